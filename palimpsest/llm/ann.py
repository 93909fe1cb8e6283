"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors get one more coordinate that gives all the same length, so that the largest inner product is the smallest distance. A
sample is halved again and again, each part at the median of its widest direction, until parts are small: their means are the
centroids, whose lists are of like size. A vector goes to its nearest centroid's list and, near a boundary, to those of up to
``REPLICAS`` centroids whose distance is at most (1 + ``SPREAD``) times the least. Centroids are found by a best-first search of a
graph of their neighbours, held in memory. A query looks at the lists of the centroids whose distance is at most (1 + ``RATIO``)
times the least but one, ``LEAST_LISTS`` at least. If those are more than ``MOST_LISTS``, as on vectors without clusters, it is compared
with every vector instead, so its answer is exact; with a ``most_lists`` of 0 that is so for every query. Scores are inner products in
double precision of the original vectors.

The common length is that of the sample's ``LENGTH_QUANTILE`` if few vectors are more than twice as long: these are in a list of their
own that every query reads, so that they don't flatten the index. Equal vectors are one entry with its smallest ids, one more than are
asked for: others can't be among the nearest. The sample is a hundredth of the vectors, at least ``SAMPLE`` and at most ``MAX_SAMPLE``, and bounds
the centroids; every vector is indexed. A list's task reads its vectors in blocks. Entries that tie with the last of the nearest
are all ranked, by vec_id.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do rows with a null
id, nor vectors of another length than the most frequent one (of equally frequent ones the shortest). Rows that repeat an id
count once, with the smallest vector. With fewer candidates than asked for, all are returned. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint, lean, table

#: Vectors per list, about; rows of the sample; neighbours of a centroid in the graph; entries kept in a search at least.
LIST_ROWS, SAMPLE, MAX_SAMPLE, DEGREE, BEAM = 200, 20_000, 200_000, 24, 16
REPLICAS, SPREAD, RATIO, LEAST_LISTS, MOST_LISTS = 6, 0.08, 0.35, 16, 64
BLOCK = 4096
#: Rows of the sample that tell how long lists are; entries in a part of a list, about; of the list of all, at least; scores at a time.
PROBE, PART_ROWS, LEAST_ROWS, SCORES = 4000, 1 << 16, 1 << 12, 1 << 22
#: Vectors longer than twice this quantile of the sample's lengths are long.
LENGTH_QUANTILE = 0.99
#: The list of every vector once, for queries that no choice of lists serves, and the list of long vectors.
ALL, LONG = -1, -2


class Centroids:
    """Centroids in the lengthened space, and the graph of their neighbours."""

    def __init__(self, sample: np.ndarray, radius: float, list_rows: float, degree: int = DEGREE):
        self.radius = radius
        x = self.lengthened(sample)
        parts = []
        todo = [np.arange(len(x))] if len(x) else []
        while todo:
            part = todo.pop()
            if len(part) <= max(2.0, list_rows):
                parts.append(part)
                continue
            p = x[part] - x[part].mean(axis=0)
            d = p[np.argmax((p * p).sum(axis=1))]
            for _ in range(4):  # the widest direction, by power iteration
                d = p.T @ (p @ d)
                d /= np.linalg.norm(d) or 1.0
            order = np.argsort(p @ d, kind="stable")
            half = len(part) // 2
            todo += [part[order[half:]], part[order[:half]]]
        self.points = np.array([x[part].mean(axis=0) for part in parts], np.float32) if parts else np.empty((0, sample.shape[1] + 1), np.float32)
        # nearest neighbours, a chain through the parts that keeps the graph in one piece, and a few distant ones
        n, near = len(self.points), []
        for a in range(0, n, 512):
            d = self._distance(self.points[a : a + 512])
            some = np.argpartition(d, min(degree, n - 1), axis=1)[:, : degree + 1]
            order = np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable")
            near.append(np.take_along_axis(some, order, 1)[:, 1:])
        links = np.concatenate(near) if n > 1 else np.zeros((n, 0), np.int64)
        i = np.arange(n)
        far = np.stack([(i + 1) % max(n, 1), (i - 1) % max(n, 1), *((i * 2654435761 + s) % max(n, 1) for s in (7, 13))], axis=1)
        self.links = np.concatenate([links, far], axis=1)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = (x / max(self.radius, np.finfo(np.float64).tiny)).astype(np.float32)
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    @staticmethod
    def direction(q: np.ndarray) -> np.ndarray:
        """A query, whose length doesn't matter, in the lengthened space."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
        return np.concatenate([q, np.zeros((len(q), 1), np.float32)], axis=1)

    def _distance(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x * x).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1) - 2 * x @ self.points.T)

    def search(self, x: np.ndarray, most: int, beam: int = BEAM, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row, nearest first, and their distances, by best-first search of the graph."""
        n, q = len(self.points), len(x)
        beam = min(max(beam, most + most // 2), n)
        start = np.unique(np.linspace(0, n - 1, min(n, beam)).astype(np.int64))
        ids = np.broadcast_to(start, (q, len(start))).copy()
        norm = (self.points * self.points).sum(axis=1)
        own = (x * x).sum(axis=1)[:, None]
        dist = norm[ids] - 2 * x @ self.points[start].T
        done = np.zeros(ids.shape, bool)
        while True:
            rank = np.where(done, np.inf, dist)
            pick = np.argpartition(rank, min(width, rank.shape[1]) - 1, axis=1)[:, :width]
            fresh = np.take_along_axis(rank, pick, 1) < np.inf
            if not fresh.any():
                break
            np.put_along_axis(done, pick, True, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(q, -1)
            far = norm[new] - 2 * np.einsum("qd,qkd->qk", x, self.points[new])
            far = np.where(np.repeat(fresh, self.links.shape[1], axis=1), far, np.inf)
            ids, dist, done = np.concatenate([ids, new], 1), np.concatenate([dist, far], 1), np.concatenate([done, np.zeros(new.shape, bool)], 1)
            # an entry once only, the one already expanded first
            order = np.lexsort((~done, ids), axis=1)
            ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
            dist[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(a, order, 1) for a in (ids, dist, done))
            done |= dist == np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(0, np.take_along_axis(dist, order, 1) + own))

    def choose(self, x: np.ndarray, ratio: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of all centroids within the ratio of the nearest one's distance."""
        ids, dist = self.search(x, most)
        good = (dist <= dist[:, :1] * (1 + ratio)) | (np.arange(ids.shape[1]) < least)
        good &= np.isfinite(dist)
        row, col = np.nonzero(good)
        return row, ids[row, col]

    def ask(self, x: np.ndarray, ratio: float = RATIO, least: int = LEAST_LISTS, most: int = MOST_LISTS) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) that queries read: those within the ratio, or ALL where these are too many.

        The ratio is to the least distance but one: the centroid of a query's own list is a mean of few vectors, maybe the query among them.
        """
        ids, dist = self.search(x, most + 1)
        good = (dist <= dist[:, : min(2, dist.shape[1])].max(axis=1, keepdims=True) * (1 + ratio)) | (np.arange(ids.shape[1]) < least)
        good &= np.isfinite(dist)
        many = good.sum(axis=1) > most
        row, col = np.nonzero(good & ~many[:, None])
        return np.concatenate([row, np.flatnonzero(many)]), np.concatenate([ids[row, col], np.full(many.sum(), ALL)])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def valid_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision."""
    v = vectors[vector].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id is not null and v is not null").filter(~bad & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    # 0.0 for -0.0, so that equal vectors have equal bits
    rows = rows.filter(F.size("v") == (top[0]["n"] if top else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): each vector once, with its smallest ids."""

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal vectors in a batch the smallest ids."""
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            key = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
            ids = batch.column(0).to_numpy()
            order = np.lexsort((ids, np.unique(key, return_inverse=True)[1]))
            same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            yield batch.take(pa.array(np.sort(order[np.arange(len(order)) - start < keep])))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by vector and id."""
        now, v, ids = b"", None, []
        vs, lists = [], []
        for batch in batches:
            x = np.ascontiguousarray(_matrix(batch.column(1)))
            for k, i in enumerate(batch.column(0).to_pylist()):
                key = x[k].tobytes()
                if key != now:
                    if ids:
                        vs.append(v)
                        lists.append(ids)
                    now, v, ids = key, x[k], []
                if len(ids) < keep:
                    ids.append(i)
            if vs:
                yield pa.RecordBatch.from_arrays([pa.array(vs, pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int64()))], names=["v", "ids"])
                vs, lists = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.float64())), pa.array([ids], pa.list_(pa.int64()))], names=["v", "ids"])

    some = rows.select("vec_id", "v").mapInArrow(lean(fewer), "vec_id long, v array<double>")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return some.repartition(n, "v").sortWithinPartitions("v", "vec_id").mapInArrow(lean(gather), "v array<double>, ids array<long>")


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> Iterator[tuple[int, int, float]]:
    """(query, id, score) of each query's k nearest among the entries, ties to smaller ids."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        n = min(len(x), k + 1)  # one of the entries may be the query alone
        last = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
        # twice what the products' rounding may be: whoever is as near as the last is above
        slack = 4 * q.shape[1] * np.finfo(np.float64).eps * np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1).max())
        floor = np.where(np.isfinite(last - slack), last - slack, np.where(last == np.inf, np.finfo(np.float64).max, -np.inf))
    smallest = np.array([own[0] for own in ids])
    for i in range(len(q)):
        top = np.flatnonzero(rough[i] >= floor[i])
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.nan_to_num((q[i] * x[top]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        best = np.lexsort((smallest[top], -exact))[: k + 1]
        found = sorted((-s, v) for s, t in zip(exact[best].tolist(), top[best].tolist(), strict=True) for v in ids[t] if v != qid[i])[:k]
        for s, v in found:
            yield int(qid[i]), v, -s


def nearest(vectors: DataFrame, queries, k: int = 20, vector: str = "embedding", list_rows: int = LIST_ROWS, replicas: int = REPLICAS, ratio: float = RATIO, least_lists: int = LEAST_LISTS, most_lists: int = MOST_LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other vectors.

    :param queries: a condition on vec_id
    :param replicas: lists that a vector near a boundary may be in
    :param ratio: of a list's distance to the least that a query reads
    :param least_lists: lists that a query reads in any case
    :param most_lists: a query that would read more is compared with every vector; 0: each is
    """
    spark = vectors.sparkSession
    rows = checkpoint(valid_vectors(vectors, vector))
    entries = checkpoint(distinct_vectors(rows, k + 1))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    count, longest = entries.agg(F.count("*"), F.max(norm)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # by a hash below a threshold first, so that no task sorts more than a few times the sample
    wanted = min(MAX_SAMPLE, max(SAMPLE, count // 100))
    some = entries.select("v").filter(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) < min(1 << 30, (wanted + wanted // 4 << 30) // count))
    x = np.array(some.orderBy(F.xxhash64("v"), "v").limit(wanted).toArrow()["v"].to_pylist(), np.float64)
    with np.errstate(over="ignore"):
        lengths = np.sqrt((x * x).sum(axis=1))
    usual = 2 * float(np.quantile(lengths, LENGTH_QUANTILE, method="lower"))
    radius, n_long = (longest, 0) if longest <= usual else (usual, entries.filter(norm > usual).count())
    if not np.isfinite(radius):  # nearly all are that long: no index, everything is compared
        radius, n_long = 0.0, count
    x = x[lengths <= radius] if n_long else x
    index = Centroids(x, radius, max(2.0, list_rows * len(x) / max(1, count - n_long)))
    if not len(x):
        most_lists = 0
    shared = spark.sparkContext.broadcast(index)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if most_lists:
                    row, centroid = c.ask(c.direction(_matrix(part.column(1))), ratio, least_lists, most_lists)
                    if n_long:  # whoever reads every vector reads the long ones there
                        row, centroid = np.concatenate([row, np.unique(row[centroid != ALL])]), np.concatenate([centroid, np.full(len(np.unique(row[centroid != ALL])), LONG)])
                else:
                    row, centroid = np.arange(part.num_rows), np.full(part.num_rows, ALL)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(centroid.astype(np.int32)), part.column(0).take(at), part.column(1).take(at), pa.nulls(len(row), pa.list_(pa.int64()))], names=["list", "query", "v", "ids"])

    schema = "list int, query long, v array<double>, ids array<long>"
    asks = checkpoint(rows.filter(queries).select("vec_id", "v").mapInArrow(lean(ask), schema))
    # vectors are posted to lists that are asked for; a row per centroid at most
    asked = {x[0] for x in asks.select("list").distinct().collect()}
    every, apart, some_lists = ALL in asked, LONG in asked, np.isin(np.arange(len(index.points)), list(asked))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                row, centroid, v = np.empty(0, np.int64), np.empty(0, np.int64), _matrix(part.column(0))
                usual = np.arange(len(v))
                if n_long:
                    with np.errstate(over="ignore"):
                        over = (v * v).sum(axis=1) > c.radius * c.radius
                    usual = np.flatnonzero(~over)
                if some_lists.any() and len(usual):
                    row, centroid = c.choose(c.lengthened(v[usual]), SPREAD, 1, replicas)
                    row, centroid = usual[row[some_lists[centroid]]], centroid[some_lists[centroid]]
                if apart and n_long:
                    row, centroid = np.concatenate([row, np.flatnonzero(over)]), np.concatenate([centroid, np.full(over.sum(), LONG)])
                if every:
                    row, centroid = np.concatenate([row, np.arange(part.num_rows)]), np.concatenate([centroid, np.full(part.num_rows, ALL)])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(centroid.astype(np.int32)), pa.nulls(len(row), pa.int64()), part.column(0).take(at), part.column(1).take(at)], names=["list", "query", "v", "ids"])

    # a long list's entries in parts, each of which meets all of its queries; how long it is about, the sample tells
    posts = entries.mapInArrow(lean(post), schema)
    found = np.zeros(len(index.points))
    if some_lists.any():
        some = x[:PROBE]
        found = np.bincount(index.choose(index.lengthened(some), SPREAD, 1, replicas)[1], minlength=len(index.points)) * ((count - n_long) / len(some))
    split = [(int(c), int(n)) for c, n in enumerate(np.ceil(found / PART_ROWS)) if n > 1]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split += [(c, max(-(-n // PART_ROWS), min(tasks, -(-n // LEAST_ROWS)))) for c, n in ((ALL, count if every else 0), (LONG, n_long if apart else 0)) if n]
    n_parts = F.lit(1)
    if split:  # a row per centroid at most
        many = F.broadcast(spark.createDataFrame(split, "list int, parts int"))
        posts, asks, n_parts = posts.join(many, "list", "left"), asks.join(many, "list", "left"), F.coalesce("parts", F.lit(1))
    posts = posts.withColumn("part", F.pmod(F.xxhash64("v"), n_parts).cast("int")).select("list", "part", "query", "v", "ids")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))).select("list", "part", "query", "v", "ids")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, ids, out = None, [], [], []
        for batch in batches:
            lists, asked, v, own = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False), _matrix(batch.column(3)), batch.column(4)
            cut = np.flatnonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (asked[1:] != asked[:-1])]))
            for a, b in zip(cut, [*cut[1:], len(lists)], strict=True):
                if lists[a] != now:
                    now, x, ids = lists[a], [], []
                if not asked[a]:
                    x.append(v[a:b])
                    ids += own.slice(a, b - a).to_pylist()
                elif ids:
                    if len(x) > 1:
                        x = [np.concatenate(x)]
                    step = max(1, min(256, SCORES // len(x[0])))
                    for s in range(a, b, step):
                        e = min(b, s + step)
                        out += _best(v[s:e], batch.column(2).slice(s, e - s).to_numpy(), x[0], ids, k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])
                out = []

    met = posts.unionByName(asks).repartition("list", "part").sortWithinPartitions("list", "part", F.col("query").asc_nulls_first()).mapInArrow(lean(meet), "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
