"""Near-duplicates by the Jaccard likeness of their sets of five-word shingles, none missed.

Two sets of likeness 4/5 or more have two shingles in common among the first n - ceil(4n/5) + 2 of each, in any order that is the same
for all texts (sets of one shingle: that one). So these are posted, and only texts that share two are candidates, less those whose
lengths, or a shingle's place in both, rule the likeness out. Shingles that a sample finds often come last in the order, so that
common phrases bring few texts together; the order has no effect on the result. Equal texts are one: a task posts each once.

Texts that share some shingles by chance grow in number with the square of the corpus, and a set takes more bytes than its text. So
candidates first meet by their parities alone: a bit for each of n to 2n ranges of shingles, whether the set has an odd number there.
Each bit in which two texts differ is a shingle that only one has; alike texts differ in no more than a ninth of n + m. This
rules out no alike texts, and nearly all others. What is left is compared on the whole sets.

Texts that are all alike would be candidates in all pairs. So each text is first compared with one centre alone: of the texts that have
the smallest id at some shared shingle, the one with which it shares the most. A centre's texts are dealt into parts of about ``STAR_ROWS``.
Whoever is like their centre is connected, and candidates are pairs across what isn't connected yet. These are compared where their
component of candidates is: its sets go there once, and pairs that have become connected aren't compared. Components of more than
``TOGETHER`` shingles aren't gathered; their pairs meet one by one.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text of fewer than five words has one shingle, of all of them;
null, empty and blank texts have none and are like no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint, combine, drop_shuffles, lean, slices, utf8, word_hashes
from palimpsest.llm.components import components
from palimpsest.llm.simhash import fingerprints, grouped, row_key

WIDTH = 5
#: Rows of the sample, about; shingles it may put last; pairs made at a time; rows that may be broadcast.
SAMPLE, MOST_COMMON, PAIRS, BROADCAST_ROWS = 10_000, 1 << 18, 1 << 20, 1 << 20
#: Shingles of a component of candidates that are compared in one place; texts that meet a copy of their centre, about.
TOGETHER, STAR_ROWS = 1 << 22, 512


def shingles(texts: list[bytes], common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle): each text's set, in order. common: sorted shingles and how often the sample has them."""
    h, counts = word_hashes(texts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    s = h
    for k in range(1, WIDTH):
        ahead = np.zeros_like(h)
        ahead[:-k or None] = h[k:]
        s = combine(s, np.where(left > k, ahead, np.uint64(0)))
    row = np.repeat(np.arange(len(texts)), counts)
    first = left == counts[row]
    keep = (left >= WIDTH) | first
    row, s = row[keep], s[keep]
    often = np.zeros(len(s), np.int64)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        often = np.where(common[0][at] == s, common[1][at], 0)
    order = np.lexsort((s, often, row))
    row, s = row[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1])
    return row[new], s[new]


def parities(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The size of each text's set, and its parities: of 2**k ranges of shingles, as many as the set has or up to twice that, 64 at least."""
    row, s = shingles(texts)
    n = np.bincount(row, minlength=len(texts))
    bits = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)))
    end = np.cumsum(bits)
    odd = np.bincount((end - bits)[row] + (s & (bits - 1).astype(np.uint64)[row]).astype(np.int64), minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(bool), bitorder="little").tobytes()
    return n, [packed[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), end.tolist(), strict=True)]


def fewest_apart(a: bytes, b: bytes) -> int:
    """A number of shingles that one of two sets, at least, has and the other hasn't, from their parities; the longer ones are folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _possible(n: np.ndarray, at: np.ndarray, other_n: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """Whether sets of these lengths that share a shingle at these places, and one before at most, may be alike."""
    return 9 * (1 + np.minimum(n - at, other_n - other_at)) >= 4 * (n + other_n)


def _pairs(shingle: np.ndarray, sid: np.ndarray, n: np.ndarray, at: np.ndarray, before: np.ndarray, label: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of different labels among rows sorted by shingle and n: ids, lengths and labels, the smaller id first, and how many shingles are known to be shared.

    Each text of a shingle meets those of other labels, but texts of its most frequent label aren't gone through.
    Two texts that have the same shingle before this one met there, and if their likeness isn't ruled out here, it wasn't there.
    There the next shingle was counted as well. before: as of shared_shingles.
    """
    before, after = before >> 16, before & 0xFFFF
    group = np.cumsum(np.concatenate([[0], shingle[1:] != shingle[:-1]])).astype(np.int64)
    order = np.lexsort((label, group))
    g, x = group[order], label[order]
    start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])]))
    size = np.diff(start, append=len(g))
    best = start[np.lexsort((size, g[start]))]
    top = x[best[np.concatenate([g[best][1:] != g[best][:-1], [True]])]]
    rest = label != top[group]
    rows = np.flatnonzero(rest)
    key = group << 32 | n
    low = np.searchsorted(key, group[rows] << 32 | (4 * n[rows] + 4) // 5)
    high = np.searchsorted(key, group[rows] << 32 | n[rows] * 5 // 4, "right")
    upto = np.concatenate([[0], np.cumsum(high - low)])
    k = 0
    while k < len(rows):
        end = max(k + 1, int(np.searchsorted(upto, upto[k] + PAIRS, "right")) - 1)
        many = high[k:end] - low[k:end]
        a = np.repeat(rows[k:end], many)
        b = np.arange(len(a)) - np.repeat(upto[k:end] - upto[k] - low[k:end], many)
        good = (label[a] != label[b]) & (~rest[b] | (a < b)) & _possible(n[a], at[a], n[b], at[b])
        good &= (before[a] != before[b]) | (at[a] == 0) | (at[b] == 0)
        a, b = a[good], b[good]
        other = sid[a] > sid[b]
        a, b = np.where(other, b, a), np.where(other, a, b)
        both, which = np.unique(np.stack([sid[a], n[a], label[a], sid[b], n[b], label[b]], axis=1), axis=0, return_inverse=True)
        if len(both):
            times = np.bincount(which.reshape(-1), 1 + (after[a] == after[b]), len(both)).astype(np.int64)
            yield np.concatenate([both, times[:, None]], axis=1)
        k = end


def _new(ids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Places of the ids that weren't seen, which are seen from now on."""
    return np.array([k for k, i in enumerate(ids.tolist()) if i not in seen and not seen.add(i)], np.int64)


def shared_shingles(docs: DataFrame) -> DataFrame:
    """(shingle, sid, n, at, before, centre): the posted shingles that texts share, each text's once. docs: (sid, text); equal ids have equal texts.

    centre: the smallest id that has the shingle, null for itself and where the likeness is ruled out. before: 32 bits of the shingle before
    in the text's order, then 16 of the one after.
    """
    total = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(texts[a:b])[1].view(np.int64))], names=["shingle"])

    some = docs.filter(F.pmod(F.xxhash64("sid"), F.lit(1 << 20)) < (SAMPLE << 20) // max(total, 1))
    often = some.mapInArrow(lean(count), "shingle long").groupBy("shingle").count().filter("count > 1").orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    found, n = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(found)
    shared = docs.sparkSession.sparkContext.broadcast((found[order], n[order]))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.take(pa.array(_new(batch.column(0).to_numpy(), seen)))
            texts, sid = utf8(batch.column(1)), batch.column(0).to_numpy()
            for a, b in slices(texts):
                row, s = shingles(texts[a:b], shared.value)
                n = np.bincount(row, minlength=b - a)
                at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                n = n[row]
                first = at <= n - (4 * n + 4) // 5 + 1
                before = (np.concatenate([s[:1], s[:-1]]).astype(np.uint32).astype(np.int64) << 16) | np.concatenate([s[1:], s[-1:]]).astype(np.uint16)
                columns = s[first].view(np.int64), sid[a:b][row[first]], n[first].astype(np.int32), at[first].astype(np.int32), before[first]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "sid", "n", "at", "before"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by shingle and sid; the first of a shingle is held back until there is another."""
        first = held = last = None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
            if not len(rows):
                continue
            ids = rows[:, :2] if last is None else np.concatenate([last[None], rows[:, :2]])
            new = np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])
            rows, last = rows[new[len(new) - len(rows) :]], rows[-1, :2]
            if not len(rows):
                continue
            if first is not None:  # the centre of the shingle before, which may have been written
                rows = np.concatenate([first[None], rows])
            begin = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            centre = np.maximum.accumulate(np.where(begin, np.arange(len(rows)), 0))
            c = rows[centre]
            good = ~begin & _possible(rows[:, 2], rows[:, 3], c[:, 2], c[:, 3])
            keep = ~begin | np.concatenate([~begin[1:], [False]])
            if first is not None and not held:
                keep[0] = False
            first, held = rows[centre[-1]], bool(begin[-1])
            if keep.any():
                columns = [pa.array(rows[keep, k].astype(t)) for k, t in enumerate((np.int64, np.int64, np.int32, np.int32, np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(c[keep, 1], mask=~good[keep])], names=["shingle", "sid", "n", "at", "before", "centre"])

    posts = docs.mapInArrow(lean(post), "shingle long, sid long, n int, at int, before long")
    return posts.repartition("shingle").sortWithinPartitions("shingle", "sid").mapInArrow(lean(share), "shingle long, sid long, n int, at int, before long, centre long")


def candidates(shared: DataFrame) -> DataFrame:
    """(a, na, la, b, nb, lb): ids, lengths and labels of texts of different labels that may be alike, each pair once. shared: (shingle, sid, n, at, before, label)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, ...]] = []

        def settle(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]):
                for both in _pairs(*rows):
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in range(7)], names=["a", "na", "la", "b", "nb", "lb", "times"])

        for batch in batches:
            rows = tuple(batch.column(k).to_numpy().astype(np.int64) for k in range(6))
            if not len(rows[0]):
                continue
            pending.append(rows)
            if pending[0][0][0] == rows[0][-1]:
                continue  # one shingle so far
            whole = tuple(np.concatenate(x) for x in zip(*pending, strict=True))
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            yield from settle(tuple(x[:last] for x in whole))
            pending = [tuple(x[last:] for x in whole)]
        if pending:
            yield from settle(tuple(np.concatenate(x) for x in zip(*pending, strict=True)))

    rows = shared.select("shingle", "sid", "n", "at", "before", "label").repartition("shingle").sortWithinPartitions("shingle", "n")
    met = rows.mapInArrow(lean(meet), "a long, na long, la long, b long, nb long, lb long, times long")
    return met.groupBy("a", "na", "la", "b", "nb", "lb").agg(F.sum("times").alias("times")).filter("times > 1 or na + nb = 2").drop("times")


def sketches(docs: DataFrame) -> DataFrame:
    """(sid, n, bits): the size of each text's set and its parities, each id once in a task at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.take(pa.array(_new(batch.column(0).to_numpy(), seen)))
            texts = utf8(batch.column(1))
            for a, b in slices(texts):
                n, bits = parities(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["sid", "n", "bits"])

    return docs.select("sid", "text").mapInArrow(lean(run), "sid long, n long, bits binary").dropDuplicates(["sid"])


def likely(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The rows of pairs (a, b and other columns) but those whose parities rule the likeness out."""
    one, two = (sketched.select(F.col("sid").alias(k), F.col("n").alias(f"_n{k}"), F.col("bits").alias(f"_x{k}")) for k in "ab")
    width = len(pairs.columns)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(width).to_numpy() + batch.column(width + 1).to_numpy()
            x, y = (batch.column(k).to_pylist() for k in (width + 2, width + 3))
            apart = np.fromiter(map(fewest_apart, x, y), np.int64, len(n))
            yield batch.select(list(range(width))).filter(pa.array(9 * apart <= n))

    return pairs.join(one, "a").join(two, "b").select(*pairs.columns, "_na", "_nb", "_xa", "_xb").mapInArrow(lean(check), pairs.schema)


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _few(df: DataFrame) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it has no more than so many."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text, the last column, is replaced by its set; equal rows of a task once."""
    seen: set[tuple] = set()
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns - 1)), strict=True))
        batch = batch.take(pa.array([k for k, x in enumerate(keys) if x not in seen and not seen.add(x)], pa.int64()))
        texts = utf8(batch.column(batch.num_columns - 1))
        for a, b in slices(texts):
            row, s = shingles(texts[a:b])
            cut = np.cumsum(np.bincount(row, minlength=b - a))[:-1]
            own = [x.tobytes() for x in np.split(s, cut)]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(own, pa.binary())], names=[*batch.schema.names[:-1], "s"])


def stars(docs: DataFrame, shared: DataFrame, star_rows: int = STAR_ROWS, sketched: DataFrame | None = None) -> DataFrame:
    """(a, b): texts that are like their centre, b. sketched: the texts' sketches."""
    counted = shared.filter("centre is not null").groupBy("sid", "centre").count()
    most = counted.groupBy("sid").agg(F.max(F.struct("count", "centre")).alias("x")).select(F.col("sid").alias("a"), F.col("x.centre").alias("b"))
    own = checkpoint(likely(most, sketched or sketches(docs)).select(F.col("a").alias("sid"), F.col("b").alias("centre")))
    sizes = checkpoint(own.groupBy("centre").agg(F.ceil(F.count("*") / star_rows).cast("int").alias("parts")))
    texts = own.join(_few(sizes), "centre").select("sid", "centre", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"))
    copies = sizes.select(F.col("centre").alias("sid"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    ends = checkpoint(texts.unionByName(copies))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for own, part, asks, sid, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                x = np.sort(np.frombuffer(s, np.uint64))
                if not asks:
                    now, centre = (own, part), x
                elif now == (own, part) and _alike(centre, x):
                    a.append(sid)
                    b.append(own)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets = docs.join(_few(ends), "sid").select("centre", "part", "asks", "sid", "text").mapInArrow(lean(_sets), "centre long, part int, asks boolean, sid long, s binary")
    return sets.repartition("centre", "part").sortWithinPartitions("centre", "part", "asks").mapInArrow(lean(compare), "a long, b long").distinct()


def links(docs: DataFrame, together: int = TOGETHER, star_rows: int = STAR_ROWS) -> DataFrame:
    """(a, b): links that connect the different texts that are alike, by their ids. docs: (sid, text); equal ids have equal texts."""
    spark = docs.sparkSession
    shared = checkpoint(shared_shingles(docs))
    drop_shuffles(spark)  # of all posted shingles
    sketched = checkpoint(sketches(docs))
    near = checkpoint(stars(docs, shared, star_rows, sketched))
    joined = checkpoint(components(near).select(F.col("node").alias("sid"), F.col("component").alias("label")))
    drop_shuffles(spark)
    pairs = checkpoint(candidates(shared.join(_few(joined), "sid", "left").withColumn("label", F.coalesce("label", "sid"))))
    del shared
    drop_shuffles(spark)
    pairs = checkpoint(likely(pairs, sketched))
    del sketched
    drop_shuffles(spark)
    label = components(pairs.select("a", "b")).select(F.col("node").alias("sid"), F.col("component").alias("label"))
    ends = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("sid"), F.col(f"n{x}").alias("n"), F.col(f"l{x}").alias("known")) for x in "ab"))).alias("x")).select("x.*").distinct()
    ends = checkpoint(ends.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    sizes = checkpoint(ends.groupBy("label").agg(F.sum("n").alias("size")))
    ends = checkpoint(ends.join(sizes, "label").select("sid", "label", "known", (F.col("size") <= together).alias("near")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, known, root = None, {}, {}, {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            found = []
            for own, a, b, k, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if own != now:
                    now, sets, known, root = own, {}, {}, {}
                if b is None:
                    sets[a], known[a] = np.sort(np.frombuffer(s, np.uint64)), k
                    root.setdefault(k, k)
                elif (x := find(known[a])) != (y := find(known[b])) and _alike(sets[a], sets[b]):
                    root[max(x, y)] = min(x, y)
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda k: [np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()]  # noqa: E731, B023
            good = pa.array([_alike(x, y) for x, y in zip(read(2), read(3), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    texts = docs.join(_few(ends), "sid").select("label", F.col("sid").alias("a"), "known", "near", "text")
    sets = checkpoint(texts.mapInArrow(lean(_sets), "label long, a long, known long, near boolean, s binary"))
    rows = sets.filter("near").select("label", "a", F.lit(None).cast("long").alias("b"), "known", "s")
    met = pairs.select("a", "b").join(ends.select(F.col("sid").alias("a"), "label", "near"), "a")
    asked = met.filter("near").select("label", "a", "b", F.lit(None).cast("long").alias("known"), F.lit(None).cast("binary").alias("s"))
    inside = rows.unionByName(asked).repartition("label").sortWithinPartitions("label", F.col("b").asc_nulls_first(), "a").mapInArrow(lean(compare), "a long, b long")
    far = sets.filter("not near").dropDuplicates(["a"])
    one, two = (far.select(F.col("a").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    apart = met.filter("not near").select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long")
    return near.unionByName(inside).unionByName(apart)


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key isn't among ``gone`` (_key)."""
    gone = checkpoint(gone)
    if gone.count() > BROADCAST_ROWS:
        return keyed.join(gone, "_key", "left_anti")
    return keyed.join(F.broadcast(gone.select(F.xxhash64("_key").alias("_id"))), F.xxhash64(keyed["_key"]) == F.col("_id"), "left_anti")


def keep_one_like(docs: DataFrame) -> DataFrame:
    """The documents that simhash.keep_one keeps, less all but the smallest doc_id of each component of texts that are alike."""
    keyed = docs.withColumn("_key", row_key())
    fps = checkpoint(fingerprints(keyed.select(F.col("_key").alias("doc_id"), "text")))
    groups = checkpoint(grouped(fps).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_least")))
    more = groups.filter("_key <> _least").select("_key").distinct()
    left = _without(keyed, more)
    drop_shuffles(docs.sparkSession)  # of the fingerprints
    alike = checkpoint(links(left.select(F.xxhash64("_key").alias("sid"), "text")))
    names = groups.select("_key", F.xxhash64("_key").alias("sid")).distinct().join(alike.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    names = checkpoint(names)
    linked = alike.join(names.select(F.col("sid").alias("a"), F.col("_key").alias("ka")), "a").join(names.select(F.col("sid").alias("b"), F.col("_key").alias("kb")), "b")
    again = components(linked.select(F.col("ka").alias("a"), F.col("kb").alias("b"))).select(F.col("node").alias("_key"))
    out = _without(keyed, more.unionByName(again))
    # rows that are equal
    twice = checkpoint(groups.groupBy("_key").count().filter("count > 1").select("_key"))
    if twice.isEmpty():
        return out.select(*docs.columns)
    return _without(out, twice).unionByName(out.join(twice, "_key", "left_semi").dropDuplicates(["_key"])).select(*docs.columns)
