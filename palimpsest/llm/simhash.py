"""SimHash near-duplicates, found by covering the fingerprints with the words of a code.

A fingerprint has 64 bits; a bit is 1 if it is 1 in over half the hashes of the text's shingles. To find all pairs of at most
``distance`` differing bits, the bits are cut into three blocks. In one block at least such a pair differs in at most
distance // 3 bits. The anchors of a block are the words of a covering code: a Hamming code of 15 bits, which has a word
within one bit of any pattern, times all patterns of the block's other bits. A fingerprint's home is its nearest anchor, at
most ``RADIUS`` = 1 bit away; a copy goes to every anchor within RADIUS plus the block's threshold. So a pair that is close in a
block meets at the home of either. Only homes are compared with copies, once per anchor, on all 64 bits.

Equal fingerprints are one row before anything else. Anchors with more than ``HOME_ROWS`` homes are split into a grid: homes are
dealt into rows, copies into columns, and each cell compares its own. A task returns a spanning forest of the links it found, never
all pairs.

Defined results: null, empty and blank texts have fingerprint 0, which is linked like any other. Rows with equal doc_id are
kept; a null doc_id takes part but names no component, and one of nulls alone has a null component_id. A bit that is 1 in exactly
half the hashes is 0. Of long texts every word counts, a block of ``BLOCK`` bytes at a time. An empty table gives an empty
result. Other columns of the input aren't looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint, lean, table, utf8
from palimpsest.llm.components import components, local_stars

DISTANCE, WIDTH, SEED = 4, 4, 42
#: (first bit, number of bits) of the blocks; the code covers the first 15 bits of each.
BLOCKS = ((0, 21), (21, 21), (42, 22))
CODE_BITS, RADIUS = 15, 1
#: Bits of a block whose positions, counted from 1, have this bit set: the code's parity checks.
CHECKS = tuple(sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> k & 1) for k in range(4))
#: Homes of an anchor that are compared in one part; split anchors that may be broadcast; pairs compared at a time.
HOME_ROWS, BROADCAST_ANCHORS, PAIRS = 4096, 10_000, 1 << 20
_HASHES = 1 << 16
#: Bytes of a text that are split into words at a time, about.
BLOCK = 4 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(text: bytes) -> Iterator[bytes]:
    """The text in blocks that end between words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        end = cut.end() if cut else len(text)
        yield text[at:end] if end - at < len(text) else text
        at = end


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint of the shingles of a UTF-8 text's words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for block in _blocks(text):
        words = held + block.lower().split()
        held = words[max(0, len(words) - width + 1) :]
        if len(words) >= width:
            ones += _ones(words, width, seed)
            total += len(words) - width + 1
    if not total:
        if not held:
            return 0
        ones, total = _ones(held, len(held), seed), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _ones(words: list[bytes], width: int, seed: int) -> np.ndarray:
    """For each bit, in how many of the shingles' hashes it is 1."""
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    starts, ends, h = starts[:n].tolist(), ends[-n:].tolist(), xxhash.xxh64_intdigest
    out = np.zeros(64, np.int64)
    for k in range(0, n, _HASHES):
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[k : k + _HASHES], ends[k : k + _HASHES], strict=True)], np.uint64)
        out += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x, width, seed) for x in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    source = docs.select(docs["doc_id"].alias("doc_id"), docs[text].cast("string").alias("text"))
    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndrome_of(pattern: int) -> int:
    return sum(((pattern & m).bit_count() & 1) << k for k, m in enumerate(CHECKS))


def offsets(bits: int, within: int) -> list[list[int]]:
    """For each syndrome the patterns of at most so many bits that lead from a block of it to an anchor."""
    out: list[list[int]] = [[] for _ in range(16)]
    for n in range(within + 1):
        for chosen in combinations(range(bits), n):
            pattern = sum(1 << b for b in chosen)
            out[_syndrome_of(pattern & ((1 << CODE_BITS) - 1))].append(pattern)
    return out


def _block(fp: Column, first: int, bits: int) -> tuple[Column, Column]:
    """A block's bits and its syndrome."""
    x = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
    checks = [F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), k) for k, m in enumerate(CHECKS)]
    return x, checks[0].bitwiseOR(checks[1]).bitwiseOR(checks[2]).bitwiseOR(checks[3])


def homes(fps: DataFrame) -> DataFrame:
    """(anchor, fp): the home of each fingerprint in every block."""
    keys = []
    for k, (first, bits) in enumerate(BLOCKS):
        x, s = _block(F.col("fp"), first, bits)
        flip = F.when(s == 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1), s - 1))
        keys.append(x.bitwiseXOR(flip.cast("long")).bitwiseOR(F.lit(k << 32)))
    return fps.select(F.explode(F.array(*keys)).alias("anchor"), "fp")


def copies(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(anchor, fp, home): every anchor of each block within RADIUS plus the block's threshold; home: whether it is the home."""
    def block(k: int, first: int, bits: int) -> Column:
        x, s = _block(F.col("fp"), first, bits)
        near = F.array(*(F.array(*(F.lit(p).cast("long") for p in row)) for row in offsets(bits, RADIUS + distance // len(BLOCKS))))
        home = F.when(s == 0, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1), s - 1)).cast("long")
        return F.transform(F.element_at(near, s + 1), lambda p: F.struct(x.bitwiseXOR(p).bitwiseOR(F.lit(k << 32)).alias("anchor"), (p == home).alias("home")))

    every = F.concat(*(block(k, first, bits) for k, (first, bits) in enumerate(BLOCKS)))
    return fps.select(F.explode(every).alias("c"), "fp").select("c.anchor", "fp", "c.home")


def _compare(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, copy: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the homes and the copies of each anchor; rows are sorted by anchor."""
    a, b, held = [], [], 0
    own_anchor, own_fp = anchor[home], fp[home]
    anchor, fp = anchor[copy], fp[copy]
    low, high = np.searchsorted(anchor, own_anchor), np.searchsorted(anchor, own_anchor, "right")
    upto = np.concatenate([[0], np.cumsum(high - low)])
    k = 0
    while k < len(own_fp):
        end = max(k + 1, int(np.searchsorted(upto, upto[k] + PAIRS, "right")) - 1)
        n = high[k:end] - low[k:end]
        right = np.arange(int(n.sum())) - np.repeat(upto[k:end] - upto[k] - low[k:end], n)
        x, y = np.repeat(own_fp[k:end], n), fp[right]
        near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
        if near.any():
            x, y = local_stars(x[near], y[near])
            a.append(x)
            b.append(y)
            held += len(x)
            if held > 1 << 20:
                x, y = local_stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        k = end
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, distance: int = DISTANCE, home_rows: int = HOME_ROWS, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """(a, b): links of different fingerprints that connect all those within the distance. fps: (fp), each once."""
    # a fingerprint becomes dozens of copies: that many tasks, however few bytes the fingerprints themselves are
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    hot = homes(fps).groupBy("anchor").count().filter(F.col("count") > home_rows).select("anchor", F.ceil(F.col("count") / home_rows).cast("int").alias("parts"))
    rows, found = copies(fps, distance), hot.limit(broadcast_anchors + 1).collect()
    if found:
        bounded = F.broadcast(fps.sparkSession.createDataFrame(found, hot.schema)) if len(found) <= broadcast_anchors else hot
        n = F.coalesce("parts", F.lit(1))
        own, every = F.pmod(F.xxhash64("fp"), n).cast("int"), F.sequence(F.lit(0), n - 1)
        # cell i * parts + j holds the homes of row i and the copies of column j; a home is a copy, too, in its own column
        column = F.transform(every, lambda i: F.struct((i * n + own).alias("part"), (F.col("home") & (i == own)).alias("home"), F.lit(True).alias("copy")))
        row = F.transform(F.filter(every, lambda j: F.col("home") & (j != own)), lambda j: F.struct((own * n + j).alias("part"), F.lit(True).alias("home"), F.lit(False).alias("copy")))
        rows = rows.join(bounded, "anchor", "left").select("anchor", "fp", F.explode(F.concat(column, row)).alias("x"))
        rows = rows.select("anchor", "x.part", "fp", "x.home", "x.copy")
    else:
        rows = rows.select("anchor", F.lit(0).alias("part"), "fp", "home", F.lit(True).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0

        def settle(cut: tuple[np.ndarray, ...]) -> None:
            nonlocal a, b, held
            x, y = _compare(*cut, distance)
            a.append(x)
            b.append(y)
            held += len(x)
            if held > 1 << 20:
                x, y = local_stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0

        pending: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            # the part is folded into the anchor's free high bits
            key = batch.column(0).to_numpy() | batch.column(1).to_numpy().astype(np.int64) << 36
            pending.append((key, batch.column(2).to_numpy().view(np.uint64), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))))
            if key[0] == key[-1] and (len(pending) == 1 or pending[0][0][0] == key[0]):
                continue  # one anchor so far
            whole = tuple(np.concatenate(x) for x in zip(*pending, strict=True))
            last = int(np.searchsorted(whole[0], whole[0][-1]))
            settle(tuple(x[:last] for x in whole))
            pending = [tuple(x[last:] for x in whole)]
        if pending:
            settle(tuple(np.concatenate(x) for x in zip(*pending, strict=True)))
        if held:
            x, y = local_stars(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    # sorted as the folded key is: by part, then anchor
    return rows.repartition("anchor", "part").sortWithinPartitions("part", "anchor").mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", distance: int = DISTANCE, width: int = WIDTH, seed: int = SEED, home_rows: int = HOME_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): one row per document; components join texts whose fingerprints are linked."""
    return grouped(checkpoint(fingerprints(docs, text, width, seed)), distance, home_rows)


def grouped(fps: DataFrame, distance: int = DISTANCE, home_rows: int = HOME_ROWS) -> DataFrame:
    """As near_duplicates, of a written table (doc_id, fp)."""
    if distance // len(BLOCKS) > 1:
        raise ValueError("a distance of at most 5 is covered")
    each = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(each.select("fp"), distance, home_rows))
    named = each.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # a written table on either side lets Spark split the rows of a large component
    least = checkpoint(named.groupBy("component").agg(F.min("least").alias("component_id")))
    named = checkpoint(named.select("fp", "component").join(least, "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def row_key() -> Column:
    """A key of doc_id and text, ordered as doc_id is, nulls last."""
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(number, F.lit("~")), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents, all their columns, less all but one of each component: of its smallest doc_id stays one row, nulls last."""
    keyed = docs.withColumn("_key", row_key())
    kept = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), "text", distance).filter("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
