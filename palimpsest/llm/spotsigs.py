"""SpotSigs fingerprints: chains of content words that follow common words.

Anchors are the commonest words of some languages and the text's start. A signature is an anchor with the ``CHAIN`` content words
after it, where common words are skipped; near the text's end a chain may be shorter. A text's fingerprint is the set of its
signatures, 32 bits each, sorted, written as 8 hexadecimal digits each. The likeness of two fingerprints is the Jaccard
similarity of their sets, and can be had from the strings alone.

Near-duplicates: equal sets are one class. Classes are partitioned by set length into ranges so wide that similar sets lie in the
same range or in neighbouring ones. Within, sets meet at their rarest signatures only, as many as a pair of that likeness can't
miss; each meeting is pruned by length first and then compared by the exact likeness of the whole sets.

Defined results: words are runs of ASCII letters and digits and of other code points over 127; A-Z count as a-z. A text of words
always has a signature, for its start is an anchor, and a text of common words alone has one of all its words; one without words
has one of all its bytes. Null and empty texts have an empty fingerprint; two empty ones have likeness 1, an empty one and another 0.
Documents are ordered by doc_id descending, nulls last, then by text; the last is followed by the first, a single one by itself.
Repeated rows are kept; documents of equal ids come in the order of their texts, equal ones in any. Long texts are hashed a
block of words at a time; beside the text they take some 60 bytes a word. Columns other than doc_id and text aren't looked at. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import LETTER_BYTES, checkpoint, combine, lean, slices, table, utf8, word_hash, word_hashes

#: The commonest words of English, French, German and Spanish.
COMMON = (
    "the of and to in a is that for it as was with be by on not he are or his from at which this have an had they you were but "
    "le la les de du des un une et est que qui dans pour par sur pas au avec en ce il se ne plus son "
    "der die das den dem und ist von zu mit sich des auf für im nicht ein eine als auch es er hat aus bei "
    "el los las y del al que en por con para una su no lo como más pero sus"
).split()
CHAIN = 3
#: Documents in a range of ids that a task takes in order, as long as there are fewer than MAX_RANGES; quantiles that are cut at,
#: between which ranges are of equal width.
RANGE_ROWS, MAX_RANGES, SEGMENTS = 1_000, 1 << 16, 200
THRESHOLD = 0.8

_ANCHORS = np.unique(np.array([word_hash(w.encode(), LETTER_BYTES) for w in COMMON], np.uint64))


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the texts, sorted and once for each text, and each one's text."""
    h, counts = word_hashes(texts, LETTER_BYTES)
    # a start before each text's words is an anchor
    first = np.cumsum(counts) - counts + np.arange(len(texts))
    at = np.arange(len(h)) + np.repeat(np.arange(1, len(texts) + 1), counts)
    word, doc = np.zeros(len(h) + len(texts), np.uint64), np.repeat(np.arange(len(texts)), counts + 1)
    word[at] = h
    common = np.zeros(len(word), bool)
    if len(h):
        common[at] = _ANCHORS[np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)] == h
    common[first] = True
    content = np.flatnonzero(~common)
    anchor = np.flatnonzero(common)
    k = np.searchsorted(content, anchor)
    sig, has = mixed(word[anchor]), np.zeros(len(anchor), bool)
    for i in range(CHAIN):
        there = k + i < len(content)
        c = content[np.minimum(k + i, max(0, len(content) - 1))] if len(content) else np.zeros(len(anchor), np.int64)
        there &= doc[c] == doc[anchor]
        sig = np.where(there, combine(sig, word[c]), sig)
        has |= there
    doc_of, sig = doc[anchor][has], sig[has]
    # texts without content words
    bare = np.setdiff1d(np.arange(len(texts)), doc_of)
    extra = [(i, _whole(texts[i], word[first[i] + 1 : first[i] + 1 + counts[i]])) for i in bare.tolist() if texts[i]]
    if extra:
        doc_of = np.concatenate([doc_of, [i for i, _ in extra]])
        sig = np.concatenate([sig, np.array([x for _, x in extra], np.uint64)])
    both = np.unique(doc_of.astype(np.uint64) << np.uint64(32) | sig >> np.uint64(32))
    return both & np.uint64(0xFFFFFFFF), (both >> np.uint64(32)).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    return combine(h, 11)


def _whole(text: bytes, words: np.ndarray) -> int:
    """A signature of all words, or of the bytes of a text without words."""
    return int.from_bytes(hashlib.sha1(words.tobytes() if len(words) else text).digest()[:8], "big")


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The fingerprint of each text: its signatures, sorted."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        sig, doc = signatures(texts[a:b])
        out += np.split(sig.astype(np.uint32), np.searchsorted(doc, np.arange(1, b - a)))
    return out


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def edited(text: str, following: str) -> str:
    """The last half, rounded down, replaced by as many of the next document's first code points, or all of these."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Documents by ranges of descending doc_id, and with each range the document that follows its last.

    Rows (bucket, ghost, doc_id, text): sorting a bucket by ghost, doc_id descending and text puts each document before its
    next. There are so many ranges that one has about ``range_rows`` documents; the first document of each (a row per range) is found by one aggregation, and read once more for the range above.
    """
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    n, low, high = source.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    parts = min(MAX_RANGES, math.ceil(n / range_rows))
    segments = min(SEGMENTS, parts)
    cuts = source.approxQuantile("doc_id", [i / segments for i in range(1, segments)], 0.2 / segments) if low is not None and segments > 1 else []
    cuts = sorted({int(x) for x in cuts} - {low, high})
    edges = [low or 0, *cuts, (high or 0) + 1]
    each = max(1, parts // (len(edges) - 1))
    segment = _below(F.col("doc_id"), cuts)
    at = lambda values: F.element_at(F.array(*(F.lit(int(v)).cast("double") for v in values)), segment + 1)
    within = F.floor((F.col("doc_id") - at(edges[:-1])) / at([b - a for a, b in zip(edges, edges[1:], strict=False)]) * each)
    # larger ids come first, a null id comes after all
    bucket = F.when(F.col("doc_id").isNull(), 1).otherwise(-(segment * each + F.least(F.lit(each - 1), F.greatest(F.lit(0), within))))
    keyed = source.withColumn("bucket", bucket.cast("int"))
    heads = {x["bucket"]: x["head"] for x in keyed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    # of the rows with the head's id the one of the smallest text is first: all of them go, sorted, and the first is used
    above = {heads[b]: order[k - 1] for k, b in enumerate(order)}
    targets = F.lit(None).cast("int")
    if above:
        spark = docs.sparkSession
        rows = spark.createDataFrame([(k, v) for k, v in above.items() if k is not None], "head long, above int")
        keyed = keyed.join(F.broadcast(rows), F.col("doc_id") == F.col("head"), "left")  # a row per range
        targets = F.when(F.col("doc_id").isNull(), F.lit(above[None])).otherwise(F.col("above")) if None in above else F.col("above")
    both = F.when(targets.isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("g")), F.struct(targets.alias("b"), F.lit(True).alias("g")))
    )
    return keyed.select(F.explode(both).alias("x"), "doc_id", "text").select(F.col("x.b").alias("bucket"), F.col("x.g").alias("ghost"), "doc_id", "text")


def _below(value, cuts: list[int]):
    """How many of the sorted cuts are at most the value, as a balanced tree of comparisons."""

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < cuts[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def fingerprint_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Of each document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures."""
    rows = with_next(docs, range_rows)
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartition(int(parts), "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes, bytes]]:
        """(doc_id, text, next text)"""
        held: tuple | None = None
        for batch in batches:
            for bucket, ghost, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
                if held and held[0] == bucket:
                    yield held[1], held[2], text
                held = None if ghost else (bucket, doc_id, text)

    def out(part: list[tuple[int | None, bytes, bytes]]) -> pa.RecordBatch:
        changed = [edited(t.decode(), n.decode()).encode() for _, t, n in part]
        own, new = fingerprints([t for _, t, _ in part]), fingerprints(changed)
        # the next document's fingerprint is the following row's but where a range ends
        last = [k for k in range(len(part)) if k + 1 == len(part) or part[k][2] is not part[k + 1][1]]
        following = own[1:] + own[:1]
        for k, f in zip(last, fingerprints([part[k][2] for k in last]), strict=True):
            following[k] = f
        columns = (
            [p[0] for p in part],
            [len(t.decode()) for _, t, _ in part],
            [hashlib.sha256(x).hexdigest() for x in changed],
            [as_text(x) for x in own],
            [as_text(x) for x in new],
            [likeness(a, b) for a, b in zip(own, new, strict=True)],
            [likeness(a, b) for a, b in zip(own, following, strict=True)],
            [len(x) for x in own],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for p in pairs(batches):
            part.append(p)
            size += len(p[1])
            if size > 2 << 20:
                yield out(part)
                part, size = [], 0
        if part:
            yield out(part)

    return rows.mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long")


def _length_range(n: int, threshold: float) -> int:
    """The range of a set's length; sets of at least this likeness lie in the same range or in neighbouring ones."""
    return int(math.log(n) / -math.log(threshold)) if n else -1


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id) and pairs (a, b, likeness) of classes whose sets differ but are at least this alike.

    A class is the documents of equal sets, named by the smallest doc_id; one of null ids alone has none, and so no pairs.
    """
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(">u4").tobytes() for x in found], pa.binary())], names=["doc_id", "sigs"])

    each = checkpoint(source.mapInArrow(lean(sets), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, sigs binary"))
    classes = checkpoint(each.groupBy("sigs").agg(F.min("doc_id").alias("class_id")))
    members = each.join(classes, "sigs").select("doc_id", "class_id")
    sized = classes.filter("class_id is not null and octet_length(sigs) > 0")
    every = F.expr("transform(sequence(1, octet_length(sigs), 4), i -> cast(conv(hex(substring(sigs, i, 4)), 16, 10) as bigint))")
    spots = sized.select("class_id", (F.octet_length("sigs") / 4).cast("int").alias("n"), F.explode(every).alias("sig"))
    counts = spots.groupBy("sig").count().filter("count > 1")
    rare = spots.join(counts, "sig").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("by"))
    # signatures of one class alone are the rarest and meet nothing, so they take up the front of the prefix
    single = F.col("n") - F.size("by")
    keep = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1 - single)
    place = F.floor(F.log("n") / -math.log(threshold)).cast("int")
    prefix = rare.select("class_id", "n", F.explode(F.slice("by", 1, keep)).alias("x"), place.alias("place")).select("class_id", "n", F.col("x.sig").alias("sig"), "place")
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("place", F.col("place") + 1)).alias("place"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "sig", "place")
    met = left.join(right, ["sig", "place"]).filter((F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (sized.select(F.col("class_id").alias(k), F.col("sigs").alias(f"s{k}")) for k in "ab")
    met = met.join(one, "a").join(two, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: [np.frombuffer(x, ">u4").astype(np.uint32) for x in c.to_pylist()]
            j = np.array([likeness(x, y) for x, y in zip(read(batch.column(2)), read(batch.column(3)), strict=True)], np.float64)
            good = np.flatnonzero(j >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array(j[good])], names=["a", "b", "likeness"])

    return members, met.select("a", "b", "sa", "sb").mapInArrow(lean(compare), "a long, b long, likeness double")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
