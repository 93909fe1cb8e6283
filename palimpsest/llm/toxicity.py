"""Toxicity by logistic regression with FTRL-proximal updates over hashed word n-grams and skip-grams.

Features are the words, the first ``HEAD`` bytes of longer words (inflected languages), the pairs of neighbouring words and the
pairs with one word between, hashed to ``bits`` bits; a text has a feature or has it not. FTRL-proximal keeps two numbers per coordinate, the sum of gradients and of their squares: each
coordinate has its own learning rate, and the L1 term keeps weights of weak features at 0. What is left is a short table of
features and weights. Training takes a bounded sample of the labelled rows, ``TRAIN_ROWS`` at most, whole texts, in one task;
the table has at most 2**bits entries of 12 bytes, which bounds what is sent to the executors.

Defined results: null and empty texts have no features, their score is that of the bias. A document whose id is null is no
training row and isn't held out. Of several labels of one document the largest counts; a null label is none. Without any
training rows each score is 0.5. Repeated rows are scored alike. Labels of ids that aren't among the documents don't count
towards the bound; of several documents with one id the smallest text trains. A score that equals the threshold is toxic. Long
texts are read a block of words at a time; beside the text they take some 60 bytes a word. Columns of the input other than doc_id
and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import LETTER_BYTES, checkpoint, combine, crc_mod, lean, slices, table, utf8, word_and_head_hashes

BITS, HEAD = 20, 8
#: FTRL-proximal: learning rate, its offset, L1 and L2 strengths; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.8, 1.0, 20.0, 0.1, 5
#: Weight of a toxic row's gradient: toxic rows are rarer.
TOXIC_WEIGHT = 4.0
#: At most so many labelled rows train the model; which ones, a hash of the id decides.
TRAIN_ROWS = 16_384
THRESHOLD = 0.7


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, feature) of all features of the texts, repeats included, not sorted."""
    h, counts, heads = word_and_head_hashes(texts, LETTER_BYTES, HEAD)
    doc = np.repeat(np.arange(len(texts)), counts)
    longer = np.flatnonzero(heads != h)
    parts = [(doc, h), (doc[longer], combine(heads[longer], 7))]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            parts.append((doc[:-gap][same], combine(h[:-gap], h[gap:] + np.uint64(gap))[same]))
    return np.concatenate([d for d, _ in parts]), (np.concatenate([x for _, x in parts]) & np.uint64((1 << bits) - 1)).astype(np.int64)


def distinct_features(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """Each text's features, sorted, without repeats."""
    doc, f = features(texts, bits)
    both = np.unique(doc << bits | f)
    return np.split(both & ((1 << bits) - 1), np.searchsorted(both, np.arange(1, len(texts)) << bits))


class FTRL:
    """Per-coordinate FTRL-proximal for logistic loss; coordinate 2**bits is the bias, which has no L1 term."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, 1 << bits
        self.z, self.n = np.zeros(self.bias + 1), np.zeros(self.bias + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= TOXIC_WEIGHT if label else 1.0
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(self.bias + 1)
        w = self.weights(every)
        kept = np.flatnonzero(w)
        return kept, w[kept]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, fold: int = 3, held: int = 1) -> DataFrame:
    """(text, label, turn) of the sample: labelled documents outside the held-out fold, those of the smallest hashes of the id."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("label")).filter(F.col("label").isNotNull() & (crc_mod("doc_id", fold) != held))
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).withColumn("turn", F.xxhash64("doc_id", F.lit(3)))
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    known = checkpoint(known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi"))
    # turns are spread evenly: a threshold leaves somewhat more than are wanted, so no task sorts many times the sample
    share = min(1.0, (most + most // 4 + 100) / max(1, known.count()))
    known = known.filter(F.col("turn") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))).orderBy("turn", "doc_id").limit(most)
    # at most ``most`` rows of a few bytes; the texts stay where they are read until the sample is chosen
    return texts.join(F.broadcast(known), "doc_id").groupBy("turn", "doc_id", "label").agg(F.min("text").alias("text")).select("turn", "doc_id", "text", "label")


def train(rows: DataFrame, bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """The table of weights: features in order, 2**bits for the bias, and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        label: list[int] = []
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices(texts):
                part = distinct_features(texts[a:b], bits)  # views of one array, which is freed as a whole
                found += np.split(np.concatenate(part).astype(np.int32), np.cumsum([len(x) for x in part])[:-1])
            label += batch.column(1).to_pylist()
        model = FTRL(bits)
        for k in range(passes):
            for i in np.random.default_rng(k).permutation(len(found)):
                model.learn(found[i], label[i])
        at, w = model.table()
        if label:
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    one = rows.repartition(1).sortWithinPartitions("turn", "doc_id", F.xxhash64("text")).select("text", "label")
    got = one.mapInArrow(lean(run), "at long, w double").toArrow().sort_by("at")
    return got["at"].to_numpy(), got["w"].to_numpy()


def _scorer(model: tuple[np.ndarray, np.ndarray], bits: int):
    at, w = model
    weight = np.zeros((1 << bits) + 1, np.float32)
    weight[at] = w
    bias = float(weight[-1])

    def scores(texts: list[bytes]) -> np.ndarray:
        out = [np.empty(0)]
        for a, b in slices(texts):
            doc, f = features(texts[a:b], bits)
            hit = weight[f] != 0
            both = np.unique(doc[hit] << bits | f[hit])
            total = np.bincount(both >> bits, weight[both & ((1 << bits) - 1)], b - a) + bias
            out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return np.concatenate(out)

    return scores


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every document."""
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value, bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(utf8(batch.column(1))))], names=["doc_id", "score"])

    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The documents, all their columns, whose score is below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value, bits)
        for batch in batches:
            yield batch.filter(pa.array(scores(utf8(batch.column(at))) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score): trains on labelled rows outside the held-out fold and scores all documents."""
    return score_documents(docs, train(training_rows(docs, labels, most)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
