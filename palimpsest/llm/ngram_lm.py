"""Scores by a trigram model in an Elias-Fano trie whose levels are memory-mapped.

Level 1 is the vocabulary: hashes of all words, sorted, in Elias-Fano form, with their counts. Level 2 holds all bigrams: for each
word its successors' numbers, made monotone by adding what the words before take up, with monotone pointers from each word to its
successors' range. Level 3 holds all trigrams in the same way: a bigram's place in level 2 is the context that its successors
are relative to. Probabilities are smoothed towards the next shorter context:
p(x|vw) = (c(vwx) + MU3 p(x|w)) / (c(vw) + MU3), p(w|v) = (c(vw) + MU p(w)) / (c(v) + MU), p(w) = (c(w)+0.1) / (N+0.1(V+1)). Level 2
keeps p(w|v) and the share MU3 / (c(vw)+MU3) that falls to p(x|w), level 3 the trigram's share of all tokens, log10 in 65,536 steps.
So all probabilities after a context sum to 1, but for rounding. A text's first word has its end as the context, and no longer one.

Nothing of the model is broadcast, capped or pruned. It is cut into buckets of words and shards of bigrams by hash, so a common
word's successors lie in many shards. A bigram whose words are both so common that it could fill shards has its successors dealt to
several, its count to one. Counts travel as sorted packed arrays, summed up before they are sent. Each part is written to the shared folder once,
under another name first, and executors map the files; their memory holds what one batch of texts needs.

Defined results: a null text is empty: its end alone is a token. Rows with a null id don't train and aren't held out. Without
training rows N and V are 0 and all scores 0. Repeated rows count each; equal texts score alike. Long texts are hashed a block of
words at a time; beside the text they take some 150 bytes a word. A vocabulary of 2**32 - 2 words or more is refused, for words are
numbered by 32 bits. Columns other than doc_id and text aren't looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import CHUNK_BYTES, checkpoint, crc_mod, lean, mix, shared_dir, slices, table, utf8, word_hash, word_hashes
from palimpsest.llm.elias_fano import EliasFano, mapped, packed
from palimpsest.llm.warc import filesystem

MU, MU3 = 30.0, 3.0
#: Added to each count in the base.
ADD = 0.1
#: A shard's tokens, about; the most buckets of words; pairs that a task gathers before it sends them; steps of log10 p.
SHARD_TOKENS, MAX_BUCKETS, GATHER, STEPS = 2 << 20, 4096, 2 << 20, 1 << 16
#: In place of a word's number after a bigram: none, for the text ends there; any, in a row of the bigram's own count.
PAD, ANY = 0xFFFFFFFF, 0xFFFFFFFE
#: (key, word after it or 0, count, part)
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: The end of a text as a token, and what stands before its first word.
END = word_hash(b"end") ^ 0x5555


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words and ends, and each one's text."""
    h, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts + 1)
    out = np.full(len(doc), END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts)] = h
    return out, doc


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes first: sorted numbers then compress well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _merged(rows: list[Rows]) -> Rows:
    """Rows sorted by key and word after it, each pair of these once."""
    k, w, n, part = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(np.unique(k, return_inverse=True)[1].astype(np.uint64) << np.uint64(32) | w if w.any() else k)
    k, w = k[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])) if len(k) else np.empty(0, np.int64)
    return k[first], w[first], np.add.reduceat(n[order], first) if len(first) else n, part[order[first]]


def _gathered(batches: Iterator[pa.RecordBatch], rows_of: Callable[[list[bytes]], Rows]) -> Iterator[pa.RecordBatch]:
    """Counts of the rows of training texts as (part, keys, after, counts)."""
    held: list[Rows] = []
    size = 0

    def send(rows: Rows) -> Iterator[pa.RecordBatch]:
        order = np.argsort(rows[3], kind="stable")
        k, w, n, part = (x[order] for x in rows)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
            packs = (pa.array([_planes(x[a:b])], pa.binary()) for x in (k, w, n.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([part[a]]), *packs], names=["part", "keys", "after", "counts"])

    for batch in batches:
        texts = utf8(batch.column(0))
        for a, b in slices(texts):
            held.append(rows_of(texts[a:b]))
            size += len(held[-1][0])
            if size > GATHER:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield from send(held[0])
                    held, size = [], 0
    if size:
        yield from send(_merged(held))


def _built(batches: Iterator[pa.RecordBatch], folder: str, name: str, build: Callable[[Rows], tuple[dict, int, int]]) -> Iterator[pa.RecordBatch]:
    """A file for each part of rows sorted by part; rows (part, n, total)."""
    store, base = filesystem(folder)
    store.create_dir(base)
    now, held, size, bound = -1, [], 0, 1 << 22

    def finish() -> pa.RecordBatch:
        arrays, n, total = build(_merged(held))
        path = f"{base}/{name}-{now:06d}"
        own = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(own, compression=None) as out:
            out.write(packed(arrays))
        store.move(own, path)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["part", "n", "total"])

    for batch in batches:
        for part, k, w, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part != now:
                if held:
                    yield finish()
                now, held, size, bound = part, [], 0, 1 << 22
            k, w, n = _numbers(k, np.uint64), _numbers(w, np.uint32), _numbers(n, np.uint32).astype(np.int64)
            held.append((k, w, n, np.full(len(k), part, np.int32)))
            size += len(k)
            if size > bound:  # many tasks send the same keys
                held = [_merged(held)]
                size = len(held[0][0])
                bound = max(bound, 2 * size)
    if held:
        yield finish()


def _word_rows(texts: list[bytes], part_of: Callable[[np.ndarray], np.ndarray]) -> Rows:
    k, n = np.unique(tokens(texts)[0], return_counts=True)
    return k, np.zeros(len(k), np.uint32), n, part_of(k).astype(np.int32)


def _build_words(rows: Rows) -> tuple[dict, int, int]:
    k, _, n, _ = rows
    return EliasFano.build(k).arrays("words") | {"counts": n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.int64)}, len(k), int(n.sum())


class Vocabulary:
    """Level 1, in buckets by the hashes' first bits."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, int], total: int):
        self.folder, self.bits, self.total, self.shard_tokens = folder, bits, total, SHARD_TOKENS
        self.first = np.zeros((1 << bits) + 1, np.int64)
        for part, n in sizes.items():
            self.first[part + 1] = n
        self.first = np.cumsum(self.first)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "parts"}

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def part_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(63 - self.bits) >> np.uint64(1)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, -1 for unknown words, and counts of sorted hashes."""
        if not hasattr(self, "parts"):
            self.parts: dict[int, tuple[EliasFano, np.ndarray]] = {}
        store, base = filesystem(self.folder)
        ids, counts = np.full(len(h), -1), np.zeros(len(h), np.int64)
        edges = np.searchsorted(self.part_of(h), np.arange((1 << self.bits) + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            if self.first[p + 1] == self.first[p]:
                continue
            if p not in self.parts:
                arrays = mapped(store, f"{base}/words-{p:06d}")
                self.parts[p] = EliasFano.of(arrays, "words"), arrays["counts"]
            words, n = self.parts[p]
            a, b = edges[p], edges[p + 1]
            i = words.find(h[a:b])
            ids[a:b] = np.where(i < 0, -1, i + self.first[p])
            counts[a:b] = np.where(i < 0, 0, n[np.maximum(i, 0)])
        return ids, counts

    def spread(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """To how many shards the successors of bigrams are dealt whose words have these counts."""
        return (np.minimum(c, d) // self.shard_tokens + 1).astype(np.uint64)

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.total + ADD * (self.size + 1))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hashes of the texts' words and, of each token: text, number among these of the token before it, its own, whether it is its text's last."""
    h, doc = tokens(texts)
    words, at = np.unique(h, return_inverse=True)
    new = np.diff(doc, prepend=-1) != 0
    before = np.where(new, int(np.searchsorted(words, np.uint64(END))), np.concatenate([[0], at[:-1]]))
    return words, doc, before, at, np.concatenate([new[1:], [True]])


def _shard_of(pairs: np.ndarray, shards: int, salt: np.ndarray | int = 0) -> np.ndarray:
    return ((mix(pairs + np.asarray(salt, np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _salt(after: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return mix(after.astype(np.uint64)) % spread


def _gram_rows(vocabulary: Vocabulary, shards: int, texts: list[bytes]) -> Rows:
    """A row for each token: it and the one before, 32 bits each, and what follows; bigrams that are dealt out have another of their own."""
    words, _, before, at, last = _grams(texts)
    ids, counts = vocabulary.find(words)
    ids = ids.astype(np.uint64)
    pairs = ids[before] << np.uint64(32) | ids[at]
    after = np.where(last, np.uint64(PAD), np.concatenate([ids[at[1:]], ids[:1]])).astype(np.uint32)
    spread = vocabulary.spread(counts[before], counts[at])
    part = _shard_of(pairs, shards, _salt(after, spread))
    out = pairs, after, np.ones(len(at), np.int64), part
    if len(more := np.flatnonzero(spread > 1)):
        own = pairs[more], np.full(len(more), ANY, np.uint32), np.ones(len(more), np.int64), _shard_of(pairs[more], shards)
        out = tuple(np.concatenate(x) for x in zip(out, own, strict=True))
    return _merged([out])


def quantised(p: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """log10 p in steps from the least of them to 0."""
    x = np.log10(p)
    least = float(min(x.min(), -1e-9)) if len(x) else -1.0
    return {name: np.rint(x / least * (STEPS - 1)).clip(0, STEPS - 1).astype(np.uint16), f"{name}.least": np.array([least])}


def _level(node: np.ndarray, after: np.ndarray, nodes: int, name: str) -> dict[str, np.ndarray]:
    """Successors of each of the nodes, sorted by node and successor."""
    room = np.zeros(nodes, np.uint64)
    room[node] = after + np.uint64(1)  # the last, which is the largest, stays
    pointers = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=nodes))])
    return EliasFano.build(pointers).arrays(f"{name}.pointers") | EliasFano.build(after + (np.cumsum(room) - room)[node]).arrays(f"{name}.successors")


def build_trie(rows: Rows, total: int, smoothed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """Levels 2 and 3 of the sorted rows of a shard; ``smoothed`` gives bigrams' probabilities by their counts."""
    k, after, n, _ = rows
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    pairs, count = k[first], np.add.reduceat(n, first)
    own = after == ANY
    count[np.searchsorted(pairs, k[own])] = n[own]
    v, w = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    contexts, node = np.unique(v, return_inverse=True)
    real = np.flatnonzero(after < ANY)
    pair = np.searchsorted(first, real, "right") - 1
    levels = _level(node, w, len(contexts), "2") | _level(pair, after[real].astype(np.uint64), len(pairs), "3")
    return EliasFano.build(contexts).arrays("contexts") | levels | quantised(smoothed(pairs, count), "p") | quantised(MU3 / (count + MU3), "rest") | quantised(n[real] / total, "share")


class Trie:
    """Levels 2 and 3 of one shard."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.contexts = EliasFano.of(arrays, "contexts")
        self.pointers, self.successors = ([EliasFano.of(arrays, f"{k}.{x}") for k in "23"] for x in ("pointers", "successors"))
        self.values = {x: (arrays[x], float(arrays[f"{x}.least"][0]) / (STEPS - 1)) for x in ("p", "rest", "share")}

    def _after(self, level: int, node: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Places of successors of the nodes, -1 if not there."""
        pointers, successors = self.pointers[level], self.successors[level]
        out = np.full(len(node), -1)
        known = np.flatnonzero(node >= 0)
        if len(known) and successors.n:
            c = node[known]
            a, b = pointers.access(c).astype(np.int64), pointers.access(c + 1).astype(np.int64)
            base = np.where(a > 0, successors.access(np.maximum(a - 1, 0)) + np.uint64(1), np.uint64(0))
            i = successors.find(w[known].astype(np.uint64) + base)
            out[known] = np.where((i >= a) & (i < b), i, -1)
        return out

    def find(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Places of bigrams, -1 if not there."""
        return self._after(0, self.contexts.find(v), w)

    def next(self, place: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of trigrams that follow bigrams, -1 if not there."""
        return self._after(1, place, x)

    def value(self, name: str, place: np.ndarray) -> np.ndarray:
        q, step = self.values[name]
        return np.exp(q[place] * (step * math.log(10)))


class Model:
    """Vocabulary and shards; maps a shard when it is first asked."""

    def __init__(self, vocabulary: Vocabulary, shards: int, there: set[int]):
        self.vocabulary, self.shards, self.there = vocabulary, shards, there

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tries"}

    def _trie(self, shard: int) -> Trie:
        if not hasattr(self, "tries"):
            self.tries: dict[int, Trie] = {}
        if shard not in self.tries:
            store, base = filesystem(self.vocabulary.folder)
            self.tries[shard] = Trie(mapped(store, f"{base}/grams-{shard:06d}"))
        return self.tries[shard]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        doc, known, single, p = self.probabilities(texts)
        n = len(texts)
        return np.bincount(doc, minlength=n), np.bincount(doc, known, n).astype(np.int64), np.bincount(doc, np.log10(single), n), np.bincount(doc, np.log10(p), n)

    def probabilities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token of the texts: the text, whether it is known, its probability by itself and after what stands before it."""
        voc = self.vocabulary
        words, doc, before, at, last = _grams(texts)
        ids, counts = voc.find(words)
        single = voc.probability(counts)
        pairs, of = np.unique(before.astype(np.int64) << 32 | at, return_inverse=True)
        v, w = pairs >> 32, pairs & 0xFFFFFFFF
        two, rest, place = MU / (counts[v] + MU) * single[w], np.ones(len(pairs)), np.full(len(pairs), -1)
        spread, key = voc.spread(counts[v], counts[w]), ids[v].astype(np.uint64) << np.uint64(32) | ids[w].astype(np.uint64)
        known = (ids[v] >= 0) & (ids[w] >= 0)
        inner = np.flatnonzero(~last)
        inner = inner[np.argsort(of[inner] << 32 | at[inner + 1])]  # sorted searches are near each other
        pair, x = of[inner], ids[at[inner + 1]]
        three = np.zeros(len(inner))
        # what each shard is asked: bigrams, and what follows them
        home = np.where(known, _shard_of(key, self.shards), self.shards)
        where = home[pair]
        if len(dealt := np.flatnonzero((spread[pair] > 1) & known[pair])):
            where[dealt] = _shard_of(key[pair[dealt]], self.shards, _salt(x[dealt], spread[pair[dealt]]))
        where[x < 0] = self.shards
        small = np.uint16 if self.shards < 1 << 16 else np.int32
        asked = [(order := np.argsort(s.astype(small), kind="stable"), np.searchsorted(s[order], np.arange(self.shards + 1))) for s in (home, where)]
        for s in np.flatnonzero(np.diff(asked[0][1]) + np.diff(asked[1][1])).tolist():
            if s not in self.there:
                continue
            trie = self._trie(s)
            i, j = (order[edges[s] : edges[s + 1]] for order, edges in asked)
            place[i] = trie.find(ids[v[i]].astype(np.uint64), ids[w[i]].astype(np.uint64))
            seen = i[place[i] >= 0]
            two[seen], rest[seen] = trie.value("p", place[seen]), trie.value("rest", place[seen])
            node = place[pair[j]]
            if len(d := np.flatnonzero(spread[pair[j]] > 1)):
                q = pair[j[d]]
                node[d] = trie.find(ids[v[q]].astype(np.uint64), ids[w[q]].astype(np.uint64))
            found = trie.next(node, x[j])
            good = np.flatnonzero(found >= 0)
            three[j[good]] = trie.value("share", found[good])
        p = two[of]
        p[inner + 1] = rest[pair] * (three * (voc.total / MU3) + p[inner + 1])
        return doc, counts[at] > 0, single[at], p


_models: dict[str, Model] = {}


def train(texts: DataFrame, folder: str) -> Model:
    """Counts all words, then all bigrams and trigrams, of texts (text), and writes the levels to the folder."""
    spark = texts.sparkSession
    bits = min(MAX_BUCKETS, max(4, texts.rdd.getNumPartitions())).bit_length()
    probe = Vocabulary(folder, bits, {}, 0)
    rows = texts.mapInArrow(lean(lambda b: _gathered(b, lambda t: _word_rows(t, probe.part_of))), "part int, keys binary, after binary, counts binary")
    parts = checkpoint(rows.repartition(1 << bits, "part").sortWithinPartitions("part").mapInArrow(lean(lambda b: _built(b, folder, "words", _build_words)), "part int, n long, total long"))
    sizes = parts.collect()  # a row of numbers per bucket
    vocabulary = Vocabulary(folder, bits, {x.part: x.n for x in sizes}, sum(x.total for x in sizes))
    if vocabulary.size >= ANY:
        raise ValueError("more words than 32 bits can number")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vocabulary.total // vocabulary.shard_tokens))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(batches, lambda t: _gram_rows(vocabulary, shards, t))

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _built(batches, folder, "grams", lambda rows: (build_trie(rows, vocabulary.total, lambda k, n: _smoothed(vocabulary, k, n)), len(rows[0]), int(rows[2].sum())))

    counted = texts.mapInArrow(lean(grams), "part int, keys binary, after binary, counts binary")
    built = checkpoint(counted.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(lean(tries), "part int, n long, total long"))
    return Model(vocabulary, shards, {x.part for x in built.select("part").collect()})


def _smoothed(vocabulary: Vocabulary, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    v, w = (vocabulary_counts(vocabulary, x.astype(np.int64)) for x in (k >> np.uint64(32), k & np.uint64(0xFFFFFFFF)))
    return (n + MU * vocabulary.probability(w)) / (v + MU)


def vocabulary_counts(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Counts of words by number."""
    store, base = filesystem(vocabulary.folder)
    out, part = np.zeros(len(ids), np.int64), np.searchsorted(vocabulary.first, ids, "right") - 1
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange((1 << vocabulary.bits) + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        i = order[edges[p] : edges[p + 1]]
        out[i] = mapped(store, f"{base}/words-{p:06d}")["counts"][ids[i] - vocabulary.first[p]]
    return out


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    limit = max(CHUNK_BYTES, min(4 * CHUNK_BYTES, model.shards << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.vocabulary.folder not in _models:
            _models.clear()
        m = _models.setdefault(model.vocabulary.folder, model)  # with the files that this worker has mapped
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(texts, limit):
                n, known, base, score = m.score(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(known), pa.array(np.full(b - a, m.vocabulary.total)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(crc_mod("doc_id", 10) != 0).select("text"), shared_dir(spark) + "-lm")
    held = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
