"""Language identification by one character language model per language, smoothed by interpolated Kneser-Ney.

A text's symbols are its letters, lower-cased, with one space for any run of other characters. Each language's model keeps, for
every order up to ``ORDER``, sorted arrays of the hashes of its n-grams and of its contexts, with the discounted share of each
n-gram and the weight that each context leaves to the next lower order. The language of the lowest cross-entropy per symbol
wins. Two things are calibrated on a fifth of the sample that the counts don't see: the temperature that turns differences of
log-likelihood into a score, and the cross-entropy beyond which a text is rejected as being in none of the languages.

Training takes a sample of about ``TRAIN_ROWS`` rows per language, fewer if there are so many languages that these would be more
than ``ALL_TRAIN_ROWS``, chosen by a hash of the id, whole texts, in one task; the models' size is bounded by the sample. Scoring
keeps the log-probabilities of n-grams met before in a table of fixed size.

Defined results: a null text and one without any letter are ``und``, score 0, rejected; so is every text if nothing was learned.
Rows with a null lang, a null id or of the held-out fold are never learned from; of several with one id and lang the smallest text
is. Of languages of equal cross-entropy the first in order wins. A long text is scored a window of ``CHUNK_CHARS`` characters at a
time. Repeated rows get equal results. Columns of the input other than doc_id, text and lang aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint, crc_mod, lean, mix, table

ORDER = 5
#: Rows per language that train, and rows of all languages together (expected numbers).
TRAIN_ROWS, ALL_TRAIN_ROWS = 1500, 150_000
#: Languages whose numbers of rows may be broadcast.
BROADCAST_ROWS = 100_000
#: Share of the sample that calibrates; temperatures tried; how far beyond the calibration's 99.9th percentile a text is rejected.
CALIBRATE, TEMPERATURES, SLACK = 5, (1.0, 2.0, 4.0, 8.0, 16.0, 32.0), 1.5
UNKNOWN = "und"
#: Characters that are scored at a time; slots of a worker's table of n-grams met before. Beyond eight languages both are
#: fewer in proportion.
CHUNK_CHARS, SLOTS = 1 << 18, 1 << 18

_LETTERS: np.ndarray | None = None
_FACTORS = [pow(0x9E3779B97F4A7C15 | 1, k + 1, 1 << 64) for k in range(16)]


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts and the number of the text that each belongs to."""
    parts = [x.lower() for x in texts]
    raw = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(parts)), [len(x) + 1 for x in parts])
    letter = _letters()[raw]
    kept = np.flatnonzero(letter | np.concatenate([[False], letter[:-1]]))  # a space stands after a letter only
    return np.where(letter[kept], raw[kept], 32).astype(np.uint64), doc[kept]


def gram_hashes(sym: np.ndarray, doc: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n from 1 to the order, the hash of the last n symbols at each place; places before a text's start count as symbol 0."""
    total, out = np.zeros(len(sym), np.uint64), []
    for k in range(order):
        x = np.zeros(len(sym), np.uint64)
        if k < len(sym):
            x[k:] = np.where(doc[k:] == doc[: len(sym) - k], sym[: len(sym) - k], 0)
        total = total + x * np.uint64(_FACTORS[k])
        out.append(mix(total + np.uint64((k + 1) << 57)))
    return out


def context_hashes(sym: np.ndarray, doc: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n from 1 to the order, the hash of the n-1 symbols before each place."""
    total, out = np.zeros(len(sym), np.uint64), []
    for k in range(order):
        out.append(mix(total + np.uint64((k + 33) << 57 & (1 << 64) - 1) + np.uint64(k)))
        x = np.zeros(len(sym), np.uint64)
        if k + 1 < len(sym):
            x[k + 1 :] = np.where(doc[k + 1 :] == doc[: len(sym) - k - 1], sym[: len(sym) - k - 1], 0)
        total = total + x * np.uint64(_FACTORS[k])
    return out


def _find(keys: np.ndarray, values: np.ndarray, at: np.ndarray, otherwise: float) -> np.ndarray:
    """Values of a sorted hash array."""
    if not len(keys):
        return np.full(len(at), otherwise)
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[i] == at, values[i], otherwise)


class CharModel:
    """Interpolated Kneser-Ney over symbols, from the distinct n-grams of the highest order and their counts."""

    def __init__(self, grams: list[np.ndarray], contexts: list[np.ndarray], counts: np.ndarray):
        self.grams, self.contexts = [], []
        alive, weight = np.arange(len(counts)), counts.astype(np.float64)
        levels = []
        for n in range(len(grams) - 1, -1, -1):
            levels.append((grams[n][alive], contexts[n][alive], weight))
            # below the highest order an n-gram counts once for each n+1-gram that ends in it
            if n:
                _, first = np.unique(grams[n][alive], return_index=True)
                alive = alive[first]
                _, first, back = np.unique(grams[n - 1][alive], return_index=True, return_inverse=True)
                weight, alive = np.bincount(back).astype(np.float64), alive[first]
        for g, c, w in reversed(levels):
            g, first, back = np.unique(g, return_index=True, return_inverse=True)
            w = np.bincount(back, w)
            c = c[first]
            ones, twos = (w == 1).sum(), (w == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            ctx, at = np.unique(c, return_inverse=True)
            total = np.bincount(at, w)
            self.grams.append((g, (np.maximum(w - discount, 0) / total[at]).astype(np.float32)))
            self.contexts.append((ctx, (np.bincount(at, np.minimum(w, discount)) / total).astype(np.float32)))
        self.floor = 1.0 / (len(self.grams[0][0]) + 1)

    def log2(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(grams[0]), self.floor)
        for (g, a), (c, b), x, y in zip(self.grams, self.contexts, grams, contexts, strict=True):
            p = _find(g, a, x, 0.0) + _find(c, b, y, 1.0) * p
        return np.log2(p)


class Identifier:
    """Models of all languages, the calibration, and a table of n-grams met before."""

    def __init__(self, models: dict[str, CharModel], order: int = ORDER):
        self.names, self.models, self.order = list(models), list(models.values()), order
        self.temperature, self.mean, self.spread, self.limit = 8.0, np.zeros(len(models)), np.ones(len(models)), np.inf

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "rows")}

    def _log2(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """A row for each place and a column for each language."""
        if not hasattr(self, "keys"):
            slots = max(256, SLOTS >> max(0, (len(self.models) - 1).bit_length() - 3))
            self.keys, self.rows = np.zeros(slots, np.uint64), np.zeros((slots, len(self.models)), np.float32)
        key = grams[-1]
        slot = (key & np.uint64(len(self.keys) - 1)).astype(np.int64)
        out = self.rows[slot]
        new = np.flatnonzero(self.keys[slot] != key)
        if len(new):
            fresh, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            at = new[first]
            values = np.stack([m.log2([g[at] for g in grams], [c[at] for c in contexts]) for m in self.models], axis=1).astype(np.float32)
            out[new] = values[back]
            self.keys[slot[at]], self.rows[slot[at]] = fresh, values
        return out

    @property
    def chunk(self) -> int:
        return max(1024, CHUNK_CHARS * 8 // max(8, len(self.models)))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol of each text in each language, and its number of symbols."""
        if len(texts) == 1 and len(texts[0]) > 2 * self.chunk:
            return self._of_long_text(texts[0])
        sym, doc = symbols(texts)
        n = np.bincount(doc, minlength=len(texts))
        total = self._total(sym, doc, len(texts), 0)
        return -total / np.maximum(n, 1)[:, None], n

    def _total(self, sym: np.ndarray, doc: np.ndarray, texts: int, skip: int) -> np.ndarray:
        """log2 p of each text's symbols in each language, without those before the place ``skip``."""
        if not len(sym) or not self.models:
            return np.zeros((texts, len(self.models)))
        rows = self._log2(*([x[skip:] for x in f(sym, doc, self.order)] for f in (gram_hashes, context_hashes)))
        return np.stack([np.bincount(doc[skip:], rows[:, k], texts) for k in range(len(self.models))], axis=1)

    def _of_long_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """As entropies, a window at a time; a window starts with the last symbols before it."""
        before, total, n = np.empty(0, np.uint64), np.zeros((1, len(self.models))), 0
        for at in range(0, len(text), self.chunk):
            # one character more tells whether a space follows a letter
            head = text[at - 1 : at] if at else ""
            own = symbols([head])[0]
            window = symbols([head + text[at : at + self.chunk]])[0][min(1, len(own)) :]
            if at + self.chunk < len(text) and len(window) and window[-1] == 32 and text[at + self.chunk - 1].lower()[-1:].isalpha():
                window = window[:-1]  # the space that ends a text; the next window begins with it if there is one
            sym = np.concatenate([before, window])
            total += self._total(sym, np.zeros(len(sym), np.int64), 1, len(before))
            n += len(window)
            before = sym[max(0, len(sym) - self.order + 1) :]
        return -total / max(n, 1), np.array([n])

    def _scaled(self, entropy: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far the best language's cross-entropy is above what its texts have; short texts may be further."""
        own = np.take_along_axis(entropy, best[:, None], 1)[:, 0]
        return (own - self.mean[best]) / (self.spread[best] * np.sqrt(1 + 400 / np.maximum(n, 1)))

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        truth = np.array([self.names.index(x) for x in langs])
        entropy, n = (np.concatenate(x) for x in zip(*(self.entropies(part) for part in _chunks(texts, self.chunk)), strict=True))
        has = n > 0
        if not has.any():
            return
        entropy, n, truth = entropy[has], n[has], truth[has]
        losses = []
        for t in TEMPERATURES:
            z = -entropy * n[:, None] * np.log(2) / t
            z = z - z.max(axis=1, keepdims=True)
            losses.append(-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean())
        self.temperature = TEMPERATURES[int(np.argmin(losses))]
        own = entropy[np.arange(len(truth)), truth]
        for k in range(len(self.names)):
            if (truth == k).sum() > 1:
                self.mean[k], self.spread[k] = own[truth == k].mean(), max(0.05, own[truth == k].std())
        self.limit = max(4.0, float(np.quantile(self._scaled(entropy, n, truth), 0.999))) * SLACK

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        entropy, n = self.entropies(texts)
        if not self.models:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = entropy.argmin(axis=1)
        least = np.take_along_axis(entropy, best[:, None], 1)
        score = 1 / np.exp(-(entropy - least) * n[:, None] * np.log(2) / self.temperature).sum(axis=1)
        none = n == 0
        return [UNKNOWN if x else self.names[k] for k, x in zip(best, none, strict=True)], np.where(none, 0.0, score), none | (self._scaled(entropy, n, best) > self.limit)


def learn(texts: list[str], langs: list[str], order: int = ORDER) -> Identifier:
    models = {}
    calibrating = np.arange(len(texts)) % CALIBRATE == CALIBRATE - 1
    for name in sorted(set(langs)):
        own = [t for t, x, c in zip(texts, langs, calibrating, strict=True) if x == name and not c] or [t for t, x in zip(texts, langs, strict=True) if x == name]
        grams, contexts, counts = np.empty((order, 0), np.uint64), np.empty((order, 0), np.uint64), np.empty(0, np.int64)
        for chunk in _chunks(own):
            sym, doc = symbols(chunk)
            g, c = (np.concatenate([x, f(sym, doc, order)], axis=1) for x, f in ((grams, gram_hashes), (contexts, context_hashes)))
            n = np.concatenate([counts, np.ones(len(sym), np.int64)])
            _, first, back = np.unique(g[-1], return_index=True, return_inverse=True)
            grams, contexts, counts = g[:, first], c[:, first], np.bincount(back, n)
        if len(counts):
            models[name] = CharModel(list(grams), list(contexts), counts)
    out = Identifier(models, order)
    held = [(t, x) for t, x, c in zip(texts, langs, calibrating, strict=True) if c and x in models]
    if held:
        out.calibrate(*map(list, zip(*held, strict=True)))
    return out


def _chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    out, total = [], 0
    for x in texts:
        if total and total + len(x) > limit:
            yield out
            out, total = [], 0
        out.append(x)
        total += len(x)
    if out:
        yield out


def training_rows(docs: DataFrame, per_language: int = TRAIN_ROWS, fold: int = 4, held: int = 2, all_rows: int = ALL_TRAIN_ROWS) -> DataFrame:
    """(turn, doc_id, text, lang): the sample, each language by the fraction that gives ``per_language`` rows."""
    known = docs.select(docs["doc_id"].alias("doc_id"), docs["lang"].alias("lang"), docs["text"].cast("string").alias("text")).filter(F.col("lang").isNotNull() & (crc_mod("doc_id", fold) != held))
    turn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    # chosen by id, of a few bytes a row, before any text is read
    ids = known.select("doc_id", "lang", turn.alias("turn"))
    counts = checkpoint(ids.groupBy("lang").count())
    n = counts.count()
    share = min(per_language, all_rows / max(1, n)) / F.col("count")
    counts = F.broadcast(counts) if n <= BROADCAST_ROWS else counts
    chosen = checkpoint(ids.join(counts, "lang").filter(F.col("turn") < share * (1 << 30)).select("doc_id", "lang", "turn").distinct())
    # about all_rows ids at most
    return known.filter("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("turn", "doc_id", "lang").agg(F.min("text").alias("text")).select("turn", "doc_id", "text", "lang")


def train(rows: DataFrame) -> Identifier:
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(texts, langs))], pa.binary())], names=["model"])

    one = rows.repartition(1).sortWithinPartitions("turn", "doc_id", "lang").select("text", "lang")
    got = one.mapInArrow(lean(run), "model binary").collect()
    return pickle.loads(got[0].model) if got else Identifier({})


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document."""
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            start, texts = 0, [x or "" for x in batch.column(1).to_pylist()]
            for part in _chunks(texts, m.chunk):
                lang, score, rejected = m.predict(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])
                start += len(part)

    return source.mapInArrow(lean(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Identifier) -> DataFrame:
    """The documents, all their columns, that one of the languages accepts."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rejected = [m.predict(part)[2] for part in _chunks([x or "" for x in batch.column(at).to_pylist()], m.chunk)]
            yield batch.filter(pa.array(~np.concatenate([np.empty(0, bool), *rejected])))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return identify(docs, train(training_rows(docs))).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
