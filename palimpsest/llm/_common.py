"""What the operators of this subpackage share: tables, shared storage, and token hashing over whole batches of text."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the pattern [\x20\x09-\x0D].
SPACES = (0x20, *range(0x09, 0x0E))
#: Bytes of text that are hashed at a time; the arrays made on the way take some forty times as much.
CHUNK_BYTES = 1 << 20
#: Bytes of rows that a Python worker gets at a time, about, and Spark's setting for that.
BATCH_BYTES, BATCH_SETTING = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing, as in tests on one machine, a temporary folder is set as the checkpoint folder; a cluster must
    name one.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop_shuffles(spark: SparkSession) -> None:
    """Collects the driver's garbage: Spark removes shuffle files, and checkpoints if so configured, only when the driver's objects for them are gone.

    Py4J tells the JVM what Python has let go once a second, and Spark removes files in a thread of its own.
    """
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for what Spark hands to a Python worker at a time to ``BATCH_BYTES``; a longer row goes by itself.

    Spark's own limit is 64 MB. A batch is held by the JVM outside its heap and by the worker, there as lists of texts too. Spark reads the
    setting when it runs a query, so it has to stay; a limit that is lower already stays as it is.
    """
    set_to = spark.conf.get(BATCH_SETTING, None)
    if not set_to or not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(set_to) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, after which its worker returns the memory that is free: it may wait for long for its next task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % n


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together, or of one row that is longer."""
    start, total = 0, 0
    for i, x in enumerate(texts):
        if total and total + len(x) > limit:
            yield start, i
            start, total = i, 0
        total += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


_PRIME, _POWERS, _INVERSES = 0x9E3779B97F4A7C15 | 1, np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 3))

        def run(base: int) -> np.ndarray:
            out = np.full(n, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _POWERS, _INVERSES = run(_PRIME), run(pow(_PRIME, -1, 1 << 64))
    return _POWERS, _INVERSES


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def combine(h: np.ndarray, other: np.ndarray | int) -> np.ndarray:
    """A hash of an ordered pair of hashes."""
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + np.asarray(other, np.uint64))


def byte_table(separators, lower: bool = True) -> np.ndarray:
    """For each byte 0 if it separates tokens, else a value over 0; A-Z as a-z if lower."""
    out = np.arange(1, 257, dtype=np.uint16)
    if lower:
        out[0x41:0x5B] += 32
    out[list(separators)] = 0
    return out


#: Words [^\x20\x09-\x0D]+, lower-cased.
WORD_BYTES = byte_table(SPACES)
#: Words of ASCII letters and digits and of all other code points.
LETTER_BYTES = byte_table(b for b in range(128) if not chr(b).isalnum())


def word_hashes(texts: list[bytes], kinds: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    h, counts, _ = word_and_head_hashes(texts, kinds, 0)
    return h, counts


def word_and_head_hashes(texts: list[bytes], kinds: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and hashes of the words' first bytes; a word that isn't longer than these has its own hash."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(texts) == 1 and len(texts[0]) > 2 * CHUNK_BYTES:
        return _of_long_text(texts[0], kinds, head)
    end = bytes([int(np.flatnonzero(kinds == 0)[0])])
    a = kinds[np.frombuffer(end.join(texts) + end, np.uint8)]
    edge = np.diff((a != 0).view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * power[: len(a)], out=total[1:])

    def upto(ends: np.ndarray) -> np.ndarray:
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    counts = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
    return upto(ends), np.diff(counts, prepend=0), upto(np.minimum(ends, starts + head)) if head else np.empty(0, np.uint64)


def _of_long_text(text: bytes, kinds: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_and_head_hashes, of one text in blocks that end between words; a word longer than a block is summed up by itself."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, power = 0, _powers(CHUNK_BYTES)[0]
    while at < len(text):
        block = kinds[np.frombuffer(text, np.uint8, min(CHUNK_BYTES, len(text) - at), at)]
        between = np.flatnonzero(block == 0)
        if len(between) or at + len(block) == len(text):
            end = at + (int(between[-1]) + 1 if len(between) and at + len(block) < len(text) else len(block))
            h, _, heads = word_and_head_hashes([text[at:end]], kinds, head)
        else:
            total, end = 0, at
            while end < len(text):
                block = kinds[np.frombuffer(text, np.uint8, min(CHUNK_BYTES, len(text) - end), end)]
                between = np.flatnonzero(block == 0)
                block = block[: between[0]] if len(between) else block
                total += int((block * power[: len(block)]).sum(dtype=np.uint64)) * pow(_PRIME, end - at, 1 << 64)
                end += len(block)
                if len(between):
                    break
            h = mix(np.array([(total + end - at) & (1 << 64) - 1], np.uint64))
            heads = word_and_head_hashes([text[at : at + head]], kinds, head)[0] if head else h[:0]
        found.append((h, heads))
        at = end
    h, heads = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, np.array([len(h)]), heads


def word_hash(word: bytes, kinds: np.ndarray = WORD_BYTES) -> int:
    return int(word_hashes([word], kinds)[0][0])
