"""Byte-level BPE encoding and decoding through a sentencepiece model that is made from the vocabulary alone.

A rank file's tokens are byte strings. Each byte is written as one character, so that a token becomes a piece of text;
its score is the negative rank, and the normalisation is the identity. Sentencepiece then merges, of all neighbours whose
joint piece exists, the pair of the best score and of those the leftmost: the merges of the rank file. Texts are split
into pre-tokens first and each is encoded by itself; decoding maps ids back to their bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; special tokens have no meaning in a text, it is
ordinary text there. Of pairs of equal score the leftmost merges. Long texts are encoded a part of ``BATCH_CHARS`` at a time, cut where
pre-tokens end in any case. A pattern other than ``public_tokenizers.PATTERN`` is matched over whole texts, for where it cuts isn't
known. Columns of the input other than the text stay; a column named as an output is replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm._common import lean, table, utf8

#: Byte b is written as this character: visible ASCII as itself, the rest as characters that are no white space.
BYTE_CHARS = {b: b if 0x21 <= b <= 0x7E else 0x100 + b for b in range(256)}
#: The piece that the format demands for unknown text; no character of it stands for a byte.
UNKNOWN = "\u2047"
#: Units of text whose ids a Python worker keeps, and the longest of them.
CACHE_UNITS, CACHE_CHARS = 150_000, 64
#: Texts of so many characters together are encoded at a time.
BATCH_CHARS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a line for each, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, float or integer."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(BYTE_CHARS)


def piece_of(text: str) -> str:
    return text.replace(" ", chr(BYTE_CHARS[0x20])) if text.isascii() and text.isprintable() else as_piece(text.encode())


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: pieces in order of rank, which is their id, then the unknown piece that the format demands."""
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0 to n-1 and hold every single byte")
    pieces = [_field(1, as_piece(token).encode()) + _field(2, float(-rank)) + _field(3, 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    trainer += b"".join(_varint(k << 3) + b"\xff" * 9 + b"\x01" for k in (41, 42, 43))  # no begin, end or padding: -1
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, x) for x in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and back; keeps the ids of frequent units of text, as packed 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {as_piece(token): array("i", [rank]).tobytes() for token, rank in ranks.items()}
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.find = regex.compile(pattern).findall
        self.uneven = re.compile(r"\s\s").search
        self.space = re.compile(r"(?<=\S) (?=\S)")
        self.between = self.space.split
        self.cuts = pattern == public_tokenizers.PATTERN
        self.known: dict[str, bytes] = {}

    def _units(self, text: str) -> list[str]:
        """The text cut where pre-tokens end in any case: at a space or, kept, a new line between two other characters."""
        if self.uneven(text) or text[:1].isspace() or text[-1:].isspace():
            return self.between(text)
        return text.replace("\n", " \n").split(" ")

    def _learn(self, units: Iterable[str], lead: str) -> dict[str, bytes]:
        """Ids of units after a lead, no text or a space; one that begins with a new line has none. A merge takes place within a pre-token only."""
        space = piece_of(lead)
        parts = [(u, (space + u,) if self.cuts and u.isascii() and u.isalpha() else tuple(map(piece_of, self.find(u if u[:1] == "\n" else lead + u)))) for u in units]
        new = list({x for _, p in parts for x in p}.difference(self.ranks))
        ids = {x: array("i", y).tobytes() for x, y in zip(new, self.model.encode(new, out_type=int, num_threads=1), strict=True)} if new else {}
        rank = self.ranks.get
        return {u: b"".join([rank(x) or ids[x] for x in p]) for u, p in parts}

    def _parts(self, text: str) -> Iterator[str]:
        """A long text cut before single spaces, where pre-tokens end in any case."""
        at = 0
        while at < len(text):
            cut = self.space.search(text, at + BATCH_CHARS) if len(text) - at > 2 * BATCH_CHARS else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if not self.cuts:
            return [b"".join(self._learn({x}, "").values()) for x in texts]
        if any(len(x) > 2 * BATCH_CHARS for x in texts):
            return [b"".join(y for part in self._parts(x) for y in self._encode_parts([part])) for x in texts]
        return self._encode_parts(texts)

    def _encode_parts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        cut = [self._units(x) if x else [] for x in texts]
        firsts = self._learn({x[0] for x in cut if x}, "")
        fresh = self._learn(set(chain.from_iterable(x[1:] for x in cut)).difference(self.known), " ")
        self.known.update(fresh)
        get = self.known.__getitem__
        out = [firsts[x[0]] + b"".join(map(get, x[1:])) if x else b"" for x in cut]
        for u in fresh:
            if len(u) > CACHE_CHARS:
                del self.known[u]
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_packed(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_packed(self, ids: bytes) -> bytes:
        step = 4 * BATCH_CHARS
        return b"".join(self.decode(np.frombuffer(ids[k : k + step], np.int32).tolist()) for k in range(0, len(ids), step))


_codecs: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def _batches(texts: list[bytes]) -> Iterator[list[str]]:
    out, total = [], 0
    for x in texts:
        out.append(x.decode())
        total += len(x)
        if total > BATCH_CHARS:
            yield out
            out, total = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the ids of each text and, from these, the decoded bytes.

    :param path: rank file; every machine has it at this path
    :param pattern: each match is a pre-token
    """
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    source = docs.select(*(docs[c] for c in kept))
    schema = T.StructType([*source.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            start = 0
            for texts in _batches(utf8(batch.column(batch.schema.get_field_index(text)))):
                out = c.encode_packed(texts)
                offsets = np.zeros(len(out) + 1, np.int32)
                np.cumsum([len(x) >> 2 for x in out], out=offsets[1:])
                values = np.frombuffer(b"".join(out), np.int32)
                part = batch.slice(start, len(out))
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array([c.decode_packed(x) for x in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, ids, decoded])
                start += len(out)

    return source.mapInArrow(lean(run), schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
