import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from palimpsest.llm.byte_bpe import Codec, encode_documents, load_ranks, op10_byte_bpe, sentencepiece_model

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(7)
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "'s", "'", "12", ".,", " ", "　", "\x1c", "\x85", "\0", "日本", "😀", "<|endoftext|>", "²", "x" * 90]
    return ["", " ", "a", *("".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(3000)), "ab" * 30_000, "word " * 20_000]


def test_as_the_library(reference):
    c = Codec(load_ranks(PATH), P.PATTERN)
    for t in texts():
        ids = c.encode(t)
        assert ids == reference.encode_ordinary(t), repr(t[:80])
        assert c.decode(ids) == t.encode()


def test_every_kind_of_character(reference):
    c = Codec(load_ranks(PATH), P.PATTERN)
    for cp in [*range(1, 0x3100), *range(0xFE00, 0x10000), *range(0x1F000, 0x1FB00)]:
        t = f"a{chr(cp)}b1{chr(cp)} {chr(cp)} y"
        assert c.encode(t) == reference.encode_ordinary(t), hex(cp)


def test_vocabulary_must_be_whole():
    with pytest.raises(ValueError):
        sentencepiece_model({b"a": 0})


def test_query(spark, docs_of, sf_dir, reference):
    rows = [(1, None), (2, ""), (3, "Eau de la\n vie."), (3, "Eau de la\n vie."), (None, "x"), *((10 + i, t) for i, t in enumerate(texts()[-40:]))]
    out = op10_byte_bpe(spark, sf_dir(documents=docs_of(rows)))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = []
    for k, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, expected))
    assert op10_byte_bpe(spark, sf_dir(documents=docs_of(rows[:0]))).count() == 0


def test_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "a b")]).withColumnRenamed("source", "ids").withColumnRenamed("lang", "decoded")
    row = encode_documents(docs, PATH, P.PATTERN).first()
    assert bytes(row.decoded) == b"a b" and len(row.ids) == 2


def test_long_texts_and_other_patterns(reference, monkeypatch):
    from palimpsest.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "BATCH_CHARS", 20)
    c = Codec(load_ranks(PATH), P.PATTERN)
    for t in texts()[-400:]:
        assert c.encode(t) == reference.encode_ordinary(t) and c.decode_packed(c.encode_packed([t])[0]) == t.encode()
    for pattern in (r"\S+\s*|\s+", r"[a-z ]+|[^a-z ]+"):
        own, c = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=load_ranks(PATH), special_tokens={}), Codec(load_ranks(PATH), pattern)
        for t in texts()[:300]:
            assert c.encode(t) == own.encode_ordinary(t)
