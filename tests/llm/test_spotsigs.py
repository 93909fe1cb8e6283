import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import spotsigs
from palimpsest.llm.spotsigs import COMMON, as_text, edited, fingerprints, likeness, near_duplicates, op1_spotsigs, with_next


def words_of(text):
    out, now = [], b""
    for b in text.encode():
        if b > 127 or chr(b).isalnum():
            now += bytes([b + 32]) if 65 <= b <= 90 else bytes([b])
        elif now:
            out.append(now)
            now = b""
    return [*out, now] if now else out


def chains(text):
    """Signatures as tuples, written out."""
    words, common = words_of(text), {w.encode() for w in COMMON}
    out = set()
    for i, w in enumerate([None, *words]):
        if w is None or w in common:
            after = [x for x in words[i:] if x not in common][:3]
            if after:
                out.add((w, *after))
    if not out and text:
        out = {("whole", *words)} if words else {("bytes", text)}
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(len(a) == len(b))


def some_texts(n=60, seed=2):
    r = random.Random(seed)
    vocabulary = COMMON[:40] + ["w%d" % i for i in range(60)] + ["é%d" % i for i in range(20)]
    texts = ["", " ", "!!", "the", "the of", "The, OF", "word", "Word the", "a", "日本"]
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randrange(1, 120))]
        texts.append(" ".join(base))
        for _ in range(2):
            c = list(base)
            c[r.randrange(len(c))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "  ", ", ", "\n"]).join(c))
    return texts


def test_signatures_against_plain_python():
    texts = some_texts()
    got = fingerprints([t.encode() for t in texts])
    alone = [fingerprints([t.encode()])[0] for t in texts]
    for f, g, t in zip(got, alone, texts, strict=True):
        assert len(f) == len(chains(t)) and np.array_equal(f, g)
    r = random.Random(1)
    for _ in range(3000):
        i, j = r.randrange(len(texts)), r.randrange(len(texts))
        assert abs(likeness(got[i], got[j]) - jaccard(chains(texts[i]), chains(texts[j]))) < 1e-12
    assert as_text(got[0]) == "" and len(as_text(got[-1])) == 8 * len(got[-1])


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_query(spark, docs_of, sf_dir, monkeypatch, range_rows):
    monkeypatch.setattr(spotsigs.fingerprint_documents, "__defaults__", (range_rows,))
    texts = some_texts(20)
    rows = [(7 * i if i < 40 else 10**12 + i, t) for i, t in enumerate(texts)] + [(-5, None), (21, texts[3]), (21, texts[3]), (None, "last one"), (None, None), (3, "the long " * 20_000)]
    out = op1_spotsigs(spark, sf_dir(documents=docs_of(rows).withColumnRenamed("lang", "bucket"))).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        e = edited(t, n)
        assert e == (t[: len(t) - len(t) // 2] + n[: len(t) // 2])
        a, b, c = (fingerprints([x.encode()])[0] for x in (t, e, n))
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), as_text(a), as_text(b), likeness(a, b), likeness(a, c)))
    assert sorted(map(str, want)) == sorted(str(tuple(x)[:7]) for x in out)


@pytest.mark.parametrize("rows", [[], [(1, "the one")], [(None, "a b"), (None, "c d")], [(5, "x"), (5, "y")]])
def test_few_rows(spark, docs_of, rows):
    out = spotsigs.fingerprint_documents(docs_of(rows)).collect()
    assert len(out) == len(rows)
    if len(rows) == 1:
        assert out[0].near_next == 1.0
    assert {x.doc_id for x in out} == {k for k, _ in rows}


def test_a_range_ends_with_the_head_of_the_next(spark, docs_of):
    rows = with_next(docs_of([(i, str(i)) for i in range(100)]), 10)
    assert rows.filter("ghost").count() == rows.select("bucket").distinct().count() > 5


def test_near_duplicates_against_all_pairs(spark, docs_of):
    texts = some_texts(40, 5) + ["the same words here", "the same words here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[12]), (None, "the lone null text")]
    members, pairs = near_duplicates(docs_of(rows), 0.7)
    sets = [frozenset(chains(t)) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    assert sorted((x.doc_id, x.class_id) for x in members.collect() if x.doc_id is not None) == [(i, first[s]) for i, s in enumerate(sets)]
    got = {(x.a, x.b): x.likeness for x in pairs.collect()}
    names = sorted(first.items(), key=lambda x: x[1])
    want = {(i, j): jaccard(s, t) for s, i in names for t, j in names if i < j and s and t and jaccard(s, t) >= 0.7}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 5
    assert near_duplicates(docs_of([]))[1].count() == 0
