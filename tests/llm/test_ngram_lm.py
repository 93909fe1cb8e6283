import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyarrow import fs

from palimpsest.llm import ngram_lm
from palimpsest.llm.elias_fano import EliasFano, mapped, packed
from palimpsest.llm.ngram_lm import ANY, MU, MU3, PAD, Trie, build_trie, op5_ngram_lm, shared_dir, train


@pytest.mark.parametrize("top", [1, 5, 70, 4000, 2**40, 2**63])
def test_elias_fano(top):
    r = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        x = np.sort(r.integers(0, top, n, dtype=np.uint64))
        e = EliasFano.build(x)
        e = EliasFano.of({k: v for k, v in e.arrays("a").items()}, "a")
        assert np.array_equal(e.access(np.arange(n)), x)
        probe = np.concatenate([x, x + np.uint64(1), r.integers(0, 2 * top, 200, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert np.array_equal(e.successor(probe), np.searchsorted(x, probe))
        there = np.isin(probe, x)
        assert np.array_equal(e.find(probe) >= 0, there) and np.array_equal(x[e.find(probe)[there]], probe[there])


def test_files(tmp_path):
    arrays = {"a": np.arange(7, dtype=np.uint16), "b": np.empty(0), "c": np.array([2**63], np.uint64)}
    (tmp_path / "f").write_bytes(packed(arrays))
    for store, path in ((fs.LocalFileSystem(), f"{tmp_path}/f"), (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "f")):
        got = mapped(store, path)
        assert all(np.array_equal(got[k], v) and got[k].dtype == v.dtype for k, v in arrays.items())


@pytest.mark.parametrize("only_ends", [False, True])
def test_trie(only_ends):
    r = random.Random(3)
    rows = {(r.choice([0, 1, 5, 9, 4000]), r.randrange(50), PAD if only_ends else r.choice([0, 3, 7, 9000, PAD])): r.randrange(1, 50) for _ in range(400)}
    counts = Counter()
    for (v, w, _), n in rows.items():
        counts[v, w] += n
    dealt = next(iter(counts))
    rows[*dealt, ANY] = counts[dealt] = 777
    keys = sorted(rows)
    columns = [np.array([v << 32 | w for v, w, _ in keys], np.uint64), np.array([x for *_, x in keys], np.uint32), np.array([rows[k] for k in keys]), np.zeros(len(keys))]
    t = Trie(build_trie(tuple(columns), 10_000, lambda k, n: n / 1000))
    every = [(v, w) for v in (0, 1, 2, 5, 9, 10, 4000, 4001) for w in range(60)]
    place = t.find(np.array([v for v, _ in every], np.uint64), np.array([w for _, w in every], np.uint64))
    for pair, i in zip(every, place, strict=True):
        assert (i >= 0) == (pair in counts)
        if i >= 0:
            assert math.isclose(t.value("p", i), counts[pair] / 1000, rel_tol=1e-3) and math.isclose(t.value("rest", i), MU3 / (counts[pair] + MU3), rel_tol=1e-3)
        for x in (0, 1, 3, 7, 9000, 9001):
            j = t.next(np.array([i]), np.array([x]))[0]
            assert (j >= 0) == ((*pair, x) in rows)
            if j >= 0:
                assert math.isclose(t.value("share", j), rows[*pair, x] / 10_000, rel_tol=1e-3)


def plain(rows):
    cut = lambda t: [*(t or "").encode().lower().split(), "END"]
    one, two, three = Counter(), Counter(), Counter()
    crc = lambda k: None if k is None else zlib.crc32(str(k).encode()) % 10
    for k, t in rows:
        if crc(k):
            w = cut(t)
            one.update(w)
            two.update(zip(["END", *w], w, strict=False))
            three.update(zip(["END", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, b: (two[a, b] + MU * p1(b)) / (one[a] + MU)
    p3 = lambda a, b, c: (three[a, b, c] + MU3 * p2(b, c)) / (two[a, b] + MU3)
    for k, t in rows:
        w = cut(t)
        score = math.log10(p2("END", w[0])) + sum(math.log10(p3(*x)) for x in zip(["END", *w], w, w[1:], strict=False))
        yield k, crc(k) == 0, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, docs_of, sf_dir, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram_lm, "GATHER", 50)
        monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 200)
    r = random.Random(9)
    vocabulary = ["the", "The", "of", "\x00odd", "é"] + ["w%d" % i for i in range(80)]
    rows = [(i, r.choice([" ", "\n", "\t  "]).join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "the of"), (902, "the of " * 20_000), (5, rows[5][1]), (903, "never seen words")]
    out = op5_ngram_lm(spark, sf_dir(documents=docs_of(rows).withColumnRenamed("lang", "score"))).collect()
    got, want = (sorted(x, key=lambda x: (str(x[0]), x[5])) for x in (map(tuple, out), plain(rows)))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and abs(a[6] - b[6]) < 2e-4 * a[2]


@pytest.mark.parametrize("shard_tokens", [30, 1 << 20])
def test_sums_to_one(spark, monkeypatch, shard_tokens):
    """Of every word that can follow, an unknown one for all that weren't seen, after contexts that were seen or not."""
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard_tokens)
    r = random.Random(2)
    texts = [(" ".join(r.choice("abcdef") for _ in range(r.randrange(9))),) for _ in range(200)]
    model = train(spark.createDataFrame(texts, "text string"), shared_dir(spark) + "-lm")
    assert model.vocabulary.size == 7
    for context in ("", "a", "a b", "f f", "zz a", "a zz", "zz zz"):
        # of the token after the context: each word, an unknown one, the end
        total = sum(model.probabilities([f"{context} {x}".encode()])[3][len(context.split())] for x in [*"abcdef", "zz", ""])
        assert abs(total - 1) < 1e-3


@pytest.mark.parametrize("rows", [[], [(None, "a b")]])
def test_nothing_to_learn(spark, docs_of, sf_dir, rows):
    out = op5_ngram_lm(spark, sf_dir(documents=docs_of(rows))).collect()
    assert len(out) == len(rows) and all(x.train_tokens == 0 and x.score == x.base_score == 0 for x in out)
