import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from palimpsest.llm import langid
from palimpsest.llm.langid import context_hashes, gram_hashes, learn, op7_langid, symbols

WORDS = {"en": "the of and that house tree walk over", "de": "der und das haus baum gehen über schön", "fr": "le et la maison arbre à été où", "ja": "日本 語 の 文字 です 私 木 家"}


def text(r, lang, n=40):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def kneser_ney(texts, order):
    """Interpolated Kneser-Ney with dictionaries."""
    top = Counter()
    for t in texts:
        s = symbols([t])[0].tolist()
        padded = [0] * (order - 1) + s
        for i in range(len(s)):
            top[tuple(padded[i : i + order])] += 1
    levels = [top]
    while len(levels) < order:
        below = Counter()
        for g in levels[-1]:
            below[g[1:]] += 1
        levels.append(below)
    levels.reverse()
    stats = []
    for level in levels:
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, left = defaultdict(float), defaultdict(float)
        for g, v in level.items():
            total[g[:-1]] += v
            left[g[:-1]] += min(v, d)
        stats.append((level, d, total, left))

    def log2(t):
        s = symbols([t])[0].tolist()
        padded, out = [0] * (order - 1) + s, 0.0
        for i in range(len(s)):
            p = 1 / (len(levels[0]) + 1)
            for n, (level, d, total, left) in enumerate(stats, 1):
                g = tuple(padded[i + order - n : i + order])
                if g[:-1] in total:
                    p = max(level.get(g, 0) - d, 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p
            out += np.log2(p)
        return out

    return log2


def test_symbols():
    s, d = symbols(["Ab, 12 c!", "", "É", "1"])
    assert s.tolist() == [ord("a"), ord("b"), 32, ord("c"), 32, ord("é"), 32] and d.tolist() == [0] * 5 + [2] * 2


def test_a_text_has_the_same_hashes_among_others():
    alone, both = symbols(["the house"]), symbols(["x y", "the house", "z"])
    inside = both[1] == 1
    for f in (gram_hashes, context_hashes):
        assert all(np.array_equal(a, b[inside]) for a, b in zip(f(*alone), f(*both), strict=True))


def test_against_dictionaries(monkeypatch):
    monkeypatch.setattr(langid, "SLOTS", 64)
    r = random.Random(4)
    texts = [text(r, "de", 12) for _ in range(25)] + ["Haus!! haus 7 baum"]
    monkeypatch.setattr(langid, "CALIBRATE", 10**9)
    model = learn(texts, ["de"] * len(texts), 4)
    want = kneser_ney(texts, 4)
    probe = [*texts[:3], text(r, "fr", 30), "", "schöner baum gehen", "Q"]
    entropy, n = model.entropies(probe)
    again, _ = model.entropies(probe)
    for e, k, t in zip(entropy[:, 0], n, probe, strict=True):
        assert abs(-e * k - want(t)) < 1e-3 * max(1, k)
    assert np.allclose(entropy, again)


def test_query(spark, docs_of, sf_dir):
    r = random.Random(6)
    rows = [(i, text(r, lang, r.randrange(3, 60)), lang) for i, lang in enumerate(r.choice(list(WORDS)) for _ in range(400))]
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 !!", "en"), (903, text(r, "fr"), None), (None, text(r, "ja"), "en"), (904, "the " * 30_000, "en"), (0, rows[0][1], rows[0][2])]
    path = sf_dir(documents=docs_of(rows + extra))
    out = op7_langid(spark, path).collect()
    assert len(out) == len(rows) + len(extra)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in out)
    lang = {i: x for i, _, x in rows}
    assert all(x.lang_pred == lang[x.doc_id] for x in out if x.doc_id in lang)
    assert all(0 <= x.score <= 1 for x in out)
    got = {x.doc_id: x for x in out}
    assert all(got[k].lang_pred == "und" and got[k].rejected for k in (900, 901, 902))
    assert got[903].lang_pred == "fr" and got[904].lang_pred == "en" and got[None].lang_pred == "ja"
    assert sum(x.rejected for x in out) <= 3 + 2
    assert sorted(map(str, out)) == sorted(map(str, op7_langid(spark, path).collect()))
    assert op7_langid(spark, sf_dir(documents=docs_of(rows[:0]))).count() == 0


def test_nothing_to_learn(spark, docs_of, sf_dir):
    assert [x.lang_pred for x in op7_langid(spark, sf_dir(documents=docs_of([(1, "a b", None)]))).collect()] == ["und"]


def test_rejection():
    r = random.Random(9)
    langs = [r.choice(["en", "de"]) for _ in range(300)]
    model = learn([text(r, x) for x in langs], langs)
    _, _, rejected = model.predict([text(r, "en"), text(r, "ja"), "xqz jjk vvw " * 30])
    assert rejected.tolist() == [False, True, True]


def test_long_texts_are_scored_in_windows(monkeypatch):
    r = random.Random(10)
    model = learn([text(r, "de", 12) for _ in range(25)], ["de"] * 25)
    long = [text(r, "de", 300), "a, " * 200, "é" * 500 + "!!  " * 100, "1234 " * 100]
    want = [model.entropies([x]) for x in long]
    monkeypatch.setattr(langid.Identifier, "chunk", 37)
    for x, (e, n) in zip(long, want, strict=True):
        got, m = model.entropies([x])
        assert m[0] == n[0] and np.allclose(got, e, atol=1e-5)


def test_every_language_is_learned(spark, docs_of):
    docs = docs_of([(i, f"word{i % 40}", f"l{i % 40}") for i in range(1200)] + [(5, "again", "l5")])
    rows = langid.training_rows(docs, 10, all_rows=200).collect()
    assert {x.lang for x in rows} == {f"l{i}" for i in range(40)} and 100 < len(rows) < 300
    assert len(langid.training_rows(docs, 10_000).select("doc_id", "lang").collect()) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1200))
