import random

import pytest

import corpus_pipeline
from palimpsest.llm import similar


def sets(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    x, y = sets(a), sets(b)
    return bool(x and y) and 9 * len(x & y) >= 4 * (len(x) + len(y))


def corpus():
    r = random.Random(3)
    phrase = [f"p{i}" for i in range(12)]
    texts = []
    for _ in range(40):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(40, 160))]
        w[5:5] = phrase
        texts.append(" ".join(w))
        for edits in (1, 2, 3, 5):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(v))
    return texts + ["", "one two", "One  two", "one two three", None]


@pytest.mark.parametrize("together, star_rows", [(1 << 22, 512), (400, 2), (0, 512)])
def test_links_connect_all_pairs(spark, together, star_rows):
    texts = corpus()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, texts[i]) for i in range(0, 60, 2)], "sid long, text string")
    got = {tuple(sorted((x.a, x.b))) for x in similar.links(frame, together, star_rows).collect()}
    want = {(i, j) for j, y in enumerate(texts) for i, x in enumerate(texts[:j]) if like(x or "", y or "")}
    assert got <= want and len(want) > 40
    root = list(range(len(texts)))
    for links in (got, want):  # the second brings nothing together that the first hasn't
        for a, b in links:
            new = min(root[a], root[b]), max(root[a], root[b])
            assert links is got or new[0] == new[1]
            root = [new[0] if x == new[1] else x for x in root]


def test_stage_leaves_no_pair(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(corpus()[:100])]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1]), (600, None), (601, ""), (None, rows[7][1])]
    out = corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "")
    assert out.columns == docs_of(rows).columns
    left = [x.text for x in out.collect()]
    assert left.count(None) == 1
    left.remove(None)
    assert not any(like(x, y) for i, x in enumerate(left) for y in left[:i])
    assert {rows[i][1] for i in range(0, 100, 5)} <= set(left) and len(left) == len(set(left)) and "" not in left


def test_a_large_group_of_near_copies_isn_t_paired(spark):
    """Copies of one text, each with a word of its own, are connected by their centre; only the text that isn't like it is left to candidates."""
    r = random.Random(5)
    w = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        v = list(w)
        v[r.randrange(len(v))] = f"x{i}"
        texts.append(" ".join(v))
    frame = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    shared = similar.shared_shingles(frame).cache()
    near = [(x.a, x.b) for x in similar.stars(frame, shared, 16).collect()]
    assert len({a for a, _ in near}) == len(near) == 299 and all(like(texts[a], texts[b]) for a, b in near)
    pairs = similar.candidates(shared.withColumn("label", shared["sid"])).collect()
    assert len(pairs) > 299 * 100
    assert not similar.candidates(shared.selectExpr("*", "0L as label")).collect()
    links = {(x.a, x.b) for x in similar.links(frame).collect()}
    assert len(links) == 299


def test_shared_shingles_across_batches(spark):
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)) * 2, "sid long, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    got = []
    for rows in ("10000", "3", "1"):
        spark.conf.set(key, rows)
        got.append(sorted((tuple(x) for x in similar.shared_shingles(frame).drop("at", "before").collect()), key=str))
    spark.conf.unset(key)
    assert got[0] == got[1] == got[2]
    of = {}
    for shingle, sid, _, _ in got[0]:
        of.setdefault(shingle, set()).add(sid)
    assert all(len(x) > 1 for x in of.values()) and len(got[0]) == sum(map(len, of.values()))
    assert all(c is None or c == min(of[h]) != sid for h, sid, _, c in got[0]) and any(c is not None for *_, c in got[0])


def long_texts():
    """Texts that are pairwise apart, each with a shingle of every other, and near copies of some."""
    r = random.Random(11)
    n = 40
    shared = {(i, j): [f"c{i}_{j}_{k}" for k in range(5)] for j in range(n) for i in range(j)}
    texts = []
    for i in range(n):
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for pair, phrase in shared.items():
            if i in pair:
                w += [*phrase, f"w{r.randrange(10**6)}"]
        texts.append(w)
    copies = []
    for w in texts[::8]:
        v = list(w)
        for _ in range(4):
            v[r.randrange(len(v))] = "x"
        copies.append(v)
    return [" ".join(w) for w in texts + copies]


def test_texts_that_share_a_shingle_by_chance_ship_no_sets(spark, monkeypatch):
    """Pairs grow with the square of the corpus; only texts that are alike, or nearly so, are left after candidates and parities."""
    texts = long_texts()
    monkeypatch.setattr(similar, "SAMPLE", 0)
    frame = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    shared = similar.shared_shingles(frame).selectExpr("*", "sid as label").cache()
    by = {}
    for x in shared.collect():
        by.setdefault(x.shingle, set()).add(x.sid)
    meet = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    pairs = similar.candidates(shared)
    left = {(x.a, x.b) for x in similar.likely(pairs, similar.sketches(frame)).collect()}
    want = {(i, j) for j, y in enumerate(texts) for i, x in enumerate(texts[:j]) if like(x, y)}
    assert len(want) == 5 and left == want and len(meet) > 10 * len(want)
    assert pairs.count() < len(meet) / 4


def test_parities_rule_out_no_alike_texts():
    texts = [x.encode() for x in corpus() if x] + [x.encode() for x in long_texts()] + [b"one", b"one two", b"a b c d e f", b"a b c d e g"]
    n, bits = similar.parities(texts)
    all_sets = [sets(x.decode()) for x in texts]
    assert n.tolist() == [len(x) for x in all_sets] and all(8 * len(b) >= max(64, k) for b, k in zip(bits, n, strict=True))
    for i, x in enumerate(all_sets):
        for j in range(i):
            assert similar.fewest_apart(bits[i], bits[j]) <= len(x ^ all_sets[j])
            assert similar.fewest_apart(bits[i], bits[j]) == similar.fewest_apart(bits[j], bits[i])


def test_short_texts_are_found_at_the_bound(spark):
    """Short sets, of one shingle too, with words changed at either end."""
    texts = []
    for words in (1, 3, 5, 6, 7, 9, 10, 13, 14):
        w = [f"w{words}_{i}" for i in range(words)]
        texts += [" ".join(x) for x in (w, ["x", *w[1:]], [*w[:-1], "y"], [*w, "z"], ["v", *w], [*w, "z", "u"], [x.upper() for x in w])]
    frame = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    root = list(range(len(texts)))
    got = {tuple(sorted((x.a, x.b))) for x in similar.links(frame).collect()}
    want = {(i, j) for j, y in enumerate(texts) for i, x in enumerate(texts[:j]) if like(x, y)}
    assert got <= want and len(want) > 20
    for links in (got, want):
        for a, b in links:
            new = min(root[a], root[b]), max(root[a], root[b])
            assert links is got or new[0] == new[1]
            root = [new[0] if x == new[1] else x for x in root]
