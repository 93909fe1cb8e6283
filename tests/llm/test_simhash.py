import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import components as components_module
from palimpsest.llm import simhash
from palimpsest.llm.components import components, local_stars
from palimpsest.llm.simhash import copies, fingerprint, homes, links, near_duplicates, op2_simhash


def plain(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_fingerprint():
    for t in ["", " \t\x0b", "A", "a b c", "A b\nc d", "a b c d e f g " * 50, "é À 日本 x\0y z", "w " * 70_000]:
        assert fingerprint(t.encode()) == plain(t)


def test_every_pattern_is_within_the_radius_of_an_anchor(spark):
    fps = spark.range(1 << 15).select((F.col("id") * 64 * 2097152 + F.col("id")).alias("fp"))
    far = homes(fps).select(F.max(F.bit_count(F.expr("((fp >> cast(21 * (anchor >> 32) as int)) & 2097151) ^ (anchor & 2097151)"))))
    assert far.first()[0] <= 1
    assert copies(fps).filter("home").exceptAll(homes(fps).select("anchor", "fp", F.lit(True))).count() == 0


@pytest.mark.parametrize("home_rows", [4096, 3])
def test_links_against_all_pairs(spark, home_rows):
    r = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
    for _ in range(150):
        fps.add(sum(1 << b for b in r.sample(range(64), r.randrange(1, 4))))
    fps = sorted(fps)
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    for most in ([10_000, 0] if home_rows == 3 else [10_000]):
        got = [(x.a, x.b) for x in links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, home_rows, most).collect()]
        want = [(a, b) for i, a in enumerate(signed) for j, b in enumerate(signed[:i]) if (fps[i] ^ fps[j]).bit_count() <= 4]
        assert grouped(signed, got) == grouped(signed, want)


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components_module, "BROADCAST_LINKS", most)
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    edges = chain + [(r.randrange(1000, 2000), r.randrange(1000, 2000)) for _ in range(700)] + [(5000, 6000 + i) for i in range(300)] + [(7, 7)]
    nodes = {x for e in edges for x in e}
    want = grouped(nodes, edges)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in nodes} == want
    a, b = local_stars(*np.array(edges).T)
    assert {x: dict(zip(a.tolist(), b.tolist(), strict=True)).get(x, x) for x in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, docs_of, sf_dir):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = [(1, None), (2, ""), (3, "\n \t"), (4, "One two"), (4, "one  TWO"), (None, "one two"), (None, "lonely words here"), (5, "x " * 30_000)]
    for k in range(30):
        base = [word() for _ in range(120)]
        for i in range(8):
            w = list(base)
            for _ in range(i):
                w[r.randrange(120)] = word()
            rows.append((100 + 10 * k + i, " ".join(w)))
    docs = docs_of(rows)
    out = op2_simhash(spark, sf_dir(documents=docs)).collect()
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.fingerprint) for x in out) == sorted((k is not None, k or 0, f"{plain(t or ''):016x}") for k, t in rows)
    fps = sorted({plain(t or "") for _, t in rows})
    group = grouped(fps, [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4])
    least = {}
    for k, t in rows:
        if k is not None:
            g = group[plain(t or "")]
            least[g] = min(least.get(g, k), k)
    assert all(x.component_id == least.get(group[int(x.fingerprint, 16)]) for x in out)
    assert 4 < len(set(group.values())) < len(fps)
    assert op2_simhash(spark, sf_dir(documents=docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(docs, distance=6)
    assert simhash.RADIUS == 1


def test_fingerprint_of_long_texts(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    r = random.Random(12)
    for n in (1, 3, 4, 5, 400):
        t = " ".join("".join(r.choice("abcD") for _ in range(r.randrange(1, 9))) for _ in range(n)) + " " * r.randrange(3)
        assert fingerprint(t.encode()) == plain(t)
    assert fingerprint((" " * 300).encode()) == 0 and fingerprint(("q" * 300).encode()) == plain("q" * 300)
