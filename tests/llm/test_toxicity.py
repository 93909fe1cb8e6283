import random
import zlib

import numpy as np

from palimpsest.llm import toxicity
from palimpsest.llm._common import LETTER_BYTES, WORD_BYTES, slices, word_hashes
from palimpsest.llm.toxicity import FTRL, distinct_features, op3_toxicity, score_toxicity


def test_word_hashes():
    texts = [b"", b"One two  ONE", b" \x00a\x0b", "é é".encode(), b"one"]
    h, n = word_hashes(texts, WORD_BYTES)
    assert n.tolist() == [0, 3, 1, 2, 1]
    assert h[0] == h[2] == h[6] and h[4] == h[5] and len(set(h.tolist())) == 4
    assert word_hashes([b"x, the-X"], LETTER_BYTES)[1].tolist() == [3]
    assert list(slices([b"a" * 5, b"b" * 5, b"c" * 50, b"d"], 11)) == [(0, 2), (2, 3), (3, 4)]
    assert not len(word_hashes([], WORD_BYTES)[0])


def test_updates_as_published():
    """Against the algorithm written out for one coordinate at a time."""
    r = random.Random(0)
    m = FTRL(bits=4, alpha=0.3, beta=1.0, l1=0.2, l2=0.5)
    z, n = dict.fromkeys(range(17), 0.0), dict.fromkeys(range(17), 0.0)
    for _ in range(200):
        at, y = sorted(r.sample(range(16), 3)), r.randrange(2)
        w = {}
        for i in [*at, 16]:
            l1 = 0 if i == 16 else 0.2
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.5)
        g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (toxicity.TOXIC_WEIGHT if y else 1)
        for i in w:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3
            z[i] += g - sigma * w[i]
            n[i] += g * g
        m.learn(np.array(at), y)
    assert np.allclose(m.z, [z[i] for i in range(17)]) and np.allclose(m.n, [n[i] for i in range(17)])


def test_features_are_words_pairs_and_skips():
    assert len(distinct_features([b"one two three"])[0]) == 3 + 2 + 1
    assert len(distinct_features([b"a a a a"])[0]) == 3
    assert [len(x) for x in distinct_features([b"", b"longerthaneight", b""])] == [0, 2, 0]


def rows(n, seed=1):
    r = random.Random(seed)
    out, toxic = [], {}
    for i in range(n):
        words = ["w%d" % r.randrange(300) for _ in range(r.randrange(5, 60))]
        if r.random() < 0.2:
            toxic[i] = 1
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum"]))
        else:
            toxic[i] = 0
        out.append((i, " ".join(words)))
    return out, toxic


def test_query(spark, docs_of, sf_dir):
    data, toxic = rows(1500)
    extra = [(9001, None), (9002, ""), (None, "idiot"), (9003, "idiot " * 40_000), (0, data[0][1])]
    labels = spark.createDataFrame([(k, 1, v) for k, v in toxic.items()] + [(9002, 1, None), (None, 1, 1), (3, 0, toxic[3])], "doc_id long, quality int, toxic int")
    path = sf_dir(documents=docs_of(data + extra), labels=labels)
    out = op3_toxicity(spark, path).collect()
    assert len(out) == len(data) + len(extra)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in out)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in out)
    held = [x for x in out if x.held_out and x.doc_id in toxic]
    assert sum(x.predicted == toxic[x.doc_id] for x in held) / len(held) > 0.97
    assert {x.score for x in out if x.doc_id == 9001} == {x.score for x in out if x.doc_id == 9002}
    assert sorted(map(str, out)) == sorted(map(str, op3_toxicity(spark, path).collect()))


def test_held_out_labels_are_not_learned(spark, docs_of):
    data, toxic = rows(300, 2)
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    frames = [spark.createDataFrame([(k, 1 - v if f and held(k) else v) for k, v in toxic.items()], "doc_id long, toxic int") for f in (False, True)]
    assert [sorted(map(str, score_toxicity(docs_of(data), x).collect())) for x in frames][0] == sorted(map(str, score_toxicity(docs_of(data), frames[1]).collect()))


def test_nothing_to_learn(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert [x.score for x in score_toxicity(docs_of([(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert score_toxicity(docs_of([(1, "a")]).limit(0), none).count() == 0


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark, docs_of):
    data, toxic = rows(300, 3)
    labels = spark.createDataFrame([(k, v) for k, v in toxic.items()] + [(100_000 + i, 0) for i in range(20_000)], "doc_id long, toxic int")
    free = [i for i, _ in data if zlib.crc32(str(i).encode()) % 3 != 1]
    got = toxicity.training_rows(docs_of([*data, (free[0], "a copy")]), labels, 500).collect()
    assert sorted(x.doc_id for x in got) == free
    assert sorted(x.doc_id for x in toxicity.training_rows(docs_of(data), labels, 20).collect()) == sorted(x.doc_id for x in sorted(got, key=lambda x: (x.turn, x.doc_id))[:20])


def test_words_of_long_texts(monkeypatch):
    from palimpsest.llm import _common

    r = random.Random(5)
    text = b" ".join(bytes(r.choices(b"abC\xc3\xa9\t", k=r.randrange(1, 30))) for _ in range(4000)) + b" " + b"x" * 9000 + b" tail  "
    want = _common.word_and_head_hashes([text], WORD_BYTES, 4)
    monkeypatch.setattr(_common, "CHUNK_BYTES", 1000)
    got = _common.word_and_head_hashes([text], WORD_BYTES, 4)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    for t in (b" " * 5000, b"y" * 5000, b"y" * 5000 + b" "):
        monkeypatch.setattr(_common, "CHUNK_BYTES", 1000)
        got = _common.word_and_head_hashes([t], WORD_BYTES, 8)
        monkeypatch.setattr(_common, "CHUNK_BYTES", 1 << 20)
        assert all(np.array_equal(a, b) for a, b in zip(got, _common.word_and_head_hashes([t], WORD_BYTES, 8), strict=True))
