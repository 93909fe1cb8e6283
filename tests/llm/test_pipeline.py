import random

import corpus_pipeline
from palimpsest.llm import byte_bpe, langid, similar, simhash, toxicity
from palimpsest.llm._common import BATCH_BYTES, BATCH_SETTING, lean, small_batches
from palimpsest.llm.mixing import assign


def corpus(docs_of, spark):
    r = random.Random(11)
    words = {"en": [f"en{i}ing" for i in range(200)], "de": [f"ß{i}heit" for i in range(200)]}
    words = {k: ["".join(r.choice("etaoinsh" if k == "en" else "äöüßrdcg") for _ in range(r.randrange(2, 8))) for _ in v] for k, v in words.items()}
    rows, toxic = [], {}
    for i in range(500):
        lang = r.choice(["en", "de"])
        w = [r.choice(words[lang]) for _ in range(r.randrange(20, 80))]
        toxic[i] = int(r.random() < 0.25)
        if toxic[i]:
            w.insert(r.randrange(len(w)), "idiot")
        rows.append((i, " ".join(w), lang, f"s{i % 4}"))
    clean = [x for x in rows if not toxic[x[0]]]
    copies = [(1000 + k, x[1], x[2], x[3]) for k, x in enumerate(clean[:20])]
    odd = [(2000, "12 34 !!", "en", "s1"), (2001, None, "en", "s1"), (2002, "", None, None), (clean[30][0], *clean[30][1:]), (None, clean[31][1], "en", "s2"), (None, "sato heina tiso " * 30, "en", None)]
    return rows + copies + odd, toxic, spark.createDataFrame([(k, 1, v) for k, v in toxic.items()], "doc_id long, quality int, toxic int")


def test_stages(spark, docs_of, sf_dir):
    rows, toxic, labels = corpus(docs_of, spark)
    path = sf_dir(documents=docs_of(rows), labels=labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "mix", "byte_bpe"]

    clean = corpus_pipeline.drop_toxic(spark, docs, path)
    assert clean.columns == columns
    left = [x.doc_id for x in clean.select("doc_id").collect()]
    assert sum(toxic.get(k, 0) for k in left) <= 2 and sum(not toxic.get(k, 0) for k in left) >= sum(not toxic.get(x[0], 0) for x in rows) - 2
    clean = spark.createDataFrame(clean.collect(), clean.schema)

    known = corpus_pipeline.drop_unknown_language(spark, clean, path)
    assert known.columns == columns
    gone = {x.doc_id for x in clean.collect()} - {x.doc_id for x in known.collect()}
    assert {2000, 2001, 2002} <= gone and len(gone) <= 5
    known = spark.createDataFrame(known.collect(), known.schema)

    single = corpus_pipeline.drop_near_duplicates(spark, known, path).collect()
    texts = {x.text for x in known.collect()}
    assert {x.text for x in single} == texts and len(single) == len(texts)
    least = {}
    for x in known.collect():
        if x.doc_id is not None:
            least[x.text] = min(least.get(x.text, x.doc_id), x.doc_id)
    assert all(x.doc_id == least.get(x.text) for x in single)
    single = spark.createDataFrame(single, known.schema)

    mixed = corpus_pipeline.mix(spark, single, path)
    assert mixed.columns == columns
    taken = {x.doc_id: len(x.positions) for x in assign(single).collect()}
    got = [x.doc_id for x in mixed.collect()]
    assert {k: got.count(k) for k in taken} == taken and len(got) > 50

    out = corpus_pipeline.encode(spark, mixed, path).collect()
    assert len(out) == len(got) and all(x.exact and x.n_tokens == len(x.ids) > 0 for x in out)


def test_run_and_nothing(spark, docs_of, sf_dir):
    rows, _, labels = corpus(docs_of, spark)
    path = sf_dir(documents=docs_of(rows), labels=labels)
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, corpus_pipeline.run(spark, path).collect()))
    assert corpus_pipeline.run(spark, sf_dir(documents=docs_of([(1, "a")]).limit(0), labels=labels.limit(0))).count() == 0


def test_small_batches(spark, docs_of, sf_dir, tmp_path, monkeypatch):
    """No stage hands more than about BATCH_BYTES to a Python worker at a time."""
    r, seen = random.Random(5), tmp_path / "seen"
    text = lambda: " ".join("".join(r.choice("etaoinsh") for _ in range(r.randrange(2, 8))) for _ in range(1000))
    rows = [(i, text(), "en", f"s{i % 4}") for i in range(600)]
    path = sf_dir(documents=docs_of(rows).coalesce(1), labels=spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int").coalesce(1))
    docs = spark.read.parquet(f"{path}/documents.parquet")

    def watched(run):
        def noting(batches):
            for x in batches:
                (seen / f"{x.nbytes} {x.num_rows}").touch()
                yield x

        return lean(lambda batches: run(noting(batches)))

    for module in (toxicity, langid, simhash, similar, byte_bpe):
        monkeypatch.setattr(module, "lean", watched)
    seen.mkdir()
    for name, stage in corpus_pipeline.STAGES:
        if name == "mix":
            continue  # without Python workers
        spark.conf.unset(BATCH_SETTING)
        stage(spark, docs, path).write.mode("overwrite").parquet(f"{tmp_path}/out")
        sizes = [int(x.name.split()[0]) for x in seen.iterdir()]
        assert 0.9 * BATCH_BYTES < max(sizes) < 1.1 * BATCH_BYTES, name
        for x in seen.iterdir():
            x.unlink()
    spark.conf.set(BATCH_SETTING, "64k")
    small_batches(spark)
    assert spark.conf.get(BATCH_SETTING) == "64k"
    spark.conf.unset(BATCH_SETTING)
