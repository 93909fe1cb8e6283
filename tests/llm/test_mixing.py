import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing
from palimpsest.llm.mixing import _time_of, assign, curriculum, op8_mix_sources, source_targets


def filled(sizes, weights, most=3):
    """Shares out step by step, as the contract says."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 5, 50, 900, 10_000]) for i in range(9)} | {None: 7}
    got = {x.source: x.target for x in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = filled(sizes, mixing.WEIGHTS)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_query(spark, docs_of, sf_dir):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randrange(1, 40)), "en", r.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(700, None), (701, ""), (702, " \t\n\x0b\f\r"), (None, "a b"), (5, rows[5][1], "en", rows[5][3]), (703, "x " * 5000, "en", "d"), (704, "  y", "en", "b")]
    path = sf_dir(documents=docs_of(rows))
    out = op8_mix_sources(spark, path).collect()
    assert sorted(map(str, out)) == sorted(map(str, op8_mix_sources(spark, path).collect()))
    assert len(out) == len(rows)
    size = {x.doc_id: x.size for x in out}
    assert size[700] == size[701] == size[702] == 0 and size[703] == 5000 and size[704] == 2
    per, largest, target, source = defaultdict(int), defaultdict(int), {}, {x[0]: x[3] if len(x) > 3 else "s" for x in rows}
    for x in out:
        s = source[x.doc_id]
        assert x.taken <= 3 * x.size and x.taken % max(1, x.size) == 0
        per[s] += x.taken
        largest[s] = max(largest[s], x.size)
        target[s] = x.target
    sizes = {source[x.doc_id]: x.source_size for x in out}
    assert all(abs(target[s] - v) < 1e-6 for s, v in filled(sizes, mixing.WEIGHTS).items())
    assert all(abs(per[s] - target[s]) <= largest[s] for s in per)
    assert all((x.position is None) == (x.last_position is None) == (x.taken == 0) for x in out)
    assert all(0 <= x.position <= x.last_position <= 1 and (x.taken > x.size) == (x.position < x.last_position) for x in out if x.taken)
    parts = op8_mix_sources(spark, path).select("position", F.spark_partition_id().alias("p")).collect()
    assert all(a.position <= b.position for a, b in zip(parts, parts[1:], strict=False) if a.position is not None and b.position is not None)
    assert op8_mix_sources(spark, sf_dir(documents=docs_of(rows[:0]))).count() == 0


def test_positions_follow_the_schedules(spark, docs_of):
    docs = docs_of([(i, "a b c d", "en", "xyz"[i % 3]) for i in range(900)]).withColumnRenamed("lang", "target")
    rows = curriculum(assign(docs)).select("source", "position", F.spark_partition_id().alias("p")).collect()
    assert all(a.position <= b.position for a, b in zip(rows, rows[1:], strict=False) if a.p == b.p)
    half = {s: sum(x.position < 0.5 for x in rows if x.source == s) / sum(x.source == s for x in rows) for s in "xyz"}
    assert abs(half["x"] - 0.5) < 0.02 and abs(half["y"] - 0.625) < 0.02 and abs(half["z"] - 0.375) < 0.02


def test_inverse_of_the_integral(spark):
    schedule = (0.0, 2.0, 0.5, 0.5)
    shares = [k / 40 for k in range(41)]
    got = [x.t for x in spark.createDataFrame([(s,) for s in shares], "s double").select("s", _time_of(F.col("s"), schedule).alias("t")).orderBy("s").collect()]

    def integral(t, n=6000):
        at = lambda u: schedule[min(2, int(u * 3))] + (schedule[min(2, int(u * 3)) + 1] - schedule[min(2, int(u * 3))]) * (u * 3 - min(2, int(u * 3)))
        return sum(at((k + 0.5) / n) for k in range(int(t * n))) / n

    assert all(abs(integral(t) / integral(1) - s) < 2e-3 for s, t in zip(shares, got, strict=True))
    with pytest.raises(ValueError):
        _time_of(F.lit(0.5), (0.0, 0.0))


def test_a_schedule_changes_the_order(spark, docs_of):
    sized = docs_of([(i, "a b c", "en", "xy"[i % 2]) for i in range(200)]).select("doc_id", "source", F.lit(3).cast("long").alias("size"))
    first = lambda schedules: {x.doc_id: x.position for x in mixing.by_position(mixing.place(sized, schedules=schedules)).collect()}
    even, late = first([(1.0, 1.0)]), first([(1.0, 1.0), (0.0, 1.0)])
    assert all(even[i] == late[i] for i in range(0, 200, 2)) and all(even[i] is None or even[i] <= late[i] for i in range(1, 200, 2)) and even != late


def test_sql(spark, docs_of, sf_dir):
    import duckdb

    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randrange(0, 30)), "en", r.choice(["a", "a", "b", "c", None])) for i in range(400)] + [(5, "x y", "en", "a"), (None, "z", "en", "b"), (900, None, "en", "empty")]
    path = sf_dir(documents=docs_of(rows))
    got = op8_mix_sources(spark, path)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        want = db.sql(mixing.OP8_SQL)
        assert sorted(map(str, (tuple(x) for x in got.collect()))) == sorted(map(str, want.select(*got.columns).fetchall()))
