import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.archive import Archive, PatchBuilder
from palimpsest.model import ArchiveError, TriplePattern
from palimpsest.operators import changes
from palimpsest.operators.changes import overlay
from palimpsest.plans.routing import clamp, nearest_snapshot
from palimpsest.sources.ntriples import changes_in_memory, in_memory


def T(text):
    return tuple(text.split()) if " " in text else tuple(text)


def make(spark, base, patches, snapshot=None, lowest=0):
    """base: triples; patches: {version: ["+spo", "-spo"]}"""
    rows = [(v, *T(x[1:].strip()), 1 if x[0] == "+" else -1) for v, xs in patches.items() for x in xs]
    return Archive.from_changes(in_memory(spark, [T(x) for x in base]), changes_in_memory(spark, rows), lowest, max([lowest, *patches]), snapshot)


def got(df):
    return [tuple(x) for x in df.collect()]


def vm(a, v, *args, **kw):
    return {"".join(x) for x in got(a.vm(v, *args, **kw))}


def dm(a, x, y, *args, **kw):
    return {("+" if r[3] else "-") + "".join(r[:3]) for r in got(a.dm(x, y, *args, **kw))}


def test_before_the_first_and_past_the_last(spark):
    a = make(spark, ["aaa", "aab", "aac"], {1: ["-aab"]})
    assert vm(a, -1) == set() and vm(a, 0) == {"aaa", "aab", "aac"}
    assert vm(a, 1) == vm(a, 2) == vm(a, 50) == {"aaa", "aac"}
    assert a.count_vm(-1).first()[0] == 0 and a.count_vm(9).first()[0] == 2
    assert dm(a, -1, 0) == {"+aaa", "+aab", "+aac"} and a.count_dm(-1, 0).first()[0] == 3 and dm(a, -3, -1) == set()


def test_changes_without_effect_and_skipped_versions(spark):
    a = make(spark, ["gpo", "szo", "hzo", "hpo"], {1: ["-gpo", "+apo", "-szo", "+sao"], 2: ["-gpo", "-apo", "-hzo", "+lao"], 4: ["-hpo", "-szo"], 5: ["+hpo"], 6: ["+apo"]})
    assert got(a.vm(1, offset=0, limit=9, order="archive")) == [T(x) for x in ("hpo", "hzo", "apo", "sao")]
    assert got(a.vm(1, offset=1, limit=9, order="archive")) == [T(x) for x in ("hzo", "apo", "sao")]
    assert vm(a, 2) == vm(a, 3) == {"hpo", "lao", "sao"}
    assert vm(a, 4) == {"lao", "sao"} and vm(a, 6) == {"apo", "hpo", "lao", "sao"}
    assert a.log.filter("version = 3 or (s = 'g' and version = 2)").count() == 0


def test_offset_among_deletions(spark):
    a = make(spark, [str(i) * 3 for i in range(10)], {1: ["-000", "-111", "-222", "-444", "-555"]})
    every = [T(str(i) * 3) for i in (3, 6, 7, 8, 9)]
    for k in range(7):
        assert got(a.vm(1, offset=k)) == every[k:] if k else sorted(got(a.vm(1))) == every
    assert got(a.vm(1, offset=1, limit=2)) == every[1:3] and got(a.vm(1, limit=-2)) == every and got(a.vm(1, limit=0)) == []


def test_filtered_deletions(spark):
    a = make(spark, ["aaa", "bbb", "yaa", "zaa"], {1: ["-bbb", "-yaa", "-zaa"]})
    assert vm(a, 1, TriplePattern(None, "a", "a")) == {"aaa"} and vm(a, 0, TriplePattern(None, "a", "a")) == {"aaa", "yaa", "zaa"}
    assert a.count_vm(1, TriplePattern(p="a")).first()[0] == 1


def test_delta(spark):
    a = make(spark, ["aaa", "aab", "aac"], {1: ["-aab"], 2: ["+aad"], 3: ["+aae", "-aaa"]})
    assert dm(a, 0, 1) == {"-aab"} and dm(a, 0, 2) == {"-aab", "+aad"} and dm(a, 1, 3) == {"+aad", "+aae", "-aaa"}
    assert dm(a, 0, 2, offset=1) == {"+aad"} and dm(a, 0, 2, offset=2) == set() and dm(a, 2, 1) == dm(a, 2, 2) == set()
    assert [(x.s + x.p + x.o, x.versions) for x in make(spark, ["aaa", "aab", "aac"], {1: ["-aab"], 2: ["+aad"]}).vq(limit=10).collect()] == [("aaa", [0, 1, 2]), ("aab", [0]), ("aac", [0, 1, 2]), ("aad", [2])]


@pytest.mark.parametrize("snapshot", [0, 2, 4])
def test_toggled(spark, snapshot):
    a = make(spark, ["aaa"], {1: ["-aaa"], 2: ["+aaa"], 3: ["-aaa"], 4: ["+aaa"]}, snapshot)
    assert [dm(a, v, v + 1) for v in range(4)] == [{"-aaa"}, {"+aaa"}, {"-aaa"}, {"+aaa"}]
    assert dm(a, 0, 2) == dm(a, 1, 3) == set() and dm(a, 0, 3) == {"-aaa"}
    assert got(a.vq()) == [("a", "a", "a", [0, 2, 4])]
    local = [a.rebase(0).patch(v).first().is_local for v in range(1, 5)]
    assert local == [False, True, False, True]


def test_added_and_gone_again(spark):
    a = make(spark, ["bbb"], {1: ["+aaa"], 2: ["-aaa"]})
    p = TriplePattern("a")
    assert dm(a, 0, 2, p) == set() and dm(a, 0, 1, p) == {"+aaa"} and dm(a, 1, 2, p) == {"-aaa"}
    assert got(a.vq(p)) == [("a", "a", "a", [1])]


def test_both_signs_at_once(spark):
    with pytest.raises(ArchiveError):
        make(spark, [], {1: ["+aaa", "-aaa"]})


def histories():
    for seed in range(4):
        r = random.Random(seed)
        terms, n = "abcd", r.randrange(3, 9)
        every = [(s, p, o) for s in terms for p in "xy" for o in terms]
        states = [{t for t in every if r.random() < 0.4}]
        raw = []
        for v in range(1, n):
            change = {t: r.choice([1, -1]) for t in every if r.random() < 0.3}
            raw += [(v, *t, op) for t, op in change.items() for _ in range(r.choice([1, 1, 2]))]
            states.append((states[-1] | {t for t, op in change.items() if op > 0}) - {t for t, op in change.items() if op < 0})
        yield seed, states, raw


@pytest.mark.parametrize("seed,states,raw", list(histories()))
def test_against_independent_copies(spark, seed, states, raw):
    r, last = random.Random(seed + 100), len(states) - 1
    a = Archive.from_changes(in_memory(spark, sorted(states[0])), changes_in_memory(spark, raw), 0, last, r.randrange(last + 1))
    if seed % 2:
        a = a.rebase(r.randrange(last + 1), keep=True)
    assert a.log.groupBy("s", "p", "o").agg(F.max(F.abs("op")), F.abs(F.sum("op")).alias("n")).filter("n > 1").count() == 0
    log = {(x.version, x.s, x.p, x.o): x.op for x in a.log.collect()}
    assert log == {(v, *t): 1 if t in states[v] else -1 for v in range(1, last + 1) for t in states[v] ^ states[v - 1]}
    for pattern in (TriplePattern(), TriplePattern("a"), TriplePattern(p="x"), TriplePattern("b", None, "c"), TriplePattern("a", "x", "b")):
        fits = lambda t, pattern=pattern: all(t["spo".index(c)] == v for c, v in pattern.bound.items())
        at = [{t for t in s if fits(t)} for s in states]
        v, (x, y) = r.randrange(last + 1), sorted(r.sample(range(last + 1), 2))
        assert set(got(a.vm(v, pattern))) == at[v] and a.count_vm(v, pattern).first()[0] == len(at[v])
        change = {(*t, True) for t in at[y] - at[x]} | {(*t, False) for t in at[x] - at[y]}
        assert set(got(a.dm(x, y, pattern))) == change
        assert tuple(a.count_dm(x, y, pattern).first()) == (len(change), "EXACT") and a.count_dm(x, y, pattern, True).first()[0] >= len(change)
        ever = {t: [v for v in range(last + 1) if t in at[v]] for t in set().union(*at)}
        assert {tuple(q[:3]): q.versions for q in a.vq(pattern).collect()} == ever
        assert a.count_vq(pattern).first()[0] == len(ever) <= a.count_vq(pattern, True).first()[0]


def test_positions_and_cube(spark):
    a = make(spark, ["aaa", "aab", "aba", "bbb", "caa"], {1: ["-aaa", "-aab", "-bbb", "+zaa", "+zab", "+yaa"]})
    rows = {x.s + x.p + x.o: x for x in a.deletion_positions(1).collect()}
    assert rows["aab"].asDict() == {"s": "a", "p": "a", "o": "b", "pos_sp_": 1, "pos_s_o": 0, "pos_s__": 1, "pos__po": 0, "pos__p_": 1, "pos___o": 0, "pos____": 1}
    assert rows["bbb"].pos____ == 2 and rows["bbb"].pos___o == 1 and rows["aaa"].pos____ == 0
    cube = {x.s + x.p + x.o: x.n for x in a.pattern_counts(1).collect()}
    assert cube["???"] == 3 and cube["z??"] == 2 and cube["?aa"] == 2 and cube["za?"] == 2 and cube["z?b"] == 1 and not any("?" not in k for k in cube)
    assert {x.s + x.p + x.o for x in a.pattern_counts(1, 3).collect()} == {"???", "?a?"}


def test_membership_and_overlay(spark):
    a = make(spark, ["aaa"], {1: ["+bbb", "-aaa"]})
    asked = spark.createDataFrame([("a", "a", "a", 1), ("b", "b", "b", 1), ("c", "c", "c", 1)], "s string, p string, o string, op int")
    assert {x.s for x in a.contains(1, asked).collect()} == {"b"} and {x.s for x in a.contains(1, asked, False).collect()} == {"a", "b"}
    rows = spark.createDataFrame([("a", "a", "a", 1, 1), ("a", "a", "a", -1, 2), ("b", "b", "b", 1, 3)], "s string, p string, o string, op int, seq int")
    assert {(x.s, x.op) for x in overlay(rows).collect()} == {("a", -1), ("b", 1)}


def test_maintenance(spark):
    a = make(spark, ["aaa", "bbb"], {1: ["-aaa"], 2: ["+ccc"], 3: ["+aaa"]}, 3)
    assert vm(a.purge(2), 9) == {"bbb"} and a.purge(2).highest == 1
    b = PatchBuilder(a, spark).addition("d", "d", "d").deletion("b", "b", "b").deletion("n", "o", "t").commit(5)
    assert vm(b, 5) == {"aaa", "ccc", "ddd"} and vm(b, 4) == vm(a, 3) and b.log.filter("version = 5").count() == 2
    with pytest.raises(ArchiveError):
        PatchBuilder(a, spark).deletion("n", "o", "t").commit(5, strict=True)
    with pytest.raises(ArchiveError):
        PatchBuilder(a, spark).addition("x", "x", "x").commit(3)
    with pytest.raises(ArchiveError):
        PatchBuilder(None, spark).deletion("x", "x", "x")
    for bad in (lambda: a.rebase(7), lambda: a.purge(0)):
        with pytest.raises(ArchiveError):
            bad()
    first = PatchBuilder(None, spark).addition("x", "x", "x").addition("x", "x", "x").commit()
    assert vm(first, 0) == {"xxx"} and got(first.vq()) == [("x", "x", "x", [0])]


def test_routing():
    assert nearest_snapshot([0, 10], 5) == 0 and nearest_snapshot([0, 10], 6) == 10 and nearest_snapshot([4], 99) == 4
    assert clamp(-1, 0, 5) is None and clamp(9, 0, 5) == 5 and clamp(3, 0, 5) == 3


def test_pattern_reaches_the_scan(spark, tmp_path):
    a = make(spark, ["aaa", "abb"], {1: ["-aaa", "+acc"]})
    a.log.write.parquet(f"{tmp_path}/log")
    a.snapshots[0].write.parquet(f"{tmp_path}/snap")
    a = Archive({0: spark.read.parquet(f"{tmp_path}/snap")}, spark.read.parquet(f"{tmp_path}/log"), 0, 1)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = a.vm(1, TriplePattern(p="c"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) >= 2 and all(re.search(r"DataFilters: \[.*\(p#\d+ = c\)", line) for line in scans) and "PythonUDF" not in plan and "Arrow" not in plan


def test_the_log_is_shuffled_once(spark, tmp_path):
    a = make(spark, ["aaa", "abb"], {1: ["-aaa", "+acc"]})
    a.log.write.parquet(f"{tmp_path}/log")
    a.snapshots[0].write.parquet(f"{tmp_path}/snap")
    a = Archive({0: spark.read.parquet(f"{tmp_path}/snap")}, spark.read.parquet(f"{tmp_path}/log"), 0, 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = a.vm(1)
        assert {"".join(x) for x in df.collect()} == {"abb", "acc"}
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_versions_before_the_first(spark):
    a = make(spark, ["aaa", "aab"], {1: ["-aab"], 3: ["+ccc"]}, 2)
    for estimate in (False, True):
        assert tuple(a.count_dm(2, -1, estimate=estimate).first()) == (0, "EXACT")
    assert got(a.dm(2, -1)) == [] and got(a.patch(-5)) == [] and a.pattern_counts(-5).count() == 0 and a.deletion_positions(-5).count() == 0
    assert set(got(a.patch(99))) == set(got(a.patch(3))) and a.deletion_count(0).first()[0] == 0


def test_orders(spark):
    a = make(spark, ["bxz", "ayz", "cxy"], {1: ["+axx", "-cxy"]})
    assert got(a.vm(1, order="pos")) == [T("axx"), T("bxz"), T("ayz")] and got(a.vm(1, order="osp_reverse")) == [T("bxz"), T("ayz"), T("axx")]
    assert [x[:3] for x in got(a.dm(0, 1, order="reverse"))] == [T("cxy"), T("axx")]
    assert [x[:3] for x in got(a.vq(order="pos", limit=2))] == [T("axx"), T("cxy")]
    with pytest.raises(ArchiveError):
        a.vm(1, order="sop")


def test_positions_of_one_triple(spark):
    base = ["abc", "abd", "acc", "bbc", "bbd", "bcc"]
    a = make(spark, base, {1: [f"-{x}" for x in base]})
    every = {tuple(x[:3]): x for x in a.deletion_positions(1).collect()}
    for t in base:
        one = a.position_of(1, *T(t)).first()
        assert one.is_deletion and all(one[c] == every[T(t)][c] for c in one.asDict() if c.startswith("pos_"))
    gone = a.position_of(1, "a", "c", "a").first()
    assert not gone.is_deletion and gone.pos____ == 2 and gone.pos_s__ == 2 and gone.pos__p_ == 0
    assert [(x.s + x.p + x.o, x.position) for x in sorted(a.deletions_from(1, "a", "c", "c", TriplePattern(None, None, "c")).collect())] == [("acc", 1), ("bbc", 2), ("bcc", 3)]
    assert tuple(a.position_of_element(1, "b", "b", "c").first()) == (3, True) and tuple(a.position_of_element(1, "b", "b", "c", ("p",), False).first()) == (2, True)
    assert got(a.patch_from(1, "b", "b", "d").select("s", "p", "o")) == [T("bbd"), T("bcc")]


def test_patch_over_patch(spark):
    schema = "s string, p string, o string, is_addition boolean, is_local boolean"
    old = spark.createDataFrame([("a", "a", "a", True, False), ("b", "b", "b", True, False), ("c", "c", "c", False, True), ("d", "d", "d", True, False)], schema)
    new = spark.createDataFrame([("b", "b", "b", False, False), ("c", "c", "c", True, False), ("d", "d", "d", True, True), ("e", "e", "e", False, False)], schema)
    assert {(x[0], x[3], x[4]) for x in changes.join_patches(old, new).collect()} == {("a", True, False), ("b", False, True), ("c", True, False), ("d", True, True), ("e", False, False)}


def test_strict_appends(spark):
    a = make(spark, ["aaa", "aab"], {1: ["-aab"]})
    frame = lambda *rows: spark.createDataFrame([(*T(x[1:]), 1 if x[0] == "+" else -1) for x in rows], "s string, p string, o string, op int")
    assert vm(a.append(2, frame("+aab", "-aaa"), True), 2) == {"aab"}
    for bad in (["+aaa"], ["-aab"], ["+ccc", "+ccc"]):
        with pytest.raises(ArchiveError):
            a.append(2, frame(*bad), True)


def test_ranks_of_hot_groups_need_no_single_task(spark):
    rows = spark.range(5000).selectExpr("concat('http://x/', id) s", "'p' p", "if(id % 3 = 0, 'hot', concat('o', id % 11)) o")
    out = changes.positions(rows)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    got_ = sorted(map(tuple, out.select("s", "p", "o", "pos__p_", "pos___o", "pos____").collect()))
    seen = {}
    for i, (s, p, o, by_p, by_o, every) in enumerate(got_):
        assert by_p == every == i and by_o == seen.get(o, 0)
        seen[o] = seen.get(o, 0) + 1
