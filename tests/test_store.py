import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.archive import Archive
from palimpsest.functions.terms import bracketed, dictionary, dictionary_stats, terms, triple_hash, triple_line
from palimpsest.model import TRIPLE, ArchiveError, TriplePattern
from palimpsest.sources.ntriples import in_memory, malformed_lines, read_ntriples, write_changeset, write_ntriples
from palimpsest.sources.store import Store
from palimpsest.streaming.ingest import ingest, ingest_latest

#: A seven-version fixture: additions, deletions and state of each; n stands for the triple n n n.
STEPS = [("", "", "26"), ("1", "2", "16"), ("34", "1", "346"), ("57", "3", "4567"), ("1", "", "14567"), ("2", "5", "12467"), ("58", "12", "45678")]


@pytest.fixture
def folder(tmp_path):
    line = lambda n: f"<{n}> <{n}> <{n}> .\n"
    for v, (up, down, state) in enumerate(STEPS):
        d = tmp_path / "nt" / str(v)
        d.mkdir(parents=True)
        for name, ns in (("additions", up), ("deletions", down), ("snapshot", state if v in (0, 3, 4, 5, 6) else "")):
            if ns:
                (d / f"main.nt.{name}.txt").write_text("".join(map(line, ns)))
    return str(tmp_path / "nt")


def state(a, v):
    return "".join(sorted(x.s for x in a.vm(v).collect()))


@pytest.mark.parametrize("snapshot", [None, 3, 6])
def test_folder_of_versions(spark, folder, snapshot):
    a = Archive.from_folder(spark, folder, snapshot)
    assert [state(a, v) for v in range(7)] == [s for _, _, s in STEPS]
    assert {x.s: x.versions for x in a.vq().collect()} == {str(n): [v for v, s in enumerate(STEPS) if str(n) in s[2]] for n in range(1, 9)}
    assert sorted(("+" if x.is_addition else "-") + x.s for x in a.dm(0, 6).collect()) == ["+4", "+5", "+7", "+8", "-2"]


def test_ntriples(spark, tmp_path):
    lines = ['<http://a> <http://p> "x \\" . y"@en .', "_:b <p> _:c.", "# comment", "", '<s> <p> "1"^^<int> . # after', "<s> <p> .", "no triple", "<s> <p> <o>", '  <s>\t<p> "é" .  ']
    (tmp_path / "f.nt").write_text("\n".join(lines))
    good = {tuple(x) for x in read_ntriples(spark, f"{tmp_path}/f.nt").collect()}
    assert good == {("http://a", "http://p", '"x \\" . y"@en'), ("_:b", "p", "_:c"), ("s", "p", '"1"^^<int>'), ("s", "p", '"é"')}
    assert {x.value for x in malformed_lines(spark, f"{tmp_path}/f.nt").collect()} == {"<s> <p> .", "no triple", "<s> <p> <o>"}
    write_ntriples(read_ntriples(spark, f"{tmp_path}/f.nt"), f"{tmp_path}/out")
    assert {tuple(x) for x in read_ntriples(spark, f"{tmp_path}/out").collect()} == good
    t = in_memory(spark, [("http://a", "p", '"l"')])
    assert t.select(triple_line(True)).first()[0] == '<http://a> p "l" .' and t.select(bracketed(t.p)).first()[0] == "<p>"


def test_changeset_round_trip(spark, folder, tmp_path):
    a = Archive.from_folder(spark, folder, 3)
    write_changeset(a.log, f"{tmp_path}/cs")
    (tmp_path / "cs" / "0").mkdir()
    (tmp_path / "cs" / "0" / "main.nt.snapshot.txt").write_text("<2> <2> <2> .\n<6> <6> <6> .\n")
    b = Archive.from_folder(spark, f"{tmp_path}/cs")
    assert sorted(map(tuple, a.log.collect())) == sorted(map(tuple, b.log.collect()))


def test_store(spark, folder, tmp_path):
    store = Store(spark, f"{tmp_path}/store").create(Archive.from_folder(spark, folder, 3))
    with pytest.raises(ArchiveError):
        store.create(store.open())
    with pytest.raises(ArchiveError):
        Store(spark, f"{tmp_path}/none").open()
    check = lambda: [state(store.open(), v) for v in range(7)] == [s for _, _, s in STEPS]
    assert check()
    store.snapshot(6)
    assert list(store.open().snapshots) == [3, 6] and check()
    store.rebase(1)
    assert list(store.open().snapshots) == [1] and check()
    raw = spark.createDataFrame([("9", "9", "9", 1), ("4", "4", "4", -1)], "s string, p string, o string, op int")
    store.append(8, raw)
    assert state(store.open(), 8) == "56789" and state(store.open(), 7) == "45678"
    store.purge(7)
    assert check() and store.open().highest == 6
    store.append(7, raw.limit(1))
    assert state(store.open(), 8) == state(store.open(), 7) == "456789"
    copy = store.copy_to(f"{tmp_path}/copy").open()
    assert state(copy, 7) == "456789" and state(copy, 0) == "26"
    later = spark.createDataFrame([(8, "a", "a", "a", 1), (10, "a", "a", "a", -1), (10, "a", "a", "a", -1), (3, "z", "z", "z", 1)], "version int, s string, p string, o string, op int")
    store.append_all(later)
    assert [state(store.open(), v) for v in (3, 8, 9, 10)] == ["4567", "456789a", "456789a", "456789"]
    plan = store.open().dm(4, 6)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan


def test_compaction(spark, folder, tmp_path):
    store = Store(spark, f"{tmp_path}/store").create(Archive.from_folder(spark, folder, 3))
    check = lambda n=7: [state(store.open(), v) for v in range(n)] == [s for _, _, s in STEPS][:n]
    for upto in (4, None, 2):
        store.compact(upto)
        assert check() and sorted(map(tuple, store.open().log.collect())) == sorted(map(tuple, Archive.from_folder(spark, folder).log.collect()))
    store.compact()
    store.purge(5)
    assert check(5) and store.open().highest == 4
    store.append(5, spark.createDataFrame([("2", "2", "2", 1), ("5", "5", "5", -1)], "s string, p string, o string, op int"))
    store.append(6, spark.createDataFrame([("q", "q", "q", 1)], "s string, p string, o string, op int"))
    assert check(6) and state(store.open(), 6) == "12467q"
    rows = store.open().describe().orderBy("version").collect()
    assert [x.triples for x in rows] == [2, 2, 3, 4, 5, 5, 6] and [x.version for x in rows if x.is_snapshot] == [3] and rows[5].deletions == 1
    assert [x.s for x in store.open().vm(6, limit=2, order="reverse").collect()] == ["q", "7"]


def test_purge_below_the_snapshot(spark, folder, tmp_path):
    store = Store(spark, f"{tmp_path}/store").create(Archive.from_folder(spark, folder, 5))
    store.purge(3)
    assert [state(store.open(), v) for v in range(4)] == ["26", "16", "346", "346"]


def test_streams(spark, tmp_path, folder):
    store = Store(spark, f"{tmp_path}/store").create(Archive.from_folder(spark, folder))
    source, schema = f"{tmp_path}/in", "s string, p string, o string, op int, seq int"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put(("a", "a", "a", 1, 1), ("6", "6", "6", -1, 1))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(store, stream(), f"{tmp_path}/cp", 7).awaitTermination()
    assert state(store.open(), 7) == "4578a"
    put(("a", "a", "a", -1, 1))
    ingest(store, stream(), f"{tmp_path}/cp", 7).awaitTermination()
    assert state(store.open(), 8) == "4578" and state(store.open(), 7) == "4578a" and store.open().highest == 8
    ingest(store, stream(), f"{tmp_path}/other", 7).awaitTermination()  # versions that exist are left alone
    assert state(store.open(), 8) == "4578" and store.open().highest == 8
    put(("b", "b", "b", 1, 1), ("b", "b", "b", -1, 2), ("c", "c", "c", 1, 3))
    ingest_latest(store, stream(), f"{tmp_path}/third", 7, "seq").awaitTermination()
    assert state(store.open(), 9) == "4578c"


def test_command_line(spark, folder, tmp_path):
    run = lambda *args: list(cli.run(spark, list(map(str, args))))
    path = f"{tmp_path}/store"
    assert run("ingest", path, folder, 3) == []
    assert run("vm", path, 5, "?", "?", "?", 1, 2) == ["Count: 5", "2 2 2 .", "4 4 4 ."]
    assert run("vm", path, 5, "<4>", "?", "") == ["Count: 1", "4 4 4 ."]
    assert run("dm", path, 1, 5, "?", "?", "?", 0, -2)[0] == "Count: 7 (UP_TO)" and sorted(run("dm", path, 1, 5, "?", "?", "?")[1:]) == ["+ 2 2 2 .", "+ 4 4 4 .", "+ 7 7 7 ."]
    assert run("vq", path, "1", "?", "?")[1:] == ["1 1 1 . :: [ 1 4 5 ]"]
    run("rebase", path, 6), run("copy", path, f"{tmp_path}/copy"), run("changeset", path, f"{tmp_path}/cs")
    assert run("vm", f"{tmp_path}/copy", 0, "?", "?", "?", 0) and (tmp_path / "cs" / "5" / "main.nt.deletions.txt").exists()
    with pytest.raises(SystemExit):
        run("what", path)


def test_terms(spark):
    t = in_memory(spark, [("a", "p", "b"), ("b", "p", "c"), ("b", "q", "a")])
    assert tuple(dictionary_stats(t).first()) == (2, 2, 3, 2)
    assert tuple(dictionary_stats(t.limit(0)).first()) == (0, 0, 0, 0)
    assert {(x.role, x.term): x.id for x in dictionary(t).collect()} == {("s", "a"): 1, ("s", "b"): 2, ("p", "p"): 1, ("p", "q"): 2, ("o", "a"): 1, ("o", "b"): 2, ("o", "c"): 3}
    assert {x.term for x in terms(t, "shared").collect()} == {"a", "b"} and terms(t, "p").count() == 2
    assert t.select(triple_hash()).distinct().count() == 3 and TRIPLE == ["s", "p", "o"]
    assert TriplePattern.parse("?", "<http://x>", '"l"') == TriplePattern(None, "http://x", '"l"')


def test_purge_of_compacted_steps_below_the_snapshot(spark, folder, tmp_path):
    store = Store(spark, f"{tmp_path}/store").create(Archive.from_folder(spark, folder, 5), ["pos", "osp"])
    store.compact()
    store.purge(3)
    assert [state(store.open(), v) for v in range(4)] == ["26", "16", "346", "346"] and list(store.open().snapshots) == [2]
    assert {x.s for x in store.open().vm(1, TriplePattern(None, "6")).collect()} == {"6"}


@pytest.mark.parametrize("compacted", [False, True])
def test_versions_before_the_first(spark, folder, tmp_path, compacted):
    raw = spark.createDataFrame([("2", "2", "2", -1), ("x", "x", "x", 1), ("6", "6", "6", 1), ("6", "6", "6", 1)], "s string, p string, o string, op int")
    store = Store(spark, f"{tmp_path}/store").create(Archive.from_folder(spark, folder, 3))
    if compacted:
        store.compact()
    store.prepend(-2, raw)
    a = store.open()
    assert (a.lowest, a.highest) == (-2, 6) and [state(a, v) for v in range(-2, 3)] == ["6x", "6x", "26", "16", "346"]
    assert sorted(("+" if x.is_addition else "-") + x.s for x in a.dm(-2, 0).collect()) == ["+2", "-x"]
    assert {x.s: x.versions for x in a.vq().collect()}["6"] == [-2, -1, 0, 1, 2, 3, 4, 5, 6]
    with pytest.raises(ArchiveError):
        a.prepend(-2, raw)


def test_copies_in_other_orders(spark, tmp_path):
    """A pattern without a subject reads files of which statistics leave few row groups."""
    log = spark.range(4000).selectExpr("cast(1 + id % 5 as int) version", "concat('s', id) s", "concat('p', id % 400) p", "concat('o', id % 37) o", "cast(1 as tinyint) op")
    base = spark.range(4000, 8000).selectExpr("concat('s', id) s", "concat('p', id % 400) p", "concat('o', id % 37) o")
    a = Archive.from_changes(base, log, 0, 5)
    store = Store(spark, f"{tmp_path}/store").create(a, ["pos", "osp"])
    store.compact()
    b = store.open()
    for pattern in (TriplePattern(None, "p7"), TriplePattern(None, None, "o5"), TriplePattern("s7", None, "o7"), TriplePattern(None, "p7", "o7"), TriplePattern("s7")):
        assert sorted(map(tuple, b.vm(4, pattern).collect())) == sorted(map(tuple, a.vm(4, pattern).collect()))
        assert sorted(map(tuple, b.dm(1, 4, pattern).collect())) == sorted(map(tuple, a.dm(1, 4, pattern).collect()))
        assert sorted(map(str, b.vq(pattern).collect())) == sorted(map(str, a.vq(pattern).collect()))
        assert b.count_vm(4, pattern).first() == a.count_vm(4, pattern).first() and b.count_dm(1, 4, pattern).first() == a.count_dm(1, 4, pattern).first() and b.count_vq(pattern).first() == a.count_vq(pattern).first()
    for pattern, place in ((TriplePattern(None, "p7"), "_pos/"), (TriplePattern(None, None, "o5"), "_osp/")):
        assert {("snapshot" + place in f, "compact" + place in f) for f in b.vm(4, pattern).inputFiles()} == {(True, False), (False, True)}
    assert "EqualTo(p,p7)" in b.vm(4, TriplePattern(None, "p7"))._jdf.queryExecution().executedPlan().toString()
    # each file of the copy holds a range of predicates of its own
    files = spark.read.parquet(f"{tmp_path}/store/snapshot_pos/version=0").selectExpr("_metadata.file_path f", "p").groupBy("f").agg(F.min("p").alias("a"), F.max("p").alias("b")).orderBy("a").collect()
    assert files and all(x.b <= y.a for x, y in zip(files, files[1:], strict=False))
    rows = store.statistics().orderBy("version").collect()
    assert [x.version for x in rows] == list(range(6)) and rows[0].bytes > 0 and [x.additions for x in rows] == [0, *[800] * 5]
    with pytest.raises(ArchiveError):
        Store(spark, f"{tmp_path}/other").create(a, ["sop"])


def test_malformed_lines_are_refused(spark, folder, tmp_path):
    from palimpsest.sources.ntriples import malformed_in

    (tmp_path / "nt" / "2" / "main.nt.additions.txt").write_text("<3> <3> <3> .\nnot a triple\n<4> <4> <4> .\n<4> <4> .\n")
    with pytest.raises(ArchiveError, match="2 lines"):
        Archive.from_folder(spark, folder)
    assert state(Archive.from_folder(spark, folder, skip_malformed=True), 2) == "346"
    assert {(x.version, x.kind, x.value) for x in malformed_in(spark, folder).collect()} == {(2, "addition", "not a triple"), (2, "addition", "<4> <4> .")}


def test_escapes(spark, tmp_path):
    lines = [r'<a> <p> "caf\u00e9 \U0001F600 \"q\" \\u0041 \n" .', r"<\u0041> <p> <\U00000042> .", "<a> <p> <x\u0001y> ."]
    (tmp_path / "f.nt").write_text("\n".join(lines))
    got = {tuple(x) for x in read_ntriples(spark, f"{tmp_path}/f.nt").collect()}
    assert got == {("a", "p", r'"café 😀 \"q\" \\u0041 \n"'), ("A", "p", "B")} and malformed_lines(spark, f"{tmp_path}/f.nt").count() == 1


def test_changing_commands(spark, folder, tmp_path):
    run = lambda *args: list(cli.run(spark, list(map(str, args))))
    path, more = f"{tmp_path}/store", tmp_path / "more"
    for v, name, n in ((8, "additions", 9), (8, "deletions", 4), (-1, "additions", 7)):
        (more / str(v)).mkdir(parents=True, exist_ok=True)
        (more / str(v) / f"main.nt.{name}.txt").write_text(f"<{n}> <{n}> <{n}> .\n")
    run("ingest", path, folder, 3), run("append", path, 8, more), run("compact", path), run("snapshot", path, 6)
    assert state(Store(spark, path).open(), 8) == "56789" and list(Store(spark, path).open().snapshots) == [3, 6]
    run("purge", path, 7)
    lines = run("describe", path)
    assert len(lines) == 7 and lines[3].endswith("snapshot") and lines[1].startswith("1 +1 -1 2 ")


def test_term_numbers(spark):
    from palimpsest.functions.terms import decode, encode, insert_terms

    t = in_memory(spark, [("http://a", "p", "b"), ("http://b", "p", "c")])
    numbers = dictionary(t)
    more = insert_terms(numbers, in_memory(spark, [("http://0", "q", "c"), ("http://z", "p", "a")]))
    assert {(x.role, x.term): x.id for x in more.collect()} == {("s", "http://a"): 1, ("s", "http://b"): 2, ("s", "http://0"): 3, ("s", "http://z"): 4, ("p", "p"): 1, ("p", "q"): 2, ("o", "b"): 1, ("o", "c"): 2, ("o", "a"): 3}
    assert {tuple(x) for x in decode(encode(t, numbers), more).select(*TRIPLE).collect()} == {tuple(x) for x in t.collect()}
    assert encode(in_memory(spark, [("none", "p", "b")]), numbers).select(*TRIPLE).first()[:] == (None, 1, 1)
