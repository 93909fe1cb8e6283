"""Queries on stored archives, on their files and on single operators, over the relational tables, and the SQL that must agree.

Each stores the events archive in a folder of its own, changes it as its name says, opens it again and asks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.archive import Archive, PatchBuilder
from palimpsest.functions.terms import decode, delta_text, dictionary, encode, insert_terms, terms, triple_hash, triple_line, versions_text
from palimpsest.model import TRIPLE, TriplePattern
from palimpsest.operators import changes
from palimpsest.sources.ntriples import changes_in_memory, in_memory, malformed_in, parse_lines, read_ntriples, read_versions, write_changeset, write_ntriples
from palimpsest.sources.store import Store
from palimpsest.streaming.ingest import ingest, ingest_latest
from palimpsest.workload import EVENTS, KIND, LAST, MIDDLE, ORDERS, ORDERS_LAST, PATTERNS, URGENT, _dm_sql, _net_sql, _step_sql, _versions, _vm_sql, _vq_sql, events_archive, events_presence, orders_archive

CLICK, EVERY = PATTERNS["o"], TriplePattern()
EXACT = "SELECT count(*) AS count, 'EXACT' AS estimation FROM ({})"


def folder(spark: SparkSession) -> str:
    """A new folder that all machines share."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def stored(spark: SparkSession, sf_dir: str, *snapshots: int, orders: tuple[str, ...] = ()) -> Store:
    first, *more = snapshots or (MIDDLE,)
    store = Store(spark, folder(spark)).create(events_archive(spark, sf_dir, first), orders)
    for v in more:
        store.snapshot(v)
    return store


def _two(s: SparkSession, d: str) -> Archive:
    return stored(s, d, 5, 22).open()


def _compacted(s: SparkSession, d: str) -> Archive:
    store = stored(s, d, orders=("pos", "osp"))
    store.compact()
    return store.open()


def _purged(s: SparkSession, d: str) -> Archive:
    store = stored(s, d)
    store.compact()
    store.purge(10)
    return store.open()


def _rebased(s: SparkSession, d: str) -> Archive:
    store = stored(s, d)
    store.rebase(4)
    return store.open()


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Deletes the clicks of the last version, and adds one triple."""
    gone = events_archive(s, d).vm(LAST, CLICK).withColumn("op", F.lit(-1))
    return gone.unionByName(s.createDataFrame([("new", "did", "appear", 1)], "s string, p string, o string, op int"))


def _appended(s: SparkSession, d: str) -> Archive:
    store = stored(s, d)
    store.append(LAST + 2, _raw(s, d), strict=True)
    return store.open()


def _appended_all(s: SparkSession, d: str) -> Archive:
    """The versions up to the tenth are stored; the rest come as one frame of raw changes."""
    whole = events_archive(s, d, 0)
    store = Store(s, folder(s)).create(whole.purge(11))
    store.append_all(whole.log)
    return store.open()


def _prepended(s: SparkSession, d: str) -> Archive:
    """Versions 10 to the last, then version 3 before these."""
    rows = events_presence(s, d)
    store = Store(s, folder(s)).create(Archive.from_presence(rows.filter("version >= 10"), 10, LAST, 15))
    old, new = (rows.filter(F.col("version") == v).select(*TRIPLE) for v in (3, 10))
    raw = old.join(new, TRIPLE, "left_anti").withColumn("op", F.lit(1)).unionByName(new.join(old, TRIPLE, "left_anti").withColumn("op", F.lit(-1)))
    store.prepend(3, raw)
    return store.open()


def _files(s: SparkSession, d: str) -> str:
    """A folder of versions in N-Triples: a snapshot of the first, changes of the rest."""
    whole, path = events_archive(s, d, 0), folder(s)
    write_changeset(whole.log, path)
    write_ntriples(whole.vm(0), f"{path}/0/main.nt.snapshot.txt")
    return path


def _streamed(s: SparkSession, d: str) -> Archive:
    """A file of changes is a batch, a batch a version."""
    whole, path = events_archive(s, d, 0), folder(s)
    store = Store(s, f"{path}/store").create(whole.purge(28))
    schema = "s string, p string, o string, op int"
    for v in (28, 29):
        whole.log.filter(F.col("version") == v).select(*TRIPLE, F.col("op").cast("int").alias("op")).coalesce(1).write.mode("append").parquet(f"{path}/in")
        ingest(store, s.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/progress", 28).awaitTermination()
    return store.open()


def _streamed_latest(s: SparkSession, d: str) -> Archive:
    """One batch deletes all clicks of the last version, then adds those of even users again."""
    path, click = folder(s), events_archive(s, d).vm(LAST, CLICK)
    store = Store(s, f"{path}/store").create(events_archive(s, d))
    even = F.substring("s", 2, 20).cast("long") % 2 == 0
    rows = click.withColumn("op", F.lit(-1)).withColumn("seq", F.lit(1)).unionByName(click.filter(even).withColumn("op", F.lit(1)).withColumn("seq", F.lit(2)))
    rows.coalesce(1).write.parquet(f"{path}/in")
    ingest_latest(store, s.readStream.schema("s string, p string, o string, op int, seq int").parquet(f"{path}/in"), f"{path}/progress", LAST + 1, "seq").awaitTermination()
    return store.open()


def _orders_two(s: SparkSession, d: str) -> Archive:
    store = Store(s, folder(s)).create(orders_archive(s, d, 1), ("pos",))
    store.snapshot(ORDERS_LAST)
    store.compact(4)
    return store.open()


def _lines(s: SparkSession, *args: object) -> DataFrame:
    return s.createDataFrame([(k, x) for k, x in enumerate(cli.run(s, list(map(str, args))))], "k long, line string")


def _broken(s: SparkSession, d: str) -> DataFrame:
    """Lines of version 22 as N-Triples, those of clicks without their end."""
    line = triple_line()
    return events_archive(s, d).vm(22).select(F.when(F.col("o") == KIND, F.substring_index(line, " ", 3)).otherwise(line).alias("value"))


def _shifted(signs: str) -> str:
    return f"SELECT s, p, o, arg_max(sign, k) AS op FROM ({signs}) GROUP BY s, p, o"


def _table() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
    for name, make in {"store": lambda s, d: stored(s, d).open(), "compacted": _compacted, "two_snapshots": _two, "rebased": _rebased}.items():
        q[f"{name}_vm"] = (lambda s, d, f=make: f(s, d).vm(22), _vm_sql(EVENTS, 22, EVERY))
        q[f"{name}_vm_o"] = (lambda s, d, f=make: f(s, d).vm(7, CLICK), _vm_sql(EVENTS, 7, CLICK))
        q[f"{name}_dm"] = (lambda s, d, f=make: f(s, d).dm(3, 26), _dm_sql(EVENTS, 3, 26, EVERY))
        q[f"{name}_vq"] = (lambda s, d, f=make: _versions(f(s, d).vq(CLICK)), _vq_sql(EVENTS, CLICK))
        q[f"{name}_count_vm"] = (lambda s, d, f=make: f(s, d).count_vm(22, CLICK), EXACT.format(_vm_sql(EVENTS, 22, CLICK)))
    q["two_snapshots_count_dm"] = (lambda s, d: _two(s, d).count_dm(3, 26), EXACT.format(_dm_sql(EVENTS, 3, 26, EVERY)))
    q["two_snapshots_vq_all"] = (lambda s, d: _versions(_two(s, d).vq()), _vq_sql(EVENTS, EVERY))
    q["two_snapshots_between"] = (lambda s, d: _two(s, d).vm(14), _vm_sql(EVENTS, 14, EVERY))
    q["two_snapshots_metadata"] = (lambda s, d: _two(s, d).describe().filter("is_snapshot").select("version"), "SELECT CAST(unnest([5, 22]) AS INTEGER) AS version")
    q["store_orders"] = (lambda s, d: _orders_two(s, d).vm(5, URGENT), _vm_sql(ORDERS, 5, URGENT))
    q["store_orders_dm"] = (lambda s, d: _orders_two(s, d).dm(0, 6, URGENT), _dm_sql(ORDERS, 0, 6, URGENT))
    q["store_purged"] = (lambda s, d: _versions(_purged(s, d).vq()), _vq_sql(EVENTS.replace("FROM events", "FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-11'"), EVERY))
    q["store_appended"] = (lambda s, d: _appended(s, d).vm(LAST + 2), f"WITH {EVENTS} SELECT s, p, o FROM a WHERE version = {LAST} AND o <> '{KIND}' UNION ALL SELECT 'new', 'did', 'appear'")
    q["store_appended_skips"] = (lambda s, d: _appended(s, d).vm(LAST + 1), _vm_sql(EVENTS, LAST, EVERY))
    q["store_appended_all"] = (lambda s, d: _versions(_appended_all(s, d).vq()), _vq_sql(EVENTS, EVERY))
    q["store_prepended"] = (lambda s, d: _prepended(s, d).dm(3, 20), _dm_sql(EVENTS, 3, 20, EVERY))
    q["store_prepended_skips"] = (lambda s, d: _prepended(s, d).vm(7), _vm_sql(EVENTS, 3, EVERY))
    q["store_copy"] = (lambda s, d: stored(s, d).copy_to(folder(s)).open().vm(7), _vm_sql(EVENTS, 7, EVERY))
    q["store_statistics"] = (lambda s, d: stored(s, d).statistics().select("version", "additions", "deletions", "triples", (F.col("bytes") > 0).alias("has_files")), f"{_step_sql()}, n AS (SELECT version, count(*) AS triples FROM a GROUP BY version) SELECT version, CAST(coalesce(sum(CASE WHEN op = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS additions, CAST(coalesce(sum(CASE WHEN op = -1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS deletions, any_value(triples) AS triples, version > 0 AS has_files FROM n LEFT JOIN t USING (version) GROUP BY version")
    q["stream"] = (lambda s, d: _streamed(s, d).vm(29), _vm_sql(EVENTS, 29, EVERY))
    q["stream_versions"] = (lambda s, d: _versions(_streamed(s, d).vq()), _vq_sql(EVENTS, EVERY))
    kept = f"CAST(substr(s, 2) AS BIGINT) % 2 = 0 OR o <> '{KIND}'"
    q["stream_latest"] = (lambda s, d: _streamed_latest(s, d).vm(LAST + 1), f"WITH {EVENTS} SELECT s, p, o FROM a WHERE version = {LAST} AND ({kept})")
    q["files_vq"] = (lambda s, d: _versions(Archive.from_folder(s, _files(s, d), 12).vq()), _vq_sql(EVENTS, EVERY))
    q["files_changes"] = (lambda s, d: read_versions(s, _files(s, d)).filter("kind <> 'snapshot'"), f"{_step_sql()} SELECT version, CASE WHEN op = 1 THEN 'addition' ELSE 'deletion' END AS kind, s, p, o FROM t")

    def lines_written(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        write_ntriples(events_archive(s, d).vm(22), path)
        return read_ntriples(s, path)

    q["ntriples_round_trip"] = (lines_written, _vm_sql(EVENTS, 22, EVERY))
    text = "concat('<', s, '> <', p, '> <', o, '> .')"
    q["ntriples_lines"] = (lambda s, d: events_archive(s, d).vm(22).select(triple_line().alias("line")), f"WITH {EVENTS} SELECT {text} AS line FROM a WHERE version = 22")
    q["ntriples_well_formed"] = (lambda s, d: parse_lines(_broken(s, d)).filter("not malformed").select(*TRIPLE), f"WITH {EVENTS} SELECT s, p, o FROM a WHERE version = 22 AND o <> '{KIND}'")
    q["ntriples_malformed"] = (lambda s, d: parse_lines(_broken(s, d)).filter("malformed").select("value"), f"WITH {EVENTS} SELECT concat('<', s, '> <', p, '> <', o, '>') AS value FROM a WHERE version = 22 AND o = '{KIND}'")

    def quarantined(s: SparkSession, d: str) -> DataFrame:
        path = folder(s)
        _broken(s, d).write.text(f"{path}/0/main.nt")
        return Archive.from_folder(s, path, skip_malformed=True).vm(0).withColumn("n_malformed", F.lit(malformed_in(s, path).count()).cast("long"))

    q["files_quarantine"] = (quarantined, f"WITH {EVENTS} SELECT s, p, o, (SELECT count(*) FROM a WHERE version = 22 AND o = '{KIND}') AS n_malformed FROM a WHERE version = 22 AND o <> '{KIND}'")
    q["delta_lines"] = (lambda s, d: events_archive(s, d).dm(7, 22).select(delta_text().alias("line")), f"SELECT concat(CASE WHEN is_addition THEN '+ ' ELSE '- ' END, s, ' ', p, ' ', o, ' .') AS line FROM ({_dm_sql(EVENTS, 7, 22, EVERY)})")
    q["versions_lines"] = (lambda s, d: events_archive(s, d).vq().select(versions_text().alias("line")), f"WITH {EVENTS} SELECT concat(s, ' ', p, ' ', o, ' . :: [ ', string_agg(CAST(version AS VARCHAR), ' ' ORDER BY version), ' ]') AS line FROM a GROUP BY s, p, o")
    q["triple_hashes"] = (lambda s, d: events_archive(s, d).vm(22).agg(F.count("*").alias("n"), F.countDistinct(triple_hash()).alias("hashes")), f"WITH {EVENTS} SELECT count(*) AS n, count(*) AS hashes FROM a WHERE version = 22")
    memory = [("a", "p", "b"), ("b", "p", "c"), ("a", "q", "c")]
    values = "(VALUES ('a', 'p', 'b'), ('b', 'p', 'c'), ('a', 'q', 'c')) v(s, p, o)"
    q["in_memory"] = (lambda s, d: Archive.from_changes(in_memory(s, memory[:2]), changes_in_memory(s, [(1, *memory[2], 1), (2, *memory[0], -1)]), 0, 2).vm(1), f"SELECT s, p, o FROM {values}")

    def built(s: SparkSession, d: str) -> DataFrame:
        made = PatchBuilder(events_archive(s, d), s).addition("x", "did", "new").addition("y", "did", "new").deletion("x", "did", "old")
        return made.commit().vm(LAST + 1)

    q["patch_builder"] = (built, f"WITH {EVENTS} SELECT s, p, o FROM a WHERE version = {LAST} UNION ALL SELECT 'x', 'did', 'new' UNION ALL SELECT 'y', 'did', 'new'")
    q["terms_shared"] = (lambda s, d: terms(events_presence(s, d).unionByName(events_presence(s, d).select("version", F.col("o").alias("s"), "p", F.lit("kind").alias("o"))), "shared"), f"WITH {EVENTS} SELECT DISTINCT o AS term FROM a")

    def encoded(s: SparkSession, d: str) -> DataFrame:
        log = events_archive(s, d).log
        numbers = dictionary(log)
        return decode(encode(log, numbers), numbers).select("version", *TRIPLE, F.col("op").cast("int").alias("op"))

    q["dictionary_round_trip"] = (encoded, f"{_step_sql()} SELECT version, s, p, o, op FROM t")
    role = lambda c, v: f"SELECT DISTINCT '{c}' AS role, {c} AS term, version = {v} AS early FROM a WHERE version IN (0, 1)"
    first = "UNION ALL".join(f" SELECT role, term, max(early) AS early FROM ({role(c, 0)}) GROUP BY role, term " for c in TRIPLE)
    q["dictionary_insert"] = (lambda s, d: insert_terms(dictionary(events_archive(s, d).vm(0)), events_archive(s, d).vm(1)), f"WITH {EVENTS}, x AS ({first}) SELECT role, term, row_number() OVER (PARTITION BY role ORDER BY NOT early, term) AS id FROM x")
    q["dictionary_encode"] = (lambda s, d: encode(events_archive(s, d).vm(22), dictionary(events_archive(s, d).vm(22))), f"WITH {EVENTS}, v AS (SELECT * FROM a WHERE version = 22) SELECT dense_rank() OVER (ORDER BY s) AS s, dense_rank() OVER (ORDER BY p) AS p, dense_rank() OVER (ORDER BY o) AS o FROM v")
    for name, order in (("pos", "p, o, s"), ("osp", "o, s, p")):
        q[f"vm_order_{name}"] = (lambda s, d, n=name: events_archive(s, d).vm(22, offset=30, limit=40, order=n), _vm_sql(EVENTS, 22, EVERY, f" ORDER BY {order} LIMIT 40 OFFSET 30"))
    q["dm_reverse_order"] = (lambda s, d: events_archive(s, d).dm(7, 22, offset=5, limit=30, order="reverse"), _dm_sql(EVENTS, 7, 22, EVERY) + " ORDER BY s DESC, p DESC, o DESC LIMIT 30 OFFSET 5")
    q["vq_reverse_order"] = (lambda s, d: _versions(events_archive(s, d).vq(offset=7, limit=20, order="pos_reverse")), _vq_sql(EVENTS, EVERY) + " ORDER BY p DESC, o DESC, s DESC LIMIT 20 OFFSET 7")
    q["deletion_count"] = (lambda s, d: events_archive(s, d).deletion_count(22, CLICK), f"{_net_sql(-1)} SELECT count(*) AS count FROM d WHERE o = '{KIND}'")
    before = "(s < 'u5' OR (s = 'u5' AND (p < 'did' OR (p = 'did' AND o < 'purchase'))))"
    at = {"s": "u5", "p": "did", "o": "purchase"}
    shapes = ", ".join(f"CAST(coalesce(sum(CASE WHEN {' AND '.join([before, *(f"{c} = '{at[c]}'" for c in b)])} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {changes.position_name(b)}" for b in changes.SHAPES)
    is_one = " AND ".join(f"{c} = '{v}'" for c, v in at.items())
    q["position_of_triple"] = (lambda s, d: events_archive(s, d).position_of(22, *at.values()), f"{_net_sql(-1)} SELECT {shapes}, coalesce(max({is_one}), false) AS is_deletion FROM d")
    q["deletions_from"] = (lambda s, d: events_archive(s, d).deletions_from(22, *at.values(), CLICK), f"{_net_sql(-1)}, r AS (SELECT s, p, o, row_number() OVER (ORDER BY s, p, o) - 1 AS position FROM d WHERE o = '{KIND}') SELECT * FROM r WHERE NOT {before}")
    patch = f"{_step_sql()}, l AS (SELECT s, p, o, sum(op) AS net, arg_max(op, version) AS last FROM t WHERE version > {MIDDLE} AND version <= 22 GROUP BY s, p, o), e AS (SELECT s, p, o, last > 0 AS is_addition, net = 0 AS is_local FROM l)"
    q["position_of_element"] = (lambda s, d: events_archive(s, d).position_of_element(22, *at.values(), ("o",), True), f"{patch} SELECT CAST(coalesce(sum(CASE WHEN {before} THEN 1 ELSE 0 END), 0) AS BIGINT) AS position, coalesce(max({is_one}), false) AS found FROM e WHERE o = 'purchase' AND is_addition")
    q["patch_from"] = (lambda s, d: events_archive(s, d).patch_from(22, *at.values()), f"{patch} SELECT * FROM e WHERE NOT {before}")
    old = patch.replace("<= 22", "<= 18")[len("WITH "):].replace("e AS", "eo AS").replace("l AS", "lo AS").replace("FROM l)", "FROM lo)")
    joined = f"{patch}, {old[old.index('lo AS'):]} SELECT coalesce(e.s, eo.s) AS s, coalesce(e.p, eo.p) AS p, coalesce(e.o, eo.o) AS o, coalesce(e.is_addition, eo.is_addition) AS is_addition, CASE WHEN e.s IS NULL THEN eo.is_local WHEN eo.s IS NOT NULL AND eo.is_addition <> e.is_addition THEN NOT eo.is_local ELSE e.is_local END AS is_local FROM e FULL JOIN eo ON e.s = eo.s AND e.p = eo.p AND e.o = eo.o"
    q["patch_over_patch"] = (lambda s, d: changes.join_patches(events_archive(s, d).patch(18), events_archive(s, d).patch(22)), joined)
    sets = "GROUPING SETS ((version, s, p), (version, s, o), (version, s), (version, p, o), (version, p), (version, o), (version), (s, p), (s, o), (s), (p, o), (p), (o), ())"
    q["pattern_counts_by_version"] = (lambda s, d: events_archive(s, d).pattern_counts_by_version(), f"{_step_sql()} SELECT version, coalesce(s, '?') AS s, coalesce(p, '?') AS p, coalesce(o, '?') AS o, count(*) AS n FROM t WHERE op = 1 GROUP BY {sets}")
    union = f"SELECT s, p, o, op AS sign, version AS k FROM t WHERE version <= 20"
    q["patch_union"] = (lambda s, d: changes.overlay(events_archive(s, d).log.filter("version <= 20").withColumn("op", F.col("op").cast("int")), "version"), f"{_step_sql()} {_shifted(union)}")

    def command_line(s: SparkSession, d: str) -> DataFrame:
        store = stored(s, d)
        return _lines(s, "vm", store.path, 22, "?", "?", KIND, 3, 20)

    listed = f"SELECT row_number() OVER (ORDER BY s, p, o) AS k, concat(s, ' ', p, ' ', o, ' .') AS line FROM a WHERE version = 22 AND o = '{KIND}' ORDER BY k LIMIT 20 OFFSET 3"
    q["command_line"] = (command_line, f"WITH {EVENTS}, l AS ({listed}) SELECT k - 3 AS k, line FROM l UNION ALL SELECT 0, concat('Count: ', count(*)) FROM a WHERE version = 22 AND o = '{KIND}'")
    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _table().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _table().items()}
