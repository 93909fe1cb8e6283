"""Archives derived from the relational tables, the queries on them, and the SQL that must agree.

events: a version per day, 0 to 29; (user, did, event type) holds on the days with such an event. orders: a version per year, 0 to 6;
(customer, priority, status) holds in the years with such an order. Queries answer from a snapshot in the middle and the steps
around it; the SQL compares independent copies of each version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.archive import Archive
from palimpsest.functions.terms import dictionary, dictionary_stats
from palimpsest.model import TRIPLE, TriplePattern
from palimpsest.operators import changes

MIDDLE, LAST = 15, 29
ORDERS_MIDDLE, ORDERS_LAST = 3, 6


def events_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.select(day.alias("version"), F.concat(F.lit("u"), F.col("user_id")).alias("s"), F.lit("did").alias("p"), F.col("event_type").alias("o")).filter(f"version between 0 and {LAST}").distinct()


def orders_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select((F.year("o_orderdate") - 1995).alias("version"), F.concat(F.lit("c"), F.col("o_custkey")).alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("o"))
    return rows.filter(f"version between 0 and {ORDERS_LAST}").distinct()


def events_archive(spark: SparkSession, sf_dir: str, snapshot: int = MIDDLE) -> Archive:
    return Archive.from_presence(events_presence(spark, sf_dir), 0, LAST, snapshot)


def orders_archive(spark: SparkSession, sf_dir: str, snapshot: int = ORDERS_MIDDLE) -> Archive:
    return Archive.from_presence(orders_presence(spark, sf_dir), 0, ORDERS_LAST, snapshot)


def lines_archive(spark: SparkSession, sf_dir: str, snapshot: int = 3) -> Archive:
    """lineitem: a version per year of shipping, 0 to 6; (order, part, flag) holds in the year of its line. Parts are many predicates."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = x.select((F.year("l_shipdate") - F.lit(1995)).alias("version"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("s"), F.concat(F.lit("part"), F.col("l_partkey")).alias("p"), F.col("l_returnflag").alias("o"))
    return Archive.from_presence(rows.filter("version between 0 and 6").distinct(), 0, 6, snapshot)


EVENTS = "a AS (SELECT DISTINCT CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS version, concat('u', user_id) AS s, 'did' AS p, event_type AS o FROM events)"
ORDERS = "a AS (SELECT DISTINCT CAST(year(o_orderdate) - 1995 AS INTEGER) AS version, concat('c', o_custkey) AS s, o_orderpriority AS p, o_orderstatus AS o FROM orders)"


def _where(pattern: TriplePattern) -> str:
    return "".join(f" AND {c} = '{v}'" for c, v in pattern.bound.items())


def _vm_sql(archive: str, version: int, pattern: TriplePattern, tail: str = "") -> str:
    return f"WITH {archive} SELECT s, p, o FROM a WHERE version = {version}{_where(pattern)}{tail}"


def _dm_sql(archive: str, start: int, end: int, pattern: TriplePattern) -> str:
    w = _where(pattern)
    side = lambda x, y, sign: f"SELECT s, p, o, {sign} AS is_addition FROM (SELECT s, p, o FROM a WHERE version = {x}{w} EXCEPT SELECT s, p, o FROM a WHERE version = {y}{w})"
    return f"WITH {archive} {side(end, start, 'true')} UNION ALL {side(start, end, 'false')}"


def _vq_sql(archive: str, pattern: TriplePattern) -> str:
    return f"WITH {archive} SELECT s, p, o, string_agg(CAST(version AS VARCHAR), ',' ORDER BY version) AS versions, count(*) AS n_versions FROM a WHERE true{_where(pattern)} GROUP BY s, p, o"


def _step_sql() -> str:
    """Both signs of every step of the events archive."""
    return (
        f"WITH {EVENTS}, t AS (SELECT version, s, p, o, 1 AS op FROM a WHERE version > 0 AND NOT EXISTS (SELECT 1 FROM a b WHERE b.version = a.version - 1 AND b.s = a.s AND b.p = a.p AND b.o = a.o)"
        f" UNION ALL SELECT version + 1, s, p, o, -1 FROM a WHERE version < {LAST} AND NOT EXISTS (SELECT 1 FROM a b WHERE b.version = a.version + 1 AND b.s = a.s AND b.p = a.p AND b.o = a.o))"
    )


def _net_sql(sign: int, version: int = 22) -> str:
    """Net additions (1) or deletions (-1) of a version against the middle snapshot, as table d."""
    x, y = (version, MIDDLE) if sign > 0 else (MIDDLE, version)
    return f"WITH {EVENTS}, d AS (SELECT s, p, o FROM a WHERE version = {x} EXCEPT SELECT s, p, o FROM a WHERE version = {y})"


def _versions(df: DataFrame) -> DataFrame:
    """Version lists as text, which every engine compares alike."""
    return df.select(*TRIPLE, F.array_join("versions", ",").alias("versions"), F.size("versions").cast("long").alias("n_versions"))


USER, DID, KIND = "u5", "did", "signup"
PATTERNS = {"spo": TriplePattern(USER, DID, KIND), "sp": TriplePattern(USER, DID), "s_o": TriplePattern(USER, None, KIND), "s": TriplePattern(USER), "po": TriplePattern(None, DID, KIND), "p": TriplePattern(None, DID), "o": TriplePattern(None, None, KIND), "all": TriplePattern()}
URGENT = TriplePattern(None, "1-URGENT")
_E, _O = events_archive, orders_archive


def _table() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
    all_, click = PATTERNS["all"], PATTERNS["o"]
    for name, v in (("snapshot", MIDDLE), ("forward", 22), ("backward", 7), ("first", 0), ("last", LAST)):
        q[f"vm_{name}"] = (lambda s, d, v=v: _E(s, d).vm(v), _vm_sql(EVENTS, v, all_))
    for name, x in PATTERNS.items():
        q[f"vm_{name}"] = (lambda s, d, x=x: _E(s, d).vm(22, x), _vm_sql(EVENTS, 22, x))
    q["vm_past_the_end"] = (lambda s, d: _E(s, d).vm(99), _vm_sql(EVENTS, LAST, all_))
    q["vm_before_the_first"] = (lambda s, d: _E(s, d).vm(-1), _vm_sql(EVENTS, -1, all_))
    q["vm_offset_limit"] = (lambda s, d: _E(s, d).vm(22, offset=20, limit=15), _vm_sql(EVENTS, 22, all_, " ORDER BY s, p, o LIMIT 15 OFFSET 20"))
    archive_order = f"WITH {EVENTS}, m AS (SELECT DISTINCT s, p, o, 0 AS k FROM a WHERE version = {MIDDLE}) SELECT a.s, a.p, a.o FROM a LEFT JOIN m USING (s, p, o) WHERE version = 22 ORDER BY coalesce(k, 1), s, p, o LIMIT 25 OFFSET 10"
    q["vm_archive_order"] = (lambda s, d: _E(s, d).vm(22, offset=10, limit=25, order="archive"), archive_order)
    for name, (a, b) in {"snapshot_patch": (15, 22), "patch_snapshot": (7, 15), "forward": (18, 26), "reverse": (3, 9), "across": (7, 22)}.items():
        q[f"dm_{name}"] = (lambda s, d, a=a, b=b: _E(s, d).dm(a, b), _dm_sql(EVENTS, a, b, all_))
    q["dm_pattern"] = (lambda s, d: _E(s, d).dm(7, 22, click), _dm_sql(EVENTS, 7, 22, click))
    q["dm_empty"] = (lambda s, d: _E(s, d).dm(22, 7), _dm_sql(EVENTS, 7, 7, all_))
    q["dm_offset_limit"] = (lambda s, d: _E(s, d).dm(7, 22, offset=5, limit=30), _dm_sql(EVENTS, 7, 22, all_) + " ORDER BY s, p, o LIMIT 30 OFFSET 5")
    q["vq_all"] = (lambda s, d: _versions(_E(s, d).vq()), _vq_sql(EVENTS, all_))
    q["vq_pattern"] = (lambda s, d: _versions(_E(s, d).vq(click)), _vq_sql(EVENTS, click))
    q["vq_offset_limit"] = (lambda s, d: _versions(_E(s, d).vq(offset=7, limit=20)), _vq_sql(EVENTS, all_) + " ORDER BY s, p, o LIMIT 20 OFFSET 7")
    exact = "SELECT count(*) AS count, 'EXACT' AS estimation FROM ({})"
    q["count_vm"] = (lambda s, d: _E(s, d).count_vm(22, click), exact.format(_vm_sql(EVENTS, 22, click)))
    q["count_vm_snapshot"] = (lambda s, d: _E(s, d).count_vm(MIDDLE), exact.format(_vm_sql(EVENTS, MIDDLE, all_)))
    q["count_dm"] = (lambda s, d: _E(s, d).count_dm(7, 22), exact.format(_dm_sql(EVENTS, 7, 22, all_)))
    both = f"SELECT CAST(sum(n) AS BIGINT) AS count, 'UP_TO' AS estimation FROM (SELECT count(*) AS n FROM ({_dm_sql(EVENTS, 7, MIDDLE, all_)}) UNION ALL SELECT count(*) FROM ({_dm_sql(EVENTS, MIDDLE, 22, all_)}))"
    q["count_dm_estimate"] = (lambda s, d: _E(s, d).count_dm(7, 22, estimate=True), both)
    q["count_vq"] = (lambda s, d: _E(s, d).count_vq(), exact.format(_vq_sql(EVENTS, all_)))
    upper = f"{_step_sql()} SELECT (SELECT count(*) FROM a WHERE version = {MIDDLE}) + (SELECT count(*) FROM t) AS count, 'UP_TO' AS estimation"
    q["count_vq_estimate"] = (lambda s, d: _E(s, d).count_vq(estimate=True), upper)
    cube = f"{_net_sql(1)} SELECT coalesce(s, '?') AS s, coalesce(p, '?') AS p, coalesce(o, '?') AS o, count(*) AS n FROM d GROUP BY GROUPING SETS ((s, p), (s, o), (s), (p, o), (p), (o), ())"
    q["pattern_cube_counts"] = (lambda s, d: _E(s, d).pattern_counts(22), cube)
    q["pattern_cube_threshold"] = (lambda s, d: _E(s, d).pattern_counts(22, 10), f"SELECT * FROM ({cube}) WHERE n >= 10")
    ranks = ", ".join(f"row_number() OVER ({f'PARTITION BY {", ".join(b)} ' if b else ''}ORDER BY s, p, o) - 1 AS pos_{''.join(c if c in b else '_' for c in TRIPLE)}" for b in changes.SHAPES)
    q["deletion_positions"] = (lambda s, d: _E(s, d).deletion_positions(22), f"{_net_sql(-1)} SELECT s, p, o, {ranks} FROM d")
    q["changeset"] = (lambda s, d: _E(s, d).log.withColumn("op", F.col("op").cast("int")), f"{_step_sql()} SELECT version, s, p, o, op FROM t")
    q["step_sizes"] = (lambda s, d: _E(s, d).sizes(), f"{_step_sql()} SELECT version, CAST(sum(CASE WHEN op = 1 THEN 1 ELSE 0 END) AS BIGINT) AS additions, CAST(sum(CASE WHEN op = -1 THEN 1 ELSE 0 END) AS BIGINT) AS deletions FROM t GROUP BY version")
    q["rebase"] = (lambda s, d: _E(s, d).rebase(4).vm(22, click), _vm_sql(EVENTS, 22, click))
    q["purge"] = (lambda s, d: _E(s, d).purge(20).vm(25), _vm_sql(EVENTS, 19, all_))
    q["purge_below_snapshot"] = (lambda s, d: _versions(_E(s, d).purge(10).vq()), f"WITH {EVENTS} SELECT s, p, o, string_agg(CAST(version AS VARCHAR), ',' ORDER BY version) AS versions, count(*) AS n_versions FROM a WHERE version < 10 GROUP BY s, p, o")

    def appended(s: SparkSession, d: str) -> DataFrame:
        """Deletes the clicks of the last version, and adds one triple."""
        archive = _E(s, d)
        gone = archive.vm(LAST, click).withColumn("op", F.lit(-1).cast("tinyint"))
        new = s.createDataFrame([("new", "did", "appear", 1)], "s string, p string, o string, op tinyint")
        return archive.append(LAST + 2, gone.unionByName(new)).vm(LAST + 2)

    q["append"] = (appended, f"WITH {EVENTS} SELECT s, p, o FROM a WHERE version = {LAST} AND o <> '{KIND}' UNION ALL SELECT 'new', 'did', 'appear'")

    def ingested(s: SparkSession, d: str) -> DataFrame:
        """From raw changes with repeats and without effect: every version adds all that holds and deletes all that doesn't any more."""
        rows = events_presence(s, d)
        gone = rows.withColumn("version", F.col("version") + 1).filter(f"version <= {LAST}").join(rows, ["version", *TRIPLE], "left_anti")
        later = gone.withColumn("version", F.explode(F.array("version", "version")))
        raw = rows.withColumn("op", F.lit(1)).unionByName(later.withColumn("op", F.lit(-1)))
        return Archive.from_changes(rows.filter("version = 0"), raw, 0, LAST).log.withColumn("op", F.col("op").cast("int"))

    q["normalise"] = (ingested, f"{_step_sql()} SELECT version, s, p, o, op FROM t")
    q["contains"] = (lambda s, d: _E(s, d).contains(8, _E(s, d).vm(8).withColumn("op", F.lit(1))).select(*TRIPLE), f"{_step_sql()} SELECT s, p, o FROM t WHERE version = 8 AND op = 1")
    q["contains_untyped"] = (lambda s, d: _E(s, d).contains(8, _E(s, d).vm(7), False), f"{_step_sql()} SELECT s, p, o FROM t WHERE version = 8 AND op = -1")
    patch = f"{_step_sql()}, l AS (SELECT s, p, o, sum(op) AS net, arg_max(op, version) AS last FROM t WHERE version > {MIDDLE} AND version <= 22 GROUP BY s, p, o) SELECT s, p, o, last > 0 AS is_addition, net = 0 AS is_local FROM l"
    q["patch_reconstruct"] = (lambda s, d: _E(s, d).patch(22), patch)
    back = f"{_step_sql()}, l AS (SELECT s, p, o, sum(op) AS net, arg_min(op, version) AS last FROM t WHERE version > 7 AND version <= {MIDDLE} GROUP BY s, p, o) SELECT s, p, o, last < 0 AS is_addition, net = 0 AS is_local FROM l"
    q["patch_reconstruct_reverse"] = (lambda s, d: _E(s, d).patch(7), back)
    stats = f"WITH {EVENTS} SELECT count(DISTINCT s) AS n_subjects, count(DISTINCT p) AS n_predicates, count(DISTINCT o) AS n_objects, (SELECT count(*) FROM (SELECT s FROM a INTERSECT SELECT o FROM a)) AS n_shared FROM a"
    q["dictionary_stats"] = (lambda s, d: dictionary_stats(events_presence(s, d)), stats)
    numbers = f"WITH {EVENTS}, x AS (SELECT DISTINCT 's' AS role, s AS term FROM a UNION ALL SELECT DISTINCT 'p', p FROM a UNION ALL SELECT DISTINCT 'o', o FROM a) SELECT role, term, row_number() OVER (PARTITION BY role ORDER BY term) AS id FROM x"
    q["dictionary"] = (lambda s, d: dictionary(events_presence(s, d)), numbers)
    q["orders_vm"] = (lambda s, d: _O(s, d).vm(5, URGENT), _vm_sql(ORDERS, 5, URGENT))
    q["orders_dm"] = (lambda s, d: _O(s, d).dm(1, 5, URGENT), _dm_sql(ORDERS, 1, 5, URGENT))
    q["orders_vq"] = (lambda s, d: _versions(_O(s, d).vq(URGENT)), _vq_sql(ORDERS, URGENT))
    q["orders_count_vm"] = (lambda s, d: _O(s, d).count_vm(1), exact.format(_vm_sql(ORDERS, 1, all_)))
    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _table().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _table().items()}
