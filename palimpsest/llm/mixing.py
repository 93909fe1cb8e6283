"""Mixing sources to target weights along a curriculum that varies with time.

Every source has a weight schedule: its share of the words read at each moment of training, a polyline over time 0 to 1. The
integral of a schedule up to a time is the source's demand by then, scaled so that it ends at the source's target. A source's
documents, repeated as often as its target asks, lie one after the other on that demand; inverting it gives each copy the
time at which training reaches it. Ranges of time make the output partitions.

Targets: all words are shared out by weight, but no source gets more than ``max_repeats`` times its own words, and what it
can't use goes to the rest by weight, until none is above its limit.

Everything runs on DataFrame functions. The order within a source is that of a digest of doc_id; prefix sums run within
buckets of that digest and over the buckets' totals, so no task holds a whole source.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; null and blank texts have size 0, are never taken and have no position.
Rows with equal doc_id are further ordered by size, equal ones are interchangeable; so are copies at equal positions, which doc_id
orders. A null source comes last. A document is taken at most ``max_repeats`` times. A long text counts by its words like any
other. An empty table gives an empty result. Columns named as outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import checkpoint, table

#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Schedules by the sources' order, repeating: shares at equal steps of time, straight in between. Even; early; late.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
#: Leading hexadecimal digits of the order's digest that make a bucket of prefix sums.
BUCKET_DIGITS = 3
SPACES = " \t\n\x0b\f\r"
ADDED = ("size", "source_size", "target", "taken", "positions")


def count_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.coalesce(F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target, slot (its place in the order of sources).

    With limits sorted by limit / weight, the first k sources reach theirs and the rest share what is left by weight; k is
    the smallest at which none of the rest is above its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("slot", (F.row_number().over(by_name) - 1).cast("int"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("slot") % len(weights) + 1).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("cap") / F.col("w"), "slot")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "slot", "level"))).over(every)["level"])
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"), "slot")


def _time_of(share: Column, schedule: Sequence[float]) -> Column:
    """The time by which a schedule has asked for this share of its target: the inverse of the schedule's integral."""
    steps = len(schedule) - 1
    if steps < 1 or min(schedule) < 0 or not any(schedule):
        raise ValueError("a schedule needs two or more shares, none negative, and one above 0")
    area = [(a + b) / 2 / steps for a, b in zip(schedule, schedule[1:], strict=False)]
    total, done, out = sum(area), 0.0, F.lit(1.0)
    pieces = []
    for k, (a, b) in enumerate(zip(schedule, schedule[1:], strict=False)):
        need = share * total - done  # a*x + (b-a)*steps/2*x*x = need for x in 0 to 1/steps
        slope = (b - a) * steps
        x = need / a if slope == 0 and a else (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * need)) - a) / slope if slope else F.lit(0.0)
        done += area[k]
        pieces.append((share * total <= done, F.lit(k / steps) + x))
    for test, value in reversed(pieces):
        out = F.when(test, value).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def assign(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """Adds to each document size, source_size, target, taken, and positions: the times at which training reaches its copies.

    Copy r of a document starts r source sizes after the document's own place in its source, and is taken if its middle lies
    within the target: the words taken then miss the target by half a document at most.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    return place(docs.select(*(docs[c] for c in kept), count_words(docs["text"]).alias("size")), weights, max_repeats, schedules)


def place(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: Sequence[Sequence[float]] = SCHEDULES) -> DataFrame:
    """As assign, of rows that have their size."""
    kept = [c for c in sized.columns if c not in ADDED]
    rows = sized.select(*kept, "size")
    rows = rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    parts = rows.groupBy(F.col("source").alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("size").alias("_part"))
    targets = source_targets(parts.select(F.col("_s").alias("source"), F.col("_part").alias("size")), weights, max_repeats)
    parts = parts.withColumn("_before", F.sum("_part").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_part"))
    parts = parts.join(targets.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t", "_part")
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_start", F.col("_before") + F.sum("size").over(within) - F.col("size"))
    starts = [F.col("_start") + r * F.col("source_size") for r in range(max_repeats)]
    times = [F.element_at(F.array(*(_time_of(s / F.nullif(F.col("target"), F.lit(0.0)), x) for x in schedules)), F.col("slot") % len(schedules) + 1) for s in starts]
    positions = F.array(*(F.when((F.col("size") > 0) & (s + F.col("size") / 2.0 <= F.col("target")), t) for s, t in zip(starts, times, strict=True)))
    rows = rows.withColumn("positions", F.array_compact(positions))
    return rows.withColumn("taken", F.col("size") * F.size("positions")).select(*kept, *ADDED)


def curriculum(assigned: DataFrame) -> DataFrame:
    """A row per copy that is taken, range-partitioned and sorted by position."""
    return assigned.withColumn("position", F.explode("positions")).drop("positions").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def by_position(assigned: DataFrame) -> DataFrame:
    """A row per document, range-partitioned and sorted by position, the time of its first copy; last_position is that of the last."""
    first, last = F.get("positions", F.lit(0)), F.get("positions", F.size("positions") - 1)
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return assigned.withColumns({"position": first, "last_position": last}).repartitionByRange(*keys).sortWithinPartitions(*keys)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # words are counted once; what follows reads a few bytes a document
    sized = checkpoint(docs.select("doc_id", "source", count_words(docs["text"]).alias("size")))
    return by_position(place(sized)).select("doc_id", "size", "source_size", "target", "taken", "position", "last_position")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS slot FROM d GROUP BY source),
w AS (SELECT *, CASE slot % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3 AS cap FROM s),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / w, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY cap / w, slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT level AS chosen FROM l WHERE level * w <= cap ORDER BY cap / w, slot LIMIT 1),
t AS (SELECT source, source_size, slot, least(CAST(cap AS DOUBLE), chosen * w) AS target FROM w, g),
c AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS start FROM d),
n AS (
  SELECT doc_id, size, source_size, target, slot, start, CASE WHEN size = 0 THEN 0 ELSE
    CASE WHEN start + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END
    + CASE WHEN start + source_size + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END
    + CASE WHEN start + 2 * source_size + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END END AS copies
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, CASE WHEN copies > 0 THEN CAST(start AS DOUBLE) / target END AS a, CASE WHEN copies > 0 THEN CAST(start + (copies - 1) * source_size AS DOUBLE) / target END AS b FROM n)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN least(1.0::DOUBLE, CASE slot % 3 WHEN 0 THEN a WHEN 1 THEN 1.5::DOUBLE - sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * a))
    ELSE sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * a)) - 0.5::DOUBLE END) END AS position,
  CASE WHEN copies > 0 THEN least(1.0::DOUBLE, CASE slot % 3 WHEN 0 THEN b WHEN 1 THEN 1.5::DOUBLE - sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * b))
    ELSE sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * b)) - 0.5::DOUBLE END) END AS last_position
FROM p
"""
