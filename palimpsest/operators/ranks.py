"""Numbering of sorted rows, in all or within groups, that no task holds as a whole.

Rows are range-partitioned and sorted; a row's number is its place in the partition after the rows of all partitions before, and within
a group that less the number of the group's first row. So a group may lie in many partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose first numbers may be broadcast, a row each.
BROADCAST_GROUPS = 100_000
_WITHIN = (1 << 33) - 1


def kept(df: DataFrame) -> DataFrame:
    """A frame that is evaluated once: checkpointed if there is a folder for it, else kept on the executors' disks."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.DISK_ONLY)


def ranked(rows: DataFrame, name: str, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Adds the number, from 0, of each row in this order within its group. Rows must differ in group and order together."""
    keys = [*group, *(c for c in order if c not in group)]
    placed = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    out = out.withColumn(name, (F.col("_id").bitwiseAND(F.lit(_WITHIN)) + F.col("_before")).cast("long")).drop("_id", "_part", "_before")
    if not group:
        return out
    first = kept(out.groupBy(*group).agg(F.min(name).alias("_first")))
    first = F.broadcast(first) if first.count() <= BROADCAST_GROUPS else first
    return out.join(first, list(group)).withColumn(name, F.col(name) - F.col("_first")).drop("_first").select(*rows.columns, name)
