"""The three queries of an archive: what held at a version, what changed between two, and when each triple held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import EVERYTHING, TRIPLE, ArchiveError, TriplePattern
from palimpsest.operators.changes import change_from, net


def materialize(snapshot: DataFrame, log: DataFrame, at: int, version: int, pattern: TriplePattern = EVERYTHING, section: bool = False) -> DataFrame:
    """Triples at a version, from a snapshot at another: less the net deletions, with the net additions.

    :param section: adds a column, 0 for what the snapshot has and 1 for additions
    """
    snapshot = pattern.filter(snapshot.select(*TRIPLE))
    mark = lambda df, k: df.select(*TRIPLE, F.lit(k).alias("section")) if section else df.select(*TRIPLE)
    if at == version:
        return mark(snapshot, 0)
    change = change_from(log, at, version, pattern)
    return mark(snapshot.join(change.filter("net < 0"), TRIPLE, "left_anti"), 0).unionByName(mark(change.filter("net > 0"), 1))


def delta(log: DataFrame, start: int, end: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
    """(s, p, o, is_addition): how the state at end differs from that at start; nothing unless start is before end."""
    return net(log, start, max(start, end), pattern).select(*TRIPLE, (F.col("net") > 0).alias("is_addition"))


def versions(snapshot: DataFrame, log: DataFrame, lowest: int, highest: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
    """(s, p, o, versions): every triple that ever held, with the versions in which it did.

    A triple without steps is in the snapshot and held always; of one with steps these alone tell, for they alternate. So one
    aggregation by triple does it, wherever the snapshot is.
    """
    step = F.struct(F.col("version").cast("int").alias("version"), F.col("op").cast("int").alias("op"))
    still = snapshot.select(*TRIPLE, F.lit(None).cast(step_type()).alias("step"))
    rows = pattern.filter(still.unionByName(log.filter((F.col("version") > lowest) & (F.col("version") <= highest)).select(*TRIPLE, step.alias("step"))))
    ops = rows.groupBy(*TRIPLE).agg(F.sort_array(F.collect_list("step")).alias("ops"))
    first = F.when((F.size("ops") == 0) | (F.get(F.col("ops.op"), F.lit(0)) < 0), F.array(F.struct(F.lit(lowest).alias("version"), F.lit(1).alias("op")))).otherwise(F.array().cast(f"array<{step_type()}>"))
    ops = ops.select(*TRIPLE, F.concat(first, "ops").alias("ops"))
    until = lambda i: F.coalesce(F.get(F.col("ops.version"), i + 1), F.lit(highest + 1)) - 1
    held = F.flatten(F.filter(F.transform("ops", lambda x, i: F.when(x["op"] > 0, F.sequence(x["version"], until(i)))), lambda x: x.isNotNull()))
    return ops.select(*TRIPLE, held.alias("versions"))


def step_type() -> str:
    return "struct<version:int,op:int>"


#: Orders of triples by the components that count first; each of them can be had in reverse.
ORDERS = {"total": ("s", "p", "o"), "spo": ("s", "p", "o"), "pos": ("p", "o", "s"), "osp": ("o", "s", "p")}


def keys_of(order: str) -> list:
    """The columns that an order sorts by: a name of ORDERS, ``reverse``, such a name with ``_reverse``, or ``archive``."""
    if order == "archive":
        return ["section", *TRIPLE]
    name, _, back = order.rpartition("_") if "_" in order else ("total", "", order) if order == "reverse" else (order, "", "")
    if name not in ORDERS or back not in ("", "reverse"):
        raise ArchiveError(f"no such order: {order}")
    return [F.desc(c) if back else F.col(c) for c in ORDERS[name]]


def page(result: DataFrame, offset: int = 0, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows from an offset on, in the total order of triples or another; with ``archive`` what the snapshot has before additions.

    A limit and an offset over a sort make one top-k plan; without either, and without an order, nothing is sorted.
    """
    if not offset and limit is None and order is None:
        return result.drop("section")
    result = result.orderBy(*keys_of(order or "total"))
    if offset:
        result = result.offset(offset)
    if limit is not None and limit >= 0:
        result = result.limit(limit)
    return result.drop("section")
