"""Counts of the three queries, exact or cheaper upper bounds: rows (count, estimation) with EXACT or UP_TO."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import EVERYTHING, TRIPLE, TriplePattern
from palimpsest.operators.changes import change_from, net


def _result(df: DataFrame, count: Column, exact: bool) -> DataFrame:
    return df.agg(F.coalesce(count, F.lit(0)).cast("long").alias("count"), F.lit("EXACT" if exact else "UP_TO").alias("estimation"))


def count_version(snapshot: DataFrame, log: DataFrame, at: int, version: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
    """The snapshot's triples and the net change summed up; nothing is joined."""
    rows = pattern.filter(snapshot.select(*TRIPLE)).agg(F.count("*").alias("n"))
    if at != version:
        rows = rows.unionByName(change_from(log, at, version, pattern).agg(F.sum("net").alias("n")))
    return _result(rows, F.sum("n"), True)


def count_delta(log: DataFrame, start: int, end: int, pattern: TriplePattern = EVERYTHING, snapshot: int | None = None, estimate: bool = False) -> DataFrame:
    """Exact, or with an estimate across the snapshot both sides' changes added up, where a triple may count twice."""
    if estimate and snapshot is not None and start < snapshot < end:
        sides = [net(log, a, b, pattern).agg(F.count("*").alias("n")) for a, b in ((start, snapshot), (snapshot, end))]
        return _result(sides[0].unionByName(sides[1]), F.sum("n"), False)
    return _result(net(log, start, max(start, end), pattern), F.count("*"), True)


def count_versions(snapshot: DataFrame, log: DataFrame, pattern: TriplePattern = EVERYTHING, estimate: bool = False) -> DataFrame:
    """Triples that ever held. The estimate adds the snapshot's triples to all steps but does no work per triple."""
    snapshot, log = pattern.filter(snapshot.select(*TRIPLE)), pattern.filter(log.select(*TRIPLE))
    if estimate:
        one = lambda df: df.agg(F.count("*").alias("n"))
        return _result(one(snapshot).unionByName(one(log)), F.sum("n"), False)
    return _result(snapshot.unionByName(log).distinct(), F.count("*"), True)
