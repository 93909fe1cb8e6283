"""Operators on change logs: net change, normalisation, reconstruction, ranks and pattern counts.

Steps of one triple alternate in sign, so the sum of its steps over a range of versions is -1, 0 or 1: the net change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import EVERYTHING, LOG_SCHEMA, TRIPLE, ArchiveError, TriplePattern
from palimpsest.operators.ranks import ranked

#: The seven pattern shapes that leave a component free, as the columns they bind.
SHAPES = (("s", "p"), ("s", "o"), ("s",), ("p", "o"), ("p",), ("o",), ())


def steps(log: DataFrame, low: int, high: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
    """Steps after version low up to high.

    Terms are never null; saying so lets a join and a union read the same shuffle, for joins add that condition themselves.
    """
    return pattern.filter(log.filter((F.col("version") > low) & (F.col("version") <= high)).filter(" and ".join(f"{c} is not null" for c in TRIPLE)))


def net(log: DataFrame, low: int, high: int, pattern: TriplePattern = EVERYTHING, sign: int = 1) -> DataFrame:
    """(s, p, o, net): triples whose presence differs at high from that at low; sign -1: from high to low."""
    total = F.sum("op") if sign > 0 else -F.sum("op")
    return steps(log, low, high, pattern).groupBy(*TRIPLE).agg(total.cast("int").alias("net")).filter("net <> 0")


def change_from(log: DataFrame, start: int, end: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
    """The net change from start to end, in either direction of time."""
    return net(log, start, end, pattern) if start <= end else net(log, end, start, pattern, -1)


def reconstruct(log: DataFrame, snapshot: int, version: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
    """(s, p, o, is_addition, is_local): the patch of a version against its snapshot.

    A local change was touched on the way, but is at the version as in the snapshot; its sign is that of the last step towards it.
    """
    low, high = min(snapshot, version), max(snapshot, version)
    last = F.max_by("op", "version") if version >= snapshot else -F.min_by("op", "version")
    rows = steps(log, low, high, pattern).groupBy(*TRIPLE).agg(F.sum("op").alias("net"), last.alias("last"))
    return rows.select(*TRIPLE, (F.col("last") > 0).alias("is_addition"), (F.col("net") == 0).alias("is_local"))


def conflicts(changes: DataFrame) -> DataFrame:
    """(version, s, p, o) that one version both adds and deletes."""
    return changes.groupBy("version", *TRIPLE).agg(F.min("op").alias("a"), F.max("op").alias("b")).filter("a <> b").select("version", *TRIPLE)


def normalise(changes: DataFrame, base: DataFrame, check: bool = True) -> DataFrame:
    """The log of raw changes (version, s, p, o, op) upon a base state (s, p, o): additions of what is there, deletions of what
    isn't, and repeats go, which leaves alternating steps. All versions at once, in one shuffle by triple.

    :raises ArchiveError: if a version both adds and deletes a triple
    """
    if check and (found := conflicts(changes).limit(1).collect()):
        raise ArchiveError(f"version {found[0].version} both adds and deletes {found[0].s} {found[0].p} {found[0].o}")
    start = base.select(F.lit(None).cast("int").alias("version"), *TRIPLE, F.lit(1).cast("tinyint").alias("op"))
    rows = start.unionByName(changes.select("version", *TRIPLE, F.col("op").cast("tinyint").alias("op")))
    before = F.lag("op", 1, -1).over(Window.partitionBy(*TRIPLE).orderBy(F.col("version").asc_nulls_first()))
    kept = rows.withColumn("before", before).filter("version is not null and op <> before")
    return kept.select(*(F.col(f.name).cast(f.dataType) for f in LOG_SCHEMA))


def runs(presence: DataFrame, low: int, high: int) -> DataFrame:
    """The log of presence rows (version, s, p, o), each once: the starts and ends of runs of versions."""
    by = Window.partitionBy(*TRIPLE).orderBy("version")
    rows = presence.select("version", *TRIPLE, F.lag("version").over(by).alias("before"), F.lead("version").over(by).alias("after"))
    starts = (F.col("version") > low) & ~F.col("before").eqNullSafe(F.col("version") - 1)
    ends = (F.col("version") < high) & ~F.col("after").eqNullSafe(F.col("version") + 1)
    step = lambda test, v, op: F.when(test, F.struct(v.cast("int").alias("version"), F.lit(op).cast("tinyint").alias("op")))
    found = F.array_compact(F.array(step(starts, F.col("version"), 1), step(ends, F.col("version") + 1, -1)))
    return rows.select(*TRIPLE, F.explode(found).alias("x")).select("x.version", *TRIPLE, "x.op")


def contains(log: DataFrame, version: int, triples: DataFrame, typed: bool = True) -> DataFrame:
    """Those of the triples (s, p, o, op if typed) that the version's own step holds, of that sign or of either."""
    keys = [*TRIPLE, "op"] if typed else TRIPLE
    step = log.filter(F.col("version") == version).select(*TRIPLE, F.col("op").cast("tinyint").alias("op"))
    asked = triples.withColumn("op", F.col("op").cast("tinyint")) if typed else triples
    return asked.join(step, keys, "left_semi")


def positions(deletions: DataFrame) -> DataFrame:
    """Each deletion's rank, from 0, among those that agree with it in a shape's bound columns; a column of (s, p, o) per shape.

    A sort by range for each shape: neither all deletions nor those of one predicate or object are one task's.
    """
    out = deletions.select(*TRIPLE)
    for bound in SHAPES:
        out = ranked(out, position_name(bound), TRIPLE, bound)
    return out


def position_name(bound: tuple[str, ...]) -> str:
    return "pos_" + "".join(c if c in bound else "_" for c in TRIPLE)


def _before(s: str, p: str, o: str) -> Column:
    """Whether a triple comes before this one."""
    return (F.col("s") < s) | ((F.col("s") == s) & ((F.col("p") < p) | ((F.col("p") == p) & (F.col("o") < o))))


def position_of(deletions: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """One row: the rank that a triple has, or would have, among the deletions of each shape, and whether it is one. Only counts."""
    of = {"s": s, "p": p, "o": o}

    def smaller(bound: tuple[str, ...]) -> Column:
        test = _before(s, p, o)
        for c in bound:
            test &= F.col(c) == of[c]
        return F.coalesce(F.sum(test.cast("long")), F.lit(0)).cast("long").alias(position_name(bound))

    found = F.coalesce(F.max((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)), F.lit(False)).alias("is_deletion")
    return deletions.agg(*map(smaller, SHAPES), found)


def position_of_element(patch: DataFrame, s: str, p: str, o: str, bound: tuple[str, ...] = (), is_addition: bool | None = None) -> DataFrame:
    """(position, found): how many elements of a patch come before this triple, of those that agree with it in the bound columns
    and, if given, in sign; and whether the triple is among them."""
    rows = patch if is_addition is None else patch.filter(F.col("is_addition") == is_addition)
    for c, v in zip(TRIPLE, (s, p, o), strict=True):
        rows = rows.filter(F.col(c) == v) if c in bound else rows
    found = F.coalesce(F.max((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)), F.lit(False)).alias("found")
    return rows.agg(F.coalesce(F.sum(_before(s, p, o).cast("long")), F.lit(0)).cast("long").alias("position"), found)


def pattern_cube(additions: DataFrame, least: int = 1, by: str | None = None) -> DataFrame:
    """(s, p, o, n): the number of additions for every pattern of the seven shapes with a free component, ``?`` there.

    :param least: only patterns with so many
    :param by: a column, such as the version: counts for each of its values, and over all of them where it is null
    """
    columns = [*([by] if by else []), *TRIPLE]
    cube = additions.cube(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    cube = cube.filter((F.col("g").bitwiseAND(F.lit(7)) > 0) & (F.col("n") >= least))
    free = {"s": 4, "p": 2, "o": 1}
    shown = (F.when(F.col("g").bitwiseAND(F.lit(bit)) > 0, F.lit("?")).otherwise(F.col(c)).alias(c) for c, bit in free.items())
    return cube.select(*([by] if by else []), *shown, "n")


def join_patches(old: DataFrame, new: DataFrame) -> DataFrame:
    """A patch over another, both (s, p, o, is_addition, is_local): the newer element counts; where it turns the older one's sign it is
    local if that one wasn't."""
    a = old.select(*TRIPLE, F.col("is_addition").alias("_sign"), F.col("is_local").alias("_local"))
    both = new.select(*TRIPLE, "is_addition", "is_local").join(a, TRIPLE, "full_outer")
    local = F.when(F.col("is_addition").isNull(), F.col("_local")).when(F.col("_sign") != F.col("is_addition"), ~F.col("_local")).otherwise(F.col("is_local"))
    return both.select(*TRIPLE, F.coalesce("is_addition", "_sign").alias("is_addition"), local.alias("is_local"))


def overlay(patches: DataFrame, order: str = "seq") -> DataFrame:
    """Union of patches where a later element of a triple wins: (s, p, o, op) from rows with a column that orders them."""
    return patches.groupBy(*TRIPLE).agg(F.max_by("op", order).alias("op"))
