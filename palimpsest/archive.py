"""An archive: the versions of a set of triples, as snapshots and one log of steps."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.model import EVERYTHING, LOG_SCHEMA, TRIPLE, TRIPLE_SCHEMA, ArchiveError, TriplePattern
from palimpsest.operators import changes, count, query
from palimpsest.operators.ranks import ranked
from palimpsest.plans.routing import clamp, index_for, nearest_snapshot
from palimpsest.sources import ntriples


@dataclass(frozen=True)
class Archive:
    """Versions lowest to highest; snapshots by version; steps (version, s, p, o, op) for each version after the lowest.

    Versions past the end stand for the last, versions before the first hold nothing.
    """

    snapshots: Mapping[int, DataFrame]
    log: DataFrame
    lowest: int
    highest: int
    #: Snapshots and log in other orders, by the order's name.
    copies: Mapping[str, tuple[Mapping[int, DataFrame], DataFrame]] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.log.sparkSession

    @classmethod
    def from_changes(cls, base: DataFrame, raw: DataFrame, lowest: int, highest: int, snapshot: int | None = None, check: bool = True) -> Archive:
        """From the state at the lowest version and raw changes, which are normalised."""
        base = base.select(*TRIPLE).distinct()
        out = cls({lowest: base}, changes.normalise(raw.filter((F.col("version") > lowest) & (F.col("version") <= highest)), base, check), lowest, highest)
        return out if snapshot in (None, lowest) else out.rebase(snapshot)

    @classmethod
    def from_presence(cls, presence: DataFrame, lowest: int, highest: int, snapshot: int) -> Archive:
        """From rows (version, s, p, o) that say what held when."""
        rows = presence.select(F.col("version").cast("int").alias("version"), *TRIPLE).distinct()
        return cls({snapshot: rows.filter(F.col("version") == snapshot).select(*TRIPLE)}, changes.runs(rows, lowest, highest), lowest, highest)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, snapshot: int | None = None, skip_malformed: bool = False) -> Archive:
        """From a folder of versions of N-Triples: the lowest version's snapshot files, if any, and all changes.

        :param skip_malformed: load what is well formed; else a line that isn't a triple is refused. ``ntriples.malformed_in`` has these
        """
        every = ntriples.parse_versions(spark, folder)
        rows = every.filter("not malformed").drop("malformed", "value")
        lowest, highest, bad = every.agg(F.min(F.when(~F.col("malformed"), F.col("version"))), F.max(F.when(~F.col("malformed"), F.col("version"))), F.sum(F.col("malformed").cast("int"))).first()
        if bad and not skip_malformed:
            raise ArchiveError(f"{folder} holds {bad} lines that aren't triples")
        if lowest is None:
            raise ArchiveError(f"{folder} holds no versions")
        base = rows.filter((F.col("version") == lowest) & (F.col("kind") == "snapshot"))
        raw = ntriples.changes_of(rows)
        # without a snapshot the lowest version's additions are its state
        base = base.select(*TRIPLE).unionByName(raw.filter((F.col("version") == lowest) & (F.col("op") > 0)).select(*TRIPLE))
        return cls.from_changes(base, raw, lowest, highest, snapshot)

    def _at(self, version: int) -> int | None:
        return clamp(version, self.lowest, self.highest)

    def _nothing(self, columns: str) -> DataFrame:
        return self.spark.createDataFrame([], columns)

    def for_pattern(self, pattern: TriplePattern) -> Archive:
        """The archive over the copies whose order has the pattern's bound components first, where there are such."""
        order = index_for(pattern)
        return replace(self, **dict(zip(("snapshots", "log"), self.copies[order], strict=True))) if order in self.copies else self

    def vm(self, version: int, pattern: TriplePattern = EVERYTHING, offset: int = 0, limit: int | None = None, order: str | None = None) -> DataFrame:
        """(s, p, o): the triples at a version, paged in the total order, another, or the archive's, where additions come last."""
        at = self._at(version)
        if at is None or not self.snapshots:
            return self.spark.createDataFrame([], TRIPLE_SCHEMA)
        near, own = nearest_snapshot(self.snapshots, at), self.for_pattern(pattern)
        return query.page(query.materialize(own.snapshots[near], own.log, near, at, pattern, True), offset, limit, order)

    def dm(self, start: int, end: int, pattern: TriplePattern = EVERYTHING, offset: int = 0, limit: int | None = None, order: str | None = None) -> DataFrame:
        """(s, p, o, is_addition): the change from one version to a later one."""
        a, b, log = self._at(start), self._at(end), self.for_pattern(pattern).log
        if b is None:
            return query.delta(log, 0, 0, pattern)
        rows = self.vm(b, pattern).withColumn("is_addition", F.lit(True)) if a is None else query.delta(log, a, b, pattern)
        return query.page(rows, offset, limit, order)

    def vq(self, pattern: TriplePattern = EVERYTHING, offset: int = 0, limit: int | None = None, order: str | None = None) -> DataFrame:
        """(s, p, o, versions): each triple that ever held, with its versions."""
        own = self.for_pattern(pattern)
        return query.page(query.versions(own._some_snapshot(), own.log, self.lowest, self.highest, pattern), offset, limit, order)

    def _some_snapshot(self) -> DataFrame:
        """Any will do for a triple without steps; a triple with steps needs none."""
        return self.snapshots[min(self.snapshots)] if self.snapshots else self.spark.createDataFrame([], TRIPLE_SCHEMA)

    def count_vm(self, version: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
        at = self._at(version)
        if at is None or not self.snapshots:
            return self.spark.createDataFrame([(0, "EXACT")], "count long, estimation string")
        near, own = nearest_snapshot(self.snapshots, at), self.for_pattern(pattern)
        return count.count_version(own.snapshots[near], own.log, near, at, pattern)

    def count_dm(self, start: int, end: int, pattern: TriplePattern = EVERYTHING, estimate: bool = False) -> DataFrame:
        a, b = self._at(start), self._at(end)
        if b is None:
            return self.spark.createDataFrame([(0, "EXACT")], "count long, estimation string")
        if a is None:
            return self.count_vm(b, pattern)
        middle = next((s for s in sorted(self.snapshots) if a < s < b), None)
        return count.count_delta(self.for_pattern(pattern).log, a, b, pattern, middle, estimate)

    def count_vq(self, pattern: TriplePattern = EVERYTHING, estimate: bool = False) -> DataFrame:
        own = self.for_pattern(pattern)
        return count.count_versions(own._some_snapshot(), own.log, pattern, estimate)

    def _change(self, version: int, sign: int) -> DataFrame:
        """Net additions (1) or deletions (-1) of a version against its nearest snapshot; none before the first version."""
        at = self._at(version)
        near = nearest_snapshot(self.snapshots, self.lowest if at is None else at)
        return changes.change_from(self.log, near, near if at is None else at).filter(F.col("net") * sign > 0).select(*TRIPLE)

    def patch(self, version: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
        """(s, p, o, is_addition, is_local): the version's patch against its nearest snapshot; empty before the first version."""
        at = self._at(version)
        near = nearest_snapshot(self.snapshots, self.lowest if at is None else at)
        return changes.reconstruct(self.log, near, near if at is None else at, pattern)

    def patch_from(self, version: int, s: str, p: str, o: str, pattern: TriplePattern = EVERYTHING) -> DataFrame:
        """The patch's elements from a triple on, in order."""
        return self.patch(version, pattern).filter(~changes._before(s, p, o)).orderBy(*TRIPLE)

    def deletion_count(self, version: int, pattern: TriplePattern = EVERYTHING) -> DataFrame:
        return pattern.filter(self._change(version, -1)).agg(F.count("*").alias("count"))

    def deletion_positions(self, version: int) -> DataFrame:
        return changes.positions(self._change(version, -1))

    def deletions_from(self, version: int, s: str, p: str, o: str, pattern: TriplePattern = EVERYTHING) -> DataFrame:
        """(s, p, o, position): the deletions that fit a pattern, from a triple on, with their ranks among these."""
        return ranked(pattern.filter(self._change(version, -1)), "position", TRIPLE).filter(~changes._before(s, p, o))

    def position_of(self, version: int, s: str, p: str, o: str) -> DataFrame:
        return changes.position_of(self._change(version, -1), s, p, o)

    def position_of_element(self, version: int, s: str, p: str, o: str, bound: tuple[str, ...] = (), is_addition: bool | None = None) -> DataFrame:
        return changes.position_of_element(self.patch(version), s, p, o, bound, is_addition)

    def pattern_counts(self, version: int, least: int = 1) -> DataFrame:
        return changes.pattern_cube(self._change(version, 1), least)

    def pattern_counts_by_version(self, least: int = 1) -> DataFrame:
        """(version, s, p, o, n): additions of each version's step by pattern, and of all versions where version is null."""
        return changes.pattern_cube(self.log.filter("op > 0").select("version", *TRIPLE), least, "version")

    def contains(self, version: int, triples: DataFrame, typed: bool = True) -> DataFrame:
        return changes.contains(self.log, version, triples, typed)

    def sizes(self) -> DataFrame:
        """(version, additions, deletions) of each step."""
        up, down = (F.sum((F.col("op") == k).cast("long")).alias(n) for k, n in ((1, "additions"), (-1, "deletions")))
        return self.log.groupBy("version").agg(up, down)

    def describe(self) -> DataFrame:
        """(version, additions, deletions, triples, is_snapshot) of every version."""
        every = self.spark.range(self.lowest, self.highest + 1).select(F.col("id").cast("int").alias("version"))
        rows = every.join(self.sizes(), "version", "left").fillna(0, ["additions", "deletions"])
        first = self.count_vm(self.lowest).first()["count"]
        triples = F.lit(first) + F.sum(F.col("additions") - F.col("deletions")).over(Window.orderBy("version"))  # a row per version
        return rows.select("version", "additions", "deletions", triples.alias("triples"), F.col("version").isin(*self.snapshots).alias("is_snapshot"))

    def rebase(self, snapshot: int, keep: bool = False) -> Archive:
        """The same versions upon a snapshot at another version; the log stays as it is. keep: beside the others."""
        if not self.lowest <= snapshot <= self.highest:
            raise ArchiveError(f"version {snapshot} isn't in the archive")
        new = self.snapshots[snapshot] if snapshot in self.snapshots else self.vm(snapshot)
        return replace(self, snapshots={**(self.snapshots if keep else {}), snapshot: new}, copies={})

    def purge(self, version: int) -> Archive:
        """Without this version and all later ones."""
        if not self.lowest < version <= self.highest:
            raise ArchiveError(f"version {version} can't be the first to go")
        kept = {s: df for s, df in self.snapshots.items() if s < version} or {version - 1: self.vm(version - 1)}
        return replace(self, snapshots=kept, log=self.log.filter(F.col("version") < version), highest=version - 1, copies={})

    def append(self, version: int, raw: DataFrame, strict: bool = False) -> Archive:
        """With a version after the last; raw: (s, p, o, op). Versions in between equal the last.

        :param strict: refuse additions of what is there and deletions of what isn't, which else have no effect
        """
        if version <= self.highest:
            raise ArchiveError(f"version {version} isn't after {self.highest}")
        raw = raw.select(F.lit(version).alias("version"), *TRIPLE, "op")
        state = self.vm(self.highest)
        # only the state of what changes matters
        base = state.join(raw.select(*TRIPLE).distinct(), TRIPLE, "left_semi")
        new = changes.normalise(raw, base)
        if strict:
            # a repeat, an addition of what is there or a deletion of what isn't
            held = raw.join(base.withColumn("_held", F.lit(True)), TRIPLE, "left").groupBy(*TRIPLE).agg(F.count("*").alias("n"), F.min("op").alias("op"), F.max("_held").alias("held"))
            if not held.filter((F.col("n") > 1) | ((F.col("op") > 0) == F.coalesce("held", F.lit(False)))).isEmpty():
                raise ArchiveError(f"version {version} changes nothing with some of its changes")
        return replace(self, log=self.log.unionByName(new), highest=version, copies={})

    def prepend(self, version: int, raw: DataFrame) -> Archive:
        """With a version before the first; raw: (s, p, o, op), how it differs from the first. Versions in between equal the new one."""
        if version >= self.lowest:
            raise ArchiveError(f"version {version} isn't before {self.lowest}")
        raw = raw.select(F.lit(self.lowest).alias("version"), *TRIPLE, "op")
        base = self.vm(self.lowest).join(raw.select(*TRIPLE).distinct(), TRIPLE, "left_semi")
        back = changes.normalise(raw, base)
        return replace(self, log=self.log.unionByName(back.withColumn("op", (-F.col("op")).cast("tinyint"))), lowest=version, copies={})


class PatchBuilder:
    """Collects a version's changes in memory."""

    def __init__(self, archive: Archive | None, spark: SparkSession):
        self.archive, self.spark, self.rows = archive, spark, []

    def addition(self, s: str, p: str, o: str) -> PatchBuilder:
        self.rows.append((s, p, o, 1))
        return self

    def deletion(self, s: str, p: str, o: str) -> PatchBuilder:
        if self.archive is None:
            raise ArchiveError("a first version has nothing to delete")
        self.rows.append((s, p, o, -1))
        return self

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "s string, p string, o string, op tinyint")

    def commit(self, version: int | None = None, strict: bool = False) -> Archive:
        """The archive with these changes as its next version, or a new one with them as its first."""
        if self.archive is None:
            first = version or 0
            return Archive({first: self.frame().select(*TRIPLE).distinct()}, self.spark.createDataFrame([], LOG_SCHEMA), first, first)
        return self.archive.append(self.archive.highest + 1 if version is None else version, self.frame(), strict)
