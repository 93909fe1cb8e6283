"""Archives on disk: Parquet snapshots and steps, and a manifest that says which of them count.

    snapshot/version=S/    triples, sorted by s, p, o
    log/version=V/         steps of a version, sorted by s, p, o
    compact/upto=V-N/      steps of all versions up to V, sorted by s, p, o, version: few files instead of one set per version
    snapshot_pos/, compact_pos/, snapshot_osp/, compact_osp/    copies sorted by p, o, s or o, s, p, if the store has these orders
    manifest/g=N/          lowest, highest, snapshots, the compacted steps and the orders; the largest N holds

A change writes data first and then a manifest of the next number, so a reader sees the archive before or after it. Each
version's steps are overwritten as a whole: a repeated write has no further effect.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import astuple, dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.archive import Archive
from palimpsest.model import LOG_SCHEMA, TRIPLE, TRIPLE_SCHEMA, ArchiveError
from palimpsest.operators import changes
from palimpsest.operators.query import ORDERS

MANIFEST = "lowest int, highest int, snapshots array<int>, upto int, compact string, orders array<string>"


@dataclass(frozen=True)
class Manifest:
    lowest: int
    highest: int
    snapshots: list[int]
    upto: int | None = None
    compact: str | None = None
    orders: tuple[str, ...] = ()


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _generation(self) -> int:
        store, path = self._file("manifest")
        found = [int(x.getPath().getName()[2:]) for x in store.listStatus(path) if x.getPath().getName().startswith("g=")] if store.exists(path) else []
        return max((g for g in found if store.exists(self._file(f"manifest/g={g}/_SUCCESS")[1])), default=-1)

    def exists(self) -> bool:
        return self._generation() >= 0

    def _commit(self, manifest: Manifest) -> None:
        row = self.spark.createDataFrame([astuple(replace(manifest, snapshots=sorted(manifest.snapshots), orders=list(manifest.orders)))], MANIFEST)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/g={self._generation() + 1}")

    def _manifest(self) -> Manifest:
        if (g := self._generation()) < 0:
            raise ArchiveError(f"{self.path} holds no archive")
        x = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/g={g}").first()
        return Manifest(x.lowest, x.highest, list(x.snapshots), x.upto, x.compact, tuple(x.orders or ()))

    @staticmethod
    def _places(folder: str, orders: Iterable[str]) -> dict[str, str]:
        """The folder of each order's copy; that of spo is the folder itself."""
        return {"spo": folder} | {x: f"{folder}_{x}" for x in orders}

    def _write_snapshot(self, version: int, triples: DataFrame, orders: Iterable[str]) -> None:
        rows = triples.select(*TRIPLE).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        for order, folder in self._places("snapshot", orders).items():
            rows.repartitionByRange(*ORDERS[order]).sortWithinPartitions(*ORDERS[order]).write.mode("overwrite").parquet(f"{self.path}/{folder}/version={version}")
        rows.unpersist()

    def _write_compact(self, name: str, log: DataFrame, orders: Iterable[str]) -> None:
        rows = log.select(*LOG_SCHEMA.fieldNames()).persist(StorageLevel.MEMORY_AND_DISK)
        for order, folder in self._places("compact", orders).items():
            rows.repartitionByRange(*ORDERS[order]).sortWithinPartitions(*ORDERS[order], "version").write.mode("overwrite").parquet(f"{self.path}/{folder}/{name}")
        rows.unpersist()

    def _write_log(self, log: DataFrame) -> None:
        # rows of a version are split among tasks as needed; a version doesn't become one task's work
        # they are evaluated once, though the ranges are sampled first
        kept = log.select(*LOG_SCHEMA.fieldNames()).persist(StorageLevel.MEMORY_AND_DISK)
        rows = kept.repartitionByRange("version", *TRIPLE).sortWithinPartitions("version", *TRIPLE)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{self.path}/log")
        kept.unpersist()

    def create(self, archive: Archive, orders: Sequence[str] = ()) -> Store:
        """Stores an archive.

        :param orders: copies in other orders, ``pos`` and ``osp``, for patterns without a subject
        """
        if self.exists():
            raise ArchiveError(f"{self.path} holds an archive already")
        if not {"pos", "osp"}.issuperset(orders):
            raise ArchiveError(f"no such orders: {orders}")
        for v, df in archive.snapshots.items():
            self._write_snapshot(v, df, orders)
        self._write_log(archive.log)
        self._commit(Manifest(archive.lowest, archive.highest, list(archive.snapshots), orders=tuple(orders)))
        return self

    def open(self) -> Archive:
        """The archive as lazy reads; versions of the log are partitions, which a query's range prunes."""
        m = self._manifest()
        store, path = self._file("log")
        has = store.exists(path) and any(x.getPath().getName().startswith("version=") for x in store.listStatus(path))
        log = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log") if has else self.spark.createDataFrame([], LOG_SCHEMA)
        log = log.filter((F.col("version") > (m.lowest if m.upto is None else m.upto)) & (F.col("version") <= m.highest))

        def copy(snapshot: str, compact: str) -> tuple[dict[int, DataFrame], DataFrame]:
            frames = {v: self.spark.read.schema(TRIPLE_SCHEMA).parquet(f"{self.path}/{snapshot}/version={v}") for v in m.snapshots}
            return frames, self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/{compact}/{m.compact}").unionByName(log) if m.compact else log

        places = self._places("compact", m.orders)
        copies = {x: copy(folder, places[x]) for x, folder in self._places("snapshot", m.orders).items()}
        return Archive(*copies.pop("spo"), m.lowest, m.highest, copies)

    def compact(self, upto: int | None = None) -> None:
        """Merges the steps up to a version, the last by default, into few files sorted by triple.

        A lookup of a subject then reads the row groups that may hold it, and an archive of very many versions few files.
        """
        m = self._manifest()
        upto = m.highest if upto is None else min(upto, m.highest)
        name = f"upto={upto}-{self._generation() + 1}"
        self._write_compact(name, self.open().log.filter(F.col("version") <= upto), m.orders)
        rest = m.upto if m.upto is not None and m.upto > upto else None
        if rest is not None:  # what was compacted beyond goes back to its versions
            self._write_log(self.open().log.filter((F.col("version") > upto) & (F.col("version") <= rest)))
        self._commit(replace(m, upto=upto, compact=name))
        for v in range(m.lowest + 1, upto + 1):
            self._delete(f"log/version={v}")
        if m.compact:
            self._delete_all("compact", m.compact, m.orders)

    def append(self, version: int, raw: DataFrame, strict: bool = False) -> None:
        """Adds a version after the last. Data of a version that was purged or whose append broke off are overwritten."""
        archive = self.open()
        new = archive.append(version, raw, strict)
        for v in range(archive.highest + 1, version + 1):
            self._delete(f"log/version={v}")
        self._write_log(new.log.filter(F.col("version") == version))
        self._commit(replace(self._manifest(), highest=version))

    def prepend(self, version: int, raw: DataFrame) -> None:
        """Adds a version before the first; raw: how it differs from the first."""
        m = self._manifest()
        new = self.open().prepend(version, raw)
        if m.upto is not None:
            name = f"upto={m.upto}-{self._generation() + 1}"
            self._write_compact(name, new.log.filter(F.col("version") <= m.upto), m.orders)
            self._commit(replace(m, lowest=version, compact=name))
            self._delete_all("compact", m.compact, m.orders)
        else:
            self._delete(f"log/version={m.lowest}")
            self._write_log(new.log.filter(F.col("version") == m.lowest))
            self._commit(replace(m, lowest=version))

    def append_all(self, raw: DataFrame, check: bool = True) -> None:
        """Adds all versions of raw changes (version, s, p, o, op) that come after the last, in one job."""
        archive = self.open()
        raw = raw.filter(F.col("version") > archive.highest)
        if (last := raw.agg(F.max("version")).first()[0]) is None:
            return
        base = archive.vm(archive.highest).join(raw.select(*TRIPLE).distinct(), TRIPLE, "left_semi")
        for v in range(archive.highest + 1, last + 1):
            self._delete(f"log/version={v}")
        self._write_log(changes.normalise(raw, base, check))
        self._commit(replace(self._manifest(), highest=last))

    def snapshot(self, version: int, keep: bool = True) -> None:
        """Materialises a version as a snapshot, beside the others or instead of them."""
        m = self._manifest()
        if version not in m.snapshots:
            self._write_snapshot(version, self.open().rebase(version).snapshots[version], m.orders)
        self._commit(replace(m, snapshots=list({*m.snapshots, version}) if keep else [version]))
        for v in [] if keep else [s for s in m.snapshots if s != version]:
            self._delete_all("snapshot", f"version={v}", m.orders)

    def rebase(self, version: int) -> None:
        self.snapshot(version, keep=False)

    def purge(self, version: int) -> None:
        """Removes a version and all later ones. Its steps are still read while a snapshot before it is written, if there is none."""
        archive, m = self.open().purge(version), self._manifest()
        if new := set(archive.snapshots) - set(m.snapshots):
            for v in new:
                self._write_snapshot(v, archive.snapshots[v], m.orders)
            self._commit(replace(m, snapshots=[*m.snapshots, *new]))
        if m.upto is not None and m.upto >= version:
            self.compact(version - 1)
        self._commit(replace(self._manifest(), highest=version - 1, snapshots=list(archive.snapshots)))
        for v in range(version, m.highest + 1):
            self._delete(f"log/version={v}")
            self._delete_all("snapshot", f"version={v}", m.orders)

    def _delete(self, name: str) -> None:
        store, path = self._file(name)
        store.delete(path, True)

    def _delete_all(self, folder: str, name: str, orders: Iterable[str]) -> None:
        for place in self._places(folder, orders).values():
            self._delete(f"{place}/{name}")

    def copy_to(self, path: str) -> Store:
        return Store(self.spark, path).create(self.open(), self._manifest().orders)

    def statistics(self) -> DataFrame:
        """(version, additions, deletions, triples, is_snapshot, bytes): every version and the bytes of its own files; steps that are
        compacted aren't a version's own."""
        m = self._manifest()
        places = list(self._places("snapshot", m.orders).values())

        def size(name: str) -> int:
            store, path = self._file(name)
            return store.getContentSummary(path).getLength() if store.exists(path) else 0

        rows = [(v, size(f"log/version={v}") + sum(size(f"{x}/version={v}") for x in places if v in m.snapshots)) for v in range(m.lowest, m.highest + 1)]
        return self.open().describe().join(F.broadcast(self.spark.createDataFrame(rows, "version int, bytes long")), "version")
