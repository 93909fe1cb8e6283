"""Command line: python -m palimpsest.cli COMMAND ...

    ingest PATH FOLDER [SNAPSHOT]      a folder of versions of N-Triples into a store
    vm PATH VERSION S P O [OFFSET [LIMIT]]
    dm PATH START END S P O [OFFSET [LIMIT]]
    vq PATH S P O [OFFSET [LIMIT]]
    append PATH VERSION FOLDER         a version after the last: that version's changes in a folder of versions
    prepend PATH VERSION FOLDER        a version before the first: how it differs from the first
    snapshot PATH VERSION              materialises a version beside the other snapshots
    rebase PATH VERSION                or instead of them
    purge PATH VERSION                 without this version and all later ones
    compact PATH [VERSION]             merges the steps up to a version
    describe PATH                      every version's additions, deletions, triples and bytes
    changeset PATH FOLDER              every version's additions and deletions as N-Triples
    copy PATH TARGET

A term that is ? or empty is free; -2 is no limit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.archive import Archive
from palimpsest.functions.terms import delta_text, triple_text, versions_text
from palimpsest.model import TriplePattern
from palimpsest.sources.ntriples import changes_of, read_versions, write_changeset
from palimpsest.sources.store import Store


def _lines(df: DataFrame, text) -> Iterator[str]:
    return (x[0] for x in df.select(text).toLocalIterator())


def run(spark: SparkSession, args: list[str]) -> Iterator[str]:
    command, path, *rest = args
    store = Store(spark, path)

    def asked(start: int) -> dict:
        offset, limit, *_ = [*map(int, rest[start + 3 : start + 5]), 0, -2] if len(rest) < start + 4 else [*map(int, rest[start + 3 : start + 5]), -2]
        return {"pattern": TriplePattern.parse(*rest[start : start + 3]), "offset": offset, "limit": None if limit < 0 else limit}

    if command == "ingest":
        store.create(Archive.from_folder(spark, rest[0], int(rest[1]) if len(rest) > 1 else None))
    elif command in ("append", "prepend"):
        version = int(rest[0])
        raw = changes_of(read_versions(spark, rest[1])).filter(F.col("version") == version).drop("version")
        store.append(version, raw) if command == "append" else store.prepend(version, raw)
    elif command in ("rebase", "snapshot", "purge"):
        getattr(store, command)(int(rest[0]))
    elif command == "compact":
        store.compact(int(rest[0]) if rest else None)
    elif command == "describe":
        text = F.concat_ws(" ", "version", F.concat(F.lit("+"), "additions"), F.concat(F.lit("-"), "deletions"), "triples", "bytes", F.when(F.col("is_snapshot"), "snapshot"))
        yield from _lines(store.statistics().orderBy("version"), text)
    elif command == "changeset":
        write_changeset(store.open().log, rest[0])
    elif command == "copy":
        store.copy_to(rest[0])
    elif command == "vm":
        archive, q = store.open(), asked(1)
        n = archive.count_vm(int(rest[0]), q["pattern"]).first()
        yield f"Count: {n['count']}"
        yield from _lines(archive.vm(int(rest[0]), **q), F.concat(triple_text(), F.lit(" .")))
    elif command == "dm":
        archive, q = store.open(), asked(2)
        n = archive.count_dm(int(rest[0]), int(rest[1]), q["pattern"], True).first()
        yield f"Count: {n['count']} ({n.estimation})"
        yield from _lines(archive.dm(int(rest[0]), int(rest[1]), **q), delta_text())
    elif command == "vq":
        archive, q = store.open(), asked(0)
        n = archive.count_vq(q["pattern"], True).first()
        yield f"Count: {n['count']} ({n.estimation})"
        yield from _lines(archive.vq(**q), versions_text())
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    if len(sys.argv) < 3:
        raise SystemExit(__doc__)
    for line in run(SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]):
        print(line)
