"""N-Triples files: reading, folders of versions, and writing changesets.

A folder of versions has a subfolder per version; in it, files ``*.nt.additions.txt`` and ``*.nt.deletions.txt`` are changes, and
every other file belongs to a snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.terms import triple_line
from palimpsest.model import LOG_SCHEMA, TRIPLE

#: Subject, predicate, object; an IRI's brackets are left out of the group.
LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+?)|("(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?))\s*\.\s*(?:#.*)?$'
ADDITIONS, DELETIONS = ".nt.additions.txt", ".nt.deletions.txt"


#: Stands between components of a parsed line; no such line holds it.
_BETWEEN = "\u0001"
#: Escapes of code points, other escapes, and all else.
_PIECE = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"


def unescaped(term: Column) -> Column:
    """A term with its \\u and \\U escapes as characters; other escapes stay as they are."""
    point = lambda x: F.when(x.rlike(r"^\\u"), F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE")).when(x.rlike(r"^\\U"), F.decode(F.unhex(F.substring(x, 3, 8)), "UTF-32")).otherwise(x)
    whole = F.array_join(F.transform(F.regexp_extract_all(term, F.lit(f"({_PIECE})"), F.lit(1)), point), "")
    return F.when(F.rlike(term, F.lit(r"\\[uU]")), whole).otherwise(term)


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds s, p, o and malformed to rows with a line each; blank lines and comments go. A line is matched once."""
    rows = lines.filter(~F.rlike(F.col(line), F.lit(r"^\s*(#.*)?$")))
    parts = F.when(~F.contains(F.col(line), F.lit(_BETWEEN)), F.split(F.regexp_replace(F.col(line), LINE, f"$1$2{_BETWEEN}$3{_BETWEEN}$4$5$6"), _BETWEEN))
    rows = rows.withColumn("_parts", parts).withColumn("malformed", F.coalesce(F.size("_parts") != 3, F.lit(True)))
    good = lambda k: F.when(~F.col("malformed"), unescaped(F.get("_parts", F.lit(k))))
    return rows.withColumns({c: good(k) for k, c in enumerate(TRIPLE)}).drop("_parts")


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(s, p, o) of well-formed lines."""
    return parse_lines(spark.read.text(path)).filter("not malformed").select(*TRIPLE)


def malformed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value): the lines that aren't triples."""
    return parse_lines(spark.read.text(path)).filter("malformed").select("value")


def read_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, kind, s, p, o) of the well-formed lines of a folder of versions; kind is addition, deletion or snapshot."""
    return parse_versions(spark, folder).filter("not malformed").drop("malformed", "value")


def malformed_in(spark: SparkSession, folder: str) -> DataFrame:
    """(version, kind, value): the lines of a folder of versions that aren't triples."""
    return parse_versions(spark, folder).filter("malformed").select("version", "kind", "value")


def parse_versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, kind, value, malformed, s, p, o) of all lines of a folder of versions. One scan of all files."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    # a changeset that was written here is a folder of parts with the file's name
    place = F.regexp_extract("file", r"/(\d+)/([^/]+)(?:/[^/]+)?$", 1), F.regexp_extract("file", r"/\d+/([^/]+)(?:/[^/]+)?$", 1)
    kind = F.when(F.endswith(place[1], F.lit(ADDITIONS)), "addition").when(F.endswith(place[1], F.lit(DELETIONS)), "deletion").otherwise("snapshot")
    rows = parse_lines(files.select("value", place[0].alias("version"), kind.alias("kind")).filter("version <> ''"))
    return rows.select(F.col("version").cast("int").alias("version"), "kind", "value", "malformed", *TRIPLE)


def changes_of(rows: DataFrame) -> DataFrame:
    """(version, s, p, o, op) of the additions and deletions of read_versions."""
    op = F.when(F.col("kind") == "addition", 1).otherwise(-1).cast("tinyint")
    return rows.filter("kind <> 'snapshot'").select("version", *TRIPLE, op.alias("op"))


def in_memory(spark: SparkSession, triples: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(triples, "s string, p string, o string")


def changes_in_memory(spark: SparkSession, changes: list[tuple[int, str, str, str, int]]) -> DataFrame:
    return spark.createDataFrame(changes, LOG_SCHEMA)


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    triples.select(triple_line()).write.mode(mode).text(path)


def write_changeset(log: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Each version's additions and deletions below the folder, as read_versions reads them: a folder of parts for either. One job writes
    all versions, dealt by ranges of lines, so that a large version is many tasks' work; then the folders get their names."""
    spark = log.sparkSession
    name = F.concat(F.lit("main"), F.when(F.col("op") > 0, ADDITIONS).otherwise(DELETIONS))
    staged = f"{folder.rstrip('/')}/_staged"
    log.select("version", name.alias("file"), triple_line().alias("value")).repartitionByRange("version", "file", "value").write.mode(mode).partitionBy("version", "file").text(staged)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staged)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for version in store.listStatus(path):
        if version.isDirectory():
            for file in store.listStatus(version.getPath()):
                target = jvm.org.apache.hadoop.fs.Path(folder, version.getPath().getName().split("=")[1])
                store.mkdirs(target)
                place = jvm.org.apache.hadoop.fs.Path(target, file.getPath().getName().split("=")[1])
                if mode == "overwrite":
                    store.delete(place, True)
                store.rename(file.getPath(), place)
    store.delete(path, True)
