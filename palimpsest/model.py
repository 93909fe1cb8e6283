"""The data model: triples, patterns, change logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a triple, and of the total order of results: strings, compared by bytes.
TRIPLE = ["s", "p", "o"]
TRIPLE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), False) for c in TRIPLE])
#: A step: op is 1 where a triple appears at a version, -1 where it disappears.
LOG_SCHEMA = T.StructType([T.StructField("version", T.IntegerType(), False), *TRIPLE_SCHEMA.fields, T.StructField("op", T.ByteType(), False)])


class ArchiveError(ValueError):
    """A change or a request that an archive can't accept."""


@dataclass(frozen=True)
class TriplePattern:
    """A conjunction of equalities; None leaves a component free."""

    s: str | None = None
    p: str | None = None
    o: str | None = None

    @classmethod
    def parse(cls, s: str, p: str, o: str) -> TriplePattern:
        """From terms as people write them: a leading ``?`` or nothing is a variable, an IRI may have its brackets."""

        def term(x: str) -> str | None:
            if not x or x.startswith("?"):
                return None
            return x[1:-1] if x.startswith("<") and x.endswith(">") else x

        return cls(*map(term, (s, p, o)))

    @property
    def bound(self) -> dict[str, str]:
        return {c: v for c in TRIPLE if (v := getattr(self, c)) is not None}

    def condition(self) -> Column | None:
        """The filter, or None if every component is free."""
        out = None
        for c, v in self.bound.items():
            test = F.col(c) == F.lit(v)
            out = test if out is None else out & test
        return out

    def filter(self, df: DataFrame) -> DataFrame:
        test = self.condition()
        return df if test is None else df.filter(test)


EVERYTHING = TriplePattern()
