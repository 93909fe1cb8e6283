"""Terms and triples as text, hashes and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import TRIPLE
from palimpsest.operators.ranks import ranked


def bracketed(term: Column, web_only: bool = False) -> Column:
    """A term as N-Triples writes it: IRIs in brackets, literals and blank nodes as they are. web_only: brackets for http:// alone."""
    iri = F.startswith(term, F.lit("http://")) if web_only else ~F.startswith(term, F.lit('"')) & ~F.startswith(term, F.lit("_:"))
    return F.when(iri, F.concat(F.lit("<"), term, F.lit(">"))).otherwise(term)


def triple_line(web_only: bool = False) -> Column:
    """``s p o .``"""
    return F.concat_ws(" ", *(bracketed(F.col(c), web_only) for c in TRIPLE), F.lit("."))


def triple_text() -> Column:
    return F.concat_ws(" ", *TRIPLE)


def delta_text() -> Column:
    """``+ s p o .`` or ``- s p o .``"""
    return F.concat_ws(" ", F.when(F.col("is_addition"), "+").otherwise("-"), triple_text(), F.lit("."))


def versions_text() -> Column:
    """``s p o . :: [ v v ]``"""
    return F.concat(triple_text(), F.lit(" . :: [ "), F.array_join("versions", " "), F.lit(" ]"))


def triple_hash() -> Column:
    return F.xxhash64(*TRIPLE)


def terms(triples: DataFrame, role: str) -> DataFrame:
    """(term): the terms in one role, s, p or o, each once; ``shared`` for those that are subjects and objects."""
    one = lambda c: triples.select(F.col(c).alias("term"))
    return one("s").intersect(one("o")) if role == "shared" else one(role).distinct()


def dictionary(triples: DataFrame) -> DataFrame:
    """(role, term, id): numbers from 1 for the terms of each role, in order; no task holds all terms of a role."""
    each = triples.select(F.explode(F.array(*(F.struct(F.lit(c).alias("role"), F.col(c).alias("term")) for c in TRIPLE))).alias("x")).select("x.role", "x.term").distinct()
    return ranked(each, "id", ["term"], ["role"]).select("role", "term", (F.col("id") + 1).alias("id"))


def insert_terms(known: DataFrame, triples: DataFrame) -> DataFrame:
    """A dictionary with the terms that it lacks, numbered in order after the last of their role. What it has keeps its number."""
    new = dictionary(triples).select("role", "term").join(known, ["role", "term"], "left_anti")
    last = known.groupBy("role").agg(F.max("id").alias("last"))  # a row per role
    numbered = ranked(new, "id", ["term"], ["role"]).join(F.broadcast(last), "role", "left")
    return known.select("role", "term", "id").unionByName(numbered.select("role", "term", (F.col("id") + 1 + F.coalesce("last", F.lit(0))).alias("id")))


def encode(triples: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows with numbers for s, p and o; a term that the dictionary lacks becomes null."""
    for c in TRIPLE:
        own = numbers.filter(F.col("role") == c).select(F.col("term").alias(c), F.col("id").alias(f"{c}_id"))
        triples = triples.join(own, c, "left")
    return triples.drop(*TRIPLE).withColumnsRenamed({f"{c}_id": c for c in TRIPLE})


def decode(encoded: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows with terms for numbers."""
    for c in TRIPLE:
        own = numbers.filter(F.col("role") == c).select(F.col("id").alias(c), F.col("term").alias(f"{c}_term"))
        encoded = encoded.join(own, c, "left")
    return encoded.drop(*TRIPLE).withColumnsRenamed({f"{c}_term": c for c in TRIPLE})


def dictionary_stats(triples: DataFrame) -> DataFrame:
    """(n_subjects, n_predicates, n_objects, n_shared)

    Counts the roles of each term after one shuffle by term; a distinct count per column would expand every row threefold.
    """
    each = triples.select(F.explode(F.array(*(F.struct(F.lit(c).alias("role"), F.col(c).alias("term")) for c in TRIPLE))).alias("x")).select("x.role", "x.term")
    has = lambda c: F.max((F.col("role") == c).cast("int"))
    per = each.groupBy("term").agg(*(has(c).alias(c) for c in TRIPLE))
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return per.agg(total(F.col("s"), "n_subjects"), total(F.col("p"), "n_predicates"), total(F.col("o"), "n_objects"), total(F.col("s") * F.col("o"), "n_shared"))
