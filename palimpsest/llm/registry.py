"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.ann import op6_nearest
from palimpsest.llm.byte_bpe import op10_byte_bpe
from palimpsest.llm.langid import op7_langid
from palimpsest.llm.mixing import OP8_SQL, op8_mix_sources
from palimpsest.llm.ngram_lm import op5_ngram_lm
from palimpsest.llm.simhash import op2_simhash
from palimpsest.llm.spotsigs import op1_spotsigs
from palimpsest.llm.toxicity import op3_toxicity
from palimpsest.llm.url_reputation import OP4_SQL, op4_url_filter
from palimpsest.llm.warc import OP9_SQL, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_spotsigs, op2_simhash, op3_toxicity, op4_url_filter, op5_ngram_lm, op6_nearest, op7_langid, op8_mix_sources, op9_warc, op10_byte_bpe)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op8_mix_sources": OP8_SQL, "op9_warc": OP9_SQL}
