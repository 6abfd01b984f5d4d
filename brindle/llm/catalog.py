"""The operators' queries and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, crf, dualtree, lattice, neardup, packing, pii, rules, secrets, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": neardup.op1,
    "op2_sharding": sharding.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_quality_rules": rules.op4,
    "op5_pii": pii.op5,
    "op6_secrets": secrets.op6,
    "op7_top_k": dualtree.op7,
    "op8_lm_scores": lattice.op8,
    "op9_packing": packing.op9,
    "op10_quality_classifier": crf.op10,
}

ORACLE: dict[str, str] = {"op1_ngram_join": neardup.ORACLE, "op7_top_k": dualtree.ORACLE}
