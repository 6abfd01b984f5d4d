"""From documents to packed training sequences, in five stages.

Each stage takes what the one before has kept; its result is written as
Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import crf, neardup, packing, pii, rules
from brindle.llm.common import discard, written


def aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text under names no stage uses."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)])


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good."""
    plain = aside(docs)
    scored = crf.classify(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"), plain.columns)
    return scored.where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the word rules and the compression bands. Shortness alone
    is no fault here: by the training labels short documents are mostly good."""
    plain = aside(docs)
    return rules.judge(plain, plain.columns, base=rules.Base(least_words=1)).where("kept").select(*plain.columns).toDF(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return neardup.without_copies(docs, words=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars is counted anew."""
    plain = aside(docs)
    changed = pii.replace_personal(plain, pii.session_key(spark)).select(*plain.columns).toDF(*docs.columns)
    return changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_documents),
    ("quality_rules", by_rules),
    ("ngram_jaccard_join", one_of_each),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)  # its reader is written
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
