"""Plan texts, for people and for plan tests."""

from __future__ import annotations

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """Spark's plan text: simple, extended, codegen, cost or formatted."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def logical(df: DataFrame) -> str:
    """The optimized logical plan."""
    return df._jdf.queryExecution().optimizedPlan().toString()
