"""What several operators share: scratch tables, numbering, batches."""

from __future__ import annotations

import atexit
import shutil
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of rows that a Python worker looks at together: at most so many, of so
#: many bytes of text (or one row). Spark itself bounds a batch by its bytes.
RUN_ROWS = 512
RUN_BYTES = 8 << 20


def runs(batches: Iterator[pa.RecordBatch], column: int, rows: int = RUN_ROWS, most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs, without copying; ``column`` holds the texts."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset
    (local tests) a fresh folder below the warehouse is set for the session,
    and removed when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    return base.rstrip("/")


def written(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, and
    later passes don't compute it anew when an executor is lost."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/brindle-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(columns: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def numbered(df: DataFrame, by: list[str], order: list[str], out: str, bucket_rows: int = 50_000, least: int = 64, part: str | None = None) -> DataFrame:
    """A gapless number from 0 within each value of ``by``, without bringing a
    value's rows together: rows are dealt to buckets, numbered within
    (value, bucket), and moved on by the sizes of the buckets before. ``part``
    is the name by which the bucket stays: a run of numbers for each."""
    buckets = max(least, -(-df.count() // bucket_rows))
    dealt = df.withColumn("__bucket", spread([F.col(c) for c in order], buckets))
    sizes = dealt.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__bucket").orderBy(*order)
    placed = dealt.withColumn("__at", F.row_number().over(within) - 1)
    placed = placed.join(sizes, [*by, "__bucket"]).withColumn(out, (F.col("__at") + F.col("__before")).cast("long"))
    return (placed.withColumnRenamed("__bucket", part) if part else placed.drop("__bucket")).drop("__at", "__before")


def worker_cache() -> dict:
    """A dictionary that lives as long as the worker process, for vocabularies."""
    return sys.modules.setdefault("_brindle_worker", types.ModuleType("_brindle_worker")).__dict__


def carried(docs: DataFrame, columns: list[str], made: list[str]) -> tuple[DataFrame, list[str], int]:
    """What a per-document operator sends to Python, under plain names that no
    column's own can clash with: ``columns`` but those it makes itself, their
    real names, and where the text is (last, if not among them)."""
    keep = [c for c in columns if c not in made]
    text = F.col("text").cast("string")
    sent = docs.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [text.alias("_text")]))
    return sent, keep, keep.index("text") if "text" in keep else len(keep)


def mapped(sent: DataFrame, keep: list[str], run, figures: str) -> DataFrame:
    """``run`` over what ``carried`` sends; its columns come back under their real names."""
    made = T.StructType.fromDDL(figures)
    return sent.mapInArrow(run, T.StructType(sent.schema.fields[: len(keep)] + made.fields)).toDF(*keep, *made.names)
