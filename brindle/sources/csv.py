"""CSV source: options, inference from a bounded sample of records, 64-bit integers.

A value that doesn't fit the schema is an error when its column is read (Spark
parses only the columns a query needs). A quote inside a quoted field is
doubled. Records may hold line breaks: then Spark reads whole files instead
of splits, so this is found out by a distributed pass over the lines, unless
``with_multi_line`` says it.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CsvReadOptions:
    """How to read a CSV file. Options hold for inference and for the scan."""

    schema: T.StructType | str | None = None
    has_header: bool = True
    delimiter: str = ","
    quote: str = '"'
    infer_rows: int = 100
    multi_line: bool | None = None

    def with_schema(self, schema) -> CsvReadOptions:
        return replace(self, schema=schema)

    def with_has_header(self, has_header: bool) -> CsvReadOptions:
        return replace(self, has_header=has_header)

    def with_delimiter(self, delimiter: str) -> CsvReadOptions:
        return replace(self, delimiter=delimiter)

    def with_quote(self, quote: str) -> CsvReadOptions:
        return replace(self, quote=quote)

    def with_multi_line(self, multi_line: bool) -> CsvReadOptions:
        """Whether quoted fields may hold line breaks (None: look)."""
        return replace(self, multi_line=multi_line)

    def reader(self, spark: SparkSession):
        made = spark.read.option("header", self.has_header).option("sep", self.delimiter).option("quote", self.quote).option("escape", self.quote)
        return made.option("multiLine", bool(self.multi_line)).option("mode", "FAILFAST")


def widened(schema: T.StructType) -> T.StructType:
    """Integers as 64 bit, everything nullable."""
    kind = lambda t: T.LongType() if isinstance(t, T.IntegralType) else t
    return T.StructType([T.StructField(f.name, kind(f.dataType), True) for f in schema])


def spans_lines(spark: SparkSession, path: str, quote: str) -> bool:
    """Has any line an odd number of quotes, so that a record goes on?"""
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))) % 2 == 1
    return bool(spark.read.text(path).where(odd).limit(1).count())


def infer_schema(spark: SparkSession, path: str, options: CsvReadOptions) -> T.StructType:
    """The schema that the header and the first ``infer_rows`` records suggest."""
    records = options.reader(spark).option("mode", "PERMISSIVE").csv(path)
    sample = io.StringIO()
    writer = csv.writer(sample, delimiter=options.delimiter, quotechar=options.quote, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
    for row in records.limit(options.infer_rows).collect():
        writer.writerow(["" if v is None else v.replace("\n", " ").replace("\r", " ") for v in row])
    lines = spark.createDataFrame([(x,) for x in sample.getvalue().split("\n") if x], "value string")
    as_text = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = options.reader(spark).option("header", False).option("mode", "PERMISSIVE").option("inferSchema", True)
    types = [f.dataType for f in DataFrame(reader._jreader.csv(as_text), spark).schema]
    types += [T.StringType()] * (len(records.columns) - len(types))
    return widened(T.StructType([T.StructField(n, t) for n, t in zip(records.columns, types, strict=False)]))


def read_csv(spark: SparkSession, path: str, options: CsvReadOptions | None = None) -> DataFrame:
    """A lazy scan of a CSV file or folder; empty fields are NULL."""
    options = options or CsvReadOptions()
    if options.multi_line is None:
        options = options.with_multi_line(spans_lines(spark, path, options.quote))
    schema = options.schema if options.schema is not None else infer_schema(spark, path, options)
    return options.reader(spark).schema(schema).csv(path)
