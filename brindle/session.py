"""The session: a catalog of named tables and the SQL front door."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from brindle.errors import InvalidOperation, translated
from brindle.operators.frame import Frame
from brindle.sources import CsvReadOptions, read_csv, read_parquet

QUOTED = "spark.sql.ansi.doubleQuotedIdentifiers"
LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Kinds of plans that change or describe something instead of asking.
REFUSED = tuple(LOGICAL + n for n in ("Command", "ParsedStatement", "InsertIntoDir"))
#: Pieces of SQL text: comments, texts and quoted names, words, any other character.
TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\w+|\s+|.""", re.DOTALL)
#: What ends a list of sort keys.
AFTER_KEYS = ("LIMIT", "OFFSET", "UNION", "EXCEPT", "INTERSECT", "ROWS", "RANGE", "SELECT")


def nulls_first(text: str) -> str:
    """The text with NULLS FIRST at each descending sort key that names no order
    of NULLs, as in the fluent API (ascending keys have it by themselves)."""
    tokens = TOKEN.findall(text)
    solid = [(i, t.upper()) for i, t in enumerate(tokens) if not t.isspace() and not t.startswith(("--", "/*"))]
    keys = [False]  # one entry an open bracket: are we among sort keys?
    for at, (i, t) in enumerate(solid):
        following = solid[at + 1][1] if at + 1 < len(solid) else ""
        if t == "(":
            keys.append(False)
        elif t == ")" and len(keys) > 1:
            keys.pop()
        elif t == "BY" and at and solid[at - 1][1] in ("ORDER", "SORT"):
            keys[-1] = True
        elif t in AFTER_KEYS:
            keys[-1] = False
        elif t == "DESC" and keys[-1] and following != "NULLS" and solid[at - 1][1] not in ("BY", ","):
            tokens[i] += " NULLS FIRST"
    return "".join(tokens)


class SessionContext:
    """Wraps a Spark session; tables are its temporary views."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()

    @translated
    def read_csv(self, path: str, options: CsvReadOptions | None = None) -> Frame:
        return Frame(read_csv(self.spark, path, options))

    @translated
    def read_parquet(self, path: str) -> Frame:
        return Frame(read_parquet(self.spark, path))

    @translated
    def register_csv(self, name: str, path: str, options: CsvReadOptions | None = None) -> None:
        read_csv(self.spark, path, options).createOrReplaceTempView(name)

    @translated
    def register_parquet(self, name: str, path: str) -> None:
        read_parquet(self.spark, path).createOrReplaceTempView(name)

    def register(self, name: str, frame: Frame) -> None:
        frame.df.createOrReplaceTempView(name)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary)

    @translated
    def table(self, name: str) -> Frame:
        return Frame(self.spark.table(name))

    @translated
    def sql(self, text: str) -> Frame:
        """Run one query; anything else, also behind WITH, is refused. Double
        quotes name columns; unnamed aggregates come back as ``FUNC(arg)``.
        NULLs come first in both directions unless the text says otherwise."""
        if not re.match(r"\s*(?:--[^\n]*\n\s*)*(?:select|with|\(|values)\b|\s*\(", text, re.IGNORECASE):
            raise InvalidOperation("only queries are supported")
        text = nulls_first(text)
        before = self.spark.conf.get(QUOTED)
        self.spark.conf.set(QUOTED, "true")
        try:
            self.only_asks(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
            df = self.spark.sql(text)
        finally:
            self.spark.conf.set(QUOTED, before)
        shown = [re.sub(r"^(count|sum|avg|min|max)(?=\()", lambda m: m[0].upper(), c) for c in df.columns]
        return Frame(df if shown == df.columns else df.toDF(*shown))

    def only_asks(self, plan) -> None:
        """Raise if a parsed plan, or one within it, is no query."""
        loader = plan.getClass().getClassLoader()
        if any(loader.loadClass(name).isInstance(plan) for name in REFUSED):
            raise InvalidOperation("only queries are supported")
        inner = plan.children()
        for i in range(inner.size()):
            self.only_asks(inner.apply(i))
