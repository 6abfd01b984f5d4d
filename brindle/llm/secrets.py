"""Secret scans: known shapes, and high-entropy strings.

A candidate is a long run of token characters. By its characters it is of a
class (one-case or mixed hex, base 32, one-case letters with digits, letters of
both cases, base 64, others); a window slides
over it, and the sum of c*log2(c) over the window's characters is kept up to
date by the counts of the one that enters and the one that leaves. The highest
entropy of any window decides, unless an allow-list pattern fits. All of it is
SQL functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import documents
from brindle.llm.spans import apart, let, located, matches

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class Entropy:
    """Windows and least entropies (bits a character) by class, and patterns of
    harmless candidates: placeholders, alphabets in order, long repeats, checksums'
    labels. The least entropies are those that 98 % of random windows of 20
    characters of the class's alphabet reach (40,000 drawn). Letters alone must
    also have ``odd_case`` of them outside words in camel case."""

    shortest: int = 20
    window: int = 20
    hex_least: float = 2.94
    mixed_hex_least: float = 3.18
    base32_least: float = 3.40
    one_case_least: float = 3.44
    letters_least: float = 3.62
    base64_least: float = 3.68
    wide_least: float = 3.9
    odd_case: float = 0.25
    allow: tuple[str, ...] = (
        r"(?i)example|sample|placeholder|changeme|your[_-]?(?:key|token|secret)",
        r"(?i)abcdefghijkl|0123456789ab|qwertyuiop",
        r"(.)\1{7}",
        r"(?i)^sha(?:256|384|512)[-=]",
        r"(?i)^(?:https?|file)[/=]",
    )

    @property
    def candidate(self) -> str:
        return f"[A-Za-z0-9+/_=-]{{{self.shortest},}}"


def top_entropy(value: Column, window: int) -> Column:
    """The highest Shannon entropy of the windows over an ASCII string (of the
    whole string where it is shorter)."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def slide(codes: Column) -> Column:
        n = F.size(codes)

        def step(acc: Column, i: Column) -> Column:
            stays = F.slice(codes, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)))
            count = lambda c: F.size(F.filter(stays, lambda x: x == c))
            comes = count(F.element_at(codes, i))
            goes = count(F.element_at(codes, F.greatest(i - window, F.lit(1))))
            more = F.element_at(weight, comes + 2) - F.element_at(weight, comes + 1)
            less = F.when(i > window, F.element_at(weight, goes + 2) - F.element_at(weight, goes + 1)).otherwise(F.lit(0.0))
            total = acc["sum"] + more - less
            size = F.least(i, F.lit(window)).cast("double")
            return let(total, lambda t: F.struct(t.alias("sum"), F.when(i >= F.least(F.lit(window), n), F.greatest(acc["best"], F.log2(size) - t / size)).otherwise(acc["best"]).alias("best")))

        return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda acc: acc["best"]))

    return let(F.filter(F.transform(F.split(value, ""), F.ascii), lambda c: c > 0), slide)


def suspicious(value: Column, how: Entropy) -> Column:
    """Does a candidate's entropy, for its class, look like a key's?"""
    allowed = F.lit(False)
    for pattern in how.allow:
        allowed = allowed | value.rlike(pattern)
    digit, upper, lower = (value.rlike(p) for p in ("[0-9]", "[A-Z]", "[a-z]"))
    least = (
        F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(how.hex_least))
        .when(value.rlike("^[0-9A-Fa-f]+$"), F.lit(how.mixed_hex_least))
        .when(value.rlike("^(?:[A-Z2-7]+|[a-z2-7]+)=*$"), F.lit(how.base32_least))
        .when(value.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)$"), F.lit(how.one_case_least))
        .when(~digit, F.lit(how.letters_least))
        .when(upper & lower, F.lit(how.base64_least))
        .otherwise(F.lit(how.wide_least))
    )
    odd = F.length(F.regexp_replace(value, "[A-Z]?[a-z]{2,}", "")) >= F.length(value) * how.odd_case
    mixed = F.when(digit, upper | lower).otherwise(upper & lower & value.rlike("^[A-Za-z]+$") & odd)
    return F.when(mixed & ~allowed, top_entropy(value, how.window) >= least).otherwise(F.lit(False))


def scan(docs: DataFrame, columns: list[str], how: Entropy = Entropy()) -> DataFrame:  # noqa: B008
    """``columns`` of every document and ``found``: an array of (start, kind,
    end, value) in order of start and kind; kind is a place in KINDS.

    Null and empty texts have none. Whole texts are scanned, however long;
    an entropy span that touches a span of another kind is left out. Repeated
    rows are scanned alike; an empty table gives no rows. Columns may have any
    names; one named found gives way.
    """
    columns = [c for c in columns if c != "found"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(columns)], text.alias("__text"))
    t = F.col("__text")
    none = F.expr("CAST(array() AS array<string>)")
    values = F.when(t.rlike(ASSIGN), matches(t, ASSIGN, 2)).otherwise(none)
    found = found.select("*", F.zip_with(located(t, ASSIGN), values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.length(v).alias("n"))).alias("__assign"), located(t, ACCESS).alias("__access"), located(t, HEX).alias("__hex"), located(t, how.candidate).alias("__runs"))
    row = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    base = F.concat(F.transform(F.filter("__assign", lambda s: s["n"] >= 8), row(0)), F.transform("__access", row(1)), F.transform("__hex", row(2)))
    found = found.select("*", base.alias("__base"))
    extra = F.transform(F.filter(apart(F.col("__runs"), F.col("__base")), lambda s: suspicious(s["value"], how)), row(3))
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(columns)], F.array_sort(F.concat("__base", extra)).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir), ["doc_id"])
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return rows.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
