"""Spans of regular expressions, in SQL functions alone.

Splitting a text at a pattern and extracting its matches give the pieces
between and the matches; running lengths give the places. Only texts that
hold a match are taken apart. Nothing is quadratic in the number of matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def between(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; a column used in several
    places, or in another function's loop, would be worked out each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, add) -> Column:
    """What the values before each one add up to, by an associative ``add``.
    An array that grows is copied at every step, so this goes by blocks of
    about the square root of the array's size: n values take n**1.5 copies."""

    def each(some: Column, start: Column) -> Column:
        none = F.slice(F.array(zero), 1, 0)
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(some, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def cut(all_: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.slice(all_, k * size + 1, size))

    def joined(blocks: Column) -> Column:
        starts = each(F.transform(blocks, lambda b: F.aggregate(b, zero, add)), zero)
        return F.flatten(F.zip_with(blocks, starts, each))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(let(cut(v), joined)))


def located(text: Column, pattern: str) -> Column:
    """array of (start, end, value): code points, end exclusive."""
    empty = F.expr("CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>)")
    pairs = F.zip_with(matches(text, pattern), between(text, pattern), lambda m, g: F.struct(m.alias("value"), F.length(g).cast("long").alias("gap")))
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    long = lambda x: x["gap"] + F.length(x["value"])
    put = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + long(x)).alias("end"), x["value"].alias("value"))
    found = let(pairs, lambda p: F.zip_with(p, running(F.transform(p, long), F.lit(0).cast("long"), lambda a, b: a + b), put))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that touch none of ``others`` (structs with start and
    end): both are put in order; the farthest end before a span and the first
    start after it tell."""
    far = F.lit(2**62).cast("long")

    def marked(of: Column, own: bool) -> Column:
        return F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), (s["value"] if own else F.lit(None).cast("string")).alias("value")))

    def picked(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda x: F.when(x["own"], F.lit(-1)).otherwise(x["end"]).cast("long")), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.transform(F.reverse(ordered), lambda x: F.when(x["own"], far).otherwise(x["start"])), far, lambda a, b: F.least(a, b)))
        seen = F.zip_with(F.zip_with(ordered, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts, lambda y, s: F.struct(y["x"].alias("x"), y["e"].alias("e"), s.alias("s")))
        kept = F.filter(seen, lambda y: y["x"]["own"] & (y["e"] <= y["x"]["start"]) & (y["s"] >= y["x"]["end"]))
        return F.transform(kept, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["value"].alias("value")))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.array_sort(F.concat(marked(spans, True), marked(others, False))), picked))
