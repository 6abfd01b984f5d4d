"""Connected components by alternating large and small stars.

Links stay distributed; every round is two joins and is written to the shared
folder. In a large star each node hands its larger neighbours to its smallest
one, in a small star its smaller ones; rounds end when nothing moves, and then
every node is linked with the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, written


def hand_over(edges: DataFrame) -> DataFrame:
    """edges (u, v): v goes to the smallest of u and its vs."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link; label is its component's
    smallest node. Null and self links count for nothing."""
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col("u") != F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "links")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hand_over(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = hand_over(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        edges, before = written(small, "links"), edges
        discard(before)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            made = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
            made._scratch = edges._scratch  # for discard()
            return made
        state = tuple(seen)
