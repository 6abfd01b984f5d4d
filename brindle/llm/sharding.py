"""Sharding by a k-d tree over document metadata.

The unit is a group of equal texts (one row after a partial aggregation, so a
text with any number of copies weighs one row). A node with a quota of k
shards is cut along its widest metadata dimension at the weighted quantile
that gives each side its share of the bytes; for two, four, eight shards that
is the weighted median. The tree is cut a level at a time: each row carries its
node, and a table of one row a node holds what is known of it. Quantiles come
from histograms of at most ``BINS`` counts a node that are summed, searched and
refined on the executors; the driver sees neither counts nor cuts, and no
expression grows with the number of shards. The documents themselves move
twice: to their text's shard, and to their slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import discard, documents, numbered, scratch, written

BINS = 1 << 15
#: A cut is final when the bin that it falls into holds at most this share of the node.
FINE = 0.0005
#: Dimensions are scaled to so many bits within a node; ties go by checksum.
BITS = 30


def metadata(docs: DataFrame, *others: Column | str) -> DataFrame:
    """doc_id, size, text_crc32 and the text's identity and dimensions; and others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("mark"),
        F.length(text).cast("long").alias("chars"),
        *others,
    )


def groups(meta: DataFrame) -> DataFrame:
    """One row for each text: bytes of all copies, and the metadata dimensions:
    log size, share of one-byte characters, and place in the corpus."""
    return meta.groupBy("mark", "text_crc32", "size", "chars").agg(F.sum("size").alias("weight"), F.min("doc_id").cast("double").alias("d2")).select(
        "mark", "text_crc32", "size", "chars", "weight", F.log2("size").alias("d0"), (F.col("chars") / F.col("size")).alias("d1"), F.coalesce("d2", F.lit(-1.0)).alias("d2"))


DIMS = ("d0", "d1", "d2")


def key() -> Column:
    """A row's place along its node's dimension as a whole number; equal values
    go by checksum, so only equal texts can't be parted."""
    value = F.element_at(F.array(*DIMS), F.col("dim") + 1)
    scaled = F.floor((value - F.col("low")) / (F.col("high") - F.col("low")) * (2**BITS - 1)).cast("long")
    scaled = F.when(F.col("high") > F.col("low"), F.greatest(F.least(scaled, F.lit(2**BITS - 1)), F.lit(0))).otherwise(F.lit(0))
    return F.shiftleft(scaled.cast("long"), 32) + F.col("text_crc32")


def measured(rows: DataFrame, scale: list[float] | None) -> tuple[DataFrame, list[float]]:
    """One row for each open node (first shard, quota above 1): its weight, its
    widest dimension against the whole table's spans, and that one's range."""
    spans = [f(d).alias(f"{f.__name__}_{d}") for d in DIMS for f in (F.min, F.max)]
    nodes = rows.where("quota > 1").groupBy("first", "quota").agg(F.sum("weight").alias("weight"), *spans)
    if scale is None:  # the root
        root = nodes.first()
        scale = [root[f"max_{d}"] - root[f"min_{d}"] or 1.0 for d in DIMS] if root else [1.0] * len(DIMS)
    wide = [(F.col(f"max_{d}") - F.col(f"min_{d}")) / F.lit(x) for d, x in zip(DIMS, scale, strict=True)]
    dim = F.array_position(F.array(*wide), F.array_max(F.array(*wide))).cast("int") - 1
    nodes = nodes.select("*", dim.alias("dim"))
    of = lambda end: F.element_at(F.array(*[F.col(f"{end}_{d}") for d in DIMS]), F.col("dim") + 1)
    long = lambda n: F.lit(n).cast("long")
    return nodes.select("first", "quota", "weight", "dim", of("min").alias("low"), of("max").alias("high"), long(0).alias("start"), long(2 ** (BITS + 32)).alias("stop"), long(0).alias("before"), long(0).alias("cut"), F.lit(False).alias("done")), scale


def refined(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with the bin that holds the quantile in place of the range before."""
    step = F.greatest(F.ceil((F.col("stop") - F.col("start")) / BINS).cast("long"), F.lit(1))
    inside = rows.join(nodes.where("NOT done").select("first", "quota", "dim", "low", "high", "start", "stop"), ["first", "quota"])
    inside = inside.select("first", "weight", "start", "stop", step.alias("step"), key().alias("key")).where("key >= start AND key < stop")
    bins = inside.groupBy("first", F.expr("(key - start) div step").alias("bin")).agg(F.sum("weight").alias("w"))
    state = nodes.select("first", "weight", "quota", "before")
    upto = Window.partitionBy("first").orderBy("bin")
    run = bins.withColumn("run", F.sum("w").over(upto)).join(state, "first")
    goal = F.col("weight") * F.floor(F.col("quota") / 2) / F.col("quota")
    hit = run.where(F.col("before") + F.col("run") >= goal).groupBy("first").agg(F.min(F.struct("bin", "run", "w")).alias("hit"))
    moved = nodes.join(hit, "first", "left")
    h = F.col("hit")
    start = F.col("start") + h["bin"] * step
    stop = F.least(F.col("stop"), start + step)
    before = F.col("before") + h["run"] - h["w"]
    cut = F.when(goal - before < before + h["w"] - goal, start).otherwise(stop)
    done = (h["w"] <= F.col("weight") * FINE) | (stop - start <= 1)
    new = lambda value, name: F.when(h.isNull(), F.col(name)).otherwise(value).alias(name)
    return moved.select("first", "quota", "weight", "dim", "low", "high", new(start, "start"), new(stop, "stop"), new(before, "before"), new(cut, "cut"), F.coalesce(done, F.lit(True)).alias("done"))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """rows with ``shard``: the leaf of the tree with so many leaves."""
    rows = written(rows.select("*", F.lit(0).alias("first"), F.lit(shards).alias("quota")), "shard-level")
    most, scale = shards, None
    while most > 1:
        nodes, scale = measured(rows, scale)
        nodes = written(nodes, "shard-nodes")
        while nodes.where("NOT done").limit(1).count():
            nodes, old = written(refined(rows, nodes), "shard-nodes"), nodes
            discard(old)
        half = F.floor(F.col("quota") / 2).cast("int")
        left = F.coalesce(key() < F.col("cut"), F.lit(True))
        cut = F.col("cut").isNotNull()
        first = F.when(cut & ~left, F.col("first") + half).otherwise(F.col("first"))
        quota = F.when(~cut, F.col("quota")).when(left, half).otherwise(F.col("quota") - half)
        placed = rows.join(nodes.select("first", "quota", "dim", "low", "high", "cut"), ["first", "quota"], "left")
        made = written(placed.select(*[c for c in rows.columns if c not in ("first", "quota")], first.alias("first"), quota.alias("quota")), "shard-level")
        discard(rows, nodes)
        rows, most = made, most - most // 2
    return rows.withColumnRenamed("first", "shard")


#: Documents of a part of a shard, on average.
PART_ROWS = 50_000


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Deal documents to shards of nearly equal bytes.

    Returns doc_id, size, text_crc32, shard, slot (from 0, gapless within a
    shard), part (a run of slots) and document: a struct of all columns of
    docs. Give the number of shards or the bytes of one. Copies of a text
    share a shard. A null text counts as empty (size 1); repeated rows each
    get a slot; an empty table gives no rows; columns may have any names.
    """
    rows = written(groups(metadata(docs)), "shard-groups")
    if shards is None:
        total = rows.agg(F.sum("weight")).first()[0] or 0
        shards = max(1, round(total / target_bytes)) if target_bytes else 1
    leaves = dealt(rows, shards)
    discard(rows)
    # a group's third dimension is its first document's place, so its shard is looked up by identity
    placed = leaves.select("mark", "text_crc32", "size", "chars", "shard")
    whole = metadata(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    found = whole.join(placed, ["mark", "text_crc32", "size", "chars"]).select("doc_id", "size", "text_crc32", "document", "shard")
    return numbered(found, ["shard"], ["doc_id", "text_crc32"], "slot", PART_ROWS, 4, "part")


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None) -> None:
    """Write each shard to ``path``: shard=S/part=P holds documents (all
    columns, in ``document``) with their slots in order, and the parts of a
    shard, by number, follow each other in order of slot."""
    out = shard(docs, shards, target_bytes).select("slot", "document", "shard", "part")
    out.sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path, compression="zstd")


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """What write_shards has written of ``docs``: slot, document, shard, part."""
    fields = [("slot", T.LongType()), ("document", docs.schema), ("shard", T.IntegerType()), ("part", T.IntegerType())]
    return spark.read.schema(T.StructType([T.StructField(n, t) for n, t in fields])).parquet(path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    path = f"{scratch(spark)}/brindle-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, shards=8)
    kept = read_shards(spark, path, docs).select("document.doc_id", "document.text", "shard", "slot")
    out = metadata(kept, "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
