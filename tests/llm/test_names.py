"""Every operator and every stage: columns of any name, settings left alone."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import bpe, crf, dualtree, lattice, neardup, packing, pii, rules, secrets, sharding

CLASHES = [
    "a.b", "a`b", "found", "pii", "score", "predicted", "kept", "ids", "own", "cell", "key", "h", "n", "block", "word", "size", "shard", "slot", "document", "mark", "weight",
    "_0", "_1", "_text", "__text", "__own", "__cell", "__0", "__hits", "__new", "__bucket", "klass", "n_words", "ratio", "component_id", "first", "quota", "column_0",
]
PLAIN = [c for c in CLASHES if "`" not in c]


@pytest.fixture(scope="module")
def named(odd):
    out = odd.select("doc_id", "text")
    for c in PLAIN:
        out = out.withColumn(c, F.lit(c))
    return out


def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


OPERATORS = {
    "join": lambda s, d, sf: neardup.join(d),
    "without_copies": lambda s, d, sf: neardup.without_copies(d),
    "shard": lambda s, d, sf: sharding.shard(d, shards=2),
    "encode": lambda s, d, sf: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "judge": lambda s, d, sf: rules.judge(d, d.columns),
    "replace_personal": lambda s, d, sf: pii.replace_personal(d, "k"),
    "scan": lambda s, d, sf: secrets.scan(d, d.columns),
    "score": lambda s, d, sf: lattice.score(d, public_tokenizers.path("piece_bpe_32k.model")),
    "pack": lambda s, d, sf: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")),
    "classify": lambda s, d, sf: crf.classify(d, labels(s, sf), d.columns),
    "top_k": lambda s, d, sf: dualtree.top_k(d.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.length("text"), F.lit(1))), F.lit(True), k=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, sf, named, name):
    before = dict(r[:2] for r in spark.sql("SET").collect())
    out = OPERATORS[name](spark, named, sf)
    rows = out.collect()
    assert dict(r[:2] for r in spark.sql("SET").collect()) == before
    assert len(rows) >= (10 if name == "without_copies" else 1)
    if name in ("judge", "replace_personal", "scan", "classify"):
        assert len(rows) == named.count()
        lost = {"judge": {"kept", "n_words", "ratio"}, "replace_personal": {"pii"}, "scan": {"found"}, "classify": {"score", "predicted"}}[name]
        for c in set(PLAIN) - lost:
            assert {r[out.columns.index(c)] for r in rows} == {c}
    if name == "shard":
        assert rows[0].document["a.b"] == "a.b" and rows[0].document.asDict().keys() == set(named.columns)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf, named, stage):
    before = dict(r[:2] for r in spark.sql("SET").collect())
    out = dict(corpus_pipeline.STAGES)[stage](spark, named, sf)
    rows = out.collect()
    assert dict(r[:2] for r in spark.sql("SET").collect()) == before
    if stage != "packing":
        assert out.columns == named.columns
        for c in PLAIN:
            assert {r[out.columns.index(c)] for r in rows} <= {c}


def test_runs_bound_bytes_and_rows():
    import pyarrow as pa

    from brindle.llm.common import runs

    texts = ["x" * n for n in (10, 3000, 10, 10, 5000, 1, 1, 1, 1)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    got = list(runs([batch, batch.slice(0, 0)], 1, rows=3, most=100))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts
    assert all(b.num_rows <= 3 and (b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 100) for b in got)
