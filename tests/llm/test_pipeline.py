import __spark_entry__ as entries
import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test")
        assert docs.columns == names
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] == kept[3]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(d) == 0 for d in kept[0]) <= 3  # some seventy labels teach it here
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == kept[3]


def test_odd_columns_come_through(spark, odd, none, sf):
    docs = odd.withColumnsRenamed({"size": "score", "shard": "kept", "rank": "pii"})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.schema["kept"].dataType.simpleString() == "string"
        assert all((r["score"], r["kept"], r["pii"]) == (9, "clash", 0) for r in out.collect())
        assert stage(spark, none, sf).collect() == []


def test_registered():
    names = entries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
