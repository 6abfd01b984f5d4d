import math
import time
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from brindle.llm import sharding


def test_shards_are_even_and_gapless(spark, sf):
    rows = sharding.op2(spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    weight, slots, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = docs[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
        texts[raw].add(r.shard)
    assert len(rows) == len(docs) and set(weight) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in texts.values())
    assert max(weight.values()) - min(weight.values()) <= 2 * max(map(len, docs.values()))


def test_odd_rows(odd, none):
    rows = sharding.shard(odd, shards=4).collect()
    assert len(rows) == odd.count()
    assert {r.shard for r in rows if r.doc_id == 5} == {next(r.shard for r in rows if r.doc_id == 5)}
    assert sharding.shard(none, shards=4).collect() == []
    assert {r.shard for r in sharding.shard(odd, target_bytes=10**9).collect()} == {0}


def test_three_shards(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', CAST(id % 40 AS INT)) || id AS text")
    sums = [r[0] for r in sharding.shard(docs, shards=3).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(sums) == 3 and max(sums) - min(sums) < 0.02 * sum(sums)


def test_documents_are_written_to_their_shards_in_order(spark, odd, none, sf, tmp_path):
    for name, docs in (("odd", odd), ("sf", spark.read.parquet(f"{sf}/documents.parquet"))):
        path = tmp_path / name
        sharding.write_shards(docs, str(path), shards=4)
        slots, back = defaultdict(list), []
        folders = [f for f in path.glob("shard=*/part=*")]
        for folder in sorted(folders, key=lambda f: (f.parent.name, int(f.name.split("=")[1]))):
            files = list(folder.glob("*.parquet"))
            assert len(files) == 1
            for row in pq.ParquetFile(files[0]).read().to_pylist():
                slots[folder.parent.name].append(row["slot"])
                back.append(tuple(row["document"].values()))
        assert all(s == list(range(len(s))) for s in slots.values())
        assert sorted(back, key=str) == sorted(map(tuple, docs.collect()), key=str)
        read = sharding.read_shards(spark, str(path), docs).select("document.*")
        assert read.schema == docs.schema and read.exceptAll(docs).count() == 0 == docs.exceptAll(read).count()
    sharding.write_shards(none, str(tmp_path / "none"), shards=4)
    assert sharding.read_shards(spark, str(tmp_path / "none"), none).collect() == []


def plain_tree(rows, shards):
    """The k-d tree by itself: rows are (dims, crc, weight); gives each row's shard."""
    shard = [0] * len(rows)
    spans = lambda some: [max(rows[i][0][d] for i in some) - min(rows[i][0][d] for i in some) for d in range(3)]
    scale = [x or 1.0 for x in spans(range(len(rows)))]

    def cut(some, first, quota):
        if quota == 1 or not some:
            for i in some:
                shard[i] = first
            return
        wide = [x / s for x, s in zip(spans(some), scale, strict=True)]
        d = wide.index(max(wide))
        low, high = min(rows[i][0][d] for i in some), max(rows[i][0][d] for i in some)
        place = {i: ((min(max(math.floor((rows[i][0][d] - low) / (high - low) * (2**sharding.BITS - 1)), 0), 2**sharding.BITS - 1) if high > low else 0) << 32) + rows[i][1] for i in some}
        weight = defaultdict(int)
        for i in some:
            weight[place[i]] += rows[i][2]
        goal, before = sum(weight.values()) * (quota // 2) / quota, 0
        for at in sorted(weight):
            if before + weight[at] >= goal:
                break
            before += weight[at]
        edge = at if goal - before < before + weight[at] - goal else at + 1
        cut([i for i in some if place[i] < edge], first, quota // 2)
        cut([i for i in some if place[i] >= edge], first + quota // 2, quota - quota // 2)

    cut(list(range(len(rows))), 0, shards)
    return shard


@pytest.mark.parametrize("shards", [2, 8, 11])
def test_against_a_plain_tree(spark, odd, sf, monkeypatch, shards):
    monkeypatch.setattr(sharding, "FINE", 0.0)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    texts = list(groups)
    rows = []
    for t in texts:
        raw = t.encode()
        ids = [i for i in groups[t] if i is not None]
        size = len(raw) + 1
        rows.append(((math.log2(size), len(t) / size, float(min(ids)) if ids else -1.0), zlib.crc32(raw), size * len(groups[t])))
    want = dict(zip(texts, plain_tree(rows, shards), strict=True))
    got = {(r.text or "", r.shard) for r in sharding.shard(docs, shards=shards).select("document.text", "shard").collect()}
    assert got == set(want.items())


def test_many_shards(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('ab ', CAST(id % 40 AS INT)) || id AS text")
    began = time.time()
    sums = [r[0] for r in sharding.shard(docs, shards=500).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(sums) == 500 and max(sums) <= 2.5 * sum(sums) / 500
    assert time.time() - began < 120
