import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import dualtree


def slow(rows, k=10, scale=1024, step=100):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % step == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in good if c != q and len(a) == len(b))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(dualtree.op7(spark, sf)) == slow(rows)


SCHEMA = "vec_id long, embedding array<float>, score int, label int"


def test_ties_blocks_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(700)]
    vectors += [(1000, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (1400, [1.0, 2.0]), (None, [1.0] * 6), (1500, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], SCHEMA)
    want = slow([(i, v) for i, v in vectors if v != []], scale=4)
    got = found(dualtree.top_k(df, F.col("vec_id") % 100 == 0, scale=4, block=90, share=3))
    assert got == want
    assert found(dualtree.top_k(df.limit(0), F.col("vec_id") % 100 == 0)) == []


def test_few_and_equal(spark):
    df = spark.createDataFrame([(0, [0.5, 0.25]), (5, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert found(dualtree.top_k(df, F.col("vec_id") == 0)) == [(0, 1, 3, 512 * 1024), (0, 2, 5, 512 * 1024)]


def ask(x, ids, y, names, k, count=None):
    return sorted(zip(*(c.tolist() for c in dualtree.search(x, np.array(ids), np.full(len(ids), -np.inf), dualtree.Candidates(y, np.array(names)), k, count)), strict=True))


def test_large_numbers():
    assert ask(np.array([[2**40 + 1, 3]]), [0], np.array([[2**20, 1], [2**20, 2]]), [1, 2], 1) == [(0, 2, (2**40 + 1) * 2**20 + 6)]


@pytest.mark.parametrize("kind", ["clusters", "sphere", "lengths", "zeros"])
def test_pruning_is_exact_and_real(kind):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 64))
    x = centers[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 64))
    if kind == "sphere":
        x /= np.sqrt((x * x).sum(1))[:, None]
    if kind == "lengths":
        x *= rng.lognormal(size=4000)[:, None]
    if kind == "zeros":
        x[::3] = 0
    x, ids, count = np.floor(1024 * x).astype(np.int64), np.arange(4000), [0]
    asked = ids % 20 == 0
    got = ask(x[asked], ids[asked], x, ids, 10, count)
    scores = x[asked] @ x.T
    want = []
    for q, s in zip(ids[asked], scores, strict=True):
        order = np.lexsort((ids, -s))
        want += [(int(q), int(c), int(s[c])) for c in order[order != q][:10]]
    assert got == sorted(want)
    if kind != "zeros":
        assert count[0] < 0.8 * scores.size, count[0] / scores.size


def test_cells_split_and_queries_shared(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(v) for v in c]) for i, c in enumerate(rng.normal(size=(900, 7)))] + [(2000 + i, [0.0] * 7) for i in range(40)] + [(100, [1.0] * 7), (100, [-1.0] * 7)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    assert found(dualtree.top_k(df, F.col("vec_id") % 100 == 0, block=50, share=2).where("query_id <> 100")) == [r for r in slow([(i, v) for i, v in vectors]) if r[0] != 100]


def test_rows_of_one_id_are_parted(spark):
    """A third of all rows has one id: no block's task gets all of them."""
    rng = np.random.default_rng(6)
    vectors = [(i, [float(v) for v in c]) for i, c in enumerate(rng.normal(size=(600, 5)))] + [(777, [2.0] * 5)] * 300
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = dualtree.top_k(df, F.col("vec_id") % 100 == 0, block=60)
    assert found(got) == slow(vectors)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(row" in plan


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_tree_covers(leaf):
    x = np.random.default_rng(2).normal(size=(500, 5))
    tree = dualtree.CoverTree(x, leaf)
    for c, r, kids, rows, turn in zip(tree.center, tree.radius, tree.children, tree.points, tree.cone, strict=True):
        assert np.arccos(np.clip(x[rows] @ x[c] / (np.linalg.norm(x[rows], axis=1) * np.linalg.norm(x[c])), -1, 1)).max() <= turn
        assert np.sqrt(((x[rows] - x[c]) ** 2).sum(1)).max() <= r + 1e-9
        if kids:
            assert sorted(np.concatenate([tree.points[k] for k in kids])) == sorted(rows)
