import itertools

import numpy as np
import pytest

from brindle.llm import crf


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    unary, join = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    real = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    good, joins, z = crf.marginals(np.where(real, unary, 0), real, join)
    expected = np.zeros((2, 2))
    for d in range(3):
        n = real[d].sum()
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = np.exp(sum(unary[d, t] * y[t] for t in range(n)) + sum(join[y[t], y[t + 1]] for t in range(n - 1)))
        total = sum(weights.values())
        assert z[d] == pytest.approx(np.log(total))
        for t in range(n):
            assert good[d, t] == pytest.approx(sum(w for y, w in weights.items() if y[t]) / total)
        for y, w in weights.items():
            for t in range(n - 1):
                expected[y[t], y[t + 1]] += w / total
    assert joins == pytest.approx(expected)


def test_held_out_accuracy(spark, sf):
    folder = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = crf.op10(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for held in (True, False):
        some = [r for r in rows if r.doc_id in labels and r.held_out == held]
        assert np.mean([r.predicted == labels[r.doc_id] for r in some]) > 0.95


def test_odd_rows(spark, odd, none, sf):
    labels = spark.createDataFrame([(1, 0, 5), (2, 1, 5), (5, 1, 1), (8, None, 1), (6, 7, 1), (None, 1, 1)], "doc_id long, quality int, text int")
    rows = crf.classify(odd, labels, odd.columns).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert crf.classify(none, labels, none.columns).collect() == []
    assert len({round(r.score, 9) for r in crf.classify(odd.where("doc_id > 2"), labels.limit(0), ["doc_id"]).collect()}) == 1


def test_labels_of_held_out_rows_are_never_read(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(crf.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = crf.train(docs, labels), crf.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.offset == b.offset


def test_sample_is_bounded_by_lines_and_by_ids(spark):
    """Long documents take part; rows that share an id come to the driver once."""
    assert crf.filled([(1, 5), (2, 9), (3, 4), (4, 1)], 10) == [1, 3, 4]
    good, bad = "A plain sentence of words here.", "BUY NOW!!! $$$ | $$$"
    texts = {i: "\n".join([good if i % 2 else bad] * 700) for i in range(12)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    rows = [*texts.items()] + [(1, texts[1])] * 500 + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    model, same = crf.train(docs, labels), crf.train(once, labels)
    assert np.array_equal(model.weights, same.weights) and (model.slope, model.offset) == (same.slope, same.offset)
    found = model.scores([crf.line_features(texts[1]), crf.line_features(texts[0])])
    assert found[0] > 0.7 > 0.3 > found[1]
    few = crf.train(docs, labels, sample_lines=1400)
    assert few.slope != model.slope


def test_chains_of_long_documents_keep_their_neighbours(monkeypatch):
    """One line short of a chain or several chains: the objective sees all lines."""
    rng = np.random.default_rng(4)
    texts = [crf.line_features("\n".join(rng.choice(["One good line.", "LOUD!!!", "a | b | c"], size=n, p=p))) for n, p in ((40, (0.8, 0.1, 0.1)), (35, (0.2, 0.4, 0.4)), (1, (1, 0, 0)), (20, (0.1, 0.5, 0.4)))]
    whole = crf.fit(texts, [1, 0, 1, 0])
    monkeypatch.setattr(crf, "CHAIN", 7)
    cut = crf.fit(texts, [1, 0, 1, 0])
    assert np.abs(whole.scores(texts) - cut.scores(texts)).max() < 0.1


def test_document_score_by_enumeration():
    """The weighted mean of all lines' probabilities over every labelling, then the curve."""
    rng = np.random.default_rng(12)
    model = crf.Model(rng.normal(size=crf.WIDTH), rng.normal(size=(2, 2)), 1.7, -0.4, 0.25)
    texts = ["One good line.\nTHEN A LOUD ONE!!!\n\nand | some | bars\nOne good line.", "single", "a\nb\nc\nd\ne\nf", "", "  \n\t"]
    featured = [crf.line_features(t) for t in texts]
    got = model.scores(featured)
    for (x, weight), score in zip(featured, got, strict=True):
        if not len(weight):
            assert score == 0.25
            continue
        unary = crf.with_neighbours(x) @ model.weights
        mass, good = 0.0, np.zeros(len(weight))
        for labels in itertools.product((0, 1), repeat=len(weight)):
            p = np.exp(sum(u for u, y in zip(unary, labels, strict=True) if y) + sum(model.join[a, b] for a, b in itertools.pairwise(labels)))
            mass += p
            good += p * np.array(labels)
        mean = (good / mass * weight).sum() / weight.sum()
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        assert score == pytest.approx(1 / (1 + np.exp(-(1.7 * np.log(mean / (1 - mean)) - 0.4))), rel=1e-6)
