import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from brindle.llm import lattice

FILE = public_tokenizers.path("piece_bpe_32k.model")


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</end>"]


def check(docs, rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    train = Counter(w for d, t in texts if not held(d) for w in words_of(t))
    n, v = sum(train.values()), len(train)
    want = sorted(
        ((str(d), held(d), len(w := words_of(t)), sum(x in train for x in w), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for d, t in texts),
        key=str,
    )
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-6)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


def test_query(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), lattice.op8(spark, sf).collect())


def test_small_blocks_and_head(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.score for r in lattice.score(docs, FILE).collect()}
    parted = lattice.score(docs.repartition(5), FILE, head=3).collect()
    check(docs, parted)
    assert {r.doc_id: r.score for r in parted} == pytest.approx(whole, rel=1e-9)


def test_odd_rows(odd, none):
    check(odd, lattice.score(odd, FILE).collect())
    assert lattice.score(none, FILE).collect() == []


def test_marginal_is_the_sum_over_segmentations():
    model = lattice.Lattice(FILE, {}, 1)

    def total(s):
        if not s:
            return 1.0
        out = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in model.piece:
                out += math.exp(model.piece[s[:k]]) * total(s[k:])
        if s[0] not in model.piece:
            out += math.exp(sum(model.byte[b] for b in s[0].encode())) * total(s[1:])
        return out

    for word in ("the", "nation", "übung", "漢x🎉", "a"):
        assert model.marginal(word) == pytest.approx(math.log(total("▁" + word)))
    assert sum(map(math.exp, [*model.piece.values(), *model.byte.values(), model.end])) == pytest.approx(1.0)


def segmentations(model, s):
    """All (log probability, numbers of pieces) of a string."""
    if not s:
        return [(0.0, ())]
    heads = [(model.piece[s[:k]], (model.number[s[:k]],), s[k:]) for k in range(1, len(s) + 1) if s[:k] in model.piece]
    if s[0] not in model.piece:
        raw = s[0].encode()
        heads.append((sum(model.byte[b] for b in raw), tuple(model.byte_number[b] for b in raw), s[1:]))
    return [(p + q, ids + more) for p, ids, rest in heads for q, more in segmentations(model, rest)]


@pytest.mark.parametrize("short", [30, 0])
def test_expected_counts_are_those_of_all_segmentations(monkeypatch, short):
    monkeypatch.setattr(lattice, "SHORT", short)
    model = lattice.Lattice(FILE, {}, 1)
    for word, times in (("the", 3), ("nation", 1), ("übung", 7), ("漢x🎉", 2)):
        total = [0] * lattice.processor(FILE).get_piece_size()
        model.expect(word, times, total)
        found = segmentations(model, "▁" + word)
        whole, want = sum(math.exp(p) for p, _ in found), Counter()
        for p, ids in found:
            for i in ids:
                want[i] += times * math.exp(p) / whole
        assert {i: n / lattice.PART for i, n in enumerate(total) if n > 20} == pytest.approx({i: n for i, n in want.items() if n * lattice.PART > 20}, abs=1e-4)


def test_score_is_the_sum_of_words_over_all_segmentations(spark):
    """The document's score, from counting to adding up, worked out by enumeration."""
    texts = ["The cat sat on the mat", "a mat and a cat", "übung the", "", "cat nap"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:4] + [next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)]
    rows = lattice.score(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), FILE).collect()
    train = Counter(w for t in texts[:4] for w in words_of(t)[:-1])
    cut, counts = lattice.processor(FILE), Counter()
    for w, c in train.items():
        for i in cut.encode(w):
            counts[i] += c
    first, expected = lattice.Lattice(FILE, counts, 4), Counter()
    for w, c in train.items():
        found = segmentations(first, "▁" + w)
        whole = sum(math.exp(p) for p, _ in found)
        for p, pieces in found:
            for i in pieces:
                expected[i] += c * math.exp(p) / whole
    model = lattice.Lattice(FILE, expected, 4)
    for r in rows:
        words = words_of(texts[ids.index(r.doc_id)])[:-1]
        want = model.end + sum(math.log(sum(math.exp(p) for p, _ in segmentations(model, "▁" + w))) for w in words)
        assert r.score == pytest.approx(want / math.log(10), rel=1e-5)


def test_training_words_gain(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat('zyxwvq marble ', 5) AS text")
    scores = {r.doc_id: r.score for r in lattice.score(rows.unionAll(spark.createDataFrame([(10**6, "plinth sconce " * 5)], rows.schema)), FILE).collect()}
    assert scores[0] > scores[10**6]
