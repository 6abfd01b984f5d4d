import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import neardup, shingles
from brindle.llm.components import components


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def slow(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, s) in enumerate(sets):
        for j in range(i):
            e, t = sets[j]
            if d is not None and e is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def found(df, k, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.join(df, k, percent).collect()), key=str)


def slow_links(rows, k, percent):
    sets = [(d, shingle_set(t, k)) for d, t in rows]
    links = lambda i, j: i != j and sets[j][0] is not None and 100 * len(sets[i][1] & sets[j][1]) >= percent * len(sets[i][1] | sets[j][1])
    return sorted(((d, sum(links(i, j) for j in range(len(sets))) if s and d is not None else 0) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("block", [500, 9])
def test_links_are_counted_within_components(spark, odd, monkeypatch, block):
    monkeypatch.setattr(neardup, "LINKED", block)
    same_id = [(7, "one two three four five six"), (7, "other words that have nothing in common"), (8, "one two three four five six"), (None, "one two three four five six")]
    tables = [spark.createDataFrame(rows, "doc_id long, text string") for rows in ((planted(), same_id) if block == 500 else (planted(),))]
    for df in tables + [odd] * (block == 500):
        got = sorted(((r.doc_id, r.n_links) for r in neardup.join(df, 4, 85).collect()), key=str)
        assert got == slow_links(texts_of(df), 4, 85)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_query(spark, sf):
    want = slow(texts_of(spark.read.parquet(f"{sf}/documents.parquet")), 4, 85)
    assert sorted((tuple(r) for r in neardup.op1(spark, sf).collect()), key=str) == want


def planted():
    """Copies, near copies of a base, chains of edits, a passage in half of all texts."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghiklmnoprst", k=rng.randint(2, 8))) for _ in range(3000)]
    say = lambda n: rng.choices(vocabulary, k=n)

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return words

    base, passage, texts = say(150), say(60), []
    texts += [" ".join(edited(base, rng.randint(1, 6))) for _ in range(60)]
    chain = say(90)
    for _ in range(25):
        chain = edited(chain, 2)
        texts.append(" ".join(chain))
    texts += [" ".join([*say(rng.randint(2, 60)), *passage, *say(rng.randint(2, 60))]) for _ in range(80)]
    texts += [" ".join(say(rng.randint(1, 120))) for _ in range(60)] + ["same words here again and again"] * 12 + ["Same  WORDS here\tagain and again"]
    texts += [" ".join([*passage, *say(n)]) for n in range(1, 14)]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_planted(spark, k, percent):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df, k, percent) == slow(rows, k, percent)


def test_large_tiles_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 7)
    monkeypatch.setattr(neardup, "HELD", 7)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "HUB", 3)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, "5")
    try:
        rows = planted()
        assert found(spark.createDataFrame(rows, "doc_id long, text string"), 3, 70) == slow(rows, 3, 70)
    finally:
        spark.conf.set(most, before)


def test_neighbouring_bands_hold_all_sizes_within_the_ratio():
    for percent in (60, 80, 85):
        for n in range(1, 4000):
            assert neardup.band(n * 100 // percent, percent) - neardup.band(n, percent) in (0, 1)


def test_hot_members_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SKETCH", 1 << 8)
    monkeypatch.setattr(neardup, "frequent_cells", lambda docs, k: list(range(0, 1 << 8, 2)))
    rows = planted()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85) == slow(rows, 4, 85)


def test_unrelated_texts_make_no_pairs(spark, monkeypatch):
    """Texts that share rare shingles by chance: pairs that leave the tiles must not grow with the square of the texts."""
    emitted, real = [], neardup.written

    def counted(df, tag, *rest):
        out = real(df, tag, *rest)
        if tag == "near-pairs":
            emitted.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counted)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    for n in (250, 1000):
        texts = [" ".join(rng.choices(vocabulary, k=rng.randint(200, 600))) for _ in range(n)]
        rows = neardup.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85)
        assert rows.where("n_links > 0").count() == 0
    assert emitted[1] <= 4 * max(emitted[0], 1)


def test_odd_rows(spark, odd, none):
    assert found(odd, 4, 85) == slow(texts_of(odd), 4, 85)
    assert neardup.join(none).collect() == []
    kept = neardup.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(1, 11), None], key=str)


def test_one_stays(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.without_copies(df, 5, 80).collect()) == sorted({c for _, _, c in slow(rows, 5, 80)})


def test_rows_that_share_an_id_go_by_their_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "quite another text without any link to it"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "lone words of number three here"), (2, "second text of number two is alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([rows[0], rows[1], rows[4], rows[5]])
    assert sorted(tuple(r) for r in neardup.without_copies(df, 5, 80).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB c\n\té", max_size=40), max_size=5), st.integers(1, 4))
def test_sets(texts, k):
    made = shingles.sets(texts, k)
    wanted = [shingle_set(t, k) for t in texts]
    assert [len(s) for s in made] == [len(w) for w in wanted]
    for i, a in enumerate(wanted):
        for j, b in enumerate(wanted):
            assert len(np.intersect1d(made[i], made[j])) == len(a & b)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6])
def test_arrangements_of_the_same_words_differ(k):
    runs = list(itertools.product(["the", "and", "of"], repeat=k))
    text = " x ".join(" ".join(r) for r in runs)
    assert len(shingles.sets([text], k)[0]) == len(shingle_set(text, k))


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        sa, sb = neardup.bitmap(a, neardup.band_bits(len(a))), neardup.bitmap(b, neardup.band_bits(len(b)))
        size = min(len(sa), len(sb))
        apart = int(np.bitwise_count(neardup.folded(sa, size) ^ neardup.folded(sb, size)).sum())
        assert (len(a) + len(b) - apart) / 2 >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
