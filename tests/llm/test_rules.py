import random
import re
from collections import Counter

import pytest
import zstandard

from brindle.llm import rules


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    inside = {j for i, g in enumerate(grams) if times[g] > 1 for j in (i, i + 1, i + 2)}
    seen, duplicates = set(), 0
    for x in text.split("\n"):
        duplicates += bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in seen
        seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(inside), n < 50 or 100 * len(inside) > 50 * n


def fits(text, bands=rules.Bands()):  # noqa: B008
    """The bands' verdict by itself, from the library's one-shot function."""
    raw = (text or "").encode()
    if not raw:
        return True
    share = lambda b: len(zstandard.compress(b, bands.level)) / len(b)
    limits = [(least, most) for upto, least, most in bands.whole if len(raw) <= upto][0]
    chunks = [raw[i : i + bands.chunk] for i in range(0, len(raw), bands.chunk)]
    counted = [share(c) for c in chunks if len(c) >= bands.chunk / 2]
    bad = [r for r in counted if r < bands.chunk_least or r > bands.chunk_most]
    return limits[0] <= share(raw) <= limits[1] and len(bad) <= bands.bad_share * len(counted)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = rules.op4(spark, sf).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = slow(texts[r.doc_id])
        assert tuple(r)[1:7] == want
        assert r.kept == (not want[5] and fits(texts[r.doc_id]))
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept


def test_bands(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(4000)]
    prose = " ".join(rng.choices(vocabulary, k=1500))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(20)) for _ in range(300))
    stencil = "\n".join(f"item {i} costs {i % 7} and ships in box {i % 11} to the usual place" for i in range(300))
    rows = spark.createDataFrame([(1, prose), (2, noise), (3, stencil)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in rules.judge(rows, ["doc_id"]).collect()} == {1: True, 2: False, 3: False}


def test_incompressible_text_fails_at_each_length(spark):
    rng = random.Random(5)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    printable = "".join(map(chr, range(33, 127)))
    vocabulary = ["".join(rng.choices("eeeetttaaooiinnsshrrdllucmfpgwybvk", k=rng.randint(2, 9))) for _ in range(1500)]

    def of(alphabet, size):  # 50 words or more
        out = ""
        while len(out) < size:
            out += "".join(rng.choices(alphabet, k=rng.randint(4, 8 if size < 600 else 14))) + " "
        return out[:size]

    def prose(size):
        return " ".join(rng.choices(vocabulary, [1 / (i + 3) for i in range(1500)], k=size))[:size]

    sizes = (390, 590, 790, 990, 1400, 2000, 2048, 3000, 3900, 8000, 16_000, 50_000)
    noise = [of(a, n) for n in sizes for a in (base64, printable)]
    mixed = [prose(n // 2) + " " + of(base64, n // 2) for n in (4000, 8000, 16_000, 22_000, 60_000)]
    clean = [prose(n) for n in sizes]
    rows = spark.createDataFrame(list(enumerate([*noise, *mixed, *clean])), "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in rules.judge(rows, ["doc_id"]).collect()}
    first = len(noise) + len(mixed)
    assert not any(kept[i] for i in range(first)), [i for i in range(first) if kept[i]]
    assert all(kept[first + i] for i in range(len(clean))), [n for i, n in enumerate(sizes) if not kept[first + i]]


def test_odd(odd, none):
    rows = rules.judge(odd, odd.columns).collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(rows[0].asDict())
    assert not any(r.kept for r in rows if not r.text)
    assert rules.judge(none, none.columns).collect() == []


@pytest.mark.parametrize("text", ["a a a a", "a b c a b c", "x y z", "", "q q"])
def test_repeated(text):
    assert rules.repeated(text.split()) == slow(text)[4]
