import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe

FILE = tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TO_IDS, TO_BYTES = bpe.codec(FILE, tokenizers.PATTERN)


def ids(text):
    return np.frombuffer(TO_IDS(text), "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aab 's\n\t\x1c\x85  é漢3", max_size=80))
def test_equals_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert TO_BYTES(TO_IDS(text)) == text.encode()


def test_long_pre_tokens():
    rng = random.Random(5)
    for text in ("a" * 40_000, "".join(rng.choices("abcdeést", k=60_000)), "=" * 5000, "ab" * 10_000):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_memory_is_bounded():
    small = bpe.Remembered(RANKS, limit=3)
    for t in ("one", "two", "three", "four", "five", "one"):
        assert np.frombuffer(small[t], "<u4").tolist() == bpe.encode_piece(t.encode(), RANKS)
    assert len(small) <= 3


def test_queue_order():
    q = bpe.RankQueue()
    pairs = [(random.Random(i).randrange(50_000), i) for i in range(300)] + [(7, 3), (7, 1), (7, 2)]
    for p in pairs:
        q.push(*p)
    assert [q.pop() for _ in pairs] == sorted(pairs) and not q


def test_query_and_odd_rows(spark, sf, odd, none):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op3(spark, sf).collect():
        want = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    made = bpe.encode(odd, FILE, tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(made, FILE, tokenizers.PATTERN).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.collect()}
    assert bpe.encode(none, FILE, tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("text", ["", " ", "\r\n  x", "don't 'LL", "１２３ ४५"])
def test_corner_texts(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
