import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from brindle.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def exact():
    made = Tokenizer.from_file(FILE)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


ENCODE = exact()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=[chr(i) for i in range(0x250)], max_size=60))
def test_encoder_equals_library(text):
    assert packing.encoder(FILE)(text).tolist() == ENCODE(text)


def test_each_latin_character():
    for i in range(0x250):
        for text in (chr(i), f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)}1"):
            assert packing.encoder(FILE)(text).tolist() == ENCODE(text)


def check(docs, rows):
    texts = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=str)
    whole = {}
    for doc, text in texts:
        whole.setdefault(doc, np.array([*ENCODE(text), 0], "<u4"))
    places, got = defaultdict(list), defaultdict(int)
    for r in rows:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
    for doc, n in got.items():
        assert n == len(whole[doc]) * sum(d == doc for d, _ in texts)
    padding = total = 0
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 1024
        total += end
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert total == sum(got.values()) and set(got) == {d for d, _ in texts}
    return padding / max(1, total)


def test_query(spark, sf):
    assert check(spark.read.parquet(f"{sf}/documents.parquet"), packing.op9(spark, sf).collect()) < 0.2


def test_odd(odd, none):
    check(odd, packing.pack(odd, FILE).collect())
    assert packing.pack(none, FILE).collect() == []


def test_sequences_hold_the_tokens(odd):
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    sequences = defaultdict(list)
    for r in packing.pack(odd, FILE).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == [*ENCODE(texts[r.doc_id]), 0][r.start : r.start + r.length] and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, ids))
    for found in sequences.values():
        packed = []
        for offset, ids in sorted(found):
            assert offset == len(packed)
            packed += ids
        assert 0 < len(packed) <= 1024


def test_cuts():
    for n in range(3000):
        assert sum(packing.cuts(n)) == n and all(0 < x <= 1024 for x in packing.cuts(n))


def test_fast_engine_agrees_on_a_whole_corpus():
    made, encode = Tokenizer.from_file(FILE), packing.encoder(FILE)
    made.encode_special_tokens = True
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for text, want in zip(texts, made.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids
