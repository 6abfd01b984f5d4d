"""Harmonic packing of tokenized documents into fixed sequences.

A sequence holds ``capacity`` tokens. A document's ids are cut into full
sequences, then powers of two down to ``least``, then a tail. A piece of
length n is of class k = capacity // n (a length in (capacity/(k+1),
capacity/k]); a sequence of class k takes k pieces of that class. Which
sequence a piece goes to follows from its number in the class alone, so each
worker fills sequences without knowing the others' pieces; only the sizes of
(class, bucket) are exchanged. Powers of two fill sequences to the brim, and
tails are short, so the padding is a few tokens of a sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import documents, numbered, runs, worker_cache, written

CAPACITY = 1024
LEAST = 64
#: Beyond these characters two regex engines might class a character in
#: different ways, so such texts go through the tokenizers library itself.
ODD = re.compile("[^\x00-ɏ]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, others for 256 upwards in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(vocabulary: str):
    """text -> ids, equal to the tokenizers library's without special tokens.

    The vocabulary file's merges are ranks of byte strings; the ranks run in a
    faster engine, texts with unusual characters in tokenizers itself."""
    cache = worker_cache()
    if ("encoder", vocabulary) not in cache:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        letters = byte_alphabet()
        with open(vocabulary, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["content"] for t in made.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in made["model"]["vocab"].items() if piece not in special}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(vocabulary)
        exact.encode_special_tokens = True

        def encode(text: str) -> np.ndarray:
            if ODD.search(text):
                return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        cache["encoder", vocabulary] = encode
    return cache["encoder", vocabulary]


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= least and rest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return [*out, rest] if rest else out


PIECES = "doc_id long, start long, length long, mark long, doc_tokens long, klass int, ids binary"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """Tokenize documents and cut them. Each piece carries its ids; ``mark``, a
    checksum of them, parts pieces of equal places in the order of numbering."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in runs(batches, 1):
            rows: list[tuple] = []
            kept: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                start = 0
                for length in cuts(len(got), capacity, least):
                    raw = got[start : start + length].tobytes()
                    rows.append((doc, start, length, zlib.crc32(raw), len(got), capacity // length))
                    kept.append(raw)
                    start += length
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """Pack documents; one row for each piece with its sequence, its offset
    there and its ids (little-endian, four bytes each): a sequence's rows, in
    order of offset, are the packed sequence. ids_crc32 is that of the ids.

    A null or empty text is the end id alone; repeated rows are packed as
    often as they occur; an empty table gives no rows; texts of any length
    are cut; only doc_id and text are read. A sequence's id is bin * capacity
    + class - 1.
    """
    cut = written(pieces(docs, vocabulary, end_id, capacity, least), "pack-pieces", "zstd")
    placed = numbered(cut, ["klass"], ["doc_id", "start", "mark", "length"], "rank")
    k = F.col("klass").cast("long")
    placed = placed.withColumn("sequence_id", F.floor(F.col("rank") / k) * capacity + k - 1)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "ids"]
    # a class of one fixed length needs no meeting of a sequence's pieces: full ones and exact powers above the tails
    fixed = (F.col("length") > least) & (F.col("klass") * F.col("length") == capacity)
    regular = placed.where(fixed).select(*names, ((F.col("rank") % k) * F.col("length")).alias("offset"))
    order = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    others = placed.where(~fixed).withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select(*names, "offset")
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"]
    return regular.unionAll(others).select(*columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
