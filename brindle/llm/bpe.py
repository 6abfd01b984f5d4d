"""Byte-level BPE with a rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that has a merge
rank sits in the bucket of that rank; a two-level bitmap over the ranks says
which buckets hold anything, and find-first-set gives the lowest. Entries
whose pair has changed since are skipped when they come up. A merge costs a
few bit operations whatever the pre-token's length, so a pre-token of a
million bytes takes a million steps, not their square.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import documents, runs, worker_cache

#: Encoded pre-tokens that a worker remembers, in each of two generations.
REMEMBERED = 300_000
WORD_BITS = 64


class RankQueue:
    """Positions by merge rank; lowest rank first, leftmost position first."""

    def __init__(self) -> None:
        self.summary = 0  # bit w: word w of the bitmap is not 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            w = rank >> 6
            self.words[w] = self.words.get(w, 0) | 1 << (rank & 63)
            self.summary |= 1 << w
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        w = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[w]
        low = bits & -bits
        rank = w * WORD_BITS + low.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[w] = bits ^ low
            if bits == low:
                self.summary ^= 1 << w
        return rank, position

    def __bool__(self) -> bool:
        return self.summary != 0


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends, the next one's start
    before = list(range(-1, n))  # before[i]: start of the part before i
    pair: list[int | None] = [None] * (n + 1)  # rank of the part at i with the next
    queue = RankQueue()
    push = queue.push
    for i in range(n - 1):
        rank = pair[i] = get(piece[i : i + 2])
        if rank is not None:
            push(rank, i)
    while queue:
        rank, i = queue.pop()
        if pair[i] != rank:
            continue  # stale
        j = end[i]
        k = end[j]
        end[i] = k
        pair[j] = pair[i] = None
        if k < n:
            before[k] = i
            new = pair[i] = get(piece[i : end[k]])
            if new is not None:
                push(new, i)
        if i:
            p = before[i]
            new = pair[p] = get(piece[p:k])
            if new is not None:
                push(new, p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Remembered(dict):
    """pre-token -> its ids' bytes, worked out when first asked for; of two
    generations the older is dropped when the newer is full."""

    def __init__(self, ranks: dict[bytes, int], limit: int = REMEMBERED):
        super().__init__()
        self.ranks, self.limit, self.old = ranks, limit, {}

    def __missing__(self, token: str) -> bytes:
        made = self.old.get(token)
        if made is None:
            made = np.array(encode_piece(token.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(token) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[token] = made
        return made


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str):
    """The pattern with white space as Unicode's property, as engines outside
    Python understand it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def codec(path: str, pattern: str):
    """(text -> ids as bytes, ids as bytes -> text's bytes); kept by the worker."""
    cache = worker_cache()
    if ("bpe", path, pattern) not in cache:
        ranks = read_ranks(path)
        memory, find = Remembered(ranks), splitter(pattern).findall
        pieces = {i: b for b, i in ranks.items()}

        def encode(text: str) -> bytes:
            return b"".join(map(memory.__getitem__, find(text)))

        def decode(ids: bytes) -> bytes:
            return b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

        cache["bpe", path, pattern] = encode, decode
    return cache["bpe", path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and, if asked for,
    the bytes that decoding these ids gives.

    A null or empty text has no ids; texts are whole however long; repeated
    rows are encoded each; an empty table gives no rows; only doc_id and text
    are read. Special tokens' strings are ordinary text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, to_bytes = codec(path, pattern)
        for batch in runs(batches, 1):
            ids = [to_ids(t.as_py() or "") for t in batch.column(1)]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([to_bytes(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary" + ", decoded binary" * decoded)


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and decoded bytes of rows with ids; null ids decode to nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, to_bytes = codec(path, pattern)
        for batch in runs(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_bytes(x.as_py() or b"") for x in batch.column(1)], pa.binary())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary")).mapInArrow(run, "doc_id long, decoded binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    rows = encode(documents(spark, sf_dir), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, decoded=True)
    return rows.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
