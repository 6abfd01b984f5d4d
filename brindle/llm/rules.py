"""Quality rules: compression bands beside plain word rules.

zstandard's ratio (compressed / raw bytes) of the whole text and of its
fixed chunks must lie within limits for the text's length: repetitive text
compresses too well, random text not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import carried, documents, mapped, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
BREAK = re.compile(r"[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Bands:
    """Limits by the text's bytes: (up to bytes, least ratio, most ratio). A
    chunk counts when it is at least half full; a text fails when more than
    ``bad_share`` of its chunks are outside ``chunk_least`` … ``chunk_most``.
    Upper limits lie between the highest ratio measured on documents of a band
    (0.75 at 301 bytes, 0.52 at 2001, 0.53 for chunks of 2 KiB) and the lowest of
    base64 words (0.86 at 400 bytes, 0.75 at 4000, 0.76 for such chunks)."""

    whole: tuple[tuple[float, float, float], ...] = (
        (150, 0.0, 9.0), (300, 0.0, 0.95), (400, 0.36, 0.83), (600, 0.36, 0.79), (800, 0.36, 0.77), (1000, 0.36, 0.75), (2000, 0.28, 0.72), (4000, 0.28, 0.68), (40_000, 0.22, 0.66), (float("inf"), 0.18, 0.66))
    chunk: int = 2048
    chunk_least: float = 0.25
    chunk_most: float = 0.68
    bad_share: float = 0.2
    level: int = 3


@dataclass(frozen=True)
class Base:
    """The word rules: too few words, or too many in repeated windows."""

    least_words: int = 50
    most_repeat_percent: int = 50
    window: int = 3


def repeated(words: list[str], window: int = 3) -> int:
    """Words that lie in a window that occurs twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    seen: dict[tuple, int] = {}
    again: list[int] = []
    firsts: set[int] = set()
    put = seen.setdefault
    for i, g in enumerate(grams):
        j = put(g, i)
        if j != i:
            again.append(i)
            firsts.add(j)
    if not again:
        return 0
    mark = np.zeros(len(words) + window, np.int32)
    at = np.fromiter((*again, *firsts), np.int64)
    for k in range(window):
        mark[at + k] = 1
    return int(mark.sum())


def ratios(raw: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """Whole ratio, chunks counted, chunks outside their limits."""
    if not raw:
        return 1.0, 0, 0
    whole = len(z.compress(raw)) / len(raw)
    n = bad = 0
    for i in range(0, len(raw), bands.chunk):
        part = raw[i : i + bands.chunk]
        if len(part) * 2 >= bands.chunk:
            r = len(z.compress(part)) / len(part)
            n, bad = n + 1, bad + (not bands.chunk_least <= r <= bands.chunk_most)
    return whole, n, bad


def in_band(size: int, whole: float, chunks: int, bad: int, bands: Bands) -> bool:
    _, least, most = next(b for b in bands.whole if size <= b[0])
    return least <= whole <= most and bad <= bands.bad_share * chunks


def measure(text: str | None, bands: Bands, base: Base, z: zstandard.ZstdCompressor) -> tuple:
    """All figures of one text."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in lines:
            duplicates += 1
        elif line and WORD.search(line):
            lines.add(line)
    again = repeated(words, base.window)
    failed = n < base.least_words or 100 * again > base.most_repeat_percent * n
    raw = text.encode("utf-8", "surrogatepass")
    whole, chunks, bad = ratios(raw, bands, z)
    fits = in_band(len(raw), whole, chunks, bad, bands)
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), duplicates, again, failed, not failed and fits, whole, chunks, bad


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def judge(docs: DataFrame, columns: list[str], bands: Bands = Bands(), base: Base = Base()) -> DataFrame:  # noqa: B008
    """``columns`` of every document, passed through, and the figures and verdict.

    A null text has no words and fails; so does an empty one. Repeated rows are
    judged alike; an empty table gives no rows. ``columns`` may hold anything
    but the names of the figures, which win over equal names.
    """
    figures = [f.split()[0] for f in FIGURES.split(", ")]
    sent, keep, at = carried(docs, columns, figures)
    names = [f"_{i}" for i in range(len(keep))] + figures
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=bands.level)
        for batch in runs(batches, at):
            texts = batch.column(at)
            found = list(zip(*(measure(t.as_py(), bands, base, z) for t in texts), strict=True)) or [()] * len(figures)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names)

    return mapped(sent, keep, run, FIGURES)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), ["doc_id"])
