"""Language-model scores: marginal probability over subword segmentations.

The vocabulary exists; its scores order the pieces and are the prior. Counts
of pieces in training words turn them into unigram probabilities: first those
of one segmentation a word, then, by forward and backward sums over the
lattice of every distinct training word, the counts that all segmentations lead
one to expect. A word's
probability sums over all its segmentations (log-space forward recursion over
the lattice); words are parted at white space, so a text's probability is the
product of its words' and of the end's.

No table of all words is ever broadcast: distinct words are counted and scored
once, and blocks of documents ask for the words they hold. A fixed number of
most frequent words is resolved in the block itself, the others travel once a
block, however often they occur in it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import discard, documents, runs, worker_cache, written

#: Most frequent words that every task knows; the only ones that are broadcast.
HEAD = 16_384
#: A task's word counts are passed on when so many distinct words have come up.
FLUSH_WORDS = 300_000
#: A block of documents: at most so many bytes of text (or one document).
BLOCK_BYTES = 8_000_000
BLOCK_DOCS = 30_000
#: Blocks of a task that adds words up.
TASK_BLOCKS = 8
#: Rounds of expected counts.
ROUNDS = 1
#: Expected counts are added in these parts: whole numbers, in any order the same.
PART = 1 << 20
#: Longer words are summed over in log space only; shorter ones can't underflow.
SHORT = 30
#: Weight of the vocabulary's own order against counts, in pieces.
PRIOR = 16_000.0


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def with_split(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out (crc32 of the id's text leaves 1 by 5; a null id doesn't)."""
    left = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(left, F.lit(False)).alias("held_out"))


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training texts), other (in held-out texts); the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(words, pa.binary())] + [pa.array([s.get(w, 0) for w in words], pa.int64()) for s in seen]
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "c", "other"])

        for batch in runs(batches, 1):
            for text, out in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                found = seen[bool(out)]
                found.update(tokens(text.as_py()))
                found[b""] += 1
                if len(seen[0]) + len(seen[1]) >= FLUSH_WORDS:
                    yield flush()
        yield flush()

    return docs.mapInArrow(run, "word binary, c long, other long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("other").alias("other"))


def processor(path: str):
    cache = worker_cache()
    if ("pieces", path) not in cache:
        import sentencepiece

        cache["pieces", path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return cache["pieces", path]


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How often each piece occurs in the training words, as the vocabulary's
    own segmenter cuts them. At most one count a piece comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(path)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids, c in zip(model.encode(texts, num_threads=1), batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    total[i] += c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["piece", "n"])

    rows = words.where("c > 0 AND octet_length(word) > 0").select("word", "c").mapInArrow(run, "piece long, n long")
    return {r["piece"]: r["n"] for r in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """Unigram log probabilities of pieces and the forward recursion."""

    def __init__(self, path: str, counts: dict[int, float], ends: int):
        model = processor(path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i))]
        # the vocabulary's scores fall from 0 by rank; bytes hold the tail
        weight = {i: 1.0 / (10.0 + size) if model.is_byte(i) else 1.0 / (10.0 - min(0.0, model.get_score(i))) for i in normal}
        scale = PRIOR / sum(weight.values())
        total = sum(counts.get(i, 0) for i in normal) + ends + 1.0 + PRIOR
        log = {i: math.log((counts.get(i, 0) + scale * weight[i]) / total) for i in normal}
        self.end = math.log((ends + 1.0) / total)
        self.byte = {int(model.id_to_piece(i)[3:5], 16): log[i] for i in normal if model.is_byte(i)}
        self.piece = {model.id_to_piece(i): log[i] for i in normal if not model.is_byte(i)}
        self.number = {model.id_to_piece(i): i for i in normal if not model.is_byte(i)}
        self.byte_number = {int(model.id_to_piece(i)[3:5], 16): i for i in normal if model.is_byte(i)}
        self.prefixes = {p[:k] for p in self.piece for k in range(1, len(p) + 1)}

    def marginal(self, word: str) -> float:
        """log of the sum over all segmentations of a word's probability. A
        character that is no piece is spelt in bytes."""
        s = "▁" + word
        n, piece, prefixes, exp, log1p = len(s), self.piece, self.prefixes, math.exp, math.log1p
        a: list[float | None] = [None] * (n + 1)
        a[0] = 0.0
        for i in range(n):
            here = a[i]
            if here is None:
                continue
            j = i + 1
            part = s[i]
            if part not in piece:
                v = here + sum(self.byte.get(b, -30.0) for b in part.encode("utf-8", "surrogatepass"))
                t = a[j]
                a[j] = v if t is None else max(t, v) + log1p(exp(-abs(t - v)))
            while part in prefixes:
                p = piece.get(part)
                if p is not None:
                    v = here + p
                    t = a[j]
                    if t is None:
                        a[j] = v
                    elif t >= v:
                        a[j] = t + log1p(exp(v - t))
                    else:
                        a[j] = v + log1p(exp(t - v))
                j += 1
                if j > n:
                    break
                part = s[i:j]
        return a[n]

    def edges(self, word: str) -> tuple[int, list[tuple[int, int, float, tuple[int, ...]]]]:
        """The lattice of a word: places, and (from, to, log probability, the
        numbers of the piece or of the bytes) in order of from."""
        s = "▁" + word
        n, piece, prefixes = len(s), self.piece, self.prefixes
        out = []
        for i in range(n):
            part, j = s[i], i + 1
            if part not in piece:
                raw = part.encode("utf-8", "surrogatepass")
                out.append((i, j, sum(self.byte.get(b, -30.0) for b in raw), tuple(self.byte_number[b] for b in raw if b in self.byte_number)))
            while part in prefixes:
                p = piece.get(part)
                if p is not None:
                    out.append((i, j, p, (self.number[part],)))
                j += 1
                if j > n:
                    break
                part = s[i:j]
        return n, out

    def expect(self, word: str, times: int, total: list[int]) -> None:
        """Add to ``total``, in PARTs, how often each piece is expected in
        ``times`` words, by forward and backward sums."""
        n, edges = self.edges(word)
        exp = math.exp
        if n <= SHORT:
            a, b = [0.0] * (n + 1), [0.0] * (n + 1)
            a[0] = b[n] = 1.0
            steps = [(i, j, exp(p), ids) for i, j, p, ids in edges]
            for i, j, p, _ in steps:
                a[j] += a[i] * p
            for i, j, p, _ in reversed(steps):
                b[i] += p * b[j]
            scale = times * PART / a[n]
            for i, j, p, ids in steps:
                share = int(a[i] * p * b[j] * scale + 0.5)
                if share:
                    for k in ids:
                        total[k] += share
            return
        low = -1e300
        a, b = [low] * (n + 1), [low] * (n + 1)
        a[0] = b[n] = 0.0
        add = lambda x, y: max(x, y) + math.log1p(exp(-abs(x - y)))
        for i, j, p, _ in edges:
            a[j] = add(a[j], a[i] + p)
        for i, j, p, _ in reversed(edges):
            b[i] = add(b[i], p + b[j])
        for i, j, p, ids in edges:
            share = int(exp(min(0.0, a[i] + p + b[j] - a[n])) * times * PART + 0.5)
            for k in ids:
                total[k] += share

    def log10(self, word: bytes) -> float:
        return (self.marginal(word.decode("utf-8", "replace")) if word else self.end) / math.log(10)


def expected_counts(words: DataFrame, path: str, counts: dict[int, float], ends: int) -> dict[int, float]:
    """How often each piece is expected in the training words, over all their
    segmentations under the model of ``counts``. One number a piece of the
    vocabulary goes out and comes back."""
    known = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, known.value, ends)
        total = [0] * processor(path).get_piece_size()
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lattice.expect(word.decode("utf-8", "replace"), c, total)
        used = [i for i, n in enumerate(total) if n]
        # two halves, as a sum may go beyond 64 bits
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([total[i] >> 20 for i in used], pa.int64()), pa.array([total[i] & (PART - 1) for i in used], pa.int64())], ["piece", "n", "parts"])

    rows = words.where("c > 0 AND octet_length(word) > 0").select("word", "c").mapInArrow(run, "piece long, n long, parts long")
    return {r["piece"]: r["n"] + r["parts"] / PART for r in rows.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("parts").alias("parts")).collect()}


def score_words(words: DataFrame, path: str, counts: dict[int, float], ends: int) -> DataFrame:
    """word, c, n (everywhere), log10 of its marginal probability."""
    spread_counts = words.sparkSession.sparkContext.broadcast(counts)  # at most one number a piece of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, spread_counts.value, ends)
        for batch in batches:
            scores = [lattice.log10(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.float64())], ["word", "c", "n", "score"])

    return words.select("word", "c", (F.col("c") + F.col("other")).alias("n")).mapInArrow(run, "word binary, c long, n long, score double")


#: Scores are added as multiples of 2**-SCALE: whole numbers, whose sum doesn't
#: depend on the order of addition.
SCALE = 34
BLOCKS = "block long, word binary, local binary, times binary, doc_id long, held_out boolean, n_tokens long, n_known long, base long, score long"


class Numbers(dict):
    """word -> its number in the block; new words get the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def ragged(parts: np.ndarray, lengths: np.ndarray, width: int) -> pa.Array:
    """An array of binaries from numbers of ``width`` bytes laid end to end."""
    offsets = np.concatenate(([0], np.cumsum(lengths * width))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(parts.tobytes())])


def laid_out(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``ragged``: all numbers, and how many each row has."""
    array = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


def in_blocks(docs: DataFrame, head: dict[bytes, tuple[int, int, int]]) -> DataFrame:
    """Rows of two kinds: a document with what its frequent words add up to
    (word null), and a block's other word with the documents it is in and,
    unless it is always once, how often."""
    known = docs.sparkSession.sparkContext.broadcast(head)
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = {w: i for i, w in enumerate(known.value)}
        values = np.array(list(known.value.values()), np.int64).reshape(-1, 3)
        top = len(frequent)
        task, serial, size = TaskContext.get().partitionId(), 0, 0
        number = Numbers(frequent)
        held: list[tuple] = []
        numbers: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, size, number
            block = task << 32 | serial
            if held:
                columns = [[block] * len(held), *[[None] * len(held)] * 3, *zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                at, n = np.concatenate(numbers), np.concatenate(counts)
                owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in numbers])
                rare = at >= top
                at, n, owner = at[rare] - top, n[rare], owner[rare]
                order = np.argsort(at, kind="stable")
                at, n, owner = at[order], n[order], owner[order]
                words = list(number)[top:]
                each = np.bincount(at, minlength=len(words))
                often = np.zeros(len(words), bool)
                often[at[n > 1]] = True
                ends = np.concatenate(([0], np.cumsum(each)))
                for lo in range(0, len(words), 50_000):
                    hi = min(lo + 50_000, len(words))
                    part, some = slice(ends[lo], ends[hi]), slice(lo, hi)
                    nothing = [pa.nulls(hi - lo, k) for k in kinds[4:]]
                    times = n[part][np.repeat(often[some], each[some])].astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, block)), pa.array(words[some], pa.binary()), ragged(owner[part], each[some], 2), ragged(times, each[some] * often[some], 4), *nothing], names)
            for x in (held, numbers, counts):
                x.clear()
            number = Numbers(frequent)
            serial, size = serial + 1, 0

        for batch in runs(batches, 1):
            for doc, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or ""
                if held and (size + len(text) > BLOCK_BYTES or len(held) >= BLOCK_DOCS):
                    yield from flush()
                size += len(text)
                words = tokens(text)
                found = Counter(words)
                found[b""] = 1
                at = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                n = np.fromiter(found.values(), np.int64, len(found))
                common = at < top
                sums = n[common] @ values[at[common]]
                numbers.append(at)
                counts.append(n)
                held.append((doc, out, len(words) + 1, *sums.tolist()))
        yield from flush()

    return docs.mapInArrow(run, BLOCKS)


def gather(rows: DataFrame, schema: str, blocks: int) -> DataFrame:
    """Add up each block's words into its documents."""

    def run(group: pa.Table) -> pa.Table:
        is_doc = group.column("n_tokens").is_valid()
        docs, words = group.filter(is_doc), group.filter(pa.compute.invert(is_doc))
        sums = [docs.column(c).to_numpy().copy() for c in ("n_known", "base", "score")]
        if words.num_rows:
            at, each = laid_out(words.column("local"), np.uint16)
            some, given = laid_out(words.column("times"), np.uint32)
            times = np.ones(len(at), np.int64)
            times[np.repeat(given > 0, each)] = some
            for s, c in zip(sums, ("n_known", "base", "score"), strict=True):
                # whole numbers; two halves keep each sum exact in double precision
                value = np.repeat(words.column(c).to_numpy(), each) * times
                for shift in (0, 30):
                    part = value & ((1 << 30) - 1) if shift == 0 else value >> 30
                    s += np.bincount(at, part, len(s)).astype(np.int64) << shift
        made = [docs.column("doc_id"), docs.column("held_out"), docs.column("n_tokens"), pa.array(sums[0]), *(pa.array(x / 2**SCALE) for x in sums[1:])]
        return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), made, strict=True)))

    # as many tasks as the blocks ask for, whatever the session's number of partitions
    return rows.repartition(max(1, -(-blocks // TASK_BLOCKS)), "block").groupBy("block").applyInArrow(run, schema)


def score(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """Score every document with the model its training part teaches.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10 probability). A null or empty text is the end alone; repeated
    rows are each counted and scored; an empty table gives no rows; without
    training rows all words are unknown; only doc_id and text are read.
    """
    spark = docs.sparkSession
    texts = with_split(docs)
    words = written(count_words(texts), "lm-words")
    seen = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train, scale = seen["n"], seen["n"] + 0.5 * (seen["v"] + 1)
    end = words.where("octet_length(word) = 0").first()
    ends, counts = end["c"] if end else 0, piece_counts(words, path)
    for _ in range(ROUNDS):
        counts = expected_counts(words, path, counts, ends)
    scored = written(score_words(words, path, counts, ends), "lm-scored")
    discard(words)
    fixed = lambda x: F.round(x * F.lit(float(2**SCALE))).cast("long")
    base = F.log10((F.col("c") + 0.5) / F.lit(float(scale)))
    known = scored.select("word", (F.col("c") > 0).cast("long").alias("n_known"), fixed(base).alias("base"), fixed(F.col("score")).alias("score"), "n")
    top = known.orderBy(F.desc("n"), "word").limit(head).collect()
    frequent = {bytes(r["word"]): (r["n_known"], r["base"], r["score"]) for r in top}
    blocks = written(in_blocks(texts, frequent), "lm-blocks")
    asked = blocks.where("word IS NOT NULL").select("block", "word", "local", "times")
    answered = asked.join(known.drop("n"), "word").select("block", "local", "times", "n_known", "base", "score")
    nothing = F.lit(None)
    rows = blocks.where("word IS NULL").select("block", "local", "times", "n_known", "base", "score", "doc_id", "held_out", "n_tokens").unionAll(
        answered.select("*", nothing.cast("long").alias("doc_id"), nothing.cast("boolean").alias("held_out"), nothing.cast("long").alias("n_tokens")))
    out = gather(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double", blocks.where("word IS NULL").select("block").distinct().count())
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
