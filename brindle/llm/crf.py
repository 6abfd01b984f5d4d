"""Quality classifier: a linear-chain conditional random field over lines.

Every line that holds a word is good or bad. Its potentials see its own
features and those of the lines before and after; a second set of weights
joins neighbouring labels. Forward-backward gives each line's probability of
being good; their mean, weighted by the lines' lengths, is the document's,
brought to the scale of the labels by a fitted logistic curve.

Training is on the driver, on a bounded sample of labelled documents; only
feature rows of the sample come there. Scoring runs on all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import carried, discard, documents, mapped, runs, written

#: The sample: at most so many labelled documents, of so many lines together.
SAMPLE = 4000
SAMPLE_LINES = 200_000
#: Lines of a training chain: longer documents are several, one after another.
CHAIN = 300
RIDGE = 2.0
STEPS = 60
#: Documents are worked on in groups of at most so many padded lines.
PADDED = 300_000

FEATURES = ("one", "length", "upper", "digit", "symbol", "bang", "pipe", "other_mark", "word_length", "same_words", "same_pairs", "said_before", "ends_sentence", "few_words", "starts_upper")
CLASSES = ("upper", "lower", "digit", "symbol", "bang", "pipe", "mark", "space", "wide")


def class_table() -> np.ndarray:
    t = np.zeros((256, len(CLASSES)), np.int32)
    of = {c: i for i, c in enumerate(CLASSES)}
    for b in range(256):
        c = chr(b)
        name = "wide" if b >= 128 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "symbol" if c in "#*$%&<>" else "bang" if c == "!" else "pipe" if c == "|" else "space" if c.isspace() else "mark"
        t[b, of[name]] = 1
    return t


TABLE = class_table()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with a word, its weight: characters)."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    raws = [x.encode("utf-8", "surrogatepass") for x in lines]
    flat = np.frombuffer(b"".join(raws), np.uint8)
    starts = np.cumsum([0] + [len(r) for r in raws[:-1]])
    counts = np.stack([np.add.reduceat(TABLE[:, i][flat], starts) for i in range(len(CLASSES))], 1).astype(float)
    upper, lower, digit, symbol, bang, pipe, mark, space, wide = counts.T
    size = np.array([len(r) for r in raws], float)
    n_words, same_words, same_pairs, before, ends, starts_upper = (np.zeros(len(lines)) for _ in range(6))
    said: set[str] = set()
    pairs: set[tuple[str, str]] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = n_words[i] = len(words)
        if not n:
            n_words[i] = 1
            continue
        same_words[i] = 1 - len(set(words)) / n
        if n > 1:
            own = set(zip(words, words[1:], strict=False))
            same_pairs[i] = 1 - len(own - pairs) / (n - 1)
            pairs |= own
        before[i] = line in said
        said.add(line)
        ends[i] = words[-1][-1] in ".?!…\"»"
        starts_upper[i] = words[0][0].isupper()
    letters = upper + lower + wide / 2 + 1
    out = np.stack([
        np.ones(len(lines)), np.log1p(size) / 5, upper / letters, digit / size, symbol / n_words, bang / n_words, pipe / n_words, mark / n_words,
        np.minimum(size / n_words, 40) / 10, same_words, same_pairs, before, ends, n_words < 4, starts_upper,
    ], 1)
    out[:, 4:8] = np.minimum(out[:, 4:8], 4)
    return out.astype(np.float32), size


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features; zeros beyond the ends."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    return np.concatenate([x, np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none])], 1)


WIDTH = 3 * len(FEATURES)


def groups(lengths: list[int]) -> Iterator[list[int]]:
    """Documents of like lengths together, within PADDED lines."""
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    some: list[int] = []
    for i in order:
        if some and (len(some) + 1) * lengths[i] > PADDED:
            yield some
            some = []
        some.append(i)
    if some:
        yield some


def marginals(unary: np.ndarray, real: np.ndarray, join: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unary (docs, lines): log potential of good over bad; join (2, 2).
    Returns P(good) of each line, expected joins (2, 2) and log Z by document."""
    n, lines = unary.shape
    a = np.zeros((n, lines, 2))
    b = np.zeros((n, lines, 2))
    a[:, 0, 1] = unary[:, 0]
    for t in range(1, lines):
        for s in (0, 1):
            a[:, t, s] = np.logaddexp(a[:, t - 1, 0] + join[0, s], a[:, t - 1, 1] + join[1, s]) + (unary[:, t] if s else 0)
        a[:, t] = np.where(real[:, t, None], a[:, t], a[:, t - 1])
    for t in range(lines - 2, -1, -1):
        for s in (0, 1):
            b[:, t, s] = np.logaddexp(join[s, 0] + b[:, t + 1, 0], join[s, 1] + unary[:, t + 1] + b[:, t + 1, 1])
        b[:, t] = np.where(real[:, t + 1, None], b[:, t], 0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    good = 1 / (1 + np.exp(np.clip(a[:, :, 0] + b[:, :, 0] - a[:, :, 1] - b[:, :, 1], -700, 700)))
    joins = np.zeros((2, 2))
    if lines > 1:
        ok = real[:, 1:]
        for s in (0, 1):
            for r in (0, 1):
                e = a[:, :-1, s] + join[s, r] + (unary[:, 1:] if r else 0) + b[:, 1:, r] - z[:, None]
                joins[s, r] = np.exp(np.minimum(e, 0))[ok].sum()
    return good, joins, z


@dataclass
class Model:
    weights: np.ndarray
    join: np.ndarray
    slope: float
    offset: float
    empty: float  # of a text without words

    def raw(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean of the lines' P(good); nan without lines."""
        out = np.full(len(texts), np.nan)
        lengths = [len(w) for _, w in texts]
        for some in groups(lengths):
            some = [i for i in some if lengths[i]]
            if not some:
                continue
            unary, real = padded([with_neighbours(texts[i][0]) @ self.weights for i in some])
            good, _, _ = marginals(unary, real, self.join)
            for row, i in enumerate(some):
                out[i] = np.average(good[row, : lengths[i]], weights=texts[i][1])
        return out

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        raw = self.raw(texts)
        made = 1 / (1 + np.exp(-(self.slope * logit(raw) + self.offset)))
        return np.where(np.isnan(raw), self.empty, made)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(map(len, rows))
    out, real = np.zeros((len(rows), most)), np.zeros((len(rows), most), bool)
    for i, r in enumerate(rows):
        out[i, : len(r)], real[i, : len(r)] = r, True
    return out, real


def descend(value, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``value`` gives (f, gradient)."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y in reversed(past):
            alphas.append((s @ d) / (s @ y))
            d = d - alphas[-1] * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0 if past else 1 / max(1.0, float(np.abs(g).sum()))
        while step > 1e-10:
            fx, gx = value(x + step * d)
            if fx <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, y = step * d, gx - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, moved, f, g = x + s, abs(f - fx), fx, gx
        if moved < 1e-6 * (1 + abs(f)):
            break
    return x


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    """Maximum likelihood of the labels on all lines, with a ridge; then the
    curve from a document's mean to its label."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    used = [i for i, (_, w) in enumerate(texts) if len(w)]
    empties = [y for (_, w), y in zip(texts, labels, strict=True) if not len(w)]
    empty = sum(empties) / (len(empties) + 1)
    if len({labels[i] for i in used}) < 2:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))), share)
    # a chain's first and last line still see their neighbours in the document
    chains = [(i, at, min(at + CHAIN, len(texts[i][1]))) for i in used for at in range(0, len(texts[i][1]), CHAIN)]
    batches = []
    for some in groups([stop - at for _, at, stop in chains]):
        for first in range(0, len(some), 250):
            part = [chains[c] for c in some[first : first + 250]]
            near = {i: with_neighbours(texts[i][0]) for i, _, _ in part}
            x = [near[i][at:stop].astype(float) for i, at, stop in part]
            batches.append((np.concatenate(x), [len(v) for v in x], np.array([labels[i] for i, _, _ in part])))

    def value(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, join = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        f, g, gj = RIDGE / 2 * theta @ theta, np.zeros(WIDTH), np.zeros((2, 2))
        for x, lengths, y in batches:
            line = x @ w
            parts = np.split(line, np.cumsum(lengths)[:-1])
            unary, real = padded(parts)
            good, joins, z = marginals(unary, real, join)
            target = np.repeat(y, lengths)
            stays = np.array([n - 1 for n in lengths])
            f += z.sum() - (line * target).sum() - (join[0, 0] * stays[y == 0].sum() + join[1, 1] * stays[y == 1].sum())
            g += x.T @ (good[real] - target)
            gj += joins - np.diag([stays[y == 0].sum(), stays[y == 1].sum()])
        return f, np.concatenate([g, gj.ravel()]) + RIDGE * theta

    theta = descend(value, np.zeros(WIDTH + 4), STEPS)
    model = Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), 1.0, 0.0, empty)
    m, y = logit(model.raw([texts[i] for i in used])), np.array([labels[i] for i in used], float)

    def curve(p: np.ndarray) -> tuple[float, np.ndarray]:
        u = p[0] * m + p[1]
        d = 1 / (1 + np.exp(-u)) - y
        return float(np.logaddexp(0, u).sum() - (u * y).sum() + 0.5 * p @ p), np.array([(d * m).sum(), d.sum()]) + p

    model.slope, model.offset = descend(curve, np.array([1.0, 0.0]), 100).tolist()
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def featured(batch: pa.RecordBatch, column: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [line_features(t.as_py()) for t in batch.column(column)]


def filled(lines: list[tuple[int, int]], most: int) -> list[int]:
    """Ids of (id, lines) taken in order while they fit into ``most`` lines
    together; one that doesn't fit is passed over, and those after it are tried."""
    out, total = [], 0
    for doc, n in lines:
        if total + n <= most:
            out.append(doc)
            total += n
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model:
    """Fit on labelled rows that aren't held out, in the order of a hash of
    their id: at most ``sample`` of them, of at most ``sample_lines`` lines
    together. Rows labelled other than 0 or 1 don't count; an id labelled both
    ways is a bad one; of several texts of one id the smallest counts, so rows
    that share an id don't add up."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    picked = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    chosen = written(chosen.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "crf-sample")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    sizes = chosen.select("doc_id", F.coalesce(breaks + 1, F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    some = chosen.where(F.col("doc_id").isin(filled([(r["doc_id"], r["n"]) for r in sizes], sample_lines))).select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            found = featured(batch, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([w.astype(np.float64).tobytes() for _, w in found], pa.binary())], ["doc_id", "quality", "x", "w"])

    rows = some.mapInArrow(run, "doc_id long, quality int, x binary, w binary").collect()
    discard(chosen)
    rows.sort(key=lambda r: r["doc_id"])
    texts = [(np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)), np.frombuffer(r["w"], np.float64)) for r in rows]
    return fit(texts, [r["quality"] for r in rows])


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], threshold: float = 0.3) -> DataFrame:
    """``columns`` of every document, passed through, with score and predicted.

    A null, empty or blank text gets the training share of good ones among
    such texts (0 without any). Repeated rows score alike; without usable
    labels every text gets the same score; an empty table gives no rows.
    Columns named score or predicted give way.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels))  # some fifty numbers
    sent, keep, at = carried(docs, columns, ["score", "predicted"])
    names = [*(f"_{i}" for i in range(len(keep))), "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, at):
            score = model.value.scores(featured(batch, at))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names)

    return mapped(sent, keep, run, "score double, predicted int")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
