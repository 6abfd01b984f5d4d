"""N-gram Jaccard join, without loss.

Every text becomes a set of hashed word shingles; equal sets are one class.
Two sets whose Jaccard is at least t share a member among the first
n - ceil(t n) + 1 of each in one common order (prefix principle), so a class
is posted to the tile of each of these members. Any common order is right;
this one puts the shingles that many documents hold last, as a sketch of
bounded size finds them, so hot shingles make no hot tiles. A tile is read in
order of size, so that a size band meets only itself and the band below.

A pair passes, in turn: sizes within the ratio; what its positions in the
prefix leave for the overlap; a parity bitmap of 64 bits; a parity bitmap as
wide as its size band asks for (differing bits bound the symmetric difference
from below, so the overlap from above); and the intersection of the sorted
arrays, which decides.

A first round links each tile's members with its middle one, the member most
like a spread of the others. The second round looks at all pairs that the
first has left in different components, so groups of many copies cost a star
and not all their pairs, and no link between components is lost. Then the links
within components are counted, class by class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import shingles
from brindle.llm.common import discard, documents, runs, written
from brindle.llm.components import components

#: Cells of the sketch of frequent shingles, and how many cells are passed on.
SKETCH = 1 << 22
FREQUENT = 65_536
#: Classes that a task remembers so as to post a copied text once.
REMEMBERED = 500_000
#: Cells by which the scan for texts to be compared exactly is narrowed.
CELLS = 1 << 19
#: Members of a tile that stand for the others when its middle is looked for.
SPREAD = 48
#: Rows of a tile that a task holds at once in the first round.
HELD = 20_000
#: Rows of an undecided tile; a larger one is dealt to blocks, and each pair of
#: blocks is a tile of its own, so that several tasks share it.
TILE = 1000
#: Rows of a tile that are compared at once in the second round.
BLOCK = 2048
#: Pairs of a class that a task decides.
HUB = 2000
#: Classes of a component, and members of their sets, that make a block when links are counted.
LINKED = 500
LINKED_MEMBERS = 400_000
#: Members that a product of incidence matrices takes at once.
COLUMNS = 2048

U = np.uint64


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_cells(docs: DataFrame, k: int) -> list[int]:
    """The sketch's fullest cells, fullest first. A task reports a cell that
    far more of its texts fall into than chance explains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n, total = np.zeros(SKETCH, np.int32), 0, 0
        for batch in runs(batches, 1):
            found = shingles.sets([t.as_py() for t in batch.column(1)], k)
            for s in found:
                cells[(s & U(SKETCH - 1)).astype(np.int64)] += 1  # a text counts once a cell
                total += len(s)
            n += len(found)
        at = np.flatnonzero(cells >= 8 + n // 1024 + 4 * (total // SKETCH))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells[at], pa.int64())], ["cell", "n"])

    rows = texts(docs).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return [r["cell"] for r in rows.orderBy(F.desc("n"), "cell").limit(FREQUENT).collect()]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def set_hash(s: np.ndarray) -> int:
    return int(np.int64(shingles.mix(shingles.mix(s, 5).sum(dtype=np.uint64, keepdims=True), len(s) + 7)[0]))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Parities of how many members fall on each bit, packed in bytes."""
    return np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def band_bits(n: int) -> int:
    """Bits of a set's bitmap: a power of two, about half its size or more."""
    return max(64, 1 << (max(1, n // 2) - 1).bit_length())


def folded(a: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as one of ``size`` bytes."""
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a


SETS = "doc_id long, n long, h long, prefix array<long>, hot int, sig64 long, sig binary"


def band(n: int, percent: int) -> int:
    """A size's band; sizes within the ratio are in one band or in neighbouring ones."""
    return 1 + int(math.log(n) / (math.log(100 / percent) * (1 + 1e-9)))


def posted(docs: DataFrame, k: int, percent: int, cells: list[int]) -> DataFrame:
    """Each document's set size and class; with the prefix and bitmaps where
    the task sees the class first. The prefix's ``hot`` last members are in the
    sketch's fullest cells; after the prefix come the keys of their tiles, which
    are one a size band: first of the set's own, then of the band below."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(cells, np.int64))  # FREQUENT at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(SKETCH, np.int32)
        weight[shared.value[::-1]] = np.arange(1, len(shared.value) + 1)  # the fullest is the heaviest
        seen: set[int] = set()
        for batch in runs(batches, 1):
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc, s in zip(ids, shingles.sets([t.as_py() for t in batch.column(1)], k), strict=True):
                n = len(s)
                h = set_hash(s) if n else 0
                if not n or doc is None or h in seen:
                    rows.append((n, h, None, None, None, None))
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(h)
                w = weight[(s & U(SKETCH - 1)).astype(np.int64)]
                size, hot = prefix_length(n, percent), 0
                first = s[:size]
                if w.any():
                    first = s[np.lexsort((s, w))][:size]
                    hot = max(0, size - int((w == 0).sum()))
                    first = np.concatenate((first, shingles.mix(first[size - hot :] + U(band(n, percent)), 11), shingles.mix(first[size - hot :] + U(band(n, percent) - 1), 11)))
                rows.append((n, h, first.view(np.int64), hot, int(bitmap(s, 64).view(np.int64)[0]), bitmap(s, band_bits(n)).tobytes()))
            n, h, prefix, hot, sig64, sig = zip(*rows, strict=True) if rows else ((),) * 6
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(hot, pa.int32()), pa.array(sig64, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SETS.split(", ")])

    return texts(docs).mapInArrow(run, SETS)


def tiles(keyed: DataFrame, schema: str, work, most: int | None = None) -> DataFrame:
    """Deal rows to tasks by ``key``, in order of key, n, h, and hand ``work``
    whole tiles: a run of rows as arrays by column. With ``most``, a tile of
    more rows comes in several runs."""
    names = keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
            key = rows[0]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last tile may go on
            cut = most is not None and len(key) - last > most
            last = len(key) if cut else last
            rest = [c[last - cut :] for c in rows]  # the next run of a tile has this run's last row
            if last:
                yield from work(dict(zip(names, (c[:last] for c in rows), strict=True)))
        if rest is not None and len(rest[0]):
            yield from work(dict(zip(names, rest, strict=True)))

    return keyed.repartition("key").sortWithinPartitions("key", "n", "h").mapInArrow(run, schema)


def bounds(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))


def popcount(x: np.ndarray) -> np.ndarray:
    """Bits that are set; numpy would count those of a negative's magnitude."""
    return np.bitwise_count(x.view(np.uint64) if x.dtype == np.int64 else x).astype(np.int64)


def middle(sig: np.ndarray, n: np.ndarray) -> int:
    """The row that is most like a spread of all rows."""
    some = np.unique(np.linspace(0, len(sig) - 1, SPREAD).astype(int))
    away = np.zeros(len(sig), np.int64)
    for i in some:
        away += popcount(sig ^ sig[i]) + np.abs(n - n[i])
    return int(away.argmin())


MEMBERS = "key long, n long, h long, pos long, sig64 long, lead long"


def members(sets: DataFrame, percent: int) -> DataFrame:
    """The rows of tiles with two classes or more, and each one's lead: the
    middle row of those within the size ratio (null: it is that itself). A tile
    of more than HELD rows has a middle for each run of them."""
    rows = sets.where("prefix IS NOT NULL").select("n", "h", "sig64", "hot", (F.size("prefix") - F.col("hot") * 2).alias("size"), F.posexplode("prefix").alias("at", "key"))
    rows = rows.where("at < size - hot OR at >= size")  # a hot member goes to its bands' tiles
    place = F.when(F.col("at") < F.col("size"), F.col("at")).when(F.col("at") < F.col("size") + F.col("hot"), F.col("at") - F.col("hot")).otherwise(F.col("at") - 2 * F.col("hot"))
    rows = rows.select("key", "n", "h", place.cast("long").alias("pos"), "sig64")

    def work(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, h = t["key"], t["h"]
        again = np.concatenate(([False], (key[1:] == key[:-1]) & (h[1:] == h[:-1])))  # a class that several tasks have posted
        t = {c: x[~again] for c, x in t.items()}
        key = t["key"]
        same = key[1:] == key[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(key) else np.zeros(0, bool)
        t = {c: x[many] for c, x in t.items()}
        if not len(t["key"]):
            return
        lead = np.zeros(len(t["key"]), np.int64)
        none = np.zeros(len(lead), bool)
        edge = bounds(t["key"])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n, at = t["n"], lo
            while at < hi:  # runs in which the largest is within the ratio of the smallest
                stop = lo + int(np.searchsorted(n[lo:hi], n[at] * 100 // percent, side="right"))
                best = at + (middle(t["sig64"][at:stop], n[at:stop]) if stop - at > 2 else 0)
                lead[at:stop], none[best] = t["h"][best], True
                at = stop
        yield pa.RecordBatch.from_arrays([*(pa.array(t[c], pa.int64()) for c in ("key", "n", "h", "pos", "sig64")), pa.array(lead, pa.int64(), mask=none)], [x.split()[0] for x in MEMBERS.split(", ")])

    return tiles(rows, MEMBERS, work, HELD)


def undecided(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of tiles that still hold different labels, with their wide bitmaps;
    a tile of more than TILE rows becomes one for each pair of its blocks. In a
    pair of two blocks ``side`` tells them apart, in others it is 0."""
    seen = marked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    rows = marked.join(seen.select("key", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")), "key").join(classes.select("h", "sig"), "h")
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    rows = rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    part = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("long")
    return rows.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(part).alias("key"), "n", "h", "pos", "sig64", "label", side.alias("side"), "sig")


def within(sig: np.ndarray, i: np.ndarray, j: np.ndarray, budget: np.ndarray) -> np.ndarray:
    """For rows i and j: do their wide bitmaps, folded to the smaller one's
    size, differ in ``budget`` bits at most?"""
    width = np.array([len(x) for x in sig])
    size, keep = np.minimum(width[i], width[j]), np.ones(len(i), bool)
    for bytes_ in np.unique(size[size > 8]).tolist():  # 64 bits have been compared
        at = np.flatnonzero(size == bytes_)
        used, place = np.unique(np.concatenate((i[at], j[at])), return_inverse=True)
        maps = np.stack([folded(np.frombuffer(sig[r], np.uint8), bytes_) for r in used]).view(np.uint64)
        a, b = place[: len(at)], place[len(at) :]
        step = max(1, (8 << 20) // bytes_)
        for lo in range(0, len(at), step):
            some = slice(lo, lo + step)
            keep[at[some]] = np.bitwise_count(maps[a[some]] ^ maps[b[some]]).sum(1, dtype=np.int64) <= budget[at[some]]
    return keep


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a tile's rows with different labels that sizes,
    positions and both bitmaps allow."""

    def work(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        edge = bounds(t["key"])
        found: list[np.ndarray] = []
        size = 0
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n, h, pos, sig, label, side, wide = (t[c][lo:hi] for c in ("n", "h", "pos", "sig64", "label", "side", "sig"))
            if (label == label[0]).all():
                continue
            for y0 in range(0, hi - lo, BLOCK):
                y = slice(y0, min(y0 + BLOCK, hi - lo))
                x0 = int(np.searchsorted(n, -(-n[y0] * percent // 100)))
                for x1 in range(x0, y.stop, BLOCK):
                    x = slice(x1, min(x1 + BLOCK, y.stop))
                    total = n[x][:, None] + n[y][None, :]
                    need = -(-percent * total // (100 + percent))
                    ok = (np.arange(x.start, x.stop)[:, None] < np.arange(y.start, y.stop)[None, :]) & (label[x][:, None] != label[y][None, :])
                    ok &= (side[x][:, None] == 0) | (side[x][:, None] != side[y][None, :])
                    ok &= (n[x] * 100)[:, None] >= (percent * n[y])[None, :]
                    ok &= ((n[x] - pos[x])[:, None] >= need) & ((n[y] - pos[y])[None, :] >= need)
                    ok &= total - popcount(sig[x][:, None] ^ sig[y][None, :]) >= 2 * need
                    i, j = np.nonzero(ok)
                    if not len(i):
                        continue
                    keep = within(wide, i + x.start, j + y.start, (total - 2 * need)[i, j])
                    if keep.any():
                        found.append(np.stack((h[x][i[keep]], h[y][j[keep]])))
                        size += int(keep.sum())
                    if size > 200_000:
                        yield pairs_of(found)
                        found, size = [], 0
        if found:
            yield pairs_of(found)

    return tiles(rows, "a long, b long", work).distinct()


def pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def enough(overlap: int, n: int, m: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose wide bitmaps allow the overlap."""
    one = classes.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                size = min(len(sa[i]), len(sb[i]))
                apart = int(popcount(folded(np.frombuffer(sa[i], np.uint8), size) ^ folded(np.frombuffer(sb[i], np.uint8), size)).sum())
                keep.append(enough((na[i] + nb[i] - apart) // 2, na[i], nb[i], percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def sorted_arrays(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """h and members of the classes asked for (h, rep), written."""
    cell = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(CELLS)).cast("int").alias("cell")
    cells = asked.select(F.col("rep").alias("doc_id")).select(cell).distinct()  # CELLS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            found = shingles.sets([t.as_py() for t in batch.column(1)], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_hash(s) if len(s) else 0 for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["rep", "h", "members"])

    wanted = texts(docs).select("*", cell).join(F.broadcast(cells), "cell", "left_semi").select("doc_id", "text")
    return written(wanted.mapInArrow(run, "rep long, h long, members binary").join(asked, ["rep", "h"]).dropDuplicates(["h"]).select("h", "members"), "near-arrays")


def exact(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by the intersection of sorted arrays. The array
    of an ``a`` is sent once for each HUB of its pairs, not with each of them."""
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(classes.select("h", "rep"), "h"), "near-asked")
    arrays = sorted_arrays(asked, docs, k)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    mine = hubs.join(arrays.toDF("a", "members"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "members")
    theirs = pairs.join(arrays.toDF("b", "members"), "b").join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "members")
    rows = mine.unionAll(theirs).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, members in zip(batch.column(2), batch.column(3), strict=True):
                s = np.frombuffer(members.as_py(), np.uint64)
                if not b.is_valid:
                    hub = s
                    keep.append(False)
                    continue
                at = np.searchsorted(hub, s)
                at[at == len(hub)] = 0
                keep.append(enough(int((hub[at] == s).sum()), len(s), len(hub), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(2).filter(mask)], ["a", "b"])

    links = written(rows.mapInArrow(decide, "a long, b long"), "near-links")
    discard(asked, arrays)
    return links


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many members each set of x shares with each of y: products of
    incidence matrices, COLUMNS members at a time (whole numbers below 2**24)."""
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = (np.cumsum(times > 1) - 1)[at]
    shared = times[at] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[row[part], column[part] - first] = 1
        out += (holds[x] @ holds[y].T).astype(np.int64)
    return out


def link_counts(homes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """h and n_links: with how many documents of other classes each class links.

    All links are within components (homes: h, rep, n, copies, component_id).
    Two classes that make one are linked; in a larger one all pairs of classes
    are decided, by sorted arrays. Its classes are dealt to blocks, and a task
    gets each pair of blocks and gives counts, no pairs."""
    size = homes.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.sum("copies").alias("all"), (F.min("rep") != F.max("rep")).alias("apart"))
    sized = homes.join(size.where("size > 1"), "component_id")
    two = (F.col("size") == 2) & F.col("apart")  # else they only share an id
    blocks = F.greatest(F.ceil(F.col("size") / LINKED), F.ceil(F.col("total") / LINKED_MEMBERS)).cast("int")
    larger = written(sized.where(~two).select("h", "rep", "n", "copies", "component_id", blocks.alias("blocks")), "near-larger")
    arrays = sorted_arrays(larger.select("h", "rep"), docs, k)
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    rows = larger.join(arrays, "h").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.xxhash64("component_id", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(part.alias("key"), "n", "h", "component_id", "own", "other", "copies", "members")

    def work(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        # two tiles whose keys collide are told apart by what the keys were made of
        low, high = np.minimum(t["own"], t["other"]), np.maximum(t["own"], t["other"])
        order = np.lexsort((high, low, t["component_id"], t["key"]))
        t = {c: x[order] for c, x in t.items()} | {"low": low[order], "high": high[order]}
        new = np.zeros(len(order), bool)
        for c in ("component_id", "low", "high"):
            new[1:] |= t[c][1:] != t[c][:-1]
        edge = bounds(np.cumsum(new))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n, h, own, copies = (t[c][lo:hi].astype(np.int64) for c in ("n", "h", "own", "copies"))
            low, high = t["low"][lo], t["high"][lo]
            x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
            if not len(x) or not len(y):
                continue
            sets = [np.frombuffer(m, np.uint64) for m in t["members"][lo:hi]]
            overlap = overlaps(sets, x, y)
            ok = 100 * overlap >= percent * (n[x][:, None] + n[y][None, :] - overlap)
            if low == high:
                np.fill_diagonal(ok, False)
            counts = [(h[x], ok @ copies[y])] + [(h[y], copies[x] @ ok)] * bool(low != high)
            for who, links in counts:
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(links, pa.int64())], ["h", "n_links"])

    inside = tiles(rows, "h long, n_links long", work).groupBy("h").agg(F.sum("n_links").alias("n_links"))
    found = written(inside.unionAll(sized.where(two).select("h", (F.col("all") - F.col("copies")).alias("n_links"))), "near-counts")
    discard(larger, arrays)
    return found


def join(docs: DataFrame, words: int = 5, percent: int = 80, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead
    to) and n_links (the number of other documents it links with) of every
    document; two documents link when the Jaccard of their shingle sets is at
    least ``percent``. Without ``count`` n_links is null.

    A text of fewer than ``words`` words is one shingle; a null, empty or blank
    text has none and links with nothing. Repeated rows and equal sets are one
    class and each come back. Ids are taken for unique: rows that share one go
    each by its own text, and classes with the same smallest id are one. A row
    without an id links with nothing and has no component. An empty table gives
    no rows. Only doc_id and text are read.
    """
    sets = written(posted(docs, words, percent, frequent_cells(docs, words)), "near-sets")
    known = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(known.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "near-classes")
    tiled = written(members(sets, percent), "near-tiles")
    rows = written(sets.select("doc_id", F.col("n").alias("n_shingles"), "h"), "near-docs")
    discard(sets)
    stars = written(plausible(tiled.where("lead IS NOT NULL").select(F.col("lead").alias("a"), F.col("h").alias("b")).distinct(), classes, percent), "near-stars")
    first = exact(stars, classes, docs, words, percent)
    discard(stars)
    label = components(first)
    marked = tiled.join(label.withColumnRenamed("node", "h"), "h", "left").select("key", "n", "h", "pos", "sig64", F.coalesce("label", "h").alias("label"))
    others = written(across(undecided(marked, classes), percent), "near-pairs")
    discard(tiled, label)
    second = exact(others, classes, docs, words, percent)
    # from here on a class goes by its smallest document, so a component's label is the answer
    name = classes.select(F.col("h").alias("a"), F.col("rep").alias("x"))
    links = first.unionAll(second).join(name, "a").join(name.toDF("b", "y"), "b").select("x", "y")
    final = components(links, "x", "y")
    discard(first, second, others)
    homes = classes.select("h", F.col("rep").alias("node"), "n", "copies").join(final, "node", "left").select("h", F.col("node").alias("rep"), "n", "copies", F.coalesce("label", "node").alias("component_id"))
    homes = written(homes, "near-homes")
    discard(classes, final)
    found, links = homes, F.lit(None).cast("long")
    if count:
        found = homes.join(link_counts(homes, docs, words, percent), "h", "left")
        links = F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1
    linked = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(found.select("h", "component_id", links.alias("n_links")), "h").select("doc_id", "n_shingles", "component_id", "n_links")
    alone = F.lit(0 if count else None).cast("long").alias("n_links")
    return linked.unionAll(rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), alone))


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest
    id, one row of it. Rows that are linked with nothing stay, also those
    without an id; rows that share an id go each by its own text. Only texts
    whose id and text fall into the cell of one that goes, or that comes
    twice, are shuffled. Columns may have any names."""
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)])
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    keyed = plain.withColumn("own", own)
    found = written(join(keyed.select(F.col("own").alias("doc_id"), "text"), words, percent, count=False).where("doc_id IS NOT NULL"), "near-found")
    ids = keyed.where("own IS NOT NULL").select(F.col("own").alias("doc_id"), F.col("doc_id").cast("long").alias("id")).distinct()
    places = found.select("doc_id", "component_id").distinct().join(ids, "doc_id")
    best = places.groupBy("component_id").agg(F.min(F.struct("id", "doc_id"))["doc_id"].alias("stays"))
    goes = written(places.join(best, "component_id").where("doc_id <> stays").select(F.col("doc_id").alias("own")), "near-goes")
    twice = written(found.groupBy(F.col("doc_id").alias("own")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("own"), "near-twice")
    discard(found)
    cell = F.coalesce(F.pmod(F.xxhash64("own"), F.lit(CELLS)).cast("int"), F.lit(-1)).alias("cell")
    touched = goes.unionAll(twice).select(cell).distinct()  # CELLS numbers at most
    marked = keyed.select("*", cell)
    clear = marked.join(F.broadcast(touched), "cell", "left_anti")
    unclear = marked.join(F.broadcast(touched), "cell", "left_semi").join(goes, "own", "left_anti")
    return clear.select(*plain.columns).unionAll(unclear.dropDuplicates(["own"]).select(*plain.columns)).toDF(*docs.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE len(s) > 0),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS o
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p WHERE 100 * o >= 85 * (na + nb - o)),
l AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r(x, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.y, r.c FROM r JOIN l ON l.x = r.x
)
SELECT s.doc_id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, k.c AS component_id
FROM s JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) k ON k.x = s.doc_id
"""
