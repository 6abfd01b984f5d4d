"""Exact top-k search by inner product with two cover trees.

Vectors go to the cell of their nearest pivot, large cells to several blocks
of bounded size. Each block of candidates gets a cover tree, built once; the
queries that come to it get one too, a run at a time. A node's children form a
net of half its radius, and each node knows the radius of the ball and of the
cone around its center that hold its points. A pair of nodes is dropped when the
largest inner product that both allow is below the worst kth score of the
queries below the query node; at the query tree's leaves each query has its own
bound. Queries look first into their own cell, and then go only to cells that
can still better their kth score.

Components are whole numbers, so scores are exact and ties are settled by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, spread, written

LEAF = 8
#: Rows of a leaf of the queries' tree; products of more rows at once are far cheaper a pair.
ASK_LEAF = 64
#: Children of a node at most.
FAN = 32
#: Candidates of a block, about; and queries of a tree.
BLOCK = 4096
ASKED = 512
#: Cells at most; their pivots and measures are the only broadcasts.
CELLS = 1024
#: Queries that a block's task looks up; more are shared among several.
SHARE = 200_000
#: Leaves of the first look, and leaves scored at once.
SEEDS = 3
AT_ONCE = 32
#: Sums below this are whole in double precision.
EXACT = 2.0**52


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(-1))


class CoverTree:
    """Nodes as parallel lists; a node's rows are its points.

    A node's children are centers picked one by one, each the row farthest from
    those before, until all rows are within half the node's radius or as
    many are there as give children of half a leaf's rows, FAN at most (in many
    dimensions half the radius would take nearly every row); a row belongs to its nearest center.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        self.square = (x * x).sum(1)
        self.norm = np.sqrt(self.square)
        self.children: list[list[int]] = []
        self.points: list[np.ndarray] = []
        center: list[int] = []
        figures: list[tuple[float, float, float, float]] = []
        stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), 0, -1)]
        while stack:
            rows, middle, parent = stack.pop()
            y, square = x[rows], self.square[rows]
            away = self.from_center(y, square, middle)
            me, radius = len(center), float(away.max())
            center.append(middle)
            norm = self.norm[rows]
            figures.append((radius * (1 + 1e-9) + 1e-6, cone(y @ x[middle], norm, self.norm[middle]), norm.min(), norm.max()))
            self.children.append([])
            self.points.append(rows)
            if parent >= 0:
                self.children[parent].append(me)
            if len(rows) <= leaf or radius == 0:
                continue
            owner, centers = np.zeros(len(rows), np.int64), [middle]
            fan = min(FAN, max(2, 2 * len(rows) // leaf))
            while len(centers) < fan and away.max() > radius / 2:
                pick = int(rows[int(away.argmax())])
                d = self.from_center(y, square, pick)
                closer = d < away
                owner[closer], away[closer] = len(centers), d[closer]
                centers.append(pick)
            for i in range(len(centers)):
                part = rows[owner == i]
                if 0 < len(part) < len(rows):
                    stack.append((part, centers[i], me))
        self.center = np.array(center)
        self.radius, self.cone, self.least, self.most = np.array(figures).T
        self.leaf = np.array([not c for c in self.children])
        self.middle, self.middle_norm = x[self.center], self.norm[self.center]

    def from_center(self, y: np.ndarray, square: np.ndarray, center: int) -> np.ndarray:
        """Distances of rows from a row; rounding can't make one too short by
        more than the slack that radii have."""
        return np.sqrt(np.maximum(square - 2 * (y @ self.x[center]) + self.square[center], 0) + 1e-12 * (square + self.square[center]))


def angles(products: np.ndarray, norms: np.ndarray, center_norms: np.ndarray | float) -> np.ndarray:
    """The angles between centers and points, with slack; half a turn where
    there is no direction."""
    sizes = norms * center_norms
    cosines = np.divide(products, sizes, out=np.full(len(products), -1.0), where=sizes > 0)
    return np.minimum(np.pi, np.arccos(np.clip(cosines, -1, 1)) + 1e-6)


def cone(products: np.ndarray, norms: np.ndarray, center_norm: float) -> float:
    """The widest angle between a center and points."""
    return float(angles(products, norms, center_norm).max())


def tops(q: np.ndarray, q_norm: np.ndarray, q_radius, q_cone, q_most, c: np.ndarray, c_norm: np.ndarray, c_radius: np.ndarray, c_cone: np.ndarray, c_least: np.ndarray, c_most: np.ndarray) -> np.ndarray:
    """Above any inner product between points around q (rows) and around c:
    the smaller of what the balls and what the cones allow."""
    col = lambda v: np.broadcast_to(np.asarray(v, float), len(q))[:, None]
    qr, qc, qm = col(q_radius), col(q_cone), col(q_most)
    product = q @ c.T
    ball = product + q_norm[:, None] * c_radius + c_norm * qr + qr * c_radius
    sizes = q_norm[:, None] * c_norm
    apart = np.arccos(np.clip(np.divide(product, sizes, out=np.ones_like(product), where=sizes > 0), -1, 1)) - 1e-6
    best = np.cos(np.maximum(apart - qc - c_cone, 0))
    # a negative cosine is best for the shortest; a group of queries may hold one of length zero
    ray = np.where(best >= 0, best * qm * c_most, np.where(qr > 0, 0, best * qm * c_least))
    ray = np.where(sizes > 0, ray, np.inf)
    return np.minimum(ball, ray) + 1e-9 * qm * c_most + 1


class Best:
    """The k best (score, id) of each query so far, and what the kth must reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k = k
        self.worst = floors.astype(float)
        self.scores = [np.zeros(0, np.int64)] * len(floors)
        self.ids = [np.zeros(0, np.int64)] * len(floors)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[order], i[order]
        if len(order) == self.k:
            self.worst[q] = max(self.worst[q], float(s[order[-1]]))


class Candidates:
    """A block's rows and their tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.tree = CoverTree(x.astype(float))
        self.top = float(np.abs(x.astype(float)).max(initial=0))


def search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, block: Candidates, k: int, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, candidate ids and scores of each query's k best candidates
    in the block that reach its floor. ``count`` gets the pairs scored."""
    asks, right = CoverTree(queries.astype(float), ASK_LEAF), block.tree
    whole = float(np.abs(asks.x).max(initial=0)) * block.top * max(1, queries.shape[1]) < EXACT
    exact_q, exact_c = (asks.x, right.x) if whole else (queries.astype(object), block.x.astype(object))
    best = Best(floors, k)

    def bounds(rows: np.ndarray | None, node: int, among: np.ndarray) -> np.ndarray:
        of = (right.middle[among], right.middle_norm[among], right.radius[among], right.cone[among], right.least[among], right.most[among])
        if rows is None:
            some = slice(node, node + 1)
            return tops(asks.middle[some], asks.middle_norm[some], asks.radius[some], asks.cone[some], asks.most[some], *of)
        return tops(asks.x[rows], asks.norm[rows], 0.0, 0.0, asks.norm[rows], *of)

    def score(rows: np.ndarray, leaves: list[int]) -> None:
        cols = np.concatenate([right.points[b] for b in leaves])
        scores = exact_q[rows] @ exact_c[cols].T
        if count is not None:
            count[0] += scores.size
        hits = (scores >= best.worst[rows][:, None]) & (block.ids[cols][None, :] != query_ids[rows][:, None])
        for i in np.flatnonzero(hits.any(1)):
            at = np.flatnonzero(hits[i])
            best.offer(int(rows[i]), scores[i, at].astype(np.int64), block.ids[cols[at]])

    def first_look(rows: np.ndarray, middle: np.ndarray) -> set[int]:
        """Down to a few leaves near the queries' middle."""
        front = [0]
        while not right.leaf[front].all():
            front = [c for b in front for c in (right.children[b] or [b])]
            front = [front[i] for i in np.argsort(-(right.middle[front] @ middle), kind="stable")[:SEEDS]]
        score(rows, front)
        return set(front)

    def below(nodes: np.ndarray) -> np.ndarray:
        return np.array([c for b in nodes.tolist() for c in (right.children[b] or [b])], np.int64)

    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        node, among = stack.pop()
        rows = asks.points[node]
        if asks.children[node]:
            among = among[bounds(None, node, among)[0] >= best.worst[rows].min()]
            stack += [(child, below(among)) for child in asks.children[node] if len(among)]
            continue
        looked = first_look(rows, asks.middle[node])
        while len(among):
            top = bounds(rows, node, among)
            keep = (top >= best.worst[rows][:, None]).any(0)
            among, top = among[keep], top[:, keep]
            done = right.leaf[among]
            leaves, high = among[done], top[:, done]
            order = np.argsort(-high.max(0, initial=-np.inf), kind="stable")
            for lo in range(0, len(order), AT_ONCE):  # the most promising first; kth scores rise meanwhile
                some = order[lo : lo + AT_ONCE]
                asking = high[:, some] >= best.worst[rows][:, None]
                some = [(i, int(leaves[j])) for i, j in enumerate(some) if int(leaves[j]) not in looked and asking[:, i].any()]
                if some:
                    score(rows[asking[:, [i for i, _ in some]].any(1)], [b for _, b in some])
            among = below(among[~done])
    sizes = [len(s) for s in best.scores]
    return np.repeat(query_ids, sizes), np.concatenate(best.ids), np.concatenate(best.scores)


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of each component; rows without an id or a
    vector, or with null or non-finite components, are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.forall("v", finite)).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


ROWS = "width int, block long, asks boolean, vec_id long, floor double, v array<long>"
FOUND = "query_id long, vec_id long, score long"


def answered(rows: DataFrame, k: int) -> DataFrame:
    """FOUND for rows of ROWS: a block's candidates come before its queries, so
    that its tree is there when they come, run by run."""

    def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
        return batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            width, number, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edge = np.flatnonzero(np.concatenate(([True], (width[1:] != width[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), [True])))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if (width[lo], number[lo]) != at:
                    at, held, block = (width[lo], number[lo]), [], None
                x, ids = matrix(part, int(width[lo])), part.column(3).to_numpy()
                if not asks[lo]:
                    held.append((x, ids))
                    continue
                if block is None and held:
                    block = Candidates(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                if block is None:
                    continue
                floors = np.nan_to_num(part.column(4).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                for i in range(0, len(ids), ASKED):
                    some = slice(i, i + ASKED)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in search(x[some], ids[some], floors[some], block, k)], [c.split()[0] for c in FOUND.split(", ")])

    names = [c.split()[0] for c in ROWS.split(", ")]
    return rows.select(*names).repartition("width", "block").sortWithinPartitions("width", "block", "asks").mapInArrow(run, FOUND)


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows (vec_id, v, is_query) with width, cell (the nearest pivot's
    number), and distance, cosine and length for the cell's measures."""
    known = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            width = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
            cell, away, turn, norm = np.zeros(len(width), np.int32), *(np.zeros(len(width)) for _ in range(3))
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w).astype(float)
                p = known.value.get(w, np.zeros((1, w)))
                square, size = (x * x).sum(1), (p * p).sum(1)
                apart = square[:, None] - 2 * (x @ p.T) + size
                mine = apart.argmin(1)
                cell[at], norm[at] = mine, np.sqrt(square)
                away[at] = np.sqrt(np.maximum(apart[np.arange(len(at)), mine], 0) + 1e-12 * (square + size[mine]))
                turn[at] = angles((x * p[mine]).sum(1), norm[at], np.sqrt(size)[mine])
            made = [pa.array(width, pa.int32()), pa.array(cell, pa.int32()), pa.array(away), pa.array(turn), pa.array(norm)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["vec_id", "v", "is_query", "width", "cell", "away", "turn", "norm"])

    return rows.select("vec_id", "v", "is_query").mapInArrow(run, "vec_id long, v array<long>, is_query boolean, width int, cell int, away double, turn double, norm double")


def reachable(asked: DataFrame, cells: dict[int, tuple], pivots: dict[int, np.ndarray]) -> DataFrame:
    """asked (vec_id, v, width, home, floor) with each other ``cell`` that may
    hold a score of its floor or more."""
    known = asked.sparkSession.sparkContext.broadcast((cells, pivots))
    names = ["vec_id", "v", "width", "home", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, pivots = known.value
        for whole in batches:
            for lo in range(0, whole.num_rows, ASKED):
                batch = whole.slice(lo, ASKED)
                width, home, floor = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                floor = np.nan_to_num(floor.astype(float), nan=-np.inf)
                for w in np.unique(width).tolist():
                    if w not in cells:
                        continue
                    at = np.flatnonzero(width == w)
                    x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w).astype(float)
                    number, radius, turn, least, most = cells[w]
                    p = pivots.get(w, np.zeros((1, w)))[number]
                    top = tops(x, lengths(x), 0.0, 0.0, lengths(x), p, lengths(p), radius, turn, least, most)
                    i, j = np.nonzero((top >= floor[at][:, None]) & (number[None, :] != home[at][:, None]))
                    taken = batch.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(number[j], pa.int32())], [*names, "cell"])

    return asked.select(*names).mapInArrow(run, "vec_id long, v array<long>, width int, home int, floor double, cell int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """Each query's k highest inner products among all other rows.

    Returns query_id, rank (from 1), vec_id, score; equal scores go by smaller
    id. Fewer candidates than k give fewer rows. Vectors are compared with
    vectors of the same length only; equal query rows are asked once, query rows
    of one id with different vectors are asked each and ranked in one list, and
    rows with a query's id aren't its candidates. An empty table gives no rows.
    Products beyond double precision are worked out in whole numbers; a score
    must fit 64 bits.
    """
    rows = written(whole_vectors(vectors, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False))), "top-vectors")
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(CELLS, max(1, -(-n // block)))).select("v").collect()
    pivots: dict[int, np.ndarray] = {}
    for w in {len(r["v"]) for r in picked}:
        pivots[w] = np.unique(np.array([r["v"] for r in picked if len(r["v"]) == w], float), axis=0) if w else np.zeros((1, 0))
    # a row's number parts the rows of a large cell, also those of one id; it settles no result
    placed = written(in_cells(rows, pivots).withColumn("row", F.monotonically_increasing_id()), "top-placed")
    discard(rows)
    measures = placed.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.max("turn").alias("turn"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    # at most CELLS cells have a pivot, and one a width has none
    sized = measures.withColumn("subs", F.ceil(F.col("n") / block).cast("int"))
    cells: dict[int, tuple] = {}
    found = sorted(sized.collect(), key=lambda r: (r["width"], r["cell"]))
    for w in {r["width"] for r in found}:
        mine = [r for r in found if r["width"] == w]
        of = lambda c: np.array([r[c] for r in mine])  # noqa: B023, E731
        cells[w] = (of("cell"), of("away") * (1 + 1e-9) + 1e-6, of("turn"), of("least"), of("most"))
    subs = written(sized.select("width", "cell", "subs"), "top-cells")
    number = F.xxhash64("cell", "sub", "turn_of")
    asked = placed.where("is_query").select("vec_id", "v", "width", F.col("cell").alias("home")).distinct()
    shares = max(1, -(-placed.where("is_query").count() // share))

    def ask(queries: DataFrame) -> DataFrame:
        """FOUND for queries (vec_id, v, width, cell, floor) in their cells."""
        every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
        candidates = placed.join(subs, ["width", "cell"]).select("width", "cell", "vec_id", "v", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int").alias("sub"), every(F.lit(shares)).alias("turn_of"))
        come = queries.join(subs, ["width", "cell"]).select("width", "cell", "vec_id", "v", "floor", spread([F.col("vec_id"), F.lit(7)], shares).alias("turn_of"), every(F.col("subs")).alias("sub"))
        both = candidates.select("width", number.alias("block"), F.lit(False).alias("asks"), "vec_id", F.lit(None).cast("double").alias("floor"), "v").unionAll(come.select("width", number.alias("block"), F.lit(True).alias("asks"), "vec_id", "floor", "v"))
        return answered(both, k)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = written(ranked(ask(asked.select("vec_id", "v", "width", F.col("home").alias("cell"), F.lit(None).cast("double").alias("floor")))), "top-near")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    far = ask(reachable(asked.join(floors, "vec_id", "left"), cells, pivots))
    return ranked(near.drop("rank").unionAll(far)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
