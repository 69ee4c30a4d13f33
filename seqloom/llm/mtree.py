"""Exact top-k by inner product through M-trees.

Vectors become integers, floor(256 * x).  Candidates are dealt to cells, each by the
nearest of at most ``PIVOTS`` candidates (those with the least hash of their id), and
large cells to blocks of about ``BLOCK`` rows.  No candidate x of the cell of pivot p
scores more than <q, p> + |q| r for a query q, where r is the cell's covering radius.

The queries, a stated set, first meet the blocks of the one cell whose pivot they like
best.  Their k-th best score there is a bound: of the other cells they meet only those
that can reach it.

A block is an M-tree: with one more coordinate that gives all its vectors the same
norm, the largest inner product is the least Euclidean distance, which is a metric.
Its paged nodes have a routing vector, a covering radius and the distance to the
parent's routing vector.  A search skips, through covering radii, stored parent
distances and the triangle inequality, whatever cannot be among the k best, mostly
without computing its distance.  All queries of a task go through the tree together:
each first meets the leaf that it reaches by always taking the nearest child, which
bounds it; then nodes are opened depth first, the nearest first, each by the queries that
can still find something in it, whose scores with a leaf are one matrix product.  Where
scores are too large to be exact as doubles, queries go one by one, best node first.
Bounds have a margin for rounding, and scores are exact integers, so results are exact.
Each block gives at most k rows for a query; the best of them are kept.

Equal vectors are one entry with their k + 1 smallest ids (the query's own may be
among them), which is all that can appear.

Defined cases: vectors that are null, or hold null or non-finite components, take
no part, nor do rows without an id; vectors of different lengths are not compared;
rows of the query's own id are no candidates; ties go to the smaller id; rows that
repeat an id and a vector count once; an empty table gives an empty result; other
columns are not read.  Scores are exact whatever the components' size; one
beyond a long is given as the greatest or least long, in the order of the exact scores
(up to 38 digits).  Vectors with a component of 1e120 or more take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ._common import arrow_map, column, stage, table

BLOCK = 16_384
PIVOTS = 64
#: Queries that meet a block in one task; as many as rows, as each side is sent once for so many of the other.
CHUNK = 16_384
#: Pairs of queries and rows whose scores are held at once.
PAIRS = 1 << 18
#: Integers up to here are exact as doubles.
EXACT = 2.0**53
#: Components from here on have no squares as doubles.
LARGEST = 1e120
PAGE = 128
FANOUT = 12


class MTree:
    """Bulk-loaded; points are rows of ``x`` (their distances: Euclidean)."""

    def __init__(self, x: np.ndarray, page: int = PAGE, fanout: int = FANOUT) -> None:
        self.x, self.page, self.fanout = x, page, fanout
        # of each node: routing vector, covering radius, distance to the parent's routing vector
        self.routing: list[np.ndarray] = []
        self.radius: list[float] = []
        self.parent: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.rows: list[np.ndarray | None] = []
        self.reach: list[np.ndarray | None] = []  # distances of a leaf's rows to its routing vector
        self.tables: list[tuple | None] = []
        if len(x):
            self._build(np.arange(len(x)), None)
        for kids in self.children:
            self.tables.append(None if kids is None else (np.array([self.routing[c] for c in kids]), np.array([self.radius[c] for c in kids]), np.array([self.parent[c] for c in kids])))
        self.leaf_x = [None if r is None else x[r] for r in self.rows]
        self.squares = [float((r**2).sum()) for r in self.routing]

    def _build(self, rows: np.ndarray, above: np.ndarray | None) -> int:
        points = self.x[rows]
        middle = points.mean(0)
        centre = points[((points - middle) ** 2).sum(1).argmin()]
        reach = np.sqrt(((points - centre) ** 2).sum(1))
        node = len(self.routing)
        self.routing.append(centre)
        self.radius.append(float(reach.max()))
        self.parent.append(0.0 if above is None else float(np.sqrt(((centre - above) ** 2).sum())))
        self.children.append(None)
        self.rows.append(None)
        self.reach.append(None)
        if len(rows) <= self.page or self.radius[node] == 0:
            order = np.argsort(reach, kind="stable")
            self.rows[node], self.reach[node] = rows[order], reach[order]
            return node
        # seeds far from each other; each row goes to the nearest
        seeds, least = [int(reach.argmax())], np.full(len(rows), np.inf)
        group = np.zeros(len(rows), np.int64)
        for k in range(self.fanout):
            d = ((points - points[seeds[-1]]) ** 2).sum(1)
            group[d < least] = k
            least = np.minimum(least, d)
            if least.max() == 0 or k == self.fanout - 1:
                break
            seeds.append(int(least.argmax()))
        kids = [self._build(rows[group == k], centre) for k in np.unique(group)]
        self.children[node] = np.array(kids)
        return node

    def search(self, q: np.ndarray, consider, limit, margin: float) -> None:
        """Give ``consider`` the leaf rows that can be nearer than ``limit()``."""
        if not self.routing:
            return
        d = float(np.sqrt(((self.routing[0] - q) ** 2).sum()))
        heap = [(max(0.0, d - self.radius[0]), 0, d)]
        while heap:
            bound, node, d = heapq.heappop(heap)
            most = limit() + margin
            if bound > most:
                return
            kids = self.children[node]
            if kids is None:
                near = np.abs(self.reach[node] - d) <= most
                if near.any():
                    consider(self.rows[node][near], self.leaf_x[node][near])
                continue
            routing, radius, parent = self.tables[node]
            for k in np.flatnonzero(np.abs(parent - d) - radius <= most):
                to = float(np.sqrt(((routing[k] - q) ** 2).sum()))
                if to - radius[k] <= most:
                    heapq.heappush(heap, (max(0.0, to - radius[k]), int(kids[k]), to))

    def search_all(self, q: np.ndarray, consider, limit, margin: np.ndarray) -> None:
        """``search`` for the rows of ``q`` at once.  ``limit(at)`` has a distance for
        each of those queries; ``consider(at, rows, points)`` gets queries and the leaf
        rows that some of them can need, each query and row at most once."""
        if not self.routing or not len(q):
            return
        square = (q**2).sum(1)

        def distances(at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            routing = np.array([self.routing[c] for c in nodes])
            return np.sqrt(np.maximum(square[at][:, None] + np.array([self.squares[c] for c in nodes]) - 2 * (q[at] @ routing.T), 0.0))

        home = np.zeros(len(q), np.int64)  # the leaf that a query meets first
        stack: list[tuple] = [(0, np.arange(len(q)))]
        while stack:
            node, at = stack.pop()
            if (kids := self.children[node]) is None:
                home[at] = node
                consider(at, self.rows[node], self.leaf_x[node])
                continue
            nearest = distances(at, kids).argmin(1)
            stack += [(int(kids[k]), at[nearest == k]) for k in np.unique(nearest)]
        everyone = np.arange(len(q))
        stack = [(0, everyone, distances(everyone, np.array([0]))[:, 0])]
        while stack:
            node, at, d = stack.pop()
            most = limit(at) + margin[at]
            open_ = (d - self.radius[node] <= most) & (home[at] != node)
            if not open_.all():
                at, d, most = at[open_], d[open_], most[open_]
            if not len(at):
                continue
            kids = self.children[node]
            if kids is None:
                # rows by their distance to the routing vector: each query needs a range of them
                low, high = np.searchsorted(self.reach[node], d - most), np.searchsorted(self.reach[node], d + most, "right")
                some = low < high
                if some.any():
                    part = slice(low[some].min(), high[some].max())
                    consider(at[some], self.rows[node][part], self.leaf_x[node][part])
                continue
            _, radius, parent = self.tables[node]
            near = np.abs(parent - d[:, None]) - radius <= most[:, None]
            tried = np.flatnonzero(near.any(0))
            to = distances(at, kids[tried])
            near = near[:, tried] & (to - radius[tried] <= most[:, None])
            for k in np.argsort(-to.mean(0)):  # the last one is opened first
                if near[:, k].any():
                    stack.append((int(kids[tried[k]]), at[near[:, k]], to[near[:, k], k]))


def _scores(points: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact inner products: as doubles where all sums are, else in whole numbers."""
    if not points.size or np.abs(points).max() * max(np.abs(q).max(), 1.0) * len(q) < EXACT:
        return (points @ q).astype(np.int64).tolist()
    whole = [int(v) for v in q]
    return [sum(int(a) * b for a, b in zip(row, whole)) for row in points.tolist()]


class Block:
    """Candidates of one length: ids and integer vectors, with their M-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        first = np.flatnonzero(new)
        self.vectors, self.k = vectors[first], k
        self.ids = [np.unique(part)[: k + 1] for part in np.split(ids, first[1:])] if len(ids) else []
        squares = (self.vectors**2).sum(1)
        self.top = float(squares.max()) if len(squares) else 0.0
        self.most = float(np.abs(self.vectors).max(initial=0.0))
        self.tree = MTree(np.concatenate([self.vectors, np.sqrt(self.top - squares)[:, None]], axis=1))

    def exact(self, q: np.ndarray) -> bool:
        """Whether all sums that scores and distances to ``q`` need are exact as doubles."""
        return 4 * max(self.most, float(np.abs(q).max(initial=0.0)), 1.0) ** 2 * q.shape[1] < EXACT

    def best_all(self, own: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best`` for the rows of ``q``, which must be ``exact``, without a bound
        where ``least`` is -inf: query's index, score and id, by query and rank."""
        k, square = self.k, (q**2).sum(1)
        scores, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        count = np.array([len(i) for i in self.ids], np.int64)
        flat, begin = np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.cumsum(count) - count

        def low(at: np.ndarray) -> np.ndarray:
            return np.maximum(scores[at, -1], least[at])  # without k rows the last is -inf

        def limit(at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[at] + self.top - 2 * low(at), 0.0))

        def consider(at: np.ndarray, rows: np.ndarray, points: np.ndarray) -> None:
            step = max(1, PAIRS // len(rows))
            for first in range(0, len(at), step):
                score_part(at[first : first + step], rows, points)

        def score_part(at: np.ndarray, rows: np.ndarray, points: np.ndarray) -> None:
            found = q[at] @ points[:, :-1].T
            i, j = np.nonzero(found >= low(at)[:, None])
            if not len(i):
                return
            n = count[rows[j]]  # ids of each vector found
            entry = np.repeat(begin[rows[j]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            who, score, other = np.repeat(at[i], n), np.repeat(found[i, j], n), flat[entry]
            keep = other != own[who]
            asked = np.unique(who)
            who = np.concatenate([np.repeat(asked, k), who[keep]])
            score, other = np.concatenate([scores[asked].ravel(), score[keep]]), np.concatenate([ids[asked].ravel(), other[keep]])
            order = np.lexsort((other, -score, who))
            who = who[order]
            first = np.searchsorted(who, asked)[:, None] + np.arange(k)  # each has k entries at least
            scores[asked], ids[asked] = score[order][first], other[order][first]

        self.tree.search_all(np.concatenate([q, np.zeros((len(q), 1))], axis=1), consider, limit, 1e-6 * (1 + np.sqrt(square + self.top)))
        there = np.isfinite(scores)
        return np.nonzero(there)[0], scores[there].astype(np.int64), ids[there]

    def best(self, own: int, q: np.ndarray, least: float | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``least``, ties to the smaller id,
        without ``own``."""
        k, square = self.k, float((q**2).sum())
        best: list[tuple[int, int]] = []  # heap of (score, -id)

        def bound() -> float | None:
            return best[0][0] if len(best) == k else least

        def limit() -> float:
            low = bound()
            return np.inf if low is None else np.sqrt(max(square + self.top - 2 * low, 0.0))

        def consider(rows: np.ndarray, points: np.ndarray) -> None:
            scores, low = _scores(points[:, :-1], q), bound()
            for row, score in zip(rows.tolist(), scores):
                if low is not None and score < low:
                    continue
                for i in self.ids[row].tolist():
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                    else:
                        break

        margin = 1e-6 * (1 + np.sqrt(square + self.top))
        self.tree.search(np.append(q, 0.0), consider, limit, margin)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(256.0 * values).reshape(len(column), width)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest pivot of each vector, and its distance."""
    squares = (pivots**2).sum(1)
    cell = (squares[None] - 2 * (vectors @ pivots.T)).argmin(1)
    return cell, np.sqrt(((vectors - pivots[cell]) ** 2).sum(1))


def _deal(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds cell (-1 where no pivot has that length) and distance to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = column(batch, "width")
            cell, far = np.full(len(width), -1, np.int32), np.zeros(len(width))
            for w, (numbers, points) in pivots.items():
                at = np.flatnonzero(width == w)
                if len(at):
                    near, distance = nearest_pivots(_matrix(batch.column(1).take(pa.array(at)), w), points)
                    cell[at], far[at] = numbers[near], distance
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _meet(pivots: dict[int, tuple[np.ndarray, np.ndarray]], radius: dict[int, float]):
    """Adds ``first``, the cell to meet first, and ``others``, all other cells with
    the highest score that a candidate of theirs can have."""
    kind = pa.list_(pa.struct([("cell", pa.int32()), ("most", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = column(batch, "width")
            first: list[int] = [-1] * len(width)
            others: list[list] = [[] for _ in width]
            for w, (numbers, points) in pivots.items():
                at = np.flatnonzero(width == w)
                if not len(at):
                    continue
                q = _matrix(batch.column(1).take(pa.array(at)), w)
                size, reach = np.sqrt((q**2).sum(1))[:, None], np.array([radius.get(c, -1.0) for c in numbers.tolist()])
                like = q @ points.T
                most = like + size * reach + 1e-6 * (1 + size * (reach + np.sqrt((points**2).sum(1)))[None])
                like[:, reach < 0] = -np.inf  # cells without candidates
                best = like.argmax(1)
                for i, row in enumerate(at.tolist()):
                    first[row] = int(numbers[best[i]])
                    others[row] = [{"cell": int(c), "most": float(m)} for k, (c, m) in enumerate(zip(numbers, most[i])) if k != best[i] and reach[k] >= 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(others, kind)], names=[*batch.schema.names, "first", "others"])

    return run


_OUT = "query_id long, query_key long, vec_id long, score long, exact string"


def _solve(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if candidates.num_rows and queries.num_rows:
            width = candidates.column("width")[0].as_py()
            block, asked = Block(candidates.column("vec_id").to_numpy(), _matrix(candidates.column("embedding"), width), k), _matrix(queries.column("embedding"), width)
            if block.exact(asked):
                own, key = (queries.column(c).to_numpy() for c in ("vec_id", "query_key"))
                at, score, vec_id = block.best_all(own, asked, queries.column("least").fill_null(-np.inf).to_numpy())
                return pa.table({"query_id": own[at], "query_key": key[at], "vec_id": vec_id, "score": score, "exact": pa.nulls(len(at), pa.string())})
            for own, key, least, q in zip(*(queries.column(c).to_pylist() for c in ("vec_id", "query_key", "least")), asked):
                rows += [(own, key, i, max(min(s, 2**63 - 1), -(2**63)), None if abs(s) < 2**63 else str(s)) for s, i in block.best(own, q, least)]
        cols = zip(*rows) if rows else [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "query_key", "vec_id", "score", "exact"), cols, [pa.int64()] * 4 + [pa.string()])})

    return run


def _search(candidates: DataFrame, visits: DataFrame, subs: dict[int, int], k: int, chunk: int) -> DataFrame:
    """_OUT for ``visits`` (vec_id, query_key, embedding, width, least, cell): each
    query with all blocks of a cell.  Queries of a cell are dealt into parts."""
    visits = visits.withColumn("cell", F.coalesce("cell", F.lit(-1)))
    asked = {r.cell: r["count"] for r in visits.groupBy("cell").count().collect()}  # a row for each cell
    lookup = lambda values, least: F.coalesce(F.get(F.array(*(F.lit(values.get(c, least)) for c in range(-1, PIVOTS))), F.col("cell") + 1), F.lit(least))
    parts = {c: -(-n // chunk) for c, n in asked.items()}
    many, blocks = lookup(parts, 0), lookup(subs, 1)
    keys = ("width", "cell", "block", "part")
    left = candidates.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).filter(many > 0).withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    right = visits.withColumn("part", F.pmod(F.xxhash64("vec_id", "query_key"), many).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = max(1, min(sum(p * subs.get(c, 1) for c, p in parts.items()), 4096))
    left, right = (df.repartition(tasks, *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_solve(k), _OUT)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product."""
    spark = vectors.sparkSession
    ship(spark)

    def valid(df: DataFrame) -> DataFrame:
        base = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
        return base.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))).withColumn("width", F.size("embedding"))

    candidates = valid(vectors)
    # a few cells for each block's worth of candidates: smaller ones cost more visits than they spare
    wanted = min(PIVOTS, max(8, 4 * -(-candidates.count() // block)))
    some = candidates.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()  # at most PIVOTS rows
    pivots = {w: (np.array([i for i, r in enumerate(some) if r.width == w]), np.floor(256.0 * np.array([r.embedding for r in some if r.width == w], float)).reshape(-1, w)) for w in {r.width for r in some}}
    dealt = stage(arrow_map(candidates, _deal(pivots), "vec_id long, embedding array<double>, width int, cell int, far double"), "cells")
    cells = {r.cell: r for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}  # a row for each cell
    subs = {c: -(-r.n // block) for c, r in cells.items()}
    asked = valid(queries).distinct().withColumn("query_key", F.xxhash64("embedding"))
    asked = stage(arrow_map(asked, _meet(pivots, {c: r.radius for c, r in cells.items()}), "vec_id long, embedding array<double>, width int, query_key long, first int, others array<struct<cell:int,most:double>>"), "queries")
    given = ("vec_id", "embedding", "width", "query_key")
    near = stage(_search(dealt, asked.select(*given, F.lit(None).cast("double").alias("least"), F.col("first").alias("cell")), subs, k, chunk), "near")
    # the k-th best score so far; without k, or beyond a long, there is no bound
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc(F.col("score")), "vec_id")
    # as a double that is not above it: from EXACT on a cast may round up
    score = F.col("score").cast("double")
    least = F.when(F.abs(score) < EXACT, score).otherwise(score - F.abs(score) * 2.0**-52)
    bound = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).filter("abs(score) < 4611686018427387904").select(F.col("query_id").alias("vec_id"), "query_key", least.alias("least"))
    later = asked.join(bound, ["vec_id", "query_key"], "left").select(*given, "least", F.explode("others").alias("o")).filter("least IS NULL OR o.most >= least")
    far = _search(dealt, later.select(*given, "least", F.col("o.cell").alias("cell")), subs, k, chunk)
    found = near.unionByName(far)
    # scores beyond a long in their exact order, as far as decimals go
    wide = F.coalesce(F.expr("try_cast(exact AS decimal(38, 0))"), F.when(F.col("exact").startswith("-"), F.lit("-" + "9" * 38)).when(F.col("exact").isNotNull(), F.lit("9" * 38)).cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)"))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc(wide), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
