"""Nearest neighbours by inner product: few stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors are given one more coordinate so that all have the length M of the
longest, and queries are scaled to M: then the largest inner product is the
smallest distance.  Projected on m Gaussian directions, a squared distance d2
becomes d2 times a chi-square variable of m degrees.  Projected neighbours are
taken up in order of their projected distance r2, a leaf of the kd-tree at a
time, and verified on the original vectors where they pass the test themselves;
once r2 / d2(k), for the k-th best distance so far, exceeds the chi-square
quantile at ``sure``, a better vector would have come up already with at least
that probability, and the search ends.  Queries that stand before the same leaf
are verified together.

Across the cluster: the upper levels of the kd-tree are cut on a bounded sample
(``SAMPLE`` rows), every row is put in its block, and blocks that outgrow a task
are dealt out in pieces, queries in parts of ``PART``.  A query's k-th best in
the sample bounds its distance from above, so it only goes to blocks whose box
passes the same test; each block builds the lower levels over its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogable.llm import store

#: Directions and certainty: of isotropic vectors of 64 dimensions fewer directions leave more rows to verify at the same recall.
M, SURE, SEED = 24, 0.94, 31
#: Rows of the sample; rows that a block should have; rows of a leaf; queries of a task.
SAMPLE, BLOCK, LEAF, PART = 10_000, 16_384, 256, 32_768
#: Blocks at most; beyond, blocks get larger and are dealt out in pieces.
MOST_BLOCKS = 1 << 15


def chi_square(x: float, m: int) -> float:
    """The distribution function for an even number of degrees."""
    term, total = 1.0, 1.0
    for j in range(1, m // 2):
        term *= x / 2 / j
        total += term
    return 1 - exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


class Tree:
    """A kd-tree's cuts, made by halving at medians of the widest direction, to a number of leaves."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.cuts: list[tuple[int, float, int, int]] = []
        self.leaves: list[tuple[int, int]] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[self.order[a:b]]
            spread = own.max(0) - own.min(0) if b > a else np.zeros(1)
            if b - a <= leaf or not spread.max() > 0:
                here = -1 - len(self.leaves)
                self.leaves.append((a, b))
            else:
                axis, half = int(spread.argmax()), (b - a) // 2
                along = own[:, axis]
                cut = float(np.partition(along, half)[half])
                if not (along < cut).any():  # the median is the minimum: cut above it
                    cut = float(along[along > cut].min())
                lower = int((along < cut).sum())
                self.order[a:b] = self.order[a:b][np.argsort(along >= cut, kind="stable")]
                here = len(self.cuts)
                self.cuts.append((axis, cut, 0, 0))
                todo += [(a, a + lower, here, 2), (a + lower, b, here, 3)]
            if parent >= 0:
                above = list(self.cuts[parent])
                above[side] = here
                self.cuts[parent] = tuple(above)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int32)
        todo = [(0 if self.cuts else -1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, cut, below, above = self.cuts[node]
            up = points[rows, axis] >= cut
            todo += [(below, rows[~up]), (above, rows[up])]
        return out


class Space:
    """Lengths made equal, and the projections."""

    def __init__(self, dim: int, longest: float):
        self.longest = longest
        self.directions = np.random.default_rng(SEED).standard_normal((dim + 1, M))

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.concatenate((x, rest[:, None]), 1) @ self.directions

    def queries(self, x: np.ndarray) -> np.ndarray:
        return (x * (self.longest / np.sqrt((x * x).sum(1)))[:, None]) @ self.directions[:-1]

    def squared(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Squared distance by inner product; a rounding error's size at least."""
        return np.maximum(2 * self.longest**2 - 2 * self.longest * score / length, 1e-12 * self.longest**2)


def _gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes."""
    out = np.zeros((len(points), len(low)))
    for i in range(points.shape[1]):
        at = points[:, i, None]
        off = np.maximum(np.maximum(low[None, :, i] - at, at - high[None, :, i]), 0)
        out += off * off
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


_FOUND = "query_id long, vec_id long, score double"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Best:
    """The k best of each query so far; equal scores go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.at, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.last = np.full(queries, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """More finds of the queries ``at``."""
        touched = np.isin(self.at, at)
        at, ids, scores = (np.concatenate((old[touched], new)) for old, new in ((self.at, at), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        full = rank == self.k - 1
        self.last[at[full]] = scores[full]
        kept = rank < self.k
        self.at, self.ids, self.scores = (np.concatenate((old[~touched], new[kept])) for old, new in ((self.at, at), (self.ids, ids), (self.scores, scores)))


def search(space: Space, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, limit: float, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best of these rows, by the incremental search; ``tally`` collects how many rows were verified."""
    points = space.rows(x)
    tree = Tree(points, LEAF)
    ids, x, points = ids[tree.order], x[tree.order], points[tree.order]
    low = np.stack([points[a:b].min(0) for a, b in tree.leaves])
    high = np.stack([points[a:b].max(0) for a, b in tree.leaves])
    lengths, at, best, bounds = np.sqrt((q * q).sum(1)), space.queries(q), Best(len(q), k), bounds.copy()
    gaps, sizes, own = _gaps(at, low, high), (points * points).sum(1), (at * at).sum(1)
    order, slack = np.argsort(gaps, axis=1, kind="stable"), 1e-12 * space.longest * lengths
    going = np.arange(len(q))
    for step in range(len(tree.leaves)):
        leaf = order[going, step]
        going = going[gaps[going, leaf] <= limit * bounds[going]]
        if not len(going):
            break
        leaf = order[going, step]
        by = np.argsort(leaf, kind="stable")
        found: list[tuple] = []
        for group in np.split(going[by], np.flatnonzero(np.diff(leaf[by])) + 1):
            a, b = tree.leaves[order[group[0], step]]
            projected = own[group, None] + sizes[None, a:b] - 2 * at[group] @ points[a:b].T
            near = (projected <= limit * bounds[group, None]) & (ids[None, a:b] != qids[group, None])
            if tally is not None:
                tally.append(int(near.sum()))
            row, column = np.nonzero(near & (q[group] @ x[a:b].T >= best.last[group, None] - slack[group, None]))
            # A product of matrices may round like rows apart; what is kept is summed row by row, so that copies tie.
            found.append((group[row], ids[a + column], (x[a + column] * q[group[row]]).sum(1)))
        new = tuple(np.concatenate(c) for c in zip(*found, strict=True))
        if len(new[0]):
            best.add(*new)
            full = np.isfinite(best.last[going])
            bounds[going[full]] = np.minimum(bounds[going[full]], space.squared(best.last[going[full]], lengths[going[full]]))
    return qids[best.at], best.ids, best.scores


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row for which the column ``is_query`` holds, its k nearest other rows.

    Score is the inner product in double precision, ties go to the smaller id.
    Rows with a null id, and vectors that are null, empty, zero, hold a null or
    non-finite value, or have another length than most (of equally frequent
    lengths, than the longest), take no part.  Rows of a query's own id are no
    candidates; a query id that repeats is searched once.  With fewer than k
    candidates all are returned.  An empty table gives an empty one.  Other
    columns of the input are not read.
    """
    spark = df.sparkSession
    place, limit = store.folder(spark, "neighbours"), quantile(sure, M)
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("squares", F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).filter("squares > 0")
    kinds = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("squares").alias("top")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not kinds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest = kinds[0]["dim"], kinds[0]["n"], float(kinds[0]["top"]) ** 0.5
    rows, space = rows.filter(F.size("v") == dim).drop("squares"), Space(dim, longest)

    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample_ids, sample_x = sample["id"].to_numpy(), _vectors(sample["v"])
    blocks = min(MOST_BLOCKS, -(-n // BLOCK))
    tree = Tree(space.rows(sample_x), -(-len(sample_ids) // blocks))
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                points = space.rows(_vectors(batch.column("v")))
                place = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * M, pa.int32()), pa.array(points.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(points)), place], names=["id", "v", "asks", "block", "p"])

    index = store.keep(rows.select("id", "v", "asks").mapInArrow(assign, "id long, v array<double>, asks boolean, block int, p array<double>"), f"{place}/index")
    side = lambda f, c: F.array(*[f(F.get("p", F.lit(i))) for i in range(M)]).alias(c)
    boxes = index.groupBy("block").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), side(F.min, "low"), side(F.max, "high")).orderBy("block").collect()
    numbers, low, high = np.array([r["block"] for r in boxes]), np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])
    pieces, parts = np.array([-(-r["n"] // (2 * BLOCK)) for r in boxes]), max(1, -(-sum(r["asked"] for r in boxes) // PART))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                q = _vectors(batch.column("v"))
                score = q @ sample_x.T
                score[batch.column("id").to_numpy()[:, None] == sample_ids[None, :]] = -np.inf
                last = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                known = np.isfinite(last)
                bound = np.where(known, space.squared(np.where(known, last, 0), np.sqrt((q * q).sum(1))), np.inf)
                row, at = np.nonzero(_gaps(space.queries(q), low, high) <= limit * bound[:, None])
                times = pieces[at]
                row, at, piece = np.repeat(row, times), np.repeat(at, times), np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(numbers[at], pa.int32()), pa.array(piece, pa.int32()), pa.array(bound[row])], names=["id", "v", "block", "piece", "bound"])

    def look(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(candidates) and len(asked):
            out = search(space, candidates["id"].to_numpy(), _vectors(candidates["v"]), asked["id"].to_numpy(), _vectors(asked["v"]), asked["bound"].to_numpy(), k, limit)
        return pa.Table.from_arrays([pa.array(o) for o in out], schema=_FOUND_ARROW)

    # Blocks are at most MOST_BLOCKS, so their pieces fit a broadcast.
    dealt = spark.createDataFrame([(int(b), int(p)) for b, p in zip(numbers, pieces, strict=True)], "block int, pieces int")
    candidates = index.select("id", "v", "block").join(F.broadcast(dealt), "block").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")).drop("pieces").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = index.filter("asks").select("id", "v").dropDuplicates(["id"]).mapInArrow(route, "id long, v array<double>, block int, piece int, bound double").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    tasks, keys = max(store.partitions(spark), int(pieces.sum()) * parts), ("block", "piece", "part")
    found = candidates.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(look, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
