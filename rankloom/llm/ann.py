"""Approximate nearest neighbours by stable projections and a chi-square stopping test.

Vectors are projected to `dims` dimensions by Gaussian directions: the squared projected distance of a pair at distance
r is r^2 times a chi-square variable with `dims` degrees of freedom. A kd-tree over the projections cuts the rows into
cells of about `cell` rows; its splits come from a bounded sample, those of a larger table in two levels, the second one
from samples of each coarse cell on the executors. A cell is one packed row with a kd-tree of leaves of its own.

Queries go out in blocks of bounded size. A query is searched in its own cell first, which bounds its k-th distance.
Then every cell drops the queries whose stopping test already holds for its box, and walks its leaves in order of
projected distance for the others. True distances are verified leaf by leaf, until with confidence `p` no nearer
neighbour is left unseen: next projected distance squared > the chi-square quantile of p times the k-th squared distance
so far. A true neighbour is missed with probability 1 - p at most. How many rows are verified depends on the data: where
all lie about equally far apart, no test of few dimensions can stop early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

#: Rows of a cell, about, and of a leaf inside it.
CELL, LEAF = 4096, 256
#: Projections that a level of the kd-tree is cut from at most, and those for each of its cells.
SAMPLE, PER_CELL = 131_072, 128
#: Bytes of query vectors that every task holds at a time.
QUERY_BYTES = 32 << 20


def chi_square_quantile(p: float, dims: int) -> float:
    """The quantile by bisection of the regularised incomplete gamma function, by its series."""
    from math import exp, lgamma, log

    def cdf(x: float) -> float:
        a, h = dims / 2, x / 2
        if h <= 0:
            return 0.0
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= h / n
            total += term
        return total * exp(a * log(h) - h - lgamma(a))

    low, high = 0.0, dims + 60 * dims**0.5
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def directions(width: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dims))


def kd_cuts(points: np.ndarray, leaves: int) -> list[tuple[int, float] | None]:
    """Splits of a kd-tree of `leaves` leaves, a power of two, in heap order: the widest dimension at its median."""
    out: list[tuple[int, float]] = []
    groups = [points]
    while len(groups) < leaves:
        nxt = []
        for g in groups:
            d = int(np.argmax(g.max(axis=0) - g.min(axis=0))) if len(g) else 0
            at = float(np.median(g[:, d])) if len(g) else 0.0
            out.append((d, at))
            nxt += [g[g[:, d] < at], g[g[:, d] >= at]]
        groups = nxt
    return out


def kd_leaf(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if not cuts:
        return at
    dim, value = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
    for _ in range((len(cuts) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), dim[at]] >= value[at])
    return at - len(cuts)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of each query from each box."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0)
        out += gap * gap
    return out


def _merge(best: np.ndarray, ids: np.ndarray, d: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k least of both by distance, then id; rows are queries."""
    k = best.shape[1]
    d, i = np.concatenate([best, d], axis=1), np.concatenate([ids, other], axis=1)
    if d.shape[1] > 4 * k:
        near = np.argpartition(d, 2 * k, axis=1)[:, : 2 * k + 1]
        edge = np.take_along_axis(d, near, axis=1).max(axis=1)
        # ties at the edge could hide a lesser id: then all of the row is sorted
        if (edge > np.partition(d, k - 1, axis=1)[:, k - 1]).all():
            d, i = np.take_along_axis(d, near, axis=1), np.take_along_axis(i, near, axis=1)
    by = np.lexsort((i, d), axis=1)[:, :k]
    return np.take_along_axis(d, by, axis=1), np.take_along_axis(i, by, axis=1)


class Cell:
    """Rows of one cell, ordered by the leaves of their own kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, spans: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.vectors, self.spans, self.low, self.high = ids, vectors, spans, low, high
        self.norms = (vectors**2).sum(axis=1)

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, leaf: int = LEAF) -> Cell:
        leaves = 1 << max(0, int(np.ceil(np.log2(max(1, len(ids) / leaf)))))
        at = kd_leaf(projected, kd_cuts(projected, leaves))
        by = np.argsort(at, kind="stable")
        p = projected[by]
        edges = np.searchsorted(at[by], np.arange(leaves + 1))
        spans = np.array([(a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a], np.int64).reshape(-1, 2)
        low = np.array([p[a:b].min(axis=0) for a, b in spans]).reshape(-1, p.shape[1])
        high = np.array([p[a:b].max(axis=0) for a, b in spans]).reshape(-1, p.shape[1])
        return cls(ids[by], vectors[by], spans, low, high)

    def search(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, bound: np.ndarray, k: int, quantile: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest rows of other ids that the incremental search verifies, for each query, and how many it verified
        in all; bound: known k-th squared distances."""
        n = len(ids)
        best, found = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        far = box_distance(projected, self.low, self.high)
        order = np.argsort(far, axis=1, kind="stable")
        norms = (vectors**2).sum(axis=1)
        live, verified = np.arange(n), 0
        for step in range(len(self.spans)):
            leaf = order[live, step]
            reach = np.minimum(best[live, -1], bound[live])
            go = far[live, leaf] <= quantile * reach
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            by = np.argsort(leaf, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(leaf[by])) + 1, len(leaf)]
            for x, y in zip(edges[:-1], edges[1:]):
                q = live[by[x:y]]
                a, b = self.spans[leaf[by[x]]]
                verified += len(q) * int(b - a)
                d = np.maximum(norms[q, None] + self.norms[None, a:b] - 2 * vectors[q] @ self.vectors[a:b].T, 0)
                d[ids[q, None] == self.ids[None, a:b]] = np.inf
                edge = np.minimum(best[q, -1], bound[q])
                if b - a > k:
                    edge = np.minimum(edge, np.partition(d, k - 1, axis=1)[:, k - 1])
                close = d <= edge[:, None]
                width = int(close.sum(axis=1).max())
                if not width:
                    continue
                pick = np.argsort(~close, axis=1, kind="stable")[:, :width]
                dd = np.where(np.take_along_axis(close, pick, axis=1), np.take_along_axis(d, pick, axis=1), np.inf)
                best[q], found[q] = _merge(best[q], found[q], dd, self.ids[a:b][pick])
        return best, found, verified


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that can be compared, ids once; entries stay floats where they are."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].try_cast("long").alias("id"), vectors[vector_col].cast(kind).alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


class Tree:
    """Splits of the coarse cells, and of those that are cut again; cells are numbered coarse << 32 | fine."""

    def __init__(self, cuts: list, below: dict[int, list]):
        self.cuts, self.below = cuts, below

    def cell(self, projected: np.ndarray) -> np.ndarray:
        coarse = kd_leaf(projected, self.cuts)
        out = coarse << 32
        for c in np.unique(coarse).tolist() if self.below else ():
            if c in self.below:
                own = coarse == c
                out[own] |= kd_leaf(projected[own], self.below[c])
        return out


def _tree(rows: DataFrame, total: int, width: int, way: np.ndarray, cell: int, sample: int) -> Tree:
    """Cells of about `cell` of the rows (id, v). No more than `sample` projections come together in one place."""
    power = lambda x: 1 << max(0, int(np.ceil(np.log2(max(1, x)))))
    cells = power(total / cell)
    if cells == 1:
        return Tree([], {})
    coarse = min(cells, max(2, power(sample / PER_CELL)))
    share = lambda x: F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, x) * (1 << 30))

    def project(batches):
        for b in batches:
            if b.num_rows:
                p = _matrix(b.column(0), width) @ way
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in p], pa.binary())], ["p"])

    some = map_arrow(rows.where(share(PER_CELL * coarse / total)).select("v"), project, "p binary").collect()
    cuts = kd_cuts(np.frombuffer(b"".join(r[0] for r in some), np.float64).reshape(-1, way.shape[1]), coarse)
    if coarse == cells:
        return Tree(cuts, {})
    first, finer = Tree(cuts, {}), min(cells // coarse, power(sample / PER_CELL))

    def place(batches):
        for b in batches:
            if b.num_rows:
                p = _matrix(b.column(0), width) @ way
                yield pa.RecordBatch.from_arrays([pa.array(first.cell(p) >> 32), pa.array([x.tobytes() for x in p], pa.binary())], ["c", "p"])

    def below(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = kd_cuts(np.frombuffer(b"".join(pdf["p"]), np.float64).reshape(-1, way.shape[1]), finer)
        return pd.DataFrame({"c": [key[0]], "dim": [[d for d, _ in cuts]], "at": [[float(x) for _, x in cuts]]})

    found = map_arrow(rows.where(share(PER_CELL * coarse * finer / total)).select("v"), place, "c long, p binary").groupBy("c").applyInPandas(below, "c long, dim array<int>, at array<double>").collect()
    return Tree(cuts, {r["c"]: list(zip(r["dim"], r["at"])) for r in found})


def _packed(rows: DataFrame, tree: Tree, width: int, way: np.ndarray, parts: int) -> DataFrame:
    """One row for each cell: its rows by leaf, and the leaves' boxes."""
    single = dict(rows.dtypes)["v"] == "array<float>"
    held = np.float32 if single else np.float64

    def place(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1), width)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tree.cell(m @ way)), pa.array([x.tobytes() for x in m.astype(held)], pa.binary())], ["id", "cell", "v"])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.frombuffer(b"".join(pdf["v"]), held).reshape(-1, width).astype(np.float64)
        c = Cell.of(pdf["id"].to_numpy(np.int64), m, m @ way)
        return pd.DataFrame({"cell": [key[0]], "ids": [c.ids.tobytes()], "v": [c.vectors.astype(held).tobytes()], "spans": [c.spans.tobytes()], "low": [c.low.tobytes()], "high": [c.high.tobytes()]})

    placed = map_arrow(rows, place, "id long, cell long, v binary").repartition(parts, "cell")
    return cut(placed.groupBy("cell").applyInPandas(pack, "cell long, ids binary, v binary, spans binary, low binary, high binary"))


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 12, p: float = 0.9, seed: int = 7, cell: int = CELL, sample: int = SAMPLE, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank): for each query its k nearest rows of other ids by Euclidean distance.

    queries: rows like those of vectors; all of these by default. Equal distances go by id. Rows with a null id or
    vector, a null or non-finite entry, or another length than most rows of vectors (the shortest of the most frequent)
    are left out of both; an id on several rows counts once, with the least vector. Of equal vectors, k + 1 rows of the
    least ids are indexed: no query can need more, and no hot vector fills a cell. Fewer than k others give fewer rows;
    empty tables give none. Columns of other names don't matter.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, neighbour_id long, distance double, rank int"
    rows = cut(_clean(vectors, id_col, vector_col))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths["n"]
    dims = min(dims, width)
    rows = rows.where(F.size("v") == width)
    asks = rows if queries is None else _clean(queries, id_col, vector_col).where(F.size("v") == width)
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = rows.withColumn("_copy", least).where(F.col("_copy") <= k + 1).select("id", "v")
    way = directions(width, dims, seed)
    total = lengths["count"]
    tree = _tree(rows, total, width, way, cell, sample)
    index = _packed(rows, tree, width, way, max(1, min(2000, -(-total // cell))))
    quantile = chi_square_quantile(p, dims)
    held = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    asks = cut(asks)
    count = asks.count()
    rounds = max(1, -(-count * width * 8 // query_bytes))
    answer = "q long, d array<double>, other array<long>"
    results = []

    def cells(batches) -> Iterator[tuple[int, Cell]]:
        for b in batches:
            for c, ids, v, spans, low, high in zip(*(x.to_pylist() for x in b.columns)):
                m = np.frombuffer(v, held).reshape(-1, width).astype(np.float64)
                boxes = (np.frombuffer(x, np.float64).reshape(-1, dims) for x in (low, high))
                yield c, Cell(np.frombuffer(ids, np.int64), m, np.frombuffer(spans, np.int64).reshape(-1, 2), *boxes)

    def rows_of(ids: np.ndarray, best: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        ok = np.isfinite(best)
        some = np.flatnonzero(ok.any(axis=1))
        offsets = pa.array(np.r_[0, np.cumsum(ok[some].sum(axis=1))], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[some][ok[some]])) for x in (best, found)]
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), *lists], ["q", "d", "other"])

    for r in range(rounds):
        block = asks if rounds == 1 else asks.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r)
        got = block.toArrow()
        if not got.num_rows:
            continue
        ids = got["id"].to_numpy()
        m = _matrix(got["v"].combine_chunks(), width)
        sent = spark.sparkContext.broadcast((ids, m.astype(held), tree.cell(m @ way)))

        def home(batches, sent=sent):
            ids, m, at = sent.value
            for c, own in cells(batches):
                q = np.flatnonzero(at == c)
                if len(q):
                    v = m[q].astype(np.float64)
                    yield rows_of(ids[q], *own.search(ids[q], v, v @ way, np.full(len(q), np.inf), k, quantile)[:2])

        near = cut(map_arrow(index, home, answer))
        reach = np.full(len(ids), np.inf)
        by = np.argsort(ids)
        bounds = near.where(F.size("d") == k).select("q", F.element_at("d", -1).alias("d")).toArrow()
        reach[by[np.searchsorted(ids[by], bounds["q"].to_numpy())]] = bounds["d"].to_numpy()
        bound = spark.sparkContext.broadcast(reach)

        def others(batches, sent=sent, bound=bound):
            ids, m, at = sent.value
            m = m.astype(np.float64)
            pr, reach = m @ way, bound.value.copy()
            best, found = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for c, own in cells(batches):
                box = box_distance(pr, own.low.min(axis=0)[None], own.high.max(axis=0)[None])[:, 0]
                q = np.flatnonzero((box <= quantile * reach) & (at != c))
                if len(q):
                    d, i, _ = own.search(ids[q], m[q], pr[q], reach[q], k, quantile)
                    best[q], found[q] = _merge(best[q], found[q], d, i)
                    reach[q] = np.minimum(reach[q], best[q, -1])
            yield rows_of(ids, best, found)

        results.append(near.union(map_arrow(index, others, answer)))
    if not results:
        return spark.createDataFrame([], schema)
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    pairs = every.select("q", F.explode(F.arrays_zip("d", "other")).alias("x"))
    ranked = pairs.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias("x"))
    return ranked.select(F.col("q").alias("vec_id"), F.posexplode("x").alias("i", "x")).select("vec_id", F.col("x.other").alias("neighbour_id"), F.sqrt("x.d").alias("distance"), (F.col("i") + 1).cast("int").alias("rank"))
