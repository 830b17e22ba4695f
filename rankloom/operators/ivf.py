"""Cluster-probed nearest neighbours: a two-level k-means hierarchy, members partitioned by fine cell, probes as pruning.

Centroids are fitted on a bounded sample (model fitting, `FIT_ROWS`); all rows are then assigned in one pass. Up to 32
fine cells every query probes all of them, which makes the result exact. The surveyed system's probe of 4 x 2 cells is
the default and loses recall as cells grow; `cells_for` measures how many cells keep a given recall.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, dot, similarity
from ..sources.shared import shared_dir

ROUNDS = 10
FIT_ROWS = 100_000
PROBE_ALL = 32
#: What approximate searches keep, and the queries it is measured with.
RECALL, RECALL_QUERIES = 0.9, 200
COARSE, FINE, MOST_OBJECTS = 4, 2, 64
MASK = (1 << 64) - 1


def pairwise(points: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """Scores, higher is nearer."""
    if metric == METRICS[1]:
        return -((points**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * points @ centres.T)
    norms = np.linalg.norm(points, axis=1)[:, None] * np.linalg.norm(centres, axis=1)[None]
    return np.divide(points @ centres.T, norms, out=np.zeros_like(norms), where=norms > 0)


class Xorshift:
    def __init__(self, seed: int):
        self.state = seed & MASK or 1

    def unit(self) -> float:
        x = self.state
        x ^= (x << 13) & MASK
        x ^= x >> 7
        x ^= (x << 17) & MASK
        self.state = x
        return x / 2**64


def seeds(points: np.ndarray, k: int) -> np.ndarray:
    """k-means++ with a generator seeded from n and k; the first centre is the first point."""
    n, rng = len(points), Xorshift(len(points) * 0x9E3779B97F4A7C15 ^ k)
    chosen = [0]
    d = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = float(d.sum())
        i = len(chosen) % n if total <= 1e-12 else min(n - 1, int(np.searchsorted(np.cumsum(d), rng.unit() * total, side="right")))
        chosen.append(i)
        d = np.minimum(d, ((points - points[i]) ** 2).sum(1))
    return points[chosen].copy()


def kmeans(points: np.ndarray, k: int, metric: str, rounds: int = ROUNDS) -> np.ndarray:
    """Centres after Lloyd's steps: ties go to the lowest centre, empty centres stay, k >= n gives the points."""
    if k >= len(points):
        return points.copy()
    centres = seeds(points, k)
    for _ in range(rounds):
        at = pairwise(points, centres, metric).argmax(axis=1)
        size = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def sizes(n: int, layout: int = 2) -> int:
    """Coarse cells for n vectors."""
    if layout == 2:
        return 1 if n <= 32 else min(16, max(1, max(4, ceil(sqrt(n)) // 4)))
    return 1 if n <= 32 else min(256, max(8, n // 500))


def fine_size(cell: int, layout: int = 2) -> int:
    return max(1, min(256 if layout == 2 else 8, ceil(sqrt(cell))))


def clamp(coarse: int, fine: int, most: int = MOST_OBJECTS) -> tuple[int, int]:
    """The largest probe within the cap on objects read."""
    while coarse + coarse * fine + 4 > most and (coarse > 1 or fine > 1):
        if fine > 1 and fine >= coarse:
            fine -= 1
        elif coarse > 1:
            coarse -= 1
        else:
            fine -= 1
    return coarse, fine


@dataclass(frozen=True)
class Index:
    """Centres of the coarse cells, and for each fine cell its centre and coarse cell; members are a table by fine_id."""

    coarse: np.ndarray
    fine: np.ndarray
    parent: np.ndarray
    metric: str
    members: DataFrame | None = None
    path: str | None = None

    def probes(self, query: Sequence[float], coarse: int = COARSE, fine: int = FINE, most: int = MOST_OBJECTS) -> list[int]:
        """Fine cells that a query reads: the best of the best coarse cells, ties to the lowest, or all of a few or when all are asked for."""
        if len(self.fine) <= PROBE_ALL or (coarse >= len(self.coarse) and fine >= np.bincount(self.parent).max()):
            return list(range(len(self.fine)))
        coarse, fine = clamp(coarse, fine, most)
        q = np.array([query], float)
        out = []
        for c in np.argsort(-pairwise(q, self.coarse, self.metric)[0], kind="stable")[:coarse]:
            own = np.flatnonzero(self.parent == c)
            out += own[np.argsort(-pairwise(q, self.fine[own], self.metric)[0], kind="stable")[:fine]].tolist()
        return sorted(out)

    def ranked(self, query: Sequence[float]) -> np.ndarray:
        """All fine cells, those of the nearest centres first, ties to the lowest."""
        return np.argsort(-pairwise(np.array([query], float), self.fine, self.metric)[0], kind="stable")

    def assign(self, points: np.ndarray) -> np.ndarray:
        near = pairwise(points, self.coarse, self.metric).argmax(axis=1)
        out = np.empty(len(points), np.int64)
        for c in np.unique(near):
            own = np.flatnonzero(self.parent == c)
            at = near == c
            out[at] = own[pairwise(points[at], self.fine[own], self.metric).argmax(axis=1)]
        return out


def fitted(vectors: DataFrame, id_col: str, vector_col: str, metric: str = METRICS[0], layout: int = 2, fit_rows: int = FIT_ROWS) -> Index | None:
    """Both levels of centres; points in order of id, so that no partitioning leaks in."""
    n = vectors.where(F.col(vector_col).isNotNull()).count()
    if not n:
        return None
    some = vectors.where(F.col(vector_col).isNotNull())
    if n > fit_rows:
        some = some.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    points = np.array([r[0] for r in some.select(F.col(vector_col).cast("array<double>").alias("v"), id_col).orderBy(id_col).collect()], float)
    coarse = kmeans(points, sizes(n, layout), metric)
    at = pairwise(points, coarse, metric).argmax(axis=1)
    fine, parent = [], []
    for c in range(len(coarse)):
        own = points[at == c]
        centres = kmeans(own, fine_size(ceil(len(own) * n / len(points)), layout), metric) if len(own) else coarse[c : c + 1]
        fine.append(centres)
        parent += [c] * len(centres)
    return Index(coarse, np.concatenate(fine), np.array(parent), metric)


def assigned(index: Index, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, fine_id) of all rows with a vector of the right length, in one pass."""
    sent = vectors.sparkSession.sparkContext.broadcast(index_arrays(index))
    width, kind = index.coarse.shape[1], dict(vectors.dtypes)[id_col]

    def run(batches):
        own = Index(*sent.value)
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(fine_id=own.assign(np.stack(pdf[vector_col].to_numpy()).astype(float)))

    rows = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col)).where(F.size(vector_col) == width)
    return rows.mapInPandas(run, f"`{id_col}` {kind}, `{vector_col}` array<double>, fine_id long")


def index_arrays(index: Index) -> tuple:
    return index.coarse, index.fine, index.parent, index.metric


def built(vectors: DataFrame, id_col: str, vector_col: str, metric: str = METRICS[0], layout: int = 2, path: str | None = None) -> Index | None:
    """The whole index; with a path, members are written there by fine cell so that probes prune partitions."""
    index = fitted(vectors, id_col, vector_col, metric, layout)
    if index is None:
        return None
    members = assigned(index, vectors, id_col, vector_col)
    if path:
        members.repartition(F.col("fine_id")).write.mode("overwrite").partitionBy("fine_id").parquet(path)
        members = vectors.sparkSession.read.parquet(path)
    return Index(*index_arrays(index), members, path)


def pool_size(top_k: int) -> int:
    return max(8 * top_k, 64)


def searched(index: Index, query: Sequence[float], k: int, id_col: str, vector_col: str, coarse: int = COARSE, fine: int = FINE, rerank: DataFrame | None = None, digits: int | None = None, cells: int | None = None) -> DataFrame:
    """(id, dist) of the k best members of the probed cells; with rerank, live rows score them and decide who exists.

    With cells, so many fine cells nearest to the query are probed, whatever their coarse cells are.
    """
    probed = index.probes(query, coarse, fine) if cells is None else sorted(index.ranked(query)[:cells].tolist())
    found = index.members.where(F.col("fine_id").isin(probed))
    if rerank is not None:
        found = rerank.join(found.select(id_col), id_col, "left_semi")
    score = similarity(F.col(vector_col), query, index.metric)
    scored = found.select(id_col, (F.round(score, digits) if digits is not None else score).alias("dist"))
    return scored.orderBy(F.desc("dist"), id_col).limit(k)


def cells_for(index: Index, vectors: DataFrame, id_col: str, vector_col: str, k: int = 10, least: float = RECALL, num: int = RECALL_QUERIES) -> int:
    """The fewest cells whose probe finds `least` of the k nearest others of sampled rows, two standard errors aside.

    All rows are searched once for the sample's true neighbours; of each, the place of its cell in the query's order counts.
    """
    from .knn import batch

    rows = vectors.where(F.size(vector_col) == index.coarse.shape[1]).select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col))
    asked = rows.orderBy(F.xxhash64(id_col), id_col).limit(num).select(F.col(id_col).alias("_q"), F.col(vector_col).alias("_v")).collect()
    sent = vectors.sparkSession.createDataFrame(asked, f"_q {dict(rows.dtypes)[id_col]}, _v array<double>")
    near = batch(rows, sent, k + 1, id_col, vector_col, "_q", "_v", index.metric).where(F.col("_q") != F.col(id_col)).select("_q", id_col)
    hits = index.members.select(id_col, "fine_id").join(F.broadcast(near), id_col).select("_q", "fine_id").collect()
    if not hits:
        return len(index.fine)
    place = {}
    for q, v in asked:
        place[q] = np.empty(len(index.fine), np.int64)
        place[q][index.ranked(v)] = np.arange(len(index.fine))
    found: dict = {}
    for q, cell in hits:
        found.setdefault(q, []).append(place[q][cell])
    for cells in range(1, len(index.fine)):
        part = np.array([np.mean(np.array(x) < cells) for x in found.values()])
        if part.mean() - 2 * part.std() / sqrt(len(part)) >= least:
            return cells
    return len(index.fine)


def maintained(index: Index, upserts: DataFrame, deletes: DataFrame, id_col: str, vector_col: str) -> Index:
    """Members after a delta: old copies of all touched ids go, new vectors join their nearest cells."""
    gone = deletes.select(id_col).union(upserts.select(id_col)).distinct()
    kept = index.members.join(gone, id_col, "left_anti").select(id_col, vector_col, F.col("fine_id").cast("long").alias("fine_id"))
    return Index(*index_arrays(index), kept.unionByName(assigned(index, upserts, id_col, vector_col)))


#: Members beyond which a cell is split, up to which one is given up, cells below a coarse one at most, and the sample of
#: a cell that its split is fitted on.
SPLIT, TINY, MOST_FINE, SPLIT_ROWS = 512, 2, 256, 8_192
REBUILD_PASSES = 256


def maintained_cells(index: Index, members: DataFrame, id_col: str, vector_col: str, split: int = SPLIT) -> Index:
    """Centres after a look at the members (id, vector, fine_id): overfull cells are split by k-means into parts below the
    same coarse cell, those of hardly any members given up. Members are to be assigned anew.
    """
    sizes = {r[0]: r[1] for r in members.groupBy("fine_id").count().collect()}
    below = np.bincount(index.parent, minlength=len(index.coarse)).tolist()
    parts = {}
    for cell, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        more = min(ceil(n / split), MOST_FINE - below[index.parent[cell]] + 1)
        if n > split and more > 1:
            parts[cell] = more
            below[index.parent[cell]] += more - 1
    keep = np.ones(len(index.fine), bool)
    for cell in range(len(index.fine)):
        if sizes.get(cell, 0) <= TINY and below[index.parent[cell]] > 1 and cell not in parts:
            keep[cell] = False
            below[index.parent[cell]] -= 1
    fine, parent = [index.fine[keep]], [index.parent[keep]]
    if parts:
        metric = index.metric
        share = members.sparkSession.createDataFrame([(c, k, min(1.0, SPLIT_ROWS / sizes[c])) for c, k in parts.items()], "fine_id long, _k int, _share double")
        some = members.join(F.broadcast(share), "fine_id").where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.col("_share") * (1 << 30))

        def cut(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(id_col)
            centres = kmeans(np.stack(pdf[vector_col].to_numpy()).astype(float), int(pdf["_k"].iloc[0]), metric)
            return pd.DataFrame({"fine_id": int(pdf["fine_id"].iloc[0]), "v": list(centres)})

        found = some.groupBy("fine_id").applyInPandas(cut, "fine_id long, v array<double>").collect()
        if found:
            for r in found:
                keep[r[0]] = False
            fine = [index.fine[keep], np.array([r[1] for r in found])]
            parent = [index.parent[keep], index.parent[[r[0] for r in found]]]
    return Index(index.coarse, np.concatenate(fine), np.concatenate(parent), index.metric)


def needs_rebuild(passes: int, n: int, cells: int, split: int = SPLIT) -> bool:
    """After so many passes, or once cells hold more than `split` members on average."""
    return passes >= REBUILD_PASSES or (cells > 0 and n > split * cells)


def recall_sample(n: int, num: int, name: str) -> list[int]:
    """Distinct places below n from a linear congruential generator seeded with the name's FNV-1a hash."""
    state = 0xCBF29CE484222325
    for b in name.encode():
        state = (state ^ b) * 0x100000001B3 & MASK
    out: dict[int, None] = {}
    while len(out) < min(n, num):
        state = (state * 6364136223846793005 + 1442695040888963407) & MASK
        out.setdefault(state % n)
    return list(out)


def at_places(rows: DataFrame, id_col: str, places: list[int]) -> DataFrame:
    """The rows at some places of the order by id; ids are ranged and counted by partition, not brought together."""
    shared_dir(rows.sparkSession)
    ids = rows.select(id_col).repartitionByRange(id_col).sortWithinPartitions(id_col).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = {r[0]: r[1] for r in ids.groupBy("_part").count().collect()}
    starts, before = {}, 0
    for part in sorted(counts):
        starts[part] = before
        before += counts[part]
    want = [(p, i - s + 1) for i in places for p, s in starts.items() if s <= i < s + counts[p]]
    asked = rows.sparkSession.createDataFrame(want, "_part int, _at int")
    numbered = ids.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(id_col)))
    return rows.join(F.broadcast(numbered.join(F.broadcast(asked), ["_part", "_at"], "left_semi").select(id_col)), id_col, "left_semi")


def between(a: Column, b: Column, metric: str) -> Column:
    """Similarity of two columns of equally long vectors."""
    if metric == METRICS[1]:
        return -F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) + 0.0
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def recall(index: Index, vectors: DataFrame, id_col: str, vector_col: str, name: str, num: int = 25, k: int = 10, coarse: int = COARSE, fine: int = FINE) -> dict[str, float]:
    """Mean recall of probing against brute force over the given rows, which may be a filtered part of the indexed ones."""
    from .knn import batch

    rows = vectors.where(F.size(vector_col) == index.coarse.shape[1]).select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col))
    n = rows.count()
    picked = recall_sample(n, num, name)
    if not picked:
        return {"avg_recall": 0.0, "avg_ann_count": 0.0, "avg_exhaustive_count": 0.0}
    asked = at_places(rows, id_col, picked)
    spark: SparkSession = vectors.sparkSession
    queries = {r[0]: r[1] for r in asked.collect()}
    brute = batch(rows, asked.select(F.col(id_col).alias("_q"), F.col(vector_col).alias("_v")), k, id_col, vector_col, "_q", "_v", index.metric)
    truth: dict = {}
    for r in brute.select("_q", id_col).collect():
        truth.setdefault(r[0], set()).add(r[1])
    plan = spark.createDataFrame([(q, v, f) for q, v in queries.items() for f in index.probes(v, coarse, fine)], f"_q {dict(rows.dtypes)[id_col]}, _v array<double>, fine_id long")
    pool = pool_size(k)
    hit = index.members.join(F.broadcast(plan), "fine_id").withColumn("_s", between(F.col(vector_col), F.col("_v"), index.metric))
    hit = hit.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_s"), id_col))).where(F.col("_r") <= pool)
    hit = hit.join(rows.select(id_col), id_col, "left_semi")
    hit = hit.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_s"), id_col))).where(F.col("_r") <= k)
    ann: dict = {}
    for r in hit.select("_q", id_col).collect():
        ann.setdefault(r[0], set()).add(r[1])
    m = len(queries)
    return {
        "avg_recall": sum(len(truth[q] & ann.get(q, set())) / max(1, min(k, len(truth[q]))) for q in queries) / m,
        "avg_ann_count": sum(len(ann.get(q, ())) for q in queries) / m,
        "avg_exhaustive_count": sum(len(truth[q]) for q in queries) / m,
    }
