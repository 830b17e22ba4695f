"""Exact nearest neighbours: one query as a top-k plan, many queries block by block with partial top-k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, similarity

#: Bytes of query vectors that every task may hold; more are cut into rounds. Bytes of scores held at once, and vectors
#: that are multiplied together.
QUERY_BYTES, SCORE_BYTES, VECTORS = 64 << 20, 32 << 20, 10_000


def exact(vectors: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str, metric: str = METRICS[0], digits: int | None = None) -> DataFrame:
    """(id, dist) of the k best by score, then id."""
    score = similarity(F.col(vector_col), query, metric)
    scored = vectors.select(id_col, (F.round(score, digits) if digits is not None else score).alias("dist")).where("dist is not null")
    return scored.orderBy(F.desc("dist"), id_col).limit(k)


def batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_id: str, query_vector: str, metric: str = METRICS[0], digits: int | None = None) -> DataFrame:
    """(query_id, id, dist, rank) of each query's k best. Tasks multiply blocks of vectors with all queries of a round
    and pass on k rows a query; the merge sees k times the number of blocks. Vectors of another length score 0 or -inf."""
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric: {metric}")
    spark = vectors.sparkSession
    size = queries.agg(F.sum(8 * F.size(query_vector))).first()[0] or 0
    rounds = max(1, -(-size // QUERY_BYTES))
    kinds = dict(vectors.dtypes)[id_col], dict(queries.dtypes)[query_id]
    parts = []
    for r in range(rounds):
        some = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(rounds)) == r)
        rows = some.select(query_id, F.col(query_vector).cast("array<double>")).where(F.col(query_vector).isNotNull()).collect()
        if not rows:
            continue
        # by width: names and one matrix
        asked = {}
        for name, v in rows:
            asked.setdefault(len(v), ([], []))[0].append(name)
            asked[len(v)][1].append(np.array(v, float))
        del rows
        sent = spark.sparkContext.broadcast([(w, names, np.stack(m)) for w, (names, m) in asked.items()])
        del asked

        def block(batches, sent=sent):
            held, n = [], 0
            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                held.append(pdf)
                n += len(pdf)
                if n >= VECTORS:
                    yield from best_of(pd.concat(held), sent.value)
                    held, n = [], 0
            if n:
                yield from best_of(pd.concat(held), sent.value)

        def best_of(pdf, asked):
            lengths = pdf["v"].map(len).to_numpy()
            order = np.argsort(pdf["i"].to_numpy(), kind="stable")  # by id, so that ties go to the least
            ids, lengths, vs = pdf["i"].to_numpy()[order], lengths[order], pdf["v"].to_numpy()[order]
            for width, names, every in asked:
                fit = np.flatnonzero(lengths == width)
                m = np.stack(vs[fit]).astype(float) if len(fit) else None
                step = max(1, SCORE_BYTES // (8 * len(ids)))
                for at in range(0, len(names), step):
                    q = every[at : at + step]
                    s = np.full((len(q), len(ids)), 0.0 if metric == METRICS[0] else -np.inf)
                    if m is not None:
                        if metric == METRICS[0]:
                            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None]
                            s[:, fit] = np.divide(q @ m.T, norms, out=np.zeros_like(norms), where=norms > 0)
                        else:
                            s[:, fit] = -np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * q @ m.T, 0)
                    if digits is not None:
                        s = np.round(s, digits) + 0.0
                    picked = []
                    for row in s:
                        near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                        picked.append(near[np.argsort(-row[near], kind="stable")][:k])
                    lens = [len(p) for p in picked]
                    flat = np.concatenate(picked)
                    who = np.repeat(np.arange(len(q)), lens)
                    yield pd.DataFrame({"q": np.array(names[at : at + step])[who], "i": ids[flat], "dist": s[who, flat]})

        parts.append(vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).mapInPandas(block, f"q {kinds[1]}, i {kinds[0]}, dist double"))
    if not parts:
        return spark.createDataFrame([], f"{query_id} {kinds[1]}, {id_col} {kinds[0]}, dist double, rank int")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = every.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "i"))), 1, k).alias("x"))
    flat = best.select(F.col("q").alias(query_id), F.posexplode("x").alias("p", "x"))
    return flat.select(query_id, F.col("x.i").alias(id_col), (-F.col("x.d") + 0.0).alias("dist"), (F.col("p") + 1).cast("int").alias("rank"))
