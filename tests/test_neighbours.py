from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import ivf, knn, measures


def frame(spark, m, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>")


def test_batch_matches_brute_force(spark):
    m = np.random.default_rng(1).normal(size=(60, 5))
    m[7] = m[3]
    df = frame(spark, m)
    for metric in ("cosine_distance", "euclidean_squared"):
        got = knn.batch(df, df.select(F.col("id").alias("q"), F.col("v").alias("qv")), 4, "id", "v", "q", "qv", metric, 9)
        s = np.round(ivf.pairwise(m, m, metric), 9) + 0.0
        want = {(q, int(i), k + 1) for q in range(60) for k, i in enumerate(np.lexsort((np.arange(60), -s[q]))[:4])}
        assert {(r["q"], r["id"], r["rank"]) for r in got.collect()} == want


def test_batch_holds_few_scores_at_once(spark, monkeypatch):
    from rankloom import catalog

    monkeypatch.setattr(knn, "SCORE_BYTES", 8 * 16 * 7)
    monkeypatch.setattr(knn, "VECTORS", 16)
    test_batch_matches_brute_force(spark)
    asked = {r[0] for r in catalog.v5(spark, "/root/testdata/sf0.01").select("query_id").collect()}
    assert asked == set(range(0, 500, 50))


def test_few_cells_are_exact_and_deltas_apply(spark):
    m = np.random.default_rng(2).normal(size=(120, 8))
    df = frame(spark, m)
    index = ivf.built(df, "id", "v", layout=3)
    assert len(index.fine) > 32
    every = ivf.searched(index, m[0], 5, "id", "v", len(index.coarse), len(index.fine))
    assert [r[0] for r in every.collect()][0] == 0
    small = ivf.built(df.where("id < 20"), "id", "v")
    assert len(small.fine) <= 32
    assert [r[0] for r in ivf.searched(small, m[0], 5, "id", "v").collect()] == [r[0] for r in knn.exact(df.where("id < 20"), m[0], 5, "id", "v").collect()]
    moved = ivf.maintained(small, df.where("id between 15 and 24"), df.where("id = 3"), "id", "v")
    assert {r[0] for r in moved.members.select("id").collect()} == set(range(25)) - {3}


def test_recall_on_waves(spark):
    df = measures.synthetic(spark, 1000, 32).select("id", "embedding")
    assert ivf.recall(ivf.built(df, "id", "embedding"), df, "id", "embedding", "waves", 10, 5)["avg_recall"] >= 0.75


def test_all_cells_are_read_when_asked_for(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for rows in (v.where("label = 0"), v):
        index = ivf.fitted(rows, "vec_id", "embedding", layout=3)
        assert len(index.fine) > ivf.PROBE_ALL
        assert index.probes(index.fine[0], len(index.coarse), len(index.fine)) == list(range(len(index.fine)))
        assert len(index.probes(index.fine[0], len(index.coarse), 1)) < len(index.fine)


def test_registered_searches_keep_recall(spark, monkeypatch):
    from rankloom import catalog

    sf = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = v.orderBy("vec_id").collect()
    m, at = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    asked, used = list(range(0, len(m), 10)), {}
    real = ivf.searched
    monkeypatch.setattr(ivf, "searched", lambda index, *a, **kw: used.update(index=index, **kw) or real(index, *a, **kw))
    truth = np.argsort(-ivf.pairwise(m[asked], m, "cosine_distance"), axis=1, kind="stable")
    for query, k in ((catalog.v11, ivf.pool_size(10)), (catalog.v12, 10)):
        assert query(spark, sf).count() == k
        index, cells = used["index"], used.get("cells")
        cell = index.assign(m)
        found = [np.isin(cell[truth[i, :k]], index.probes(m[q]) if cells is None else index.ranked(m[q])[:cells]).mean() for i, q in enumerate(asked)]
        assert np.mean(found) >= 0.9
        assert cells < len(index.fine)
        got = {r["vec_id"] for r in real(index, m[5], k, "vec_id", "embedding", cells=cells).collect()}
        inside = np.isin(cell[truth[0]], index.ranked(m[0])[:cells])
        assert {r["vec_id"] for r in query(spark, sf).collect()} == set(at[truth[0][inside][:k]].tolist()) and len(got) == k


def test_probes_prune_partitions(spark, tmp_path):
    df = frame(spark, np.random.default_rng(3).normal(size=(400, 6)))
    index = ivf.built(df, "id", "v", path=str(tmp_path / "members"))
    plan = ivf.searched(index, [1.0] * 6, 3, "id", "v")._jdf.queryExecution().toString()
    assert "PartitionFilters: [fine_id" in plan or "PartitionFilters: [isnotnull(fine_id" in plan


def test_kmeans_and_sizes():
    points = np.array([[0.0], [0.1], [5.0], [5.1]])
    assert sorted(ivf.kmeans(points, 2, "euclidean_squared").ravel().tolist()) == pytest.approx([0.05, 5.05])
    assert ivf.kmeans(points, 9, "euclidean_squared").shape == (4, 1)
    assert len(ivf.seeds(np.zeros((5, 2)), 3)) == 3
    assert ivf.sizes(32) == 1 and ivf.sizes(100) == 4 and ivf.sizes(10**6) == 16 and ivf.sizes(10**6, 3) == 256
    c, f = ivf.clamp(16, 8)
    assert c + c * f + 4 <= 64
    assert ivf.needs_rebuild(256, 1, 1) and not ivf.needs_rebuild(3, 100, 4)
    assert ivf.built is not None and len(ivf.recall_sample(5, 9, "x")) == 5


def test_empty(spark):
    assert ivf.built(spark.createDataFrame([], "id long, v array<double>"), "id", "v") is None


def test_sizes_of_json(spark):
    df = spark.createDataFrame([("a", "é", 5, None)], "id string, t string, n int, m string")
    assert df.select(measures.document_bytes(df)).first()[0] == 1 + 4 + 1
    assert measures.returned_bytes(df).first()[0] == 1 + 1 + 4 + 1 + 1
    assert measures.overlap(df, df, 2).first()["overlap"] == 0.5
