"""Queries through the index against scans, commits by several writers, checks of the log."""

from __future__ import annotations

import random
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from rankloom.operators import ivf
from rankloom.sources import index as indexes
from rankloom.sources.namespace import Catalog

WORDS = "red green blue fish bird stone river cloud north south".split()
LEAF_T, LEAF_V = ["BM25", "text", "red fish red"], ["vector", "ANN", "v", [0.3, -1.0, 0.5]]
REQUESTS = [
    {"rank_by": LEAF_T},
    {"rank_by": LEAF_V, "include_vectors": True},
    {"rank_by": LEAF_T, "filters": ["tier", "Eq", "pro"], "order_by": ["n", "desc"]},
    {"rank_by": LEAF_V, "filters": ["Or", [["n", "Gt", 50], ["tier", "Ne", "free"]]], "top_k": 7},
    {"rank_by": ["Sum", LEAF_T, LEAF_V], "top_k": 40},
    {"rank_by": ["Product", LEAF_T, LEAF_V], "order_by": ["n", "asc"], "include_attributes": ["n", "tier"]},
    {"rank_by": ["Sum", LEAF_T, ["Product", LEAF_T, LEAF_V]], "filters": ["n", "Lt", 90]},
    {"rank_by": ["BM25", "text", "absent the"]},
]


def rows(seed: int, ids) -> list[dict]:
    rng = random.Random(seed)
    out = []
    for i in ids:
        row = {"id": f"d{i:04d}", "text": " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), "tier": rng.choice(["pro", "free"]), "n": rng.randint(0, 99)}
        if rng.random() < 0.8:
            row["v"] = [round(rng.uniform(-1, 1), 3) for _ in range(3)]
        out.append(row)
    return out


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "ns"), list_ttl=0)


def same(ns, requests=REQUESTS, levels=("strong",), **how):
    for r in requests:
        for level in levels:
            ask = r | {"consistency": level}
            a, b = ns.query(ask, **how), ns.query(ask, scan=True, **how)
            assert sorted(a.columns) == sorted(b.columns), r
            x, y = ([tuple(tuple(v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in (row[c] for c in sorted(a.columns))) for row in d.collect()] for d in (a, b))
            assert x == y, (r, level)


def test_index_and_scan_agree(catalog, monkeypatch):
    ns = catalog.namespace("docs")
    schema = {"text": {"type": "string", "full_text_search": True}, "v": "[3]f32", "tier": "string", "n": "int"}
    ns.write({"schema": schema, "upsert_rows": rows(1, range(150))})
    index = ns.build_index()
    assert index.manifest["totals"]["text"][0] > 100 and ns.metadata()["status"] == "up_to_date"
    same(ns, REQUESTS[3:5])
    # what came since: written again, patched, deleted, new; with an attribute that the index has never seen
    ns.write({"upsert_rows": [*rows(2, range(140, 160)), {"id": "x", "text": "red fish", "odd": 3}], "patch_rows": [{"id": "d0003", "text": "red red red"}, {"id": "d0004", "n": 1}], "deletes": ["d0005", "d0006"]})
    same(ns)
    same(ns, [REQUESTS[2], REQUESTS[4]], ["eventual"])
    assert ns.view().where("odd = 3").count() == 1
    ns.advance_index()
    assert len(ns.index().manifest["segments"]) == 2
    same(ns, [REQUESTS[0], REQUESTS[4]], df="corpus")
    monkeypatch.setattr(indexes, "MOST_SEGMENTS", 3)
    for i in range(3):
        ns.write({"upsert_rows": rows(10 + i, range(i * 9, i * 9 + 4)), "deletes": [f"d{100 + i:04d}"]})
        ns.advance_index()
    merged = ns.index()
    assert len(merged.manifest["segments"]) == 2 and merged.manifest["seq"] == 5
    same(ns, REQUESTS[1:5:3])
    live = ns.documents()
    assert merged.manifest["totals"]["text"][0] == ns.query({"rank_by": ["BM25", "text", " ".join(WORDS)], "top_k": 1200}, scan=True).count()
    assert merged.documents().count() == live.count() == ns.view().count()
    catalog.copy("docs", "twin")
    ns.write({"deletes": [f"d{i:04d}" for i in range(100)]})
    twin = catalog.namespace("twin")
    assert twin.index().manifest["seq"] == 5 and twin.documents().count() == live.count()
    same(twin, REQUESTS[:2])
    assert ns.vacuum() > 0 and ns.query(REQUESTS[0]).count() > 0


def test_an_empty_namespace_and_one_without_texts(catalog):
    ns = catalog.namespace("bare")
    ns.write({"upsert_rows": [{"id": "a", "n": 1}]})
    ns.build_index()
    assert ns.view().count() == 1
    ns.write({"upsert_rows": [{"id": "b", "text": "red fish", "v": [1.0, 0.0]}]})
    ns.advance_index()
    assert [r["id"] for r in ns.query({"rank_by": LEAF_T}).collect()] == ["b"] == [r["id"] for r in ns.query({"rank_by": ["vector", "ANN", "v", [1, 0]]}).collect()]
    ns.write({"deletes": ["a", "b"]})
    ns.advance_index()
    assert ns.view().count() == 0 == ns.query({"rank_by": LEAF_T}).count()


def test_only_probed_cells_and_asked_buckets_are_read(spark, catalog):
    ns = catalog.namespace("many")
    m = np.random.default_rng(0).normal(size=(8, 4))[np.arange(900) % 8] + 0.1 * np.random.default_rng(1).normal(size=(900, 4))
    docs = spark.createDataFrame([("upsert", f"d{i}", {"v": str([float(x) for x in v]), "text": f'"w{i % 50} common"'}, i) for i, v in enumerate(m)], "op string, id string, attrs map<string,string>, pos long")
    ns.append(docs)
    index = ns.build_index()
    cells = index.measured("v")
    assert len(index.centres("v").fine) > ivf.PROBE_ALL and 0 < cells < len(index.centres("v").fine)
    ask = {"rank_by": ["vector", "ANN", "v", m[5].tolist()], "top_k": 10}
    near, true = ns.query(ask), ns.query(ask, scan=True)
    assert "fine_id" in near._jdf.queryExecution().toString() and "PartitionFilters: [fine_id" in near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    hits = []
    for i in range(0, 900, 60):
        ask = {"rank_by": ["vector", "ANN", "v", m[i].tolist()], "top_k": 10}
        hits.append(len({r[0] for r in ns.query(ask).select("id").collect()} & {r[0] for r in ns.query(ask, scan=True).select("id").collect()}) / 10)
    assert np.mean(hits) >= 0.9
    assert {r[0] for r in ns.query(ask, cells=0).select("id").collect()} == {r[0] for r in ns.query(ask, scan=True).select("id").collect()}
    assert true.count() == 10
    plan = ns.explain({"rank_by": ["BM25", "text", "w7"]})
    assert "PartitionFilters: [isnotnull(field" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w7)" in plan.replace("In(term, [w7])", "EqualTo(term,w7)")


def test_an_index_folds_the_log_once_and_cuts_texts_once(spark, catalog, monkeypatch):
    written, read = [], []
    write, infer = DataFrameWriter.parquet, indexes.schemas.inferred
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (written.append(plan(self._df)), write(self, *a, **k))[1])
    monkeypatch.setattr(indexes.schemas, "inferred", lambda docs, schema: (read.append(plan(docs)), infer(docs, schema))[1])
    for name, schema in (("declared", {"text": {"type": "string", "full_text_search": True}, "v": "[3]f32", "tier": "string", "n": "int"}), ("found", {})):
        ns = catalog.namespace(name)
        ns.write({"schema": schema, "upsert_rows": rows(5, range(60))})
        written.clear(), read.clear()
        index = ns.build_index()
        assert sum(p.count("windowspecdefinition") for p in written + read) == 1
        assert sum(p.count("regexp_extract_all") for p in written) == len(index.manifest["text"])
        assert len(ns.files.names(name, "index")) == 2  # a segment and the manifest


def test_runs_of_documents_hold_each_term_once(monkeypatch):
    lists = [["a", "b", "a"], None, [], ["b"] * 5, ["c"], ["a", "c"], [], ["é", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(8)]), pa.array(lists, pa.list_(pa.string()))], ["id", "terms"]).slice(0)
    for most in (1, 3, 4, 100):
        monkeypatch.setattr(indexes, "RUN_TERMS", most)
        for piece in ([batch], [batch.slice(0, 3), batch.slice(3)]):
            out = [r for b in indexes.counted(iter(piece)) for r in b.to_pylist()]
            found = sorted((r["term"] or "", h["id"], h["tf"], h["dl"]) for r in out for h in r["hits"])
            true = [(t, f"d{i}", x.count(t), len(x)) for i, x in enumerate(lists) if x for t in set(x)]
            assert found == sorted(true + [("", f"d{i}", 0, len(x)) for i, x in enumerate(lists) if x])
            assert all(0 <= r["part"] < indexes.SALT for r in out)
    assert len(out) == 3 + 3 + 2  # terms of two batches' runs, and their lengths
    assert list(indexes.counted(iter([batch.slice(1, 2)]))) == []


def test_cells_are_split_and_given_up(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.normal(size=(700, 3)), rng.normal(size=(40, 3)) + 30, [[90.0, 0, 0]]]
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)], "id long, v array<double>")
    old = ivf.Index(np.array([[0.0, 0, 0], [30.0, 30, 30]]), np.array([[0.0, 0, 0], [80.0, 0, 0], [30.0, 30, 30]]), np.array([0, 0, 1]), "euclidean_squared")
    new = ivf.maintained_cells(old, ivf.assigned(old, table, "id", "v"), "id", "v", split=200)
    at = {}
    for r in ivf.assigned(new, table, "id", "v").collect():
        at.setdefault(r["fine_id"], []).append(r["id"])
    assert len(at) == 5 and max(map(len, at.values())) < 500 and sorted(i for x in at.values() for i in x) == list(range(741))
    assert not (new.fine == [80.0, 0, 0]).all(axis=1).any()


def test_two_writers_lose_nothing(spark, catalog):
    ns = catalog.namespace("shared")
    ns.write({"upsert_rows": [{"id": "first", "n": 0}]})
    failed = []

    def writer(k):
        try:
            own = Catalog(spark, catalog.files.root, 0).namespace("shared")
            for i in range(3):
                own.write({"upsert_rows": [{"id": f"w{k}-{i}", "n": i}]})
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert ns.meta()["commit_seq"] == 13 and ns.log().select("seq").distinct().count() == 13
    assert {r[0] for r in ns.documents().select("id").collect()} == {"first", *(f"w{k}-{i}" for k in range(4) for i in range(3))}


def test_a_lost_writer_leaves_its_commit_whole(catalog, monkeypatch):
    ns = catalog.namespace("lost")
    ns.write({"upsert_rows": [{"id": "a", "n": 1}]})
    with monkeypatch.context() as m:
        m.setattr(type(ns), "settled", lambda self: self.meta())
        ns.write({"upsert_rows": [{"id": "b", "n": 2}]})
    assert {r[0] for r in ns.documents().select("id").collect()} == {"a", "b"}
    with monkeypatch.context() as m:
        m.setattr(type(ns.files), "create", lambda *_: (_ for _ in ()).throw(OSError("down")))
        with pytest.raises(OSError):
            ns.write({"schema": {"n": "string"}, "upsert_rows": [{"id": "c", "n": "3"}]})
    assert ns.documents().count() == 2 and "n" not in ns.meta()["schema"]


def test_conditions_see_what_another_writer_did(catalog, monkeypatch):
    ns = catalog.namespace("race")
    ns.write({"upsert_rows": [{"id": "a", "n": 1}]})
    real, done = type(ns)._commit, []

    def late(self, rows, **how):
        if not done:
            done.append(1)
            self.write({"upsert_rows": [{"id": "a", "n": 9}]})
        return real(self, rows, **how)

    monkeypatch.setattr(type(ns), "_commit", late)
    out = ns.write({"upsert_rows": [{"id": "a", "n": 5}], "upsert_condition": ["n", "Lt", {"$ref_new": "n"}]})
    assert out["rows_upserted"] == 0 and ns.view().first()["n"] == 9


def test_affected_ids_blocking_and_dimensions(catalog):
    ns = catalog.namespace("more")
    out = ns.write({"upsert_rows": [{"id": "a", "v": [1.0, 0.0]}, {"id": "b", "v": [0.0, 1.0]}], "deletes": ["z"], "patch_rows": [{"id": "a", "n": 1}], "return_affected_ids": True})
    assert out["upserted_ids"] == ["a", "b"] and out["deleted_ids"] == ["z"] and out["rows_patched"] == 1
    with pytest.raises(ValueError, match="2 dimensions"):
        ns.query({"rank_by": ["vector", "ANN", "v", [1.0]]})
    ns.build_index()
    with pytest.raises(ValueError, match="2 dimensions"):
        ns.query({"rank_by": ["Sum", ["vector", "ANN", "v", [1.0, 2.0, 3.0]]]})
    ns.write({"upsert_rows": [{"id": "c", "v": [1.0, 1.0]}], "block_until_indexed": True})
    assert ns.meta()["index_cursor"] == ns.meta()["commit_seq"] == ns.index().manifest["seq"] == 2
    bare = catalog.namespace("bare2")
    bare.write({"upsert_rows": [{"id": "a", "n": 1}]})
    with pytest.raises(TimeoutError):
        bare.wait_until_indexed(timeout=0.1)


def test_checksums_are_kept_and_looked_at(spark, catalog):
    ns = catalog.namespace("sums")
    for i in range(3):
        ns.write({"upsert_rows": [{"id": f"d{i}", "n": i}]})
    assert ns.log(corrupt="fail").count() == 3
    spark.createDataFrame([(2, 12345)], "seq long, crc32 long").write.mode("overwrite").partitionBy("seq").parquet(ns._path("wrong"))
    ns.files.delete("sums", "sums", "seq=2")
    ns.files.move(("sums", "wrong", "seq=2"), ("sums", "sums", "seq=2"))
    assert {r[0] for r in ns.log(corrupt="skip").select("seq").distinct().collect()} == {1, 3}
    careful = Catalog(spark, catalog.files.root, 0, corrupt="fail").namespace("sums")
    with pytest.raises(Exception, match="corrupt log batch 2"):
        careful.documents().collect()
    assert Catalog(spark, catalog.files.root, 0, corrupt="skip").namespace("sums").documents().count() == 2


def test_attributes_with_names_of_our_own(catalog):
    ns = catalog.namespace("names")
    ns.write({"upsert_rows": [{"id": f"d{i}", "text": "red fish" if i % 2 else "red", "dist": i, "dist_km": 10 * i, "_raw_0": i, "_pin": i, "a:id": i, "attr_dist": -i, "v": [1.0, float(i)]} for i in range(4)]})
    for rank in (LEAF_T, ["vector", "ANN", "v", [1.0, 0.0]], ["Sum", LEAF_T, ["vector", "ANN", "v", [1.0, 0.0]]]):
        for _ in range(2):
            got = ns.query({"rank_by": rank, "order_by": ["dist", "desc"], "filters": ["dist_km", "Gte", 10]}).collect()
            assert {r["id"] for r in got} == {"d1", "d2", "d3"}
            assert all(r["attr_attr_dist"] == r["dist_km"] / 10 == r["_raw_0"] == r["a:id"] == -r["attr_dist"] and isinstance(r["dist"], float) for r in got)
            ns.build_index()
