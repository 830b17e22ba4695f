from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25
from rankloom.sources import log as logs
from rankloom.sources.namespace import Catalog, expanded, export_page
from rankloom.sources.shared import spread
from rankloom.streaming.indexing import TableIndex, follow

ROWS = [
    (1, 2, 0, "patch", "early", {"a": "1"}),
    (1, 1, 0, "upsert", "x", {"a": "1", "b": '"s"'}),
    (1, 1, 1, "upsert", "x", {"a": "2", "b": '"t"'}),
    (1, 2, 1, "patch", "x", {"b": "null", "c": "3"}),
    (2, 1, 0, "upsert", "y", {"a": "1"}),
    (2, 0, 0, "delete", "y", None),
    (2, 1, 1, "upsert", "empty", {}),
    (3, 0, 0, "delete", "y", None),
    (3, 2, 0, "patch", "y", {"a": "9"}),
    (4, 1, 0, "upsert", "x", {"a": "7"}),
    (4, 0, 0, "delete", "ghost", None),
]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(ROWS, logs.LOG_SCHEMA)


def state(df):
    return {r["id"]: (r["attrs"], r["_last_seq"]) for r in df.collect()}


def test_fold(log):
    assert state(logs.folded(log, 1)) == {"x": ({"a": "2", "b": "null", "c": "3"}, 1)}
    assert state(logs.folded(log, 2)) == {"x": ({"a": "2", "b": "null", "c": "3"}, 1), "y": ({"a": "1"}, 2), "empty": ({}, 2)}
    assert state(logs.folded(log)) == {"x": ({"a": "7"}, 4), "empty": ({}, 2)}
    assert state(logs.folded(log.where("seq > 9"))) == {}


def test_snapshot_and_replay_agree(log):
    for at in (1, 2, 3):
        again = logs.replayed(logs.folded(log, at).select("id", "attrs"), at, log, 4)
        assert {k: v[0] for k, v in state(again).items()} == {k: v[0] for k, v in state(logs.folded(log)).items()}


def test_reads_and_lag(log):
    assert {r[0] for r in logs.touched(log, 2).collect()} == {"x", "y", "ghost"}
    assert set(state(logs.eventual(logs.folded(log), 3))) == {"empty"}
    assert logs.compaction_plan(12, 12, 0) == (12, 9) and logs.compaction_plan(12, 11, 0) is None and logs.compaction_plan(10, 10, 0) is None
    assert logs.indexing_order({"a": 1, "b": 5, "c": 0, "d": 90}) == [("d", 8), ("b", 2), ("a", 1)]


def test_checksums(log):
    sums = logs.signed(log)
    assert logs.verified(log, sums).count() == len(ROWS)
    wrong = sums.withColumn("crc32", F.when(F.col("seq") == 2, 0).otherwise(F.col("crc32")))
    assert {r[0] for r in logs.verified(log, wrong, "skip").select("seq").distinct().collect()} == {1, 3, 4}
    with pytest.raises(Exception, match="corrupt log batch 2"):
        logs.verified(log, wrong).collect()


def test_small_inputs_are_spread(spark):
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=9)
    assert spread(few).rdd.getNumPartitions() == 4 and spread(many).rdd.getNumPartitions() == 9
    joined = few.join(many, "id")
    assert spread(joined) is joined and spread(few).count() == 100


def test_postings_delta(spark):
    docs = spark.createDataFrame([("a", "red red fish"), ("b", "blue fish"), ("c", "the of")], "id string, t string")
    old = bm25.postings(docs, "id", F.col("t"))
    assert old[1].count() == 2
    new = bm25.postings(spark.createDataFrame([("a", "green")], "id string, t string"), "id", F.col("t"))
    tf, dl = bm25.updated(old, spark.createDataFrame([("a",)], "id string"), new)
    assert {tuple(r) for r in tf.collect()} == {("green", "a", 1), ("blue", "b", 1), ("fish", "b", 1)}
    assert {tuple(r) for r in dl.collect()} == {("a", 1), ("b", 2)}


def test_columns_must_be_even(spark):
    assert expanded(spark.createDataFrame([(["a", "b"], [1, 2])], "id array<string>, n array<int>")).count() == 2
    with pytest.raises(Exception, match="as long as the ids"):
        expanded(spark.createDataFrame([(["a", "b"], [1])], "id array<string>, n array<int>")).collect()


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "ns"), list_ttl=0)


def got(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_three_documents(catalog):
    ns = catalog.namespace("smoke")
    with pytest.raises(KeyError):
        ns.query({"rank_by": ["BM25", "text", "x"]})
    out = ns.write(
        {
            "schema": {"embedding": "[3]f32", "text": {"type": "string", "full_text_search": True}, "tier": "string"},
            "distance_metric": "cosine_distance",
            "upsert_rows": [
                {"id": "1", "embedding": [1, 0, 0], "text": "red fish", "tier": "pro"},
                {"id": "2", "embedding": [0, 1, 0], "text": "blue fish", "tier": "free"},
                {"id": "3", "embedding": [0.9, 0.1, 0], "text": "green bird", "tier": "pro"},
            ],
        }
    )
    assert out["rows_affected"] == 3
    near = {"rank_by": ["vector", "ANN", "embedding", [1, 0, 0]], "top_k": 2}
    assert [x[0] for x in got(ns.query(near), "id")] == ["1", "3"]
    assert [x[0] for x in got(ns.query(near | {"filters": ["tier", "Eq", "free"]}), "id")] == ["2"]
    assert {x[0] for x in got(ns.query({"rank_by": ["BM25", "text", "fish"]}), "id")} == {"1", "2"}
    assert got(ns.query({"rank_by": ["Sum", ["BM25", "text", "fish"], near["rank_by"]]}), "id")[0] == ("1",)
    assert ns.statistics({"rank_by": ["BM25", "text", "fish"]})["candidates"] == 2
    assert "TakeOrderedAndProject" in ns.explain(near)
    assert ns.recall("embedding", 3, 2)["avg_recall"] == 1.0
    with pytest.raises(ValueError, match="metric"):
        ns.write({"distance_metric": "euclidean_squared", "upsert_rows": []})
    with pytest.raises(ValueError, match="entries"):
        ns.write({"upsert_rows": [{"id": "4", "embedding": [1]}]})
    with pytest.raises(ValueError, match="patched"):
        ns.write({"patch_rows": [{"id": "1", "embedding": [1, 0, 0]}]})


def test_writes_conditions_copies_export(catalog):
    ns = catalog.namespace("docs")
    schema = {"at": "datetime", "owner": "uuid", "n": "int"}
    ns.write({"schema": schema, "upsert_columns": {"id": ["a", "b", "c"], "at": ["2024-01-02T00:00:00Z"] * 3, "n": [1, 2, 3], "owner": ["A987FBC94BED3078CF079141BA07C9F3"] * 3}})
    assert got(ns.view().orderBy("id"), "id", "at", "n")[0] == ("a", "2024-01-02T00:00:00.000000000Z", 1)
    newer = ["at", "Lt", {"$ref_new": "at"}]
    out = ns.write({"upsert_rows": [{"id": "a", "at": "2024-01-01T00:00:00Z", "n": 9}, {"id": "b", "at": "2024-01-03T00:00:00Z", "n": 9}, {"id": "d", "at": "2023-01-01T00:00:00Z", "n": 4}], "upsert_condition": newer})
    assert out["rows_upserted"] == 2
    assert got(ns.view().orderBy("id"), "id", "n") == [("a", 1), ("b", 9), ("c", 3), ("d", 4)]
    ns.write({"patch_by_filter": {"filters": ["n", "Gte", 4], "patch": {"tag": "big", "n": None}}, "patch_rows": [{"id": "d", "tag": "own"}]})
    assert got(ns.view().orderBy("id"), "id", "n", "tag") == [("a", 1, None), ("b", None, "big"), ("c", 3, None), ("d", None, "own")]
    catalog.copy("docs", "twin")
    out = ns.write({"delete_by_filter": ["tag", "Ne", None], "deletes": ["ghost"]})
    assert out["rows_deleted"] == 3 and ns.documents().count() == 2
    assert catalog.namespace("twin").documents().count() == 4 and catalog.list() == ["docs", "twin"]
    with pytest.raises(ValueError, match="not empty"):
        catalog.copy("docs", "twin")
    page, after = catalog.namespace("twin").export(None, 3)
    assert [x[0] for x in got(page, "id")] == ["a", "b", "c"] and after == "c"
    assert export_page(catalog.namespace("twin").view().drop("_last_seq"), "c", 3)[1] is None
    catalog.drop("twin")
    assert catalog.list() == ["docs"]
    with pytest.raises(KeyError):
        catalog.drop("twin")
    for bad in ({"upsert_columns": {"id": ["a"], "n": [1, 2]}}, {"upsert_rows": [{"id": "a/b"}]}, {"upsert_rows": [{"id": "a", "at": "soon"}]}, {"upsert_rows": [{"id": "q", "owner": "1"}]}):
        with pytest.raises(ValueError):
            ns.write(bad)


def test_mixed_kinds_and_inference(catalog):
    ns = catalog.namespace("free")
    ns.write({"upsert_rows": [{"id": "1", "x": 1, "y": True, "z": "s"}, {"id": "2", "x": "1", "y": False}, {"id": "3", "z": None, "w": [0.5, 1]}]})
    view = ns.view()
    kinds = dict(view.dtypes)
    assert kinds["x"] == "string" and kinds["y"] == "boolean" and kinds["z"] == "string" and kinds["w"] == "array<float>"
    assert got(view.orderBy("id"), "x", "z") == [("1", "s"), ('"1"', None), (None, None)]


def test_stream_index_compaction_and_consistency(catalog, tmp_path):
    ns = catalog.namespace("stream")
    for i in range(11):
        ns.write({"upsert_rows": [{"id": f"d{i}", "text": f"word{i} same"}], "deletes": ["d0"] if i == 5 else []})
    assert ns.metadata()["status"] == "catching_up" and ns.view("eventual").count() == 0 and not ns.compact()
    index = TableIndex(ns, str(tmp_path / "fts"), lambda docs: docs.select("id", F.element_at("attrs", F.lit("text")).alias("text")))
    query = follow(ns, str(tmp_path / "ck"), index.apply, files_per_trigger=4)
    query.awaitTermination()
    assert query.exception() is None
    assert {r[0] for r in index.table().select("id").collect()} == {f"d{i}" for i in range(1, 11)}
    assert ns.metadata()["status"] == "up_to_date" and ns.view("eventual").count() == 10
    ns.write({"patch_rows": [{"id": "d1", "text": "changed"}]})
    assert {r[0] for r in ns.view("eventual").select("id").collect()} == {f"d{i}" for i in range(2, 11)}
    follow(ns, str(tmp_path / "ck"), index.apply).awaitTermination()
    assert index.table().where("id = 'd1'").first()["text"] == '"changed"'
    before = state(ns.documents())
    assert ns.compact() and {k: v[0] for k, v in state(ns.documents()).items()} == {k: v[0] for k, v in before.items()}
    assert ns.files.names("stream", "log") == ["seq=10", "seq=11", "seq=12"]
    ns.warm()
    assert ns.view().count() == 10


def test_many_batches_share_folders(spark, catalog, tmp_path):
    rows = [(s, 1, 0, "upsert", f"d{s % 50}", {"n": str(s)}) for s in range(1, 201)]
    want = {k: v[0] for k, v in state(logs.folded(spark.createDataFrame(rows, logs.LOG_SCHEMA))).items()}
    ns = catalog.namespace("long")
    assert ns.append_batches(spark.createDataFrame(rows, logs.LOG_SCHEMA)) == 200
    assert len(ns.folders()) <= logs.FOLDERS and len(ns.folders("sums")) <= logs.FOLDERS and ns.folders()[-1] == 200
    assert {r[0] for r in ns.log(90).select("seq").collect()} == set(range(91, 201)) and ns.log(corrupt="fail").count() == 200
    index, seen = TableIndex(ns, str(tmp_path / "t"), lambda docs: docs.select("id", "attrs")), []

    def apply(delta, upto):
        seen.append((delta.agg(F.min("seq")).first()[0], upto))
        index.apply(delta, upto)

    follow(ns, str(tmp_path / "ck"), apply, files_per_trigger=len(ns.folders()) // 2).awaitTermination()
    assert len(seen) > 1 and seen[0][0] == 1 and [u for _, u in seen] == sorted(u for _, u in seen) and seen[-1][1] == 200
    assert {r["id"]: r["attrs"] for r in index.table().collect()} == want
    catalog.copy("long", "twin")
    assert ns.metadata()["unindexed_bytes"] == 0 and ns.compact() and len(ns.folders()) == 1
    for name in ("long", "twin"):
        assert {k: v[0] for k, v in state(catalog.namespace(name).documents()).items()} == want
