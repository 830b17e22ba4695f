from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rankloom.operators.fusion import fused
from rankloom.operators.writes import applied, resolved
from rankloom.plans import query as plans
from rankloom.plans.predicates import Scope, condition, truth
from rankloom.plans.spec import Fusion, Text, parse_filter, parse_order, parse_query, parse_rank, parse_top_k

ROWS = [("a", "pro", 1, True), ("b", "free", 2, False), ("c", None, None, None)]
SCHEMA = "id string, tier string, n int, ok boolean"


def ids(df, tree):
    scope = Scope(df.schema)
    a = {r[0] for r in df.where(condition(scope, parse_filter(tree))).collect()}
    flags = df.select("id", truth(scope, parse_filter(tree)).alias("t")).collect()
    assert all(r["t"] is not None for r in flags)
    assert a == {r["id"] for r in flags if r["t"]}
    return "".join(sorted(a))


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        (["tier", "Eq", "pro"], "a"),
        (["tier", "Eq", None], "c"),
        (["tier", "Ne", "pro"], "bc"),
        (["tier", "Ne", None], "ab"),
        (["tier", "Eq", 1], ""),
        (["tier", "Ne", 1], "abc"),
        (["n", "Gt", 1], "b"),
        (["n", "Lte", 1.5], "a"),
        (["n", "Gt", "1"], ""),
        (["ok", "Gt", False], "a"),
        (["ok", "Gte", 0], "ab"),
        (["tier", "Lt", "g"], "b"),
        (["tier", "In", ["pro", None]], "ac"),
        (["n", "In", [2, "x"]], "b"),
        (["Or", []], ""),
        (["And", []], "abc"),
        (["Or", [["tier", "Eq", "pro"], ["And", [["n", "Ne", 1], ["ok", "Eq", None]]]]], "ac"),
        (["nowhere", "Eq", None], "abc"),
        (["nowhere", "Ne", 4], "abc"),
        (["nowhere", "Gt", 4], ""),
        (["id", "Gte", "b"], "bc"),
    ],
)
def test_filters(spark, tree, want):
    assert ids(spark.createDataFrame(ROWS, SCHEMA), tree) == want


@pytest.mark.parametrize("bad", [[], "x", [1, "Eq", 2], ["a", "Like", 1], ["a", "In", []], ["a", "Eq"], ["And", 3], ["a", "Eq", [1]]])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        parse_filter(bad)


def test_bad_requests():
    for bad in ([], ["Min", 1], ["vector", "ANN", "v"], ["vector", "ANN", "v", ["x"]], ["BM25", "t"], ["Sum"]):
        with pytest.raises(ValueError):
            parse_rank(bad)
    for bad in (0, 1201, "3", True):
        with pytest.raises(ValueError):
            parse_top_k(bad)
    for bad in (["x"], ["x", "up"], "x"):
        with pytest.raises(ValueError):
            parse_order(bad)
    rank = {"rank_by": ["BM25", "t", "x"]}
    for bad in ({"include_attributes": 3}, {"include_vectors": []}, {"vector_encoding": "hex"}, {"consistency": "weak"}):
        with pytest.raises(ValueError):
            parse_query(rank | bad)
    with pytest.raises(ValueError):
        parse_query({})


def test_ties_fall_to_order_by_then_id(spark):
    df = spark.createDataFrame([("x", "same", 10), ("y", "same", 30), ("z", "same", 20), ("w", "same", None), ("v", "same", -5)], "id string, text string, seq int")
    run = lambda way: [r[0] for r in plans.compiled(df, parse_query({"rank_by": ["BM25", "text", "same"], "order_by": ["seq", way]})).collect()]
    assert run("desc") == ["y", "z", "x", "v", "w"] and run("asc") == ["w", "v", "x", "z", "y"]
    assert [r[0] for r in plans.compiled(df, parse_query({"rank_by": ["BM25", "text", "same"], "top_k": 2})).collect()] == ["v", "w"]


def test_projection(spark):
    df = spark.createDataFrame([("a", "t", [1.0, 0.0])], "id string, text string, v array<float>")
    names = lambda **x: plans.compiled(df, parse_query({"rank_by": ["vector", "ANN", "v", [1.0, 0.0]]} | x)).columns
    assert names() == ["id", "dist", "text"] and names(include_attributes=False) == ["id", "dist"]
    assert names(include_attributes=["v"]) == ["id", "dist", "v"] and names(include_vectors=True) == ["id", "dist", "text", "v"]
    assert names(include_attributes=["v"], include_vectors=False) == ["id", "dist"]
    with pytest.raises(ValueError, match="no vector field"):
        plans.compiled(df, parse_query({"rank_by": ["vector", "ANN", "text", [1.0]]}))


def test_fusion_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 4.0), ("b", 3.0, float("-inf")), ("c", 2.0, 8.0)], "id string, s double, t double")
    leaf = Text("x", "y")
    got = {r["id"]: r["dist"] for r in fused(df, Fusion("sum", (leaf, leaf)), ["s", "t"]).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 1.5}
    assert {r["id"]: r["dist"] for r in fused(df, Fusion("product", (leaf, leaf)), ["s", "t"]).collect()} == {"c": 0.5}
    flat = spark.createDataFrame([("a", 2.0, 0.0), ("b", 2.0, 0.0)], "id string, s double, t double")
    assert {r["dist"] for r in fused(flat, Fusion("sum", (leaf, leaf)), ["s", "t"]).collect()} == {1.0}


def test_conditional_writes(spark):
    now = spark.createDataFrame([("a", 5, "x"), ("b", None, "y")], "id string, at int, tag string")
    new = spark.createDataFrame([("a", 4, "x"), ("b", 1, "y"), ("c", 1, "z")], "id string, at int, tag string")
    names = lambda *a: "".join(sorted(r[0] for r in applied(*a).collect()))
    newer = ["at", "Lt", {"$ref_new": "at"}]
    assert names("upsert", now, new, newer) == "c" and names("patch", now, new, newer) == ""
    assert names("upsert", now, new, ["Or", [newer, ["at", "Eq", None]]]) == "bc"
    assert names("delete", now, new, ["tag", "Eq", "x"]) == "a"
    assert names("delete", now, new, ["at", "Eq", {"$ref_new": "at"}]) == ""
    absent = new.drop("at")
    assert names("patch", now, absent, ["at", "Eq", {"$ref_new": "at"}]) == "" and names("patch", now, absent, ["at", "Ne", {"$ref_new": "at"}]) == "b"
    with pytest.raises(ValueError, match="conditional"):
        condition(Scope(now.schema), parse_filter(newer))


def test_filter_writes_are_capped(spark):
    df = spark.createDataFrame([Row(id=str(i), tag="t") for i in range(4)])
    found, left = resolved(df, ["tag", "Eq", "t"], 2, True)
    assert [r[0] for r in found.collect()] == ["0", "1"] and left == 2
    with pytest.raises(ValueError, match="4 rows"):
        resolved(df, ["tag", "Eq", "t"], 2)


def test_pool_is_taken_before_the_filter(spark):
    rows = [(f"{i:03d}", [1.0, i / 100], i % 50 == 49) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, v array<double>, keep boolean")
    query = parse_query({"rank_by": ["vector", "ANN", "v", [1.0, 0.0]], "filters": ["keep", "Eq", True], "top_k": 4})
    assert plans.compiled(df, query, plans.Settings(candidates="all")).count() == 4
    assert plans.compiled(df, query, plans.Settings(candidates="pool")).count() == 1
