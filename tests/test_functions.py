from __future__ import annotations

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text, vectors
from rankloom.functions.scalars import canonical_datetime, datetimes, uuids, valid_id, valid_namespace
from rankloom.functions.stem import stem
from rankloom.operators import bm25


def test_tokens_normalise_cut_and_lower(spark):
    rows = [("Ｆｕｌｌ ﬁne ²x the well-known İstanbul",), ("",), (None,), ("...",)]
    df = spark.createDataFrame(rows, "t string").select(text.tokens(F.col("t")).alias("x"))
    got = [r[0] for r in df.collect()]
    assert got[0][:3] == ["full", "fine", "2x"] and got[0][3:5] == ["well", "known"]
    assert got[1:] == [[], None, []]
    assert text.query_terms("Ｆｕｌｌ ﬁne ²x the well-known") == got[0][:5]


def test_stems_of_lists_stay_in_arrows_form(spark):
    import pyarrow as pa

    rows = [["running", "ties", "running"], None, [], ["cries"]] * 400
    found = text._stems.func(pa.array(rows, pa.list_(pa.string())).slice(1))
    assert isinstance(found, pa.Array) and found.to_pylist() == [None if r is None else [stem(w) for w in r] for r in rows[1:]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w array<string>")
    assert {r["i"]: r["s"] for r in df.select("i", text._stems("w").alias("s")).collect()} == {i: None if r is None else [stem(w) for w in r] for i, r in enumerate(rows)}
    docs = spark.createDataFrame([("a", "red red fish"), ("b", "blue bird"), ("c", "the of")], "id string, t string")
    tf, dl = bm25.asked_postings(docs, "id", F.col("t"), "red fish red")
    assert {tuple(r) for r in tf.collect()} == {("red", "a", 2), ("fish", "a", 1)} and {tuple(r) for r in dl.collect()} == {("a", 3), ("b", 2)}


def test_stems():
    known = {"consign": "consign", "consigned": "consign", "consistency": "consist", "knights": "knight", "kneeling": "kneel", "generous": "generous", "communication": "communic", "skies": "sky", "dying": "die", "running": "run", "hopping": "hop", "hoping": "hope", "relational": "relat", "conditional": "condit", "ties": "tie", "cries": "cri", "happily": "happili", "national": "nation", "knack": "knack", "by": "by"}
    assert {w: stem(w) for w in known} == known


def test_similarity_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r[0]: (r[1], r[2]) for r in df.select("id", vectors.cosine(F.col("v"), [2.0, 0.0]), vectors.negated_l2(F.col("v"), [3.0, 4.0])).collect()}
    assert got[1][0] == 1.0 and got[1][1] == -20.0
    assert got[2] == (0.0, -25.0) and got[3] == (0.0, float("-inf")) and got[4] == (None, None) and got[5] == (0.0, float("-inf"))
    with pytest.raises(ValueError):
        vectors.similarity(F.col("v"), [1.0], "manhattan")


def test_vector_codecs(spark):
    assert vectors.decode(vectors.encode([1.5, -2.0])) == [1.5, -2.0]
    assert vectors.decode(vectors.encode([1.5, -2.0], 16), 16) == [1.5, -2.0]
    for bad in ("", "AAAA", "!!!!"):
        with pytest.raises(ValueError):
            vectors.decode(bad)
    long = [float(i) for i in range(100)]
    df = spark.createDataFrame([(long,)], "v array<float>").select(vectors.encoded(F.col("v")).alias("e")).select("e", vectors.decoded(F.col("e")).alias("d"))
    row = df.first()
    assert row["e"] == base64.b64encode(np.array(long, "<f4").tobytes()).decode() and row["d"] == long


def test_datetimes_and_uuids(spark):
    assert canonical_datetime("2024-02-29T23:30:00.1234567891-01:00") == "2024-03-01T00:30:00.123456789Z"
    for bad in ("2024-02-30T00:00:00Z", "yesterday", "2024-01-01T00:00:00"):
        with pytest.raises(ValueError):
            canonical_datetime(bad)
    df = spark.createDataFrame([("A987FBC94BED3078CF079141BA07C9F3", "2024-01-01T00:00:00Z")], "u string, t string")
    assert tuple(df.select(uuids(F.col("u")), datetimes(F.col("t"))).first()) == ("a987fbc9-4bed-3078-cf07-9141ba07c9f3", "2024-01-01T00:00:00.000000000Z")
    with pytest.raises(Exception, match="invalid uuid"):
        spark.createDataFrame([("nope",)], "u string").select(uuids(F.col("u"))).collect()


def test_names():
    assert valid_id("a b") and valid_namespace("a.b-c_1")
    for bad in ("", "a/b", "x" * 256, "a\\b", 3):
        with pytest.raises(ValueError):
            valid_id(bad)
    for bad in ("", "a b", "x" * 129):
        with pytest.raises(ValueError):
            valid_namespace(bad)


def test_bm25_of_one_document():
    assert bm25.idf(1, 1) == pytest.approx(0.287682, abs=1e-6)
