"""Neighbours, URL classes, shards, components and the pipeline against brute force."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import ann, sharding, url_filter
from rankloom.llm.common import cut, shared_dir, stable_fraction
from rankloom.llm.components import components


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- components ----


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1120)] + [(5, 5), (None, 3), (7, None), (1000, 1001)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = rows(components(spark.createDataFrame(edges, "src long, dst long")))
    assert got == sorted((x, find(x)) for x in root)
    assert rows(components(spark.createDataFrame([], "src string, dst string"))) == []


# ---- neighbours ----


def table(spark, m, extra=()):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + list(extra)
    return spark.createDataFrame([(*r, 1, "c") for r in data], "vec_id long, embedding array<double>, cell int, id string")


def brute(m, k):
    d = ((m[:, None] - m[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return [set(np.lexsort((np.arange(len(m)), r))[:k].tolist()) for r in np.round(d, 9)]


def test_neighbours_recall_over_many_cells(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    got = {}
    for r in ann.neighbours(table(spark, m), k=10, cell=400).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = (r["neighbour_id"], r["distance"])
    want = brute(m, 10)
    assert len(got) == 3000 and all(sorted(x) == list(range(1, 11)) for x in got.values())
    assert np.mean([len(want[i] & {n for n, _ in got[i].values()}) / 10 for i in got]) >= 0.9
    assert all(abs(d - np.linalg.norm(m[i] - m[n])) < 1e-6 for i in list(got)[:50] for n, d in got[i].values())


def test_queries_by_blocks_over_a_tree_of_two_levels(spark):
    """Recall of the registered form on the test table: every 50th row against all, in several blocks."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    m = np.array([r[0] for r in v.orderBy("vec_id").select("embedding").collect()], float)
    want = brute(m, 10)
    for more in ({}, {"cell": 100, "sample": 512, "query_bytes": 5000}):
        got = {}
        for r in ann.neighbours(v, v.where("vec_id % 50 = 0"), **more).collect():
            got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
        assert set(got) == set(range(0, len(m), 50)) and all(len(x) == 10 for x in got.values())
        assert np.mean([len(want[i] & x) / 10 for i, x in got.items()]) >= 0.9


def test_the_stopping_test_prunes_clustered_vectors():
    """Under a fifth of all pairs of a query and a row is verified, and nine tenths of the neighbours are found."""
    rng = np.random.default_rng(3)
    n, k, dims = 20_000, 10, 12
    m = 3 * rng.normal(size=(60, 32))[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, 32))
    way, quantile = ann.directions(32, dims, 7), ann.chi_square_quantile(0.9, dims)
    p = m @ way
    tree = ann.Tree(ann.kd_cuts(p[:2000], 16), {})
    at = tree.cell(p)
    q = np.arange(0, n, 50)
    best, found, verified = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64), 0
    for home in (True, False):
        for c in np.unique(at):
            own = ann.Cell.of(np.flatnonzero(at == c), m[at == c], p[at == c])
            some = np.flatnonzero((at[q] == c) == home)
            d, i, seen = own.search(q[some], m[q[some]], p[q[some]], best[some, -1], k, quantile)
            best[some], found[some] = ann._merge(best[some], found[some], d, i)
            verified += seen
    assert verified < 0.2 * len(q) * n
    d = ((m[q] ** 2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * m[q] @ m.T)
    d[np.arange(len(q)), q] = np.inf
    true = np.argsort(d, axis=1)[:, :k]
    assert np.mean([len(set(a) & set(b)) / k for a, b in zip(true, found)]) >= 0.9


def test_hot_vectors_and_queries_from_elsewhere(spark):
    m = np.zeros((3000, 4))
    m[2000:] = np.random.default_rng(0).normal(size=(1000, 4))
    asked = table(spark, [[0.0] * 4, [0.1] * 4], [(7000, [1.0]), (None, [0.0] * 4)])
    got = {}
    for r in ann.neighbours(table(spark, m), asked, k=3, cell=64).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour_id"]
    assert got[0] == {1: 1, 2: 2, 3: 3} and set(got) == {0, 1}
    strings = spark.createDataFrame([("1", [0.0, 1.0]), ("x", [0.0, 1.0]), ("2", [0.0, 2.0])], "vec_id string, embedding array<float>")
    assert [(r[0], r[1]) for r in rows(ann.neighbours(strings))] == [(1, 2), (2, 1)]


def test_projected_distance_is_chi_square():
    for dims, p, want in ((4, 0.95, 9.4877), (12, 0.9, 18.5493), (1, 0.5, 0.4549)):
        assert ann.chi_square_quantile(p, dims) == pytest.approx(want, abs=1e-3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 30))
    ratio = ((v @ ann.directions(30, 6, 3)) ** 2).sum(axis=1) / (v**2).sum(axis=1)
    assert abs((ratio <= ann.chi_square_quantile(0.9, 6)).mean() - 0.9) < 0.2


def test_neighbour_edges(spark):
    m = np.zeros((40, 3))
    m[30:] = [[1.0, 0, i] for i in range(10)]
    extra = [(100, None), (None, [1.0, 2.0, 3.0]), (101, [1.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, []), (5, [0.0, 0.0, 0.0]), (6, [9.0, 9.0, 9.0])]
    got = rows(ann.neighbours(table(spark, m, extra), k=3))
    assert {r[0] for r in got} == set(range(40))
    assert [r[1] for r in got if r[0] == 5] == [0, 1, 2] and [r[1] for r in got if r[0] == 0] == [1, 2, 3]
    assert [r[1] for r in sorted(got, key=lambda r: r[3]) if r[0] == 39] == [38, 37, 36]
    assert rows(ann.neighbours(table(spark, m[:2]), k=5)) == [(0, 1, 0.0, 1), (1, 0, 0.0, 1)]
    assert rows(ann.neighbours(table(spark, m[:0]))) == [] == rows(ann.neighbours(table(spark, m[:1])))


def test_kd_leaves_partition_the_points():
    p = np.random.default_rng(2).normal(size=(1000, 3))
    at = ann.kd_leaf(p, ann.kd_cuts(p, 8))
    assert sorted(np.bincount(at, minlength=8)) == [125] * 8
    assert (ann.kd_leaf(p, []) == 0).all()


# ---- URLs ----


def pages(spark, data):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in data], "page_id long, url string, html string, node string, root string, part string")


def test_alias_classes_and_precedence(spark):
    link = '<link rel="canonical" href="{}">'
    data = [
        (1, "http://www.bad.com/a/?utm_source=x#top", ""),
        (2, "https://m.bad.com/a.html", None),
        (3, "https://fine.org/copy", link.format("https://bad.com/a")),
        (4, "https://fine.org/refresh", '<meta http-equiv="refresh" content="0; url=https://fine.org/copy">'),
        (5, "https://fine.org/ok", "<p>bad.com</p>"),
        (6, "https://sub.bad.com/news", ""),
        (7, "https://notbad.com/", ""),
        (8, "https://fine.org/relative", "<LINK href='/copy/' REL='canonical'>"),
        (9, None, link.format("https://bad.com/a")),
        (10, "", "x"),
        (11, "https://fine.org/ok", "twice"),
        (None, "https://bad.com/b", "x" * 100_000),
    ]
    rules = lambda *r: spark.createDataFrame([(x,) for x in r], "rule string")
    got = {(r["page_id"]): r["decision"] for r in url_filter.decided(pages(spark, data), rules("bad.com", None), rules("https://fine.org/refresh", "sub.bad.com/news")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "none", 6: "allow", 7: "none", 8: "block", 9: "none", 10: "none", 11: "none", None: "block"}
    roots = {r["page_id"]: r["alias_root"] for r in url_filter.decided(pages(spark, data), rules("bad.com"), rules()).collect()}
    assert roots[1] == roots[2] == roots[3] == roots[4] == roots[8] != roots[5]
    assert url_filter.decided(pages(spark, []), rules("bad.com"), rules()).count() == 0
    assert url_filter.decided(pages(spark, data), rules(), rules()).where("decision <> 'none'").count() == 0


def test_sql_sees_the_same_tags(spark):
    import duckdb

    data = [
        (1, "http://www.bad.com/a/?utm_source=x#top", "", "x", "y", "z"),
        (2, "https://fine.org/copy", '<p><link data-x="1" rel="canonical" href="https://bad.com/a"></p>', "x", "y", "z"),
        (3, "https://fine.org/refresh", "<META http-equiv=refresh content='0; url=/copy'>", "x", "y", "z"),
        (4, "https://fine.org/ok", None, "x", "y", "z"),
        (5, None, "", "x", "y", "z"),
        (6, "https://sub.bad.com/b/c?z=1&a=2", "", "x", "y", "z"),
        (7, "https://fine.org/dir/page", '<link rel=canonical href="other.html">', "x", "y", "z"),
        (8, "https://fine.org/dir/other", "", "x", "y", "z"),
        (9, "https://fine.org/two", '<link rel="canonical" href="/one"><link rel="canonical" href="//bad.com/z">', "x", "y", "z"),
        (10, "https://fine.org/up/a/b?x=1", '<link href="../../dots/./c" rel="canonical"><link rel="canonical" href="mailto:x@bad.com">', "x", "y", "z"),
        (11, "https://fine.org/dots/c", "", "x", "y", "z"),
        (12, "https://fine.org/list?page=1", "", "x", "y", "z"),
        (13, "https://fine.org/list?page=2", '<link rel="canonical" href="?page=3&amp;utm_x=1#f">', "x", "y", "z"),
        (14, "https://fine.org/list?page=3&ref=q", "", "x", "y", "z"),
        (15, "https://fine.org", '<link rel="canonical" href="start">', "x", "y", "z"),
        (16, "https://fine.org/start/", "", "x", "y", "z"),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string, node string, root string, part string")
    rules = lambda *r: spark.createDataFrame([(x,) for x in r], "rule string")
    got = {tuple(r) for r in url_filter.decided(df, rules("bad.com"), rules("fine.org/copy", "sub.bad.com/b")).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    duck.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in data])
    assert got == set(duck.execute(url_filter.sql(("bad.com",), ("fine.org/copy", "sub.bad.com/b"))).fetchall())
    blocked, allowed = {1, 3, 9}, {2, 6}
    assert {r[0]: r[3] for r in got} == {i: "block" if i in blocked else "allow" if i in allowed else "none" for i in range(1, 17)}
    root = {r[0]: r[2] for r in got}
    assert root[7] == root[8] and root[10] == root[11] and root[15] == root[16] and len({root[12], root[13], root[14]}) == 3


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://User:pw@WWW.Example.com:443/A/index.html?b=2&a=1&utm_x=9#f", "example.com/A?a=1&b=2"),
        ("example.com", "example.com"),
        ("http://m.example.com./", "example.com"),
        ("/only/path", None),
        ("", None),
        (None, None),
    ],
)
def test_plain_form(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(url_filter.plain(F.col("u"))).first()[0] == want


# ---- shards ----


def naive(sizes, k):
    heap = [(-s, i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (-(c[0] - c[-1]), n, c))
        n += 1
    return heap[0][2]


def test_differencing():
    sizes = [8, 7, 6, 5, 4]
    parts = np.zeros((5, 2), np.int64)
    parts[:, 0] = sizes
    total, slots = sharding.difference(parts)
    assert total.tolist() == [16, 14]
    rng = np.random.default_rng(0)
    for k in (2, 3, 7):
        sizes = rng.integers(0, 1000, 200)
        parts = np.zeros((200, k), np.int64)
        parts[:, 0] = sizes
        total, slots = sharding.difference(parts)
        assert total.tolist() == naive(sizes.tolist(), k)
        assert np.bincount(slots[:, 0], sizes, minlength=k).tolist() == total.tolist()
        assert (np.sort(slots, axis=1) == np.arange(k)).all()


def test_shards_keep_groups_and_balance(make, prose):
    texts = [(i, prose(i, 5 + i * 7 % 90)) for i in range(300)] + [(500 + i, prose(1, 12)) for i in range(25)] + [(600, None), (601, ""), (None, "none"), (3, prose(3, 26)), (3, prose(3, 26))]
    for block, most in ((20_000, 30), (20, 400)):
        got = sharding.sharded(make(texts), ["text"], 4, block=block).collect()
        assert len(got) == len(texts) and all(0 <= r["shard"] < 4 for r in got)
        by_group = {}
        for r in got:
            by_group.setdefault(r["group_key"], set()).add(r["shard"])
        assert all(len(x) == 1 for x in by_group.values())
        size = {i: len((t or "").encode()) for i, t in texts}
        load = np.zeros(4)
        for r in got:
            load[r["shard"]] += size[r["doc_id"]]
        assert load.max() - load.min() <= most
    assert sharding.sharded(make([]), ["text"], 4).count() == 0
    assert sharding.sharded(make([(1, "a"), (2, None)]), ["lang"], 3).select("shard").distinct().count() == 1


def test_shards_level_heavy_groups_over_blocks(make, prose):
    texts = [(i, prose(i, 5 + i % 9)) for i in range(200)] + [(500 + i, prose(1000, 30)) for i in range(10)] + [(600 + i, prose(1001, 30)) for i in range(6)]
    load, where = np.zeros(4, np.int64), {}
    size = {i: len(t.encode()) for i, t in texts}
    for r in sharding.sharded(make(texts), ["text"], 4, block=25).collect():
        load[r["shard"]] += size[r["doc_id"]]
        where.setdefault(r["group_key"], set()).add(r["shard"])
    assert len(where) == 202 and all(len(x) == 1 for x in where.values())
    assert load.sum() == sum(size.values()) and load.max() - load.min() <= 20


# ---- shared folder ----


def test_shared_folder_and_samples(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert "ExistingRDD" in cut(spark.range(3))._jdf.queryExecution().toString()
    some = stable_fraction(spark.range(10_000), "id", 0.25)
    assert abs(some.count() - 2500) < 200 and stable_fraction(spark.range(7), "id", 1).count() == 7


# ---- pipeline ----


def test_stages_match_their_rules(spark, tmp_path, make, prose):
    from test_text_operators import brute_groups, brute_leaks

    bench = [(i, prose(800 + i, 25)) for i in range(4)]
    docs = [(i, prose(i, 80)) for i in range(60)] + [(100 + i, prose(i, 80)) for i in range(10)]
    docs += [(200, f"{prose(70, 30)} {bench[1][1]} {prose(71, 30)}"), (201, 'token = "3c4226790fc3f8022bcc4434e93601b2005f1325" ' + prose(72, 40)), (202, None), (None, prose(73, 60))]
    docs += [(300 + i, f"{prose(300 + i, 40)} scum moron") for i in range(40)]
    table = make(docs).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(i, 1, 1) for i in range(300, 330)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece"]
    now, seen = table, []
    for _, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, str(tmp_path)))
        seen.append(now)
    for df in seen[:-1]:
        assert df.columns == table.columns
    ids = [sorted((r["doc_id"] for r in df.collect()), key=str) for df in seen]
    assert not {202, *range(300, 340)} & set(ids[0]) and {*range(60), 200, 201, None} <= set(ids[0])
    first = {r["doc_id"]: r["text"] for r in seen[0].collect()}
    gone = {a for a, _ in brute_groups({k: v for k, v in first.items() if k is not None})}
    assert set(ids[1]) == set(ids[0]) - gone and set(range(100, 110)) <= gone
    leaks = {r[0] for r in brute_leaks([(k, v) for k, v in first.items()], bench)}
    assert set(ids[2]) == set(ids[1]) - leaks and 200 in leaks
    clean = {r["doc_id"]: r for r in seen[3].collect()}
    assert set(clean) == set(ids[2]) and "[SECRET]" in clean[201]["text"] and clean[201]["n_chars"] == len(clean[201]["text"])
    assert {r["doc_id"]: r["decoded"] for r in seen[4].collect()} == {k: v["text"] for k, v in clean.items()}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "ids", "decoded"] and sorted((r["doc_id"] for r in out.collect()), key=str) == ids[4]


def test_pipeline_of_odd_tables(spark, tmp_path, make, prose):
    """Repeated rows, very long and empty texts, null ids, columns that are called as the stages' own."""
    long = prose(400, 60_000)
    docs = [(i, prose(i, 80)) for i in range(40)] + [(3, prose(3, 80)), (3, prose(3, 80)), (50, long), (51, long + " end"), (52, ""), (None, prose(77, 50)), (53, prose(1, 80))]
    docs += [(300 + i, f"{prose(300 + i, 40)} scum") for i in range(30)]
    table = make(docs).withColumnsRenamed({"g": "_gone", "cell": "r", "fp": "i"})
    spark.createDataFrame([(1, prose(900, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 1, 1) for i in range(300, 330)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, ids = table, []
    for _, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, str(tmp_path)))
        ids.append(sorted((r["doc_id"] for r in now.select("doc_id").collect()), key=str))
        assert now.columns == table.columns or now.columns == ["doc_id", "ids", "decoded"]
    assert ids[0] == sorted([*range(40), 3, 3, 50, 51, None, 53], key=str)
    assert ids[1] == ids[4] == sorted([*range(40), 3, 3, 50, None], key=str)
    assert now.where("doc_id = 50").first()["decoded"] == long


def test_pipeline_of_nothing(spark, tmp_path, make):
    make([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
