import pytest
from pyspark.sql import functions as F

from loomspark.operators import graph, oplog, ratings, search

EDGES = [("0", "2"), ("1", "2"), ("1", "0"), ("1", "4"), ("2", "1"), ("3", "1"), ("3", "1")]


def brute(edges, iterations, d):
    edges = set(edges)
    ids = sorted({x for e in edges for x in e})
    out = {i: sum(a == i for a, _ in edges) for i in ids}
    r = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(iterations):
        m = sum(r[i] for i in ids if not out[i])
        r = {i: (1 - d) / len(ids) + d * (sum(r[a] / out[a] for a, b in edges if b == i) + m / len(ids)) for i in ids}
    return r


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = {r.id: r.rank for r in graph.pagerank(edges, 10).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert got == pytest.approx(brute(EDGES, 10, 0.85))
    assert [r.id for r in graph.dangling(edges).collect()] == ["4"]
    assert {r.id: r.outdegree for r in graph.out_degrees(edges).collect()} == {"0": 1, "1": 3, "2": 1, "3": 1}
    assert {r.id: r.neighbours for r in graph.adjacency(edges).collect()}["1"] == ["0", "2", "4"]


def test_additive_pagerank(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    got = {r.id: r.rank for r in graph.pagerank(edges, 1, formula="additive").collect()}
    assert got == pytest.approx({"a": 1.0, "b": 1.0})


def test_empty_graph(spark):
    assert graph.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_mean_squared_error(spark):
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0), (2, 1, 5.0)], "user int, product int, rating double")
    b = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 7.0)], "user int, product int, rating double")
    assert ratings.mean_squared_error(a, b).first().mse == pytest.approx(5 / 3)


def test_search(spark):
    rows = [("#a", "x", 5, 2), ("#a", "y", 5, 1), ("#a", "x", 3, 3), ("#a", "y", 9, 7), ("#a", "z", 1, 99), ("#b", "x", 2, 50)]
    postings = spark.createDataFrame(rows, "hashtag string, keyword string, uid bigint, freq bigint")
    assert [tuple(r) for r in search.top_users(postings, "#a", 3, ["x", "y"]).collect()] == [(9, 7), (3, 3), (5, 3)]
    assert search.as_posting(search.top_users(postings, "#a", 3, ["x", "y"])).first().posting == "9:7,3:3,5:3"
    parsed = spark.createDataFrame([("9:7,3:3",)], "p string").select(search.parse_posting(F.col("p")).alias("x")).first().x
    assert [tuple(x) for x in parsed] == [(9, 7), (3, 3)]
    for bad in (("", 3, ["x"]), ("#a", 0, ["x"]), ("#a", 3, [])):
        with pytest.raises(ValueError):
            search.top_users(postings, *bad)


def test_replay(spark):
    rows = [
        ("set", "t1", "f", "v2", 5), ("write", "t1", None, "w", 1), ("set", "t1", "f", "v1", 3), ("delete", "t2", None, None, 4), ("set", "t2", "f", "old", 2),
        ("set", "t2", "g", "new", 6), ("write", "t3", None, "x", 7), ("delete", "t3", None, None, 8),
    ]
    ops = spark.createDataFrame(rows, "op string, tid1 string, field string, payload string, seq int")
    got = {(r.tid, r.field): r.payload for r in oplog.replay(ops).collect()}
    assert got == {("t1", ""): "w", ("t1", "f"): "v2", ("t2", "g"): "new"}
    assert [r.seq for r in oplog.ordered(ops).collect()] == sorted(r[4] for r in rows)
