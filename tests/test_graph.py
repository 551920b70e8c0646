"""Graph operators on the FIXTURES shapes against brute force."""

import itertools
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as G

SHAPES = {
    "edgeless": (["a", "b"], []),
    "path4": (["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "d")]),
    "star5": (["h", "a", "b", "c", "d"], [("h", x) for x in "abcd"]),
    "two_components": (["a", "b", "c", "x", "y"], [("a", "b"), ("b", "c"), ("x", "y")]),
    "self_loop_parallel": (["a", "b", "c"], [("a", "a"), ("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")]),
}


def bfs_all(nodes, edges):
    adj = {n: set() for n in nodes}
    for u, v in edges:
        if u != v:
            adj[u].add(v)
            adj[v].add(u)
    dist, sigma = {}, {}
    for s in nodes:
        d, sg = {s: 0}, {s: 1}
        dq = deque([s])
        while dq:
            u = dq.popleft()
            for w in adj[u]:
                if w not in d:
                    d[w] = d[u] + 1
                    sg[w] = 0
                    dq.append(w)
                if d[w] == d[u] + 1:
                    sg[w] += sg[u]
        dist[s], sigma[s] = d, sg
    return dist, sigma


def brute_betweenness(nodes, edges):
    dist, sigma = bfs_all(nodes, edges)
    bc = {n: 0.0 for n in nodes}
    for s, t in itertools.combinations(nodes, 2):
        if t not in dist[s]:
            continue
        for v in nodes:
            if v in (s, t) or v not in dist[s] or t not in dist[v]:
                continue
            if dist[s][v] + dist[v][t] == dist[s][t]:
                bc[v] += sigma[s][v] * sigma[v][t] / sigma[s][t]
    return bc


def frames(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame([(f"e{i}", u, v) for i, (u, v) in enumerate(edges)], "id string, src string, dst string")
    return n, e


@pytest.mark.parametrize("shape", list(SHAPES))
def test_components_and_betweenness(spark, shape):
    nodes, edges = SHAPES[shape]
    n, e = frames(spark, nodes, edges)
    comp = {r["node"]: r["component"] for r in G.connected_components(n, e).collect()}
    dist, _ = bfs_all(nodes, edges)
    assert comp == {v: min(dist[v]) for v in nodes}
    bc = {r["node"]: r["betweenness"] for r in G.betweenness(n, e).collect()}
    want = brute_betweenness(nodes, edges)
    assert bc.keys() == want.keys()
    assert all(abs(bc[k] - want[k]) < 1e-9 for k in want), (bc, want)


def test_degree_loop_counts(spark):
    nodes, edges = SHAPES["self_loop_parallel"]
    n, e = frames(spark, nodes, edges)
    deg = {r["node"]: (r["degree"], r["connections"]) for r in G.degree(n, e).collect()}
    assert deg["a"] == (5, 4)  # loop counts 2 in degree, 1 in connected edges


def test_long_path_converges(spark):
    nodes = [f"n{i:03d}" for i in range(200)]
    edges = list(zip(nodes, nodes[1:]))
    n, e = frames(spark, nodes, edges)
    comp = {r["component"] for r in G.connected_components(n, e).collect()}
    assert comp == {"n000"}


def test_components_match_a_plain_search(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        nodes = [f"n{i}" for i in range(80)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.choice([30, 60, 120]))]
        n, e = frames(spark, nodes, edges)
        dist, _ = bfs_all(nodes, edges)
        for salts in (1, 5):
            got = {r["node"]: r["component"] for r in G.connected_components(n, e, salts).collect()}
            assert got == {v: min(dist[v]) for v in nodes}


@pytest.mark.parametrize("hub", ["a", "z"])  # smaller, and larger than all its leaves
def test_hub_is_dealt_out(spark, hub):
    leaves = 100_000
    e = spark.range(leaves).selectExpr("concat('e', id) AS id", f"'{hub}' AS src", "concat('m', id) AS dst")
    n = e.select(F.col("dst").alias("node")).unionByName(spark.createDataFrame([(hub,)], "node string"))
    got = G.connected_components(n, e)
    assert got.where("component = 'a'" if hub == "a" else "component = 'm0'").count() == leaves + 1
    # what one key of the look-up holds: the hub's edges by salt, never all of them
    edges = e.selectExpr("src AS at", "dst AS other")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(G.SALTS))).groupBy("at", "salt").count()
    assert salted.agg(F.max("count")).first()[0] < 2 * leaves / G.SALTS
    assert G._nearest(edges, "at", "other", G.SALTS).where("least = 'm0'").count() == leaves


def test_betweenness_of_trees_and_cycles_with_trees(spark):
    import random

    for seed, share in ((1, 0.0), (2, 0.01), (3, 0.9)):  # fold to the end, as usual, and hardly at all
        rng = random.Random(seed)
        nodes = [f"n{i:02d}" for i in range(34)]
        edges = [(nodes[i], nodes[rng.randrange(i)]) for i in range(1, 22)]        # a tree
        edges += [(nodes[i], nodes[rng.randrange(22, i)]) for i in range(23, 32)]  # another; two nodes stay alone
        edges += [(nodes[3], nodes[9]), (nodes[9], nodes[14]), (nodes[5], nodes[5]), (nodes[23], nodes[22])]
        n, e = frames(spark, nodes, edges)
        G.FOLD_SHARE, before = share, G.FOLD_SHARE
        try:
            counter = {}
            got = {r["node"]: r["betweenness"] for r in G.betweenness(n, e, counter).collect()}
        finally:
            G.FOLD_SHARE = before
        want = brute_betweenness(nodes, edges)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), (seed, got, want)
        if seed < 3:
            assert counter["folded"] > 15 and counter["state"] < 34 * 34 / 6


def test_degree_of_shared_and_missing_ids(spark):
    rows = [("x", "a", "b"), ("x", "a", "c"), ("x", "a", "a"), ("y", "a", "b"), (None, "a", "b"), (None, "c", "c")]
    e = spark.createDataFrame(rows, "id string, src string, dst string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), ("a",)], "node string")
    got = sorted((r["node"], r["degree"], r["connections"]) for r in G.degree(n, e).collect())
    assert got == [("a", 6, 2), ("a", 6, 2), ("b", 3, 2), ("c", 3, 1), ("z", 0, 0)]
    assert G.degree(n, e).schema["degree"].dataType.simpleString() == "bigint"


def test_degree_has_no_row_per_node_and_edge(spark):
    """Where no two edges share an id, rows are grouped by node at once: no aggregate carries the ids."""
    e = spark.range(100).selectExpr("concat('e', id) AS id", "concat('s', id % 7) AS src", "concat('p', id % 11) AS dst")
    n = e.selectExpr("src AS node").distinct()
    plan = G.degree(n, e)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[node#" in plan and ", id#" not in plan.split("HashAggregate", 1)[1].split("functions", 1)[0]
    assert {r["connections"] for r in G.degree(n, e).collect()} == {14, 15}


def test_components_run_over_numbers(spark):
    e = spark.createDataFrame([("e1", "b", "a"), ("e2", "c", "b"), ("e3", "d", "d"), ("e4", None, "a")], "id string, src string, dst string")
    named, pairs = G._numbered(e)
    assert {r["node"] for r in named.collect()} == {"a", "b", "c"} and dict(pairs.dtypes) == {"big": "bigint", "small": "bigint"}
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,), ("c",)], "node string")
    got = [(r["node"], r["component"]) for r in G.connected_components(n, e).collect()]
    assert sorted(got, key=str) == [("a", "a"), ("b", "a"), ("c", "a"), ("c", "a"), ("d", "d"), (None, None)]
