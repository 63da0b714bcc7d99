import random

import pytest

import rigspark.operators.graph as graph
from rigspark.operators.graph import connected_components, trace_members, trace_observations
from rigspark.scratch import written


def brute(edges):
    label = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {n: low if c == high else c for n, c in label.items()}
    return label


@pytest.mark.parametrize("nodes", [500_000, 0])
def test_components_match_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(graph, "BROADCAST_NODES", nodes)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2064)] + [(5000, 5000), (7, 8), (8, 7), (-3, -9)]
    df = spark.createDataFrame([*edges, (None, 4), (4, None)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_match_graph_of_the_given_table(spark):
    from rigspark import bindings as B
    from rigspark import registry

    edges = [tuple(r) for r in B.match_graph(spark, "/root/testdata/sf0.001").collect()]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = registry.queries()["g1_match_components"](spark, "/root/testdata/sf0.001").collect()
    assert {r.node: r.component for r in got} == {n: root(n) for n in list(parent)}


def test_traces_and_their_observations(spark):
    matches = spark.createDataFrame([("cam0/1", 3, "cam1/1", 4), ("cam1/1", 4, "cam2/1", 5), ("cam0/1", 9, "cam2/1", 8)], "image0 string, idx0 int, image1 string, idx1 int")
    members = trace_members(matches)
    sets = {}
    for r in members.collect():
        sets.setdefault(r.trace_id, set()).add((r.image, r.kp_idx))
    assert sorted(map(sorted, sets.values())) == [[("cam0/1", 3), ("cam1/1", 4), ("cam2/1", 5)], [("cam0/1", 9), ("cam2/1", 8)]]
    from pyspark.sql import functions as F

    keypoints = spark.createDataFrame([(f"cam{c}/1", k, float(c), float(k)) for c, k in ((0, 3), (1, 4), (2, 5), (0, 9))], "image string, kp_idx int, px double, py double")
    cameras = spark.createDataFrame([("cam0", 0), ("cam1", 1), ("cam2", 2)], "id string, ordinal int")
    got = trace_observations(members, keypoints, cameras, F.split("image", "/")[0]).collect()
    assert sorted((r.id, r.ordinal, r.px, r.py) for r in got) == [("cam0", 0, 0.0, 3.0), ("cam0", 0, 0.0, 9.0), ("cam1", 1, 1.0, 4.0), ("cam2", 2, 2.0, 5.0)]


def test_heavy_nodes_are_broadcast_and_long_chains_end_in_few_rounds(spark, monkeypatch):
    """A hub, rings over two chunks, and a chain that one task contracts before any round."""
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    monkeypatch.setattr(graph, "HEAVY_ROWS", 20)
    rng = random.Random(5)
    edges = [("h", f"n{i}") for i in range(300)] + [(f"a{rng.randrange(200)}", f"b{rng.randrange(200)}") for _ in range(230)] + [("é", "z"), ("z", "\U0001f600")]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(4)
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(edges)
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or written(df))
    chain = spark.range(1, 20_000).coalesce(1).selectExpr("id src", "id - 1 dst")
    assert connected_components(chain).where("component <> 0").count() == 0
    assert len(rounds) <= 7


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """A chain in pieces over many partitions, a loop and a hub: written twice, as given and as found."""
    steps = []
    monkeypatch.setattr(graph, "written", lambda df: steps.append(1) or written(df))
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(300)] + [("x", "x"), ("é", "z")] + [("h", f"q{i}") for i in range(40)]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(32)
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(edges)
    assert len(steps) == 2


@pytest.mark.parametrize("nodes", [400, 700])
def test_rounds_end_where_one_task_can_finish(spark, monkeypatch, nodes):
    """More edges than one task is given, fewer once repeated ones are gone; 400: not even then."""
    monkeypatch.setattr(graph, "BROADCAST_NODES", nodes)
    rng = random.Random(8)
    edges = [(rng.randrange(280), rng.randrange(280)) for _ in range(500)] + [(i, i + 1) for i in range(1000, 1030)] + [(9999, 9999)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == brute(edges)


def test_small_components_end_without_steps_on_single_nodes(spark, monkeypatch):
    """Pairs, triangles and a few chains over many partitions: what is left beyond stars is for one task."""
    monkeypatch.setattr(graph, "BROADCAST_NODES", 300)
    monkeypatch.setattr(graph, "_stars", None)
    edges = [(10 * i + a, 10 * i + b) for i in range(400) for a, b in ((0, 1), (1, 2), (0, 2))] + [(10 * i + 2, 10 * i + 10) for i in range(0, 60, 2)] + [(7777, 7777), (1, 1)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == brute(edges)


def test_traces_are_named_alike_with_and_without_numbers(spark, monkeypatch):
    rng = random.Random(3)
    names = ["rgb/cam1/1.png", "rgb/cam1/1", "rgb/cam10/1.png", "rgb/\u00e9/1", "rgb/cam1/1.png2", "a b", "a"]
    rows = [(*(x for _ in "01" for x in (rng.choice(names), rng.randrange(90))),) for _ in range(160)] + [("a", (1 << 31) - 1, "a b", 0)]
    matches = spark.createDataFrame(rows, "image0 string, idx0 int, image1 string, idx1 int")
    numbered = sorted(trace_members(matches).collect())
    assert graph._numbered(matches) is not None
    monkeypatch.setattr(graph, "MOST_IMAGES", 3)
    assert graph._numbered(matches) is None
    assert sorted(trace_members(matches).collect()) == numbered
    with_negative = matches.union(spark.createDataFrame([("a", -1, "b", 2)], matches.schema))
    monkeypatch.setattr(graph, "MOST_IMAGES", 100)
    assert graph._numbered(with_negative) is None
