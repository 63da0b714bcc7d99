import math

import numpy as np
import pytest

import rigspark.llm.hyperplane_tree as tree
from rigspark.llm.hyperplane_tree import Tree, hard_negatives, negatives_of_every_fiftieth


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    """``rows``: distinct (id, label, whole-numbered vector)."""
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r[0] != a[0])
        for s, i, _ in [r for r in scored if r[2] == a[1]][:positives]:
            fit = [r for r in scored if r[2] != a[1] and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a[0], i, k, n, -s, -t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def of_contract(rows):
    out = set()
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    return list(out)


@pytest.fixture
def little(monkeypatch):
    for name, value in {"SHARD_ROWS": 150, "QUERY_ROWS": 7, "LEAF_ROWS": 8, "SPLITS": 4, "TOP_POINTS": 6, "LABEL_GROUPS": 3}.items():
        monkeypatch.setattr(tree, name, value)


def test_given_table(spark, little):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = [tuple(r) for r in negatives_of_every_fiftieth(table).collect()]
    want = brute(of_contract([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]), lambda i: i % 50 == 0)
    assert sorted(got) == want


def test_clustered_rows_of_different_length(spark, little):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8)) * rng.lognormal(0, 1, (12, 1))
    rows = [(i, (centres[i % 12] + 0.3 * rng.standard_normal(8)).tolist(), i % 5) for i in range(1200)]
    rows += [(2000 + i, rows[7][1], int(i % 3 == 0)) for i in range(400)] + [(50, rows[7][1], 1)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in negatives_of_every_fiftieth(df).collect()]
    assert sorted(got) == brute(of_contract(rows), lambda i: i % 50 == 0)


def test_what_takes_no_part_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 9), (0, [1.0, 0.5], 9), (1, [1.0, 0.0], 0), (2, [0.9, 0.1], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1)]
    rows += [(8, [0.7, 0.2], None), (9, [0.5, 0.5, 3.0], 2), (10, [], 2), (50, [-1.0, 0.0], 4), (100, [0.0, 0.0], 5), (101, [0.3, 0.3], 5), (150, [0.3], 6), (7, [0.6, 0.6], 9)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, grp int, id string, vec int")
    got = sorted(tuple(r) for r in negatives_of_every_fiftieth(df).collect())
    assert got == brute(of_contract(rows), lambda i: i % 50 == 0) and got
    assert negatives_of_every_fiftieth(df.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(i, [int(1e18) + i * int(1e17), -i], i % 2) for i in range(12)]
    df = spark.createDataFrame([(i, v, y) for i, v, y in rows], "id long, vec array<bigint>, label long")
    most = (1 << 63) - 1
    for r in hard_negatives(df, df["id"] == 0, low=1, high=100).collect():
        assert r.positive_score == most == r.negative_score
    assert (tree.inner(np.array([[2**31, 3]]), np.array([[2**30, 5]])) == 2**61 + 15).all()


def test_ranges_exclude_leaves_but_no_row():
    rng = np.random.default_rng(6)
    x = np.floor(256 * (rng.integers(0, 30, (6000, 1)) * 2.0 + 0.05 * rng.standard_normal((6000, 6)))).astype(np.int64)
    found = Tree(x, np.arange(6000), np.zeros(6000, np.int64))
    q = x[:40]
    scores = q @ x.T
    hi = np.quantile(scores, 0.6, axis=1).astype(np.int64)
    lo = np.quantile(scores, 0.58, axis=1).astype(np.int64)
    read = []
    inner = tree.inner
    try:
        tree.inner = lambda a, b: (read.append(len(b)), inner(a, b))[1]
        stored = Tree.of(found.to_bytes())
        each = [stored.search(q[i : i + 1], np.full(1, -1), np.ones(1, np.int64), lo[i : i + 1], hi[i : i + 1], 5, False) for i in range(40)]
    finally:
        tree.inner = inner
    for i in range(40):
        fit = sorted((-s, k) for k, s in enumerate(scores[i].tolist()) if lo[i] <= s <= hi[i])[:5]
        have = [(-s, k) for s, k in zip(each[i].score[0].tolist(), each[i].id[0].tolist()) if k < 2**62]
        assert have == fit
    assert sum(read) / 40 < 6000 / 4
