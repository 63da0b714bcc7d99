import numpy as np
import pytest

from rigspark.llm.ann import EF_SEARCH, SHARD_ROWS, Graph, nearest, neighbours_of_every_twentieth


def brute(rows, queries, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in queries:
        found = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_recall_and_scores_on_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    got = {}
    for r in neighbours_of_every_twentieth(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute([(i, v.tolist()) for i, v in rows.items()], [(i, rows[i].tolist()) for i in rows if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - float(rows[q] @ rows[i])) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 20 * len(want)


@pytest.mark.parametrize("equal_lengths", [True, False])
def test_recall_of_a_full_shard_of_random_vectors(equal_lengths):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((SHARD_ROWS, 64))
    if equal_lengths:
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = vectors[rng.choice(SHARD_ROWS, 128, False)]
    found = Graph(vectors).search(queries, EF_SEARCH)
    want = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    recall = np.mean([len(set(f) & set(w)) / 20 for f, w in zip(found.tolist(), want.tolist())])
    assert recall >= (0.98 if equal_lengths else 0.9), recall


@pytest.mark.parametrize("sigma", [0.1, 0.25, 0.5])
def test_recall_of_a_shard_whose_lengths_differ(sigma):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((SHARD_ROWS, 64))
    vectors *= rng.lognormal(0, sigma, (SHARD_ROWS, 1)) / np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = vectors[rng.choice(SHARD_ROWS, 200, False)]
    found = Graph(vectors).search(queries, EF_SEARCH)
    want = np.argsort(-(queries @ vectors.T), axis=1)
    for k in (3, 20):
        assert np.mean([len(set(f) & set(w[:k])) / k for f, w in zip(found.tolist(), want.tolist())]) >= 0.9


def test_bands_cover_all_rows():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((5000, 6)) * rng.lognormal(0, 1, (5000, 1))
    graph = Graph(vectors)
    assert len(graph.rows) > 3 and sorted(np.concatenate(graph.rows).tolist()) == list(range(5000))
    assert min(map(len, graph.rows)) >= 512
    again = Graph.of(graph.arrays())
    assert (graph.search(vectors[:40], 60) == again.search(vectors[:40], 60)).all()


def test_stored_graph_is_the_graph():
    vectors = np.random.default_rng(1).standard_normal((3000, 8))
    graph = Graph(vectors)
    again = Graph.of(graph.arrays())
    assert all((a == b).all() for a, b in zip(graph.links, again.links, strict=True))
    assert (graph.search(vectors[:50], 40) == again.search(vectors[:50], 40)).all()


def test_recall_of_several_shards(spark, monkeypatch):
    import rigspark.llm.ann as module

    monkeypatch.setattr(module, "SHARD_ROWS", 1500)
    monkeypatch.setattr(module, "QUERY_ROWS", 20)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 16))
    rows = [(i, (centres[i % 10] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    hits = sum(len({i for _, i in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i in sorted(got[0])] == [i for i, _ in want[0]]


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, vec int, ids string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours_of_every_twentieth(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 20, -1.0), (20, 1, 2, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0)]
    assert neighbours_of_every_twentieth(df.limit(0)).count() == 0
