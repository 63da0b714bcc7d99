"""A query's work in all shards together grows less than their number, and recall stays."""

import numpy as np

from rigspark.llm.ann import EF_SEARCH, LEAST_SEARCH, Graph, search_width


def test_width_of_a_search_falls_with_the_number_of_shards():
    assert search_width(20, 1) == EF_SEARCH and search_width(300, 1) == 600
    assert 4 * search_width(20, 4) <= 2 * EF_SEARCH
    assert search_width(20, 10_000) == LEAST_SEARCH


def test_recall_over_shards_that_are_searched_with_less():
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((12_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    queries, found = vectors[:100], []
    for s in range(4):
        rows = np.arange(s, len(vectors), 4)
        at = Graph(vectors[rows]).search(queries, search_width(20, 4))
        assert all(len(set(a)) == len(a) for a in at.tolist())
        found.append(np.where(at >= 0, rows[at], -1))
    want = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    recall = np.mean([len(set(f) & set(w)) / 20 for f, w in zip(np.concatenate(found, 1).tolist(), want.tolist(), strict=True)])
    assert recall >= 0.97, recall
