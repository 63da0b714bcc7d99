import zlib

import numpy as np

from rigspark.llm import quality
from rigspark.llm.quality import QualityModel, byte_pairs, chunk_starts, keep_quality, quality_report, score_quality, train_quality


def test_chunks_cover_the_whole_text():
    for places in [1, 5, 255, 256, 257, 480, 481, 5000, 70001]:
        covered = np.zeros(places, bool)
        for s in chunk_starts(places):
            covered[s : s + quality.CHUNK] = True
        assert covered.all()


def test_pooled_responses_match_a_plain_convolution():
    model, rng = QualityModel.fresh(1), np.random.default_rng(0)
    table = model.pair_table()
    for n in [0, 1, 7, 8, 9, 600, 5000]:
        data = rng.integers(32, 127, n).astype(np.uint8)
        raw = np.zeros(max(n, 8) + max(n, 8) % 2, np.uint8)
        raw[:n] = data
        places = range(0, len(raw) - 7, 2)
        plain = np.array([sum(model.embed[raw[p + k]] @ model.filters[k] for k in range(8)) for p in places])
        tops = np.tanh(np.array([plain[s : s + quality.CHUNK].max(0) for s in chunk_starts(len(plain))]) + model.bias)
        got, chunks = model.pooled(data, table)
        assert chunks == len(tops) and len(byte_pairs(data)) * 2 == len(raw)
        np.testing.assert_allclose(got[:-1], np.r_[tops.mean(0), tops.min(0), tops.max(0)], atol=1e-4)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_report(docs, labels).collect()}
    assert len(got) == docs.count()
    known = [(got[r.doc_id], r.quality) for r in labels.collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [(r.score, q) for r, q in known if r.held_out]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95, auc
    assert np.mean([s >= 0.5 for s in good]) > 0.93


def test_training_reads_whole_texts_within_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y, seed: seen.append((texts, y)))
    monkeypatch.setattr(quality, "TRAIN_BYTES", 120_000)
    long = "x" * 50_000 + "end"
    docs = spark.createDataFrame([(i, long if i < 4 else f"short {i}", "a") for i in range(40)], "doc_id long, text string, label string")
    train_quality(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    [(texts, y)] = seen
    assert sum(map(len, texts)) <= 120_000 and len(set(y.tolist())) == 2
    assert all(t == long.encode() or t.startswith(b"short") for t in texts)


def test_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words here. " if i % 2 else "@@## $$%% ") * 20, "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (61, "", "x"), (None, "a", "x"), (62, "ü" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = train_quality(docs, labels)
    got = score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 60} == set(range(1, 60, 2))
    assert train_quality(docs, labels.where("quality = 1")) is None
    assert {r.score for r in score_quality(docs, None).collect()} == {0.5}
    assert score_quality(docs.limit(0), model).count() == 0
