from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from rigspark.llm import quality as Q
from rigspark.llm.common import written
from rigspark.llm.mixing import _uniform
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_mixing import brute_copies
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_sharding import brute_places

SF = "/root/testdata/sf0.001"


def plain_score(model, text):
    """The network as its docstrings tell it, without tables or pieces."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    raw = np.zeros(max(len(data), Q.SPAN) + max(len(data), Q.SPAN) % 2, np.uint8)
    raw[: len(data)] = data
    spans = np.lib.stride_tricks.sliding_window_view(raw, Q.SPAN)[:: Q.STRIDE]
    got = np.einsum("nkd,kdf->nf", model.embed[spans], model.filters)
    starts = [0] if len(got) <= Q.CHUNK else sorted({*range(0, len(got) - Q.CHUNK, Q.STEP), len(got) - Q.CHUNK})
    act = np.tanh(np.array([got[s : s + Q.CHUNK].max(0) for s in starts]) + model.bias)
    x = np.r_[act.mean(0), act.min(0), act.max(0), np.log2(min(len(got), Q.CHUNK)) / 8]
    return 1 / (1 + np.exp(-(np.tanh(x @ model.w1 + model.b1) @ model.w2 + model.b2[0])))


def held(name, spark, before, after, bench):
    """The stage's rows against a plain version over all of its input."""
    text = {r.doc_id: r.text for r in before}
    kept = Counter(r.doc_id for r in after)
    if name == "quality":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        model = Q.train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        scores = {d: plain_score(model, t) for d, t in text.items()}
        assert all((d in kept) == (s >= 0.5) for d, s in scores.items() if abs(s - 0.5) > 1e-3)
        assert len(kept) > 0.6 * len(text)
    if name == "near_copies":
        label = components([(r.doc_id, r.text) for r in before], 5, 80)
        assert set(kept) == {d for d, (_, c) in label.items() if c == d}
    if name == "benchmark_leaks":
        assert set(kept) == {r[0] for r in leaks([(r.doc_id, r.text) for r in before], bench) if not r[5]}
    if name == "source_mix":
        drawn = spark.createDataFrame(before).withColumn("u", _uniform(20, F.col("doc_id"), F.col("text"))).collect()
        want = brute_copies([(r.doc_id, r.source, len([w for w in (r.text or "").split() if w]), r.u) for r in drawn])
        assert kept == Counter({d: n for d, n in want.items() if n})
    if name == "shards":
        rows = spark.createDataFrame(before).select("doc_id", "source", F.xxhash64(F.lit(4), "doc_id", "text").alias("h")).collect()
        want = brute_places([(i, r.source, r.h, r.doc_id) for i, r in enumerate(rows)], P.SHARDS)
        assert sorted((r.doc_id, r["shard"], r.slot) for r in after) == sorted((rows[i].doc_id, *p) for i, p in want.items())
    if name not in ("source_mix", "shards"):
        assert all(n == 1 for n in kept.values())


def test_each_stage_against_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF))
        after = docs.collect()
        text = {r.doc_id: r.text for r in before}
        assert all(text[r.doc_id] == r.text for r in after)
        if name != "shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held(name, spark, before, after, bench)


def test_hard_rows_pass_every_stage(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties and columns that clash."""
    plain = "these are quite ordinary words that make up a short but complete document about nothing at all "
    rows = [(1, plain, "en", "a", 5, "x"), (1, plain, "en", "a", 5, "x"), (2, None, None, None, None, None), (3, "", "en", "b", 0, "x"), (None, plain + "more", "en", "b", 1, "x"), (4, "word " * 200_000, "en", "a", 1, "x"), (5, plain.upper(), "en", None, 1, "x"), (6, "é" * 300_000, None, "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, p string")
    docs = docs.withColumns({c: F.lit(c) for c in ("sure", "__size", "__text", "rep", "grp", "digest", "f_note", "slot", "__gone", "__key", "__hash", "__all", "__before", "__rank", "a.b")})
    columns = docs.columns
    for name, stage in P.STAGES:
        before = docs.count()
        docs = written(stage(spark, docs, SF))
        assert docs.count() <= (3 * before if name == "source_mix" else before), name
        if name == "shards":
            assert sorted(docs.columns) == sorted([*[f"{c}" for c in ("doc_id", "text", "lang", "source", "n_chars", "p", "sure", "__size", "__text", "rep", "grp", "digest", "f_note", "slot", "__gone", "__key", "__hash", "__all", "__before", "__rank", "a.b")], "shard"])
        else:
            assert docs.columns == columns
            assert all(r["__text"] == "__text" and r["__size"] == "__size" and r.sure == "sure" for r in docs.select("__text", "__size", "sure").collect())
        if name == "near_copies":
            assert {r.doc_id for r in docs.collect()} <= {1, 2, 3, 4, 6, None}


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
