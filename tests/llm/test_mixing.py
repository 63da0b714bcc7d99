import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from rigspark.llm.mixing import _uniform, mix_sources, mixed


def targets(sizes, weights=(1, 2, 3), most=3):
    """The contract word for word: share by weight, stop at the caps, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            out[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.discard(s)
    return out


def check(docs, got):
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        longest[r.source] = max(longest[r.source], n)
    want = targets(sizes)
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1, s


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mix_sources(docs).collect()
    check(docs.collect(), got)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))


def brute_copies(rows, tilt=0.1, most=3):
    """Copies by the docstring's law; ``rows``: (key, source, words, u)."""
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    out, want = {}, targets(sizes)
    for source in sizes:
        own = [(k, n, u) for k, s, n, u in rows if s == source and n]
        words = defaultdict(int)
        for _, n, _ in own:
            words[n.bit_length() - 1] += n
        low, high = 0.0, float(most)
        for _ in range(200):  # the level at which the classes' shares sum to the target
            level = (low + high) / 2
            low, high = (level, high) if sum(min(most * w, level * w * (1 + tilt * c)) for c, w in words.items()) < want[source] else (low, level)
        copies = {c: min(most, low * (1 + tilt * c)) for c in words}
        p = {c: x - int(x + 1e-9) if x - int(x + 1e-9) > 1e-9 else 0.0 for c, x in copies.items()}
        ranked, missing = defaultdict(list), 0.0
        for k, n, u in own:
            c = n.bit_length() - 1
            out[k] = int(copies[c] + 1e-9)
            missing += p[c] * n
            if p[c]:
                ranked[u / (1 - u) / (p[c] / (1 - p[c]))].append((k, n))
        so_far = 0.0
        for q in sorted(ranked):
            more = sum(n for _, n in ranked[q])
            if so_far + more > missing and so_far + more - missing >= more / 2:
                break
            so_far += more
            for k, _ in ranked[q]:
                out[k] += 1
            if so_far > missing:
                break
    return out


def test_ranking_and_cut_match_a_plain_version(spark, monkeypatch):
    import rigspark.llm.mixing as module

    for ranges, table in ((8192, "sf0.01"), (40, "sf0.001")):
        monkeypatch.setattr(module, "BUCKET_ROWS", ranges)
        docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
        drawn = docs.withColumn("u", _uniform(20, F.col("doc_id"), F.col("text"))).collect()
        rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.u) for r in drawn]
        want = brute_copies(rows)
        got = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
        assert got == {k: want.get(k, 0) for k in got} and len(set(got.values())) > 2


def test_clashing_names(spark):
    names = ["p", "sure", "last_q", "__size", "__key", "missing", "SIZE", "range"]
    docs = spark.createDataFrame([(i, "w " * (i % 5), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    more = docs.select("*", *(F.lit(n).alias(n) for n in names))
    plain = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    got = mix_sources(more).collect()
    assert {r.doc_id: r.copies for r in got} == plain and all(r[n] == n for r in got for n in names if n != "SIZE")
    assert mixed(more).columns == more.columns and all(r[n] == n for r in mixed(more).collect() for n in names)


def test_caps_nulls_ties_and_ranges(spark, monkeypatch):
    import rigspark.llm.mixing as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 7)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows = [(i, "w " * (i % 9), "big", 1, "x") for i in range(300)]
    rows += [(1000 + i, "a b c", "small", 2, None) for i in range(4)] + [(2000, "one two", None, 3, "y"), (2001, None, None, 3, "y")]
    rows += [(3000, "", "void", 0, ""), (None, "null id", "Ünder", 0, ""), (None, "null id", "Ünder", 0, ""), (4000, "long " * 20000, "long", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")
    got = mix_sources(docs)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = got.collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    want = targets(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got) and len(got) == len(rows)
    assert all(r.taken == 3 * r.size for r in got if r.source == "small")
    assert mixed(docs).columns == docs.columns
    assert mixed(docs).count() == sum(r.copies for r in got)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 0 and mixed(docs).count() == 0
    empty = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix_sources(empty).collect()] == [(0, 0.0)]


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (4 if i % 2 else 64), "a" if i < 2000 else "b") for i in range(4000)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), tilt=0.2).collect()
    mean = lambda n: sum(r.copies for r in got if r.source == "a" and r.size == n) / 1000
    assert mean(64) > mean(4) > 0
