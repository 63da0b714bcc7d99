import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rigspark.llm.sharding import interleave, shard_report


def check(rows, shards, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shard_report(docs).collect()
    check(got, 24, docs.count())
    want = sorted((r.doc_id, len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sorted(map(str, got)) == sorted(map(str, shard_report(docs.repartition(3)).collect()))
    # Each shard holds a source in its proportion, to about one row.
    placed = interleave(docs).collect()
    total, each = Counter(r.source for r in placed), Counter((r.source, r.shard) for r in placed)
    assert all(abs(each[s, k] - n / 24) <= 2 for s, n in total.items() for k in range(24))


def test_edges(spark, monkeypatch):
    import rigspark.llm.sharding as module

    monkeypatch.setattr(module, "RANGE_ROWS", 5)
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    rows = [(i % 7, "same", "hot", 1, 2) for i in range(60)] + [(None, None, None, 1, 2)] * 3 + [(9, "", "b", 0, 0), (10, "ü" * 50000, "b", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, size int")
    got = interleave(docs, 7)
    assert got.columns == ["doc_id", "text", "source", "size", "shard", "slot"]
    check(got.collect(), 7, len(rows))
    report = shard_report(docs, 7).collect()
    check(report, 7, len(rows))
    assert {(r.size, r.text_crc32) for r in report if r.doc_id is None} == {(8, 0)}
    assert {r.size for r in report if r.doc_id == 10} == {100008}
    check(shard_report(docs.limit(2), 7).collect(), 7, 2)
    assert shard_report(docs.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["__key", "__hash", "__all", "__range", "__before", "__rank", "__part", "__earlier", "__place", "__rows", "n", "a.b", "__in0", "__in1"]
    rows = [(i, f"text {i}", "ab"[i % 2], *(f"{n}{i}" for n in names)) for i in range(30)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    got = interleave(docs, 7)
    assert got.columns == [*docs.columns, "shard", "slot"]
    check(got.collect(), 7, 30)
    assert sorted(tuple(r)[:-2] for r in got.collect()) == sorted(map(tuple, rows))
    dotted = interleave(docs.withColumnRenamed("text", "the.text"), 7, text_col="the.text")
    assert "the.text" in dotted.columns and dotted.count() == 30


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = shard_report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_places(rows, shards):
    """Shard and slot by the docstring's law; ``rows``: (row, source, hash, id), ids without null."""
    by, n = {}, len(rows)
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = []
    for source, own in by.items():
        own.sort(key=lambda r: ((r[2] % (1 << 64)) >> 11, r[2], r[3]))
        order += [((k + 0.5) / len(own), source is None, (source or "").encode(), r[2], r[3], r[0]) for k, r in enumerate(own)]
    out, taken = {}, {}
    for place, (*_, row) in enumerate(sorted(order)):
        shard = place * shards // n
        out[row] = shard, taken.setdefault(shard, 0)
        taken[shard] += 1
    return out


def test_order_matches_a_plain_version(spark, monkeypatch):
    import rigspark.llm.sharding as module

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hashed = docs.select("doc_id", "source", F.xxhash64(F.lit(4), "doc_id", F.xxhash64("text")).alias("h")).collect()
    want = brute_places([(r.doc_id, r.source, r.h, r.doc_id) for r in hashed], 24)
    for ranges in (8192, 50):
        monkeypatch.setattr(module, "RANGE_ROWS", ranges)
        assert {r.doc_id: (r["shard"], r.slot) for r in module.shard_report(docs, 24).collect()} == want
