import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rigspark.llm.decontamination import contamination_report, decontaminate

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            p = words(t)
            for q in [p[i : i + window] for i in range(len(p) - window + 1)] if len(p) >= window else [p] if p else []:
                for at in range(len(w) - len(q) + 1):
                    if w[at : at + len(q)] == q:
                        hit |= set(range(at, at + len(q)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


DOCS = [
    (1, "zero one two three four five six seven eight nine ten eleven"),
    (2, "x ZERO-one, two three four five six seven eight nine y"),
    (3, None),
    (4, ""),
    (5, "short item here; Short Item here short item"),
    (6, "ümlaut ñ\x00é"),
    (7, "one two three four five six seven eight nine ten " * 4000),
    (7, "nothing"),
    (8, "solo"),
    (None, "short item here"),
]
ITEMS = [(0, "zero one two three four five six seven eight nine ten eleven"), (10, "Short item here"), (11, None), (12, " - "), (13, "solo"), (2, "a b c d e f g h i j"), (2, "Ümlaut ñ é"), (14, "ümlaut ñ é")]


def test_matches_brute_force_on_small_cases(spark):
    docs = spark.createDataFrame([(*d, "e", 1) for d in DOCS], "doc_id long, text string, items string, hits int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(contamination_report(docs, bench)) == brute(DOCS, ITEMS)
    kept = decontaminate(docs.withColumn("__text", F.col("text")), bench)
    assert kept.columns == [*docs.columns, "__text"]
    clean = {(r[0], r[5]) for r in brute(DOCS, ITEMS)}
    assert sorted((r.doc_id, False) for r in kept.collect()) == sorted(x for x in clean if not x[1])


def test_matches_brute_force_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert rows(contamination_report(docs, bench)) == want
    assert any(r[5] for r in want)


def test_passes_and_empty_tables(spark, monkeypatch):
    import rigspark.llm.decontamination as module

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(module, "PASS_WINDOWS", 3)
    monkeypatch.setattr(module, "PIECE_WINDOWS", 2)
    assert rows(contamination_report(docs, bench)) == brute(DOCS, ITEMS)
    assert decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    assert rows(contamination_report(docs, bench.limit(0))) == brute(DOCS, [])
    assert contamination_report(docs.limit(0), bench).count() == 0


def test_tables_of_a_large_benchmark_stay_small():
    import pickle
    import tracemalloc

    import numpy as np

    from rigspark.llm.decontamination import searchers

    rng = np.random.default_rng(3)
    n = 1_000_000
    vocabulary = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    text = vocabulary[rng.zipf(1.3, n) % len(vocabulary)]
    items = [(str(i), text[i * 4000 : i * 4000 + 4009].tobytes()) for i in range(n // 4000)] + [(f"same{i}", text[:2000].tobytes()) for i in range(20)]
    tracemalloc.start()
    [table], names = searchers(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(table)) < 60 * n and peak < 200 * n
    found = {}
    for t, begin, own in table.search(np.concatenate([text[5000:5030], vocabulary[:40], text[100:112]]), np.array([0, 30, 70, 82])):
        found.setdefault((t, begin), set()).update(names[o] for o in own)
    assert {t for t, _ in found} >= {0, 2} and all("1" in found[0, b] for b in range(21))
    assert all({"0", "same0", "same19"} <= found[2, b] for b in range(3))


@pytest.mark.parametrize("window", [1, 2, 3])
def test_small_windows(spark, window):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(contamination_report(docs, bench, window=window)) == brute(DOCS, ITEMS, window)


def test_shifts_skip_words_and_miss_nothing():
    """Texts longer than a stretch, of frequent and of unknown words, against every position."""
    import numpy as np

    from rigspark.llm.decontamination import searchers

    rng = np.random.default_rng(5)
    known, other = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (60, 4000))
    items = [(str(i), known[rng.integers(0, 60, 25)]) for i in range(40)]
    [table], names = searchers([(n, w.tobytes()) for n, w in items], 10)
    parts = []
    for _ in range(700):
        parts.append(rng.choice([known, other][rng.integers(2)], rng.integers(0, 30)))
        if rng.random() < 0.3:
            n, w = items[rng.integers(40)]
            at = rng.integers(0, 16)
            parts.append(w[at : at + 10])
    text = np.concatenate(parts)
    bounds = np.array([0, 0, 5, 2000, 2000, len(text)])
    held = {}
    for n, w in items:
        for at in range(16):
            held.setdefault(w[at : at + 10].tobytes(), set()).add(n)
    want = {}
    for t in range(5):
        for at in range(bounds[t], bounds[t + 1] - 9):
            if (own := held.get(text[at : at + 10].tobytes())) is not None:
                want[t, at - bounds[t]] = own
    assert {(t, b): {names[o] for o in own} for t, b, own in table.search(text, bounds)} == want and len(want) > 100
    looked = []
    words, blocks = table.places
    table.places = type("Counted", (), {"of": lambda self, v: looked.append(len(v)) or words.of(v)})(), blocks
    plain = rng.choice(other, 100_000)
    assert len(table.halts(plain, np.array([0, len(plain)]))) == 0 and sum(looked) < 30_000
