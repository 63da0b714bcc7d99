import itertools
import random
import re

import numpy as np
import pytest

from rigspark.llm.ngram_join import Schemes, histograms, jaccard_components, near_duplicates, possible_links, t_occurrences

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    sets = {d: brute_set(t, width) for d, t in rows}
    label = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        common = len(x & y)
        if x and y and 100 * common >= percent * (len(x) + len(y) - common) and label[a] != label[b]:
            keep, gone = sorted((label[a], label[b]))
            label = {d: keep if c == gone else c for d, c in label.items()}
    return {d: (len(sets[d]), label[d]) for d in sets}


def copies(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, bases = [], [[rng.choice(vocab) for _ in range(rng.choice([4, 9, 30, 80, 200]))] for _ in range(12)]
    for d in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.2:
            words = words[: max(1, int(len(words) * 0.93))]
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, width, percent, monkeypatch):
    rows = copies(7, 220) + [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "word " * 3000)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width, percent)


def test_components_match_brute_force_on_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_components(docs, width=3, percent=90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90)


def test_blocks_give_the_same_links(spark, monkeypatch):
    import rigspark.llm.ngram_join as join

    rows = copies(3, 120)
    monkeypatch.setattr(join, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(join, "BLOCK_DOCS", 9)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 80)


def test_every_linked_pair_shares_a_signature():
    rng, schemes = np.random.default_rng(1), Schemes(80)
    for n in [1, 2, 3, 5, 8, 13, 20, 34, 60, 120, 400]:
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            cut = int(rng.integers(0, n // 5 + 1))
            more = int(rng.integers(0, n // 5 + 1))
            y = np.r_[x[cut:], rng.integers(0, 1 << 63, more).astype(np.uint64)]
            if 100 * (n - cut) >= 80 * (n + more):
                both = np.r_[x, y]
                owner, sig = schemes.signatures(both, np.array([0, len(x), len(both)]))
                assert set(sig[owner == 0]) & set(sig[owner == 1]), n


def test_histograms_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in [1, 5, 40, 300, 200_000]:
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.r_[x[n // 10 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]
        both = np.r_[x, y]
        h = histograms(both, np.array([0, len(x), len(both)]))
        sizes, sides = np.array([len(x), len(y)]), np.array([True, False])
        assert possible_links(sizes, h, sides, 80, True) and possible_links(sizes, h, sides, 80, False)
    a, b = (rng.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(2))
    assert not possible_links(np.array([400, 400]), histograms(np.r_[a, b], np.array([0, 400, 800])), np.array([True, False]), 80, True)


def test_t_occurrences():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 40, rng.integers(0, 30))) for _ in range(rng.integers(1, 12))]
        least = int(rng.integers(1, 9))
        ids, times = np.unique(np.concatenate(lists), return_counts=True)
        want = {int(i): int(c) for i, c in zip(ids, times) if c >= least}
        got = dict(zip(*map(lambda x: x.tolist(), t_occurrences(lists, least))))
        assert got == want


def test_t_occurrences_skip_keeps_lists_that_stand_at_the_target():
    lists = [np.array(x) for x in ([1], [2, 3], [2, 4], [2, 5])]
    assert [x.tolist() for x in t_occurrences(lists, 3, mu=1000.0)] == [[2], [3]]
    rng = np.random.default_rng(5)
    for least, mu in [(100, 0.0085), (200, 0.0085), (150, 1.0), (200, 0.1)]:
        share = rng.choice([0.3, 0.6, 0.8, 0.9], 400)
        lists = [np.flatnonzero(rng.random(400) < share) for _ in range(250)]
        ids, times = np.unique(np.concatenate(lists), return_counts=True)
        want = {int(i): int(c) for i, c in zip(ids, times) if c >= least}
        found, counts = t_occurrences(lists, least, mu)
        assert want and dict(zip(found.tolist(), counts.tolist())) == want


def brute_of_repeated_ids(rows, width, percent):
    """As ``brute``, for rows whose ids repeat: a document has the links of all its texts."""
    texts = dict(enumerate(t for _, t in rows))
    of_text = brute(list(texts.items()), width, percent)
    label = {d: d for d, _ in rows}
    for i, (_, c) in of_text.items():
        a, b = label[rows[i][0]], label[rows[c][0]]
        label = {d: min(a, b) if x in (a, b) else x for d, x in label.items()}
    return sorted((d, of_text[i][0], label[d]) for i, (d, _) in enumerate(rows))


def test_a_repeated_id_joins_the_groups_of_its_texts(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "red green blue black white"
    for rows in ([(1, a), (2, b), (5, a), (5, b)], [(5, a), (5, b), (5, None), (7, b), (9, a), (9, a)], [(3, a), (3, b), (4, b), (4, c), (6, c), (8, "x y z")]):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90)
        assert sorted(tuple(r) for r in got.collect()) == brute_of_repeated_ids(rows, 3, 90)
    rng, rows = random.Random(11), copies(5, 90)
    rows = [(rng.randrange(60) - 30, t if rng.random() < 0.9 else None) for _, t in rows]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80)
    assert sorted(tuple(r) for r in got.collect()) == brute_of_repeated_ids(rows, 3, 80)


def test_signatures_met_lately_link_at_once(monkeypatch):
    import pyarrow as pa

    import rigspark.llm.ngram_join as join

    monkeypatch.setattr(join, "RECENT", 8)
    rows = copies(9, 150)
    batches = [pa.RecordBatch.from_pydict({"rep": pa.array([d for d, _ in part]), "text": pa.array([t for _, t in part])}) for part in (rows[:40], rows[40:41], rows[41:])]
    out = [r for b in join._signature_rows(iter(batches), 3, 80) for r in b.to_pylist()]
    alone = Schemes(80)
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for r in out:
        if r["hub"] is None:
            parent[root(r["rep"])] = root(holders.setdefault(r["sig"], r["rep"]))
        else:
            parent[root(r["rep"])] = root(r["hub"])
    got = {d: root(d) for d, _ in rows}
    parent, holders = {d: d for d, _ in rows}, {}
    for first, tokens, bounds in join.shingled(pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows])}), 3):
        for o, g in zip(*alone.signatures(tokens, bounds)):
            parent[root(rows[first + o][0])] = root(holders.setdefault(int(g), rows[first + o][0]))
    want = {d: root(d) for d, _ in rows}
    pairs = lambda label: {(a, b) for a in label for b in label if label[a] == label[b]}
    assert pairs(got) == pairs(want) and len(set(want.values())) < 100


def test_repeated_rows_null_ids_extra_columns_and_no_rows(spark):
    schema = "doc_id long, text string, digest int, n string, rep int"
    rows = [(1, "a b c d", 0, "x", 1), (1, "a b c d", 0, "x", 1), (None, "a b c d", 0, "x", 1), (None, "z z z", 0, "", 2), (2, "A b C d", 1, "y", 3)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in jaccard_components(docs, width=3, percent=90).collect())
    assert got == [(-1, 1, None), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    kept = near_duplicates(docs, width=3, percent=90)
    assert kept.columns == docs.columns and kept.count() == 4
    assert jaccard_components(docs.limit(0)).count() == 0


def near_copies(n, share):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 62, 150).astype(np.uint64)
    return [np.unique(np.r_[base[rng.random(150) < share], rng.integers(0, 1 << 62, 2).astype(np.uint64)]) for _ in range(n)]


def test_a_group_of_near_copies_costs_no_pass_over_all_its_pairs(monkeypatch):
    """Sets that a link connects leave the search of the set that brought it."""
    import rigspark.llm.ngram_join as join

    pops, pop = [], join.heapq.heappop
    monkeypatch.setattr(join.heapq, "heappop", lambda h: pops.append(1) or pop(h))
    sets = near_copies(200, 0.985)
    assert len(join.links_of_block(sets, [0] * 200, 90, False)) == 199
    assert len(pops) < 200 * 1000  # 1,000,000 if each set meets all before it


@pytest.mark.parametrize("apart", [False, True])
def test_links_of_a_block_match_brute_force(apart):
    from rigspark.llm.ngram_join import links_of_block

    for share, n in ((0.985, 90), (0.95, 120), (0.9, 60)):
        sets = near_copies(n, share)
        sides = [i % 3 == 0 for i in range(n)]
        label, want = np.arange(n), np.arange(n)
        for a, b in links_of_block(sets, sides, 90, apart):
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        for a, b in itertools.combinations(range(n), 2):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common) and not (apart and sides[a] == sides[b]):
                want[want == max(want[a], want[b])] = min(want[a], want[b])
        assert (label == want).all()


def test_offered_ids_that_are_settled_leave_the_search():
    lists = [np.arange(0, 400), np.arange(0, 400), np.arange(0, 400, 2), np.arange(100, 400)]
    seen = []

    def offer(ids, counts):
        seen.extend(ids.tolist())
        return np.arange(400) < 390 if len(seen) < 10 else None

    t_occurrences(lists, 3, offer=offer)
    assert seen[:4] == [0, 2, 4, 6] and seen[4:] == list(range(390, 400))


def test_signatures_without_common_shingles_miss_no_linked_pair():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        schemes = Schemes(percent)
        for size in (3, 12, 40, 150, 700):
            for share in (0.0, 0.3, 0.9, 1.0):
                x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
                apart = int(len(x) * 2 * (100 - percent) / (100 + percent)) // 2
                y = np.unique(np.r_[x[apart:], rng.integers(0, 1 << 63, apart).astype(np.uint64)])
                common = np.unique(np.r_[x[rng.random(len(x)) < share], y[rng.random(len(y)) < share]])
                owner, sig = schemes.signatures(np.r_[x, y], np.array([0, len(x), len(x) + len(y)]), common)
                assert set(sig[owner == 0]) & set(sig[owner == 1])


def shared_passage(n):
    """Documents of 60 words of their own that share one of 20, and four near copies of the first."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(20)]
    rows = [[f"d{d}x{rng.randrange(10**9)}" for _ in range(60)] + passage for d in range(n)]
    rows += [[*rows[0][:-1], f"end{i}"] for i in range(4)]
    return [(d, " ".join(words)) for d, words in enumerate(rows)]


def test_a_passage_that_many_share_does_not_make_them_candidates(spark, monkeypatch):
    import rigspark.llm.ngram_join as join

    monkeypatch.setattr(join, "SAMPLED", 1)
    met, refined = [], join._refined
    monkeypatch.setattr(join, "_refined", lambda texts, members, *a: met.append(members.count()) or refined(texts, members, *a))
    rows = shared_passage(300)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: 0 if d > 299 else d for d, _ in rows}
    assert met[0] < 30  # 304 where the passage counts


def test_texts_are_not_shuffled_for_tables_beyond_a_broadcast(spark, monkeypatch):
    import rigspark.llm.ngram_join as join

    rows = copies(11, 200) + [(None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r.doc_id or -1 for r in near_duplicates(docs, width=3, percent=80).collect())
    monkeypatch.setattr(join, "BROADCAST_ROWS", 40)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_duplicates(docs, width=3, percent=80)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.doc_id or -1 for r in kept.collect()) == want
        monkeypatch.setattr(join, "MOST_RANGES", 3)
        assert sorted(r.doc_id or -1 for r in near_duplicates(docs, width=3, percent=80).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_histogram_goes_to_no_more_block_pairs_in_larger_classes(spark, monkeypatch):
    import rigspark.llm.ngram_join as join

    monkeypatch.setattr(join, "BLOCK_DOCS", 5)
    texts = spark.createDataFrame([(d, f"a b c d e f g h i j k l m n{d}") for d in range(400)], "rep long, text string")
    members = texts.selectExpr("rep", "0L as grp", "12L as n")
    held, compare = spark.sparkContext.accumulator(0), join._compare

    def counted(frames, percent):
        def seen():
            for frame in frames:
                held.add(len(frame))
                yield frame

        return compare(seen(), percent)

    monkeypatch.setattr(join, "_compare", counted)
    edges = join._refined(texts, members, 3, 80).collect()
    label = {d: d for d in range(400)}
    for e in edges:
        keep, gone = sorted((label[e.rep], label[e.hub]))
        label = {d: keep if c == gone else c for d, c in label.items()}
    assert set(label.values()) == {0}
    assert held.value <= 400 * join.MOST_BLOCKS  # 400 * 80 in blocks of 5
