import hashlib
import zlib

import pytest

import rigspark.llm.merkle as merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def brute(rows, fanout=2):
    """The contract row by row; ``rows``: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[g] = levels([leaf(*r) for r in by[g]], fanout)
    top = levels([trees[g][-1][0] for g in langs], fanout)
    root, out = top[-1][0], []
    for i, g in enumerate(langs):
        for k, r in enumerate(by[g]):
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, beside = leaf(*r[:3], r[3] + 1, r[4]) if tampered else leaf(*r), ""
            for tree, at in ((trees[g], k), (top, i)):
                for level in tree[:-1]:
                    first = at // fanout * fanout
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + fanout])
                    node, beside, at = H(left + node + right), beside + left + right, at // fanout
            out.append((r[0], trees[g][0][k], trees[g][-1][0], root, H(beside), node, node == root))
    return sorted(map(str, out))


def rows_of(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


@pytest.mark.parametrize("fanout, block", [(2, 8), (3, 10), (5, 1000)])
def test_given_table(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", block)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = merkle.dataset_manifest(docs, fanout).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows_of(docs), fanout)
    assert 0 < sum(not r.verified for r in got) < len(got)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEAVES", 2)
    monkeypatch.setattr(merkle, "ROUNDS_A_TABLE", 1)
    rows = [(i, "s", "hot", 5, "x") for i in range(21)] + [(3, "s", "hot", 5, "x")] * 4 + [(3, None, "hot", 5, "y"), (None, "s", "hot", 1, "z")]
    rows += [(50, None, None, None, None), (51, "ü", "", 0, ""), (52, "s", "zz", 9, "ß" * 200_000), (56, "s", "zz", None, "-")]
    schema = "doc_id long, source string, lang string, n_chars long, text string, pos int, grp int, leaf string, id int, part int, n int"
    docs = spark.createDataFrame([(*r, 1, 2, "l", 3, 4, 5) for r in rows], schema)
    got = merkle.dataset_manifest(docs.repartition(5)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)
    for n in (0, 1):
        assert sorted(str(tuple(r)) for r in merkle.dataset_manifest(docs.limit(n)).collect()) == (brute(rows_of(docs.limit(n))) if n else [])


def test_every_block_learns_its_upper_proof(spark):
    for count in (1, 2, 3, 5, 9, 17):
        names = [H(str(i)) for i in range(count)]
        blocks = spark.createDataFrame([("g", i, count, h) for i, h in enumerate(names)], "grp string, block long, total long, root string")
        got = merkle.butterfly(blocks, 2).collect()
        root = levels(names, 2)[-1][0]
        assert sorted(r.block for r in got) == list(range(count)) and {r.root for r in got} == {root}
        assert all(merkle.fold(names[r.block], [(s.left, s.right) for s in r.steps]) == root for r in got)
