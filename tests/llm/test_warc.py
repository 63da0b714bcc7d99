import hashlib

import pytest

from rigspark.llm.warc import MAGIC, read_warc, warc_round_trip, write_warc

EMBEDDED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [
    (1, "http://a/", "x" * 150),
    (2, "http://b/", "x" * 150),
    (0, "http://c/\r\nWARC-Type: bad", "x" * 150),
    (3, "u", "short"),
    (4, "u", "short"),
    (5, None, None),
    (6, "u", ""),
    (7, "u", "before " + EMBEDDED + " after WARC/1.0\r\n\r\n\r\n"),
    (8, "u", EMBEDDED),
    (9, "u", "WARC/1.0\r\n" * 30),
    (10, "u", "ünï\r\n\r\n" * 40),
    (11, "u", EMBEDDED * 4000),
    (None, "u", "x" * 150),
    (1 << 60, "u", "y" * 99),
    ((1 << 60) + 1, "u", "y" * 99),
]


def brute(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same) if len(body) >= 100 and same else page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("split", ["128m", "20k"])
def test_round_trip_of_hard_payloads(spark, split, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, file int").coalesce(1)
        assert rows(warc_round_trip(pages, str(tmp_path / "w"))) == brute(ROWS)
        back = {r.page_id: bytes(r.payload).decode() for r in read_warc(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
        assert all(back[p] == (h or "") for p, _, h in ROWS if p in back) and len(back) == 12
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert rows(warc_round_trip(pages)) == want


def test_damage_and_no_rows(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two"), (3, "u", "three")], "page_id long, url string, html string").coalesce(1)
    write_warc(pages, str(tmp_path / "w"))
    [file] = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    assert data.startswith(MAGIC) and data.endswith(b"\r\n\r\n")
    second = data.index(MAGIC, 10)
    ids = lambda p: sorted(r.page_id for r in read_warc(spark, str(p)).collect())
    for name, bad, want in [("cut", data[:-6], [1, 2]), ("junk", b"junk" + data, []), ("header", data[: second + 14] + b"\x00" + data[second + 30 :], [1])]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(bad)
        assert ids(tmp_path / name) == want, name
    assert warc_round_trip(pages.limit(0)).count() == 0
    # Malformed headers of a revisit end the chain like any other unreadable header.
    both = spark.createDataFrame([(i, "u", "x" * 200) for i in (1, 2)] + [(3, "u", "end")], "page_id long, url string, html string").coalesce(1).sortWithinPartitions("page_id")
    write_warc(both, str(tmp_path / "v"))
    [file] = (tmp_path / "v").glob("part-*")
    data = file.read_bytes()
    for name, old, new in [("count", b"X-Payload-Length: 200", b"X-Payload-Length: abc"), ("huge", b"X-Payload-Length: 200", b"X-Payload-Length: " + b"9" * 40), ("digest", b"Digest: sha256:", b"Digest: sh\xff256:"), ("length", b"Content-Length: 0", b"Content-Length: \xb2")]:
        at = data.index(b"WARC-Type: revisit")
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data[:at] + data[at:].replace(old, new, 1))
        assert 1 in ids(tmp_path / name) and 2 not in ids(tmp_path / name), name
