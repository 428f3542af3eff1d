import hashlib
import random

from graphloom.llm import warc_segments as w

SCHEMA = "page_id bigint, url string, html string, payload string"


def test_framing():
    rng = random.Random(1)
    for n in (0, 1, 8191, 8192, 8193, 30_000):
        body = rng.randbytes(n)
        assert w.unframe(w.frame(body)) == (body, True)
    assert w.unframe(b"5\r\nab") == (b"ab", False) and w.unframe(b"zz\r\n") == (b"", False)
    assert w.unframe(b"2;x=1\r\nab\r\n0\r\n\r\n") == (b"ab", True)


def test_malformed_framing_ends():
    for size in (b"-6", b"+2", b"0x2", b"2_0", b" ", b"", b"g", b"9" * 40):
        assert w.unframe(b"2\r\nab\r\n" + size + b"\r\n0\r\n\r\n") == (b"ab", False)


def test_malformed_records_are_rows(spark, tmp_path):
    good = w.record("resource", "good", b"abc", WARC_Payload_Digest="sha256:" + hashlib.sha256(b"abc").hexdigest()) + b"\r\n\r\n"
    bad = {
        "no number": b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: x3\r\n\r\nabc\r\n\r\n",
        "negative": b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: -3\r\n\r\nabc\r\n\r\n",
        "absent": b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\n\r\nabc\r\n\r\n",
        "short": b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n",
        "long": b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nContent-Length: 999999\r\n\r\nabc\r\n\r\n",
        "no origin": b"WARC/1.1\r\nWARC-Type: continuation\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
        "segment": b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Segment-Origin-ID: <o>\r\nWARC-Segment-Number: z\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
        "revisit": b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <r>\r\nWARC-Refers-To: <nowhere>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    }
    for i, data in enumerate(bad.values()):
        (tmp_path / f"{i}.warc").write_bytes(good + data + good)
    (tmp_path / "cut.warc").write_bytes(good + good[:40])
    got = w.read_archives(spark, f"file://{tmp_path}").collect()
    assert sum(r.verified for r in got) == 2 * len(bad) + 1 and sum(not r.verified for r in got) == len(bad) + 1


def test_damaged_response_shows_in_its_revisits(spark, tmp_path):
    body, digest = b"z" * 500, hashlib.sha256(b"z" * 500).hexdigest()
    one = b"".join(r + b"\r\n\r\n" for r in w.page_records("urn:page:1", "u", body, digest, None))
    two = b"".join(r + b"\r\n\r\n" for r in w.page_records("urn:page:2", "u", body, digest, "urn:page:1"))
    (tmp_path / "a.warc").write_bytes(one + two)
    got = {r.record_type: (r.payload_bytes, r.payload_digest, r.verified) for r in w.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got == {"response": (500, digest, True), "revisit": (500, digest, True)}
    (tmp_path / "a.warc").write_bytes(one.replace(b"zz", b"zy", 1) + two)
    assert [r.verified for r in w.read_archives(spark, f"file://{tmp_path}").collect()] == [False, False]


def test_records_split():
    block = b"a\r\n\r\nWARC/1.1\r\nb"
    data = b"".join(w.record("resource", f"x{i}", block, WARC_Target_URI="u:v") + b"\r\n\r\n" for i in range(3))
    assert [(h["warc-record-id"], h["warc-target-uri"], b, ok) for h, b, ok in w.split_records(data)] == [(f"<x{i}>", "u:v", block, True) for i in range(3)]


def test_round_trip(spark, tmp_path):
    long = "".join(random.Random(2).choices("ab\r\né<&", k=60_000))
    pages = [(5, "u5", "same " * 30, ""), (3, None, "same " * 30, ""), (9, "u\r\n9", "same " * 30, ""), (1, "u", "s", ""), (2, "u", "s", ""), (4, "u", None, ""), (6, "u", long, ""), (7, "u", long, ""), (8, "u", "é" * 50, ""), (8, "u", "é" * 50, ""), (None, "u", "x" * 200, ""), (10, "u", "x" * 200, "")]
    df = spark.createDataFrame(pages, SCHEMA)
    want = []
    for page, _, html, _ in pages:
        body = (html or "").encode()
        same = [p for p, _, h, _ in pages if h == html and p is not None]
        revisit = len(body) >= 100 and bool(same) and (page is None or page > min(same))
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None, True))
    key = str
    assert sorted(map(tuple, w.round_trip(df).collect()), key=key) == sorted(want, key=key)
    w.write_archives(df, f"file://{tmp_path}/a", segment=700)
    got = w.read_archives(spark, f"file://{tmp_path}/a").where("record_type = 'response'").collect()
    texts = {p: (h or "").encode() for p, _, h, _ in pages if p is not None}
    assert all(r.verified and hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in got)
    assert {bytes(r.payload) for r in got} >= {texts[6], texts[3]}
    assert w.round_trip(df.limit(0)).collect() == []


def test_missing_segment_is_reported(spark, tmp_path):
    records = [*w.page_records("urn:page:1", "u", b"z" * 5000, hashlib.sha256(b"z" * 5000).hexdigest(), None, 1000)]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records[:2] + records[3:]))
    assert [r.verified for r in w.read_archives(spark, f"file://{tmp_path}").collect()] == [False]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records[::-1]))
    assert [(r.verified, r.payload_bytes) for r in w.read_archives(spark, f"file://{tmp_path}").collect()] == [(True, 5000)]
