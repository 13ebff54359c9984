import hashlib

import pytest

from bandscape.llm import warc


def record(kind, page, body, extra=""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = hashlib.sha1(body).hexdigest()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: sha1:{digest}\r\n{extra}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_magic_inside_payloads_is_rejected(spark, tmp_path):
    trap = record("response", 99, b"inner")
    bodies = [b"a", trap, b"x" + trap + trap, b"WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"", b"\xff\x00" * 9]
    for f in range(3):
        (tmp_path / f"f{f}.warc").write_bytes(b"".join(record("response", i + 10 * f, b) for i, b in enumerate(bodies)))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "cut.warc").write_bytes(record("response", 50, b"z") + record("response", 51, b"long one")[:-9])
    assert warc.candidates(spark, str(tmp_path)).filter("page_id = '99'").count() == 9
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted(
        [(i + 10 * f, len(b)) for f in range(3) for i, b in enumerate(bodies)] + [(50, 1)])
    assert all(r.verified for r in got)


def slow(rows):
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[sha(html)] = max(page, last.get(sha(html), page))
    out = []
    for page, _, html in rows:
        size, orig = len((html or "").encode()), last.get(sha(html))
        again = size >= 1000 and orig is not None and (page is None or page < orig)
        out.append((page, size, sha(html), "revisit" if again else "response", orig if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("records", [4000, 3])
def test_round_trip(spark, tmp_path, records):
    long = "é" * 600
    rows = [(i, f"http://x/{i}", long) for i in range(9)] + [(20, None, None), (21, "u r\nl", ""), (22, "u", "short"), (23, "u", "short"),
            (30, "u", "WARC/1.0\r\n\r\n" * 200), (31, "u", "WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 90), (8, "u", long),
            (None, "u", long), (40, "u", "b" * 999), (41, "u", "b" * 999), (50, "u", "z" * 1000), (51, "u", "z" * 1000), (52, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, at int, digest string")
    warc.write_archives(pages, f"{tmp_path}/out", records=records)
    got = warc.read_archives(spark, f"{tmp_path}/out").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == slow(rows)
    assert all(r.verified for r in got)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_chain(spark):
    rows = [("f", i, i + 1) for i in range(700)] + [("f", 5000, 3), ("g", 1, 2), ("g", 2, 3)]
    got = warc.reachable(spark.createDataFrame(rows, "file string, at long, next long")).collect()
    assert sorted(r.at for r in got) == list(range(700)) and {r.file for r in got} == {"f"}
