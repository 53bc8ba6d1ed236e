import base64
import hashlib

import pytest

from corpusloom.llm import archives

SCHEMA = "page_id long, url string, html string, record_type string, payload int"
ROWS = [
    (1, "http://a/ b%20", "<p>x</p>", "t", 1), (2, None, "<p>x</p>", "t", 1), (3, "http://c/", None, "t", 1), (4, "http://d/", "", "t", 1),
    (5, "http://e/ü\n", "line\r\n\r\nWARC/1.1\r\n\r\n\nhttp://x 1 2 3 4\n", "t", 1), (None, "http://f/", "<p>x</p>", "t", 1),
    (None, "u", "alone", "t", 1), (7, "http://g/", "ü" * 50_000 + "\n" * 9, "t", 1), (1, "http://a/", "<p>x</p>", "t", 1), (9, "u", "\n", "t", 1),
]


def brute(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        ids = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        first = min(ids, default=None)
        again = len(body) >= least and first is not None and page != first
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, least):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = archives.archive_pages(frame, min_bytes=least)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(ROWS, least)
    assert archives.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_and_headers(spark):
    frame = spark.createDataFrame(ROWS[2:], SCHEMA).coalesce(1)
    warc = archives.arc_to_warc(spark, archives.write_arc(frame))
    got = {r.page_id: r for r in archives.read_warc(spark, warc).collect() if r.page_id is not None}
    for page, url, html, *_ in ROWS[2:]:
        if page is not None and got[page].record_type == "response":
            assert bytes(got[page].payload).decode() == (html or "") and got[page].target_uri == url
    assert got[5].date == "2001-01-01T00:00:00Z" and len({r.record_id for r in got.values()}) == len(got)


def parse(*files):
    lines = [(f"f{i}", line) for i, data in enumerate(files) for line in data.split(b"\n")]
    return list(archives.parse_arc(archives.Lines(iter(lines))))


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions(version):
    data = b"\n".join([archives.arc_version_record(version), archives.arc_record(version, 5, b"http://h/", b"a\n\nb"), archives.arc_record(version, -6, b"http://i/", b"")])
    got = parse(data + b"\n", data)
    assert [(r[0], r[1], r[6]) for r in got] == [(5, "http://h/", b"a\n\nb"), (-6, "http://i/", b"")] * 2


def test_old_header_lines():
    head = b"filedesc://x 0.0.0.0 19960923142103 text/plain 26\n1 0 Org\nURL IP date type n\n"[: 50 + 26]
    got = parse(b"http://a/ 1.2.3.4 1996 text/html; charset=x 5\nhello\n")
    assert got[0][3:5] == ("1996", "text/html; charset=x") and got[0][6] == b"hello" and head
    assert archives.warc_date("1996") == "1996-01-01T00:00:00Z" and archives.warc_date("?") == "1970-01-01T00:00:00Z"
    with pytest.raises(ValueError, match="bytes before"):
        parse(b"http://a/ 1.2.3.4 1996 text/html 50\nhello\n")
    with pytest.raises(ValueError, match="header line"):
        parse(b"what is this\n")
