import base64
import gzip
import hashlib
import tracemalloc

import pyarrow as pa

from trawl.llm import warc


def b32(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()


def arc(version, items, tail=b"\n"):
    """Records as (line without length, block); returns the parts, the version block first."""
    fields = warc.FIELDS_V1 if version == 1 else warc.FIELDS_V2
    body = f"{version} 0 me\n{fields}\n\n<xml/>".encode()
    said = "" if version == 1 else "200 - - 0 f.arc "
    out = [f"filedesc://f.arc 0.0.0.0 20010203040506 text/plain {said}{len(body)}\n".encode() + body + tail]
    return out + [f"{line} {len(block)}\n".encode() + block + tail for line, block in items]


HTTP = b"HTTP/1.0 404 Not Found\r\nA: b\r\n\r\n\x00\xffbody\n\nhttp://not/a 1.1.1.1 record"


def test_versions_and_gzip():
    v1 = [("http://a/b c?d 1.2.3.4 20010203040507 text/html", HTTP), ("dns:a 1.2.3.4 20010203040508 text/dns", b"x"), ("ftp://f/ 0.0.0.0 20010203040509 image/png", b""), ("http://a/ 1.2.3.4 200102030405 text/html", b"<html>")]
    v2 = [("http://a/b c?d 1.2.3.4 20010203040507 text/html 301 abc - 77 f.arc", HTTP), ("ftp://f/ 0.0.0.0 20010203040509 image/png 226 - - 9 f.arc", b"img")]
    for version, items in ((1, v1), (2, v2)):
        parts = arc(version, items)
        plain = warc.convert("n", b"".join(parts))
        assert plain == warc.convert("n", b"".join(map(gzip.compress, parts))) == warc.convert("n", gzip.compress(b"".join(parts)))
        assert [r["error"] for r in plain] == [None] * len(parts) and {r["arc_version"] for r in plain} == {version}
        http = plain[1]
        assert (http["warc_type"], http["target_uri"], http["http_status"], http["warc_date"]) == ("response", "http://a/b c?d", 404, "2001-02-03T04:05:07Z")
        assert http["block"] == HTTP and http["block_digest"] == b32(HTTP) and http["payload_digest"] == b32(HTTP.split(b"\r\n\r\n", 1)[1])
        for r, p in zip(plain, parts):
            assert b"".join(parts)[r["offset"] :].startswith(p[:20])
            head = dict(x.split(": ", 1) for x in r["header"].strip().split("\r\n")[1:])
            assert head["WARC-Type"] == r["warc_type"] and int(head["Content-Length"]) == len(r["block"]) and head["WARC-Record-ID"] == r["record_id"]
        assert len({r["record_id"] for r in plain}) == len(plain)
    assert [r["warc_type"] for r in warc.convert("n", b"".join(arc(1, v1)))] == ["warcinfo", "response", "response", "resource", "resource"]
    assert warc.convert("n", b"".join(arc(1, v1)))[4]["warc_date"] == "2001-02-03T04:05:00Z"


def test_version_block_lines():
    for version in (1, 2):
        first = warc.convert("n", arc(version, [])[0])[0]
        assert (first["target_uri"], first["warc_date"], first["error"], first["arc_version"], first["http_status"]) == ("f.arc", "2001-02-03T04:05:06Z", None, version, None)
    five = arc(2, [])[0].replace(b"200 - - 0 f.arc ", b"")
    assert warc.convert("n", five)[0]["arc_version"] == 2 and warc.convert("n", five)[0]["error"] is None
    # a record with a bad date takes the archive's
    parts = arc(2, [("http://a/ 1.2.3.4 soon text/html 200 - - 9 f.arc", b"x")])
    assert warc.convert("n", b"".join(parts))[1]["warc_date"] == "2001-02-03T04:05:06Z"


def test_sent_in_pieces(spark, monkeypatch):
    parts = arc(1, [(f"http://a/{k} 1.2.3.4 20010203040507 text/html", b"z" * 1000) for k in range(50)])
    df = spark.createDataFrame([("a", b"".join(parts)), ("b", b"".join(parts))], "path string, content binary")
    want = sorted((r.path, r.record_no, r.record_id) for r in warc.records(df).collect())
    monkeypatch.setattr(warc, "SENT_BYTES", 1500)
    assert sorted((r.path, r.record_no, r.record_id) for r in warc.records(df).collect()) == want and len(want) == 102


def test_large_archive_is_not_held(spark, monkeypatch):
    one = b"".join(arc(1, [(f"http://a/{k} 1.2.3.4 20010203040507 text/html", b"z" * 1_000_000) for k in range(40)]))
    df = spark.createDataFrame([("a", one[:0])], "path string, content binary")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    monkeypatch.setattr(warc, "SENT_BYTES", 2_000_000)
    run, batch = warc.records(df), pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([one])], ["path", "content"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 41 and peak < len(one) / 2  # a few of its blocks


def test_bad_input():
    cut = b"".join(arc(1, [("http://a/ 1.2.3.4 20010203040507 text/html", b"0123456789")]))[:-5]
    last = warc.convert("n", cut)[-1]
    assert last["error"] == "truncated" and last["block"] == b"012345" and "WARC-Truncated" in last["header"]
    bad = warc.convert("n", b"".join(arc(1, [("http://a/ 1.2.3.4 yesterday text/html", b"0"), ("nonsense", b"")])))
    assert bad[1]["error"] == "bad date" and bad[1]["warc_date"] == "2001-02-03T04:05:06Z"
    assert bad[2]["error"].startswith("bad header") and "block" not in bad[2]
    assert warc.convert("n", b"") == [] and warc.convert("n", b"\n\n") == []
    assert warc.convert("n", b"\x1f\x8bxx")[0]["error"] and warc.convert("n", gzip.compress(cut)[:-9])[-1]["error"]


def test_table(spark):
    one = b"".join(arc(1, [("http://a/ 1.2.3.4 20010203040507 text/html", b"y" * 3_000_000)]))
    df = spark.createDataFrame([("a", one, "x"), ("a", one, "x"), ("b", None, "x"), (None, one, "x"), ("c", b"", "x")], "path string, content binary, warc_type string")
    got = warc.records(df).collect()
    assert sorted(str(r.path) for r in got) == ["None", "None", "a", "a", "a", "a"]
    assert {len(r.block) for r in got if r.record_no == 1} == {3_000_000}
    assert warc.records(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.arc.gz").write_bytes(b"".join(map(gzip.compress, arc(k, []))))
    assert sorted(r.arc_version for r in warc.records(warc.read_archives(spark, str(tmp_path))).collect()) == [1, 2]


def test_sql(same_as_sql):
    assert same_as_sql(warc.query, warc.SQL) > 0
