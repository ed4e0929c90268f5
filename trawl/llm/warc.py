"""Conversion of legacy ARC archives to WARC records."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import table

SOFTWARE = "trawl"
#: Bytes of blocks after which records are sent on.
SENT_BYTES = 1 << 26
FIELDS_V1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_SCHEMA = [
    ("record_no", "int"), ("arc_version", "int"), ("offset", "bigint"), ("warc_type", "string"), ("record_id", "string"), ("warc_date", "string"),
    ("target_uri", "string"), ("ip_address", "string"), ("content_type", "string"), ("content_length", "bigint"), ("block_digest", "string"),
    ("payload_digest", "string"), ("http_status", "int"), ("error", "string"), ("header", "string"), ("block", "binary"),
]
_NEWLINE = re.compile(b"\n")
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _date(stamp: str) -> str | None:
    """YYYYMMDDhhmmss, or its first digits from the year on, as an ISO date; longer ones have their fraction dropped."""
    if not re.fullmatch(r"\d{4,}", stamp):
        return None
    s = stamp[:14]
    s += "00000101000000"[len(s) :] if len(s) % 2 == 0 and len(s) >= 4 else ""
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z" if len(s) == 14 else None


def _uuid(text: str) -> str:
    h = hashlib.md5(text.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-3{h[13:16]}-8{h[17:20]}-{h[20:]}>"


def gunzip(data: bytes | memoryview) -> tuple[bytes, str | None]:
    """All members of a gzip file, one after the other; what could be read, and what went wrong."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            return b"".join(out), "damaged gzip member"
        if not member.eof:
            return b"".join(out), "gzip member ends early"
        data = member.unused_data
    return b"".join(out), None


def convert(name: str, data: bytes) -> list[dict]:
    """The WARC records of one ARC file, in order; never raises. See records()."""
    return list(parse(name, data))


def parse(name: str, data: bytes | memoryview) -> Iterator[dict]:
    """What convert() lists, made one by one: of a view (of unsigned bytes) only the block at hand is copied."""
    data, error = gunzip(data) if data[:2] == b"\x1f\x8b" else (data, None)
    no, at, version, archive_date = 0, 0, 1, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        ends = _NEWLINE.search(data, at)
        end = ends.start() if ends else -1
        line = bytes(data[at : end if end >= 0 else len(data)]).rstrip(b"\r").decode("utf-8", "replace")
        fields = line.split(" ")
        is_head = line.startswith("filedesc:")
        if is_head:
            version = 2 if end >= 0 and data[end + 1 : end + 3] == b"2 " else 1
        # what follows the URL is counted from the right: URLs may hold spaces; version blocks of version 2 are met with both lines
        n = 4 if version == 1 or (is_head and not (len(fields) > 9 and re.fullmatch(r"\d{4,}", fields[-8]))) else 9
        if end < 0 or len(fields) < n + 1 or not re.fullmatch(r"\d{1,18}", fields[-1]):
            error = error or f"bad header line at {at}"
            break
        url, (ip, stamp, kind) = " ".join(fields[:-n]), fields[-n : len(fields) - n + 3]
        length, start = int(fields[-1]), end + 1
        block = bytes(data[start : start + length])
        problem = None if len(block) == length else "truncated"
        result = fields[-6] if n == 9 else None
        date = _date(stamp)
        if is_head:
            head = block.split(b"\n", 2)
            first = head[0].decode("utf-8", "replace").split(" ")
            archive_date = date
            said = head[1].decode("utf-8", "replace").strip() if len(head) > 1 else ""
            block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC/{version}\r\norigin: {first[2] if len(first) > 2 else ''}\r\nfields: {said}\r\n".encode()
            warc_type, kind, payload, url, result = "warcinfo", "application/warc-fields", None, url.removeprefix("filedesc://"), None
        elif url.startswith("dns:"):
            warc_type, kind, payload = "response", "text/dns", block
        elif block[:5] == b"HTTP/" and url.lower().startswith(("http:", "https:")):
            cut = block.find(b"\r\n\r\n")
            skip = 4
            if cut < 0:
                cut, skip = block.find(b"\n\n"), 2
            payload = block[cut + skip :] if cut >= 0 else b""
            said = re.match(rb"HTTP/\d(?:\.\d)? +(\d{3})\b", block)
            result = said[1].decode() if said else result
            warc_type, kind = "response", "application/http; msgtype=response"
        else:
            warc_type, payload = "resource", block
        if date is None:
            problem = problem or "bad date"
            date = archive_date or "1970-01-01T00:00:00Z"
        digest = sha1(block)
        ident = _uuid(f"{name}|{at}|{url}|{date}|{digest}")
        lines = ["WARC/1.0", f"WARC-Type: {warc_type}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}"]
        lines += [f"WARC-Filename: {url}"] if is_head else [f"WARC-Target-URI: {url}"]
        lines += [f"WARC-IP-Address: {ip}"] if not is_head and ip not in ("", "0.0.0.0", "-") else []
        lines += [f"WARC-Block-Digest: {digest}"]
        lines += [f"WARC-Payload-Digest: {sha1(payload)}"] if payload is not None else []
        lines += ["WARC-Truncated: unspecified"] if problem == "truncated" else []
        lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
        yield {
            "record_no": no, "arc_version": version, "offset": at, "warc_type": warc_type, "record_id": ident, "warc_date": date, "target_uri": url,
            "ip_address": None if is_head or ip in ("", "0.0.0.0", "-") else ip, "content_type": kind, "content_length": len(block), "block_digest": digest,
            "payload_digest": None if payload is None else sha1(payload), "http_status": int(result) if result and re.fullmatch(r"\d{3}", result) else None,
            "error": problem, "header": "\r\n".join(lines) + "\r\n\r\n", "block": block,
        }
        no, at = no + 1, start + length
    if error:
        yield {"record_no": no, "arc_version": version, "offset": at, "error": error}


def records(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per WARC record of the ARC files in content (binary), with their key.

    An ARC file starts with a version block, whose first number says how URL lines are laid out, its own too: five fields in
    version 1, ten in version 2 (a version block of version 2 under a line of five fields is read as well). Each line declares the length of the block after it, to which the parser jumps; blank lines
    between records are skipped. Files may be plain or gzip, with a member for each record. Without a version block the lines
    are taken as version 1.

    The version block becomes a warcinfo record, lookups and HTTP answers become responses, everything else a resource. Dates of 14
    digits become ISO dates; a missing or bad one becomes the archive's and is named in error. Digests are SHA-1 in base 32, of
    the block and, for HTTP, of what follows its headers. Identifiers are made from the archive's key, the offset, URI, date and digest,
    so a second conversion makes the same ones. header + block + CRLF CRLF is the record as it stands in a WARC file.

    A block shorter than declared is kept, marked as truncated; a line that can't be read ends its archive with a row that has
    only record_no, arc_version, offset and error. Null or empty content gives no rows; a null key is taken as an empty name;
    repeated rows are converted each; other columns are ignored; an empty table gives an empty table.
    """
    own = archives.where(F.col(content).isNotNull()).select(F.col(key).alias("__key"), F.col(content).cast("binary").alias("__content"))
    kind = own.schema["__key"].dataType.simpleString()

    def out(batch, at, rows):
        cols = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in _SCHEMA]
        return pa.RecordBatch.from_arrays(cols, [key, *(n for n, _ in _SCHEMA)])

    def run(batches):
        for batch in batches:
            at, rows, held = [], [], 0
            for i, (name, data) in enumerate(zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1))):
                for r in parse(name or "", memoryview(data.as_buffer()).cast("B")):
                    at.append(i)
                    rows.append(r)
                    held += len(r.get("block") or b"")
                    if held > SENT_BYTES:  # what is sent at once stays small
                        sent = out(batch, at, rows)
                        at, rows, held = [], [], 0
                        yield sent
                        del sent
            yield out(batch, at, rows)

    return own.mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} {t}" for n, t in _SCHEMA)]))


def read_archives(spark, path: str) -> DataFrame:
    """(path, content) of the files under path, for records(); a file is one row, so at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arc_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, content): for each page an ARC file with its version block, the lookup of its host, and the page as an HTTP answer.

    Pages with odd ids are in version 2. Dates and addresses follow from the id.
    """
    i, text = F.col("page_id"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    size = lambda c: F.octet_length(c).cast("string")
    url, html = F.coalesce("url", F.lit("about:blank")), F.coalesce("html", F.lit(""))
    n = lambda k, m: F.lpad(F.pmod(i, F.lit(m)).cast("string"), k, "0")
    own = pages.select(
        i.alias("page_id"), url.alias("u"), F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1).alias("host"), (F.pmod(i, F.lit(2)) == 1).alias("v2"),
        text("20080430", n(2, 24), n(2, 60), n(2, 60)).alias("d"), text("192.0.2.", F.pmod(i, F.lit(250)).cast("string")).alias("ip"),
        text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", size(html), "\r\n\r\n", html).alias("http"),
    )
    head = F.when(F.col("v2"), f"2 0 {SOFTWARE}\n{FIELDS_V2}\n\n").otherwise(f"1 0 {SOFTWARE}\n{FIELDS_V1}\n\n")
    name = text("pages-", F.col("page_id").cast("string"), ".arc")
    dns = text(F.col("d"), "\n", F.col("host"), ".\t3600\tIN\tA\t", F.col("ip"), "\n")

    def line(uri: Column, mime: str, status: str, body: Column) -> Column:
        v1 = text(uri, " ", F.col("ip"), " ", F.col("d"), f" {mime} ", size(body), "\n")
        v2 = text(uri, " ", F.col("ip"), " ", F.col("d"), f" {mime} {status} - - 0 ", name, " ", size(body), "\n")
        return F.when(F.col("v2"), v2).otherwise(v1)

    said = F.when(F.col("v2"), text("200 - - 0 ", name, " ")).otherwise("")
    first = text("filedesc://", name, " 0.0.0.0 ", F.col("d"), " text/plain ", said, size(head), "\n", head, "\n")
    second = text(line(text("dns:", F.col("host")), "text/dns", "001", dns), dns, "\n")
    third = text(line(F.col("u"), "text/html", "200", F.col("http")), F.col("http"), "\n")
    return own.select("page_id", text(first, second, third).cast("binary").alias("content"))


def query(spark, sf_dir):
    found = records(arc_of_pages(table(spark, sf_dir, "pages")), key="page_id")
    return found.withColumn("block", F.decode("block", "UTF-8"))


def _b32(value: str) -> str:
    return f"""('sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1({value}), 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), ''))"""


_ID = "'<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-3' || m[14:16] || '-8' || m[18:20] || '-' || m[21:32] || '>'"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, 'about:blank') AS u, regexp_extract(coalesce(url, 'about:blank'), '^[a-z]+://([^/:?#]+)', 1) AS host, 1 + page_id % 2 AS v,
                  '20080430' || lpad((page_id % 24)::VARCHAR, 2, '0') || lpad((page_id % 60)::VARCHAR, 2, '0') || lpad((page_id % 60)::VARCHAR, 2, '0') AS d,
                  '192.0.2.' || (page_id % 250) AS ip, coalesce(html, '') AS html, 'pages-' || page_id || '.arc' AS name FROM pages),
q AS (SELECT *, CASE v WHEN 2 THEN '2 0 {SOFTWARE}' || chr(10) || '{FIELDS_V2}' || chr(10) || chr(10) ELSE '1 0 {SOFTWARE}' || chr(10) || '{FIELDS_V1}' || chr(10) || chr(10) END AS head,
             d || chr(10) || host || '.' || chr(9) || '3600' || chr(9) || 'IN' || chr(9) || 'A' || chr(9) || ip || chr(10) AS dns,
             'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html AS http FROM p),
r AS (SELECT *, 'filedesc://' || name || ' 0.0.0.0 ' || d || ' text/plain ' || CASE v WHEN 2 THEN '200 - - 0 ' || name || ' ' ELSE '' END || octet_length(encode(head)) || chr(10) || head || chr(10) AS one,
             'dns:' || host || ' ' || ip || ' ' || d || ' text/dns ' || CASE v WHEN 2 THEN '001 - - 0 ' || name || ' ' ELSE '' END || octet_length(encode(dns)) || chr(10) || dns || chr(10) AS two FROM q),
x AS (
  SELECT page_id, 0 AS record_no, v, 0 AS pos, 'warcinfo' AS warc_type, name AS uri, NULL AS ip, 'application/warc-fields' AS kind, d, NULL AS payload, NULL::INT AS status,
         'software: {SOFTWARE}' || chr(13) || chr(10) || 'format: WARC File Format 1.0' || chr(13) || chr(10) || 'converted-from: ARC/' || v || chr(13) || chr(10) || 'origin: {SOFTWARE}' || chr(13) || chr(10) || 'fields: ' || CASE v WHEN 2 THEN '{FIELDS_V2}' ELSE '{FIELDS_V1}' END || chr(13) || chr(10) AS block FROM r
  UNION ALL SELECT page_id, 1, v, octet_length(encode(one)), 'response', 'dns:' || host, ip, 'text/dns', d, dns, CASE v WHEN 2 THEN 1 END, dns FROM r
  UNION ALL SELECT page_id, 2, v, octet_length(encode(one)) + octet_length(encode(two)), 'response', u, ip, 'application/http; msgtype=response', d, html, 200, http FROM r),
y AS (SELECT *, d[1:4] || '-' || d[5:6] || '-' || d[7:8] || 'T' || d[9:10] || ':' || d[11:12] || ':' || d[13:14] || 'Z' AS warc_date, {_b32("block")} AS bd, {_b32("payload")} AS pd FROM x),
z AS (SELECT *, md5(page_id || '|' || pos || '|' || uri || '|' || warc_date || '|' || bd) AS m FROM y)
SELECT page_id, record_no::INT AS record_no, v::INT AS arc_version, pos::BIGINT AS "offset", warc_type, {_ID} AS record_id, warc_date, uri AS target_uri, ip AS ip_address, kind AS content_type,
       octet_length(encode(block))::BIGINT AS content_length, bd AS block_digest, pd AS payload_digest, status AS http_status, NULL::VARCHAR AS error,
       'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: ' || warc_type || chr(13) || chr(10) || 'WARC-Record-ID: ' || {_ID} || chr(13) || chr(10) || 'WARC-Date: ' || warc_date || chr(13) || chr(10)
       || CASE record_no WHEN 0 THEN 'WARC-Filename: ' ELSE 'WARC-Target-URI: ' END || uri || chr(13) || chr(10) || coalesce('WARC-IP-Address: ' || ip || chr(13) || chr(10), '')
       || 'WARC-Block-Digest: ' || bd || chr(13) || chr(10) || coalesce('WARC-Payload-Digest: ' || pd || chr(13) || chr(10), '')
       || 'Content-Type: ' || kind || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(block)) || chr(13) || chr(10) || chr(13) || chr(10) AS header, block
FROM z
"""
