"""WARC archives as tables of rows, and a normaliser for archives that were gzipped as one stream.

An archive is one row (archive, content): the bytes of one file of bounded size, so archives are written and read by Spark
from any store it knows. ``write_monolithic`` packs records into archives that are a single gzip member each, as careless
tools do. ``normalise`` inflates each such stream once, piece by piece, writes every record as a gzip member of its own and
lists (archive, offset, length, uri, type, digest) of each in a sidecar index. ``read_members`` then inflates just the member an
index row points to.

Nulls: a null html is an empty payload, a null url an empty target. Empty payloads are records too. Equal payloads of at least
``least`` bytes are one response (that of the largest id) and revisits without a block; rows with a null id revisit it too, and are responses only
if none of the rows has an id. Rows that share the largest id are all responses. Ids of any size come back exactly. A truncated or damaged archive raises in ``normalise``; an empty one has no records.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import sha1
from uuid import NAMESPACE_URL, uuid5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.classes import small
from sparkraster.llm.common import table
from sparkraster.session import cut_lineage

LEAST, ARCHIVE_BYTES, PIECE = 1000, 8 << 20, 1 << 16
ARCHIVES = "archive string, content binary"
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, uri string, payload_digest string, refers_to string"


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest and refers_to (the response's page_id for revisits) of every page."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    slim = p.filter(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    twice = cut_lineage(slim.filter("n > 1 and kept is not null").select("digest", "kept"), "repeated-payloads")
    p = p.join(small(twice), "digest", "left")
    return p.withColumn("refers_to", F.when(~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))).drop("kept")


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    uri, kind = url or "", "response" if refers_to is None else "revisit"
    rid = lambda k: f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{k}')}>"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid(page_id)}\r\nWARC-Target-URI: {re.sub(r'[\r\n]', ' ', uri)}\r\n"
            f"WARC-Date: {datetime.fromtimestamp(0, timezone.utc):%Y-%m-%dT%H:%M:%SZ}\r\nX-Page-ID: {'' if page_id is None else page_id}\r\n"
            f"X-Payload-Length: {len(payload)}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {rid(refers_to)}\r\nX-Refers-To-Page: {refers_to}\r\n"
                    "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if refers_to is None else http
    return f"{''.join(head)}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]) if k}


def write_monolithic(decided: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of one gzip member each, closed once they hold ``archive_bytes`` or more of records."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, z, out, size = None, None, [], 0
        for b in batches:
            for r in b.itertuples(index=False):
                if z is None:
                    name, z, out, size = f"pages-{uuid5(NAMESPACE_URL, f'{r.page_id}:{r.url}')}.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31), [], 0
                raw = record_bytes(r.page_id, r.url, bytes(r.payload), r.digest, r.refers_to)
                out.append(z.compress(raw))
                size += len(raw)
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [name], "content": [b"".join(out) + z.flush()]})
                    z = None
        if z is not None:
            yield pd.DataFrame({"archive": [name], "content": [b"".join(out) + z.flush()]})
    # Ids travel as text: pandas would turn whole numbers beside nulls into floats.
    return decided.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string")).mapInPandas(pack, ARCHIVES)


def inflate_records(content: bytes) -> Iterator[bytes]:
    """The raw records of a gzip stream of any number of members, inflated once; holds a record and a piece at most."""
    buf, at, z = bytearray(), 0, zlib.decompressobj(31)
    need = None

    def whole() -> Iterator[bytes]:
        nonlocal need
        while True:
            if need is None:
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    return
                need = end + 4 + int(parse_head(bytes(buf[:end]))["content-length"]) + 4
            if len(buf) < need:
                return
            yield bytes(buf[:need])
            del buf[:need]
            need = None

    while at < len(content) or z.unconsumed_tail:
        piece = z.unconsumed_tail or content[at:at + PIECE]
        at += 0 if z.unconsumed_tail else len(piece)
        buf += z.decompress(piece, 1 << 20)
        yield from whole()
        if z.eof:
            at -= len(z.unused_data)
            z = zlib.decompressobj(31)
            while at < len(content) and content[at] == 0:  # padding between members
                at += 1
    buf += z.flush()
    yield from whole()
    if buf:
        raise ValueError(f"{len(buf)} bytes after the last whole record")


def normalise(archives: DataFrame) -> DataFrame:
    """A row for each archive: archive, content with a gzip member for each record, and index, an array of sidecar rows."""
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.archive, b.content):
                out, index, at = [], [], 0
                for raw in inflate_records(bytes(content)):
                    h = parse_head(raw[:raw.find(b"\r\n\r\n")])
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    m = z.compress(raw) + z.flush()
                    index.append({"archive": name, "offset": at, "length": len(m), "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "uri": h.get("warc-target-uri"),
                                  "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": h.get("warc-refers-to")})
                    out.append(m)
                    at += len(m)
                yield pd.DataFrame({"archive": [name], "content": [b"".join(out)], "index": [index]})
    return archives.mapInPandas(one, f"{ARCHIVES}, index array<struct<{INDEX.replace(' ', ':').replace(',:', ',')}>>")


def sidecar(normalised: DataFrame) -> DataFrame:
    return normalised.select(F.explode("index").alias("i")).select("i.*")


def read_members(normalised: DataFrame) -> DataFrame:
    """Reads every record back through its index row: the member's bytes alone are inflated and its block is hashed anew.

    Index rows stay beside their archive's content, so no bytes are shuffled.
    """
    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content, index in zip(b.content, b["index"]):
                rows = []
                for i in index:
                    raw = zlib.decompress(content[i["offset"]:i["offset"] + i["length"]], 31)
                    end = raw.find(b"\r\n\r\n")
                    h, block = parse_head(raw[:end]), raw[end + 4:-4]
                    if len(block) != int(h["content-length"]):
                        raise ValueError(f"record {h.get('warc-record-id')} has {len(block)} bytes")
                    body = block[block.find(b"\r\n\r\n") + 4:]
                    full = h["warc-type"] == "response"
                    rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], len(body) if full else int(h["x-payload-length"]),
                                 sha1(body).hexdigest() if full else h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None))
                cols = dict(zip(["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"], map(list, zip(*rows)))) if rows else {}
                if cols:
                    yield pd.DataFrame(cols | {k: pd.array(cols[k], "Int64") for k in ("page_id", "refers_to")})
    return normalised.mapInPandas(one, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op10_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut_lineage(write_monolithic(decide(table(spark, sf_dir, "pages"))), "warc-monolithic")
    normal = cut_lineage(normalise(archives), "warc-members")
    return read_members(normal).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
k AS (SELECT s, max(page_id) AS kept FROM d WHERE n >= 1000 GROUP BY s)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
       CASE WHEN k.kept IS NULL OR k.kept = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.kept IS DISTINCT FROM d.page_id THEN k.kept END AS refers_to
FROM d LEFT JOIN k ON d.s = k.s
"""
