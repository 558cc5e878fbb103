"""Learned speeds, streams and the decoder hook."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import ingest, progress, speeds
from .inputs import STEPS, ctes, derived, r6, table
from .q_sources import _SCAN, library_items
from .registry import query

_EWMA = ctes("samples") + """,
a AS (SELECT key, amount/seconds AS v, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS r, count(*) OVER (PARTITION BY key) AS n, ts FROM samples WHERE seconds>0.05 AND amount>0),
st AS (SELECT key, sum(CASE WHEN r=n THEN pow(0.7::DOUBLE,n-1) ELSE 0.3::DOUBLE*pow(0.7::DOUBLE,r-1) END*v) AS value, count(*) AS n, max(ts) AS updated FROM a GROUP BY 1)"""


@query("t01_t02_learned_speeds", _EWMA + " SELECT key, round(value,3) AS value, n, updated FROM st")
def t01(spark, sf):
    return speeds.fold(speeds.admit(derived(spark, sf, "samples"))).select("key", r6("value", "value", 3), "n", "updated")


@query("t02_file_sample_admission", ctes("samples") + " SELECT seq, round(amount/seconds,3) AS value FROM samples WHERE seconds>0.05 AND amount>=1048576")
def t02(spark, sf):
    return speeds.admit(derived(spark, sf, "samples"), file_samples=True).select("seq", r6("value", "value", 3))


@query("t03_rate_lookup", _EWMA + """,
w AS (SELECT DISTINCT concat(CASE s_suppkey%4 WHEN 0 THEN 'bytes:host' WHEN 1 THEN 'tiles:t' WHEN 2 THEN 'chunks:c' ELSE 'other:o' END, CAST(s_suppkey%24 AS STRING)) AS key FROM supplier), c AS (SELECT max(updated) - INTERVAL 1 HOUR AS t FROM st)
SELECT key, round(coalesce(value, CASE split_part(key,':',1) WHEN 'bytes' THEN 1e6 WHEN 'chunks' THEN 2.0::DOUBLE/60 WHEN 'tiles' THEN 10.0 WHEN 'tilebytes' THEN 25000.0 ELSE 1.0 END),3) AS rate, CASE WHEN updated>=c.t THEN 'measured' ELSE 'default' END AS basis FROM w LEFT JOIN st USING(key), c""")
def t03(spark, sf):
    state = speeds.fold(speeds.admit(derived(spark, sf, "samples")))
    wanted = table(spark, sf, "supplier").selectExpr("concat(CASE s_suppkey % 4 WHEN 0 THEN 'bytes:host' WHEN 1 THEN 'tiles:t' WHEN 2 THEN 'chunks:c' ELSE 'other:o' END, s_suppkey % 24) AS key").distinct()
    start = speeds.admit(derived(spark, sf, "samples")).agg(F.max("ts") - F.expr("interval 1 hour")).scalar()
    return speeds.rates(wanted, state, start).select("key", r6("rate", "rate", 3), "basis")


def events_as_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def event_stream(spark, sf, name):
    """A derived input of the events table, read as a stream of files."""
    df = events_as_stream(spark, sf)
    for cols in STEPS[name][1]:
        df = df.select(*[F.expr(e).alias(c) for c, e in cols.items()])
    return df


@query("t01_learned_speeds_stream", _EWMA + " SELECT key, round(value,3) AS value, n FROM st")
def t01s(spark, sf):
    out, ck = shared_dir(spark, "speeds"), shared_dir(spark, "speeds-ck")
    q = speeds.learn_stream(event_stream(spark, sf, "samples"), out, ck)
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return spark.read.parquet(f"{out}/v{last}").select("key", r6("value", "value", 3), "n")


_PROG = ctes("progress") + """, l AS (SELECT job_id, tile, arg_max(frac, {'a': ts, 'b': seq}) AS f, max(n_tiles) AS n FROM progress WHERE frac IS NOT NULL GROUP BY 1,2)
SELECT job_id, round(sum(f)/max(n),9) AS progress, count(*) AS reported FROM l GROUP BY 1"""


@query("t04_progress_fan_in", _PROG)
def t04(spark, sf):
    return progress.overall(progress.latest_fractions(derived(spark, sf, "progress"))).select("job_id", r6("progress", "progress", 9), "reported")


@query("t04_progress_fan_in_stream", _PROG)
def t04s(spark, sf):
    out, ck = shared_dir(spark, "progress"), shared_dir(spark, "progress-ck")
    progress.fan_in_stream(event_stream(spark, sf, "progress"), out, ck).awaitTermination()
    return progress.overall(progress.current(spark.read.parquet(out))).select("job_id", r6("progress", "progress", 9), "reported")


@query("t06_stall_alert_stream", "SELECT user_id AS job_id, epoch_us(max(ts))//1000 AS last_ms FROM events GROUP BY 1 HAVING arg_max(event_type, {'a': ts, 'b': event_id})<>'purchase' AND epoch_us(max(ts))//1000+120000 <= (SELECT epoch_us(max(ts))//1000 FROM events)")
def t06(spark, sf):
    ev = events_as_stream(spark, sf).selectExpr("user_id AS job_id", "ts", "event_id AS seq", "if(event_type = 'purchase', 'done', 'running') AS status")
    out, ck = shared_dir(spark, "stalls"), shared_dir(spark, "stalls-ck")
    progress.alert_stream(ev, out, ck).awaitTermination()
    return spark.read.schema("job_id bigint, last_ms bigint").parquet(out)


@query("t10_library_ingest_stream")
def t10(spark, sf):
    out, ck = shared_dir(spark, "library"), shared_dir(spark, "library-ck")
    ingest.ingest_stream(ingest.file_stream(spark, sf, "*.parquet"), out, ck).awaitTermination()
    return ingest.library_items(spark, out).selectExpr("element_at(split(path, '/'), -1) AS name", "length")


def rescanned(spark, sf):
    """Two passes over a library: index files and a quarter of the files arrive late, a sixth change, a ninth go."""
    files = derived(spark, sf, "files").withColumn("modificationTime", F.expr("timestamp_seconds(doc_id)"))
    first = files.filter("doc_id % 4 <> 1 AND name NOT IN ('A.TOC', 'TOC.xml')")
    second = files.filter("doc_id % 9 <> 0").withColumn("length", F.expr("if(doc_id % 6 = 0, length + 7, length)"))
    stored = ingest.rescan(first, None, lambda f: f.withColumn("pass", F.lit(1)))
    return ingest.rescan(second, stored, lambda f: f.withColumn("pass", F.lit(2)))


@query("t10_library_rescan", ctes("files") + """ SELECT path, length+CASE WHEN doc_id%6=0 THEN 7 ELSE 0 END AS length,
 CASE WHEN doc_id%4<>1 AND name NOT IN ('A.TOC','TOC.xml') AND doc_id%6<>0 THEN 1 ELSE 2 END AS pass FROM files WHERE doc_id%9<>0""")
def t10r(spark, sf):
    return rescanned(spark, sf).select("path", "length", "pass")


@query("t10_library_rescan_products", _SCAN.replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id%9<>0)") + "SELECT path, product, product_id, kind FROM keyed")
def t10p(spark, sf):
    return library_items(spark, sf, rescanned(spark, sf)).select("path", "product", "product_id", "kind")


def raw_decoder(data: bytes) -> dict:
    """Plain bytes as one band of 64 columns, the last row padded with zeros."""
    height = max(1, math.ceil(len(data) / 64))
    band = np.zeros(64 * height, np.float32)
    band[:len(data)] = np.frombuffer(data, np.uint8)
    return {"width": 64, "height": height, "dtype": "uint8", "bands": [band]}


@query("x03_decoder_hook", """
SELECT doc_id, 64 AS width, CAST(greatest(1,(strlen(text)+63)//64) AS INT) AS height,
 CAST(list_sum(list_transform(regexp_extract_all(hex(encode(text)),'..'), lambda x: ('0x'||x)::INT)) AS DOUBLE) AS total FROM documents""")
def x03(spark, sf):
    f = table(spark, sf, "documents").selectExpr("doc_id", "encode(text, 'UTF-8') AS content")
    return ingest.decode(f, raw_decoder, "doc_id").selectExpr("doc_id", "width", "height", "aggregate(bands[0], 0D, (s, v) -> s + v) AS total")
