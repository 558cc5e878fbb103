"""Package delivery: checksums, verification, split plans, admission."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as dl
from .inputs import table
from .registry import query


def package_files(spark, sf):
    return table(spark, sf, "documents").selectExpr("source AS package", "concat('layers/', doc_id, '.txt') AS path", "encode(text, 'UTF-8') AS content", "doc_id", "text")


@query("d01_package_checksums", "SELECT source AS package, concat('layers/', CAST(doc_id AS STRING), '.txt') AS path, concat(sha256(text), '  layers/', CAST(doc_id AS STRING), '.txt') AS line FROM documents")
def d01(spark, sf):
    return dl.checksums(package_files(spark, sf)).select("package", "path", "line")


def verified(spark, sf):
    f = package_files(spark, sf)
    listed = dl.checksums(f.filter("package NOT LIKE '%0'"))
    copy = f.filter("doc_id % 70 <> 0").withColumn("content", F.expr("if(doc_id % 50 = 0, encode(concat(text, '!'), 'UTF-8'), content)"))
    return f, dl.verify(listed, dl.checksums(copy))


@query("j12_checksum_verification", """SELECT source AS package, concat('layers/', CAST(doc_id AS STRING), '.txt') AS path, CASE WHEN doc_id%70=0 THEN 'missing' WHEN doc_id%50=0 THEN 'checksum mismatch' ELSE 'ok' END AS state FROM documents WHERE source NOT LIKE '%0'""")
def j12(spark, sf):
    return verified(spark, sf)[1]


@query("j12_verification_summary", """SELECT source AS package, count(*) FILTER (source NOT LIKE '%0' AND doc_id%70<>0 AND doc_id%50<>0) AS ok, count(*) FILTER (source NOT LIKE '%0' AND doc_id%70=0) AS missing, count(*) FILTER (source NOT LIKE '%0' AND doc_id%70<>0 AND doc_id%50=0) AS mismatched, source LIKE '%0' AS list_missing FROM documents GROUP BY 1""")
def j12b(spark, sf):
    f, checked = verified(spark, sf)
    return dl.verify_summary(f, checked)


@query("d03_split_plan", """
WITH p AS (SELECT source AS package, sum(n_chars)*20000 AS size, 52428800 AS pb FROM documents GROUP BY 1), n AS (SELECT *, greatest(1, (size+pb-1)//pb) AS k FROM p), x AS (SELECT *, unnest(range(1, CAST(k AS BIGINT)+1)) AS part FROM n)
SELECT package, part, concat(package, '.', lpad(CAST(part AS STRING), greatest(3, length(CAST(CAST(k AS BIGINT) AS STRING)))::INT, '0')) AS name, CAST((part-1)*pb AS BIGINT) AS "offset", CAST(least(pb, size-(part-1)*pb) AS BIGINT) AS length FROM x""")
def d03(spark, sf):
    p = table(spark, sf, "documents").groupBy(F.col("source").alias("package")).agg((F.sum("n_chars") * 20000).alias("size")).withColumn("part_bytes", F.lit(50 << 20).cast("long"))
    return dl.split_plan(p).select("package", "part", "name", "offset", "length")


@query("d03_part_size_check", "SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN 'not a whole number' WHEN p_size*2<50 THEN 'below 50 MB' END AS reason FROM part")
def d03b(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", "if(p_partkey % 5 = 0, 'big', string(p_size * 2)) AS part_mb")
    return p.selectExpr("p_partkey", dl.part_size_error("part_mb") + " AS reason")


@query("d04_part_checksums", """
WITH t AS (SELECT CAST(doc_id AS STRING) AS package, hex(encode(text)) AS h, strlen(text) AS n FROM documents), p AS (SELECT *, unnest(range(1, greatest(1, (n+999)//1000)+1)) AS part FROM t)
SELECT package, part, sha256(unhex(substring(h, (part-1)*2000+1, 2000))) AS sha256 FROM p UNION ALL SELECT package, 0, sha256(unhex(h)) FROM t""")
def d04(spark, sf):
    f = package_files(spark, sf).selectExpr("string(doc_id) AS package", "content")
    return dl.content_part_checksums(f, 1000)


_DEL = """d AS (SELECT o_orderkey AS delivery_id, o_custkey AS job_id, CASE WHEN o_orderkey%4=0 THEN 'export' ELSE 'split' END AS type, CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'F' THEN 'running' ELSE 'failed' END AS status, CAST(50+50*(o_orderkey%2) AS INT) AS part_mb FROM orders)"""


def deliveries(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS delivery_id", "o_custkey AS job_id", "if(o_orderkey % 4 = 0, 'export', 'split') AS type",
                                                 "CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'F' THEN 'running' ELSE 'failed' END AS status", "int(50 + 50 * (o_orderkey % 2)) AS part_mb")


@query("d05_identical_split_reuse", f"WITH {_DEL}, f AS (SELECT l_orderkey, bool_and(l_quantity>5) AS ok FROM lineitem GROUP BY 1) SELECT job_id, delivery_id, part_mb FROM d JOIN f ON l_orderkey=delivery_id WHERE type='split' AND status='done' AND ok AND part_mb=50+50*(job_id%2)")
def d05(spark, sf):
    present = table(spark, sf, "lineitem").selectExpr("l_orderkey AS delivery_id", "l_linenumber AS file", "l_quantity > 5 AS exists")
    wanted = table(spark, sf, "customer").selectExpr("c_custkey AS job_id", "int(50 + 50 * (c_custkey % 2)) AS part_mb")
    return dl.reusable_splits(deliveries(spark, sf), present, wanted)


@query("d06_superseded_splits", f"WITH {_DEL}, n AS (SELECT job_id, max(delivery_id) AS nw FROM d WHERE type='split' GROUP BY 1) SELECT delivery_id, d.job_id, type, status FROM d LEFT JOIN n USING(job_id) WHERE nw IS NULL OR delivery_id=nw OR NOT (type='split' AND status<>'running')")
def d06(spark, sf):
    d = deliveries(spark, sf)
    new = d.filter("type = 'split'").groupBy("job_id").agg(F.max("delivery_id").alias("delivery_id"))
    return dl.drop_superseded(d, new).select("delivery_id", "job_id", "type", "status")


@query("d10_archive_admission", """
WITH m AS (SELECT l_suppkey AS archive, CASE WHEN l_partkey%700=3 THEN '/etc/x' WHEN l_partkey%700=4 THEN 'a/../b' WHEN l_partkey%700=5 THEN 'C:/x' ELSE 'a/b..c' END AS path, CAST(l_extendedprice*100 AS BIGINT) AS size, 536870912+1700000000*(1+l_suppkey%3) AS free FROM lineitem)
SELECT archive, count(*) AS n, CAST(sum(size) AS BIGINT) AS total, CASE WHEN bool_or(path IN ('/etc/x','a/../b','C:/x')) THEN 'unsafe path' WHEN count(*)>200000 THEN 'too many members' WHEN sum(size)+536870912>max(free) THEN 'not enough space' END AS reason FROM m GROUP BY 1""")
def d10(spark, sf):
    m = table(spark, sf, "lineitem").selectExpr("l_suppkey AS archive", "CASE WHEN l_partkey % 700 = 3 THEN '/etc/x' WHEN l_partkey % 700 = 4 THEN 'a/../b' WHEN l_partkey % 700 = 5 THEN 'C:/x' ELSE 'a/b..c' END AS path",
                                                "bigint(rint(l_extendedprice * 100)) AS size", "536870912L + 1700000000L * (1 + l_suppkey % 3) AS free_bytes")
    return dl.admit_archives(m)
