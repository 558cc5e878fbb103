"""Job results, logs, retries, naming and validation."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import jobs as jb
from ..operators import resample as rs
from ..operators.spatial_join import rect_join
from ..session import cut_lineage, shuffled
from ..sources import registry, xyz
from .inputs import ELEV_CTE, ctes, derived, elevation_chips, r6, spread, table
from .q_sources import SRC_CTE
from .registry import query

_TILES = """t AS (SELECT l_orderkey AS layer, l_linenumber*1000000000000+l_partkey*100000+l_suppkey AS tile,
 CASE WHEN l_returnflag='A' THEN 'ok' WHEN l_linestatus='F' THEN 'failed' ELSE 'empty' END AS status, concat('part ',CAST(l_partkey AS STRING),' failed') AS message, l_quantity AS size_mb, 10+l_linenumber AS res_m FROM lineitem)"""


def tile_results(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS layer", "l_linenumber * 1000000000000L + l_partkey * 100000L + l_suppkey AS tile",
        "CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_linestatus = 'F' THEN 'failed' ELSE 'empty' END AS status", "concat('part ', l_partkey, ' failed') AS message",
        "l_quantity AS size_mb", "10 + l_linenumber AS res_m", "array(concat('f', l_partkey, '.tif'), concat('f', l_partkey, '.tfw')) AS files")


_MERGED = f"""WITH {_TILES},
g AS (SELECT layer, count(*) AS n, count(*) FILTER (status='ok') AS n_ok, count(*) FILTER (status='failed') AS nf, arg_min(message, tile) FILTER (status='failed') AS fm, arg_min(res_m, tile) FILTER (status='ok') AS res_m, sum(size_mb) FILTER (status='ok') AS mb FROM t GROUP BY 1),
m AS (SELECT layer, n, n_ok, CASE WHEN n_ok>0 THEN 'ok' WHEN nf>0 THEN 'failed' ELSE 'empty' END AS status, CASE WHEN n_ok>0 THEN NULL WHEN nf>0 THEN fm ELSE 'no data in area' END AS message, res_m, CAST(round_even(round(mb,6),2) AS DOUBLE) AS size_mb,
 CASE WHEN n_ok>0 THEN concat(CAST(n_ok AS STRING),' of ',CAST(n AS STRING),CASE WHEN n=1 THEN ' tile' ELSE ' tiles' END,' built',CASE WHEN n_ok<n THEN concat(', ',CAST(n-n_ok AS STRING),' failed') ELSE '' END) END AS summary FROM g)"""


@query("a16_tile_results_merge", _MERGED + " SELECT layer, n, n_ok, status, message, res_m, size_mb, summary FROM m")
def a16(spark, sf):
    return jb.merge_tiles(tile_results(spark, sf), "layer")


@query("a16_merged_files", f"WITH {_TILES} SELECT layer, tile, CAST(pos AS INT) AS pos, concat('tile_', CAST(tile AS STRING), '/f', CAST((tile//100000)%10000000 AS STRING), CASE WHEN pos=0 THEN '.tif' ELSE '.tfw' END) AS file FROM t, range(2) r(pos) WHERE status='ok'")
def a16b(spark, sf):
    return jb.merged_files(tile_results(spark, sf), "layer")


_SMALL = "SELECT l_orderkey%40 AS layer, l_partkey%130 AS tile, 'f'||CAST(l_suppkey AS STRING)||'.tif' AS f FROM lineitem WHERE l_returnflag='A'"


@query("a16_merged_files_numbers", f"SELECT layer, tile, 0 AS pos, 'tile_'||CASE WHEN tile<10 THEN '0' ELSE '' END||CAST(tile AS STRING)||'/'||f AS file FROM ({_SMALL})")
def a16c(spark, sf):
    """Tile numbers of one, two and three digits."""
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey % 40 AS layer", "l_partkey % 130 AS tile", "if(l_returnflag = 'A', 'ok', 'failed') AS status", "array(concat('f', l_suppkey, '.tif')) AS files")
    return jb.merged_files(t, "layer")


@query("a17_job_status", _MERGED + """, j AS (SELECT layer//4 AS job, count(*) FILTER (status='ok') AS o, count(*) FILTER (status='failed') AS f FROM m GROUP BY 1)
SELECT job, CASE WHEN o>0 AND f=0 THEN 'done' WHEN o>0 THEN 'partial' ELSE 'failed' END AS status, CASE WHEN o>0 THEN concat(CAST(o AS STRING),' layer(s) ready',CASE WHEN f>0 THEN concat(', ',CAST(f AS STRING),' failed') ELSE '' END) ELSE 'no layers produced' END AS message FROM j""")
def a17(spark, sf):
    layers = jb.merge_tiles(tile_results(spark, sf), "layer").selectExpr("layer div 4 AS job", "status")
    return jb.job_status(layers, "job")


@query("a15_input_summary", """
WITH d AS (SELECT DISTINCT l_suppkey, concat('part ', CAST(l_partkey%(5+l_suppkey%30) AS STRING)) AS label FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY label) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM d)
SELECT l_suppkey, any_value(n) AS n_labels, concat(string_agg(label, '; ' ORDER BY label) FILTER (n<=12 OR rn<=10), CASE WHEN any_value(n)>12 THEN concat('; … and ', CAST(any_value(n)-10 AS STRING), ' more') ELSE '' END) AS inputs FROM r GROUP BY 1""")
def a15(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_suppkey", "concat('part ', l_partkey % (5 + l_suppkey % 30)) AS label")
    return jb.input_summary(li, "l_suppkey", "label")


@query("a19_unconverted_summary", """
WITH f AS (SELECT source, n_chars/1e3 AS mb, doc_id%9=0 OR lang='fr' AND source='web' AS sk FROM documents), g AS (SELECT source, count(*) FILTER (NOT sk) AS n, count(*) FILTER (sk) AS s, sum(CASE WHEN sk THEN 0 ELSE mb END) AS mb FROM f GROUP BY 1)
SELECT source, CASE WHEN n>0 THEN 'ok' ELSE 'empty' END AS status, n AS n_files, s AS n_skipped, CAST(round_even(round(mb,6),2) AS DOUBLE) AS size_mb, CASE WHEN n>0 THEN concat(CAST(n AS STRING),' file(s) exactly as published',CASE WHEN s>0 THEN concat(' (',CAST(s AS STRING),' input(s) had nothing inside the area)') ELSE '' END) END AS summary FROM g""")
def a19(spark, sf):
    f = table(spark, sf, "documents").selectExpr("source", "n_chars / 1e3D AS size_mb", "doc_id % 9 = 0 OR (lang = 'fr' AND source = 'web') AS skipped")
    return jb.unconverted_summary(f, "source", "exactly as published")


@query("r21_unconverted_layers", ctes("aoi") + ", " + ELEV_CTE + """,
k AS (SELECT o.aoi_id, least(8,ceil((o.east-c.c)/a))-greatest(0,floor((o.west-c.c)/a)) AS w, least(8,ceil((o.south-f)/e))-greatest(0,floor((o.north-f)/e)) AS h FROM aoi o JOIN elev c ON NOT (c.east<=o.west OR c.west>=o.east OR c.north<=o.south OR c.south>=o.north)),
g AS (SELECT aoi_id, count(*) FILTER (w*h>=6) AS n, count(*) FILTER (w*h<6) AS s, sum(CASE WHEN w*h>=6 THEN w*h*4/1e3 ELSE 0 END) AS mb FROM k WHERE w>=1 AND h>=1 GROUP BY 1)
SELECT aoi_id, CASE WHEN n>0 THEN 'ok' ELSE 'empty' END AS status, n AS n_files, s AS n_skipped, CAST(round_even(round(mb,6),2) AS DOUBLE) AS size_mb,
 CASE WHEN n>0 THEN concat(CAST(n AS STRING),' file(s) cut to the area',CASE WHEN s>0 THEN concat(' (',CAST(s AS STRING),' input(s) had nothing inside the area)') ELSE '' END) END AS summary FROM g""")
def r21(spark, sf):
    chips = elevation_chips(spark, sf).withColumnRenamed("bbox", "item_bbox").drop("z", "layer", "item_ord")
    areas = derived(spark, sf, "aoi").select("aoi_id", F.col("bbox").alias("aoi_bbox"))
    # Areas of equal boxes get equal files, so these are cut and summed up once, as box ``box``.
    boxes = cut_lineage(areas.select("aoi_bbox").distinct().withColumn("box", F.monotonically_increasing_id()), "boxes")
    win = rs.clip_window(rect_join(spread(boxes), chips, "aoi_bbox", "item_bbox")).selectExpr("box", "(c1 - c0) * (r1 - r0) AS n")
    files = win.selectExpr("box", "n * 4 / 1e3D AS size_mb", "n < 6 AS skipped")
    sums = jb.unconverted_summary(files, "box", "cut to the area").join(boxes, "box").drop("box")
    return areas.join(shuffled(sums), "aoi_bbox").drop("aoi_bbox")


@query("w03_layer_order", ctes("requests") + " SELECT aoi_id, job_id, row_number() OVER (PARTITION BY aoi_id ORDER BY res_m DESC, job_id) AS position FROM requests WHERE res_m>0")
def w03(spark, sf):
    r = derived(spark, sf, "requests").selectExpr("aoi_id", "job_id", "res_m", "if(res_m > 0, 'ok', 'failed') AS status")
    return jb.layer_order(r, "aoi_id", "res_m", "job_id").select("aoi_id", "job_id", F.col("position").cast("long").alias("position"))


@query("w05_keep_newest", """SELECT user_id%20 AS source, event_id, row_number() OVER (PARTITION BY user_id%20 ORDER BY ts DESC, event_id DESC)<=5 AS keep FROM events""")
def w05(spark, sf):
    f = table(spark, sf, "events").selectExpr("user_id % 20 AS source", "event_id", "ts AS mtime")
    return xyz.keep_newest(f, ["source"], [F.col("mtime").desc(), F.col("event_id").desc()], "event_id").select("source", "event_id", "keep")


@query("w06_log_compaction", ctes("progress") + """,
e AS (SELECT *, lag(msg) OVER (PARTITION BY job_id ORDER BY ts, seq) AS pm FROM progress WHERE frac IS NULL OR frac IN (0,1)),
k AS (SELECT job_id, seq, msg, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM e WHERE pm IS NULL OR pm<>msg) SELECT job_id, seq, msg FROM k WHERE rn<=200""")
def w06(spark, sf):
    return jb.compact_log(derived(spark, sf, "progress"), "job_id").select("job_id", "seq", "msg")


@query("w07_collision_free_names", """
WITH f AS (SELECT p_size%10 AS folder, p_partkey AS ord, concat(p_brand, CASE WHEN p_partkey%17=0 THEN ' (2)' WHEN p_partkey%31=0 THEN ' (4)' ELSE '' END, '.tif.gz') AS name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY ord) AS rn FROM f),
l AS (SELECT DISTINCT folder, regexp_replace(name,' \\(\\d+\\)','') AS name, CAST(regexp_extract(name,' \\((\\d+)\\)',1) AS BIGINT) AS j FROM f WHERE name LIKE '% (%'),
g AS (SELECT folder, name, list_sort(list(j)) AS taken FROM l GROUP BY 1,2),
n AS (SELECT r.*, CASE WHEN taken IS NULL THEN rn ELSE list_reduce(list_prepend(rn, taken), lambda n, t: CASE WHEN t<=n THEN n+1 ELSE n END) END AS num FROM r LEFT JOIN g USING(folder, name))
SELECT folder, ord, name, CASE WHEN rn=1 THEN name ELSE concat(regexp_extract(name,'^([^.]*)',1),' (',CAST(num AS STRING),').tif.gz') END AS unique_name FROM n""")
def w07(spark, sf):
    f = table(spark, sf, "part").selectExpr("p_size % 10 AS folder", "p_partkey AS ord", "concat(p_brand, CASE WHEN p_partkey % 17 = 0 THEN ' (2)' WHEN p_partkey % 31 = 0 THEN ' (4)' ELSE '' END, '.tif.gz') AS name")
    return jb.unique_names(f, "folder", "name", "ord").select("folder", "ord", "name", "unique_name")


def job_states(progress):
    """Half of the jobs have ended, by rule."""
    return progress.select("job_id").distinct().selectExpr("job_id", "CASE job_id % 4 WHEN 0 THEN 'done' WHEN 3 THEN 'failed' ELSE 'running' END AS status")


@query("w09_job_eta", ctes("progress") + """,
e AS (SELECT job_id, arg_min({'ts': ts, 'p': frac}, {'a': ts, 'b': seq}) AS a, arg_max({'ts': ts, 'p': frac}, {'a': ts, 'b': seq}) AS b FROM progress WHERE frac IS NOT NULL GROUP BY 1),
s AS (SELECT job_id, job_id%4 IN (1,2) AS live, (CASE WHEN job_id%4 IN (1,2) THEN (SELECT epoch_us(max(ts)) FROM progress) ELSE epoch_us(b.ts) END-epoch_us(a.ts))/1e6 AS run, a.p AS p0, b.p AS p FROM e) SELECT job_id, round(run,3) AS run_s, round(CASE WHEN live AND run>5 AND p>p0 THEN (1-p)*run/(p-p0) END,3) AS eta_s FROM s""")
def w09(spark, sf):
    p = derived(spark, sf, "progress")
    return jb.timing(p, job_states(p), "job_id", p.agg(F.max("ts")).scalar()).select("job_id", r6("run_s", "run_s", 3), r6("eta_s", "eta_s", 3))


@query("w10_stalled_jobs", ctes("progress") + ", n AS (SELECT max(ts) AS t FROM progress) SELECT job_id, round((epoch_us(any_value(t))-epoch_us(max(ts)))/1e6,3) AS age_s, job_id%4 IN (1,2) AND (epoch_us(any_value(t))-epoch_us(max(ts)))/1e6>=120 AS stalled FROM progress, n GROUP BY 1")
def w10(spark, sf):
    p = derived(spark, sf, "progress")
    return jb.stalled(p, job_states(p), "job_id", p.agg(F.max("ts")).scalar()).select("job_id", r6("age_s", "age_s", 3), "stalled")


@query("w11_monotonic_progress", ctes("progress") + " SELECT job_id, tile, seq, frac, lag(frac) OVER w AS prev_frac, coalesce(frac < lag(frac) OVER w, false) AS backwards FROM progress WHERE frac IS NOT NULL WINDOW w AS (PARTITION BY job_id, tile ORDER BY ts, seq)")
def w11(spark, sf):
    return jb.progress_steps(derived(spark, sf, "progress"), ["job_id", "tile"]).select("job_id", "tile", "seq", "frac", "prev_frac", "backwards")


@query("u05_first_wins", "SELECT p_size%7 AS layer, p_brand AS file, min(p_partkey) AS ord, arg_min(p_name, p_partkey) AS item FROM part GROUP BY 1,2")
def u05(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_size % 7 AS layer", "p_brand AS file", "p_partkey AS ord", "p_name AS item")
    return jb.first_wins(rows, ["layer", "file"], "ord", "item")


@query("u07_copied_trees", "SELECT DISTINCT l_suppkey%50 AS layer, concat('/lib/', CAST(l_partkey%30 AS STRING)) AS tree FROM lineitem")
def u07(spark, sf):
    return jb.trees_to_copy(table(spark, sf, "lineitem").selectExpr("l_suppkey % 50 AS layer", "concat('/lib/', l_partkey % 30) AS tree"), "layer", "tree")


@query("p06_job_validation", f"""WITH {SRC_CTE},
l AS (SELECT l_orderkey AS job_id, l_linenumber*1000000000000+l_partkey*100000+l_suppkey AS ord, CAST(l_partkey%60 AS INT) AS sn, l_quantity-2 AS res FROM lineitem),
f AS (SELECT job_id, sn, min(ord) AS fo FROM l GROUP BY 1,2),
c AS (SELECT l.job_id, l.ord, CASE WHEN source_id IS NULL THEN concat('unknown source ',CAST(l.sn AS STRING)) WHEN l.ord>fo THEN concat(source_id,' selected twice') WHEN NOT res>0 THEN concat(source_id,': resolution not positive') END AS why FROM l JOIN f ON f.job_id=l.job_id AND f.sn=l.sn LEFT JOIN src ON src.source_no=l.sn),
b AS (SELECT job_id, arg_min(why, ord) FILTER (why IS NOT NULL) AS why FROM c GROUP BY 1)
SELECT o_orderkey AS job_id, CASE WHEN b.job_id IS NULL THEN 'no layer' WHEN why IS NOT NULL THEN why WHEN o_orderstatus='P' THEN 'unknown mode' WHEN o_orderstatus='O' AND o_orderkey%4=0 THEN 'no output format' END AS reason FROM orders LEFT JOIN b ON b.job_id=o_orderkey""")
def p06(spark, sf):
    layers = table(spark, sf, "lineitem").selectExpr("l_orderkey AS job_id", "l_linenumber * 1000000000000L + l_partkey * 100000L + l_suppkey AS ord", "int(l_partkey % 60) AS source_no", "l_quantity - 2 AS res_m")
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS job_id", "CASE o_orderstatus WHEN 'O' THEN 'mosaic' WHEN 'F' THEN 'clipped' ELSE 'bundle' END AS mode", "int(o_orderkey % 4) AS formats")
    return jb.validate(o, layers, registry.sources(spark))


# Sample messages of the error triage.
_MSGS = ["HTTP 504", "server error 500 ", "over the pixel limit", "No data from x intersects the area", "SSL handshake", "403 Forbidden", "could not resolve host", "no space left", "odd", "Recv failure: reset"]


@query("p14_p15_error_triage", """SELECT event_id, CASE event_id%10 WHEN 0 THEN 'server timed out' WHEN 1 THEN 'server error' WHEN 2 THEN 'too much detail' WHEN 3 THEN 'no data in area' WHEN 4 THEN 'secure connection failed' WHEN 5 THEN 'access refused' WHEN 6 THEN 'server unreachable' WHEN 7 THEN 'disk full' END AS class, event_id%10 IN (4,9) AS transient FROM events""")
def p14(spark, sf):
    msg = F.element_at(F.array(*map(F.lit, _MSGS)), (F.col("event_id") % 10 + 1).cast("int"))
    df = table(spark, sf, "events").select("event_id", msg.alias("m"))
    return df.select("event_id", text.error_class(F.col("m")).alias("class"), text.is_transient(F.array(F.lit("read failed"), F.col("m"))).alias("transient"))


@query("p16_p17_fetch_outcomes", """
WITH r AS (SELECT event_id, CASE event_id%9 WHEN 0 THEN NULL WHEN 1 THEN 204 WHEN 2 THEN 404 WHEN 3 THEN 401 WHEN 4 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN 400 ELSE 200 END AS st, event_id%4 AS nb, CASE event_id%5 WHEN 0 THEN '' WHEN 1 THEN '90' WHEN 2 THEN 'soon' ELSE '7' END AS ra, 1+event_id%3 AS att FROM events)
SELECT event_id, CASE WHEN st IS NULL THEN 'retry' WHEN st=200 AND nb>0 THEN 'tile' WHEN st IN (204,404,200) THEN 'empty' WHEN st IN (401,403) THEN 'abort' WHEN st=429 THEN 'slow down' ELSE 'retry' END AS tile,
 CASE WHEN st=429 THEN least(60.0::DOUBLE, CASE WHEN ra='' THEN 5.0 ELSE TRY_CAST(ra AS DOUBLE) END) END AS wait_s, CASE WHEN st IS NULL OR st>=500 THEN CASE WHEN att<3 THEN 'retry' ELSE 'split' END WHEN st>=400 THEN 'error' WHEN event_id%2=0 OR event_id%7=0 THEN 'ok' ELSE 'error' END AS export FROM r""")
def p16(spark, sf):
    df = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 204 WHEN 2 THEN 404 WHEN 3 THEN 401 WHEN 4 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN 400 ELSE 200 END AS st", "event_id % 4 AS nb",
        "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '90' WHEN 2 THEN 'soon' ELSE '7' END AS ra", "1 + event_id % 3 AS att", "if(event_id % 2 = 0, 'image/tiff', 'text/html') AS ct", "if(event_id % 7 = 0, '49492A00', '3C68746D') AS head")
    return df.select("event_id", text.tile_outcome(F.col("st"), F.col("nb")).alias("tile"), text.slow_down_seconds(F.col("st"), F.col("ra")).alias("wait_s"),
                     text.export_outcome(F.col("st"), F.col("ct"), F.col("head"), F.col("att")).alias("export"))


@query("t08_retry_ladder", """
WITH a AS (SELECT event_id//6 AS request_id, CASE (event_id//6)%3 WHEN 0 THEN 'read' WHEN 1 THEN 'tile' ELSE 'export' END AS kind, CAST(event_id%6+1 AS INT) AS attempt, ts, CASE WHEN event_id%6=5 THEN 'tile' ELSE 'retry' END AS outcome FROM events),
w AS (SELECT *, CASE WHEN outcome='retry' THEN CASE kind WHEN 'read' THEN [2,5,15,30] WHEN 'tile' THEN [1,3,8,20] ELSE [5,15] END[attempt] END AS wait_s FROM a)
SELECT request_id, kind, attempt, outcome, wait_s, outcome='retry' AND wait_s IS NULL AS gave_up, ts + to_seconds(wait_s) AS next_at FROM w""")
def t08(spark, sf):
    a = table(spark, sf, "events").selectExpr("event_id div 6 AS request_id", "CASE (event_id div 6) % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'tile' ELSE 'export' END AS kind", "int(event_id % 6 + 1) AS attempt", "ts",
                                              "if(event_id % 6 = 5, 'tile', 'retry') AS outcome")
    return jb.retry_plan(a)


@query("t09_interrupted_recovery", "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'done' ELSE 'failed' END AS new_status, CASE WHEN o_orderstatus<>'O' THEN 'interrupted' END AS note FROM orders")
def t09(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey AS job_id", "CASE o_orderstatus WHEN 'O' THEN 'done' WHEN 'F' THEN 'running' ELSE 'queued' END AS status")
    return jb.recover_interrupted(o).select("job_id", "new_status", "note")


@query("j11_prior_results", """WITH w AS (SELECT o_orderkey AS layer, unnest(range(1,8)) AS tile FROM orders), d AS (SELECT DISTINCT l_orderkey AS layer, l_linenumber AS tile FROM lineitem WHERE l_returnflag='A' OR l_linestatus<>'F')
SELECT layer, CAST(tile AS INT) AS tile FROM w ANTI JOIN d USING(layer, tile)""")
def j11(spark, sf):
    wanted = table(spark, sf, "orders").selectExpr("o_orderkey AS layer", "explode(sequence(1, 7)) AS tile")
    done = table(spark, sf, "lineitem").selectExpr("l_orderkey AS layer", "l_linenumber AS tile", "CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_linestatus = 'F' THEN 'failed' ELSE 'empty' END AS status")
    return jb.unfinished(wanted, done, ["layer", "tile"])


@query("s36_manifest", """
SELECT o_orderkey AS job, 0::BIGINT AS line, CAST(json_object('name', concat('job ', CAST(o_orderkey AS STRING)), 'created', strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ'), 'mode', o_orderstatus, 'layers', coalesce(n,0)) AS STRING) AS body FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey
UNION ALL SELECT l_orderkey, l_linenumber*1000000000000+l_partkey*100000+l_suppkey, CAST(json_object('source', concat('s', CAST(l_suppkey AS STRING)), 'status', l_returnflag, 'files', l_linenumber) AS STRING) FROM lineitem""")
def s36(spark, sf):
    jobs = table(spark, sf, "orders").selectExpr("o_orderkey AS job", "concat('job ', o_orderkey) AS name", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS created", "o_orderstatus AS mode")
    layers = table(spark, sf, "lineitem").selectExpr("l_orderkey AS job", "l_linenumber * 1000000000000L + l_partkey * 100000L + l_suppkey AS ord", "concat('s', l_suppkey) AS source", "l_returnflag AS status", "l_linenumber AS files")
    return jb.manifest(jobs, layers, "job")
