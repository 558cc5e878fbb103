"""Cost estimates, cells, export chunks and map tiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, tiles
from ..operators import estimate as est
from ..operators.spatial_join import rect_join
from ..session import cut_lineage, shuffled
from ..sources import cells, charts, exports, registry, xyz
from ..streaming import speeds
from .inputs import ctes, derived, r6, spread, table
from .q_joins import HIT
from .q_sources import SRC_CTE, _STAC_CTE, event_tiles_in
from .registry import query

FRAC = "(least(a.east,c.east)-greatest(a.west,c.west))*(least(a.north,c.north)-greatest(a.south,c.south))"
RATE = 1e6


def ENV(todo="todo", pct="pct", req="req", sec="sec", src="src", cut="cut"):
    return (f"CAST(round_even(round({todo},0)/1e6,1) AS DOUBLE) AS download_mb, CAST(round_even(greatest(0.0::DOUBLE,least(100.0::DOUBLE,round({pct},6))),0) AS INT) AS cached_pct, CAST({req} AS BIGINT) AS requests, "
            f"CAST(ceil(round({sec},6)) AS BIGINT) AS download_seconds, CAST(round_even(round({src},0)/1e6,1) AS DOUBLE) AS source_mb, CAST(round_even(round({cut},0)/1e6,1) AS DOUBLE) AS clipped_mb")


def areas(spark, sf):
    return spread(derived(spark, sf, "aoi").select("aoi_id", "bbox"))


def area_boxes(spark, sf):
    """box, bbox: the distinct boxes of the areas; what an estimate reads of an area is its box."""
    return spread(cut_lineage(areas(spark, sf).select("bbox").distinct().withColumn("box", F.monotonically_increasing_id()), "boxes"))


def of_areas(spark, sf, boxes, estimates):
    """The estimates of ``boxes`` for every area, as aoi_id and their columns."""
    priced = boxes.join(estimates, "box").drop("box")
    return areas(spark, sf).join(shuffled(priced), "bbox").select("aoi_id", *[c for c in priced.columns if c != "bbox"])


_CHARTS = """ch AS (SELECT *, concat('https://x/z', CAST(item_id%40 AS STRING), '.zip') AS url, CASE WHEN item_id%40%6=0 THEN NULL ELSE 1000000.0*(1+item_id%40) END AS zip_bytes, item_id%4=0 AS extracted, item_id%40%5=0 AS zip_local FROM catalog)"""


def chart_hits(spark, sf, boxes):
    """Charts that share forty archives, some cached, some of unknown size (the cache-status join)."""
    cat = derived(spark, sf, "catalog").withColumnRenamed("bbox", "item_bbox").selectExpr("item_id", "item_bbox", "size_bytes AS member_bytes", "item_id % 40 AS z")
    sizes = derived(spark, sf, "catalog").selectExpr("item_id % 40 AS z").distinct().filter("z % 6 <> 0").selectExpr("z", "1000000D * (1 + z) AS zip_bytes")
    local = derived(spark, sf, "catalog").selectExpr("item_id % 40 AS z").distinct().filter("z % 5 = 0").withColumn("zip_local", F.lit(True))
    done = derived(spark, sf, "catalog").filter("item_id % 4 = 0").select("item_id").withColumn("extracted", F.lit(True))
    state = (cat.join(sizes, "z", "left").join(local, "z", "left").join(done, "item_id", "left")
             .selectExpr("item_id", "item_bbox", "member_bytes", "zip_bytes", "coalesce(zip_local, false) AS zip_local", "coalesce(extracted, false) AS extracted",
                         "concat('https://x/z', z, '.zip') AS url"))
    return rect_join(boxes, state)


def chart_prices(spark, sf):
    b = area_boxes(spark, sf)
    return of_areas(spark, sf, b, est.envelope(est.chart_estimate(b, chart_hits(spark, sf, b), "box", RATE), ["box"]))


@query("j09_cache_status", ctes("catalog") + f", {_CHARTS} SELECT item_id, url, CAST(zip_bytes AS DOUBLE) AS zip_bytes, extracted, zip_local FROM ch")
def j09(spark, sf):
    cat = derived(spark, sf, "catalog").selectExpr("item_id", "item_id % 40 AS z")
    sizes = cat.select("z").distinct().filter("z % 6 <> 0").selectExpr("z", "1000000D * (1 + z) AS zip_bytes")
    j = charts.cache_status(cat, sizes, cat.filter("z % 5 = 0"), cat.filter("item_id % 4 = 0"), "z", "item_id")
    return j.selectExpr("item_id", "concat('https://x/z', z, '.zip') AS url", "zip_bytes", "extracted", "zip_local")


_A01 = ctes("aoi", "catalog") + f""", {_CHARTS},
h AS (SELECT a.aoi_id, url, coalesce(zip_bytes,60e6) AS zip, coalesce(CAST(size_bytes AS DOUBLE), zip_bytes, 60e6) AS mem, extracted, zip_local, {FRAC}/((c.east-c.west)*(c.north-c.south)) AS frac FROM aoi a JOIN ch c ON {HIT}),
u AS (SELECT aoi_id, url, max(zip) AS zip, max(CASE WHEN NOT extracted AND NOT zip_local THEN zip ELSE 0 END) AS get_b, max(CASE WHEN NOT extracted AND NOT zip_local THEN 1 ELSE 0 END) AS g, count(*) FILTER (NOT extracted) AS nw, sum(mem) AS mem, sum(mem*frac) AS cut FROM h GROUP BY 1,2),
t AS (SELECT aoi_id, sum(zip) AS zip, sum(get_b) AS get_b, sum(g) AS g, sum(nw) AS nw, sum(mem) AS mem, sum(cut) AS cut FROM u GROUP BY 1),
e01 AS (SELECT aoi_id, coalesce(get_b,0.0) AS todo, CASE WHEN zip IS NULL THEN 100.0 ELSE 100*(1-get_b/zip) END AS pct, g AS req, coalesce(get_b/1e6+nw*3.0,0.0) AS sec, mem AS src, cut FROM aoi LEFT JOIN t USING(aoi_id))"""


@query("a01_a09_chart_estimate", _A01 + f" SELECT aoi_id, {ENV()} FROM e01")
def a01(spark, sf):
    return chart_prices(spark, sf)


@query("a02_size_cache_merge", """
WITH k AS (SELECT p_size AS key, min(p_partkey)*10 AS size FROM part WHERE p_size%3<>0 GROUP BY 1), w AS (SELECT DISTINCT p_size AS key FROM part)
SELECT w.key, coalesce(k.size, w.key*1000) AS size FROM w LEFT JOIN k USING(key)""")
def a02(spark, sf):
    p = table(spark, sf, "part")
    known = p.filter("p_size % 3 <> 0").groupBy(F.col("p_size").alias("key")).agg((F.min("p_partkey") * 10).alias("size"))
    wanted = p.select(F.col("p_size").alias("key")).distinct()
    found = wanted.join(known, "key", "left_anti").selectExpr("key", "key * 1000L AS size")
    return est.merge_sizes(known, found, "key")


_CELLS = """cl AS (SELECT aoi_id, west, south, east, north, lat, lon FROM (SELECT *, unnest(range(CAST(floor(west) AS BIGINT), CAST(ceil(east) AS BIGINT))) AS lon FROM
 (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(ceil(north) AS BIGINT))) AS lat FROM aoi))),
pc AS (SELECT DISTINCT CAST(floor(lat) AS INT) AS lat, CAST(floor(lon) AS INT) AS lon FROM points),
sz AS (SELECT lat, lon, CASE WHEN (lat-lon)%5=0 THEN 0 ELSE 1000000*(1+(lat-lon)%30) END AS size FROM pc WHERE (lat-lon)%4<>0),
ca AS (SELECT lat, lon FROM pc WHERE (lat-lon)%3=0)"""


def dem_state(spark, sf):
    pc = derived(spark, sf, "points").selectExpr("int(floor(lat)) AS lat", "int(floor(lon)) AS lon").distinct()
    sizes = pc.filter("(lat - lon) % 4 <> 0").selectExpr("lat", "lon", "if((lat - lon) % 5 = 0, 0, 1000000 * (1 + (lat - lon) % 30)) AS size")
    cached = pc.filter("(lat - lon) % 3 = 0")
    return cells.with_state(cells.cells(areas(spark, sf)), sizes, cached)


_A03 = ctes("aoi", "points") + f""", {_CELLS},
st AS (SELECT cl.*, CAST(coalesce(size,15000000) AS DOUBLE) AS size, ca.lat IS NOT NULL AS cached, (least(east,lon+1)-greatest(west,lon))*(least(north,lat+1)-greatest(south,lat)) AS frac
 FROM cl LEFT JOIN sz USING(lat,lon) LEFT JOIN ca ON ca.lat=cl.lat AND ca.lon=cl.lon WHERE coalesce(size,15000000)>0)"""
_FRACEST = """,
nd AS (SELECT *, CASE WHEN cached OR frac>=0.25 THEN size ELSE size*frac*1.3 END AS need FROM st),
tt AS (SELECT aoi_id, count(*) AS n, sum(need) AS total, sum(CASE WHEN cached THEN 0 ELSE need END) AS todo, sum(size) AS src, sum(size*frac) AS cut, count(*) FILTER (NOT cached AND frac<0.25) AS partial FROM nd GROUP BY 1),
ef AS (SELECT aoi_id, coalesce(todo,0.0) AS todo, CASE WHEN n IS NULL THEN 100.0 ELSE 100*(1-todo/total) END AS pct, n AS req, coalesce(todo,0.0)/1e6 AS sec, coalesce(src,0.0) AS src, coalesce(cut,0.0) AS cut, coalesce(partial,0) AS partial FROM aoi LEFT JOIN tt USING(aoi_id))"""


@query("a03_cell_estimate", _A03 + _FRACEST + f" SELECT aoi_id, {ENV()}, partial FROM ef")
def a03(spark, sf):
    e = est.fraction_estimate(areas(spark, sf), dem_state(spark, sf), "aoi_id", RATE)
    return est.envelope(e, ["aoi_id", "partial"])


_RATED = """, sm AS (SELECT max(ts) - INTERVAL 1 HOUR AS t0 FROM samples WHERE seconds>0.05 AND amount>0),
sp AS (SELECT key, sum(CASE WHEN r=n THEN pow(0.7::DOUBLE,n-1) ELSE 0.3::DOUBLE*pow(0.7::DOUBLE,r-1) END*v) AS value, max(ts) AS updated FROM
 (SELECT key, amount/seconds AS v, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS r, count(*) OVER (PARTITION BY key) AS n, ts FROM samples WHERE seconds>0.05 AND amount>0) GROUP BY 1),
rt AS (SELECT aoi_id, round(coalesce(value, 1e6),3) AS rate, CASE WHEN updated>=t0 THEN 'measured' ELSE 'default' END AS speed_basis FROM aoi LEFT JOIN sp ON key=concat('bytes:host', CAST(aoi_id%26 AS STRING)), sm)"""


@query("a09_t03_rated_cell_estimate", _A03.replace(ctes("aoi", "points"), ctes("aoi", "points", "samples")) + _FRACEST + _RATED + """
 SELECT aoi_id, speed_basis, req AS requests, CAST(ceil(round(todo/rate,6)) AS BIGINT) AS download_seconds FROM ef JOIN rt USING(aoi_id)""")
def a09r(spark, sf):
    """Every area's source has its own learned rate, or the default one and its basis."""
    return est.envelope(est.fraction_estimate(rated(spark, sf, areas(spark, sf)), dem_state(spark, sf), "aoi_id", "rate"), ["aoi_id", "speed_basis"]).select("aoi_id", "speed_basis", "requests", "download_seconds")


def rated(spark, sf, a):
    """Areas with the rate learned for their host and what it is based on."""
    good = speeds.admit(derived(spark, sf, "samples"))
    a = a.withColumn("key", F.expr("concat('bytes:host', aoi_id % 26)"))
    known = speeds.rates(a.select("key").distinct(), speeds.fold(good), good.agg(F.max("ts") - F.expr("interval 1 hour")).scalar())
    return a.join(known.select("key", F.round("rate", 3).alias("rate"), F.col("basis").alias("speed_basis")), "key")


@query("s18_s19_cell_objects", ctes("aoi") + """,
n AS (SELECT *, CAST((ceil(east)-floor(west))*(ceil(north)-floor(south)) AS BIGINT) AS n FROM aoi),
c AS (SELECT aoi_id, lat, unnest(range(CAST(floor(west) AS BIGINT), CAST(ceil(east) AS BIGINT))) AS lon FROM (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(ceil(north) AS BIGINT))) AS lat FROM n))
SELECT aoi_id, CAST(lat AS INT) AS lat, CAST(lon AS INT) AS lon, 'copernicus-dem-30m/'||o||'/'||o||'.tif' AS object FROM (SELECT *, printf('Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM', CASE WHEN lat>=0 THEN 'N' ELSE 'S' END, abs(lat), CASE WHEN lon>=0 THEN 'E' ELSE 'W' END, abs(lon)) AS o FROM c)""")
def s18(spark, sf):
    c = cells.cells(areas(spark, sf))
    return c.select("aoi_id", "lat", "lon", cells.object_name(F.col("lat"), F.col("lon"), 30).alias("object"))


@query("s20_s21_cell_read_choice", _A03 + """ SELECT aoi_id, CAST(lat AS INT) AS lat, CAST(lon AS INT) AS lon, size, cached, round(frac,6) AS frac,
 CASE WHEN cached OR frac>=0.25 THEN concat('/cache/', CAST(lat AS STRING), '_', CAST(lon AS STRING)) ELSE concat('/vsicurl/', CAST(lat AS STRING), '_', CAST(lon AS STRING)) END AS path FROM st""")
def s20(spark, sf):
    name = F.concat_ws("_", "lat", "lon")
    return dem_state(spark, sf).select("aoi_id", "lat", "lon", "size", "cached", r6("frac", "frac"),
                                       cells.read_path(F.col("cached"), F.col("frac"), F.concat(F.lit("/cache/"), name), name).alias("path"))


@query("a04_event_imagery_estimate", ctes("aoi", "catalog") + _STAC_CTE + f""", st0 AS (SELECT * FROM st),
hit AS (SELECT a.aoi_id, c.s_suppkey, {FRAC}/((c.east-c.west)*(c.north-c.south)) AS frac FROM aoi a JOIN st0 c ON {HIT})""" + (_FRACEST).replace("FROM st)", """
 FROM (SELECT aoi_id, frac, CASE WHEN s_suppkey%11=0 THEN 20000000.0::DOUBLE ELSE CAST(1000000*(1+s_suppkey%25) AS DOUBLE) END AS size, s_suppkey%3=0 AS cached FROM hit))""") + f" SELECT aoi_id, {ENV()} FROM ef")
def a04(spark, sf):
    b = area_boxes(spark, sf)
    t = event_tiles_in(spark, sf, b).withColumn("k", F.regexp_extract("tile_url", r"/v(\d+)\.tif$", 1).cast("long"))
    s = table(spark, sf, "supplier")
    sizes = s.filter("s_suppkey % 11 <> 0").selectExpr("s_suppkey AS k", "double(1000000 * (1 + s_suppkey % 25)) AS size")
    cached = s.filter("s_suppkey % 3 = 0").selectExpr("s_suppkey AS k", "true AS cached")
    parts = (t.join(sizes, "k", "left").join(cached, "k", "left").withColumn("frac", geo.overlap_fraction(F.col("bbox"), F.col("tile_bbox")))
             .selectExpr("box", f"coalesce(size, {est.TYPICAL_IMAGE_BYTES}D) AS size", "frac", "coalesce(cached, false) AS cached"))
    return of_areas(spark, sf, b, est.envelope(est.fraction_estimate(b, parts, "box", RATE), ["box"]))


_CHUNKS = """ex AS (SELECT aoi_id, greatest(west,-98.0::DOUBLE) AS w0, greatest(south,31.0::DOUBLE) AS s0, least(east,-80.0::DOUBLE) AS e0, least(north,38.5::DOUBLE) AS n0 FROM aoi),
xd AS (SELECT *, (100.0::DOUBLE/111320)/greatest(cos(radians((s0+n0)/2)),0.01) AS xd, 100.0::DOUBLE/111320 AS yd FROM ex WHERE w0<e0 AND s0<n0),
rr AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((n0-s0-1e-12)/(400*yd)) AS BIGINT)))) AS r FROM xd), cc AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((e0-w0-1e-12)/(400*xd)) AS BIGINT)))) AS c FROM rr),
cb AS (SELECT *, w0+c*(400*xd) AS west, greatest(s0,n0-(r+1)*(400*yd)) AS south, least(e0,w0+(c+1)*(400*xd)) AS east, n0-r*(400*yd) AS north FROM cc),
ck AS (SELECT *, greatest(1,CAST(round_even((east-west)/xd,0) AS BIGINT)) AS w, greatest(1,CAST(round_even((north-south)/yd,0) AS BIGINT)) AS h FROM cb)"""


def export_chunks(spark, sf):
    a = areas(spark, sf).withColumn("res_m", F.lit(100.0)).withColumn("extent", geo.make_bbox(-98.0, 31.0, -80.0, 38.5))
    a = a.withColumn("url", F.concat(F.lit("https://h/"), "aoi_id")).withColumn("bands", F.lit("0,1,2"))
    return exports.chunk_plan(a, extent="extent", chunk=400)


@query("s22_s23_export_chunks", ctes("aoi") + f", {_CHUNKS}" + """ SELECT aoi_id, CAST(r AS INT) AS chunk_row, CAST(c AS INT) AS chunk_col, w, h, round(west,6) AS west, round(south,6) AS south,
 substring(sha1(concat_ws('|', concat('https://h/',CAST(aoi_id AS STRING)), CAST(CAST(round_even(west*1e6,0) AS BIGINT) AS STRING), CAST(CAST(round_even(south*1e6,0) AS BIGINT) AS STRING), CAST(CAST(round_even(east*1e6,0) AS BIGINT) AS STRING), CAST(CAST(round_even(north*1e6,0) AS BIGINT) AS STRING), CAST(w AS STRING), CAST(h AS STRING), '0,1,2')),1,20) AS key FROM ck""")
def s22(spark, sf):
    c = export_chunks(spark, sf)
    return c.select("aoi_id", "chunk_row", "chunk_col", "w", "h", r6("cb.west", "west"), r6("cb.south", "south"),
                    exports.chunk_key(F.col("url"), F.col("cb"), F.col("w"), F.col("h"), F.col("bands")).alias("key"))


@query("u04_quarter_split", ctes("aoi") + f", {_CHUNKS}" + """,
q AS (SELECT aoi_id, r, c, w*3 AS w, h*3+1 AS h, (w*3)//2 AS w1, (h*3+1)//2 AS h1, (west+east)/2 AS mx, (south+north)/2 AS my, west, south FROM ck)
SELECT aoi_id, CAST(r AS INT) AS chunk_row, CAST(c AS INT) AS chunk_col, CAST(k AS INT) AS q, CASE WHEN k%2=0 THEN w1 ELSE w-w1 END AS w, CASE WHEN k<2 THEN h-h1 ELSE h1 END AS h,
 round(CASE WHEN k%2=0 THEN west ELSE mx END,6) AS west, round(CASE WHEN k<2 THEN my ELSE south END,6) AS south, least(w,h)>=1000 AS allowed FROM q, range(4) t(k)""")
def u04(spark, sf):
    c = export_chunks(spark, sf).withColumn("w", F.col("w") * 3).withColumn("h", F.col("h") * 3 + 1)
    c = c.withColumn("allowed", exports.can_split(F.col("w"), F.col("h"))).withColumn("p", F.explode(exports.quarters(F.col("cb"), F.col("w"), F.col("h"))))
    return c.select("aoi_id", "chunk_row", "chunk_col", F.col("p.q").alias("q"), F.col("p.w").alias("w"), F.col("p.h").alias("h"), r6("p.cb.west", "west"), r6("p.cb.south", "south"), "allowed")


def export_cache(spark, sf):
    """Cache keys by rule: whole chunks, split markers, quarters and quarters of quarters."""
    def key(df):
        return df.withColumn("key", exports.chunk_key(F.col("url"), F.col("cb"), F.col("w"), F.col("h"), F.col("bands")))

    def quads(df, name):
        return df.withColumn("p", F.explode(exports.quarters(F.col("cb"), F.col("w"), F.col("h")))).select(
            *[c for c in df.columns if c not in ("cb", "w", "h")], F.col("p.q").alias(name), "p.cb", "p.w", "p.h")
    c0 = export_chunks(spark, sf).select("aoi_id", "chunk_row", "chunk_col", "url", "bands", "cb", "w", "h")
    q1 = quads(c0, "q")
    q2 = quads(q1, "p")
    k = "(aoi_id + chunk_row * 3 + chunk_col) % 3"
    s0 = key(c0).selectExpr("key", f"CASE {k} WHEN 0 THEN 'tif' WHEN 1 THEN 'split' END AS state")
    s1 = key(q1).selectExpr("key", "CASE (aoi_id + q) % 4 WHEN 0 THEN 'tif' WHEN 1 THEN 'split' END AS state")
    s2 = key(q2).selectExpr("key", "if((aoi_id + q + p) % 2 = 0, 'tif', NULL) AS state")
    # A cache listing is a stored table; it is read once per quad level.
    return cut_lineage(s0.unionByName(s1).unionByName(s2).filter("state IS NOT NULL"), "export-cache")


_GOT = """gt AS (SELECT *, CASE (aoi_id+r*3+c)%3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN (SELECT sum(CASE (aoi_id+q)%4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.125 ELSE 0 END) FROM range(4) t(q))::DOUBLE ELSE 0.0 END AS got FROM ck)"""


@query("a06_cached_fraction", ctes("aoi") + f", {_CHUNKS}, {_GOT} SELECT aoi_id, CAST(r AS INT) AS chunk_row, CAST(c AS INT) AS chunk_col, got, 0::BIGINT AS cut_off FROM gt")
def a06(spark, sf):
    return exports.cached_fraction(export_chunks(spark, sf), export_cache(spark, sf), ["aoi_id", "chunk_row", "chunk_col"])


@query("a05_export_estimate", ctes("aoi") + f", {_CHUNKS}, {_GOT}" + f""",
tt AS (SELECT aoi_id, count(*) AS n, sum(w*h*3+8000.0::DOUBLE) AS total, sum((w*h*3+8000.0::DOUBLE)*(1-got)) AS todo, sum(1-got) AS ct FROM gt GROUP BY 1),
e AS (SELECT aoi_id, coalesce(todo,0.0) AS todo, CASE WHEN n IS NULL THEN 100.0 ELSE 100*(1-todo/total) END AS pct, n AS req, coalesce(ct,0)/0.04::DOUBLE AS sec, coalesce(total,0.0) AS src, coalesce(total,0.0) AS cut FROM aoi LEFT JOIN tt USING(aoi_id))
SELECT aoi_id, {ENV()} FROM e""")
def a05(spark, sf):
    ids = ["aoi_id", "chunk_row", "chunk_col"]
    chunks = export_chunks(spark, sf)
    got = exports.cached_fraction(chunks, export_cache(spark, sf), ids)
    c = chunks.select(*ids, "w", "h", F.lit(3).alias("px_bytes")).join(shuffled(got), ids)
    return est.envelope(est.export_estimate(areas(spark, sf), c, "aoi_id", "px_bytes", 0.04), ["aoi_id"])


@query("u06_flatten_chunk_items", ctes("aoi") + f", {_CHUNKS}" + """
SELECT aoi_id, CAST(r*1000+c AS BIGINT) AS chunk, CAST(i AS INT) AS pos, concat(CAST(r AS STRING),'/',CAST(i AS STRING)) AS item FROM ck, range(4) t(i) WHERE (aoi_id+r)%5<>0 AND i<=(aoi_id+c)%4""")
def u06(spark, sf):
    from ..operators.jobs import flatten_chunks
    c = export_chunks(spark, sf).selectExpr("aoi_id", "bigint(chunk_row * 1000 + chunk_col) AS chunk",
                                            "if((aoi_id + chunk_row) % 5 = 0, NULL, transform(sequence(0L, (aoi_id + chunk_col) % 4), i -> concat(chunk_row, '/', i))) AS items")
    return flatten_chunks(c, ["aoi_id", "chunk"], "items")


_TILES = """zz AS (SELECT *, least(12, greatest(0, least(23, CAST(ceil(log2(2*pi()*6378137*cos(radians((south+north)/2))/256/150.0)) AS INT)))) AS z FROM aoi),
rg AS (SELECT *, pow(2,z)::BIGINT AS n, greatest(0,CAST(trunc((west+180)/360*pow(2,z)) AS BIGINT)) AS x0, least(pow(2,z)::BIGINT-1, CAST(trunc((east-1e-12+180)/360*pow(2,z)) AS BIGINT)) AS x1,
 greatest(0,CAST(trunc((1-asinh(tan(radians(north)))/pi())/2*pow(2,z)) AS BIGINT)) AS y0, least(pow(2,z)::BIGINT-1, CAST(trunc((1-asinh(tan(radians(south+1e-12)))/pi())/2*pow(2,z)) AS BIGINT)) AS y1 FROM zz),
tl AS (SELECT aoi_id, z, x0, y0, x, unnest(range(y0,y1+1)) AS y FROM (SELECT *, unnest(range(x0,x1+1)) AS x FROM rg)),
pt AS (SELECT CAST(trunc((lon+180)/360*1024) AS BIGINT) AS x, CAST(trunc((1-asinh(tan(radians(lat)))/pi())/2*1024) AS BIGINT) AS y, point_id FROM points),
tc AS (SELECT 10 AS z, x, y, CASE WHEN bool_or(point_id%3=0) THEN 'tile' ELSE 'empty' END AS state FROM pt WHERE point_id%3=0 OR point_id%7=0 GROUP BY 1,2,3)"""


def zoomed(spark, sf):
    return areas(spark, sf).withColumn("z", tiles.choose_zoom(F.lit(150.0), F.col("bbox"), F.lit(12)).cast("long"))


def tile_cache(spark, sf):
    x, y = tiles.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(10))
    p = derived(spark, sf, "points").select(x.alias("x"), y.alias("y"), "point_id")
    paths = p.filter("point_id % 3 = 0").selectExpr("concat('/c/10/', x, '/', y, '.tile') AS path").unionByName(
        p.filter("point_id % 7 = 0").selectExpr("concat('/c/10/', x, '/', y, '.none') AS path"))
    return xyz.cache_inventory(paths)


@query("s24_s27_tile_enumeration", ctes("aoi", "points") + f", {_TILES} SELECT aoi_id, z::BIGINT AS z, x, y FROM tl")
def s24(spark, sf):
    return xyz.enumerate_tiles(zoomed(spark, sf)).select("aoi_id", "z", "x", "y")


@query("s25_tile_cache_inventory", ctes("aoi", "points") + f", {_TILES} SELECT z::BIGINT AS z, x, y, state FROM tc")
def s25(spark, sf):
    return tile_cache(spark, sf)


@query("s26_fetch_counts", ctes("aoi", "points") + f", {_TILES} SELECT aoi_id, count(*) AS total, count(state) AS cached, count(*) FILTER (state='empty') AS empty, count(*) FILTER (state IS NULL) AS todo FROM tl LEFT JOIN tc USING(z,x,y) GROUP BY 1")
def s26(spark, sf):
    return xyz.fetch_counts(xyz.enumerate_tiles(zoomed(spark, sf)), tile_cache(spark, sf), ["aoi_id"])


@query("s26_fetch_list", ctes("aoi", "points") + f", {_TILES} SELECT aoi_id, z::BIGINT AS z, x, y FROM tl ANTI JOIN tc USING(z,x,y)")
def s26b(spark, sf):
    return xyz.todo(xyz.enumerate_tiles(zoomed(spark, sf)).select("aoi_id", "z", "x", "y"), tile_cache(spark, sf)).select("aoi_id", "z", "x", "y")


@query("s38_tile_stitching", ctes("aoi", "points") + f", {_TILES}" + """,
sd AS (SELECT x, y, z, CASE WHEN (x+y)%11=0 THEN 512 ELSE 256 END AS size FROM tc WHERE state='tile'), j AS (SELECT tl.*, size FROM tl LEFT JOIN sd USING(z,x,y)),
f AS (SELECT aoi_id, arg_min(size, y*100000+x) AS edge FROM j WHERE size IS NOT NULL GROUP BY 1)
SELECT aoi_id, x, y, (x-x0)*edge AS off_x, (y-y0)*edge AS off_y, coalesce(size<>edge, true) AS masked FROM j JOIN f USING(aoi_id)""")
def s38(spark, sf):
    stored = tile_cache(spark, sf).filter("state = 'tile'").selectExpr("z", "x", "y", "if((x + y) % 11 = 0, 512, 256) AS size")
    return xyz.stitch_plan(xyz.enumerate_tiles(zoomed(spark, sf)), stored, ["aoi_id"]).select("aoi_id", "x", "y", "off_x", "off_y", "masked")


@query("a07_tile_estimate", ctes("aoi", "points") + f", {_TILES}" + f""",
cn AS (SELECT aoi_id, count(state) AS cached FROM tl LEFT JOIN tc USING(z,x,y) GROUP BY 1),
nn AS (SELECT aoi_id, (abs(CAST(trunc((east+180)/360*n) AS BIGINT)-CAST(trunc((west+180)/360*n) AS BIGINT))+1)*(abs(CAST(trunc((1-asinh(tan(radians(south)))/pi())/2*n) AS BIGINT)-CAST(trunc((1-asinh(tan(radians(north)))/pi())/2*n) AS BIGINT))+1) AS cnt FROM rg),
e AS (SELECT aoi_id, (cnt-cached)*25000.0::DOUBLE AS todo, 100.0::DOUBLE*cached/cnt AS pct, cnt AS req, (cnt-cached)/10.0::DOUBLE AS sec, cnt*25000.0::DOUBLE*1.1::DOUBLE AS src, cnt*25000.0::DOUBLE*1.1::DOUBLE AS cut FROM nn JOIN cn USING(aoi_id))
SELECT aoi_id, {ENV()} FROM e""")
def a07(spark, sf):
    a = zoomed(spark, sf)
    counts = xyz.fetch_counts(xyz.enumerate_tiles(a), tile_cache(spark, sf), ["aoi_id"])
    return est.envelope(est.tile_estimate(a, counts, "aoi_id", 25_000.0, 10.0), ["aoi_id"])


@query("a07_wms_estimate", ctes("aoi") + f""",
g AS (SELECT aoi_id, greatest(1, CAST(round_even((east-west)/((20.0::DOUBLE/111320)/greatest(cos(radians((south+north)/2)),0.01)),0) AS BIGINT)) AS w, greatest(1, CAST(round_even((north-south)/(20.0::DOUBLE/111320),0) AS BIGINT)) AS h FROM aoi),
b AS (SELECT aoi_id, w*h*CASE WHEN aoi_id%2=0 THEN 4.0::DOUBLE ELSE 0.35::DOUBLE END AS todo, CAST(ceil(w/1024.0::DOUBLE)*ceil(h/1024.0::DOUBLE) AS BIGINT) AS req FROM g),
e AS (SELECT aoi_id, todo, 0.0 AS pct, req, req/0.5::DOUBLE AS sec, todo*1.1::DOUBLE AS src, todo*1.1::DOUBLE AS cut FROM b) SELECT aoi_id, {ENV()} FROM e""")
def a07b(spark, sf):
    kind = F.when(F.col("aoi_id") % 2 == 0, F.lit("elevation")).otherwise(F.lit("rgb"))
    return est.envelope(est.wms_estimate(areas(spark, sf), "aoi_id", F.lit(20.0), kind, 0.5), ["aoi_id"])


@query("a09_rated_tile_and_image_estimates", ctes("aoi", "points", "samples") + f", {_TILES}" + f""",
cn AS (SELECT aoi_id, count(state) AS cached FROM tl LEFT JOIN tc USING(z,x,y) GROUP BY 1),
nn AS (SELECT aoi_id, (abs(CAST(trunc((east+180)/360*n) AS BIGINT)-CAST(trunc((west+180)/360*n) AS BIGINT))+1)*(abs(CAST(trunc((1-asinh(tan(radians(south)))/pi())/2*n) AS BIGINT)-CAST(trunc((1-asinh(tan(radians(north)))/pi())/2*n) AS BIGINT))+1) AS cnt FROM rg),
g AS (SELECT aoi_id, greatest(1, CAST(round_even((east-west)/((20.0::DOUBLE/111320)/greatest(cos(radians((south+north)/2)),0.01)),0) AS BIGINT)) AS w, greatest(1, CAST(round_even((north-south)/(20.0::DOUBLE/111320),0) AS BIGINT)) AS h FROM aoi)
{_RATED}
SELECT aoi_id, 'tiles' AS service, speed_basis, CAST(cnt AS BIGINT) AS requests, CAST(ceil(round((cnt-cached)/(rate/25000.0::DOUBLE),6)) AS BIGINT) AS download_seconds FROM nn JOIN cn USING(aoi_id) JOIN rt USING(aoi_id)
UNION ALL SELECT aoi_id, 'images', speed_basis, CAST(ceil(w/1024.0::DOUBLE)*ceil(h/1024.0::DOUBLE) AS BIGINT), CAST(ceil(round(ceil(w/1024.0::DOUBLE)*ceil(h/1024.0::DOUBLE)/(rate/2000000.0::DOUBLE),6)) AS BIGINT) FROM g JOIN rt USING(aoi_id)""")
def a09_tiles(spark, sf):
    """Tile and map-image services with learned byte rates, turned into tiles and images a second."""
    a = rated(spark, sf, zoomed(spark, sf)).withColumn("tile_rate", F.expr("rate / 25000D")).withColumn("image_rate", F.expr("rate / 2000000D"))
    counts = xyz.fetch_counts(xyz.enumerate_tiles(zoomed(spark, sf)), tile_cache(spark, sf), ["aoi_id"])
    out = [est.tile_estimate(a, counts, "aoi_id", 25_000.0, "tile_rate"), est.wms_estimate(a, "aoi_id", F.lit(20.0), F.lit("rgb"), "image_rate")]
    both = [est.envelope(e, ["aoi_id", "speed_basis"]).select("aoi_id", F.lit(n).alias("service"), "speed_basis", "requests", "download_seconds") for n, e in zip(("tiles", "images"), out)]
    return both[0].unionByName(both[1])


_A08 = f"""h8 AS (SELECT a.aoi_id, size_bytes, {FRAC}/greatest((c.east-c.west)*(c.north-c.south),1e-12) AS frac FROM aoi a JOIN catalog c ON {HIT}),
t8 AS (SELECT aoi_id, count(*) AS n, CASE WHEN bool_or(size_bytes IS NULL) THEN NULL ELSE sum(CAST(size_bytes AS DOUBLE)) END AS src, CASE WHEN bool_or(size_bytes IS NULL) THEN NULL ELSE sum(size_bytes*frac) END AS cut FROM h8 GROUP BY 1),
e8 AS (SELECT aoi_id, 0.0 AS todo, 100.0 AS pct, CASE WHEN n IS NOT NULL THEN 0 END AS req, 0.0 AS sec, CASE WHEN n IS NULL THEN 0.0 ELSE src END AS src, CASE WHEN n IS NULL THEN 0.0 ELSE cut END AS cut FROM aoi LEFT JOIN t8 USING(aoi_id))"""


def library_sizes(spark, sf):
    cat = derived(spark, sf, "catalog").select("item_id", "size_bytes", F.col("bbox").alias("item_bbox"))
    b = area_boxes(spark, sf)
    return of_areas(spark, sf, b, est.envelope(est.library_estimate(b, rect_join(b, cat), "box"), ["box"]))


@query("a08_library_estimate", ctes("aoi", "catalog") + f", {_A08} SELECT aoi_id, {ENV()} FROM e8")
def a08(spark, sf):
    return library_sizes(spark, sf)


_LAYERS = ctes("aoi", "catalog", "requests") + f""", {_CHARTS}, {SRC_CTE}, {_A08}, {_A01.split(_CHARTS + ",", 1)[1].lstrip()},
v8 AS (SELECT aoi_id, {ENV()} FROM e8), v1 AS (SELECT aoi_id, {ENV()} FROM e01),
ly AS (SELECT r.job_id, r.aoi_id, s.kind, s.resampling, coalesce(nullif(r.res_m,-1), s.default_res_m) AS res, r.mode, geotiff, cog, mbtiles, cell_level, v8.source_mb, v8.clipped_mb, west, south, east, north, v1.download_mb, v1.download_seconds
 FROM (SELECT job_id, aoi_id, source_no, res_m, mode, geotiff, cog, mbtiles, cell_level FROM requests) r JOIN (SELECT source_no, kind, resampling, default_res_m FROM src) s USING(source_no) JOIN aoi a ON a.aoi_id=r.aoi_id JOIN v8 ON v8.aoi_id=r.aoi_id LEFT JOIN v1 ON v1.aoi_id=r.aoi_id AND r.job_id%13<>0),
lg AS (SELECT *, greatest(1, CAST(round_even((east-west)/((res/111320)/greatest(cos(radians((south+north)/2)),0.01)),0) AS BIGINT)) AS width, greatest(1, CAST(round_even((north-south)/(res/111320),0) AS BIGINT)) AS height FROM ly),
lm AS (SELECT *, CAST(round_even(round(width*height*CASE WHEN kind='elevation' THEN 4 ELSE 3 END*CASE WHEN kind='rgb' AND resampling<>'nearest' THEN 0.08::DOUBLE ELSE 0.3::DOUBLE END*1.33::DOUBLE/1e6,6),1) AS DOUBLE) AS est_mb, mode='mosaic' AND width*height>2000000000 AS too_big FROM lg),
lp AS (SELECT *, CAST(round_even(round(CASE mode WHEN 'original' THEN coalesce(source_mb,clipped_mb,est_mb) WHEN 'clipped' THEN coalesce(clipped_mb,est_mb) ELSE est_mb*(geotiff+cog+CASE WHEN mbtiles=1 AND kind='rgb' THEN 1.1::DOUBLE ELSE 0 END)
 + CASE WHEN kind='elevation' THEN (ceil(east)-floor(west))*(ceil(north)-floor(south))*CASE cell_level WHEN 0 THEN 0.04::DOUBLE WHEN 1 THEN 2.9 WHEN 2 THEN 26.0 ELSE 0.0 END ELSE 0 END END,6),1) AS DOUBLE) AS package_mb FROM lm)"""


def priced_layers(spark, sf):
    src = registry.sources(spark).selectExpr("source_no", "kind", "resampling", "default_res_m")
    req = derived(spark, sf, "requests").withColumnRenamed("res_m", "wanted")
    chart = chart_prices(spark, sf).select("aoi_id", "download_mb", "download_seconds")
    j = (req.join(F.broadcast(src), "source_no").join(areas(spark, sf), "aoi_id")
         .join(library_sizes(spark, sf).select("aoi_id", "source_mb", "clipped_mb"), "aoi_id"))
    # Every thirteenth job stands for a source whose estimate failed.
    j = j.join(chart, (j.aoi_id == chart.aoi_id) & (j.job_id % 13 != 0), "left").drop(chart.aoi_id)
    return est.layer_sizes(j.withColumn("res_m", F.expr("coalesce(nullif(wanted, -1D), default_res_m)")), 2_000_000_000)


@query("a10_a11_a22_p13_layer_sizes", _LAYERS + " SELECT job_id, width, height, est_mb, too_big, package_mb, CAST((ceil(east)-floor(west))*(ceil(north)-floor(south)) AS BIGINT) AS n_cells FROM lp")
def a10(spark, sf):
    return priced_layers(spark, sf).select("job_id", "width", "height", "est_mb", "too_big", "package_mb", F.col("n_cells").cast("long").alias("n_cells"))


@query("a12_job_totals", _LAYERS + """ SELECT aoi_id, count(*) AS n_layers, CAST(round_even(round(sum(coalesce(download_mb,0)),6),1) AS DOUBLE) AS total_download_mb, CAST(sum(coalesce(download_seconds,0)) AS BIGINT) AS total_download_seconds,
 CAST(round_even(round(sum(package_mb),6),1) AS DOUBLE) AS total_package_mb, bool_or(too_big) AS any_too_big, count(*) FILTER (download_mb IS NULL) AS failed_estimates,
 CAST(round_even(round((max(east)-max(west))*111320*cos(radians((max(south)+max(north))/2))/1000,6),1) AS DOUBLE) AS width_km, CAST(round_even(round((max(north)-max(south))*111320/1000,6),1) AS DOUBLE) AS height_km FROM lp GROUP BY 1""")
def a12(spark, sf):
    return est.area_km(est.job_totals(priced_layers(spark, sf), ["aoi_id"]), areas(spark, sf), "aoi_id")
