"""Validation, projections and scalar geometry over the derived areas, catalogue and points."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, tiles
from .inputs import ctes, derived, flat, r6, table
from .registry import query

_INTER = "greatest(a.west,c.west) < least(a.east,c.east) AND greatest(a.south,c.south) < least(a.north,c.north)"
_OCT_SQL = """[{'lon': west+0.1*(east-west), 'lat': south}, {'lon': east-0.1*(east-west), 'lat': south},
 {'lon': east, 'lat': south+0.1*(north-south)}, {'lon': east, 'lat': north-0.1*(north-south)},
 {'lon': east-0.1*(east-west), 'lat': north}, {'lon': west+0.1*(east-west), 'lat': north},
 {'lon': west, 'lat': north-0.1*(north-south)}, {'lon': west, 'lat': south+0.1*(north-south)}]"""


def octagon(b):
    """Box with its corners cut by a tenth, as an open ring."""
    dx, dy = 0.1 * (b.east - b.west), 0.1 * (b.north - b.south)
    pts = [(b.west + dx, b.south), (b.east - dx, b.south), (b.east, b.south + dy), (b.east, b.north - dy),
           (b.east - dx, b.north), (b.west + dx, b.north), (b.west, b.north - dy), (b.west, b.south + dy)]
    return F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in pts])


@query("p01_bbox_validity", """
SELECT o_orderkey AS job_id, west, south, east, north,
 CASE WHEN NOT (west >= -180 AND west < east AND east <= 180) THEN 'longitude range'
      WHEN NOT (south >= -90 AND south < north AND north <= 90) THEN 'latitude range' END AS reason
FROM (SELECT o_orderkey, CAST(o_orderkey%370-185 AS DOUBLE) AS west, CAST(o_orderkey%190-95 AS DOUBLE) AS south,
 CAST(o_orderkey%370-185+o_custkey%40-3 AS DOUBLE) AS east, CAST(o_orderkey%190-95+o_custkey%20-2 AS DOUBLE) AS north FROM orders)""")
def p01(spark, sf):
    o = table(spark, sf, "orders")
    w, s = F.col("o_orderkey") % 370 - 185, F.col("o_orderkey") % 190 - 95
    b = geo.make_bbox(w, s, w + F.col("o_custkey") % 40 - 3, s + F.col("o_custkey") % 20 - 2)
    df = o.select(F.col("o_orderkey").alias("job_id"), b.alias("bbox"))
    return df.select("job_id", *[F.col(f"bbox.{x}") for x in ("west", "south", "east", "north")],
                     geo.bbox_error(F.col("bbox")).alias("reason"))


@query("p02_p03_box_intersection", ctes("aoi", "catalog") + """
SELECT a.aoi_id, c.item_id,
 NOT (c.east<=a.west OR c.west>=a.east OR c.north<=a.south OR c.south>=a.north) AS hits,
 CASE WHEN """ + _INTER + """ THEN round(greatest(a.west,c.west),6) END AS west,
 CASE WHEN """ + _INTER + """ THEN round(least(a.north,c.north),6) END AS north
FROM aoi a JOIN catalog c ON c.item_id = (a.aoi_id*7)%(SELECT count(*) FROM supplier)""")
def p02(spark, sf):
    cat = derived(spark, sf, "catalog").select("item_id", F.col("bbox").alias("item_bbox"))
    n = table(spark, sf, "supplier").agg(F.count("*")).scalar()
    a = derived(spark, sf, "aoi").withColumn("item_id", (F.col("aoi_id") * 7) % n)
    j = a.join(cat, "item_id")
    i = geo.intersection(F.col("bbox"), F.col("item_bbox"))
    return j.select("aoi_id", "item_id", geo.intersects(F.col("bbox"), F.col("item_bbox")).alias("hits"),
                    r6(i.west, "west"), r6(i.north, "north"))


@query("p04_ring_envelope", ctes("catalog") + f""", rings AS (SELECT item_id, {_OCT_SQL} AS ring FROM catalog)
SELECT item_id, round(list_min(list_transform(ring, lambda p: p.lon)),6) AS west, round(list_min(list_transform(ring, lambda p: p.lat)),6) AS south,
 round(list_max(list_transform(ring, lambda p: p.lon)),6) AS east, round(list_max(list_transform(ring, lambda p: p.lat)),6) AS north FROM rings""")
def p04(spark, sf):
    df = derived(spark, sf, "catalog").select("item_id", geo.envelope(octagon(F.col("bbox"))).alias("bbox"))
    return df.select("item_id", *flat())


@query("p05_polygon_validation", """
WITH r AS (SELECT c_custkey AS aoi_id, list_transform(range(0, 2 + c_custkey%4), lambda i: {'lon': CAST((c_custkey*13 + i*(37 + c_custkey%3))%400-200 AS DOUBLE),
 'lat': CASE WHEN (c_custkey+i)%29=0 THEN CAST('nan' AS DOUBLE) ELSE CAST((c_custkey*7 + i*i*11)%170-85 AS DOUBLE) END}) AS ring FROM customer),
e AS (SELECT *, list_min(list_transform(ring, lambda p: p.lon)) AS w, list_max(list_transform(ring, lambda p: p.lon)) AS e,
 list_min(list_transform(ring, lambda p: p.lat)) AS s, list_max(list_transform(ring, lambda p: p.lat)) AS n FROM r)
SELECT aoi_id, CASE WHEN len(ring)<3 THEN 'fewer than 3 points' WHEN len(list_filter(ring, lambda p: isnan(p.lat)))>0 THEN 'non-finite point'
 WHEN NOT (w>=-180 AND w<e AND e<=180) THEN 'longitude range' WHEN NOT (s>=-90 AND s<n AND n<=90) THEN 'latitude range' END AS reason,
 CAST(CASE WHEN ring[1].lon=ring[-1].lon AND ring[1].lat=ring[-1].lat THEN len(ring) ELSE len(ring)+1 END AS INT) AS closed_points FROM e""")
def p05(spark, sf):
    k = F.col("c_custkey")
    ring = F.transform(F.sequence(F.lit(0), (1 + k % 4).cast("int")), lambda i: F.struct(
        ((k * 13 + i * (37 + k % 3)) % 400 - 200).cast("double").alias("lon"),
        F.when((k + i) % 29 == 0, F.lit(float("nan"))).otherwise(((k * 7 + i * i * 11) % 170 - 85).cast("double")).alias("lat")))
    df = table(spark, sf, "customer").select(k.alias("aoi_id"), ring.alias("ring"))
    return df.select("aoi_id", geo.ring_error(F.col("ring")).alias("reason"), F.size(geo.close_ring(F.col("ring"))).alias("closed_points"))


@query("a20_polygon_area", ctes("catalog") + f""", rings AS (SELECT item_id, {_OCT_SQL} AS ring FROM catalog),
p AS (SELECT item_id, unnest(ring, recursive := true), generate_subscripts(ring,1) AS i, len(ring) AS n FROM rings),
m AS (SELECT item_id, avg(lat) AS lat0 FROM p GROUP BY 1),
q AS (SELECT p.item_id, i, n, lon*111.32*cos(lat0*pi()/180) AS x, lat*111.32 AS y FROM p JOIN m USING(item_id))
SELECT a.item_id, round(abs(sum(a.x*b.y-b.x*a.y))/2, 4) AS km2 FROM q a JOIN q b ON a.item_id=b.item_id AND b.i = a.i%a.n+1 GROUP BY 1""")
def a20(spark, sf):
    df = derived(spark, sf, "catalog")
    return df.select("item_id", r6(geo.polygon_area_km2(octagon(F.col("bbox"))), "km2", 4))


@query("a21_area_stats", ctes("aoi") + """
SELECT aoi_id, round(wkm,6) AS wkm, round(hkm,6) AS hkm, round(wkm*hkm,4) AS km2, round(wkm*1000/1852,6) AS wnm, round(hkm*1000/1852,6) AS hnm,
 wkm*hkm > 20000 AS large FROM (SELECT aoi_id, (east-west)*111.32*cos(((south+north)/2)*pi()/180) AS wkm, (north-south)*111.32 AS hkm FROM aoi)""")
def a21(spark, sf):
    s = derived(spark, sf, "aoi").select("aoi_id", geo.area_stats(F.col("bbox")).alias("s"))
    return s.select("aoi_id", r6("s.wkm", "wkm"), r6("s.hkm", "hkm"), r6("s.km2", "km2", 4), r6("s.wnm", "wnm"),
                    r6("s.hnm", "hnm"), F.col("s.large").alias("large"))


@query("h01_h05_output_grid", ctes("aoi") + """,
g AS (SELECT *, 30.0 + aoi_id%50 AS res FROM aoi),
d AS (SELECT *, (res/111320)/greatest(cos(radians((south+north)/2)),0.01) AS xd, res/111320 AS yd FROM g),
s AS (SELECT *, greatest(1, CAST(round_even((east-west)/xd,0) AS BIGINT)) AS width, greatest(1, CAST(round_even((north-south)/yd,0) AS BIGINT)) AS height FROM d)
SELECT aoi_id, round(xd,9) AS xdeg, round(yd,9) AS ydeg, round(yd*111320,6) AS back_m, width, height, width*height AS pixels,
 round((east-west)/width,9) AS xres, round((north-south)/height,9) AS yres,
 round(west + 1*((east-west)/width),6) AS win_west, round(north - (2+3)*((north-south)/height),6) AS win_south,
 round(west + (2+0.5)*((east-west)/width),6) AS centre_lon FROM s""")
def h01(spark, sf):
    df = derived(spark, sf, "aoi").withColumn("res", 30.0 + F.col("aoi_id") % 50)
    xd, yd = geo.meters_to_deg(F.col("res"), geo.center_lat(F.col("bbox")))
    g = df.select("aoi_id", xd.alias("xd"), yd.alias("yd"), geo.make_grid(F.col("bbox"), F.col("res")).alias("g"))
    win = geo.window_bbox(F.col("g"), F.lit(1), F.lit(2), F.lit(4), F.lit(3))
    centre = geo.pixel_center(F.col("g.xres"), F.col("g.bbox.west"), F.lit(2))
    return g.select("aoi_id", r6("xd", "xdeg", 9), r6("yd", "ydeg", 9), r6(geo.deg_to_meters(F.col("yd")), "back_m"),
                    F.col("g.width").alias("width"), F.col("g.height").alias("height"), F.col("g.pixels").alias("pixels"),
                    r6("g.xres", "xres", 9), r6("g.yres", "yres", 9), r6(win.west, "win_west"), r6(win.south, "win_south"),
                    r6(centre, "centre_lon"))


@query("h06_h07_mercator_zoom", ctes("aoi") + """,
z AS (SELECT aoi_id, (south+north)/2 AS lat, CAST(1+aoi_id%60 AS DOUBLE) AS res FROM aoi),
q AS (SELECT *, greatest(0, least(23, CAST(ceil(log2(2*pi()*6378137*cos(radians(lat))/256/greatest(res,0.01))) AS INT))) AS zoom FROM z)
SELECT aoi_id, zoom, round(2*pi()*6378137*cos(radians(lat))/256/pow(2,zoom),6) AS zoom_res_m FROM q""")
def h06(spark, sf):
    df = derived(spark, sf, "aoi").select("aoi_id", geo.center_lat(F.col("bbox")).alias("lat"), (1 + F.col("aoi_id") % 60).cast("double").alias("res"))
    df = df.withColumn("zoom", tiles.zoom_for(F.col("res"), F.col("lat")))
    return df.select("aoi_id", "zoom", r6(tiles.resolution(F.col("zoom"), F.col("lat")), "zoom_res_m"))


@query("h08_interior_depth", ctes("points", "catalog") + """
SELECT point_id, round(least(least(lon-west,east-lon)/(east-west), least(lat-south,north-lat)/(north-south)),6) AS depth
FROM points JOIN catalog ON item_id = point_id%(SELECT count(*) FROM supplier)""")
def h08(spark, sf):
    n = table(spark, sf, "supplier").agg(F.count("*")).scalar()
    p = derived(spark, sf, "points").withColumn("item_id", F.col("point_id") % n)
    j = p.join(derived(spark, sf, "catalog").select("item_id", "bbox"), "item_id")
    return j.select("point_id", r6(geo.interior_depth(F.col("lon"), F.col("lat"), F.col("bbox")), "depth"))


# Sample WKT heads of four projections.
_WKT = ['GEOGCS["WGS 84"]', 'PROJCS["WGS 84 / Pseudo-Mercator"]', 'PROJCS["NAD83 / Transverse Mercator 18N"]', 'PROJCS["Albers"]']


@query("h09_h22_native_resolution", ctes("catalog") + """,
w AS (SELECT item_id, (south+north)/2 AS lat, 1+item_id%20 AS px, CASE item_id%4 WHEN 0 THEN 'GEOGCS["WGS 84"]' WHEN 1 THEN 'PROJCS["WGS 84 / Pseudo-Mercator"]'
 WHEN 2 THEN 'PROJCS["NAD83 / Transverse Mercator 18N"]' ELSE 'PROJCS["Albers"]' END AS wkt,
 CASE item_id%4 WHEN 0 THEN 4326 WHEN 1 THEN 3857 WHEN 2 THEN 32618 END AS epsg FROM catalog)
SELECT item_id, round(CASE WHEN item_id%4=0 THEN px/10000.0::DOUBLE*111320*greatest(cos(radians(lat)),0.1) WHEN item_id%4=1 THEN px*greatest(cos(radians(lat)),0.01)
 ELSE px END,6) AS native_m, CASE WHEN epsg IS NULL THEN regexp_extract(wkt,'\\["([^"]+)"',1) ELSE concat('EPSG:',epsg,' (',regexp_extract(wkt,'\\["([^"]+)"',1),')') END AS crs FROM w""")
def h09(spark, sf):
    from ..functions import text
    k = F.col("item_id")
    wkt = F.element_at(F.array(*[F.lit(w) for w in _WKT]), (k % 4 + 1).cast("int"))
    epsg = F.element_at(F.array(F.lit(4326), F.lit(3857), F.lit(32618), F.lit(None)), (k % 4 + 1).cast("int"))
    df = derived(spark, sf, "catalog").select(k, geo.center_lat(F.col("bbox")).alias("lat"), wkt.alias("wkt"), epsg.alias("epsg"),
                                              F.when(k % 4 == 0, (1 + k % 20).cast("double") / 10000).otherwise((1 + k % 20).cast("double")).alias("px"))
    fam = geo.crs_family(F.col("epsg"), F.col("wkt"))
    return df.select("item_id", r6(geo.native_res_m(fam, F.col("px"), F.col("lat")), "native_m"),
                     text.crs_label(F.col("epsg"), F.col("wkt")).alias("crs"))


@query("h10_point_tiles", ctes("points") + """
SELECT point_id, least(greatest(CAST(trunc((lon+180.0)/360.0*1024) AS BIGINT),0),1023) AS x,
 least(greatest(CAST(trunc((1.0-asinh(tan(radians(lat)))/pi())/2.0*1024) AS BIGINT),0),1023) AS y FROM points""")
def h10(spark, sf):
    x, y = tiles.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(10))
    return derived(spark, sf, "points").select("point_id", x.alias("x"), y.alias("y"))


@query("h11_centre_radius_box", ctes("points") + """
SELECT point_id, CASE WHEN abs(la)<=89 AND r>0 THEN round(lon-r*1852/(111320*cos(la*pi()/180)),6) END AS west,
 CASE WHEN abs(la)<=89 AND r>0 THEN round(la+r*1852/111320,6) END AS north
FROM (SELECT point_id, lon, CASE WHEN point_id%97=0 THEN CAST(89.5 AS DOUBLE) ELSE lat END AS la, point_id%30 AS r FROM points)""")
def h11(spark, sf):
    df = derived(spark, sf, "points").withColumn("la", F.when(F.col("point_id") % 97 == 0, F.lit(89.5)).otherwise(F.col("lat")))
    b = geo.bbox_from_center(F.col("la"), F.col("lon"), F.col("point_id") % 30)
    return df.select("point_id", r6(b.west, "west"), r6(b.north, "north"))


@query("h12_display_scale", ctes("catalog") + """
SELECT item_id, round(native_res_m/0.0002645833,3) AS native, round(native_res_m/0.0002645833/2,3) AS finest, round(native_res_m/0.0002645833*8,3) AS coarsest
FROM catalog WHERE native_res_m IS NOT NULL""")
def h12(spark, sf):
    df = derived(spark, sf, "catalog").filter("native_res_m is not null").select("item_id", geo.display_scale(F.col("native_res_m")).alias("s"))
    return df.select("item_id", r6("s.native", "native", 3), r6("s.finest", "finest", 3), r6("s.coarsest", "coarsest", 3))


@query("u01_u02_box_split", ctes("aoi") + """,
f AS (SELECT *, greatest(2, CAST(ceil(CAST(1+aoi_id%90 AS DOUBLE)/10) AS INT)) AS n FROM aoi),
g AS (SELECT *, CAST(ceil(sqrt(n)) AS INT) AS cols FROM f), h AS (SELECT *, CAST(ceil(CAST(n AS DOUBLE)/cols) AS INT) AS rows FROM g),
s AS (SELECT *, unnest(range(0, cols*rows)) AS idx FROM h)
SELECT aoi_id, CAST(idx AS INT) AS idx, cols, rows, round(west+(idx%cols)*((east-west)/cols),6) AS west, round(south+(idx//cols)*((north-south)/rows),6) AS south,
 round(west+(idx%cols+1)*((east-west)/cols),6) AS east, round(south+(idx//cols+1)*((north-south)/rows),6) AS north FROM s""")
def u01(spark, sf):
    cols, rows = geo.split_size((1 + F.col("aoi_id") % 90).cast("double") / 10)
    df = derived(spark, sf, "aoi").withColumn("cols", cols).withColumn("rows", rows)
    df = df.select("aoi_id", "cols", "rows", F.explode(geo.split_bbox(F.col("bbox"), F.col("cols"), F.col("rows"))).alias("p"))
    return df.select("aoi_id", F.col("p.idx").alias("idx"), "cols", "rows", *flat("p.bbox"))
