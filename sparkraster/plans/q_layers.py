"""Layers of charts and pictures: palettes with clip rings, alpha, mixed projections, and areas painted in pieces."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import mosaic as mo
from ..operators import render as rd
from ..session import cut_lineage, shuffled
from .inputs import ELEV_CTE, ctes, derived, elevation_chips, palette_chips, r6, spread
from .q_mosaic import _GRID_CTE, _WIN, REGION, REGION_RES, px_sql, round_sql, smooth_cte
from .registry import query

R = rd.MERCATOR_RADIUS_M
_WHOLE_PX = """
ppy AS (SELECT *, unnest(range(greatest(0, CAST(floor((gn-north)/yres) AS BIGINT)), least(ghei-1, CAST(ceil((gn-south)/yres) AS BIGINT)-1)+1)) AS py FROM pairs),
ppx AS (SELECT *, unnest(range(greatest(0, CAST(floor((west-gw)/xres) AS BIGINT)), least(gwid-1, CAST(ceil((east-gw)/xres) AS BIGINT)-1)+1)) AS px FROM ppy),
pll AS (SELECT *, gw+(px+0.5::DOUBLE)*xres AS lon, gn-(py+0.5::DOUBLE)*yres AS lat FROM ppx)"""
_RATIO = "yres*111320/greatest(abs(a)*111320*greatest(cos(radians((south+north)/2)),0.1), 1e-9)"


def _region_grid(df):
    res = F.when(F.col("layer") % 2 == 0, F.lit(REGION_RES[0])).otherwise(F.lit(REGION_RES[1]))
    native = geo.native_res_m(F.lit("geographic"), F.col("a"), geo.center_lat(F.col("bbox")))
    return spread(df).withColumn("grid", geo.make_grid(geo.make_bbox(*REGION), res)).withColumn("native_res_m", native).withColumn("crs", F.lit("geographic"))


# Ten colours by rule; index 0 is transparent. Each chart is clipped to a four-sided neatline, charts of odd layers to a user's polygon too.
PALETTE = [[25 * k, 255 - 20 * k, 37 * k % 256, 0 if k == 0 else 255] for k in range(10)]
_NEATLINE = [("bbox.west + 0.1D * dx", "bbox.south"), ("bbox.east", "bbox.south + 0.2D * dy"), ("bbox.east - 0.15D * dx", "bbox.north"), ("bbox.west", "bbox.north - 0.1D * dy")]
_USER = [(-99.5, 30.2), (-75.2, 31.0), (-80.0, 40.8), (-97.0, 39.0)]


def with_user_polygon(df, polygon, where: str = "true"):
    """The polygon a user has drawn, closed, becomes one more clip ring of every raster."""
    ring = geo.close_ring(polygon)
    return df.withColumn("rings", F.when(F.expr(where), F.concat(F.coalesce("rings", F.array().cast("array<array<struct<lon:double,lat:double>>>")), F.array(ring))).otherwise(F.col("rings")))


def chart_shares(spark, sf):
    df = _region_grid(palette_chips(spark, sf)).withColumn("dx", F.expr("bbox.east - bbox.west")).withColumn("dy", F.expr("bbox.north - bbox.south"))
    points = ", ".join(f"named_struct('lon', {x}, 'lat', {y})" for x, y in [*_NEATLINE, _NEATLINE[0]])
    df = df.withColumn("rings", F.array(F.expr(f"array({points})")))
    user = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _USER])
    df = with_user_polygon(df, user, "layer % 2 = 1")
    return (df.withColumn("mode", F.lit("palette")).withColumn("resampling", F.lit("nearest")).withColumn("dtype", F.lit("uint8")).withColumn("bands", F.array(F.lit(1)))
            .withColumn("alpha_band", F.lit(None).cast("int")).withColumn("lut", F.array(*[F.array(*[F.lit(x) for x in c]) for c in PALETTE]))
            .withColumn("values", F.array(F.transform("idx", lambda v: v.cast("double")))))


def _ring_sql(points):
    return "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in [*points, points[0]]) + "]"


def _inside_sql(ring):
    """Even-odd test of lon, lat in a closed list of points."""
    return (f"list_sum(list_transform(range(1, len({ring})), lambda k: CASE WHEN ({ring}[k].y > lat) <> ({ring}[k+1].y > lat) AND "
            f"lon < ({ring}[k+1].x-{ring}[k].x)*(lat-{ring}[k].y)/({ring}[k+1].y-{ring}[k].y)+{ring}[k].x THEN 1 ELSE 0 END))%2=1")


_CHART_SQL = "WITH " + ELEV_CTE + "," + _GRID_CTE + f""",
pairs AS (SELECT elev.* EXCLUDE (z), list_transform(embedding, lambda v: greatest(0, least(9, CAST(floor((CAST(v AS DOUBLE)+0.6)*8) AS INT)))) AS idx, 8 AS width, 8 AS height, grd.*
 FROM elev JOIN (SELECT item_id, embedding FROM chips) USING (item_id) JOIN grd ON odd = layer%2),{_WHOLE_PX},
fac AS (SELECT *, CAST(greatest(1, least(4, round_even({_RATIO}, 0))) AS BIGINT) AS fk FROM pll),
sub AS (SELECT * EXCLUDE (idx), flatten(list_transform(range(py*fk, py*fk+fk), lambda j: list_transform(range(px*fk, px*fk+fk), lambda i: {{
 'fr': (gn-(j+0.5::DOUBLE)*(yres/fk)-f)/e, 'fc': (gw+(i+0.5::DOUBLE)*(xres/fk)-c)/a}}))) AS subs, idx FROM fac),
ids AS (SELECT * EXCLUDE (subs, idx), list_transform(subs, lambda q: CASE WHEN q.fr>=0 AND q.fr<height AND q.fc>=0 AND q.fc<width
 THEN idx[CAST(floor(q.fr) AS BIGINT)*width+CAST(floor(q.fc) AS BIGINT)+1] ELSE NULL END) AS ks FROM sub),
col AS (SELECT *, (list_sum(list_transform(ks, lambda k: 25*coalesce(k,0)))+fk*fk//2)//(fk*fk) AS r, (list_sum(list_transform(ks, lambda k: 255-20*coalesce(k,0)))+fk*fk//2)//(fk*fk) AS g,
 (list_sum(list_transform(ks, lambda k: 37*coalesce(k,0)%256))+fk*fk//2)//(fk*fk) AS b, len(list_filter(ks, lambda k: k>0))/(fk*fk) AS share FROM ids WHERE len(list_filter(ks, lambda k: k>0))/(fk*fk)>=0.5),
rng AS (SELECT *, {_ring_sql([(x.replace('bbox.', '').replace('dx', '(east-west)').replace('0.1D', '0.1::DOUBLE').replace('0.15D', '0.15::DOUBLE'), y.replace('bbox.', '').replace('dy', '(north-south)').replace('0.2D', '0.2::DOUBLE').replace('0.1D', '0.1::DOUBLE')) for x, y in _NEATLINE])} AS neat,
 {_ring_sql([(f'{x!r}::DOUBLE', f'{y!r}::DOUBLE') for x, y in _USER])} AS usr FROM col),
inn AS (SELECT *, CASE WHEN odd=1 THEN greatest(west, {min(x for x, _ in _USER)!r}) ELSE west END AS w2, CASE WHEN odd=1 THEN least(east, {max(x for x, _ in _USER)!r}) ELSE east END AS e2,
 CASE WHEN odd=1 THEN greatest(south, {min(y for _, y in _USER)!r}) ELSE south END AS s2, CASE WHEN odd=1 THEN least(north, {max(y for _, y in _USER)!r}) ELSE north END AS n2
 FROM rng WHERE {_inside_sql('neat')} AND (odd=0 OR {_inside_sql('usr')})),
fit AS (SELECT *, CASE WHEN w2<e2 AND s2<n2 THEN w2 ELSE west END AS fw, CASE WHEN w2<e2 AND s2<n2 THEN e2 ELSE east END AS fe,
 CASE WHEN w2<e2 AND s2<n2 THEN s2 ELSE south END AS fs, CASE WHEN w2<e2 AND s2<n2 THEN n2 ELSE north END AS fn FROM inn),
smp AS (SELECT *, CAST(least(least(lon-fw,fe-lon)/(fe-fw), least(lat-fs,fn-lat)/(fn-fs)) AS FLOAT) AS depth FROM fit)
SELECT layer, CAST(py AS INT) AS py, CAST(px AS INT) AS px, CAST(m.r AS INT) AS r, CAST(m.g AS INT) AS g, CAST(m.b AS INT) AS b, m.item_id AS item_id FROM (
 SELECT layer, py, px, arg_max({{'r': r, 'g': g, 'b': b, 'item_id': item_id}}, {{'d': depth, 'o': -item_ord}}) AS m FROM smp GROUP BY 1,2,3)"""


@query("r20_palette_rings", _CHART_SQL)
def r20_palette_rings(spark, sf):
    """Charts with neatlines and a user's polygon, sampled nearest at up to four times and box-averaged."""
    blocks = rd.render_blocks(chart_shares(spark, sf), ["layer"], 128)
    return rd.block_pixels(blocks, ["layer"], 128, ["r", "g", "b"]).withColumnRenamed("item_ord", "item_id")


# Pictures of three colour bands and alpha; every seventh is gray without alpha, every other has sixteen bits, some of them beyond twelve.
_SCALE = "CASE WHEN item_id%2=0 THEN 1 WHEN item_id%3=0 THEN 200 ELSE 16 END"


def picture_shares(spark, sf):
    df = _region_grid(elevation_chips(spark, sf).drop("z").join(derived(spark, sf, "chips").select("item_id", "embedding"), "item_id"))
    one = f"greatest(0, least(255, int(floor((double(v) + 0.6D) * 200))))"
    scale = f"double({_SCALE})"
    values = [f"transform(embedding, (v, i) -> {one} * {scale})", f"transform(embedding, (v, i) -> (255 - {one}) * {scale})", f"transform(embedding, (v, i) -> ((i * 37 + item_id) % 256) * {scale})",
              "transform(embedding, (v, i) -> double(CASE (item_id + i) % 5 WHEN 0 THEN 0 WHEN 1 THEN 128 ELSE 255 END))"]
    gray = F.col("item_id") % 7 == 0
    return (df.withColumn("values", F.array(*[F.expr(x) for x in values])).withColumn("mode", F.when(gray, "gray").otherwise("rgb")).withColumn("bands", F.when(gray, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))))
            .withColumn("alpha_band", F.when(~gray, 4)).withColumn("dtype", F.when(F.col("item_id") % 2 == 0, "uint8").otherwise("uint16")).withColumn("resampling", F.lit("bilinear"))
            .withColumn("lut", F.lit(None).cast("array<array<int>>")).withColumn("rings", F.lit(None).cast("array<array<struct<lon:double,lat:double>>>")))


def _picture_band(k):
    x = f"floor(list_sum(list_transform(cells, lambda q: q.w*q.v{k}))/list_sum(list_transform(cells, lambda q: q.w))+0.5)"
    return f"CASE WHEN item_id%2=0 THEN CAST({x} AS INT) ELSE least(255, CAST(trunc(CAST({x} AS FLOAT)*CAST(255.0::DOUBLE/CASE WHEN top<=4095 THEN 4095.0 ELSE 65535.0 END AS FLOAT)) AS INT)) END"


_PICTURE_SQL = "WITH " + ELEV_CTE + "," + _GRID_CTE + f""",
pic AS (SELECT item_id, list_transform(embedding, lambda v, i: CAST(greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE)+0.6)*200) AS INT)))*({_SCALE}) AS DOUBLE)) AS b1,
 list_transform(embedding, lambda v, i: CAST((255-greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE)+0.6)*200) AS INT))))*({_SCALE}) AS DOUBLE)) AS b2,
 list_transform(embedding, lambda v, i: CAST((((i-1)*37+item_id)%256)*({_SCALE}) AS DOUBLE)) AS b3,
 list_transform(embedding, lambda v, i: CASE WHEN item_id%7=0 THEN 1.0::DOUBLE WHEN (item_id+i-1)%5=0 THEN 0 WHEN (item_id+i-1)%5=1 THEN 128/255.0::DOUBLE ELSE 1 END) AS al FROM chips),
pairs AS (SELECT elev.* EXCLUDE (z), b1, b2, b3, al, CASE WHEN item_id%7=0 THEN list_max(b1) ELSE greatest(list_max(b1), list_max(b2), list_max(b3)) END AS top, 8 AS width, 8 AS height, grd.*
 FROM elev JOIN pic USING (item_id) JOIN grd ON odd = layer%2),{smooth_cte("""'w': al[j*width+i+1]*WEIGHT, 'v1': b1[j*width+i+1], 'v2': b2[j*width+i+1], 'v3': b3[j*width+i+1]""", "b1, b2, b3, al", "q.w > 0")},
smp AS (SELECT * EXCLUDE (cells), {_picture_band(1)} AS r, {_picture_band(2)} AS g, {_picture_band(3)} AS b, CAST(least(least(lon-west,east-lon)/(east-west), least(lat-south,north-lat)/(north-south)) AS FLOAT) AS depth
 FROM near WHERE list_sum(list_transform(cells, lambda q: q.w)) > 1e-9)
SELECT layer, CAST(py AS INT) AS py, CAST(px AS INT) AS px, m.r AS r, CASE WHEN m.item_id%7=0 THEN m.r ELSE m.g END AS g, CASE WHEN m.item_id%7=0 THEN m.r ELSE m.b END AS b, m.item_id AS item_id FROM (
 SELECT layer, py, px, arg_max({{'r': r, 'g': g, 'b': b, 'item_id': item_id}}, {{'d': depth, 'o': -item_ord}}) AS m FROM smp GROUP BY 1,2,3)"""


@query("r20_rgb_alpha", _PICTURE_SQL)
def r20_rgb_alpha(spark, sf):
    """Pictures with alpha: half-transparent pixels weigh half, and sixteen bits are brought down to eight."""
    blocks = rd.render_blocks(picture_shares(spark, sf), ["layer"], 128)
    return rd.block_pixels(blocks, ["layer"], 128, ["r", "g", "b"]).withColumnRenamed("item_ord", "item_id")


# ---------------------------------------------------------------------------- projections
def mixed_shares(spark, sf):
    """The elevation chips, odd ones as rasters in Web-Mercator metres over the same box."""
    df = rd.elevation_shares(_region_grid(elevation_chips(spark, sf)))
    merc = F.col("item_id") % 2 == 1

    def x(c):
        return F.radians(c) * R

    def y(c):
        return F.asinh(F.tan(F.radians(c))) * R
    b = F.col("bbox")
    return (df.withColumn("crs", F.when(merc, "mercator").otherwise("geographic"))
            .withColumn("c", F.when(merc, x(b.west)).otherwise(F.col("c"))).withColumn("f", F.when(merc, y(b.north)).otherwise(F.col("f")))
            .withColumn("a", F.when(merc, (x(b.east) - x(b.west)) / 8).otherwise(F.col("a"))).withColumn("e", F.when(merc, -(y(b.north) - y(b.south)) / 8).otherwise(F.col("e")))
            .withColumn("native_res_m", geo.native_res_m(F.col("crs"), F.col("a"), geo.center_lat(b))))


_MIXED_SQL = "WITH " + ELEV_CTE + "," + _GRID_CTE + f""",
own AS (SELECT * EXCLUDE (a, c, e, f), item_id%2=1 AS merc, CASE WHEN item_id%2=1 THEN radians(west)*{R!r}::DOUBLE ELSE c END AS c, CASE WHEN item_id%2=1 THEN asinh(tan(radians(north)))*{R!r}::DOUBLE ELSE f END AS f,
 CASE WHEN item_id%2=1 THEN (radians(east)*{R!r}::DOUBLE-radians(west)*{R!r}::DOUBLE)/8 ELSE a END AS a,
 CASE WHEN item_id%2=1 THEN -(asinh(tan(radians(north)))*{R!r}::DOUBLE-asinh(tan(radians(south)))*{R!r}::DOUBLE)/8 ELSE e END AS e FROM elev),
pairs AS (SELECT own.*, 8 AS width, 8 AS height, grd.*, abs(a)*CASE WHEN merc THEN greatest(cos(radians((south+north)/2)),0.01) ELSE 111320*greatest(cos(radians((south+north)/2)),0.1) END AS native FROM own JOIN grd ON odd = layer%2),
{smooth_cte("'w': WEIGHT, 'v': z[j*width+i+1]", "z", "q.v<>-32767 AND NOT isnan(q.v) AND NOT isinf(q.v)", merc=True)},
smp AS (SELECT * EXCLUDE (cells), list_sum(list_transform(cells, lambda q: q.w*q.v))/list_sum(list_transform(cells, lambda q: q.w)) AS v,
 CAST(least(least(lon-west,east-lon)/(east-west), least(lat-south,north-lat)/(north-south)) AS FLOAT) AS depth FROM near WHERE list_sum(list_transform(cells, lambda q: q.w)) > 1e-9)
SELECT layer, CAST(py AS INT) AS py, CAST(px AS INT) AS px, round(m.v,3) AS v, m.item_id AS item_id FROM (SELECT layer, py, px, {_WIN} AS m FROM smp GROUP BY 1,2,3)"""


@query("r11_mixed_projections", _MIXED_SQL)
def r11_mixed_projections(spark, sf):
    """A mosaic of rasters in degrees and in Web-Mercator metres."""
    blocks = rd.render_blocks(mixed_shares(spark, sf), ["layer"], 128)
    return rd.block_pixels(blocks, ["layer"], 128, ["v"]).select("layer", "py", "px", r6("v", "v", 3), F.col("item_ord").alias("item_id"))


# ---------------------------------------------------------------------------- areas in pieces
PIECE_PIXELS, PIECE_RES = 120, 15000.0


@query("r20_split_layers", ctes("aoi") + ", " + ELEV_CTE + ", s0 AS (SELECT aoi_id, '' AS path, west AS w, south AS s, east AS e, north AS n FROM aoi)"
       + "".join(round_sql(i, PIECE_RES, PIECE_PIXELS) for i in range(4)) + f""", p4 AS (SELECT *, {px_sql('', PIECE_RES)} AS px FROM s4),
pieces AS (SELECT aoi_id, path, w AS gw, s AS gs, e AS ge, n AS gn FROM (
 SELECT aoi_id,path,w,s,e,n FROM p0 WHERE px<={PIECE_PIXELS} UNION ALL SELECT aoi_id,path,w,s,e,n FROM p1 WHERE px<={PIECE_PIXELS} UNION ALL SELECT aoi_id,path,w,s,e,n FROM p2 WHERE px<={PIECE_PIXELS}
 UNION ALL SELECT aoi_id,path,w,s,e,n FROM p3 WHERE px<={PIECE_PIXELS} UNION ALL SELECT aoi_id,path,w,s,e,n FROM p4)),
grd AS (SELECT *, (ge-gw)/gwid AS xres, (gn-gs)/ghei AS yres FROM (SELECT *, greatest(1, CAST(round_even((ge-gw)/(({PIECE_RES!r}::DOUBLE/111320)/greatest(cos(radians((gs+gn)/2)),0.01)),0) AS BIGINT)) AS gwid,
 greatest(1, CAST(round_even((gn-gs)/({PIECE_RES!r}::DOUBLE/111320),0) AS BIGINT)) AS ghei FROM pieces)),
pairs AS (SELECT grd.*, c.*, 8 AS width, 8 AS height FROM grd JOIN elev c ON NOT (c.east<=gw OR c.west>=ge OR c.north<=gs OR c.south>=gn)),
{smooth_cte("'w': WEIGHT, 'v': z[j*width+i+1]", "z", "q.v<>-32767 AND NOT isnan(q.v) AND NOT isinf(q.v)")},
smp AS (SELECT * EXCLUDE (cells), list_sum(list_transform(cells, lambda q: q.w*q.v))/list_sum(list_transform(cells, lambda q: q.w)) AS v,
 CAST(least(least(lon-west,east-lon)/(east-west), least(lat-south,north-lat)/(north-south)) AS FLOAT) AS depth FROM near WHERE list_sum(list_transform(cells, lambda q: q.w)) > 1e-9),
win AS (SELECT aoi_id, path, py, px, {_WIN} AS m FROM smp GROUP BY 1,2,3,4),
agg AS (SELECT aoi_id, path, count(*) AS filled, sum(CAST(round_even(m.v,0) AS BIGINT)) AS sum_v FROM win GROUP BY 1,2)
SELECT aoi_id, path, gwid AS width, ghei AS height, coalesce(filled,0) AS filled, CAST(coalesce(sum_v,0) AS BIGINT) AS sum_v,
 CAST(round_even(100.0::DOUBLE*sum(coalesce(filled,0)) OVER (PARTITION BY aoi_id)/sum(gwid*ghei) OVER (PARTITION BY aoi_id),2) AS DOUBLE) AS area_coverage_pct
FROM grd LEFT JOIN agg USING (aoi_id, path)""")
def r20_split_layers(spark, sf):
    """Areas with too many pixels are painted in pieces, each a grid of its own, and the pieces' coverage is merged to the area's."""
    from ..operators.spatial_join import rect_join
    areas = derived(spark, sf, "aoi").select("aoi_id", "bbox")
    # Areas of equal boxes are split and painted once, as box ``box``.
    boxes = cut_lineage(areas.select("bbox").distinct().withColumn("box", F.monotonically_increasing_id()), "boxes")
    pieces = mo.split_until_fits(spread(boxes.withColumn("res_m", F.lit(PIECE_RES))), "box", PIECE_PIXELS).select("box", F.concat_ws("/", F.transform("path", lambda i: i.cast("string"))).alias("path"), F.col("bbox").alias("piece_bbox"))
    # Each piece is shuffled with the values of its chips: those that win nowhere stay out, and however many chips share a box, few are left.
    chips = cut_lineage(rd.first_of_equal(elevation_chips(spark, sf)), "chips")
    hits = rect_join(pieces, chips.select("item_id", F.col("bbox").alias("item_bbox")), "piece_bbox").withColumn("grid", geo.make_grid(F.col("piece_bbox"), F.lit(PIECE_RES)))
    shares = rd.elevation_shares(hits.select("box", "path", "grid", "item_id").join(chips, "item_id"))
    sums = rd.block_sums(rd.render_blocks(shares, ["box", "path"], 256), ["box", "path"])
    g = pieces.withColumn("g", geo.make_grid(F.col("piece_bbox"), F.lit(PIECE_RES))).join(sums, ["box", "path"], "left").na.fill(0, ["filled", "sum_v"])
    layers = g.groupBy("box").agg(F.expr("bround(100D * sum(filled) / sum(g.pixels), 2)").alias("area_coverage_pct"),
                                  F.expr("collect_list(struct(path, g.width AS width, g.height AS height, filled, sum_v))").alias("p"))
    return (areas.join(shuffled(layers.join(boxes, "box").drop("box")), "bbox").selectExpr("aoi_id", "inline(p)", "area_coverage_pct"))
