"""Tile tables: web pyramids of all zooms, mosaics from overview levels, and tiles through the committing sink."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import render as rd
from ..operators import resample as rs
from ..session import shared_dir
from ..sources import tilestore as ts
from .inputs import ELEV_CTE, elevation_chips, r6
from .q_mosaic import _GRID_CTE, _PX_CTE, _WIN
from .q_raster import web_base_sql
from .registry import query

ZOOM = 6


def web_pixels(spark, sf):
    """The finest zoom of the chips' web pyramid: row, col, v."""
    return ts.web_mosaic(elevation_chips(spark, sf), ZOOM)


@query("s34_all_zooms", "WITH " + ELEV_CTE + web_base_sql() + "".join(f""",
m{z} AS (SELECT gy//2 AS gy, gx//2 AS gx, avg(v) AS v FROM {'m' if z == ZOOM - 1 else f'm{z + 1}'} GROUP BY 1,2)""" for z in range(ZOOM - 1, -1, -1)) + """
SELECT z, CAST(gx//256 AS INT) AS x, CAST(gy//256 AS INT) AS y, count(*) AS valid, round(sum(v),2) AS total, round(sum(v*((gy%256*256+gx%256)%97)),1) AS placed FROM (
 SELECT 6 AS z, * FROM m""" + "".join(f" UNION ALL SELECT {z}, * FROM m{z}" for z in range(ZOOM)) + ") GROUP BY 1,2,3")
def s34_all(spark, sf):
    """The pyramid from the finest zoom down to one tile of the world, each zoom from the tiles of the one before."""
    tiles = ts.write_pyramid(spark, web_pixels(spark, sf), ZOOM, shared_dir(spark, "pyramid"))
    return ts.tile_sums(tiles, ["z", "x", "y"]).select("z", "x", "y", "valid", F.round("total", 2).alias("total"), F.round("placed", 1).alias("placed"))


LEVELS = 2
_LEVEL_SQL = "WITH " + ELEV_CTE + "," + _GRID_CTE.replace("(VALUES (0, 5000.0::DOUBLE), (1, 12000.0::DOUBLE))", "(VALUES (0, 15000.0::DOUBLE), (1, 40000.0::DOUBLE))") + """,
px0 AS (SELECT item_id, CAST((i-1)//8 AS INT) AS row, CAST((i-1)%8 AS INT) AS col, v FROM (SELECT item_id, unnest(z) AS v, generate_subscripts(z,1) AS i FROM elev) WHERE v<>-32767),
px1 AS (SELECT item_id, row//2 AS row, col//2 AS col, avg(v) AS v FROM px0 GROUP BY 1,2,3), px2 AS (SELECT item_id, row//2 AS row, col//2 AS col, avg(v) AS v FROM px1 GROUP BY 1,2,3),
lev AS (SELECT elev.* EXCLUDE (z, a, e), grd.*, CASE WHEN native*4<=yres*111320*1.01 THEN 2 WHEN native*2<=yres*111320*1.01 THEN 1 ELSE 0 END AS lv, a, e FROM (
 SELECT *, abs(a)*111320*greatest(cos(radians((south+north)/2)),0.1) AS native FROM elev) elev JOIN grd ON odd = layer%2),
cell AS (SELECT item_id, 0 AS lv, row, col, v FROM px0 UNION ALL SELECT item_id, 1, row, col, v FROM px1 UNION ALL SELECT item_id, 2, row, col, v FROM px2),
gap AS (SELECT lev.item_id, lv, r.range AS row, q.range AS col FROM lev, range(8) r, range(8) q WHERE r.range < (8>>lv) AND q.range < (8>>lv)),
arr AS (SELECT item_id, list(coalesce(v, -32767) ORDER BY row, col) AS z FROM gap LEFT JOIN cell USING (item_id, lv, row, col) GROUP BY 1),
pairs AS (SELECT lev.* EXCLUDE (a, e), a*(1<<lv) AS a, e*(1<<lv) AS e, z, 8>>lv AS width, 8>>lv AS height FROM lev JOIN arr USING (item_id)),""" + _PX_CTE


@query("w02_level_mosaic", _LEVEL_SQL + f"""
SELECT layer, CAST(py AS INT) AS py, CAST(px AS INT) AS px, round(m.v,4) AS v, m.item_id AS item_id FROM (SELECT layer, py, px, {_WIN} AS m FROM smp GROUP BY 1,2,3)""")
def w02_levels(spark, sf):
    """A mosaic of coarse layers from the overview level that each chip's ratio asks for."""
    chips = elevation_chips(spark, sf)
    store = ts.write_levels(chips, LEVELS, shared_dir(spark, "levels"))
    res = F.when(F.col("layer") % 2 == 0, F.lit(15000.0)).otherwise(F.lit(40000.0))
    pairs = chips.drop("z", "width", "height").withColumn("grid", geo.make_grid(geo.make_bbox(-100.0, 30.0, -75.0, 41.0), res))
    pairs = pairs.withColumn("native_res_m", geo.native_res_m(F.lit("geographic"), F.col("a"), geo.center_lat(F.col("bbox")))).withColumn("target_res_m", F.col("grid.yres") * geo.METERS_PER_DEG)
    best = ts.at_best_level(pairs, store, LEVELS)
    native = F.col("native_res_m")
    shares = rd.elevation_shares(best.withColumn("_native", native)).withColumn("native_res_m", F.col("_native"))
    return rd.block_pixels(rd.render_blocks(shares, ["layer"], 128), ["layer"], 128, ["v"]).select("layer", "py", "px", r6("v", "v", 4), F.col("item_ord").alias("item_id"))


@query("s33_committed_tiles", """WITH """ + ELEV_CTE + """,
p AS (SELECT layer, CAST((i-1)//8 AS INT)+8*CAST(item_id%40 AS INT) AS py, CAST((i-1)%8 AS INT)+8*CAST(item_id//40 AS INT) AS px, v FROM (SELECT layer, item_id, unnest(z) AS v, generate_subscripts(z,1) AS i FROM elev))
SELECT layer, CAST(py//64 AS INT) AS tile_row, CAST(px//64 AS INT) AS tile_col, CAST(py%64*64+px%64 AS INT) AS i, round(v,6) AS v FROM p WHERE v<>-32767""")
def s33_committed(spark, sf):
    """Mosaic tiles written through the data source, whose files count once its commit record stands, and read back pixel by pixel."""
    p = (elevation_chips(spark, sf).selectExpr("layer", "item_id", "posexplode(z) AS (i, v)")
         .selectExpr("layer", "int(floor(i / 8)) + 8 * int(item_id % 40) AS py", "i % 8 + 8 * int(item_id div 40) AS px", "v").filter("v <> -32767"))
    path = shared_dir(spark, "tiles")
    spark.dataSource.register(ts.TileSink)
    rs.tile_rows(p, ["layer"], 64).write.format("tiles").mode("append").save(path)
    return ts.committed(spark, path).selectExpr("layer", "tile_row", "tile_col", "posexplode(data) AS (i, v)").filter("v IS NOT NULL").withColumn("v", F.round("v", 6))
