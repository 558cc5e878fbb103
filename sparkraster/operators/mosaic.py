"""Mosaics in which the raster a pixel lies deepest inside wins.

Two paths give the same pixels. ``composite`` works on candidate rows and one ``max_by`` aggregate,
which combines map-side, so a pixel under any number of rasters shuffles one row per task.
``render.render_blocks`` composites whole blocks with numpy and is meant for fine grids.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo

NODATA = -32767.0
MAX_PIXELS = 2_000_000_000
MAX_SPLIT_DEPTH = 3


def plan_resolution(pairs: DataFrame, keys: list[str], wanted: str = "res_m", native: str = "native_res_m",
                    default: str = "default_res_m") -> DataFrame:
    """keys -> res_m, n_inputs: the wanted resolution (at least 0.05), else the finest native one, else the default; and the number of rows."""
    return pairs.groupBy(*keys).agg(F.expr(
        f"coalesce(if(max({wanted}) IS NULL, NULL, greatest(max({wanted}), 0.05D)), min(if({native} > 0, {native}, NULL)), max({default}))").alias("res_m"), F.count("*").alias("n_inputs"))


def with_target_pixels(pairs: DataFrame, grid: str = "grid", centres: bool = True) -> DataFrame:
    """One row per output pixel under each raster tile, with py, px, lon, lat and source position.

    With ``centres`` only pixels whose centre lies in the tile, else all that overlap it.

    ``pairs`` has a grid struct and the tile's georeferencing (width, height, a, c, e, f). Pixels are
    listed over the tile's own extent, not its footprint: valid data outside the footprint still
    competes, with a negative depth.
    """
    g = grid
    px = (pairs
            .selectExpr("*", f"explode(sequence(greatest(0, int(floor(({g}.bbox.north - f) / {g}.yres))), "
                             f"greatest(-1, least(int({g}.height) - 1, int(ceil(({g}.bbox.north - (f + e * height)) / {g}.yres)) - 1)))) AS py")
            .selectExpr("*", f"explode(sequence(greatest(0, int(floor((c - {g}.bbox.west) / {g}.xres))), "
                             f"greatest(-1, least(int({g}.width) - 1, int(ceil((c + a * width - {g}.bbox.west) / {g}.xres)) - 1)))) AS px")
            .selectExpr("*", f"{g}.bbox.west + (px + 0.5D) * {g}.xres AS lon", f"{g}.bbox.north - (py + 0.5D) * {g}.yres AS lat")
            .filter("px >= 0 AND py >= 0")
            .selectExpr("*", "(lon - c) / a AS fcol", "(lat - f) / e AS frow"))
    return px.filter("fcol >= 0 AND fcol < width AND frow >= 0 AND frow < height") if centres else px


def touching_grid(pairs: DataFrame, grid: str = "grid") -> DataFrame:
    """Pairs whose tile extent overlaps the grid; others have no pixel to list."""
    g = f"{grid}.bbox"
    return pairs.filter(f"c < {g}.east AND c + a * width > {g}.west AND f > {g}.south AND f + e * height < {g}.north")


def sample_nearest(px: DataFrame, values: str = "z", out: str = "v") -> DataFrame:
    """Value of the source pixel under each target centre; null where it is void."""
    return px.selectExpr("*", f"{values}[int(floor(frow)) * width + int(floor(fcol))] AS _v") \
        .selectExpr("*", f"if(_v = {NODATA}D OR isnan(_v) OR abs(_v) = double('inf'), NULL, _v) AS {out}").drop("_v")


def sample_bilinear(px: DataFrame, values: str = "z", out: str = "v") -> DataFrame:
    """Weighted mean of the four nearest source centres, renormalised over the valid ones.

    Samples without any valid neighbour are dropped. The last step is a generator of none or one row:
    a plain filter would be pushed below the projections and repeat the whole formula there, past what
    can be compiled.
    """
    corners = [(0, 0, "(1D - _dx) * (1D - _dy)"), (1, 0, "_dx * (1D - _dy)"), (0, 1, "(1D - _dx) * _dy"), (1, 1, "_dx * _dy")]
    vals, weights = [], []
    for di, dj, w in corners:
        i, j, v = f"(_i + {di})", f"(_j + {dj})", f"_v{di}{dj}"
        vals.append(f"if({i} >= 0 AND {i} < width AND {j} >= 0 AND {j} < height, nullif({values}[{j} * width + {i}], {NODATA}D), NULL) AS {v}")
        weights.append(f"if({v} IS NULL OR isnan({v}) OR abs({v}) = double('inf'), 0D, {w}) AS _w{di}{dj}")
    ws = " + ".join(f"_w{di}{dj}" for di, dj, _ in corners)
    wv = " + ".join(f"if(_w{di}{dj} > 0, _w{di}{dj} * _v{di}{dj}, 0D)" for di, dj, _ in corners)
    keep = px.columns
    return (px.selectExpr(*keep, "fcol - 0.5D AS _x", "frow - 0.5D AS _y")
            .selectExpr(*keep, "int(floor(_x)) AS _i", "int(floor(_y)) AS _j", "_x - floor(_x) AS _dx", "_y - floor(_y) AS _dy")
            .selectExpr(*keep, "_dx", "_dy", *vals).selectExpr("*", *weights)
            .selectExpr(*keep, f"{ws} AS _ws", f"{wv} AS _wv")
            .selectExpr(*keep, f"explode(if(_ws > 0, array(_wv / _ws), CAST(array() AS array<double>))) AS {out}"))


def sample_smooth(px: DataFrame, values: str = "z", out: str = "v", grid: str = "grid") -> DataFrame:
    """Elevation as layers take it: the area-weighted mean of what a pixel covers if it is over one and a half times as coarse
    as ``native_res_m``, else the weighted mean of the four nearest centres, for pixels whose centre lies in the tile. Void pixels
    weigh nothing; pixels without valid ones are dropped. ``px`` comes from ``with_target_pixels(..., centres=False)``.
    """
    g, keep = grid, px.columns

    def near(axis: str, n: str, lo: str, hi: str, at: str) -> str:
        first, last = f"if(_avg, floor({lo}), floor({at} - 0.5D))", f"if(_avg, ceil({hi}) - 1, floor({at} - 0.5D) + 1)"
        return (f"transform(sequence(int(greatest(0, {first})), int(least({n} - 1, {last}))), k -> struct(k AS k, "
                f"if(_avg, least(k + 1D, {hi}) - greatest(double(k), {lo}), 1D - abs(k + 0.5D - {at})) AS w)) AS _{axis}")
    return (px.selectExpr("*", f"{g}.yres * {geo.METERS_PER_DEG}D / greatest(native_res_m, 1e-9D) > 1.5D AS _avg",
                          f"({g}.bbox.north - py * {g}.yres - f) / e AS _y0", f"({g}.bbox.north - (py + 1) * {g}.yres - f) / e AS _y1",
                          f"({g}.bbox.west + px * {g}.xres - c) / a AS _x0", f"({g}.bbox.west + (px + 1) * {g}.xres - c) / a AS _x1")
            .filter("if(_avg, _y1 > 0 AND _y0 < height AND _x1 > 0 AND _x0 < width, fcol >= 0 AND fcol < width AND frow >= 0 AND frow < height)")
            .selectExpr("*", near("rows", "height", "_y0", "_y1", "frow"), near("cols", "width", "_x0", "_x1", "fcol"))
            .selectExpr(*keep, f"filter(flatten(transform(_rows, r -> transform(_cols, q -> struct(r.w * q.w AS w, {values}[r.k * width + q.k] AS v)))), "
                               f"x -> x.v <> {NODATA}D AND NOT isnan(x.v) AND abs(x.v) < double('inf')) AS _near")
            .selectExpr(*keep, "aggregate(_near, struct(0D AS w, 0D AS v), (s, x) -> struct(s.w + x.w AS w, s.v + x.w * x.v AS v)) AS _sum")
            .filter("_sum.w > 1e-9D").selectExpr(*keep, f"_sum.v / _sum.w AS {out}"))


def with_depth(px: DataFrame, footprint: str = "bbox", clip: str | None = None) -> DataFrame:
    """Float32 interior depth; with clip rings, pixels outside any ring are dropped and depth is
    measured from the footprint cut to the rings."""
    fp = footprint
    if clip:
        px = px.withColumn("_fp", geo.clip_footprint(F.col(clip), F.col(footprint))) \
            .filter(geo.in_all_rings(F.col(clip), F.col("lon"), F.col("lat")))
        fp = "_fp"
    return px.selectExpr("*", f"float(least(least(lon - {fp}.west, {fp}.east - lon) / ({fp}.east - {fp}.west), "
                              f"least(lat - {fp}.south, {fp}.north - lat) / ({fp}.north - {fp}.south))) AS depth")


def composite(candidates: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, py, px -> winning value, its item and depth. Equal depths go to the earlier item."""
    best = f"max_by(struct({value} AS v, item_id, depth), struct(depth, -item_ord)) FILTER (WHERE {value} IS NOT NULL)"
    return (candidates.groupBy(*keys, "py", "px").agg(F.expr(best).alias("_m")).filter("_m IS NOT NULL")
            .select(*keys, "py", "px", "_m.v", "_m.item_id", "_m.depth"))


def coverage(pixels: DataFrame, grids: DataFrame, keys: list[str], grid: str = "grid") -> DataFrame:
    """keys -> filled pixel count and percentage of the grid (two decimals, halves to even)."""
    n = pixels.groupBy(*keys).agg(F.count("*").alias("filled"))
    return (grids.join(n, keys, "left")
            .selectExpr(*grids.columns, "coalesce(filled, 0L) AS filled")
            .selectExpr("*", f"bround(100D * filled / greatest({grid}.pixels, 1L), 2) AS coverage_pct"))


def split_until_fits(areas: DataFrame, key: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Pieces of every area small enough for ``max_pixels``; too-large pieces are split again.

    ``areas`` is (key, bbox, res_m). At most three rounds of splitting follow the first attempt;
    what is still too large then keeps fits = false.
    """
    cur = areas.select(key, "bbox", "res_m", F.array().cast("array<int>").alias("path"))

    def sized(df: DataFrame) -> DataFrame:
        return df.withColumn("_px", geo.make_grid(F.col("bbox"), F.col("res_m")).pixels)
    for _ in range(MAX_SPLIT_DEPTH + 1):  # pieces that fit pass through, so all rounds are one chain over the rows
        cur = sized(cur)
        cols, rows = geo.split_size(F.col("_px") / max_pixels)
        whole = F.array(F.struct(F.lit(None).cast("int").alias("idx"), F.col("bbox").alias("bbox")))
        cur = (cur.withColumn("_c", cols).withColumn("_r", rows)
               .withColumn("_p", F.explode(F.when(F.col("_px") > max_pixels, geo.split_bbox(F.col("bbox"), F.col("_c"), F.col("_r"))).otherwise(whole)))
               .select(key, F.col("_p.bbox").alias("bbox"), "res_m", F.when(F.col("_p.idx").isNull(), F.col("path")).otherwise(F.concat("path", F.array("_p.idx"))).alias("path")))
    return sized(cur).select(key, "bbox", "res_m", "path", F.col("_px").alias("pixels"), (F.col("_px") <= max_pixels).alias("fits"))
