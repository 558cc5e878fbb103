"""Download, time and package-size estimates for many areas at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, tiles
from ..session import shuffled
from ..sources.cells import DOWNLOAD_FRACTION

# Seconds to prepare a new chart, typical archive and imagery tile bytes, windowed-read
# overhead, bytes added per export, megabytes of one elevation cell by level and JPEG bytes per pixel.
SECONDS_PER_NEW_CHART = 3.0
TYPICAL_ZIP_BYTES = 60e6
TYPICAL_IMAGE_BYTES = 20e6
WINDOW_OVERHEAD = 1.3
EXPORT_HEADER_BYTES = 8_000
CELL_MB = {0: 0.04, 1: 2.9, 2: 26.0}
OTHER_CELL_MB = 3.0
JPEG_BYTES_PER_PX = 0.35
WMS_BLOCK = 1024


def envelope(df: DataFrame, keys: list[str], download: str = "todo_bytes", cached: str = "cached_pct", requests: str = "requests",
             seconds: str = "seconds", source: str = "source_bytes", clipped: str = "clipped_bytes") -> DataFrame:
    """Rounded estimate columns; sizes that are unknown stay null, which is not the same as zero.

    Sums are first rounded far below the shown precision, so the order in which tasks add up does
    not decide a tie.
    """
    def mb(c):
        return F.bround(F.round(c, 0) / 1e6, 1)
    return df.select(*keys, mb(download).alias("download_mb"),
                     F.rint(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(cached))), 6)).cast("int").alias("cached_pct"),
                     F.col(requests).cast("long").alias("requests"), F.ceil(F.round(seconds, 6)).cast("long").alias("download_seconds"),
                     mb(source).alias("source_mb"), mb(clipped).alias("clipped_mb"))


def _rated(areas: DataFrame, key: str, rate: float | str) -> tuple[DataFrame, str]:
    """The areas' keys with ``speed_basis``, and the rate as SQL text: a number, or a column of ``areas`` that comes with its basis."""
    if isinstance(rate, str):
        return areas.select(key, F.col(rate).alias("_rate"), "speed_basis"), "_rate"
    return areas.select(key, F.lit("default").alias("speed_basis")), f"{rate}D"


def _own_rate(rate: float | str) -> tuple[str, str]:
    """The basis and the rate as SQL text, for estimates that read the areas' rows themselves."""
    return ("speed_basis", rate) if isinstance(rate, str) else ("'default' AS speed_basis", f"{rate}D")


def _pct(todo: str, total: str) -> str:
    return f"if({total} > 0, 100D * (1 - {todo} / {total}), 100D)"


def chart_estimate(areas: DataFrame, hits: DataFrame, key: str, rate: float | str) -> DataFrame:
    """Charts in shared archives. ``hits`` is (key, bbox, item_bbox, url, zip_bytes, member_bytes, extracted, zip_local).

    An archive counts once per area however many of its charts are hit, so the sum runs in two steps.
    """
    per = (hits.withColumn("frac", geo.overlap_fraction(F.col("bbox"), F.col("item_bbox")))
           .selectExpr("*", f"coalesce(nullif(double(zip_bytes), 0D), {TYPICAL_ZIP_BYTES}D) AS _zip")
           .selectExpr("*", "coalesce(nullif(double(member_bytes), 0D), _zip) AS _mem")
           .groupBy(key, "url").agg(F.expr("max(_zip) AS zip"), F.expr("max(if(NOT extracted AND NOT zip_local, _zip, 0D)) AS get_bytes"),
                                    F.expr("max(int(NOT extracted AND NOT zip_local)) AS get_one"), F.expr("count_if(NOT extracted) AS new_charts"),
                                    F.expr("count(*) AS n"), F.expr("sum(_mem) AS mem"), F.expr("sum(_mem * frac) AS cut")))
    base, speed = _rated(areas, key, rate)
    tot = per.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("zip", "get_bytes", "get_one", "new_charts", "mem", "cut")])
    return (base.join(shuffled(tot), key, "left")
            .selectExpr(key, "speed_basis", "coalesce(get_bytes, 0D) AS todo_bytes", f"if(zip IS NULL, 100D, {_pct('get_bytes', 'zip')}) AS cached_pct", "get_one AS requests",
                        f"coalesce(get_bytes / {speed} + new_charts * {SECONDS_PER_NEW_CHART}D, 0D) AS seconds", "mem AS source_bytes", "cut AS clipped_bytes"))


def fraction_estimate(areas: DataFrame, parts: DataFrame, key: str, rate: float | str) -> DataFrame:
    """Cells or image tiles read whole when mostly covered and by window otherwise.

    ``parts`` is (key, size, frac, cached). ``partial`` counts windowed reads of uncached parts.
    """
    base, speed = _rated(areas, key, rate)
    need = f"if(cached OR frac >= {DOWNLOAD_FRACTION}D, size, size * frac * {WINDOW_OVERHEAD}D)"
    tot = parts.selectExpr(key, "size", "frac", "cached", f"{need} AS need").groupBy(key).agg(
        F.expr("count(*) AS n"), F.expr("sum(need) AS total"), F.expr("sum(if(cached, 0D, need)) AS todo"), F.expr("sum(size) AS src"),
        F.expr("sum(size * frac) AS cut"), F.expr(f"count_if(NOT cached AND frac < {DOWNLOAD_FRACTION}D) AS partial"))
    return (base.join(shuffled(tot), key, "left")
            .selectExpr(key, "speed_basis", "coalesce(todo, 0D) AS todo_bytes", f"if(n IS NULL, 100D, {_pct('todo', 'total')}) AS cached_pct", "n AS requests",
                        f"coalesce(todo, 0D) / {speed} AS seconds", "coalesce(src, 0D) AS source_bytes", "coalesce(cut, 0D) AS clipped_bytes", "coalesce(partial, 0L) AS partial"))


def export_estimate(areas: DataFrame, chunks: DataFrame, key: str, px_bytes: str, rate: float | str) -> DataFrame:
    """Server exports. ``chunks`` is (key, w, h, got, px_bytes); areas outside the extent have none and cost nothing."""
    base, speed = _rated(areas, key, rate)
    tot = chunks.selectExpr(key, "got", f"double(w * h * {px_bytes} + {EXPORT_HEADER_BYTES}) AS size").groupBy(key).agg(
        F.expr("count(*) AS n"), F.expr("sum(size) AS total"), F.expr("sum(size * (1 - got)) AS todo"), F.expr("sum(1 - got) AS chunks_todo"))
    return (base.join(shuffled(tot), key, "left")
            .selectExpr(key, "speed_basis", "coalesce(todo, 0D) AS todo_bytes", f"if(n IS NULL, 100D, {_pct('todo', 'total')}) AS cached_pct", "n AS requests",
                        f"coalesce(chunks_todo, 0D) / {speed} AS seconds", "coalesce(total, 0D) AS source_bytes", "coalesce(total, 0D) AS clipped_bytes"))


def tile_estimate(areas: DataFrame, counts: DataFrame, key: str, tile_bytes: float, rate: float | str) -> DataFrame:
    """XYZ tiles: ``areas`` is (key, bbox, z) and, if ``rate`` is a column of it, its speed_basis; ``counts`` is (key, cached) from the cache inventory."""
    x0, y0 = tiles.lonlat_to_tile(F.col("bbox.west"), F.col("bbox.north"), F.col("z"))
    x1, y1 = tiles.lonlat_to_tile(F.col("bbox.east"), F.col("bbox.south"), F.col("z"))
    n = (F.abs(x1 - x0) + 1) * (F.abs(y1 - y0) + 1)
    basis, speed = _own_rate(rate)
    return (areas.withColumn("n", n).join(shuffled(counts.select(key, "cached")), key, "left")
            .selectExpr(key, "n", "coalesce(cached, 0L) AS have", basis, f"{speed} AS _speed")
            .selectExpr(key, "speed_basis", f"(n - have) * {tile_bytes}D AS todo_bytes", "100D * have / n AS cached_pct", "n AS requests",
                        "(n - have) / _speed AS seconds", f"n * {tile_bytes}D * 1.1D AS source_bytes", f"n * {tile_bytes}D * 1.1D AS clipped_bytes"))


def wms_estimate(areas: DataFrame, key: str, res: Column, kind: Column, rate: float | str) -> DataFrame:
    """Map images asked for in blocks of 1024 pixels; nothing is assumed to be cached. ``rate`` may be a column of ``areas`` that comes with its speed_basis."""
    w, h = geo.grid_size(F.col("bbox"), res)
    px = F.when(kind == "elevation", F.lit(4.0)).otherwise(F.lit(JPEG_BYTES_PER_PX))
    basis, speed = _own_rate(rate)
    return (areas.withColumn("_w", w).withColumn("_h", h).withColumn("_px", px)
            .selectExpr(key, basis, f"{speed} AS _speed", f"bigint(ceil(_w / {WMS_BLOCK}) * ceil(_h / {WMS_BLOCK})) AS requests", "_w * _h * _px AS todo_bytes")
            .selectExpr(key, "speed_basis", "todo_bytes", "0D AS cached_pct", "requests", "requests / _speed AS seconds", "todo_bytes * 1.1D AS source_bytes", "todo_bytes * 1.1D AS clipped_bytes"))


def library_estimate(areas: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Files on disk: nothing to download; totals are null as soon as one size is unknown."""
    tot = (hits.withColumn("frac", geo.overlap_fraction(F.col("bbox"), F.col("item_bbox"), 1e-12)).groupBy(key)
           .agg(F.expr("if(bool_or(size_bytes IS NULL), NULL, sum(double(size_bytes))) AS src"),
                F.expr("if(bool_or(size_bytes IS NULL), NULL, sum(size_bytes * frac)) AS cut"), F.expr("count(*) AS n")))
    return (areas.select(key).join(shuffled(tot), key, "left")
            .selectExpr(key, "0D AS todo_bytes", "100D AS cached_pct", "if(n IS NULL, NULL, 0L) AS requests", "0D AS seconds",
                        "if(n IS NULL, 0D, src) AS source_bytes", "if(n IS NULL, 0D, cut) AS clipped_bytes"))


def merge_sizes(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: freshly found sizes replace known ones of the same key."""
    both = known.withColumn("_p", F.lit(0)).unionByName(found.withColumn("_p", F.lit(1)))
    return both.groupBy(key).agg(F.max_by("size", "_p").alias("size"))


def layer_sizes(layers: DataFrame, max_pixels: int) -> DataFrame:
    """Grid, raster estimate, too-big flag and package size of each layer.

    ``layers`` is (bbox, kind, resampling, res_m, mode, geotiff, cog, mbtiles, cell_level, source_mb, clipped_mb).
    """
    w, h = geo.grid_size(F.col("bbox"), F.col("res_m"))
    cell_mb = F.when(F.col("cell_level").isNull(), F.lit(0.0))
    for lvl, mb in CELL_MB.items():
        cell_mb = cell_mb.when(F.col("cell_level") == lvl, F.lit(mb))
    return (layers.withColumn("width", w).withColumn("height", h).withColumn("_cell", cell_mb.otherwise(F.lit(OTHER_CELL_MB)))
            .selectExpr("*", "width * height AS pixels", "(ceil(bbox.east) - floor(bbox.west)) * (ceil(bbox.north) - floor(bbox.south)) AS n_cells")
            .selectExpr("*", "bround(round(pixels * if(kind = 'elevation', 4, 3) * if(kind = 'rgb' AND resampling <> 'nearest', 0.08D, 0.3D) * 1.33D / 1e6D, 6), 1) AS est_mb",
                        f"mode = 'mosaic' AND pixels > {max_pixels} AS too_big")
            .selectExpr("*", "CASE mode WHEN 'original' THEN coalesce(source_mb, clipped_mb, est_mb) WHEN 'clipped' THEN coalesce(clipped_mb, est_mb) ELSE "
                             "est_mb * (geotiff + cog + if(mbtiles = 1 AND kind = 'rgb', 1.1D, 0D)) + if(kind = 'elevation', n_cells * _cell, 0D) END AS _pkg")
            .selectExpr("*", "bround(round(_pkg, 6), 1) AS package_mb").drop("_pkg", "_cell"))


def area_km(totals: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Totals with the sides of each area's box in km, to one digit."""
    w, h = geo.size_m(F.col("bbox"))
    sides = areas.select(key, *[F.bround(F.round(x / 1000, 6), 1).alias(c) for x, c in ((w, "width_km"), (h, "height_km"))])
    return totals.join(shuffled(sides), key)


def job_totals(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per job; a layer whose estimate failed counts as zero. Layers run one after another, so times add up."""
    return layers.groupBy(*keys).agg(
        F.count("*").alias("n_layers"), F.expr("bround(round(sum(coalesce(download_mb, 0D)), 6), 1) AS total_download_mb"),
        F.expr("bigint(sum(coalesce(download_seconds, 0L))) AS total_download_seconds"), F.expr("bround(round(sum(package_mb), 6), 1) AS total_package_mb"),
        F.expr("bool_or(too_big) AS any_too_big"), F.expr("count_if(download_mb IS NULL) AS failed_estimates"))
