"""One-degree elevation cells: enumeration, object names, existence and how each is read."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

DOWNLOAD_FRACTION = 0.25   # cells covered at least this far are fetched whole
TYPICAL_BYTES = 15e6


def cells(areas: DataFrame, box: str = "bbox") -> DataFrame:
    """areas x (lat, lon) south-west corners of every cell they touch, however many."""
    return (areas.selectExpr("*", f"explode(sequence(int(floor({box}.south)), int(ceil({box}.north)) - 1)) AS lat")
            .selectExpr("*", f"explode(sequence(int(floor({box}.west)), int(ceil({box}.east)) - 1)) AS lon"))


def cell_box(lat: Column, lon: Column) -> Column:
    return geo.make_bbox(lon, lat, lon + 1, lat + 1)


def object_name(lat: Column, lon: Column, arcsec: int) -> Column:
    """Object path of a cell in the 30 m or 90 m bucket."""
    # Bucket and resolution code per product.
    bucket, code = {30: ("copernicus-dem-30m", "10"), 90: ("copernicus-dem-90m", "30")}[arcsec]
    name = F.format_string(f"Copernicus_DSM_COG_{code}_%s%02d_00_%s%03d_00_DEM", F.when(lat >= 0, F.lit("N")).otherwise(F.lit("S")), F.abs(lat),
                           F.when(lon >= 0, F.lit("E")).otherwise(F.lit("W")), F.abs(lon))
    return F.concat(F.lit(f"{bucket}/"), name, F.lit("/"), name, F.lit(".tif"))


def with_state(area_cells: DataFrame, sizes: DataFrame, cached: DataFrame, box: str = "bbox") -> DataFrame:
    """Existing cells with size, covered fraction and cached flag. Size 0 means no such cell, a missing
    size means unknown and takes the typical one."""
    frac = geo.overlap_fraction(F.col(box), cell_box(F.col("lat"), F.col("lon")))
    return (area_cells.join(sizes, ["lat", "lon"], "left").join(cached.select("lat", "lon").distinct().withColumn("cached", F.lit(True)), ["lat", "lon"], "left")
            .withColumn("size", F.coalesce(F.col("size").cast("double"), F.lit(TYPICAL_BYTES))).filter("size > 0")
            .withColumn("cached", F.coalesce("cached", F.lit(False))).withColumn("frac", frac))


def read_path(cached: Column, frac: Column, local: Column, remote: Column) -> Column:
    """Whole local file when cached or mostly covered, else a windowed remote read."""
    return F.when(cached | (frac >= DOWNLOAD_FRACTION), local).otherwise(F.concat(F.lit("/vsicurl/"), remote))
