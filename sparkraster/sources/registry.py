"""Built-in source dimension, detail levels, categories and the source plug-in table."""
from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Chart products as id, page, archive pattern, member pattern, default metres, category.
PRODUCTS = [
    ("faa-sectional", "vfr", r"^sectional-files/", r" SEC\.tif$", 42.0, "vfr"),
    ("faa-tac", "vfr", r"^tac-files/", r" TAC\.tif$", 21.0, "vfr"),
    ("faa-flyway", "vfr", r"^tac-files/", r" FLY\.tif$", 21.0, "vfr"),
    ("faa-heli", "vfr", r"^heli_files/", r"\.tif$", 10.0, "vfr"),
    ("faa-caribbean", "vfr", r"^Caribbean/", r"\.tif$", 42.0, "vfr"),
    ("faa-grand-canyon", "vfr", r"^grand_canyon_files/", r"\.tif$", 21.0, "vfr"),
    ("faa-ifr-low", "ifr", r"^(enr_l\d+|DELCB\w*_tif|DELCBA\w*_tif)\.zip$", r"^ENR_C?L\w*\.tif$", 60.0, "ifr"),
    ("faa-ifr-high", "ifr", r"^(enr_h\d+|DEHCB\w*_tif)\.zip$", r"^ENR_C?H\w*\.tif$", 120.0, "ifr"),
    ("faa-ifr-area", "ifr", r"^enr_a\d+\.zip$", r"\.tif$", 25.0, "ifr"),
    ("faa-ifr-alaska", "ifr", r"^enr_ak[lh]\d+\.zip$", r"\.tif$", 60.0, "ifr"),
    ("faa-ifr-pacific", "ifr", r"^enr_p\d+\.zip$", r"\.tif$", 60.0, "ifr"),
    ("faa-ifr-oceanic", "ifr", r"^(narc|porc|watrs)_tif\.zip$", r"\.tif$", 300.0, "ifr"),
]


def tile_min_res(zoom: int) -> float:
    return round(2 * math.pi * 6_378_137.0 / 256 / 2 ** zoom, 2)


# Service sources as id, kind, category, default metres, finest metres, max zoom, service,
# extent (west, south, east, north) or None, bytes per exported pixel or None, licence class.
SERVICES = [
    ("usgs-naip", "rgb", "imagery", 1.0, 0.3, None, "export", (-125.0, 24.0, -66.5, 49.5), 3, "public domain"),
    ("usgs-imagery", "rgb", "imagery", 2.0, tile_min_res(16), 16, "xyz", None, None, "public domain"),
    ("esri-world-imagery", "rgb", "imagery", 2.0, tile_min_res(19), 19, "xyz", None, None, "provider terms"),
    ("s2cloudless-2024", "rgb", "imagery", 10.0, tile_min_res(15), 15, "xyz", None, None, "CC BY-NC-SA 4.0"),
    ("s2cloudless-2016", "rgb", "imagery", 10.0, tile_min_res(15), 15, "xyz", None, None, "CC BY 4.0"),
    ("copernicus-dem-30", "elevation", "elevation", 30.0, 30.0, None, "cells", None, None, "Copernicus DEM"),
    ("copernicus-dem-90", "elevation", "elevation", 90.0, 90.0, None, "cells", None, None, "Copernicus DEM"),
    ("usgs-3dep", "elevation", "elevation", 10.0, 1.0, None, "export", (-180.0, -15.0, -60.0, 72.0), 4, "public domain"),
    ("maxar-open-data", "rgb", "imagery", 0.5, 0.3, None, "stac", None, None, "CC BY-NC 4.0"),
]
# Detail levels that are listed per source, coarse to fine.
LEVELS = {
    "usgs-naip": [("overview", 10.0), ("area", 3.0), ("detailed", 1.0), ("max", 0.6)],
    "usgs-imagery": [("overview", 20.0), ("area", 5.0), ("detailed", 2.5)],
    "esri-world-imagery": [("overview", 20.0), ("area", 5.0), ("detailed", 2.0), ("max", 0.3)],
    "s2cloudless-2024": [("overview", 40.0), ("native", 10.0)],
    "s2cloudless-2016": [("overview", 40.0), ("native", 10.0)],
    "copernicus-dem-30": [("overview", 90.0), ("native", 30.0)],
    "copernicus-dem-90": [("native", 90.0)],
    "usgs-3dep": [("overview", 30.0), ("area", 10.0), ("detailed", 3.0), ("max", 1.0)],
    "maxar-open-data": [("native", 0.3)],
}
SOURCE_COLUMNS = ("source_no int, source_id string, kind string, category string, access string, default_res_m double, min_res_m double, "
                  "resampling string, max_zoom int, service string, west double, south double, east double, north double, px_bytes int, license string")


def source_rows() -> list[tuple]:
    """Every built-in source, numbered in registry order; charts first."""
    none4 = (None,) * 4
    charts = [(pid, "rgb", cat, "public", res, res / 2, "nearest", None, "charts", *none4, None, "public domain")
              for pid, _, _, _, res, cat in PRODUCTS]
    services = [(sid, kind, cat, "public", res, fine, "bilinear", zoom, service, *(extent or none4), px, lic)
                for sid, kind, cat, res, fine, zoom, service, extent, px, lic in SERVICES]
    return [(i, *r) for i, r in enumerate(charts + services)]


def sources(spark: SparkSession) -> DataFrame:
    """The dimension of 21 rows; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame(source_rows(), SOURCE_COLUMNS)


def levels(spark: SparkSession) -> DataFrame:
    """Detail levels of the built-in sources: charts at twice and once their scale, others as listed."""
    rows = [(pid, i, name, round(res * f, 3)) for pid, _, _, _, res, _ in PRODUCTS for i, (name, f) in enumerate([("overview", 2), ("native", 1)])]
    rows += [(sid, i, name, res) for sid, ls in LEVELS.items() for i, (name, res) in enumerate(ls)]
    return spark.createDataFrame(rows, "source_id string, level_ord int, level string, res_m double")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one registered last; combines map-side, so a key of any size is fine."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def generic_levels(kind: Column, default_res: Column, min_res: Column) -> Column:
    """Array of (level, res_m) around a source's own resolution, none finer than it offers."""
    d = F.when(F.coalesce(default_res, F.lit(0.0)) == 0, F.lit(10.0)).otherwise(default_res)

    def lv(name, f):
        return F.struct(F.lit(name).alias("level"), F.round(d * f, 3).alias("res_m"))
    all_ = F.when(kind == "elevation", F.array(lv("overview", 4), lv("native", 1))) \
        .otherwise(F.array(lv("overview", 8), lv("area", 3), lv("native", 1)))
    return F.filter(all_, lambda l: l.res_m >= F.coalesce(min_res, F.lit(0.0)) * 0.999)


def level_label(res: Column, kind: Column) -> Column:
    # Lowest metres of each class, coarse to fine, and the class below all of them.
    elevation, imagery = [(60, "standard"), (20, "detailed"), (5, "high")], \
        [(20, "overview"), (8, "regional"), (3, "area"), (1.5, "detailed"), (0.9, "verydetailed")]

    def chain(steps):
        return reduce(lambda acc, s: acc.when(res >= s[0], F.lit(s[1])), steps[1:], F.when(res >= steps[0][0], F.lit(steps[0][1]))).otherwise(F.lit("max"))
    return F.when(kind == "elevation", chain(elevation)).otherwise(chain(imagery))


def derived_levels(kind: Column, default_res: Column, min_res: Column) -> Column:
    """Array of (label, res_m): fixed steps plus the source's own, one per label, the coarsest of each."""
    fine = F.when(min_res < 0.9, F.array(min_res)).otherwise(F.array().cast("array<double>"))
    steps = F.when(kind == "elevation", F.array(*map(F.lit, (90.0, 30.0, 10.0, 1.0)))) \
        .otherwise(F.concat(F.array(*map(F.lit, (30.0, 10.0, 4.0, 2.0, 1.0))), fine))
    steps = F.filter(steps, lambda r: r >= F.coalesce(min_res, F.lit(0.0)) * 0.999)
    own = F.exists(steps, lambda r: F.abs(r - default_res) < 1e-6)
    steps = F.when((default_res > 0) & ~own, F.concat(steps, F.array(default_res))).otherwise(steps)
    ordered = F.reverse(F.array_sort(F.array_distinct(steps)))
    empty = F.array().cast("array<struct<label:string,res_m:double>>")
    return F.aggregate(ordered, empty, lambda acc, r: F.when(
        F.exists(acc, lambda a: a.label == level_label(r, kind)), acc).otherwise(
        F.concat(acc, F.array(F.struct(level_label(r, kind).alias("label"), r.alias("res_m"))))))


def category(explicit: Column, access: Column, source_id: Column, group: Column, kind: Column) -> Column:
    custom = source_id.rlike("^ep-") | F.coalesce(group, F.lit("")).rlike("(?i)custom|nga|controlled")
    return F.coalesce(explicit, F.when(access == "local", F.lit("local")).when(custom, F.lit("custom"))
                      .when(source_id.startswith("faa-ifr"), F.lit("ifr")).when(source_id.startswith("faa-"), F.lit("vfr"))
                      .when(kind == "elevation", F.lit("elevation")).otherwise(F.lit("imagery")))


# ---------------------------------------------------------------------------- plug-ins
CatalogFn = Callable[[DataFrame], DataFrame]
PLUGINS: dict[str, CatalogFn] = {}
CATALOG_COLUMNS = ["aoi_id", "source_id", "item_id", "path", "label", "kind", "item_bbox", "native_res_m", "service"]


def register_source(source_id: str, fn: CatalogFn) -> None:
    """A source is a function from areas (aoi_id, bbox) to catalogue rows; the last one registered wins."""
    PLUGINS[source_id] = fn


def catalog_for(areas: DataFrame, plugins: dict[str, CatalogFn] | None = None) -> DataFrame:
    """Catalogue rows of every plug-in for the given areas, in one relation."""
    parts = [fn(areas).withColumn("source_id", F.lit(sid)).select(*CATALOG_COLUMNS)
             for sid, fn in (PLUGINS if plugins is None else plugins).items()]
    return reduce(DataFrame.unionByName, parts)
