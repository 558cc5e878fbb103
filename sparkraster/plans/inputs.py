"""Inputs derived from the test tables.

The tables hold no rasters, so areas, catalogues, chips, file lists and logs are computed from
them by rule, over every row. One expression text serves Spark and the SQL twins, which keeps
both sides on the same input; everything after that is written twice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..session import deal, spread  # noqa: F401, plans take it from here


def _lonlat(key: str) -> dict[str, str]:
    return {"west": f"-100 + CAST(({key}*71)%2400 AS DOUBLE)/100", "south": f"30 + CAST(({key}*29)%1000 AS DOUBLE)/100"}


_FOLDER = ("CASE WHEN doc_id%17=0 THEN concat(source,'/.cache') "
           "WHEN doc_id%60=7 THEN concat(source,'/d7/g',CAST(CAST(floor(doc_id/60) AS INT) AS STRING),'/sub') "
           "WHEN doc_id%20=7 THEN concat(source,'/d7/g',CAST(CAST(floor(doc_id/60) AS INT) AS STRING)) "
           "WHEN doc_id%20=13 THEN concat(source,'/d13/x',CAST(CAST(floor(doc_id/100) AS INT) AS STRING)) "
           "WHEN doc_id%20=5 THEN source ELSE concat(source,'/d',CAST(doc_id%20 AS STRING)) END")
_EXT = ("CASE doc_id%8 WHEN 0 THEN '.tif' WHEN 1 THEN '.ntf' WHEN 2 THEN '.dt0' WHEN 3 THEN '.DT1' WHEN 4 THEN '.jp2' "
        "WHEN 5 THEN '.txt' WHEN 6 THEN '.htm' ELSE '.TIFF' END")

# name -> list of steps; each step is (source table or None for the previous step, columns)
STEPS: dict[str, tuple[str, list[dict[str, str]]]] = {
    "aoi": ("customer", [
        {"aoi_id": "c_custkey", **_lonlat("c_custkey"), "k": "c_custkey", "seg": "c_mktsegment"},
        {"aoi_id": "aoi_id", "west": "west", "south": "south", "east": "west + 0.2 + CAST(k%25 AS DOUBLE)/10",
         "north": "south + 0.2 + CAST(k%20 AS DOUBLE)/10", "seg": "seg"}]),
    "catalog": ("supplier", [
        {"item_id": "s_suppkey", "west": "-100 + CAST((s_suppkey*37)%240 AS DOUBLE)/10",
         "south": "30 + CAST((s_suppkey*53)%100 AS DOUBLE)/10", "bal": "s_acctbal", "nat": "s_nationkey", "label": "s_name"},
        {"item_id": "item_id", "item_ord": "item_id", "source_id": "concat('local-', CAST(nat%6 AS STRING))",
         "path": "concat('/lib/', CAST(nat AS STRING), '/', label, '.tif')", "label": "label",
         "kind": "CASE WHEN nat%6<2 THEN 'elevation' ELSE 'rgb' END",
         "west": "west", "south": "south", "east": "west + 0.7 + CAST(item_id%40 AS DOUBLE)/10",
         "north": "south + 0.6 + CAST(item_id%30 AS DOUBLE)/10",
         "native_res_m": "CASE WHEN item_id%7=0 THEN NULL ELSE CAST(10+5*(item_id%9) AS DOUBLE) END",
         "size_bytes": "CASE WHEN item_id%11=0 THEN NULL ELSE CAST(floor(abs(bal)*1000) AS BIGINT) END",
         "service": "item_id%13=0"}]),
    "chips": ("embeddings", [
        {"item_id": "vec_id", "layer": "label", "west": "-100 + CAST((vec_id*137)%2400 AS DOUBLE)/100",
         "south": "30 + CAST((vec_id*59)%1000 AS DOUBLE)/100", "embedding": "embedding"},
        {"item_id": "item_id", "layer": "layer", "west": "west", "south": "south",
         "east": "west + 0.4 + CAST(item_id%5 AS DOUBLE)/10", "north": "south + 0.4 + CAST(item_id%4 AS DOUBLE)/10",
         "embedding": "embedding"}]),
    "requests": ("orders", [
        {"job_id": "o_orderkey", "aoi_id": "o_custkey", "source_no": "CAST(o_orderkey%23 AS INT)",
         "res_m": "CASE WHEN o_orderkey%4=0 THEN NULL WHEN o_orderkey%50=3 THEN CAST(-1 AS DOUBLE) ELSE CAST(5*(1+o_orderkey%12) AS DOUBLE) END",
         "mode": "CASE o_orderstatus WHEN 'O' THEN 'mosaic' WHEN 'F' THEN 'clipped' ELSE 'original' END",
         "geotiff": "CAST(o_orderkey%5<>0 AS INT)", "cog": "CAST(o_orderkey%3=0 AS INT)", "mbtiles": "CAST(o_orderkey%7=0 AS INT)",
         "cell_level": "CASE WHEN o_orderkey%2=0 THEN CAST(o_orderkey%3 AS INT) ELSE NULL END"}]),
    "samples": ("events", [
        {"key": "concat('bytes:host', CAST(user_id%20 AS STRING))", "amount": "value*10000",
         "seconds": "CAST(event_id%100 AS DOUBLE)/10", "ts": "ts", "seq": "event_id"}]),
    "progress": ("events", [
        {"job_id": "user_id%20", "tile": "CAST(event_id%8 AS INT)", "n_tiles": "8",
         "frac": "CASE WHEN event_type='error' THEN NULL WHEN event_id%9=0 THEN CAST(1 AS DOUBLE) WHEN event_id%9=1 THEN CAST(0 AS DOUBLE) "
                 "WHEN value/400>1 THEN CAST(1 AS DOUBLE) ELSE value/400 END",
         "msg": "concat(event_type, ' ', CAST(CAST(floor(value/40) AS INT) AS STRING))", "ts": "ts", "seq": "event_id"}]),
    "points": ("events", [
        {"point_id": "event_id", "lon": "-100 + CAST((event_id*71)%2400 AS DOUBLE)/100",
         "lat": "30 + CAST((event_id*29)%1000 AS DOUBLE)/100"}]),
    "files": ("documents", [
        {"doc_id": "doc_id", "root": "source", "folder": _FOLDER,
         "name": f"CASE WHEN doc_id%60=47 THEN 'A.TOC' WHEN doc_id%100=13 THEN 'TOC.xml' ELSE concat(CAST(doc_id AS STRING), {_EXT}) END",
         "length": "n_chars",
         "dtype": "CASE doc_id%5 WHEN 0 THEN 'uint8' WHEN 1 THEN 'int16' WHEN 2 THEN 'float32' WHEN 3 THEN 'uint16' ELSE 'int32' END",
         "count": "CASE WHEN doc_id%3=0 THEN 3 ELSE 1 END", "palette": "doc_id%7=0", "has_crs": "doc_id%19<>0",
         "geographic": "doc_id%2=0", "pixel": "CASE WHEN doc_id%2=0 THEN CAST(1+doc_id%40 AS DOUBLE)/10000 ELSE CAST(5+doc_id%50 AS DOUBLE) END",
         **_lonlat("doc_id")},
        {"doc_id": "doc_id", "root": "root", "folder": "folder", "name": "name", "path": "concat(folder, '/', name)", "length": "length",
         "dtype": "dtype", "count": "count", "palette": "palette", "has_crs": "has_crs", "geographic": "geographic", "pixel": "pixel",
         "west": "west", "south": "south", "east": "west + CAST(0.5 AS DOUBLE)", "north": "south + CAST(0.25 AS DOUBLE)"}]),
}


def _sql(name: str) -> str:
    table, steps = STEPS[name]
    src = table
    for cols in steps:
        src = "(SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in cols.items()) + f" FROM {src})"
    return f"{name} AS {src}"


def ctes(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` text of derived inputs for a SQL twin."""
    return "WITH " + ",\n".join(_sql(n) for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Derived input; west, south, east, north are packed into one ``bbox`` struct."""
    source, steps = STEPS[name]
    df = table(spark, sf_dir, source)
    for cols in steps:
        df = df.select(*[F.expr(e).alias(c) for c, e in cols.items()])
    if {"west", "south", "east", "north"} <= set(df.columns):
        df = df.withColumn("bbox", geo.make_bbox("west", "south", "east", "north")).drop("west", "south", "east", "north")
    return df


def flat(bbox: str = "bbox", prefix: str = "", digits: int = 6):
    """The four sides of a box as rounded top-level columns."""
    return [F.round(F.col(f"{bbox}.{s}"), digits).alias(prefix + s) for s in ("west", "south", "east", "north")]


def r6(c, name: str, digits: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), digits).alias(name)


# Elevation chips: 8 x 8 values per vector, -32767 where a value is void.
NODATA = -32767.0


def chip_georef(box: str = "bbox") -> list[Column]:
    """width, height, a, c, e, f of the chip that fills a box."""
    return [F.lit(8).alias("width"), F.lit(8).alias("height"), ((F.col(f"{box}.east") - F.col(f"{box}.west")) / 8).alias("a"), F.col(f"{box}.west").alias("c"),
            (-(F.col(f"{box}.north") - F.col(f"{box}.south")) / 8).alias("e"), F.col(f"{box}.north").alias("f")]


def elevation_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, layer, item_ord, bbox, width, height, a, c, e, f, z (row-major)."""
    df = derived(spark, sf_dir, "chips")
    z = F.transform("embedding", lambda v, i: F.when((F.col("item_id") + i) % 13 == 0, F.lit(NODATA))
                    .otherwise(v.cast("double") * 1000))
    return df.select("item_id", "layer", F.col("item_id").alias("item_ord"), "bbox", *chip_georef(), z.alias("z"))


ELEV_CTE = _sql("chips") + """,
elev AS (SELECT item_id, layer, item_id AS item_ord, west, south, east, north, (east-west)/8 AS a, west AS c,
         -(north-south)/8 AS e, north AS f,
         list_transform(embedding, lambda v, i: CASE WHEN (item_id+i-1)%13=0 THEN CAST(-32767 AS DOUBLE)
                        ELSE CAST(v AS DOUBLE)*1000 END) AS z FROM chips)"""


def fine_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors as finer tiles: 48 x 48 values over a fifth of a degree, about 400 m each."""
    df = derived(spark, sf_dir, "chips").selectExpr("item_id", "layer", "item_id AS item_ord", "bbox.west AS c", "bbox.south + 0.2D AS f", "embedding")
    z = ("transform(sequence(0, 2303), i -> if((item_id + int(i / 48) + i % 48) % 29 = 0, -32767D, double(embedding[(int(i / 48) * 7 + i % 48) % 64]) * 1000 + int(i / 48) * 2 - i % 48))")
    df = df.selectExpr("item_id", "layer", "item_ord", "48 AS width", "48 AS height", "0.2D / 48 AS a", "c", "-0.2D / 48 AS e", "f", f"{z} AS z")
    return df.withColumn("bbox", geo.make_bbox(F.col("c"), F.col("f") + 48 * F.col("e"), F.col("c") + 48 * F.col("a"), F.col("f")))


FINE_CTE = _sql("chips") + """,
fin AS (SELECT item_id, layer, item_id AS item_ord, 48 AS width, 48 AS height, 0.2::DOUBLE/48 AS a, west AS c, -0.2::DOUBLE/48 AS e, south+0.2::DOUBLE AS f,
 list_transform(range(0, 2304), lambda i: CASE WHEN (item_id+i//48+i%48)%29=0 THEN -32767::DOUBLE ELSE CAST(embedding[(i//48*7+i%48)%64+1] AS DOUBLE)*1000+i//48*2-i%48 END) AS z FROM chips),
elev AS (SELECT *, c AS west, f+48*e AS south, c+48*a AS east, f AS north FROM fin)"""


def palette_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chips read as palette indices 0..9."""
    df = elevation_chips(spark, sf_dir).drop("z")
    idx = derived(spark, sf_dir, "chips").select("item_id", F.transform(
        "embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(9), F.floor((v.cast("double") + 0.6) * 8).cast("int")))).alias("idx"))
    return df.join(idx, "item_id")


def chart_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """42 x 42 charts of half a minute per pixel, one per vector, with their georeferencing."""
    k = F.col("item_id")
    west = -100 + ((k * 7) % 1200).cast("double") / 60
    south = 30 + ((k * 11) % 500).cast("double") / 60
    return derived(spark, sf_dir, "chips").select(
        "item_id", F.lit(42).alias("width"), F.lit(42).alias("height"), (F.lit(0.5) / 60).alias("a"), west.alias("c"),
        (F.lit(-0.5) / 60).alias("e"), (south + F.lit(21.0) / 60).alias("f"))


def chart_pixels(spark: SparkSession, sf_dir: str, charts: DataFrame | None = None) -> DataFrame:
    """item_id, row, col, idx: a white collar (9) on the west and south, a one-pixel ink line (0), then the face. With ``charts`` (item_id) only theirs, chosen before they become pixels."""
    chips = spread(derived(spark, sf_dir, "chips").select("item_id", "embedding"))
    if charts is not None:
        chips = deal(chips.join(charts, "item_id", "left_semi"), "item_id")
    px = (chips.selectExpr("item_id", "embedding", "explode(sequence(0, 41)) AS row").selectExpr("*", "explode(sequence(0, 41)) AS col"))
    face = "greatest(1, least(8, int(floor((double(embedding[(row * 7 + col) % 64]) + 0.6D) * 8))))"
    return px.selectExpr("item_id", "row", "col", f"CASE WHEN col < 3 + item_id % 6 OR row > 38 - item_id % 4 THEN 9 WHEN col = 3 + item_id % 6 OR row = 38 - item_id % 4 THEN 0 ELSE {face} END AS idx")


CHART_CTE = _sql("chips") + """,
charts AS (SELECT item_id, 42 AS width, 42 AS height, CAST(0.5 AS DOUBLE)/60 AS a,
           -100 + CAST((item_id*7)%1200 AS DOUBLE)/60 AS c, CAST(-0.5 AS DOUBLE)/60 AS e,
           (30 + CAST((item_id*11)%500 AS DOUBLE)/60) + CAST(21 AS DOUBLE)/60 AS f, embedding FROM chips),
chart_px AS (SELECT item_id, width, height, a, c, e, f, row, col,
           CASE WHEN col < 3+item_id%6 OR row > 41-(3+item_id%4) THEN 9
                WHEN col = 3+item_id%6 OR row = 41-(3+item_id%4) THEN 0
                ELSE greatest(1, least(8, CAST(floor((CAST(embedding[(row*7+col)%64+1] AS DOUBLE)+0.6)*8) AS INT))) END AS idx
           FROM charts, (SELECT r.range AS row, q.range AS col FROM range(42) r, range(42) q) g)"""
