"""Web-Mercator tile sources: enumeration, cache inventory, fetch lists, stitching and pruning."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tiles
from ..operators.ranking import top_k
from ..session import shuffled

KEEP_MOSAICS = 5


def enumerate_tiles(areas: DataFrame, zoom: str = "z", box: str = "bbox") -> DataFrame:
    """areas x (x, y), the inclusive range covering each box, with the range itself as ``rng``."""
    return (areas.withColumn("rng", tiles.tile_range(F.col(box), F.col(zoom)))
            .selectExpr("*", "explode(sequence(rng.y0, rng.y1)) AS y").selectExpr("*", "explode(sequence(rng.x0, rng.x1)) AS x"))


def cache_inventory(paths: DataFrame, path: str = "path") -> DataFrame:
    """z, x, y, state of cached tiles; a tile file wins over a known-empty marker."""
    p = r"(\d+)/(\d+)/(\d+)\.(tile|none)$"
    found = paths.filter(F.col(path).rlike(p)).select(
        *[F.regexp_extract(path, p, i + 1).cast("long").alias(c) for i, c in enumerate("zxy")],
        F.when(F.regexp_extract(path, p, 4) == "tile", F.lit("tile")).otherwise(F.lit("empty")).alias("state"))
    return found.groupBy("z", "x", "y").agg(F.max("state").alias("state"))


def todo(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(shuffled(cache.select("z", "x", "y")), ["z", "x", "y"], "left_anti")


def fetch_counts(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Per area: tiles wanted, on disk, known to be empty, and still to fetch."""
    j = wanted.select(*keys, "z", "x", "y").join(shuffled(cache.select("z", "x", "y", "state")), ["z", "x", "y"], "left")
    return j.groupBy(*keys).agg(F.count("*").alias("total"), F.count("state").alias("cached"),
                                F.count_if(F.col("state") == "empty").alias("empty"), F.count_if(F.col("state").isNull()).alias("todo"))


def stitch_plan(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Where each tile goes in its area's mosaic.

    ``stored`` is (z, x, y, size). The tile edge in pixels is that of the first stored tile in row
    order; a missing tile, or one of another size, is masked.
    """
    j = wanted.join(shuffled(stored), ["z", "x", "y"], "left")
    first = j.filter("size IS NOT NULL").groupBy(*keys).agg(F.min_by("size", F.struct("y", "x")).alias("edge"))
    return (j.join(shuffled(first), keys).selectExpr(*keys, "z", "x", "y", "edge", "(x - rng.x0) * edge AS off_x", "(y - rng.y0) * edge AS off_y",
                                           "coalesce(size <> edge, true) AS masked"))


def keep_newest(files: DataFrame, keys: list[str], order: list, id_col: str, k: int = KEEP_MOSAICS) -> DataFrame:
    """Files with keep = among the k newest of their source."""
    kept = top_k(files.select(*keys, id_col, "mtime"), keys, order, k).select(id_col).withColumn("_keep", F.lit(True))
    return files.join(kept, id_col, "left").withColumn("keep", F.coalesce("_keep", F.lit(False))).drop("_keep")
