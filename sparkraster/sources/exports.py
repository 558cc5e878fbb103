"""Server-side exports: chunk plans, cache keys, quarter splits and how much is on disk."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage, shuffled

CHUNK = 2000
MIN_SPLIT = 500
MAX_DEPTH = 4


def chunk_plan(areas: DataFrame, res: str = "res_m", extent: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Chunks (cb, w, h) covering each area's part inside the service extent, north to south then west to east."""
    b = F.col("bbox") if extent is None else F.when(F.col(extent).isNull(), F.col("bbox")).otherwise(geo.intersection(F.col("bbox"), F.col(extent)))
    xd, yd = geo.meters_to_deg(F.col(res), geo.center_lat(F.col("_b")))
    return (areas.withColumn("_b", b).filter("_b IS NOT NULL").withColumn("_xd", xd).withColumn("_yd", yd)
            .selectExpr("*", f"explode(sequence(0, greatest(1, int(ceil((_b.north - _b.south - 1e-12D) / ({chunk} * _yd)))) - 1)) AS chunk_row")
            .selectExpr("*", f"explode(sequence(0, greatest(1, int(ceil((_b.east - _b.west - 1e-12D) / ({chunk} * _xd)))) - 1)) AS chunk_col")
            .selectExpr("*", f"struct(_b.west + chunk_col * ({chunk} * _xd) AS west, greatest(_b.south, _b.north - (chunk_row + 1) * ({chunk} * _yd)) AS south, "
                             f"least(_b.east, _b.west + (chunk_col + 1) * ({chunk} * _xd)) AS east, _b.north - chunk_row * ({chunk} * _yd) AS north) AS cb")
            .selectExpr("*", "greatest(1L, bigint(rint((cb.east - cb.west) / _xd))) AS w", "greatest(1L, bigint(rint((cb.north - cb.south) / _yd))) AS h")
            .drop("_b", "_xd", "_yd"))


def chunk_key(url: Column, cb: Column, w: Column, h: Column, bands: Column) -> Column:
    """Twenty hex digits; the box enters as whole micro-degrees so that the text is the same everywhere."""
    sides = [F.rint(cb[s] * 1e6).cast("long").cast("string") for s in ("west", "south", "east", "north")]
    return F.substring(F.sha1(F.concat_ws("|", url, *sides, w.cast("string"), h.cast("string"), bands)), 1, 20)


def quarters(cb: Column, w: Column, h: Column) -> Column:
    """Array of (q, cb, w, h), q = 2 * south + east; of an odd number of pixels the larger part goes east and north."""
    def cut(lo: Column, hi: Column, upper: bool) -> tuple[Column, Column]:
        middle = (lo + hi) / 2
        return (middle, hi) if upper else (lo, middle)

    def part(q: int) -> Column:
        south, east = q // 2 == 1, q % 2 == 1
        x, y = cut(cb.west, cb.east, east), cut(cb.south, cb.north, not south)
        pixels = [F.when(F.lit(larger), F.ceil(n / 2)).otherwise(F.floor(n / 2)).cast("long") for n, larger in ((w, east), (h, not south))]
        return F.struct(F.lit(q).alias("q"), geo.make_bbox(x[0], y[0], x[1], y[1]).alias("cb"), pixels[0].alias("w"), pixels[1].alias("h"))
    return F.array(*map(part, range(4)))


def can_split(w: Column, h: Column) -> Column:
    return F.least(w, h) >= 2 * MIN_SPLIT


def cached_fraction(chunks: DataFrame, cache: DataFrame, ids: list[str], url: str = "url", bands: str = "bands", max_depth: int = MAX_DEPTH) -> DataFrame:
    """ids -> share of the chunk on disk, following quarter-split markers ``max_depth`` levels down; ``cut_off`` counts the markers below that.

    ``cache`` is (key, state) with state 'tif' or 'split'. Each round joins one level of the quad tree;
    the loop is over levels, never over chunks.
    """
    state = cut_lineage(cache.groupBy("key").agg(F.max("state").alias("state")), "export-states")  # 'tif' sorts after 'split' and wins
    cur = chunks.select(*ids, url, bands, "cb", "w", "h", F.lit(1.0).alias("_weight"))
    parts = chunks.select(*ids, F.lit(0.0).alias("_got"), F.lit(0).alias("_cut"))
    for depth in range(max_depth + 1):
        cur = cur.withColumn("key", chunk_key(F.col(url), F.col("cb"), F.col("w"), F.col("h"), F.col(bands))).join(shuffled(state), "key")
        cur = cut_lineage(cur, "export-chunks")  # read for this round's parts and for the next round
        parts = parts.unionByName(cur.selectExpr(*ids, "if(state = 'tif', _weight, 0D) AS _got", f"int(state = 'split' AND {depth} = {max_depth}) AS _cut"))
        if depth < max_depth:
            cur = (cur.filter("state = 'split'").withColumn("_q", F.explode(quarters(F.col("cb"), F.col("w"), F.col("h"))))
                   .select(*ids, url, bands, "_q.cb", "_q.w", "_q.h", (F.col("_weight") / 4).alias("_weight")))
    return parts.groupBy(*ids).agg(F.sum("_got").alias("got"), F.sum("_cut").alias("cut_off"))
