"""Layers of several rasters: sampling by policy, colours, clip rings and deepest-inside-wins, block by block in numpy.

``render_blocks`` takes (raster, output grid) pairs and gives one row per output block. Every raster is sampled as ``resampling_policy`` says: elevation
and smooth colours bilinear, or averaged when the target is over one and a half times as coarse; charts nearest at up to four times and
box-averaged. Averages come from summed-area tables of values and weights, so a ratio of any size costs four lookups. Rings are filled by
scan lines from an edge table. Rasters in Web Mercator are warped row by row, since their columns stay linear in longitude.

A block's rasters arrive sorted, so a task holds one block and one batch. Blocks with many rasters are painted in shares, which are merged.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geo
from ..session import cut_lineage
from .mosaic import NODATA

# Radius of the sphere of Web Mercator, coarsest ratio for bilinear sampling, most sub-pixels along a side.
MERCATOR_RADIUS_M = 6_378_137.0
BILINEAR_RATIO = 1.5
MAX_FACTOR = 4
UNSET = np.iinfo(np.int64).max
TIE = 1e-6  # a mean this close to a half is summed anew before it is rounded
LEAST_WEIGHT = 1e-9  # what weighs less is rounding, of a sample on the centre of a void pixel or of a void box


# ---------------------------------------------------------------------------- sampling in numpy
def _warp(coord: np.ndarray, mercator: bool, vertical: bool) -> np.ndarray:
    """Degrees to the raster's own coordinates along one axis."""
    if not mercator:
        return coord
    return np.arcsinh(np.tan(np.radians(coord))) * MERCATOR_RADIUS_M if vertical else np.radians(coord) * MERCATOR_RADIUS_M


def nearest(values: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Values (bands, h, w) of the pixels that hold the points; rows and cols lie inside."""
    return values[:, np.floor(rows).astype(int)[:, None], np.floor(cols).astype(int)[None, :]]


def _between(x: np.ndarray, low: np.ndarray, w_low: np.ndarray, high: np.ndarray, w_high: np.ndarray, axis: int) -> np.ndarray:
    """Two weighted picks of ``x`` along an axis, the last or the one before."""
    if axis == 1:
        return x[:, low] * w_low[:, None] + x[:, high] * w_high[:, None]
    return x[:, :, low] * w_low + x[:, :, high] * w_high


def _weighted(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values times weight, and the weight as one more band; void values may be anything."""
    x = np.zeros((len(values) + 1, *weight.shape))
    np.multiply(values, weight, out=x[:-1], where=weight > 0)
    x[-1] = weight
    return x


def _mean(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = x[-1] > LEAST_WEIGHT
    return x[:-1] / np.where(found, x[-1], 1.0), found


def bilinear(values: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of the four nearest centres (bands, h, w) and where there are any; ``weight`` (h, w) is 0 where a pixel is void."""
    x = _weighted(values, weight)
    for axis, pos in ((1, rows), (2, cols)):
        at, last = pos - 0.5, x.shape[axis] - 1
        low = np.floor(at)
        d = at - low
        low = low.astype(np.int64)
        x = _between(x, np.maximum(low, 0), (1 - d) * (low >= 0), np.minimum(low + 1, last), d * (low < last), axis)
    return _mean(x)


def average(values: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Area-weighted means (bands, h, w) between neighbouring ``rows`` and ``cols``, h + 1 and w + 1 edges, and where there are any.

    A summed-area table is read between its nodes, so it gives the integral up to any fraction of a pixel.
    """
    x = _weighted(values, weight)
    table = np.zeros((len(x), x.shape[1] + 1, x.shape[2] + 1))
    np.cumsum(np.cumsum(x, axis=1), axis=2, out=table[:, 1:, 1:])
    for axis, pos in ((1, rows), (2, cols)):
        at, last = np.minimum(np.maximum(pos, 0), table.shape[axis] - 1), table.shape[axis] - 2
        low = np.minimum(np.floor(at).astype(np.int64), last)
        d = at - low
        table = _between(table, low, 1 - d, low + 1, d, axis)
    return _mean(np.diff(np.diff(table, axis=1), axis=2))


def summed_in_order(values: np.ndarray, weight: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, x: np.ndarray, averaged: bool) -> np.ndarray:
    """The means of ``average`` or ``bilinear`` at pixels (y, x), summed pixel by pixel in row-major order.

    Both ways agree but for rounding, and this one rounds least; it decides where a mean is a tie of two whole numbers.
    """
    if averaged:
        spans = [(p[at], p[at + 1]) for p, at in ((rows, y), (cols, x))]
        first = [np.maximum(np.floor(lo), 0).astype(np.int64) for lo, _ in spans]
        last = [np.minimum(np.ceil(hi) - 1, n - 1).astype(np.int64) for (_, hi), n in zip(spans, weight.shape)]
    else:
        spans = [(p[at], p[at]) for p, at in ((rows, y), (cols, x))]
        low = [np.floor(lo - 0.5).astype(np.int64) for lo, _ in spans]
        first, last = [np.maximum(v, 0) for v in low], [np.minimum(v + 1, n - 1) for v, n in zip(low, weight.shape)]

    def share(k: int, at: np.ndarray) -> np.ndarray:
        lo, hi = spans[k]
        return np.where(at > last[k], 0.0, np.minimum(at + 1, hi) - np.maximum(at, lo) if averaged else 1 - np.abs(at + 0.5 - lo))
    total, sums = np.zeros(len(y)), np.zeros((len(values), len(y)))
    for j in range(int((last[0] - first[0]).max(initial=-1)) + 1):
        row = first[0] + j
        for i in range(int((last[1] - first[1]).max(initial=-1)) + 1):
            col = first[1] + i
            at = np.minimum(row, last[0]), np.minimum(col, last[1])
            w = weight[at] * (share(0, row) * share(1, col))
            held = w > 0
            total += np.where(held, w, 0.0)
            sums += np.where(held, w * np.where(held, values[(slice(None), *at)], 0.0), 0.0)
    return sums / total


def fill_ring(lon: np.ndarray, lat: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Even-odd mask (len(lat), len(lon)) of a closed ring; ``lat`` falls. An edge counts its lower end and not its upper one.

    The edge table lists, for every edge, the rows it crosses and where; a row's crossings are sorted and the columns between them filled.
    """
    ax, ay, bx, by = px[:-1], py[:-1], px[1:], py[1:]
    first = np.searchsorted(-lat, -np.maximum(ay, by), side="right")
    last = np.searchsorted(-lat, -np.minimum(ay, by), side="right")
    n = np.where(ay == by, 0, last - first)
    edge = np.repeat(np.arange(len(n)), n)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    at = (bx[edge] - ax[edge]) * (lat[row] - ay[edge]) / (by[edge] - ay[edge]) + px[:-1][edge]
    # A pixel is inside if an odd number of crossings lie right of it.
    col = np.searchsorted(lon, at, side="left")
    marks = np.zeros((len(lat), len(lon) + 1), np.int64)
    np.add.at(marks, (row, col), 1)
    right = marks[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    return right % 2 == 1


def to_uint8(v: np.ndarray, dtype: str, top: float) -> np.ndarray:
    """Eight bits of sampled values: whole numbers of the raster's type first, sixteen bits scaled by 4095 or 65535 as its highest value ``top`` asks."""
    if not dtype.startswith("float"):
        v = np.floor(v + 0.5)
    if dtype == "uint16":
        v = v.astype(np.float32) * np.float32(255.0 / (4095.0 if top <= 4095 else 65535.0))
    return np.clip(v, 0, 255).astype(np.uint8)


class Canvas:
    """One output block: values by band, depth and order of the raster each pixel was taken from."""

    def __init__(self, g: dict, row: int, col: int, block: int):
        self.g, self.r0, self.c0 = g, row * block, col * block
        self.h, self.w = min(block, g["height"] - self.r0), min(block, g["width"] - self.c0)
        self.data = None
        self.depth, self.ord = np.full((self.h, self.w), -np.inf, np.float32), np.full((self.h, self.w), UNSET)
        self.known = {}

    def edges(self, factor: int, centres: bool) -> tuple[np.ndarray, np.ndarray]:
        """Latitudes and longitudes of (sub-)pixel centres, or edges."""
        if (factor, centres) not in self.known:
            self.known[factor, centres] = self._edges(factor, centres)
        return self.known[factor, centres]

    def _edges(self, factor: int, centres: bool) -> tuple[np.ndarray, np.ndarray]:
        g, half = self.g, 0.5 if centres else 0.0
        rows = np.arange(self.r0 * factor, (self.r0 + self.h) * factor + (not centres))
        cols = np.arange(self.c0 * factor, (self.c0 + self.w) * factor + (not centres))
        return g["north"] - (rows + half) * (g["yres"] / factor), g["west"] + (cols + half) * (g["xres"] / factor)

    def put(self, px: np.ndarray, better: np.ndarray, depth: np.ndarray, order, win=(slice(None), slice(None))) -> None:
        """Pixels of the window where ``better`` holds."""
        if self.data is None:
            self.data = np.zeros((len(px), self.h, self.w), px.dtype)
        np.copyto(self.data[(slice(None), *win)], px, where=better)
        np.copyto(self.depth[win], depth, where=better)
        np.copyto(self.ord[win], order, where=better)

    def merge(self, px: np.ndarray, depth: np.ndarray, order: np.ndarray) -> None:
        """Keep the deeper of both at each pixel, the earlier raster where depths are equal."""
        self.put(px, (order != UNSET) & ((depth > self.depth) | ((depth == self.depth) & (order < self.ord))), depth, order)


def paint(canvas: Canvas, t: dict, bands: np.ndarray) -> None:
    """Composite one raster (bands, height, width) into a block."""
    mercator, mode = t["crs"] == "mercator", t["mode"]
    ratio = t["target_res_m"] / max(t["native_res_m"], 1e-9)
    crisp = mode == "palette" or (mode != "elevation" and t["resampling"] == "nearest")
    factor = int(min(MAX_FACTOR, max(1, np.rint(ratio)))) if crisp else 1
    method = "nearest" if crisp else "average" if ratio > BILINEAR_RATIO else "bilinear"
    lat, lon = canvas.edges(factor, method != "average")
    rows, cols = (_warp(lat, mercator, True) - t["f"]) / t["e"], (_warp(lon, mercator, False) - t["c"]) / t["a"]
    win = []
    for p, n in ((rows, t["height"]), (cols, t["width"])):  # positions rise
        if method == "average":
            first, end = p[1:].searchsorted(0, "right"), p[:-1].searchsorted(n, "left")
        else:
            first, end = p.searchsorted(0, "left") // factor, -(-p.searchsorted(n, "left") // factor)
        if first >= end:
            return
        win.append(slice(int(first), int(end)))
    win = tuple(win)
    sub = tuple(slice(s.start * factor, s.stop * factor + (method == "average")) for s in win)
    rows, cols = rows[sub[0]], cols[sub[1]]
    lat, lon = canvas.edges(1, True)
    lat, lon = lat[win[0]], lon[win[1]]
    dx = np.minimum(lon - t["west"], t["east"] - lon) / (t["east"] - t["west"])
    dy = np.minimum(lat - t["south"], t["north"] - lat) / (t["north"] - t["south"])
    depth = np.minimum(dx.astype(np.float32)[None, :], dy.astype(np.float32)[:, None])
    deeper = depth > canvas.depth[win]
    if not deeper.any() and canvas.data is not None:
        return  # it wins no pixel, whatever its samples are

    alpha = t["alpha_band"]
    chosen = bands if len(bands) == 1 else bands[np.asarray(t["bands"], int) - 1]
    if mode == "elevation":
        weight = (np.isfinite(chosen[0]) & (chosen[0] != NODATA)).astype(float)
    elif alpha:
        weight = bands[alpha - 1].astype(float) / 255.0
    else:
        weight = np.ones(chosen.shape[1:])
    if method == "nearest":
        in_r, in_c = (rows >= 0) & (rows < t["height"]), (cols >= 0) & (cols < t["width"])
        held = in_r[:, None] & in_c[None, :]
        rows, cols = np.where(in_r, rows, 0), np.where(in_c, cols, 0)
        px, mask = np.where(held, nearest(chosen, rows, cols), 0.0), held & (nearest(weight[None], rows, cols)[0] > 0)
    else:
        px, mask = (average if method == "average" else bilinear)(chosen, weight, rows, cols)
        if mode != "elevation" and not t["dtype"].startswith("float"):
            y, x = np.nonzero(mask & (np.abs(px - np.floor(px) - 0.5) < TIE).any(axis=0))
            if len(y):
                px[:, y, x] = summed_in_order(chosen, weight, rows, cols, y, x, method == "average")
    if mode == "palette":
        lut = t["lut"]
        rgba = lut[np.clip(px[0], 0, len(lut) - 1).astype(int)]
        px = np.moveaxis(rgba[..., :3], -1, 0).astype(np.uint8)
        if lut[np.clip(chosen[0], 0, len(lut) - 1).astype(int), 3].any():
            mask = mask & (rgba[..., 3] > 0)
    elif mode != "elevation":
        px = to_uint8(px, t["dtype"], chosen.max(initial=0))
        px = np.repeat(px[:1], 3, axis=0) if mode == "gray" else px
    if factor > 1:
        h, w, n = win[0].stop - win[0].start, win[1].stop - win[1].start, factor * factor
        px = ((px.astype(np.int64).reshape(3, h, factor, w, factor).sum(axis=(2, 4)) + n // 2) // n).astype(np.uint8)
        mask = mask.reshape(h, factor, w, factor).mean(axis=(1, 3)) >= 0.5
    for ring in t["rings"]:
        mask = mask & fill_ring(lon, lat, ring[:, 0], ring[:, 1])
    canvas.put(px, mask & deeper, depth, t["item_ord"], win)  # rasters come in order, so the earlier one keeps a tie


# ---------------------------------------------------------------------------- Spark
def raster_box(crs: Column, a: Column, c: Column, e: Column, f: Column, width: Column, height: Column) -> Column:
    """Box in degrees of a raster given by its own coordinates."""
    merc = crs == "mercator"

    def lon(x):
        return F.when(merc, F.degrees(x / MERCATOR_RADIUS_M)).otherwise(x)

    def lat(y):
        return F.when(merc, F.degrees(F.atan(F.sinh(y / MERCATOR_RADIUS_M)))).otherwise(y)
    return geo.make_bbox(lon(c), lat(f + e * height), lon(c + a * width), lat(f))


def elevation_shares(pairs: DataFrame) -> DataFrame:
    """Adds what ``render_blocks`` wants to know of single-band elevation tiles in degrees with values ``z``."""
    return (pairs.withColumn("crs", F.lit("geographic")).withColumn("mode", F.lit("elevation")).withColumn("resampling", F.lit("bilinear")).withColumn("dtype", F.lit("float32"))
            .withColumn("bands", F.array(F.lit(1))).withColumn("alpha_band", F.lit(None).cast("int")).withColumn("lut", F.lit(None).cast("array<array<int>>"))
            .withColumn("rings", F.lit(None).cast("array<array<struct<lon:double,lat:double>>>")).withColumn("values", F.array("z"))
            .withColumn("native_res_m", geo.native_res_m(F.lit("geographic"), F.col("a"), geo.center_lat(F.col("bbox")))))


def first_of_equal(tiles: DataFrame, values: str = "z") -> DataFrame:
    """Elevation rasters (item_ord, bbox, ``values``) without those that win no pixel of any layer: of rasters with one box and the same void pixels the first
    has a mean wherever the others have one, lies as deep there and keeps the tie.
    """
    v = F.transform(values, lambda x: F.when(x.isNull(), "n").when((x == NODATA) | F.isnan(x) | (F.abs(x) == float("inf")), "0").otherwise("1"))
    first = tiles.groupBy("bbox", F.array_join(v, "").alias("_valid")).agg(F.min("item_ord").alias("item_ord")).select("item_ord")
    return tiles.join(cut_lineage(first, "first-rasters"), "item_ord", "left_semi")


def _rows_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of an array of lists of lists: the flat values, where each inner list starts, and which inner list each row starts with."""
    inner = lists.flatten()
    return inner.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False))], np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]


def _columns(b: pa.RecordBatch) -> dict:
    c = {n: b.column(n).to_pylist() for n in b.schema.names if n != "values"}
    if "values" in b.schema.names:
        c["values"] = _rows_of(b.column("values"))
    return c


def _pieces(b: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, since columns become Python objects, which take more room than the batch itself."""
    step = max(1, most * b.num_rows // max(1, b.nbytes))
    return (b.slice(i, step) for i in range(0, b.num_rows, step))


def _tile(c: dict, i: int) -> tuple[dict, np.ndarray]:
    t = {k: v[i] for k, v in c.items() if k != "values"}
    flat, starts, rows = c["values"]
    bands = flat[starts[rows[i]]:starts[rows[i + 1]]].reshape(-1, t["height"], t["width"])
    t["lut"] = np.asarray(t["lut"] or [[0, 0, 0, 0]], int)
    t["rings"] = [np.array([(p["lon"], p["lat"]) for p in ring]) for ring in t["rings"] or []]
    return t, bands


NESTED = ("values", "bands", "lut", "rings")
STATE = "bh int, bw int, filled bigint, n_bands int, data binary, depth binary, ord binary"


def _bands(data: bytes, n: int, h: int, w: int) -> np.ndarray:
    """Elevation has one band of doubles, colours three of bytes."""
    return np.frombuffer(data, np.float64 if n == 1 else np.uint8).reshape(n, h, w)


def _blocks(keys: list[str], schema: pa.Schema, batches: Iterator[pa.RecordBatch], start: Callable, add: Callable) -> Iterator[pa.RecordBatch]:
    """One row per key of sorted batches: ``start`` makes the canvas from a key's first row, ``add`` draws a row on it."""
    held, size = [], 0

    def row(key: tuple, c: Canvas) -> dict:
        data = c.data if c.data is not None else np.zeros((0, c.h, c.w))
        return dict(zip(keys, key)) | {"bh": c.h, "bw": c.w, "filled": int((c.ord != UNSET).sum()), "n_bands": len(data), "data": data.tobytes(), "depth": c.depth.tobytes(), "ord": c.ord.tobytes()}
    at = canvas = None
    for c in (_columns(p) for b in batches for p in _pieces(b)):
        for i, key in enumerate(zip(*[c[k] for k in keys])):
            if key != at:
                if canvas is not None:
                    held.append(row(at, canvas))
                    size += canvas.h * canvas.w
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                at, canvas = key, start(c, i)
            add(canvas, c, i)
    if canvas is not None:
        yield pa.RecordBatch.from_pylist([*held, row(at, canvas)], schema)


def _painter(keys: list[str], block: int, schema: pa.Schema) -> Callable:
    def start(c: dict, i: int) -> Canvas:
        return Canvas({k: c[f"g_{k}"][i] for k in ("west", "north", "xres", "yres", "width", "height")}, c["block_row"][i], c["block_col"][i], block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(keys, schema, batches, start, lambda canvas, c, i: paint(canvas, *_tile(c, i)))
    return run


def _merger(keys: list[str], schema: pa.Schema) -> Callable:
    def start(c: dict, i: int) -> Canvas:
        return Canvas({"width": c["bw"][i], "height": c["bh"][i]}, 0, 0, max(c["bw"][i], c["bh"][i]))

    def add(canvas: Canvas, c: dict, i: int) -> None:
        if c["n_bands"][i]:
            shape = (c["bh"][i], c["bw"][i])
            canvas.merge(_bands(c["data"][i], c["n_bands"][i], *shape), np.frombuffer(c["depth"][i], np.float32).reshape(shape), np.frombuffer(c["ord"][i], np.int64).reshape(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(keys, schema, batches, start, add)
    return run


def dealt(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of a key together and sorted, by ``order`` inside; as many partitions as there are, since a row here is much work."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def with_blocks(pairs: DataFrame, block: int) -> DataFrame:
    """One row per (raster, output block it touches), keyed block_row, block_col, with the grid's numbers as g_*."""
    g = F.col("grid")
    box = raster_box(F.col("crs"), F.col("a"), F.col("c"), F.col("e"), F.col("f"), F.col("width"), F.col("height"))
    d = pairs
    for k in ("west", "south", "east", "north"):  # plain columns: the optimizer loses fields of a struct between two generators
        d = d.withColumn(f"_b_{k}", box[k]).withColumn(f"g_{k}", g.bbox[k])
    for k in ("xres", "yres", "width", "height"):
        d = d.withColumn(f"g_{k}", g[k])
    d = d.filter("_b_west < g_east AND _b_east > g_west AND _b_north > g_south AND _b_south < g_north")

    def span(lo: str, hi: str, n: str) -> Column:
        return F.expr(f"explode(sequence(int(floor(greatest({lo}, 0D) / {block})), int(floor(least({hi}, {n} - 1D) / {block}))))")
    d = d.withColumn("block_row", span("(g_north - _b_north) / g_yres", "(g_north - _b_south) / g_yres", "g_height"))
    return d.withColumn("block_col", span("(_b_west - g_west) / g_xres", "(_b_east - g_west) / g_xres", "g_width"))


def render_blocks(pairs: DataFrame, keys: list[str], block: int = 1024, rasters: str | None = None, per_share: int = 64) -> DataFrame:
    """keys, block_row, block_col -> size, filled pixels, and bytes of values by band, depth (float32) and raster order (int64, the highest number where empty).

    ``pairs`` carries keys, grid, item_id, item_ord, bbox, crs, mode, resampling, dtype, native_res_m, width, height, a, c, e, f, ``values`` (one
    row-major array per band), ``bands`` (numbers of the bands to draw), alpha_band, lut (rgba by index) and rings; grids of at least one pixel.
    ``target_res_m`` may be given too, else it is the grid's step along a meridian. ``rasters`` names a column with an upper bound of a block's rasters; without it they are counted, which plans ``pairs`` a second time.
    A block of n rasters is painted in n / ``per_share`` shares, or the square root of n if that is less, so no task sees more than that many.
    """
    at = [*keys, "block_row", "block_col"]
    rows = with_blocks(pairs.withColumn("_fp", geo.clip_footprint(F.col("rings"), F.col("bbox"))), block)
    if rasters is None:
        rows = rows.join(rows.groupBy(*at).agg(F.count("*").alias("_n")), at)
    if "target_res_m" not in pairs.columns:
        rows = rows.withColumn("target_res_m", F.col("g_yres") * geo.METERS_PER_DEG)
    n = F.col(rasters or "_n")
    shares = F.ceil(F.least(n / per_share, F.sqrt(n))).cast("int")
    plain = ["item_ord", "crs", "mode", "resampling", "dtype", "native_res_m", "target_res_m", "width", "height", "a", "c", "e", "f", "alpha_band", "g_west", "g_north", "g_xres", "g_yres", "g_width", "g_height"]
    rows = rows.select(*at, F.pmod(F.xxhash64("item_id"), shares).cast("int").alias("_share"), *plain, *NESTED, *[F.col(f"_fp.{s}").alias(s) for s in ("west", "south", "east", "north")])
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in at)
    by = [*at, "_share"]
    parts = dealt(rows, by, "item_ord").mapInArrow(_painter(by, block, _arrow(rows, by)), f"{types}, _share int, {STATE}")
    return dealt(parts.drop("_share"), at).mapInArrow(_merger(at, _arrow(rows, at)), f"{types}, {STATE}")


def _arrow(df: DataFrame, keys: list[str]) -> pa.Schema:
    fields = [(k, to_arrow_type(df.schema[k].dataType)) for k in keys]
    return pa.schema([*fields, ("bh", pa.int32()), ("bw", pa.int32()), ("filled", pa.int64()), ("n_bands", pa.int32()), ("data", pa.binary()), ("depth", pa.binary()), ("ord", pa.binary())])


def block_pixels(blocks: DataFrame, keys: list[str], block: int, bands: list[str]) -> DataFrame:
    """One row per filled pixel: keys, py, px, one column per band (doubles for one band, whole numbers for three), and the order of its raster."""
    kinds = "double" if len(bands) == 1 else "int"
    names = [*keys, "block_row", "block_col", "bh", "bw", "n_bands", "data", "ord"]
    types = "".join(f"{k} {blocks.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in names}
                order = np.frombuffer(r["ord"], np.int64).reshape(r["bh"], r["bw"])
                y, x = np.nonzero(order != UNSET)
                if not len(y):
                    continue
                data = _bands(r["data"], r["n_bands"], r["bh"], r["bw"])
                cols = [pa.array([r[k]] * len(y), b.schema.field(k).type) for k in keys]
                cols += [pa.array((y + r["block_row"] * block).astype(np.int32)), pa.array((x + r["block_col"] * block).astype(np.int32))]
                cols += [pa.array(d[y, x] if kinds == "double" else d[y, x].astype(np.int32)) for d in data]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(order[y, x])], names=[*keys, "py", "px", *bands, "item_ord"])
    return blocks.select(*names).mapInArrow(run, f"{types}py int, px int, " + ", ".join(f"{n} {kinds}" for n in bands) + ", item_ord bigint")


def block_sums(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> filled pixels and the sum of values rounded to whole numbers (over all bands), from the arrays themselves."""
    types = "".join(f"{k} {blocks.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = []
            for n, h, w, order, data in zip(*[b.column(k).to_pylist() for k in ("n_bands", "bh", "bw", "ord", "data")]):
                on = np.frombuffer(order, np.int64).reshape(h, w) != UNSET
                sums.append(int(np.rint(_bands(data, n, h, w)[:, on]).sum()) if n else 0)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("filled"), pa.array(sums, pa.int64())], names=[*keys, "filled", "sum_v"])
    part = blocks.select(*keys, "bh", "bw", "n_bands", "filled", "data", "ord").mapInArrow(run, f"{types}filled bigint, sum_v bigint")
    return part.groupBy(*keys).agg(F.sum("filled").alias("filled"), F.sum("sum_v").alias("sum_v"))
