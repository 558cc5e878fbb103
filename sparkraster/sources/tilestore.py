"""Tables of tile arrays: web pyramids of all zooms, overview levels of rasters, and a data source that commits tile files at once.

A tile is ``data``: size x size doubles, row-major from the north-west, NaN where nothing is known. Pyramids and levels are Parquet tables partitioned by zoom
or level, so a reader that names the levels it wants opens no other files.
"""
from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import pixels as fx
from ..operators import render as rd

TILE = 256


def _nan_mean(x: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 pixels over those that are known."""
    x = x.reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2)
    known = np.isfinite(x)
    n = known.sum(axis=(1, 3))
    return np.where(n > 0, np.where(known, x, 0.0).sum(axis=(1, 3)) / np.maximum(n, 1), np.nan)


def web_mosaic(tiles: DataFrame, zoom: int, block: int = 64, per_share: int = 512) -> DataFrame:
    """row, col, v of the pixels of a Web-Mercator zoom under lon/lat rasters (item_id, item_ord, bbox, width, height, a, c, e, f, z): the nearest samples of the raster a pixel
    lies deepest inside, as ``resample.web_tiles`` and ``mosaic.composite`` give them.

    Rasters are dealt by the blocks they touch and painted in numpy, so no candidate pixel becomes a row. A block of n rasters is painted in n / ``per_share``
    shares, or the square root of n if that is less, which are merged. Latitudes come from Spark, as ``web_tiles`` has them.
    """
    half, last = 20037508.342789244, TILE * 2 ** zoom - 1
    res, radian = 2 * half / (TILE * 2 ** zoom), 3.141592653589793 / half

    def my(lat: str) -> str:
        return f"(asinh(tan(radians({lat}))) * {half / 3.141592653589793!r}D)"
    at = ["block_row", "block_col"]
    rows = (tiles.filter("z IS NOT NULL").withColumn("z", F.expr("transform(z, v -> coalesce(v, -32767D))"))
            .withColumn("y0", F.expr(f"greatest(0, int(floor(({half}D - {my('f')}) / {res!r}D)))"))
            .withColumn("y1", F.expr(f"least({last}, int(ceil(({half}D - {my('f + e * height')}) / {res!r}D)) - 1)"))
            .withColumn("x0", F.expr(f"greatest(0, int(floor((c * {half / 180!r}D + {half}D) / {res!r}D)))"))
            .withColumn("x1", F.expr(f"least({last}, int(ceil(((c + a * width) * {half / 180!r}D + {half}D) / {res!r}D)) - 1)"))
            .filter("y0 <= y1 AND x0 <= x1")
            .withColumn("lat", F.expr(f"transform(sequence(y0, y1), gy -> degrees(atan(sinh(({half}D - (gy + 0.5D) * {res!r}D) * {radian!r}D))))"))
            .withColumn("block_row", F.expr(f"explode(sequence(int(y0 div {block}), int(y1 div {block})))"))
            .withColumn("block_col", F.expr(f"explode(sequence(int(x0 div {block}), int(x1 div {block})))")))
    n = rows.groupBy(*at).agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64("item_id"), F.ceil(F.least(F.col("_n") / per_share, F.sqrt("_n")))).cast("int")
    rows = rows.join(n, at).select(*at, share.alias("_share"), "item_ord", *[f"bbox.{k}" for k in ("west", "south", "east", "north")], "width", "height", "a", "c", "e", "f", "y0", "x0", "x1", "lat", "z")

    def paint(state: list[np.ndarray], row: int, col: int, t: dict) -> None:
        v, depth, order = state
        top, left = max(t["y0"], row * block), max(t["x0"], col * block)
        lat = np.asarray(t["lat"])[top - t["y0"]:(row + 1) * block - t["y0"]]
        lon = ((np.arange(left, min(t["x1"] + 1, (col + 1) * block)) + 0.5) * res - half) * (180 / half)
        fcol, frow = (lon - t["c"]) / t["a"], (lat - t["f"]) / t["e"]
        i, j = np.flatnonzero((frow >= 0) & (frow < t["height"])), np.flatnonzero((fcol >= 0) & (fcol < t["width"]))
        if not (len(i) and len(j)):
            return
        lat, lon = lat[i], lon[j]
        z = np.asarray(t["z"], float).reshape(t["height"], t["width"])[np.floor(frow[i]).astype(int)[:, None], np.floor(fcol[j]).astype(int)]
        dx = np.minimum(lon - t["west"], t["east"] - lon) / (t["east"] - t["west"])
        dy = np.minimum(lat - t["south"], t["north"] - lat) / (t["north"] - t["south"])
        win = (slice(top - row * block + i[0], top - row * block + i[-1] + 1), slice(left - col * block + j[0], left - col * block + j[-1] + 1))
        put(state, win, z, np.minimum(dx.astype(np.float32)[None, :], dy.astype(np.float32)[:, None]), np.full(z.shape, t["item_ord"]), z != rd.NODATA)

    def put(state: list[np.ndarray], win: tuple, z: np.ndarray, depth: np.ndarray, order: np.ndarray, known: np.ndarray) -> None:
        better = known & ((depth > state[1][win]) | ((depth == state[1][win]) & (order < state[2][win])))
        for old, new in zip(state, (z, depth, order)):
            np.copyto(old[win], new, where=better)

    def blank() -> list[np.ndarray]:
        return [np.zeros((block, block)), np.full((block, block), -np.inf, np.float32), np.full((block, block), rd.UNSET)]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *[pa.array([s.tobytes()], pa.binary()) for s in state]], names=[*at, "v", "depth", "ord"])
        for b in batches:
            for start in range(0, b.num_rows, 256):
                for t in b.slice(start, 256).to_pylist():
                    if (now := (t["block_row"], t["block_col"], t["_share"])) != key:
                        if key is not None:
                            yield done()
                        key, state = now, blank()
                    paint(state, *now[:2], t)
        if key is not None:
            yield done()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def done() -> pa.RecordBatch:
            y, x = np.nonzero(state[2] != rd.UNSET)
            return pa.RecordBatch.from_arrays([pa.array((y + key[0] * block).astype(np.int32)), pa.array((x + key[1] * block).astype(np.int32)), pa.array(state[0][y, x])], names=["row", "col", "v"])
        for b in batches:
            for i in range(b.num_rows):
                row, col, *arrays = (c[i].as_py() for c in b.columns)
                if (row, col) != key:
                    if key is not None:
                        yield done()
                    key, state = (row, col), blank()
                z, depth, order = (np.frombuffer(x, k).reshape(block, block) for x, k in zip(arrays, (float, np.float32, np.int64)))
                put(state, (slice(None), slice(None)), z, depth, order, order != rd.UNSET)
        if key is not None:
            yield done()
    parts = rd.dealt(rows, [*at, "_share"], "item_ord").mapInArrow(shares, "block_row int, block_col int, v binary, depth binary, ord binary")
    return rd.dealt(parts, at).mapInArrow(merge, "row int, col int, v double")


def pixel_tiles(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """Pixels (row, col, v) of one zoom to tiles (x, y, data); a tile's pixels arrive sorted, and one tile is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, None
        for b in batches:
            x, y, i, v = (b.column(k).to_numpy(zero_copy_only=False) for k in ("x", "y", "i", "v"))
            cuts = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for s in np.split(np.arange(len(x)), cuts):
                if not len(s):
                    continue
                if (key := (int(x[s[0]]), int(y[s[0]]))) != at:
                    if at is not None:
                        yield _tile_row(at, tile)
                    at, tile = key, np.full(size * size, np.nan)
                tile[i[s]] = v[s]
        if at is not None:
            yield _tile_row(at, tile)
    p = pixels.selectExpr(f"int(col div {size}) AS x", f"int(row div {size}) AS y", f"int(row % {size}) * {size} + int(col % {size}) AS i", "double(v) AS v")
    return rd.dealt(p, ["x", "y"]).mapInArrow(run, "x int, y int, data binary")


def _tile_row(at: tuple[int, int], tile: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([tile.tobytes()], pa.binary())], names=["x", "y", "data"])


def parent_tiles(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """The next coarser zoom: every tile is put together from its four children, each halved where it arrives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = tile = None
        half = size // 2
        for b in batches:
            for x, y, data in zip(*[b.column(k).to_pylist() for k in ("x", "y", "data")]):
                if (x // 2, y // 2) != at:
                    if at is not None:
                        yield _tile_row(at, tile)
                    at, tile = (x // 2, y // 2), np.full((size, size), np.nan)
                tile[y % 2 * half:][:half, x % 2 * half:][:, :half] = _nan_mean(np.frombuffer(data).reshape(size, size))
        if at is not None:
            yield _tile_row(at, tile)
    up = tiles.selectExpr("x", "y", "data", "int(x div 2) AS ux", "int(y div 2) AS uy")
    return rd.dealt(up, ["ux", "uy"]).select("x", "y", "data").mapInArrow(run, "x int, y int, data binary")


def write_pyramid(spark: SparkSession, pixels: DataFrame, zoom: int, path: str, size: int = TILE) -> DataFrame:
    """All zooms from ``zoom`` to 0 as a table partitioned by z. Each zoom is read back from the table for the next, so sources are sampled once, and a
    zoom costs one shuffle of a quarter of the tiles before. A run that is repeated overwrites what it wrote.
    """
    for z in range(zoom, -1, -1):
        tiles = pixel_tiles(pixels, size) if z == zoom else parent_tiles(spark.read.schema("x int, y int, data binary").parquet(f"{path}/z={z + 1}"), size)
        tiles.write.mode("overwrite").parquet(f"{path}/z={z}")
    return spark.read.schema("x int, y int, data binary, z int").parquet(path)


def tile_sums(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> number of known pixels, their sum, and their sum weighted by place."""
    types = ", ".join(f"{k} {tiles.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column("data").to_pylist():
                v = np.frombuffer(data)
                i = np.flatnonzero(np.isfinite(v))
                out.append((len(i), float(v[i].sum()), float((v[i] * (i % 97)).sum())))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], *[pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]], names=[*keys, "valid", "total", "placed"])
    return tiles.select(*keys, "data").mapInArrow(run, f"{types}, valid bigint, total double, placed double")


# ---------------------------------------------------------------------------- overview levels
def write_levels(tiles: DataFrame, levels: int, path: str) -> DataFrame:
    """Rasters (item_id, width, height, z) with their overviews 0..levels, each half the last, as a table partitioned by level; averages over what is valid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, w, h, z in zip(*[b.column(k).to_pylist() for k in ("item_id", "width", "height", "z")]):
                v = np.asarray(z, float).reshape(h, w)
                v = np.where(np.isfinite(v) & (v != rd.NODATA), v, np.nan)
                for level in range(levels + 1):
                    if level:
                        v = _nan_mean(np.pad(v, ((0, v.shape[0] % 2), (0, v.shape[1] % 2)), constant_values=np.nan))
                    rows.append({"item_id": i, "level": level, "width": v.shape[1], "height": v.shape[0], "z": np.where(np.isnan(v), rd.NODATA, v).ravel()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.int64()), ("level", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("z", pa.list_(pa.float64()))]))
    out = tiles.select("item_id", "width", "height", "z").mapInArrow(run, "item_id bigint, level int, width int, height int, z array<double>")
    out.write.mode("overwrite").partitionBy("level").parquet(path)
    return tiles.sparkSession.read.schema("item_id bigint, width int, height int, z array<double>, level int").parquet(path)


def at_best_level(pairs: DataFrame, store: DataFrame, levels: int) -> DataFrame:
    """``pairs`` (item_id, native_res_m, target_res_m, a, e and more, no pixels) with the pixels of the coarsest level that is still as fine as the target.

    The levels in use, a handful of numbers, become a filter on the store's partitions; ``a``, ``e`` and ``native_res_m`` are those of the level.
    """
    factors = F.array(*[F.lit(2 ** k) for k in range(1, levels + 1)])
    p = pairs.withColumn("level", F.coalesce(fx.overview_level(F.col("native_res_m"), factors, F.col("target_res_m")) + 1, F.lit(0)))
    used = sorted(r[0] for r in p.select("level").distinct().collect())
    step = F.pow(F.lit(2.0), F.col("level"))
    return (p.join(store.filter(F.col("level").isin(used)), ["item_id", "level"])
            .withColumn("a", F.col("a") * step).withColumn("e", F.col("e") * step).withColumn("native_res_m", F.col("native_res_m") * step))


# ---------------------------------------------------------------------------- committed sink
@dataclass
class Staged(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class TileWriter(DataSourceWriter):
    """Tasks stage files under names of their own; one commit record, written last, says which of them count."""

    def __init__(self, path: str, schema: pa.Schema, overwrite: bool):
        self.path, self.schema, self.overwrite, self.run = path, schema, overwrite, uuid.uuid4().hex[:12]

    def store(self):
        from pyarrow.fs import FileSystem
        return FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Staged:
        fs, base = self.store()
        fs.create_dir(f"{base}/data", recursive=True)
        name, rows, n = f"data/{self.run}-{uuid.uuid4().hex}.parquet", [], 0
        with fs.open_output_stream(f"{base}/{name}") as out, pq.ParquetWriter(out, self.schema) as w:
            for row in iterator:
                rows.append(row.asDict())
                if len(rows) == 64:
                    w.write_table(pa.Table.from_pylist(rows, self.schema))
                    n, rows = n + len(rows), []
            w.write_table(pa.Table.from_pylist(rows, self.schema))
        return Staged([name], n + len(rows))

    def commit(self, messages) -> None:
        fs, base = self.store()
        done = [m for m in messages if m is not None]
        fs.create_dir(f"{base}/_commits", recursive=True)
        record = {"run": self.run, "overwrite": self.overwrite, "files": [f for m in done for f in m.files], "rows": sum(m.rows for m in done)}
        with fs.open_output_stream(f"{base}/_commits/{time.time_ns():020d}-{self.run}.json") as out:
            out.write(json.dumps(record).encode())

    def abort(self, messages) -> None:
        fs, base = self.store()
        for f in [f for m in messages if m is not None for f in m.files]:
            fs.delete_file(f"{base}/{f}")


class TileSink(DataSource):
    """``df.write.format("tiles").mode(...).save(path)``; any columns. Files of failed or repeated tasks are left out of the commit record."""

    @classmethod
    def name(cls) -> str:
        return "tiles"

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(self.options["path"], to_arrow_schema(schema), overwrite)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """What committed runs wrote below ``path``: all runs since the last that overwrote. Commit records are one small file a run."""
    log = spark.read.text(f"{path}/_commits/*.json").select(F.input_file_name().alias("at"), F.from_json("value", "run string, overwrite boolean, files array<string>, rows bigint").alias("c")).select("at", "c.*")
    runs = log.orderBy("at").collect()
    since = max((i for i, r in enumerate(runs) if r["overwrite"]), default=0)
    return spark.read.parquet(*[f"{path}/{f}" for r in runs[since:] for f in r["files"]])
