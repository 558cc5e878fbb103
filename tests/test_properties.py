"""Operators against plain formulations, with skewed keys, and streams against batch."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkraster.functions import geo
from sparkraster.operators import estimate as est
from sparkraster.operators import jobs as jb
from sparkraster.operators import mosaic as mo
from sparkraster.operators import render as rd
from sparkraster.operators import ranking as rk
from sparkraster.operators import resample as rs
from sparkraster.operators.spatial_join import rect_join
from sparkraster.plans.inputs import elevation_chips
from sparkraster.sources import cells
from sparkraster.streaming import ingest, progress, speeds

SF = "/root/testdata/sf0.001"
B = "struct<west:double,south:double,east:double,north:double>"


def boxes(seed, n, hot):
    """A third of the boxes in one spot, some spanning the world, some degenerate neighbours."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        if i % 3 == 0:
            w, s, dw, dh = hot[0] + rnd.random() / 10, hot[1] + rnd.random() / 10, 0.05, 0.05
        elif i % 17 == 1:
            w, s, dw, dh = -180.0, -90.0, 360.0, 180.0
        elif i % 17 == 2:
            w, s, dw, dh = float(rnd.randint(-20, 20)), float(rnd.randint(-20, 20)), float(rnd.randint(1, 30)), float(rnd.randint(1, 20))
        else:
            w, s, dw, dh = rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.uniform(0.1, 3), rnd.uniform(0.1, 3)
        out.append((i, (w, s, min(180.0, w + dw), min(90.0, s + dh))))
    return out


@pytest.mark.parametrize("rows_per_share", [200_000, 7])
def test_rect_join_equals_nested_loop(spark, rows_per_share):
    a = spark.createDataFrame(boxes(1, 240, (3.0, 4.0)), f"aid bigint, bbox {B}")
    b = spark.createDataFrame(boxes(2, 200, (3.05, 4.05)), f"bid bigint, item_bbox {B}")
    got = rect_join(a, b, rows_per_share=rows_per_share).select("aid", "bid").collect()
    want = a.join(b, geo.intersects(F.col("bbox"), F.col("item_bbox"))).select("aid", "bid").collect()
    assert len(got) == len(set(got)) and set(got) == set(want)


@pytest.mark.parametrize("per_share, res", [(64, 20000.0), (3, 20000.0), (2, 6000.0)])
def test_block_kernel_equals_composite(spark, per_share, res):
    """Averages at the coarse resolution, bilinear samples at the fine one; values differ by rounding only."""
    chips = elevation_chips(spark, SF).withColumn("grid", geo.make_grid(geo.make_bbox(-100.0, 30.0, -75.0, 41.0), F.lit(res)))
    chips = chips.withColumn("native_res_m", geo.native_res_m(F.lit("geographic"), F.col("a"), geo.center_lat(F.col("bbox"))))
    a = mo.composite(mo.with_depth(mo.sample_smooth(mo.with_target_pixels(mo.touching_grid(chips), centres=False))), ["layer"]).selectExpr("layer", "py", "px", "v", "item_id")
    b = rd.block_pixels(rd.render_blocks(rd.elevation_shares(chips), ["layer"], 32, per_share=per_share), ["layer"], 32, ["w"])
    both = a.join(b, ["layer", "py", "px"], "full").collect()
    assert len(both) > 100 and all(abs(r["v"] - r["w"]) < 1e-8 and r["item_id"] == r["item_ord"] for r in both)


def test_clip_rings_limit_the_mosaic(spark):
    z = [200.0] * 400
    tri = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    t = spark.createDataFrame([(1, 1, (0.0, 0.0, 2.0, 2.0), 20, 20, 0.1, 0.0, -0.1, 2.0, z, [tri])],
                              f"item_id bigint, item_ord bigint, bbox {B}, width int, height int, a double, c double, e double, f double, z array<double>, clip array<array<struct<lon:double,lat:double>>>")
    t = t.withColumn("grid", geo.make_grid(F.col("bbox"), F.lit(11132.0)))
    px = mo.with_depth(mo.sample_nearest(mo.with_target_pixels(t)), clip="clip")
    kept = mo.composite(px, [])
    total = t.select("grid.pixels").first()[0]
    assert 0.4 < kept.count() / total < 0.6


def test_pyramid_keeps_the_mean_of_full_cells(spark):
    p = rs.to_pixels(elevation_chips(spark, SF)).withColumn("v", F.abs("v"))
    means = p.groupBy("item_id").agg(F.avg("v").alias("m")).join(rs.pyramid(p, ["item_id"], 3).filter("level = 3").select("item_id", "v"), "item_id")
    assert means.filter("abs(m - v) > 1e-6").count() == 0


def test_tile_table_round_trip(spark, tmp_path):
    p = spark.range(0, 5000).selectExpr("'a' AS layer", "int(id % 100) AS py", "int(id div 100) AS px", "double(id) AS v")
    out = str(tmp_path / "tiles")
    rs.tile_rows(p, ["layer"], 64).withColumn("level", F.lit(0)).write.partitionBy("layer", "level").parquet(out)
    back = spark.read.parquet(out).selectExpr("tile_row", "tile_col", "posexplode(data) AS (i, v)").filter("v IS NOT NULL") \
        .selectExpr("tile_row * 64 + int(i div 64) AS py", "tile_col * 64 + i % 64 AS px", "v")
    assert back.count() == 5000 and back.exceptAll(p.select("py", "px", "v")).count() == 0


def skewed(spark):
    return spark.range(0, 3000).selectExpr("if(id % 3 = 0, 0, id % 50) AS k", "id AS seq", "timestamp_seconds(id * 977 % 500000) AS ts", "(id * 31) % 7 AS v")


def test_bucketed_rank_lag_and_top_k_equal_windows(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    want = df.withColumn("rn", F.row_number().over(w)).withColumn("pv", F.lag("v").over(w))
    hour = F.date_trunc("hour", "ts")
    got = rk.bucketed_row_number(df, ["k"], [F.col("ts"), F.col("seq")], hour).select("k", "seq", "rn")
    assert got.exceptAll(want.select("k", "seq", "rn")).count() == 0 and got.count() == 3000
    lag = rk.bucketed_lag(df, ["k"], ["ts", "seq"], hour, "v", "pv").select("k", "seq", "pv")
    assert lag.exceptAll(want.select("k", "seq", "pv")).count() == 0 and lag.count() == 3000
    top = rk.top_k(df, ["k"], [F.col("ts").desc(), F.col("seq").desc()], 5).select("k", "seq")
    exp = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("seq").desc()))).filter("r <= 5").select("k", "seq")
    assert top.exceptAll(exp).count() == 0 and top.count() == exp.count()
    med = {r.k: r.median for r in rk.upper_median(df, "k", "v").collect()}
    for k in (0, 1):
        vals = sorted(r.v for r in df.filter(F.col("k") == k).collect())
        assert med[k] == vals[len(vals) // 2]


def test_streams_in_many_batches_equal_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    s = skewed(spark).selectExpr("concat('k', k) AS key", "double(1 + v) AS amount", "double(1) AS seconds", "timestamp_seconds(seq) AS ts", "seq")
    for i in range(4):  # four files in time order, one per micro-batch
        s.filter(f"seq >= {i * 750} AND seq < {(i + 1) * 750}").coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = speeds.learn_stream(read, str(tmp_path / "st"), str(tmp_path / "ck"))
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    assert last == 3
    a = {r.key: r for r in spark.read.parquet(str(tmp_path / "st" / f"v{last}")).collect()}
    b = {r.key: r for r in speeds.fold(speeds.admit(s)).collect()}
    assert a.keys() == b.keys()
    assert all(a[k].value == pytest.approx(b[k].value) and a[k].n == b[k].n for k in b)
    # A restart from the checkpoint with one more file goes on from the stored state.
    s.limit(1).selectExpr("'k0' AS key", "amount * 5 AS amount", "seconds", "timestamp_seconds(99999) AS ts", "99999L AS seq").coalesce(1).write.mode("append").parquet(src)
    q = speeds.learn_stream(read, str(tmp_path / "st"), str(tmp_path / "ck"))
    q.awaitTermination()
    c = {r.key: r for r in spark.read.parquet(str(tmp_path / "st" / "v4")).collect()}
    assert c["k0"].value == pytest.approx(0.7 * a["k0"].value + 0.3 * 5.0) and c["k1"].value == pytest.approx(a["k1"].value)


def test_progress_fan_in_many_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    e = spark.range(0, 400).selectExpr("id % 3 AS job_id", "int(id % 4) AS tile", "4 AS n_tiles", "double(id) / 400 AS frac", "timestamp_seconds(id) AS ts", "id AS seq")
    for i in range(3):
        e.filter(f"seq % 3 = {i}").coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    progress.fan_in_stream(read, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = progress.overall(progress.current(spark.read.parquet(str(tmp_path / "out")))).collect()
    want = progress.overall(progress.latest_fractions(e)).collect()
    assert sorted(got) == sorted(want)


def test_library_ingest_is_incremental(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    (lib / "a.tif").write_bytes(b"x" * 10)
    files = ingest.file_stream(spark, str(lib))
    args = (files, str(tmp_path / "out"), str(tmp_path / "ck"))
    ingest.ingest_stream(*args).awaitTermination()
    (lib / "b.tif").write_bytes(b"x" * 20)
    ingest.ingest_stream(*args).awaitTermination()
    assert sorted(r.length for r in ingest.library_items(spark, str(tmp_path / "out")).collect()) == [10, 20]


def test_rescan_of_changed_and_deleted_files(spark):
    def listing(*rows):
        return spark.createDataFrame([(p, n, t) for p, n, t in rows], "path string, length bigint, t bigint").selectExpr("path", "length", "timestamp_seconds(t) AS modificationTime")
    first = ingest.rescan(listing(("a", 1, 1), ("b", 2, 2), ("c", 3, 3)), None, lambda f: f.withColumn("n", F.lit(1)))
    second = ingest.rescan(listing(("a", 1, 1), ("b", 5, 2), ("c", 3, 9), ("d", 4, 4)), first, lambda f: f.withColumn("n", F.lit(2)))
    assert sorted((r.path, r.length, r.n) for r in second.collect()) == [("a", 1, 1), ("b", 5, 2), ("c", 3, 2), ("d", 4, 2)]
    assert ingest.rescan(listing(("d", 4, 4)), second, lambda f: f.withColumn("n", F.lit(3))).select("path", "n").collect() == [("d", 2)]


def test_large_areas_and_long_tile_numbers(spark):
    big = spark.sql("SELECT 1 AS aoi_id, struct(0D AS west, 10D AS south, 30D AS east, 35D AS north) AS bbox")
    assert cells.cells(big).count() == 750
    sizes, cached = spark.sql("SELECT 10 AS lat, 0 AS lon, 1000000 AS size"), spark.sql("SELECT 11 AS lat, 0 AS lon")
    e = est.fraction_estimate(big, cells.with_state(cells.cells(big), sizes, cached), "aoi_id", 1e6).first()
    assert e.requests == 750 and e.todo_bytes == 748 * 15e6 + 1e6
    tiles = spark.sql("SELECT 1 AS layer, explode(array(1, 10, 100, 104)) AS tile, 'ok' AS status, array('a.tif') AS files")
    assert sorted(r.file for r in jb.merged_files(tiles, "layer").collect()) == ["tile_01/a.tif", "tile_10/a.tif", "tile_100/a.tif", "tile_104/a.tif"]
    wide = spark.sql("SELECT 1 AS aoi_id, struct(-120D AS west, 20D AS south, -60D AS east, 60D AS north) AS bbox, 12 AS z")
    n = est.tile_estimate(wide, spark.sql("SELECT 1 AS aoi_id, 1000L AS cached"), "aoi_id", 1.0, 1.0).first()
    assert n.requests > 50_000 and n.todo_bytes == n.requests - 1000


def test_decoder_skips_unreadable_files(spark):
    f = spark.createDataFrame([(1, bytearray(b"\x01\x02")), (2, bytearray(b""))], "item_id bigint, content binary")
    got = ingest.decode(f, lambda d: {"width": 2, "height": 1, "dtype": "uint8", "bands": [list(map(float, d))]} if d else None).collect()
    assert len(got) == 1 and got[0].bands == [[1.0, 2.0]]
