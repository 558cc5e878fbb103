"""Block renderer, tile tables, sinks and names against plain formulations."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkraster.functions import geo
from sparkraster.operators import elevation as el
from sparkraster.operators import jobs as jb
from sparkraster.operators import render as rd
from sparkraster.plans.inputs import elevation_chips, fine_tiles
from sparkraster.sources import tilestore as ts

SF = "/root/testdata/sf0.001"


def test_average_and_bilinear_equal_sums_over_pixels():
    rng = np.random.default_rng(1)
    v, w = rng.normal(size=(2, 9, 7)), (rng.random((9, 7)) < 0.8).astype(float)
    v[:, w == 0] = np.nan
    rows, cols = np.sort(rng.uniform(-1, 10, 6)), np.sort(rng.uniform(-1, 8, 5))
    got, found = rd.average(v, w, rows, cols)
    for r in range(5):
        for c in range(4):
            a = np.array([[max(0, min(rows[r + 1], j + 1) - max(rows[r], j)) * max(0, min(cols[c + 1], i + 1) - max(cols[c], i)) for i in range(7)] for j in range(9)]) * w
            assert found[r, c] == (a.sum() > 1e-9)
            if found[r, c]:
                assert np.allclose(got[:, r, c], (np.nan_to_num(v) * a).sum(axis=(1, 2)) / a.sum())
    rows, cols = rng.uniform(0, 9, 6), rng.uniform(0, 7, 5)
    got, found = rd.bilinear(v, w, rows, cols)
    for r in range(6):
        for c in range(5):
            a = np.array([[max(0, 1 - abs(j + 0.5 - rows[r])) * max(0, 1 - abs(i + 0.5 - cols[c])) for i in range(7)] for j in range(9)]) * w
            assert found[r, c] == (a.sum() > 1e-9) and (not found[r, c] or np.allclose(got[:, r, c], (np.nan_to_num(v) * a).sum(axis=(1, 2)) / a.sum()))


def test_means_in_order_equal_the_others_and_decide_ties(spark):
    rng = np.random.default_rng(2)
    v, w = rng.integers(0, 256, (3, 9, 7)).astype(float), rng.choice([0, 128 / 255, 1], (9, 7))
    for fn, averaged, rows, cols in ((rd.average, True, np.sort(rng.uniform(-1, 10, 6)), np.sort(rng.uniform(-1, 8, 5))), (rd.bilinear, False, rng.uniform(0, 9, 6), rng.uniform(0, 7, 5))):
        got, found = fn(v, w, rows, cols)
        y, x = np.nonzero(found)
        assert len(y) and np.allclose(rd.summed_in_order(v, w, rows, cols, y, x, averaged), got[:, y, x])
    from sparkraster.plans.q_layers import picture_shares
    one = rd.render_blocks(picture_shares(spark, "/root/testdata/sf0.01").filter("item_id = 432"), ["layer"], 128)
    px = rd.block_pixels(one, ["layer"], 128, ["r", "g", "b"]).filter("py = 53 and px = 124").collect()
    assert [(p["r"], p["g"], p["b"]) for p in px] == [(80, 176, 199)]  # 79.5, but for rounding


def test_ring_fill_equals_the_test_of_every_pixel(spark):
    rng = random.Random(4)
    lon, lat = np.linspace(0.05, 9.95, 60), np.linspace(9.95, 0.05, 50)
    for case in range(6):
        pts = [(rng.choice([rng.uniform(-1, 11), float(lon[rng.randrange(60)])]), rng.choice([rng.uniform(-1, 11), float(lat[rng.randrange(50)])])) for _ in range(rng.choice([3, 4, 9, 40]))]
        ring = np.array([*pts, pts[0]])
        got = rd.fill_ring(lon, lat, ring[:, 0], ring[:, 1])
        df = spark.createDataFrame([(float(x), float(y)) for y in lat for x in lon], "lon double, lat double")
        one = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring])
        inside = {(r["lon"], r["lat"]) for r in df.filter(geo.in_all_rings(F.array(one), F.col("lon"), F.col("lat"))).collect()}
        assert {(float(lon[i]), float(lat[j])) for j, i in zip(*np.nonzero(got))} == inside


def test_cells_of_level_1_equal_the_formula(spark):
    tiles = fine_tiles(spark, SF).filter("item_id < 3")
    got = el.cell_values(el.cell_table(tiles, 1, []), []).collect()
    assert len(got) > 50000
    t = {r["item_id"]: r for r in tiles.collect()}
    rng = random.Random(3)
    for r in rng.sample(got, 300):
        lon, lat = r["cell_lon"] + r["px"] / 1200, r["cell_lat"] + 1 - r["py"] / 1200
        best = None
        for k in t.values():
            fc, fr = (lon - k["c"]) / k["a"], (lat - k["f"]) / k["e"]
            if not (0 <= fc < 48 and 0 <= fr < 48):
                continue
            z = np.array(k["z"]).reshape(48, 48)
            near = [(max(0, 1 - abs(j + 0.5 - fr)) * max(0, 1 - abs(i + 0.5 - fc)), z[j, i]) for j in range(48) for i in range(48) if abs(j + 0.5 - fr) < 1 and abs(i + 0.5 - fc) < 1 and z[j, i] != -32767]
            b, w = k["bbox"], sum(x for x, _ in near)
            depth = np.float32(min(min(lon - b["west"], b["east"] - lon) / (b["east"] - b["west"]), min(lat - b["south"], b["north"] - lat) / (b["north"] - b["south"])))
            if w > 1e-9 and (best is None or depth > best[0]):
                best = (depth, sum(x * y for x, y in near) / w)
        assert abs(best[1] - r["z"]) <= 0.5 + 1e-6


def test_mixed_modes_meet_in_one_layer(spark):
    """A chart over a picture: the deeper one wins pixel by pixel, whatever its mode."""
    box = "struct<west:double,south:double,east:double,north:double>"
    rows = [(1, 1, (0.0, 0.0, 2.0, 2.0), "palette", "nearest", [[float(i % 3) for i in range(400)]], [1], None, [[9, 9, 9, 0], [200, 0, 0, 255], [0, 200, 0, 255]]),
            (2, 2, (1.0, 0.0, 3.0, 2.0), "rgb", "bilinear", [[50.0] * 400, [60.0] * 400, [70.0] * 400, [255.0] * 200 + [0.0] * 200], [1, 2, 3], 4, None)]
    df = spark.createDataFrame(rows, f"item_id bigint, item_ord bigint, bbox {box}, mode string, resampling string, `values` array<array<double>>, bands array<int>, alpha_band int, lut array<array<int>>")
    df = (df.withColumn("width", F.lit(20)).withColumn("height", F.lit(20)).withColumn("a", F.lit(0.1)).withColumn("c", F.col("bbox.west")).withColumn("e", F.lit(-0.1)).withColumn("f", F.col("bbox.north"))
          .withColumn("crs", F.lit("geographic")).withColumn("dtype", F.lit("uint8")).withColumn("native_res_m", F.lit(11132.0)).withColumn("rings", F.lit(None).cast("array<array<struct<lon:double,lat:double>>>"))
          .withColumn("grid", F.struct(geo.make_bbox(0.0, 0.0, 3.0, 2.0).alias("bbox"), F.lit(30).cast("long").alias("width"), F.lit(20).cast("long").alias("height"), F.lit(0.1).alias("xres"), F.lit(0.1).alias("yres"))))
    px = {(r["py"], r["px"]): (r["r"], r["g"], r["b"], r["item_ord"]) for r in rd.block_pixels(rd.render_blocks(df, [], 16), [], 16, ["r", "g", "b"]).collect()}
    assert px[5, 25] == (50, 60, 70, 2) and (15, 25) not in px and px[5, 4] == ([(9, 9, 9), (200, 0, 0), (0, 200, 0)][(5 * 20 + 4) % 3] + (1,))
    assert not any(v[3] == 1 and (k[0] * 20 + k[1]) % 3 == 0 for k, v in px.items())  # transparent indices show nothing


def test_sink_leaves_failed_runs_out(spark, tmp_path):
    path, flag = f"file://{tmp_path}/tiles", tmp_path / "broken"
    spark.dataSource.register(ts.TileSink)

    def check(x):
        if x == 7 and flag.exists():
            raise ValueError("lost")
        return x
    df = spark.range(0, 40, numPartitions=4).withColumn("x", F.udf(check, "bigint")("id"))
    df.write.format("tiles").mode("append").save(path)
    flag.touch()
    with pytest.raises(Exception, match="lost"):
        df.write.format("tiles").mode("append").save(path)
    assert sorted(r["x"] for r in ts.committed(spark, path).collect()) == list(range(40))
    flag.unlink()
    df.write.format("tiles").mode("append").save(path)
    assert ts.committed(spark, path).count() == 80
    df.filter("id < 3").write.format("tiles").mode("overwrite").save(path)
    assert sorted(r["id"] for r in ts.committed(spark, path).collect()) == [0, 1, 2]


def test_pyramid_reads_one_partition_for_a_zoom(spark, tmp_path):
    rng = np.random.default_rng(2)
    grid = np.where(rng.random((40, 40)) < 0.7, rng.normal(size=(40, 40)), np.nan)
    px = spark.createDataFrame([(j, i, float(grid[j, i])) for j in range(40) for i in range(40) if np.isfinite(grid[j, i])], "row int, col int, v double")
    store = ts.write_pyramid(spark, px, 3, str(tmp_path / "p"), 8)
    want = np.full((64, 64), np.nan)
    want[:40, :40] = grid
    for z in (3, 2, 1, 0):
        got = np.full(want.shape, np.nan)
        for r in store.filter(F.col("z") == z).collect():
            got[r["y"] * 8:][:8, r["x"] * 8:][:, :8] = np.frombuffer(r["data"]).reshape(8, 8)
        assert np.allclose(got, want, equal_nan=True)
        want = ts._nan_mean(want)
    assert "PartitionFilters: [isnotnull(z" in store.filter("z = 2")._jdf.queryExecution().toString()


def test_names_pass_over_any_number_of_taken_ones(spark):
    rng = random.Random(5)
    taken = sorted(rng.sample(range(2, 400), 150)) + list(range(1000, 1300))
    files = [("d", i, "a.tif") for i in range(900)] + [("d", 1000 + k, f"a ({t}).tif") for k, t in enumerate(taken)] + [("e", i, "a.tif") for i in range(3)]
    df = spark.createDataFrame(files, "folder string, ord bigint, name string")
    for bucket in (10_000, 50):
        got = {(r["folder"], r["ord"]): r["unique_name"] for r in jb.unique_names(df, "folder", "name", "ord", bucket).collect()}
        assert len(got) == len(files) == len({(f, n) for (f, _), n in got.items()})
        free = iter(x for x in range(2, 5000) if x not in set(taken))
        assert [got["d", i] for i in range(900)] == ["a.tif", *[f"a ({next(free)}).tif" for _ in range(899)]]
        assert [got["e", i] for i in range(3)] == ["a.tif", "a (2).tif", "a (3).tif"]


def test_exploded_tables_are_not_broadcast(spark):
    """The planner takes an exploded table for as small as its file; all of it would go through the driver."""
    from sparkraster.plans import q_estimates as qe
    from sparkraster.sources import exports
    ids = ["aoi_id", "chunk_row", "chunk_col"]
    tables = [exports.cached_fraction(qe.export_chunks(spark, SF), qe.export_cache(spark, SF), ids), qe.a05(spark, SF), qe.s38(spark, SF)]
    for df in tables:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan, plan


def test_equal_boxes_are_joined_once(spark, monkeypatch):
    from sparkraster.operators import spatial_join as sj
    seen = []
    plain = sj.rect_join
    monkeypatch.setattr(sj, "rect_join", lambda left, right, *a, **k: seen.append((left.count(), right.count())) or plain(left, right, *a, **k))
    areas = spark.range(300).select(F.col("id").alias("aoi_id"), geo.make_bbox(F.col("id") % 3 * 2.0, F.lit(0.0), F.col("id") % 3 * 2.0 + 1, F.lit(1.0)).alias("bbox"), F.lit("a").alias("source_id"))
    areas = areas.union(spark.sql("SELECT 900L, cast(null AS struct<west:double,south:double,east:double,north:double>), 'a'"))
    items = spark.range(200).select(geo.make_bbox(F.col("id") % 2 * 2.0, F.lit(0.0), F.col("id") % 2 * 2.0 + 1.5, F.lit(1.0)).alias("item_bbox"), F.lit("a").alias("source_id"))
    got = {r["aoi_id"]: (r["points_covered"], r["covered"]) for r in sj.covered_boxes(areas, items, "aoi_id").collect()}
    assert got == {i: (441, True) if i % 3 < 2 else (0, False) for i in range(300)} | {900: (0, False)}
    got = {r["aoi_id"]: r["has_data"] for r in sj.has_data(areas, items, "aoi_id", items).collect()}
    assert got == {i: i % 3 < 2 for i in range(300)} | {900: False}
    assert len(seen) == 2 and all(a <= 4 and b == 2 for a, b in seen)


def test_pairs_of_cell_inputs_are_not_shuffled(spark):
    areas = spark.range(300).select(F.col("id").alias("aoi_id"), geo.make_bbox(F.col("id") % 3 * 2.0 + 0.2, F.lit(0.2), F.col("id") % 3 * 2.0 + 0.8, F.lit(0.8)).alias("bbox"))
    items = spark.range(4).select(F.col("id").alias("item_id"), geo.make_bbox(F.col("id") * 2.0 - 0.5, F.lit(-0.5), F.col("id") * 2.0 + 1.5 - F.col("id") % 2, F.lit(1.5)).alias("item_bbox"))
    df = el.cell_inputs(areas, items, "aoi_id")
    above, last = df._jdf.queryExecution().executedPlan().toString().split("Join", 1)
    assert "Exchange" not in above and "cx#" in last.split("\n")[0]  # the join of boxes is the last one
    assert {(r["aoi_id"] % 3, r["item_id"], r["fetch_wider"]) for r in df.collect()} == {(0, 0, False), (1, 1, True), (2, 2, False)} and df.count() == 300
