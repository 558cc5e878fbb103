"""Areas of equal boxes are looked at, painted and summed up once, and every one of them gets the result."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkraster.operators import render as rd
from sparkraster.plans import q_mosaic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The tables with every customer twice; both have one box."""
    d = tmp_path_factory.mktemp("twice")
    for f in os.listdir(SF):
        if f != "customer.parquet":
            os.symlink(f"{SF}/{f}", d / f)
    c = spark.read.parquet(f"{SF}/customer.parquet")
    c.unionByName(c.withColumn("c_custkey", F.col("c_custkey") + 12000)).write.parquet(str(d / "customer.parquet"))
    return str(d)


def by_area(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["aoi_id"], []).append(tuple(v for k, v in sorted(r.asDict().items()) if k != "aoi_id"))
    return {k: sorted(v, key=str) for k, v in out.items()}


@pytest.mark.parametrize("name", ["r20_split_layers", "j06_j07_clipped_footprint", "s01_x01_catalog_contract", "s08_library_items_in_area", "s17_catalog_tiles_in_area", "r21_unconverted_layers", "a01_a09_chart_estimate", "a04_event_imagery_estimate", "a08_library_estimate"])
def test_boxes_are_joined_once(spark, twice, monkeypatch, name):
    module = __import__(entry.queries()[name].__module__, fromlist=["x"])
    from sparkraster.operators import spatial_join as sj
    rows = []

    def counted(left, right, *a, **k):
        rows.append(left.count())
        return plain(left, right, *a, **k)
    plain = sj.rect_join
    monkeypatch.setattr(sj, "rect_join", counted)
    if hasattr(module, "rect_join"):
        monkeypatch.setattr(module, "rect_join", counted)
    one, two = by_area(entry.queries()[name](spark, SF)), by_area(entry.queries()[name](spark, twice))
    assert rows[: len(rows) // 2] == rows[len(rows) // 2:]
    assert two == one | {k + 12000: v for k, v in one.items()}


def test_layers_are_painted_once(spark, twice):
    assert q_mosaic.area_shares(spark, twice).count() == q_mosaic.area_shares(spark, SF).count()


def test_chips_of_equal_boxes_plan_a_resolution_once(spark, tmp_path, monkeypatch):
    """With every vector twice, as chips of equal boxes, as many boxes are paired and every area gets the same grid."""
    for f in os.listdir(SF):
        if f != "embeddings.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 12000)).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows, plain = [], q_mosaic.rect_join

    def counted(left, right, *a, **k):
        rows.append(right.count())
        return plain(left, right, *a, **k)
    monkeypatch.setattr(q_mosaic, "rect_join", counted)
    one, two = (by_area(entry.queries()["a13_planned_resolution"](spark, d)) for d in (SF, str(tmp_path)))
    assert one == two and one
    assert rows[0] == rows[1] > 0


def test_rasters_that_win_no_pixel_are_not_sampled(monkeypatch):
    def tile(order, west, size):
        return {"crs": "geographic", "mode": "elevation", "resampling": "bilinear", "target_res_m": 1.0, "native_res_m": 1.0, "a": size / 8, "c": west, "e": -size / 8, "f": west + size,
                "width": 8, "height": 8, "alpha_band": None, "dtype": "float32", "rings": [], "lut": None, "item_ord": order, "west": west, "south": west, "east": west + size, "north": west + size}
    seen = []
    plain = rd.bilinear
    monkeypatch.setattr(rd, "bilinear", lambda *a: seen.append(1) or plain(*a))
    canvas = rd.Canvas({"west": 0.0, "north": 1.0, "xres": 0.125, "yres": 0.125, "width": 8, "height": 8}, 0, 0, 8)
    rd.paint(canvas, tile(1, -4.0, 9.0), np.ones((1, 8, 8)))
    rd.paint(canvas, tile(2, -0.1, 1.2), np.full((1, 8, 8), 2.0))
    before = canvas.data.copy(), canvas.ord.copy()
    n = len(seen)
    rd.paint(canvas, tile(3, -0.1, 1.2), np.full((1, 8, 8), 3.0))
    assert len(seen) == n and (canvas.data == before[0]).all() and (canvas.ord == before[1]).all()


def test_clipped_pixels_are_dealt_by_pair(spark):
    plan = entry.queries()["r16_clipped_pixels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(aoi_id" in plan


def test_pairs_by_distinct_boxes_equal_all_pairs(spark):
    from sparkraster.functions import geo
    from sparkraster.operators import spatial_join as sj

    def boxes(n, key, name, k):
        x, y = F.col("id") % 7 * k, F.col("id") % 3 * k
        return spark.range(n).select(F.col("id").alias(key), geo.make_bbox(x, y, x + 1 + F.col("id") % 2, y + 1).alias(name))
    left, right = boxes(300, "l", "bbox", 0.4), boxes(200, "r", "item_bbox", 0.9)
    want = sorted((x["l"], x["r"]) for x in sj.rect_join(left, right).collect())
    pairs = sj.box_pairs(left, right)
    assert pairs.count() < len(want) / 20
    assert sorted((x["l"], x["r"]) for x in sj.each_pair(pairs).collect()) == want
    parts = sj.equal_boxes(left, "bbox", "rows", most=2).collect()
    assert sorted(x["l"] for p in parts for x in p["rows"]) == list(range(300)) and max(len(p["rows"]) for p in parts) < 8
