"""Pairs of boxes are listed in small pieces by many tasks, however many rows one box has."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkraster.functions import geo
from sparkraster.operators import spatial_join as sj

SF = "/root/testdata/sf0.001"


def one_box(spark, n, key, name):
    return spark.range(n).select(F.col("id").alias(key), geo.make_bbox(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0)).alias(name))


def test_lists_of_a_box_with_many_rows_stay_short(spark):
    pairs = sj.box_pairs(one_box(spark, 3000, "l", "bbox"), one_box(spark, 500, "r", "item_bbox"))
    rows = pairs.selectExpr("size(_left) * size(_right) AS n").collect()
    assert sum(r["n"] for r in rows) == 1_500_000 and max(r["n"] for r in rows) <= 10_000
    assert sj.each_pair(pairs.select("_left", "_right")).distinct().count() == 1_500_000


def test_full_cells_are_shared_by_the_rows_behind_their_boxes(spark, monkeypatch):
    monkeypatch.setattr(sj, "PAIRED", 100)
    left, right = one_box(spark, 1000, "l", "bbox"), one_box(spark, 1000, "r", "item_bbox")
    pairs = sj.box_pairs(left, right)
    assert "REPARTITION_BY_NUM" in pairs._jdf.queryExecution().executedPlan().toString()
    tasks = pairs.selectExpr("spark_partition_id() AS p", "size(_left) * size(_right) AS n").groupBy("p").agg(F.sum("n").alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 1_000_000 and len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_areas_of_equal_boxes_ask_for_cell_inputs_once(spark, tmp_path, monkeypatch):
    from sparkraster.operators import elevation as el
    for f in os.listdir(SF):
        if f != "customer.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    c = spark.read.parquet(f"{SF}/customer.parquet")
    c.unionByName(c.withColumn("c_custkey", F.col("c_custkey") + 12000)).write.parquet(str(tmp_path / "customer.parquet"))
    rows, plain = [], sj.rect_join

    def counted(left, *a, **k):
        rows.append(left.count())
        return plain(left, *a, **k)
    monkeypatch.setattr(sj, "rect_join", counted)
    monkeypatch.setattr(el, "rect_join", counted)
    one, two = (sorted((r["aoi_id"], r["item_id"], r["fetch_wider"]) for r in entry.queries()["h14_cell_inputs"](spark, d).collect()) for d in (SF, str(tmp_path)))
    assert rows[: len(rows) // 2] == rows[len(rows) // 2:]
    assert two == sorted(one + [(a + 12000, i, w) for a, i, w in one]) and one


@pytest.mark.parametrize("others", [[], ["item_bbox"]])
def test_columns_of_the_pair_reach_every_row(spark, others):
    pairs = sj.box_pairs(one_box(spark, 120, "l", "bbox"), one_box(spark, 70, "r", "item_bbox")).select("_left", "_right", *others)
    out = sj.each_pair(pairs)
    assert sorted(out.columns) == sorted([*others, "l", "r"])
    assert sorted((x["l"], x["r"]) for x in out.collect()) == [(a, b) for a in range(120) for b in range(70)]


def test_lists_are_never_broadcast(spark):
    """The planner takes exploded lists for as small as their file; passed through the driver they can exceed what it holds."""
    plan = sj.box_pairs(one_box(spark, 1000, "l", "bbox"), one_box(spark, 1000, "r", "item_bbox"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [level" in plan
    for side in plan.split("BroadcastExchange")[1:]:
        assert "cells-" in side.split("FileScan", 1)[1].split("\n", 1)[0]


@pytest.mark.parametrize("copies", [1, 40])
def test_clipped_pixels_are_cut_once_for_areas_of_one_box(spark, tmp_path, copies):
    """No exchange stands above the join of lists, however many areas share a box, and every area gets its pixels."""
    for f in os.listdir(SF):
        if f != "customer.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    c = spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey <= 12")
    c.crossJoin(spark.range(copies)).withColumn("c_custkey", F.col("c_custkey") + F.col("id") * 12000).drop("id").write.parquet(str(tmp_path / "customer.parquet"))
    df = entry.queries()["r16_clipped_pixels"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("SortMergeJoin", 1)[0]
    want = {tuple(r) for r in entry.queries()["r16_clipped_pixels"](spark, SF).filter("aoi_id <= 12").collect()}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) * copies > 0
    assert {(r[0] % 12000, *r[1:]) for r in got} == want
