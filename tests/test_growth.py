"""Work and memory that must not grow faster than the tables."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

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


@pytest.mark.parametrize("name", ["r16_native_window_clip", "r16_clipped_pixels"])
def test_windows_are_cut_once_for_equal_boxes(spark, twice, monkeypatch, name):
    from sparkraster.operators import spatial_join as sj
    rows, plain = [], sj.rect_join
    monkeypatch.setattr(sj, "rect_join", lambda left, *a, **k: rows.append(left.count()) or plain(left, *a, **k))
    one, two = (sorted(tuple(r) for r in entry.queries()[name](spark, d).select("aoi_id", "item_id").collect()) for d in (SF, twice))
    assert rows[0] == rows[1]
    assert two == sorted(one + [(a + 12000, i) for a, i in one])


def test_decoded_rasters_leave_in_bounded_batches(spark, tmp_path):
    """A task hands on what it has decoded long before it has read its whole input batch."""
    from sparkraster.streaming import ingest
    seen = str(tmp_path / "seen")

    def decoder(data):
        with open(seen, "a") as f:
            f.write(".")
        return {"width": 1000, "height": 400, "dtype": "uint8", "bands": [[float(len(data))] * 400_000, range(3)]}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        files = spark.range(60).coalesce(1).selectExpr("id AS item_id", "encode(repeat('x', int(id)), 'UTF-8') AS content")
        got = ingest.decode(files, decoder)

        def sizes(batches):
            import os
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "decoded": [os.path.getsize(seen)], "ids": [b.column(0).to_pylist()], "first": [[x[0][0] for x in b.column(1).to_pylist()]]})
        rows = got.select("item_id", "bands").mapInArrow(sizes, "n long, decoded long, ids array<long>, first array<double>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert [i for r in rows for i in r["ids"]] == list(range(60)) and [x for r in rows for x in r["first"]] == list(range(60))
    assert rows[0]["decoded"] < 60


def test_equal_boxes_are_split_once(spark, twice, monkeypatch):
    from sparkraster.plans import q_mosaic
    rows, plain = [], q_mosaic.mo.split_until_fits
    monkeypatch.setattr(q_mosaic.mo, "split_until_fits", lambda boxes, *a: rows.append((boxes.count(), boxes.rdd.getNumPartitions())) or plain(boxes, *a))
    one, two = (sorted(tuple(r) for r in q_mosaic.u03(spark, d).collect()) for d in (SF, twice))
    assert rows[0] == rows[1] and rows[0][1] >= spark.sparkContext.defaultParallelism
    assert two == sorted(one + [(r[0] + 12000, *r[1:]) for r in one])


def test_web_mosaic_equals_candidate_rows_without_making_them(spark):
    from sparkraster.functions import geo
    from sparkraster.operators import mosaic as mo
    from sparkraster.operators import resample as rs
    from sparkraster.sources import tilestore as ts
    k = F.col("id")
    west, south = -100 + k * 37 % 40 / 10.0, 30 + k * 23 % 30 / 10.0  # several rasters have one box
    z = F.expr("transform(sequence(0, 63), i -> CASE WHEN (id + i) % 13 = 0 THEN -32767D WHEN (id + i) % 17 = 0 THEN double('nan') WHEN (id + i) % 19 = 0 THEN NULL ELSE id * 100D + i END)")
    chips = (spark.range(250).withColumn("z", z).withColumn("bbox", geo.make_bbox(west, south, west + 0.4 + k % 5 / 10, south + 0.4 + k % 4 / 10))
             .selectExpr("id AS item_id", "id AS item_ord", "bbox", "8 AS width", "8 AS height", "(bbox.east - bbox.west) / 8 AS a", "bbox.west AS c", "(bbox.south - bbox.north) / 8 AS e", "bbox.north AS f", "z"))
    px = rs.web_tiles(chips, 6).filter("v <> -32767").selectExpr("item_id", "item_ord", "bbox", "lon", "lat", "gy AS py", "gx AS px", "v")
    want = sorted((r["py"], r["px"], str(r["v"])) for r in mo.composite(mo.with_depth(px), []).collect())
    for per_share in (512, 3):
        assert sorted((r["row"], r["col"], str(r["v"])) for r in ts.web_mosaic(chips, 6, per_share=per_share).collect()) == want


@pytest.mark.parametrize("name", ["s34_web_tile_pyramid"])
def test_candidate_pixels_are_not_sorted(spark, name):
    assert "SortAggregate" not in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_shares_are_merged_in_small_pieces(monkeypatch):
    """However many shares of a block one batch brings, only a few of them are Python objects at once."""
    import numpy as np
    import pyarrow as pa
    from sparkraster.operators import render as rd
    seen, plain, rng = [], rd._columns, np.random.default_rng(3)
    monkeypatch.setattr(rd, "_columns", lambda b: seen.append(b.nbytes) or plain(b))
    schema = pa.schema([("k", pa.int64()), ("bh", pa.int32()), ("bw", pa.int32()), ("filled", pa.int64()), ("n_bands", pa.int32()), ("data", pa.binary()), ("depth", pa.binary()), ("ord", pa.binary())])
    v, d = rng.random((300, 64, 64)), rng.random((300, 64, 64)).astype(np.float32)
    rows = [{"k": i // 200, "bh": 64, "bw": 64, "filled": 4096, "n_bands": 1, "data": v[i].tobytes(), "depth": d[i].tobytes(), "ord": np.full((64, 64), i).tobytes()} for i in range(300)]
    out = [r for b in rd._merger(["k"], schema)(iter([pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()]
    assert [r["k"] for r in out] == [0, 1] and max(seen) < 5 << 20 and len(seen) > 4
    for r, part in zip(out, (slice(0, 200), slice(200, 300))):
        best = d[part].argmax(axis=0)
        assert (np.frombuffer(r["ord"], np.int64).reshape(64, 64) == best + part.start).all()
        assert (np.frombuffer(r["data"]).reshape(64, 64) == np.take_along_axis(v[part], best[None], 0)[0]).all()


def test_charts_are_chosen_before_they_become_pixels(spark, monkeypatch):
    from sparkraster.plans import q_elevation
    seen, plain = [], q_elevation.nl.edge_profiles
    monkeypatch.setattr(q_elevation.nl, "edge_profiles", lambda px, h: seen.append(px) or plain(px, h))
    q_elevation.s15(spark, SF)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.rindex("Generate explode(")


def test_chips_that_win_nowhere_are_not_shuffled_with_the_pieces(spark, tmp_path, monkeypatch):
    """Later chips of one box and the same void pixels add no pair, and no layer changes; one with other void pixels stays."""
    from sparkraster.operators import spatial_join as sj
    for f in os.listdir(SF):
        if f != "embeddings.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    later = e.withColumn("vec_id", F.col("vec_id") + 12000 * 13).withColumn("embedding", F.transform("embedding", lambda v: (v / 2).cast("float")))  # a multiple of 13 keeps the void pixels
    e.unionByName(later).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows, plain = [], sj.rect_join
    monkeypatch.setattr(sj, "rect_join", lambda left, right, *a, **k: rows.append(right.count()) or plain(left, right, *a, **k))
    one, two = (sorted(tuple(r) for r in entry.queries()["r20_split_layers"](spark, d).collect()) for d in (SF, str(tmp_path)))
    assert rows[0] == rows[1] and one == two


def test_first_rasters_of_equal_boxes_give_the_same_mosaic(spark):
    from sparkraster.functions import geo
    from sparkraster.operators import render as rd
    k = F.col("id")
    z = F.expr("transform(sequence(0, 63), i -> CASE WHEN (id % 5 + i) % 4 = 0 THEN -32767D WHEN id % 11 = 0 AND i < 32 THEN double('nan') ELSE id * 100D + i END)")
    tiles = (spark.range(120).withColumn("z", z).withColumn("bbox", geo.make_bbox(k % 3 * 0.5, k % 2 * 0.5, k % 3 * 0.5 + 1, k % 2 * 0.5 + 1))
             .selectExpr("id AS item_id", "id AS item_ord", "bbox", "8 AS width", "8 AS height", "0.125D AS a", "bbox.west AS c", "-0.125D AS e", "bbox.north AS f", "z")
             .withColumn("grid", geo.make_grid(geo.make_bbox(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.5)), F.lit(9000.0))).withColumn("layer", F.lit(1)))
    kept = rd.first_of_equal(tiles)
    assert 0 < kept.count() < 120

    def pixels(df):
        return sorted((r["py"], r["px"], r["v"], r["item_ord"]) for r in rd.block_pixels(rd.render_blocks(rd.elevation_shares(df), ["layer"], 64), ["layer"], 64, ["v"]).collect())
    assert pixels(kept) == pixels(tiles) != []
