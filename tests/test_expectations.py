"""Known results: grids, zooms, depths, averages, estimates, cells, names."""
import pytest
from pyspark.sql import functions as F

from sparkraster.functions import geo, pixels, text, tiles
from sparkraster.operators import elevation as el
from sparkraster.operators import estimate as est
from sparkraster.operators import delivery, jobs
from sparkraster.sources import charts, exports, registry
from sparkraster.streaming import speeds


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def box(*v):
    return geo.make_bbox(*map(float, v))


def test_grid_and_zoom(spark):
    g = one(spark, geo.make_grid(box(-77.2, 38.8, -76.9, 39.0), F.lit(10.0)))[0]
    assert abs((g.bbox.north - g.bbox.south) / g.height * 111320 - 10) < 0.05
    assert one(spark, tiles.zoom_for(F.lit(10.0), F.lit(39.0)))[0] == 14


def test_mercator_resolution_shrinks_with_latitude(spark):
    r = one(spark, geo.native_res_m(F.lit("mercator"), F.lit(10.0), F.lit(60.0)))[0]
    assert r == pytest.approx(5.0)


def test_interior_depth(spark):
    fp = box(0, 0, 2, 2)
    r = one(spark, geo.interior_depth(F.lit(1.0), F.lit(1.0), fp), geo.interior_depth(F.lit(0.1), F.lit(1.0), fp), geo.interior_depth(F.lit(-1.0), F.lit(1.0), fp))
    assert r[0] == 0.5 and r[1] == pytest.approx(0.05) and r[2] < 0


def test_touching_boxes_do_not_intersect(spark):
    r = one(spark, geo.intersects(box(0, 0, 1, 1), box(1, 0, 2, 1)), geo.intersection(box(0, 0, 1, 1), box(1, 0, 2, 1)))
    assert r[0] is False and r[1] is None


def test_elevation_cell_grids(spark):
    a, b = one(spark, el.cell_grid(F.lit(38), F.lit(-78), 1), el.cell_grid(F.lit(60), F.lit(10), 2))
    assert (a.width, a.height) == (1201, 1201) and (b.width, b.height) == (1801, 3601)
    m = spark.createDataFrame([(x,) for x in (10, 55, 72, 78, 85)], "lat int").select(el.lon_multiplier(F.col("lat"))).collect()
    assert [r[0] for r in m] == [1, 2, 3, 4, 6]
    assert one(spark, el.cell_path(F.lit(38), F.lit(-77), 0))[0] == "dted/w077/n38.dt0"


@pytest.mark.parametrize("factor,want", [(1, (2, 1)), (4, (2, 2)), (4.4, (3, 2)), (8, (3, 3)), (9, (3, 3))])
def test_split_size(spark, factor, want):
    assert tuple(one(spark, *geo.split_size(F.lit(float(factor))))) == want


@pytest.mark.parametrize("cols,rows", [(1, 1), (2, 2), (3, 1), (1, 4), (4, 3)])
def test_split_covers_exactly(spark, cols, rows):
    parts = one(spark, geo.split_bbox(box(-10, 5, 14, 21), F.lit(cols), F.lit(rows)))[0]
    assert len(parts) == cols * rows
    area = sum((p.bbox.east - p.bbox.west) * (p.bbox.north - p.bbox.south) for p in parts)
    assert area == pytest.approx(24 * 16)
    assert min(p.bbox.west for p in parts) == -10 and max(p.bbox.north for p in parts) == pytest.approx(21)


def test_polygon_ring_is_closed_and_checked(spark):
    tri = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((10.0, 10.0), (12.0, 10.0), (10.0, 12.0))])
    closed, err, env, two = one(spark, geo.close_ring(tri), geo.ring_error(tri), geo.envelope(tri), geo.ring_error(F.slice(tri, 1, 2)))
    assert len(closed) == 4 and closed[0] == closed[3] and err is None and tuple(env) == (10, 10, 12, 12) and two == "fewer than 3 points"


def test_average_learns_and_ignores_junk(spark):
    s = spark.createDataFrame([("k", 10e6, 2.0, "2024-01-01 00:00:00", 1), ("k", 10e6, 10.0, "2024-01-01 05:00:00", 2), ("x", 0.0, 1.0, "2024-01-01 00:00:00", 3),
                               ("y", 5.0, 0.05, "2024-01-01 00:00:00", 4)], "key string, amount double, seconds double, t string, seq bigint").withColumn("ts", F.to_timestamp("t"))
    first = speeds.fold(speeds.admit(s.filter("seq = 1")))
    assert first.first().value == pytest.approx(5e6)
    both = speeds.fold(speeds.admit(s)).collect()
    assert len(both) == 1 and both[0].value == pytest.approx(3.8e6) and both[0].n == 2
    step = speeds.fold(speeds.admit(s.filter("seq = 2")), first).first()
    assert step.value == pytest.approx(3.8e6) and step.n == 2
    r = {x.key: (x.rate, x.basis) for x in speeds.rates(spark.createDataFrame([("k",), ("bytes:x",), ("odd:1",)], "key string"), speeds.fold(speeds.admit(s)), F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()}
    assert r["k"][1] == "measured" and r["bytes:x"] == (1e6, "default") and r["odd:1"] == (1.0, "default")


def areas(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "aoi_id bigint, bbox struct<west:double,south:double,east:double,north:double>")


def test_chart_estimate(spark):
    a = areas(spark, (-76.0, 39.0, -74.0, 41.0))
    b = "struct<west:double,south:double,east:double,north:double>"

    def run(extracted):
        hits = spark.createDataFrame([(0, (-76.0, 39.0, -74.0, 41.0), (-78.0, 36.0, -72.0, 40.0), "A", 5e7, 8e7, extracted, False),
                                      (0, (-76.0, 39.0, -74.0, 41.0), (-78.0, 40.0, -72.0, 44.0), "B", 5e7, 8e7, False, False)],
                                     f"aoi_id bigint, bbox {b}, item_bbox {b}, url string, zip_bytes double, member_bytes double, extracted boolean, zip_local boolean")
        return est.envelope(est.chart_estimate(a, hits, "aoi_id", 1e6), ["aoi_id"]).first()
    e = run(False)
    assert (e.requests, e.download_mb, e.cached_pct, e.source_mb) == (2, 100.0, 0, 160.0) and e.clipped_mb == pytest.approx(2 * 80 * 2 / 24, abs=0.2)
    e = run(True)
    assert (e.requests, e.download_mb, e.cached_pct) == (1, 50.0, 50)


def test_cell_estimate(spark):
    from sparkraster.sources import cells
    a = areas(spark, (-77.9, 38.1, -75.5, 38.9), (-77.05, 38.1, -76.95, 38.2), (-75.9, 38.1, -75.1, 38.9))
    sizes = spark.createDataFrame([(38, -78, 20_000_000), (38, -77, 10_000_000), (38, -76, 0)], "lat int, lon int, size bigint")
    none = sizes.filter("false")

    def run(cached):
        e = est.fraction_estimate(a, cells.with_state(cells.cells(a), sizes, cached), "aoi_id", 1e6)
        return {r.aoi_id: r for r in est.envelope(e, ["aoi_id", "partial"]).collect()}
    r = run(none)
    assert (r[0].requests, r[0].source_mb, r[0].download_mb) == (2, 30.0, 30.0)
    assert r[1].download_mb < 1 and r[1].partial == 2 and r[1].cached_pct == 0
    assert r[2].download_mb == 0 and r[2].requests is None and r[2].cached_pct == 100
    assert run(sizes)[0].download_mb == 0 and run(sizes)[0].cached_pct == 100


def test_export_chunks_and_quarters(spark):
    a = areas(spark, (0.0, 0.0, 0.0035, 0.0017)).withColumn("res_m", F.lit(1.0)).withColumn("url", F.lit("u")).withColumn("bands", F.lit(""))
    c = exports.chunk_plan(a, chunk=100).cache()
    assert c.count() == 8
    c = c.withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.orderBy("chunk_row", "chunk_col"))).cache()

    def key(d):
        return d.withColumn("key", exports.chunk_key(F.col("url"), F.col("cb"), F.col("w"), F.col("h"), F.col("bands")))
    quads = c.filter("n = 4").withColumn("p", F.explode(exports.quarters(F.col("cb"), F.col("w"), F.col("h")))).select("url", "bands", "p.cb", "p.w", "p.h")
    cache = key(c.filter("n <= 3")).selectExpr("key", "'tif' AS state").unionByName(key(c.filter("n = 4")).selectExpr("key", "'split' AS state")).unionByName(key(quads).selectExpr("key", "'tif' AS state"))
    got = exports.cached_fraction(c, cache, ["aoi_id", "chunk_row", "chunk_col"])
    assert got.agg(F.sum("got")).first()[0] == pytest.approx(4)
    e = est.export_estimate(a, c.withColumn("pb", F.lit(3)).join(got, ["aoi_id", "chunk_row", "chunk_col"]), "aoi_id", "pb", 2 / 60)
    r = est.envelope(e, ["aoi_id"]).first()
    assert 45 <= r.cached_pct <= 55 and r.download_seconds == pytest.approx(4 * 30, abs=1)


def test_package_size_by_mode(spark):
    b = "struct<west:double,south:double,east:double,north:double>"
    rows = [(i, (-106.6, 31.7, -106.2, 31.9), "elevation", "bilinear", 30.0, m, 0, 0, 0, 1, None, None) for i, m in enumerate(("mosaic", "clipped", "original"))]
    df = spark.createDataFrame(rows, f"id int, bbox {b}, kind string, resampling string, res_m double, mode string, geotiff int, cog int, mbtiles int, cell_level int, source_mb double, clipped_mb double")
    r = {x.mode: x for x in est.layer_sizes(df, 100).collect()}
    assert r["mosaic"].package_mb == pytest.approx(2.9) and r["mosaic"].too_big and not r["clipped"].too_big and not r["original"].too_big
    assert r["original"].package_mb == r["original"].est_mb


def test_sixteen_bit_scaling(spark):
    lo, hi = one(spark, pixels.to_uint8(F.array(F.lit(4000), F.lit(2000), F.lit(1000)), F.lit("uint16")), pixels.to_uint8(F.array(F.lit(65535), F.lit(0)), F.lit("uint16")))
    assert lo == [249, 124, 62] and hi == [255, 0]


def test_index_product_names(spark):
    r = one(spark, text.rpf_product(F.lit("NITF_TOC_ENTRY:CADRG_ONC_1:1M_1_1:/x/A.TOC")), text.ecrg_product(F.lit("ECRG_TOC_ENTRY:FalconView:ECRG:1_500K:/x/TOC.xml")))
    assert r[0] == "CADRG ONC 1:1M" and r[1] == "ECRG FalconView ECRG 1_500K"


def test_source_dimension(spark):
    s = registry.sources(spark)
    assert s.count() == 21 and s.select("source_id").distinct().count() == 21
    cat = {r.source_id: r.category for r in s.collect()}
    assert cat["faa-sectional"] == "vfr" and cat["faa-ifr-low"] == "ifr" and cat["usgs-3dep"] == "elevation" and cat["usgs-naip"] == "imagery"
    lv = registry.levels(spark).join(s.select("source_id", "min_res_m"), "source_id")
    assert lv.filter("res_m < min_res_m * 0.999").count() == 0 and lv.select("source_id").distinct().count() == 21


def test_member_patterns(spark):
    m = spark.createDataFrame([("x/Denver SEC.tif",), ("ENR_L12.TIF",), ("readme.htm",)], "name string")
    got = {(r.name, r.product) for r in charts.member_products(m).collect()}
    assert ("x/Denver SEC.tif", "faa-sectional") in got and ("ENR_L12.TIF", "faa-ifr-low") in got and not any(n == "readme.htm" for n, _ in got)


def test_split_names_and_whole_checksum(spark, tmp_path):
    plan = delivery.split_plan(spark.createDataFrame([("p.zip", 130 << 20, 50 << 20)], "package string, size bigint, part_bytes bigint")).orderBy("part").collect()
    assert [p.name for p in plan] == ["p.zip.001", "p.zip.002", "p.zip.003"] and plan[2].length == 30 << 20
    import hashlib
    data = bytes(range(256)) * 5000
    f = tmp_path / "a.bin"
    f.write_bytes(data)
    parts = spark.createDataFrame([(str(f), 0, 1000), (str(f), 1000, 1279000), (str(f), 0, None)], "path string, offset bigint, length bigint")
    got = {(r.offset, r.length): r.sha256 for r in delivery.file_checksums(parts).collect()}
    assert got[(0, 1000)] == hashlib.sha256(data[:1000]).hexdigest() and got[(0, None)] == hashlib.sha256(data).hexdigest()


def test_tile_merge_statuses(spark):
    t = spark.createDataFrame([("a", 0, "ok", None, 1.5, 10), ("a", 1, "failed", "boom", 0.0, 10), ("b", 0, "failed", "x", 0.0, 1), ("b", 1, "empty", None, 0.0, 1), ("c", 0, "empty", None, 0.0, 1)],
                              "layer string, tile int, status string, message string, size_mb double, res_m int")
    r = {x.layer: x for x in jobs.merge_tiles(t, "layer").collect()}
    assert r["a"].status == "ok" and r["a"].summary == "1 of 2 tiles built, 1 failed" and r["b"].message == "x" and r["c"].status == "empty"
