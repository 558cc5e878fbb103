"""Rectangle joins by grid cells of matching size.

Every box has a level: the finest of six cell sizes (16 degrees down to 1/64) that is still as wide and
high as the box, so it touches at most four cells. A pair meets at the coarser of its two levels, and is
kept only in the cell that holds the south-west corner of the common box, so nothing has to be
de-duplicated afterwards. Because cells fit the boxes, the pairs looked at stay near the pairs found,
also where a large part of all boxes lies in one small place.

A table of counts per cell steers the shuffle. Cells without partners are dropped, and a cell with many
boxes on either side is cut into a rectangle of sub-keys: each left row picks one left share and is
copied to all right shares, and the other way round, so every pair still meets exactly once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, deal, shuffled, spread

TOP_CELL = 16.0   # degrees; each further level halves the cell twice
LEVELS = 6
LISTED = 50       # rows of one box in a list: a task holds all pairs of two lists at once
PAIRED = 30_000   # rows of either side that meet in one share of a cell, at the most, where they are listed


def _level(box: str) -> str:
    size = f"greatest({box}.east - {box}.west, {box}.north - {box}.south, 1e-9D)"
    return f"greatest(0, least({LEVELS - 1}, int(floor(log2({TOP_CELL}D / {size}) / 2))))"


def _listed(df: DataFrame, box: str, side: str, partners: DataFrame, partner_box: str) -> DataFrame:
    """One row per (box, level, cell). The band tells who is the coarser one there: B both, L or R.

    A box is listed at its own level for partners of the same size (B) and smaller ones, and at each
    coarser level for larger partners, as far as the other side has boxes of such a level at all; the
    levels in use are six bits.
    """
    mine, theirs = ("L", "R") if side == "left" else ("R", "L")
    used = partners.agg(F.expr(f"bit_or(shiftleft(1, {_level(partner_box)}))")).scalar()

    def span(lo, hi):
        return (f"explode(sequence(int(floor({box}.{lo} / _size)), "
                f"greatest(int(floor({box}.{lo} / _size)), int(ceil({box}.{hi} / _size)) - 1)))")
    return (df.withColumn("_used", F.coalesce(used, F.lit(0))).selectExpr("*", f"{_level(box)} AS _own")
            .selectExpr("*", "explode(sequence(0, _own)) AS level")
            .selectExpr("*", f"explode(if(level = _own, array('B', '{mine}'), array('{theirs}'))) AS band")
            .filter(f"if(band = '{mine}', shiftright(_used, level + 1) <> 0, (shiftright(_used, level) & 1) = 1)")
            .selectExpr("*", f"{TOP_CELL}D / pow(4D, level) AS _size")
            .selectExpr("*", span("west", "east") + " AS cx").selectExpr("*", span("south", "north") + " AS cy")
            .select(*df.columns, "level", "band", "cx", "cy"))


def rect_join(left: DataFrame, right: DataFrame, left_box: str = "bbox", right_box: str = "item_bbox",
              rows_per_share: int = 200_000, on: Column | None = None, weights: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of rows whose boxes intersect (touching edges do not count).

    Column names of the two sides must differ. Rows are copied per cell, so pass narrow rows and join
    pixel arrays to the pairs afterwards. ``on`` adds a further condition on the pair. ``weights`` tell how
    many rows a row of either side stands for; shares are then cut by weight and dealt over all shuffle
    partitions, whatever their size in bytes, as a pair becomes many rows.
    """
    if set(left.columns) & set(right.columns):
        raise ValueError(f"columns on both sides: {set(left.columns) & set(right.columns)}")
    keys = ["level", "band", "cx", "cy"]
    lx, rx = _listed(left, left_box, "left", right, right_box), _listed(right, right_box, "right", left, left_box)
    lw, rw = weights or ("1L", "1L")
    ln, rn = (x.groupBy(*keys).agg(F.sum(F.expr(w)).alias(n)) for x, w, n in ((lx, lw, "_ln"), (rx, rw, "_rn")))
    # One row per cell with partners. It is broadcast only if its measured size allows.
    plan = ln.join(rn, keys).selectExpr(*keys, f"int(ceil(_ln / {rows_per_share})) AS _ls",
                                        f"int(ceil(_rn / {rows_per_share})) AS _rs")
    # The share number comes from the row itself, so a re-run task sends a row to the same place.
    if weights:
        # Boxes come with lists here, which the planner takes for as small as the file behind them: the cells are counted and broadcast, never the lists.
        plan = cut_lineage(plan, "cells")
        plan = F.broadcast(plan) if plan.count() <= 1_000_000 else shuffled(plan)
    lid = F.pmod(F.xxhash64(*left.columns), F.col("_ls")).cast("int")
    rid = F.pmod(F.xxhash64(*right.columns), F.col("_rs")).cast("int")
    lx = (lx.join(plan, keys).withColumn("_i", lid)
          .selectExpr("*", "explode(sequence(0, _rs - 1)) AS _j").drop("_ls", "_rs"))
    rx = (rx.join(plan, keys).withColumn("_j", rid)
          .selectExpr("*", "explode(sequence(0, _ls - 1)) AS _i").drop("_ls", "_rs"))
    a, b, size = left_box, right_box, f"({TOP_CELL}D / pow(4D, level))"
    cond = F.expr(f"{b}.east > {a}.west AND {b}.west < {a}.east AND {b}.north > {a}.south AND {b}.south < {a}.north "
                  f"AND floor(greatest({a}.west, {b}.west) / {size}) = cx "
                  f"AND floor(greatest({a}.south, {b}.south) / {size}) = cy")
    if on is not None:
        cond = cond & on
    if weights:
        lx, rx = deal(lx, *keys, "_i", "_j"), shuffled(deal(rx, *keys, "_i", "_j"))
    return lx.join(rx, keys + ["_i", "_j"]).filter(cond).drop(*keys, "_i", "_j")


def equal_boxes(df: DataFrame, box: str, rows: str, most: int = 1000) -> DataFrame:
    """box, ``rows``: the other columns of all rows with that box, in lists of about ``most`` at the most."""
    others = [c for c in df.columns if c != box]
    n = df.groupBy(box).agg(F.count("*").alias("_n"))
    cut = df.join(shuffled(n), box).withColumn("_part", F.pmod(F.xxhash64(*others), F.ceil(F.col("_n") / most)))
    return cut.groupBy(box, "_part").agg(F.collect_list(F.struct(*others)).alias(rows)).drop("_part")


def box_pairs(left: DataFrame, right: DataFrame, left_box: str = "bbox", right_box: str = "item_bbox", listed: int | None = None, paired: int | None = None) -> DataFrame:
    """Pairs of ``rect_join`` by distinct boxes: both boxes, and the rows that have them as the lists ``_left`` and ``_right``.

    What depends on the boxes alone is worked out on these rows, and ``each_pair`` then lists all pairs without a shuffle. Rows of one box are
    compared and copied to cells once; if all boxes differ, the lists have one row each. Spark keeps all rows that come of one row until the last of
    them is made, so lists are short; and a box with many rows weighs as much as they do when the work is dealt. ``listed`` and ``paired`` stand
    for ``LISTED`` and ``PAIRED`` where a pair becomes more than one row.
    """
    ls = cut_lineage(equal_boxes(left, left_box, "_left", listed or LISTED), "left-boxes")
    rs = cut_lineage(equal_boxes(right, right_box, "_right", listed or LISTED), "right-boxes")
    # Lists are dealt by the key of their first row before they are copied to cells.
    key = next(c for c in left.columns if c != left_box)
    ls = deal(ls.withColumn(key, F.col("_left")[0][key]), key).drop(key)
    return rect_join(ls, rs, left_box, right_box, paired or PAIRED, weights=("size(_left)", "size(_right)"))


def each_pair(pairs: DataFrame) -> DataFrame:
    """One row per pair of rows of ``box_pairs``; the other columns are worked out once for all pairs of two lists."""
    others = [c for c in pairs.columns if c not in ("_left", "_right")]
    if others:
        pairs = pairs.select("_left", "_right", F.inline(F.array(F.struct(*others))))
    return pairs.selectExpr("*", "inline(_left)").drop("_left").selectExpr("*", "inline(_right)").drop("_right")


def has_data(areas: DataFrame, footprints: DataFrame, area_key: str, known: DataFrame) -> DataFrame:
    """areas x known sources: true or false where footprints are known, null where they are not.

    ``areas`` carries (area_key, source_id, bbox); ``footprints`` carries (source_id, item_bbox);
    ``known`` lists the source ids that publish footprints.
    """
    # Equal boxes of a source are asked, and answer, once.
    fp = cut_lineage(footprints.select(F.col("source_id").alias("_fp_source"), "item_bbox").distinct(), "footprints")
    asked = cut_lineage(areas.select("source_id", "bbox").distinct(), "boxes")
    hits = (rect_join(asked, fp, on=F.col("source_id") == F.col("_fp_source"))
            .select("source_id", "bbox").distinct().withColumn("_hit", F.lit(True)))
    marks = known.select("source_id").distinct().withColumn("_known", F.lit(True))
    return (areas.join(shuffled(hits), ["source_id", "bbox"], "left").join(marks, "source_id", "left")
            .withColumn("has_data", F.when(F.col("_known"), F.coalesce("_hit", F.lit(False)))).drop("_hit", "_known"))


def covered_boxes(areas: DataFrame, footprints: DataFrame, key: str, n: int = 21) -> DataFrame:
    """``jointly_covered`` of all areas (key, bbox) by all footprints (item_bbox) that meet them; equal boxes, on either side, are looked at once."""
    boxes = cut_lineage(areas.select("bbox").distinct().withColumn("_box", F.monotonically_increasing_id()), "boxes")
    pairs = rect_join(spread(boxes), cut_lineage(footprints.select("item_bbox").distinct(), "footprints"))
    seen = jointly_covered(boxes, pairs.select("_box", "bbox", "item_bbox"), "_box", n).drop("_box")
    return areas.join(shuffled(seen), "bbox", "left").na.fill({"points_covered": 0, "covered": False}).select(*areas.columns, "points_covered", "covered")


def jointly_covered(targets: DataFrame, footprints: DataFrame, key: str, n: int = 21) -> DataFrame:
    """key -> whether every point of an n x n lattice over ``bbox`` lies in some footprint.

    ``footprints`` is (key, item_bbox); with the target's bbox too, as ``rect_join`` gives it, no join is needed. A footprint covers
    a block of lattice columns, kept as bits of one number; the blocks of all footprints are or-ed
    per lattice row, so a target with any number of footprints keeps n numbers and shuffles those.
    """
    if not 2 <= n <= 62:
        raise ValueError("n must be within 2..62")

    def point(lo, hi, i):  # the last point is the far edge itself
        return f"bbox.{hi}" if i == n - 1 else f"({i} * ((bbox.{hi} - bbox.{lo}) / {n - 1}) + bbox.{lo})"
    columns = " + ".join(f"if({point('west', 'east', i)} BETWEEN item_bbox.west AND item_bbox.east, {1 << i}L, 0L)"
                         for i in range(n))
    rows = [f"bit_or(if({point('south', 'north', i)} BETWEEN item_bbox.south AND item_bbox.north, _cols, 0L)) AS _r{i}"
            for i in range(n)]
    pairs = footprints if "bbox" in footprints.columns else targets.select(key, "bbox").join(footprints.select(key, "item_bbox"), key)
    seen = (pairs.select(key, "bbox", "item_bbox")
            .selectExpr("*", f"{columns} AS _cols").groupBy(key).agg(*[F.expr(r) for r in rows])
            .selectExpr(key, " + ".join(f"bit_count(_r{i})" for i in range(n)) + " AS _points"))
    return (targets.join(seen, key, "left").selectExpr(
        *targets.columns, "coalesce(bigint(_points), 0L) AS points_covered", f"coalesce(_points, 0) = {n * n} AS covered"))
