"""Charts of more than one word per line: bits against plain Python."""
from sparkraster.operators import neatline as nl

W, H = 140, 70


def flags(spark):
    white = [(1, r, c, True, False) for r in range(H) for c in range(W) if c < 9 or r >= 60]
    dark = [(1, r, c, False, True) for r, c in ((0, 0), (1, 63), (2, 64), (3, 65), (30, 62), (40, 128), (69, 139), (50, 126), (55, 127), (62, 66))]
    taken = {(r, c) for _, r, c, _, _ in dark}
    plain = [(1, r, c, False, False) for r in range(H) for c in range(W)]
    kept = {(r, c): (i, r, c, w, d) for i, r, c, w, d in plain + white + dark}
    return spark.createDataFrame(list(kept.values()), "item_id long, row int, col int, white boolean, dark boolean"), taken


def unpacked(rows, name, axis):
    out = set()
    for x in rows:
        if x.axis == axis:
            out |= {(x.pos, 64 * x.word + b) for b in range(64) if x[name] >> b & 1}
    return out


def test_line_bits_spread_ink_over_word_edges(spark):
    px, dark = flags(spark)
    rows = nl.line_bits(px).collect()
    near = {(r + y, c + x) for r, c in dark for y in range(-2, 3) for x in range(-2, 3)}
    inside = {(r, c) for r, c in near if 0 <= r < H and 0 <= c < W}
    by_row, by_col = unpacked(rows, "dark", "row"), {(b, a) for a, b in unpacked(rows, "dark", "col")}
    assert {p for p in by_row if p[0] in range(H) and p[1] in range(W)} == inside
    assert {p for p in by_col if p[0] in range(H) and p[1] in range(W)} == inside
    assert unpacked(rows, "seen", "row") == {(r, c) for r in range(H) for c in range(W)}
    assert len(rows) <= (H + 4) * 5 + (W + 4) * 4  # a line is a few numbers, not its pixels


def test_profiles_take_the_middle_of_long_lines(spark):
    px, dark = flags(spark)
    h = spark.createDataFrame([(1, W, H)], "item_id long, width int, height int")
    got = {(r.side, r.i): r.frac for r in nl.edge_profiles(px, h).collect()}
    white = {(r, c) for r in range(H) for c in range(W) if c < 9 or r >= 60} - dark
    for c in range(W):
        assert got["W", c] == got["E", W - 1 - c] == sum((r, c) in white for r in range(14, 56)) / 42
    for r in range(H):
        assert got["N", r] == got["S", H - 1 - r] == sum((r, c) in white for c in range(28, 112)) / 84
    assert len(got) == 2 * (W + H)


def test_both_detectors_share_one_reading_of_the_pixels(spark, tmp_path):
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b
    px, _ = flags(spark)
    px = px.mapInArrow(count, px.schema)
    h = spark.createDataFrame([(1, W, H, 0.5 / 60, -100.0, -0.5 / 60, 30.0)], "item_id long, width int, height int, a double, c double, e double, f double")
    assert nl.detect_clip(px, h).count() == 1
    assert n.value == W * H
