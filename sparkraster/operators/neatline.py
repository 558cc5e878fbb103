"""Finding the face of scanned charts: white collars by profile, printed neatlines by graticule.

Charts come as pixel rows (item_id, row, col, white, dark) with a header row per chart
(item_id, width, height, a, c, e, f) in lon/lat. Everything is grouped by chart and line, 64 pixels of a line
in one number, so a chart of any size spreads over the cluster; only edge profiles, as long as a chart side, become arrays.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut_lineage

CLIP_VERSION = 1
# Luminance below which a pixel is dark, probes per line, search limit in minutes.
DARK = 90.0
PROBES = 500
MAX_MINUTES = 90


WORD = 64  # pixels of a line that share one number


def line_bits(pixels: DataFrame) -> DataFrame:
    """item_id, axis, pos, word, seen, white, dark: each column and row of a chart as numbers of 64 bits, one bit a pixel.

    ``dark`` marks pixels with ink up to two pixels away. Pixels are or-ed map-side, so a line of a chart is shuffled as a few numbers, not pixel by pixel.
    """
    both = pixels.selectExpr("item_id", "coalesce(white, false) AS white", "coalesce(dark, false) AS dark",
                             "inline(array(struct('col' AS axis, int(col) AS pos, int(row) AS i), struct('row' AS axis, int(row) AS pos, int(col) AS i)))")
    near = (both.selectExpr("*", f"i % {WORD} AS b", "explode(if(dark, sequence(-2, 2), array(0))) AS d")
            .selectExpr("*", f"explode(if(dark AND b < 2, array(-1, 0), if(dark AND b >= {WORD - 2}, array(0, 1), array(0)))) AS x"))
    return (near.selectExpr("item_id", "axis", "pos + d AS pos", f"int(i div {WORD}) + x AS word",
                            "if(d = 0 AND x = 0, shiftleft(1L, b), 0L) AS seen", "if(white AND d = 0 AND x = 0, shiftleft(1L, b), 0L) AS white",
                            f"if(NOT dark, 0L, CASE x WHEN -1 THEN shiftleft(31L, b + {WORD - 2}) WHEN 1 THEN shiftright(31L, {WORD + 2} - b) "
                            "ELSE if(b < 2, shiftright(31L, 2 - b), shiftleft(31L, b - 2)) END) AS dark")
            .groupBy("item_id", "axis", "pos", "word").agg(*[F.expr(f"bit_or({c}) AS {c}") for c in ("seen", "white", "dark")]))


def edge_profiles(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """item_id, side, i, frac: white share of each column (row) over the middle 60 percent, counted
    inward from each side, over all pixels."""
    return profiles_of(line_bits(pixels), headers)


def profiles_of(bits: DataFrame, headers: DataFrame) -> DataFrame:
    """``edge_profiles`` from ``line_bits``."""
    def ones(x: str) -> str:
        return f"if({x} >= {WORD}, -1L, ~shiftleft(-1L, greatest({x}, 0)))"
    h = headers.selectExpr("item_id", "inline(array(struct('col' AS axis, int(width) AS n, int(height) AS len), struct('row' AS axis, int(height) AS n, int(width) AS len)))")
    mask = f"{ones(f'int(len * 0.8D) - word * {WORD}')} & ~{ones(f'int(len * 0.2D) - word * {WORD}')}"
    frac = (bits.join(h, ["item_id", "axis"]).selectExpr("*", f"{mask} AS inside").groupBy("item_id", "axis", "pos")
            .agg(F.expr("sum(bit_count(white & inside)) AS w"), F.expr("sum(bit_count(seen & inside)) AS s"), F.first("n").alias("n"))
            .filter("s > 0").selectExpr("item_id", "axis", "pos", "w / s AS frac", "n"))
    return frac.selectExpr("item_id", "n", "frac", "inline(array(struct(if(axis = 'col', 'W', 'N') AS side, pos AS i), "
                           "struct(if(axis = 'col', 'E', 'S') AS side, n - 1 - pos AS i)))")


def collar_cuts(profiles: DataFrame) -> DataFrame:
    """item_id, side, cut (pixels): where the face begins, 0 without clear evidence."""
    arr = profiles.groupBy("item_id", "side").agg(F.expr("transform(array_sort(collect_list(struct(i, frac))), x -> x.frac) AS fr"), F.first("n").alias("n"))
    mean = "aggregate({0}, 0D, (s, x) -> s + x) / size({0})"
    return (arr.selectExpr("*", "greatest(3, int(n * 0.02D)) AS k")
            .selectExpr("*", "if(int(n * 0.3D) < 1, NULL, try_element_at(filter(sequence(0, greatest(0, int(n * 0.3D) - 1)), i -> array_max(slice(fr, i + 1, k)) < 0.3D), 1)) AS at")
            .selectExpr("*", "slice(fr, 1, greatest(0, coalesce(at, 0))) AS collar", "slice(fr, coalesce(at, 0) + 1, greatest(k, int(n * 0.1D))) AS face")
            .selectExpr("item_id", "side", f"if(coalesce(at, 0) > 0 AND {mean.format('collar')} >= 0.6D AND {mean.format('face')} <= 0.1D, at, 0) AS cut"))


def pixel_clip(cuts: DataFrame, headers: DataFrame) -> DataFrame:
    """item_id, px = array(c0, r0, c1, r1), or null when no side is cut."""
    c = cuts.groupBy("item_id").agg(*[F.max(F.when(F.col("side") == s, F.col("cut"))).alias(f"cut_{s}") for s in "WNES"])
    px = F.expr("array(cut_W, cut_N, width - cut_E, height - cut_S)")
    return headers.join(c, "item_id").select("item_id", F.when(F.expr("cut_W + cut_N + cut_E + cut_S > 0"), px).alias("px"))


def _lines(headers: DataFrame, max_minutes: int = MAX_MINUTES, share: float = 0.3) -> DataFrame:
    """Candidate lines: item_id, side, k, v with the chart's extent; whole minutes stepping inward."""
    h = headers.selectExpr("*", "c AS wm", "f AS nm", "c + width * a AS em", "f + height * e AS sm") \
        .selectExpr("*", f"int(least({max_minutes}D, 60 * {share}D * least(nm - sm, em - wm))) AS lim").filter("lim > 0")
    return (h.selectExpr("*", "explode(sequence(0, lim - 1)) AS k").selectExpr("*", "explode(array('W', 'S', 'E', 'N')) AS side")
            .selectExpr("*", "CASE side WHEN 'W' THEN ceil(wm * 60) / 60 + k / 60D WHEN 'E' THEN floor(em * 60) / 60 - k / 60D "
                             "WHEN 'S' THEN ceil(sm * 60) / 60 + k / 60D ELSE floor(nm * 60) / 60 - k / 60D END AS v"))


def graticule_hits(pixels: DataFrame, headers: DataFrame, probes: int = PROBES, max_minutes: int = MAX_MINUTES, share: float = 0.3) -> DataFrame:
    """item_id, side, v: outermost whole-minute line that is dark along its central span and has white
    paper two minutes outside it.
    """
    return hits_of(line_bits(pixels), headers, probes, max_minutes, share)


def hits_of(bits: DataFrame, headers: DataFrame, probes: int = PROBES, max_minutes: int = MAX_MINUTES, share: float = 0.3) -> DataFrame:
    """``graticule_hits`` from ``line_bits``.

    All lines along an axis of a chart are probed at the same steps, so these are counted once by pixel. A line lies on one column
    or row, and meets its bits there.
    """
    step = probes - 1
    steps = (headers.selectExpr("item_id", "inline(array(struct('col' AS axis, f + height * e AS lo, f AS hi, f AS zero, e AS size, height AS len), "
                                "struct('row' AS axis, c AS lo, c + width * a AS hi, c AS zero, a AS size, width AS len)))")
             .selectExpr("*", "lo + 0.15D * (hi - lo) AS s0", "hi - 0.15D * (hi - lo) AS s1").selectExpr("*", f"explode(sequence(0, {step})) AS i")
             .selectExpr("item_id", "axis", "len", f"int(rint((if(i = {step}, s1, i * ((s1 - s0) / {step}) + s0) - zero) / size)) AS p").filter("p >= 0 AND p < len")
             .groupBy("item_id", "axis", "len", "p").agg(F.count("*").alias("n")).selectExpr("*", "p >= 2 AND p < len - 2 AS inner"))
    totals = steps.groupBy("item_id", "axis").agg(F.expr("sum(if(inner, n, 0L)) AS dn"), F.expr("sum(n) AS wn"))
    words = steps.groupBy("item_id", "axis", F.expr(f"int(p div {WORD}) AS word")).agg(F.expr(f"collect_list(struct(p % {WORD} AS b, n, inner)) AS at"))
    lines = (_lines(headers, max_minutes, share).selectExpr("*", "if(side IN ('W', 'E'), 'col', 'row') AS axis")
             .selectExpr("*", "inline(array(struct('dark' AS test, 2 AS rad, v AS at), struct('white' AS test, 0 AS rad, if(side IN ('W', 'S'), v - 2D / 60, v + 2D / 60) AS at)))")
             .selectExpr("item_id", "axis", "side", "k", "v", "test", "rad", "if(axis = 'col', width, height) AS len", "int(rint(if(axis = 'col', (at - c) / a, (at - f) / e))) AS pos")
             .filter("pos >= rad AND pos < len - rad").select("item_id", "axis", "pos", "side", "k", "v", "test"))
    hit = "aggregate(at, 0L, (s, x) -> s + if({0} AND (shiftright({1}, x.b) & 1L) = 1L, x.n, 0L))"
    seen = (bits.select("item_id", "axis", "pos", "word", "white", "dark").filter("white <> 0 OR dark <> 0").join(lines, ["item_id", "axis", "pos"]).join(words, ["item_id", "axis", "word"])
            .selectExpr("item_id", "axis", "side", "k", "v", "test", f"if(test = 'dark', {hit.format('x.inner', 'dark')}, {hit.format('true', 'white')}) AS hits")
            .groupBy("item_id", "axis", "side", "k", "v").agg(F.expr("sum(if(test = 'dark', hits, 0L)) AS dh"), F.expr("sum(if(test = 'white', hits, 0L)) AS wh")))
    # A line without hits is no neatline, so lines that meet no bits may go.
    ok = seen.join(totals, ["item_id", "axis"]).filter(f"dh > 0 AND wh > 0 AND dn >= 0.9D * {probes} AND dh >= 0.95D * dn AND wn >= 0.5D * {probes} AND wh >= 0.8D * wn")
    return ok.groupBy("item_id", "side").agg(F.round(F.min_by("v", "k"), 6).alias("v"))


def detect_clip(pixels: DataFrame, headers: DataFrame) -> DataFrame:
    """item_id, clip = struct(v, px, ll): both detectors for every chart."""
    bits = cut_lineage(line_bits(pixels), "line-bits")
    px = pixel_clip(collar_cuts(profiles_of(bits, headers)), headers)
    ll = hits_of(bits, headers).groupBy("item_id").agg(F.expr(
        "array(" + ", ".join(f"max(if(side = '{s}', v, NULL))" for s in "WSEN") + ") AS ll"))
    return (px.join(ll, "item_id", "left").select("item_id", F.struct(
        F.lit(CLIP_VERSION).alias("v"), "px", F.coalesce("ll", F.expr("array(double(NULL), double(NULL), double(NULL), double(NULL))")).alias("ll")).alias("clip")))


def clip_polygons(clip: Column, a: Column, c: Column, e: Column, f: Column) -> Column:
    """Rings of a clip: the lon/lat box with open sides at the world's edge, and the pixel box with 65
    points per edge. Null when neither applies."""
    ll = clip.ll
    w, s, x, n = (F.coalesce(F.get(ll, i), F.lit(d)) for i, d in enumerate((-180.0, -90.0, 180.0, 90.0)))
    box = F.array(*[F.struct(p.alias("lon"), q.alias("lat")) for p, q in ((w, s), (x, s), (x, n), (w, n), (w, s))])
    c0, r0, c1, r1 = (F.get(clip.px, i) for i in range(4))
    t = F.sequence(F.lit(0), F.lit(64))

    def edge(cs, rs):
        return F.transform(t, lambda i: F.struct((c + cs(i / 64.0) * a).alias("lon"), (f + rs(i / 64.0) * e).alias("lat")))
    ring = F.concat(edge(lambda u: c0 + (c1 - c0) * u, lambda u: r0 + 0 * u), edge(lambda u: c1 + 0 * u, lambda u: r0 + (r1 - r0) * u),
                    edge(lambda u: c1 - (c1 - c0) * u, lambda u: r1 + 0 * u), edge(lambda u: c0 + 0 * u, lambda u: r1 - (r1 - r0) * u))
    rings = F.array_compact(F.array(F.when(F.exists(ll, lambda v: v.isNotNull()), box), F.when(clip.px.isNotNull(), ring)))
    return F.when(F.size(rings) > 0, rings)
