"""Pixel values, band roles and colour tests as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



ELEV_NODATA = -32767.0


def valid_elevation(v: Column) -> Column:
    return (v != ELEV_NODATA) & ~F.isnan(v) & (F.abs(v) != float("inf"))


def band_roles(roles: Column, kind: Column) -> Column:
    """struct(mode, alpha_band, bands) from the colour roles of a raster's bands."""
    alpha = F.array_position(roles, F.lit("alpha"))
    colours = F.size(roles) - F.when(alpha > 0, 1).otherwise(0)
    rgb = F.array(*[F.array_position(roles, F.lit(r)).cast("int") for r in ("red", "green", "blue")])
    mode = (F.when(kind == "elevation", F.lit("elevation"))
            .when((F.size(roles) == 1) & (F.element_at(roles, 1) == "palette"), F.lit("palette"))
            .when(colours < 3, F.lit("gray")).otherwise(F.lit("rgb")))
    bands = (F.when(mode != "rgb", F.array(F.lit(1)))
             .when(F.forall(rgb, lambda p: p > 0), rgb).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return F.struct(mode.alias("mode"), F.when(alpha > 0, alpha.cast("int")).alias("alpha_band"), bands.alias("bands"))


def to_uint8(values: Column, dtype: Column, window: Column | None = None) -> Column:
    """Eight-bit values of one band. Sixteen-bit data is scaled by 4095 when the whole ``window``, the
    values of all bands together, stays within it, else by 65535, in single precision and truncated."""
    top = F.when(F.coalesce(F.array_max(values if window is None else window), F.lit(0)) <= 4095, F.lit(4095.0)).otherwise(F.lit(65535.0))
    ratio = (F.lit(255.0) / top).cast("float")

    def clip(x):
        return F.greatest(F.lit(0), F.least(F.lit(255), x.cast("int")))
    return (F.when(dtype == "uint8", F.transform(values, lambda v: v.cast("int")))
            .when(dtype == "uint16", F.transform(values, lambda v: clip(v.cast("float") * ratio)))
            .otherwise(F.transform(values, clip)))


def bands_to_uint8(bands: Column, dtype: Column) -> Column:
    """All bands of one window (an array of arrays) with one scale."""
    return F.transform(bands, lambda b: to_uint8(b, dtype, F.flatten(bands)))


def gray_to_rgb(values: Column) -> Column:
    return F.array(values, values, values)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def is_white(r: Column, g: Column, b: Column) -> Column:
    return F.least(r, g, b) >= 240


def resampling_policy(mode: Column, resampling: Column, ratio: Column) -> Column:
    """struct(factor, method): charts are sampled nearest at up to four times and box-averaged."""
    crisp = (mode == "palette") | (resampling == "nearest")
    factor = F.when(crisp, F.least(F.lit(4), F.greatest(F.lit(1), F.rint(ratio).cast("int")))).otherwise(1)
    smooth = (mode == "elevation") | ((resampling != "nearest") & (mode != "palette"))
    method = F.when(smooth, F.when(ratio > 1.5, F.lit("average")).otherwise(F.lit("bilinear"))).otherwise(F.lit("nearest"))
    return F.struct(factor.alias("factor"), method.alias("method"))


def overview_factors(w: Column, h: Column) -> Column:
    """2, 4, 8 ... while the longer side stays at 256 or more."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.pow(F.lit(2.0), k).cast("int")),
                    lambda f: F.greatest(w, h) / f >= 256)


def overview_level(native: Column, factors: Column, target: Column) -> Column:
    """Index of the coarsest overview still as fine as the target, or null for full resolution."""
    fit = F.filter(factors, lambda f: native * f <= target * 1.01)
    return F.when(F.size(fit) > 0, F.size(fit) - 1)


def box_average(values: Column, factor: Column) -> Column:
    """Rounded mean of f x f sub-pixels, as (sum + f*f/2) div (f*f)."""
    n = factor * factor
    total = F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v.cast("long"))
    return F.floor((total + F.floor(n / 2)) / n).cast("int")


