"""Web-Mercator tile arithmetic as Column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import EARTH_RADIUS_M, _c, center_lat

# Latitude limit of the square Mercator world and half its side in metres.
MAX_LAT = 85.0511
MERCATOR_HALF = 20037508.342789244
WORLD_M = 2 * math.pi * EARTH_RADIUS_M


def resolution(zoom: Column, lat: Column, tile: int = 256) -> Column:
    return F.lit(WORLD_M) * F.cos(F.radians(lat)) / tile / F.pow(F.lit(2.0), zoom)


def zoom_for(res_m: Column, lat: Column, tile: int = 256) -> Column:
    """Smallest zoom at least as fine as res_m, within 0..23."""
    z0 = F.lit(WORLD_M) * F.cos(F.radians(lat)) / tile
    z = F.ceil(F.log2(z0 / F.greatest(res_m, F.lit(0.01))))
    return F.greatest(F.lit(0), F.least(F.lit(23), z.cast("int")))


def choose_zoom(res_m: Column, bbox: Column, max_zoom) -> Column:
    """Zoom a tile service is read at for a wanted resolution."""
    return F.least(_c(max_zoom), zoom_for(F.greatest(res_m, F.lit(0.05)), center_lat(bbox)))


def _x(lon: Column, n: Column) -> Column:
    return ((lon + 180.0) / 360.0 * n).cast("long")


def _y(lat: Column, n: Column) -> Column:
    lat = F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT))
    return ((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n).cast("long")


def lonlat_to_tile(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), z).cast("long")
    zero = F.lit(0).cast("long")
    return (F.least(F.greatest(_x(lon, n), zero), n - 1), F.least(F.greatest(_y(lat, n), zero), n - 1))


def tile_range(bbox: Column, z: Column) -> Column:
    """Inclusive tile range covering a box; an edge exactly on a tile border takes no extra tile."""
    n = F.pow(F.lit(2.0), z).cast("long")
    zero = F.lit(0).cast("long")
    return F.struct(F.greatest(zero, _x(bbox.west, n)).alias("x0"), F.greatest(zero, _y(bbox.north, n)).alias("y0"),
                    F.least(n - 1, _x(bbox.east - 1e-12, n)).alias("x1"),
                    F.least(n - 1, _y(bbox.south + 1e-12, n)).alias("y1"))


def tile_count(rng: Column) -> Column:
    return (F.abs(rng.x1 - rng.x0) + 1) * (F.abs(rng.y1 - rng.y0) + 1)


def lon_to_mercator(lon: Column) -> Column:
    return lon * (MERCATOR_HALF / 180.0)


def lat_to_mercator(lat: Column) -> Column:
    lat = F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT))
    return F.asinh(F.tan(F.radians(lat))) * (MERCATOR_HALF / math.pi)


def mercator_to_lon(x: Column) -> Column:
    return x * (180.0 / MERCATOR_HALF)


def mercator_to_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y * (math.pi / MERCATOR_HALF))))
