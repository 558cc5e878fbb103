"""Bounding boxes, rings, output grids and ground resolution, as Column expressions.

A box is a struct(west, south, east, north) in WGS84 degrees; boxes never cross the antimeridian.
A ring is an array of struct(lon, lat) whose last point repeats the first.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, metres per degree of latitude, metres per nautical mile, pixel pitch
# of a 96-dpi screen in metres, and the box area (km2) above which an area counts as large.
EARTH_RADIUS_M = 6_378_137.0
METERS_PER_DEG = 111_320.0
NM_TO_M = 1852.0
PIXEL_PITCH_M = 0.0002645833
LARGE_AREA_KM2 = 20_000.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def make_bbox(w, s, e, n) -> Column:
    return F.struct(_c(w).cast("double").alias("west"), _c(s).cast("double").alias("south"),
                    _c(e).cast("double").alias("east"), _c(n).cast("double").alias("north"))


def bbox_error(b: Column) -> Column:
    """Null for a usable box, else the reason it is refused."""
    lon_ok = (b.west >= -180) & (b.west < b.east) & (b.east <= 180)
    lat_ok = (b.south >= -90) & (b.south < b.north) & (b.north <= 90)
    return (F.when(~F.coalesce(lon_ok, F.lit(False)), F.lit("longitude range"))
            .when(~F.coalesce(lat_ok, F.lit(False)), F.lit("latitude range")))


def intersects(a: Column, b: Column) -> Column:
    """Open-interval overlap: boxes that only touch do not intersect."""
    return (b.east > a.west) & (b.west < a.east) & (b.north > a.south) & (b.south < a.north)


def intersection(a: Column, b: Column) -> Column:
    """The common box, or null when there is none."""
    w, s = F.greatest(a.west, b.west), F.greatest(a.south, b.south)
    e, n = F.least(a.east, b.east), F.least(a.north, b.north)
    return F.when((w < e) & (s < n), make_bbox(w, s, e, n))


def box_area_deg(b: Column) -> Column:
    return (b.east - b.west) * (b.north - b.south)


def overlap_fraction(area: Column, footprint: Column, floor: float | None = None) -> Column:
    """Share of ``footprint`` (in square degrees) lying inside ``area``; 0 when disjoint."""
    denom = box_area_deg(footprint)
    if floor is not None:
        denom = F.greatest(denom, F.lit(floor))
    return F.coalesce(box_area_deg(intersection(area, footprint)) / denom, F.lit(0.0))


def center_lat(b: Column) -> Column:
    return (b.south + b.north) / 2


def size_m(b: Column) -> tuple[Column, Column]:
    w = (b.east - b.west) * METERS_PER_DEG * F.cos(F.radians(center_lat(b)))
    return w, (b.north - b.south) * METERS_PER_DEG


def area_stats(b: Column) -> Column:
    """Sides in km and nautical miles, area in km2 and the large-area flag."""
    wkm = (b.east - b.west) * (METERS_PER_DEG / 1000) * F.cos(center_lat(b) * math.pi / 180)
    hkm = (b.north - b.south) * (METERS_PER_DEG / 1000)
    return F.struct(wkm.alias("wkm"), hkm.alias("hkm"), (wkm * hkm).alias("km2"),
                    (wkm * 1000 / NM_TO_M).alias("wnm"), (hkm * 1000 / NM_TO_M).alias("hnm"),
                    (wkm * hkm > LARGE_AREA_KM2).alias("large"))


def envelope(ring: Column) -> Column:
    """Smallest box around a ring."""
    lons, lats = F.transform(ring, lambda p: p.lon), F.transform(ring, lambda p: p.lat)
    return make_bbox(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))


def close_ring(ring: Column) -> Column:
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    same = (first.lon == last.lon) & (first.lat == last.lat)
    return F.when(same, ring).otherwise(F.concat(ring, F.array(first)))


def ring_error(ring: Column) -> Column:
    """Null for a usable polygon; its box is always derived from the points themselves."""
    bad = F.exists(ring, lambda p: F.isnan(p.lon) | F.isnan(p.lat) | p.lon.isNull() | p.lat.isNull()
                   | (F.abs(p.lon) == float("inf")) | (F.abs(p.lat) == float("inf")))
    return (F.when(F.size(ring) < 3, F.lit("fewer than 3 points"))
            .when(bad, F.lit("non-finite point"))
            .otherwise(bbox_error(envelope(ring))))


def _edges(ring: Column, fn) -> Column:
    """fn(p, q) for each edge of a closed ring."""
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), fn)


def polygon_area_km2(ring: Column) -> Column:
    """Shoelace area of an open ring in equirectangular km at the mean vertex latitude."""
    n = F.size(ring)
    lat0 = F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p.lat) / n
    kx, ky = (METERS_PER_DEG / 1000) * F.cos(lat0 * math.pi / 180), METERS_PER_DEG / 1000
    rotated = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, rotated, lambda p, q: p.lon * kx * (q.lat * ky) - q.lon * kx * (p.lat * ky))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2


def in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test; an edge counts its lower end and not its upper one."""
    def hit(p, q):
        # The guard keeps a horizontal edge from dividing by zero under ANSI rules.
        dy = F.when(q.lat == p.lat, F.lit(None)).otherwise(q.lat - p.lat)
        at = (q.lon - p.lon) * (lat - p.lat) / dy + p.lon
        return F.when((p.lat > lat) != (q.lat > lat), F.when(lon < at, 1).otherwise(0)).otherwise(0)
    crossings = F.aggregate(_edges(ring, hit), F.lit(0), lambda acc, x: acc + x)
    return crossings % 2 == 1


def in_all_rings(rings: Column, lon: Column, lat: Column) -> Column:
    """True when the point is inside every ring; no rings means no clipping."""
    return rings.isNull() | F.forall(rings, lambda r: in_ring(r, lon, lat))


def clip_footprint(rings: Column, footprint: Column) -> Column:
    """Footprint cut to the rings' envelopes; a disjoint envelope leaves it unchanged."""
    world = make_bbox(-180.0, -90.0, 180.0, 90.0)

    def shrink(acc, ring):
        env = envelope(ring)
        env = make_bbox(F.greatest(env.west, world.west), F.greatest(env.south, world.south),
                        F.least(env.east, world.east), F.least(env.north, world.north))
        return F.coalesce(intersection(acc, env), acc)
    return F.aggregate(F.coalesce(rings, F.array().cast("array<array<struct<lon:double,lat:double>>>")),
                       footprint, shrink)


def meters_to_deg(res_m: Column, lat: Column) -> tuple[Column, Column]:
    """Pixel size in degrees (x, y) for a ground resolution at a latitude."""
    y = res_m / METERS_PER_DEG
    return y / F.greatest(F.cos(F.radians(lat)), F.lit(0.01)), y


def deg_to_meters(res_deg: Column) -> Column:
    return res_deg * METERS_PER_DEG


def grid_size(b: Column, res_m: Column) -> tuple[Column, Column]:
    """Width and height in pixels; halves round to even."""
    xd, yd = meters_to_deg(res_m, center_lat(b))
    w = F.greatest(F.lit(1).cast("long"), F.rint((b.east - b.west) / xd).cast("long"))
    h = F.greatest(F.lit(1).cast("long"), F.rint((b.north - b.south) / yd).cast("long"))
    return w, h


def make_grid(b: Column, res_m: Column) -> Column:
    """struct(bbox, width, height, xres, yres, pixels) of the output raster."""
    w, h = grid_size(b, res_m)
    return F.struct(b.alias("bbox"), w.alias("width"), h.alias("height"),
                    ((b.east - b.west) / w).alias("xres"), ((b.north - b.south) / h).alias("yres"),
                    (w * h).alias("pixels"))


def window_bbox(grid: Column, col: Column, row: Column, w: Column, h: Column) -> Column:
    b = grid.bbox
    return make_bbox(b.west + col * grid.xres, b.north - (row + h) * grid.yres,
                     b.west + (col + w) * grid.xres, b.north - row * grid.yres)


def pixel_center(a: Column, c: Column, idx: Column) -> Column:
    """Coordinate of the centre of pixel ``idx`` on an axis with origin c and step a."""
    return c + (idx + 0.5) * a


def pixel_index(a: Column, c: Column, coord: Column) -> Column:
    """Pixel that contains a coordinate on an axis with origin c and step a."""
    return F.floor((coord - c) / a)


def interior_depth(lon: Column, lat: Column, fp: Column) -> Column:
    """Normalised distance to the nearest edge: 0.5 in the middle, negative outside."""
    dx = F.least(lon - fp.west, fp.east - lon) / (fp.east - fp.west)
    dy = F.least(lat - fp.south, fp.north - lat) / (fp.north - fp.south)
    return F.least(dx, dy)


def native_res_m(crs: Column, pixel: Column, lat: Column) -> Column:
    """Ground metres per pixel: degrees and Mercator metres shrink with latitude, others do not."""
    cos = F.cos(F.radians(lat))
    return (F.when(crs == "geographic", F.abs(pixel) * METERS_PER_DEG * F.greatest(cos, F.lit(0.1)))
            .when(crs == "mercator", F.abs(pixel) * F.greatest(cos, F.lit(0.01)))
            .otherwise(F.abs(pixel)))


def crs_family(epsg: Column, wkt: Column) -> Column:
    """geographic, mercator or projected, from an EPSG code and WKT text."""
    # EPSG codes of Mercator map grids.
    mercator = epsg.isin(3857, 3395, 900913, 3785) | (wkt.contains("Mercator") & ~wkt.contains("Transverse"))
    return (F.when(wkt.rlike(r"^\s*GEO"), F.lit("geographic"))
            .when(F.coalesce(mercator, F.lit(False)), F.lit("mercator")).otherwise(F.lit("projected")))


def bbox_from_center(lat: Column, lon: Column, radius_nm: Column) -> Column:
    """Box around a point, null for an unusable centre or radius."""
    r = radius_nm * NM_TO_M
    dlat, dlon = r / METERS_PER_DEG, r / (METERS_PER_DEG * F.cos(lat * math.pi / 180))
    ok = (F.abs(lat) <= 89) & (radius_nm > 0)
    return F.when(ok, make_bbox(lon - dlon, lat - dlat, lon + dlon, lat + dlat))


def display_scale(res_m: Column) -> Column:
    """Denominator of the native display scale and of its useful range."""
    native = res_m / PIXEL_PITCH_M
    return F.struct(native.alias("native"), (native / 2).alias("finest"), (native * 8).alias("coarsest"))


def split_bbox(b: Column, cols: Column, rows: Column) -> Column:
    """Array of (idx, bbox) pieces covering the box exactly, south to north then west to east."""
    dw, dh = (b.east - b.west) / cols, (b.north - b.south) / rows
    return F.transform(F.sequence(F.lit(0), (cols * rows - 1).cast("int")), lambda i: F.struct(
        i.alias("idx"),
        make_bbox(b.west + (i % cols) * dw, b.south + F.floor(i / cols) * dh,
                  b.west + (i % cols + 1) * dw, b.south + (F.floor(i / cols) + 1) * dh).alias("bbox")))


def split_size(factor: Column) -> tuple[Column, Column]:
    """(cols, rows) of a near-square split with at least ceil(factor) pieces."""
    n = F.greatest(F.lit(2), F.ceil(factor).cast("int"))
    cols = F.ceil(F.sqrt(n)).cast("int")
    return cols, F.ceil(n / cols).cast("int")
