"""Names, labels, URLs and text parsing as Column expressions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def crs_label(epsg: Column, wkt: Column) -> Column:
    """'EPSG:4326 (WGS 84)', the bare name without a code, or 'no georeferencing'."""
    name = F.regexp_extract(wkt, r'^\s*(?:PROJCS|PROJCRS|GEOGCS|GEOGCRS|GEODCRS)\["([^"]+)"', 1)
    return (F.when(wkt.isNull(), F.lit("no georeferencing"))
            .when(epsg.isNull(), F.when(name == "", wkt).otherwise(name))
            .otherwise(F.format_string("EPSG:%d (%s)", epsg, F.when(name == "", wkt).otherwise(name))))


def format_label(driver: Column) -> Column:
    # Driver names and their plain labels; other drivers keep their name.
    labels = {"GTiff": "GeoTIFF", "DTED": "DTED", "NITF": "NITF", "JP2OpenJPEG": "JPEG 2000"}
    return reduce(lambda acc, kv: acc.when(driver == kv[0], F.lit(kv[1])), list(labels.items())[1:],
                  F.when(driver == "GTiff", F.lit("GeoTIFF"))).otherwise(driver)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _or(s: Column, default: str) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def safe_name(s: Column, most: int = 60) -> Column:
    """Folder-safe name of at most ``most`` characters, 'area' when nothing is left. Names that the cut makes equal are told apart by W07."""
    return _or(F.substring(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, most), "area")


def safe_stem(s: Column, most: int = 80) -> Column:
    """File-safe stem of at most ``most`` characters; letters of any script are kept."""
    return _or(F.substring(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w .,()+-]+", "_"), "^[ ._]+|[ ._]+$", ""), 1, most), "file")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def item_stem(path: Column, label: Column, service: Column) -> Column:
    """Output name of a raster: services by label, index entries by product, hashed names by label."""
    # Fixed value: how index entries are named.
    entry = r"(?i)^(?:NITF|ECRG)_TOC_ENTRY:(.*):[^:]*(?:A\.TOC|TOC\.xml)$"
    base = stem(file_name(path))
    remote = stem(file_name(F.split(path, r"\?").getItem(0)))
    plain = (file_name(path).rlike(r".\.[^.]+$") & ~path.rlike("^(/vsi|WMTS:)") & ~base.rlike("^[0-9a-f]{16,}$")
             & ~F.lower(path).endswith(".xml"))
    shown = F.when(F.coalesce(label, F.lit("")) == "", base).otherwise(label)
    return safe_stem(F.when(service, shown)
                     .when(path.rlike(entry), F.replace(F.regexp_extract(path, entry, 1), F.lit(":"), F.lit("-")))
                     .when(path.startswith("/vsicurl/"), remote).when(plain, base).otherwise(shown))


def rpf_product(sub: Column) -> Column:
    """Product name of a frame index entry: prefix, path and trailing numbers removed."""
    body = F.when(sub.startswith("NITF_TOC_ENTRY:"), F.regexp_extract(sub, "^NITF_TOC_ENTRY:(.*):[^:]*$", 1)).otherwise(sub)
    return F.replace(F.regexp_replace(body, r"(_\d+)+$", ""), F.lit("_"), F.lit(" "))


def ecrg_product(sub: Column) -> Column:
    parts = F.split(sub, ":")
    middle = F.filter(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 2)), lambda p: (p != "") & ~p.startswith("/"))
    return F.concat(F.lit("ECRG "), F.array_join(middle, " "))


def host_key(kind: Column, url: Column) -> Column:
    host = F.try_parse_url(url, F.lit("AUTHORITY"))
    return F.concat(kind, F.lit(":"), F.coalesce(host, url))


def tile_url(template: Column, z: Column, x: Column, y: Column) -> Column:
    for mark, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        template = F.replace(template, F.lit(mark), value.cast("string"))
    return template


def cache_name(url: Column) -> Column:
    """Twelve hex digits of the URL's SHA-1 and its last path part; equal part names stay apart."""
    return F.concat(F.substring(F.sha1(url), 1, 12), F.lit("_"), file_name(url))


def tile_cache_folder(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 10)


def resolve_url(base: Column, href: Column) -> Column:
    """href against the URL of the document it stands in."""
    up = F.length(F.regexp_extract(href, r"^(?:\./)?((?:\.\./)*)", 1)) / 3
    rest = F.regexp_replace(href, r"^(?:\./)?(?:\.\./)*", "")
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    dirs = F.split(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/?(.*?)[^/]*$", 1), "/")
    dirs = F.filter(dirs, lambda d: d != "")
    kept = F.slice(dirs, F.lit(1), F.greatest(F.lit(0), F.size(dirs) - up.cast("int")))
    return (F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(root, href))
            .otherwise(F.concat(root, F.lit("/"), F.array_join(F.concat(kept, F.array(rest)), "/"))))


def text_bounds(text: Column) -> Column:
    """Box named by <side>_Bounding_Coordinate in metadata text; null if a side is missing or the box is empty."""
    def side(name):
        got = F.regexp_extract(text, name + r"_Bounding_Coordinate:\s*(?:<[^>]*>\s*)*(-?\d+(?:\.\d+)?)", 1)
        return F.when(got != "", got).try_cast("double")
    w, e, n, s = (side(x) for x in ("West", "East", "North", "South"))
    return F.when((w < e) & (s < n), F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north")))


# Patterns tried in order and the class each stands for.
ERROR_CLASSES = [
    ("(?i)504|gateway time-?out|timed? ?out", "server timed out"),
    ("(?i)5\\d\\d |server error", "server error"),
    ("(?i)pixel limit", "too much detail"),
    ("(?i)no data .* intersects|intersects the area", "no data in area"),
    ("(?i)ssl|certificate|handshake", "secure connection failed"),
    ("(?i)401|403|unauthori[sz]ed|forbidden", "access refused"),
    ("(?i)resolve|connect|network|unreachable", "server unreachable"),
    ("(?i)no space|507|free on", "disk full"),
]
# Fixed value: messages of read failures worth another try.
TRANSIENT = ("(?i)Unable to download block|Recv failure|Connection reset|Connection refused|timed out|Timeout was reached|"
             "Couldn't connect|Empty reply|SSL|HTTP status code: 5\\d\\d|Operation too slow")


def error_class(msg: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for pattern, label in ERROR_CLASSES:
        out = out.when(msg.rlike(pattern), F.lit(label))
    return out


def is_transient(chain: Column) -> Column:
    """True when any message of an exception chain names a network failure."""
    return F.exists(chain, lambda m: m.rlike(TRANSIENT))


def tile_outcome(status: Column, n_bytes: Column) -> Column:
    """What one tile response means; a null status is a transport error."""
    return (F.when(status.isNull(), F.lit("retry")).when((status == 200) & (n_bytes > 0), F.lit("tile"))
            .when(status.isin(204, 404) | (status == 200), F.lit("empty")).when(status.isin(401, 403), F.lit("abort"))
            .when(status == 429, F.lit("slow down")).otherwise(F.lit("retry")))


def slow_down_seconds(status: Column, retry_after: Column) -> Column:
    return F.when(status == 429, F.least(F.lit(60.0), F.when(F.coalesce(retry_after, F.lit("")) == "", F.lit(5.0)).otherwise(retry_after.try_cast("double"))))


def export_outcome(status: Column, content_type: Column, head: Column, attempt: Column, attempts: int = 3) -> Column:
    """What one export response means; head is the first four bytes as hex."""
    is_tiff = F.coalesce(content_type, F.lit("")).contains("tif") | head.isin("49492A00", "4D4D002A")
    return (F.when(status.isNull() | (status >= 500), F.when(attempt < attempts, F.lit("retry")).otherwise(F.lit("split")))
            .when(status >= 400, F.lit("error")).when(is_tiff, F.lit("ok")).otherwise(F.lit("error")))
