"""Catalogue discovery, sources, names and text."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.spatial_join import box_pairs, each_pair
from ..session import cut_lineage
from ..sources import charts, library, registry, stac
from .inputs import ctes, derived, flat, table
from .q_joins import HIT
from .registry import query


def _lit(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)


SRC_COLS = [c.split()[0] for c in registry.SOURCE_COLUMNS.split(", ")]
SRC_CTE = "src(" + ", ".join(SRC_COLS) + ") AS (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in registry.source_rows()) + ")"


def library_plugin(areas, cat):
    items = cat.withColumnRenamed("bbox", "item_bbox").select("item_id", "path", "label", "kind", "item_bbox", "native_res_m", "service")
    return each_pair(box_pairs(areas.select("aoi_id", "bbox"), items))


@query("s01_x01_catalog_contract", ctes("aoi", "catalog", "chips") + f"""
SELECT aoi_id, 'library' AS source_id, item_id, label, kind, native_res_m, service FROM aoi a JOIN catalog c ON {HIT}
UNION ALL SELECT aoi_id, 'chips', item_id, concat('chip ', CAST(item_id AS STRING)), 'elevation', 5000.0, false FROM aoi a JOIN chips c ON {HIT}""")
def s01(spark, sf):
    cat = derived(spark, sf, "catalog")
    chips = derived(spark, sf, "chips").selectExpr("item_id", "concat('chip/', item_id) AS path", "concat('chip ', item_id) AS label",
                                                   "'elevation' AS kind", "bbox", "5000D AS native_res_m", "false AS service")
    plugins = {"library": lambda areas: library_plugin(areas, cat), "chips": lambda areas: library_plugin(areas, chips)}
    out = registry.catalog_for(derived(spark, sf, "aoi"), plugins)
    return out.select("aoi_id", "source_id", "item_id", "label", "kind", "native_res_m", "service")


@query("s02_registry_last_wins", """
SELECT concat('ep-', CAST(p_size AS STRING)) AS source_id, arg_max(p_name, p_partkey) AS name, arg_max(p_type, p_partkey) AS kind FROM part GROUP BY 1""")
def s02(spark, sf):
    rows = table(spark, sf, "part").selectExpr("concat('ep-', p_size) AS source_id", "p_name AS name", "p_type AS kind", "p_partkey AS ord")
    return registry.last_wins(rows, "source_id", "ord").select("source_id", "name", "kind")


@query("s03_j10_source_lookup", ctes("requests", "aoi") + f""", {SRC_CTE}
SELECT job_id, coalesce(s.source_id, 'unknown source') AS source_id, s.category, s.kind, s.license, CASE WHEN s.source_id IS NOT NULL THEN coalesce(nullif(r.res_m,-1), default_res_m) END AS res_m,
 CASE WHEN s.source_id IS NOT NULL AND a.aoi_id IS NOT NULL THEN s.west IS NULL OR NOT (s.east<=a.west OR s.west>=a.east OR s.north<=a.south OR s.south>=a.north) END AS covers
FROM requests r LEFT JOIN src s USING(source_no) LEFT JOIN aoi a USING(aoi_id)""")
def s03(spark, sf):
    src = registry.sources(spark).withColumn("extent", F.when(F.col("west").isNotNull(), geo.make_bbox("west", "south", "east", "north")))
    j = (derived(spark, sf, "requests").withColumnRenamed("res_m", "wanted").join(F.broadcast(src), "source_no", "left")
         .join(derived(spark, sf, "aoi").select("aoi_id", "bbox"), "aoi_id", "left"))
    known = F.col("source_id").isNotNull()
    covers = F.col("extent").isNull() | geo.intersects(F.col("bbox"), F.col("extent"))
    return j.select("job_id", F.coalesce("source_id", F.lit("unknown source")).alias("source_id"), "category", "kind", "license",
                    F.when(known, F.coalesce(F.expr("nullif(wanted, -1D)"), F.col("default_res_m"))).alias("res_m"),
                    F.when(known & F.col("bbox").isNotNull(), covers).alias("covers"))


_FACTS = """facts AS (SELECT *, round(abs(pixel)*CASE WHEN geographic THEN 111320 ELSE 1 END,3) AS res_m,
 CASE WHEN count=1 AND NOT palette AND dtype IN ('int16','float32','float64','int32') THEN 'elevation' ELSE 'rgb' END AS k FROM files WHERE has_crs)"""
_SCAN = ctes("files") + "," + _FACTS + """,
vis AS (SELECT * FROM files WHERE len(list_filter(string_split(folder,'/'), lambda p: starts_with(p,'.')))=0),
ent AS (SELECT f.path AS index_path, CASE WHEN name='A.TOC' THEN concat('NITF_TOC_ENTRY:CADRG_ONC_', CAST(doc_id%3 AS STRING), ':1M_1_1:', f.path)
 ELSE concat('ECRG_TOC_ENTRY:ECRG', CAST(doc_id%2 AS STRING), '::1-500K:', f.path) END AS sub, f.* FROM files f WHERE name='A.TOC' OR (name='TOC.xml' AND doc_id%200<>113)),
tops AS (SELECT DISTINCT folder FROM vis WHERE name='A.TOC' OR (name='TOC.xml' AND doc_id%200<>113)),
fld AS (SELECT DISTINCT folder FROM vis), hid AS (SELECT DISTINCT fld.folder FROM fld JOIN tops ON fld.folder=tops.folder OR starts_with(fld.folder, concat(tops.folder,'/'))),
live AS (SELECT folder FROM tops t WHERE NOT EXISTS (SELECT 1 FROM tops u WHERE u.folder<>t.folder AND starts_with(t.folder, concat(u.folder,'/')))),
subs AS (SELECT root, sub AS path, CASE WHEN name='A.TOC' THEN concat('CADRG ONC ', CAST(doc_id%3 AS STRING), ':1M') ELSE concat('ECRG ECRG', CAST(doc_id%2 AS STRING), ' 1-500K') END AS product,
 CASE WHEN count=1 AND NOT palette AND dtype IN ('int16','float32','float64','int32') THEN 'elevation' ELSE 'rgb' END AS kind, round(abs(pixel)*CASE WHEN geographic THEN 111320 ELSE 1 END,3) AS res_m, west, south, east, north
 FROM ent WHERE has_crs AND folder IN (SELECT folder FROM live)),
loose AS (SELECT root, path, regexp_extract(lower(name),'\\.dt([012])$',1) AS cell, k, res_m, west, south, east, north, string_split(folder,'/') AS parts FROM facts
 WHERE path IN (SELECT path FROM vis) AND folder NOT IN (SELECT folder FROM hid) AND (regexp_matches(lower(name),'\\.(tif|tiff|ntf|nitf|nsf|jp2|img|vrt|sid|ecw)$') OR regexp_matches(lower(name),'\\.dt[012]$'))),
items AS (SELECT root, path, product, kind, res_m, west, south, east, north FROM subs UNION ALL SELECT root, path, CASE WHEN cell<>'' THEN concat('DTED Level ',cell) ELSE
 concat(CASE WHEN len(parts)>1 THEN parts[2] ELSE 'Loose files' END, CASE WHEN k='elevation' THEN ' (elevation)' ELSE ' (imagery)' END) END, CASE WHEN cell<>'' THEN 'elevation' ELSE k END, res_m, west, south, east, north FROM loose),
keyed AS (SELECT *, concat('local-', trim(regexp_replace(lower(product),'[^a-z0-9]+','-','g'),'-')) AS product_id FROM items)"""


def library_items(spark, sf, files=None):
    files = derived(spark, sf, "files") if files is None else files
    toc = files.filter("name = 'A.TOC' OR (name = 'TOC.xml' AND doc_id % 200 <> 113)").selectExpr(
        "path AS index_path", "if(name = 'A.TOC', concat('NITF_TOC_ENTRY:CADRG_ONC_', doc_id % 3, ':1M_1_1:', path), "
        "concat('ECRG_TOC_ENTRY:ECRG', doc_id % 2, '::1-500K:', path)) AS sub", "dtype", "count", "palette", "has_crs", "geographic", "pixel", "bbox")
    return library.scan(files, toc)


@query("s05_library_scan", _SCAN + "SELECT path, product, product_id, kind FROM keyed")
def s05(spark, sf):
    return library_items(spark, sf).select("path", "product", "product_id", "kind")


@query("s06_raster_facts", ctes("files") + "," + _FACTS + " SELECT doc_id, res_m, k AS kind, round(west,8) AS west, round(north,8) AS north FROM facts")
def s06(spark, sf):
    return library.raster_facts(derived(spark, sf, "files")).select("doc_id", "res_m", "kind", F.col("bbox.west").alias("west"), F.col("bbox.north").alias("north"))


@query("s07_a18_library_products", _SCAN + """,
r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY res_m) AS rn, count(*) OVER (PARTITION BY product_id) AS n FROM keyed),
m AS (SELECT product_id, any_value(res_m) AS med FROM r WHERE rn=n//2+1 GROUP BY 1)
SELECT product_id, arg_min(product, path) AS name, arg_min(kind, path) AS kind, count(*) AS n_files, CAST(round_even(any_value(med),2) AS DOUBLE) AS default_res_m,
 CAST(round_even(min(res_m)/2,2) AS DOUBLE) AS min_res_m, CASE WHEN arg_min(product,path) LIKE '%CADRG%' OR arg_min(product,path) LIKE '%ECRG%' THEN 'nearest' ELSE 'bilinear' END AS resampling
FROM keyed JOIN m USING(product_id) GROUP BY 1""")
def s07(spark, sf):
    return library.products(library_items(spark, sf)).select("product_id", "name", "kind", "n_files", "default_res_m", "min_res_m", "resampling")


@query("s08_library_items_in_area", _SCAN.replace("WITH ", ctes("aoi") + ", ", 1) + f"""
SELECT aoi_id, regexp_extract(path,'([^/]*)$',1) AS label, product_id FROM aoi a
 JOIN (SELECT path, product_id, round(west,8) AS west, round(south,8) AS south, round(east,8) AS east, round(north,8) AS north FROM keyed) c ON {HIT}""")
def s08(spark, sf):
    # The library index is a stored table, as a scan is not repeated for every lookup.
    items = cut_lineage(library_items(spark, sf).select("path", "product_id", F.col("bbox").alias("item_bbox")), "library-index")
    named = items.select(text.file_name(F.col("path")).alias("label"), "product_id", "item_bbox")
    j = box_pairs(derived(spark, sf, "aoi").select("aoi_id", "bbox"), named).select("_left", "_right")
    return each_pair(j).select("aoi_id", "label", "product_id")


@query("s09_page_links", """
WITH l AS (SELECT page_id, url, pos FROM (SELECT page_id, unnest(regexp_extract_all(html,'href="([^"]+)"',1)) AS url, generate_subscripts(regexp_extract_all(html,'href="([^"]+)"',1),1)-1 AS pos FROM pages))
SELECT page_id, url, CAST(min(pos) AS INT) AS pos FROM l GROUP BY 1,2""")
def s09(spark, sf):
    return charts.links(table(spark, sf, "pages"), "page_id", "html", 'href="([^"]+)"', 1)


@query("s09_chart_page_products", """
WITH u AS (SELECT page_id, CASE page_id%4 WHEN 0 THEN 'visual/09-03-2026/sectional-files/P' WHEN 1 THEN 'visual/09-03-2026/tac-files/P' WHEN 2 THEN 'enroute/10-01-2026/enr_l' ELSE 'enroute/10-01-2026/other' END || CAST(page_id AS STRING) || '.zip' AS r FROM pages)
SELECT page_id, 'https://aeronav.faa.gov/' || r AS url, CASE WHEN page_id%4<2 THEN '09-03-2026' ELSE '10-01-2026' END AS edition, p AS product FROM u,
 LATERAL (SELECT unnest(CASE page_id%4 WHEN 0 THEN ['faa-sectional'] WHEN 1 THEN ['faa-tac','faa-flyway'] WHEN 2 THEN ['faa-ifr-low'] ELSE [] END) AS p)""")
def s09b(spark, sf):
    rel = ("concat(CASE page_id % 4 WHEN 0 THEN 'visual/09-03-2026/sectional-files/P' WHEN 1 THEN 'visual/09-03-2026/tac-files/P' "
           "WHEN 2 THEN 'enroute/10-01-2026/enr_l' ELSE 'enroute/10-01-2026/other' END, page_id, '.zip')")
    link = f"concat('<a href=\"https://aeronav.faa.gov/', {rel}, '\">')"
    pages = table(spark, sf, "pages").selectExpr("page_id", f"concat({link}, html, {link}) AS html")
    return charts.chart_links(pages).select("page_id", "url", "edition", "product")


_MEMBER = """concat(CASE p_partkey%6 WHEN 4 THEN 'ENR_L' WHEN 5 THEN 'ENR_CH' ELSE p_name END, CAST(p_partkey%50 AS STRING),
 CASE p_partkey%6 WHEN 0 THEN ' SEC.tif' WHEN 1 THEN ' TAC.TIF' WHEN 2 THEN ' FLY.tif' WHEN 3 THEN '.htm' ELSE '.tif' END)"""


@query("s10_product_members", f"""
SELECT p_partkey, p FROM (SELECT p_partkey, {_MEMBER} AS name FROM part), LATERAL (SELECT unnest(list_filter([
 CASE WHEN regexp_matches(name,'(?i) SEC\\.tif$') THEN 'faa-sectional' END, CASE WHEN regexp_matches(name,'(?i) TAC\\.tif$') THEN 'faa-tac' END, CASE WHEN regexp_matches(name,'(?i) FLY\\.tif$') THEN 'faa-flyway' END,
 CASE WHEN regexp_matches(name,'(?i)^ENR_C?L\\w*\\.tif$') THEN 'faa-ifr-low' END, CASE WHEN regexp_matches(name,'(?i)^ENR_C?H\\w*\\.tif$') THEN 'faa-ifr-high' END,
 CASE WHEN regexp_matches(name,'(?i)\\.tif$') THEN 'any' END], lambda x: x IS NOT NULL)) AS p)""")
def s10(spark, sf):
    m = table(spark, sf, "part").selectExpr("p_partkey", f"concat('dir/', {_MEMBER}) AS name")
    # Seven products take every .tif member; they are shown as one.
    return charts.member_products(m).select("p_partkey", F.when(F.col("product").isin(
        "faa-sectional", "faa-tac", "faa-flyway", "faa-ifr-low", "faa-ifr-high"), F.col("product")).otherwise(F.lit("any")).alias("p")).distinct()


_META = """concat('West_Bounding_Coordinate: <b>', CAST(-s_suppkey%170 AS STRING), '.25</b> East_Bounding_Coordinate:', CASE WHEN s_suppkey%10=3 THEN 'n/a' ELSE concat(' <i> <b>', CAST(s_suppkey%9-s_suppkey%170 AS STRING), '.5') END,
 ' North_Bounding_Coordinate: ', CAST(s_suppkey%80 AS STRING), ' South_Bounding_Coordinate: ', CAST(s_suppkey%80-CAST(s_suppkey%7 AS INT) AS STRING))"""


@query("s11_text_bounds", f"""
WITH m AS (SELECT s_suppkey, {_META} AS t FROM supplier),
x AS (SELECT s_suppkey, TRY_CAST(regexp_extract(t,'West_Bounding_Coordinate:\\s*(?:<[^>]*>\\s*)*(-?\\d+(?:\\.\\d+)?)',1) AS DOUBLE) AS w, TRY_CAST(regexp_extract(t,'East_Bounding_Coordinate:\\s*(?:<[^>]*>\\s*)*(-?\\d+(?:\\.\\d+)?)',1) AS DOUBLE) AS e,
 TRY_CAST(regexp_extract(t,'North_Bounding_Coordinate:\\s*(?:<[^>]*>\\s*)*(-?\\d+(?:\\.\\d+)?)',1) AS DOUBLE) AS n, TRY_CAST(regexp_extract(t,'South_Bounding_Coordinate:\\s*(?:<[^>]*>\\s*)*(-?\\d+(?:\\.\\d+)?)',1) AS DOUBLE) AS s FROM m)
SELECT s_suppkey, CASE WHEN w<e AND s<n THEN w END AS west, CASE WHEN w<e AND s<n THEN s END AS south, CASE WHEN w<e AND s<n THEN e END AS east, CASE WHEN w<e AND s<n THEN n END AS north FROM x""")
def s11(spark, sf):
    df = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_META} AS t").select("s_suppkey", text.text_bounds(F.col("t")).alias("b"))
    return df.select("s_suppkey", "b.west", "b.south", "b.east", "b.north")


_ARCH = """SELECT p_size%20 AS archive, p_partkey AS ord, CASE WHEN p_partkey%3=2 THEN concat('m/', p_brand, ' ', p_type, ' v', CAST(p_partkey AS STRING), '.HTM') ELSE concat('c/', p_brand, ' ', p_type, '.tif') END AS name FROM part"""


@query("s12_metadata_pairing", f"""
WITH m AS ({_ARCH}), c AS (SELECT *, regexp_replace(regexp_extract(name,'([^/]*)$',1),'\\.[^.]*$','') AS stem FROM m)
SELECT a.archive, a.ord, a.name, (SELECT arg_min(h.name, h.ord) FROM c h WHERE h.archive=a.archive AND lower(h.name) LIKE '%.htm' AND starts_with(h.stem, a.stem)) AS htm FROM c a WHERE lower(a.name) LIKE '%.tif'""")
def s12(spark, sf):
    m = table(spark, sf, "part").selectExpr(
        "p_size % 20 AS archive", "p_partkey AS ord",
        "if(p_partkey % 3 = 2, concat('m/', p_brand, ' ', p_type, ' v', p_partkey, '.HTM'), concat('c/', p_brand, ' ', p_type, '.tif')) AS name")
    return charts.pair_metadata(m)


_LINKS = """l AS (SELECT DISTINCT unnest(regexp_extract_all(html,'href="([^"]+)"',1)) AS url FROM pages),
idx AS (SELECT url, 'old' AS edition FROM l WHERE length(url)%3<>0 UNION ALL SELECT DISTINCT concat('/gone', url), 'gone' FROM pages)"""


@query("s13_incremental_index", f"WITH {_LINKS} SELECT url, edition FROM idx WHERE url IN (SELECT url FROM l) UNION ALL SELECT url, 'new' FROM l WHERE url NOT IN (SELECT url FROM idx) AND length(url)%5<>0")
def s13(spark, sf):
    pages = table(spark, sf, "pages")
    live = charts.links(pages, "page_id", "html", 'href="([^"]+)"', 1).select("url").distinct()
    index = live.filter("length(url) % 3 <> 0").withColumn("edition", F.lit("old")).unionByName(
        pages.selectExpr("concat('/gone', url) AS url", "'gone' AS edition").distinct())
    # Archives whose address length is a multiple of five stand for unreadable ones.
    probed = charts.missing_links(live, index).filter("length(url) % 5 <> 0").withColumn("edition", F.lit("new"))
    return charts.refresh_index(index, live, probed)


@query("s14_chart_coverage", ctes("catalog") + " SELECT item_id, concat(label, ' (', lpad(CAST(1+item_id%12 AS STRING),2,'0'), '-03-2026)') AS label, round(west,6) AS west, round(south,6) AS south, round(east,6) AS east, round(north,6) AS north FROM catalog")
def s14(spark, sf):
    df = derived(spark, sf, "catalog").withColumn("edition", F.expr("concat(lpad(1 + item_id % 12, 2, '0'), '-03-2026')"))
    return charts.coverage(df).select("item_id", "label", *flat())


_STAC_ROWS = "s_suppkey, n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey=n_nationkey"


def stac_documents(spark, sf):
    """Catalogue documents: regions as events, up to a thousand suppliers of a nation as one acquisition."""
    base = "https://example.org/events/"
    n, s, r = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "region")
    ev = "concat('ev', {k}, '/collection.json')"
    root = r.agg(F.expr(f"to_json(struct(collect_list(struct('child' AS rel, concat('./', {ev.format(k='r_regionkey')}) AS href)) AS links)) AS body")) \
        .selectExpr(f"'{base}catalog.json' AS url", "body")
    j = s.join(n, F.expr("s_nationkey = n_nationkey")).withColumn("acq", F.expr("concat(n_nationkey, '-', s_suppkey div 1000)"))
    evd = j.select("n_regionkey", "acq").distinct().groupBy("n_regionkey").agg(F.expr("to_json(struct(collect_list(struct('child' AS rel, concat('./acq', acq, '/c.json') AS href)) AS links, "
                                              "struct(struct(if(n_regionkey = 4, array(array(-100D, 30D)), array(array(-100D + 5 * n_regionkey, 30D, -94D + 5 * n_regionkey, 43D))) AS bbox) AS spatial) AS extent)) AS body")) \
        .selectExpr(f"concat('{base}', {ev.format(k='n_regionkey')}) AS url", "body")
    acq = j.groupBy("n_regionkey", "acq").agg(F.expr("to_json(struct(collect_list(struct(if(s_suppkey % 8 = 0, 'self', 'item') AS rel, concat('../acq', acq, '/i', s_suppkey, '.json') AS href)) AS links)) AS body")) \
        .selectExpr(f"concat('{base}ev', n_regionkey, '/acq', acq, '/c.json') AS url", "body")
    cat = derived(spark, sf, "catalog").select(F.col("item_id").alias("s_suppkey"), "bbox")
    item = j.join(cat, "s_suppkey").selectExpr(
        f"concat('{base}ev', n_regionkey, '/acq', acq, '/i', s_suppkey, '.json') AS url",
        "to_json(struct(if(s_suppkey % 10 = 0, NULL, array(bbox.west, bbox.south, bbox.east, bbox.north)) AS bbox, "
        "struct(if(s_suppkey % 9 = 0, NULL, struct(concat('./v', s_suppkey, '.tif') AS href)) AS visual) AS assets)) AS body")
    docs = stac.parse(evd.unionByName(acq).unionByName(item))
    return stac.parse(root), docs


def event_tiles_in(spark, sf, areas):
    """Imagery tiles touching each area, from the crawled catalogue stored as two tables."""
    root, docs = stac_documents(spark, sf)
    evs = stac.events(root, docs)
    tiles = cut_lineage(stac.event_tiles(evs, docs), "event-tiles")
    return stac.tiles_for(areas, cut_lineage(evs.select("name", "bbox"), "events"), tiles)


@query("s16_catalog_events", """SELECT concat('ev', CAST(n_regionkey AS STRING)) AS name, -100.0::DOUBLE+5*n_regionkey AS west, -94.0::DOUBLE+5*n_regionkey AS east FROM nation WHERE n_regionkey<>4 AND n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY n_regionkey""")
def s16(spark, sf):
    root, docs = stac_documents(spark, sf)
    return stac.events(root, docs).select("name", "bbox.west", "bbox.east")


_STAC_CTE = f""", st AS (SELECT s_suppkey, concat('ev', CAST(n_regionkey AS STRING)) AS name, n_regionkey, concat('https://example.org/events/ev', CAST(n_regionkey AS STRING), '/acq', CAST(n_nationkey AS STRING), '-', CAST(s_suppkey//1000 AS STRING), '/v', CAST(s_suppkey AS STRING), '.tif') AS tile_url,
 west, south, east, north FROM (SELECT {_STAC_ROWS}) JOIN catalog ON item_id=s_suppkey WHERE s_suppkey%8<>0 AND s_suppkey%9<>0 AND s_suppkey%10<>0 AND n_regionkey<>4)"""


@query("s17_catalog_tiles_in_area", ctes("aoi", "catalog") + _STAC_CTE + f""",
ev AS (SELECT DISTINCT name, -100.0::DOUBLE+5*n_regionkey AS west, 30.0::DOUBLE AS south, -94.0::DOUBLE+5*n_regionkey AS east, 43.0::DOUBLE AS north FROM st),
near AS (SELECT DISTINCT name FROM aoi a JOIN ev c ON {HIT})
SELECT aoi_id, tile_url FROM aoi a JOIN (SELECT * FROM st WHERE name IN (SELECT name FROM near)) c ON {HIT}""")
def s17(spark, sf):
    return event_tiles_in(spark, sf, derived(spark, sf, "aoi").select("aoi_id", "bbox")).select("aoi_id", "tile_url")


@query("t07_ttl_refresh", """SELECT user_id AS key, max(ts) AS fetched_at, arg_max(event_id, ts) AS version, epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT - floor(epoch(max(ts)))::BIGINT > 21600 AS stale FROM events GROUP BY 1""")
def t07(spark, sf):
    c = table(spark, sf, "events").selectExpr("user_id AS key", "ts AS fetched_at", "event_id AS version")
    return stac.needs_refresh(c, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("key", "fetched_at", "version", "stale")


@query("s32_original_files", ctes("files") + """,
m AS (SELECT folder, doc_id, concat('d', CAST(doc_id%50 AS STRING), '.tif') AS name FROM files), mm AS (SELECT DISTINCT folder, name, concat(folder,'/',name) AS path FROM m),
sc AS (SELECT DISTINCT folder, concat('d', CAST(doc_id%50 AS STRING), CASE doc_id%5 WHEN 0 THEN '.TFW' WHEN 1 THEN '.tif.aux.xml' WHEN 2 THEN '.bin' WHEN 3 THEN '_b.prj' ELSE '.x.htm' END) AS name FROM files)
SELECT path AS item_path, path AS file, false AS sidecar FROM mm UNION ALL SELECT mm.path, concat(sc.folder,'/',sc.name), true FROM mm JOIN sc ON sc.folder=mm.folder AND starts_with(sc.name, concat(regexp_replace(mm.name,'\\.tif$',''),'.'))
 AND regexp_matches(lower(sc.name), '\\.(tfw|aux\\.xml|htm|prj)$')""")
def s32(spark, sf):
    f = derived(spark, sf, "files")
    mains = f.selectExpr("folder", "concat('d', doc_id % 50, '.tif') AS name").distinct().selectExpr("*", "concat(folder, '/', name) AS path")
    side = f.selectExpr("folder", "concat('d', doc_id % 50, CASE doc_id % 5 WHEN 0 THEN '.TFW' WHEN 1 THEN '.tif.aux.xml' WHEN 2 THEN '.bin' WHEN 3 THEN '_b.prj' ELSE '.x.htm' END) AS name").distinct()
    side = side.selectExpr("*", "concat(folder, '/', name) AS path")
    return library.original_files(mains, mains.unionByName(side))


_PUBLISHED = _SCAN + """,
tre AS (SELECT DISTINCT product_id, regexp_replace(regexp_extract(path,':([^:]*)$',1),'/[^/]*$','') AS t FROM keyed WHERE regexp_matches(path,'^(NITF|ECRG)_TOC_ENTRY:')),
pub AS (SELECT product_id, f.path AS file, concat(string_split(t,'/')[-1], substr(f.path, length(t)+1)) AS as_name, true AS tree, f.length FROM tre JOIN files f ON f.folder=t OR starts_with(f.folder, concat(t,'/'))
 UNION ALL SELECT product_id, f.path, f.name, false, f.length FROM (SELECT DISTINCT product_id, path FROM keyed) k JOIN files f ON f.path=k.path
 UNION ALL SELECT product_id, g.path, g.name, false, g.length FROM (SELECT DISTINCT product_id, path FROM keyed) k JOIN files f ON f.path=k.path JOIN files g ON g.folder=f.folder AND g.name<>f.name AND starts_with(g.name, concat(regexp_replace(f.name,'\\.[^.]*$',''),'.'))
 AND regexp_matches(lower(g.name), '\\.(tfw|tfwx|tifw|wld|jgw|j2w|pgw|prj|aux\\.xml|ovr|htm|html|xml|txt|rrd|msk|tab)$'))"""


@query("s32_index_trees", _PUBLISHED + " SELECT DISTINCT product_id, file, as_name, tree FROM pub")
def s32_trees(spark, sf):
    """What each product hands over as published: trees below index files once, other files with their sidecars."""
    items = library_items(spark, sf).select("product_id", "path")
    return library.published_files(items, derived(spark, sf, "files"), "product_id").select("product_id", "file", "as_name", "tree")


@query("r21_original_files", _PUBLISHED + """
SELECT product_id, CASE WHEN tree THEN string_split(as_name,'/')[1] ELSE as_name END AS entry, tree, count(*) AS n_files, CAST(round_even(sum(length)/1e6,2) AS DOUBLE) AS size_mb FROM (SELECT DISTINCT * FROM pub) GROUP BY 1,2,3""")
def r21_original(spark, sf):
    """Layers of the original mode: one entry for a file or a whole tree, with its size."""
    p = library.published_files(library_items(spark, sf).select("product_id", "path"), derived(spark, sf, "files"), "product_id")
    entry = F.when(F.col("tree"), F.element_at(F.split("as_name", "/"), 1)).otherwise(F.col("as_name"))
    return p.groupBy("product_id", entry.alias("entry"), "tree").agg(F.count("*").alias("n_files"), F.expr("bround(sum(length) / 1e6D, 2)").alias("size_mb"))


@query("p20_file_facts", ctes("files") + """
SELECT root AS tree, count(*) AS n_files, CAST(round_even(sum(length)/1e6,2) AS DOUBLE) AS size_mb FROM files GROUP BY 1""")
def p20(spark, sf):
    f = derived(spark, sf, "files")
    return library.tree_sizes(f, f.selectExpr("root AS tree").distinct())


@query("p20_h23_format_labels", ctes("files") + """
SELECT doc_id, CAST(round_even(length/1e6,2) AS DOUBLE) AS size_mb, CASE WHEN ext IN ('.tif','.tiff') THEN 'GeoTIFF' WHEN ext='.ntf' THEN 'NITF' WHEN ext='.jp2' THEN 'JPEG 2000' WHEN ext LIKE '.dt_' THEN 'DTED' ELSE 'sidecar / metadata' END AS format,
 CASE WHEN ext NOT IN ('.txt','.htm','.toc','.xml') THEN count=1 AND palette END AS palette FROM (SELECT *, lower(regexp_extract(name,'(\\.[^.]*)$',1)) AS ext FROM files)""")
def p20b(spark, sf):
    drivers = "CASE WHEN ext IN ('.tif', '.tiff') THEN 'GTiff' WHEN ext = '.ntf' THEN 'NITF' WHEN ext = '.jp2' THEN 'JP2OpenJPEG' WHEN ext LIKE '.dt_' THEN 'DTED' END"
    df = derived(spark, sf, "files").selectExpr("*", "lower(regexp_extract(name, '([.][^.]*)$', 1)) AS ext").selectExpr("*", f"{drivers} AS driver")
    return df.select("doc_id", F.bround(F.col("length") / 1e6, 2).alias("size_mb"), F.coalesce(text.format_label(F.col("driver")), F.lit("sidecar / metadata")).alias("format"),
                     F.when(F.col("driver").isNotNull(), (F.col("count") == 1) & F.col("palette")).alias("palette"))


@query("p07_generic_levels", ctes("catalog") + """,
l AS (SELECT item_id, kind, coalesce(native_res_m,10.0) AS d, CAST(item_id%5 AS DOUBLE)*20 AS m, unnest(CASE WHEN kind='elevation' THEN [{'n':'overview','f':4},{'n':'native','f':1}] ELSE [{'n':'overview','f':8},{'n':'area','f':3},{'n':'native','f':1}] END) AS x FROM catalog)
SELECT item_id, x.n AS level, round(d*x.f,3) AS res_m FROM l WHERE round(d*x.f,3) >= m*0.999""")
def p07(spark, sf):
    df = derived(spark, sf, "catalog").withColumn("m", (F.col("item_id") % 5).cast("double") * 20)
    return df.select("item_id", F.explode(registry.generic_levels(F.col("kind"), F.col("native_res_m"), F.col("m"))).alias("l")).select("item_id", "l.level", "l.res_m")


@query("p08_source_levels", ctes("requests") + f""", {SRC_CTE}, lv(source_id, level_ord, level, level_res) AS (VALUES {", ".join(
    "(" + ", ".join(map(_lit, r)) + ")" for r in [(pid, i, nm, round(res * f, 3)) for pid, _, _, _, res, _ in registry.PRODUCTS for i, (nm, f) in enumerate([("overview", 2), ("native", 1)])]
    + [(sid, i, nm, res) for sid, ls in registry.LEVELS.items() for i, (nm, res) in enumerate(ls)])})
SELECT job_id, source_id, level, level_res AS res_m, level_res >= r.res_m AS at_least_wanted FROM requests r JOIN src USING(source_no) JOIN lv USING(source_id)""")
def p08(spark, sf):
    src = registry.sources(spark).select("source_no", "source_id")
    lv = registry.levels(spark).withColumnRenamed("res_m", "level_res")
    j = derived(spark, sf, "requests").join(F.broadcast(src), "source_no").join(F.broadcast(lv), "source_id")
    return j.select("job_id", "source_id", "level", F.col("level_res").alias("res_m"), (F.col("level_res") >= F.col("res_m")).alias("at_least_wanted"))


@query("p09_level_labels", ctes("catalog") + """,
b AS (SELECT item_id, kind, CAST(1+item_id%70 AS DOUBLE)/2 AS d, CAST(item_id%30 AS DOUBLE)/10+0.3 AS m FROM catalog),
c AS (SELECT *, list_filter(CASE WHEN kind='elevation' THEN [90.0::DOUBLE,30.0,10.0,1.0] WHEN m<0.9 THEN [30.0::DOUBLE,10.0,4.0,2.0,1.0,m] ELSE [30.0::DOUBLE,10.0,4.0,2.0,1.0] END, lambda r: r>=m*0.999) AS s FROM b),
e AS (SELECT item_id, kind, unnest(CASE WHEN len(list_filter(s, lambda r: abs(r-d)<1e-6))=0 THEN list_append(s,d) ELSE s END) AS r FROM c)
SELECT item_id, label, max(r) AS res_m FROM (SELECT item_id, r, CASE WHEN kind='elevation' THEN CASE WHEN r>=60 THEN 'standard' WHEN r>=20 THEN 'detailed' WHEN r>=5 THEN 'high' ELSE 'max' END
 ELSE CASE WHEN r>=20 THEN 'overview' WHEN r>=8 THEN 'regional' WHEN r>=3 THEN 'area' WHEN r>=1.5 THEN 'detailed' WHEN r>=0.9 THEN 'verydetailed' ELSE 'max' END END AS label FROM e) GROUP BY 1,2""")
def p09(spark, sf):
    df = derived(spark, sf, "catalog").selectExpr("item_id", "kind", "double(1 + item_id % 70) / 2 AS d", "double(item_id % 30) / 10 + 0.3 AS m")
    return df.select("item_id", F.explode(registry.derived_levels(F.col("kind"), F.col("d"), F.col("m"))).alias("l")).select("item_id", "l.label", "l.res_m")


@query("p10_category", ctes("catalog") + """,
c AS (SELECT item_id, CASE WHEN item_id%9=0 THEN 'imagery' END AS x, CASE WHEN item_id%6=1 THEN 'local' ELSE 'public' END AS acc, CASE item_id%5 WHEN 0 THEN 'ep-1' WHEN 1 THEN 'faa-ifr-low' WHEN 2 THEN 'faa-tac' ELSE source_id END AS sid,
 CASE WHEN item_id%7=0 THEN 'Controlled data' ELSE 'x' END AS grp, kind FROM catalog)
SELECT item_id, coalesce(x, CASE WHEN acc='local' THEN 'local' WHEN starts_with(sid,'ep-') OR grp LIKE 'Controlled%' THEN 'custom' WHEN starts_with(sid,'faa-ifr') THEN 'ifr' WHEN starts_with(sid,'faa-') THEN 'vfr' WHEN kind='elevation' THEN 'elevation' ELSE 'imagery' END) AS category FROM c""")
def p10(spark, sf):
    df = derived(spark, sf, "catalog").selectExpr("item_id", "if(item_id % 9 = 0, 'imagery', NULL) AS x", "if(item_id % 6 = 1, 'local', 'public') AS acc",
                                                  "CASE item_id % 5 WHEN 0 THEN 'ep-1' WHEN 1 THEN 'faa-ifr-low' WHEN 2 THEN 'faa-tac' ELSE source_id END AS sid",
                                                  "if(item_id % 7 = 0, 'Controlled data', 'x') AS grp", "kind")
    return df.select("item_id", registry.category(F.col("x"), F.col("acc"), F.col("sid"), F.col("grp"), F.col("kind")).alias("category"))


@query("h18_h19_h20_names", """
SELECT doc_id, trim(regexp_replace(lower(t),'[^a-z0-9]+','-','g'),'-') AS slug,
 CASE WHEN s1='' THEN 'area' ELSE s1 END AS safe FROM (SELECT doc_id, t, substring(trim(regexp_replace(t,'[^A-Za-z0-9._-]+','_','g'),'_'),1,60) AS s1 FROM (SELECT doc_id, concat(lang,' / ',source,' #',CAST(doc_id AS STRING),'! ',text) AS t FROM documents))""")
def h18(spark, sf):
    df = table(spark, sf, "documents").selectExpr("doc_id", "concat(lang, ' / ', source, ' #', doc_id, '! ', text) AS t")
    return df.select("doc_id", text.slug(F.col("t")).alias("slug"), text.safe_name(F.col("t")).alias("safe"))


@query("h20_item_stems", """
SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN concat('Map (',CAST(p_size AS STRING),')') WHEN 1 THEN concat('CADRG_ONC-',CAST(p_size AS STRING)) WHEN 2 THEN concat('t',CAST(p_partkey AS STRING),'_v') WHEN 3 THEN concat('f',CAST(p_partkey AS STRING),'.b')
 WHEN 4 THEN p_name ELSE replace(p_name,'/','_') END AS stem FROM part""")
def h20(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN '/c/x.tif' WHEN 1 THEN concat('NITF_TOC_ENTRY:CADRG_ONC:', p_size, ':/x/A.TOC') WHEN 2 THEN concat('/vsicurl/https://h/d/t', p_partkey, '_v.tif?sig=a/b.c') "
        "WHEN 3 THEN concat('/d/f', p_partkey, '.b.tif') WHEN 4 THEN '/cache/0123456789abcdef0123.tif' ELSE '/x/wms.XML' END AS path",
        "if(p_partkey % 6 = 0, concat('Map (', p_size, ')'), p_name) AS label", "p_partkey % 6 = 0 AS service")
    return df.select("p_partkey", text.item_stem(F.col("path"), F.col("label"), F.col("service")).alias("stem"))


@query("h21_index_products", """SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN concat('CADRG ',replace(p_brand,'#',' '),' 1:',CAST(p_size AS STRING),'M') ELSE concat('ECRG ',p_brand,' ',p_type) END AS product FROM part""")
def h21(spark, sf):
    sub = ("if(p_partkey % 2 = 0, concat('NITF_TOC_ENTRY:CADRG_', replace(p_brand, '#', '_'), '_1:', p_size, 'M_', p_partkey % 5, '_2:/x/A.TOC'), "
           "concat('ECRG_TOC_ENTRY:', p_brand, '::', p_type, ':/lib/TOC.xml'))")
    df = table(spark, sf, "part").selectExpr("p_partkey", f"{sub} AS sub")
    return df.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, text.rpf_product(F.col("sub"))).otherwise(text.ecrg_product(F.col("sub"))).alias("product"))


@query("h24_h25_h27_url_keys", """
SELECT page_id, concat('bytes:', regexp_extract(url,'^https?://([^/]*)',1)) AS host_key, concat(url,'/',CAST(page_id%5 AS STRING),'/',CAST(page_id AS STRING),'/7.jpg') AS tile_url,
 concat(substring(sha1(url),1,12),'_',regexp_extract(url,'([^/]*)$',1)) AS cache_name, substring(sha1(url),1,10) AS folder FROM pages""")
def h24(spark, sf):
    df = table(spark, sf, "pages").withColumn("t", F.concat("url", F.lit("/{z}/{x}/{y}.jpg")))
    return df.select("page_id", text.host_key(F.lit("bytes"), F.col("url")).alias("host_key"),
                     text.tile_url(F.col("t"), F.col("page_id") % 5, F.col("page_id"), F.lit(7)).alias("tile_url"),
                     text.cache_name(F.col("url")).alias("cache_name"), text.tile_cache_folder(F.col("url")).alias("folder"))


@query("h28_relative_urls", """
SELECT page_id, CASE page_id%5 WHEN 0 THEN 'https://other.org/a.json' WHEN 1 THEN concat(o,'/root/',CAST(page_id AS STRING)) WHEN 2 THEN concat(o,'/a/b/c',CAST(page_id AS STRING),'.json') WHEN 3 THEN concat(o,'/a/x.json') ELSE concat(o,'/a/b/d/e.json') END AS resolved
FROM (SELECT page_id, regexp_extract(url,'^(https?://[^/]*)',1) AS o FROM pages)""")
def h28(spark, sf):
    df = table(spark, sf, "pages").selectExpr(
        "page_id", "concat(regexp_extract(url, '^(https?://[^/]*)', 1), '/a/b/cat.json') AS base",
        "CASE page_id % 5 WHEN 0 THEN 'https://other.org/a.json' WHEN 1 THEN concat('/root/', page_id) WHEN 2 THEN concat('./c', page_id, '.json') WHEN 3 THEN '../x.json' ELSE 'd/e.json' END AS href")
    return df.select("page_id", text.resolve_url(F.col("base"), F.col("href")).alias("resolved"))
