"""Published chart archives: link discovery, member selection, the incremental index and clip state."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .registry import PRODUCTS

# Fixed value: archive links with their edition date.
LINK = r"(?i)https://aeronav\.faa\.gov/(?:visual|enroute)/(\d\d-\d\d-\d{4})/[^\s>\"']+?\.zip"
CLIP_VERSION = 1


def links(pages: DataFrame, key: str, html: str, pattern: str, group: int = 0) -> DataFrame:
    """key, pos, url of every first occurrence of a link on a page, in page order."""
    hits = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), group)).alias("pos", "url"))
    return hits.groupBy(key, "url").agg(F.min("pos").alias("pos"))


def chart_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Archive links with edition and product; one archive may serve several products."""
    found = (links(pages, key, html, LINK)
             .withColumn("edition", F.regexp_extract("url", LINK, 1))
             .withColumn("rest", F.expr("substring(url, instr(url, concat('/', edition, '/')) + length(edition) + 2)")))
    match = F.array_compact(F.array(*[F.when(F.col("rest").rlike(z), F.lit(pid)) for pid, _, z, _, _, _ in PRODUCTS]))
    return found.select(key, "url", "edition", "rest", "pos", F.explode(match).alias("product"))


def member_products(members: DataFrame, name: str = "name") -> DataFrame:
    """Archive members with every product whose member pattern their base name matches."""
    base = text.file_name(F.col(name))
    match = F.array_compact(F.array(*[F.when(base.rlike("(?i)" + m), F.lit(pid)) for pid, _, _, m, _, _ in PRODUCTS]))
    return members.withColumn("product", F.explode(match))


def pair_metadata(members: DataFrame) -> DataFrame:
    """archive, chart member, first .htm member whose stem begins with the chart's stem (or null).

    Every .htm stem offers all its prefixes, so the pairing is an equality join on (archive, prefix)
    and an archive with very many members does not compare them pairwise.
    """
    m = members.withColumn("_stem", text.stem(text.file_name(F.col("name"))))
    charts = m.filter("lower(name) LIKE '%.tif'").select("archive", "name", "ord", "_stem")
    stems = charts.select("archive", "_stem").distinct()
    htm = (m.filter("lower(name) LIKE '%.htm'")
           .selectExpr("archive", "name AS htm", "ord AS _hord", "explode(transform(sequence(1, length(_stem)), i -> substring(_stem, 1, i))) AS _stem")
           .join(stems, ["archive", "_stem"], "left_semi")
           .groupBy("archive", "_stem").agg(F.min_by("htm", "_hord").alias("htm")))
    return charts.join(htm, ["archive", "_stem"], "left").select("archive", "name", "ord", "htm")


def coverage(charts: DataFrame, label: str = "label", edition: str = "edition") -> DataFrame:
    """Charts with the label shown on a coverage map: the name and, in brackets, the edition."""
    return charts.withColumn(label, F.format_string("%s (%s)", label, edition))


def cache_status(charts: DataFrame, sizes: DataFrame, archives: DataFrame, extracted: DataFrame, archive: str, chart: str) -> DataFrame:
    """Charts with what is on disk: ``sizes`` (archive, zip_bytes), ``archives`` (archive) that are local, ``extracted`` (chart) done."""
    there, done = (d.select(k).distinct().withColumn(c, F.lit(True)) for d, k, c in ((archives, archive, "zip_local"), (extracted, chart, "extracted")))
    j = charts.join(sizes.select(archive, "zip_bytes"), archive, "left").join(there, archive, "left").join(done, chart, "left")
    return j.withColumn("extracted", F.coalesce("extracted", F.lit(False))).withColumn("zip_local", F.coalesce("zip_local", F.lit(False)))


def refresh_index(index: DataFrame, live: DataFrame, probed: DataFrame) -> DataFrame:
    """New index: entries of live URLs already indexed, plus probed entries of URLs that were not.

    ``probed`` holds the entries read from new archives; an archive that could not be read has none
    and is simply absent. Entries of superseded editions drop out with their URL.
    """
    urls = live.select("url").distinct()
    kept = index.join(urls, "url", "left_semi")
    new = probed.join(urls, "url", "left_semi").join(index.select("url").distinct(), "url", "left_anti")
    return kept.unionByName(new)


def missing_links(live: DataFrame, index: DataFrame) -> DataFrame:
    return live.join(index.select("url").distinct(), "url", "left_anti")


def with_clip(charts: DataFrame, stored: DataFrame, detected: DataFrame) -> DataFrame:
    """Charts with their clip: the stored one when current, else the freshly detected one."""
    fresh = stored.filter(f"v = {CLIP_VERSION}").select("item_id", F.col("clip").alias("_old"))
    return (charts.join(fresh, "item_id", "left").join(detected.select("item_id", F.col("clip").alias("_new")), "item_id", "left")
            .withColumn("clip", F.coalesce("_old", "_new")).withColumn("recomputed", F.col("_old").isNull()).drop("_old", "_new"))
