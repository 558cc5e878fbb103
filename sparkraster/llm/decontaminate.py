"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming search, exact weighted check.

For every place where a text shares a run of ``SHINGLE`` words with an item, the window of the item's size that would align
the two is fingerprinted, and so is the window that begins there (or the text's last one), if it holds as many shared runs as ``SIMILARITY`` takes. Any other
window is no more similar than one of these: moved right to its first shared run, it loses none; so moved or swapped parts of an item are found as well. Fingerprints of 64 bits
are cut into ``RADIUS + 1`` blocks: two that differ in at most ``RADIUS`` bits agree in some block, so joining on
(item, block number, block value) finds every pair within the radius among windows and the items they were cut for; others share no run. Such pairs are checked exactly: the weight of a shingle is how
often it occurs, similarity is the sum of the lesser weights over the sum of the greater ones, and ``SIMILARITY`` or more is a leak.
At that similarity two fingerprints differ in 10 bits on average (standard deviation 3), hence the radius.

Defined cases: words are compared without case; an item of fewer words than ``SHINGLE`` is looked for by runs of its own length; a text
shorter than an item is one window; null and blank texts and items never match; equal items are one, named by the smallest item_id; copies
of a document each get their rows. Empty tables give empty results. ``remove`` keeps all columns of its input under any names.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.classes import small
from sparkraster.llm.common import let, table, with_shingles, words, unused
from sparkraster.session import cut_lineage, drop_written

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.8, 18, 64
WEIGHED_ROWS = 2_000_000


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def blocks(fp: Column) -> list[Column]:
    """The ``RADIUS + 1`` blocks of a fingerprint, of nearly equal width."""
    ends = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(ends, ends[1:])]


def fingerprints(bags: DataFrame, key: str) -> DataFrame:
    """(key, fp) of (key, h, c): bit i is set where the hashes with bit i outweigh those without."""
    sums = bags.groupBy(key).agg(*[F.sum(F.expr(f"if(getbit(h, {i}) = 1, c, -c)")).alias(f"b{i}") for i in range(BITS)])
    fp = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(BITS)])
    return sums.select(key, fp.alias("fp"))


def within_radius(windows: DataFrame, items: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(win, item) of windows (win, n, fp) and items (item, n, fp) of one size whose fingerprints differ in at most ``RADIUS`` bits.

    ``seeds`` (win, item) limits the search to pairs that share a run of words. Without it nearly every window meets nearly every item, since blocks
    are of three or four bits.
    """
    def cut(d: DataFrame, name: str) -> DataFrame:
        return d.select(*[c for c in ("win", "item", "n") if c in d.columns], F.col("fp").alias(f"fp_{name}"), F.posexplode(F.array(*blocks(F.col("fp")))).alias("block", "value"))
    x = F.col("fp_win").bitwiseXOR(F.col("fp_item"))
    first = F.array_position(F.transform(F.array(*blocks(x)), lambda v: v == 0), True) - 1  # a pair that agrees in several blocks counts in the first
    if seeds is None:
        j = cut(windows, "win").join(cut(items, "item"), ["n", "block", "value"])
    else:
        j = cut(windows.join(seeds, "win"), "win").join(cut(items, "item").drop("n"), ["item", "block", "value"])
    return j.filter(F.bit_count(x) <= RADIUS).filter(F.col("block") == first).select("win", "item")


def crowded_starts(shared: DataFrame) -> DataFrame:
    """(key, item, n, start) of the windows of ``n`` shingles that begin at a shared run, or end the text, and hold enough shared runs for ``SIMILARITY``.

    ``shared``: (key, item, n, m, pos), one row for each run at ``pos`` that a text of ``m`` runs shares with an item. Positions are ranked, so a window
    costs one look at the run that would have to lie in it. Windows as long as a shorter text are all alike, and the aligned ones hold them.
    """
    least = F.ceil(SIMILARITY / (1 + SIMILARITY) * 2 * F.col("n") - 1e-9).cast("int")
    at = (shared.filter("n <= m").groupBy("key", "item", "n", "m").agg(F.sort_array(F.collect_set("pos")).alias("at")).withColumn("need", least)
          .filter(F.size("at") >= F.col("need")))
    starts = let(F.col("at"), lambda a: F.filter(
        F.transform(a, lambda p, i: F.when(F.get(a, i + F.col("need") - 1) <= F.least(p, F.col("m") - F.col("n")) + F.col("n") - 1, F.least(p, F.col("m") - F.col("n")))), lambda s: s.isNotNull()))
    last = F.when(F.get("at", F.size("at") - F.col("need")) >= F.col("m") - F.col("n"), F.array(F.col("m") - F.col("n"))).otherwise(F.array().cast("array<int>"))
    return at.select("key", "item", "n", F.explode(F.array_union(starts, last)).alias("start"))


def leaks_of_size(texts: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(key, item, start, n, similarity) for items whose shingles have ``size`` words; texts: (key, text)."""
    ish = cut_lineage(items.select("item", "n", F.posexplode("s").alias("off", "h")), "item-shingles")
    probe = F.broadcast(ish) if ish.count() <= WEIGHED_ROWS else ish
    # outer, for else a filter on the array goes below the projections, where their lambdas evaluate each other anew for each run
    runs = with_shingles(texts, F.lower("text"), size, "s").select("key", F.size("s").alias("m"), F.posexplode_outer("s").alias("pos", "h"))
    start = F.greatest(F.least(F.col("pos") - F.col("off"), F.col("m") - F.col("n")), F.lit(0))
    shared = cut_lineage(runs.join(probe, "h").select("key", "item", "n", "m", "pos", start.alias("start")), "shared-runs")
    seeds = cut_lineage(shared.select("key", "n", "start", "item").union(crowded_starts(shared).select("key", "n", "start", "item")).distinct(), "window-seeds")
    drop_written(shared)
    windows = cut_lineage(seeds.select("key", "n", "start").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    seeds = seeds.join(windows, ["key", "n", "start"]).select("win", "item")
    keys = cut_lineage(windows.select("key").distinct(), "window-texts")
    hit = texts.join(small(keys), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    hit = with_shingles(hit, F.lower("text"), size, "s").drop("text")
    wsh = hit.join(windows, "key").select("win", F.explode(F.slice("s", F.col("start") + 1, F.col("n"))).alias("h")).groupBy("win", "h").agg(F.count("*").alias("c"))
    wsh = cut_lineage(wsh, "window-shingles")
    bag = cut_lineage(ish.groupBy("item", "h").agg(F.count("*").alias("c")), "item-bags")
    fw = cut_lineage(fingerprints(wsh, "win").join(windows.select("win", "n"), "win"), "window-fingerprints")
    fi = cut_lineage(fingerprints(bag, "item").join(items.select("item", "n"), "item"), "item-fingerprints")
    pairs = cut_lineage(within_radius(fw, fi, seeds), "fingerprint-pairs")
    size_w = wsh.groupBy("win").agg(F.sum("c").alias("cw"))
    both = (pairs.join(wsh, "win").join(bag.withColumnRenamed("c", "ci"), ["item", "h"])
            .groupBy("win", "item").agg(F.sum(F.least("c", "ci")).alias("both")))
    sim = both.join(size_w, "win").join(items.select("item", F.col("n").alias("ci")), "item").withColumn("similarity", F.col("both") / (F.col("cw") + F.col("ci") - F.col("both")))
    return (sim.filter(F.col("similarity") >= SIMILARITY).join(windows, "win").select("key", "item", "start", F.col("n"), "similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, similarity, first_word, n_words) of each document and item of which some window is a copy: the best window's figures."""
    w = words(F.lower("text"))
    items = (benchmark.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
             .withColumn("w", w).filter("size(w) > 0").withColumn("k", F.least(F.size("w"), F.lit(SHINGLE))).withColumn("item", F.monotonically_increasing_id()))
    items = cut_lineage(items.select("item", "item_id", "text", "k"), "items")
    texts = docs.filter("text is not null").select(text_key(F.col("text")).alias("key"), "text")
    found = None
    for k in [r[0] for r in items.select("k").distinct().collect()]:  # at most SHINGLE values
        of = with_shingles(items.filter(F.col("k") == k), F.lower("text"), k, "s").select("item", "s", F.size("s").alias("n"))
        part = leaks_of_size(texts, of, k).withColumn("n_words", F.col("n") + (k - 1))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.filter("false").selectExpr("doc_id", "cast(null as binary) AS key", "0L AS item_id", "0D AS similarity", "0 AS first_word", "0 AS n_words")
    best = found.groupBy("key", "item").agg(F.max(F.struct("similarity", -F.col("start"), "n_words")).alias("x"))
    best = cut_lineage(best.join(items.select("item", "item_id"), "item")
                       .selectExpr("key", "item_id", "x.similarity", "-x.col2 AS first_word", "x.n_words"), "leaks")
    d = docs.filter("text is not null").select("doc_id", text_key(F.col("text")).alias("key"))
    return d.join(small(best), "key").select("doc_id", "key", "item_id", "similarity", "first_word", "n_words")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copy of an item."""
    (key,) = unused(docs, "leaked")
    bad = cut_lineage(leaks(docs.select("doc_id", "text"), benchmark).select(F.col("key").alias(key)).distinct(), "leaked-texts")
    return docs.join(small(bad), F.col(key) == text_key(F.col("text")), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "first_word", "n_words")
