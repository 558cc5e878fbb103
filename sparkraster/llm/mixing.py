"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get targets (a share of all words, weighted, none above a multiple of its size). Targets become integer
seats of ``block`` words: as many as all targets together make, rounded once, are shared out among the sources, each further seat to
the highest quotient target / (2 seats + 1). A source's seats go to its shards (documents dealt by a seeded hash) by the same rule. Within a shard, documents are laid end to end in a
seeded order, which cuts the shard into blocks; seats take the blocks in that order, round after round. No shard is taken more than ``most`` times, so a seat of a source whose limit is
under a block is filled up to that limit only.

Nulls: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, last in order.
Ties between quotients go to the earlier source or shard. Rows of one doc_id are told apart by their text only in the seeded
order; equal rows follow each other, each with its own share. An empty table gives an empty result. Only doc_id, text and source
are read, so other columns can't clash.
"""
from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkraster.llm.common import WORD, table
from sparkraster.session import cut_lineage

BLOCK, SHARD_DOCS, SEED, PROBES = 16, 4096, 17, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: (source, source_size, n_docs) a row per source. Adds k, its place among all, and target: ``share`` of all words by weight, sources over
    ``most`` times their size held there and the excess shared again by weight until none is above.

    Sources at their limit are those of the least limit-to-weight ratios; each round finds more of them from one row of sums.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    k = F.row_number().over(by) - 1
    s = sizes.withColumn("k", k.cast("long")).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    s = cut_lineage(s.withColumn("limit", most * F.col("source_size")), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("limit") <= F.lit(level) * F.col("w")
        held, free = s.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(~full, F.col("w")).otherwise(0.0))).first()
        if not free or (share * total - held) / free <= level * (1 + 1e-12):
            break
        level = (share * total - held) / free
    return s.withColumn("target", F.when(F.col("limit") <= level * F.col("w"), F.col("limit")).otherwise(level * F.col("w"))).drop("w", "limit")


def narrowed(lo: int, hi: int, want: int, count: Callable[[list[int]], list[int]]) -> tuple[int, int]:
    """(lo, hi) brought together, where ``count`` doesn't fall from lo to hi, is under ``want`` at lo and ``want`` or more at hi."""
    while hi - lo > 1:
        at = sorted({lo + (hi - lo) * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {lo})
        for x, n in zip(at, count(at)):
            if n >= want:
                hi = x
                break
            lo = x
        if hi in at and n == want:
            break
    return lo, hi


def seats_at_least(votes: Column, least: Column) -> Column:
    """How many of the quotients votes / 1, votes / 3, votes / 5 .. are ``least`` or more."""
    n = F.floor(votes / (2 * least) + 0.5)  # off by one at most
    return F.when((n > 0) & (votes / (2 * n - 1) < least), n - 1).when(votes / (2 * n + 1) >= least, n + 1).otherwise(n).cast("long")


def sainte_lague_of_all(parts: DataFrame, votes: str, seats: int, rank: str) -> DataFrame:
    """Adds ``quota``: as ``sainte_lague`` with all of ``parts``, a written table, as one group of any number of rows.

    The quotient of the last seat is searched for between doubles by sums over the table, many of them in one pass; where more rows
    share that very quotient than seats are left, those of the lowest ``rank`` (unique whole numbers) get them, searched for in the same way.
    """
    v = F.col(votes).cast("double")
    total, n, last = parts.agg(F.sum(v), F.count("*"), F.max(rank)).first()
    if not total or seats <= 0:
        return parts.withColumn("quota", F.lit(0).cast("long"))

    def sums(of: Callable[[Column], Column], rows: DataFrame, at: list) -> list[int]:
        d = rows.select("*", F.posexplode(F.array(*[F.lit(x) for x in at])).alias("_p", "_x")).groupBy("_p").agg(F.sum(of(F.col("_x"))).alias("n"))
        got = {r["_p"]: r["n"] for r in d.collect()}
        return [got.get(i, 0) for i in range(len(at))]

    def double(k: int) -> float:  # the more, the smaller
        return struct.unpack("<d", struct.pack("<q", -k))[0]

    def key(x: float) -> int:
        return -struct.unpack("<q", struct.pack("<d", x))[0]
    few, enough = narrowed(key(2 * total / seats), key(total / (2 * seats + n) / 2), seats, lambda at: sums(lambda x: seats_at_least(v, x), parts, [double(k) for k in at]))
    low = seats_at_least(v, F.lit(double(enough)))
    given = parts.agg(F.sum(low)).first()[0]
    if given == seats:
        return parts.withColumn("quota", low)
    high = seats_at_least(v, F.lit(double(few)))
    left = seats - parts.agg(F.sum(high)).first()[0]
    tied = parts.filter(low > high)
    _, upto = narrowed(-1, last, left, lambda at: sums(lambda x: (F.col(rank) <= x).cast("long"), tied, at))
    return parts.withColumn("quota", F.when(F.col(rank) <= upto, low).otherwise(high))


def sainte_lague(parts: DataFrame, group: list[str], votes: str, seats: str, order: list[Column]) -> DataFrame:
    """Adds ``quota``: ``seats`` (equal within a group) are given one by one to the highest votes / (2 quota + 1).

    Rounding votes to a common divisor gives all but a few seats of the method; the few left over or given too often
    are settled by the quotients themselves.
    """
    g = W.partitionBy(*group)
    d = parts.withColumn("_v", F.sum(votes).over(g)).withColumn("_d", F.when(F.col(seats) > 0, F.col("_v") / F.col(seats)))
    d = d.withColumn("quota", F.coalesce(F.floor(F.try_divide(F.col(votes), F.col("_d")) + 0.5), F.lit(0)).cast("long"))
    d = d.withColumn("_more", F.col(seats) - F.sum("quota").over(g))
    up = F.row_number().over(W.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("quota") + 1)).desc(), *order))
    down = F.row_number().over(W.partitionBy(*group).orderBy(F.when(F.col("quota") > 0, F.col(votes) / (2 * F.col("quota") - 1)).asc_nulls_last(), *[c.desc() for c in order]))
    d = d.withColumn("_up", up).withColumn("_down", down)
    return d.withColumn("quota", F.when((F.col("_more") > 0) & (F.col("_up") <= F.col("_more")), F.col("quota") + 1)
                        .when((F.col("_more") < 0) & (F.col("_down") <= -F.col("_more")), F.col("quota") - 1).otherwise(F.col("quota"))
                        ).drop("_v", "_d", "_more", "_up", "_down")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document; the defaults are the contract's."""
    slim = cut_lineage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h")), "mix-sizes")
    targets = cut_lineage(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")),
                                         weights, share, most), "mix-targets")
    seats = round((targets.agg(F.round(F.sum("target"), 6)).first()[0] or 0) / block)
    targets = cut_lineage(sainte_lague_of_all(targets, "target", seats, "k").withColumnRenamed("quota", "_seats").drop("k"), "mix-seats")
    targets = targets.withColumn("_shards", F.ceil(F.col("n_docs") / shard_docs))
    t = F.broadcast(targets) if targets.count() <= 100_000 else targets
    slim = (slim.alias("s").join(t.alias("t"), F.expr("s.source <=> t.source"))
            .selectExpr("s.*", "source_size", "target", "_seats", "pmod(_h, _shards) AS _shard", "hash(_h) AS _o"))
    shards = slim.groupBy("source", "source_size", "target", "_seats", "_shard").agg(F.sum("size").alias("_votes"))
    q = cut_lineage(sainte_lague(shards, ["source"], "_votes", "_seats", [F.col("_shard")])
                    .select("source", "_shard", "_votes", "quota"), "mix-quotas")
    w = W.partitionBy("source", "_shard").orderBy("_o", "_h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    laid = slim.withColumn("_at", F.coalesce(F.sum("size").over(w), F.lit(0)))
    laid = laid.alias("s").join(q.alias("q"), F.expr("s.source <=> q.source and s._shard = q._shard")).select("s.*", "_votes", "quota")
    words = F.least(F.col("quota") * block, (F.col("_votes") * most).cast("long"))
    rounds = F.when(F.col("_votes") > 0, F.floor(words / F.col("_votes"))).otherwise(F.lit(0)).cast("long")
    rest = words - rounds * F.col("_votes")
    part = F.least(F.greatest(rest - F.col("_at"), F.lit(0)), F.col("size"))
    return laid.select("doc_id", "source", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
