"""Near-duplicate documents by SimHash: fingerprints are cut into blocks, those that agree in enough blocks meet, Hamming distance decides.

A fingerprint has a bit set if it is set in over half the hashes of the text's shingles. With ``BITS_APART`` = 4 differing bits and m blocks,
two linked fingerprints agree in some m - 4 blocks, so both are found under the key that leaves the other four blocks free. m
grows with the number of distinct fingerprints, so that a key has few of them by chance. A key with more than ``CROWD`` fingerprints is
split: its four free blocks are halved, and of the eight halves four at a time are left free. After ``LEVELS`` halvings the free
blocks have so few bits that a key can hold no more than 4,096 fingerprints, so every group is bounded and no link is lost. The fingerprints of a
key are compared in one array, which gives a spanning forest of the links, never all pairs. Keys whose fingerprints are connected already are dropped.

Defined cases: null and blank texts have the fingerprint zero and are linked like any other; a text of fewer words than ``SHINGLE`` is one shingle.
Rows that share a doc_id each keep their fingerprint; null doc_ids never become a component_id unless no linked row has another. Only
doc_id and text are read, whatever other columns there are. Empty tables give empty results.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.classes import components, small
from sparkraster.llm.common import SPACES, table
from sparkraster.session import cut_lineage

SHINGLE, BITS_APART, CROWD, LEVELS, PER_KEY = 4, 4, 256, 3, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased."""
    low = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, SPACES))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every row; f holds the 64 bits as a signed number.

    Shingles are hashed by XXH64 (seed 42); a sequence shorter than ``SHINGLE`` words is hashed whole.
    """
    d = docs.select("doc_id", lowered_words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    runs = F.transform(F.sequence(F.lit(1), F.col("n") - (SHINGLE - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at("w", i + k) for k in range(SHINGLE)])))
    one = F.array(F.xxhash64(F.array_join("w", " ")))
    d = d.select("doc_id", F.when(F.col("n") >= SHINGLE, runs).when(F.col("n") > 0, one).otherwise(F.array().cast("array<bigint>")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.ascontiguousarray(b["h"].flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.r_[0, np.cumsum(b["h"].value_lengths().to_numpy(zero_copy_only=False))]
            f = np.array([majority(flat[ends[i]:ends[i + 1]]) for i in range(b.num_rows)], np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(f)], names=["doc_id", "f"])
    return d.mapInArrow(run, "doc_id bigint, f bigint")


def majority(h: np.ndarray) -> int:
    """The bits set in over half of ``h``; counted a stretch at a time, so that memory stays small for long texts."""
    n = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        n += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * n > len(h), bitorder="little").view(np.int64)[0])


def block_count(n: int) -> int:
    """Blocks to cut into: the least number, six at least, with at most ``PER_KEY`` of ``n`` random fingerprints to a key."""
    m = 6
    while m < 16 and n / 2.0 ** (64 * (m - BITS_APART) / m) > PER_KEY:
        m += 1
    return m


def block_masks(m: int) -> list[int]:
    """``m`` masks of neighbouring bits, signed."""
    edges = [round(i * 64 / m) for i in range(m + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(m)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _keyed(rows: DataFrame, free: Column, m: int) -> DataFrame:
    """(free, mask, key, f): ``free`` an array of sets of four of ``m`` blocks, a key for each set."""
    masks = F.array(*[F.lit(x).cast("long") for x in block_masks(m)])
    d = rows.select("f", F.explode(free).alias("free"))
    for i in range(BITS_APART):
        d = d.withColumn(f"x{i}", F.element_at(masks, F.element_at("free", i + 1) + 1))
    mask = F.col("x0")
    for i in range(1, BITS_APART):
        mask = mask.bitwiseOR(F.col(f"x{i}"))
    return d.select("free", mask.alias("mask"), "f").withColumn("key", F.col("f").bitwiseAND(F.bitwise_not("mask")))


def _forest(groups: DataFrame) -> DataFrame:
    """Links (a, b) that join what is linked inside each group (fs: distinct fingerprints): fewer than its members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            flat, ends = batch["fs"].flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(batch["fs"].value_lengths().to_numpy(zero_copy_only=False))]
            for i in range(batch.num_rows):
                f = flat[ends[i]:ends[i + 1]].astype(np.int64).view(np.uint64)  # bits of signed numbers would be counted without their sign
                left = np.arange(len(f))
                while len(left):  # breadth first from the first that is left
                    front, left = left[:1], left[1:]
                    while len(front) and len(left):
                        near = np.bitwise_count(f[left] ^ f[front[0]]) <= BITS_APART
                        got = left[near]
                        a += f.view(np.int64)[np.repeat(front[:1], len(got))].tolist()
                        b += f.view(np.int64)[got].tolist()
                        front, left = np.r_[front[1:], got], left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return groups.select("fs").mapInArrow(run, "a bigint, b bigint")


def fingerprint_roots(distinct: DataFrame, n: int) -> DataFrame:
    """(id, root) of the fingerprints (f, a written table of ``n`` distinct ones) that are linked to another, directly or through others."""
    m = block_count(n)
    sets = [F.array(*[F.lit(x) for x in c]) for c in combinations(range(m), BITS_APART)]
    rows = cut_lineage(_keyed(distinct, F.array(*sets), m), "simhash-keys")
    links = roots = None
    for level in range(LEVELS):
        sizes = cut_lineage(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
        last = level == LEVELS - 1
        cold = rows.join(small(sizes.filter("true" if last else f"n <= {CROWD}")), ["mask", "key"])
        new = cut_lineage(_forest(cold.groupBy("mask", "key").agg(F.collect_list("f").alias("fs"))).distinct(), "simhash-links")
        links = new if links is None else links.union(new)
        hot = sizes.filter(f"n > {CROWD}").drop("n")
        if last or hot.isEmpty():
            return components(links)
        roots = components(links)
        crowd = rows.join(small(hot), ["mask", "key"]).join(small(roots).withColumnRenamed("id", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
        open_keys = crowd.groupBy("mask", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("mask", "key")
        crowd = crowd.join(small(cut_lineage(open_keys, "simhash-open")), ["mask", "key"]).select("f", "free")
        halves = F.flatten(F.transform("free", lambda b: F.array(b * 2, b * 2 + 1)))
        picks = [list(c) for c in combinations(range(2 * BITS_APART), BITS_APART)]
        free = F.transform(F.array(*[F.array(*[F.lit(i) for i in c]) for c in picks]), lambda c: F.transform(c, lambda i: F.element_at("halves", i + 1)))
        m *= 2
        rows = cut_lineage(_keyed(crowd.withColumn("halves", halves), free, m).dropDuplicates(["mask", "key", "f"]), "simhash-keys")


def document_components(docs: DataFrame) -> DataFrame:
    """(doc_id, f, component_id) of every row."""
    fps = cut_lineage(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    distinct = cut_lineage(fps.groupBy("f").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = fingerprint_roots(distinct.select("f"), distinct.count())
    of = roots.withColumnRenamed("id", "f")
    least = cut_lineage(of.join(distinct, "f").groupBy("root").agg(F.min("first").alias("least")), "component-firsts")
    linked = cut_lineage(of.join(small(least), "root").select("f", "least", F.lit(True).alias("linked")), "component-fingerprints")
    ids = distinct.join(small(linked), "f", "left").select("f", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return fps.join(small(cut_lineage(ids, "fingerprint-ids")), "f").select("doc_id", "f", "component_id")


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_components(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.format_string("%016x", "f").alias("fingerprint"), "component_id")
