"""Prefix trie of rebuilt conversations: nodes are distinct prefix digests in minimal-perfect-hash tables, counts are summed in flat arrays.

A prefix digest combines a 128-bit hash of each turn with its position, so all digests of a conversation come from one running pass.
Grouping by digest gives the nodes with their members. Subtrees of at most ``SHARD_TURNS`` turns (counted with repeats, which
grouping alone can tell) are dealt over tasks whole. A task takes some subtrees at a time as a shard: its digests get the slots of a minimal perfect hash, every slot is
verified against the whole digest, counts are scattered into arrays by slot, and parent-slot arrays carry them upwards from the deepest level.
Nodes above these subtrees are the crown. Runs of crown nodes with one crown child are summed by pointer doubling; what is left are at most
twice as many nodes as the turns hold ``SHARD_TURNS``, one shard of their own. So neither a wide nor a deep hot subtree has to fit in a task.

Member lists are hashed from a stream sorted by id: first chunks of digits are made in tasks dealt by id range, then one hash runs over a node's chunks.

Defined cases: rows with a null conv_id take no part; rows of one conversation with the same turn are ordered by role, then text; rows are never merged, so repeated
rows are turns of their own. No conversations give no nodes. Columns other than conv_id, turn, role and text are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkraster.llm.classes import small
from sparkraster.llm.common import table
from sparkraster.operators.ranking import bucketed_row_number
from sparkraster.session import cut_lineage

GROUP, MOST_SHARED = 100, 6
SHARD_TURNS, SHARD_NODES, CHUNK_TURNS, CHUNK_IDS = 200_000, 100_000, 4096, 8192
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------------------- conversations to prefixes
def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, c1, c2, len): turns in order from 1, two hashes of role and text, and the text's code points."""
    t = rows.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    early = F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 62)))
    n = bucketed_row_number(t, ["conv_id"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], early, "pos")
    return n.select("conv_id", F.col("pos").cast("long").alias("pos"), F.xxhash64(F.lit(1), "role", "text").alias("c1"), F.xxhash64("text", "role", F.lit(2)).alias("c2"), F.length("text").cast("long").alias("len"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total) and their rebuilt turns (conv_id, depth, total, c1, c2, len)."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    sizes = cut_lineage(turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("base", base).withColumn("h", shared_turns(F.col("conv_id"))), "conversations")
    firsts = sizes.filter("conv_id = base").select("base", F.col("own").alias("in_base"))
    taken = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.least("h", F.coalesce("in_base", F.lit(0))))
    kept_from = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.col("h"))
    convs = cut_lineage(sizes.join(small(firsts), "base", "left").withColumn("taken", taken).withColumn("skip", kept_from)
                        .select("conv_id", "base", "taken", "skip", (F.col("taken") + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).cast("long").alias("total")), "conversations")
    lent = turns.filter((F.col("pos") < MOST_SHARED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    content = ["total", "c1", "c2", "len"]
    own = turns.join(small(convs), "conv_id").filter("pos > skip").select("conv_id", (F.col("pos") - F.col("skip") + F.col("taken")).cast("long").alias("depth"), *content)
    lead = convs.filter("taken > 0").join(lent, "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("depth"), *content)
    return convs.select("conv_id", "total"), own.unionByName(lead)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, total, len, d1, d2, p1, p2): the digest of each prefix and of the one before; that of no turns is 0, 0."""
    t = cut_lineage(rows.select("conv_id", "depth", "total", "len", F.xxhash64("depth", "c1").alias("g1"), F.xxhash64("c2", "depth").alias("g2"), F.floor((F.col("depth") - 1) / CHUNK_TURNS).alias("chunk")), "rebuilt-turns")
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (t.filter(F.col("total") > CHUNK_TURNS).groupBy("conv_id", "chunk").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
              .select("conv_id", "chunk", F.bit_xor("x1").over(by_chunk).alias("x1"), F.bit_xor("x2").over(by_chunk).alias("x2")))
    w = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.join(small(cut_lineage(chunks, "turn-chunks")), ["conv_id", "chunk"], "left")
    for i in "12":
        t = t.withColumn(f"d{i}", F.bit_xor(f"g{i}").over(w).bitwiseXOR(F.coalesce(f"x{i}", F.lit(0).cast("long"))))
    return t.select("conv_id", "depth", "total", "len", "d1", "d2", F.col("d1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("g2")).alias("p2"))


# ---------------------------------------------------------------------------- node tables
def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class NodeTable:
    """Minimal perfect hash of distinct 128-bit digests: levels of bit arrays, a digest sits in the first level where no other falls on its place."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        left, placed, self.levels = np.arange(len(a)), 0, []
        while len(left):
            if len(self.levels) > 64:
                raise ValueError("digests repeat")
            size = len(left) + len(left) // 4 + 1
            at = (_mixed(a[left], b[left], len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            self.levels.append((size, bits, np.cumsum(bits) - 1 + placed))
            placed += int(alone.sum())
            left = left[~alone]
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        slot = self._slots(a, b)
        self.a[slot], self.b[slot] = a, b
        if (self.a[slot] != a).any() or (self.b[slot] != b).any():
            raise ValueError("two digests share a slot")

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (size, bits, rank) in enumerate(self.levels):
            at = (_mixed(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for those that are not in the table."""
        s = self._slots(a, b)
        s[(self.a[s] != a) | (self.b[s] != b)] = -1
        return s


def accumulate(d1, d2, p1, p2, depth, leaves, saved) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: row of its parent (-1 if it is not here), children here, and sums of ``leaves`` and ``saved`` over its subtree; a node without children has its own leaf count."""
    u = [x.astype(np.int64).view(np.uint64) for x in (d1, d2, p1, p2)]
    nodes = NodeTable(u[0], u[1])
    slot, up = nodes.slots(u[0], u[1]), nodes.slots(u[2], u[3])
    up[(u[0] == u[2]) & (u[1] == u[3])] = -1
    n = len(slot)
    parent, level, row = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    parent[slot], level[slot], row[slot] = up, depth, np.arange(n)
    children = np.bincount(parent[parent >= 0], minlength=n)
    sums = []
    for own in (leaves, saved):
        x = np.empty(n, np.int64)
        x[slot] = own
        sums.append(x)
    order = np.argsort(-level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[order])) + 1
    for s in np.split(order, cuts):  # the deepest level first
        s = s[parent[s] >= 0]
        for x in sums:
            np.add.at(x, parent[s], x[s])
    above = parent[slot]
    return np.where(above >= 0, row[above], -1), children[slot], sums[0][slot], sums[1][slot]


SHARD = "d1 bigint, d2 bigint, p1 bigint, p2 bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, top boolean"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole subtrees, some at a time; the batches come sorted by subtree (s1, s2)."""
    def solve(t: pa.Table) -> pa.RecordBatch:
        c = {x: t[x].to_numpy() for x in ("d1", "d2", "p1", "p2", "conv_id", "depth", "n_convs", "len", "inner")}
        up, children, leaves, saved = accumulate(c["d1"], c["d2"], c["p1"], c["p2"], c["depth"], 1 - c["inner"], (c["n_convs"] - 1) * c["len"])
        conv = pa.array(c["conv_id"][up], mask=up < 0)
        return pa.RecordBatch.from_arrays([*[pa.array(c[x]) for x in ("d1", "d2", "p1", "p2", "conv_id", "depth")], conv, pa.array(c["n_convs"]), pa.array(children.astype(np.int64)), pa.array(leaves), pa.array(saved), pa.array(up < 0)],
                                          names=[x.split()[0] for x in SHARD.split(", ")])
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n > SHARD_NODES:
            t = pa.Table.from_batches(held)
            last = np.flatnonzero((t["s1"].to_numpy() != t["s1"][n - 1].as_py()) | (t["s2"].to_numpy() != t["s2"][n - 1].as_py()))
            if len(last):
                cut = int(last[-1]) + 1
                yield solve(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), n - cut
    if n:
        yield solve(pa.Table.from_batches(held))


def member_hashes(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of (d1, d2, conv_id): the hash of a node's ids, ascending, with commas between."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2, ids = (b[x].to_numpy(zero_copy_only=False) for x in ("d1", "d2", "conv_id"))
            cut = np.flatnonzero((np.diff(d1) != 0) | (np.diff(d2) != 0)) + 1
            cut = np.unique(np.r_[0, cut, np.arange(0, len(ids), CHUNK_IDS)])[:len(ids)]
            text = [",".join(map(str, x)) for x in np.split(ids, cut[1:])] if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (d1, d2, ids)] + [pa.array(text, pa.string())], names=["d1", "d2", "first", "text"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for b in batches:
            out = []
            for d1, d2, text in zip(b["d1"].to_pylist(), b["d2"].to_pylist(), b["text"].to_pylist()):
                if (d1, d2) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (d1, d2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            yield of(out)
        if key is not None:
            yield of([(*key, digest.hexdigest())])

    def of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["d1", "d2", "ends_sha256"])
    parts = ends.select("d1", "d2", "conv_id").repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(chunks, "d1 bigint, d2 bigint, first bigint, text string")
    return parts.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").select("d1", "d2", "text").mapInArrow(hashes, "d1 bigint, d2 bigint, ends_sha256 string")


# ---------------------------------------------------------------------------- crown
def crown_sums(crown: DataFrame, tops: DataFrame) -> DataFrame:
    """Crown nodes (d1, d2, p1, p2, conv_id, depth, n_convs, len) with children and sums; ``tops`` are the subtrees' top nodes that hang below."""
    node, up = ["d1", "d2"], ["p1", "p2"]
    below = tops.groupBy(*up).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnsRenamed(dict(zip(up, node)))
    inner = crown.filter("depth > 0")
    only = inner.groupBy(*up).agg(F.count("*").alias("k"), F.min("d1").alias("c1"), F.min(F.struct("d1", "d2")).alias("c")).select(*[F.col(a).alias(b) for a, b in zip(up, node)], "k", F.col("c.d1").alias("c1"), F.col("c.d2").alias("c2"))
    k = crown.join(below, node, "left").join(only, node, "left").na.fill(0, ["n", "leaves", "saved", "k"])
    k = k.withColumn("own_leaves", F.when(F.col("n") + F.col("k") == 0, 1).otherwise(F.col("leaves"))).withColumn("own_saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("len"))
    unary = F.col("k") == 1
    k = cut_lineage(k.select(*node, *up, "conv_id", "depth", "n_convs", "k", (F.col("n") + F.col("k")).alias("n_children"), "own_leaves", "own_saved", F.when(unary, F.col("c1")).otherwise(F.col("d1")).alias("e1"),
                             F.when(unary, F.col("c2")).otherwise(F.col("d2")).alias("e2"), F.when(unary, F.col("own_leaves")).otherwise(0).alias("run_leaves"), F.when(unary, F.col("own_saved")).otherwise(0).alias("run_saved")), "crown")
    while True:  # e: a node further down the run, its end at last; run: sums from the node to before e
        nxt = k.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("e1").alias("f1"), F.col("e2").alias("f2"), F.col("run_leaves").alias("more_leaves"), F.col("run_saved").alias("more_saved"))
        j = k.join(nxt, ["e1", "e2"]).withColumn("moved", (F.col("e1") != F.col("f1")) | (F.col("e2") != F.col("f2")))
        there = (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2"))
        for x in ("leaves", "saved"):
            j = j.withColumn(f"run_{x}", F.col(f"run_{x}") + F.when(there, 0).otherwise(F.col(f"more_{x}")))
        k = cut_lineage(j.withColumn("e1", F.col("f1")).withColumn("e2", F.col("f2")).drop("f1", "f2", "more_leaves", "more_saved"), "crown")
        if k.filter("moved").isEmpty():
            break
        k = k.drop("moved")
    forks = k.filter("k <> 1").select(*node)
    heads = k.join(forks.withColumnsRenamed(dict(zip(node, up))), up, "left_semi").filter("depth > 0").union(k.filter("depth = 0"))  # where runs begin
    heads = heads.select(F.col("e1").alias("d1"), F.col("e2").alias("d2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("depth").alias("head_depth"), F.col("run_leaves").alias("head_leaves"), F.col("run_saved").alias("head_saved"))
    ends = k.filter("k <> 1").join(heads, node)
    none = F.col("head_depth") == 0
    ends = ends.select(*node, F.when(none, F.col("d1")).otherwise(F.col("q1")).alias("p1"), F.when(none, F.col("d2")).otherwise(F.col("q2")).alias("p2"), "depth",
                       (F.col("own_leaves") + F.col("head_leaves")).alias("leaves"), (F.col("own_saved") + F.col("head_saved")).alias("saved"), "head_leaves", "head_saved")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        if t.num_rows:
            c = {x: t[x].to_numpy() for x in t.column_names}
            _, _, leaves, saved = accumulate(*[c[x] for x in ("d1", "d2", "p1", "p2", "depth", "leaves", "saved")])
            yield pa.RecordBatch.from_arrays([pa.array(c["d1"]), pa.array(c["d2"]), pa.array(leaves - c["head_leaves"]), pa.array(saved - c["head_saved"])], names=["e1", "e2", "end_leaves", "end_saved"])

    # One shard: forks and ends of runs are at most twice as many as subtrees of more than SHARD_TURNS turns fit side by side.
    solved = ends.coalesce(1).mapInArrow(solve, "e1 bigint, e2 bigint, end_leaves bigint, end_saved bigint")
    return (k.join(solved, ["e1", "e2"])
            .select(*node, *up, "conv_id", "depth", "n_convs", "n_children", (F.col("run_leaves") + F.col("end_leaves")).alias("n_leaves"), (F.col("run_saved") + F.col("end_saved")).alias("saved_tokens")))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    node = ["d1", "d2"]
    convs, rows = rebuilt(cut_lineage(numbered_turns(conversations), "turns"))
    convs = cut_lineage(convs, "totals")
    p = cut_lineage(prefixes(rows), "prefixes")
    heavy = cut_lineage(p.groupBy(*node).agg(F.sum(F.col("total") - F.col("depth") + 1).alias("turns")).filter(F.col("turns") > SHARD_TURNS).select(*node, F.lit(True).alias("heavy")), "heavy-prefixes")
    p = p.join(small(heavy), node, "left")
    light = p.filter("heavy is null")
    subtree = cut_lineage(light.groupBy("conv_id").agg(F.min_by(F.struct("d1", "d2"), "depth").alias("s")).select("conv_id", F.col("s.d1").alias("s1"), F.col("s.d2").alias("s2")), "subtrees")
    nodes = p.groupBy(*node).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("len").alias("len"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
                                 F.max(F.when(F.col("depth") < F.col("total"), 1).otherwise(0)).cast("long").alias("inner"), F.max("heavy").alias("heavy"))
    nodes = cut_lineage(nodes, "nodes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(zero.alias("d1"), zero.alias("d2"), zero.alias("p1"), zero.alias("p2"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("len"))
    crown = cut_lineage(nodes.filter("heavy").select(*root.columns).union(root), "crown-nodes")
    shards = (nodes.filter("heavy is null").join(small(subtree), "conv_id").select("s1", "s2", *node, "p1", "p2", "conv_id", "depth", "n_convs", "len", "inner")
              .repartition("s1", "s2").sortWithinPartitions("s1", "s2").mapInArrow(_shards, SHARD))
    shards = cut_lineage(shards, "shards")
    top = cut_lineage(crown_sums(crown, shards.filter("top")), "crown-sums")
    full = shards.drop("top").unionByName(top.withColumn("parent_conv_id", F.lit(None).cast("long")))
    over = top.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("crown_conv"))
    full = full.join(small(over), ["p1", "p2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "crown_conv")))
    ends = p.filter("depth = total").select(*node, "conv_id").union(convs.filter("total = 0").select(zero, zero, "conv_id"))
    members = cut_lineage(member_hashes(cut_lineage(ends, "ends")), "member-hashes")
    full = full.join(members, node, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


# The same by grouping on prefixes of turn digests, every node joined to all that lie above it.
OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT CAST({_crc_table()} AS BIGINT[]) AS t),
turns AS (SELECT conv_id, coalesce(role,'') AS role, coalesce(text,'') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,'')) AS pos
 FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM turns),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % {MOST_SHARED} AS h
 FROM ids, crc),
parts AS (
 SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h WHERE c.conv_id <> c.base
 UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t USING (conv_id) WHERE c.conv_id = c.base OR pos > c.h),
built AS (SELECT conv_id, text, md5(concat(length(role), ':', role, text)) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM parts),
paths AS (SELECT conv_id, depth, length(text) AS len, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM built
 UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
totals AS (SELECT conv_id, max(depth) AS total FROM paths GROUP BY 1),
nodes AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(len) AS len, count(*) AS n_convs FROM paths GROUP BY 1),
kids AS (SELECT key[1:length(key) - 32] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM paths JOIN totals USING (conv_id) WHERE depth = total GROUP BY 1),
sums AS (SELECT p.key, sum((n.n_convs - 1) * n.len) AS saved_tokens, count(*) FILTER (WHERE k.key IS NULL) AS n_leaves
 FROM nodes n LEFT JOIN kids k USING (key) JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
 CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes up ON n.depth > 0 AND up.key = n.key[1:length(n.key) - 32]"""
