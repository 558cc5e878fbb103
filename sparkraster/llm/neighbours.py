"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, walked best bin first.

The tree is grown on at most about ``SAMPLE`` vectors (by a hash of vec_id); every vector is then filed under a leaf. A query takes nodes
from a priority queue by the inner product their vectors can be expected to reach, and files itself under the leaves it
comes to first. How many is calibrated: ``CALIBRATION`` queries are answered by brute force over all rows, and leaf visits are doubled until
``RECALL`` of their true neighbours lie in visited leaves. Leaves are cut into blocks of bounded size (a leaf may hold
any share of the rows), query blocks meet the vector blocks of their leaves, and each block gives its best.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do rows with a null vec_id
or another number of components than most; equal scores go to the smaller vec_id; rows that share a vec_id are not each other's neighbours; an empty
table, or no queries, gives an empty result. Only vec_id and embedding are read, so other columns can't clash.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkraster.llm.classes import small
from sparkraster.llm.common import table
from sparkraster.session import cut_lineage

SAMPLE, FAN_OUT, LEAF_SAMPLE, CALIBRATION, RECALL, BLOCK, VISIT_ROWS = 20_000, 8, 64, 64, 0.97, 2048, 1 << 16


class Tree:
    """Nodes in arrays: centre, first child and number of children (0: leaf), the leaf's number, and reach, a node's usual excess over its centre for a query of length 1."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centre, self.child, self.count, self.leaf, self.reach = [x.mean(0)], [0], [0], [-1], [0.0]
        todo, self.leaves = [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            v = x[rows]
            self.reach[node] = float(np.sqrt(((v - self.centre[node]) ** 2).mean() * 2 * np.log(max(2, len(v)))))
            parts = self.split(v, rng) if len(rows) > LEAF_SAMPLE else []
            if len(parts) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.child[node], self.count[node] = len(self.centre), len(parts)
            for p in parts:
                todo.append((len(self.centre), rows[p]))
                self.centre.append(v[p].mean(0))
                self.child.append(0), self.count.append(0), self.leaf.append(-1), self.reach.append(0.0)
        self.centre, self.reach = np.array(self.centre), np.array(self.reach)

    @staticmethod
    def split(v: np.ndarray, rng) -> list[np.ndarray]:
        c = v[rng.choice(len(v), FAN_OUT, replace=False)]
        for _ in range(12):
            of = np.argmin((c * c).sum(1) - 2 * v @ c.T, axis=1)
            c = np.array([v[of == i].mean(0) if (of == i).any() else c[i] for i in range(len(c))])
        of = np.argmin((c * c).sum(1) - 2 * v @ c.T, axis=1)
        return [np.flatnonzero(of == i) for i in range(len(c)) if (of == i).any()]

    def file(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level."""
        node = np.zeros(len(v), int)
        while True:
            inner = [n for n in np.unique(node) if self.count[n]]
            if not inner:
                return np.array(self.leaf)[node]
            for n in inner:
                rows = np.flatnonzero(node == n)
                c = self.centre[self.child[n]:self.child[n] + self.count[n]]
                node[rows] = self.child[n] + np.argmin((c * c).sum(1) - 2 * v[rows] @ c.T, axis=1)

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves for a query, best bin first."""
        score = self.centre @ q + np.linalg.norm(q) * self.reach
        heap, out = [(-score[0], 0)], []
        while heap and len(out) < most:
            _, n = heapq.heappop(heap)
            if not self.count[n]:
                out.append(self.leaf[n])
            for c in range(self.child[n], self.child[n] + self.count[n]):
                heapq.heappush(heap, (-score[c], c))
        return out


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component, so that equal vectors score equally wherever they stand."""
    s = np.zeros(len(v))
    for j in range(v.shape[1]):
        s += v[:, j] * q[j]
    return s


def best(v: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, vec_id and score of the ``k`` best rows for every query of a block.

    Products by matrix multiplication pick what may be among the best, ties and a margin for rounding included; those are summed anew.
    """
    rough = q @ v.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    m = rough.shape[1]
    least = np.partition(rough, m - k, axis=1)[:, m - k] if m > k else np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(v).max() * np.abs(q).max() * v.shape[1])
    rows, cols = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
    s = np.zeros(len(rows))
    for d in range(v.shape[1]):
        s += v[cols, d] * q[rows, d]
    o = np.lexsort((ids[cols], -s, rows))
    rows, cols, s = rows[o], cols[o], s[o]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return pd.DataFrame({"query_id": q_ids[rows[keep]], "vec_id": ids[cols[keep]], "score": s[keep]})


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    ok = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", e.alias("e")).filter("vec_id is not null and e is not null").filter(ok).filter(F.exists("e", lambda x: x != 0))


def blocks(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Rows (keys, id, e) packed by key: n rows a block as arrays of ids and of components."""
    return rows.groupBy(*keys).agg(F.collect_list(id_).alias(f"{id_}s"), F.flatten(F.collect_list("e")).alias(f"{id_}_v"))


def visited(tree: Tree, queries: pd.DataFrame, visits: int) -> Iterator[pd.DataFrame]:
    """query_id and leaf of each query's visits, a frame for as many queries as make about ``VISIT_ROWS`` rows; vectors are not repeated."""
    step = max(1, VISIT_ROWS // visits)
    for at in range(0, len(queries), step):
        part = queries.iloc[at:at + step]
        leaves = [tree.visit(q, visits) for q in part.e]
        yield pd.DataFrame({"query_id": part.query_id.repeat([len(x) for x in leaves]), "leaf": [y for x in leaves for y in x]})


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score, visits): the ``k`` nearest found for each row for which ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    empty = spark.range(0).selectExpr("id AS query_id", "cast(id AS int) AS rank", "id AS vec_id", "cast(id AS double) AS score", "cast(id AS int) AS visits")
    v = usable(vectors)
    dims = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return empty
    d, n = dims
    v = v.filter(F.size("e") == d)
    parts = 1 << 30
    sample = [r[0] for r in v.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)) < min(parts, parts * SAMPLE // n)).orderBy("vec_id").select("e").collect()]
    if not sample:
        sample = [v.first()["e"]]
    tree = Tree(np.array(sample))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.file(np.stack(b.e.to_numpy())))
    filed = cut_lineage(v.mapInPandas(file, "vec_id bigint, e array<double>, leaf int"), "vectors-by-leaf")
    queries = cut_lineage(filed.filter(is_query).select(F.col("vec_id").alias("query_id"), "e"), "queries")
    nq = queries.count()
    if not nq:
        return empty
    visits = calibrated(tree, filed, queries, nq, k, recall)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from visited(tree, b, visits)
    asked = cut_lineage(queries.mapInPandas(visit, "query_id bigint, leaf int"), "queries-by-leaf").join(queries, "query_id")

    def cut(rows: DataFrame, id_: str, part: str) -> DataFrame:
        per_leaf = cut_lineage(rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("_p")), "leaf-sizes")
        return blocks(rows.join(small(per_leaf), "leaf").withColumn(part, F.pmod(F.xxhash64(id_, F.lit(2)), F.col("_p"))), ["leaf", part], id_)
    pairs = cut(filed, "vec_id", "part").join(cut(asked, "query_id", "q_part"), "leaf")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield best(np.reshape(r.vec_id_v, (-1, d)), np.asarray(r.vec_ids), np.reshape(r.query_id_v, (-1, d)), np.asarray(r.query_ids), k)
    found = pairs.select("vec_ids", "vec_id_v", "query_ids", "query_id_v").mapInPandas(answer, "query_id bigint, vec_id bigint, score double")
    return top(found, k).withColumn("visits", F.lit(visits))


def top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, q: np.ndarray, q_ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, leaf) of a bounded set of queries against all rows (vec_id, e, leaf), batch by batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                got = best(np.stack(b.e.to_numpy()), b.vec_id.to_numpy(), q, q_ids, k)
                yield got.merge(b[["vec_id", "leaf"]].drop_duplicates("vec_id"), on="vec_id")
    found = rows.mapInPandas(run, "query_id bigint, vec_id bigint, score double, leaf int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def calibrated(tree: Tree, filed: DataFrame, queries: DataFrame, nq: int, k: int, recall: float) -> int:
    """The least power of two of leaf visits at which ``recall`` of the calibration queries' true neighbours lie in visited leaves."""
    few = queries.filter(F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(1 << 20)) < min(1 << 20, max(1, (CALIBRATION << 20) // nq))).orderBy("query_id").collect() or queries.limit(1).collect()
    q, ids = np.array([r["e"] for r in few]), np.array([r["query_id"] for r in few])
    truth: dict[int, list[int]] = {}
    for r in brute_force(filed, q, ids, k).select("query_id", "leaf").collect():
        truth.setdefault(r[0], []).append(r[1])
    order = [{leaf: n for n, leaf in enumerate(tree.visit(x, tree.leaves))} for x in q]
    at = np.array([order[i][leaf] for i, x in enumerate(ids) for leaf in truth.get(x, [])])
    visits = 1
    while visits < tree.leaves and len(at) and (at < visits).mean() < recall:
        visits *= 2
    return min(visits, tree.leaves)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")
