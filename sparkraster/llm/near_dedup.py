"""Near-duplicate documents by order MinHash: sketches that keep the order of sampled k-mers, verified by banded alignment.

A text's k-mers are its runs of ``KMER`` words, each labelled with its occurrence number among equal ones. Each of ``SKETCHES``
seeded permutations picks the ``PICKED`` smallest labelled k-mers and hashes them in the order in which the text has them, so
reordered texts seldom agree. Texts that agree in a sketch are candidates. Two candidates are near-duplicates if the longest common
subsequence of their k-mers, found in the band outside which the threshold can't be reached, is at least ``SIMILARITY`` of all
their k-mers (common / (a + b - common)). Classes are connected components of these links.

Defined cases: equal texts are one class, whatever their length; a null text is a class of its own; a text of fewer words than
``KMER`` is one k-mer; a text without words is linked to equal texts only. The class id is its smallest doc_id (null if it has none), and the
first document by doc_id stays; of rows equal in doc_id and text one stays. Words are compared without case. Empty tables give empty
results; ``deduplicate`` keeps all columns of its input under any names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.classes import linked_classes, small
from sparkraster.llm.common import table, unused, words
from sparkraster.session import cut_lineage

KMER, SKETCHES, PICKED, SIMILARITY, MAP_WORDS = 5, 10, 3, 0.8, 16


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which near values part."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(w: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``KMER`` words, in text order; of the whole text if it is shorter."""
    w = w.astype(np.uint64)
    k = min(KMER, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(3) + w[i:len(w) - k + 1 + i])
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Each k-mer hashed with its occurrence number among equal ones."""
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    nth = np.empty(len(h), np.uint64)
    nth[order] = (np.arange(len(h)) - start).astype(np.uint64)
    return mixed(h + nth * np.uint64(0x9E3779B97F4A7C15))


def sketch(w: np.ndarray) -> np.ndarray:
    """The ``SKETCHES`` hashes of ordered picks of a text with words ``w``."""
    label = labelled(kmers(w))
    seeds = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64))
    rank = mixed(label[None, :] ^ seeds[:, None])
    n = min(PICKED, len(label))
    at = np.sort(np.argpartition(rank, n - 1, axis=1)[:, :n], axis=1) if n < len(label) else np.broadcast_to(np.arange(n), (SKETCHES, n))
    out = seeds.copy()
    for i in range(n):
        out = mixed(out * np.uint64(5) + label[at[:, i]])
    return out.astype(np.int64)


def sketches(texts: DataFrame) -> DataFrame:
    """(id, bucket array) of (id, w), w the word hashes; texts without words give no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = b["w"].flatten().to_numpy(zero_copy_only=False), np.cumsum(b["w"].value_lengths().to_numpy(zero_copy_only=False))
            if b.num_rows:
                s = np.concatenate([sketch(flat[e0:e1]) for e0, e1 in zip(np.r_[0, ends[:-1]], ends)])
                yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(np.arange(0, len(s) + 1, SKETCHES, dtype=np.int32), pa.array(s))], names=["id", "buckets"])
    return texts.filter(F.size("w") > 0).mapInArrow(run, "id bigint, buckets array<bigint>")


def common_in_band(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Length of the longest common subsequence of ``a`` and ``b`` inside the band that any one of length ``need`` keeps to.

    Bit i of the vector is cell i of a row of the alignment; a row costs a few operations on whole machine words.
    """
    below, above = len(b) - need, len(a) - need
    if below < 0 or above < 0:
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full, strip = (1 << len(a)) - 1, (1 << (below + above + 1)) - 1
    v = full
    for j, x in enumerate(b.tolist()):
        m = where.get(x, 0)
        if m:
            lo = j - below
            m &= strip << lo if lo >= 0 else strip >> -lo
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def near(wa: np.ndarray, wb: np.ndarray, least: float = SIMILARITY) -> bool:
    a, b = kmers(wa), kmers(wb)
    need = int(np.ceil(least / (1 + least) * (len(a) + len(b)) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[i], cb[j]).sum() < need:  # more than an alignment can have in common
        return False
    n = min(len(a), len(b))
    head = int(np.argmin(np.r_[a[:n] == b[:n], False]))
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    tail = int(np.argmin(np.r_[a[::-1][:n] == b[::-1][:n], False]))
    if head + tail >= need:
        return True
    return head + tail + common_in_band(a[:len(a) - tail], b[:len(b) - tail], need - head - tail) >= need


def aligned(content: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose alignment reaches the threshold; content: (id, w)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            fa, fb = (t[c].flatten().to_numpy(zero_copy_only=False) for c in ("wa", "wb"))
            ea, eb = (np.r_[0, np.cumsum(t[c].value_lengths().to_numpy(zero_copy_only=False))] for c in ("wa", "wb"))
            for i in range(t.num_rows):
                ok.append(near(fa[ea[i]:ea[i + 1]], fb[eb[i]:eb[i + 1]]))
            yield pa.RecordBatch.from_arrays([t["a"].filter(pa.array(ok, pa.bool_())), t["b"].filter(pa.array(ok, pa.bool_()))], names=["a", "b"])
    j = (pairs.join(content.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
         .join(content.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a"))
    na, nb = F.greatest(F.size("wa") - (KMER - 1), F.lit(1)), F.greatest(F.size("wb") - (KMER - 1), F.lit(1))
    return j.filter(F.least(na, nb) >= SIMILARITY * F.greatest(na, nb)).select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint")


def traits(content: DataFrame) -> DataFrame:
    """(id, n, x0 .. ): the number of labelled k-mers and a bitmap of them; two texts' bitmaps differ in no more bits than their k-mers do.

    A bit is set if an odd number of k-mers fall on it, so what two texts have in common hides no difference between them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            flat, ends = t["w"].flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(t["w"].value_lengths().to_numpy(zero_copy_only=False))]
            maps, n = np.zeros((t.num_rows, MAP_WORDS * 64), bool), []
            for i in range(t.num_rows):
                lab = labelled(kmers(flat[ends[i]:ends[i + 1]]))
                maps[i] = np.bincount((lab % np.uint64(MAP_WORDS * 64)).astype(int), minlength=MAP_WORDS * 64) % 2
                n.append(len(lab))
            x = np.packbits(maps, axis=1).view(np.int64).reshape(t.num_rows, MAP_WORDS)
            yield pa.RecordBatch.from_arrays([t["id"], pa.array(n, pa.int32()), *[pa.array(x[:, k]) for k in range(MAP_WORDS)]], names=["id", "n", *[f"x{k}" for k in range(MAP_WORDS)]])
    return content.select("id", "w").mapInArrow(run, "id bigint, n int, " + ", ".join(f"x{k} bigint" for k in range(MAP_WORDS)))


def may_link(a: str, b: str) -> Column:
    """Whether sizes and bitmaps leave room for the similarity."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}x{k}").bitwiseXOR(F.col(f"{b}x{k}"))) for k in range(1, MAP_WORDS)), F.bit_count(F.col(f"{a}x0").bitwiseXOR(F.col(f"{b}x0"))))
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * (na + nb) - 1e-9)
    return (F.least(na, nb) >= need) & (apart <= na + nb - 2 * need)


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (id, text, first: smallest doc_id) and the classes (id, class_id, keeper) of those that are not alone.

    class_id is the class's smallest doc_id, keeper the id of the text that stays.
    """
    texts = cut_lineage(docs.filter("text is not null").groupBy("text").agg(F.min("doc_id").alias("first"))
                        .withColumn("id", F.monotonically_increasing_id()), "texts")
    sk = cut_lineage(sketches(texts.select("id", word_hashes(F.col("text")).alias("w"))), "sketches")
    members = sk.select(F.explode("buckets").alias("bucket"), "id")

    def prepare(ids: DataFrame):
        content = cut_lineage(texts.join(small(ids), "id", "left_semi").select("id", word_hashes(F.col("text")).alias("w")), "mates-words")
        t = cut_lineage(traits(content), "mates-traits")
        return t, None, may_link, lambda pairs: aligned(content, pairs)

    roots = linked_classes(members, prepare)
    of = roots.join(texts.select("id", "first"), "id")
    keep = of.groupBy("root").agg(F.min("first").alias("class_id"), F.min_by("id", F.struct(F.col("first").isNull(), "first", "id")).alias("keeper"))
    return texts, cut_lineage(roots.join(keep, "root").select("id", "class_id", "keeper"), "text-classes")


def document_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, class_id, stays) of every document; key hashes the text, stays is false for all but the first document of a class."""
    texts, classes = text_classes(docs)
    key = F.md5(F.col("text").cast("binary"))
    known = (texts.join(small(classes), "id", "left")
             .select(key.alias("key"), "first", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("keeper", "id") == F.col("id")).alias("keeps")))
    d = docs.select("doc_id", key.alias("key"))
    whole = d.filter("key is not null").join(known, "key")
    return (whole.select("doc_id", "key", "class_id", (F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("first"))).alias("stays"))
            .unionByName(d.filter("key is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(True).alias("stays"))))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, and all with a null text."""
    of, key, rows = unused(docs, "stays_id", "stays_key", "stays_rows")
    c = cut_lineage(document_classes(docs.select("doc_id", "text")).filter("stays and key is not null")
                    .groupBy("doc_id", "key").agg(F.count("*").alias(rows)).select(F.col("doc_id").alias(of), F.col("key").alias(key), rows), "stay")
    cols = [F.col(f"`{x}`") for x in docs.columns]
    on = F.col("doc_id").eqNullSafe(F.col(of)) & (F.md5(F.col("text").cast("binary")) == F.col(key))
    once, repeated = cut_lineage(c.filter(F.col(rows) == 1), "stay-once"), cut_lineage(c.filter(F.col(rows) > 1), "stay-repeated")
    kept = docs.join(small(once), on, "left_semi").union(docs.filter("text is null"))
    more = docs.join(small(repeated), on)
    return kept.select(*cols).union(more.dropDuplicates([of, key]).select(*cols))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "stays")
