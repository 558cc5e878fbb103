"""A toxicity classifier that is trained not to react to which group a sentence names.

Features are hashes of the distinct words of a text and of their first letters (``PREFIXES``). A logistic model is fitted to a
bounded sample of labelled texts. For a sampled text that names a group, copies are made in which every group term is
swapped for another of its set; the squared change of the score between a text and its copies is added to the loss with weight
``fairness``. Scoring runs over whole texts in Spark tasks; the model is a few thousand numbers.

Nulls: a null or empty text has no features and scores the intercept; a null doc_id counts as an empty string for the split.
Labels that are null or repeated: nulls are left out, the largest of a doc_id counts. Without positive or without negative
labels the model has no weights and scores the share of positives (0 if there are no labels). An empty table gives an empty result. Other
columns of the documents are kept by ``score``; only the one it is told to add is replaced.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.common import table

SAMPLE_PER_LABEL, PREFIXES, FAIRNESS, THRESHOLD = 3000, (4, 6), 1.0, 0.7

#: Sets of terms that name groups; a term is swapped within its set.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrant", "immigrants", "refugee", "refugees", "native", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def features(toks: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(
        toks, lambda t: F.array(F.xxhash64(t), *[F.xxhash64(F.substring(t, 1, n), F.lit(n)) for n in PREFIXES]))))


def swapped(toks: Column, step: int) -> Column:
    to = {t: g[(i + step) % len(g)] for g in IDENTITY_TERMS for i, t in enumerate(g)}
    table_ = F.create_map(*[F.lit(x) for kv in to.items() for x in kv])
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(table_, t), t))


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    intercept: float


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, per_label: int) -> tuple[list, dict]:
    """At most about ``per_label`` rows of each label, by a hash of doc_id, and how many labelled rows there are of each."""
    lab = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(allowed)
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = {int(r[0]): r[1] for r in lab.groupBy("toxic").count().collect() if r[0] in (0, 1)}
    parts = 1 << 30
    cut = F.element_at(F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(parts, int(parts * per_label / max(1, n.get(k, 0)))))]), F.col("toxic"))
    picked = lab.filter(F.col("toxic").isin(0, 1)).filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts)) < cut)
    toks = docs.select("doc_id", F.col("text")).join(F.broadcast(picked), "doc_id").select("toxic", tokens(F.col("text")).alias("t"))
    terms = [t for g in IDENTITY_TERMS for t in g]
    named = F.arrays_overlap("t", F.array(*[F.lit(x) for x in terms]))
    rows = toks.select("toxic", features(F.col("t")).alias("f"), *[F.when(named, features(swapped(F.col("t"), s))).alias(f"s{s}") for s in (1, 2)])
    return rows.toArrow(), n


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_label: int = SAMPLE_PER_LABEL, fairness: float = FAIRNESS,
        l2: float = 2e-3, rounds: int = 600) -> Model:
    t, n = training_rows(docs, labels, allowed, per_label)
    total = sum(n.values())
    y = np.array(t["toxic"].to_pylist(), dtype=float)
    if not total or not 0 < y.sum() < len(y):
        p = n.get(1, 0) / total if total else 0.0
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        c = t[name].combine_chunks()
        lens = np.array([0 if x is None else x for x in pa.compute.list_value_length(c).to_pylist()])
        return np.repeat(np.arange(len(lens)), lens), c.flatten().to_numpy(zero_copy_only=False)

    rows, feats = flat("f")
    vocab, cols = np.unique(feats, return_inverse=True)
    df, pos = np.bincount(cols), np.bincount(cols, weights=y[rows])
    p0 = y.mean()
    z = (pos - df * p0) / np.sqrt(df * p0 * (1 - p0))
    keep = (df >= 3) & (np.abs(z) >= 4)
    variants = [flat(f"s{s}") for s in (1, 2)]
    for r, f in variants:  # what a swap adds or takes away must be in the model for its change to be seen
        if len(f):
            own = np.isin(rows, np.unique(r))
            changed = np.setxor1d(np.unique(f), np.unique(feats[own]))
            keep |= np.isin(vocab, changed) & (df >= 3)
    vocab, new = vocab[keep], np.cumsum(keep) - 1
    at = keep[cols]
    rows, cols = rows[at], new[cols[at]]
    m = len(vocab)
    diffs = []
    for r, f in variants:
        i = np.minimum(np.searchsorted(vocab, f), max(m - 1, 0))
        ok = vocab[i] == f if m else np.zeros(0, bool)
        named = np.isin(rows, np.unique(r))
        diffs.append((np.concatenate([rows[named], r[ok]]), np.concatenate([cols[named], i[ok]]), np.concatenate([np.ones(named.sum()), -np.ones(ok.sum())])))
    w, b, gw, gb, n_rows = np.zeros(m), float(np.log(p0 / (1 - p0))), np.full(m, 1e-8), 1e-8, len(y)
    for _ in range(rounds):  # full-batch AdaGrad
        s = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=n_rows) + b, -30, 30)))
        e = (s - y) / n_rows
        g = np.bincount(cols, weights=e[rows], minlength=m) + l2 * w / n_rows
        for dr, dc, sign in diffs:
            d = np.bincount(dr, weights=sign * w[dc], minlength=n_rows)
            g += 2 * fairness / n_rows * np.bincount(dc, weights=sign * d[dr], minlength=m)
        gw, gb = gw + g * g, gb + e.sum() ** 2
        w, b = w - 0.3 * g / np.sqrt(gw), b - 0.3 * e.sum() / np.sqrt(gb)
    prior = (n.get(1, 0) / max(1, n.get(0, 0))) / (p0 / (1 - p0))  # the sample holds labels in other shares than all labelled rows
    big = np.abs(w) > 1e-3
    return Model(vocab[big], w[big], b + float(np.log(prior)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds ``name``, the probability of label 1 of the whole text."""
    vocab, weights, b = model.vocabulary, model.weights, model.intercept
    mask = np.zeros(1 << 16, bool)
    mask[vocab & 0xFFFF] = True

    def value(f: pa.Array) -> pa.Array:
        lens = pa.compute.list_value_length(f).fill_null(0).to_numpy(zero_copy_only=False)
        h = f.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lens)), lens)
        may = mask[h & 0xFFFF]
        h, rows = h[may], rows[may]
        z = np.full(len(lens), b)
        if len(vocab):
            i = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            hit = vocab[i] == h
            z += np.bincount(rows[hit], weights=weights[i[hit]], minlength=len(lens))
        return pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())

    value.__annotations__ = {"f": pa.Array, "return": pa.Array}
    return docs.withColumn(name, F.arrow_udf(value, "double")(features(tokens(F.col("text")))))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~is_held_out(F.col("doc_id")))
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")))
