"""Line dedup, near-duplicate documents and class resolution against plain Python versions."""
import random

import numpy as np
from pyspark.sql import functions as F

from sparkraster.llm import line_dedup, near_dedup
from sparkraster.llm.classes import components, linked_classes

DOCS = "doc_id bigint, text string, source string, `rows` int, item int"


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "zzz"
    return " ".join(w)


def test_components_of_paths_stars_and_none(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(50, i) for i in range(51, 90)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    df = spark.createDataFrame(links + links[:3] + [(7, 7)], "a bigint, b bigint")
    want = groups(160, links)
    got = {r["id"]: r["root"] for r in components(df).collect()}
    assert got == {x: want[x] for ab in links if ab[0] != ab[1] for x in ab}
    assert components(df.filter("false")).count() == 0


def test_bucket_mates_lose_no_link(spark):
    """One bucket: three groups that are linked inside only, and one late link between two of them."""
    n = 90
    true = {(a, b) for a in range(n) for b in range(a + 1, n) if a % 3 == b % 3 and b - a < 12} | {(60, 61)}
    members = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 5)], "bucket bigint, id bigint")
    yes = spark.createDataFrame(sorted(true), "a bigint, b bigint").cache()
    seen = []

    def prepare(ids):
        assert ids.count() == n

        def verify(pairs):
            seen.append(pairs.count())
            return pairs.join(yes, ["a", "b"], "left_semi")
        return ids.withColumn("n", F.lit(1)), ids.withColumn("mark", F.lit(5).cast("long")), lambda a, b: F.col(f"{a}n") == F.col(f"{b}n"), verify
    got = {r["id"]: r["root"] for r in linked_classes(members, prepare).collect()}
    assert got == dict(enumerate(groups(n, true)))
    assert sum(seen) <= n * (n - 1) / 2


def line_truth(docs):
    lines = {}
    for doc_id, text, *_ in docs:
        for no, line in enumerate((text or "").split("\n")):
            if line.strip():
                lines.setdefault(line.strip(), []).append((doc_id is None, doc_id, no))
    keys = list(lines)
    s = [{x[i:i + 8] for i in range(len(x) - 7)} for x in keys]
    links = [(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    of = groups(len(keys), links)
    first = {}
    for i, k in enumerate(keys):
        first[of[i]] = min([*lines[k], *([first[of[i]]] if of[i] in first else [])])
    return {(d, no, first[of[i]][1:]) for i, k in enumerate(keys) for _, d, no in lines[k]}


def test_line_classes(spark):
    rng = random.Random(2)
    base = [sentence(rng, 40) for _ in range(12)]
    docs = [(i, "\n".join([rng.choice(base), "  ", changed(rng, rng.choice(base), 1), "short", sentence(rng, 30) + " "]), "s", 1, 2) for i in range(1, 25)]
    docs += [(None, base[0], None, None, None), (30, None, "s", 1, 2), (31, "", "s", 1, 2), (32, "abc", "s", 1, 2), (33, "é" * 3000 + "\n" + "é" * 3000, "s", 1, 2)]
    df = spark.createDataFrame(docs, DOCS)
    got = line_dedup.line_classes(df).selectExpr("doc_id", "line_no", "cast((class_at - pmod(class_at, 1000000000)) / 1000000000 as bigint) d", "cast(pmod(class_at, 1000000000) as int) n", "kept").collect()
    assert {(r[0], r[1], (r[2], r[3])) for r in got} == line_truth(docs)
    assert all(r["kept"] == ((r[0], r[1]) == (r[2], r[3])) for r in got)


def test_short_lines_just_at_the_threshold_are_linked(spark):
    """A line of n shingles and itself with n / 4 more characters: Jaccard 0.8 in 15 to 40 characters."""
    rng = random.Random(7)
    docs = []
    for i in range(5000):
        n = (8, 12, 16, 20, 24)[i % 5]
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n + 7 + n // 4))
        docs.append((i, f"{line}\n{line[:n + 7]}", "s", 1, 2))
    got = line_dedup.line_classes(spark.createDataFrame(docs, DOCS)).groupBy("doc_id").agg(F.countDistinct("class_at").alias("n")).filter("n = 1").count()
    assert got >= 4980


def test_line_dedup_rewrites_documents(spark):
    docs = [(1, "alpha beta gamma\nsame line here\n\nlast", "s", 5, 6), (2, "same line here\nown line", "s", 5, 6), (3, "same line here", "s", 5, 6), (4, None, None, None, None),
            (5, "", "s", 5, 6), (2, "same line here\nown line", "s", 5, 6), (None, "same line here\nother words", "s", 5, 6)]
    out = line_dedup.deduplicate(spark.createDataFrame(docs, DOCS))
    assert out.columns == ["doc_id", "text", "source", "rows", "item"]
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "alpha beta gamma\nsame line here\n\nlast"), (2, "own line"), (2, "own line"), (4, None), (5, ""), (None, "other words")], key=str)
    assert line_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def plain_similarity(a, b):
    """Longest common subsequence of the k-mers, by the textbook table."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1] / max(1, len(a) + len(b) - t[-1, -1])


def test_banded_alignment_is_the_full_alignment_at_the_threshold():
    rng = np.random.default_rng(3)
    seen = set()
    for _ in range(300):
        a = rng.integers(0, rng.choice([5, 50, 10**9]), rng.integers(1, 60))
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 3))) if len(a) > 3 else a.copy()
        for _ in range(rng.integers(0, 3)):
            b = np.insert(b, rng.integers(0, len(b) + 1), 7) if len(b) else b
        if not len(b):
            continue
        want = plain_similarity(near_dedup.kmers(a).tolist(), near_dedup.kmers(b).tolist()) >= 0.8 - 1e-12
        assert near_dedup.near(a, b) == want
        seen.add(bool(want))
    assert seen == {True, False}


def test_sketch_minds_order_and_repeats():
    w = np.arange(400) * 7919
    assert (near_dedup.sketch(w) == near_dedup.sketch(w.copy())).all()
    assert (near_dedup.sketch(w) == near_dedup.sketch(np.r_[w[200:], w[:200]])).mean() < 0.8
    assert len(near_dedup.sketch(np.array([5]))) == near_dedup.SKETCHES


def test_document_classes(spark):
    rng = random.Random(4)
    base = [sentence(rng, 120) for _ in range(6)]
    docs = [(i, changed(rng, base[i % 6], rng.choice([0, 0, 1, 2])), "s", 1, 2) for i in range(60)]
    docs += [(100, sentence(rng, 100), "s", 1, 2), (101, "two words", "s", 1, 2), (102, "two words", "s", 1, 2), (103, "", "s", 1, 2), (104, "", None, 1, 2), (105, None, "s", 1, 2), (106, None, "s", 1, 2),
             (None, base[0], "s", 1, 2), (100, "another text under a used id", "s", 1, 2), (107, "x " * 20000, "s", 1, 2), (101, "two words", "s", 1, 2)]
    df = spark.createDataFrame(docs, DOCS)
    texts = sorted({d[1] for d in docs if d[1] is not None})
    k = [near_dedup.kmers(np.array([hash(w) & 0x7FFFFFFF for w in t.split()])).tolist() if t.split() else [] for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if k[a] and k[b] and min(len(k[a]), len(k[b])) >= 0.8 * max(len(k[a]), len(k[b])) and plain_similarity(k[a], k[b]) >= 0.8]
    of = dict(zip(texts, groups(len(texts), links)))
    first = {}
    for d, t, *_ in docs:
        if t is not None and d is not None:
            first[of[t]] = min(d, first.get(of[t], d))
    got = near_dedup.document_classes(df).collect()
    assert len(got) == len(docs)
    want = sorted(((d, d if t is None else first[of[t]]) for d, t, *_ in docs), key=str)
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == want
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns
    kept = out.collect()
    assert sorted(of[r["text"]] for r in kept if r["text"] is not None) == sorted(set(of.values()))  # one of each class
    assert sum(r["text"] is None for r in kept) == 2
    assert all(r["doc_id"] == first[of[r["text"]]] for r in kept if r["text"] is not None)
    assert near_dedup.deduplicate(df.filter("false")).count() == 0


def test_bitmaps_tell_near_copies_apart_and_keep_every_link(spark):
    """Copies of one text, each with changes of its own: pairs under the threshold are told apart though they share most words."""
    rng = random.Random(11)
    base = [rng.randrange(1 << 60) for _ in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(150), i % 6):
            w[at] = rng.randrange(1 << 60)
        texts.append((i, w + w[:7] * (i % 2)))
    content = spark.createDataFrame(texts, "id bigint, w array<bigint>")
    t = near_dedup.traits(content).cache()
    a, b = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for s in "ab")
    may = {(r[0], r[1]) for r in a.join(b, (F.col("a_id") < F.col("b_id")) & near_dedup.may_link("a_", "b_")).select("a_id", "b_id").collect()}
    w = [np.array(x) for _, x in texts]
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if near_dedup.near(w[i], w[j])}
    assert 0 < len(links) < 60 * 59 / 4
    assert links <= may
    assert len(may - links) <= 60


def test_line_bitmaps_tell_near_copies_apart_and_keep_every_link(spark):
    """Long lines that share most of a text: pairs under the threshold are told apart, all links stay possible."""
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1200))
    lines = []
    for i in range(40):
        x = list(base)
        for at in rng.sample(range(1200), 5 * (i % 6)):
            x[at] = "#"
        lines.append((i, "".join(x)))
    t = line_dedup.traits(spark.createDataFrame(lines, "id bigint, line string")).cache()
    a, b = (t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns]) for s in "ab")
    may = {(r[0], r[1]) for r in a.join(b, (F.col("a_id") < F.col("b_id")) & line_dedup.may_link("a_", "b_")).select("a_id", "b_id").collect()}
    s = [{x[i:i + 8] for i in range(len(x) - 7)} for _, x in lines]
    links = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    assert links <= may
    assert 0 < len(links) and len(may) <= 1.25 * len(links)
