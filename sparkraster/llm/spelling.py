"""Spelling variants: words one edit apart, found with an index of variable-length grams; rare words point to a far more frequent neighbour.

The gram dictionary holds every gram of two and more letters that over ``LIST`` words' positions have, with its count; the limit is doubled until
at most ``GRAMS`` grams are left, so that the dictionary is bounded. From each position of a word (padded by two marks on either side) the shortest gram that is
not in the dictionary is taken, ``q`` letters at most, and grams that lie inside the one before are left out. A gram changes only
by an edit from ``q - 1`` letters before its end up to its end; the most grams that one edit changes are the word's bound. One more than
that of its grams, the rarest ones, are listed in the index, so two words one edit apart meet in a list (a prefix filter of the list merge). Lists are kept by
position, since a position moves by none or one. Candidates are verified by edit distance.

Words of length L and L + 1 are compared in class L with q = (L + 4) / 2 at most: padded words are then at least 2q long, so that
one edit can't change the first and the last gram both, and the bound always leaves a gram. Lists of over ``CROWD`` words are split: if the
shared gram is unharmed, one edit leaves all that stands on its other side the same, so a word is listed under what is left and what is right of it.

Defined cases: a null text has no words; where doc_id is null no run is changed. Repeated rows count again. Empty tables give empty results. Only doc_id
and text are read, whatever other columns there are.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.classes import small
from sparkraster.llm.common import table
from sparkraster.session import cut_lineage

NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TIMES, CHANGED = 6, 5, 5, 199
SHORTEST_GRAM, LONGEST_GRAM, LIST, GRAMS, CROWD = 2, 8, 64, 300_000, 1000
BEFORE, AFTER = "\x01\x01", "\x02\x02"


def gram_limit(length: int) -> int:
    """Longest gram in the class of words of ``length`` and ``length`` + 1."""
    return min(LONGEST_GRAM, (length + 4) // 2)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences; some runs lose a letter, by a hash of doc_id and run."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.split(low, NOT_LETTERS)).alias("run")).filter(F.length("run") >= LEAST_LENGTH)
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("run")).cast("binary"))
    runs = runs.select("run", F.when(F.col("doc_id").isNotNull(), h).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.pmod("h", F.lit(CHANGED)) == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT))


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Grams that many positions have, with their number of positions; at most ``GRAMS``."""
    padded = words.select(F.concat(F.lit(BEFORE), "word", F.lit(AFTER)).alias("p"))
    at = padded.select("p", F.explode(F.sequence(F.lit(1), F.length("p") - 1)).alias("i"))
    tails = at.select(F.substring("p", F.col("i"), F.lit(LONGEST_GRAM - 1)).alias("t"))
    grams = tails.select("t", F.explode(F.sequence(F.lit(SHORTEST_GRAM), F.length("t"))).alias("q")).select(F.substring("t", F.lit(1), F.col("q")).alias("gram"))
    counts = cut_lineage(grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > LIST), "grams")
    limit = LIST
    while counts.filter(F.col("n") > limit).count() > GRAMS:
        limit *= 2
    return {r["gram"]: r["n"] for r in counts.filter(F.col("n") > limit).collect()}


def decompose(padded: str, common: dict[str, int], q: int) -> list[tuple[int, str]]:
    """Start and text of a padded word's grams of at most ``q`` letters."""
    out, reach, n = [], 0, len(padded)
    for i in range(n - SHORTEST_GRAM + 1):
        top = min(n, i + q)
        end = i + SHORTEST_GRAM
        while end < top and padded[i:end] in common:
            end += 1
        if end > reach:
            out.append((i, padded[i:end]))
            reach = end
    return out


def changed_at_most(grams: list[tuple[int, str]], q: int) -> int:
    """The most grams that a single edit can change."""
    ends = [i + len(g) for i, g in grams]
    most = first = 0
    for last, end in enumerate(ends):
        while ends[first] <= end - q:
            first += 1
        most = max(most, last - first + 1)
    return most


def listed(word: str, common: dict[str, int], q: int) -> list[tuple[int, str]]:
    """The grams under which a word is indexed."""
    grams = decompose(BEFORE + word + AFTER, common, q)
    return sorted(grams, key=lambda g: (common.get(g[1], 0), g[1], g[0]))[:changed_at_most(grams, q) + 1]


def index_entries(words: DataFrame, common: dict[str, int]) -> DataFrame:
    """(cls, gram, at, word, kind): kind 0 words of the class's length; longer ones at their gram's position (1) and the one before (2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, gram, at, word, kind = [], [], [], [], []
            for w in b["word"].to_pylist():
                n, by_q = len(w), {}
                for c in (n, n - 1):
                    if c < LEAST_LENGTH:
                        continue
                    q = gram_limit(c)
                    if q not in by_q:
                        by_q[q] = listed(w, common, q)
                    for i, g in by_q[q]:
                        for k in ((0,) if c == n else (1, 2)):
                            cls.append(c), gram.append(g), at.append(i - (k == 2)), word.append(w), kind.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), pa.array(gram, pa.string()), pa.array(at, pa.int32()), pa.array(word, pa.string()), pa.array(kind, pa.int32())],
                                             names=["cls", "gram", "at", "word", "kind"])
    return words.select("word").mapInArrow(run, "cls int, gram string, at int, word string, kind int")


def split_crowds(entries: DataFrame) -> DataFrame:
    """``entries`` with a key; those of long lists under two keys, what is left and what is right of the gram."""
    keys = ["cls", "gram", "at"]
    hot = small(cut_lineage(entries.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(*keys, F.lit(True).alias("hot")), "gram-crowds"))
    e = entries.join(hot, keys, "left")
    start = F.col("at") - (len(BEFORE) - 1) + F.when(F.col("kind") == 2, 1).otherwise(0)  # of the gram in the word itself, from 1
    left = F.substring("word", F.lit(1), F.greatest(start - 1, F.lit(0)))
    right = F.substring("word", F.greatest(start + F.length("gram"), F.lit(1)), F.length("word"))
    sides = (F.when(F.col("hot").isNull(), F.array(F.lit("")))
             .when(F.col("kind") == 1, F.array(F.concat(F.lit("<"), left))).when(F.col("kind") == 2, F.array(F.concat(F.lit(">"), right)))
             .otherwise(F.array(F.concat(F.lit("<"), left), F.concat(F.lit(">"), right))))
    return e.select(*keys, "word", "kind", F.explode(sides).alias("side")).select(F.xxhash64(*keys, "side").alias("key"), "word", "kind")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of all words one edit apart, each pair once."""
    entries = cut_lineage(index_entries(words, gram_dictionary(words)), "gram-index")
    keyed = split_crowds(entries)
    a = keyed.filter("kind = 0").select("key", F.col("word").alias("a"))
    b = keyed.select("key", F.col("word").alias("b"), F.col("kind"))
    return (a.join(b, "key").filter((F.col("kind") > 0) | (F.col("a") < F.col("b"))).filter(F.levenshtein("a", "b", 1) == 1)
            .select("a", "b").distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last; counts grow five-fold each step, so few doublings reach the end."""
    cur = forms.select("word", F.col("form").alias("root"))
    while True:
        up = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        cur = cut_lineage(cur.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        if cur.filter("moved").isEmpty():
            return cur.select("word", "root")
        cur = cur.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut_lineage(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    pairs = cut_lineage(near_pairs(words), "near-words")
    near = pairs.union(pairs.select("b", "a")).toDF("word", "other").join(words.withColumnsRenamed({"word": "other", "n": "m"}), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    w = words.join(best, "word", "left")
    far = -F.col("best.m") >= TIMES * F.col("n")
    w = cut_lineage(w.select("word", F.when(far, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.m")).alias("form_n")), "forms")
    r = roots(w.filter("form is not null").select("word", "form"))
    return w.join(r, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
