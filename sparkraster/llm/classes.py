"""Classes of linked rows: candidates from shared buckets, a given exact check, and distributed union-find.

Nothing here lists all pairs of a bucket. A bucket's members are held against one representative first; what that
links falls into one class. Members of other classes become pivots, 8, 64, 512, ... a round, and are held against
every member of another class with which a link is possible, until each two members of a bucket are either in one class or
compared. So no link between bucket mates is lost, and a bucket of near copies costs about as many checks as it has members.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkraster.session import cut_lineage, drop_written


BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, marked for broadcast if it has no more than ``BROADCAST_ROWS`` of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the smallest id of its connected component.

    Each round every node hooks onto its smallest smaller neighbour, pointers are doubled until they reach the
    roots, and links are contracted to roots. Rounds and doublings are logarithmic; all state is in tables.
    Null ids, self links and repeated links are ignored; no links give no rows.
    """
    e = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    out = None
    while not e.isEmpty():
        hook = cut_lineage(e.groupBy("v").agg(F.min("u").alias("p")), "hooks")
        while True:
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("g"))
            step = cut_lineage(hook.select("v", "p").join(up, "p", "left").select("v", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")), "hooks")
            drop_written(hook)
            hook = step
            if hook.filter("moved").isEmpty():
                break
        if out is None:
            grown = cut_lineage(hook.select("v", "p"), "roots")
        else:
            nxt = hook.select(F.col("v").alias("p"), F.col("p").alias("g"))
            grown = cut_lineage(out.join(nxt, "p", "left").select("v", F.coalesce("g", "p").alias("p")).union(hook.select("v", "p")), "roots")
        hv, hu = hook.select("v", F.col("p").alias("rv")), hook.select(F.col("v").alias("u"), F.col("p").alias("ru"))
        left = (e.join(hv, "v", "left").join(hu, "u", "left")
                .select(F.coalesce("rv", "v").alias("x"), F.coalesce("ru", "u").alias("y")).filter("x <> y")
                .select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).distinct())
        left = cut_lineage(left, "links")
        drop_written(e, hook, out)
        e, out = left, grown
    if out is None:
        return e.select(F.col("v").alias("id"), F.col("u").alias("root"))
    roots = out.select(F.col("p").alias("id"), F.col("p").alias("root")).distinct()
    done = cut_lineage(out.select(F.col("v").alias("id"), F.col("p").alias("root")).union(roots).distinct(), "roots")
    drop_written(e, out)
    return done


def frequent(live: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, degree): how many ids share each of an id's marks, in all."""
    marks = marks.join(live.filter("mates > 4").select("id").distinct(), "id", "left_semi")
    return marks.join(marks.groupBy("mark").agg(F.count("*").alias("n")), "mark").groupBy("id").agg(F.sum("n").alias("degree"))


def central(crowd: DataFrame, traits: DataFrame) -> DataFrame:
    """(bucket, id, degree): the fewer bits an id's bitmap differs in from the bits that most of its bucket's ids have, the higher, always above 0.

    Counts of bits are summed before they meet, so the work is one row for each member and word of the bitmap.
    """
    maps = [c for c in traits.columns if c[0] == "x" and c[1:].isdigit()]
    rows = crowd.join(traits.select("id", *maps), "id").select("bucket", "id", F.posexplode(F.array(*maps)).alias("k", "x"))
    rows = cut_lineage(rows, "bitmap-words")
    votes = rows.groupBy("bucket", "k").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"int(getbit(x, {i}))")).alias(f"b{i}") for i in range(64)])
    bits = [F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    most = bits[0]
    for x in bits[1:]:
        most = most.bitwiseOR(x)
    most = cut_lineage(votes.select("bucket", "k", most.alias("most")), "bucket-majorities")
    return (rows.join(small(most), ["bucket", "k"]).groupBy("bucket", "id").agg((F.lit(64 * len(maps) + 1) - F.sum(F.bit_count(F.col("x").bitwiseXOR(F.col("most"))))).alias("degree")))


def linked_classes(members: DataFrame, prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame, Callable[[str, str], Column], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(id, root) of all ids that some verified link joins to another id.

    ``members``: (bucket, id), bigint both, one row for each bucket an id is in. ``prepare`` takes the ids (id) that have bucket mates at all and
    returns their traits (id and narrow columns), their marks (id, mark) or None, a condition on the traits of two ids, given the prefixes of their columns,
    that holds for every link and is cheap, and the check, which takes distinct pairs (a, b) and returns those that are links.
    The representative of a bucket is the member whose bitmap (columns x0, x1 .. of the traits) is nearest to the bits that most members have, in a
    group of near copies the one nearest to all; without bitmaps the one with the most frequent marks. Which one it is decides how many checks are
    made, not what they find.
    """
    seen = cut_lineage(members.groupBy("bucket").agg(F.count("*").alias("mates")).filter("mates > 1"), "buckets")
    first = cut_lineage(members.join(small(seen), "bucket").select("bucket", "id", "mates").distinct(), "members")
    drop_written(seen)
    live = first
    traits, marks, may, verify = prepare(cut_lineage(live.select("id").distinct(), "mates"))
    degree = cut_lineage(frequent(live, marks) if marks is not None else central(live.filter("mates > 4"), traits), "degrees")
    reps = (live.join(small(degree), [c for c in degree.columns if c != "degree"], "left").groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("id")).alias("i"))).alias("m"))
            .select("bucket", (-F.col("m.i")).alias("rep")))
    live = cut_lineage(live.drop("mates").join(reps, "bucket").withColumn("done", F.lit(False)), "members")
    drop_written(first, degree)
    named = traits.columns[1:]
    side = {s: traits.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in named]) for s in "ab"}
    pairs = live.filter("id <> rep").select(F.least("rep", "id").alias("a"), F.greatest("rep", "id").alias("b")).distinct()
    pairs = pairs.join(side["b"], "b").join(side["a"], "a").filter(may("a_", "b_")).select("a", "b")
    links = cut_lineage(verify(pairs).select("a", "b"), "verified")
    roots = components(links)
    pivots, written = 8, live
    while True:
        of = small(roots)
        live = (live.drop("root").join(of.select("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
                .join(of.select(F.col("id").alias("rep"), F.col("root").alias("main")), "rep", "left").withColumn("main", F.coalesce("main", "rep")))
        todo = live.filter("root <> main and not done").groupBy("bucket").agg(F.count("*").alias("others"))
        live = cut_lineage(live.join(todo, "bucket").withColumn(
            "pivot", F.expr(f"root <> main and not done and pmod(xxhash64(id, bucket, {pivots}), cast(ceil(others / {pivots}) as bigint)) = 0"))
            .drop("main", "others"), "members")
        drop_written(written)
        written = live
        if live.isEmpty():
            drop_written(written)
            return roots
        full = live.join(traits, "id")
        p = full.filter("pivot").select("bucket", F.col("id").alias("a"), F.col("root").alias("ra"), *[F.col(c).alias(f"a_{c}") for c in named])
        q = full.filter("not done and id <> rep").select(F.col("bucket").alias("at"), "id", "root", "pivot", *[F.col(c).alias(f"b_{c}") for c in named])
        pairs = (q.join(p, (F.col("at") == F.col("bucket")) & F.expr("root <> ra and (not pivot or id > a)") & may("a_", "b_"))
                 .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct())
        new = cut_lineage(verify(pairs).select("a", "b"), "verified")
        live = live.withColumn("done", F.expr("done or pivot")).drop("pivot")
        if new.isEmpty():
            drop_written(new)
        else:
            links = links.union(new)
            old, roots = roots, components(links)
            drop_written(old)
        pivots *= 8
