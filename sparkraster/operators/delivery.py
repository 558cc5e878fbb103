"""Package checksums, verification, split plans and archive admission."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name of the checksum list, smallest part, member limit and free space kept back.
SUMS = "SHA256SUMS"
MIN_PART_MB = 50
MAX_MEMBERS = 200_000
MIN_FREE_BYTES = 512 << 20


def checksums(files: DataFrame) -> DataFrame:
    """Files (package, path, content) -> digest and list line; the list itself is left out."""
    return (files.filter(~F.col("path").rlike(f"(^|/){SUMS}$"))
            .select("package", "path", F.sha2("content", 256).alias("sha256"))
            .withColumn("line", F.concat("sha256", F.lit("  "), "path")))


def write_checksums(sums: DataFrame, out: str) -> None:
    """Lists sorted by path, one folder per package; range partitions keep the order without one big task."""
    (sums.repartitionByRange("package", "path").sortWithinPartitions("package", "path").select("package", "line")
     .write.mode("overwrite").partitionBy("package").text(out))


def file_checksums(parts: DataFrame) -> DataFrame:
    """(path, offset, length) -> sha256, read in pieces; for files too large for one value.

    A null length means to the end. Every row is one unit of work, so parts spread over the tasks.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, off, n in zip(pdf["path"], pdf["offset"], pdf["length"]):
                h, left = hashlib.sha256(), None if pd.isna(n) else int(n)
                with open(path, "rb") as f:
                    f.seek(int(off))
                    while left is None or left > 0:
                        piece = f.read(1 << 20 if left is None else min(1 << 20, left))
                        if not piece:
                            break
                        h.update(piece)
                        left = None if left is None else left - len(piece)
                out.append(h.hexdigest())
            yield pdf[["path", "offset", "length"]].assign(sha256=out)
    return parts.select("path", "offset", "length").mapInPandas(run, "path string, offset bigint, length bigint, sha256 string")


def verify(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """Listed files (package, path, sha256) against digests of the files present; unlisted files are ignored."""
    return (listed.join(actual.select("package", "path", F.col("sha256").alias("_got")), ["package", "path"], "left")
            .selectExpr("package", "path", "CASE WHEN _got IS NULL THEN 'missing' WHEN _got <> sha256 THEN 'checksum mismatch' ELSE 'ok' END AS state"))


def verify_summary(packages: DataFrame, checked: DataFrame) -> DataFrame:
    """package -> counts; a package without a list is reported as such."""
    n = checked.groupBy("package").agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "missing").alias("missing"),
                                       F.count_if(F.col("state") == "checksum mismatch").alias("mismatched"))
    return (packages.select("package").distinct().join(n, "package", "left")
            .selectExpr("package", "coalesce(ok, 0L) AS ok", "coalesce(missing, 0L) AS missing", "coalesce(mismatched, 0L) AS mismatched", "ok IS NULL AS list_missing"))


def split_plan(packages: DataFrame, part_bytes: str = "part_bytes") -> DataFrame:
    """(package, size, part_bytes) -> numbered parts with offset and length; the last may be short."""
    return (packages.selectExpr("*", f"greatest(1L, bigint(ceil(size / {part_bytes}))) AS n_parts")
            .selectExpr("*", "explode(sequence(1L, n_parts)) AS part")
            .selectExpr(*packages.columns, "n_parts", "part", "concat(package, '.', lpad(part, greatest(3, length(string(n_parts))), '0')) AS name",
                        f"(part - 1) * {part_bytes} AS offset", f"least({part_bytes}, size - (part - 1) * {part_bytes}) AS length"))


def part_size_error(part_mb: str) -> str:
    """SQL text: why a wanted part size is refused, or null."""
    return f"CASE WHEN try_cast({part_mb} AS INT) IS NULL THEN 'not a whole number' WHEN try_cast({part_mb} AS INT) < {MIN_PART_MB} THEN 'below {MIN_PART_MB} MB' END"


def content_part_checksums(files: DataFrame, part_bytes: int) -> DataFrame:
    """Digest of every part of in-table contents (package, content), and of the whole as part 0."""
    sized = files.withColumn("size", F.octet_length("content").cast("long")).withColumn("part_bytes", F.lit(part_bytes).cast("long"))
    parts = split_plan(sized).selectExpr("package", "part", "sha2(substring(content, int(offset) + 1, int(length)), 256) AS sha256")
    return parts.unionByName(files.selectExpr("package", "0L AS part", "sha2(content, 256) AS sha256"))


def reusable_splits(deliveries: DataFrame, present: DataFrame, wanted: DataFrame) -> DataFrame:
    """Earlier finished splits of the wanted part size whose files all still exist.

    ``deliveries`` is (delivery_id, job_id, type, status, part_mb); ``present`` is (delivery_id, file, exists).
    """
    files = present.groupBy("delivery_id").agg(F.expr("bool_and(exists) AS _all"))
    return (deliveries.filter("type = 'split' AND status = 'done'").join(wanted, ["job_id", "part_mb"]).join(files, "delivery_id").filter("_all")
            .select("job_id", "delivery_id", "part_mb"))


def drop_superseded(deliveries: DataFrame, new: DataFrame) -> DataFrame:
    """Deliveries left after a new split: other splits of that job go, unless they are running."""
    n = new.select("job_id", F.col("delivery_id").alias("_new"))
    return (deliveries.join(n, "job_id", "left")
            .filter("_new IS NULL OR delivery_id = _new OR NOT (type = 'split' AND status <> 'running')").drop("_new"))


def admit_archives(members: DataFrame, free_bytes: str = "free_bytes", max_members: int = MAX_MEMBERS, min_free: int = MIN_FREE_BYTES) -> DataFrame:
    """archive -> reason it is refused, or null; from its member list (archive, path, size, free_bytes)."""
    unsafe = "path LIKE '/%' OR array_contains(split(path, '/'), '..') OR contains(split(path, '/')[0], ':')"
    agg = members.groupBy("archive").agg(F.expr(f"bool_or({unsafe}) AS bad"), F.count("*").alias("n"), F.sum("size").alias("total"), F.max(free_bytes).alias("free"))
    return agg.selectExpr("archive", "n", "total", f"CASE WHEN bad THEN 'unsafe path' WHEN n > {max_members} THEN 'too many members' WHEN total + {min_free} > free THEN 'not enough space' END AS reason")
