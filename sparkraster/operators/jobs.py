"""Job, layer, tile and log analytics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import bucketed_lag, bucketed_row_number, top_k

# Seconds without news that count as a stall, log length, retry delays by kind of request.
STALL_S = 120
LOG_KEEP = 200
RETRY_DELAYS = {"read": (2, 5, 15, 30), "tile": (1, 3, 8, 20), "export": (5, 15)}
MODES = ("mosaic", "clipped", "original")


def flatten_chunks(chunks: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Items of all chunks with their position; chunks that failed (null) contribute nothing."""
    return chunks.select(*keys, F.posexplode(items).alias("pos", "item"))


def validate(jobs: DataFrame, layers: DataFrame, sources: DataFrame) -> DataFrame:
    """job_id -> reason of the first failure, or null.

    ``jobs`` is (job_id, mode, formats); ``layers`` is (job_id, ord, source_no, res_m). Layers are
    checked in order for an unknown source, a source seen before, and a resolution that is not positive.
    """
    first = layers.groupBy("job_id", "source_no").agg(F.min("ord").alias("_first"))
    checked = (layers.join(first, ["job_id", "source_no"]).join(sources.select("source_no", "source_id"), "source_no", "left")
               .selectExpr("job_id", "ord", "CASE WHEN source_id IS NULL THEN concat('unknown source ', source_no) WHEN ord > _first THEN concat(source_id, ' selected twice') "
                           "WHEN NOT res_m > 0 THEN concat(source_id, ': resolution not positive') END AS why"))
    bad = checked.groupBy("job_id").agg(F.expr("min_by(why, ord) FILTER (WHERE why IS NOT NULL) AS _why"))
    modes = ", ".join(f"'{m}'" for m in MODES)
    return (jobs.join(bad, "job_id", "left").join(layers.select("job_id").distinct().withColumn("_has", F.lit(True)), "job_id", "left")
            .selectExpr("job_id", f"CASE WHEN _has IS NULL THEN 'no layer' WHEN _why IS NOT NULL THEN _why WHEN mode NOT IN ({modes}) THEN 'unknown mode' "
                        "WHEN mode = 'mosaic' AND formats = 0 THEN 'no output format' END AS reason"))


def input_summary(inputs: DataFrame, key: str, label: str, most: int = 12, shown: int = 10) -> DataFrame:
    """key -> distinct sorted labels; beyond ``most`` only ``shown`` and how many more there are."""
    distinct = inputs.groupBy(key, label).agg(F.lit(1).alias("_one")).select(key, label)
    n = distinct.groupBy(key).agg(F.count("*").alias("n_labels"))
    first = top_k(distinct, [key], [F.col(label)], most).groupBy(key).agg(F.array_sort(F.collect_list(label)).alias("_l"))
    more = F.concat(F.slice("_l", 1, shown), F.array(F.format_string("… and %d more", F.col("n_labels") - shown)))
    return n.join(first, key).select(key, "n_labels", F.array_join(F.when(F.col("n_labels") <= most, F.col("_l")).otherwise(more), "; ").alias("inputs"))


def merge_tiles(tiles: DataFrame, key: str) -> DataFrame:
    """One result per layer from its tile results (key, tile, status, message, size_mb, res_m)."""
    agg = tiles.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"),
                                 F.expr("min_by(message, tile) FILTER (WHERE status = 'failed') AS failed"), F.expr("min_by(res_m, tile) FILTER (WHERE status = 'ok') AS res_m"),
                                 F.expr("sum(size_mb) FILTER (WHERE status = 'ok') AS size_mb"))
    return agg.selectExpr(key, "n", "n_ok", "CASE WHEN n_ok > 0 THEN 'ok' WHEN n_failed > 0 THEN 'failed' ELSE 'empty' END AS status",
                          "CASE WHEN n_ok > 0 THEN NULL WHEN n_failed > 0 THEN failed ELSE 'no data in area' END AS message", "res_m", "bround(round(size_mb, 6), 2) AS size_mb",
                          "if(n_ok > 0, concat(n_ok, ' of ', n, if(n = 1, ' tile', ' tiles'), ' built', if(n_ok < n, concat(', ', n - n_ok, ' failed'), '')), NULL) AS summary")


def merged_files(tiles: DataFrame, key: str) -> DataFrame:
    """Files of the good tiles under their tile folder, one row each, so a layer of any size is fine."""
    return tiles.filter("status = 'ok'").selectExpr(key, "tile", "posexplode(files) AS (pos, f)").selectExpr(key, "tile", "pos", "concat('tile_', lpad(tile, greatest(2, length(string(tile))), '0'), '/', f) AS file")


def job_status(layers: DataFrame, key: str) -> DataFrame:
    agg = layers.groupBy(key).agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return agg.selectExpr(key, "CASE WHEN n_ok > 0 AND n_failed = 0 THEN 'done' WHEN n_ok > 0 THEN 'partial' ELSE 'failed' END AS status",
                          "if(n_ok > 0, concat(n_ok, ' layer(s) ready', if(n_failed > 0, concat(', ', n_failed, ' failed'), '')), 'no layers produced') AS message")


def unconverted_summary(files: DataFrame, key: str, what: str) -> DataFrame:
    """Layer result of the modes that do not convert: files (key, size_mb, skipped)."""
    agg = files.groupBy(key).agg(F.expr("count_if(NOT skipped) AS n_files"), F.expr("count_if(skipped) AS n_skipped"), F.expr("bround(round(sum(if(skipped, 0D, size_mb)), 6), 2) AS size_mb"))
    return agg.selectExpr(key, "if(n_files > 0, 'ok', 'empty') AS status", "n_files", "n_skipped", "size_mb",
                          f"if(n_files > 0, concat(n_files, ' file(s) {what}', if(n_skipped > 0, concat(' (', n_skipped, ' input(s) had nothing inside the area)'), '')), NULL) AS summary")


def layer_order(layers: DataFrame, key: str, res: str, ord_: str) -> DataFrame:
    """Position of each good layer, coarsest first, in the given order among equals."""
    return bucketed_row_number(layers.filter("status = 'ok'"), [key], [F.col(res).desc(), F.col(ord_)], F.struct(-F.col(res), F.floor(F.col(ord_) / 100_000)), "position")


def compact_log(events: DataFrame, key: str, keep: int = LOG_KEEP) -> DataFrame:
    """Log entries: phase changes only (no fraction, or 0, or 1), without repeats, the last ``keep`` per job."""
    told = events.filter("frac IS NULL OR frac IN (0D, 1D)")
    prev = bucketed_lag(told, [key], ["ts", "seq"], F.date_trunc("minute", "ts"), "msg", "prev_msg")
    return top_k(prev.filter("prev_msg IS NULL OR prev_msg <> msg").drop("prev_msg"), [key], [F.col("ts").desc(), F.col("seq").desc()], keep).drop("rn")


def progress_steps(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each reported fraction with the one before it and whether the series went backwards there."""
    prev = bucketed_lag(events.filter("frac IS NOT NULL"), keys, ["ts", "seq"], F.date_trunc("minute", "ts"), "frac", "prev_frac")
    return prev.withColumn("backwards", F.coalesce(F.col("frac") < F.col("prev_frac"), F.lit(False)))


def timing(events: DataFrame, jobs: DataFrame, key: str, as_of: Column) -> DataFrame:
    """key -> run time and seconds left. A running job counts to ``as_of``, and its time left follows from the progress made since it was
    first seen; one that has ended took the time between its first and last event. ``jobs`` is (key, status)."""
    e = events.filter("frac IS NOT NULL").groupBy(key).agg(F.expr("min_by(struct(ts, frac), struct(ts, seq)) AS a"), F.expr("max_by(struct(ts, frac), struct(ts, seq)) AS b"))
    e = (e.join(jobs.select(key, (F.col("status") == "running").alias("_on")), key).withColumn("_now", as_of)
         .selectExpr(key, "_on", "(unix_micros(timestamp(if(_on, _now, b.ts))) - unix_micros(timestamp(a.ts))) / 1e6D AS run_s", "a.frac AS p0", "b.frac AS p"))
    return e.selectExpr(key, "run_s", "if(_on AND run_s > 5 AND p > p0, (1 - p) * run_s / (p - p0), NULL) AS eta_s")


def stalled(events: DataFrame, jobs: DataFrame, key: str, as_of: Column) -> DataFrame:
    """key -> age of the last update at ``as_of`` (session time zone UTC) and whether that is a stall, which only a running job
    can have. ``jobs`` is (key, status)."""
    def micros(c):
        return F.unix_micros(c.cast("timestamp"))
    last = events.groupBy(key).agg(F.max("ts").alias("last")).join(jobs.select(key, "status"), key)
    return (last.withColumn("age_s", (micros(as_of) - micros(F.col("last"))) / 1e6)
            .withColumn("stalled", (F.col("status") == "running") & (F.col("age_s") >= STALL_S)).drop("status"))


def first_wins(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row for each key: the least ``order`` and the ``value`` that came with it."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order), F.min_by(value, order).alias(value))


def trees_to_copy(wanted: DataFrame, layer: str, tree: str) -> DataFrame:
    """Every tree of files once for each layer that shares it."""
    return wanted.select(layer, tree).dropDuplicates([layer, tree])


def unique_names(files: DataFrame, key: str, name: str, ord_: str, bucket: int = 10_000) -> DataFrame:
    """Collision-free names inside a folder: repeats get ' (2)', ' (3)' ... before the first dot.

    Numbers that some file already carries literally are passed over, so no made name meets a given one.
    """
    at = [key, name]
    ranked = bucketed_row_number(files, at, [F.col(ord_)], F.floor(F.col(ord_) / bucket), "_rn")
    pat = r"^([^.]*) \((\d+)\)(\..*)?$"
    lit = (files.filter(F.col(name).rlike(pat)).select(key, F.regexp_replace(name, pat, "$1$3").alias(name), F.regexp_extract(name, pat, 2).cast("long").alias("_j")).filter("_j >= 2").distinct())
    # The k-th taken number t pushes up every rank from t - (k - 1) on; numbers in a row push from the same rank, as one island.
    lit = bucketed_row_number(lit, at, [F.col("_j")], F.floor(F.col("_j") / bucket), "_k").withColumn("_rn", F.col("_j") - F.col("_k") + 1)
    islands = lit.groupBy(*at, "_rn").agg(F.max("_k").alias("_k"))
    rows = (ranked.withColumn("_k", F.lit(0).cast("long")).withColumn("_own", F.lit(1)).unionByName(islands.withColumn("_own", F.lit(0)), allowMissingColumns=True)
            .withColumn("_b", F.floor(F.col("_rn") / bucket)))
    before = (rows.filter("_own = 0").groupBy(*at, "_b").agg(F.max("_k").alias("_m"))
              .withColumn("_to", F.lead("_b").over(Window.partitionBy(*at).orderBy("_b"))))
    # Buckets without islands of their own take what the last bucket with islands left: they lie in its range.
    last = before.select(*at, F.col("_b").alias("_from"), "_to", "_m")
    local = F.max("_k").over(Window.partitionBy(*at, "_b").orderBy("_rn", "_own"))
    rows = rows.withColumn("_k", local).filter("_own = 1")
    starts = rows.select(*at, "_b").distinct().join(last, at).filter("_b > _from AND (_to IS NULL OR _b <= _to)").select(*at, "_b", "_m")
    rows = rows.join(starts, [*at, "_b"], "left")
    num = F.col("_rn") + F.greatest(F.col("_k"), F.coalesce("_m", F.lit(0)))
    stem, ext = F.regexp_extract(name, r"^([^.]*)", 1), F.regexp_extract(name, r"^[^.]*(.*)$", 1)
    return (rows.withColumn("unique_name", F.when(F.col("_rn") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), num.cast("string"), F.lit(")"), ext)))
            .select(*files.columns, "unique_name"))


def retry_plan(attempts: DataFrame) -> DataFrame:
    """Attempts (request_id, kind, attempt, ts, outcome) with the wait before the next try.

    Only transient outcomes are retried; ``next_at`` is null when the request is over or given up.
    """
    ladder = "CASE kind " + " ".join(f"WHEN '{k}' THEN array({', '.join(map(str, v))})" for k, v in RETRY_DELAYS.items()) + " END"
    return (attempts.selectExpr("*", f"{ladder} AS _d").selectExpr("*", "if(outcome = 'retry', get(_d, attempt - 1), NULL) AS wait_s")
            .selectExpr("request_id", "kind", "attempt", "outcome", "wait_s", "if(outcome = 'retry' AND wait_s IS NULL, true, false) AS gave_up", "ts + make_dt_interval(0, 0, 0, wait_s) AS next_at"))


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    """Status after a restart: what was waiting or running did not finish."""
    return jobs.selectExpr("*", "if(status IN ('queued', 'running'), 'failed', status) AS new_status", "if(status IN ('queued', 'running'), 'interrupted', NULL) AS note")


def unfinished(wanted: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted tiles without an earlier good or empty result."""
    return wanted.join(results.filter("status IN ('ok', 'empty')").select(*keys).distinct(), keys, "left_anti")


def manifest(jobs: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """Manifest documents as rows: line 0 describes the job, every further line one layer.

    A job may have any number of layers; they are never gathered into one document.
    """
    n = layers.groupBy(key).agg(F.count("*").alias("n_layers"))
    head = jobs.join(n, key, "left").selectExpr(key, "0L AS line", "to_json(struct(name, created, mode, coalesce(n_layers, 0L) AS layers)) AS body")
    return head.unionByName(layers.selectExpr(key, "ord AS line", "to_json(struct(source, status, files)) AS body"))
