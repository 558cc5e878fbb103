"""URL filter: host and path rules first, gradient-boosted trees on lexical features for what no rule judges.

Features are the url's length, depth, digit ratio, character entropy, parameter counts and statistics of its host's suffix over all
urls. The trees are fitted to at most about ``SAMPLE`` labelled urls of each label (by a hash), so that fitting stays bounded; counts per
suffix cover every row, and its share of bad urls every labelled one. A url of the sample is shown its suffix's share without the urls
of its own fold, one of ``FOLDS`` by another hash: the trees can't read its label off that share.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is scored on empty features like
any other. Only A-Z are lower-cased in hosts. Equal urls get equal verdicts; the rule whose host and path are longest together wins,
and of equally long ones the greatest string. Without labelled urls of both kinds everything no rule judges is allowed. An empty table
gives an empty result; only page_id and url are read, so other columns can't clash.
"""
from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkraster.llm.classes import small
from sparkraster.llm.common import table
from sparkraster.session import cut_lineage

#: (verdict, host, path) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words in a host name that mark urls of the training sample as bad.
ABUSE_WORDS = ("ads", "adult", "bets", "casino", "click", "gamble", "pills", "porn", "spam", "track", "viagra", "xxx")
SAMPLE, TREES, DEPTH, FOLDS = 5000, 20, 4, 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    q = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {q} AS t(rule_verdict, rule_host, rule_path)")


def judged_by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the hosts and paths some rule fits: rules meet the host's suffixes by equality."""
    d = urls.filter("host <> ''").select("host", "path").distinct().withColumn("_p", F.split("host", r"\."))
    d = d.withColumn("_s", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", i, F.size("_p")), "."))))
    fit = d.join(rules, F.col("_s") == F.col("rule_host")).filter(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    return fit.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "rule_verdict")).alias("best")).select("host", "path", "best.rule", "best.rule_verdict")


FEATURES = ("n_url", "n_host", "n_path", "depth", "digit_ratio", "host_digits", "entropy", "params", "labels", "hyphens", "longest_label", "suffix_rows", "suffix_hosts", "suffix_bad")


def with_features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds FEATURES to (url, host, path); suffixes: (suffix, suffix_rows, suffix_hosts, bad_urls, labelled_urls). If urls
    has own_bad and own_labelled, these are taken out of its suffix's figures."""
    own = F.col("own_bad"), F.col("own_labelled")
    if "own_bad" not in urls.columns:
        own = F.lit(0), F.lit(0)
    u = urls.withColumn("_u", F.coalesce("url", F.lit(""))).withColumn("_c", F.array_distinct(F.split("_u", ""))).withColumn("suffix", suffix_of(F.col("host")))
    u = u.withColumn("n_url", F.length("_u"))
    share = F.transform("_c", lambda c: F.when(c == "", 0.0).otherwise((F.col("n_url") - F.length(F.replace("_u", c, F.lit("")))) / F.greatest("n_url", F.lit(1))))
    u = u.withColumn("_shares", share)
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    query = F.regexp_extract("_u", r"(?s)\?([^#]*)", 1)
    u = (u.withColumn("n_host", F.length("host")).withColumn("n_path", F.length("path"))
         .withColumn("depth", F.size(F.filter(F.split("path", "/"), lambda x: x != "")))
         .withColumn("digit_ratio", digits("_u") / F.greatest("n_url", F.lit(1))).withColumn("host_digits", digits("host"))
         .withColumn("entropy", F.aggregate("_shares", F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0)))
         .withColumn("params", F.size(F.filter(F.split(query, "&"), lambda x: x != "")))
         .withColumn("labels", F.size(F.split("host", r"\."))).withColumn("hyphens", F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit(""))))
         .withColumn("longest_label", F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x)))))
    u = u.join(small(suffixes), "suffix", "left").na.fill(0, ["suffix_rows", "suffix_hosts", "bad_urls", "labelled_urls"])
    u = u.withColumn("suffix_bad", (F.col("bad_urls") - own[0] + 1) / (F.col("labelled_urls") - own[1] + 10))
    return u.select(*urls.columns, *[F.col(f).cast("double").alias(f) for f in FEATURES])


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS))


def judge(pages: DataFrame, labelled: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) of every page; labelled: (url, bad 0/1)."""
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    by_rule = cut_lineage(judged_by_rules(urls, rules), "url-rules")
    lab = labelled.filter("bad in (0, 1) and url is not null").groupBy("url").agg(F.max("bad").alias("bad"))
    n = {r["bad"]: r["count"] for r in lab.groupBy("bad").count().collect()}
    parts = 1 << 30
    take = F.when(F.col("bad") == 1, F.lit(min(parts, parts * SAMPLE // max(1, n.get(1, 0))))).otherwise(F.lit(min(parts, parts * SAMPLE // max(1, n.get(0, 0)))))
    picked = cut_lineage(lab.filter(F.pmod(F.xxhash64("url"), F.lit(parts)) < take).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), "url-sample")
    by_fold = cut_lineage(lab.select(suffix_of(host_of(F.col("url"))).alias("suffix"), fold_of(F.col("url")).alias("fold"), "bad")
                          .groupBy("suffix", "fold").agg(F.sum("bad").alias("own_bad"), F.count("*").alias("own_labelled")), "url-suffix-labels")
    bad = by_fold.groupBy("suffix").agg(F.sum("own_bad").alias("bad_urls"), F.sum("own_labelled").alias("labelled_urls"))
    all_ = urls.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.log1p(F.count("*")).alias("suffix_rows"), F.log1p(F.approx_count_distinct("host")).alias("suffix_hosts"))
    suffixes = cut_lineage(all_.join(bad, "suffix", "full"), "url-suffixes")
    to_vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    scored = with_features(urls, suffixes)
    if n.get(0) and n.get(1):
        shown = picked.withColumn("suffix", suffix_of(F.col("host"))).withColumn("fold", fold_of(F.col("url"))).join(small(by_fold), ["suffix", "fold"]).drop("suffix", "fold")
        rows = with_features(shown, suffixes).withColumn("weight", F.when(F.col("bad") == 1, F.lit(max(1.0, n[0] / n[1]) ** 0.5)).otherwise(1.0)).withColumn("label", F.col("bad").cast("double"))
        fit = cut_lineage(to_vector.transform(rows).select("features", "label", "weight"), "url-features")
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, weightCol="weight", cacheNodeIds=False).fit(fit)
        p = vector_to_array(F.col("probability"))[1]
        scored = model.transform(to_vector.transform(scored)).withColumn("p", p)
    else:
        scored = scored.withColumn("p", F.lit(0.0))
    scored = scored.select("page_id", "host", "path", F.col("p").alias("probability"))
    return (scored.join(small(by_rule), ["host", "path"], "left")
            .select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "probability"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): bad where the host has an abuse word, good where the document the url's last number names has good quality."""
    words = F.split(host_of(F.col("url")), r"[.-]")
    u = pages.select("url", F.arrays_overlap(words, F.array(*[F.lit(w) for w in ABUSE_WORDS])).alias("abuse"),
                     F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)(?:[.][a-z]+)?/?(?:[?#]|$)', 1) AS bigint)").alias("doc_id"))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    return u.filter("abuse").select("url", F.lit(1).alias("bad")).union(u.filter("not abuse").join(good, "doc_id", "left_semi").select("url", F.lit(0)))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    j = judge(pages, labelled_urls(pages, table(spark, sf_dir, "labels")), rule_table(spark))
    return j.select("page_id", "host", "path", "rule", "verdict", "probability")
