"""Helper columns never meet columns of the input, whatever those are called; pseudonyms of social security numbers are valid ones."""
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkraster.llm import decontaminate, line_dedup, near_dedup, pseudonyms
from sparkraster.llm.common import unused

OWN = ["_k", "_d", "_m", "_new", "_rows", "_gone", "_lines", "_toxic", "key", "leaked", "stays_id", "stays_KEY", "stays_rows", "gone_id", "gone_key", "gone_lines", "text_lines", "pii_matches", "pii_parts", "pii_new",
       "toxic_score", "rows", "item", "at", "id", "n", "stays", "line", "bucket", "h", "w"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "one line that stands in both\nwords of its own 123-45-6789 and more words to make it long enough to be seen"
    return (spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, "one line that stands in both\nother", "t"), (None, None, None)], "doc_id bigint, text string, source string")
            .select("*", *[F.lit(i).alias(c) for i, c in enumerate(OWN)]))


@pytest.mark.parametrize("name", ["remove", "near", "lines", "pii"])
def test_columns_of_any_name_pass_through(spark, docs, name):
    items = spark.createDataFrame([(1, "none of these words stand in any of the documents that are given")], "item_id bigint, text string")
    out = {"remove": lambda: decontaminate.remove(docs, items), "near": lambda: near_dedup.deduplicate(docs), "lines": lambda: line_dedup.deduplicate(docs), "pii": lambda: pseudonyms.pseudonymise(docs).drop("pii_found")}[name]()
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == i for r in rows for i, c in enumerate(OWN))


def test_pipeline_keeps_a_column_named_like_its_score(spark, docs):
    out = corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and all(r["toxic_score"] == OWN.index("toxic_score") for r in out.collect())


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert unused(df, "a", "b", "b") == ["a__", "b", "b_"]


def test_social_security_numbers_stay_valid_and_distinct(spark):
    rng = random.Random(3)
    valid = set()
    while len(valid) < 1500:
        x = f"{rng.randint(1, 899):03d}{rng.randint(1, 99):02d}{rng.randint(1, 9999):04d}"
        if not x.startswith("666"):
            valid.add(x)
    df = spark.createDataFrame([(x,) for x in sorted(valid)], "x string")
    got = [r[0] for r in df.select(pseudonyms.permuted_ssn(F.col("x"), "k")).collect()]
    assert len(set(got)) == len(valid) and not any(re.search(r"^(000|666|9\d\d)|^\d{3}00|0000$", x) for x in got) and all(len(x) == 9 for x in got)
