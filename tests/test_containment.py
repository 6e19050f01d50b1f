"""The inverted index against the oracle of every claim on every page."""

import random

from pyspark.sql import functions as F

from attestry.functions.contact import oracle
from attestry.operators import containment as CN

STORED = [("phone", "(415) 555-0100"), ("phone", "1 415 555 0100"), ("phone", "311"),
          ("phone", None), ("phone", "4155550100 x5"), ("address", "12 Main Street, Oakland"),
          ("address", "120 Mainly Rd"), ("address", "P.O. Box 23, Oakland"), ("address", "Box #7"),
          ("address", "Main Street 12"), ("address", "5 St"), ("address", " 77 Élan Quai\nx"),
          ("address", None), ("status", "open")]
PIECES = ["12", "120", "23", "7", "77", "main", "MAIN", "mainly", "quai", "lan", "(415) 555", "0100",
          "5", "street", "box", "1415", "é", "", "4155550100", "9415555010099"]


def tables(spark, seed):
    rnd = random.Random(seed)
    claims = [(g, f"k{i}", f, s) for g in (1, 2, 3) for i, (f, s) in enumerate(STORED)]
    pages = [(g, f"u{i}", rnd.choice([" ", "-", "", "x"]).join(
        rnd.choice(PIECES) for _ in range(rnd.randrange(7)))) for g in (1, 2) for i in range(60)]
    pages.append((2, "null", None))
    return (spark.createDataFrame(claims, "listing_id bigint, key string, field string, stored string"),
            spark.createDataFrame(pages, "listing_id bigint, url string, text string"))


def test_truth_equals_the_oracle(spark):
    claims, pages = tables(spark, 3)
    want = {(r.listing_id, r.key, r.url): r.t for r in claims.join(
        pages.filter("text IS NOT NULL"), "listing_id").select(
        "listing_id", "key", "url", oracle(F.col("field"), F.col("stored"), F.col("text")).alias("t")
    ).collect()}
    got = {(r.listing_id, r.key, r.url): r.on_page for r in CN.truth_rows(
        CN.needles(claims), pages).collect() if r.url != "null"}
    assert got.keys() == want.keys()
    nulls = {k for i, (f, s) in enumerate(STORED) if s is None for k in [f"k{i}"]}
    assert {k: v for k, v in got.items() if k[1] not in nulls} == {
        k: v for k, v in want.items() if k[1] not in nulls}
    assert sum(bool(v) for v in got.values()) > 100


def test_counts_are_the_rows_counted(spark):
    claims, pages = tables(spark, 4)
    need = CN.needles(claims)
    rows = CN.truth_rows(need, pages).groupBy("listing_id", "key", F.col("on_page").alias("truth")).agg(
        F.count(F.lit(1)).alias("n"))
    a = sorted(map(repr, rows.select("listing_id", "key", "truth", "n").collect()))
    b = sorted(map(repr, CN.counts(need, pages).select("listing_id", "key", "truth", "n").collect()))
    assert a == b


def test_no_text_beyond_the_index(spark):
    claims, pages = tables(spark, 5)
    plan = CN.hits(CN.needles(claims), pages)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not any("text#" in line for line in joins)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hits_of_a_large_listing(spark):
    """Four thousand claims on two thousand pages: the work follows the hits."""
    claims = spark.range(4000).selectExpr(
        "1L AS listing_id", "'k' || id AS key", "'phone' AS field",
        "'510' || lpad(cast(id AS string), 7, '0') AS stored")
    pages = spark.range(2000).selectExpr(
        "1L AS listing_id", "'u' || id AS url",
        "'Call (510) ' || lpad(cast(id * 2 AS string), 7, '0') AS text")
    need = CN.needles(claims)
    assert CN.hits(need, pages).count() == 2000
    assert {(r.truth, r.n) for r in CN.counts(need, pages).groupBy("truth").agg(
        F.sum("n").alias("n")).collect()} == {(True, 2000), (False, 4000 * 2000 - 2000)}
