"""Registered queries against their SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from attestry.plans import catalog
from attestry.plans.adapters import TABLES

SF = "/root/testdata/sf0.001"
KNOWN = catalog.load()
CHECKED = ("p01", "p04", "p13", "p27", "p28", "p40", "p41", "g01", "a04", "j12", "g03", "g04",
           "w01", "w02", "j01", "j04", "f05", "e02", "a08", "w13", "e06", "a02", "a03", "u01",
           "s02", "s07", "x06", "e07", "p32", "w06", "st2_remaining", "s18", "s19", "st2", "st4", "p38", "p45", "u06", "w10", "w17")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    df = catalog.runner(KNOWN[name])(spark, SF)
    cols = sorted(df.columns)
    ours = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    rel = duck.sql(KNOWN[name].sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(repr([norm(row[i]) for i in at]) for row in rel.fetchall())
    assert ours == theirs


def test_every_query_has_a_title():
    assert all(q.title for q in KNOWN.values())
    assert len(KNOWN) > 150


def test_matches_of_a_run_feed_freshness(spark):
    from attestry.operators import freshness as FR
    from attestry.plans.adapters import Tables
    from attestry.plans.pipeline import DirectoryRun

    run = DirectoryRun(Tables(spark, SF))
    told = {(r["listing_id"], r["field"]) for r in run.confirmations.collect()}
    before = FR.rollup(FR.field_scores(run.d, run.as_of)).select("id", "exact")
    moved = run.freshness.alias("a").join(before.alias("b"), "id").filter(
        "a.exact > b.exact").select("id").collect()
    assert told and moved
    assert {r["id"] for r in moved} <= {i for i, _ in told}


def test_plans_have_no_cartesian_pair_join(spark):
    for name in ("j03", "j04", "j07", "j12", "w02"):
        plan = catalog.runner(KNOWN[name])(spark, SF)._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def plan_of(spark, name, sf=SF):
    return catalog.runner(KNOWN[name])(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_captures_of_a_page_are_put_together_without_moving_text(spark):
    plan = plan_of(spark, "e08")
    assert plan.count("lineitem.parquet") == 1
    assert "Union" not in plan and "hashpartitioning(listing_id" not in plan


@pytest.mark.parametrize("text, rows", [
    ("x" * 701, {"direct": ("x" * 701, None), "reader": ("x" * 701, None)}),
    ("y" * 301, {"direct": ("y" * 60, None), "reader": ("y" * 301, None)}),
    ("z" * 151, {"direct": (None, "direct fetch failed"), "reader": ("z" * 151, None)}),
    ("w", {"direct": (None, "direct fetch failed"), "reader": (None, "reader fetch failed")}),
    (None, {"direct": (None, "direct fetch failed"), "reader": (None, "reader fetch failed")})])
def test_capture_rows_equal_their_view(spark, text, rows):
    from attestry.plans.adapters import _CAPTURE_ROWS, VIEWS

    page = spark.createDataFrame([(1, "u", text), (None, None, text), (1, "u", text)],
                                 "listing_id bigint, url string, text string")
    got = spark.sql(_CAPTURE_ROWS, page=page)
    assert got.exceptAll(spark.sql(VIEWS["capture"][1], page=page)).count() == 0
    assert got.count() == 6
    assert {r["method"]: (r["text"], r["error"]) for r in got.collect()} == rows


def test_sitemap_bodies_are_put_together_once(spark):
    from attestry.plans.adapters import Tables

    body = Tables(spark, SF).sitemap_body._jdf.queryExecution().executedPlan().toString()
    assert plan_of(spark, "p11").count("lineitem.parquet") == body.count("lineitem.parquet")


@pytest.mark.parametrize("name", ("w03", "x04"))
def test_pages_are_ranked_once(spark, name):
    # The pattern of noise words stands where pages are scored: in the stored ranking only.
    assert "annual-report" not in plan_of(spark, name)
