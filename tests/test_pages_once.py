"""Pages are gone through once, their text stays in its row, and tables are written once."""

import os
import random

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions.contact import oracle
from attestry.operators import containment as CN
from attestry.operators import entity_graph as G
from attestry.operators import evidence as E
from attestry.operators import inventory as I
from attestry.operators import scorers as X
from attestry.session import dealt, stored
from attestry.sources.stores import read_captures, write_captures

PAGE = "listing_id bigint, pos int, url string, text string"
PHONE = "listing_id bigint, pos int, phone_id bigint, number string, service_type string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def marked(df):
    """Rows with text whose making shows in a plan as ~~made~~."""
    return df.withColumn("text", F.concat("text", F.lit(" ~~made~~")))


def pages(spark, seed=1, n=80):
    rnd = random.Random(seed)
    words = ["415", "555", "0100", "(415)", "4155550100", "(628) 001-0002", "call", "Oak. ", "? ",
             "12 Main", "94607", "", "é", "closed!  ", "x. "]
    return spark.createDataFrame([(g, i, f"u{i}", rnd.choice([" ", "-", ". "]).join(
        rnd.choice(words) for _ in range(rnd.randrange(9)))) for g in (1, 2) for i in range(n)], PAGE)


def test_many_values_are_found_like_few(spark):
    rnd = random.Random(2)
    numbers = ["415555" + f"{rnd.randrange(300):04d}" for _ in range(40)]
    claims = spark.createDataFrame(
        [(1, f"p{i}", "phone", x) for i, x in enumerate(numbers)]
        + [(1, f"a{i}", "address", f"{i} {w} St") for i, w in enumerate(["Main", "Oak", "élan Quai"] * 9)]
        + [(1, "b", "address", "PO Box 12")],
        "listing_id bigint, key string, field string, stored string")
    shown = spark.createDataFrame([(1, f"u{i}", " ".join(rnd.choice(
        numbers + ["3 main", "MAIN 10", "oak 4", "7", "12", "quai 5"]) for _ in range(5)))
        for i in range(60)], "listing_id bigint, url string, text string")
    needles = CN.needles(claims)
    want = sorted((r.key, r.url) for r in claims.join(shown, "listing_id").filter(
        oracle(F.col("field"), F.col("stored"), F.col("text"))).select("key", "url").collect())
    found = CN.hits(needles, marked(shown))
    # One pass over the text, and one join: values by listing.
    assert plan(found).count("~~made~~") == 1 and plan(found).count("Join") == 1
    assert sorted((r.key, r.url) for r in found.collect()) == want and len(want) > 60


def test_phone_evidence_reads_a_page_once(spark):
    phone = spark.createDataFrame([(1, 0, 10, "415 555 0100", None), (2, 0, 20, "311", None),
                                   (2, 1, 21, "415 999 0000", None)], PHONE)
    found = E.phone_findings(phone, marked(pages(spark)))
    assert plan(found).count("~~made~~") == 1
    rows = {r.listing_id: r for r in found.collect()}
    assert rows[1].match and rows[1].stored == "415 555 0100" and rows[1].phone_id == 10
    assert not rows[2].match and rows[2].field == "phone" and rows[2].quote


def test_phone_evidence_with_many_stored_numbers(spark):
    many = [(1, i, i, f"628 000 {i:04d}", None) for i in range(150)] + [(1, 150, 150, "4155550100", None)]
    phone = spark.createDataFrame(many, PHONE)
    seen = spark.createDataFrame([(1, 2, "b", "628 000 0003"), (1, 1, "a", "x 415-555-0100 628 000 0149")],
                                 PAGE)
    r = E.phone_findings(phone, seen).first()
    assert (r.match, r.url, r.live, r.phone_id) == (True, "a", "415-555-0100", 150)


def test_identity_meets_anchors_by_listing(spark):
    phone = spark.createDataFrame([(1, i, i, f"628 000 {i:04d}", None) for i in range(150)], PHONE)
    address = spark.createDataFrame([(1, 0, "12 Main Street", "Oakland", "94607"),
                                     (2, 0, None, "Oakville", None)],
                                    "listing_id bigint, pos int, address_1 string, city string, "
                                    "postal_code string")
    seen = spark.createDataFrame([(1, 1, "a", "in oakland"), (1, 2, "b", "call 628-000-0149"),
                                  (2, 1, "c", None), (3, 1, "d", "any")], PAGE)
    found = E.identity(E.identity_anchors(phone, address), marked(seen))
    rows = {r.listing_id: tuple(r)[1:] for r in found.collect()}
    assert rows == {1: (True, "phone", "6280000149", "b"), 2: (False, None, None, None),
                    3: (True, None, None, None)}
    # Anchors meet a page as arrays, so its text is not repeated for each.
    assert "collect_list" in plan(found)


def test_first_span_is_the_first_of_all_spans(spark):
    rows = pages(spark, 5, 200)
    spans = F.filter(X.spans(F.col("text")), lambda s: s["span"].rlike(K.PHONE_RE))
    want = sorted(map(repr, rows.select("url", F.get(spans, F.lit(0)).alias("s")).filter(
        "s IS NOT NULL").select("url", "s.i", "s.span").collect()))
    got = X.first_span(marked(rows).withColumn("text", F.replace("text", F.lit(" ~~made~~"))),
                       K.PHONE_RE, "url")
    assert sorted(map(repr, got.collect())) == want and len(want) > 50
    # Shown across two spans only: the whole page is cut.
    odd = spark.createDataFrame([(1, 1, "u", "ab. cd. Then b.")], PAGE)
    assert X.first_span(odd, r"b\. c|Then", "url").first().i == 2


def test_captures_carry_what_is_chosen(spark):
    from attestry.plans.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    chosen = t.page_key.select("listing_id", "url", F.lit(7).alias("pos")).limit(20)
    rows = t.captures(stored(chosen)).collect()
    assert len(rows) == 40 and {r.pos for r in rows} == {7}


def test_contacts_hold_no_services(spark):
    nodes = spark.createDataFrame([("org:1", "org", "a", None), ("svc:1", "service", "b", None)],
                                  "id string, kind string, name string, value string")
    edges = spark.createDataFrame([("org:1", "svc:1", "offers"), ("org:1", "tel:1", "reachable_at")],
                                  "src string, dst string, rel string")
    g = G.Graph(nodes, edges).contacts()
    assert [r.id for r in g.nodes.collect()] == ["org:1"]
    assert [r.dst for r in g.edges.collect()] == ["tel:1"]


def test_dealt_rows_stay_in_a_join(spark):
    big = dealt(spark.createDataFrame([(str(i % 9), i) for i in range(90)], "src string, n int"), "src")
    few = spark.createDataFrame([("1",), ("2",)], "src string").hint("merge")
    met = big.join(few, "src", "left_semi")
    assert met.count() == 20
    assert plan(met).count("Exchange") == 1


def test_captures_are_written_unsorted(spark, tmp_path):
    rows = spark.createDataFrame([(m, f"u{i}", "t" * i) for i in range(9) for m in "abcdef"],
                                 "method string, url string, text string")
    path = str(tmp_path / "captures")
    write_captures(rows, path)
    assert {f.split(".")[-2] for _, _, fs in os.walk(path) for f in fs
            if f.startswith("part")} == {"zstd"}
    assert read_captures(spark, path, "f").count() == 9
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"


def test_sitemap_bodies_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(url):
        made.add(1)
        return "<sitemapindex><sitemap><loc>https://a.org/2.xml</loc></sitemap></sitemapindex>" \
            if url.endswith("1.xml") else "<urlset><url><loc>https://a.org/p</loc></url></urlset>"

    bodies = spark.createDataFrame([("https://a.org/1.xml",), ("https://a.org/2.xml",)],
                                   "url string").withColumn("body", body("url"))
    sites = spark.createDataFrame([("https://a.org/", "Sitemap: https://a.org/1.xml")],
                                  "website string, body string")
    assert [r.url for r in I.crawl_sitemaps(I.site_rules(sites), bodies).collect()] == ["https://a.org/p"]
    assert made.value == 2


def moved_rows(df):
    """How many shuffles a plan holds, made without broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_dealt_where_they_lie_are_not_moved_again(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(300).selectExpr("id % 40 AS listing_id", "'t' || id AS text").repartition(
        n, "listing_id")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dealt(rows, "listing_id", "kept", moved=False)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))
        few = spark.range(5).withColumnRenamed("id", "listing_id")
        met = kept.join(few, "listing_id")
        assert moved_rows(met) == 1 and met.count() == 40
        assert moved_rows(kept.groupBy("listing_id").count()) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_halves_are_made_from_counts_of_organisations(spark):
    """j16 read its scored rows, and so the tables below them, three times."""
    from types import SimpleNamespace

    from attestry.plans import queries_measure as Q

    rows = [("s1" if i % 3 else "s2", f"o{i % 7}" if i % 10 else None, 0.5 if i % 4 else None,
             i % 2 == 0) for i in range(200)]
    scored = spark.createDataFrame(rows, "scorer string, org_id string, support double, truth boolean")
    out = Q.j16(SimpleNamespace(scored=scored))
    assert out.inputFiles() and all("/per-" in f for f in out.inputFiles())
    got = {(r.scorer, r.half): (r.n, r.orgs) for r in out.collect()}
    used = [r for r in rows if r[2] is not None]
    for s in ("s1", "s2"):
        assert got[s, "calibration"][0] + got[s, "test"][0] == sum(r[0] == s for r in used)
        assert got[s, "calibration"][1] + got[s, "test"][1] == len({r[1] for r in used if r[0] == s})


def test_wanted_pages_are_found_where_their_listing_lies(spark):
    from attestry.plans.pipeline import DirectoryRun

    wanted = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (None, 1, "n")],
                                   "listing_id bigint, pos int, url string")
    pages = dealt(spark.createDataFrame([(1, "a", "A"), (1, "a", "A2"), (2, "z", "Z")],
                                        "listing_id bigint, url string, made string"), "listing_id")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = DirectoryRun.found(None, wanted, pages)
        assert moved_rows(out) == 0
        assert sorted(out.select("listing_id", "pos", "url", "made").collect(), key=str) == sorted([
            (1, 1, "a", "A"), (1, 1, "a", "A2"), (1, 2, "b", None), (2, 1, "x", None),
            (None, 1, "n", None)], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_picks_and_tops_leave_ranked_pages_where_they_lie(spark):
    ranked = dealt(spark.createDataFrame(
        [(i, f, r, f"{f}{r}", None) for i in (1, 2) for f in ("phone", "address")
         for r in range(1, 6)], "listing_id bigint, field string, rank int, url string, "
        "lastmod string"), "listing_id")
    answers = spark.createDataFrame([(1, "phone", "u4"), (1, "address", "none"), (2, "phone", "u9")],
                                    "listing_id bigint, field string, choice string")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        picks = X.picked_pages(ranked, answers)
        assert moved_rows(picks) == 1
        assert [tuple(r) for r in picks.collect()] == [(1, "phone", "phone5", None)]
        fields = spark.createDataFrame([(1, "address", (0, 0)), (1, "phone", (1, 0))],
                                       "listing_id bigint, field string, field_pos struct<t:int,p:int>")
        listed = spark.createDataFrame([(1, "http://a")], "listing_id bigint, origin string")
        got = I.select_pages(listed, fields, ranked, budget=6, picks=picks).orderBy("pos").collect()
        assert [r.url for r in got] == ["http://a/", "phone5", "address1", "address2", "address3",
                                        "phone1"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
