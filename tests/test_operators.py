"""Operators over small tables, compared with the expected rows or with brute force."""

import itertools
import random
import re

import pytest

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.operators import calibration as CA
from attestry.operators import claims as CL
from attestry.operators import entity_graph as G
from attestry.operators import evidence as E
from attestry.operators import freshness as FR
from attestry.operators import inventory as I
from attestry.operators import review_queue as R
from attestry.operators import scorers as X
from attestry.operators.directory import Directory

c = F.col
AS_OF = "2026-09-20T00:00:00Z"

PHONE = "listing_id bigint, pos int, phone_id bigint, number string, service_type string, " \
        "country_code string"
ADDRESS = "listing_id bigint, pos int, address_1 string, city string, state_province string, " \
          "postal_code string"
PAGES = "listing_id bigint, pos int, url string, lastmod string, text string"
LISTING = "id bigint, name string, status string, website string, email string, " \
          "verified_at string, certified_at string, certified boolean, updated_at string, " \
          "hours_known boolean, category_names string"


def directory(spark, listing=(), phone=(), address=(), service=(), svc_cat=(), cat=(), days=()):
    f = spark.createDataFrame
    return Directory(
        f(list(listing), LISTING), f(list(phone), PHONE), f(list(address), ADDRESS),
        f(list(service), "listing_id bigint, service_id bigint, name string"),
        f(list(svc_cat), "service_id bigint, category_id bigint, name string"),
        f(list(cat), "listing_id bigint, category_id bigint, name string"),
        f(list(days), "listing_id bigint, day string, opens_at int, closes_at int"))


def org(i, name="n", **kw):
    row = dict(id=i, name=name, status="approved", website=None, email=None, verified_at=None,
               certified_at=None, certified=False, updated_at=None, hours_known=None,
               category_names="")
    row.update(kw)
    return tuple(row.values())


# ---------------------------------------------------------------- claims

def test_phone_claims(spark):
    rows = [(1, 0, 1, "", "Voice", "US"), (1, 1, 2, "510-555-0100", "Voice", "US"),
            (2, 0, 3, "510-555-0100", "TTY", None)]
    rows += [(3, i, 10 + i, f"510-555-010{i}", None, None) for i in range(10)]
    got = CL.phone_claims(spark.createDataFrame(rows, PHONE)).collect()
    by = {k: [r for r in got if r["listing_id"] == k] for k in (1, 2, 3)}
    assert [r["stored"] for r in by[1]] == ["510-555-0100"]
    assert "(TTY)" in by[2][0]["text"]
    assert len(by[3]) == 10


def test_address_claim_skips_blanks(spark):
    rows = [(1, 0, "433 Hegenberger Rd.", "Oakland", "CA", "94621"), (1, 1, "", "", None, None)]
    got = CL.address_claims(spark.createDataFrame(rows, ADDRESS)).collect()
    assert [r["stored"] for r in got] == ["433 Hegenberger Rd., Oakland, CA, 94621"]


def test_templates_always_include_status(spark):
    d = directory(spark, listing=[org(1)])
    assert [r["field"] for r in CL.template_claims(d).collect()] == ["status"]


def test_extracted_claims_cleaned_and_united(spark):
    reply = ('sure {"claims":[{"field":"Fee","text":"The fee is ten dollars","stored":"$10"},'
             '{"field":"fee","text":"the FEE is ten dollars","stored":"x"},'
             '{"field":"fee","text":"It is free of charge","stored":"x"},'
             '{"field":"colour","text":"The walls are green","stored":"x"},'
             '{"field":"wait","text":"The short","stored":"x"},'
             '{"field":"status","text":"THE ORGANISATION IS CURRENTLY OPERATING AND HAS NOT CLOSED '
             'OR PERMANENTLY SHUT DOWN.","stored":""}]} ok')
    got = CL.clean_extracted(spark.createDataFrame(
        [(1, reply), (2, "no json"), (3, "{broken")], "listing_id bigint, reply string"))
    rows = [(r["key"], r["field"], r["source"]) for r in got.orderBy("pos").collect()]
    assert rows == [("c0", "eligibility", "fee"), ("c1", "status", "status")]
    both = CL.union_claims(CL.template_claims(directory(spark, listing=[org(1)])), got)
    assert sorted(r["key"] for r in both.collect()) == ["status", "xc0"]


# ---------------------------------------------------------------- verdicts

def verdicts(spark, rows):
    return E.reconcile(E.label_rows(spark.createDataFrame(
        rows, "listing_id bigint, key string, pos int, support double, contradict double")))


def test_reconcile(spark):
    rows = [(1, "a", 1, .02, .02), (1, "a", 2, .02, .02), (1, "a", 3, .97, .02),
            (1, "b", 1, .02, .99), (1, "b", 2, .97, .02),
            (1, "c", 1, .02, .02), (1, "c", 2, .02, .99),
            (1, "d", 1, .91, .02), (1, "d", 2, .99, .01),
            (1, "e", 1, .5, .4), (1, "e", 2, .6, .4)]
    got = {r["key"]: r for r in verdicts(spark, rows).collect()}
    assert got["a"]["label"] == "supported" and got["b"]["label"] == "supported"
    assert got["c"]["label"] == "contradicted"
    assert got["d"]["support"] == .99
    assert got["e"]["pos"] == 1
    assert verdicts(spark, [(1, "a", 1, 0.0, 0.0)]).filter("false").count() == 0


def test_findings_deduplicated_by_value(spark):
    rows = [(1, "phone0", "phone", "(415) 223-1416", "contradicted"),
            (1, "xc7", "phone", " (415) 223-1416", "contradicted"),
            (1, "addr0", "address", "1185 Mission Street", "contradicted"),
            (1, "z", "phone", "x", "absent")]
    df = spark.createDataFrame(rows, "listing_id bigint, key string, field string, stored string, "
                                     "label string")
    assert E.distinct_findings(df, c("key")).count() == 2


def identity(spark, phones=(), addresses=(), text=""):
    anchors = E.identity_anchors(
        spark.createDataFrame([(1, i, i, n, None, None) for i, n in enumerate(phones)], PHONE),
        spark.createDataFrame([(1, i, *a) for i, a in enumerate(addresses)], ADDRESS))
    pages = spark.createDataFrame([(1, 1, "u", None, text)], PAGES)
    return anchors, E.identity(anchors, pages).first()


def test_identity(spark):
    _, r = identity(spark, ["(510) 587-2999"], text="call us on 510.587.2999 today")
    assert r["belongs"] and r["anchor_kind"] == "phone"
    anchors, r = identity(
        spark, ["(415) 489-7300"], [("1485 Bayshore Boulevard", "San Francisco", "CA", "94124")],
        "GOSO East Harlem New York. Call 212-831-5020.")
    assert not r["belongs"] and r["anchor_kind"] is None
    assert {a["kind"] for a in anchors.collect()} == {"phone", "street", "city", "postal_code"}
    _, r = identity(spark, ["(415) 555-0100"], [("1 Main Street", "San Francisco", "CA", "94103")],
                    "We serve San Francisco. 415-555-0100.")
    assert r["anchor_kind"] == "phone"
    _, r = identity(spark, text="anything at all")
    assert r["belongs"]


def test_closure_guard(spark):
    texts = {
        1: "Our pantry is permanently closed since May.",
        2: 'config {"specs.events.ui.RelocatedPagesModal":"true"}',
        3: "In 1998 he relocated to New Orleans with family.",
        4: "he relocated to New Orleans " + "x" * 200 + " We have closed; our office has closed.",
        5: "Nothing to see."}
    pages = spark.createDataFrame([(k, 1, "u", None, v) for k, v in texts.items()], PAGES)
    got = {r["listing_id"]: r["live"] for r in E.closure_findings(pages).collect()}
    assert got == {1: "permanently closed", 4: "has closed"}


def test_phone_findings(spark):
    phone = spark.createDataFrame(
        [(1, 0, 1, "415-555-0001", None, None), (2, 0, 2, "415-555-0002", None, None),
         (2, 1, 3, "415-555-0003", None, None), (3, 0, 4, "415-555-0004", None, None),
         (3, 1, 5, "(415) 555 0009", None, None)], PHONE)
    pages = spark.createDataFrame(
        [(k, 1, "u", None, "Call 415.555.0009 now") for k in (1, 2, 3)], PAGES)
    got = {r["listing_id"]: (r["field"], r["match"], r["phone_id"])
           for r in E.phone_findings(phone, pages).collect()}
    assert got == {1: ("phone", False, 1), 2: ("phone_missing", False, None),
                   3: ("phone", True, 5)}


def run_audit(spark, website="https://x.test/", method="sitemap", n=1, available=True, text="",
              claimed=True):
    d = directory(spark, [org(1, website=website)], phone=[(1, 0, 1, "510-555-0100", None, None)])
    pages = spark.createDataFrame([(1, 1, "https://x.test/", None, text)] if text else [], PAGES)
    inv = spark.createDataFrame([(1, method, n)], "listing_id bigint, method string, pages int")
    claims = CL.template_claims(d).filter(F.lit(claimed))
    summary, kept = E.audit(d.listing, claims, inv, pages,
                            E.identity_anchors(d.phone, d.address), available=available)
    return summary.first(), kept.collect()


def test_audit_abstains(spark):
    s, v = run_audit(spark, website="")
    assert "no website" in s["note"] and not v
    s, v = run_audit(spark, available=False, text="510 555 0100 " * 30)
    assert "abstaining" in s["note"] and not v
    s, v = run_audit(spark, text="Call 510 555 0100, open daily. " * 20, claimed=False)
    assert s["note"] == K.NOTE_NO_CLAIMS and not v
    s, v = run_audit(spark, method="robots-denied", n=0)
    assert "robots.txt" in s["note"] and s["n_findings"] == 0
    s, v = run_audit(spark, text="A page about 212-831-5020. " * 20)
    assert s["website_suspect"] and not v
    s, v = run_audit(spark, text="Call 510 555 0100, open daily. " * 20)
    assert s["note"] == "" and s["n_confirmations"] == 2


def test_failed_scorer_withholds_its_listing(spark):
    # The failed page might hold the support, so listing 1 gets no verdict; listing 2 does.
    claims = CL.template_claims(directory(
        spark, [org(1), org(2)], phone=[(1, 0, 1, "510-555-0100", None, None),
                                        (2, 0, 2, "510-555-0101", None, None)]))
    pages = spark.createDataFrame([(1, 1, "a", None, "good"), (1, 2, "b", None, "bad"),
                                   (2, 1, "c", None, "good")], PAGES)

    def judge(text, asked):
        if text == "bad":
            raise ValueError("no answer")
        return [(0.8, 0.1) if a["field"] == "phone" else (None, 0.2) for a in asked]

    got = X.judge_pages(claims, pages, judge).collect()
    assert [(r["url"], r["field"], r["support"]) for r in got] == [("c", "phone", 0.8)]


def test_failed_text_costs_one_row(spark):
    def shout(texts):
        return texts.map(lambda s: 1 / 0 if s == "bad" else s.upper())

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "t string").coalesce(1)
    assert [r["reply"] for r in X.map_text(df, "t", shout).collect()] == ["A", None, "C"]


def test_newest_capture_counts(spark):
    df = spark.createDataFrame([(1, "direct", "z" * 300, None, "1"), (1, "direct", "a" * 300, None, "2")],
                               "id int, method string, text string, error string, at string")
    assert E.best_capture(df, ["id"]).first()["text"] == "a" * 300


# ---------------------------------------------------------------- captures and pages

def test_capture_tiers(spark):
    rows = [(1, "direct", "x" * 150, None), (1, "reader", "y" * 21710, None),
            (2, "direct", "x" * 250, None), (2, "reader", "y" * 900, None),
            (3, "direct", "short", None), (3, "reader", None, "timeout"),
            (4, "direct", None, "refused"), (4, "reader", None, "timeout")]
    df = spark.createDataFrame(rows, "id int, method string, text string, error string")
    got = {r["id"]: (r["method"], r["error"]) for r in E.best_capture(df, ["id"]).collect()}
    assert got == {1: ("reader", None), 2: ("direct", None), 3: ("direct", None),
                   4: (None, "timeout")}
    longest = {r["id"]: r["method"] for r in E.best_capture(df, ["id"], longest=True).collect()}
    assert longest[2] == "reader"


def top_page(spark, field, *pages):
    df = spark.createDataFrame([("https://x.test", *p) for p in pages],
                               "website string, url string, lastmod string")
    return I.rank_pages(df, (field,), AS_OF).orderBy("rank").first()["url"]


def test_ranking(spark):
    assert top_page(spark, "eligibility", ("https://x.test/jazzprogrambooks/", "2026-05-12"),
                    ("https://x.test/services/", "2026-09-15")).endswith("/services/")
    assert top_page(spark, "phone", ("https://x.test/about-2/", "2026-06-04"),
                    ("https://x.test/get-help/", "2026-09-18"),
                    ("https://x.test/contact/", "2026-08-14")).endswith("/get-help/")
    assert top_page(spark, "phone", ("https://x.test/2026/09/gala-night/", "2026-09-19"),
                    ("https://x.test/contact/", "2024-01-01")).endswith("/contact/")
    assert top_page(spark, "phone", ("https://x.test/b/", None),
                    ("https://x.test/a/", None)).endswith("/a/")


def test_link_walk_goes_two_levels_and_stops_at_the_cap(spark):
    site = spark.createDataFrame([("https://x.test/", "User-agent: *\nDisallow: /no")],
                                 "website string, body string")
    links = " ".join(f'<a href="/p{i}">x</a>' for i in range(3))
    deep = " ".join(f'<a href="/d{i}">x</a>' for i in range(30))
    bodies = spark.createDataFrame(
        [("https://x.test", links + '<a href="/no/x">n</a><a href="https://o.test/">o</a>'),
         ("https://x.test/p1", deep), ("https://x.test/d0", '<a href="/deeper">x</a>')],
        "url string, html string")
    got = I.crawl_link_graph(I.site_rules(site), bodies, K.MAX_BFS_PAGES,
                             K.MAX_BFS_DEPTH).orderBy("ord").collect()
    assert [r["url"].rsplit("/", 1)[1] for r in got] == [
        "x.test", "p0", "p1", "p2"] + [f"d{i}" for i in range(8)]
    # Without budgets the walk goes on until nothing is new.
    whole = I.crawl_link_graph(I.site_rules(site), bodies)
    assert whole.count() == 35 and whole.filter("url LIKE '%/deeper' AND depth = 3").count() == 1


def test_sitemap_budget(spark):
    site = spark.createDataFrame([("https://x.test/", "Sitemap: https://x.test/a.xml")],
                                 "website string, body string")
    urls = "".join(f"<url><loc>https://x.test/{i}</loc></url>" for i in range(10))
    bodies = spark.createDataFrame([("https://x.test/a.xml", f"<urlset>{urls}</urlset>")],
                                   "url string, body string")
    rules = I.site_rules(site)
    assert I.crawl_sitemaps(rules, bodies).count() == 10
    few = I.crawl_sitemaps(rules, bodies, max_urls=4).collect()
    assert sorted(r["url"][-1] for r in few) == ["0", "1", "2", "3"]
    urls = "".join(f"<url><loc>https://x.test/{i}</loc></url>" for i in range(4000))
    long = spark.createDataFrame([("https://x.test/a.xml", f"<urlset>{urls}</urlset>")],
                                 "url string, body string")
    assert I.crawl_sitemaps(rules, long).count() == 4000


def test_sitemap_bodies_are_not_broadcast(spark, monkeypatch):
    """Plans over small files promised small bodies, which then met in the driver."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(I, "cut_lineage", noted)
    site = spark.createDataFrame([("https://x.test/", "Sitemap: https://x.test/a.xml")],
                                 "website string, body string")
    bodies = spark.createDataFrame([("https://x.test/a.xml", "<loc>https://x.test/1</loc>")],
                                   "url string, body string")
    got = I.crawl_sitemaps(I.site_rules(site), bodies).collect()
    assert [r["url"] for r in got] == ["https://x.test/1"]
    assert plans and not any("Broadcast" in p for p in plans)


def test_pages_to_read_are_fetched_once(spark, monkeypatch):
    """Every reading position joined all pages of all sites again."""
    from attestry.plans.adapters import Tables
    from attestry.plans.pipeline import DirectoryRun

    def t(rows, schema):
        return spark.createDataFrame(rows, schema)

    tables = Tables(spark, "/nowhere")
    tables.__dict__["directory"] = None
    tables._cache["listing"] = t([(1, "https://www.org1.org/")], "id long, website string")
    run = DirectoryRun(tables)
    base = [(1, "https://www.org1.org/", f"https://www.org1.org/{p}", None, 7, 1, 2.0, "N", "F",
             0.0, 0.05, "ALGERIA", 3, "AFRICA", "soup", 10, 5.0, 4) for p in ("", "contact/")]
    run.__dict__["site_rows"] = t(base, """listing_id long, website string, url string,
        lastmod string, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string,
        l_linestatus string, l_discount double, l_tax double, n_name string, n_nationkey int,
        r_name string, p_name string, o_custkey long, o_totalprice double, o_orderkey long""")
    got = {r["url"][21:]: r["text"] for r in run.gather(tables.listing).collect()}
    assert set(got) == {"", "contact/"}, got
    assert all(v.startswith("Welcome to part 7.") for v in got.values()), got
    asked = run.texts(t([b[:1] + (1,) + b[2:3] + b[4:] for b in base[:1]], """listing_id long,
        pos int, url string, l_partkey long, l_suppkey long, l_quantity double,
        l_returnflag string, l_linestatus string, l_discount double, l_tax double, n_name string,
        n_nationkey int, r_name string, p_name string, o_custkey long, o_totalprice double,
        o_orderkey long"""))
    assert "Join" not in asked._jdf.queryExecution().optimizedPlan().toString()


def small_tables(spark):
    """Tables of a few rows; a part, an order and a line come twice, some keys are null."""
    import datetime

    from attestry.plans.adapters import Tables

    t, day = Tables(spark, "/nowhere"), datetime.datetime(2000, 1, 2)
    t.__dict__["directory"] = None

    def keep(name, rows, schema):
        t._cache[name] = spark.createDataFrame(rows, schema)

    keep("region", [(0, "AFRICA")], "r_regionkey int, r_name string")
    keep("nation", [(3, "ALGERIA", 0)], "n_nationkey int, n_name string, n_regionkey int")
    keep("customer", [(10, 3), (11, 3), (None, 3)], "c_custkey long, c_nationkey int")
    keep("part", [(7, "soup"), (7, "soup"), (8, "bread"), (None, "none")],
         "p_partkey long, p_name string")
    keep("orders", [(1, 10, "O", 5.0, "1-URGENT"), (2, 11, "F", 6.0, "5-LOW"),
                    (3, 11, "O", 7.0, "1-URGENT"), (3, 10, "O", 7.0, "1-URGENT"),
                    (None, 10, "F", 8.0, "1-URGENT")],
         "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
         "o_orderpriority string")
    keep("lineitem", [(o, p, 5, n, 2.0, 0.0 if n == 4 else 0.05, 0.02, "N", s, day)
                      for o in (1, 2, 3, None) for p in (7, 8, None)
                      for n, s in ((2, "O"), (4, "F"), (7, "O"), (7, "O"))],
         "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
         "l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
         "l_shipdate timestamp")
    return t


def test_lines_are_moved_by_part_and_order_only(spark):
    """Lines were shuffled by order, customer, part, website and listing, wider each time."""
    from collections import Counter

    from attestry.plans.adapters import VIEWS
    from attestry.plans.pipeline import DirectoryRun

    tables = small_tables(spark)
    deps, sql = VIEWS["page_row"]
    plain = spark.sql(sql, **{d: tables._cache[d] for d in deps})
    assert plain.count() > 20
    assert Counter(tables.page_row.select(*plain.columns).collect()) == Counter(plain.collect())

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = DirectoryRun(tables).site_rows
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = Counter((r["listing_id"], r["url"]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"hashpartitioning\((\w+)#", plan)
    assert "listing_id" not in moved, plan
    assert moved.count("l_partkey") == moved.count("l_orderkey") == 1, plan
    # Order 1 bars /news and order 2 all paths; a partner's pages are not the site's own.
    want = Counter()
    for r in tables.page.collect():
        barred = r["listing_id"] == 2 or "/news" in r["url"]
        if "partner" not in r["url"] and not barred:
            want[r["listing_id"], r["url"]] += 1
    assert got == want and len(want) > 2


def test_captures_meet_their_pages_by_listing(spark):
    """All pages were shuffled again by listing and URL."""
    tables = small_tables(spark)
    pages = [(r["listing_id"], r["url"]) for r in tables.page.collect()]
    wanted = [pages[0], pages[0], pages[-1], (1, "https://www.org1.org/none"), (1, None)]
    found = tables.captures(spark.createDataFrame(wanted, "listing_id long, url string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(listing_id#\d+L?, url", plan), plan
    want = sorted(2 * [p for p in pages if p in wanted])
    assert sorted((r["listing_id"], r["url"]) for r in found.collect()) == want


def test_ranked_pages_keep_their_columns(spark):
    rows = [(1, f"https://x.test/{p}", None, n) for n, p in enumerate(("contact", "a/b/c", "b"))]
    pages = spark.createDataFrame(rows, "listing_id long, url string, lastmod string, n int")
    got = I.rank_pages(pages, ("phone",), "2002-01-01T00:00:00Z", None, key="listing_id",
                       keep=["n"]).collect()
    assert sorted((r["rank"], r["n"]) for r in got) == [(1, 0), (2, 2), (3, 1)]


def test_closure_phrases_are_searched_once_and_where_they_can_be(spark):
    """The phrases were looked for in the whole text, once to filter and once to keep."""
    from attestry.functions.text import closure_span

    long = "soup and bread, " * 40
    rows = [(long + "We are permanently closed. " + long, "permanently closed"),
            (long + "\u0130\u0130 Our shop has closed" + long, "has closed"),
            ("We\u2019ve moved. We've moved" + long, "We've moved"), (long, None), ("", None)]
    pages = spark.createDataFrame([(i, 1, "u", None, s) for i, (s, _) in enumerate(rows)], PAGES)
    found = E.closure_findings(pages)
    assert {r["listing_id"]: r["live"] for r in found.collect()} == {
        i: live for i, (_, live) in enumerate(rows) if live}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1, plan
    spans = [r["s"] for r in pages.orderBy("listing_id").select(
        closure_span(F.col("text")).alias("s")).collect()]
    assert spans[0] == "permanently closed" and spans[3:] == ["", ""]


def test_hours_are_searched_where_a_word_is(spark):
    from attestry.functions.text import shows_hours

    rows = [("OPEN daily", True), ("Mon-Fri", True), ("common", False), ("opened", False),
            ("", False), (None, None)]
    got = spark.createDataFrame(rows, "text string, shown boolean").select(
        "shown", shows_hours(F.col("text")).alias("got")).collect()
    assert all(r["shown"] == r["got"] for r in got)


def test_pages_without_closure_words_are_not_searched(spark):
    rows = [("A shop.", 0), ("We HAVE moved away.", 1), ("It is Permanently Closed now.", 1),
            ("We've moved. Out of business.", 2), (None, None)]
    got = spark.createDataFrame(rows, "text string, n int").select(
        "n", F.when(F.col("text").isNotNull(), F.size(E.closure_hits(F.col("text")))).alias("m"),
        E.raw_digits(F.lit(" 4-1 5.x")).alias("d")).collect()
    assert all(r["n"] == r["m"] and r["d"] == "415" for r in got)


# ---------------------------------------------------------------- graph

def brute_siblings(edges):
    by_key = {}
    for o, k in edges:
        by_key.setdefault(k, set()).add(o)
    out = {}
    for o, k in edges:
        out.setdefault(o, set()).update(by_key[k] - {o})
    return {o: len(s) for o, s in out.items() if s}


def test_sibling_counts_match_brute_force(spark):
    rnd = random.Random(5)
    # One key holds a third of the organisations, one organisation holds many keys.
    edges = {(f"org:{i}", f"tel:{rnd.randrange(40)}") for i in range(120) for _ in range(2)}
    edges |= {(f"org:{i}", "tel:hot") for i in range(40)}
    edges |= {("org:0", f"tel:{k}") for k in range(14)}
    nodes = spark.createDataFrame([(f"org:{i}", "org", str(i), None) for i in range(120)],
                                  "id string, kind string, name string, value string")
    g = G.Graph(nodes, spark.createDataFrame(
        [(o, k, "reachable_at") for o, k in edges], "src string, dst string, rel string"))
    for light in (64, 8, 2, 0):
        got = {r["org_id"]: r["n_siblings"] for r in G.sibling_counts(g, light).collect()
               if r["n_siblings"]}
        assert got == brute_siblings(edges)


def test_sibling_counts_with_many_keys_and_a_shared_switchboard(spark):
    edges = {(f"org:{i}", "tel:hot") for i in range(0, 90, 3)}
    for o, n in ((0, 3), (1, 8), (2, 9), (3, 30), (4, 30)):
        edges |= {(f"org:{o}", f"tel:{k}") for k in range(n)}
    edges |= {(f"org:{50 + k}", f"tel:{k}") for k in range(30)}
    nodes = spark.createDataFrame([(f"org:{i}", "org", str(i), None) for i in range(90)],
                                  "id string, kind string, name string, value string")
    g = G.Graph(nodes, spark.createDataFrame(
        [(o, k, "reachable_at") for o, k in edges], "src string, dst string, rel string"))
    for light in (64, 4):
        got = {r["org_id"]: r["n_siblings"] for r in G.sibling_counts(g, light).collect()
               if r["n_siblings"]}
        assert got == brute_siblings(edges)


@pytest.mark.parametrize("bucket", [1 << 14, 4])
def test_sibling_counts_when_many_hot_keys_are_shared(spark, monkeypatch, bucket):
    """Subsets of thirty shared keys would be a thousand million rows."""
    monkeypatch.setattr(G, "HALF_BUCKET", bucket)
    rnd = random.Random(8)
    edges = {(f"org:{o}", f"tel:{k}") for o in range(12) for k in range(30) if rnd.random() < 0.9}
    edges |= {(f"org:{o}", f"tel:{k}") for o in (20, 21) for k in range(30)}
    edges |= {("org:21", "tel:own"), ("org:20", "tel:more")}
    # Combinations that several organisations share, and some with a single key.
    edges |= {(f"org:{30 + i}", f"tel:{k}") for i in range(20) for k in (i % 3, 29)}
    edges |= {(f"org:{60 + i}", f"tel:{i % 5}") for i in range(25)}
    nodes = spark.createDataFrame([(f"org:{i}", "org", str(i), None) for i in range(90)],
                                  "id string, kind string, name string, value string")
    g = G.Graph(nodes, spark.createDataFrame(
        [(o, k, "reachable_at") for o, k in edges], "src string, dst string, rel string"))
    for light in (64, 3, 0):
        got = {r["org_id"]: r["n_siblings"] for r in G.sibling_counts(g, light).collect()
               if r["n_siblings"]}
        assert got == brute_siblings(edges)


@pytest.mark.parametrize("few", [0, 1, 2, 5])
def test_sibling_counts_of_narrow_and_wide_key_sets(spark, few):
    rnd = random.Random(few)
    edges = {(f"org:{i}", f"tel:{rnd.randrange(25)}") for i in range(90) for _ in range(3)}
    edges |= {(f"org:{i}", "tel:hot") for i in range(0, 90, 4)}
    edges |= {(f"org:{o}", f"tel:{k}") for o in (3, 4, 7) for k in range(o, 20, 2)}
    g = G.Graph(None, spark.createDataFrame(
        [(o, k, "reachable_at") for o, k in edges], "src string, dst string, rel string"))
    for light in (64, 3):
        got = {r["org_id"]: r["n_siblings"] for r in G.sibling_counts(g, light, few).collect()}
        assert got == brute_siblings(edges)


def test_sibling_counts_list_no_pairs_of_small_key_sets(spark, monkeypatch):
    """Sixty organisations behind each address made a row per pair of them."""
    monkeypatch.setattr(G, "_holders", None)
    edges = {(f"org:{i}", k) for i in range(600) for k in (f"addr:{i % 10}", f"tel:{i // 4}")}
    g = G.Graph(None, spark.createDataFrame(
        [(o, k, "located_at") for o, k in edges], "src string, dst string, rel string"))
    got = {r["org_id"]: r["n_siblings"] for r in G.sibling_counts(g).collect()}
    assert got == brute_siblings(edges)


def test_reading_stops_where_a_listing_is_settled(spark):
    """Listings settled early cost no further text; a missing page settles nothing."""
    fill = " Some words that make the page long enough to be read at all."
    texts = {"shut": "We are permanently closed." + fill, "tel": "Call 415-555-0100." + fill,
             "open": "Open Monday to Friday." + fill, "dull": fill * 2, "short": "415-555-0100"}
    wanted = [(1, 1, "shut"), (1, 2, "tel"), (2, 1, "tel"), (2, 2, "open"), (2, 3, "dull"),
              (3, 1, "none"), (3, 2, "dull"), (3, 3, "shut"), (4, 1, "short"), (4, 2, "tel")]
    pages = spark.createDataFrame(list(texts.items()), "url string, text string")
    asked = []

    def read(frontier):
        asked.append(sorted((r.listing_id, r.url) for r in frontier.collect()))
        return frontier.join(pages, "url", "left")

    candidates = spark.createDataFrame(wanted, "listing_id bigint, pos int, url string")
    got = I.gather_evidence(candidates, read, 3)
    assert asked == [[(1, "shut"), (2, "tel"), (3, "none"), (4, "short")],
                     [(2, "open"), (3, "dull"), (4, "tel")], [(3, "shut")]]
    assert {(r.listing_id, r.pos): r.usable for r in got.collect()} == {
        (1, 1): True, (2, 1): True, (2, 2): True, (3, 1): False, (3, 2): True, (3, 3): True,
        (4, 1): False, (4, 2): True}
    asked.clear()
    assert I.gather_evidence(candidates, read, None).count() == 8 and len(asked) == 3


def test_pages_are_scanned_once_and_no_text_is_moved(spark):
    from attestry.plans import catalog

    known = catalog.load()
    for name in ("j01", "j04"):
        df = catalog.runner(known[name])(spark, "/root/testdata/sf0.001")
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        assert sum("FileScan" in x and "lineitem" in x for x in lines) == 1, name
        at = [i for i, x in enumerate(lines) if "Welcome to part" in x and "Project" in x]
        # Every exchange of pages lies below the place where their text is made.
        assert at and all(i > at[0] for i, x in enumerate(lines) if "REPARTITION_BY_COL" in x), name


def graph(spark):
    d = directory(
        spark, [org(1, "A"), org(2, None), org(3, "A"), org(4, "B")],
        phone=[(1, 0, 1, "415-555-0001", None, None), (2, 0, 2, "(415) 555-0001 x 5", None, None),
               (3, 0, 3, "415 555 0003", None, None), (4, 0, 4, "+1 415 555 0003", None, None),
               (1, 1, 5, "311", None, None)],
        address=[(1, 0, "1 Main St.", "Oakland", "CA", "94601"),
                 (3, 0, "1 MAIN ST", "oakland", "CA", "94601"), (4, 0, " ", None, None, None)],
        service=[(1, 10, "Food"), (2, 10, "Food too"), (3, 11, "Beds")],
        svc_cat=[(10, 7, "Meals")], cat=[(4, 7, "Meals")])
    return G.build(d)


def test_graph_build_and_contradictions(spark):
    g = graph(spark)
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert nodes["svc:10"]["name"] == "Food"
    assert "tel:4155550001" in nodes and "addr:1 main st oakland 94601" in nodes
    assert not any(n.startswith("tel:311") for n in nodes)
    got = {(r["shared"], r["n_orgs"]) for r in G.contradictions(g).collect()}
    # A missing name is a value of its own; two listings of one name are no contradiction.
    assert got == {("4155550001", 2), ("4155550003", 2)}


def test_doubt_walks_back_to_its_seed(spark):
    seeds = spark.createDataFrame([("org:1",)], "id string")
    for fn in (G.propagate, G.propagate_incremental):
        got = {r["id"]: r["score"] for r in fn(graph(spark), seeds, hops=2).collect()}
        assert got == {"svc:10": 0.5, "org:2": 0.25, "org:1": 0.25}


def test_subgraph_cap_and_pins(spark):
    g = graph(spark)
    focus = spark.createDataFrame([("org:1",)], "id string")
    pins = spark.createDataFrame([("org:4", 1), ("gone:1", 2)], "id string, pos int")
    s = G.subgraph(g, focus, hops=2, cap=3, pinned=pins)
    order = [r["id"] for r in s.nodes.orderBy("pos").collect()]
    assert order[:2] == ["org:4", "org:1"] and len(order) == 3
    assert s.truncated.first()["truncated"]
    whole = G.subgraph(g, focus, hops=2, cap=300)
    assert not whole.truncated.first()["truncated"]
    ids = {r["id"] for r in whole.nodes.collect()}
    for r in whole.edges.collect():
        assert r["source"] in ids and r["target"] in ids


# ---------------------------------------------------------------- calibration

def brute_auroc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def test_calibration_metrics_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([rnd.random(), rnd.randrange(11) / 10, 1.0]), rnd.random() < .4)
            for _ in range(400)]
    df = spark.createDataFrame([("s", s, y) for s, y in rows],
                               "scorer string, support double, truth boolean")
    assert abs(CA.auroc(df, ["scorer"]).first()["auroc"] - brute_auroc(rows)) < 1e-12
    swept = {round(r["threshold"], 2): r for r in CA.sweep(df, ["scorer"]).collect()}
    assert len(swept) == 101
    for i in range(101):
        t = i / 100
        assert swept[t]["tp"] == sum(1 for s, y in rows if s >= t and y)
        assert swept[t]["fp"] == sum(1 for s, y in rows if s >= t and not y)
        assert swept[t]["fn"] == sum(1 for s, y in rows if s < t and y)
    total = 0.0
    for b in range(10):
        inside = [(s, y) for s, y in rows if b / 10 <= s < (b + 1) / 10 or (b == 9 and s == 1.0)]
        if inside:
            conf = sum(s for s, _ in inside) / len(inside)
            acc = sum(y for _, y in inside) / len(inside)
            total += len(inside) / len(rows) * abs(conf - acc)
    assert abs(CA.ece(df, ["scorer"]).first()["ece"] - total) < 1e-9
    one_class = df.filter("truth")
    assert CA.auroc(one_class, ["scorer"]).first()["auroc"] is None


def test_threshold_is_the_middle_of_the_plateau(spark):
    rows = [("s", 0.9, True)] * 5 + [("s", 0.1, False)] * 5
    df = spark.createDataFrame(rows, "scorer string, support double, truth boolean")
    got = CA.choose_threshold(CA.sweep(df, ["scorer"]), ["scorer"]).first()
    plateau = [i / 100 for i in range(11, 91)]
    assert got["threshold"] == plateau[len(plateau) // 2]


def test_split_is_disjoint_and_halves(spark):
    df = spark.createDataFrame([(i % 101,) for i in range(1000)], "org_id int")
    halves = CA.split_by_org(df)
    n = {r["half"]: r["count"] for r in halves.groupBy("half").count().collect()}
    assert n == {"calibration": 50, "test": 51}
    assert halves.exceptAll(CA.split_by_org(df)).count() == 0


# ---------------------------------------------------------------- freshness

def test_freshness_rollup_and_next_action(spark):
    d = directory(
        spark,
        [org(1, verified_at=AS_OF), org(2, updated_at=AS_OF, website="https://x"),
         org(3, status=None), org(4, verified_at="junk", certified_at=AS_OF, updated_at=AS_OF)],
        phone=[(2, 0, 1, "311", None, None)])
    conf = spark.createDataFrame([(2, "phone", AS_OF)], "listing_id bigint, field string, "
                                                        "confirmed_at string")
    got = {r["id"]: r for r in FR.rollup(FR.field_scores(d, AS_OF, conf)).collect()}
    assert got[1]["freshness"] == 100.0 and got[1]["coverage"] == 1.0
    assert got[1]["next"] is None
    # phone 90 x .25, status 40 x .15, website 40 x .08
    assert got[2]["freshness"] == round((22.5 + 6 + 3.2) / .48, 1)
    assert got[2]["next"]["field"] == "status"
    assert got[3]["freshness"] == 0.0 and got[3]["band"] == "expired"
    # An unreadable first date hides the second one.
    assert got[4]["freshness"] == 40.0


def test_upper_median(spark):
    df = spark.createDataFrame([(i, float(v), "stale") for i, v in enumerate([1, 2, 3, 4])],
                               "id int, freshness double, band string")
    assert FR.report(df).first()["median_freshness"] == 3.0


def test_match_without_fields_confirms_three(spark):
    df = spark.createDataFrame([(1, []), (2, ["address"])], "listing_id int, fields array<string>")
    got = FR.match_confirmations(df, F.lit("now")).collect()
    assert sorted((r["listing_id"], r["field"]) for r in got) == [
        (1, "address"), (1, "phone"), (1, "schedule"), (2, "address")]


def test_positions_split_a_shared_priority_and_prefix(spark):
    rows = [(f"resource-{i:05d}", 1.5) for i in range(3000)] + [("a", 9.0), ("b", 0.1), ("c", None)]
    df = spark.createDataFrame(rows, "resource_id string, priority double").repartition(7)
    got = {r["resource_id"]: r["position"] for r in R.positions(df).collect()}
    assert got["a"] == 1 and got["b"] == 3002 and got["c"] == 3003
    assert [got[f"resource-{i:05d}"] for i in range(3000)] == list(range(2, 3002))
    assert R.positions(df.limit(0)).count() == 0


def test_next_open_review_passes_over_settled_and_skipped(spark):
    df = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)],
                               "resource_id string, priority double")
    ids = "resource_id string"
    got = R.open_positions(df, spark.createDataFrame([("x",)], ids),
                           spark.createDataFrame([("y",)], ids)).collect()
    assert {r["resource_id"]: (r["position"], r["is_next"]) for r in got} == {
        "x": (1, False), "y": (2, False), "z": (3, True)}


def test_weights_sum_to_one():
    assert abs(sum(K.WEIGHT.values()) - 1) < 1e-12


def test_scores_are_not_written_out_in_a_filter_on_them(spark):
    d = directory(spark, [org(1, verified_at=AS_OF), org(2, updated_at=AS_OF, website="https://x")],
                  phone=[(2, 0, 1, "311", None, None)])
    told = FR.rollup(FR.field_scores(d, AS_OF)).filter("next IS NOT NULL").select("id", "next.field")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bround(") <= 4 * len(FR.FIELDS)
    assert plan.count("try_cast(updated_at") <= 2
    assert [(r["id"], r["field"]) for r in told.collect()] == [(2, "phone")]


def test_both_choices_come_from_one_table_of_tiers(spark):
    df = spark.createDataFrame(
        [(1, "direct", "a" * 250, None), (1, "reader", "b" * 300, None),
         (2, "direct", None, "down"), (2, "reader", None, None)],
        "id bigint, method string, text string, error string")
    _, longest, _ = E.best_of_tiers(longest=True)
    got = {r["id"]: r[1:] for r in E.capture_tiers(df, ["id"]).select(
        "id", *E.best_of_tiers(), longest.alias("longest")).collect()}
    assert got == {1: ("a" * 250, "direct", None, "reader"), 2: (None, None, "down", None)}
