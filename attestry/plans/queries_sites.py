"""Sites and pages: robots, sitemaps, link walks, ranking, budgets, captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions import urls as U
from attestry.operators import claims as CL
from attestry.operators import evidence as E
from attestry.operators import inventory as I
from attestry.operators import review_queue as R
from attestry.plans.adapters import AS_OF
from attestry.plans.catalog import check_view, query
from attestry.plans.pipeline import DirectoryRun
from attestry.plans.queries_columns import q, sql_domain, sql_path
from attestry.session import dealt, stored

c = F.col


# ---------------------------------------------------------------- robots and sitemaps

_BLOCKED = f"len(list_filter(r.disallow, lambda d: starts_with({sql_path('p.url')}, d))) > 0"


@query("f01", "Pages the robots rules allow", "page rule", f"""
SELECT p.listing_id, p.url FROM page p LEFT JOIN rule r ON p.website = r.website
WHERE NOT coalesce({_BLOCKED}, FALSE)""")
def f01(t):
    rules = I.site_rules(t.robots_body).select("website", "disallow")
    return t.page.join(rules, "website", "left").filter(
        U.robots_allow(c("url"), c("disallow"))).select("listing_id", "url")


@query("j07", "Pages against disallow rules: an anti join on site and path prefix", "page rule", f"""
SELECT p.listing_id, p.url FROM page p JOIN rule r ON p.website = r.website WHERE NOT {_BLOCKED}""")
def j07(t):
    rules = I.site_rules(t.robots_body).select("website", F.explode("disallow").alias("prefix"))
    pages = t.page.select("website", "listing_id", "url", U.url_path(c("url")).alias("path"))
    cond = (pages["website"] == rules["website"]) & F.startswith(pages["path"], rules["prefix"])
    return pages.join(rules, cond, "left_anti").select("listing_id", "url")


@query("f02", "Sites that deny every crawler", "rule", """
SELECT website FROM rule WHERE list_contains(disallow, '/')""")
def f02(t):
    return I.site_rules(t.robots_body).filter(F.array_contains("disallow", "/")).select("website")


@query("j08", "Pages of a listing's own registered domain", "page", f"""
SELECT listing_id, url FROM page WHERE {sql_domain('url')} = {sql_domain('website')}""")
def j08(t):
    pages = t.page.select("listing_id", "url", U.registered_domain(c("url")).alias("domain"))
    sites = t.listing.filter(c("website").isNotNull()).select(
        c("id").alias("listing_id"), U.registered_domain(c("website")).alias("domain"))
    every = sites.unionByName(t.page.select(
        "listing_id", U.registered_domain(c("website")).alias("domain"))).distinct()
    return pages.join(every, ["listing_id", "domain"], "left_semi").select("listing_id", "url")


check_view("child_map", "rule sitemap_entry", f"""
SELECT DISTINCT r.website, e.loc AS child, e.ix FROM (SELECT website, unnest(sitemaps) AS sm
  FROM rule) r JOIN sitemap_entry e ON e.sitemap = r.sm AND e.is_index
WHERE {sql_domain('e.loc')} = {sql_domain('r.website')}""")
check_view("mapped_entry", "child_map sitemap_entry", f"""
SELECT m.website, m.ix AS mx, e.ix, e.loc AS url,
  CASE WHEN e.is_set AND e.ix = 0 THEN e.day END AS lastmod
FROM child_map m JOIN sitemap_entry e ON e.sitemap = m.child
WHERE {sql_domain('e.loc')} = {sql_domain('m.website')}""")
check_view("mapped", "mapped_entry", """
SELECT website, url, max(lastmod) AS lastmod FROM mapped_entry GROUP BY website, url""")


@query("g06", "Pages found through sitemap indexes", "mapped",
       "SELECT website, url, lastmod FROM mapped")
def g06(t):
    return I.crawl_sitemaps(I.site_rules(t.robots_body), t.sitemap_body)


@query("w16", "Sitemap and page budgets per site, in reading order", "mapped_entry", """
SELECT website, url, lastmod FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY ix)
  AS r FROM mapped_entry WHERE mx = 0) WHERE r = 1""")
def w16(t):
    # Five sitemaps are declared or standard, so a budget of six reads one child.
    return I.crawl_sitemaps(I.site_rules(t.robots_body), t.sitemap_body, max_sitemaps=6,
                            max_urls=1)


@query("a14", "Newest date per page across sitemaps", "sitemap_entry", """
SELECT website, loc AS url, max(CASE WHEN is_set AND ix = 0 THEN day END) AS lastmod
FROM sitemap_entry WHERE NOT is_index GROUP BY website, loc""")
def a14(t):
    pages = t.sitemap_body.select("website", F.explode(
        U.parse_sitemap(c("body"))["pages"]).alias("p")).select("website", "p.url", "p.lastmod")
    return I.newest_per_url(pages)


@query("a13", "Page statistics per site", "page", """
SELECT website, count(*) AS pages, count(lastmod) AS with_lastmod, max(lastmod) AS newest_lastmod
FROM page GROUP BY website""")
def a13(t):
    return I.page_stats(t.page)


check_view("walk", "linked_page", f"""
SELECT website, url, 1 + row_number() OVER (PARTITION BY website ORDER BY ix) AS ord FROM (
  SELECT website, u AS url, min(ix) AS ix FROM (
    SELECT website, ix, regexp_replace(CASE WHEN starts_with(h, '/') THEN website || h ELSE h END,
      '#.*$', '') AS u
    FROM (SELECT website, unnest(regexp_extract_all(html, {q(K.HREF_RE)}, 1)) AS h,
      unnest(range(len(regexp_extract_all(html, {q(K.HREF_RE)}, 1)))) AS ix
      FROM linked_page WHERE url = website)
    WHERE NOT regexp_matches(lower(h), '^(mailto:|tel:|javascript:|data:|#)'))
  WHERE {sql_domain('u')} = {sql_domain('website')} AND u <> website GROUP BY website, u)
UNION ALL SELECT DISTINCT website, website, 1 FROM linked_page""")


def _link_rules(t):
    none = F.lit(None).cast("string")
    return I.site_rules(t.linked_page.select("website", none.alias("body")).distinct())


@query("g07", "Breadth-first link walk over captured pages", "walk",
       "SELECT website, url, ord FROM walk")
def g07(t):
    return I.crawl_link_graph(_link_rules(t), t.linked_page).select("website", "url", "ord")


@query("g08", "Site inventory: sitemap, links, none or denied", "rule mapped walk", f"""
SELECT r.website, CASE WHEN list_contains(disallow, '/') THEN 'robots-denied'
    WHEN m.n > 0 THEN 'sitemap' ELSE 'none' END AS method,
  CASE WHEN list_contains(disallow, '/') THEN 0 ELSE coalesce(m.kept, CASE WHEN m.n IS NULL AND
    NOT list_contains(disallow, '/') THEN 1 END, 0) END AS pages
FROM rule r LEFT JOIN (SELECT p.website, count(*) AS n, count(*) FILTER (len(list_filter(r.disallow,
    lambda d: starts_with({sql_path('p.url')}, d))) = 0) AS kept
  FROM mapped p JOIN rule r ON p.website = r.website GROUP BY p.website) m ON r.website = m.website
UNION ALL
SELECT website, CASE WHEN count(*) > 1 THEN 'links' ELSE 'none' END, count(*) FROM walk
GROUP BY website""")
def g08(t):
    none = F.lit(None).cast("string")
    sites = t.robots_body.select("website", "body").unionByName(
        t.linked_page.select("website", none.alias("body")))
    summary, _ = I.site_inventory(sites, t.sitemap_body, t.linked_page)
    return summary.select("website", "method", "pages")


# ---------------------------------------------------------------- ranking and budgets

def sql_rank(source: str, fields, limit: int) -> str:
    """Ranked pages per (listing, field), the score written out per field."""
    words = "w"
    path = sql_path("url")
    depth = "len(list_filter(string_split(path, '/'), lambda x: x <> ''))"
    age = (f"(epoch(TIMESTAMP '{AS_OF[:10]}') - epoch(TRY_CAST(lastmod AS TIMESTAMP))) / 86400.0")
    base = (f"CASE {depth} WHEN 0 THEN 5.0 WHEN 1 THEN 1.0 ELSE 0.0 END "
            f"- 1.5 * greatest(0, {depth} - 2) "
            f"- CASE WHEN regexp_matches(path, {q(K.NOISE_RE)}) THEN 7.0 ELSE 0.0 END "
            f"+ CASE WHEN {age} < 180 THEN 3.0 WHEN {age} < 730 THEN 1.5 ELSE 0.0 END")

    def hints(f):
        arms = []
        for i, h in enumerate(K.SLUG_HINTS[f]):
            parts = ", ".join(q(p) for p in h.split("-"))
            arms.append(f"WHEN list_has_all({words}, [{parts}]) THEN {float(12 - min(i, 6))}")
        return f"CASE {' '.join(arms)} ELSE 0.0 END" if arms else "0.0"

    per = " UNION ALL ".join(
        f"SELECT listing_id, url, lastmod, '{f}' AS field, base + {hints(f)} AS score FROM s"
        for f in fields)
    return f"""
WITH s AS (SELECT listing_id, url, lastmod, path, {base} AS base,
  list_filter(regexp_split_to_array(path, '[/\\-_.]+'), lambda x: x <> '') AS w
  FROM (SELECT listing_id, url, lastmod, lower({path}) AS path FROM {source}))
SELECT listing_id, field, row_number() OVER (PARTITION BY listing_id, field
  ORDER BY score DESC, url) AS rank, url, lastmod, score FROM ({per}) QUALIFY rank <= {limit}"""


check_view("rank_all", "page", sql_rank("page", tuple(K.SLUG_HINTS), K.RANK_LIMIT))


@query("w01", "Page ranking per site and field", "rank_all", """
SELECT listing_id, field, rank, url, CAST(score AS DOUBLE) AS score FROM rank_all""")
def w01(t):
    return I.rank_pages(t.page, tuple(K.SLUG_HINTS), AS_OF, key="listing_id").drop("lastmod")


check_view("site_page", "page rule", f"""
SELECT p.listing_id, p.website, p.url, p.lastmod, p.text FROM page p JOIN rule r
ON p.website = r.website WHERE {sql_domain('p.url')} = {sql_domain('p.website')}
AND NOT {_BLOCKED}""")
check_view("ranked", "site_page", sql_rank("site_page", ("phone", "address", "status"),
                                           K.RANK_LIMIT))
check_view("claim_field", "tclaim", """
SELECT listing_id, field, min((t, p)) AS field_pos FROM tclaim GROUP BY 1, 2""")


def sql_selected(picks: str = "") -> str:
    return f"""
SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY o) AS pos, url, lastmod
FROM (SELECT listing_id, url, min(o) AS o, arg_min(coalesce(lastmod, ''), o) AS lastmod FROM (
  SELECT id AS listing_id, website AS url, NULL AS lastmod, (0, (0, 0), 0) AS o FROM listing
    WHERE website IS NOT NULL
  UNION ALL SELECT r.listing_id, r.url, r.lastmod, (2, f.field_pos, r.rank) FROM ranked r
    JOIN claim_field f ON r.listing_id = f.listing_id AND r.field = f.field WHERE r.rank <= 3
  {picks}) GROUP BY listing_id, url) QUALIFY pos <= {K.MAX_PAGES_PER_ORG}"""


check_view("selected", "listing ranked claim_field", sql_selected())


@query("w02", "Fetch budget per listing", "selected", """
SELECT listing_id, pos, url, nullif(lastmod, '') AS lastmod FROM selected""")
def w02(t):
    run = DirectoryRun(t)
    listed = t.listing.filter(c("website").isNotNull()).select(
        c("id").alias("listing_id"), U.origin(c("website")).alias("origin"))
    return I.select_pages(listed, CL.claim_fields(run.claims), run.ranked)


@query("x04", "A page picker's choices come before the top-up", "listing ranked claim_field",
       sql_selected("""UNION ALL SELECT r.listing_id, r.url, r.lastmod, (1, f.field_pos, 0)
  FROM ranked r JOIN claim_field f ON r.listing_id = f.listing_id AND r.field = f.field
  WHERE r.field = 'address' AND r.rank = 5""").replace(
           "SELECT listing_id, row_number()", "SELECT listing_id, nullif(lastmod, '') AS lastmod, "
           "row_number()", 1).replace("AS pos, url, lastmod", "AS pos, url", 1))
def x04(t):
    from attestry.operators.scorers import picked_pages

    run = DirectoryRun(t)
    listed = t.listing.filter(c("website").isNotNull()).select(
        c("id").alias("listing_id"), U.origin(c("website")).alias("origin"))
    # A stand-in picker: the fifth address page, and 'none' for every other field.
    ranked = dealt(run.ranked, "listing_id", "ranked", moved=False)
    answers = ranked.select("listing_id", "field").distinct().withColumn(
        "choice", F.when(c("field") == "address", "u4").otherwise("none"))
    picks = picked_pages(ranked, answers)
    return I.select_pages(listed, CL.claim_fields(run.claims), ranked, picks=picks)


check_view("candidate", "listing ranked", """
SELECT listing_id, url, row_number() OVER (PARTITION BY listing_id ORDER BY o) AS pos FROM (
SELECT listing_id, url, min(o) AS o FROM (
  SELECT id AS listing_id, rtrim(website, '/') || '/' AS url, 0 AS o FROM listing
    WHERE id IN (SELECT listing_id FROM ranked) AND website IS NOT NULL
  UNION ALL SELECT listing_id, url, rank FROM ranked WHERE field = 'phone' AND rank <= 5
  UNION ALL SELECT id, rtrim(website, '/') || p, o FROM listing, (VALUES (0, ''), (1, '/contact'),
    (2, '/about'), (3, '/hours'), (4, '/visit'), (5, '/locations')) f(o, p)
    WHERE website IS NOT NULL AND id NOT IN (SELECT listing_id FROM ranked))
GROUP BY listing_id, url)""")


def candidates(t):
    run = DirectoryRun(t)
    # Three steps below read the ranking; it is worked out once.
    phone = stored(I.rank_pages(run.site_rows, ("phone",), AS_OF, K.MAX_FETCHES + 2,
                                key="listing_id"), "ranked")
    listed = t.listing.filter(c("website").isNotNull()).select(c("id").alias("listing_id"),
                                                               "website")
    return I.candidate_pages(listed, phone)


@query("w03", "Candidate pages of the rule check", "candidate",
       "SELECT listing_id, pos, url FROM candidate")
def w03(t):
    return candidates(t)


check_view("read_page", "candidate site_page", f"""
SELECT c.listing_id, c.pos, c.url, s.text, coalesce(length(s.text) >= 50, FALSE) AS usable
FROM candidate c LEFT JOIN site_page s ON c.listing_id = s.listing_id AND c.url = s.url
WHERE c.pos <= 3""")
check_view("flagged", "read_page", f"""
SELECT *, coalesce(usable AND regexp_matches(text, {q(K.PHONE_RE)}), FALSE) AS phone_here,
  coalesce(usable AND regexp_matches(text, {q(K.CLOSURE_RE)}), FALSE) AS closure_here,
  coalesce(usable AND regexp_matches(text, {q(K.HOURS_RE)}), FALSE) AS hours_here FROM read_page""")
check_view("gathered", "flagged", """
SELECT * FROM flagged f WHERE NOT (
  EXISTS (SELECT 1 FROM flagged b WHERE b.listing_id = f.listing_id AND b.pos < f.pos
    AND b.closure_here)
  OR (EXISTS (SELECT 1 FROM flagged b WHERE b.listing_id = f.listing_id AND b.pos < f.pos
      AND b.phone_here)
    AND EXISTS (SELECT 1 FROM flagged b WHERE b.listing_id = f.listing_id AND b.pos < f.pos
      AND b.hours_here)))""")


@query("w06", "Pages read before enough was seen", "gathered",
       "SELECT listing_id, pos, url, usable FROM gathered")
def w06(t):
    return DirectoryRun(t).gathered.select("listing_id", "pos", "url", "usable")


@query("a22", "Evidence seen so far, page by page", "flagged", """
SELECT listing_id, pos, max(phone_here) OVER w AS phone_seen, max(closure_here) OVER w
  AS closure_seen, max(hours_here) OVER w AS hours_seen
FROM flagged WINDOW w AS (PARTITION BY listing_id ORDER BY pos)""")
def a22(t):
    from pyspark.sql.window import Window

    # Flags of a page leave, its text does not.
    pages = DirectoryRun(t).read(candidates(t).filter(c("pos") <= K.MAX_FETCHES)).select(
        "listing_id", "pos", *[f.alias(n) for n, f in I.evidence_flags(c("text")).items()])
    upto = Window.partitionBy("listing_id").orderBy("pos")
    return pages.select("listing_id", "pos", *[
        F.max(f"{n}_here").over(upto).alias(f"{n}_seen") for n in ("phone", "closure", "hours")])


@query("f03", "Readable pages per listing at each length", "page", """
SELECT listing_id, count(*) FILTER (length(text) >= 200) AS audit_pages,
  count(*) FILTER (length(text) >= 50) AS verify_pages FROM page GROUP BY listing_id""")
def f03(t):
    return t.page.groupBy("listing_id").agg(
        F.count_if(F.length("text") >= K.MIN_USEFUL_CHARS).alias("audit_pages"),
        F.count_if(F.length("text") >= K.MIN_VERIFY_CHARS).alias("verify_pages"))


@query("f10", "Listings with positive triage", "triaged",
       "SELECT id AS listing_id FROM triaged WHERE triage > 0")
def f10(t):
    return R.triage(t.listing, AS_OF).select(c("id").alias("listing_id"))


@query("w04", "Triage order within the budget", "triaged", """
SELECT id AS listing_id, round(triage, 6) AS triage FROM triaged WHERE triage > 0
ORDER BY triage DESC, id LIMIT 25""")
def w04(t):
    return R.triage(t.listing, AS_OF, K.TRIAGE_BUDGET).select(
        c("id").alias("listing_id"), F.round("triage", 6).alias("triage"))


# ---------------------------------------------------------------- captures

check_view("tiers", "capture", """
SELECT listing_id, url, max(text) FILTER (method = 'direct') AS d,
  max(text) FILTER (method = 'reader') AS r, max(error) FILTER (method = 'direct') AS de,
  max(error) FILTER (method = 'reader') AS re FROM capture GROUP BY 1, 2""")
check_view("best_text", "tiers", """
SELECT listing_id, url, CASE WHEN coalesce(length(d), 0) < 200 AND coalesce(length(r), 0) >= 200
    THEN r ELSE d END AS text,
  CASE WHEN coalesce(length(d), 0) < 200 AND coalesce(length(r), 0) >= 200 THEN 'reader'
    WHEN d IS NOT NULL THEN 'direct' END AS method, coalesce(re, de) AS why FROM tiers""")


@query("e08", "Best capture tier per page, and the longest rendering", "best_text tiers", """
SELECT b.listing_id, b.url, b.method, length(b.text) AS chars,
  CASE WHEN b.text IS NULL THEN b.why END AS error,
  CASE WHEN t.r IS NOT NULL AND (t.d IS NULL OR length(t.r) > length(t.d)) THEN 'reader'
    WHEN t.d IS NOT NULL THEN 'direct' END AS longest
FROM best_text b JOIN tiers t ON b.listing_id = t.listing_id AND b.url = t.url""")
def e08(t):
    keys = ["listing_id", "url"]
    # Tiers are put together once for both choices; a page without a key is none.
    tiers = E.capture_tiers(t.capture.dropna(subset=keys), keys)
    _, longest, _ = E.best_of_tiers(longest=True)
    return tiers.select(*keys, *E.best_of_tiers(), longest.alias("longest")).select(
        *keys, "method", F.length("text").alias("chars"), "error", "longest")


@query("s09", "Captured pages written by method and read back by key", "capture", """
SELECT substr(sha256(method || ':' || url), 1, 24) AS key, method, length(text) AS chars
FROM capture WHERE method = 'reader'""")
def s09(t):
    from attestry.session import scratch_path
    from attestry.sources.stores import read_captures, write_captures

    path = scratch_path(t.spark, "captures")
    write_captures(t.capture, path)
    return read_captures(t.spark, path, "reader").select(
        "key", "method", F.length("text").alias("chars"))
