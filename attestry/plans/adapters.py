"""Directory-shaped tables derived from the star-schema test tables.

Every view is one SELECT in the dialect Spark and DuckDB share, so a query and
its SQL check read the same rows. An order stands for a listing, its lines for
pages of the listing's site and for the services it offers.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2002-01-01T00:00:00Z"
EVENTS_AS_OF = "2024-02-01T00:00:00Z"

_DAY = "CAST(CAST({0} AS DATE) AS STRING)"
_DIGITS = "'415' || lpad(CAST(o.o_custkey AS STRING), 7, '0')"
_MID = "substr(lpad(CAST(o.o_custkey AS STRING), 7, '0'), 1, 3)"
_END = "substr(lpad(CAST(o.o_custkey AS STRING), 7, '0'), 4, 4)"
_SITE = "'https://www.org' || CAST(o.o_orderkey AS STRING) || '.org/'"
_STREET = (
    "CAST(CAST(floor(o.o_totalprice / 100) AS BIGINT) AS STRING) || ' ' || n.n_name || ' St.'"
)
_ZIP = "CAST(94000 + n.n_nationkey AS STRING)"
_TAX = "CAST(round(l.l_tax * 100) AS INT)"
_DISC = "CAST(round(l.l_discount * 100) AS INT)"
_SLUG = """CASE l.l_linenumber WHEN 1 THEN '?v=' WHEN 2 THEN 'contact/' WHEN 3 THEN 'about/hours/'
  WHEN 4 THEN 'services/food/' WHEN 5 THEN '2019/gala-night/' WHEN 6 THEN 'get-help/'
  ELSE 'news/archive/page/3/' END"""
_PAGE_ID = """'p' || CAST(l.l_partkey AS STRING) || 's' || CAST(l.l_suppkey AS STRING) || 'q'
  || CAST(CAST(l.l_quantity AS INT) AS STRING)"""


def _bare(sql: str) -> str:
    """SQL over the tables o, l, n, r, p as SQL over page_row."""
    return re.sub(r"\b[olnrp]\.(?=[olnrp]_)", "", sql)


_PAGE_KEY = _bare(f"""o.o_orderkey AS listing_id, {_SITE} AS website,
  CASE WHEN l.l_linestatus = 'F' AND {_DISC} = 0 THEN 'https://cdn.partner.org/' ELSE {_SITE} END
    || {_SLUG} || {_PAGE_ID} AS url,
  CASE WHEN l.l_linestatus = 'O' THEN {_DAY.format('l.l_shipdate')} ELSE NULL END AS lastmod""")
_PAGE_TEXT = _bare(f"""'Welcome to part ' || CAST(l.l_partkey AS STRING) || '. '
  || CASE WHEN l.l_returnflag = 'A' THEN 'Call us on 415.' || {_MID} || '.' || {_END} || '. '
          WHEN l.l_returnflag = 'N' THEN 'Call (628) ' || lpad(CAST(l.l_suppkey AS STRING), 3, '0')
            || '-' || lpad(CAST(l.l_partkey AS STRING), 4, '0') || ' for help. '
          ELSE '' END
  || CASE WHEN {_TAX} = 1 THEN 'The director relocated to the coast last spring. '
          WHEN {_TAX} = 2 AND l.l_linestatus = 'F' THEN 'Our office has closed for the season. '
          WHEN {_TAX} = 3 AND l.l_linestatus = 'F' THEN 'This pantry is permanently closed. '
          WHEN {_TAX} = 4 THEN 'var cfg = app.events.modal; has closed => flag. ' ELSE '' END
  || CASE WHEN {_DISC} > 6 THEN 'Visit ' || {_STREET} || ', ' || r.r_name || ' ' || {_ZIP} || '. '
          WHEN {_DISC} > 4 THEN 'Serving ' || r.r_name || '. ' ELSE '' END
  || CASE WHEN {_TAX} > 5 THEN 'Open Monday to Friday. ' ELSE '' END
  || repeat('We offer ' || p.p_name || ' support. ', CAST(l.l_quantity AS INT))""")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "listing": (("orders", "customer", "nation"), f"""
SELECT o.o_orderkey AS id,
  CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal > 7000 THEN c.c_mktsegment
       ELSE c.c_name || ' ' || o.o_orderpriority END AS name,
  CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'inactive' ELSE 'approved' END AS status,
  CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'O' THEN NULL
       ELSE {_SITE} END AS website,
  CASE WHEN n.n_nationkey < 10 THEN lower(c.c_mktsegment) || '@example.org'
       WHEN n.n_nationkey < 15 THEN ' ' ELSE NULL END AS email,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority IN ('1-URGENT', '3-MEDIUM')
         THEN {_DAY.format('o.o_orderdate')} || 'T00:00:00Z'
       WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '5-LOW' THEN 'unknown'
       ELSE NULL END AS verified_at,
  CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '2-HIGH'
       THEN {_DAY.format('o.o_orderdate')} || 'T00:00:00Z' ELSE NULL END AS certified_at,
  (o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW') AS certified,
  {_DAY.format('o.o_orderdate')} || 'T12:00:00+00:00' AS updated_at,
  c.c_acctbal > 3000 AS hours_known,
  CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Emergency Housing' WHEN 'FURNITURE'
       THEN 'Food Pantry' ELSE c.c_mktsegment END AS category_names
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey"""),
    "phone": (("orders",), f"""
SELECT o.o_orderkey AS listing_id, 0 AS pos, o.o_orderkey * 2 AS phone_id,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN '(415) ' || {_MID} || '-' || {_END}
       WHEN o.o_orderpriority = '2-HIGH' THEN '415.' || {_MID} || '.' || {_END} || ' ext. 105'
       WHEN o.o_orderpriority = '3-MEDIUM' THEN '+1 415 ' || {_MID} || ' ' || {_END}
       WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'F' THEN ''
       WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'O' THEN NULL
       WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'P' THEN {_DIGITS} || '2383'
       WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'O' THEN '311'
       ELSE {_DIGITS} END AS number,
  CASE WHEN o.o_orderpriority = '2-HIGH' THEN 'TTY'
       WHEN o.o_orderpriority = '3-MEDIUM' THEN 'Voice'
       WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'F'
         THEN '(415) ' || {_MID} || '-' || {_END}
       WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN ' ' ELSE NULL END AS service_type,
  CASE WHEN o.o_orderpriority = '3-MEDIUM' AND o.o_orderstatus = 'O' THEN 'CH'
       WHEN o.o_orderstatus = 'F' THEN NULL ELSE 'US' END AS country_code
FROM {{orders}} o
UNION ALL
SELECT o.o_orderkey AS listing_id, 1 AS pos, o.o_orderkey * 2 + 1 AS phone_id,
  '510-' || substr(lpad(CAST(CAST(floor(o.o_totalprice / 10) AS BIGINT) AS STRING), 7, '0'), 1, 3)
  || '-' || substr(lpad(CAST(CAST(floor(o.o_totalprice / 10) AS BIGINT) AS STRING), 7, '0'), 4, 4)
    AS number,
  'Fax' AS service_type, 'US' AS country_code
FROM {{orders}} o WHERE o.o_orderstatus = 'P'"""),
    "address": (("orders", "customer", "nation", "region"), f"""
SELECT o.o_orderkey AS listing_id, 0 AS pos,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN '' ELSE {_STREET} END AS address_1,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE r.r_name END AS city,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN ' ' ELSE 'CA' END AS state_province,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE {_ZIP} END AS postal_code
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey"""),
    "service": (("lineitem", "part"), """
SELECT DISTINCT l.l_orderkey AS listing_id, l.l_partkey AS service_id, p.p_name AS name
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey"""),
    "service_category": (("part",), """
SELECT p.p_partkey AS service_id, CAST(p.p_size AS BIGINT) AS category_id,
  'size ' || CAST(p.p_size AS STRING) AS name FROM {part} p"""),
    "listing_category": (("orders", "customer"), """
SELECT o.o_orderkey AS listing_id,
  CAST(CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 101 WHEN 'BUILDING' THEN 102
    WHEN 'FURNITURE' THEN 103 WHEN 'HOUSEHOLD' THEN 104 ELSE 105 END AS BIGINT) AS category_id,
  CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'Emergency Housing' WHEN 'FURNITURE'
    THEN 'Food Pantry' ELSE c.c_mktsegment END AS name
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey"""),
    "schedule_day": (("lineitem",), """
SELECT l.l_orderkey AS listing_id, CAST(l.l_linenumber AS STRING) AS day,
  CAST(l.l_quantity AS INT) * 48 AS opens_at, CAST(l.l_suppkey % 24 AS INT) * 100 AS closes_at
FROM {lineitem} l WHERE l.l_returnflag = 'N'"""),
    # A page before its columns are put together: what they are made of.
    "page_row": (("lineitem", "orders", "customer", "nation", "region", "part"), """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, n.n_name, n.n_nationkey, r.r_name, p.p_name,
  l.l_linenumber, l.l_linestatus, l.l_returnflag, l.l_discount, l.l_tax, l.l_quantity,
  l.l_partkey, l.l_suppkey, l.l_shipdate
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN {part} p ON l.l_partkey = p.p_partkey"""),
    "page": (("page_row",), f"SELECT {_PAGE_KEY}, {_PAGE_TEXT} AS text FROM {{page_row}}"),
    # The same pages as two capture tiers: a direct read that is often a shell,
    # and a rendered one that sometimes fails.
    "capture": (("page",), """
SELECT listing_id, url, 'direct' AS method,
  CASE WHEN length(text) > 700 THEN text WHEN length(text) > 300 THEN substr(text, 1, 60)
       ELSE NULL END AS text,
  CASE WHEN length(text) > 300 THEN NULL ELSE 'direct fetch failed' END AS error
FROM {page}
UNION ALL
SELECT listing_id, url, 'reader' AS method,
  CASE WHEN length(text) > 150 THEN text ELSE NULL END AS text,
  CASE WHEN length(text) > 150 THEN NULL ELSE 'reader fetch failed' END AS error
FROM {page}"""),
    "robots_body": (("orders",), f"""
SELECT o.o_orderkey AS listing_id, {_SITE} AS website,
  CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F' THEN NULL ELSE
  '# robots' || chr(10) || 'User-agent: *' || chr(10)
  || CASE o.o_orderstatus WHEN 'F' THEN 'Disallow: /2019/  # archive' || chr(10)
       WHEN 'O' THEN 'disallow: /news' || chr(10) || 'Allow: /' || chr(10)
       ELSE 'Disallow:' || chr(10) END
  || CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_orderstatus = 'F'
       THEN 'Disallow: /' || chr(10) ELSE '' END
  || 'User-agent: otherbot' || chr(10) || 'Disallow: /contact/' || chr(10)
  || CASE WHEN o.o_orderpriority <> '3-MEDIUM' THEN 'Sitemap: ' || {_SITE} || 'index.xml' || chr(10)
       ELSE '' END END AS body
FROM {{orders}} o"""),
    # An index per site that names one sitemap per line number, and those sitemaps.
    "sitemap_body": (("orders", "page"), f"""
SELECT o.o_orderkey AS listing_id, {_SITE} AS website, {_SITE} || 'index.xml' AS url,
  '<sitemapindex><sitemap><loc><![CDATA[' || {_SITE} || 'sm-contact.xml]]></loc></sitemap>'
  || '<sitemap><loc>' || {_SITE} || 'sm-other.xml</loc></sitemap>'
  || '<sitemap><loc>https://cdn.partner.org/sm.xml</loc></sitemap></sitemapindex>' AS body
FROM {{orders}} o
UNION ALL
SELECT listing_id, website, website || 'sm-contact.xml' AS url,
  '<urlset><url><loc>' || min(url) || '</loc><lastmod>' || coalesce(min(lastmod), 'soon')
  || 'T06:00:00Z</lastmod></url><URL><LOC> <![CDATA[' || max(url) || ']]> </LOC></URL></urlset>'
  AS body
FROM {{page}} GROUP BY listing_id, website
UNION ALL
SELECT listing_id, website, website || 'sm-other.xml' AS url,
  '<loc>' || max(url) || '</loc><loc>' || website || 'extra/</loc>' AS body
FROM {{page}} WHERE lastmod IS NULL GROUP BY listing_id, website"""),
    "work_list": (("lineitem", "part", "orders"), f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS row_no,
  CAST(l.l_partkey AS STRING) AS service_id,
  CASE WHEN l.l_returnflag = 'R' THEN ' ' ELSE p.p_name END AS service_name,
  CASE WHEN l.l_linestatus = 'F' AND {_DISC} = 0 THEN 'n/a'
       ELSE ' ' || CAST(l.l_orderkey AS STRING) END AS resource_id,
  'org ' || CAST(l.l_orderkey AS STRING) AS resource_name,
  {_SITE} AS resource_website,
  CASE WHEN l.l_returnflag = 'A' THEN 'https://directory.example/edit/'
    || CAST(l.l_orderkey AS STRING) || '/' || CAST(l.l_linenumber AS STRING)
       ELSE '' END AS service_edit_url,
  {_DAY.format('l.l_shipdate')} AS service_updated_at
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey
JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey"""),
    # One freshness field row per event: the listing is a user, the field and the
    # kind of evidence come from the event.
    "event_field": (("events",), """
SELECT event_id, user_id AS listing_id, event_type, ts,
  CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7
    WHEN 0 THEN 'phone' WHEN 1 THEN 'address' WHEN 2 THEN 'schedule' WHEN 3 THEN 'status'
    WHEN 4 THEN 'website' WHEN 5 THEN 'services' ELSE 'email' END AS field
FROM {events}"""),
    # Decisions: who ruled what on which resource, and when.
    "decision": (("events",), """
SELECT CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 1000 + user_id AS STRING)
    AS resource_id,
  CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'reject'
    WHEN 'signup' THEN 'looks_right' WHEN 'click' THEN 'needs_fixing' ELSE 'skip' END AS action,
  'reviewer' || CAST(user_id AS STRING) AS decided_by, ts AS decided_at, event_id AS row_no
FROM {events}"""),
    # Confirmations: a page that agreed with the listing on some field, and when.
    "confirmation": (("lineitem",), f"""
SELECT l.l_orderkey AS listing_id,
  CASE l.l_linenumber WHEN 1 THEN 'phone' WHEN 2 THEN 'address' WHEN 3 THEN 'schedule'
    WHEN 4 THEN 'services' WHEN 5 THEN 'status' WHEN 6 THEN 'website' ELSE 'phone_missing' END
    AS field,
  {_DAY.format('l.l_shipdate')} || 'T00:00:00Z' AS confirmed_at
FROM {{lineitem}} l WHERE l.l_returnflag = 'A'"""),
    # Two probabilities per line, spread over the whole unit square.
    "judged": (("lineitem",), f"""
SELECT l.l_orderkey AS listing_id, CAST(l.l_linenumber AS STRING) AS key,
  l.l_partkey * 100000 + l.l_suppkey * 100 + CAST(l.l_quantity AS INT) AS pos,
  l.l_returnflag AS field, ' Value' || CAST(l.l_suppkey % 5 AS STRING) || ' ' AS stored,
  l.l_quantity / 50.0 AS support, CAST({_TAX} AS DOUBLE) / 8.0 AS contradict
FROM {{lineitem}} l"""),
    # Pages with links: one entry page per host, other pages under their own URL.
    "linked_page": (("pages",), """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS website,
  CASE WHEN page_id = min(page_id) OVER (
         PARTITION BY regexp_extract(url, '^(https?://[^/?#]+)', 1))
       THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) ELSE url END AS url, html
FROM {pages}"""),
    # Scored rows for calibration: does a label follow a score? Several scorers, long.
    "scored": (("documents", "labels", "lineitem"), f"""
SELECT 'letters' AS scorer, 'd' || CAST(d.doc_id AS STRING) AS row_key, d.source AS org_id,
  CASE b.toxic WHEN 1 THEN 'address' ELSE 'phone' END AS field,
  CAST(length(replace(d.text, ' ', '')) AS DOUBLE) / length(d.text) AS support,
  1.0 / (1.0 + CAST(d.n_chars AS DOUBLE) / 1000.0) AS contradict, b.quality = 1 AS truth
FROM {{documents}} d JOIN {{labels}} b ON d.doc_id = b.doc_id
UNION ALL
SELECT 'coarse' AS scorer, 'd' || CAST(d.doc_id AS STRING) AS row_key, d.source AS org_id,
  CASE b.toxic WHEN 1 THEN 'address' ELSE 'phone' END AS field,
  CAST(round(100.0 * length(replace(lower(d.text), 'e', '')) / length(d.text)) AS DOUBLE) / 100.0
    AS support,
  CAST(round(100.0 * length(replace(d.text, 'a', '')) / length(d.text)) AS DOUBLE) / 100.0
    AS contradict, b.quality = 1 AS truth
FROM {{documents}} d JOIN {{labels}} b ON d.doc_id = b.doc_id
UNION ALL
SELECT 'quantity' AS scorer, 'l' || CAST(l.l_orderkey AS STRING) || '/' || {_PAGE_ID} AS row_key,
  'sup' || CAST(l.l_suppkey AS STRING) AS org_id, l.l_linestatus AS field,
  l.l_quantity / 50.0 AS support, CAST({_TAX} AS DOUBLE) / 8.0 AS contradict,
  CASE WHEN l.l_returnflag = 'R' AND {_DISC} = 0 THEN NULL ELSE l.l_quantity > 30
    AND l.l_returnflag <> 'N' END AS truth
FROM {{lineitem}} l
UNION ALL
SELECT 'discount' AS scorer, 'l' || CAST(l.l_orderkey AS STRING) || '/' || {_PAGE_ID} AS row_key,
  'sup' || CAST(l.l_suppkey AS STRING) AS org_id, l.l_linestatus AS field,
  CASE WHEN {_TAX} = 8 THEN NULL ELSE CAST({_DISC} AS DOUBLE) / 10.0 END AS support,
  l.l_quantity / 50.0 AS contradict, {_DISC} > 6 OR l.l_returnflag = 'A' AS truth
FROM {{lineitem}} l"""),
}

# The rows of the view page_row in two parts that meet by order: a line crosses the network by
# its part and by its order only, and what a site's pages share is worked out once per order.
_SITE_ROWS = f"""
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, n.n_name, n.n_nationkey, r.r_name,
  {_SITE} AS site
FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey
JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
JOIN {{region}} r ON n.n_regionkey = r.r_regionkey"""
_LINE_ROWS = """
SELECT l.l_orderkey, p.p_name, l.l_linenumber, l.l_linestatus, l.l_returnflag, l.l_discount,
  l.l_tax, l.l_quantity, l.l_partkey, l.l_suppkey, l.l_shipdate
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey"""

# The rows of the view capture, a page's two tiers made side by side: pages are read once and
# stay where they are dealt.
def _capture_rows(*keys: str) -> str:
    names = ", ".join(keys)
    return f"""
SELECT {names}, c.method, c.text, c.error FROM (
  SELECT {names}, explode(array(
    struct('direct' AS method,
      CASE WHEN length(text) > 700 THEN text WHEN length(text) > 300 THEN substr(text, 1, 60)
           ELSE NULL END AS text,
      CASE WHEN length(text) > 300 THEN NULL ELSE 'direct fetch failed' END AS error),
    struct('reader' AS method, CASE WHEN length(text) > 150 THEN text ELSE NULL END AS text,
      CASE WHEN length(text) > 150 THEN NULL ELSE 'reader fetch failed' END AS error))) AS c
  FROM {{page}})"""


_CAPTURE_ROWS = _capture_rows("listing_id", "url")


class Tables:
    """The test tables and the views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                deps, sql = VIEWS[name]
                self._cache[name] = self.spark.sql(sql, **{d: getattr(self, d) for d in deps})
            else:
                raise AttributeError(name)
        return self._cache[name]

    def _view(self, sql: str, *names: str) -> DataFrame:
        return self.spark.sql(sql, **{n: getattr(self, n) for n in names})

    @cached_property
    def site_row(self) -> DataFrame:
        """What the pages of an order share, and their website as `site`."""
        return self._view(_SITE_ROWS, "orders", "customer", "nation", "region")

    def rows_of(self, sites: DataFrame) -> DataFrame:
        """Rows of page_row for some rows of site_row, with the columns these carry besides."""
        # Pages are dealt by listing while they are narrow: what follows joins and groups by
        # listing, so no text is moved.
        lines = self._view(_LINE_ROWS, "lineitem", "part").repartition("l_orderkey")
        return lines.join(sites, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")

    @cached_property
    def page_row(self) -> DataFrame:
        return self.rows_of(self.site_row.drop("site"))

    def keyed(self, rows: DataFrame) -> DataFrame:
        return self.spark.sql(f"SELECT *, {_PAGE_KEY} FROM {{page_row}}", page_row=rows)

    @cached_property
    def page_key(self) -> DataFrame:
        """Pages without their text: listing_id, website, url, lastmod and what makes the text."""
        return self.keyed(self.page_row)

    def with_text(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Some rows of page_key with their text."""
        return rows.selectExpr(*columns, f"{_PAGE_TEXT} AS text")

    @cached_property
    def capture(self) -> DataFrame:
        return self.spark.sql(_CAPTURE_ROWS, page=self.page)

    def captures(self, wanted: DataFrame) -> DataFrame:
        """Captures of the wanted pages only, as many as a listing's reading budget.

        wanted: listing_id, url and columns that its captures carry besides.
        """
        # Met by listing, as the pages are dealt.
        columns = [x for x in wanted.columns if x != "listing_id"]
        lists = wanted.groupBy("listing_id").agg(
            F.collect_set(F.struct(*columns)).alias("wanted"))
        rows = self.page_key.drop("lastmod").join(lists, "listing_id").withColumn("w", F.explode(
            F.filter("wanted", lambda w: w["url"] == F.col("url"))))
        made = self.with_text(rows, "listing_id", *[f"w.{x} AS {x}" for x in columns])
        return self.spark.sql(_capture_rows("listing_id", *columns), page=made)

    @cached_property
    def directory(self):
        from attestry.operators.directory import Directory

        return Directory(
            listing=self.listing, phone=self.phone, address=self.address, service=self.service,
            service_category=self.service_category, listing_category=self.listing_category,
            schedule_day=self.schedule_day)
