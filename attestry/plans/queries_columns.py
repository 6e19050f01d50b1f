"""Column jobs over whole tables: contacts, text, URLs, ages and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions import contact as C
from attestry.functions import review as V
from attestry.functions import scoring as SC
from attestry.functions import text as T
from attestry.functions import urls as U
from attestry.operators import claims as CL
from attestry.operators import containment as CN
from attestry.operators import entity_graph as G
from attestry.operators import evidence as E
from attestry.operators import freshness as FR
from attestry.operators import structural as ST
from attestry.plans.adapters import AS_OF
from attestry.plans.catalog import check_view, query

c = F.col


def q(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_digits(x: str) -> str:
    cut = f"regexp_replace(coalesce({x}, ''), {q(K.EXTENSION_RE)}, '')"
    return f"regexp_replace({cut}, '\\D+', '', 'g')"


def sql_raw_digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '\\D', '', 'g')"


def sql_phone_key(x: str) -> str:
    return f"CASE WHEN length({sql_digits(x)}) >= 10 THEN right({sql_digits(x)}, 10) END"


def sql_addr_key(p: str = "") -> str:
    joined = (f"coalesce({p}address_1, '') || ' ' || coalesce({p}city, '') || ' ' || "
              f"coalesce({p}postal_code, '')")
    kept = f"regexp_replace(lower({joined}), '[^a-z0-9 ]', '', 'g')"
    return f"nullif(trim(regexp_replace({kept}, '\\s+', ' ', 'g')), '')"


def sql_domain(x: str) -> str:
    host = (f"lower(regexp_replace(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)'"
            ", 1), ':[0-9]*$', ''))")
    return f"array_to_string(string_split({host}, '.')[-2:], '.')"


def sql_path(x: str) -> str:
    return (f"coalesce(nullif(regexp_extract({x}, "
            "'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ''), '/')")


def sql_age(x: str, as_of: str = AS_OF, clamp: bool = True) -> str:
    at = as_of.replace("T", " ").rstrip("Z")
    days = (f"CAST(floor((epoch(TIMESTAMP '{at}') - epoch(TRY_CAST({x} AS TIMESTAMP))) / 86400) "
            "AS INT)")
    return f"CASE WHEN {days} IS NOT NULL THEN greatest({days}, 0) END" if clamp else days


def sql_case(x: str, table: dict, default) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else ("NULL" if v is None else str(v))

    arms = " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {x} {arms} ELSE {lit(default)} END"


def sql_band(x: str) -> str:
    arms = " ".join(f"WHEN {x} >= {v} THEN '{n}'" for n, v in K.BANDS)
    return f"CASE {arms} ELSE '{K.LAST_BAND}' END"


def sql_label(s: str, k: str) -> str:
    return (f"CASE WHEN {k} >= 0.99 THEN 'contradicted' WHEN {s} >= 0.69 THEN 'supported' "
            f"WHEN {s} <= 0.05 AND {k} <= 0.05 THEN 'absent' ELSE 'uncertain' END")


# ---------------------------------------------------------------- contacts

@query("p01", "Dialable digits, extension removed", "phone",
       f"SELECT phone_id, {sql_digits('number')} AS digits FROM phone")
def p01(t):
    return t.phone.select("phone_id", C.phone_digits(c("number")).alias("digits"))


@query("p02", "Phone key: last ten digits or NULL", "phone",
       f"SELECT phone_id, {sql_phone_key('number')} AS phone_key FROM phone")
def p02(t):
    return t.phone.select("phone_id", C.phone_key(c("number")).alias("phone_key"))


@query("p03", "Address key", "address",
       f"SELECT listing_id, {sql_addr_key()} AS address_key FROM address")
def p03(t):
    return t.address.select("listing_id", C.address_key(
        c("address_1"), c("city"), c("postal_code")).alias("address_key"))


_LABEL = "trim(coalesce(service_type, ''))"
_RECOVERED = f"nullif(regexp_extract({_LABEL}, {q(K.PHONE_RE)}), '')"
check_view("issue", "phone", f"""
SELECT * FROM (SELECT listing_id, pos, phone_id,
  CASE WHEN trim(coalesce(number, '')) = '' THEN '(empty)' ELSE trim(number) END AS raw,
  CASE WHEN {_LABEL} = '' THEN 'unlabelled' ELSE {_LABEL} END AS label,
  CASE WHEN trim(coalesce(number, '')) = '' THEN 'empty'
       WHEN length({sql_digits('number')}) > 11 THEN 'run_together'
       WHEN coalesce(country_code, '') NOT IN ('', 'US') THEN 'foreign' END AS kind,
  CASE WHEN trim(coalesce(number, '')) = '' THEN 'no number stored' || coalesce(
         '; its label holds ''' || {_RECOVERED} || ''' and belongs there', '')
       WHEN length({sql_digits('number')}) > 11 THEN CAST(length({sql_digits('number')}) AS VARCHAR)
         || ' digits, as if two numbers had been joined'
       ELSE 'country_code is ' || country_code
         || ', so the number is shown and dialled as a foreign one' END AS why,
  CASE WHEN trim(coalesce(number, '')) = '' THEN {_RECOVERED} END AS proposed
FROM phone) WHERE kind IS NOT NULL""")
check_view("defect", "issue", """
SELECT listing_id, count(*) AS n_issues, arg_min(phone_id, pos) AS phone_id,
  arg_min(raw || ' (' || label || '): ' || why, pos) || CASE WHEN count(*) > 1
    THEN '; +' || CAST(count(*) - 1 AS VARCHAR) || ' more' ELSE '' END AS stored,
  arg_min(proposed, pos) FILTER (proposed IS NOT NULL) AS proposed
FROM issue GROUP BY listing_id""")


@query("p27", "Structural defects of every stored phone", "issue",
       "SELECT listing_id, phone_id, raw, label, kind, why, proposed FROM issue")
def p27(t):
    return ST.phone_issues(t.phone).drop("pos", "summary")


@query("a25", "Schedule rows closing before opening", "schedule_day", """
SELECT count(*) AS schedule_rows, count(DISTINCT listing_id) AS listings
FROM schedule_day WHERE closes_at < opens_at""")
def a25(t):
    return ST.closes_before_opening(t.schedule_day).groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("schedule_rows"),
                                          F.count(F.lit(1)).alias("listings"))


# ---------------------------------------------------------------- text

_BODY = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
         "'(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), "
         "'(?is)<script[^>]*>.*$', ' ', 'g'), '(?is)<style[^>]*>.*$', ' ', 'g'), "
         "'<[^>]+>', ' ', 'g')")
_ENTITIES = (("&quot;", "'\"'"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"),
             ("&gt;", "'>'"), ("&nbsp;", "chr(160)"), ("&#39;", "chr(39)"), ("&amp;", "'&'"))
_DECODED = _BODY
for _name, _char in _ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_name}', {_char})"
SQL_PAGE_TEXT = f"trim(regexp_replace({_DECODED}, '\\s+', ' ', 'g'))"


@query("p04", "HTML to text", "", f"SELECT page_id, {SQL_PAGE_TEXT} AS text FROM pages")
def p04(t):
    return t.pages.select("page_id", T.text_from_html(c("html")).alias("text"))


def sql_snippet(text: str, hit: str) -> str:
    at = f"instr({text}, {hit})"
    lo = f"greatest(1, {at} - 60)"
    return (f"CASE WHEN {hit} <> '' THEN trim(substr({text}, {lo}, {at} + length({hit}) + 60 "
            f"- {lo})) ELSE '' END")


_HIT = f"regexp_extract(text, {q(K.PHONE_RE)})"


@query("p05", "Evidence snippet around the first number", "page",
       f"SELECT listing_id, url, {sql_snippet('text', _HIT)} AS snippet FROM page")
def p05(t):
    return t.page.select("listing_id", "url", T.snippet(c("text"), K.PHONE_RE).alias("snippet"))


@query("p06", "Listing and edit URLs, a supplied edit URL first", "listing work_list", """
SELECT l.id AS listing_id, 'https://directory.example/organizations/' || l.id AS listing_url,
  coalesce(w.u, 'https://directory.example/organizations/' || l.id || '/edit') AS edit_url
FROM listing l LEFT JOIN (SELECT CAST(trim(resource_id) AS BIGINT) AS rid,
    arg_min(service_edit_url, row_no) FILTER (service_edit_url <> '') AS u
  FROM work_list WHERE regexp_matches(trim(resource_id), '^[0-9]+$') GROUP BY 1) w
  ON l.id = w.rid""")
def p06(t):
    from attestry.sources.landed import work_list_index

    site = E.Site()
    idx = work_list_index(t.work_list).select(c("resource_id").alias("id"), "service_edit_url")
    return t.listing.select("id").join(idx, "id", "left").select(
        c("id").alias("listing_id"), site.listing_url(c("id")).alias("listing_url"),
        site.edit_url(c("id"), c("service_edit_url")).alias("edit_url"))


@query("p36", "Clean text", "", """
SELECT doc_id, trim(regexp_replace(regexp_replace(text,
  '[\\x{00}-\\x{1f}\\x{7f}-\\x{9f}\\x{2028}\\x{2029}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text
FROM documents""")
def p36(t):
    return t.documents.select("doc_id", T.clean_text(c("text")).alias("text"))


@query("p37", "Safe number, string list and http URL", "", """
SELECT event_id, CAST(coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), -1)
    AS DOUBLE) AS k,
  array_to_string(list_filter(list_transform([event_type, ' ', props, NULL],
    lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), ' | ') AS items,
  CASE WHEN event_type = 'view' THEN 'HTTP://a.example/' || user_id ELSE '' END AS link
FROM events""")
def p37(t):
    link = F.when(c("event_type") == "view", F.concat(F.lit(" HTTP://a.example/"), "user_id")
                  ).otherwise(F.concat(F.lit("javascript:"), "event_type"))
    items = F.array("event_type", F.lit(" "), "props", F.lit(None).cast("string"))
    return t.events.select(
        "event_id", T.safe_number(F.regexp_extract("props", "([0-9]+)", 1), -1).alias("k"),
        F.array_join(T.string_list(items), " | ").alias("items"), T.http_url(link).alias("link"))


@query("p38", "Display name of a finding's field", "event_field", f"""
SELECT event_id, CASE WHEN event_type = 'signup' THEN field || ' days' ELSE {sql_case("field", {
    "phone": "phone number", "address": "address", "website": "website",
    "email": "email address", "schedule": "schedule", "services": "services",
    "status": "status"}, None)} END AS label FROM event_field""")
def p38(t):
    # "_days" is no suffix of a finding, so such a name is shown as it is.
    raw = F.concat("field", F.when(c("event_type") == "view", "_missing").when(
        c("event_type") == "click", "_Not_Found").when(c("event_type") == "signup", "_days")
        .otherwise(""))
    return t.event_field.select("event_id", V.field_label(raw).alias("label"))


# ---------------------------------------------------------------- URLs

@query("p07", "Registered domain", "", f"SELECT page_id, {sql_domain('url')} AS domain FROM pages")
def p07(t):
    return t.pages.select("page_id", U.registered_domain(c("url")).alias("domain"))


@query("p08", "Same-site test", "page", f"""
SELECT listing_id, url, {sql_domain('url')} = {sql_domain('website')} AS same_site FROM page""")
def p08(t):
    return t.page.select("listing_id", "url",
                         U.same_site(c("url"), c("website")).alias("same_site"))


@query("p09", "CDATA unwrap and date cut", "sitemap_body", """
SELECT url, trim(regexp_replace(regexp_replace(regexp_extract(body, '(?is)<loc>(.*?)</loc>', 1),
    '^\\s*<!\\[CDATA\\[', ''), '\\]\\]>\\s*$', '')) AS loc,
  nullif(regexp_extract(regexp_extract(body, '(?is)<lastmod>(.*?)</lastmod>', 1),
    '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS day
FROM sitemap_body""")
def p09(t):
    return t.sitemap_body.select(
        "url", U.unwrap_cdata(F.regexp_extract("body", K.LOC_RE, 1)).alias("loc"),
        U.day_of(F.regexp_extract("body", K.LASTMOD_RE, 1)).alias("day"))


check_view("rule", "robots_body", """
SELECT listing_id, website, coalesce(body, '') <> '' AS robots_txt,
  regexp_extract_all(regexp_extract(coalesce(body, ''),
    '(?s)User-agent: \\*\\n(.*?)User-agent: otherbot', 1),
    '(?im)^disallow:[ \\t]*([^\\s#]+)', 1) AS disallow,
  regexp_extract_all(coalesce(body, ''), '(?m)^Sitemap: (\\S+)', 1) AS sitemaps
FROM robots_body""")


@query("p10", "Robots text to sitemaps and rules", "rule", """
SELECT website, array_to_string(disallow, ' ') AS disallow,
  array_to_string(sitemaps, ' ') AS sitemaps FROM rule""")
def p10(t):
    r = U.parse_robots(c("body"))
    return t.robots_body.select("website", r.alias("r")).select(
        "website", F.array_join("r.disallow", " ").alias("disallow"),
        F.array_join("r.sitemaps", " ").alias("sitemaps"))


check_view("sitemap_entry", "sitemap_body", """
SELECT listing_id, website, url AS sitemap,
  regexp_matches(body, '(?i)<sitemap>') AS is_index, regexp_matches(body, '(?i)<url>') AS is_set,
  unnest(range(len(regexp_extract_all(body, '(?is)<loc>(.*?)</loc>', 1)))) AS ix,
  unnest(list_transform(regexp_extract_all(body, '(?is)<loc>(.*?)</loc>', 1), lambda x:
    trim(regexp_replace(regexp_replace(x, '^\\s*<!\\[CDATA\\[', ''), '\\]\\]>\\s*$', '')))) AS loc,
  nullif(regexp_extract(body, '<lastmod>([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS day
FROM sitemap_body""")


@query("p11", "Sitemap body to children and dated pages", "sitemap_entry", """
SELECT sitemap, CASE WHEN is_index THEN 'child' ELSE 'page' END AS role, loc AS url,
  CASE WHEN is_set AND ix = 0 THEN day END AS lastmod FROM sitemap_entry""")
def p11(t):
    parsed = t.sitemap_body.select(c("url").alias("sitemap"),
                                   U.parse_sitemap(c("body")).alias("s"))
    # Children and pages leave a body together, so bodies are put together and parsed once.
    named = F.concat(
        F.transform("s.children", lambda u: F.struct(
            F.lit("child").alias("role"), u.alias("url"),
            F.lit(None).cast("string").alias("lastmod"))),
        F.transform("s.pages", lambda p: F.struct(
            F.lit("page").alias("role"), p["url"].alias("url"), p["lastmod"].alias("lastmod"))))
    return parsed.select("sitemap", F.explode(named).alias("e")).select("sitemap", "e.*")


@query("p12", "Slug words of a path", "page", f"""
SELECT listing_id, url, array_to_string(list_filter(regexp_split_to_array(
  lower({sql_path('url')}), '[/\\-_.]+'), lambda x: x <> ''), ' ') AS words FROM page""")
def p12(t):
    return t.page.select("listing_id", "url", F.array_join(
        U.slug_words(U.url_path(c("url"))), " ").alias("words"))


_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


def sql_links(pattern: str, cut: str) -> str:
    """Ordered distinct absolute links for root-relative and absolute hrefs."""
    every = f"regexp_extract_all(html, {q(pattern)}, 1)"
    return f"""
SELECT page_id, count(*) AS n_links, string_agg(u, ' ' ORDER BY ix) AS links FROM (
  SELECT page_id, u, min(ix) AS ix FROM (
    SELECT page_id, ix, {cut.format(u="CASE WHEN starts_with(h, '/') THEN o || h ELSE h END")} AS u
    FROM (SELECT page_id, {_ORIGIN} AS o, unnest({every}) AS h,
            unnest(range(len({every}))) AS ix FROM pages)
    WHERE NOT regexp_matches(lower(h), '^(mailto:|tel:|javascript:|data:|#)'))
  GROUP BY page_id, u) GROUP BY page_id"""


def _listed(df):
    return df.filter(F.size("l") > 0).select("page_id", F.size("l").alias("n_links"),
                                             F.array_join("l", " ").alias("links"))


@query("p13", "Anchor links of a page, absolute and deduplicated", "",
       sql_links(K.ANCHOR_HREF_RE, "{u}"))
def p13(t):
    return _listed(t.pages.select("page_id", U.html_links(c("html"), c("url")).alias("l")))


@query("p14", "Markdown links", "", """
SELECT page_id, count(*) AS n_links, string_agg(h, ' ' ORDER BY ix) AS links FROM (
  SELECT page_id, h, min(ix) AS ix FROM (
    SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^")\\s]+)">', 1)) AS p,
      unnest(range(len(regexp_extract_all(html, '<a href="(/[^")\\s]+)">', 1)))) AS ix FROM pages),
    LATERAL (SELECT 'https://site.example' || p AS h) GROUP BY page_id, h) GROUP BY page_id""")
def p14(t):
    markdown = F.regexp_replace("html", r'<a href="(/[^")\s]+)">([^<]*)</a>',
                                "[$2](https://site.example$1)")
    return _listed(t.pages.select("page_id", U.markdown_links(markdown).alias("l")))


@query("p15", "Links a crawl may follow", "",
       sql_links(K.HREF_RE, "regexp_replace({u}, '#.*$', '')"))
def p15(t):
    return _listed(t.pages.select("page_id", U.crawl_links(c("html"), c("url")).alias("l")))


@query("p39", "Host without www.", "", """
SELECT page_id, regexp_replace(lower(regexp_extract(url, '//([^/?#:]+)', 1)), '^www\\.', '') AS host
FROM pages""")
def p39(t):
    return t.pages.select("page_id", U.display_host(c("url")).alias("host"))


# ---------------------------------------------------------------- claims

check_view("tclaim", "listing phone address", f"""
SELECT listing_id, 'phone' || pos AS key, 'phone' AS field, 0 AS t, pos AS p,
  'Callers reach this organisation on ' || trim(number)
    || CASE WHEN {_LABEL} NOT IN ('', 'Voice') THEN ' (' || {_LABEL} || ')' ELSE '' END || '.'
    AS text, trim(number) AS stored FROM phone WHERE trim(coalesce(number, '')) <> ''
UNION ALL
SELECT listing_id, 'addr' || pos, 'address', 1, pos, 'This organisation is found at '
  || concat_ws(', ', nullif(trim(address_1), ''), nullif(trim(city), ''),
     nullif(trim(state_province), ''), nullif(trim(postal_code), '')) || '.',
  concat_ws(', ', nullif(trim(address_1), ''), nullif(trim(city), ''),
     nullif(trim(state_province), ''), nullif(trim(postal_code), ''))
FROM address WHERE concat_ws('', trim(address_1), trim(city), trim(state_province),
  trim(postal_code)) <> ''
UNION ALL
SELECT id, 'status', 'status', 2, 0, {q(K.STATUS_CLAIM)}, 'approved/open' FROM listing""")


def _claim_query(name, title, field, build):
    @query(name, title, "tclaim",
           f"SELECT listing_id, key, text, stored FROM tclaim WHERE field = '{field}'")
    def run(t):
        return build(t).select("listing_id", "key", "text", "stored")

    return run


_claim_query("p16", "Stored phone claims", "phone", lambda t: CL.phone_claims(t.phone))
_claim_query("p17", "Address claims", "address", lambda t: CL.address_claims(t.address))
_claim_query("p18", "Status claim", "status", lambda t: CL.status_claims(t.listing))


@query("p50", "Claim key and sentence per judged row", "tclaim page", """
SELECT c.listing_id, p.url, c.field || '|' || c.stored AS claim_key,
  CASE c.field WHEN 'phone' THEN 'Callers reach this organisation on '
    || c.stored || '.' ELSE 'This organisation is found at ' || c.stored || '.' END AS sentence
FROM tclaim c JOIN page p ON c.listing_id = p.listing_id WHERE c.field <> 'status'""")
def p50(t):
    claims = CL.template_claims(t.directory).filter(c("field") != "status")
    sentence = F.when(c("field") == "phone", CL.phone_sentence(c("stored"))).otherwise(
        CL.address_sentence(c("stored")))
    return claims.join(t.page.select("listing_id", "url"), "listing_id").select(
        "listing_id", "url", F.concat_ws("|", "field", "stored").alias("claim_key"),
        sentence.alias("sentence"))


# ---------------------------------------------------------------- ages and scores

_MID = "1998-07-01T00:00:00Z"


@query("p22", "Age in whole days, clamped and unclamped", "listing", f"""
SELECT id AS listing_id, {sql_age('verified_at')} AS verified_age,
  {sql_age('updated_at', _MID)} AS clamped, {sql_age('updated_at', _MID, False)} AS signed
FROM listing""")
def p22(t):
    return t.listing.select(
        c("id").alias("listing_id"),
        SC.age_days(c("verified_at"), AS_OF).alias("verified_age"),
        SC.age_days(c("updated_at"), _MID).alias("clamped"),
        SC.age_days(c("updated_at"), _MID, clamp=False).alias("signed"))


@query("p23", "Exponential decay", "listing", f"""
SELECT id AS listing_id, round(coalesce(pow(0.5, {sql_age('verified_at')} / 1095.0), 0), 6) AS human,
  round(coalesce(pow(0.5, {sql_age('updated_at')} / 180.0), 0), 6) AS record FROM listing""")
def p23(t):
    return t.listing.select(
        c("id").alias("listing_id"),
        F.round(SC.decay(SC.age_days(c("verified_at"), AS_OF), F.lit(1095)), 6).alias("human"),
        F.round(SC.decay(SC.age_days(c("updated_at"), AS_OF), F.lit(180)), 6).alias("record"))


def sql_score(field: str, evidence: str, age: str) -> str:
    ceil = sql_case(evidence, K.EVIDENCE_CEILING, 0)
    life = sql_case(field, K.HALF_LIFE, K.DEFAULT_HALF_LIFE)
    return (f"CASE WHEN {ceil} = 0 THEN 0.0 ELSE round_even(CAST(({ceil}) * coalesce(pow(0.5, "
            f"{age} / CAST({life} AS DOUBLE)), 0) AS DOUBLE), 1) END")


_HUMAN = "coalesce(nullif(l.verified_at, ''), nullif(l.certified_at, ''))"
_HAS = {
    "phone": "EXISTS (SELECT 1 FROM phone p WHERE p.listing_id = l.id "
             "AND trim(coalesce(p.number, '')) <> '')",
    "address": "EXISTS (SELECT 1 FROM address p WHERE p.listing_id = l.id)",
    "schedule": "EXISTS (SELECT 1 FROM schedule_day p WHERE p.listing_id = l.id)",
    "status": "coalesce(l.status, '') <> ''",
    "website": "trim(coalesce(l.website, '')) <> ''",
    "services": "EXISTS (SELECT 1 FROM service p WHERE p.listing_id = l.id)",
    "email": "trim(coalesce(l.email, '')) <> ''",
}
_CHILDREN = "listing phone address schedule_day service"
check_view("has", _CHILDREN, " UNION ALL ".join(
    f"SELECT l.id AS listing_id, '{f}' AS field, {i} AS fpos, {cond} AS present, {_HUMAN} AS human,"
    f" l.updated_at FROM listing l" for i, (f, cond) in enumerate(_HAS.items())))


def evidence_view(name: str, confirmed: bool) -> None:
    conf = ("LEFT JOIN (SELECT listing_id, field, max(confirmed_at) AS cat FROM confirmation "
            "GROUP BY 1, 2) k ON h.listing_id = k.listing_id AND h.field = k.field"
            if confirmed else "CROSS JOIN (SELECT NULL AS cat) k")
    check_view(name, "has" + (" confirmation" if confirmed else ""), f"""
SELECT listing_id, field, fpos, evidence, age_days,
  {sql_score('field', 'evidence', 'age_days')} AS score
FROM (SELECT h.listing_id, h.field, h.fpos,
  CASE WHEN {sql_age('human')} IS NOT NULL THEN 'human_verified'
       WHEN {sql_age('k.cat')} IS NOT NULL THEN 'source_agreement'
       WHEN present THEN 'structural_ok' ELSE 'none' END AS evidence,
  CASE WHEN {sql_age('human')} IS NOT NULL THEN {sql_age('human')}
       WHEN {sql_age('k.cat')} IS NOT NULL THEN {sql_age('k.cat')}
       WHEN present THEN {sql_age('updated_at')} END AS age_days
FROM has h {conf})""")


evidence_view("evid", False)
evidence_view("evidc", True)


def rollup_view(name: str, source: str) -> None:
    """Sums written out in weight order, as a running total adds them."""
    def arm(f, value):
        return (f"coalesce(max(CASE WHEN field = '{f}' AND evidence <> 'none' "
                f"THEN {value} END), 0.0)")

    total = " + ".join(["0.0"] + [arm(f, f"score * CAST({w} AS DOUBLE)")
                                  for f, w in K.WEIGHT.items()])
    weight = " + ".join(["0.0"] + [arm(f, f"CAST({w} AS DOUBLE)") for f, w in K.WEIGHT.items()])
    check_view(name, source, f"""
SELECT listing_id, exact, freshness, coverage, {sql_band('freshness')} AS band FROM (
SELECT listing_id, exact, round_even(exact, 1) AS freshness, coverage FROM (
SELECT listing_id, CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE 0.0 END AS exact,
  round_even({weight}, 2) AS coverage FROM {source} GROUP BY listing_id))""")


rollup_view("fresh", "evid")
rollup_view("freshc", "evidc")


@query("p24", "Field score", "evid", "SELECT listing_id, field, score FROM evid")
def p24(t):
    return FR.long_scores(FR.field_scores(t.directory, AS_OF)).select(
        "listing_id", "field", "score")


@query("p25", "Band of a listing", "fresh", "SELECT listing_id, band FROM fresh")
def p25(t):
    return FR.rollup(FR.field_scores(t.directory, AS_OF)).select(
        c("id").alias("listing_id"), "band")


@query("p26", "Which fields a listing states", "has", """
SELECT listing_id, string_agg(field, ' ' ORDER BY fpos) FILTER (present) AS fields
FROM has GROUP BY listing_id""")
def p26(t):
    return FR.field_presence(t.directory).select(
        c("id").alias("listing_id"), F.concat_ws(" ", *[
            F.when(c(f"has_{f}"), f) for f in FR.FIELDS]).alias("fields"))


@query("p28", "Best evidence per field", "evidc",
       "SELECT listing_id, field, evidence, age_days FROM evidc")
def p28(t):
    return FR.long_scores(FR.field_scores(t.directory, AS_OF, t.confirmation)).select(
        "listing_id", "field", "evidence", "age_days")


@query("p29", "Verdict label from two probabilities", "judged", f"""
SELECT listing_id, key, pos, {sql_label('support', 'contradict')} AS label FROM judged""")
def p29(t):
    return E.label_rows(t.judged).select("listing_id", "key", "pos", "label")


check_view("claim_page", "tclaim page", """
SELECT c.listing_id, c.key, c.field, c.stored, p.url, p.text FROM tclaim c JOIN page p
ON c.listing_id = p.listing_id""")


def sql_on_page(stored: str, page: str) -> str:
    d = sql_raw_digits(stored)
    return (f"CASE WHEN length({d}) < 10 THEN FALSE ELSE contains({sql_raw_digits(page)}, "
            f"right({d}, 10)) END")


def sql_addr_on_page(stored: str, page: str) -> str:
    head = f"trim(string_split(trim({stored}), ',')[1])"
    num = f"nullif(regexp_extract({head}, '^(\\d+)\\s+.+', 1), '')"
    stop = "[" + ", ".join(q(w) for w in K.STREET_STOP_WORDS) + "]"
    words = (f"list_filter(regexp_extract_all(lower(regexp_extract({head}, '^\\d+\\s+(.+)', 1)), "
             f"'[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))")
    return (f"CASE WHEN {num} IS NULL OR len({words}) = 0 THEN NULL ELSE contains({page}, {num}) "
            f"AND len(list_filter({words}, lambda w: contains(lower({page}), w))) > 0 END")


@query("p30", "Phone oracle", "claim_page", f"""
SELECT listing_id, key, url, {sql_on_page('stored', 'text')} AS on_page FROM claim_page
WHERE field = 'phone'""")
def p30(t):
    return CN.truth_rows(claim_needles(t, "phone"), t.page)


def claim_needles(t, field=None):
    """What decides each template claim; see operators.containment."""
    claims = CL.template_claims(t.directory).select("listing_id", "key", "field", "stored")
    return CN.needles(claims.filter(c("field") == field) if field else claims)


@query("p31", "Address oracle, three-valued", "claim_page", f"""
SELECT listing_id, key, url, {sql_addr_on_page('stored', 'text')} AS on_page FROM claim_page
WHERE field = 'address'""")
def p31(t):
    return CN.truth_rows(claim_needles(t, "address"), t.page)


check_view("oracle_row", "claim_page", f"""
SELECT listing_id, key, field, stored, url, CASE field WHEN 'phone' THEN
  {sql_on_page('stored', 'text')} WHEN 'address' THEN {sql_addr_on_page('stored', 'text')} END
  AS truth FROM claim_page""")


@query("p32", "Oracle by field", "oracle_row", """
SELECT field, truth, count(*) AS n FROM oracle_row GROUP BY field, truth""")
def p32(t):
    return CN.counts(claim_needles(t), t.page).groupBy("field", "truth").agg(
        F.sum("n").alias("n"))


def answers(t):
    """Raw scorer answers as JSON, one question form per return flag."""
    def js(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    kind = F.when(c("l_returnflag") == "A", "choice").when(
        c("l_returnflag") == "N", "score").otherwise("noul_pair")
    full = c("l_linestatus") == "F"
    choice = js('{"choice":"supports","confidence":', c("l_tax"), ',"probabilities":{',
                F.when(full, js('"supports":', c("l_discount"), ",")).otherwise(F.lit("")),
                '"contradicts":', c("l_tax"), "}}")
    score = js('{"probabilities":{"0":', c("l_tax"), '},"score":',
               F.when(full, c("l_linenumber").cast("string")).otherwise(F.lit("null")), "}")
    noul = js('{"noul":', c("l_discount"), "}")
    other = F.when(full, js('{"noul":', c("l_tax"), "}")).otherwise(F.lit("{}"))
    text = F.when(kind == "choice", choice).when(kind == "score", score).otherwise(noul)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"),
        F.from_json(text, SC.ANSWER_SCHEMA).alias("answer"),
        F.from_json(F.when(kind == "noul_pair", other), SC.ANSWER_SCHEMA).alias("second"))


@query("p33", "Scores on one axis for every question form", "", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(CASE l_returnflag WHEN 'N' THEN l_linenumber / 3.0 ELSE l_discount END, 6) AS support,
  round(CAST(l_tax AS DOUBLE), 6) AS contradict
FROM lineitem WHERE l_linestatus = 'F'""")
def p33(t):
    s = SC.read_support(c("kind"), c("answer"), c("second"))
    return answers(t).withColumn("s", s).filter(c("s").isNotNull()).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round("s.support", 6).alias("support"), F.round("s.contradict", 6).alias("contradict"))


@query("p34", "Answer readers", "", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'R' THEN l_discount END AS noul,
  CASE WHEN l_returnflag = 'A' THEN 'supports' END AS choice,
  CASE WHEN l_returnflag = 'A' THEN l_tax ELSE 0.0 END AS confidence
FROM lineitem""")
def p34(t):
    p = SC.picked(c("answer"))
    return answers(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             SC.probability(c("answer")).alias("noul"),
                             p["choice"].alias("choice"), p["confidence"].alias("confidence"))


@query("p35", "Cost of a request", "", """
SELECT doc_id, round(ceil(n_chars / 4.0) / 1e6 * 0.042, 9) AS usd FROM documents""")
def p35(t):
    return t.documents.select("doc_id", F.round(SC.usd(F.ceil(c("n_chars") / 4)), 9).alias("usd"))


def sql_half_even(x, digits=3):
    """Half-even rounding of the shortest decimal text of a double."""
    unit = 10 ** digits
    scaled = f"(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 20)) * {unit})"
    return (f"(CAST(floor({scaled}) AS BIGINT) + CASE WHEN {scaled} - floor({scaled}) > 0.5 OR "
            f"({scaled} - floor({scaled}) = 0.5 AND CAST(floor({scaled}) AS BIGINT) % 2 = 1) "
            f"THEN 1 ELSE 0 END) / {unit}.0::DOUBLE")


@query("p45", "Priority from confidence and radius", "", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {sql_half_even("l_discount * (1 + l_quantity * 0.15::DOUBLE)")} AS priority FROM lineitem""")
def p45(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        SC.priority(c("l_discount"), c("l_quantity")).alias("priority"))


check_view("triaged", "listing", f"""
SELECT * FROM (SELECT id, CASE WHEN status = 'approved' AND coalesce(website, '') <> '' THEN
  1.0 + CASE WHEN {sql_age('verified_at', clamp=False)} IS NULL THEN 3.0
    ELSE least({sql_age('verified_at', clamp=False)} / 365.0, 3.0) END
  + CASE WHEN regexp_matches(lower(coalesce(name, '') || ' ' || category_names),
      {q('|'.join(K.CRITICAL_WORDS))}) THEN 4.0 ELSE 0.0 END
  + CASE WHEN hours_known THEN 0.0 ELSE 1.0 END ELSE 0.0 END AS triage FROM listing)""")


@query("p46", "Triage score", "triaged",
       "SELECT id AS listing_id, round(triage, 6) AS triage FROM triaged")
def p46(t):
    words = F.concat_ws(" ", F.coalesce("name", F.lit("")), "category_names")
    return t.listing.select(c("id").alias("listing_id"), F.round(SC.triage_score(
        c("status"), c("website"), c("verified_at"), words, c("hours_known"), AS_OF), 6)
        .alias("triage"))


@query("p48", "Route a change request would take", "phone", """
SELECT phone_id, CASE WHEN service_type = 'Fax' AND phone_id <> 0
  THEN 'https://directory.example/api/phones/' || phone_id || '/change_requests'
  ELSE 'https://directory.example/api/resources/' || listing_id || '/change_requests' END AS route
FROM phone""")
def p48(t):
    field = F.when(c("service_type") == "Fax", "phone_format").otherwise("address")
    return t.phone.select("phone_id", E.Site().endpoint(
        c("listing_id"), field, c("phone_id")).alias("route"))


@query("p49", "Graph node label", "", """
SELECT 'doc:' || doc_id AS id, CASE WHEN length(nm) > 40 THEN left(nm, 39) || '…' ELSE nm END AS label
FROM (SELECT doc_id, coalesce(nullif(text, ''), source) AS nm FROM documents)""")
def p49(t):
    nodes = t.documents.select(F.concat(F.lit("doc:"), "doc_id").alias("id"),
                               c("text").alias("name"), c("source").alias("value"))
    return nodes.select("id", G.node_label().alias("label"))
