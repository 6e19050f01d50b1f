"""Stored values against pages: rule findings, verdicts, labels, identity, scorers."""

import json
import math
import re
from functools import lru_cache

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.operators import claims as CL
from attestry.operators import evidence as E
from attestry.operators import experiment as EX
from attestry.operators import review_queue as R
from attestry.operators import scorers as X
from attestry.plans.catalog import check_view, query
from attestry.plans.pipeline import DirectoryRun
from attestry.plans.queries_columns import (
    q,
    sql_addr_on_page,
    sql_digits,
    sql_half_even,
    sql_label,
    sql_on_page,
    sql_phone_key,
    sql_raw_digits,
    sql_snippet,
)

c = F.col


def _with_pos(t):
    """All captured pages of a listing; the URL itself is the reading order."""
    return t.page.select("listing_id", "url", "text", c("url").alias("pos"))


check_view("placed", "page", """
SELECT listing_id, url, text, row_number() OVER (PARTITION BY listing_id ORDER BY url) AS pos
FROM page""")


def phone_views(prefix: str, pages: str) -> None:
    """SQL for the phone evidence over a set of read pages."""
    check_view(f"{prefix}shown", pages, f"""
SELECT listing_id, pos, url, text, unnest(regexp_extract_all(text, {q(K.PHONE_RE)})) AS live,
  unnest(range(len(regexp_extract_all(text, {q(K.PHONE_RE)})))) AS ix FROM {pages}
WHERE coalesce(length(text), 0) >= 50""")
    check_view(f"{prefix}hit", f"{prefix}shown phone", f"""
SELECT s.listing_id, arg_min({{'stored': p.number, 'live': s.live, 'url': s.url,
  'phone_id': p.phone_id}}, (s.pos, s.ix, p.pos)) AS f
FROM {prefix}shown s JOIN phone p ON s.listing_id = p.listing_id
  AND {sql_phone_key('s.live')} = {sql_phone_key('p.number')} GROUP BY s.listing_id""")
    check_view(f"{prefix}first", f"{prefix}shown", f"""
SELECT listing_id, arg_min({{'live': live, 'url': url, 'quote': {sql_snippet('text', 'live')}}},
  (pos, ix)) AS f FROM {prefix}shown WHERE ix = 0 GROUP BY listing_id""")
    check_view(f"{prefix}phone", f"{prefix}hit {prefix}first phone", f"""
SELECT s.listing_id, CASE WHEN h.f IS NULL AND n > 1 THEN 'phone_missing' ELSE 'phone' END AS field,
  CASE WHEN h.f IS NOT NULL THEN h.f.stored WHEN n > 1 THEN 'not among the ' || n
    || ' numbers on the listing' ELSE s.one.number END AS stored,
  coalesce(h.f.live, w.f.live) AS live, coalesce(h.f.url, w.f.url) AS url,
  CASE WHEN h.f IS NOT NULL THEN h.f.live ELSE w.f.quote END AS quote, h.f IS NOT NULL AS match,
  CASE WHEN h.f IS NOT NULL THEN h.f.phone_id WHEN n = 1 THEN s.one.phone_id END AS phone_id
FROM (SELECT listing_id, count(*) AS n, arg_min({{'number': number, 'phone_id': phone_id}}, pos)
    AS one FROM phone WHERE {sql_phone_key('number')} IS NOT NULL GROUP BY listing_id) s
JOIN {prefix}first w ON s.listing_id = w.listing_id
LEFT JOIN {prefix}hit h ON s.listing_id = h.listing_id""")
    check_view(f"{prefix}closure", pages, f"""
SELECT listing_id, arg_min({{'live': m, 'url': url, 'quote': quote}}, pos) AS f FROM (
  SELECT *, {sql_snippet('text', 'm')} AS quote FROM (
    SELECT *, regexp_extract(text, {q(K.CLOSURE_RE)}) AS m FROM {pages}
    WHERE coalesce(length(text), 0) >= 50) WHERE m <> '')
WHERE NOT regexp_matches(quote, {q(K.CODE_RE)}) AND (regexp_matches(m, {q(K.STRONG_CLOSURE_RE)})
  OR regexp_matches(quote, {q(K.SUBJECT_RE)})) GROUP BY listing_id""")
    check_view(f"{prefix}address", f"{pages} address", f"""
SELECT g.listing_id, arg_min({{'stored': a.stored, 'url': g.url,
  'quote': {sql_snippet('g.text', 'a.postal_code')}}}, g.pos) AS f
FROM {pages} g JOIN (SELECT listing_id, postal_code, trim(coalesce(address_1, '') || ' '
    || coalesce(city, '') || ' ' || coalesce(postal_code, '')) AS stored FROM address
  WHERE pos = 0 AND coalesce(postal_code, '') <> '') a ON g.listing_id = a.listing_id
WHERE coalesce(length(g.text), 0) >= 50 AND contains(g.text, a.postal_code)
GROUP BY g.listing_id""")


phone_views("all_", "placed")
phone_views("g_", "gathered")


def _long(t):
    return _with_pos(t).filter(F.length("text") >= K.MIN_VERIFY_CHARS)


@query("j01", "Stored numbers matched with numbers on own pages", "all_phone", """
SELECT listing_id, stored, live, url, phone_id FROM all_phone WHERE match""")
def j01(t):
    return E.phone_matches(t.phone, _long(t)).select("listing_id", "stored", "live", "url",
                                                     "phone_id")


@query("j02", "No stored number matches: the first number shown instead", "all_phone", """
SELECT listing_id, field, stored, live, url, quote FROM all_phone WHERE NOT match""")
def j02(t):
    return E.phone_findings(t.phone, _long(t)).filter(~c("match")).select(
        "listing_id", "field", "stored", "live", "url", "quote")


@query("j03", "First page showing the postal code", "all_address", """
SELECT listing_id, f.stored AS stored, f.url AS url, f.quote AS quote FROM all_address""")
def j03(t):
    return E.address_findings(t.address, _long(t)).select("listing_id", "stored", "url", "quote")


@query("w05", "First number on a listing's pages by page and position", "all_first", """
SELECT listing_id, f.live AS live, f.url AS url FROM all_first""")
def w05(t):
    first = E.page_phones(_long(t)).groupBy("listing_id").agg(
        F.min_by(F.struct("live", "url"), F.struct("pos", "at")).alias("f"))
    return first.select("listing_id", "f.live", "f.url")


@query("f05", "Closure phrases that survive the guard", "all_closure", """
SELECT listing_id, f.live AS live, f.url AS url, f.quote AS quote FROM all_closure""")
def f05(t):
    return E.closure_findings(_long(t)).select("listing_id", "live", "url", "quote")


check_view("anchor", "phone address", f"""
SELECT listing_id, 'phone' AS kind, right({sql_raw_digits('number')}, 10) AS value, 0 AS rank, pos
FROM phone WHERE length({sql_raw_digits('number')}) >= 10
UNION ALL SELECT listing_id, 'street', w, 1, pos FROM (SELECT listing_id, pos, array_to_string(
  list_filter(regexp_split_to_array(trim(coalesce(address_1, '')), '\\s+'), lambda x: x <> '')[:2],
  ' ') AS w FROM address) WHERE length(w) >= 6
UNION ALL SELECT listing_id, 'postal_code', left(trim(postal_code), 5), 2, pos FROM address
  WHERE length(trim(coalesce(postal_code, ''))) >= 5
UNION ALL SELECT listing_id, 'city', trim(city), 3, pos FROM address
  WHERE length(trim(coalesce(city, ''))) >= 4""")


def identity_view(name: str, pages: str, where: str = "TRUE") -> None:
    check_view(name, f"{pages} anchor", f"""
SELECT p.listing_id, NOT EXISTS (SELECT 1 FROM anchor a WHERE a.listing_id = p.listing_id)
    OR b.v IS NOT NULL AS belongs, b.v.kind AS anchor_kind, b.v.value AS anchor_value,
  b.v.url AS anchor_url
FROM (SELECT DISTINCT listing_id FROM {pages} WHERE {where}) p LEFT JOIN (
  SELECT g.listing_id, arg_min({{'kind': a.kind, 'value': a.value, 'url': g.url}},
    (a.rank, g.pos, a.pos, a.kind, a.value)) AS v
  FROM {pages} g JOIN anchor a ON g.listing_id = a.listing_id
  WHERE {where} AND CASE a.kind WHEN 'phone' THEN contains({sql_raw_digits('g.text')}, a.value)
    ELSE contains(lower(g.text), lower(a.value)) END GROUP BY g.listing_id) b
ON p.listing_id = b.listing_id""")


identity_view("ident_all", "placed")


@query("j04", "Identity: the strongest anchor any page shows", "ident_all", """
SELECT listing_id, belongs, anchor_kind, anchor_value, anchor_url FROM ident_all""")
def j04(t):
    return E.identity(E.identity_anchors(t.phone, t.address), _with_pos(t))


@query("j05", "Claims against pages of the same listing", "claim_page", """
SELECT listing_id, key, url, length(text) AS chars FROM claim_page""")
def j05(t):
    pages = t.page.select("listing_id", "url", F.length("text").alias("chars"))
    return CL.template_claims(t.directory).select("listing_id", "key").join(
        pages, "listing_id").select("listing_id", "key", "url", "chars")


# ---------------------------------------------------------------- verdicts of the rule check

check_view("g_struct", "defect", """
SELECT listing_id, {'field': 'phone_format', 'stored': stored, 'live': 'not dialable as stored',
  'url': 'https://directory.example/organizations/' || listing_id, 'quote': stored,
  'match': FALSE, 'phone_id': phone_id, 'proposed': proposed} AS f FROM defect""")
check_view("found", "listing g_phone g_closure g_address g_struct gathered", """
SELECT l.id, l.name, l.website, g.listing_id IS NOT NULL AS has_text, p.live IS NOT NULL AS has_p,
  p.field AS p_field, p.stored AS p_stored, p.live AS p_live, p.match AS p_match,
  p.url AS p_url, p.quote AS p_quote, p.phone_id AS p_id,
  k.f AS k, a.f AS a, s.f AS s
FROM listing l LEFT JOIN (SELECT DISTINCT listing_id FROM gathered WHERE usable) g
  ON g.listing_id = l.id
LEFT JOIN g_phone p ON p.listing_id = l.id LEFT JOIN g_closure k ON k.listing_id = l.id
LEFT JOIN g_address a ON a.listing_id = l.id LEFT JOIN g_struct s ON s.listing_id = l.id""")
check_view("ruled", "found", f"""
SELECT *, CASE WHEN k IS NOT NULL OR (has_p AND p_field = 'phone' AND NOT p_match)
    THEN 'discrepancy' WHEN (has_p AND p_match) OR a IS NOT NULL THEN 'match' ELSE 'abstain' END
    AS rule_verdict,
  CASE WHEN k IS NOT NULL THEN 'The site itself speaks of closing or moving: "' || k.quote || '"'
    WHEN has_p AND p_field = 'phone' AND NOT p_match THEN 'No page shows the stored phone '
      || p_stored || '; the site gives ' || p_live || '.'
    WHEN (has_p AND p_match) OR a IS NOT NULL THEN {q(K.REASON_MATCH)}
    ELSE {q(K.REASON_ABSTAIN)} END AS rule_reason,
  CASE WHEN k IS NOT NULL THEN 0.7 WHEN has_p AND p_field = 'phone' AND NOT p_match THEN 0.55
    WHEN (has_p AND p_match) OR a IS NOT NULL THEN 0.6 ELSE 0.3 END AS rule_confidence,
  coalesce(has_p AND trim(p_stored) <> trim(p_live) AND NOT (p_field = 'phone'
    AND {sql_phone_key('p_stored')} IS NOT DISTINCT FROM {sql_phone_key('p_live')}), FALSE)
    AS p_usable
FROM found""")
check_view("verified", "ruled gathered work_index", f"""
SELECT id AS resource_id, name, website AS org_website,
  CASE WHEN website IS NULL THEN '' ELSE coalesce(t.tried, '') END AS fetched,
  coalesce(w.service_edit_url, 'https://directory.example/organizations/' || id || '/edit')
    AS edit_url,
  CASE WHEN early AND s IS NOT NULL THEN 'discrepancy' WHEN early OR empty THEN 'abstain'
    ELSE rule_verdict END AS verdict,
  CASE WHEN early AND s IS NOT NULL THEN s.stored WHEN website IS NULL THEN {q(K.REASON_NO_WEBSITE)}
    WHEN early THEN {q(K.REASON_NO_TEXT)} WHEN empty THEN 'A problem was reported, but every '
      || 'gathered field agrees, so no change can be proposed. What was reported: '
      || rule_reason ELSE rule_reason END AS reason,
  CAST(CASE WHEN early AND s IS NOT NULL THEN 0.95 WHEN website IS NULL THEN 1.0 WHEN early THEN 0.2
    WHEN empty THEN least(rule_confidence, 0.3) ELSE rule_confidence END AS DOUBLE) AS confidence,
  CASE WHEN early THEN CASE WHEN s IS NOT NULL THEN 'phone_format' ELSE '' END ELSE
    concat_ws(',', CASE WHEN p_usable THEN p_field END, CASE WHEN k IS NOT NULL
      THEN 'operating_status' END, CASE WHEN s IS NOT NULL THEN 'phone_format' END) END AS fields,
  CASE WHEN early THEN s.field WHEN p_usable AND NOT p_match THEN p_field WHEN k IS NOT NULL THEN
    'operating_status' WHEN s IS NOT NULL THEN 'phone_format' WHEN p_usable THEN p_field END
    AS bad_field,
  CASE WHEN early THEN s.stored WHEN p_usable AND NOT p_match THEN p_stored WHEN k IS NOT NULL THEN
    'open (approved)' WHEN s IS NOT NULL THEN s.stored WHEN p_usable THEN p_stored END AS bad_stored,
  CASE WHEN early THEN coalesce(s.proposed, s.live) WHEN p_usable AND NOT p_match THEN p_live
    WHEN k IS NOT NULL THEN k.live WHEN s IS NOT NULL THEN coalesce(s.proposed, s.live)
    WHEN p_usable THEN p_live END AS bad_live
FROM (SELECT *, website IS NULL OR NOT has_text AS early,
  rule_verdict = 'discrepancy' AND NOT p_usable AND k IS NULL AND s IS NULL AS empty FROM ruled)
LEFT JOIN work_index w ON w.resource_id = id
LEFT JOIN (SELECT listing_id, string_agg(url, ' ' ORDER BY pos) AS tried FROM gathered GROUP BY 1) t
  ON t.listing_id = id""")


@query("e01", "Rule adjudication over gathered findings", "ruled", """
SELECT id AS listing_id, rule_verdict AS verdict, rule_reason AS reason,
  CAST(rule_confidence AS DOUBLE) AS confidence FROM ruled""")
def e01(t):
    run = DirectoryRun(t)
    pages = run.gathered.filter("usable").select("listing_id", "pos", "url", "text")
    tel = E.phone_findings(t.phone, pages).select("listing_id", E.finding(
        c("field"), c("stored"), c("live"), c("url"), c("quote"), c("match"),
        phone_id=c("phone_id")).alias("p"))
    shut = E.closure_findings(pages).select("listing_id", E.finding(
        "operating_status", K.STORED_OPEN, c("live"), c("url"), c("quote"), False).alias("k"))
    adr = E.address_findings(t.address, pages).select("listing_id", E.finding(
        "address", c("stored"), c("stored"), c("url"), c("quote"), True).alias("a"))
    rows = t.listing.select(c("id").alias("listing_id"))
    for part in (tel, shut, adr):
        rows = rows.join(part, "listing_id", "left")
    return rows.select("listing_id", E.rule_verdict(c("k"), c("p"), c("a")).alias("r")).select(
        "listing_id", "r.*")


def _result_columns(df, *lists):
    return df.select("resource_id", "verdict", "reason", "confidence",
                     F.array_join(F.transform("fields", lambda f: f["field"]), ",")
                     .alias("fields"), *[F.array_join(x, " ").alias(x) for x in lists])


@query("e02", "Verification result per listing", "verified",
       "SELECT resource_id, verdict, reason, confidence, fields, fetched FROM verified")
def e02(t):
    return _result_columns(DirectoryRun(t).verified, "fetched")


@query("p47", "Change request of each discrepancy", "verified", """
SELECT resource_id, bad_field AS field, bad_stored AS current, bad_live AS proposed, edit_url
FROM verified WHERE verdict = 'discrepancy'""")
def p47(t):
    return DirectoryRun(t).verified.filter(c("change_request").isNotNull()).select(
        "resource_id", "change_request.field", "change_request.current",
        "change_request.proposed", c("change_request.listing_edit_url").alias("edit_url"))


@query("f04", "Findings a reviewer could rule on", "g_phone", f"""
SELECT listing_id, field, stored, live FROM g_phone WHERE trim(stored) <> trim(live)
  AND NOT (field = 'phone' AND {sql_phone_key('stored')} IS NOT DISTINCT FROM
    {sql_phone_key('live')})""")
def f04(t):
    pages = DirectoryRun(t).gathered.filter("usable").select("listing_id", "pos", "url", "text")
    f = E.phone_findings(t.phone, pages)
    return f.filter(E.actionable(F.struct("field", "stored", "live"))).select(
        "listing_id", "field", "stored", "live")


@query("e03", "Verification of many: a bad row costs one row", "verified", """
SELECT resource_id, CASE WHEN bad THEN 'abstain' ELSE verdict END AS verdict,
  CASE WHEN name IS NULL THEN 'the check failed on this record: AttributeError: '
      || '''NoneType'' object has no attribute ''split'''
    WHEN bad THEN 'the check failed on this record: IndexError: list index out of range'
    ELSE reason END AS reason,
  CASE WHEN bad THEN 0.0 WHEN number % 2 = 0 THEN confidence / 2 ELSE confidence END AS confidence,
  CASE WHEN bad THEN '' ELSE fields END AS fields
FROM (SELECT *, name IS NULL OR NOT contains(name, '#') AS bad,
  TRY_CAST(regexp_extract(name, '#([0-9]+)', 1) AS BIGINT) AS number FROM verified)""")
def e03(t):
    # Halves the confidence of even customer numbers. Names without a number break it.
    def by_number(rows):
        odd = [int(n.split("#")[1].split(" ")[0]) % 2 == 1 for n in rows["name"]]
        return rows.assign(confidence=rows["confidence"].where(odd, rows["confidence"] / 2))

    return _result_columns(E.verify_many(DirectoryRun(t).verified, by_number))


check_view("merged", "verified triaged defect listing", """
SELECT coalesce(v.resource_id, d.listing_id) AS resource_id,
  CASE WHEN d.listing_id IS NOT NULL THEN 'discrepancy' ELSE v.verdict END AS verdict,
  CASE WHEN d.listing_id IS NOT NULL THEN d.stored ELSE v.reason END AS reason,
  CASE WHEN d.listing_id IS NOT NULL THEN greatest(coalesce(v.confidence, 0), 0.95)
    ELSE v.confidence END AS confidence,
  CASE WHEN d.listing_id IS NOT NULL THEN concat_ws(',', 'phone_format', nullif(trim(replace(
    ',' || coalesce(v.fields, ''), ',phone_format', ''), ','), '')) ELSE v.fields END AS fields,
  coalesce(v.name, l.name) AS name, coalesce(v.org_website, l.website) AS org_website,
  d.listing_id IS NOT NULL AS structural, v.bad_field, v.bad_stored, v.bad_live, d.stored,
  d.proposed
FROM (SELECT * FROM verified WHERE resource_id IN (SELECT id FROM triaged WHERE triage > 0)) v
FULL JOIN (SELECT d.* FROM defect d JOIN listing l ON d.listing_id = l.id
  WHERE l.status = 'approved') d ON v.resource_id = d.listing_id
LEFT JOIN listing l ON l.id = d.listing_id""")


@query("j09", "Structural findings over the whole corpus merged into checked results", "merged", """
SELECT resource_id, verdict, reason, confidence, fields FROM merged""")
def j09(t):
    return _result_columns(DirectoryRun(t).results)


@query("a18", "Run summary", "merged", """
SELECT count(*) AS checked, count(*) FILTER (verdict = 'discrepancy') AS discrepancies,
  count(*) FILTER (verdict = 'abstain') AS abstained, count(*) FILTER (verdict = 'match') AS matched
FROM merged""")
def a18(t):
    return R.run_summary(DirectoryRun(t).results)


@query("u05", "Verdicts split into queue, abstained and matches", "merged", """
SELECT CASE verdict WHEN 'discrepancy' THEN 'queue' WHEN 'abstain' THEN 'abstained'
  ELSE 'confirmed_matches' END AS part, resource_id FROM merged""")
def u05(t):
    from attestry.session import stored

    parts = R.split_verdicts(stored(DirectoryRun(t).results.select("resource_id", "verdict")))
    rows = [df.select(F.lit(n).alias("part"), "resource_id") for n, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


check_view("queue", "merged radius", """
SELECT m.*, r.size AS blast_size, confidence * (1 + r.size * 0.15::DOUBLE) AS score FROM merged m
JOIN radius r ON r.org_id = 'org:' || m.resource_id WHERE verdict = 'discrepancy'""")


@query("j13", "Result organisations present in the graph", "merged node", """
SELECT resource_id FROM merged WHERE 'org:' || resource_id IN (SELECT id FROM node)""")
def j13(t):
    run = DirectoryRun(t)
    orgs = run.graph.nodes.filter(c("kind") == "org").select(c("id").alias("org_id"))
    return run.results.select("resource_id", F.concat(
        F.lit("org:"), c("resource_id").cast("string")).alias("org_id")).join(
        orgs, "org_id", "left_semi").select("resource_id")


@query("w10", "Queue ranked by priority", "queue", f"""
SELECT resource_id, blast_size, priority,
  row_number() OVER (ORDER BY priority DESC, resource_id) AS position
FROM (SELECT *, {sql_half_even("score")} AS priority FROM queue)""")
def w10(t):
    return R.positions(DirectoryRun(t).queue.select("resource_id", "blast_size", "priority"))


check_view("focus3", "queue triaged", """
SELECT resource_id AS id FROM (SELECT resource_id, 0 AS tier, -round_even(score, 3) AS k FROM queue
  UNION ALL SELECT id, 1, -triage FROM triaged
    WHERE id NOT IN (SELECT resource_id FROM queue))
ORDER BY tier, k, resource_id LIMIT 3""")


@query("w12", "Focus: the top of the queue, topped up from triage", "focus3",
       "SELECT id AS listing_id FROM focus3")
def w12(t):
    run = DirectoryRun(t)
    top = R.ranked(run.queue, 3).select(c("resource_id").alias("id"), F.lit(0).alias("tier"),
                                        (-c("priority")).alias("k"))
    more = R.triage(t.listing, run.as_of, 6).select(
        "id", F.lit(1).alias("tier"), (-c("triage")).alias("k"))
    return (top.unionByName(more).groupBy("id").agg(F.min(F.struct("tier", "k")).alias("o"))
            .orderBy("o", "id").limit(3).select(c("id").alias("listing_id")))


@query("s12", "Results document: its tables written and read back", "merged queue "
       "top_contradiction", """
SELECT 'abstained' AS part, count(*) AS n FROM merged WHERE verdict = 'abstain'
UNION ALL SELECT 'confirmed_matches', count(*) FROM merged WHERE verdict = 'match'
UNION ALL SELECT 'contradictions', count(*) FROM top_contradiction
UNION ALL SELECT 'queue', count(*) FROM queue
UNION ALL SELECT 'stats', 1""")
def s12(t):
    from attestry.operators import entity_graph as G
    from attestry.session import scratch_path, stored
    from attestry.sources.stores import write_tables

    run = DirectoryRun(t)
    results, graph = stored(run.results, "results"), run.graph.saved()
    parts = R.split_verdicts(results)
    tables = {"stats": R.run_summary(results), "abstained": parts["abstained"],
              "confirmed_matches": parts["confirmed_matches"],
              "queue": R.prioritise(results, G.blast_radius(graph)),
              "contradictions": G.top_contradictions(graph)}
    paths = write_tables(tables, scratch_path(t.spark, "results"))
    counts = [t.spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(n).alias("part"), "n") for n, p in sorted(paths.items())]
    out = counts[0]
    for p in counts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- labels and audits

check_view("labelled", "judged",
           f"SELECT *, {sql_label('support', 'contradict')} AS label FROM judged")
check_view("reconciled", "labelled", """
SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY listing_id, key ORDER BY
  CASE label WHEN 'supported' THEN 3 WHEN 'contradicted' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END
    DESC, CASE label WHEN 'supported' THEN support ELSE 0 END DESC, pos) = 1""")


@query("a09", "Best evidence per claim across pages", "reconciled", """
SELECT listing_id, key, label, pos, support, contradict FROM reconciled""")
def a09(t):
    return E.reconcile(E.label_rows(t.judged)).select(
        "listing_id", "key", "label", "pos", "support", "contradict")


@query("a10", "Contradictions, one per field and stored value", "labelled", """
SELECT listing_id, field, min(pos) AS pos, lower(trim(stored)) AS value FROM labelled
WHERE label = 'contradicted' GROUP BY listing_id, field, lower(trim(stored))""")
def a10(t):
    return E.distinct_findings(E.label_rows(t.judged), c("pos")).select(
        "listing_id", "field", "pos", F.lower(F.trim("stored")).alias("value"))


@query("f08", "Contradicted findings and supported confirmations", "reconciled", """
SELECT listing_id, count(*) FILTER (label = 'contradicted') AS contradicted,
  count(*) FILTER (label = 'supported') AS supported FROM reconciled GROUP BY listing_id""")
def f08(t):
    best = E.reconcile(E.label_rows(t.judged))
    return best.groupBy("listing_id").agg(
        F.count_if(c("label") == "contradicted").alias("contradicted"),
        F.count_if(c("label") == "supported").alias("supported"))


check_view("audit_page", "selected best_text", """
SELECT s.listing_id, s.pos, s.url, b.text FROM selected s JOIN best_text b
ON s.listing_id = b.listing_id AND s.url = b.url WHERE length(b.text) >= 200""")
_QUOTE = sql_snippet("g.text", f"regexp_extract(g.text, {q(K.CLOSURE_RE)})")
_CLOSED = (f"regexp_matches(g.text, {q(K.CLOSURE_RE)}) AND NOT regexp_matches({_QUOTE}, "
           f"{q(K.CODE_RE)}) AND (regexp_matches(regexp_extract(g.text, {q(K.CLOSURE_RE)}), "
           f"{q(K.STRONG_CLOSURE_RE)}) OR regexp_matches({_QUOTE}, {q(K.SUBJECT_RE)}))")
check_view("page_verdict", "audit_page tclaim", f"""
SELECT listing_id, key, field, stored, url, pos, support, contradict,
  {sql_label('support', 'contradict')} AS label FROM (
SELECT listing_id, key, field, stored, url, pos, CAST(s[1] AS DOUBLE) AS support,
  CAST(s[2] AS DOUBLE) AS contradict FROM (
SELECT g.listing_id, c.key, c.field, c.stored, g.url, g.pos, CASE c.field
  WHEN 'phone' THEN CASE WHEN {sql_on_page('c.stored', 'g.text')} THEN [0.97, 0.01]
    WHEN regexp_matches(g.text, {q(K.PHONE_RE)}) THEN [0.02, 0.99] ELSE [0.02, 0.01] END
  WHEN 'address' THEN CASE {sql_addr_on_page('c.stored', 'g.text')} WHEN TRUE THEN [0.95, 0.02]
    WHEN FALSE THEN [0.02, 0.02] END
  ELSE CASE WHEN {_CLOSED} THEN [0.01, 0.995] WHEN regexp_matches(g.text, {q(K.HOURS_RE)})
    THEN [0.75, 0.02] ELSE [0.4, 0.2] END END AS s
FROM audit_page g JOIN tclaim c ON g.listing_id = c.listing_id) WHERE s IS NOT NULL)""")


@query("e05", "Every claim judged against every selected page", "page_verdict", """
SELECT listing_id, key, url, support, contradict, label FROM page_verdict""")
def e05(t):
    run = DirectoryRun(t)
    return E.label_rows(X.judge_pages(run.claims, run.audit_rows)).select(
        "listing_id", "key", "url", "support", "contradict", "label")


identity_view("ident_audit", "audit_page")
check_view("verdict", "page_verdict ident_audit", """
SELECT v.* FROM page_verdict v JOIN ident_audit i ON v.listing_id = i.listing_id WHERE i.belongs
QUALIFY row_number() OVER (PARTITION BY v.listing_id, v.key ORDER BY
  CASE label WHEN 'supported' THEN 3 WHEN 'contradicted' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END
    DESC, CASE label WHEN 'supported' THEN support ELSE 0 END DESC, pos) = 1""")


@query("j17", "Reconciled verdicts joined with their claims", "verdict tclaim", """
SELECT v.listing_id, v.key, v.label, c.field, c.stored, c.text AS claim
FROM verdict v JOIN tclaim c ON v.listing_id = c.listing_id AND v.key = c.key""")
def j17(t):
    run = DirectoryRun(t)
    _, verdicts = run.audited()
    return verdicts.select("listing_id", "key", "label").join(
        run.claims.select("listing_id", "key", "field", "stored", c("text").alias("claim")),
        ["listing_id", "key"])


check_view("audit", "listing rule site_page ident_audit verdict audit_page", f"""
SELECT l.id AS listing_id, CASE WHEN l.website IS NULL THEN {q(K.NOTE_NO_WEBSITE)}
    WHEN list_contains(r.disallow, '/') THEN {q(K.NOTE_ROBOTS)}
    WHEN coalesce(s.n, 0) = 0 THEN {q(K.NOTE_NO_PAGES)}
    WHEN i.belongs IS NULL THEN {q(K.NOTE_UNREADABLE)}
    WHEN NOT i.belongs THEN {q(K.NOTE_SUSPECT)} ELSE '' END AS note,
  coalesce(NOT i.belongs, FALSE) AS website_suspect, coalesce(v.nf, 0) AS n_findings,
  coalesce(v.nc, 0) AS n_confirmations, coalesce(u.calls, 0) AS calls,
  round(coalesce(u.tokens, 0) / 1e6 * 0.042, 9) AS cost_usd
FROM listing l LEFT JOIN rule r ON r.website = l.website
LEFT JOIN (SELECT website, count(*) AS n FROM site_page GROUP BY 1) s ON s.website = l.website
LEFT JOIN ident_audit i ON i.listing_id = l.id
LEFT JOIN (SELECT listing_id, count(DISTINCT CASE WHEN label = 'contradicted' THEN field || '|'
    || lower(trim(stored)) END) AS nf, count(*) FILTER (label = 'supported') AS nc
  FROM verdict GROUP BY 1) v ON v.listing_id = l.id
LEFT JOIN (SELECT listing_id, count(*) AS calls, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT))
    AS BIGINT) AS tokens FROM audit_page GROUP BY 1) u ON u.listing_id = l.id""")


@query("e04", "Audit of every listing", "audit", """
SELECT listing_id, note, website_suspect, n_findings, n_confirmations FROM audit""")
def e04(t):
    summary, _ = DirectoryRun(t).audited()
    return summary.select("listing_id", "note", "website_suspect", "n_findings",
                          "n_confirmations")


@query("a11", "Confirmations and cost per listing", "audit", """
SELECT listing_id, n_confirmations, calls, cost_usd FROM audit""")
def a11(t):
    summary, _ = DirectoryRun(t).audited()
    return summary.select("listing_id", "n_confirmations", "calls",
                          F.round("cost_usd", 9).alias("cost_usd"))


# ---------------------------------------------------------------- claims from text

def listing_documents(t):
    """Landed-shape documents, one per order, built from its own columns."""
    d = t.directory
    first = d.phone.filter(c("pos") == 0).select(
        c("listing_id").alias("id"), F.struct(c("phone_id").alias("id"), "number", "service_type",
                                              "country_code").alias("p0"))
    second = d.phone.filter(c("pos") == 1).select(
        c("listing_id").alias("id"), F.struct(c("phone_id").alias("id"), "number", "service_type",
                                              "country_code").alias("p1"))
    places = d.address.select(c("listing_id").alias("id"), F.array(F.struct(
        "address_1", "city", "state_province", "postal_code")).alias("addresses"))
    kinds = d.listing_category.select(c("listing_id").alias("id"), F.array(F.struct(
        c("category_id").alias("id"), "name")).alias("categories"))
    prose = t.documents.select(c("doc_id").alias("id"), c("text").alias("long_description"))
    none = F.lit(None).cast("string")
    docs = (t.listing.join(first, "id").join(second, "id", "left").join(places, "id")
            .join(kinds, "id").join(prose, "id", "left"))
    names = ("application_process", "required_documents", "fee", "wait_time",
             "interpretation_services", "notes", "short_description")
    service = F.struct(
        (c("id") * 10).alias("id"), F.concat(F.lit("Desk "), c("id").cast("string")).alias("name"),
        c("categories"), F.array(F.struct(F.lit("Adults").alias("name"))).alias("eligibilities"),
        c("long_description"), c("category_names").alias("short_description"),
        *[none.alias(n) for n in names if n != "short_description"])
    return docs.select(
        "id", "name", "status", "website", "email", "verified_at", "certified_at", "certified",
        "updated_at", F.filter(F.array("p0", "p1"), lambda p: p.isNotNull()).alias("phones"),
        "addresses", "categories", F.array(service).alias("services"),
        F.struct("hours_known", F.array().cast(
            "array<struct<day:string,opens_at:int,closes_at:int>>").alias("schedule_days"))
        .alias("schedule"), none.alias("eligibilities"), "long_description",
        *[none.alias(n) for n in names])


check_view("rendered", "listing phone address listing_category", """
SELECT l.id AS listing_id, concat_ws(chr(10), 'ORGANISATION: ' || trim(coalesce(l.name, '')),
  'WEBSITE: ' || l.website,
  (SELECT string_agg('PHONE (' || coalesce(nullif(p.service_type, ''), 'Voice') || '): '
    || trim(p.number), chr(10) ORDER BY p.pos) FROM phone p WHERE p.listing_id = l.id
    AND trim(coalesce(p.number, '')) <> ''),
  'ADDRESS: ' || nullif(concat_ws(', ', nullif(trim(a.address_1), ''), nullif(trim(a.city), ''),
    nullif(trim(a.state_province), ''), nullif(trim(a.postal_code), '')), ''),
  'LONG_DESCRIPTION: ' || nullif(trim(d.text, chr(32) || chr(9) || chr(10) || chr(13)), ''),
  chr(10) || 'SERVICE: Desk ' || l.id, '  ELIGIBILITY: Adults',
  '  LONG_DESCRIPTION: ' || nullif(trim(d.text, chr(32) || chr(9) || chr(10) || chr(13)), ''),
  '  SHORT_DESCRIPTION: ' || l.category_names) AS text
FROM listing l JOIN address a ON a.listing_id = l.id LEFT JOIN documents d ON d.doc_id = l.id""")


@query("p19", "Listing rendered as text", "rendered", "SELECT listing_id, text FROM rendered")
def p19(t):
    return listing_documents(t).select(c("id").alias("listing_id"),
                                       CL.listing_text().alias("text"))


def replies(t):
    """Extractor replies: JSON wrapped in chatter, three claims per conversation turn."""
    def claim(field, text, stored):
        return F.struct(field.alias("field"), text.alias("text"), stored.alias("stored"))

    text = F.concat(F.lit("The "), "text")
    payload = F.to_json(F.struct(F.array(
        claim(F.when(c("role") == "user", " Fee ").otherwise("colour"), text, c("text")),
        claim(F.lit("language"), F.concat(F.lit("THE "), "text"), F.lit("")),
        claim(F.lit("wait"), F.concat(F.lit("This desk serves "), c("role")), c("role")),
        claim(F.lit("phone"), F.lit("It has no subject"), c("role")),
        claim(F.lit("phone"), F.lit("The short"), c("role"))).alias("claims")))
    body = F.when(c("role") == "system", F.lit("no claims here")).otherwise(
        F.concat(F.lit("Sure, here: "), payload, F.lit(" - done")))
    return t.conversations.select((c("conv_id") * 100 + c("turn")).alias("listing_id"),
                                  body.alias("reply"))


check_view("extracted", "", """
SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY n) - 1 AS pos, field, text,
  stored, source FROM (
SELECT conv_id * 100 + turn AS listing_id, 1 AS n, 'eligibility' AS field,
  trim('The ' || text, chr(32) || chr(9) || chr(10) || chr(13)) AS text,
  trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS stored, 'fee' AS source,
  length(trim('The ' || text, chr(32) || chr(9) || chr(10) || chr(13))) AS size
  FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id * 100 + turn, 2, 'services', trim('THE ' || text,
  chr(32) || chr(9) || chr(10) || chr(13)), '', 'language',
  length(trim('The ' || text, chr(32) || chr(9) || chr(10) || chr(13)))
  FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id * 100 + turn, 3, 'services', 'This desk serves ' || role, role, 'wait', 99
  FROM conversations WHERE role <> 'system') WHERE size >= 12""")


@query("p20", "Extracted claims cleaned", "extracted", """
SELECT listing_id, source, text, stored FROM extracted""")
def p20(t):
    return CL.clean_extracted(replies(t)).select("listing_id", "source", "text", "stored")


@query("p21", "Extracted claims keyed and mapped to page hints", "extracted", """
SELECT listing_id, 'c' || pos AS key, field, source FROM extracted""")
def p21(t):
    return CL.clean_extracted(replies(t)).select("listing_id", "key", "field", "source")


@query("u01", "Template and extracted claims united, templates first", "tclaim extracted", """
SELECT listing_id, key, field FROM tclaim
UNION ALL SELECT listing_id, 'xc' || pos, field FROM extracted""")
def u01(t):
    return CL.union_claims(CL.template_claims(t.directory), CL.clean_extracted(replies(t))).select(
        "listing_id", "key", "field")


@query("s10", "Versioned claim store: only new listing versions are extracted", "listing", """
SELECT id AS listing_id, substr(sha256(id || ':' || updated_at || ':' || coalesce(name, '')), 1, 20)
  AS version FROM listing WHERE status <> 'approved'""")
def s10(t):
    from attestry.session import scratch_path
    from attestry.sources import stores

    path = scratch_path(t.spark, "claims")
    done = t.listing.filter(c("status") == "approved").withColumn("version", stores.version_key())
    claims = CL.template_claims(t.directory).join(
        done.select(c("id").alias("listing_id"), "version"), "listing_id")
    stores.append_claims(claims.drop("ord"), path)
    fresh = stores.new_versions(t.listing, t.spark.read.parquet(path))
    return fresh.select(c("id").alias("listing_id"), "version")


@query("s11", "Stored listing versions counted", "listing", """
SELECT count(DISTINCT (id, updated_at, name)) AS cached_listings FROM listing
WHERE status = 'approved'""")
def s11(t):
    from attestry.session import scratch_path
    from attestry.sources import stores

    path = scratch_path(t.spark, "claims")
    done = t.listing.filter(c("status") == "approved").withColumn("version", stores.version_key())
    stores.append_claims(done.select(c("id").alias("listing_id"), "version"), path)
    return stores.stored_listings(t.spark.read.parquet(path))


# ---------------------------------------------------------------- scorers plugged in

@query("x01", "A plugged-in judge, one call per page with all its claims", "audit_page tclaim", f"""
SELECT g.listing_id, c.key, g.url, CASE WHEN contains({sql_raw_digits('g.text')},
  right({sql_digits('c.stored')}, 7)) THEN 0.9 ELSE 0.1 END::DOUBLE AS support
FROM audit_page g JOIN tclaim c ON g.listing_id = c.listing_id WHERE c.field = 'phone'""")
def x01(t):
    def last_seven(page_text, claims):
        import re

        page = re.sub(r"\D", "", page_text)

        def score(stored):
            cut = re.sub(r"(?i)\b(?:ext\.?|extension|x)\b.*$", "", stored)
            return 0.9 if re.sub(r"\D", "", cut)[-7:] in page else 0.1

        return [(score(c["stored"]), 0.0) for c in claims]

    run = DirectoryRun(t)
    phones = run.claims.filter(c("field") == "phone")
    return X.judge_pages(phones, run.audit_rows, last_seven).select(
        "listing_id", "key", "url", "support")


@query("x02", "A plugged-in extractor over rendered listings", "rendered", """
SELECT listing_id, 'The listing renders to ' || length(text) || ' characters' AS text
FROM rendered""")
def x02(t):
    def describe(texts):
        import json

        return texts.map(lambda s: "ok " + json.dumps({"claims": [{
            "field": "service", "stored": str(len(s)),
            "text": f"The listing renders to {len(s)} characters"}]}))

    docs = listing_documents(t).select(c("id").alias("listing_id"),
                                       CL.listing_text().alias("text"))
    return CL.clean_extracted(X.map_text(docs, "text", describe)).select("listing_id", "text")


@query("x03", "A plugged-in adjudicator; invalid answers fall back to the rules", "ruled", """
SELECT id AS listing_id, CASE WHEN k IS NOT NULL THEN 'abstain' ELSE rule_verdict END AS verdict,
  CASE WHEN k IS NOT NULL THEN 0.5 ELSE CAST(rule_confidence AS DOUBLE) END AS confidence
FROM ruled WHERE has_text AND website IS NOT NULL AND s IS NULL
  AND NOT (k IS NULL AND rule_verdict = 'discrepancy' AND NOT p_usable)""")
def x03(t):
    def doubtful(texts):
        return texts.map(lambda s: '{"verdict":"abstain"}' if "operating_status" in s
                         else '{"verdict":"perhaps"}')

    run = DirectoryRun(t)
    pages = run.gathered.filter("usable").select("listing_id", "pos", "url", "text")
    out = E.verify(t.listing, t.phone, t.address, pages, run.structural, judge=doubtful)
    read = pages.select(c("listing_id").alias("resource_id")).distinct()
    broken = run.structural.select(c("listing_id").alias("resource_id"))
    return (out.join(read, "resource_id", "left_semi").join(broken, "resource_id", "left_anti")
            .filter(c("org_website").isNotNull())
            .select(c("resource_id").alias("listing_id"), "verdict", "confidence"))


@query("x05", "Span picker: the first span that carries a number", "page", f"""
SELECT listing_id, url, ix AS i, span FROM (
  SELECT listing_id, url, ix, s AS span, row_number() OVER (PARTITION BY listing_id, url
    ORDER BY ix) AS r FROM (SELECT listing_id, url, unnest(l) AS s, unnest(range(len(l))) AS ix
    FROM (SELECT listing_id, url, list_filter(string_split(regexp_replace(text, '([.!?])\\s+',
      '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM page))
  WHERE regexp_matches(s, {q(K.PHONE_RE)})) WHERE r = 1""")
def x05(t):
    return X.first_span(t.page, K.PHONE_RE, "listing_id", "url")


# The judged rows of an experiment: every benchmark text against every document, by the share
# of its longer words that the document holds. The forms answer on scales of their own.
check_view("xpair", "", """
SELECT CAST(d.doc_id AS VARCHAR) AS url, CAST(b.item_id AS VARCHAR) AS key,
  contains(d.text, b.text) AS truth, len(list_intersect(b.w, d.w)) / len(b.w) AS o
FROM (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
    lambda w: length(w) > 3)) AS w FROM documents) d
CROSS JOIN (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
    lambda w: length(w) > 3)) AS w FROM benchmark) b""")
check_view("xlong", "xpair", """
SELECT unnest(['baseline', 'structured_state', 'structured_all', 'score', 'noul_pair']) AS variant,
  url, key, truth, unnest([o, o, floor(o * 8 + 0.5) / 8, floor(o * 3 + 0.5) / 3, o * o]) AS support,
  unnest([1 - o, 1 - o, 1 - floor(o * 8 + 0.5) / 8,
    CASE WHEN floor(o * 3 + 0.5) = 0 THEN 1.0 ELSE 0.0 END, 1 - o * o]) AS contradict
FROM xpair""")


@query("x06", "Registered scorers over the same rows, long form", "xlong", """
SELECT CASE variant WHEN 'baseline' THEN 'choice' ELSE 'two_noul' END AS scorer,
  count(*) AS rows, round(sum(support), 4) AS total FROM xlong
WHERE variant IN ('baseline', 'noul_pair') GROUP BY variant""")
def x06(t):
    return experiment(t).scores(EX.READINGS.names()).groupBy("scorer").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("score"), 4).alias("total"))


def longer(text):
    return frozenset(w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 3)


@lru_cache(maxsize=1 << 14)
def read_question(payload):
    """A question and its claim's longer words; every page is asked the same ones."""
    asked = json.loads(payload)
    return asked, longer(asked["claim"])


@lru_cache(maxsize=16)
def page_words(state):
    """A page's longer words; its requests come one after another."""
    return longer(json.loads(state)["page_text"] if state.startswith('{"organisation"') else state)


def word_share(state, questions):
    """Answers by the share of a claim's longer words that the page holds."""
    page = page_words(state)
    out, shares = {}, {}
    for name, payload in questions.items():
        asked, claim = read_question(payload)
        o = shares.get(asked["claim"])
        if o is None:
            o = shares[asked["claim"]] = len(claim & page) / len(claim)
        if asked["question"] == "criteria":
            o = math.floor(o * 8 + 0.5) / 8
        if asked["type"] == "choice":
            out[name] = {"choice": "supports" if o > 0.5 else "says_nothing", "confidence": o,
                         "probabilities": {"supports": o, "contradicts": 1 - o}}
        elif asked["type"] == "score":
            level = math.floor(o * 3 + 0.5)
            out[name] = {"score": float(level), "probabilities": {"0": 0.0 if level else 1.0}}
        else:
            out[name] = {"noul": o * o if asked["question"] == "support" else 1 - o * o}
    return out


def experiment(t):
    """All variants over documents as pages and benchmark texts as claims."""
    # The benchmark is the stated set of claims, the same for every page.
    claims = t.benchmark.select(
        F.lit(0).alias("grp"), c("item_id").cast("string").alias("key"), c("text").alias("claim"),
        c("item_id").alias("p"))
    pages = t.documents.select(
        F.lit(0).alias("grp"), c("doc_id").cast("string").alias("url"), c("source").alias("org"),
        "text")
    return EX.run(pages, claims, EX.Scorer("word share", word_share,
                                           frozenset({"noul", "choice", "score"})))


check_view("payload", "tclaim page", """
SELECT listing_id, key, 'support' AS form, '{"type":"noul","question":"support","claim":"' || text
  || '","options":["true","false"]}' AS payload FROM tclaim UNION ALL
SELECT listing_id, key, 'contradict', '{"type":"noul","question":"contradict","claim":"' || text
  || '","options":["true","false"]}' FROM tclaim UNION ALL
SELECT listing_id, key, 'relation', '{"type":"choice","question":"relation","claim":"' || text
  || '","options":["supports","contradicts","says_nothing"]}' FROM tclaim UNION ALL
SELECT listing_id, key, 'criteria', '{"type":"choice","question":"criteria","claim":"' || text
  || '","options":[{"option":"supports","holds_when":"the page gives the claimed value or makes '
  || 'it certain"},{"option":"contradicts","holds_when":"the page gives another value for it or '
  || 'denies it"},{"option":"says_nothing","holds_when":"the page is silent on it"}]}'
FROM tclaim UNION ALL
SELECT listing_id, key, 'ordinal', '{"type":"score","question":"ordinal","claim":"' || text
  || '","options":["0","1","2","3"]}' FROM tclaim UNION ALL
SELECT listing_id, url, 'object', '{"organisation":"' || website || '","page_url":"' || url
  || '","page_text":"' || text || '"}' FROM page UNION ALL
SELECT listing_id, url, 'text', text FROM page""")


@query("x07", "Question payloads and states built before a scorer, too many options flagged",
       "payload tclaim", """
SELECT listing_id, key, form, md5(payload) AS payload, NULL::VARCHAR AS error FROM payload
UNION ALL SELECT listing_id, key, 'options', NULL,
  CASE WHEN p = 0 AND t = 1 THEN '301 options, at most 255' END FROM tclaim""")
def x07(t):
    claims = CL.template_claims(t.directory).select("listing_id", "key", "field", "text")
    none = F.lit(None).cast("string")
    forms = F.explode(F.array(*[
        F.struct(F.lit(f).alias("form"), X.question(f, c("text")).alias("payload"))
        for f in ("support", "contradict", "relation", "criteria", "ordinal")]))
    asked = claims.select("listing_id", "key", forms.alias("f")).select(
        "listing_id", "key", "f.form", "f.payload")
    states = t.page.select("listing_id", c("url").alias("key"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("form"),
                 X.state_column(f, c("text"), c("website"), c("url")).alias("payload"))
        for f in ("object", "text")])).alias("f")).select("listing_id", "key", "f.form",
                                                          "f.payload")
    # An address claim offers three hundred spans, above what one question may carry.
    n = F.when(c("field") == "address", 300).otherwise(5)
    options = F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))
    flagged = claims.select("listing_id", "key", F.lit("options").alias("form"),
                            none.alias("payload"),
                            X.option_question(c("text"), options, "s")["error"].alias("error"))
    return asked.unionByName(states).select(
        "listing_id", "key", "form", F.md5("payload").alias("payload"), none.alias("error")
    ).unionByName(flagged)
