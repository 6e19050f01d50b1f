"""Freshness roll-ups and calibration metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions import scoring as SC
from attestry.operators import calibration as CA
from attestry.operators import claims as CL
from attestry.operators import containment as CN
from attestry.operators import freshness as FR
from attestry.plans.adapters import AS_OF, EVENTS_AS_OF
from attestry.plans.catalog import check_view, query
from attestry.plans.queries_columns import (
    claim_needles,
    rollup_view,
    sql_age,
    sql_case,
    sql_score,
)
from attestry.plans.queries_evidence import experiment
from attestry.session import stored

c = F.col
BY = ["scorer"]


# ---------------------------------------------------------------- freshness

@query("a01", "Provenance baseline", "listing", f"""
SELECT count(*) AS sampled, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'approved' AND coalesce(verified_at, '') = ''
    AND coalesce(certified_at, '') = '' AND NOT certified) AS no_verification_signal,
  CAST(trunc(median({sql_age('updated_at', clamp=False)}) FILTER (status = 'approved')) AS INT)
    AS median_updated_age_days,
  count(*) FILTER (status = 'approved' AND {sql_age('updated_at', clamp=False)} <= 90)
    AS updated_last_90d,
  count(*) FILTER (status = 'approved' AND coalesce(website, '') <> '') AS with_website
FROM listing""")
def a01(t):
    return FR.provenance_baseline(t.listing, AS_OF)


@query("f09", "Listings without any verification signal", "listing", """
SELECT id AS listing_id FROM listing WHERE status = 'approved' AND coalesce(verified_at, '') = ''
  AND coalesce(certified_at, '') = '' AND NOT certified""")
def f09(t):
    blank = [F.coalesce(x, F.lit("")) == "" for x in ("verified_at", "certified_at")]
    return t.listing.filter((c("status") == "approved") & blank[0] & blank[1] & ~c("certified")
                            ).select(c("id").alias("listing_id"))


def event_scores(t):
    """Best evidence per (user, field) from event kinds, scored; one shuffle, partial sums."""
    def last(kind):
        return F.max(F.when(c("event_type") == kind, c("ts"))).alias(kind)

    latest = t.event_field.groupBy("listing_id", "field").agg(
        last("purchase"), last("click"), last("view"))
    def iso(x):
        return F.date_format(c(x), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    found = FR.best_evidence(iso("purchase"), iso("click"), c("view").isNotNull(), iso("view"),
                             EVENTS_AS_OF)
    return latest.select("listing_id", "field", found.alias("b")).select(
        "listing_id", "field", c("b.evidence").alias("evidence"), c("b.age").alias("age_days"),
        SC.field_score(c("field"), c("b.evidence"), c("b.age")).alias("score"))


check_view("event_score", "event_field", f"""
SELECT listing_id, field, evidence, {sql_score('field', 'evidence', 'age')} AS score FROM (
SELECT listing_id, field, CASE WHEN p IS NOT NULL THEN 'human_verified' WHEN k IS NOT NULL
    THEN 'source_agreement' WHEN v IS NOT NULL THEN 'structural_ok' ELSE 'none' END AS evidence,
  {sql_age('coalesce(p, k, v)', EVENTS_AS_OF)} AS age
FROM (SELECT listing_id, field, max(ts) FILTER (event_type = 'purchase') AS p,
    max(ts) FILTER (event_type = 'click') AS k, max(ts) FILTER (event_type = 'view') AS v
  FROM event_field GROUP BY 1, 2))""")
rollup_view("event_fresh", "event_score")


@query("a02", "Listing freshness and coverage from events", "event_fresh", """
SELECT listing_id, round(exact, 6) AS freshness, coverage, band FROM event_fresh""")
def a02(t):
    return FR.long_rollup(event_scores(t)).select(
        "listing_id", F.round("exact", 6).alias("freshness"), "coverage", "band")


def _pct(b):
    return f"round_even(100.0 * count(*) FILTER (band = '{b}') / count(*), 1) AS pct_{b}"


_BANDS = [b for b, _ in K.BANDS] + [K.LAST_BAND]


@query("a03", "Directory report", "freshc", f"""
SELECT count(*) AS listings, round(avg(freshness), 1) AS mean_freshness,
  {', '.join(f"count(*) FILTER (band = '{b}') AS n_{b}" for b in _BANDS)},
  {', '.join(_pct(b) for b in _BANDS)},
  (SELECT freshness FROM (SELECT freshness, row_number() OVER (ORDER BY freshness) AS r,
     count(*) OVER () AS n FROM freshc) WHERE r = n // 2 + 1) AS median_freshness
FROM freshc""")
def a03(t):
    return FR.report(FR.rollup(FR.field_scores(t.directory, AS_OF, t.confirmation)))


check_view("gain", "evid", f"""
SELECT listing_id, field, score_gain FROM (SELECT listing_id, field,
  round_even((90.0 - score) * w, 1) AS score_gain, row_number() OVER (PARTITION BY listing_id
    ORDER BY (90.0 - score) * w DESC, fpos) AS r
FROM (SELECT *, CAST({sql_case('field', K.WEIGHT, 0)} AS DOUBLE) AS w FROM evid)
WHERE evidence <> 'none' AND (90.0 - score) * w > 0) WHERE r = 1""")


@query("w08", "Next best action per listing", "gain", "SELECT listing_id, field FROM gain")
def w08(t):
    return FR.rollup(FR.field_scores(t.directory, AS_OF)).filter(c("next").isNotNull()).select(
        c("id").alias("listing_id"), c("next.field").alias("field"))


@query("w07", "Worst listings with their next action", "fresh gain", """
SELECT f.listing_id, f.freshness, f.band, g.field AS next_field FROM (
  SELECT * FROM fresh ORDER BY freshness, listing_id LIMIT 25) f
LEFT JOIN gain g ON f.listing_id = g.listing_id""")
def w07(t):
    return FR.worst(FR.rollup(FR.field_scores(t.directory, AS_OF))).select(
        c("id").alias("listing_id"), "freshness", "band", c("next.field").alias("next_field"))


@query("j11", "Confirmations onto listings", "listing confirmation", """
SELECT l.id AS listing_id, {} FROM listing l LEFT JOIN confirmation k ON k.listing_id = l.id
GROUP BY l.id""".format(", ".join(
    f"max(confirmed_at) FILTER (field = '{f}') AS conf_{f}" for f in K.WEIGHT)))
def j11(t):
    conf = FR.confirmation_columns(t.confirmation)
    return t.listing.select("id").join(conf, "id", "left").withColumnRenamed("id", "listing_id")


@query("u06", "Confirmed matches to field confirmations", "merged", f"""
SELECT resource_id AS listing_id, unnest(CASE WHEN coalesce(fields, '') <> ''
  THEN string_split(fields, ',') ELSE ['phone', 'address', 'schedule'] END) AS field,
  '{AS_OF}' AS confirmed_at FROM merged WHERE verdict = 'match'""")
def u06(t):
    from attestry.plans.pipeline import DirectoryRun

    return DirectoryRun(t, AS_OF).confirmations


@query("s14", "Freshness report written and read back", "freshc", """
SELECT band, count(*) AS listings, round(avg(exact), 6) AS mean_exact
FROM freshc GROUP BY band""")
def s14(t):
    from attestry.session import scratch_path
    from attestry.sources.stores import write_tables

    scores = FR.rollup(FR.field_scores(t.directory, AS_OF, t.confirmation))
    path = scratch_path(t.spark, "freshness")
    paths = write_tables({"listings": scores.select("id", "exact", "freshness", "coverage", "band")}, path)
    saved = t.spark.read.parquet(paths["listings"])
    write_tables({"report": FR.report(saved)}, path, "json")
    return saved.groupBy("band").agg(F.count(F.lit(1)).alias("listings"),
                                     F.round(F.avg("exact"), 6).alias("mean_exact"))


# ---------------------------------------------------------------- calibration

check_view("decided", "scored", """
SELECT * FROM scored WHERE truth IS NOT NULL AND support IS NOT NULL""")
check_view("half", "decided", """
SELECT org_id, CASE WHEN row_number() OVER (ORDER BY md5(org_id || ':17'), org_id)
  <= count(*) OVER () // 2 THEN 'calibration' ELSE 'test' END AS half
FROM (SELECT DISTINCT org_id FROM decided)""")


def rows(t):
    return CA.decidable(t.scored)


@query("f06", "Undecidable and unscored rows dropped", "oracle_row decided", """
SELECT 'oracle ' || field AS part, count(*) AS n FROM oracle_row WHERE truth IS NOT NULL
GROUP BY field
UNION ALL SELECT 'scorer ' || scorer, count(*) FROM decided GROUP BY scorer""")
def f06(t):
    judged = CN.counts(claim_needles(t), t.page).filter("truth IS NOT NULL")
    a = judged.groupBy(F.concat(F.lit("oracle "), "field").alias("part")).agg(
        F.sum("n").alias("n"))
    b = rows(t).groupBy(F.concat(F.lit("scorer "), "scorer").alias("part")).agg(
        F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


@query("f07", "Calibration population", "listing phone address", """
SELECT id AS listing_id FROM listing l WHERE status = 'approved' AND coalesce(website, '') <> ''
  AND (EXISTS (SELECT 1 FROM phone p WHERE p.listing_id = l.id AND p.number IS NOT NULL)
    OR EXISTS (SELECT 1 FROM address a WHERE a.listing_id = l.id AND a.address_1 <> ''))""")
def f07(t):
    contacts = t.phone.filter(c("number").isNotNull()).select("listing_id").unionByName(
        t.address.filter(c("address_1") != "").select("listing_id"))
    return CA.population(t.listing, contacts).select(c("id").alias("listing_id"))


@query("w14", "Seeded split by organisation", "half", "SELECT org_id, half FROM half")
def w14(t):
    return CA.split_by_org(rows(t))


@query("w15", "Seeded sample of listings", "listing", """
SELECT id AS listing_id FROM listing ORDER BY md5(id || ':11'), id LIMIT 40""")
def w15(t):
    return CA.sample_listings(t.listing.select("id"), 40).withColumnRenamed("id", "listing_id")


@query("j16", "Rows of each half, organisations disjoint", "decided half", """
SELECT d.scorer, h.half, count(*) AS n, count(DISTINCT d.org_id) AS orgs
FROM decided d JOIN half h ON d.org_id = h.org_id GROUP BY 1, 2""")
def j16(t):
    # An organisation's rows are counted once; halves are made and met by its counts only.
    per = stored(rows(t).groupBy("scorer", "org_id").agg(F.count(F.lit(1)).alias("m")), "per")
    cal = CA.split_by_org(per).filter(c("half") == "calibration").select("org_id")
    both = per.join(cal, "org_id", "left_semi").withColumn("half", F.lit("calibration")
                                                           ).unionByName(
        per.join(cal, "org_id", "left_anti").withColumn("half", F.lit("test")))
    return both.groupBy("scorer", "half").agg(F.sum("m").alias("n"),
                                              F.count(F.lit(1)).alias("orgs"))


@query("a05", "Metrics at the working threshold", "decided", """
SELECT scorer, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision,
  round(tp / nullif(tp + fn, 0), 6) AS recall FROM (
SELECT scorer, count(*) FILTER (support >= 0.69 AND truth) AS tp,
  count(*) FILTER (support >= 0.69 AND NOT truth) AS fp,
  count(*) FILTER (support < 0.69 AND truth) AS fn FROM decided GROUP BY scorer)""")
def a05(t):
    m = CA.at_threshold(rows(t), BY, F.lit(K.SUPPORT_THRESHOLD))
    return m.withColumns({x: F.round(x, 6) for x in ("precision", "recall")})


check_view("swept", "decided half", """
SELECT scorer, half, threshold, tp, fp, fn, tp / nullif(tp + fp, 0) AS precision,
  tp / nullif(tp + fn, 0) AS recall FROM (
SELECT scorer, half, i / 100.0 AS threshold,
  count(*) FILTER (support >= CAST(i / 100.0 AS DOUBLE) AND truth) AS tp,
  count(*) FILTER (support >= CAST(i / 100.0 AS DOUBLE) AND NOT truth) AS fp,
  count(*) FILTER (support < CAST(i / 100.0 AS DOUBLE) AND truth) AS fn
FROM decided d JOIN half h ON d.org_id = h.org_id, range(101) g(i) GROUP BY 1, 2, 3)""")


def _halved(t):
    r = rows(t)
    return CA.with_half(r, CA.split_by_org(r))


@query("a06", "Sweep of 101 thresholds", "swept", """
SELECT scorer, half, CAST(threshold AS DOUBLE) AS threshold, tp, fp, fn,
  round(precision, 6) AS precision, round(recall, 6) AS recall FROM swept""")
def a06(t):
    return CA.sweep(_halved(t), ["scorer", "half"]).withColumns(
        {x: F.round(x, 6) for x in ("precision", "recall")})


check_view("ece", "decided half", """
SELECT scorer, half, sum(n * abs(conf - acc)) / sum(n) AS ece FROM (
SELECT scorer, half, least(floor(support * 10), 9) AS b, count(*) AS n, avg(support) AS conf,
  avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END) AS acc
FROM decided d JOIN half h ON d.org_id = h.org_id GROUP BY 1, 2, 3) GROUP BY 1, 2""")


@query("a07", "Expected calibration error", "ece",
       "SELECT scorer, half, round(ece, 6) AS ece FROM ece")
def a07(t):
    return CA.ece(_halved(t), ["scorer", "half"]).withColumn("ece", F.round("ece", 6))


check_view("auroc", "decided half", """
SELECT scorer, half, (sum(r) FILTER (truth) - pos * (pos + 1) / 2.0) / (pos * neg) AS auroc
FROM (SELECT scorer, half, truth,
  rank() OVER (PARTITION BY scorer, half ORDER BY support)
    + (count(*) OVER (PARTITION BY scorer, half, support) - 1) / 2.0 AS r,
  count(*) FILTER (truth) OVER (PARTITION BY scorer, half) AS pos,
  count(*) FILTER (NOT truth) OVER (PARTITION BY scorer, half) AS neg
FROM decided d JOIN half h ON d.org_id = h.org_id) GROUP BY scorer, half, pos, neg""")


@query("a08", "AUROC with half-credit ties", "auroc",
       "SELECT scorer, half, round(auroc, 6) AS auroc FROM auroc")
def a08(t):
    return CA.auroc(_halved(t), ["scorer", "half"]).withColumn("auroc", F.round("auroc", 6))


@query("j15", "Positive-negative score pairs, counted without forming them", "auroc decided half", """
SELECT a.scorer, a.half, pairs, round(auroc * pairs, 1) AS wins FROM auroc a JOIN (
  SELECT scorer, half, count(*) FILTER (truth) * count(*) FILTER (NOT truth) AS pairs
  FROM decided d JOIN half h ON d.org_id = h.org_id GROUP BY 1, 2) p
ON a.scorer = p.scorer AND a.half = p.half""")
def j15(t):
    h = _halved(t)
    pairs = h.groupBy("scorer", "half").agg(
        (F.count_if("truth") * F.count_if(~c("truth"))).alias("pairs"))
    return CA.auroc(h, ["scorer", "half"]).join(pairs, ["scorer", "half"]).select(
        "scorer", "half", "pairs", F.round(c("auroc") * c("pairs"), 1).alias("wins"))


# The stated target, and one that the derived scores of most scorers reach.
TARGETS = (K.TARGET_PRECISION, 0.5)
check_view("plateau", "swept", f"""
SELECT scorer, half, target, threshold, precision, row_number() OVER (PARTITION BY scorer, half,
  target ORDER BY threshold) AS pos, count(*) OVER (PARTITION BY scorer, half, target) AS n
FROM (SELECT *, max(precision) OVER (PARTITION BY scorer, half, target) AS best
  FROM swept CROSS JOIN (VALUES {", ".join(f"({x}::DOUBLE)" for x in TARGETS)}) v(target)
  WHERE precision >= target AND tp > 0) WHERE precision >= best - 1e-9""")
check_view("chosen", "plateau",
           "SELECT * FROM plateau WHERE pos = n // 2 + 1")


@query("w13", "Threshold in the middle of the best plateau", "chosen", """
SELECT scorer, half, target, CAST(threshold AS DOUBLE) AS threshold,
  round(precision, 6) AS precision FROM chosen""")
def w13(t):
    by = ["scorer", "half"]
    swept = stored(CA.sweep(_halved(t), by), "swept")
    strict, lax = (CA.choose_threshold(swept, by, x).select(
        "scorer", "half", F.lit(x).alias("target"), "threshold",
        F.round("precision", 6).alias("precision")) for x in TARGETS)
    return strict.unionByName(lax)


@query("a15", "Rows and positives per field", "decided", """
SELECT field, count(*) AS rows, count(*) FILTER (truth) AS positives FROM decided GROUP BY field""")
def a15(t):
    return CA.field_profile(rows(t))


check_view("bars", "decided half", """
SELECT scorer, CAST(bar AS DOUBLE) AS bar, count(*) FILTER (contradict >= bar) AS flagged,
  count(*) FILTER (contradict >= bar AND truth) AS wrong
FROM decided d JOIN half h ON d.org_id = h.org_id, (VALUES (0.9), (0.95), (0.99)) b(bar)
WHERE half = 'test' GROUP BY 1, 2""")


@query("a16", "False accusations at high contradict scores", "bars",
       "SELECT scorer, bar, flagged, wrong FROM bars")
def a16(t):
    return CA.accusations(_halved(t).filter(c("half") == "test"), BY)


check_view("best", "swept", """
SELECT scorer, threshold, precision, recall FROM (SELECT *, row_number() OVER (
  PARTITION BY scorer ORDER BY coalesce(precision, 0) DESC, coalesce(recall, 0) DESC, threshold)
  AS r FROM swept WHERE half = 'test' AND threshold >= 0.5 AND threshold < 0.995) WHERE r = 1""")


@query("a17", "Best precision on the test half", "best", """
SELECT scorer, CAST(threshold AS DOUBLE) AS threshold, round(precision, 6) AS precision FROM best""")
def a17(t):
    test = _halved(t).filter(c("half") == "test")
    return CA.ceiling(CA.sweep(test, BY), BY).select(
        "scorer", "threshold", F.round("precision", 6).alias("precision"))


_REPORT_SQL = """
SELECT s.scorer, s.rows, s.positives, s.test_rows, round(a.auroc, 6) AS auroc,
  round(e.ece, 6) AS ece, CAST(k.threshold AS DOUBLE) AS chosen, w.tp AS held_tp, w.fp AS held_fp,
  w.fn AS held_fn, round(w.precision, 6) AS held_precision
FROM (SELECT scorer, count(*) AS rows, count(*) FILTER (truth) AS positives,
    count(*) FILTER (half = 'test') AS test_rows
  FROM decided d JOIN half h ON d.org_id = h.org_id GROUP BY scorer) s
LEFT JOIN auroc a ON a.scorer = s.scorer AND a.half = 'test'
LEFT JOIN ece e ON e.scorer = s.scorer AND e.half = 'test'
LEFT JOIN chosen k ON k.scorer = s.scorer AND k.half = 'calibration' AND k.target = {target}
LEFT JOIN swept w ON w.scorer = s.scorer AND w.half = 'test' AND w.threshold = k.threshold""".replace("{target}", str(TARGETS[0]))


def _report(r, halves):
    out = CA.report(r, halves, TARGETS[0])
    return out.select("scorer", "rows", "positives", "test_rows", F.round("auroc", 6).alias("auroc"),
                      F.round("ece", 6).alias("ece"), "chosen", "held_tp", "held_fp", "held_fn",
                      F.round("held_precision", 6).alias("held_precision"))


@query("e06", "Calibration report", "decided half auroc ece chosen swept", _REPORT_SQL)
def e06(t):
    r = rows(t)
    return _report(r, CA.split_by_org(r))


@query("s15", "Calibration rows saved and re-scored", "decided half auroc ece chosen swept",
       _REPORT_SQL)
def s15(t):
    from attestry.session import scratch_path
    from attestry.sources.stores import write_tables

    paths = write_tables({"rows": t.scored}, scratch_path(t.spark, "calibration"))
    saved = CA.decidable(t.spark.read.parquet(paths["rows"]))
    return _report(saved, CA.split_by_org(saved))


# Variants: the same (url, claim) rows scored by several question forms; see `experiment`.

def variant_rows(t):
    """(oracle rows, judged rows) of the experiment, both long and keyed by (url, key)."""
    pages = t.documents.select(c("doc_id").cast("string").alias("url"), "text", F.lit(0).alias("g"))
    claims = t.benchmark.select(c("item_id").cast("string").alias("key"), c("text").alias("claim"),
                                F.lit(0).alias("g"))
    # Whole texts meet the stated claims, an array of them per page; only the truth leaves.
    listed = claims.groupBy("g").agg(F.collect_list(F.struct("key", "claim")).alias("claims"))
    told = F.transform("claims", lambda x: F.struct(
        x["key"].alias("key"), F.contains(F.col("text"), x["claim"]).alias("truth")))
    oracle = pages.join(listed, "g").select("url", F.explode(told).alias("o")).select(
        "url", c("url").alias("org_id"), "o.key", "o.truth")
    return oracle, experiment(t).rows


@query("j06", "Judged rows joined with oracle rows on page and claim", "xlong", """
SELECT variant, truth, count(*) AS n, round(sum(support), 4) AS support FROM xlong GROUP BY 1, 2""")
def j06(t):
    oracle, judged = variant_rows(t)
    return judged.join(oracle, ["url", "key"]).groupBy("variant", "truth").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("support"), 4).alias("support"))


check_view("vtest", "xlong", """
SELECT v.* FROM xlong v JOIN (SELECT url, row_number() OVER (ORDER BY md5(url || ':17'),
    url) <= count(*) OVER () // 2 AS cal FROM (SELECT DISTINCT url FROM xlong)) h
ON v.url = h.url WHERE NOT cal""")
check_view("vrank", "vtest", """
SELECT variant, truth, rank() OVER (PARTITION BY variant ORDER BY support)
  + (count(*) OVER (PARTITION BY variant, support) - 1) / 2.0 AS r FROM vtest""")


@query("e07", "Question variants compared over identical rows", "vtest vrank", """
SELECT a.variant, a.test_rows, round(b.auroc, 6) AS auroc, a.flagged, a.wrong FROM (
  SELECT variant, count(*) AS test_rows, count(*) FILTER (contradict >= 0.99) AS flagged,
    count(*) FILTER (contradict >= 0.99 AND truth) AS wrong FROM vtest GROUP BY 1) a JOIN (
  SELECT variant, (sum(r) FILTER (truth) - count(*) FILTER (truth) * (count(*) FILTER (truth) + 1)
    / 2.0) / (count(*) FILTER (truth) * count(*) FILTER (NOT truth)) AS auroc
  FROM vrank GROUP BY variant) b ON a.variant = b.variant""")
def e07(t):
    oracle, judged = variant_rows(t)
    r = stored(judged.join(oracle, ["url", "key"]).withColumnRenamed("variant", "scorer"), "rows")
    halves = CA.split_by_org(r)
    rep = CA.report(r, halves)
    accused = CA.accusations(CA.with_half(r, halves).filter(c("half") == "test"), BY, (0.99,))
    return rep.join(accused, "scorer").select(
        c("scorer").alias("variant"), "test_rows", F.round("auroc", 6).alias("auroc"), "flagged",
        "wrong")


@query("a23", "One row per page and claim; claims per page", "tclaim page", """
SELECT url, count(*) AS claims FROM (SELECT DISTINCT p.url, c.field || '|' || c.stored AS k
  FROM tclaim c JOIN page p ON c.listing_id = p.listing_id WHERE c.field <> 'status') GROUP BY url""")
def a23(t):
    claims = CL.template_claims(t.directory).filter(c("field") != "status").select(
        "listing_id", F.concat_ws("|", "field", "stored").alias("k")).distinct()
    rows_ = claims.join(t.page.select("listing_id", "url"), "listing_id")
    return rows_.dropDuplicates(["url", "k"]).groupBy("url").agg(
        F.count(F.lit(1)).alias("claims"))


@query("a12", "Usage totals", "", """
SELECT source, count(*) AS calls, CAST(sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) AS BIGINT)
    AS input_tokens, round(sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) / 1e6 * 0.042, 9) AS usd
FROM documents GROUP BY source""")
def a12(t):
    return t.documents.groupBy("source").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.ceil(c("n_chars") / 4)).alias("input_tokens")).withColumn(
        "usd", F.round(SC.usd(c("input_tokens")), 9))
