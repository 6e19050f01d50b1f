"""Review items, replies, decisions and outcome logs."""

from pyspark.sql import functions as F

from attestry import constants as K
from attestry import schemas as S
from attestry.functions import review as V
from attestry.functions.scoring import choose
from attestry.operators import review_queue as R
from attestry.plans.catalog import check_view, query
from attestry.session import scratch_path, stored
from attestry.sources import stores

c = F.col


# ---------------------------------------------------------------- replies

# One spelling per remainder of the event's number, with the reading it must get.
REPLIES = (
    ("yes", "action", "confirm"), (" Y. ", "action", "confirm"), ("yep thanks", "action", "confirm"),
    ("n", "action", "reject"), ("Nope!", "action", "reject"), ("nah", "action", "reject"),
    ("skip", "action", "skip"), ("s", "action", "skip"), ("right", "action", "looks_right"),
    ("fix.", "action", "needs_fixing"), ("/queue", "queue", None), ("left", "queue", None),
    ("?", "evidence", None), ("?why", "evidence", None), ("help", "help", None),
    ("/stop now", "stop", None), ("looks_right", "action", "looks_right"),
    ("reject", "action", "reject"), ("   ", "unknown", None), ("yesterday", "unknown", None),
)
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"


def _number():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def _reply():
    n = len(REPLIES)
    return choose(F.pmod(_number(), F.lit(n)), {i: r for i, (r, _, _) in enumerate(REPLIES)})


def _expected(i):
    def lit(v):
        return "NULL" if v is None else f"'{v}'"

    return " ".join(f"WHEN {j} THEN {lit(r[i])}" for j, r in enumerate(REPLIES))


@query("p41", "Replies read as commands", "", f"""
SELECT event_id, CASE {_K} % {len(REPLIES)} {_expected(1)} END AS kind,
  CASE {_K} % {len(REPLIES)} {_expected(2)} END AS action FROM events""")
def p41(t):
    return t.events.select("event_id", V.parse_reply(_reply()).alias("r")).select(
        "event_id", "r.kind", "r.action")


_REQUESTED = """CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'reject'
  WHEN 'signup' THEN 'looks_right' WHEN 'click' THEN 'needs_fixing' ELSE 'skip' END"""


@query("p42", "Action legality and the structural yes/no reading", "", f"""
SELECT event_id, CASE kind
  WHEN 0 THEN CASE WHEN a IN ('confirm', 'reject', 'skip') THEN a END
  WHEN 1 THEN CASE WHEN a IN ('looks_right', 'needs_fixing', 'skip') THEN a END
  ELSE CASE a WHEN 'confirm' THEN 'needs_fixing' WHEN 'reject' THEN 'looks_right' ELSE a END END
  AS recorded FROM (SELECT event_id, {_K} % 3 AS kind, {_REQUESTED} AS a FROM events)""")
def p42(t):
    kind = choose(F.pmod(_number(), F.lit(3)), {0: "discrepancy", 1: "abstention",
                                                2: "structural"})
    asked = choose(c("event_type"), {"purchase": "confirm", "error": "reject",
                                     "signup": "looks_right", "click": "needs_fixing"}, "skip")
    return t.events.select("event_id", V.settle_action(kind, asked).alias("recorded"))


# ---------------------------------------------------------------- items

def raw_reviews(t):
    """Raw queue entries in every shape the queue must survive, one per order."""
    p, st = c("o_orderpriority"), c("o_orderstatus")
    who = c("o_custkey").cast("string")

    def text(v):
        return v if not isinstance(v, str) else F.lit(v)

    def finding(field, stored_, live, structural):
        return F.struct(
            F.lit(field).alias("field"), text(stored_).alias("stored"), text(live).alias("live"),
            F.concat(F.lit("https://e.example/"), who).alias("evidence_url"),
            F.lit("seen\u0007 here").alias("evidence_quote"), F.lit(False).alias("match"),
            F.lit(structural).alias("structural"), c("o_orderkey").alias("phone_id"),
            F.lit(None).cast("string").alias("proposed"))

    weak = finding("phone_missing", F.concat(F.lit(" stored  "), who),
                   F.when(p == "2-HIGH", F.concat(F.lit("stored "), who)).otherwise(
                       F.concat(F.lit("live\n"), who)), False)
    hard = finding("phone_format", F.when(st == "P", "").otherwise(F.concat(who, F.lit("99"))),
                   K.LIVE_UNDIALABLE, True)
    fields = F.filter(F.array(F.when(st != "O", weak), F.when(p == "5-LOW", hard)),
                      lambda f: f.isNotNull())
    none = F.lit(None).cast("string")
    request = F.when(st == "F", F.struct(
        F.lit("phone").alias("field"), F.lit("cur").alias("current"),
        F.when(p == "1-URGENT", "new").otherwise("").alias("proposed"),
        F.lit("javascript:x").alias("source_url"), none.alias("source_quote"),
        none.alias("listing_url"), none.alias("listing_edit_url"), none.alias("org_website"),
        F.lit("someone").alias("submitted_by"), F.lit(False).alias("structural")))
    raw = t.orders.select(
        F.when((p == "3-MEDIUM") & (st == "O"), " ").otherwise(
            c("o_orderkey").cast("string")).alias("resource_id"),
        F.when(st == "P", none).otherwise(F.concat(F.lit("Org "), who)).alias("name"),
        none.alias("verdict"), F.lit("why").alias("reason"),
        (c("o_totalprice") / 1_000_000).alias("confidence"),
        F.array(F.lit("a"), F.lit(" ")).alias("fetched"),
        F.when(p == "3-MEDIUM", "ftp://x").otherwise("https://o.example").alias("org_website"),
        F.when(p == "1-URGENT", "https://l.example").alias("listing_url"),
        none.alias("listing_edit_url"), F.lit(False).alias("structural"),
        F.round(c("o_totalprice") / 100_000, 3).alias("priority"),
        F.lit(None).cast("bigint").alias("blast_size"),
        F.array(F.lit("one"), F.lit("two")).alias("blast_services"),
        fields.cast(f"array<{S.FINDING}>").alias("fields"),
        request.cast(S.CHANGE_REQUEST).alias("change_request"),
        F.when(c("o_totalprice") > 200_000, "discrepancy").otherwise("abstention").alias("asked"))
    return raw


check_view("item", "", """
SELECT * FROM (SELECT rid AS resource_id, nm AS name, field, stored, org, priority, asked,
  CASE WHEN sf THEN 'structural' WHEN asked = 'discrepancy' AND said = '' THEN 'abstention'
    ELSE asked END AS kind,
  CASE WHEN sf THEN '' ELSE said END AS live, CASE WHEN sf THEN said ELSE '' END AS defect,
  source_url, quote, rid <> '' AND field <> '' AND NOT (sf AND stored = '')
    AND NOT (NOT sf AND (asked = 'abstention' OR said = '') AND org = '' AND lst = ''
      AND stored = '') AS usable
FROM (SELECT *, CASE WHEN stored <> '' AND live0 = stored THEN '' ELSE live0 END AS said FROM (
SELECT CASE WHEN p = '3-MEDIUM' AND st = 'O' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS rid,
  CASE WHEN st = 'P' THEN 'Unknown organisation' ELSE 'Org ' || o_custkey END AS nm,
  p = '5-LOW' AS sf, CASE WHEN o_totalprice > 200000 THEN 'discrepancy' ELSE 'abstention' END
    AS asked,
  CASE WHEN p = '5-LOW' THEN 'phone_format' WHEN st = 'F' THEN 'phone' WHEN st = 'P'
    THEN 'phone_missing' WHEN o_totalprice <= 200000 THEN 'listing' ELSE '' END AS field,
  CASE WHEN p = '5-LOW' THEN CASE WHEN st = 'P' THEN '' ELSE o_custkey || '99' END
    WHEN st = 'F' THEN 'cur' WHEN st = 'P' THEN 'stored ' || o_custkey ELSE '' END AS stored,
  CASE WHEN p = '5-LOW' THEN 'not dialable as stored' WHEN st = 'F' AND p = '1-URGENT' THEN 'new'
    WHEN st IN ('F', 'P') THEN CASE WHEN p = '2-HIGH' THEN 'stored ' ELSE 'live ' END || o_custkey
    ELSE '' END AS live0,
  CASE WHEN p = '3-MEDIUM' THEN '' ELSE 'https://o.example' END AS org,
  CASE WHEN p = '1-URGENT' THEN 'https://l.example' ELSE '' END AS lst,
  CASE WHEN p = '5-LOW' OR st IN ('F', 'P') THEN 'https://e.example/' || o_custkey ELSE '' END
    AS source_url,
  CASE WHEN p <> '5-LOW' AND st IN ('F', 'P') THEN 'seen here' ELSE '' END AS quote,
  round(o_totalprice / 100000, 3) AS priority
FROM (SELECT *, o_orderpriority AS p, o_orderstatus AS st FROM orders)))) WHERE usable""")


def items(t):
    return R.normalise(raw_reviews(t), c("asked"))


@query("p40", "Review items normalised", "item", """
SELECT resource_id, kind, name, field, stored, live, defect, source_url, quote AS source_quote,
  org AS org_website, priority FROM item""")
def p40(t):
    return items(t).select("resource_id", "kind", "name", "field", "stored", "live", "defect",
                           "source_url", "source_quote", "org_website", "priority")


check_view("latest", "decision", """
SELECT resource_id, arg_max(action, (CASE action WHEN 'confirm' THEN 0 WHEN 'reject' THEN 1
  WHEN 'looks_right' THEN 2 ELSE 3 END, row_no)) AS action
FROM decision WHERE action <> 'skip' GROUP BY resource_id""")


@query("s18", "Outcome replay: latest decision per resource", "latest",
       "SELECT resource_id, action FROM latest")
def s18(t):
    return R.latest_decisions(t.decision).select("resource_id", "action")


@query("j10", "Queue minus decided", "item latest", """
SELECT resource_id, kind FROM item WHERE resource_id NOT IN (SELECT resource_id FROM latest)""")
def j10(t):
    done = R.latest_decisions(t.decision).select("resource_id")
    return items(t).join(done, "resource_id", "left_anti").select("resource_id", "kind")


@query("s19", "Review queue loaded: united, cleaned, undecided, ranked", "item latest", """
SELECT resource_id, kind, priority,
  row_number() OVER (ORDER BY priority DESC, resource_id) AS position,
  (SELECT count(*) FROM orders) AS read,
  (SELECT count(*) FROM orders) - (SELECT count(*) FROM item) AS dropped,
  (SELECT count(*) FROM item WHERE resource_id IN (SELECT resource_id FROM latest)) AS already
FROM item WHERE resource_id NOT IN (SELECT resource_id FROM latest)""")
def s19(t):
    raw = stored(raw_reviews(t), "raw-reviews")
    queue = raw.filter(c("asked") == "discrepancy").drop("asked")
    abstained = raw.filter(c("asked") == "abstention").drop("asked")
    open_items, counts = R.load_queue(queue, abstained, R.latest_decisions(t.decision))
    return R.positions(open_items.select("resource_id", "kind", "priority")).join(F.broadcast(
        counts.select("read", "dropped", c("already_decided").alias("already"))))


@query("a19", "Queue breakdown", "item latest", """
SELECT count(*) FILTER (NOT d) AS remaining,
  count(*) FILTER (NOT d AND kind = 'discrepancy') AS discrepancies,
  count(*) FILTER (NOT d AND kind = 'structural') AS structural,
  count(*) FILTER (NOT d AND kind = 'abstention') AS abstentions,
  count(*) FILTER (d) AS already_answered
FROM (SELECT *, resource_id IN (SELECT resource_id FROM latest) AS d FROM item)""")
def a19(t):
    return R.breakdown(items(t), R.latest_decisions(t.decision))


@query("a20", "Recorded decisions by action", "latest",
       "SELECT action, count(*) AS n FROM latest GROUP BY action")
def a20(t):
    return R.decision_counts(R.latest_decisions(t.decision))


@query("a21", "What each reviewer did", "decision", """
SELECT decided_by, count(*) FILTER (action = 'confirm') AS confirmed,
  count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'looks_right')
    AS verified, count(*) FILTER (action = 'needs_fixing') AS flagged,
  count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action <> 'skip') AS answered
FROM decision GROUP BY decided_by""")
def a21(t):
    return R.session_counts(t.decision)


@query("w17", "Positions in the queue and the next open review", "item decision", """
SELECT resource_id, position, position = min(position) FILTER (open) OVER () AS is_next FROM (
  SELECT resource_id, row_number() OVER (ORDER BY priority DESC, resource_id) AS position,
    resource_id NOT IN (SELECT resource_id FROM decision) AS open FROM item)""")
def w17(t):
    done = t.decision.filter(c("action") != "skip").select("resource_id")
    skipped = t.decision.filter(c("action") == "skip").select("resource_id")
    return R.open_positions(stored(items(t), "items"), done, skipped)


# ---------------------------------------------------------------- outcome logs

def _records(t):
    recorded = R.outcome_records(t.decision)
    return recorded.select(
        "resource_id", "action", V.decision_of(c("action")).alias("decision"), "decided_by",
        F.lit("web").alias("decided_via"), c("decided_at").cast("timestamp").alias("decided_at"),
        F.lit(False).alias("submitted"), "outcome", "row_no")


@query("s16", "Outcome logs: one per action, appended", "decision", """
SELECT CASE action WHEN 'confirm' THEN 'approved' WHEN 'reject' THEN 'rejected'
  WHEN 'looks_right' THEN 'verified' ELSE 'flagged' END AS outcome,
  CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected'
  WHEN 'looks_right' THEN 'verified_by_human' ELSE 'needs_manual_fix' END AS decision,
  count(*) AS n FROM decision WHERE action <> 'skip' GROUP BY ALL""")
def s16(t):
    path = scratch_path(t.spark, "outcomes")
    records = _records(t)
    for half in (c("row_no") < 5000, c("row_no") >= 5000):
        stores.append_outcomes(records.filter(half), path)
    good, _ = stores.read_outcomes(t.spark, path)
    return good.groupBy("outcome", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("s17", "Damaged log lines quarantined, the rest kept", "decision", """
SELECT CASE WHEN action = 'skip' THEN 'quarantined' ELSE 'kept' END AS part, count(*) AS n
FROM decision GROUP BY 1""")
def s17(t):
    path = scratch_path(t.spark, "damaged")
    line = F.when(c("action") == "skip", F.concat(F.lit('{"resource_id": "'), "resource_id")
                  ).otherwise(F.to_json(F.struct("resource_id", "action", "row_no")))
    t.decision.select(line.alias("value"), F.coalesce(V.outcome_of(c("action")), F.lit("flagged"))
                      .alias("outcome")).write.partitionBy("outcome").text(path)
    good, bad = stores.read_outcomes(t.spark, path)
    one = F.count(F.lit(1)).alias("n")
    return good.agg(one).select(F.lit("kept").alias("part"), "n").unionByName(
        bad.agg(one).select(F.lit("quarantined").alias("part"), "n"))
