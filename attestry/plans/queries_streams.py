"""Streams over the event table, run to the end and read back from their sinks."""

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.plans.catalog import query
from attestry.streaming import streams as ST

c = F.col
GAP = "12 hours"


def event_stream(t):
    """The event table as a file stream."""
    return ST.timed(ST.read_stream(t.spark, t.events.schema, f"{t.sf_dir}/events*.parquet"), "ts")


def _number():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def decision_stream(t):
    """Decisions as the reviewers' replies arrive; a view is a skip."""
    action = (F.when(c("event_type") == "purchase", "confirm")
              .when(c("event_type") == "error", "reject")
              .when(c("event_type") == "signup", "looks_right")
              .when(c("event_type") == "click", "needs_fixing").otherwise("skip"))
    return event_stream(t).select(
        (_number() * 1000 + c("user_id")).cast("string").alias("resource_id"),
        action.alias("action"), F.concat(F.lit("reviewer"), "user_id").alias("decided_by"),
        c("ts").alias("decided_at"), c("event_id").alias("row_no"))


_OUTCOMES = " ".join(f"WHEN '{a}' THEN '{o}'" for a, o in K.OUTCOME_OF_ACTION.items())


@query("st1", "Decision stream to an idempotent outcome log, one row per resource", "decision", f"""
SELECT resource_id, action, CASE action {_OUTCOMES} END AS outcome FROM (
  SELECT resource_id, arg_min(action, (decided_at, row_no)) AS action FROM decision
  WHERE action <> 'skip' GROUP BY resource_id)""")
def st1(t):
    path = ST.run_to_end(lambda out, chk: ST.write_decisions(
        ST.decision_log(decision_stream(t)), out, chk, order=("decided_at", "row_no")),
        t.spark, "decisions")
    return t.spark.read.parquet(path).select("resource_id", "action", "outcome")


@query("st2", "Live latest decision per resource", "decision", """
SELECT resource_id, arg_max(action, (decided_at, row_no)) AS action FROM decision
WHERE action <> 'skip' GROUP BY resource_id""")
def st2(t):
    path = ST.run_to_end(lambda out, chk: ST.write_updates(
        ST.latest_by_resource(decision_stream(t)), out, chk, ["resource_id"]), t.spark, "latest")
    return ST.current_rows(t.spark, path, ["resource_id"]).select("resource_id", "action")


@query("st2_remaining", "Queue items that the decision stream has left open", "decision", """
SELECT DISTINCT resource_id FROM decision d WHERE NOT EXISTS (SELECT 1 FROM decision e
  WHERE e.resource_id = d.resource_id AND e.action <> 'skip')""")
def st2_remaining(t):
    path = ST.run_to_end(lambda out, chk: ST.write_updates(
        ST.latest_by_resource(decision_stream(t)), out, chk, ["resource_id"]), t.spark, "latest")
    # Whatever a reviewer was shown is in the queue, also what they skipped.
    queue = t.decision.select("resource_id").distinct()
    return ST.remaining_queue(queue, ST.current_rows(t.spark, path, ["resource_id"]))


@query("st3", "Confirmations reset the freshness clock", "event_field", """
SELECT e.listing_id, e.field, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS confirmed_at
FROM event_field e JOIN customer ON c_custkey = e.listing_id WHERE event_type IN
  ('purchase', 'click') GROUP BY 1, 2""")
def st3(t):
    names = {0: "phone", 1: "address", 2: "schedule", 3: "status", 4: "website", 5: "services"}
    from attestry.functions.scoring import choose

    confirmations = event_stream(t).filter(c("event_type").isin("purchase", "click")).select(
        c("user_id").alias("listing_id"),
        choose(_number() % 7, names, "email").alias("field"), c("ts").alias("confirmed_at"))
    listing = t.customer.select(c("c_custkey").alias("listing_id"))
    path = ST.run_to_end(lambda out, chk: ST.write_updates(
        ST.confirmation_clock(confirmations, listing), out, chk, ["listing_id", "field"]),
        t.spark, "clock")
    return ST.current_rows(t.spark, path, ["listing_id", "field"]).select(
        "listing_id", "field", F.date_format("confirmed_at", "yyyy-MM-dd HH:mm:ss")
        .alias("confirmed_at"))


@query("st4", "Daily update bursts, closed days only", "", """
SELECT strftime(d, '%Y-%m-%d') AS day, n AS updates FROM (
  SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1)
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def st4(t):
    path = ST.run_to_end(lambda out, chk: ST.write_append(
        ST.update_bursts(event_stream(t)), out, chk), t.spark, "bursts")
    return t.spark.read.parquet(path).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "updates")


@query("st5", "Reviewer sessions with answers and skips", "decision", """
SELECT decided_by, strftime(min(decided_at), '%Y-%m-%d %H:%M:%S') AS started,
  count(*) FILTER (action <> 'skip') AS answered, count(*) FILTER (action = 'skip') AS skipped
FROM (SELECT *, sum(fresh) OVER (PARTITION BY decided_by ORDER BY decided_at, row_no) AS s FROM (
  SELECT *, CASE WHEN decided_at - lag(decided_at) OVER (PARTITION BY decided_by
    ORDER BY decided_at, row_no) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM decision))
GROUP BY decided_by, s
HAVING max(decided_at) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def st5(t):
    path = ST.run_to_end(lambda out, chk: ST.write_append(
        ST.reviewer_sessions(decision_stream(t), GAP), out, chk), t.spark, "sessions")
    return t.spark.read.parquet(path).select(
        "decided_by", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"),
        "answered", "skipped")


@query("a24", "Updates by day and month", "", """
SELECT 'day' AS unit, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS updates
FROM events GROUP BY 2
UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m-%d'), count(*) FROM events
GROUP BY 2""")
def a24(t):
    parts = [ST.daily_updates(t.events, "ts", u).select(
        F.lit(u).alias("unit"), F.date_format(u, "yyyy-MM-dd").alias("start"), "updates")
        for u in ("day", "month")]
    return parts[0].unionByName(parts[1])


