"""The ranked review queue: priorities, normalised items, replies, decisions, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry import constants as K
from attestry.functions.review import outcome_of
from attestry.functions.scoring import priority, triage_score
from attestry.functions.text import clean_text, first_filled, http_url
from attestry.session import stored as written


def triage(listing: DataFrame, as_of, budget: int | None = None,
           critical=K.CRITICAL_WORDS) -> DataFrame:
    """Listings worth reading, best first; a budget keeps the top ones."""
    words = F.concat_ws(" ", F.coalesce("name", F.lit("")),
                        F.coalesce("category_names", F.lit("")))
    scored = listing.withColumn("triage", triage_score(
        F.col("status"), F.col("website"), F.col("verified_at"), words, F.col("hours_known"),
        as_of, critical)).filter(F.col("triage") > 0)
    if budget is None:
        return scored
    return scored.orderBy(F.desc("triage"), "id").limit(budget)


def prioritise(results: DataFrame, radius: DataFrame) -> DataFrame:
    """Discrepancies with blast radius and priority. radius: org_id, size."""
    found = results.filter(F.col("verdict") == "discrepancy").withColumn(
        "org_id", F.concat(F.lit("org:"), F.col("resource_id").cast("string")))
    sized = found.join(radius.select("org_id", F.col("size").alias("blast_size")), "org_id", "left")
    return sized.withColumn("blast_size", F.coalesce("blast_size", F.lit(0).cast("bigint"))
                            ).withColumn("priority", priority(F.col("confidence"),
                                                              F.col("blast_size")))


def ranked(queue: DataFrame, limit: int | None = None) -> DataFrame:
    out = queue.orderBy(F.desc("priority"), "resource_id")
    return out if limit is None else out.limit(limit)


def split_verdicts(results: DataFrame) -> dict[str, DataFrame]:
    return {name: results.filter(F.col("verdict") == verdict) for name, verdict in (
        ("queue", "discrepancy"), ("abstained", "abstain"), ("confirmed_matches", "match"))}


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("verdict") == "discrepancy").alias("discrepancies"),
        F.count_if(F.col("verdict") == "abstain").alias("abstained"),
        F.count_if(F.col("verdict") == "match").alias("matched"))


# ---------------------------------------------------------------- review items

def normalise(raw: DataFrame, kind: Column) -> DataFrame:
    """Raw results (schemas.RAW_REVIEW) to review items; rows nobody could rule on are dropped.

    A structural finding is read off its own field and never proposes a value;
    a change to the same value is no change; a discrepancy without a proposal
    is an abstention.
    """
    def t(c) -> Column:
        return clean_text(F.col(c) if isinstance(c, str) else c)

    fields = F.coalesce(F.col("fields"), F.array().cast(raw.schema["fields"].dataType))
    marked = F.get(F.filter(fields, lambda f: F.coalesce(f["structural"], F.lit(False))), F.lit(0))
    staged = raw.withColumns({"asked": kind, "sf": marked,
                              "ff": F.coalesce(marked, F.get(fields, F.lit(0)))})
    has_sf, cr, sf, ff = F.col("sf").isNotNull(), "change_request", F.col("sf"), F.col("ff")
    field = F.when(has_sf, t(sf["field"])).otherwise(first_filled(
        t(f"{cr}.field"), t(ff["field"]),
        F.when(F.col("asked") == "abstention", "listing").otherwise("")))
    stored = F.when(has_sf, t(sf["stored"])).otherwise(
        first_filled(t(f"{cr}.current"), t(ff["stored"])))
    live = F.when(has_sf, t(sf["live"])).otherwise(first_filled(t(f"{cr}.proposed"), t(ff["live"])))
    first = staged.withColumns({"field": field, "stored": stored, "live0": live})
    said = F.when((F.col("stored") != "") & (F.col("live0") == F.col("stored")), "").otherwise(
        F.col("live0"))
    structural = (has_sf | F.coalesce("structural", F.lit(False))
                  | F.coalesce(F.col(f"{cr}.structural"), F.lit(False))
                  | (F.col("field") == "phone_format"))
    second = first.withColumn("said", said).withColumn("is_structural", structural).withColumn(
        "kind", F.when(F.col("is_structural"), "structural")
        .when((F.col("asked") == "discrepancy") & (F.col("said") == ""), "abstention")
        .otherwise(F.col("asked")))
    org = first_filled(http_url(F.col("org_website")), http_url(F.col(f"{cr}.org_website")))
    page = first_filled(http_url(F.col("listing_url")), http_url(F.col(f"{cr}.listing_url")))
    edit = first_filled(http_url(F.col("listing_edit_url")), http_url(F.col(f"{cr}.listing_edit_url")))
    somewhere = first_filled(org, http_url(F.col("listing_url")), F.col("stored"))
    usable = (
        (t("resource_id") != "") & (F.col("field") != "")
        & ~((F.col("kind") == "structural") & (F.col("stored") == ""))
        & ~((F.col("kind") == "abstention") & (somewhere == ""))
    )
    source = F.when(has_sf, http_url(sf["evidence_url"])).otherwise(
        first_filled(http_url(F.col(f"{cr}.source_url")), http_url(ff["evidence_url"])))
    quote = F.when(has_sf, "").otherwise(
        first_filled(t(f"{cr}.source_quote"), t(ff["evidence_quote"])))
    items = second.filter(usable).select(
        t("resource_id").alias("resource_id"), "kind",
        clean_text(F.col("name"), "Unknown organisation").alias("name"), "field", "stored",
        F.when(F.col("is_structural"), "").otherwise(F.col("said")).alias("live"),
        F.when(F.col("is_structural"), F.col("said")).otherwise("").alias("defect"),
        source.alias("source_url"), quote.alias("source_quote"), page.alias("listing_url"),
        edit.alias("listing_edit_url"), org.alias("org_website"),
        first_filled(t("verdict"), F.col("kind")).alias("verdict"),
        t("reason").alias("reason"), "confidence",
        F.coalesce("blast_size", F.size(F.coalesce(
            "blast_services", F.array().cast("array<string>"))).cast("bigint"))
        .alias("blast_size"),
        F.coalesce("priority", F.lit(0.0)).alias("priority"),
        first_filled(t(f"{cr}.submitted_by"), F.lit("attestry (human review required)"))
        .alias("submitted_by"))
    return items.withColumn("proposes", F.col("kind") == "discrepancy")


def load_queue(queue: DataFrame, abstained: DataFrame, decisions: DataFrame):
    """(open items ranked, counts): both lists normalised, minus what was already decided."""
    a = normalise(queue, F.lit("discrepancy"))
    b = normalise(abstained, F.lit("abstention"))
    items = a.unionByName(b)
    decided = decisions.select("resource_id").distinct()
    remaining = items.join(decided, "resource_id", "left_anti")
    done = items.join(decided, "resource_id", "left_semi")
    total = queue.select(F.lit(1).alias("x")).unionByName(abstained.select(F.lit(1).alias("x")))
    counts = (total.agg(F.count(F.lit(1)).alias("read"))
              .join(items.agg(F.count(F.lit(1)).alias("usable")))
              .join(done.agg(F.count(F.lit(1)).alias("already_decided")))
              .withColumn("dropped", F.col("read") - F.col("usable")))
    return ranked(remaining), counts


def breakdown(items: DataFrame, decided: DataFrame) -> DataFrame:
    """Reviewable items by kind, how many remain and how many were answered before."""
    flagged = items.join(decided.select("resource_id").distinct().withColumn(
        "done", F.lit(True)), "resource_id", "left")
    left = F.col("done").isNull()
    return flagged.agg(
        F.count_if(left).alias("remaining"),
        F.count_if(left & (F.col("kind") == "discrepancy")).alias("discrepancies"),
        F.count_if(left & (F.col("kind") == "structural")).alias("structural"),
        F.count_if(left & (F.col("kind") == "abstention")).alias("abstentions"),
        F.count_if(~left).alias("already_answered"))


def latest_decisions(log: DataFrame) -> DataFrame:
    """Latest decision per resource over the four logs in replay order; skips never count."""
    rank = F.when(F.col("action") == "confirm", 0).when(F.col("action") == "reject", 1).when(
        F.col("action") == "looks_right", 2).when(F.col("action") == "needs_fixing", 3)
    return (log.filter(rank.isNotNull()).groupBy("resource_id").agg(F.max_by(
        F.struct("action", "decided_at"), F.struct(rank.alias("f"), "row_no")).alias("d"))
        .select("resource_id", "d.action", "d.decided_at"))


def decision_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def session_counts(log: DataFrame) -> DataFrame:
    """What each reviewer did: answers by outcome, plus skips."""
    def n(action):
        return F.count_if(F.col("action") == action)

    return log.groupBy("decided_by").agg(
        n("confirm").alias("confirmed"), n("reject").alias("rejected"),
        n("looks_right").alias("verified"), n("needs_fixing").alias("flagged"),
        n("skip").alias("skipped"),
        F.count_if(F.col("action") != "skip").alias("answered"))


def positions(items: DataFrame) -> DataFrame:
    """`items` with their position by falling priority, then resource_id, from 1.

    Rows are dealt out by sampled ranges of both, so a priority or an id prefix that most of
    the queue shares is split like any other. Only the ranges' row counts come together.
    """
    order = [F.desc("priority"), F.asc("resource_id")]
    dealt = written(items.repartitionByRange(*order).withColumn(
        "_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
                                      ).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # One row per range, of which there are as many as shuffle partitions at most.
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").select(
        *items.columns, (F.col("_before") + F.col("_inside")).alias("position"))


def open_positions(items: DataFrame, settled: DataFrame, skipped: DataFrame) -> DataFrame:
    """(resource_id, position, is_next): the queue order and the next open review."""
    placed = positions(items.select("resource_id", "priority")).select("resource_id", "position")
    busy = settled.select("resource_id").unionByName(skipped.select("resource_id")).distinct()
    free = placed.join(busy, "resource_id", "left_anti")
    nxt = free.agg(F.min("position").alias("next_position"))
    return placed.join(F.broadcast(nxt)).select(
        "resource_id", "position",
        F.coalesce(F.col("position") == F.col("next_position"), F.lit(False)).alias("is_next"))


def outcome_records(decisions: DataFrame) -> DataFrame:
    """Settled decisions with the log each belongs to; skips are never recorded."""
    return decisions.withColumn("outcome", outcome_of(F.col("action"))).filter(
        F.col("outcome").isNotNull())
