"""Defects provable from a stored value alone: no page, no scorer, the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions.contact import phone_issue


def _summary(issue: Column) -> Column:
    return F.concat(issue["raw"], F.lit(" ("), issue["label"], F.lit("): "), issue["why"])


def phone_issues(phone: DataFrame) -> DataFrame:
    """One row per undialable stored number."""
    issue = phone_issue(F.col("phone_id"), F.col("number"), F.col("service_type"),
                        F.col("country_code"))
    return (
        phone.select("listing_id", "pos", issue.alias("i"))
        .filter(F.col("i").isNotNull())
        .select("listing_id", "pos", F.col("i.phone_id").alias("phone_id"), "i.raw", "i.label",
                "i.kind", "i.why", "i.proposed", _summary(F.col("i")).alias("summary"))
    )


def structural_findings(phone: DataFrame) -> DataFrame:
    """One finding per listing: the first issue, how many there are, the first recovered value.

    The issues themselves stay long in phone_issues(), so no listing is gathered
    into one row here.
    """
    issues = phone_issues(phone)
    more = F.count(F.lit(1)) - 1
    first = F.min_by("summary", "pos")
    return issues.groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.min_by("phone_id", "pos").alias("phone_id"),
        F.when(more > 0, F.concat(first, F.lit("; +"), more.cast("string"), F.lit(" more")))
        .otherwise(first).alias("stored"),
        F.min_by("proposed", F.when(F.col("proposed").isNotNull(), F.col("pos")))
        .alias("proposed"),
    ).select("listing_id", "n_issues", "phone_id", "stored", "proposed",
             F.lit(K.LIVE_UNDIALABLE).alias("live"))


def document_finding(phones: Column) -> Column:
    """The same finding inside one landed document, every issue spelled out; no shuffle."""
    issues = F.filter(
        F.transform(F.coalesce(phones, F.array()), lambda p: phone_issue(
            p["id"], p["number"], p["service_type"], p["country_code"])),
        lambda i: i.isNotNull())
    proposed = F.filter(F.transform(issues, lambda i: i["proposed"]), lambda p: p.isNotNull())
    return F.when(F.size(issues) > 0, F.struct(
        F.size(issues).alias("n_issues"),
        issues[0]["phone_id"].alias("phone_id"),
        F.array_join(F.transform(issues, _summary), "; ").alias("stored"),
        F.get(proposed, F.lit(0)).alias("proposed"),
        issues.alias("issues")))


def closes_before_opening(schedule_day: DataFrame) -> DataFrame:
    """Schedule rows whose closing time is earlier than the opening time."""
    return schedule_day.filter(
        F.col("closes_at").try_cast("int") < F.col("opens_at").try_cast("int"))
