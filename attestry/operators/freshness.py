"""How believable each field still is: evidence ceiling times age decay, rolled up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry import constants as K
from attestry.functions.scoring import age_days, band, field_score, half_life
from attestry.functions.text import blank_to_null, present
from attestry.operators.directory import Directory

FIELDS = tuple(K.WEIGHT)
WEIGHT_POS = {f: i for i, f in enumerate(FIELDS)}


def field_presence(d: Directory) -> DataFrame:
    """One row per listing with a flag per field; every child table is pre-aggregated."""
    def has(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        kept = df if condition is None else df.filter(condition)
        return kept.select("listing_id").distinct().select(
            F.col("listing_id").alias("id"), F.lit(True).alias(name))

    parts = [
        has(d.phone, "has_phone", present(F.col("number"))),
        has(d.address, "has_address"),
        has(d.schedule_day, "has_schedule"),
        has(d.service, "has_services"),
    ]
    base = d.listing.select(
        "*",
        (F.coalesce("status", F.lit("")) != "").alias("has_status"),
        present(F.col("website")).alias("has_website"),
        present(F.col("email")).alias("has_email"))
    joined = reduce(lambda a, b: a.join(b, "id", "left"), parts, base)
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.lit(False))
        for c in ("has_phone", "has_address", "has_schedule", "has_services")})


def confirmation_columns(confirmations: DataFrame) -> DataFrame:
    """(listing_id, field, confirmed_at) to one row per listing with the latest per field."""
    return confirmations.groupBy(F.col("listing_id").alias("id")).agg(*[
        F.max(F.when(F.col("field") == f, F.col("confirmed_at"))).alias(f"conf_{f}")
        for f in FIELDS])


def best_evidence(human: Column, confirmed: Column, has_value: Column, updated: Column,
                  as_of) -> Column:
    """struct(evidence, age): a person, then the source, then well-formedness, then nothing."""
    return evidence_of_ages(age_days(human, as_of), age_days(confirmed, as_of), has_value,
                            age_days(updated, as_of))


def evidence_of_ages(ha: Column, ca: Column, has_value: Column, ua: Column) -> Column:
    """best_evidence() from the ages of its dates."""
    return (
        F.when(ha.isNotNull(), F.struct(F.lit("human_verified").alias("evidence"),
                                        ha.alias("age")))
        .when(ca.isNotNull(), F.struct(F.lit("source_agreement").alias("evidence"),
                                       ca.alias("age")))
        .when(has_value, F.struct(F.lit("structural_ok").alias("evidence"),
                                  ua.alias("age")))
        .otherwise(F.struct(F.lit("none").alias("evidence"),
                            F.lit(None).cast("int").alias("age")))
    )


def human_date(verified: Column, certified: Column, use_newest: bool = False) -> Column:
    """The human date; by default a stored verified_at hides a newer certified_at."""
    v, c = blank_to_null(verified), blank_to_null(certified)
    return F.greatest(v, c) if use_newest else F.coalesce(v, c)


def field_scores(d: Directory, as_of, confirmations: DataFrame | None = None,
                 use_newest: bool = False) -> DataFrame:
    """One row per listing with a struct per field; the rest of the scoring is narrow."""
    rows = field_presence(d)
    if confirmations is not None:
        rows = rows.join(confirmation_columns(confirmations), "id", "left")
    # Two of the three dates are the listing's: their ages are worked out once for all fields.
    rows = rows.withColumns({
        "human_age": age_days(human_date(F.col("verified_at"), F.col("certified_at"), use_newest),
                              as_of),
        "updated_age": age_days(F.col("updated_at"), as_of)})

    def one(field: str) -> Column:
        conf = (age_days(F.col(f"conf_{field}"), as_of) if confirmations is not None
                else F.lit(None).cast("int"))
        return evidence_of_ages(F.col("human_age"), conf, F.col(f"has_{field}"),
                                F.col("updated_age"))

    found = rows.select("id", "name", *[one(f).alias(f) for f in FIELDS])
    # Exploding one struct keeps the scores columns: a filter on what follows from them is not
    # pushed below with every score and age written out in it again and again.
    return found.select("id", "name", F.explode(F.array(F.struct(*[
        F.struct(F.lit(f).alias("field"), F.col(f)["evidence"].alias("evidence"),
                 F.col(f)["age"].alias("age_days"),
                 field_score(F.lit(f), F.col(f)["evidence"], F.col(f)["age"]).alias("score"),
                 half_life(F.lit(f)).alias("half_life")).alias(f)
        for f in FIELDS]))).alias("s")).select("id", "name", "s.*")


def long_scores(scored: DataFrame) -> DataFrame:
    """(listing_id, field, evidence, age_days, score, half_life)."""
    return scored.select(F.col("id").alias("listing_id"),
                         F.explode(F.array(*FIELDS)).alias("f")).select("listing_id", "f.*")


def rollup(scored: DataFrame) -> DataFrame:
    """Weighted listing freshness, band, coverage and next action; absent fields do not count."""
    def weighted(value) -> Column:
        return reduce(lambda a, f: a + F.when(
            F.col(f)["evidence"] != "none", value(f)).otherwise(F.lit(0.0)), FIELDS, F.lit(0.0))

    total = weighted(lambda f: F.col(f)["score"] * K.WEIGHT[f])
    weight = weighted(lambda f: F.lit(K.WEIGHT[f]))
    exact = F.when(weight > 0, total / weight).otherwise(F.lit(0.0))
    out = scored.select("id", "name", exact.alias("exact"), F.bround(exact, 1).alias("freshness"),
                        F.bround(weight, 2).alias("coverage"),
                        next_action().alias("next"), *FIELDS)
    return out.withColumn("band", band(F.col("freshness")))


def next_action() -> Column:
    """The field whose confirmation raises the listing most; ties keep weight order."""
    ceiling = float(K.EVIDENCE_CEILING["source_agreement"])
    gains = F.array(*[
        F.struct(((F.lit(ceiling) - F.col(f)["score"]) * K.WEIGHT[f]).alias("gain"),
                 F.lit(-WEIGHT_POS[f]).alias("rank"), F.lit(f).alias("field"),
                 (F.col(f)["evidence"] != "none").alias("stated"))
        for f in FIELDS])
    best = F.array_max(F.filter(gains, lambda g: g["stated"] & (g["gain"] > 0)))
    return F.when(best.isNotNull(), F.struct(
        best["field"].alias("field"), F.bround(best["gain"], 1).alias("score_gain")))


def long_rollup(fields: DataFrame) -> DataFrame:
    """Roll up (listing_id, field, evidence, score) rows, one per listing and field.

    One column per field keeps the sums partial and adds them in weight order.
    """
    stated = F.col("evidence") != "none"
    wide = fields.groupBy("listing_id").agg(*[
        F.sum(F.when(stated & (F.col("field") == f), F.col("score"))).alias(f) for f in FIELDS])

    def weighted(value) -> Column:
        return reduce(lambda a, f: a + F.when(F.col(f).isNotNull(), value(f)).otherwise(
            F.lit(0.0)), FIELDS, F.lit(0.0))

    raw = weighted(lambda f: F.col(f) * K.WEIGHT[f])
    weight = weighted(lambda f: F.lit(K.WEIGHT[f]))
    exact = F.when(weight > 0, raw / weight).otherwise(F.lit(0.0))
    return wide.select("listing_id", exact.alias("exact"), F.bround(weight, 2).alias("coverage")
                       ).withColumn("freshness", F.bround("exact", 1)).withColumn(
        "band", band(F.col("freshness")))


def report(listing_scores: DataFrame) -> DataFrame:
    """Count, upper median, mean and share per band.

    Freshness carries one decimal, so there are at most 1,001 distinct values;
    the exact median comes from that histogram instead of a global sort.
    """
    hist = listing_scores.groupBy("freshness").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("freshness"))
    total = F.sum("n").over(Window.partitionBy())
    median = (hist.select("freshness", upto.alias("upto"), total.alias("total"))
              .filter(F.col("upto") >= F.floor(F.col("total") / 2) + 1)
              .agg(F.min("freshness").alias("median_freshness")))
    names = [b for b, _ in K.BANDS] + [K.LAST_BAND]
    summary = listing_scores.agg(
        F.count(F.lit(1)).alias("listings"),
        F.bround(F.avg("freshness"), 1).alias("mean_freshness"),
        *[F.count_if(F.col("band") == b).alias(f"n_{b}") for b in names],
        *[F.bround(100 * F.count_if(F.col("band") == b) / F.greatest(
            F.count(F.lit(1)), F.lit(1)), 1).alias(f"pct_{b}") for b in names])
    return summary.join(F.broadcast(median))


def worst(listing_scores: DataFrame, limit: int = K.WORST_LIMIT) -> DataFrame:
    return listing_scores.orderBy("freshness", "id").limit(limit)


def match_confirmations(matches: DataFrame, when: Column) -> DataFrame:
    """Confirmed matches to (listing_id, field, confirmed_at); no field list confirms three."""
    default = F.array(*[F.lit(f) for f in K.WHOLE_LISTING_MATCH_FIELDS])
    fields = F.when(F.coalesce(F.size("fields"), F.lit(0)) > 0, F.col("fields")).otherwise(default)
    return matches.select("listing_id", F.explode(fields).alias("field"),
                          when.alias("confirmed_at"))


def provenance_baseline(listing: DataFrame, as_of) -> DataFrame:
    """How much of the directory says anyone checked it. One pass, partial aggregates."""
    ok = F.coalesce("status", F.lit("")) == "approved"
    age = age_days(F.col("updated_at"), as_of, clamp=False)

    def blank(c):
        return F.coalesce(F.col(c), F.lit("")) == ""

    no_signal = blank("verified_at") & blank("certified_at") & ~F.coalesce(
        "certified", F.lit(False))
    return listing.agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(ok).alias("approved"),
        F.count_if(ok & no_signal).alias("no_verification_signal"),
        # Ages are whole days, so the exact median's value counts stay small.
        F.median(F.when(ok, age)).cast("int").alias("median_updated_age_days"),
        F.count_if(ok & (age <= 90)).alias("updated_last_90d"),
        F.count_if(ok & ~blank("website")).alias("with_website"))
