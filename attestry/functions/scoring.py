"""Ages, decay, bands, labels, costs and ranks as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import constants as K

ANSWER_SCHEMA = (
    "struct<noul:double,choice:string,confidence:double,score:double,"
    "probabilities:map<string,double>>"
)


def choose(key: Column, table: dict, default=None) -> Column:
    """A constant table as a CASE, so no join is planned for it."""
    expr = reduce(
        lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])),
        list(table.items())[1:],
        F.when(key == next(iter(table)), F.lit(next(iter(table.values())))),
    )
    return expr.otherwise(F.lit(default))


def instant(ts: Column) -> Column:
    """ISO-8601 text to an instant; text without an offset cannot be placed and is NULL."""
    return F.when(ts.rlike(K.OFFSET_RE), ts.try_cast("timestamp"))


def moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def age_days(ts: Column, as_of, clamp: bool = True) -> Column:
    """Whole days since an ISO timestamp; NULL when it cannot be read."""
    micros = F.unix_micros(moment(as_of)) - F.unix_micros(instant(ts))
    days = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0))) if clamp else days


def decay(age: Column, half_life: Column) -> Column:
    return F.coalesce(F.pow(F.lit(0.5), age / half_life), F.lit(0.0))


def half_life(field: Column) -> Column:
    return choose(field, K.HALF_LIFE, K.DEFAULT_HALF_LIFE)


def field_score(field: Column, evidence: Column, age: Column) -> Column:
    ceiling = choose(evidence, K.EVIDENCE_CEILING, 0)
    return F.when(ceiling == 0, F.lit(0.0)).otherwise(
        F.bround(ceiling * decay(age, half_life(field)), 1))


def band(score: Column) -> Column:
    expr = F.when(score >= K.BANDS[0][1], K.BANDS[0][0])
    for name, floor_ in K.BANDS[1:]:
        expr = expr.when(score >= floor_, name)
    return expr.otherwise(K.LAST_BAND)


def classify(support: Column, contradict: Column) -> Column:
    """Contradiction is tested first, against the strictest bar."""
    return (
        F.when(contradict >= K.CONTRADICT_THRESHOLD, "contradicted")
        .when(support >= K.SUPPORT_THRESHOLD, "supported")
        .when((support <= K.REFUTE_THRESHOLD) & (contradict <= K.REFUTE_THRESHOLD), "absent")
        .otherwise("uncertain")
    )


def label_rank(label: Column) -> Column:
    return choose(label, K.LABEL_RANK, -1)


def usd(input_tokens: Column) -> Column:
    return input_tokens / F.lit(1e6) * F.lit(K.USD_PER_INPUT_MTOK)


def priority(confidence: Column, radius: Column) -> Column:
    return F.bround(
        F.coalesce(confidence, F.lit(0.5)) * (F.lit(1.0) + F.coalesce(radius, F.lit(0)) * 0.15), 3)


def triage_score(status: Column, website: Column, verified_at: Column, words: Column,
                 hours_known: Column, as_of, critical=K.CRITICAL_WORDS) -> Column:
    """Where to look first; 0 for anything not approved or without a website."""
    age = age_days(verified_at, as_of, clamp=False)
    score = (
        F.lit(1.0)
        + F.when(age.isNull(), 3.0).otherwise(F.least(age / 365.0, F.lit(3.0)))
        + F.when(F.lower(words).rlike("|".join(critical)), 4.0).otherwise(0.0)
        + F.when(F.coalesce(hours_known, F.lit(False)), 0.0).otherwise(1.0)
    )
    eligible = (F.coalesce(status, F.lit("")) == "approved") & (
        F.coalesce(website, F.lit("")) != "")
    return F.when(eligible, score).otherwise(0.0)


def probability(answer: Column) -> Column:
    return answer["noul"]


def picked(answer: Column) -> Column:
    return F.struct(answer["choice"].alias("choice"),
                    F.coalesce(answer["confidence"], F.lit(0.0)).alias("confidence"))


def read_support(kind: Column, answer: Column, second: Column,
                 levels: int = K.ORDINAL_LEVELS) -> Column:
    """struct(support, contradict) on one 0..1 axis for every question form, or NULL."""
    p = answer["probabilities"]
    return read_values(kind, answer["noul"], second["noul"], answer["score"],
                       F.map_contains_key(p, F.lit("supports")), p["supports"], p["contradicts"],
                       p["0"], levels)


def read_values(kind: Column, noul: Column, second: Column, score: Column, three: Column,
                supports: Column, contradicts: Column, zero: Column,
                levels: int = K.ORDINAL_LEVELS) -> Column:
    """read_support() of what an answer holds; three: does it give relations probabilities?"""
    three_way = F.when(three, F.struct(F.coalesce(supports, F.lit(0.0)).alias("support"),
                                       F.coalesce(contradicts, F.lit(0.0)).alias("contradict")))
    ordinal = F.when(score.isNotNull(), F.struct(
        (score / F.lit(float(levels - 1))).alias("support"),
        F.coalesce(zero, F.lit(0.0)).alias("contradict")))
    pair = F.when(noul.isNotNull() & second.isNotNull(), F.struct(
        noul.alias("support"), second.alias("contradict")))
    return (F.when(kind == "choice", three_way)
            .when(kind == "score", ordinal)
            .when(kind == "noul_pair", pair))
