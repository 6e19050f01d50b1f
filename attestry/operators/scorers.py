"""Extension points: judge, extractor, adjudicator, page picker and span picker.

Each takes a plain pandas function. Without one the deterministic default
applies. A missing score is NULL and leads to abstention, never to a guess.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions.contact import oracle, raw_digits
from attestry.functions.text import stripped
from attestry.operators.evidence import closure_hits
from attestry.session import stored

CHUNK = 64


def page_features(pages: DataFrame) -> DataFrame:
    """What the default judge needs from a page, worked out once per page."""
    return pages.withColumns({
        "page_digits": raw_digits(F.col("text")),
        "page_lower": F.lower("text"),
        "page_number": F.col("text").rlike(K.PHONE_RE),
        "page_closed": F.size(closure_hits(F.col("text"))) > 0,
        "page_open": F.col("text").rlike(K.HOURS_RE),
    })


def default_scores(field: Column, stored: Column, claim: Column) -> Column:
    """struct(support, contradict) from string evidence alone, over page_features().

    Undecidable is NULL. A page only contradicts a phone by showing another
    number, and a status by a closure notice.
    """
    on_page = oracle(field, stored, F.col("text"), F.col("page_digits"), F.col("page_lower"))
    words = F.array_distinct(F.filter(F.split(F.lower(claim), r"[^a-z0-9]+"),
                                      lambda w: F.length(w) > 3))
    overlap = F.size(F.filter(words, lambda w: F.contains(F.col("page_lower"), w))) / F.greatest(
        F.size(words), F.lit(1))

    def pair(s, c) -> Column:
        return F.struct(F.lit(s).cast("double").alias("support"),
                        F.lit(c).cast("double").alias("contradict"))

    phone = (F.when(on_page, pair(0.97, 0.01)).when(F.col("page_number"), pair(0.02, 0.99))
             .otherwise(pair(0.02, 0.01)))
    address = F.when(on_page, pair(0.95, 0.02)).when(~on_page, pair(0.02, 0.02))
    status = (F.when(F.col("page_closed"), pair(0.01, 0.995))
              .when(F.col("page_open"), pair(0.75, 0.02)).otherwise(pair(0.4, 0.2)))
    return (F.when(field == "phone", phone).when(field == "address", address)
            .when(field == "status", status)
            .otherwise(F.struct(overlap.alias("support"), F.lit(0.0).alias("contradict"))))


RELATIONS = ("supports", "contradicts", "says_nothing")
# When each relation holds, for the form that spells its options out.
HOLDS_WHEN = ("the page gives the claimed value or makes it certain",
              "the page gives another value for it or denies it",
              "the page is silent on it")


def question_kind(form: str) -> str:
    """The kind of answer a question form asks for."""
    return {"support": "noul", "contradict": "noul", "relation": "choice", "criteria": "choice",
            "ordinal": "score"}[form]


def question(form: str, claim: Column, levels: int = K.ORDINAL_LEVELS) -> Column:
    """One question as a JSON column, built before any scorer runs."""
    options = {
        "noul": F.array(F.lit("true"), F.lit("false")),
        "choice": F.array(*[F.lit(r) for r in RELATIONS]),
        "score": F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: i.cast("string")),
    }[question_kind(form)]
    if form == "criteria":
        options = F.array(*[F.struct(F.lit(r).alias("option"), F.lit(w).alias("holds_when"))
                            for r, w in zip(RELATIONS, HOLDS_WHEN)])
    return F.to_json(F.struct(F.lit(question_kind(form)).alias("type"),
                              F.lit(form).alias("question"), claim.alias("claim"),
                              options.alias("options")))


def option_question(claim: Column, options: Column, prefix: str) -> Column:
    """struct(payload, error): choose one of the options or 'none'; too many is an error."""
    named = F.transform(options, lambda o, i: F.struct(
        F.concat(F.lit(prefix), i.cast("string")).alias("key"), o.alias("value")))
    crit = F.concat(named, F.array(F.struct(F.lit("none").alias("key"),
                                            F.lit("none of these").alias("value"))))
    too_many = F.size(crit) > K.MAX_OPTIONS
    return F.struct(
        F.when(~too_many, F.to_json(F.struct(
            F.lit("choice").alias("type"), claim.alias("claim"), crit.alias("options"))))
        .alias("payload"),
        F.when(too_many, F.concat(F.size(crit).cast("string"), F.lit(" options, at most "),
                                  F.lit(str(K.MAX_OPTIONS)))).alias("error"))


def state_column(form: str, page: Column, org: Column, url: Column,
                 limit: int | None = None) -> Column:
    text = page if limit is None else F.left(page, F.lit(limit))
    if form == "text":
        return text
    return F.to_json(F.struct(org.alias("organisation"), url.alias("page_url"),
                              text.alias("page_text")))


def judge_pages(claims: DataFrame, pages: DataFrame,
                scorer: Callable | None = None) -> DataFrame:
    """Every claim against every selected page of its listing.

    claims: listing_id, key, field, text, stored, ord; pages: listing_id, pos, url,
    text and lastmod. Returns listing_id, key, field, stored, url, pos, lastmod,
    support, contradict. The default stays in the JVM. A scorer is called as
    scorer(page_text, claims) with a list of dicts and returns one (support,
    contradict) pair per claim; a page's text travels to Python once.
    """
    # Claims are packed in chunks of bounded size by their position, so a listing
    # with very many claims becomes many requests instead of one oversized row.
    chunked = claims.groupBy(
        "listing_id", F.col("ord.t").alias("t"),
        F.floor(F.col("ord.p") / CHUNK).alias("chunk")).agg(
        F.collect_list(F.struct("key", "field", "stored", F.col("text").alias("claim")))
        .alias("claims")).select("listing_id", "claims")
    if scorer is None:
        # A page's text meets an array of claims; only keys and scores leave the row.
        scores = F.transform("claims", lambda x: F.struct(
            x["key"].alias("key"), x["field"].alias("field"), x["stored"].alias("stored"),
            default_scores(x["field"], x["stored"], x["claim"]).alias("s")))
        return page_features(pages).join(chunked, "listing_id").select(
            "listing_id", "url", "pos", "lastmod", F.explode(scores).alias("c")).filter(
            F.col("c.s").isNotNull()).select(
            "listing_id", "c.key", "c.field", "c.stored", "url", "pos", "lastmod",
            "c.s.support", "c.s.contradict")

    requests = pages.select("listing_id", "pos", "url", "lastmod", "text").join(
        chunked, "listing_id")
    answered = stored(requests.mapInPandas(
        _page_caller(scorer),
        "listing_id bigint, key string, field string, stored string, url string, pos int, "
        "lastmod string, support double, contradict double, failed boolean"), "answers")
    # The page that failed might have held the support that others lack, so its listing
    # is left without verdicts.
    failed = answered.filter("failed").select("listing_id").distinct()
    return answered.filter(F.col("support").isNotNull() & F.col("contradict").isNotNull()).join(
        failed, "listing_id", "left_anti").drop("failed")


def _page_caller(scorer: Callable):
    def run(batches):
        import pandas as pd

        def answer(row):
            claims = [dict(c) for c in row.claims]
            try:
                return claims, list(scorer(row.text, claims)), False
            except Exception:
                return claims, [(None, None)] * len(claims), True

        columns = ("listing_id", "key", "field", "stored", "url", "pos", "lastmod", "support",
                   "contradict", "failed")
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                claims, scores, failed = answer(row)
                for claim, (support, contradict) in zip(claims, scores):
                    out.append((row.listing_id, claim["key"], claim["field"], claim["stored"],
                                row.url, row.pos, row.lastmod, support, contradict, failed))
            yield pd.DataFrame(out, columns=columns)

    return run


def map_text(df: DataFrame, column: str, fn: Callable, out: str = "reply") -> DataFrame:
    """Run a series-to-series text function (an extractor) in Arrow batches.

    A batch that fails is tried again row by row; only a row that fails is NULL.
    """
    import pandas as pd

    @F.pandas_udf("string")
    def call(texts: pd.Series) -> pd.Series:
        def alone(text):
            try:
                return fn(pd.Series([text])).iloc[0]
            except Exception:
                return None

        try:
            return fn(texts)
        except Exception:
            return pd.Series([alone(t) for t in texts], dtype=object)

    return df.withColumn(out, call(F.col(column)))


def adjudicate(findings: DataFrame, judge: Callable | None = None) -> DataFrame:
    """Add verdict, reason and confidence; an invalid or missing answer falls back to rules.

    findings needs rule_verdict, rule_reason, rule_confidence and evidence (JSON).
    """
    if judge is None:
        return findings.select("*", F.col("rule_verdict").alias("verdict"),
                               F.col("rule_reason").alias("reason"),
                               F.col("rule_confidence").alias("confidence"))
    answered = map_text(findings, "evidence", judge, "answer").withColumn(
        "a", F.from_json("answer", "struct<verdict:string,reason:string,confidence:double>"))
    valid = F.col("a.verdict").isin("discrepancy", "match", "abstain")
    return answered.select(
        *findings.columns,
        F.when(valid, F.col("a.verdict")).otherwise(F.col("rule_verdict")).alias("verdict"),
        F.when(valid, F.coalesce("a.reason", F.lit(""))).otherwise(F.col("rule_reason"))
        .alias("reason"),
        F.when(valid, F.coalesce("a.confidence", F.lit(0.5))).otherwise(
            F.col("rule_confidence")).alias("confidence"))


def picked_pages(shortlist: DataFrame, answers: DataFrame) -> DataFrame:
    """Turn a picker's 'u3' answers into URLs of the shortlist; 'none' picks nothing.

    shortlist: listing_id, field, rank, url, lastmod; answers: listing_id, field, choice.
    """
    index = F.regexp_extract("choice", r"^u(\d+)$", 1).try_cast("int")
    # One answer per field: they come to their listing's pages as one array.
    chosen = answers.select("listing_id", "field", (index + 1).alias("rank")).filter(
        F.col("rank").isNotNull()).groupBy("listing_id").agg(
        F.collect_list(F.struct("field", "rank")).alias("chosen"))
    return shortlist.join(chosen, "listing_id").select(
        "listing_id", "field", "url", "lastmod", F.explode(F.filter(
            "chosen", lambda a: (a["field"] == F.col("field")) & (a["rank"] == F.col("rank")))
        ).alias("a")).drop("a")


def spans(text: Column, width: int | None = None) -> Column:
    """Numbered sentence spans of a page for a span picker, whole unless a width is given."""
    return F.transform(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: stripped(s) != ""),
                       lambda s, i: F.struct(i.alias("i"), (
                           s if width is None else F.left(s, F.lit(width))).alias("span")))


def first_span(pages: DataFrame, pattern: str, *keys: str) -> DataFrame:
    """(keys, i, span): the first sentence span of each page's text that shows a pattern.

    Only a page's head is cut into spans, up to the end of the first sentence that shows the
    pattern; the whole page where what is shown there belongs to no one span.
    """
    ending = r"(?=(?<=[.!?])\s|\z)"
    head = F.regexp_extract("text", rf"(?s)^.*?(?:{pattern}).*?{ending}", 0)

    def found(text: Column) -> Column:
        return F.get(F.filter(spans(text), lambda s: s["span"].rlike(pattern)), F.lit(0))

    # Exploding works the head out once and drops pages that do not show the pattern.
    heads = pages.select(*keys, "text", F.explode(F.array_compact(F.array(
        F.nullif(head, F.lit(""))))).alias("head"))
    return heads.select(*keys, F.explode(F.array_compact(F.array(
        F.coalesce(found(F.col("head")), found(F.col("text")))))).alias("s")).select(
        *keys, "s.i", "s.span")
