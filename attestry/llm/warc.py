"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit record says that a URL had not changed (HTTP 304) and holds headers only. It is
resolved by an as-of join: the latest full response of the same canonical URL captured
before it (of equal times, the one of greater record_id). The pair's validators decide:

- both have an ETag: they must be equal in weak comparison;
- else both have Last-Modified: it must be equal;
- else both have a payload digest: it must be equal;
- else the revisit counts as resolved, `unchecked`.

The headers of a resolved revisit are the response's, replaced by those the revisit brings,
except the ones that describe the stored body or the connection (`KEPT`).

The as-of join works in time buckets: each (URL, bucket) is a window of its own, and only the
last response of each bucket is carried on to later ones, so a URL with a third of all
captures is spread over its buckets. Payloads do not travel: the result names the response.

Records without canonical URL or time cannot be joined (`no_response`); null headers are
none; equal records are resolved alike, each on its own row. Of responses that share id, URL
and time, the one whose headers and digest sort last as JSON counts. Further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.url_filter import canonical

BUCKET_SECONDS = 3600

# Stored headers that a not-modified answer must not replace (RFC 9111, 3.2).
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type",
        "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
        "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")

RECORD = ("record_id", "warc_type", "status", "target_uri", "captured_at", "headers",
          "payload_digest")


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then agree, the last value counts."""
    entries = F.map_entries(F.coalesce(headers, F.expr("map()").cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"),
                                                    e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(
        F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def merged(stored: Column, fresh: Column) -> Column:
    """The stored headers with those of the not-modified answer, except KEPT ones."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT))
    rest = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def earlier_response(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Each record with `last`, the latest full response of its URL before it, or null.

    `records` has url, captured_at (a timestamp), order (a value to break ties of time),
    full (is it a full response) and item (the struct to hand on).
    """
    at = records.withColumn("bucket", F.expr(
        f"unix_seconds(captured_at) div {int(bucket_seconds)}"))
    offer = F.when(F.col("full"), F.struct("captured_at", "order", "item"))
    # Same-time rows do not see one another: the range ends before the row's own time.
    micros = F.unix_micros("captured_at")
    within = W.partitionBy("url", "bucket").orderBy(micros).rangeBetween(W.unboundedPreceding, -1)
    here = at.withColumn("here", F.max(offer).over(within))
    ends = at.filter("full").groupBy("url", "bucket").agg(F.max(offer).alias("end"))
    marks = ends.select("url", "bucket", "end").unionByName(
        at.filter("NOT full").select("url", "bucket").distinct().withColumn(
            "end", F.lit(None).cast(ends.schema["end"].dataType)))
    per = marks.groupBy("url", "bucket").agg(F.max("end").alias("end"))
    before = W.partitionBy("url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select("url", "bucket", F.max("end").over(before).alias("carried"))
    h, c = here.alias("h"), carried.alias("c")
    both = h.join(c, (F.col("h.url") == F.col("c.url")) & (F.col("h.bucket") == F.col("c.bucket")),
                  "left")
    return both.select(*[F.col(f"h.{n}") for n in records.columns],
                       F.coalesce("h.here", "c.carried").alias("last"))


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """A row per revisit: record_id, url, outcome, response_id, checked_by, headers.

    `records` has record_id, warc_type (`response` or `revisit`), status, target_uri,
    captured_at, headers (a map) and payload_digest.
    """
    kind = F.lower(F.col("warc_type"))
    rows = records.select(
        F.col("record_id"), F.col("record_id").alias("order"), kind.alias("kind"),
        canonical(F.col("target_uri")).alias("url"), F.col("captured_at").cast("timestamp"),
        ((kind == "response") & (F.col("status") == 200)).alias("full"),
        F.struct(F.col("record_id").alias("id"), lower_keys(F.col("headers")).alias("headers"),
                 F.col("payload_digest").alias("digest")).alias("item"))
    rows = rows.withColumn("full", F.coalesce("full", F.lit(False))).filter(
        F.col("full") | (F.col("kind") == "revisit"))
    placed = F.col("url").isNotNull() & F.col("captured_at").isNotNull()
    # Maps cannot be compared, so only ids take part in the search; headers join afterwards.
    slim = rows.filter(placed).select(
        "url", "captured_at", "order", "full", F.col("item.id").alias("item"))
    revisits = earlier_response(slim, bucket_seconds).filter("NOT full").groupBy(
        F.col("item").alias("record_id"), "url", "captured_at").agg(F.max("last").alias("last"))
    r = rows.filter("kind = 'revisit'").alias("r")
    v = revisits.alias("v")
    found = r.join(v, (F.col("r.record_id") == F.col("v.record_id"))
                   & (F.col("r.url") == F.col("v.url"))
                   & (F.col("r.captured_at") == F.col("v.captured_at")), "left").select(
        "r.record_id", "r.url", "r.captured_at", F.col("r.item").alias("fresh"),
        F.col("v.last.item").alias("response_id"), F.col("v.last.captured_at").alias("answered"))
    # A response that answers very many revisits is split by the skew-aware join.
    told = F.to_json(F.struct(F.array_sort(F.map_entries("item.headers")).alias("h"),
                              F.col("item.digest").alias("d")))
    full = rows.filter(F.col("full") & placed).groupBy(
        F.col("record_id").alias("response_id"), F.col("url").alias("response_url"),
        F.col("captured_at").alias("response_at")).agg(F.max_by("item", told).alias("old"))
    both = found.join(full, (found["response_id"] == full["response_id"])
                      & (found["url"] == full["response_url"])
                      & (found["answered"] == full["response_at"]), "left").select(
        found["record_id"], found["url"], found["captured_at"], "fresh", found["response_id"],
        "old")

    def head(side: str, name: str) -> Column:
        return F.element_at(F.col(f"{side}.headers"), F.lit(name))

    tags = (weak(head("fresh", "etag")), weak(head("old", "etag")))
    dates = (F.trim(head("fresh", "last-modified")), F.trim(head("old", "last-modified")))
    digests = (F.col("fresh.digest"), F.col("old.digest"))
    checked, same = F.lit("none"), F.lit(True)
    for name, (a, b) in (("digest", digests), ("last-modified", dates), ("etag", tags)):
        known = a.isNotNull() & b.isNotNull()
        checked = F.when(known, name).otherwise(checked)
        same = F.when(known, a == b).otherwise(same)
    outcome = (F.when(F.col("response_id").isNull(), "no_response")
               .when(~same, "changed").when(checked == "none", "unchecked").otherwise("resolved"))
    done = outcome.isin("resolved", "unchecked")
    return both.select(
        "record_id", "url", "captured_at", outcome.alias("outcome"), "response_id",
        F.when(F.col("response_id").isNotNull(), checked).alias("checked_by"),
        F.when(done, merged(F.col("old.headers"), F.col("fresh.headers"))).alias("headers"))
