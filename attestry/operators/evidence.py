"""Stored values against a listing's own pages: findings, labels, identity, verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions.contact import phone_key, raw_digits
from attestry.functions.scoring import classify, label_rank, usd
from attestry.functions.text import (
    all_matches,
    blank_to_null,
    closure_span,
    closure_words,
    snippet_at,
    stripped,
)
from attestry.operators.chunks import in_chunks


@dataclass(frozen=True)
class Site:
    """Where listings live; used to build links, never contacted."""

    directory: str = "https://directory.example"
    api: str = "https://directory.example/api"
    submitted_by: str = "attestry (human review required)"

    def listing_url(self, rid: Column) -> Column:
        return F.concat(F.lit(f"{self.directory}/organizations/"), rid.cast("string"))

    def edit_url(self, rid: Column, supplied: Column | None = None) -> Column:
        built = F.concat(self.listing_url(rid), F.lit("/edit"))
        return built if supplied is None else F.coalesce(blank_to_null(supplied), built)

    def endpoint(self, rid: Column, field: Column, phone_id: Column) -> Column:
        by_phone = field.isin(*K.PHONE_FIELDS) & (F.coalesce(phone_id, F.lit(0)) != 0)
        return F.when(by_phone, F.concat(F.lit(f"{self.api}/phones/"), phone_id.cast("string"),
                                         F.lit("/change_requests"))).otherwise(
            F.concat(F.lit(f"{self.api}/resources/"), rid.cast("string"),
                     F.lit("/change_requests")))


# ---------------------------------------------------------------- captures

def capture_tiers(captures: DataFrame, keys: list[str]) -> DataFrame:
    """One row per page: texts d and r, errors de and re of its direct and rendered tier."""
    def tier(method: str, column: str) -> Column:
        mine = F.col("method") == method
        if "at" in captures.columns:  # a page captured again: the newest counts
            return F.max_by(F.col(column), F.when(mine, F.struct("at", column)))
        return F.max(F.when(mine, F.col(column)))

    return captures.groupBy(*keys).agg(
        tier("direct", "text").alias("d"), tier("reader", "text").alias("r"),
        tier("direct", "error").alias("de"), tier("reader", "error").alias("re"))


def best_capture(captures: DataFrame, keys: list[str], reader: bool = True,
                 longest: bool = False) -> DataFrame:
    """One text per page from its capture tiers: (keys, text, method, error).

    Direct text when it is long enough, else the rendered one, else short
    direct text. longest=True prefers the rendered text whenever it is longer.
    """
    return capture_tiers(captures, keys).select(*keys, *best_of_tiers(reader, longest))


def best_of_tiers(reader: bool = True, longest: bool = False) -> list[Column]:
    """text, method and error of best_capture() from the columns of capture_tiers()."""
    d, r = blank_to_null(F.col("d")), blank_to_null(F.col("r"))
    if longest:
        use_reader = r.isNotNull() & (d.isNull() | (F.length(r) > F.length(d)))
    elif reader:
        use_reader = (F.coalesce(F.length(d), F.lit(0)) < K.MIN_USEFUL_CHARS) & (
            F.coalesce(F.length(r), F.lit(0)) >= K.MIN_USEFUL_CHARS)
    else:
        use_reader = F.lit(False)
    text = F.when(use_reader, r).otherwise(d)
    return [
        text.alias("text"),
        F.when(use_reader, "reader").when(d.isNotNull(), "direct").alias("method"),
        F.when(text.isNull(), F.coalesce(
            F.col("re") if reader else F.lit(None), F.col("de"),
            F.lit("neither capture of the page holds text"))).alias("error")]


def audit_pages(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Best captures long enough to judge, with their whole text."""
    return best_capture(captures, keys).filter(F.length("text") >= K.MIN_USEFUL_CHARS)


# ---------------------------------------------------------------- rule findings

def closure_hits(text: Column) -> Column:
    """Closure phrases on a page that survive the guard: array of (match, quote).

    A quote that looks like code is rejected, and a weak phrase needs the
    organisation as its subject. Only the part of a page from its first to its last phrase
    word is searched.
    """
    none = F.array().cast("array<struct<match:string,quote:string>>")

    def placed(found: Column) -> Column:
        # What equals a match is one itself, so each lies at its first place behind the last one.
        return F.aggregate(
            found, F.struct(F.lit(1).alias("at"), none.alias("hits")),
            lambda acc, m: F.get(F.transform(
                F.array(F.position(m, text, acc["at"])), lambda at: F.struct(
                    (at + F.length(m)).alias("at"),
                    F.concat(acc["hits"], F.array(F.struct(
                        m.alias("match"), snippet_at(text, at, F.length(m)).alias("quote"))))
                    .alias("hits"))), F.lit(0)))["hits"]

    kept = F.filter(placed(all_matches(closure_span(text), K.CLOSURE_RE, 0)), lambda h: ~h["quote"].rlike(K.CODE_RE) & (
        h["match"].rlike(K.STRONG_CLOSURE_RE) | h["quote"].rlike(K.SUBJECT_RE)))
    return F.when(~closure_words(text), none).otherwise(kept)


def closure_findings(pages: DataFrame) -> DataFrame:
    """First surviving closure phrase per listing in page order."""
    # Exploding drops pages without a hit and works the hits out once.
    hits = pages.filter(closure_words(F.col("text"))).select(
        "listing_id", "pos", "url",
        F.explode(F.slice(closure_hits(F.col("text")), 1, 1)).alias("h"))
    return hits.groupBy("listing_id").agg(F.min_by(
        F.struct(F.col("h.match").alias("live"), "url", F.col("h.quote").alias("quote")), "pos")
        .alias("f")).select("listing_id", "f.*")


def shown_numbers(text: Column) -> Column:
    """Every number shown on a page, in order: array of (live, key)."""
    return F.transform(all_matches(text, K.PHONE_RE, 0), lambda live: F.struct(
        live.alias("live"), phone_key(live).alias("key")))


def page_phones(pages: DataFrame) -> DataFrame:
    """Every number shown on a page: (listing_id, pos, url, at, live, key)."""
    return pages.select("listing_id", "pos", "url", F.posexplode(
        all_matches(F.col("text"), K.PHONE_RE, 0)).alias("at", "live")).withColumn(
        "key", phone_key(F.col("live")))


def _keyed(phone: DataFrame) -> DataFrame:
    return phone.withColumn("key", phone_key(F.col("number"))).filter(F.col("key").isNotNull())


def _met_numbers(phone: DataFrame, pages: DataFrame) -> DataFrame:
    """(listing_id, pos, url, numbers, quote, hit): pages next to their listing's stored numbers.

    numbers: shown_numbers(); quote: the text around the first one; hit: the first shown number
    equal to a stored one, as (at, stored_pos, stored, live, phone_id). The numbers of a page are
    looked for once, and no text meets another row.
    """
    mine = in_chunks(_keyed(phone), ["pos", "phone_id"], "key", F.col("pos").alias("stored_pos"),
                     F.col("number").alias("stored"), "phone_id", name="mine")
    first = F.get(F.col("numbers"), F.lit(0))["live"]
    rows = pages.select("listing_id", "pos", "url", "text",
                        shown_numbers(F.col("text")).alias("numbers")).select(
        "listing_id", "pos", "url", "numbers", F.when(F.size("numbers") > 0, snippet_at(
            F.col("text"), F.instr("text", first), F.length(first))).alias("quote"))
    equal = F.flatten(F.transform("numbers", lambda n, at: F.transform(
        F.filter("mine", lambda s: s["key"] == n["key"]), lambda s: F.struct(
            at.alias("at"), s["stored_pos"].alias("stored_pos"), s["stored"].alias("stored"),
            n["live"].alias("live"), s["phone_id"].alias("phone_id")))))
    return rows.join(mine, "listing_id").select(
        "listing_id", "pos", "url", "numbers", "quote", F.array_min(equal).alias("hit"))


def _first_hit() -> Column:
    order = F.struct("pos", "hit.at", "hit.stored_pos")
    return F.min_by(F.struct("hit.stored", "hit.live", "url", "hit.phone_id"),
                    F.when(F.col("hit").isNotNull(), order))


def phone_matches(phone: DataFrame, pages: DataFrame) -> DataFrame:
    """First shown number equal to any stored one, per listing."""
    return _met_numbers(phone, pages).groupBy("listing_id").agg(_first_hit().alias("f")).filter(
        F.col("f").isNotNull()).select("listing_id", "f.*")


def phone_findings(phone: DataFrame, pages: DataFrame) -> DataFrame:
    """Phone evidence per listing: a match, else the first number shown instead.

    With one stored number that is a mismatch; with several it is only a number
    missing from the listing.
    """
    stored = _keyed(phone).groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("n_stored"),
        F.min_by(F.struct("number", "phone_id"), "pos").alias("first"))
    some = F.size("numbers") > 0
    seen = _met_numbers(phone, pages).groupBy("listing_id").agg(
        F.max(some).alias("some"), _first_hit().alias("hit"), F.min_by(
            F.struct(F.get(F.col("numbers"), F.lit(0))["live"].alias("live"), "url", "quote"),
            F.when(some, F.col("pos"))).alias("shown")).filter("some")
    several = F.col("n_stored") > 1
    found = stored.join(seen, "listing_id")
    matched = F.col("hit").isNotNull()
    missing = F.concat(F.lit("not among the "), F.col("n_stored").cast("string"),
                       F.lit(" numbers on the listing"))
    return found.select(
        "listing_id",
        F.when(~matched & several, "phone_missing").otherwise("phone").alias("field"),
        F.when(matched, F.col("hit.stored")).when(several, missing)
        .otherwise(F.col("first.number")).alias("stored"),
        F.when(matched, F.col("hit.live")).otherwise(F.col("shown.live")).alias("live"),
        F.when(matched, F.col("hit.url")).otherwise(F.col("shown.url")).alias("url"),
        F.when(matched, F.col("hit.live")).otherwise(F.col("shown.quote")).alias("quote"),
        matched.alias("match"),
        F.when(matched, F.col("hit.phone_id")).when(~several, F.col("first.phone_id"))
        .alias("phone_id"))


def address_findings(address: DataFrame, pages: DataFrame) -> DataFrame:
    """First page that shows the postal code of a listing's first address."""
    joined = stripped(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (
        "address_1", "city", "postal_code")]))
    first = (address.filter(F.col("pos") == 0).select(
        "listing_id", joined.alias("stored"), "postal_code")
        .filter((F.col("stored") != "") & (F.coalesce("postal_code", F.lit("")) != "")))
    # The listing key makes this an equi join; the containment test is a residual.
    hits = pages.join(first, "listing_id").filter(F.contains(F.col("text"), F.col("postal_code")))
    quote = snippet_at(F.col("text"), F.instr("text", F.col("postal_code")),
                       F.length("postal_code"))
    return hits.groupBy("listing_id").agg(F.min_by(
        F.struct("stored", "url", quote.alias("quote")), "pos").alias("f")).select(
        "listing_id", "f.*")


def same_number(stored: Column, live: Column) -> Column:
    return phone_key(stored).eqNullSafe(phone_key(live))


def actionable(f: Column) -> Column:
    """Both sides stated and really different."""
    s = stripped(F.coalesce(f["stored"], F.lit("")))
    v = stripped(F.coalesce(f["live"], F.lit("")))
    return (s != "") & (v != "") & (s != v) & ~((f["field"] == "phone") & same_number(s, v))


def finding(field, stored, live, url, quote, match, structural=False, phone_id=None,
            proposed=None) -> Column:
    def text(c) -> Column:
        return (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")

    return F.struct(
        text(field).alias("field"), text(stored).alias("stored"), text(live).alias("live"),
        text(url).alias("evidence_url"), text(quote).alias("evidence_quote"),
        (match if isinstance(match, Column) else F.lit(match)).alias("match"),
        F.lit(structural).alias("structural"),
        (F.lit(None) if phone_id is None else phone_id).cast("bigint").alias("phone_id"),
        text(proposed).alias("proposed"))


def change_request(rid: Column, findings: Column, verdict: Column, site: Site,
                   supplied_edit: Column | None = None) -> Column:
    """Proposed edit for a discrepancy: the first usable mismatch, else the first usable finding."""
    usable = F.filter(findings, actionable)
    wrong = F.get(F.filter(usable, lambda f: ~f["match"]), F.lit(0))
    bad = F.coalesce(wrong, F.get(usable, F.lit(0)))
    return F.when((verdict == "discrepancy") & bad.isNotNull(), F.struct(
        rid.alias("resource_id"), bad["phone_id"].alias("phone_id"), bad["field"].alias("field"),
        site.listing_url(rid).alias("listing_url"),
        site.edit_url(rid, supplied_edit).alias("listing_edit_url"),
        site.endpoint(rid, bad["field"], bad["phone_id"]).alias("endpoint"),
        F.lit("POST").alias("method"), bad["stored"].alias("current"),
        F.coalesce(bad["proposed"], bad["live"]).alias("proposed"),
        bad["evidence_url"].alias("source_url"), bad["evidence_quote"].alias("source_quote"),
        F.lit(site.submitted_by).alias("submitted_by"), F.lit(False).alias("posted")))


def rule_verdict(closure: Column, phone: Column, address: Column) -> Column:
    """struct(verdict, reason, confidence) from finding structs, NULL where absent."""
    closed = closure.isNotNull()
    wrong = (phone["field"] == "phone") & ~phone["match"]
    agrees = F.coalesce(phone["match"], F.lit(False)) | address.isNotNull()

    def out(verdict, reason, confidence) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"),
                        F.lit(confidence).alias("confidence"))

    return (
        F.when(closed, out("discrepancy", F.concat(
            F.lit('The site itself speaks of closing or moving: "'),
            closure["evidence_quote"], F.lit('"')), 0.7))
        .when(F.coalesce(wrong, F.lit(False)), out("discrepancy", F.concat(
            F.lit("No page shows the stored phone "), phone["stored"], F.lit("; the site gives "),
            phone["live"], F.lit(".")), 0.55))
        .when(agrees, out("match", F.lit(K.REASON_MATCH), 0.6))
        .otherwise(out("abstain", F.lit(K.REASON_ABSTAIN), 0.3))
    )


def verify(listing: DataFrame, phone: DataFrame, address: DataFrame, pages: DataFrame,
           structural: DataFrame, site: Site = Site(), judge=None,
           fetched: DataFrame | None = None) -> DataFrame:
    """One result row per listing.

    pages: usable gathered pages (listing_id, pos, url, text); fetched: listing_id, pos, url of
    all pages read, usable or not. A listing's service_edit_url, where it has one, is the edit
    URL of its change request. A structural defect stands on its own, whatever happened to the
    site.
    """
    from attestry.operators.scorers import adjudicate

    read = pages.select("listing_id").distinct().select(
        F.col("listing_id").alias("id"), F.lit(True).alias("has_text"))
    rid = F.col("id")
    tel = phone_findings(phone, pages).select(
        F.col("listing_id").alias("id"),
        finding(F.col("field"), F.col("stored"), F.col("live"), F.col("url"), F.col("quote"),
                F.col("match"), phone_id=F.col("phone_id")).alias("phone_f"))
    shut = closure_findings(pages).select(
        F.col("listing_id").alias("id"),
        finding("operating_status", K.STORED_OPEN, F.col("live"), F.col("url"), F.col("quote"),
                False).alias("closure_f"))
    adr = address_findings(address, pages).select(
        F.col("listing_id").alias("id"),
        finding("address", F.col("stored"), F.col("stored"), F.col("url"), F.col("quote"), True)
        .alias("address_f"))
    form = structural.select(F.col("listing_id").alias("id"), structural_struct(site).alias(
        "structural_f"))
    tried = (pages if fetched is None else fetched).groupBy(F.col("listing_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda p: p["url"])
        .alias("fetched"))  # as many as a listing's reading budget
    rows = listing.select("id", "name", "website", _supplied(listing).alias("supplied"))
    for part in (read, tried, tel, shut, adr, form):
        rows = rows.join(part, "id", "left")
    rows = rows.withColumn("found", F.filter(
        F.array("phone_f", "closure_f", "address_f", "structural_f"), lambda f: f.isNotNull()))
    rule = rule_verdict(F.col("closure_f"), F.col("phone_f"), F.col("address_f"))
    ruled = rows.withColumn("rule", rule).select(
        "*", F.col("rule.verdict").alias("rule_verdict"), F.col("rule.reason").alias("rule_reason"),
        F.col("rule.confidence").alias("rule_confidence"),
        F.to_json("found").alias("evidence"))
    judged = adjudicate(ruled, judge)

    no_site = F.coalesce("website", F.lit("")) == ""
    early = no_site | F.col("has_text").isNull()
    defect = F.col("structural_f").isNotNull()
    usable = F.filter(F.col("found"), actionable)
    empty = (F.col("verdict") == "discrepancy") & (F.size(usable) == 0)
    verdict = (F.when(early & defect, "discrepancy").when(early, "abstain")
               .when(empty, "abstain").otherwise(F.col("verdict")))
    reason = (
        F.when(early & defect, F.col("structural_f.stored"))
        .when(no_site, K.REASON_NO_WEBSITE).when(early, K.REASON_NO_TEXT)
        .when(empty, F.concat(F.lit(
            "A problem was reported, but every gathered field agrees, so no change can be "
            "proposed. What was reported: "), F.col("reason")))
        .otherwise(F.col("reason")))
    confidence = (F.when(early & defect, 0.95).when(no_site, 1.0).when(early, 0.2)
                  .when(empty, F.least(F.col("confidence"), F.lit(0.3)))
                  .otherwise(F.col("confidence")))
    only_defect = F.when(defect, F.array("structural_f")).otherwise(
        F.array().cast(ruled.schema["found"].dataType))
    out = judged.select(
        rid.alias("resource_id"), "name", F.col("website").alias("org_website"),
        verdict.alias("verdict"), reason.alias("reason"), confidence.alias("confidence"),
        F.when(early, only_defect).otherwise(usable).alias("fields"),
        F.when(~no_site, F.col("fetched")).alias("fetched"), "supplied",
        F.when(early, only_defect).otherwise(F.col("found")).alias("found"))
    return out.withColumn("fetched", F.coalesce("fetched", F.array().cast("array<string>"))
                          ).withColumn("change_request", change_request(
        F.col("resource_id"), F.col("found"), F.col("verdict"), site, F.col("supplied"))).drop(
        "found", "supplied")


def _supplied(listing: DataFrame) -> Column:
    """The edit URL that came with a listing, null where its table has none."""
    if "service_edit_url" in listing.columns:
        return F.col("service_edit_url")
    return F.lit(None).cast("string")


def verify_many(results: DataFrame, check) -> DataFrame:
    """A caller's check over verification results; a row it fails on abstains, alone.

    check takes a pandas frame with resource_id, name, org_website, verdict, reason and
    confidence and returns one with verdict, reason and confidence, row by row. `error` tells
    what went wrong; such a row keeps no fields and asks for no change.
    """
    from attestry.operators.contained import contained

    seen = ["resource_id", "name", "org_website", "verdict", "reason", "confidence"]
    told = contained(results.select(*seen), check,
                     "verdict string, reason string, confidence double", ["resource_id"])
    # Nested columns stay in the JVM: the check never needs them.
    j = results.drop("verdict", "reason", "confidence").join(told, "resource_id")
    bad = F.col("error").isNotNull()
    none = F.array().cast(results.schema["fields"].dataType)
    return j.select(
        "resource_id", "name", "org_website",
        F.when(bad, "abstain").otherwise(F.col("verdict")).alias("verdict"),
        F.when(bad, F.concat(F.lit("the check failed on this record: "), F.col("error")))
        .otherwise(F.col("reason")).alias("reason"),
        F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(bad, none).otherwise(F.col("fields")).alias("fields"), *[
            F.col(x) for x in ("fetched",) if x in results.columns],
        F.when(~bad, F.col("change_request")).alias("change_request"), "error", "tries")


def structural_struct(site: Site) -> Column:
    return finding("phone_format", F.col("stored"), F.col("live"),
                   site.listing_url(F.col("listing_id")), F.col("stored"), False,
                   structural=True, phone_id=F.col("phone_id"), proposed=F.col("proposed"))


def merge_structural(results: DataFrame, structural: DataFrame, approved: DataFrame,
                     site: Site = Site()) -> DataFrame:
    """Structural findings of the whole approved corpus override or extend checked results.

    A listing that already carries its defect keeps it once, in first place.
    """
    form = (structural.join(approved.select(F.col("id").alias("listing_id"),
                                            F.col("name").alias("listing_name"),
                                            F.col("website").alias("listing_site"),
                                            _supplied(approved).alias("supplied")), "listing_id")
            .select(F.col("listing_id").alias("resource_id"), "listing_name", "listing_site",
                    "supplied", structural_struct(site).alias("s")))
    j = results.join(form, "resource_id", "full_outer")
    hit = F.col("s").isNotNull()
    fields_type = results.schema["fields"].dataType
    rest = F.filter(F.coalesce("fields", F.array().cast(fields_type)),
                    lambda f: ~f["structural"])
    fresh = change_request(F.col("resource_id"), F.array("s"), F.lit("discrepancy"), site,
                           F.col("supplied"))
    return j.select(
        "resource_id", F.coalesce("name", "listing_name").alias("name"),
        F.coalesce("org_website", "listing_site").alias("org_website"),
        F.when(hit, "discrepancy").otherwise(F.col("verdict")).alias("verdict"),
        F.when(hit, F.col("s.stored")).otherwise(F.col("reason")).alias("reason"),
        F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.95)))
        .otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.concat(F.array("s"), rest)).otherwise(F.col("fields")).alias("fields"),
        F.coalesce("fetched", F.array().cast("array<string>")).alias("fetched"),
        F.when(hit, fresh).otherwise(F.col("change_request")).alias("change_request"))


# ---------------------------------------------------------------- labels

def label_rows(scored: DataFrame) -> DataFrame:
    return scored.withColumn("label", classify(F.col("support"), F.col("contradict")))


def reconcile(labelled: DataFrame) -> DataFrame:
    """Best evidence per (listing, claim): support beats contradiction beats doubt beats silence.

    Among supporting pages the strongest wins, otherwise the first page read.
    """
    rank = label_rank(F.col("label"))
    order = F.struct(
        rank.alias("rank"),
        F.when(F.col("label") == "supported", F.col("support")).otherwise(0.0).alias("strength"),
        (-F.col("pos")).alias("earliest"))
    keep = [c for c in labelled.columns if c not in ("listing_id", "key")]
    return labelled.groupBy("listing_id", "key").agg(
        F.max_by(F.struct(*keep), order).alias("v")).select("listing_id", "key", "v.*")


def distinct_findings(verdicts: DataFrame, order: Column) -> DataFrame:
    """Contradicted verdicts, one per (listing, field, stored value)."""
    keep = [c for c in verdicts.columns if c not in ("listing_id", "field")]
    return (verdicts.filter(F.col("label") == "contradicted")
            .withColumn("value", F.lower(stripped(F.coalesce("stored", F.lit("")))))
            .groupBy("listing_id", "field", "value")
            .agg(F.min_by(F.struct(*keep), order).alias("v"))
            .select("listing_id", "field", "v.*"))


# ---------------------------------------------------------------- identity

def identity_anchors(phone: DataFrame, address: DataFrame) -> DataFrame:
    """Facts that would prove a page belongs to a listing: (listing_id, kind, value, rank, ord).

    Never the name: a domain unrelated to the name is normal.
    """
    d = raw_digits(F.col("number"))
    tels = phone.filter(F.length(d) >= 10).select(
        "listing_id", F.lit("phone").alias("kind"), F.right(d, F.lit(10)).alias("value"),
        F.lit(0).alias("rank"), F.col("pos").cast("int").alias("ord"))
    zip_ = stripped(F.coalesce("postal_code", F.lit("")))
    street = F.array_join(F.slice(F.filter(F.split(stripped(F.coalesce("address_1", F.lit(""))),
                                                   r"\s+"), lambda w: w != ""), 1, 2), " ")
    city = stripped(F.coalesce("city", F.lit("")))
    places = address.select("listing_id", "pos", F.explode(F.array(
        F.struct(F.lit("street").alias("kind"), street.alias("value"), F.lit(1).alias("rank"),
                 (F.length(street) >= 6).alias("ok")),
        F.struct(F.lit("postal_code").alias("kind"), F.left(zip_, F.lit(5)).alias("value"),
                 F.lit(2).alias("rank"), (F.length(zip_) >= 5).alias("ok")),
        F.struct(F.lit("city").alias("kind"), city.alias("value"), F.lit(3).alias("rank"),
                 (F.length(city) >= 4).alias("ok")))).alias("a")).filter("a.ok")
    return tels.unionByName(places.select("listing_id", "a.kind", "a.value", "a.rank",
                                          F.col("pos").cast("int").alias("ord")))


def identity(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """Strongest anchor shown by any page, per listing that has pages.

    Returns listing_id, belongs, anchor_kind, anchor_value, anchor_url. A
    listing without anchors cannot be doubted.
    """
    # One pass over the pages: every page meets its listing's anchors, if there are any, and
    # is made lower case and digits once for them all.
    needle = F.when(F.col("kind") == "phone", F.col("value")).otherwise(F.lower("value"))
    known = in_chunks(anchors, ["rank", "ord"], "rank", "ord", "kind", "value",
                      needle.alias("needle"), name="anchors")

    def strongest(page: Column) -> Column:
        shown = F.filter("anchors", lambda a: F.contains(
            F.when(a["kind"] == "phone", page["digits"]).otherwise(page["low"]), a["needle"]))
        return F.array_min(F.transform(shown, lambda a: F.struct(
            a["rank"].alias("rank"), F.col("pos").alias("pos"), a["ord"].alias("ord"),
            a["kind"].alias("kind"), a["value"].alias("value"), F.col("url").alias("url"))))

    forms = F.array(F.struct(F.lower("text").alias("low"),
                             raw_digits(F.col("text")).alias("digits")))
    best = F.get(F.transform(forms, strongest), F.lit(0))
    met = pages.select("listing_id", "pos", "url", "text").join(
        known, "listing_id", "left").select("listing_id", "anchors", best.alias("b")).groupBy(
        "listing_id").agg(F.count("anchors").alias("anchored"), F.min("b").alias("b"))
    return met.select(
        "listing_id", ((F.col("anchored") == 0) | F.col("b").isNotNull()).alias("belongs"),
        F.col("b.kind").alias("anchor_kind"), F.col("b.value").alias("anchor_value"),
        F.col("b.url").alias("anchor_url"))


# ---------------------------------------------------------------- audit

def audit(listing: DataFrame, claims: DataFrame, inventory: DataFrame, pages: DataFrame,
          anchors: DataFrame, scorer=None, available: bool = True):
    """(per-listing summary, verdict rows).

    pages: the selected, readable pages (listing_id, pos, url, lastmod, text);
    inventory: listing_id, method, pages. Every early exit becomes a note.
    """
    from attestry.operators.scorers import judge_pages

    scored = label_rows(judge_pages(claims, pages, scorer))
    ident = identity(anchors, pages)
    verdicts = reconcile(scored)
    allowed = ident.filter("belongs").select("listing_id")
    kept = verdicts.join(allowed, "listing_id", "left_semi")
    if not available:
        kept = kept.limit(0)
    findings = distinct_findings(kept, F.col("key")).groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("n_findings"))
    counts = kept.groupBy("listing_id").agg(
        F.count_if(F.col("label") == "supported").alias("n_confirmations"),
        F.count(F.lit(1)).alias("n_verdicts"))
    usage = pages.groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.ceil(F.length("text") / 4)).alias("input_tokens"))
    has_claims = claims.select("listing_id").distinct().withColumn("has_claims", F.lit(True))
    rows = listing.select(F.col("id").alias("listing_id"), "name", "website")
    for part in (inventory.select("listing_id", "method", F.col("pages").alias("n_pages")),
                 has_claims, ident, findings, counts, usage):
        rows = rows.join(part, "listing_id", "left")
    note = F.when(F.coalesce(stripped("website"), F.lit("")) == "", K.NOTE_NO_WEBSITE)
    if not available:
        note = note.otherwise(K.NOTE_NO_SCORER)
    else:
        note = (note.when(F.col("has_claims").isNull(), K.NOTE_NO_CLAIMS)
                .when(F.col("method") == "robots-denied", K.NOTE_ROBOTS)
                .when(F.coalesce("n_pages", F.lit(0)) == 0, K.NOTE_NO_PAGES)
                .when(F.col("belongs").isNull(), K.NOTE_UNREADABLE)
                .when(~F.col("belongs"), K.NOTE_SUSPECT).otherwise(""))
    zero = F.lit(0).cast("bigint")
    summary = rows.select(
        "listing_id", "name", "website", note.alias("note"),
        F.coalesce(~F.col("belongs"), F.lit(False)).alias("website_suspect"),
        F.coalesce("n_findings", zero).alias("n_findings"),
        F.coalesce("n_confirmations", zero).alias("n_confirmations"),
        F.coalesce("n_verdicts", zero).alias("n_verdicts"),
        F.coalesce("calls", zero).alias("calls"),
        usd(F.coalesce("input_tokens", zero)).alias("cost_usd"))
    return summary, kept
