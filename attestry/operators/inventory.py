"""What pages a site has, which of them to read first, and how many to read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry import constants as K
from attestry.functions import urls as U
from attestry.functions.scoring import moment
from attestry.functions.text import closure_span, closure_words, shows_hours
from attestry.session import cut_lineage, stored


def first_per(df: DataFrame, keys: list[str], order: Column, limit: int | None = None,
              room: Column | None = None, name: str = "rn") -> DataFrame:
    """Rows numbered per key; with a limit the first ones, fewer where a key has less room left.

    The literal limit lets Spark prune before the shuffle, so one key with very
    many rows sends only its first ones.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn(name, F.row_number().over(w))
    kept = numbered if limit is None else numbered.filter(F.col(name) <= limit)
    return kept if room is None else kept.filter(F.col(name) <= room)


def rounds(limit: int | None):
    """1, 2, ... up to a limit, or until the caller finds nothing new."""
    return count(1) if limit is None else range(1, limit + 1)


# ---------------------------------------------------------------- sites and sitemaps

def site_rules(sites: DataFrame) -> DataFrame:
    """(website, body) to (website, origin, domain, sitemaps, disallow, robots_txt)."""
    rules = U.parse_robots(F.col("body"))
    return sites.select("website", U.origin(F.col("website")).alias("origin"),
                        U.registered_domain(F.col("website")).alias("domain"),
                        rules.alias("r"),
                        (F.coalesce("body", F.lit("")) != "").alias("robots_txt")).select(
        "website", "origin", "domain", F.col("r.sitemaps").alias("sitemaps"),
        F.col("r.disallow").alias("disallow"), "robots_txt")


def crawl_sitemaps(rules: DataFrame, bodies: DataFrame, max_sitemaps: int | None = None,
                   max_urls: int | None = None) -> DataFrame:
    """Pages named by a site's sitemaps: (website, url, lastmod).

    Sitemaps are taken breadth first, declared ones before the standard paths,
    first mention wins. Each level is one join of the new sitemaps with their
    bodies; without budgets the walk ends when a level names nothing new. Levels and
    bodies are as many as sites, whatever their plans promise, so none is broadcast.
    """
    standard = F.transform(F.array(*[F.lit(p) for p in K.SITEMAP_PATHS]),
                           lambda p: F.concat(F.col("origin"), p))
    queue = rules.select("website", "domain", F.posexplode(
        F.concat("sitemaps", standard)).alias("pos", "url")).select(
        "website", "domain", "url", F.lit(0).alias("parent"), "pos")
    bodies = stored(bodies.select("url", "body"), "bodies")  # read at every level
    seen = None
    visited = None
    for _ in rounds(max_sitemaps):
        fresh = (queue.filter(U.registered_domain(F.col("url")) == F.col("domain"))
                 .groupBy("website", "domain", "url")
                 .agg(F.min(F.struct("parent", "pos")).alias("o")))
        if seen is None:
            fresh = fresh.withColumn("before", F.lit(0))
        else:
            taken = seen.groupBy("website").agg(F.count(F.lit(1)).cast("int").alias("before"))
            fresh = (fresh.join(seen.select("website", "url").hint("merge"), ["website", "url"],
                                "left_anti").join(taken.hint("merge"), "website", "left"))
        room = None if max_sitemaps is None else (
            F.lit(max_sitemaps) - F.coalesce("before", F.lit(0)))
        level = cut_lineage(
            first_per(fresh, ["website"], F.col("o"), max_sitemaps, room)
            .select("website", "domain", "url",
                    (F.coalesce("before", F.lit(0)) + F.col("rn")).alias("ord")))
        if level.isEmpty():
            break
        seen = level if seen is None else seen.unionByName(level)
        parsed = (level.join(bodies.select("url", "body").hint("merge"), "url")
                  .filter(F.contains(F.lower("body"), F.lit("<loc")))
                  .select("website", "domain", "ord", U.parse_sitemap(F.col("body")).alias("s")))
        parsed = cut_lineage(parsed)
        visited = parsed if visited is None else visited.unionByName(parsed)
        queue = parsed.select("website", "domain", F.col("ord").alias("parent"),
                              F.posexplode("s.children").alias("pos", "url"))
    if visited is None:
        return rules.limit(0).select("website", F.lit("").alias("url"),
                                     F.lit(None).cast("string").alias("lastmod"))
    entries = (visited.select("website", "domain", "ord",
                              F.posexplode("s.pages").alias("pos", "p"))
               .select("website", "domain", "ord", "pos", "p.url", "p.lastmod")
               .filter(U.registered_domain(F.col("url")) == F.col("domain")))
    return newest_per_url(entries if max_urls is None else _within_url_budget(entries, max_urls))


def _within_url_budget(entries: DataFrame, max_urls: int) -> DataFrame:
    """Entries read before a site's page budget filled up, in reading order.

    Only sites that exceed the budget need the ordered pass.
    """
    sized = entries.groupBy("website").agg(F.count(F.lit(1)).alias("n"))
    over = sized.filter(F.col("n") > max_urls).select("website")
    under = entries.join(over, "website", "left_anti")
    order = Window.partitionBy("website").orderBy("ord", "pos")
    first = F.row_number().over(Window.partitionBy("website", "url").orderBy("ord", "pos")) == 1
    running = F.sum(F.col("first").cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    cut = (entries.join(over, "website", "left_semi").withColumn("first", first)
           .withColumn("distinct_before", F.coalesce(running, F.lit(0)))
           .filter(F.col("distinct_before") < max_urls).drop("first", "distinct_before"))
    return under.unionByName(cut)


def newest_per_url(entries: DataFrame) -> DataFrame:
    return entries.groupBy("website", "url").agg(F.max("lastmod").alias("lastmod"))


def crawl_link_graph(rules: DataFrame, bodies: DataFrame, max_pages: int | None = None,
                     max_depth: int | None = None) -> DataFrame:
    """Breadth-first link walk from each origin over captured pages: (website, url, ord, depth).

    Without budgets it ends when a level links to no new page of its site.
    """
    front = cut_lineage(rules.select(
        "website", "domain", "disallow", F.col("origin").alias("url"), F.lit(1).alias("ord"),
        F.lit(0).alias("depth")))
    out = front
    for depth in rounds(max_depth):
        links = (front.join(bodies.select("url", "html"), "url")
                 .select("website", "domain", "disallow", "ord",
                         F.posexplode(U.crawl_links(F.col("html"), F.col("url")))
                         .alias("pos", "url"))
                 .filter(U.registered_domain(F.col("url")) == F.col("domain"))
                 .filter(U.robots_allow(F.col("url"), F.col("disallow"))))
        fresh = (links.groupBy("website", "url").agg(
                    F.min(F.struct("ord", "pos")).alias("o"),
                    F.first("domain").alias("domain"), F.first("disallow").alias("disallow"))
                 .join(out.select("website", "url"), ["website", "url"], "left_anti")
                 .join(out.groupBy("website").agg(F.count(F.lit(1)).cast("int").alias("before")),
                       "website"))
        room = None if max_pages is None else F.lit(max_pages) - F.col("before")
        front = cut_lineage(first_per(fresh, ["website"], F.col("o"), max_pages, room).select(
            "website", "domain", "disallow", "url", (F.col("before") + F.col("rn")).alias("ord"),
            F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.select("website", "url", "ord", "depth")


def site_inventory(sites: DataFrame, sitemap_bodies: DataFrame, pages: DataFrame,
                   max_sitemaps: int | None = None, max_urls: int | None = None,
                   max_pages: int | None = None, max_depth: int | None = None):
    """(per-site summary, pages): sitemaps first, else links, else none, or robots-denied.

    sites: website, body (robots text). Sites are taken once each, with the greatest body.
    """
    once = sites.groupBy("website").agg(F.max("body").alias("body"))
    rules = cut_lineage(site_rules(once))
    usable = F.col("website").rlike(r"^https?://")
    denied = usable & F.array_contains("disallow", "/")
    open_sites = rules.filter(usable & ~F.array_contains("disallow", "/"))
    from_maps = crawl_sitemaps(open_sites, sitemap_bodies, max_sitemaps, max_urls)
    mapped = from_maps.select("website").distinct()
    walked = crawl_link_graph(open_sites.join(mapped, "website", "left_anti"), pages,
                              max_pages, max_depth)
    width = walked.groupBy("website").agg(F.count(F.lit(1)).alias("n_links"))
    found = from_maps.unionByName(
        walked.select("website", "url", F.lit(None).cast("string").alias("lastmod")))
    listed = cut_lineage(
        found.join(rules.select("website", "disallow"), "website")
        .filter(U.robots_allow(F.col("url"), F.col("disallow"))).drop("disallow"))
    summary = (
        rules.join(mapped.withColumn("mapped", F.lit(True)), "website", "left")
        .join(width, "website", "left")
        .join(page_stats(listed), "website", "left")
        .select("website", "origin",
                F.when(~usable, "none").when(denied, "robots-denied")
                .when(F.col("mapped"), "sitemap").when(F.col("n_links") > 1, "links")
                .otherwise("none").alias("method"),
                F.coalesce("pages", F.lit(0)).alias("pages"),
                F.coalesce("with_lastmod", F.lit(0)).alias("with_lastmod"),
                "newest_lastmod", "robots_txt", F.size("disallow").alias("robots_disallow")))
    return summary, listed


def page_stats(pages: DataFrame) -> DataFrame:
    return pages.groupBy("website").agg(
        F.count(F.lit(1)).alias("pages"), F.count("lastmod").alias("with_lastmod"),
        F.max("lastmod").alias("newest_lastmod"))


# ---------------------------------------------------------------- ranking

def hint_score(words: Column, field: str) -> Column:
    """12 down to 6 for the first hint whose words are all slug words."""
    expr = None
    for i, hint in enumerate(K.SLUG_HINTS.get(field, ())):
        parts = [p for p in hint.split("-") if p]
        hit = F.array_contains(words, parts[0])
        for p in parts[1:]:
            hit = hit & F.array_contains(words, p)
        points = F.lit(float(12 - min(i, 6)))
        expr = F.when(hit, points) if expr is None else expr.when(hit, points)
    return F.lit(0.0) if expr is None else expr.otherwise(0.0)


def base_score(path: Column, lastmod: Column, as_of) -> Column:
    """The part of a page's score that no field changes; recency is a weak term on purpose."""
    depth = F.size(F.array_remove(F.split(path, "/"), ""))
    age = (F.unix_seconds(moment(as_of)) - F.unix_seconds(
        lastmod.try_cast("date").cast("timestamp"))) / 86400.0
    return (
        F.when(depth == 0, 5.0).when(depth == 1, 1.0).otherwise(0.0)
        - 1.5 * F.greatest(F.lit(0), depth - 2)
        - F.when(path.rlike(K.NOISE_RE), 7.0).otherwise(0.0)
        + F.when(age < 180, 3.0).when(age < 730, 1.5).otherwise(0.0)
    )


def rank_pages(pages: DataFrame, fields, as_of, limit: int | None = K.RANK_LIMIT,
               key: str = "website", keep=()) -> DataFrame:
    """Top pages per (site, field): (key, field, rank, url, lastmod, score, *keep); all if None."""
    prepared = pages.select(key, "url", "lastmod", *keep,
                            F.lower(U.url_path(F.col("url"))).alias("path"))
    based = prepared.select(key, "url", "lastmod", *keep,
                            U.slug_words(F.col("path")).alias("words"), base_score(
                                F.col("path"), F.col("lastmod"), as_of).alias("base"))
    scored = based.select(key, "url", "lastmod", *keep, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"),
                 (F.col("base") + hint_score(F.col("words"), f)).alias("score"))
        for f in fields])).alias("s")).select(key, "url", "lastmod", *keep, "s.field", "s.score")
    w = Window.partitionBy(key, "field").orderBy(F.desc("score"), "url")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select(
        key, "field", "rank", "url", "lastmod", "score", *keep)


# ---------------------------------------------------------------- budgets

def select_pages(listings: DataFrame, claim_fields: DataFrame, ranked: DataFrame,
                 budget: int = K.MAX_PAGES_PER_ORG, picks: DataFrame | None = None) -> DataFrame:
    """Which pages to read per listing: (listing_id, pos, url, lastmod).

    Home first, then a picker's choices, then the best three per field in claim
    order; a page counts once, at its first mention.

    listings: listing_id, origin; claim_fields: listing_id, field, field_pos;
    ranked: listing_id, field, rank, url, lastmod; picks: listing_id, field, url, lastmod.
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0)
    home = listings.filter(F.col("origin") != "").select(
        "listing_id", F.concat(F.regexp_replace("origin", "/+$", ""), F.lit("/")).alias("url"),
        none.alias("lastmod"), F.struct(
            zero.alias("t"), F.struct(zero.alias("t"), zero.alias("p")).alias("f"),
            zero.alias("r")).alias("o"))
    # Ranked pages meet a listing's few fields as one array, so they stay where it lies.
    fields = claim_fields.groupBy("listing_id").agg(
        F.collect_list(F.struct("field", "field_pos")).alias("fields"))
    tops = ranked.filter(F.col("rank") <= K.TOP_UP_PER_FIELD).join(fields, "listing_id").select(
        "listing_id", "url", "lastmod", F.col("rank").cast("int").alias("r"), F.explode(F.filter(
            "fields", lambda f: f["field"] == F.col("field"))).alias("f")).select(
        "listing_id", "url", "lastmod",
        F.struct(F.lit(2).alias("t"), F.col("f.field_pos").alias("f"), "r").alias("o"))
    every = home.unionByName(tops)
    if picks is not None:
        every = every.unionByName(picks.join(claim_fields, ["listing_id", "field"]).select(
            "listing_id", "url", "lastmod",
            F.struct(F.lit(1).alias("t"), F.col("field_pos").alias("f"),
                     zero.alias("r")).alias("o")))
    # Dealt by listing once, for the URLs and for their order.
    first = every.repartition("listing_id").groupBy("listing_id", "url").agg(
        F.min("o").alias("o"), F.min_by(F.struct("lastmod"), "o").alias("l"))
    return first_per(first, ["listing_id"], F.col("o"), budget, name="pos").select(
        "listing_id", "pos", "url", F.col("l.lastmod").alias("lastmod"))


def candidate_pages(listings: DataFrame, ranked: DataFrame,
                    top: int = K.MAX_FETCHES + 2) -> DataFrame:
    """Pages the rule check may read, in order: (listing_id, pos, url).

    Home then the best phone pages; a site without an inventory gets the
    standard paths. listings: listing_id, website; ranked: listing_id, rank, url.
    """
    base = F.regexp_replace("website", "/+$", "")
    have = ranked.select("listing_id").distinct()
    home = listings.join(have, "listing_id", "left_semi").select(
        "listing_id", F.concat(base, F.lit("/")).alias("url"), F.lit(0).alias("o"))
    best = ranked.filter(F.col("rank") <= top).select(
        "listing_id", "url", F.col("rank").cast("int").alias("o"))
    fixed = listings.join(have, "listing_id", "left_anti").select(
        "listing_id", base.alias("base"), F.posexplode(
            F.array(*[F.lit(p) for p in K.FALLBACK_PATHS])).alias("o", "p")).select(
        "listing_id", F.concat("base", "p").alias("url"), "o")
    # Dealt by listing once, for the URLs and for their order.
    once = (home.unionByName(best).unionByName(fixed).repartition("listing_id")
            .groupBy("listing_id", "url").agg(F.min("o").alias("o")))
    w = Window.partitionBy("listing_id").orderBy("o")
    return once.select("listing_id", F.row_number().over(w).alias("pos"), "url")


def evidence_flags(text: Column) -> dict[str, Column]:
    """What a page contributes to stopping: a readable number, closure notice, opening hours."""
    usable = F.coalesce(F.length(text) >= K.MIN_VERIFY_CHARS, F.lit(False))
    shown = {"phone": text.rlike(K.PHONE_RE),
             "closure": closure_words(text) & closure_span(text).rlike(K.CLOSURE_RE),
             "hours": shows_hours(text)}
    return {"usable": usable, **{
        f"{name}_here": usable & F.coalesce(here, F.lit(False)) for name, here in shown.items()}}


def gather_evidence(candidates: DataFrame, read: Callable[[DataFrame], DataFrame],
                    max_fetches: int | None = K.MAX_FETCHES) -> DataFrame:
    """Pages read before enough was seen: (listing_id, pos, url, text, usable, seen flags).

    candidates: listing_id, pos from 1 on, url; read turns some of them into the same rows
    with text. A frontier moves from position to position: only listings still undecided are
    read at the next one, so the text read falls with those settled early. A listing is
    settled by a closure notice, or once both a phone number and opening hours have appeared.
    """
    last = max_fetches if max_fetches is not None else (
        candidates.agg(F.max("pos")).first()[0] or 0)
    parts, seen, undecided = [], None, None
    for pos in range(1, max(1, last) + 1):
        frontier = candidates.filter(F.col("pos") == pos)
        if undecided is not None:
            frontier = frontier.join(undecided, "listing_id", "left_semi")
        part = stored(read(frontier).select("listing_id", "pos", "url", "text").withColumns(
            evidence_flags(F.col("text"))), "gathered")
        parts.append(part)
        flags = part.select("listing_id", *(f"{n}_here" for n in ("phone", "closure", "hours")))
        seen = flags if seen is None else seen.unionByName(flags)
        told = seen.groupBy("listing_id").agg(*[
            F.max(f"{n}_here").alias(n) for n in ("phone", "closure", "hours")])
        undecided = told.filter(~(F.col("closure") | (F.col("phone") & F.col("hours")))).select(
            "listing_id")
    return reduce(DataFrame.unionByName, parts)
