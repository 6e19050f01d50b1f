"""The jobs chained: from listings and captured pages to the ranked queue."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions import urls as U
from attestry.operators import claims as C
from attestry.operators import entity_graph as G
from attestry.operators import evidence as E
from attestry.operators import freshness as FR
from attestry.operators import inventory as I
from attestry.operators import review_queue as R
from attestry.operators import structural as S
from attestry.plans.adapters import AS_OF, Tables
from attestry.session import dealt, stored
from attestry.sources import landed as L


class DirectoryRun:
    """Stages of one directory run. Pages chosen for reading are written once and re-read."""

    def __init__(self, t: Tables, as_of: str = AS_OF):
        self.t, self.d, self.as_of = t, t.directory, as_of

    @cached_property
    def listing(self) -> DataFrame:
        """Listings with the edit URL that the work list supplies."""
        return L.enrich(self.d.listing, L.work_list_index(self.t.work_list))

    @cached_property
    def _rules(self) -> DataFrame:
        """One row per site, also where several listings share it and its robots text."""
        return I.site_rules(self.t.robots_body).groupBy("website").agg(
            F.max("disallow").alias("disallow"))

    @cached_property
    def site_rows(self) -> DataFrame:
        """Pages of each listing's own site that its robots rules allow, without their text."""
        # A site's rules and domain are looked up once for all its pages.
        rules = self._rules.select(F.col("website").alias("site"), "disallow")
        sites = self.t.site_row.join(rules, "site", "left").withColumn(
            "domain", U.registered_domain(F.col("site"))).drop("site")
        own = self.t.keyed(self.t.rows_of(sites)).filter(
            (F.col("domain") != "") & (U.registered_domain(F.col("url")) == F.col("domain")))
        return own.filter(U.robots_allow(F.col("url"), F.col("disallow"))).drop(
            "domain", "disallow")

    @cached_property
    def site_pages(self) -> DataFrame:
        return self.t.with_text(self.site_rows, "listing_id", "website", "url", "lastmod")

    def found(self, wanted: DataFrame, pages: DataFrame | None = None) -> DataFrame:
        """Wanted (listing_id, pos, url) with what makes their text, null where there is no page.

        pages: the site rows to look in, all of them by default.
        """
        pages = self.site_rows.drop("website", "lastmod") if pages is None else pages
        # As many as a listing's reading budget; pages meet them by listing, as they are dealt.
        lists = dealt(wanted.groupBy("listing_id").agg(
            F.collect_list(F.struct("pos", "url")).alias("wanted")), "listing_id", "wanted",
            moved=False)
        met = pages.join(lists, "listing_id").withColumn(
            "w", F.explode(F.filter("wanted", lambda w: w["url"] == F.col("url"))))
        hits = dealt(met.select("listing_id", "w.pos", *[
            x for x in pages.columns if x != "listing_id"]), "listing_id", "found", moved=False)
        got = hits.groupBy("listing_id").agg(F.collect_set("pos").alias("got"))
        missing = lists.join(got, "listing_id", "left").select("listing_id", F.explode(F.filter(
            "wanted", lambda w: ~F.coalesce(F.array_contains("got", w["pos"]), F.lit(False)))
            ).alias("w")).select("listing_id", "w.pos", "w.url")
        return hits.unionByName(missing, allowMissingColumns=True)

    def texts(self, found: DataFrame) -> DataFrame:
        return self.t.with_text(found, "listing_id", "pos", "url")

    def read(self, wanted: DataFrame) -> DataFrame:
        """Wanted (listing_id, pos, url) with their text; only these are put together."""
        return self.texts(self.found(wanted))

    @cached_property
    def ranked(self) -> DataFrame:
        return I.rank_pages(self.site_rows, ("phone", "address", "status"), self.as_of,
                            K.RANK_LIMIT, key="listing_id")

    def gather(self, listing: DataFrame) -> DataFrame:
        """Pages read for the rule check of some listings, in order, until enough was seen."""
        listed = listing.filter(F.col("website").isNotNull()).select(
            F.col("id").alias("listing_id"), "website")
        rows = self.site_rows.join(listing.select(F.col("id").alias("listing_id")), "listing_id",
                                   "left_semi")
        # Sites are gone through once: every page leaves with its rank and what makes its text.
        page = [x for x in rows.columns if x not in ("listing_id", "website", "url", "lastmod")]
        ranked = dealt(I.rank_pages(rows, ("phone",), self.as_of, None, key="listing_id",
                                    keep=page), "listing_id", "ranked", moved=False)
        phone = ranked.filter(F.col("rank") <= K.MAX_FETCHES + 2)
        wanted = I.candidate_pages(listed, phone).filter(F.col("pos") <= K.MAX_FETCHES)
        # All candidates meet their pages at once; each position then puts its texts together.
        return I.gather_evidence(
            self.found(wanted, ranked.select("listing_id", "url", *page)), self.texts)

    @cached_property
    def gathered(self) -> DataFrame:
        return self.gather(self.d.listing)

    @cached_property
    def structural(self) -> DataFrame:
        return S.structural_findings(self.d.phone)

    def verify(self, listing: DataFrame, gathered: DataFrame) -> DataFrame:
        pages = gathered.filter("usable").select("listing_id", "pos", "url", "text")
        mine = listing.select(F.col("id").alias("listing_id"))
        phone, address, structural = (df.join(mine, "listing_id", "left_semi") for df in (
            self.d.phone, self.d.address, self.structural))
        return E.verify(listing, phone, address, pages, structural,
                        fetched=gathered.select("listing_id", "pos", "url"))

    @cached_property
    def verified(self) -> DataFrame:
        return self.verify(self.listing, self.gathered)

    @cached_property
    def results(self) -> DataFrame:
        """Triaged listings checked, with the whole corpus's structural findings merged in."""
        worth = R.triage(self.d.listing, self.as_of).select("id")
        triaged = stored(self.listing.join(worth, "id", "left_semi"), "triaged")
        checked = self.verify(triaged, self.gather(triaged))
        approved = self.listing.filter(F.col("status") == "approved")
        return E.merge_structural(checked, self.structural, approved)

    @cached_property
    def graph(self) -> G.Graph:
        return G.build(self.d).saved()

    @cached_property
    def queue(self) -> DataFrame:
        return R.prioritise(self.results, G.blast_radius(self.graph))

    @cached_property
    def confirmations(self) -> DataFrame:
        """What this run's matches confirm, field by field, as of the run."""
        matches = R.split_verdicts(self.results)["confirmed_matches"].select(
            F.col("resource_id").alias("listing_id"),
            F.transform("fields", lambda f: f["field"]).alias("fields"))
        return FR.match_confirmations(matches, F.lit(self.as_of))

    @cached_property
    def freshness(self) -> DataFrame:
        """Listing scores that count this run's own confirmations."""
        return FR.rollup(FR.field_scores(self.d, self.as_of, self.confirmations))

    @cached_property
    def claims(self) -> DataFrame:
        return C.template_claims(self.d)

    @cached_property
    def audit_rows(self) -> DataFrame:
        """Selected pages with their best capture, long enough to judge, dealt by listing."""
        listed = self.d.listing.filter(F.col("website").isNotNull()).select(
            F.col("id").alias("listing_id"), U.origin(F.col("website")).alias("origin"))
        chosen = I.select_pages(listed, C.claim_fields(self.claims), self.ranked)
        chosen = stored(chosen, "chosen")
        # Captures of the chosen pages only are compared. They carry what is chosen, so no
        # text meets another row.
        return E.audit_pages(self.t.captures(chosen), ["listing_id", "pos", "url", "lastmod"]
                             ).select("listing_id", "pos", "url", "lastmod", "text", "method")

    @cached_property
    def audit_pages(self) -> DataFrame:
        """The same written once, for jobs that read them more than once."""
        return dealt(self.audit_rows, "listing_id", "audit_pages", moved=False)

    @cached_property
    def anchors(self) -> DataFrame:
        return E.identity_anchors(self.d.phone, self.d.address)

    def audited(self, scorer=None, available: bool = True):
        rules = self._rules
        sizes = self.site_rows.groupBy("website").agg(F.count_distinct("url").alias("pages"))
        inv = (self.d.listing.select(F.col("id").alias("listing_id"), "website")
               .join(rules.select("website", F.array_contains("disallow", "/").alias("denied")),
                     "website", "left").join(sizes, "website", "left")
               .select("listing_id", F.when(F.col("denied"), "robots-denied").otherwise("sitemap")
                       .alias("method"), F.coalesce("pages", F.lit(0)).alias("pages")))
        return E.audit(self.d.listing, self.claims, inv, self.audit_pages, self.anchors,
                       scorer, available)
