"""Entity graph: organisations, services, categories, phones and addresses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry import constants as K
from attestry.functions.contact import address_key, phone_key
from attestry.operators.directory import Directory
from attestry.session import cut_lineage, stored

SHARED = ("located_at", "reachable_at")
# Keys in more key sets than this are counted by bitmaps instead of pairs.
LIGHT_SETS = 64
# Sets of at most this many keys are counted by the subsets of their keys.
FEW_KEYS = 5
HALF_BUCKET = 1 << 14  # a bitmap has 32,768 bits


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame   # id, kind, name, value
    edges: DataFrame   # src, dst, rel - directed from the owner to the owned

    def saved(self) -> Graph:
        """Both tables written once to the shared folder; every later pass scans them."""
        return Graph(stored(self.nodes, "nodes"), stored(self.edges, "edges"))

    def contacts(self) -> Graph:
        """Organisations and their shared keys only, written once."""
        return Graph(stored(self.nodes.filter(F.col("kind") == "org"), "orgs"),
                     stored(self.edges.filter(F.col("rel").isin(*SHARED)), "contacts"))


def node_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), key.cast("string"))


def kind_of(nid: Column) -> Column:
    prefix = F.substring_index(nid, ":", 1)
    return (F.when(prefix == "org", "org").when(prefix == "svc", "service")
            .when(prefix == "cat", "category").when(prefix == "tel", "phone")
            .when(prefix == "addr", "address"))


def contact_edges(d: Directory) -> DataFrame:
    """Organisation to shared-key edges; listings without a usable key add none."""
    org = node_id("org", F.col("listing_id"))
    tel = phone_key(F.col("number"))
    adr = address_key(F.col("address_1"), F.col("city"), F.col("postal_code"))

    def held(rows: DataFrame, key: Column, rel: str) -> DataFrame:
        # Exploding works a key out once and drops rows without one.
        return rows.select(org.alias("src"), F.explode(F.array_compact(F.array(key))).alias("dst"),
                           F.lit(rel).alias("rel"))

    return held(d.phone, node_id("tel", tel), "reachable_at").unionByName(
        held(d.address, node_id("addr", adr), "located_at"))


def build(d: Directory) -> Graph:
    """Nodes and distinct typed edges; the first listing to name a node gives its attributes."""
    org = node_id("org", F.col("listing_id"))
    svc = node_id("svc", F.col("service_id"))
    cat = node_id("cat", F.col("category_id"))
    used = d.service.groupBy("service_id").agg(F.min("listing_id").alias("listing_id"))
    in_use = d.service_category.join(used, "service_id")
    contacts = contact_edges(d)
    edges = reduce(DataFrame.unionByName, [
        d.service.select(org.alias("src"), svc.alias("dst"), F.lit("offers").alias("rel")),
        in_use.select(svc.alias("src"), cat.alias("dst"), F.lit("in_category").alias("rel")),
        d.listing_category.select(org.alias("src"), cat.alias("dst"),
                                  F.lit("in_category").alias("rel")),
        contacts,
    ]).distinct()

    none = F.lit(None).cast("string")
    orgs = d.listing.select(node_id("org", F.col("id")).alias("id"), F.lit("org").alias("kind"),
                            F.col("name").alias("name"), none.alias("value"))
    services = d.service.groupBy(svc.alias("id")).agg(
        F.min_by("name", "listing_id").alias("name")).select(
        "id", F.lit("service").alias("kind"), "name", none.alias("value"))
    categories = (
        in_use.select(cat.alias("id"), "name", "listing_id", F.lit(1).alias("k"))
        .unionByName(d.listing_category.select(cat.alias("id"), "name", "listing_id",
                                               F.lit(0).alias("k")))
        .groupBy("id").agg(F.min_by("name", F.struct("listing_id", "k", "name")).alias("name"))
        .select("id", F.lit("category").alias("kind"), "name", none.alias("value")))
    keys = contacts.select("dst").distinct().select(
        F.col("dst").alias("id"), kind_of(F.col("dst")).alias("kind"), none.alias("name"),
        F.expr("substring(dst, instr(dst, ':') + 1)").alias("value"))
    nodes = reduce(DataFrame.unionByName, [orgs, services, categories, keys])
    return Graph(nodes, edges)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel"))


def neighbours(g: Graph, kind: str | None = None, rel: str | None = None) -> DataFrame:
    """(id, neighbour, kind, rel) over the symmetric view."""
    e = both_ways(g.edges).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"),
                                  kind_of(F.col("dst")).alias("kind"), "rel")
    if rel:
        e = e.filter(F.col("rel") == rel)
    return e.filter(F.col("kind") == kind) if kind else e


def contradictions(g: Graph) -> DataFrame:
    """Phones and addresses held by several organisations under more than one name.

    More than one name means the least and greatest differ, or some but not all
    are missing (a missing name counts as a value); both are partial aggregates.
    """
    org = g.nodes.filter(F.col("kind") == "org").select(F.col("id").alias("src"), "name")
    held = g.edges.filter(F.col("rel").isin(*SHARED)).join(org, "src")
    n, named = F.count(F.lit(1)), F.count("name")
    return (
        held.groupBy("dst").agg(
            n.alias("n_orgs"),
            ((F.min("name") != F.max("name")) | ((named > 0) & (named < n))).alias("differ"))
        .filter((F.col("n_orgs") > 1) & F.col("differ"))
        .select(F.expr("substring(dst, instr(dst, ':') + 1)").alias("shared"),
                kind_of(F.col("dst")).alias("kind"), "n_orgs", F.col("dst").alias("key_id"))
    )


def top_contradictions(g: Graph, limit: int = K.CONTRADICTION_LIMIT) -> DataFrame:
    return contradictions(g).orderBy(F.desc("n_orgs"), "shared").limit(limit)


def members(g: Graph, keys: DataFrame) -> DataFrame:
    """Organisations behind each key, one row each; keys is a short published list."""
    org = g.nodes.filter(F.col("kind") == "org").select(F.col("id").alias("src"), "name")
    return (g.edges.filter(F.col("rel").isin(*SHARED))
            .join(keys.select(F.col("key_id").alias("dst"), "shared", "kind"), "dst")
            .join(org, "src")
            .select("shared", "kind", F.col("src").alias("org_id"), "name"))


def _hot_unions(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """(set_id, total): counted organisations that hold at least one of an asked set's hot keys.

    `asked` is (set_id, hot), `counted` (n, hot): hot keys and number of organisations of each
    key set. Sets with the same hot keys are one combination. The total of a single key is its
    count. For the others, combinations get places in buckets of bits, and each key a bitmap of
    its combinations per bucket and binary digit of their counts; the union of the bitmaps of
    a set's keys, counted and weighed by the digit, is its number of organisations.
    """
    combos = stored(counted.groupBy("hot").agg(F.sum("n").alias("n")), "hot-sets")
    held = combos.select("n", F.explode("hot").alias("key"))
    single = held.groupBy("key").agg(F.sum("n").alias("total"))
    blocks = max(1, -(-combos.count() // HALF_BUCKET))
    spot = combos.withColumn("block", F.pmod(F.xxhash64("hot"), F.lit(blocks)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("hot")) - 1
    # A block of twice its mean goes on in a bucket of its own.
    placed = spot.withColumn("place", place).select(
        "hot", "n", F.struct("block", F.floor(F.col("place") / (2 * HALF_BUCKET)).alias("part"))
        .alias("bucket"), (F.col("place") % (2 * HALF_BUCKET)).cast("bigint").alias("bit"))
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)),
                      lambda d: F.call_function("shiftright", F.col("n"), d) % 2 == 1)
    maps = stored(placed.select("bucket", "bit", F.explode("hot").alias("key"), digits.alias("d"))
                  .select("bucket", "bit", "key", F.explode("d").alias("digit"))
                  .groupBy("key", "bucket", "digit").agg(
        F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits")), "hot-maps")
    questions = stored(asked.select("hot").distinct().withColumn(
        "combo", F.monotonically_increasing_id()), "hot-asked")
    united = questions.filter(F.size("hot") > 1).select("combo", F.explode("hot").alias("key")).join(
        maps, "key").groupBy("combo", "bucket", "digit").agg(
        F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
    weight = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("digit"))
    totals = united.groupBy("combo").agg(
        F.sum(F.call_function("bitmap_count", F.col("bits")) * weight).alias("total"))
    several = questions.join(totals, "combo").select("hot", "total")
    alone = questions.filter(F.size("hot") == 1).select("hot", F.col("hot")[0].alias("key")).join(
        single, "key").select("hot", "total")
    return asked.join(several.unionByName(alone), "hot").select("set_id", "total")


def _holders(asked: DataFrame, counted: DataFrame, light: int) -> DataFrame:
    """(set_id, total): counted organisations that share a key with each asked key set.

    `asked` is (set_id, key), `counted` (set_id, n, key), a row per key of a set. A key in at
    most `light` counted sets lists the pairs of its sets. A hot key, such as a switchboard
    shared by a third of the directory, lists none: how many organisations hold any of a
    set's hot keys is the size of a union of bitmaps, hot keys with the same holders being
    one. Pairs that also share a hot key are left to that count.
    """
    # Two hashes of its sets tell which keys have the same holders.
    width = stored(counted.groupBy("key").agg(
        F.count(F.lit(1)).alias("sets"), F.bit_xor(F.xxhash64("set_id")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("h2")), "key-width")
    hot_keys = width.filter(F.col("sets") > light)
    alike = hot_keys.groupBy("sets", "h1", "h2").agg(F.min("key").alias("hot_key"))
    named = stored(hot_keys.join(alike, ["sets", "h1", "h2"]).select("key", "hot_key"), "hot-names")

    def hot(rows: DataFrame, *columns: str) -> DataFrame:
        return stored(rows.join(named, "key").groupBy(*columns).agg(
            F.array_sort(F.collect_set("hot_key")).alias("hot")), "hot-keys")

    mine, theirs = hot(asked, "set_id"), hot(counted, "set_id", "n")
    few = width.filter(F.col("sets") <= light).select("key")
    other = counted.join(few, "key", "left_semi").select(
        F.col("set_id").alias("other"), F.col("n").alias("m"), "key")
    pairs = asked.join(other, "key").select("set_id", "other", "m").distinct()
    their_hot = theirs.select(F.col("set_id").alias("other"), F.col("hot").alias("their_hot"))
    apart = ~F.coalesce(F.arrays_overlap("hot", "their_hot"), F.lit(False))
    by_pairs = (pairs.join(mine, "set_id", "left").join(their_hot, "other", "left").filter(apart)
                .select("set_id", F.col("m").alias("total")))
    return by_pairs.unionByName(_hot_unions(mine, theirs.select("n", "hot"))).groupBy(
        "set_id").agg(F.sum("total").alias("total"))


def sibling_counts(g: Graph, light: int = LIGHT_SETS, few: int = FEW_KEYS) -> DataFrame:
    """How many other organisations share a phone or address with each one, exactly.

    Organisations with the same shared keys are one key set and are counted once. Among sets
    of at most `few` keys no pair is listed: the organisations that hold each subset of a
    set's keys are counted, those of an odd number of keys added and of an even number taken
    off. Only what a set of more keys asks or answers goes by _holders().
    """
    held = g.edges.filter(F.col("rel").isin(*SHARED)).select("src", "dst").distinct()
    keys = stored(held.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "dst", F.monotonically_increasing_id().alias("key")), "shared-keys")
    own = stored(held.join(keys, "dst").groupBy("src").agg(
        F.array_sort(F.collect_list("key")).alias("keys")), "key-sets")
    sets = stored(own.groupBy("keys").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "set_id", F.monotonically_increasing_id()), "sets")
    narrow, wide = sets.filter(F.size("keys") <= few), sets.filter(F.size("keys") > few)

    one, both = F.array(F.col("keys")[0]), F.col("keys")
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("keys")) - 1)
    subsets = (F.when(F.size("keys") == 1, F.array(both))
               .when(F.size("keys") == 2, F.array(one, F.array(F.col("keys")[1]), both))
               .otherwise(F.transform(masks, lambda m: F.filter(
                   "keys", lambda k, i: F.call_function("shiftright", m, i) % 2 == 1))))
    parts = narrow.select("keys", "n", F.explode(subsets).alias("part"))
    held_by = parts.groupBy("part").agg(F.sum("n").alias("holders"))
    signed = F.when(F.size("part") % 2 == 1, F.col("holders")).otherwise(-F.col("holders"))
    per_set = parts.select("keys", "part").join(held_by, "part").groupBy("keys").agg(
        F.sum(signed).alias("total"))
    if not wide.isEmpty():
        def rows(some: DataFrame) -> DataFrame:
            return some.select("set_id", "n", F.explode("keys").alias("key"))

        more = _holders(rows(narrow).drop("n"), rows(wide), light).unionByName(
            _holders(rows(wide).drop("n"), rows(sets), light))
        per_set = per_set.unionByName(sets.join(more, "set_id").select("keys", "total")).groupBy(
            "keys").agg(F.sum("total").alias("total"))
    return own.join(per_set, "keys").select(
        F.col("src").alias("org_id"), (F.col("total") - 1).alias("n_siblings"))


def blast_radius(g: Graph) -> DataFrame:
    """Services beneath each organisation plus the organisations sharing its contacts."""
    services = (g.edges.filter(F.col("rel") == "offers").groupBy(F.col("src").alias("org_id"))
                .agg(F.count(F.lit(1)).alias("n_services")))
    orgs = g.nodes.filter(F.col("kind") == "org").select(F.col("id").alias("org_id"))
    zero = F.lit(0).cast("bigint")
    return (orgs.join(services, "org_id", "left").join(sibling_counts(g), "org_id", "left")
            .select("org_id", F.coalesce("n_services", zero).alias("n_services"),
                    F.coalesce("n_siblings", zero).alias("n_siblings"))
            .withColumn("size", F.col("n_services") + F.col("n_siblings")))


def blast_members(g: Graph, focus: DataFrame) -> DataFrame:
    """The nodes inside the radius of a short list of organisations: (focus, id)."""
    start = focus.select(F.col("id").alias("src")).distinct()
    own = g.edges.join(start, "src", "left_semi")
    services = own.filter(F.col("rel") == "offers").select(
        F.col("src").alias("focus"), F.col("dst").alias("id"))
    siblings = (own.filter(F.col("rel").isin(*SHARED)).select(F.col("src").alias("focus"), "dst")
                .join(g.edges.filter(F.col("rel").isin(*SHARED)).select("src", "dst"), "dst")
                .filter(F.col("src") != F.col("focus")).select("focus", F.col("src").alias("id")))
    return services.unionByName(siblings).distinct()


def carriers(g: Graph) -> DataFrame:
    """(src, dst): edges that can carry doubt, into an organisation or a service."""
    return both_ways(g.edges).filter(kind_of(F.col("dst")).isin("org", "service")).select(
        "src", "dst")


def propagate(g: Graph, seeds: DataFrame, hops: int = 2, decay: float = 0.5,
              step: DataFrame | None = None) -> DataFrame:
    """Doubt reaching each organisation or service within a number of hops.

    Walk semantics: a seed is reached again at two hops. Each hop works on the
    distinct frontier, so its cost is the edges leaving it. step: carriers(g), where a caller
    has them dealt by source already.
    """
    step = carriers(g) if step is None else step
    frontier = seeds.select("id").distinct()
    reached = None
    for hop in range(1, hops + 1):
        frontier = stored(step.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi")
                          .select(F.col("dst").alias("id")).distinct(), "frontier")
        layer = frontier.withColumn("dist", F.lit(hop))
        reached = layer if reached is None else reached.unionByName(layer)
    return reached.groupBy("id").agg(F.min("dist").alias("dist")).withColumn(
        "score", F.pow(F.lit(decay), F.col("dist")))


def propagate_incremental(g: Graph, seeds: DataFrame, hops: int = 2, decay: float = 0.5,
                          step: DataFrame | None = None) -> DataFrame:
    """The same answer by relaxing distances, kept as a cross-check of propagate()."""
    step = carriers(g) if step is None else step
    walk = seeds.select("id").distinct().withColumn("dist", F.lit(0))
    best = None
    for _ in range(hops):
        walk = stored(step.join(walk.withColumnRenamed("id", "src"), "src")
                      .groupBy(F.col("dst").alias("id")).agg((F.min("dist") + 1).alias("dist")),
                      "walk")
        best = walk if best is None else (
            best.unionByName(walk).groupBy("id").agg(F.min("dist").alias("dist")))
    return best.withColumn("score", F.pow(F.lit(decay), F.col("dist")))


def node_label(limit: int = K.LABEL_CHARS) -> Column:
    full = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("value"), F.lit("")),
                      F.col("id"))
    return F.when(F.length(full) > limit, F.concat(F.left(full, F.lit(limit - 1)), F.lit("…"))
                  ).otherwise(full)


@dataclass(frozen=True)
class Subgraph:
    nodes: DataFrame      # pos, id, kind, label
    edges: DataFrame      # source, target, rel
    truncated: DataFrame  # one row: truncated


def near_nodes(g: Graph, focus: DataFrame, hops: int = 2, cap: int = K.SUBGRAPH_CAP) -> DataFrame:
    """(id, dist) of at most cap + 1 nearest nodes, in (dist, id) order.

    A node beyond the first cap + 1 can neither be kept nor change the
    truncated flag, so each hop keeps a bounded, ordered prefix and the walk
    stops once it is full. The frontier therefore never exceeds cap + 1 rows
    and the edge table is scanned, never shuffled.
    """
    sym = both_ways(g.edges)
    found = cut_lineage(
        focus.select("id").distinct().join(g.nodes.select("id"), "id", "left_semi")
        .select("id", F.lit(0).alias("dist")).orderBy("id").limit(cap + 1))
    for hop in range(1, hops + 1):
        room = cap + 1 - found.count()
        if room <= 0:
            break
        front = found.filter(F.col("dist") == hop - 1).select(F.col("id").alias("src"))
        fresh = (sym.join(F.broadcast(front), "src", "left_semi")
                 .select(F.col("dst").alias("id"))
                 .join(F.broadcast(found.select("id")), "id", "left_anti").distinct()
                 .withColumn("dist", F.lit(hop)).orderBy("id").limit(room))
        found = cut_lineage(found.unionByName(fresh))
    return found


def subgraph(g: Graph, focus: DataFrame, hops: int = 2, cap: int = K.SUBGRAPH_CAP,
             pinned: DataFrame | None = None) -> Subgraph:
    """Neighbourhood of the focus nodes, pinned nodes first, nearest next, capped."""
    near = near_nodes(g, focus, hops, cap).select(
        "id", F.lit(1).alias("tier"), F.lit(0).cast("bigint").alias("pin"), "dist")
    order = near
    if pinned is not None:
        pins = (pinned.groupBy("id").agg(F.min("pos").cast("bigint").alias("pin"))
                .join(g.nodes.select("id"), "id", "left_semi")
                .select("id", F.lit(0).alias("tier"), "pin", F.lit(0).alias("dist"))
                .orderBy("pin").limit(cap + 1))
        order = pins.unionByName(near)
    # At most 2 * (cap + 1) rows reach this window.
    firsts = order.groupBy("id").agg(F.min(F.struct("tier", "pin", "dist", "id")).alias("o"))
    ranked = cut_lineage(firsts.select(
        "id", F.row_number().over(Window.orderBy("o")).alias("pos")).filter(
        F.col("pos") <= cap + 1))
    kept = ranked.filter(F.col("pos") <= cap)
    nodes = (g.nodes.join(F.broadcast(kept), "id")
             .select("pos", "id", "kind", node_label().alias("label")))
    ids = F.broadcast(kept.select("id"))
    edges = (g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
             .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
             .select(F.col("src").alias("source"), F.col("dst").alias("target"), "rel"))
    truncated = ranked.agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return Subgraph(nodes, edges, truncated)


def flag_suspects(nodes: DataFrame, doubted: DataFrame, blast: DataFrame) -> DataFrame:
    """Nodes with suspect = reached by doubt or inside a blast radius."""
    suspects = (doubted.select("id").unionByName(blast.select("id")).distinct()
                .withColumn("suspect", F.lit(True)))
    return nodes.join(suspects, "id", "left").withColumn(
        "suspect", F.coalesce("suspect", F.lit(False)))
