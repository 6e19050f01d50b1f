"""Entity graph: nodes, shared contacts, blast radius, spreading doubt, subgraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import constants as K
from attestry.operators import entity_graph as G
from attestry.operators import structural as ST
from attestry.plans.catalog import check_view, query
from attestry.plans.queries_columns import sql_addr_key, sql_phone_key
from attestry.session import dealt

c = F.col
HOPS = 3

check_view("contact_edge", "phone address", f"""
SELECT DISTINCT src, dst, rel FROM (
SELECT 'org:' || listing_id AS src, 'tel:' || {sql_phone_key('number')} AS dst,
  'reachable_at' AS rel FROM phone
UNION ALL
SELECT 'org:' || listing_id, 'addr:' || {sql_addr_key()}, 'located_at' FROM address)
WHERE dst IS NOT NULL""")
check_view("edge", "contact_edge service service_category listing_category", """
SELECT DISTINCT 'org:' || listing_id AS src, 'svc:' || service_id AS dst, 'offers' AS rel
FROM service
UNION ALL SELECT DISTINCT 'svc:' || service_id, 'cat:' || category_id, 'in_category'
FROM service_category WHERE service_id IN (SELECT service_id FROM service)
UNION ALL SELECT DISTINCT 'org:' || listing_id, 'cat:' || category_id, 'in_category'
FROM listing_category
UNION ALL SELECT src, dst, rel FROM contact_edge""")
check_view("node", "listing service service_category listing_category contact_edge", """
SELECT 'org:' || id AS id, 'org' AS kind, name, NULL AS value FROM listing
UNION ALL SELECT DISTINCT 'svc:' || service_id, 'service', name, NULL FROM service
UNION ALL SELECT DISTINCT 'cat:' || category_id, 'category', name, NULL FROM service_category
  WHERE service_id IN (SELECT service_id FROM service)
UNION ALL SELECT DISTINCT 'cat:' || category_id, 'category', name, NULL FROM listing_category
UNION ALL SELECT DISTINCT dst, CASE rel WHEN 'located_at' THEN 'address' ELSE 'phone' END, NULL,
  substr(dst, instr(dst, ':') + 1) FROM contact_edge""")
check_view("sym", "edge", """
SELECT src, dst, rel FROM edge UNION ALL SELECT dst, src, rel FROM edge""")


def graph(t):
    return G.build(t.directory)


@query("g01", "Nodes and their first attributes", "node",
       "SELECT id, kind, name, value FROM node")
def g01(t):
    return graph(t).nodes


_KIND = """CASE split_part(dst, ':', 1) WHEN 'org' THEN 'org' WHEN 'svc' THEN 'service'
  WHEN 'cat' THEN 'category' WHEN 'tel' THEN 'phone' ELSE 'address' END"""


@query("g02", "Neighbours of every node by kind and relation", "sym", f"""
SELECT src AS id, {_KIND} AS kind, rel, count(*) AS n FROM sym GROUP BY ALL""")
def g02(t):
    return G.neighbours(graph(t)).groupBy("id", "kind", "rel").agg(F.count(F.lit(1)).alias("n"))


check_view("contradiction", "contact_edge listing", """
SELECT substr(dst, instr(dst, ':') + 1) AS shared,
  CASE rel WHEN 'located_at' THEN 'address' ELSE 'phone' END AS kind, count(*) AS n_orgs,
  dst AS key_id
FROM contact_edge e JOIN listing l ON e.src = 'org:' || l.id GROUP BY dst, rel
HAVING count(*) > 1 AND count(DISTINCT coalesce('n' || name, '')) > 1""")


@query("a04", "Phones and addresses under several names", "contradiction",
       "SELECT shared, kind, n_orgs FROM contradiction")
def a04(t):
    return G.contradictions(graph(t)).drop("key_id")


check_view("top_contradiction", "contradiction",
           "SELECT * FROM contradiction ORDER BY n_orgs DESC, shared LIMIT 15")


@query("w09", "Top contradictions with their members", "top_contradiction contact_edge listing", """
SELECT t.shared, t.kind, e.src AS org_id, l.name FROM top_contradiction t
JOIN contact_edge e ON e.dst = t.key_id JOIN listing l ON e.src = 'org:' || l.id""")
def w09(t):
    g = graph(t).contacts()
    return G.members(g, G.top_contradictions(g))


check_view("siblings", "contact_edge", """
SELECT a.src AS org_id, count(DISTINCT b.src) AS n_siblings
FROM contact_edge a JOIN contact_edge b ON a.dst = b.dst AND a.rel = b.rel AND a.src <> b.src
GROUP BY a.src""")


@query("j12", "Organisations sharing a contact, counted per organisation", "siblings",
       "SELECT org_id, n_siblings FROM siblings")
def j12(t):
    return G.sibling_counts(graph(t).saved()).filter("n_siblings > 0")


check_view("radius", "listing service siblings", """
SELECT 'org:' || l.id AS org_id, coalesce(s.n, 0) AS n_services, coalesce(b.n_siblings, 0)
  AS n_siblings, coalesce(s.n, 0) + coalesce(b.n_siblings, 0) AS size
FROM listing l LEFT JOIN (SELECT listing_id, count(DISTINCT service_id) AS n FROM service
  GROUP BY 1) s ON s.listing_id = l.id LEFT JOIN siblings b ON b.org_id = 'org:' || l.id""")


@query("g03", "Blast radius of every organisation", "radius",
       "SELECT org_id, n_services, n_siblings, size FROM radius")
def g03(t):
    return G.blast_radius(graph(t).saved())


def seeds(t):
    """Organisations with a run-together number."""
    return ST.phone_issues(t.phone).filter(c("kind") == "run_together").select(
        G.node_id("org", c("listing_id")).alias("id")).distinct()


check_view("seed", "issue",
           "SELECT DISTINCT 'org:' || listing_id AS id FROM issue WHERE kind = 'run_together'")
check_view("spread", "sym", """
SELECT src, dst FROM sym WHERE split_part(dst, ':', 1) IN ('org', 'svc')""")
check_view("hop1", "seed spread",
           "SELECT DISTINCT dst AS id FROM spread WHERE src IN (SELECT id FROM seed)")
check_view("hop2", "hop1 spread",
           "SELECT DISTINCT dst AS id FROM spread WHERE src IN (SELECT id FROM hop1)")
check_view("hop3", "hop2 spread",
           "SELECT DISTINCT dst AS id FROM spread WHERE src IN (SELECT id FROM hop2)")
check_view("doubt", "hop1 hop2 hop3", """
SELECT id, min(d) AS dist FROM (SELECT id, 1 AS d FROM hop1 UNION ALL SELECT id, 2 FROM hop2
UNION ALL SELECT id, 3 FROM hop3) GROUP BY id""")


@query("g04", "Doubt within three hops", "doubt",
       "SELECT id, dist, pow(0.5, dist) AS score FROM doubt")
def g04(t):
    return G.propagate(graph(t).saved(), seeds(t), hops=HOPS)


@query("u02", "Two formulations of doubt agree row for row", "doubt", """
SELECT count(*) AS nodes, 0 AS only_first, 0 AS only_second FROM doubt""")
def u02(t):
    g, s = graph(t), seeds(t)
    # Both walk the same edges, which are dealt by their source once for all hops.
    step = dealt(G.carriers(g), "src", "carriers")
    a = G.propagate(g, s, hops=HOPS, step=step)
    b = G.propagate_incremental(g, s, hops=HOPS, step=step)
    one = F.count(F.lit(1))
    return (a.agg(one.alias("nodes"))
            .join(a.exceptAll(b).agg(one.alias("only_first")))
            .join(b.exceptAll(a).agg(one.alias("only_second"))))


def focus(g):
    """The three organisations with the widest radius."""
    return G.blast_radius(g).orderBy(F.desc("size"), "org_id").limit(3).select(
        c("org_id").alias("id"))


def pinned(g):
    """Members of the top contradictions, in published order."""
    top = G.top_contradictions(g)
    return G.members(g, top).join(F.broadcast(top.select("shared", "kind", "n_orgs")),
                                  ["shared", "kind"]).select(
        c("org_id").alias("id"),
        (F.lit(1_000_000) - c("n_orgs")).alias("a"), c("shared").alias("b")).groupBy("id").agg(
        F.min(F.struct("a", "b", "id")).alias("o"))


check_view("focus", "radius",
           "SELECT org_id AS id FROM radius ORDER BY size DESC, org_id LIMIT 3")
check_view("near", "focus sym", """
SELECT id, min(d) AS dist FROM (
SELECT id, 0 AS d FROM focus
UNION ALL SELECT dst, 1 FROM sym WHERE src IN (SELECT id FROM focus)
UNION ALL SELECT dst, 2 FROM sym WHERE src IN (
  SELECT dst FROM sym WHERE src IN (SELECT id FROM focus))) GROUP BY id""")
check_view("kept", "near", f"""
SELECT id, row_number() OVER (ORDER BY dist, id) AS pos FROM near
QUALIFY pos <= {K.SUBGRAPH_CAP}""")
_LABEL = f"""CASE WHEN length(coalesce(nullif(name, ''), value, n.id)) > {K.LABEL_CHARS}
  THEN left(coalesce(nullif(name, ''), value, n.id), {K.LABEL_CHARS - 1}) || '…'
  ELSE coalesce(nullif(name, ''), value, n.id) END"""


@query("g05", "Two-hop neighbourhood, capped", "kept node near", f"""
SELECT k.pos, n.id, n.kind, {_LABEL} AS label,
  (SELECT count(*) FROM near) > {K.SUBGRAPH_CAP} AS truncated
FROM kept k JOIN node n ON k.id = n.id""")
def g05(t):
    g = graph(t).saved()
    s = G.subgraph(g, focus(g))
    return s.nodes.join(F.broadcast(s.truncated))


@query("j14", "Edges with both ends kept", "kept edge", """
SELECT e.src AS source, e.dst AS target, e.rel FROM edge e
JOIN kept a ON e.src = a.id JOIN kept b ON e.dst = b.id""")
def j14(t):
    g = graph(t).saved()
    return G.subgraph(g, focus(g)).edges


check_view("pin", "top_contradiction contact_edge", """
SELECT src AS id, row_number() OVER (ORDER BY min(1000000 - n_orgs), arg_min(shared, (1000000
  - n_orgs, shared)), src) AS pos
FROM (SELECT e.src, t.n_orgs, t.shared FROM top_contradiction t JOIN contact_edge e
  ON e.dst = t.key_id) GROUP BY src""")
check_view("ordered", "pin near", """
SELECT id, tier, pin, dist FROM (
  SELECT id, 0 AS tier, pos AS pin, 0 AS dist FROM pin
  UNION ALL SELECT id, 1, 0, dist FROM near WHERE id NOT IN (SELECT id FROM pin))""")


def _pins_with_pos(g, cap=K.SUBGRAPH_CAP):
    from pyspark.sql.window import Window

    # A pin beyond cap + 1 can neither be kept nor change the truncated flag.
    return pinned(g).orderBy("o").limit(cap + 1).select("id", F.row_number().over(Window.orderBy("o")).alias("pos"))


@query("w11", "Node cap with pinned nodes first", "ordered", f"""
SELECT id, row_number() OVER (ORDER BY tier, pin, dist, id) AS pos FROM ordered
QUALIFY pos <= {K.SUBGRAPH_CAP}""")
def w11(t):
    g = graph(t).saved()
    return G.subgraph(g, focus(g), pinned=_pins_with_pos(g)).nodes.select("id", "pos")


@query("u03", "Ordered distinct union of pinned and near nodes", "ordered", """
SELECT id, row_number() OVER (ORDER BY tier, pin, dist, id) AS pos FROM ordered
QUALIFY pos <= 5000""")
def u03(t):
    g = graph(t).saved()
    return G.subgraph(g, focus(g), cap=5000, pinned=_pins_with_pos(g, 5000)).nodes.select(
        "id", "pos")


check_view("blast_member", "focus edge contact_edge", """
SELECT DISTINCT src AS focus, dst AS id FROM edge WHERE rel = 'offers'
  AND src IN (SELECT id FROM focus)
UNION
SELECT a.src, b.src FROM contact_edge a JOIN contact_edge b ON a.dst = b.dst AND a.src <> b.src
WHERE a.src IN (SELECT id FROM focus)""")


@query("u04", "Suspect nodes: reached by doubt or inside a radius", "node doubt blast_member", """
SELECT id, kind, id IN (SELECT id FROM doubt) OR id IN (SELECT id FROM blast_member) AS suspect
FROM node""")
def u04(t):
    g = graph(t).saved()
    return G.flag_suspects(g.nodes.select("id", "kind"), G.propagate(g, seeds(t), hops=HOPS),
                           G.blast_members(g, focus(g)))


@query("s13", "Graph document: nodes, edges, radius members and contradictions written and read",
       "kept node edge blast_member top_contradiction", """
SELECT 'blast' AS part, count(*) AS n FROM blast_member
UNION ALL SELECT 'contradictions', count(*) FROM top_contradiction
UNION ALL SELECT 'edges', count(*) FROM edge WHERE src IN (SELECT id FROM kept)
  AND dst IN (SELECT id FROM kept)
UNION ALL SELECT 'nodes', count(*) FROM kept""")
def s13(t):
    from attestry.session import scratch_path
    from attestry.sources.stores import write_tables

    g = graph(t).saved()
    sub = G.subgraph(g, focus(g))
    paths = write_tables({"nodes": sub.nodes, "edges": sub.edges,
                          "blast": G.blast_members(g, focus(g)),
                          "contradictions": G.top_contradictions(g)},
                         scratch_path(t.spark, "graph"), "json")
    parts = [t.spark.read.json(p).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(n).alias("part"), "n") for n, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
