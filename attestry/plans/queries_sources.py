"""Landed files read back: work list, listing documents, incremental sets."""

from pyspark.sql import functions as F

from attestry import schemas as S
from attestry.plans.catalog import check_view, query
from attestry.session import scratch_path
from attestry.sources import landed as L

c = F.col
_CSV = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def landed_work_list(t) -> str:
    """The work list written as CSV with a byte-order mark before its first name."""
    path = scratch_path(t.spark, "work-list")
    named = t.work_list.select(c("service_id").alias("﻿service_id"), *S.WORK_LIST[1:])
    named.write.options(**_CSV).csv(path)
    return path


@query("s01", "Work-list CSV scan", "work_list", """
SELECT service_id, service_name, resource_id, resource_name, resource_website, service_edit_url,
  service_updated_at FROM work_list""")
def s01(t):
    read = L.read_work_list(t.spark, landed_work_list(t))
    return read.select(*[F.coalesce(x, F.lit("")).alias(x) for x in S.WORK_LIST])


check_view("work_index", "work_list", """
SELECT CAST(trim(resource_id) AS BIGINT) AS resource_id,
  arg_min(service_edit_url, row_no) FILTER (service_edit_url <> '') AS service_edit_url,
  count(*) FILTER (trim(service_name) <> '') AS n_curated
FROM work_list WHERE regexp_matches(trim(resource_id), '^[0-9]+$') GROUP BY 1""")


@query("s02", "Work-list index per resource", "work_index", """
SELECT resource_id, n_curated, service_edit_url IS NOT NULL AS has_edit,
  split_part(coalesce(service_edit_url, ''), '/', 5) AS edits FROM work_index""")
def s02(t):
    idx = L.work_list_index(t.work_list)
    url = F.coalesce("service_edit_url", F.lit(""))
    return idx.select("resource_id", "n_curated",
                      c("service_edit_url").isNotNull().alias("has_edit"),
                      F.split_part(url, F.lit("/"), F.lit(5)).alias("edits"))


@query("s07", "Work-list details carried onto listings", "listing work_index work_list", """
SELECT l.id AS listing_id, w.n_curated, w.service_edit_url, s.names FROM listing l
LEFT JOIN work_index w ON l.id = w.resource_id
LEFT JOIN (SELECT CAST(trim(resource_id) AS BIGINT) AS rid,
    string_agg(DISTINCT service_name, '|' ORDER BY service_name) AS names
  FROM work_list WHERE regexp_matches(trim(resource_id), '^[0-9]+$') AND trim(service_name) <> ''
  GROUP BY 1) s ON l.id = s.rid""")
def s07(t):
    rich = L.enrich(t.listing, L.work_list_index(t.work_list))
    names = (L.curated_services(t.work_list).select("resource_id", "service_name").distinct()
             .groupBy(c("resource_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_list("service_name")), "|").alias("names")))
    return rich.join(names, "id", "left").select(
        c("id").alias("listing_id"), "n_curated", "service_edit_url", "names")


def landed_listings(t) -> str:
    """Listing documents as JSON lines: wrapped, bare, arrays, nameless and broken ones."""
    from attestry.plans.queries_evidence import listing_documents

    path = scratch_path(t.spark, "listings")
    docs = listing_documents(t).join(
        t.orders.select(c("o_orderkey").alias("id"), "o_orderpriority"), "id")
    fields = [x for x in docs.columns if x != "o_orderpriority"]
    body = F.to_json(F.struct(*fields))
    twin = F.to_json(F.struct((c("id") + 1_000_000_000).alias("id"),
                              *[x for x in fields if x != "id"]))
    p = c("o_orderpriority")
    line = (F.when(p == "1-URGENT", F.concat(F.lit('{"resource":'), body, F.lit("}")))
            .when(p == "2-HIGH", F.concat(F.lit("["), body, F.lit(","), twin, F.lit("]")))
            .when(p == "4-NOT SPECIFIED", F.lit('{"id": 1, "name": ')).otherwise(body))
    docs.select(line.alias("value")).write.text(path)
    return path


check_view("readable", "listing orders_priority", """
SELECT l.id, l.status, l.name FROM listing l JOIN orders_priority o ON l.id = o.id
WHERE l.name IS NOT NULL AND o.p <> '4-NOT SPECIFIED'
UNION ALL SELECT l.id + 1000000000, l.status, l.name FROM listing l JOIN orders_priority o
  ON l.id = o.id WHERE l.name IS NOT NULL AND o.p = '2-HIGH'""")
check_view("orders_priority", "", "SELECT o_orderkey AS id, o_orderpriority AS p FROM orders")


@query("s03", "Listing documents: unwrapped, named, corrupt skipped", "readable phone", """
SELECT r.id AS listing_id, r.name, (SELECT count(*) FROM phone p
  WHERE p.listing_id = CASE WHEN r.id >= 1000000000 THEN r.id - 1000000000 ELSE r.id END) AS phones
FROM readable r""")
def s03(t):
    read = L.read_listing_lines(t.spark, landed_listings(t))
    return read.select(c("id").alias("listing_id"), "name",
                       F.size("phones").cast("bigint").alias("phones"))


@query("s04", "Approved listings only", "readable", """
SELECT id AS listing_id FROM readable WHERE status = 'approved'""")
def s04(t):
    read = L.read_listing_lines(t.spark, landed_listings(t))
    return read.filter(c("status") == "approved").select(c("id").alias("listing_id"))


@query("s05", "Listings from objects and arrays, split into the normal form", "readable phone", """
SELECT CASE WHEN r.id >= 1000000000 THEN 'second of an array' ELSE 'first' END AS place,
  count(DISTINCT r.id) AS listings, count(p.listing_id) AS phones
FROM readable r LEFT JOIN phone p
  ON p.listing_id = CASE WHEN r.id >= 1000000000 THEN r.id - 1000000000 ELSE r.id END
GROUP BY 1""")
def s05(t):
    from attestry.operators.directory import from_documents
    from attestry.session import stored

    d = from_documents(stored(L.read_listing_lines(t.spark, landed_listings(t)), "documents"))

    def place(x):
        return F.when(c(x) >= 1_000_000_000, "second of an array").otherwise("first").alias(
            "place")

    a = d.listing.groupBy(place("id")).agg(F.count(F.lit(1)).alias("listings"))
    b = d.phone.groupBy(place("listing_id")).agg(F.count(F.lit(1)).alias("phones"))
    return a.join(b, "place")


@query("s06", "Ids of the work list that have not landed", "work_index listing", """
SELECT resource_id FROM work_index WHERE resource_id NOT IN (
  SELECT id FROM listing WHERE status = 'approved')""")
def s06(t):
    landed = t.listing.filter(c("status") == "approved")
    return L.missing_ids(L.work_list_index(t.work_list), landed)


@query("s08", "Corpus size", "listing service", """
SELECT (SELECT count(*) FROM listing) AS resources,
  (SELECT count(DISTINCT service_id) FROM service) AS services""")
def s08(t):
    return L.corpus_size(t.listing, t.service)
