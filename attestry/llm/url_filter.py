"""URL verdicts: host and path rules first, then a list of canonical URLs.

A rule `host/path` fits its host and all subdomains where the URL's path starts with the
rule's path; the longest fitting rule decides. Every other URL is blocked if its canonical
form is listed. Listed URLs are hashed into a blocked Bloom filter (a URL's bits all lie in
one block of eight 32-bit words), kept as a table with a row per block; its size follows the
list but never passes `MOST_BLOCKS` rows, so it may be broadcast whatever the list. URLs that
hit it are joined with the list itself, which removes false positives; a filter too small for
its list only lets more URLs through to that join.

A null URL, or one without `://`, has an empty host and path, no canonical form and verdict
allow. Rows may repeat; each is judged. Further columns are ignored; an empty table gives an
empty result, an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import columns_of
from attestry.session import stored

# The rules of the query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS_PER_BLOCK = 16  # 256 bits for 16 URLs
MOST_BLOCKS = 1 << 16  # 65,536 rows of eight 32-bit words: 2 MB of bits
WORDS = 8


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(
        F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without `www.`, `m.` or port, path without its last slash, query without campaign
    parameters (`utm_*`, `ref`); null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":[0-9]+$", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    kept = F.concat_ws("&", F.filter(
        F.split(query_of(url), "&"),
        lambda p: (F.length(p) > 0) & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    return F.when(F.length(host) > 0, F.concat(
        host, path, F.when(F.length(kept) > 0, F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _bit(key: Column, word: int) -> Column:
    """One bit of a 32-bit word, kept in a long: five bits of a second hash pick it."""
    at = F.shiftrightunsigned(F.xxhash64(F.lit(2), key), 5 * word).bitwiseAND(F.lit(31))
    return F.call_function("shiftleft", F.expr("1L"), at.cast("int"))


def bloom(keys: DataFrame, key: str, n_keys: int, most: int = MOST_BLOCKS
          ) -> tuple[DataFrame, int]:
    """A row (block, w0..w7) per block that holds a key, and the number of blocks."""
    blocks = 1
    while blocks < min(most, -(-n_keys // KEYS_PER_BLOCK)):
        blocks *= 2
    k = F.col(key)
    rows = keys.select(_block(k, blocks).alias("block"),
                       *[_bit(k, i).alias(f"w{i}") for i in range(WORDS)])
    return rows.groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def passing(rows: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key hits the filter. The filter has at most MOST_BLOCKS rows."""
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(F.col(key), i)) != 0)
    return rows.withColumn("block", _block(F.col(key), blocks)).join(
        F.broadcast(filter_), "block").filter(hit).select(*rows.columns)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
          most: int = MOST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed; `listed` has a column url."""
    url = F.col("url").cast("string")
    rows = columns_of(pages, "page_id", "url").select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"),
        canonical(url).alias("canonical")).withColumn(
        "rule", rule_of(F.col("host"), F.col("path"), rules))
    keys = stored(listed.select(canonical(F.col("url").cast("string")).alias("key")).filter(
        "key IS NOT NULL").distinct(), "listed")
    filter_, blocks = bloom(keys, "key", keys.count(), most)
    # Each possible hit is looked up once, however many pages share its URL.
    asked = passing(rows.filter(F.col("rule").isNull() & F.col("canonical").isNotNull()).select(
        F.col("canonical").alias("key")), "key", filter_, blocks).distinct()
    confirmed = stored(asked.join(keys, "key", "left_semi"), "confirmed")
    hit = confirmed.withColumn("hit", F.lit(True))
    open_ = F.col("rule").isNull()
    key = F.when(open_, F.col("canonical"))
    verdicts = {r: v for v, r in rules}
    by_rule = F.element_at(F.create_map(*[F.lit(x) for r in verdicts for x in (r, verdicts[r])]),
                           F.col("rule")) if verdicts else F.lit(None).cast("string")
    # Only rows that no rule decides can hit; the others never leave their task.
    decided = rows.filter(~open_).select(
        "page_id", "host", "path", "rule", by_rule.alias("verdict"), "canonical",
        F.lit(False).alias("listed"))
    undecided = rows.filter(open_).join(hit, key == F.col("key"), "left").select(
        "page_id", "host", "path", "rule",
        F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"), "canonical",
        F.coalesce("hit", F.lit(False)).alias("listed"))
    return decided.unionByName(undecided)
