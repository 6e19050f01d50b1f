"""Which stored values a listing's own pages carry.

Pages meet the stored values of their listing in arrays of bounded size. A few values are looked
for one by one; many are looked up in what a page is cut into: ten-digit windows of its digits,
windows of its digit runs as long as the listing's street or box numbers. Only hits leave;
whether a value can be decided at all depends on the value alone, so misses are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions.contact import raw_digits
from attestry.functions.text import blank_to_null, stripped
from attestry.operators.chunks import in_chunks
from attestry.session import stored

DIALLED = 10
CHUNK = 1024
FEW = 16  # as many values are cheaper to look for one by one


def windows(text: Column, size: Column | int) -> Column:
    """All substrings of a length, each once; none of a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.array_distinct(F.when(F.length(text) >= size, F.transform(
        F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))
        .otherwise(F.array().cast("array<string>")))


def run_windows(runs: Column, sizes: Column) -> Column:
    """Windows of every run in every one of some lengths."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.flatten(
        F.transform(runs, lambda r: windows(r, k))))))


def needles(claims: DataFrame) -> DataFrame:
    """Claims with what decides them: dialled, number, words; `decidable` tells if anything can."""
    s = stripped(F.col("stored"))
    head = stripped(F.element_at(F.split(s, r"[,\n]", 2), 1))
    box = blank_to_null(F.regexp_extract(head, K.BOX_RE, 1))
    number = blank_to_null(F.regexp_extract(head, r"^(\d+)\s+(.+)", 1))
    stop = F.array(*[F.lit(w) for w in K.STREET_STOP_WORDS])
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_extract(head, r"^(\d+)\s+(.+)", 2)),
                                          F.lit("([a-z]+)"), F.lit(1)),
                     lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    digits = raw_digits(F.col("stored"))
    phone, address = F.col("field") == "phone", F.col("field") == "address"
    streets = address & box.isNull() & number.isNotNull() & (F.size(words) > 0)
    return claims.select(
        "listing_id", "key", "field",
        F.when(phone & (F.length(digits) >= DIALLED), F.right(digits, F.lit(DIALLED)))
        .alias("dialled"),
        F.when(address & box.isNotNull(), box).when(streets, number).alias("number"),
        F.when(streets, F.array_distinct(words)).alias("words"),
        F.coalesce((phone & F.col("stored").isNotNull()) | (address & box.isNotNull()) | streets,
                   F.lit(False)).alias("decidable"))


def met(needle: DataFrame, pages: DataFrame) -> DataFrame:
    """(listing_id, url, shown): the stored values (key, street) each page carries.

    needle: needles(); pages: listing_id, url, text. Every page meets its listing's values, up
    to CHUNK at a time, so no text and no window leaves its row.
    """
    chunks = in_chunks(needle.filter("dialled IS NOT NULL OR number IS NOT NULL"), ["key"],
                       "key", "dialled", "number", "words", name="needles", size=CHUNK)
    low, needles_ = F.col("low"), F.col("needles")
    # Lower case has the digits of the text.
    rows = pages.select("listing_id", "url", F.lower("text").alias("low")).withColumn(
        "digits", raw_digits(F.col("low"))).join(chunks, "listing_id")

    def worded(n: Column) -> Column:
        # A street counts once per address of a page, so the page needs one.
        return n["words"].isNull() | (F.col("url").isNotNull() & F.exists(
            n["words"], lambda w: F.contains(low, w)))

    few = F.filter(needles_, lambda n: F.coalesce(
        F.contains(F.col("digits"), n["dialled"]),
        F.contains(low, n["number"]) & worded(n), F.lit(False)))
    # Many values are looked up among the windows of the page instead of one by one.
    numbers = F.array_compact(needles_["number"])
    found = F.transform(F.array(F.struct(
        F.array_intersect(windows(F.col("digits"), DIALLED), needles_["dialled"]).alias("dialled"),
        F.array_intersect(run_windows(
            F.array_distinct(F.regexp_extract_all("low", F.lit(r"(\d+)"))),
            F.array_distinct(F.transform(numbers, F.length))), numbers).alias("numbers"))),
        lambda f: F.filter(needles_, lambda n: F.coalesce(
            F.array_contains(f["dialled"], n["dialled"]),
            F.array_contains(f["numbers"], n["number"]) & worded(n), F.lit(False))))
    shown = F.when(F.size(needles_) <= FEW, few).otherwise(F.get(found, F.lit(0)))
    return rows.select("listing_id", "url", F.transform(shown, lambda n: F.struct(
        n["key"].alias("key"), n["words"].isNotNull().alias("street"))).alias("shown"))


def _copies(needle: DataFrame, pages: DataFrame) -> DataFrame:
    """(listing_id, key, url, street, n): how often a value is found on a page's address.

    A street counts once there, however often the page or the value comes.
    """
    shown = met(needle, pages).select("listing_id", "url", F.explode("shown").alias("s"))
    return shown.groupBy("listing_id", "s.key", "url", "s.street").agg(
        F.count(F.lit(1)).alias("n")).withColumn(
        "n", F.when(F.col("street"), F.lit(1).cast("bigint")).otherwise(F.col("n")))


def hits(needle: DataFrame, pages: DataFrame) -> DataFrame:
    """(listing_id, key, url) of every stored value a page carries."""
    return _copies(needle, pages).select(
        "listing_id", "key", "url", F.explode(F.array_repeat(
            F.lit(True), F.col("n").cast("int"))).alias("hit")).drop("hit")


def counts(needle: DataFrame, pages: DataFrame) -> DataFrame:
    """(listing_id, key, field, truth, n): pages that carry a value, do not, or cannot tell."""
    needle = stored(needle, "needles")
    per = pages.groupBy("listing_id").agg(F.count(F.lit(1)).alias("pages"))
    hit = _copies(needle, pages).groupBy("listing_id", "key").agg(F.sum("n").alias("hits"))
    told = needle.select("listing_id", "key", "field", "decidable").join(per, "listing_id").join(
        hit, ["listing_id", "key"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    yes, no = F.col("hits"), F.col("pages") - F.col("hits")
    parts = F.when(F.col("decidable"), F.array(
        F.struct(F.lit(True).alias("truth"), yes.alias("n")),
        F.struct(F.lit(False).alias("truth"), no.alias("n")))).otherwise(F.array(
            F.struct(F.lit(None).cast("boolean").alias("truth"), F.col("pages").alias("n"))))
    return told.select("listing_id", "key", "field", F.explode(parts).alias("p")).select(
        "listing_id", "key", "field", "p.truth", "p.n").filter("n > 0")


def truth_rows(needle: DataFrame, pages: DataFrame) -> DataFrame:
    """(listing_id, key, url, on_page) for every claim and page, the pages by their URL only."""
    hit = hits(needle, pages).withColumn("hit", F.lit(True))
    return needle.select("listing_id", "key", "decidable").join(
        pages.select("listing_id", "url"), "listing_id").join(
        hit, ["listing_id", "key", "url"], "left").select(
        "listing_id", "key", "url",
        F.when(F.col("decidable"), F.coalesce("hit", F.lit(False))).alias("on_page"))
