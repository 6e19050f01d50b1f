"""URL parts, site keys, links, robots and sitemap bodies as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import constants as K
from attestry.functions.text import all_matches, blank_to_null, first_match, stripped

# A host after an optional scheme; text with a later // has no host of its own.
_HOST = (r"^\s*(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//|(?!.*//))"
         r"(?:[^/?#]*@)?([^/?#:\s]*)")
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def hostname(url: Column) -> Column:
    """Lower-case host without user info or port; '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def url_path(url: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(url, _PATH, 1)), F.lit("/"))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, _ORIGIN, 1)


def registered_domain(url: Column) -> Column:
    """Last two host labels; '' when there is no host."""
    return F.substring_index(F.btrim(hostname(url), F.lit(".")), ".", -2)


def same_site(url: Column, website: Column) -> Column:
    allowed = registered_domain(website)
    return (allowed != "") & (registered_domain(url) == allowed)


def display_host(url: Column) -> Column:
    """Host for display, a leading www. removed."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def unwrap_cdata(c: Column) -> Column:
    s = F.coalesce(c, F.lit(""))
    inner = F.regexp_extract(s, K.CDATA_RE, 1)
    return stripped(F.when(s.rlike(K.CDATA_RE), inner).otherwise(s))


def day_of(c: Column) -> Column:
    """First YYYY-MM-DD in the text, or NULL."""
    return first_match(c, K.DATE_RE, 1)


def slug_words(path: Column) -> Column:
    return F.array_remove(F.split(F.lower(path), K.SLUG_SPLIT_RE), "")


def join_urls(base: Column, hrefs: Column, drop_fragment: bool = False) -> Column:
    """Resolve an array of hrefs against a base; Spark has no RFC 3986 resolver."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def resolve(bases: pd.Series, links: pd.Series) -> pd.Series:
        from urllib.parse import urldefrag, urljoin

        def one(b, href):
            try:
                u = urljoin(b, href)
                return urldefrag(u).url if drop_fragment else u
            except ValueError:
                return None

        return pd.Series([
            None if links_ is None else [one(b, h) for h in links_]
            for b, links_ in zip(bases, links)
        ])

    return resolve(base, hrefs)


def _fetchable(urls: Column) -> Column:
    return F.array_distinct(F.filter(urls, lambda u: u.rlike(r"^https?://")))


def _first(links: Column, limit: int | None) -> Column:
    return links if limit is None else F.slice(links, 1, limit)


def html_links(html: Column, base: Column, limit: int | None = None) -> Column:
    """Absolute anchor targets in page order, first occurrence kept; all unless limited."""
    hrefs = F.filter(
        all_matches(html, K.ANCHOR_HREF_RE, 1),
        lambda h: ~F.lower(h).rlike(r"^(mailto:|tel:|javascript:|data:)"),
    )
    return _first(_fetchable(join_urls(base, hrefs)), limit)


def markdown_links(text: Column, limit: int | None = None) -> Column:
    return _first(F.array_distinct(all_matches(text, K.MARKDOWN_LINK_RE, 1)), limit)


def crawl_links(html: Column, base: Column) -> Column:
    """Link targets a crawl may follow: any href, fragment dropped."""
    hrefs = F.filter(
        all_matches(html, K.HREF_RE, 1),
        lambda h: ~F.lower(h).rlike(r"^(mailto:|tel:|javascript:|data:|#)"),
    )
    return _fetchable(join_urls(base, hrefs, drop_fragment=True))


def parse_robots(body: Column) -> Column:
    """struct(sitemaps, disallow) of a robots body.

    The last user-agent line before a rule decides whether it applies; only the
    any-agent group counts.
    """
    lines = F.transform(
        F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"),
        lambda ln: stripped(F.regexp_replace(ln, r"#.*$", "")),
    )
    rules = F.transform(
        F.filter(lines, lambda ln: F.contains(ln, F.lit(":"))),
        lambda ln: F.struct(
            F.lower(stripped(F.regexp_extract(ln, r"^([^:]*):(.*)$", 1))).alias("k"),
            stripped(F.regexp_extract(ln, r"^([^:]*):(.*)$", 2)).alias("v"),
        ),
    )
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("applies"), empty.alias("sitemaps"),
                     empty.alias("disallow"))

    def step(acc, rule):
        return F.struct(
            F.when(rule.k == "user-agent", rule.v == "*").otherwise(acc.applies).alias("applies"),
            F.when((rule.k == "sitemap") & (rule.v != ""),
                   F.concat(acc.sitemaps, F.array(rule.v)))
            .otherwise(acc.sitemaps).alias("sitemaps"),
            F.when((rule.k == "disallow") & acc.applies & (rule.v != ""),
                   F.concat(acc.disallow, F.array(rule.v)))
            .otherwise(acc.disallow).alias("disallow"),
        )

    return F.aggregate(
        rules, start, step,
        lambda acc: F.struct(acc.sitemaps.alias("sitemaps"), acc.disallow.alias("disallow")))


def robots_allow(url: Column, disallow: Column) -> Column:
    # The one-element array makes the path a variable, worked out once for all rules.
    blocked = F.exists(F.array(url_path(url)), lambda path: F.exists(
        disallow, lambda rule: F.startswith(path, rule)))
    return ~F.coalesce(blocked, F.lit(False))


def parse_sitemap(body: Column) -> Column:
    """struct(children, pages(url, lastmod)); bare <loc> documents count as pages."""
    children = F.flatten(F.transform(
        all_matches(body, K.SITEMAP_BLOCK_RE, 1),
        lambda b: F.transform(all_matches(b, K.LOC_RE, 1), unwrap_cdata)))
    blocks = F.filter(all_matches(body, K.URL_BLOCK_RE, 1), lambda b: b.rlike(K.LOC_RE))
    listed = F.transform(blocks, lambda b: F.struct(
        unwrap_cdata(F.regexp_extract(b, K.LOC_RE, 1)).alias("url"),
        day_of(unwrap_cdata(F.regexp_extract(b, K.LASTMOD_RE, 1))).alias("lastmod")))
    bare = F.transform(all_matches(body, K.LOC_RE, 1), lambda u: F.struct(
        unwrap_cdata(u).alias("url"), F.lit(None).cast("string").alias("lastmod")))
    wrapped = (F.size(children) > 0) | (F.size(listed) > 0)
    return F.struct(children.alias("children"),
                    F.when(wrapped, listed).otherwise(bare).alias("pages"))
