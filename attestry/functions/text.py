"""Text cleaning as column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import constants as K

_SPACE = " \t\n\r\x0b\x0c"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """Non-blank; NULL counts as blank."""
    return F.coalesce(stripped(c) != "", F.lit(False))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, group))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _any_word(text: Column, words) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def closure_words(text: Column) -> Column:
    """FALSE where no closure phrase can be found; plain words are cheaper than the pattern."""
    return _any_word(text, K.CLOSURE_WORDS)


def shows_hours(text: Column) -> Column:
    """Does a text match HOURS_RE? Only texts that hold one of its words are searched."""
    return _any_word(text, K.HOURS_WORDS) & text.rlike(K.HOURS_RE)


def closure_span(text: Column) -> Column:
    """The part of a text that holds all its closure phrases, '' where it has no phrase word."""
    def span(low: Column) -> Column:
        first = F.least(*[F.nullif(F.instr(low, F.lit(w)), F.lit(0)) for w in K.CLOSURE_WORDS])
        behind = F.least(*[F.length(F.substring_index(low, w, -1)) for w in K.CLOSURE_WORDS])
        start = F.greatest(F.lit(1), first - K.CLOSURE_LEAD)
        return (F.when(first.isNull(), "")
                # Lower case that is longer has other positions.
                .when(F.length(low) != F.length(text), text)
                .otherwise(F.substring(text, start, F.length(low) - behind - start + 1)))

    # The one-element array makes the lower case a variable, worked out once.
    return F.when(text.isNotNull(), F.get(F.transform(F.array(F.lower(text)), span), F.lit(0)))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def decode_entities(c: Column) -> Column:
    """HTML entity decoding; Spark has no built-in for the named set."""
    import pandas as pd

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        import html
        return texts.map(html.unescape, na_action="ignore")

    return unescape(c)


def text_from_html(raw: Column, decode: bool = True) -> Column:
    """Readable text: script and style blocks, then any unclosed opener to the end, then tags."""
    body = F.regexp_replace(raw, K.PAIRED_TAG_RE, " ")
    body = F.regexp_replace(body, K.OPEN_TAG_RE, " ")
    body = F.regexp_replace(body, K.ANY_TAG_RE, " ")
    return collapse(decode_entities(body) if decode else body)


def snippet_at(text: Column, start: Column, length: Column, pad: int = 60) -> Column:
    """Text around a 1-based match, trimmed."""
    lo = F.greatest(F.lit(1), start - pad)
    return stripped(F.substring(text, lo, start + length + pad - lo))


def snippet(text: Column, pattern: str, pad: int = 60) -> Column:
    hit = F.regexp_extract(text, pattern, 0)
    at = F.instr(text, hit)
    return F.when(hit != "", snippet_at(text, at, F.length(hit), pad)).otherwise("")


def clean_text(c: Column, fallback: str = "") -> Column:
    """Control characters to spaces, whitespace collapsed, trimmed; blank gives the fallback."""
    s = collapse(F.regexp_replace(c.cast("string"), K.CONTROL_RE, " "))
    return F.coalesce(s if fallback == "" else blank_to_null(s), F.lit(fallback))


def first_filled(*choices: Column) -> Column:
    """First non-empty text, '' when there is none; each choice is evaluated once."""
    filled = F.filter(F.array(*choices), lambda s: s != "")
    return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))


def http_url(c: Column) -> Column:
    s = clean_text(c)
    return F.when(s.rlike(r"(?i)^https?://"), s).otherwise("")


def safe_number(c: Column, fallback: float) -> Column:
    """A finite number or the fallback."""
    n = c.try_cast("double")
    usable = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return F.when(usable, n).otherwise(F.lit(float(fallback)))


def string_list(c: Column) -> Column:
    """Cleaned non-blank strings of an array; NULL array gives an empty one."""
    return F.coalesce(
        F.filter(F.transform(c, lambda s: clean_text(s)), lambda s: s != ""),
        F.array().cast("array<string>"),
    )
