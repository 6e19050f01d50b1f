"""Personal data by weak supervision, in DataFrame operations only.

1. Base spans: one pattern per kind, leftmost matches, those that fail their check dropped.
   They always stay.
2. Candidates: the base spans, and looser look-alikes of the same kinds outside of them.
3. Six labelers vote for (1), against (-1) or abstain (0): pattern and check, gazetteer of
   known endings, issuers and networks, cue words before, words that speak against it,
   shape, and what the span touches.
4. Votes are counted by (kind, votes): a bounded table, at most 4 x 3^6 rows whatever the
   corpus. Expectation-maximisation on it estimates each kind's share of true spans and
   each labeler's reliability. A logistic span classifier is then fitted to the resulting
   probabilities, on vote features alone, so it also scores patterns never seen together.
5. The classifier is a CASE expression; look-alikes that reach `ACCEPT` become spans.

Positions are code points, ends exclusive. Null text counts as empty. Rows may repeat; each
is searched on its own. Further columns are ignored; an empty table gives an empty result.
Patterns use possessive runs, so a text of any length is read once per pattern; places of
matches are summed in blocks of `BLOCK`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import columns_of
from attestry.session import stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "cue", "against", "shape", "touch")
ACCEPT = 0.9
BLOCK = 128
ROUNDS = 50

# The base patterns. A match may begin at the start of a run, or where the
# last match ended; from inside a run nothing else could match.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Cheap tests that every match must pass; texts without them skip the pattern.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]",
        "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?"
             r"[a-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[a-z0-9-]{1,63}){1,5}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])",
    "card": BASE["card"],
    "phone": r"(?<![0-9+.(-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])",
}
LOOSE_HINT = {"email": r"(?i)[(\[{]at[)\]}]", "ip": r"[0-9] ?\. ?[0-9]", "card": HINT["card"],
              "phone": r"[0-9]\)?[ .-][0-9]"}

# Gazetteers and context words of the labelers.
ENDINGS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "uk", "eu")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|65|62)"
UNROUTED = r"^0*(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|addr|address|from|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|telefon|fon|movil)\b",
}
AGAINST = r"(?i)\b(?:isbn|issn|order|invoice|version|ver|serial|part|sku|token|hash|no|nr|ref)\b"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

_SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"
_CAND = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.expr("0L"), lambda a, x: a + x)


def sums_before(steps: Column) -> Column:
    """For each element the sum of those before it, in blocks so that long arrays stay cheap."""
    def per_block(v: Column) -> Column:
        n = F.ceil(F.size(v) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                           lambda b: total(F.slice(v, b * BLOCK + 1, BLOCK)))

    def places(v: Column, base: Column) -> Column:
        return F.transform(v, lambda _, i: F.get(base, F.floor(i / BLOCK).cast("int")) + total(
            F.slice(v, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK).cast("int"))))

    def bases(blocks: Column) -> Column:
        return F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))

    return let(steps, lambda v: let(per_block(v), lambda s: let(
        bases(s), lambda base: places(v, base))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of all matches, in order."""
    def build(between: Column, found: Column) -> Column:
        gaps = F.transform(between, lambda x: F.length(x).cast("long"))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                           lambda g, m: g + F.length(m))
        return let(gaps, lambda g: let(sums_before(steps), lambda at: F.transform(
            found, lambda m, i: F.struct(
                (F.get(at, i) + F.get(g, i)).alias("start"),
                (F.get(at, i) + F.get(g, i) + F.length(m)).alias("end"),
                m.alias("found")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, let(F.split(text, pattern, -1), lambda between: build(between, found))
    ).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    def add(acc: Column, i: Column) -> Column:
        x = F.expr("0") + F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(digits(found))
    if kind == "card":
        # A long run is no card, whatever its digits add up to.
        return F.when(n.between(13, 19), luhn(digits(found))).otherwise(False)
    return n.between(9, 15)


def votes(kind: str, base: Column, found: Column, before: Column, after: Column) -> Column:
    """array<int> of the six votes."""
    def vote(up: Column, down: Column | None = None) -> Column:
        out = F.when(up, 1)
        return (out.when(down, -1) if down is not None else out).otherwise(0)

    d = digits(found)
    n = F.length(d)
    if kind == "email":
        ending = F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = vote(ending.isin(*ENDINGS), ~ending.rlike("^[a-z]{2,}$"))
        shape = vote(F.length(found).between(6, 100), F.length(found) > 254)
    elif kind == "ip":
        gazetteer = vote(F.lit(False), found.rlike(UNROUTED))
        shape = vote(found.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$"),
                     found.rlike(r"(?:^|\.) ?0[0-9]"))
    elif kind == "card":
        gazetteer = vote(d.rlike(ISSUERS), ~d.rlike(ISSUERS))
        shape = vote(n.isin(15, 16), n.isin(17, 18))
    else:
        gazetteer = vote(found.rlike(r"^\+(?:1|3[0-9]|4[0-9]|7|8[1-6]|9[0-5])"),
                         d.rlike("^0{3}"))
        shape = vote(n.between(10, 13), (n < 9) | (n > 15))
    touched = before.rlike("[A-Za-z0-9=\"#/_]$") | after.rlike("^[A-Za-z0-9\"/_]")
    return F.array(vote(base, ~base), gazetteer, vote(before.rlike(CUES[kind])),
                   vote(F.lit(False), before.rlike(AGAINST)), shape,
                   vote(~touched, touched)).cast("array<int>")


def blotted(text: Column, kind: str) -> Column:
    """The text with valid matches of a base pattern replaced, place by place."""
    def one(between: Column, found: Column) -> Column:
        return F.array_join(F.zip_with(between, found, lambda g, m: F.concat(
            g, F.when(m.isNull(), "").when(passes(kind, m), F.repeat(F.lit("\u0001"), F.length(m)))
            .otherwise(m))), "")

    return let(F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), lambda found: one(
        F.split(text, BASE[kind], -1), found))


def searched(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates with their votes, one row per document."""
    source = columns_of(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = source.select("doc_id", text.alias("text"))
    if rows.schema["doc_id"].dataType.simpleString() == "void":
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    # Few texts hold any; the rest skip everything below.
    t = F.col("text")
    rows = rows.withColumn("some", t.rlike(r"[0-9@]") | t.rlike(LOOSE_HINT["email"]))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")

    def valid(kind: str) -> Column:
        return F.filter(matches(t, BASE[kind]), lambda m: passes(kind, m["found"]))

    full = rows.withColumns({
        f"b_{k}": F.when(F.col("some") & t.rlike(HINT[k]), valid(k)).otherwise(empty)
        for k in KINDS})
    # Look-alikes are sought in a copy whose base spans are blotted out, so that they cannot
    # overlap and need not be compared.
    full = full.withColumn("masked", t)
    for k in KINDS:
        m = F.col("masked")
        full = full.withColumn("masked", F.when(
            F.size(f"b_{k}") > 0, blotted(m, k)).otherwise(m))
    m = F.col("masked")
    full = full.withColumns({
        f"l_{k}": F.when(F.col("some") & m.rlike(LOOSE_HINT[k]), matches(m, LOOSE[k])).otherwise(
            empty) for k in KINDS})

    def placed(kind: str, i: int) -> Column:
        return F.transform(F.col(f"b_{kind}"), lambda m: F.struct(
            F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    def voted(kind: str, i: int, spans: Column, is_base: bool) -> Column:
        return F.transform(spans, lambda m: F.struct(
            F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            F.lit(is_base).alias("base"),
            votes(kind, F.lit(is_base), m["found"],
                  F.substr(t, F.greatest(m["start"] - 23, F.lit(1)).cast("int"),
                           F.least(m["start"], F.lit(24)).cast("int")),
                  F.substr(t, (m["end"] + 1).cast("int"), F.lit(12))).alias("votes")))

    def loose(kind: str) -> Column:
        spans = F.col(f"l_{kind}")
        if kind == "ip":
            return F.filter(spans, lambda m: passes("ip", F.translate(m["found"], " ", "")))
        if kind == "email":
            return spans
        low, high = (13, 19) if kind == "card" else (9, 15)
        return F.filter(spans, lambda m: F.length(digits(m["found"])).between(low, high))

    base = F.concat(*[placed(k, i) for i, k in enumerate(KINDS)]).cast(_SPAN)
    cands = F.concat(*[voted(k, i, F.col(f"b_{k}"), True) for i, k in enumerate(KINDS)],
                     *[voted(k, i, loose(k), False) for i, k in enumerate(KINDS)]).cast(_CAND)
    return full.select("doc_id", base.alias("base"), cands.alias("cands"))


@dataclass(frozen=True)
class Supervision:
    """What EM found, and the span classifier fitted to it."""

    share: np.ndarray  # of true spans, by kind
    reliability: np.ndarray  # P(vote | truth) as [labeler, truth, vote + 1]
    weights: np.ndarray  # intercept by kind, then two per labeler


def em(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = ROUNDS
       ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares, reliabilities and P(true) of each pattern, begun from the majority vote.

    Each labeler is taken to be better than chance: a vote for a span is never likelier for
    a false one, which keeps the two classes from changing places.
    """
    p = 1 / (1 + np.exp(-v.sum(1).astype(float)))
    share, rel = np.full(len(KINDS), 0.5), np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            at = kinds == k
            share[k] = ((p * n)[at].sum() + 1) / (n[at].sum() + 2)
        for j in range(v.shape[1]):
            for z, w in ((1, p * n), (0, (1 - p) * n)):
                rel[j, z] = [w[v[:, j] == x].sum() + 1 for x in (-1, 0, 1)]
                rel[j, z] /= rel[j, z].sum()
            for x, better in ((0, 0), (2, 1)):
                if rel[j, better, x] < rel[j, 1 - better, x]:
                    rel[j, :, x] = rel[j, :, x].mean()
            rel[j] /= rel[j].sum(1, keepdims=True)
        log = np.log(share[kinds]) - np.log(1 - share[kinds])
        for j in range(v.shape[1]):
            log = log + np.log(rel[j, 1, v[:, j] + 1] / rel[j, 0, v[:, j] + 1])
        p = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
    return share, rel, p


def features(kinds: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.column_stack([np.eye(len(KINDS))[kinds], v == 1, v == -1]).astype(float)


def logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0,
             rounds: int = 30) -> np.ndarray:
    """Weights for soft labels `p` by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - q)) - ridge * w
        curve = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def supervise(found: DataFrame) -> Supervision:
    """EM and classifier from the votes of all candidates."""
    c = found.select(F.explode("cands").alias("c"))
    rows = c.groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    kinds = np.array([r["kind"] for r in rows], int)
    v = np.array([r["votes"] for r in rows], int).reshape(-1, len(LABELERS))
    n = np.array([r["n"] for r in rows], float)
    share, rel, p = em(kinds, v, n)
    return Supervision(share, rel, logistic(features(kinds, v), p, n))


def probability(model: Supervision, c: Column) -> Column:
    """P(true) of a candidate struct, as an expression."""
    w = model.weights
    k, j = len(KINDS), len(LABELERS)
    score = F.element_at(F.array(*[F.lit(float(x)) for x in w[:k]]), c["kind"] + 1)
    for i in range(j):
        x = F.get(c["votes"], F.lit(i))
        score = score + F.when(x == 1, float(w[k + i])).when(
            x == -1, float(w[k + j + i])).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def shown(spans: Column) -> Column:
    """kind:start:end by kind, then start, joined with commas; `spans` is sorted."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))))


def spans(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end), in the order of `shown`."""
    found = stored(searched(docs), "candidates")
    model = supervise(found)
    added = F.filter("cands", lambda c: ~c["base"] & (probability(model, c) >= accept))
    return found.select(
        "doc_id", F.array_sort("base").alias("base"),
        F.array_sort(F.array_distinct(F.concat("base", F.transform(added, lambda c: F.struct(
            c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
                     ).alias("spans"))


def report(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, counts of base spans by kind, their checksum, all spans as text."""
    rows = spans(docs, accept)

    def number(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    return rows.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(shown(F.col("base")), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"))
