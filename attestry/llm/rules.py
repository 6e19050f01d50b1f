"""Quality rules: a decision list learnt by sequential covering.

Counts of every text become sizes and shares (`stats.RATIOS`). On a bounded sample of
labelled rows a rule grows one threshold at a time by the gain in information about rejected
documents, is pruned on rows it has not seen, and is taken if it stays precise there; the
rows it covers leave and the next rule grows. The ordered rules are one Spark CASE
expression, so applying them needs neither Python nor a shuffle.

Null text counts as empty. Without labels of both kinds there are no rules. A table may
repeat rows and carry further columns; every row is judged on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm import stats
from attestry.llm.common import crc_fold
from attestry.session import stored

SAMPLE_ROWS = 20_000
CUTS = 64
MAX_RULES = 24
MAX_CONDITIONS = 5
PRECISION = 0.98
LEAST_COVER = 4
LEAST_WORDS, REPEAT_SHARE = 50, 50


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature]
        return v >= self.cut if self.above else v <= self.cut


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def cuts(values: np.ndarray) -> np.ndarray:
    """Midpoints between distinct values, thinned by quantile."""
    v = np.unique(values)
    mid = (v[1:] + v[:-1]) / 2
    return mid if len(mid) <= CUTS else np.unique(
        mid[np.linspace(0, len(mid) - 1, CUTS).astype(int)])


def grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until no good row is covered."""
    rule: list[Condition] = []
    live = np.ones(len(y), bool)
    while len(rule) < MAX_CONDITIONS and (~y[live]).any():
        xs, ys = x[live], y[live]
        p0, n0 = ys.sum(), (~ys).sum()
        if not p0:
            break
        base = np.log2(p0 / (p0 + n0))
        best = (1e-9, None)
        for f in range(x.shape[1]):
            order = np.argsort(xs[:, f], kind="stable")
            v, bad = xs[order, f], np.concatenate([[0], np.cumsum(ys[order])])
            for cut in cuts(v):
                for above in (True, False):
                    k = np.searchsorted(v, cut, "left" if above else "right")
                    p = bad[-1] - bad[k] if above else bad[k]
                    total = len(v) - k if above else k
                    if p and total < len(v):
                        gain = p * (np.log2(p / total) - base)
                        if gain > best[0]:
                            best = (gain, Condition(f, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= best[1].holds(x)
    return tuple(rule)


def worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = covers(rule, x)
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on."""
    heads = [rule[:k] for k in range(len(rule), 0, -1)]
    return max(heads, key=lambda r: worth(r, x, y)) if heads else ()


def learn(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[Rule]:
    """Ordered rules for `y`; rows with `fold` 0 prune, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    while len(rules) < MAX_RULES and y[left].any():
        grown, held = left & (fold != 0), left & (fold == 0)
        if not y[grown].any():
            break
        rule = grow(x[grown], y[grown])
        if held.any():
            rule = prune(rule, x[held], y[held])
        if not rule:
            break
        hit = covers(rule, x) & left
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        if p < LEAST_COVER or p < PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(counted: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules for quality 0 from at most `sample_rows` labelled rows, those of least id hash."""
    known = stats.labelled(counted.filter(crc_fold(F.col("doc_id")) != 1), labels)
    at = F.xxhash64(F.col("doc_id"), F.lit(29))
    rows = known.select("label", F.pmod(F.shiftright(at, 7), F.lit(3)).alias("fold"), at.alias("at"),
                        *[F.expr(c).alias(n) for n, c in stats.RATIOS.items()]).orderBy(
        "at", *stats.RATIOS).limit(sample_rows).toPandas()
    x = rows[list(stats.RATIOS)].to_numpy(float)
    return learn(x, rows["label"].to_numpy() == 0, rows["fold"].to_numpy())


def rejects(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, from 1; null if none does."""
    names = list(stats.RATIOS)
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            v = F.expr(stats.RATIOS[names[c.feature]])
            test = test & (v >= c.cut if c.above else v <= c.cut)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(None).cast("int") if out is None else out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, the rule that fired, kept."""
    counted = stored(stats.table(docs), "counts")
    return judged(counted, fit(counted, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    rules = fit(stored(stats.table(docs), "counts"), labels)
    rows = stats.beside(docs).filter(~base_failed() & rejects(rules).isNull())
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def judged(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    return counted.select(
        "doc_id", *stats.COUNTS, base_failed().alias("base_failed"),
        rejects(rules).alias("rule"),
        (~base_failed() & rejects(rules).isNull()).alias("kept"))
