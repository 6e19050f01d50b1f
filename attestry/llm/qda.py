"""Regularised quadratic discriminant for text quality.

Sizes and shares of every text (`stats.RATIOS`) are transformed to be nearer to normal and
standardised. Each class gets a mean and a covariance shrunk towards the pooled one and then
towards a multiple of the identity; all of it comes from one grouped sum of products, so any
number of labelled rows takes part. The Cholesky factors are worked out once on the driver
(a dozen columns) and travel with the scoring function. The score is the logistic function
of the difference of the two log densities, each a Mahalanobis distance and a log
determinant, plus the log odds of the classes.

Null text counts as empty and is scored like any other. With labels of one class only, or
none, all scores are that class's share, or a half. Rows may repeat; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import stats
from attestry.llm.common import crc_fold
from attestry.session import stored

TO_POOLED = 0.1
TO_IDENTITY = 0.02
FLOOR = 1e-3


def transformed(name: str) -> str:
    """SQL: shares by their logarithm above a floor, lengths by theirs."""
    ratio = stats.RATIOS[name]
    if name == "log_words":
        return ratio
    return f"log1p({ratio})" if name in ("word_length", "line_words") else f"log({ratio} + {FLOOR}D)"


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants, by class 0 and 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = []
        for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True):
            y = (z - m) @ f.T
            density.append(-0.5 * ((y * y).sum(1) + d))
        gap = np.clip(density[1] - density[0] + self.log_odds, -500, 500)
        return 1.0 / (1.0 + np.exp(-gap))


def moments(rows: DataFrame, names: list[str]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By label: rows, sums and sums of products. One grouped aggregate."""
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(f"s{i}") for i, n in enumerate(names)],
        *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in got:
        p = np.zeros((k, k))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[int(r["label"])] = (r["n"], np.array([r[f"s{i}"] for i in range(k)]), p)
    return out


def fit(known: dict[int, tuple[int, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED,
        to_identity: float = TO_IDENTITY) -> Model | float:
    """The model, or the one score to give where a class is missing."""
    if set(known) != {0, 1} or min(known[c][0] for c in (0, 1)) < 2:
        n = {c: known[c][0] for c in known}
        return n.get(1, 0) / sum(n.values()) if n else 0.5
    n = np.array([known[c][0] for c in (0, 1)], float)
    total = known[0][1] + known[1][1]
    centre = total / n.sum()
    spread = np.diag(known[0][2] + known[1][2]) / n.sum() - centre ** 2
    # What is left of a constant column is rounding, not spread.
    scale = np.sqrt(np.where(spread > 1e-9 * (1 + centre ** 2), spread, 1.0))
    means = np.array([(known[c][1] / n[c] - centre) / scale for c in (0, 1)])
    own = []
    for c in (0, 1):
        m = known[c][1] / n[c]
        own.append((known[c][2] / n[c] - np.outer(m, m)) / np.outer(scale, scale))
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, log_dets = [], []
    for cov in own:
        shrunk = (1 - to_pooled) * cov + to_pooled * pooled
        # A class without any spread still gets a ball around its mean.
        eye = np.eye(len(centre)) * max(np.trace(shrunk) / len(centre), FLOOR)
        shrunk = (1 - to_identity) * shrunk + to_identity * eye
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Model(centre, scale, means, np.array(factors), np.array(log_dets),
                 float(np.log(n[1] / n[0])))


def scores(docs: DataFrame, labels: DataFrame, to_pooled: float = TO_POOLED,
           to_identity: float = TO_IDENTITY) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    names = list(stats.RATIOS)
    table = stored(stats.table(docs).select(
        "doc_id", *[F.expr(transformed(n)).alias(n) for n in names]), "features")
    held_out = crc_fold(F.col("doc_id")) == 1
    known = moments(stats.labelled(table.filter(~held_out), labels), names)
    model = fit(known, to_pooled, to_identity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            s = model.score(x) if isinstance(model, Model) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())],
                                             names=["doc_id", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
