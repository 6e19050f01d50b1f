"""Mixing sources to target weights by entropy balancing.

Documents start at rate 1. Of all rates between 0 and `most` whose words add up to a source's
target, entropy balancing takes those nearest to the start; they are min(most, exp(tilt x
size)), one tilt per source. The tilts solve the convex dual by Newton steps, each a grouped
sum over (source, size, documents of that size), so a step never sees a single document and a
source with a third of all rows is no larger than its distinct sizes.

Rates become copies size by size, longest first, each size taking over what the sizes before
it left open, so a source misses its target by half its shortest document at most (where its
own words allow). Which of equally long documents get the extra copy follows a hash of doc_id.

Null text has size 0 and takes 0 words; a null source is a source, the last one. Rows may
repeat; each counts. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.common import chunks, columns_of, words
from attestry.llm.ranking import ranked
from attestry.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
STEPS = 40
CLOSE = 1e-7


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words of every text."""
    source = columns_of(docs, "doc_id", "source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [words(t).per_text() for t in chunks(b.column(2))]
            size = np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size)],
                                             names=["doc_id", "source", "size"])

    source = source.select(_typed(source, "doc_id", "bigint"), F.col("source").cast("string"),
                           F.col("text").cast("string"))
    return source.mapInArrow(
        run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, source string, "
             "size bigint")


def _typed(df: DataFrame, name: str, fallback: str):
    void = df.schema[name].dataType.simpleString() == "void"
    return F.col(name).cast(fallback) if void else F.col(name)


def targets(counted: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """source, source_size, target: shares by weight, none above `most` times its source.

    `counted` has a row per source. Weights repeat along the sources in code point order,
    null last. What a full source cannot take goes to the others by weight, until none
    is above; a round fills one source at least, and all sums are taken over sources only.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = counted.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    weighted = stored(weighted, "weights")
    cap = F.col("source_size") * float(most)
    whole = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * level >= cap
        taken, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (share * whole - taken) / open_weight if open_weight else level
        if not open_weight or new <= level * (1 + 1e-15):
            break
        level = new
    return weighted.select(
        "source", "source_size",
        F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def tilts(histogram: DataFrame, goal: DataFrame, most: float = MOST, steps: int = STEPS,
          close: float = CLOSE) -> DataFrame:
    """source, source_size, target, tilt, unit: a tilt for each source by Newton on the dual.

    `histogram` is (source, size, n). The dual of a source is
    D(t) = sum n g(t z) - t target / unit with z = size / unit and unit its mean size; its
    slope is the words taken less the target. A step is bounded, and halves its bracket
    where Newton would leave it, so it cannot diverge; sources that must take all they have
    start at a tilt high enough to do so.
    """
    scale = histogram.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n"))),
                                                        F.lit(1))).alias("unit"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest"))
    state = goal.join(scale, goal["source"].eqNullSafe(scale["source"])).select(
        goal["source"], "source_size", "target",
        F.greatest(F.coalesce(F.col("unit"), F.lit(1.0)), F.lit(1e-9)).alias("unit"),
        F.coalesce(F.col("shortest"), F.lit(1)).alias("shortest"))
    top = F.log(F.lit(float(most))) * F.col("unit") / F.col("shortest") + 1e-9
    filled = F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12)
    state = state.select(
        "source", "source_size", "target", "unit",
        F.when(filled, top).otherwise(0.0).alias("tilt"),
        F.lit(-1e3).alias("low"), top.alias("high"), filled.alias("done"))
    for _ in range(steps):
        state = stored(state, "tilts")
        if state.filter(~F.col("done")).isEmpty():
            break
        h = histogram.alias("h").join(
            state.filter(~F.col("done")).alias("s"),
            F.col("h.source").eqNullSafe(F.col("s.source")))
        z = F.col("h.size") / F.col("s.unit")
        bare = F.exp(F.col("s.tilt") * z)
        rate = F.least(bare, F.lit(float(most)))
        sums = h.groupBy(F.col("s.source").alias("source")).agg(
            F.sum(F.col("h.n") * rate * z).alias("took"),
            F.sum(F.when(bare < float(most), F.col("h.n") * bare * z * z)
                  .otherwise(0.0)).alias("curve"))
        # One row per source on both sides.
        j = state.alias("s").join(
            sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left")
        slope = F.col("took") - F.col("target") / F.col("unit")
        low = F.when(slope < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(slope > 0, F.col("tilt")).otherwise(F.col("high"))
        jump = F.col("tilt") - slope / F.col("curve")
        # Tilts act on sizes of about the unit: a longer jump means a flat curve.
        jump = F.greatest(F.least(jump, F.col("tilt") + 2), F.col("tilt") - 2)
        j = j.select("s.*", slope.alias("slope"), "curve", low.alias("new_low"),
                     high.alias("new_high"), jump.alias("jump"))
        ended = (F.col("done") | F.col("slope").isNull()
                 | (F.abs(F.col("slope")) * F.col("unit") <= close * F.col("target")))
        inside = (F.col("jump") > F.col("new_low")) & (F.col("jump") < F.col("new_high"))
        state = j.select(
            "source", "source_size", "target", "unit",
            F.round(F.when(ended, F.col("tilt"))
                    .when((F.col("curve") > 0) & inside, F.col("jump"))
                    .otherwise((F.col("new_low") + F.col("new_high")) / 2), 12).alias("tilt"),
            F.coalesce("new_low", "low").alias("low"),
            F.coalesce("new_high", "high").alias("high"), ended.alias("done"))
    # The order in which partial sums meet leaves its mark in the last digits only.
    return state.select("source", "source_size", "target", "unit",
                        F.round("tilt", 9).alias("tilt"))


def copies(rates: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, rate, target) to (source, size, total): copies for each size.

    One group is the distinct sizes of one source, at most as many as its longest document
    has words.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        total, open_ = np.zeros(len(pdf), np.int64), 0.0
        for i, (size, n, rate) in enumerate(zip(pdf["size"], pdf["n"], pdf["rate"], strict=True)):
            if size:
                open_ += n * rate * size
                total[i] = min(max(int(np.floor(open_ / size + 0.5)), 0), most * n)
                open_ -= total[i] * size
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"],
                             "total": total})

    return rates.groupBy("source").applyInPandas(
        run, "source string, size bigint, n bigint, total bigint")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most: int = MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, rate, copies, taken for each document."""
    sized = stored(sizes(docs), "sizes")
    histogram = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")),
                       "histogram")
    counted = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = tilts(histogram, targets(counted, weights, share, most), most)
    solved = stored(solved, "solved")
    rated = histogram.alias("h").join(
        solved.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).select(
        "h.source", "h.size", "h.n", "s.source_size", "s.target",
        F.when(F.col("h.size") == 0, 0.0).otherwise(
            F.least(F.exp(F.col("s.tilt") * F.col("h.size") / F.col("s.unit")),
                    F.lit(float(most)))).alias("rate"))
    rated = stored(rated, "rates")
    split = copies(rated.select("source", "size", "n", "rate"), most)
    plan = rated.alias("r").join(
        split.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
        & (F.col("r.size") == F.col("c.size"))).select("r.*", "c.total")
    rows = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_hash = F.xxhash64(F.col("doc_id"), F.lit(17))
    numbered = ranked(sized, ["source", "size"], [by_hash, F.col("doc_id")], F.col("doc_id"), rows)
    got = F.when(F.col("p.size") == 0, 0).otherwise(
        F.expr("p.total div p.n") + F.when(F.col("d.rank") < F.expr("p.total % p.n"), 1)
        .otherwise(0)).cast("long")
    return numbered.alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))
        & (F.col("d.size") == F.col("p.size"))).select(
        "d.doc_id", "d.source", "d.size", "p.source_size", "p.target", "p.rate",
        got.alias("copies"), (got * F.col("d.size")).alias("taken"))
