"""How far a scorer can be trusted, measured on organisations it was not tuned on.

Scored rows are long: scorer, org_id, support, contradict, truth. Every metric
works from grouped counts, so a scorer with a billion rows still reduces to
small tables before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestry import constants as K
from attestry.functions.scoring import read_support

STEPS = 100
SCORE_BUCKETS = 4096


def decidable(rows: DataFrame) -> DataFrame:
    """Rows the oracle could decide and the scorer answered."""
    return rows.dropna(subset=["truth", "support"])


def population(listing: DataFrame, contacts: DataFrame) -> DataFrame:
    """Approved listings with a website and a phone or an address."""
    ok = (F.coalesce("status", F.lit("")) == "approved") & (
        F.coalesce("website", F.lit("")) != "")
    return listing.filter(ok).join(contacts.select(F.col("listing_id").alias("id")), "id",
                                   "left_semi")


def sample_listings(listing: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """A repeatable sample of n listings; per-partition top-n, merged."""
    return listing.orderBy(hash_order(F.col("id"), seed), "id").limit(n)


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def split_by_org(rows: DataFrame, seed: int = 17, key: str = "org_id") -> DataFrame:
    """(org_id, half): a seeded split by organisation, the floor half for calibration.

    The exact middle of the hash order is found from the counts of 4,096 hash
    prefixes; only the prefix holding the middle is ranked.
    """
    orgs = rows.select(key).distinct().withColumn("h", hash_order(F.col(key), seed)).withColumn(
        "p", F.left("h", F.lit(3)))
    counts = orgs.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # At most 4,096 rows.
    before = counts.select(
        "p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"),
        F.floor(F.sum("n").over(Window.partitionBy()) / 2).alias("half_size"))
    placed = orgs.join(F.broadcast(before.join(counts, "p")), "p")
    whole = placed.filter((F.col("before") + F.col("n") <= F.col("half_size"))
                          | (F.col("before") >= F.col("half_size"))).select(
        key, F.when(F.col("before") < F.col("half_size"), "calibration").otherwise("test")
        .alias("half"))
    # The middle lies inside one prefix; only that one is ranked.
    within = F.row_number().over(Window.partitionBy("p").orderBy("h", key))
    middle = placed.filter((F.col("before") < F.col("half_size"))
                           & (F.col("before") + F.col("n") > F.col("half_size"))).select(
        key, F.when(F.col("before") + within <= F.col("half_size"), "calibration")
        .otherwise("test").alias("half"))
    return whole.unionByName(middle)


def with_half(rows: DataFrame, halves: DataFrame, key: str = "org_id") -> DataFrame:
    return rows.join(halves, key)


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; NULL for one class.

    Rows collapse to one per distinct score first. Running negative counts come
    from bucket totals plus a running sum inside each score bucket.
    """
    points = rows.groupBy(*by, F.col("support").alias("s")).agg(
        F.count_if(F.col("truth")).alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    bucket = F.greatest(F.lit(0), F.least(F.lit(SCORE_BUCKETS - 1),
                                          F.floor(F.col("s") * SCORE_BUCKETS)))
    points = points.withColumn("b", bucket)
    totals = points.groupBy(*by, "b").agg(F.sum("neg").alias("bneg"))
    prefix = totals.select(*by, "b", (F.sum("bneg").over(
        Window.partitionBy(*by).orderBy("b")) - F.col("bneg")).alias("below"))
    inside = F.sum("neg").over(Window.partitionBy(*by, "b").orderBy("s")) - F.col("neg")
    joined = points.withColumn("inside", inside).join(prefix, [*by, "b"])
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") * 0.5))
    pairs = F.sum("pos") * F.sum("neg")
    return joined.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def ece(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins; 1.0 belongs to the last one."""
    b = F.least(F.floor(F.col("support") * bins), F.lit(bins - 1)).alias("bin")
    per_bin = rows.groupBy(*by, b).agg(
        F.count(F.lit(1)).alias("n"), F.avg("support").alias("conf"),
        F.avg(F.col("truth").cast("double")).alias("acc"))
    return per_bin.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def step_of(score: Column) -> Column:
    """Largest i with i/100 <= score, -1 below zero, exact at the step edges."""
    guess = F.floor(score * STEPS).cast("int")
    up = F.when((guess + 1) / F.lit(float(STEPS)) <= score, guess + 1).otherwise(guess)
    exact = F.when(up / F.lit(float(STEPS)) > score, up - 1).otherwise(up)
    return F.greatest(F.lit(-1), F.least(F.lit(STEPS), exact))


def sweep(rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision and recall at the 101 thresholds 0.00 .. 1.00.

    Each row is counted once at its own step; thresholds are running sums over
    at most 102 counts per group.
    """
    steps = rows.groupBy(*by, step_of(F.col("support")).alias("i")).agg(
        F.count_if(F.col("truth")).alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    grid = steps.select(*by).distinct().select(
        *by, F.explode(F.sequence(F.lit(-1), F.lit(STEPS))).alias("i"))
    dense = grid.join(steps, [*by, "i"], "left").fillna(0, ["pos", "neg"])
    down = Window.partitionBy(*by).orderBy(F.desc("i"))
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    total = F.sum("pos").over(Window.partitionBy(*by))
    return dense.select(
        *by, "i", tp.alias("tp"), fp.alias("fp"), (total - tp).alias("fn")).filter(
        F.col("i") >= 0).select(
        *by, (F.col("i") / float(STEPS)).alias("threshold"), "tp", "fp", "fn",
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def at_threshold(rows: DataFrame, by: list[str], threshold: Column) -> DataFrame:
    hit = F.col("support") >= threshold
    counts = rows.groupBy(*by).agg(
        F.count_if(hit & F.col("truth")).alias("tp"),
        F.count_if(hit & ~F.col("truth")).alias("fp"),
        F.count_if(~hit & F.col("truth")).alias("fn"))
    return counts.withColumns({
        "precision": F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)),
        "recall": F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))})


def choose_threshold(swept: DataFrame, by: list[str],
                     target: float = K.TARGET_PRECISION) -> DataFrame:
    """The middle of the plateau of best precision among thresholds meeting the target."""
    ok = swept.filter((F.col("precision") >= target) & (F.col("tp") > 0))
    best = F.max("precision").over(Window.partitionBy(*by))
    plateau = ok.withColumn("best", best).filter(F.col("precision") >= F.col("best") - 1e-9)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    pos = F.row_number().over(Window.partitionBy(*by).orderBy("threshold"))
    return plateau.withColumn("n", n).withColumn("pos", pos).filter(
        F.col("pos") == F.floor(F.col("n") / 2) + 1).drop("best", "n", "pos")


def ceiling(swept: DataFrame, by: list[str]) -> DataFrame:
    """Best precision, then recall, over thresholds 0.50 .. 0.99; first threshold on ties."""
    band_ = swept.filter((F.col("threshold") >= 0.5) & (F.col("threshold") < 0.995))
    zero = F.lit(0.0)
    order = F.struct(F.coalesce("precision", zero).alias("p"),
                     F.coalesce("recall", zero).alias("r"), (-F.col("threshold")).alias("t"))
    return band_.groupBy(*by).agg(F.max_by(
        F.struct("threshold", "tp", "fp", "fn", "precision", "recall"), order).alias("m")
    ).select(*by, "m.*")


def accusations(rows: DataFrame, by: list[str], bars=K.ACCUSATION_BARS) -> DataFrame:
    """Rows a high contradict score would accuse, and how many are on the page after all."""
    wide = rows.groupBy(*by).agg(*[
        F.struct(F.lit(t).alias("bar"),
                 F.count_if(F.col("contradict") >= t).alias("flagged"),
                 F.count_if((F.col("contradict") >= t) & F.col("truth")).alias("wrong"))
        .alias(f"t{i}") for i, t in enumerate(bars)])
    return wide.select(*by, F.explode(F.array(*[F.col(f"t{i}") for i in range(len(bars))]))
                       .alias("a")).select(*by, "a.*")


def field_profile(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("rows"),
                                     F.count_if(F.col("truth")).alias("positives"))


def report(rows: DataFrame, halves: DataFrame, target: float = K.TARGET_PRECISION) -> DataFrame:
    """One row per scorer: AUROC and ECE held out, the chosen threshold and how it held up."""
    by = ["scorer"]
    halved = with_half(decidable(rows), halves)
    cal, test = halved.filter("half = 'calibration'"), halved.filter("half = 'test'")
    chosen = choose_threshold(sweep(cal, by), by, target).select(
        "scorer", F.col("threshold").alias("chosen"), F.col("precision").alias("cal_precision"))
    held = sweep(test, by)
    at_chosen = held.join(chosen, "scorer").filter(
        F.abs(F.col("threshold") - F.col("chosen")) < 1e-9).select(
        "scorer", "chosen", "cal_precision", F.col("tp").alias("held_tp"),
        F.col("fp").alias("held_fp"), F.col("fn").alias("held_fn"),
        F.col("precision").alias("held_precision"), F.col("recall").alias("held_recall"))
    top = ceiling(held, by).select("scorer", F.col("threshold").alias("ceiling_threshold"),
                                   F.col("precision").alias("ceiling_precision"))
    size = halved.groupBy("scorer").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("truth")).alias("positives"),
        F.count_if(F.col("half") == "test").alias("test_rows"))
    out = size
    for part in (auroc(test, by), ece(test, by), at_chosen, top):
        out = out.join(part, "scorer", "left")
    return out


def read_answers(answers: DataFrame) -> DataFrame:
    """Raw scorer answers (kind, answer, second) to support and contradict; unreadable dropped."""
    s = read_support(F.col("kind"), F.col("answer"), F.col("second"))
    return answers.withColumn("s", s).filter(F.col("s").isNotNull()).select(
        *[c for c in answers.columns if c not in ("kind", "answer", "second")],
        "s.support", "s.contradict")
