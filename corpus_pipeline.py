"""Raw documents to packed sequences in five stages.

Each stage is a function (spark, docs, sf_dir); what it returns is written as Parquet to the
shared folder and read again as the next one's documents. All but the last return the columns
of `documents`. No stage can be told in SQL as a whole (learnt rules, Newton steps, packing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import jaccard, mixing, packing, rules, tries
from attestry.session import stored

# The stage's near copies: 5-word shingles, similarity of 0.8 or more. The narrower values
# that jaccard has by default are those of the query op9_ngram_jaccard_join.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learnt list rejects."""
    return rules.accepted(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return tries.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component; documents without id stay."""
    found = jaccard.near_copies(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))
                        | F.col("doc_id").isNull()).select("doc_id").distinct().alias("s")
    return docs.alias("d").join(
        stay, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows that share id and source are taken as often as the one taken most.
    """
    taken = mixing.mix(docs).filter("copies > 0").groupBy("doc_id", "source").agg(
        F.max("copies").cast("int").alias("copies")).alias("m")
    d = docs.alias("d")
    both = d.join(taken, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
                  & F.col("d.source").eqNullSafe(F.col("m.source")))
    # A second row per document with two copies, not a list of texts.
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("m.copies")))).select(
        *[F.col(f"d.`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup),
          ("n-gram Jaccard join", near_dedup), ("mixing sources to target weights", source_mix),
          ("best-fit packing", best_fit_packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
