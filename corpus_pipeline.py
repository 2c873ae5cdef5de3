"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, shards.

Every stage reads what the one before it kept, as a written table. All but the last return the
columns of ``documents``, and further ones if the documents have them. For every stage: rows with
a null or empty text, source or language are ordinary rows; a null doc_id is in no fold, class or
leak, so such rows pass; repeated rows are judged alike; long texts count whole; an empty table
gives an empty table. Where a stage differs, its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm import decontaminate, mixing, near_dup, quality_fm, sharding
from gridlens.llm.kneser_ney import fold
from gridlens.llm.shared import Scratch

#: Share of the tokens that the mixture stage draws.
MIX_SHARE = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject (score of 0.3 or more).

    Without labels of both kinds the score is the share of good labels, the same for all rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    machine = quality_fm.learn(docs, labels, metadata=("n_chars",))
    return quality_fm.keep_good(docs, machine, metadata=("n_chars",))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Shingles of five words and a similarity of 0.8, the rule for near-duplicate stages (the query
    of the operator has a contract of its own). Of rows that share an id and text one stays; rows
    that share an id alone can't be told apart by it and stay if the id does.
    """
    found = near_dup.near_duplicates(docs, size=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    # Rows that share an id are told apart by their texts; of equal texts under one id one stays.
    if kept.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    again = Window.partitionBy("doc_id", "text").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")])
    (number,) = mixing.fresh(["number"], docs.columns)
    return kept.withColumn(number, F.row_number().over(again)).where(F.col("doc_id").isNull() | (F.col(number) == 1)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Ids with a leak in any of their rows go."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaky = Scratch(spark, "leaks").write(leaks.select("doc_id").distinct(), "ids")
    return docs.join(leaky, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to source, language and topic marginals."""
    return mixing.drawn(docs, share=MIX_SHARE)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, with text, in 16 shards of near-equal bytes: cut into a folder each, and read from there."""
    return sharding.write_shards(sharding.minimax_shards(docs, keep_text=True), Scratch(spark, "shards").path("shards"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: Hashed features, signatures and latent vectors have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(f"stage{k - 1}")
    return docs
