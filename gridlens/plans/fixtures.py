"""The given tables in the shape of meter tables: a user is a recording, an event a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, i (sample number from 0), ts, ts_us, p, q, event_type, event_id."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("rid"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("i"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("ts_us"),
        F.col("value").alias("p"),
        (F.regexp_extract("props", "-?[0-9]+", 0).cast("long") - 50).cast("double").alias("q"),
        "event_type",
        "event_id",
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with a channel ``v`` that has missing, infinite and not-a-number samples."""
    i, e = F.col("i"), F.col("event_id")
    hole = (i % 9 == 4) | (i % 40).between(20, 27) | (i % 40 < 2)
    v = F.when(hole, F.lit(None).cast("double")).when(e % 101 == 0, F.lit(float("inf"))).when(e % 103 == 0, F.lit(float("nan"))).otherwise(F.col("p"))
    return readings(spark, sf_dir).withColumn("v", v)


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings split over three phases by fixed shares."""
    r = readings(spark, sf_dir)
    for k, share in enumerate((0.5, 0.3, 0.2), start=1):
        r = r.withColumn(f"p{k}", share * F.col("p")).withColumn(f"q{k}", share * F.col("q"))
    return r


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, appliance, sample, p, q, phase (0: all three)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scenario"), (F.col("l_partkey") % 9).alias("appliance"), (F.col("l_suppkey") % 4).alias("sample"),
        F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), (F.col("l_linenumber") % 4).alias("phase"),
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, mag and ang: 39 harmonics of orders 2 to 40."""
    first = F.slice("embedding", 1, 39)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform(first, lambda x: F.abs(x.cast("double"))).alias("mag"), F.transform(first, lambda x: x.cast("double") * 3.0).alias("ang")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as window predictions: probability, truth and decision for each family."""
    return readings(spark, sf_dir).select(
        "rid", F.expr("i div 5").alias("win"), F.col("event_type").alias("family"), "p", F.least(F.lit(1.0), F.col("p") / 100).alias("prob"),
        (F.col("p") > 50).cast("int").alias("truth"), (F.col("p") + F.col("q") > 50).cast("int").alias("pred"), "q",
    )
