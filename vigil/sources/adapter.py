"""The driver's tables as recordings: (recording_id, seq, ts_ms, x[, y, z])."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.windows import number_samples

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Events as recordings, in order of time."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col(key).cast("string").alias("recording_id"), F.expr("unix_millis(cast(ts AS timestamp))").alias("ts_ms"), F.expr("unix_micros(cast(ts AS timestamp))").alias("ts_us"), "event_id", F.col("value").alias("x"))
    return number_samples(rows, ["ts_us", "event_id"])


def injected(rows: DataFrame) -> DataFrame:
    """Adds observed: the clean value, raised by 5 in every seventh event."""
    changed = F.col("event_id") % 7 == 0
    return rows.withColumn("observed", F.when(changed, F.col("x") + 5).otherwise(F.col("x"))).withColumn("changed", changed)


def binary(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.when(F.col("x") > 50, 1.0).otherwise(0.0))


def samples_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recordings of three axes, one for each supplier."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("recording_id"),
        F.expr("unix_millis(cast(l_shipdate AS timestamp))").alias("ts_ms"),
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"),
    )
    return number_samples(rows, ["ts_ms", "l_orderkey", "l_linenumber", "l_extendedprice"])


def windows64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as ready-made windows of 64 samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("win_no"), F.expr("transform(embedding, v -> cast(v AS double))").alias("v"))


def timeline(spark: SparkSession) -> DataFrame:
    """Six predictions around a fault at 5 s, calibration being [1 s, 3 s)."""
    rows = [(1000, 0.9, 0), (2000, 0.8, 0), (3000, 0.7, 1), (4000, 0.6, 0), (5000, 0.4, 1), (6000, 0.3, 7)]
    return spark.createDataFrame([("job", *r) for r in rows], "recording_id string, ts_ms long, shi double, flags int")
