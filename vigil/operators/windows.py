"""Ordered, count-based windows over recordings.

A recording isn't handled by one task: samples are numbered inside time buckets, to which the counts of earlier
buckets are added, and every sample is sent to the few windows that hold it. So one long recording is spread over as
many tasks as it has buckets and windows, and nothing larger than a bucket or a window meets in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 86_400_000


def number_samples(rows: DataFrame, order: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Adds seq, from 1, to the samples of each recording (recording_id, ts_ms), in the order given (time first)."""
    keyed = rows.withColumn("bucket", F.floor(F.col("ts_ms") / F.lit(bucket_ms)))
    counts = keyed.groupBy("recording_id", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("recording_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("recording_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("recording_id", "bucket").orderBy(*order))
    numbered = keyed.withColumn("place", place)
    return numbered.join(offsets, ["recording_id", "bucket"]).withColumn("seq", F.col("place") + F.col("offset")).drop("bucket", "place", "offset")


def sliding_windows(rows: DataFrame, size: int, stride: int, values: tuple[str, ...] = ("x",), key: str = "recording_id") -> DataFrame:
    """One row per full window: key, win_no (from 1), end_ts, end_value, and for each value column an array of its samples.

    A window ends at sample ``size`` and every ``stride`` samples after; what doesn't fill a window is dropped.
    """
    held = F.struct("seq", "ts_ms", *values)
    if size % stride == 0:
        # blocks of one stride first: each sample is sent once, and only whole blocks go to the windows that hold them
        many = size // stride
        block = F.floor((F.col("seq") - 1) / stride)
        blocks = rows.groupBy(key, block.alias("b")).agg(F.sort_array(F.collect_list(held)).alias("s")).where(F.size("s") == stride)
        spread = blocks.select(key, "s", F.explode(F.sequence(F.greatest(F.col("b") - (many - 1), F.lit(0)), F.col("b"))).alias("k"))
        grouped = spread.groupBy(key, "k").agg(F.flatten(F.sort_array(F.collect_list("s"))).alias("s")).where(F.size("s") == size)
    else:
        # sample n lies in windows k (from 0) with k * stride < n <= k * stride + size
        first = F.greatest(F.ceil((F.col("seq") - size) / stride), F.lit(0))
        last = F.floor((F.col("seq") - 1) / stride)
        spread = rows.where(first <= last).select(key, "seq", "ts_ms", *values, F.explode(F.sequence(first, last)).alias("k"))
        grouped = spread.groupBy(key, "k").agg(F.sort_array(F.collect_list(held)).alias("s")).where(F.size("s") == size)
    end = F.col("s")[size - 1]
    names = {v: "v" if v == "x" else f"v_{v}" for v in values}
    arrays = [F.col("s").getField(v).cast("array<double>").alias(n) for v, n in names.items()]
    return grouped.select(key, (F.col("k") + 1).alias("win_no"), end["ts_ms"].alias("end_ts"), end[values[0]].cast("double").alias("end_value"), *arrays)


def window_times(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """As sliding_windows, with the timestamps of the samples as array ts."""
    return sliding_windows(rows.withColumn("t", F.col("ts_ms").cast("double")), size, stride, ("x", "t")).withColumnRenamed("v_t", "ts")


def first_window_rate(rows: DataFrame, size: int) -> DataFrame:
    """Samples a second: 1000 over the median positive step inside the first full window, else 1."""
    head = rows.where(F.col("seq") <= size)
    step = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy("recording_id").orderBy("seq"))
    steps = head.withColumn("step", step)
    positive = F.when(F.col("step") > 0, F.col("step"))
    full = steps.groupBy("recording_id").agg(F.count("*").alias("n"), F.expr("percentile(step, 0.5) FILTER (WHERE step > 0)").alias("median"), F.count(positive).alias("k"))
    return full.where(F.col("n") == size).select("recording_id", F.when(F.col("k") > 0, 1000 / F.col("median")).otherwise(F.lit(1.0)).alias("fs"))


def sampling_rate(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """First and last time, number of samples, and the rate from the first ``most`` positive steps; no rate without one."""
    w = Window.partitionBy("recording_id").orderBy("seq")
    steps = rows.withColumn("step", F.col("ts_ms") - F.lag("ts_ms").over(w))
    ranked = steps.withColumn("rank", F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).over(w))
    return ranked.groupBy("recording_id").agg(
        F.min_by("ts_ms", "seq").alias("first_ts"), F.max_by("ts_ms", "seq").alias("last_ts"), F.count("*").alias("n"),
        (1000 / F.expr(f"percentile(step, 0.5) FILTER (WHERE step > 0 AND rank <= {most})")).alias("fs"),
    )


def timestamp_bounds(rows: DataFrame) -> DataFrame:
    """First and last time and count of each recording, and how many steps go back in time (which makes it invalid)."""
    back = F.col("ts_ms") < F.lag("ts_ms").over(Window.partitionBy("recording_id").orderBy("seq"))
    marked = rows.withColumn("back", F.coalesce(back, F.lit(False)))
    return marked.groupBy("recording_id").agg(F.min_by("ts_ms", "seq").alias("first_ts"), F.max_by("ts_ms", "seq").alias("last_ts"), F.count("*").alias("n"), F.count_if("back").alias("decreasing"))


def aligned_join(clean: DataFrame, variant: DataFrame) -> DataFrame:
    """Clean and observed samples of the same place; see ``alignment_check`` for what must hold."""
    return clean.select("recording_id", "seq", "ts_ms", F.col("x").alias("clean")).join(variant.select("recording_id", "seq", F.col("observed")), ["recording_id", "seq"])


def alignment_check(clean: DataFrame, variant: DataFrame) -> DataFrame:
    """Per recording, samples of only one side; any makes the pair invalid."""
    a, b = clean.select("recording_id", "seq", F.lit(1).alias("a")), variant.select("recording_id", "seq", F.lit(1).alias("b"))
    both = a.join(b, ["recording_id", "seq"], "full_outer")
    return both.groupBy("recording_id").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count("*").alias("n"))


def require(rows: DataFrame, broken: str, message: str) -> None:
    """Fails with the message and the first recordings for which the condition holds."""
    bad = [r["recording_id"] for r in rows.where(broken).select("recording_id").take(5)]
    if bad:
        raise ValueError(f"{message}: {', '.join(map(str, bad))}")
