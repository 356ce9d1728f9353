"""Alarms, partitions around a fault, per-job metrics and their stratified summaries."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.shipping import ship

BREACH, PERSISTENT, EVENT = 1, 2, 4
EXPECTED_SUBTYPES = ("accelerated_aging", "imu_bias_injection", "loose_connector", "partial_occlusion", "supply_voltage_droop")


def pack_flags(*bits: Column) -> Column:
    out = F.lit(0)
    for i, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.coalesce(b, F.lit(False)).cast("int"), i))
    return out


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def persistent(breach: Column, order: str = "ts_ms", key: str = "recording_id") -> Column:
    """Breach at this window and the one before."""
    return breach & F.coalesce(F.lag(breach).over(Window.partitionBy(key).orderBy(order)), F.lit(False))


def partition(ts: Column, start: Column, end: Column, fault: Column) -> Column:
    """calibration, then pre between its end and the fault, then post; null for what is in none."""
    inside = (ts >= start) & (ts < end)
    return F.when(inside, "calibration").when((ts >= end) & (ts < fault), "pre").when(ts >= fault, "post")


def partition_legacy(ts: Column, start: Column, end: Column, fault: Column) -> Column:
    """The older rule: all from the fault on is post, even inside calibration."""
    return F.when(ts >= fault, "post").when((ts >= start) & (ts < end), "calibration").otherwise("pre")


def job_metrics(rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """Counts, rates, means and latencies by partition from (key, ts_ms, shi, flags, part, fault_start), in one aggregate."""
    part = F.col("part")
    breach, steady, event = (has_flag(F.col("flags"), b) for b in (BREACH, PERSISTENT, EVENT))
    aggregates = [F.count("*").alias("n_windows")]
    for name, p in (("calibration", "calibration"), ("pre_fault", "pre"), ("post_fault", "post")):
        inside = part == p
        n = F.count_if(inside)
        aggregates += [n.alias(f"n_{name}"), F.avg(F.when(inside, F.col("shi").cast("double"))).alias(f"{name}_shi_mean")]
        for kind, flag in (("breach", breach), ("persistent", steady), ("event", event)):
            aggregates += [F.count_if(inside & flag).alias(f"{name}_{kind}_count"), F.avg(F.when(inside, flag.cast("double"))).alias(f"{name}_{kind}_rate")]
    for kind, flag in (("breach", breach), ("persistent", steady), ("event", event)):
        aggregates += [F.count_if(flag).alias(f"whole_{kind}_count"), F.avg(flag.cast("double")).alias(f"whole_{kind}_rate")]
    fault = F.max("fault_start")
    for name, flag in (("detection", steady), ("event", event)):
        aggregates.append(((F.min(F.when((part == "post") & flag, F.col("ts_ms"))) - fault) / 1000).alias(f"{name}_latency_s"))
    out = rows.groupBy(key).agg(*aggregates)
    return out.withColumn("detected", F.col("detection_latency_s").isNotNull()).withColumn("event_detected", F.col("event_latency_s").isNotNull())


def stratified_summary(jobs: DataFrame) -> DataFrame:
    """Groups by confidence and onset class, by subtype, by family, and by subtype and target; never a grand total.

    ``jobs``: n_post_fault, n_pre_fault, detected, detection_latency_s, pre_fault_breach_count and the grouping columns
    confidence, onset, subtype, family, target. One pass expands each row to its four groups.
    """
    sets = [["confidence", "onset"], ["subtype"], ["family"], ["subtype", "target"]]
    keys = ["confidence", "onset", "subtype", "family", "target"]
    columns = [F.col(k) for k in keys]
    usable = F.col("n_post_fault") > 0
    latency = F.when(usable & F.col("detected"), F.col("detection_latency_s"))
    out = jobs.groupingSets([[F.col(k) for k in s] for s in sets], *columns).agg(
        F.grouping_id(*keys).alias("level"),
        F.count("*").alias("jobs"),
        F.count_if(usable).alias("evaluated"),
        F.count_if(usable & F.col("detected")).alias("detected"),
        F.percentile(latency, F.lit(0.5)).alias("latency_median"),
        F.percentile(latency, F.lit(0.25)).alias("latency_q1"),
        F.percentile(latency, F.lit(0.75)).alias("latency_q3"),
        F.count_if(F.col("n_pre_fault") > 0).alias("jobs_with_pre_fault"),
        F.sum("n_pre_fault").alias("pre_trials"),
        F.sum("pre_fault_breach_count").alias("pre_breaches"),
    )
    return out.where(~((F.col("level") == 26) & (F.coalesce(F.col("target"), F.lit("")) == "")))


def beta_quantile(p: float, a: float, b: float) -> float:
    """By bisection on the binomial form of the incomplete beta function for whole a, b."""
    import math

    n = int(a + b - 1)

    def tail(x: float) -> float:
        logs = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(x) + (n - k) * math.log1p(-x) for k in range(int(a), n + 1))
        return math.fsum(math.exp(v) for v in logs)

    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if tail(mid) < p else (lo, mid)
    return (lo + hi) / 2


def exact_interval(successes: int, trials: int, alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Clopper-Pearson bounds of a proportion; none without trials."""
    if trials <= 0:
        return None, None
    lower = 0.0 if successes == 0 else beta_quantile(alpha / 2, successes, trials - successes + 1)
    upper = 1.0 if successes == trials else beta_quantile(1 - alpha / 2, successes + 1, trials - successes)
    return lower, upper


def with_interval(rows: DataFrame, successes: str, trials: str, prefix: str = "ci") -> DataFrame:
    """Adds the bounds to a summary; one Arrow batch function over its few rows."""
    ship(rows.sparkSession)

    @F.pandas_udf("struct<lower:double,upper:double>")
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_interval(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["lower", "upper"], dtype=float)

    b = bounds(F.col(successes).cast("long"), F.col(trials).cast("long"))
    return rows.withColumn(prefix, b).withColumns({f"{prefix}_lower": F.col(prefix)["lower"], f"{prefix}_upper": F.col(prefix)["upper"]}).drop(prefix)
