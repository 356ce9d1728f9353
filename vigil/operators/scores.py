"""Calibration statistics and health scores, as aggregates and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.config import NUMERIC_FLOOR, RELATIVE_TOLERANCE, Z_CLIP, ReferenceConfig
from vigil.functions.arrays import let

REFERENCE = ReferenceConfig()


def with_calibration(windows: DataFrame, rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Marks windows that end in the first ``share`` of their recording's samples."""
    sizes = rows.groupBy("recording_id").agg(F.max("seq").alias("n"))
    edge = rows.join(sizes, "recording_id").where(F.col("seq") == F.greatest(F.floor(F.col("n") * share), F.lit(1))).select("recording_id", F.col("ts_ms").alias("calibration_end"))
    return windows.join(edge, "recording_id").withColumn("calibration", F.col("end_ts") <= F.col("calibration_end"))


def unpivot(features: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return features.unpivot(keys, names, "feature", "value")


def calibration_scale(values: DataFrame, keys: list[str], tolerance: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Mean and scale of value by key: the sample deviation, but not below a share of the mean magnitude."""
    scale = F.greatest(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), tolerance * F.avg(F.abs("value")), F.lit(NUMERIC_FLOOR))
    return values.groupBy(*keys).agg(F.avg("value").alias("mean"), scale.alias("scale"), F.count("*").alias("n"))


def distance(values: DataFrame, keys: list[str], reference: str = "mean", clip: float = Z_CLIP) -> DataFrame:
    """Root mean square of clipped, scaled distances of value from ``reference`` over the features of a window."""
    z = F.least(F.abs(F.col("value") - F.col(reference)) / F.col("scale"), F.lit(clip))
    return values.groupBy(*keys).agg(F.sqrt(F.avg(z * z)).alias("distance"))


def distance_health(d: Column) -> Column:
    return 100 * F.exp(-d)


def envelope_health(raw: Column, threshold: Column, scale: Column) -> Column:
    """1 up to the threshold, then falling with the excess in scales."""
    return 1 / (1 + F.greatest(raw - threshold, F.lit(0.0)) / F.greatest(scale, F.lit(1e-12)))


def logistic_health(score: Column, median: Column, threshold: Column, odds: float = REFERENCE.odds, rising: bool = False) -> Column:
    """0.5 at the threshold, odds : 1 at the median; without a gap between them the median gets that health and the threshold moves."""
    gap = F.abs(threshold - median)
    floor = F.greatest(F.abs(median) * 1e-9, F.lit(1e-12))
    thin = gap < floor
    scale = F.when(thin, floor).otherwise(gap)
    at = F.when(thin, median - floor if rising else median + floor).otherwise(threshold)
    argument = math.log(odds) * (score - at) / scale
    argument = -argument if rising else argument
    return 1 / (1 + F.exp(F.greatest(F.least(argument, F.lit(60.0)), F.lit(-60.0))))


def geometric_fusion(parts: list[tuple[Column, Column]]) -> Column:
    """Weighted geometric mean of healths in [1e-6, 1]."""
    return F.exp(sum((w * F.log(F.greatest(F.least(h, F.lit(1.0)), F.lit(1e-6))) for h, w in parts), F.lit(0.0)))


def reliability_weights(healths: DataFrame, keys: list[str], config: ReferenceConfig = REFERENCE) -> DataFrame:
    """(keys, branch, weight) from (keys, branch, health): inverse spread, held near the median, summing to one."""
    spread = healths.groupBy(*keys, "branch").agg((1 / F.greatest(F.stddev_pop("health"), F.lit(config.weight_floor))).alias("w"))
    middle = spread.groupBy(*keys).agg(F.expr("percentile(w, 0.5)").alias("m"))
    held = spread.join(middle, keys).withColumn("w", F.greatest(F.least("w", F.col("m") * config.weight_ratio), F.col("m") / config.weight_ratio))
    total = held.groupBy(*keys).agg(F.sum("w").alias("t"))
    return held.join(total, keys).select(*keys, "branch", (F.col("w") / F.col("t")).alias("weight"))


def normalised(raw: Column, middle: Column, upper: Column) -> Column:
    """0 at the median, 1 at the upper percentile of calibration."""
    return F.greatest(F.least((raw - middle) / F.greatest(upper - middle, F.lit(1e-12)), F.lit(1.0)), F.lit(0.0))


def pairwise_reliability(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reliability) of value: one less the mean relative distance of a point to all others.

    Sums of distances come from running sums over the sorted values, not from pairs. A key's values are one window of
    rows (calibration windows of a recording, thousands at most).
    """
    w = Window.partitionBy(*keys)
    order = w.orderBy("value", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = values.withColumn("tie", F.monotonically_increasing_id()) if "tie" not in values.columns else values
    rows = rows.withColumn("i", F.row_number().over(w.orderBy("value", "tie")) - 1).withColumn("n", F.count("*").over(w))
    rows = rows.withColumn("before", F.coalesce(F.sum("value").over(order), F.lit(0.0))).withColumn("all", F.sum("value").over(w))
    x, i, n = F.col("value"), F.col("i"), F.col("n")
    after = F.col("all") - F.col("before") - x
    d = (x * i - F.col("before") + after - x * (n - i - 1)) / n
    found = rows.withColumn("d", d).groupBy(*keys).agg(F.max("d").alias("m"), F.avg("d").alias("a"), F.max("n").alias("n"))
    share = F.greatest(F.least(1 - F.col("a") / F.col("m"), F.lit(1.0)), F.lit(0.0))
    return found.select(*keys, F.when((F.col("n") < 2) | (F.col("m") <= 1e-12), F.lit(1.0)).otherwise(share).alias("reliability"))


def feature_categories(values: DataFrame, keys: list[str], mandatory: tuple[str, ...], stable: int = 8, sensitive: int = 4, segments: int = 4) -> DataFrame:
    """(keys, feature, category, expert) of the selected features of (keys, feature, position, win_no, value).

    Features are ordered by the variation of their means over ``segments`` runs of windows: the first are stable, the
    last sensitive; mandatory ones are selected anyway and take precedence, then stable ones.
    """
    part = F.ntile(segments).over(Window.partitionBy(*keys, "feature").orderBy("win_no"))
    means = values.withColumn("part", part).groupBy(*keys, "feature", "position", "part").agg(F.avg("value").alias("m"))
    cv = means.groupBy(*keys, "feature", "position").agg((F.stddev_samp("m") / (F.abs(F.avg("m")) + 1e-12)).alias("cv"))
    w = Window.partitionBy(*keys)
    ranked = cv.withColumn("rank", F.row_number().over(w.orderBy("cv", "position"))).withColumn("n", F.count("*").over(w))
    needed = F.lit(False)
    for suffix in mandatory:
        needed = needed | F.col("feature").endswith(suffix)
    category = F.when(needed, "mandatory").when(F.col("rank") <= stable, "stable").when(F.col("rank") > F.col("n") - sensitive, "sensitive")
    chosen = ranked.withColumn("category", category).where("category IS NOT NULL")
    expert = F.when(F.col("category") == "mandatory", 1.0).when(F.col("category") == "stable", 0.8).otherwise(0.5)
    return chosen.select(*keys, "feature", "cv", "category", expert.alias("expert"))


def composite_weight(expert: Column, reliability: Column) -> Column:
    """Expert weights are given relative to the largest."""
    return expert / F.greatest(1 + expert - reliability, F.lit(1e-12))


def running(values: Column, state: Column, step, block: int = 256) -> Column:  # noqa: ANN001
    """Array of step(state, x) results, each the state for the next: a sequential recursion inside the JVM.

    Results are gathered in blocks, so that what is copied grows with the block and not with the whole array.
    """
    empty = F.array().cast("array<double>")
    pair = lambda s, out: F.struct(s.alias("s"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        return let(step(acc["s"], x), lambda y: pair(y, F.concat(acc["out"], F.array(y))))

    def many(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, pair(acc["s"], empty), one), lambda i: pair(i["s"], F.concat(acc["out"], F.array(i["out"]))))

    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block).cast("int") - 1, F.lit(0)))
    parts = F.transform(starts, lambda k: F.slice(values, k * block + 1, block))
    return F.flatten(F.aggregate(parts, pair(state, F.array().cast("array<array<double>>")), many)["out"])


BRANCHES = ["isolation", "mahalanobis", "ewma"]


def _branches(raw: DataFrame) -> DataFrame:
    return raw.where("isolation IS NOT NULL").unpivot(["recording_id", "win_no", "calibration"], BRANCHES, "branch", "value")


def _calibration_quantiles(rows: DataFrame, keys: list[str], value: str, **quantiles: float) -> DataFrame:
    return rows.where("calibration").groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in quantiles.items()])


def fused_health(raw: DataFrame, upper: float = 0.99, alarm: float = 0.05) -> DataFrame:
    """(recording_id, win_no, calibration, isolation_health, mahalanobis_health, ewma_health, shi, alarm_threshold, breach, persistent).

    Each branch's raw value counts from its calibration median to its upper percentile; health is one less the mean of
    the three. Recordings without raw values (too few calibration windows) give no rows.
    """
    v = _branches(raw)
    q = _calibration_quantiles(v, ["recording_id", "branch"], "value", middle=0.5, high=upper)
    v = v.join(q, ["recording_id", "branch"]).withColumn("health", 1 - normalised(F.col("value"), F.col("middle"), F.col("high")))
    wide = v.groupBy("recording_id", "win_no", "calibration").agg(*[F.max(F.when(F.col("branch") == b, F.col("health"))).alias(f"{b}_health") for b in BRANCHES], F.avg("health").alias("shi"))
    low = _calibration_quantiles(wide, ["recording_id"], "shi", alarm_threshold=alarm)
    out = wide.join(low, "recording_id").withColumn("breach", F.col("shi") < F.col("alarm_threshold"))
    before = F.coalesce(F.lag("breach").over(Window.partitionBy("recording_id").orderBy("win_no")), F.lit(False))
    return out.withColumn("persistent", F.col("breach") & before)


def reference_health(raw: DataFrame, config: ReferenceConfig = REFERENCE) -> DataFrame:
    """(recording_id, win_no, calibration, raw, shi, alarm): logistic branch healths, fused by reliability and calibrated once more.

    A branch is at a half where its calibration has the upper ``target_fpr`` of values; the fused health is moved so that
    the lower ``target_fpr`` of calibration is at a half and its median at the odds given.
    """
    v = _branches(raw)
    q = _calibration_quantiles(v, ["recording_id", "branch"], "value", middle=0.5, high=1 - config.target_fpr)
    v = v.join(q, ["recording_id", "branch"]).withColumn("health", logistic_health(F.col("value"), F.col("middle"), F.col("high"), config.odds))
    weights = reliability_weights(v.where("calibration"), ["recording_id"], config)
    log = F.col("weight") * F.log(F.greatest(F.least("health", F.lit(1.0)), F.lit(1e-6)))
    fused = v.join(weights, ["recording_id", "branch"]).groupBy("recording_id", "win_no", "calibration").agg(F.exp(F.sum(log)).alias("raw"))
    q = _calibration_quantiles(fused, ["recording_id"], "raw", low=config.target_fpr, middle=0.5)
    shi = logistic_health(F.col("raw"), F.col("middle"), F.col("low"), config.odds, rising=True)
    out = fused.join(q, "recording_id").withColumn("shi", shi)
    return out.select("recording_id", "win_no", "calibration", "raw", "shi", (F.col("shi") < 0.5).alias("alarm"))
