"""The query catalogue: each query applies operators to recordings made of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.config import QUERY_STRIDE, QUERY_WINDOW
from vigil.functions import arrays as A
from vigil.functions.shipping import ship
from vigil.operators import labels as L
from vigil.operators import metrics as M
from vigil.operators import rules as R
from vigil.operators import scores as S
from vigil.operators import selection as C
from vigil.operators import windows as W
from vigil.plans.oracle import MEMBERS, ORACLE
from vigil.sources import adapter as D

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FEATURES = ["mean", "variance", "rms", "skewness", "kurtosis", "msd"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + 0.0


def ev_windows(spark: SparkSession, sf: str) -> DataFrame:
    return W.sliding_windows(D.samples(spark, sf), QUERY_WINDOW, QUERY_STRIDE)


def features(windows: DataFrame) -> DataFrame:
    v = F.col("v")
    keep = [c for c in windows.columns if c != "v"]
    return windows.select(*keep, A.mean(v).alias("mean"), A.variance(v).alias("variance"), A.rms(v).alias("rms"), A.skewness(v).alias("skewness"), A.kurtosis(v).alias("kurtosis"), A.mean_squared_step(v).alias("msd"))


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows (recording_id, win_no, end_ts, calibration, feature, value)."""
    rows = D.samples(spark, sf)
    marked = S.with_calibration(features(W.sliding_windows(rows, QUERY_WINDOW, QUERY_STRIDE)), rows)
    return S.unpivot(marked, FEATURES, ["recording_id", "win_no", "end_ts", "calibration"])


def distances(spark: SparkSession, sf: str) -> DataFrame:
    values = calibrated(spark, sf)
    scale = S.calibration_scale(values.where("calibration"), ["recording_id", "feature"])
    return S.distance(values.join(scale, ["recording_id", "feature"]), ["recording_id", "win_no", "end_ts", "calibration"])


# windows and features ------------------------------------------------------------------------------------------------


@query
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return ev_windows(spark, sf).select("recording_id", "win_no", "end_ts", "end_value", F.size(v).alias("n"), v[0].alias("first_value"), r(A.mean(v), 9).alias("mean"))


@query
def sliding_windows_short(spark: SparkSession, sf: str) -> DataFrame:
    w = W.sliding_windows(D.samples(spark, sf, "user_id"), 16, 4)
    return w.select("recording_id", "win_no", "end_ts", "end_value", r(A.mean(F.col("v")), 9).alias("mean"))


@query
def sliding_windows_xyz(spark: SparkSession, sf: str) -> DataFrame:
    w = W.sliding_windows(D.samples_xyz(spark, sf), 128, 64, ("x", "y", "z"))
    return w.select("recording_id", "win_no", "end_ts", r(A.mean(F.col("v")), 9).alias("mean_x"), r(A.rms(F.col("v_y")), 4).alias("rms_y"), r(A.variance(F.col("v_z"))).alias("variance_z"))


@query
def first_window_fs(spark: SparkSession, sf: str) -> DataFrame:
    return W.first_window_rate(D.samples(spark, sf), QUERY_WINDOW).select("recording_id", r("fs", 12).alias("fs"))


@query
def feat_time(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return ev_windows(spark, sf).select("recording_id", "win_no", r(A.mean(v), 9).alias("mean"), r(A.variance(v)).alias("variance"), r(A.rms(v)).alias("rms"))


@query
def feat_moments(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return ev_windows(spark, sf).select("recording_id", "win_no", r(A.skewness(v)).alias("skewness"), r(A.kurtosis(v)).alias("kurtosis"))


@query
def feat_zcr(spark: SparkSession, sf: str) -> DataFrame:
    centred = F.transform("v", lambda x: x - 50)
    return ev_windows(spark, sf).select("recording_id", "win_no", r(A.sign_change_rate(centred), 9).alias("zcr"))


@query
def feat_stability(spark: SparkSession, sf: str) -> DataFrame:
    return ev_windows(spark, sf).select("recording_id", "win_no", r(A.mean_squared_step(F.col("v"))).alias("msd"))


@query
def feat_mean_abs(spark: SparkSession, sf: str) -> DataFrame:
    return ev_windows(spark, sf).select("recording_id", "win_no", r(A.mean_abs(F.col("v")), 9).alias("mean_abs"))


@query
def calibration_scale(spark: SparkSession, sf: str) -> DataFrame:
    scale = S.calibration_scale(calibrated(spark, sf).where("calibration"), ["recording_id", "feature"])
    return scale.select("recording_id", "feature", "n", r("mean").alias("mean"), r("scale").alias("scale"))


@query
def baseline_score(spark: SparkSession, sf: str) -> DataFrame:
    d = distances(spark, sf)
    return d.select("recording_id", "win_no", "end_ts", r("distance").alias("distance"), r(S.distance_health(F.col("distance"))).alias("shi"))


# aligned variants ----------------------------------------------------------------------------------------------------


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    return D.injected(D.samples(spark, sf))


@query
def aligned_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pair(spark, sf)
    return W.aligned_join(rows, rows).select("recording_id", "seq", "ts_ms", "clean", "observed")


@query
def alignment_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pair(spark, sf)
    return W.alignment_check(rows, rows.where("event_id % 1000 <> 3"))


def _pair_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pair(spark, sf).withColumn("c", F.col("changed").cast("double"))
    return W.sliding_windows(rows, QUERY_WINDOW, QUERY_STRIDE, ("x", "observed", "c"))


@query
def injected_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _pair_windows(spark, sf).select("recording_id", "win_no", r(A.mean(F.col("v_c")), 9).alias("fraction"))


def _simple(spark: SparkSession, sf: str) -> DataFrame:
    w = _pair_windows(spark, sf)
    keys = ["recording_id", "win_no", "end_ts"]
    fraction = w.select(*keys, A.mean(F.col("v_c")).alias("fraction"))
    clean = S.unpivot(features(w.select(*keys, "v")), FEATURES, keys)
    seen = S.unpivot(features(w.select(*keys, F.col("v_observed").alias("v"))), FEATURES, keys).withColumnRenamed("value", "observed")
    scale = S.calibration_scale(clean, ["recording_id", "feature"]).drop("mean", "n")
    both = clean.join(seen, [*keys, "feature"]).withColumnsRenamed({"value": "clean", "observed": "value"}).join(scale, ["recording_id", "feature"])
    d = S.distance(both, keys, "clean").join(fraction, keys)
    return d.withColumn("shi", F.when(F.col("fraction") == 0, 100.0).otherwise(S.distance_health(F.col("distance"))))


@query
def simple_score(spark: SparkSession, sf: str) -> DataFrame:
    return _simple(spark, sf).select("recording_id", "win_no", r("distance").alias("distance"), r("shi").alias("shi"))


@query
def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("fraction") > 0
    return _simple(spark, sf).groupBy("recording_id").agg(
        F.count("*").alias("windows"), F.count_if(hit).alias("injected"), r(F.avg("shi")).alias("mean_shi"),
        r(F.avg(F.when(hit, F.col("shi")))).alias("mean_injected"), r(F.avg(F.when(~hit, F.col("shi")))).alias("mean_clean"),
        r(F.min("shi")).alias("min_shi"), r(F.max("shi")).alias("max_shi"), F.min("end_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"),
    )


# recordings and rules ------------------------------------------------------------------------------------------------


@query
def ts_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return W.timestamp_bounds(D.samples(spark, sf)).select("recording_id", "first_ts", "last_ts", "n")


@query
def monotone_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.samples(spark, sf)
    return W.timestamp_bounds(rows.withColumn("ts_ms", F.when(F.col("event_id") % 500 == 7, F.col("ts_ms") - 90_000_000).otherwise(F.col("ts_ms")))).select("recording_id", "n", "decreasing")


@query
def sampling_rate(spark: SparkSession, sf: str) -> DataFrame:
    return W.sampling_rate(D.samples(spark, sf)).select("recording_id", "first_ts", "last_ts", "n", r("fs", 12).alias("fs"))


def members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEMBERS, "archive string, member string, sensor string")


@query
def member_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("member")
    return members(spark).select("member", R.member_sensor(m).alias("found"), R.valid_member(m).alias("valid"))


@query
def protocol_rules(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark).select("member", R.protocol(F.col("member")).alias("p")).select("member", "p.*")


@query
def protocol_override(spark: SparkSession, sf: str) -> DataFrame:
    out = members(spark).withColumn("override", F.when(F.contains("member", F.lit("Experiment")), 5.0).when(F.contains("member", F.lit("IMU")), 0.0))
    return out.select("member", R.protocol(F.col("member"), F.col("override")).alias("p")).select("member", "p.*")


def _bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Every protocol against every recording's span: a fixed list of rules against one row per recording."""
    spans = W.timestamp_bounds(D.samples(spark, sf)).select("recording_id", "first_ts", "last_ts", F.lit(1).alias("one"))
    rules = members(spark).select("member", R.protocol(F.col("member")).alias("p"), F.lit(1).alias("one"))
    return spans.join(F.broadcast(rules), "one").drop("one")


@query
def calibration_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _bounds(spark, sf).select("recording_id", "member", R.calibration_bounds(F.col("first_ts"), F.col("last_ts"), F.col("p")).alias("b")).select("recording_id", "member", "b.*")


@query
def calibration_bounds_brb(spark: SparkSession, sf: str) -> DataFrame:
    ends = ev_windows(spark, sf).select("recording_id", "win_no", "end_ts")
    rows = ends.join(_bounds(spark, sf), "recording_id")
    inside = R.in_baseline(F.col("end_ts"), F.col("first_ts"), F.col("last_ts"), F.col("p"))
    return rows.groupBy("recording_id", "member").agg(F.count_if(inside).alias("inside"), F.count("*").alias("windows"))


def _interval(spark: SparkSession, sf: str) -> DataFrame:
    """Per recording: calibration over the first half, the fault at 60 % of its samples."""
    rows = D.samples(spark, sf)
    n = rows.groupBy("recording_id").agg(F.max("seq").alias("n"))
    at = lambda share: F.max(F.when(F.col("seq") == F.floor(F.col("n") * share), F.col("ts_ms")))
    return rows.join(n, "recording_id").groupBy("recording_id").agg(F.min("ts_ms").alias("start"), (at(0.5) + 1).alias("end"), at(0.6).alias("fault_start"))


@query
def calibration_range_join(spark: SparkSession, sf: str) -> DataFrame:
    ends = ev_windows(spark, sf).select("recording_id", "win_no", "end_ts")
    return ends.join(_interval(spark, sf), "recording_id").where("end_ts >= start AND end_ts < end").select("recording_id", "win_no", "end_ts")


@query
def min_calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = calibrated(spark, sf).where("feature = 'mean'")
    n = rows.groupBy("recording_id").agg(F.count_if("calibration").alias("n"))
    return n.select("recording_id", "n", F.when(F.col("n") >= 60, "ok").otherwise("too few calibration windows").alias("status"))


@query
def family_label(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark).select("archive", "member", R.family(F.col("archive")).alias("family"), R.family(F.col("archive"), True).alias("legacy_family"), R.subtype(F.col("member"), legacy=True).alias("legacy_subtype"))


def _context(spark: SparkSession) -> DataFrame:
    rows = members(spark).withColumn("family", R.family(F.col("archive")))
    return rows.withColumn("subtype", R.subtype(F.col("member"), F.col("family"))).withColumn("target", R.target(F.col("member"), F.col("family")))


@query
def fault_context(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark).select("archive", "member", "subtype", "target")


@query
def target_sensor_match(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark).select("member", "sensor", R.is_target(F.col("target"), F.col("sensor")).alias("is_target"))


@query
def safe_component(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark).select("member", R.safe_component(F.col("member")).alias("safe"))


@query
def job_ids(spark: SparkSession, sf: str) -> DataFrame:
    return members(spark).select("archive", "member", R.job_id(F.col("archive"), F.col("member"), F.col("sensor")).alias("job_id"))


@query
def missing_subtypes(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame([(s,) for s in M.EXPECTED_SUBTYPES], "subtype string")
    return expected.join(_context(spark).where("sensor <> 'pressure'"), "subtype", "left_anti")


@query
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    jobs = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("source"))
    done = D.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job"))
    return jobs.join(done, "job", "left_anti")


# alarms and metrics --------------------------------------------------------------------------------------------------


@query
def flag_pack(spark: SparkSession, sf: str) -> DataFrame:
    return D.samples(spark, sf).select("event_id", M.pack_flags(F.col("x") > 50, F.col("x") > 100, F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0).alias("flags"))


@query
def flag_unpack(spark: SparkSession, sf: str) -> DataFrame:
    flags = (F.col("event_id") % 8).cast("int")
    return D.samples(spark, sf).select("event_id", *[M.has_flag(flags, b).alias(n) for b, n in ((1, "breach"), (2, "persistent"), (4, "event"))])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with shi in [0, 1], flags and the recording's interval."""
    d = distances(spark, sf).withColumn("shi", r(S.distance_health(F.col("distance")), 6) / 100)
    low = d.where("calibration").groupBy("recording_id").agg(F.expr("percentile(shi, 0.05)").alias("low"))
    d = d.join(low, "recording_id").join(_interval(spark, sf), "recording_id").withColumnRenamed("end_ts", "ts_ms")
    d = d.withColumn("breach", F.col("shi") < F.col("low"))
    d = d.withColumn("persistent", M.persistent(F.col("breach"))).withColumn("event", F.col("win_no") % 9 == 0)
    d = d.withColumn("flags", M.pack_flags(F.col("breach"), F.col("persistent"), F.col("event")))
    return d.withColumn("part", M.partition(F.col("ts_ms"), F.col("start"), F.col("end"), F.col("fault_start")))


@query
def persistent_breach(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("recording_id", "win_no", "breach", "persistent")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return ev_windows(spark, sf).select("recording_id", "win_no", "end_ts").join(_interval(spark, sf), "recording_id")


@query
def partition_new(spark: SparkSession, sf: str) -> DataFrame:
    p = M.partition(F.col("end_ts"), F.col("start"), F.col("end"), F.col("fault_start"))
    return _parts(spark, sf).select("recording_id", "win_no", p.alias("part"))


@query
def partition_legacy(spark: SparkSession, sf: str) -> DataFrame:
    p = M.partition_legacy(F.col("end_ts"), F.col("start") + 86_400_000, F.col("fault_start") + 86_400_000, F.col("fault_start"))
    return _parts(spark, sf).select("recording_id", "win_no", p.alias("part"))


@query
def partition_invariant(spark: SparkSession, sf: str) -> DataFrame:
    p = M.partition(F.col("end_ts"), F.col("start") + 86_400_000, F.col("end"), F.col("fault_start"))
    rows = _parts(spark, sf).withColumn("part", p)
    return rows.groupBy("recording_id").agg(F.count("*").alias("windows"), F.count_if(F.col("part").isNull()).alias("unassigned"))


@query
def timeline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.timeline(spark).withColumn("fault_start", F.lit(5000))
    rows = rows.withColumn("part", M.partition(F.col("ts_ms"), F.lit(1000), F.lit(3000), F.col("fault_start")))
    m = M.job_metrics(rows)
    return m.select(*[r(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])


@query
def detection_latency(spark: SparkSession, sf: str) -> DataFrame:
    return M.job_metrics(_scored(spark, sf)).select("recording_id", "detected", "detection_latency_s", "event_detected", "event_latency_s")


@query
def alarm_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = M.job_metrics(_scored(spark, sf))
    return m.select("recording_id", "n_windows", *[c for k in ("breach", "persistent", "event") for c in (F.col(f"whole_{k}_count"), r(f"whole_{k}_rate", 9).alias(f"whole_{k}_rate"))])


@query
def job_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.job_metrics(_scored(spark, sf))
    return m.select(*[r(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])


@query
def event_branch(spark: SparkSession, sf: str) -> DataFrame:
    m = M.job_metrics(_scored(spark, sf))
    return m.select("recording_id", "n_windows", "whole_event_count", "calibration_event_count", "pre_fault_event_count", "post_fault_event_count", "event_detected")


@query
def calibration_health(spark: SparkSession, sf: str) -> DataFrame:
    m = M.job_metrics(_scored(spark, sf))
    return m.select("recording_id", "n_calibration", r("calibration_shi_mean").alias("calibration_shi_mean"), (F.col("calibration_shi_mean") < 0.7).alias("unhealthy"))


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as audited jobs, for the grouping queries."""
    o = D.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.element_at(F.array(*[F.lit(x) for x in ("protocol", "protocol_family", "limited", "assumed")]), (k % 4 + 1).cast("int")).alias("confidence"),
        F.when(F.col("o_custkey") % 3 == 0, "onset_at_recording_start").otherwise("delayed_onset").alias("onset"),
        F.element_at(F.array(*[F.lit(x) for x in M.EXPECTED_SUBTYPES]), (k % 5 + 1).cast("int")).alias("subtype"),
        F.when(k % 2 == 0, "A1_orbital_shaker").otherwise("B_faulty_hardware").alias("family"),
        F.when(k % 2 == 0, "").when(F.col("o_custkey") % 2 == 0, "imu").otherwise("current").alias("target"),
        (k % 6).alias("n_post_fault"), (k % 3).alias("n_pre_fault"), (k % 3 % 2).alias("pre_fault_breach_count"),
        (F.col("o_custkey") % 4 != 1).alias("detected"),
        (F.col("o_custkey") % 97).cast("double").alias("detection_latency_s"),
    )


@query
def grouping_sets_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = M.stratified_summary(_jobs(spark, sf)).drop("level")
    return out.select(*[r(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes])


@query
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.when(F.col("detected") & (F.col("n_post_fault") > 0), F.col("detection_latency_s"))
    return _jobs(spark, sf).groupBy("subtype").agg(*[r(F.percentile(hit, F.lit(q)), 9).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


@query
def clopper_pearson(spark: SparkSession, sf: str) -> DataFrame:
    summary = _jobs(spark, sf).where("n_post_fault > 0").groupBy("subtype").agg(F.count_if("detected").alias("k"), F.count("*").alias("n"))
    return M.with_interval(summary, "k", "n")


@query
def report_rate_check(spark: SparkSession, sf: str) -> DataFrame:
    m = M.job_metrics(_scored(spark, sf)).select("recording_id", F.col("whole_breach_rate").alias("derived"))
    report = _scored(spark, sf).groupBy("recording_id").agg(F.avg(F.col("breach").cast("double")).alias("reported"))
    report = report.withColumn("reported", F.when(F.col("recording_id") == "click", F.col("reported") + 0.001).otherwise(F.col("reported")))
    a, b = F.col("derived"), F.col("reported")
    close = F.abs(a - b) <= F.greatest(1e-7 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-7))
    return m.join(report, "recording_id").select("recording_id", close.alias("matches"))


@query
def window_count_check(spark: SparkSession, sf: str) -> DataFrame:
    found = ev_windows(spark, sf).groupBy("recording_id").agg(F.count("*").alias("found"))
    n = D.samples(spark, sf).groupBy("recording_id").agg(F.max("seq").alias("n"))
    expected = n.select("recording_id", F.floor((F.col("n") - QUERY_WINDOW) / QUERY_STRIDE + 1).alias("expected"))
    return expected.join(found, "recording_id", "left").select("recording_id", "expected", "found", F.col("expected").eqNullSafe(F.col("found")).alias("matches"))


# calibration ---------------------------------------------------------------------------------------------------------


@query
def quantile_calibration(spark: SparkSession, sf: str) -> DataFrame:
    qs = (0.05, 0.5, 0.75, 0.95, 0.99)
    return calibrated(spark, sf).where("calibration").groupBy("recording_id", "feature").agg(*[r(F.percentile("value", F.lit(q))).alias(f"p{int(q * 100)}") for q in qs])


@query
def zscore_select(spark: SparkSession, sf: str) -> DataFrame:
    s = calibrated(spark, sf).where("calibration").groupBy("recording_id", "feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    kept = s.where("s > 1e-6")
    z = calibrated(spark, sf).join(kept, ["recording_id", "feature"])
    return z.select("recording_id", "win_no", "feature", r((F.col("value") - F.col("m")) / (F.col("s") + 1e-9), 5).alias("z"))


@query
def robust_envelope(spark: SparkSession, sf: str) -> DataFrame:
    x = ev_windows(spark, sf).select("recording_id", F.explode("v").alias("x"))
    middle = x.groupBy("recording_id").agg(F.expr("percentile(x, 0.5)").alias("m"), F.stddev_pop("x").alias("s"))
    d = x.join(middle, "recording_id").groupBy("recording_id", "m", "s").agg(F.expr("percentile(abs(x - m), 0.5)").alias("mad"))
    scale = F.greatest(1.4826 * F.col("mad"), 0.1 * F.col("s"), F.lit(1e-9))
    return d.select("recording_id", r("m").alias("median"), r("mad").alias("mad"), r(scale).alias("scale"))


@query
def sparse_channel(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.samples_xyz(spark, sf)
    n = rows.groupBy("recording_id").agg(F.count_distinct(F.struct("x", "y", "z")).alias("xyz"), F.count_distinct("z").alias("z"))
    return n.select("recording_id", "xyz", "z", (F.col("z") <= 16).alias("sparse"))


def _branch_health(spark: SparkSession, sf: str) -> DataFrame:
    """Three branches' health in calibration: (recording_id, branch, health)."""
    v = calibrated(spark, sf).where("calibration AND feature IN ('mean', 'rms', 'msd')")
    q = v.groupBy("recording_id", "feature").agg(F.percentile("value", F.lit(0.5)).alias("m"), F.percentile("value", F.lit(0.95)).alias("t"))
    v = v.join(q, ["recording_id", "feature"])
    return v.select("recording_id", "win_no", F.col("feature").alias("branch"), S.logistic_health(F.col("value"), F.col("m"), F.col("t")).alias("health"))


@query
def reliability_weights(spark: SparkSession, sf: str) -> DataFrame:
    return S.reliability_weights(_branch_health(spark, sf), ["recording_id"]).select("recording_id", "branch", r("weight").alias("weight"))


@query
def pairwise_reliability(spark: SparkSession, sf: str) -> DataFrame:
    v = calibrated(spark, sf).where("calibration").withColumnRenamed("win_no", "tie")
    return S.pairwise_reliability(v, ["recording_id", "feature"]).select("recording_id", "feature", r("reliability").alias("reliability"))


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature"))
    v = calibrated(spark, sf).where("calibration").withColumn("position", place)
    return S.feature_categories(v, ["recording_id"], ("variance",), stable=2, sensitive=1)


@query
def feature_categories(spark: SparkSession, sf: str) -> DataFrame:
    return _categories(spark, sf).select("recording_id", "feature", r("cv").alias("cv"), "category", "expert")


@query
def brb_score(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["recording_id", "feature"]
    values = calibrated(spark, sf)
    fit = values.where("calibration")
    scale = fit.groupBy(*keys).agg(F.avg("value").alias("m"), F.greatest(F.stddev_samp("value"), F.lit(1e-12)).alias("s"))
    trust = S.pairwise_reliability(fit.withColumnRenamed("win_no", "tie"), keys)
    model = _categories(spark, sf).join(trust, keys).join(scale, keys)
    top = model.groupBy("recording_id").agg(F.max("expert").alias("top"))
    model = model.join(top, "recording_id").select(*keys, "category", "m", "s", S.composite_weight(F.col("expert") / F.col("top"), F.col("reliability")).alias("w"))
    z = values.join(model, keys).withColumn("z", F.abs((F.col("value") - F.col("m")) / F.col("s")))
    sensitive = F.col("category") == "sensitive"
    raw = z.groupBy("recording_id", "win_no", "calibration").agg(
        (F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("raw"),
        (F.sum(F.when(sensitive, F.col("z") * F.col("w"))) / F.sum(F.when(sensitive, F.col("w")))).alias("degradation"),
    )
    q = raw.where("calibration").groupBy("recording_id").agg(*[F.percentile("raw", F.lit(p)).alias(n) for p, n in ((0.95, "t"), (0.5, "m"), (0.75, "b"), (0.25, "a"))])
    q = q.select("recording_id", "t", F.greatest(F.col("t") - F.col("m"), F.col("b") - F.col("a"), F.lit(1e-6)).alias("scale"))
    out = raw.join(q, "recording_id")
    return out.select("recording_id", "win_no", r("raw", 5).alias("raw"), r(F.coalesce("degradation", "raw"), 5).alias("degradation"), r(S.envelope_health(F.col("raw"), F.col("t"), F.col("scale")), 5).alias("health"))


@query
def bounded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return L.bounded_sample(ev_windows(spark, sf).select("recording_id", "win_no", "end_ts"), 40, 9, "win_no")


# events --------------------------------------------------------------------------------------------------------------


@query
def event_rates(spark: SparkSession, sf: str) -> DataFrame:
    w = W.sliding_windows(D.binary(D.samples(spark, sf)), QUERY_WINDOW, QUERY_STRIDE)
    return w.select("recording_id", "win_no", r(A.change_rate(F.col("v")), 9).alias("rate"))


@query
def flat_fraction(spark: SparkSession, sf: str) -> DataFrame:
    w = W.sliding_windows(D.binary(D.samples(spark, sf)), QUERY_WINDOW, QUERY_STRIDE)
    return w.select("recording_id", "win_no", r(A.flat_fraction(F.col("v")), 9).alias("flat"))


@query
def max_jump(spark: SparkSession, sf: str) -> DataFrame:
    return ev_windows(spark, sf).select("recording_id", "win_no", r(A.largest_step(F.col("v")), 9).alias("jump"))


def _binary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = D.binary(D.samples(spark, sf))
    w = S.with_calibration(W.sliding_windows(rows, QUERY_WINDOW, QUERY_STRIDE), rows)
    flat = w.where("calibration").select("recording_id", F.explode("v").alias("x"))
    return w, flat.groupBy("recording_id").agg(F.mode("x", True).alias("baseline"))


@query
def binary_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _binary(spark, sf)[1]


@query
def binary_event_score(spark: SparkSession, sf: str) -> DataFrame:
    w, base = _binary(spark, sf)
    rate = w.join(base, "recording_id").select("recording_id", "win_no", "calibration", A.mean(F.expr("transform(v, x -> if(x <> baseline, 1D, 0D))")).alias("raw"))
    q = rate.where("calibration").groupBy("recording_id").agg(*[F.percentile("raw", F.lit(p)).alias(n) for p, n in ((0.95, "t"), (0.5, "m"), (0.75, "b"), (0.25, "a"))])
    q = q.select("recording_id", "t", F.greatest(F.col("t") - F.col("m"), F.col("b") - F.col("a"), F.lit(1 / QUERY_WINDOW)).alias("scale"))
    return rate.join(q, "recording_id").select("recording_id", "win_no", r("raw", 9).alias("raw"), r(S.envelope_health(F.col("raw"), F.col("t"), F.col("scale"))).alias("health"))


@query
def event_rate_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.binary(D.samples(spark, sf))
    w = S.with_calibration(W.sliding_windows(rows, QUERY_WINDOW, QUERY_STRIDE), rows).select("recording_id", "win_no", "calibration", A.change_rate(F.col("v")).alias("rate"))
    m = w.where("calibration").groupBy("recording_id").agg(F.percentile("rate", F.lit(0.5)).alias("m"))
    w = w.join(m, "recording_id").withColumn("off", F.abs(F.col("rate") - F.col("m")))
    q = w.where("calibration").groupBy("recording_id").agg(F.percentile("off", F.lit(0.5)).alias("low"), F.percentile("off", F.lit(0.95)).alias("high"))
    health = 1 - S.normalised(F.col("off"), F.col("low"), F.col("high"))
    return w.join(q, "recording_id").select("recording_id", "win_no", r(health).alias("health"), (health <= 0).alias("alarm"))


# selection of jobs ---------------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet")


@query
def complete_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("job"))
    orders = _orders(spark, sf).withColumnRenamed("o_custkey", "job")
    return C.complete_jobs(jobs, [orders.where("o_orderkey % 3 = 0"), orders.where("o_orderkey % 3 = 1")], "job")


@query
def common_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return C.common_keys(rows, "event_type", "user_id")


@query
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return C.fingerprint(_orders(spark, sf), "o_orderkey", "o_custkey")


# fusion --------------------------------------------------------------------------------------------------------------


def _norms(spark: SparkSession, sf: str) -> DataFrame:
    """Per recording the array of window RMS values, in order."""
    f = features(ev_windows(spark, sf))
    return f.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("win_no", "rms"))).alias("s")).select("recording_id", F.col("s.win_no").alias("win"), F.col("s.rms").alias("z"))


def _spread(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("recording_id", F.explode(F.arrays_zip("win", "out")).alias("x")).select("recording_id", F.col("x.win").alias("win_no"), r("x.out").alias(name))


@query
def ewma_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = _norms(spark, sf).withColumn("out", S.running(F.col("z"), F.lit(0.0), lambda s, x: s * 0.9 + x * 0.1))
    return _spread(rows, "ewma")


@query
def ewma_residual(spark: SparkSession, sf: str) -> DataFrame:
    rows = _norms(spark, sf)
    state = S.running(F.col("z"), F.lit(0.0), lambda s, x: x * 0.15 + s * 0.85)
    before = F.concat(F.array(F.lit(0.0)), F.slice(state, F.lit(1), F.size(state) - 1))
    return _spread(rows.withColumn("out", F.zip_with(F.col("z"), before, lambda x, s: F.abs(x - s))), "residual")


@query
def logistic_health(spark: SparkSession, sf: str) -> DataFrame:
    return _branch_health(spark, sf).select("recording_id", "win_no", "branch", r("health").alias("health"))


@query
def geometric_fusion(spark: SparkSession, sf: str) -> DataFrame:
    h = _branch_health(spark, sf)
    w = S.reliability_weights(h, ["recording_id"])
    log = F.col("weight") * F.log(F.greatest(F.least("health", F.lit(1.0)), F.lit(1e-6)))
    raw = h.join(w, ["recording_id", "branch"]).groupBy("recording_id", "win_no").agg(F.exp(F.sum(log)).alias("raw"))
    q = raw.groupBy("recording_id").agg(F.percentile("raw", F.lit(0.05)).alias("t"), F.percentile("raw", F.lit(0.5)).alias("m"))
    final = S.logistic_health(F.col("raw"), F.col("m"), F.col("t"), rising=True)
    return raw.join(q, "recording_id").select("recording_id", "win_no", r("raw").alias("raw"), r(final).alias("health"))


@query
def fused_score(spark: SparkSession, sf: str) -> DataFrame:
    v = calibrated(spark, sf).where("feature IN ('mean', 'rms', 'msd')")
    q = v.where("calibration").groupBy("recording_id", "feature").agg(F.percentile("value", F.lit(0.5)).alias("m"), F.percentile("value", F.lit(0.99)).alias("u"))
    n = S.normalised(F.col("value"), F.col("m"), F.col("u"))
    shi = v.join(q, ["recording_id", "feature"]).groupBy("recording_id", "win_no", "calibration").agg((1 - F.avg(n)).alias("shi"))
    low = shi.where("calibration").groupBy("recording_id").agg(F.percentile("shi", F.lit(0.05)).alias("low"))
    return shi.join(low, "recording_id").select("recording_id", "win_no", r("shi").alias("shi"), (F.round("shi", 9) < F.round("low", 9)).alias("breach"))


@query
def reference_flags(spark: SparkSession, sf: str) -> DataFrame:
    w = ev_windows(spark, sf)
    x = w.select("recording_id", F.explode("v").alias("x"))
    m = x.groupBy("recording_id").agg(F.expr("percentile(x, 0.5)").alias("m"), F.stddev_pop("x").alias("s"))
    d = x.join(m, "recording_id").groupBy("recording_id", "m", "s").agg(F.expr("percentile(abs(x - m), 0.5)").alias("mad"))
    scale = F.greatest(1.4826 * F.col("mad"), 0.1 * F.col("s"), F.lit(1e-9))
    rows = w.join(d, "recording_id")
    flags = M.pack_flags(A.mean(F.col("v")) < 20, F.lit(False), A.flat_fraction(F.col("v")) >= 0.98, F.abs(F.col("end_value") - F.col("m")) / scale > 3)
    return rows.select("recording_id", "win_no", flags.alias("flags"))


@query
def mahalanobis_2d(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.samples(spark, sf)
    f = S.with_calibration(features(W.sliding_windows(rows, QUERY_WINDOW, QUERY_STRIDE)), rows)
    c = f.where("calibration").groupBy("recording_id").agg(F.avg("mean").alias("ma"), F.avg("rms").alias("mb"), F.var_pop("mean").alias("vaa"), F.var_pop("rms").alias("vbb"), F.covar_pop("mean", "rms").alias("vab"))
    a, b = F.col("mean") - F.col("ma"), F.col("rms") - F.col("mb")
    det = F.col("vaa") * F.col("vbb") - F.col("vab") * F.col("vab")
    d = (a * a * F.col("vbb") - 2 * a * b * F.col("vab") + b * b * F.col("vaa")) / det
    return f.join(c, "recording_id").select("recording_id", "win_no", r(d, 4).alias("d2"))


def _feature_arrays(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.samples(spark, sf)
    f = S.with_calibration(features(W.sliding_windows(rows, QUERY_WINDOW, QUERY_STRIDE)), rows)
    return f.select("recording_id", "win_no", "calibration", F.array(*FEATURES).alias("features"))


@query
def ledoit_wolf(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.operators.detectors import reference_raw

    return reference_raw(_feature_arrays(spark, sf))


@query
def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.operators.detectors import fused_raw

    return fused_raw(_feature_arrays(spark, sf))


@query
def reference_health(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.operators.detectors import reference_raw

    return S.reference_health(reference_raw(_feature_arrays(spark, sf)))


@query
def fused_health(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.operators.detectors import fused_raw

    return S.fused_health(fused_raw(_feature_arrays(spark, sf)))


@query
def features_f22(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.functions.features import extract

    rows = D.samples(spark, sf)
    w = W.sliding_windows(rows, QUERY_WINDOW, QUERY_STRIDE).join(W.first_window_rate(rows, QUERY_WINDOW), "recording_id")
    return extract(w, ar=True)


@query
def features_f20(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.functions.features import extract

    return extract(W.sliding_windows(D.samples_xyz(spark, sf), 128, 64, ("x", "y", "z")), ("v", "v_y", "v_z"), "F20")


# labels, sampling, planning, injection -------------------------------------------------------------------------------


def _active(spark: SparkSession, sf: str) -> DataFrame:
    return D.samples(spark, sf).withColumn("active", F.col("x") > 120)


@query
def horizon_labels(spark: SparkSession, sf: str) -> DataFrame:
    return L.horizon_labels(_active(spark, sf), 4 * 3_600_000).select("recording_id", "seq", "label")


@query
def active_onsets(spark: SparkSession, sf: str) -> DataFrame:
    return _active(spark, sf).withColumn("onset", L.onsets(F.col("active"))).where("onset").select("recording_id", "seq", "ts_ms")


@query
def stratified_even_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "orders").select((F.col("o_custkey") % 5 * F.col("o_custkey") % 3).cast("int").alias("label"), F.col("o_orderkey").alias("seq"))
    return L.stratified_even_sample(rows, 500)


@query
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return L.largest_remainder(D.samples(spark, sf).groupBy("recording_id").agg(F.count("*").alias("n")), 1234, "recording_id")


@query
def lpt_plan(spark: SparkSession, sf: str) -> DataFrame:
    jobs = [(f"j{i}", w) for i, w in enumerate((100, 80, 40, 20, 60, 60, 10))]
    return spark.createDataFrame(L.lpt_plan(jobs, 3), "job string, batch int")


@query
def downsample(spark: SparkSession, sf: str) -> DataFrame:
    return L.downsample(D.samples(spark, sf), 300).select("recording_id", "seq", "x")


@query
def fault_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.samples(spark, sf).join(_interval(spark, sf), "recording_id")
    elapsed = (F.col("ts_ms") - F.col("start")) / 1000
    near = F.abs(F.col("ts_ms") - F.col("fault_start")) <= 86_400_000
    return rows.where(near).select("recording_id", "seq", r(elapsed, 3).alias("elapsed_s"), "x")


@query
def signal_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.samples_xyz(spark, sf)
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return rows.groupBy("recording_id").agg(F.when(F.max((F.col("y") != 0) | (F.col("z") != 0)), 3).otherwise(1).alias("axes"), r(F.max(norm), 4).alias("largest"), r(F.min(norm), 4).alias("smallest"))


def _inject(kind: str, severity: float) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = D.samples(spark, sf)
        n = rows.groupBy("recording_id").agg(F.floor(F.max("seq") * 0.6).alias("onset"))
        out = L.inject(rows.join(n, "recording_id"), kind, F.col("onset"), severity, pre=20, seed=5)
        return out.select("recording_id", "seq", r("faulty").alias("faulty"), "label")

    run.__name__ = f"inject_{kind}"
    query(run)


for _kind, _severity in (("bias_offset", 2.5), ("drift", 10.0), ("noise_increase", 2.0), ("dropout", 9.0), ("stuck_at", 1.0), ("latency", 12.0), ("saturation", 0.5), ("calibration_shift", 1.25)):
    _inject(_kind, _severity)


# features of the other scores ----------------------------------------------------------------------------------------


@query
def t2_time(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return D.windows64(spark, sf).select("win_no", r(A.mean(v)).alias("mean"), r(F.sqrt(A.variance(v))).alias("std"), r(A.rms(v)).alias("rms"), r(A.skewness(v)).alias("skewness"), r(A.kurtosis(v)).alias("kurtosis"))


@query
def t2_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return ev_windows(spark, sf).select("recording_id", "win_no", *[r(A.quantile(F.col("v"), q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


@query
def t2_zcr(spark: SparkSession, sf: str) -> DataFrame:
    return D.windows64(spark, sf).select("win_no", r(A.crossing_rate(F.col("v")), 9).alias("zcr"))


@query
def t2_quality(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return ev_windows(spark, sf).select("recording_id", "win_no", r(A.noise_floor(v)).alias("noise_floor"), r(A.baseline_stability(v, 5)).alias("stability"), r(A.log_snr(v)).alias("log_snr"))


@query
def brb_time(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return D.windows64(spark, sf).select("win_no", r(A.mean(v)).alias("mean"), r(A.variance(v)).alias("variance"), *[r(A.quantile(v, q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], r(A.sign_change_rate(v), 9).alias("zcr"))


@query
def brb_moments(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return D.windows64(spark, sf).select("win_no", r(A.skewness_corrected(v)).alias("skewness"), r(A.kurtosis_corrected(v)).alias("kurtosis"))


@query
def brb_allan(spark: SparkSession, sf: str) -> DataFrame:
    return D.windows64(spark, sf).select("win_no", *[r(A.allan_deviation(F.col("v"), m)).alias(f"adev_{m}") for m in (1, 2, 4, 8)])


@query
def brb_quality(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    step = A.let(A.neighbours(v, lambda a, b: b - a), A.variance)
    snr = 10 * F.log10(A.variance(v) / (step / 2))
    return D.windows64(spark, sf).select("win_no", r(A.noise_floor(v)).alias("noise_floor"), r(A.baseline_stability(v, 4)).alias("stability"), r(F.greatest(F.least(snr, F.lit(60.0)), F.lit(-60.0))).alias("snr"))


@query
def brb_runs(spark: SparkSession, sf: str) -> DataFrame:
    w = W.sliding_windows(D.binary(D.samples(spark, sf)), QUERY_WINDOW, QUERY_STRIDE).withColumn("runs", A.run_lengths(F.col("v")))
    dropped = F.aggregate(F.filter("runs", lambda n: n >= 3), F.lit(0), lambda a, n: a + n) / F.size("v")
    longest = F.array_max("runs")
    return w.select("recording_id", "win_no", r(dropped, 9).alias("dropout"), r(A.flat_fraction(F.col("v")), 9).alias("identical"), r(F.when(longest >= 2, longest / F.size("v")).otherwise(0.0), 9).alias("longest"))


@query
def brb_linearity(spark: SparkSession, sf: str) -> DataFrame:
    return D.windows64(spark, sf).select("win_no", r(A.linearity(F.col("v"))).alias("linearity"))


@query
def brb_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Variation of the peak-to-peak range over half-overlapping segments of an eighth of the window."""
    size, step = 8, 4
    ranges = F.array(*[F.array_max(F.slice("v", a + 1, size)) - F.array_min(F.slice("v", a + 1, size)) for a in range(0, 64 - size + 1, step)])
    return D.windows64(spark, sf).select("win_no", r(A.let(ranges, lambda p: F.sqrt(A.variance(p)) / (A.mean(p) + 1e-12))).alias("peak_consistency"))


@query
def interp_nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    """Every ninth sample is missing; the line between its neighbours with values fills it, ends take the nearest."""
    rows = D.samples(spark, sf).withColumn("g", F.when(F.col("event_id") % 9 != 4, F.col("x")))
    w = Window.partitionBy("recording_id").orderBy("seq")
    known = F.when(F.col("g").isNotNull(), F.struct("seq", "g"))
    rows = rows.withColumn("a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("recording_id").orderBy(F.desc("seq"))
    rows = rows.withColumn("b", F.last(known, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    share = (F.col("seq") - F.col("a.seq")) / (F.col("b.seq") - F.col("a.seq"))
    line = F.col("a.g") + (F.col("b.g") - F.col("a.g")) * share
    filled = F.coalesce("g", F.when(F.col("a").isNull(), F.col("b.g")).when(F.col("b").isNull(), F.col("a.g")).otherwise(line))
    return rows.select("recording_id", "seq", r(filled).alias("filled"))


# spectral ------------------------------------------------------------------------------------------------------------


@query
def feat_bands(spark: SparkSession, sf: str) -> DataFrame:
    """At 64 samples a second: bins are whole hertz."""
    rows = D.windows64(spark, sf).withColumn("p", A.power_spectrum(F.col("v"), 64))
    total = A.total(F.col("p")) + 1e-12
    return rows.select("win_no", r(A.total(F.slice("p", 1, 10)) / total).alias("low"), r(A.total(F.slice("p", 11, 23)) / total).alias("middle"))


@query
def feat_spectral(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.windows64(spark, sf).withColumn("p", A.power_spectrum(F.col("v"), 64))
    p = F.col("p")
    centroid = A.total(F.transform(p, lambda x, k: x * k)) / (A.total(p) + 1e-12)
    flatness = F.exp(A.mean(F.transform(p, lambda x: F.log(x + 1e-12)))) / (A.mean(p) + 1e-12)
    return rows.select("win_no", r(centroid).alias("centroid"), r(flatness).alias("flatness"))


def _gain(k: Column, n: int, level: int) -> Column:
    """Squared gain of the eight-tap scaling filters at frequency bin k of n, dilated ``level`` times."""
    w = k * (2 * 3.141592653589793 / n) * float(2**level)
    c, s = F.pow(F.cos(w / 2), 2.0), F.pow(F.sin(w / 2), 2.0)
    return 2 * F.pow(c, 4.0) * (1 + 4 * s + 10 * s * s + 20 * s * s * s)


def _detail(level: int) -> Callable[[Column, Column], Column]:
    def part(x: Column, k: Column) -> Column:
        for i in range(level - 1):
            x = x * _gain(k, 64, i)
        return x * (2 - _gain(k, 64, level - 1))

    return part


def _wavelet(rows: DataFrame, levels: int, norm: bool) -> DataFrame:
    """Energies of undecimated detail levels and the last approximation, from the spectrum (Parseval)."""
    p = A.power_spectrum(F.col("v"), 64)
    both = F.transform(p, lambda x, k: x * F.when((k == 0) | (k == 32), 1.0).otherwise(2.0) / 64)
    rows = rows.withColumn("p", both)
    columns = []
    for j in range(1, levels + 1):
        scale = float(2**j) if norm else 1.0
        columns.append(r(A.total(F.transform("p", _detail(j))) / scale, 5).alias(f"d{j}"))

    def smooth(x: Column, k: Column) -> Column:
        for i in range(levels):
            x = x * _gain(k, 64, i)
        return x

    columns.append(r(A.total(F.transform("p", smooth)) / (float(2**levels) if norm else 1.0), 5).alias("approximation"))
    return rows.select("win_no", *columns)


@query
def feat_wavelet_energy(spark: SparkSession, sf: str) -> DataFrame:
    return _wavelet(D.windows64(spark, sf), 4, False)


@query
def t2_wavelet(spark: SparkSession, sf: str) -> DataFrame:
    return _wavelet(D.windows64(spark, sf), 5, True)


def _kernel(spark: SparkSession, sf: str, names: list[str], f: Callable) -> DataFrame:
    """Windows through a NumPy kernel, in Arrow batches."""
    import pandas as pd

    ship(spark)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pd.concat([b[["win_no"]], pd.DataFrame([f(x) for x in b["v"]], columns=names, index=b.index, dtype=float)], axis=1)

    return D.windows64(spark, sf).mapInPandas(run, "win_no long, " + ", ".join(f"{n} double" for n in names))


@query
def feat_ar_burg(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.functions.signals import ar_features

    return _kernel(spark, sf, ["angle_mean", "angle_std", "root_size", "log_noise"], ar_features)


@query
def brb_spectral(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.functions.signals import spectral_features

    return _kernel(spark, sf, ["slope", "entropy", "flatness", "centroid"], spectral_features)


@query
def brb_modwt(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.functions.signals import modwt_features

    return _kernel(spark, sf, [f"{k}{j}" for j in (1, 2, 3) for k in ("energy", "entropy", "kurtosis")] + ["detail_share"], modwt_features)


# models --------------------------------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.horizon_labels(_active(spark, sf), 4 * 3_600_000)
    ends = rows.select("recording_id", F.col("ts_ms").alias("end_ts"), "seq", "label")
    w = features(ev_windows(spark, sf)).withColumn("seq", QUERY_WINDOW + (F.col("win_no") - 1) * QUERY_STRIDE)
    return w.join(ends.select("recording_id", "seq", "label"), ["recording_id", "seq"]).withColumn("win_no", F.xxhash64("recording_id", "win_no"))


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.operators.models import confusion

    rows = _labelled(spark, sf)
    return confusion(rows.select((F.col("label") > 0).cast("int").alias("label"), (F.round("rms", 6) > 60).cast("int").alias("predicted")))


@query
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.operators.models import class_report as report

    rows = _labelled(spark, sf).select((F.col("label") > 0).cast("int").alias("label"), (F.round("rms", 6) > 60).cast("int").alias("predicted"))
    return report(rows).select("class", *[r(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    from vigil.operators.models import accuracy

    rows = _labelled(spark, sf).withColumn("health", F.when(F.round("rms", 6) > 60, 0.25).otherwise(0.75))
    return accuracy(rows, "recording_id").select("recording_id", "n", r("accuracy", 9).alias("accuracy"))


def _model(spark: SparkSession, sf: str, kind: str, trees: int) -> DataFrame:
    from vigil.operators.models import healthy_probability, known_features, stratified_split, train

    rows = stratified_split(_labelled(spark, sf).select("win_no", "label", *FEATURES)).cache()
    if rows.where("train").where(known_features(FEATURES)).isEmpty():
        return rows.select("win_no", "label", "train", F.lit(None).cast("double").alias("health"))
    model = train(rows.where("train"), FEATURES, kind, trees=trees)
    return healthy_probability(model, rows).select("win_no", "label", "train", "health")


@query
def rf_health(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "forest", 20)


@query
def gbt_health(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, "boosted", 10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
