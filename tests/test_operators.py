import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.config import FusedConfig, ReferenceConfig
from vigil.functions import arrays as A
from vigil.functions import signals as N
from vigil.operators import labels as L
from vigil.operators import metrics as M
from vigil.operators import scores as S
from vigil.operators import windows as W


def samples(spark, values, step=10, key="r"):
    return spark.createDataFrame([(key, i + 1, i * step, float(v)) for i, v in enumerate(values)], "recording_id string, seq long, ts_ms long, x double")


def one(spark, values, column):
    return spark.createDataFrame([([float(v) for v in values],)], "v array<double>").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("stride", [1, 3, 4, 8, 11])
def test_windows_drop_what_does_not_fill(spark, stride):
    rows = W.sliding_windows(samples(spark, range(23)), 8, stride).orderBy("win_no").collect()
    want = [(k + 1, (8 + stride * k - 1) * 10, [float(x) for x in range(stride * k, stride * k + 8)]) for k in range((23 - 8) // stride + 1)]
    assert [(r["win_no"], r["end_ts"], r["v"]) for r in rows] == want
    assert W.sliding_windows(samples(spark, range(5)), 8, 4).count() == 0


def test_numbering_over_buckets(spark):
    rows = spark.createDataFrame([("a", t, t % 7) for t in range(0, 1000, 7)] + [("b", 5, 0), ("b", 5, 1)], "recording_id string, ts_ms long, tie long")
    out = W.number_samples(rows, ["ts_ms", "tie"], 100).orderBy("recording_id", "seq").collect()
    assert [r["seq"] for r in out if r["recording_id"] == "a"] == list(range(1, 144))
    assert [r["ts_ms"] for r in out if r["recording_id"] == "a"] == list(range(0, 1000, 7))
    assert [r["tie"] for r in out if r["recording_id"] == "b"] == [0, 1]


def test_rate_of_first_window(spark):
    rows = spark.createDataFrame([("r", i + 1, t, 0.0) for i, t in enumerate((0, 1, 1, 2, 3))], "recording_id string, seq long, ts_ms long, x double")
    assert W.first_window_rate(rows, 5).first()["fs"] == 1000.0


def test_running_scale(spark):
    rows = spark.createDataFrame([("r", f, float(v)) for f, vs in (("a", (1, 2, 3, 4)), ("b", (10, 20, 30, 40))) for v in vs], "recording_id string, feature string, value double")
    got = {r["feature"]: r["scale"] for r in S.calibration_scale(rows, ["recording_id", "feature"]).collect()}
    assert got["a"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1)) and got["b"] == pytest.approx(np.std([10, 20, 30, 40], ddof=1))


def test_scores_of_equal_and_different_windows(spark):
    rows = spark.createDataFrame([("r", 1, "a", 1.0, 1.0, 1.0), ("r", 1, "b", 1.0, 1.0, 1.0), ("r", 2, "a", 2.0, 1.0, 1.0), ("r", 2, "b", 2.0, 1.0, 1.0)], "recording_id string, win_no int, feature string, value double, mean double, scale double")
    got = {r["win_no"]: r["shi"] for r in S.distance(rows, ["win_no"]).select("win_no", S.distance_health(F.col("distance")).alias("shi")).collect()}
    assert got == {1: 100.0, 2: pytest.approx(100 * math.exp(-1))}


def test_horizon_labels(spark):
    active = [c == "1" for c in "0001100110"]
    rows = spark.createDataFrame([("r", i, 1000 * i, a) for i, a in enumerate(active)], "recording_id string, seq long, ts_ms long, active boolean")
    got = [r["label"] for r in L.horizon_labels(rows, 2000).orderBy("seq").collect()]
    assert got == [0, 1, 1, 2, 2, 1, 1, 2, 2, 0]


def test_stratified_sample_keeps_all_labels(spark):
    rows = spark.createDataFrame([(0 if i < 90 else 1 if i < 95 else 2, i) for i in range(100)], "label int, seq int")
    a, b = ([(r["label"], r["seq"]) for r in L.stratified_even_sample(rows, 20).orderBy("seq").collect()] for _ in range(2))
    assert a == b and len(a) == 20 and {x for x, _ in a} == {0, 1, 2}


def test_plan_balances_and_ignores_order():
    jobs = [("a", 100), ("b", 80), ("c", 40), ("d", 20)]
    for order in (jobs, jobs[::-1]):
        load = [0, 0]
        for name, batch in L.lpt_plan(order, 2):
            load[batch] += dict(jobs)[name]
        assert load == [120, 120]


def test_binary_event_health(spark):
    w = np.zeros(256)
    one_event = w.copy()
    one_event[7] = 1
    got = [one(spark, x, S.envelope_health(A.mean(F.col("v")), F.lit(0.0), F.lit(1 / 256))) for x in (w, one_event)]
    assert got == [1.0, 0.5]


@pytest.mark.parametrize(("k", "n"), [(0, 10), (1, 10), (5, 10), (10, 10), (37, 1000)])
def test_exact_interval(k, n):
    lo, hi = M.exact_interval(k, n)
    tail = lambda p, ks: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in ks)
    assert lo <= k / n <= hi
    assert lo == 0.0 if k == 0 else tail(lo, range(k, n + 1)) == pytest.approx(0.025, rel=1e-6)
    assert hi == 1.0 if k == n else tail(hi, range(k + 1)) == pytest.approx(0.025, rel=1e-6)
    assert M.exact_interval(0, 0) == (None, None)


def test_flags_and_partition(spark):
    row = spark.range(1).select(M.pack_flags(F.lit(True), F.lit(False), F.lit(True), F.lit(None).cast("boolean")).alias("f"), M.partition(F.lit(5), F.lit(3), F.lit(9), F.lit(4)).alias("p"), M.partition_legacy(F.lit(5), F.lit(3), F.lit(9), F.lit(4)).alias("q")).first()
    assert (row["f"], row["p"], row["q"]) == (5, "calibration", "post")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-100, 100).map(lambda x: round(x, 3)), min_size=12, max_size=40))
def test_array_functions_match_numpy(spark, values):
    x, v = np.array(values), F.col("v")
    cols = [A.mean(v), A.variance(v), A.rms(v), A.median(v), A.quantile(v, 0.9), A.mean_squared_step(v), A.largest_step(v), A.flat_fraction(v), A.allan_deviation(v, 2)]
    row = spark.createDataFrame([(values,)], "v array<double>").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    s = np.concatenate(([0], np.cumsum(x)))
    d = (s[4:] - 2 * s[2:-2] + s[:-4]) / 2
    want = [x.mean(), x.var(), np.sqrt((x**2).mean()), np.median(x), np.quantile(x, 0.9), (np.diff(x) ** 2).mean(), np.abs(np.diff(x)).max(), (np.diff(x) == 0).mean(), np.sqrt((d**2).sum() / (2 * len(d)))]
    assert list(row) == pytest.approx(want, rel=1e-8, abs=1e-7)


def test_runs(spark):
    assert one(spark, [1, 1, 1, 0, 2, 2], A.run_lengths(F.col("v"))) == [3, 1, 2]


def test_faults_change_only_what_follows(spark):
    x = np.sin(np.arange(100))
    for kind, severity in (("bias_offset", 2.0), ("drift", 3.0), ("noise_increase", 1.0), ("dropout", 8.0), ("stuck_at", 0.0), ("latency", 5.0), ("saturation", 0.5), ("calibration_shift", 2.0)):
        rows = L.inject(samples(spark, x), kind, F.lit(60), severity, pre=10).orderBy("seq").collect()
        assert [r["faulty"] for r in rows[:60]] == pytest.approx(x[:60].tolist())
        assert [r["label"] for r in rows] == [0] * 50 + [1] * 10 + [2] * 40
        assert any(abs(r["faulty"] - v) > 1e-9 for r, v in zip(rows[60:], x[60:], strict=True)), kind
    with pytest.raises(ValueError, match="no fault"):
        L.inject(samples(spark, x), "other", F.lit(1), 1.0)


def test_modwt_keeps_energy_and_burg_finds_a_pole():
    x = np.random.default_rng(1).standard_normal(128)
    details, smooth = N.modwt(x, 3)
    assert sum(float(d @ d) for d in details) + float(smooth @ smooth) == pytest.approx(float(x @ x))
    y = np.zeros(4000)
    for i, e in enumerate(np.random.default_rng(2).standard_normal(3999)):
        y[i + 1] = 0.8 * y[i] + e
    a, e = N.burg(y, 1)
    assert a[0] == pytest.approx(-0.8, abs=0.05) and e == pytest.approx(1, abs=0.1)
    assert N.ar_features(np.ones(64)) == (0.0, 0.0, 0.0, 0.0)


def test_isolation_and_shrinkage():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 3))
    score = N.IsolationForest(x, 64, 256, 1).score(np.vstack((x, [[9, 9, 9]])))
    assert score[-1] > np.quantile(score[:-1], 0.99)
    cov, share = N.ledoit_wolf(x)
    assert 0 <= share <= 1 and np.trace(cov) == pytest.approx(np.trace(np.cov(x.T, bias=True)))


def test_settings_are_checked():
    ReferenceConfig().validate()
    assert FusedConfig().geometry(100) == (300, 150)
    with pytest.raises(ValueError, match="shares"):
        ReferenceConfig(target_fpr=2).validate()
    with pytest.raises(ValueError, match="overlap"):
        FusedConfig(overlap=1).validate()


def test_broken_streams_are_named(spark):
    rows = W.timestamp_bounds(spark.createDataFrame([("r", 1, 10, 0.0), ("r", 2, 5, 0.0)], "recording_id string, seq long, ts_ms long, x double"))
    with pytest.raises(ValueError, match="back in time: r"):
        W.require(rows, "decreasing > 0", "back in time")


def raw_scores(spark, n=200, fit=100):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        shift = 0.0 if i < 150 else 6.0
        rows.append(("r", i, i < fit, *(float(abs(rng.normal()) + shift) for _ in range(3))))
    return spark.createDataFrame(rows + [("few", 1, True, None, None, None)], "recording_id string, win_no long, calibration boolean, isolation double, mahalanobis double, ewma double")


def test_fused_and_reference_health(spark):
    raw = raw_scores(spark)
    fused = S.fused_health(raw).orderBy("win_no").collect()
    assert len(fused) == 200 and all(0 <= r["shi"] <= 1 for r in fused)
    assert all(r["persistent"] for r in fused[152:]) and sum(r["breach"] for r in fused[:100]) <= 5
    ref = S.reference_health(raw).orderBy("win_no").collect()
    assert len(ref) == 200 and abs(np.mean([r["alarm"] for r in ref[:100]]) - 0.05) < 0.04 and all(r["alarm"] for r in ref[150:])
    assert np.median([r["shi"] for r in ref[:100]]) == pytest.approx(0.9, abs=0.02)
