import numpy as np
import pytest

from vigil.functions import features as E
from vigil.functions import signals as N
from vigil.operators import windows as W


def test_widths():
    assert [len(E.names("F22", a, ar)) for a, ar in ((1, False), (1, True), (3, False), (3, True))] == [22, 26, 66, 78]
    assert len(E.names("F20", 1)) == 20 and E.names("F20", 3)[20] == "y__mean"
    x = np.random.default_rng(42).standard_normal((6, 256))
    assert E.f22(x, 1000).shape == (6, 22) and E.f22(x, 1000, True).shape == (6, 26)
    y = np.random.default_rng(12).standard_normal((30, 96))
    assert E.f20(y).shape == (30, 20) and np.isfinite(E.f20(y)).all()


def test_energies_equal_the_filters():
    x = np.random.default_rng(1).standard_normal((3, 64))
    details, smooth = E.wavelet_energies(x, 3)
    for row, d, s in zip(x, details, smooth, strict=True):
        parts, rest = N.modwt(row, 3)
        # filters there are scaled by one over root two at each level
        assert [p @ p * 2 ** (j + 1) for j, p in enumerate(parts)] == pytest.approx(d)
        assert rest @ rest * 8 == pytest.approx(s[2])
    assert E.f20(x)[:, 9:15].sum(axis=1) == pytest.approx((x**2).sum(axis=1))


def test_constant_windows():
    x = np.full((2, 64), 3.0)
    out = dict(zip(E.names("F22", 1, True), E.f22(x, 100, True)[0], strict=True))
    assert out["mean"] == 3 and out["var"] == out["skew"] == out["zero_crossing_rate"] == out["ar_std_angle"] == 0
    assert np.isfinite(E.f22(x, 100)).all() and np.isfinite(E.f20(x)).all()
    assert E.f20(np.ones((1, 5))).shape == (1, 20) and E.f20(np.ones((1, 3))).shape == (1, 20)


def test_extract_joins_axes(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([("r", i + 1, i * 10, *map(float, rng.standard_normal(3))) for i in range(200)], "recording_id string, seq long, ts_ms long, x double, y double, z double")
    w = W.sliding_windows(rows, 64, 16, ("x", "y", "z")).join(W.first_window_rate(rows, 64), "recording_id")
    out = E.extract(w, ("v", "v_y", "v_z")).orderBy("win_no").collect()
    assert len(out) == 9 and all(len(r["features"]) == 66 and r["fs"] == 100.0 for r in out)
    first = w.orderBy("win_no").first()
    want = np.hstack([E.f22(np.array([first[a]]), 100.0) for a in ("v", "v_y", "v_z")])[0]
    assert out[0]["features"] == pytest.approx(want.tolist())
