"""Whole feature vectors of windows, for Arrow batches: the 22 (26 with AR) features of the distance and model scores, the 20 of the fused score.

Axes are computed one after another and joined; with several axes names get the prefix x__, y__ or z__. Energies of the
undecimated wavelet transform come from the power spectrum, as they depend on the filters' gain only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.functions.shipping import ship
from vigil.functions.signals import ar_features, band_energies

BANDS = ((0, 10), (10, 100), (100, 500))
#: Names in order. Wavelet levels keep the names they were published with, which count from the coarsest.
F22 = ["mean", "var", "rms", "skew", "kurtosis", "zero_crossing_rate", *(f"band_energy_{a}_{b}hz" for a, b in BANDS), "spectral_centroid", "spectral_flatness", "mean_squared_diff"]
F22 += [f"detail_{k}_L{j}" for j in (1, 2, 3, 4) for k in ("energy", "variance")] + ["approx_energy_L4", "approx_variance_L4"]
AR = ["ar_mean_angle", "ar_std_angle", "ar_mean_magnitude", "ar_log_noise_var"]
F20 = ["mean", "std", "rms", "skew", "kurtosis", "p25", "p50", "p75", "zcr", "swt_approx_L5_energy", *(f"swt_detail_L{j}_energy" for j in (5, 4, 3, 2, 1)), "swt_energy_entropy", "swt_hf_lf_ratio", "noise_floor", "baseline_stability", "log10_snr"]


def names(family: str, axes: int, ar: bool = False) -> list[str]:
    base = F20 if family == "F20" else F22 + AR * ar
    return base if axes == 1 else [f"{a}__{n}" for a in "xyz"[:axes] for n in base]


def _gain(w: np.ndarray) -> np.ndarray:
    """Squared gain of the scaling filters with four vanishing moments (Daubechies 1992)."""
    s = np.sin(w / 2) ** 2
    return 2 * np.cos(w / 2) ** 8 * (1 + 4 * s + 10 * s**2 + 20 * s**3)


def wavelet_energies(x: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Energies of details and of approximations at levels 1 .. ``levels`` (one column each), unnormalised."""
    n = x.shape[1]
    power = np.abs(np.fft.fft(x, axis=1)) ** 2 / n
    w = 2 * np.pi * np.arange(n) / n
    low, details, smooth = np.ones(n), [], []
    for j in range(levels):
        g = _gain(w * 2**j)
        details.append(power @ (low * (2 - g)))
        low = low * g
        smooth.append(power @ low)
    return np.stack(details, axis=1), np.stack(smooth, axis=1)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, v = x.mean(axis=1), x.var(axis=1)
    d = x - m[:, None]
    safe = np.where(v > 0, v, 1.0)
    return m, v, np.where(v > 0, (d**3).mean(axis=1) / safe**1.5, 0.0), np.where(v > 0, (d**4).mean(axis=1) / safe**2 - 3, 0.0)


def f22(x: np.ndarray, fs: float, ar: bool = False) -> np.ndarray:
    m, v, skew, kurt = _moments(x)
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    f = np.fft.rfftfreq(x.shape[1], 1 / fs)
    columns = [m, v, np.sqrt((x**2).mean(axis=1)), skew, kurt, (np.diff(np.sign(x), axis=1) != 0).mean(axis=1), *band_energies(x, fs, BANDS).T]
    columns += [(power * f).sum(axis=1) / (power.sum(axis=1) + 1e-12), np.exp(np.log(power + 1e-12).mean(axis=1)) / (power.mean(axis=1) + 1e-12), (np.diff(x, axis=1) ** 2).mean(axis=1)]
    size = 1 << max(int(np.ceil(np.log2(x.shape[1]))), 4)
    padded = np.pad(x, ((0, 0), (0, size - x.shape[1])), mode="symmetric")
    details, smooth = wavelet_energies(padded, 4)
    for j in (3, 2, 1, 0):
        columns += [details[:, j], details[:, j] / size]
    columns += [smooth[:, 0], smooth[:, 0] / size - 2 * padded.mean(axis=1) ** 2]
    if ar:
        columns += list(np.array([ar_features(row) for row in x]).reshape(-1, 4).T)
    out = np.stack(columns, axis=1)
    return np.nan_to_num(out, nan=0.0, posinf=1e12, neginf=-1e12)


def f20(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    m, v, skew, kurt = _moments(x)
    columns = [m, np.sqrt(v), np.sqrt((x**2).mean(axis=1)), skew, kurt, *np.percentile(x, (25, 50, 75), axis=1), (x[:, :-1] * x[:, 1:] < 0).mean(axis=1)]
    if n < 8:
        columns += [np.zeros(len(x))] * 8
    else:
        details, smooth = wavelet_energies(np.pad(x, ((0, 0), (0, -n % 32))), 5)
        energy = np.column_stack((smooth[:, 4], details[:, ::-1])) / 2.0 ** np.array([5, 5, 4, 3, 2, 1])
        share = energy / (energy.sum(axis=1, keepdims=True) + 1e-12)
        entropy = -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1)
        columns += [*energy.T, entropy, (energy[:, 1] + energy[:, 2]) / (energy[:, 5] + 1e-12)]
    if n < 4:
        columns += [np.zeros(len(x))] * 3
    else:
        d = np.diff(x, axis=1)
        noise = np.median(np.abs(d - np.median(d, axis=1, keepdims=True)), axis=1) * 1.4826 / 2**0.5
        k = max(1, n // 5)
        segments = x[:, : 5 * k].reshape(len(x), -1, k).mean(axis=2) if n >= 5 else x
        columns += [noise, segments.std(axis=1), np.log10(v / np.maximum(noise**2, 1e-12) + 1e-12)]
    out = np.stack(columns, axis=1)
    if not np.isfinite(out).all():
        raise ValueError("features that aren't finite")
    return out


def extract(windows: DataFrame, axes: tuple[str, ...] = ("v",), family: str = "F22", fs: float | None = None, ar: bool = False) -> DataFrame:
    """The windows with their array columns ``axes`` replaced by one array, features; see ``names`` for what is in it.

    ``fs``: samples a second, or a column fs of the windows (the first window's rate of each recording).
    """
    ship(windows.sparkSession)
    kept = [c for c in windows.columns if c not in axes]
    schema = ", ".join(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in kept) + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = []
            rate = np.asarray(b["fs"], dtype=float) if fs is None and "fs" in kept else np.full(b.num_rows, fs or 1.0)
            for a in axes:
                x = np.asarray(b[a].flatten(), dtype=float).reshape(b.num_rows, -1)
                if family == "F20":
                    parts.append(f20(x))
                    continue
                one = np.empty((len(x), len(F22) + len(AR) * ar))
                for r in np.unique(rate):
                    one[rate == r] = f22(x[rate == r], float(r), ar)
                parts.append(one)
            whole = np.hstack(parts)
            offsets = pa.array(np.arange(0, whole.size + 1, whole.shape[1], dtype=np.int32))
            yield pa.record_batch([*(b[c] for c in kept), pa.ListArray.from_arrays(offsets, pa.array(whole.ravel()))], names=[*kept, "features"])

    return windows.mapInArrow(run, schema)
