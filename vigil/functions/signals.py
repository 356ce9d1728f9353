"""Spectral and model kernels in NumPy, for Arrow batches of windows."""

from __future__ import annotations

import math

import numpy as np

#: Low-pass taps of the Symlet with four vanishing moments (Daubechies 1992, table 6.3), sum of squares 1 here.
SYM4 = np.array([-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.8037387518059161, 0.29785779560527736, -0.09921954357684722, -0.012603967262037833, 0.0322231006040427])


def band_energies(x: np.ndarray, fs: float, bands: tuple[tuple[float, float], ...] = ((0, 10), (10, 100), (100, 500))) -> np.ndarray:
    """Share of the spectrum's energy in each band [low, high), for every row."""
    power = np.abs(np.fft.rfft(x, axis=1)) ** 2
    f = np.fft.rfftfreq(x.shape[1], 1 / fs)
    total = power.sum(axis=1) + 1e-12
    return np.stack([power[:, (f >= a) & (f < b)].sum(axis=1) / total for a, b in bands], axis=1)


def burg(x: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Coefficients a of x[t] + sum a_k x[t-k] = noise by Burg's method (1975), and the noise variance."""
    f, b = x[1:].copy(), x[:-1].copy()
    a, e = np.zeros(0), float(x @ x) / len(x)
    for _ in range(order):
        down = float(f @ f + b @ b)
        k = -2 * float(f @ b) / down if down > 0 else 0.0
        a = np.concatenate((a + k * a[::-1], [k]))
        e *= 1 - k * k
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a, e


def ar_features(x: np.ndarray, order: int = 6) -> tuple[float, float, float, float]:
    """Mean and spread of the root angles, mean root size, logarithm of the noise variance; zeros for a constant window.

    The polynomial takes the coefficients with the sign that the scores were defined with.
    """
    if np.ptp(x) == 0 or len(x) <= order + 1:
        return 0.0, 0.0, 0.0, 0.0
    a, e = burg(x - 0.0, order)
    roots = np.roots(np.concatenate(([1.0], -a)))
    angle = np.angle(roots)
    out = (angle.mean(), angle.std(), np.abs(roots).mean(), math.log(max(e, 1e-12)))
    return out if np.isfinite(out).all() else (0.0, 0.0, 0.0, 0.0)


def welch(x: np.ndarray, fs: float = 1.0, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density by averaged periodograms of half-overlapping Hann windows, means removed (Welch 1967)."""
    n = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    parts = np.stack([x[a : a + n] for a in range(0, len(x) - n + 1, step)])
    parts = (parts - parts.mean(axis=1, keepdims=True)) * window
    p = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(axis=0) / (fs * (window**2).sum())
    p[1 : (len(p) - 1 if n % 2 == 0 else len(p))] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def spectral_features(x: np.ndarray, fs: float = 1.0) -> tuple[float, float, float, float]:
    """Slope of log power over log frequency, entropy, flatness and centroid of the density."""
    f, p = welch(x, fs)
    some = (f > 0) & (p > 0)
    slope = float(np.polyfit(np.log10(f[some]), np.log10(p[some]), 1)[0]) if some.sum() > 1 else 0.0
    total = p.sum()
    if total <= 0:
        return slope, 0.0, 0.0, 0.0
    q = p[p > 0] / total
    return slope, float(-(q * np.log(q)).sum()), float(np.exp(np.log(p + 1e-12).mean()) / (p.mean() + 1e-12)), float((f * p).sum() / total)


def modwt(x: np.ndarray, levels: int, taps: np.ndarray = SYM4) -> tuple[list[np.ndarray], np.ndarray]:
    """Detail coefficients of each level and the last approximation, by circular filters in the frequency domain (Percival and Walden)."""
    n = len(x)
    g = taps / math.sqrt(2)
    h = np.array([(-1) ** k * g[len(g) - 1 - k] for k in range(len(g))])
    low, out = np.fft.fft(x), []
    for level in range(levels):
        place = (np.arange(len(g)) * 2**level) % n
        filters = []
        for c in (h, g):
            t = np.zeros(n)
            np.add.at(t, place, c)
            filters.append(np.fft.fft(t))
        out.append(np.fft.ifft(low * filters[0]).real)
        low = low * filters[1]
    return out, np.fft.ifft(low).real


def modwt_features(x: np.ndarray, most: int = 5) -> list[float]:
    """Energy, entropy and excess kurtosis of each detail level (``most`` at most, fewer in short windows), and the share of energy in details."""
    levels = min(most, int(math.log2(max(len(x) / 7, 2))))
    details, smooth = modwt(x, levels)
    out, total = [], float(smooth @ smooth)
    for d in details:
        e = float(d @ d)
        total += e
        q = d**2 / e if e > 0 else np.zeros(0)
        q = q[q > 0]
        v = d.var()
        out += [e, float(-(q * np.log2(q)).sum()), float(((d - d.mean()) ** 4).mean() / v**2 - 3) if v > 0 else 0.0]
    out += [0.0] * (9 - len(out))
    return [*out, sum(out[0:9:3]) / total if total > 0 else 0.0]


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk toward a multiple of the identity, and the shrinkage (Ledoit and Wolf 2004)."""
    n, p = x.shape
    c = x - x.mean(axis=0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = ((c**2).T @ (c**2) / n - s**2).sum() / (n * p)
    share = 0.0 if delta == 0 else min(max(beta, 0.0), delta) / delta
    return (1 - share) * s + share * mu * np.eye(p), share


class IsolationForest:
    """Trees that part random samples at random places; odd points end up alone soon (Liu, Ting and Zhou 2008)."""

    def __init__(self, x: np.ndarray, trees: int, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = min(samples, len(x))
        depth = math.ceil(math.log2(max(self.size, 2)))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def path(n: int) -> float:
        """Mean depth of an unsuccessful search among n."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
        lo, hi = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(0), np.zeros(0))
        wide = np.flatnonzero(hi > lo)
        if depth == 0 or len(x) <= 1 or not len(wide):
            return (len(x),)
        f = int(rng.choice(wide))
        at = rng.uniform(lo[f], hi[f])
        left = x[:, f] < at
        return f, at, self._grow(x[left], depth - 1, rng), self._grow(x[~left], depth - 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, near 1 for odd points."""
        total = np.zeros(len(x))
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)), 0)]
            while todo:
                node, rows, depth = todo.pop()
                if len(node) == 1:
                    total[rows] += depth + self.path(node[0])
                elif len(rows):
                    left = x[rows, node[0]] < node[1]
                    todo += [(node[2], rows[left], depth + 1), (node[3], rows[~left], depth + 1)]
        return 2 ** -(total / len(self.trees) / max(self.path(self.size), 1e-12))
