"""Detectors fitted per recording on its calibration windows, one recording's feature matrix at a time.

A recording's calibration windows are bounded by ``bounded_sample`` before, so a group stays small however long it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vigil.config import FusedConfig, ReferenceConfig
from vigil.functions.shipping import ship
from vigil.functions.signals import IsolationForest, ledoit_wolf


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["features"].tolist(), dtype=float).reshape(len(rows), -1)


def _standard(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
    scale = x[fit].std(axis=0)
    keep = scale > 1e-6
    return (x[:, keep] - x[fit][:, keep].mean(axis=0)) / (scale[keep] + 1e-9)


def _ewma(z: np.ndarray, start: float, weight: float) -> np.ndarray:
    out, state = np.empty(len(z)), start
    for i, v in enumerate(z):
        state = out[i] = (1 - weight) * state + weight * v
    return out


def fused_raw(features: DataFrame, config: FusedConfig = FusedConfig()) -> DataFrame:
    """(recording_id, win_no, calibration, isolation, mahalanobis, ewma) from (recording_id, win_no, calibration, features).

    Recordings with fewer calibration windows than ``least_windows`` give null scores.
    """
    ship(features.sparkSession)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("win_no")
        fit = rows["calibration"].to_numpy(bool)
        out = rows[["recording_id", "win_no", "calibration"]].copy()
        if fit.sum() < config.least_windows:
            return out.assign(isolation=None, mahalanobis=None, ewma=None)
        z = _standard(_matrix(rows), fit)
        inverse = np.linalg.pinv(np.cov(z[fit].T, bias=True).reshape(z.shape[1], -1))
        centred = z - z[fit].mean(axis=0)
        norm = np.linalg.norm(z, axis=1)
        first = _ewma(norm[fit], 0.0, config.ewma_lambda)
        return out.assign(
            isolation=IsolationForest(z[fit], config.trees, 256, config.seed).score(z),
            mahalanobis=np.einsum("ij,jk,ik->i", centred, inverse, centred),
            ewma=_ewma(norm, float(first.mean()), config.ewma_lambda),
        )

    return features.groupBy("recording_id").applyInPandas(score, "recording_id string, win_no long, calibration boolean, isolation double, mahalanobis double, ewma double")


def reference_raw(features: DataFrame, config: ReferenceConfig = ReferenceConfig()) -> DataFrame:
    """As ``fused_raw`` with the shrunk covariance, a smaller forest and residuals from the running mean before each window."""
    ship(features.sparkSession)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("win_no")
        fit = rows["calibration"].to_numpy(bool)
        out = rows[["recording_id", "win_no", "calibration"]].copy()
        if fit.sum() < config.least_windows:
            return out.assign(isolation=None, mahalanobis=None, ewma=None, shrinkage=None)
        z = _standard(_matrix(rows), fit)
        cov, share = ledoit_wolf(z[fit])
        inverse = np.linalg.pinv(cov)
        centred = z - z[fit].mean(axis=0)
        state, residual = np.zeros(z.shape[1]), np.empty(len(z))
        for i, v in enumerate(z):
            residual[i] = np.linalg.norm(v - state) / max(1, z.shape[1]) ** 0.5
            state = config.ewma_alpha * v + (1 - config.ewma_alpha) * state
        return out.assign(
            isolation=IsolationForest(z[fit], config.trees, config.samples, config.seed).score(z) - 0.5,
            mahalanobis=np.einsum("ij,jk,ik->i", centred, inverse, centred),
            ewma=residual,
            shrinkage=share,
        )

    return features.groupBy("recording_id").applyInPandas(score, "recording_id string, win_no long, calibration boolean, isolation double, mahalanobis double, ewma double, shrinkage double")
