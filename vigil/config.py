"""Geometry and limits of the scores, in one place."""

from __future__ import annotations

from dataclasses import dataclass

#: Window geometry of the count-based scores, and of the queries over the driver's tables.
WINDOW, STRIDE = 256, 64
QUERY_WINDOW, QUERY_STRIDE = 64, 16
SENSORS = ("vibration", "microphone", "magnetometer", "gyroscope", "accelerometer", "current", "photodiode", "pressure", "temperature")
IMU = ("magnetometer", "gyroscope", "accelerometer")
TIERS = {"fast": SENSORS[:5], "medium": SENSORS[5:7], "slow": SENSORS[7:]}
RELATIVE_TOLERANCE, NUMERIC_FLOOR, Z_CLIP = 0.10, 2.220446049250313e-14, 10.0
HORIZON_MS = 20_000


@dataclass(frozen=True)
class ReferenceConfig:
    """Settings of the covariance, isolation and residual score."""

    target_fpr: float = 0.05
    ewma_alpha: float = 0.15
    trees: int = 64
    samples: int = 256
    seed: int = 42
    odds: float = 9.0
    least_windows: int = 20
    weight_floor: float = 0.05
    weight_ratio: float = 3.0
    sparse_values: int = 16
    flat_fraction: float = 0.98
    outlier_mads: float = 20.0

    def validate(self) -> None:
        if not 0 < self.target_fpr < 1 or not 0 < self.ewma_alpha <= 1:
            raise ValueError("target_fpr and ewma_alpha are shares")
        if min(self.trees, self.samples, self.least_windows) < 1 or self.odds <= 1:
            raise ValueError("counts start at 1 and odds exceed 1")


@dataclass(frozen=True)
class FusedConfig:
    """Settings of the equally weighted fused score."""

    window_s: float = 3.0
    overlap: float = 0.5
    trees: int = 200
    seed: int = 0
    ewma_lambda: float = 0.1
    upper: float = 0.99
    alarm: float = 0.05
    least_windows: int = 20

    def validate(self) -> None:
        if self.window_s <= 0 or not 0 <= self.overlap < 1 or not 0 < self.ewma_lambda <= 1:
            raise ValueError("window_s is positive, overlap below 1, ewma_lambda a share")

    def geometry(self, fs: float) -> tuple[int, int]:
        """Samples in a window, and from one to the next."""
        w = max(8, round(self.window_s * fs))
        return w, max(1, round(w * (1 - self.overlap)))
