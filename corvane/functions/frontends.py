"""What models are fed: from samples to the feature of any frontend and magnitude scale, in one Arrow function.

Signals of one length are a matrix; framing, transform, filter bank, scale and normalization are matrix
operations on it, so a batch takes a few NumPy calls and no row of a spectrum becomes a row of a table.
Features are arrays of rows (bands, coefficients or bins) of frames, scaled to 0 to 1; the raw frontend's are
the samples as one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.spectral import by_length, gain_controlled, hann, magnitudes, mel_matrix, smoothing

#: The frontends and magnitude scales there are.
FRONTENDS = ("librosa", "hybrid", "raw", "mfcc", "log_mel")
SCALES = ("none", "pwl", "pcen", "db")
#: Knees and slopes of the piecewise compression, the least power and amplitude, and the range of decibels.
KNEES, SLOPES = (0.0, 0.10, 0.35, 0.65), (0.40, 0.25, 0.15, 0.08)
LEAST_POWER, RANGE_DB, PCM_PEAK, LOWEST_HZ = 1e-10, 80.0, 2.0**31, 150.0
FLOOR = 1e-10


@dataclass(frozen=True)
class Feature:
    """A frontend with its sizes. `scale` counts for the mel frontend only."""

    frontend: str
    rate: int
    scale: str = "none"
    size: int = 512
    width: int = 256
    bands: int = 64
    coefficients: int = 20

    def __post_init__(self):
        if self.frontend not in FRONTENDS:
            raise ValueError(f"unknown frontend: {self.frontend}")
        if self.scale not in SCALES:
            raise ValueError(f"unknown magnitude scale: {self.scale}")

    def hop(self, samples: int) -> int:
        """Samples between frames, so that `width` frames cover the signal."""
        return max(1, samples // self.width if self.width > 0 else self.size // 2)

    def shape(self, samples: int) -> tuple[int, int]:
        """Rows and frames of the feature of so many samples."""
        rows = {"raw": 1, "hybrid": self.size // 2 + 1, "mfcc": min(self.coefficients, self.bands)}.get(self.frontend, self.bands)
        if self.frontend == "raw":
            return rows, samples
        frames = 1 + max(0, samples + 2 * (self.size // 2) - self.size) // self.hop(samples)
        return rows, min(frames, self.width) if self.width > 0 else frames


def min_max(x: np.ndarray) -> np.ndarray:
    """Each feature of the stack scaled to 0 to 1."""
    axes = tuple(range(1, x.ndim))
    low, high = x.min(axes, keepdims=True), x.max(axes, keepdims=True)
    return (x - low) / (high - low + FLOOR)


def power_db(power: np.ndarray) -> np.ndarray:
    """Decibels against each feature's largest power, not more than RANGE_DB below the loudest."""
    top = np.maximum(power.max((1, 2), keepdims=True), LEAST_POWER)
    db = 10 * np.log10(np.maximum(power, LEAST_POWER)) - 10 * np.log10(top)
    return np.maximum(db, db.max((1, 2), keepdims=True) - RANGE_DB)


def cosine_rows(n: int, bands: int) -> np.ndarray:
    """The first n rows of the orthonormal cosine transform."""
    k, i = np.arange(n)[:, None], np.arange(bands)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * bands)) * np.sqrt(np.where(k == 0, 1.0, 2.0) / bands)


def scaled(x: np.ndarray, feature: Feature, hop: int) -> np.ndarray:
    """Magnitudes (signals, frames, bands) on the feature's scale."""
    if feature.scale == "pwl":
        x = min_max(x)
        return sum(slope * np.maximum(x - knee, 0.0) for slope, knee in zip(SLOPES, KNEES, strict=True))
    if feature.scale == "pcen":
        return gain_controlled(x * PCM_PEAK, smoothing(0.4, feature.rate, hop), 0.98, 2.0, 0.5, 1e-6)
    return power_db(x * x) if feature.scale == "db" else x


def computed(x: np.ndarray, feature: Feature) -> np.ndarray:
    """Features (signals, rows, frames) of signals in rows."""
    if feature.frontend == "raw":
        return x[:, None, :]
    rows, frames = feature.shape(x.shape[1])
    if not x.shape[1]:
        return np.zeros((len(x), rows, 0))
    hop = feature.hop(x.shape[1])
    spectrum = magnitudes(x, feature.size, hop, hann(feature.size, False), True, None)
    if feature.frontend == "hybrid" or feature.bands <= 0:
        out = scaled(spectrum[:, :frames], feature, hop) if feature.frontend == "librosa" else spectrum[:, :frames]
    else:
        bank = mel_matrix(feature.bands, feature.size, feature.rate, LOWEST_HZ)
        if feature.frontend == "mfcc":
            out = (power_db(spectrum**2 @ bank.T) @ cosine_rows(rows, feature.bands).T)[:, :frames]
        elif feature.frontend == "log_mel":
            out = np.log1p((spectrum @ bank.T)[:, :frames])
        else:
            out = scaled((spectrum @ bank.T)[:, :frames], feature, hop)
    return min_max(out).transpose(0, 2, 1)


def features(feature: Feature):
    """An Arrow function: samples to their feature, an array of rows of frames; null stays null."""
    overlap = 1 if feature.frontend == "raw" else 2 + feature.size // max(1, feature.width)

    @F.arrow_udf("array<array<double>>")
    def made(samples: pa.Array) -> pa.Array:
        return by_length(samples, lambda x: computed(x, feature), overlap, depth=2)

    return made


def flat(feature: Column) -> Column:
    """A feature's numbers one after the other, by rows."""
    return F.flatten(feature)
