"""Spectra of sample arrays: Arrow-batched NumPy where Spark has no transform, joins for filter banks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hann(n: int, symmetric: bool) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1 if symmetric else n))


def magnitudes(samples: np.ndarray, size: int, hop: int, window: np.ndarray | None, centred: bool, frames: int | None) -> np.ndarray:
    """Of signals in rows: frames by bins each; a centred signal is padded with zeros by half a frame on both sides; short signals make one frame."""
    side = size // 2 if centred else 0
    x = np.pad(samples, ((0, 0), (side, side + max(0, size - samples.shape[1] - 2 * side))))
    cut = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
    cut = cut if frames is None else cut[:, :frames]
    return np.abs(np.fft.rfft(cut if window is None else cut * window, axis=2))


#: Numbers that are worked on at once.
BATCH_NUMBERS = 4_000_000


def by_length(column: pa.Array, work, per_number: int = 1, depth: int = 1) -> pa.Array:
    """`work` on lists of numbers, in matrices of rows of one length with bounded numbers of elements; null stays null.

    `work` makes an array whose first axis is the rows; the further ones, `depth` of them, become lists.
    """
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(np.maximum(sizes, 0))
    parts, places = [], []
    for n in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == n)
        step = max(1, BATCH_NUMBERS // max(1, n * per_number))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            done = work(values[(ends[own] - n)[:, None] + np.arange(n)])
            parts.append(lists(done))
            places.append(own)
    return in_places(parts, places, len(sizes), depth)


def in_places(parts: list[pa.Array], places: list[np.ndarray], n: int, depth: int) -> pa.Array:
    """`n` rows, those of each part at its places, null where there is none."""
    kind = pa.float64()
    for _ in range(depth):
        kind = pa.list_(kind)
    back = np.full(n, -1)
    if places:
        back[np.concatenate(places)] = np.arange(sum(map(len, places)))
    found = pa.concat_arrays(parts) if parts else pa.nulls(0, kind)
    return found.take(pa.array(back, mask=back < 0)).cast(kind)


def lists(x: np.ndarray) -> pa.Array:
    """An array of two or more dimensions as nested lists."""
    flat = pa.array(x.ravel())
    for depth in range(x.ndim - 1, 0, -1):
        count = int(np.prod(x.shape[:depth]))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * x.shape[depth]), flat)
    return flat


def stft(size: int, hop: int, symmetric: bool = False, centred: bool = False, window: bool = True, frames: int | None = None):
    """An Arrow function: samples to magnitudes, an array of frames of bins."""
    shape = hann(size, symmetric) if window else None

    @F.arrow_udf("array<array<double>>")
    def spectrum(samples: pa.Array) -> pa.Array:
        return by_length(samples, lambda x: magnitudes(x, size, hop, shape, centred, frames), -(-size // hop), depth=2)

    return spectrum


def long_form(df: DataFrame, column: str) -> DataFrame:
    """Rows (other columns, frame, bin, magnitude) of an array of frames."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("frame", "__bins")).select(*rest, "frame", F.posexplode("__bins").alias("bin", "magnitude"))


def _mel(hz: float) -> float:
    return hz * 3 / 200 if hz < 1000 else 15 + math.log(hz / 1000) * 27 / math.log(6.4)


def _hz(mel: float) -> float:
    return mel * 200 / 3 if mel < 15 else 1000 * math.exp((mel - 15) * math.log(6.4) / 27)


def mel_matrix(filters: int, size: int, rate: int, low: float, high: float | None = None) -> np.ndarray:
    """Filters by bins: triangles of unit area."""
    a, b = _mel(low), _mel(high or rate / 2)
    edges = np.array([_hz(a + (b - a) * i / (filters + 1)) for i in range(filters + 2)])
    x, y, z = (edges[i : filters + i, None] for i in range(3))
    hz = np.arange(size // 2 + 1)[None, :] * rate / size
    return np.maximum(0.0, np.minimum((hz - x) / (y - x), (z - hz) / (z - y))) * 2 / (z - x)


def mel_weights(spark: SparkSession, filters: int, size: int, rate: int, low: float, high: float | None = None) -> DataFrame:
    """mel, bin, weight: the nonzero weights of triangles of unit area. A small table: filters times bins at most."""
    bank = mel_matrix(filters, size, rate, low, high)
    rows = [(m, k, float(bank[m, k])) for m, k in np.argwhere(bank > 0).tolist()]
    return spark.createDataFrame(rows, "mel int, bin int, weight double")


def mel_energies(spectrum: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """by, mel, energy: weighted sums of `magnitude` over bins."""
    return spectrum.join(F.broadcast(weights), "bin").groupBy(*by, "mel").agg(F.sum(F.col("weight") * F.col("magnitude")).alias("energy"))


def cepstra(n: int, floor: float = 1e-10, range_db: float = 80.0):
    """An Arrow function: power bands to the first `n` cosine coefficients (orthonormal) of their decibels, scaled to 0 to 1."""

    def coefficients_of(p: np.ndarray) -> np.ndarray:
        if not p.shape[1]:
            return np.zeros((len(p), 0))
        db = 10 * np.log10(np.maximum(p, floor)) - 10 * np.log10(np.maximum(p.max(1, keepdims=True), floor))
        db = np.maximum(db, db.max(1, keepdims=True) - range_db)
        k, i = np.arange(n)[:, None], np.arange(p.shape[1])[None, :]
        turns = np.cos(np.pi * k * (2 * i + 1) / (2 * p.shape[1])) * np.sqrt(np.where(k == 0, 1.0, 2.0) / p.shape[1])
        c = db @ turns.T
        low, high = c.min(1, keepdims=True), c.max(1, keepdims=True)
        return (c - low) / (high - low + 1e-10)

    @F.arrow_udf("array<double>")
    def coefficients(power: pa.Array) -> pa.Array:
        return by_length(power, coefficients_of)

    return coefficients


def smoothing(seconds: float, rate: int, hop: int) -> float:
    """The coefficient of a first-order filter with that time constant."""
    frames = seconds * rate / hop
    return (math.sqrt(1 + 4 * frames**2) - 1) / (2 * frames**2)


def gain_controlled(s: np.ndarray, b: float, gain: float, bias: float, power: float, floor: float) -> np.ndarray:
    """Magnitudes (signals, frames, bins) with gain control per bin; the filter starts in the state that a steady unit input leaves."""
    out, m = np.empty_like(s), 1.0
    for t in range(s.shape[1]):
        m = (1 - b) * m + b * s[:, t]
        smooth = np.exp(-gain * (math.log(floor) + np.log1p(m / floor)))
        out[:, t] = bias**power * np.expm1(power * np.log1p(s[:, t] * smooth / bias))
    return out


def pcen(gain: float = 0.98, bias: float = 2.0, power: float = 0.5, seconds: float = 0.4, rate: int = 22_050, hop: int = 512, floor: float = 1e-6, scale: float = 2.0**31):
    """An Arrow function: magnitudes (frames of bins) with gain control per bin. A signal without frames stays so."""
    b = smoothing(seconds, rate, hop)

    @F.arrow_udf("array<array<double>>")
    def normalized(spectra: pa.Array) -> pa.Array:
        frames = pc.fill_null(pc.list_value_length(spectra), -1).to_numpy(zero_copy_only=False)
        rows = spectra.flatten()
        widths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        first = np.cumsum(np.maximum(frames, 0)) - np.maximum(frames, 0)
        width = np.where(frames > 0, np.append(widths, 0)[np.minimum(first, len(widths))], 0)
        # A spectrogram is one row of numbers here: frames of equal width, one after the other.
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.maximum(frames, 0) * width))).astype(np.int32)), rows.flatten())
        parts, places = [], []
        for n, w in sorted({(int(n), int(w)) for n, w in zip(frames, width, strict=True) if n >= 0}):
            rows_of = np.flatnonzero((frames == n) & (width == w))
            step = max(1, BATCH_NUMBERS // max(1, n * w))
            for own in (rows_of[at : at + step] for at in range(0, len(rows_of), step)):
                x = flat.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), n, w)
                parts.append(lists(gain_controlled(x * scale, b, gain, bias, power, floor)))
                places.append(own)
        return in_places(parts, places, len(frames), 2)

    return normalized


def polyphase(rate_in: int, rate_out: int, half: int = 10, beta: float = 5.0) -> tuple[int, int, np.ndarray]:
    """(up, down, taps): a windowed sinc with unit gain, 2 half + 1 times the larger rate long."""
    g = math.gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    widest = max(up, down)
    t = np.arange(-half * widest, half * widest + 1)
    taps = np.sinc(t / widest) * np.kaiser(len(t), beta)
    return up, down, taps / taps.sum() * up


#: Outputs that are worked out at once.
BLOCK_OUTPUTS = 32_768


def resample(x: np.ndarray, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Signals in rows at up / down times their rate: each output takes the one phase of the taps that meets samples."""
    n = x.shape[1]
    if up == down or not n:
        return x
    outputs, middle, reach = -(-n * up // down), len(taps) // 2, -(-len(taps) // up)
    phases = np.zeros(reach * up)
    phases[: len(taps)] = taps
    phases = phases.reshape(reach, up).T[:, ::-1]  # a row a phase, in the order of the samples
    place = np.arange(outputs) * down + middle
    last = place // up
    wide = np.pad(x, ((0, 0), (reach - 1, max(0, int(last[-1]) + 1 - n))))
    views = np.lib.stride_tricks.sliding_window_view(wide, reach, axis=1)
    out = np.empty((len(x), outputs))
    step = max(1, BLOCK_OUTPUTS // len(x))
    for a in range(0, outputs, step):
        own = slice(a, a + step)
        out[:, own] = np.einsum("nkj,kj->nk", views[:, last[own]], phases[place[own] % up])
    return out


def resampled(rate_in: int, rate_out: int, half: int = 10, beta: float = 5.0):
    """An Arrow function: samples at another rate, by a windowed sinc in polyphase; ceil(n out / in) samples."""
    up, down, taps = polyphase(rate_in, rate_out, half, beta)

    @F.arrow_udf("array<double>")
    def changed(samples: pa.Array) -> pa.Array:
        return by_length(samples, lambda x: resample(x, up, down, taps))

    return changed
