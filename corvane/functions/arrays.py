"""Column functions on arrays of samples and on their sizes. Samples are doubles: cast before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(samples: Column) -> Column:
    return samples.cast("array<double>")


def total(samples: Column, of=lambda x: x) -> Column:
    """The sum of `of` each element; 0 for an empty array."""
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + of(x))


def mean(samples: Column, of=lambda x: x) -> Column:
    """The mean of `of` each element; null for an empty array."""
    return F.try_divide(total(samples, of), F.size(samples).cast("double"))


def std(samples: Column) -> Column:
    """The population's standard deviation."""
    return F.sqrt(element_of(mean(samples), lambda m: mean(samples, lambda x: (x - m) * (x - m))))


def element_of(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def peak(samples: Column) -> Column:
    """The largest absolute value; null for an empty array."""
    return F.array_max(F.transform(samples, F.abs))


def peak_normalized(samples: Column) -> Column:
    """Divided by the peak, if that is over 0."""
    return element_of(peak(samples), lambda p: F.when(p > 0, F.transform(samples, lambda x: x / p)).otherwise(samples))


def model_input(samples: Column, width: int, floor: float = 1e-6) -> Column:
    """Divided by the peak and a small constant, then cut or padded with zeros to `width`."""
    scaled = element_of(peak(samples), lambda p: F.transform(samples, lambda x: x / (p + floor)))
    return fitted(scaled, width)


def fitted(samples: Column, width: int | Column) -> Column:
    """Cut or padded with zeros at the end to `width` elements."""
    wanted = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.slice(samples, F.lit(1), wanted), F.array_repeat(F.lit(0.0), F.greatest(wanted - F.size(samples), F.lit(0))))


def min_max(samples: Column, floor: float = 1e-10) -> Column:
    """(x - min) / (max - min + floor)."""
    return element_of(F.struct(F.array_min(samples).alias("lo"), F.array_max(samples).alias("hi")), lambda r: F.transform(samples, lambda x: (x - r["lo"]) / (r["hi"] - r["lo"] + floor)))


def n_chunks(n: Column, size: Column | int, step: Column | int) -> Column:
    """Chunks of a signal of n samples: none, one, or all steps and one more for an uncovered tail."""
    size, step = (F.lit(x) if isinstance(x, int) else x for x in (size, step))
    rest = n - size
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(1 + F.floor(rest / step) + (F.pmod(rest, step) != 0).cast("int")).cast("int")


def chunk_starts(n: Column, size: int, step: int) -> Column:
    """Where chunks begin: every `step`, and once more at n - size if a tail stays uncovered; 0 for short signals."""
    rest = n - size
    whole = F.sequence(F.lit(0), rest, F.lit(step))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.when(F.pmod(rest, F.lit(step)) != 0, F.array_append(whole, rest)).otherwise(whole))


def chunks(samples: Column, size: int, step: int) -> Column:
    """An array of (start, samples): the chunks, the only one of a short signal padded with zeros."""
    starts = chunk_starts(F.size(samples), size, step)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), fitted(F.slice(samples, s + 1, F.lit(size)), size).alias("samples")))


def overlap_step(size: int, overlap: int, least: int) -> int:
    """The step for an overlap held to 0 at least and `size - least` at most."""
    return size - min(max(overlap, 0), size - least)


def centre(items: Column) -> Column:
    """The middle element: place n div 2."""
    return F.get(items, F.floor(F.size(items) / 2).cast("int"))


def short_time_energy(samples: Column, frame: int, hop: int) -> Column:
    """Mean square of each full frame; an array shorter than a frame is one frame."""
    last = F.greatest(F.size(samples) - frame, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(hop)), lambda s: mean(F.slice(samples, s + 1, F.lit(frame)), lambda x: x * x))


def rms(samples: Column) -> Column:
    return F.sqrt(mean(samples, lambda x: x * x))


def signal_to_noise(samples: Column, floor: float = 1e-10) -> Column:
    """Mean over the population's standard deviation."""
    return mean(samples) / (std(samples) + floor)


def pwl(x: Column) -> Column:
    """Piecewise linear compression. The slopes and knees are fixed values."""
    over = lambda knee: F.greatest(x - knee, F.lit(0.0))
    return 0.40 * x + 0.25 * over(0.10) + 0.15 * over(0.35) + 0.08 * over(0.65)


def pcen_like(x: Column) -> Column:
    """Gain control with pools of one element. The constants are fixed values."""
    gained = F.greatest(x - 0.6 * x, F.lit(0.0))
    return F.greatest(0.15 * gained + 0.45 * F.greatest(gained - 0.2, F.lit(0.0)), F.lit(0.0))


def decibels_below_top(values: Column, floor: float = 1e-5, range_db: float = 80.0) -> Column:
    """Amplitudes to decibels against the largest, `range_db` below it at least."""
    size = lambda x: F.greatest(F.abs(x), F.lit(floor))
    return element_of(F.array_max(F.transform(values, size)), lambda top: F.transform(values, lambda x: F.greatest(20.0 * F.log10(size(x)) - 20.0 * F.log10(top), F.lit(-range_db))))


def decibels(x: Column, floor: float = 1e-6) -> Column:
    return 10.0 * F.log10(F.greatest(x, F.lit(floor)))


def hz_to_mel(hz: Column) -> Column:
    """Linear to 1000 Hz (200/3 Hz a mel), then logarithmic with 27 mels to a factor of 6.4."""
    return F.when(hz < 1000.0, hz * 3.0 / 200.0).otherwise(15.0 + F.ln(hz / 1000.0) * 27.0 / F.ln(F.lit(6.4)))


def mel_to_hz(mel: Column) -> Column:
    return F.when(mel < 15.0, mel * 200.0 / 3.0).otherwise(1000.0 * F.exp((mel - 15.0) * F.ln(F.lit(6.4)) / 27.0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Cosine similarity; 1 if both are near zero, 0 if one is."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < floor) & (nb < floor), 1.0).when((na < floor) | (nb < floor), 0.0).otherwise(F.try_divide(dot(a, b), na * nb))


def pearson(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Correlation; 1 if either is constant."""
    centred = lambda v: element_of(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return element_of(
        F.struct(centred(a).alias("a"), centred(b).alias("b")),
        lambda c: element_of(F.sqrt(dot(c["a"], c["a"]) * dot(c["b"], c["b"])), lambda d: F.when(d < floor, 1.0).otherwise(F.try_divide(dot(c["a"], c["b"]), d))),
    )


def fake_quantized(values: Column, bits: int = 8) -> Column:
    """To the nearest of 2^bits levels between min and max (ties to even) and back; a constant array stays."""
    levels = float(2**bits - 1)
    bounds = F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"))
    step = element_of(bounds, lambda r: F.struct(r["lo"].alias("lo"), F.greatest((r["hi"] - r["lo"]) / levels, F.lit(1e-10)).alias("by")))
    return element_of(step, lambda s: F.transform(values, lambda x: F.rint((x - s["lo"]) / s["by"]) * s["by"] + s["lo"]))


def divisible(v: Column, by: int = 8) -> Column:
    """To the nearest multiple of `by`, that much at least."""
    return F.greatest(F.lit(by), (F.floor(F.floor(v + by / 2) / by) * by).cast("int"))


def hop_length(n: Column, width: int) -> Column:
    return F.greatest(F.lit(1), F.floor(n / width).cast("int"))


def strided_padding(n: Column, width: int, kernel: int = 16) -> Column:
    """(stride, left, right): the stride that gives `width` outputs, and the padding it needs."""
    stride = F.ceil(n / width).cast("int")
    pad = F.greatest(F.lit(0), stride * (width - 1) + kernel - n)
    left = F.floor(pad / 2).cast("int")
    return F.struct(stride.alias("stride"), left.alias("pad_left"), (pad - left).cast("int").alias("pad_right"))


def cosine_decay(step: Column, total_steps: int, rate: float) -> Column:
    return 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * step / float(total_steps))) * rate


def geometric_sweep(step: Column, low: float, high: float, n: int) -> Column:
    return low * F.pow(F.lit(high / low), step / float(n - 1))


def binary_focal_loss(y: Column, p: Column, gamma: float = 2.0, floor: float = 1e-7, from_logits: bool = False) -> Column:
    """(1 - p_t)^gamma times the cross-entropy of one probability, held off 0 and 1.

    From a logit, the entropy is that of its logistic (max(x, 0) - x y + ln(1 + exp(-|x|)), never infinite),
    and p_t is the logistic itself whatever the label, as the reference has it.
    """
    if from_logits:
        entropy = F.greatest(p, F.lit(0.0)) - p * y + F.log1p(F.exp(-F.abs(p)))
        return F.pow(1.0 - 1.0 / (1.0 + F.exp(-p)), F.lit(gamma)) * entropy
    held = F.least(F.greatest(p, F.lit(floor)), F.lit(1.0 - floor))
    entropy = -(y * F.ln(held) + (1.0 - y) * F.ln(1.0 - held))
    right = y * held + (1.0 - y) * (1.0 - held)
    return F.pow(1.0 - right, F.lit(gamma)) * entropy


def smoothed(y: Column, by: float, classes: int) -> Column:
    return (1.0 - by) * y + by / classes


def samples_per_epoch(files: Column, most: int = 1) -> Column:
    """About how many samples `files` files with 1 to `most` chunks each make; 1 at least."""
    return F.greatest(F.lit(1), F.floor(files * (1 + most) / 2)).cast("long")


def steps_per_epoch(samples: Column, batch: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(samples / batch)).cast("long")


def input_shape(frontend: Column, samples: Column, mels: int, width: int, fft: int, cepstra: int = 20) -> Column:
    """The shape of a model's input by its frontend, as text: bands, bins or coefficients by frames, or samples; an unknown frontend is an error."""
    framed = lambda rows: F.lit(f"{rows}x{width}x1")
    named = F.when(frontend == "raw", F.concat(samples.cast("string"), F.lit("x1"))).when(frontend == "hybrid", framed(fft // 2 + 1)).when(frontend == "mfcc", framed(cepstra))
    return named.when(frontend.isin("librosa", "log_mel"), framed(mels)).otherwise(F.raise_error(F.concat(F.lit("unknown frontend: "), frontend)).cast("string"))


def reservoir_limits(elements: Column, classes: int, batch: int, megabytes: float) -> Column:
    """(high, low) watermarks of a buffer of float samples of `elements` each and their labels.

    high: what the megabytes (1 at least) hold, 1,024 at most, but four batches and 32 in any case. low: a
    third of it, two batches at least, and a batch less than high where that would not be below it.
    """
    size = F.greatest((elements + classes) * 4, F.lit(1))
    held = F.floor(F.lit(int(max(megabytes, 1.0) * 1024 * 1024)) / size)
    high = F.greatest(F.lit(max(4 * batch, 32)), F.least(F.lit(1024), held))
    third = F.greatest(F.lit(2 * batch), F.floor(high / 3))
    low = F.when(third >= high, F.greatest(F.lit(batch), high - batch)).otherwise(third)
    return F.struct(high.cast("int").alias("high"), low.cast("int").alias("low"))
