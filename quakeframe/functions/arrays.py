"""Functions of sample arrays as column expressions. Indices are 0-based, as in the waveform data."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once for the row, not once for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rounded(v: Column, n: int = 6) -> Column:
    """v to n decimals as DuckDB's round does it: scaled, half away from zero, and the sign stays on zeros (F.round drops it)."""
    return F.round(F.abs(v) * 10.0**n) / 10.0**n * F.signum(v)


def mean(x: Column) -> Column:
    """Mean, null without values."""
    return F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x))


def variance(x: Column) -> Column:
    """Population variance, by the mean of squares about the mean; null without values."""
    return let(mean(x), lambda m: F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(x)))


def peak(x: Column) -> Column:
    """Largest absolute value."""
    return F.array_max(F.transform(x, lambda v: F.abs(v)))


def normalise(x: Column, least: float = 1e-4) -> Column:
    """x over its largest absolute value; zeros where that is `least` at most."""
    return let(peak(x), lambda top: F.transform(x, lambda v: F.when(top > least, v / top).otherwise(F.lit(0.0))))


def pad_edges(x: Column, before: Column | int, after: Column | int) -> Column:
    """x with its first value repeated before it and its last one after it."""
    n = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.concat(F.array_repeat(F.element_at(x, 1), n(before)), x, F.array_repeat(F.element_at(x, -1), n(after)))


def padding(npts: Column, window: int, slide: int, pad_start: bool) -> dict[str, Column]:
    """total, start_pad and end_pad that let windows of that slide cover npts samples with an edge to trim."""
    edge = (window - slide) // 2
    start = F.lit(edge if pad_start else 0)
    rest = F.pmod(npts + start - window, F.lit(slide))
    end = slide - rest
    end = F.when(end < edge, end + slide).otherwise(end)
    return {"total": npts + start + end, "start_pad": start, "end_pad": end}


def window_starts(npts: Column, window: int, slide: int) -> Column:
    """0, slide, ... for the (npts - window) // slide + 1 whole windows."""
    n = F.floor((npts - window) / slide)
    return F.when(n >= 0, F.sequence(F.lit(0), (n * slide).cast("int"), F.lit(slide))).otherwise(F.array().cast("array<int>"))


def cut(x: Column, first: Column, n: int) -> Column:
    """n samples from `first` on; null if they don't all lie in x."""
    ok = (first >= 0) & (first + n <= F.size(x))
    return F.when(ok, F.slice(x, F.greatest(first, F.lit(0)) + 1, F.lit(n)))


def cut_padded(x: Column, first: Column, n: int) -> Column:
    """Always n samples from `first` on, zeros where they lie outside x."""
    before = F.least(F.lit(n), F.greatest(-first, F.lit(0)))
    size = F.greatest(F.lit(0), F.least(F.size(x) - F.greatest(first, F.lit(0)), n - before))
    inside = F.slice(x, F.greatest(first, F.lit(0)) + 1, size)
    return F.concat(F.array_repeat(F.lit(0.0), before.cast("int")), inside, F.array_repeat(F.lit(0.0), (n - before - size).cast("int")))


def fitted(x: Column, first: Column, n: Column) -> Column:
    """The n samples of x from `first` on (from 0, may be negative), zeros where x has none."""
    lead = F.least(n, F.greatest(-first, F.lit(0))).cast("int")
    at = F.greatest(first, F.lit(0)).cast("int")
    taken = F.greatest(F.least(F.size(x), first + n) - at, F.lit(0)).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    return F.concat(zeros(lead), F.slice(x, at + 1, taken), zeros((n - lead - taken).cast("int")))


def sample_index(time: Column, start: Column, dt: float) -> Column:
    """Index of the sample nearest to a time, half up, truncated toward zero."""
    return ((time - start) / dt + 0.5).cast("int")


def boxcar(n: Column | int, centre: Column, width: Column) -> Column:
    """0/1 mask of a width around a centre; all 0 for a negative centre."""
    size = F.lit(n) if isinstance(n, int) else n
    half = F.floor(width / 2)
    bounds = F.struct(F.when(centre >= 0, centre - half).otherwise(size).alias("a"), (centre + half).alias("b"))
    return let(bounds, lambda w: F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when((i >= w["a"]) & (i <= w["b"]), 1).otherwise(0)))


def boxcar_width(quality: Column, widths: tuple[int, int, int] = (21, 31, 51)) -> Column:
    """Width of the mask of a quality class 1.0, 0.75 or 0.5."""
    return F.when(quality == 1.0, widths[0]).when(quality == 0.75, widths[1]).when(quality == 0.5, widths[2])


def snr(x: Column, pick: Column, half: int) -> Column:
    """10 log10 of the mean square in a pick's mask (`half` samples on both sides, clipped at the ends) to that in as many samples before it, each about its mean; -999 for noise, null without spread."""
    first = F.greatest(pick - half, F.lit(0))
    n = F.greatest(F.least(F.size(x), pick + half + 1) - first, F.lit(0))
    before = F.greatest(first - n, F.lit(0))
    ratio = F.try_divide(variance(F.slice(x, first + 1, n)), variance(F.slice(x, before + 1, first - before)))
    return F.when((pick < 0) | (first - before < 1), F.lit(-999.0)).otherwise(F.when(ratio > 0, 10 * F.log10(ratio)))


def transverse(north: Column, east: Column, azimuth: Column) -> Column:
    """The transverse component of two horizontal ones, by the azimuth in degrees."""
    turn = F.struct(F.sin(F.radians(azimuth)).alias("s"), F.cos(F.radians(azimuth)).alias("c"))
    return let(turn, lambda t: F.zip_with(north, east, lambda n, e: e * t["c"] - n * t["s"]))


def snr_transverse(north: Column, east: Column, azimuth: Column, pick: Column, half: int) -> Column:
    """`snr` of the transverse component, as for S picks; an azimuth of null counts as 0."""
    return let(transverse(north, east, F.coalesce(azimuth, F.lit(0.0))), lambda x: snr(x, pick, half))


def argmax(p: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def single_pick(p: Column, centre: int | None = None) -> Column:
    """First maximum, of the whole series or within `centre` samples of its middle."""
    if centre is None:
        return argmax(p)
    first = (F.floor(F.size(p) / 2) - centre).cast("int")
    return argmax(F.slice(p, first + 1, F.lit(2 * centre))) + first


def quantised(p: Column) -> Column:
    """Probabilities as truncated hundredths in one byte."""
    return F.transform(p, lambda v: (v * 100).cast("tinyint"))


def strip_trailing_zeros(x: Column) -> Column:
    """x up to its last non-zero sample."""
    last = F.aggregate(F.transform(x, lambda v, i: F.when(v != 0, i + 1).otherwise(0)), F.lit(0), lambda a, i: F.greatest(a, i))
    return F.slice(x, F.lit(1), last)


def zeroed_if_bad(x: Column, ones: int = 5) -> Column:
    """Zeros in place of a window with a NaN or more than `ones` samples of exactly 1."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v)) | (F.size(F.filter(x, lambda v: v == 1.0)) > ones)
    return F.when(bad, F.transform(x, lambda v: F.lit(0.0))).otherwise(x)


def jaccard(y: Column, p: Column, threshold: float) -> Column:
    """Overlap of the samples at or over a threshold in both; 1 if neither has one."""
    both = F.aggregate(F.zip_with(y, p, lambda a, b: ((a >= threshold) & (b >= threshold)).cast("int")), F.lit(0), lambda s, v: s + v)
    either = F.aggregate(F.zip_with(y, p, lambda a, b: ((a >= threshold) | (b >= threshold)).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(either == 0, 1.0).otherwise(both / either)


def equal_samples(y: Column, p: Column, threshold: float) -> Column:
    """Number of samples where p >= threshold says what the mask y says."""
    return F.aggregate(F.zip_with(y, p, lambda a, b: ((b >= threshold).cast("int") == a).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def random_lag(seed: str, key: Column, copy: Column, most: int) -> Column:
    """A lag from -most to most, from the md5 of seed, key and copy."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), copy.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (h % (2 * most + 1) - most).cast("int")


def random_integer(seed: str, key: Column, draw: int, low: Column, high: Column) -> Column:
    """A number from low to high - 1, the `draw`-th of a key's stream: 52 bits of the md5 of seed, key and draw. Null where there is none between."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), F.lit(str(draw)))), 1, 13), 16, 10).cast("bigint")
    return F.when(high > low, low + F.pmod(h, F.greatest(high - low, F.lit(1))))


def pad_length(seconds: float, dt: float) -> int:
    """Samples of a window with both its ends, made up to a multiple of 16, as networks that halve it four times want it."""
    n = int(seconds / dt + 0.5) + 1
    return -(-n // 16) * 16


def largest_lag(max_shift: float, n: int) -> int:
    """The largest lag: a number of samples, or, up to 1, that share of half a window of n samples."""
    return int(max_shift * n / 2) if max_shift <= 1.0 else int(max_shift)


def scaled_pair(x1: Column, x2: Column, m1: Column, m2: Column) -> tuple[Column, Column]:
    """Two events over their largest values and about their means, the smaller one scaled to 10^-|m1 - m2| of the larger."""
    centred = lambda x: let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    unit = lambda x: let(normalise(x, 0.0), centred)
    smaller = F.pow(F.lit(10.0), -F.abs(m1 - m2))
    scaled = lambda x, f: let(f, lambda g: F.transform(x, lambda v: v * g))
    return scaled(unit(x1), F.when(m1 < m2, smaller).otherwise(1.0)), scaled(unit(x2), F.when(m1 < m2, 1.0).otherwise(smaller))


def calibrated_bound(y: Column, std: Column, q: float) -> Column:
    """y + std * z, with z the normal quantile of q."""
    from statistics import NormalDist

    return y + std * NormalDist().inv_cdf(q)


def sorted_quantile(s: Column, q: float) -> Column:
    """Interpolated quantile of a sorted array."""
    at = (F.size(s) - 1) * q
    low = F.get(s, F.floor(at).cast("int"))
    return low + (at - F.floor(at)) * (F.get(s, F.ceil(at).cast("int")) - low)


def fenced_summary(x: Column, k: float) -> Column:
    """Median, std and number of the values strictly between the quartiles moved out by k times their distance; 0, 0, 0 without any."""

    def inside(s: Column) -> Column:
        quartiles = F.struct(sorted_quantile(s, 0.25).alias("a"), sorted_quantile(s, 0.75).alias("b"))
        return let(quartiles, lambda q: F.filter(s, lambda v: (v > q["a"] - k * (q["b"] - q["a"])) & (v < q["b"] + k * (q["b"] - q["a"]))))

    def summary(f: Column) -> Column:
        std = let(mean(f), lambda m: F.sqrt(F.aggregate(f, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(f)))
        some = F.size(f) > 0
        return F.struct(F.when(some, sorted_quantile(f, 0.5)).otherwise(0.0).alias("shift"), F.when(some, std).otherwise(0.0).alias("std"), F.size(f).alias("n"))

    return F.when(x.isNotNull(), let(F.array_sort(F.transform(x, lambda v: v.cast("double"))), lambda s: let(inside(s), summary)))


def mixed_window(x1: Column, x2: Column, first: Column, second: Column, offset: Column, n: int, lead: int = 10, taper: int = 9) -> Column:
    """n samples of two events on top of each other, from `offset` on.

    Both traces have their arrival in the middle. The first one's lies at `first`; the second one is cut from `lead` samples before its
    arrival, sloped in over `taper` samples by a cosine, and arrives at `second`. Zeros where a trace has ended.
    """

    def sample(j: Column) -> Column:
        i = j + offset
        k = i - second + lead
        own = F.coalesce(F.get(x1, (F.floor(F.size(x1) / 2) - first + i).cast("int")), F.lit(0.0))
        other = F.coalesce(F.get(x2, (F.floor(F.size(x2) / 2) - lead + k).cast("int")), F.lit(0.0))
        slope = F.when(k < taper, 0.5 * (1 - F.cos(math.pi * k / taper))).otherwise(1.0)
        return own + F.when(k >= 0, other * slope).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample)


def two_boxcars(first: Column, second: Column, offset: Column, n: int, half: int) -> Column:
    """0/1 mask of n samples from `offset` on, `half` samples on both sides of two arrivals."""
    near = lambda i, at: F.abs(i + offset - at) <= half
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(near(i, first) | near(i, second), 1).otherwise(0))


def first_motion_index(idx: Column, correction: Column) -> Column:
    """Pick index moved by a correction in seconds, rounded half to even."""
    return F.bround(idx + correction * 100).cast("long")


def polarity(p: Column) -> Column:
    """1, -1 or 0 for the largest of the probabilities up, down, unknown; the first of equals."""
    return F.element_at(F.array(F.lit(1), F.lit(-1), F.lit(0)), F.array_position(p, F.array_max(p)).cast("int"))
