"""Scalar expressions: levels, gains, curves, quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def db_to_linear(db: Column | float) -> Column:
    """Minus infinity gives 0."""
    return F.pow(F.lit(10.0), (F.lit(db) if isinstance(db, (int, float)) else db) / 20.0)


def linear_to_db(x: Column) -> Column:
    return 20.0 * F.log10(F.greatest(x, F.lit(1e-10)))


def power_to_lufs(power: Column, floor: float | None = None) -> Column:
    """-0.691 + 10 log10(power); silence is minus infinity unless a floor of the power is given."""
    if floor is not None:
        return -0.691 + 10.0 * F.log10(F.greatest(power, F.lit(floor)))
    return F.when(power > 0, -0.691 + 10.0 * F.log10(power)).otherwise(F.lit(float("-inf")))


def lufs_to_power(lufs: float) -> float:
    return 10 ** ((lufs + 0.691) / 10)


def loudness_gain(lufs: Column, target: float) -> Column:
    """1 where the loudness isn't finite."""
    finite = lufs.isNotNull() & ~F.isnan(lufs) & (F.abs(lufs) != float("inf"))
    return F.when(finite, F.pow(F.lit(10.0), (target - lufs) / 20.0)).otherwise(1.0)


def true_peak_gain(peak: Column, target_db: float) -> Column:
    return F.when(peak > 0, 10 ** (target_db / 20) / peak).otherwise(1.0)


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5), which is not what F.round does below zero."""
    return F.floor(x + 0.5)


def digits(x: Column, n: int) -> Column:
    """The nearest number of n decimals, ties away from zero, without the decimal text that F.round makes of
    every value; no minus zero."""
    size = F.abs(x * 10.0**n)
    whole = F.rint(size)
    return F.signum(x) * (whole + F.when(size - whole == 0.5, 1.0).otherwise(0.0)) / 10.0**n + 0.0


def quantize_pcm(x: Column, bits: int) -> Column:
    """A sample as an integer of so many bits: clamped, negative ones scaled by 2^(b-1), others by one less."""
    top = 1 << (bits - 1)
    clamped = F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    return round_half_up(clamped * F.when(x < 0, float(top)).otherwise(float(top - 1))).cast("long")


def quantize_level(x: Column, bits: int) -> Column:
    steps = float(1 << (bits - 1))
    return round_half_up(x * steps) / steps


def gain_curve(level_db: Column, pivot: float, limit: float, body: float, peak_gain: float, floor: float | None = None) -> Column:
    """Gain in dB: none under the floor, a ramp to `body` at the pivot, a ramp to the peak gain at the
    limit; above, the level is held where the limit ended."""
    above = peak_gain - (level_db - limit)
    upper = body + (peak_gain - body) * (level_db - pivot) / (limit - pivot)
    lower = F.lit(float(body)) if floor is None else body * (level_db - floor) / (pivot - floor)
    curve = F.when(level_db >= limit, above).when(level_db >= pivot, upper)
    return (curve if floor is None else curve.when(level_db <= floor, 0.0)).otherwise(lower)


def raised_cosine(progress: Column) -> Column:
    return 0.5 - 0.5 * F.cos(math.pi * progress)


def hertz_to_mel(f: Column) -> Column:
    return 2595.0 * F.log10(1.0 + f / 700.0)


def mel_to_hertz(m: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)


def hertz_to_erb(f: Column) -> Column:
    return 21.4 * F.log10(1.0 + 0.00437 * f)


def erb_to_hertz(e: Column) -> Column:
    return (F.pow(F.lit(10.0), e / 21.4) - 1.0) / 0.00437
