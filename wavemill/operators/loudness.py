"""Loudness from power: overlapping gates, two-stage gating, loudness range.

Frames are summed to steps before they are spread over the gates that overlap
them, wherever the gate is a whole number of steps; so the spread is over sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels
from .lineage import per_track

ABSOLUTE, RELATIVE, RANGE_RELATIVE = -70.0, -10.0, -20.0


def power(df: DataFrame) -> DataFrame:
    """(track, frame, power): squares summed over the channels, all of weight 1."""
    return df.groupBy("track", "frame").agg(F.sum(F.col("value") * F.col("value")).alias("power"))


def gates(powers: DataFrame, size: int, step: int) -> DataFrame:
    """(track, gate, power): the mean over frames [gate * step, gate * step + size); full gates only."""
    lengths = powers.groupBy("track").agg((F.max("frame") + 1).alias("n"))
    if size % step == 0:
        rows = powers.groupBy("track", F.floor(F.col("frame") / step).alias("s")).agg(F.sum("power").alias("power"))
        first, last = F.col("s") - size // step + 1, F.col("s")
    else:
        rows = powers
        first, last = F.floor((F.col("frame") - size) / step) + 1, F.floor(F.col("frame") / step)
    spread = rows.withColumn("gate", F.explode(F.sequence(F.greatest(F.lit(0), first).cast("long"), last.cast("long"))))
    summed = spread.groupBy("track", "gate").agg((F.sum("power") / size).alias("power"))
    return summed.join(lengths, "track").filter(F.col("gate") * step + size <= F.col("n")).drop("n")


def gated_mean(found: DataFrame) -> DataFrame:
    """(track, power) of gates over -70 LUFS and over the mean of those less 10 LU, both strictly; null if none."""
    over = F.when(F.col("power") > levels.lufs_to_power(ABSOLUTE), F.col("power"))
    means = found.groupBy("track").agg((F.avg(over) * 10 ** (RELATIVE / 10)).alias("_least"))
    both = F.when(F.col("power") > F.col("_least"), over)
    return found.join(means, "track").groupBy("track").agg(F.avg(both).alias("power"))


def gated_loudness(found: DataFrame, tracks: DataFrame) -> DataFrame:
    """(track, lufs) from 400 ms gates; silence, or no gate, is minus infinity."""
    lufs = levels.power_to_lufs(F.coalesce("power", F.lit(0.0)))
    return tracks.select("track").distinct().join(gated_mean(found), "track", "left").select("track", lufs.alias("lufs"))


def series(found: DataFrame) -> DataFrame:
    """(track, gate, lufs) of gates, not under a power of 1e-10."""
    return found.select("track", "gate", levels.power_to_lufs(F.col("power"), 1e-10).alias("lufs"))


def integrated(powers: DataFrame, rate: float) -> DataFrame:
    """(track, lufs): gates of 400 ms every 100 ms; silence is minus infinity."""
    return gated_loudness(gates(powers, int(0.4 * rate + 0.5), int(0.1 * rate + 0.5)), powers)


def momentary(powers: DataFrame, rate: float) -> DataFrame:
    """(track, gate, lufs): 400 ms every 100 ms, not under a power of 1e-10."""
    return series(gates(powers, int(0.4 * rate + 0.5), int(0.1 * rate + 0.5)))


def short_term(powers: DataFrame, rate: float) -> DataFrame:
    """(track, gate, lufs): 3 s every 100 ms, not under a power of 1e-10."""
    return series(gates(powers, int(3 * rate + 0.5), int(0.1 * rate + 0.5)))


def full_gates(sums: DataFrame, span: int, seconds: float, every: float, lengths: DataFrame, tail: float = 0.0) -> DataFrame:
    """(track, gate, power): the means of blocks.gated_sums' full gates of one span.

    lengths: (track, n, rate). tail: seconds of silence after the end, which make more
    gates full; those that hold nothing but silence are made here.
    """
    frames = lambda s: F.floor(F.lit(s) * F.col("rate") + 0.5)
    count = F.floor((F.col("n") + frames(tail) - frames(seconds)) / frames(every)) + 1
    due = lengths.filter(count > 0).select("track", frames(seconds).alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))).alias("gate"))
    found = sums.filter(F.col("span") == span).select("track", "gate", "power")
    return due.join(found, ["track", "gate"], "left").select("track", "gate", (F.coalesce("power", F.lit(0.0)) / F.col("size")).alias("power"))


def whole_gates(sums: DataFrame, span: int, seconds: float, every: float, lengths: DataFrame) -> DataFrame:
    """The same without a tail, but for gates that no block touches: nothing but silence, which no gated mean counts."""
    size, step = (F.floor(F.lit(s) * F.col("rate") + 0.5) for s in (seconds, every))
    found = per_track(sums.filter(F.col("span") == span).select("track", "gate", "power"), lengths, place="gate")
    return found.filter(F.col("gate") * step + size <= F.col("n")).select("track", "gate", (F.col("power") / size).alias("power"))


def _considered(series: DataFrame) -> DataFrame:
    over = series.filter(F.col("lufs") >= ABSOLUTE)
    least = over.groupBy("track").agg((10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("lufs") / 10))) + RANGE_RELATIVE).alias("_least"))
    return over.join(least, "track").filter(F.col("lufs") >= F.col("_least")).drop("_least")


def loudness_range(series: DataFrame, low: float = 0.1, high: float = 0.95) -> DataFrame:
    """(track, lra) of a short-term series: the distance of two nearest-rank percentiles; fewer than two gates: 0."""
    ranked = _considered(series).withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy("lufs")) - 1)
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("track")))
    at = lambda p: F.max(F.when(F.col("k") == levels.round_half_up((F.col("n") - 1) * p), F.col("lufs")))
    found = ranked.groupBy("track").agg((at(high) - at(low)).alias("lra"))
    return series.select("track").distinct().join(found, "track", "left").select("track", F.coalesce("lra", F.lit(0.0)).alias("lra"))


def gated_extent(series: DataFrame) -> DataFrame:
    """(track, low, median) of the gates that count for the range; plus infinity without any."""
    found = _considered(series).groupBy("track").agg(F.min("lufs").alias("low"), F.expr("percentile(lufs, 0.5)").alias("median"))
    top: Column = F.lit(math.inf)
    return series.select("track").distinct().join(found, "track", "left").select("track", F.coalesce("low", top).alias("low"), F.coalesce("median", top).alias("median"))


def with_tail(powers: DataFrame, rate: float, seconds: float = 1.5) -> DataFrame:
    """The powers and so many seconds of silence after each track's end."""
    n = int(seconds * rate + 0.5)
    ends = powers.groupBy("track").agg(F.max("frame").alias("last"))
    tail = ends.select("track", F.explode(F.sequence(F.col("last") + 1, F.col("last") + n)).alias("frame"), F.lit(0.0).alias("power"))
    return powers.unionByName(tail)
