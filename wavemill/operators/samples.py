"""Operators on samples(track, channel, frame, value): one row for each sample.

Shuffles move whole tracks only where frames must meet: channel sums and running
sums. Everything that is one number for a track is aggregated first and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels
from . import blocks
from .lineage import per_track

TRACK = ("track",)
SIGNAL = ("track", "channel")


def gain(df: DataFrame, db: float) -> DataFrame:
    factor = 10 ** (db / 20)
    return df if factor == 1 else df.withColumn("value", F.col("value") * factor)


def track_gain(df: DataFrame, gains: DataFrame) -> DataFrame:
    """gains: (track, factor), a row for each track at most; tracks without one stay as they are.

    The gains are broadcast if they are few, else a track is dealt to several tasks.
    """
    return per_track(df, gains, "left").withColumn("value", F.col("value") * F.coalesce("factor", F.lit(1.0))).select(df.columns)


def invert(df: DataFrame) -> DataFrame:
    return df.withColumn("value", -F.col("value"))


def pan(df: DataFrame, position: float) -> DataFrame:
    """Mono to stereo at equal power, position -1 (left) to 1; more channels are an error."""
    angle = (position + 1) / 2 * math.pi / 2
    sides = F.array(F.struct(F.lit(0).alias("channel"), F.lit(math.cos(angle)).alias("k")), F.struct(F.lit(1).alias("channel"), F.lit(math.sin(angle)).alias("k")))
    mono = df.withColumn("channel", F.when(F.col("channel") != 0, F.raise_error(F.lit("pan takes one channel"))).otherwise(F.col("channel")))
    return mono.filter("channel = 0").select("track", "frame", "value", F.explode(sides).alias("s")).select("track", "s.channel", "frame", (F.col("value") * F.col("s.k")).alias("value"))


def balance(df: DataFrame, position: float) -> DataFrame:
    left, right = min(1.0, 1 - position), min(1.0, 1 + position)
    factor = F.when(F.col("channel") == 0, left).when(F.col("channel") == 1, right).otherwise(F.raise_error(F.lit("balance takes two channels")).cast("double"))
    return df.withColumn("value", F.col("value") * factor)


def duplicate_channels(df: DataFrame, channels: int) -> DataFrame:
    """The first channel in all of `channels` (1 to 8)."""
    if not 1 <= channels <= 8:
        raise ValueError("1 to 8 channels")
    return df.filter("channel = 0").withColumn("channel", F.explode(F.array(*[F.lit(c) for c in range(channels)])))


def select_channels(df: DataFrame, channels: Sequence[int]) -> DataFrame:
    """Output channel i has input channel channels[i]; a missing one is silent."""
    wanted = F.array(*[F.struct(F.lit(i).alias("out"), F.lit(c).alias("src")) for i, c in enumerate(channels)])
    present = df.select("track", "channel", "frame", "value").withColumn("w", F.explode(F.filter(wanted, lambda w: w["src"] == F.col("channel"))))
    found = present.select("track", F.col("w.out").alias("channel"), "frame", "value")
    has = df.groupBy("track").agg(F.collect_set("channel").alias("has"))
    lacking = has.select("track", F.array_min("has").alias("channel"), F.filter(wanted, lambda w: ~F.array_contains("has", w["src"])).alias("w"))
    # the frames of a channel that is there, silenced
    frames = per_track(df.select("track", "channel", "frame"), lacking.filter(F.size("w") > 0), on=("track", "channel"))
    silent = frames.select("track", F.explode("w").alias("w"), "frame").select("track", F.col("w.out").alias("channel"), "frame", F.lit(0.0).alias("value"))
    return found.unionByName(silent)


def replace_channel(df: DataFrame, channel: int, other: DataFrame) -> DataFrame:
    """other: (track, frame, value); frames that it lacks are silent."""
    new = df.filter(F.col("channel") == channel).drop("value").join(other.select("track", "frame", "value"), ["track", "frame"], "left")
    return df.filter(F.col("channel") != channel).unionByName(new.withColumn("value", F.coalesce("value", F.lit(0.0))).select(df.columns))


def reverse(df: DataFrame) -> DataFrame:
    ends = df.groupBy("track").agg(F.max("frame").alias("_last"))
    return per_track(df, ends).withColumn("frame", F.col("_last") - F.col("frame")).select(df.columns)


def pad(df: DataFrame, rate: float, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """Silence of so many seconds in front and behind; a track without frames stays empty."""
    front, behind = int(before * rate + 0.5), int(after * rate + 0.5)
    last = df.groupBy(*SIGNAL).agg(F.max("frame").alias("last"))
    zero = F.lit(0).cast("long")
    made = [last.select(*SIGNAL, F.explode(F.sequence(zero, F.lit(front - 1).cast("long"))).alias("frame"))] if front else []
    if behind:
        made.append(last.select(*SIGNAL, F.explode(F.sequence(F.col("last") + front + 1, F.col("last") + front + behind)).alias("frame")))
    out = df.withColumn("frame", F.col("frame") + front)
    for silence in made:
        out = out.unionByName(silence.withColumn("value", F.lit(0.0)))
    return out


def trim(df: DataFrame, threshold: float = 0.0, margin: int = 0, start: bool = True, end: bool = True) -> DataFrame:
    """Keeps from the first to the last frame in which a channel is over the threshold, with a margin."""
    loud = F.when(F.abs("value") > threshold, F.col("frame"))
    ends = df.groupBy("track").agg(F.min(loud).alias("_a"), F.max(loud).alias("_b"), F.max("frame").alias("_n")).filter("_a is not null")
    first = F.greatest(F.lit(0), F.col("_a") - margin) if start else F.lit(0).cast("long")
    last = F.least(F.col("_n"), F.col("_b") + margin) if end else F.col("_n")
    kept = per_track(df, ends).filter(F.col("frame").between(first, last))
    return kept.withColumn("frame", F.col("frame") - first).select(df.columns)


def dither(df: DataFrame, bits: int, seed: int = 1) -> DataFrame:
    """Triangular noise of one step, then rounding to 2^(bits-1) levels; the same row gets the same noise."""
    uniform = lambda salt: F.shiftrightunsigned(F.xxhash64("track", "channel", "frame", F.lit(seed), F.lit(salt)), 11) / float(1 << 53)
    return df.withColumn("value", levels.quantize_level(F.col("value") + (uniform(0) - uniform(1)) / float(1 << (bits - 1)), bits))


def shape_noise(df: DataFrame, bits: int, size: int = blocks.BLOCK) -> DataFrame:
    """First-order error feedback: the difference of the rounded running sums; in blocks of `size`."""
    return blocks.to_samples(blocks.shape_noise(blocks.from_samples(df, size), bits))


def downmix(df: DataFrame) -> DataFrame:
    return df.groupBy("track", "frame").agg((F.sum("value") / F.count(F.lit(1))).alias("value")).select("track", F.lit(0).alias("channel"), "frame", "value")


def peak(df: DataFrame) -> DataFrame:
    """(track, peak): the largest finite magnitude, 0 without any."""
    size = F.abs("value")
    return df.groupBy("track").agg(F.coalesce(F.max(F.when(size < float("inf"), size)), F.lit(0.0)).alias("peak"))


def normalize(df: DataFrame, ceiling: float = 1.0) -> DataFrame:
    factors = peak(df).select("track", F.when(F.col("peak") > 0, ceiling / F.col("peak")).otherwise(1.0).alias("factor"))
    return track_gain(df, factors)


def waveform(df: DataFrame, frames_per_point: int) -> DataFrame:
    """(track, channel, point, min, max); a point's minimum starts at 1 and its maximum at -1."""
    point = F.floor(F.col("frame") / max(1, frames_per_point)).cast("long")
    return df.groupBy(*SIGNAL, point.alias("point")).agg(F.least(F.lit(1.0), F.min("value")).alias("min"), F.greatest(F.lit(-1.0), F.max("value")).alias("max"))


def histogram(df: DataFrame, buckets: int = 1024) -> DataFrame:
    """(track, bucket, n, bucket_max): magnitudes in equal steps up to the peak, all channels together."""
    size = F.abs("value")
    tops = peak(df)
    bucket = F.when(F.col("peak") > 0, F.least(F.lit(buckets - 1), F.floor(size * buckets / F.col("peak")))).otherwise(0).cast("int")
    return per_track(df, tops).groupBy("track", bucket.alias("bucket"), F.col("peak").alias("bucket_max")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentile(hist: DataFrame, percent: float, buckets: int = 1024) -> DataFrame:
    """(track, level): by linear interpolation inside the bucket where the running count gets there; 0 for silence."""
    order = Window.partitionBy("track").orderBy("bucket")
    whole = Window.partitionBy("track")
    run = hist.withColumn("cum", F.sum("n").over(order)).withColumn("goal", F.sum("n").over(whole) * (percent / 100))
    at = run.filter(F.col("cum") >= F.col("goal")).groupBy("track").agg(F.min(F.struct("bucket", "cum", "goal", "n", "bucket_max")).alias("b"))
    width = F.col("b.bucket_max") / buckets
    return at.select("track", (width * (F.col("b.bucket") + (F.col("b.goal") - (F.col("b.cum") - F.col("b.n"))) / F.col("b.n"))).alias("level"))


def statistics(df: DataFrame) -> DataFrame:
    """(track, mean, std) over all channels; a deviation of 0 counts as 1."""
    out = df.groupBy("track").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def loudest(df: DataFrame) -> DataFrame:
    """(track, channel, frame, magnitude) of the first largest magnitude of each channel."""
    best = df.groupBy(*SIGNAL).agg(F.max(F.struct(F.abs("value").alias("m"), (-F.col("frame")).alias("f"))).alias("b"))
    return best.select(*SIGNAL, (-F.col("b.f")).alias("frame"), F.col("b.m").alias("magnitude"))


def checks(df: DataFrame, rate: float, expected_seconds: float | None = None) -> DataFrame:
    """One row for each track: silent, not_finite, clipped, zeros, too_short."""
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = df.groupBy("track").agg(
        (F.sqrt(F.avg(F.when(~bad, F.col("value") * F.col("value")))) < 1e-6).alias("silent"),
        F.max(bad).alias("not_finite"),
        (share(F.abs("value") >= 1) > 0.1).alias("clipped"),
        (share(F.col("value") == 0) > 0.9).alias("zeros"),
        ((F.max("frame") + 1) / rate).alias("seconds"),
    )
    return out if expected_seconds is None else out.withColumn("off_length", F.abs(F.col("seconds") - expected_seconds) > 0.01 * expected_seconds)


def moving_average(df: DataFrame, window: int, size: int = blocks.BLOCK) -> DataFrame:
    """Of those frames around each that there are; in blocks of `size`, at least window // 2."""
    return blocks.to_samples(blocks.moving_average(blocks.from_samples(df, size), window))


def sliding_max(df: DataFrame, half: int, size: int = blocks.BLOCK) -> DataFrame:
    return blocks.to_samples(blocks.sliding_extreme(blocks.from_samples(df, size), half))


def channel_sum(df: DataFrame) -> DataFrame:
    """Channel 0 is the sum of all."""
    return df.groupBy("track", "frame").agg(F.sum("value").alias("value")).select("track", F.lit(0).alias("channel"), "frame", "value")


def windows(df: DataFrame, size: int, hop: int, padded: bool = False) -> DataFrame:
    """(track, channel, window, i, value): each window of `size` frames every `hop`; the last ones are short or padded with zeros."""
    if padded:
        ends = df.groupBy(*SIGNAL).agg((F.max("frame") + 1).alias("n"))
        # behind the last frame only what its windows lack: less than one window for each channel
        stop = F.floor((F.col("n") - 1) / hop) * hop + size
        tail = ends.filter(stop > F.col("n")).select(*SIGNAL, F.explode(F.sequence(F.col("n"), (stop - 1).cast("long"))).alias("frame"), F.lit(0.0).alias("value"), "n")
        out = windows(df.select(*SIGNAL, "frame", "value").unionByName(tail.drop("n")), size, hop)
        last = ends.select(*SIGNAL, F.floor((F.col("n") - 1) / hop).alias("_last"))
        return per_track(out, last, on=SIGNAL, place="window").filter("window <= _last").drop("_last")
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - size) / hop) + 1)
    out = df.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col("frame") / hop).cast("long"))))
    return out.select(*SIGNAL, "window", (F.col("frame") - F.col("window") * hop).alias("i"), "value")


def transients(energies: DataFrame) -> DataFrame:
    """Adds transient to (track, channel, window, energy): over twice the energy before, which isn't 0."""
    before = F.lag("energy").over(Window.partitionBy(*SIGNAL).orderBy("window"))
    return energies.withColumn("transient", F.coalesce((before > 0) & (F.col("energy") > 2 * before), F.lit(False)))


def hold(amounts: DataFrame, half: int) -> DataFrame:
    """(track, channel, window, amount): the largest amount within `half` windows; each row is spread, so a hop of h costs 2h+1 rows."""
    last = amounts.groupBy(*SIGNAL).agg(F.max("window").alias("_last"))
    spread = amounts.join(last, list(SIGNAL)).select(*SIGNAL, F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("window") - half), F.least("_last", F.col("window") + half))).alias("window"), "amount")
    return spread.groupBy(*SIGNAL, "window").agg(F.max("amount").alias("amount"))

