"""Loudness target: a gain curve over the level of each track, found by attempts, that meets loudness and true peak.

All tracks go through each attempt together and those that are done leave the loop. What
the driver holds between attempts is nothing but the plan; a track is one row of some
numbers and its histogram, and its samples stay in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import blocks, design, loudness
from ..operators.lineage import per_track, settle, written
from . import reports

#: Boosts of the body in dB, the pivot where none can be measured, and how far a peak may pass its target (fixed values).
LOWEST, HIGHEST, PIVOT, HOLD = -30.0, 30.0, -40.0, 0.01
BUCKETS = 1024


def limit_level(hist: DataFrame, pivots: DataFrame, percentile: float, buckets: int = BUCKETS) -> DataFrame:
    """(track, limit_db): the highest bucket of (track, bucket, n, bucket_max) with over 1 - percentile of all
    values in it and above, not under the pivot's (track, pivot); infinity if none is."""
    width = F.col("bucket_max") / buckets
    from_top = Window.partitionBy("track").orderBy(F.col("bucket").desc())
    rows = per_track(hist, pivots, "left", place="bucket").withColumn("_above", F.sum("n").over(from_top)).withColumn("_all", F.sum("n").over(Window.partitionBy("track")))
    pivot = levels.db_to_linear(F.coalesce(F.when(F.abs("pivot") < float("inf"), F.col("pivot")), F.lit(PIVOT)))
    start = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(pivot / width)))
    # an empty bucket at the pivot counts as the first one above it that isn't, from which the sums are the same
    good = rows.filter((F.col("bucket_max") > 0) & (F.col("_above") >= F.col("_all") * (1 - percentile)))
    best = good.withColumn("_start", start).groupBy("track").agg(F.max("bucket").alias("bucket"), F.max("_start").alias("start"), F.max(width).alias("width"))
    found = best.filter("bucket >= start").select("track", levels.linear_to_db((F.col("bucket") + 0.5) * F.col("width")).alias("limit_db"))
    return hist.select("track").distinct().join(found, "track", "left").select("track", F.coalesce("limit_db", F.lit(float("inf"))).alias("limit_db"))


def best_attempt(attempts: DataFrame, target_lufs: float, target_tp: Column) -> DataFrame:
    """The best row for each track of (track, attempt, lufs, true_peak_db): legal ones (neither target passed)
    first, then those that hold the peak, then the smaller error of the peak, then of the loudness, then the earlier."""
    holds = F.col("true_peak_db") <= target_tp + HOLD
    legal = holds & (F.col("lufs") <= target_lufs)
    order = [(~legal).cast("int"), (~holds).cast("int"), F.when(holds, 0.0).otherwise(F.abs(F.col("true_peak_db") - target_tp)), F.abs(F.col("lufs") - target_lufs), F.col("attempt")]
    best = attempts.groupBy("track").agg(F.min_by(F.struct("*"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias("b"))
    return best.select("b.*")


def measure_source(df: DataFrame, rate: float, half: int, percentile: float = 0.995, sections: blocks.Sections | None = None, held: DataFrame | None = None) -> DataFrame:
    """One row for each track: lufs, lra, true_peak_db, pivot and floor (median and lowest of the gates that
    count for the range), limit_db, and the histogram (counts, bucket_max) of the detection levels.

    held: blocks.held_magnitudes of df, if they are there already."""
    held = settle(blocks.held_magnitudes(df, half)) if held is None else held
    sizes = settle(reports.lengths(df, rate))
    sums = reports.gate_sums(df, rate, None, sections)
    lufs = loudness.gated_loudness(loudness.full_gates(sums, 0, *reports.SPANS[0], sizes), sizes)
    series = settle(loudness.series(loudness.full_gates(sums, 1, *reports.SPANS[1], sizes, reports.TAIL)))
    plain = loudness.series(loudness.full_gates(sums, 1, *reports.SPANS[1], sizes))
    extent = loudness.gated_extent(plain)
    extent = settle(sizes.select("track").join(extent, "track", "left").select("track", F.coalesce("low", F.lit(float("inf"))).alias("floor"), F.coalesce("median", F.lit(float("inf"))).alias("pivot")))
    hist = settle(blocks.histogram(held, BUCKETS))
    limits = limit_level(hist, extent.select("track", "pivot"), percentile)
    shape = reports.amplitude(hist, BUCKETS).select("track", F.col("buckets").alias("counts"), F.col("peak").alias("bucket_max"))
    peaks = blocks.true_peak(df).select("track", levels.linear_to_db(F.col("true_peak")).alias("true_peak_db"))
    out = lufs.join(loudness.loudness_range(series), "track", "left").withColumn("lra", F.coalesce("lra", F.lit(0.0)))
    for part in (peaks, extent, limits, shape):
        out = out.join(part, "track")
    return out


def predicted(rows: pd.DataFrame, boost: np.ndarray, peak_gain: np.ndarray) -> np.ndarray:
    """The loudness of each track after its curve, from its histogram alone; minus infinity for silence.

    rows: lufs, counts, bucket_max, floor (null: none), pivot and limit_db of each track.
    """
    column = lambda c: rows[c].to_numpy(np.float64)[:, None]
    counts = np.stack([np.asarray(c, np.float64) for c in rows["counts"]])
    centre = (np.arange(counts.shape[1]) + 0.5) * column("bucket_max") / counts.shape[1]
    floor, pivot, limit = (column(c) for c in ("floor", "pivot", "limit_db"))
    body, top = boost[:, None], peak_gain[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        db = 20 * np.log10(centre)
        ramp = np.where(np.isnan(floor), body, np.where(db <= floor, 0.0, body * (db - floor) / (pivot - floor)))
        upper = np.where(db >= limit, top - (db - limit), body + (top - body) * (db - pivot) / (limit - pivot))
        energy = counts * centre * centre
        before, after = energy.sum(axis=1), (energy * 10 ** (np.where(db < pivot, ramp, upper) / 10)).sum(axis=1)
        out = rows["lufs"].to_numpy(np.float64) + 10 * np.log10(after / before)
    return np.where((after > 0) & np.isfinite(out), out, -np.inf)


def solve_boosts(rows: pd.DataFrame, goal: np.ndarray, tolerance: float, never_expand: bool) -> np.ndarray:
    """The boost of each track with which its predicted loudness comes nearest to its goal.

    More boost is more loudness, so all tracks halve their own interval at once, until it is a
    hundredth of the tolerance wide; a goal out of reach takes the interval to its end.
    """
    cap = rows["peak_cap"].to_numpy(np.float64)
    low, high = np.full(len(rows), LOWEST), np.full(len(rows), HIGHEST)
    for _ in range(int(np.ceil(np.log2((HIGHEST - LOWEST) / (tolerance / 100))))):
        middle = (low + high) / 2
        over = predicted(rows, middle, np.minimum(middle, cap) if never_expand else cap) > goal
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return np.where(high == HIGHEST, HIGHEST, np.where(low == LOWEST, LOWEST, (low + high) / 2))


def _next(parts: Iterator[pd.DataFrame], target: float, tolerance: float, never_expand: bool) -> Iterator[pd.DataFrame]:
    """Adds boost and peak_gain of the coming attempt to rows (track, measures, tried: boosts and their loudness)."""
    for rows in parts:
        if rows.empty:
            continue
        cap = rows["peak_cap"].to_numpy(np.float64)
        tried = [[(t["boost"], t["lufs"]) for t in mine] for mine in rows["tried"]]
        # what the last attempt came out louder than foreseen, the next one is foreseen to come out louder too
        last, got = (np.array([mine[-1][k] if mine else np.nan for mine in tried]) for k in (0, 1))
        missed = got - predicted(rows, last, np.minimum(last, cap) if never_expand else cap)
        boost = solve_boosts(rows, target - np.where(np.isfinite(missed), missed, 0.0), tolerance, never_expand)
        under = np.array([max((b for b, l in mine if l <= target), default=-np.inf) for mine in tried])
        over = np.array([min((b for b, l in mine if l > target), default=np.inf) for mine in tried])
        between = np.isfinite(under) & np.isfinite(over) & (under < over)
        boost = np.where(between, (np.where(between, under, 0) + np.where(between, over, 0)) / 2, boost)
        yield rows[["track"]].assign(boost=boost, peak_gain=np.minimum(boost, cap) if never_expand else cap)


def gain_blocks(levels_db: DataFrame, plan: DataFrame, half: int, smoothing_ms: float, rate: float) -> DataFrame:
    """Linear gains (channel 0) from detection levels and a plan (track, floor, pivot, limit_db, boost, peak_gain):
    the curve, its least within `half`, smoothed both ways but never above that least."""
    c = F.col
    above, upper = lambda x: c("peak_gain") - (x - c("limit_db")), lambda x: c("boost") + (c("peak_gain") - c("boost")) * (x - c("pivot")) / (c("limit_db") - c("pivot"))
    ramp = lambda x: F.when(c("floor").isNull(), c("boost")).otherwise(c("boost") * (x - c("floor")) / (c("pivot") - c("floor")))
    curve = lambda x: F.when(c("floor").isNotNull() & (x <= c("floor")), 0.0).when(x < c("pivot"), ramp(x)).when(x < c("limit_db"), upper(x)).otherwise(above(x))
    shaped = per_track(levels_db, plan, place="block_idx").withColumn("samples", F.transform("samples", lambda x: F.pow(F.lit(10.0), curve(x) / 20)))
    least = settle(blocks.sliding_extreme(shaped.select(*blocks.KEY, "offset", "samples"), half, largest=False))
    smooth = blocks.smooth(least, smoothing_ms, rate, both_ways=True).select(*blocks.KEY, F.col("samples").alias("smooth"))
    return least.join(smooth, blocks.KEY).select("track", "block_idx", F.zip_with("samples", "smooth", lambda a, b: F.least(a, b)).alias("gains"))


def loudness_target(df: DataFrame, rate: float, target_lufs: float = -16.0, target_tp: float | None = None, percentile: float = 0.995, smoothing_ms: float = 1.0, tolerance: float = 0.5, never_expand: bool = False, most_attempts: int = 10, limit_db: float | None = None, sections: blocks.Sections | None = None) -> tuple[DataFrame, DataFrame]:
    """The blocks at the target loudness, never louder, with the true peak held; and what was done
    (track, attempt, boost, lufs, true_peak_db, converged), one row for each track with a loudness.

    Tracks without one (silence, or shorter than a gate) stay as they are. `df` is read in
    each attempt: pass a table, or settle() what is costly to make.
    """
    half = design.frames_of(smoothing_ms, rate)
    held = written(blocks.held_magnitudes(df, half))
    found = measure_source(df, rate, half, percentile, sections, held)
    peak = F.col("true_peak_db") if target_tp is None else F.lit(float(target_tp))
    pivot = F.when(F.abs("pivot") < float("inf"), F.col("pivot")).otherwise(PIVOT)
    state = found.filter(F.abs("lufs") < float("inf")).withColumn("pivot", pivot).withColumn("peak_goal", peak)
    low = F.when(F.abs("floor") < float("inf"), F.least(F.col("floor"), F.col("pivot") - 0.01))
    limit = F.lit(float(limit_db)) if limit_db is not None else F.when(F.abs("limit_db") < float("inf"), F.col("limit_db")).otherwise(F.col("true_peak_db"))
    # between the pivot and the source's peak
    state = state.withColumn("floor", low).withColumn("limit_db", F.greatest(F.col("pivot") + 0.01, F.least(limit, F.col("true_peak_db"))))
    state = written(state.withColumn("peak_cap", F.col("peak_goal") - F.col("limit_db")))
    kind = dict(df.dtypes)["track"]
    detected = blocks.each(held, blocks.decibels)
    columns = ["track", "lufs", "counts", "bucket_max", "floor", "pivot", "limit_db", "peak_cap"]
    attempts = state.select("track", F.lit(0).alias("attempt"), F.lit(0.0).alias("boost"), F.lit(0.0).alias("peak_gain"), "lufs", "true_peak_db", "peak_goal").limit(0)
    left = state
    for attempt in range(1, most_attempts + 1):
        tried = attempts.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("attempt", "boost", F.col("lufs").alias("lufs")))).alias("tried"))
        rows = left.select(*columns).join(tried, "track", "left").withColumn("tried", F.coalesce("tried", F.array().cast("array<struct<attempt:int,boost:double,lufs:double>>")))
        plan = written(rows.mapInPandas(lambda it: _next(it, target_lufs, tolerance, never_expand), f"track {kind}, boost double, peak_gain double"))
        full = plan.join(left.select("track", "floor", "pivot", "limit_db"), "track")
        gains = written(gain_blocks(detected, full, half, smoothing_ms, rate))
        out = written(apply_blocks(df, gains))
        sizes = reports.lengths(out, rate)
        lufs = loudness.gated_loudness(loudness.full_gates(reports.gate_sums(out, rate, None, sections, reports.SPANS[:1]), 0, *reports.SPANS[0], sizes), sizes)
        peaks = blocks.true_peak(out).select("track", levels.linear_to_db(F.col("true_peak")).alias("true_peak_db"))
        made = plan.join(lufs, "track").join(peaks, "track").join(left.select("track", "peak_goal"), "track")
        attempts = written(attempts.unionByName(made.select("track", F.lit(attempt).alias("attempt"), "boost", "peak_gain", "lufs", "true_peak_db", "peak_goal")))
        best = best_attempt(attempts, target_lufs, F.col("peak_goal"))
        good = (F.col("lufs") <= target_lufs) & (F.col("true_peak_db") <= F.col("peak_goal") + HOLD) & (F.abs(F.col("lufs") - target_lufs) < tolerance)
        ends = attempts.filter((F.col("attempt") == attempt) & (((F.col("boost") == HIGHEST) & (F.col("lufs") < target_lufs)) | ((F.col("boost") == LOWEST) & (F.col("lufs") > target_lufs))))
        left = written(left.join(best.filter(good).select("track").union(ends.select("track")).distinct(), "track", "left_anti"))
        if not left.limit(1).count():
            break
    best = written(best_attempt(attempts, target_lufs, F.col("peak_goal")))
    chosen = best.join(state.select("track", "floor", "pivot", "limit_db"), "track").select("track", "floor", "pivot", "limit_db", "boost", "peak_gain")
    final = apply_blocks(df, written(gain_blocks(detected, chosen, half, smoothing_ms, rate)))
    return final, best.select("track", "attempt", "boost", "lufs", "true_peak_db", F.coalesce(good, F.lit(False)).alias("converged"))


def apply_blocks(df: DataFrame, gains: DataFrame) -> DataFrame:
    """Each block times the gains of its frames (track, block_idx, gains); blocks without stay as they are."""
    joined = df.join(gains, ["track", "block_idx"], "left")
    return joined.withColumn("samples", F.when(F.col("gains").isNull(), F.col("samples").cast("array<double>")).otherwise(F.zip_with("samples", "gains", lambda x, g: x * g))).select(df.columns)
