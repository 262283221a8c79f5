"""Operators on spectra(track, channel, stft_frame, re, im) and bands: scales, transfer functions, phases.

Everything on a frame is a column expression over its bins; what is summed over frames
goes through partial sums keyed by bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import per_track, settle

#: Frequency scales, there and back, of whole arrays.
SCALES: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]] = {
    "log": (np.log, np.exp),
    "mel": (lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)),
    "erb": (lambda f: 21.4 * np.log10(1 + 0.00437 * f), lambda e: (10 ** (e / 21.4) - 1) / 0.00437),
}


def band_edges(scale: str, bands: int, low: float, high: float, rate: float, fft: int) -> list[tuple[int, int, float, float]]:
    """(first bin, last bin, weight of the first, of the last) of bands of equal width on the scale.

    A band covers the bins from the one at or under its lower border to the one at or over its
    upper; these two count by how near they are to the border.
    """
    there, back = SCALES[scale]
    borders = back(np.linspace(there(np.float64(low)), there(np.float64(high)), bands + 1)) * fft / rate
    under, over = np.floor(borders[:-1]), np.ceil(borders[1:])
    weights = np.clip(1 - np.stack([borders[:-1] - np.maximum(under, 0), np.minimum(over, fft // 2) - borders[1:]]), 0, 1)
    first = np.maximum(under, 0).astype(int)
    last = np.maximum(np.minimum(over, fft // 2).astype(int), first)
    return list(zip(first.tolist(), last.tolist(), *weights.tolist()))


def to_bands(spectrogram: DataFrame, edges: Sequence[tuple[int, int, float, float]]) -> DataFrame:
    """Each band the weighted mean of its bins: the edge bins by their weights, those between by 1."""

    def mean(edge: tuple[int, int, float, float]) -> Column:
        first, last, w_first, w_last = edge
        weights = [w_first] if first == last else [w_first, *[1.0] * (last - first - 1), w_last]
        total = sum(weights)
        if total <= 0:
            return F.lit(0.0)
        inner = F.slice("bands", first + 1, last - first + 1)
        return F.aggregate(F.zip_with(inner, F.array(*[F.lit(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) / total

    return spectrogram.withColumn("bands", F.array(*[mean(e) for e in edges]))


def relative_power(magnitudes: Column) -> Column:
    """Each bin's share of the frame's power; equal shares of silence."""
    square = lambda x: x * x
    total = F.aggregate(F.transform(magnitudes, square), F.lit(0.0), lambda a, x: a + x)
    return F.transform(magnitudes, lambda x: F.when(total > 0, x * x / total).otherwise(1.0 / F.size(magnitudes)))


def schroeder_phase(magnitudes: Column, first: float = 0.0) -> Column:
    """The phase of low crest for a spectrum: a running sum over the bins below, each by how many bins are left above it."""
    n = F.size(magnitudes)
    step = F.transform(relative_power(magnitudes), lambda p, i: p * (n - i - 1))
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"))
    run = F.aggregate(step, start, lambda a, x: F.struct(F.concat(a["out"], F.array(first - 2 * math.pi * a["sum"])).alias("out"), (a["sum"] + x).alias("sum")), lambda a: a["out"])
    return run


def group_delay(phase: Column, amount: float = 1.0) -> Column:
    """Centred differences of a phase over bins from 0 to half the rate, one-sided at the ends, not under 0."""
    n = F.size(phase)
    width = math.pi / F.greatest(n - 1, F.lit(1))
    low, high = lambda i: F.greatest(i - 1, F.lit(0)), lambda i: F.least(i + 1, n - 1)
    slope = F.transform(phase, lambda _, i: -(F.get(phase, high(i)) - F.get(phase, low(i))) / ((high(i) - low(i)) * width))
    return F.when(n < 2, F.transform(phase, lambda _: F.lit(0.0))).otherwise(F.transform(slope, lambda x: max(0.0, min(1.0, amount)) * F.greatest(x, F.lit(0.0))))


def crest_score(samples: Column) -> Column:
    """0 to 1: how far a window's peak stands over its root mean square, from that of a sine to six times."""
    power = F.aggregate(F.transform(samples, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    crest = F.array_max(F.transform(samples, lambda x: F.abs(x))) / F.sqrt(power / F.size(samples))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (crest - math.sqrt(2)) / (6 - math.sqrt(2))))
    return F.when((F.size(samples) == 0) | (power <= 0), 0.0).otherwise(t * t * (3 - 2 * t))


def binds(frame_peak_db: Column, score: Column, global_peak_db: Column, is_global: Column | None = None) -> Column:
    """Whether a frame limits the whole: a crest score over 0.5, and within 3 dB of the global peak or its very frame."""
    near = frame_peak_db >= global_peak_db - 3
    return (score > 0.5) & (near if is_global is None else near | is_global)


def with_references(spectra: DataFrame, session: DataFrame) -> DataFrame:
    """(session, target, reference, stft_frame, re, im, ref_re, ref_im): each target's frames beside those of
    its references; a reference that is shorter goes on with zeros.

    session: (session, track, role), role target or reference; first channels are taken.
    """
    mono = spectra.filter("channel = 0").select("track", "stft_frame", "re", "im")
    role = lambda name, to: session.filter(F.col("role") == name).select("session", F.col("track").alias(to))
    wanted = role("target", "target").join(role("reference", "reference"), "session")
    ours = per_track(mono.withColumnRenamed("track", "target"), wanted, on=("target",), place="stft_frame")
    theirs = mono.select(F.col("track").alias("reference"), "stft_frame", F.col("re").alias("ref_re"), F.col("im").alias("ref_im"))
    zeros = F.transform("re", lambda _: F.lit(0.0))
    out = ours.join(theirs, ["reference", "stft_frame"], "left")
    return out.select("session", "target", "reference", "stft_frame", "re", "im", F.coalesce("ref_re", zeros).alias("ref_re"), F.coalesce("ref_im", zeros).alias("ref_im"))


def transfer(pairs: DataFrame) -> DataFrame:
    """(session, target, reference, bin, h_re, h_im): how a reference sounds in the target, from what
    with_references returns; frames count by the reference's share of the power."""
    key = ["session", "target", "reference"]
    power = F.zip_with("ref_re", "ref_im", lambda a, b: a * a + b * b)
    rows = settle(pairs)
    tops = rows.groupBy(*key).agg(F.max(F.array_max(power)).alias("top"))
    each = rows.select(*key, F.posexplode(F.arrays_zip("re", "im", "ref_re", "ref_im")).alias("bin", "x")).select(*key, "bin", "x.*")
    p_t, p_r = F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("ref_re") * F.col("ref_re") + F.col("ref_im") * F.col("ref_im")
    # a row for each pair of tracks: as many as the sessions' tables have
    each = each.join(F.broadcast(tops), key)
    w = p_r / (p_t + p_r + 1e-10 * (F.col("top") + 1e-20))
    cross_re, cross_im = F.col("re") * F.col("ref_re") + F.col("im") * F.col("ref_im"), F.col("im") * F.col("ref_re") - F.col("re") * F.col("ref_im")
    sums = each.groupBy(*key, "bin").agg(F.sum(w * cross_re).alias("x"), F.sum(w * cross_im).alias("y"), F.sum(w * p_r).alias("auto"))
    most = sums.groupBy(*key).agg((1e-10 * F.max("auto")).alias("least"))
    under = F.col("auto") + F.col("least")
    share = lambda c: F.when(under > 0, F.col(c) / under).otherwise(0.0)
    return sums.join(F.broadcast(most), key).select(*key, "bin", share("x").alias("h_re"), share("y").alias("h_im"))


def degenerate(transfers: DataFrame) -> DataFrame:
    """(session, target, reference, reason): why a transfer function can't be used, null if it can."""
    key = ["session", "target", "reference"]
    both = lambda test: test(F.col("h_re")) | test(F.col("h_im"))
    nan = both(F.isnan)
    odd = ~nan & both(lambda c: (F.abs(c) == float("inf")) | ((c != 0) & (F.abs(c) < 1.175494e-38)))
    size = F.when(~nan & ~odd, F.sqrt(F.col("h_re") * F.col("h_re") + F.col("h_im") * F.col("h_im")))
    rows = transfers.select(*key, nan.alias("nan"), odd.alias("odd"), size.alias("m"))
    tops = rows.groupBy(*key).agg(F.max("m").alias("top"))
    found = rows.join(F.broadcast(tops), key).groupBy(*key).agg(
        F.count_if("nan").alias("nans"), F.count_if("odd").alias("odds"), F.coalesce(F.max("top"), F.lit(0.0)).alias("top"), F.count_if(F.col("m") < 1e-4 * F.col("top")).alias("silent"), F.count(F.lit(1)).alias("bins")
    )
    reason = F.when(F.col("nans") > 0, "not a number").when(F.col("odds") > 0, "infinite or denormal").when(F.col("top") == 0, "all zero").when(F.col("silent") >= 0.8 * F.col("bins"), "mostly silent")
    return found.select(*key, reason.alias("reason"))


def mirrored(samples: Column, left: int, right: int) -> Column:
    """An array with its ends repeated outwards in mirror image."""
    head, tail = F.reverse(F.slice(samples, 1, left)), F.reverse(F.slice(samples, F.greatest(F.lit(1), F.size(samples) - right + 1), right))
    return F.concat(head, samples, tail) if left and right else F.concat(head, samples) if left else F.concat(samples, tail) if right else samples
