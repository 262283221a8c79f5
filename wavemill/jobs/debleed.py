"""Bleed removal: what a microphone hears of the other microphones' speakers is taken out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bleed, blocks, design, spectra
from ..operators.lineage import per_track, settle

#: Seconds from the beginning that the first gains are learned from; threshold of the mask's smoothing for each unit (fixed values).
WARM_UP, THRESHOLD = 30.0, 0.15


def seeds(rows: DataFrame, session: DataFrame, most_frames: int) -> DataFrame:
    """(session, target, reference, bin, h_re, h_im): first gains from the first frames; none where they can't be used."""
    found = settle(spectra.transfer(spectra.with_references(rows.filter(F.col("stft_frame") < most_frames), session)))
    good = spectra.degenerate(found).filter("reason is null").select("session", "target", "reference")
    return found.join(good, ["session", "target", "reference"])


def masks(rows: DataFrame, session: DataFrame, rate: float, fft: int, hop: int, strength: float = 5.0, smoothing: float = 5.0, speed: float = 3.0, warm_up: float = WARM_UP) -> DataFrame:
    """(session, target, stft_frame, mask, smooth, final): for each target's frame and bin, what share stays."""
    beside = settle(bleed.frames(rows, session))
    first = seeds(rows, session, max(1, int((warm_up * rate - fft) // hop) + 1))
    active = settle(bleed.activity(beside))
    pause = max(1, design.frames_of(500.0, rate / hop))
    heard = bleed.adaptive_bleed(beside, active, first, design.forgetting(speed), 0.5, hop / fft, pause)
    raw = settle(bleed.wiener_masks(heard, design.suppression(strength)))
    smooth = settle(bleed.smooth_nlm(raw, THRESHOLD * smoothing))
    return bleed.smooth_dftt(smooth, THRESHOLD * smoothing)


def remove(df: DataFrame, session: DataFrame, rate: float, fft: int = 4096, hop: int = 1024, strength: float = 5.0, smoothing: float = 5.0, speed: float = 3.0) -> DataFrame:
    """The blocks of the sessions' targets, first channels, without the bleed of their references.

    Blocks are of one size, a multiple of hop and no shorter than fft. session: (session, track,
    role); a track is a target once at most. Tracks that are no target, or have no
    reference, aren't in the result; a reference that ends early is silent from then on.
    strength and smoothing: 0 (nothing is taken out, masks stay as they are) to 10; speed: how
    fast the filters follow, 0 to 10.
    """
    size = df.agg(F.max(F.size("samples"))).first()[0]
    if not size:
        return df.limit(0)
    used = df.filter("channel = 0").join(F.broadcast(session.select("track").distinct()), "track", "left_semi") if session.count() <= 1_000_000 else df.filter("channel = 0").join(session, "track", "left_semi")
    used = used.select(*blocks.KEY, "offset", F.col("samples").cast("array<double>").alias("samples"))
    ends = settle(used.groupBy("track").agg(F.max(F.col("offset") + F.size("samples")).alias("_n")))
    # a block of silence on both sides, so that every frame of the recording is under whole windows
    silence = F.array_repeat(F.lit(0.0), size)
    moved = used.withColumn("block_idx", F.col("block_idx") + 1).withColumn("offset", F.col("offset") + size)
    moved = moved.withColumn("samples", F.concat("samples", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("samples"))))
    last = F.floor((F.col("_n") + size - 1) / size)
    pads = ends.select("track", F.explode(F.array(F.lit(0).cast("long"), last.cast("long") + 1)).alias("block_idx")).withColumn("channel", F.lit(0))
    kinds = dict(moved.dtypes)
    pads = pads.select("track", F.col("channel").cast(kinds["channel"]).alias("channel"), F.col("block_idx").cast(kinds["block_idx"]).alias("block_idx"), (F.col("block_idx") * size).cast(kinds["offset"]).alias("offset"), silence.alias("samples"))
    rows = settle(blocks.stft(moved.unionByName(pads), fft, hop))
    found = masks(rows, session, rate, fft, hop, strength, smoothing, speed, WARM_UP + size / rate).select(F.col("target").alias("track"), "stft_frame", "final")
    gained = lambda c: F.zip_with(c, "final", lambda x, g: x * g)
    kept = rows.join(found, ["track", "stft_frame"]).select("track", "channel", "stft_frame", gained("re").alias("re"), gained("im").alias("im"))
    out = per_track(blocks.istft(kept, fft, hop, size), ends, place="block_idx").withColumn("offset", F.col("offset") - size).withColumn("block_idx", F.col("block_idx") - 1)
    out = out.withColumn("samples", F.slice("samples", F.lit(1), F.least(F.size("samples"), F.col("_n") - F.col("offset")).cast("int")))
    return out.filter((F.col("offset") >= 0) & (F.col("offset") < F.col("_n"))).select(*blocks.KEY, "offset", "samples")
