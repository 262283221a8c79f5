"""Interval operators: merging, cutting, splicing, gating, padding, hysteresis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import levels
from .lineage import per_track


def to_frames(regions: DataFrame, rate: float) -> DataFrame:
    """(track, start_s, end_s) in seconds to half-open frame ranges, each edge rounded once; empty ones go."""
    edge = lambda c: levels.round_half_up(F.col(c) * rate).cast("long")
    return regions.select("track", F.greatest(F.lit(0), edge("start_s")).alias("start_frame"), edge("end_s").alias("end_frame")).filter("end_frame > start_frame")


def merge(segments: DataFrame) -> DataFrame:
    """(track, start_frame, end_frame): overlapping or touching ones become one."""
    order = Window.partitionBy("track").orderBy("start_frame", "end_frame")
    reach = F.max("end_frame").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.withColumn("_new", F.coalesce(F.col("start_frame") > reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy("track", "_island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("_island")


def buckets(segments: DataFrame, size: int) -> DataFrame:
    """A row for each bucket of `size` frames that a segment touches, so that range joins are equi-joins."""
    return segments.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_frame") / size), F.floor((F.col("end_frame") - 1) / size))))


def cut(df: DataFrame, regions: DataFrame, rate: float, bucket: int = 4096) -> DataFrame:
    """Takes the frames of the regions out and closes the gaps.

    A frame's new index is its own less all frames cut before it; that number is a
    running sum over the merged regions, looked up by bucket, not over the frames.
    """
    merged = merge(to_frames(regions, rate))
    order = Window.partitionBy("track").orderBy("start_frame")
    merged = merged.withColumn("_before", F.sum(F.col("end_frame") - F.col("start_frame")).over(order) - (F.col("end_frame") - F.col("start_frame")))
    # stretches between regions, with what was cut before them; the last one is open
    nexts = F.lead("start_frame").over(order)
    kept = merged.select("track", F.col("end_frame").alias("a"), nexts.alias("b"), (F.col("_before") + F.col("end_frame") - F.col("start_frame")).alias("gone"))
    first = merged.groupBy("track").agg(F.min("start_frame").alias("b")).select("track", F.lit(0).cast("long").alias("a"), "b", F.lit(0).cast("long").alias("gone"))
    lengths = df.groupBy("track").agg((F.max("frame") + 1).alias("n"))
    stretches = first.unionByName(kept).join(lengths, "track").select("track", F.col("a").alias("start_frame"), F.least(F.coalesce("b", "n"), "n").alias("end_frame"), "gone").filter("end_frame > start_frame")
    touched = merged.select("track").distinct().withColumn("_cut", F.lit(True))
    marked = per_track(df, touched, "left")
    whole = marked.filter("_cut is null").select(df.columns)
    inside = marked.filter("_cut").withColumn("_bucket", F.floor(F.col("frame") / bucket))
    joined = inside.join(buckets(stretches, bucket), ["track", "_bucket"]).filter("frame >= start_frame and frame < end_frame")
    return whole.unionByName(joined.withColumn("frame", F.col("frame") - F.col("gone")).select(df.columns))


def splice(df: DataFrame, insert: DataFrame, at: int, channels: dict[int, int] | None = None, rate: float | None = None, insert_rate: float | None = None) -> DataFrame:
    """Frames from `at` on are those of insert (track, channel, frame, value), as far as it has any.

    channels: which channel of insert goes to which channel here; the others stay as they
    are. Rates that are given must be equal.
    """
    if rate != insert_rate and None not in (rate, insert_rate):
        raise ValueError(f"rates differ: {rate} and {insert_rate}")
    moved = insert.select("track", "channel", (F.col("frame") + at).alias("frame"), F.col("value").alias("_new"))
    if channels is not None:
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in channels.items()])
        found = F.explode(F.filter(pairs, lambda p: p["a"] == F.col("channel")))
        moved = moved.withColumn("_", found).select("track", F.col("_.b").alias("channel"), "frame", "_new")
    return df.join(moved, ["track", "channel", "frame"], "left").withColumn("value", F.coalesce("_new", "value")).select(df.columns)


def gate(df: DataFrame, segments: DataFrame, floor: float, attack: int, release: int, bucket: int = 64) -> DataFrame:
    """Multiplies by the largest gain over segments: 1 inside, raised-cosine fades beside, the floor elsewhere.

    The attack leaves out its first frame, the release takes in its last. The segments near
    `bucket` frames meet them as one array, so a frame stays one row.
    """
    # fades touch frames outside; the range is widened for the buckets and tested exactly below
    wide = buckets(segments.select("track", (F.col("start_frame") - attack).alias("start_frame"), (F.col("end_frame") + release + 1).alias("end_frame"), F.col("start_frame").alias("s"), F.col("end_frame").alias("e")), bucket)
    near = wide.groupBy("track", "_bucket").agg(F.collect_list(F.struct("s", "e")).alias("_near"))
    f = F.col("frame")
    fade = lambda p: floor + (1 - floor) * levels.raised_cosine(p)

    def gain(x: Column) -> Column:
        g = F.when((f >= x["s"]) & (f < x["e"]), 1.0)
        if attack:
            g = g.when((f > x["s"] - attack) & (f < x["s"]), fade((f - (x["s"] - attack)) / attack))
        if release:
            g = g.when((f >= x["e"]) & (f <= x["e"] + release), fade(1 - (f - x["e"]) / release))
        return g.otherwise(float(floor))

    joined = df.withColumn("_bucket", F.floor(f / bucket)).join(near, ["track", "_bucket"], "left")
    return joined.withColumn("value", F.col("value") * F.coalesce(F.array_max(F.transform("_near", gain)), F.lit(float(floor)))).select(df.columns)


def pad_segments(segments: DataFrame, pad: int, lengths: DataFrame) -> DataFrame:
    """Widens each by `pad` on both sides; a gap of less than twice that is shared half and half.

    lengths: (track, n), which the last end doesn't pass.
    """
    order = Window.partitionBy("track").orderBy("start_frame")
    ahead, behind = F.lead("start_frame").over(order) - F.col("end_frame"), F.col("start_frame") - F.lag("end_frame").over(order)
    near = lambda gap: gap < 2 * pad
    start = F.when(behind.isNull(), F.greatest(F.lit(0), F.col("start_frame") - pad)).when(near(behind), F.col("start_frame") - F.floor(behind / 2)).otherwise(F.col("start_frame") - pad)
    end = F.when(ahead.isNull(), F.col("end_frame") + pad).when(near(ahead), F.col("end_frame") + F.floor(ahead / 2)).otherwise(F.col("end_frame") + pad)
    out = segments.select("track", F.greatest(F.lit(0), start).cast("long").alias("start_frame"), end.cast("long").alias("end_frame"))
    return out.join(lengths, "track").select("track", "start_frame", F.least("end_frame", "n").alias("end_frame"))


def resample_segments(segments: DataFrame, old: float, new: float, lengths: DataFrame) -> DataFrame:
    """Segments at another rate, clamped to (track, n); empty ones go."""
    edge = lambda c: F.least(F.col("n"), F.greatest(F.lit(0), levels.round_half_up(F.col(c) * new / old))).cast("long")
    out = segments.join(lengths, "track").select("track", edge("start_frame").alias("start_frame"), edge("end_frame").alias("end_frame"))
    return out.filter("end_frame > start_frame")


def hysteresis(scores: DataFrame, threshold: float, window: int, min_silence: int, min_speech: int, slack: float = 0.15) -> DataFrame:
    """Segments (track, start_frame, end_frame) from scores (track, w, p), windows of `window` frames.

    Opens at p >= threshold; silence starts where p < threshold - slack (0.01 at least)
    and ends at p >= threshold; the segment closes once silence has lasted min_silence
    frames, and counts if longer than min_speech. Scores and threshold share any scale.
    """
    if threshold < 0.01:
        raise ValueError("the threshold is under 0.01")
    low, order = max(threshold - slack, 0.01), Window.partitionBy("track").orderBy("w")
    s = scores.select("track", "w", (F.col("w") * window).alias("pos"), (F.col("p") >= threshold).cast("int").alias("on"), (F.col("p") < low).alias("off"))
    s = s.withColumn("ep", F.sum("on").over(order))
    ends = s.groupBy("track").agg(((F.max("w") + 1) * window).alias("total"))
    q = s.filter("ep > 0").withColumn("sil", F.min(F.when(F.col("off"), F.col("pos"))).over(order.partitionBy("track", "ep")))
    closed = (F.col("off") & (F.col("pos") - F.col("sil") >= min_silence)).cast("int")
    r = q.groupBy("track", "ep").agg(F.min("pos").alias("on_pos"), F.min("sil").alias("sil"), F.max(closed).alias("closed"))
    before = Window.partitionBy("track").orderBy("ep").rowsBetween(Window.unboundedPreceding, -1)
    g = r.withColumn("seg", F.coalesce(F.sum("closed").over(before), F.lit(0)))
    g = g.groupBy("track", "seg").agg(F.min("on_pos").alias("start_frame"), F.max(F.when(F.col("closed") == 1, F.col("sil"))).alias("e"))
    out = g.join(ends, "track").select("track", "start_frame", F.coalesce("e", "total").alias("end_frame"))
    return out.filter(F.col("end_frame") - F.col("start_frame") > min_speech)
