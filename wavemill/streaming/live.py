"""Live audio and telemetry on Structured Streaming; each function takes streams and tables alike.

Rows are (track, ts, value, …). Lateness is the caller's: a watermark of so long is
set on ts, and state is dropped behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import Filter

LATE = "1 hour"


def read(spark: SparkSession, folder: str, pattern: str, like: DataFrame) -> DataFrame:
    """A stream of the parquet files of a folder, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)


def waveform(df: DataFrame, every: str, late: str = LATE) -> DataFrame:
    """(track, start, min, max) for each stretch of time."""
    out = df.withWatermark("ts", late).groupBy("track", F.window("ts", every).alias("w")).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return out.select("track", F.col("w.start").alias("start"), "min", "max")


def gates(df: DataFrame, size: str, step: str, late: str = LATE) -> DataFrame:
    """(track, start, power, n) for overlapping stretches: the sum of squares."""
    out = df.withWatermark("ts", late).groupBy("track", F.window("ts", size, step).alias("w")).agg(F.sum(F.col("value") * F.col("value")).alias("power"), F.count(F.lit(1)).alias("n"))
    return out.select("track", F.col("w.start").alias("start"), "power", "n")


def activity(df: DataFrame, threshold: float, gap: str, late: str = LATE) -> DataFrame:
    """(track, start, n): runs of rows over the threshold with pauses under `gap`."""
    loud = df.filter(F.col("value") > threshold).withWatermark("ts", late)
    return loud.groupBy("track", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("track", F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """(track, start, last, n): stretches in which beats follow each other within `gap`; after `last`, a stream is stalled."""
    out = df.withWatermark("ts", late).groupBy("track", F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.select("track", F.col("w.start").alias("start"), "last", "n")


def fine_histogram(df: DataFrame, step: float) -> DataFrame:
    """(track, bucket, n) of magnitudes in fixed fine steps, which merge into any wider ones when read."""
    return df.groupBy("track", F.floor(F.abs("value") / step).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def last_finished(df: DataFrame, kind: str) -> DataFrame:
    """(track, finished_at, value): the last event of a kind for each track."""
    last = df.filter(F.col("kind") == kind).groupBy("track").agg(F.max(F.struct("ts", "event_id", "value")).alias("l"))
    return last.select("track", F.col("l.ts").alias("finished_at"), F.col("l.value").alias("value"))


def unrepeated(df: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Rows whose keys weren't there before; on a stream, within the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def throttle(df: DataFrame, seconds: float, least: float) -> DataFrame:
    """(track, ts, value): a row if the value has grown by `least` and `seconds` have passed since the last one.

    State: the last row let through. Rows of a batch are taken in the order of time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("ts")
        at, top = state.get if state.exists else (None, None)
        out = []
        for ts, value in zip(rows["ts"], rows["value"]):
            if at is None or (value - top >= least and ts.timestamp() - at >= seconds):
                at, top = ts.timestamp(), float(value)
                out.append((key[0], ts, top))
        if at is not None:
            state.update((at, top))
        yield pd.DataFrame(out, columns=["track", "ts", "value"])

    kinds = dict(df.dtypes)
    return df.groupBy("track").applyInPandasWithState(run, f"track {kinds['track']}, ts {kinds['ts']}, value double", "at double, top double", "append", GroupStateTimeout.NoTimeout)


def hysteresis(df: DataFrame, threshold: float, window: int, min_silence: int, min_speech: int, slack: float = 0.15) -> DataFrame:
    """(track, start_frame, end_frame) of segments as they close, from scores (track, w, p, last) in the order of w;
    what intervals.hysteresis says of the whole table.

    State: where the open segment began, where its silence began, the next window. A row
    with `last` ends its track: an open segment is closed there. Rows of a batch are taken
    in order; one that isn't next is an error.
    """
    low = max(threshold - slack, 0.01)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("w")
        begin, silent, after = state.get if state.exists else (-1, -1, 0)
        out = []
        for w, p, last in zip(rows["w"], rows["p"], rows["last"]):
            if w != after:
                raise ValueError(f"window {w} of {key}, expected {after}")
            at, after, stop = w * window, w + 1, -1
            if p >= threshold:
                begin, silent = at if begin < 0 else begin, -1
            elif p < low and begin >= 0:
                silent = at if silent < 0 else silent
                stop = silent if at - silent >= min_silence else -1
            if stop < 0 and last and begin >= 0:
                stop = after * window
            if stop >= 0:
                if stop - begin > min_speech:
                    out.append((*key, begin, stop))
                begin, silent = -1, -1
        state.update((int(begin), int(silent), int(after)))
        yield pd.DataFrame(out, columns=["track", "start_frame", "end_frame"])

    schema = f"track {dict(df.dtypes)['track']}, start_frame long, end_frame long"
    return df.groupBy("track").applyInPandasWithState(run, schema, "begin long, silent long, after long", "append", GroupStateTimeout.NoTimeout)


def closed_up(df: DataFrame) -> DataFrame:
    """Blocks (track, channel, offset, samples, kept) as they come, without the frames not kept: each offset less all
    frames left out before it. State: that number and the next offset; blocks of a batch are taken in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("offset")
        gone, after = state.get if state.exists else (0, 0)
        out = []
        for offset, samples, kept in zip(rows["offset"], rows["samples"], rows["kept"]):
            if offset != after:
                raise ValueError(f"block at {offset} of {key}, expected {after}")
            left = np.asarray(samples, np.float64)[np.asarray(kept, bool)]
            if len(left):
                out.append((*key, offset - gone, left))
            gone, after = gone + len(samples) - len(left), offset + len(samples)
        state.update((int(gone), int(after)))
        yield pd.DataFrame(out, columns=["track", "channel", "offset", "samples"])

    kinds = dict(df.dtypes)
    schema = f"track {kinds['track']}, channel {kinds['channel']}, offset long, samples array<double>"
    return df.groupBy("track", "channel").applyInPandasWithState(run, schema, "gone long, after long", "append", GroupStateTimeout.NoTimeout)


def lti_filter(df: DataFrame, sections) -> DataFrame:
    """Filters (track, channel, offset, samples) as they come; the state is the filter's few numbers and the
    next offset. Blocks of a batch are taken in order; one that isn't next is an error."""
    machine, order = Filter(sections), 2 * len(sections)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("offset")
        held, after = state.get if state.exists else ([0.0] * order, 0)
        out = []
        for offset, samples in zip(rows["offset"], rows["samples"]):
            if offset != after:
                raise ValueError(f"block at {offset} of {key}, expected {after}")
            y, held = machine.run(pd.Series(samples, dtype="float64").to_numpy(), pd.Series(held, dtype="float64").to_numpy())
            after = offset + len(samples)
            out.append((*key, offset, y.tolist()))
        state.update(([float(x) for x in held], int(after)))
        yield pd.DataFrame(out, columns=["track", "channel", "offset", "samples"])

    kinds = dict(df.dtypes)
    schema = f"track {kinds['track']}, channel {kinds['channel']}, offset long, samples array<double>"
    return df.groupBy("track", "channel").applyInPandasWithState(run, schema, "held array<double>, after long", "append", GroupStateTimeout.NoTimeout)
