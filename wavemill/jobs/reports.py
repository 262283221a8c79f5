"""Jobs over a corpus: the loudness report, its tables, and the two normalisations that follow from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels
from ..operators import blocks, design, loudness, samples
from ..operators.lineage import per_track, settle

#: Gates of the loudness standard, in seconds: momentary and short-term, and how often they begin.
SPANS = ((0.4, 0.1), (3.0, 0.1))
TAIL = 1.5

Apply = Callable[[DataFrame, DataFrame], DataFrame]


def lengths(df: DataFrame, rate: float | None) -> DataFrame:
    """(track, n, rate) of blocks; a rate of None is read from the column `rate`."""
    given = F.col("rate") if rate is None else F.lit(float(rate))
    return df.groupBy("track").agg(F.max(F.col("offset") + F.size("samples")).alias("n"), F.max(given).cast("double").alias("rate"))


def gate_sums(df: DataFrame, rate: float | None = None, weights: Sequence[float] | None = None, sections: blocks.Sections | None = None, spans: Sequence[tuple[float, float]] = SPANS, dealt: bool = False) -> DataFrame:
    """K-weighted sums of the spans' gates, see blocks.gated_sums; designed for each track's rate unless sections are given."""
    filters: blocks.Sections | Callable[[float], blocks.Sections] = sections or (design.k_weighting(rate) if rate else design.k_weighting)
    if rate and callable(filters):
        raise ValueError("sections by rate need the column")
    return settle(blocks.gated_sums(df, filters, spans, rate, weights, dealt))


def integrated_loudness(df: DataFrame, rate: float | None = None, weights: Sequence[float] | None = None, sections: blocks.Sections | None = None, dealt: bool = False) -> DataFrame:
    """(track, lufs) of blocks, from the momentary gates alone. dealt: see blocks.lti_map."""
    sizes = settle(lengths(df, rate))
    sums = gate_sums(df, rate, weights, sections, SPANS[:1], dealt)
    return loudness.gated_loudness(loudness.whole_gates(sums, 0, *SPANS[0], sizes), sizes)


def loudness_report(df: DataFrame, rate: float | None = None, buckets: int = 1024, weights: Sequence[float] | None = None, sections: blocks.Sections | None = None) -> DataFrame:
    """One row for each track: integrated loudness, range, true peak, and amplitude (buckets, bucket_max, total, median).

    rate: of all tracks, or None for the column `rate` of each. The blocks are read
    several times: pass a table, or settle() what is costly to make. What leaves a block
    is a row for each gate and each bucket that it touches, none for each sample.
    """
    sizes = settle(lengths(df, rate))
    sums = gate_sums(df, rate, weights, sections)
    lufs = loudness.gated_loudness(loudness.full_gates(sums, 0, *SPANS[0], sizes), sizes)
    lra = loudness.loudness_range(loudness.series(loudness.full_gates(sums, 1, *SPANS[1], sizes, TAIL)))
    hist = settle(blocks.histogram(df, buckets))
    median = samples.histogram_percentile(hist, 50, buckets).withColumnRenamed("level", "median")
    out = lufs.join(lra, "track", "left").join(blocks.true_peak(df), "track").join(amplitude(hist, buckets), "track", "left").join(median, "track", "left")
    return out.withColumn("lra", F.coalesce("lra", F.lit(0.0)))


def amplitude(hist: DataFrame, buckets: int) -> DataFrame:
    """(track, peak, buckets, total) from (track, bucket, n, bucket_max): the counts as an array of all buckets."""
    rows = hist.groupBy("track").agg(F.max("bucket_max").alias("peak"), F.collect_list(F.struct("bucket", "n")).alias("_m"), F.sum("n").alias("total"))
    source = rows.select("track", "peak", F.col("_m.bucket").alias("bucket"), F.col("_m.n").alias("n"), "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.parts(batches, 2):
            bucket, starts = batch.column(2).flatten().to_numpy(), blocks.flat(batch.column(2))[1]
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                here = slice(starts[at], starts[at + some.num_rows])
                counts = np.zeros((some.num_rows, buckets), np.int64)
                counts[np.repeat(np.arange(some.num_rows), np.diff(starts[at : at + some.num_rows + 1])), bucket[here]] = batch.column(3).flatten().to_numpy()[here]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * buckets), pa.array(counts.ravel())), some.column(4)], names=["track", "peak", "buckets", "total"])

    return source.mapInArrow(run, f"track {dict(hist.dtypes)['track']}, peak double, buckets array<bigint>, total bigint")


def write_report(report: DataFrame, path: str) -> None:
    """A JSON line for each track: integrated, truePeak, range and amplitude {buckets, bucketMax, totalSamples, median}."""
    shape = F.struct("buckets", F.col("peak").alias("bucketMax"), F.col("total").alias("totalSamples"), "median").alias("amplitude")
    report.select("track", F.col("lufs").alias("integrated"), F.col("true_peak").alias("truePeak"), F.col("lra").alias("range"), shape).write.mode("overwrite").json(path)


def write_waveform(points: DataFrame, path: str, rate: float, frames_per_point: int) -> None:
    """The table of samples.waveform, each row with the rate and points a second that a reader needs."""
    head = {"rate": F.lit(float(rate)), "resolution": F.lit(rate / frames_per_point)}
    points.withColumns(head).write.mode("overwrite").partitionBy("channel").parquet(path)


def write_spectrogram(frames: DataFrame, path: str, rate: float, fft: int, hop: int, scale: str = "linear", low: float = 0.0, high: float | None = None) -> None:
    """The table of blocks.spectrogram or spectra.to_bands as 32-bit floats, with what a header would say."""
    head = {"rate": rate, "fft": fft, "hop": hop, "scale": scale, "low": low, "high": rate / 2 if high is None else high}
    rows = frames.withColumn("bands", F.col("bands").cast("array<float>")).withColumns({k: F.lit(v) for k, v in head.items()})
    rows.write.mode("overwrite").partitionBy("channel").parquet(path)


def apply_gains(df: DataFrame, gains: DataFrame) -> DataFrame:
    """Blocks times a factor for each track (track, factor)."""
    out = per_track(df, gains, place="block_idx").withColumn("samples", F.transform("samples", lambda x: x * F.col("factor")))
    return out.select(df.columns)


def gained_samples(df: DataFrame, gains: DataFrame) -> DataFrame:
    """What apply_gains gives as samples(track, channel, frame, value); no array is made in between."""
    return blocks.to_samples(per_track(df, gains, place="block_idx"), "factor")


def loudness_normalize(df: DataFrame, rate: float | None = None, target: float = -23.0, weights: Sequence[float] | None = None, sections: blocks.Sections | None = None, dealt: bool = False, apply: Apply = apply_gains) -> DataFrame:
    """Every track at the target loudness, as blocks or, by gained_samples, as samples. dealt: see blocks.lti_map."""
    found = integrated_loudness(df, rate, weights, sections, dealt)
    return apply(df, found.select("track", levels.loudness_gain(F.col("lufs"), target).alias("factor")))


def true_peak_normalize(df: DataFrame, target_db: float = -1.0, apply: Apply = apply_gains) -> DataFrame:
    return apply(df, blocks.true_peak(df).select("track", levels.true_peak_gain(F.col("true_peak"), target_db).alias("factor")))
