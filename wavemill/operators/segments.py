"""Hooks for a user's models and aggregates over blocks: segments with context, weighted overlap-add, partial sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import design
from .blocks import KEY, arrays, flat, parts, with_halo
from .lineage import per_track, settle


def on_segments(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int, hop: int, power: float = 1.0) -> DataFrame:
    """Runs a model on segments of `size` samples every `hop` and adds its outputs up by triangular weights.

    A segment is cut off, padded with zeros, at the end. Blocks are a multiple of hop and no
    shorter than size - hop. A segment over the edge of two blocks is run for both of them, so
    only the edges' samples move, and no sums.
    """
    weights, kinds, before = np.array(design.triangle(size, power)), dict(df.dtypes), (size - 1) // hop * hop
    source = with_halo(df, before, size - 1).select(*KEY, "offset", "samples", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4):
            (x, own), (left, ahead), (right, behind) = (flat(batch.column(i)) for i in (4, 5, 6))
            done = np.empty(len(x))
            for i, offset in enumerate(batch.column(3).to_pylist()):
                a, n = ahead[i + 1] - ahead[i], own[i + 1] - own[i]
                if not n:
                    continue
                whole = np.concatenate([left[ahead[i] : ahead[i + 1]], x[own[i] : own[i + 1]], right[behind[i] : behind[i + 1]], np.zeros(size)])
                sums, weight = np.zeros(len(whole)), np.zeros(len(whole))
                for begin in range((a - offset) % hop, a + n, hop):
                    if begin + size > a:
                        sums[begin : begin + size] += weights * model(whole[begin : begin + size])
                        weight[begin : begin + size] += weights
                sums, weight = sums[a : a + n], weight[a : a + n]
                done[own[i] : own[i + 1]] = np.where(weight > 0, sums / np.where(weight > 0, weight, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), arrays(done, own)], names=[*KEY, "offset", "samples"])

    keys = ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "offset"))
    return source.mapInArrow(run, f"{keys}, samples array<double>")


def scores(df: DataFrame, model: Callable[[np.ndarray], float], fresh: int = 512, context: int = 64) -> DataFrame:
    """(track, channel, w, p): a model's score of each run of `fresh` samples with the `context` before it.

    Before the first are zeros, and the last run is filled up with zeros. Blocks are a
    multiple of `fresh`.
    """
    kinds = dict(df.dtypes)
    source = with_halo(df, context, 0).select("track", "channel", "offset", "samples", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for track, channel, offset, samples, left in zip(*(batch.column(i) for i in range(5))):
                x, before = (np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in (samples, left))
                n = -(-len(x) // fresh)
                if not n:
                    continue
                x = np.concatenate([np.zeros(context - len(before)), before, x, np.zeros(n * fresh - len(x))])
                p = [float(model(x[k * fresh : k * fresh + context + fresh])) for k in range(n)]
                w = offset.as_py() // fresh + np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array([track.as_py()] * n, batch.schema.field(0).type), pa.array([channel.as_py()] * n, batch.schema.field(1).type), pa.array(w, pa.int64()), pa.array(p, pa.float64())], names=["track", "channel", "w", "p"])

    return source.mapInArrow(run, f"track {kinds['track']}, channel {kinds['channel']}, w long, p double")


def aggregate(df: DataFrame, partial: Callable[[np.ndarray], Sequence[float]], names: Sequence[str], merge: str = "sum") -> DataFrame:
    """A user's aggregate: partial(samples of a block) gives numbers, merged over a track's blocks by sum, min or max."""
    kind = dict(df.dtypes)["track"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [partial(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([float(m[k]) for m in made], pa.float64()) for k in range(len(names)))], names=["track", *names])

    rows = df.select("track", "samples").mapInArrow(run, f"track {kind}, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("track").agg(*[getattr(F, merge)(n).alias(n) for n in names])


def fold(df: DataFrame, partial: Callable[[np.ndarray], Sequence[float]], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], fan_in: int = 64) -> DataFrame:
    """(track, channel, state): a user's aggregate with any associative merge, which may depend on the order.

    partial(samples of a block) gives a state, an array of numbers of any length; merge(a, b)
    joins the states of two stretches, a before b. Up to fan_in neighbours are merged in a
    task, then what came of them, and so on, so no track is in one task while it is long.
    """
    kinds = dict(df.dtypes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.asarray(partial(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)), np.float64) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(made, pa.list_(pa.float64()))], names=["track", "channel", "at", "state"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over sorted rows: a group may go on in the next batch."""
        key, state, done = None, None, []
        for batch in batches:
            types = batch.schema.types[:2]
            values, starts = flat(batch.column(3))
            out = lambda: pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in done], t) for i, t in enumerate(types)), pa.array([k[2] for k, _ in done], pa.int64()), pa.array([s for _, s in done], pa.list_(pa.float64()))], names=["track", "channel", "at", "state"])
            for i, new in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)))):
                own = values[starts[i] : starts[i + 1]]
                if new == key:
                    state = np.asarray(merge(state, own), np.float64)
                    continue
                if key is not None:
                    done.append((key, state))
                key, state = new, own.copy()
            if done:
                yield out()
                done = []
        if key is not None:
            done.append((key, state))
            yield out()

    schema = f"track {kinds['track']}, channel {kinds['channel']}, at long, state array<double>"
    # written once: a state for each block, of which the last block's number is wanted as well
    rows = settle(df.select("track", "channel", F.col("block_idx").cast("long").alias("at"), "samples").mapInArrow(first, schema))
    last = rows.agg(F.max("at")).first()[0] or 0
    while True:
        rows = rows.withColumn("group", F.floor(F.col("at") / fan_in)).repartition("track", "channel", "group").sortWithinPartitions("track", "channel", "group", "at").mapInArrow(joined, schema)
        last //= fan_in
        if not last:
            return rows.select("track", "channel", "state")


def measure_apply(df: DataFrame, partial: Callable[[np.ndarray], Sequence[float]], names: Sequence[str], apply: Callable[[np.ndarray, tuple[float, ...]], np.ndarray], merge: str = "sum") -> DataFrame:
    """A user's transform in two passes: measures each track by `aggregate`, then apply(samples, measures) on each block."""
    measured = aggregate(df, partial, names, merge)
    source = per_track(df, measured, place="block_idx").select(*KEY, "offset", "samples", F.array(*names).alias("m"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [apply(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64), tuple(m.as_py())) for x, m in zip(batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(done, pa.list_(pa.float64()))], names=[*KEY, "offset", "samples"])

    keys = ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "offset"))
    return source.mapInArrow(run, f"{keys}, samples array<double>")

