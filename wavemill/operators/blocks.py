"""Operators on blocks(track, channel, block_idx, offset, samples): the form for long recordings.

Blocks of one grid are rows, so a recording of any length is spread over tasks. What
reaches over a block's edge is exchanged as edges or states, never as whole tracks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import design
from .lineage import per_track, settle

KEY = ["track", "channel", "block_idx"]
BLOCK = 65_536
#: Blocks of a channel in a row that go through a recursive filter in one task.
SPAN = 16
SPAN_KEY = ["track", "channel", "_span"]
#: Samples of many short blocks that a task works on at once.
AT_ONCE = 1 << 18
#: Interpolation by four, twelve taps a phase, of the broadcast loudness standard (fixed values);
#: the third and fourth phase are the second and first read backwards.
TAPS = (
    (0.0017089843750, 0.0109863281250, -0.0196533203125, 0.0332031250000, -0.0594482421875, 0.1373291015625, 0.9721679687500, -0.1022949218750, 0.0476074218750, -0.0266113281250, 0.0148925781250, -0.0083007812500),
    (-0.0291748046875, 0.0292968750000, -0.0517578125000, 0.0891113281250, -0.1665039062500, 0.4650878906250, 0.7797851562500, -0.2003173828125, 0.1015625000000, -0.0582275390625, 0.0330810546875, -0.0189208984375),
)
PHASES = (*TAPS, TAPS[1][::-1], TAPS[0][::-1])
K_WEIGHTING = design.K_48000


def from_samples(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Frames must be dense from 0; keyed by block, so that no task gets a whole track."""
    kinds = dict(df.dtypes)
    rows = df.select("track", "channel", F.floor(F.col("frame") / size).cast("long").alias("block_idx"), "frame", "value")
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "frame").drop("frame")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in runs(batches, 3):
            starts = changes(whole, 3)
            keys = [whole.column(i).take(pa.array(starts)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, bundled(whole.column(3), starts)], names=[*KEY, "samples"])

    return _placed(rows.mapInArrow(cut, f"track {kinds['track']}, channel {kinds['channel']}, block_idx long, samples array<{kinds['value']}>"), size)


def _placed(df: DataFrame, size: int) -> DataFrame:
    return df.select(*KEY, (F.col("block_idx") * size).alias("offset"), "samples")


def from_rows(df: DataFrame, order: Sequence[str], channels: Sequence[str], size: int = BLOCK, packed: str | None = None) -> DataFrame:
    """Blocks of rows of which each is a frame, numbered by `order` in its track, with a column for each channel.

    Numbering takes a track's rows in one task, as they pass by: pass rows that are dealt by `track`.
    packed: a number that grows with track and the first of `order`, never null: sorting by it compares
    one number in place of rows.
    """
    kinds = dict(df.dtypes)
    rows = df.sortWithinPartitions(*[c for c in [packed] if c], "track", *order).select("track", *channels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counted = None, 0  # of the track that may go on
        for whole in runs(batches, 1, size):
            heads, n = changes(whole, 1), whole.num_rows
            lengths = np.diff(np.append(heads, n))
            before = np.zeros(len(heads), np.int64)
            if last is not None and len(changes(pa.concat_batches([last, whole.slice(0, 1)]), 1)) == 1:
                before[0] = counted
            last, counted = whole.slice(n - 1), int(before[-1] + lengths[-1])
            pieces = -(-lengths // size)  # what was before is whole blocks
            own = np.repeat(np.arange(len(heads)), pieces)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, block = heads[own] + nth * size, before[own] // size + nth
            track, numbers = whole.column(0).take(pa.array(starts)), [pa.array(np.full(len(starts), c, np.int32)) for c in range(len(channels))]
            made = [pa.RecordBatch.from_arrays([track, number, pa.array(block), bundled(whole.column(1 + c), starts)], names=[*KEY, "samples"]) for c, number in enumerate(numbers)]
            yield pa.concat_batches(made)

    return _placed(rows.mapInArrow(cut, f"track {kinds['track']}, channel int, block_idx long, samples array<{kinds[channels[0]]}>"), size)


def changes(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the first `keys` columns differ from the row before, the first row with them; nulls are alike."""
    codes = (batch.column(i).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for i in range(keys))
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for code in codes:
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def runs(batches: Iterator[pa.RecordBatch], keys: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches cut so that rows of like keys, the first `keys` columns, stay together;
    with `size`, a run that goes on is cut at a multiple of it, so that little is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tail = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 0)
        starts = changes(pa.concat_batches([tail, batch]), keys) - tail.num_rows
        starts = starts[starts >= 0]
        kept = sum(b.num_rows for b in held)
        begin = kept + starts[-1] if len(starts) else 0  # of the last run, in what is held and the batch
        cut = begin + (kept + batch.num_rows - begin) // size * size if size else begin
        held.append(batch)
        if cut:
            whole = pa.concat_batches(held)
            yield whole.slice(0, cut)
            held = [whole.slice(cut)] if cut < whole.num_rows else []
    if held:
        yield pa.concat_batches(held)


def bundled(column: pa.Array, starts: np.ndarray) -> pa.Array:
    """The column's values as arrays that begin at `starts`."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(column)), pa.int32()), column)


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where their arrays in `column` hold more than AT_ONCE samples together."""
    for batch in batches:
        ends, start = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The samples of all arrays in a row, and where each array starts; the last number is where they end."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def arrays(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.float64()))


def to_samples(df: DataFrame, factor: str | None = None) -> DataFrame:
    """factor: the column that a block's samples are multiplied with, one by one as they leave it."""
    out = df.select("track", "channel", "offset", *[c for c in [factor] if c], F.posexplode("samples").alias("i", "value"))
    value = F.col("value") * F.col(factor) if factor else F.col("value")
    return out.select("track", "channel", (F.col("offset") + F.col("i")).alias("frame"), value.cast("double").alias("value"))


def scale(df: DataFrame, factor: float) -> DataFrame:
    return df.withColumn("samples", F.transform("samples", lambda x: x * factor))


def slice_block(df: DataFrame, start: int, frames: int) -> DataFrame:
    """The same part of each block; its offset moves along."""
    return df.withColumn("samples", F.slice("samples", start + 1, frames)).withColumn("offset", F.col("offset") + start)


def interleave(df: DataFrame) -> DataFrame:
    """(track, block_idx, offset, n_channels, samples): the channels' samples in turns."""
    rows = df.groupBy("track", "block_idx", "offset").agg(F.sort_array(F.collect_list(F.struct("channel", "samples"))).alias("c"))
    mixed = F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.col("c")[0]["samples"]) - 1), lambda i: F.transform("c", lambda x: F.get(x["samples"], i))))
    return rows.select("track", "block_idx", "offset", F.size("c").alias("n_channels"), mixed.alias("samples"))


def deinterleave(df: DataFrame) -> DataFrame:
    each = df.withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("n_channels") - 1)))
    return each.select(*KEY, "offset", F.filter("samples", lambda x, i: i % F.col("n_channels") == F.col("channel")).alias("samples"))


def regrid(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of any offsets, dense in sum, to the grid: pieces move, keyed by their new block."""
    n = F.size("samples")
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + n - 1) / size)
    cut = df.filter(n > 0).withColumn("_to", F.explode(F.sequence(first, last)))
    start = F.greatest(F.lit(0).cast("long"), F.col("_to") * size - F.col("offset"))
    stop = F.least(n.cast("long"), (F.col("_to") + 1) * size - F.col("offset"))
    pieces = cut.select("track", "channel", F.col("_to").alias("block_idx"), F.struct((F.col("offset") + start).alias("at"), F.slice("samples", (start + 1).cast("int"), (stop - start).cast("int")).alias("samples")).alias("p"))
    rows = pieces.groupBy(*KEY).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return rows.select(*KEY, F.col("p")[0]["at"].alias("offset"), F.flatten("p.samples").alias("samples"))


def with_halo(df: DataFrame, before: int, behind: int) -> DataFrame:
    """Adds left and right: the last and first samples of the neighbours, as many as asked and there are.

    Only edges move to the neighbours; neither may be longer than a block.
    """
    edge = lambda step, cut: df.select("track", "channel", (F.col("block_idx") + step).alias("block_idx"), cut)
    none = F.expr("filter(samples, x -> false)")
    n = F.size("samples")
    out = df
    if before:
        out = out.join(edge(1, F.slice("samples", F.greatest(F.lit(1), n - before + 1), before).alias("left")), KEY, "left")
    if behind:
        out = out.join(edge(-1, F.slice("samples", 1, behind).alias("right")), KEY, "left")
    return out.withColumn("left", F.coalesce("left", none) if before else none).withColumn("right", F.coalesce("right", none) if behind else none)


def map_blocks(df: DataFrame, fn: Callable[[np.ndarray, int, int], np.ndarray], before: int = 0, behind: int = 0) -> DataFrame:
    """A user's transform: fn(samples with halo, how many of them are before, behind) -> the block's samples."""
    source = with_halo(df, before, behind).select(*KEY, "offset", "samples", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for samples, left, right in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("samples", "left", "right"))):
                parts = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) for x in (left, samples, right)]
                done.append(fn(np.concatenate(parts), len(parts[0]), len(parts[2])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(done, pa.list_(pa.float64()))], names=[*KEY, "offset", "samples"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "offset")) + ", samples array<double>")


def extreme(x: np.ndarray, half: int, largest: bool = True) -> np.ndarray:
    """Largest (or smallest) of each sample and `half` on both sides, by running extremes of runs of that width."""
    over, pad = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    width, n = 2 * half + 1, len(x)
    rows = -(-(n + 2 * half) // width)
    padded = np.full(rows * width, pad)
    padded[half : half + n] = x
    grid = padded.reshape(rows, width)
    ahead, back = over.accumulate(grid, 1).ravel(), over.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return over(back[:n], ahead[width - 1 : width - 1 + n])


def sliding_extreme(df: DataFrame, half: int, largest: bool = True) -> DataFrame:
    return map_blocks(df, lambda x, a, b: extreme(x, half, largest)[a : len(x) - b], half, half)


def interpolate(x: np.ndarray) -> np.ndarray:
    """Four samples for each one after the first eleven."""
    return np.lib.stride_tricks.sliding_window_view(x, 12)[:, ::-1] @ np.array(PHASES).T


def true_peak(df: DataFrame) -> DataFrame:
    """(track, true_peak): the largest of the samples and of four interpolated ones for each, with the tail behind the end."""
    haloed = with_halo(df, 11, 0)
    ends = df.groupBy("track", "channel").agg(F.max("block_idx").alias("_end"))
    source = per_track(haloed, ends, on=("track", "channel"), place="block_idx").select("track", "samples", "left", (F.col("block_idx") == F.col("_end")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for samples, left, last in zip(*(batch.column(i) for i in (1, 2, 3))):
                x, before = (np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in (samples, left))
                padded = np.concatenate([np.zeros(11 - len(before)), before, x, np.zeros(11 if last.as_py() else 0)])
                tops.append(max(np.abs(x).max(initial=0), np.abs(interpolate(padded)).max(initial=0)) if len(x) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tops, pa.float64())], names=["track", "p"])

    return source.mapInArrow(run, f"track {dict(df.dtypes)['track']}, p double").groupBy("track").agg(F.max("p").alias("true_peak"))


def true_peak_position(df: DataFrame) -> DataFrame:
    """(track, frame, magnitude): where the largest interpolated magnitude is, the first of equal ones.

    An interpolated value belongs to the last frame that it is made of; in the tail behind
    the end, to the last frame.
    """
    ends = df.groupBy("track", "channel").agg(F.max("block_idx").alias("_end"))
    source = per_track(with_halo(df, 11, 0), ends, on=("track", "channel"), place="block_idx")
    source = source.select("track", "offset", "samples", "left", (F.col("block_idx") == F.col("_end")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for offset, samples, left, last in zip(*(batch.column(i) for i in (1, 2, 3, 4))):
                x, before = (np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in (samples, left))
                padded = np.concatenate([np.zeros(11 - len(before)), before, x, np.zeros(11 if last.as_py() else 0)])
                tops = np.abs(interpolate(padded)).max(1) if len(padded) > 11 else np.zeros(1)
                at = int(tops.argmax())
                found.append((float(tops[at]), offset.as_py() + min(at, max(0, len(x) - 1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for m, _ in found], pa.float64()), pa.array([f for _, f in found], pa.int64())], names=["track", "m", "f"])

    rows = source.mapInArrow(run, f"track {dict(df.dtypes)['track']}, m double, f long")
    best = rows.groupBy("track").agg(F.max(F.struct("m", (-F.col("f")).alias("f"))).alias("b"))
    return best.select("track", (-F.col("b.f")).alias("frame"), F.col("b.m").alias("magnitude"))


def each(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A function of single samples, for many blocks at once."""
    source, kinds = df.select(*KEY, "offset", "samples"), dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4):
            x, starts = flat(batch.column(4))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), arrays(fn(x), starts)], names=[*KEY, "offset", "samples"])

    return source.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "offset")) + ", samples array<double>")


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest of all channels (arrays of an array), frame by frame."""
    for batch in batches:
        done = []
        for channels in batch.column(4):
            x, starts = flat(channels.values)
            sizes = np.diff(starts)
            if len(set(sizes)) > 1:  # a channel that ends before
                whole = np.full((len(sizes), sizes.max()), -np.inf)
                whole[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - np.repeat(starts[:-1], sizes)] = x
            else:
                whole = x.reshape(len(sizes), -1)
            done.append(whole.max(0))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(done, pa.list_(pa.float64()))], names=[*KEY, "offset", "samples"])


def held_magnitudes(df: DataFrame, half: int) -> DataFrame:
    """(track, channel 0, …) blocks: the largest interpolated magnitude over all channels, of the frames within `half`."""
    loud, kinds = map_blocks(df, _magnitudes, 11, 0), dict(df.dtypes)
    top = loud.groupBy("track", "block_idx", "offset").agg(F.collect_list("samples").alias("all"))  # an array for each channel
    schema = f"track {kinds['track']}, channel int, block_idx {kinds['block_idx']}, offset {kinds['offset']}, samples array<double>"
    # written once, as the halo's edges are read beside the blocks
    largest = settle(top.select("track", F.lit(0).alias("channel"), "block_idx", "offset", "all").mapInArrow(_largest, schema))
    return sliding_extreme(largest, half)


def decibels(x: np.ndarray) -> np.ndarray:
    return 20.0 * np.log10(np.maximum(x, 1e-10))


def detection(df: DataFrame, half: int) -> DataFrame:
    """held_magnitudes in dB."""
    return each(held_magnitudes(df, half), decibels)


def _magnitudes(x: np.ndarray, before: int, behind: int) -> np.ndarray:
    return np.abs(interpolate(np.concatenate([np.zeros(11 - before), x]))).max(1)


def true_peak_long(df: DataFrame) -> DataFrame:
    """The same over samples(track, channel, frame, value), by lags."""
    order = Window.partitionBy("track", "channel").orderBy("frame")
    tail = df.groupBy("track", "channel").agg(F.max("frame").alias("n"))
    tail = tail.select("track", "channel", F.explode(F.sequence(F.col("n") + 1, F.col("n") + 11)).alias("frame"), F.lit(0.0).alias("value"))
    lagged = df.select("track", "channel", "frame", "value").unionByName(tail).select("track", "value", *[F.lag("value", k, 0.0).over(order).alias(f"v{k}") for k in range(12)])
    dots = [F.abs(sum(F.col(f"v{k}") * tap for k, tap in enumerate(phase))) for phase in PHASES]
    return lagged.groupBy("track").agg(F.max(F.greatest(F.abs("value"), *dots)).alias("true_peak"))


class Filter:
    """Second-order sections in a row as one linear system, run in stretches of matrix products."""

    def __init__(self, sections: Sequence[tuple[Sequence[float], Sequence[float]]], stretch: int = 256):
        a, b, c, d = np.zeros((0, 0)), np.zeros((0, 1)), np.zeros((1, 0)), 1.0
        for num, den in sections:
            b0, b1, b2 = (x / den[0] for x in num)
            a1, a2 = den[1] / den[0], den[2] / den[0]
            sa, sb, sc = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([[b1 - a1 * b0], [b2 - a2 * b0]]), np.array([[1.0, 0.0]])
            a = np.block([[a, np.zeros((len(a), 2))], [sb @ c, sa]])
            b, c, d = np.vstack([b, sb * d]), np.hstack([b0 * c, sc]), b0 * d
        self.a, self.b, self.c, self.d, self.stretch = a, b, c, d, stretch
        powers = [np.eye(len(a))]
        for _ in range(stretch):
            powers.append(powers[-1] @ a)
        response = np.array([d, *(float((c @ p @ b)[0, 0]) for p in powers[: stretch - 1])])
        i, j = np.indices((stretch, stretch))
        self.inside = np.where(i >= j, response[np.maximum(i - j, 0)], 0.0)
        self.ahead = np.vstack([c @ p for p in powers[:stretch]])
        self.into = np.hstack([powers[stretch - 1 - k] @ b for k in range(stretch)])
        self.over = powers[stretch]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The output and the state at the end; of many inputs of one length, if they are columns."""
        out, n = np.empty(x.shape), self.stretch
        for at in range(0, len(x) - n + 1, n):
            part = x[at : at + n]
            out[at : at + n] = self.inside @ part + self.ahead @ state
            state = self.over @ state + self.into @ part
        rest = x[len(x) // n * n :]
        if k := len(rest):
            out[-k:] = self.inside[:k, :k] @ rest + self.ahead[:k] @ state
            state = np.linalg.matrix_power(self.a, k) @ state + self.into[:, n - k :] @ rest
        return out, state

    def settled(self) -> np.ndarray:
        """The state that an endless input of ones leads to."""
        return np.linalg.solve(np.eye(len(self.a)) - self.a, self.into[:, -1])


Sections = Sequence[tuple[Sequence[float], Sequence[float]]]


def _machines(df: DataFrame, sections: Sections | Callable[[float], Sections]) -> dict[float | None, Filter]:
    """One filter, or one for each distinct rate in the column `rate`, of which there are few."""
    if not callable(sections):
        return {None: Filter(sections)}
    return {r["rate"]: Filter(sections(float(r["rate"]))) for r in df.select("rate").distinct().collect()}


def lti_map(df: DataFrame, sections: Sections | Callable[[float], Sections], finish: Callable[[dict, np.ndarray, np.ndarray], dict[str, Sequence | pa.Array]], schema: str, keep: Sequence[str] = (), backward: bool = False, settled: bool = False, dealt: bool = False) -> DataFrame:
    """Filters each channel as if it were one run, block by block, and returns what finish makes of many blocks.

    SPAN blocks of a channel in a row are a span, which passes through the filter in one task, from
    block to block; blocks of one length of many spans go side by side. Only channels of more than
    one span are read before: every block tells, from rest, the state at its end; these few
    numbers are carried along the channel, and each span after the first gets its state.
    finish(columns of the blocks' key, offset and `keep` as lists, their filtered samples in a row,
    where each block starts in them) gives columns of rows. backward: from a channel's last
    sample to its first. settled: as if the sample that comes first had always been there,
    not silence. Blocks without a track or channel are in no run and left out. dealt: every channel's
    blocks are in one task of df already, as from_rows leaves them; they aren't shuffled unless a channel
    has more than one span.
    """
    machines = _machines(df, sections)
    by_rate = None not in machines
    kinds = dict(df.dtypes)
    keys = f"track {kinds['track']}, channel {kinds['channel']}"
    given = [*SPAN_KEY, "block_idx", *(["rate"] if by_rate else [])]
    extra = f", rate {kinds['rate']}" if by_rate else ""
    df = df.dropna(subset=KEY).withColumn("_span", F.floor(F.col("block_idx") / SPAN).cast("long"))
    order = [F.col("block_idx").desc() if backward else F.col("block_idx")]

    def alike(batch: pa.RecordBatch, starts: np.ndarray, which: np.ndarray) -> Iterator[tuple[Filter, np.ndarray, np.ndarray]]:
        """Of the rows `which`, those of one filter and one length: that filter, the rows, and where their samples are (sample, row)."""
        rates = np.array(batch.column(4).take(pa.array(which)).to_pylist(), object) if by_rate else np.full(len(which), None)
        sizes = np.diff(starts)[which]
        for rate in dict.fromkeys(rates.tolist()):
            mine = rates == rate if by_rate else np.ones(len(which), bool)
            for size in np.unique(sizes[mine]):
                rows = which[mine & (sizes == size)]
                at = starts[rows] + np.arange(size)[:, None]
                yield machines[rate], rows, at[::-1] if backward else at

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, len(given)):
            x, starts = flat(batch.column(len(given)))
            found: list = [None] * batch.num_rows
            for machine, rows, at in alike(batch, starts, np.arange(batch.num_rows)):
                state = machine.run(x[at], np.zeros((len(machine.a), len(rows))))[1]
                for row, own in zip(rows, state.T):
                    found[row] = own
            sizes = np.diff(starts)
            first = np.where(sizes > 0, np.append(x, 0.0)[np.where(sizes > 0, starts[1:] - 1 if backward else starts[:-1], 0)], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(given))), pa.array(sizes, pa.int64()), pa.array(first, pa.float64()), pa.array(found, pa.list_(pa.float64()))], names=[*given, "size", "first", "state"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over sorted rows: a channel may go on in the next batch. A state for each span, null before the first sample."""
        channel, span, state, begun, over = None, None, np.zeros(0), False, {}
        for batch in batches:
            out, heads = [], []
            rates = batch.column(4).to_pylist() if by_rate else [None] * batch.num_rows
            own, starts = flat(batch.column(batch.num_columns - 1))
            sizes, firsts = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
            for i, (key, here, rate, size, first) in enumerate(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist(), rates, sizes, firsts)):
                machine = machines[rate]
                if new := key != channel:
                    channel, state, begun = key, np.zeros(len(machine.a)), not settled
                if new or here != span:
                    span = here
                    heads.append(i)
                    out.append(state if begun else None)
                if not begun and size:
                    state, begun = machine.settled() * first, True
                if (rate, size) not in over:
                    over[rate, size] = np.linalg.matrix_power(machine.a, size)
                state = over[rate, size] @ state + own[starts[i] : starts[i + 1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(heads, pa.int64())) for i in range(3)), pa.array(out, pa.list_(pa.float64()))], names=[*SPAN_KEY, "state"])

    source, more = df, []
    long = settle(df.filter("_span != 0").select("track", "channel").distinct())
    if not long.isEmpty():
        states = per_track(df.select(*given, "samples"), long, on=("track", "channel"), place="block_idx").select(*given, "samples")
        states = states.mapInArrow(ends, f"{keys}, _span long, block_idx {kinds['block_idx']}{extra}, size long, first double, state array<double>")
        states = states.repartition("track", "channel").sortWithinPartitions("track", "channel", *order).mapInArrow(carry, f"{keys}, _span long, state array<double>")
        source, more = per_track(df, states, "left", tuple(SPAN_KEY), "block_idx"), ["state"]
    source = source.select(*given, "offset", *[c for c in keep if c not in given], "samples", *more)
    source = (source if dealt and not more else source.repartition(*SPAN_KEY)).sortWithinPartitions(*SPAN_KEY, *order)
    names = [c for c in source.columns if c not in ("samples", "state")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over sorted rows: a span may go on in the next batch."""
        last, end, started = None, np.zeros(0), False
        for batch in parts(batches, len(names)):
            x, starts = flat(batch.column(len(names)))
            key = batch.select(SPAN_KEY)
            heads = changes(key, 3)
            lengths = np.diff(np.append(heads, batch.num_rows))
            states, begun = np.zeros((len(next(iter(machines.values())).a), len(heads))), np.full(len(heads), not settled)
            if more:
                given_states = batch.column(len(names) + 1).take(pa.array(heads))
                known = given_states.is_valid().to_numpy(zero_copy_only=False)
                states[:, known], begun[known] = flat(given_states.drop_null())[0].reshape(known.sum(), len(states)).T, True
            if last is not None and len(changes(pa.concat_batches([last, key.slice(0, 1)]), 3)) == 1:
                states[:, 0], begun[0] = end, started
            y, group = np.empty(len(x)), np.repeat(np.arange(len(heads)), lengths)
            for step in range(lengths.max()):
                for machine, rows, at in alike(batch, starts, heads[lengths > step] + step):
                    if not len(at):
                        continue
                    fresh = ~begun[group[rows]]
                    if fresh.any():
                        states[:, group[rows[fresh]]], begun[group[rows]] = machine.settled()[:, None] * x[at[0, fresh]], True
                    y[at], states[:, group[rows]] = machine.run(x[at], states[:, group[rows]])
            last, end, started = key.slice(batch.num_rows - 1), states[:, -1], bool(begun[-1])
            made = finish(dict(zip(names, batch.columns)), y, starts)
            yield pa.RecordBatch.from_pydict(made, schema=arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return source.mapInArrow(run, schema)


def lti_filter(df: DataFrame, sections: Sections | Callable[[float], Sections], backward: bool = False, settled: bool = False) -> DataFrame:
    """The filtered blocks. A callable gets the rate of each track, from the column `rate`."""
    kinds, rated = dict(df.dtypes), callable(sections)
    names = (*KEY, "offset", "rate") if rated else (*KEY, "offset")

    def finish(rows: dict, y: np.ndarray, starts: np.ndarray) -> dict:
        return {c: rows[c] for c in names} | {"samples": arrays(y, starts)}

    keys = ", ".join(f"{c} {kinds[c]}" for c in names)
    return lti_map(df, sections, finish, f"{keys}, samples array<double>", backward=backward, settled=settled)


def gated_sums(df: DataFrame, sections: Sections | Callable[[float], Sections], spans: Sequence[tuple[float, float]], rate: float | None = None, weights: Sequence[float] | None = None, dealt: bool = False) -> DataFrame:
    """(track, span, gate, power): sums of squares of the filtered channels, for gates of span[0] seconds
    every span[1], spans numbered from 0; of blocks that a task works on at once, one row leaves for each gate
    of a track, none for each sample.

    weights: of the channels, 1 without. rate: of all tracks, or None for the column `rate`. dealt: see lti_map.
    """
    kind = dict(df.dtypes)["track"]

    def finish(rows: dict, y: np.ndarray, starts: np.ndarray) -> dict:
        count, lengths, at = len(starts) - 1, np.diff(starts), rows["offset"].to_numpy()
        frames = np.full(count, rate) if rate else np.array(rows["rate"].to_pylist(), np.float64)
        squares = y * y if weights is None else y * y * np.repeat(np.asarray(weights, np.float64)[rows["channel"].to_numpy()], lengths)
        zero = starts[:-1] + np.arange(count)  # each block's sums up to a sample begin with 0
        sums = np.zeros(len(y) + count)
        for n in np.unique(lengths[lengths > 0]):
            which = np.flatnonzero(lengths == n)[:, None]
            sums[zero[which] + np.arange(1, n + 1)] = squares[starts[which] + np.arange(n)].cumsum(1)
        row, span, gate, sum_ = [], [], [], []
        for k, (seconds, every) in enumerate(spans):
            size, step = (np.floor(s * frames + 0.5).astype(np.int64) for s in (seconds, every))
            with np.errstate(divide="raise"):
                first, last = np.maximum(0, (at - size) // step + 1), (at + lengths - 1) // step
            met = np.where(lengths > 0, np.maximum(0, last - first + 1), 0)
            own = np.repeat(np.arange(count), met)
            gates = np.arange(len(own)) - np.repeat(np.cumsum(met) - met, met) + first[own]
            begin, end = (np.clip(gates * step[own] + s - at[own], 0, lengths[own]) for s in (0, size[own]))
            row.append(own)
            span.append(np.full(len(own), k, np.int32))
            gate.append(gates)
            sum_.append(sums[zero[own] + end] - sums[zero[own] + begin])
        track, span, gate = np.concatenate(row), np.concatenate(span), np.concatenate(gate)
        heads = changes(pa.RecordBatch.from_arrays([rows["track"]], names=["track"]), 1)
        key = ((np.searchsorted(heads, track, "right") - 1) * len(spans) + span) * (gate.max(initial=0) + 1) + gate
        _, met, own = np.unique(key, return_index=True, return_inverse=True)
        return {"track": rows["track"].take(pa.array(track[met])), "span": span[met], "gate": gate[met], "power": np.bincount(own, np.concatenate(sum_), len(met))}

    rows = lti_map(df, sections, finish, f"track {kind}, span int, gate long, power double", () if rate else ("rate",), dealt=dealt)
    if dealt:  # as many small tasks as df has would each write a file for every partition of the session's number
        rows = rows.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // 4), "track")
    return rows.groupBy("track", "span", "gate").agg(F.sum("power").alias("power"))


def magnitudes(df: DataFrame, fn: Callable[[np.ndarray, float], dict[str, Sequence]], schema: str, tops: DataFrame) -> DataFrame:
    """What fn makes of each block's magnitudes and its track's number in tops (track, top)."""
    source = per_track(df, tops, place="block_idx").select("track", "top", "samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            (x, starts), tops = flat(batch.column(2)), batch.column(1).to_pylist()
            x, row, made = np.abs(x), [], []
            for i, top in enumerate(tops):
                made.append(fn(x[starts[i] : starts[i + 1]], top))
                row.append(len(next(iter(made[-1].values()))))
            joined = {c: np.concatenate([m[c] for m in made]) for c in made[0]}
            yield pa.RecordBatch.from_pydict({"track": batch.column(0).take(pa.array(np.repeat(np.arange(len(tops)), row)))} | joined, schema=arrow)

    full = f"track {dict(df.dtypes)['track']}, {schema}"
    arrow = to_arrow_schema(T.StructType.fromDDL(full))
    return source.mapInArrow(run, full)


def peak(df: DataFrame) -> DataFrame:
    """(track, peak): the largest finite magnitude, 0 without any; a number for each block is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            x, starts = flat(batch.column(1))
            x, filled = np.abs(x), np.flatnonzero(np.diff(starts))
            tops = np.zeros(batch.num_rows)
            if len(filled):
                tops[filled] = np.maximum.reduceat(np.where(x < np.inf, x, 0.0), starts[filled])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tops)], names=["track", "p"])

    return df.select("track", "samples").mapInArrow(run, f"track {dict(df.dtypes)['track']}, p double").groupBy("track").agg(F.max("p").alias("peak"))


def histogram(df: DataFrame, buckets: int = 1024) -> DataFrame:
    """(track, bucket, n, bucket_max), as samples.histogram; counted inside each block first."""

    def count(x: np.ndarray, top: float) -> dict:
        at = np.minimum(buckets - 1, np.floor(x * buckets / top)).astype(np.int64) if top > 0 else np.zeros(len(x), np.int64)
        n = np.bincount(at)
        return {"bucket": np.flatnonzero(n), "n": n[n > 0], "bucket_max": [top] * int((n > 0).sum())}

    tops = peak(df).withColumnRenamed("peak", "top")
    return magnitudes(df, count, "bucket int, n long, bucket_max double", tops).groupBy("track", "bucket", "bucket_max").agg(F.sum("n").alias("n"))


def moving_average(df: DataFrame, window: int) -> DataFrame:
    """The mean of each sample and window // 2 on both sides, of those that there are."""
    half = window // 2

    def mean(x: np.ndarray, before: int, behind: int) -> np.ndarray:
        sums, at = np.concatenate([[0.0], np.cumsum(x)]), np.arange(before, len(x) - behind)
        low, high = np.maximum(0, at - half), np.minimum(len(x), at + half + 1)
        return (sums[high] - sums[low]) / (high - low)

    return map_blocks(df, mean, half, half)


def shape_noise(df: DataFrame, bits: int) -> DataFrame:
    """As samples.shape_noise: the difference of the rounded running sums; a block begins with the sum of those before it."""
    order = Window.partitionBy("track", "channel").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    sums = df.select(*KEY, total.alias("own")).select(*KEY, F.coalesce(F.sum("own").over(order), F.lit(0.0)).alias("before"))  # a number for each block
    source, kinds, steps = df.join(sums, KEY).select(*KEY, "offset", "samples", "before"), dict(df.dtypes), float(1 << (bits - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for samples, before in zip(batch.column(4), batch.column(5).to_pylist()):
                x = np.asarray(samples.values.to_numpy(zero_copy_only=False), np.float64)
                done.append(np.diff(np.floor(np.concatenate([[before], before + np.cumsum(x)]) * steps + 0.5) / steps))
                if batch.column(3)[len(done) - 1].as_py() == 0 and len(x):
                    done[-1][0] += np.floor(before * steps + 0.5) / steps  # nothing is taken off the first
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(done, pa.list_(pa.float64()))], names=[*KEY, "offset", "samples"])

    keys = ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "offset"))
    return source.mapInArrow(run, f"{keys}, samples array<double>")


def zero_phase(df: DataFrame, sections: Sections) -> DataFrame:
    """Forward, then backward; what lies between is written once, as each pass reads its input twice."""
    return lti_filter(settle(lti_filter(df, sections)), sections, backward=True)


def band_pass(df: DataFrame, rate: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Zero-phase high-pass at `low` hertz, then low-pass at `high`; either may be left out."""
    if low:
        df = zero_phase(df, [design.high_pass(rate, low)])
        df = settle(df) if high else df
    return zero_phase(df, [design.low_pass(rate, high)]) if high else df


def smooth(df: DataFrame, milliseconds: float, rate: float, both_ways: bool = False) -> DataFrame:
    """One-pole smoothing of every channel from its first value on, forward or (zero-phase) forward and
    backward; 0 ms changes nothing."""
    if milliseconds <= 0:
        return df
    sections = [design.one_pole(design.smoothing(milliseconds, rate, both_ways))]
    out = lti_filter(df, sections, settled=True)
    return lti_filter(settle(out), sections, backward=True, settled=True) if both_ways else out


def rotate_phase(df: DataFrame, degrees: float) -> DataFrame:
    return lti_filter(df, [design.allpass(degrees)])


def hann(n: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))


def stft(df: DataFrame, fft: int, hop: int, tail: bool = False) -> DataFrame:
    """(track, channel, stft_frame, re, im): a frame belongs to the block of its first sample.

    Blocks are of one size, a multiple of hop, and no shorter than fft - hop. With
    `tail`, samples behind the last whole frame make one more, padded with zeros.
    """
    ends = df.groupBy("track", "channel").agg(F.max(F.col("offset") + F.size("samples")).alias("_n"))
    source = per_track(with_halo(df, 0, fft - hop), ends, on=("track", "channel"), place="block_idx").select("track", "channel", "offset", "samples", "right", "_n")
    window, kinds = hann(fft), dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 3):
            (x, own), (right, behind) = flat(batch.column(3)), flat(batch.column(4))
            offset, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sizes, more = np.diff(own), np.diff(behind)
            at = np.concatenate([[0], np.cumsum(sizes + more + fft)])  # each block, what follows it, then zeros
            signal = np.zeros(at[-1])
            signal[np.arange(len(x)) + np.repeat(at[:-1] - own[:-1], sizes)] = x
            signal[np.arange(len(right)) + np.repeat(at[:-1] + sizes - behind[:-1], more)] = right
            whole = np.maximum(0, (n - fft) // hop + 1)
            count = whole + ((n > whole * hop) if tail else 0)
            first = -(-offset // hop)
            each = np.maximum(0, np.minimum(count, -(-(offset + sizes) // hop)) - first)
            row = np.repeat(np.arange(len(each)), each)
            frame = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            begin, step = at[row] + frame * hop - offset[row], max(1, AT_ONCE // fft)
            for k in range(0, len(row), step):
                spectra = np.fft.rfft(signal[begin[k : k + step, None] + np.arange(fft)] * window)
                bins = np.arange(len(spectra) + 1) * spectra.shape[1]
                rows = pa.array(row[k : k + step])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(frame[k : k + step], pa.int64()), arrays(spectra.real.ravel(), bins), arrays(spectra.imag.ravel(), bins)], names=["track", "channel", "stft_frame", "re", "im"])

    return source.mapInArrow(run, f"track {kinds['track']}, channel {kinds['channel']}, stft_frame long, re array<double>, im array<double>")


def spectrogram(df: DataFrame, fft: int, hop: int) -> DataFrame:
    """(track, channel, stft_frame, bands): magnitudes times 2 / fft, the padded tail frame with them."""
    if hop > fft:
        raise ValueError("the hop is longer than the frame")
    scale = 2.0 / fft
    return stft(df, fft, hop, tail=True).select("track", "channel", "stft_frame", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b) * scale).alias("bands"))


def istft(spectra: DataFrame, fft: int, hop: int, size: int = BLOCK) -> DataFrame:
    """Overlap-add of windowed frames, divided by the summed squares of the window, as blocks of `size`."""
    window, kinds = hann(fft), dict(spectra.dtypes)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Frames that overlap are added up here already; their sum is cut at the blocks' borders."""
        for batch in parts(batches, 3):
            named = pd.DataFrame({"track": batch.column(0).to_pylist(), "channel": batch.column(1).to_pylist()})
            signal, frame = named.groupby(["track", "channel"], dropna=False, sort=False).ngroup().to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            order = np.lexsort((frame, signal))
            signal, frame = signal[order], frame[order]
            re, im = (flat(batch.column(i))[0].reshape(len(order), -1)[order] for i in (3, 4))
            y = np.fft.irfft(re + 1j * im, fft) * window
            fresh = np.append(True, (np.diff(signal) != 0) | (np.diff(frame) * hop > fft))
            run, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            begin, end = frame[heads] * hop, frame[np.append(heads[1:], len(frame)) - 1] * hop + fft
            at = np.concatenate([[0], np.cumsum(end - begin)])
            place = (at[run] + frame * hop - begin[run])[:, None] + np.arange(fft)
            num = np.bincount(place.ravel(), y.ravel(), at[-1])
            den = np.bincount(place.ravel(), np.tile(window * window, len(frame)), at[-1])
            pieces = (end - 1) // size - begin // size + 1
            which = np.repeat(np.arange(len(heads)), pieces)
            block = begin[which] // size + np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            low = np.maximum(begin[which], block * size)
            cuts = np.append(at[which] + low - begin[which], at[-1])  # pieces follow one another without gaps
            rows = pa.array(order[heads[which]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(block, pa.int64()), pa.array(low - block * size, pa.int32()), arrays(num, cuts), arrays(den, cuts)], names=["track", "channel", "block_idx", "at", "num", "den"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over sorted rows: a block may go on in the next batch."""
        key, sums, done, held = None, [], [], 0

        def finished() -> np.ndarray:
            n = max(a + len(v) for a, v, _ in sums)
            num, den = np.zeros(n), np.zeros(n)
            for a, v, w in sums:
                num[a : a + len(v)] += v
                den[a : a + len(w)] += w
            return np.where(den > 1e-8, num / np.maximum(den, 1e-8), 0.0)

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], t) for i, t in enumerate(types)]
            values, ends = np.concatenate([x for _, x in done]), np.cumsum([0, *(len(x) for _, x in done)])
            return pa.RecordBatch.from_arrays([*columns, arrays(values, ends)], names=[*KEY, "samples"])

        for batch in batches:
            types = batch.schema.types[:3]
            (num, starts), (den, _) = flat(batch.column(4)), flat(batch.column(5))
            for i, (new, at) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in range(3))), batch.column(3).to_pylist())):
                if new != key:
                    if key is not None:
                        done.append((key, finished()))
                        held += len(done[-1][1])
                        if held >= AT_ONCE:
                            yield out()
                            done, held = [], 0
                    key, sums = new, []
                sums.append((at, num[starts[i] : starts[i + 1]].copy(), den[starts[i] : starts[i + 1]].copy()))
        if key is not None:
            done.append((key, finished()))
            yield out()

    keys = f"track {kinds['track']}, channel {kinds['channel']}, block_idx long"
    pieces = spectra.select("track", "channel", F.col("stft_frame").cast("long"), "re", "im").mapInArrow(frames, f"{keys}, at int, num array<double>, den array<double>")
    return _placed(pieces.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(add, f"{keys}, samples array<double>"), size)
