"""A lattice of first-order allpass sections whose coefficients change from sample to sample.

A section keeps one number z. With coefficient k and c = sqrt(1 - k*k) it turns its input x and
z like a rotation does: z becomes c*x + k*z, and -k*x + c*z goes on to the next section. So
neither adds nor takes energy, however k changes, and with k = 0 it is a delay of one sample.

For given coefficients, what a block does to the numbers that its sections hold is an affine
map. Blocks tell their maps, those are applied one after the other to the numbers of a
channel's beginning, then every block runs from its own. Inside a block each section is a
first-order recursion, added up by doubling steps over all samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import KEY, arrays, flat, parts
from .lineage import per_track, settle

#: Largest coefficient; and samples after which such sections have forgotten what they held, to the last bit of a double.
LARGEST, MEMORY = 0.95, 2048
#: Samples of blocks of one length that go through side by side, about.
TOGETHER = 1 << 16


def _recursion(k: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """z before each sample and at the end, of z(n+1) = k(n)*z(n) + b(n), for several b and first z side by side."""
    total, over, step = b.copy(), k.copy(), 1
    total[0] += k[0, ..., None] * first
    while step < len(k) and np.abs(over[step - 1 :]).max() > 1e-300:
        total[step:] = total[step:] + over[step:, ..., None] * total[:-step]
        over[step:] = over[step:] * over[:-step]
        over[:step] = 0  # what these reach back to is in them already
        step *= 2
    return np.concatenate([first[None], total])


def run(x: np.ndarray, k: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output, state at the end) of inputs (sample, …, column) through sections k (sample, …, section) from
    states (section, …, column); what stands between may be blocks of one length, each with its own k."""
    ends = np.empty_like(state)
    for s in range(k.shape[-1]):
        c = np.sqrt(1 - k[..., s] ** 2)
        z = _recursion(k[..., s], c[..., None] * x, state[s])
        x, ends[s] = c[..., None] * z[:-1] - k[..., s, None] * x, z[-1]
    return x, ends


def coefficients(rows: np.ndarray, first: int, count: int, offset: int, size: int, hop: int, strength: float) -> np.ndarray:
    """(sample, section) of a block at `offset`: rows first, first + 1, … of a trajectory of `count`, one each
    `hop` samples, with straight lines between them; behind the last row its values stay."""
    at = np.arange(offset, offset + size)
    low = np.minimum(at // hop, count - 1)
    high = np.minimum(low + 1, count - 1)
    share = (at / hop - low)[:, None]
    return np.clip(strength * (rows[low - first] + share * (rows[high - first] - rows[low - first])), -LARGEST, LARGEST)


def apply(df: DataFrame, trajectory: DataFrame, hop: int, order: int = 8, strength: float = 1.0) -> DataFrame:
    """The blocks through a lattice of `order` sections that follows each track's trajectory.

    trajectory: (track, row, k), k of `order` numbers for sample row * hop, rows from 0 without
    gaps. A track without rows has coefficients of zero, so it is `order` samples late.
    Results don't depend on how a channel is cut into blocks.
    """
    kinds = dict(df.dtypes)
    counts = trajectory.groupBy("track").agg(F.count(F.lit(1)).alias("_rows"))
    keys = per_track(df.select(*KEY, "offset", F.size("samples").alias("_n")), counts, place="block_idx").filter("_n > 0")
    low, high = F.floor(F.col("offset") / hop), F.floor((F.col("offset") + F.col("_n") - 1) / hop) + 1
    last = F.col("_rows") - 1
    wanted = keys.select(*KEY, F.col("_rows"), F.explode(F.sequence(F.least(low, last), F.least(high, last))).alias("row"))
    found = wanted.join(trajectory.select("track", F.col("row").cast("long").alias("row"), "k"), ["track", "row"])
    mine = found.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("row", "k"))).alias("_k"), F.max("_rows").alias("_rows"))
    source = settle(df.join(mine, KEY, "left").select(*KEY, "offset", F.col("samples").cast("array<double>").alias("samples"), "_k", "_rows"))

    def given(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one length: which they are, where their samples are (sample, row), those, their coefficients."""
        (x, starts), counts, offsets = flat(batch.column(4)), batch.column(6).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
        listed, sizes = batch.column(5), np.diff(starts)
        rows = listed.flatten()
        heads = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(listed).to_numpy(zero_copy_only=False)))]).astype(int)
        number, value = rows.field("row").to_numpy(zero_copy_only=False), rows.field("k").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        for size in np.unique(sizes):
            alike = np.flatnonzero(sizes == size)
            for mine in np.array_split(alike, max(1, -(-len(alike) * size // TOGETHER))):
                k = np.zeros((size, len(mine), order))
                for j, i in enumerate(mine):
                    if size and heads[i + 1] > heads[i]:
                        k[:, j] = coefficients(value[heads[i] : heads[i + 1]], number[heads[i]], int(counts[i]), offsets[i], size, hop, strength)
                at = starts[mine] + np.arange(size)[:, None]
                yield mine, at, x[at], k

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4):
            over, own = np.zeros((batch.num_rows, order * order)), np.zeros((batch.num_rows, order))
            for mine, at, x, k in given(batch):
                n = len(mine)
                if not len(at):
                    over[mine] = np.eye(order).ravel()
                    continue
                own[mine] = run(x[..., None], k, np.zeros((order, n, 1)))[1][..., 0].T
                if len(at) <= MEMORY:
                    unit = np.repeat(np.eye(order)[:, None], n, 1)
                    over[mine] = run(np.zeros((*x.shape, order)), k, unit)[1].swapaxes(0, 1).reshape(n, -1)
            rows = np.arange(batch.num_rows + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), arrays(over.ravel(), rows * order * order), arrays(own.ravel(), rows * order)], names=[*KEY, "over", "own"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over sorted rows: a channel may go on in the next batch."""
        channel, state = None, np.zeros(order)
        for batch in batches:
            over, own = flat(batch.column(3))[0].reshape(-1, order, order), flat(batch.column(4))[0].reshape(-1, order)
            out = np.empty_like(own)
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != channel:
                    channel, state = key, np.zeros(order)
                out[i] = state
                state = over[i] @ state + own[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), arrays(out.ravel(), np.arange(len(out) + 1) * order)], names=[*KEY, "state"])

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4):
            states, (samples, starts) = flat(batch.column(7))[0].reshape(-1, order), flat(batch.column(4))
            done = np.empty(len(samples))
            for mine, at, x, k in given(batch):
                if len(at):
                    done[at] = run(x[..., None], k, states[mine].T[..., None])[0][..., 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), arrays(done, starts)], names=[*KEY, "offset", "samples"])

    names = ", ".join(f"{c} {kinds[c]}" for c in KEY)
    found_maps = source.mapInArrow(maps, f"{names}, over array<double>, own array<double>")
    states = found_maps.repartition("track", "channel").sortWithinPartitions(*KEY).mapInArrow(carry, f"{names}, state array<double>")
    joined = source.join(states, KEY).select(*KEY, "offset", "samples", "_k", "_rows", "state")
    return joined.mapInArrow(through, f"{names}, offset {kinds['offset']}, samples array<double>")


def reflections(denominator: np.ndarray) -> np.ndarray:
    """Coefficients of the lattice with these denominators (…, order + 1), for many at once: the last one of
    each shorter denominator, kept to LARGEST."""
    a = np.asarray(denominator, np.float64)
    a = a / a[..., :1]
    out = np.empty((*a.shape[:-1], a.shape[-1] - 1))
    for m in range(a.shape[-1] - 1, 0, -1):
        k = np.clip(np.nan_to_num(a[..., m : m + 1], nan=0.0, posinf=0.0, neginf=0.0), -LARGEST, LARGEST)
        out[..., m - 1 : m] = k
        a = (a[..., :m] - k * a[..., m:0:-1]) / (1 - k * k)
        a[..., 0] = 1.0
    return out
