"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period p that holds it at least three times and
that no neighbour extends. Positions are selected at scales tau = 4, 8, 16, …: position i
belongs to the set of a scale when, of the hashes of the tau words that begin at i, i+1, …,
i+tau, the least one stands at i or at i+tau. So whether i is selected depends on the 2*tau
words from i on only: where those come again, both places are selected or none is. Starts of
words with a period of tau/3 or less are left out of the least (they would be selected all
over); they lie in runs that smaller scales have found already.

In a run of period p, 2*tau <= p < 4*tau, one of the first p positions i is selected at scale
tau: otherwise p + 2*tau - 1 words of it had a period of tau/3 or less, which then divided p.
The run holds p + 2*tau words from i on, so i and i + p are two selected positions with
equal contexts, and comparing each selected position with those less than 4*tau behind it
proposes every period. Each proposal is extended word by word, so that hashes that happen to
agree cost time and never a wrong run. Periods under 8 are read off comparisons of the words
with themselves, shifted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices, _text_sizes, _with
from .common import map_batches, word_chunks

#: Periods under twice this are found directly; it is the first scale.
FIRST = 4
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (the finaliser of splitmix64)."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def _longer(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2*size words from those of size words."""
    return _mixed(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where flags begin and cease to be set."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree before the first that doesn't."""
    start, size, n = 0, 64, min(len(a), len(b))
    while start < n:
        differ = np.flatnonzero(a[start : min(n, start + size)] != b[start : min(n, start + size)])
        if len(differ):
            return start + int(differ[0])
        start, size = start + size, 2 * size
    return n


def selected(hashes: np.ndarray, tau: int, periodic: np.ndarray) -> np.ndarray:
    """The scale's positions. hashes: of the tau words from each position on; periodic: which of
    these have a period of tau/3 or less."""
    names = _mixed(hashes ^ np.uint64(tau))
    names[periodic] = LAST
    least, width = names, 1
    while width < tau:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], names[tau:])
    first = names[: len(least)]
    return np.flatnonzero((least != LAST) & ((least == first) | (least == names[tau:])))


def _proposed(at: np.ndarray, context: np.ndarray, tau: int) -> np.ndarray:
    """(period, position) of equal contexts 2*tau or more, but less than 4*tau apart, sorted."""
    found = [np.empty((0, 2), np.int64)]
    for k in range(1, len(at)):
        apart = at[k:] - at[:-k]
        near = apart < 4 * tau
        if not near.any():
            break
        hit = np.flatnonzero(near & (apart >= 2 * tau) & (context[k:] == context[:-k]))
        found.append(np.stack([apart[hit], at[hit]], axis=1))
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def find(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, length, period) of every run with a length of three periods or more, sorted by start, then period.

    words: whole numbers, equal for equal words. longest: no run is longer than this many
    words (where separators that occur once stand between texts, sorted by falling length).
    """
    n = len(words)
    longest = n if longest is None else min(n, longest)
    runs = [np.empty((0, 3), np.int64)]
    for period in range(1, min(2 * FIRST - 1, longest // 3) + 1):
        start, stop = _stretches(words[:-period] == words[period:])
        keep = stop - start >= 2 * period
        start, stop = start[keep], stop[keep]
        runs.append(np.stack([start, stop - start + period, np.full(len(start), period)], axis=1))
    hashes, size, tau = _mixed(words.astype(np.uint64)), 1, FIRST
    while 6 * tau <= longest:
        while size < tau:
            hashes, size = _longer(hashes, size), 2 * size
        held = np.concatenate(runs)
        held = held[(3 * held[:, 2] <= tau) & (held[:, 1] >= tau)]
        depth = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(depth, held[:, 0], 1)
        np.add.at(depth, held[:, 0] + held[:, 1] - tau + 1, -1)
        at = selected(hashes, tau, np.cumsum(depth[:-1]) > 0)
        proposed = _proposed(at, _longer(hashes, tau)[at], tau)
        found, last, reached = [], 0, 0
        for period, i in proposed.tolist():
            if period == last and i < reached:
                continue
            stop = i + _agreeing(words[i:], words[i + period :])
            start = i - _agreeing(words[:i][::-1], words[: i + period][::-1][: i])
            last, reached = period, stop
            if stop - start >= 2 * period:
                found.append((start, stop - start + period, period))
        runs.append(np.array(found, np.int64).reshape(-1, 3))
        tau *= 2
    out = np.concatenate(runs)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    # a multiple of a run's period gives the same stretch: the smallest one stays
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
    out = out[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) > 0


def _marked(texts: list[str | None], least: int) -> tuple[list[np.ndarray], list[str]]:
    """Runs and collapsed text of each text, found together: texts stand side by side, the longest
    first, with a number between them that nothing else has."""
    words = [[w for some in word_chunks((t or "").encode()) for w in some] for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(words[i]))
    codes: dict[bytes, int] = {}
    parts, begin, at = [], {}, 0
    for k, i in enumerate(order):
        begin[i] = at
        parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words[i]), np.int64, len(words[i])))
        parts.append(np.array([-1 - k], np.int64))
        at += len(words[i]) + 1
    found = find(np.concatenate([*parts, np.empty(0, np.int64)]), max(map(len, words), default=0))
    found = found[found[:, 1] >= least]
    runs, texts_out = [], []
    for i, mine in enumerate(words):
        low, high = np.searchsorted(found[:, 0], [begin[i], begin[i] + len(mine)])
        own = found[low:high] - [begin[i], 0, 0]
        if len(own):
            gone = dropped(len(mine), own)
            mine = [w for w, g in zip(mine, gone.tolist()) if not g]
        runs.append(own)
        texts_out.append(b" ".join(mine).decode())
    return runs, texts_out


def mark(df: DataFrame, text: str = "text", least: int = 24) -> DataFrame:
    """Adds `runs`, the periodic runs of the whole text, and `collapsed`, its words without repetitions.

    runs: array of (start, length, period) in words, by start, then period; a run has
    max(least, 3 periods) words or more. collapsed: the words, joined by one space, without
    those that some run contains after its first period. A null or empty text has no runs
    and an empty collapsed text. Repeated rows stay; other columns too, but input columns
    named `runs` or `collapsed` are replaced.
    """
    added = T.StructType([T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])
    kept = [c for c in df.columns if c not in added.fieldNames()]
    schema = T.StructType([*(df.schema[c] for c in kept), *added])
    run_type = pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64(), nullable=False) for n in RUN.fieldNames()]), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, _text_sizes(text)):
            runs, texts = _marked(batch.column(batch.schema.get_field_index(text)).to_pylist(), least)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs], dtype=np.int64)])
            flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
            values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type.value_type))
            out = _with(batch, "runs", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=run_type))
            yield _with(out, "collapsed", pa.array(texts, pa.string()))

    return map_batches(df, run, schema)


def strongest() -> Column:
    """Of `runs`, that of the greatest length in periods (ties: the first); null without runs."""
    better = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))
