"""What one microphone hears of the others' speakers: activity, adaptive filters, masks.

A session has microphones; each target is heard beside its references. `frames` lays a
target's spectra and those of its references side by side, a row for each frame. What needs
a bounded past only (activity) is done in spans of frames with a halo; what is recursive is
done by ordered scans that carry some numbers for each bin from batch to batch: the filters
in ranges of bins, so that one target is dealt to several tasks, the mask, whose decisions
look at the whole spectrum, one target at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import per_track

KEY = ["session", "target"]

#: Of the activity detector: smoothing of powers, over-estimation of noise, share of bins and of bands, thresholds (fixed values, published with the method).
SMOOTHING, OVER, BANDS, LEAST_SNR, BAND_WEIGHT, LEAST_SCORE = 0.5, 4.0, 10, 0.25, 0.1, 0.2
#: Of the noise floor by minimum statistics: frames of a part, parts looked back on, correction of the minimum's bias (fixed values).
PART, PARTS, BIAS = 12, 8, 2.0
#: Of the mask: weight of the frame where it stands out; else of the frame and of the last output; boost of high bins and its exponent (fixed values).
STANDING, FRESH, LAST, BOOST, EXPONENT = 0.2, 0.25, 0.15, 200.0, 2.0
#: Frames of a span, bins of a range.
SPAN, WIDTH = 256, 64


def frames(spectra: DataFrame, session: DataFrame) -> DataFrame:
    """(session, target, stft_frame, re, im, mics, refs): each target's frames with those of its references.

    session: (session, track, role), role target or reference; first channels are taken. mics
    names the references in order, refs has (track, re, im) of those that have the frame. A
    target without references is left out.
    """
    mono = spectra.filter("channel = 0").select("track", "stft_frame", "re", "im")
    role = lambda name, to: session.filter(F.col("role") == name).select("session", F.col("track").alias(to))
    pairs = role("target", "target").join(role("reference", "reference"), "session")
    mics = pairs.groupBy(*KEY).agg(F.array_sort(F.collect_set("reference")).alias("mics"))
    ours = per_track(mono, mics.withColumnRenamed("target", "track"), place="stft_frame").withColumnRenamed("track", "target")
    heard = per_track(mono, pairs.withColumnRenamed("reference", "track"), place="stft_frame")
    refs = heard.groupBy(*KEY, "stft_frame").agg(F.array_sort(F.collect_list(F.struct("track", "re", "im"))).alias("refs"))
    joined = ours.join(refs, [*KEY, "stft_frame"], "left")
    return joined.select(*KEY, "stft_frame", "re", "im", "mics", F.coalesce("refs", F.array().cast(dict(refs.dtypes)["refs"])).alias("refs"))


def _rows(lists: pa.Array) -> np.ndarray:
    """A list column of one length as the rows of an array."""
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)


def _references(mics: list, refs: pa.Array, width: int) -> np.ndarray:
    """(frame, reference, bin) of complex values; zeros where a reference has no frame."""
    out = np.zeros((len(refs), len(mics), width), complex)
    flat = refs.flatten()
    if len(flat):
        owner = np.repeat(np.arange(len(refs)), refs.value_lengths().to_numpy(zero_copy_only=False))
        place = {m: i for i, m in enumerate(mics)}
        at = np.array([place[m] for m in flat.field("track").to_pylist()])
        out[owner, at] = _rows(flat.field("re")) + 1j * _rows(flat.field("im"))
    return out


def smoothed(power: np.ndarray, share: float) -> np.ndarray:
    """First-order smoothing over frames that begins with zero; share: of the frame before."""
    out, last = np.empty_like(power), np.zeros(power.shape[1:])
    for t in range(len(power)):
        last = share * last + (1 - share) * power[t]
        out[t] = last
    return out


def noise_floor(power: np.ndarray, first: int) -> np.ndarray:
    """BIAS times the least smoothed power of the running part and the PARTS whole ones before it; the
    first row is frame `first`."""
    number = (np.arange(len(power)) + first) // PART
    part, parts = np.empty_like(power), {}
    for k in range(number[0], number[-1] + 1):
        own = np.flatnonzero(number == k)
        part[own] = np.minimum.accumulate(power[own], axis=0)
        parts[k] = part[own[-1]]
    out = np.empty_like(power)
    for t in range(len(power)):
        k, ends = number[t], (t + first + 1) % PART == 0
        before = [parts[j] for j in range(k - PARTS + ends, k) if j in parts]
        out[t] = np.minimum.reduce([part[t], *before])
    return BIAS * out


def _reach(share: float) -> int:
    """Frames after which a first-order recursion has forgotten its past, to the last bit of a double."""
    return math.ceil(math.log(1e-17) / math.log(share)) if share > 0 else 0


def scores(power: np.ndarray, first: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """(frame, microphone): how surely its own speaker is heard, from (frame, microphone, bin) of powers.

    The share of bins where it stands out from the others and from its noise, times its best band.
    """
    smooth = smoothed(power, smoothing)
    noise = noise_floor(smooth, first)
    clean = np.maximum(smooth - noise, 0)
    loudest = (clean.argmax(axis=1)[:, None] == np.arange(power.shape[1])[:, None]) & (clean.max(axis=1) > 0)[:, None]
    over = OVER * noise
    ratio = np.divide(np.maximum(np.minimum(power - over, smooth), 0), over, out=np.zeros_like(power), where=over > 0)
    share = (loudest & (ratio >= LEAST_SNR)).mean(axis=2)
    bins = power.shape[2]
    edges = [k * (bins // BANDS) for k in range(BANDS)] + [bins]
    bands = [ratio[:, :, a:b].mean(axis=2) for a, b in zip(edges, edges[1:]) if b > a]
    return np.minimum(BAND_WEIGHT * np.maximum.reduce(bands), 1) * share


def activity(rows: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """(session, target, stft_frame, scores, active) of what frames() returns: of the target, then its references.

    A span of SPAN frames is a group, with as many frames before it as the noise floor and the
    smoothing look back on.
    """
    halo = PART * (PARTS + 1) + _reach(smoothing)
    span = lambda f: F.floor(f / SPAN)
    dealt = rows.withColumn("span", F.explode(F.sequence(span(F.col("stft_frame")), span(F.col("stft_frame") + halo))))
    kinds = dict(rows.dtypes)
    out_type = pa.schema([("stft_frame", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("stft_frame").combine_chunks()
        at = table.column("stft_frame").to_numpy()
        own = at >= key[2].as_py() * SPAN
        if not own.any():
            return pa.table({c: pa.array([], table.schema.field(c).type) for c in KEY} | {f.name: pa.array([], f.type) for f in out_type})
        value = lambda c: table.column(c).chunk(0)
        x = _rows(value("re")) + 1j * _rows(value("im"))
        every = np.concatenate([x[:, None], _references(value("mics")[0].as_py(), value("refs"), x.shape[1])], axis=1)
        # frames that are missing in between are silent
        power = np.zeros((at[-1] - at[0] + 1, *every.shape[1:]))
        power[at - at[0]] = every.real**2 + every.imag**2
        found = scores(power, int(at[0]), smoothing)[at - at[0]][own]
        kept = table.filter(pa.array(own))
        return pa.table({c: kept.column(c) for c in KEY} | {"stft_frame": pa.array(at[own], pa.int64()), "scores": pa.array(list(found), pa.list_(pa.float64()))})

    schema = f"session {kinds['session']}, target {kinds['target']}, stft_frame long, scores array<double>"
    out = dealt.groupBy(*KEY, "span").applyInArrow(run, schema)
    return out.withColumn("active", F.transform("scores", lambda s: s > LEAST_SCORE))


class Adaptive:
    """Filters of one target in a range of bins: for each reference and bin a complex gain that wanders
    slowly, tracked by a Kalman filter; corrected only while the target's own speaker is silent."""

    def __init__(self, gains: np.ndarray, forgetting: float, smoothing: float, hop_share: float, pause: int):
        self.h, self.p, self.noise = gains.astype(complex), np.ones(gains.shape), np.ones(gains.shape)
        self.kept, self.silent = (self.h, self.p), np.zeros(len(gains), np.int64)
        self.known = np.zeros(len(gains), bool)
        self.forgetting, self.smoothing, self.hop_share, self.pause = forgetting, smoothing, hop_share, pause

    def step(self, x: np.ndarray, y: np.ndarray, active: Sequence[bool]) -> np.ndarray:
        """The bleed in the frame x, as foreseen from the references' frames y."""
        square = self.forgetting**2
        drift = (1 - square) * (self.h.real**2 + self.h.imag**2 + self.p)
        self.h, self.p = self.forgetting * self.h, square * self.p + drift
        bleed = (self.h * y).sum(axis=0)
        if not active[0]:
            e, loud = x - bleed, y.real**2 + y.imag**2
            self.noise = self.smoothing * self.noise + (1 - self.smoothing) * (e.real**2 + e.imag**2 + self.hop_share * loud * self.p)
            gain = self.p / (self.noise + 1e-30)
            self.h = self.h + gain * y.conj() * e
            self.p = np.maximum(1 - gain * loud, 0) * self.p
        # a reference that speaks again after a pause goes on as it was when it last spoke
        speaks = np.asarray(active[1:], bool)
        back = speaks & (self.silent >= self.pause) & self.known
        keep = speaks & ~back
        self.h, self.p = np.where(back[:, None], self.kept[0], self.h), np.where(back[:, None], self.kept[1], self.p)
        self.kept = np.where(keep[:, None], self.h, self.kept[0]), np.where(keep[:, None], self.p, self.kept[1])
        self.known |= keep
        self.silent = np.where(speaks, 0, self.silent + 1)
        return bleed


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of a sorted batch that have the same key."""
    keys = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], batch.slice(start, i - start)
            start = i


def adaptive_bleed(rows: DataFrame, active: DataFrame, seeds: DataFrame, forgetting: float = 0.998, smoothing: float = 0.5, hop_share: float = 0.25, pause: int = 24, width: int = WIDTH) -> DataFrame:
    """(session, target, range, stft_frame, re, im, bleed_re, bleed_im), `width` bins a range: the target and the bleed in it.

    rows: from frames(); active: (session, target, stft_frame, active); seeds: (session, target,
    reference, bin, h_re, h_im), first gains, zero where there are none. A task has some
    ranges of bins of some targets and reads their frames in order, once.
    """
    cut = lambda c, r: F.slice(c, r * width + 1, F.lit(width))
    dealt = rows.join(active.select(*KEY, "stft_frame", "active"), [*KEY, "stft_frame"])
    dealt = dealt.withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.size("re") - 1) / width).cast("int"))))
    r = F.col("range")
    dealt = dealt.select(*KEY, "range", "stft_frame", cut("re", r).alias("re"), cut("im", r).alias("im"), "mics", F.transform("refs", lambda x: F.struct(x["track"].alias("track"), cut(x["re"], r).alias("re"), cut(x["im"], r).alias("im"))).alias("refs"), "active")
    mine = seeds.select(*KEY, "reference", F.floor(F.col("bin") / width).cast("int").alias("range"), "bin", "h_re", "h_im")
    mine = mine.groupBy(*KEY, "range", "reference").agg(F.array_sort(F.collect_list(F.struct("bin", "h_re", "h_im"))).alias("h"))
    mine = mine.groupBy(*KEY, "range").agg(F.collect_list(F.struct(F.col("reference").alias("track"), F.col("h.bin").alias("bin"), F.col("h.h_re").alias("re"), F.col("h.h_im").alias("im"))).alias("seeds"))
    first = mine.select(*KEY, "range", F.lit(-1).cast("long").alias("stft_frame"), "seeds")
    both = dealt.unionByName(first, allowMissingColumns=True)
    kinds = dict(rows.dtypes)
    schema = f"session {kinds['session']}, target {kinds['target']}, range int, stft_frame long, re array<double>, im array<double>, bleed_re array<double>, bleed_im array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, seed = None, None, []
        for batch in batches:
            for key, part in _runs(batch, [*KEY, "range"]):
                if key != current:
                    current, machine, seed = key, None, []
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                if column("stft_frame")[0].as_py() < 0:
                    seed = column("seeds")[0].as_py()
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                x = _rows(column("re")) + 1j * _rows(column("im"))
                mics = column("mics")[0].as_py()
                y = _references(mics, column("refs"), x.shape[1])
                if machine is None:
                    gains = np.zeros(y.shape[1:], complex)
                    for s in seed:
                        if s["track"] in mics:
                            gains[mics.index(s["track"]), np.array(s["bin"]) - key[2] * width] = np.array(s["re"]) + 1j * np.array(s["im"])
                    machine = Adaptive(gains, forgetting, smoothing, hop_share, pause)
                out = [machine.step(*now) for now in zip(x, y, column("active").to_pylist())]
                same = [column(c) for c in (*KEY, "range", "stft_frame", "re", "im")]
                yield pa.RecordBatch.from_arrays([*same, pa.array([o.real for o in out], pa.list_(pa.float64())), pa.array([o.imag for o in out], pa.list_(pa.float64()))], names=[*KEY, "range", "stft_frame", "re", "im", "bleed_re", "bleed_im"])

    return both.repartition(*KEY, "range").sortWithinPartitions(*KEY, "range", "stft_frame").mapInArrow(run, schema)


class Wiener:
    """Masks of one target: what share of each bin isn't bleed, with the last output as a guide."""

    def __init__(self, bins: int, strength: float, smoothing: float):
        self.bleed, self.output, self.smoothing = np.zeros(bins), np.zeros(bins), smoothing
        self.weight = strength * (1 + BOOST * (np.arange(bins) / max(1, bins - 1)) ** EXPONENT)

    def step(self, x: np.ndarray, bleed: np.ndarray) -> np.ndarray:
        self.bleed = self.smoothing * self.bleed + (1 - self.smoothing) * (bleed.real**2 + bleed.imag**2)
        rest = x - bleed
        fresh = rest.real**2 + rest.imag**2
        stands = (fresh >= fresh.mean()) & (self.output >= self.output.mean())
        speech = np.where(stands, STANDING * fresh, FRESH * fresh + LAST * self.output)
        mask = np.clip(speech / (speech + self.weight * self.bleed + 1e-10), 0, 1)
        self.output = mask**2 * (x.real**2 + x.imag**2)
        return mask


def wiener_masks(rows: DataFrame, strength: float = 25.0, smoothing: float = 0.5) -> DataFrame:
    """(session, target, stft_frame, mask) from what adaptive_bleed returns; a target's frames go through one task in order."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine = None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []  # ranges of the frame that is being read
        frame = None
        out: list[tuple] = []

        def close() -> None:
            nonlocal machine
            if held:
                x, d = (np.concatenate(parts) for parts in zip(*held))
                machine = machine or Wiener(len(x), strength, smoothing)
                out.append((*current, frame, machine.step(x, d)))
                held.clear()

        def passed() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], types[0]), pa.array(columns[1], types[1]), pa.array(columns[2], pa.int64()), pa.array(list(columns[3]), pa.list_(pa.float64()))], names=[*KEY, "stft_frame", "mask"])

        for batch in batches:
            types = batch.schema.field(0).type, batch.schema.field(1).type
            for session, target, at, *values in zip(*(batch.column(batch.schema.get_field_index(c)) for c in (*KEY, "stft_frame", "re", "im", "bleed_re", "bleed_im"))):
                key, at = (session.as_py(), target.as_py()), at.as_py()
                if key != current or at != frame:
                    close()
                if key != current:
                    current, machine = key, None
                frame = at
                re, im, b_re, b_im = (v.values.to_numpy(zero_copy_only=False) for v in values)
                held.append((re + 1j * im, b_re + 1j * b_im))
            if len(out) >= 256:
                yield passed()
        close()
        if out:
            yield passed()

    schema = f"session {kinds['session']}, target {kinds['target']}, stft_frame long, mask array<double>"
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "stft_frame", "range").mapInArrow(run, schema)


def in_spans(masks: DataFrame, fn: Callable[[dict[str, np.ndarray], int, int], np.ndarray], columns: Sequence[str], before: int, behind: int, out: str, span: int = 64) -> DataFrame:
    """Adds fn(columns as (frame, bin), first own row, rows of its own) in spans of `span` frames, with up to
    so many frames before and behind; fewer only where the target begins or ends."""
    kinds = dict(masks.dtypes)
    at = F.col("stft_frame")
    spans = F.sequence(F.floor(F.greatest(at - behind, F.lit(0)) / span), F.floor((at + before) / span))
    dealt = masks.withColumn("span", F.explode(spans))
    schema = ", ".join(f"{c} {kinds[c]}" for c in masks.columns if c != out) + f", {out} array<double>"
    names = [c for c in masks.columns if c != out]
    plain = lambda c: c.cast(pa.list_(pa.float64())) if pa.types.is_list(c.type) else c

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("stft_frame").combine_chunks()
        number = table.column("stft_frame").to_numpy()
        own = np.flatnonzero(number // span == key[2].as_py())
        kept = table.take(pa.array(own))
        made = fn({c: _rows(table.column(c).chunk(0)) for c in columns}, int(own[0]), len(own)) if len(own) else []
        return pa.table({n: plain(kept.column(n)) for n in names} | {out: pa.array(list(made), pa.list_(pa.float64()))})

    return dealt.groupBy(*KEY, "span").applyInArrow(run, schema)


def nlm_tiles(mask: np.ndarray, first: int, count: int, threshold: float, patch: int = 8, tile: int = 8, bins: int = 8, past: int = 16, ahead: int = 4) -> np.ndarray:
    """Rows first to first + count of a mask, each tile the mean of the values around its middle,
    weighted by how alike the patches around them are."""
    n, width, half = *mask.shape, patch // 2
    # a patch at (f, b) begins half a patch before it; beyond the ends, the last value goes on
    padded = np.pad(mask, ((half, half - 1), (half, half - 1)), mode="edge")
    patches = np.lib.stride_tricks.sliding_window_view(padded, (patch, patch))
    f0, b0 = np.meshgrid(np.arange(first, first + count, tile) + tile // 2, np.arange(0, width, tile) + tile // 2, indexing="ij")
    f0, b0 = f0.ravel(), b0.ravel()
    rows, columns = f0[:, None] + np.arange(-half, half), b0[:, None] + np.arange(-half, half)
    centres = mask[np.clip(rows, 0, n - 1)[:, :, None], np.clip(columns, 0, width - 1)[:, None, :]]
    weights, sums = np.zeros(len(f0)), np.zeros(len(f0))
    for df in range(-past, ahead + 1):
        for db in range(-bins, bins + 1):
            f, b = np.clip(f0 + df, 0, n - 1), np.clip(b0 + db, 0, width - 1)
            w = np.exp(-((centres - patches[f, b]) ** 2).sum(axis=(1, 2)) / threshold**2)
            weights += w
            sums += w * mask[f, b]
    middle = mask[np.minimum(f0, n - 1), np.minimum(b0, width - 1)]
    out = np.clip(np.divide(sums, weights, out=middle.copy(), where=weights > 0), 0, 1)
    tiles = out.reshape(-1, -(-width // tile))
    return np.repeat(np.repeat(tiles, tile, axis=0), tile, axis=1)[:count, :width]


def smooth_nlm(masks: DataFrame, threshold: float, patch: int = 8, tile: int = 8, bins: int = 8, past: int = 16, ahead: int = 4, mask: str = "mask", out: str = "smooth") -> DataFrame:
    """Adds the mask smoothed by non-local means in tiles of `tile` frames and bins; threshold 0: as it is."""
    if not threshold:
        return masks.withColumn(out, F.col(mask))
    span = tile * max(1, 64 // tile)
    fn = lambda x, first, count: nlm_tiles(x[mask], first, count, threshold, patch, tile, bins, past, ahead)
    middle, half = tile // 2, patch // 2
    return in_spans(masks, fn, [mask], max(0, past + half - middle), max(0, middle + ahead + half - tile), out, span)


def dftt_rows(raw: np.ndarray, guide: np.ndarray, first: int, count: int, threshold: float, frames: int, bins: int, hop_frames: int, hop_bins: int) -> np.ndarray:
    """Rows first to first + count of `raw`, filtered in overlapping windows of its two-dimensional
    transform: each coefficient by how far the guide's stands over the threshold."""
    n, width = raw.shape
    hann = lambda size: 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / max(1, size - 1))
    window = np.outer(hann(frames), hann(bins))
    # spans and what is before them are multiples of the hop, so rows are numbered as frames are
    starts = [f for f in range(0, first + count, hop_frames) if f + frames > first]
    f, b = np.array(starts), np.arange(0, width, hop_bins)
    rows = np.minimum(f[:, None] + np.arange(frames), n - 1)[:, None, :, None]
    columns = np.minimum(b[:, None] + np.arange(bins), width - 1)[None, :, None, :]
    spectrum, known = np.fft.rfft2(raw[rows, columns] * window), np.abs(np.fft.rfft2(guide[rows, columns] * window)) ** 2
    back = np.fft.irfft2(spectrum * known / (known + threshold**2), s=(frames, bins)) * window
    total, weight = np.zeros((n + frames, width + bins)), np.zeros((n + frames, width + bins))
    for i, at in enumerate(f):
        for k, bin_ in enumerate(b):
            total[at : at + frames, bin_ : bin_ + bins] += back[i, k]
            weight[at : at + frames, bin_ : bin_ + bins] += window**2
    own = slice(first, first + count)
    total, weight, plain = total[own, :width], weight[own, :width], raw[own]
    return np.where(weight > 1e-8, np.clip(total / np.maximum(weight, 1e-8), 0, 1), plain)


def smooth_dftt(masks: DataFrame, threshold: float, frames: int = 16, bins: int = 32, hop_frames: int = 4, hop_bins: int = 8, mask: str = "mask", guide: str = "smooth", out: str = "final") -> DataFrame:
    """Adds the mask smoothed in windows of `frames` and `bins` of its two-dimensional transform, guided by
    a smoother one; threshold 0: as it is."""
    if not threshold:
        return masks.withColumn(out, F.col(mask))
    span = hop_frames * max(1, 64 // hop_frames)
    # windows begin at multiples of the hop, the earliest so many frames before the span
    before = -(-(frames - 1) // hop_frames) * hop_frames
    fn = lambda x, first, count: dftt_rows(x[mask], x[guide], first, count, threshold, frames, bins, hop_frames, hop_bins)
    return in_spans(masks, fn, [mask, guide], before, frames - 1, out, span)
