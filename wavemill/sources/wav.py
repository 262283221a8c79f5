"""WAV files as a Spark data source (`spark.read.format("wav")`) and as a sink.

Headers are read by seeking over chunks; each file is cut into ranges of whole blocks,
so one long recording is read by many tasks. Paths must be on a file system that all
executors mount; other stores are for parquet tables of blocks.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import blocks
from ..operators.lineage import per_track, settle

HEADER = "track string, path string, sample_rate int, n_channels int, bit_depth int, audio_format int, n_frames bigint, duration_s double"
BLOCKS = "track string, channel int, block_idx bigint, offset bigint, sample_rate int, bit_depth int, samples array<float>"
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def parse_header(file, path: str) -> dict:
    """The format and where the data lie, of RIFF and RF64 files; anything else is an error."""
    magic, _, kind = struct.unpack("<4sI4s", file.read(12).ljust(12, b"\0"))
    if magic not in (b"RIFF", b"RF64") or kind != b"WAVE":
        raise ValueError(f"{path} is not a WAV file")
    found, long_size = None, None
    while len(head := file.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        at = file.tell()
        if name == b"ds64":
            long_size = struct.unpack("<QQ", file.read(16))[1]
        elif name == b"fmt ":
            body = file.read(size)
            form, channels, rate, _, align, bits = struct.unpack("<HHIIHH", body[:16])
            if form == EXTENSIBLE and len(body) >= 26:
                form = struct.unpack("<H", body[24:26])[0]
            found = {"audio_format": form, "n_channels": channels, "sample_rate": rate, "align": align, "bit_depth": bits}
        elif name == b"data":
            if found is None:
                raise ValueError(f"{path} has data before its format")
            size = long_size if size == 0xFFFFFFFF and long_size is not None else size
            size = min(size, os.path.getsize(path) - at)
            return found | {"data_at": at, "n_frames": size // found["align"]}
        file.seek(at + size + size % 2)
    raise ValueError(f"{path} has no data")


def decode_pcm(data: bytes, bits: int, form: int) -> np.ndarray:
    """Little-endian samples as float32 in [-1, 1); formats that aren't known are silent."""
    if form == FLOAT and bits in (32, 64):
        return np.frombuffer(data, f"<f{bits // 8}").astype(np.float32)
    if bits == 8:
        return ((np.frombuffer(data, np.uint8).astype(np.float32)) - 128) / 128
    if bits == 16:
        return np.frombuffer(data, "<i2").astype(np.float32) / 0x8000
    if bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(np.float32) / 0x800000
    if bits == 32:
        return (np.frombuffer(data, "<i4") / 0x80000000).astype(np.float32)
    return np.zeros(len(data) * 8 // bits, np.float32)


def encode_pcm(x: np.ndarray, bits: int, floating: bool = False) -> bytes:
    if floating:
        return x.astype("<f4").tobytes()
    top = 1 << (bits - 1)
    x = np.clip(x.astype(np.float64), -1, 1)
    whole = np.floor(x * np.where(x < 0, top, top - 1) + 0.5).astype(np.int64)
    if bits == 24:
        return np.ascontiguousarray(whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return whole.astype(f"<i{bits // 8}").tobytes()


class _Part(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options):
        path = options["path"]
        self.paths = sorted(glob.glob(os.path.join(path, "*.wav")) if os.path.isdir(path) else glob.glob(path))
        self.mode, self.size = options.get("mode", "blocks"), int(options.get("blockframes", blocks.BLOCK))
        self.per_part = int(options.get("blocksperpartition", 64))
        self.channels = [int(c) for c in options["channels"].split(",")] if options.get("channels") else None
        self.base = os.path.commonpath([os.path.dirname(p) for p in self.paths]) if self.paths else ""

    def partitions(self):
        """By sizes from the listing alone: a part's frames are known where its task reads the header."""
        out = []
        for path in self.paths:
            # a frame has a byte at least; parts behind the last frame have nothing to read
            count = 1 if self.mode == "header" else max(1, -(-os.path.getsize(path) // (self.size * self.per_part)))
            out += [_Part(path, i) for i in range(count)]
        return out

    def track(self, path):
        """The file's path under what all have in common, so that files of one name in two folders are two tracks."""
        return os.path.relpath(path, self.base).removesuffix(".wav")

    def read(self, part):
        with open(part.path, "rb") as file:
            head, track = parse_header(file, part.path), self.track(part.path)
        if self.mode == "header":
            yield (track, part.path, head["sample_rate"], head["n_channels"], head["bit_depth"], head["audio_format"], head["n_frames"], head["n_frames"] / head["sample_rate"])
            return
        with open(part.path, "rb") as file:
            for block in range(part.number * self.per_part, (part.number + 1) * self.per_part):
                at = block * self.size
                n = min(self.size, head["n_frames"] - at)
                if n <= 0:
                    return
                file.seek(head["data_at"] + at * head["align"])
                x = decode_pcm(file.read(n * head["align"]), head["bit_depth"], head["audio_format"]).reshape(-1, head["n_channels"])
                wanted = range(head["n_channels"]) if self.channels is None else self.channels
                for channel, source in enumerate(wanted):
                    values = x[:, source] if source < head["n_channels"] else np.zeros(len(x), np.float32)
                    yield self._batch(track, channel, block, at, head, values)

    @staticmethod
    def _batch(track, channel, block, at, head, values):
        """One row as an Arrow batch, so that samples don't become Python numbers."""
        one = [[track], [channel], [block], [at], [head["sample_rate"]], [head["bit_depth"]]]
        samples = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(np.ascontiguousarray(values, np.float32), pa.float32()))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(one, kinds)), samples], names=[f.split()[0] for f in BLOCKS.split(", ")])


class WavDataSource(DataSource):
    """Options: path (a directory or pattern), mode (blocks or header), blockFrames, blocksPerPartition, and
    channels (source channels, as 1,0; those that a file lacks are silent; none: all of them)."""

    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return HEADER if self.options.get("mode") == "header" else BLOCKS

    def reader(self, schema):
        return _Reader(self.options)


def header(n_frames: int, channels: int, rate: int, bits: int, floating: bool) -> bytes:
    """80 bytes with room for the 64-bit sizes, which are used beyond 4 GiB."""
    align = channels * bits // 8
    size = n_frames * align
    large = size + 72 > 0xFFFFFFFF
    spare = struct.pack("<4sIQQQI", b"ds64", 28, size + 72, size, n_frames, 0) if large else struct.pack("<4sI28x", b"JUNK", 28)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, FLOAT if floating else PCM, channels, rate, rate * align, align, bits)
    top = struct.pack("<4sI4s", b"RF64" if large else b"RIFF", 0xFFFFFFFF if large else size + 72, b"WAVE")
    return top + spare + form + struct.pack("<4sI", b"data", 0xFFFFFFFF if large else size)


def file_name(path: str, track: object) -> str:
    parts = str(track).split("/")
    if ".." in parts or not parts[-1]:
        raise ValueError(f"not a file's name: {track}")
    return os.path.join(path, *parts) + ".wav"


def write(df: DataFrame, path: str, rate: int, bits: int = 16, floating: bool = False) -> DataFrame:
    """Writes each track's blocks to path/track.wav, in the order of their offsets; returns (track, path, n_frames).

    The files are written when the result is used. A track's name may have folders, never ..;
    each attempt of a task writes a file of its own first and puts it in place whole, and
    takes it away if it fails.
    """
    bits = 32 if floating else bits
    rows = blocks.interleave(df).select("track", "offset", "n_channels", "samples").repartition("track").sortWithinPartitions("track", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, track, target, frames, channels = None, None, "", 0, 0
        done: list[tuple[str, str, int]] = []

        def close() -> None:
            if file is None:
                return
            file.seek(0)
            file.write(header(frames, channels, rate, bits, floating))
            file.close()
            os.replace(file.name, target)
            done.append((str(track), target, frames))

        try:
            for batch in batches:
                for name, _, n, samples in zip(*(batch.column(i) for i in range(4))):
                    if file is None or name.as_py() != track:
                        close()
                        track, frames, channels = name.as_py(), 0, n.as_py()
                        target = file_name(path, track)
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        file = open(os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{uuid.uuid4().hex}"), "wb")
                        file.write(bytes(80))
                    x = samples.values.to_numpy(zero_copy_only=False)
                    file.write(encode_pcm(x, bits, floating))
                    frames += len(x) // channels
            close()
        except BaseException:
            if file is not None and os.path.exists(file.name):
                os.unlink(file.name)
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["track", "path", "n_frames"])

    return rows.mapInArrow(run, "track string, path string, n_frames long")


def write_parallel(df: DataFrame, path: str, rate: int, bits: int = 16, floating: bool = False) -> DataFrame:
    """Writes the files that `write` writes, each by many tasks; returns (track, path, n_frames, n_tasks).

    Sizes are counted first and every file is made at its full length under a hidden name that
    all tasks know. Then each block goes to its own place in its file, wherever the block lies, so
    that an attempt that runs again, or beside another, puts the same bytes in the same place. Where
    all frames are there, the header is written and the file gets its name; else the hidden files go.
    The files are there when this returns. Blocks without samples are nothing; channels of unlike
    length, gaps, overlaps and repeated blocks are errors, before anything is written. An empty table
    gives no files.
    """
    bits = 32 if floating else bits
    job, end = uuid.uuid4().hex, F.col("offset") + F.size("samples")
    df = df.filter(F.size("samples") > 0)
    lengths = df.groupBy("track", "channel").agg(F.max(end).alias("n_frames"), F.sum(F.size("samples").cast("long")).alias("given"))
    of_tracks = lengths.groupBy("track").agg(F.max("n_frames").alias("n_frames"), F.count(F.lit(1)).cast("int").alias("n_channels"), F.bool_and(F.col("given") == F.col("n_frames")).alias("dense"), F.min("n_frames").alias("shortest"))
    tracks = settle(of_tracks)
    unnamed = tracks.filter(F.col("track").cast("string").rlike(r"(^|/)\.\.(/|$)|(^|/)$")).first()
    if unnamed:
        raise ValueError(f"not a file's name: {unnamed.track}")
    uneven = tracks.filter("not dense or shortest <> n_frames").first()
    # with the sums right, blocks that all begin where another ends neither overlap nor leave gaps
    ends = df.select("track", "channel", end.alias("offset"))
    loose = df.select("track", "channel", "offset").filter("offset <> 0").join(ends, ["track", "channel", "offset"], "left_anti").first()
    if uneven or loose:
        raise ValueError(f"blocks of {(uneven or loose).track} don't follow one another")
    tracks = tracks.select("track", "n_frames", "n_channels")

    def hidden(track: object) -> str:
        target = file_name(path, track)
        return os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{job}")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                os.makedirs(os.path.dirname(hidden(r["track"])), exist_ok=True)
                with open(hidden(r["track"]), "ab") as file:
                    file.truncate(80 + r["n_frames"] * r["n_channels"] * bits // 8)
            yield batch.select(["track"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            names, frames = batch.column(0).to_pylist(), []
            for track, offset, n, samples in zip(names, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                x = samples.values.to_numpy(zero_copy_only=False)
                with open(hidden(track), "r+b") as file:
                    file.seek(80 + offset * n * bits // 8)
                    file.write(encode_pcm(x, bits, floating))
                frames.append(len(x) // n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.int64()), pa.array([task] * len(frames), pa.int64())], names=["track", "frames", "task"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["done"] != r["n_frames"]:
                    raise ValueError(f"{r['done']} of {r['n_frames']} frames of {r['track']} were written")
                source, target = hidden(r["track"]), file_name(path, r["track"])
                if os.path.exists(source):  # else an earlier attempt of this task has named it
                    with open(source, "r+b") as file:
                        file.write(header(r["n_frames"], r["n_channels"], rate, bits, floating))
                    os.replace(source, target)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([file_name(path, r["track"]) for r in rows], pa.string()), pa.array([r["n_frames"] for r in rows], pa.int64()), pa.array([r["n_tasks"] for r in rows], pa.int64())], names=["track", "path", "n_frames", "n_tasks"])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for track in batch.column(0).to_pylist():
                if os.path.exists(hidden(track)):
                    os.unlink(hidden(track))
            yield batch.select(["track"])

    kind = f"track {dict(df.dtypes)['track']}"
    try:
        settle(tracks.mapInArrow(made, kind))
        whole = per_track(blocks.interleave(df), tracks.select("track", F.col("n_channels").alias("_n")), place="offset").filter("n_channels = _n")
        parts = settle(whole.select("track", "offset", "n_channels", "samples").mapInArrow(placed, f"{kind}, frames long, task long"))
        done = parts.groupBy("track").agg(F.sum("frames").alias("done"), F.countDistinct("task").alias("n_tasks"))
        ready = tracks.join(done, "track", "left").select("track", "n_frames", "n_channels", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"))
        return settle(ready.mapInArrow(named, f"{kind}, path string, n_frames long, n_tasks long"))
    except BaseException:
        tracks.mapInArrow(removed, kind).count()
        raise
