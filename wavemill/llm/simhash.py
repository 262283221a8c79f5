"""SimHash near-duplicates: exact comparison by tiles, then connected components.

Distinct fingerprints are dealt into tiles by the population counts of their parts
(four words of 16 bits, or more and smaller parts for larger corpora). Fingerprints
that differ in at most `radius` bits lie in tiles whose counts differ by no more in
sum, so only such pairs of tiles are compared, whole, with exclusive-or and bit
counts. Of the links found, each comparison emits a spanning forest, which keeps the
components and holds no more rows than fingerprints, however dense a group is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, salted, word_chunks

#: A tile with more fingerprints is cut into blocks of this many, compared two by two.
TILE_ROWS = 32_768


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes of the shingles; 0 without words."""
    counts, n, carry = np.zeros(64, np.int64), 0, []
    for words in word_chunks(text.lower()):
        words = carry + words
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(seed)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n, carry = n + len(hashes), words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carry), seed) if carry else 0
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the SimHash of the whole text as a long (its 64 bits, signed); a null text counts as empty.

    A column named like `out` is replaced; other columns and repeated rows stay.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            values = np.fromiter((simhash(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in column), np.uint64, len(column))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(values.view(np.int64))], names=[*kept, out])

    return df.mapInArrow(run, schema)


def _steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """All vectors of whole numbers whose absolute values sum up to 1..radius, one of each opposite pair."""
    out = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if len(head) == parts:
            if any(head) and head > tuple(-x for x in head):
                out.append(head)
            return
        for x in range(-left, left + 1):
            extend((*head, x), left - abs(x))

    extend((), radius)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as those given, at most one for each node: node, smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


def close_pairs(ours: np.ndarray, theirs: np.ndarray | None, radius: int, rows: int = 512, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius, between two arrays or (None) inside one."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    other = ours if theirs is None else theirs
    for i in range(0, len(ours), rows):
        links = []
        for j in range(0 if theirs is not None else i, len(other), columns):
            near = np.bitwise_count(ours[i : i + rows, None] ^ other[None, j : j + columns]) <= radius
            x, y = np.nonzero(near)
            if theirs is None:
                apart = x + i < y + j
                x, y = x[apart], y[apart]
            if len(x):
                links.append(_forest(ours[i : i + rows][x], other[j : j + columns][y]))
        if links:
            found.append(_forest(*(np.concatenate(side) for side in zip(*links))))
    if not found:
        return np.empty(0, ours.dtype), np.empty(0, ours.dtype)
    return tuple(np.concatenate(side) for side in zip(*found))


def links(nodes: DataFrame, radius: int = 2, parts: int = 4, fp: str = "fp") -> DataFrame:
    """Links (a, b) between the distinct fingerprints in `nodes` with the components of all links.

    parts 4 deals 1e8 fingerprints into tiles of at most 150,000; with 8 or 16 parts
    the tiles are finer and more of them are visited, for 1e10 and more.
    """
    width, base = 64 // parts, {4: 5, 8: 4, 16: 3}[parts]
    mask = (1 << width) - 1
    count = lambda i: F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask))).cast("long")
    tile = sum((F.shiftleft(count(i), base * i) for i in range(1, parts)), count(0))
    tiled = nodes.select(F.col(fp).alias("fp"), tile.alias("tile"))
    packed = [sum(x << (base * i) for i, x in enumerate(reversed(step))) for step in _steps(parts, radius)]
    # at most one row for each TILE_ROWS fingerprints, so small enough to broadcast at any size
    large = tiled.groupBy("tile").count().filter(F.col("count") > TILE_ROWS).select("tile", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("blocks"))
    own = tiled.join(F.broadcast(large), "tile", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("home", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    own = own.select("fp", "tile", F.explode(F.sequence("home", F.col("blocks") - 1)).alias("block"), "home")
    own = own.select("fp", "tile", "block", (F.col("home") == F.col("block")).alias("home"))
    away = tiled.select("fp", "tile", F.explode(F.array(*[F.lit(x).cast("long") for x in packed])).alias("step"))
    away = away.select("fp", (F.col("tile") + F.col("step")).alias("tile")).join(F.broadcast(large), "tile", "left")
    away = away.select("fp", "tile", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), F.lit(False).alias("home"))
    dealt = own.unionByName(away).repartition("tile", "block").sortWithinPartitions("tile", "block", F.col("home").desc())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes = None, np.empty(0, np.uint64)
        for batch in batches:
            columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            fps, tiles, blocks, home = columns["fp"].view(np.uint64), columns["tile"], columns["block"], columns["home"]
            if not len(fps):
                continue
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(blocks) != 0) | (np.diff(home.astype(np.int8)) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
                if key != (tiles[start], blocks[start]):
                    key, homes = (tiles[start], blocks[start]), np.empty(0, np.uint64)
                part = fps[start:stop]
                made = [close_pairs(part, homes, radius)] if len(homes) else []
                if home[start]:
                    made.append(close_pairs(part, None, radius))
                    homes = np.concatenate([homes, part])
                for a, b in made:
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): the smallest node that can be reached.

    Large-star and small-star steps in turns, each a keyed minimum and a join back,
    until the edges stay the same; each round is written to the checkpoint folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs, seen = cut_lineage(pairs), None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        seen = state
        both = pairs.union(pairs.select("v", "u"))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        stars = both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = stars.groupBy("u").agg(F.min("v").alias("low"))
        joined = stars.join(lows, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("_")).select("_.*")
        pairs = cut_lineage(small.filter("u <> v").distinct())


def groups(marked: DataFrame, radius: int = 2, parts: int = 4, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Adds component_id: the smallest doc_id reachable over links of at most `radius` differing bits.

    `marked` has a fingerprint (long) for each row and is read several times: pass
    rows that are cheap to read again, such as a written table. Rows with a null
    doc_id take part; the id of a component without any doc_id is null. Equal
    fingerprints are one node, so groups of exact copies cost nothing. Columns
    named component_id are replaced; repeated rows stay.
    """
    names = [c for c in marked.columns if c != "component_id"]
    rows = marked.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("in"), F.col(fingerprint).alias("fp"))
    nodes = cut_lineage(marked.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(doc_id).alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(cut_lineage(links(nodes, radius, parts)))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    linked = linked.join(lowest, "root").select("fp", "lowest")
    ids = cut_lineage(nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("lowest", "low").alias("component_id")))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")  # which task a row goes to makes no difference
    return salted(rows, ids, ["fp"], spread).select("in.*", "component_id")


def hexadecimal(fingerprint: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
