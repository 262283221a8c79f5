"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every shingle of five words is hashed once: the upper bits of the hash choose a bin,
whose smallest value counts. An empty bin borrows from the bin to which its own
sequence of hashes first leads and which isn't empty, so that two equal sets borrow
alike. Only the low bits of each value are stored; the likeness of two fingerprints
is corrected for bins that agree in these bits by chance.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACE

BINS, BITS, SHINGLE = 512, 4, 5
#: Odd multipliers and shifts of the 64-bit mixing steps (fixed values).
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
BASE = 0x9E3779B97F4A7C15

_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of each 64-bit number over all of its bits."""
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(2 * n, BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes, size: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word."""
    return words(text, size)[0]


def words(text: bytes, size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, made from parts of the text that end at white space."""
    found, start = [], 0
    while start < len(text):
        stop = start + size
        if stop < len(text):
            after = SPACE.search(text, stop)
            stop = after.end() if after else len(text)
        part = np.frombuffer(text, np.uint8, stop - start if stop <= len(text) else len(text) - start, start)
        inside = np.concatenate([[False], ~IS_SPACE[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = edges[::2], edges[1::2]
        if len(begins):
            chars = part[inside[1:-1]].astype(np.uint64) + np.uint64(1)
            lengths = ends - begins
            offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            place = np.arange(len(chars)) - np.repeat(offsets, lengths)
            sums = np.add.reduceat(chars * powers(min(int(lengths.max()), 1 << 16))[place & 0xFFFF], offsets)
            found.append((mix(sums + lengths.astype(np.uint64) * np.uint64(BASE)), begins + start, ends + start))
        start = stop
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return found[0] if len(found) == 1 else tuple(np.concatenate(part) for part in zip(*found))


def joined_hashes(body: bytes, own: tuple, head: bytes, other: tuple) -> np.ndarray:
    """The word hashes of body + head, where body begins the text of `own` and head that of `other`.

    Only what stands at the seam and at the end of head is hashed anew.
    """
    whole = int(np.searchsorted(own[2], len(body)))  # words of body with white space behind them
    first = int(np.searchsorted(other[1], 0, side="right"))  # a word at head's very start belongs to the seam
    last = max(first, int(np.searchsorted(other[2], len(head), side="right")))
    seam = body[own[2][whole - 1] if whole else 0 :] + head[: other[2][0] if first else 0]
    rest = head[other[1][last] :] if last < len(other[1]) and other[1][last] < len(head) else b""
    return np.concatenate([own[0][:whole], words(seam)[0], other[0][first:last], words(rest)[0]])


def shingle_hashes(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One for each run of `shingle` words; of fewer words, one for all of them together."""
    if not len(words):
        return words
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(words))):
        out = mix(out + words[i : i + n] + np.uint64(BASE * (i + 1) & 0xFFFFFFFFFFFFFFFF))
    return out


@functools.cache
def probes(bins: int, block: int, width: int = 64) -> np.ndarray:
    """For each bin the bins that its own sequence of hashes leads to, a stretch of it."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    attempts = np.arange(block * width + 1, (block + 1) * width + 1, dtype=np.uint64)
    own = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(BASE)
    return (mix(own + attempts) >> shift).astype(np.int64)


def sketch(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> bytes:
    """The packed fingerprint: `bits` bits for each bin; empty for no hashes."""
    if not len(hashes):
        return b""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    low = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    hashes = np.sort(hashes)  # by bin, then by value
    at = (hashes >> shift).astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]])
    low[at[first]] = mix(hashes[first])
    full = np.zeros(bins, bool)
    full[at] = True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        ways = probes(bins, block)[empty]
        hit = full[ways]
        at, got = hit.argmax(1), hit.any(1)
        low[empty[got]] = low[ways[got, at[got]]]
        empty, block = empty[~got], block + 1
    values = (low & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint8)) & 1).tobytes()


def likeness(a: bytes, b: bytes, bits: int = BITS) -> float:
    """Estimated share of common shingles, 0 to 1; of two empty fingerprints 1, of one 0."""
    if not a or not b:
        return float(a == b)
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits).any(1)
    chance = 0.5**bits
    return float(min(1.0, max(0.0, ((1 - differ.mean()) - chance) / (1 - chance))))


def fingerprint(text: str | None) -> bytes:
    return sketch(shingle_hashes(word_hashes((text or "").encode())))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the packed fingerprint (binary) of the whole text; null counts as empty. `out` is replaced."""
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(v.as_py()) for v in batch.column(batch.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(values, pa.binary())], names=[*kept, out])

    return df.mapInArrow(run, schema)


#: What with_next adds.
RESULTS = (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))


def neighbours(df: DataFrame) -> tuple[DataFrame, int]:
    """Deals rows (by, tie, …) into ranges of descending `by`, then ascending `tie`, of about the same number of rows.

    Adds `range` and returns how many there are. A `by` that many rows share (null too) is
    a range of its own, or several, cut by `tie`, a 64-bit hash. The driver learns one key
    for each range: some times as many as there are shuffle partitions.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("by", [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("b")).first()
    limit = max(1000, first["n"] // ranges)
    counts = df.groupBy("by").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    hot = {r["by"]: -(-r["n"] // limit) for r in counts.collect()}  # at most as many as there are ranges
    bounds = {b for b in first["b"] or []} | {b - k for b in hot if b is not None for k in (0, 1)}
    cuts = sorted(bounds, reverse=True)
    table = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # null comes last; ranges are numbered from the largest key on
    number = F.when(F.col("by").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(table, lambda c: c >= F.col("by"))))
    pieces = [1] * (len(cuts) + 2)
    for by, n in hot.items():
        pieces[len(cuts) + 1 if by is None else sum(c >= by for c in cuts)] = n
    begin = np.concatenate([[0], np.cumsum(pieces)]).tolist()
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("number") + 1)
    share = F.floor((F.col("tie") / float(1 << 64) + 0.5) * at(pieces))
    ranged = df.withColumn("number", number.cast("int")).withColumn("range", (at(begin[:-1]) + F.least(share, at(pieces) - 1)).cast("int"))
    return ranged.drop("number"), begin[-1]


def with_next(df: DataFrame, columns: list[str], by: str = "doc_id", text: str = "text") -> DataFrame:
    """(…columns, then RESULTS: fingerprint, edited text's fingerprint and SHA-256, both likenesses) in one ordered pass.

    The next row is the one with the next lower `by`, a whole number (equal ones in the
    order of a hash of their texts, null last); after the last comes the first again, so a
    single row is its own next. The edited text has its last floor(n/2) code points
    replaced by the first as many of the next row's text. A null text counts as empty;
    repeated rows are each other's next; columns named like the results are left out.
    """
    columns = [c for c in columns if c not in dict(RESULTS)]
    words_of = F.coalesce(F.col(text), F.lit(""))
    given = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("in"), F.col(by).cast("bigint").alias("by"), words_of.alias("text"), F.xxhash64(words_of).alias("tie"))
    ranged, ranges = neighbours(given)
    # the keys of each range's first row; the same row, as a ghost, ends the range before it
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.bitwise_not("by").alias("k"), "tie")).alias("f")).select("range", "f.k", "f.tie")
    found = sorted(firsts.collect(), key=lambda r: r["range"])
    moves = [(r["range"], r["k"], r["tie"], found[i - 1]["range"]) for i, r in enumerate(found)]
    small = df.sparkSession.createDataFrame(moves, "at int, k long, t long, to int")  # a row for each range
    ghosts = ranged.join(F.broadcast(small), (F.col("range") == F.col("at")) & F.bitwise_not("by").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")))
    ghosts = ghosts.withColumn("range", F.col("to")).drop("at", "k", "t", "to").dropDuplicates(["range"])
    dealt = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    dealt = dealt.repartitionById(max(1, ranges), F.col("range")).sortWithinPartitions("range", "ghost", F.col("by").desc_nulls_last(), "tie")
    schema = T.StructType([df.schema[c] for c in columns])
    for name, kind in RESULTS:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its next
        for batch in batches:
            rows, out = batch.select(["in", "text", "range", "ghost"]), []
            for row in (rows.slice(i, 1).to_pylist()[0] for i in range(rows.num_rows)):
                found = words(row["text"].encode())
                mine = sketch(shingle_hashes(found[0]))
                if held is not None and held[0]["range"] == row["range"]:
                    last, fp, before = held
                    text, n = last["text"], len(last["text"])
                    body, head = text[: n - n // 2].encode(), row["text"][: n // 2].encode()
                    other = sketch(shingle_hashes(joined_hashes(body, before, head, found)))
                    out.append(last["in"] | {"n_chars": n, "edited_sha256": hashlib.sha256(body + head).hexdigest(), "fingerprint": fp.hex(), "edited_fingerprint": other.hex(), "near_edited": likeness(fp, other), "near_next": likeness(fp, mine)})
                held = None if row["ghost"] else (row, mine, found)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        # every range ends with a ghost, so nothing waits here

    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(run, schema)
