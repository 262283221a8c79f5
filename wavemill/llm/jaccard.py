"""Near-duplicates by the exact Jaccard similarity of word shingles.

Texts are sets of five-word shingles; equal sets are one node. Candidates are what the
exact SimHash comparison by tiles finds (fingerprints of the shingles within RADIUS
bits), and, as at a similarity of 0.8 fingerprints differ in some ten bits, where tiles
skip nothing, also all that share one of BANDS keys of ROWS minima under hash functions:
two sets of similarity s share none with probability (1 - s**ROWS)**BANDS, 1e-10 at 0.8.
Similarities are counted on whole sets, block against block: each node lies in a block of
its most crowded key, and a crowded key has several blocks, by size. First every block is compared in
itself, with one node that all blocks of its key share. Then, under each key, nodes that are
still apart from the key's largest component are sent to the other blocks, and a block meets
what it was sent heap by heap. So a set travels once for each block or heap that it meets, not
for each pair, what is in the largest component stays where it is, no pair under a key is left
out, and a comparison emits a spanning forest of the links it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, salted
from .minhash import BASE, mix, shingle_hashes, word_hashes
from .simhash import _forest, components, links

RADIUS = 2
BANDS, ROWS = 32, 3
#: Nodes and shingles that a block holds, about; a larger set is a block of its own.
CROWD, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles that are counted at once between two blocks.
COLUMNS = 4096
#: Rows of a few numbers that are broadcast at most; beyond it, a shuffled join.
BROADCAST_IDS = 1_000_000

FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of the text's shingles as sorted hashes; ASCII letters count in lower case."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode().lower())))


def node(found: np.ndarray) -> int:
    """One number for equal sets, signed; 0 for the empty one."""
    if not len(found):
        return 0
    return int(mix(mix(found).sum(dtype=np.uint64)[None] + np.uint64(len(found))).view(np.int64)[0])


def band_keys(found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.empty(0, np.int64)
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 2048):
        low = np.minimum(low, (FACTORS[:, None] * found[None, start : start + 2048]).min(1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys + np.uint64(BASE) + low[i::ROWS])
    return keys.view(np.int64)


def bits(found: np.ndarray, size: int = 1 << 14) -> int:
    """The SimHash of a set of shingles, signed: a bit is set if it is set in over half of their hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(found), size):
        counts += np.unpackbits(found[start : start + size].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.int64)[0])


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.lit(4), F.col(doc_id), F.col(text))


def mark(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, node, size, fp, keys) of each row."""
    given = df.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for v in batch.column(2):
                found = shingles(v.as_py())
                nodes.append(node(found))
                sizes.append(len(found))
                fps.append(bits(found))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "node", "size", "fp", "keys"])

    return given.mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, row long, node long, size long, fp long, keys array<long>")


def _sets(df: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, found): the whole sets of the given rows, one of each node."""
    rows = cut_lineage(rows.select("row").distinct())
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    texts = df.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text")).join(rows, "row", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node(f) for f in found], pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["node", "found"])

    return texts.mapInArrow(run, "node long, found array<long>").dropDuplicates(["node"])


def shared_counts(sets: list[np.ndarray], first: int) -> np.ndarray:
    """How many shingles each of the first sets shares with each of the others (first = len(sets): each with each)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = often > 1
    place = (np.cumsum(several) - 1)[column]
    owner, place = owner[several[column]], place[several[column]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    rest = 0 if first == len(sets) else first
    out = np.zeros((first, len(sets) - rest))
    for start in range(0, int(several.sum()), COLUMNS):
        low, high = np.searchsorted(place, [start, start + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[low:high], place[low:high] - start] = 1
        out += has[:first] @ has[rest:].T
    return out


def alike(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the first nodes and the others (first = len(nodes): among all)
    whose roots differ."""
    rest = 0 if first == len(nodes) else first
    both, size = shared_counts(sets, first), np.array([len(x) for x in sets], np.float64)
    near = both / np.maximum(size[:first, None] + size[None, rest:] - both, 1) >= least
    x, y = np.nonzero(near & (roots[:first, None] != roots[None, rest:]))
    return _forest(nodes[x], nodes[y + rest]) if len(x) else (nodes[:0], nodes[:0])


def _compared(dealt: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of a spanning forest for each two blocks (low, high) to which nodes are dealt.

    dealt: (low, high, block, node, root), block being one of the two; nodes of one block
    are compared with those of the other, or, where low = high, with each other.
    """
    dealt = F.broadcast(dealt) if dealt.count() <= BROADCAST_IDS else dealt

    def run(group: pa.Table) -> pa.Table:
        low, high, block, node_, root = (group.column(c).to_numpy() for c in ("low", "high", "block", "node", "root"))
        order = np.argsort(block != low, kind="stable")
        first = int((block == low).sum())
        found = [group.column("found")[int(i)].values.to_numpy().view(np.uint64) for i in order]
        a, b = alike(node_[order], root[order], found, first, least) if low[0] == high[0] or 0 < first < len(order) else (node_[:0], node_[:0])
        return pa.table({"a": a, "b": b})

    return sets.join(dealt, "node").groupBy("low", "high").applyInArrow(run, "a long, b long")


def by_tiles(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked by the comparison of tiles."""
    fps = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("one"), F.count(F.lit(1)).alias("n")))
    near = links(fps.select("fp"), RADIUS)
    one = lambda c: fps.select(F.col("fp").alias(c), F.col("one").alias(f"one_{c}"))
    across = near.join(one("a"), "a").join(one("b"), "b").select("one_a", "one_b")
    inside = salted(nodes.select("node", "fp"), fps, ["fp"], F.pmod("node", F.lit(1 << 20)).cast("int")).select("one", "node").filter("one <> node")
    return across.union(inside).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _placed(shared: DataFrame, nodes: DataFrame, tiles: DataFrame, least: float) -> DataFrame:
    """(node, size, block, split, n, hub): nodes with a key or a tile in common with others in blocks of their
    most crowded key; whether that key has several, its nodes and the smallest one of these.

    Several blocks hold nodes of like size each, so that most blocks needn't meet: sizes whose
    ratio is `least` or more lie in the same step of 1 / least or in neighbouring ones.
    """
    homes = shared.groupBy("node").agg(F.max(F.struct("n", "key")).alias("_")).select("node", F.col("_.key").alias("home"))
    used = tiles.select(F.explode(F.array("a", "b")).alias("node")).union(homes.select("node")).distinct()
    mine = nodes.select("node", "size").join(used, "node").join(homes, "node", "left").withColumn("home", F.coalesce("home", "node"))
    mine = cut_lineage(mine)
    full = mine.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("node").alias("hub"))
    full = full.withColumn("split", (F.col("n") > CROWD) | (F.col("total") > BLOCK_SHINGLES))
    spread = F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 20)).cast("int")
    out = salted(mine, full.select("home", "hub", "split", "n", F.col("n").alias("crowd")), ["home"], spread)
    step = F.when(F.col("split"), F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1 / min(max(least, 0.01), 0.999)))).otherwise(0)
    out = cut_lineage(out.withColumn("step", step.cast("long")))
    steps = out.groupBy("home", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    steps = steps.select("home", "step", "n", F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).alias("blocks"))
    out = salted(out, steps, ["home", "step"], spread)
    block = F.xxhash64("home", "step", F.pmod(F.xxhash64(F.lit(8), "node"), "blocks"))
    return out.select("node", "size", block.alias("block"), "split", F.col("crowd").alias("n"), "hub")


def _apart(shared: DataFrame, known: DataFrame, tiles: DataFrame, least: float) -> DataFrame:
    """What `_compared` is dealt second: to each block of a key, in heaps, the nodes of other blocks that lie
    outside the key's largest component, and of the block the nodes with such a key; and nodes linked by tiles.

    Of two nodes outside, that of the lower block is sent; to a higher one's block, nodes only go for those
    in the largest component. A block whose sizes are too far off gets nothing.
    """
    rows = cut_lineage(shared.select("key", "node").join(known, "node"))
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("_"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", F.col("_.root").alias("largest"))
    rows = cut_lineage(rows.join(largest, "key").withColumn("apart", F.col("root") != F.col("largest")).drop("largest"))
    others = rows.groupBy("key", F.col("block").alias("other")).agg(F.min("apart").alias("only_apart"), F.min("size").alias("smallest"), F.max("size").alias("biggest"))
    slack = least * 0.999  # rounding never leaves a pair out
    fits = (F.col("size") >= slack * F.col("smallest")) & (slack * F.col("size") <= F.col("biggest"))
    met = rows.filter("apart").join(others, "key").filter("block < other or (block > other and not only_apart)").filter(fits)
    met = cut_lineage(met.select("key", "other", "node", "size", "root"))
    guests = cut_lineage(met.groupBy("other", "node").agg(F.any_value("size").alias("size"), F.any_value("root").alias("root")))
    heaps = guests.groupBy("other").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    heaps = cut_lineage(heaps.select("other", "n", F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1)).alias("heaps")))
    spread = F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 20)).cast("int")
    heap = lambda c: F.xxhash64(F.lit(11), F.col("other"), c).alias("high")
    come = salted(guests, heaps, ["other"], spread).select(F.col("other").alias("low"), heap(F.pmod(F.xxhash64(F.lit(8), "node"), "heaps")), "node", "root")
    hosts = rows.join(met.select("key", F.col("other").alias("block")).distinct(), ["key", "block"], "left_semi").select(F.col("block").alias("other"), "node", "root").distinct()
    hosts = salted(hosts, heaps, ["other"], spread).select("other", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("heaps") - 1)).alias("_heap"))
    stay = hosts.select(F.col("other").alias("low"), heap(F.col("_heap")), F.col("other").alias("block"), "node", "root")
    side = lambda c: known.select(F.col("node").alias(c), F.col("block").alias(f"block_{c}"), F.col("root").alias(f"root_{c}"))
    linked = tiles.join(side("a"), "a").join(side("b"), "b").filter("root_a <> root_b and block_a <> block_b")
    low, high = F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")
    ends = [linked.select(low, high, F.col(f"block_{x}").alias("block"), F.col(x).alias("node"), F.col(f"root_{x}").alias("root")).distinct() for x in "ab"]
    return stay.unionByName(come.withColumn("block", F.col("high"))).unionByName(ends[0].union(ends[1]).distinct())


def groups(df: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, component_id) of each row: the smallest doc_id reachable over links of
    similarity `least` or more; `row` is row_key, equal for rows of the same doc_id and text.

    `df` is read twice. Texts without words are alike, null ones too; of fewer than five
    words, equal ones. Rows with a null doc_id take part; the id of a component without
    any doc_id is null.
    """
    return members(df, least, text, doc_id).select("doc_id", "row", "component_id")


def members(df: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What `groups` returns, with `root`, a number for each component."""
    marked = cut_lineage(mark(df, text, doc_id))
    nodes = cut_lineage(marked.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), *[F.any_value(c).alias(c) for c in ("size", "fp", "keys")]))
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(keyed.join(counts, "key"))
    tiles = cut_lineage(by_tiles(nodes))
    placed = cut_lineage(_placed(shared, nodes, tiles, least))
    sets = cut_lineage(_sets(df, nodes.select("node", "row").join(placed.select("node"), "node"), text, doc_id))
    guests = placed.filter("split").select("block", F.col("hub").alias("node")).distinct()
    inside = placed.filter("n > 1").select("block", "node").union(guests).distinct()
    inside = cut_lineage(inside.select(F.col("block").alias("low"), F.col("block").alias("high"), "block", "node", F.col("node").alias("root")))
    found = cut_lineage(_compared(inside, sets, least))
    known = placed.select("node", "size", "block").join(components(found), "node", "left")
    known = cut_lineage(known.withColumn("root", F.coalesce("root", "node")))
    across = cut_lineage(_apart(shared, known, tiles, least))
    roots = components(cut_lineage(found.union(_compared(across, sets, least))))
    rooted = cut_lineage(nodes.select("node", "low", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = cut_lineage(rooted.join(lowest, "root").select("node", "n", "root", "component_id"))
    spread = F.pmod("row", F.lit(1 << 20)).cast("int")
    return salted(marked.select("doc_id", "row", "node"), ids, ["node"], spread).select("doc_id", "row", "root", "component_id")


def representatives(df: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component, whole: that of the lowest doc_id (null last), then by row_key.

    Of rows with the same doc_id and text one stays; rows that share a doc_id but not
    their text are judged each for itself.
    """
    names = df.columns
    found = members(df, least, text, doc_id)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("_")).select("_.row").distinct()
    copies = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    chosen = cut_lineage(chosen.join(copies, "row"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("in"), row_key(doc_id, text).alias("row"))
    if chosen.count() <= BROADCAST_IDS:
        kept = rows.join(F.broadcast(chosen), "row")
    else:
        spread = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")
        kept = salted(rows, chosen.withColumn("copies", F.col("n")), ["row"], spread).withColumnRenamed("copies", "n")
    out = kept.filter("n = 1")
    if chosen.filter("n > 1").limit(1).count():  # of these, copies meet before the shuffle
        out = out.unionByName(kept.filter("n > 1").dropDuplicates(["row"]))
    return out.select("in.*")
