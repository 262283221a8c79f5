"""Phrases of words that belong together, counted on a weighted de Bruijn graph.

An edge is a phrase of `longest` words; it leads from the node of its first words but one to
the node of its last ones. Only edges are counted in the texts, with, where a piece ends, the
shorter phrases that no edge begins with there. What begins with a phrase then adds up to the
phrase's count: a node's flow is the sum of its edges and of the pieces that end in it, and a
word's flow is that of its nodes.

Edges are shuffled once, counted in their task before, to sorted ranges of edges, so that all
edges of a node, and all nodes of a word, follow one another, and a hot word or node takes
several ranges. They travel in blocks, each with its own words and its edges as numbers of
these. A range numbers the words of all its blocks in their order, sorts its edges as numbers
and adds up its flows; sums that may go on beyond its ends are added up afterwards, a few for
each range. A node with a single way on, and no piece that ends in it, is compacted with what
follows: one row stands for all of the path's phrases.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _slices
from .common import cut_lineage, once, salted

#: What a byte is: 0 part of a word, 1 blank, 2 end of a piece. No byte of a longer UTF-8 character is blank or an end.
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t")] = 1
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # of bytes: A-Z alone
#: So many words (by _weight) are held in a task before their edges are counted and passed on.
HELD = 1_000_000
#: Ranges are so many that each has about as many edges as this, or fewer: a task holds them all.
IN_A_RANGE = 1_500_000
#: Documents and edges of each that are looked at for each range, to place its bounds.
SAMPLE_DOCUMENTS, SAMPLE_EDGES = 20, 5
NO_LANG = "und"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and whether each is the first of a piece."""
    texts = pc.drop_null(texts).cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if at[0] == at[-1]:
        return pa.array([], pa.string()), np.zeros(0, bool)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    heads = at[:-1][at[:-1] < at[-1]] - at[0]
    kinds = KINDS[data]
    inside = kinds == 0
    before, behind = np.roll(inside, 1), np.roll(inside, -1)
    before[heads] = behind[heads - 1] = False  # the first head is 0, whose byte before is the last
    start = np.flatnonzero(inside & ~before)
    sizes = np.flatnonzero(inside & ~behind) + 1 - start
    begins = np.zeros(len(start) + 1, bool)
    begins[np.searchsorted(start, heads)] = True
    begins[np.searchsorted(start, np.flatnonzero(kinds == 2))] = True
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])), begins[:-1]


def _weight(words: pa.Array) -> int:
    """How many words there are; long ones count as several, so that weights bound bytes too."""
    return max(len(words), words.nbytes // 16)


def _numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in the order of their bytes, and each word's place among them, from 1 on."""
    encoded = words.dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary)
    places = np.zeros(len(order), np.int32)
    places[order.to_numpy()] = np.arange(1, len(order) + 1)
    return encoded.dictionary.take(order), places[encoded.indices.to_numpy()]


def _keys(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row that sorts like the row."""
    base = max(int(c.max()) for c in columns) + 1
    keys, size = columns[0].astype(np.int64), base
    for column in columns[1:]:
        if size * base > 1 << 63:
            keys = np.unique(keys, return_inverse=True)[1]
            size = len(keys)
        keys *= base
        keys += column
        size *= base
    return keys


def _bounds(texts: DataFrame, longest: int, ranges: int) -> tuple[int, list[tuple[str, tuple[str, ...]]]]:
    """How many ranges there are (`ranges` or more), and bounds that cut the edges into ranges of about the same size.

    The driver sorts SAMPLE_EDGES edges of SAMPLE_DOCUMENTS documents for each range; what they
    decide is where rows go, not what is counted.
    """
    rows = texts.count()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                words, begins = _words(batch.column(1).slice(i, 1))
                piece = np.cumsum(begins)
                picked = range(0, len(words), max(1, len(words) // SAMPLE_EDGES))[:SAMPLE_EDGES]
                edges = [words[j : j + int(np.searchsorted(piece[j : j + longest], piece[j], "right"))].to_pylist() for j in picked]
                weight = _weight(words) / max(1, len(picked))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(edges), pa.string()), pa.array(edges, pa.list_(pa.string())), pa.array([weight] * len(edges), pa.float64())], names=["lang", "edge", "weight"])

    def sample() -> tuple[list[tuple[str, tuple[str, ...], float]], int]:
        share = min(1.0, max(1000, SAMPLE_DOCUMENTS * ranges) / max(1, rows))
        found = texts.sample(share, 7).mapInArrow(some, "lang string, edge array<string>, weight double").collect()
        return sorted((r["lang"], tuple(r["edge"]), r["weight"]) for r in found), int(sum(r["weight"] for r in found) / share / IN_A_RANGE) + 1

    found, needed = sample()
    few, ranges = needed > 2 * ranges and rows > 1000, max(ranges, needed)
    if few:
        found, _ = sample()
    if not found:
        return ranges, []
    at = np.cumsum([w for *_, w in found])
    return ranges, sorted({found[min(len(found) - 1, int(i))][:2] for i in np.searchsorted(at, at[-1] * np.arange(1, ranges) / ranges)})


def _blocks(lang: str, words: pa.Array, begins: np.ndarray, longest: int, bounds: list[tuple[str, tuple[str, ...]]]) -> Iterator[pa.RecordBatch]:
    """(range, lang, words, w0, w1, .., n): the edges and piece ends of one language's words, counted.

    A block's edges are the places of their words in `words`, from 1 on, 0 where the piece has
    ended. It has so few that places fit in 16 bits.
    """
    first = bisect_left(bounds, (lang, ()))
    cuts = [edge for own, edge in bounds[first:] if own == lang]
    rows = len(words)
    spelled, places = _numbered(pa.concat_arrays([words, pa.array([w for edge in cuts for w in edge], pa.string())]))
    piece = np.cumsum(begins, dtype=np.int32)
    at = np.concatenate([[rows], rows + np.cumsum([len(edge) for edge in cuts])]).astype(np.int64)
    columns = []
    for k in range(longest):
        column = np.zeros(rows + len(cuts), np.int32)
        same = piece[k:] == piece[: max(0, rows - k)]
        column[: len(same)][same] = places[k:rows][same]
        has = np.flatnonzero(np.diff(at) > k)
        column[rows + has] = places[at[has] + k]
        columns.append(column)
    keys = _keys(columns)
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    is_cut = order >= rows
    n = np.add.reduceat(~is_cut, start, dtype=np.int32)
    number = first + np.cumsum(np.add.reduceat(is_cut, start, dtype=np.int32))
    real = n > 0
    picked, n, number = order[start[real]], n[real], number[real]
    columns = [column[picked] for column in columns]

    most = 0xFFFF // longest
    turns = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(n)]
    starts = [i for a, b in zip(turns, turns[1:]) for i in range(a, b, most)]
    local = np.zeros(len(spelled) + 1, np.uint16)
    for i in range(0, len(starts), 64):
        own = starts[i : i + 65] if i + 64 < len(starts) else [*starts[i:], len(n)]
        a, b = own[0], own[-1]
        used, short = [], [np.empty(b - a, np.uint16) for _ in columns]
        for x, y in zip(own, own[1:]):
            mine = np.unique(np.concatenate([column[x:y] for column in columns]))
            mine = mine[mine > 0]
            local[mine] = np.arange(1, len(mine) + 1)
            for column, out in zip(columns, short):
                out[x - a : y - a] = local[column[x:y]]
            used.append(mine - 1)
        listed = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
        sizes = np.diff(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number[own[:-1]], pa.int32()), pa.array([lang] * len(used), pa.string()), listed([len(u) for u in used], spelled.take(pa.array(np.concatenate(used))))]
            + [listed(sizes, pa.array(out.view(np.int16))) for out in short]
            + [listed(sizes, pa.array(n[a:b], pa.int32()))],
            names=["range", "lang", "words", *[f"w{k}" for k in range(longest)], "n"],
        )


def _edges(texts: DataFrame, longest: int, bounds: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(range, lang, words, w0, w1, .., n): blocks of edges and piece ends, counted in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        total = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                words, begins = zip(*held.pop(lang))
                yield from _blocks(lang, pa.concat_arrays(words), np.concatenate(begins), longest, bounds)

        for batch in _slices(batches, lambda b: pc.binary_length(b.column(1)).fill_null(0).to_pylist()):
            for lang in batch.column(0).unique().to_pylist():
                words, begins = _words(batch.column(1).filter(pc.equal(batch.column(0), lang)))
                if len(words):
                    held.setdefault(lang, []).append((words, begins))
                    total += _weight(words)
            if total > HELD:
                yield from passed()
                total = 0
        yield from passed()

    return texts.mapInArrow(run, f"range int, lang string, words array<string>, {''.join(f'w{k} array<short>, ' for k in range(longest))}n array<int>")


class Edges:
    """A range's edges of one language, block by block; `flows` adds them up."""

    def __init__(self, longest: int):
        self.words: list[pa.Array] = []
        self.columns: list[list[np.ndarray]] = [[] for _ in range(longest)]
        self.n: list[np.ndarray] = []
        self.held = 0

    def add(self, words: pa.Array, columns: list[pa.Array], n: pa.Array) -> None:
        """One row each for a block."""
        sizes = pc.list_value_length(words).to_numpy()
        start = np.repeat(self.held + np.cumsum(sizes) - sizes, pc.list_value_length(n).to_numpy()).astype(np.int32)
        for out, column in zip(self.columns, columns):
            place = column.flatten().to_numpy().view(np.uint16)
            out.append(np.where(place > 0, place + start, 0).astype(np.int32))
        self.words.append(words.flatten().cast(pa.large_string()))
        self.n.append(n.flatten().to_numpy())
        self.held += int(sizes.sum())

    def flows(self, least: int) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
        """(phrases, words, shortest, n), once for each number of words, the total with 0 words.

        A phrase stands for itself and its beginnings from `shortest` words on, which all have its
        count. Sums under `least` are left out, unless they may go on before or behind the range.
        """
        words, parts, n = self.words, self.columns, np.concatenate(self.n)
        self.__init__(len(parts))
        spelled, places = _numbered(pa.concat_arrays(words))
        places = np.concatenate([[0], places]).astype(np.int32)
        words.clear()
        columns = []
        for some in parts:  # one at a time, as a range holds many
            columns.append(places[np.concatenate(some)])
            some.clear()
        order = np.argsort(_keys(columns))
        for m in range(len(columns)):
            columns[m] = columns[m][order]
        before = np.concatenate([[0], np.cumsum(n[order], dtype=np.int64)])
        del n, order
        yield pa.array([""], pa.large_string()), 0, np.zeros(1, np.int64), before[-1:]

        rows = len(before) - 1
        turns = np.zeros(rows, bool)
        turns[0] = True
        above: dict[str, np.ndarray] = {}

        def wanted(g: dict[str, np.ndarray], m: int) -> tuple[pa.Array, int, np.ndarray, np.ndarray]:
            some = ~g["absorbed"] & ((g["total"] >= least) | ~g["plain"])
            at = g["start"][some]
            phrases = pc.binary_join_element_wise(*[spelled.take(pa.array(column[at] - 1)) for column in columns[:m]], pa.scalar(" ", pa.large_string()))
            return phrases, m, g["shortest"][some], g["total"][some]

        for m, column in enumerate(columns, 1):
            turns[1:] |= column[1:] != column[:-1]
            start = np.flatnonzero(turns).astype(np.int32)
            end = np.append(start[1:], np.int32(rows))
            start, end = (x[column[start] > 0] for x in (start, end))
            total, plain = before[end] - before[start], (start > 0) & (end < rows)
            shortest, absorbed = np.full(len(start), m, np.int32), np.zeros(len(start), bool)
            if above and len(start):
                parent = np.searchsorted(above["start"], start, "right") - 1
                joins = plain & above["plain"][parent] & (above["total"][parent] == total)
                above["absorbed"][parent[joins]] = True
                shortest = np.where(joins, above["shortest"][parent], shortest)
            if above:
                yield wanted(above, m - 1)
            above = {"start": start, "total": total, "plain": plain, "shortest": shortest, "absorbed": absorbed}
        yield wanted(above, len(columns))


def counts(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10) -> DataFrame:
    """(lang, phrase, words, n): all phrases of up to `longest` words found `least` times or more.

    The empty phrase, with no words, has the number of the language's words. Null
    languages are NO_LANG, null texts have no words; repeated rows count each time.
    """
    texts = df.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    ranges, bounds = _bounds(texts, longest, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _edges(texts, longest, bounds).repartitionById(ranges, F.col("range")).drop("range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Edges] = {}
        for batch in batches:
            langs = batch.column(0).unique().to_pylist()
            for own in langs:
                _, words, *columns, n = (batch if len(langs) == 1 else batch.filter(pc.equal(batch.column(0), own))).columns
                found.setdefault(own, Edges(longest)).add(words, columns, n)
        for own in list(found):
            for phrases, words, shortest, n in found.pop(own).flows(least):
                for i in range(0, len(n), 10_000):
                    some = slice(i, i + 10_000)
                    size = len(n[some])
                    yield pa.RecordBatch.from_arrays([pa.array([own] * size, pa.string()), phrases[some].cast(pa.string()), pa.array([words] * size, pa.int32()), pa.array(shortest[some], pa.int32()), pa.array(n[some], pa.int64())], names=["lang", "phrase", "words", "shortest", "n"])

    paths = dealt.mapInArrow(run, "lang string, phrase string, words int, shortest int, n long")
    each = paths.select("lang", "phrase", "n", F.explode(F.sequence("shortest", "words")).alias("words"))
    each = each.withColumn("phrase", F.expr("substring_index(phrase, ' ', words)"))
    return each.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))


def _looked_up(cuts: DataFrame, found: DataFrame, part: str, name: str) -> DataFrame:
    """Adds the count of the phrase in `part`; parts that many phrases share are dealt to several tasks."""
    used = cuts.groupBy("lang", F.col(part).alias("phrase")).agg(F.count(F.lit(1)).alias("uses"))
    keyed = cut_lineage(found.join(used, ["lang", "phrase"]).select("lang", F.col("phrase").alias(part), F.col("n").alias(name), "uses"))
    return salted(cuts, keyed, ["lang", part], F.xxhash64("phrase"), n="uses")


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def mine(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, first: int = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to `longest` words whose words go together most.

    a, l, r: how often the phrase, its first part and the rest are found, for the cut of
    lowest score (ties: after fewer words), n: the language's words, score:
    floor(1000000*a*a / (l*r)). A phrase whose words stand inside a longer one that is
    found `share` percent as often or more is left out. Each language's `first` phrases are
    ranked by score, then a, both descending, then by the phrase's bytes. Null languages are
    NO_LANG; null and empty texts have no phrases; other columns don't matter.
    """
    found = cut_lineage(counts(df, text, lang, longest, least))
    phrases = found.filter("words >= 2").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice("parts", start, size), " ")
    parts = phrases.select("lang", "phrase", "a", "words", once(words).alias("parts"))
    longer = (
        parts.filter("words > 2")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        .select("lang", joined(F.col("start"), F.col("size")).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    cuts = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words")).alias("rest"))
    known = _looked_up(_looked_up(cuts, found, "head", "l"), found, "rest", "r")
    # 38 digits hold a*a*1000000 for up to 10^16 occurrences
    score = known.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * (_wide("a") * _wide("a"))).withColumn("score", F.expr("top div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = score.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    totals = found.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
