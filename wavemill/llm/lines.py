"""Line deduplication across documents: copies and lines one edit away from an earlier line.

Copies are found by a hash of the line. For edits, each distinct line is split into
threshold-plus-one segments (two, for one edit): two lines one edit apart agree, for
their common length, in all but one of them. So each line is entered under what
stands before and behind each segment, for its own length and for the length less
one, and lines under the same key are compared by banded edit distance. Where many
lines share a key, these lines are entered again with finer segments, so that they
agree in more; where many still share one, with single characters, and there a
common key already proves the edit: the earliest line of a key stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, once, salted

#: Lines of so many words or characters are compared by edits; of shorter ones only copies go.
EDIT_WORDS, EDIT_CHARS = 5, 20
#: Keys under which more lines stand are refined before lines are compared two by two.
CROWD = 64
#: Segments of the first two levels (threshold 1 plus one, then finer); the third is by character.
SEGMENTS = (2, 16)
#: Pieces of a line that are looked for in another one before the two are compared character by character.
PIECES = 8
#: Ids of lines that are broadcast at most (8 bytes each); beyond it, a shuffled join.
BROADCAST_IDS = 1_000_000


def lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, no, line, size, h): each line of each text, its code points and its hash.

    `row` tells texts apart whose doc_id is the same or null.
    """
    row = F.xxhash64(F.lit(3), F.col(doc_id), F.col(text))
    split = df.select(F.col(doc_id).alias("doc_id"), row.alias("row"), F.posexplode(F.split(F.col(text), "\n")).alias("no", "line"))
    return split.withColumn("size", once(F.length("line"))).withColumn("h", F.xxhash64("line", "size"))


def _words(least: int) -> Column:
    return F.col("line").rlike(rf"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{least - 1}}}[^\x20\x09-\x0D]")


def eligible(least: int = 1) -> Column:
    """Whether copies of a line go: if it has `least` words."""
    return _words(max(1, least))


def editable(least: int = 1) -> Column:
    """Whether a line goes or stands for others that are one edit away."""
    return _words(max(least, EDIT_WORDS)) | (eligible(least) & (F.col("size") >= EDIT_CHARS))


def within(a: Column, b: Column, most: int = 1) -> Column:
    """Whether the edit distance of two texts is at most `most`, by a banded bit-parallel recurrence.

    The band holds the 2 * most + 1 rows around the diagonal, one bit each; vertical
    differences of +1 and -1 are two numbers, and a column follows from the one before
    in a few operations on whole numbers. The distance is kept along the band's lowest
    diagonal and then along the last row.
    """
    width = 2 * most + 1
    m, n = F.length(a), F.length(b)
    whole = lambda x: F.lit(x).cast("bigint")
    full, last = whole((1 << width) - 1), whole(1 << (width - 1))
    # which rows of each column's band are equal to the column's character
    one, two = F.array(F.split(a, "")), F.split(b, "")
    equal = lambda x, c, j: sum((F.when(F.get(x, j + (k - most)) == c, 1 << k).otherwise(0) for k in range(1, width)), F.when(F.get(x, j - most) == c, 1).otherwise(0))
    matches = F.flatten(F.transform(one, lambda x: F.transform(two, lambda c, j: F.struct(equal(x, c, j).cast("bigint").alias("pm"), (j + 1).alias("j")))))

    def column(state: Column, at: Column) -> Column:
        vp, vn, pm, j = state["vp"], state["vn"], at["pm"], at["j"]

        def diagonal(d0: Column) -> Column:
            hp, hn, shifted = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full), d0.bitwiseAND(vp), F.shiftright(d0, 1)
            bit = F.call_function("shiftleft", whole(1), F.greatest(m - j + most, F.lit(0)))
            down = F.when(d0.bitwiseAND(last) != 0, 0).otherwise(1)
            along = F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
            vertical = hn.bitwiseOR(F.bitwise_not(shifted.bitwiseOR(hp))).bitwiseAND(full)
            return F.struct(vertical.alias("vp"), shifted.bitwiseAND(hp).alias("vn"), (state["dist"] + F.when(j <= m - most, down).otherwise(along)).cast("int").alias("dist"))

        d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(full)
        return F.get(F.transform(F.array(d0), diagonal), 0)

    start = F.struct(whole(((1 << (most + 1)) - 1) << most).alias("vp"), whole(0).alias("vn"), F.least(F.lit(most), m).cast("int").alias("dist"))
    run = F.aggregate(matches, start, column, lambda state: state["dist"] <= most)
    return F.when(F.abs(m - n) > most, False).when((m == 0) | (n == 0), True).otherwise(run)


def likely(a: Column, b: Column) -> Column:
    """False only for texts more than one edit apart. Of PIECES pieces of `a` one edit touches one at most;
    every other piece stands in `b` at its place, or as much further as b is longer."""
    m, n = F.length(a), F.length(b)
    missing = F.lit(0)
    for k in range(PIECES):
        start, stop = F.floor(k * m / PIECES).cast("int"), F.floor((k + 1) * m / PIECES).cast("int")
        piece, size = a.substr(start + 1, stop - start), stop - start
        moved = F.when(start + n - m >= 0, b.substr(start + 1 + n - m, size) == piece).otherwise(False)
        missing = missing + F.when((b.substr(start + 1, size) == piece) | moved, 0).otherwise(1)
    return (F.abs(m - n) <= 1) & (missing <= 1)


def _key(length: Column, segment: Column, segments: Column, drop: int) -> Column:
    """What stands before and behind the segment of a line; drop 1: as if it were one character shorter."""
    start, stop = F.floor(segment * length / segments).cast("int"), F.floor((segment + 1) * length / segments).cast("int")
    behind = (length - stop).cast("int")
    before = F.col("line").substr(F.lit(1), start)
    after = F.when(behind > 0, F.col("line").substr(length + drop - behind + 1, behind)).otherwise("")
    return F.xxhash64(length, segment, before, after)


def entries(found: DataFrame, most: int) -> DataFrame:
    """(key, h, other): each line (h, line, size) under its own keys, and under those of shorter lines (other)."""
    size = F.col("size")

    def keys(length: Column, drop: int) -> Column:
        n = F.least(F.lit(most), length)
        return F.when(length > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(_key(length, i, n, drop).alias("key"), F.lit(bool(drop)).alias("other"))))

    none = F.array().cast("array<struct<key:bigint,other:boolean>>")
    both = F.concat(F.coalesce(keys(size, 0), none), F.coalesce(keys(size - 1, 1), none))
    return found.select("h", F.explode(both).alias("_")).select("_.key", "h", "_.other")


def _texts(df: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(h, line, size, first) of the lines whose h is in ids."""
    ids = cut_lineage(ids.select("h").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    found = df.filter(editable(least)).join(ids, "h", "left_semi")
    return found.groupBy("h").agg(F.min("line").alias("line"), F.min("size").alias("size"), F.min(F.struct("doc_id", "row", "no")).alias("first"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(h) of the later line of each pair (a, b) that is one edit apart."""
    one = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"), F.col("first").alias("first_a"))
    two = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"), F.col("first").alias("first_b"))
    near = pairs.join(one, "a").join(two, "b").filter(F.when(likely(F.col("line_a"), F.col("line_b")), within(F.col("line_a"), F.col("line_b"))).otherwise(False))
    return near.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("h"))


def _by_character(texts: DataFrame) -> DataFrame:
    """Pairs (a, b): each line and the earliest one that is one edit away by a key, if earlier.

    A line without its i-th character is the same for lines that differ there only (key
    with i), and is the other line where that one has a character less (key without i).
    """
    cut = F.concat(F.col("line").substr(F.lit(1), F.col("i") - 1), F.expr("substring(line, i + 1)"))
    each = texts.select("h", "line", "size", "first", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i")).select("h", "first", "size", "i", once(cut).alias("cut"))
    at = F.struct("first", "h").alias("at")
    same = each.select(at, F.xxhash64(F.lit("other"), "i", "size", "cut").alias("key"), F.lit(0).alias("kind"))
    less = each.select(at, F.xxhash64(F.lit("less"), F.col("size") - 1, "cut").alias("key"), F.lit(1).alias("kind"))
    whole = texts.select(at, F.xxhash64(F.lit("less"), "size", "line").alias("key"), F.lit(2).alias("kind"))
    rows = cut_lineage(same.union(less).union(whole))
    lows = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"low{k}") for k in range(3)])
    lows = cut_lineage(lows.filter("n > 1"))
    against = F.when(F.col("kind") == 0, F.col("low0")).when(F.col("kind") == 1, F.col("low2")).otherwise(F.col("low1"))
    met = salted(rows, lows, ["key"], F.pmod("at.h", F.lit(1 << 20)).cast("int")).select("at", against.alias("other")).filter("other.first < at.first")
    # the earliest over all keys is one edit away as well, so one pair for each line is enough
    return met.groupBy(F.col("at.h").alias("b")).agg(F.min("other").alias("other")).select(F.col("other.h").alias("a"), "b")


def later(df: DataFrame, least: int = 1) -> DataFrame:
    """(h) of the distinct lines one edit away from a line that comes first before them."""
    good = df.filter(editable(least))
    keyed = entries(good.select("h", "line", "size"), SEGMENTS[0])
    found = None
    for level in range(len(SEGMENTS)):
        keyed = keyed.distinct()
        counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("other")).alias("own")).filter("n > 1 and own > 0")
        shared = cut_lineage(keyed.join(counts, "key").select("key", "h", "other", "n"))
        few = shared.filter(F.col("n") <= CROWD)
        a, b = few.filter("not other").select("key", F.col("h").alias("a")), few.select("key", F.col("h").alias("b"), "other")
        pairs = a.join(b, "key").filter("a <> b and (other or a < b)").select("a", "b").distinct()
        texts = cut_lineage(_texts(df, shared, least))
        near = _verified(pairs, texts)
        found = near if found is None else found.union(near)
        crowded = texts.join(shared.filter(F.col("n") > CROWD).select("h").distinct(), "h", "left_semi")
        if level + 1 < len(SEGMENTS):
            keyed = entries(crowded, SEGMENTS[level + 1])
    if crowded.limit(1).count():
        found = found.union(_verified(_by_character(crowded), crowded))
    return found.distinct()


def dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least_words: int = 1) -> DataFrame:
    """Leaves out of each text the lines that came before.

    A line that isn't blank came before if a copy of it, or, for lines of EDIT_WORDS words
    or EDIT_CHARS characters, a line one edit away, stands in a document of lower doc_id
    (null lowest, then by a hash of doc_id and text) or further up in the same one. Lines
    of fewer than `least_words` words may be let alone. The texts keep their order of
    lines; a text all of whose lines came before becomes empty, null stays null, and no
    row goes. Of rows with the same doc_id and text, null included, only one could keep
    its lines, so these are left alike. Adds n_lines and n_removed; columns of these
    names are replaced.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    found = lines(df, text, doc_id)
    good = found.filter(eligible(least_words)).select("doc_id", "row", "no", "h")
    first = good.groupBy("h").agg(F.min(F.struct("doc_id", "row", "no")).alias("first"), F.count(F.lit(1)).alias("n"))
    gone = later(found, least_words).withColumn("gone", F.lit(True))
    state = first.join(gone, "h", "left").select("h", "first", "n", F.coalesce("gone", F.lit(False)).alias("gone"))
    state = cut_lineage(state.filter("n > 1 or gone"))  # all other lines are the first and only ones
    out = salted(good, state, ["h"], F.pmod(F.xxhash64("row", "no"), F.lit(1 << 20)).cast("int"))
    out = out.filter(F.col("gone") | ~F.col("first").eqNullSafe(F.struct("doc_id", "row", "no")))
    out = out.groupBy("row").agg(F.array_sort(F.collect_set("no")).alias("gone"))
    marked = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("in"), F.col(text).alias("text"), F.xxhash64(F.lit(3), F.col(doc_id), F.col(text)).alias("row"))
    split = marked.join(out, "row", "left").withColumn("lines", once(F.split("text", "\n"))).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # the lines between two that go are taken together, so the work is in proportion to the text
    bounds = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))
    split = split.withColumn("bounds", once(bounds))
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice("lines", F.get("bounds", i) + 2, F.get("bounds", i + 1) - F.get("bounds", i) - 1))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    counted = [F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed")]
    return split.select(*[kept.alias(c) if c == text else F.col("in")[c].alias(c) for c in names], *counted)
