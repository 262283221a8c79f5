"""Licence scan: headers and licence files to templates by sparse TF-IDF cosine, then inheritance by directories.

Three kinds of passages are compared: lines with a licence word, the comment that a
file begins with, and the whole text of a licence file, whatever its words. Passages and
templates are sparse vectors of terms, weighted by how rare a term is among all passages
of the corpus; a passage is of the template with the largest cosine, if that is large
enough. A file has the licence of its best passage; a file without one has that of the
nearest directory above it that holds a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, salted
from .licence_texts import TEMPLATES

#: What a line with a licence word holds, in lower case (fixed values).
MARKS = ("license", "licence", "copyright", "spdx")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
#: The lines that a file begins with, blank or led by a comment mark, or up to the end of a block comment.
COMMENT = r"^(?:[ \t]*(?:(?:#|//|--|;|%|\*)[^\n]*)?(?:\n|\z)|[ \t]*(?:/\*|<!--)(?s:.*?)(?:\*/|-->))+"
LEAST = 0.6


def speaks(text: Column) -> Column:
    """Whether a text holds a licence word."""
    low = F.lower(text)
    found = low.contains(MARKS[0])
    for mark in MARKS[1:]:
        found = found | low.contains(mark)
    return F.coalesce(found, F.lit(False))


def passages(path: Column, text: Column) -> Column:
    """An array of what is compared of a file."""
    none = F.array().cast("array<string>")
    lines = F.when(speaks(text), F.filter(F.split(text, "\n"), speaks)).otherwise(none)
    comment = F.regexp_extract(text, COMMENT + "+", 0)  # possessive, so that no length is too much for the stack
    header = F.when(comment.rlike("[A-Za-z0-9]"), F.array(comment)).otherwise(none)
    whole = F.when(path.rlike(FILE) & text.isNotNull(), F.array(text)).otherwise(none)
    return F.concat(*[F.coalesce(part, none) for part in (lines, header, whole)])


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf); a term is told by its 64-bit hash."""
    found = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy(key, F.xxhash64("term").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def match(found: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(unit, n, licence, score) of the passages that match; from (unit, passage), one row each
    time that the passage `unit` occurs, n times in all."""
    spark = found.sparkSession
    counted = cut_lineage(found.groupBy("unit").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # copies of a passage add up to n times its terms, so they meet before the shuffle
    terms = cut_lineage(_terms(found, "unit", "passage").join(counted, "unit").select("unit", "term", (F.col("tf") / F.col("n")).alias("tf"), "n"))
    rarity = cut_lineage(terms.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("n")))
    weight = F.col("tf") * (F.log(F.lit(1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0)
    ours = salted(terms.select("unit", "term", "tf"), rarity, ["term"], F.col("unit")).select("unit", "term", weight.alias("w"))
    given = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "no int, licence string, template string")
    table = _terms(given, "no", "template").join(rarity, "term", "left")
    theirs = cut_lineage(table.select("no", "term", weight.alias("v")))  # as small as `templates`
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    lists = theirs.groupBy("term").agg(F.collect_list(F.struct("no", "v")).alias("in"))
    # one row for each term of a passage; what templates make of it follows only where one has the term
    marked = cut_lineage(ours.join(F.broadcast(lists), "term", "left").select("unit", "w", "in"))
    dots = marked.filter("in is not null").select("unit", "w", F.inline("in")).groupBy("unit", "no").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    dots = dots.join(F.broadcast(theirs.groupBy("no").agg(length("v").alias("b"))), "no").join(F.broadcast(given.select("no", "licence")), "no")
    scored = dots.join(marked.groupBy("unit").agg(length("w").alias("a")), "unit").withColumn("score", F.round(F.col("dot") / (F.col("a") * F.col("b")), 6))
    best = scored.filter(F.col("score") >= least).groupBy("unit").agg(F.max(F.struct("score", "licence")).alias("_"))
    return best.join(counted, "unit").select("unit", "n", "_.licence", "_.score")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """Adds licence, score, origin (own, directory or null) and licence_from (the directory).

    Whole texts are searched. Of several passages or licence files the one with the
    highest score counts, then the last licence by the alphabet. A null path is a file
    of its own in no directory; files of the same path count together; a null or empty
    text has no passage; rows and other columns stay, columns of these names are replaced.
    """
    names = [c for c in files.columns if c not in ("licence", "score", "origin", "licence_from")]
    given, words = F.col(path), F.col(text)
    # a file without a path is told by its text
    key = F.coalesce(given, F.concat(F.lit("\0"), F.xxhash64(words).cast("string")))
    found = files.select(key.alias("key"), F.explode(passages(given, words)).alias("passage"))
    found = found.select("key", F.xxhash64("passage").alias("unit"), "passage")
    matched = cut_lineage(match(found.select("unit", "passage"), templates, least))
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 20)).cast("int")
    own = cut_lineage(salted(found.select("key", "unit"), matched, ["unit"], spread).groupBy("key").agg(F.max(F.struct("score", "licence")).alias("own")))
    paths = cut_lineage(files.groupBy(key.alias("key"), F.coalesce(_folder(given), key).alias("folder")).agg(F.count(F.lit(1)).alias("n")))
    folders = own.filter(F.col("key").rlike(FILE)).groupBy(_folder(F.col("key")).alias("above")).agg(F.max("own").alias("theirs"))
    parts = F.split("folder", "/")
    up = paths.filter(~F.col("folder").startswith("\0")).groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    up = up.select("folder", "n", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    up = up.select("folder", "n", "depth", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("above")).filter("depth = 0 or above <> ''")
    nested = up.join(folders.groupBy("above").agg(F.max("theirs").alias("theirs")), "above")
    nearest = cut_lineage(nested.groupBy("folder", "n").agg(F.max(F.struct("depth", "above", "theirs")).alias("near")))
    keyed = salted(paths, nearest, ["folder"], spread, "left").join(own, "key", "left").filter("own is not null or near is not null")
    mine = F.col("own").isNotNull()
    best = F.coalesce("own", "near.theirs")
    keyed = cut_lineage(keyed.select("key", "n", best["licence"].alias("licence"), best["score"].alias("score"), F.when(mine, "own").otherwise("directory").alias("origin"), F.when(~mine, F.col("near.above")).alias("licence_from")))
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_in"), key.alias("key"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int")  # which task a row goes to makes no difference
    return salted(rows, keyed, ["key"], salt, "left").select("_in.*", "licence", "score", "origin", "licence_from")
