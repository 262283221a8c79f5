"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key, divided by its quality weight, so that in
ascending order of keys a prefix is a weighted sample (Efraimidis and Spirakis).
Whole epochs of a source come first; what is left of its target is filled by the
prefix whose words come nearest to it. Sums by bucket of the key say in which bucket a
source's budget ends; that bucket is cut into buckets again until it is small, and only
what is left of it is sorted, so no source, however large, is sorted in one task. Exact
copies share a key: they count as one step of the sum, of which as many are taken as the
budget says.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, once, words

#: Ranges that the keys of a source are cut into at a time, until the last one holds at most EDGE_ROWS rows.
BUCKETS, EDGE_ROWS = 1024, 100_000

#: Up to so many sources their plan (some 60 bytes each) is broadcast; beyond it, a shuffled join.
BROADCAST_SOURCES = 100_000

#: Copies that are numbered in one task.
COPIES = 100_000

MEASURES = ("size", "draw", "draw_order")
RESULTS = ("source_size", "target", "times", "taken")


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, less the more of the signs `#*$%&|<>` there are for each word."""
    signs = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[#*$%&|<>]"))
    return 1.0 / (1.0 + signs / F.greatest(size, F.lit(1)))


def measure(df: DataFrame, seed: int = 7, text: str = "text", doc_id: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """Adds size (words of the text, none for null), draw (the exponential key) and draw_order (ties).

    The same row draws the same key in each run; exact repetitions of a row share it.
    Columns of these names are replaced.
    """
    names = [c for c in df.columns if c not in MEASURES]
    size = once(F.size(words(F.col(text))).cast("long"))
    df = df.select(*[f"`{c}`" for c in names]).withColumn("size", size).withColumn("draw_order", F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)))
    uniform = (F.shiftrightunsigned("draw_order", 11) + 0.5) / float(1 << 53)
    return df.withColumn("draw", -F.log(uniform) / (quality_weight(F.col(text), F.col("size")) if weight is None else weight))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, source: str = "source") -> DataFrame:
    """From (source, source_size), one row each: the words that each source is to give.

    Sources in the order of their code points, null last, weigh `weights`, repeated.
    They share `share` times all words; none gets over `most` times its own words and
    what is above goes to the others by weight. In closed form: the level at which
    min(most * size, level * weight) sums up to the total. There is one row for each
    source here, so the order and the running sums are over that small table.
    """
    total, limit = F.sum("source_size").over(Window.partitionBy()), F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(F.col(source).asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    numbered = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))).withColumn("_total", share * total)
    filled = numbered.withColumn("_limit", limit).withColumn("_full_at", F.col("_limit") / F.col("_weight"))
    below, whole = Window.orderBy("_full_at").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    filled = filled.withColumn("_left", F.sum("_weight").over(whole) - F.sum("_weight").over(below))
    filled = filled.withColumn("_full", F.sum("_limit").over(below) + F.col("_full_at") * F.col("_left") <= F.col("_total"))
    spare = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(whole), F.lit(0.0))
    level = spare / F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(whole)
    got = filled.withColumn("_level", level)
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_level") * F.col("_weight")))
    return got.select(source, "source_size", target.alias("target"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_source"].eqNullSafe(b["_of"])


def plan(measured: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, source: str = "source") -> DataFrame:
    """One row for each source: source_size, target, whole epochs and where the fractional one ends.

    `_end` is the last key taken, `_copies` the number of rows that share it and `_take`
    how many of them are taken. `measured` is read once and then once for each cut.
    """
    slim = measured.select(F.col(source).alias("_source"), "size", "draw", "draw_order")
    sources = slim.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"), F.min("draw").alias("_low"), F.max("draw").alias("_high"))
    sources = cut_lineage(sources)
    goal = targets(sources.select("_source", "source_size"), weights, share, most, "_source")
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = cut_lineage(goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")))
    few = goal.count() <= BROADCAST_SOURCES
    near = F.broadcast if few else lambda df: df
    edge = sources.select(F.col("_source").alias("_of"), "_n", "_low", "_high").join(goal.select("_source", "_rest"), F.expr("_of <=> _source")).filter("_rest > 0")
    edge = edge.select("_of", "_rest", F.lit(0).cast("long").alias("_before"), "_n", "_low", "_high")
    while True:
        edge = cut_lineage(edge)
        inside = slim.join(near(edge), _same(slim, edge) & F.col("draw").between(F.col("_low"), F.col("_high")))
        if not edge.filter((F.col("_n") > EDGE_ROWS) & (F.col("_low") < F.col("_high"))).limit(1).count():
            break
        place = F.floor((F.col("draw") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BUCKETS)
        bucket = F.when(F.col("_low") < F.col("_high"), F.least(place, F.lit(BUCKETS - 1))).otherwise(F.lit(0)).cast("int")
        cut = inside.groupBy("_of", "_rest", "_before", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n"), F.min("draw").alias("_low"), F.max("draw").alias("_high"))
        ahead = F.sum("_words").over(Window.partitionBy("_of").orderBy("_bucket")) - F.col("_words")
        cut = cut.withColumn("_before", F.col("_before") + ahead).filter("_before < _rest")
        edge = cut.groupBy("_of", "_rest").agg(F.max(F.struct("_bucket", "_before", "_n", "_low", "_high")).alias("_")).select("_of", "_rest", "_._before", "_._n", "_._low", "_._high")
    steps = inside.groupBy("_of", "_rest", "_before", "draw", "draw_order").agg(F.max("size").alias("_size"), F.count(F.lit(1)).alias("_copies"))
    ahead = F.sum(F.col("_size") * F.col("_copies")).over(Window.partitionBy("_of").orderBy("draw", "draw_order")) - F.col("_size") * F.col("_copies")
    steps = steps.withColumn("_left", F.col("_rest") - F.col("_before") - ahead).filter("_left > 0")
    take = F.when(F.col("_size") > 0, F.least(F.col("_copies"), F.round(F.col("_left") / F.col("_size")).cast("long"))).otherwise(F.col("_copies"))
    ends = steps.groupBy("_of").agg(F.max(F.struct("draw", "draw_order", F.col("_copies").alias("copies"), take.alias("take"))).alias("_"))
    ends = ends.select("_of", F.struct("_.draw", "_.draw_order").alias("_end"), F.col("_.copies").alias("_copies"), F.col("_.take").alias("_take"))
    out = goal.join(ends, _same(goal, ends), "left")
    return out.select("_source", "source_size", "target", "_epochs", "_end", "_copies", "_take")


def mix(measured: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """Adds source_size, target, times (how often the document is taken) and taken (words taken).

    A source without words has the target 0 and its documents are taken 0 times. Of
    exact copies at a source's end as many are taken as its budget says; which of them
    makes no difference. Columns of these names are replaced; repeated rows stay.
    """
    names = [c for c in measured.columns if c not in RESULTS]
    plan = cut_lineage(plan)
    near = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    df = measured.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), F.col(source).alias("_of"), "size", F.struct("draw", "draw_order").alias("_key"))
    df = df.join(near, _same(near, df))
    split = F.coalesce((F.col("_key") == F.col("_end")) & F.col("_take").between(1, F.col("_copies") - 1), F.lit(False))
    chosen = F.coalesce((F.col("_key") < F.col("_end")) | ((F.col("_key") == F.col("_end")) & (F.col("_take") > 0)), F.lit(False))
    if plan.filter(F.col("_take").between(1, F.col("_copies") - 1)).limit(1).count():
        # copies of one row, dealt to tasks of COPIES rows; each task takes its share of them
        deals = F.ceil(F.col("_copies") / COPIES)
        dealt = df.filter(split).withColumn("_deal", F.pmod(F.monotonically_increasing_id(), deals))
        number = F.row_number().over(Window.partitionBy("_of", "_deal").orderBy(F.lit(0)))
        share = F.floor(F.col("_take") / deals) + (F.col("_deal") < F.col("_take") % deals).cast("long")
        rows = df.filter(~split).withColumn("_chosen", chosen).unionByName(dealt.withColumn("_chosen", number <= share).drop("_deal"))
    else:
        rows = df.withColumn("_chosen", chosen)
    times = F.col("_epochs").cast("long") + F.col("_chosen").cast("long")
    return rows.select("_row.*", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as `times` says; not at all for 0 or null. Repeated rows are each repeated."""
    each = mixed.select(F.struct(*[f"`{c}`" for c in mixed.columns]).alias("_row"), F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times").cast("int")))))
    return each.select("_row.*")
