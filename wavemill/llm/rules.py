"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Statistics of whole texts are built-in expressions. From the statistics of labelled
texts, rules for the rejected class are grown condition by condition (information
gain), pruned on held-out rows and kept while they are precise; what they cover is
set aside before the next rule. The list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, words

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may ask for, from the statistics.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_lines_per_word", "repeat_share")
WINDOW = 8
#: At most so many labelled rows are learned from, chosen by a hash of their doc_id.
SAMPLE_ROWS = 20_000


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns STATISTICS (long) of the whole text; all are 0 for null.

    n_repeat_words counts the words inside windows of eight words found twice or more
    in the text. Windows are compared by 64-bit hashes of their words' hashes: sorted
    with their places only where two are equal, so the work is n log n at any length.
    Columns of these names are replaced; repeated rows stay.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in STATISTICS]
    whole = F.coalesce("text", F.lit(""))
    df = df.select((F.struct(*kept) if kept else F.lit(None)).alias("in"), F.col(text).alias("text"))
    df = df.withColumn("_words", once(words(F.col("text")))).withColumn("_lines", once(F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    df = df.withColumn("_hashes", once(F.transform("_words", lambda w: F.xxhash64(w))))
    n = F.size("_hashes")
    df = df.withColumn("_windows", once(F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))))))
    df = df.withColumn("_again", F.size("_windows") > F.size(F.array_distinct("_windows")))
    df = df.withColumn("_sorted", once(F.when(F.col("_again"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_found", once(F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_found", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return df.select(
        *(["in.*"] if kept else []),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """FEATURES as expressions over STATISTICS; rates are 0 for a text without words."""
    rate = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    each = (F.col("n_words").cast("double"), rate("word_chars"), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words"))
    return dict(zip(FEATURES, each))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for condition in rule:
        held &= condition.holds(x)
    return held


def _grow(x: np.ndarray, y: np.ndarray, most: int, cuts: int) -> Rule:
    """Adds the condition of the highest information gain until no rejected-class error is left."""
    rule: Rule = ()
    while len(rule) < most:
        p, n = y.sum(), (~y).sum()
        if not n or not p:
            break
        best, base = (1e-9, None), math.log2(p / (p + n))
        for k, name in enumerate(FEATURES):
            values = np.unique(x[:, k])
            if len(values) < 2:
                continue
            middles = (values[1:] + values[:-1]) / 2
            order = np.argsort(x[:, k], kind="stable")
            rejected = np.concatenate([[0], np.cumsum(y[order])])
            for t in middles if len(middles) <= cuts else middles[np.linspace(0, len(middles) - 1, cuts).astype(int)]:
                at = np.searchsorted(x[order, k], t, side="right")
                for above in (True, False):
                    q, size = (p - rejected[at], len(y) - at) if above else (rejected[at], at)
                    if q > 0 and (gain := q * (math.log2(q / size) - base)) > best[0]:
                        best = gain, Condition(name, above, float(t))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        held = best[1].holds(x)
        x, y = x[held], y[held]
    return rule


def learn(x: np.ndarray, rejected: np.ndarray, held_out: np.ndarray, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.95, cuts: int = 256) -> list[Rule]:
    """An ordered list of conjunctions that reject; precise on held-out rows, else left out.

    Pruning drops final conditions while (p - n) / (p + n) on held-out rows doesn't fall.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and rejected[left & ~held_out].any():
        grow, prune = left & ~held_out, left & held_out
        rule = _grow(x[grow], rejected[grow], most_conditions, cuts)
        if not rule:
            break

        def worth(r: Rule, at: np.ndarray = prune) -> float:
            held = _covered(r, x[at])
            p = rejected[at][held].sum()
            return (2 * p - held.sum()) / max(1, held.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        held = _covered(rule, x) & left
        if held.sum() < 4 or rejected[held].mean() < precision or (worth(rule) + 1) / 2 < precision:
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    """Learns from at most sample_rows labelled documents (label quality 0: rejected).

    Rows without doc_id or label are passed over; of several labels of a document the
    lowest counts. Without labels, or without documents of either class, no rule is
    learned. Of documents of the same doc_id one counts, that of the least statistics.
    The driver gets sample_rows rows of five numbers at most.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # the bound of what is broadcast
    marked = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    got = statistics(marked).filter(~base_failed())
    one = F.struct("_quality", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)).alias("_part"), *[c.alias(n) for n, c in features().items()])
    rows = [r["one"] for r in got.groupBy("doc_id").agg(F.min(one).alias("one")).collect()]
    if not rows:
        return []
    table = np.array(sorted(tuple(map(float, r)) for r in rows))
    return learn(table[:, 2:], table[:, 0] == 0, table[:, 1] == 0)


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: the first rule that holds rejects; true if none does."""
    kept = F.lit(True)
    for rule in reversed(rules):
        condition = rule[0].column()
        for further in rule[1:]:
            condition &= further.column()
        kept = F.when(condition, F.lit(False)).otherwise(kept)
    return kept


def judge(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds STATISTICS, base_failed and kept; columns of these names are replaced."""
    out = statistics(df.drop("base_failed", "kept"), text).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
