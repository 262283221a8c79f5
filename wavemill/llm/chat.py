"""Transcripts to turns: a hidden Markov model over lines, read by Viterbi, then canonical rendering.

Each line of a transcript is in one of six states: the first line of a turn, or a
further one, of the system, the user or the assistant. What is seen of a line is the
class of its speaker marker and plain features. Probabilities are counted, over all
given transcripts with known turns, and smoothed; decoding finds the most likely
sequence of states, so a turn without a marker is told by its place and its lines.

A conversation of any length is held in parts. What a part does to scores is one small
matrix; along the matrices of a conversation the best states at the parts' ends are
found, and each part is decoded between them, as if it hadn't been cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

ROLES = ("system", "user", "assistant")
#: Speaker names (fixed values).
NAMES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "you", "me"),
    "assistant": ("assistant", "ai", "answer", "a", "bot", "model", "agent"),
}
_CLASS = {name: i + 1 for i, role in enumerate(ROLES) for name in NAMES[role]}
MARKER = re.compile(rf"^\s*[*#\[<(]*\s*({'|'.join(sorted(_CLASS, key=len, reverse=True))})\s*[*\])>]*\s*[:>\]]+[* ]*", re.I)
SOME_MARKER = re.compile(r"^[A-Z][A-Za-z]{0,20}: ")
#: How many values each feature of a line has: marker class, blank line before, length, question, first line.
VALUES = (5, 2, 4, 2, 2)
#: A conversation's turns are held together in parts of this many by their number.
PART = 4096


def observe(lines: list[str], first: bool = True) -> np.ndarray:
    """One row of features for each line that isn't blank; first: a conversation begins here."""
    out, blank = [], False
    for line in lines:
        if not line.strip():
            blank = True
            continue
        found = MARKER.match(line)
        mark = _CLASS[found[1].lower()] if found else 4 if SOME_MARKER.match(line) else 0
        n = len(line)
        out.append((mark, int(blank), int(n > 40) + int(n > 120) + int(n > 400), int(line.rstrip().endswith("?")), int(first and not out)))
        blank = False
    return np.array(out, np.int64).reshape(-1, len(VALUES))


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: tuple[np.ndarray, ...]

    @staticmethod
    def of(counts: dict[tuple[int, int, int], int]) -> Model:
        """From (kind, from, to) -> count; kinds: 0 starts, 1 moves, 2.. features. One is added to each."""
        start, move, emit = np.ones(6), np.ones((6, 6)), [np.ones((6, n)) for n in VALUES]
        for (kind, a, b), n in counts.items():
            if kind == 0:
                start[b] += n
            elif kind == 1:
                move[a, b] += n
            else:
                emit[kind - 2][a, b] += n
        log = lambda m: np.log(m / m.sum(-1, keepdims=True))
        return Model(log(start), log(move), tuple(log(m) for m in emit))

    def _fit(self, seen: np.ndarray) -> np.ndarray:
        return sum(m[:, seen[:, k]].T for k, m in enumerate(self.emit))

    def passage(self, seen: np.ndarray, first: bool = True) -> np.ndarray:
        """The best score from each state before these lines (first: from none, in each row) to each state after them."""
        if not len(seen):
            return np.zeros((6, 6)) if first else np.where(np.eye(6, dtype=bool), 0.0, -np.inf)
        fit = self._fit(seen)
        score = np.tile(self.start, (6, 1)) + fit[0] if first else self.move + fit[0]
        for t in range(1, len(seen)):
            score = (score[:, :, None] + self.move).max(1) + fit[t]
        return score

    def decode(self, seen: np.ndarray, before: int = -1, after: int = -1) -> list[int]:
        """The most likely states (2 * role + 1 for further lines); of equal ones the lower number.

        before: the state of the line before (-1: none); after: the state of the last line (-1: any).
        """
        if not len(seen):
            return []
        fit = self._fit(seen)
        score, back = (self.start if before < 0 else self.move[before]) + fit[0], np.empty((len(seen), 6), np.int8)
        for t in range(1, len(seen)):
            ways = score[:, None] + self.move
            back[t] = ways.argmax(0)
            score = ways.max(0) + fit[t]
        path = [int(score.argmax()) if after < 0 else after]
        for t in range(len(seen) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return path[::-1]


def turns(model: Model, transcript: str | None, before: int = -1, after: int = -1) -> list[tuple[str, str]]:
    """(role, text) of each turn; known markers at a turn's start are taken off. Null or blank: no turn.

    before, after: the states at the ends of a part, as in decode.
    """
    out: list[tuple[str, list[str]]] = []
    lines = (transcript or "").split("\n")
    states = iter(model.decode(observe(lines, before < 0), before, after))
    for line in lines:
        if not line.strip():
            if out:
                out[-1][1].append(line)
            continue
        state = next(states)
        role = ROLES[state // 2]
        if state % 2 == 0 or not out or out[-1][0] != role:
            out.append((role, []))
            line = MARKER.sub("", line, count=1)
        out[-1][1].append(line)
    return [(role, "\n".join(text).strip()) for role, text in out]


def fit(conversations: DataFrame, style: Column) -> Model:
    """Counts over all conversations (part_no, turns), written in the style of `transcripts`.

    Rows without turns or of turns without a known role count for nothing, repeated rows
    each; a move from one part to the next isn't counted. The driver gets the counts only,
    at most 6 * (1 + 6 + all values) numbers.
    """
    written = conversations.select("part_no", F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), style_turn(style, t, i).alias("text"))).alias("turns"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for number, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines, states = [], []
                for turn in given or []:
                    if turn["role"] not in ROLES:
                        continue
                    first, at = True, 2 * ROLES.index(turn["role"])
                    for line in (turn["text"] or "").split("\n"):
                        lines.append(line)
                        if line.strip():
                            states.append(at if first else at + 1)
                            first = False
                seen = observe(lines, number == 0)
                for t, state in enumerate(states):
                    if t:
                        counts[1, states[t - 1], state] += 1
                    elif number == 0:
                        counts[0, 0, state] += 1
                    for k, v in enumerate(seen[t].tolist()):
                        counts[2 + k, state, v] += 1
        if counts:
            keys, n = list(counts), list(counts.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array(n, pa.int64())], names=["kind", "a", "b", "n"])

    counted = written.mapInArrow(count, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model.of({(r.kind, r.a, r.b): r.n for r in counted})


def gather(table: DataFrame) -> DataFrame:
    """(conv_id, part, part_no, parts, turns) from rows (conv_id, turn, role, text), turns in order.

    part_no counts a conversation's parts from 0, parts is how many it has. Exact
    repetitions of a row count once; rows without conv_id stand for themselves, as do turns
    without a number; turns of equal number are in the order of role and text.
    """
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    part = F.when(alone, F.xxhash64("conv_id", "turn", "role", "text")).otherwise(F.floor(F.col("turn") / PART))
    rows = table.select("conv_id", part.alias("part"), alone.alias("alone"), F.struct("turn", "role", "text").alias("t")).distinct()
    held = cut_lineage(rows.groupBy("conv_id", "part", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    slim = held.filter("not alone").select("conv_id", "part")
    cut = slim.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(slim, "conv_id")
    # a row for each PART turns of the conversations that have more, so a window over one is small
    each = Window.partitionBy("conv_id")
    cut = cut_lineage(cut.select("conv_id", "part", (F.row_number().over(each.orderBy("part")) - 1).alias("part_no"), F.col("n").cast("int").alias("parts")))
    numbered = held.filter("not alone").join(cut, ["conv_id", "part"], "left")
    out = numbered.unionByName(held.filter("alone"), allowMissingColumns=True)
    return out.select("conv_id", "part", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.coalesce("parts", F.lit(1)).alias("parts"), "turns")


#: How transcripts mark speakers: before system, user, assistant (fixed values).
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### system: ", "### human: ", "### ai: "),
    ("[context] ", "[question] ", "[answer] "),
    ("**System**: ", "**You**: ", "**Bot**: "),
    ("<system> ", "<user> ", "<model> "),
)


def style_turn(style: Column, turn: Column, i: Column) -> Column:
    """A turn as a transcript has it: marker and text, or, for some turns, a blank line and no marker."""
    marks = F.array(*[F.array(*[F.lit(m) for m in s]) for s in STYLES])
    role = F.when(turn["role"] == "system", 1).when(turn["role"] == "user", 2).otherwise(3)
    mark = F.element_at(F.element_at(marks, F.pmod(style, F.lit(len(STYLES))).cast("int") + 1), role)
    mark = F.when(turn["role"].isin(*ROLES), mark).when(turn["role"].isNull(), "\n").otherwise(F.concat(F.initcap(turn["role"]), F.lit(": ")))
    bare = (F.pmod(style + i * 7, F.lit(8)) == 0) & (i > 0)
    return F.concat(F.when(bare, F.lit("\n")).otherwise(mark), F.coalesce(turn["text"], F.lit("")))


def transcripts(conversations: DataFrame, style: Column) -> DataFrame:
    """Adds transcript: the turns written one below the other in a style that `style` (a number) chooses."""
    return conversations.withColumn("transcript", F.array_join(F.transform("turns", lambda t, i: style_turn(style, t, i)), "\n"))


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def parse(df: DataFrame, model: Model, transcript: str = "transcript", out: str = "parsed") -> DataFrame:
    """Adds the turns found, an array of (role, text), each row a whole transcript; empty for null and blank.

    `out` is replaced, other columns and repeated rows stay.
    """
    return _parsed(df, model, transcript, out, None, None)


def _parsed(df: DataFrame, model: Model, transcript: str, out: str, before: str | None, after: str | None) -> DataFrame:
    names = [c for c in df.columns if c not in (out, before, after)]
    kind = "array<struct<role:string,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            given = [column(transcript), *([column(before), column(after)] if before and after else [])]
            found = [[{"role": r, "text": t} for r, t in turns(model, *(v.as_py() for v in row))] for row in zip(*given)]
            yield pa.RecordBatch.from_arrays([*(column(c) for c in names), pa.array(found, _TURNS)], names=[*names, out])

    schema = df.select(*[f"`{c}`" for c in names]).withColumn(out, F.lit(None).cast(kind)).schema
    return df.mapInArrow(run, schema)


def parse_parts(df: DataFrame, model: Model, transcript: str = "transcript", out: str = "parsed", conv_id: str = "conv_id", part_no: str = "part_no", parts: str = "parts") -> DataFrame:
    """Like parse, where a conversation is cut into rows, numbered from 0: decoded as if it weren't.

    Conversations in one row are parsed as they are. Of the others, 36 numbers a part are
    passed along the conversation. `df` is read three times; a part's first turn may go
    on with the last one of the part before, where both have the same role.
    """
    cut = df.filter(F.col(parts) > 1)
    if not cut.limit(1).count():
        return parse(df, model, transcript, out)
    key = df.schema[conv_id].dataType.simpleString()

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.passage(observe((text.as_py() or "").split("\n"), no.as_py() == 0), no.as_py() == 0).ravel() for text, no in zip(batch.column(2), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tolist() for m in made], pa.list_(pa.float64()))], names=["c", "no", "m"])

    def ends(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("no")
        scores, froms = None, []
        for m in table["m"]:
            ways = np.asarray(m).reshape(6, 6) + (0 if scores is None else scores[:, None])
            froms.append(ways.argmax(0))
            scores = ways.max(0)
        after = [int(scores.argmax())]
        for way in reversed(froms[1:]):
            after.append(int(way[after[-1]]))
        after.reverse()
        return pd.DataFrame({"c": table["c"], "no": table["no"], "before": [-1, *after[:-1]], "after": after})

    slim = cut.select(F.col(conv_id).alias("c"), F.col(part_no).cast("int").alias("no"), F.col(transcript).alias("t"))
    matrices = cut_lineage(slim.mapInArrow(passages, f"c {key}, no int, m array<double>"))
    states = cut_lineage(matrices.groupBy("c").applyInPandas(ends, f"c {key}, no int, before int, after int"))
    names = [c for c in df.columns if c != out]
    rows = cut.select(*[F.col(f"`{c}`") for c in names])
    on = rows[conv_id].eqNullSafe(states["c"]) & (rows[part_no] == states["no"])
    joined = rows.join(states.select("c", "no", F.col("before").alias("_before"), F.col("after").alias("_after")), on).drop("c", "no")
    whole = parse(df.filter(F.col(parts) <= 1).select(*[F.col(f"`{c}`") for c in names]), model, transcript, out)
    return whole.unionByName(_parsed(joined, model, transcript, out, "_before", "_after"))


def render(parsed: Column) -> Column:
    """The canonical text: each turn between `<|role|>` and `<|end|>` lines; `<|` inside a text becomes `< |`."""
    each = F.transform(parsed, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit("\n<|end|>\n")))
    return F.array_join(each, "")
