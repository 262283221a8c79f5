"""Catalogues of pipeline definitions: edges checked, parameters filled in, paths listed; and running chains."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import settle

SCHEMA = """definition string, apiVersion int, nodes array<struct<node:string,operator:string,parameters:map<string,string>>>,
edges array<struct<source:string,target:string>>"""

PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"


def chain(*steps: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
    """One step after the other; None is a step left out."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df if step is None else step(df)
        return df

    return run


def unknown_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (definition, source, target) one of whose ends is no node (definition, node)."""
    ends = edges.withColumn("node", F.explode(F.array("source", "target")))
    return ends.join(nodes, ["definition", "node"], "left_anti").select("definition", "source", "target", "node")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no edge's target."""
    targets = edges.select("definition", F.col("target").alias("node")).distinct()
    return nodes.join(targets, ["definition", "node"], "left_anti")


def paths(nodes: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(definition, path, node, cycle): every way from a root on; a node seen before ends it as a cycle.

    Joins edges to the ends of the ways found, step by step, for `most` steps at most.
    """
    step = roots(nodes, edges).select("definition", F.array("node").alias("path"), "node", F.lit(False).alias("cycle"))
    out, links = step, edges.select("definition", F.col("source").alias("node"), F.col("target").alias("to"))
    for _ in range(most):
        step = step.filter("not cycle").join(links, ["definition", "node"])
        step = settle(step.select("definition", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("node"), F.array_contains("path", F.col("to")).alias("cycle")))
        if not step.limit(1).count():
            return out
        out = out.unionByName(step)
    raise ValueError(f"ways of over {most} steps")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Definitions from JSON files, one in each, with `problem`: why one can't be used, null if it can."""
    raw = spark.read.schema(SCHEMA + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    names = F.transform("nodes", lambda n: n["node"])
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["source"], e["target"])))
    problem = (
        F.when(F.col("_corrupt").isNotNull(), "no JSON of this form")
        .when(F.col("definition").isNull(), "no name")
        .when(F.coalesce("apiVersion", F.lit(0)) != 1, "unknown version")
        .when(F.coalesce(F.size("nodes"), F.lit(0)) < 1, "no nodes")
        .when(F.exists("nodes", lambda n: n["node"].isNull() | n["operator"].isNull()), "a node without name or operator")
        .when(F.size(F.array_distinct(names)) < F.size(names), "a node's name twice")
        .when(F.size(F.array_except(F.coalesce(ends, F.array().cast("array<string>")), names)) > 0, "an edge to no node")
    )
    return raw.withColumn("problem", problem).drop("_corrupt")


def _steps(operators: Mapping[str, Callable[..., DataFrame]], definition, given: Mapping[str, str] | None) -> tuple[dict[str, Callable[[DataFrame], DataFrame]], dict[str, list[str]]]:
    """Each node as a function of a frame, its parameters filled in; and the nodes behind each node."""
    nodes = {n["node"]: n for n in definition["nodes"]}
    texts = [v for n in nodes.values() for v in (n["parameters"] or {}).values()]
    named, given = {m for v in texts for m in re.findall(PLACEHOLDER, v)}, dict(given or {})
    if named != set(given):
        raise ValueError(f"parameters not given: {sorted(named - set(given))}, not named: {sorted(set(given) - named)}")
    steps = {}
    for name, node in nodes.items():
        if node["operator"] not in operators:
            raise ValueError(f"no such operator: {node['operator']}")
        filled = {k: _number(re.sub(PLACEHOLDER, lambda m: given[m[1]], v)) for k, v in (node["parameters"] or {}).items()}
        steps[name] = functools.partial(operators[node["operator"]], **filled)
    after: dict[str, list[str]] = {n: [] for n in nodes}
    for edge in definition["edges"] or []:
        if not {edge["source"], edge["target"]} <= set(nodes):
            raise ValueError(f"an edge to no node: {edge['source']} - {edge['target']}")
        after[edge["source"]].append(edge["target"])
    return steps, after


def branches(operators: Mapping[str, Callable[..., DataFrame]], definition, given: Mapping[str, str] | None = None) -> Callable[[DataFrame | Mapping[str, DataFrame]], dict[tuple[str, ...], DataFrame]]:
    """One definition (a row of `load`) as a function from its roots' frames to its targets' frames.

    A root is no edge's target, a target has no way on; a frame goes through the operators
    along each way between them. The result has a frame for each such way, keyed by its nodes.
    What ways begin with in common runs once: where they part, rows are written to the
    checkpoint folder and read from there by each. Given one frame, all roots read it.
    Parameters are filled in from `given` and passed by name, numbers as numbers. Errors: names
    in {{…}} that aren't given, given ones that nothing names, unknown operators or nodes,
    cycles, roots without a frame.
    """
    steps, after = _steps(operators, definition, given)
    begins = [n for n in steps if not any(n in to for to in after.values())]
    seen: set[str] = set()

    def check(way: tuple[str, ...]) -> None:
        seen.add(way[-1])
        for n in after[way[-1]]:
            if n in way:
                raise ValueError(f"a cycle: {' - '.join((*way, n))}")
            check((*way, n))

    for root in begins:
        check((root,))
    if seen != set(steps):
        raise ValueError(f"a cycle, or no root, before {sorted(set(steps) - seen)}")

    def run(frames: DataFrame | Mapping[str, DataFrame]) -> dict[tuple[str, ...], DataFrame]:
        given_frames = frames if isinstance(frames, Mapping) else dict.fromkeys(begins, frames)
        if missing := set(begins) - set(given_frames):
            raise ValueError(f"roots without a frame: {sorted(missing)}")
        out: dict[tuple[str, ...], DataFrame] = {}

        def follow(way: tuple[str, ...], df: DataFrame) -> None:
            df = steps[way[-1]](df)
            on = after[way[-1]]
            if not on:
                out[way] = df
            elif len(on) > 1:
                df = settle(df)
            for n in on:
                follow((*way, n), df)

        for root in begins:
            follow((root,), given_frames[root])
        return out

    return run


def pipeline(operators: Mapping[str, Callable[..., DataFrame]], definition, given: Mapping[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A definition that is one line, as a function of a frame; errors as in `branches`, and for other graphs."""
    steps, after = _steps(operators, definition, given)
    targets = [n for to in after.values() for n in to]
    if any(len(to) > 1 for to in after.values()):
        raise ValueError("two ways on; see branches")
    if len(begin := [n for n in steps if n not in targets]) != 1:
        raise ValueError(f"{len(begin)} roots; see branches")
    line = begin
    while after[line[-1]]:
        line.append(after[line[-1]][0])
        if len(line) > len(steps):
            raise ValueError("a cycle")
    if len(line) < len(steps):
        raise ValueError(f"not on the line: {sorted(set(steps) - set(line))}")
    return chain(*[steps[n] for n in line])


def _number(text: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def placeholders(definitions: DataFrame, parameters: str = "parameters") -> DataFrame:
    """(definition, name): the distinct names in {{…}} among the values of a map."""
    values = F.explode(F.map_values(parameters))
    names = definitions.select("definition", values.alias("v")).select("definition", F.explode(F.regexp_extract_all("v", F.lit(PLACEHOLDER), F.lit(1))).alias("name"))
    return names.distinct().orderBy("definition", "name")


def substitute(definitions: DataFrame, given: Mapping[str, str], parameters: str = "parameters") -> DataFrame:
    """Fills {{name}} in; adds unbound, the names that weren't given."""
    def fill(_, value):
        for name, text in given.items():
            value = F.regexp_replace(value, r"\{\{\s*" + name + r"\s*\}\}", F.lit(text.replace("\\", "\\\\").replace("$", "\\$")))
        return value

    out = definitions.withColumn(parameters, F.transform_values(parameters, fill))
    left = F.flatten(F.transform(F.map_values(parameters), lambda v: F.regexp_extract_all(v, F.lit(PLACEHOLDER), F.lit(1))))
    return out.withColumn("unbound", F.array_sort(F.array_distinct(left)))


def parse_options(pairs: list[str]) -> dict[str, str]:
    """name=value arguments; a name without value or given twice is an error."""
    out: dict[str, str] = {}
    for pair in pairs:
        name, sign, value = pair.partition("=")
        if not sign or not name or name in out:
            raise ValueError(f"bad or repeated option: {pair}")
        out[name] = value
    return out
