import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.jobs import definitions
from wavemill.operators import segments
from wavemill.sources import wav

OPERATORS = {"add": lambda df, n=1: df.withColumn("x", F.col("x") + n), "times": lambda df, n: df.withColumn("x", F.col("x") * n), "keep": lambda df: df}


def defined(nodes, edges):
    return {"nodes": [{"node": n, "operator": o, "parameters": p} for n, o, p in nodes], "edges": [{"source": a, "target": b} for a, b in edges]}


def test_diamond_two_roots_three_targets(spark):
    read = spark.sparkContext.accumulator(0)

    def scanned(df):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    nodes = [("in", "scan", None), ("a", "add", {"n": "{{step}}"}), ("b", "times", {"n": "10"}), ("c", "times", {"n": "100"}), ("d", "keep", {}), ("other", "scan", {}), ("e", "add", {"n": "7"}), ("f", "keep", {})]
    graph = defined(nodes, [("in", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("in", "f"), ("other", "e")])
    run = definitions.branches(OPERATORS | {"scan": scanned}, graph, {"step": "2"})
    out = run({"in": spark.createDataFrame([(1,), (2,)], "x int"), "other": spark.createDataFrame([(5,)], "x int")})
    got = {way: sorted(r.x for r in df.collect()) for way, df in out.items()}
    assert got == {("in", "a", "b", "d"): [30, 40], ("in", "a", "c", "d"): [300, 400], ("in", "f"): [1, 2], ("other", "e"): [12]}
    assert read.value == 3  # each source once


@pytest.mark.parametrize(
    ("nodes", "edges", "given", "said"),
    [
        ([("a", "keep", {})], [("a", "zz")], {}, "no node"),
        ([("a", "nothing", {})], [], {}, "no such operator"),
        ([("a", "keep", {}), ("b", "keep", {}), ("c", "keep", {})], [("a", "b"), ("b", "c"), ("c", "b")], {}, "cycle"),
        ([("a", "keep", {}), ("b", "keep", {})], [("a", "b"), ("b", "a")], {}, "no root"),
        ([("a", "add", {"n": "{{n}}"})], [], {}, "not given"),
        ([("a", "keep", {})], [], {"n": "1"}, "not named"),
    ],
)
def test_broken_graphs(nodes, edges, given, said):
    with pytest.raises(ValueError, match=said):
        definitions.branches(OPERATORS, defined(nodes, edges), given)


def test_a_root_without_a_frame(spark):
    run = definitions.branches(OPERATORS, defined([("a", "keep", {}), ("b", "keep", {})], []))
    with pytest.raises(ValueError, match="without a frame"):
        run({"a": spark.range(1)})
    assert set(run(spark.range(1))) == {("a",), ("b",)}


def test_lines_stay_lines(spark):
    line = defined([("a", "add", {"n": "1"}), ("b", "times", {"n": "3"})], [("a", "b")])
    assert definitions.pipeline(OPERATORS, line)(spark.createDataFrame([(1,)], "x int")).first().x == 6
    for nodes, edges in ((["a", "b", "c"], [("a", "b"), ("a", "c")]), (["a", "b"], []), (["a", "b", "c"], [("b", "c"), ("c", "b")])):
        with pytest.raises(ValueError):
            definitions.pipeline(OPERATORS, defined([(n, "keep", {}) for n in nodes], edges))


def blocks_of(spark, names):
    return spark.createDataFrame([(t, 0, i, i * 10, [0.1 * i] * 10) for t in names for i in range(3)], "track string, channel int, block_idx long, offset long, samples array<double>")


def test_written_tracks_may_have_folders(spark, tmp_path):
    names = ["a/x", "a/b/x", "x"]
    assert {r.track for r in wav.write(blocks_of(spark, names), str(tmp_path), 8000).collect()} == set(names)
    files = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert files == ["a/b/x.wav", "a/x.wav", "x.wav"]
    with pytest.raises(Exception, match="not a file's name"):
        wav.write(blocks_of(spark, ["../x"]), str(tmp_path / "in"), 8000).collect()


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    broken = blocks_of(spark, ["x"]).withColumn("samples", F.when(F.col("block_idx") < 2, F.col("samples")).otherwise(F.raise_error(F.lit("broken")).cast("array<double>")))
    with pytest.raises(Exception, match="broken"):
        wav.write(broken, str(tmp_path), 8000).collect()
    assert [f for _, _, fs in os.walk(tmp_path) for f in fs] == []


def test_fold_keeps_the_order(spark):
    rng = np.random.default_rng(1)
    values = {t: rng.random(n) for t, n in (("long", 1000), ("short", 3))}
    rows = [(t, 0, i, i * 2, x[2 * i : 2 * i + 2].tolist()) for t, x in values.items() for i in range(-(-len(x) // 2))]
    df = spark.createDataFrame(rows, "track string, channel int, block_idx long, offset long, samples array<double>")
    out = segments.fold(df, lambda x: x, lambda a, b: np.concatenate([a, b]), 5)  # the longest state there is: all values in order
    got = {r.track: r.state for r in out.collect()}
    assert all(got[t] == x.tolist() for t, x in values.items()) and len(got) == 2
    assert segments.fold(df.limit(0), lambda x: x, lambda a, b: a).collect() == []
    assert SimpleNamespace(**got).short
