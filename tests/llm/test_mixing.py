import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wavemill.llm import mixing
from wavemill.llm.queries import op8_mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what is above the limit goes to the others, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, total = {}, set(order), share * sum(sizes.values())
    while free:
        left = total - sum(out.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if got[s] > most * sizes[s]}
        if not above:
            return out | got
        out |= {s: most * sizes[s] for s in above}
        free -= above
    return out


def check(rows, texts):
    size, sources, taken = {}, defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        sources[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    goal = plain_targets(sources)
    for r in rows:
        assert r.source_size == sources[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-6)
    for s, got in taken.items():
        assert abs(got - goal[s]) <= max(r.size for r in rows if r.source == s) / 2 + 1e-6
    return size


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    first = op8_mixing(spark, sf_dir).collect()
    check(first, texts)
    assert sorted(first) == sorted(op8_mixing(spark, sf_dir).repartition(3).collect())


def test_one_large_source_nulls_and_empty_texts(spark):
    rows = [(i, "hot" if i % 3 else None, " ".join(["w"] * (1 + i % 5))) for i in range(300)]
    rows += [(1000, "none", ""), (1001, "none", None), (None, "hot", "a b c"), (1002, "", "x"), (1002, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    measured = mixing.measure(df)
    out = mixing.mix(measured, mixing.plan(measured))
    assert out.count() == len(rows)
    goal = plain_targets({r["source"]: r["n"] for r in measured.groupBy("source").agg(F.sum("size").alias("n")).collect()})
    for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max("times").alias("m")).collect():
        assert r.t == pytest.approx(goal[r.source]) and abs(r.n - r.t) <= 2.5 and r.m <= 2
    assert mixing.repeat(out).count() == out.agg(F.sum("times")).first()[0]


def test_better_documents_come_first_more_often(spark):
    rows = [(i, "a", ("clean " if i % 2 else "junk### ") * 20) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    measured = mixing.measure(df)
    got = mixing.mix(measured, mixing.plan(measured, weights=(1,), share=0.3)).groupBy(F.col("doc_id") % 2).agg(F.sum("times").alias("n"))
    n = {r[0]: r.n for r in got.collect()}
    assert n[1] > 1.5 * n[0]
    assert abs(n[0] + n[1] - 1200) <= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string, size string, taken string")
    measured = mixing.measure(df)
    assert mixing.mix(measured, mixing.plan(measured)).count() == 0


def test_repeated_rows_meet_the_target(spark, monkeypatch):
    rows = [(7, "a", "w " * 21)] * 500 + [(i, "a", "v " * 21) for i in range(1000, 1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for copies, share in ((100_000, 0.75), (7, 0.75), (100_000, 1.9), (7, 0.5)):
        monkeypatch.setattr(mixing, "COPIES", copies)
        for seed in range(3):
            measured = mixing.measure(df, seed)
            out = mixing.mix(measured, mixing.plan(measured, weights=(1,), share=share)).collect()
            goal = share * 21_000
            assert abs(sum(r.taken for r in out) - goal) <= 21 * (1 if copies > 500 else 80) and len(out) == len(rows)
            assert {r.target for r in out} == {goal}


def test_edge_of_unequal_weights_is_cut_until_it_is_small(spark, monkeypatch):
    rows = [(i, "a", "# " * 40 if i % 10 else "w " * 40) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    measured = mixing.measure(df)
    expected = sorted((r.doc_id, r.times) for r in mixing.mix(measured, mixing.plan(measured, weights=(1,), share=0.6)).collect())
    monkeypatch.setattr(mixing, "EDGE_ROWS", 2)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    assert sorted((r.doc_id, r.times) for r in mixing.mix(measured, mixing.plan(measured, weights=(1,), share=0.6)).collect()) == expected
    assert abs(sum(t for _, t in expected) - 1800) <= 1


def test_clashing_names_and_a_very_long_text(spark):
    rows = [(1, "a", "word " * 2_000_000, "x", 5), (2, "a", "b", "y", 6), (2, "a", "b", "y", 6), (3, None, "", "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _of string, _copies long")
    measured = mixing.measure(df)
    out = mixing.mix(measured, mixing.plan(measured))
    assert out.columns == ["doc_id", "source", "text", "_of", "_copies", "size", "draw_order", "draw", *mixing.RESULTS]
    got = out.collect()
    assert sorted((r.doc_id, r["_of"], r["_copies"], r.size) for r in got) == [(1, "x", 5, 2_000_000), (2, "y", 6, 1), (2, "y", 6, 1), (3, "z", 7, 0)]
