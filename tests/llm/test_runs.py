import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import runs
from wavemill.llm.queries import op13_periodic_runs


def plainly(x):
    """(start, length, period) of every run of three periods or more, by comparing all shifts."""
    n, found = len(x), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j - i >= 2 * p:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def sample(rng, kind):
    n = rng.randrange(1, 500)
    if kind == "letters":
        return [rng.randrange(2) for _ in range(n)]
    if kind == "periodic":
        base = [rng.randrange(3) for _ in range(rng.randrange(1, 80))]
        x = (base * (n // len(base) + 1))[:n]
        for _ in range(rng.randrange(4)):
            x[rng.randrange(n)] = rng.randrange(3)
        return x
    if kind == "nested":
        x = []
        while len(x) < n:
            x += [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 15)
            if rng.random() < 0.3 and len(x) < 80:
                x *= 3
        return x[:n]
    a, b = [0], [0, 1]  # Fibonacci words hold many runs, none of four periods
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("kind", ["letters", "periodic", "nested", "fibonacci"])
def test_equals_comparing_all_shifts(kind):
    rng = random.Random(7)
    for _ in range(150):
        x = sample(rng, kind)
        assert [tuple(r) for r in runs.find(np.array(x)).tolist()] == plainly(x)


def test_selected_positions_depend_on_their_context_only():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, 3000)
    x[2000:2600] = x[300:900]
    for tau in (4, 8, 16, 32):
        hashes, size = runs._mixed(x.astype(np.uint64)), 1
        while size < tau:
            hashes, size = runs._longer(hashes, size), 2 * size
        at = set(runs.selected(hashes, tau, np.zeros(len(hashes), bool)).tolist())
        for i in range(300, 900 - 2 * tau + 1):
            assert (i in at) == (i + 1700 in at)
        assert all(any(j in at for j in range(i, i + tau)) for i in range(len(x) - 3 * tau))
        assert len(at) < 6 * len(x) / tau


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [r for r in plainly(w) if r[1] >= 24]
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = {d: t for d, t in docs if len(t or "") < 20_000}
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs) and len(short) > 100 and sum(r[1] > 0 for r in got.values()) > 10
    for doc_id, text in short.items():
        assert got[doc_id] == expected(doc_id, text)


def test_nulls_empty_repeated_and_long_texts(spark, tmp_path):
    texts = [None, "", " \n\t ", "a", "x " * 24, "x " * 23, "a b c " * 9, "ä ß\x0b" * 40, "a\x85b " * 30, ("one two three\n" * 8 + "four ") * 3]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:30]
    docs = [(i, t) for k, t in enumerate(texts) for i in (ids[k], ids[k] + 1)] + [(ids[4], texts[4]), (None, "a " * 50), (None, None)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    rows = sorted((tuple(r) for r in op13_periodic_runs(spark, folder).collect() if r.doc_id is not None), key=str)
    assert rows == sorted((expected(*d) for d in docs if d[0] is not None), key=str)


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    middle = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    text = f"{middle} {'p q r ' * 30_000} {middle} {middle} {middle} end"
    (row,) = runs.mark(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r.length, r.period) for r in row.runs] == [(90_000, 3), (180_000, 60_000)]
    assert row.collapsed.split() == [*middle.split(), "p", "q", "r", *middle.split(), "end"]
    assert runs.mark(spark.createDataFrame([], "text string, n int")).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a " * 30, 1, "b " * 40, "k")], "collapsed string, runs int, text string, `odd.name` string")
    (row,) = runs.mark(df).collect()
    assert row["odd.name"] == "k" and row.collapsed == "b" and [r.length for r in row.runs] == [40]
    (row,) = runs.mark(df, "collapsed").collect()
    assert row.collapsed == "a" and row.text == "b " * 40 and row.runs[0].length == 30


def test_strongest_breaks_ties_by_place(spark):
    df = spark.sql("select array(named_struct('start', 1l, 'length', 30l, 'period', 10l), named_struct('start', 5l, 'length', 60l, 'period', 20l), named_struct('start', 9l, 'length', 31l, 'period', 10l)) runs union all select array()")
    assert [r.b and r.b.start for r in df.select(runs.strongest().alias("b")).collect()] == [9, None]
    assert df.select(F.size("runs")).count() == 2
