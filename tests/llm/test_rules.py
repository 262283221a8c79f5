import re
from collections import Counter

import numpy as np

from wavemill.llm import rules
from wavemill.llm.queries import op3_quality_rules


def plain(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op3_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    right = []
    for r in rows:
        expected = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            right.append(r.kept == bool(labels[r.doc_id]))
    assert np.mean(right) > 0.95


def test_statistics_of_odd_texts(spark):
    loop = " ".join("a b c d e f g h i j".split() * 30)
    texts = [None, "", " \t\n\x0b\x0c\r", "a\x1cb c d", "x\ny\nx\n \n \nx", loop, loop + " end", "eins " * 9, "né " * 8 + "#$ " * 3, "a b c d e f g h", "p q " + "a b c d e f g h i " * 2 + "z" * 5000]
    df = spark.createDataFrame([(i, t, "no") for i, t in enumerate(texts)], "id int, text string, n_words string")
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert rules.judge(df.limit(0), []).count() == 0


def test_learns_a_conjunction_and_leaves_the_rest():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(rules.FEATURES)))
    y = (x[:, 2] > 0.7) & (x[:, 1] <= 0.4)
    learned = rules.learn(x, y, rng.random(3000) < 0.33)
    said = np.zeros(3000, bool)
    for rule in learned:
        said |= rules._covered(rule, x)
    assert (said == y).mean() > 0.99
    assert rules.learn(x, rng.random(3000) < 0.1, rng.random(3000) < 0.33) == []
    assert rules.learn(x, np.zeros(3000, bool), rng.random(3000) < 0.33) == []


def test_labels_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(i, ("good word " * 30 if i % 2 else "bad### ***word " * 30) + str(i)) for i in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] * 2 + [(None, 0), (3, None), (999, 0)], "doc_id long, quality int")
    varied = docs.selectExpr("doc_id", "concat(text, repeat(concat(' w', doc_id), 0), ' ', array_join(transform(sequence(1, 300), i -> concat('u', i * doc_id)), ' ')) as text")
    learned = rules.fit(varied, labels)
    kept = {r.doc_id: r.kept for r in rules.judge(varied.filter("doc_id is not null"), learned).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(200))
    assert rules.fit(docs, labels.limit(0)) == []


def test_clashing_names_repeats_ties_and_a_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, long, "a", "b"), (1, long, "a", "b"), (2, None, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _words string, _lines string")
    out = rules.statistics(df)
    assert out.columns == ["doc_id", "text", "_words", "_lines", *rules.STATISTICS]
    got = sorted((r.doc_id, r["_words"], r["_lines"], r.n_words, r.n_repeat_words) for r in out.collect())
    assert got == [(1, "a", "b", 300_000, 300_000)] * 2 + [(2, None, "c", 0, 0)]
    # two features that tell the classes apart equally well: the first in the list is asked
    x = np.array([[float(i), 0, float(i), 0, 0] for i in range(40)])
    learned = rules.learn(x, x[:, 0] < 20, np.arange(40) % 3 == 0)
    assert [str(c) for c in learned[0]] == ["n_words <= 19.5"]
    texts = [(i // 2, " ".join([f"v{i}"] * 30 if i % 4 else ["##"] * 30)) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert rules.fit(docs, labels) == rules.fit(docs.repartition(5), labels)
