import random
import re

from pyspark.sql import functions as F

from wavemill.llm import lines
from wavemill.llm.queries import op10_line_dedup


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(docs):
    """docs: (doc_id, text) in order. Every line against every earlier one."""
    first, out = {}, {}
    for k, (doc_id, text) in enumerate(docs):
        for no, line in enumerate((text or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                first.setdefault(line, (k, no))
    gone, earlier = set(), {}
    for line in first:
        if len(line) < lines.EDIT_CHARS and len(re.findall(r"[^\x20\x09-\x0D]+", line)) < lines.EDIT_WORDS:
            continue
        near = [x for n in (-1, 0, 1) for x in earlier.get(len(line) + n, ()) if one_edit(line, x)]
        if near:
            gone.add(line)
        earlier.setdefault(len(line), []).append(line)
    for k, (doc_id, text) in enumerate(docs):
        kept = [x for no, x in enumerate((text or "").split("\n")) if x not in first or x not in gone and first[x] == (k, no)]
        out[doc_id] = None if text is None else "\n".join(kept)
    return out


def test_documents_equal_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    got = lines.dedup(df).collect()
    assert {r.doc_id: r.text for r in got} == plain(docs)
    assert op10_line_dedup(spark, sf_dir).count() == len(docs)


def test_crowded_keys_go_through_all_levels(spark, monkeypatch):
    rng = random.Random(8)
    base = "alpha beta gamma delta epsilon zeta"
    made = []
    for i in range(120):
        line, how = base, rng.random()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at, c = rng.randrange(len(line)), rng.choice("xyzé")
            line = line[:at] + ("" if how < 0.3 else c) + line[at + (how < 0.6) :]
        made.append((i, "\n".join([line, f"short{i}", base + str(rng.randrange(9))])))
    df = spark.createDataFrame(made, "doc_id long, text string")
    expected = plain(made)
    for crowd in (1, 4, 1000):
        monkeypatch.setattr(lines, "CROWD", crowd)
        assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == expected


def test_nulls_repeats_and_clashes(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e", "y"), (3, "a b c d e\n\nkeep\na b c d e", None), (3, "a b c d e\n\nkeep\na b c d e", None), (4, " a b c d e f \nz", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = lines.dedup(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert (False, 1, None, 0, 0) in got and (False, 2, "", 1, 0) in got and (True, 0, "a b c d e", 1, 0) in got
    assert got.count((False, 3, "\nkeep", 4, 2)) == 2 and (False, 4, " a b c d e f \nz", 2, 0) in got
    assert lines.dedup(df.limit(0)).count() == 0


def test_every_line_goes_with_its_copies_and_edits_need_length(spark, sf_dir):
    long = "\u4e00\u4e8c\u4e09\u56db" * 6
    docs = [(1, f"All rights reserved.\n\nLa.\n{long}\na b c d e"), (2, f"All rights reserved.\n\nGa.\n{long}x\na b c d f"), (3, f"keep\nLa.\n \n{long}\nGa.\n ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert got == {1: docs[0][1], 2: "\nGa.", 3: "keep\n \n "}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, copies = set(), 0
    for r in table.orderBy("doc_id").collect():
        for line in (r.text or "").split("\n"):
            copies += bool(line.strip(" \t\n\v\f\r")) and line in seen
            seen.add(line)
    kept = [x for r in lines.dedup(table).collect() for x in (r.text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    assert len(kept) == len(set(kept)) and copies
    assert op10_line_dedup(spark, sf_dir).agg({"n_removed": "sum"}).first()[0] >= copies


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_distance_equals_the_table(spark):
    rng, rows = random.Random(5), [("", ""), ("", "a"), ("a", ""), ("😀é", "é😀"), ("x" * 3000, "x" * 2999 + "y")]
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abé😀")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", *[lines.within(df.a, df.b, k).alias(f"near{k}") for k in (1, 2, 3)]).collect():
        d = distance(r.a, r.b) if len(r.a) < 99 else 1
        assert (r.near1, r.near2, r.near3) == (d <= 1, d <= 2, d <= 3), r


def test_fewer_words_can_be_let_alone_and_names_clash(spark):
    rows = [(1, "one two\na b c d e", 5, "k"), (2, "one two\na b c d e", 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, lines string")
    out = lines.dedup(df, least_words=3)
    assert out.columns == ["doc_id", "text", "gone", "lines", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "one two\na b c d e", 5, "k", 2, 0), (2, "one two", 6, None, 2, 1)]


def test_a_very_long_text_and_a_common_line(spark):
    long = "\n".join(f"line number {i} of a long text" for i in range(40_000))
    rows = [(i, "the same line in every text\n" + (long if i == 3 else f"own {i}")) for i in range(3000)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (2, 0, rows[0][1]) and got[2] == (2, 1, "own 2")
    assert got[3][0] == 40_001 and got[3][2].split("\n")[0] == "line number 0 of a long text"
    assert all(n == 1 for i, (_, n, _) in got.items() if i not in (0, 3))


def test_likely_lets_every_single_edit_through_and_few_others(spark):
    """Op10: pairs that share half a line were all compared character by character."""
    chance = random.Random(3)
    text = lambda n: "".join(chance.choice("ab é\U0001f600") for _ in range(n))
    near, far = [], []
    for n in [*range(0, 30), 60, 100]:
        for _ in range(12):
            a, at, c = text(n), chance.randrange(n + 1), chance.choice("abz")
            near += [(a, a[:at] + c + a[at:]), (a[:at] + c + a[at:], a), (a, a[:at] + c + a[at + 1 :]), (a, a)]
    for _ in range(200):
        half = text(40)
        far.append((half + text(40), half + text(40)))
    good = spark.createDataFrame(near, "a string, b string").filter(~lines.likely(F.col("a"), F.col("b")))
    assert good.count() == 0
    assert spark.createDataFrame(far, "a string, b string").filter(lines.likely(F.col("a"), F.col("b"))).count() < 20
