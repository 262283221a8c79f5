import itertools

import numpy as np
from pyspark.sql import functions as F

from wavemill.llm import chat
from wavemill.llm.queries import op7_chat


def test_roles_come_back(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # a twentieth of a few conversations says little
    rows = op7_chat(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
    assert np.mean([r.roles == r.given_roles for r in rows]) > 0.93


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    sizes = (6, 6, *chat.VALUES)
    model = chat.Model.of({(k, a, b): int(rng.integers(50)) for k, n in enumerate(sizes) for a in range(6) for b in range(n)})
    seen = np.stack([rng.integers(0, n, 5) for n in chat.VALUES], 1)

    def score(path):
        s = model.start[path[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(path))
        return s + sum(m[s_, seen[t, k]] for t, s_ in enumerate(path) for k, m in enumerate(model.emit))

    best = max(itertools.product(range(6), repeat=5), key=score)
    assert np.isclose(score(model.decode(seen)), score(best))


def test_held_out_transcripts_and_texts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/conversations.parquet")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(1000))
    given = chat.gather(table).withColumn("style", style)
    model = chat.fit(given.filter("conv_id % 2 = 0"), F.col("style"))
    rows = chat.parse(chat.transcripts(given.filter("conv_id % 2 = 1"), F.col("style")), model).collect()
    right = [[(t.role, t.text) for t in r.parsed] == [(t.role, t.text.strip()) for t in r.turns] for r in rows]
    assert np.mean(right) > 0.85
    # an eighth of the turns have no marker; of all turns, so many come back whole with their role
    found = [sum(((t.role, t.text) in {(p.role, p.text) for p in r.parsed}) for t in r.turns) for r in rows]
    assert sum(found) / sum(len(r.turns) for r in rows) > 0.93


def test_parts_are_decoded_as_a_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    roles, texts = ("system", "user", "assistant"), ("yes?", "well then", "a longer line " * 8, "one\ntwo\n\nthree", "")
    rows = [(c, t, roles[rng.integers(3)], texts[rng.integers(5)] + str(rng.integers(50))) for c, n in ((1, 230), (2, 7), (3, 40), (4, 41)) for t in range(5, 5 + n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.gather(table).withColumn("style", F.lit(0))
    assert [r.parts for r in whole.collect()] == [1] * 4
    model = chat.fit(whole, F.col("style"))
    # markers are rare, so that most turns are told by what stands around them
    bare = lambda df: df.withColumn("transcript", F.array_join(F.transform("turns", lambda t: F.concat(F.when(F.length(t["text"]) % 3 == 0, F.concat(t["role"], F.lit(": "))).otherwise("\n"), t["text"])), "\n"))
    expected = {r.conv_id: chat.turns(model, r.transcript) for r in bare(whole).collect()}
    monkeypatch.setattr(chat, "PART", 8)
    cut = chat.gather(table)
    assert cut.filter("conv_id = 1").count() == 30
    got = {}
    for r in sorted(chat.parse_parts(bare(cut), model).collect(), key=lambda r: (r.conv_id, r.part_no)):
        got.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.parsed)
    # a turn that goes on in the next part comes as two there
    flat = lambda found: [(role, line) for role, text in found for line in text.split("\n") if line.strip()]
    assert {c: flat(t) for c, t in got.items()} == {c: flat(t) for c, t in expected.items()}


def test_ties_take_the_lower_state_and_other_roles_have_their_own_marker(spark):
    flat = chat.Model.of({})
    assert flat.decode(chat.observe(["a", "b"])) == [0, 0]
    table = spark.createDataFrame([(1, 0, "tool", "x"), (1, 1, None, "y"), (1, 2, "user", "z")], "conv_id long, turn long, role string, text string")
    assert chat.transcripts(chat.gather(table), F.lit(1)).first().transcript == "Tool: x\n\ny\n### human: z"


def test_a_very_long_transcript(spark):
    model = chat.Model.of({(2, 0, 1): 9, (2, 2, 2): 9, (2, 4, 3): 9, (2, 3, 0): 9, (2, 5, 0): 9})
    text = "User: hi\n" + "words and words\n" * 100_000 + "Assistant: yes"
    df = spark.createDataFrame([(1, text, "p"), (1, text, "p")], "conv_id long, transcript string, parts string")
    rows = chat.parse(df, model).collect()
    assert len(rows) == 2 and all([t.role for t in r.parsed] == ["user", "assistant"] and r.parts == "p" for r in rows)


def test_nulls_repeats_empty_and_rendering(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "a <|b\n\nc"), (None, 0, "user", "x"), (None, 0, "user", "y"), (2, None, None, None), (3, 9000, "tool", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    given = chat.gather(table)
    assert given.count() == 5
    model = chat.fit(given.withColumn("style", F.lit(0)), F.col("style"))
    out = chat.parse(chat.transcripts(given.withColumn("style", F.lit(0)), F.col("style")).withColumn("parsed", F.lit("k")), model)
    got = {r.conv_id: r for r in out.withColumn("r", chat.render(F.col("parsed"))).collect() if r.conv_id}
    assert got[1].r == "<|user|>\nhi\n<|end|>\n<|assistant|>\na < |b\n\nc\n<|end|>\n"
    assert chat.turns(model, None) == chat.turns(model, " \n ") == []
    assert chat.parse(given.limit(0).withColumn("transcript", F.lit("")), model).count() == 0
