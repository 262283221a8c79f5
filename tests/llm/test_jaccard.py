import random
import re

import corpus_pipeline
from wavemill.llm import jaccard


def plain(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def reachable(docs, least=0.8):
    """Smallest doc_id reachable, by comparing all."""
    sets, root = {k: plain(t) for k, t in docs}, {k: k for k, _ in docs}
    for a in sets:
        for b in sets:
            either = len(sets[a] | sets[b])
            if b < a and (not either or len(sets[a] & sets[b]) / either >= least) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def planted(seed):
    """Families of texts with a few words changed: similarities of about 0.6 to 1; and short and empty texts."""
    rng, docs = random.Random(seed), []
    for family in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            docs.append(" ".join(words))
    docs += ["", None, " ", "a b", "A  b", "a b c", "one two three four five", "one two three four six"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_equals_brute_force(spark, monkeypatch):
    docs = planted(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expected = reachable(docs)
    for crowd in (64, 2):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        assert {r.doc_id: r.component_id for r in jaccard.groups(df).collect()} == expected


def test_near_copies_of_other_sizes_meet_across_blocks(spark, monkeypatch):
    """Texts cut shorter step by step, each like the next but not like the one after; and others that share their beginning."""
    words = [f"w{i}" for i in range(600)]
    docs = [" ".join(words[: int(600 * 0.85**i)]) for i in range(10)]
    docs += [" ".join(words[:60] + [f"y{i}x{j}" for j in range(20 + 15 * i)]) for i in range(12)]
    docs = list(enumerate(docs))
    expected = reachable(docs)
    assert len(set(expected.values())) > 3 and list(expected.values()).count(0) >= 10
    monkeypatch.setattr(jaccard, "CROWD", 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.groups(df).collect()} == expected


def test_stage_finds_near_copies_beyond_two_bits(spark, sf_dir):
    docs = planted(5)
    df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect())
    assert kept == sorted(k for k, root in reachable(docs).items() if k == root)


def test_rows_are_told_by_row_not_by_id(spark, sf_dir):
    words = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(1, words(1)), (1, words(2)), (2, words(1)), (3, words(3)), (3, words(3)), (None, words(3)), (None, words(4)), (None, words(4)), (5, None), (4, "")]
    df = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(1, words(1)), (1, words(2)), (3, words(3)), (None, words(4)), (4, "")]))
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), sf_dir).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "r", 7), (2, "a b c d e f", "s", 8)], "doc_id long, text string, row string, n int")
    out = jaccard.representatives(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", "r", 7)]
