import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import minhash
from wavemill.llm.queries import op1_minhash


def jaccard(a, b):
    def sets(t):
        w = (t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check(rows, docs):
    order = sorted(docs, key=lambda d: -d[0])
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    errors = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == minhash.fingerprint(text).hex() and r.edited_fingerprint == minhash.fingerprint(edited).hex()
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
    return np.array(errors)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    errors = check(op1_minhash(spark, sf_dir).collect(), docs)
    assert np.abs(errors).mean() < 0.03 and abs(errors.mean()) < 0.01


@pytest.mark.parametrize("n", [0, 1, 2, 25])
def test_few_rows_nulls_and_short_texts(spark, n):
    texts = [None, "", "one", "a b c d", "éa " * 30, "x " * 3000]
    docs = [(i * 7 - 20, texts[i % 6]) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(minhash.with_next(df, ["doc_id"]).collect(), docs)


def test_repeated_and_null_ids(spark):
    docs = [(None, "a b"), (None, "a b"), (3, "x y z"), (3, "x y z"), (3, "other"), (1, None)]
    out = minhash.with_next(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).collect()
    assert len(out) == 6 and sum(r.doc_id == 3 for r in out) == 3


def test_estimates_are_unbiased():
    rng = random.Random(2)
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        errors = []
        for _ in range(30):
            a = [str(rng.random()) for _ in range(400)]
            b = a[: int(share * 400)] + [str(rng.random()) for _ in range(400 - int(share * 400))]
            x, y = " ".join(a), " ".join(b)
            errors.append(minhash.likeness(minhash.fingerprint(x), minhash.fingerprint(y)) - jaccard(x, y))
        assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12


def test_parts_of_a_text_do_not_matter():
    text = ("wörd and\tmore\x0b " * 500).encode()
    whole = minhash.word_hashes(text)
    assert len(whole) == 1500 and all((minhash.word_hashes(text, n) == whole).all() for n in (1, 10, 1000))


def test_joined_texts_hash_as_one():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab é\n") for _ in range(rng.randrange(12))).encode() for _ in range(2))
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        joined = minhash.joined_hashes(a[:i], minhash.words(a), b[:j], minhash.words(b))
        assert joined.tolist() == minhash.word_hashes(a[:i] + b[:j]).tolist(), (a[:i], b[:j])


def test_clashing_names_and_many_rows_of_one_id(spark):
    docs = [(None, f"{i} text of many", "r", 1) for i in range(3000)] + [(5, f"{i} words of five", "r", 2) for i in range(2500)] + [(9, None, "r", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _range string, n_chars int")
    out = minhash.with_next(df, ["doc_id", "_range", "n_chars"])
    assert out.columns == ["doc_id", "_range", *dict(minhash.RESULTS)]
    rows = out.collect()
    assert len(rows) == len(docs) and {r["_range"] for r in rows} == {"r"} and sum(r.doc_id is None for r in rows) == 3000
    # each text is the next one of exactly one row, so every edited text is another one
    assert len({r.edited_sha256 for r in rows}) > 5400
    ranged, n = minhash.neighbours(df.select(df.doc_id.alias("by"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie")))
    sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 1500 and n > max(r["range"] for r in ranged.select("range").distinct().collect())


def test_a_very_long_text(spark):
    docs = [(1, "word and more " * 300_000), (2, "short")]
    check(minhash.with_next(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]).collect(), docs)
