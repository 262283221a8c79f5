import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from wavemill.llm import collocations
from wavemill.llm.queries import OP11_SQL, op11_collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        if words := re.findall(r"[^\x20\x09]+", piece):
            yield words


def counted(docs, longest):
    found = Counter()
    for lang, text in docs:
        for words in pieces(text):
            for size in range(1, longest + 1):
                found.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return found


def expected(docs, longest=3, least=10, first=2000, share=50):
    found, rows = counted(docs, longest), {}
    totals = Counter()
    for (lang, words), f in found.items():
        totals[lang] += f if len(words) == 1 else 0
    good = {k: f for k, f in found.items() if len(k[1]) >= 2 and f >= least}
    for (lang, words), a in good.items():
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: E731, B023
        if any(other == lang and len(w) > len(words) and 100 * f >= share * a and inside(w) for (other, w), f in good.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, words[:k]], found[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, mine in rows.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(mine)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def random_docs(rng, n=120):
    letters = ["a", "b", "c", "the", "A", "é", "É", "x\x01", "x", "-", "日本"]
    docs = []
    for _ in range(n):
        words = [rng.choice(letters) + rng.choice(["", "", "", ".", ",", "\n", "\x0b", "!?"]) for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "\t", "  "]) for w in words)
        docs.append((rng.choice(["en", "en", "en", None, "und", "de", "d e"]), rng.choice([text, text, text, "", None])))
    return docs


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_equals_counting_every_phrase(spark, longest):
    docs = random_docs(random.Random(longest))
    df = spark.createDataFrame(docs, "lang string, text string")
    found = {(r.lang, tuple(r.phrase.split(" ")) if r.phrase else ()): r.n for r in collocations.counts(df, longest=longest).collect()}
    want = {k: f for k, f in counted(docs, longest).items() if f >= 10}
    assert {k: n for k, n in found.items() if k[1]} == want
    assert sorted(map(tuple, collocations.mine(df, longest=longest).collect())) == expected(docs, longest)


def test_a_hot_word_over_many_ranges(spark):
    rng = random.Random(6)
    docs = [("en", " ".join(rng.choice(["the"] * 6 + [f"w{rng.randrange(40)}"]) for _ in range(200))) for _ in range(150)]
    docs += [("fr", "le chat dort. " * 12), ("fr", "le chat dort. " * 12)]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, collocations.mine(df, first=7).collect())) == expected(docs, first=7)


def test_query_and_sql_on_odd_rows(spark, tmp_path):
    docs = [(i, lang, text) for i, (lang, text) in enumerate(random_docs(random.Random(1)))]
    docs += [(7, "en", "long " * 2_000), (7, "en", "long " * 2_000), (None, None, "ab cd " * 20)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_collocations(spark, str(tmp_path)).collect()))
    assert got == expected([d[1:] for d in docs]) and len(got) > 5
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(db.execute(OP11_SQL).fetchall()) == got


def test_counts_beyond_64_bits(spark):
    df = spark.sql("select 'en' lang, p phrase, size(split(p, ' ')) words, n from values ('a b', 2000000000000l), ('a', 4000000000000l), ('b', 3000000000000l) t(p, n)")
    a, left, right = 2 * 10**12, 4 * 10**12, 3 * 10**12
    assert a * a * 1_000_000 > 2**63
    found = df.selectExpr(f"cast(1000000 as decimal(7,0)) * (cast(n as decimal(19,0)) * cast(n as decimal(19,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0))) s").collect()
    assert found[0].s == 1_000_000 * a * a // (left * right)


def test_nothing_to_count(spark):
    df = spark.createDataFrame([("en", None), (None, ""), ("en", " .,\n")], "lang string, text string")
    assert collocations.mine(df).collect() == [] and collocations.mine(df.limit(0)).collect() == []
    named = spark.createDataFrame([("x", 1, "a b " * 30)], "`lang` string, n int, `phrase` string")
    assert sorted(r.phrase for r in collocations.mine(named, "phrase").collect()) == ["a b a", "b a b"]


def test_a_very_long_piece(spark):
    df = spark.createDataFrame([("en", "long " * 200_000 + "end"), ("en", "x" * 100_000 + " y")], "lang string, text string")
    found = {r.phrase: r.n for r in collocations.counts(df, least=1).collect()}
    assert found["long long long"] == 199_998 and found["long"] == 200_000 and found["long end"] == 1 and found["x" * 100_000 + " y"] == 1 and found[""] == 200_003


def test_edges_travel_in_blocks_not_one_by_one(spark):
    words = [f"w{i}" for i in range(60_000)]
    texts = spark.createDataFrame([("en", " ".join(words))], "lang string, text string")
    assert collocations._edges(texts, 3, []).count() == 3  # 65,535 // 3 edges a block
    found = {r.phrase: r.n for r in collocations.counts(texts, least=1).collect()}
    assert len(found) == 3 * 60_000 - 3 + 1 and found["w0 w1 w2"] == found["w59999"] == 1 and found[""] == 60_000


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_blocks_and_flows_of_cut_ranges(longest):
    rng = random.Random(longest)
    docs = [text for _, text in random_docs(rng, 400)]
    bounds = sorted({("en", tuple(rng.choice(["a", "the", "m", "x", "x\x01", "日本", "ÿ"]) for _ in range(rng.randrange(1, longest + 1)))) for _ in range(9)})
    ranges = {}
    for i in range(0, len(docs), 60):  # counted in parts
        words, begins = collocations._words(pa.array(docs[i : i + 60], pa.string()))
        for batch in collocations._blocks("en", words, begins, longest, bounds):
            number, _, *columns = batch.columns
            for r in number.unique().to_pylist():
                own, *places, n = [c.filter(pc.equal(number, r)) for c in columns]
                ranges.setdefault(r, collocations.Edges(longest)).add(own, places, n)
    assert len(ranges) > 3
    found, total = Counter(), 0
    for edges in ranges.values():
        for phrases, words, shortest, n in edges.flows(1):
            for phrase, low, count in zip(phrases.to_pylist(), shortest.tolist(), n.tolist()):
                total += count if words == 0 else 0
                found.update({("en", tuple(phrase.split(" ")[:size])): count for size in range(low, words + 1) if size})
    want = counted([("en", text) for text in docs], longest)
    assert found == want and total == sum(n for (_, words), n in want.items() if len(words) == 1)


def test_more_words_than_fit_in_64_bits():
    rng = np.random.default_rng(1)
    columns = [rng.choice(np.array([0, 1, 5, 2**31 - 2], np.int32), 500) for _ in range(5)]
    rows = list(zip(*[c.tolist() for c in columns]))
    keys = collocations._keys(columns).tolist()
    assert sorted(range(500), key=lambda i: (keys[i], i)) == sorted(range(500), key=lambda i: (rows[i], i))
    assert len(set(keys)) == len(set(rows))


def test_ranges_grow_with_the_edges(spark, monkeypatch):
    docs = random_docs(random.Random(9), 300)
    df = spark.createDataFrame(docs, "lang string, text string")
    monkeypatch.setattr(collocations, "IN_A_RANGE", 300)
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, bounds = collocations._bounds(df.fillna("und", "lang"), 3, before)
    assert ranges > before and len(bounds) > before
    assert sorted(map(tuple, collocations.mine(df).collect())) == expected(docs)
    long = spark.createDataFrame([("en", "x" * 100_000 + " y")], "lang string, text string")
    assert collocations._bounds(long, 3, 2)[0] > 10  # by bytes
