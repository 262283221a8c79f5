import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import bpe
from wavemill.llm.queries import op9_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.parse_ranks(file.read())


@pytest.fixture(scope="module")
def machines(ranks):
    return bpe.Transducer(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library_on_documents(spark, sf_dir, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(rows[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("aábßthe rn'1 \n\té中", max_size=200))
def test_any_text(machines, library, text):
    if any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        return
    transducer, decoder = machines
    ids = transducer.encode(text)
    assert ids == library.encode_ordinary(text)
    assert decoder.decode(ids) == text
    assert transducer.fallbacks == 0


def test_slow_merge_equals_library(ranks, library):
    for word in ("internationalisation", "öffentlichkeit", " aaaaaaaaaaaaaaaaaaaaaaaaa", "xyzzy"):
        assert bpe.merge_slowly(ranks, word.encode()) == library.encode_ordinary(word)


def test_memos_are_bounded_and_do_not_matter(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    machine = bpe.Transducer(ranks, public_tokenizers.PATTERN)
    text = " ".join(f"word{i} thereof{i % 7} qu{i * i}er" for i in range(300))
    assert machine.encode(text) == library.encode_ordinary(text)
    assert len(machine.states) <= 50 and len(machine.words) <= 10 and len(machine.pairs) <= 20


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12), st.integers(0, 12))
def test_malformed_bytes_as_python_replaces_them(data, cut):
    ranks = {bytes((i,)): i for i in range(256)} | {data[:cut]: 256 for _ in [0] if cut > 1 and len(data[:cut]) > 1}
    ids = ([256] if 256 in ranks.values() else list(data[:cut])) + list(data[cut:])
    assert bpe.Decoder(ranks).decode(ids) == data.decode(errors="replace")


def test_nulls_clashing_names_and_empty_tables(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (3, "für élise  \n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids"] and out.count() == 4
    back = bpe.decode(out.withColumnRenamed("text", "before"), PATH).collect()
    assert sorted(r.text for r in back) == sorted(r.before or "" for r in back)
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="KeyError|IndexError|99999"):
        bpe.decode(spark.sql("select array(99999) as ids"), PATH).collect()


def test_a_very_long_text_in_parts(machines, library, monkeypatch):
    transducer, decoder = machines
    text = "Über 12 words, and more.\n" * 60_000 + "x" * 50_000 + " tail"
    monkeypatch.setattr(bpe, "PIECES", 1000)
    texts = ["", text, "a b", text[:5000], ""]
    got = transducer.encode_many(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert decoder.decode(got[1].tolist()) == text


def test_few_states_and_pairs_do_not_matter(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 10)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    machine = bpe.Transducer(ranks, public_tokenizers.PATTERN)
    for i in range(20):
        text = " ".join(f"wörd{i * k} thereof" for k in range(30))
        assert machine.encode(text) == library.encode_ordinary(text)
    assert machine.fallbacks == 0


def test_round_trip_in_one_pass(spark, library):
    rows = [(1, None, "x"), (2, "für élise 😀", "y"), (2, "für élise 😀", "y")]
    out = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids"]
    assert sorted((r.doc_id, r.text, r.ids) for r in out.collect()) == [(1, "", [])] + [(2, rows[1][1], library.encode_ordinary(rows[1][1]))] * 2
