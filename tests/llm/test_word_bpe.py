import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wavemill.llm import word_bpe
from wavemill.llm.queries import op12_word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return word_bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return word_bpe.Encoder(vocabulary)


def random_text(rng):
    kinds = ["abcdefghijklmnopqrstuvwxyz", "aàâäeéèêiîoôuùçñ  ", "0123456789 .,;:!?'\"-", "ab", "ΣσςİIıßẞ ", "日本語中文 。", "😂😍🇺🇸👍🏽‍ ", "éạ̧̊ ", "<|endoftext|>", "\t\n\x0b\x1c\x85  　x"]
    out = []
    for _ in range(rng.randrange(1, 8)):
        letters = rng.choice(kinds)
        out.append("".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 20, 80]))))
        out.append(rng.choice([" ", "", "'s", "<|endoftext|>", "<|startoftext|>", "the", "ing"]))
    return "".join(out)


def test_random_texts_equal_the_library(library, encoder, vocabulary):
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for x in encoder.encode_many(texts)]
    assert got == want
    decoder = word_bpe.Decoder(vocabulary)
    assert [decoder.listed(x) for x in got] == library.decode_batch(want, skip_special_tokens=False)


@pytest.mark.parametrize("around", ["{}", "a{}b", "é{}."])
def test_every_letter(library, encoder, around):
    """Letters that this Python doesn't know yet may be told apart otherwise by the library."""
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = [around.format(c) for c in letters]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode_many(texts)] == want


def long_words(rng):
    yield "a" * 20_000
    yield "😂" * 3_000
    yield "".join(rng.choice("ab") for _ in range(12_000))
    yield "".join(rng.choice("etaoinshr") for _ in range(12_000))
    yield "haha" * 4_000 + "!" * 5_000
    yield "".join(rng.choice(["ing", "the", "er", "and", "wh", "ough", "tion"]) for _ in range(4_000))


def test_long_words_stream(library, vocabulary):
    rng = random.Random(4)
    for word in long_words(rng):
        stream, ids, data, start = word_bpe.Stream(vocabulary), [], word.encode(), 0
        while start < len(data):
            size = rng.choice([1, 7, 500, 5000])
            ids += stream.feed(data[start : start + size])
            assert len(stream.held) <= 2 * stream.most
            start += size
        ids += stream.finish()
        whole = library.encode(word, add_special_tokens=False).ids
        if "!" not in word:
            assert ids == whole
        assert word_bpe.Encoder(vocabulary).encode_many([word])[0].tolist() == whole


def test_lookahead_holds(vocabulary):
    """Whatever follows, boundaries further back than the lookahead stay; and some do move that lie further back than a token."""
    rng, furthest = random.Random(9), 0
    tokens = [t for t in vocabulary.ids if t.isascii() and t.isalpha() and not t.endswith(word_bpe.END)]

    def bounds(text):
        at, out = 0, set()
        for token in vocabulary.merge(vocabulary.within[list(text.encode())].tolist()):
            at += word_bpe.length(vocabulary.tokens[token])
            out.add(at)
        return out

    for _ in range(3000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randrange(1, 40)))
        t = rng.randrange(1, len(text) + 1)
        differ = {b for b in bounds(text) ^ bounds(text[:t]) if b < t}
        furthest = max([furthest, *(t - b for b in differ)])
    assert 2 < furthest <= vocabulary.lookahead


def test_small_merge_lists():
    assert word_bpe.lookahead([("a", "b")]) == 1
    chain = [("a", "b"), ("c", "a"), ("d", "c"), ("e", "d")]  # an appended b takes a, so that c is free for d, so that e isn't
    assert word_bpe.lookahead(chain) >= 4


def test_spelled(vocabulary, encoder):
    decoder = word_bpe.Decoder(vocabulary)
    for text in ("hello , world", "über 東京 😂", "", "a <|endoftext|> b"):
        assert decoder.spelled(encoder.encode_many([text])[0].tolist()) == text
    ids = encoder.encode_many(["東"])[0].tolist()
    byte = vocabulary.ids[word_bpe.byte_letters()[0xE6]]
    assert decoder.spelled([byte, *ids]) == "�東" and decoder.spelled([byte]) == "�"


def expected(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in op12_word_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs) > 100
    for r in docs:
        assert got[r.doc_id] == expected(library, r.doc_id, r.text)


def test_nulls_repeated_clashing_and_empty(spark, library, tmp_path):
    docs = [(1, None), (1, None), (2, ""), (3, "x " * 90_000), (None, "Ünï <|endoftext|>"), (5, "w" * 50_000), (5, "w" * 50_000), (6, " \n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op12_word_bpe(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(library, *d) for d in docs), key=str)
    df = spark.createDataFrame([("so it goes", "a", 1)], "text string, `ids` string, `b.c` int")
    (row,) = word_bpe.encode(df, PATH, listed="listed").collect()
    assert row["b.c"] == 1 and row.listed == "so</w> it</w> goes</w>" and len(row.ids) == 3
    (back,) = word_bpe.decode(word_bpe.encode(df, PATH), PATH).collect()
    assert back.text == "so it goes" and back["b.c"] == 1
    (back,) = word_bpe.decode(word_bpe.encode(df, PATH), PATH, spelled=False).collect()
    assert back.text == row.listed
    assert word_bpe.encode(df.limit(0), PATH).collect() == []
