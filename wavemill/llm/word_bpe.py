"""BPE with word ends as a transducer of bounded lookahead.

The merges decide how far back what follows can still be felt. Let two inputs agree up to
place t, and compare their merging rule by rule. A boundary before t that one of them keeps
and the other removes by rule j, (u, v), has a neighbouring token that differs between them,
so a boundary that an earlier rule i treated differently: at the right end of v (then the
left part of rule i is an end of v) or inside v (rule i helped to make v), both up to |v| to
the right; or to the left, likewise with u. `lookahead` follows these steps through all rules
in their order and returns the greatest distance from t. Tokens that end further behind the
read position are final whatever comes, so a stream holds a few lookaheads of symbols and no
more, however long the word is.

Short words, nearly all, are merged many at a time on arrays and remembered.

Decoding is a machine over tokens whose state is the unfinished UTF-8 sequence and whether
a word has ended; text comes out while ids arrive.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _IDS, REPLACEMENT, _read, _slices, _text_sizes, _with, continues, sequence_length
from .common import map_batches

#: Bounds of the memo: when as many words are new, the older half is forgotten.
MAX_WORDS = 120_000
#: Words of fewer bytes are merged many at a time, so many together.
SHORT, TOGETHER = 64, 8192
#: Texts are cut into this many words at a time.
PIECES = 1 << 16
NONE = np.int64(1) << 40

END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones of Latin-1
    stand for themselves, the others for the letters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [other.get(b, chr(b)) for b in range(256)]


def length(token: str) -> int:
    """Symbols of a token: its word end isn't one of its own."""
    return len(token.removesuffix(END)) or 1


def lookahead(merges: list[tuple[str, str]]) -> int:
    """How far, in symbols, before the read position a boundary can depend on what follows."""
    ending: dict[str, int] = {}  # reach of rules by their left part
    starting: dict[str, int] = {}  # and by their right part
    inside: dict[str, int] = {}  # and of those that make a token
    furthest = 0
    for u, v in merges:
        end = END if length(v) < len(v) else ""
        body = v.removesuffix(end)
        behind = max(inside.get(v, 0), *(ending.get(body[i:] + end, 0) for i in range(len(body))))
        before = max(inside.get(u, 0), *(starting.get(u[:i], 0) for i in range(1, len(u) + 1)))
        reach = max(length(v) + behind, before - 1)
        ending[u], starting[v] = max(ending.get(u, 0), reach), max(starting.get(v, 0), reach)
        inside[u + v] = max(inside.get(u + v, 0), inside.get(u, 0), inside.get(v, 0), reach)
        furthest = max(furthest, reach)
    return furthest


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, data: bytes):
        file = json.loads(data)
        model = file["model"]
        kinds = [n["type"] for n in file["normalizer"]["normalizers"]]
        if model["end_of_word_suffix"] != END or model["unk_token"] is not None or kinds != ["NFC", "Replace", "Lowercase"] or file["decoder"] is not None:
            raise ValueError("not a vocabulary of lower-case words with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.pattern: str = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        made = {t for letter in byte_letters() for t in (letter, letter + END)}
        for u, v in self.merges:
            if u not in made or v not in made:
                raise ValueError(f"no earlier rule makes a part of {u} {v}")
            made.add(u + v)
        letters = byte_letters()
        self.within = np.array([self.ids[c] for c in letters], np.int64)
        self.final = np.array([self.ids[c + END] for c in letters], np.int64)
        self.base = max(self.tokens) + 1
        pairs = {self.ids[u] * self.base + self.ids[v]: (rank, self.ids[u + v]) for rank, (u, v) in reversed([*enumerate(self.merges)])}
        self.rules = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.results = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[order].T
        self.lookahead = lookahead(self.merges)

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the rules to one long sequence, those of lowest rank first, from the left."""
        n, base, rule = len(symbols), self.base, self.rules.get
        symbols, after, before = symbols[:], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r[0], i, r[1]) for i in range(n - 1) if (r := rule(symbols[i] * base + symbols[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or (rule(symbols[i] * base + symbols[j]) or (-1,))[0] != rank:
                continue
            symbols[i], symbols[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rule(symbols[k] * base + symbols[after[k]])):
                    heapq.heappush(heap, (r[0], k, r[1]))
        return [s for s in symbols if s >= 0]

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each word: at each step all words apply their rule of lowest rank."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        read = np.frombuffer(b"".join(words), np.uint8)
        symbols, last = self.within[read], np.cumsum(sizes) - 1
        symbols[last] = self.final[read[last]]
        word, done = np.repeat(np.arange(len(words)), sizes), []
        while len(symbols):
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], NONE)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(np.append(rank, NONE), begin)
            ready = least == NONE
            counts = np.diff(np.append(begin, len(word)))
            lowest = np.repeat(least, counts)
            hit = np.flatnonzero((rank == lowest[:-1]) & (rank < NONE))
            first = np.concatenate([[True], np.diff(hit) != 1]) if len(hit) else np.empty(0, bool)
            hit = hit[(hit - hit[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]) % 2 == 0]  # of aaa, the left pair
            symbols[hit] = self.results[at[hit]]
            out = np.repeat(ready, counts)
            done.append((word[out], symbols[out]))
            left = ~out
            left[hit + 1] = False
            symbols, word = symbols[left], word[left]
        found = np.concatenate([w for w, _ in done])
        order = np.argsort(found, kind="stable")
        tokens = np.concatenate([s for _, s in done])[order].tolist()
        stops = np.cumsum(np.bincount(found, minlength=len(words))).tolist()
        return [tuple(tokens[a:b]) for a, b in zip([0, *stops], stops)]


class Stream:
    """The tokens of one word, however long, while its bytes arrive; at most some lookaheads are held."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""
        self.most = 4 * vocabulary.lookahead + 256

    def feed(self, data: bytes) -> Iterator[int]:
        for start in range(0, len(data), self.most):
            self.held += data[start : start + self.most]
            if len(self.held) > self.most:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        read = self.held[:-1]  # the last byte may end the word
        stop = 0
        for token in self.vocabulary.merge(self.vocabulary.within[np.frombuffer(read, np.uint8)].tolist()):
            size = length(self.vocabulary.tokens[token])
            if stop + size >= len(read) - self.vocabulary.lookahead:
                break
            stop += size
            yield token
        self.held = self.held[stop:]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        read = np.frombuffer(self.held, np.uint8)
        self.held = b""
        return self.vocabulary.merge([*self.vocabulary.within[read[:-1]].tolist(), int(self.vocabulary.final[read[-1]])])


def lower(text: str) -> str:
    """Lower case letter by letter: a capital sigma at a word's end is like any other."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Encoder:
    """Token ids of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        compiled = regex.compile(vocabulary.pattern)
        self.split, self.iterate = compiled.findall, compiled.finditer
        self.specials = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _segments(self, text: str) -> Iterator[list[str]]:
        """The words of a text in lists; special tokens are words of their own."""
        start = 0
        for found in chain(self.specials.finditer(text), [None]):
            part = text[start : found.start() if found else len(text)]
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            part = lower(part)
            if len(part) <= PIECES:
                yield self.split(part)
            else:
                some = (m[0] for m in self.iterate(part))
                while got := list(islice(some, PIECES)):
                    yield got
            if found:
                yield [found[0]]
                start = found.end()

    def _missing(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        found: dict[str, tuple[int, ...]] = {}
        short: list[str] = []
        special = self.vocabulary.special
        for word in dict.fromkeys(words):
            if word in self.older:
                found[word] = self.older[word]
            elif word in special:  # words are lower case and don't mix letters and signs, so none looks like one
                found[word] = (special[word],)
            elif len(word) < SHORT and len(word.encode()) < SHORT:
                short.append(word)
            else:
                stream = Stream(self.vocabulary)
                found[word] = (*stream.feed(word.encode()), *stream.finish())
        short.sort(key=len)
        for start in range(0, len(short), TOGETHER):
            some = short[start : start + TOGETHER]
            found |= zip(some, self.vocabulary.merge_many([w.encode() for w in some]))
        for word, ids in found.items():
            if len(word) < SHORT:
                if len(self.words) >= MAX_WORDS:
                    self.older, self.words = self.words, {}
                self.words[word] = ids
        return found

    def _ids(self, words: list[str]) -> list[tuple[int, ...]]:
        got = list(map(self.words.get, words))
        missing = [i for i, ids in enumerate(got) if ids is None]
        if missing:
            found = self._missing(words[i] for i in missing)
            for i in missing:
                got[i] = found[words[i]]
        return got

    def encode_many(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        out: list[list[np.ndarray]] = []
        words: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            got, start = self._ids(words), 0
            for owner, n in owners:
                out[owner].append(np.fromiter(chain.from_iterable(got[start : start + n]), np.int32))
                start += n
            words.clear(), owners.clear()

        for text in texts:
            out.append([])
            for some in self._segments(text):
                words.extend(some)
                owners.append((len(out) - 1, len(some)))
                if len(words) >= PIECES:
                    flush()
        flush()
        return [np.concatenate([np.empty(0, np.int32), *parts]) for parts in out]


class Decoder:
    """Text from token ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.names = [vocabulary.tokens.get(i, "") for i in range(max(vocabulary.tokens) + 1)]
        self.special = set(vocabulary.special.values())
        self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}

    def listed(self, ids: Iterable[int]) -> str:
        """The tokens as the vocabulary writes them, joined by one space."""
        return " ".join(map(self.names.__getitem__, ids))

    def move(self, pending: bytes, token: int) -> tuple[str, bytes]:
        """What is emitted, and the sequence that is left unfinished, if the token comes next."""
        known = self.moves.setdefault(pending, {})
        if token not in known:
            name, out, held = self.names[token], [], pending
            ends = len(name) > len(END) and name.endswith(END)
            for byte in (self.bytes_of[c] for c in (name[: -len(END)] if ends else name)):
                if held and not continues(held, byte):
                    out.append(REPLACEMENT)
                    held = b""
                if not held and not sequence_length(byte):
                    out.append(REPLACEMENT)
                    continue
                held += bytes((byte,))
                if len(held) == sequence_length(held[0]):
                    out.append(held.decode())
                    held = b""
            if ends:
                out.append(f"{REPLACEMENT} " if held else " ")
                held = b""
            known[token] = "".join(out), held
        return known[token]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The words while tokens arrive, a space after each; malformed bytes become U+FFFD."""
        held = b""
        for token in ids:
            if token in self.special:
                yield (REPLACEMENT if held else "") + self.names[token] + " "
                held = b""
                continue
            text, held = self.move(held, token)
            if text:
                yield text
        if held:
            yield REPLACEMENT

    def spelled(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids)).removesuffix(" ")


_made: dict[tuple[int, int], tuple[Encoder, Decoder]] = {}


def _of(data: bytes) -> tuple[Encoder, Decoder]:
    """The machines of a vocabulary in a worker, kept between tasks."""
    key = hash(data), len(data)
    if key not in _made:
        vocabulary = Vocabulary(data)
        _made[key] = Encoder(vocabulary), Decoder(vocabulary)
    return _made[key]


def _array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])), type=_IDS)


def _plus(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = [f.name for f in fields]
    return T.StructType([*(df.schema[c] for c in df.columns if c not in names), *fields])


_ID_LIST = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", listed: str | None = None) -> DataFrame:
    """Adds `ids`, the token ids of the whole text, without added special tokens.

    vocabulary: path of a tokenizer's JSON file. The strings of special tokens in a text are
    these tokens. listed: name of one more column, the tokens as the vocabulary writes
    them, joined by one space. A null or empty text has no ids and an empty list. Input
    columns named like the results are replaced; other columns and repeated rows stay.
    """
    data = _read(df, vocabulary)
    more = [T.StructField(listed, T.StringType())] if listed else []
    schema = _plus(df, T.StructField(ids, _ID_LIST), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _of(data.value)
        for batch in _slices(batches, _text_sizes(text)):
            found = encoder.encode_many(value or "" for value in batch.column(batch.schema.get_field_index(text)).to_pylist())
            out = _with(batch, ids, _array(found))
            yield _with(out, listed, pa.array([decoder.listed(x.tolist()) for x in found], pa.string())) if listed else out

    return map_batches(df, run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text", spelled: bool = True) -> DataFrame:
    """Adds `text`: what the ids spell, words joined by one space, or, not spelled, the tokens as the vocabulary writes them.

    Null ids give an empty text, an unknown id fails the job. An input column named like
    `text` is replaced; other columns and repeated rows stay.
    """
    data = _read(df, vocabulary)
    sizes = lambda b: pc.multiply(pc.list_value_length(b.column(b.schema.get_field_index(ids))), 4).fill_null(0).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = _of(data.value)
        made = decoder.spelled if spelled else decoder.listed
        for batch in _slices(batches, sizes):
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield _with(batch, text, pa.array([made(v or ()) for v in values], pa.string()))

    return map_batches(df, run, _plus(df, T.StructField(text, T.StringType())))
