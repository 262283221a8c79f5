"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges of a byte-level vocabulary define, for every byte string, one token
sequence. A sequence is that one exactly when each two neighbours, encoded
together, stay the same two tokens. This makes encoding a local property: a
non-deterministic transducer keeps every possible start of the current token
(its trie node) with the token before it, and its subsets are determinised when
first met. Short pieces run through it many at a time (`Lockstep`): at each step the
pieces' states move together, and transitions that none has made before are determinised
in bulk; which token ends at a place is known from the state, and the piece's tokens are
read back from its end. Long pieces run alone (`Transducer.encode_piece`); there a token
is emitted as soon as all live hypotheses agree on it, which is at most the longest
token's length behind the read position.

Decoding is the inverse: a machine over tokens whose state is the unfinished
UTF-8 sequence (0 to 3 bytes), so that text is emitted while ids arrive.
"""

from __future__ import annotations

import base64
import contextlib
import gc
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bounds of the memos; when one is full it is emptied, and results stay the same.
MAX_STATES, MAX_WORDS, MAX_PAIRS = 100_000, 120_000, 1_000_000
#: Pieces of fewer characters run many at a time and are remembered.
SHORT = 64
#: Texts are cut into this many pieces at a time.
PIECES = 1 << 16
#: So many pieces, of like length, run together.
TOGETHER = 16_384

REPLACEMENT = "�"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a .tiktoken file: base64 of the token's bytes, space, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_slowly(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Merges the neighbours of lowest rank, leftmost first, until none can be merged."""
    n = len(piece)
    if not n:
        return []
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and ends[i] < n:
            stop = ends[ends[i]]
            rank = ranks.get(piece[i:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[i], stop))

    for i in range(n):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or ends[i] != middle or ends[middle] != stop:
            continue
        alive[middle] = False
        ends[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def _parts(piece: bytes) -> list[bytes]:
    return [piece[i:j] for i in range(len(piece)) for j in range(i + 1, len(piece) + 1)]


class State:
    """A determinised state: its hypotheses (token before, trie node, tokens not yet emitted) and known transitions."""

    __slots__ = ("hypotheses", "next")

    def __init__(self, hypotheses: tuple[tuple[int, int, tuple[int, ...]], ...]):
        self.hypotheses = hypotheses
        self.next: dict[int, tuple[tuple[int, ...], State]] = {}


class Known:
    """A growing map from numbers to numbers as two sorted arrays, the smaller one for what came last."""

    def __init__(self) -> None:
        self.parts = [(np.empty(0, np.int64), np.empty(0, np.int32)), (np.empty(0, np.int64), np.empty(0, np.int32))]

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.parts)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; -1 where there is none yet."""
        out = np.full(len(keys), -1, np.int32)
        for have, values in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = values[at[hit]]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that aren't there yet."""
        large, small = self.parts
        small = self._merged(small, (keys, values))
        if len(small[0]) > 4096 + len(large[0]) // 8:
            large, small = self._merged(large, small), (np.empty(0, np.int64), np.empty(0, np.int32))
        self.parts = [large, small]

    @staticmethod
    def _merged(a, b):
        order = np.argsort(b[0])
        keys, values = b[0][order], b[1][order].astype(np.int32)
        at = np.searchsorted(a[0], keys)
        return np.insert(a[0], at, keys), np.insert(a[1], at, values)


class Lockstep:
    """The transducer for many short pieces at once.

    A state is a set of hypotheses, packed as (token before + 1) << 32 | trie node; state 0
    is the piece's start. `ends` tells the token that ends where the state is reached, -1
    for none. At most MAX_STATES states and MAX_PAIRS pairs are held, then they are dropped.
    """

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        keys = np.fromiter(transducer.trie, np.int64, len(transducer.trie))
        moves = np.array(list(transducer.trie.values()), np.int32).reshape(-1, 2)
        order = np.argsort(keys)
        self.trie, self.nodes, self.tokens = keys[order], moves[order, 0], moves[order, 1]
        self.inner = np.zeros(len(transducer.trie) + 1, bool)  # nodes that lead on
        self.inner[keys >> 8] = True
        self.sizes = np.zeros(max(transducer.tokens, default=0) + 1, np.int32)
        for rank, token in transducer.tokens.items():
            self.sizes[rank] = len(token)
        self.pairs = Known()
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.moves = Known()
        self.hypotheses = np.zeros(1024, np.int64)
        self.bounds = np.zeros(1024, np.int64)
        self.ends = np.full(1024, -1, np.int32)
        self.states, self.bounds[1] = 1, 1  # the start: no token before, the trie's root

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the right token of each pair may follow the left one."""
        out = self.pairs.get(pairs)
        unknown = np.unique(pairs[out < 0])
        if len(unknown):
            if len(self.pairs) + len(unknown) > MAX_PAIRS:
                self.pairs = Known()
                unknown = np.unique(pairs)
            may = self.transducer.may_follow
            made = np.fromiter((may((p >> 32) - 1, p & 0xFFFFFFFF) for p in unknown.tolist()), np.int32, len(unknown))
            self.pairs.put(unknown, made)
            at = np.searchsorted(unknown, pairs)
            at[at == len(unknown)] = 0
            mine = unknown[at] == pairs
            out[mine] = made[at[mine]]
        return out > 0

    def determinise(self, moves: np.ndarray) -> np.ndarray:
        """The states that the moves (state << 8 | byte) lead to, new ones included."""
        begin = self.bounds[moves >> 8]
        n = self.bounds[(moves >> 8) + 1] - begin
        owner = np.repeat(np.arange(len(moves)), n)
        given = self.hypotheses[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]]
        steps = (given & 0xFFFFFFFF) << 8 | moves[owner] & 255
        at = np.minimum(np.searchsorted(self.trie, steps), len(self.trie) - 1)
        alive = self.trie[at] == steps
        at, owner, last = at[alive], owner[alive], given[alive] >> 32
        node, token = self.nodes[at].astype(np.int64), self.tokens[at].astype(np.int64)
        whole = np.flatnonzero(token >= 0)
        whole = whole[self.fits(last[whole] << 32 | token[whole])]
        on = self.inner[node]
        who = np.concatenate([owner[on], owner[whole]])
        made = np.concatenate([last[on] << 32 | node[on], (token[whole] + 1) << 32])
        order = np.argsort(who, kind="stable")
        made = made[order]
        ends = np.full(len(moves), -1, np.int32)
        ends[owner[whole]] = token[whole]
        stops = np.cumsum(np.bincount(who, minlength=len(moves)))
        out, ids, data, fresh, start = [], self.ids, made.tobytes(), [], 0
        for i, stop in enumerate((8 * stops).tolist()):
            state = ids.setdefault(data[start:stop], self.states + len(fresh))
            if state == self.states + len(fresh):
                fresh.append(i)
            out.append(state)
            start = stop
        if fresh:
            sizes = np.diff(stops, prepend=0)[fresh]
            rows = np.repeat(stops[fresh] - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            used, more = self.bounds[self.states], self.states + len(fresh)
            self.hypotheses = _room(self.hypotheses, used + len(rows))
            self.bounds, self.ends = _room(self.bounds, more + 1), _room(self.ends, more + 1)
            self.hypotheses[used : used + len(rows)] = made[rows]
            self.bounds[self.states + 1 : more + 1] = used + np.cumsum(sizes)
            self.ends[self.states : more] = ends[fresh]
            self.states = more
        return np.array(out, np.int32)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...] | None]:
        """The tokens of each piece; None where merges alone don't make the vocabulary's tokens."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        out: list[tuple[int, ...] | None] = [None] * len(pieces)
        for start in range(0, len(order), TOGETHER):
            if self.states > MAX_STATES:
                self.clear()
            self._encode(pieces, order[start : start + TOGETHER], out)
        return out

    def _encode(self, given: list[bytes], order: list[int], out: list[tuple[int, ...] | None]) -> None:
        """Those of the pieces in `order`, from the longest on, into out."""
        pieces = [given[i] for i in order]
        sizes = np.array([len(p) for p in pieces], np.int64)
        longest = int(sizes[0])
        read = np.zeros((len(pieces), longest), np.uint8)
        read[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        state, ends = np.zeros(len(pieces), np.int64), np.full((len(pieces), longest + 1), -1, np.int32)
        for t in range(longest):
            n = int(np.searchsorted(-sizes, -t, side="left"))  # pieces of more than t bytes
            moves, back = np.unique(state[:n] << 8 | read[:n, t], return_inverse=True)
            to = self.moves.get(moves)
            new = np.flatnonzero(to < 0)
            if len(new):
                to[new] = self.determinise(moves[new])
                self.moves.put(moves[new], to[new])
            state[:n] = to[back]
            ends[:n, t + 1] = self.ends[state[:n]]
        rows, at, found = np.arange(len(pieces)), sizes.copy(), []
        while len(rows):
            token = ends[rows, at[rows]]
            rows, token = rows[token >= 0], token[token >= 0]
            found.append((rows, token))
            at[rows] -= self.sizes[token]
            rows = rows[at[rows] > 0]
        rows, tokens = np.concatenate([r for r, _ in reversed(found)]), np.concatenate([t for _, t in reversed(found)])
        tokens = tokens[np.argsort(rows, kind="stable")].tolist()
        start = 0
        for i, n, left in zip(order, np.bincount(rows, minlength=len(pieces)).tolist(), at.tolist()):
            if not left:
                out[i] = tuple(tokens[start : start + n])
            start += n


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    out = np.full(max(size, 2 * len(array)), -1, array.dtype)
    out[: len(array)] = array
    return out


class Transducer:
    """Encodes byte pieces and texts; holds at most MAX_STATES states."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        compiled = regex.compile(pattern)
        self.split, self.iterate = compiled.findall, compiled.finditer
        self.trie: dict[int, tuple[int, int]] = {}  # node and byte -> node, token that ends there or -1
        nodes = 0
        for token, rank in ranks.items():
            node = key = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.trie:
                    nodes += 1
                    self.trie[key] = nodes, -1
                node = self.trie[key][0]
            self.trie[key] = node, rank
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.start = State(((-1, 0, ()),))
        self.states: dict[tuple, State] = {}
        self.fallbacks = 0
        self.lockstep = Lockstep(self)

    def spine(self, token: int) -> tuple[list, list] | None:
        """The parts of a token at its left and its right end, smallest first, each with the rank
        at which a merge takes it up (none: infinity); None if merges don't make the token."""
        if token not in self.spines:
            piece = self.tokens[token]
            if len(piece) == 1:
                self.spines[token] = [(piece, float("inf"))], [(piece, float("inf"))]
            elif merge_slowly(self.ranks, piece) != [token]:
                self.spines[token] = None
            else:
                left, right = merge_slowly({k: v for k in _parts(piece) if (v := self.ranks.get(k, token)) < token}, piece)
                lefts, rights = self.spine(left)[0], self.spine(right)[1]
                self.spines[token] = [*lefts[:-1], (lefts[-1][0], token), (piece, float("inf"))], [*rights[:-1], (rights[-1][0], token), (piece, float("inf"))]
        return self.spines[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded together, stay these two (left -1: the piece's start).

        They do unless some part at the left token's right end and some part at the right
        token's left end, standing side by side at the same time, merge before their own do.
        """
        after = self.spine(right)
        if left < 0 or after is None:
            return after is not None
        ones, others, get = self.spine(left)[1], after[0], self.ranks.get
        i = j = 0
        while True:
            (one, one_until), (other, other_until) = ones[i], others[j]
            rank = get(one + other)
            if rank is not None and rank < one_until and rank <= other_until:
                return False
            if one_until <= other_until:
                if i + 1 == len(ones):
                    return True
                i += 1
            else:
                j += 1

    def fits(self, pair: int, left: int, right: int) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = known = self.may_follow(left, right)
        return known

    def step(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        """Determinises one transition and remembers it."""
        found, trie, pairs = [], self.trie, self.pairs
        for last, node, pending in state.hypotheses:
            reached = trie.get(node << 8 | byte)
            if reached is None:
                continue
            node, token = reached
            found.append((last, node, pending))
            if token >= 0:
                pair = (last + 1) << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = self.fits(pair, last, token)
                if fits:
                    found.append((token, 0, (*pending, token)))
        emitted = ()
        if found and found[0][2]:
            agreed, first = len(found[0][2]), found[0][2]
            for x in found:
                while x[2][:agreed] != first[:agreed]:
                    agreed -= 1
            if agreed:
                emitted = first[:agreed]
                found = [(last, node, pending[agreed:]) for last, node, pending in found]
        key = tuple(found)
        known = self.states.get(key)
        if known is None:
            if len(self.states) >= MAX_STATES:
                self.states.clear()
                self.start = State(self.start.hypotheses)
            known = self.states[key] = State(key)
        move = state.next[byte] = emitted, known
        return move

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for byte in piece[:-1]:
            emitted, state = state.next.get(byte) or self.step(state, byte)
            if emitted:
                out += emitted
        final = self.finish(state, piece[-1])
        if final is None:  # a vocabulary whose tokens are not all made by merges
            self.fallbacks += 1
            return tuple(merge_slowly(self.ranks, piece))
        return (*out, *final) if out else final

    def finish(self, state: State, byte: int) -> tuple[int, ...] | None:
        """What is emitted if the piece ends with this byte; most pieces' ends are met once, so no state is kept."""
        trie, pairs = self.trie, self.pairs
        for last, node, pending in state.hypotheses:
            reached = trie.get(node << 8 | byte)
            if reached is not None and reached[1] >= 0:
                pair = (last + 1) << 32 | reached[1]
                fits = pairs.get(pair)
                if fits is None:
                    fits = self.fits(pair, last, reached[1])
                if fits:
                    return (*pending, reached[1])
        return None

    def remember(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of pieces that aren't among the words remembered; short ones are from now on."""
        found: dict[str, tuple[int, ...]] = {}
        short = []
        for piece in dict.fromkeys(pieces):
            if piece in self.older:
                found[piece] = self.older[piece]
            elif len(piece) < SHORT:
                short.append(piece)
            else:
                found[piece] = self.encode_piece(piece.encode())
        if short:
            given = [p.encode() for p in short]
            for piece, data, ids in zip(short, given, self.lockstep.encode(given)):
                if ids is None:
                    self.fallbacks += 1
                    ids = tuple(merge_slowly(self.ranks, data))
                found[piece] = ids
        for piece, ids in found.items():
            if len(piece) < SHORT:
                if len(self.words) >= MAX_WORDS:
                    self.older, self.words = self.words, {}
                self.words[piece] = ids
        return found

    def _pieces(self, texts: Iterable[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Pieces, and how many belong to each text in turn (negative: the text goes on in what follows)."""
        pieces, bounds = [], []
        for text in texts:
            if len(text) <= PIECES:
                got = self.split(text)
            else:
                some = (m[0] for m in self.iterate(text))
                while len(got := list(islice(some, PIECES))) == PIECES:
                    yield [*pieces, *got], [*bounds, -PIECES]
                    pieces, bounds = [], []
            pieces += got
            bounds.append(len(got))
            if len(pieces) >= PIECES:
                yield pieces, bounds
                pieces, bounds = [], []
        if bounds:
            yield pieces, bounds

    def encode_many(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The token ids of each text."""
        out: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for pieces, bounds in self._pieces(texts):
            got = list(map(self.words.get, pieces))
            missing = [i for i, ids in enumerate(got) if ids is None]
            if missing:
                found = self.remember(pieces[i] for i in missing)
                for i in missing:
                    got[i] = found[pieces[i]]
            start = 0
            for n in bounds:
                part = np.fromiter(chain.from_iterable(got[start : start + abs(n)]), np.int32)
                start += abs(n)
                if n < 0:
                    held.append(part)
                else:
                    out.append(np.concatenate([*held, part]) if held else part)
                    held = []
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()


def sequence_length(lead: int) -> int:
    """Bytes of the UTF-8 sequence that starts with this byte; 0 if none does."""
    if lead < 0x80:
        return 1
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def continues(pending: bytes, byte: int) -> bool:
    """Whether the byte may come next in the unfinished sequence (no overlong forms, no surrogates)."""
    low, high = 0x80, 0xBF
    if len(pending) == 1:
        lead = pending[0]
        low = 0xA0 if lead == 0xE0 else 0x90 if lead == 0xF0 else low
        high = 0x9F if lead == 0xED else 0x8F if lead == 0xF4 else high
    return low <= byte <= high


class Decoder:
    """Text from token ids, piece by piece; malformed bytes become U+FFFD, one for each maximal part."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.whole: list[str | None] = [None] * (max(self.tokens, default=-1) + 1)
        for token in self.tokens:
            text, rest = self.move(b"", token)
            if not rest and REPLACEMENT not in text:
                self.whole[token] = text

    def move(self, pending: bytes, token: int) -> tuple[str, bytes]:
        known = self.moves.setdefault(pending, {})
        if token not in known:
            out, held = [], pending
            for byte in self.tokens[token]:
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
            known[token] = "".join(out), held
        return known[token]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        held = b""
        for token in ids:
            known = self.moves.get(held)
            text, held = (known.get(token) if known else None) or self.move(held, token)
            if text:
                yield text
        if held:
            yield REPLACEMENT

    def decode(self, ids: list[int]) -> str:
        try:
            return "".join(map(self.whole.__getitem__, ids))  # type: ignore[arg-type]
        except TypeError:  # a token that ends inside a character
            return "".join(self.stream(ids))


_made: dict[tuple, object] = {}


def _of(kind: type, data: bytes, *rest: str):
    """One machine for each vocabulary in a worker, kept between tasks."""
    key = (kind.__name__, hash(data), len(data), *rest)
    if key not in _made:
        _made[key] = kind(parse_ranks(data), *rest)
    return _made[key]


@contextlib.contextmanager
def _no_cycles():
    """States refer to later states only, so searching them for cycles is in vain."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _plus(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = [c for c in df.columns if c != name]
    out = df.select(*[f"`{c}`" for c in df.columns])
    return out, T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], names=[*(batch.schema.names[i] for i in kept), name])


def _slices(batches: Iterable[pa.RecordBatch], size) -> Iterator[pa.RecordBatch]:
    """Parts of at most about 1.5 MB of the column that size() measures, one row at least."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(size(batch)):
            if held and held + n > 1_500_000:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def _read(df: DataFrame, vocabulary: str):
    """The vocabulary file's bytes, read by the driver and broadcast (about 1 MB, whatever the input)."""
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


_IDS = pa.list_(pa.field("element", pa.int32(), nullable=False))


def _encoded(machine: Transducer, column: pa.Array) -> pa.Array:
    with _no_cycles():
        out = machine.encode_many(value or "" for value in column.to_pylist())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *out])), type=_IDS)


def _decoded(machine: Decoder, column: pa.Array) -> pa.Array:
    flat, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    return pa.array([machine.decode(flat[a:b].tolist()) if ok else "" for a, b, ok in zip(bounds[:-1], bounds[1:], valid)], pa.string())


def _text_sizes(name: str):
    return lambda b: pc.binary_length(b.column(b.schema.get_field_index(name))).fill_null(0).to_pylist()


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`, the token ids of the whole text, each match of the pattern encoded separately.

    vocabulary: path of a .tiktoken file. A null or empty text has no ids. An input
    column named like `ids` is replaced; other columns and repeated rows stay.
    """
    data = _read(df, vocabulary)
    source, schema = _plus(df, ids, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _of(Transducer, data.value, pattern)
        for batch in _slices(batches, _text_sizes(text)):
            yield _with(batch, ids, _encoded(machine, batch.column(batch.schema.get_field_index(text))))

    return source.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Like encode, with `text` replaced by what the ids spell: both in one pass over the rows."""
    data = _read(df, vocabulary)
    source, schema = _plus(df, ids, T.ArrayType(T.IntegerType(), False))
    at = schema.fieldNames().index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _of(Transducer, data.value, pattern), _of(Decoder, data.value)
        for batch in _slices(batches, _text_sizes(text)):
            out = _with(batch, ids, _encoded(encoder, batch.column(batch.schema.get_field_index(text))))
            yield out.set_column(at, text, _decoded(decoder, out.column(out.num_columns - 1)))

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds `text`, what the token ids spell; null ids give an empty text, an unknown id fails the job.

    An input column named like `text` is replaced; other columns and repeated rows stay.
    """
    data = _read(df, vocabulary)
    source, schema = _plus(df, text, T.StringType())
    sizes = lambda b: pc.multiply(pc.list_value_length(b.column(b.schema.get_field_index(ids))), 4).fill_null(0).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _of(Decoder, data.value)
        for batch in _slices(batches, sizes):
            yield _with(batch, text, _decoded(machine, batch.column(batch.schema.get_field_index(ids))))

    return source.mapInArrow(run, schema)
