"""Main text of web pages by a recurrent block labeller.

A page is cut at block-level tags into leaf blocks of text. A bidirectional LSTM in
numpy reads the blocks in order, each as hashed tag path, hashed words and a few
shares, and tells of each whether it belongs to the article, knowing all blocks
before and behind it. It is trained on a bounded sample of pages, labelled by what
their markup says outright, and on the same texts dressed in other page layouts, half of
them with names that say nothing, so that it learns from texts and places as well.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many pages, of at most so many characters, are trained on.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 100_000
PATH, WORDS, PLAIN, HIDDEN = 96, 32, 11, 16
WIDTH = PATH + WORDS + PLAIN

#: A block's path is that of its nearest so many block elements.
DEPTH = 64

#: Elements that begin a block, that have no end tag, and whose content is no text
#: (to their end tag; svg may also end itself).
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|iframe|object|textarea"
#: A new one ends an open one of the same set.
CLOSES = ({"p"}, {"li"}, {"td", "th"}, {"tr"}, {"dd", "dt"}, {"option"})

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<svg(?=[\s/])(?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+(?<=/)>|<({RAW})(?=[\s/>]).*?(?:</\1\s*>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+|\d+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int = 0


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; references decoded, white space made one space, empty ones left out."""
    page, out = page or "", []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    link, linked, at = False, 0, 0

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(tuple(x for tag, named in stack[-DEPTH:] for x in (tag, *named)), text, linked))
        parts.clear()
        linked = 0

    for found in TAG.finditer(page):
        if found.start() > at:
            parts.append(page[at : found.start()])
            linked += link * (found.start() - at)
        at = found.end()
        name = found[3]
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            link = not found[2]
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            end()
            link = False
            if found[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            else:
                closes = next((s for s in CLOSES if name in s), None)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or closes and stack[i][0] in closes:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "div", "section", "article", "select"):
                        break
                if name not in VOID:
                    named = [TOKEN.findall("".join(filter(None, m)).lower()) for m in NAMED.findall(found[4] or "")]
                    stack.append((name, tuple("." + t for ts in named for t in ts)))
    parts.append(page[at:])
    end()
    return out


def _hash(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def container(block: Block) -> tuple[str, ...]:
    """The path without its last element."""
    for i in range(len(block.path) - 1, -1, -1):
        if block.path[i][0] != ".":
            return block.path[:i]
    return ()


def vectors(found: list[Block]) -> np.ndarray:
    """One row for each block: hashed path, hashed words, and shares of links, length, punctuation,
    place, and of the page's text, blocks and links that stand in the same element."""
    out = np.zeros((len(found), WIDTH), np.float32)
    cache: dict[tuple[str, ...], list[int]] = {}
    inside: dict[tuple[str, ...], np.ndarray] = {}
    homes = [container(block) for block in found]
    for block, home in zip(found, homes):
        sums = inside.get(home)
        if sums is None:
            sums = inside[home] = np.zeros(3)
        sums += (len(block.text), 1, min(block.linked, len(block.text)))
    whole = sum(inside.values(), np.zeros(3))
    for i, (block, home) in enumerate(zip(found, homes)):
        at = cache.get(block.path)
        if at is None:
            at = cache[block.path] = [_hash(token, PATH) for token in set(block.path)]
        out[i, at] = 1
        words = block.text.split(" ")
        for word in words:
            out[i, PATH + hash_word(word)] += 1
        size, sums = len(block.text), inside[home]
        marks = block.text.count(",") + block.text.count(". ")
        plain = (min(1.0, block.linked / size), min(1.0, np.log1p(size) / 8), min(1.0, len(words) / 50), block.text[-1] in ".!?", i / len(found), 1 / (1 + i))
        out[i, PATH + WORDS :] = (*plain, sums[0] / whole[0], sums[1] / whole[1], sums[2] / sums[0], min(1.0, np.log1p(sums[0] / sums[1]) / 8), min(1.0, 8 * marks / size))
    out[:, PATH : PATH + WORDS] = np.log1p(out[:, PATH : PATH + WORDS])
    return out


def hash_word(word: str) -> int:
    return (len(word) * 7 + ord(word[0]) * 31 + ord(word[-1])) % WORDS


@dataclass
class Labeller:
    """Weights of both directions and of the output; `label` gives the probability of each block."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 1) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w[f"x{side}"] = (rng.standard_normal((WIDTH, 4 * HIDDEN)) / np.sqrt(WIDTH / 4)).astype(np.float32)
            w[f"h{side}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            w[f"c{side}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        w["o"] = (rng.standard_normal((2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        w["d"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x: time, page, feature. Padding leaves the state as it is."""
        n, pages, _ = x.shape
        wx, wh, c0 = self.weights[f"x{side}"], self.weights[f"h{side}"], self.weights[f"c{side}"]
        given = x @ wx + c0
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((n, pages, HIDDEN), np.float32), []
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            z = given[t] + h @ wh
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((t, i, f, o, g, c, h, tanh, m))
            c, h = np.where(m, new, c), np.where(m, o * tanh, h)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        ahead, tape_f = self._run("f", x, mask, keep)
        behind, tape_b = self._run("b", x, mask, keep)
        both = np.concatenate([ahead, behind], 2)
        p = 1 / (1 + np.exp(-np.clip((both @ self.weights["o"])[..., 0] + self.weights["d"], -30, 30)))
        return p, both, tape_f, tape_b

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, *tapes = self.forward(x, mask, keep=True)
        error = ((p - y) * mask / mask.sum()).astype(np.float32)[..., None]
        out = {"o": np.einsum("tpk,tpj->kj", both, error), "d": error.sum((0, 1))}
        back = error @ self.weights["o"].T
        for side, tape, dout in (("f", tapes[0], back[..., :HIDDEN]), ("b", tapes[1], back[..., HIDDEN:])):
            wh = self.weights[f"h{side}"]
            dz_all, dwh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(wh)
            dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
            for t, i, f, o, g, c, h, tanh, m in reversed(tape):
                dh = dh + dout[t]
                dnew = (dc + dh * o * (1 - tanh**2)) * m
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dh * m * tanh * o * (1 - o), dnew * i * (1 - g**2)], 1)
                dz_all[t] = dz
                dwh += h.T @ dz
                dh = np.where(m, dz @ wh.T, dh)
                dc = np.where(m, dnew * f, dc)
            out |= {f"x{side}": np.einsum("tpx,tpz->xz", x, dz_all), f"h{side}": dwh, f"c{side}": dz_all.sum((0, 1))}
        return out

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities for each page's blocks; pages of like length are run together."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            n, longest = 1, len(pages[order[0]])
            while n < len(order) and n < 128 and len(pages[order[n]]) <= longest + 8:
                n += 1
            some, order = order[:n], order[n:]
            x, mask = _padded([pages[i] for i in some])
            p = self.forward(x, mask)[0]
            for k, i in enumerate(some):
                out[i] = p[: len(pages[i]), k]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x, mask = np.zeros((n, len(pages), WIDTH), np.float32), np.zeros((n, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, True
    return x, mask


#: What markup says outright, for labels and for layouts (fixed values).
INSIDE = frozenset(("article", "main"))
OUTSIDE = frozenset("nav aside footer form title head button select label menu .ad .ads .advert .banner .menu .nav .navbar .sidebar .comment .comments .cookie .notice .share .related .promo .newsletter .footer .header .breadcrumb".split())


def told(block: Block) -> bool:
    return bool(INSIDE & set(block.path)) and not OUTSIDE & set(block.path)


FRAMES = (("article",), ("main", "article"), ("main",), ("div", ".content"), ("div", ".post", ".body"), ("section", ".entry"), ("div", ".main", ".content"), ("div", ".article"), ("div", ".story", "article"))
BEFORE = (("header",), ("header", "nav", "ul", "li"), ("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("div", ".nav"), ("div", ".ad"), ("div", ".cookie", ".notice"), ("div", ".notice"), ("div", ".banner"), ("form", "label"), ("form",), ("aside",), ("div", ".sidebar", "p"), ("div", ".breadcrumb"), ("div", ".header", "h1"), ("div", ".alert"), ("div", ".topbar"))
BEHIND = (("aside", "p"), ("aside", ".sidebar", "ul", "li"), ("div", ".sidebar", "h3"), ("section", ".comments", "p"), ("div", ".comments", "div", ".comment", "p"), ("div", ".comment"), ("ul", ".comments", "li"), ("ol", ".commentlist", "li"), ("div", ".related", "ul", "li"), ("form", ".newsletter"), ("form", "button"), ("footer",), ("footer", "p"), ("div", ".footer"), ("div", ".ads"), ("div", ".advert"), ("div", ".share"), ("div", ".promo"), ("section", ".related", "h2"))
WITHIN = (("div", ".ad"), ("aside",), ("div", ".share"), ("section", ".comments", "p"), ("div", ".promo"), ("form",), ("div", ".advert"), ("figure", "div", ".ad"))


def unnamed(path: tuple[str, ...], names: dict[str, str], rng: np.random.Generator) -> tuple[str, ...]:
    """The path with plain elements only and invented names for its named ones, the same name for the same."""
    out = []
    for token in path:
        if token[0] == "." or token in ("article", "main", "nav", "aside", "header", "footer", "section"):
            if token not in names:
                names[token] = "." + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) if rng.random() < 0.8 else ""
            out += ["div"] if token[0] != "." else []
            out += [names[token]] if names[token] else []
        else:
            out.append(token)
    return tuple(out)


def dressed(texts: list[str], others: list[str], rng: np.random.Generator, named: bool = True) -> tuple[list[Block], list[bool]]:
    """The texts as an article in some layout, with other texts around and now and then inside it.

    named False: no element or name tells what it holds, and what isn't the article is
    short, linked, or stands apart.
    """
    pick = lambda paths: paths[rng.integers(len(paths))]
    root, frame, names = ("html", "body"), pick(FRAMES), {}
    if rng.random() < 0.4:
        root = (*root, "div", *((".page",), (".wrapper",), (".container",), (".site",))[rng.integers(4)])

    def add(path: tuple[str, ...], text: str, label: bool, linked: int = 0) -> None:
        out.append(Block(path if named else unnamed(path, names, rng), text, linked))
        labels.append(label)

    def other(path: tuple[str, ...]) -> None:
        words = others[rng.integers(len(others))].split(" ")
        text = " ".join(words[: int(rng.choice([1, 2, 5, 15, 60] if named else [1, 2, 3, 5, 15]))])
        add(path, text, False, len(text) if rng.random() < (0.4 if named else 0.7) else 0)

    out: list[Block] = []
    labels: list[bool] = []
    if rng.random() < 0.7:
        out.append(Block(("html", "head", "title"), texts[0][:60]))
        labels.append(False)
    for _ in range(rng.integers(0, 4)):
        path = pick(BEFORE)
        for _ in range(rng.integers(1, 6)):
            other((*root, *path))
    for i, text in enumerate(texts):
        leaf = ("h1",) if i == 0 else (("p",), ("p",), ("p",), ("h2",), ("ul", "li"), ("blockquote", "p"), ("div",), ("pre",))[min(7, int(rng.exponential(1.5)))]
        add((*root, *frame, *leaf), text, True)
        if rng.random() < 0.08:
            other((*root, *frame, *pick(WITHIN)))
    if rng.random() < 0.3:
        for _ in range(rng.integers(1, 4)):
            other((*root, *frame, *pick((("section", ".comments", "p"), ("div", ".comments", "div", ".comment", "p")))))
    for _ in range(rng.integers(0, 5)):
        path = pick(BEHIND)
        for _ in range(rng.integers(1, 5)):
            other((*root, *path))
    return out, labels


def ends(page: list, most: int) -> list:
    """At most so many: the first half and the last half of them."""
    return page if len(page) <= most else page[: most // 2] + page[len(page) - most + most // 2 :]


def train(pages: list[str], epochs: int = 16, seed: int = 1, most_blocks: int = 60) -> Labeller:
    """Adam on the told labels of the pages and on three dressed versions of each, two of them unnamed.

    Of a page with more than most_blocks blocks, the first and the last ones are trained on.
    """
    rng = np.random.default_rng(seed)
    cut = [blocks(p) for p in pages]
    texts = [[b.text for b in page if told(b)] for page in cut]
    others = [b.text for page in cut for b in page if len(b.text) > 1] or ["none"]
    data = [(page, [told(b) for b in page]) for page in cut if any(map(told, page))]
    for page in texts:
        if page:
            for named in (True, False, False):
                n = int(rng.integers(1, len(page) + 1))
                data.append(dressed(ends(page[:n], most_blocks // 2), others, rng, named))
    model = Labeller.fresh(seed)
    # vectors of whole pages, as their shares are, then the blocks trained on
    ready = sorted(((np.array(ends(list(vectors(b)), most_blocks)), np.array(ends(y, most_blocks), np.float32)) for b, y in data if b), key=lambda d: len(d[0]))
    groups = [ready[i : i + 24] for i in range(0, len(ready), 24)]
    first, second, step = {k: 0.0 for k in model.weights}, {k: 0.0 for k in model.weights}, 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _padded([v for v, _ in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(groups[g]):
                y[: len(labels), k] = labels
            step += 1
            for k, d in model.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                rate = 0.02 if epoch < epochs * 0.6 else 0.005
                model.weights[k] = (model.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> Labeller:
    """Trains on at most `sample` pages, chosen by a hash, each of at most SAMPLE_CHARS characters."""
    hashed = pages.filter(F.length(html) <= SAMPLE_CHARS).select(html, F.xxhash64(html).alias("_h"))
    # the hashes alone are ordered, and copies count once, so few rows reach the driver whatever the table's size
    last = hashed.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if last is None:
        return train([])
    rows = hashed.filter(F.col("_h") <= last).groupBy("_h").agg(F.first(html).alias("page")).collect()
    return train([r.page for r in sorted(rows, key=lambda r: r["_h"])])


def main_text(found: list[Block], p: np.ndarray) -> str:
    return "\n\n".join(b.text for b, q in zip(found, p) if q > 0.5)


def extract(df: DataFrame, model: Labeller, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of the whole page, blocks joined by blank lines; empty for null or where no
    block is of the article. `out` is replaced; other columns and repeated rows stay."""
    names = [c for c in df.columns if c != out]
    schema = df.select(*[f"`{c}`" for c in names]).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = [blocks(v.as_py()) for v in batch.column(batch.schema.get_field_index(html))]
                labels = model.label([vectors(b) for b in found])
                values = pa.array([main_text(b, p) for b, p in zip(found, labels)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), values], names=[*names, out])

    return df.mapInArrow(run, schema)
