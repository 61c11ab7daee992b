"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks in page order: runs of text between block-level tags, with the path of open elements
(names, classes, ids, roles). Scripts, styles, the head and comments of the markup are not rendered and make no block.
A bidirectional LSTM in numpy reads the sequence of all blocks of the page, each as hashed vectors of its tag path and of
its words and a few measures, and labels every block from the whole page's context; the main blocks are the text.

The model is trained by html_training.py on generated pages and stored next to this module; it is loaded on the driver,
bounded in size, and sent with the tasks. Pages are labelled in groups of like length of at most GROUP blocks (padding
counted) or of one page. All words of a block, all elements of its path and all blocks of a page reach the model: path
vectors are sums that a child element takes over from its parent, so that deep pages cost no more than flat ones.

Defined edge cases: null or empty html, or html without a main block, gives an empty text. Repeated rows are labelled row
by row. Broken markup is read like a browser does: unknown or unclosed tags never stop the reading. A page is never cut.
Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

MODEL = Path(__file__).parent / "models" / "html_blocks.npz"

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe input label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul video audio canvas".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not rendered, and ends only at their end tag.
RAW_TAGS = frozenset("script style noscript template title iframe noembed noframes svg object".split())
CLOSES_P = BLOCK_TAGS - frozenset("br button input label option optgroup td th tr tbody thead tfoot caption body html li dd dt legend summary select textarea iframe video audio canvas".split())
#: An opening tag that ends an open one of its kind, and the tags beyond which it doesn't look.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

_QUOTE_OR_END = re.compile("[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label|aria-hidden|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.I)
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[a-z]+|[0-9]+")


PATH_BUCKETS, WORD_BUCKETS, MEASURES = 1024, 1024, 8
#: Blocks of the pages that are labelled together, padding counted; a longer page goes alone.
GROUP = 16_384
#: Words beyond which a block's vector comes from counts.
LONG_BAG = 512
#: Steps whose gates are held at once.
STRETCH = 2048


@lru_cache(maxsize=200_000)
def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


class Element:
    """An open element as blocks see it: its marks, its parent, and the hashed features that it adds to the path."""

    __slots__ = ("added", "fresh", "index", "marks", "name", "parent")

    def __init__(self, index: int, parent: Element | None, marks: tuple[str, ...], held: Counter):
        self.index, self.parent, self.marks = index, parent, marks
        above = parent.name if parent else ""
        self.name = above if marks[0] in ("html", "body") else marks[0]
        self.added = [f"m:{m}" for m in set(marks)]
        if above and self.name is marks[0]:
            self.added.append(f"p:{above}>{marks[0]}")
        self.fresh = tuple([_bucket(x, PATH_BUCKETS) for x in self.added if not held[x]])
        for x in self.added:
            held[x] += 1


class Block:
    """path: the innermost open element, or None."""

    __slots__ = ("links", "path", "text")

    def __init__(self, path: Element | None, text: str, links: int):
        self.path, self.text, self.links = path, text, links


def _tag_end(page: str, at: int) -> int:
    """Place after the > that ends the tag; quotes count only as attribute values."""
    while m := _QUOTE_OR_END.search(page, at):
        if m[0] == ">":
            return m.end()
        before = m.start() - 1
        while before >= 0 and page[before] in " \t\n\r\f":
            before -= 1
        close = page.find(m[0], m.end()) if page[before] == "=" else m.start()
        if close < 0:
            at = page.find(">", m.end())
            return at + 1 if at >= 0 else len(page)
        at = close + 1
    return len(page)


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """Words that an element puts on the path: its name, and the parts of its class, id and role."""
    out = [tag]
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or (name == "aria-hidden" and "true" in value) or HIDES.search(value):
                out.append("@hidden")
            continue
        parts = _PARTS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value.strip("\"'")).lower())
        out += [f"@{p}" for p in parts if not p.isdigit()]
    return tuple(out)


def read_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in page order; every block has text."""
    blocks: list[Block] = []
    stack: list[tuple[str, Element]] = []
    open_: Counter[str] = Counter()
    held: Counter[str] = Counter()
    made = 0
    pieces: list[str] = []
    links = 0
    path: Element | None = None
    started = False
    at, n = 0, len(page)
    low = None

    def flush() -> None:
        nonlocal links, path, started
        if pieces:
            raw = "".join(pieces)
            text = " ".join(entities.unescape(raw).split())
            if text:
                blocks.append(Block(path, text, links))
            pieces.clear()
        links, path, started = 0, None, False

    def add(text: str) -> None:
        nonlocal links, path, started
        if not started and not text.isspace():
            path, started = stack[-1][1] if stack else None, True
        pieces.append(text)
        if open_["a"]:
            links += len(text)

    def close(i: int) -> None:
        for tag, element in stack[i:]:
            open_[tag] -= 1
            for x in element.added:
                held[x] -= 1
        del stack[i:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4) if not page.startswith("<!-->", lt) else lt + 2
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            continue
        closing = nxt == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            if closing:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                add("<")
                at = lt + 1
            continue
        tag, end = m[0].lower(), _tag_end(page, m.end())
        attributes = page[m.end() : end - 1]
        at = end
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1) if open_["p"] else ():
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "li", "div", "article", "section", "button", "table"):
                    break
        if tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            cut = len(stack)
            for i in range(len(stack) - 1, -1, -1) if any(open_[x] for x in ends) else ():
                if stack[i][0] in stops:
                    break
                if stack[i][0] in ends:
                    cut = i
            close(cut)
        if tag in RAW_TAGS:
            if attributes.endswith("/") and tag in ("svg", "object"):
                continue
            low = low or page.lower()
            end = low.find(f"</{tag}", at) if len(low) == n else -1
            if end < 0 and len(low) != n and (m := re.compile(f"</{tag}", re.I).search(page, at)):
                end = m.start()
            if end < 0:
                at = n
            else:
                end = page.find(">", end)
                at = end + 1 if end >= 0 else n
        elif tag not in VOID_TAGS and not (attributes.endswith("/") and tag not in BLOCK_TAGS):
            if tag == "a" and open_["a"]:  # links do not nest: a second one ends the first
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "a"))
            stack.append((tag, Element(made, stack[-1][1] if stack else None, _marks(tag, attributes), held)))
            made += 1
            open_[tag] += 1
    flush()
    return blocks


@lru_cache(maxsize=20_000)
def tail_buckets(marks: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    """Features of the last elements of a path by their distance from the leaf."""
    return tuple(_bucket(f"l{i}:{m}", PATH_BUCKETS) for i, element in enumerate(marks) for m in set(element))


def last_marks(path: Element | None) -> tuple[tuple[str, ...], ...]:
    out = []
    while path is not None and len(out) < 4:
        out.append(path.marks)
        path = path.parent
    return tuple(out)


def path_buckets(path: Element | None) -> tuple[int, ...]:
    """Hashed features of a tag path: all its marks and pairs of neighbours, and the last elements by their distance."""
    out = list(tail_buckets(last_marks(path)))
    while path is not None:
        out += path.fresh
        path = path.parent
    return tuple(out)


def path_means(table: np.ndarray, blocks: list[Block], known: dict | None = None) -> np.ndarray:
    """What bag_means gives for the blocks' path_buckets, with each element's part summed once. known: sums by bucket tuple,
    kept from page to page."""
    known = {} if known is None else known
    none = np.zeros(table.shape[1], table.dtype)

    def total(buckets: tuple[int, ...]) -> np.ndarray:
        if (x := known.get(buckets)) is None:
            x = known[buckets] = table[list(buckets)].sum(0) if buckets else none
        return x

    sums: dict[int, tuple[np.ndarray, int]] = {-1: (none, 0)}
    paths, ends, sizes = [], [], []
    for block in blocks:
        todo, at = [], block.path
        while at is not None and at.index not in sums:
            todo.append(at)
            at = at.parent
        for x in reversed(todo):
            above, n = sums[x.parent.index if x.parent else -1]
            sums[x.index] = (above + total(x.fresh), n + len(x.fresh)) if x.fresh else (above, n)
        path, n = sums[block.path.index if block.path else -1]
        last = tail_buckets(last_marks(block.path)) or (0,)  # no path at all is the first bucket
        paths.append(path)
        ends.append(total(last))
        sizes.append(n + len(last))
    return (np.stack(paths) + np.stack(ends)) / np.sqrt(np.array(sizes, table.dtype))[:, None] if blocks else np.zeros((0, table.shape[1]), table.dtype)


_WORD = re.compile(r"[^\W_]+")


class _Words(dict):
    """Buckets of words that have come by."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return found


_WORDS = _Words()


def word_buckets(text: str) -> tuple[int, ...]:
    return tuple(map(_WORDS.__getitem__, _WORD.findall(text.lower()))) or (0,)


def measures(block: Block, i: int, n: int) -> list[float]:
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    stops = sum(map(text.count, ".,;:!?"))
    return [np.log1p(size) / 6, np.log1p(words) / 4, min(1.0, block.links / size), min(1.0, 8 * stops / size), i / n, np.log1p(n) / 5, float("©" in text), sum(map(text.count, "0123456789")) / size]


class Labeller:
    """Forward pass of the model. Parameters: by name, as html_training.py stores them."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = {k: v.astype(np.float32) for k, v in parameters.items()}
        self.known: dict = {}

    @classmethod
    def load(cls, path: Path = MODEL) -> Labeller:
        with np.load(path) as stored:
            return cls({k: stored[k] for k in stored.files})

    def inputs(self, blocks: list[Block]) -> np.ndarray:
        """A row for each block: path vector, word vector, measures."""
        p, n = self.p, len(blocks)
        words = np.concatenate([bag_means(p["word"], [word_buckets(b.text) for b in blocks[at : at + 1000]]) for at in range(0, n, 1000)])
        return np.concatenate([np.tanh(path_means(p["path"], blocks, self.known)), np.tanh(words), np.array([measures(b, i, n) for i, b in enumerate(blocks)], np.float32)], 1)

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the log odds of each block to be main text."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        by_length = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(by_length):
            to = at + 1
            while to < min(at + 64, len(by_length)) and len(pages[by_length[to]]) * (to + 1 - at) <= GROUP:
                to += 1
            part, at = by_length[at:to], to
            x = [self.inputs(pages[i]) for i in part]
            lengths = np.array([len(v) for v in x])
            padded = np.zeros((lengths.max(), len(part), x[0].shape[1]), np.float32)
            for k, v in enumerate(x):
                padded[: len(v), k] = v
            odds, row = padded @ self.p["out"][-padded.shape[2] :] + self.p["out_bias"], 0
            for d in ("forward", "backward"):
                states = lstm_states(padded, lengths, self.p, d)
                odds += states @ self.p["out"][row : row + states.shape[2]]
                row += states.shape[2]
            for k, i in enumerate(part):
                out[i] = odds[: lengths[k], k, 0]
        return out


def bag_means(vectors: np.ndarray, bags: list[tuple[int, ...]]) -> np.ndarray:
    """The sum of each bag's vectors over the root of its size."""
    sizes = np.array([len(b) for b in bags])
    small = np.flatnonzero(sizes <= LONG_BAG)
    sums = np.zeros((len(bags), vectors.shape[1]), vectors.dtype)
    if len(small):
        flat = np.fromiter(chain.from_iterable(bags[k] for k in small.tolist()), np.int64, sizes[small].sum())
        sums[small] = np.add.reduceat(vectors[flat], np.concatenate(([0], np.cumsum(sizes[small])[:-1])), 0)
    for k in np.flatnonzero(sizes > LONG_BAG):
        sums[k] = np.bincount(bags[k], minlength=len(vectors)).astype(vectors.dtype) @ vectors
    return sums / np.sqrt(sizes)[:, None].astype(vectors.dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm_states(x: np.ndarray, lengths: np.ndarray, p: dict[str, np.ndarray], direction: str, tape: list | None = None) -> np.ndarray:
    """Hidden states of all steps of x (step, sequence, feature), in reading order of the direction. Steps past a
    sequence's length leave its state at zero. tape: gets what the backward pass of training needs."""
    steps, n, _ = x.shape
    w, u, b = p[f"{direction}_x"], p[f"{direction}_h"], p[f"{direction}_b"]
    size = u.shape[0]
    gates, base = None, -1
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out = np.zeros((steps, n, size), x.dtype)
    for t in range(steps) if direction == "forward" else range(steps - 1, -1, -1):
        if t // STRETCH != base:
            base = t // STRETCH
            gates = x[base * STRETCH : (base + 1) * STRETCH] @ w + b
        live = (t < lengths).astype(x.dtype)[:, None]
        g = gates[t - base * STRETCH] + h @ u
        i, f, o, z = sigmoid(g[:, :size]), sigmoid(g[:, size : 2 * size]), sigmoid(g[:, 2 * size : 3 * size]), np.tanh(g[:, 3 * size :])
        new_c = f * c + i * z
        squashed = np.tanh(new_c)
        if tape is not None:
            tape.append((t, live, i, f, o, z, c, h, squashed))
        c, h = live * new_c, live * o * squashed
        out[t] = h
    return out


def extract_text(pages: DataFrame, parameters: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_main of each row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(parameters or Labeller.load().p)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        labeller = _labeller(sent)
        out: dict[str, list] = {"page_id": batch["page_id"], "url": batch["url"], "text": [], "n_chars": [], "n_blocks": [], "n_main": []}
        for at in range(0, len(batch["html"]), 512):
            read = [read_blocks(x) if x else [] for x in batch["html"][at : at + 512]]
            for blocks, odds in zip(read, labeller.scores(read), strict=True):
                main = [b.text for b, x in zip(blocks, odds, strict=True) if x > 0]
                text = " ".join(main)
                for c, v in (("text", text), ("n_chars", len(text)), ("n_blocks", len(blocks)), ("n_main", len(main))):
                    out[c].append(v)
        return out

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), rows, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def _labeller(sent) -> Labeller:
    if getattr(sent, "_labeller", None) is None:
        sent._labeller = Labeller(sent.value)
    elif len(sent._labeller.known) > 50_000:
        sent._labeller.known.clear()
    return sent._labeller


def op1_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
