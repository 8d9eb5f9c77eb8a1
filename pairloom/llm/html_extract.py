"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into its leaf blocks: runs of text that no block element parts, with the elements
that enclose them. Each block has features of its ancestors (element names, words of class, id
and role) and of its text. A chain over the blocks of a page with two labels is trained by
gradient steps on the log likelihood of labelled pages and decoded by Viterbi.

Scripts, styles, comments, head data and other text that a browser doesn't show make no block.
Character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones left out, and main blocks joined by one line feed in page order. A head without
an end tag ends at the first start tag or text that can't stand in it.

Reading goes forward only, elements know the one around them, and labelling enters each element
once, so time grows with the page's length, whatever the markup.

Results for special input: a null or empty html gives the empty text; text without any element
is one block; unclosed and crossed elements are closed where their parent ends; a null or
repeated page_id gives a row each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.llm.common import slices
from pairloom.llm.html_pages import page

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
MARKS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
#: Elements of formulas, which are part of their line; annotations aren't shown.
MATH = frozenset("annotation annotation-xml maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: Fixed values of HTML: elements inside a line of text, without an end tag, and whose content is not shown.
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark object q s samp small span strike strong sub sup svg time tt u var wbr canvas audio video math".split()) | MATH
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes".split())
HIDDEN = frozenset("annotation annotation-xml audio button canvas head object option select svg video".split())
#: Start tags that can stand in a head; any other, or text, closes an open one.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that a start tag of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
STOPS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul xmp".split())


def tag_end(source: str, at: int) -> int:
    """Where the '>' stands that ends a tag whose name ends at `at`; the source's length if there is none.

    A quote that follows '=' holds everything up to the next one of its kind; any other, or one
    that is never closed, is an ordinary character. Goes forward only.
    """
    while (m := MARKS.search(source, at)) is not None:
        k = m.start()
        if source[k] == ">":
            return k
        at = k + 1
        if source[:k].endswith("=") if k < 64 else source[k - 64 : k].rstrip().endswith("="):
            if (end := source.find(source[k], at)) >= 0:
                at = end + 1
    return len(source)


class Element:
    """A block element of a page: its mark (name with class, id and role words), the element around it, and how many enclose it, itself included."""

    __slots__ = ("above", "mark", "depth")

    def __init__(self, above: Element | None, mark: str):
        self.above, self.mark, self.depth = above, mark, above.depth + 1 if above else 1


Block = tuple[Element | None, str, float]


def blocks(source: str) -> list[Block]:
    """Leaf blocks in order: the innermost block element around them, text, and share of text in links."""
    out: list[Block] = []
    open_: list[tuple[str, Element | None]] = []
    count: Counter[str] = Counter()
    text: list[str] = []
    linked = total = hidden = links = 0
    around: Element | None = None

    def flush() -> None:
        nonlocal linked, total
        if text:
            joined = SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append((around, joined, linked / max(1, total)))
            text.clear()
        linked = total = 0

    def say(part: str, literal: bool = False) -> None:
        nonlocal linked, total, around
        if open_ and open_[-1][0] == "head" and part.strip():
            close(len(open_) - 1)
        if hidden or not part:
            return
        part = entities.unescape(part) if "&" in part and not literal else part
        if not text:
            around = open_[-1][1] if open_ else None
        text.append(part)
        n = len(part.strip())
        total += n
        linked += n if links else 0

    def close(k: int) -> None:
        """Close the open elements from place k on."""
        nonlocal hidden, links
        for name, _ in open_[k:]:
            count[name] -= 1
            hidden -= name in HIDDEN
            links -= name == "a"
        del open_[k:]

    def raw_end(name: str, at: int) -> tuple[int, int]:
        """Where the content of an element without markup ends, and where its end tag does."""
        end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
        return (end.start(), min(len(source), tag_end(source, end.end()) + 1)) if end else (len(source), len(source))

    at = 0
    while (m := TAG.search(source, at)) is not None:
        say(source[at : m.start()])
        if m[1] or m[2]:
            end = source.find("-->" if m[1] else ">", m.end())
            at = len(source) if end < 0 else end + (3 if m[1] else 1)
            continue
        end = tag_end(source, m.end())
        inside, at = source[m.end() : end], min(len(source), end + 1)
        name = m[4].lower()
        if hidden and count["head"] and (name in ("body", "br", "html") if m[3] else name not in IN_HEAD):
            close(next(k for k, (other, _) in enumerate(open_) if other == "head"))
        if not hidden and (name not in INLINE or name in ("br",)):
            flush() if name != "br" else text.append(" ") if text else None
        if m[3]:
            for k in range(len(open_) - 1, -1, -1) if count[name] > 0 else ():
                if open_[k][0] == name:
                    close(k)
                    break
                if name in INLINE and open_[k][0] not in INLINE:
                    break
            continue
        if name in VOID or inside.rstrip().endswith("/") and name not in RAW and name != "xmp":
            continue
        if name in RAW:
            at = raw_end(name, at)[1]
            continue
        ends = SELF_CLOSING.get(name, set()) | ({"p"} if name in STOPS_P else set())
        if any(count[e] > 0 for e in ends):
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in ends:
                    close(k)
                    break
                if open_[k][0] not in INLINE and open_[k][0] not in ends:
                    break
        above = open_[-1][1] if open_ else None
        if name not in INLINE:
            words = " ".join((a[1] or a[2] or a[3]).lower() for a in (x.groups() for x in ATTRIBUTE.finditer(inside)) if a[1] or a[2] or a[3]) if inside else ""
            above = Element(above, f"{name} {words}" if words else name)
        open_.append((name, above))
        count[name] += 1
        hidden += name in HIDDEN
        links += name == "a"
        if name == "xmp":  # shown as it is written
            end, after = raw_end(name, at)
            say(source[at:end], literal=True)
            flush()
            close(len(open_) - 1)
            at = after
    say(source[at:])
    flush()
    return out


@lru_cache(1 << 12)
def _mark_features(mark: str) -> frozenset[str]:
    """What a block gets from an element of this mark around it."""
    name, _, words = mark.partition(" ")
    out = {"in:" + name}
    for w in NAME.findall(words):
        out.add("is:" + w)
        out.update("has:" + k for k in KEYS if k in w)
    return frozenset(out)


def _own_features(element: Element | None, text: str, linked: float) -> list[str]:
    """What a block gets from its text and the innermost element."""
    n = len(text)
    words = text.count(" ") + 1
    out = [f"words:{min(words.bit_length(), 7)}", f"links:{round(3 * linked)}"]
    if element:
        name, _, marked = element.mark.partition(" ")
        out += ["leaf:" + name, "marked" if marked else "bare"]
    out.append("stop" if text[-1] in ".!?…\"»”" else "no stop")
    if "©" in text or "copyright" in text[:80].lower():
        out.append("copyright")
    if words > 3 and text.count(",") + text.count(".") > n / 60:
        out.append("prose")
    return out


#: Parts of class, id and role words that occur in many compounds.
KEYS = ("nav", "menu", "foot", "head", "side", "comment", "cookie", "ad", "promo", "share", "social", "content", "article", "post", "body", "main", "related", "form", "search", "notice", "copy")


def features(element: Element | None, text: str, linked: float) -> list[str]:
    """All features of a block: those of every element around it, each once, and its own."""
    own, around = _own_features(element, text, linked), set()
    while element:
        around |= _mark_features(element.mark)
        element = element.above
    return [*sorted(around), *own]


class Trail:
    """Weights of the elements around the block at hand.

    Blocks come in page order, so going from one to the next leaves and enters each element once.
    An element adds the weights of those features that none around it has.
    """

    def __init__(self, weights: dict[str, tuple[float, float]]):
        self.weights = weights
        self.steps: list[tuple[Element, float, float, list[str]]] = []
        self.active: set[str] = set()

    def go(self, to: Element | None) -> tuple[float, float]:
        enter = []
        while to and not (to.depth <= len(self.steps) and self.steps[to.depth - 1][0] is to):
            enter.append(to)
            to = to.above
        while len(self.steps) > (to.depth if to else 0):
            self.active.difference_update(self.steps.pop()[3])
        for element in reversed(enter):
            _, a, b, _ = self.steps[-1] if self.steps else (None, 0.0, 0.0, None)
            new = [f for f in sorted(_mark_features(element.mark)) if f not in self.active]
            for f in new:
                w = self.weights.get(f, (0.0, 0.0))
                a, b = a + w[0], b + w[1]
            self.active.update(new)
            self.steps.append((element, a, b, new))
        return self.steps[-1][1:3] if self.steps else (0.0, 0.0)


class Chain:
    """Two labels; weights of features by label, of label pairs, and of the first label."""

    def __init__(self, weights: dict[str, tuple[float, float]], pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def label(self, page_blocks: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not page_blocks:
            return []
        (p00, p01), (p10, p11) = self.pairs.tolist()
        none = (0.0, 0.0)
        get = self.weights.get
        back: list[tuple[int, int]] = []
        a = b = 0.0
        trail = Trail(self.weights)
        for k, block in enumerate(page_blocks):
            e0, e1 = trail.go(block[0])
            for f in _own_features(*block):
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if k == 0:
                a, b = self.first[0] + e0, self.first[1] + e1
                continue
            to0, to1 = (0, a + p00) if a + p00 >= b + p10 else (1, b + p10), (0, a + p01) if a + p01 > b + p11 else (1, b + p11)
            back.append((to0[0], to1[0]))
            a, b = to0[1] + e0, to1[1] + e1
        now = int(b >= a)
        out = [now]
        for step in reversed(back):
            now = step[now]
            out.append(now)
        return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.2, ridge: float = 1e-3) -> Chain:
    """Maximise the log likelihood of the labels, page by page, with per-weight step sizes."""
    names = {f: k for k, f in enumerate(sorted({f for xs, _ in pages for x in xs for f in x}))}
    data = [([np.array([names[f] for f in x]) for x in xs], np.array(ys)) for xs, ys in pages if ys]
    w, pairs, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(x, 1e-1) for x in (w, pairs, first)]
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            xs, ys = data[k]
            n = len(ys)
            e = np.array([w[x].sum(axis=0) for x in xs])
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = first + e[0]
            for t in range(1, n):
                forward[t] = _log_sum(forward[t - 1][:, None] + pairs, 0) + e[t]
            for t in range(n - 2, -1, -1):
                backward[t] = _log_sum(pairs + (e[t + 1] + backward[t + 1])[None], 1)
            z = _log_sum(forward[-1], 0)
            one = np.exp(forward + backward - z)
            gap = np.eye(2)[ys] - one
            gp = np.zeros((2, 2))
            for t in range(1, n):
                gp -= np.exp(forward[t - 1][:, None] + pairs + (e[t] + backward[t])[None] - z)
                gp[ys[t - 1], ys[t]] += 1
            flat = np.concatenate(xs)
            own, place = np.unique(flat, return_inverse=True)
            gw = np.zeros((len(own), 2))
            np.add.at(gw, place, np.repeat(gap, [len(x) for x in xs], axis=0))
            for value, s, g, at in ((w, seen[0], gw - ridge * w[own], own), (pairs, seen[1], gp, slice(None)), (first, seen[2], gap[0], slice(None))):
                s[at] += g * g
                value[at] += rate * g / np.sqrt(s[at])
    return Chain({f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}, pairs, first)


def labelled(seed: int) -> tuple[list[Block], list[int]]:
    """Blocks of a written page and their labels: its parts are told apart by marks that are taken out again."""
    parts = page(seed)
    found = blocks("".join(_mark(html) if label else html for label, html in parts))
    return [(around, text.replace(MARK, ""), linked) for around, text, linked in found], [int(MARK in text) for _, text, _ in found]


#: A private character that no written page contains.
MARK = "\ue000"


def _mark(html: str) -> str:
    """Put the mark in front of each run of text."""
    return re.sub(r"(>|^)([^<>\s])", rf"\1{MARK}\2", html)


_trained: dict[tuple[int, int], Chain] = {}


def trained_chain(pages: int = 240, seed: int = 0) -> Chain:
    """The chain fitted on this many written pages, once in a process."""
    if (pages, seed) not in _trained:
        data = []
        for k in range(pages):
            found, ys = labelled(seed * 1_000_003 + k)
            data.append(([features(*b) for b in found], ys))
        _trained[pages, seed] = train(data)
    return _trained[pages, seed]


def main_text(source: str, chain: Chain) -> str:
    found = blocks(source)
    return "\n".join(b[1] for b, y in zip(found, chain.label(found), strict=True) if y)


def extract_text(pages: DataFrame, *, chain: Chain | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row; no shuffle."""
    chain = chain or trained_chain()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [main_text(h or "", chain) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(id_column, url_column, html_column).mapInArrow(run, "page_id long, url string, text string, n_chars long")
