"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between the borders of
block-level elements, each with its path of tags, classes and ids.  A block
becomes a vector of its path's hashed parts, its hashed words and a few numbers.
A bidirectional LSTM in numpy reads the sequence of a page's blocks and labels
each one as article or not, so that a block's label depends on the whole page.

The network is trained on the driver by backpropagation through time, on pages
that `synthetic_page` makes up with known labels; it never sees a row of the
table.  Weights are broadcast; each page is handled where it is read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import _sigmoid, adam

BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea svg math".split())
#: An open element of the second kind ends where one of the first begins.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK_TAGS - CLOSES.keys() - {"body", "html", "head"}}
#: Closing by implication doesn't reach over these.
SCOPES = frozenset("ul ol dl table article section div aside nav main form body blockquote header footer".split())

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
SPECIAL = re.compile("""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[a-z]+")

PATHS, WORDS = 2048, 1024
PATH_WIDTH, WORD_WIDTH, NUMBERS = 12, 6, 7


#: Cells (block, page) that one batch of pages may have, and steps whose input to the network is held at once.
CELLS, STEPS = 1 << 15, 4096


class Path:
    """The open elements at a block: the innermost one's tag, the parts (tags,
    classes, ids) that it adds to those around it, and its parent."""

    __slots__ = ("parts", "slots", "tag", "up")

    def __init__(self, up: Path | None, tag: str, parts: tuple[str, ...]):
        self.up, self.tag, self.parts = up, tag, parts
        self.slots = np.array([zlib.crc32(x.encode()) % PATHS for x in parts], np.int64)

    def line(self) -> Iterator[Path]:
        at: Path | None = self
        while at is not None:
            yield at
            at = at.up

    def all_slots(self) -> np.ndarray:
        """Slots of all distinct parts, and one of the innermost tag."""
        return np.concatenate([*(x.slots for x in self.line()), [leaf_slot(self.tag)]]).astype(np.int64)


def leaf_slot(tag: str) -> int:
    return zlib.crc32(f"leaf t:{tag}".encode()) % PATHS


class Tags:
    """The tags of a page, found in time linear in its length: how a tag that
    begins before a quote or a bracket ends is worked out once for each of these."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.ends: dict[int, int] = {}
        self.next_special = -1

    def _special(self, at: int) -> int:
        """The first bracket or quote from a place on that never goes back; -1 without one."""
        if self.next_special < at:
            m = SPECIAL.search(self.page, at)
            self.next_special = m.start() if m else len(self.page)
        return self.next_special

    def end(self, at: int) -> int:
        """Where the tag whose name ends at `at` has its closing bracket; -1 if it has none."""
        if at > self.last[">"]:
            return -1
        j, seen = self._special(at), []
        while True:
            if j >= len(self.page):
                found = -1
            elif j in self.ends:
                found = self.ends[j]
            elif self.page[j] == ">":
                found = j
            elif j >= self.last[self.page[j]]:
                found = -1  # a quote that nothing closes
            else:
                seen.append(j)
                m = SPECIAL.search(self.page, self.page.find(self.page[j], j + 1) + 1)
                j = m.start() if m else len(self.page)
                continue
            for k in seen:
                self.ends[k] = found
            return found

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, tag, whether it closes, the rest); comments and the like have no tag.
        The scan goes on from `at`, which its reader may move forward."""
        page, self.at = self.page, 0
        while (i := page.find("<", self.at)) >= 0:
            nxt = page[i + 1 : i + 2]
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                found = (i, len(page) if end < 0 else end + 3, "", False, "")
            elif nxt in ("!", "?"):
                end = page.find(">", i + 2) if i < self.last[">"] else -1
                found = (i, end + 1, "", False, "") if end >= 0 else None
            else:
                closes = nxt == "/"
                name = NAME.match(page, i + 1 + closes)
                end = self.end(name.end()) if name else -1
                found = (i, end + 1, name[0].lower(), closes, page[name.end() : end]) if end >= 0 else None
            if found is None:
                # Not a tag: the text goes on.  What has been read stays read.
                self.at = i + 1
                continue
            self.at = found[1]
            yield found


def blocks(page: str) -> list[tuple[Path, str, float]]:
    """(path, text, share of the text in links) of each non-empty leaf block, in order."""
    out: list[tuple[Path, str, float]] = []
    root = Path(None, "", ())
    stack: list[Path] = []
    places: dict[str, list[int]] = {}  # tag -> its places in the stack
    scopes: list[int] = []
    held: dict[str, int] = {}  # part -> how many open elements have added it (0 or 1)
    pieces: list[str] = []
    path, in_links, links, at = root, 0, 0, 0

    def add(raw: str) -> None:
        nonlocal path, in_links
        if not raw or not pieces and raw.isspace():
            return
        if not pieces:
            path, in_links = stack[-1] if stack else root, 0
        pieces.append(raw)
        if links:
            in_links += len(raw)

    def end() -> None:
        if pieces:
            raw = "".join(pieces)
            pieces.clear()
            text = " ".join(html.unescape(raw).split())
            if text:
                out.append((path, text, in_links / len(raw)))

    def close_from(i: int) -> None:
        nonlocal links
        while len(stack) > i:
            top = stack.pop()
            places[top.tag].pop()
            links -= top.tag == "a"
            if scopes and scopes[-1] == len(stack):
                scopes.pop()
            for x in top.parts:
                del held[x]

    tags = Tags(page)
    for start, stop, tag, closes, rest in tags:
        add(page[at:start])
        at = stop
        if not tag:
            continue
        if closes:
            if tag in BLOCK_TAGS:
                end()
            if places.get(tag):
                close_from(places[tag][-1])
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            tags.at = at = close.end() if close else len(page)
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCK_TAGS:
            end()
            low = scopes[-1] if scopes else -1
            while True:
                i = max((places[x][-1] for x in CLOSES.get(tag, ()) if places.get(x)), default=-1)
                if i <= low:
                    break
                close_from(i)
        if tag not in VOID_TAGS and not rest.endswith("/"):
            parts = [f"t:{tag}"]
            for name, value in ATTRIBUTE.findall(rest):
                parts += [f"c:{x}" for x in PARTS.findall(value.lower())] if name else []
            fresh = tuple(x for x in dict.fromkeys(parts) if x not in held)
            held.update(dict.fromkeys(fresh, 1))
            places.setdefault(tag, []).append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
            links += tag == "a"
            stack.append(Path(stack[-1] if stack else root, tag, fresh))
    add(page[at:])
    end()
    return out


class Vectors:
    """Hashes of words, with a cache of bounded size."""

    def __init__(self, cache_size: int = 100_000):
        self.words: dict[str, int] = {}
        self.limit = cache_size

    def word(self, w: str) -> int:
        n = self.words.get(w)
        if n is None:
            if len(self.words) >= self.limit:
                self.words = {}
            n = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
            if len(w) <= 64:
                self.words[w] = n
        return n


def numbers(i: int, n: int, text: str, words: int, links: float) -> list[float]:
    size = len(text)
    return [min(np.log1p(words) / 5, 2), links, text.count(".") / (words + 1), (text[-1] in ".!?…:\"'”»") * 1.0, i / n, size / (words + 1) / 10 if words < 400 else 0.5, 1.0]


def init(hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    width = PATH_WIDTH + WORD_WIDTH + NUMBERS
    w = {"path": normal(PATHS, PATH_WIDTH, scale=0.1), "word": normal(WORDS, WORD_WIDTH, scale=0.05), "out": normal(2 * hidden, scale=0.3), "bias": np.zeros(1, np.float32)}
    for way in "fb":
        w["x" + way] = normal(width, 4 * hidden, scale=width**-0.5)
        w["h" + way] = normal(hidden, 4 * hidden, scale=hidden**-0.5)
        w["b" + way] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)  # input, forget, output, new
    return w


def inputs(w: dict[str, np.ndarray], pages: list[list[tuple[Path, np.ndarray, list[float]]]]) -> tuple[np.ndarray, np.ndarray]:
    """(block, page, width) vectors of pages of (path, words, numbers), and which are real."""
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), PATH_WIDTH + WORD_WIDTH + NUMBERS), np.float32)
    real = np.zeros((steps, len(pages), 1), np.float32)
    for j, page in enumerate(pages):
        sums: dict[int, np.ndarray] = {}  # of each path's parts, its parents' included
        for t, (path, word, more) in enumerate(page):
            x[t, j, :PATH_WIDTH] = _path_sum(w["path"], path, sums) + w["path"][leaf_slot(path.tag)]
            x[t, j, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] = w["word"][word].mean(axis=0) * 3
            x[t, j, PATH_WIDTH + WORD_WIDTH :] = more
        real[: len(page), j] = 1
    return x, real


def _path_sum(w: np.ndarray, path: Path, sums: dict[int, np.ndarray]) -> np.ndarray:
    new = []
    for at in path.line():
        if id(at) in sums:
            total = sums[id(at)]
            break
        new.append(at)
    else:
        total = np.zeros(PATH_WIDTH, w.dtype)
    for at in reversed(new):
        total = sums[id(at)] = total + w[at.slots].sum(axis=0) if len(at.slots) else total
    return total


def _lstm(w: dict[str, np.ndarray], way: str, x: np.ndarray, real: np.ndarray, keep: list | None = None, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hidden states (block, page, hidden) of one direction, and the state after the last one read."""
    hidden = w["h" + way].shape[0]
    steps, batch, _ = x.shape
    given = x @ w["x" + way] + w["b" + way]
    h, c = state or (np.zeros((batch, hidden), np.float32),) * 2
    out = np.empty((steps, batch, hidden), np.float32)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        a = given[t] + h @ w["h" + way]
        g = _sigmoid(a[:, : 3 * hidden].copy())
        i, f, o, n = g[:, :hidden], g[:, hidden : 2 * hidden], g[:, 2 * hidden :], np.tanh(a[:, 3 * hidden :])
        before = h, c
        c = (f * c + i * n) * real[t]
        s = np.tanh(c)
        h = o * s
        if keep is not None:
            keep.append((t, *before, i, f, o, n, s))
        out[t] = h
    return out, (h, c)


def probabilities(w: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray) -> np.ndarray:
    """(block, page) chances of being the article.  Stretches of STEPS blocks are
    read one after the other with the state carried on, so only x grows with the page."""
    hidden = w["hf"].shape[0]
    out = np.zeros(x.shape[:2], np.float32) + w["bias"]
    starts = range(0, x.shape[0], STEPS)
    for way, weights in (("f", w["out"][:hidden]), ("b", w["out"][hidden:])):
        state = None
        for a in starts if way == "f" else reversed(starts):
            states, state = _lstm(w, way, x[a : a + STEPS], real[a : a + STEPS], state=state)
            out[a : a + STEPS] += states @ weights
    return _sigmoid(out)


def gradients(w: dict[str, np.ndarray], pages: list, labels: list[list[int]]) -> tuple[float, dict[str, np.ndarray]]:
    x, real = inputs(w, pages)
    y = np.zeros(x.shape[:2], np.float32)
    for j, own in enumerate(labels):
        y[: len(own), j] = own
    hidden = w["hf"].shape[0]
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_lstm(w, way, x, real, kept[way])[0] for way in "fb"], axis=2)
    p = _sigmoid(states @ w["out"] + w["bias"])
    share = real[:, :, 0] / real.sum()
    loss = float(-(share * np.log(np.where(y > 0, p, 1 - p) + 1e-7)).sum())
    d = (p - y) * share
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["out"], grads["bias"] = np.einsum("tbh,tb->h", states, d), d.sum(keepdims=True).reshape(1)
    into, dx = d[:, :, None] * w["out"], np.zeros_like(x)
    for way, at in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        dh = dc = np.zeros((x.shape[1], hidden), np.float32)
        for t, h, c, i, f, o, n, s in reversed(kept[way]):
            dh = dh + into[t][:, at]
            dc = (dc + dh * o * (1 - s * s)) * real[t]
            da = np.concatenate([dc * n * i * (1 - i), dc * c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - n * n)], axis=1)
            grads["x" + way] += x[t].T @ da
            grads["h" + way] += h.T @ da
            grads["b" + way] += da.sum(axis=0)
            dx[t] += da @ w["x" + way].T
            dh, dc = da @ w["h" + way].T, dc * f
    for j, page in enumerate(pages):
        for t, (path, word, _) in enumerate(page):
            np.add.at(grads["path"], path.all_slots(), dx[t, j, :PATH_WIDTH])
            np.add.at(grads["word"], word, dx[t, j, PATH_WIDTH : PATH_WIDTH + WORD_WIDTH] * (3 / len(word)))
    return loss, grads


def prepared(page: list[tuple[Path, str, float]], vectors: Vectors) -> list[tuple[Path, np.ndarray, list[float]]]:
    out = []
    for i, (path, text, links) in enumerate(page):
        words = text.split(" ")
        out.append((path, np.array(list(map(vectors.word, words))), numbers(i, len(page), text, len(words), links)))
    return out


#: Words of the parts that aren't the article, and names of elements; examples to learn from.
CHROME = {
    "nav": ("nav menu navbar navigation topnav breadcrumb links", "home about contact news products services blog menu login search archive"),
    "header": ("header masthead banner top branding logo", "welcome site name slogan skip to content language sign in"),
    "footer": ("footer bottom colophon copyright legal", "© 2024 all rights reserved imprint privacy terms contact sitemap ·"),
    "aside": ("sidebar aside widget related rail secondary recommended", "related most read popular tags categories archives see also trending"),
    "notice": ("cookie notice consent alert gdpr popup modal", "we use cookies accept decline settings privacy notice agree"),
    "ad": ("ad ads advert advertisement sponsor sponsored promo banner", "advertisement sponsored buy now offer sale discount click here"),
    "form": ("form search login subscribe newsletter signup contact", "name email password subscribe submit search send your address"),
    "comments": ("comments comment reply replies discussion respond thread", "reply posted by says report likes comments guest"),
    "share": ("share social follow tools buttons meta byline", "share tweet print follow us facebook email"),
}
BODIES = "content article post entry story main text body page"


def synthetic_page(rng: np.random.Generator) -> tuple[str, list[tuple[str, int]]]:
    """A made-up page and its blocks' texts with 1 for those of the article."""
    syllables = ["".join(rng.choice(list("bcdfghjklmnprstvwz"), 1)) + str(rng.choice(list("aeiouéäñü"))) for _ in range(40)]
    marks = str(rng.choice(["", "", "", "", "***", "!!", "%%%"]))
    seen: list[tuple[str, int]] = []

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 5)))

    def sentence(least: int, most: int) -> str:
        words = [word() + marks for _ in range(rng.integers(least, most + 1))]
        return " ".join(words).capitalize() + str(rng.choice([".", ".", ".", "", "!", "?"]))

    def text(label: int, own: str = "", least: int = 1, most: int = 60) -> str:
        words = own.split() if rng.random() < 0.5 else []
        s = " ".join([*([str(w) for w in rng.choice(words, min(len(words), 3), replace=False)] if words else []), *(sentence(1, 18) for _ in range(rng.integers(1, max(2, most // 9))))][: max(1, most // 4)])
        s = " ".join(s.split()[: rng.integers(max(least, 1), most + 1)])
        seen.append((s, label))
        return html.escape(s, quote=False)

    def names(own: str) -> str:
        if rng.random() < 0.25:
            return ""
        name = str(rng.choice(own.split())) + str(rng.choice(["", "", "-1", "-box", "_wrap", " item"]))
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def chrome(kind: str) -> str:
        own, words = CHROME[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div") if rng.random() < 0.7 else str(rng.choice(["div", "div", "section"]))
        given = names(own) if tag not in ("nav", "header", "footer", "aside", "form") else names(own) if rng.random() < 0.5 else ""
        if tag in ("div", "section") and not given:
            given = f' class="{rng.choice(own.split())}"'
        style = rng.random()
        if kind == "nav" or kind in ("aside", "footer", "share") and style < 0.4:
            inner = "<ul>" + "".join(f'<li><a href="/{word()}">{text(0, words, 1, 3)}</a></li>' for _ in range(rng.integers(2, 9))) + "</ul>"
        elif kind == "form":
            inner = "".join(f"<label>{text(0, words, 1, 3)}</label><input name=q><p>{text(0, words, 1, 14)}</p>" for _ in range(rng.integers(1, 3))) + f"<button>{text(0, words, 1, 2)}</button>"
            merged = seen[-3 * inner.count("<label>") - 1 :]
            del seen[-len(merged) :]
            for i in range(0, len(merged) - 1, 2):
                seen.extend([merged[i], merged[i + 1]])
            seen.append(merged[-1]) if len(merged) % 2 else None
        elif kind == "comments":
            inner = "".join(f"<div{names(own)}><p>{text(0, words, 1, 60)}</p></div>" for _ in range(rng.integers(1, 6)))
            if rng.random() < 0.5:
                inner = f"<h3>{text(0, words, 1, 3)}</h3>" + inner
                seen.insert(len(seen) - 1 - inner.count("<p>") + 1, seen.pop())
        elif style < 0.6:
            inner = text(0, words, 1, 25)
        else:
            inner = "".join(f"<p>{text(0, words, 1, 25)}</p>" for _ in range(rng.integers(1, 4)))
        return f"<{tag}{given}>{inner}</{tag}>"

    def article() -> str:
        tag = str(rng.choice(["article", "article", "article", "main", "div", "section"]))
        given = names(BODIES) if tag in ("article", "main") else f' class="{rng.choice(BODIES.split())}"'
        out = [f"<h1>{text(1, '', 1, 14)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.integers(1, 22)):
            kind = rng.random()
            if kind < 0.68:
                body = text(1, "", 1, 120 if rng.random() < 0.7 else 6)
                out.append(f"<p>{body}</p>" if rng.random() < 0.85 else f"<p><b>{body}<br>")
            elif kind < 0.76:
                out.append(f"<h2>{text(1, '', 1, 9)}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{text(1, '', 1, 15)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote>{text(1, '', 4, 40)}</blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{text(1, '', 1, 4)}</td><td>{text(1, '', 1, 4)}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif kind < 0.94:
                out.append(f"<pre>{text(1, '', 2, 30)}</pre>")
            elif kind < 0.97:
                out.append(chrome(str(rng.choice(["ad", "share", "form"]))))
            else:
                out.append(f'<p>{text(1, "", 5, 40)} <a href="/{word()}">x</a></p>')
                s, label = seen.pop()
                seen.append((s + " x", label))
        return f"<{tag}{given}>{''.join(out)}</{tag}>"

    kinds = [k for k in ("notice", "header", "nav", "ad") if rng.random() < 0.6]
    parts = [chrome(k) for k in kinds]
    if rng.random() < 0.25:
        parts.append(chrome("aside"))
    if rng.random() < 0.97:
        parts.append(article())
    parts += [chrome(k) for k in ("share", "comments", "aside", "form", "ad", "footer") if rng.random() < 0.4]
    page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"
    return page, seen


def training_set(n: int, seed: int) -> tuple[list, list[list[int]]]:
    """Pages as `prepared` gives them, and labels.  A block is labelled by its
    text; a page in which one text has both labels is left out, as is one whose
    blocks aren't those that were made up."""
    rng, vectors, pages, labels = np.random.default_rng(seed), Vectors(), [], []
    for _ in range(n):
        page, seen = synthetic_page(rng)
        known = {" ".join(s.split()): label for s, label in seen}
        if len(set(known.items())) != len({(" ".join(s.split()), label) for s, label in seen}):
            continue
        cut = blocks(page)
        own = [0 if p.tag == "title" else known.get(t, 0 if {"form", "button"} & {x.tag for x in p.line()} else None) for p, t, _ in cut]
        if cut and None not in own:
            pages.append(prepared(cut, vectors))
            labels.append(own)
    return pages, labels


@cache
def trained(pages: int = 500, hidden: int = 12, epochs: int = 5, batch: int = 8, seed: int = 3) -> dict[str, np.ndarray]:
    """Weights; the same for the same parameters, so a process makes them once."""
    rows, labels = training_set(pages, seed)
    rng = np.random.default_rng(seed)

    def steps(w):
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                yield gradients(w, [rows[k] for k in at], [labels[k] for k in at])[1]

    return adam(init(hidden, seed), steps, rate=0.01)


def main_texts(w: dict[str, np.ndarray], pages: list[str], vectors: Vectors, width: int = 64) -> list[str]:
    """The article of each page, its blocks joined by line feeds.  Pages of like
    length share a batch of at most `width` pages and CELLS cells, or are alone."""
    out = [""] * len(pages)
    cut = [(i, b) for i, b in ((i, blocks(p)) for i, p in enumerate(pages)) if b]
    cut.sort(key=lambda x: len(x[1]))
    while cut:
        n = 1
        while n < min(width, len(cut)) and len(cut[n][1]) * (n + 1) <= CELLS:
            n += 1
        own, cut = cut[:n], cut[n:]
        p = probabilities(w, *inputs(w, [prepared(b, vectors) for _, b in own]))
        for j, (i, b) in enumerate(own):
            out[i] = "\n".join(text for t, (_, text, _) in enumerate(b) if p[t, j] > 0.5)
    return out


def extract(df: DataFrame, page: str = "html", rows: int = 256, **options) -> DataFrame:
    """Adds text, the page's article, and n_chars, its code points, to df.

    Null, empty and article-less pages get an empty text.  A page is read in time
    linear in its length, whatever it holds; a `<` that begins no tag is text.
    Columns of df with
    these names are replaced; options are those of `trained`.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained(**options))

    @F.arrow_udf(T.StringType())
    def article(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors()
        for batch in batches:
            texts: list[str] = []
            for i in range(0, len(batch), rows):
                texts += main_texts(shared.value, [x.as_py() or "" for x in batch[i : i + rows]], vectors)
            yield pa.array(texts, pa.string())

    return df.withColumn("text", article(F.col(page))).withColumn("n_chars", F.length("text").cast("long"))
