"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is described by its tag path (tags, classes,
ids, hashed) and by its words (hashed), and a bidirectional LSTM, in numpy, labels every block with the
whole page as context. The labeller is trained on the driver, on a bounded sample of the pages
themselves: containers and boilerplate that pages name in their markup teach it (teach()), on the pages as they are and
on variants with other containers and further boilerplate put in (variant()).

A page is read in one pass, whose time and memory are in proportion to its length, however deep its elements
are nested and whatever is left unclosed.

Defined results: null and empty html gives an empty text; markup that isn't closed is closed where HTML closes it; a tag
that never ends is text; a quote that is never closed ends nowhere, so its tag ends at the next >; all elements around
a block count, however many; a head ends at what may not be in it; an svg or math element that is left open ends at the next
paragraph or heading; scripts, pictures and players inside a sentence do not break it, and what stands in them is no text, but
for formulas; blocks without text are none; repeated rows are extracted each; if no page
of the sample has a block, there is no labeller and every block stays; extra columns are left out.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidline.llm.common import hash_sample

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp textarea title".split())
#: Elements whose content is not shown; but for RAW they have children like others and end with what they stand in.
UNSEEN = frozenset("annotation annotation-xml audio canvas datalist object select svg template video".split())
#: Elements that may stand in a sentence without ending it.
EMBEDDED = frozenset("audio canvas datalist embed iframe link math meta noembed noscript object optgroup option param script select source style svg template textarea title track video".split())
#: What may be in a head, and where foreign elements hold HTML again.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
WITHIN_FOREIGN = frozenset("annotation-xml desc foreignobject mi mn mo ms mtext".split())
#: Tags that end svg and math elements left open.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag ends if it is open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th")}

#: Markup that names the article, and markup that names what is not part of it (classes and ids, split at hyphens and underscores).
CONTAINER_TAGS = frozenset(("article", "main"))
CONTAINER_NAMES = frozenset("article articlebody content main maincontent post postbody entry story".split())
BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button"))
BOILER_NAMES = frozenset("ad ads advert advertisement adverts sponsor sponsored banner promo cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments reply replies discussion disqus respond share sharing social related recommended newsletter subscribe signup login search widget pagination pager tags".split())

SAMPLE, VARIANTS, EPOCHS = 240, 4, 8
PATHS, WORDS = 1 << 11, 1 << 11
PATH_DIM, WORD_DIM, HIDDEN = 20, 6, 16
BATCH = 64
#: Elements of a block's path that Block.path names, from the inside; marks and slots follow all of them.
DEPTH = 48
#: Characters of a page that the labeller learns from, at most; pages are labelled whole.
LONGEST = 200_000
#: Elements at which an opening tag's search for what it ends stops.
BARRIERS = frozenset(("ul", "ol", "table", "dl", "div", "article", "section", "object", "template", "foreignobject"))

# A tag whose quoted values hold no angle bracket; whatever fails has been read up to the next bracket only.
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_name = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_stop = re.compile(r"[>\"']")
_zeros = re.compile(r"&#(?:([xX])0++(?=[0-9a-fA-F])|0++(?=[0-9]))")
_numbers = re.compile(r"&#(?:[xX][0-9a-fA-F]{9,}|[0-9]{9,});?")
_named = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_split = re.compile(r"[\s_-]+")


class Block:
    """text; path: the innermost elements (tag, names); linked: words inside links; slots: bits of what all open elements are
    called; inside, boiler: whether any of them is named as a container, or as what is not part of the article."""

    __slots__ = ("boiler", "inside", "linked", "path", "slots", "text")

    def __init__(self, text: str, path: tuple, linked: int, place: _Place) -> None:
        self.text, self.path, self.linked = text, path, linked
        self.slots, self.inside, self.boiler = place.slots, place.inside, place.boiler


class _Place:
    """What an element and all those around it say together, so that nothing depends on how deep it is.

    slots takes PATHS bits at most; shown: not inside of what is hidden; foreign: the content is svg or math.
    """

    __slots__ = ("boiler", "foreign", "inside", "shown", "slots")

    def __init__(self, slots: int = 0, inside: bool = False, boiler: bool = False, shown: bool = True, foreign: bool = False) -> None:
        self.slots, self.inside, self.boiler, self.shown, self.foreign = slots, inside, boiler, shown, foreign

    def enter(self, tag: str, names: tuple[str, ...], known: dict) -> _Place:
        if (tag, names) not in known:
            parts = {p for n in names for p in _split.split(n)}
            bits = 0
            for token in (tag, *names, *(f"~{p}" for p in parts if p)):
                bits |= 1 << _slot(token, PATHS)
            known[tag, names] = (bits, tag in BOILER_TAGS or bool(parts & BOILER_NAMES), tag in CONTAINER_TAGS or bool(parts & CONTAINER_NAMES))
        bits, boiler, inside = known[tag, names]
        boiler = boiler or tag == "header" and not self.inside
        return _Place(
            self.slots | bits,
            self.inside or inside and not boiler,
            self.boiler or boiler,
            tag == "foreignobject" or self.shown and tag not in UNSEEN,
            tag in FOREIGN or self.foreign and tag not in WITHIN_FOREIGN,
        )


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(x for m in _named.finditer(attributes) for x in [" ".join(g for g in m.groups()[1:] if g).lower()] if x)


class _Open:
    """The open elements, with the places of each tag, so that nothing is searched for."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.said: list[_Place] = [_Place()]
        self.known: dict = {}
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        if tag in BARRIERS:
            self.barriers.append(at)
        self.stack.append((tag, names))
        self.said.append(self.said[-1].enter(tag, names, self.known))

    @property
    def here(self) -> _Place:
        return self.said[-1]

    def cut(self, at: int) -> None:
        """Close everything from place at on."""
        while len(self.stack) > at:
            self.places[self.stack.pop()[0]].pop()
            self.said.pop()
        while self.barriers and self.barriers[-1] >= at:
            self.barriers.pop()

    def close(self, tag: str) -> None:
        if self.has(tag):
            self.cut(self.places[tag][-1])

    def leave_foreign(self) -> None:
        """Close svg and math elements, up to what holds HTML in them or around them."""
        while self.here.foreign:
            self.cut(len(self.stack) - 1)

    def end(self, tags: tuple[str, ...]) -> None:
        """Close from the outermost element of these tags on that lies inside the innermost barrier."""
        low = self.barriers[-1] if self.barriers else -1
        for tag in tags:
            while self.has(tag) and self.places[tag][-1] > low:
                self.cut(self.places[tag][-1])

    def path(self) -> tuple:
        return tuple(self.stack[-DEPTH:])


class _Tags:
    """Reads the markup of one page; what has been found not to close is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def read(self, at: int) -> tuple[str, str, str, int] | None:
        """(slash, name, attributes, place behind) of the tag at a place, or None if there is none."""
        m = _tag.match(self.page, at)
        if m:
            return m.group(1), m.group(2), m.group(3), m.end()
        m = _name.match(self.page, at)
        if not m or at > self.last:
            return None
        i = m.end()
        while self.quoted:
            stop = _stop.search(self.page, i)
            if stop is None:
                self.quoted = False  # quotes run to the end of the page: from here on they are mere characters
            elif stop.group() == ">":
                return m.group(1), m.group(2), self.page[m.end() : stop.start()], stop.end()
            else:
                close = self.page.find(stop.group(), stop.end())
                if close < 0:
                    self.quoted = False
                i = close + 1
        end = self.page.find(">", m.end())
        return m.group(1), m.group(2), self.page[m.end() : end], end + 1

    def skip(self, at: int) -> int:
        """The place behind a comment, a declaration or an instruction at a place, or that place."""
        page = self.page
        for start, close in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(start, at):
                end = page.find(close, at + len(start))
                return len(page) if end < 0 else end + len(close)
        if page.startswith(("<!", "<?"), at) and at < self.last:
            return page.find(">", at) + 1
        return at


def _unescaped(text: str) -> str:
    if "&" not in text:
        return text
    text = _zeros.sub(lambda m: f"&#{m.group(1) or ''}", text)
    return entities.unescape(_numbers.sub("\ufffd", text))  # beyond any code point, and digits without end


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    page = page or ""
    tags, open_ = _Tags(page), _Open()
    text: list[str] = []
    path: tuple = ()
    place = open_.here
    linked, seen, at = 0, False, 0

    def flush() -> None:
        nonlocal linked, seen
        if seen:
            out.append(Block(" ".join("".join(text).split()), path, linked, place))
        text.clear()
        linked, seen = 0, False

    while at < len(page):
        behind = page.find("<", at)
        if behind != at:
            behind = len(page) if behind < 0 else behind
            piece, at = page[at:behind], behind
            tag = None
        elif (behind := tags.skip(at)) != at:
            at = behind
            continue
        elif (tag := tags.read(at)) is None:
            piece, at = "<", at + 1
        if tag is None:
            if not open_.here.shown:
                continue
            piece = _unescaped(piece)
            if piece.strip():
                if open_.has("head"):
                    open_.cut(open_.places["head"][0])
                if not seen:
                    path, place, seen = open_.path(), open_.here, True
                if open_.has("a"):
                    linked += len(piece.split())
            text.append(piece)
            continue
        slash, name, attributes, at = tag
        name = name.lower()
        mere = name in INLINE or name in EMBEDDED
        if slash:
            if name == "br":
                text.append(" ")
                continue
            foreign = open_.here.foreign and not open_.has(name)
            open_.close(name)
            if not mere and not foreign and open_.here.shown and not (open_.here.foreign or name in WITHIN_FOREIGN):
                flush()
            continue
        if name in BREAKOUT:
            open_.leave_foreign()
        foreign = open_.here.foreign
        if name == "br":
            if open_.here.shown:
                text.append(" ")
            continue
        if foreign or name in FOREIGN:
            if not attributes.endswith("/"):
                open_.push(name, _names(attributes))
            continue
        if open_.here.shown:
            if open_.has("head") and name not in IN_HEAD:
                open_.cut(open_.places["head"][0])
            if not mere:
                flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end and end.end() <= tags.last else len(page)
            continue
        if name in VOID or attributes.endswith("/") and name not in ("p", "div", "li", "a"):
            continue
        closes = ENDS.get(name, ())
        if not mere and open_.has("p"):
            hidden = not open_.here.shown
            closes = (*closes, "p")
            open_.end(closes)
            if hidden and open_.here.shown:
                flush()  # the paragraph that held what was hidden has ended
        else:
            open_.end(closes)
        open_.push(name, _names(attributes))
    flush()
    return out


def teach(page: list[Block]) -> list[int]:
    """Labels by what the markup names: inside a container and not inside boilerplate; without a container, not inside boilerplate."""
    any_in = any(b.inside and not b.boiler for b in page)
    return [int(not b.boiler and (b.inside or not any_in)) for b in page]


def variant(page: str, texts: list[str], rng: random.Random) -> str:
    """The page with another container and further boilerplate before, in and after it."""

    def some() -> str:
        t = rng.choice(texts)
        words = t.split()
        a = rng.randrange(max(1, len(words)))
        return entities.escape(" ".join(words[a : a + rng.randrange(1, 40)])) or "x"

    def boiler() -> str:
        name = rng.choice(sorted(BOILER_NAMES))
        if rng.random() < 0.4:
            name = f"{rng.choice(['site', 'page', 'main', 'top', 'user', 'post', 'box', name])}{rng.choice('-_')}{name}"
        tag = rng.choice(["div", "div", "section", "aside", "nav", "footer", "header", "form", "ul"])
        inner = rng.choice(["p", "p", "div", "span", "li", "a"])
        body = "".join(f"<{inner}>{some()}</{inner}>" for _ in range(rng.randrange(1, 5)))
        plain = tag in ("aside", "nav", "footer", "form") and rng.random() < 0.5
        return f"<{tag}>{body}</{tag}>" if plain else f'<{tag} {rng.choice(["class", "id"])}="{name}">{body}</{tag}>'

    start, end = page.find("<article"), page.rfind("</article>")
    if start < 0 or end < 0:
        return page
    first = page.find(">", start) + 1
    body = page[first:end]
    cuts = [m.start() for m in re.finditer(r"<(?:p|h[1-6]|ul|div|blockquote|table)\b", body)]
    for at in sorted(rng.sample(cuts, min(len(cuts), rng.randrange(0, 3))), reverse=True):
        body = body[:at] + (boiler() if rng.random() < 0.6 else rng.choice([f"<h2>{some()}</h2>", f"<ul><li>{some()}</li><li>{some()}</li></ul>", f"<blockquote>{some()}</blockquote>", f"<blockquote><p>{some()}</p></blockquote>", f"<pre>{some()}</pre>", f"<table><tr><td>{some()}</td><td>{some()}</td></tr></table>", f"<section><h3>{some()}</h3><p>{some()}</p></section>", f"<figure><figcaption>{some()}</figcaption></figure>", f"<div><p>{some()} <a href='#'>{some()}</a></p></div>"])) + body[at:]
    tag, attribute = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", ' class="article"'), ("div", ' id="content"'), ("div", ' class="post-content"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ' class="main-content"'), ("div", ' role="main"'), ("article", ' class="post"')])
    before = "".join(boiler() for _ in range(rng.randrange(0, 3)))
    after = "".join(boiler() for _ in range(rng.randrange(0, 3)))
    return f"{page[:start]}{before}<{tag}{attribute}>{body}</{tag}>{after}{page[end + len('</article>'):]}"


def _slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % size


def features(page: list[Block], memory: dict) -> list[tuple[list[int], list[int], tuple[float, float, float]]]:
    """(path slots, word slots, numbers) of every block."""
    out = []
    for b in page:
        key = b.slots | 1 << _slot("/".join(t for t, _ in b.path[-3:]), PATHS)
        if key not in memory:
            if len(memory) > 50_000:
                memory.clear()
            bits = np.frombuffer(key.to_bytes(PATHS // 8, "little"), np.uint8)
            memory[key] = np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()
        words = b.text.lower().split()
        out.append((memory[key], [_slot(w, WORDS) for w in words], (min(1.0, len(words) / 50), b.linked / len(words), sum(b.text.count(c) for c in ".,;:!?") / len(words))))
    return out


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + 3
        self.p = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIM))}
        for side in "fb":
            self.p[f"w{side}"] = rng.normal(0, 0.2, (d + HIDDEN, 4 * HIDDEN))
            self.p[f"c{side}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gates begin open
        self.p["out"] = rng.normal(0, 0.2, (2 * HIDDEN + d,))
        self.p["bias"] = np.zeros(1)

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(time, page, d) block vectors, their mask, and what the gradients of the tables need."""
        steps, n = max(len(x) for x in pages), len(pages)
        x = np.zeros((steps, n, PATH_DIM + WORD_DIM + 3))
        mask = np.zeros((steps, n))
        ps, pc, ws, wc = [], [], [], []
        for j, page in enumerate(pages):
            for t, (path, words, numbers) in enumerate(page):
                mask[t, j] = 1
                cell = t * n + j
                ps += path
                pc += [cell] * len(path)
                ws += words
                wc += [cell] * len(words)
                x[t, j, -3:] = numbers
        flat = x.reshape(steps * n, -1)
        ps, pc, ws, wc = (np.array(a, np.int64) for a in (ps, pc, ws, wc))
        weight = 1 / np.bincount(wc, minlength=steps * n).clip(1)[wc]
        for k in range(PATH_DIM):
            flat[:, k] = np.bincount(pc, self.p["path"][ps, k], steps * n)
        for k in range(WORD_DIM):
            flat[:, PATH_DIM + k] = np.bincount(wc, self.p["word"][ws, k] * weight, steps * n)
        return x, mask, (ps, pc, ws, wc, weight)

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden values (time, page, HIDDEN), and what back() needs of every step if that is to be kept."""
        w, c = self.p[f"w{side}"], self.p[f"c{side}"]
        steps, n, _ = x.shape
        h, s = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, kept = np.zeros((steps, n, HIDDEN)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[t], h], 1)
            a = z @ w + c
            g = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            f, i, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            s_new = np.where(m, f * s + i * u, s)
            th = np.tanh(s_new)
            h_new = np.where(m, o * th, h)
            if keep:
                kept.append((t, z, f, i, o, u, s, th, m))
            h, s = h_new, s_new
            out[t] = h
        return out, kept

    def forward(self, pages: list) -> tuple:
        x, mask, tables = self.inputs(pages)
        f, kept_f = self.run(x, mask, "f")
        b, kept_b = self.run(x, mask, "b")
        z = np.concatenate([f, b, x], 2)
        return 1 / (1 + np.exp(-(z @ self.p["out"] + self.p["bias"][0]))), z, x, mask, tables, kept_f, kept_b

    def scores(self, pages: list) -> np.ndarray:
        """The probability (time, page) of every block, without what only training needs."""
        x, mask, _ = self.inputs(pages)
        w = self.p["out"]
        sums = x @ w[2 * HIDDEN :] + self.p["bias"][0]
        sums += self.run(x, mask, "f", False)[0] @ w[:HIDDEN]
        sums += self.run(x, mask, "b", False)[0] @ w[HIDDEN : 2 * HIDDEN]
        return 1 / (1 + np.exp(-sums))

    def back(self, kept: list, grad: np.ndarray, side: str, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.p[f"w{side}"]
        dw, dc = np.zeros_like(w), np.zeros(4 * HIDDEN)
        dh, ds = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
        for t, z, f, i, o, u, s, th, m in reversed(kept):
            dh = dh + grad[t]
            live = dh * m
            d = ds * m + live * o * (1 - th**2)
            da = np.concatenate([d * s * f * (1 - f), d * u * i * (1 - i), live * th * o * (1 - o), d * i * (1 - u**2)], 1)
            dw += z.T @ da
            dc += da.sum(0)
            dz = da @ w.T
            dx[t] += dz[:, : dx.shape[2]]
            dh = np.where(m, dz[:, dx.shape[2] :], dh)
            ds = np.where(m, d * f, ds)
        return dw, dc

    def gradients(self, pages: list, labels: list[list[int]]) -> dict[str, np.ndarray]:
        y, z, x, mask, (ps, pc, ws, wc, weight), kept_f, kept_b = self.forward(pages)
        want = np.zeros_like(y)
        for j, row in enumerate(labels):
            want[: len(row), j] = row
        dy = (y - want) * mask / mask.sum()
        dz = dy[..., None] * self.p["out"]
        dx = dz[..., 2 * HIDDEN :].copy()
        g = {"out": np.einsum("tn,tnk->k", dy, z), "bias": np.array([dy.sum()])}
        g["wf"], g["cf"] = self.back(kept_f, dz[..., :HIDDEN], "f", dx)
        g["wb"], g["cb"] = self.back(kept_b, dz[..., HIDDEN : 2 * HIDDEN], "b", dx)
        flat = dx.reshape(-1, dx.shape[2])
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        np.add.at(g["path"], ps, flat[pc, :PATH_DIM])
        np.add.at(g["word"], ws, flat[wc, PATH_DIM : PATH_DIM + WORD_DIM] * weight[:, None])
        return g

    def fit(self, pages: list, labels: list[list[int]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 5) -> Labeller:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 32):
                some = order[at : at + 32]
                step += 1
                for k, g in self.gradients([pages[i] for i in some], [labels[i] for i in some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, pages: list) -> list[np.ndarray]:
        """A boolean for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            n = max(1, min(BATCH, len(order), 20_000 // len(pages[order[-1]])))
            some, order = order[-n:], order[:-n]
            y = self.scores([pages[i] for i in some])
            for j, i in enumerate(some):
                out[i] = y[: len(pages[i]), j] > 0.5
        return out


def train(sample: list[str], seed: int = 11) -> Labeller | None:
    """A labeller of the pages and their variants; none if they have no block."""
    rng = random.Random(seed)
    texts = [b.text for p in sample[:50] for b in blocks(p)] or ["x"]
    pages = [blocks(p) for p in [*sample, *(variant(p, texts, rng) for p in sample for _ in range(VARIANTS))]]
    pages = [p for p in pages if p]
    memory: dict = {}
    return Labeller().fit([features(p, memory) for p in pages], [teach(p) for p in pages]) if pages else None


def sample_of(pages: DataFrame, id_col: str, html_col: str, rows: int = SAMPLE, longest: int = LONGEST) -> list[str]:
    """At most `rows` pages, by the smallest hash of id and html, and of each at most the first `longest` characters."""
    some = pages.select(F.col(id_col).alias("id"), F.substring(F.col(html_col), 1, longest).alias("html")).where(F.length("html") > 0)
    return [r.html for r in hash_sample(some, rows, "id", "html").select("html").collect()]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every row."""
    sent = pages.sparkSession.sparkContext.broadcast(train(sample_of(pages, id_col, html_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = sent.value, {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                parsed = [blocks(x.as_py()) for x in b.column(2)]
                marks = model.label([features(p, memory) for p in parsed]) if model else [np.ones(len(p), bool) for p in parsed]
                texts = ["\n\n".join(x.text for x, m in zip(p, mark, strict=True) if m) for p, mark in zip(parsed, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in parsed], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_blocks bigint, n_main bigint")
