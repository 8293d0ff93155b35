"""Main text of web pages by a recurrent block labeller.

A page is parsed into blocks: stretches of text between block-level tags. Each has
a vector of its tag path (tags, classes and ids of its ancestors, hashed), the mean of
learnt vectors of all its words (hashed) and its shape (size, links, place). A
bidirectional LSTM in numpy reads the page's blocks in both directions, so that each
block is labelled in the light of the whole page, and the blocks labelled as content
are joined.

The labeller is trained here on invented pages, whose make-up (nested boxes with
usual and unusual names, menus, notices, adverts, comments, forms) is drawn anew for
each; no page of the input is used for training.

Time and memory grow with a page, not with its square: a block shares its ancestors'
bits, and a page of many blocks is labelled in stretches that hand their state on.
"""

from __future__ import annotations

import functools
import hashlib
import io
import re
import zlib
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import one_thread, own_name, shared_dir, table, tidied
from .tokens import BASE, powers, put_in_place, store_of

#: Tags that end the block before them and begin another.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option optgroup p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose text no reader of the page sees, or that hold what a form is filled with.
SILENT_TAGS = frozenset("script style template iframe head select textarea".split())
#: Tags that leave an open head open; any other one begins the body.
HEAD_TAGS = frozenset("html head title base link meta script style noscript template".split())
#: Tags that an opening tag of the key closes, if one is open inside the nearest box.
CLOSES = {**dict.fromkeys("p h1 h2 h3 h4 h5 h6 div ul ol dl table article section aside nav header footer main form blockquote pre figure hr".split(), {"p"}), "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BOXES = frozenset("body html div article section aside nav header footer main form table ul ol dl blockquote figure details".split())
SPACE = re.compile(r"\s+")
NOT_NAME = re.compile(r"[^a-z]+")
#: Bytes between words: white space and the signs of sentences.
BETWEEN = np.isin(np.arange(256), [*b" .,;:!?()\"'"])
PATH_BINS, WORD_BINS, WORD_SIZE, SHAPE = 192, 4096, 32, 9
FEATURES = PATH_BINS + WORD_SIZE + SHAPE
#: Pages of more blocks are labelled a stretch of so many at a time.
STRETCH = 8192


@functools.lru_cache(1 << 16)
def path_bit(name: str) -> int:
    return 1 << zlib.crc32(name.encode()) % PATH_BINS


class Block:
    """path: the bits of its ancestors' names; depth: how many names; linked: characters in links."""

    __slots__ = ("path", "depth", "parts", "linked", "text")

    def __init__(self, path: int, depth: int):
        self.path, self.depth, self.parts, self.linked, self.text = path, depth, [], 0, ""


class Blocks(HTMLParser):
    """Collects a page's blocks in order; text of scripts, styles and the head is left out.

    ``at`` has the places of each tag in the stack of open ones, so no tag is looked for there.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.at, self.boxes, self.silent = [], defaultdict(list), [], 0
        self.found, self.open = [], None

    def push(self, tag: str, names: list[str]) -> None:
        path, depth = self.stack[-1][1:] if self.stack else (0, 0)
        for name in names:
            path |= path_bit(name)
        self.at[tag].append(len(self.stack))
        if tag in BOXES:
            self.boxes.append(len(self.stack))
        self.silent += tag in SILENT_TAGS
        self.stack.append((tag, path, depth + len(names)))

    def cut(self, k: int) -> None:
        """Close all from place k on."""
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in BOXES:
                self.boxes.pop()
            self.silent -= tag in SILENT_TAGS

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def end_block(self) -> None:
        if self.open is not None:
            self.open.text = SPACE.sub(" ", "".join(self.open.parts)).strip()
            self.open.parts = None
            if self.open.text:
                self.found.append(self.open)
        self.open = None

    def end_head(self) -> None:
        k = self.last("head")
        if k >= 0 and max(self.last("noscript"), self.last("template")) < k:
            self.end_block()
            self.cut(k)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_TAGS:
            self.end_head()
        while tag in CLOSES:
            k = max(self.last(x) for x in CLOSES[tag])
            if k < 0 or (self.boxes and self.boxes[-1] > k):
                break
            self.cut(k)
        if tag in BLOCK_TAGS:
            self.end_block()
        elif tag == "br" and self.open is not None:
            self.open.parts.append(" ")
        if tag in VOID_TAGS:
            return
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [x for x in NOT_NAME.split(value.lower()) if x]
        self.push(tag, names)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.end_block()
        k = self.last(tag)
        if k >= 0 and (tag in BOXES or not self.boxes or self.boxes[-1] <= k):
            self.cut(k)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and not data.isspace():
            self.end_head()
        if self.silent:
            return
        if self.open is None:
            if data.isspace():
                return
            self.open = Block(*(self.stack[-1][1:] if self.stack else (0, 0)))
        self.open.parts.append(data)
        if self.at.get("a"):
            self.open.linked += len(data.strip())

    def unknown_decl(self, data):
        pass


def blocks(html: str | None) -> list[Block]:
    """The blocks of a whole page; any text can be given."""
    parser = Blocks()
    if html:
        parser.feed(html)
        parser.close()
        parser.end_block()
    return parser.found


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each word of all texts in turn, and how many words each text has."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    if len(_POWERS[0]) <= len(data):
        _POWERS[:] = powers(2 * len(data) + 1, BASE), powers(2 * len(data) + 1, pow(BASE, -1, 1 << 64))
    edge = np.flatnonzero(np.diff(BETWEEN[data].astype(np.int8), prepend=1, append=1))
    starts, stops = edge[0::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _POWERS[0][: len(data)], dtype=np.uint64)])
    h = (sums[stops] - sums[starts]) * _POWERS[1][starts]
    h = (h ^ h >> np.uint64(32)) * np.uint64(BASE)
    ends = np.cumsum([len(x) + 1 for x in raw])
    return (h >> np.uint64(64 - 12)).astype(np.int32), np.diff(np.searchsorted(starts, ends), prepend=0)


class Rows:
    """Features of consecutive blocks: dense ones of path and shape, and the words' bins with their number in each block."""

    def __init__(self, page: list[Block], low: int = 0, high: int | None = None):
        high = len(page) if high is None else high
        some, n = page[low:high], len(page)
        bits = np.frombuffer(b"".join(b.path.to_bytes(PATH_BINS // 8, "little") for b in some), np.uint8).reshape(-1, PATH_BINS // 8)
        self.path = np.unpackbits(bits, axis=1, bitorder="little").astype(np.float32)
        self.shape = np.zeros((len(some), SHAPE), np.float32)
        for row, block, i in zip(self.shape, some, range(low, high), strict=True):
            text = block.text
            size = len(text)
            marks = sum(text.count(c) for c in ".,;:!?")
            row[:] = [np.log1p(size) / 8, min(1, block.linked / size), min(1, 20 * marks / size), text[-1] in ".!?", i / n, np.log1p(i) / 5, np.log1p(n - i) / 5, min(block.depth, 200) / 20, "©" in text]
        self.bins, self.words = word_bins([b.text for b in some])

    def __len__(self):
        return len(self.path)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        said = np.zeros((len(self), WORD_SIZE), np.float32)
        full = np.flatnonzero(self.words)
        begins = (np.cumsum(self.words) - self.words)[full]
        for at in range(0, len(full), 512):  # a bounded number of blocks' words at once
            some = begins[at : at + 512]
            end = begins[at + 512] if at + 512 < len(full) else len(self.bins)
            said[full[at : at + 512]] = np.add.reduceat(vectors[self.bins[some[0] : end]], some - some[0], axis=0)
        said /= np.maximum(1, self.words)[:, None]
        return np.concatenate([self.path, said, self.shape], 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction over a padded batch: (batch, time, features) to (batch, time, units), from a state to the state at the end."""

    def __init__(self, inputs: int, units: int, rng):
        self.units = units
        self.p = [rng.normal(0, inputs**-0.5, (inputs, 4 * units)).astype(np.float32), rng.normal(0, units**-0.5, (units, 4 * units)).astype(np.float32), np.concatenate([np.zeros(units), np.ones(units), np.zeros(2 * units)]).astype(np.float32)]

    def forward(self, x, mask, keep: bool = False, state=None):
        n, steps, _ = x.shape
        u, ahead = self.units, x @ self.p[0] + self.p[2]
        h, c = state if state is not None else (np.zeros((n, u), np.float32),) * 2
        out, trace = np.zeros((n, steps, u), np.float32), []
        for t in range(steps):
            z = ahead[:, t] + h @ self.p[1]
            gates = sigmoid(z[:, : 3 * u])
            i, f, o, g = gates[:, :u], gates[:, u : 2 * u], gates[:, 2 * u :], np.tanh(z[:, 3 * u :])
            m = mask[:, t : t + 1]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                trace.append((h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return (out, trace) if keep else (out, (h, c))

    def backward(self, x, trace, d_out):
        """Gradients of the parameters and of x."""
        grads = [np.zeros_like(p) for p in self.p]
        d_ahead = np.zeros((*x.shape[:2], 4 * self.units), np.float32)
        dh = dc = np.zeros((x.shape[0], self.units), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, c, i, f, o, g, tc, m = trace[t]
            dh = dh + d_out[:, t]
            own, dc2 = m * dh, m * dc
            dc2 = dc2 + own * o * (1 - tc * tc)
            dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), own * tc * o * (1 - o), dc2 * i * (1 - g * g)], 1)
            d_ahead[:, t] = dz
            grads[1] += h.T @ dz
            dh, dc = (1 - m) * dh + dz @ self.p[1].T, (1 - m) * dc + dc2 * f
        flat = d_ahead.reshape(-1, d_ahead.shape[2])
        grads[0], grads[2] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
        return grads, d_ahead @ self.p[0].T


def turned(x, sizes):
    """Each row of a padded batch backwards, its padding still behind."""
    at = np.arange(x.shape[1])[None, :]
    back = np.where(at < sizes[:, None], sizes[:, None] - 1 - at, at)
    return np.take_along_axis(x, back[:, :, None], 1)


class Labeller:
    """Word vectors, two LSTMs, one in each direction, and a logistic output per block."""

    def __init__(self, units: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.ways = [Lstm(FEATURES, units, rng), Lstm(FEATURES, units, rng)]
        self.w, self.b = rng.normal(0, 0.1, 2 * units + FEATURES).astype(np.float32), np.zeros(1, np.float32)
        self.vectors = np.zeros((WORD_BINS, WORD_SIZE), np.float32)  # a word that training does not show says nothing

    def params(self) -> list[np.ndarray]:
        return [*self.ways[0].p, *self.ways[1].p, self.w, self.b, self.vectors]

    def padded(self, pages: list[Rows]):
        sizes = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), max(sizes), FEATURES), np.float32)
        for row, p in zip(x, pages, strict=True):
            row[: len(p)] = p.inputs(self.vectors)
        return x, sizes, (np.arange(x.shape[1])[None] < sizes[:, None]).astype(np.float32)

    def probabilities(self, pages: list[Rows]) -> list[np.ndarray]:
        x, sizes, mask = self.padded(pages)
        (one, _), (two, _) = self.ways[0].forward(x, mask), self.ways[1].forward(turned(x, sizes), mask)
        p = sigmoid(np.concatenate([one, turned(two, sizes), x], 2) @ self.w + self.b)
        return [row[:n] for row, n in zip(p, sizes, strict=True)]

    def probabilities_of_long(self, page: list[Block], stretch: int) -> np.ndarray:
        """The same for one page, whose features exist for a stretch at a time: first all the way back, then forth."""
        cuts, state, behind = list(range(0, len(page), stretch)), None, {}
        ones = np.ones((1, stretch), np.float32)
        for at in reversed(cuts):
            x = Rows(page, at, min(at + stretch, len(page))).inputs(self.vectors)[None]
            out, state = self.ways[1].forward(x[:, ::-1], ones[:, : x.shape[1]], state=state)
            behind[at] = out[:, ::-1]
        state, found = None, []
        for at in cuts:
            x = Rows(page, at, min(at + stretch, len(page))).inputs(self.vectors)[None]
            out, state = self.ways[0].forward(x, ones[:, : x.shape[1]], state=state)
            found.append(sigmoid(np.concatenate([out, behind.pop(at), x], 2) @ self.w + self.b)[0])
        return np.concatenate(found)

    def train(self, pages: list[Rows], labels: list[np.ndarray], rounds: int = 10, batch: int = 16, rate: float = 0.01, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        m, v, step = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()], 0
        lengths = np.array([len(p) for p in pages])
        for turn in range(rounds):
            # Pages of like length go together, in another order each round.
            alike = np.argsort(lengths + rng.random(len(pages)) * (1 + lengths / 4), kind="stable")
            batches = np.array_split(alike, -(-len(pages) // batch))
            for k in rng.permutation(len(batches)):
                some = batches[k]
                x, sizes, mask = self.padded([pages[i] for i in some])
                y = np.zeros(mask.shape, np.float32)
                for row, i in zip(y, some, strict=True):
                    row[: len(labels[i])] = labels[i]
                back_x = turned(x, sizes)
                (one, t1), (two, t2) = self.ways[0].forward(x, mask, True), self.ways[1].forward(back_x, mask, True)
                both = np.concatenate([one, turned(two, sizes), x], 2)
                error = (sigmoid(both @ self.w + self.b) - y) * mask / mask.sum()
                d = error[:, :, None] * self.w
                u = one.shape[2]
                (g1, x1), (g2, x2) = self.ways[0].backward(x, t1, d[:, :, :u]), self.ways[1].backward(back_x, t2, turned(d[:, :, u : 2 * u], sizes))
                said = (x1 + turned(x2, sizes) + d[:, :, 2 * u :])[:, :, PATH_BINS : PATH_BINS + WORD_SIZE]
                grads = [*g1, *g2, (both * error[:, :, None]).sum((0, 1)), error.sum(keepdims=True).reshape(1), self.word_gradient(said, [pages[i] for i in some])]
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                for p, g, a, s in zip(self.params(), grads, m, v, strict=True):
                    g = g * min(1, 1 / (size + 1e-9))
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    pace = rate * 0.65**turn
                    if p is self.vectors:  # words that tell nothing are forgotten, so that single pages are not learnt by heart
                        p *= 0.98
                        pace *= 0.3
                    p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def word_gradient(self, said: np.ndarray, pages: list[Rows]) -> np.ndarray:
        each = np.concatenate([np.repeat(row[: len(p)] / np.maximum(1, p.words)[:, None], p.words, axis=0) for row, p in zip(said, pages, strict=True)])
        bins, out = np.concatenate([p.bins for p in pages]), np.zeros_like(self.vectors)
        order = np.argsort(bins, kind="stable")
        if len(order):
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            out[bins[order][first]] = np.add.reduceat(each[order], first, axis=0)
        return out


#: Names that pages use for their parts: fixed values of the training pages.
NAMES = {
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs site-nav main-menu links toc skip pagination pager tabs".split(),
    "head": "header masthead top banner site-header branding logo topbar".split(),
    "foot": "footer foot site-footer colophon bottom copyright legal credits".split(),
    "side": "sidebar aside side widget related recommended popular trending more-stories rail secondary".split(),
    "note": "notice cookie cookies consent gdpr alert banner popup modal newsletter subscribe paywall warning overlay toast".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsbox banner-ad".split(),
    "form": "form search searchform login signup contact-form subscribe-form".split(),
    "comments": "comments comment comment-list replies disqus discussion responses respond reader-comments".split(),
    "share": "share social sharing follow byline-share buttons tags tagcloud".split(),
    "main": "article content post entry main story body post-content entry-content article-body text prose page-content".split(),
    "plain": "wrapper container row col inner box block grid page wrap layout section outer".split(),
}
#: Words that stand in such parts more often than elsewhere: fixed values of the training pages.
TYPICAL = {
    "menu": "home about contact products services news archive sitemap startseite kontakt accueil inicio contacto menü",
    "head": "welcome search login willkommen bienvenue bienvenido suche",
    "foot": "copyright rights reserved privacy terms imprint impressum datenschutz mentions légales aviso legal powered by",
    "side": "related popular recent posts more trending archives categories beliebt ähnliche populaires recientes",
    "note": "we use cookies accept decline agree subscribe newsletter sign up continue akzeptieren zustimmen accepter aceptar suscribirse",
    "advert": "advertisement sponsored buy now offer sale discount free shipping anzeige werbung publicité publicidad oferta",
    "form": "name email password submit send search required senden envoyer enviar",
    "comments": "reply says said ago comment posted antworten répondre responder kommentar commentaire comentario",
    "share": "share tweet follow us facebook email print teilen partager compartir",
}
TAGS = {"menu": ["nav", "nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "note": ["div", "aside", "section", "dialog"], "advert": ["div", "aside", "section", "p"], "form": ["form", "form", "div"], "comments": ["div", "section", "ol", "aside"], "share": ["div", "ul"]}


class Invented:
    """Draws training pages."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        letters, ends = np.array(list("abcdefghijklmnoprstuvwzéüñ")), ["a", "e", "o", "en", "er", "ion", "th"]
        sizes, drawn, last = self.r.integers(1, 5, 20_000), letters[self.r.integers(0, len(letters), (20_000, 4))], self.r.integers(0, len(ends), 20_000)
        self.lexicon = ["".join(row[:n].tolist()) + ends[e] for row, n, e in zip(drawn, sizes.tolist(), last.tolist(), strict=True)]

    def words(self, low: int, high: int, kind: str = "") -> str:
        n = int(self.r.integers(low, high + 1))
        signs = self.r.random(n)
        if kind and self.r.random() < 0.5:
            usual = TYPICAL[kind].split()
            return " ".join(usual[k] if x < 0.6 else self.lexicon[j] for k, j, x in zip(self.r.integers(0, len(usual), n).tolist(), self.r.integers(0, len(self.lexicon), n).tolist(), signs.tolist(), strict=True)).capitalize()
        some = [self.lexicon[k] + ("," if x < 0.16 else "." if x < 0.32 else "") for k, x in zip(self.r.integers(0, len(self.lexicon), n).tolist(), signs.tolist(), strict=True)]
        style = self.r.random()
        if style < 0.08:  # signs within the text, as in lists, tables without tags and broken encodings
            marks = ("###", "&&&", "%%%", "***", "$$", "...", "--")
            some = [w + marks[k] if x < 0.5 else w for w, k, x in zip(some, self.r.integers(0, len(marks), n).tolist(), signs.tolist(), strict=True)]
        return (" | " if style > 0.95 else " ").join(some).capitalize() + ("." * 3 + " !*%")[int(self.r.integers(0, 7))].strip()

    def named(self, kind: str) -> str:
        if self.r.random() < 0.2:
            return ""
        name = str(self.r.choice(NAMES[kind]))
        return f' {self.r.choice(["class", "class", "id"])}="{name}{self.r.choice(["", "", " x", "-1"])}"'

    def junk(self, kind: str) -> list[tuple[str, int]]:
        tag = str(self.r.choice(TAGS[kind]))
        name = self.named(kind)
        if not name and tag in ("div", "section", "ul", "ol", "p", "dialog"):
            name = f' class="{self.r.choice(NAMES[kind])}"'
        out = [(f"<{tag}{name}>", 0)]
        for _ in range(self.r.integers(1, 8)):
            long = kind in ("comments", "note", "side", "foot", "advert") and self.r.random() < 0.7
            text = self.words(6, 60, kind) if long else self.words(1, 5, kind)
            if kind == "foot" and self.r.random() < 0.5:
                text = "© " + text
            inner = str(self.r.choice(["p", "div", "span", "li"] if kind != "form" else ["label", "p", "button", "div"]))
            link = self.r.random() < (0.9 if kind in ("menu", "share") else 0.3)
            text = f'<a href="/x">{text}</a>' if link and not long else text
            if tag == "p":
                inner = "span"
            out += [(f"<{inner}>", 0), (text, 0), (f"</{inner}>", 0)]
        return [*out, (f"</{tag}>", 0)]

    def content(self) -> list[tuple[str, int]]:
        tag = str(self.r.choice(["article", "article", "main", "div", "section"]))
        name = self.named("main")
        if not name and tag in ("div", "section"):
            name = f' class="{self.r.choice(NAMES["main"])}"'
        bare = self.r.random() < 0.12  # nothing tells where the content begins
        out = [] if bare else [(f"<{tag}{name}>", 0)]
        if self.r.random() < 0.8:
            out += [("<h1>", 0), (self.words(1, 10), 1), ("</h1>", 0)]
        for _ in range(int(self.r.choice([1, 2, 4, 8, 15, 30, 80], p=[0.15, 0.15, 0.2, 0.2, 0.15, 0.1, 0.05]))):
            kind = str(self.r.choice(["p", "p", "p", "p", "p", "h2", "h3", "ul", "blockquote", "pre", "table", "bold"]))
            if kind in ("p", "blockquote", "pre"):
                out += [(f"<{kind}>", 0), (self.words(1, 120), 1), (f"</{kind}>" if self.r.random() < 0.8 or kind != "p" else "", 0)]
            elif kind in ("h2", "h3"):
                out += [(f"<{kind}>", 0), (self.words(1, 8), 1), (f"</{kind}>", 0)]
            elif kind == "ul":
                out += [("<ul>", 0), *[x for _ in range(self.r.integers(1, 6)) for x in (("<li>", 0), (self.words(1, 25), 1), ("</li>", 0))], ("</ul>", 0)]
            elif kind == "table":
                out += [("<table><tr>", 0), *[x for _ in range(self.r.integers(1, 5)) for x in (("<td>", 0), (self.words(1, 6), 1), ("</td>", 0))], ("</tr></table>", 0)]
            else:
                out += [("<p><b>", 0), (self.words(1, 120), 1), ("<br>", 0)]
            if self.r.random() < 0.08:
                out += self.junk(str(self.r.choice(["advert", "note", "share", "side", "form"])))
        return out if bare else [*out, (f"</{tag}>", 0)]

    def page(self) -> tuple[str, list[int]]:
        if self.r.random() < 0.05:  # no more than a few words or bare paragraphs
            text = self.words(1, 200)
            return str(self.r.choice([text, f"<p>{text}", f"<div>{text}</div>", f"<body>{text}"])), [1]
        parts = [("<!DOCTYPE html><html><head><title>", 0), (self.words(1, 8), -1), ("</title><style>p{margin:0}</style></head><body>", 0)]
        pick = lambda kinds, n: [x for _ in range(n) for x in self.junk(str(self.r.choice(kinds)))]
        boxes = self.r.integers(0, 3)
        parts += [(f"<div{self.named('plain')}>", 0)] * boxes
        parts += pick(["menu", "head", "note", "advert", "form", "menu"], self.r.integers(0, 4))
        parts += self.content()
        parts += pick(["comments", "side", "foot", "share", "advert", "form", "comments", "note"], self.r.integers(0, 4))
        if self.r.random() < 0.7:
            parts += self.junk("foot")
        if self.r.random() < 0.8:
            parts += [("</div>", 0)] * boxes + [("</body></html>", 0)]
        texts = {}
        for text, label in parts:
            if not text.startswith("<") or text.startswith("<a "):
                texts.setdefault(SPACE.sub(" ", unescape(re.sub("<[^>]*>", "", text))).strip(), label)
        html = "".join(t for t, _ in parts)
        return html, [max(0, texts.get(b.text, 0)) for b in blocks(html)]


_TRAINED: dict[tuple, Labeller] = {}


def trained(pages: int = 1200, seed: int = 17, spark: SparkSession | None = None) -> Labeller:
    """The labeller, trained on ``pages`` invented pages: once per process and, given a session, once per shared folder.

    There the weights lie under a hash of this module and the settings.
    """
    key = (pages, seed)
    if key in _TRAINED:
        return _TRAINED[key]
    made, at, store = Labeller(), None, None
    if spark is not None:
        with open(__file__, "rb") as own:
            name = hashlib.sha256(own.read() + repr(key).encode()).hexdigest()[:32]
        store, at = store_of(f"{shared_dir(spark)}/html-labeller-{name}.npz")
        if store.get_file_info(at).type != fs.FileType.NotFound:
            with store.open_input_file(at) as f, np.load(io.BytesIO(f.read())) as held:
                for p, k in zip(made.params(), held.files, strict=True):
                    p[:] = held[k]
            return _TRAINED.setdefault(key, made)
    source = Invented(seed)
    drawn = [source.page() for _ in range(pages)]
    rows = [(Rows(found), np.array(y, np.float32)) for h, y in drawn if (found := blocks(h))]
    with one_thread():
        made.train([x for x, _ in rows], [y for _, y in rows])
    if at is not None:
        held = io.BytesIO()
        np.savez(held, *made.params())
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        draft = f"{at}.{hashlib.sha256(repr(id(made)).encode()).hexdigest()[:8]}"
        with store.open_output_stream(draft) as f:
            f.write(held.getvalue())
        put_in_place(store, draft, at)
    return _TRAINED.setdefault(key, made)


def main_texts(pages: list[str | None], labeller: Labeller, cells: int = 30_000, stretch: int = STRETCH) -> list[str]:
    """The main text of each page: its content blocks, one line each. ``cells`` bounds a batch's padded blocks, ``stretch`` one page's."""
    parsed = [blocks(p) for p in pages]
    order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    out, some = [""] * len(pages), []

    def told(i, p):
        out[i] = "\n".join(b.text for b, x in zip(parsed[i], p, strict=True) if x >= 0.5)

    def label():
        for i, p in zip(some, labeller.probabilities([Rows(parsed[i]) for i in some]), strict=True):
            told(i, p)
        some.clear()

    for i in order:
        if some and (len(some) + 1) * len(parsed[i]) > cells:
            label()
        if len(parsed[i]) > stretch:
            told(i, labeller.probabilities_of_long(parsed[i], stretch))
        else:
            some.append(i)
    if some:
        label()
    return out


def extract(df: DataFrame, html_col: str = "html", out: str = "main_text", labeller: Labeller | None = None) -> DataFrame:
    """df with each whole page's main text, as ``out`` (``out_1`` and so on where df has that name); empty where html is null, empty or without content.

    Character references are decoded, white space within a block is one space,
    and blocks follow in the page's order. Bare text without tags is parsed like any
    page, and pages of any depth and number of blocks. Repeated rows and all columns
    stay; an empty table gives an empty result.
    """
    at, labeller, out = df.columns.index(html_col), labeller or trained(spark=df.sparkSession), own_name(df, out)

    @tidied
    def each(batches):
        for batch in batches:
            texts, some, held = [], [], 0
            for html in batch.column(at):
                some.append(html.as_py())
                held += len(some[-1] or "")
                if held > 1 << 20:
                    texts += main_texts(some, labeller)
                    some, held = [], 0
            texts += main_texts(some, labeller)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(each, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def op8_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    made = extract(pages)
    return made.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
