"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is scanned into leaf blocks: runs of text between block-level tags, with white space folded and
character references decoded. Each block gets features of its ancestors (tags, and words of their class,
id and role attributes), of its text (length, links, punctuation) and of its neighbours. The chain's
labels are main text or not; weights are fitted by gradient steps on the exact likelihood (forward and
backward sums) over labelled pages, and Viterbi decodes the best labelling of a page.

The labelled pages are made by ``labelled_pages``: a generator of varied layouts (menus, headers,
asides, notices, adverts, forms, comments, footers around an article, semantic tags or plain ``div``s)
whose main blocks are known. The model has a fixed size and is trained on the driver in seconds.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framewright.llm.arrow import append_columns, text_view

#: Fixed values of HTML: tags that break a block, tags whose text is never shown, tags without an end,
#: and tags that end an open paragraph.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN_TAGS = frozenset("script style template noscript iframe svg math canvas object textarea select".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = BLOCK_TAGS - {"br", "button", "option", "select", "body", "html", "head", "title"}

#: Text up to the next thing that begins like markup; possessive, so no byte is looked at twice.
_TEXT = re.compile(r"[^<]*+(?:<(?![a-zA-Z/!?])[^<]*+)*+")
#: A tag: its slash, name and attributes, where ">" in quotes doesn't end it; again possessive.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


#: Words of attributes by the part of a page they name.
NAMED = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead banner topbar logo hero",
    "foot": "footer copyright legal colophon bottom imprint",
    "side": "sidebar aside widget related recommended promo rail secondary trending",
    "note": "cookie consent notice alert gdpr popup modal overlay newsletter subscribe signup paywall",
    "ad": "ad ads advert advertisement adsense sponsor sponsored banner",
    "talk": "comment comments disqus reply replies discussion respond reader",
    "form": "form search login register",
    "share": "share social sharing follow meta byline tags author",
    "main": "article content post entry story main body text page",
}
_KIND = {w: k for k, ws in NAMED.items() for w in ws.split()}

#: Tags that tell nothing about what they hold.
PLAIN_TAGS = frozenset("html body div span b i em strong".split())
#: Tags that features name; any other is as good as plain, so what a block inherits has a bound.
KNOWN_TAGS = (BLOCK_TAGS | HIDDEN_TAGS | frozenset("a abbr cite code data del dfn ins kbd label mark q s samp small sub sup time u var".split())) - PLAIN_TAGS


@dataclass(frozen=True)
class Place:
    """Where in a page a block is: what its ancestors say, summed up from the outermost on."""

    number: int  # the same for blocks under the same ancestors' tags and names
    under: frozenset[str]  # known tags among them
    kinds: frozenset[str]  # kinds of page parts that words of their class, id and role name
    leaf: str  # the innermost block tag


ROOT = Place(0, frozenset(), frozenset(), "none")


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters inside links


class Reader:
    """Reads one page into leaf blocks, in time in proportion to its length whatever its markup: each
    open element carries the sums of its ancestors, and open tags are found by their last places."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = self.hidden = 0
        self.stack: list[tuple[str, Place, bool]] = []
        self.places: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.open_blocks: list[int] = []
        self.known: dict[tuple, Place] = {}

    def text(self, raw: str) -> None:
        if raw and not self.hidden:
            self.parts.append(raw)
            self.linked += len(raw) * (self.links > 0)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.out.append(Block(text, self.stack[-1][1] if self.stack else ROOT, self.linked))
        self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, _, was_hidden = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.open_blocks.pop()
            self.links -= tag == "a"
            self.hidden -= was_hidden

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if self.places.get(tag):
            self.pop(self.places[tag][-1])

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in ENDS_PARAGRAPH:
            p = self.places.get("p")
            if p and self.open_blocks[-1] == p[-1]:
                self.pop(p[-1])
            if tag in ("li", "dd", "dt", "option", "tr", "td", "th") and self.stack and self.stack[-1][0] == tag:
                self.pop(len(self.stack) - 1)
        if tag in VOID_TAGS or attributes.endswith("/"):
            return
        words: set[str] = set()
        is_hidden = tag in HIDDEN_TAGS
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    words.update(_WORD.findall(value))
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    is_hidden = True
        outer = self.stack[-1][1] if self.stack else ROOT
        key = (outer.number, tag, frozenset(words))
        place = self.known.get(key)
        if place is None:
            kinds = {_KIND[w] for w in words if w in _KIND}
            place = self.known[key] = Place(
                len(self.known) + 1,
                outer.under | {tag} if tag in KNOWN_TAGS and tag not in outer.under else outer.under,
                outer.kinds | kinds if kinds - outer.kinds else outer.kinds,
                tag if tag in BLOCK_TAGS else outer.leaf,
            )
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.open_blocks.append(len(self.stack))
        self.stack.append((tag, place, is_hidden))
        self.links += tag == "a"
        self.hidden += is_hidden


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order. Unclosed and stray tags do no harm; an open ``p`` ends where
    another block begins; comments, scripts, styles and hidden elements have no text. Where quotes never
    close, tags from there on end at the next ``>``, and a tag that never ends is text."""
    read = Reader()
    at, n = 0, len(page)
    quoted, ends = True, True  # whether quotes still close, and whether a ">" is still ahead
    while at < n:
        m = _TEXT.match(page, at)
        if m.end() > at:
            read.text(m[0])
            at = m.end()
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page[at + 1] in "!?":
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, at) if quoted and ends else None
        if m:
            slash, tag, attributes, at = m[1], m[2].lower(), m[3], m.end()
        else:
            head = _NAME.match(page, at)
            end = page.find(">", at) if ends else -1
            quoted, ends = quoted and head is None, end >= 0
            if end < 0 or head is None and page[at + 1] != "/":
                read.text(page[at])
                at += 1
                continue
            if head is None:  # "</" before anything but a letter is a comment
                at = end + 1
                continue
            slash, tag, attributes, at = head[1], head[2].lower(), page[head.end() : end], end + 1
        if slash:
            read.end(tag)
            continue
        read.start(tag, attributes)
        if tag in _RAW_END and read.stack and read.stack[-1][0] == tag:  # text up to the end tag, whatever it holds
            end = _RAW_END[tag].search(page, at)
            stop = end.start() if end else n
            if tag == "title":
                read.text(page[at:stop])
            at = stop
    read.flush()
    return read.out


#: Phrases of notices, forms and footers.
_PHRASES = re.compile(r"cookie|newsletter|subscri|sign up|log ?in|privacy|copyright|©|all rights|advert|sponsor|accept|read more|share|comment|reply", re.I)


@lru_cache(maxsize=4096)
def place_features(place: Place) -> tuple[str, ...]:
    return ("bias", *(f"under:{t}" for t in sorted(place.under)), *(f"named:{k}" for k in sorted(place.kinds)), f"leaf:{place.leaf}")


def features(page: list[Block]) -> list[tuple[tuple[str, ...], tuple[str, ...]]]:
    """Names of each block's features: of its place, and of its text and neighbours."""
    inside = [not b.place.under.isdisjoint(("article", "main")) for b in page]
    any_inside = any(inside)
    lengths = [min(8, len(b.text).bit_length()) for b in page]
    linked = [min(3, 4 * b.linked // max(1, len(b.text))) for b in page]
    out = []
    for i, b in enumerate(page):
        n = len(b.text)
        f = [f"length:{lengths[i]}", f"linked:{linked[i]}", f"stops:{min(4, sum(map(b.text.count, '.!?,;')))}", f"ends:{b.text[-1] in '.!?…»”'}"]
        if _PHRASES.search(b.text):
            f.append("phrase")
            if n < 120:
                f.append("phrase, short")
        f.append(f"the page's article:{inside[i]}" if any_inside else "no article")
        f.append("first" if i == 0 else "last" if i == len(page) - 1 else "mid")
        for name, j in (("before", i - 1), ("after", i + 1)):
            if 0 <= j < len(page):
                f += (f"{name} length:{lengths[j]}", f"{name} linked:{linked[j]}")
        if i and page[i - 1].place.number == b.place.number:
            f.append("as before")
        out.append((place_features(b.place), tuple(f)))
    return out


@dataclass
class ChainField:
    """Weights of features by label (0: other, 1: main) and of label pairs."""

    index: dict[str, int]
    weights: np.ndarray  # features x 2
    steps: np.ndarray  # 2 x 2

    def __post_init__(self) -> None:
        self.pairs = [tuple(x) for x in self.weights.tolist()]

    def scores(self, page: list[Block]) -> np.ndarray:
        get, pairs = self.index.get, self.pairs
        sums: dict[tuple[str, ...], tuple[float, float]] = {}

        def total(names: tuple[str, ...]) -> tuple[float, float]:
            found = [pairs[k] for k in map(get, names) if k is not None]
            return sum(x for x, _ in found), sum(y for _, y in found)

        out = np.empty((len(page), 2))
        for i, (place, text) in enumerate(features(page)):
            if place not in sums:
                sums[place] = total(place)
            (a, b), (c, d) = sums[place], total(text)
            out[i] = a + c, b + d
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The best labelling, by Viterbi; ties go to other."""
        if not page:
            return []
        s = self.scores(page).tolist()
        (a, b), (c, d) = self.steps.tolist()
        x, y = s[0]
        back = []
        for u, v in s[1:]:
            from_0, from_1 = x + a >= y + c, x + b >= y + d
            back.append((from_0, from_1))
            x, y = (x + a if from_0 else y + c) + u, (x + b if from_1 else y + d) + v
        label = int(y > x)
        out = [label]
        for pair in reversed(back):
            label = 0 if pair[label] else 1
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.5, ridge: float = 1e-3, seed: int = 0) -> ChainField:
    """Fits the field to labelled pages by adaptive gradient steps on the log-likelihood."""
    rng = random.Random(seed)
    named = [([a + b for a, b in features(p)], y) for p, y in pages if p]
    index: dict[str, int] = {}
    for f, _ in named:
        for names in f:
            for name in names:
                index.setdefault(name, len(index))
    w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gt = np.full((len(index), 2), 1.0), np.full((2, 2), 1.0)
    data = [([np.array([index[n] for n in names]) for names in f], np.array(y)) for f, y in named]
    for _ in range(epochs):
        rng.shuffle(data)
        for f, y in data:
            n = len(y)
            s = np.array([w[k].sum(axis=0) for k in f])
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = s[0]
            for i in range(1, n):
                alpha[i] = s[i] + np.logaddexp(alpha[i - 1][0] + t[0], alpha[i - 1][1] + t[1])
            for i in range(n - 2, -1, -1):
                after = s[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(t[:, 0] + after[0], t[:, 1] + after[1])
            z = np.logaddexp(*alpha[-1])
            g = np.exp(alpha + beta - z)
            g[np.arange(n), y] -= 1
            dt = np.zeros((2, 2))
            for i in range(1, n):
                dt += np.exp(alpha[i - 1][:, None] + t + (s[i] + beta[i])[None, :] - z)
                dt[y[i - 1], y[i]] -= 1
            for k, row in zip(f, g, strict=True):
                d = row + ridge * w[k]
                gw[k] += d * d
                w[k] -= rate * d / np.sqrt(gw[k])
            gt += dt * dt
            t -= rate * dt / np.sqrt(gt)
    return ChainField(index, w, t)


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """``n`` generated pages of varied layout, as blocks and their labels (1: main text)."""
    rng = random.Random(seed)
    syllables = "an be ción de en er es fra ge ha in ka la men ne on pa que re sta ti un ver wo é ü ñ zu".split()
    mark = "⁣"  # stands before main blocks' text, and is taken away again

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def sentence(least: int = 3, most: int = 18) -> str:
        kind = rng.random()
        s = [word() for _ in range(rng.randint(least, most))]
        if kind < 0.08:
            s = [x + rng.choice(("***", "###", "$$$", "&amp;&amp;")) for x in s]
        elif kind < 0.14:
            s = [x.upper() + "!!" for x in s]
        elif kind < 0.2:
            return " | ".join(s)
        elif kind < 0.25:
            s = [s[0]] * len(s)
        return " ".join(s).capitalize() + rng.choice((".", ".", ".", "?", "", ","))

    def text(sentences: int) -> str:
        return " ".join(sentence() for _ in range(sentences))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    def attribute(kind: str) -> str:
        if rng.random() < 0.12:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(NAMED[kind].split())}{rng.choice(("", "-box", " x1", "-wrap"))}"'

    def paragraph(main: bool) -> str:
        m = mark if main else ""
        kind = rng.random()
        body = text(rng.choice((1, 1, 2, 3, 5, 8)))
        if kind < 0.06:
            body = word() + rng.choice((".", ""))
        if kind < 0.12:
            return f"<p><b>{m}{body}<br>"
        if kind < 0.2:
            return f"<p>{m}{body} <a href='/x'>{sentence(1, 3)}</a> {sentence()}</p>"
        if kind < 0.26:
            return f"<ul><li>{m}{sentence()}</li><li>{m}{sentence()}</li></ul>"
        if kind < 0.3:
            return f"<blockquote>{m}{body}</blockquote>"
        if kind < 0.36:
            return f"<h{rng.choice((2, 3))}>{m}{sentence(1, 6)}</h2>"
        if kind < 0.4:
            return f"<table><tr><td>{m}{word()}</td><td>{m}{sentence(1, 4)}</td></tr></table>"
        if kind < 0.43:
            return f"<figure><figcaption>{m}{sentence()}</figcaption></figure><pre>{m}{sentence()}</pre>"
        return f"<p>{m}{body}</p>"

    def aside(kind: str) -> str:
        tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div")
        if rng.random() < 0.3:
            tag = rng.choice(("div", "section"))
        short = text(rng.choice((1, 1, 2)))
        body = {
            "menu": lambda: f"<ul>{links(rng.randint(2, 8))}</ul>",
            "head": lambda: rng.choice((f"<h1>{sentence(1, 3)}</h1>{links(3)}", f"<p>{sentence(1, 6)}</p>", f"<div>{short}</div>")),
            "foot": lambda: rng.choice((f"&copy; {word()}.example.com &middot; {short}", f"<p>{short}</p><ul>{links(3)}</ul>", f"Copyright {sentence()}")),
            "side": lambda: rng.choice((f"<h3>{sentence(1, 4)}</h3><ul>{links(5)}</ul>", f"<p>{short}</p>", f"<h3>{word()}</h3><p>{text(3)}</p>")),
            "note": lambda: rng.choice((f"We use cookies. {short} <button>Accept</button>", f"<p>{short}</p><button>{word()}</button>", f"Subscribe to the newsletter: {short}")),
            "ad": lambda: rng.choice((short, f"<p>{short}</p>", f"Advertisement {short}", f"<a href='/ad'>{short}</a>")),
            "talk": lambda: "".join(f"<div class='{rng.choice(('comment', 'reply', 'user'))}'><p>{text(rng.choice((1, 2, 4)))}</p></div>" for _ in range(rng.randint(1, 4))),
            "form": lambda: f"<label>{word()}</label><input name='q'><button>{word()}</button><p>{sentence()}</p>",
            "share": lambda: f"<a href='/s'>{word()}</a> <a href='/t'>{word()}</a> {sentence(1, 3)}",
        }[kind]()
        if tag == "div" and kind in ("menu", "foot", "head", "side", "form", "talk") and rng.random() < 0.7:
            return f'<{tag} class="{rng.choice(NAMED[kind].split())}">{body}</{tag}>'
        return f"<{tag}{attribute(kind)}>{body}</{tag}>"

    out = []
    for _ in range(n):
        title = sentence(2, 10)
        head = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        before = "".join(aside(k) for k in ("note", "head", "menu", "ad", "form", "side") if rng.random() < 0.45)
        after = "".join(aside(k) for k in ("ad", "share", "side", "talk", "note", "form", "foot") if rng.random() < 0.45)
        body = [f"<h1>{mark}{title}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13))):
            body.append(paragraph(True))
            if rng.random() < 0.07:
                body.append(aside(rng.choice(("ad", "ad", "share", "side", "note", "form"))))
        if rng.random() < 0.15:
            body.append(aside("talk"))
        kind = rng.random()
        if kind < 0.6:
            main = f"<article>{''.join(body)}</article>"
        elif kind < 0.75:
            main = f"<main>{''.join(body)}</main>"
        else:
            main = f'<div class="{rng.choice(NAMED["main"].split())}">{"".join(body)}</div>'
        page = blocks(head + before + main + after + "</body></html>")
        labels = [int(mark in b.text) for b in page]
        out.append(([Block(b.text.replace(mark, ""), b.place, b.linked) for b in page], labels))
    return out


@lru_cache(maxsize=1)
def default_model() -> ChainField:
    return train(labelled_pages())


def main_text(page: str, model: ChainField) -> str:
    """The main blocks of a page, joined by one space; '' when there is none."""
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, model.decode(found), strict=True) if y)


def extract(df: DataFrame, model: ChainField | None = None, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out_col``, the main text of each page; null and empty pages, and pages without main text,
    give ''. One row for each row; a column named ``out_col`` is replaced. Pages are read whole."""
    held = df.sparkSession.sparkContext.broadcast(model or default_model())  # a few hundred weights

    def make():
        m = held.value

        def run(col: pa.Array) -> list:
            raw, off = text_view(col)
            data = raw[off[0] : off[-1]].tobytes()
            off = (off - off[0]).tolist()
            return [[main_text(data[a:b].decode("utf-8"), m) for a, b in zip(off[:-1], off[1:], strict=True)]]

        return run

    return append_columns(df, html_col, T.StructType([T.StructField(out_col, T.StringType())]), make, keep)
