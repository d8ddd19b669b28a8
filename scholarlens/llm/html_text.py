"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags, each with
the tags and class names above it. A chain of two labels, content and
boilerplate, runs over the blocks of a page; ancestor and text features score
the labels, transition weights their order, and Viterbi finds the best labels.

Training pages come from a bounded sample of the given pages. Where a page marks
its article by tags, its blocks are labelled by them; those blocks are then also
set into ``layouts`` (plain divisions, sidebars, notices, forms, comments), so
that the model does not lean on one tag that other sites do not use.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlens.llm.common import mapped

SAMPLE_PAGES, SAMPLE_CHARS = 300, 200_000
EPOCHS, RATE, DECAY = 6, 0.5, 1e-4
#: Elements above a block, from the nearest on, that give it features.
ABOVE = 100
#: Tags that do not break a block, tags without an end, tags whose content is not text, and
#: tags that end an open one of their own kind.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace mstyle msub msup msubsup mfrac msqrt mroot mover munder munderover".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes".split())
SECTIONS = frozenset("article aside body dialog footer form head header main menu nav section".split())
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Tags that end an open paragraph.
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_QUOTED = re.compile(r"[^>\"']*+")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Tags and names that mark main text and what stands around it.
_CONTENT_TAGS = {"article", "main"}
_OUTER_TAGS = {"nav", "footer", "aside", "form", "header", "button", "select", "dialog", "title", "head", "menu"}
_OUTER_NAMES = {"ad", "advert", "nav", "menu", "sidebar", "footer", "comment", "cookie", "notice", "banner", "promo", "share", "related"}


class Block:
    """A leaf block: its text, the share of it in links, and the tags and names of the nearest elements above it."""

    __slots__ = ("text", "linked", "tags", "names", "tag", "nearest")

    def __init__(self, text: str, linked: int, stack: list):
        self.text, self.linked = text, linked
        near = stack[-ABOVE:]
        self.tags = [tag for tag, _ in near]
        self.names = {n for _, names in near for n in names}
        self.tag = next((t for t in reversed(self.tags) if t not in INLINE), "")
        # the nearest element that groups blocks: a sectioning one, or one with a name
        self.nearest = next(((t, names) for t, names in reversed(near) if t in SECTIONS or (names and t not in INLINE)), ("", ()))


def _names(attributes: str) -> tuple:
    if "=" not in attributes:
        return ()
    values = (a or b or c for a, b, c in _NAMED.findall(attributes))
    return tuple({w.lower().rstrip("s") or w.lower() for v in values for w in _PART.findall(v)})


class _Tags:
    """Markup of a page, one piece after another, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.quotes, self.absent = page, True, set()

    def _end(self, at: int) -> int:
        """Place of the bracket that ends a tag from ``at`` on: outside quotes, or the first one where quotes are never closed."""
        page, first = self.page, self.page.find(">", at)
        while self.quotes:
            at = _QUOTED.match(page, at).end()
            if at >= len(page):
                # once is enough: later tags take the first bracket
                self.quotes = False
                break
            mark = page[at]
            if mark == ">":
                return at
            close = -1 if mark in self.absent else page.find(mark, at + 1)
            if close < 0:
                self.absent.add(mark)
                return first
            at = close + 1
        return first

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(start, end, slash, tag, attributes) of the next piece of markup; the tag is "" for comments and the like."""
        page = self.page
        last = page.rfind(">") if not hasattr(self, "last") else self.last
        self.last = last
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if start > last:
                break
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", "", ""
            name = _NAME.match(page, start + 1)
            if name:
                end = self._end(name.end())
                return start, end + 1, name[1], name[2].lower(), page[name.end() : end]
            at = start + 1
        return len(page), len(page), "", "", ""


class _Open:
    """The open elements, with the places of each tag and of those that break a block."""

    def __init__(self):
        self.stack: list[tuple[str, tuple]] = []
        self.places: dict[str, list[int]] = {}
        self.breaks: list[int] = []

    def push(self, tag: str, names: tuple) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.breaks.append(len(self.stack))
        self.stack.append((tag, names))

    def pop_to(self, count: int) -> None:
        while len(self.stack) > count:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.breaks.pop()

    def close(self, tag: str) -> None:
        """An end tag closes the nearest element of its kind; an inline one only within its block."""
        places = self.places.get(tag)
        if places and (tag not in INLINE or not self.breaks or places[-1] > self.breaks[-1]):
            self.pop_to(places[-1])

    def end_before(self, tag: str) -> None:
        """What a start tag ends: an element of its own kind, and a paragraph."""
        ends = SELF_ENDING.get(tag, ())
        for k in reversed(self.breaks):
            name = self.stack[k][0]
            if name in ends or (name == "p" and tag in _CLOSES_P):
                self.pop_to(k)
                break
            if name != "p":
                break

    def within(self, tag: str) -> bool:
        return bool(self.places.get(tag))


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; character references decoded, white space squeezed."""
    out: list[Block] = []
    parts: list[str] = []
    linked, at = 0, 0
    tags, open_, unclosed = _Tags(page), _Open(), set()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, open_.stack))
            parts.clear()
            linked = 0

    while at < len(page):
        start, end, slash, tag, attributes = tags.next(at)
        if start > at:
            parts.append(page[at:start])
            linked += (start - at) * open_.within("a")
        at = end
        if tag == "br":
            parts.append(" ")
        elif tag in RAW and not slash:
            if not attributes.endswith("/") and tag not in unclosed:
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                else:
                    unclosed.add(tag)
        elif tag:
            if tag not in INLINE:
                flush()
            if slash:
                open_.close(tag)
                continue
            if tag in SELF_ENDING or tag in _CLOSES_P:
                open_.end_before(tag)
            if tag not in VOID and not attributes.endswith("/"):
                open_.push(tag, _names(attributes))
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        size = min(7, words.bit_length())
        row = ["bias", f"tag={b.tag}", f"size={size}", f"links={int(min(1.0, share) * 3)}", f"end={b.text[-1] in '.!?'}"]
        row += [f"before={size if k == 0 else min(7, (page[k - 1].text.count(' ') + 1).bit_length())}", f"same={k > 0 and page[k - 1].tags == b.tags}"]
        row += [f"in={t}" for t in set(b.tags)]
        row += [f"near={b.nearest[0]}", *(f"near={b.nearest[0]}.{n}" for n in b.nearest[1])]
        row += [f"name={n}" for n in b.names]
        row.append(f"first={k == 0}")
        out.append(row)
    return out


class Chain:
    """Weights of a two-label linear chain; label 1 is content."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.state = np.zeros((len(names) + 1, 2))
        self.step = np.zeros((2, 2))

    def rows(self, page: list[list[str]]) -> list[np.ndarray]:
        unknown = len(self.names)
        return [np.array([self.names.get(f, unknown) for f in row]) for row in page]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.state[r].sum(axis=0) for r in rows])

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels (n x 2) and of neighbouring pairs (n - 1 x 2 x 2), by forward and backward sums."""
        n = len(scores)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = scores[0]
        for k in range(1, n):
            forward[k] = scores[k] + np.logaddexp(forward[k - 1][0] + self.step[0], forward[k - 1][1] + self.step[1])
        for k in range(n - 2, -1, -1):
            to = scores[k + 1] + backward[k + 1]
            backward[k] = np.logaddexp(self.step[:, 0] + to[0], self.step[:, 1] + to[1])
        total = np.logaddexp(*forward[-1])
        pairs = forward[:-1, :, None] + self.step[None] + (scores[1:] + backward[1:])[:, None, :]
        return np.exp(forward + backward - total), np.exp(pairs - total)

    def learn(self, rows: list[np.ndarray], labels: np.ndarray, squares: tuple, rate: float) -> None:
        """One AdaGrad step on the log-likelihood of a page."""
        nodes, pairs = self.marginals(self.scores(rows))
        error = -nodes
        error[np.arange(len(labels)), labels] += 1
        flat = np.concatenate(rows)
        used, local = np.unique(flat, return_inverse=True)
        grad = np.zeros((len(used), 2))
        np.add.at(grad, local, np.repeat(error, [len(r) for r in rows], axis=0))
        grad -= DECAY * self.state[used]
        squares[0][used] += grad**2
        self.state[used] += rate * grad / np.sqrt(squares[0][used] + 1e-6)
        self.state[-1] = 0
        step = -pairs.sum(axis=0)
        np.add.at(step, (labels[:-1], labels[1:]), 1)
        squares[1][:] += step**2
        self.step += rate * step / np.sqrt(squares[1] + 1e-6)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The likeliest labels of a page; a tie goes to content."""
        (a, b), back = scores[0].tolist(), []
        (aa, ab), (ba, bb) = self.step.tolist()
        for x, y in scores[1:].tolist():
            back.append((0 if a + aa > b + ba else 1, 0 if a + ab > b + bb else 1))
            a, b = x + max(a + aa, b + ba), y + max(a + ab, b + bb)
        label = 0 if a > b else 1
        out = [label]
        for row in reversed(back):
            label = row[label]
            out.append(label)
        return out[::-1]


def marked(page: list[Block]) -> np.ndarray | None:
    """Labels by the page's own tags; None where it marks no article."""
    inside = [bool(_CONTENT_TAGS & set(b.tags)) for b in page]
    if not any(inside):
        return None
    return np.array([int(i and not _OUTER_TAGS & set(b.tags) and not _OUTER_NAMES & b.names) for i, b in zip(inside, page)])


def layouts(content: list[str], outer: list[str], turn: int) -> list[tuple[str, int]]:
    """Pieces of a made page, (html, label), around the blocks of a real one; ``turn`` picks the layout.

    A piece without text, an opening or closing tag, has label -1.
    """
    c = [html.escape(t) for t in content]
    o = [html.escape(t) for t in outer] or ["Home"]

    def some(k: int, n: int = 1) -> list[str]:
        return [o[(turn + k + i) % len(o)] for i in range(n)]

    def wrap(tag: str, texts: list[str], inner: str = "p", label: int = 0) -> list[tuple[str, int]]:
        name = tag.split(" ")[0]
        return [(f"<{tag}>", -1), *((f"<{inner}>{t}</{inner.split(' ')[0]}>", label) for t in texts), (f"</{name}>", -1)]

    def links(tag: str) -> list[tuple[str, int]]:
        name = tag.split(" ")[0]
        return [(f"<{tag}><ul>", -1), *((f'<li><a href="#">{t}</a></li>', 0) for t in some(1, 5)), (f"</ul></{name}>", -1)]

    long = [content[i] for i in range(min(3, len(content)))]
    comments = [html.escape(t) for t in (long or ["Good."])]
    mains = ["article", "main", 'div class="content"', 'div id="main"', 'div class="post body"', 'section class="entry"', 'div class="article text"', "main><article"]
    main = mains[turn % len(mains)]
    heads = [links("nav"), links('div class="menu"'), wrap("header", some(2), "span"), wrap('div id="header"', some(3, 2), "h2"), links('ul class="nav"')]
    sides = [wrap("aside", some(4, 2)), wrap('div class="sidebar"', some(5, 3)), links('div class="related"'), wrap('div class="widget"', some(6, 2))]
    notices = [wrap('div class="ad"', some(7)), wrap('div class="notice"', some(8)), wrap('div class="cookie banner"', comments[:1]), wrap('div class="advert"', comments[:1]), wrap('div class="promo"', some(9))]
    forms = [wrap("form", some(2, 2), "label"), wrap('form class="search"', some(3), "button"), wrap('div class="newsletter subscribe"', some(4))]
    replies = [wrap('section class="comments"', comments), wrap('div id="comments"', comments, 'div class="comment"'), wrap('ol class="commentlist"', comments, "li"), wrap('div class="replies discussion"', comments)]
    feet = [wrap("footer", some(5)), wrap('div id="footer"', some(6, 2)), wrap('div class="footer copyright"', some(7))]
    inner = [(f"<p>{t}</p>" if k else f"<h1>{t}</h1>", 1) for k, t in enumerate(c)]
    cut = max(1, len(inner) // 2)
    if turn % 3 == 0:
        inner = inner[:cut] + notices[turn % 5] + inner[cut:]
    if turn % 5 == 0 and len(inner) > 3:
        inner = [*inner[:1], ("<ul>", -1), (f"<li>{c[-1]}</li>", 1), ("</ul>", -1), *inner[1:]]
    close = "".join(f"</{t.split(' ')[0].strip('<>')}>" for t in reversed(main.split("><")))
    parts = [("<head>", -1), (f"<title>{c[0]}</title>", 0), ("</head><body>", -1), *heads[turn % 5], *notices[(turn + 1) % 5]]
    if turn % 2:
        parts += sides[turn % 4]
    parts += [(f"<{main}>", -1), *inner]
    inside = turn % 4 == 1
    parts += replies[turn % 4] if inside else []
    parts += [(close, -1)]
    parts += sides[(turn + 1) % 4] if not turn % 2 else []
    parts += [] if inside else replies[(turn + 1) % 4]
    return [*parts, *forms[turn % 3], *feet[turn % 3], ("</body>", -1)]


def lessons(pages: list[str]) -> list[tuple[list[list[str]], np.ndarray]]:
    """Labelled pages for training: the marked ones, and their blocks in other layouts."""
    out = []
    for turn, page in enumerate(pages):
        found = blocks(page)
        labels = marked(found) if found else None
        if labels is None:
            continue
        out.append((features(found), labels))
        content = [b.text for b, y in zip(found, labels) if y]
        outer = [b.text for b, y in zip(found, labels) if not y]
        if content:
            pieces = layouts(content, outer, turn)
            made = blocks("".join(p for p, _ in pieces))
            wanted = [y for p, y in pieces if y >= 0 and blocks(p)]
            if len(made) == len(wanted):
                out.append((features(made), np.array(wanted)))
    return out


def train(pages: list[str], seed: int = 5) -> Chain:
    """Fit a chain on sampled pages; on ``STARTER`` alone where none of them marks an article."""
    data = lessons(pages) + lessons(STARTER)
    chain = Chain({f: k for k, f in enumerate(sorted({f for page, _ in data for row in page for f in row}))})
    squares = np.zeros_like(chain.state), np.zeros_like(chain.step)
    rng = np.random.default_rng(seed)
    prepared = [(chain.rows(page), labels) for page, labels in data]
    for turn in range(EPOCHS):
        for k in rng.permutation(len(prepared)):
            chain.learn(*prepared[k], squares, RATE / (1 + turn))
    return chain


#: A page with every kind of part, from which layouts are made when the sample has no marked page.
STARTER = [
    "<head><title>On the reading of old maps</title></head><body><header><span>Daily Atlas</span></header>"
    "<nav><ul><li><a href='/'>Home</a></li><li><a href='/maps'>Maps</a></li><li><a href='/about'>About us</a></li></ul></nav>"
    "<article><h1>On the reading of old maps</h1><p>Old maps show what their makers knew, and what they wished others to believe.</p>"
    f"<p>A coast is drawn with care where ships had anchored; inland, a river may follow nothing but hearsay number {k}.</p>"
    f"<p>{'So it was.' if k % 2 else 'So a reader has to ask of every line who could have walked along it.'}</p></article>"
    "<aside><p>Most read this week</p></aside><footer><p>All rights reserved.</p></footer></body>"
    for k in range(40)
]


def main_text(chain: Chain, page: str) -> str:
    """Text of the blocks that the chain labels as content, in page order, joined by one space."""
    found = blocks(page)
    if not found:
        return ""
    labels = chain.viterbi(chain.scores(chain.rows(features(found))))
    return " ".join(b.text for b, y in zip(found, labels) if y)


class _Extract:
    def __init__(self, chain: Chain):
        self.chain = chain

    def __call__(self, batch):
        texts = [main_text(self.chain, page) if page else "" for page in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}


def sampled_pages(pages: DataFrame, count: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most ``count`` pages of at most ``chars`` characters, by the least hash of their html."""
    hashed = pages.filter(F.length("html").between(1, chars)).select("html", F.xxhash64("html").alias("h"))
    wanted = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(count).collect()]
    rows = hashed.filter(F.col("h").isin(wanted)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h")
    return [r.html for r in rows.collect()]


def extracted(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    The text is the whole main text; "" where the html is null, empty or has no content.
    Null ids and urls stay null, repeated rows give equal rows, other columns are ignored.
    """
    chain = chain or train(sampled_pages(pages))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return mapped(rows, _Extract(chain), "page_id long, url string, text string, n_chars long")
