"""Main-text extraction: the maximum-scoring contiguous run of a page's words and tags.

A page is a sequence of words and tags. A word scores what a logistic model, fitted on labelled pages, says of the elements around
it (names and class words) and, where none of them is telling, of its block (how many words, which share of them in links,
whether sentences end in it); a tag scores a fixed cost below zero. One linear scan finds the contiguous run with the greatest sum. Text in the run whose own score
is below zero (an advert inside the article) is left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import slices

_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Elements whose inside is no text; of these, those that may close themselves, and those whose inside goes on to the page's end if none closes
#: them (of the others only the tag is skipped then). Elements that never have an inside.
_FOREIGN, _TO_THE_END = ("svg", "math", "object"), ("script", "style")
_RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "xmp", "select", "math", "object")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: The most that a word of clutter costs: an advert inside an article must not cut it in two.
CLUTTER = 0.02
#: Elements that close one of their own kind that is still open.
_ALONE = frozenset("p li dt dd tr td th option".split())


@dataclass
class Piece:
    """Text between two tags: its words, the features of the elements around it, and how many tags stand before it."""

    text: str
    words: int
    features: frozenset[str]
    tags: int
    block: int
    about: frozenset[str] = frozenset()


#: Elements whose names say what is in them; class, id and role words that the model knows do, too.
_TELLING = frozenset("article main nav header footer aside form button dialog".split())
#: A name that stands on fewer labelled pages is not known.
LEAST_PAGES = 8
#: A block's words, up to which each feature holds, and the share of them in links.
_SIZES, _LINKED = (2, 5, 10, 20, 40), (0.0, 0.3, 0.7)
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)]*(?:\s|\Z)")


def _with_blocks(found: list[Piece]) -> list[Piece]:
    """The pieces with what is to be said about their blocks."""
    at = 0
    while at < len(found):
        to = at
        while to < len(found) and found[to].block == found[at].block:
            to += 1
        own = found[at:to]
        n = sum(p.words for p in own)
        if n:
            share = sum(p.words for p in own if "a" in p.features) / n
            more = {f"#words{sum(n > x for x in _SIZES)}", f"#links{sum(share > x for x in _LINKED)}"}
            if any(_SENTENCE.search(p.text) for p in own):
                more.add("#sentence")
            if not any(p.features for p in own):
                more.add("#bare")
            for p in own:
                p.about = frozenset(more)
        at = to
    return found


def _names(name: str, rest: str) -> list[str]:
    out = [name]
    for key, *values in _ATTRIBUTE.findall(rest):
        out += [f"{'.' if key.lower() != 'role' else '@'}{w}" for w in re.findall(r"[a-z]+", "".join(values).lower())]
    return out


class _Ahead:
    """The next place of a pattern from a position on. Answers are kept, so that asking at every position costs one pass."""

    def __init__(self, page: str, pattern: str):
        self.page, self.pattern, self.start, self.end = page, re.compile(pattern), 0, -1

    def __call__(self, at: int) -> int:
        """-1 if there is none."""
        if self.end < 0 or not self.start <= at <= self.end:
            m = self.pattern.search(self.page, at)
            self.start, self.end = at, m.start() if m else len(self.page)
        return self.end if self.end < len(self.page) else -1


class Tags:
    """The tags and comments of a page in order, in time that grows with the page alone: what was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.special, self.stop = _Ahead(page, "[>\"']"), _Ahead(page, r"[\s/>]")
        self.no_end: set[int] = set()
        self.unclosed: set[str] = set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it is an end tag, lower-case name, the rest inside) of the next tag; a comment has no name."""
        while (start := self.page.find("<", at)) >= 0:
            for mark, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if self.page.startswith(mark, start):
                    to = self.page.find(end, start + len(mark))
                    return start, to + 3 if to >= 0 else len(self.page), False, "", ""
            if start > self.last:
                return None
            sign = self.page[start + 1]
            if sign in "!?":
                return start, self.page.index(">", start) + 1, False, "", ""
            first = start + 1 + (sign == "/")
            letter = self.page[first : first + 1]
            if letter.isascii() and letter.isalpha() and (stop := self.stop(first)) >= 0 and (to := self._end(stop)) >= 0:
                return start, to + 1, sign == "/", self.page[first:stop].lower(), self.page[stop:to]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """The > that ends a tag, past quoted values; -1 if there is none."""
        met = []
        while (to := self.special(at)) >= 0 and to not in self.no_end:
            if self.page[to] == ">":
                return to
            met.append(to)
            close = self.page.find(self.page[to], to + 1)
            if close < 0:
                break
            at = close + 1
        self.no_end.update(met)
        return -1

    def inside_end(self, name: str, at: int) -> int:
        """Where the end tag of an element ends that is open at `at`; -1 if none follows."""
        if name in self.unclosed:
            return -1
        m = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(self.page, at)
        if not m:
            self.unclosed.add(name)
        return m.end() if m else -1


def pieces(page: str, known=None) -> list[Piece]:
    """The text between tags. With `known`, of the names around a piece only these are held, `a`, and * for any other."""
    out: list[Piece] = []
    open_: list[tuple[str, list[str]]] = []
    opened: Counter[str] = Counter()
    names: Counter[str] = Counter()
    around, changed, tags, block, at = frozenset(), False, 0, 0, 0
    found = Tags(page)

    def text(to: int) -> None:
        nonlocal tags, around, changed
        if changed:
            around, changed = frozenset(x for x, n in names.items() if n), False
        if to > at:
            out.append(Piece(page[at:to], len(page[at:to].split()), around, tags, block))
            tags = 0

    def close() -> None:
        element, own = open_.pop()
        opened[element] -= 1
        for x in own:
            names[x] -= 1
            if not names[x]:
                del names[x]

    while True:
        tag = found.next(at)
        text(tag[0] if tag else len(page))
        if not tag:
            return _with_blocks(out)
        _, at, ends, name, rest = tag
        if not name:
            continue
        tags += 1
        if name not in _INLINE:
            block += 1
        if name == "br":
            out.append(Piece(" ", 0, around, 0, block))
        if ends:
            if not opened[name]:
                continue
            while open_[-1][0] != name:
                close()
            close()
        elif name in _RAW:
            if name in _FOREIGN and rest.endswith("/"):
                continue
            to = found.inside_end(name, at)
            at = to if to >= 0 else len(page) if name in _TO_THE_END else at
            continue
        elif name in _VOID or rest.endswith("/") or name in _INLINE and name != "a":
            continue
        else:
            if name in _ALONE and open_ and open_[-1][0] == name:
                close()
            own = _names(name, rest)
            own = own if known is None else [x if x in known or x == "a" else "*" for x in own]
            open_.append((name, own))
            opened[name] += 1
            names.update(own)
        changed = True


class Model:
    """Weights of features around a word, of any word, and of a tag. Names without a weight count for nothing."""

    def __init__(self, weights: dict[str, float], word: float, tag: float):
        self.weights, self.word, self.tag = weights, word, tag

    def of(self, p: Piece) -> float:
        # in the order of names: sums must not depend on the order of a set
        return self.word + sum(self.weights[x] for x in sorted(told(p, self.weights)))


def told(p: Piece, known) -> list[str]:
    """The known features of a piece: those of its block only if no name around it is telling."""
    names = [x for x in p.features if x in known]
    if any(x in _TELLING or x[0] in ".@" for x in names):
        return names
    return names + [x for x in p.about if x in known]


def best_run(tags: list[float], words: list[float]) -> tuple[int, int, float]:
    """The first and last piece of the contiguous run with the greatest sum, and that sum, in one scan; words[i] is what piece i scores, tags[i] what
    the tags before it cost, which count inside a run only. The last is before the first where nothing scores above zero."""
    best = total = 0.0
    start, first, last = 0, 0, -1
    for i, (cost, score) in enumerate(zip(tags, words)):
        total += cost
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i
    return first, last, best


def extract(page: str | None, model: Model) -> str:
    """The main text: blocks joined by an empty line, white space within a block as one space. Null and empty pages have none."""
    if not page:
        return ""
    found = pieces(page, model.weights)
    known: dict[tuple, float] = {}
    scores = []
    for p in found:
        key = p.features, p.about
        if key not in known:
            known[key] = model.of(p)
        scores.append(known[key])
    first, last, _ = best_run([model.tag * p.tags for p in found], [max(x, -CLUTTER) * p.words for x, p in zip(scores, found)])
    blocks: list[list[str]] = []
    at = None
    for i in range(first, last + 1):
        if scores[i] > 0:
            if found[i].block != at:
                at = found[i].block
                blocks.append([])
            blocks[-1].append(found[i].text)
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def labelled_pages(n: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[str, bool]]]]:
    """Made-up pages of varied layout: (html, the words with whether each belongs to the main text). Words are unique numbers, so
    that a page's pieces find their labels. The article stands in an element that says so, in a div or table cell of any name,
    in the body, or in no element at all; clutter has a telling name, or only its links and short lines."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    any_name = lambda: "".join(pick(["ba", "do", "ki", "lu", "mer", "nos", "pra", "stu", "vel", "xo"]) for _ in range(int(rng.integers(2, 4))))
    other = [("nav", ""), ("nav", ' class="menu"'), ("header", ""), ("header", ' class="top"'), ("footer", ""), ("aside", ""), ("aside", ' class="sidebar"'), ("form", ""), ("form", ' class="newsletter"'), ("div", ' class="ad"'), ("div", ' class="ads banner"'), ("div", ' class="advert sponsored"'), ("div", ' id="cookie" class="notice"'), ("div", ' class="cookie consent notice banner"'), ("div", ' class="sidebar"'), ("div", ' class="menu"'), ("div", ' id="comments"'), ("section", ' class="comments"'), ("div", ' class="comment"'), ("ul", ' class="menu"'), ("div", ' class="related"'), ("div", ' class="share social"'), ("div", ' class="footer"'), ("div", ' class="header"'), ("div", ' class="promo"'), ("div", ' class="newsletter subscribe"'), ("div", ' role="navigation"'), ("div", ' role="banner"'), ("div", ' role="complementary"'), ("div", ' class="breadcrumb"'), ("div", ' class="popup modal"'), ("div", ' class="disclaimer alert"'), ("div", ' class="warning"'), ("button", ""), ("ol", ' class="comments"'), ("div", ' class="nav"'), ("dialog", ""), ("div", ' class="tags"'), ("div", ' class="login"')]
    main = [("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main" class="article"'), ("div", ' class="post"'), ("div", ' class="story"'), ("div", ' class="entry content"'), ("section", ""), ("div", ' class="body text"'), ("article", ' class="post"')]
    out = []
    for _ in range(n):
        words: list[tuple[str, bool]] = []

        def say(k: int, own: bool, stop: bool = False) -> str:
            new = [f"w{len(words) + i}x" for i in range(k)]
            if stop:
                new = [w + "." if i == k - 1 or i % 11 == 10 else w for i, w in enumerate(new)]
            words.extend((w, own) for w in new)
            return " ".join(new)

        def links() -> str:
            """Clutter that only its links and short lines give away."""
            inside = "".join(pick([f"<li><a href='#'>{say(int(rng.integers(1, 4)), False)}</a></li>", f"<a href='#'>{say(int(rng.integers(1, 3)), False)}</a> "]) for _ in range(int(rng.integers(3, 9))))
            return f"<{pick(['ul', 'div'])} class=\"{any_name()}\">{inside}</div>" if rng.random() < 0.5 else f"<ul>{inside}</ul>"

        def clutter() -> str:
            if rng.random() < 0.2:
                return links()
            name, rest = pick(other)
            inner = "".join(pick([f"<li><a href='#'>{say(int(rng.integers(1, 3)), False)}</a></li>", f"<p>{say(int(rng.integers(3, 45)), False, True)}</p>", say(int(rng.integers(2, 15)), False), f"<span>{say(3, False)}</span>", f"<h3>{say(2, False)}</h3>", f"<div class='{any_name()}'><p>{say(int(rng.integers(3, 30)), False, True)}</p></div>"]) for _ in range(int(rng.integers(1, 6))))
            return f"<{name}{rest}>{inner}</{name}>"

        def content() -> str:
            return pick([lambda: f"<p>{say(int(rng.integers(5, 80)), True, True)}</p>", lambda: f"<p>{say(int(rng.integers(1, 9)), True)}</p>", lambda: f"<div>{say(int(rng.integers(12, 60)), True, True)}</div>", lambda: f"<p><b>{say(9, True)}</b> {say(20, True, True)}</p>", lambda: f"<h2>{say(4, True)}</h2>", lambda: f"<ul><li>{say(6, True)}</li><li>{say(8, True)}</li></ul>", lambda: f"<ol><li>{say(3, True)}</li><li>{say(12, True, True)}</li></ol>", lambda: f"<blockquote>{say(15, True, True)}</blockquote>", lambda: f"<pre>{say(int(rng.integers(3, 40)), True)}</pre>", lambda: f"<figure><figcaption>{say(6, True)}</figcaption></figure>", lambda: f"<p>{say(5, True)} <a href='#'>{say(2, True)}</a> {say(7, True, True)}</p>", lambda: f"<table><tr><td>{say(2, True)}</td><td>{say(3, True)}</td></tr></table>"])()

        if rng.random() < 0.04:  # plain text
            out.append((say(int(rng.integers(20, 200)), True, bool(rng.random() < 0.7)), words))
            continue
        kind = rng.random()
        if kind < 0.45:
            name, rest = pick(main)
        elif kind < 0.8:
            name, rest = pick(["div", "div", "section", "td"]), pick(["", f' class="{any_name()}"', f' id="{any_name()}"'])
        else:
            name, rest = "", ""
        page = "<html><body>" + "".join(clutter() for _ in range(int(rng.integers(0, 4)))) + (f"<table><tr><td>" if name == "td" else "") + (f"<{name}{rest}>" if name else "") + (f"<h1>{say(5, True)}</h1>" if rng.random() < 0.8 else "")
        if rng.random() < 0.1:
            page += "<br><br>".join(say(int(rng.integers(20, 60)), True, True) for _ in range(int(rng.integers(1, 4))))
        for _ in range(int(rng.integers(1, 9))):
            page += clutter() if rng.random() < 0.2 else content()
        page += f"<p>{say(int(rng.integers(20, 60)), True, True)}</p>" + (f"</{name}>" if name else "") + ("</tr></table>" if name == "td" else "") + "".join(clutter() for _ in range(int(rng.integers(0, 4)))) + "</body></html>"
        out.append((page, words))
    return out


def train(pages: list[tuple[str, list[tuple[str, bool]]]] | None = None, rounds: int = 12) -> Model:
    """Logistic regression of a word's label on the features around it, by Newton steps; a tag costs little, so that only its words'
    own scores can outweigh it."""
    found = [(pieces(page), {w for w, mine in words if mine}) for page, words in pages or labelled_pages()]
    on: dict[str, int] = {}
    for own, _ in found:
        for x in set().union(*(p.features | p.about for p in own)):
            on[x] = on.get(x, 0) + 1
    place = {x: i for i, x in enumerate(sorted(x for x, n in on.items() if n >= LEAST_PAGES))}
    counts: dict[tuple, list[int]] = {}
    for own, mine in found:
        for p in own:
            key = tuple(sorted(told(p, place)))
            for w in p.text.split():
                counts.setdefault(key, [0, 0])[w in mine] += 1
    keys = sorted(counts)
    x = np.zeros((len(keys), len(place) + 1))
    x[:, -1] = 1
    for i, k in enumerate(keys):
        x[i, [place[f] for f in k]] = 1
    n = np.array([counts[k] for k in keys], float)
    total, share = np.sqrt(n.sum(axis=1)), n[:, 1] / n.sum(axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (total * (p - share)) + w
        bend = (x * (total * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return Model(dict(zip(place, w[:-1].tolist())), float(w[-1]), -0.002)


def main_text(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """rows(html, ...) with text, the main text of each page, and n_chars, its code points; columns of these names are replaced.

    A null or empty page, or one without text, has an empty text. Repeated rows come out as often as they came in. Of runs with
    equal sums the first is taken. A very long page is worked on alone, and whole."""
    held = rows.sparkSession.sparkContext.broadcast(model or train())
    rows = rows.select(*[c for c in rows.columns if c not in ("text", "n_chars")])
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(x.as_py(), held.value) for x in part.column("html")]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
