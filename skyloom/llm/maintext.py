"""Main text of HTML pages by maximum-scoring subsequence.

A page is cut into tokens: words, and tags. Every token has a score: words are positive, tags negative, each by the kind of block it
stands in (paragraph, heading, list item, link, ... ; tag kinds likewise) and by its state: on a page that marks an article
(article, main, or such a role) inside or outside of it, else neither. A linear scan finds the contiguous run of tokens with
the largest sum, which is the page's main region. The scores are log odds of standing in the main text, fitted on
labelled pages (labelled_pages below: a seeded generator of layouts, whose main text is known).

Boilerplate also stands inside an article (adverts, reader comments, ...), where no contiguous run can leave it out. So elements
that carry a name (class, id, role, aria-label) or a structural tag are judged first, by a logistic model fitted on the same
labelled pages: of their tag, the words of their names (a name that is one such word tells more than a name with one in it), their
number of words, their share of linked words, and whether they hold a heading or the article. Judged boilerplate is left out of
the scan and of the text. What is no text by definition (scripts, styles, form controls, hidden elements, the head) always is.

The text of the region: character references decoded, white space inside a block turned into one space and trimmed, blocks
joined by \\n in page order. Whole pages are read; nothing is capped.

Cases: null or empty html, or a page without words outside such elements, gives an empty text. Broken markup (unclosed or
stray tags, a cut page) is read as browsers do, roughly: a stray end tag is ignored, open elements end with their parent.
Null urls are returned as null; repeated rows give a row each; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import arrow_schema, released

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
NEVER = frozenset("form button select menu dialog fieldset datalist audio video map head".split()) | RAW
STRUCTURAL = frozenset("nav header footer aside".split())
BLOCKS = frozenset("address article blockquote body br center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption".split())
#: Elements that a new one of these closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {x: {"p"} for x in "article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: A name that begins with one of these tells of a page's layout.
LAYOUT = frozenset("has with no without".split())
WANTED = frozenset("article main".split())
#: Elements that tell words apart. Fixed values.
KINDS = frozenset("p h1 h2 h3 h4 h5 h6 li a td th pre blockquote dd dt div section article main span br b i em strong table ul ol tr body".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(maxsize=4096)
def named(attributes: str) -> tuple[bool, bool, frozenset[str]]:
    """Whether an element is hidden, whether it is marked as the article, and the features of its names."""
    hidden = marked = False
    features: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "style" and _HIDE.search(value):
            hidden = True
        elif name == "itemprop":
            marked |= value.lower() == "articlebody"
        elif name != "style":
            for one in value.split():
                words = _NAME.findall(_HUMP.sub(" ", one).lower())
                marked |= name == "role" and one.lower() in WANTED
                if len(words) == 1:
                    features.add("is:" + words[0])
                elif words and words[0] in LAYOUT:
                    features.add("layout")
                else:
                    features.update("part:" + w for w in words)
    return hidden, marked, frozenset(features)


@dataclass(slots=True)
class Element:
    """tag and features of its names; its tokens are those from start up to end. marked: the page marks it as the article; within: an element that it stands in."""

    tag: str
    names: frozenset[str]
    start: int
    end: int
    marked: bool
    within: bool

    @property
    def judged(self) -> bool:
        return bool(self.names) or self.tag in STRUCTURAL


class Page:
    """A page's tokens outside elements that are never text: (kind, text) of text runs and (kind, None) of tags, in page order.

    kind of a text is that of its nearest telling element; block[i] numbers the block a text stands in; article[i] tells
    whether it stands in a marked element; elements are those that judging looks at, in page order.
    """

    def __init__(self, html: str):
        self.kind: list[str] = []
        self.text: list[str | None] = []
        self.block: list[int] = []
        self.article: list[bool] = []
        self.elements: list[Element] = []
        # tag, whether inside what is never text, whether inside a marked element, the kind of words here, the element.
        stack: list[tuple[str, bool, bool, str, Element | None]] = []
        block = at = 0
        lower = html.lower()
        if len(lower) != len(html):
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), html)
        never, inside, here = False, False, "other"

        def add(kind: str, text: str | None) -> None:
            self.kind.append(kind)
            self.text.append(text)
            self.block.append(block)
            self.article.append(inside)

        def close(depth: int) -> None:
            nonlocal never, inside, here
            for *_, element in stack[depth:]:
                if element:
                    element.end = len(self.kind)
            del stack[depth:]
            never, inside, here = stack[-1][1:4] if stack else (False, False, "other")

        while True:
            m = _TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text and not never:
                add(here, entities.unescape(text))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in BLOCKS:
                block += 1
            if m[1]:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if depth >= 0:
                    close(depth)
            else:
                closes = CLOSES.get(tag, ())
                depth = len(stack)
                while depth and stack[depth - 1][0] in closes:
                    depth -= 1
                if depth < len(stack):
                    close(depth)
                if tag in RAW:
                    end = lower.find("</" + tag, at)
                    after = html.find(">", end) if end >= 0 else -1
                    at = after + 1 if after >= 0 else len(html)
                    continue
                if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
                    hidden, marked, names = named(m[3]) if m[3] else (False, False, frozenset())
                    never = never or hidden or tag in NEVER
                    marked = marked or tag in WANTED
                    element = Element(tag, names, len(self.kind), 0, marked, inside) if not never and (names or marked or tag in STRUCTURAL) else None
                    if element:
                        self.elements.append(element)
                    inside, here = inside or marked, tag if tag in KINDS else here
                    stack.append((tag, never, inside, here, element))
            if not never:
                add("<" + (tag if tag in KINDS else "other"), None)
        close(0)

    def features(self) -> list[list[str]]:
        """What judging looks at, of each element."""
        words = list(itertools.accumulate((len(t.split()) if t else 0 for t in self.text), initial=0))
        linked = list(itertools.accumulate((len(t.split()) if t and k == "a" else 0 for t, k in zip(self.text, self.kind, strict=True)), initial=0))
        heads = list(itertools.accumulate((k == "<h1" if t is None else 0 for t, k in zip(self.text, self.kind, strict=True)), initial=0))
        marks = list(itertools.accumulate((e.marked for e in self.elements), initial=0))
        starts = [e.start for e in self.elements]
        out = []
        for i, e in enumerate(self.elements):
            n = words[e.end] - words[e.start]
            share = (linked[e.end] - linked[e.start]) / n if n else 0.0
            own = ["bias", ("in:" if e.within else "tag:") + e.tag, f"words:{min(6, int(math.log(1 + n, 3)))}", f"links:{math.ceil(share * 4)}", *e.names]
            if heads[e.end] > heads[e.start]:
                own.append("title")
            if marks[bisect.bisect_left(starts, e.end, i + 1)] > marks[i + 1]:
                own.append("holds article")
            out.append(own)
        return out


# What the labelled pages are made of. Names in common use, by what they stand for. A space parts the words of a name.
BOILERPLATE = {
    "links": [("nav div ul section", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar toolbar tabs,main menu,site nav,nav menu,page nav,post navigation,menu list"), ("div ul section p aside", "share sharing social related recommended trending popular tags,social links,share buttons,related posts,related articles,more stories,read next,follow us,link list")],
    "short": [("header div", "header masthead banner logo,site header,page header,top banner,site title"), ("footer div p", "footer foot copyright legal disclaimer colophon contentinfo,site footer,page footer,footer widgets"), ("div section p aside span", "ad ads advert advertisement adverts advertising adbox sponsor sponsored promo promoted promotion,ad slot,ad box,banner ad,sponsored content,promo box,ad container"), ("div section p aside", "cookie cookies consent gdpr notice notices alert popup modal overlay skip hidden,cookie banner,cookie notice,consent bar,alert box,site notice,skip link"), ("div section", "newsletter subscribe subscription signup login search paywall,newsletter box,sign up,search box,subscribe form,search results")],
    "teasers": [("aside div section", "sidebar sidebars side aside widget widgets rail complementary related recommended,side bar,widget area,left sidebar,sidebar right,related posts,right rail,more stories,sidebar widget")],
    "prose": [("div section ol ul article li", "comment comments commentlist reply replies respond responses disqus feedback discussion,comment list,comment body,comment text,comment content,reader comments,comments area,comment thread,user comments"), ("aside div", "sidebar aside widget,text widget,author bio box,sidebar text")],
}
CONTENT = "content entry post story text page container wrapper row column hentry lead intro summary section chapter note quote figure caption example byline author date title subtitle paragraph body primary inner block,main content,entry content,post content,post body,article body,story body,body text,article text,page content,content area,site content,content wrapper,text block,section title,post title,entry title,article header,lead paragraph,article section"


def labelled_pages(n: int = 700, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """Seeded pages of many layouts, and the words of their main text (words are unique to it)."""
    rng = random.Random(seed)
    word = itertools.count()
    listed = lambda names: [x for i, part in enumerate(names.split(",")) for x in (part.split() if not i else [part])]
    unwanted = sorted({w for kinds in BOILERPLATE.values() for _, names in kinds for x in listed(names) for w in x.split()})
    wanted = listed(CONTENT)

    def prose(k: int, own: set[str] | None, linked: float = 0.02) -> str:
        out = []
        for i in range(k):
            w = f"w{next(word)}"
            if own is not None:
                own.add(w)
            draw = rng.random()
            out.append(f'<a href="/{i}">{w}</a>' if draw < linked else f"<{t}>{w}</{t}>" if draw < linked + 0.03 and (t := rng.choice(["b", "em", "strong", "i"])) else w)
        return " ".join(out)

    def rare() -> str:
        return f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}"

    def attribute(name: str) -> str:
        """A name as pages write it: among others, or as an id."""
        words = name.split()
        if rng.random() < 0.07:
            words.insert(rng.choice([0, len(words)]), rare())
        joined = rng.choice(["-", "-", "_", ""]).join(words) if len(words) == 1 or rng.random() < 0.7 else words[0] + "".join(w.title() for w in words[1:])
        more = "".join(f" {rng.choice(['x', 'js', 'u', 'is', 'c'])}-{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(rng.choice([0, 0, 1])))
        more += rng.choice(["", "", f" {rng.choice(['no', 'has', 'with'])}-{rng.choice(unwanted)}"])
        return f'{rng.choice(["class", "class", "class", "id"])}="{joined}{more}"'

    def links(k: int, lead: str = "") -> str:
        return lead + "<ul>" + "".join(f'<li><a href="/{i}">{prose(rng.randint(1, 4), None)}</a></li>' for i in range(k)) + "</ul>"

    def filled(kind: str) -> str:
        if kind == "links":
            return links(rng.randint(2, 10), rng.choice(["", "", f"<{rng.choice(['h2', 'h3'])}>{prose(2, None)}</h3>"])) if rng.random() < 0.7 else " | ".join(f"<a href='/{i}'>{prose(rng.randint(1, 3), None)}</a>" for i in range(rng.randint(1, 6)))
        if kind == "short":
            return prose(rng.randint(2, 25), None, rng.choice([0.0, 0.0, 0.3]))
        if kind == "teasers":
            return "".join(f"<h3>{prose(rng.randint(2, 5), None, 0.9)}</h3><p>{prose(rng.randint(4, 25), None)}</p>" for _ in range(rng.randint(1, 6)))
        return "".join(f"<p>{prose(rng.randint(2, 40), None)}</p>" for _ in range(rng.randint(1, 5)))

    def boilerplate() -> str:
        kind = rng.choice(["links", "short", "short", "teasers", "prose"])
        tags, names = rng.choice(BOILERPLATE[kind])
        tag = rng.choice(tags.split())
        if tag in ("nav", "header", "footer", "aside") and rng.random() < 0.5:
            return f"<{tag}>{filled(kind)}</{tag}>"
        held = filled(rng.choice([kind, kind, "prose"]))
        if tag in ("header", "div") and rng.random() < 0.1:
            held = f"<h1>{prose(rng.randint(1, 3), None)}</h1>{held}"
        return f"<{tag} {attribute(rng.choice(listed(names)))}>{held if tag not in ('p', 'span') else prose(rng.randint(2, 40), None)}</{tag}>"

    def maybe_named(tag: str, text: str) -> str:
        """Content, now and then under a name that holds a word of boilerplate among others."""
        draw = rng.random()
        if draw < 0.65:
            return f"<{tag}>{text}</{tag}>"
        if draw < 0.8:
            return f"<{tag} {attribute(rng.choice([*wanted, *(rare() for _ in wanted)]))}>{text}</{tag}>"
        name = [*(rare() for _ in range(rng.randint(1, 2))), rng.choice(unwanted)]
        rng.shuffle(name)
        return f'<{tag} class="{"-".join(name)}">{text}</{tag}>'

    for _ in range(n):
        own: set[str] = set()
        body = []
        for _ in range(rng.randint(1, 9)):
            kind = rng.choices(["p", "h2", "ul", "blockquote", "pre", "table", "div", "section"], [10, 2, 1.5, 1, 0.5, 0.5, 3, 2])[0]
            if kind == "ul":
                body.append(maybe_named("ul", "".join(f"<li>{prose(rng.randint(3, 14), own)}</li>" for _ in range(rng.randint(2, 5)))))
            elif kind == "table":
                body.append(maybe_named("table", "".join("<tr>" + "".join(f"<td>{prose(rng.randint(1, 4), own)}</td>" for _ in range(3)) + "</tr>" for _ in range(3))))
            elif kind in ("div", "section"):
                body.append(maybe_named(kind, prose(rng.randint(2, 30), own) if rng.random() < 0.4 else "".join(f"<p>{prose(rng.randint(4, 40), own)}</p>" for _ in range(rng.randint(1, 4)))))
            else:
                body.append(maybe_named(kind, prose(rng.randint(2, 6) if kind == "h2" else rng.randint(4, 60), own)))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            body.insert(rng.randint(0, len(body)), boilerplate())
        title = f"<h1>{prose(rng.randint(2, 9), own)}</h1>" if rng.random() < 0.8 else ""
        box = rng.choice(["div", "section", "div", "article", "main", "article"])
        if title and box in ("article", "main") and rng.random() < 0.3:
            title = f"<header>{title}{rng.choice(['', '<p>' + prose(4, own) + '</p>'])}</header>"
        whole = maybe_named(box, title + "".join(body)) if rng.random() < 0.5 else f"<{box} {attribute(rng.choice(wanted))}>{title}{''.join(body)}</{box}>"
        before = rng.choice([links(rng.randint(3, 12)), f"<div>{links(rng.randint(3, 9))}</div>", f"<div><a href='/'>{prose(2, None)}</a> <a href='/x'>{prose(1, None)}</a></div>", ""])
        after = rng.choice([f"<div>{prose(rng.randint(2, 8), None)}</div>", f"<div>{links(rng.randint(3, 10))}<span>{prose(4, None)}</span></div>", f"<div><a href='/a'>{prose(2, None)}</a><br><a href='/b'>{prose(2, None)}</a></div>", ""])
        before += "".join(boilerplate() for _ in range(rng.choice([0, 1, 2, 3])))
        after = "".join(boilerplate() for _ in range(rng.choice([0, 1, 2, 3, 5]))) + after
        inner = f"{before}{whole}{after}"
        if rng.random() < 0.4:
            inner = f"<div {attribute(rng.choice(['page', 'container', 'wrapper', 'site content', 'content sidebar wrap', 'main', 'layout', 'row']))}>{inner}</div>"
        yield f"<html><body{rng.choice(['', ' class=has-sidebar', ' class=page'])}>{inner}</body></html>", own


@dataclass(frozen=True)
class Weights:
    """judging: log odds of boilerplate of an element's features; words: scores of words and tags by kind."""

    judging: dict[str, float]
    words: dict[str, float]


def _logistic(rows: list[list[str]], is_boilerplate: list[bool], dear: float = 3.0, ridge: float = 0.3, rounds: int = 12) -> dict[str, float]:
    """Weights of features met three times at least (rarer names are "is:?" and "part:?"), by Newton's method with a penalty of
    `ridge` on their squares. Text that is lost weighs `dear` times as much as boilerplate that stays."""
    met: dict[str, int] = {}
    for r in rows:
        for f in r:
            met[f] = met.get(f, 0) + 1
    names = ["is:?", "part:?", *sorted(f for f, n in met.items() if n >= 3)]
    place = {f: i for i, f in enumerate(names)}
    x, y = np.zeros((len(rows), len(names))), np.array(is_boilerplate, float)
    for i, r in enumerate(rows):
        for f in r:
            at = place.get(f, place.get(f.split(":")[0] + ":?"))
            if at is not None:
                x[i, at] += 1.0
    cost, w = np.where(y > 0, 1.0, dear), np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names)), x.T @ (cost * (y - p)) - ridge * w)
    return {f: round(float(v), 6) for f, v in zip(names, w, strict=True)}


@lru_cache(maxsize=1)
def fitted() -> Weights:
    """The weights fitted on labelled_pages."""
    pages = [(Page(html), own) for html, own in labelled_pages()]
    rows, labels = [], []
    for page, own in pages:
        mine = list(itertools.accumulate((bool(t and set(t.split()) & own) for t in page.text), initial=0))
        some = list(itertools.accumulate((bool(t and t.strip()) for t in page.text), initial=0))
        for e, features in zip(page.elements, page.features(), strict=True):
            if e.judged and some[e.end] > some[e.start]:
                rows.append(features)
                labels.append(mine[e.end] == mine[e.start])
    judging = _logistic(rows, labels)
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}
    for page, own in pages:
        left = kept(page, judging)
        held = [i for i in left if page.text[i] and set(page.text[i].split()) & own]
        lo, hi = min(held, default=0), max(held, default=-1)
        for i, kind in zip(left, kinds(page, left), strict=True):
            side = inside if lo <= i <= hi else outside
            for name in (kind, _unmet(kind)):
                side[name] = side.get(name, 0.0) + (len(page.text[i].split()) if page.text[i] else 1)
    words = {}
    for name in inside.keys() | outside.keys():
        ratio = math.log((inside.get(name, 0.0) + 1) / (outside.get(name, 0.0) + 1))
        words[name] = min(-0.05, ratio) if "<" in name else ratio if name[0] in "+-" or name == "a" else max(0.1, ratio)
    return Weights(judging, words)


def odds(features: list[str], judging: dict[str, float]) -> float:
    """Log odds of boilerplate. Names that were not met count as "is:?" or "part:?", other features not met for nothing."""
    return sum(judging[f] if f in judging else judging.get(f.split(":")[0] + ":?", 0.0) for f in features)


def kept(page: Page, judging: dict[str, float]) -> list[int]:
    """The places of a page's tokens outside elements that are judged boilerplate; what stands in one is not judged again."""
    out: list[int] = []
    at = 0
    for e, features in zip(page.elements, page.features(), strict=True):
        if e.judged and e.start >= at and odds(features, judging) > 0:
            out.extend(range(at, e.start))
            at = e.end
    out.extend(range(at, len(page.kind)))
    return out


def _unmet(kind: str) -> str:
    """What stands for a kind of its state that was never met: "w", "<w", "+w" and so on."""
    return kind.rstrip("abcdefghijklmnopqrstuvwxyz0123456789") + "w"


def kinds(page: Page, left: list[int]) -> list[str]:
    """The kind of each token in `left`, after + inside and - outside of a marked article if one is left."""
    if not any(page.article[i] for i in left):
        return [page.kind[i] for i in left]
    return [("+" if page.article[i] else "-") + page.kind[i] for i in left]


def region(page: Page, left: list[int], words: dict[str, float]) -> tuple[int, int]:
    """The run [lo, hi) of the tokens in `left` with the largest sum of scores; the first of equal ones."""
    best, lo, hi, run, start = 0.0, 0, 0, 0.0, 0
    for k, (i, kind) in enumerate(zip(left, kinds(page, left), strict=True)):
        score = words.get(kind)
        if score is None:
            score = words.get(_unmet(kind), 0.0)
        text = page.text[i]
        run += score if text is None else score * len(text.split())
        if run > best:
            best, lo, hi = run, start, k + 1
        elif run <= 0:
            run, start = 0.0, k + 1
    return lo, hi


def main_text(html: str | None, weights: Weights | None = None) -> str:
    if not html:
        return ""
    weights = weights or fitted()
    page = Page(html)
    left = kept(page, weights.judging)
    lo, hi = region(page, left, weights.words)
    out: list[str] = []
    last = None
    for i in left[lo:hi]:
        text = page.text[i]
        if text is not None:
            if page.block[i] == last:
                out[-1] += text
            else:
                out.append(text)
                last = page.block[i]
    return "\n".join(x for x in (_SPACE.sub(" ", b).strip() for b in out) if x)


RESULT = "page_id long, url string, text string, n_chars long"


def main_texts(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html), and its columns of strings named in `keep`."""
    result = ", ".join([RESULT, *(f"{c} string" for c in keep)])
    weights = fitted()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *part.columns[3:]], schema=arrow_schema(result))

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), *[F.col(c).cast("string") for c in keep]).mapInArrow(released(extract), result)
