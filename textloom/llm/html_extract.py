"""Main-text extraction by maximum-scoring subsequence.

A page is read as a sequence of words and tags.  A word scores by its context: inside a boilerplate element or not, inside
a link or not, the kind of its block, and its place, that is inside an ``article``, ``main`` or content-named element,
outside of those the page has, or on a page without any.  A tag scores negative by its name.  One linear scan finds the
contiguous region of the highest sum.  The weights are log-odds counted on labelled pages: pages that mark their content
with ``article``, at most ``max_train`` of them (those with the smallest hash of their id), words inside being content; each
is counted once as it is and once as if it had no such element, which gives the weights of pages without one.

The region then grows to an element, so that no block of the article is lost at an end: of the elements that hold all of
it, the one whose own score without boilerplate elements is highest.  Its boilerplate elements (menus, page headers,
footers, asides, forms, adverts, notices, comments ..., by their tag or by a class, id or role all of whose words say so)
are left out.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones are left
out, and the rest is joined by blank lines in page order.  Nothing else is dropped and nothing is capped: text in ``svg``,
``math`` and ``noscript`` stays, and these, form controls and unknown inline elements don't end a block.

Defined results: null, empty or contentless html gives the empty text; markup cut off in the middle of a tag loses that
tag; html without tags is one block; repeated rows are separate pages; null page_id or url pass through; without a
labelled page the default weights hold.  Scoring is one narrow pass; time is linear in the page's length.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|([^<]+|<)", re.S)
# fixed values: element names of HTML, and words of class names
RAW = {"script", "style", "textarea", "title", "template", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTROL = {"select", "option", "optgroup", "button", "datalist", "textarea", "output", "progress", "meter"}
INLINE = CONTROL | {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "math", "noscript", "object", "picture",
                    "q", "rp", "rt", "ruby", "s", "samp", "script", "small", "source", "span", "strike", "strong", "style", "sub", "sup", "svg", "template", "time", "tt", "u", "var", "wbr"}
BAD = {"nav", "footer", "aside", "form", "menu", "dialog", "head"} | CONTROL
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "option"}  # end tags are often left out
KNOWN = RAW | VOID | INLINE | BAD | LOOSE | {"html", "body", "div", "article", "main", "section", "header", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "caption", "tfoot", "figure", "figcaption",
                                             "blockquote", "pre", "address", "details", "summary", "fieldset", "legend", "audio", "video", "canvas", "hgroup"}
BAD_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars side comment comments commentlist reply replies respond disqus cookie cookies consent gdpr "
                "notice notices alert alerts popup modal overlay newsletter subscribe signup login search menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related "
                "recommended widget widgets toolbar pagination pager complementary contentinfo".split())
FILL_WORDS = set("site page top main left right primary secondary box block area section wrap wrapper container list inner links items item form posts post articles article global bottom bar panel mobile desktop "
                 "sticky fixed small js latest more popular user reader blog web".split())
HOME_FIRST, HOME_LAST = {"article", "post", "entry", "story", "main", "page"}, {"body", "content", "text"}
NAME = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?<![^\s])hidden(?=[\s=]|\Z)", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")


def kind(tag: str) -> str:
    return tag if tag in ("p", "li") else "h" if re.fullmatch(r"h[1-6]", tag) else "other"


def named(names: str) -> tuple[bool, bool, bool]:
    """(boilerplate, page header, content) of class, id and role values: each is split at white space and read as a whole."""
    bad = head = home = False
    for token in names.split():
        x = [w.lower() for w in PARTS.findall(token)]
        own = [w for w in x if w not in FILL_WORDS]
        bad |= bool(own) and all(w in BAD_WORDS for w in own)
        head |= own == ["header"]
        home |= x in (["content"], ["articlebody"], ["maintext"]) or len(x) == 2 and x[0] in HOME_FIRST and x[1] in HOME_LAST
    return bad, head, home


@dataclass(slots=True)
class Token:
    """A tag (text is None) or a text."""

    name: str
    text: str | None
    bad: bool
    link: bool = False
    shape: str = ""
    inside: bool = False  # of an article, main or content-named element
    marked: bool = False  # inside of an article
    block: int = 0
    element: int = 0

    def context(self, place: str) -> str:
        return f"{'bad' if self.bad else 'ok'}|{int(self.link)}|{self.shape}|{place}"


@dataclass
class Page:
    tokens: list[Token] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])  # of each element; 0 is the page
    begin: list[int] = field(default_factory=lambda: [0])  # its tokens: [begin, end)
    end: list[int] = field(default_factory=lambda: [0])
    home: bool = False

    def place(self, t: Token) -> str:
        return "in" if t.inside else "out" if self.home else "none"


def parse(page: str) -> Page:
    out = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # name, element, bad, home
    block, shape, pos, known = 0, "other", 0, {}
    bad = link = homes = articles = svg = 0
    while m := TOKEN.match(page, pos):
        pos = m.end()
        if m[5] is not None:
            out.tokens.append(Token("", m[5], bad > 0, link > 0, shape, homes > 0, articles > 0, block, stack[-1][1] if stack else 0))
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if not m[4]:
            break  # cut off inside a tag
        breaks = name not in INLINE and not svg
        if m[1]:
            out.tokens.append(Token(name, None, bad > 0, block=block))
            if any(x[0] == name for x in stack):
                while stack:
                    top, element, was_bad, home = stack.pop()
                    out.end[element] = len(out.tokens)
                    bad -= was_bad
                    link -= top == "a"
                    homes -= home
                    articles -= top == "article"
                    svg -= top in ("svg", "math")
                    if top == name:
                        break
            if breaks:
                block, shape = block + 1, "other"
            continue
        if breaks:
            block, shape = block + 1, kind(name)
        at = len(out.tokens)
        out.tokens.append(Token(name, None, bad > 0, block=block))
        closed = m[3].rstrip().endswith("/")
        if name in RAW and not closed and not (svg and name == "title"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name in VOID or name in LOOSE or closed:
            continue
        values = " ".join(x[1] or x[2] or x[3] or "" for x in NAME.finditer(m[3]))
        if values not in known:
            known[values] = named(values)
        by_name, head, content = known[values]
        whole = name in ("html", "body")
        home = not bad and not by_name and not head and (name in ("article", "main") or content and name in ("div", "section"))
        is_bad = not whole and (name in BAD or by_name and not home or (name == "header" or head) and not homes or HIDDEN.search(NAME.sub("", m[3])) is not None)
        out.home |= home
        link += name == "a"
        bad += is_bad
        homes += home
        articles += name == "article"
        svg += name in ("svg", "math")
        out.parent.append(stack[-1][1] if stack else 0)
        out.begin.append(at)
        out.end.append(at)
        stack.append((name, len(out.parent) - 1, is_bad, home))
    for _, element, _, _ in stack:
        out.end[element] = len(out.tokens)
    out.end[0] = len(out.tokens)
    return out


def tag_class(name: str) -> str:
    return "<" + (name if name in KNOWN else "other")


def count_tokens(page: str) -> Counter:
    """(content?, token class) counts of a labelled page, with its article and as if it had none."""
    out: Counter = Counter()
    x = parse(page)
    for t in x.tokens:
        if t.text is None:
            out[t.name != "article" and not t.bad, tag_class(t.name)] += 1
        elif n := len(t.text.split()):
            for place in (x.place(t), "none"):
                out[t.marked and not t.bad, t.context(place)] += n
    return out


def weigh(counts: dict[tuple[bool, str], float]) -> dict[str, float]:
    """Log-odds per token class: words at most 3 either way, by place; tags from -2 to -0.05."""
    group = lambda k: "<" if k[0] == "<" else k.rsplit("|", 1)[1] == "none"
    total: Counter = Counter()
    for (side, k), v in counts.items():
        total[side, group(k)] += v
    out = {}
    for k in {k for _, k in counts}:
        g = group(k)
        x = math.log((counts.get((True, k), 0) + 0.5) / (total[True, g] + 1)) - math.log((counts.get((False, k), 0) + 0.5) / (total[False, g] + 1))
        out[k] = max(-2.0, min(-0.05, x)) if k[0] == "<" else max(-3.0, min(3.0, x))
    return out


def default_weight(context: str) -> float:
    bad, link, shape, place = context.split("|")
    if bad == "bad" or link == "1" or place == "out":
        return -0.5
    return {"p": 1.0, "h": 0.8}.get(shape, 0.3)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[a, b) of the contiguous run of the highest sum; empty if no score is positive.  Ties: the first and shortest."""
    best, here, start, a, b = 0.0, 0.0, 0, 0, 0
    for i, x in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += x
        if here > best:
            best, a, b = here, start, i + 1
    return a, b


def scores_of(page: Page, weights: dict[str, float]) -> list[float]:
    out = []
    for t in page.tokens:
        if t.text is None:
            out.append(weights.get(tag_class(t.name), -0.3))
        else:
            context = t.context(page.place(t))
            out.append(len(t.text.split()) * (weights[context] if context in weights else default_weight(context)))
    return out


def element_of(page: Page, first: int, last: int, scores: list[float]) -> int:
    """Of the elements that hold the tokens first .. last, the one with the highest score outside of boilerplate; of ties the innermost."""
    sums = [0.0]
    for t, x in zip(page.tokens, scores, strict=True):
        sums.append(sums[-1] + (0.0 if t.bad else x))
    here = page.tokens[first].element
    while page.end[here] <= last:
        here = page.parent[here]
    best, top = here, sums[page.end[here]] - sums[page.begin[here]]
    while here:
        here = page.parent[here]
        x = sums[page.end[here]] - sums[page.begin[here]]
        if x > top + 1e-9:
            best, top = here, x
    return best


def extract(html: str | None, weights: dict[str, float]) -> str:
    page = parse(html or "")
    scores = scores_of(page, weights)
    a, b = best_region(scores)
    region = [i for i in range(a, b) if (t := page.tokens[i]).text is not None and not t.bad and t.text.strip()]
    if not region:
        return ""
    element = element_of(page, region[0], region[-1], scores)
    blocks: dict[int, list[str]] = {}
    for t in page.tokens[page.begin[element]: page.end[element]]:
        if t.text is not None and not t.bad:
            blocks.setdefault(t.block, []).append(t.text)
        elif t.name == "br" and t.block in blocks:
            blocks[t.block].append(" ")
    out = (" ".join(htmllib.unescape("".join(x)).split()) for x in blocks.values())
    return "\n\n".join(x for x in out if x)


def train(pages: DataFrame, max_train: int = 2000) -> dict[str, float]:
    """Weights of the token classes from at most ``max_train`` pages with an ``article``; none without such a page.

    Classes are contexts and the names of known elements, so their number is bounded by the code, not by the pages.
    Null html and page_id are not learned from; repeated page_ids may each be counted.
    """
    ids = pages.where(F.lower("html").contains("<article")).select("page_id").where("page_id is not null")
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(max_train)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for x in b["html"]:
                c.update(count_tokens(x or ""))
        yield pd.DataFrame([(bool(s), k, v) for (s, k), v in c.items()], columns=["content", "k", "n"])

    rows = pages.select("page_id", "html").join(F.broadcast(ids), "page_id").mapInPandas(count, "content boolean, k string, n long")
    got = {(r[0], r[1]): float(r[2]) for r in rows.groupBy("content", "k").agg(F.sum("n").alias("n")).collect()}
    return weigh(got) if got else {}


def html_extract(pages: DataFrame, weights: dict[str, float], html: str = "html", out: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series([extract(x, weights) for x in s], dtype=object)

    return pages.withColumn(out, udf(F.col(html)))


def op6_html_extraction(spark, sf_dir):
    from textloom.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    got = html_extract(pages, train(pages))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
