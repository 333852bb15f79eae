"""Main text of web pages by consensus of a host's pages.

Each page is parsed into blocks of text, each with the path of its block-level
containers, generalised to tag and classes with digits masked. Blocks below an
element that names itself as furniture (navigation, footers, adverts, comments,
...) are out. A page scores its containers by the text below them that is not
link text. If articles (or main elements) hold most of it, it votes for what
holds them all, whatever is inside; else for the deepest container that holds
nearly all of it. Votes are summed per host and path in Spark; a host's winning
paths are then used to extract every page of the host. A page of which they
hold less than nearly all that its own choice does uses that as well. The clean h1 of a
page is its title and stays wherever it is.

Names count less than structure, and as the first or last word of a class or id
only (not after has, no, with, is, as in has-sidebar). Where no article or main
element is clean, those whose own name or wrapper's name made them furniture (a
page about legal matters, say) are taken after all, and so is every element that
a name made furniture but that holds more than half of the page's text that is
not link text; reader comments never are.

Pages are scanned once from front to end, whatever they hold. A tag that the page
ends in is dropped with the rest of the page, which is inside of it; script and
style without an end tag hold the rest of the page, other elements whose content
is skipped are only skipped where they have one. Elements nested deeper than
``DEPTH`` count to the element at that depth.

Defined results: a null or empty html has an empty text; a null or odd url
counts to one host ''; repeated rows get equal results; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, table

#: Share of a page's clean text from which its articles are all that counts.
HOLDS = 0.6
#: Share of it that any other container must hold; and of a page's own choice, the winners of its host.
KEEPS = 0.95
#: Share of a host's votes from which a path wins (so at most four do).
WINS = 0.25
#: Hosts up to which the table of winners is broadcast.
BROADCAST_HOSTS = 10_000

RAW = {"script", "style", "textarea", "template", "noscript", "svg", "iframe", "object", "title", "select", "canvas", "audio", "video"}
BLOCK = set(
    "html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption nav header footer aside form fieldset address details summary dialog menu center hgroup search".split()
)
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "pre", "caption", "summary"}
#: Elements that are furniture by their tag; a header inside an article is its title.
FURNITURE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "head", "search", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu"}
NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header footer foot sidebar side aside widget ad ads advert adverts advertisement advertising "
    "banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "form search share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies pager pagination "
    "copyright legal toolbar".split()
)

#: What reader comments are called by the first word of a class or id.
READERS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
#: Words before a name that make it a property of something else, and after it.
BEFORE, AFTER = {"has", "no", "not", "with", "without", "is", "non", "hide", "show"}, {"free", "less", "open", "closed", "fixed", "hidden", "visible", "page", "layout"}
#: Share of a page's text from which an element is no furniture, whatever its name.
MOST = 0.5
#: Score of a section beside the articles, as a share of theirs, from which it belongs to them.
BESIDE = 0.3
#: Elements within each other that are told apart as furniture by name.
NESTED = 50

_OPEN = re.compile(r"</?[a-zA-Z]|<!--|<!\[CDATA\[|<[!?]")
_NAME = re.compile(r"[^\s/>]*")
#: The rest of a tag; quotes count after an equals sign only. Possessive, so it never goes back.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    at: int  # node of its path
    text: str
    linked: int  # characters of link text
    clean: bool  # below no furniture
    held: bool = False  # below what a name made furniture, but what holds most of the page


class Page:
    """Blocks of a page in order, and the tree of their paths: node 0 is the root, a node comes after its parent."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parent, self.name = [0], [""]
        self.child: dict[tuple[int, str], int] = {}

    def node(self, parent: int, name: str) -> int:
        at = self.child.get((parent, name))
        if at is None:
            at = self.child[parent, name] = len(self.parent)
            self.parent.append(parent)
            self.name.append(name)
        return at

    def path(self, at: int) -> tuple[str, ...]:
        out = []
        while at:
            out.append(self.name[at])
            at = self.parent[at]
        return tuple(reversed(out))

    def find(self, path: Iterable[str]) -> int | None:
        """Node of a path, if the page has it."""
        at: int | None = 0
        for name in path:
            at = self.child.get((at, name))
            if at is None:
                return None
        return at


def _called(words: list[str]) -> bool:
    """Whether the words of a class or id name furniture: the first one, or the last one of what it is a kind of."""
    if not words or BEFORE.intersection(words[:-1]) or words[-1] in AFTER:
        return False
    return words[0] in NAMES or words[-1] in NAMES


def _names(attributes: str) -> tuple[list[str], bool, bool, bool]:
    """Classes of an element; whether its names make it furniture, and reader comments; whether its role or style does."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    classes = found.get("class", "").split()
    words = [[w.lower() for w in _PART.split(c) if w] for c in [*classes, found.get("id", "")]]
    hidden = re.search(r"display\s*:\s*none", found.get("style", "")) is not None or found.get("aria-hidden") == "true"
    named = any(_called(ws) for ws in words)
    return classes, named, any(ws and ws[0] in READERS for ws in words), hidden or found.get("role", "").lower() in ROLES


class _Tags:
    """The tags of a page from front to end."""

    def __init__(self, page: str):
        self.page, self.pos, self.missing = page, 0, set()

    def end_of(self, tag: str) -> int | None:
        """Place after the next end tag of that name. A name once missed is not looked for again."""
        if tag in self.missing:
            return None
        m = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(self.page, self.pos)
        if m is None:
            self.missing.add(tag)
        return m.end() if m else None

    def _after(self, mark: str) -> int:
        at = self.page.find(mark, self.pos)
        return len(self.page) if at < 0 else at + len(mark)

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """(text before, tag name or '', closing, attributes); text of CDATA sections comes escaped."""
        page = self.page
        while self.pos < len(page):
            m = _OPEN.search(page, self.pos)
            if not m:
                yield page[self.pos :], "", False, ""
                return
            before, self.pos = page[self.pos : m.start()], m.end()
            if m[0] == "<!--":
                self.pos = self._after("-->")
                yield before, "", False, ""
            elif m[0] == "<![CDATA[":
                start, self.pos = self.pos, self._after("]]>")
                yield before + html.escape(page[start : self.pos].removesuffix("]]>")), "", False, ""
            elif m[0] in ("<!", "<?"):
                self.pos = self._after(">")
                yield before, "", False, ""
            else:
                name = _NAME.match(page, m.end() - 1)
                rest = _REST.match(page, name.end())
                if not rest:
                    yield before, "", False, ""
                    return
                self.pos = rest.end()
                yield before, name[0].lower(), m[0][1] == "/", rest[1]


class _Element(NamedTuple):
    tag: str
    at: int  # node of its path
    hard: bool  # furniture by tag, role or style, here or above
    weak: tuple[int, ...]  # elements here and above that are furniture by name only
    inside: bool  # an article or main element, here or above


_ROOT = _Element("", 0, False, (), False)


def parse(text: str) -> Page:
    """Text blocks of a page."""
    page = Page()
    found: list[tuple[_Element, str, int]] = []
    stack: list[_Element] = []
    readers: set[int] = set()  # weak elements that hold reader comments
    held: set[tuple[int, ...]] = set()  # weak elements at articles
    pieces: list[str] = []
    opened: dict[str, int] = {}  # elements on the stack by tag
    linked = links = number = 0

    def flush():
        nonlocal linked
        if pieces:
            t = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if t:
                found.append((stack[-1] if stack else _ROOT, t, linked))
            pieces.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            pieces.append(raw)
            if links:
                linked += len(raw)

    tags = _Tags(text)
    for before, tag, closing, attributes in tags:
        add(before)
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = tags.end_of(tag)
                if end is not None or tag in ("script", "style"):
                    tags.pos = len(text) if end is None else end
        elif tag == "a":
            links = max(0, links - 1) if closing else links + 1
        elif tag == "br":
            add(" ")
        elif tag == "hr":
            flush()
        elif tag == "button" or tag == "label":
            if not closing and not (tag == "label" and stack and stack[-1].inside):
                tags.pos = tags.end_of(tag) or tags.pos
        elif tag in BLOCK:
            flush()
            links = 0
            if closing:
                while opened.get(tag):  # up to the one that this closes
                    last = stack.pop()
                    opened[last.tag] -= 1
                    if last.tag == tag:
                        break
                continue
            if stack and (stack[-1].tag in LEAF or stack[-1].tag == tag and tag in ("li", "dd", "td", "th", "tr", "option")):
                opened[stack.pop().tag] -= 1
            classes, named, reader, out = _names(attributes)
            top = stack[-1] if stack else _ROOT
            weak = top.weak
            if named and len(weak) < NESTED and tag not in ("html", "body") and not (tag == "header" and top.inside):
                number += 1
                weak = (*weak, number)
                if reader:
                    readers.add(number)
            hard = top.hard or out or tag in FURNITURE or (tag == "header" and not top.inside)
            at = page.node(top.at, ".".join([tag, *sorted(re.sub(r"\d+", "N", c) for c in classes)]))
            stack.append(_Element(tag, at, hard, weak, top.inside or tag in ("article", "main")))
            opened[tag] = opened.get(tag, 0) + 1
            if tag in ("article", "main") and not hard:
                held.add(weak)
    flush()
    whole = any(e.inside and not e.hard and not e.weak for e, _, _ in found)
    taken = set() if whole else set().union(*(w for w in held if readers.isdisjoint(w)))
    most = taken if whole else taken | _holding(found, readers)
    page.blocks = [Block(e.at, t, n, not e.hard and taken.issuperset(e.weak), not e.hard and most.issuperset(e.weak)) for e, t, n in found]
    return page


def _holding(found: list[tuple[_Element, str, int]], readers: set[int]) -> set[int]:
    """Elements that are furniture by name but hold most of the text."""
    total, own = 0.0, {}
    for e, t, n in found:
        if not e.hard and readers.isdisjoint(e.weak):
            score = max(0.0, len(t) - 2.0 * n)
            total += score
            for w in e.weak:
                own[w] = own.get(w, 0.0) + score
    return {w for w, score in own.items() if score > MOST * total}


_INNER = LEAF | {"li", "ul", "ol", "dl", "dd", "blockquote", "figure", "figcaption", "header", "hgroup", "address"}


def _score(b: Block) -> float:
    return max(0.0, len(b.text) - 2.0 * b.linked)


def _tag(part: str) -> str:
    return part.split(".")[0]


def choose(page: Page, strict: bool = False) -> tuple[tuple[str, ...], float]:
    """The page's own vote: path of what holds its articles or else nearly all of its clean text, and that text's length. ``strict``: what a name made furniture is, whatever it holds."""
    n = len(page.parent)
    scores, depth, top = [0.0] * n, [0] * n, [0] * n  # top: the outermost article or main element
    outer = [0] * n  # the node above leaf blocks and lists
    for at in range(1, n):
        above, tag = page.parent[at], _tag(page.name[at])
        depth[at] = depth[above] + 1
        top[at] = top[above] or (at if tag in ("article", "main") else 0)
        outer[at] = outer[above] if tag in _INNER else at
    articles: set[int] = set()
    total = inside = 0.0
    for b in page.blocks:
        if b.clean or b.held and not strict:
            s, at = _score(b), outer[b.at]
            total += s
            scores[at] += s
            if top[at] and s:
                articles.add(top[at])
                inside += s
    if not total:
        return (), 0.0
    for at in range(n - 1, 0, -1):
        scores[page.parent[at]] += scores[at]
    if inside >= HOLDS * total:
        best = min(articles)
        for at in articles:  # the deepest node that holds both
            while at != best:
                best, at = (page.parent[best], at) if depth[best] > depth[at] else (best, page.parent[at])
        above = page.parent[best]
        if best and any(page.parent[at] == above and at != best and _tag(page.name[at]) == "section" and scores[at] >= BESIDE * inside for at in range(above + 1, n)):
            best = above
    else:
        best = max((at for at in range(n) if scores[at] >= KEEPS * total), key=lambda at: (depth[at], scores[at]))
    return page.path(best), scores[best]


def main_text(page: Page, winners: list[list[str]]) -> str:
    """Clean blocks below a winning path, and below the page's own choice if that holds more; and its title. One a line.

    What holds most of a page but is called furniture counts where it is below a winning path, or none has text here.
    """

    def below(*paths: Iterable[str], strict: bool = False, title: bool = True) -> list[Block]:
        n = len(page.parent)
        under, roots = [False] * n, {page.find(p) for p in paths}
        for at in range(n):
            under[at] = at in roots or (at > 0 and under[page.parent[at]])
        return [b for b in page.blocks if (b.clean or b.held and not strict) and (under[b.at] or (title and _tag(page.name[b.at]) == "h1" and _score(b) > 0))]

    strict = sum(map(_score, below(*winners, title=False))) > 0
    won = below(*winners)
    choice = choose(page, strict)[0]
    own = below(choice, strict=strict)
    if sum(map(_score, won)) < KEEPS * sum(map(_score, own)) or not won:
        ids = set(map(id, [*won, *own]))
        won = [b for b in page.blocks if id(b) in ids]
    return "\n".join(b.text for b in won)


def host(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Winning paths per host: rows (host, winners, pages)."""

    def vote(batches):
        for b in batches:
            got = [choose(parse(t)) if t else ((), 0.0) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(g[0]) for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.float64())], ["host", "path", "weight"])

    votes = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(vote, "host string, path array<string>, weight double")
    # The weight of a page is bounded by its length; the square root keeps long pages from outvoting many.
    sums = table(votes.groupBy("host", "path").agg(F.sum(F.sqrt("weight")).alias("votes"), F.count("*").alias("n")), "html-votes")
    totals = sums.groupBy("host").agg(F.sum("votes").alias("all"), F.sum("n").alias("pages"))
    won = sums.join(totals, "host").where((F.col("votes") > 0) & (F.col("votes") >= WINS * F.col("all")))
    winners = won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("winners"))
    return totals.select("host", "pages").join(winners, "host", "left").select("host", F.coalesce("winners", F.array().cast("array<array<string>>")).alias("winners"), "pages")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    hosts = table(consensus(pages, url_col, html_col), "html-hosts")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    size = hosts.agg(F.count("*").alias("n"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")).first()
    if size["n"] <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(hosts.drop("pages")), "host", "left")
    else:
        joined = lookup(rows, hosts, ["host"], "pages", size["pages"])

    def run(batches):
        for b in batches:
            got = [main_text(parse(t), w or []) if t else "" for t, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "winners").mapInArrow(run, "page_id long, url string, text string, n_chars long")
