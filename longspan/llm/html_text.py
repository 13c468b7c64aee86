"""Main text of web pages by paths that a host's pages agree on.

Each page's containers (body, article, main, section, div, td) are scored by the text of their blocks less that of
links, in full for the block's own container and by half for each one further out. A page votes for the path of its
best container: of the outermost article around it if there is one, else of the smallest element inside the body that
holds all of the page's unlinked text, else (only the body holds all) of the smallest that holds nearly all, and on to
one with text of its own beside it. If the page has one h1 and it stands outside, what wraps both is taken (of an
article: no more than its main). A path is tags and classes from the root, digits in classes generalised. Spark adds up votes by host and path; the path with most votes
(then most score, then first in order) wins. Pages are then extracted anew from the elements on their host's path; a
page that has none there falls back on its own best container. Votes are summed in the tasks before their shuffle, and
pages meet the winners in a join that Spark may split, so a large host is no burden.

Left out at any depth: what isn't content by tag, role or a whole class or id (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments), but for class or id nothing that wraps the page's content, and no
heading, line, cell or list item; the id of a section inside an article counts only for readers' comments. Of a
header inside an article its headings stay. What is left out inside a line does not divide the line; a <br> is white
space. Attributes are read as HTML reads them: a quote opens a value only after an equals sign. Time and memory grow
with a page's length, however deep its elements nest.

Defined results: null and empty pages give an empty text; a page without a container votes for nothing and gives the
text of its blocks; a null url has the empty host; rows that repeat vote and are returned each for itself; null ids are
returned; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import table, written

# Fixed values of HTML and of common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("body article main section div td".split())
LEFT_OUT = frozenset("nav header footer aside form menu head select button dialog svg annotation annotation-xml object audio video canvas map input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that a class or id never leaves out: it tells of the words of a heading, the column of a table, the look of a line.
NEVER_NAMED = HEADINGS | frozenset("body html main p li dt dd caption figcaption tr td th thead tbody tfoot pre blockquote".split())
# Names of readers' comments, which an id of a section inside an article tells of; other ids there are made from its heading's words.
READERS = frozenset("comment comments disqus respond replies".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
NOT_CONTENT = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar side widget widgets notice notices cookie cookies consent gdpr banner ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion share sharing social comment comments disqus respond replies related recommended popup modal overlay newsletter subscribe signup login search skip toolbar pagination pager copyright".split())
# What may stand beside them in one class or id: where and how they lie. 'no', 'has' and 'with' are not here, as they tell of another element.
BESIDE = frozenset("site page main primary secondary global top bottom left right first last inner outer container wrapper wrap box block bar area section list item items links link icons buttons button slot unit form title text posts articles".split())
PARTS = re.compile(r"[_-]+|(?<=\D)(?=\d+$)")
MOST = 0.8
CONTENT = re.compile(r"article|content|post|entry|story|main|body|text")

# A quote opens a value only after an equals sign; else it is a character like others.
VALUE = r"\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*"
TOKEN = re.compile(rf"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:{VALUE})|[^>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(rf"([^\s/>=]+)(?:\s*=\s*({VALUE})?)?")
WANTED = re.compile(r"class|id|role|hidden|style", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
DIGITS = re.compile(r"\d+")
LINK_WEIGHT = 1.0
OUTER = 0.5
PREFERRED = 1.5
NEARLY_ALL = 0.97


@dataclass
class Held:
    """What an element holds: characters of text, articles and mains."""

    text: int = 0
    articles: int = 0
    mains: int = 0


@dataclass
class Element:
    tag: str
    skip: bool
    container: int
    heading_only: bool = False
    certain: bool = False  # left out by more than its class or id
    number: int = -1  # of those left out by class or id
    in_header: bool = True  # of what leaves it out, all is a header or what may stand in one
    held: Held = field(default_factory=Held)


@dataclass
class Page:
    """A page's containers (label, parent, hash of its path) and blocks (container, text, characters in links)."""

    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    paths: list[int] = field(default_factory=list)
    bonus: list[float] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    titles: list[int] = field(default_factory=list)  # containers of blocks that are an h1

    def path(self, container: int) -> str:
        out = []
        while container >= 0:
            out.append(self.labels[container])
            container = self.parents[container]
        return ">".join(reversed(out))


def _longer(path: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=path)


def _hashed(path: str) -> int:
    out = 0
    for label in path.split(">"):
        out = _longer(out, label)
    return out


def _attributes(raw: str) -> dict[str, str]:
    """Names and values, of several of a name the first."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw) if WANTED.search(raw) else ():
        value = m[2] or ""
        out.setdefault(m[1].lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def _names(name: str) -> bool:
    """Whether a whole class or id says that its element isn't content."""
    parts = [x for x in PARTS.split(name) if x]
    return any(x in NOT_CONTENT for x in parts) and all(x in NOT_CONTENT or x in BESIDE or x.isdigit() for x in parts)


def _hidden(a: dict[str, str]) -> bool:
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    return "display:none" in a.get("style", "").replace(" ", "").lower()


def _not_content(tag: str, a: dict[str, str], in_article: bool) -> bool:
    """Whether its class or id leaves an element out. The id of a section inside an article counts only where it names readers' comments."""
    if tag in NEVER_NAMED:
        return False
    if any(_names(x) for x in a.get("class", "").lower().split()):
        return True
    ids = a.get("id", "").lower().split()
    if tag == "section" and in_article:
        ids = [x for x in ids if READERS & set(PARTS.split(x))]
    return any(_names(x) for x in ids)


class Parser:
    """Reads a page once. Elements left out by class or id are numbered; those in spared stay."""

    def __init__(self, html: str, spared: frozenset[int]):
        self.html, self.spared, self.page = html, spared, Page()
        self.stack = [Element("", False, -1)]
        self.open: Counter[str] = Counter()  # tags of the stack
        self.named: list[Held] = []
        self.named_tags: list[str] = []
        self.text: list[str] = []
        self.links = 0

    def end_block(self) -> None:
        if self.text:
            joined = " ".join("".join(self.text).split())
            self.text.clear()
            if joined:
                self.page.blocks.append((self.stack[-1].container, joined, min(self.links, len(joined))))
                if self.open["h1"]:
                    self.page.titles.append(self.stack[-1].container)
        self.links = 0

    def add(self, piece: str) -> None:
        top = self.stack[-1]
        if not top.certain:
            top.held.text += len(piece.strip())
        if piece and not (top.skip and not top.heading_only):
            piece = entities.unescape(piece) if "&" in piece else piece
            self.text.append(piece)
            if self.open["a"]:
                self.links += len(piece)

    def close(self, at: int) -> None:
        """Closes the elements of the stack from at on; each gives what it holds to the one around it."""
        stack = self.stack
        if any(e.tag in BLOCK and (e.heading_only or not stack[k - 1].skip) for k, e in enumerate(stack[at:], at)):
            self.end_block()
        while len(stack) > at:
            e = stack.pop()
            self.open[e.tag] -= 1
            if not e.certain:
                e.held.articles += e.tag == "article"
                e.held.mains += e.tag == "main"
            if e.number >= 0:
                self.named[e.number] = e.held
            around = stack[-1].held
            around.text, around.articles, around.mains = around.text + e.held.text, around.articles + e.held.articles, around.mains + e.held.mains

    def close_up_to(self, tags: frozenset[str] | set[str], scope: frozenset[str] | set[str]) -> None:
        """Closes the innermost element of one of tags, unless one of scope is around what is open."""
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self.close(k)
                return
            if self.stack[k].tag in scope:
                return

    def begin(self, tag: str, raw: str) -> None:
        if tag in BLOCK:
            self.close_up_to(frozenset(["p"]), BLOCK)
        if tag in CLOSED_BY:
            self.close_up_to(CLOSED_BY[tag], SCOPE[tag])
        top = self.stack[-1]
        if tag in VOID:
            if tag in BLOCK and not top.skip:
                self.end_block()
            return
        a = _attributes(raw) if raw and not raw.isspace() else {}
        certain = top.certain or tag in LEFT_OUT or _hidden(a)
        number = -1
        if not certain and _not_content(tag, a, self.open["article"] > 0):
            number = len(self.named)
            self.named.append(Held())
            self.named_tags.append(tag)
        out = top.skip or certain or number >= 0 and number not in self.spared
        element = Element(tag, out, top.container, certain=certain, number=number)
        element.in_header = top.in_header and (not out or tag in ("header", "div", "hgroup"))
        # Of a header inside an article the headings stay.
        element.heading_only = top.heading_only or top.skip and top.in_header and tag in HEADINGS and self.open["article"] + self.open["main"] > 0
        if tag in BLOCK and (element.heading_only or not top.skip):
            self.end_block()
        if tag in CONTAINER and not out:
            page = self.page
            page.labels.append((tag + "".join(f".{x}" for x in sorted(DIGITS.sub("#", a.get("class", "").lower()).split()))).replace(">", "#"))
            page.parents.append(top.container)
            page.paths.append(_longer(page.paths[top.container] if top.container >= 0 else 0, page.labels[-1]))
            page.bonus.append(PREFERRED if tag in ("article", "main") or CONTENT.search(f"{a.get('class', '')} {a.get('id', '')}".lower()) else 1.0)
            element.container = len(page.labels) - 1
        self.stack.append(element)
        self.open[tag] += 1

    def run(self) -> Page:
        html, at = self.html, 0
        last = html.rfind(">") + 1  # no tag ends later
        while m := TOKEN.search(html, at, last):
            self.add(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(html)  # never ends
                    break
                continue
            if m[1] or m[4]:
                if self.open[tag]:
                    self.close_up_to(frozenset([tag]), frozenset())
            elif tag in RAW:
                found = RAW_END[tag].search(html, at)
                at = found.end() if found else len(html)
            else:
                if tag == "br":
                    self.add(" ")
                self.begin(tag, m[3] if m[2] else m[6])
        rest = html[at:]
        cut = rest.find("<!--")  # a comment that never ends
        rest = rest if cut < 0 else rest[:cut]
        self.add(rest if not re.match(r"<[a-zA-Z/!?]", rest) else "")
        self.close(1)
        self.end_block()
        return self.page


def parse(html: str | None) -> Page:
    """The page's containers and blocks.

    An element that its class or id would leave out stays if it holds a main, or in a page without one all articles, or in
    a page without either (or itself an article) more than MOST of the text: it is a wrapper of the content then. If all
    else leaves nothing, all such elements stay.
    """
    first = Parser(html or "", frozenset())
    page, whole = first.run(), first.stack[0].held
    if not first.named:
        return page
    spared = []
    for k, (x, tag) in enumerate(zip(first.named, first.named_tags)):
        most = x.text > MOST * whole.text
        every = x.articles == whole.articles and (x.articles > 0 or most)
        if x.mains or not whole.mains and (every or tag == "article" and most):
            spared.append(k)
    if spared:
        page = Parser(html or "", frozenset(spared)).run()
    return page if page.blocks else Parser(html or "", frozenset(range(len(first.named)))).run()


def best(page: Page) -> tuple[str | None, float]:
    """(path, score) of what the page votes for; see the module's docstring. Of equal containers the first counts."""
    n = len(page.labels)
    score = [0.0] * n
    for c, text, links in page.blocks:
        if c >= 0:
            score[c] += max(0.0, len(text) - LINK_WEIGHT * links)
    own, whole = list(score), list(score)
    for k in range(n - 1, -1, -1):  # what stands inside another comes later
        if page.parents[k] >= 0:
            score[page.parents[k]] += OUTER * score[k]
            whole[page.parents[k]] += whole[k]
    score = [s * b for s, b in zip(score, page.bonus)]
    top = max(range(n), key=lambda k: score[k], default=None)
    if top is None or not score[top]:
        return None, 0.0
    body = lambda k: page.labels[k].startswith("body")
    all_text = sum(w for k, w in enumerate(whole) if page.parents[k] < 0)
    article, every, nearly, before, up = -1, -1, -1, -1, top
    while up >= 0:
        if page.labels[up].partition(".")[0] == "article":
            article = up
        beside = own[up] > 0 and nearly == before and not body(up)  # text of its own beside the one inside
        if nearly < 0 and whole[up] >= NEARLY_ALL * all_text or nearly >= 0 and beside:
            nearly = up
        if every < 0 and whole[up] >= all_text and not body(up):
            every = up
        before, up = up, page.parents[up]
    chosen = article if article >= 0 else every if every >= 0 else nearly if nearly >= 0 else top
    return page.path(_with_title(page, chosen)), score[top]


def _inside(page: Page, k: int, outer: int) -> bool:
    while k >= 0 and k != outer:
        k = page.parents[k]
    return k == outer


def _with_title(page: Page, chosen: int) -> int:
    """chosen, or if it has no h1 the smallest element around it that has the page's only one: of an article only its main, or what wraps both."""
    if len(page.titles) != 1 or page.titles[0] < 0 or _inside(page, page.titles[0], chosen):
        return chosen
    up = page.parents[chosen]
    while up >= 0 and not _inside(page, page.titles[0], up):
        up = page.parents[up]
    is_article = page.labels[chosen].partition(".")[0] == "article"
    return up if up >= 0 and not (is_article and page.labels[up].startswith("body")) else chosen


def text_at(page: Page, path: str | None) -> str:
    """The blocks inside elements on the path, in page order; all blocks if the path is null."""
    asked = 0 if path is None else _hashed(path)
    within = [False] * len(page.paths)
    for k, p in enumerate(page.paths):
        within[k] = p == asked or page.parents[k] >= 0 and within[page.parents[k]]
    return "\n".join(t for c, t, _ in page.blocks if path is None or c >= 0 and within[c])


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and the path that most of its pages vote for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best(parse(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["host", "path", "score"])

    votes = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, score double").where("path is not null")
    sums = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.round("score")).alias("score"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), -F.col("score"), "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for html, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                page = parse(html)
                text = text_at(page, path) if path is not None else ""
                if not text:
                    path = best(page)[0]
                    text = text_at(page, path)
                for c, v in zip(out, (text, len(text), path)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["page_id", "url", "text", "n_chars", "path"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    winners = written(winning_paths(rows))
    placed = rows.withColumn("host", host(F.col("url"))).join(winners, "host", "left").select("page_id", "url", "html", "path")
    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE_SQL: dict[str, str] = {}
