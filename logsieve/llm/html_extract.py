"""Main text of web pages by consensus host paths.

Every page's containers are scored by the running text they hold, and the best one votes for its
generalised tag-class path (digits and ids left out, hashed as a whole, however long). Elements whose
names hint at menus, adverts or reader comments vote too: by what they hold, for or against being left
out. A host's votes are added up in Spark, partial sums first, so a host with a third of all pages is a
few rows to a task. Each page is then extracted anew from the container of its own whose path has the
most votes, or from its own best container where no other page of the host shares a path with it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.shared import materialize, small_batches, table

#: Votes are shipped to the tasks up to this many bytes of hosts and paths; beyond it they are joined.
SHIPPED_BYTES = 32 << 20

_S = r"[\t\n\f\r ]"
#: One attribute as browsers read it: a quote opens a value right after the equals sign only. Nothing backtracks.
ATTRIBUTE = rf"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{_S}*+={_S}*+(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f\r >"'][^\t\n\f\r >]*+)|(?=>)))?+"""
_ATTRIBUTE = re.compile(ATTRIBUTE)
_PLAIN = re.sub(r"\((?!\?)", "(?:", ATTRIBUTE)
#: Comments and declarations, or the start of a tag.
MARK = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+>|<(/?)([a-zA-Z][^\t\n\f\r />]*+)", re.S)
REST = re.compile(rf"((?:[\t\n\f\r /]++|{_PLAIN})*+)>")
LOOSE = re.compile(r"([^>]*+)>")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, up to their own end tag.
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mstyle mpadded mphantom menclose mfenced annotation annotation-xml".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body html center".split())
#: Start tags that end an open paragraph, and those that end an open element of the same group.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (a.split(), b.split()) for k, (a, b) in CLOSES.items()}
#: Elements and roles that are no part of an article, whatever they are called.
NOT_TEXT = frozenset("script style noscript template iframe object embed svg annotation annotation-xml canvas audio video head title xmp noembed noframes".split())
ASIDE = frozenset("nav footer aside button select textarea fieldset dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class and id words that hint at what an element is. They are evidence among other evidence, never enough.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar footer masthead cookie cookies gdpr popup modal comment comments "
    "disqus newsletter werbung anzeige publicité publicite publicidad anuncio kommentar kommentare commentaire commentaires comentario comentarios".split()
)
WEAK = frozenset(
    "side aside banner header promo promoted sponsor notice notices alert overlay consent reply replies respond discussion share sharing social related recommended subscribe subscription signup login "
    "widget toolbar hidden skip print teaser hinweis avis aviso".split()
)
GOOD = frozenset("article content post entry story main body text page".split())
_WORDS = re.compile(r"[^\W\d_]+")
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre body html main".split()) | INLINE
_LONG_NUMBER = re.compile(r"&#(?:0*+([0-9]{8,})|[xX]0*+([0-9a-fA-F]{8,}));?")
#: Evidence from which an element is left out, and characters a block of running text has on average.
ENOUGH, SHORT_BLOCK = 3, 40
#: Characters before a list of entries that can be an article.
BEFORE = 150
#: Elements around the best container that are looked at one after the other.
WIDER = 8


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    parent: int
    hard: bool
    link: bool
    good: bool
    hint: int
    container: int  # the nearest container, itself included
    at: int  # characters before it
    end: int = -1
    repeats: int = 0
    last_child: int = 0
    heading: bool = False
    score: float = 0.0
    size: int = 0
    linked: int = 0
    blocks: int = 0


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (node, block, text): a block is what lies between two tags that aren't inline.
    texts: list[tuple[int, int, str]] = field(default_factory=list)
    total: int = 0


def decoded(text: str) -> str:
    """Character references become characters; numbers of any length are allowed."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("�", text) if "&#" in text else text)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): decoded(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _node(tag: str, attributes: str, page: Page, at: int) -> Node:
    found = _attributes(attributes) if attributes.strip(" /\n\t\r\f") else {}
    classes = found.get("class", "").lower().split()
    words = {w for c in [*classes, found.get("id", "").lower()] for w in _WORDS.findall(c)}
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
    hard = tag in ASIDE or tag in NOT_TEXT or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    hard = hard or "display:none" in found.get("style", "").replace(" ", "").lower()
    good = tag in ("article", "main") or (tag in CONTAINERS and bool(words & GOOD))
    hint = 3 if tag in ("form", "header") else 0 if tag in _RUNNING or not words else 2 if words & STRONG else 1 if words & WEAK else 0
    if hint and hint < 3 and words & GOOD:
        hint = 0
    n = len(page.nodes)
    if at < 0:
        return Node(tag, xxhash.xxh3_64_intdigest(step) - (1 << 63), -1, hard, tag == "a", good, 0, n, page.total)
    parent = page.nodes[at]
    path = xxhash.xxh3_64_intdigest(f"{parent.path}>{step}") - (1 << 63)
    parent.repeats += parent.last_child == path
    parent.last_child = path
    return Node(tag, path, at, hard or parent.hard, tag == "a" or parent.link, good, hint, n if tag in CONTAINERS else parent.container, page.total)


class _Open:
    """The open elements: their nodes, and where each tag and each block element stands among them."""

    def __init__(self, page: Page):
        self.page, self.stack, self.places, self.blocks = page, [], {}, []

    def enter(self) -> None:
        tag = self.page.nodes[-1].tag
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.page.nodes) - 1)

    def close(self, n: int) -> None:
        """Close the n-th open element and all within it."""
        while len(self.stack) > n:
            node = self.page.nodes[self.stack.pop()]
            node.end = len(self.page.nodes)
            self.places[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)


def parse(text: str) -> Page:
    """A forgiving parse in one pass: unclosed and stray tags, implied ends, raw text; what isn't markup is text.

    A tag that never ends because of a quote ends at its first ``>``; without one it is text.
    """
    page, block, at, rest = Page(), 0, 0, REST
    opened = _Open(page)
    stack = opened.stack

    def add(data: str) -> None:
        if data and not data.isspace():
            if not stack:
                page.nodes.append(_node("body", "", page, -1))
                opened.enter()
            page.texts.append((stack[-1], block, data))
            page.total += len(data)
        elif data and page.texts and page.texts[-1][1] == block:
            page.texts.append((page.texts[-1][0], block, " "))

    while True:
        m = MARK.search(text, at)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        inner = rest.match(text, at)
        if inner is None and rest is REST:
            rest = LOOSE
            inner = rest.match(text, at)
        if inner is None:  # no ">" is left, so no tag either
            add(text[m.start() :])
            break
        at, tag = inner.end(), m[2].lower()
        if tag not in INLINE:
            block += 1
        elif tag in ("br", "img"):
            add(" ")
        if m[1]:
            n = opened.last(tag)
            if n >= 0 and (tag not in INLINE or not opened.blocks or n > opened.blocks[-1]):
                opened.close(n)  # an inline end tag closes nothing outside its block
            continue
        if tag in ENDS_P and opened.blocks and page.nodes[stack[opened.blocks[-1]]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in CLOSES:
            ends, limits = CLOSES[tag]
            while (n := opened.last(*ends)) > opened.last(*limits):
                opened.close(n)
                if tag != "tr":
                    break
        if tag in VOID or (tag == "body" and opened.last("body") >= 0):
            continue
        if tag == "body":
            opened.close(0 if not stack or page.nodes[stack[0]].tag != "html" else 1)
        if not stack and tag not in ("html", "body"):
            page.nodes.append(_node("body", "", page, -1))
            opened.enter()
        page.nodes.append(_node(tag, inner[1], page, stack[-1] if stack else -1))
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\t\n\f\r />])", re.I).search(text, at)
            ended = LOOSE.match(text, stop.end()) if stop else None
            page.nodes[-1].hard, page.nodes[-1].end, at = True, len(page.nodes), ended.end() if ended else len(text)
            continue
        if inner[1].endswith("/") and tag not in ENDS_P and tag not in CONTAINERS:
            page.nodes[-1].end = len(page.nodes)
        else:
            opened.enter()
            if tag in ("h1", "h2"):
                page.nodes[-1].heading = True
    opened.close(0)
    _measure(page)
    return page


def _measure(page: Page) -> None:
    """Characters, linked characters and blocks of every element, and the containers' scores."""
    nodes, last = page.nodes, -1
    blocks: dict[int, list[int]] = {}
    page.total = 0
    for node, block, data in page.texts:
        n = nodes[node]
        if not n.hard:
            size = len(decoded(data).strip())
            n.size += size
            n.linked += size if n.link else 0
            n.blocks += block != last
            last = block
            page.total += size
            entry = blocks.setdefault(block, [node, 0, 0])
            entry[1] += size
            entry[2] += size if n.link else 0
    for n in reversed(nodes):
        if n.parent >= 0:
            up = nodes[n.parent]
            up.size, up.linked, up.blocks, up.heading = up.size + n.size, up.linked + n.linked, up.blocks + n.blocks, up.heading or n.heading
    faint = [1.0] * len(nodes)
    for i, n in enumerate(nodes):
        faint[i] = (faint[n.parent] if n.parent >= 0 else 1.0) * (0.3 if n.hint and evidence(page, i) >= ENOUGH else 1.0)
    for node, size, linked in blocks.values():
        worth, n = (size - 1.5 * linked) * faint[node], nodes[node].container
        while n >= 0 and worth > 0.01:
            at = nodes[n]
            at.score += worth * (1.2 if at.good else 1.0)
            worth *= 0.7
            n = nodes[at.parent].container if at.parent >= 0 else -1


def evidence(page: Page, i: int) -> int:
    """How much tells that an element with a hint is no part of the article: its name, and what it holds and where."""
    n = page.nodes[i]
    if not n.hint:
        return 0
    if n.tag == "header" and n.heading and any(page.nodes[p].tag in ("article", "main") for p in _up(page, i)):
        return 0  # the article's own head
    late = 0 < page.total * 3 <= 5 * n.at
    listed = n.repeats > 0
    # Entries of one kind behind other text are reader comments or the like, however much there is of them.
    entries = n.hint == 2 and listed and n.at >= max(BEFORE, page.total // 20)
    return n.hint + (n.linked > 0.4 * n.size) + (n.size < SHORT_BLOCK * n.blocks) + late + listed - 2 * (2 * n.size > page.total and not entries)


def _up(page: Page, i: int, most: int = 4) -> Iterator[int]:
    for _ in range(most):
        i = page.nodes[i].parent
        if i < 0:
            return
        yield i


def best_container(page: Page) -> int | None:
    """The container with the most running text: a block counts for the one it stands in, and less for each further out."""
    scored = [(n.score, -i) for i, n in enumerate(page.nodes) if n.score > 0 and not n.hard]
    return -max(scored)[1] if scored else None


def _left_out(page: Page, i: int, verdicts: dict[int, bool]) -> bool:
    n = page.nodes[i]
    return n.hard or bool(n.hint and verdicts.get(n.path, evidence(page, i) >= ENOUGH))


def _around(page: Page, roots: list[int]) -> int:
    """The closest element that holds all of these, but isn't one of them."""
    if len(roots) == 1:
        return page.nodes[roots[0]].parent
    at = roots[0]
    while at >= 0 and not (at < roots[0] and page.nodes[at].end >= page.nodes[roots[-1]].end):
        at = page.nodes[at].parent
    return at


def widened(page: Page, roots: list[int], verdicts: dict[int, bool]) -> list[int]:
    """The roots, or an element around them whose other parts are text of the article: its title, its lead, its sections.

    What is left out anyway doesn't count. Of the rest few characters may be links, and most must stand in headings
    or in blocks of running text; an element named as an article, or its tag, needs the former only.
    """
    kept, now = roots, roots
    for _ in range(WIDER):
        if (up := _around(page, now)) < 0 or page.nodes[up].tag in ("body", "html") or _left_out(page, up, verdicts):
            break
        n = page.nodes[up]
        out = bytearray(n.end - up)  # 1: in the present roots, or left out
        for r in now:
            out[r - up : page.nodes[r].end - up] = b"\1" * (page.nodes[r].end - r)
        for i in range(up + 1, n.end):
            out[i - up] = out[i - up] or out[page.nodes[i].parent - up] or _left_out(page, i, verdicts)
        blocks: dict[int, list[int]] = {}  # size, linked, in a heading
        for node, block, data in page.texts:
            if up <= node < n.end and not out[node - up] and (size := len(decoded(data).strip())):
                entry = blocks.setdefault(block, [0, 0, 0])
                entry[0] += size
                entry[1] += size if page.nodes[node].link else 0
                entry[2] |= page.nodes[node].tag in HEADINGS or any(page.nodes[p].tag in HEADINGS for p in _up(page, node))
        total, linked = sum(b[0] for b in blocks.values()), sum(b[1] for b in blocks.values())
        running = sum(b[0] for b in blocks.values() if b[2] or b[0] - b[1] >= SHORT_BLOCK)
        now = [up]
        if total:
            if 4 * linked > total or not (n.good or 5 * running >= 4 * total):
                break
            kept = now
    return kept


def text_of(page: Page, roots: list[int], verdicts: dict[int, bool]) -> str:
    """Blocks of the given containers in page order, white space folded, without what is no part of the article.

    ``verdicts`` has what the host's pages say of an element's path; where they don't, its own evidence counts.
    """
    state = bytearray(len(page.nodes))  # 1: text of the article
    for r in roots:
        state[r] = 1
        for i in range(r + 1, page.nodes[r].end):
            n = page.nodes[i]
            if state[n.parent] and not n.hard and not (n.hint and verdicts.get(n.path, evidence(page, i) >= ENOUGH)):
                state[i] = 1
    blocks: dict[int, list[str]] = {}
    for node, block, data in page.texts:
        if state[node]:
            blocks.setdefault(block, []).append(data)
    lines = [" ".join(decoded("".join(parts)).split()) for _, parts in sorted(blocks.items())]
    return "\n".join(x for x in lines if x)


def votes(page: Page) -> list[tuple[int, float, int]]:
    """(path, weight as main text, for or against leaving out) of the best container and of the hinted elements.

    The best container counts by the square root of the text it stands on, so that no one page decides.
    """
    best = best_container(page)
    out = [] if best is None else [(page.nodes[best].path, max(1.0, page.nodes[best].score) ** 0.5, 0)]
    return out + [(n.path, 0.0, 1 if evidence(page, i) >= ENOUGH else -1) for i, n in enumerate(page.nodes) if n.hint and not n.hard]


def extract(page: Page, main: dict[int, float], verdicts: dict[int, bool]) -> str:
    """Main text by the path of the page with the most votes in ``main``, else by the page's own best container."""
    best, at = best_container(page), {}
    for i, n in enumerate(page.nodes):
        if n.path in main and n.tag in CONTAINERS and not n.hard:
            at.setdefault(n.path, []).append(i)
    for path in sorted(at, key=lambda p: (-main[p], p)):
        roots = at[path]
        if best is not None and page.nodes[best].path in main and page.nodes[roots[0]].tag in ("body", "html"):
            roots = at[page.nodes[best].path]  # a voted container within the whole page is the closer one
        if found := text_of(page, widened(page, roots, verdicts), verdicts):
            return found
    return "" if best is None else text_of(page, widened(page, [best], verdicts), verdicts)


def _host(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, main, leave): what a host's pages say of each path that two or more of them vote on.

    What a single page votes for is that page's own choice anyway.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            cast = [(h, *v) for h, t in zip(part.host, part.html, strict=True) for v in votes(parse(t))]
            yield pd.DataFrame(cast, columns=["host", "path", "main", "leave"]).astype({"path": "int64", "main": "float64", "leave": "int64"})

    cast = pages.select(_host().alias("host"), "html").where("host <> '' and html is not null").mapInPandas(run, "host string, path long, main double, leave long")
    total = cast.groupBy("host", "path").agg(F.sum("main").alias("main"), F.sum("leave").alias("leave"), F.count("*").alias("n"))
    return total.where("n > 1").drop("n")


RESULT = "page_id long, url string, text string, n_chars long"


def main_text(pages: DataFrame, shipped_bytes: int = SHIPPED_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null html is an empty page and has an empty text; a url that is null or names no host has no
    consensus, and its pages go by their own best container; rows may repeat and page_id may be null;
    other columns are ignored; an empty table gives no rows. Unclosed tags, stray quotes and broken
    references are read as browsers read them; the time is in proportion to a page's length.
    """
    spark = pages.sparkSession
    small_batches(spark)
    told = materialize(host_votes(pages), "votes")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host().alias("host"))
    measured = told.agg(F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0))).first()[0]
    if measured > shipped_bytes:
        return _joined(rows, told)
    held: dict[str, list[tuple[int, float, int]]] = {}
    for r in told.toLocalIterator():  # at most ``shipped_bytes``
        held.setdefault(r.host, []).append((r.path, r.main, r.leave))
    shipped = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = []
            for t, h in zip(part.html, part.host, strict=True):
                said = shipped.value.get(h, ())
                found.append(extract(parse(t or ""), {p: m for p, m, _ in said if m > 0}, {p: x > 0 for p, _, x in said if x}))
            yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": found, "n_chars": [len(x) for x in found]})

    return rows.mapInPandas(run, RESULT)


def _joined(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The same with the votes joined: each page asks for its own paths only, so no list grows with a host."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [(a, b, h, p) for a, b, h, t in zip(part.k1, part.k2, part.host, part.html, strict=True) for p in {n.path for n in parse(t).nodes if n.tag in CONTAINERS or n.hint}]
            yield pd.DataFrame(out, columns=["k1", "k2", "host", "path"]).astype({"k1": "int64", "k2": "int64", "path": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = []
            for t, said in zip(part.html, part.said, strict=True):
                said = [] if said is None else list(said)
                found.append(extract(parse(t or ""), {x["path"]: x["main"] for x in said if x["main"] > 0}, {x["path"]: x["leave"] > 0 for x in said if x["leave"]}))
            yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": found, "n_chars": [len(x) for x in found]})

    key = [F.xxhash64("host", "html").alias("k1"), F.xxhash64(F.lit(7), "host", "html").alias("k2")]
    keyed = rows.select("*", *key)
    each = keyed.where("host <> '' and html is not null").select("k1", "k2", "host", "html").mapInPandas(asked, "k1 long, k2 long, host string, path long")
    said = each.distinct().join(told, ["host", "path"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("path", "main", "leave")).alias("said"))  # no longer than the page
    return keyed.join(said, ["k1", "k2"], "left").select("page_id", "url", "html", "said").mapInPandas(run, RESULT)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
