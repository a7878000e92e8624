"""HTML extraction (operator 8): consensus host paths.

Each page is cut once into blocks of text, each in a chain of open elements. A container's path is the names and classes of
the containers around it, digits and order of classes taken out, so that pages of one template agree. A page chooses the
container of its article: an article element if one holds a fair share of the text, else the deepest container, from a main
element or the root down, that holds two thirds of it (text in links counts against it), and its heading. Spark counts per
host how many pages chose a path and how many have it at all; every page is extracted again by the path, of those it has, that
most of the pages which have it chose. Paths of less than ``LEAST_SHARE`` of a host's pages, or one page, don't win: pages
without a winning path keep their own choice.

What isn't article: by element (menus, headers outside an article, footers, asides, scripts, styles, buttons, the head), by
role, or by name: a whole class or id with a word such as sidebar in it, not one that says of a page that it has a sidebar.
What is only named so, and forms, count as article if they hold most of the page's text and its heading, few links and few
fields; what is named as reader comments only if it holds the page's first heading too. Tools make ids from headings, so ids of
sections, headings, paragraphs and the like say nothing, unless the whole id is such a word and most of the text is links; nor does
any id that is its first heading's text. Classes of headings and paragraphs are read as whole names. Elements that HTML
closes by itself (p, li, dd, dt, td, tr, option) are closed.

Line breaks end a block; character references are decoded; white space in a block becomes one space.

Cases: a null or empty page gives an empty text; pages cut short are read to their end; very long pages are read whole; a null
or odd url is a host by itself (''); repeated rows are extracted one by one; an empty table gives no rows; other columns are
kept, but for ``host``, ``text`` and ``paths``, which the result's own replace.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, table
from .tokens import slices

#: A path wins in a host if so large a share of its pages, and two at least, chose it.
LEAST_SHARE = 0.002

CONTAINERS = frozenset("html body div section article main header footer nav aside form table tbody thead tfoot tr td th ul ol dl figure fieldset details blockquote".split())
#: Elements that end the block of text before them and begin another.
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr br caption figcaption summary legend option title".split())
SILENT = frozenset("nav footer aside script style noscript template iframe svg object select option button textarea head title canvas audio video dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
#: Words of a class or id that mark what isn't the article; adverts may be inline; comments are never the article.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements adsense adsbygoogle sponsor sponsored promo promotion promotions".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
NOISE = ADVERTS | COMMENTS | frozenset(
    "banner banners cookie cookies consent gdpr notice notices alert popup modal overlay"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer foot header masthead topbar toolbar related recommended recommendations"
    " share sharing social subscribe subscription newsletter signup login search pagination pager tags toc skip".split()
)
#: A name with one of these before the word, or one of those at its end, speaks of the page.
BEFORE = frozenset("has have with without no not non is".split())
OF_PAGE = frozenset("layout page free template theme enabled".split())
AT_END = OF_PAGE | frozenset("article story post".split())
#: Headings, and elements of running text whose ids are made from it.
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
OF_TEXT = TITLES | frozenset("p li dt dd pre blockquote figure figcaption caption table td th section".split())
#: Words that count as a whole name only, and those before "header" that make it an article's.
WHOLE = frozenset("widget widgets hidden".split())
OF_ARTICLE = frozenset("post entry article story content".split())
VOID = frozenset("br hr img meta link input area base col embed source track wbr param".split())
FIELDS = frozenset("input select textarea button".split())
#: What an opening element closes: those elements, unless one of the others lies between.
_TABLE = frozenset("table".split())
CLOSES = {tag: (frozenset(["p"]), frozenset("td th table button".split())) for tag in BREAKS - frozenset("br td th tr tbody thead tfoot option title summary legend caption html body".split())}
CLOSES |= {
    "li": (frozenset(["li"]), frozenset("ul ol table".split())), "dt": (frozenset("dt dd".split()), frozenset("dl table".split())), "dd": (frozenset("dt dd".split()), frozenset("dl table".split())), "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())), "tr": (frozenset(["tr"]), _TABLE), "tbody": (frozenset("thead tbody tfoot tr".split()), _TABLE), "tfoot": (frozenset("thead tbody tr".split()), _TABLE),
}
_RAW = "script|style|noscript|template|iframe|svg|textarea|select|title|canvas|object|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|</(?P<end>[a-z][a-z0-9:-]*)[^>]*(?:>|\Z)"
    r"|<(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-z/!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Shares of a page's text: of an article or main element to be chosen, of a container to be entered, of one with its heading.
SEMANTIC, ENTERED, WITH_HEADING = 0.25, 2 / 3, 0.8
#: Least characters for each field of a form that counts as article; of a container named otherwise that does, and its share of
#: the page's text where an article, main element or first heading lies elsewhere.
FIELD_CHARS, LIFTED_CHARS, ALONE = 100, 200, 0.9
PLAIN, LINKS, NAMED, FORM, ADVERT, COMMENT, NEVER = range(7)


class Element(NamedTuple):
    tag: str
    path: str
    kind: int
    parent: int
    name: str = ""  # its id, where nothing else speaks against it


class Page:
    """Blocks of a page in order, as (path of the container, text, characters in links, whether a heading), the article's alone."""

    def __init__(self, source: str):
        self.elements: list[Element] = []
        self.stack: list[int] = []
        self.fields: Counter[int] = Counter()
        self.raw: list[tuple[int, str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.links = 0
        self.in_link = self.in_heading = self.in_title = False
        self.name = ""
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if tag := m["tag"]:
                self._open(tag.lower(), m["attrs"] or "")
            elif end := m["end"]:
                self._close(end.lower())
            elif (m["raw"] or "").lower() in FIELDS:
                self._field()
        if at < len(source):
            self._text(source[at:])
        self._flush()
        self._sift()

    def _text(self, raw: str) -> None:
        if self.stack and self.elements[self.stack[-1]].kind == NEVER:
            return
        self.parts.append(raw)
        if self.in_link:
            self.links += len(raw)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.raw.append((self.stack[-1] if self.stack else -1, text, self.links, self.in_heading, self.in_title))
        self.parts, self.links = [], 0

    def _field(self) -> None:
        self.fields.update(k for k in self.stack if self.elements[k].kind == FORM)

    def _push(self, tag: str, path: str, kind: int, name: str = "") -> None:
        parent = self.stack[-1] if self.stack else -1
        if parent >= 0 and self.elements[parent].kind == NEVER:
            kind = NEVER
        self.elements.append(Element(tag, path, kind, parent, name))
        self.stack.append(len(self.elements) - 1)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.in_link = True
        if tag in FIELDS:
            self._field()
        here = self.elements[self.stack[-1]].path if self.stack else ""
        if tag not in BREAKS and tag not in SILENT:
            # Inline: an advert's text is cut out of its block.
            if attributes and tag not in VOID and self._kind(tag, attributes, ADVERTS) != PLAIN:
                self._push(tag, here, NEVER)
            return
        self._flush()
        if rule := CLOSES.get(tag):
            self._close_open(*rule)
            here = self.elements[self.stack[-1]].path if self.stack else ""
        if tag in VOID:
            return
        self.in_heading, self.in_title = tag == "h1", tag in TITLES
        kind = self._kind(tag, attributes, NOISE)
        if tag in CONTAINERS or tag in SILENT:
            self.in_link = False
            classes = ".".join(sorted({w.lower() for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() == "class" for w in re.findall(r"[^\W\d]+", a or b or c)})) if attributes else ""
            own = f"{tag}.{classes}" if classes else tag
            here = f"{here}>{own}" if here else own
        self._push(tag, here, kind, self.name if kind in (NAMED, ADVERT, COMMENT) else "")

    def _inside(self, *tags: str) -> bool:
        return any(self.elements[k].tag in tags for k in self.stack)

    def _kind(self, tag: str, attributes: str, words: frozenset) -> int:
        if tag in SILENT or (tag == "header" and not self._inside("article", "main")):
            return NEVER
        found, of_id, self.name = FORM if tag == "form" else PLAIN, PLAIN, ""
        for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), a or b or c
            if words is ADVERTS and name not in ("class", "id"):
                continue
            if name == "role":
                if value.lower() in ROLES and tag not in ("html", "body"):
                    found = max(found, FORM if value.lower() == "form" else NEVER)
            elif name in ("hidden", "aria-hidden"):
                if name == "hidden" or value.lower() == "true":
                    found = max(found, NAMED)
            elif tag not in ("html", "body", "main"):
                allowed = words
                if tag == "article":
                    allowed = COMMENTS
                elif words is NOISE and self._inside("article", "main"):
                    allowed = NOISE - {"header", "tags"}
                if name == "id":
                    of_id, self.name = (LINKS if value.lower() in allowed else PLAIN) if tag in OF_TEXT else max(PLAIN, *(named(t, allowed) for t in value.split())) if value.strip() else PLAIN, value
                    continue
                for token in value.split():
                    if tag not in TITLES and tag != "p" or token.lower() in allowed:
                        found = max(found, named(token, allowed))
        if found != PLAIN:
            self.name = ""
        return max(found, of_id)

    def _close_open(self, tags: frozenset, until: frozenset) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.elements[self.stack[k]].tag
            if tag in tags:
                del self.stack[k:]
                return
            if tag in until:
                return

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in BREAKS or tag in SILENT:
            self._flush()
            self.in_heading = self.in_title = False
        for k in range(len(self.stack) - 1, -1, -1):
            found = self.elements[self.stack[k]].tag
            if found == tag:
                del self.stack[k:]
                return
            if found in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                return

    def _sift(self) -> None:
        """Leave out the blocks that aren't article: of elements that never are, and of those named so that don't hold the page's text."""
        kinds = self._without_own_headings()
        chars, links, marked, whole, headed = Counter(), Counter(), Counter(), Counter(), Counter()
        for at, text, linked, heading, _ in self.raw:
            chain = list(self._chain(at))
            if any(kinds[k] == NEVER for k in chain):
                continue
            for k in (-1, *chain):
                whole[k] += len(text)
                headed[k] += heading
            # A wrapper of the whole page may be named for the comments that it holds too.
            if any(kinds[k] == COMMENT and not headed[k] for k in chain):
                continue
            marks = sum(self.elements[k].tag in ("article", "main") for k in chain) + heading
            for k in (-1, *chain):
                chars[k] += len(text)
                links[k] += linked
                marked[k] += marks

        def holds_article(k: int, kind: int) -> bool:
            if 2 * links[k] >= chars[k] or chars[k] < FIELD_CHARS * self.fields[k]:
                return False
            if kind == LINKS:
                return True
            if kind == COMMENT:
                return headed[k] > 0 and 2 * whole[k] > whole[-1]
            if marked[k]:
                return 2 * chars[k] > chars[-1]
            return kind != ADVERT and chars[k] >= LIFTED_CHARS and chars[k] > (ALONE if marked[-1] else 0.5) * chars[-1]

        silent: list[bool] = []
        for k, e in enumerate(self.elements):
            out = kinds[k] == NEVER or (kinds[k] != PLAIN and not holds_article(k, kinds[k]))
            silent.append(out or (e.parent >= 0 and silent[e.parent]))
        self.blocks = [(self.elements[at].path if at >= 0 else "", text, linked, heading) for at, text, linked, heading, _ in self.raw if at < 0 or not silent[at]]

    def _without_own_headings(self) -> list[int]:
        """The elements' kinds, but plain for those that only an id speaks against which is the text of the heading they begin with."""
        kinds, begun = [e.kind for e in self.elements], set()
        for at, text, _, _, title in self.raw:
            for k in self._chain(at):
                if k not in begun:
                    begun.add(k)
                    if title and self.elements[k].name and slug(self.elements[k].name) == slug(text):
                        kinds[k] = PLAIN
        return kinds

    def _chain(self, at: int) -> Iterator[int]:
        while at >= 0:
            yield at
            at = self.elements[at].parent

    def worths(self) -> Counter[str]:
        """Characters of the text in the containers with a path, those in links counted against it; '' is the page."""
        out: Counter[str] = Counter()
        for path, text, links, _ in self.blocks:
            worth = max(1, len(text) - 2 * links)
            out[""] += worth
            steps = path.split(">") if path else []
            for n in range(1, len(steps) + 1):
                out[">".join(steps[:n])] += worth
        return out

    def choice(self, worth: Counter[str] | None = None) -> str:
        """The path of the article's container, '' for the page as a whole."""
        worth = self.worths() if worth is None else worth
        if not worth:
            return ""
        tag = lambda p: p.rpartition(">")[2].split(".")[0]
        top = ""
        for name in ("article", "main"):
            some = [p for p in worth if tag(p) == name and worth[p] >= SEMANTIC * worth[""]]
            if some:
                top = max(some, key=lambda p: (worth[p], -len(p), p))
                if name == "article":
                    return top
                break
        best, least = top, ENTERED * worth[top]
        while inner := [p for p in worth if p and p != best and p.rpartition(">")[0] == best and worth[p] >= least]:
            best = max(inner, key=lambda p: (worth[p], p))
        heading = next((p for p, _, _, h in self.blocks if h), None)
        if heading is not None:
            wider = best
            while wider != top and not (heading == wider or heading.startswith(wider + ">")):
                wider = wider.rpartition(">")[0]
            if worth[best] >= WITH_HEADING * worth[wider]:
                best = wider
        return best

    def text(self, path: str) -> str:
        """The blocks of the containers with this path, and of those inside them."""
        inner = path + ">"
        return "\n".join(t for p, t, _, _ in self.blocks if not path or p == path or p.startswith(inner))


def slug(text: str) -> str:
    """Letters and digits of a text in lower case, as ids made from headings have them."""
    return "".join(c for c in text.lower() if c.isalnum())


def named(token: str, words: frozenset) -> int:
    """What a class or id says of its element: PLAIN, NAMED, ADVERT or COMMENT."""
    if token.lower() in WHOLE and words is not ADVERTS:
        return NAMED
    parts = [w.lower() for w in _WORD.findall(token)]
    for k, part in enumerate(parts):
        if part in words:
            if part in COMMENTS:
                return PLAIN if BEFORE & set(parts[:k]) or (parts[-1] in OF_PAGE and k < len(parts) - 1) else COMMENT
            if BEFORE & set(parts[:k]) or (parts[-1] in AT_END and k < len(parts) - 1) or (part == "header" and OF_ARTICLE & set(parts[:k])):
                return PLAIN
            return ADVERT if part in ADVERTS else NAMED
    return PLAIN


def host(url: Column) -> Column:
    """The host of a url in lower case, '' if there is none; ports and names before an @ don't count."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, n, seen``: how many pages of a host chose a path, and how many have it, from ``host, html``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            chosen: Counter[tuple[str, str]] = Counter()
            seen: Counter[tuple[str, str]] = Counter()
            for name, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source)
                worth = page.worths()
                seen.update((name, p) for p in worth)
                if worth:
                    chosen[name, page.choice(worth)] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([chosen[k] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], names=["host", "path", "n", "seen"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, n long, seen long").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def winners(pages: DataFrame) -> DataFrame:
    """``host, paths``: a host's winning paths, those first that most of the pages which have them chose."""
    counted = materialise(votes(pages).filter("n > 0"))
    all_votes = counted.groupBy("host").agg(F.sum("n").alias("all_n"))
    won = counted.join(all_votes, "host").filter((F.col("n") > 1) & (F.col("n") >= LEAST_SHARE * F.col("all_n")))
    order = F.struct((-F.col("n") / F.col("seen")).alias("share"), (-F.col("n")).alias("n"), "path")
    # A share of LEAST_SHARE bounds a host's paths by its inverse.
    return won.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("paths")).select("host", F.transform("paths", lambda p: p["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """The pages' columns and ``text``. Hosts' winners are written first, so Spark knows their size when it joins them."""
    own = [f for f in pages.schema.fields if f.name not in ("html", "host", "text", "paths")]
    named_pages = pages.select(*[f.name for f in own], F.coalesce(host(F.col("url")), F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    paths = materialise(winners(named_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for source, some in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
                page = Page(source)
                worth = page.worths()
                path = next((p for p in some or () if p in worth), None)
                texts.append(page.text(page.choice(worth) if path is None else path))
            columns = [batch.column(n) for n in batch.schema.names if n not in ("html", "paths")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*(n for n in batch.schema.names if n not in ("html", "paths")), "text"])

    joined = named_pages.join(paths, "host", "left").select(*[f.name for f in own], "html", "paths")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", text string"
    return joined.mapInArrow(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
