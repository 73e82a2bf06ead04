"""HTML main-text extraction with consensus host paths.

1. Each page's containers are scored by the text that they hold near (a block counts in full for its
   closest container, by halves for those around; link text counts against). A page's own container is the
   outermost article or main around the highest score, or else the outermost one that adds clean text
   (blocks that are not mostly links) to it.
2. Spark counts these containers by host and generalised tag-class path (digits become 0); each host's
   most frequent path wins. Counts are pre-aggregated, so a hot host is no hot task.
3. Each page is extracted again from the containers at its host's winning path. Where a page has none,
   or they lack more than a twentieth of its own container's clean text, its own is taken.

Within the container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out: by tag, and block containers (not headings, paragraphs or inline elements)
by ``role`` and by class and id names that are made of such words alone (``cookie-notice``, ``ad-slot``, but
not ``related-work``). Names that an article's own parts may have (``form``, ``search``, ``related``) count
only outside article and main, or where most of the text is links. ``hidden`` is an attribute of that name, or a
style of ``display: none`` or ``visibility: hidden``; values of other attributes never count. A form that holds most
of the page's text, headings or paragraphs among it, wraps the page and stays. A menu or sidebar that is still open where
the main part (or a menu where an article) begins was never closed, and ends there.

Defined cases: null and empty pages, and pages of nothing but such parts, give the empty text; pages without container are taken whole;
unclosed elements end with their parent; null urls are one host; repeated rows are extracted each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, materialize

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("nav header footer aside script style noscript template svg math iframe object canvas textarea select button head dialog menu audio video".split())
HOLDERS = frozenset("html body main article section div ul ol dl table tbody tr td th figure blockquote details fieldset span center".split()) - {"span"}
WHOLE = frozenset("html body main article".split())
#: Elements left out that an article cannot be in: where it begins, they have been left open.
OUTSIDE = {"main": frozenset("nav header footer aside".split()), "article": frozenset(["nav"])}
#: Elements of a page's own text; a form that holds some and most of the page's text is a wrapper.
TEXTUAL = frozenset("article main nav header footer h1 h2 p".split())
#: Block elements that are judged by their names.
NAMED = frozenset("div section ul ol dl table details figure fieldset center".split())
#: Words of class, id and role that mark what is not the article; others that do so outside it; and words that may stand beside them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar sidebar aside "
    "complementary contentinfo newsletter popup comment comments commentlist replies disqus".split()
)
DOUBTFUL = frozenset("header form search related recommended share sharing social notice notices alert skip copyright login signup subscribe subscription promo promotion sponsor banner modal overlay widget widgets reply respond".split())
BESIDE = frozenset("site page main global top bottom left right side post entry user reader box block area bar list links link container wrapper wrap inner outer slot unit section panel column col group item items the js thread".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|textarea|template|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
#: One attribute after another: a name, and a value if there is one; values are never looked for names.
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _marks(names: str) -> tuple[bool, bool]:
    """Whether a class, id or role of ``names`` is boilerplate; whether it may be."""
    sure = doubt = False
    for name in names.split():
        parts = {x for x in _SPLIT.split(name) if x}
        if parts and parts <= BOILERPLATE | DOUBTFUL | BESIDE:
            sure |= not parts.isdisjoint(BOILERPLATE)
            doubt |= not parts.isdisjoint(DOUBTFUL)
    return sure, doubt


def attributes(attrs: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name, character references decoded; of equal names the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(attrs):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


_DIGITS = re.compile(r"\d+")
#: A winning path is used on pages where it holds at least this share of the own container's clean text.
LEAST_SHARE = 0.95
BONUS = {"article": 3.0, "main": 2.0}


class Page:
    """Blocks of text outside boilerplate, and containers: [path, score, first block, end block, parent, clean text]."""

    def __init__(self, html: str, named: bool = True):
        """With ``named`` block elements are judged by their class, id and role."""
        self.blocks: list[str] = []
        doubts: list[list] = []  # of doubtful elements: characters of text, of links, first block, end block, whether it is a form, textual elements in it
        self.named_out = False  # whether anything was left out for its name
        self.containers: list[list] = []
        stack: list[tuple[str, int, bool, int]] = []  # tag, container (-1: none), skipped, doubt (-1: none)
        run: list[str] = []
        linked = skipped = at = 0
        in_link = False

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(unescape("".join(run)).split())
                run.clear()
                if text:
                    self.blocks.append(text)
                    for _, _, _, k in stack:
                        if k >= 0:
                            doubts[k][0] += len(text)
                            doubts[k][1] += linked
                    worth = len(text) - 2 * linked
                    clean = max(0, worth)
                    for _, c, _, _ in reversed(stack):
                        if c >= 0:
                            self.containers[c][1] += worth
                            self.containers[c][5] += clean
                            worth /= 2
            linked = 0

        def close(n: int) -> None:
            nonlocal skipped
            flush()
            while len(stack) > n:
                _, c, off, k = stack.pop()
                skipped -= off
                if k >= 0:
                    doubts[k][3] = len(self.blocks)
                if c >= 0:
                    self.containers[c][3] = len(self.blocks)

        for m in _TAG.finditer(html):
            if not skipped and m.start() > at:
                run.append(html[at : m.start()])
                linked += (m.start() - at) * in_link
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if tag == "a":
                in_link = not m["end"]
            if m["end"]:
                if tag not in INLINE:
                    n = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                    if n is None:
                        flush()
                    else:
                        close(n)
                elif stack and stack[-1][0] == tag:
                    close(len(stack) - 1)
                continue
            attrs = m["attrs"]
            classes, sure, doubt, hidden = "", False, False, False
            if skipped and tag in OUTSIDE:
                n = next((i for i, x in enumerate(stack) if x[2]), 0)
                if stack[n][0] in OUTSIDE[tag]:
                    close(n)
            if attrs and tag not in WHOLE:
                found = attributes(attrs)
                hidden = "hidden" in found or "style" in found and _UNSEEN.search(found["style"]) is not None
                classes = found.get("class", "").lower()
                if named and tag in NAMED:
                    sure, doubt = _marks(" ".join((classes, found.get("id", "").lower(), found.get("role", "").lower())))
            off = tag in SKIP or hidden or sure or doubt and not any(x in BONUS for x, _, _, _ in stack)
            self.named_out |= off and tag not in SKIP and not hidden
            doubt |= tag == "form"
            if tag in TEXTUAL:
                for _, _, _, k in stack:
                    if k >= 0:
                        doubts[k][5] += 1
            if off and tag not in VOID and not attrs.endswith("/"):
                flush()
                stack.append((tag, -1, True, -1))
                skipped += 1
            elif tag not in INLINE:
                flush()
                if tag in HOLDERS or tag == "form":
                    c = -1
                    if not skipped and tag in HOLDERS:
                        parent = next((x for _, x, _, _ in reversed(stack) if x >= 0), -1)
                        above = self.containers[parent][0] if parent >= 0 else ""
                        name = tag + "".join(sorted("." + _DIGITS.sub("0", x) for x in classes.split()))
                        c = len(self.containers)
                        self.containers.append([f"{above}>{name}", 0.0, len(self.blocks), 0, parent, 0])
                    if doubt and not skipped:
                        doubts.append([0, 0, len(self.blocks), 0, tag == "form", 0])
                    stack.append((tag, c, False, len(doubts) - 1 if doubt and not skipped else -1))
        if not skipped and at < len(html):
            run.append(html[at:])
        close(0)
        whole = sum(map(len, self.blocks))
        for text, links, first, end, form, textual in doubts:
            if not (textual and 2 * text > whole) if form else 2 * links > text:
                self.blocks[first:end] = [""] * (end - first)
        for c in self.containers:
            c[1] *= BONUS.get(self.tag(c), 1.0)

    @staticmethod
    def tag(container: list) -> str:
        return container[0].rpartition(">")[2].partition(".")[0]

    def best(self) -> list | None:
        best = top = max(self.containers, key=lambda c: c[1], default=None)
        marked = None
        while top is not None:
            if self.tag(top) in BONUS:
                marked = top
            if top[5] > best[5]:
                best = top
            top = self.containers[top[4]] if top[4] >= 0 else None
        return marked or best

    def text(self, path: str | None) -> str:
        best = self.best()
        if best is None:
            return " ".join(filter(None, self.blocks))
        at = [c for c in self.containers if c[0] == path]
        within = [c for c in at if best[2] <= c[2] and c[3] <= best[3] or c[2] <= best[2] and best[3] <= c[3]]
        if sum(c[5] for c in within) < LEAST_SHARE * best[5] or not within:
            at = [best]
        out, done = [], 0
        for c in at:  # in page order; nested ones are in their parents
            out += self.blocks[max(done, c[2]) : c[3]]
            done = max(done, c[3])
        return " ".join(filter(None, out))


def extract_text(html: str, path: str | None = None) -> str:
    page = Page(html)
    text = page.text(path)
    if not text and page.named_out and any(page.tag(c) == "article" for c in page.containers):
        # An article of nothing but parts left out for their names: the names say nothing there.
        return Page(html, named=False).text(path)
    return text


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        host, path, vote = [], [], []
        for h, html in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
            best = Page(html.as_py() or "").best()
            if best is not None:
                host.append(h)
                path.append(best[0])
                vote.append(1)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(vote, pa.int64())], names=["host", "path", "vote"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract_text(h.as_py() or "", p) for h, p in zip(b.column("html"), b.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), b.column("path")], names=["page_id", "url", "text", "n_chars", "host_path"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(pages: DataFrame) -> DataFrame:
    """``host, path``: the path of each host with the most votes (ties: the first by name)."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_votes, "host string, path string, vote long")
    sums = votes.groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    return sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, host_path`` of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    paths = checked(materialize(winning_paths(pages), "host-paths"))
    rows = pages.withColumn("host", host_of(F.col("url"))).join(paths, "host", "left").select("page_id", "url", "html", "path")
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long, host_path string")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("host_path")
