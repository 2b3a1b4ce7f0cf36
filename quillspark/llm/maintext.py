"""Main text of web pages by composite text density.

A page becomes a tree of elements, without those that never hold an article's text (scripts, styles, menus and the like, by
element or role). Forms, and elements whose class or id has a token made of marks alone (``sidebar``, ``cookie-notice``; not
``has-sidebar``), go too, unless they hold most of the page's text or an article or main element. Inside an article only
clear marks count, and ids of headings and sections count nowhere, as they repeat what a heading says. If nothing would be
left, no mark counts. Each node gets its characters per tag, adjusted by how many of
its characters and tags are links' (and by the whole body's share of link characters), and the sum of its children's
densities. The subtree with the greatest sum is text; the least density on the path from the body to it is the threshold,
and under every node that reaches it the subtree of the greatest sum is taken too. An element's name only widens what was
taken so: to all of the outermost ``article`` around it, with heading and short paragraphs, and the greatest subtree, if no
``article`` holds it, to the ``main`` element around it.

A task reads one page at a time; nothing is shuffled. Defined results: null, empty or textless html gives an empty
text; unclosed and stray tags, unclosed comments and quotes are read as browsers roughly do; equal pages give equal
texts; of nodes with equal sums the first in the page is taken; a very long page takes memory in proportion to itself, in
one task; an empty table gives an empty result; extra columns stay, but for text and n_chars."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspark.llm.tables import table

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noframes noembed".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never are an article's text.
_DROPPED = frozenset("head script style noscript template nav footer aside button select option textarea input label iframe object embed svg math canvas audio video map menu dialog title xmp noframes noembed".split())
#: Elements that are not an article's text unless they hold most of the page.
_FORMS = frozenset(["form", "fieldset"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words of class or id that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adsbygoogle banner promo promos promotion sponsor sponsored sponsors sidebar sidebars rail comment comments commentlist disqus respond replies discussion reactions thoughts cookie cookies consent gdpr notice notices notification alert disclaimer newsletter subscribe subscription signup login popup modal overlay paywall share sharing social related recommended recommendations trending breadcrumb breadcrumbs nav navbar navigation menu menus footer masthead toolbar topbar pagination pager widget widgets search skip tags".split()
)
#: Marks that are an article's own subjects too; inside an article they say nothing.
_SUBJECTS = frozenset("discussion reactions thoughts notice notices notification alert disclaimer banner promotion advertising consent cookie cookies rail search skip tags social sharing share related recommended recommendations trending respond replies subscription signup login navigation menu menus toolbar widget widgets modal overlay popup footer sponsor sponsors".split())
#: Words that beside a mark only say where or what box it is.
_NEUTRAL = frozenset("area bar block body bottom box buttons container content form global inner item items left link links list main outer page primary reader readers right secondary section site slot thread top unit user users visitor visitors wrap wrapper".split())
_COMMENTS = frozenset(["comment", "comments", "commentlist"])
_HEADERS = frozenset(["header", "siteheader", "pageheader"])
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th", "thead": "tr td th"}
_CLOSES = {k: frozenset(v.split()) for k, v in _CLOSES.items()}
_UNTIL = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
_CLEAR, _ALL = _MARKS - _SUBJECTS, _MARKS | _HEADERS
#: Links from which a list of nothing else is judged by its own density inside an article.
_LINKS = 5
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _marked(value: str, marks: frozenset[str]) -> bool:
    """Whether a token of a class or id is made of marks, and of words that only say where or what box it is."""
    for token in value.split():
        words = {w.lower() for w in _CAMEL.findall(token)}
        if words <= marks | _NEUTRAL and not words.isdisjoint(marks):
            return True
    return False


def _unwanted(tag: str, attrs: str, inside: bool) -> int:
    """2 for an element that is left out with all that it holds, 1 for one that is so unless it holds most of the page's
    text or an article. ``inside``: it is in an article or main element."""
    if tag in _DROPPED or tag == "header" and not inside:
        return 2
    level = int(tag in _FORMS)
    if not attrs or tag in ("html", "body", "main"):
        return level
    found = [(name.lower(), "".join(values)) for name, *values in _ATTRIBUTE.findall(attrs)]
    if tag == "article":
        return int(any(name == "class" and _marked(value, _COMMENTS) for name, value in found))
    section = tag in _HEADINGS or tag == "section" or any(name == "class" and "section" in value.split() for name, value in found)
    for name, value in found:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2
        elif name == "role":
            if value.lower() == "form":
                level = 1
            elif value.lower() in _ROLES:
                return 2
        elif value and not (name == "id" and section):
            if _marked(value, _CLEAR if inside else _ALL):
                level = 1
    return level


class _Page:
    """Nodes in page order (0 is the root), with the blocks of text and the node each stands in."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.ends = ["#root"], [-1], [0]
        self.chars, self.link_chars, self.count, self.links = [0], [0], [0], [0]
        self.marked = [False]
        self.refused: list[int] = []  # link lists that an article or main holds
        self.pieces: list[list[tuple[int, str]]] = []  # by block of text
        self._read(html)
        gone = self._gone()
        for i in range(len(self.tags) - 1, 0, -1):
            p = self.parents[i]
            self.ends[p] = max(self.ends[p], self.ends[i])
            if gone[i]:
                self.chars[i] = self.link_chars[i] = self.count[i] = self.links[i] = 0
                continue
            self.chars[p] += self.chars[i]
            self.link_chars[p] += self.link_chars[i]
            self.count[p] += self.count[i] + 1
            self.links[p] += self.links[i] + (self.tags[i] == "a")
        self.blocks: list[tuple[int, str]] = []
        for pieces in self.pieces:
            kept = [(i, part) for i, part in pieces if not gone[i]]
            whole = " ".join("".join([part for _, part in kept]).split())
            if whole:
                self.blocks.append((next(i for i, part in kept if part and not part.isspace()), whole))

    def _gone(self) -> list[bool]:
        """Whether a node lies in a marked element that holds neither most of the page's text nor an article or main."""
        n = len(self.tags)
        if not any(self.marked):
            return [False] * n
        held, keeps = self.chars[:], [False] * n
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            held[p] += held[i]
            keeps[p] |= keeps[i] or self.tags[i] in ("article", "main") and not self.marked[i] and held[i] > 0
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parents[i]] or self.marked[i] and not keeps[i] and 2 * held[i] <= held[0]
        return gone if any(c and not g for c, g in zip(self.chars, gone, strict=True)) else [False] * n

    def _read(self, html: str) -> None:
        stack, skipped = [0], 0  # skipped: the depth at which an unwanted element began
        pieces: list[tuple[int, str]] = []
        links, inside, paragraphs = 0, 0, 0
        at = 0

        def text(part: str, unescaped: bool = True) -> None:
            if skipped or not part:
                return
            if unescaped and "&" in part:
                part = unescape(part)
            node = stack[-1]
            n = len(part) - part.count(" ")
            pieces.append((node, part))
            self.chars[node] += n
            if links:
                self.link_chars[node] += n

        def flush() -> None:
            if pieces:
                self.pieces.append(pieces[:])
                pieces.clear()

        def pop() -> None:
            nonlocal skipped, links, inside, paragraphs
            tag = self.tags[stack.pop()] if not skipped else hidden.pop()
            if skipped:
                if not hidden:
                    skipped = 0
                return
            links -= tag == "a"
            inside -= tag in ("article", "main")
            paragraphs -= tag == "p"
            if tag in _BLOCK:
                flush()

        hidden: list[str] = []  # open tags inside an unwanted element
        size = len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if not m:
                text(html[at:])
                break
            if m.start() > at:
                text(html[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                text(m["cdata"], False)
                continue
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
            if end:
                if tag == "br" and not skipped:
                    text(" ")
                open_tags = hidden if skipped else stack
                for depth in range(len(open_tags) - 1, -1, -1):
                    own = open_tags[depth] if skipped else self.tags[open_tags[depth]]
                    if own == tag:
                        for _ in range(len(open_tags) - depth):
                            pop()
                        break
                    if tag not in _BLOCK and own in _BLOCK:
                        break
                else:
                    # the end of what holds an unwanted element that nobody closed
                    if skipped and tag in _BLOCK and tag != "p" and any(self.tags[i] == tag for i in stack):
                        hidden.clear()
                        skipped = 0
                        while stack[-1] and self.tags[stack[-1]] != tag:
                            pop()
                        if stack[-1]:
                            pop()
                continue
            if tag in _VOID:
                if not skipped:
                    if tag == "br":
                        text(" ")
                    elif tag == "hr":
                        flush()
                continue
            if tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = html.find(">", close.end()) + 1 or size if close else size
                continue
            if attrs.endswith("/") and tag in ("svg", "math", "path"):
                continue
            if skipped:
                if tag in ("p", "li") and tag in hidden[1:]:
                    while hidden[-1] != tag:
                        hidden.pop()
                    hidden.pop()
                hidden.append(tag)
                continue
            if tag in _BLOCK and paragraphs:
                while self.tags[stack[-1]] != "p":
                    pop()
                pop()
            if tag in _CLOSES:
                for i in reversed(stack):
                    if self.tags[i] in _CLOSES[tag]:
                        while self.tags[stack[-1]] not in _CLOSES[tag]:
                            pop()
                        pop()
                        if tag not in ("tr", "tbody", "tfoot", "thead"):
                            break
                    elif self.tags[i] in _UNTIL.get(tag, ("table",)):
                        break
            if tag in _BLOCK:
                flush()
            unwanted = _unwanted(tag, attrs, inside > 0)
            if unwanted == 2:
                hidden.append(tag)
                skipped = len(stack)
                continue
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.marked.append(unwanted == 1)
            self.ends.append(node)
            for counts in (self.chars, self.link_chars, self.count, self.links):
                counts.append(0)
            stack.append(node)
            links += tag == "a"
            inside += tag in ("article", "main")
            paragraphs += tag == "p"
        flush()

    def densities(self) -> list[float]:
        body = self.tags.index("body") if "body" in self.tags else 0
        share = self.link_chars[body] / (self.chars[body] or 1)
        out = []
        for c, lc, t, lt in zip(self.chars, self.link_chars, self.count, self.links, strict=True):
            if not c:
                out.append(0.0)
                continue
            ratio = (c / (lc or 1)) * ((t or 1) / (lt or 1))
            base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
            out.append(c / (t or 1) * max(0.0, math.log(ratio) / math.log(base)) if ratio > 1 and base > 1 else (c / (t or 1) if not lc else 0.0))
        return out

    def chosen(self) -> list[tuple[int, int]]:
        """Ranges of nodes that are the main text."""
        density = self.densities()
        sums = [0.0] * len(self.tags)
        for i in range(1, len(self.tags)):
            sums[self.parents[i]] += density[i]
        if not self.chars[0]:
            return []
        for i, c in enumerate(self.count):
            if not c:
                sums[i] = density[i]  # a leaf has its own text alone
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        path = [best]
        while self.parents[path[-1]] >= 0:
            path.append(self.parents[path[-1]])
        upto = next((k for k, i in enumerate(path) if self.tags[i] == "body"), len(path) - 1)
        threshold = min(density[i] for i in path[: upto + 1])
        # the greatest sum in each subtree
        most = list(range(len(sums)))
        for i in range(len(sums) - 1, 0, -1):
            p = self.parents[i]
            if sums[most[i]] > sums[most[p]] or sums[most[i]] == sums[most[p]] and most[i] < most[p]:
                most[p] = most[i]
        taken = {most[i] for i in range(len(sums)) if self.chars[i] and density[i] >= threshold}
        # the outermost article around each node
        around = [-1] * len(sums)
        for i in range(1, len(sums)):
            around[i] = around[self.parents[i]]
            if around[i] < 0 and self.tags[i] == "article":
                around[i] = i
        wide = {around[i] if around[i] >= 0 else i for i in taken}
        if around[best] < 0:
            wide.update(i for i in path if self.tags[i] == "main")
        # what the widening brings in must pass by its own density where links are nearly all of it
        self.refused = [i for i in range(len(sums)) if density[i] < threshold and self.links[i] >= _LINKS and 10 * self.link_chars[i] >= 9 * self.chars[i] and i not in taken]
        return [(i, self.ends[i]) for i in wide]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page(html)
    ranges = page.chosen()
    if not ranges:
        return ""
    covered: list[tuple[int, int]] = []
    for a, b in sorted(set(ranges)):
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    lists: list[tuple[int, int]] = []
    for i in page.refused:
        if not lists or i > lists[-1][1]:
            lists.append((i, page.ends[i]))

    def inside(ranges: list[tuple[int, int]], node: int) -> bool:
        i = bisect_right(ranges, (node, len(page.tags))) - 1
        return i >= 0 and node <= ranges[i][1]

    out = [text for node, text in page.blocks if inside(covered, node) and not inside(lists, node)]
    return "\n\n".join(out)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars; other columns stay as they are."""
    pages = pages.drop("text", "n_chars")
    schema = StructType([*pages.schema, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def op9_text_density_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
