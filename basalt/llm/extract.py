"""HTML extraction by tag-path ratios.

A page becomes blocks of text, each with the path of tags and classes that leads to it from the root. Length,
sentence marks and linked characters of the text are summed per path; the ratios of these sums to the path's
number of blocks are fused into one, which is smoothed over neighbouring blocks and weighed by what marks the
path. Two thresholds, shares of the page's greatest ratio, select the content: blocks above the upper one are
the article, and so are blocks above the lower one that lie among those, such as headings, lists and captions.

Only elements whose names or roles say that they are no article (nav, footer, form, script and so on), and hidden
ones, take no part. A class or id that names something else (a menu, an advert, comments) lowers its path's
ratio, an <article> or <main> raises it; neither decides by itself.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# HTML's void elements, block elements, and elements whose start ends another.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot body html head title".split())
SIBLINGS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}
SCOPES = frozenset("ul ol dl table select article aside section div main body".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml xmp noembed noframes".split())

#: Elements and roles that are no article, and words that, as the last of a class or id, name what is none.
NEVER = frozenset("nav footer aside form script style noscript template button select head iframe svg textarea object canvas audio video search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disclaimer disqus footer gdpr header login masthead menu menubar modal nav navbar navigation navigational newsletter notice notices notification outbrain pager pagination paywall popup promo promos promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
#: Words that say how an element is laid out, not what it is; they are passed over when its last word is looked for.
_LAYOUT = frozenset("area bar block box button buttons container form group holder inner item items link links list module outer panel row section slot unit wrap wrapper zone".split())
#: Elements in which a block may lie within the container of the text around it.
_WITHIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd menu blockquote figure figcaption table caption tbody thead tfoot tr td th pre address details summary hgroup header".split())

#: Elements of text, which in an article no name of theirs takes out.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())

#: What a path's ratio is multiplied by where it is marked as an article, and for each element that a hint is about.
ARTICLE, HINTED = 1.5, 0.05
#: Shares of the page's greatest ratio above which a block is the article, and above which it is if it lies within.
UPPER, LOWER = 0.35, 2e-5

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"<]*+\"|'[^'<]*+'|[^'\">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HINT_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
#: Words after which a hint says what the element has or lacks, not what it is.
_ABOUT = frozenset("has have no not with without".split())
_MARKS = re.compile(r"[.,;:!?…。、，！？]")
#: How a copyright notice begins; outside an article such a block counts as hinted.
_NOTICE = re.compile(r"(?:copyright\s*)?(?:©|\(c\))|copyright\s*\d{4}", re.I)


def _hinted(value: str) -> bool:
    """A class or id is named after what is no article: its last word, but for layout and numbers, is a hint that no has, no or with precedes."""
    for name in value.split():
        ws = [w.lower() for w in _HINT_WORDS.findall(name)]
        while len(ws) > 1 and (ws[-1] in _LAYOUT or ws[-1].isdigit()):
            ws.pop()
        if ws and ws[-1] in HINTS and not _ABOUT.intersection(ws[:-1]):
            return True
    return False


def _reading(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Of an element's attributes: its class for the path, whether there is a hint in them, whether they take it out."""
    name, hinted, out, opened = "", False, False, False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "style":
            out |= bool(_HIDDEN.search(value))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            out = True
        elif key == "role":
            out |= not ROLES.isdisjoint(value.lower().split()) and tag not in ("article", "main")
        elif key == "open":
            opened = True
        elif key in ("class", "id"):
            hinted |= _hinted(value)
            if key == "class":
                name = value
    return name, hinted, out or tag == "dialog" and not opened


@dataclass(frozen=True)
class Block:
    """A run of text without a block element's start or end in it."""

    text: str
    element: int  # the innermost block element
    linked: int  # characters in links
    path: int
    weight: float  # of the path's marks
    article: bool


class Page:
    """Blocks and elements of one page."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.out, self.article, self.weight = [-1], [""], [0], [False], [False], [1.0]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.stack = [0]
        self.text: list[str] = []
        self.linked, self.links = 0, 0
        self.open_tags: dict[str, int] = {}
        self._read(source)
        self._close_block()

    def _close_block(self) -> None:
        if self.text:
            top = self.stack[-1]
            if not self.out[top] and (text := " ".join("".join(self.text).split())):
                at = next((e for e in reversed(self.stack) if self.tag[e] in BLOCK), 0)
                notice = HINTED if not self.article[at] and _NOTICE.match(text) else 1.0
                self.blocks.append(Block(text, at, min(self.linked, len(text)), self.path[at], self.weight[top] * notice, self.article[at]))
            self.text, self.linked = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        top = self.stack[-1]
        name, hinted, out = _reading(tag, attrs) if attrs.strip() else ("", False, tag == "dialog")
        article = tag in ("article", "main")
        if tag in ("html", "body"):
            hinted, out = False, False
        hinted = hinted and not (self.article[top] and tag in _TEXT)
        key = (self.path[top], f"{tag}.{name}")
        self.parent.append(top)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.out.append(self.out[top] or out or tag in NEVER or tag == "header" and not self.article[top])
        self.weight.append(self.weight[top] * (HINTED if hinted else 1.0) * (ARTICLE if article and not self.article[top] else 1.0))
        self.article.append(self.article[top] or article)
        self.stack.append(len(self.tag) - 1)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.links += tag == "a"

    def home(self, element: int) -> int:
        """The container that a block's element lies in."""
        while self.tag[element] in _WITHIN:
            element = self.parent[element]
        return element

    def _pop_to(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.links -= self.tag[e] == "a"
            self.open_tags[self.tag[e]] -= 1
        del self.stack[depth:]

    def _find(self, tags: tuple[str, ...], stop: frozenset[str]) -> int:
        """Depth of the innermost open element of these tags, 0 if one in stop comes first."""
        if not any(self.open_tags.get(t) for t in tags):
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                return depth
            if tag in stop:
                return 0
        return 0

    def _say(self, text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            self.text.append(text)
            if self.links:
                self.linked += len(text.strip())

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">")  # beyond the last one no tag ends
        while at <= last and (m := _TAG.search(source, at)):
            self._say(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in BLOCK:
                    self._close_block()
                if depth := self._find((tag,), frozenset() if tag in BLOCK else BLOCK):
                    self._pop_to(depth)
                continue
            if tag == "br":
                self.text.append(" ")
                continue
            if tag in BLOCK:
                self._close_block()
                if tag in CLOSES_P and (depth := self._find(("p",), SCOPES)):
                    self._pop_to(depth)
            if tag in SIBLINGS and (depth := self._find(SIBLINGS[tag], SCOPES)):
                while depth:
                    self._pop_to(depth)
                    depth = self._find(SIBLINGS[tag], SCOPES)
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            self._open(tag, m[3] or m[6] or "")
        self._say(source[at:].partition("<!--")[0])


def path_sums(blocks: list[Block]) -> dict[int, tuple[int, int, int, int]]:
    """Of each path: characters, sentence marks, linked characters and blocks."""
    sums: dict[int, tuple[int, int, int, int]] = {}
    for b in blocks:
        n, marks, linked, k = sums.get(b.path, (0, 0, 0, 0))
        sums[b.path] = (n + len(b.text), marks + len(_MARKS.findall(b.text)), linked + b.linked, k + 1)
    return sums


def path_ratios(blocks: list[Block]) -> list[float]:
    """The fused ratio of each block's path, smoothed over its neighbours on the page and weighed.

    Length and sentence marks a block each go from 0 to 1, so one very long block doesn't put all others in the shade; a path
    that holds little of the page's text counts less. Linked text counts against a path, in an article less so.
    """
    sums = path_sums(blocks)
    total = sum(n for n, *_ in sums.values())
    fused = {p: (n / (n + 80 * k) * (marks + 0.3 * k) / (marks + 1.5 * k)) ** 1.5 * (n / total) ** 0.25 for p, (n, marks, _, k) in sums.items()}
    x = [fused[b.path] for b in blocks]
    most = max(x, default=0)
    near = [0.0, *x, 0.0]
    out = []
    for i, b in enumerate(blocks):
        n, _, linked, _ = sums[b.path]
        words_of_links = 1 - 0.7 * linked / n if b.article else (1 - linked / n) ** 4
        smooth = (x[i] * (0.25 * near[i] + 0.5 * x[i] + 0.25 * near[i + 2])) ** 0.5
        out.append((smooth if x[i] < most else x[i]) * b.weight * words_of_links)
    return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, one to a line; empty for a null or empty page."""
    if not source:
        return ""
    page = Page(source)
    blocks = page.blocks
    ratio = path_ratios(blocks)
    most = max(ratio, default=0)
    if not most:
        return ""
    sure = [r >= UPPER * most for r in ratio]
    homes = {page.home(b.element) for b, ok in zip(blocks, sure, strict=True) if ok}
    below = [e in homes and page.tag[e] not in ("", "html", "body") for e in range(len(page.tag))]
    for e in range(1, len(below)):
        below[e] = below[e] or below[page.parent[e]]
    least_weight = min(b.weight for b, ok in zip(blocks, sure, strict=True) if ok)
    first, last = sure.index(True), len(sure) - 1 - sure[::-1].index(True)
    kept = []
    for i, b in enumerate(blocks):
        among = first < i < last or page.home(b.element) in homes or below[b.element] or page.tag[b.element] == "h1"
        if sure[i] or among and ratio[i] >= LOWER * most and (b.weight >= least_weight or b.weight >= 1):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A page that is null, empty or without an article has an empty text. Ids and urls are passed on as they are,
    null or repeated; other columns are ignored; an empty table gives no rows. Pages are read whole, one at a
    time, in linear time; nothing is shuffled.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
