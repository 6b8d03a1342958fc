"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Each has a weight: words score
positive where pages usually hold content, negative in links, menus, footers
and the like; tags score negative.  The weights are log odds, learned from
labelled pages: those that mark their content themselves with one of
``MARKS``.  The mark itself is no feature, so the weights also serve pages
without it.  One linear scan (the largest sum of a run) finds the region; what
lies in excluded containers inside it is left out, and blocks become lines.
A container costs a run at most ``CONTAINER``, so that one inside an article
does not part it.  A region that lies mostly in a marked element is widened to
the whole of it, so that links and notices at its edges stay; there a class of a
paragraph or of a part of one names no container.  A form, or an element that only a hint excludes, is a wrapper
if it holds most of the page's words outside links, and excludes nothing; ``main``,
or an ``article`` with most of these words, is content in any container.

Character references are decoded, white space inside a block becomes one space.
A line break tag counts as white space.  Null and empty pages, and pages where
nothing scores above zero, give an empty text.  Pages of any length are read
whole.  Repeated rows are extracted each; other columns are ignored.  Without a
labelled page, fixed weights serve.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bounded, named

#: Labelled pages that the weights are learned from, at most; and kinds of tokens that get a weight of their own.
SAMPLE = 2_000
KINDS = 4_096
MARKS = ("article", "main")
CONTAINER = 6.0
#: Share of a page's unlinked words above which an element is its wrapper, not beside the article; ``SURE``: whose class,
#: id or role is a hint as a whole.
MOST = 0.5
SURE = 0.9

# Elements of HTML by their role.
_RAW = (
    *"script style noscript template iframe textarea title svg annotation-xml annotation select object".split(),
)
_VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
_BLOCK = {
    *"address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure".split(),
    *"footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section".split(),
    *"summary table tbody td tfoot th thead tr ul".split(),
}
_EXCLUDED = {*"aside button dialog footer form head header menu nav fieldset".split()}
# Elements that hold text, not other parts of a page: inside an article their class names no container.
_TEXT = {
    *"a abbr b blockquote cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li mark p pre q small span strong sub sup".split(),
    *"td th time u".split(),
}
_ENDS_P = _BLOCK - {"body", "html", "head", "option", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
# Words in class, id and role that name something beside the article.
_HINTS = (
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments "
    "complementary consent contentinfo cookie cookies disclaimer footer footnav gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar tracking warning widget"
)
_BESIDE = frozenset(_HINTS.split())

# Attributes that stand without a value.
_BOOLEAN = {
    *"allowfullscreen async autofocus autoplay checked controls default defer disabled download formnovalidate hidden".split(),
    *"inert ismap itemscope loop multiple muted nomodule novalidate open playsinline readonly required reversed selected".split(),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    # An empty foreign element; the others below have a name of their own, not the beginning of a longer one.
    r"|<(?:svg|annotation|annotation-xml)(?:\s(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)?/>"
    r"|<(?P<raw>" + "|".join(_RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ROLE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PART = re.compile(r"[a-zA-Z]+")


def _no_tag(source: str, match: re.Match) -> bool:
    """Whether what looks like a tag is a comparison: a word right before it, and plain words instead of attributes."""
    before = source[match.start() - 1 : match.start()]
    words = match["rest"].split()
    plain = words and all(w.isalnum() and w.lower() not in _BOOLEAN for w in words)
    return bool(not match["end"] and len(match["name"]) <= 2 and before.isalnum() and plain)


class Page:
    """The tokens of a page: for each its kind, how many it stands for, and what the text needs."""

    def __init__(self, source: str, wrappers: set[int] | None = None):
        self.kinds: list[str] = []
        self.sizes: list[int] = []
        self.texts: list[str | None] = []  # of words; None for a tag
        self.breaks: list[bool] = []  # whether a tag ends a block
        self.kept: list[bool] = []  # whether words lie outside excluded containers
        self.inside: list[bool] = []  # whether a token lies in a marked element
        # Name, place, excluded, marked, and where the enclosing elements begin that may be wrappers.
        self.stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = []
        self.unlinked = 0
        self.held: dict[int, list[float]] = {}  # of such an element: its unlinked words, and the share it must exceed
        self.wrappers = wrappers
        self._read(source)
        if wrappers is None:
            found = {k for k, (n, share) in self.held.items() if n > share * self.unlinked}
            if found:
                self.__init__(source, found)

    def _read(self, source: str) -> None:
        at = 0
        for match in _TOKEN.finditer(source):
            if match.start() > at:
                self._words(source[at : match.start()])
            at = match.end()
            name = match["name"]
            if name and _no_tag(source, match):
                self._words(match.group())
            elif name:
                self._tag(name.lower(), bool(match["end"]), match["rest"], match.start())
        if at < len(source):
            self._words(source[at:])

    def _top(self) -> tuple[str, str, bool, bool, tuple[int, ...]]:
        return self.stack[-1] if self.stack else ("", "", False, False, ())

    def _words(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        _, place, excluded, marked, around = self._top()
        link = any(name == "a" for name, *_ in self.stack[-4:])
        size = len(text.split())
        if not link:
            self.unlinked += size
            for k in around:
                self.held[k][0] += size
        self._add(f"word {place}{' a' if link else ''}", size, text, False, not excluded, marked)

    def _add(self, kind: str, size: int, text: str | None, ends: bool, kept: bool, marked: bool) -> None:
        self.kinds.append(kind)
        self.sizes.append(size)
        self.texts.append(text)
        self.breaks.append(ends)
        self.kept.append(kept)
        self.inside.append(marked)

    def _tag(self, name: str, end: bool, rest: str, at: int) -> None:
        place, beside = self._top()[1:3]
        if end:
            if any(x[0] == name for x in self.stack):
                while self.stack.pop()[0] != name:
                    pass
        else:
            self._close_implied(name)
        _, outer, excluded, marked, around = self._top()
        place = place if end else outer
        kept = not (beside if end else excluded)
        if not end and name not in _VOID and not rest.endswith("/"):
            values = [v.lower() for m in _ROLE.finditer(rest) for v in m.groups() if v]
            hints = sorted({w for v in values for w in _PART.findall(v)} & _BESIDE)
            mark = name in MARKS
            # A header inside the article holds its title.
            apart = bool(hints) and name not in ("body", "html", *MARKS) and not (marked and name in _TEXT)
            hinted = (apart and name not in _EXCLUDED) or name == "form"
            apart = apart or name in _EXCLUDED and not (name == "header" and marked)
            if hinted or mark and excluded and not marked:
                sure = hinted and any(w in _BESIDE for v in values for w in v.split())
                self.held[at] = [0, SURE if sure else 0 if name == "main" else MOST]
                around = (*around, at)
                if at in (self.wrappers or ()):
                    apart = False
                    if mark:
                        excluded, place, kept = False, "", True
            if apart:
                place, kept = f"{name}.{hints[0]}" if hints else name, False
            self.stack.append((name, place, excluded or apart, marked or mark, around))
        kind = f"tag {'/' if end else ''}{name} {place}".rstrip()
        self._add(kind, 1, " " if name == "br" else None, name in _BLOCK, kept, marked)

    def _close_implied(self, name: str) -> None:
        if name in _ENDS_P and any(x[0] == "p" for x in self.stack):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    del self.stack[i:]
                    break
                if self.stack[i][0] in _BLOCK:
                    break
        if name in _SAME:
            same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in same:
                    del self.stack[i:]
                    break
                if self.stack[i][0] in _SAME[name]:
                    break

    def weight(self, weights: dict[str, float]) -> list[float]:
        out, left = [], CONTAINER
        for kind, size, kept in zip(self.kinds, self.sizes, self.kept, strict=True):
            w = weights.get(kind)
            total = size * (_default(kind, kept) if w is None else w)
            if kept:
                left = CONTAINER
            else:
                total = max(min(total, 0.0), -left)
                left += total
            out.append(total)
        return out

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """Bounds of the run of tokens with the largest sum, the first of equal ones; empty if none is above 0."""
        best, found, total, start = 0.0, (0, 0), 0.0, 0
        for i, w in enumerate(self.weight(weights)):
            total += w
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, found = total, (start, i + 1)
        return found

    def whole(self, a: int, b: int) -> tuple[int, int]:
        """The region widened to the marked element that holds most of its kept words: links may begin or end it."""
        sizes = [n if t is not None and k else 0 for n, t, k in zip(self.sizes, self.texts, self.kept, strict=True)]
        marked = sum(n for n, m in zip(sizes[a:b], self.inside[a:b], strict=True) if m)
        if 2 * marked <= sum(sizes[a:b]):
            return a, b
        inside = [i for i in range(a, b) if self.inside[i]]
        low, high = inside[0], inside[-1] + 1
        while low and self.inside[low - 1]:
            low -= 1
        while high < len(self.inside) and self.inside[high]:
            high += 1
        return min(a, low), max(b, high)

    def text(self, weights: dict[str, float]) -> str:
        a, b = self.region(weights)
        a, b = self.whole(a, b) if b > a else (a, b)
        blocks: list[str] = []
        parts: list[str] = []
        for i in range(a, b + 1):
            if i == b or self.breaks[i]:
                if block := " ".join("".join(parts).split()):
                    blocks.append(block)
                parts = []
            elif self.kept[i] and (text := self.texts[i]) is not None:
                parts.append(text)
        return "\n".join(blocks)


def _default(kind: str, kept: bool) -> float:
    """The weight of a kind that no labelled page has shown."""
    if kind.startswith("tag "):
        return -0.2
    if not kept:
        return -2.0
    return -0.1 if kind.endswith(" a") else 1.0


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weight of each kind of token, from pages (id, html) that mark their content.

    Log odds of lying inside the mark, between -6 and 2; a tag's weight is at most -0.05.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for batch in bounded(batches, "html"):
            for source in batch.column("html").to_pylist():
                page = Page(source)
                for kind, size, marked in zip(page.kinds, page.sizes, page.inside, strict=True):
                    (inside if marked else outside)[kind] += size
        kinds = sorted({*inside, *outside})
        n = [pa.array([c[k] for k in kinds], pa.int64()) for c in (inside, outside)]
        yield pa.record_batch([pa.array(kinds, pa.string()), *n], ["kind", "inside", "outside"])

    marked = pages.where(F.lower("html").rlike("<(" + "|".join(MARKS) + r")[\s>]") & F.col("id").isNotNull())
    ids = marked.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` ids.
    chosen = marked.join(F.broadcast(ids.distinct()), "id").select("html")
    counted = chosen.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind")
    rows = counted.agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).orderBy(F.desc(F.col("a") + F.col("b")))
    weights = {}
    for row in rows.limit(KINDS).collect():
        odds = float(np.clip(np.log((row["a"] + 0.5) / (row["b"] + 0.5)), -6, 2))
        weights[row["kind"]] = min(odds, -0.05) if row["kind"].startswith("tag ") else odds
    return weights


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [Page(source or "").text(weights) for source in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = named(pages, page_id="page_id", url="url", html="html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    """Learns the weights from the pages that mark their content and extracts every page."""
    return extract(pages, learn(named(pages, id="page_id", html="html")))
