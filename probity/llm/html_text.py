"""Main text of web pages: streamed parser events, text-to-tag ratios by line, smoothing, clustering."""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probity.llm.common import fresh, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that never hold main text.
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea label fieldset svg canvas iframe object embed video audio dialog menu map applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "nav navbar navigation menu menubar submenu topbar toolbar breadcrumb breadcrumbs sidebar side rail aside footer foot header masthead banner ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login signin search searchbox share sharing social comment comments commentlist disqus respond reply replies discussion "
    "related recommended recommendations widget widgets pagination pager copyright legal disclaimer skip hidden".split()
)
_WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Start tags that end an open element of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SMOOTH, RADIUS = 1.0, 2


class Lines(HTMLParser):
    """Collects a page's lines (blocks): text, tags in it, link characters, innermost article, innermost main (0: none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # tag, whether it excludes
        self.out: list[list] = []
        self.parts: list[str] = []
        self.tags = self.links = self.skipped = self.anchors = self.regions = 0
        self.inside: dict[str, list[int]] = {"article": [0], "main": [0]}  # open elements' numbers

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append([text, self.tags, self.links, self.inside["article"][-1], self.inside["main"][-1]])
        self.parts, self.tags, self.links = [], 0, 0

    def excludes(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER or tag == "header" and not any(x[-1] for x in self.inside.values()):
            return True
        if tag in ("html", "body", "main"):
            return False
        for k, v in attrs:
            v = v or ""
            if k == "role" and v.lower() in ROLES or k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", "").lower():
                return True
            if k in ("class", "id") and not MARKS.isdisjoint(_WORDS.findall(CAMEL.sub("-", v).lower())):
                return True
        return False

    def pop(self, to: int) -> None:
        for tag, out in self.stack[to:]:
            self.skipped -= out
            if tag in self.inside:
                self.inside[tag].pop()
            self.anchors -= tag == "a"
        del self.stack[to:]

    def handle_starttag(self, tag, attrs) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag == "body" or tag in ("article", "main") and self.skipped and not any(t in ("aside", "section", "article", "main") for t, _ in self.stack):
            # an unclosed head, menu or header doesn't swallow the page
            self.pop(next((i for i, (_, out) in enumerate(self.stack) if out), len(self.stack)))
        if ends := CLOSES.get(tag):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self.pop(i)
                    break
                if self.stack[i][0] not in INLINE and self.stack[i][0] != "p":
                    break
        elif tag not in INLINE and any(t == "p" for t, _ in self.stack[-6:]):
            for i in range(len(self.stack) - 1, -1, -1):  # a block ends an open paragraph
                if self.stack[i][0] == "p":
                    self.pop(i)
                    break
                if self.stack[i][0] not in INLINE:
                    break
        out = self.excludes(tag, attrs)
        self.stack.append((tag, out))
        self.skipped += out
        if tag in self.inside:
            self.regions += 1
            self.inside[tag].append(self.regions)
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and tag not in ("div", "p", "article", "main", "section"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.anchors:
                self.links += len(data)


def content(lines: list[list]) -> list[str]:
    """The lines of the content regions.

    A line's ratio is its characters outside links over its tags. Ratios are smoothed by a Gaussian kernel;
    lines above the standard deviation of the smoothed ratios are content. An article with a content line
    whose own ratio is above it, too, is one region and stays whole; any other article holds no content
    (teasers). Elsewhere the lines between two content lines join them, if they lie in the same main element
    (or all in none) and no article without content is among them. A list of links joins no region.
    """
    if not lines:
        return []
    text, tags, links, article, main = zip(*lines)
    size, links = np.array(list(map(len, text))), np.array(links)
    article, main = np.array(article), np.array(main)
    ratio = np.maximum(0, size - links) / np.maximum(1, tags)
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SMOOTH**2))
    smooth = np.convolve(np.pad(ratio, RADIUS, mode="edge"), kernel / kernel.sum(), mode="valid")
    least = min(smooth.std(), smooth.max())
    chosen = (smooth >= least) & (ratio > 0)
    own = chosen & (ratio >= least)
    whole = np.isin(article, article[own if own.any() else chosen]) & (article > 0)
    chosen = whole | chosen & (article == 0)
    # two or more lines in a row that are mostly links
    linked = 2 * links >= size
    listed = linked & (np.append(linked[1:], False) | np.append(False, linked[:-1]))
    keep = chosen.copy()
    at = np.flatnonzero(chosen)
    apart = np.flatnonzero(np.diff(at) > 1)
    for a, b in zip(at[apart], at[apart + 1]):
        gap = slice(a + 1, b)
        keep[gap] = (main[a : b + 1] == main[a]).all() and not article[gap].any()
    return [text[i] for i in np.flatnonzero(keep & ~listed)]


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return " ".join(content(parser.out))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without its html, with text and n_chars (code points) behind the other columns.

    A null or empty page, or one without content, gives an empty text. Pages are independent: repeated rows
    and other columns stay; columns named text or n_chars are replaced.
    """
    inner = fresh(pages, "page_html")
    src = pages.withColumn(inner, pages[html].cast("string")).drop(*{c for c in ("text", "n_chars", html)})
    schema = src.drop(inner).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, inner):
                i = part.schema.get_field_index(inner)
                texts = [main_text(x) for x in part.column(i).to_pylist()]
                keep = [k for k in range(part.num_columns) if k != i]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*(part.schema.names[k] for k in keep), "text", "n_chars"])

    return src.mapInArrow(run, schema)
