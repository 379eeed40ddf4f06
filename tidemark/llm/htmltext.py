"""Main text of HTML pages by tag-path ratios.

A page is read into its sequence of text blocks, each with its root-to-leaf path of block-level tags and their classes. For
each path the text length, punctuation and linked text are summed over the page. A path's length ratio (characters a block
outside links) and punctuation ratio (marks a block) are smoothed over the neighbouring blocks with a Gaussian and fused into
one score. Paths whose score passes a threshold taken from the scores' spread, and a part of it before smoothing, hold
content. After Wu et al., "Content extraction from web pages via tag-path features" (2013).

Content paths choose the content nodes: the element around a content path, and all of an ``article`` or ``main`` around
that, is content with all that it holds, such as short paragraphs, lists and tables; directly in the body only the content
paths themselves are. Headings right before content belong to it. Menus are known by their ratio as well, inside and
outside: paths of list items, three at least, whose text is linked but for a tenth. The ratios of paths in ``article`` or
``main`` count threefold; where these hold no content by their ratios, they are not taken.

Elements that are never content by their definition (navigation, headers, footers, asides, forms, scripts, ..., and those
whose class, id or role names an advert, notice, sidebar, comment section and the like) are not read at all.

Character references are decoded, white space in a block becomes one space, blocks are joined in page order by one space,
nothing is cut off. Null or empty html gives the empty text; broken markup is read as far as it goes, in time proportional
to its length: where a tag's quotes never close, tags from there on end at the next ``>``. A very long page is one row, read
whole. Repeated pages give repeated rows; other columns are kept out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, table

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
           "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_NEVER = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "template", "head", "dialog", "menu", "audio",
          "video", "map", "fieldset", "datalist"} | _RAW
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|gdpr|header|login|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|paywall|popup|promo|promotion|related|replies|respond|share|sharing|sidebar|side|signup|"
    r"skip|social|sponsor|sponsored|subscribe|tags|toolbar|widget)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_ATTR = re.compile(r"""(class|id|role|style|aria-hidden|hidden)(?=[\s=/]|$)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CLASS = re.compile(r"""(?:^|[\s"'])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_KEPT = {"html", "body", "article", "main"}
_HOME = {"article", "main"}
#: Start tags that end an open paragraph, and those that end an open one of their own kind.
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
           "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"html", "body", "article", "main", "div", "section", "table", "ul", "ol", "dl", "td", "th", "tr", "blockquote", "figure"}
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: Share of the scores' standard deviation that a path must reach, the part of it before smoothing, and how much more the
#: ratios in an article count.
THRESHOLD, OWN, HOME = 1.0, 1.0, 3.0
#: Blocks of a path that may be a menu, and the share of their text that is linked then.
MENU_BLOCKS, MENU_LINKED = 3, 0.9
_ITEMS = {"li", "dt", "dd", "td", "th"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Weights of the Gaussian.
_WEIGHTS = [math.exp(-(d * d) / 2.0) for d in range(-2, 3)]


def _never(tag: str, attributes: str) -> bool:
    if tag in _KEPT:
        return False
    if tag in _NEVER:
        return True
    if attributes:
        for name, value in _ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name in ("class", "id") and _NAMED.search(value) or name == "role" and value.lower() in _ROLES:
                return True
            if name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True
    return False


class Page:
    """A page's blocks ``(path, text, linked characters)`` in page order. A path is a number: ``tags[path]`` is its last tag and
    ``around[path]`` the path of the element around it, a smaller number; 0 is the page itself."""

    def __init__(self, html: str) -> None:
        self.tags, self.around, self.blocks = [""], [0], []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[tuple[str, bool, int]] = []  # (tag, never content, path)
        self._open: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self._scopes: list[int] = []
        self._homes: list[int] = []
        self._text: list[str] = []
        self._linked = 0
        self._read(html)
        self._flush()

    def _read(self, html: str) -> None:
        at, naive, last = 0, False, html.rfind(">")
        while (start := html.find("<", at)) >= 0:
            if start > last and not html.startswith("<!--", start) and not _NAME.match(html, start + 1):
                break
            self._add(html[at:start])
            if html.startswith("<!--", start):
                end = html.find("-->", start + 2)
                at = end + 3 if end >= 0 else len(html)
                continue
            if (m := _NAME.match(html, start + 1)) is None:
                if html[start + 1 : start + 2] in ("!", "?", "/") and start < last:
                    at = html.index(">", start) + 1
                else:
                    self._add("<")
                    at = start + 1
                continue
            if start > last:  # a tag that never ends
                at = start if m.end() < len(html) else len(html)
                break
            end = -1 if naive else self._end(html, m.end())
            if end < 0:
                naive, end = True, html.find(">", m.end())
            at = end + 1
            tag = m[1].lower()
            if html[start + 1] == "/":
                self._close(tag)
            elif tag in _RAW:
                closing = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                end = html.find(">", closing.end()) if closing else -1
                at = end + 1 if end >= 0 else len(html)
            else:
                self._start(tag, html[m.end() : end])
        self._add(html[at:])

    @staticmethod
    def _end(html: str, at: int) -> int:
        """Where the tag ends, or -1 if its quotes never close."""
        while (m := _STOP.search(html, at)) is not None:
            if m[0] == ">":
                return m.start()
            at = html.find(m[0], m.end()) + 1
            if not at:
                return -1
        return -1

    def _path(self) -> int:
        return self._stack[-1][2] if self._stack else 0

    def _flush(self) -> None:
        if self._text:
            if whole := _SPACE.sub(" ", unescape("".join(self._text))).strip():
                self.blocks.append((self._path(), whole, min(self._linked, len(whole))))
            self._text.clear()
        self._linked = 0

    def _add(self, piece: str) -> None:
        if piece and not (self._stack and self._stack[-1][1]):
            self._text.append(piece)
            if self._open["a"]:
                self._linked += len(piece)

    def _pop_to(self, place: int) -> None:
        if any(tag not in _INLINE for tag, _, _ in self._stack[place:]):
            self._flush()
        for tag, _, _ in reversed(self._stack[place:]):
            self._open[tag].pop()
        del self._stack[place:]
        for places in (self._scopes, self._homes):
            while places and places[-1] >= place:
                places.pop()

    def _end_open(self, tags: set[str]) -> None:
        place = max((self._open[t][-1] for t in tags if self._open[t]), default=-1)
        if place > (self._scopes[-1] if self._scopes else -1) or place >= 0 and place == (self._scopes[-1] if self._scopes else -1):
            self._pop_to(place)

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._flush()
        if places := self._open[tag]:
            if not (tag in _INLINE or tag in ("p", "li")) or places[-1] > (self._homes[-1] if self._homes else -1):
                self._pop_to(places[-1])

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _VOID or attributes.endswith("/") and tag in _INLINE:
            if tag not in _INLINE:
                self._flush()
            return
        if tag in _ENDS_P:
            self._end_open({"p"})
        if tag in _ENDS_OWN:
            self._end_open(_ENDS_OWN[tag])
        path = self._path()
        if tag not in _INLINE:
            self._flush()
            kind = _CLASS.search(attributes) if attributes else None
            label = f"{tag}.{' '.join(sorted((kind[1] or kind[2] or kind[3] or '').split()))}" if kind else tag
            if (known := self._paths.get((path, label))) is None:
                known = self._paths[path, label] = len(self.tags)
                self.tags.append(tag)
                self.around.append(path)
            path = known
        place = len(self._stack)
        self._open[tag].append(place)
        if tag in _SCOPES:
            self._scopes.append(place)
        if tag in _HOME:
            self._homes.append(place)
        self._stack.append((tag, bool(self._stack and self._stack[-1][1]) or _never(tag, attributes), path))


def ratios(page: Page) -> tuple[dict[int, float], dict[int, float], float]:
    """Of each path the smoothed and fused score and the same before smoothing, and the threshold."""
    sums: dict[int, list[float]] = {}
    for path, text, linked in page.blocks:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += 1
        s[1] += len(text) - linked
        s[2] += len(_MARKS.findall(text))
    home = [False] * len(page.tags)
    for path in range(1, len(page.tags)):
        home[path] = page.tags[path] in _HOME or home[page.around[path]]

    def smooth(values: list[float]) -> list[float]:
        n, half = len(values), len(_WEIGHTS) // 2
        out = []
        for i in range(n):
            low, high = max(0, i - half), min(n, i + half + 1)
            weights = _WEIGHTS[low - i + half : high - i + half]
            out.append(sum(w * v for w, v in zip(weights, values[low:high], strict=True)) / sum(weights))
        return out

    length, marks = ({p: s[k] / s[0] * (HOME if home[p] else 1.0) for p, s in sums.items()} for k in (1, 2))
    raw = {p: length[p] * (0.1 + marks[p]) for p in sums}
    fused = [a * (0.1 + b) for a, b in zip(smooth([length[p] for p, _, _ in page.blocks]), smooth([marks[p] for p, _, _ in page.blocks]), strict=True)]
    scores: dict[int, float] = defaultdict(float)
    for (path, _, _), score in zip(page.blocks, fused, strict=True):
        scores[path] += score / sums[path][0]
    mean = sum(fused) / len(fused)
    return scores, raw, THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))


def content(page: Page) -> list[bool]:
    """Whether each block is content, by the ratios of its path."""
    if not page.blocks:
        return []
    scores, raw, limit = ratios(page)
    tags, around = page.tags, page.around
    counts: dict[int, list[int]] = {}
    for path, text, linked in page.blocks:
        c = counts.setdefault(path, [0, 0, 0])
        c[0] += 1
        c[1] += linked
        c[2] += len(text)
    item = [False] * len(tags)
    home = [0] * len(tags)
    for path in range(1, len(tags)):
        item[path] = tags[path] in _ITEMS or item[around[path]]
        home[path] = home[around[path]] or (path if tags[path] in _HOME else 0)
    menu = {p for p, (n, linked, whole) in counts.items() if item[p] and n >= MENU_BLOCKS and linked >= MENU_LINKED * whole}
    best = {p for p in scores if scores[p] >= limit and raw[p] >= OWN * limit and p not in menu} or {max(scores, key=scores.__getitem__)}
    nodes = {home[p] or around[p] for p in best}
    nodes = {p for p in nodes if tags[p] not in ("", "html", "body")}
    inside = [False] * len(tags)
    for path in range(1, len(tags)):
        inside[path] = path in nodes or inside[around[path]]
    out = [p in best or inside[p] and p not in menu for p, _, _ in page.blocks]
    for i in range(len(out) - 2, -1, -1):
        out[i] = out[i] or tags[page.blocks[i][0]] in _HEADINGS and out[i + 1]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    return " ".join(text for (_, text, _), keep in zip(page.blocks, content(page), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)``, one for each row of ``pages(page_id, url, html)``."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return pages.select("page_id", "url", of(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_htmltext(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
