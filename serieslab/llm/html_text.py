"""Main text of web pages by tree scoring.

A page is read once into blocks of text, each owned by its nearest block element. Paragraphs pass points for their length and commas to
their parent, half as many to the grandparent, a third to the next; an element's points are discounted by the share of its text that is in
links. The best element is kept, an `article` or `main` around it whole, with siblings that have enough points, read like text, or stand
between kept ones, with what leads up to them from a heading on (a byline, a date) and with further paragraphs or sections after the last.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments never count. What an element's name says is
final for elements such as `nav`; a class or id only takes an element out that holds no article and, unless the name is plain (`sidebar`,
not `has-sidebar`), not most of the page's text.

Reading, scoring and choosing take time in proportion to the page, and no page makes them fail.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never page text, or never main text; those whose content is not markup.
DROPPED = frozenset("script style noscript template iframe object svg math canvas head title nav footer aside button select option label textarea dialog menu audio video map".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of which one more after the last kept one goes on with it: a paragraph, or a part with a heading of its own.
GO_ON = frozenset("p section".split())
#: Elements that hold text of their own as well as paragraphs: such text gives its points to them, other text to the parent.
CONTAINERS = frozenset("article body div main section td blockquote center html dd figure li".split())
#: Opening tags that close an open paragraph; tags that an equal or related one closes, and the elements that shield them from it.
CLOSES_P = BLOCKS - set("html body caption tr td th tbody thead tfoot li dd dt".split())
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SHIELDS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CELLS = ("td", "th", "table", "caption")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Names of classes and ids: plain ones; words that only say where or how; last and first words of longer names; words that deny.
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertisements advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist ccpa cookie cookies consent disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification notifications pagination pager paywall popup promo promos promotion related replies reply respond share sharing sidebar snackbar social sponsor sponsored sponsors subscribe subscription toast toolbar widget widgets login signup".split()
)
PLACES = frozenset("left right top bottom primary secondary main wrapper wrap box container inner outer list area section block row item items link links button buttons bar panel group site page global mobile desktop form thread overlay dialog slot unit body icons tree holder root region zone".split())
LASTS = frozenset("navigation nav menu pagination comments sidebar footer newsletter breadcrumbs breadcrumb widget popup modal cookie cookies consent advert advertisement ads disclaimer".split())
FIRSTS = frozenset("ad ads advert advertisement cookie cookies newsletter promo sponsored sponsor comment comments related nav footer sidebar".split())
DENIED = frozenset("has no not with without is hide hidden show js".split())
#: Points that a sibling needs as a share of the best one's, and the least; text and link share of a sibling that reads like text.
SIBLING_SHARE, SIBLING_LEAST, TEXT_LEAST, LINKS_MOST = 0.2, 10.0, 80, 0.25
#: Shares of the page's text with which an element is kept in spite of its name: of a longer name, of a plain one.
MOST_TEXT, ALL_TEXT = 0.5, 0.98

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^>"'\s][^>\s]*+)?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
NAME_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in RAW}


@lru_cache(1 << 14)
def named(token: str) -> int:
    """2 if a class or id plainly names what is no main text, 1 if it does so in a longer name, else 0."""
    words = [w.lower() for w in WORD.findall(token)]
    if not words or words[0] in DENIED:
        return 0
    sided = words[-1] in ("left", "right")  # also said of a page that has such a part
    while len(words) > 1 and (words[-1] in PLACES or words[-1].isdigit()):
        words.pop()
    while len(words) > 1 and words[0] in PLACES:
        words.pop(0)
    if len(words) == 1:
        return 2 - sided if words[0] in PLAIN else 0
    return 1 if words[-1] in LASTS or words[0] in FIRSTS or all(w in PLAIN for w in words) else 0


class Page:
    """Elements in page order, with their parents and ends, and blocks of text (owner, text, characters in links)."""

    def __init__(self, html: str):
        self.tags, self.parents, self.ends, self.flags, self.hints = ["html"], [-1], [0], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, element of the nearest block, whether it is dropped
        self.open: dict[str, list[int]] = {"html": [0]}  # places in the stack by tag
        self.blocks_open = [0]
        self.held: list[str] = []
        self.dropped = self.linked = self.articles = 0
        self.read(html)
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        self.ends[0] = len(self.tags)

    # reading
    def read(self, html: str) -> None:
        at, size, missing, loose = 0, len(html), set(), False
        while at < size:
            i = html.find("<", at)
            if i < 0:
                self.text(html[at:])
                return
            if i > at:
                self.text(html[at:i])
            after = html[i + 1 : i + 2]
            if html.startswith("<!--", i) and "<!--" not in missing:
                j = html.find("-->", i + 2)
                if j >= 0:
                    at = j + 3
                    continue
                missing.add("<!--")
            if after in ("!", "?") or after == "/" and not html[i + 2 : i + 3].isalpha():
                j = html.find(">", i)
                at = j + 1 if j >= 0 else size
                continue
            found = None if loose else TAG.match(html, i)
            if found is None:
                if not (after == "/" or after.isascii() and after.isalpha()):
                    self.text("<")
                    at = i + 1
                    continue
                j = html.find(">", i)
                if j < 0:
                    self.text(html[i:])
                    return
                loose = True
                close, rest = after == "/", html[i + 1 + (after == "/") : j]
                name, attributes, at = (rest.split(None, 1) or ["p"])[0].rstrip("/").lower(), rest.partition(" ")[2], j + 1
            else:
                close, name, attributes, at = bool(found[1]), found[2].lower(), found[3], found.end()
            if close:
                self.end(name)
                continue
            self.start(name, attributes)
            if name in RAW and name not in missing:
                stop = NAME_END[name].search(html, at)
                if stop is None and name in ("script", "style"):
                    return
                if stop is None:
                    missing.add(name)
                else:
                    at = stop.start()

    def text(self, data: str) -> None:
        if self.dropped:
            return
        data = unescape(data) if "&" in data else data
        self.held.append(data)
        if self.open.get("a"):
            self.linked += len(data.strip())

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, min(self.linked, len(text))))
            self.held, self.linked = [], 0

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def pop(self) -> None:
        tag, _, dropped = self.stack[-1]
        if tag in BLOCKS:
            self.flush()
            self.ends[self.stack[-1][1]] = len(self.tags)
            self.blocks_open.pop()
        self.stack.pop()
        self.open[tag].pop()
        self.dropped -= dropped
        self.articles -= tag in ("article", "main")

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in CLOSES_P and self.open.get("p") and self.open["p"][-1] >= self.blocks_open[-1]:
            self.pop_to(self.open["p"][-1])
        if tag in SAME:
            place = self.nearest(SAME[tag])
            if place > self.nearest(SHIELDS[tag]):
                self.pop_to(min(self.open[t][-1] for t in SAME[tag] if self.open.get(t) and self.open[t][-1] > self.nearest(SHIELDS[tag])))
        values: dict[str, str] = {}
        if attributes and attributes != "/":
            for k, v in ATTRIBUTE.findall(attributes):
                values.setdefault(k.lower(), v.strip("\"'"))
        role = values.get("role", "").lower()
        gone = tag in DROPPED or "hidden" in values or values.get("aria-hidden") == "true" or role in ROLES or tag == "header" and not self.articles
        gone = gone or "style" in values and bool(INVISIBLE.search(values["style"]))
        flag = 0
        if tag not in ("html", "body", "main") and ("class" in values or "id" in values):
            flag = max([named(t) for t in f"{values.get('class', '')} {values.get('id', '')}".split()], default=0)
            if flag and self.articles and "header" in values.get("class", "").lower():
                flag = 0  # an article's own header holds its title
        if tag == "form":
            flag = max(flag, 1)
        if tag == "br":
            self.held.append(" ")
        if tag in VOID or attributes.endswith("/") and (self.open.get("svg") or self.open.get("math")):
            if tag == "hr":
                self.flush()
            return
        owner = self.stack[-1][1]
        if tag in BLOCKS:
            self.flush()
            self.tags.append(tag), self.parents.append(owner), self.ends.append(len(self.tags)), self.flags.append(flag)
            self.hints.append(tag == "main" or tag == "article" and not flag or role in ("main", "article"))
            owner = len(self.tags) - 1
            self.blocks_open.append(len(self.stack))
        elif gone or flag == 2:
            gone = True
            self.held.append(" ")
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, owner, gone))
        self.dropped += gone
        self.articles += tag in ("article", "main")

    def end(self, tag: str) -> None:
        places = self.open.get(tag)
        if not places or tag in ("html", "body"):
            return
        if tag not in BLOCKS and tag not in DROPPED and places[-1] < self.blocks_open[-1]:
            return  # an inline element does not close the blocks inside it
        if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") and places[-1] < self.nearest(CELLS):
            return  # nor does one outside a cell
        self.pop_to(places[-1])

    # scoring
    def sums(self, kept: list[tuple[int, str, int]]) -> tuple[list[int], list[int], list[int]]:
        """Of each element: characters of text below it, of these in links, and in headings."""
        n = len(self.tags)
        text, links, heads = [0] * n, [0] * n, [0] * n
        for owner, t, linked in kept:
            text[owner] += len(t)
            links[owner] += linked
            heads[owner] += len(t) * (self.tags[owner] in HEADINGS)
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            text[p] += text[i]
            links[p] += links[i]
            heads[p] += heads[i]
        return text, links, heads

    def without_flagged(self) -> list[tuple[int, str, int]]:
        """The blocks outside elements whose class or id takes them out."""
        n = len(self.tags)
        text, _, _ = self.sums(self.blocks)
        holds = list(self.hints)
        for i in range(n - 1, 0, -1):
            holds[self.parents[i]] |= holds[i]
        starts, stops, i = [], [], 0
        while i < n:
            if self.flags[i] and not holds[i] and text[i] < text[0] * (ALL_TEXT if self.flags[i] == 2 else MOST_TEXT):
                starts.append(i), stops.append(self.ends[i])
                i = self.ends[i]
            else:
                i += 1
        if not starts:
            return self.blocks
        return [b for b in self.blocks if (k := bisect_right(starts, b[0])) == 0 or b[0] >= stops[k - 1]]

    def main_text(self) -> str:
        blocks = self.without_flagged()
        n = len(self.tags)
        points = [0.0] * n
        for owner, text, _ in blocks:
            if len(text) < 2 or self.tags[owner] in HEADINGS:
                continue
            own = 1 + text.count(",") + min(len(text) / 100, 3)
            up, share = owner if self.tags[owner] in CONTAINERS else self.parents[owner], 1
            while up >= 0 and share <= 3:
                points[up] += own / share
                up, share = self.parents[up], share + 1
        text, links, heads = self.sums(blocks)
        for i in range(n):
            if points[i]:
                points[i] *= (1 - links[i] / text[i]) * (1.5 if self.hints[i] else 1)
        best = max(range(n), key=points.__getitem__)
        if not points[best]:
            return "\n".join(t for _, t, _ in blocks)
        holder = best
        while holder >= 0 and not self.hints[holder]:
            holder = self.parents[holder]
        best = holder if holder >= 0 else best
        up = best if self.tags[best] in ("body", "html") else self.parents[best]
        if up < 0:
            return "\n".join(t for _, t, _ in blocks)
        least = max(SIBLING_LEAST, points[best] * SIBLING_SHARE)
        parts: list[tuple[int, list[str], int]] = []  # child of the parent (or the parent itself), its texts, their link characters
        child_end = -1
        for owner, t, linked in blocks:
            if not up <= owner < self.ends[up]:
                continue
            if owner == up:
                parts.append((up, [t], linked))
                child_end = -1
            elif owner < child_end and parts[-1][0] <= owner:
                parts[-1][1].append(t)
                parts[-1] = (parts[-1][0], parts[-1][1], parts[-1][2] + linked)
            else:
                child = owner
                while self.parents[child] != up:
                    child = self.parents[child]
                child_end = self.ends[child]
                parts.append((child, [t], linked))
        read = [sum(map(len, ts)) for _, ts, _ in parts]
        share = [linked / max(1, size) for (_, _, linked), size in zip(parts, read, strict=True)]
        # an article right in the body: all of it but lists of links
        good = [s < 2 * LINKS_MOST for s in share] if up == best else [c == best or c != up and points[c] >= least or size > TEXT_LEAST and s < LINKS_MOST and (c == up or heads[c] < text[c]) for (c, _, _), size, s in zip(parts, read, share, strict=True)]
        kept = [k for k, g in enumerate(good) if g]
        if up == best or not kept:
            return "\n".join(t for (_, ts, _), g in zip(parts, good, strict=True) if g for t in ts)
        for k in range(kept[0], kept[-1]):
            good[k] = good[k] or share[k] < 2 * LINKS_MOST
        # what leads up to the body from a heading on, such as a byline, and what goes on like its last part
        k, first = kept[0] - 1, kept[0]
        while k >= 0 and share[k] < LINKS_MOST and text[parts[k][0]] > 0:
            if parts[k][0] != up and heads[parts[k][0]] > 0:
                first = k
            elif parts[k][0] == up and self.tags[parts[k][0]] not in CONTAINERS:
                break
            k -= 1
        good[first : kept[0]] = [True] * (kept[0] - first)
        tag, k = self.tags[parts[kept[-1]][0]], kept[-1] + 1
        while k < len(parts) and share[k] < LINKS_MOST and tag in GO_ON and self.tags[parts[k][0]] == tag and (tag == "p" or 0 < heads[parts[k][0]] < text[parts[k][0]]):
            good[k] = True
            k += 1
        return "\n".join(t for (_, ts, _), g in zip(parts, good, strict=True) if g for t in ts)


def main_text(page: str | None) -> str:
    """The main text: a line for each block, in page order; empty if there is none."""
    return Page(page).main_text() if page else ""


def main_texts(html: Column) -> Column:
    """The main text of whole pages; empty for null and empty ones."""

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return extract(html)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each row of pages: page_id, url, text and n_chars (its code points). Repeated rows repeat; null, empty and malformed pages
    give what text they have, or an empty one; other columns are not read, whatever their names."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), main_texts(F.col(html)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
