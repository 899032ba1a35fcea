"""Main-text extraction from HTML (operator 8).

The standard library's streaming parser turns a page into lines, one per block element. Each
line has a text-to-tag ratio; the ratios are smoothed with a Gaussian over neighbouring lines, and
lines at or above the threshold (the standard deviation of the smoothed ratios) are content lines.
They are clustered by region: the article / main element or else the nearest container the line
stands in. A region's weight is the text of its content lines. An article's region is kept if it has
any; another region if it outweighs the page's largest article by far or, on a page without one, has
a fixed share of the heaviest region's weight. A kept region stays with all its lines, so a
short paragraph between long ones stays; regions that are mostly links go.

What HTML itself marks as something else by tag or role (menus, footers, asides, forms, scripts)
never becomes a line, nor what class or id mark as notice, sidebar, sharing or reader comments:
prose of its own, which no ratio tells from an article. Adverts are left to the ratios, but inside
an article, whose region they share.

Rows are independent: one map stage, no shuffle, memory bounded by one page. A null or empty page,
or one without text, gives an empty text; repeated rows give repeated results; other columns of
the input are left out of the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

# Element classes (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body html aside nav header footer form table".split())
SELF_CLOSING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
                "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Elements whose text is never article text.
DROPPED = frozenset("script style noscript template svg math canvas iframe object select textarea button "
                    "nav footer aside form title menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                  "menubar toolbar".split())
# Words in a class or id that mark boilerplate.
NOISE = frozenset(
    "banner sidebar sidebars nav navbar navigation menu menus breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal "
    "overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "widget pagination pager toolbar skip disclaimer".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adsense sponsor sponsored "
                    "sponsors promo promotion promoted".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
REGION_SHARE = 0.25       # of the heaviest region's weight, on pages without an article
ARTICLE_FACTOR = 4        # times an article's text, for a region outside it,
ARTICLE_LEAST = 300       # and at least so many characters
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Lines(HTMLParser):
    """Parser events -> lines of (text, tags, link characters, region)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.stack: list[tuple[str, int, bool, int]] = []   # tag, skip kind, in article, region
        self.open = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = self.regions = 0
        self.articles: set[int] = set()

    # skip kinds: 0 none, 1 boilerplate (an article inside ends it), 2 never text
    def _top(self):
        return self.stack[-1] if self.stack else ("", 0, False, 0)

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, max(1, self.tags), self.linked, self._top()[3]))
        self.parts, self.tags, self.linked = [], 0, 0

    def _pop(self):
        self.open[self.stack.pop()[0]] -= 1

    def _close(self, tags, until=frozenset()):
        """End the innermost open element of ``tags``, not looking past one of ``until``."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in until:
                return

    def _skip(self, tag, attrs, inside) -> int:
        a = {k: v or "" for k, v in attrs}
        words = {w.lower() for w in _TOKEN.findall(f"{a.get('class', '')} {a.get('id', '')}")}
        if tag in DROPPED or words & COMMENTS and tag not in ("html", "body", "main"):
            return 2
        if tag in ("html", "body", "main", "article"):
            return 0
        if tag == "header":
            return 0 if inside else 1
        if a.get("role", "").lower() in ROLES or words & NOISE or inside and words & ADVERTS or "hidden" in a or \
                re.search(r"display\s*:\s*none", a.get("style", "")):
            return 1
        return 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
            if self.open["p"] and tag not in ("html", "body", "head"):
                self._close({"p"}, CONTAINERS | {"li", "td", "th"})
                self._flush()
        if tag in SELF_CLOSING and self.open[tag]:
            self._close({tag}, SELF_CLOSING[tag])
        self.tags += 1
        if tag in VOID:
            self.parts.append(" ")
            return
        _, skip, inside, region = self._top()
        own = self._skip(tag, attrs, inside)
        if tag in ("article", "main") and own == 0:
            skip = 2 if skip == 2 and (self.open["aside"] or self.open["template"]) else 0
            if not inside:
                self.regions += 1
                region = self.regions
                self.articles.add(region)
            inside = True
        elif tag in CONTAINERS and not inside:
            self.regions += 1
            region = self.regions
        self.stack.append((tag, max(skip, own), inside, region))
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        if self.open[tag]:
            self._close({tag}, {"article", "main"} if tag not in CONTAINERS else frozenset())

    def handle_data(self, data):
        if self._top()[1] == 0:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self._flush()


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average over neighbouring lines; weights beyond the ends are left out."""
    r = max(1, int(round(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratios, w)[r:r + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), w)[r:r + len(ratios)]


def content_regions(lines: list[tuple[str, int, int, int]], articles: set[int], sigma: float,
                    max_link_share: float) -> set[int]:
    """The regions to keep of a page's lines (text, tags, link characters, region)."""
    ratio = smooth(np.array([len(t) / n for t, n, _, _ in lines], dtype=float), sigma)
    high = ratio >= min(ratio.std(), ratio.max())
    weight, links, chars = Counter(), Counter(), Counter()
    for (t, _, linked, region), h in zip(lines, high):
        weight[region] += len(t) * bool(h)
        links[region] += linked
        chars[region] += len(t)
    prose = {r: weight[r] for r in chars if weight[r] and links[r] <= max_link_share * chars[r]}
    main = max((chars[r] for r in prose if r in articles), default=0)
    bar = max(ARTICLE_FACTOR * main, ARTICLE_LEAST) if main else REGION_SHARE * max(prose.values(), default=0)
    return {r for r, w in prose.items() if r in articles or w >= bar}


def main_text(html: str | None, sigma: float = 1.0, max_link_share: float = 0.5) -> str:
    """The text of the content regions of one page, one line per block."""
    p = _Lines()
    p.feed(html or "")
    p.close()
    if not p.lines:
        return ""
    keep = content_regions(p.lines, p.articles, sigma, max_link_share)
    return "\n".join(t for t, _, _, r in p.lines if r in keep)


def extract_main_text(pages: DataFrame, sigma: float = 1.0, max_link_share: float = 0.5) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h, sigma, max_link_share) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text,
                                "n_chars": [len(t) for t in text]})

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInPandas(lean(run), schema)
