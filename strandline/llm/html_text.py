"""Main text of HTML pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams events; block elements end a line. Each line belongs to a region (its nearest
article, main, section or other container) and has the ratio of its text's length to the tags met in it. The ratios
are smoothed over the page by a Gaussian and split at a threshold into content and the rest; a region is content when
most of its text is in content lines and its own ratio is over the threshold. Elements that never hold an article's text (menus, forms,
scripts) make no lines. All else only weighs: where a page has article or main elements with text, the ratios of lines in these count
more, those of other lines less, and a region in these needs no ratio of its own, so that a title beside text stays; what a role or a
class names an advert, a comment or a notice is a region whose ratio counts a sixteenth, and a class that only hints at one halves it.
So a name decides nothing by itself: a page whose whole text lies in such an element keeps it, as ratios are compared to each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_frames

#: Fixed values of HTML: elements whose tags begin and end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Fixed values of HTML: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text.
DROPPED = frozenset(
    "applet aside audio button canvas datalist dialog embed fieldset footer form head iframe input legend menu meter nav "
    "noframes noscript optgroup option picture progress search select style script svg template textarea title video".split()
)
#: Elements that are the page's frame, but hold the article's title when inside it.
FRAME = frozenset({"header"})
REGIONS = frozenset("article body div main section".split())
MAIN = frozenset({"article", "main"})
NAMED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names that a class or id gives to what is no article text, alone or with words after them ("ad", "comment-list").
NAMES = frozenset(
    "ad adbox ads adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo share sharing sidebar signup "
    "sponsor sponsored sponsors subscribe subscription taboola toolbar tooltip".split()
)
#: Beginnings of such names.
NAME_PREFIXES = ("advert", "banner", "breadcrumb", "cookie", "navbar", "newsletter", "popup", "sidebar", "sponsor")
#: Names that are so only where they are all of a class or id.
WHOLE_NAMES = frozenset("related recommended login".split())
#: Words that only hint at it, as do names after other words ("with-sidebar") or denied ("ad-free").
HINTS = frozenset("discussion disclaimer notification promotion reply replies respond skip social teaser widget widgets".split()) | NAMES | WHOLE_NAMES
DENIED = frozenset("free less off none no without".split())
#: Words in a class or id that mark the page's frame outside the article.
FRAME_NAMES = frozenset("header topbar".split())
#: Elements that a new one of the same kind, or of a listed kind, ends.
ENDS = {"p": BLOCKS - {"html", "body"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
        "tr": frozenset({"tr", "tbody"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
#: The listed kinds that a start tag ends.
ENDED_BY = {tag: tuple(k for k, ends in ENDS.items() if tag in ends) for tag in frozenset().union(*ENDS.values())}
#: Elements that hide what is open around them from such a start tag.
BARRIERS = REGIONS | DROPPED | {"ul", "ol", "dl", "table"}
#: Standard deviation of the Gaussian, in lines, and the share of the mean ratio under which a line is no content.
SIGMA, SHARE = 1.0, 0.35
#: What ratios inside article and main are multiplied by, and those outside divided by, on pages that have such text.
WEIGHT = 2.0
#: What the ratios of lines are divided by where nothing, a hint, or a name says that they are no article text.
MARKS = (1.0, 2.0, 16.0)


#: What is open at the top of a page.
NOTHING = ("", False, 0, False, 0)


class Lines(HTMLParser):
    """Collects (text, tags, region, in_main, mark) for each line of a page. Places of open elements are listed by tag, so that an end tag
    without a start, or a start tag deep inside others, costs no search."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, bool, int]] = []  # (tag, dropped, region, in main, mark)
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.text: list[str] = []
        self.tags = self.regions = 0
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.unclosed: set[str] = set()

    def parse_comment(self, i: int, report: bool = True) -> int:
        """As inherited; where the rest of the page has no end of a comment, it isn't searched for again."""
        if "comment" in self.unclosed:
            return -1
        end = super().parse_comment(i, report)
        if end < 0:
            self.unclosed.add("comment")
        return end

    def _end_line(self) -> None:
        if self.text:
            if words := " ".join("".join(self.text).split()):
                _, _, region, main, mark = self.open[-1] if self.open else NOTHING
                self.lines.append((words, max(1, self.tags), region, main, mark))
            self.text = []
        self.tags = 0

    def _push(self, tag: str, dropped: bool, region: int, main: bool, mark: int) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BARRIERS:
            self.barriers.append(len(self.open))
        self.open.append((tag, dropped, region, main, mark))

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in BARRIERS:
                self.barriers.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in MAIN:  # an article is not inside a menu or header whose end tag is missing
            while self.open and self.open[-1][0] in ("nav", "header", "footer", "aside", "head") and self.open[-1][1]:
                self._pop_to(len(self.open) - 1)
        if tag == "body":
            while self.open and self.open[-1][0] == "head":
                self._pop_to(len(self.open) - 1)
        ended = max((self.places[k][-1] for k in ENDED_BY.get(tag, ()) if self.places.get(k)), default=-1)
        if ended >= 0 and ended >= (self.barriers[-1] if self.barriers else 0):
            self._end_line()
            self._pop_to(ended)
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, dropped, region, main, mark = self.open[-1] if self.open else NOTHING
        main = main or tag in MAIN
        dropped = dropped or tag in DROPPED or (tag in FRAME and not main)
        own = self._mark(dict(attrs), main) if attrs and tag not in ("html", "body") else 0
        if tag in REGIONS or own == 2:
            self.regions += 1
            region = self.regions
        self._push(tag, dropped, region, main, max(mark, own))

    @staticmethod
    def _mark(attrs: dict[str, str | None], main: bool) -> int:
        """2 if role, class or id name what is no article text, 1 if they hint at it, else 0."""
        if (attrs.get("role") or "").lower() in NAMED_ROLES:
            return 2
        mark = 0
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
            first, *rest = words = [w for w in re.split(r"[^a-z]+", name) if w] or [""]
            known = first in NAMES or first.startswith(NAME_PREFIXES) or (first in FRAME_NAMES and not main) or (first in WHOLE_NAMES and not rest)
            if known and DENIED.isdisjoint(rest):
                return 2
            if not HINTS.isdisjoint(words):
                mark = 1
        return mark

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if found := self.places.get(tag):
            if tag not in BLOCKS and any(t in BLOCKS for t, *_ in self.open[found[-1] + 1 :]):
                self._end_line()
            self._pop_to(found[-1])

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian means over the neighbours, within three standard deviations."""
    reach = max(1, round(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[d + reach], values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def main_text(html: str | None) -> str:
    """The page's article, one line for each block; empty for null, an empty page or a page without text."""
    if not html:
        return ""
    parser = Lines()
    closed = html.rfind(">") + 1  # no tag ends after it: what begins there is text, as far as this parser is concerned
    parser.feed(html[:closed])
    parser.close()
    parser.handle_data(html[closed:] if parser.cdata_elem else unescape(html[closed:]))
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    in_main = any(x[3] for x in lines)
    weights = [(1.0 if not in_main else WEIGHT if main else 1 / WEIGHT) / MARKS[mark] for *_, main, mark in lines]
    ratios = smooth([w * len(text) / tags for w, (text, tags, *_) in zip(weights, lines, strict=True)])
    threshold = level = SHARE * sum(ratios) / len(ratios)
    if in_main:  # long paragraphs full of tags are text as well
        level = min(level, SHARE * sum(w * len(x[0]) for w, x in zip(weights, lines, strict=True)) / sum(x[1] for x in lines))
    sums: dict[int, list[float]] = {}
    for (text, tags, region, main, mark), w, ratio in zip(lines, weights, ratios, strict=True):
        x = sums.setdefault(region, [0, 0, 0, 0, 0])
        for i, n in enumerate((len(text), tags, len(text) if ratio >= level else 0, w * len(text), main and mark < 2)):
            x[i] += n
    content = {r for r, (size, tags, dense, weighed, main) in sums.items() if 2 * dense >= size and (main or weighed / tags >= threshold)}
    return "\n".join(x[0] for x in lines if x[2] in content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): one row per row of ``pages``; see ``main_text``. Whole pages are read, nothing of the
    article is cut. Repeated rows give repeated rows, an empty table an empty one; other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            text = [main_text(h) for h in frame["html"]]
            yield pd.DataFrame({"id": frame["id"], "url": frame["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_frames(rows, run, "id long, url string, text string, n_chars long")
