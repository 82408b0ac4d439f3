"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

The standard library's parser is fed the page and its events make lines: a line is the text of one block element.
Structure that is never content (menus, headers outside the article, footers, sidebars, adverts, forms, comments and
the like) is left out as its events arrive. The remaining lines get a text-to-tag ratio, smoothed over their
neighbours; a two-means threshold on it clusters them into content and rest. Content lines vote for the region of the
page that holds them (an article, main element or the page), and all lines of the winning region are the main text,
so a short paragraph between long ones stays. Other articles of some length stay too, and so does what else the main
element around the winner says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
NEVER = frozenset("head title script style noscript template nav footer aside form iframe object svg canvas math select option button textarea dialog menu audio video map".split())
#: Elements that start a new line.
BLOCKS = frozenset("html body address article blockquote caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr legend li main ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Words of class and id that mark what isn't main text, and roles that do.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination paywall popup promo promoted promotion recommended related replies reply respond responses sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
COMMENTS = frozenset("comment comments discussion disqus replies reply responses".split())
#: Elements of running text: a name marks them only if it has no word besides marks and these plain ones.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tbody tr td th figure figcaption dl dt dd".split())
PLAIN = frozenset("area bar block body box button container content group head heading inner item items label link links list module notice panel post posts section slot text title unit wrap wrapper".split())
#: Marks that tell nothing about a table or paragraph.
VAGUE = frozenset("widget widgets response responses reply".split())
#: Left out only while they end: if a page has nothing else, what follows an unclosed one counts.
MAY_STAY_OPEN = frozenset("nav header footer aside form menu dialog".split())
#: Share of the winner's text outside links from which another article stays.
ALSO = 0.25
#: Marks only outside the article, where an article has parts of the same name.
OUTSIDE = frozenset("header topbar".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that say what an element has or lacks, not what it is.
_ABOUT = re.compile(r"\b(?:has|no|not|with|without|is|hide|show)[-_][a-z_-]+")
#: What closes an open element of the same group (a page rarely ends its paragraphs and list items itself).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WORDS = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool]] = []  # element, left out, region, inside an article or main element
        self.count: dict[str, int] = {}  # open elements of each name
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, region
        self.hidden: list[tuple[str, int, int, int]] = []  # the same of what is left out while it may yet stay open
        self.parents = [0]  # the region around each region
        self.parts: list[str] = []
        self.unsure: list[str] = []
        self.tags = self.linked = 0

    def _line(self) -> None:
        region = self.open[-1][2] if self.open else 0
        for parts, lines in ((self.parts, self.lines), (self.unsure, self.hidden)):
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, max(1, self.tags), self.linked, region))
            parts.clear()
        self.tags = self.linked = 0

    def _left_out(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> int:
        """3: never shown, 2: never main text, 1: marked by its name only, 0: none of these."""
        if tag in NEVER or tag == "header" and not inside:
            return 2 if tag in MAY_STAY_OPEN else 3
        if tag in ("html", "body"):
            return 0
        named = dict(attrs)
        if "hidden" in named or (named.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", named.get("style") or "", re.I):
            return 2
        if (named.get("role") or "").lower() in ROLES:
            return 2
        names = _ABOUT.sub(" ", f"{named.get('class') or ''} {named.get('id') or ''}".lower()).split()
        words = [set(_WORDS.findall(name)) for name in names]
        if tag in TEXT:
            words = [w for w in words if w <= MARKS | PLAIN | OUTSIDE and not w <= PLAIN | VAGUE]
        every = set().union(*words)
        if every & COMMENTS:
            return 2
        return int(tag not in ("article", "main") and bool(every & MARKS or not inside and every & OUTSIDE))

    def _pop(self, at: int) -> None:
        for tag, *_ in self.open[at:]:
            self.count[tag] -= 1
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in NEVER:
            self._line()
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
                self.unsure.append(" ")
            self.tags += 1
            return
        for group in (CLOSES.get(tag, ()), {"p"} if tag in BLOCKS else ()):
            if group and self.open and self.open[-1][0] in group:
                self._pop(len(self.open) - 1)
        _, above, region, inside = self.open[-1] if self.open else ("", 0, 0, False)
        out = max(above, self._left_out(tag, attrs, inside))
        if tag in ("article", "main"):
            inside = True
            if out < 3:
                self.parents.append(region)
                region = len(self.parents) - 1
            if out < 2:  # a name around the whole article doesn't count
                out = 0
        self.open.append((tag, out, region, inside))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe", "object"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in NEVER:
            self._line()
        if not self.count.get(tag):  # so that an end without a start costs nothing
            return
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            at -= 1
        if tag not in ("html", "body") and self.open[at][1] and not (at and self.open[at - 1][1]):
            self.hidden.clear()  # what is left out has ended, so nothing of it counts
        self._pop(at)

    def handle_data(self, data: str) -> None:
        out = self.open[-1][1] if self.open else 0
        if out < 3:
            (self.unsure if out else self.parts).append(data)
            if any(t == "a" for t, *_ in self.open[-4:]):
                self.linked += len(data.strip())

    def finish(self) -> list[tuple[str, int, int, int]]:
        self.close()
        self._line()
        return self.lines or self.hidden


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The ratios with a normalised Gaussian over the neighbouring lines."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """The border between two one-dimensional clusters (two means, started at both ends)."""
    low, high = values.min(), values.max()
    for _ in range(rounds):
        border = (low + high) / 2
        below, above = values[values < border], values[values >= border]
        if not len(below) or not len(above):
            return border
        moved = below.mean(), above.mean()
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def main_blocks(html: str | None, sigma: float = 1.0) -> list[str]:
    """The blocks of the main text, in page order."""
    parser = _Lines()
    parser.feed(html or "")
    lines = parser.finish()
    if not lines:
        return []
    size = np.array([len(t) for t, _, _, _ in lines], float)
    tags = np.array([n for _, n, _, _ in lines], float)
    linked = np.array([n for _, _, n, _ in lines], float)
    region = np.array([r for _, _, _, r in lines])
    smoothed = smooth(np.maximum(size - linked, 0) / tags, sigma)
    content = smoothed >= threshold(smoothed)
    votes = np.bincount(region[content], weights=size[content], minlength=len(parser.parents))
    if not votes[1:].any():  # no article: outside clusters of content, lines of links go
        runs = np.flatnonzero(content)
        inside = (np.arange(len(lines)) >= runs[0]) & (np.arange(len(lines)) <= runs[-1])
        keep = (region == int(votes.argmax())) & (inside | (linked < 0.5 * size))
    else:
        best = 1 + int(votes[1:].argmax())  # an article or main element with content is before the rest of the page
        plain = np.bincount(region, weights=np.maximum(size - linked, 0), minlength=len(votes))
        stays = plain >= ALSO * plain[best]
        stays[0], around = False, parser.parents[best]
        keep = stays[region]
        while around:  # what the elements around the winner say, but for their links
            keep |= (region == around) & (linked < 0.5 * size)
            around = parser.parents[around]
    return [t for (t, _, _, _), k in zip(lines, keep) if k]


def extract_text(pages: DataFrame, *, sigma: float = 1.0) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks.

    Blocks are joined by a blank line; white space inside a block is one space. A page of null, empty or markup-only
    html has the empty text and 0 characters. Broken markup is read as far as the parser gets, which is always to the
    end. Rows that repeat a page_id are separate pages; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(h, sigma) for h in batch.column(2).to_pylist()]
            texts = ["\n\n".join(b) for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long, n_blocks int")
