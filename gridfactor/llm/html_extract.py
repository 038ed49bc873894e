"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's HTMLParser streams events.  A line is the text between two block boundaries; it
counts the tags seen since the last line; its ratio is characters to tags.  Names are a prior: the ratio of
a line inside navigation, page headers, footers, sidebars, notices, adverts, forms and reader comments, by
element, class, id or role, is multiplied by PRIOR.  What a page doesn't show (scripts, styles, hidden
elements, choices of a list) has no lines.  Ratios are smoothed inside runs of lines with one prior, so that
an advert between long paragraphs isn't lifted by them.  The smoothed ratios of lines are split into two
clusters by the threshold between the clusters' means.

A region (the article or main element around a line; without any, the innermost sectioning block) is content
if a line of it is in the upper cluster that isn't mostly links (without any such line, one that is).  An article or main element is a region's extent and else only a
prior: one with half of the page's text or more is content too.  Kept are all lines of content regions but
those with the low prior, so that short paragraphs and headings stay; of lines with the low prior, those
whose ratio is in the upper cluster all the same.

Class and id words that articles use too (discussion, related, share and the like; in an article or main
element all such words beside others, as in ad-hoc-analysis) only raise a doubt: such an element gets the
low prior if all its lines are in the lower cluster or most of its text is links.  The id of a heading or
section raises none, a heading in an article none at all.  Formulas are text, their annotations aren't.

Nulls: a null or empty page gives an empty text.  Repeated rows are kept, an empty table gives no rows.
Very long pages are parsed whole.  Broken markup: end tags without a start are ignored, an end tag closes
what is open inside its element, p, li, cells and the like close each other as HTML says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements by their part in a page, and words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mtable mtr mtd mstyle mpadded mspace menclose semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
UNSEEN = frozenset("button select option textarea script style noscript template iframe svg object canvas head title audio video annotation annotation-xml mphantom".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login"
    " comment comments commentlist respond replies disqus discussion breadcrumb breadcrumbs share sharing social related recommended pagination pager".split()
)
MARKED_UNLESS_CONTENT = frozenset("nav navbar navigation menu topbar header masthead footer sidebar side widget widgets banner toolbar search".split())
CONTENT = frozenset("content article main post entry story body text page wrapper container layout".split())
#: Words that only say what is marked, as in ad-slot or comment-list.
NEUTRAL = frozenset("area bar block box btn button card cell col container content entry footer form group header holder inline inner inpage item items left link links list lists main message module outer page panel post right row section site slot strip thread title top unit widget widgets wrap wrapper".split())
#: Words of MARKED that articles use too.
UNSURE = frozenset("discussion related recommended share sharing social respond replies subscribe promotion consent notice notices login signup modal overlay cookie cookies advertising sponsor".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = HEADINGS | {"section"}
FOREIGN = frozenset("svg math".split())
#: What the ratios of lines in chrome are multiplied by; beyond MOST characters a tag, a ratio says no more.
PRIOR, MOST = 2.0**-8, 1024.0
#: The share of the upper cluster's text that a region has to hold.
MOST_OF = 0.8
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def smoothed(ratios: np.ndarray, kinds: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Ratios after a Gaussian kernel inside each run of lines of one kind."""
    cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    return np.concatenate([_smoothed_run(run, sigma) for run in np.split(ratios, cuts)])


def _smoothed_run(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """At the ends, the kernel is what is inside."""
    half = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(ratios)), kernel)[half : half + len(ratios)]
    return np.convolve(ratios, kernel)[half : half + len(ratios)] / inside


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters, found by moving it until it stays."""
    t = float(values.mean())
    for _ in range(50):
        upper, lower = values[values >= t], values[values < t]
        if not len(lower) or not len(upper):
            return t
        new = (float(upper.mean()) + float(lower.mean())) / 2
        if new == t:
            break
        t = new
    return t


class _Lines(HTMLParser):
    """Collects lines: text, tags, whether it is chrome, its region (a key), and the kind of region."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # name, whether it is chrome (1) or in doubt (2)
        self.chrome = 0
        self.unseen = 0
        self.doubts: list[int] = []  # of open elements
        self.n_doubts = 0
        self.links = 0  # open ones
        self.linked = 0  # characters of the line in links
        self.more: list[tuple[tuple[int, ...], int]] = []  # of each line: its doubts, characters in links
        self.regions: list[tuple[int, str]] = [(0, "")]  # of open elements: number and kind
        self.at: list[int] = []  # depth of self.open at each region
        self.count = 0
        self.elements: list[tuple[int, str]] = [(0, "")]  # parent and name of every element but inline ones
        self.inside: list[tuple[int, int]] = [(0, -1)]  # the open ones, and their depth in self.open
        self.where: list[int] = []  # each line's innermost element
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, bool, int, str]] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split()) if not self.unseen else ""
        self.parts.clear()
        if text:
            self.lines.append((text, self.tags, self.chrome > 0, *self.regions[-1]))
            self.more.append((tuple(self.doubts), self.linked))
            self.where.append(self.inside[-1][0])
            self.tags = 0
        self.linked = 0

    def is_chrome(self, tag: str, attrs: list) -> int:
        """1 for chrome, 2 for a doubt, 3 for what isn't shown, else 0."""
        if tag in UNSEEN:
            return 3
        if tag in CHROME:
            return 1
        if tag in ("html", "body", "main", "article"):
            classes = " ".join(value or "" for name, value in attrs if name == "class").lower()
            return tag == "article" and "comment" in re.split(r"[^a-z0-9]+", classes)
        inside = self.regions[-1][1] in ("article", "main")
        if tag == "header":
            return not inside
        doubt = 0
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and HIDDEN.search(value)):
                return 3
            if name == "role" and value and value.lower() in ROLES:
                doubt = 1
                continue
            if name in ("class", "id") and value:
                every = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower()
                words = set(re.split(r"[^a-z0-9]+", every))
                by_part = words & MARKED_UNLESS_CONTENT and not words & CONTENT and not (inside and "header" in words)
                if inside and tag in HEADINGS:
                    continue
                tokens = [{w for w in re.split(r"[^a-z0-9]+", x) if w and not w.isdigit()} for x in every.split()]
                only_marks = any(x & MARKED - UNSURE and x <= MARKED | MARKED_UNLESS_CONTENT | NEUTRAL for x in tokens)
                if only_marks or not inside and words & MARKED - UNSURE or by_part and not inside:
                    doubt = 1
                    continue
                if not words & MARKED and not by_part or name == "id" and tag in NAMED:
                    continue
                # several marking words alone, as in cookie-notice, leave no doubt; nor does sidebar or nav in an article
                if any(x and x <= MARKED | MARKED_UNLESS_CONTENT and (len(x) > 1 or x <= MARKED_UNLESS_CONTENT) and (by_part or x & MARKED) for x in tokens):
                    doubt = 1
                doubt = doubt or 2
        return doubt

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            name, kind = self.open.pop()
            self.chrome -= kind == 1
            self.unseen -= kind == 3
            self.links -= name == "a"
            if kind == 2:
                self.doubts.pop()
        while self.inside[-1][1] >= depth:
            self.inside.pop()
        while self.at and self.at[-1] >= depth:
            self.at.pop()
            self.regions.pop()

    def close_open(self, names: tuple, until: tuple) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in until:
                return
            if self.open[k][0] in names:
                self.pop_to(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.end_line()
            self.tags += not self.tags
        if tag in ENDS_P:
            self.close_open(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "button", "object", "table"))
        if tag in CLOSES:
            self.close_open(CLOSES[tag], SCOPE[tag])
        if tag in VOID:
            return
        chrome = self.is_chrome(tag, attrs)
        if chrome and tag in INLINE:
            self.end_line()
        kind = self.regions[-1][1]
        if (tag == "article" and kind != "article") or (tag == "main" and kind not in ("article", "main")) or (tag in ("section", "div", "td", "body") and kind not in ("article", "main")):
            self.count += 1
            self.regions.append((self.count, tag))
            self.at.append(len(self.open))
        if tag not in INLINE:
            self.elements.append((self.inside[-1][0], tag))
            self.inside.append((len(self.elements) - 1, len(self.open)))
        self.open.append((tag, int(chrome)))
        self.chrome += chrome == 1
        self.unseen += chrome == 3
        self.links += tag == "a"
        if chrome == 2:
            self.n_doubts += 1
            self.doubts.append(self.n_doubts)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in FOREIGN or self.in_foreign():
            self.tags += 1  # closes itself; of HTML elements only void ones do
            return
        self.handle_starttag(tag, attrs)

    def in_foreign(self) -> bool:
        for name, _ in reversed(self.open):
            if name in FOREIGN or name in ("foreignobject", "annotation-xml"):
                return name in FOREIGN
        return False

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag not in INLINE or any(c for _, c in self.open[k:]):
                    self.end_line()
                self.pop_to(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return
        if tag not in INLINE:
            self.end_line()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def main_text(html: str | None) -> str:
    """The text of a page's article: kept lines, joined by one space."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    mine = np.array([not line[2] for line in lines])
    if not mine.any():
        return ""
    ratios = np.array([min(MOST, len(text) / max(1, tags)) for text, tags, *_ in lines])
    level = smoothed(np.where(mine, ratios, PRIOR * ratios), mine)
    upper = level >= threshold(level[mine])
    doubtful: dict[int, list[int]] = {}
    for k, (doubts, _) in enumerate(parser.more):
        for doubt in doubts if not lines[k][2] else ():
            doubtful.setdefault(doubt, []).append(k)
    low = [of for of in doubtful.values() if not upper[of].any() or 2 * sum(parser.more[k][1] for k in of) > sum(len(lines[k][0]) for k in of)]
    for of in low:
        mine[of] = False
    if not mine.any():
        return ""
    if low:
        level = smoothed(np.where(mine, ratios, PRIOR * ratios), mine)
    upper = level >= threshold(level[mine])
    region = np.array([line[3] for line in lines])
    links = np.array([2 * linked > len(line[0]) for (_, linked), line in zip(parser.more, lines)])
    chosen = set(region[mine & upper & ~links]) or set(region[mine & upper])
    sizes = np.array([len(line[0]) for line in lines])
    size = np.bincount(region, sizes * mine)
    chosen |= {line[3] for line in lines if line[4] in ("article", "main") and 2 * size[line[3]] >= size.sum()}
    near = grown(parser, sizes, mine, upper & mine, links)
    return " ".join(line[0] for line, ok, up, more in zip(lines, mine, upper, near) if (line[3] in chosen or more if ok else up))


def grown(parser: _Lines, sizes: np.ndarray, mine: np.ndarray, upper: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Lines of the smallest element with most of the upper cluster's text, and of the elements beside it that read like it.

    Beside it: on either side, up to the first that is chrome, mostly links, or without a paragraph or heading.
    Lines that are links and in the lower cluster aren't taken, but in an article or main element.
    """
    elements, where = parser.elements, np.array(parser.where)
    n = len(elements)
    ends = np.arange(1, n + 1)  # elements inside k are those from k to ends[k]: they are numbered as they open
    for k in range(n - 1, 0, -1):
        up = elements[k][0]
        if ends[k] > ends[up]:
            ends[up] = ends[k]

    def of(weight: np.ndarray) -> np.ndarray:
        """The weight of the lines inside each element."""
        sums = np.concatenate([[0.0], np.cumsum(np.bincount(where, weight, n))])
        return sums[ends] - sums[:-1]

    found = of(sizes * (upper & ~links if (upper & ~links).any() else upper))
    most = np.flatnonzero(found >= MOST_OF * found[0])
    at = int(most[found[most] > 0].max(initial=0))  # each of these is inside the one before
    for kind in ("main", "article"):
        up = at
        while up and elements[up][1] != kind:
            up = elements[up][0]
        at = up or at
    inside = np.zeros(n, bool)
    inside[at : ends[at]] = True
    if at:
        all_, count = of(sizes), of(np.ones(len(where)))
        parent = elements[at][0]
        row, k = [], parent + 1
        while k < ends[parent]:
            if all_[k]:
                row.append(k)
            k = int(ends[k])
        place = row.index(at)
        if len(row) > 1:
            bad, linked, of_links = of(sizes * ~mine), of(np.array([x for _, x in parser.more])), of(links * 1.0)
            plain = of(sizes * np.array([elements[k][1] == "p" or elements[k][1] in HEADINGS for k in where]))
            reads = (all_ > 0) & (bad == 0) & (2 * linked <= all_) & (2 * of_links <= count) & (plain > 0)
            for side in (row[place + 1 :], row[:place][::-1]):
                for k in side:
                    if not reads[k]:
                        break
                    inside[k : ends[k]] = True
    whole = elements[at][1] in ("article", "main")
    return inside[where] & (whole | upper | ~links)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch["html"]]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, `text` of the article, `n_chars` (its code points)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")


def op1_html_extract(pages: DataFrame) -> DataFrame:
    return extract_text(pages)
