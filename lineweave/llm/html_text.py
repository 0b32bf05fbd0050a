"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

A page is read once as a stream of events of the standard library's HTML parser. Block elements end lines; each line
knows its container (the innermost sectioning element), the characters of its text, those inside links, and the tags
since the line before. The ratio of text to tags is smoothed along the page with a Gaussian, a threshold from the
ratios' spread parts content from the rest, and a container is content if lines with most of its text are. Elements
whose name, class, id or role says menu, header, footer, sidebar, notice, advert, script, style or comments are never
content, with these bounds: what is said of ``html``, ``body`` and ``main``, or of an element that holds the article, is
about the page and not about its text, nor does a mark count on an element with nearly all of the page's text, or where
nothing else is left; a form is left out unless it wraps the page; an element that the page never closes can't take the
rest of the page with it. Time is linear in a page's size, however its elements are nested.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import pick

SIGMA, THRESHOLD = 1.0, 0.5
#: Left out whole, with the text of these that no page means to show.
UNSEEN = frozenset("script style template".split())
SKIPPED = UNSEEN | frozenset("head nav header footer aside noscript button select textarea iframe object svg canvas dialog menu".split())
#: Of the skipped ones those that hold no section of a page: where one is never closed, what follows is read.
HELD_SHORT = frozenset("head noscript button select textarea iframe object svg canvas".split())
IN_HEAD = UNSEEN | frozenset("head title meta link base noscript".split())
CONTROLS = frozenset("input select textarea button".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body article main section div td".split())
WHOLE_PAGE = frozenset("html body main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words in class or id that mark what is not content; of inline elements and of articles fewer count.
MARKS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|header|masthead|footer|sidebar|side|rail|widget|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|pagination|pager|search|toolbar)(?:$|[_\d-])",
    re.I,
)
INLINE_MARKS = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adsense|share|sharing|social|subscribe|signup|login|commentlink|comments?|reply)(?:$|[_\d-])", re.I)
COMMENT_MARKS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|disqus|reply|replies)(?:$|[_\d-])", re.I)
#: States of a page or of a wrapper, such as no-sidebar or comments-open.
STATES = re.compile(r"^(?:no|has|with|without|hide|show|is|not)[_-]|[_-](?:open|closed|enabled|disabled)$", re.I)
#: Parts of an article that are named with a mark's word.
PARTS = re.compile(r"^(?:article|post|entry|story|content)[_-]+(?:header|banner)$", re.I)
#: A form wraps the page if it holds an article, or half of all text with so many characters for each control.
CHARS_A_CONTROL = 200
#: A mark doesn't count on an element that holds this part of the page's text.
MOST_TEXT = 0.8
SPACE = re.compile(r"\s+")


def marked(attrs: list, marks: re.Pattern) -> bool:
    for name, value in attrs:
        if name in ("class", "id") and value and any(marks.search(x) and not STATES.search(x) and not PARTS.search(x) for x in value.split()):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


class Around:
    """An element that may be left out, linked to the next one around it (``outer``), and what became known of it.

    ``chars``, ``controls``, ``holds_article`` and ``holds_heading`` are of the element alone while the page is read, and are
    passed outwards once at its end, so that nesting costs nothing: ``settle()``.
    """

    __slots__ = ("tag", "outer", "by_mark", "comments", "closed", "holds_article", "holds_heading", "chars", "controls", "out")

    def __init__(self, tag: str, outer: Around | None, by_mark: bool = False, comments: bool = False):
        self.tag, self.outer, self.by_mark, self.comments = tag, outer, by_mark, comments
        self.closed = self.holds_article = self.holds_heading = False
        self.chars = self.controls = 0
        self.out: bool | None = None

    def stays_out(self, strict: bool, most: float) -> bool:
        """Whether this element itself is left out; a mark doesn't count on what holds the article or ``most`` characters."""
        if self.tag in UNSEEN:
            return True
        if not self.closed and (self.tag in HELD_SHORT or not strict):
            return False
        if not self.by_mark or self.comments:
            return True
        return not (self.holds_article or self.chars >= most)


def settle(nodes: list[Around]) -> None:
    """Passes what inner elements hold to those around them; nodes as they were opened, so inner ones come later."""
    for x in reversed(nodes):
        if x.outer is not None:
            x.outer.chars += x.chars
            x.outer.controls += x.controls
            x.outer.holds_article |= x.holds_article
            x.outer.holds_heading |= x.holds_heading


class Lines(HTMLParser):
    """Lines of a page as [container, text, tags before and inside it, characters in links, skip around it, form around it]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, Around | None, Around | None]] = [("", 0, None, None)]  # tag, container, innermost skip and form
        self.count: dict[str, int] = {}  # of open elements by tag
        self.skips: list[Around] = []
        self.forms: list[Around] = []
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.aside_tags = self.linked = self.containers = self.links = 0
        self.silent = 0  # open inline elements that are left out

    def end_line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                _, container, skips, forms = self.open[-1]
                self.lines.append([container, text, self.aside_tags if skips else self.tags, self.linked, skips, forms])
                for x in (skips, forms):
                    if x is not None:
                        x.chars += len(text)
                self.linked = self.aside_tags = 0
                if not skips:
                    self.tags = 0
            self.parts = []

    def push(self, tag: str, container: int, skip: Around | None, form: Around | None) -> None:
        self.open.append((tag, container, skip, form))
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> tuple[str, int, Around | None, Around | None]:
        x = self.open.pop()
        self.count[x[0]] -= 1
        self.silent -= x[0].startswith("~")
        return x

    def end_inline(self) -> None:
        while self.silent and self.open[-1][0].startswith("~"):
            self.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        self.aside_tags += 1
        if tag not in IN_HEAD and self.open[-1][0] == "head":
            self.end_line()
            self.pop()[2].closed = True
        _, container, skips, forms = self.open[-1]
        if tag in CONTROLS and forms is not None:
            forms.controls += 1
        if tag in VOID:
            if tag in ("br", "wbr"):
                self.parts.append(" " if tag == "br" else "")
            elif tag == "hr":
                self.end_line()
            return
        if tag not in BLOCKS and tag not in SKIPPED:
            if tag == "a":
                self.links += 1
            if attrs and marked(attrs, MARKS if tag == "span" else INLINE_MARKS):
                self.push("~" + tag, container, skips, forms)
                self.silent += 1
            elif tag == "span":
                self.push(tag, container, skips, forms)
            return
        self.end_inline()
        self.end_line()
        while self.open[-1][0] == "p" and tag != "p" or self.open[-1][0] == tag and tag in ("p", "li"):
            self.pop()  # not closed in the page
        _, container, skips, forms = self.open[-1]
        for x in (skips, forms):
            if x is not None:
                x.holds_article |= tag in ("article", "main")
                x.holds_heading |= tag == "h1"
        own = None
        if tag in SKIPPED:
            own = Around(tag, skips)
        elif tag == "article":
            if any(marked([x], COMMENT_MARKS) for x in attrs if x[0] == "class"):
                own = Around(tag, skips, True, True)
        elif tag not in WHOLE_PAGE and attrs and marked(attrs, MARKS):
            own = Around(tag, skips, True, marked(attrs, COMMENT_MARKS))
        if own is not None:
            self.skips.append(own)
            skips = own
        if tag == "form":
            forms = Around(tag, forms)
            self.forms.append(forms)
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        self.push(tag, container, skips, forms)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self.aside_tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        block = tag in BLOCKS or tag in SKIPPED
        if block:
            self.end_inline()
            self.end_line()
        if not self.count.get(tag) and (block or not self.count.get("~" + tag)):
            return  # nothing of this name is open
        if not block:
            # an inline element ends within its block only
            k = len(self.open) - 1
            while k and self.open[k][0] not in (tag, "~" + tag):
                if self.open[k][0] in BLOCKS:
                    return
                k -= 1
            while len(self.open) > k > 0:
                self.pop()
            return
        while True:
            name, _, skip, _ = self.pop()
            if skip is not None and skip is not self.open[-1][2] and (name == tag or tag not in ("body", "html")):
                skip.closed = True  # by its own end tag, or with the element around it
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent and not (self.open[-1][2] is not None and self.open[-1][2].tag in UNSEEN):
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text of a whole page, blocks joined by line ends; empty if there is none. Null counts as empty."""
    text = ""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    settle(parser.skips)
    settle(parser.forms)
    unseen = _left_out(parser.skips, lambda x: x.tag in UNSEEN)
    seen = [x for x in parser.lines if x[4] not in unseen]
    half = sum(len(x[1]) for x in seen) / 2

    def of_form(x: Around) -> bool:
        return not (x.holds_article or x.holds_heading) and not (x.chars >= half and x.chars >= CHARS_A_CONTROL * x.controls)

    forms = _left_out(parser.forms, of_form)
    seen = [x for x in seen if x[5] not in forms]
    most = MOST_TEXT * sum(len(x[1]) for x in seen)
    for strict, least in ((True, most), (False, most), (False, 0)):  # at last no mark counts, and density alone tells
        out = _left_out(parser.skips, lambda x: x.stays_out(strict, least))  # noqa: B023
        if text := _content([x for x in seen if x[4] not in out], sigma, threshold):
            break
    return text


def _left_out(nodes: list[Around], rule) -> set[Around]:
    """The elements that a rule, or one around them, leaves out; nodes as they were opened."""
    out: set[Around] = set()
    for x in nodes:
        if x.outer in out or rule(x):
            out.add(x)
    return out


def _content(lines: list[list], sigma: float, threshold: float) -> str:
    if not lines:
        return ""
    size = np.array([len(x[1]) for x in lines], float)
    linked = np.array([x[3] for x in lines], float)
    ratio = smoothed(np.maximum(0.0, size - linked) / np.maximum(1.0, [x[2] for x in lines]), sigma)
    content = ratio >= min(threshold * ratio.std(), ratio.max())
    where = np.array([x[0] for x in lines])
    total, good, links = (np.bincount(where, x) for x in (size, size * content, linked))
    chosen = (good * 2 >= total) & (links * 2 <= total) & (total > 0)
    return "\n".join(x[1] for x in lines if chosen[x[0]])


def extract(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars: one row per page, also for repeated rows and null ids and urls.

    Null and empty pages, and pages without content, give an empty text. Broken markup is read as the parser sees it;
    very long pages are read whole. An empty table gives no rows.
    """

    @F.arrow_udf("string")
    def of(html: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), sigma, threshold) for x in html], pa.string())

    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", of("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
