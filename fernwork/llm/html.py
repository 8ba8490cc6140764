"""Main text of HTML pages from streaming parser events, text-to-tag ratios and threshold clustering.

The standard library's parser feeds events one by one; block elements cut the page into lines. Each line has its
text-to-tag ratio: characters of text (links' text not counted) over tags inside the line plus one. The smoothed ratio
is scaled: by the share of the line that isn't links, down where elements, class names or a copyright sign hint at
boilerplate, and down outside the article and main elements of a page that has any. A hint scales, it doesn't delete; one
of the soft kind (a form, a "social" box) that holds half of the page's text scales nothing.

The ratios are smoothed with a Gaussian kernel and, scaled, split in two clusters by Otsu's threshold. The lines of the
upper cluster are content wherever they stand, but in records; the container (article, main, section, div, body) that
holds most of their text directly is the core, and from it the content region grows over lines of the lower cluster that
aren't mostly links nor hinted at as boilerplate:

* Inside the core to all of them.
* Outside, container by container, to those in an element of text (heading, paragraph, section, article, list, table,
  quotation). Beyond an outermost article or main element it grows to further articles alone.

Records are the reader comments of pages without telling names: two or more neighbouring elements of the same shape
without headings, each beginning with a short line, that the core isn't one of and that hold less than it.

Every element is handled once when it opens and once when it closes, however deep it stands, so the work is linear in
the page.

Defined results: null or empty html, or html without text, gives an empty text; broken markup (unclosed or
stray tags, a page that breaks off) is read as far as it goes; pages of many megabytes or with hundreds of thousands
of nested elements are read whole; rows are kept one to one, repeated rows included; null ids stay null; an empty
table gives an empty table; other columns are ignored, also those named like results. Ties between containers go to
the one that opens first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fernwork.llm.common import ship

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video select option textarea button datalist map".split())
CONTAINER = frozenset("div section article main body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose short lines belong to the text around them.
TEXTUAL = HEADINGS | frozenset("p section article ul ol dl table blockquote pre figure hgroup".split())
#: What may stand in head; anything else closes it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template head html".split())
#: Elements of boilerplate, and the one that often stands around a whole page.
BOILER = frozenset("nav aside footer dialog menu search".split())
#: Elements that end an open paragraph or item of their own kind.
ENDS_P = BLOCK - {"html", "body"}
SELF_END = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}
#: Words in class, id or role that hint at boilerplate, strongly or softly, words that start so, and words that void soft ones.
STRONG_WORDS = frozenset("ad ads adv adbox adslot banner sidebar related reply replies respond sponsored nav navbar navigation footer breadcrumb breadcrumbs pagination pager disqus menu".split())
STARTS = ("comment", "sidebar", "advert", "cookie")
SOFT_WORDS = frozenset("aside masthead topbar header toolbar sponsor promo promotion consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social recommended recommendations widget skip search complementary contentinfo disclaimer".split())
CONTENT_WORDS = frozenset("article content main post entry story".split())
#: What is left of a line's ratio under a strong and a soft hint.
STRONG, SOFT = 0.02, 0.3
#: Characters up to which a record's first line is short, and a line that begins with a copyright sign a notice.
RECORD, RIGHTS = 60, 200
_WORD = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_RIGHTS = re.compile(r"(©|\(c\) |copyright (©|\(c\)|\d{4}))", re.I)


class Lines(HTMLParser):
    """Collects lines (text, tags inside, text in links, innermost element) and the tree of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        # the tree: element 0 is the page; parents come before their children
        self.names, self.parents, self.hints = ["#page"], [0], [1.0]
        self.stack: list[tuple[int, bool]] = []  # open elements, and whether they hide
        self.at: dict[str, list[int]] = {}  # where in the stack elements of a name are open
        self.blocks: list[int] = []  # where blocks are open
        self.off = self.links = self.semantic = 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.text and (s := " ".join("".join(self.text).split())):
            self.lines.append((s, self.tags, min(self.linked, len(s)), self.here()))
        self.text, self.tags, self.linked = [], 0, 0

    def here(self) -> int:
        """The innermost open block."""
        return self.stack[self.blocks[-1]][0] if self.blocks else 0

    def last(self, *names: str) -> int:
        """Where in the stack the innermost open element of some names stands, -1 if none."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            element, off = self.stack.pop()
            name = self.names[element]
            self.at[name].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            self.off -= off
            self.links -= name == "a"
            self.semantic -= name in ("article", "main")

    def leave_head(self, tag: str = "") -> None:
        """Closes an open head whose end tag was left out."""
        k = self.last("head")
        if k >= 0 and (tag == "body" or k == len(self.stack) - 1):
            self.pop(k)

    def hint(self, tag: str, attrs: list) -> float:
        """What an element leaves of the ratio of its lines."""
        if tag in BOILER or tag == "header" and not self.semantic:
            return STRONG
        if tag == "form":
            return SOFT
        if tag not in BLOCK or tag in ("body", "html", "main"):
            return 1.0
        marks = {w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v.lower())}
        if not marks:
            return 1.0
        if marks & STRONG_WORDS and not (marks & CONTENT_WORDS and not marks & {"ad", "ads", "sidebar", "related", "reply", "replies"}) or any(w.startswith(STARTS) for w in marks):
            return STRONG
        return SOFT if marks & SOFT_WORDS and not marks & CONTENT_WORDS and tag != "article" else 1.0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in IN_HEAD:
            self.leave_head(tag)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag in BLOCK:
            self.flush()
            if tag in ENDS_P and (k := self.last("p")) >= 0 and self.blocks[-1] == k:
                self.pop(k)
        if tag in SELF_END:
            same, scope = SELF_END[tag]
            if (k := self.last(*same)) > self.last(*scope):
                self.pop(k)
        if tag in ("td", "th"):
            self.text.append(" ")
        off = tag in HIDDEN or any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _UNSEEN.search(v) for k, v in attrs)
        above = self.stack[-1][0] if self.stack else 0
        self.names.append(tag)
        self.parents.append(above)
        self.hints.append(1.0 if off else self.hint(tag, attrs))
        where = len(self.stack)
        self.stack.append((len(self.names) - 1, off))
        self.at.setdefault(tag, []).append(where)
        if tag in BLOCK:
            self.blocks.append(where)
        self.off += off
        self.links += tag == "a"
        self.semantic += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        k = self.last(tag)
        # an inline end tag doesn't reach beyond its block
        if k >= 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] < k):
            self.pop(k)

    def handle_data(self, data):
        if self.off and data.strip():
            self.leave_head()
        if not self.off:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the kernel's weights are made to sum to 1 at the ends as well."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    near = np.convolve(ratios, kernel, "full")[reach : reach + len(ratios)]
    return near / np.convolve(np.ones(len(ratios)), kernel, "full")[reach : reach + len(ratios)]


def split_point(x: np.ndarray) -> float:
    """Otsu's threshold: the cut that leaves the least variance inside the two clusters."""
    s = np.sort(x)
    if len(s) < 2 or s[0] == s[-1]:
        return s[0] if len(s) else 0.0
    n = np.arange(1, len(s))
    low = np.cumsum(s)[:-1]
    between = n * (len(s) - n) * ((low / n) - (s.sum() - low) / (len(s) - n)) ** 2
    return float(s[int(np.argmax(between)) + 1])


def clusters(ratios: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Which lines are in the upper of the two clusters of the smoothed and scaled ratios."""
    level = smoothed(ratios) * scale
    return level >= split_point(level)


class Tree:
    """A page's elements with what their lines add up to; every table is made in one pass over the elements."""

    def __init__(self, page: Lines):
        self.names, self.parents = page.names, page.parents
        self.lines = page.lines
        n = len(self.names)
        self.mass = [0] * n  # characters that aren't in links, in all below
        self.first: list[int | None] = [None] * n  # the first line below
        self.headed = [x in HEADINGS for x in self.names]
        for k, (text, _, linked, e) in enumerate(self.lines):
            self.mass[e] += len(text) - linked
            if self.first[e] is None:
                self.first[e] = k
        for e in range(n - 1, 0, -1):
            p = self.parents[e]
            self.mass[p] += self.mass[e]
            self.headed[p] = self.headed[p] or self.headed[e]
            if self.first[e] is not None and (self.first[p] is None or self.first[e] < self.first[p]):
                self.first[p] = self.first[e]
        total = self.mass[0]
        self.hint, self.container, self.semantic = [1.0] * n, [0] * n, [False] * n
        for e in range(1, n):
            own = page.hints[e]
            if own == SOFT and 2 * self.mass[e] >= total:
                own = 1.0
            self.hint[e] = min(own, self.hint[self.parents[e]])
            self.semantic[e] = self.names[e] in ("article", "main") or self.semantic[self.parents[e]]
            self.container[e] = e if self.names[e] in CONTAINER else self.container[self.parents[e]]

    def above(self, e: int) -> list[int]:
        """An element and all around it, up to the page."""
        out = [e]
        while e:
            e = self.parents[e]
            out.append(e)
        return out

    def records(self, core: int, around: set[int]) -> list[bool]:
        """Which elements are records, or inside one."""
        n = len(self.names)
        shape: list[list] = [[] for _ in range(n)]
        for e in range(1, n):
            if self.first[e] is not None and self.names[e] in BLOCK:
                shape[self.parents[e]].append(self.names[e])
        rows: dict[int, dict[tuple, list[int]]] = {}
        for e in range(1, n):
            if self.names[e] in ("div", "li", "article", "section") and self.first[e] is not None and not self.headed[e] and len(shape[e]) > 1:
                rows.setdefault(self.parents[e], {}).setdefault((self.names[e], *shape[e][:2]), []).append(e)
        out = [False] * n
        for p, kinds in rows.items():
            for same in kinds.values():
                if len(same) < 2 or any(e in around for e in same) or sum(self.mass[e] for e in same) >= self.mass[core]:
                    continue
                if all(len(self.lines[self.first[e]][0]) <= RECORD for e in same):
                    for e in same:
                        out[e] = True
        for e in range(1, n):
            out[e] = out[e] or out[self.parents[e]]
        return out


def main_text(html: str | None) -> str:
    """Text of the main content; blocks in page order, joined by an empty line."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    tree, lines = Tree(page), page.lines
    hint = np.array([STRONG if len(t) <= RIGHTS and _RIGHTS.match(t) else tree.hint[e] for t, *_, e in lines])
    ratios = np.array([(len(t) - linked) / (tags + 1) for t, tags, linked, _ in lines])
    place = np.array([1.0 if tree.semantic[e] else SOFT for *_, e in lines])
    own = np.array([1 - linked / len(t) for t, _, linked, _ in lines])  # neighbours lend a link no text
    chosen = clusters(ratios, own * hint * (place if place.max() == 1 else 1.0))
    votes: dict[int, int] = {}
    for (text, _, linked, e), on, h in zip(lines, chosen, hint, strict=True):
        if on and h == 1 and 2 * linked <= len(text):
            votes[tree.container[e]] = votes.get(tree.container[e], 0) + len(text) - linked
    if not votes:  # nothing in the upper cluster but hinted lines: what isn't hinted is all there can be
        for (text, _, linked, e), h in zip(lines, hint, strict=True):
            if h == 1 and 2 * linked <= len(text):
                votes[tree.container[e]] = votes.get(tree.container[e], 0) + len(text) - linked
    if not votes or max(votes.values()) == 0:
        return ""
    core = max(votes, key=lambda c: (votes[c], -c))
    path = tree.above(core)
    around = set(path)
    top = next((k for k in range(len(path) - 1, -1, -1) if tree.names[path[k]] in ("article", "main")), None)
    inner = set(path if top is None else path[: top + 1])  # where the region grows to any text
    records = tree.records(core, around)
    # for every element: the nearest around it that is the core or around the core, and by which child of that
    n = len(tree.names)
    joint, branch = [0] * n, [0] * n
    for e in range(1, n):
        p = tree.parents[e]
        joint[e], branch[e] = (e, e) if e in around else (p, e) if p in around else (joint[p], branch[p])
    out = []
    for k, (text, _, linked, e) in enumerate(lines):
        wordy, plain = 2 * linked <= len(text), hint[k] == 1
        if records[e]:
            continue
        if joint[e] == core:
            near = True
        elif joint[e] in inner:
            near = tree.names[branch[e]] in TEXTUAL
        else:
            near = tree.names[branch[e]] == "article" and tree.names[path[top]] == "article"
        if chosen[k] or near and plain and wordy:
            out.append(text)
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (main content, empty if none), n_chars (its code points)."""
    ship(pages.sparkSession)
    kept = pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), pages[html_col].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [kept.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return kept.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
