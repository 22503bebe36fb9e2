"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams a page's tags and text. Text between block tags is a line with its ratio of
text to tags, which falls with the share of link text and below elements that seldom hold article text (menus, forms,
names such as "sidebar"); ratios are smoothed by a Gaussian, and lines above a threshold form clusters of content. The
region is the article or main element that holds most clustered text or else the smallest container that holds all of
it. Of an article or main element every block is kept, short ones too. Elsewhere the clusters choose: kept are their lines,
blocks beside these in the same container that are no links, and headings right before what is kept. Elements inside the
region that are set apart are dropped, but for an article's headings in its header; what encloses the region drops
nothing, whatever its name, nor does a form around the whole page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul hr".split()
)
#: Elements whose content is no text of the page.
NO_TEXT = frozenset("script style head title noscript template svg math iframe object canvas audio video datalist textarea select option".split())
#: Elements that seldom hold article text.
APART = frozenset("nav header footer aside form button menu dialog".split())
#: Words of a class, id or role that mark such elements.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer"
    " disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion"
    " promotions related recommended recommendations replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe"
    " subscription tags toolbar topbar widget widgets complementary contentinfo alert".split()
)
#: Those that mark readers' comments, of an article element too, and what may stand beside them.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
BESIDE_COMMENTS = frozenset("author authors body container content entry new post posts reader readers thread threads user users wrap wrapper".split())
#: A paragraph with this name is a remark of the article.
REMARKS = frozenset({"alert"})
#: Words that may stand beside a mark in a name ("cookie-bar"); with any other word the name is no mark ("has-sidebar").
BESIDE = frozenset("area bar block box button buttons form inner item items left link links list message page panel right section site slot text unit".split())
#: Containers whose lines belong to what stands around them.
PARTS = frozenset("ul ol dl table tbody thead tfoot tr blockquote figure details hgroup span li".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers too small to be a region.
SMALL = HEADINGS | frozenset("p li td tr tbody blockquote pre dd dt".split())
SPACE = re.compile(r"\s+")
SIGMA, THRESHOLD, HOLD = 1.0, 0.5, 0.7
#: What is left of the ratio of a line that an element sets apart, and of text that is all links.
WEIGHT = 0.1
#: How a line of the page's owner begins; outside articles its ratio is lowered as if an element set it apart.
RIGHTS = re.compile(r"(?i)(©|\(c\)|copyright\b)")
#: A line is links if so much of it is.
LINKED = 0.5
#: Share of the threshold that a cluster's first and last line reach without smoothing, if they are no headings.
OWN = 0.25
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-2, 3)]
#: What an opening element closes besides an open paragraph.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HIDDEN = re.compile(r"display\s*:\s*none")


def is_hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value.lower()) for name, value in attrs)


def is_marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """A name is a mark as a whole: a word of MARKS and besides it only such words and those of BESIDE. For an article
    element only the names of comments count."""
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for whole in value.lower().split():
                parts = set(re.split(r"[^a-z]+", whole)) - {""}
                if not COMMENTS.isdisjoint(parts) and parts <= MARKS | BESIDE | BESIDE_COMMENTS:
                    return True
                if tag != "article" and not MARKS.isdisjoint(parts) and parts <= MARKS | BESIDE and not (tag == "p" and parts <= REMARKS):
                    return True
    return False


class _Page(HTMLParser):
    """Lines of a page: (text, tags met, characters of links, node).

    Nodes are the containers in the order they open. ``parent``, ``names`` and ``end`` (the first node after those
    inside) describe them; ``apart`` is the innermost node, from the node itself up, that is set apart (-1: none).
    An inline element that is set apart counts only where a whole line lies in it; such a line gets a node of its own.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.parent, self.end, self.apart = ["page"], [-1], [0], [-1]
        self.blocks: list[tuple[str, int, bool]] = [("page", 0, False)]  # open ones: name, node, no text
        self.inline: list[dict[str, int]] = [{}]  # of each open block: open inline elements by name
        self.open: dict[str, int] = {}  # open blocks by name
        self.special: list[list[str]] = [[]]  # of each open block: open inline elements that are set apart, or have no text
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.aside: list[bool] = []  # for each piece of text: within an inline element that is set apart
        self.links = self.tags = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            node = self.blocks[-1][1]
            if all(a for a, t in zip(self.aside, self.text, strict=True) if not t.isspace()):
                node = self.node("span", True)
                self.end[node] = len(self.names)
            self.lines.append((text, self.tags, self.links, node))
            self.tags = 0
        self.links = 0
        self.text.clear()
        self.aside.clear()

    def node(self, name: str, apart: bool) -> int:
        above = self.blocks[-1][1]
        self.names.append(name)
        self.parent.append(above)
        self.end.append(0)
        self.apart.append(len(self.names) - 1 if apart else self.apart[above])
        return len(self.names) - 1

    def pop(self) -> None:
        self.flush()
        name, node, _ = self.blocks.pop()
        self.inline.pop()
        self.special.pop()
        self.open[name] -= 1
        self.end[node] = len(self.names)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.add(" ")
        elif tag in BLOCK:
            self.flush()
            closed = SIBLINGS.get(tag, ())
            while (top := self.blocks[-1][0]) == "p" or top in closed:
                self.pop()
            if tag not in VOID:
                free = tag in ("html", "body", "main")
                none = self.blocks[-1][2] or bool(self.special[-1] and any(x in NO_TEXT for x in self.special[-1])) or tag in NO_TEXT or not free and tag != "article" and is_hidden(attrs)
                node = self.node(tag, not free and (tag in APART or is_marked(tag, attrs)))
                self.blocks.append((tag, node, none))
                self.inline.append({})
                self.special.append([])
                self.open[tag] = self.open.get(tag, 0) + 1
        elif tag not in VOID:
            here = self.inline[-1]
            here[tag] = here.get(tag, 0) + 1
            if tag in NO_TEXT or is_hidden(attrs):
                self.special[-1].append(tag if tag in NO_TEXT else "script:" + tag)
            elif tag in APART or is_marked(tag, attrs):
                self.special[-1].append(tag)

    handle_startendtag = handle_starttag  # as browsers do, the slash is ignored

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            if self.open.get(tag):
                while self.blocks[-1][0] != tag:
                    self.pop()
                self.pop()
            elif tag == "p":
                self.flush()
        elif n := self.inline[-1].get(tag):  # an inline tag closes nothing outside its block
            self.inline[-1][tag] = n - 1
            for name in (tag, "script:" + tag):
                if self.special[-1] and self.special[-1][-1] == name:
                    self.special[-1].pop()
                    break

    def add(self, data: str) -> None:
        special = self.special[-1]
        if self.blocks[-1][2] or special and any(x in NO_TEXT or x.startswith("script:") for x in special[-8:]):
            return
        self.text.append(data)
        self.aside.append(bool(special))

    def handle_data(self, data: str) -> None:
        self.add(data)
        if self.inline[-1].get("a"):
            self.links += len(data)

    def finish(self) -> None:
        while len(self.blocks) > 1:
            self.pop()
        self.flush()
        self.end[0] = len(self.names)
        self.unwrap()

    def unwrap(self) -> None:
        """A form around most of the page's text, with headings or paragraphs, is a part of its layout."""
        chars, prose = [0] * len(self.names), [False] * len(self.names)
        for text, _, _, node in self.lines:
            chars[node] += len(text)
        for node in range(len(self.names) - 1, 0, -1):
            up = self.parent[node]
            chars[up] += chars[node]
            prose[up] |= prose[node] or self.names[node] == "p" or self.names[node] in HEADINGS
        for node in range(1, len(self.names)):
            own = self.apart[node] == node and not (self.names[node] == "form" and prose[node] and chars[node] >= HOLD * chars[0])
            self.apart[node] = node if own else self.apart[self.parent[node]]

    def titled(self, node: int) -> bool:
        """Whether a heading is in the header of an article, or is the chief one in that of a main element."""
        above = self.apart[node]
        if above < 0 or self.names[node] not in HEADINGS or self.names[above] != "header":
            return False
        while above >= 0 and self.names[above] not in ("article", "main"):
            above = self.parent[above]
        return above >= 0 and (self.names[above] == "article" or self.names[node] == "h1") and self.apart[above] < 0


def _smooth(x: list[float]) -> list[float]:
    out = []
    for i in range(len(x)):
        near = [(k, x[i + d]) for d, k in zip(range(-2, 3), _KERNEL, strict=True) if 0 <= i + d < len(x)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def _clusters(page: _Page) -> list[int]:
    """Lines whose smoothed ratio of text to tags is above the threshold. A line that is set apart is in no cluster, unless
    even its lowered ratio is above that of all others."""
    ratio = []
    for text, tags, links, node in page.lines:
        own = len(text) / max(tags, 1) * (1 - (1 - WEIGHT) * min(1.0, links / len(text)))
        ratio.append(own * (WEIGHT if page.apart[node] >= 0 or RIGHTS.match(text) else 1))
    smooth = _smooth(ratio)
    free = [i for i, x in enumerate(page.lines) if page.apart[x[3]] < 0]
    if not free or max(ratio) > max(ratio[i] for i in free):
        free = list(range(len(page.lines)))
    limit = min(sum(smooth) / len(smooth) * THRESHOLD, max(ratio[i] for i in free))
    runs: list[list[int]] = []
    for i in free:
        if smooth[i] >= limit:
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
    out = []
    for run in runs:  # at its ends a run has lines that only smoothing lifted
        own = [i for i in run if page.names[page.lines[i][3]] in HEADINGS or ratio[i] >= OWN * limit and not RIGHTS.match(page.lines[i][0])]
        out += run[run.index(own[0]) : run.index(own[-1]) + 1] if own else []
    return out


def _region(page: _Page, content: list[int]) -> tuple[int, bool]:
    """The node of the region and whether it is an article or main element."""
    weight: dict[int, int] = {}  # of nodes: characters of clustered text inside, by sums from the last node to the first
    for i in content:
        weight[page.lines[i][3]] = weight.get(page.lines[i][3], 0) + len(page.lines[i][0])
    total = sum(weight.values())
    sums = [0] * len(page.names)
    for node in range(len(page.names) - 1, -1, -1):
        sums[node] += weight.get(node, 0)
        if node:
            sums[page.parent[node]] += sums[node]
    articles = [n for n, w in enumerate(sums) if w >= HOLD * total and page.names[n] in ("article", "main")]
    if articles:
        return min(articles), True
    return max(n for n, w in enumerate(sums) if w == total and page.names[n] not in SMALL), False


def main_text(html: str | None) -> str:
    """The article's blocks, joined by a blank line; empty if there are none."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.finish()
    lines, names = page.lines, page.names
    if not lines:
        return ""
    heading = lambda i: names[lines[i][3]] in HEADINGS
    content = _clusters(page)
    body = [i for i in content if not heading(i)]
    content = [i for i in content if i >= body[0]] if body else content  # headings before it are added below
    region, article = _region(page, content)
    # what is set apart within the region is dropped; what encloses it, or is it, is not
    free = [page.apart[x[3]] <= region or article and page.titled(x[3]) for x in lines]
    kept = [i for i, x in enumerate(lines) if region <= x[3] < page.end[region] and free[i]]
    around = page.apart[region]
    if not kept or not article and around >= 0 and (names[around] in APART or not any(map(heading, kept))):
        return ""  # a menu or notice alone is no article; with a heading, a name was part of the layout
    if not article:
        kept = _chosen(page, content, kept)
        before = kept[0] - 1
        while before >= 0 and heading(before) and page.apart[lines[before][3]] <= region:
            kept.insert(0, before)  # the headings right before the region are its own
            before -= 1
    return "\n\n".join(lines[i][0] for i in kept)


def _home(page: _Page, node: int) -> int:
    """The container that a line's block stands in, seen from outside lists, tables and quotes."""
    while node > 0 and (page.names[node] in SMALL or page.names[node] in PARTS):
        node = page.parent[node]
    return node


def _chosen(page: _Page, content: list[int], lines: list[int]) -> list[int]:
    """Of the region's lines those that clusters choose: in a cluster, or in a container that lines of clusters stand in and
    no links, and the headings right before such lines."""
    inside = set(content)
    homes = {_home(page, page.lines[i][3]) for i in content}
    out: list[int] = []
    follows = False  # whether the line after this one is kept
    for i in reversed(lines):
        text, _, links, node = page.lines[i]
        beside = _home(page, node) in homes and links < LINKED * len(text)
        follows = i in inside or beside or follows and page.names[node] in HEADINGS
        if follows:
            out.append(i)
    return out[::-1]


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points). Null or empty html, or a page without article text, has an
    empty text. Repeated rows each get a row; only page_id, url and html are read. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 1000):
                part = b.slice(at, 1000)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
