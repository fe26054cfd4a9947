"""HTML main-text extraction from standard-library parser events.

1. Lines. Events are read in one stream. A line is a block's text with the container it stands in, the tags it holds and
   what markup says of it: the article, boilerplate, or neither.
2. Ratio. Every line has a text-to-tag ratio: its characters over its tags plus one. The logarithms are smoothed with a
   Gaussian over the lines of the page.
3. Clusters. Two clusters of the smoothed values (a one-dimensional 2-means, so the threshold between them is the page's
   own) part content from the rest. Markup moves a line's value against that threshold, in parts of the distance of the
   clusters and by no more than the page's ratios lie apart: article and main elements raise it by ``FOR`` of it, menus, headers, footers, asides, and elements
   whose class or id says advert, notice, comment and the like lower it by ``AGAINST`` of it. So text that is much denser
   than the page's content outweighs what its markup says, and where all lines are alike markup says nothing. A class or
   id and a form count only where they hold no article, main or h1 element and less than half of the page's text.
4. Regions. Containers that content fills are content regions: the innermost one with nearly all content characters,
   article and main elements that are mostly content, and other containers whose own text mostly is and makes up ``FILLED``
   of the page's. Lines elsewhere go. In a region lines stay that fall below the threshold only for being short; those that
   markup calls boilerplate must pass it everywhere.

Work is linear in the page: containers are numbered after their parents, so weights are summed in one pass backwards and
regions passed down in one pass forwards.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown as text.
UNSEEN = frozenset("head script style template noscript button select textarea option iframe object svg math canvas".split())
#: Shown, but by their element not the article.
ASIDE = frozenset("nav footer aside dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body nav footer aside header menu form".split())
#: List or table parts that end their like; any block ends an open paragraph.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar tablist".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|widget|footer|masthead|site-?header|related|recommended|share|sharing|social|comments?|disqus|respond|reply|replies|tags|pagination|pager|toolbar)(?:$|[\s_-])", re.IGNORECASE)
#: By which part of the distance between the page's two clusters markup shifts a line against the threshold.
FOR, AGAINST = 1.0, 1.4
#: The part of the page's content that a container outside the main ones must hold by itself to be a region too.
FILLED = 0.05


class Lines(HTMLParser):
    """Collects (pieces of text, tags, container, in the article, aside) for every block, in page order; pieces and tags with the doubtful element they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, bool, bool]] = []  # tag, unseen, container, doubt, in the article, aside
        self.blocks: list[int] = []  # places of the open blocks
        self.inline: list[Counter] = [Counter()]  # open inline elements above each open block
        self.names_open: Counter = Counter()
        self.lines: list[tuple[list[tuple[str, int]], list[int], int, bool, bool]] = []
        self.parents: list[int] = [-1]  # of containers; 0 is the page
        self.names: list[str] = ["page"]
        self.doubts: list[int] = [-1]  # parents of doubtful elements; 0 is none
        self.article: list[bool] = [True]  # do they hold an article, main or h1 element?
        self.chars: list[int] = [0]
        self.unseen = 0
        self.container = self.doubt = 0
        self.inside = self.aside = False
        self.words: list[tuple[str, int]] = []
        self.tags: list[int] = []

    def end_line(self):
        if any(text and not text.isspace() for text, _ in self.words):
            self.lines.append((self.words, self.tags, self.container, self.inside, self.aside))
        self.words, self.tags = [], []

    def visible(self) -> list[tuple[str, int, int, int]]:
        """(text, tags, container, sign) of the lines, the sign 1 in the article, -1 in what counts as boilerplate, else 0; what lies in a doubtful element that counts as boilerplate is a line of its own."""
        total = self.chars[:]
        for i in range(len(total) - 1, 0, -1):
            total[self.doubts[i]] += total[i]
        gone = [False] * len(total)
        for i in range(1, len(total)):
            gone[i] = gone[self.doubts[i]] or not self.article[i] and 2 * total[i] < total[0]
        out = []
        kinds = (False, True) if any(gone) else (False,)
        for words, tags, container, inside, aside in self.lines:
            for bad in kinds:
                text = " ".join("".join(x for x, doubt in words if gone[doubt] == bad).split())
                if text:
                    out.append((text, sum(gone[doubt] == bad for doubt in tags), container, -1 if bad or aside else int(inside)))
        return out

    def names_aside(self, tag, attrs) -> bool:
        if tag in ASIDE:
            return True
        if tag == "header":
            return not self.inside  # an article's own header holds its title
        if not attrs or tag in ("html", "body", "article", "main", "p", "h1"):
            return False
        given = dict(attrs)
        return (given.get("role") or "") in ROLES

    def doubtful(self, tag, attrs) -> bool:
        if tag == "form":
            return True
        if not attrs or tag in ("html", "body", "article", "main", "p", "h1"):
            return False
        given = dict(attrs)
        return any(MARKED.search(given.get(k) or "") for k in ("class", "id"))

    def close_one(self):
        tag, unseen, container, doubt, inside, aside = self.open.pop()
        self.names_open[tag] -= 1
        if tag in BLOCKS:
            self.end_line()
            self.blocks.pop()
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        self.unseen -= unseen
        self.container, self.doubt, self.inside, self.aside = container, doubt, inside, aside

    def close_to(self, place: int):
        while len(self.open) > place:
            self.close_one()

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block and not self.unseen:
            self.end_line()
        if tag == "br":
            self.words.append((" ", self.doubt))
        if tag in VOID:
            self.tags.append(self.doubt)
            return
        if block:
            like = ENDS.get(tag, frozenset()) | {"p"}
            while self.blocks and self.open[self.blocks[-1]][0] in like:
                self.close_to(self.blocks[-1])
                if tag != "tr":
                    break
        unseen = tag in UNSEEN or bool(attrs) and tag not in ("html", "body") and any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        self.open.append((tag, unseen, self.container, self.doubt, self.inside, self.aside))
        self.names_open[tag] += 1
        if block:
            self.blocks.append(len(self.open) - 1)
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        self.unseen += unseen
        if self.unseen:
            return
        if self.names_aside(tag, attrs):
            self.aside = True
        elif self.doubtful(tag, attrs):
            self.doubts.append(self.doubt)
            self.article.append(False)
            self.chars.append(0)
            self.doubt = len(self.doubts) - 1
        if tag in ("article", "main", "h1"):
            at = self.doubt
            while not self.article[at]:
                self.article[at] = True
                at = self.doubts[at]
            self.inside = self.inside or tag != "h1"
        if tag in CONTAINERS:
            self.parents.append(self.container)
            self.names.append(tag)
            self.container = len(self.parents) - 1
        else:
            self.tags.append(self.doubt)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            if self.names_open[tag]:
                place = len(self.blocks) - 1
                while self.open[self.blocks[place]][0] != tag:
                    place -= 1
                self.close_to(self.blocks[place])
            elif not self.unseen:
                self.end_line()
        elif self.inline[-1][tag]:  # an inline end tag doesn't close blocks
            while self.open[-1][0] != tag:
                self.close_one()
            self.close_one()

    def handle_data(self, data):
        if not self.unseen:
            self.words.append((data, self.doubt))
            self.chars[self.doubt] += len("".join(data.split()))


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    return np.convolve(values, kernel)[reach:-reach] / weight


def clusters(values: np.ndarray) -> tuple[float, float]:
    """The threshold between the two clusters of the values, and how far these lie apart; the smallest value and the values' own range where they are one cluster."""
    low, high = float(values.min()), float(values.max())
    one = low, high - low
    if high - low < math.log(2):
        return one
    for _ in range(50):
        cut = (low + high) / 2
        a, b = values[values < cut], values[values >= cut]
        if not len(a) or not len(b):
            return one
        if (low, high) == (new := (float(a.mean()), float(b.mean()))):
            break
        low, high = new
    return (low + high) / 2, high - low


def lines_of(html: str) -> tuple[list[tuple[str, int, int, int]], list[int], list[str]]:
    """(text, tags, container, sign) of each line, the containers' parents and their names."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.close_to(0)
    parser.end_line()
    return parser.visible(), parser.parents, parser.names


def main_text(html: str | None, *, sigma=1.0) -> str:
    """The kept lines joined by one space; empty for a null, empty or textless page."""
    lines, parents, names = lines_of(html) if html else ([], [], [])
    if not lines:
        return ""
    sizes = np.array([len(text) for text, *_ in lines], float)
    sign = np.array([x for *_, x in lines])
    ratio = smoothed(np.log(sizes / (1 + np.array([tags for _, tags, *_ in lines], float)) + 1), sigma)
    threshold, apart = clusters(ratio)
    shift = np.minimum(apart * np.array([0.0, FOR, AGAINST]), ratio.max() - ratio.min()) * (0, 1, -1)
    content = ratio + shift[sign] >= threshold
    # characters of each container by itself and with what it holds: all that may be content, and content
    own, own_good = np.zeros(len(parents)), np.zeros(len(parents))
    at = np.array([container for _, _, container, _ in lines])
    np.add.at(own, at, sizes * (content | (sign >= 0)))
    np.add.at(own_good, at, sizes * content)
    every, good = own.tolist(), own_good.tolist()
    for i in range(len(parents) - 1, 0, -1):
        every[parents[i]] += every[i]
        good[parents[i]] += good[i]
    # numbered after their parents: the last with nearly all content is the innermost; the page itself where there is none
    whole = max(i for i in range(len(parents)) if good[i] >= 0.9 * good[0]) if good[0] else 0
    articles = [i for i, name in enumerate(names) if name in ("article", "main") and 2 * good[i] >= every[i] > 0]
    region = [False] * len(parents)
    for i in articles:
        region[i] = True
    if not articles or 2 * sum(good[i] for i in articles) < good[0]:
        region[whole] = True
    for i in range(1, len(parents)):
        region[i] = region[i] or region[parents[i]]
    filled = (2 * own_good >= own) & (own_good >= FILLED * good[0]) & (own_good > 0)
    return " ".join(text for (text, _, container, x), kept in zip(lines, content) if (kept or x >= 0) and (region[container] or filled[container]))


def extract(pages: DataFrame, *, page_id="page_id", url="url", html="html", sigma=1.0) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null, empty or textless page has the empty text; null ids and urls pass; repeated pages are rows of their own with
    equal texts; an empty table gives no rows. Pages are read whole in time linear in their length, and columns that clash
    with names used here are ignored."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                found = [main_text(x.as_py(), sigma=sigma) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
