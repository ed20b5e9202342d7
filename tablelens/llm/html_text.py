"""Main text of web pages: flat text blocks with word counts and link densities, judged by a small decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.batches import pieces, strings

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text nobody reads as text.
UNREAD = frozenset("script style noscript template title head select textarea button svg iframe object datalist canvas audio video".split())
#: Start tags that leave an open head open; any other, or text, ends a head whose end tag was left out.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
#: Elements whose content is taken as it stands up to their end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements and words of class, id or role that mark what surrounds an article.
FRAME_TAGS = frozenset("nav header footer aside form menu dialog".split())
FRAME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies "
    "disclaimer disqus footer gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice notices pagination "
    "pager popup promo promoted promotion recommended related replies reply respond reader search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar tracking widget widgets".split()
)
#: Frame words that are ordinary words as well: beside other words (related-work) they are a weak sign only.
ORDINARY_WORDS = frozenset(
    "header legal meta notice notices promoted reader recommended related respond search share sharing social tags teaser tracking".split()
)
BODY_TAGS = frozenset("article main".split())
#: Words that turn a frame word into a remark on the layout (has-sidebar), and the frame words that count for an article.
LAYOUT_WORDS, ARTICLE_FRAMES = frozenset("has no with without".split()), frozenset("comment comments replies reply".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?=[A-Za-z/!?])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[A-Za-z/!?][^>]*>", re.S
)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Unread elements that hide what follows only up to the next block where their end tag is missing.
ENDED_BY_BLOCKS = UNREAD - {"head", "script", "style"}

#: Per block: words, percent of words in links, the same of the block before and after, whether a frame tag encloses it,
#: whether frame words do (1 weakly, 2 clearly), whether an article or main element does, whether it is a heading. The last
#: column is the label.
LABELLED = np.array([
    # inside an article: text of any length, headings
    [60, 0, 45, 0, 70, 0, 0, 0, 1, 0, 1], [120, 2, 60, 0, 80, 0, 0, 0, 1, 0, 1], [1, 0, 50, 0, 40, 0, 0, 0, 1, 0, 1],
    [2, 0, 1, 0, 3, 0, 0, 0, 1, 0, 1], [8, 0, 4, 0, 90, 0, 0, 0, 1, 1, 1], [5, 0, 12, 100, 60, 0, 0, 0, 1, 1, 1],
    [30, 10, 20, 0, 9, 0, 0, 0, 1, 0, 1], [9, 0, 12, 0, 11, 0, 0, 0, 1, 0, 1], [4, 0, 80, 0, 10, 60, 0, 0, 1, 0, 1],
    [15, 30, 60, 0, 50, 0, 0, 0, 1, 0, 1], [40, 0, 8, 0, 12, 0, 0, 0, 1, 0, 1], [3, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1],
    [12, 40, 70, 0, 30, 5, 0, 0, 1, 0, 1], [200, 1, 0, 0, 0, 0, 0, 0, 1, 0, 1], [6, 45, 40, 0, 55, 0, 0, 0, 1, 0, 1],
    # the same beside very long and very short texts, and beside the frames above and below the article
    [40, 0, 110, 0, 2, 0, 0, 0, 1, 0, 1], [75, 0, 11, 0, 8, 0, 0, 0, 1, 0, 1], [120, 0, 12, 0, 1, 0, 0, 0, 1, 0, 1],
    [10, 0, 48, 0, 3, 0, 0, 0, 1, 0, 1], [2, 0, 120, 0, 9, 0, 0, 0, 1, 0, 1], [7, 0, 2, 0, 4, 0, 0, 0, 1, 0, 1],
    [50, 0, 1, 100, 12, 0, 0, 0, 1, 0, 1], [14, 0, 5, 100, 11, 0, 0, 0, 1, 0, 1], [9, 0, 70, 0, 2, 100, 0, 0, 1, 0, 1],
    [3, 0, 9, 100, 2, 0, 0, 0, 1, 1, 1], [1, 0, 1, 0, 1, 0, 0, 0, 1, 0, 1], [16, 0, 16, 0, 16, 0, 0, 0, 1, 0, 1],
    # text above a list of links
    [20, 0, 0, 0, 2, 100, 0, 0, 1, 0, 1], [40, 0, 5, 0, 3, 100, 0, 0, 1, 0, 1], [12, 0, 20, 0, 1, 100, 0, 0, 1, 0, 1],
    [25, 5, 1, 100, 2, 100, 0, 0, 1, 0, 1], [1, 0, 5, 0, 1, 100, 0, 0, 1, 0, 1], [3, 0, 9, 0, 2, 100, 0, 0, 1, 0, 1],
    [2, 0, 40, 0, 1, 100, 0, 0, 1, 0, 1],
    # the last text of a page
    [20, 0, 20, 0, 0, 0, 0, 0, 1, 0, 1], [6, 0, 40, 0, 0, 0, 0, 0, 1, 0, 1], [60, 0, 9, 0, 0, 0, 0, 0, 1, 0, 1],
    [30, 0, 20, 0, 0, 0, 0, 0, 0, 0, 1], [2, 0, 30, 0, 0, 0, 0, 0, 1, 0, 1], [18, 0, 30, 0, 0, 0, 0, 1, 1, 0, 1],
    # link lists inside an article
    [3, 100, 2, 100, 0, 0, 0, 0, 1, 0, 0], [4, 100, 20, 0, 0, 0, 0, 0, 1, 0, 0], [5, 100, 4, 100, 0, 0, 0, 1, 1, 0, 0],
    [2, 100, 12, 0, 0, 0, 0, 0, 0, 0, 0], [3, 100, 4, 100, 40, 0, 0, 0, 1, 0, 0],
    [4, 100, 60, 0, 5, 100, 0, 0, 1, 0, 0], [6, 100, 5, 100, 4, 100, 0, 0, 1, 0, 0], [9, 90, 4, 100, 0, 0, 0, 0, 1, 0, 0],
    # frames, whatever their text looks like, also inside an article
    [1, 100, 0, 0, 1, 100, 1, 0, 0, 0, 0], [2, 100, 1, 100, 1, 100, 1, 0, 0, 0, 0], [3, 0, 1, 100, 20, 0, 1, 0, 0, 0, 0],
    [25, 0, 60, 0, 0, 0, 1, 0, 0, 0, 0], [60, 0, 40, 0, 12, 0, 1, 0, 0, 0, 0], [12, 0, 80, 0, 0, 0, 1, 0, 0, 0, 0],
    [40, 5, 90, 0, 30, 0, 1, 0, 1, 0, 0], [8, 0, 4, 0, 60, 0, 1, 0, 1, 1, 0], [15, 20, 70, 0, 0, 0, 1, 2, 0, 0, 0],
    [9, 0, 3, 100, 70, 0, 0, 2, 0, 0, 0], [30, 0, 70, 0, 40, 0, 0, 2, 0, 0, 0], [80, 0, 60, 0, 60, 0, 0, 2, 0, 0, 0],
    [20, 0, 50, 0, 25, 0, 0, 2, 1, 0, 0], [45, 0, 20, 0, 30, 0, 0, 2, 1, 0, 0], [5, 0, 45, 0, 20, 0, 0, 2, 1, 1, 0],
    [3, 100, 9, 0, 8, 0, 0, 2, 0, 0, 0], [2, 0, 30, 0, 20, 0, 0, 2, 1, 0, 0], [100, 3, 12, 0, 15, 0, 0, 2, 1, 0, 0],
    # pages without an article element: long texts with few links, short ones beside them, headings above them
    [60, 0, 8, 0, 70, 0, 0, 0, 0, 0, 1], [35, 5, 50, 0, 40, 0, 0, 0, 0, 0, 1], [18, 0, 60, 0, 45, 0, 0, 0, 0, 0, 1],
    [150, 2, 30, 0, 4, 50, 0, 0, 0, 0, 1], [25, 15, 40, 0, 3, 100, 0, 0, 0, 0, 1], [90, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1],
    [6, 0, 60, 0, 70, 0, 0, 0, 0, 0, 1], [4, 0, 40, 0, 50, 0, 0, 0, 0, 0, 1], [9, 0, 35, 0, 30, 0, 0, 0, 0, 0, 1],
    [7, 0, 2, 100, 60, 0, 0, 0, 0, 1, 1], [5, 0, 0, 0, 45, 0, 0, 0, 0, 1, 1], [9, 0, 4, 80, 30, 0, 0, 0, 0, 1, 1],
    [16, 0, 9, 0, 12, 0, 0, 0, 0, 0, 1], [22, 0, 3, 0, 5, 0, 0, 0, 0, 0, 1],
    # and what stands around those
    [2, 100, 3, 100, 2, 100, 0, 0, 0, 0, 0], [5, 100, 60, 0, 4, 100, 0, 0, 0, 0, 0], [12, 80, 40, 0, 10, 90, 0, 0, 0, 0, 0],
    [25, 70, 10, 80, 12, 80, 0, 0, 0, 0, 0], [3, 0, 2, 100, 4, 100, 0, 0, 0, 0, 0], [4, 0, 5, 60, 0, 0, 0, 0, 0, 0, 0],
    [6, 0, 3, 0, 4, 0, 0, 0, 0, 0, 0], [5, 0, 60, 0, 0, 0, 0, 0, 0, 0, 0], [3, 0, 0, 0, 2, 100, 0, 0, 0, 0, 0],
    [4, 0, 3, 0, 2, 100, 0, 0, 0, 1, 0], [8, 50, 30, 0, 2, 100, 0, 0, 0, 0, 0], [2, 0, 4, 0, 50, 0, 0, 0, 0, 0, 0],
    # weak frame words: prose stays, link lists and remarks go
    [30, 0, 20, 0, 40, 0, 0, 1, 1, 0, 1], [14, 0, 30, 0, 25, 0, 0, 1, 1, 0, 1], [70, 5, 4, 0, 50, 0, 0, 1, 1, 0, 1],
    [5, 0, 40, 0, 60, 0, 0, 1, 1, 1, 1], [3, 0, 0, 0, 30, 0, 0, 1, 1, 1, 1], [90, 4, 60, 0, 80, 0, 0, 1, 0, 0, 1],
    [45, 2, 9, 0, 50, 0, 0, 1, 0, 0, 1], [3, 100, 9, 0, 4, 100, 0, 1, 1, 0, 0], [8, 60, 20, 0, 6, 100, 0, 1, 1, 0, 0],
    [4, 0, 30, 0, 3, 100, 0, 1, 1, 0, 0], [5, 0, 30, 0, 4, 100, 0, 1, 1, 1, 0], [10, 0, 3, 100, 5, 60, 0, 1, 0, 0, 0],
    [6, 0, 40, 0, 2, 0, 0, 1, 0, 1, 0], [15, 40, 30, 0, 9, 80, 0, 1, 0, 0, 0], [12, 0, 40, 0, 0, 0, 0, 1, 0, 0, 0],
])


@dataclass
class Node:
    """A leaf (``value``) or a question: ``feature`` at most ``upto``."""

    value: float
    feature: int = -1
    upto: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.upto, self.low.predict(x), self.high.predict(x))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A binary tree by Gini impurity; equal gains go to the first feature and the lowest threshold."""
    leaf, best = Node(float(y.mean())), (1e-9, -1, 0.0)
    impurity = y.mean() * (1 - y.mean())
    if depth and impurity:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for upto in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= upto
                share = low.mean()
                after = sum(s * m * (1 - m) for s, m in ((share, y[low].mean()), (1 - share, y[~low].mean())))
                if impurity - after > best[0] + 1e-12:
                    best = (impurity - after, f, float(upto))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Node(leaf.value, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


TREE = grow(LABELLED[:, :-1].astype(float), LABELLED[:, -1].astype(float))


@dataclass(slots=True)
class Tag:
    """A tag, the text before it, and for a start tag whether its element has an end."""

    before: str
    name: str
    source: str
    closing: bool
    ends: bool = True


def tags(page: str) -> tuple[list[Tag], str]:
    """The tags of a page without comments and the content of scripts and the like, and the text behind the last tag."""
    out: list[Tag] = []
    waiting: dict[str, list[Tag]] = {}  # unread elements that wait for their end tags
    endless: set[str] = set()  # names without an end tag in the rest of the page
    last, at, before = max(page.rfind(">"), page.rfind("<!--")), 0, []
    while at <= last and (m := _PIECE.search(page, at)):
        before.append(page[at:m.start()])
        at = m.end()
        found = _TAG.match(m.group())
        if not found:
            continue  # a comment or a declaration
        tag = Tag("".join(before), found.group(2).lower(), m.group(), bool(found.group(1)))
        name, before = tag.name, []
        out.append(tag)
        if name in RAW and not tag.closing:
            end = None if name in endless else _END[name].search(page, at)
            if end:
                at = end.end()
            elif name in ENDED_BY_BLOCKS:
                endless.add(name)
                tag.ends = False
            else:
                at = len(page)
        elif name in ENDED_BY_BLOCKS and not tag.source.endswith("/>"):
            if not tag.closing:
                tag.ends = False
                waiting.setdefault(name, []).append(tag)
            elif waiting.get(name):
                waiting[name].pop().ends = True
    before.append(page[at:])
    return out, "".join(before)


def _frame_words(tag: Tag) -> int:
    """What the words of class, id and role say: 0 nothing, 1 perhaps a frame, 2 a frame."""
    if "=" not in tag.source or tag.name in ("html", "body"):
        return 0
    lists = [[w for w in re.split(r"[^a-z0-9]+", x) if w] for m in _NAMES.findall(tag.source) for v in m for x in v.lower().split()]
    if any(w in LAYOUT_WORDS for x in lists for w in x):
        return 0
    marks = ARTICLE_FRAMES if tag.name in BODY_TAGS else FRAME_WORDS
    return max((1 if not set(x) <= marks and set(x) & marks <= ORDINARY_WORDS else 2 for x in lists if set(x) & marks), default=0)


def blocks(page: str) -> tuple[list[str], list[list[int]]]:
    """Text blocks in page order, and for each: words, words in links, frame tag, frame words, article, heading."""
    texts: list[str] = []
    facts: list[list[int]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, frame words, whether they have an end
    opened: Counter[str] = Counter()
    words: list[str] = []
    linked = unread = heads = frames = bodies = endless = 0
    named = [0, 0, 0]

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(words).split())
        if text:
            sign = 2 if named[2] else int(named[1] > 0)
            texts.append(text)
            facts.append([text.count(" ") + 1, linked, int(frames > 0), sign, int(bodies > 0), int(heads > 0)])
        words.clear()
        linked = 0

    def count(name: str, sign: int, ends: bool, by: int) -> None:
        nonlocal unread, heads, frames, bodies, endless
        opened[name] += by
        unread += by * (name in UNREAD)
        heads += by * (len(name) == 2 and name[0] == "h" and name[1].isdigit())
        frames += by * (name in FRAME_TAGS)
        named[sign] += by
        bodies += by * (name in BODY_TAGS)
        endless += by * (not ends)

    def pop() -> None:
        count(*stack.pop(), -1)

    def text(piece: str) -> None:
        nonlocal linked
        if unread and stack[-1][0] == "head" and piece.strip():
            pop()
        if piece and not unread:
            piece = html.unescape(piece) if "&" in piece else piece
            words.append(piece)
            if opened["a"]:
                linked += len(piece.split())

    found, rest = tags(page)
    for tag in found:
        text(tag.before)
        name, block = tag.name, tag.name in BLOCKS
        if block:
            close()
        if name == "br":
            words.append(" ")
        if tag.closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name == "body" and unread:
            while opened["head"]:
                pop()
        elif unread and stack[-1][0] == "head" and name not in HEAD:
            pop()
        elif unread and stack[-1][0] == "head" and name in ("head", "html"):
            continue
        while (block or name == "body") and endless and not opened["head"]:
            pop()
        if block and stack and (stack[-1][0] == "p" or name == stack[-1][0] and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            pop()
        if name in VOID or tag.source.endswith("/>") or name in RAW and tag.ends:
            continue
        element = (name, _frame_words(tag), tag.ends)
        stack.append(element)
        count(*element, 1)
    text(rest)
    close()
    return texts, facts


def _table(facts: list[list[int]]) -> np.ndarray:
    """The features of one page's blocks, neighbours included."""
    f = np.array(facts, float)
    density = 100 * np.minimum(1, f[:, 1] / f[:, 0])
    own = np.column_stack((f[:, 0], density))
    none = np.zeros((1, 2))
    return np.column_stack((own, np.vstack((none, own[:-1])), np.vstack((own[1:], none)), f[:, 2:]))


def extract(pages: list[str], tree: Node = TREE) -> list[str]:
    """The main text of each page: its content blocks, joined by empty lines."""
    found = [blocks(p) for p in pages]
    some = [_table(facts) for _, facts in found if facts]
    kept = iter(tree.predict(np.vstack(some)) >= 0.5 if some else ())
    return ["\n\n".join([t for t in texts if next(kept)]) for texts, _ in found]


def extract_text(pages: DataFrame, tree: Node = TREE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``, repeated rows too; one scan, nothing is shuffled.

    A null or empty page, and one without a content block, has the empty text. Broken and unclosed markup is
    read as far as it goes; nothing is cut off.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(extract(strings(b, "html"), tree), pa.string())], ["page_id", "url", "text"]
            )

    rows = pages.select("page_id", "url", "html")
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType())]))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
