"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is read as blocks of words with tags between them.  Words score positive
and tags negative, so the main text is the run of blocks of the highest sum,
found in one scan.  The scores are log-odds, learned from pages that mark their
article themselves (``<article>``, or else ``<main>``): how much more often a word or
a tag stands inside the marked text than outside.  A word of such a page has a
score of its own, by whether it stands inside the mark or beside it.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, known by their tags, roles and class names, are outside for
learning, and never part of a result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import append_arrow, spare, texts_of

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title".split())
REMOVED = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe map menu nav noembed noframes noscript object script search "
    "select style svg template textarea title".split()
)
CONTAINERS = frozenset("article body center details div dl figure header html main ol section table tbody td tfoot th thead tr ul".split()) | REMOVED
CLOSED_BY_NEXT = frozenset("dd dt li option p td th tr".split())
# Roles and words of class names and ids of what isn't main text.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
NOISE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor")
NOISE_ENDS = ("banner", "comments", "cookies", "footer", "menu", "nav", "popup", "sidebar")
NOT_NOISE = frozenset("commentary commentaries".split())
NOT_NOISE_AFTER = frozenset("has no with without".split())
NOISE_PAIRS = frozenset([("side", "bar"), ("side", "panel"), ("sign", "up"), ("log", "in"), ("call", "out"), ("pop", "up")])

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s\"'>]++))", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSERS = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I) for name in RAW}

WORD, INSIDE, BESIDE = "word", "word inside", "word beside"
#: A word scores at least this, a tag at most minus this.
LEAST = 1e-3
#: A tag costs this at most, so that pages without a mark may build their text of parts that others don't.
MOST_TAG = 6.0
#: The scores where no page is labelled.
PLAIN_WORD, PLAIN_TAG = 1.0, 3.25


@dataclass
class Block:
    text: str
    words: int
    tags: list[str]
    inner: list[str]
    removed: bool
    article: bool
    main: bool


@dataclass
class Weights:
    """Scores by kind of token; ``other`` is the score of a tag that wasn't seen."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -PLAIN_TAG

    def tag(self, name: str) -> float:
        return max(-MOST_TAG, min(-LEAST, self.scores.get("<" + name, self.other)))

    def word(self, kind: str) -> float:
        got = self.scores.get(kind, PLAIN_WORD)
        return got if kind == BESIDE else max(LEAST, got)


@lru_cache(maxsize=4096)
def is_noise(names: str) -> tuple[bool, bool]:
    """Whether a class or id has a word of what isn't main text, and whether it has one of a header."""
    noise = header = False
    for name in names.split():
        words = [w.lower() for w in NAME_WORD.findall(name)]
        for i, w in enumerate(words):
            before = words[i - 1] if i else ""
            if before in NOT_NOISE_AFTER:
                continue
            header |= w == "header"
            noise |= w in NOISE or (before, w) in NOISE_PAIRS or w not in NOT_NOISE and (w.startswith(NOISE_STARTS) or w.endswith(NOISE_ENDS))
    return noise, header


def _named(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Of a tag's attributes: not main text, a header, marks an article, marks the main part."""
    noise = header = article = main = False
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                noise |= value.strip().lower() in ROLES
                main |= value.strip().lower() == "main"
                article |= value.strip().lower() == "article"
            elif key == "itemprop":
                article |= value.strip().lower() == "articlebody"
            else:
                a, b = is_noise(value)
                noise, header = noise | a, header | b
    return noise, header, article, main


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have words, removed ones too; tags are those since the block before, and those within."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, removed, in an article, in the main part
    opened: Counter[str] = Counter()
    removed = article = main = False
    pieces: list[str] = []
    tags: list[str] = []
    inner: list[str] = []

    def flush() -> None:
        nonlocal tags, inner
        words = "".join(pieces).split()
        pieces.clear()
        if words:
            out.append(Block(" ".join(words), len(words), tags, inner, removed, article, main))
            tags = []
        else:
            tags += inner
        inner = []

    def close(name: str) -> None:
        nonlocal removed, article, main
        while True:
            top = stack.pop()[0]
            opened[top] -= 1
            if top == name:
                break
        _, removed, article, main = stack[-1] if stack else ("", False, False, False)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            pieces.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        is_block = name in BLOCKS
        if is_block:
            flush()
        if is_block or name not in RAW:
            (tags if is_block else inner).append(name)
        if m[1]:
            if opened[name]:
                if not is_block:
                    flush()
                close(name)
            continue
        if name == "br":
            pieces.append(" ")
        if stack and (name == stack[-1][0] and name in CLOSED_BY_NEXT or is_block and stack[-1][0] == "p"):
            close(stack[-1][0])
        noise, header, marks, is_main = _named(m[3])
        # What holds the whole text isn't removed for its class.
        whole = name in ("html", "body", "article", "main")
        # A header inside an article is the article's own.
        gone = name in REMOVED or noise and not whole or (name == "header" or header and not whole) and not (article or marks or main)
        if name == "article" and not noise:
            marks, gone = True, False
        if name == "article" and removed and not noise and not any(s[2] for s in stack):
            # An article can't stand in a menu: an element before it wasn't closed.
            removed = False
            while stack and stack[-1][1]:
                opened[stack.pop()[0]] -= 1
            _, removed, article, main = stack[-1] if stack else ("", False, False, False)
        if name in RAW:
            c = CLOSERS[name].search(page, at)
            at = c.start() if c else end
        if name in VOID or m[3].endswith("/") and name not in CONTAINERS:
            continue
        if name in CONTAINERS or gone or marks or removed and name == stack[-1][0]:
            if not is_block and gone and not removed:
                flush()
            stack.append((name, removed or gone, article or (marks and not (name == "article" and noise)), main or name == "main" or is_main))
            opened[name] += 1
            _, removed, article, main = stack[-1]
    flush()
    return out


def _marked(blocks: list[Block]) -> list[bool] | None:
    """Whether each block is inside the page's mark; None if the page has none."""
    kept = [b for b in blocks if not b.removed]
    if any(b.article for b in kept):
        return [b.article and not b.removed for b in blocks]
    if any(b.main for b in kept):
        return [b.main and not b.removed for b in blocks]
    return None


def counted(page: str) -> Counter[tuple[str, bool]] | None:
    """Of a labelled page, its tokens by kind and whether they are inside; None for other pages."""
    blocks = blocks_of(page)
    marks = _marked(blocks)
    if marks is None:
        return None
    out: Counter[tuple[str, bool]] = Counter()
    before = False
    for b, inside in zip(blocks, marks, strict=True):
        out[WORD, inside] += b.words
        if not b.removed:
            out[INSIDE if inside else BESIDE, inside] += b.words
        for t in b.tags:  # between two blocks of the text, or at its edge
            out["<" + t, inside and before] += 1
        for t in b.inner:
            out["<" + t, inside] += 1
        before = inside
    return out


def weights_from(counts: dict[tuple[str, bool], int]) -> Weights:
    """Log-odds of each kind of token, with half a count added; the plain scores if there are none."""
    if not counts:
        return Weights()
    kinds = {k for k, _ in counts} | {WORD, INSIDE, BESIDE}
    tokens = {side: sum(n for (k, s), n in counts.items() if s == side and k not in (INSIDE, BESIDE)) + len(kinds) / 2 for side in (True, False)}

    def odds(kind: str) -> float:
        inside, outside = ((counts.get((kind, s), 0) + 0.5) / tokens[s] for s in (True, False))
        return math.log(inside / outside)

    return Weights({k: odds(k) for k in sorted(kinds)}, min(-LEAST, math.log(tokens[False] / tokens[True])))


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the highest-scoring run, one on a line; of equal runs the first."""
    blocks = blocks_of(page)
    marks = _marked(blocks)
    best = total = 0.0
    start = first = last = 0
    kept: list[Block] = []
    before = False
    for i, b in enumerate(blocks):
        if b.removed:
            continue
        inside = marks is not None and marks[i]
        kind = WORD if marks is None else INSIDE if inside else BESIDE
        # Tags inside a mark are no sign of its end.
        own = b.words * weights.word(kind) + sum(-LEAST if inside else weights.tag(t) for t in b.inner)
        gap = sum(-LEAST if inside and before else weights.tag(t) for t in b.tags)
        before = inside
        if kept and total + gap > 0:
            total += gap + own
        else:
            start, total = len(kept), own
        kept.append(b)
        if total > best:
            best, first, last = total, start, len(kept)
    return "\n".join(b.text for b in kept[first:last])


def learned(pages: DataFrame, column: str = "html") -> Weights:
    """Weights from all labelled pages of the table; tasks count, Spark adds up, the driver gets two rows for each kind.

    Tags whose names HTML doesn't define count as unseen, so the kinds are bounded.
    Without labelled pages, also in an empty table, the plain scores hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for page in texts_of(batch.column(0)):
                total.update(counted(page) or {})
        keys = [k for k in total if k[0][0] != "<" or k[0][1:] in KNOWN]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "inside", "n"],
        )

    rows = pages.select(column).mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_from({(r["kind"], r["inside"]): r["n"] for r in rows})


# The inline elements of HTML. Tags of other names score as tags that weren't seen.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output picture progress q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var video".split()
)
KNOWN = BLOCKS | VOID | RAW | REMOVED | CONTAINERS | INLINE


def extracted(pages: DataFrame, weights: Weights, column: str = "html") -> DataFrame:
    """Append ``text`` (empty if there is none) and ``n_chars``, its code points; whole pages, no shuffle.

    A null page is empty.  A page cut off anywhere is read as if its open elements
    ended there.  Rows repeat as they stand.  Where a column of the name is there
    already, underscores are added to the new one's.
    """
    text, size = spare(pages, "text"), spare(pages, "n_chars")

    def make():
        def fn(column: pa.Array):
            out = [main_text(p, weights) for p in texts_of(column)]
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return fn

    return append_arrow(pages, [column], [(text, T.StringType()), (size, T.LongType())], make)
