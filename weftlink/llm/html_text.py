"""Main text of web pages as the maximum-scoring contiguous run of tokens.

A page is a sequence of tokens, words and tags. A word's weight says how much likelier words of its surroundings (the
block element it stands in, a link or not) are main text than not; a tag's weight is negative. Both are learned from
labelled pages. Elements that are boilerplate by their element name, or by a whole class name, id or role, are cut out
of the sequence, their tags stay in it. A linear scan finds the contiguous run with the largest sum; its blocks are the
text. A compound name that ends in a word of boilerplate makes an element doubtful only: its words weigh less, and the
scan decides.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.shared import slices

# Element names of the HTML standard. Void elements other than br and hr stand inside a block like a letter.
INLINE = frozenset(
    "a abbr acronym area b base bdi bdo big cite code col data del dfn em embed font i img input ins kbd label link map mark meta nobr param picture q rb rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg math select option button canvas object audio video".split())
DROPPED = frozenset("head nav footer aside form menu dialog fieldset".split()) | RAW
# Elements whose end tag may be left out: another of the kind closes them.
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
# Dropped by name, but for an article or main element inside: whole pages stand in a form at times.
LOOSE = frozenset("form dialog fieldset".split())
# Class names, ids and roles that name boilerplate.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)

# No part gives back what it took, and an unfinished tag ends where the next one begins, so a page is read once.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+(?:>|(?=<)|\Z)|[^<>]*+(?:>|(?=<)|\Z))""", re.S
)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in ("script", "style", "textarea", "title")}


@dataclass
class Block:
    """A run of text between block tags: its text, its surroundings, the tags that precede it."""

    text: str
    inside: str
    dropped: bool
    in_article: bool
    tags: list[str] = field(default_factory=list)
    doubtful: bool = False
    words: int = 0
    linked: int = 0

    def key(self) -> str:
        """What the weight of the block's words is learned by."""
        return self.inside + "?" * self.doubtful


def _names(attrs: str) -> tuple[str, bool, bool]:
    """The first class of an element, whether one of its class names, its id or its role names boilerplate, and whether the
    last word of a compound one does (site-footer; not related-work, with-sidebar or no-comments)."""
    first, bad, doubtful = "", False, False
    for m in _ATTR.finditer(attrs):
        names = (m[2] or m[3] or m[4] or "").lower().split()
        if m[1].lower() == "class" and not first:
            first = names[0] if names else ""
        for name in names:
            bad |= name in BOILERPLATE
            parts = re.split("[_-]+", name)
            doubtful |= len(parts) > 1 and parts[-1] in BOILERPLATE and parts[-2] not in ("with", "no", "has", "without", "not", "hide")
    return first, bad, doubtful


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The page's blocks in order, and the tags after the last one. Unclosed and stray tags are tolerated; the time is linear
    in the page's length, however deep elements nest."""
    out: list[Block] = []
    # element, signature, dropped for good, dropped unless an article follows inside, doubtful, inside an article
    stack: list[tuple[str, str, bool, bool, bool, bool]] = [("", "", False, False, False, False)]
    opened: Counter[str] = Counter()  # how many of each element are on the stack
    parts: list[str] = []
    tags: list[str] = []
    links = linked = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal tags, linked
        words = html.unescape("".join(parts)).split() if parts else []
        parts.clear()
        if words:
            _, sign, hard, soft, doubt, art = stack[-1]
            out.append(Block(" ".join(words), sign, hard or soft, art, tags, doubt and not (hard or soft), len(words), min(linked, len(words))))
            tags = []
        linked = 0

    def text(part: str) -> None:
        nonlocal linked
        parts.append(part)
        if links:
            linked += len(part.split())

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in INLINE:
            tags.append(name)
            if name == "a":
                links = 0 if closing else 1  # a link inside a link closes it
            continue
        if name == "br":
            parts.append(" ")
            tags.append(name)
            continue
        flush()
        tags.append(name)
        links = 0
        if closing:
            if opened[name]:
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == name:
                        break
            continue
        if stack[-1][0] == "p" or name in CLOSED_BY_NEXT and stack[-1][0] == name:
            opened[stack.pop()[0]] -= 1
        if name == "hr":
            continue
        first, bad, mixed = _names(m[3])
        _, _, hard, soft, doubt, art = stack[-1]
        marks = name in ("article", "main")
        if marks and not art and not bad:  # an outermost one counts more than the names of what it stands in
            soft = doubt = False
        art_here = art or marks or 'itemprop="articlebody"' in m[3].lower()
        hard = hard or name in DROPPED - LOOSE
        soft = soft or bad and name not in ("body", "html", "article", "main") or name in LOOSE or name == "header" and not art
        # a page's heading is no boilerplate, whatever a compound name around it says
        doubt = (doubt or mixed and name not in ("body", "html", "article", "main")) and not art_here and name != "h1"
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        stack.append((name, f"{name}.{first}" if first else name, hard, soft, doubt, art_here))
        opened[name] += 1
    flush()
    return out, tags


@dataclass
class TokenWeights:
    """Weights of words by their surroundings, and of tags; what was never seen gets the defaults."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    word: float = 0.5
    linked: float = -0.4
    doubtful: float = 0.1
    tag: float = -0.3

    @classmethod
    def learn(cls, pages: list[str]) -> TokenWeights:
        """From pages that mark their own main text (an article or main element): words there, outside boilerplate,
        are labelled 1, all others 0; tags likewise. Pages without the mark are left out, and so is what is cut out anyway."""
        count: dict[tuple[str, str], list[float]] = {}
        for page in pages:
            found, _ = blocks(page or "")
            if not any(b.in_article and not b.dropped for b in found):
                continue
            for b in found:
                good = b.in_article and not b.dropped
                for t in b.tags:
                    count.setdefault(("tag", t), [0, 0])[good] += 1
                if not b.dropped:
                    count.setdefault(("word", b.key()), [0, 0])[good] += b.words - b.linked
                    count.setdefault(("link", ""), [0, 0])[good] += b.linked
        w = cls()
        for (kind, key), (bad, good) in count.items():
            odds = log((good + 1) / (bad + 1))
            if kind == "word":
                w.words[key] = max(-4.0, min(2.0, odds))
            elif kind == "link":
                w.linked = max(-2.0, min(0.2, odds))
            else:
                w.tags[key] = max(-3.0, min(-0.05, -0.3 + 0.3 * odds))
        return w

    def of(self, b: Block) -> tuple[float, float]:
        """(sum over the tags before the block, sum over its words; none of what is cut out)."""
        tags = sum(self.tags.get(t, self.tag) for t in b.tags)
        if b.dropped:
            return tags, 0.0
        one = self.words.get(b.key(), self.doubtful if b.doubtful else self.word)
        return tags, one * (b.words - b.linked) + min(one, self.linked) * b.linked


def best_run(steps: list[tuple[float, float]]) -> tuple[int, int]:
    """The contiguous run of blocks, from the first to before the last number, with the largest sum of word weights and of
    the tag weights between its blocks; of equal sums the one that ends first, and of those the shortest. (0, 0) where none
    is positive."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for k, (tags, words) in enumerate(steps):
        if total + tags <= 0:
            total, start = 0.0, k
        else:
            total += tags
        total += words
        if total > best:
            best, at = total, (start, k + 1)
    return at


def main_blocks(page: str, w: TokenWeights) -> list[str]:
    """Texts of the best contiguous run's blocks, without those cut out. Nothing inside a block is dropped, so runs begin
    and end at blocks; where no run is positive there is no text."""
    found, _ = blocks(page)
    a, b = best_run([w.of(x) for x in found])
    return [x.text for x in found[a:b] if not x.dropped]


def learn_weights(pages: DataFrame, html_col: str = "html", sample_pages: int = 400, most_bytes: int = 40_000_000) -> TokenWeights:
    """Weights from at most ``sample_pages`` pages, chosen by a hash of the page, of ``most_bytes`` bytes in all: the first by
    that hash, and no page of more than a hundredth of it (they are extracted whole, as all pages). Null and empty pages,
    repeated ones and an empty table teach nothing; without any lesson the default weights stand."""
    c = F.col(html_col)
    keyed = pages.filter(F.octet_length(c).between(1, most_bytes // 100)).select(F.xxhash64(c).alias("wl_key"), c.alias("wl_html"))
    # the keys alone are ranked; only the chosen pages travel
    last = keyed.select("wl_key").distinct().orderBy("wl_key").limit(sample_pages).agg(F.max("wl_key")).first()[0]
    if last is None:
        return TokenWeights.learn([])
    lessons, left = [], most_bytes
    for row in keyed.filter(F.col("wl_key") <= last).dropDuplicates(["wl_key"]).orderBy("wl_key").limit(sample_pages).toLocalIterator():
        left -= len(row[1].encode("utf-8", "surrogatepass"))
        if left < 0:
            break
        lessons.append(row[1])
    return TokenWeights.learn(lessons)


def main_text(pages: DataFrame, weights: TokenWeights | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(``id_col``, text, n_chars, n_blocks), one row per input row.

    Null and empty pages, and pages without a positive run, have the empty text. Character references are decoded, white
    space inside a block becomes one space, blocks are joined by two line feeds. Repeated rows and null ids pass
    through; an empty table gives an empty table. A page's time and memory are linear in its length.
    """
    w = weights or learn_weights(pages, html_col)

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                got = [main_blocks(p or "", w) for p in b.column(1).to_pylist()]
                texts = ["\n\n".join(x) for x in got]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in got], pa.int64())], names=["wl_id", "text", "n_chars", "n_blocks"]
                )

    d = pages.select(F.col(id_col).alias("wl_id"), F.col(html_col).alias("wl_html"))
    return d.mapInArrow(run, f"wl_id {d.dtypes[0][1]}, text string, n_chars long, n_blocks long").withColumnRenamed("wl_id", id_col)
