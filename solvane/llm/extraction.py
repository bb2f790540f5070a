"""Main text of web pages: blocks are labelled content or boilerplate by a minimum cut.

A linear classifier of a block's place, markup and wording gives the cost of either label; these are the capacities of
its edges to source and sink. Blocks that follow each other, and blocks that share a container, are tied by smoothness
edges. The minimum cut is the labelling of least total cost. Blocks whose own costs outweigh all their ties have their
label in every minimum cut; they are settled first and their ties become costs of their neighbours. Max-flow
decides the rest.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict, deque
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style head title template noscript svg canvas iframe object textarea select button audio video map".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = frozenset("ul ol dl table tbody thead menu div section article main aside nav body".split())
# Words in classes, ids and roles that name what is around an article.
AROUND = frozenset(
    "nav navigation navbar menu footer sidebar aside complementary contentinfo ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored cookie cookies consent notice gdpr popup modal overlay dialog alert newsletter subscribe subscription signup share sharing social related recommended comment comments commentlist reply replies respond disqus breadcrumb breadcrumbs pagination pager widget login search toolbar skip copyright legal".split()
)
# Of these, words that also name parts of an article: on a paragraph or the like inside one they count less.
MILD = frozenset("notice alert related legal copyright login search social share comment comments reply subscription".split())
TEXTS = HEADINGS | frozenset("p li dt dd blockquote pre td th figure figcaption".split())
OTHERWISE = frozenset("has with no without".split())  # what follows is about another element
STATES = frozenset("open closed enabled disabled".split())
ABOVE = frozenset("header banner masthead topbar".split())  # around an article, but not inside one
WITHIN = frozenset("content article post entry story main maincontent articlebody".split())
# Weights of the classifier: log-odds of content, set by hand, as the pages carry no labels to fit them on. Links weigh less
# inside an article, where lists of them belong to the text; a page without any article part is one by itself.
BIAS, IN_CONTENT, NAMED_CONTENT, AROUND_IT, MILDLY, LONG, LINKED, HEADING, SENTENCE, ITEM, MARKED = -0.8, 4.0, 2.0, -12.0, -2.0, 0.6, -5.0, 0.5, 0.8, -0.5, -1.0
LINKED_WITHIN, BARE = -2.0, 1.2
# Weights of the ties.
NEXT, PARENT, GRANDPARENT = 0.4, 0.8, 0.3
# A name or form does not count on what holds more than this share of the page's text, and the article or main part with it.
MOST, MOST_ALONE = 0.5, 0.8


def words_of(names: str) -> set[str]:
    """Words of class names and the like, without those that tell of other elements or of a state."""
    out = set()
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if words and words[-1] in STATES:
            continue
        out.update(words[: next((i for i, w in enumerate(words) if w in OTHERWISE), len(words))])
    return out


class Mark:
    """An element that its tag or name calls around an article."""

    def __init__(self, above: Mark | None, weight: float, fixed: bool, main: bool):
        self.above, self.weight, self.fixed, self.main, self.size = above, weight, fixed, main, 0


class Blocks(HTMLParser):
    """Blocks (text, log-odds, parent, grandparent) of a page in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.marks: list[Mark] = []
        self.stack: list[tuple] = [("", 0, 0, None, 0, 0)]  # tag, number, unread, innermost mark, content, named
        self.parts: list[str] = []
        self.linked, self.links, self.count = 0, 0, 0
        self.open: Counter = Counter()  # how often each tag is open
        self.bare = True  # whether no block stands in what is called an article

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns are not needed

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            open_ = list(islice((s for s in reversed(self.stack) if s[0] not in INLINE), 2))
            tag, mark, content, named = open_[0][0], *open_[0][3:]
            tags = {s[0] for s in open_}
            odds = BIAS + LONG * math.log1p(len(text) / 20) + (LINKED_WITHIN if content else LINKED) * min(1, self.linked / len(text))
            self.bare &= not (content or named)
            odds += (IN_CONTENT if content else NAMED_CONTENT if named else 0)
            odds += HEADING * bool(tags & HEADINGS) + ITEM * (tag == "li") + SENTENCE * (text[-1] in ".!?…。！？\"”»") + MARKED * ("©" in text)
            self.blocks.append((text, odds, open_[0][1], open_[1][1] if len(open_) > 1 else 0, mark))
            if mark:
                mark.size += len(text)
        self.parts, self.linked = [], 0

    def close_through(self, i: int) -> None:
        for tag, *_ in self.stack[i:]:
            self.links -= tag == "a"
            self.open[tag] -= 1
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE and tag not in VOID:
            self.push(tag, attrs)
            return
        if tag in VOID:
            self.parts.append(" " if tag == "br" else "")
            if tag == "hr":
                self.flush()
            return
        if tag not in UNREAD or tag == "button":
            self.flush()
            top = len(self.stack) - 1
            while top > 0 and self.stack[top][0] in INLINE:
                top -= 1
            if self.stack[top][0] == "p":
                self.close_through(top)
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in SAME.get(tag, ()):
                    self.close_through(i)
                    break
                if self.stack[i][0] in HOLDERS:
                    break
            if tag != "html" and self.stack[-1][0] in ("head", "title"):
                self.close_through(next(i for i, s in enumerate(self.stack) if s[0] in ("head", "title")))
        self.push(tag, attrs)

    def push(self, tag: str, attrs: list) -> None:
        _, _, unread, mark, content, named = self.stack[-1]
        self.count += 1
        self.links += tag == "a"
        if tag not in ("html", "body"):
            found = dict(attrs)
            main = tag in ("article", "main") or found.get("role") == "main"
            id_ = words_of(found.get("id") or "")
            if tag in HEADINGS or (content and not id_ <= AROUND):  # an anchor
                id_ = set()
            words = words_of(f"{found.get('class') or ''} {found.get('role') or ''}") | id_ if attrs else set()
            called = words & AROUND
            fixed = (tag in ASIDE and tag != "form") or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in (found.get("style") or "").replace(" ", "")
            if fixed or tag == "form" or called or (not content and (tag == "header" or bool(words & ABOVE))):
                mild = not fixed and content and tag in TEXTS and called <= MILD
                mark = Mark(mark, MILDLY if mild else AROUND_IT, fixed, main)
                self.marks.append(mark)
            elif main and mark:
                mark.main = True
            named = named or bool(words & WITHIN)
            content = content or main
        self.open[tag] += 1
        self.stack.append((tag, self.count, unread or tag in UNREAD, mark, content, named))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and tag not in UNREAD:
            self.flush()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.close_through(i)
                break
            if tag in INLINE and self.stack[i][0] not in INLINE:
                break

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def end(self) -> list[tuple]:
        self.close()
        self.flush()
        total = sum(len(b[0]) for b in self.blocks)
        for m in reversed(self.marks):  # inner ones first
            if m.above:
                m.above.size += m.size
                m.above.main |= m.main and not m.fixed
        for m in self.marks:
            if not m.fixed and m.size > (MOST if m.main else MOST_ALONE) * total:
                m.weight = 0.0
            if m.above:
                m.weight = min(m.weight, m.above.weight)
        bare = BARE if self.bare else 0.0
        return [(text, odds + bare + (mark.weight if mark else 0), *holders) for text, odds, *holders, mark in self.blocks]


def ties(blocks: list[tuple]) -> dict[tuple[int, int], float]:
    """Smoothness edges between successive blocks, and from each block to the one before it in the same container."""
    out: dict[tuple[int, int], float] = defaultdict(float)
    last: dict[tuple[int, int], int] = {}
    for i, (_, _, parent, grandparent) in enumerate(blocks):
        if i:
            out[i - 1, i] += NEXT
        for level, (holder, weight) in enumerate(((parent, PARENT), (grandparent, GRANDPARENT))):
            if (before := last.get((level, holder))) is not None:
                out[before, i] += weight
            last[level, holder] = i
    return out


def cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling (true: content) of least cost: log-loss of the odds plus the weight of each tie it cuts."""
    n = len(odds)
    surplus = list(odds)  # log P(content) - log P(boilerplate): the difference of the two capacities is all that counts
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        around[a][b] = around[a].get(b, 0) + w
        around[b][a] = around[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is not None or abs(surplus[i]) < sum(around[i].values()):
            continue
        label[i] = surplus[i] > 0
        for j, w in around[i].items():
            del around[j][i]
            surplus[j] += w if label[i] else -w
            waiting.append(j)
        around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, max_flow(rest, surplus, around), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def max_flow(nodes: list[int], surplus: list[float], around: list[dict[int, float]]) -> list[bool]:
    """The source's side of a minimum cut, by shortest augmenting paths in layers."""
    source, sink = len(nodes), len(nodes) + 1
    place = {i: k for k, i in enumerate(nodes)}
    room: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for i, k in place.items():
        a, b = (source, k) if surplus[i] > 0 else (k, sink)
        room[a][b], room[b][a] = abs(surplus[i]), 0.0
        room[k].update((place[j], w) for j, w in around[i].items())
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(len(nodes))]
        ahead = [iter(list(r)) for r in room]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                back = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if room[a][b] <= 1e-12)
                ahead[path[back]] = iter([v for v in room[path[back]] if level.get(v) == level[path[back]] + 1 and room[path[back]][v] > 1e-12])
                del path[back + 1 :]
                continue
            step = next((v for v in ahead[u] if room[u].get(v, 0) > 1e-12 and level.get(v) == level[u] + 1), None)
            if step is None:
                level.pop(u, None)
                path.pop()
            else:
                path.append(step)


def main_text(html: str) -> str:
    parser = Blocks()
    parser.feed(html)
    blocks = parser.end()
    chosen = cut([b[1] for b in blocks], ties(blocks))
    return "\n\n".join(b[0] for b, content in zip(blocks, chosen, strict=True) if content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``.

    Blocks of the main text stand in page order, two line feeds between them, with character references decoded and
    runs of white space as one space. A null or empty page has the empty text, and so has one without content.
    Null ids and urls and repeated rows stay as they are; other columns are not read.
    """
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kinds = {c: read.schema[c].dataType.simpleString() for c in ("id", "url")}

    def batches(parts):
        for part in parts:
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = read.mapInArrow(batches, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
