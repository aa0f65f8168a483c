"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a list of text blocks with their place in the element tree. A
linear classifier over the block's text (length, sentence ends, share of linked
text), its tag and the kinds of elements around it gives each block a cost for
either label, which become the capacities of its two terminal arcs. Names of
classes and ids count in full only if the whole name says boilerplate; a name
that merely contains such a word is a weak sign. Blocks that follow each other
and blocks that share a parent are joined by smoothness arcs, the stronger the
closer they are in the tree, and weaker where one of the two is marked as
boilerplate and the other is not. The minimum cut between the terminals is the
cheapest labelling; it is found by maximum flow, after blocks whose own cost
outweighs all their smoothness arcs have been labelled (no cut could do
otherwise). So short or oddly named blocks of an article follow the blocks
around them, as do stray sentences of a menu.
Pages are independent, so each task works through its own rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Content never shown as text: skipped up to the end tag.
SILENT = frozenset("script style template textarea select title svg iframe object audio video canvas math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end the text block before them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset("nav footer aside form menu button dialog fieldset label legend head".split())
HOME = frozenset("article main".split())
#: Words of class and id names that speak for boilerplate.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer header "
    "masthead side sidebar widget cookie cookies consent notice popup modal overlay share sharing social related recommend recommended "
    "recommendations comment comments reply replies disqus newsletter subscribe signup login search pagination pager tags meta byline "
    "copyright toolbar skip".split())
#: Words beside them that say nothing on their own.
PLAIN_WORDS = frozenset(
    "site page main top bottom left right post posts article articles entry content section container wrapper wrap box block area group row "
    "col column inner outer list item items link links text form button buttons icon icons slot unit bar thread js the".split())
HOME_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|body|text)(?:$|[\s_-])", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u00bb\u201d\u2019)\]]*(?=\s|$)")
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</?([a-zA-Z][^\s>/]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|</?([a-zA-Z][^\s>/]*)([^>]*)>|<[!?/][^>]*>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)", re.I)

#: Weights of the classifier; positive speaks for content. One unit is 100.
BIAS, IN_HOME, IN_HOME_NAME, IN_AWAY, AWAY_HINT, IN_HIDDEN = -100, 250, 200, -1000, -90, -5000
PARAGRAPH, HEADING, LIST_ITEM, LINKS, PER_CHAR, MOST_CHARS, PER_SENTENCE, MOST_SENTENCES = 100, 100, -80, -500, 1, 250, 25, 4
#: Smoothness of neighbours and of blocks that share a parent; divided by CONTRAST where only one is marked as boilerplate.
ADJACENT, SIBLING, CONTRAST = 240, 200, 4


def name_signs(names: str) -> tuple[bool, bool]:
    """Whether one of the class or id names says boilerplate as a whole, and whether one holds such a word.

    ``cookie-notice``, ``post-comments`` and ``siteFooter`` say so as a whole:
    their words are boilerplate words or plain ones. ``share-price`` and
    ``social-history`` only hold one.
    """
    whole = part = False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        away = sum(w in AWAY_WORDS for w in words)
        if away:
            part = True
            whole = whole or away + sum(w in PLAIN_WORDS for w in words) == len(words)
    return whole, part


class Block:
    """A text block: its element and that element's parent by number, steps in the tree from the block before."""

    __slots__ = ("text", "links", "tag", "parent", "steps", "away", "hint", "home", "named", "hidden")

    def __init__(self, text, links, tag, parent, steps, away=False, hint=False, home=False, named=False, hidden=False):
        self.text, self.links, self.tag, self.parent, self.steps = text, links, tag, parent, steps
        self.away, self.hint, self.home, self.named, self.hidden = away, hint, home, named, hidden


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; broken markup is taken as far as it goes.

    Time is linear in the page: nesting costs nothing but the open elements
    kept, and end tags without a start tag are passed over.
    """
    out: list[Block] = []
    # open elements: name, number, then the marks of Block they hand down
    stack = [("", 0, False, False, False, False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    number = links = in_link = 0
    last = low = 1  # depth of the block before and the least depth since then

    def flush() -> None:
        nonlocal links, last, low
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                depth = len(stack)
                name, _, *marks = stack[-1]
                out.append(Block(text, links, name, stack[-2][1] if depth > 1 else -1, last + depth - 2 * min(low, depth), *marks))
                last = low = depth
            parts.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal low
        for e in stack[k:]:
            opened[e[0]] -= 1
        del stack[k:]
        low = min(low, k)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                links += stop - at
        if not m:
            break
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing = m[0][1] == "/"
        if name in SILENT:
            if not closing and not m[0].endswith("/>"):
                over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = over.end() if over else end
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                if opened[name]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                continue
            if name in VOID:
                continue
            if stack[-1][0] == "p" or (name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack[-1][0] == name):
                close(len(stack) - 1)  # these end without an end tag
            _, _, away, hint, home, named, hidden = stack[-1]
            attributes = m[2] if m[1] else m[4]
            names = " ".join(x for y in _NAMES.findall(attributes) for x in y if x) if attributes else ""
            hidden = hidden or bool(attributes and _HIDDEN.search(attributes))
            home = home or name in HOME
            away = away or name in AWAY or (name == "header" and not home)
            if names and name not in ("html", "body"):
                whole, part = name_signs(names)
                away, hint = away or whole, hint or part
                named = named or bool(HOME_NAMES.search(names))
            number += 1
            stack.append((name, number, away, hint and not away, home, named, hidden))
            opened[name] += 1
    flush()
    return out


def content_cost(b: Block) -> int:
    """What labelling the block boilerplate costs more than labelling it content."""
    size = len(b.text)
    score = BIAS + min(MOST_CHARS, size * PER_CHAR)
    score += PER_SENTENCE * min(MOST_SENTENCES, len(_SENTENCE_END.findall(b.text)))
    score += IN_HOME * b.home + IN_HOME_NAME * b.named + IN_AWAY * b.away + AWAY_HINT * b.hint + IN_HIDDEN * b.hidden
    if b.tag in ("p", "blockquote", "pre"):
        score += PARAGRAPH
    elif b.tag[:1] == "h" and b.tag[1:].isdigit():
        score += HEADING
    elif b.tag in ("li", "td", "dd", "option"):
        score += LIST_ITEM
    return score + LINKS * min(size, b.links) // max(1, size)


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], int]:
    arcs: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            arcs[k - 1, k] = ADJACENT // (1 + b.steps)
        if b.parent in last:
            pair = (last[b.parent], k)
            arcs[pair] = arcs.get(pair, 0) + SIBLING
        last[b.parent] = k
    for pair in arcs:
        x, y = blocks[pair[0]], blocks[pair[1]]
        if (x.away or x.hidden) != (y.away or y.hidden):
            arcs[pair] //= CONTRAST
    return arcs


def minimum_cut(costs: list[int], arcs: dict[tuple[int, int], int]) -> list[bool]:
    """True for the content side of a cheapest cut; ties go to boilerplate."""
    n = len(costs)
    label: list[bool | None] = [None] * n
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in arcs.items():
        if w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    cost, pull = list(costs), [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(cost[k]) > pull[k]:
            label[k] = cost[k] > 0
            for j, w in near[k].items():
                if label[j] is None:
                    cost[j] += w if label[k] else -w
                    pull[j] -= w
                    queue.append(j)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        reached = _source_side(rest, cost, near, label)
        for k in rest:
            label[k] = k in reached
    return [bool(x) for x in label]


def _source_side(rest: list[int], cost: list[int], near: list[dict[int, int]], label: list[bool | None]) -> set[int]:
    """Blocks on the content terminal's side after maximum flow (augmenting along levels)."""
    left: dict[object, dict[object, int]] = {k: {j: w for j, w in near[k].items() if label[j] is None} for k in rest}
    left["+"], left["-"] = {}, {}
    for k in rest:
        left["+"][k], left[k]["+"] = max(0, cost[k]), 0
        left[k]["-"], left["-"][k] = max(0, -cost[k]), 0
    while True:
        level, queue = {"+": 0}, deque(["+"])
        while queue:
            a = queue.popleft()
            for b, w in left[a].items():
                if w > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if "-" not in level:
            return {k for k in level if k != "+"}
        todo = {a: iter(list(left[a])) for a in level}
        path = ["+"]
        while path:
            a = path[-1]
            if a == "-":
                push = min(left[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    left[x][y] -= push
                    left[y][x] += push
                full = next(i for i, (x, y) in enumerate(zip(path, path[1:])) if left[x][y] == 0)
                del path[full + 1 :]
                continue
            for b in todo[a]:
                if left[a][b] > 0 and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    keep = minimum_cut([content_cost(b) for b in blocks], smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    NULL html is empty, an empty page or one without content has an empty text;
    NULL ids and URLs and repeated rows are kept row by row; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
