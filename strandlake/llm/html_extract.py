"""Main text of web pages by tree scoring.

A tolerant tokenizer builds the page's element tree. Elements that by tag, role or the words of their class or
id are menus, headers, footers, sidebars, notices, adverts, forms or reader comments are dropped with all they
hold. Each remaining block of text passes points to the elements above it: one, one for each comma and up to
three for its length; all of it to its container, half to the next and a third to the one above that. A
container's points are discounted by its link density, and by class words that speak against it (related, share,
legal and the like), which drop nothing by themselves. The best container is kept with all that stands beside it in
its article or main element, or in the page where it is in neither, but for branches of which links are more than half
(a third under such class words, a quarter of another article there; without an article or main element such words
drop what does not score well). Text blocks are given in page order.

Class words are evidence of a name that someone chose. Inside an article or main element a name drops an element only
if all its words are of that kind or of layout (ad, ad-slot, comment-list, but not dinner-menu or notice-period, whose
words then only count against it). An element dropped by class words alone is taken back if nothing else of the page is
left, if it holds four fifths of its text and is no comment section, or if it holds the only article or main element
and more text than the rest. A label, button or map within a sentence is text of it.

Time is linear in the page: every element's place, open namesakes and nearest block are kept while it is read.

Defined cases: a null or empty html gives an empty text; a page without any scoring block gives all text that
is not dropped; broken or unclosed markup is read as far as it goes; ``header`` inside an article is kept; a tag
with an unclosed quote ends at its first ``>``; elements may be nested to any depth.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .runtime import ship

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
#: One attribute after another: name and value, so that a value is never looked into for names.
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_NAMES = frozenset("class id role aria-hidden hidden style".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_DROP = frozenset("head script style template svg iframe object canvas audio video map nav footer aside form button select textarea input label option dialog menu title".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"html", "body"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table html body td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
#: Class words of what is dropped; those of the second list only without a word for the text itself beside them.
_KINDS = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors outbrain taboola "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination sidebar footer cookie cookies consent gdpr notice notices newsletter popup modal".split()
)
_LIKELY = frozenset("header masthead topbar banner foot aside rail pager alert overlay subscribe subscription signup login paywall form".split())
#: Words that say where or in what form an element is shown, and nothing of what it says.
_LAYOUT = frozenset(
    "site page main top bottom left right head header foot box container wrapper wrap list lists item items block section inner outer bar area zone widget widgets banner slot slots "
    "unit link links row col column group panel holder mobile desktop sticky fixed floating user users reader readers count form thread policy message overlay dialog js primary secondary global small large".split()
)
#: Elements that are part of a sentence where they stand in one.
_INLINE = frozenset("label button map".split())
#: Class words that count against an element's score.
_AGAINST = frozenset("teaser teasers card cards promo promoted promotion widget widgets discussion reply share sharing social related recommended recommendations toolbar search copyright legal disclaimer print skip tags toc side".split())
_GOOD = frozenset("article main content body entry post story text prose".split())
#: A class that begins so says what the element has or lacks, not what it is.
_ABOUT = frozenset("no has with without not is in".split())
_ITEMS = frozenset("li dt dd tr td th".split())
_INNER = frozenset("p pre blockquote li dd dt td h1 h2 h3 h4 h5 h6 figcaption".split())
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("against", "block", "chars", "depth", "drop", "linked", "name", "points", "root", "up")

    def __init__(self, name: str, up: _Node | None, drop: int, against: bool, block: bool):
        self.name, self.up, self.drop, self.against = name, up, drop, against
        self.depth = up.depth + 1 if up else 0
        self.block = self if block or up is None else up.block  # the nearest block element
        self.root = up.root if up else None  # the element dropped by class that this one is in
        self.points, self.chars, self.linked = 0.0, 0, 0


def _verdict(name: str, attrs: str, inside: bool, within: bool = False) -> tuple[int, bool, bool]:
    """Whether an element goes (2; 1 by its class alone), whether class words count against it, and whether it holds comments.

    ``inside`` an article or main element; ``within`` a paragraph, heading or item.
    """
    if name in _DROP and not (within and name in _INLINE) or name in ("header", "noscript") and not inside:
        return 2, False, False
    if not attrs or name in ("html", "body"):
        return 0, False, False
    words: set[str] = set()
    plain: set[str] = set()  # words of names that have no others than of kind and layout
    seen: set[str] = set()
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), a or b or c
        if k not in _NAMES or k in seen:  # of a repeated attribute the first counts
            continue
        seen.add(k)
        if k == "role" and v.lower() in _ROLES or k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and _STYLE.search(v):
            return 2, False, False
        if k in ("class", "id"):
            for token in v.split():
                own = [w.lower() for w in _WORD.findall(token)]
                if own and own[0] not in _ABOUT:
                    words.update(own)
                    if all(w in _KINDS or w in _LIKELY or w in _LAYOUT or len(w) == 1 for w in own):
                        plain.update(own)
    if not words:
        return 0, False, False
    talk = bool(words & _COMMENTS)
    if name in ("article", "main"):
        return int(talk), bool(words & _AGAINST) and not words & _GOOD, talk
    sure = plain if inside else words
    bad = bool(sure & _KINDS) or bool(sure & _LIKELY) and not words & _GOOD and not (inside and "header" in words)
    return int(bad), bool(words & (_AGAINST | _KINDS)) and not words & _GOOD, talk and bad


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """The place of the ``>`` that ends the tag whose attributes begin at ``at``: the first outside quotes, else the first of all; -1 without any.

    Places from which no such end was found are kept in ``dead``, so that a page is not scanned again and again.
    """
    seen, i = [], at
    while i not in dead:
        seen.append(i)
        m = _STOP.search(page, i)
        if not m:
            break
        if m[0] == ">":
            return m.start()
        j = page.find(m[0], m.end())
        if j < 0:
            break
        i = j + 1
    dead.update(seen)
    return page.find(">", at)


def _read(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements that may stay, parents first, and the text blocks in page order: container, text with white space folded, and characters of it in links."""
    root = _Node("html", None, 0, False, True)
    stack, nodes, out, held = [root], [root], [], []
    where: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
    talks: set[int] = set()
    rescue: dict[int, _Node] = {}
    links = inside = linked = 0
    outside_main = False
    dead: set[int] = set()

    def flush():
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((stack[-1].block, text, min(linked, len(text))))
        held, linked = [], 0

    def pop_to(depth: int):
        nonlocal links, inside
        while len(stack) > depth:
            n = stack.pop()
            where[n.name].pop()
            links -= n.name == "a"
            inside -= n.name in ("article", "main")

    at = 0
    while at < len(page):
        m = _OPEN.search(page, at)
        end = m.start() if m else len(page)
        close = -1
        if m and not m[1]:
            close = _tag_end(page, m.end(), dead) if m[4] and not m[3] else page.find(">", m.end())
            if close < 0:  # no tag ends any more: a comment may, the rest is text
                m = None if (end := page.find("<!--", end)) < 0 else _OPEN.match(page, end)
                end = len(page) if m is None else end
        if end > at and stack[-1].drop < 2:
            text = html.unescape(page[at:end])
            held.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        if m[1]:
            stop = page.find("-->", m.end())
            at = stop + 3 if stop >= 0 else len(page)
            continue
        at = close + 1
        if m[2]:
            continue
        name = m[4].lower()
        if m[3]:
            places = where.get(name)
            if places:
                depth = places[-1]
                if name in _BLOCK or stack[depth].drop == 2 or stack[-1].block is not stack[depth - 1].block:
                    flush()
                pop_to(depth)
            elif name == "br":
                held.append(" ")
            continue
        if name in _CLOSES_P:
            flush()
            if stack[-1].block.name == "p":
                pop_to(stack[-1].block.depth)
            if name in _SAME:
                scope = max((where[x][-1] for x in _SCOPE.difference(_SAME[name]) if where.get(x)), default=0)
                lowest = [places[k] for x in _SAME[name] if (places := where.get(x)) and (k := bisect_right(places, scope)) < len(places)]
                if lowest:
                    pop_to(min(lowest))
        elif name == "br":
            held.append(" ")
        attrs = page[m.end() : close]
        if name in _VOID:
            continue
        up = stack[-1]
        drop, against, talk = (2, False, False) if up.drop == 2 else _verdict(name, attrs, inside > 0, up.block.name in _INNER)
        if max(drop, up.drop) > up.drop and name in _BLOCK:
            flush()
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if attrs.endswith("/") and name in ("path", "circle", "rect", "use"):
            continue
        node = _Node(name, up, max(drop, up.drop), against, name in _BLOCK)
        if drop == 1 and up.drop == 0:
            node.root = node
            if talk:
                talks.add(id(node))
        where.setdefault(name, []).append(len(stack))
        stack.append(node)
        if node.drop < 2:
            nodes.append(node)
            if name in ("article", "main"):
                outside_main |= node.drop == 0
                if node.root is not None:
                    rescue[id(node.root)] = node.root
        links += name == "a"
        inside += name in ("article", "main")
    flush()
    out = [(n, t, k) for n, t, k in out if n.drop < 2]
    rest = sum(len(t) for n, t, _ in out if n.drop == 0)
    held_by: dict[int, int] = {}
    for n, t, _ in out:
        if n.root is not None:
            held_by[id(n.root)] = held_by.get(id(n.root), 0) + len(t)
    whole = rest + sum(held_by.values())
    back = {k for k, size in held_by.items() if not rest or k not in talks and (5 * size >= 4 * whole or not outside_main and k in rescue and size > rest)}
    if back and back <= talks and len(back) < len(held_by):
        back = set(held_by) - talks
    stays = [n.drop == 0 or n.root is not None and id(n.root) in back for n in nodes]
    return [n for n, ok in zip(nodes, stays, strict=True) if ok], [x for x in out if x[0].drop == 0 or id(x[0].root) in back]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes, blocks = _read(page)
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        if linked * 2 > len(text):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3.0)
        n = node.up if node.name in _INNER and node.up else node
        for share in (1.0, 2.0, 3.0):
            if n is None:
                break
            n.points += points / share
            n = n.up
    for n in reversed(nodes):  # children come after their parents
        if n.up is not None:
            n.up.chars += n.chars
            n.up.linked += n.linked

    def score(n: _Node) -> float:
        return n.points * (1 - n.linked / max(n.chars, 1)) * (1.5 if n.name in ("article", "main") else 0.25 if n.against else 1.0)

    scored = [n for n in nodes if n.points > 0]
    if not scored:
        return " ".join(t for _, t, _ in blocks)
    best = max(scored, key=lambda n: (score(n), -n.depth))
    while best.up is not None and best.name in ("ul", "ol", "table", "tbody", "tr", "dl", "p", "li"):
        best = best.up
    least = max(10.0, 0.2 * score(best))
    chain, whole, n = set(), None, best
    while n is not None:
        chain.add(id(n))
        whole = n if n.name in ("article", "main") else whole
        n = n.up
    bare = whole is None
    if bare:
        whole = nodes[0]
    # from the top down: in the best container, or in what is kept beside it
    part: dict[int, bool] = {}
    held: dict[int, bool] = {}
    for n in nodes:
        k, up = id(n), id(n.up)
        if k in chain:
            part[k] = n is whole or part.get(up, False)
        else:
            share = 4 if n.name == "article" else 3 if n.against else 2
            goes = n.name not in _ITEMS and n.linked * share > n.chars or (bare or n.name == "article") and n.against and score(n) < least
            part[k] = part.get(up, False) and not goes
        held[k] = n is best or held.get(up, False)
    return " ".join(t for n, t, _ in blocks if held[id(n)] or part[id(n)])


def extract(df: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars`` for every row of ``df``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    return df.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, StructType([*df.select(*keep).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
