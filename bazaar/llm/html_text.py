"""Main text of web pages by minimum-cut labelling.

1. A page is cut into *blocks*: runs of text between tags that break a line.  Scripts, styles and other
   things that are never shown are no blocks.
2. A linear *classifier* gives each block the cost of calling it content and the cost of calling it
   boilerplate, from its share of link text, its length and punctuation, and the elements, classes and ids around
   it.  These costs are the capacities of the edges to the two terminals.
3. *Smoothness*: neighbouring blocks are joined by an edge, the stronger the nearer their lowest common
   element is in the tree; blocks under the same parent are joined to the next one there as well.
4. The minimum cut between the terminals (augmenting paths by breadth-first search) is the cheapest labelling; blocks on the
   content side are the text, in page order.

Blocks under an element that is boilerplate by its meaning (menus, footers, forms, ...) are bound to that side
by an edge that no cut can afford.  Classes and ids are read part by part (``comment-body``: comment, body), and the last part that is no
general word (body, content, list, ...) decides.  A name of comments, sidebars, notices or adverts is a cost above all that a block can
have for it, whatever its length; of other names that sound like boilerplate the cost weighs less the more words a block has.  Such
contexts end at an article or main element inside, but for comments, which are often articles themselves.  no-, has-, with- or sticky-
before a name tell of a page's layout.

Null and empty pages have an empty text.  Broken mark-up (missing ends, cut-off tags and references) is read as browsers do.
Repeated rows are treated alike.  A page of any length is read whole; the number of edges is linear in that of blocks.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from bazaar.llm.common import in_batches

#: Elements of HTML.
_UNSHOWN = frozenset("script style template noscript iframe object svg math canvas title textarea select option head datalist "
                     "audio video".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("table ul ol dl article section div aside nav footer header form main body td th blockquote".split())
#: Elements and roles that are boilerplate by their meaning, and names that say so.
_NEVER = frozenset("nav footer aside form button menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
#: Parts of classes and ids.  Names that begin with one of the stems count as well.
_GENERAL = frozenset("content body text inner outer wrap wrapper container list item items box block area section panel holder row col "
                     "column main left right top bottom primary secondary title count form meta link links bar card group page".split())
_OF_CONTENT = frozenset("article post entry story".split())
_OF_COMMENTS = frozenset("comment comments commentlist commenter commenters reply replies respond disqus discussion".split())
_LASTING = frozenset("sidebar sidebars cookie cookies cookiebar consent gdpr notice notices newsletter signup login ad ads adv adsense adbox "
                     "adslot banner outbrain taboola popup modal overlay breadcrumb breadcrumbs pagination pager copyright disclaimer".split())
_LASTING_STEMS = ("advert", "sponsor", "promo", "subscri", "notification")
_PASSING = frozenset("footer foot header masthead topbar side aside related alert share sharing social skip legal tags".split())
_PASSING_STEMS = ("nav", "menu", "widget", "recommend", "search")
_LAYOUT = re.compile(r"(?:^|[-_])(?:no|has|with|without|sticky)[-_]|(?:content|main)[-_]sidebar", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: What a name says of its element's text.
PASSING, LASTING, COMMENTS = 1, 2, 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

BOUND = 1e6
#: Cost of a name that sounds like boilerplate, and the number of words at which it weighs half.
SUSPECT = 16.0
SUSPECT_WORDS = 60
#: Cost of a lasting name; all else can make a block worth 15 at most.
LASTING_COST = 24.0


class Block:
    """A run of text: its text, the part of it in links, the numbers of the elements around it; ``suspect`` is the share of it
    in elements that are named as boilerplate, ``lasting`` whether by a lasting name."""

    __slots__ = ("text", "linked", "path", "tags", "banned", "named", "suspect", "lasting")

    def __init__(self, text, linked, path, tags, banned, named, suspect, lasting):
        self.text, self.linked, self.path, self.tags, self.banned, self.named = text, linked, path, tags, banned, named
        self.suspect, self.lasting = suspect, lasting


def blocks(html: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, int, bool, bool, int]] = []  # name, number, banned, named as content, kind of name
    pieces: list[str] = []
    linked, odd, worst, number, at, context = 0, 0, 0, 0, 0, None

    def flush():
        nonlocal pieces, linked, odd, worst, context
        text = " ".join("".join(pieces).split())
        if text and context is not None:
            *around, kind = context
            found.append(Block(text, linked, *around, 1.0 if kind else min(odd / len(text), 1.0), (kind or worst) >= LASTING))
        pieces, linked, odd, worst, context = [], 0, 0, 0, None

    def add(raw: str):
        nonlocal linked, odd, worst, context
        if not raw or any(s[0] in _UNSHOWN or s[2] and s[0] in _INLINE for s in stack):
            return
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if text.strip():
            if any(s[0] == "a" for s in stack):
                linked += len(text.strip())
            if kind := max((s[4] for s in stack if s[0] in _INLINE), default=0):
                odd, worst = odd + len(text.strip()), max(worst, kind)
            if context is None:
                outer = [s for s in stack if s[0] not in _INLINE]
                context = (tuple(s[1] for s in outer), tuple(s[0] for s in outer),
                           any(s[2] for s in outer), any(s[3] for s in outer), _suspect(outer))

    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if name not in _INLINE:
            if name == "br":
                pieces.append(" ")
            else:
                flush()
        if m[1]:
            _close(stack, name)
            continue
        if name in _CLOSES_P:
            _close_p(stack)
        elif name in _CLOSED_BY and (i := _last(stack, _CLOSED_BY[name], _SCOPE - {"td", "th"})) is not None:
            del stack[i:]
        if name in _VOID or m[3].rstrip().endswith("/") and name not in _INLINE and name not in _CLOSES_P and name not in _SCOPE:
            continue
        number += 1
        stack.append((name, number, *_meaning(name, m[3], stack)))
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else len(html)
    flush()
    return found


def _suspect(stack) -> int:
    """The kind of the innermost name of boilerplate; outside the innermost article or main only comments count."""
    least = PASSING
    for s in reversed(stack):
        if s[4] >= least:
            return s[4]
        if s[0] in ("article", "main"):
            least = COMMENTS
    return 0


@lru_cache(maxsize=4096)
def _named(names: str) -> tuple[bool, int]:
    """Whether classes and ids name content, and the kind of boilerplate they name (0: none)."""
    content, kind = False, 0
    for name in names.split():
        if _LAYOUT.search(name):
            continue
        parts = [x.lower() for x in _PARTS.findall(name)]
        telling = [x for x in parts if x not in _GENERAL]
        if not telling:
            content |= not {"content", "main", "body", "text"}.isdisjoint(parts)
        elif telling[-1] in _OF_CONTENT:
            content = True
        elif telling[-1] in _OF_COMMENTS:
            kind = COMMENTS
        elif telling[-1] in _LASTING or telling[-1].startswith(_LASTING_STEMS):
            kind = max(kind, LASTING)
        elif telling[-1] in _PASSING or telling[-1].startswith(_PASSING_STEMS):
            if _OF_CONTENT.isdisjoint(telling):  # an entry's header is part of it
                kind = max(kind, PASSING)
            else:
                content = True
    return content and kind < LASTING, 0 if content and kind == PASSING else kind


def _last(stack, names, scope) -> int | None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            return i
        if stack[i][0] in scope:
            return None
    return None


def _close(stack, name) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if name in _INLINE and stack[i][0] in _SCOPE:
            return


def _close_p(stack) -> None:
    if (i := _last(stack, {"p"}, _SCOPE)) is not None:
        inline = [s for s in stack[i + 1:] if s[0] in _INLINE]
        stack[i:] = inline  # formatting goes on in the next block


def _meaning(name: str, attributes: str, stack) -> tuple[bool, bool, int]:
    """(boilerplate by meaning, named as content, kind of boilerplate that its names tell of)."""
    banned = name in _NEVER or name == "header" and not any(s[0] in ("article", "main") for s in stack)
    if "=" in attributes or "hidden" in attributes:
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        style = given.get("style", "").replace(" ", "").lower()
        role = given.get("role", "").lower()
        banned |= (role in _ROLES or bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attributes))
                   or "display:none" in style or given.get("aria-hidden", "").lower() == "true")
        content, kind = _named(f"{given.get('class', '')} {given.get('id', '')}")
        if role == "comment" or given.get("itemprop", "").lower() == "comment" or given.get("itemtype", "").lower().endswith(("/comment", "/usercomments")):
            kind = COMMENTS
        if name in ("html", "body", "main") or name == "article" and kind != COMMENTS:
            kind = 0
        return banned, content, kind
    return banned, False, 0


def costs(block: Block) -> tuple[float, float]:
    """(cost of the label boilerplate, cost of the label content)."""
    words = block.text.split()
    share = min(block.linked / max(len(block.text), 1), 1.0)
    ends = sum(w[-1] in ".!?:;," for w in words)
    score = 0.2 + 0.06 * min(len(words), 60) + 0.25 * min(ends, 6) - 4.0 * share
    for tag in ("article", "main"):
        score += 3.0 * (tag in block.tags)
    score += 2.0 * block.named
    score -= (LASTING_COST if block.lasting else SUSPECT / (1 + len(words) / SUSPECT_WORDS)) * block.suspect
    score += 1.0 * (block.tags[-1:] in (("p",), ("h1",), ("h2",), ("h3",), ("blockquote",), ("pre",)))
    score -= 0.8 * (block.tags[-1:] in (("li",), ("td",), ("th",)) and len(words) < 4)
    if re.match(r"(?:©|\(c\)|copyright\b|all rights reserved)", block.text, re.I):
        score -= 3.0
    if block.banned:
        return 0.0, BOUND
    return max(score, 0.0), max(-score, 0.0)


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks: neighbours, and the next block under the same parent."""
    edges, last_of = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, 1.0 / (1 + _distance(found[i - 1].path, b.path))))
        parent = b.path[-2:-1]
        if parent in last_of and last_of[parent] != i - 1:
            edges.append((last_of[parent], i, 0.5))
        last_of[parent] = i
    return edges


def _distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps in the tree from one block's element to the other's."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def minimum_cut(terminal: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, for capacities (from the source, to the sink) and undirected edges."""
    n = len(terminal)
    source, sink = n, n + 1
    to, capacity, out = [], [], [[] for _ in range(n + 2)]

    def edge(a, b, forth, back):
        out[a].append(len(to))
        to.append(b)
        capacity.append(forth)
        out[b].append(len(to))
        to.append(a)
        capacity.append(back)

    for i, (s, t) in enumerate(terminal):
        both = min(s, t)
        if s > both:
            edge(source, i, s - both, 0.0)
        if t > both:
            edge(i, sink, t - both, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if capacity[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path, a = [], source
        while True:  # blocking flow, without recursion
            if a == sink:
                flow = min(capacity[e] for e in path)
                for e in path:
                    capacity[e] -= flow
                    capacity[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if capacity[e] <= 1e-9)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while following[a] < len(out[a]):
                e = out[a][following[a]]
                if capacity[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            if following[a] < len(out[a]):
                path.append(out[a][following[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    content = minimum_cut([costs(b) for b in found], smoothness(found))
    return " ".join(b.text for b, yes in zip(found, content) if yes)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""
    def each(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return in_batches(pages.select("page_id", "url", "html"), each,
                      f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
