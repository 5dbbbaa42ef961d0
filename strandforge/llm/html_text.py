"""HTML extraction with wrappers inferred per host.

1. A page becomes a stream of text blocks. A block stands at a path: the block elements around it, by
   tag and first class or id (digits in names do not count).
2. Streams of one host are aligned again and again into one union-free wrapper. Blocks of the same path
   and text are matched first, then blocks of the same path: texts that differ make a field, what
   one side lacks becomes optional, and fields in a row, alone or in groups of two and three, become
   a repeated group. Every slot counts its pages and characters and keeps one checksum while its text
   stays the same.
3. The wrapper tells where the article is. Running text of fields (text that differs from page to page,
   less twice what is in links) is summed up over all pages of the host for each element, and from the root the wrapper
   is followed to the elements that hold most of it. Names of tags, classes, ids and roles break
   ties: they take boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments)
   out of the sums, and inside an element that the page itself calls its article, text that is the
   same everywhere stays. Elsewhere text that half of the pages have is the host's template and is left out.
4. A page gives its blocks inside these elements. A page that has none of them is read by a wrapper of its own.

What is merged with what is fixed by hashes of the streams: different streams of a host are grouped by leading
bits of their hashes, some LEAF_PAGES to a group, and groups by fewer bits in each round. So a wrapper
does not depend on partitions, and no task gets all pages of a host. Alignment is exact at every length.

Defined results: null html is empty; a null or odd url has the empty host; null page_id and
repeated rows keep their rows; an empty table gives no rows; other columns are not read; elements may
be nested to any depth.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import bounded_batches, discard, materialize, pieces

# Tags and names of HTML pages.
#: Elements that hold others; the way to the article leads through these only.
_CONTAINERS = frozenset("#root html body div section article main td th table tbody tr center".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea xmp noembed noframes iframe title plaintext".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr option".split()
)
_DROPPED_TAGS = frozenset(
    "head script style noscript template nav aside form button select option input textarea label iframe svg canvas object embed audio video footer dialog menu menuitem fieldset datalist".split()
)
#: Elements whose class or id may name a region; headings, paragraphs and the like are never dropped for a name.
_NAMED = frozenset("div section header ul ol dl table tr td span article center details figure".split())
#: Words of class and id that name a region of boilerplate, and words that may stand beside them.
_BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs crumbs masthead topbar toolbar footer footers foot colophon copyright legal cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations trending popular comment comments commentlist disqus respond reply replies discussion pagination pager toc tags tagcloud search skip hidden header".split()
)
_BESIDE = frozenset(
    "area bar block body bottom box button buttons container content first form group icon icons inner item items last layout left link links list main module outer page panel posts primary region right row secondary section site slot sticky text thread title top unit wrap wrapper".split()
)
_ARTICLE = frozenset("article post entry content story".split())
#: Words of an article that is a comment, an advert or a pointer to another page.
_TEASERS = frozenset("ad ads adv advert adverts advertisement cookie cookies comment comments commentlist disqus respond reply replies discussion related recommended recommendations trending popular hidden sponsored promo promoted teaser card".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
}
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "option"}
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_HOST = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

#: Plans of all hosts are broadcast up to this size; beyond it pages are joined by host.
BROADCAST_BYTES = 16 << 20
#: Streams of a group at the leaves of the merging, about, and how many bits of the hash a round takes off.
LEAF_PAGES = 16
ROUND_BITS = 4
#: The way leads on into an element that holds this share of the running text.
SHARE = 0.6
#: Text on this share of a host's pages (three of them, where it has as many) is its template; below RARE, from SETTLED pages on, it is a field like any other.
TEMPLATE, RARE, SETTLED = 0.5, 0.25, 32
#: Beside the fullest element, sections with less than this share of its text a page are no part of the article.
SLIGHT = 0.1
BOILER, NAMED, MAIN = 1, 2, 4  # flags of elements


@dataclass
class Node:
    tag: str
    key: str = ""
    flags: int = 0
    children: list = field(default_factory=list)  # nodes and strings


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _names_boilerplate(tag: str, names: list[str]) -> bool:
    """Whether a class or id, all of its words taken together, names a region of boilerplate."""
    for name in names:
        words = set(filter(None, re.split(r"[^a-z]+", name)))
        if tag == "article":
            if words & _TEASERS:
                return True
        elif words & _BOILER and words <= _BOILER | _BESIDE:
            return True
    return False


def _open(tag: str, attrs: str) -> Node:
    node = Node(tag, tag, BOILER if tag in _DROPPED_TAGS else MAIN if tag in ("article", "main") else 0)
    if attrs:
        a: dict[str, str] = {}
        for m in _ATTR.finditer(attrs):
            a.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
        if names:
            node.key = f"{tag}.{re.sub('[0-9]+', '#', names[0])}"
        role = a.get("role", "").lower()
        if tag not in ("html", "body", "main"):
            if role in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDES.search(a.get("style", "")):
                node.flags |= BOILER
            elif tag in _NAMED and _names_boilerplate(tag, names):
                node.flags |= NAMED
        if role == "main" or a.get("itemprop", "").lower() == "articlebody":
            node.flags |= MAIN
    if node.flags & (BOILER | NAMED):
        node.flags &= ~MAIN
    return node


def parse(source: str | None) -> Node:
    """The tree of a page; unclosed and stray tags are mended as browsers do in the common cases."""
    source = source or ""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)
    # where open elements stand in the stack, by tag, and where those that are blocks do: no walk over the stack
    places: dict[str, list[int]] = {}
    blocks: list[int] = []

    def put(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        if node.tag in _BLOCK:
            blocks.append(len(stack))
        stack.append(node)

    def cut(size: int) -> None:
        while len(stack) > size:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in _BLOCK:
                blocks.pop()

    def innermost(tags: set[str]) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=0)

    def close(tags: set[str], stop: set[str]) -> None:
        """The innermost open element of the tags, unless one of stop is further in."""
        found = innermost(tags)
        if found and found >= innermost(stop):
            cut(found)

    while at < n:
        m = _TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].children.append(source[at:end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", "br"))
            elif tag not in ("html", "body") and places.get(tag):
                found = places[tag][-1]
                if tag in _BLOCK or not blocks or blocks[-1] < found:  # a stray inline end tag closes no block
                    cut(found)
            continue
        if at == n and not source.endswith(">"):
            break  # cut off inside a tag
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag == "body":
            close({"head"}, {"body"})
        elif tag in _ENDS_P:
            close({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "body", "main", "aside", "form", "button", "figure"})
            if tag[0] == "h" and len(tag) == 2 and stack[-1].tag[0] == "h" and len(stack[-1].tag) == 2 and stack[-1].tag[1].isdigit():
                cut(len(stack) - 1)
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        node = _open(tag, m[3])
        stack[-1].children.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, at)
            close_at = stop.start() if stop else n
            node.children.append(source[at:close_at])
            after = source.find(">", close_at) + 1 if stop else n
            at = after or n
            continue
        if m[3].rstrip().endswith("/") and tag in ("path", "circle", "rect", "use", "line", "g", "image"):
            continue
        put(node)
    return root


@dataclass
class Block:
    path: int
    text: str
    linked: int  # characters in links


def _path(parent: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key, parent) >> 12


def blocks_of(root: Node) -> tuple[list[Block], dict[int, list]]:
    """The text blocks of a page in order, and its block elements: path -> [parent, tag, flags]."""
    elements: dict[int, list] = {0: [-1, "#root", 0]}
    out: list[Block] = []
    buffer: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append(Block(at, text, min(linked, len(text))))
            linked = 0

    # (node, path, in a link), or the path to come back to
    stack: list = [(root, 0, False)]
    while stack:
        top = stack.pop()
        if isinstance(top, int):
            flush()
            at = top
            continue
        node, path, link = top
        if isinstance(node, str):
            buffer.append(node)
            if link:
                linked += len(node.strip())
            continue
        if node.tag == "br":
            buffer.append(" ")
            continue
        if node.tag in _RAW:
            if node.tag in _BLOCK:
                flush()
            continue
        block = node.tag in _BLOCK or node.flags and node.tag not in ("#root", "span", "label")
        if block:
            flush()
            here = _path(path, f"{node.key} {node.flags}" if node.flags else node.key)
            elements.setdefault(here, [path, node.tag, node.flags])
            stack.append(at)
            at = path = here
        elif node.flags & BOILER:
            continue
        link = link or node.tag == "a"
        stack += [(c, path, link) for c in reversed(node.children)]
    flush()
    return out, elements


# --- wrappers: items [path, checksum or 0, pages, characters, in links] | ["?", item] | ["+", items]


def shape(source: str | None) -> dict:
    """The wrapper of one page: its stream of blocks, unfolded."""
    blocks, elements = blocks_of(parse(source))
    items = [[b.path, zlib.crc32(b.text.encode("utf-8", "surrogatepass")) or 1, 1, len(b.text), b.linked] for b in blocks]
    return {"n": 1, "items": items, "elements": {p: [*e, 1] for p, e in elements.items()}}


def _bare(item: list) -> list:
    return item[1] if item[0] == "?" else item


def _kind(item: list) -> object:
    """What items must share to be the same place of a template."""
    item = _bare(item)
    return item[0] if item[0] != "+" else _kind(item[1][0]) if len(item[1]) == 1 else tuple(map(_kind, item[1]))


def _text(item: list) -> tuple[int, int] | None:
    """Path and checksum of a text that has always been the same."""
    item = _bare(item)
    return (item[0], item[1]) if item[0] != "+" and item[1] else None


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, exact at every length; None matches nothing.

    Rows of the table are bit vectors in whole numbers; halving a again and again, as lengths of both
    halves tell where b is to be cut, keeps memory linear.
    """
    shared = (set(a) & set(b)) - {None}
    at_a, at_b = ([i for i, x in enumerate(xs) if x in shared] for xs in (a, b))  # what one side lacks has no part in it
    a, b = [a[i] for i in at_a], [b[j] for j in at_b]
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]

    def lengths(xs: list, ys: list) -> np.ndarray:
        """Of the longest common subsequence of xs and the first j of ys, for every j."""
        places: dict = {}
        for j, y in enumerate(ys):
            places[y] = places.get(y, 0) | 1 << j
        full = (1 << len(ys)) - 1
        row = full
        for x in xs:
            if mask := places.get(x):
                u = row & mask
                row = ((row + u) | (row - u)) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes(len(ys) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(ys)]
        return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i >= n or j >= m:
            continue
        if n - i == 1:
            if a[i] in b[j:m]:
                out.append((i, b.index(a[i], j, m)))
            continue
        half = (i + n) // 2
        first, second = lengths(a[i:half], b[j:m]), lengths(a[half:n][::-1], b[j:m][::-1])[::-1]
        cut = j + int((first + second).argmax())
        work += [(half, n, cut, m), (i, half, j, cut)]
    return sorted((at_a[i], at_b[j]) for i, j in out)


def _merge(a: list, b: list, same_page: bool = False) -> list:
    """One item for both, which are of one kind: of different pages, or in a row on the same ones."""
    if a[0] == "?" or b[0] == "?":
        both = _merge(_bare(a), _bare(b), same_page)
        return both if same_page and not a[0] == b[0] == "?" else ["?", both]
    if a[0] == "+" or b[0] == "+":
        x, y = a[1] if a[0] == "+" else [a], b[1] if b[0] == "+" else [b]
        return ["+", [_merge(p, q, same_page) for p, q in zip(x, y, strict=True)]]
    same = a[1] if a[1] == b[1] and not same_page else 0
    return [a[0], same, max(a[2], b[2]) if same_page else a[2] + b[2], a[3] + b[3], a[4] + b[4]]


def _folds(item: list) -> bool:
    """Whether an item may become part of a repeated group: not if it is a text that pages share."""
    item = _bare(item)
    return item[0] == "+" or not item[1] or item[2] == 1


def fold(items: list) -> list:
    """Neighbours of one kind, alone or in pairs and threes, become one repeated group."""
    for width in (1, 2, 3):
        kinds, free = [_kind(x) for x in items], [_folds(x) for x in items]
        out: list = []
        i = 0
        while i < len(items):
            group, j = items[i : i + width], i + width
            if len(group) == width and all(free[i:j]) and (width == 1 or len(set(kinds[i:j])) > 1 and not any(isinstance(k, tuple) for k in kinds[i:j])):
                while kinds[j : j + width] == kinds[i : i + width] and all(free[j : j + width]):
                    group = [_merge(p, q, True) for p, q in zip(group, items[j : j + width], strict=True)]
                    j += width
            if j > i + width:
                group = [_bare(g) for g in group]
                out.append(group[0] if width == 1 and group[0][0] == "+" else ["+", [x for g in group for x in (g[1] if g[0] == "+" else [g])]])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _forget(items: list, pages: int) -> list:
    """Texts that only few of many pages share are fields."""
    out = []
    for x in items:
        core = _bare(x)
        if core[0] != "+" and core[1] and core[2] < RARE * pages:
            core = [core[0], 0, *core[2:]]
            x = ["?", core] if x[0] == "?" else core
        out.append(x)
    return out


def align(a: dict, b: dict) -> dict:
    """The wrapper of the pages of two wrappers."""
    x, y = a["items"], b["items"]
    optional = lambda item: item if item[0] == "?" else ["?", item]
    out: list = []

    def settled(item: list, pages: int) -> bool:
        """A text that most pages have stays a text; where a page has another, it is optional."""
        core = _bare(item)
        return core[0] != "+" and bool(core[1]) and core[2] > 2 and core[2] >= TEMPLATE * pages

    i = j = 0
    for p, q in [*common_subsequence(list(map(_text, x)), list(map(_text, y))), (len(x), len(y))]:
        left = [None if settled(t, a["n"]) else _kind(t) for t in x[i:p]]
        right = [None if settled(t, b["n"]) else _kind(t) for t in y[j:q]]
        k = m = 0
        for u, v in [*common_subsequence(left, right), (len(left), len(right))]:
            out += [*map(optional, x[i + k : i + u]), *map(optional, y[j + m : j + v])]
            if u < len(left):
                out.append(_merge(x[i + u], y[j + v]))
            k, m = u + 1, v + 1
        if p < len(x):
            out.append(_merge(x[p], y[q]))
        i, j = p + 1, q + 1
    n = a["n"] + b["n"]
    elements = dict(a["elements"])
    for path, (parent, tag, flags, pages) in b["elements"].items():
        known = elements.get(path)
        elements[path] = [parent, tag, flags | known[2], pages + known[3]] if known else [parent, tag, flags, pages]
    return {"n": n, "items": fold(_forget(out, n) if n >= SETTLED else out), "elements": elements}


def as_regex(wrapper: dict) -> str:
    """The wrapper as a union-free regular expression over paths and text slots."""
    elements = wrapper["elements"]

    def said(item: list) -> str:
        if item[0] == "?":
            return f"({said(item[1])})?"
        if item[0] == "+":
            return f"({''.join(map(said, item[1]))})+"
        return f"<{elements[item[0]][1]}>" + (f"#{item[1]}" if item[1] and item[2] > 1 else "#TEXT")

    return "".join(map(said, wrapper["items"]))


# --- what a wrapper tells


def _slots(items: list) -> Iterator[list]:
    for x in items:
        core = _bare(x)
        if core[0] == "+":
            yield from core[1]
        else:
            yield core


def decide(wrapper: dict) -> dict:
    """Where the article is: regions and dropped elements (paths), template texts (path, checksum)."""
    n, elements = wrapper["n"], wrapper["elements"]
    least = max(min(n, 3), 2, TEMPLATE * n)
    template = {(s[0], s[1]) for s in _slots(wrapper["items"]) if s[1] and s[2] >= least}
    own: dict[int, float] = dict.fromkeys(elements, 0.0)
    fixed: dict[int, float] = dict.fromkeys(elements, 0.0)
    for path, same, _pages, chars, linked in _slots(wrapper["items"]):
        (fixed if (path, same) in template else own)[path] += max(0, chars - 2 * linked)
    if sum(own.values()) < sum(fixed.values()) and sum(own.values()) < 100 * n:
        own, template = {p: own[p] + fixed[p] for p in own}, set()  # the pages are copies: nothing is told apart
    order = _outward(elements)
    children: dict[int, list[int]] = {}
    for p in order:
        children.setdefault(elements[p][0], []).append(p)

    def total(values: dict[int, float], skip: int = 0) -> dict[int, float]:
        """Sums over each element and all below it, nothing from elements that have a flag of skip."""
        out = dict(values)
        for p in reversed(order):
            if elements[p][2] & skip:
                out[p] = 0.0
            if elements[p][0] in out:
                out[elements[p][0]] += out[p]
        return out

    def below(tops: list[int]) -> set[int]:
        """The elements and all below them."""
        out = set(tops)
        for p in order:
            if elements[p][0] in out:
                out.add(p)
        return out

    mass = total(own, BOILER | NAMED)
    everything = total(own, BOILER)
    skip = BOILER | NAMED
    if mass[0] < (1 - SHARE) * everything[0]:  # what only names call boilerplate is most of the text: they are wrong
        mass, skip = everything, BOILER
    at, named = 0, False
    while True:
        inside = [c for c in children.get(at, []) if not elements[c][2] & skip]
        if any(elements[c][1] in ("h1", "p") and mass[c] > 0 for c in inside):
            break
        fullest = max((c for c in inside if elements[c][1] in _CONTAINERS), key=lambda c: (mass[c], bool(elements[c][2] & MAIN), -c), default=None)
        if fullest is None or mass[fullest] < SHARE * mass[at] or mass[at] <= 0:
            break
        at = fullest
        named = named or bool(elements[at][2] & MAIN)
    regions = [at]
    if not named:  # articles beside other things, none of which holds most by itself
        called = _outermost(elements, children, skip)
        if called and (mass[0] <= 0 or sum(mass[c] for c in called) >= SHARE * mass[0]):
            regions, named = sorted(called), True
    drop = {p for p in order if elements[p][2] & skip}
    if not named:
        each = {c: mass[c] / max(1, elements[c][3]) for c in children.get(at, []) if not elements[c][2] & skip}
        most = max([own[at] / max(1, elements[at][3]), *each.values()], default=0.0)
        drop |= {c for c, m in each.items() if elements[c][1] in ("div", "section", "center", "header") and m < SLIGHT * most}
        all_chars, all_linked = dict.fromkeys(elements, 0.0), dict.fromkeys(elements, 0.0)
        for path, _same, _pages, chars, linked in _slots(wrapper["items"]):
            all_chars[path] += chars
            all_linked[path] += linked
        all_chars, all_linked = total(all_chars), total(all_linked)
        mostly_links = {c for c in order if elements[c][1] in ("ul", "ol", "div", "section", "table") and 2 * all_linked[c] > all_chars[c]}
        drop |= below([at]) & ({c for c in order if elements[c][1] == "header"} | mostly_links)
    return {"regions": regions, "drop": sorted(drop - set(regions)), "template": [] if named else sorted(map(list, template)), "named": named}


def _outward(elements: dict[int, list]) -> list[int]:
    """Elements, each after its parent."""
    children: dict[int, list[int]] = {}
    for p, e in elements.items():
        children.setdefault(e[0], []).append(p)
    out = [0]
    for p in out:
        out += children.get(p, [])
    return out


def _outermost(elements: dict[int, list], children: dict[int, list[int]], skip: int) -> list[int]:
    """Outermost elements that a page calls its article, outside boilerplate."""
    found, stack = [], [0]
    while stack:
        for c in children.get(stack.pop(), []):
            if elements[c][2] & MAIN:
                found.append(c)
            elif not elements[c][2] & skip:
                stack.append(c)
    return found


def extract(source: str | None, plan: dict | None = None) -> str:
    """The main text of a page: blocks in page order, joined by line feeds."""
    root = parse(source)
    blocks, elements = blocks_of(root)
    if not blocks:
        return ""
    if plan is None or not any(p in elements for p in plan["regions"]):
        plan = decide(shape(source))
    regions, drop = set(plan["regions"]), set(plan["drop"])
    state: dict[int, int] = {-1: 0}  # of a path: 0 outside, 1 inside a region, 2 dropped
    for p in _outward(elements):
        above = state[elements[p][0]]
        state[p] = 2 if above == 2 or p in drop or elements[p][2] & BOILER and p not in regions else 1 if above == 1 or p in regions else 0
    kept = [b for b in blocks if state[b.path] == 1]
    template = {tuple(t) for t in plan["template"]}
    if template:
        rest = [b for b in kept if (b.path, zlib.crc32(b.text.encode("utf-8", "surrogatepass")) or 1) not in template]
        # where most would go, the host's pages are copies, not one template
        if 2 * sum(len(b.text) for b in rest) >= sum(len(b.text) for b in kept):
            kept = rest
    return "\n".join(b.text for b in kept)


# --- Spark


def _dumped(w: dict) -> str:
    return json.dumps({"n": w["n"], "items": w["items"], "elements": [[p, *e] for p, e in w["elements"].items()]}, separators=(",", ":"))


def _loaded(text: str) -> dict:
    w = json.loads(text)
    return w | {"elements": {e[0]: e[1:] for e in w["elements"]}}


def host_wrappers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, wrapper (JSON) of all different pages of each host."""
    schema = "host string, hash long, wrapper string"

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            hosts, hashes, texts = [], [], []
            for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = _dumped(shape(h))
                k = xxhash.xxh64_intdigest(text)
                hosts.append(host_of(u))
                hashes.append(k - (1 << 64) if k >> 63 else k)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], names=["host", "hash", "wrapper"])

    bounded_batches(pages.sparkSession)
    first = pages.select(F.col(url).alias("u"), F.col(source).alias("h")).mapInArrow(shapes, schema)
    first = materialize(first.groupBy("host", "hash").agg(F.first("wrapper").alias("wrapper")), "shapes")
    counts = materialize(first.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host-pages")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF_PAGES))).cast("int")
    sized = counts.select(F.col("host").alias("host2"), bits.alias("bits"))
    rows = first.join(sized, F.col("host") == F.col("host2")).select("host", "bits", "hash", F.expr("if(bits > 0, shiftrightunsigned(hash, 64 - bits), 0L)").alias("part"), "wrapper")
    most = counts.agg(F.max("n")).first()[0] or 0
    rounds = 1 + -(-max(0, int(np.ceil(np.log2(max(1, most) / LEAF_PAGES)))) // ROUND_BITS)

    def joined(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("hash").to_numpy(), kind="stable").tolist()
        texts = group.column("wrapper").to_pylist()
        ready = [_loaded(texts[i]) for i in order]
        while len(ready) > 1:  # in pairs, so that alike many pages are on both sides
            ready = [align(*ready[i : i + 2]) if i + 1 < len(ready) else ready[i] for i in range(0, len(ready), 2)]
        return pa.table({"host": [key[0].as_py()], "bits": pa.array([key[1].as_py()], pa.int32()), "hash": pa.array([key[2].as_py()], pa.int64()), "wrapper": [_dumped(ready[0])]})

    for _ in range(rounds):
        merged = rows.groupBy("host", "bits", "part").applyInArrow(joined, "host string, bits int, hash long, wrapper string")
        left = F.greatest(F.lit(0), F.col("bits") - ROUND_BITS)
        # hash is the group's number here; it keeps the order of what is merged next
        rows = merged.select("host", left.alias("bits"), "hash", F.expr(f"shiftrightunsigned(hash, least(bits, {ROUND_BITS}))").alias("part"), "wrapper")
    out = materialize(rows.select("host", "wrapper"), "wrappers")
    discard(first, counts)
    return out


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    wrappers = host_wrappers(pages, url, source)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plans = [json.dumps(decide(_loaded(w)), separators=(",", ":")) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plans, pa.string())], names=["host", "plan"])

    plans = materialize(wrappers.mapInArrow(decided, "host string, plan string"), "plans")
    discard(wrappers)
    picked = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("h"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern.replace("(?:[A-Za-z]", "^(?:[A-Za-z]", 1), 1))
    small = (plans.agg(F.sum(F.octet_length("plan"))).first()[0] or 0) <= BROADCAST_BYTES
    joined = picked.withColumn("host", host).join(F.broadcast(plans) if small else plans, "host", "left").select("page_id", "url", "h", "plan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in pieces(batches):
            texts = []
            for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p is not None and p not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[p] = json.loads(p)
                texts.append(extract(h, known.get(p)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
