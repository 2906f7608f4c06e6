"""A page's block tree, and matching of such trees.

Only block elements are nodes; inline markup disappears into the text of its block. Broken markup
is read as browsers do in the common cases: implied end tags, unclosed elements, raw text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

# --- fixed names -------------------------------------------------------------------------------

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
HEAD = set("base link meta noscript script style template title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks of running text: those of one kind below one parent count as one repeated node.
FLOW = HEADINGS | set("p li dt dd tr td th blockquote pre ul ol dl table figure hr tbody".split())
#: A start tag ends the open elements of these names, unless one of the fences is nearer.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    **{h: (HEADINGS, set()) for h in HEADINGS},
}
FENCES = {"td", "th", "table", "caption", "button", "object", "template", "html"}

#: Elements, ARIA roles and words of class or id that are never part of the article.
CHROME_TAGS = set(
    "nav footer aside form button select dialog template svg iframe object audio video canvas menu "
    "search datalist noscript script style textarea title head".split()
)
CHROME_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo banner cookie "
    "cookies consent gdpr notice popup modal newsletter subscribe signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead topbar comment comments respond reply replies disqus "
    "discussion share sharing social related recommended widget pagination pager toolbar form search".split()
)
HEADER_WORDS = {"header"}
NEGATED = set("no not has with without is hide".split())
#: Class names and ids of containers of the article, where no element says so.
CONTENT_NAMES = set(
    "content main main-content maincontent article article-body post post-content post-body entry "
    "entry-content story story-body page-content".split()
)

IN_ARTICLE, IN_MAIN, IN_CONTENT, ELSEWHERE = range(4)
DEEPEST = 150

# --- reading -----------------------------------------------------------------------------------

_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^>\s"'][^>\s]*+)?)*+"""
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(" + _ATTRS + r")(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Node:
    label: str
    chrome: bool
    header: bool
    region: int
    heading: bool
    kids: list[Node] = field(default_factory=list)
    at: int = -1


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int


@dataclass(slots=True)
class _Open:
    tag: str
    node: Node | None
    depth: int


def _words(name: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(name)]


def _marked(name: str, words: set[str]) -> bool:
    """A class or id that starts or ends with one of the words, as ``sidebar-left``, ``mainNav``."""
    own = _words(name)
    return bool(own) and (own[0] in words or own[-1] in words) and not NEGATED & set(own)


def _kind(tag: str, attrs: str, over: Node | None) -> tuple[str, bool, bool, int]:
    """Label, whether the element is no part of an article, whether a header, and its region."""
    region = over.region if over else ELSEWHERE
    chrome, header = tag in CHROME_TAGS, tag == "header"
    if tag == "article":
        region = IN_ARTICLE
    elif tag == "main":
        region = min(region, IN_MAIN)
    first = ""
    if attrs and not attrs.isspace():
        a = {}
        for m in _ATTR.finditer(attrs):
            a.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        names = [*a.get("class", "").split(), a.get("id", "").strip()]
        first = re.sub(r"\d+", "#", names[0]) if names[0] else ""
        role = a.get("role", "").strip().lower()
        chrome |= role in CHROME_ROLES or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()
        if tag == "article":
            chrome |= any(n.lower() in CHROME_WORDS for n in names)
        elif tag not in ("html", "body", "main"):
            chrome |= any(_marked(n, CHROME_WORDS) for n in names)
            header |= any(_marked(n, HEADER_WORDS) for n in names)
        if role == "article" or a.get("itemprop", "").lower() == "articlebody":
            region = IN_ARTICLE
        elif role == "main":
            region = min(region, IN_MAIN)
        elif any(n.lower() in CONTENT_NAMES for n in names):
            region = min(region, IN_CONTENT)
    label = f"{tag}.{first}" if first else tag
    return re.sub(r"[(),]", "_", label), chrome, header, region


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree and its blocks of text in page order, white space and references undone.

    Text outside all elements belongs to the root. An element deeper than DEEPEST counts as one of
    that depth. Blocks without text are left out; so is what scripts, styles and other raw text hold.
    """
    root = Node("#", False, False, ELSEWHERE, False)
    stack, blocks = [_Open("#", root, 0)], []
    pieces: list[str] = []
    linked = links = 0
    cut = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(_holder(stack), text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = html.unescape(raw)
        if len(stack) > 1 and stack[-1].tag == "head" and not raw.isspace():
            close(len(stack) - 1)
        pieces.append(raw)
        if links:
            linked += len("".join(raw.split()))

    def close(i: int) -> None:
        """End the open elements from the i-th on."""
        nonlocal links
        if any(o.node for o in stack[i:]):
            flush()
        links -= sum(o.tag == "a" for o in stack[i:])
        del stack[i:]

    def nearest(tags: set[str], fences: set[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in fences:
                break
        return 0

    position = 0
    while m := _TOKEN.search(page, position):
        if m.start() > cut:
            add(page[cut : m.start()])
        position = cut = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag in ("html", "body"):
                continue
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if not i:
                continue
            if stack[i].node or not any(o.node for o in stack[i:]):
                close(i)
            else:
                links -= tag == "a"
                del stack[i]
            continue
        if tag in ("html", "body", "head") and any(o.tag == tag for o in stack):
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, cut)
            position = cut = end.start() if end else len(page)
            continue
        if tag in BLOCKS:
            flush()
            for tags, fences in (({"p"}, FENCES), ENDS.get(tag, (set(), set()))):
                if i := nearest(tags, fences):
                    close(i)
        elif tag == "br":
            pieces.append(" ")
        if tag in VOID:
            continue
        over = stack[-1]
        holder = _holder(stack)
        label, chrome, header, region = _kind(tag, m[3], holder)
        node = None
        if (tag in BLOCKS or chrome) and over.depth < DEEPEST:
            flush()
            node = Node(label, holder.chrome or chrome, holder.header or header, region, tag in HEADINGS or holder.heading)
            holder.kids.append(node)
        links += tag == "a"
        if len(stack) < 4 * DEEPEST:
            stack.append(_Open(tag, node, over.depth + (node is not None)))
        else:
            links -= tag == "a"
    if cut < len(page):
        add(page[cut:])
    flush()
    return root, blocks


def _holder(stack: list[_Open]) -> Node:
    return next(o.node for o in reversed(stack) if o.node)


def dropped(node: Node) -> bool:
    """Not part of an article by its own place: chrome, and headers but for an article's headings."""
    return node.chrome or (node.header and not (node.region == IN_ARTICLE and node.heading))


# --- folded trees ------------------------------------------------------------------------------


def fold(node: Node) -> tuple:
    """The tree as nested (label, kids, nodes), in which repeated siblings are one node.

    Running text folds by kind wherever it stands below its parent, other elements only next to
    one with the same label, which must carry a class or id.
    """
    kids: list[list] = []
    flow: dict[str, list] = {}
    for kid in node.kids:
        label, below, members = fold(kid)
        tag = label.split(".")[0]
        same = flow.get(label) if tag in FLOW else None
        if same is None and kids and tag not in FLOW and "." in label and kids[-1][0] == label:
            same = kids[-1]
        if same is None:
            same = [label, below, members]
            kids.append(same)
            if tag in FLOW:
                flow[label] = same
        else:
            _, same[1], _ = merged((label, same[1], same[2]), (label, below, members))
    return node.label, tuple(tuple(k) for k in kids), [node]


def merged(a: tuple, b: tuple) -> tuple:
    """Two trees of one label as one: matched nodes become one, others keep their order.

    The page nodes of ``b`` are added to the lists in ``a``."""
    a[2].extend(b[2])
    if not a[1] or not b[1]:
        return a[0], a[1] or b[1], a[2]
    kids = []
    for i, j in matching(a[1], b[1]):
        if i is None:
            kids.append(b[1][j])
        elif j is None:
            kids.append(a[1][i])
        else:
            kids.append(merged(a[1][i], b[1][j]))
    return a[0], tuple(kids), a[2]


#: Child lists whose lengths multiply to more than this are matched by their labels in order only.
MOST_PAIRS = 1 << 14


def matching(a: tuple, b: tuple) -> Iterator[tuple[int | None, int | None]]:
    """Simple tree matching of two child lists: the order-keeping pairs of greatest weight, with
    the unmatched of both between them."""
    if len(a) * len(b) > MOST_PAIRS:
        return _greedy(a, b)
    best = _table(a, b)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
            pairs.append((i, None))
        elif best[i][j] == best[i][j - 1]:
            j -= 1
            pairs.append((None, j))
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    pairs += [(None, n) for n in range(j - 1, -1, -1)] + [(n, None) for n in range(i - 1, -1, -1)]
    return reversed(pairs)


def weight(a: tuple, b: tuple) -> int:
    """The most nodes of two trees that match with their order and ancestors."""
    if a[0] != b[0]:
        return 0
    if not a[1] or not b[1]:
        return 1
    if len(a[1]) * len(b[1]) > MOST_PAIRS:
        return 1 + sum(i is not None and j is not None for i, j in _greedy(a[1], b[1]))
    return 1 + _table(a[1], b[1])[-1][-1]


def _table(a: tuple, b: tuple) -> list[list[int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            row[j + 1] = max(above[j + 1], row[j], above[j] + weight(x, y) if x[0] == y[0] else 0)
    return best


def _greedy(a: tuple, b: tuple) -> Iterator[tuple[int | None, int | None]]:
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j][0], []).append(j)
    at = 0
    for i, x in enumerate(a):
        there = places.get(x[0], [])
        while there and there[-1] < at:
            there.pop()
        if not there:
            yield i, None
            continue
        j = there.pop()
        yield from ((None, n) for n in range(at, j))
        yield i, j
        at = j + 1
    yield from ((None, n) for n in range(at, len(b)))


def number(folded: tuple) -> None:
    """Give every page node the place of its folded node in preorder."""
    todo, n = [folded], 0
    while todo:
        _, kids, nodes = todo.pop()
        for node in nodes:
            node.at = n
        n += 1
        todo.extend(reversed(kids))


def written_out(folded: tuple) -> str:
    """A folded tree as text: ``label(kid,kid)``."""
    label, kids = folded[0], folded[1]
    return f"{label}({','.join(map(written_out, kids))})" if kids else label


def read_in(text: str) -> tuple:
    """The tree that ``written_out`` wrote, without page nodes."""
    stack: list[list] = [["", []]]
    for label, mark in re.findall(r"([^(),]*)([(),]|\Z)", text):
        if label:
            stack[-1][1].append([label, []])
        if mark == "(":
            stack.append(stack[-1][1][-1])
        elif mark == ")":
            stack.pop()
    return _frozen(stack[0][1][0])


def _frozen(node: list) -> tuple:
    return node[0], tuple(_frozen(k) for k in node[1]), []


def aligned(tree: tuple, template: tuple) -> list[str]:
    """Per node of ``tree`` in preorder the name of its slot: the place of the template's node that
    it matches, or, below the nearest ancestor that does, its labels."""
    places: dict[int, int] = {}
    todo = [template]
    while todo:
        t = todo.pop()
        places[id(t)] = len(places)
        todo.extend(reversed(t[1]))
    slots: list[str] = []

    def walk(node: tuple, match: tuple | None, name: str) -> None:
        slots.append(name)
        with_ = {i: j for i, j in matching(node[1], match[1]) if i is not None} if match else {}
        for i, kid in enumerate(node[1]):
            j = with_.get(i)
            if j is None:
                walk(kid, None, f"{name}/{kid[0]}")
            else:
                walk(kid, match[1][j], str(places[id(match[1][j])]))

    walk(tree, template, "0")
    return slots
