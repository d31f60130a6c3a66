"""Main text of web pages by wrapper induction.

Pages of a host share a template. A wrapper is induced for each host: the DOM trees of a few of its pages, in which runs of like
siblings are one repeated node, are aligned by simple tree matching (Yang, 1991: the largest order-keeping match of two trees, by
dynamic programming over children). A host of several layouts gets a wrapper for each that its reference pages show.

The reference pages only give the trees to align with. What is template and what is content is decided by counts over all pages:
each page of the host is aligned with its layout's wrapper, and for each place (the node around a block) and text the distinct
pages that show it are counted. A text that at least SUPPORT + 1 pages show, and more than SHARE of the pages that have the place
(by one standard deviation, as passages repeat in a seventh of some hosts' articles), is template, whether the reference pages
hold it or not; so one place may have several template texts, or be there on some pages only.

What isn't template fills the wrapper's slots. The characters of each slot outside links, summed over all pages of the host, choose
the content: the articles among the wrapper's nodes if they hold most of that text, else the lowest node that holds FOCUS of it.
Parts that tags, roles or class names mark as menus, headers, footers, sidebars, notices, adverts, forms or comments take no
part in this. Pages without a wrapper are treated by the same rules, on their own text.

Reference pages are chosen by pre-aggregated minima, so a host with a third of all pages is as cheap as any; wrappers are small and
reach pages by a join, broadcast only if all of them together are within a checked size.
"""

from __future__ import annotations

import json
import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, table

REFERENCES = 5
SUPPORT = 3
#: Of the pages that have a place, the share that has to show a text there; and how alike the outlines of pages of one layout are.
SHARE = 0.2
ALIKE = 0.6
#: Of the varying text outside links, the share that the content's node has to hold.
FOCUS = 0.8
BROADCAST_BYTES = 16 << 20
#: Deeper elements hang from the element at this depth, or from the left-out one that is around them.
MAX_DEPTH = 150
#: More pairs of siblings than this are matched in a band around the diagonal.
MAX_CELLS = 1 << 18

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title iframe object svg canvas math".split())
#: Of these, what a block element ends if it begins inside, on pages that close fewer of them than they open.
LEAKY = ("iframe", "object", "svg", "canvas", "math", "noscript", "template")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
OUT_TAGS = frozenset("nav footer aside form button select textarea input dialog menu label option".split())
#: What an opening tag ends, if it is open and nothing in `BARS` lies between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"tr", "thead"}, "tfoot": {"tr", "tbody"}}
BARS = frozenset("ul ol dl table article section div main body aside nav form".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "tr", "tbody", "thead", "tfoot"}
#: Names of parts that aren't the article. They count as whole tokens of a class or an id, as the token's first word before a noun of PART, or as a noun of PART's qualifier.
OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promos promotion "
    "banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment "
    "comments commentlist replies reply respond disqus pagination pager toolbar widget widgets outbrain taboola paywall".split()
)
PART = frozenset(
    "area bar block box bottom button buttons container content form item items left links list message nav notice panel posts right section slot top unit widget widgets wrap wrapper banner menu main primary secondary footer sidebar inner".split()
)
OUT_WHOLE = frozenset("header search skip skip-link sign-up site-header page-header site-footer page-footer site-nav main-nav top-nav main-menu side-bar left-sidebar right-sidebar".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "name", "out", "children", "template", "linked")

    def __init__(self, tag: str, name: str = "", out: bool = False):
        self.tag, self.name, self.out, self.children, self.template, self.linked = tag, name, out, [], False, False


def out_name(names: str) -> bool:
    """Whether one of these class names or ids marks a part that isn't the article. `no-sidebar`, `with-sidebar`, `has-ads` or `entry-header` don't."""
    for token in names.lower().split():
        if token in OUT_WORDS or token in OUT_WHOLE:
            return True
        words = re.split(r"[-_]+", token.rstrip("0123456789-_"))
        if words[0] in OUT_WORDS and all(w in PART or w in OUT_WORDS or w.isdigit() for w in words[1:]):
            return True
    return False


def _is_out(tag: str, attrs: dict[str, str]) -> bool:
    if attrs.get("role", "").lower() in OUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    return out_name(attrs.get("class", "")) or out_name(attrs.get("id", ""))


#: A tag, or what is dropped: comments, declarations, instructions and end tags without a name. Quotes count after an equals sign only.
MARKUP = re.compile(r"""<(?:(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+)>|!--(?:-?>|.*?--!?>)|(?P<open>!--)|[!?/][^>]*+>)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style")}
CUT_OFF = re.compile("<[a-zA-Z/!?]")


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag, the first of those with one name."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and value[-1:] == value[:1]:
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


class _Builder:
    """Open elements are (tag, the node that takes what comes)."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [("#root", self.root)]
        self.leaky = {"head"}

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in self.leaky:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in BLOCK:
                    break
        if tag in CLOSES_P:
            self._end({"p"})
        if tag in ENDS:
            self._end(ENDS[tag])
        around = self.stack[-1][1]
        node = Node(tag, f"{attrs.get('id', '')}.{attrs.get('class', '')}" if attrs else ".", tag in UNSEEN or tag in OUT_TAGS or (attrs and _is_out(tag, attrs)))
        around.children.append(node)
        if tag not in VOID:
            self.stack.append((tag, node if len(self.stack) < MAX_DEPTH or (node.out and not around.out) else around))

    def _end(self, tags):
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k][0]
            if t in tags:
                del self.stack[k:]
                return
            if t in BARS:
                return

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag not in BARS and self.stack[k][0] in BARS:
                return

    def handle_data(self, data):
        if self.stack[-1][0] in UNSEEN:
            return
        kids = self.stack[-1][1].children
        if kids and kids[-1].tag == "#text":
            kids[-1].name += data
        elif not data.isspace():
            kids.append(Node("#text", data))
            kids[-1].linked = any(t == "a" for t, _ in self.stack[-4:])
        else:
            kids.append(Node("#space"))


def parse(html: str) -> Node:
    """The tree of a page. What isn't closed ends with what is around it; an open comment, and a tag that is cut off, go on to the end."""
    builder = _Builder()
    low = html.lower()
    builder.leaky.update(t for t in LEAKY if low.count("<" + t) > low.count("</" + t))
    at, search = 0, MARKUP.search
    while found := search(html, at):
        begin = found.start()
        if begin > at:
            text = html[at:begin]
            builder.handle_data(unescape(text) if "&" in text else text)
        at = found.end()
        end, tag, attrs, opened = found.groups()
        if tag:
            tag = tag.lower()
            if end:
                builder.handle_endtag(tag)
                continue
            builder.handle_starttag(tag, attributes(attrs) if attrs and not attrs.isspace() else {})
            if attrs[-1:] == "/":
                if tag not in VOID:
                    builder.handle_endtag(tag)
            elif tag in RAW_END:
                closed = RAW_END[tag].search(html, at)
                at = closed.start() if closed else len(html)
        elif opened:
            at = len(html)
    cut = CUT_OFF.search(html, at)
    text = html[at : cut.start()] if cut else html[at:]
    if text:
        builder.handle_data(unescape(text))
    return builder.root


def says(node: Node) -> str:
    return " ".join(node.name.split())


# wrappers: [tag, name, text or None, repeated, children]; text is None for elements, and where it varies


def as_wrapper(node: Node, of: dict | None = None) -> list:
    """The tree as a wrapper, without white space and parts that browsers don't show; `of` gets the nodes of texts and elements by the identity of their wrapper nodes."""
    kids = [as_wrapper(c, of) for c in node.children if c.tag != "#space" and c.tag not in VOID and c.tag not in UNSEEN]
    w = [node.tag, "" if node.tag == "#text" else node.name, says(node) if node.tag == "#text" else None, False, kids]
    if of is not None:
        of[id(w)] = node
    return w


def match(a: list, b: list, memo: dict | None = None) -> tuple[float, list[tuple[list, list]]]:
    """Score of the best match of two wrapper trees with equal roots' tags, and the pairs of children matched. A repeated child of b may take several of a.

    One byte is kept for each pair of children; if those were more than MAX_CELLS, only pairs in a band around the diagonal are tried.
    """
    x, y = a[4], b[4]
    memo = {} if memo is None else memo
    if not x or not y:
        return 1.0, []
    wide = len(y) if len(x) * len(y) <= MAX_CELLS else max(1, MAX_CELLS // len(x))
    # per row: the first column tried, and what was best there (0: left, 1: up, 2: both, 3: up with the pair, for repeated ones)
    rows: list[tuple[int, bytearray]] = []
    above, low = [0.0] * (len(y) + 1), 0
    for i, p in enumerate(x):
        low = 0 if wide == len(y) else min(max(0, i * len(y) // len(x) - wide // 2), len(y) - wide)
        row, took = [0.0] * (len(y) + 1), bytearray(wide)
        best = row[low] = above[low] if low else 0.0
        for j in range(low, low + wide):
            q = y[j]
            kind = 0
            if above[j + 1] > best:
                best, kind = above[j + 1], 1
            if p[0] == q[0]:
                s = _score(p, q, memo)
                if above[j] + s > best:
                    best, kind = above[j] + s, 2
                if q[3] and above[j + 1] + s > best:
                    best, kind = above[j + 1] + s, 3
            row[j + 1], took[j - low] = best, kind
        for j in range(low + wide, len(y) if wide < len(y) else 0):
            row[j + 1] = best
        rows.append((low, took))
        above = row
    pairs, i, j = [], len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        low, took = rows[i]
        if j >= low + len(took):
            j -= 1
            continue
        if j < low:
            i -= 1
            continue
        kind = took[j - low]
        if kind >= 2:
            pairs.append((x[i], y[j]))
        if kind != 0:
            i -= 1
        if kind in (0, 2):
            j -= 1
    return 1.0 + above[-1], pairs


def _score(p: list, q: list, memo: dict) -> float:
    if p[0] == "#text":
        return 1.5 if p[2] == q[2] else 0.5
    same = 0.5 if p[1] == q[1] else 0.0
    if not p[4] or not q[4]:
        return 1.0 + same
    key = (id(p), id(q))
    if key not in memo:
        memo[key] = match(p, q, memo)[0]
    return memo[key] + same


def align(a: list, b: list):
    """Pairs (node of a, node of b) of the best match, over all levels."""
    memo: dict = {}
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        yield p, q
        if p[0] != "#text":
            todo += match(p, q, memo)[1]


def _folded(w: list) -> list:
    """Neighbouring siblings of one tag and name become one repeated node, with the children of the one that has most."""
    kids: list = []
    for c in map(_folded, w[4]):
        if kids and kids[-1][:2] == c[:2] and c[0] != "#text":
            if len(c[4]) > len(kids[-1][4]):
                kids[-1] = c
            kids[-1][3] = True
        else:
            kids.append(c)
    w[4] = kids
    return w


def induce(pages: list[str]) -> list | None:
    """The wrapper of pages of one layout; None of fewer than two different ones, which show nothing of what varies. No text of fewer than SUPPORT alignments is template."""
    trees = [_folded(as_wrapper(parse(p))) for p in dict.fromkeys(pages)]
    if len(trees) < 2:
        return None
    base, same, seen = max(trees, key=_nodes), {}, {}
    for other in trees:
        if other is base:
            continue
        for p, q in align(other, base):
            if q[0] == "#text":
                seen[id(q)] = seen.get(id(q), 0) + 1
                same[id(q)] = same.get(id(q), 0) + (p[2] == q[2])

    def settle(w):
        if w[0] == "#text" and (seen.get(id(w), 0) < SUPPORT or same[id(w)] < seen[id(w)]):
            w[2] = None
        for c in w[4]:
            settle(c)

    settle(base)
    return base


def _nodes(w: list) -> int:
    return 1 + sum(map(_nodes, w[4]))


def outline(w: list, above: str = "") -> set:
    """The kinds of elements below a wrapper node, each with that of its parent."""
    own = f"{w[0]} {w[1]}"
    return {(above, own)}.union(*(outline(c, own) for c in w[4] if c[0] != "#text"))


def layouts(pages: list[str]) -> list | None:
    """A wrapper for each layout that these pages of a host show; None of fewer than two different ones."""
    distinct = list(dict.fromkeys(pages))
    if len(distinct) < 2:
        return None
    kinds: list[tuple[set, list[str]]] = []
    for p in distinct:
        own = outline(_folded(as_wrapper(parse(p))))
        near = max(kinds, key=lambda k: _alike(k[0], own), default=None)
        if near is not None and _alike(near[0], own) >= ALIKE:
            near[1].append(p)
        else:
            kinds.append((own, [p]))
    return [induce(group) or _settled(_folded(as_wrapper(parse(group[0])))) for _, group in kinds]


def _settled(w: list) -> list:
    """Without texts, of which one page says nothing."""
    w[2] = None
    for c in w[4]:
        _settled(c)
    return w


def _alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


#: Elements whose inside isn't aligned: their texts belong to them.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())


def _bare(w: list) -> list:
    """A wrapper's elements without texts."""
    return [w[0], w[1], None, w[3], [] if w[0] in LEAVES else [_bare(c) for c in w[4] if c[0] != "#text"]]


def _bare_page(node: Node, of: dict[int, Node]) -> list:
    """A page's elements as a wrapper without texts; `of` gets the nodes by the identity of their wrapper nodes."""
    w = [node.tag, node.name, None, False, [] if node.tag in LEAVES else [_bare_page(c, of) for c in node.children if c.tag[0] != "#" and c.tag not in VOID and c.tag not in UNSEEN]]
    of[id(w)] = node
    return w


class Wrappers:
    """A host's wrappers with what aligning pages with them needs."""

    def __init__(self, wrappers: list):
        self.wrappers = [_bare(w) for w in wrappers]
        self.outlines = [outline(w) for w in self.wrappers]
        #: Of each wrapper node its number: the layout's in the high bits, then its place in the tree, parents before children.
        self.number: dict[int, int] = {}
        for k, w in enumerate(self.wrappers):
            todo, n = [w], 0
            while todo:
                q = todo.pop()
                self.number[id(q)] = k << 32 | n
                n += 1
                todo += reversed(q[4])

    def read(self, root: Node) -> tuple[list[tuple[Node, int, int, int]], dict[int, list[Node]]]:
        """(text node, place, place with text, wrapper node's number) of each text of a page, and the page's nodes by the number of their wrapper node. Places are 64-bit hashes, never 0.

        The place is the wrapper node that is aligned with the element around the text's block (or with the nearest element
        above, and the tags from there), so that blocks of one container share it in any order.
        """
        node_of: dict[int, Node] = {}
        tree = _bare_page(root, node_of)
        at = 0
        if len(self.wrappers) > 1:
            own = outline(tree)
            at = max(range(len(self.wrappers)), key=lambda k: (_alike(self.outlines[k], own), -k))
        with_: dict[int, int] = {}
        nodes: dict[int, list[Node]] = {}
        for p, q in align(tree, self.wrappers[at]):
            with_[id(node_of[id(p)])] = k = self.number[id(q)]
            nodes.setdefault(k, []).append(node_of[id(p)])
        got = []

        def walk(node, spot, place, around, inner):
            # spot: the nearest aligned node; place: of node itself; around: of the element around its block; inner: tags from there
            for c in node.children:
                tag = c.tag
                if tag == "#text":
                    a = xxhash.xxh3_64_intdigest(around) >> 1 or 1
                    got.append((c, a, xxhash.xxh3_64_intdigest(f"{around}\n{inner}\n{says(c)}".encode("utf-8", "surrogatepass")) >> 1 or 1, spot))
                elif c.children and tag not in UNSEEN:
                    to = with_.get(id(c))
                    own = f"{place}/{tag}" if to is None else str(to)
                    to = spot if to is None else to
                    if tag in BLOCK:
                        walk(c, to, own, place, tag)
                    else:
                        walk(c, to, own, around, f"{inner} {tag}")

        top = with_[id(root)]
        walk(root, top, str(top), str(top), "")
        return got, nodes

    def content(self, amounts: dict[int, int]) -> set[int]:
        """Numbers of the nodes that are the content of their layouts, by the amounts of varying text outside links at each node."""
        return {self.number[id(q)] for w in self.wrappers for q in _chosen(w, lambda q: q[4], lambda q: q[0], lambda q: amounts.get(self.number[id(q)], 0))}


def _chosen(root, children, tag, amount) -> list:
    """Of a tree whose nodes hold amounts of varying text: its articles if they hold most of it, else its main parts if these do, else the lowest node that holds FOCUS of it. Of several articles, the one that holds most and its siblings; the others are teasers."""
    total: dict[int, int] = {}
    parent: dict[int, object] = {}

    def add(node) -> int:
        for c in children(node):
            parent[id(c)] = node
        total[id(node)] = amount(node) + sum(add(c) for c in children(node))
        return total[id(node)]

    whole = add(root)
    for kind in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if tag(node) == kind and total[id(node)]:
                found.append(node)
            else:
                todo += reversed(children(node))
        if found and 2 * sum(total[id(n)] for n in found) >= whole:
            most = max(found, key=lambda n: total[id(n)])
            return [n for n in found if n is most or parent.get(id(n)) is parent.get(id(most))]
    node = root
    while True:
        best = max((c for c in children(node) if tag(c) in BLOCK and tag(c) not in PARAGRAPHS), key=lambda c: total[id(c)], default=None)
        if best is None or not whole or total[id(best)] < FOCUS * whole:
            return [node]
        node = best


PARAGRAPHS = frozenset("p ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 li figure".split())


def mark_template(root: Node, wrapper: list | None) -> None:
    """Set `template` on the page's text nodes that match a template text of the wrapper."""
    if wrapper is None:
        return
    back: dict[int, Node] = {}
    for p, q in align(as_wrapper(root, back), wrapper):
        if p[0] == "#text" and q[2] is not None and p[2] == q[2]:
            back[id(p)].template = True


def _prose(node: Node) -> int:
    """Characters of a text outside links."""
    return 0 if node.linked else len(says(node))


def content_slots(root: Node) -> list[Node]:
    """The content of a page by itself: what _chosen says of its own varying text, without what is left out."""
    return _chosen(root, lambda n: [c for c in n.children if not c.out and c.tag != "header"], lambda n: n.tag, lambda n: sum(_prose(c) for c in n.children if c.tag == "#text" and not c.template))


def _find(node: Node, test) -> list[Node]:
    """Outermost nodes that pass."""
    if test(node):
        return [node]
    return [] if node.out else [x for c in node.children for x in _find(c, test)]


def blocks(slots: list[Node]) -> list[str]:
    """The slots' blocks of text, white space made single; without those that are template as a whole."""
    out: list[tuple[str, bool]] = []
    now: list[str] = []
    template = True

    def cut():
        nonlocal template
        text = " ".join("".join(now).split())
        if text:
            out.append((text, template))
        now.clear()
        template = True

    def walk(node, top=False):
        nonlocal template
        if node.tag == "#text":
            now.append(node.name)
            template = template and node.template
            return
        if node.tag in ("#space", "br", "wbr", "td", "th"):
            now.append(" ")
        if node.out and not top:
            return
        if node.tag == "header":
            cut()
            for h in _find(node, lambda n: n.tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
                walk(h)
            cut()
            return
        is_block = node.tag in BLOCK
        if is_block:
            cut()
        for c in node.children:
            walk(c)
        if is_block:
            cut()

    for slot in slots:
        walk(slot, True)
        cut()
    content = [t for t, is_template in out if not is_template]
    # a slot that is template for the most part is one that copies share, not a template
    return content if 2 * sum(map(len, content)) >= sum(len(t) for t, _ in out) else [t for t, _ in out]


def page_text(html: str | None, wrappers: Wrappers | None, template: frozenset, content: set[int]) -> str:
    """The main text of a page of a host with these wrappers, whose template texts have these keys and whose content is at these nodes."""
    if not html or wrappers is None:
        return main_text(html)
    root = parse(html)
    texts, nodes = wrappers.read(root)
    for node, _, key, _ in texts:
        node.template = key in template
    slots = [n for k in sorted(content) for n in nodes.get(k, ()) if _says_more(n)]
    return "\n\n".join(blocks(slots or content_slots(root)))


def _says_more(node: Node) -> bool:
    """Whether something that varies is left inside."""
    return any(not c.template if c.tag == "#text" else not c.out and _says_more(c) for c in node.children)


def main_text(html: str | None, wrapper: list | None = None) -> str:
    if not html:
        return ""
    root = parse(html)
    mark_template(root, wrapper)
    return "\n\n".join(blocks(content_slots(root)))


def host_of(url):
    """Host of a URL in lower case, without user and port; empty for a null or malformed one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """(host, wrappers of its layouts as JSON) of each host with at least two different reference pages; `references` pages are chosen by hash, one of each of as many shares of the host's pages."""
    mark = F.xxhash64(html_col)
    chosen = pages.where(F.col(html_col).isNotNull() & (F.length(html_col) > 0)).select(host_of(F.col(url_col)).alias("host"), F.pmod(mark, F.lit(references)).alias("share"), mark.alias("mark"), F.col(html_col).alias("html")).where("host <> ''").groupBy("host", "share").agg(F.min_by("html", "mark").alias("html"))

    def run(key, rows):
        ordered = [h for _, h in sorted(zip(rows.column("share").to_pylist(), rows.column("html").to_pylist()))]
        w = layouts(ordered)
        return pa.table({"host": pa.array([key[0].as_py()] if w else [], pa.string()), "wrapper": pa.array([json.dumps(w, ensure_ascii=False, separators=(",", ":"))] if w else [], pa.string())})

    return materialize(chosen.groupBy("host").applyInArrow(run, "host string, wrapper string"), "wrappers")


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
    """Rows with the columns of their host's wrapper, broadcast if all of them together are small."""
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + 8 * F.size("template") + 16 * F.size("amounts"))).first()[0] or 0
    side = wrappers.select(F.col("host").alias("__host"), "wrapper", "template", "amounts")
    return rows.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, F.col("__of") == F.col("__host"), how)


class _Known:
    """Wrappers, template keys and content of hosts as a task meets them."""

    def __init__(self):
        self.held: dict = {}

    def get(self, host, wrapper, template, amounts):
        if not wrapper.is_valid:
            return None, frozenset(), set()
        if host not in self.held:
            if len(self.held) > 2000:
                self.held.clear()
            w = Wrappers(json.loads(wrapper.as_py()))
            self.held[host] = w, frozenset(template.as_py()), w.content({x["spot"]: x["chars"] for x in amounts.as_py()})
        return self.held[host]


AMOUNTS = "array<struct<spot: bigint, chars: bigint>>"


def _left_out(root: Node) -> set[int]:
    """Identities of the text nodes inside parts that are left out."""
    gone, todo = set(), [(root, False)]
    while todo:
        node, out = todo.pop()
        out = out or node.out or node.tag == "header"
        if node.tag == "#text" and out:
            gone.add(id(node))
        todo += [(c, out) for c in node.children]
    return gone


def template_keys(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, wrapper, template, amounts): the wrappers with the keys of the host's template texts, and the characters of varying text outside links at each wrapper node, by counts over all distinct pages (rows of html, __of)."""

    def run(batches):
        known = _Known()
        for batch in batches:
            hosts, out = batch.column(1).to_pylist(), []
            for i, h in enumerate(hosts):
                w, _, _ = known.get(h, batch.column(3)[i], batch.column(4)[i], batch.column(5)[i])
                mark, of = batch.column(2)[i].as_py(), batch.column(6)[i].as_py()
                root = parse(batch.column(0)[i].as_py())
                gone, shown = _left_out(root), {}
                for node, a, k, spot in w.read(root)[0]:
                    chars = 0 if id(node) in gone else _prose(node)
                    for key in (k, 0):
                        shown[spot, a, key] = shown.get((spot, a, key), 0) + chars
                out += [(of, mark, *x, n) for x, n in shown.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)], ["of", "page", "spot", "place", "key", "chars"])

    given = _with_wrappers(rows.where(F.length("html") > 0), wrappers.withColumns({"template": F.array().cast("array<long>"), "amounts": F.array().cast(AMOUNTS)}), "inner")
    shown = given.select("html", "__of", F.xxhash64("html"), "wrapper", "template", "amounts", F.xxhash64("__of")).mapInArrow(run, "of long, page long, spot long, place long, key long, chars long")
    once = shown.groupBy("of", "spot", "place", "key", "page").agg(F.max("chars").alias("chars"))
    # a text of one block can stand at several wrapper nodes: its pages are counted at each
    counts = once.groupBy("of", "spot", "place", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).where(f"key = 0 or n > {SUPPORT}")
    counts = materialize(counts, "page-counts")
    have = counts.where("key = 0").groupBy("of", "place").agg(F.max("n").alias("whole"))
    chosen = counts.where("key <> 0").join(have, ["of", "place"]).where(F.col("n") >= SHARE * F.col("whole") + F.sqrt(SHARE * (1 - SHARE) * F.col("whole")))
    of_host = chosen.groupBy("of").agg(F.collect_set("key").alias("keys"))
    varying = counts.where("key = 0").select("of", "spot", "chars").unionByName(chosen.select("of", "spot", F.negate("chars").alias("chars"))).groupBy("of", "spot").agg(F.sum("chars").alias("chars"))
    amounts = varying.where("chars > 0").groupBy("of").agg(F.collect_list(F.struct("spot", "chars")).alias("amounts")).withColumnRenamed("of", "of_too")
    out = wrappers.join(of_host, F.xxhash64("host") == F.col("of"), "left").join(amounts, F.xxhash64("host") == F.col("of_too"), "left")
    return materialize(out.select("host", "wrapper", F.coalesce("keys", F.array().cast("array<long>")).alias("template"), F.coalesce("amounts", F.array().cast(AMOUNTS)).alias("amounts")), "templates")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", references: int = REFERENCES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages.

    Null or empty html, and html without text, give an empty text. Pages without a host, or of a host with a single distinct
    page, are extracted without a wrapper; a host of up to SUPPORT distinct pages has no template texts. If more than half of a
    page's content is template, the page is a copy and keeps all of it. Repeated rows give repeated rows; other columns aren't
    read, whatever they are called. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("__of"))
    templates = template_keys(rows, induce_wrappers(pages, url_col, html_col, references))

    def run(batches):
        known = _Known()
        for batch in batches:
            hosts = batch.column(3).to_pylist()
            text = [page_text(batch.column(2)[i].as_py(), *known.get(h, batch.column(4)[i], batch.column(5)[i], batch.column(6)[i])) for i, h in enumerate(hosts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    given = _with_wrappers(rows, templates, "left").select("page_id", "url", "html", "__of", "wrapper", "template", "amounts")
    return given.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))
