"""Main text of web pages by wrapper induction.

Every layout of a host has a reference page, its smallest id; a layout is told by the
upper containers of a page. Layouts with too few different pages for a vote go by the
reference of the host's most common layout. The DOM trees of the other pages are
aligned with the reference tree by simple tree matching: nodes match if their labels and their
ancestors do, and sibling lists are aligned by dynamic programming for the largest
number of matched nodes (runs of equally labelled siblings count as one node, so a
list of any length is one slot). Each page votes for every matched node that has
text: is the text the reference's, or not? Nodes that stay constant become template,
on the reference page as on all others, varying ones content. Copies of the reference
page don't vote, as they would make an article look constant.

A page's text is that of its article element, or else its main element, or else its
whole body, without the template, without parts whose tag, role or class says that
they are navigation, header, footer, sidebar, notice, advert, form or reader
comments, and, outside an article, without blocks that are mostly links. Within an
article a class or id drops a part only if it has no other words than those of an
advert, a menu with links, a notice or comments (``ARTICLE_WORDS``, ``PLAIN_WORDS``), and
never an inline element. Outside an article, other words keep a part whose word may name
a subject (``SUBJECT_WORDS``); a page that has no text but such parts or linked paragraphs
has these.

Elements may be nested to any depth: below ``DEEP`` levels their text and what is
dropped stay as they are, only the tree that is aligned has them side by side.

Votes are summed by host, layout and node before they are shuffled; references are sent to
the tasks if they have at most ``SEND_BYTES``, else joined. So a host with a third
of all pages needs no task of its own.

Defined results: null or empty html has the empty text; a page without a host forms
a host with the others without; null page ids stay null; repeated rows give repeated
results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ship_code, staged

#: Share of voting pages in which a template node has the reference's text, and the votes it needs.
CONSTANT_SHARE, LEAST_VOTES = 0.9, 3
#: Bytes of references that are sent to every task, at most.
SEND_BYTES = 32 << 20
#: Share of a block's characters in links from which it is a menu, outside articles.
LINK_SHARE = 0.6
#: Levels of elements that the tree has.
DEEP = 200

# Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml textarea title audio video canvas noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mpadded mphantom semantics".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("article aside body div footer header html main nav section table td th ul ol dl form blockquote".split())
DROPPED = frozenset("head nav footer aside form button select option input dialog menu legend fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status note".split())
# Words of a class or id that name a part which is not the article.
DROPPED_WORDS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner banners
nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager header masthead topbar footer colophon copyright
sidebar sidebars aside rail widget widgets related recommended recommendations popular trending
notice notices notification notifications alert alerts cookie cookies consent gdpr popup modal overlay disclaimer
newsletter subscribe subscription signup login search share sharing social
comment comments commentlist respond reply replies discussion disqus feedback
skip hidden toolbar tooltip
""".split())
# Words of a class or id that name such a part even within an article, if it has no others.
ARTICLE_WORDS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners
nav navbar navigation menu submenu breadcrumb breadcrumbs pagination sidebar sidebars
notice notices notification notifications cookie cookies consent gdpr popup overlay newsletter subscribe subscription signup
comment comments commentlist disqus share sharing social
""".split())
# Words beside them that say nothing of what a part holds.
PLAIN_WORDS = frozenset("area bar block box button buttons container content form group holder icons inner item items link links list outer panel section slot top bottom left right unit wrap wrapper".split())
# Words of a menu, which has links; without any it may be one of dishes.
MENU_WORDS = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs pagination".split())
# Words beside them that say nothing outside articles.
SITE_WORDS = frozenset("also articles body entries entry global latest like main message messages more news page post posts site stories tags text title topics user users you".split())
# Of these, words that also name a page's layout (a class "with-sidebar"
# may hold everything), and words by which an article element is none.
LAYOUT_WORDS = frozenset("sidebar sidebars rail nav navbar navigation menu header masthead topbar footer banner ad ads cookie cookies widget widgets".split())
NO_ARTICLE_WORDS = frozenset("comment comments reply replies related recommended recommendations promo promoted sponsored ad advert advertisement widget popular teaser".split())
# Elements that make a page's layout, and how many levels of them count.
LAYOUT_TAGS, LAYOUT_LEVELS = frozenset("div section article main header table center".split()), 2
ARTICLE_OR_PLAIN = ARTICLE_WORDS | PLAIN_WORDS
# Words of ``DROPPED_WORDS`` that may as well name a subject: other words beside them keep a part.
SUBJECT_WORDS = DROPPED_WORDS - ARTICLE_WORDS - LAYOUT_WORDS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_CACHE: dict[str, "Node"] = {}
NONE: frozenset[str] = frozenset()


class Node:
    """An element: label, what it is for the text (``soft``: by a word of the layout, ``named``: by these words only), children (elements and strings)."""

    __slots__ = ("tag", "label", "part", "soft", "named", "children")

    def __init__(self, tag: str, label: str = "", part: str = "", soft: bool = False):
        self.tag, self.label, self.part, self.soft, self.children = tag, label or tag, part, soft, []
        self.named = NONE


def _open(tag: str, attributes: str, in_article: bool) -> Node:
    """The node of a start tag; ``part`` says that it is dropped, or a main part."""
    part = "drop" if tag in DROPPED else tag if tag in ("article", "main", "header") else ""
    label, soft, by_words, lasting = tag, part != "drop", NONE, part == "drop"
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                label += f"{'.' if name == 'class' else '#'}{re.sub('[0-9]+', '', value)}"
                words = {w.lower() for w in _WORDS.findall(value)}
                if in_article and tag != "article":
                    named = words & ARTICLE_WORDS if words <= ARTICLE_OR_PLAIN and tag not in INLINE else frozenset()
                else:
                    named = words & (NO_ARTICLE_WORDS if tag == "article" else DROPPED_WORDS)
                    if named and tag != "article" and named <= SUBJECT_WORDS and words - DROPPED_WORDS - PLAIN_WORDS - SITE_WORDS:
                        named = NONE
                if named and tag not in ("html", "body", "main"):
                    part, soft = "drop", soft and not in_article and named <= LAYOUT_WORDS and tag != "article"
                    by_words = by_words | named
            elif name == "role":
                role = value.lower()
                lasting = lasting or role in DROPPED_ROLES
                part, soft = ("drop", False) if role in DROPPED_ROLES else (role if role in ("main", "article") and part != "drop" else part, soft)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                part, soft, lasting = "drop", False, True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                part, soft, lasting = "drop", False, True
    node = Node(tag, label, part, soft)
    if part == "drop" and not lasting and tag != "article":
        node.named = by_words
    return node


def parse(text: str) -> Node:
    """The DOM tree of a page, as forgiving as browsers are about missing end tags."""
    root = Node("#root")
    # The open elements, where each one's children go, and how many open ones are main parts, by kind.
    stack, holders, at, n = [root], [root], 0, len(text)
    articles, opened = 0, Counter()

    def close(i: int) -> None:
        nonlocal articles
        for node, holder in zip(stack[i:], holders[i:], strict=True):
            if node.part and node.part != "drop":  # what becomes a plain part later was never counted
                articles -= node.part != "header"
                opened[node.part] -= 1
            if holder is not node and node.tag not in INLINE:  # an end that stands for the flattened element's
                holder.children.append(Node(node.tag))
        del stack[i:], holders[i:]

    while at < n:
        m = _TOKEN.search(text, at)
        start = m.start() if m else n
        if start > at:
            piece = text[at:start]
            holders[-1].children.append(entities.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag = name.lower()
        if m.group(1) or m.group(4):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag in SCOPE:
                    break
            continue
        attributes = m.group(3) if m.group(2) else m.group(6)
        if tag in RAW and not (tag == "noscript" and articles):
            if not (attributes or "").endswith("/"):
                end = _RAW_END[tag].search(text, at)
                at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
        if tag in IMPLIED:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in IMPLIED[tag]:
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select") or (stack[i].tag in SCOPE and stack[i].tag not in ("td", "th")):
                    break
        node = _open(tag, attributes or "", articles > 0)
        holder = holders[-1]
        holder.children.append(node)
        if node.part in ("article", "main"):
            for above in stack:  # what holds an article is no sidebar, whatever its layout is called
                if above.soft and above.part == "drop":
                    above.part = ""
        if tag not in VOID:
            stack.append(node)
            articles += node.part in ("article", "main")
            # Far down, only what is dropped, a heading, or the first main part of its kind, holds its own children.
            if len(stack) > DEEP:
                plain = not node.part and (tag not in HEADINGS or holder.tag in HEADINGS)
                known = holder.part == "drop" or (node.part != "drop" and opened[node.part])
                holders.append(holder if plain or known else node)
            else:
                holders.append(node)
            if node.part and node.part != "drop":
                opened[node.part] += 1
    return root


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """The child elements that may hold content, runs of equal labels as one."""
    out: list[tuple[str, list[Node]]] = []
    for child in node.children:
        if isinstance(child, Node) and child.part != "drop" and child.tag not in INLINE and child.tag not in VOID:
            if out and out[-1][0] == child.label:
                out[-1][1].append(child)
            else:
                out.append((child.label, [child]))
    return out


class Slot:
    """A node of the folded tree: a run of equally labelled siblings and what lies below them."""

    __slots__ = ("label", "members", "children", "number", "text")

    def __init__(self, label: str, members: list[Node]):
        self.label, self.members, self.number, self.text = label, members, -1, None
        if len(members) == 1:
            self.children = [Slot(key, nodes) for key, nodes in runs(members[0])]
            return
        merged: list[tuple[str, list[Node]]] = []
        places: Counter = Counter()
        index: dict[tuple[str, int], int] = {}
        for member in members:
            places.clear()
            for key, nodes in runs(member):
                place = (key, places[key])
                places[key] += 1
                if place in index:
                    merged[index[place]][1].extend(nodes)
                else:
                    index[place] = len(merged)
                    merged.append((key, list(nodes)))
        self.children = [Slot(key, nodes) for key, nodes in merged]

    def own_text(self) -> str:
        """The text that no slot below holds."""
        if self.text is not None:
            return self.text
        parts: list[str] = []

        def add(node: Node) -> None:
            for child in node.children:
                if isinstance(child, str):
                    parts.append(child)
                elif child.tag in INLINE:
                    add(child)

        for member in self.members:
            add(member)
        self.text = " ".join("".join(parts).split())
        return self.text

    def first_word(self) -> str:
        """Where the text begins: quick to tell most texts apart."""
        for member in self.members:
            for child in member.children:
                while isinstance(child, Node) and child.tag in INLINE and child.children:
                    child = child.children[0]
                if isinstance(child, str) and (words := child.split(None, 1)):
                    return words[0]
        return ""

    def starts(self) -> list[str]:
        """The first words of the first slots: different in most pages."""
        out, waiting = [], [self]
        while waiting and len(out) < 12:
            slot = waiting.pop()
            out.append(slot.first_word())
            waiting.extend(reversed(slot.children))
        return out

    def same(self, other: Slot) -> bool:
        return self.first_word() == other.first_word() and self.own_text() == other.own_text()


def number(slot: Slot, first: int = 0) -> int:
    slot.number = first
    first += 1
    for child in slot.children:
        first = number(child, first)
    return first


def align(a: Slot, b: Slot, out: list[tuple[Slot, Slot]]) -> int:
    """Simple tree matching of two slots with equal labels: the matched pairs, and how many."""
    found, pairs = _match(a, b)
    out.extend(pairs)
    return found


def _match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    left, right = a.children, b.children
    pairs: list[tuple[Slot, Slot]] = [(a, b)]
    total = 1
    # Children at the ends that match in whole are matched in some best alignment: only what lies between needs the table.
    low, end = 0, 0
    while low < len(left) and low < len(right):
        found = _whole(left[low], right[low])
        if found is None:
            break
        total += len(found)
        pairs += found
        low += 1
    while end < len(left) - low and end < len(right) - low:
        found = _whole(left[-1 - end], right[-1 - end])
        if found is None:
            break
        total += len(found)
        pairs += found
        end += 1
    left, right = left[low : len(left) - end], right[low : len(right) - end]
    if left and right:
        own: dict[tuple[int, int], tuple[int, list]] = {}
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, x in enumerate(left, 1):
            above, row = table[i - 1], table[i]
            for j, y in enumerate(right, 1):
                best = above[j] if above[j] > row[j - 1] else row[j - 1]
                if x.label == y.label:
                    own[i, j] = _match(x, y)
                    best = max(best, above[j - 1] + own[i, j][0])
                row[j] = best
        i, j = len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                total += own[i, j][0]
                pairs += own[i, j][1]
                i, j = i - 1, j - 1
    return total, pairs


def _whole(a: Slot, b: Slot) -> list[tuple[Slot, Slot]] | None:
    """The pairs of two trees that match node by node; None if they don't."""
    if a.label != b.label or len(a.children) != len(b.children):
        return None
    pairs = [(a, b)]
    for x, y in zip(a.children, b.children, strict=True):
        found = _whole(x, y)
        if found is None:
            return None
        pairs += found
    return pairs


def folded(text: str) -> Slot:
    root = Slot("#root", [parse(text)])
    number(root)
    return root


def layout(text: str | None) -> int:
    """A hash of the paths of a page's upper containers; a lone one that holds all others is no level."""
    paths: set[str] = set()

    def walk(nodes: list[Node], path: str, level: int) -> None:
        below: dict[str, list[Node]] = {}
        for node in nodes:
            for key, own in runs(node):
                if own[0].tag in LAYOUT_TAGS or own[0].tag in ("html", "body"):
                    below.setdefault(key, []).extend(own)
        lone = len(below) == 1 and all(len(own) == 1 for own in below.values())
        for key, own in below.items():
            paths.add(f"{path}/{key}")
            if lone or level < LAYOUT_LEVELS:
                walk(own, f"{path}/{key}", level + (not lone))

    walk([parse(text or "")], "", 1)
    return int.from_bytes(hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def reference(text: str) -> tuple[Slot, str]:
    """A reference's folded tree and whole text, kept for the pages to come."""
    if text not in _CACHE:
        if len(_CACHE) >= 64:
            _CACHE.clear()
        tree = folded(text)
        _CACHE[text] = (tree, all_text(tree))
    return _CACHE[text]


def all_text(tree: Slot) -> str:
    return " ".join(filter(None, [tree.own_text(), *(all_text(c) for c in tree.children)]))


def votes(page: str, text: str) -> list[tuple[int, bool]]:
    """For each node of the reference that the page matches and that has text: is it the same?"""
    own, whole = reference(text)
    tree = folded(page)
    if tree.starts() == own.starts() and all_text(tree) == whole:
        return []
    pairs: list[tuple[Slot, Slot]] = []
    align(tree, own, pairs)
    return [(theirs.number, mine.same(theirs)) for mine, theirs in pairs if theirs.own_text()]


def extract(page: str | None, text: str | None = None, constant: frozenset[int] = frozenset()) -> str:
    """The main text of a page, given its host's reference and template nodes."""
    if not page:
        return ""
    root = parse(page)
    template: set[int] = set()
    if text and constant:
        pairs: list[tuple[Slot, Slot]] = []
        align(Slot("#root", [root]), reference(text)[0], pairs)
        template = {id(m) for mine, theirs in pairs if theirs.number in constant and mine.same(theirs) for m in mine.members}
    for wanted in ("article", "main", ""):
        regions = _regions(root, wanted) if wanted else [root]
        if regions:
            blocks: list[str] = []
            for region in regions:
                _blocks(region, template, blocks, whole_page=not wanted)
            if blocks or not wanted:
                if blocks or _regions(root, "article") or _regions(root, "main"):
                    return " ".join(blocks)
                # Nothing else is there: a part named by a subject word, or a linked paragraph.
                for linked in (False, True):
                    _blocks(root, template, blocks, whole_page=True, spare=True, linked_paragraphs=linked)
                    if blocks:
                        break
                return " ".join(blocks)
    return ""


def _links(node: Node) -> bool:
    return any(isinstance(c, Node) and (c.tag == "a" or _links(c)) for c in node.children)


def _kept(node: Node, whole_page: bool, spare: bool) -> bool:
    """Whether a part that is dropped by words of its class or id stays after all."""
    if not node.named:
        return False
    if not whole_page and node.named <= MENU_WORDS:
        return not _links(node)
    return spare and node.named <= SUBJECT_WORDS


def _regions(node: Node, part: str) -> list[Node]:
    """The outermost elements that are such a part."""
    found = []
    for child in node.children:
        if isinstance(child, Node) and child.part != "drop":
            found += [child] if child.part == part else _regions(child, part)
    return found


def _blocks(region: Node, template: set[int], out: list[str], whole_page: bool, spare: bool = False, linked_paragraphs: bool = False) -> None:
    """Adds the region's blocks; ``spare`` keeps parts named by subject words, too."""
    parts: list[str] = []
    linked = 0

    def flush(paragraph: bool = False) -> None:
        nonlocal linked
        block = " ".join("".join(parts).split())
        parts.clear()
        if block and not (whole_page and not (paragraph and linked_paragraphs) and linked > LINK_SHARE * len(block)):
            out.append(block)
        linked = 0

    def walk(node: Node, in_link: bool, only_headings: bool, quiet: bool) -> None:
        nonlocal linked
        for child in node.children:
            if isinstance(child, str):
                if not quiet and not only_headings:
                    parts.append(child)
                    if in_link:
                        linked += len(child.strip())
                continue
            if (child.part == "drop" and not _kept(child, whole_page, spare)) or (child.part == "header" and whole_page):
                if child.tag not in INLINE:
                    flush()
                continue
            if child.tag in INLINE:
                walk(child, in_link or child.tag == "a", only_headings, quiet)
                continue
            flush()
            headings = (only_headings or child.part == "header") and child.tag not in HEADINGS
            walk(child, in_link, headings, id(child) in template)
            flush(child.tag == "p")

    walk(region, False, False, id(region) in template)
    flush()


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), _HOST, 1))


def with_layout(pages: DataFrame) -> DataFrame:
    """Adds ``layout`` to pages (``id``, ``url``, ``html``, ``host``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([layout(page) for page in batch.column("html").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "layout"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, layout long")


def chosen(some: DataFrame, plain: DataFrame) -> DataFrame:
    """(``host``, ``layout``, ``own``, ``main``, ``reference``): references of layouts that can vote, and of each host's most common."""
    mark = F.xxhash64("html").alias("mark")
    marks = staged(some.select("host", "layout", "id", mark), "layouts")
    first = F.min(F.struct(F.col("id").isNull(), "id", "mark"))["mark"].alias("mark")
    # Copies of the reference don't vote.
    groups = marks.groupBy("host", "layout").agg(F.count_distinct("mark").alias("n"), first).withColumn("own", F.col("n") > LEAST_VOTES)
    groups = staged(groups, "layout-sizes")
    main = groups.groupBy("host").agg(F.max(F.struct("n", "layout"))["layout"].alias("layout"), F.lit(True).alias("main"))
    picks = groups.join(main, ["host", "layout"], "left").withColumn("main", F.coalesce("main", F.lit(False))).filter("own or main")
    picks = staged(picks.select("host", "layout", "mark", "own", "main"), "layout-picks")
    texts = plain.select("host", mark, "html").join(picks, ["host", "mark"])
    return staged(texts.groupBy("host", "layout", "own", "main").agg(F.min("html").alias("reference")), "references")


def placed(pages: DataFrame, references: DataFrame) -> DataFrame:
    """The pages with ``ref``: the row of ``references`` that they go by."""
    ref = F.struct(*[c for c in references.columns if c not in ("host", "own", "main")])
    own = _sent(references.filter("own")).select("host", "layout", ref.alias("own_ref"))
    main = _sent(references.filter("main")).select("host", ref.alias("main_ref"))
    both = pages.join(own, ["host", "layout"], "left").join(main, "host", "left")
    return both.withColumn("ref", F.coalesce("own_ref", "main_ref")).drop("own_ref", "main_ref")


def wrappers(pages: DataFrame, plain: DataFrame) -> DataFrame:
    """(``host``, ``layout``, ``own``, ``main``, ``reference``, ``constant``) of pages (``id``, ``url``, ``html``, ``host``) with their ``layout``, and without in ``plain``."""
    some = pages.filter("html is not null and html <> ''")
    references = chosen(some, plain)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], list[int]] = {}
        for batch in batches:
            for host, key, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for node, same in votes(page, text):
                    tally = seen.setdefault((host, key, node), [0, 0])
                    tally[0] += 1
                    tally[1] += same
            if len(seen) > 100_000:
                yield _tally(seen)
                seen = {}
        yield _tally(seen)

    sums = placed(some, references).select("host", "ref.layout", "html", "ref.reference").mapInArrow(count, "host string, layout long, node int, n long, same long")
    sums = sums.groupBy("host", "layout", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    constant = sums.filter((F.col("n") >= LEAST_VOTES) & (F.col("same") >= CONSTANT_SHARE * F.col("n")))
    # As many nodes a layout as its reference has.
    constant = constant.groupBy("host", "layout").agg(F.sort_array(F.collect_list("node")).alias("constant"))
    return staged(references.join(constant, ["host", "layout"], "left").select("host", "layout", "own", "main", "reference", "constant"), "wrappers")


def _tally(seen: dict[tuple[str, int, int], list[int]]) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())],
        ["host", "layout", "node", "n", "same"],
    )


def _sent(references: DataFrame) -> DataFrame:
    """The references, to be broadcast if they are small; else joined, a hot host's pages split."""
    size = references.agg(F.sum(F.octet_length("reference"))).first()[0] or 0
    return F.broadcast(references) if size <= SEND_BYTES else references


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url``, ``text`` and ``n_chars`` of every page."""
    ship_code(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of("url"))
    told = with_layout(source)
    joined = placed(told, wrappers(told, source)).select("id", "url", "html", "ref.reference", "ref.constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                texts = [extract(page, text, frozenset(nodes or ())) for page, text, nodes in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = source.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
