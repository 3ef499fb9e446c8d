"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a DOM tree; like siblings are folded into one node. The pages of a host are told apart by layout
(the set of their block elements with classes; rare layouts of a host are one), and the first page of each (least
page_id) is its pattern: every other page is aligned with it by simple tree matching (the largest mapping that keeps
order and parents). A node's text that most aligned pages repeat is template. The other nodes are slots, and what
they hold on all pages tells what they are for: from the root down, the main part goes to the slot with most of the
varying text that is no link, as long as there is one; block elements beside that way, and slots that are mostly
links, are template as well. Nodes that the pattern lacks carry content. Pages whose content (before induction) is the
pattern's are copies of it and say nothing about the template; with fewer than EVIDENCE other pages nothing does.

Roles (by tag, role, class or id) break ties: a menu, notice, advert, form or comment part inside the main part goes
though it varies as articles do, and no comment part is taken for the main part while there is another. An element
that is marked as an article or main part stays, and if such elements hold most of the text only they are content.
Where nothing would be left, roles of elements that hold most of the page's text don't count. Script, style, form
controls and the like are no text at all.

Character references are decoded, white space inside a block becomes one space, blocks are joined by \\n in page
order; br is white space. Null or empty html gives an empty text. A null or unreadable url counts as one host.
Repeated rows give repeated rows; of pages with equal least page_id the least html is the pattern. Nothing is cut,
whatever length or depth a page has. An empty table gives an empty one. Other columns of pages are left out.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batches, stage

#: Share of aligned pages that repeat a constant text; aligned pages needed.
CONSTANT, EVIDENCE = 0.6, 5
#: Share of the text that makes a slot the main part, share below which a block beside paragraphs is none of them, share of links that makes a menu.
MAIN_SHARE, SIDE_SHARE, LINK_SHARE = 0.5, 0.2, 0.6
#: Bytes of patterns up to which they are sent to all tasks, and layouts of hosts; beyond, they are joined by site.
SENT_BYTES, SENT_SITES = 8 << 20, 100_000
SALTS = 16

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table td th tr ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article main section div nav aside header footer form select blockquote".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption address td th tr tbody thead tfoot dl hr br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LAYOUT = "div section nav aside header footer main article form"
# Elements that hold no text of the page.
NO_TEXT = frozenset("head script style noscript template iframe svg canvas object embed button select textarea input title xmp noembed noframes audio video math".split())
# Roles that break ties.
DROP_TAGS = frozenset("nav footer aside form dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored sponsors promo promotion sidebar aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion pagination pager toolbar copyright disclaimer".split()
)
HEADER_TAGS, HEADER_WORDS = frozenset({"header"}), frozenset({"header", "topbar"})
MAIN_TAGS = frozenset({"article", "main"})
MAIN_WORDS = frozenset("article content main post entry story".split())
_BESIDE = re.compile(r"(?<![a-z])(?:with|without|has|no)(?![a-z]).*")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("kids", "label", "role", "tag")

    def __init__(self, tag: str, label: str, role: str):
        self.tag, self.label, self.role, self.kids = tag, label, role, []


def _of_name(token: str) -> str:
    """What a class or id says: its last word of a known meaning, before with and the like."""
    for word in reversed(_NAME.findall(_BESIDE.sub("", token))):
        for kind, words in (("drop", DROP_WORDS), ("header", HEADER_WORDS), ("keep", MAIN_WORDS)):
            if word in words:
                return kind
    return ""


def _kind(tag: str, attributes: str) -> tuple[str, str]:
    """Label for matching, and role: none (no text), drop, header, main or nothing."""
    if tag in NO_TEXT:
        return tag, "none"
    role, label, said = "", tag, set()
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                said.update(map(_of_name, value.lower().split()))
                if name == "class" and value.strip():
                    label = f"{tag}.{value.split()[0]}"
            elif name == "role":
                if value.lower() in DROP_ROLES:
                    role = "drop"
                elif value.lower() in ("main", "article"):
                    role = "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return label, "none"
    if tag in DROP_TAGS:
        return label, "drop"
    if role:
        return label, role
    if tag in MAIN_TAGS:
        return label, "drop" if "drop" in said and "keep" not in said else "main"
    if "keep" not in said and tag not in ("html", "body"):
        if "drop" in said:
            return label, "drop"
        if "header" in said:
            return label, "header"
    return label, "header" if tag in HEADER_TAGS else ""


def parse(page: str) -> Node:
    """A tree of the page: children are nodes and strings (decoded text)."""
    root = Node("#root", "#root", "")
    stack, at = [root], 0
    # open elements of each tag: what is not open is not searched for
    opened: Counter[str] = Counter()

    def cut(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].kids.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        close, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            close, tag, attributes = m[4], m[5], m[6]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if close:
            for k in () if not opened[tag] else range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    cut(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SAME_LEVEL and any(opened[t] for t in SAME_LEVEL[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME_LEVEL[tag]:
                    cut(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        node = Node(tag, *_kind(tag, attributes))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I).search(page, at)
            inside = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            node.kids.append(inside)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1


def _own_texts(node: Node) -> list[str]:
    return [t for t in (" ".join(k.split()) for k in node.kids if isinstance(k, str)) if t]


def _hash(text: str) -> int:
    """The length of a text can be read from its hash."""
    return crc32(text.encode("utf-8", "surrogatepass")) * 65_537 + len(text) % 65_537


class Fold:
    """Like siblings as one: their label, the folded children of all, their own texts."""

    __slots__ = ("kids", "label", "nodes", "number", "size", "texts")

    def __init__(self, nodes: list[Node]):
        self.label, self.nodes, self.number, self.kids, self.size = nodes[0].label, nodes, -1, [], 1
        self.texts = [_hash(t) for n in nodes for t in _own_texts(n)]


def folded(page: Node) -> Fold:
    root = Fold([page])
    every = [root]
    for f in every:
        by: dict[str, list[Node]] = {}
        for n in f.nodes:
            for k in n.kids:
                if isinstance(k, Node) and k.role != "none" and k.tag not in VOID and (k.kids or k.tag not in INLINE):
                    by.setdefault(k.label, []).append(k)
        f.kids = [Fold(nodes) for nodes in by.values()]
        every += f.kids
    for f in reversed(every):
        f.size += sum(k.size for k in f.kids)
    return root


def to_json(fold: Fold, content: int | None = None) -> str:
    """The nodes in page order, each with its parent's number, and the hash of the page's content."""
    out, todo = [], [(fold, -1)]
    while todo:
        f, parent = todo.pop()
        out.append([parent, f.label, f.nodes[0].role, sorted(set(f.texts))])
        todo += [(k, len(out) - 1) for k in reversed(f.kids)]
    return json.dumps([content, out], separators=(",", ":"))


class Pattern:
    """A node of a site's pattern tree. Nodes are numbered in page order; the root holds all of them and the hash of the page's content."""

    __slots__ = ("content", "every", "kids", "label", "number", "role", "size", "texts")

    def __init__(self, number: int, label: str, role: str, texts: list[int]):
        self.number, self.label, self.role, self.texts = number, label, role, frozenset(texts)
        self.kids, self.size, self.content, self.every = [], 1, None, None

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]


@lru_cache(maxsize=256)
def pattern(text: str) -> Pattern:
    content, plain = json.loads(text)
    every = [Pattern(i, label, role, texts) for i, (_, label, role, texts) in enumerate(plain)]
    for node, (parent, *_) in zip(every[1:], plain[1:], strict=True):
        every[parent].kids.append(node)
    for node, (parent, *_) in zip(every[:0:-1], plain[:0:-1], strict=True):
        every[parent].size += node.size
    every[0].content, every[0].every = content, every
    return every[0]


def _heaviest(pairs: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """Of (position, weight): weight and indices of the heaviest subsequence with rising positions. Weights are above 0."""
    if all(a[0] < b[0] for a, b in zip(pairs, pairs[1:], strict=False)):
        return sum(w for _, w in pairs), list(range(len(pairs)))
    rank = {p: i + 1 for i, p in enumerate(sorted({p for p, _ in pairs}))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(rank) + 1)  # a tree of prefix maxima
    before = [-1] * len(pairs)
    last = (0, -1)
    for i, (p, w) in enumerate(pairs):
        k, most = rank[p] - 1, (0, -1)
        while k:
            most = max(most, best[k])
            k -= k & -k
        before[i], own = most[1], (most[0] + w, i)
        last = max(last, own)
        k = rank[p]
        while k < len(best):
            best[k] = max(best[k], own)
            k += k & -k
    chosen, i = [], last[1]
    while i >= 0:
        chosen.append(i)
        i = before[i]
    return last[0], chosen[::-1]


def align(a: Fold, b: Pattern) -> int:
    """Simple tree matching of trees with like roots: numbers each matched node of a by its partner in b; size of the mapping."""
    if a.label != b.label:
        return 0
    pairs: list[tuple[Fold, Pattern, list[int]]] = [(a, b, [])]
    for x, y, under in pairs:
        at = {k.label: j for j, k in enumerate(y.kids)}
        for k in x.kids:
            if k.label in at:
                under.append(len(pairs))
                pairs.append((k, y.kids[at[k.label]], []))
    weight = [0] * len(pairs)
    taken: list[list[int]] = [[]] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        under = pairs[i][2]
        total, chosen = _heaviest([(pairs[k][1].number, weight[k]) for k in under])
        weight[i], taken[i] = total + 1, [under[k] for k in chosen]
    todo = [0]
    while todo:
        i = todo.pop()
        pairs[i][0].number = pairs[i][1].number
        todo += taken[i]
    return weight[0]


#: Kinds of counts beside the hashes of texts: characters of text, and of it in links.
CHARS, LINKED = -1, -2


def observe(fold: Fold, like: Pattern) -> Iterator[tuple[int, int, int]]:
    """(node, text, n) of a page aligned with like: texts that like has at the node, too, and the characters that the node and what like lacks below it hold."""
    todo = [(fold, 0, False)]
    while todo:
        f, number, linked = todo.pop()
        if f.number >= 0:
            number = f.number
            for h in set(f.texts) & like.every[number].texts:
                yield number, h, 1
        linked = linked or f.nodes[0].tag == "a"
        n = sum(h % 65_537 for h in f.texts)
        if n:
            yield number, CHARS, n
            if linked:
                yield number, LINKED, n
        todo += [(k, number, linked) for k in f.kids]


def slots(like: Pattern, chars: dict[int, int], linked: dict[int, int]) -> tuple[frozenset[int], frozenset[int]]:
    """Numbers of the nodes beside the main part, and of those on the way to it. chars: of varying text."""
    every = like.every
    total, links = ([by.get(n.number, 0) for n in every] for by in (chars, linked))
    flow, heads = list(total), [0] * len(every)  # text of a node and its inline parts; text in headings
    marked = [n.role == "main" for n in every]
    parent = [-1] * len(every)
    for n in reversed(every):
        i = n.number
        for k in n.kids:
            j = k.number
            parent[j] = i
            total[i] += total[j]
            links[i] += links[j]
            heads[i] += heads[j]
            marked[i] |= marked[j]
            flow[i] += flow[j] if k.tag in INLINE else 0
        if n.tag in HEADINGS:
            heads[i] = total[i]
    text = [max(0, t - x) for t, x in zip(total, links, strict=True)]
    inside = [False] * len(every)
    for n in every:
        inside[n.number] = n.role == "main" or parent[n.number] >= 0 and inside[parent[n.number]]

    def blocks(n: Pattern) -> list[Pattern]:
        return [k for k in n.kids if k.tag not in PARAGRAPHS and k.tag not in INLINE]

    at, way = like, [0]
    while some := blocks(at):
        fair = [k for k in some if k.role != "drop"]
        if sum(text[k.number] for k in fair) < SIDE_SHARE * text[at.number]:
            fair = some
        whole = text[at.number] - sum(text[k.number] for k in some) + sum(text[k.number] for k in fair)
        best = max(fair, key=lambda k: (text[k.number], -k.number))
        if not text[best.number] or text[best.number] < MAIN_SHARE * whole:
            break
        at = best
        way.append(at.number)
        if flow[at.number] >= MAIN_SHARE * text[at.number]:
            break
    beside, on = set(), set(way)
    for i in way:
        for k in blocks(every[i]):
            j = k.number
            if j in on or marked[j] or inside[j]:
                continue
            menu = links[j] >= LINK_SHARE * max(1, total[j])
            small = text[j] < SIDE_SHARE * max(1, text[i])
            headline = 2 * heads[j] >= text[j] > 0 and k.role not in ("drop", "header")
            if menu or small and not headline and (i != at.number or every[i].tag in ("html", "body", "#root")):
                beside.add(j)
    return frozenset(beside), frozenset(on)


def content_hash(page: Node) -> int | None:
    """Of the content without induction: what a copy of the page shares. A page without content has no copies."""
    text = extract(page)
    return _hash(text) if text else None


class Wrapper:
    """What the pages of a site share: the pattern, constant texts by node, nodes beside the main part and on the way to it."""

    __slots__ = ("beside", "constant", "like", "way")

    def __init__(self, like: Pattern, constant: dict[int, set[int]], chars: dict[int, int], linked: dict[int, int]):
        self.like, self.constant = like, constant
        self.beside, self.way = slots(like, chars, linked) if chars else (frozenset(), frozenset())


def _text_sizes(page: Node, passed: set[int]) -> dict[int, int]:
    """Characters of text in each node, by its id."""
    every, sizes = [page], {}
    for n in every:
        every += [k for k in n.kids if isinstance(k, Node) and k.role != "none" and id(k) not in passed]
    for n in reversed(every):
        sizes[id(n)] = sum(len(k) - k.count(" ") if isinstance(k, str) else sizes.get(id(k), 0) for k in n.kids)
    return sizes


def extract(page: Node, wrapper: Wrapper | None = None) -> str:
    """The page's content; with a wrapper, by what it knows of the page's nodes."""
    template: set[tuple[int, int]] = set()
    beside: set[int] = set()
    spared: set[int] = set()
    if wrapper is not None:
        fold = folded(page)
        align(fold, wrapper.like)
        todo_folds = [fold]
        while todo_folds:
            f = todo_folds.pop()
            if f.number in wrapper.beside:
                beside.update(map(id, f.nodes))
                continue
            if f.number in wrapper.way:
                spared.update(map(id, f.nodes))
            if hashes := wrapper.constant.get(f.number):
                template.update((id(n), h) for n in f.nodes for h in hashes)
            todo_folds += f.kids
    text = _content(page, template, beside, spared)
    if not text:
        # roles of what holds most of the page say nothing about it
        sizes, todo = _text_sizes(page, beside), [page]
        for n in todo:
            for k in n.kids:
                if isinstance(k, Node) and 2 * sizes.get(id(k), 0) > sizes[id(page)]:
                    if k.tag not in ("nav", "footer", "menu"):
                        spared.add(id(k))
                    todo.append(k)
        text = _content(page, template, beside, spared)
    return text


def _content(page: Node, template: set[tuple[int, int]], beside: set[int], spared: set[int]) -> str:
    def dropped(k: Node) -> bool:
        return k.role == "none" or id(k) in beside or k.role == "drop" and id(k) not in spared

    mains: list[Node] = []
    outside = 0
    # explicit stacks: pages may be nested to any depth
    todo: list = page.kids[::-1]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            outside += len(k) - k.count(" ")
        elif not dropped(k):
            if k.role == "main":
                mains.append(k)
            else:
                todo.extend(k.kids[::-1])
    if mains and outside:
        sizes = _text_sizes(page, beside)
        if sum(sizes[id(m)] for m in mains) < MAIN_SHARE * outside:
            mains = []
    blocks: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = [0]

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((text, linked[0]))
        parts.clear()
        linked[0] = 0

    def walk(top: Node, in_main: bool) -> None:
        open_nodes = [(top, iter(top.kids), False)]
        while open_nodes:
            n, kids, in_link = open_nodes[-1]
            for k in kids:
                if isinstance(k, str):
                    if template and (id(n), _hash(" ".join(k.split()))) in template:
                        parts.append(" ")
                        continue
                    parts.append(k)
                    if in_link:
                        linked[0] += len(k)
                elif dropped(k) or k.role == "header" and not in_main and id(k) not in spared:
                    if k.tag not in INLINE:
                        close()
                else:
                    if k.tag == "br":
                        parts.append(" ")
                    elif k.tag not in INLINE:
                        close()
                    open_nodes.append((k, iter(k.kids), in_link or k.tag == "a"))
                    break
            else:
                open_nodes.pop()
                if n.tag not in INLINE:
                    close()

    for m in mains or [page]:
        close()
        walk(m, bool(mains))
    close()
    return "\n".join(t for t, links in blocks if mains or links < LINK_SHARE * len(t))


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def sited(pages: DataFrame) -> DataFrame:
    """page_id, url, html and site: the host, and the layout if EVIDENCE other pages of the host have it."""
    opened = F.regexp_extract_all("html", F.lit(f"(?i)<(?:{LAYOUT.replace(' ', '|')})(?=[\\s/>])[^>]*"), F.lit(0))
    named = F.transform(opened, lambda x: F.concat(F.lower(F.regexp_extract(x, r"<([A-Za-z]+)", 1)), F.lit("."), F.regexp_extract(x, r"(?i)\bclass\s*=\s*[\"']?([^\s\"'>]+)", 1)))
    rows = pages.select("page_id", "url", "html", host_of().alias("host"), F.coalesce(F.xxhash64(F.array_sort(F.array_distinct(named))), F.lit(0)).alias("layout"))
    common = stage(rows.where("length(html) > 0").groupBy("host", "layout").agg(F.count("*").alias("n")).where(F.col("n") > EVIDENCE).select("host", "layout", F.lit(True).alias("own")), "layouts")
    if common.count() <= SENT_SITES:
        told = rows.join(F.broadcast(common), ["host", "layout"], "left")
    else:
        told = _salted(rows, common, ["host", "layout"])
    return told.select("page_id", "url", "html", F.concat_ws(" ", "host", F.when(F.col("own"), F.hex("layout"))).alias("site"))


def _salted(pages: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    parts = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.expr(f"cast(pmod(xxhash64(page_id, html), {SALTS}) as int)")).join(parts, [*keys, "salt"], "left").drop("salt")


def _attach(pages: DataFrame, small: DataFrame, column: str):
    """(pages with the site's value in column or None, dict of the values or None): sent if of proven size, else joined on a salted site."""
    n = small.agg(F.coalesce(F.sum(F.length(column) + F.length("site")), F.lit(0))).first()[0]
    if n <= SENT_BYTES:
        return pages.withColumn(column, F.lit(None).cast("string")), {r["site"]: r[column] for r in small.collect()}
    return _salted(pages, small, ["site"]), None


def induce(pages: DataFrame) -> DataFrame:
    """site, wrapper (JSON: pattern tree, counts by node) of each site of pages (page_id, site, html)."""
    some = pages.where("length(html) > 0")
    first = stage(some.groupBy("site").agg(F.min("page_id").alias("page_id")), "first")
    seeds = some.join(F.broadcast(first) if first.count() <= SENT_SITES else first, ["site", "page_id"]).groupBy("site").agg(F.min("html").alias("html"))

    def patterns(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches(rows):
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in batch], pa.string()), pa.array([to_json(folded(p), content_hash(p)) for p in (parse(t) for _, t in batch)], pa.string())], ["site", "pattern"])

    patterned = stage(seeds.mapInArrow(patterns, "site string, pattern string"), "patterns")
    given, sent = _attach(some.select("page_id", "site", "html"), patterned, "pattern")

    def compare(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches(rows, text=2):
            counts: Counter[tuple[str, int, int]] = Counter()
            for _, site, text, own in batch:
                like = sent.get(site) if sent is not None else own
                if like is None:
                    continue
                like = pattern(like)
                page = parse(text)
                if like.content is not None and content_hash(page) == like.content:
                    continue
                fold = folded(page)
                align(fold, like)
                counts[site, -1, 0] += 1
                for node, what, n in observe(fold, like):
                    counts[site, node, what] += n
            if counts:
                out = [(*k, n) for k, n in counts.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["site", "node", "text", "n"])

    counted = given.select("page_id", "site", "html", "pattern").mapInArrow(compare, "site string, node int, text long, n long").groupBy("site", "node", "text").agg(F.sum("n").alias("n"))
    counted = stage(counted, "counts")
    pages_of = counted.where("node = -1").where(F.col("n") >= EVIDENCE).select("site", F.col("n").alias("pages"))
    kept = counted.where("node >= 0").join(pages_of, "site").where((F.col("text") < 0) | (F.col("n") >= CONSTANT * F.col("pages")))
    told = kept.groupBy("site").agg(F.sort_array(F.collect_list(F.array(F.col("node").cast("long"), "text", "n"))).alias("counts"))
    return stage(patterned.join(told, "site").select("site", F.to_json(F.struct("pattern", "counts")).alias("wrapper")), "wrappers")


@lru_cache(maxsize=256)
def _wrapper(text: str) -> Wrapper:
    plain = json.loads(text)
    constant: dict[int, set[int]] = {}
    sums: dict[int, Counter[int]] = {CHARS: Counter(), LINKED: Counter()}
    repeated: Counter[int] = Counter()
    for node, what, n in plain["counts"]:
        if what < 0:
            sums[what][node] = n
        else:
            constant.setdefault(node, set()).add(what)
            repeated[node] += n * (what % 65_537)
    # a node's constant texts are no varying text, nor links
    chars = {k: max(0, n - repeated[k]) for k, n in sums[CHARS].items()}
    return Wrapper(pattern(plain["pattern"]), constant, chars, {k: max(0, n - repeated[k]) for k, n in sums[LINKED].items()})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    placed = sited(pages)
    given, sent = _attach(placed, induce(placed), "wrapper")

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches(rows, text=3):
            out = []
            for page_id, url, site, text, own in batch:
                own = sent.get(site) if sent is not None else own
                result = extract(parse(text), _wrapper(own) if own is not None else None) if text else ""
                out.append((page_id, url, result, len(result)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

    return given.select(F.col("page_id").cast("long"), "url", "site", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
