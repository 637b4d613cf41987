"""Main text of web pages by wrappers inferred from pages of the same host.

Pages are parsed into trees of tags. A host's wrapper is a union-free regular
expression in tree form, inferred by aligning all different pages of the host,
bounded parts of them first, then what is known of the parts: texts that differ
become slots, tags that one side lacks become optional groups, equal neighbours
become repeated groups. The slots that lie in the article and outside page
furniture are main text.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import json
import operator
import re
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ship
from spanloom.llm.urls import host
from spanloom.session import settle

#: Different pages of a host aligned in one group, and wrappers of such groups aligned in one; so many groups are made that all pages are.
GROUP, GROUPS = 256, 64
#: Different pages that must hold a constant text before it counts as the site's.
CERTAIN = 3
#: A wrapper of more nodes is generalised, so it stays small whatever marks its pages have.
MOST = 4000
#: Constant texts longer than this are told apart by their digest.
LONGEST = 64
DEEPEST = 100
#: HTML's elements without content, its blocks, page furniture by element and by class or id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset(
    "head title nav header footer aside form script style noscript template button select textarea option menu dialog iframe svg canvas "
    "object audio video map".split()
)
MARKED = frozenset(
    "ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs header footer masthead notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments reply replies disqus respond pagination pager widget toolbar".split()
)
#: Words beside a mark that leave it one.
PLACES = frozenset("site page main left right top bottom primary secondary global list section box block bar wrapper container wrap area post google".split())
REGIONS = frozenset(("article", "main"))
#: Furniture that never holds a page's content.
HIDDEN = frozenset("head title script style noscript template button select textarea option iframe svg canvas object audio video map nav footer menu dialog".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)", re.S)
#: Up to the end of a tag; a quoted value may hold >, a quote that isn't closed is any other character.
_ATTRIBUTES = re.compile(r"(?:[^>=]|=(?:\s*(?:\"[^\"]*\"|'[^']*'))?+)*+")
_NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template")}


def marked(name: str) -> bool:
    if name in MARKED:
        return True
    words = set(re.split("[_-]+", name))
    return bool(words & MARKED) and words <= MARKED | PLACES


class Node:
    """An element: key (name and marks), whether it is furniture, and its children, which are nodes or texts.

    A mark counts as a whole class, id or role, or in one made of marks and PLACES alone, so `no-sidebar` is none. <body> is never furniture.
    """

    __slots__ = ("key", "name", "dropped", "children")

    def __init__(self, name: str, marks: str = "") -> None:
        self.key, self.name, self.children = name + marks, name, []
        self.dropped = name in FURNITURE or bool(marks) and name != "body" and any(map(marked, re.split(r"[\s.]+", marks.lower())))


def parse(page: str) -> Node:
    """Tree of a page, however malformed: unknown ends are ignored, missing ones implied by the parent's end, a new block ends a paragraph.

    Takes time in proportion to the page: where quotes swallow all ends of
    tags up to the page's end, they count no more, and a tag without any end
    is text.
    """
    root = Node("html")
    stack, at, quotes = [root], 0, True
    opened: Counter = Counter()

    def leave(depth: int) -> None:
        opened.subtract(n.name for n in stack[depth:])
        del stack[depth:]

    while at < len(page):
        found = _TOKEN.search(page, at)
        end = found.end() if found else 0
        if found and found[2]:
            end = _ATTRIBUTES.match(page, found.end()).end() if quotes else len(page)
            if end == len(page):
                quotes, end = False, page.find(">", found.end())
            if end < 0:
                found = None
        text = page[at : found.start()] if found else page[at:]
        if text:
            stack[-1].children.append(entities.unescape(text))
        if not found:
            break
        name, inner = (found[2] or "").lower(), page[found.end() : end]
        at = end + 1 if name else end
        if not name or name == "html":
            continue
        if found[1]:
            if opened[name] > 0:
                leave(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].name == name))
            continue
        if (name in BLOCKS and stack[-1].name == "p") or (name == "li" and stack[-1].name == "li"):
            leave(len(stack) - 1)
        marks = "".join("." + m[2].strip("\"'") for m in _NAMES.finditer(inner)) if inner else ""
        node = Node(name, marks)
        stack[-1].children.append(node)
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not inner.endswith("/") and (name in BLOCKS or node.dropped):
            stack.append(node)
            opened[name] += 1
    return root


# A wrapper node is [key, optional, repeated, children]; a text is ["#", optional, repeated, text, pages it is known from] or, as a slot,
# ["#", optional, repeated, None]. The key `name.*` stands for elements of that name with any marks.


def told(text: str) -> str:
    """How a wrapper holds a constant text."""
    text = " ".join(text.split())
    return text if len(text) <= LONGEST else "~" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def shape(node: Node, depth: int = 1) -> list:
    """The wrapper that fits one page alone, equal neighbours already folded into repeated groups; it knows nothing of what lies below DEEPEST."""
    children = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                children.append(["#", False, False, told(child), 1])
        else:
            children.append(shape(child, depth + 1) if depth < DEEPEST else [child.key, False, False, []])
    return [node.key, False, False, fold(children)]


def fold(children: list) -> list:
    out: list = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = merge(out[-1], child, max)
            out[-1][2] = True
        else:
            out.append(child)
    return out


def merge(a: list, b: list, pages=operator.add) -> list:
    """The least general wrapper of both kinds of node found with equal keys.

    ``pages`` is how the numbers of pages that hold an equal text go together:
    their sum where the sides come from different pages, else the greater one.
    """
    if a[0] == "#":
        equal = a[3] is not None and a[3] == b[3]
        return ["#", a[1] or b[1], a[2] or b[2], *([a[3], pages(a[4], b[4])] if equal else [None])]
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3], pages)]


def align(a: list, b: list, pages=operator.add) -> list:
    """Children of both aligned by their keys; what one side lacks is optional."""
    out = []
    left, right = [x[0] for x in a], [x[0] for x in b]
    if left == right:
        return fold([merge(x, y, pages) for x, y in zip(a, b)])
    for kind, i, k, j, m in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merge(x, y, pages) for x, y in zip(a[i:k], b[j:m])]
        else:
            out += [[x[0], True, *x[2:]] for x in (*a[i:k], *b[j:m])]
    return fold(out)


def size(wrapper: list) -> int:
    return 1 + (0 if wrapper[0] == "#" else sum(map(size, wrapper[3])))


def general(wrapper: list, width: int) -> list:
    """The wrapper with at most ``width`` children a node where there are more than one of a name: those of one name become one repeated group."""
    if wrapper[0] == "#":
        return wrapper
    children = wrapper[3]
    if len(children) > width:
        named: dict[str, list] = {}
        for c in children:
            key = c[0] if c[0] == "#" else c[0].partition(".")[0] + ".*"
            c = [key, *c[1:]]
            named[key] = [*merge(named[key], c, max)] if key in named else c
            named[key][1:3] = [True, True]
        children = list(named.values())
    return [*wrapper[:3], [general(c, width) for c in children]]


def combine(wrappers: Iterable[list]) -> list | None:
    """One wrapper for all that those of different pages fit, in their order."""
    known = None
    for own in wrappers:
        known = own if known is None else merge(known, own)
        for width in (64, 16, 4, 1):
            if size(known) <= MOST:
                break
            known = general(known, width)
    return known


def infer(pages: list[str]) -> list | None:
    """A host's wrapper: the first page's own, generalised by one page after the other."""
    return combine(shape(parse(page)) for page in pages)


def site(wrapper: list) -> list | None:
    """What a wrapper holds of the site's own texts: its constants known from CERTAIN pages and the way to them."""
    if wrapper[0] == "#":
        return wrapper if wrapper[3] is not None and wrapper[4] >= CERTAIN else None
    children = [c for c in map(site, wrapper[3]) if c]
    return [*wrapper[:3], children] if children else None


def has_region(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.dropped:
            continue
        if n.name in REGIONS:
            return True
        todo += [c for c in n.children if isinstance(c, Node)]
    return False


def keep_content(root: Node) -> None:
    """On a page without a region outside furniture, furniture that holds the content is none.

    That is what holds <main>, what holds an <article> and more text than all
    that would be left, and what holds nine times as much as would be left.
    """
    while not has_region(root):
        left, outer, todo = 0, [], [root]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, str):
                    left += len(c.strip())
                elif not c.dropped:
                    todo.append(c)
                elif c.name not in HIDDEN:
                    outer.append(c)
        changed = False
        for node in outer:
            held, names, todo = 0, {node.name}, [node]
            while todo:
                for c in todo.pop().children:
                    if isinstance(c, str):
                        held += len(c.strip())
                    elif c.name not in HIDDEN:
                        names.add(c.name)
                        todo.append(c)
            if held and ("main" in names or held > left * (1 if "article" in names else 9)):
                node.dropped, changed = False, True
        if not changed:
            return


def main_text(page: str, wrapper: list | None, certain: bool) -> str:
    """Main text of a page. ``certain``: the wrapper comes from several different pages, so a text that CERTAIN of them hold as constant is the site's.

    The article element is the region where the page has one; elsewhere the
    whole body is, without the wrapper's constant texts. Nodes the wrapper
    doesn't know are judged by the same rules.
    """
    root = parse(page)
    keep_content(root)
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            blocks.append(text)

    # (node, wrapper nodes that fit it, inside the region, next child); an explicit stack, as pages may nest deeply
    stack = [(root, [wrapper] if wrapper else [], not has_region(root), 0)]
    bounded = not stack[0][2]
    while stack:
        node, known, inside, i = stack.pop()
        if i == len(node.children):
            if node.name in BLOCKS:
                close()
            continue
        stack.append((node, known, inside, i + 1))
        child = node.children[i]
        if isinstance(child, str):
            constants = [w for k in known for w in k[3] if w[0] == "#" and w[3] is not None and w[4] >= CERTAIN] if certain and not bounded else []
            if inside and not (constants and told(child) in [w[3] for w in constants]):
                now.append(child)
            continue
        if child.name in BLOCKS:
            close()
        elif child.name == "br":
            now.append(" ")
        if child.dropped or child.name in VOID:
            continue
        fits = [w for k in known for w in k[3] if w[0] == child.key or w[0] == child.name + ".*"]
        stack.append((child, fits, inside or child.name in REGIONS, 0))
    close()
    return " ".join(blocks)


def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each page's own wrapper as JSON."""
    for frame in frames:
        yield pd.DataFrame({"host": frame["host"], "shape": [json.dumps(shape(parse(page))) for page in frame["html"]]}).drop_duplicates()


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host with the wrapper of all its pages as JSON, how many different ones there are, and the site's own texts in the wrapper (null if none).

    Pages with equal texts in equal elements are one. Those of a host are dealt
    to groups by hash, a wrapper is made of each, and the wrappers are merged
    by groups until one is left, in an order that the pages alone decide.
    """
    ship(pages.sparkSession)
    rows = pages.select(host(F.col("url")).alias("host"), "html").filter("html is not null")
    own = settle(rows.mapInPandas(shapes, "host string, shape string").distinct())
    counts = settle(own.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_parts")))
    order = F.xxhash64("shape").alias("_order")
    dealt = own.join(counts, "host").select("host", "_parts", order, "shape", F.lit(1).cast("long").alias("n"))
    # Dealt by both, as a shuffled join by host alone would leave all groups of a host in one task.
    dealt = dealt.withColumn("_part", F.pmod("_order", "_parts")).repartition("host", "_part")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", "shape"])
        known = combine(map(json.loads, frame["shape"]))
        first = {c: [frame[c].iloc[0]] for c in ("host", "_part", "_parts")}
        return pd.DataFrame(first | {"shape": [json.dumps(known)], "n": [frame["n"].sum()]})

    form = "host string, _part long, _parts long, shape string, n long"
    known = settle(dealt.groupBy("host", "_part").applyInPandas(learn, form))
    while (known.agg(F.max("_parts")).first()[0] or 0) > 1:
        up = known.select("host", F.col("_part").alias("_order"), F.floor(F.col("_part") / GROUPS).alias("_part"), F.ceil(F.col("_parts") / GROUPS).alias("_parts"), "shape", "n")
        known = settle(up.groupBy("host", "_part").applyInPandas(learn, form))

    def pruned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [site(json.loads(x)) for x in frame["wrapper"]]
            yield frame.assign(site=[json.dumps(x) if x else None for x in kept])

    return settle(known.select("host", F.col("shape").alias("wrapper"), "n").mapInPandas(pruned, "host string, wrapper string, n long, site string"))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page, from the whole html.

    Null and repeated ids and URLs are passed through; null html is empty and
    has no text. Pages without a host share one wrapper. An empty table gives
    no rows; other columns are ignored. A wrapper is inferred from all
    different pages of its host, then applied to all of them.
    """
    ship(pages.sparkSession)
    learnt = wrappers(pages).select("host", F.col("site").alias("wrapper"), (F.col("n") >= CERTAIN).alias("certain"))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(learnt, "host", "left")

    def apply(frames):
        held: OrderedDict[str, list] = OrderedDict()
        for frame in frames:
            texts = []
            for page, wrapper, certain in zip(frame["html"], frame["wrapper"], frame["certain"]):
                known = None
                if isinstance(wrapper, str):
                    known = held.pop(wrapper, None) or json.loads(wrapper)
                    held[wrapper] = known
                    if len(held) > 64:
                        held.popitem(last=False)
                texts.append(main_text(page, known, bool(certain)) if isinstance(page, str) else "")
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "wrapper", "certain").mapInPandas(apply, f"page_id {kind}, url string, text string, n_chars long")
