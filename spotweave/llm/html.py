"""Main text of web pages by wrapper induction.

Pages of one host are parsed to trees of block elements; runs of like siblings become one repeated node. Pages with the same
tree share a layout. The layouts of a host, all of them, are aligned by simple tree matching into one template. Texts are
counted per node over all distinct pages, by tasks first. A node that says the same on nearly all pages of its layout, or of all
layouts that have the template's node, is constant; the others are slots. The content of a layout is the lowest node with all
slots outside menus, headers, footers, sidebars, notices, adverts, forms and comments, or all articles and main parts where
one has a large share of them. Every page gives the blocks of its layout's content, without the constant nodes.

Null pages are empty. A page whose layout has no content is judged by its own tree. Malformed markup is closed where
a browser would close blocks. No page is left out of the counts, and no block is dropped for its text or length.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.arrow import slices
from spotweave.session import durable

#: A node is constant if it says the same on this share of at least so many distinct pages.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 5
#: Bytes of templates up to which they are broadcast; beyond, pages meet them by a salted shuffle join.
BROADCAST_BYTES, SALTS = 64 << 20, 32
#: Repeated pages up to which their keys (about 40 bytes each) are broadcast; beyond, pages are shuffled.
BROADCAST_COPIES = 1_000_000
#: Texts that a task counts before it hands its counts on.
COUNTED = 100_000
#: Share of a tree's varying text from which on an article or main part speaks for its kind.
ARTICLE_SHARE = 0.3

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "param", "source", "track", "wbr"}
BLOCKS = set(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th "
    "nav header footer aside form fieldset legend address details summary dialog noscript template select option button label menu hr center hgroup search svg object video audio canvas".split())
CLOSES_P = BLOCKS - {"button", "label", "option", "select", "svg", "object", "video", "audio", "canvas", "template", "noscript"}
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = set("head nav footer aside form dialog noscript template select option button label menu search svg object video audio canvas fieldset".split())
KEPT = {"html", "body", "main", "article", "#root"}
#: Words in class, id and role of what is no content; the second list only where no word speaks for content. Whole words count.
STRONG = set("""nav navbar navigation menu menus submenu footer contentinfo sidebar sidebars complementary ad ads adv advert adverts advertisement advertising
    adslot adsense sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr newsletter newsletters subscribe subscription
    comment comments commentlist disqus respond breadcrumb breadcrumbs social share sharing related popup modal overlay pagination pager login signup
    searchform toolbar skip copyright disclaimer""".split())
WEAK = set("header masthead banner banners notice notices alert alerts widget widgets rail search form meta tags dialog topbar bar".split())
SPEAKING = {"article", "post", "entry", "content", "main", "story", "body", "text"}


@dataclass(slots=True)
class Node:
    tag: str
    names: tuple[str, ...]
    hidden: bool
    kids: list = field(default_factory=list)  #: nodes, and (text, is a link) pairs
    holds: bool = False  #: an article or main part below


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for _, value in _ATTRIBUTE.findall(attributes):
        found += [name.lower() for name in _NAME.findall(value)]
    return tuple(dict.fromkeys(found))


def parse(page: str) -> Node:
    """The tree of block elements; text keeps its inline markup only as to whether it is a link."""
    root = Node("#root", (), False)
    stack, links, at = [root], 0, 0
    opened: Counter = Counter()

    def close(depth: int) -> None:
        opened.subtract(node.tag for node in stack[depth:])
        del stack[depth:]

    while True:
        token = _TOKEN.search(page, at)
        text = page[at : token.start()] if token else page[at:]
        if text:
            stack[-1].kids.append((text, links > 0))
        if not token:
            return root
        at = token.end()
        tag = token[2]
        if not tag:
            continue
        tag = tag.lower()
        if token[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS and opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            stack[-1].kids.append((" ", False))
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            links = 0
            if tag in CLOSES_P and stack[-1].tag == "p":
                close(len(stack) - 1)
            if tag in SELF_CLOSING and any(opened[name] > 0 for name in SELF_CLOSING[tag][0]):
                same, within = SELF_CLOSING[tag]
                depth = len(stack) - 1
                while depth > 0 and stack[depth].tag not in within and stack[depth].tag not in same:
                    depth -= 1
                if depth > 0 and stack[depth].tag in same:
                    while depth > 1 and stack[depth - 1].tag in same:
                        depth -= 1
                    close(depth)
            node = Node(tag, _names(token[3]), bool(_HIDDEN.search(token[3])))
            stack[-1].kids.append(node)
            if tag in ("article", "main"):
                for above in reversed(stack):
                    if above.holds:
                        break
                    above.holds = True
            if tag not in VOID and not token[3].endswith("/"):
                stack.append(node)
                opened[tag] += 1


def is_chrome(node: Node, in_article: bool = False) -> bool:
    """Whether a node is no content by its tag, names or state."""
    if node.tag in KEPT:
        return False
    if node.hidden:
        return True
    if node.tag in DROPPED or (node.tag == "header" and not in_article):
        return not node.holds
    if not STRONG.isdisjoint(node.names) or (not WEAK.isdisjoint(node.names) and SPEAKING.isdisjoint(node.names)):
        return not node.holds
    return False


def clean(text: str) -> str:
    return _SPACE.sub(" ", html.unescape(text)).strip()


@dataclass(slots=True)
class Shape:
    """A node of the collapsed tree: like siblings next to each other are one."""

    label: str
    nodes: list[Node]
    kids: list[Shape]


def _children(nodes: list[Node]) -> list[tuple[str, list[Node]]]:
    kids: list[tuple[str, list[Node]]] = []
    for node in nodes:
        place = 0
        for kid in node.kids:
            if not isinstance(kid, Node):
                continue
            name = kid.tag + "".join("." + x for x in kid.names) + "!" * kid.hidden
            at = next((i for i in range(max(0, place - 1), len(kids)) if kids[i][0] == name), -1)
            if at >= 0:
                kids[at][1].append(kid)
                place = at + 1
            else:
                kids.insert(place, (name, [kid]))
                place += 1
    return kids


def collapsed(nodes: list[Node], label: str) -> Shape:
    root = Shape(label, nodes, [])
    waiting = [root]
    while waiting:  # pages can be nested deeper than calls can
        shape = waiting.pop()
        shape.kids = [Shape(name, part, []) for name, part in _children(shape.nodes)]
        waiting += shape.kids
    return root


def shape_of(page: str) -> Shape:
    return collapsed([parse(page)], "#root")


def written(shape: Shape) -> str:
    out, waiting = [], [shape]
    while waiting:
        own = waiting.pop()
        if isinstance(own, str):
            out.append(own)
            continue
        out.append(own.label)
        if own.kids:
            waiting.append(")")
            for kid in reversed(own.kids):
                waiting += [kid, " "]
            waiting[-1] = "("
    return "".join(out)


def match(a, b, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: nodes matched, and which children are paired, for trees with ``label`` and ``kids``."""
    known = {} if known is None else known
    if a.label != b.label:
        return 0, []
    waiting = [(a, b)]
    while waiting:
        x, y = waiting[-1]
        if (id(x), id(y)) in known:
            waiting.pop()
            continue
        open_ = [(p, q) for p in x.kids for q in y.kids if p.label == q.label and (id(p), id(q)) not in known]
        if open_:
            waiting += open_
            continue
        waiting.pop()
        known[id(x), id(y)] = _paired(x.kids, y.kids, known)
    return known[id(a), id(b)]


def _paired(left: list, right: list, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The best pairing of children in order, and the nodes matched with their parents; ties keep the later children apart."""
    own = lambda i, j: known.get((id(left[i - 1]), id(right[j - 1])), (0,))[0]
    n, m = len(left), len(right)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + own(i, j))
    pairs, i, j = [], n, m
    while i and j:
        if own(i, j) and best[i][j] == best[i - 1][j - 1] + own(i, j):
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[n][m] + 1, pairs[::-1]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass(slots=True)
class Template:
    """A node of a host's template or of a layout; ``size`` is what it said besides links, ``constant`` a text's hash."""

    label: str
    tag: str
    chrome: bool
    kids: list[Template] = field(default_factory=list)
    size: float = 0
    number: int = 0
    constant: int | None = None
    content: bool = False


def _said(nodes: Iterable[Node]) -> tuple[str, int]:
    parts, links = [], 0
    for node in nodes:
        for kid in node.kids:
            if isinstance(kid, tuple):
                parts.append(kid[0])
                links += len(kid[0].strip()) * kid[1]
    return clean(" ".join(parts)), links


def _started(shape: Shape, in_article: bool = False) -> Template:
    root = Template(shape.label, shape.nodes[0].tag, is_chrome(shape.nodes[0], in_article))
    waiting = [(shape, root, in_article)]
    while waiting:
        own, node, inside = waiting.pop()
        inside = inside or node.tag in ("article", "main")
        node.kids = [Template(kid.label, kid.nodes[0].tag, is_chrome(kid.nodes[0], inside)) for kid in own.kids]
        waiting += [(kid, made, inside) for kid, made in zip(own.kids, node.kids, strict=True)]
    return root


def preorder(node) -> Iterator:
    waiting = [node]
    while waiting:
        own = waiting.pop()
        yield own
        waiting += reversed(own.kids)


def dumped(root: Template) -> bytes:
    """A layout as a flat list, so that its depth does not matter."""
    return pickle.dumps([(node.label, node.tag, node.chrome, len(node.kids)) for node in preorder(root)])


def loaded(data: bytes) -> Template:
    root = Template("", "", False)
    waiting = [root]
    for label, tag, chrome, kids in pickle.loads(data):
        node = waiting.pop()
        node.label, node.tag, node.chrome = label, tag, chrome
        node.kids = [Template("", "", False) for _ in range(kids)]
        waiting += reversed(node.kids)
    return root


def align(into: Template, own: Template, count: Iterator[int], known: dict | None = None) -> list[int]:
    """Merges a layout into a template; the template's numbers of the layout's nodes, in preorder."""
    numbers, waiting = [], [(into, own, {} if known is None else known)]
    while waiting:
        into, own, known = waiting.pop()
        numbers.append(into.number)
        pairs = dict((j, i) for i, j in match(into, own, known)[1])
        old, place, below = list(into.kids), 0, []
        for j, kid in enumerate(own.kids):
            if j in pairs:
                node = old[pairs[j]]
                place = next(i for i, x in enumerate(into.kids) if x is node) + 1
            else:
                node = Template(kid.label, kid.tag, kid.chrome, number=next(count))
                into.kids.insert(place, node)
                place += 1
            below.append((node, kid, known if j in pairs else {}))
        waiting += reversed(below)
    return numbers


def _varying(root: Template) -> dict[int, float]:
    """Characters of slots per subtree (by id), links left out; nothing below chrome counts."""
    seen, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        seen.append(node)
        if not node.chrome:
            waiting += node.kids
    found: dict[int, float] = {}
    for node in reversed(seen):
        own = 0 if node.chrome or node.constant is not None else max(0, node.size)
        found[id(node)] = own + (0 if node.chrome else sum(found[id(kid)] for kid in node.kids))
    return found


def judge(root: Template) -> Template:
    """Marks the content of a layout whose constant nodes are known."""
    size = _varying(root)
    total = size[id(root)]
    articles, queue = [], [root]
    while queue:
        node = queue.pop()
        if node.chrome:
            continue
        if node.tag in ("article", "main"):
            articles.append(node)
        else:
            queue += node.kids
    if any(size[id(node)] >= ARTICLE_SHARE * total and size[id(node)] for node in articles):
        for node in articles:
            node.content = True
        return root
    best = root
    while best.constant is not None or best.size <= 0:
        inner = [kid for kid in best.kids if size[id(kid)] > 0]
        if len(inner) != 1 or not inner[0].kids:
            break
        best = inner[0]
    best.content = True
    return root


def _blocks(node: Node, roles: dict[int, Template | None], in_article: bool, out: list[list[str]]) -> None:
    """Adds the texts of a node to ``out``, a list per run of text that no block interrupts."""
    waiting: list = [(node, in_article)]
    while waiting:
        own = waiting.pop()
        if own is None:
            out.append([])
        elif isinstance(own, str):
            out[-1].append(own)
        else:
            node, inside = own
            role = roles.get(id(node))
            if is_chrome(node, inside) if role is None else role.chrome:
                continue
            if role is not None and role.constant is not None and not any(isinstance(kid, Node) for kid in node.kids) and _hash(_said([node])[0]) == role.constant:
                continue
            out.append([])
            inside = inside or node.tag in ("article", "main")
            for kid in reversed(node.kids):
                waiting += [None, (kid, inside)] if isinstance(kid, Node) else [kid[0]]


@dataclass(slots=True, frozen=True)
class Role:
    chrome: bool
    constant: int | None
    content: bool


class Extractor:
    """Texts of pages by the layouts of their host: roles of the nodes, in preorder, by the hash of the tree."""

    def __init__(self, layouts: dict[int, list[Role]] | None) -> None:
        self.layouts = layouts or {}

    def text(self, page: str | None) -> str:
        shape = shape_of(page or "")
        roles = self.layouts.get(_hash(written(shape)))
        found = self._extracted(shape, roles) if roles else None
        if found is None:
            root = _started(shape)
            for node, own in zip(preorder(root), preorder(shape), strict=True):
                text, links = _said(own.nodes)
                node.size = len(text) - links
            found = self._extracted(shape, list(preorder(judge(root))))
        return found or ""

    def _extracted(self, shape: Shape, roles: Sequence) -> str | None:
        flat = list(preorder(shape))
        by_node = {id(node): role for own, role in zip(flat, roles, strict=True) for node in own.nodes}
        content = [own for own, role in zip(flat, roles, strict=True) if role.content]
        if not content:
            return None
        out: list[list[str]] = []
        for own in content:
            for node in own.nodes:
                _blocks(node, by_node, node.tag in ("article", "main"), out)
        return "\n\n".join(x for x in (clean("".join(part)) for part in out) if x)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (host, html, copies): a row per layout (tree, pages, sizes) and a row per layout, leaf and text (pages), summed."""
    trees: dict[tuple, list] = {}
    texts: Counter = Counter()

    def handed() -> pa.RecordBatch:
        rows = [(*key, tree, None, None, pages, sizes) for key, (tree, pages, sizes) in trees.items()] + [(*key, pages, None) for key, pages in texts.items()]
        rows = [row if len(row) == 7 else (row[0], row[1], None, *row[2:]) for row in rows]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        out = pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], ["host", "layout", "tree", "node", "text", "pages", "sizes"])
        trees.clear()
        texts.clear()
        return out

    for batch in slices(batches):
        for host, page, copies in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            shape = shape_of(page)
            key = (host, _hash(written(shape)))
            if key not in trees:
                root = _started(shape)
                trees[key] = [dumped(root), 0.0, [0.0] * sum(1 for _ in preorder(root))]
            own = trees[key]
            own[1] += 1 / copies
            for i, part in enumerate(preorder(shape)):
                text, links = _said(part.nodes)
                own[2][i] += (len(text) - links) / copies
                if text and not part.kids:
                    texts[(*key, i, _hash(text))] += 1 / copies
        if len(texts) + len(trees) > COUNTED:
            yield handed()
    yield handed()


def templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host`` and ``template`` (pickled roles by layout) of every host with a page. Copies of a page count as one."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(page).alias("h"), F.col(page).alias("html")).filter(F.col("html").isNotNull())
    copies = durable(rows.groupBy("host", "h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    each = rows.join(copies, ["host", "h"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    counted = durable(each.mapInArrow(_counted, "host string, layout long, tree binary, node int, text long, pages double, sizes array<double>"))
    added = lambda parts: F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    layouts = counted.filter("node IS NULL").groupBy("host", "layout").agg(F.first("tree").alias("tree"), F.sum("pages").alias("pages"), F.collect_list("sizes").alias("parts"))
    layouts = durable(layouts.select("host", "layout", "tree", "pages", added(F.col("parts")).alias("sizes")))

    def aligned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "layout"], ascending=[False, True])
        root, count, numbers = Template("#root", "#root", False), itertools.count(1), []
        for tree in rows["tree"]:
            numbers.append(align(root, loaded(tree), count))
        held: Counter = Counter()
        for own, n in zip(numbers, rows["pages"], strict=True):
            held.update(dict.fromkeys(own, n))
        return pd.DataFrame({"host": rows["host"], "layout": rows["layout"], "total": rows["pages"], "numbers": numbers, "held": [[held[x] for x in own] for own in numbers]})

    numbered = durable(layouts.select("host", "layout", "tree", "pages").groupBy("host").applyInPandas(aligned, "host string, layout long, total double, numbers array<int>, held array<double>"))
    texts = counted.filter("node IS NOT NULL").groupBy("host", "layout", "node", "text").agg(F.sum("pages").alias("pages"))
    at = lambda name: F.element_at(name, F.col("node") + 1)
    placed = durable(texts.join(numbered, ["host", "layout"]).select("host", "layout", "node", "text", "pages", "total", at("numbers").alias("number"), at("held").alias("held")))
    often = lambda total: (total > CONSTANT_PAGES - 0.5) & (F.col("pages") >= CONSTANT_SHARE * total - 1e-6)
    alone = placed.filter(often(F.col("total"))).groupBy("host", "layout").agg(F.collect_list(F.struct("node", "text")).alias("alone"))
    pooled = placed.groupBy("host", "number", "text").agg(F.sum("pages").alias("pages"), F.first("held").alias("held")).filter(often(F.col("held")))
    pooled = pooled.groupBy("host").agg(F.collect_list(F.struct("number", "text")).alias("pooled"))
    known = layouts.drop("pages").join(numbered.select("host", "layout", "numbers"), ["host", "layout"]).join(alone, ["host", "layout"], "left").join(pooled, "host", "left")

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        found, roles = {}, {}
        values = rows["pooled"].iloc[0]
        shared = {x["number"]: x["text"] for x in (() if values is None else values)}
        for layout, tree, sizes, numbers, alone in zip(rows["layout"], rows["tree"], rows["sizes"], rows["numbers"], rows["alone"], strict=True):
            root = loaded(tree)
            own = {x["node"]: x["text"] for x in (() if alone is None else alone)}
            for i, (node, size, number) in enumerate(zip(preorder(root), sizes, numbers, strict=True)):
                node.size = size
                node.constant = None if node.kids else own.get(i, shared.get(number))
            judge(root)
            kept = [(node.chrome, node.constant, node.content) for node in preorder(root)]
            found[int(layout)] = [roles.setdefault(x, Role(*x)) for x in kept]
        return pd.DataFrame({"host": rows["host"].iloc[:1].tolist(), "template": [pickle.dumps(found)]})

    return known.groupBy("host").applyInPandas(judged, "host string, template binary")


def main_text(pages: DataFrame, url: str = "url", page: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, all if None) and ``text``."""
    found = durable(templates(pages, url, page))
    size = found.agg(F.sum(F.length("template") + 64).alias("n")).first()["n"] or 0
    names = pages.columns if keep is None else keep
    rows = pages.select(F.struct(*[F.col(f"`{name}`") for name in names]).alias("given"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({row["host"]: bytes(row["template"]) for row in found.toLocalIterator()})
        joined = rows.select("given", F.struct("host", "html", F.lit(None).cast("binary").alias("template")).alias("page"))
    else:
        known = None
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").select("given", F.struct("host", "html", "template").alias("page"))
    schema = joined.select("given").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractors: dict[str, Extractor] = {}
        for batch in slices(batches):
            texts = []
            hosts, bodies, own = (batch.column(1).field(i).to_pylist() for i in range(3))
            for host, body, template in zip(hosts, bodies, own, strict=True):
                if host not in extractors:
                    if len(extractors) > 5000:
                        extractors.clear()
                    template = known.value.get(host) if known else template
                    extractors[host] = Extractor(pickle.loads(template) if template else None)
                texts.append(extractors[host].text(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["given", "text"])

    return joined.mapInArrow(run, schema).withColumnRenamed("given", "row")
