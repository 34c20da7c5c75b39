"""Main text of web pages by removal of site templates.

Every element subtree has two hashes, made bottom up. One is of its tag,
attributes, text and children's hashes, with white space collapsed and numbers
alike: what a site repeats word for word. The other is of its shape: tag and
names, the shapes of its blocks with repeats run together, whether it holds text,
how much of that is links, and the path of names down to it: what a site fills
anew on every page, as menus, adverts and footers. Both are counted per host, by
Spark; a subtree with a hash that stands on MIN_PAGES different pages of its
host or more is template, and is deleted first.

A subtree that holds half of its page's text, or a marked article, is never
counted. Shapes count only for what can't be the article: what lies outside a
marked article; in or beside the block with most of the text menus, sides,
footers, forms and lists of links; beside it also single blocks of little text.

What recurs on too few pages is left to markup, as a remainder: an article that
the page marks is all that is kept; menus, footers, forms and scripts go by
their element; other blocks go whose class, id or role names such a part and
nothing else, unless they hold half of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.llm.common import col, kept, pieces, staged
from relweave.llm.markup import BLOCK, RAW, TAG, VOID, raw_end

#: A subtree is template if it stands on so many different pages of its host, and on no fewer than the base-2 logarithm of their number (20 of a million).
MIN_PAGES = 3

# Elements that aren't shown, and further ones that hold no part of an article.
UNSEEN = frozenset("head script style noscript template title textarea iframe object embed svg canvas audio video".split())
DROPPED = UNSEEN | frozenset("nav footer aside form button select input dialog menu".split())
# Fixed values of HTML: a new element of these closes an open one of those, up to an element of the scope.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body div section article main aside nav header footer ul ol dl table form td th blockquote".split())
PARAGRAPH_KEEPS = frozenset("body html head caption dd dt li td th tr tbody thead tfoot option optgroup legend summary".split())
CONTAINERS = frozenset("div section ul ol dl table nav header footer aside form p figure".split())
IN_ARTICLE = frozenset("div section ul ol dl table aside form figure".split())

# Words in a class, id or role that name a part which isn't the article, and words beside them that say a name is of something else.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promoted promotion sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments commentlist respond disqus replies toolbar widget pagination pager search "
    "skip masthead complementary contentinfo".split()
)
ARTICLE_PARTS = frozenset("comment comments reply ad advert advertisement promo sponsored related teaser".split())
# Words that may stand beside them in a name and leave it what it is: "site-footer", "ad_box_2", but not "share-price".
BESIDE = frozenset("site page main top bottom left right upper lower box block bar area list wrap wrapper container section inner outer content buttons button links link item items form text body header slot unit the global primary secondary post user reader entry article story".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data em font i img ins kbd mark q s small span strong sub sup time tt u var wbr".split())
#: Elements whose shape is enough for template, in the article's neighbourhood too.
AROUND = frozenset("nav aside footer form dialog menu".split())
#: Of a page's text a single block beside the article holds so much at most, where its shape is to make it template.
LITTLE = 1 / 8

_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Node:
    """An element. size: characters of text that are shown below it, links: those in links. marked: an article is marked below it or is itself.

    told: tag and names. sig, shape: hashes of the subtree. place: the shape's with its path, if it may be template by it, else 0.
    """

    __slots__ = ("tag", "attributes", "names", "hidden", "role", "children", "sig", "size", "links", "marked", "told", "shape", "place")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []
        self.names, self.hidden, self.role = frozenset(), False, ""
        self.sig = self.size = self.links = self.shape = self.place = 0
        self.marked, self.told = False, tag
        if attributes and not attributes.isspace():
            values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
            self.role = values.get("role", "")
            named = [values.get(k, "") for k in ("class", "id", "role")]
            if any(named):
                self.told = _DIGITS.sub("0", f"{tag} {named}")
            # A name is of a part if it says nothing else: has-sidebar and share-price aren't.
            words = [frozenset(w for w in _WORDS.findall(name) if len(w) > 1) for v in named for name in v.split()]
            self.names = frozenset(w for name in words if name <= PARTS | BESIDE for w in name & PARTS)
            self.hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")

    def measure(self) -> None:
        """Sizes, when the children have theirs."""
        shown = self.tag not in UNSEEN
        for c in self.children:
            if isinstance(c, str):
                self.size += len(_plain(c)) * shown
            else:
                self.size += c.size * shown
                self.links += (c.size if c.tag == "a" else c.links) * shown
                self.marked |= c.marked

    def close(self) -> None:
        """Hashes and sizes, when the children have theirs."""
        import xxhash

        h = xxhash.xxh3_64(f"{self.tag} {_plain(self.attributes)}".encode("utf-8", "surrogatepass"))
        shown = self.tag not in UNSEEN
        blocks, last, filled = [], 0, False
        for c in self.children:
            if isinstance(c, str):
                text = _plain(c)
                h.update(text.encode("utf-8", "surrogatepass"))
                self.size += len(text) * shown
                filled |= bool(text)
            else:
                h.update(c.sig.to_bytes(8, "little"))
                self.size += c.size * shown
                self.links += (c.size if c.tag == "a" else c.links) * shown
                self.marked |= c.marked
                if c.tag in INLINE:
                    filled |= c.size > 0
                elif c.shape != last and (c.size or c.tag not in UNSEEN):
                    blocks.append(c.shape)
                    last = c.shape
        self.sig = h.intdigest()
        if self.tag not in INLINE:
            self.shape = xxhash.xxh3_64_intdigest(f"{self.told} {filled} {2 * self.links >= self.size > 0} {blocks}".encode("utf-8", "surrogatepass"))


def _plain(text: str) -> str:
    return _DIGITS.sub("0", " ".join(text.split()))


def parse(source: str, hashed: bool = True) -> Node:
    """The element tree of a page, with or without hashes; unclosed elements end where HTML has them end, stray end tags are ignored."""
    finish = Node.close if hashed else Node.measure
    root = Node("#root", "")
    stack, at, length = [root], 0, len(source)
    open_tags: Counter[str] = Counter()

    def close(depth: int) -> None:
        for node in reversed(stack[depth:]):
            open_tags[node.tag] -= 1
            finish(node)
        del stack[depth:]

    def open_of(names, scope) -> int:
        if any(open_tags[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    return i
                if stack[i].tag in scope:
                    break
        return 0

    for m in iter(lambda: TAG.search(source, at), None):
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if i := open_of((tag,), () if tag in BLOCK else BLOCK):
                close(i)
            continue
        if tag in BLOCK and tag not in PARAGRAPH_KEEPS and (i := open_of(("p",), SCOPE)):
            close(i)
        if tag in SIBLINGS and (i := open_of(SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table", "select")))):
            close(i)
        if tag in ("article", "main") and (i := open_of(("nav", "footer", "header"), frozenset(("article", "main")))):
            close(i)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end, at = raw_end(source, tag, at)
            node.children.append(source[m.end() : end])
            finish(node)
        elif tag in VOID or m[3].rstrip().endswith("/"):
            finish(node)
        else:
            open_tags[tag] += 1
            stack.append(node)
    if at < length:
        stack[-1].children.append(source[at:])
    close(1)
    finish(root)
    return root


def _roots(node: Node) -> list[Node]:
    """The outermost articles and mains, but for those inside a comment, menu, side or footer."""
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main") or n.role == "main":
            if not (n.names & ARTICLE_PARTS or n.hidden):
                found.append(n)
            continue
        if n.tag not in ("nav", "aside", "footer") and not n.names & ARTICLE_PARTS:
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return found


def _mark(tree: Node) -> list[Node]:
    """The roots, with `marked` set on them and on all that holds one."""
    roots = _roots(tree)
    own = set(map(id, roots))
    order = [tree]
    for n in order:
        order += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        n.marked = id(n) in own or any(c.marked for c in n.children if isinstance(c, Node))
    return roots


def _single(node: Node) -> bool:
    return all(isinstance(c, str) or c.tag in INLINE for c in node.children)


def _offer(tree: Node, roots: list[Node]) -> list[Node]:
    """The subtrees that may be template, outermost first; `place` is set on those that may be so by their shape."""
    import xxhash

    own = set(map(id, roots))
    block = tree  # with most of the text: the last on a path of subtrees that hold over half of it
    while inner := next((c for c in block.children if isinstance(c, Node) and c.tag not in INLINE and 2 * c.size > tree.size and not _single(c)), None):
        block = inner
    out, todo = [], [(tree, 0, False, False)]
    while todo:
        node, path, inside, main = todo.pop()
        inside, main = inside or id(node) in own, main or node is block
        if node.tag in (IN_ARTICLE if inside else CONTAINERS) and not node.marked and node.size and 2 * node.size <= tree.size:
            out.append(node)
            around = node.tag in AROUND or 2 * node.links >= node.size
            beside = not main and (bool(roots) or (_single(node) and node.size <= LITTLE * tree.size))
            if around or (beside and not inside):
                node.place = xxhash.xxh3_64_intdigest(f"{path} {node.shape}".encode("utf-8", "surrogatepass"))
        path = crc32(node.told.encode("utf-8", "surrogatepass"), path)
        todo += [(c, path, inside, main) for c in node.children if isinstance(c, Node)]
    return out


def subtrees(source: str) -> list[tuple[int, int]]:
    """Number (in the order of _offer) and hash of a page's subtrees that may turn out to be template."""
    tree = parse(source)
    return [(i, h - (1 << 63)) for i, n in enumerate(_offer(tree, _mark(tree))) for h in (n.sig, n.place) if h]


def _text(roots: list[Node], gone: set[int], whole: int, parts: bool, names: bool) -> str:
    """Text below the roots without the nodes that are gone (by their id()); whole: size of the page."""
    own = set(map(id, roots))
    blocks: list[list[str]] = [[]]
    todo: list[tuple[Node | str, bool]] = [(n, n.tag != "#root") for n in reversed(roots)]
    while todo:
        node, inside = todo.pop()
        if isinstance(node, str):
            if node == "\n":
                blocks.append([])
            else:
                blocks[-1].append(node)
            continue
        if id(node) not in own:
            if id(node) in gone or node.tag in UNSEEN:
                continue
            if parts and (node.tag in DROPPED or node.hidden or (node.tag == "header" and not inside)):
                continue
            named = names and node.names and node.tag not in ("html", "body") and not (inside and node.tag == "p")
            if named and 2 * node.size <= whole and node.names & (ARTICLE_PARTS if node.tag in ("article", "main") else PARTS):
                continue
        if node.tag == "br":
            blocks[-1].append(" ")
        if node.tag in BLOCK:
            todo.append(("\n", inside))
            blocks.append([])
        # A text of one line feed would pass for a block's end: it is white space all the same.
        todo += [(c if not isinstance(c, str) or c != "\n" else " ", inside) for c in reversed(node.children)]
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(source: str, template: frozenset[int] = frozenset(), markup: bool = True) -> str:
    """Text of the page's article without template subtrees (by their numbers): blocks in page order, one per line.

    markup=False leaves out the remainder: of the whole page only templates and
    what is never shown go. A page whose blocks all have telling names is kept
    without regard to the names.
    """
    tree = parse(source, hashed=False)
    roots = _mark(tree)
    gone = {id(n) for i, n in enumerate(_offer(tree, roots)) if i in template} if template else set()
    if not markup:
        return _text([tree], gone, tree.size, False, False)
    return _text(roots or [tree], gone, tree.size, True, True) or ("" if roots else _text([tree], gone, tree.size, True, False))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, print, template: for each different page the numbers of its subtrees that recur on its host, for pages(host, print, html).

    Pages of equal html (print) count once. Templates meet the subtrees of pages
    as rows of (host, sig), so no host's templates are ever in one list. Counts
    combine before they are shuffled, so a host with a third of all pages is
    counted like any other. The hashes are staged: pages are parsed once for
    them, and once for their text. Hosts are told apart by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            at, numbers, sigs, first = [], [], [], []
            for i, page in enumerate(part.column("html").to_pylist()):
                seen: set[int] = set()
                for number, sig in subtrees(page):
                    at.append(i)
                    numbers.append(number)
                    sigs.append(sig)
                    first.append(sig not in seen)
                    seen.add(sig)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("host").take(at), part.column("print").take(at), pa.array(numbers, pa.int32()), pa.array(sigs, pa.int64()), pa.array(first, pa.bool_())], ["host", "print", "number", "sig", "first"])

    pages = pages.filter(F.length("html") > 0)
    found = staged(pages.mapInArrow(run, "host bigint, print bigint, number int, sig bigint, first boolean").distinct(), "subtrees")
    total = pages.select("host", "print").distinct().groupBy("host").agg(F.count("*").alias("total"))
    often = found.filter("first").groupBy("host", "sig").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    often = often.join(total, "host").filter(F.col("pages") >= F.log2("total")).select("host", "sig")
    return found.select("host", "print", "number", "sig").join(often, ["host", "sig"]).groupBy("host", "print").agg(F.collect_set("number").alias("template"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", markup: bool = True) -> DataFrame:
    """pages without the html, with text (string, empty if none) and n_chars (long).

    One row per input row. A null html is an empty page, a null url the host "";
    an empty table gives an empty one. Equal rows have equal results and count
    as one page, ties of counts don't matter. Columns named text or n_chars are
    replaced, others kept whatever their names.
    """
    fields = [f for f in pages.schema.fields if f.name != html and f.name.lower() not in ("text", "n_chars")]
    source = pages.select(*kept(fields), F.xxhash64(host(col(url))).alias("host"), F.xxhash64(col(html)).alias("print"), col(html).alias("html"))
    # A page copied many times is one key of this join, whose hot keys Spark splits.
    joined = source.join(templates(source.select("host", "print", "html")), ["host", "print"], "left").drop("host", "print")
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            texts = [main_text(p or "", frozenset(t or ()), markup) for p, t in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)
