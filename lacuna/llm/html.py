"""Main text of web pages by site-template removal.

Pages are parsed into element trees. Each block's subtree (tags and text) is hashed; Spark counts on how many different articles
of its host every hash occurs; subtrees that recur on many are deleted: menus, footers, boxes and notices, whatever they are
called, outside the article and inside it. What one page says about itself goes too: scripts, styles, forms, elements of
navigation, and containers whose role, class or id names a menu, an advert, a notice or reader comments, unless they hold the
article (or, where the page marks none, most of its text). Inside an article a name counts only as a whole: "ad-box" or "cookie-notice" are of
such words alone, "ad-hoc-analysis" and "page-header" aren't. The article, if the page marks one, is what is left of it; else what
is left of the body.

Outside articles what counts as many is a number of articles, so a box on 40,000 of a million pages is found as well as one on 4 of 9; on hosts
with few pages it is a share. Inside them a box has to be on half of the host's articles, or on a tenth and at nearly all of them the first
or the last of what it stands in, as notices and adverts are; what a few articles share, wherever, is theirs. Pages with the same text are one article, so that an article copied many times, under one address or many,
is no template. Paragraphs, headings, lists and tables are part of an article even if many articles have them; they are
templates only if nearly all different articles of the host do.

Counts cover all pages. Templates go to the executors as a broadcast while there are at most BROADCAST of them; beyond that they
are joined to the pages, with the same result.

Cases. Null or empty html: an empty text. Null url, or one without a host: the host "". Html of any length is read whole, in one
pass; what is left open at its end is closed, and a tag that the end cuts is no text. Repeated rows give the same text each. Ties:
a subtree exactly at the thresholds is deleted. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut

#: A subtree is a template of its host if it is on as many different articles; on hosts with few, if on such a share, but on LEAST_PAGES.
MANY_PAGES = 12
LEAST_PAGES = 4
#: The share for containers outside an article, and for those inside one.
OUTER_SHARE = 0.3
INNER_SHARE = 0.5
#: Inside an article: the share that is enough, on MANY_PAGES at least, for what is first, or last, of its siblings on such a share of its articles.
EDGE_SHARE = 0.1
EDGE_PLACES = 0.9
#: Paragraphs, lists and the like: on this share of all articles of the host, whatever their number, and on PROSE_PAGES.
PROSE_SHARE = 0.8
PROSE_PAGES = 10
#: Where a subtree stands: outside the article, inside it, or prose.
OUTER, INNER, PROSE = 0, 1, 2
#: Most templates that are broadcast; 16 bytes each and the hosts' names.
BROADCAST = 100_000

#: The rest of a tag: what stands between its name and the closing bracket. Nothing is tried twice.
_REST = r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>"""
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
#: A text, or a whole tag.
_TOKEN = re.compile(rf"([^<]++)|<(/?[a-zA-Z][^\s/>]*+){_REST}")
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}", re.I) for t in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CELL = frozenset(("td", "th"))
_GONE = frozenset("head script style noscript template svg math nav footer aside form button select textarea input iframe object embed applet audio video canvas dialog menu title xmp noembed noframes".split())
#: Those that hold no article even if their content looks like one.
_NEVER = _GONE - {"form"}
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Parts of class and id names that say what a container is.
_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments commentlist disqus replies respond related recommended share sharing social newsletter subscribe subscription popup modal overlay "
    "widget widgets toolbar pagination pager login signup skip paywall".split()
)
#: Parts of names that say nothing of what a container holds.
_PLAIN = frozenset("bar box block button buttons container inner link links list section slot text top bottom left right unit wrap wrapper".split())
_COMMENTS = frozenset("comment comments reply".split())
_HEADER = frozenset("header topbar".split())
_OWN = frozenset("article entry post story content".split())
#: Elements that these end when they begin inside them.
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption".split())


def _telling(name: str) -> bool:
    """Whether a class or id inside an article says by all of its parts that it is no part of it."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    return any(x in _NAMES for x in parts) and all(x in _NAMES or x in _PLAIN for x in parts)


class Node:
    __slots__ = ("tag", "names", "gone", "hidden", "parts", "inside", "kind")

    def __init__(self, tag: str, attrs: str, inside: bool = False):
        self.tag, self.parts, self.inside = tag, [], inside  # inside an article
        self.names: frozenset[str] = frozenset()
        self.gone, self.hidden = tag in _GONE, False
        self.kind = tag if tag == "article" or tag == "main" else ""  # what it marks
        if attrs and "=" in attrs or "hidden" in attrs:
            names: list[str] = []
            whole: list[str] = []
            for m in _ATTR.finditer(attrs):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key in ("class", "id"):
                    whole += value.split()
                    names += re.split(r"[\s_-]+", value)
                elif key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.gone = True
                    self.hidden |= key != "role"
                elif key == "role" and value in ("article", "main"):
                    self.kind = self.kind or value
            self.names = frozenset(names)
            if tag in ("html", "body", "main"):
                pass
            elif inside and tag != "article":
                self.gone |= any(_telling(x) for x in whole)
            elif tag != "article" and (self.names & _NAMES or self.names & _HEADER and not self.names & _OWN):
                self.gone = True
            elif tag == "article" and self.names & _COMMENTS:
                self.gone = True


def _tokens(page: str):
    """(what, value, attributes) of the page: text, the name of a tag that begins (or, after "/", ends), or raw text's end. One
    pass: every character is read once, but for what follows a quote that never closes."""
    at, end, token = 0, len(page), _TOKEN.match
    while at < end:
        m = token(page, at)
        if m:
            at = m.end()
            if m.lastindex == 1:
                yield "text", m[1], ""
                continue
            tag = m[2].lower()
            yield "tag", tag, m[3]
            if tag in _RAW:
                close = _RAW_END[tag].search(page, at)
                at = page.find(">", close.end()) + 1 if close else 0
                at = at or end  # the first end tag is the end, if it is closed
        elif page[at + 1 : at + 2] in ("!", "?"):
            if page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                at = end if close < 0 else close + 3
            elif page.startswith("<![CDATA[", at):
                close = page.find("]]>", at + 9)
                yield "text", page[at + 9 : end if close < 0 else close], ""
                at = end if close < 0 else close + 3
            else:
                close = page.find(">", at + 1)
                at = end if close < 0 else close + 1
        elif _NAME.match(page, at + 1):  # a tag that the page's end cuts is no text
            return
        else:
            yield "text", "<", ""
            at += 1


#: Where a tag stands among the open ones: 0 inline, 1 a paragraph, 2 anything else.
_RANK = dict.fromkeys(_INLINE, 0) | {"p": 1}


def parse(page: str) -> Node:
    """The tree of a page. Where the last of each name is open, and the last that isn't inline, is known, so no tag looks through the open ones."""
    root = Node("#root", "")
    stack, at = [root], {}
    block, wall = [0], [0]  # for each: the last place up to it that isn't inline; that is neither inline nor p
    text = root.parts.append

    def last(names) -> int:
        """The place of the last open element of these names; 0 if there is none."""
        return max((at[x][-1] for x in names if at.get(x)), default=0)

    for what, name, attrs in _tokens(page):
        if what == "text":
            text(name)
            continue
        cut = 0
        if name[0] == "/":
            name = name[1:]
            open_ = at.get(name)
            if not open_ or _RANK.get(name, 2) == 0 and open_[-1] < wall[-1]:  # an inline end tag closes nothing beyond its block
                continue
            cut = open_[-1]
            new = False
        else:
            new = True
            if name in _P_ENDS:
                cut = block[-1] if stack[block[-1]].tag == "p" else 0
            elif name in _SAME:
                ends, bounds = _SAME[name]
                cut = last(ends)
                cut = cut if cut > last(bounds) else 0
            elif name == "body":  # ends an open head
                cut = last(("head",))
        if cut:
            for node in stack[cut:]:
                at[node.tag].pop()
            del stack[cut:], block[cut:], wall[cut:]
        above = stack[-1]
        if new:
            node = Node(name, attrs, above.inside or above.kind != "")
            above.parts.append(node)
            if name not in _VOID and name not in _RAW and not attrs.endswith("/"):
                i, rank = len(stack), _RANK.get(name, 2)
                if name in at:
                    at[name].append(i)
                else:
                    at[name] = [i]
                block.append(i if rank else block[-1])
                wall.append(i if rank == 2 else wall[-1])
                stack.append(node)
                above = node
        text = above.parts.append
    return root


def nodes_of(root: Node) -> list[Node]:
    """Every node, parents first; gone subtrees are entered too."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def subtree_hashes(order: list[Node]) -> dict[int, int]:
    """64-bit hash of each container's subtree by id(node), children before parents; without recursion."""
    out: dict[int, int] = {}
    plain = _SPACE.sub
    for node in reversed(order):
        told = [node.tag.encode()]
        for x in node.parts:
            told.append(out[id(x)].to_bytes(8, "little") if isinstance(x, Node) else plain(" ", x).encode("utf-8", "surrogatepass"))
        out[id(node)] = xxhash.xxh64_intdigest(b"".join(told))
    return out


def _holds_main(order: list[Node]) -> set[int]:
    """Nodes that are or hold an article or main element, the page's own elements included: never templates."""
    out: set[int] = set()
    for node in reversed(order):
        if node.kind or node.tag in ("#root", "html", "body") or any(isinstance(x, Node) and id(x) in out for x in node.parts):
            out.add(id(node))
    return out


def _spare(root: Node) -> None:
    """Containers marked as gone by name, role or form tag aren't, if they hold the article or, where the page marks none, over half of
    the text. An article of less than half the length of the page's longest is none here: boxes of related pages hold such teasers.
    Nor are comments that are marked as articles, and what is hidden."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not (node.hidden or node.gone and node.tag in _NEVER):
            order.append(node)
            todo += [x for x in node.parts if isinstance(x, Node)]
    size: dict[int, int] = {}
    for node in reversed(order):
        size[id(node)] = sum(size.get(id(x), 0) if isinstance(x, Node) else len(x.strip()) for x in node.parts)
    found = [n for n in order if n.kind and not (n.gone and n.names & _COMMENTS)]
    least = max((size[id(n)] for n in found), default=0) / 2
    holds = {id(n) for n in found if size[id(n)] >= least}
    for node in reversed(order):
        if any(isinstance(x, Node) and id(x) in holds for x in node.parts):
            holds.add(id(node))
    for node in order:
        if node.gone and (id(node) in holds if holds else 2 * size[id(node)] > size[id(root)]):
            node.gone = False


def _edges(root: Node) -> dict[int, int]:
    """By id(node): 1 for the first of its siblings, 2 for the last, 3 for one alone; text counts as a sibling, white space doesn't."""
    out: dict[int, int] = {}
    todo = [root]
    while todo:
        parts = todo.pop().parts
        for bit, ordered in ((1, parts), (2, reversed(parts))):
            for x in ordered:
                if isinstance(x, Node):
                    out[id(x)] = out.get(id(x), 0) | bit
                    break
                if not x.isspace():
                    break
        todo += [x for x in parts if isinstance(x, Node)]
    return out


_NO_TEMPLATE = _INLINE | _VOID | _RAW


def candidates(root: Node) -> list[tuple[Node, int, int]]:
    """Subtrees that may be templates: (node, where it stands, hash)."""
    order = nodes_of(root)
    hashes, kept = subtree_hashes(order), _holds_main(order)
    fit = [n for n in order if n.parts and n.tag not in _NO_TEMPLATE and id(n) not in kept]
    return [(n, PROSE if n.tag in _PROSE else INNER if n.inside else OUTER, hashes[id(n)]) for n in fit]


def main_text(page: str, templates=None) -> str:
    """The blocks of the page's article. templates: by where they stand, the hashes of the subtrees to delete."""
    root = parse(page)
    _spare(root)
    if templates and any(templates):
        for node, where, h in candidates(root):
            if h in templates[where]:
                node.gone = True
    return text_of(root)


def text_of(root: Node) -> str:
    """The blocks of the article in a tree."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(root, frozenset())]
    while todo:
        node, above = todo.pop()
        if node.gone:
            continue
        kind = node.kind
        if kind and kind not in above:
            found[kind].append(node)
        above = above | {kind}
        todo += [(x, above) for x in reversed(node.parts) if isinstance(x, Node)]
    tops = found["article"] or found["main"] or [root]
    blocks: list[str] = []
    line: list[str] = []

    def end():
        if line:
            text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
            if text:
                blocks.append(text)
            line.clear()

    for top in tops:
        stack: list = [("open", top)]
        while stack:
            what, x = stack.pop()
            if what == "text":
                line.append(x)
            elif what == "close":
                if x.tag in _CELL:
                    line.append(" ")
                else:
                    end()
            elif x.tag == "br" or x.tag == "wbr":
                line.append(" " if x.tag == "br" else "")
            elif not x.gone and not (x.tag == "header" and x is not top and not found["article"]):
                inline = x.tag in _INLINE
                if not inline:
                    if x.tag in _CELL:
                        line.append(" ")
                    else:
                        end()
                    stack.append(("close", x))
                stack += [("open" if isinstance(p, Node) else "text", p) for p in reversed(x.parts)]
            elif x.tag not in _INLINE:
                end()
        end()
    return "\n\n".join(blocks)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _rows(batches):
    """url, html -> host, version, hash, place, edge: the subtrees of a page, once a batch for each different article, and a row with hash
    null for the article itself. Pages whose text is the same are one article. edge: at which ends it stands wherever it is on the page."""
    for b in batches:
        seen: dict[tuple, int] = {}
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            host, root = host_of(url), parse(page or "")
            edges = _edges(root)
            found = [(h, where, edges.get(id(n), 0)) for n, where, h in candidates(root)]
            _spare(root)
            version = xxhash.xxh64_intdigest(text_of(root).encode("utf-8", "surrogatepass")) - 2**63
            seen[host, version, None, OUTER] = 0
            for h, where, edge in found:
                key = (host, version, h - 2**63, where)
                seen[key] = seen.get(key, 3) & edge
        columns = [*zip(*((*k, e) for k, e in seen.items()))] or [[]] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "version", "hash", "place", "edge"])


def templates(pages: DataFrame) -> DataFrame:
    """host, hash, place: subtrees that recur on many articles of their host."""
    rows = pages.select("url", "html").mapInArrow(_rows, "host string, version long, hash long, place int, edge int")
    rows = rows.groupBy("host", "version", "hash", "place").agg(F.bit_and("edge").alias("edge"))
    at = lambda bit: F.count_if(F.col("edge").bitwiseAND(bit) > 0).alias(f"at{bit}")
    counts = cut(rows.groupBy("host", "hash", "place").agg(F.count(F.lit(1)).alias("n"), at(1), at(2)))
    hosts = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    share = lambda x: F.ceil(F.round(x * F.col("pages"), 6))
    n, edge = F.col("n"), F.greatest("at1", "at2") >= EDGE_PLACES * F.col("n")
    outer = n >= F.least(F.lit(MANY_PAGES), F.greatest(F.lit(LEAST_PAGES), share(OUTER_SHARE)))
    inner = (n >= F.greatest(F.lit(LEAST_PAGES), share(INNER_SHARE))) | (edge & (n >= F.greatest(F.lit(MANY_PAGES), share(EDGE_SHARE))))
    prose = n >= F.greatest(F.lit(PROSE_PAGES), share(PROSE_SHARE))
    many = F.when(F.col("place") == OUTER, outer).when(F.col("place") == INNER, inner).otherwise(prose)
    few = counts.where(F.col("hash").isNotNull() & (F.col("n") >= LEAST_PAGES))
    return few.join(hosts, "host").where(many).select("host", "hash", "place")


_SCHEMA = "page_id long, url string, text string, n_chars long"


def _extracted(b: pa.RecordBatch, sets) -> pa.RecordBatch:
    texts = [main_text(page or "", t) for page, t in zip(b.column(2).to_pylist(), sets)]
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars."""
    spark = pages.sparkSession
    found = cut(templates(pages))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    if found.limit(broadcast + 1).count() <= broadcast:
        by_host: dict[str, tuple[set[int], ...]] = {}
        for host, h, place in found.collect():
            by_host.setdefault(host, (set(), set(), set()))[place].add(h + 2**63)
        shared = spark.sparkContext.broadcast(by_host)

        def run(batches):
            for b in batches:
                yield _extracted(b, (shared.value.get(host_of(u)) for u in b.column(1).to_pylist()))

        return base.mapInArrow(run, _SCHEMA)

    def hits(batches):
        for b in batches:
            out: Counter[tuple[int, str, int, int]] = Counter()
            for url, page, key in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                for _, where, h in candidates(parse(page or "")):
                    out[key, host_of(url), h - 2**63, where] = 1
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "host", "hash", "place"])

    def run_joined(batches):
        for b in batches:
            sets = [tuple({h + 2**63 for h in x[k] or ()} for k in "oip") if x else None for x in b.column(4).to_pylist()]
            yield _extracted(b, sets)

    keyed = base.withColumn("key", F.xxhash64("url", "html"))
    pairs = keyed.mapInArrow(hits, "key long, host string, hash long, place int").distinct()
    of = lambda place, name: F.collect_set(F.when(F.col("place") == place, F.col("hash"))).alias(name)
    own = pairs.join(found, ["host", "hash", "place"]).groupBy("key").agg(F.struct(of(OUTER, "o"), of(INNER, "i"), of(PROSE, "p")).alias("t"))
    return keyed.join(cut(own), "key", "left").select("page_id", "url", "html", "key", "t").mapInArrow(run_joined, _SCHEMA)


def op10_site_templates(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
