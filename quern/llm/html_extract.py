"""Main text of web pages by consensus host paths.

Each page's containers are scored by the prose they hold (length and commas of blocks,
less what is link text, and hints in tag and class names); the page votes for the path
of its best container. A path is the tags from the body down with their classes,
digits generalised, so pages of one template vote alike. Votes are summed per host and
path, beside the pages that have prose under the path. A path is trusted if at least
half of the pages that have it vote for it. A page whose own path is trusted and has
`ENOUGH` votes is extracted from it, whatever its rank among the host's; another from
the trusted path with most votes that it has, of those with a `SHARE` of the host's
votes; a page that has none uses its own best. So a template of few pages is not read
from what it shares with the host's larger ones.

Inside the container, navigation, headers, footers, asides, forms, hidden elements, adverts,
notices by name and reader comments are left out. Names that an article's own sections may
have too (legal, discussion, related, tags) take an element out only if no paragraph in it is
prose. Outside articles also unnamed lists and divs of nothing but links before or after the
prose go. Blocks are what block-level tags separate; `br` is white space. A head ends at the
first element or text that does not belong there, and a tag without its `>` runs to the end,
as in a browser. Paths are kept as digests, so deep pages take linear time and space.

Votes are summed before the shuffle, the paths of a host that go back are as
many as shares fit into its votes, and the tables of winners and trusted paths are
broadcast only if a count shows them small, so a host that holds a third of all pages
is no hot task.

Nulls: null html is an empty page with empty text; pages without a host do not vote and use
their own best. A null id or url stays null. Repeated rows are extracted each. A page of markup
without prose gives empty text, and an empty table no rows. Ties go to the element that comes
first, and among paths to the least digest. Columns other than the three are not carried.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import as_long, keep, lean, small

#: Votes from which a page's own path is not a chance.
ENOUGH = 3
#: Share of a host's votes from which a path stands in for pages whose own path is not trusted.
SHARE = 0.01

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes in which every quote is closed before the next tag; others end at the next `>`.
ATTRS = re.compile(r"(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body blockquote center div main section table td".split())
SKIP = frozenset("script style noscript template nav footer aside form button select option input textarea iframe object svg canvas audio video dialog menu head title label fieldset map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}
ENDS_P = BLOCK - {"body", "html", "caption", "dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

BAD = re.compile(
    r"(?:^|[-_ ])(?:ads?|adbox|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscri\w*|signup|login|paywall"
    r"|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|aside|widgets?|related\w*|recommend\w*|more-stories|trending|share\w*|sharing|social\w*|follow|footer\w*|foot|masthead|site-?header|page-?header|topbar|toolbar"
    r"|comments?\w*|disqus|respond|repl(?:y|ies)|discussion|reactions?|pagination|pager|tags|tag-?cloud|copyright|legal|disclaimer|skip-?link|search\w*|hidden|sr-only|visually-hidden|outbrain|taboola|byline-?bio|author-?bio)(?:$|[-_ ])",
    re.IGNORECASE,
)
#: Names of what is no part of an article whatever it holds; by the others above an element inside one goes only if it holds no prose.
NEVER = re.compile(
    r"(?:^|[-_ ])(?:ads?|adbox|advert|adverts|advertisement|advertising|adsense|sponsored|cookies?|consent|gdpr|newsletter|subscribe|signup|paywall|navbar|navigation|breadcrumbs?|side-?bar"
    r"|comments?|comment-?(?:list|form|section|thread)|disqus|respond|outbrain|taboola|skip-?link|sr-only|visually-hidden)(?:$|[-_ ])",
    re.IGNORECASE,
)
#: Characters outside links from which a paragraph counts as prose.
PROSE = 140
GOOD = re.compile(r"(?:^|[-_ ])(?:article\w*|content\w*|post\w*|entry\w*|story\w*|main\w*|body\w*|text\w*|page-?content|prose|blog\w*|h?news)(?:$|[-_ ])", re.IGNORECASE)
DIGITS = re.compile(r"[0-9]+")
SPACES = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    classes: str
    hint: str
    hidden: bool
    up: Node | None
    order: int
    path: str = ""
    score: float = 0.0
    prose: bool = False


@dataclass
class Block:
    node: Node
    text: str
    linked: int


def _attributes(s: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTR.findall(s)}


def _tokens(page: str):
    """(kind, value, attributes) of a page in order: text, open, close; comments and declarations are left out.

    As in a browser, what follows a `<` that starts a tag and meets no `>` is part of that tag.
    A raw element's content is skipped, its tag is given. Linear in the page.
    """
    at = start = 0
    n = len(page)
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        closing = after == "/"
        name = NAME.match(page, lt + 1 + closing)
        if not name and after not in ("!", "?"):
            at = lt + 1  # a mark in the text
            continue
        if lt > start:
            yield "text", page[start:lt], ""
        if name:
            exact = None if closing else ATTRS.match(page, name.end())
            end = exact.end() if exact else page.find(">", name.end()) + 1
            tag = name[0].lower()
            if end:
                yield "close" if closing else "open", tag, page[name.end() : end - 1]
            if end and tag in RAW and not closing:
                close = RAW_END[tag].search(page, end)
                end = page.find(">", close.end()) + 1 if close else 0
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 2) + 3
            end = 0 if end == 2 else end
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt) + 3
            end = 0 if end == 2 else end
        else:
            end = page.find(">", lt) + 1
        start = at = end or n
        if not end:
            return
    if start < n:
        yield "text", page[start:], ""


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements in page order, parents before their children, and the text blocks, each under its innermost element."""
    root = Node("html", "", "", False, None, 0)
    nodes, blocks, stack = [root], [], [root]
    count: dict[str, int] = {}  # open elements by tag
    buffer: list[str] = []
    owner, linked = root, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACES.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                blocks.append(Block(owner, text, min(linked, len(text))))
        linked = 0

    def cut(size: int) -> None:
        for x in stack[size:]:
            count[x.tag] -= 1
        del stack[size:]

    def add(text: str) -> None:
        nonlocal owner, linked
        if not buffer:
            if not text.strip():
                return
            owner = next(x for x in reversed(stack) if x.tag in BLOCK or x.tag in SKIP or x.hidden or x.up is None)
        text = html.unescape(text) if "&" in text else text
        buffer.append(text)
        if any(x.tag == "a" for x in stack[-4:]):
            linked += len(text.strip())

    for kind, tag, rest in _tokens(page):
        if stack[-1].tag == "head" and (kind == "text" and tag.strip() or kind == "open" and tag not in IN_HEAD):
            flush()
            cut(len(stack) - 1)  # a head ends with the first thing that is none of its own
        if kind == "text":
            add(tag)
        elif kind == "open":
            if tag == "br":
                buffer.append(" ") if buffer else None
                continue
            if tag in BLOCK:
                flush()
            if tag in ("html", "body") and count.get(tag):
                continue
            if tag in ENDS_P and count.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        cut(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
            if tag in SAME and any(count.get(x) for x in SAME[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in FENCE[tag]:
                        break
                    if stack[i].tag in SAME[tag]:
                        cut(i)
            elif tag in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            if tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
                continue
            attrs = _attributes(rest) if rest else {}
            classes = " ".join(sorted(attrs.get("class", "").split()))
            hint = f"{classes} {attrs.get('id', '')} {attrs.get('role', '')}".strip()
            style = attrs.get("style", "").replace(" ", "").lower()
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
            node = Node(tag, classes, hint, hidden, stack[-1], len(nodes))
            nodes.append(node)
            if tag not in RAW:
                stack.append(node)
                count[tag] = count.get(tag, 0) + 1
        else:
            if tag in BLOCK:
                flush()
            if tag in ("html", "body") or not count.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in CONTAINER and tag not in BLOCK:
                    break
                if stack[i].tag in ("article", "main", "section", "body", "table") and tag in ("p", "li", "b", "i"):
                    break
    flush()
    return nodes, blocks


def _step(node: Node) -> str:
    return DIGITS.sub("#", node.tag + ("." + ".".join(node.classes.split()) if node.classes else ""))


def path_of(node: Node) -> str:
    """A digest of the steps from the root down: equal for equal paths, and short however deep a page is."""
    line, x = [], node
    while x is not None and not x.path:
        line.append(x)
        x = x.up
    for x in reversed(line):
        before = x.up.path if x.up is not None else ""
        x.path = hashlib.blake2b(f"{before}>{_step(x)}".encode(), digest_size=8).hexdigest()
    return node.path


def _holds(node: Node) -> bool:
    """Whether an element may hold a page's main text; the root does where nothing else is there."""
    return node.tag in CONTAINER or node.up is None


def _boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element and all under it is left out; inside: it lies in the container that was chosen."""
    if node.tag in SKIP or node.hidden or node.tag == "header":
        return True
    if not node.hint or node.tag in ("body", "html", "article", "main") or not BAD.search(node.hint):
        return False
    return not GOOD.search(node.hint) if not inside else not node.prose or bool(NEVER.search(node.hint))


def best_container(nodes: list[Node], blocks: list[Block]) -> Node | None:
    """The container whose prose scores most; a parent gets a share of what its children get."""
    left: list[bool] = []
    for x in nodes:
        left.append((x.up is not None and left[x.up.order]) or _boilerplate(x, False))
    worths = [0.0] * len(nodes)
    for b in blocks:
        x = b.node
        if len(b.text) - b.linked >= PROSE:
            while x is not None and not x.prose:
                x.prose, x = True, x.up
        if left[b.node.order]:
            continue
        paragraph = b.node.tag in ("p", "pre", "blockquote")
        worth = ((len(b.text) - b.linked) / 100 + b.text.count(",") * 0.5 + paragraph) * (1 - b.linked / len(b.text))
        worths[b.node.order] += worth if len(b.text) >= 25 or paragraph else 0.3 * worth
    for x in reversed(nodes):
        worth = worths[x.order]
        if worth and _holds(x):
            x.score = worth
            worth *= 0.6 if x.tag not in ("article", "main") else 0.3
        if x.up is not None:
            worths[x.up.order] += worth
    scored = [x for x in nodes if x.score > 0]
    if not scored:
        return None
    best = max(scored, key=lambda x: (x.score * (1.25 if x.tag in ("article", "main") or x.hint and GOOD.search(x.hint) else 1.0), -x.order))
    up = best.up
    while up is not None:  # an article's title and text belong together
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.up
    return best


def _is_links(b: Block) -> bool:
    return b.linked >= 0.9 * len(b.text) and len(b.text) < 80


def _menus(kept: list[Block], top: Node, fenced: dict[int, bool], lists: dict[int, Node]) -> set[int]:
    """Places in kept of the blocks of menus without a name: whole lists or divs of links before or after the prose.

    An article, a table cell, a list amid the prose or under a heading after it, and anything with a class or id holds its links as content.
    """
    if top.tag in ("article", "main") or top.hint and GOOD.search(top.hint):
        return set()
    prose = [i for i, b in enumerate(kept) if not _is_links(b) and (b.node.tag in ("p", "pre", "blockquote") or len(b.text) >= 80) and b.linked < 0.5 * len(b.text)]
    first, last = (prose[0], prose[-1]) if prose else (len(kept), -1)
    said: set[int] = set()  # elements that hold more than links
    for b in kept:
        x = None if _is_links(b) else b.node
        while x is not None and x is not top and x.order not in said:
            said.add(x.order)
            x = x.up
    out: set[int] = set()
    under = {}  # whether a menu's first block follows a heading after the prose began
    for i, b in enumerate(kept):
        if first < i < last or b.node.tag not in ("li", "div", "ul", "ol") or not _is_links(b) or fenced.get(b.node.order):
            continue
        group = lists.get(b.node.order, b.node)
        if group.order not in under:
            under[group.order] = i > first and i > 0 and kept[i - 1].node.tag in HEADINGS
        if group is not top and not group.hint and group.order not in said and not under[group.order]:
            out.add(i)
    return out


def text_of(nodes: list[Node], blocks: list[Block], tops: list[Node]) -> str:
    """The text under some elements, none of them inside another, in page order."""
    owner: dict[int, Node] = {x.order: x for x in tops}
    left, header, fenced = (dict.fromkeys(owner, False) for _ in range(3))
    lists: dict[int, Node] = {}  # the outermost list that each element is in
    for x in nodes:
        if x.order in owner or x.up is None or x.up.order not in owner:
            continue
        up = x.up.order
        owner[x.order] = owner[up]
        left[x.order] = left[up] or _boilerplate(x, True)
        header[x.order] = header[up] or x.tag == "header"
        fenced[x.order] = fenced[up] or x.tag in ("td", "th", "article", "main")
        if up in lists or x.tag in ("ul", "ol"):
            lists[x.order] = lists.get(up, x)
    kept: dict[int, list[Block]] = {x.order: [] for x in tops}
    for b in blocks:
        k = b.node.order
        if k in owner and (not left[k] or header[k] and b.node.tag in HEADINGS and not (b.node.hint and BAD.search(b.node.hint))):
            kept[owner[k].order].append(b)
    out = []
    for x in tops:
        menus = _menus(kept[x.order], x, fenced, lists)
        out += [b.text for i, b in enumerate(kept[x.order]) if i not in menus]
    return "\n".join(out)


@dataclass
class Page:
    """A page's elements and blocks, and its best container if it has prose."""

    nodes: list[Node]
    blocks: list[Block]
    best: Node | None

    @staticmethod
    def read(page: str) -> Page:
        nodes, blocks = parse(page)
        return Page(nodes, blocks, best_container(nodes, blocks))

    def under(self, path: str) -> str:
        """The text under all elements of a path: one of several elements, as of list entries, is the main text only all together."""
        return text_of(self.nodes, self.blocks, [x for x in self.nodes if _holds(x) and path_of(x) == path])

    def alone(self) -> str:
        return text_of(self.nodes, self.blocks, [self.best]) if self.best is not None else ""

    def own(self) -> str:
        return self.best and self.under(path_of(self.best)) or self.alone()

    def of(self, winners: list[str]) -> str:
        """The text under the first path that has any, else of the best container."""
        return next((t for t in map(self.under, winners if self.best is not None else ()) if t), "") or self.alone()


def vote(page: str) -> tuple[str, float, set[str]] | None:
    """The path of the best container, its score, and all paths that have prose on the page."""
    return _vote(Page.read(page))


def _vote(page: Page) -> tuple[str, float, set[str]] | None:
    return (path_of(page.best), page.best.score, {path_of(x) for x in page.nodes if x.score > 0}) if page.best is not None else None


def extract(page: str, winners: list[str], own: bool = False) -> str:
    """The text under the page's elements of its best container's path if own, else of the first path of winners that it has."""
    return Page.read(page).own() if own else Page.read(page).of(winners)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE) -> DataFrame:
    """page_id, url, text of every row.

    A page is read once, and votes with the text that it has under its own path. Only pages whose own path
    turns out not to be trusted are read again.
    """
    slim = pages.select(as_long(pages, id_col).alias("page_id"), pages[url_col].cast("string").alias("url"), host_of(pages[url_col]).alias("host"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    slim = slim.withColumn("hash", F.xxhash64("url", "html"))
    kinds = {"page_id": pa.int64(), "url": pa.string(), "hash": pa.int64(), "host": pa.string(), "text": pa.string(), "path": pa.string(), "score": pa.float64(), "paths": pa.list_(pa.string())}

    def cast_votes(batches):
        for batch in batches:
            rows = []
            for host, markup in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                page = Page.read(markup)
                path, score, paths = host and _vote(page) or (None, None, [])
                rows.append((page.own() if path else page.alone(), path, score and round(score, 3), list(paths)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(list(kinds.values())[4:]))], names=list(kinds))

    schema = "page_id long, url string, hash long, host string, text string, path string, score double, paths array<string>"
    read = keep(slim.select("page_id", "url", "hash", "host", "html").mapInArrow(lean(cast_votes), schema), "html-read")
    on_page = read.where("path IS NOT NULL").select("host", "score", "path", F.explode("paths").alias("on"))
    mine = F.col("path") == F.col("on")
    cast = on_page.groupBy("host", F.col("on").alias("path")).agg(F.sum(mine.cast("long")).alias("votes"), F.count(F.lit(1)).alias("pages"), F.sum(F.when(mine, F.col("score").cast("decimal(30,3)"))).alias("score"))
    votes = keep(cast.where("votes > 0"), "html-votes")
    trusted = votes.where("2 * votes >= pages")
    # at most 1 / share paths a host
    most = votes.groupBy("host").agg((F.sum("votes") * share).alias("least"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), (-F.col("score")).alias("score"), "path")))
    winners = keep(trusted.join(most, "host").where("votes >= least").groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("winners")), "html-winners")
    known = keep(trusted.where(F.col("votes") >= ENOUGH).select("host", "path", F.lit(True).alias("own")), "html-trusted")

    def again(batches):
        for batch in batches:
            texts = [Page.read(p).of(w or []) for p, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    told = read.drop("paths").join(small(known), ["host", "path"], "left")
    done = told.where("path IS NULL OR own").select("page_id", "url", "text")
    doubtful = keep(told.where("path IS NOT NULL AND own IS NULL").select(F.col("page_id").alias("id"), F.col("hash").alias("of")).distinct(), "html-doubtful")
    side = small(doubtful)
    rest = slim.join(side, slim["page_id"].eqNullSafe(side["id"]) & (slim["hash"] == side["of"]), "left_semi").join(small(winners), "host", "left")
    return done.unionByName(rest.select("page_id", "url", "html", "winners").mapInArrow(lean(again), "page_id long, url string, text string"))


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("*", F.length("text").cast("long").alias("n_chars"))


SQL = None
