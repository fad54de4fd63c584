"""Main text of web pages, with the templates of each site removed.

A first pass hashes the element subtrees of every page that could be template parts, whatever their element or class says, and
Spark counts, for each host, on how many pages of different content each hash occurs. A second pass deletes the subtrees that
recur on many pages of their host; of what is left it takes away what its element or class says isn't content, which recurs too
seldom to be counted, as on hosts of few pages, and joins the remaining blocks.

An article must survive being served under several addresses, or being printed by several sites: pages count once by the hash of
their content (their articles and ``main``, or all of the page), whatever stands around it, and no subtree that holds half of a
page's text can be a template part. Inside an ``article`` or ``main`` only containers can be, never paragraphs, headings or the
like, as articles of one host may share sentences.

A template is on ``LEAST_PAGES`` of its host's pages, and on a share ``SHARE`` of them or on ``MANY_PAGES``. The lists of templates
are broadcast while there are few (``FEW``, counted first). Beyond that pages and lists are dealt to tasks by host, with the hosts
that hold over ``HOT`` of all pages (at most 1 / ``HOT``) dealt out by salt; a task reads each list once, ahead of its pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .urls import host_of

SHARE, LEAST_PAGES, MANY_PAGES, FEW, HOT, SALTS = 0.05, 5, 1000, 200_000, 0.01, 64
#: The share of a page's text from which a subtree is its content.
MASS = 0.5

# Element names by their roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head nav footer aside form script style textarea title noscript iframe template svg math menu dialog button select option input object audio video canvas".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ENDS_P = BLOCK - frozenset("body html li dt dd td th tr tbody thead tfoot caption legend summary".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|subscription|sidebar|breadcrumbs?|menu|navbar|navigation|nav|pagination|pager|comments?|disqus|replies|related|recommended|share|sharing|social|footer|masthead|site-header|topbar|toolbar|skip-link|widget|login|signup)(?:$|[\s_-])", re.I)
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|alertdialog|menu|menubar|toolbar)$", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


class Node:
    """An element: its children are nodes and strings (text, references decoded), in order.

    ``said`` is what its class, id and role say, ``marked`` whether that makes it boilerplate, ``hash`` that of its subtree and
    ``size`` the characters of its text that isn't boilerplate.
    """

    __slots__ = ("tag", "said", "marked", "children", "hash", "size")

    def __init__(self, tag: str, said: str = "", marked: bool = False):
        self.tag, self.said, self.marked, self.children, self.hash, self.size = tag, said, marked, [], 0, 0


def _said(raw: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether they or a hidden attribute mark it as not content."""
    if not raw or raw.isspace():
        return "", False
    found = {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "")
    return f"{names}|{role}", bool(MARKED.search(names) or ROLES.match(role) or "hidden" in found or found.get("aria-hidden") == "true")


def parse(text: str) -> Node:
    """The page's tree; missing end tags end where the next block, item or cell begins. Nesting has no limit.

    An end tag without its start, and a paragraph or item that begins, look back only to the nearest enclosing block, so that a
    page of many open elements is read in linear time; ``open_tags`` tells at once if there is anything to look for.
    """
    root = Node("#root")
    stack, at, size = [root], 0, len(text)
    open_tags: dict[str, int] = {}

    def cut(i: int) -> None:
        for node in stack[i:]:
            open_tags[node.tag] -= 1
        del stack[i:]

    while at < size:
        m = TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[:9] == "<![CDATA[":
                stack[-1].children.append(piece[9:].removesuffix("]]>"))
            elif piece[0] != "<" or piece == "<":
                stack[-1].children.append(entities.unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_tags.get(tag) else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag in INLINE_ENDS:
                    break
            continue
        if tag in ENDS_P and open_tags.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            own, scope = CLOSES[tag]
            own = own.split()
            for i in range(len(stack) - 1, 0, -1) if any(open_tags.get(x) for x in own) else ():
                if stack[i].tag in own:
                    cut(i)
                    break
                if stack[i].tag in scope:
                    break
        node = Node(tag, *_said(m[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not (m[3].endswith("/") and tag in BLOCK):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


#: End tags that do not reach out of an article or table.
INLINE_ENDS = frozenset("p b i em strong span a li".split())


def is_boilerplate(node: Node, inside: bool) -> bool:
    """Whether the element or its class says that it isn't content. A header inside an article is; so is an article or main
    whatever its class, unless it stands inside another one, like a reader's comment."""
    if node.tag in ("article", "main"):
        return inside and node.marked
    return node.tag in NEVER or (node.marked and node.tag not in ("html", "body")) or (node.tag == "header" and not inside)


def walk(root: Node, inside: bool = False) -> Iterator[tuple[Node, bool]]:
    """All elements below but raw ones, whatever their class says, in page order, and whether they stand in an article or main."""
    todo = [(c, inside) for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        node, inside = todo.pop()
        if node.tag in RAW:
            continue
        yield node, inside
        within = inside or node.tag in ("article", "main")
        todo += [(c, within) for c in reversed(node.children) if isinstance(c, Node)]


def measure(root: Node) -> None:
    """Hashes (white space apart) and sizes of all subtrees, from the leaves up."""
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        within = inside or node.tag in ("article", "main")
        todo += [(c, within) for c in node.children if isinstance(c, Node)]
    for node, inside in reversed(order):
        h, size, within = xxhash.xxh64(f"{node.tag}|{node.said}"), 0, inside or node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "big", signed=True))
                size += 0 if is_boilerplate(c, within) else c.size
            else:
                said = " ".join(c.split())
                h.update(said.encode("utf-8", "replace"))
                size += len(said)
        node.hash, node.size = h.intdigest() - (1 << 63), size


def content_roots(root: Node, drop: frozenset[int] = frozenset()) -> list[Node]:
    """The outermost articles and mains outside boilerplate and templates, in page order, or the whole page."""
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not (c.hash in drop and may_be_template(c, False, root.size)) and not is_boilerplate(c, False)]
    return found or [root]


def content_hash(roots: list[Node]) -> int:
    h = xxhash.xxh64()
    for node in roots:
        h.update(node.hash.to_bytes(8, "big", signed=True))
    return h.intdigest() - (1 << 63)


def may_be_template(node: Node, inside: bool, whole: int) -> bool:
    """Whether a block may go as a template part, in a page of ``whole`` characters of content."""
    if node.tag not in BLOCK or node.tag in ("html", "body", "article", "main") or node.size >= MASS * whole:
        return False
    return not (inside and node.tag in PROSE)


def blocks(root: Node, inside: bool, drop: frozenset[int], whole: int) -> list[str]:
    """Texts of the blocks that stay, in page order: white space joined, trimmed, not empty."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if own := " ".join("".join(line).split()):
            out.append(own)
        line.clear()

    todo: list = [*reversed([(c, inside) for c in root.children])]
    while todo:
        c, within = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            line.append(c)
        elif c.tag == "br":
            line.append(" ")
        elif c.tag in VOID:
            pass
        elif is_boilerplate(c, within) or (c.hash in drop and may_be_template(c, within, whole)):
            if c.tag in BLOCK:
                flush()
        else:
            if c.tag in BLOCK:
                flush()
                todo.append((None, within))
            inner = within or c.tag in ("article", "main")
            todo += [(x, inner) for x in reversed(c.children)]
    flush()
    return out


def main_text(page: str | None, drop: frozenset[int] = frozenset()) -> str:
    """The page's main text, without the template parts whose hashes are given."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    roots = content_roots(root, drop)
    whole = sum(x.size for x in roots)
    return "\n".join(t for x in roots for t in blocks(x, x is not root, drop, whole))


def page_hashes(page: str | None) -> tuple[int, list[int]]:
    """A hash of the page's content and the distinct hashes of its possible template parts."""
    if not page:
        return 0, []
    root = parse(page)
    measure(root)
    roots = content_roots(root)
    whole = sum(x.size for x in roots)
    return content_hash(roots), sorted({n.hash for n, inside in walk(root) if may_be_template(n, inside, whole)})


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, hash, n_pages) of the subtrees that recur on many pages of their host."""

    @F.pandas_udf("content long, parts array<long>")
    def hashed(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_hashes(t) for t in batch], columns=["content", "parts"])

    rows = pages.select(host_of(url).alias("host"), hashed(F.col(html)).alias("h")).select("host", "h.content", F.explode_outer(F.concat("h.parts", F.array(F.lit(None).cast("long")))).alias("hash"))
    counts = rows.distinct().groupBy("host", "hash").agg(F.count("*").alias("n_pages"))  # of a null hash: the host's pages
    counts = materialise(counts.filter(f"hash is null or n_pages >= {LEAST_PAGES}"), "subtrees")
    whole = counts.filter("hash is null").select("host", F.col("n_pages").alias("of"))
    many = F.col("n_pages") >= F.least(SHARE * F.col("of"), F.lit(MANY_PAGES))
    return counts.filter("hash is not null").join(whole, "host").filter(many).select("host", "hash", "n_pages")


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Per row: key, url, text, n_chars.

    A null or empty page has an empty text; pages with a null URL, or one without ://, share the empty host; repeated rows and
    pages of the same content count once as evidence for a template; rows with a null key stay; an empty table gives no rows;
    other columns are left out, so their names cannot clash.
    """
    found = materialise(templates(pages, url, html), "templates")
    picked = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    if found.count() <= FEW:
        done = _with_shared_lists(picked, found)
    else:
        done = _with_dealt_lists(picked, found)
    return done.select(F.col("key").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))


def _with_shared_lists(picked: DataFrame, found: DataFrame) -> DataFrame:
    """key, url, text, by a broadcast of all lists."""
    lists = found.groupBy("host").agg(F.collect_list("hash").alias("drop")).collect()
    shared = picked.sparkSession.sparkContext.broadcast({r.host: frozenset(r.drop) for r in lists})

    @F.pandas_udf("string")
    def text(page: pd.Series, host: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, shared.value.get(h, frozenset())) for p, h in zip(page, host)], dtype=object)

    return picked.select("key", "url", text("html", "host").alias("text"))


def _with_dealt_lists(picked: DataFrame, found: DataFrame) -> DataFrame:
    """key, url, text: each task reads a host's hashes ahead of its pages, so it holds one list at a time."""
    sizes = picked.groupBy("host").count()
    total = sizes.agg(F.sum("count")).first()[0]
    hot = [r.host for r in sizes.filter(F.col("count") > HOT * total).collect()]
    is_hot = F.col("host").isin(hot) if hot else F.lit(False)
    pages = picked.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("key", "url", F.length("html")), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = found.select("host", "hash").withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    both = pages.unionByName(spread, allowMissingColumns=True).withColumn("is_page", F.col("hash").isNull())
    dealt = both.repartition("host", "salt").sortWithinPartitions("host", "salt", "is_page")

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, drop = None, set()
        for batch in batches:
            out = []
            for k, u, page, host, salt, h, is_page in zip(*[batch[c] for c in ("key", "url", "html", "host", "salt", "hash", "is_page")]):
                if (host, salt) != place:
                    place, drop = (host, salt), set()
                if is_page:
                    out.append((k, u, main_text(page, drop)))
                else:
                    drop.add(int(h))
            yield pd.DataFrame(out, columns=["key", "url", "text"])

    # As text, a key and a hash keep all their digits beside nulls.
    kind = dict(picked.dtypes)["key"]
    texts = dealt.withColumns({"hash": F.col("hash").cast("string"), "key": F.col("key").cast("string")})
    done = texts.select("key", "url", "html", "host", "salt", "hash", "is_page").mapInPandas(text, "key string, url string, text string")
    return done.withColumn("key", F.col("key").cast(kind))
