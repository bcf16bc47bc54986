"""Main text of web pages: markup is read into a tree, and subtrees that a site repeats go.

A small reader turns html into elements and texts; it closes what html lets be left open, and
decodes character references. Elements that are never prose (scripts, styles, forms, menus,
sidebars, footers) and elements whose class, id or role says that they are furniture go first.

Then site templates: every element subtree that may be one is hashed (tag, attributes' names,
texts and children), and Spark counts on how many different pages of a host each hash occurs.
Pages with equal content count once, so copies of an article don't make it a template. A
subtree found on at least ``MANY`` pages and a ``SHARE`` of the host's pages is deleted.
Headings, paragraphs and other prose are no candidates by themselves inside an article, since
articles quote the same passages; the containers around them are. Outside an article prose
goes only if ``PROSE_SHARE`` of the host's pages have it.

What is left inside ``article`` elements is the text (the ones not inside another); without
one, that of ``main``; without that, of the body. An article's own header keeps its headings,
and a wrapper with a furniture name stays if all articles of the page lie in it.
Blocks are joined by a line break, white space inside one becomes a space; ``br`` is white space.

Templates go to the tasks as one sorted array up to ``TEMPLATES`` of them; beyond, the hashes of
each page are joined with them by shuffle, and pages get their own list.

Defined cases: null html is empty and gives an empty text; null urls, and urls without a host,
form one host of their own; equal pages give equal rows; cut-off tags are dropped up to the end
of the page; an unknown or unfinished reference stays as it is; references to no character
become U+FFFD; an empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage

#: A template recurs on so many different pages of its host, and on so many of a hundred of them.
MANY = 5
SHARE = 2
PROSE_SHARE = 50
#: Templates that a task holds (8 bytes each).
TEMPLATES = 4_000_000

# Names of html elements and of page furniture.
IN_HEAD = set("title meta link style script base noscript template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template".split())
DROPPED = RAW | set("head nav aside form footer header menu dialog button select option datalist input label object svg math canvas audio video map".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd li td th caption b i em strong a span u s sub sup small code mark q cite abbr time br hr img".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {  # an open element, by which start tags it ends
    "p": BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "legend", "summary"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
}
CLOSERS = set().union(*CLOSED_BY.values())
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"}}
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!no-)(?<!with-)(?:ads?|ad(?:box|slot|unit)s?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer|masthead|"
    r"site-?header|page-?header|cookies?|consent|gdpr|notice\w*|newsletter|subscri\w*|signup|sign-up|login|popup|modal|overlay|"
    r"share|sharing|social|related|recommend\w*|comment\w*|disqus|respond|replies|reactions|pagination|pager|"
    r"widget|toolbar|skip-?link|copyright|legal|disclaimer|outbrain|taboola)(?=$|[\s_-])|(?:^|\s)(?:header|top-?bar)(?=$|\s)",
    re.I,
)
NO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comment\w*|repl(?:y|ies)|related|teaser|card|promo\w*|advert\w*|ads?|sponsor\w*)(?=$|[\s_-])", re.I)
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    r"|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]+)*+)(?:>|$)|<[a-zA-Z][^>]*(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[a-zA-Z][a-zA-Z0-9]*;?)")
SPACE = re.compile(r"\s+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attributes", "children", "hash", "gone")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.hash, self.gone = tag, attributes, [], 0, False


def decoded(text: str) -> str:
    if "&" not in text:
        return text
    return REFERENCE.sub(lambda m: references.unescape(m.group()), text)


def _ended(tag: str, open_: list[Node]) -> int:
    """From where on the open elements end when this tag starts; their number if none does."""
    end = len(open_)
    if len(open_) > 1 and open_[-1].tag == "head" and tag not in IN_HEAD:
        return end - 1
    if tag not in CLOSERS:
        return end
    for k in range(len(open_) - 1, 0, -1):
        held = open_[k].tag
        if tag in CLOSED_BY.get(held, ()):
            end = k
            if held == tag or held == "p":
                break
        elif held in BLOCKS and held not in CLOSED_BY:
            if tag not in SCOPES or held in SCOPES[tag]:
                break
    return end


def parsed(html: str) -> Node:
    """The page as a tree; children are nodes and texts in order."""
    root = Node("html", {})
    open_, names = [root], Counter()
    at, n = 0, len(html)

    def close(k: int) -> None:
        names.subtract(x.tag for x in open_[k:])
        del open_[k:]

    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            open_[-1].children.append(decoded(text))
        if not m:
            break
        at = m.end()
        if m.group(1):
            tag = m.group(1).lower()
            if names[tag] < 1:
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCKS and open_[k].tag in BLOCKS:
                    break  # a stray end of an inline element doesn't end the blocks around it
        elif m.group(2):
            tag, given = m.group(2).lower(), m.group(3)
            if tag == "html" or (tag == "body" and names["body"]):
                continue
            close(_ended(tag, open_))
            attributes: dict[str, str] = {}
            for a in ATTRIBUTE.finditer(given):
                attributes.setdefault(a[1].lower(), decoded(a[2] or a[3] or a[4] or ""))
            node = Node(tag, attributes)
            open_[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*(?:>|$)", re.I).search(html, at)
                at = end.end() if end else n
            elif tag not in VOID and (tag in BLOCKS or not given.rstrip().endswith("/")):
                open_.append(node)
                names[tag] += 1
    return root


def _furniture(node: Node) -> bool:
    a = node.attributes
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    names = (CAMEL.sub("-", a[k]) for k in ("class", "id") if a.get(k))
    return any((NO_ARTICLE if node.tag == "article" else FURNITURE).search(x) for x in names)


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]


def _main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attributes.get("role") == "main"


def pruned(root: Node) -> Node:
    """Marks what is furniture by its element or its names."""
    articles = [x for x in _walk(root) if _main(x)]
    around: set[int] = set()  # elements that hold an article
    if articles:
        for x in reversed(list(_walk(root))):
            if any(isinstance(c, Node) and (_main(c) or id(c) in around) for c in x.children):
                around.add(id(x))
    for spare in (False, True):
        todo, kept = [(root, False)], False
        while todo:
            node, inside = todo.pop()
            inside = inside or _main(node)
            for c in node.children:
                if not isinstance(c, Node):
                    continue
                wraps = id(c) in around and (spare or c.tag == "form")
                own_header = c.tag == "header" and inside
                c.gone = not wraps and (
                    (c.tag in DROPPED and not own_header) or (c.tag not in ("main", "body", "html") and _furniture(c))
                )
                if c.gone:
                    continue
                if own_header:
                    c.children = [x for x in _walk(c) if x.tag in HEADINGS]
                kept = kept or _main(c)
                todo.append((c, inside))
        if kept or not articles:
            break
    return root


def candidates(root: Node, host: int) -> dict[int, bool]:
    """Sets the hash of each remaining element that may be a template; these, and whether they are prose."""
    order, inside, todo = [], set(), [root]
    while todo:
        x = todo.pop()
        order.append(x)
        below = [c for c in x.children if isinstance(c, Node) and not c.gone]
        if x.tag == "article" or id(x) in inside:
            inside.update(map(id, below))
        todo += below
    whole: dict[int, bytes] = {}
    found: dict[int, bool] = {}
    for x in reversed(order):
        parts, holds = [x.tag.encode(), *(k.encode("utf-8", "surrogatepass") for k in sorted(x.attributes))], False
        for c in x.children:
            if isinstance(c, str):
                words = SPACE.sub(" ", c).strip()
                if words:
                    parts += [b"\1", words.encode("utf-8", "surrogatepass")]
                    holds = True
            elif id(c) in whole:
                parts += [b"\2", whole[id(c)]]
                holds = True
        if not holds:
            continue
        whole[id(x)] = xxhash.xxh64_digest(b"\0".join(parts))
        prose = x.tag in PROSE
        if x.tag in ("html", "body", "article", "main") or (id(x) in inside and prose):
            continue
        x.hash = xxhash.xxh64_intdigest(whole[id(x)], seed=host ^ prose)
        found[x.hash] = prose
    return found


def content(root: Node) -> list[str]:
    """The blocks of the articles, of main, or of the body."""
    chosen = []
    for is_one in (lambda x: x.tag == "article", _main):
        todo = [root]
        while todo:  # the outermost ones, in page order
            x = todo.pop()
            if is_one(x):
                chosen.append(x)
            else:
                todo += [c for c in reversed(x.children) if isinstance(c, Node) and not c.gone]
        if chosen:
            break
    blocks: list[list[str]] = [[]]
    todo = [y for x in reversed(chosen or [root]) for y in (None, x)]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.gone:
            continue
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif x.tag in BLOCKS:
            blocks.append([])
            todo += [None, *reversed(x.children)]
        else:
            todo += reversed(x.children)
    joined = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    return [b for b in joined if b]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hosts(urls: list[str | None]) -> list[int]:
    """A hash of each url's host; that of the empty one without."""
    found = (re.search(r"://([^/?#]*)", u or "") for u in urls)
    return [xxhash.xxh64_intdigest((m[1].lower() if m else "").encode("utf-8", "surrogatepass")) for m in found]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str, int]]:
    """Row number, html and host; rows are taken out one by one, as pages may be long."""
    hosts = _hosts(batch.column(1).to_pylist())
    for i, host in enumerate(hosts):
        yield i, batch.column(2)[i].as_py() or "", host


def _listed(batches):
    """(host, page, node, prose): the page's content and each subtree that may be a template."""
    for batch in batches:
        out = set()
        for _, text, host in _rows(batch):
            root = pruned(parsed(text))
            found = candidates(root, host)
            page = _signed(xxhash.xxh64_intdigest("\n".join(content(root)).encode("utf-8", "surrogatepass")))
            out.update((_signed(host), page, _signed(x), prose) for x, prose in [(host, False), *found.items()])
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "node", "prose"])


def templates(pages: DataFrame, many: int = MANY, share: int = SHARE) -> DataFrame:
    """(node): hashes, with the host in them, of the subtrees to delete; written.

    The host's own hash stands for it as a node that each of its pages has.
    """
    listed = pages.mapInArrow(_listed, "host long, page long, node long, prose boolean")
    counted = stage(listed.distinct().groupBy("host", "node", "prose").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {many}"))
    total = counted.where("node = host").select("host", F.col("n").alias("pages"))
    least = f"IF(prose, {PROSE_SHARE}, {share})"
    return counted.where("node <> host").join(total, "host").where(f"100 * n >= {least} * pages").select("node")


def _texts(lookup):
    """Texts of the pages of a batch; lookup gives a row's templates from the batch."""

    def run(batches):
        for batch in batches:
            known = lookup(batch)
            texts = []
            for i, text, host in _rows(batch):
                root = pruned(parsed(text))
                found = candidates(root, host)
                gone = known(i, found)
                for x in _walk(root) if gone else ():
                    x.gone = x.gone or x.hash in gone
                texts.append("\n".join(content(root)).encode("utf-8", "replace").decode())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, many: int = MANY, share: int = SHARE, bound: int = TEMPLATES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, text string, n_chars long"
    gone = templates(rows, many, share)
    held = gone.limit(bound + 1).toPandas()["node"].to_numpy(np.int64)
    if len(held) <= bound:
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(held.view(np.uint64)))

        def from_all(batch):
            every = shared.value

            def known(i, found):
                h = np.fromiter(found, np.uint64, len(found))
                at = np.searchsorted(every, h)
                return {x for x, k in zip(found, at, strict=True) if k < len(every) and int(every[k]) == x}

            return known

        return rows.mapInArrow(_texts(from_all), schema)

    def own(batches):
        for batch in batches:
            out = []
            for i, text, host in _rows(batch):
                key = batch.column(3)[i].as_py()
                out += [(key, _signed(x)) for x in candidates(pruned(parsed(text)), host)]
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["key", "node"])

    def from_row(batch):
        return lambda i, found: {x & ((1 << 64) - 1) for x in batch.column(3)[i].as_py() or ()}

    key = F.sha2(F.concat_ws("\0", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    keyed = rows.withColumn("key", key)
    lists = keyed.mapInArrow(own, "key string, node long").distinct().join(gone, "node").groupBy("key").agg(F.collect_list("node").alias("nodes"))
    return keyed.join(lists, "key", "left").select("page_id", "url", "html", "nodes").mapInArrow(_texts(from_row), schema)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
