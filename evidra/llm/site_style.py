"""HTML extraction with site style trees.

The pages of a host are merged into one tree: a node is a path of elements (tag, class and id without digits), counted over the
host's pages. Its importance is composite: for presentation, the entropy of the child sequences seen under it; for
content, the entropy of its texts over the pages (a text that every page repeats carries nothing). Both are in 0 to 1.
What an element's tag, role or name says is a prior on that importance: ``ROLE`` for elements that are no article (navigation,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments), ``WEAK`` for names that may be either (legal,
related, print), 1 for all others. A branch goes with all below where prior times importance is less than ``LEAST``. So roles
go whatever the tree says, weak names go if their text varies little, and any named or structural branch goes that hosts repeat.

Pages that repeat each other say nothing about their branches: repetition counts only if the text around (of the article, or of the
page outside of one) differs as usual. On hosts of fewer than ``LEAST_PAGES`` pages with a branch it is 1 (weak names go there if most
of their text is links). Headings and unnamed paragraphs, items and cells are text: their path stands for all their likes, and they stay.

Text of each page: that of its main and article elements, with what is in them, in page order; of pages without such, the branch
that holds most of the text outside links. Blocks are joined by line breaks; character references decoded, white space within a
block one space. Null and empty html give an empty text, as does a page without article. Unclosed and crossed tags are closed by
the usual rules (a paragraph ends at the next block). Depth and length are not limited; parsing counts what is open and is linear in the page. Repeated rows
give equal rows; no rows give none. Null urls share one host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, rows_in_chunks, table

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_PARAGRAPH = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
NOT_ARTICLE = frozenset("nav header footer aside form script style noscript iframe template svg math button select option textarea input label dialog menu head title object embed canvas audio video".split())
NOISE_NAMES = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adbox|adslot|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe\w*|signup|login"
    r"|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|widget\w*|trending|share\w*|sharing|social\w*|comments?|commentlist|comment-\w+|replies|reply|disqus|respond"
    r"|header|masthead|topbar|toolbar|footer|copyright|pagination|pager|tagcloud|skip\w*|hidden)(?:$|[-_ ])",
    re.I,
)
WEAK_NAMES = re.compile(r"(?:^|[-_ ])(?:side|related\w*|recommend\w*|popular|follow|discussion|feedback|foot|bottom|legal|disclaimer|tags?|meta|byline|search\w*|print)(?:$|[-_ ])", re.I)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE_NAMES = re.compile(r"(?:^|[-_ ])(?:article\w*|post|story|entry|content|main|body|text)(?:$|[-_ ])", re.I)

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)", re.S)
#: An attribute by its whole name; a value without quotes ends at white space or the end of the tag, whatever quotes are in it.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_TAG_END = re.compile(r"\s*(/?)[\s/]*(?:>|\Z)")
#: Parts of a class that tell how a page is laid out, not what the element is.
_LAYOUT = re.compile(r"^(?:has|with|no|without)[-_]", re.I)
# Elements that end an open one of their kind, and what keeps one within.
ENDED_BY = {"li": ("li", "ul ol menu"), "tr": ("tr", "table"), "td": ("td", "tr table"), "th": ("th", "tr table"), "dt": ("dt", "dl"), "dd": ("dd", "dl"), "option": ("option", "select")}
_SPACE = re.compile(r"\s+")
# Elements that are text by themselves, and those that say where the article is.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = frozenset("p li td th tr tbody thead tfoot dt dd caption figcaption summary legend br hr pre".split())
CONTAINERS = frozenset(("article", "main"))
#: Priors of roles and of weak names; a branch goes where prior times importance is less.
ROLE, WEAK, LEAST = 0.2, 0.5, 0.25
#: Pages of a host that must have a branch; entropy of the text around from which repetition counts.
LEAST_PAGES, VARIED = 4, 0.5
#: Rows of branches (host, path) up to which they are broadcast to the pages.
BROADCAST_ROWS = 100_000


@dataclass(eq=False)
class Node:
    tag: str
    name: str
    path: int  # hash of the names from the root
    parent: Node | None
    noise: bool = False  # by role, or within such
    weak: bool = False  # by name
    items: list = field(default_factory=list)  # nodes and texts in page order
    open: dict = field(default_factory=dict)  # the open paragraph, item, row, cell ... that a tag within would end


def _scope(parent: Node, node: Node) -> dict:
    """What is open within ``node``; shared with its parent where it changes nothing."""
    tag, out = node.tag, dict(parent.open)
    if tag in BLOCK:
        out.pop("p", None)
    for kind, keeps in ENDED_BY.values():
        if tag in keeps.split():
            out.pop(kind, None)
    if tag == "p" or tag in ENDED_BY:
        out[tag] = node
    return parent.open if out == parent.open else out


def attributes(html: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Names (lower case) and values of a start tag from behind its name, whether it closes itself, and where it ends."""
    found = []
    while (end := _TAG_END.match(html, at)) is None:
        a = _ATTRIBUTE.match(html, at)
        if a is None:  # white space up to the end of the page
            return found, False, len(html)
        found.append((a[1].lower(), next((v for v in a.groups()[1:] if v is not None), "")))
        at = a.end()
    return found, bool(end[1]), end.end()


def role(tag: str, given: list[tuple[str, str]]) -> tuple[str, bool, bool]:
    """Name of an element in the tree (tag, class and id without digits), whether its role is no article's, and whether its name is weak."""
    noise, weak, name = tag in NOT_ARTICLE, False, tag
    for key, value in given:
        if key in ("class", "id"):
            name += "." + re.sub(r"\d+", "", value)
            told = " ".join(x for x in value.split() if not _LAYOUT.match(x))
            if tag == "article":
                noise = noise or bool(re.search(r"\bcomment", told, re.I))
            elif tag not in ("body", "html", "main"):
                noise, weak = noise or bool(NOISE_NAMES.search(told)), weak or (bool(WEAK_NAMES.search(told)) and not ARTICLE_NAMES.search(told))
        elif key == "role":
            noise = noise or value.lower() in NOISE_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            noise = True
    return name, noise, weak


def parse(html: str) -> Node:
    """The page's element tree, as forgiving as browsers are about unclosed tags. Each step looks at what is opened or closed only: which tags are
    open is counted, and what a tag would end is known at each node."""
    root = Node("", "", 0, None)
    at, now, end, opened = 0, root, len(html), Counter()

    def up_to(node: Node) -> Node:
        """Close everything down from ``node``."""
        x = now
        while x is not node.parent:
            opened[x.tag] -= 1
            x = x.parent
        return x

    while at < end:
        found = _MARKUP.search(html, at)
        if found is None:
            now.items.append(html[at:])
            break
        if found.start() > at:
            now.items.append(html[at : found.start()])
        at = max(found.end(), found.start() + 1)
        closing, tag = found[1], found[2]
        if closing:
            closing = closing.lower()
            if opened[closing] > 0:
                up = now
                while up.tag != closing:
                    up = up.parent
                now = up_to(up)
            elif closing == "p":
                now.items.append(Node("p", "p", _path(now.path, "p"), now, now.noise))
        elif tag:
            tag = tag.lower()
            given, closes_itself, at = attributes(html, at)
            for ended in (["p"] if tag in ENDS_PARAGRAPH else []) + ([tag] if tag in ENDED_BY else []):
                if (x := now.open.get(ended)) is not None:
                    now = up_to(x)
            name, noise, weak = role(tag, given)
            node = Node(tag, name, _path(now.path, name), now, noise or now.noise, weak)
            now.items.append(node)
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*[^>]*>?", re.I).search(html, at)
                if tag in ("title", "textarea"):
                    node.items.append(html[at : close.start() if close else end])
                at = close.end() if close else end
            elif tag not in VOID and not closes_itself:
                node.open = _scope(now, node)
                opened[tag] += 1
                now = node
    return root


def _path(above: int, name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace"), above) >> 1


def walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in reversed(node.items) if not isinstance(x, str))


def _host_of(url: object) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def containers(nodes: list[Node]) -> list[Node]:
    """The topmost main and article elements that no role removes; without such, topmost ``div.article`` ones. ``nodes``: in page order."""
    for fits in (lambda x: x.tag in CONTAINERS, lambda x: x.name.startswith("div.article")):
        found = [x for x in nodes if not x.noise and fits(x)]
        if found:
            inside, top = set(), []
            for x in nodes:  # parents come before their children
                if x.parent in inside:
                    inside.add(x)
                elif not x.noise and fits(x):
                    top.append(x)
                    inside.add(x)
            return top
    return []


def digests(nodes: list[Node]) -> tuple[dict[Node, bytes], dict[Node, list[int]]]:
    """Of each node, a digest of all text below it outside removed roles, and how many characters that has, in all and in links: from
    the leaves up, so each text is looked at once."""
    out, size = {}, {}
    for node in reversed(nodes):
        h, n = xxhash.xxh3_64(), [0, 0]
        for x in node.items:
            if isinstance(x, str):
                text = _SPACE.sub(" ", x)
                h.update(text.encode("utf-8", "replace"))
                n[0] += len(text.strip())
            elif not x.noise and x.tag not in RAW:
                h.update(out[x])
                n = [n[0] + size[x][0], n[1] + size[x][1]]
        out[node], size[node] = h.digest(), [n[0], n[0]] if node.tag == "a" else n
    return out, size


def judged(node: Node) -> bool:
    """Whether the tree judges this node: blocks, but headings and unnamed plain text."""
    return bool(node.tag) and not node.noise and node.tag in BLOCK and node.tag not in HEADINGS and node.tag not in ("html", "body", *CONTAINERS) and (node.tag not in PLAIN or node.name != node.tag)


def page_facts(html: str) -> dict[int, tuple[int, int, int]]:
    """For each path that the tree judges: digests of its child sequences, of its text, and of the text around it. Within pages that have
    an article, only what is in it."""
    nodes = list(walk(parse(html)))
    top = containers(nodes)
    around: dict[Node, Node] = {x: x for x in top}
    for x in nodes:
        if x not in around and (not top or x.parent in around):
            around[x] = around[x.parent] if top else nodes[0]
    if not any(judged(x) for x in around):
        return {}
    content, _ = digests(nodes)
    facts: dict[int, list] = {}
    for x in nodes:
        if x in around and judged(x):
            shape, text, _ = facts.setdefault(x.path, [xxhash.xxh3_64(), xxhash.xxh3_64(), content[around[x]]])
            shape.update(">".join(dict.fromkeys(y.name for y in x.items if not isinstance(y, str))) + "|")
            text.update(content[x])
    return {path: (a.intdigest() >> 1, b.intdigest() >> 1, int.from_bytes(c, "big") >> 1) for path, (a, b, c) in facts.items()}


def _facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, pages in rows_in_chunks(batches, "_html"):
        found = [(i, p, *f) for i, page in enumerate(pages) for p, f in page_facts(page).items()]
        columns = np.array(found, np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(columns[0])), *(pa.array(c.copy()) for c in columns[1:])], ["host", "path", "shape", "content", "around"])


def style_trees(pages: DataFrame) -> DataFrame:
    """Importance of each node (host, path) of the merged trees: presentation plus content entropy, and that of the text around.
    ``pages``: columns host, _html. Counts are pre-aggregated; no host is collected."""
    seen = pages.select("host", "_html").mapInArrow(_facts, "host string, path long, shape long, content long, around long")
    counted = seen.groupBy("host", "path", "shape", "content", "around").agg(F.count("*").alias("n"))  # all entropies use this one exchange

    def entropy(kind: str) -> DataFrame:
        each = counted.groupBy("host", "path", kind).agg(F.sum("n").alias("n"))
        of = each.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
        return of.select("host", "path", "pages", F.when(F.col("pages") > 1, 1 - F.col("nlogn") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias(kind))

    every = entropy("shape").join(entropy("content").drop("pages"), ["host", "path"]).join(entropy("around").drop("pages"), ["host", "path"])
    return every.select("host", "path", "pages", "around", (1 - (1 - F.col("shape")) * (1 - F.col("content"))).alias("importance"))


def article_text(html: str, importance: dict[int, float]) -> str:
    """Text blocks of the page's article: of its containers (see ``containers``), or else of the densest branch, without the branches of which
    prior times importance (by path; 1 where it isn't known) is low."""
    nodes = list(walk(parse(html)))
    content_size: dict[Node, list[int]] = {}

    def goes(x: Node) -> bool:
        if x.noise:
            return True  # ROLE times any importance is less than LEAST
        if not judged(x):
            return False
        known = importance.get(x.path)
        if not x.weak or known is not None:
            return (WEAK if x.weak else 1.0) * (1.0 if known is None else known) < LEAST
        if not content_size:
            content_size.update(digests(nodes)[1])
        text, links = content_size[x]
        return 2 * links > text

    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            blocks.append(text)

    for top in containers(nodes) or [_densest(nodes, goes)]:
        stack: list[tuple[Node, Iterator]] = [(top, iter(top.items))]
        while stack:
            node, items = stack[-1]
            for x in items:
                if isinstance(x, str):
                    line.append(unescape(x))
                elif goes(x):
                    flush() if x.tag in BLOCK else None
                elif x.tag == "br":
                    line.append(" ")
                else:
                    if x.tag in BLOCK:
                        flush()
                    stack.append((x, iter(x.items)))
                    break
            else:
                stack.pop()
                if node.tag in BLOCK:
                    flush()
        flush()
    return "\n".join(blocks)


def _densest(nodes: list[Node], goes: Callable[[Node], bool]) -> Node:
    """From the body down: the child block that holds most (over 0.7) of its parent's text outside links, as long as there is one."""
    gone = {x for x in nodes if x.tag and goes(x)}
    weight: dict[Node, int] = {}
    for x in reversed(nodes):
        weight[x] = sum(len(y.strip()) if isinstance(y, str) else 0 if y in gone or y.tag == "a" else weight[y] for y in x.items)
    node = next((x for x in nodes if x.tag == "body"), nodes[0])
    while True:
        kids = [x for x in node.items if not isinstance(x, str) and x not in gone and x.tag in BLOCK and x.tag not in ("p", "ul", "ol", "table", "blockquote", "pre")]
        best = max(kids, key=weight.__getitem__, default=None)
        if best is None or weight[best] < 0.7 * max(1, weight[node]):
            return node
        node = best


def _extracted(names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pages in rows_in_chunks(batches, "_html"):
            texts = [article_text(page, {x["path"]: x["importance"] for x in known or ()}) for page, known in zip(pages, rows.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars of every page.

    The branches that the trees judge, with pages and variety enough, meet the pages as one list a host: by broadcast if they are
    few (checked), else by a join that adaptive execution splits at hot hosts."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), _host_of(F.col(url_col)).alias("host"))
    enough = (F.col("pages") >= LEAST_PAGES) & (F.col("around") >= VARIED)
    trees = checkpointed(style_trees(rows).where(enough).select("host", "path", "importance"))
    known = trees.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("known"))
    if trees.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    kinds = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    joined = rows.join(known, "host", "left").select("_id", "_url", "_html", "known")
    return joined.mapInArrow(_extracted([id_col, url_col]), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")


def op9_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the article text of every page."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
