"""Main text of web pages by minimum-cut labelling of text blocks.

A tolerant tokenizer turns a page into blocks (runs of text between block-level tags) and regions (elements whose tag, role
or names say something of the text in them). The labelling is a minimum cut over both:

* Blocks have terminal capacities from a linear classifier over bounded features of their own: length, share of linked
  text, closing punctuation, kind of tag (`WEIGHTS`, -5 to 4 in log odds). It knows nothing of where a block stands, so a
  short paragraph looks like boilerplate to it and a long notice like content.
* Regions have terminal capacities from their tag and names (`REGIONS`). Names are weak: they hold for a few long blocks,
  and a region that has more text than its name outweighs is content all the same. On a page that declares an article,
  the page itself is a region too, for what lies outside.
* Adjacency: neighbouring blocks of the page have a smoothness edge, children of one element a stronger one. DOM proximity:
  each block is tied to its nearest region (a block that is content in a boilerplate region pays, or one that is
  boilerplate in a content region), and each region to the one around it.

The cut is found by max-flow. Before the flow runs, a node whose terminal excess is at least the sum of its edges is fixed
(it has that label in some minimum cut), so the network left is small. Some regions are never content and take no part:
navigation, footers, asides, hidden elements and the like, and what is named as comments, teasers or advertisements; on a
page that declares an article also forms, headers and elements with boilerplate names outside it.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed
in page order. `br` is white space. Nothing else is dropped or cut.

Edge cases: null or empty html and pages without content have empty text and 0 characters. Broken markup (unclosed or
stray tags, unended comments) is read as a browser would, roughly: inline tags are ignored, a block-level tag ends an
open paragraph, an end tag closes up to its partner, a tag that never ends is text. Time is in proportion to the page. Repeated rows and null ids stay; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']+|<(?![a-zA-Z/!])|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title svg annotation object audio video canvas select datalist".split())
#: Raw elements that run to the page's end if they are not closed; of others only the tag is skipped then.
ENDLESS = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same group ends, up to the nearest of their containers.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NOT_CONTENT = frozenset("nav footer aside menu dialog search button label legend".split())
#: Boilerplate outside an article; inside a header is its title's place, and a form may wrap a whole page.
OUTSIDE = frozenset("header form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
CONTENT = frozenset("article main".split())
#: Words in class and id that name boilerplate or content.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar side aside nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs header masthead topbar footer foot bottombar copyright legal notice notices cookie cookies consent gdpr privacy disclaimer alert popup modal overlay toast subscribe subscription newsletter signup login register paywall comment comments commentlist discussion disqus respond replies reply thread feedback reviews share sharing social follow related recommended recommendations more popular trending tags taglist toc widget widgets pagination pager paging search form skip outbrain taboola".split()
)
GOOD_WORDS = frozenset("article content entry post story body main maintext text hentry articlebody".split())
#: Boilerplate that has articles of its own (comments, teasers, advertisements): no content element inside outweighs it.
FIRM_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion comment comments commentlist disqus respond replies reply related recommended recommendations popular trending outbrain taboola".split())
#: Words that name an article, other than those that also name parts of boilerplate (content, body, text).
ARTICLE_WORDS = frozenset("article entry post story hentry articlebody maintext".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Weights of the classifier, in units of log odds for content; length counts up to 200 characters, linked text as a share.
WEIGHTS = {"bias": -0.5, "paragraph": 1.5, "heading": 1.0, "item": -0.5, "linked": -4.0, "long": 2.0, "sentence": 1.0}
#: Regions: (log odds of being content, capacity of the edge to each of its blocks). "page" stands for what lies outside
#: of a declared article; "hinted" has a content word among others in its name.
REGIONS = {"article": (60.0, 5.0), "content": (6.0, 5.0), "hinted": (1.5, 1.5), "named": (-12.0, 5.0), "page": (-12.0, 5.0)}
ADJACENT, SIBLING, NESTED = 0.6, 0.4, 1.0


def _tokens(value: str) -> list[list[str]]:
    """Words of each token of a class or id; has-x, with-x, no-x and not-x say nothing about the element itself."""
    tokens = ([w for w in _SPLIT.split(_CAMEL.sub("-", token).lower()) if w] for token in value.split())
    return [words for words in tokens if words and words[0] not in ("has", "with", "no", "not", "is", "without")]


def _bearing(tag: str, attrs: str) -> str:
    """What an element is by its tag and attributes: never (content), outside (boilerplate outside an article), named (has
    a boilerplate name), article, content, hinted, or nothing."""
    never, named, article, content, hinted = tag in NOT_CONTENT, False, tag in CONTENT, False, False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if tag in ("body", "html"):
                    continue
                for words in _tokens(_html.unescape(value)):
                    never = never or not FIRM_WORDS.isdisjoint(words)
                    # "post-header" names a part of the content; a comment's or menu's body does not
                    if words[0] not in ARTICLE_WORDS or not BAD_WORDS.intersection(words) <= {"header"}:
                        named = named or not BAD_WORDS.isdisjoint(words)
                    if GOOD_WORDS.issuperset(words):
                        content = True
                        article = article or not ARTICLE_WORDS.isdisjoint(words) or {"main", "content"}.issubset(words)
                    hinted = hinted or not GOOD_WORDS.isdisjoint(words)
            elif key == "role":
                never = never or value.strip().lower() in ROLES
                article = article or value.strip().lower() in ("main", "article")
            elif key == "itemprop":
                article = article or value.strip().lower() == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and _HIDDEN.search(value):
                never = True
    if never:
        return "never"
    if article:
        return "article"
    return "outside" if tag in OUTSIDE else "named" if named else "content" if content else "hinted" if hinted else ""


class Region:
    """An element that bears on its text. up: the number of the region around it (-1: none); inside: it is in an article."""

    __slots__ = ("inside", "kind", "up")

    def __init__(self, kind: str, up: int, inside: bool):
        self.kind, self.up, self.inside = kind, up, inside


class Block:
    __slots__ = ("linked", "parent", "region", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, parent: int, region: int):
        self.text, self.linked, self.tag, self.parent, self.region = text, linked, tag, parent, region


def _within(regions: list[Region], kind: str, up: int) -> int:
    """The region of an element of this kind in region `up`; a new one if it changes anything."""
    around = regions[up] if up >= 0 else None
    inside = around is not None and around.inside
    if not kind or around and around.kind == "never" or kind == "outside" and inside:
        return up  # nothing inside "never" is content
    if kind in ("content", "hinted") and around and around.kind in ("named", "outside"):
        return up  # only an article outweighs a boilerplate name around it
    regions.append(Region(kind, up, inside or kind == "article"))
    return len(regions) - 1


def blocks(page: str) -> tuple[list[Block], list[Region]]:
    """The text blocks of a page in page order, and the regions they stand in."""
    out: list[Block] = []
    regions: list[Region] = []
    stack: list[tuple[str, int, int]] = [("", 0, -1)]  # tag, number, region
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    number, in_link, linked = 0, 0, 0
    parts: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                tag, _, region = stack[-1]
                out.append(Block(text, linked, tag, stack[-2][1] if len(stack) > 1 else 0, region))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    def close(upto: int) -> None:
        nonlocal in_link
        flush()
        for x in stack[upto:]:
            opened[x[0]] -= 1
        del stack[upto:]
        in_link = 0

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            take(m["cdata"].replace("&", "&amp;"))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCKS:
                where = next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag) if opened[tag] else 0
                if where:
                    close(where)
                elif tag == "p":
                    flush()
            elif tag == "br":
                take(" ")
            continue
        attrs = m["attrs"]
        if tag in RAW:
            if tag in BLOCKS or tag in ("title", "xmp"):
                flush()
            if not attrs.rstrip().endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>", re.I).search(page, at)
                if end and tag == "xmp":
                    take(page[at : end.start()].replace("&", "&amp;"))
                    flush()
                if end:
                    at = end.end()
                elif tag in ENDLESS:
                    at = n
                else:
                    unclosed.add(tag)
            take(" ")
            continue
        if tag in BLOCKS:
            flush()
            in_link = 0
            if stack[-1][0] == "p" or tag == "body" and stack[-1][0] == "head":
                close(len(stack) - 1)
            if tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag][0]):
                ends, within = SIBLINGS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in within:
                        break
                    if stack[i][0] in ends:
                        close(i)
                        break
            elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[-1][0]):
                close(len(stack) - 1)
            if tag != "hr":
                number += 1
                opened[tag] += 1
                stack.append((tag, number, _within(regions, _bearing(tag, attrs), stack[-1][2])))
        elif tag == "a":
            in_link += 1
        elif tag == "br":
            take(" ")
        elif attrs and tag not in VOID and tag not in unclosed and not attrs.rstrip().endswith("/") and _bearing(tag, attrs) in ("never", "named"):
            # an inline element that names itself boilerplate (or is hidden) goes, if it holds no blocks and not its like
            end = re.compile(rf"(</{re.escape(tag)}\s*>)|<{re.escape(tag)}|<(?:p|div|section|article|ul|ol|table|h[1-6])\b", re.I).search(page, at)
            if end is None:
                unclosed.add(tag)
            elif end[1]:
                take(" ")
                at = end.end()
    flush()
    return out, regions


def odds(b: Block) -> float:
    """Log odds of content of one block by itself."""
    w, size = WEIGHTS, len(b.text)
    x = w["bias"]
    if b.tag in ("p", "pre", "blockquote"):
        x += w["paragraph"]
    elif len(b.tag) == 2 and b.tag[0] == "h":
        x += w["heading"]
    elif b.tag in ("li", "td", "th", "dd", "dt"):
        x += w["item"]
    x += w["linked"] * min(1.0, b.linked / size)
    x += w["long"] * min(1.0, size / 200)
    if b.text[-1] in ".!?…:;»”\"'":
        x += w["sentence"]
    return x


def min_cut(excess: list[float], edges: list[tuple]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut. excess: capacity from the source (positive) or to the
    sink (negative). edges: (a, b, c), c in both directions, or (a, b, c, d), c from a to b and d back; what leads from
    the source's side to the sink's is paid."""
    n = len(excess)
    out: list[dict[int, float]] = [{} for _ in range(n)]  # the same neighbours in both: what a node pays as source, as sink
    into: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c, *d in edges:
        if a != b:
            for i, j, x in ((a, b, c), (b, a, d[0] if d else c)):
                out[i][j] = into[j][i] = out[i].get(j, 0.0) + x
    label: list[bool | None] = [None] * n
    excess = list(excess)
    as_source, as_sink = [sum(x.values()) for x in out], [sum(x.values()) for x in into]
    todo = deque(range(n))
    while todo:  # fix what no cut of its edges can outweigh; a fixed neighbour's edge joins the terminal
        i = todo.popleft()
        if label[i] is None and (excess[i] > 0 and excess[i] >= as_source[i] - 1e-12 or excess[i] <= 0 and -excess[i] >= as_sink[i] - 1e-12):
            label[i] = excess[i] > 0
            for j in out[i]:
                if label[j] is None:
                    excess[j] += out[i][j] if label[i] else -into[i][j]
                    as_source[j] -= into[i][j]
                    as_sink[j] -= out[i][j]
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        arcs = [(number[i], number[j], c, into[i][j]) for i in rest for j, c in out[i].items() if i < j and j in number]
        for i, side in zip(rest, _source_side([excess[i] for i in rest], arcs), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _source_side(excess: list[float], arcs: list[tuple[int, int, float, float]]) -> list[bool]:
    """The nodes that the source still reaches after a maximum flow (by levels, as Dinic 1970)."""
    n = len(excess)
    source, sink, least = n, n + 1, 1e-12
    to: list[int] = []
    room: list[float] = []
    leaving: list[list[int]] = [[] for _ in range(n + 2)]  # arc 2 k goes there, 2 k + 1 back
    terminal = [(source, i, x, 0.0) if x > 0 else (i, sink, -x, 0.0) for i, x in enumerate(excess)]
    for a, b, c, d in terminal + arcs:
        leaving[a].append(len(to))
        leaving[b].append(len(to) + 1)
        to += (b, a)
        room += (c, d)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in leaving[i]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                f = min(room[e] for e in path)
                for e in path:
                    room[e] -= f
                    room[e ^ 1] += f
                full = next(k for k, e in enumerate(path) if room[e] <= least)
                i = to[path[full] ^ 1]
                del path[full:]
            arcs_of = leaving[i]
            while turn[i] < len(arcs_of) and not (room[arcs_of[turn[i]]] > least and level[to[arcs_of[turn[i]]]] == level[i] + 1):
                turn[i] += 1
            if turn[i] < len(arcs_of):
                path.append(arcs_of[turn[i]])
                i = to[path[-1]]
            elif i == source:
                break
            else:
                level[i] = -1
                i = to[path.pop() ^ 1]


def labels(found: list[Block], regions: list[Region]) -> list[bool]:
    """Is each block content, by the minimum cut."""
    declared = any(r.kind in ("article", "content") for r in regions)
    # what stands for no content at all: on a page that declares an article also named elements outside it
    gone = [r.kind == "never" or declared and not r.inside and r.kind in ("named", "outside") for r in regions]
    n = len(found)
    excess = [odds(b) for b in found]
    edges: list[tuple] = [(i, i + 1, ADJACENT + SIBLING * (found[i].parent == found[i + 1].parent)) for i in range(n - 1)]
    for r in regions:
        excess.append(REGIONS.get("named" if r.kind == "outside" else r.kind, (0.0, 0.0))[0])
        if r.up >= 0:
            edges.append((len(excess) - 1, n + r.up, NESTED))
    page = len(excess)
    excess.append(REGIONS["page"][0])
    titled = any(b.tag == "h1" and b.region >= 0 and regions[b.region].inside for b in found)
    for i, b in enumerate(found):
        if b.region >= 0:
            kind = "named" if regions[b.region].kind == "outside" else regions[b.region].kind
        elif declared and (titled or b.tag != "h1"):  # a title may stand before its article
            kind = "page"
        else:
            continue
        if b.region >= 0 and gone[b.region]:
            excess[i] = float("-inf")
            continue
        evidence, tie = REGIONS[kind]
        at = n + b.region if b.region >= 0 else page
        edges.append((at, i, tie, 0.0) if evidence > 0 else (i, at, tie, 0.0))
    return min_cut(excess, edges)[:n]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found, regions = blocks(page or "")
    return "\n".join(b.text for b, content in zip(found, labels(found, regions), strict=True) if content) if found else ""


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "html"):
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(common.column(pages, "page_id", "long").alias("page_id"), common.column(pages, "url", "string").alias("url"), common.column(pages, "html", "string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
