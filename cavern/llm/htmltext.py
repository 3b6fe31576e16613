"""Operator 3: the main text of web pages, with site templates removed by recurring subtrees.

A page is parsed once into elements, and each block element's subtree is hashed (its tag and the texts and subtrees
in it). The pages of a host with that subtree are counted in Spark; pages of one main text count once. Outside the
main part of a page, subtrees found on `least_pages` pages of the host are the site's template and are deleted:
menu entries, adverts, footers and notices, whatever their tags are called. Inside it, only boxes of several blocks are
(not its own paragraphs, headings and lists, which many pages may quote), from a share `least_share` of the host's
pages on. The main part is the page's articles, else its main elements, else the element with the most text in
paragraphs of its own; in the last case what stands outside it stays too, if it is no template.

For hosts with too few pages to show a template, parts known by their element, role or class go by rule: a class or
id counts where a whole word of it, or the first or last part of a hyphenated one, names such a part. Lists of links
outside the main part are menus. A rule that would leave a page without text is not applied to it, and a page whose
text would be deleted whole as template keeps it.

What is left is the text: character references decoded, white space in a block turned into one space, blocks joined
by an empty line. The blocks of the one parse are written with the hashes of the subtrees around them, so that
no page is parsed again when the templates are known.

Defined cases: a null or empty html gives the empty text; null or hostless urls form no host and lose nothing as
template; repeated rows are pages like any other; unclosed and misnested elements are closed as browsers close
them; unknown declarations and marked sections are comments; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, texts, written

LEAST_PAGES, LEAST_SHARE = 5, 0.1
#: Template subtrees, over all hosts, up to which they are broadcast (8 bytes each); beyond it they are joined.
BROADCAST_SUBTREES = 1_000_000
#: Pages whose texts are put together at once.
ROWS = 512

# Element names and the words of roles, classes and ids by which pages name their parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER_TEXT = set("script style noscript template head button select option textarea input iframe object embed svg canvas audio video".split())
DROPPED = set("nav header footer aside form menu dialog".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
DROPPED_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner masthead nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar side rail widget widgets footer foot copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social form search toolbar skip".split()
)
OTHER_NAMES = set("comment comments reply replies disqus related recommended".split())
#: First parts of class words that say what a page has or lacks, not what the element is.
MODIFIERS = set("has no not with without is js hide hides show shows can allow enable disable".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Elements of the main part that may be a template's box.
BOXES = set("div section aside nav footer address center details figure".split())
FRAME = {"html", "body", "article", "main"}
ENDS_PARAGRAPH = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ENDS_ITSELF = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ALIKE = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BUT_PARAGRAPH = BLOCK - {"p"}
#: Blocks that the end tag of an inline element does not close.
CLOSED_ON_THE_WAY = {"p", "li", "td", "th", "tr", "dt", "dd"}
DOCTYPE = re.compile(r"<!doctype[^>\[]*(?:\[[^\]]*\]\s*)?>", re.I)


#: How an element goes by rule: as a part named so, as readers' comments or links to other pages, or as no text at all.
NAMED, OTHERS, NEVER = 1, 2, 3
KEY_BITS = (1 << 63) - 1


class Element:
    """rule: 0 where it stays; links: how many links its text is made of, -1 where text stands outside them."""

    __slots__ = ("tag", "rule", "children", "key", "links")

    def __init__(self, tag: str, rule: int):
        self.tag, self.rule, self.children, self.key, self.links = tag, rule, [], 0, 0


def rule_of_names(words: str) -> int:
    rule = 0
    for word in words.lower().split():
        parts = re.split(r"[-_]+", word)
        for x in {word} if parts[0] in MODIFIERS else {word, parts[0], parts[-1]}:
            rule = max(rule, OTHERS if x in OTHER_NAMES else NAMED if x in DROPPED_NAMES else 0)
    return rule


def rule_of(tag: str, attrs: dict[str, str | None], in_article: bool) -> int:
    if tag in NEVER_TEXT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return NEVER
    if tag in FRAME:
        return 0
    if tag in DROPPED and not (tag == "header" and in_article):
        return NAMED
    if not attrs or tag not in BLOCK:
        return 0
    rule = rule_of_names(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")
    return max(rule, NAMED) if (attrs.get("role") or "").lower() in DROPPED_ROLES else rule


class Page(HTMLParser):
    """Builds the elements of a page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.top = Element("#", 0)
        self.open = [self.top]
        self.articles = 0
        self.feed(html)
        self.close()

    def updatepos(self, i, j):
        return j  # line numbers aren't needed

    def parse_comment(self, i, report=1):
        ends = [k for k in (self.rawdata.find("-->", i + 2), self.rawdata.find("--!>", i + 4)) if k >= 0]
        return self.rawdata.find(">", min(ends)) + 1 if ends else len(self.rawdata)

    def parse_html_declaration(self, i):
        found = DOCTYPE.match(self.rawdata, i)
        end = found.end() if found else self.rawdata.find(">", i + 2) + 1
        return end or len(self.rawdata)

    def pop_to(self, at: int) -> None:
        for x in self.open[at:]:
            self.articles -= x.tag == "article"
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self.end(("p",), BUT_PARAGRAPH)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop_to(len(self.open) - 1)
        if tag in ENDS_ITSELF:
            self.end(ALIKE.get(tag, (tag,)), ENDS_ITSELF[tag])
        own = Element(tag, rule_of(tag, dict(attrs), self.articles > 0))
        self.open[-1].children.append(own)
        if tag not in VOID:
            self.open.append(own)
            self.articles += tag == "article"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def end(self, tags: tuple[str, ...], stop: set[str], but: set[str] = frozenset()) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                return self.pop_to(k)
            if tag in stop and tag not in but:
                return None

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end((tag,), frozenset())
        else:
            self.end((tag,), BLOCK, CLOSED_ON_THE_WAY)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def measured(top: Element) -> Element | None:
    """Sets the key of every element that holds text, and its links. Returns the element with the most text in paragraphs of its own, none of them in a part that goes by rule."""
    best, best_size = None, 0
    todo = [(top, False, False)]
    while todo:
        node, ready, gone = todo.pop()
        if not ready:
            gone = gone or node.rule > 0
            todo.append((node, True, gone))
            todo += [(c, False, gone) for c in node.children if not isinstance(c, str) and c.rule < NEVER]
            continue
        parts, size, links = [node.tag], 0, 0
        for c in node.children:
            if isinstance(c, str):
                if own := " ".join(c.split()):
                    parts.append(own)
                    links = -1
            elif c.rule < NEVER and c.key:
                parts.append(f"\x01{c.key:x}")
                links = -1 if links < 0 or c.links < 0 else links + c.links
                if c.tag in PARAGRAPHS and not c.rule:
                    size += sum(len(x) if isinstance(x, str) else 1 for x in c.children)
        if len(parts) > 1:
            node.key = xxhash.xxh64_intdigest("\x02".join(parts)) & KEY_BITS | 1
            node.links = 1 if node.tag == "a" else links
            if size > best_size and not gone:
                best, best_size = node, size
    return best


def semantic_roots(top: Element, most: int) -> list[Element]:
    """The page's articles; else its main elements; those in parts of a rule above `most` don't count."""
    for wanted in ("article", "main"):
        found, todo = [], [top]
        while todo:
            x = todo.pop()
            if x.tag == wanted:
                if x.key:
                    found.append(x)
                continue
            todo += [c for c in reversed(x.children) if not isinstance(c, str) and (c.rule <= most or c.tag == "form")]
        if found:
            return found
    return []


def ancestors(top: Element, part: Element | None) -> set[int]:
    """The ids of the elements that hold a part."""
    todo: list[tuple[Element, int]] = [(top, 0)]
    line: list[Element] = []
    while todo and part is not None:
        x, depth = todo.pop()
        del line[depth:]
        if x is part:
            return {id(y) for y in line}
        line.append(x)
        todo += [(c, depth + 1) for c in x.children if not isinstance(c, str)]
    return set()


def blocks_under(roots: list[Element], main: Element | None, most: int) -> list[tuple[str, tuple[int, ...]]]:
    """The texts of the blocks, and around each the keys of the subtrees that a template may have (odd: outside the main part).

    Without `main` the roots are the main part."""
    out: list[tuple[str, tuple[int, ...]]] = []
    own: list[str] = []
    path: tuple[int, ...] = ()
    holders = ancestors(roots[0], main) if roots else set()

    def end() -> None:
        if text := " ".join("".join(own).split()):
            out.append((text, path))
        own.clear()

    todo: list[tuple] = [(x, main is None) for x in reversed(roots)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, tuple):
            end()
            path = x
        elif isinstance(x, str):
            own.append(x)
        elif x.tag in ("br", "wbr"):
            own.append(" " if x.tag == "br" else "")
        elif x.rule <= most:
            outside = not inside and x is not main and id(x) not in holders
            if outside and x.links > 1 and x.tag in BLOCK and not most:
                continue  # a menu
            if x.tag in BLOCK or x.tag == "#":
                end()
                todo.append((path, inside))
                if x.key and x.tag not in FRAME:
                    if outside:
                        path = (*path, x.key)
                    elif inside and x.tag in BOXES and any(not isinstance(c, str) and c.tag in BLOCK and c.key for c in x.children):
                        path = (*path, x.key ^ 1)
            # In a page without a box for its main part, the paragraphs of the body are that part.
            part = inside or x is main and x.tag not in ("body", "#")
            todo += [(c, part or x is main and not isinstance(c, str) and c.tag in PARAGRAPHS) for c in reversed(x.children)]
    end()
    return out


def page_blocks(html: str) -> tuple[int, list[tuple[str, tuple[int, ...]]]]:
    """The key of a page's main part, and its blocks. The first reading that leaves text is taken."""
    top = Page(html).top
    main = measured(top)
    for above in (0, NAMED):
        if roots := semantic_roots(top, above):
            for most in (0, OTHERS):
                if found := blocks_under(roots, None, most):
                    return xxhash.xxh64_intdigest(repr([x.key for x in roots])) & KEY_BITS, found
    for most in (0, NAMED, OTHERS):
        if found := blocks_under([top], main, most):
            return (main or top).key, found
    return 0, []


def kept_text(blocks: list[tuple[str, tuple[int, ...]]], template: set[int]) -> str:
    left = [text for text, path in blocks if template.isdisjoint(path)]
    return "\n\n".join(left or [text for text, _ in blocks])


def host_key(host: str | None) -> int:
    """What distinguishes the keys of hosts; it leaves the lowest bit."""
    return xxhash.xxh64_intdigest(host or "") & KEY_BITS & ~1


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, html to the blocks: their texts, the lengths of their paths, and the paths' keys, one after the other."""
    for whole in batches:
        for batch in slices(whole, "html"):
            pages, bodies, sizes, paths, keys = [], [], [], [], []
            for host, html in zip(batch.column("host").to_pylist(), texts(batch, "html")):
                own, blocks = page_blocks(html)
                mix = host_key(host)
                flat = [k ^ mix for _, path in blocks for k in path] if host else []
                pages.append(own)
                bodies.append([text for text, _ in blocks])
                sizes.append([len(path) if host else 0 for _, path in blocks])
                paths.append(flat)
                keys.append(sorted(set(flat)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(pages, pa.int64()), pa.array(bodies, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32())), pa.array(paths, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["page_id", "url", "host", "main", "texts", "sizes", "paths", "subtrees"],
            )


def parsed(pages: DataFrame) -> DataFrame:
    """The blocks of every page, with a number of its row in `row`; written, so that pages are parsed once."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[^/]*//([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(parse_batches, f"page_id {kind}, url string, host string, main long, texts array<string>, sizes array<int>, paths array<long>, subtrees array<long>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "pages")


def template_subtrees(blocks: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """subtree: those of the hosts' templates. Of a host's pages with one main text, one is counted."""
    pages = blocks.where("host <> ''").groupBy("host", "main").agg(F.min("subtrees").alias("subtrees"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("of"))
    counts = pages.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    # Written, so that a host of very many subtrees can be split in the join.
    joined = checkpointed(counts).join(hosts, "host")
    return joined.where((F.col("subtree").bitwiseAND(F.lit(1)) == 1) | (F.col("pages") >= F.col("of") * least_share)).select("subtree")


def text_batches(batches: Iterator[pa.RecordBatch], known: set[int] | None) -> Iterator[pa.RecordBatch]:
    """Blocks to texts; the template's subtrees are `known`, or in the rows' column `gone`."""
    for whole in batches:
        for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
            found = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("texts", "sizes", "paths")), batch.column("gone").to_pylist() if known is None else [known] * batch.num_rows)
            for bodies, sizes, paths, gone in rows:
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                found.append(kept_text([(text, tuple(paths[b - n : b])) for text, n, b in zip(bodies, sizes, ends)], known if known is not None else set(gone or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_subtrees: int = BROADCAST_SUBTREES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    blocks = parsed(pages)
    template = checkpointed(template_subtrees(blocks, least_pages, least_share).distinct())
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    columns = ["page_id", "url", "texts", "sizes", "paths"]
    if template.count() <= broadcast_subtrees:
        shared = pages.sparkSession.sparkContext.broadcast(template.toArrow().column("subtree").to_numpy())
        return blocks.select(*columns).mapInArrow(lambda it: text_batches(it, set(shared.value.tolist())), schema)
    # Beyond the bound, each page gets its own; a subtree of very many pages is split by Spark's handling of skewed joins.
    hits = blocks.select("row", F.explode("subtrees").alias("subtree")).join(template.hint("merge"), "subtree").groupBy("row").agg(F.collect_set("subtree").alias("gone"))
    return blocks.join(hits, "row", "left").select(*columns, "gone").mapInArrow(lambda it: text_batches(it, None), schema)
