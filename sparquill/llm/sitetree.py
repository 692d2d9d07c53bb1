"""HTML extraction with a site style tree.

Pages of a host are merged by the style of their elements (tag, classes and id along the path), leaf elements included. For each node of the tree,
entropy gives two importances over the host's different pages: of presentation (do pages fill it with different sequences of child tags?) and of content
(are its blocks found on few pages or on most?). What an element says of itself (a menu, footer, advert, form or reader comment by tag, role or name) is
a prior: such a branch is cut like one of low importance. An element that holds the page's article or main part, or most of its text with its heading,
or nearly all text of a page that marks no article, has no such prior. Branches of importance under `LOW` are cut from every page, but a node that holds
most of an article is not cut for being repeated, so near copies of an article survive on their host. Of what stays, the article is taken, or the main
part or the whole body where these hold much more text; blocks are joined in page order.

The tree is one aggregation with partial sums; blocks are counted at their own node and added up along the tree's paths afterwards. A host's pages are
spread over all tasks. Its low nodes go back to the pages by broadcast while their number is under `BROADCAST_ROWS`, else by a join on the host.

Defined results: a null html is empty and gives an empty text; a null url is a host of its own; repeated pages count once in the tree; hosts of fewer
than `LEAST_PAGES` different pages show no repetition, so that priors decide alone; unclosed, misnested and unknown tags are closed as a browser would
close them, roughly; hidden elements and those that aren't text (scripts, styles, ...) are no part of a page; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, portions

LEAST_PAGES, LOW, DAMPING, BROADCAST_ROWS = 4, 0.25, 0.9, 100_000
#: Shares of a page's text: an element with more than `MOST` of it has no prior; an article or main part with `ENOUGH` of it is taken alone.
MOST, ENOUGH = 0.9, 0.3

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")

# Element names of HTML by their role here.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas object audio video select title xmp noembed noframes".split())
#: An open element of the set ends where an element of that name begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {b: {"p"} for b in BLOCKS - {"li", "dt", "dd", "tr", "td", "th"}}
#: Elements and roles that say what they are.
SAYING = frozenset("nav footer aside form button menu dialog label".split())
ROLES = frozenset("navigation contentinfo complementary banner search dialog alertdialog menu menubar toolbar form".split())
#: Text itself, which only names of adverts tell apart.
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 p li td th tr tbody thead tfoot dt dd pre blockquote figcaption caption summary".split())
#: Words in class names and ids for what is not the article.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
NAMES = ADVERTS | frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs topbar sidebar sidenav rail widget widgets footer foot cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus replies respond related recommended recommendations copyright pagination pager form toolbar contentinfo complementary hidden".split())
#: Those that hold only outside an article, where they are the site's own.
OUTSIDE = NAMES | frozenset("header masthead banner head logo alert search discussion".split())
#: Those that make an article element a comment or a teaser.
SMALL = ADVERTS | frozenset("comment comments reply replies related recommended teaser".split())
#: A name's other words: these leave its meaning, and those before it take it away.
PLAIN = frozenset("area bar block body bottom box container content group header holder inner item items left links list outer panel right section slot top unit wrap wrapper".split())
WITH = frozenset("with has no not without is".split())


def says(value: str, names: frozenset[str]) -> bool:
    """Whether one of the names in a class or id attribute has a word of `names` as its last word, or as its first before plain words."""
    for token in value.split():
        words = [w.lower() for w in PARTS.findall(token)]
        if words and words[0] not in WITH and (words[-1] in names or words[0] in names and PLAIN.issuperset(words[1:])):
            return True
    return False


class Element:
    __slots__ = ("above", "article", "children", "gone", "h1", "holds", "named", "mass", "node", "path", "tag")

    def __init__(self, tag: str, above: Element | None, path: int, node: bool, named: bool, gone: bool, article: int):
        self.tag, self.above, self.path, self.node, self.named, self.gone, self.article = tag, above, path, node, named, gone, article
        self.children, self.mass, self.holds, self.h1 = {}, 0, False, False

    def chain(self) -> Iterator[Element]:
        e = self
        while e is not None:
            yield e
            e = e.above


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if "=" in text else {}


def _element(tag: str, above: Element, attributes: dict[str, str], bare: str) -> Element:
    names = " ".join(attributes[k] for k in ("class", "id") if k in attributes)
    role = attributes.get("role", "").lower()
    small = tag == "article" and says(names, SMALL)
    article = above.article if small else 2 if tag == "article" else max(above.article, int(tag == "main" or role == "main"))
    if tag in ("html", "body", "main") or tag == "article":
        named = small
    elif tag in LEAVES:
        named = says(names, ADVERTS)
    else:
        named = tag in SAYING or tag == "header" and not above.article or role in ROLES or bool(names) and says(names, NAMES if above.article else OUTSIDE)
    hidden = tag == "head" or "hidden" in bare or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    path = xxhash.xxh64_intdigest(f"{tag} {' '.join(sorted(names.lower().split()))}", above.path) >> 1
    made = Element(tag, above, path, tag in BLOCKS or named, named, above.gone or hidden, article)
    if not made.gone and (tag == "h1" or tag in ("article", "main") and not small):
        for e in above.chain():
            e.h1, e.holds = e.h1 or tag == "h1", e.holds or tag != "h1"
    return made


def parse(html: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """Of a page: its blocks of text in order, with the innermost element of each, and its elements that are nodes of the tree."""
    root = Element("", None, 1, False, False, False, 0)
    stack, blocks, nodes, words = [root], [], [], []

    def flush() -> None:
        text = SPACE.sub(" ", unescape("".join(words))).strip() if words else ""
        words.clear()
        if text and not stack[-1].gone:
            blocks.append((text, stack[-1]))
            for e in stack:
                e.mass += len(text)

    def apart(tag: str, element: Element) -> bool:
        return tag in BLOCKS or element.node or element.gone

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            words.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            words.append(" ")
        if m[1]:
            found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if found and (tag in BLOCKS or not any(e.tag in BLOCKS for e in stack[found + 1 :])):
                if any(apart(e.tag, e) for e in stack[found:]):
                    flush()
                del stack[found:]
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        for k in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[k].tag in CLOSES[tag]:
                del stack[k:]
                break
            if stack[k].tag in BLOCKS:
                break
        above = stack[-1]
        made = _element(tag, above, _attributes(m[3]), m[3].lower().split() if "hidden" in m[3].lower() else ())
        if tag not in BLOCKS and apart(tag, made) and not above.gone:
            flush()
        if made.node and not made.gone:
            nodes.append(made)
        above.children[tag] = None
        stack.append(made)
    if at < len(html):
        words.append(html[at:])
    flush()
    return blocks, nodes


def article(html: str, low: frozenset[int]) -> str:
    """The text of a page, given the tree's low nodes."""
    blocks, nodes = parse(html)
    total = sum(len(text) for text, _ in blocks)
    some = max((e.article for e in nodes), default=0) > 0
    cut = {e for e in nodes if e.named and not (e.holds or e.mass > total / 2 and e.h1 or not some and e.mass > MOST * total)}
    masses: dict[int, int] = {}
    whole = sum(len(text) for text, own in blocks if own.article or not some)
    for text, own in blocks if low else ():
        for path in {e.path for e in own.chain()} if own.article or not some else ():
            masses[path] = masses.get(path, 0) + len(text)
    cut |= {e for e in nodes if e.path in low and 2 * masses.get(e.path, 0) < whole}
    kept = [(text, own.article) for text, own in blocks if cut.isdisjoint(own.chain())]
    mass = [sum(len(text) for text, level in kept if level >= least) for least in range(3)]
    best = next(least for least in (2, 1, 0) if mass[least] and mass[least] >= ENOUGH * mass[0] or not least)
    return "\n".join(text for text, level in kept if level >= best)


def _rows(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


#: Of a node and a page: the paths above come with kind 0 alone.
NODE = "host string, path long, kind int, feature long, page long, above array<long>"


def features(html: str) -> tuple[int, set[tuple]]:
    """What a page adds to its host's tree: a hash of its text, and (paths from the node upwards, kind, feature): kind 0 for the node, 1 for its
    presentation, 2 for a block of its own."""
    blocks, nodes = parse(html)
    paths: dict[int, tuple[int, ...]] = {}

    def upwards(e: Element) -> tuple[int, ...]:
        if id(e) not in paths:
            paths[id(e)] = tuple(a.path for a in e.chain() if a.node)
        return paths[id(e)]

    page = xxhash.xxh64_intdigest("\n".join(t for t, _ in blocks)) >> 1
    own = {(upwards(e), 0, 0) for e in nodes} | {(upwards(e), 1, xxhash.xxh64_intdigest(" ".join(e.children)) >> 1) for e in nodes}
    own |= {(up, 2, xxhash.xxh64_intdigest(t) >> 1) for t, e in blocks if (up := upwards(e))}
    return page, own


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), _rows(batch.column("html"))
        for a, b in portions([p.encode() for p in pages], 4_000_000):
            out = []
            for host, html in zip(hosts[a:b], pages[a:b], strict=True):
                page, own = features(html)
                out += [(host, paths[0], kind, feature, page, None if kind else paths[1:]) for paths, kind, feature in own]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "path", "kind", "feature", "page", "above"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the nodes on rows (host, html); pages counts different pages.

    Over m pages, importance of presentation is the entropy (base m) of the styles; importance of content is 1 less the mean entropy of the blocks in the
    branch, the entropy of a block on k pages being log k / log m.
    """
    counts = pages.mapInArrow(_nodes, NODE).groupBy("host", "path", "kind", "feature", "page").agg(F.first("above").alias("above")).groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"), F.first("above").alias("above"))
    k = F.col("k").cast("double")
    own = counts.groupBy("host", "path").agg(F.first("above", True).alias("above"), *(F.sum(F.when(F.col("kind") == kind, value)).alias(name) for kind, value, name in ((0, k, "m"), (1, k, "styles"), (1, k * F.log(k), "style_logs"), (2, k, "blocks"), (2, k * F.log(k), "block_logs"))))
    at = F.explode(F.concat(F.array(F.struct(F.col("path").alias("path"), F.lit(True).alias("own"))), F.transform("above", lambda p: F.struct(p.alias("path"), F.lit(False).alias("own")))))
    branches = own.select("host", at.alias("at"), "m", "styles", "style_logs", "blocks", "block_logs").select("*", "at.*")
    sums = branches.groupBy("host", "path").agg(*(F.sum(F.when(F.col("own"), F.col(c))).alias(c) for c in ("m", "styles", "style_logs")), F.sum("blocks").alias("blocks"), F.sum("block_logs").alias("block_logs"))
    base = F.log(F.greatest(F.col("m"), F.lit(2.0)))
    style = (F.log("styles") - F.col("style_logs") / F.col("styles")) / base
    content = 1 - F.coalesce(F.col("block_logs") / F.col("blocks"), F.lit(0.0)) / base
    importance = F.when(F.col("m") > 1, (1 - DAMPING) * F.coalesce(style, F.lit(0.0)) + DAMPING * content).otherwise(1.0)
    return sums.select("host", "path", F.col("m").cast("long").alias("pages"), importance.alias("importance"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [article(h, frozenset(low or ())) for h, low in zip(_rows(batch.column("html")), batch.column("low").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", low: float = LOW, least: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    rows = pages.select(pages[id].cast("long").alias("page_id"), pages[url].alias("url"), pages[html].alias("html"), F.lower(F.coalesce(F.regexp_extract(pages[url], r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"))
    tree = keep(style_tree(rows.select("host", "html")).where((F.col("pages") >= least) & (F.col("importance") < low)).groupBy("host").agg(F.collect_list("path").alias("low")), "tree")
    size = tree.agg(F.coalesce(F.sum(F.size("low") + 4), F.lit(0))).first()[0]
    return rows.join(F.broadcast(tree) if size < BROADCAST_ROWS else tree, "host", "left").select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
