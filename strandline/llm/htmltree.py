"""Main text of web pages by site style trees.

The pages of one host are merged by the style path of their elements (tag and class names from the root).
For each merged element two entropies say how important it is: presentation, how much the sequence of its
child styles varies between pages, and content, how far its texts differ between pages. A branch that looks
and reads the same on page after page is boilerplate. What tags and class names state about an element
(navigation, notices, adverts, forms; article) weighs that importance, of every block. Branches whose weighed
importance is low are removed from each page and the rest is returned as blocks of text.

Tree nodes are counted over all pages of a host with Spark aggregates; no task needs a host's pages at once.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import text as tx
from strandline.llm.work import dropped, new_path, saved, small_batches

#: Importance under which a branch is removed.
THRESHOLD = 0.4
#: Weight of an element's own content against the presentation of its parent.
DECAY = 0.9
#: Importance of a path that only one page has, so that nothing is known of it.
UNMEASURED = 0.7
#: Weights: in the article; outside it on a page that marks one; in a branch whose name holds a noise word among
#: others; and where a tag, a role or a whole name says noise, which no importance outweighs.
ARTICLE, OUTSIDE, NAMED, NOISE = 1.5, 0.6, 0.5, 0.35
#: Weight of a name that only says where in a layout something stands or what it deals with.
SOFT = 0.8
#: Measured (host, path) keys that are broadcast at most; more are joined by host.
BROADCAST_KEYS = 2_000_000

# Tags and name parts that say what an element is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q s samp small span strike strong sub sup time tt u var br wbr img".split())
INLINE |= frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mspace mpadded semantics".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas noframes xmp annotation annotation-xml".split())
NOISE_TAGS = frozenset("head nav footer aside form button select option input fieldset dialog menu menuitem audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox adunit banner banners sponsor sponsored promo promos promotion promoted "
    "sidebar sidebars side rail menu menus submenu nav navbar navigation topnav subnav breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer foot bottombar "
    "cookie cookies consent gdpr notice notices notification popup modal overlay alert newsletter subscribe subscription signup login register paywall "
    "share sharing social related recommended recommendations widget widgets tags taglist search searchbox form "
    "comment comments commentlist commentary disqus respond reply replies discussion reviews copyright disclaimer legal skip".split()
)
SOFT_NAMES = frozenset("header head side rail legal reviews discussion".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article content main post entry story articlebody postbody".split())
#: Tags whose start closes an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody"}, "body": {"head"}}
BLOCK_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Element:
    tag: str
    path: str
    noise: bool = False
    named: bool = False
    soft: bool = False
    main: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    path: str
    parent: str
    text: str
    noise: bool
    named: bool
    soft: bool
    main: bool


@functools.lru_cache(maxsize=4096)
def _says_noise(names: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether one of the class names and ids consists of noise words, holds such a word among others, and holds one of a layout.

    Inside an article, layout words are never noise by themselves: an article has headers and may deal with law or reviews.
    """
    words = [_parts(name) for name in names.split()]
    hard = NOISE_NAMES - SOFT_NAMES
    whole = any(w and all(n in (hard if inside else NOISE_NAMES) for n in w) for w in words)
    return whole, any(n in hard for w in words for n in w), any(n in SOFT_NAMES for w in words for n in w)


@functools.lru_cache(maxsize=4096)
def _parts(names: str) -> list[str]:
    """Words that class names and ids are made of, camel case and punctuation apart."""
    return _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """A page's text blocks in order and its elements. Markup that isn't closed ends with its parent."""
    stack = [Element("", "")]
    elements: list[Element] = [stack[0]]
    blocks: list[Block] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                top = stack[-1]
                blocks.append(Block(top.path, stack[-2].path if len(stack) > 1 else "", joined, top.noise, top.named, top.soft, top.main))

    def pop(names) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                flush()
                del stack[k:]
                return
            if stack[k].tag in ("table", "ul", "ol", "dl", "select", "body", "article", "main", "section", "div"):
                return

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    flush()
                    del stack[k:]
                    break
            else:
                if tag in BLOCK_CLOSES_P:
                    flush()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        flush()
        if tag in CLOSES:
            pop(CLOSES[tag])
        if tag in BLOCK_CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        above = stack[-1]
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        given = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        names = _parts(given)
        label = ".".join([tag, *sorted(set(names))])
        above.children.append(label)
        role = attributes.get("role", "").lower()
        noise = tag in NOISE_TAGS or role in NOISE_ROLES or (tag == "header" and not above.main) or "hidden" in m[3].lower().split()
        named = soft = False
        if tag not in MAIN_TAGS and tag not in ("html", "body"):
            whole, named, soft = _says_noise(given, above.main)
            noise = noise or whole
        main = not noise and not named and (tag in MAIN_TAGS or role in ("main", "article") or (any(n in MAIN_NAMES for n in names) and tag not in ("html", "body")))
        # what the name around an article holds says nothing of the article
        starts = main and not above.main
        element = Element(tag, f"{above.path}/{label}", above.noise or noise, (above.named and not starts) or named, (above.soft and not starts) or soft, above.main or main)
        elements.append(element)
        if tag not in VOID:
            stack.append(element)
    flush()
    return blocks, elements


def host_of(url: str | None) -> str:
    """The host of a url without port and user, lower case; empty where there is none."""
    m = re.match(r"\s*[a-zA-Z][-+.\w]*://([^/?#\s]*)", url or "")
    return m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "replace")) - (1 << 63)


#: What a node row counts: that the page has the path, a text that stands there, the sequence of its child styles.
PAGE, CONTENT, PRESENTATION = 0, 1, 2
NODE_SCHEMA = "host string, path bigint, parent bigint, kind int, feature bigint, page bigint"


def nodes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """What pages bring to their host's tree: (host, path, parent, kind, feature, page).

    path stands for host and path, page for a page's bytes, so copies of a page count once.
    """

    def run(batches):
        for part in tx.chunks(batches, html):
            columns: list[list] = [[], [], [], [], [], []]
            seen = set()
            for address, page in zip(part.column(url).to_pylist(), part.column(html).to_pylist(), strict=True):
                host, digest = host_of(address), _hash(page or "")
                if (host, digest) in seen:
                    continue
                seen.add((host, digest))
                blocks, elements = parse(page or "")
                found = {(_hash(host, b.path), _hash(host, b.parent), CONTENT, _hash(b.text)) for b in blocks}
                shapes = {(_hash(host, e.path), _hash(*e.children)) for e in elements}
                found |= {(path, 0, PRESENTATION, shape) for path, shape in shapes}
                found |= {(path, 0, PAGE, 0) for path, _ in shapes}
                for path, parent, kind, feature in found:
                    for column, v in zip(columns, (host, path, parent, kind, feature, digest), strict=True):
                        column.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "parent", "kind", "feature", "page"])

    return pages.select(url, html).mapInArrow(run, NODE_SCHEMA)


def importance(found: DataFrame) -> DataFrame:
    """Of nodes: (host, path, importance from 0 to 1) for every path with text that several pages have.

    With m pages that have a path, content is 1 - mean over its texts of log(pages with the text) / log m, and
    presentation the entropy of the child sequences to the base m. A path on one page is left out.
    Everything is a sum over counted features, so no count is joined to single nodes.
    """
    counted = found.groupBy("host", "path", "parent", "kind", "feature").agg(F.count_distinct("page").alias("n"))
    n = F.col("n").cast("double")
    only = lambda kind, c: F.when(F.col("kind") == kind, c)
    sums = counted.groupBy("host", "path").agg(
        F.max(only(PAGE, n)).alias("m"), F.max(only(CONTENT, F.col("parent"))).alias("parent"), F.count(only(CONTENT, n)).alias("texts"), F.sum(only(CONTENT, F.log(n))).alias("text_logs"),
        F.sum(only(PRESENTATION, n)).alias("total"), F.sum(only(PRESENTATION, n * F.log(n))).alias("shape_logs"),
    )
    alone = F.coalesce(F.col("m") <= 1, F.lit(True))
    content = F.when(alone, 1.0).otherwise(1 - F.col("text_logs") / F.col("texts") / F.log("m"))
    presentation = F.when(alone, 1.0).otherwise(F.least(F.lit(1.0), (F.log("total") - F.col("shape_logs") / F.col("total")) / F.log("m")))
    above = sums.select(F.col("path").alias("parent"), presentation.alias("presentation"))
    own = sums.where("texts > 0 and m > 1").select("host", "path", "parent", content.alias("content"))
    return own.join(above, "parent", "left").select("host", "path", (DECAY * F.col("content") + (1 - DECAY) * F.coalesce("presentation", F.lit(1.0))).alias("importance"))


def weighed_blocks(page: str, host: str) -> Iterator[tuple[int, float, str]]:
    """A page's blocks in order: hash of host and path, the weight that tags, names and place give, and the text."""
    blocks, _ = parse(page)
    marked = any(b.main and not (b.noise or b.named) for b in blocks)
    for b in blocks:
        if b.noise:
            weight = NOISE
        else:
            outside = OUTSIDE if marked and not b.main else 1.0
            weight = NAMED * outside if b.named else (ARTICLE if b.main else outside) * (SOFT if b.soft else 1.0)
        yield _hash(host, b.path), weight, b.text


def kept_blocks(page: str, host: str, measured: Mapping[int, float] | set[int], threshold: float = THRESHOLD) -> Iterator[str]:
    """Texts of a page's branches whose weighed importance isn't low. measured: importance of the host's paths that several pages have."""
    for path, weight, text in weighed_blocks(page, host):
        if weight * (measured[path] if path in measured else UNMEASURED) >= threshold:
            yield text


BLOCK_SCHEMA = "row bigint, place int, path bigint, weight double, block string"


def joined(pages: DataFrame, measured: DataFrame, url: str, html: str, text: str, threshold: float) -> DataFrame:
    """pages with the main text where there are too many importances to broadcast: blocks are joined to them by path, and put together again by page."""
    own = next(name for name in (f"_row{k}" for k in range(len(pages.columns) + 1)) if name not in pages.columns)
    numbered = saved(pages.withColumn(own, F.monotonically_increasing_id()), "numbered-pages")

    def run(batches):
        for part in tx.chunks(batches, html):
            columns: list[list] = [[], [], [], [], []]
            for row, address, page in zip(part.column(own).to_pylist(), part.column(url).to_pylist(), part.column(html).to_pylist(), strict=True):
                for place, found in enumerate(weighed_blocks(page or "", host_of(address))):
                    for column, v in zip(columns, (row, place, *found), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "place", "path", "weight", "block"])

    blocks = numbered.select(own, url, html).mapInArrow(run, BLOCK_SCHEMA).join(measured.select("path", "importance"), "path", "left")
    kept = blocks.where(F.col("weight") * F.coalesce("importance", F.lit(UNMEASURED)) >= threshold)
    texts = kept.groupBy(F.col("row").alias(own)).agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "block")))["block"], "\n").alias("_text"))
    return numbered.join(texts, own, "left").select(*[F.col(c) for c in pages.columns], F.coalesce("_text", F.lit("")).alias(text))


def extract(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """pages with the main text: blocks joined by newlines; empty where there is none, as for a null page.

    Rows without a host share one tree. Copies of a page are one page of its tree and get the same text.
    The paths' importances are counted and broadcast if they are few enough; else they are joined to the
    pages' blocks by path. A column named as ``text`` is replaced.
    """
    spark = pages.sparkSession
    small_batches(spark)
    at = new_path(spark, "style-nodes")
    found = saved(nodes(pages, url, html), "style-nodes", at)
    measured = saved(importance(found), "measured-paths", new_path(spark, "measured-paths"))
    fields = [f for f in pages.schema.fields if f.name != text]
    out = T.StructType([*fields, T.StructField(text, T.StringType())])
    base = pages.select([f.name for f in fields])
    dropped(spark, at)
    if measured.count() > BROADCAST_KEYS:
        return joined(base, measured, url, html, text, threshold)
    rows = measured.select("path", "importance").toArrow()
    shared = spark.sparkContext.broadcast((rows.column(0).to_numpy(), rows.column(1).to_numpy()))

    def run(batches):
        common = dict(zip(*(v.tolist() for v in shared.value), strict=True))
        for part in tx.chunks(batches, html):
            texts = ["\n".join(kept_blocks(page or "", host_of(address), common, threshold)) for address, page in zip(part.column(url).to_pylist(), part.column(html).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(texts, pa.string())], names=out.names)

    return base.mapInArrow(run, out)
