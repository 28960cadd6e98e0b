"""Main text of web pages: site templates removed by subtree frequency, then block text.

Each page is parsed into a small element tree. Subtrees of block containers are hashed
with their markup and text; Spark counts, for each host, the pages that hold a subtree,
and subtrees on many of a host's pages are its template. The second pass deletes
template subtrees, elements that are boilerplate by their tag or by a whole name in their
class, id or role, and returns the text of the blocks that are left.

Defined results
- null or empty html: empty text. A null url: a host of its own, the empty one.
- no `article` or `main` element: the whole body is read.
- by a name no element is dropped that is or holds an `article` or `main`, or most of
  the page's text, and inside of those no paragraph, heading, list item or other element of running text (but hidden ones).
- inside `article` or `main` only `div` and `section` can be template, so
  that an article that a site repeats keeps its text, and none that holds most of its text.
- broken markup: unclosed elements end with their parent; stray end tags are skipped; behind a
  tag whose quotes are not closed, quotes don't count.
- pages of a host with the same main text count as one page; every row is returned.
- an empty table gives no rows; columns beside id, url and html are only passed on.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.llm.common import cut_lineage, in_arrow, salted_join, small

#: A subtree is template if at least so many pages of its host, and this share of them, hold it.
MIN_PAGES = 5
MIN_SHARE = 0.3

#: What is no tag; a tag, whose quoted values may hold any character; and one where quotes don't count.
#: None goes back over what it has read.
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>")
UNQUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
BEGINS = re.compile(r"</?[a-zA-Z]")
#: An attribute's name with its value, or a value without a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+|\"[^\"]*+\"|'[^']*+'")
# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot "
    "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Tags of one kind end an open one of the same kind.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset({"div", "section"})
DROPPED = frozenset(
    "head script style noscript template nav aside footer form button select option textarea input label iframe object embed "
    "canvas svg audio video dialog menu title xmp noembed noframes".split()
)
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored sponsors promo "
    "promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended comment comments disqus respond reply replies login search toolbar pagination pager masthead skip "
    "complementary contentinfo hidden".split()
)
KEPT = frozenset({"article", "main"})
#: Elements of running text, which inside an article no name drops.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd table tr td th figure figcaption hgroup body html".split())


class Element:
    __slots__ = ("tag", "words", "children", "vital")

    def __init__(self, tag: str, words: frozenset[str]):
        self.tag, self.words, self.children, self.vital = tag, words, [], False


def markup(text: str, at: int, quotes: bool) -> tuple[re.Match | None, bool]:
    """The next markup from a place on, and whether quotes count behind it.

    A tag whose end isn't found, as of an unclosed quote, ends at the next >, and from there on quotes
    don't count, so that a page is read through twice at most.
    """
    while (at := text.find("<", at)) >= 0:
        found = OTHER.match(text, at) or (QUOTED if quotes else UNQUOTED).match(text, at)
        if found is None and quotes and BEGINS.match(text, at):
            quotes, found = False, UNQUOTED.match(text, at)
        if found:
            return found, quotes
        at += 1
    return None, quotes


def names(attributes: str) -> frozenset[str]:
    """The words of class, id, role and itemprop, and `hidden` of what is not shown."""
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value:
            words.add("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            words.update(value.split())
    return frozenset(words)


def parse(text: str) -> Element:
    """The tree of elements and strings; strings keep their character references."""
    root, at, quotes = Element("", frozenset()), 0, True
    stack, open_ = [root], Counter()

    def end(i: int) -> None:
        """End the open elements from the i-th on."""
        open_.subtract(e.tag for e in stack[i:])
        del stack[i:]

    while True:
        m, quotes = markup(text, at, quotes)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        if m.re is OTHER:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                end(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in CLOSES_P and open_["p"] > 0 and (p := next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag not in INLINE), 0)) and stack[p].tag == "p":
            end(p)
        elif tag in SAME and any(open_[t] > 0 for t in SAME[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[tag]:
                    end(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select", "div"):
                    break
        element = Element(tag, names(m[3]))
        stack[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            element.children.append(text[at : close.start() if close else len(text)])
            at = close.end() if close else len(text)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(element)
            open_[tag] += 1
    if at < len(text):
        stack[-1].children.append(text[at:])
    mark_vital(root)
    return root


def mark_vital(root: Element) -> None:
    """Mark what is or holds an article or main, or most of the page's text that isn't dropped by its tag."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.children if isinstance(c, Element) and c.tag not in DROPPED]
    sizes: dict[int, int] = {}
    for e in reversed(order):
        sizes[id(e)] = sum(sizes.get(id(c), 0) if isinstance(c, Element) else len("".join(c.split())) for c in e.children)
        e.vital = e.tag in KEPT or any(c.vital for c in e.children if isinstance(c, Element))
    for e in order:
        e.vital = e.vital or 2 * sizes[id(e)] > sizes[id(root)]


def boilerplate(e: Element, inside: bool) -> bool:
    if e.tag in DROPPED or (e.tag == "header" and not inside):
        return True
    return not (e.vital or (inside and e.tag in RUNNING and "hidden" not in e.words) or DROPPED_WORDS.isdisjoint(e.words))


def walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Elements that aren't dropped, with whether they stand in an article, in page order."""
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        yield e, inside
        stack += [(c, inside or c.tag in KEPT) for c in reversed(e.children) if isinstance(c, Element) and not boilerplate(c, inside)]


def subtree_hashes(root: Element) -> dict[int, int]:
    """By id() of each element that may be a template, the hash of its subtree; each is hashed once."""
    inside = {id(e): i for e, i in walk(root)}
    out: dict[int, int] = {}
    done: dict[int, int] = {}
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        e, seen = stack.pop()
        if not seen:
            stack.append((e, True))
            stack += [(c, False) for c in e.children if isinstance(c, Element)]
            continue
        parts = [f"{done[id(c)]:x}" if isinstance(c, Element) else " ".join(c.split()) for c in e.children]
        done[id(e)] = key = xxhash.xxh64_intdigest(f"{e.tag}\0{' '.join(sorted(e.words))}\0" + "\0".join(parts)) - (1 << 63)
        if id(e) in inside and e.tag not in INLINE | KEPT | {"", "html", "body"}:
            if (not inside[id(e)] or e.tag in CONTAINERS) and any(isinstance(c, Element) or c.strip() for c in e.children):
                out[id(e)] = key
    return out


def holds_most(root: Element) -> set[int]:
    """By id(), the elements that hold most of the text, without boilerplate, of an outermost article or main."""
    order, stack = [], [(root, None)]
    while stack:
        e, top = stack.pop()
        inside = top is not None
        top = e if top is None and e.tag in KEPT else top
        order.append((e, top))
        stack += [(c, top) for c in e.children if isinstance(c, Element) and not boilerplate(c, inside or e.tag in KEPT)]
    sizes: dict[int, int] = {}
    for e, _ in reversed(order):
        sizes[id(e)] = sum(sizes.get(id(c), 0) if isinstance(c, Element) else len("".join(c.split())) for c in e.children)
    return {id(e) for e, top in order if top is not None and 2 * sizes[id(e)] > sizes[id(top)]}


def blocks(root: Element, template: set[int]) -> list[str]:
    """Texts of the blocks in page order, from article or main elements if there are any."""
    found = [e for e, inside in walk(root) if e.tag in KEPT and not inside]
    keys = subtree_hashes(root) if template else {}
    most = holds_most(root) if template else set()
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    for top in found or [root]:
        stack: list = [(top, bool(found))]
        while stack:
            item, inside = stack.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                run.append(item)
            elif item.tag in ("br", "wbr", "img", "hr"):
                run.append("" if item.tag == "wbr" else " ")
                if item.tag == "hr":
                    end()
            elif (item is not top and boilerplate(item, inside)) or (keys.get(id(item)) in template and id(item) not in most):
                if item.tag not in INLINE:
                    end()
            else:
                inside = inside or item.tag in KEPT
                block = item.tag not in INLINE
                stack += [(None, inside)] * block + [(c, inside) for c in reversed(item.children)]
                if block:
                    end()
        end()
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = [parse(t) for t in batch.column(2).to_pylist()]
        keys = [sorted(set(subtree_hashes(t).values())) for t in trees]
        mains = [xxhash.xxh64_intdigest("\n".join(blocks(t, set()))) - (1 << 63) for t in trees]
        columns = [batch.column(0), batch.column(1), pa.array(mains, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["page", "host", "main", "keys"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            "\n".join(blocks(parse(t), set(keys or ()))) for t, keys in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next of / ? #, in lower case; else empty."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page, key): the subtrees that each page loses, page being a hash of the row."""
    read = pages.select(page_key().alias("page"), host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = read.transform(in_arrow, _hashed, "page long, host string, main long, keys array<long>")
    rows = cut_lineage(rows)
    held = rows.select("page", "host", "main", F.explode("keys").alias("key"))
    sizes = rows.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    distinct = held.select("host", "key", "main").distinct()
    often = distinct.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    template = cut_lineage(often.join(sizes, "host").filter(F.col("n") >= F.col("_all") * min_share).select("host", "key"))
    return salted_join(held, template, ["host", "key"], "page").groupBy("page").agg(F.collect_set("key").alias("keys"))


def page_key() -> Column:
    return F.xxhash64("page_id", "url", "html")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of every page."""
    gone = small(cut_lineage(template_subtrees(pages)))
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), page_key().alias("page"))
    joined = read.join(gone, "page", "left").select("page_id", "url", "html", "keys")
    types = dict(pages.dtypes)
    return joined.transform(in_arrow, _extracted, f"page_id {types['page_id']}, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
