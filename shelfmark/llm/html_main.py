"""Main text of web pages: page furniture by markup, site templates by recurring subtrees.

One Python pass reads each page into blocks of text, each with hashes of the element subtrees that
hold it, and Spark counts in how many different bodies (texts that markup alone leaves of a page) of
a host each subtree recurs: a page met again under other addresses or with other furniture is the
same body.  Subtrees in at least ``least_pages`` bodies and ``share`` of the host's bodies are
template, and blocks inside them go.  There are two hashes:

* of the *text* of a subtree (tags and text, no attributes, so that marked menu entries and nonces
  do not hide a recurrence); text that stands loose between block elements has one of its own.
  Inside an element that the page declares its article only subtrees with a furniture word in
  their class, or mostly of links, can go by it: passages that articles quote stay;
* of the *shape* of a subtree (tags, class names and ids without digits, runs of equal children as
  one): menus and footers recur in shape even where each page words them differently.  Only whole
  branches beside the content have one, the content being the smallest element with most of the
  page's unlinked words and its heading; a shape that holds more than ``MOST_WORDS`` of a host's
  words is no furniture; and of a branch that is not mostly links the words but for digits count as
  well, so that what is said on one page alone (a lead, a last paragraph) is never taken for furniture.

A heading that recurs by itself (``Ingredients`` over each recipe) stays where the text after it
does.  If text hashes would leave less than ``LEAST_LEFT`` of the words of a page, the page is what recurs,
not its furniture, and they take nothing from it.

Markup is a prior for what recurs too rarely to be counted (new hosts, single adverts).  Element
names decide, and class names and ids if all their words are furniture words or say nothing
(``cookie-banner``, ``site-footer``); a furniture word among others (``recipe-notice``) does not,
unless the element is mostly links.  Words that may as well name the page's subject (``search``,
``form``) give way where nothing would be left.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, prepare, table

#: A whole tag; quotes count after ``=`` only.  No match: the page ends inside a tag.
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+|\d+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th wbr-".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input iframe svg math canvas object embed video audio map menu dialog "
    "noembed noframes datalist fieldset label".split()
)
#: Never shown, or controls without a text of their own.
UNSHOWN = frozenset("script style noscript template head title textarea iframe svg math canvas object embed video audio map noembed noframes datalist select option input".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption", "tbody", "tfoot", "thead", "tr"}
#: Start tags that end an open element of these names, up to the nearest of the third entry.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
}
#: Words of class names, ids and roles that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox banner sponsor sponsored promo promotion promoted outbrain taboola "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar sitemap skip "
    "sidebar aside widget widgets rail complementary footer foot contentinfo copyright colophon "
    "cookie cookies consent gdpr notice notices notification alert alertdialog disclaimer popup modal overlay dialog paywall toast "
    "comment comments commentlist disqus respond reply replies discussion guestbook "
    "share sharing social follow newsletter subscribe subscription signup signin login register search searchform form "
    "related recommended recommendations recirculation trending teaser teasers tagcloud hidden".split()
)
HEADERS = frozenset("header masthead topbar".split())
#: Furniture even where it holds an article of its own.
ASIDES = frozenset("comment comments commentlist disqus respond reply replies discussion guestbook related recommended recommendations recirculation trending teaser teasers sidebar".split())
#: Words of class names that say neither furniture nor content.
NEUTRAL = frozenset(
    "site page main global top bottom left right upper lower box block bar list item items wrapper wrap container inner outer section area link links icon icons "
    "reader readers user users visitor visitors google gpt div law info panel module unit slot holder group row col column primary secondary mobile desktop fixed sticky js btn button buttons the and by view large small wide".split()
)
#: Furniture words that give way where a page would have no text without what they name.
FAINT = frozenset("search searchform form share sharing social follow signin signup login register newsletter subscribe subscription respond reply menu rail foot widget widgets dialog overlay".split())
#: Headings below the page's own.
SUBHEADINGS = frozenset(("h2", "h3", "h4", "h5", "h6"))
#: Names with these words speak of furniture that is elsewhere or absent.
ABSENT = frozenset("with without has no free".split())
#: Elements in which loose text stands between block elements.
LOOSE = frozenset(("", "html", "body", "div", "section", "article", "main", "td", "li", "blockquote"))
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
LEAST_LEFT = 0.2
MOST_WORDS = 0.25


class _Element:
    __slots__ = ("tag", "number", "parent", "dropped", "head", "keeps", "article", "digest", "shape", "last", "soft", "side", "weak", "faint", "block", "linked", "words", "links")

    def __init__(self, tag: str, number: int, parent: _Element | None) -> None:
        self.tag, self.number, self.parent = tag, number, parent.number if parent else -1
        self.dropped = self.soft = self.side = self.head = self.keeps = self.weak = self.faint = False
        self.article = tag == "article" or tag == "main"
        self.digest, self.shape, self.last = xxhash.xxh3_64(tag), xxhash.xxh3_64(tag), b""
        self.block = number if parent is None or tag in BLOCK else parent.block
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.words = self.links = 0

    def holds(self, what: bytes) -> None:
        """Note a child's shape, runs of equal ones once."""
        if what != self.last:
            self.shape.update(what)
            self.last = what


def _judge(e: _Element, attrs: str) -> None:
    """What markup alone says of an element: ``dropped`` and ``soft`` furniture, ``weak`` hints, site ``head``."""
    e.dropped = e.tag in DROPPED
    e.head = e.tag == "header"
    if not attrs:
        return
    shape = []
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            value = html.unescape(value)
            shape.append(f"{name}={DIGITS.sub('', value)}")
            if name == "role" and value.lower() == "main":
                e.article = True
            for one in HUMP.sub("-", value).lower().split():
                words = set(WORDS.findall(one))
                if words & ABSENT:
                    continue
                rest = any(len(w) > 1 and not w.isdigit() and w not in FURNITURE and w not in NEUTRAL and w not in HEADERS for w in words)
                e.head |= bool(words & HEADERS) and not rest
                if words & FURNITURE and e.tag not in ("html", "body", "main"):
                    e.weak |= rest
                    # An article is one whatever else its class says, but for readers' comments and teasers.
                    e.soft |= not rest and (not e.article or bool(words & ASIDES))
                    e.side |= not rest and bool(words & ASIDES)
                    e.faint |= not rest and words & FURNITURE <= FAINT
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
            e.dropped = True
    e.shape.update(" ".join(shape).encode("utf-8", "surrogatepass"))


def _read(page: str) -> tuple[list[_Element], list[list[tuple[int, str]]]]:
    """Elements in document order, and runs of text between block tags as pieces with the element that holds each.

    Unclosed, misnested and broken-off markup is read as browsers do in the common cases; a tag that
    the end of the page cuts off is left out with what it would hold.
    """
    elements = [_Element("", 0, None)]
    stack = [0]
    runs: list[list[tuple[int, str]]] = []
    run: list[tuple[int, str]] = []

    def flush() -> None:
        nonlocal run
        if run:
            runs.append(run)
            run = []

    def pop() -> None:
        e = elements[stack[-1]]
        if e.tag in BLOCK:
            flush()
            elements[elements[e.parent].block].holds(e.shape.digest())
        stack.pop()
        elements[stack[-1]].digest.update(e.digest.digest())

    def close_to(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in stops:
                return
            if tag in names:
                while len(stack) > depth:
                    pop()
                if not any(elements[s].tag in names for s in stack[depth:]) and len(names) == 1:
                    return

    def text(data: str) -> None:
        if "&" in data:
            data = html.unescape(data)
        holder = elements[stack[-1]]
        run.append((holder.number, data))
        if words := data.split():
            holder.digest.update(" ".join(words).encode("utf-8", "surrogatepass"))
            elements[holder.block].holds(b"@" if holder.linked else b"#")
            holder.words += len(words)
            holder.links += len(words) * holder.linked

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0 or start == size - 1:
            text(page[at:])
            break
        after = page[start + 1]
        if after == "!" or after == "?" or (after == "/" and not page[start + 2 : start + 3].isalpha()):
            if start > at:
                text(page[at:start])
            if page.startswith("<!--", start):
                quick = page.startswith((">", "->"), start + 4)
                end = None if quick else COMMENT_END.search(page, start + 4)
                at = page.index(">", start) + 1 if quick else end.end() if end else size
            else:
                end_at = page.find(">", start)
                at = end_at + 1 if end_at >= 0 else size
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            text(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            text(page[at:start])
        m = TAG.match(page, start)
        if m is None:
            if after == "/" and not page[start + 2].isascii():  # no tag name
                at = page.find(">", start) + 1 or size
                continue
            break
        at = m.end()
        tag = m[1].lower()
        if after == "/":
            if tag == "br":
                run.append((stack[-1], " "))
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == tag:
                    while len(stack) > depth:
                        pop()
                    break
                # An inline end tag does not reach out of a block, nor any out of a table cell.
                if (tag not in BLOCK and elements[stack[depth]].tag in BLOCK) or (elements[stack[depth]].tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot")):
                    break
            if tag in SPACED:
                run.append((stack[-1], " "))
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == "p":
                    while len(stack) > depth:
                        pop()
                    break
                if elements[stack[depth]].tag in BLOCK or elements[stack[depth]].tag in ("td", "th"):
                    break
        if tag in IMPLIED:
            close_to(*IMPLIED[tag])
        if tag in BLOCK:
            flush()
        elif tag in SPACED:
            run.append((stack[-1], " "))
        if tag in VOID:
            continue
        e = _Element(tag, len(elements), elements[stack[-1]])
        _judge(e, m[2])
        elements.append(e)
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if m[2].rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.append(e.number)
    while len(stack) > 1:
        pop()
    flush()
    return elements, runs


Block = tuple[str, tuple[list[int], list[int]]]


def blocks_of(page: str | None, priors: bool = True) -> list[Block]:
    """Text blocks of the page's article, in order, each with text hashes and shape hashes of subtrees that hold it.

    If the page has ``article`` elements (or else ``main``) outside its furniture, what stands
    outside them is left out, and nested ones marked as comments go like all furniture; articles
    inside ``main`` leave the rest of that in.  A ``header``, and an element with furniture words as
    its class or id, is kept where it holds the page's heading or article (comments and the like:
    only the heading); the site's header is not kept for a first heading if the page has another one
    outside.  A furniture element takes its own text with it, inside a paragraph too.  Without
    ``priors`` only what is never shown goes.
    """
    return [(text, (within, shapes)) for text, within, shapes, _ in marked_blocks(page, priors)]


def marked_blocks(page: str | None, priors: bool = True) -> list[tuple[str, list[int], list[int], int | None]]:
    """The blocks of :func:`blocks_of`, with the hash of its own that a subheading has among the others (else null)."""
    if not page:
        return []
    elements, runs = _read(page)
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
        elements[e.parent].links += e.links
    for e in elements[1:]:
        if not priors:
            e.soft = e.head = e.weak = e.article = False
            e.dropped = e.dropped and e.tag in UNSHOWN
        e.soft |= e.weak and not e.article and 2 * e.links >= e.words > 0
    found = _kept_blocks(elements, runs)
    if not found and any(e.soft and e.faint for e in elements):
        for e in elements:
            e.soft = e.soft and not e.faint
            e.keeps = False
        found = _kept_blocks(elements, runs)
    return found


def _kept_blocks(elements: list[_Element], runs: list[list[tuple[int, str]]]) -> list[tuple[str, list[int], list[int], int | None]]:
    # What holds the page's heading or article is not furniture, whatever its class says.
    heads = [e for e in elements[1:] if e.tag == "h1"]
    under = {e.number: _any_above(elements, e.parent, lambda x: x.head) for e in heads}
    for e in elements[1:]:
        if (e.article and not e.soft) or (e.tag == "h1" and not (under[e.number] and not all(under.values()) and not _any_above(elements, e.parent, lambda x: x.article))):
            up = e.parent
            while up > 0:
                if not (e.tag == "article" and elements[up].side):
                    elements[up].keeps = True
                up = elements[up].parent
    gone, in_article, in_main = ([False] * len(elements) for _ in range(3))
    for e in elements[1:]:
        gone[e.number] = gone[e.parent] or e.dropped or ((e.soft or e.head) and not e.keeps)
        in_article[e.number] = in_article[e.parent] or (e.article and e.tag == "article")
        in_main[e.number] = in_main[e.parent] or (e.article and e.tag != "article")
    articles = [e.number for e in elements[1:] if e.article and e.tag == "article" and not gone[e.number]]
    mains = any(e.article and e.tag != "article" and not gone[e.number] for e in elements[1:])
    declared = in_main if mains and all(in_main[n] for n in articles) else in_article if articles else None
    around = _content_path(elements, gone)
    texts: dict[int, list[int]] = {}
    out, branches = [], []
    said: dict[int, list[str]] = {}
    for run in runs:
        kept = [(number, data) for number, data in run if not gone[number] and (declared is None or declared[number])]
        if joined := " ".join("".join(data for _, data in kept).split()):
            number = elements[kept[0][0]].block
            within = _chain(elements, number, texts, lambda e: e.digest if declared is None or e.weak or 2 * e.links >= e.words else None)
            own = _signed(elements[number].digest.intdigest()) if elements[number].tag in SUBHEADINGS else None
            if declared is None and elements[number].tag in LOOSE:
                within = [*within, _signed(xxhash.xxh3_64_intdigest(f"#{joined}".encode("utf-8", "surrogatepass")))]
            top = _branch(elements, number, around)
            said.setdefault(top, []).append(joined)
            branches.append(top)
            out.append((joined, within, own))
    shapes = {top: [] if top < 0 else [_signed(_furniture(elements[top], words))] for top, words in said.items()}
    return [(joined, within, shapes[top], own) for (joined, within, own), top in zip(out, branches, strict=True)]


def _furniture(e: _Element, words: list[str]) -> int:
    """What marks a branch beside the content: its shape, and its words without digits unless it is mostly links."""
    if 2 * e.links >= e.words:
        return e.shape.intdigest()
    return xxhash.xxh3_64_intdigest(e.shape.digest() + DIGITS.sub("0", "\n".join(words)).encode("utf-8", "surrogatepass"))


def _content_path(elements: list[_Element], gone: list[bool]) -> set[int]:
    """Elements that hold the content, or are part of it: those around the smallest with most unlinked words and the heading, and below."""
    own = [0 if gone[e.number] else e.words - e.links for e in elements]
    least = [own[0], *own[1:]]
    total = elements[0].words - elements[0].links
    root = max((e.number for e in elements if 2 * least[e.number] > total), default=0)
    head = next((e.number for e in elements[1:] if e.tag == "h1" and not gone[e.number]), None)
    above = [root]
    while above[-1] > 0:
        above.append(elements[above[-1]].parent)
    if head is not None:
        up = head
        while up not in above and up > root:
            up = elements[up].parent
        while up not in above:
            up = elements[up].parent
        above = above[above.index(up) :]
    root, path = above[0], set(above)
    for e in elements[root + 1 :]:
        if e.parent in path and (e.parent == root or e.parent not in above):
            path.add(e.number)
    return path


def _any_above(elements: list[_Element], number: int, what: Callable[[_Element], bool]) -> bool:
    while number > 0:
        if what(elements[number]):
            return True
        number = elements[number].parent
    return False


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(elements: list[_Element], number: int, known: dict[int, list[int]], of: Callable[[_Element], object]) -> list[int]:
    """Hashes of the block-level elements around a block, without recursion: pages nest deeply."""
    path = []
    while number > 0 and number not in known:
        path.append(number)
        number = elements[number].parent
    have = known.get(number, [])
    for n in reversed(path):
        e = elements[n]
        if e.tag in BLOCK and e.tag not in ("body", "html") and (hashed := of(e)) is not None:
            have = [*have, _signed(hashed.intdigest())]
        known[n] = have
    return have


def _branch(elements: list[_Element], number: int, around: set[int]) -> int:
    """The top of the whole branch beside the content that holds a block; -1 for the content itself."""
    top = -1
    while number not in around:
        if elements[number].tag in BLOCK:
            top = number
        number = elements[number].parent
    return top


def _inner(blocks: list[Block]) -> list[Block]:
    """The blocks without the text subtrees that hold all of them: these are the page's article, not template."""
    whole = set(blocks[0][1][0]).intersection(*(w for _, (w, _) in blocks[1:])) if blocks else set()
    return [(t, ([h for h in w if h not in whole], s)) for t, (w, s) in blocks]


KIND = "array<struct<text: string, within: array<long>, shapes: array<long>, own: long>>"


def _parse_batches(priors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("within", pa.list_(pa.int64())), ("shapes", pa.list_(pa.int64())), ("own", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                found = []
                for p in some.column(3):
                    marked = marked_blocks(p.as_py(), priors)
                    inner = _inner([(t, (w, s)) for t, w, s, _ in marked])
                    found.append([{"text": t, "within": w, "shapes": s, "own": own} for (t, (w, s)), (*_, own) in zip(inner, marked, strict=True)])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(found, kind)], names=["id", "url", "host", "blocks"])

    return run


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^?#]*?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, share: float = 0.5, priors: bool = True, templates: bool = True) -> DataFrame:
    """``id``, ``url``, ``text``, ``n_chars`` per row of ``pages``; all other columns are ignored, whatever their names.

    Null and empty pages, and pages without an article's text, give an empty text; a null url or one
    without a host makes the row part of one site of its own, of which nothing is taken for a
    template.  Repeated rows are returned each, and like all rows of a host with the same body count
    once.  Pages are read whole, however long; an empty table gives an empty result.  ``priors`` and
    ``templates`` switch off markup or recurrence, to measure the other.
    """
    prepare(pages.sparkSession)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), host_of(url).alias("host"), F.col(html_col).cast("string").alias("page"))
    parsed = materialise(rows.mapInArrow(_parse_batches(priors), f"id long, url string, host string, blocks {KIND}"), "html-blocks")
    bodies = parsed.filter("host <> ''").select("host", F.xxhash64(F.col("blocks.text")).alias("body"), "blocks")
    sites = bodies.groupBy("host").agg(F.count_distinct("body").alias("pages"))
    least = least_pages if templates else 1 << 62

    def recurring(met: DataFrame) -> DataFrame:
        return met.filter(F.col("n") >= least).join(sites, "host").filter(F.col("n") >= share * F.col("pages"))

    met = bodies.select("host", "body", F.explode(F.array_distinct(F.flatten(F.col("blocks.within")))).alias("subtree")).groupBy("host", "subtree").agg(F.count_distinct("body").alias("n"))
    # At most 1 / share times a page's subtrees can recur so often: the arrays are short.
    by_text = materialise(recurring(met).groupBy("host").agg(F.collect_list("subtree").alias("within_gone")), "html-templates")

    def gone(b: F.Column, kind: str) -> F.Column:
        return F.coalesce(F.arrays_overlap(b[kind], F.col(f"{kind}_gone")), F.lit(False))

    def without(blocks: F.Column, kind: str) -> F.Column:
        if kind == "shapes":
            return F.filter(blocks, lambda b: ~gone(b, kind))

        def stays(b: F.Column, i: F.Column) -> F.Column:
            # A subheading that is gone by its own hash alone stays where the first text after it does.
            alone = b["own"].isNotNull() & ~F.exists(b[kind], lambda h: (h != b["own"]) & F.array_contains(F.col(f"{kind}_gone"), h))
            then = F.get(F.filter(F.slice(blocks, i + 2, F.size(blocks)), lambda x: x["own"].isNull()), F.lit(0))
            return ~gone(b, kind) | F.coalesce(alone & then.isNotNull() & ~gone(then, kind), F.lit(False))

        return F.filter(blocks, stays)

    def n_words(text: F.Column) -> F.Column:
        return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1

    def all_words(blocks: F.Column) -> F.Column:
        return F.aggregate(blocks, F.lit(0), lambda n, b: n + n_words(b["text"]))

    left = bodies.join(by_text, "host", "left").select("host", "body", F.explode(without(F.col("blocks"), "within")).alias("b"))
    counted = left.select("host", "body", F.try_element_at("b.shapes", F.lit(1)).alias("subtree"), n_words(F.col("b.text")).alias("words"))
    sizes = counted.groupBy("host").agg(F.sum("words").alias("all_words"))
    shaped = counted.filter("subtree is not null").groupBy("host", "subtree").agg(F.count_distinct("body").alias("n"), F.sum("words").alias("words"))
    small = recurring(shaped).join(sizes, "host").filter(F.col("words") <= MOST_WORDS * F.col("all_words"))
    by_shape = materialise(small.groupBy("host").agg(F.collect_list("subtree").alias("shapes_gone")), "html-templates")
    joined = parsed.join(by_text, "host", "left").join(by_shape, "host", "left").withColumn("shaped", without(F.col("blocks"), "shapes")).withColumn("kept", without(F.col("shaped"), "within"))
    kept = F.when(all_words(F.col("kept")) < LEAST_LEFT * all_words(F.col("shaped")), F.col("shaped")).otherwise(F.col("kept"))
    return joined.select("id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
