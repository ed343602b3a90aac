"""Main text of web pages by removal of what a site repeats.

1. Each page is parsed once into elements (tag, parent, hash of the whole subtree)
   and text blocks. Scripts, styles, markup, menus, forms and elements that their
   tag or role, or by the end of a class or id word, are page furniture hold no blocks.
   A class or id does not count where the element holds an article, main or more
   than half of the page's text (see ``read_page``); such subtrees are left to the counts of step 2.
2. Per host, Spark counts on how many different pages each subtree hash occurs.
   Copies of one page count once, so an article does not become a template by
   being copied.
3. Subtrees that occur on many pages of their host are deleted: from half of the
   pages outside an article, and only from nine in ten inside one. At most
   (subtrees per page / share) hashes of a host can pass, so the list that a page
   is checked against stays short however many pages the host has.

A page whose ``article`` and ``main`` elements hold at least half of the text that
is left after that gives the blocks inside them, any other page all blocks that are
left. Character references are decoded, white space inside a
block becomes one space, blocks are joined in page order by one space.

Null and empty pages have an empty text; a null url is a host of its own; repeated
rows give their rows again; broken markup (missing or stray end tags, a page cut
off anywhere) is read as far as it goes; an empty table gives no rows. Pages of any
length and depth are read whole; of equally long articles the first counts as the
largest; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import as_texts, slices
from rasterloom.plans.scratch import materialise

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
FURNITURE = frozenset("head nav footer aside button select option dialog menu svg math canvas object audio video map datalist fieldset label legend".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
IMPLIED_END = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies footer header "
    "masthead topbar toolbar share sharing social related newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager teaser teasers".split()
)
# Those of them under which nothing is the page's own text, even in an article of its own.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
CONTENT = frozenset(("article", "main"))
NEVER = frozenset(("html", "body", "article", "main"))

OUTSIDE_SHARE, OUTSIDE_PAGES = 0.5, 5
INSIDE_SHARE, INSIDE_PAGES = 0.9, 10

# A quote opens a value only after "="; anywhere else it is an ordinary character.
_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+)|[^>=]++)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[^a-z0-9]+")
_PREFIXES = frozenset(("has", "no", "with", "is", "without"))
# What may follow a name of furniture in a class word: "sidebar-left", "comments-area".
_FORMS = frozenset("left right top bottom inner outer area bar block box button container content group header footer inside item items link links list row section slot title unit widget wrap wrapper".split())


def named_furniture(word: str, in_content: bool) -> bool:
    """Whether a class or id word is a furniture name, alone or at the end, before endings such as -left or -area."""
    parts = [x for x in _NAME.split(word) if x]
    if not _PREFIXES.isdisjoint(parts):
        return False
    while len(parts) > 1 and (parts[-1] in _FORMS or parts[-1].isdigit()) and parts[-1] not in NAMES:
        parts.pop()
    # an article keeps its own header: entry-header
    return bool(parts) and parts[-1] in NAMES and not (in_content and parts[-1] == "header")


def is_furniture(tag: str, attributes: str, in_content: bool) -> bool:
    """Whether an element is page furniture by its tag or role, whatever it holds."""
    if tag in NEVER:
        return False
    if tag in FURNITURE or (tag == "header" and not in_content):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
    return False


def furniture_words(tag: str, attributes: str, in_content: bool) -> list[str]:
    """The class and id words of an element that name it as page furniture; a form is named by its tag."""
    if tag == "form":
        return ["form"]
    if tag in NEVER and tag != "article" or not attributes or "=" not in attributes:
        return []
    values = [value.strip("\"'").lower() for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id")]
    return [word for value in values for word in value.split() if named_furniture(word, in_content)]


def read_page(text: str) -> "Page":
    """A page without its furniture.

    Elements named as furniture are read first. Those are kept that hold the page's
    largest article or main (neither one inside another nor one below readers'
    comments counts), or more than half of the text that no other rule drops. Where
    an article with text stands outside of all of them, a whole word such as
    class="ad", a form or a word for comments counts however long the element is,
    and only longer words give way to its size.
    """
    first = Page(text, None)
    if not first.named:
        return first
    size = [0] * len(first.tags)
    for block, owner in zip(first.blocks, first.owners, strict=True):
        if owner >= 0:
            size[owner] += len(block)
    for number in range(len(first.tags) - 1, -1, -1):
        if first.parents[number] >= 0:
            size[first.parents[number]] += size[number]
    total = sum(map(len, first.blocks))
    names = {number for _, number, _, _ in first.named}
    readers = {number for _, number, _, by_readers in first.named if by_readers}
    under, below_readers, outer = [], [], []
    for number, above in enumerate(first.parents):
        under.append(number in names or (above >= 0 and under[above]))
        below_readers.append(number in readers or (above >= 0 and below_readers[above]))
        if first.content[number] and not (above >= 0 and first.inside[above]) and not below_readers[number] and size[number]:
            outer.append(number)
    # one that no name casts doubt on comes before a longer one that is named, or lies in something named
    largest = max(outer, key=lambda number: (not under[number], number not in names, size[number]), default=-1)
    holding = set()
    while largest >= 0:
        holding.add(largest)
        largest = first.parents[largest]
    article = any(o >= 0 and first.inside[o] and not under[o] for o in first.owners)
    return Page(text, frozenset(start for start, number, whole, _ in first.named if number in holding or (2 * size[number] > total and not (whole and article))))


class Page:
    """Elements and blocks of one page.

    Elements named as furniture are dropped unless the number of their start tag is
    in ``kept``; with None they all stay, and ``named`` lists them.
    """

    def __init__(self, text: str, kept: frozenset | None = frozenset()) -> None:
        self.kept = kept
        # number of the start tag, of the element, whether a whole word or a word for comments names it, whether the latter
        self.named: list[tuple[int, int, bool, bool]] = []
        self.content: list[bool] = []
        self._starts = 0
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.hashes: list[int] = []
        self.inside: list[bool] = []
        self.blocks: list[str] = []
        self.owners: list[int] = []
        self.key = 0
        self._open: list[int] = []  # element numbers from the root down
        self._count: dict[str, int] = {}
        self._parts: list[list[bytes]] = []
        self._dropped: list[bool] = []
        self._held: list[str] = []
        self._read(text)
        while self._open:
            self._close()
        self._flush()

    def _read(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            found = _MARKUP.search(text, at)
            if not found:
                self._text(text[at:])
                break
            if found.start() > at:
                self._text(text[at : found.start()])
            at = found.end()
            tag = found[2]
            if not tag:
                continue
            tag = tag.lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3])
            if tag in RAW and not found[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
                at = stop.start() if stop else n

    def _text(self, raw: str) -> None:
        if self._open and self._dropped[-1]:
            return
        self._held.append(raw)

    def _flush(self) -> None:
        """End the current block: its text belongs to the innermost open element."""
        if not self._held:
            return
        text = " ".join(html.unescape("".join(self._held)).split())
        self._held = []
        if text:
            self.blocks.append(text)
            self.owners.append(self._open[-1] if self._open else -1)
            if self._parts:
                self._parts[-1].append(text.encode("utf-8", "surrogatepass"))

    def _start(self, tag: str, attributes: str) -> None:
        self._starts += 1
        if tag not in INLINE:
            self._flush()
        if tag in CLOSES_P and self._count.get("p"):
            self._end("p", ("table", "td", "th", "button", "object"))
        if tag in IMPLIED_END:
            names, limits = IMPLIED_END[tag]
            for name in names.split():
                if self._count.get(name):
                    self._end(name, limits)
        if tag in VOID or tag in INLINE and not attributes:
            return
        above = self._open[-1] if self._open else -1
        in_content = bool(self._open) and self.inside[above]
        gone = (bool(self._open) and self._dropped[-1]) or is_furniture(tag, attributes, in_content)
        if not gone and (words := furniture_words(tag, attributes, in_content)):
            if tag in INLINE:
                gone = True
            elif self.kept is None:
                readers = any(not READERS.isdisjoint(_NAME.split(w)) for w in words)
                self.named.append((self._starts, len(self.tags), readers or tag == "form" or not NAMES.isdisjoint(words), readers))
            else:
                gone = self._starts not in self.kept
        if tag in INLINE and not gone:
            return  # inline elements only matter where they are furniture
        self.tags.append(tag)
        self.content.append(tag in CONTENT and not gone)
        self.parents.append(above)
        self.hashes.append(0)
        self.inside.append(in_content or (tag in CONTENT and not gone))
        self._open.append(len(self.tags) - 1)
        self._parts.append([tag.encode()])
        self._dropped.append(gone)
        self._count[tag] = self._count.get(tag, 0) + 1

    def _end(self, tag: str, limits: tuple[str, ...] = ()) -> None:
        if tag in INLINE and not self._count.get(tag):
            return
        if tag not in INLINE:
            self._flush()
        if not self._count.get(tag):
            return
        if limits:
            for number in reversed(self._open):
                if self.tags[number] == tag:
                    break
                if self.tags[number] in limits:
                    return
        while self.tags[self._open[-1]] != tag:
            self._close()
        self._close()

    def _close(self) -> None:
        number = self._open[-1]
        if self.tags[number] not in INLINE:
            self._flush()
        self._open.pop()
        parts = self._parts.pop()
        self._dropped.pop()
        self._count[self.tags[number]] -= 1
        if len(parts) > 1:
            digest = xxhash.xxh64_digest(b"\0".join(parts))
            self.hashes[number] = int.from_bytes(digest, "big", signed=True) or 1
            if self._parts:
                self._parts[-1].append(digest)
        if not self._open and self.hashes[number]:
            self.key = int.from_bytes(xxhash.xxh64_digest(b"%d %d" % (self.key, self.hashes[number])), "big", signed=True)


PARSED = "page_id long, url string, host string, key long, parents array<int>, hashes array<long>, inside array<boolean>, blocks array<string>, owners array<int>"


def host_of(url: str | None) -> str | None:
    found = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else None


def parse_pages(pages: DataFrame) -> DataFrame:
    """The elements and blocks of every page, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                read = [read_page(t) for t in as_texts(piece.column("html"))]
                hosts = [host_of(u) for u in piece.column("url").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("page_id"), piece.column("url"), pa.array(hosts, pa.string()), pa.array([p.key for p in read], pa.int64()),
                        pa.array([p.parents for p in read], pa.list_(pa.int32())), pa.array([p.hashes for p in read], pa.list_(pa.int64())),
                        pa.array([p.inside for p in read], pa.list_(pa.bool_())), pa.array([p.blocks for p in read], pa.list_(pa.string())),
                        pa.array([p.owners for p in read], pa.list_(pa.int32())),
                    ],
                    names=["page_id", "url", "host", "key", "parents", "hashes", "inside", "blocks", "owners"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, PARSED)


def site_templates(parsed: DataFrame) -> DataFrame:
    """Per host the subtree hashes that recur: ``outside`` and ``inside`` an article."""
    each = parsed.select("host", "key", "hashes").dropDuplicates(["host", "key"])
    sizes = each.groupBy("host").agg(F.count("*").alias("pages"))
    hits = each.select("host", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash <> 0").groupBy("host", "hash").agg(F.count("*").alias("n"))
    joined = hits.where(F.col("n") >= OUTSIDE_PAGES).alias("h").join(sizes.alias("s"), F.col("h.host").eqNullSafe(F.col("s.host")))
    often = joined.where((F.col("n") >= OUTSIDE_SHARE * F.col("pages")) & (F.col("pages") >= OUTSIDE_PAGES))
    strong = (F.col("n") >= INSIDE_SHARE * F.col("pages")) & (F.col("pages") >= INSIDE_PAGES)
    return often.groupBy("h.host").agg(
        F.collect_list("hash").alias("outside"), F.collect_list(F.when(strong, F.col("hash"))).alias("inside_too")
    )


def main_blocks(parents: list[int], hashes: list[int], inside: list[bool], blocks: list[str], owners: list[int], outside: frozenset, within: frozenset) -> list[str]:
    """The blocks of one page that neither lie in a template nor outside an article that holds most of the rest."""
    dead: list[bool] = []
    for parent, value, own in zip(parents, hashes, inside, strict=True):
        dead.append((parent >= 0 and dead[parent]) or value in (within if own else outside))
    live = [(b, o >= 0 and inside[o]) for b, o in zip(blocks, owners, strict=True) if o < 0 or not dead[o]]
    within_article = sum(len(b) for b, own in live if own)
    only = within_article > 0 and 2 * within_article >= sum(len(b) for b, _ in live)
    return [b for b, own in live if own or not only]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text (the main text) of every page."""
    parsed = materialise(parse_pages(pages), "pages-parsed")
    templates = materialise(site_templates(parsed), "site-templates")
    joined = parsed.alias("p").join(templates.alias("t"), F.col("p.host").eqNullSafe(F.col("t.host")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("parents", "hashes", "inside", "blocks", "owners", "outside", "inside_too")]
            texts = [" ".join(main_blocks(p, h, i, t, o, frozenset(out or ()), frozenset(w or ()))) for p, h, i, t, o, out, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "parents", "hashes", "inside", "blocks", "owners", "outside", "inside_too").mapInArrow(run, "page_id long, url string, text string")
