"""Main text of web pages: boilerplate by long token runs that pages of a host repeat, and by markup.

A page is read as blocks of text with the markup around them. Text outside the article is a stream of
words. Boilerplate are the words inside a repeat of RUN words or more that stands on a SHARE of the
host's distinct pages (two at least), or inside a repeat of LONG words or more that stands on two of
them. Pages with equal text outside furniture are one distinct page, so copies of a page are no repeat.

No suffix array is built: the union of all maximal repeats of at least n words equals the union of the
repeated windows of n words, so windows are hashed, sorted through Spark's shuffle and counted. Windows
of LONG words are made only where the windows of RUN words in them repeat. The sort is per host and
window, with counts made before the shuffle, so a host with a third of all pages is no large group.

Repetition alone is not enough: articles quote lines that other pages have too, and menus or adverts
may stand on one page only. So words inside an article (or main) element are never removed as repeats,
and elements that are furniture by tag, role, class or id are removed even if unique. A class or id
names furniture only as a whole: each of its words must be a furniture or layout word. Inside an
article that goes for containers and a shorter list; ids of headings, paragraphs and sections never count.

Null and empty html gives empty text; a page without markup is one block. Null hosts count as one
host. Repeated rows of one page count as one page (by page_id and html), so a page never repeats
itself. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlane.llm.base import bound, held, table
from driftlane.llm.words import inside, mix, slices, window_hashes

#: Words of the shortest repeat that counts as boilerplate on a share of the host's distinct pages, and on any two of them.
RUN, LONG = 6, 24
SHARE = 0.1
#: The list of repeats is broadcast to the last scan up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 32_000_000
#: What may stand after "<" in markup, the name of a tag, where a name ends, and what matters inside a tag.
MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z]))")
NAME_END = re.compile(r"[\s/>]|\Z")
SPECIAL = re.compile("[\"'>]")
#: A whole tag, never read twice from one place.
WHOLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Possessive, and tried only where a name begins, so that long runs of letters are read once.
ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = frozenset("script style noscript template textarea title svg iframe object select canvas annotation annotation-xml xmp noembed noframes".split())
#: Of these, what holds text of its own inside an article.
TEXT_IN_MAIN = frozenset(("noscript", "object"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mfenced menclose mstyle mspace "
    "mpadded mphantom merror mtable mtr mtd semantics".split())
FURNITURE = frozenset("head nav footer aside form button menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
#: Words of a class or id that name furniture in articles and elsewhere, furniture outside articles only, and those
#: that may stand beside one in a furniture name ("share-buttons", but not "share-prices").
ADVERT = frozenset("ad ads advert adverts advertisement advertisements advertising advertorial adsense sponsored".split())
IN_ARTICLES = ADVERT | frozenset(
    "banner sponsor sponsors promo promos nav navbar navigation menu menus menubar sidebar footer breadcrumb breadcrumbs newsletter subscribe share sharing social related "
    "recommended recommendation recommendations trending comment comments disqus respond reply replies pagination pager toolbar widget cookie cookies consent gdpr notice "
    "popup modal overlay search signup login".split())
ANYWHERE = IN_ARTICLES | frozenset(
    "sponsorship promotion promotions promoted side masthead notification notifications recommends skip searchbox searchform searchbar copyright legal".split())
LAYOUT = frozenset(
    "site page global main primary secondary top bottom left right header footer inner outer box bar block area wrap wrapper container content holder section panel column col "
    "row slot unit group link links list item items button buttons btn btns icon icons form input field media post posts article articles stories story text to and us our policy "
    "info js is has fixed sticky desktop mobile".split())
NAME_WORD = re.compile(r"[^_-]+")
#: Prose elements whose names say little: inside articles or not, only adverts, comments and forms to subscribe or share go by their class.
PROSE_NAMES = ADVERT | frozenset("newsletter subscribe share sharing comment comments cookie cookies consent gdpr".split())


def _named(name: str, marks: frozenset) -> bool:
    """Whether a whole class or id is made of ``marks`` and layout words or numbers, with at least one mark."""
    words = NAME_WORD.findall(name.lower())
    return not marks.isdisjoint(words) and all(w in marks or w in LAYOUT or w.isdigit() for w in words)


#: Elements that group others; inside an article only they are furniture by name (adverts apart), and ids count only outside sections.
CONTAINERS = frozenset("div aside ul ol section".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p section blockquote pre figure dl dt dd".split())
MAIN = frozenset(("article", "main"))
SPACE = re.compile(r"\s+")
#: Start tags that end an open paragraph, list item, cell or row of their own kind.
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _furniture(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not in_main):
        return True
    if "=" not in attributes or tag in ("html", "body"):
        return "hidden" in attributes.split()
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or "hidden" in ATTRIBUTE.sub("", attributes).split():
        return True
    if tag in MAIN:
        return False
    if tag in PROSE and tag not in CONTAINERS:
        marks = PROSE_NAMES
    elif in_main:
        marks = IN_ARTICLES if tag in CONTAINERS else ADVERT
    else:
        marks = ANYWHERE
    names = found.get("class", "").split() + ([] if tag in PROSE else found.get("id", "").split())
    return any(_named(n, marks) for n in names)


class Tags:
    """The markup of a page in order, in one forward pass.

    Tags are matched whole. From the first one on that never ends, the places of all that matters are
    listed and what follows them is remembered, so nothing is scanned twice however the page is broken.
    """

    def __init__(self, page: str):
        self.page = page
        self.special: list[int] | None = None
        self.ends: dict[int, int] = {}
        self.name = (0, 0)

    def end_of_tag(self, at: int) -> int:
        """Place of the ">" that ends a tag whose attributes begin at ``at``, outside quotes; -1 if there is none."""
        passed, end = [], -1
        k = bisect.bisect_left(self.special, at)
        while k < len(self.special):
            q = self.special[k]
            if q in self.ends:
                end = self.ends[q]
                break
            passed.append(q)
            if self.page[q] == ">":
                end = q
                break
            close = self.page.find(self.page[q], q + 1)
            if close < 0:
                break
            k = bisect.bisect_right(self.special, close)
        self.ends.update(dict.fromkeys(passed, end))
        return end

    def __iter__(self) -> Iterator[tuple[int, int, bool, str | None, str]]:
        """(start, end, whether an end tag, tag, attributes); tag is None for comments and the like."""
        page, at = self.page, 0
        while hit := MARKUP.search(page, at):
            start, at = hit.start(), hit.end()
            if hit[2] is None:
                mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(hit[0], ">")
                end = page.find(mark, at)
                at = len(page) if end < 0 else end + len(mark)
                yield start, at, False, None, ""
                continue
            if self.special is None:
                if whole := WHOLE.match(page, start):
                    at = whole.end()
                    yield start, at, bool(whole[1]), whole[2].lower(), whole[3]
                    continue
                self.special = [m.start() for m in SPECIAL.finditer(page, at)]
            if not self.name[0] <= at <= self.name[1]:
                self.name = at, NAME_END.search(page, at).start()
            name = self.name[1]
            end = self.end_of_tag(name)
            if end >= 0:
                yield start, end + 1, bool(hit[1]), page[at - 1:name].lower(), page[name:end]
                at = end + 1


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in the article, in furniture) of the page's text blocks in order.

    Elements are kept on a stack; an end tag closes up to its own element and is ignored without
    one, what the page leaves open ends with it, and furniture reaches to the end of its element.
    """
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in main, in furniture
    open_: Counter = Counter()  # tags of the stack
    at, main, waste = 0, False, False

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, main, waste))
            parts.clear()

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    for start, end, ends, tag, attributes in Tags(page):
        if start < at:
            continue
        if start > at:
            parts.append(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in RAW and not ends and not (main and tag in TEXT_IN_MAIN):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in INLINE and not (tag not in VOID and not ends and _furniture(tag, attributes, main)) and not (ends and open_[tag]):
            continue
        flush()
        if ends:
            if open_[tag]:
                while pop() != tag:
                    pass
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            if tag in CLOSES_PARAGRAPH and stack and stack[-1][0] == "p":
                pop()
            elif tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                pop()
            up = stack[-1] if stack else ("", False, False)
            stack.append((tag, up[1] or tag in MAIN, up[2] or _furniture(tag, attributes, up[1] or tag in MAIN)))
            open_[tag] += 1
        main, waste = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    if at < len(page):
        cut = re.compile("<[a-zA-Z/!?]").search(page, max(at, page.rfind(">") + 1))  # a tag that the page leaves unfinished
        parts.append(page[at:cut.start() if cut else len(page)])
    flush()
    return out


def _keyed(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", F.xxhash64("page_id", "html").alias("page_key"), host.alias("host"), "html")


def stray_runs(pages: DataFrame, run: int) -> DataFrame:
    """page_key, host, stream, hash, at, open: every run of ``run`` words outside the article; ``at`` counts such words.

    ``stream`` is the hash of the page's words outside furniture. ``open`` says that a word of the run is
    in no furniture, so that it matters whether the run repeats. Each page has besides a row with null hash.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [blocks(h) if h else [] for h in batch.column(2).to_pylist()]
            streams = np.array([int.from_bytes(hashlib.blake2b(" ".join(t for t, _, w in r if not w).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                                for r in read], np.int64)
            stray = [[(t, waste) for t, main, waste in r if not main] for r in read]
            n = len(read)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(streams), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())], names)
            for first, words in slices(pa.array([" ".join(t for t, _ in s) for s in stray], pa.large_string()), False):
                some = stray[first:first + len(words.counts)]
                loose = np.array([not waste for s in some for t, waste in s for _ in range(t.count(" ") + 1)], bool)
                near = np.concatenate([[0], np.cumsum(loose)])
                at = inside(words.first, run)
                text_of = np.searchsorted(words.first, at, "right") - 1
                rows = pa.array(first + text_of)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(streams[first + text_of]),
                    pa.array(window_hashes(words.hashes(), run)[at].view(np.int64)), pa.array((at - words.first[text_of]).astype(np.int32)),
                    pa.array(near[at + run] > near[at]),
                ], names)

    names = ["page_key", "host", "stream", "hash", "at", "open"]
    return _keyed(pages).select("page_key", "host", "html").mapInArrow(scan, "page_key long, host string, stream long, hash long, at int, open boolean")


def _counted(runs: DataFrame) -> DataFrame:
    """host, hash, pages: the runs that stand on at least two distinct pages of the host."""
    return runs.select("host", "hash", "stream").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")


def long_runs(found: DataFrame, run: int, long_: int) -> DataFrame:
    """page_key, host, stream, hash, at of every run of ``long_`` words made of repeated runs of ``run`` words."""
    steps = [*range(0, long_ - run, run), long_ - run]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                runs = batch.column(3)[k].values
                at, hashes = runs.field("at").to_numpy(), runs.field("hash").to_numpy().view(np.uint64)
                last = np.arange(len(at) - (long_ - run))
                start = last[at[last + (long_ - run)] - at[last] == long_ - run] if len(last) else last
                total = np.zeros(len(start), np.uint64)
                for step in steps:
                    total = mix(total + hashes[start + step])
                rows = pa.array(np.full(len(start), k))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(rows) for c in range(3)), pa.array(total.view(np.int64)), pa.array(at[start].astype(np.int32))],
                    ["page_key", "host", "stream", "hash", "at"])

    pages = found.groupBy("page_key", "host", "stream").agg(F.array_sort(F.collect_set(F.struct("at", "hash"))).alias("runs"))
    return pages.mapInArrow(join, "page_key long, host string, stream long, hash long, at int")


def extracted(pages: DataFrame, run: int = RUN, long_: int = LONG, share: float = SHARE) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html).

    Pages are parsed twice, so that no page has to be kept or sent anywhere but in the last join, and
    there only if the list of repeats is too long to broadcast.
    """
    every = held(stray_runs(pages, run))
    runs = every.where("hash is not null")
    sizes = every.where("hash is null").select("host", "stream").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    found = held(runs.join(_counted(runs), ["host", "hash"]).join(sizes, "host"))
    wide = found.where("open").where(F.col("pages") >= F.lit(share) * F.col("of")).select("page_key", F.explode(F.sequence("at", F.col("at") + (run - 1))).alias("at"))
    longs = held(long_runs(found, run, long_))
    deep = longs.join(_counted(longs), ["host", "hash"]).select("page_key", F.explode(F.sequence("at", F.col("at") + (long_ - 1))).alias("at"))
    covered = held(wide.union(deep).groupBy("page_key").agg(F.sort_array(F.collect_set("at")).alias("covered")))
    if (covered.agg(F.sum(F.size("covered") * 4 + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        covered = F.broadcast(covered)
    joined = _keyed(pages).join(covered, "page_key", "left").select("page_id", "url", "html", "covered")

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, places in zip(frame["html"], frame["covered"]):
                gone = set(places if places is not None else ())
                kept, at = [], 0
                for text, main, waste in blocks(page) if page else ():
                    if not main:
                        words = text.split(" ")
                        text = " ".join(w for k, w in enumerate(words, at) if k not in gone)
                        at += len(words)
                    if text and not waste:
                        kept.append(text)
                out.append("\n".join(kept))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": out})

    return joined.mapInPandas(clean, "page_id long, url string, text string")


@bound("op9_html")
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
