"""Main text of web pages, with boilerplate found by a suffix array over each host's pages (operator 1).

A page is parsed once and cut into blocks, each of one of three kinds: *article* (inside ``article`` or ``main``), *chrome*
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments, by element, role, class or id) and *open*
(all else). The words of chrome and open blocks are the page's stream.

The suffixes of all streams of a host are sorted by their words' numbers (range partitioning on host and the first
``DEPTH`` words, so a hot host and a hot beginning are spread over many tasks). Neighbours are compared: suffixes that follow on each other with
at least ``RUN`` words in common are an interval of the array, and its pages are counted, copies of one stream once. An
interval that reaches over the border of a task is summed from its parts. Longer repeats are intervals of each of their
suffixes, so the maximal repeated runs of a page are the unions of its suffixes' common beginnings. A run is repeated if at
least ``PAGES`` distinct streams of the host have it and at least a ``SHARE`` of them, so what counts doesn't shrink with
the size of the host. What such runs cover is cut out of open blocks that consist mostly of them; all other open blocks
stay whole, and so do all of a page that would be left without text.

Article blocks are proven by the markup and stay whole, chrome goes. Articles are not put into the stream: copies of an
article on one host are its text, not boilerplate, and a page whose markup names its article needs no guess about it. Pages
that name no article rest on the suffix array alone.

Markup: an ``article`` is chrome only where it is hidden, inside chrome, or its first class says that it is a comment or an
advert (``class="comment"``), ``main`` only where it is hidden or inside chrome. Inside an article a header is its own, ids never
decide, and a class only for boxes (see ``_named_chrome``). Formulas and the text of an ``object`` run on in the sentence around
them. Paragraphs, items and rows end where the next one begins.

Defined results: null and empty html give the empty text; a null url is a host of its own; broken markup (unclosed or
stray tags) drops no text but that of elements it leaves open inside chrome; a null page_id is kept; repeated rows count
as one page and are returned each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .shingles import mix, word_hashes

RUN, PAGES, SHARE = 5, 3, 0.5
#: Words of a suffix by which it is sorted, and suffixes that a task puts into a batch.
DEPTH, AT_ONCE = 8, 100_000
#: Parts into which the repeated prefixes of a host are dealt when they meet its number of streams.
PARTS = 64
ARTICLE, OPEN, CHROME = 0, 1, 2

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template iframe svg canvas audio video textarea select option title annotation annotation-xml".split())
#: Elements that are chrome by themselves, and roles, words of a class or id that make one so.
CHROME_TAGS = frozenset("nav header footer aside form head menu dialog button".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar toolbar "
    "comment comments commentlist disqus reply replies respond discussion related recommended share sharing social newsletter subscribe signup login form search pagination pager skip".split()
)
BESIDE = frozenset("has with no without".split())
#: Chrome words that say nothing inside an article, and those that make an ``article`` chrome.
OWN_WORDS = frozenset("header masthead discussion respond".split())
NO_ARTICLE = frozenset("comment comments reply replies ad ads adv advert adverts advertisement sponsor sponsored promo".split())
#: Words that go with a chrome word in a compound name without changing what it says.
NEUTRAL = frozenset("area bar block bottom box btn button buttons col column container desktop fixed global group holder icon icons inner item items left link links list main mobile outer page panel primary right row secondary section site sticky top wrap wrapper".split())
#: Names of boxes that hold the text, whatever else they are called.
CONTENT = frozenset("article article-body article-content content entry entry-content main-content post-body post-content story".split())
#: Elements of the text itself: in an article no class or id makes them chrome, elsewhere only a class that is a chrome word.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption tr td th tbody thead tfoot li dt dd figure hgroup address".split())
#: Elements that a new one ends: a paragraph by any block, an item or row by the next.
ENDED = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "option": frozenset(["option"])}
#: Elements that keep their place on the stack until they are closed; all others but RAW only separate blocks or not.
BOXES = CHROME_TAGS | frozenset("html body div section article main ul ol dl table figure details fieldset blockquote center address hgroup".split())
#: Elements inside which text runs on.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th object math semantics mrow mi mo mn ms mtext mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mpadded mphantom mfenced menclose".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _kind_of(tag: str, attributes: str, inside: int) -> int:
    """The kind of a box's own text, ``inside`` being that of the box around it."""
    if inside == CHROME:
        return CHROME
    classes: list[str] = []
    ids: list[str] = []
    role, hidden = "", False
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
            elif name == "class":
                classes = value.split()
            elif name == "id":
                ids = value.split()
    if hidden:
        return CHROME
    if tag in ("article", "main") or role in ("article", "main"):
        return CHROME if tag == "article" and classes and classes[0].lower() in NO_ARTICLE else ARTICLE
    if role in CHROME_ROLES or tag in CHROME_TAGS and not (tag == "header" and inside == ARTICLE):
        return CHROME
    return CHROME if tag not in ("body", "html") and _named_chrome(tag, classes, ids, inside) else inside


def _named_chrome(tag: str, classes: list[str], ids: list[str], inside: int) -> bool:
    """Whether its class or id makes a box chrome.

    Inside an article ids are made from headings and say nothing, nor do the classes of headings, paragraphs, items and
    rows; a compound class counts only if all of it does ("share-buttons", not "market-share"). Elsewhere any part of a
    name counts, but for boxes that are also called the content, and for elements of the text, whose class has to be a
    chrome word as it stands. "with-sidebar" says what stands beside a box, not what it is."""
    if tag in TEXT_TAGS:
        return inside != ARTICLE and any(c.lower() in CHROME_WORDS for c in classes)
    names = [WORD.findall(CAMEL.sub(" ", c).lower()) for c in (classes if inside == ARTICLE else classes + ids)]
    names = [own for own in names if BESIDE.isdisjoint(own)]
    if inside == ARTICLE:
        return any(not CHROME_WORDS.isdisjoint(set(own) - OWN_WORDS) and CHROME_WORDS | NEUTRAL >= set(own) for own in names)
    return not any(c.lower() in CONTENT for c in classes) and any(not CHROME_WORDS.isdisjoint(own) for own in names)


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the page's blocks in order, character references decoded and white space made one space."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, parts, at = OPEN, [], 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((kind, text))

    position, n = 0, len(page)
    while True:
        m = TAG.search(page, position)
        if m is None:
            parts.append(page[position:])
            break
        parts.append(page[position : m.start()])
        position = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, position)
                position = end.end() if end else n
            if tag not in ("svg", "annotation", "annotation-xml"):
                close()
            continue
        if not closing and stack and (stack[-1][0] == "p" and tag not in INLINE and tag != "br" or tag in ENDED.get(stack[-1][0], ())):
            close()
            kind = stack.pop()[1]
        if tag in BOXES:
            close()
            if not closing:
                stack.append((tag, kind))
                kind = _kind_of(tag, attributes, kind)
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        kind = stack[k][1]
                        del stack[k:]
                        break
        elif tag not in INLINE:
            close()
            if kind != CHROME and not closing and attributes and _kind_of(tag, attributes, kind) == CHROME and tag not in VOID:
                stack.append((tag, kind))  # a paragraph or item that is chrome: until it is closed
                kind = CHROME
            elif closing and stack and stack[-1][0] == tag:
                kind = stack.pop()[1]
        elif tag == "br" or tag in ("td", "th"):
            parts.append(" ")
    close()
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: its text if no block is open, else its blocks; its stream as 32-bit numbers of words, and their hash."""
    for batch in slices(batches, "html", 4 << 20):
        found = [blocks(page) if page else [] for page in batch.column("html").to_pylist()]
        stream = pa.array([" ".join(t for k, t in page if k != ARTICLE) for page in found], pa.string())
        numbers, offsets = word_hashes(stream)
        numbers = np.maximum((numbers >> np.uint64(32)).astype(np.uint32), 1)
        rows = []
        for page, a, b in zip(found, offsets.tolist(), offsets[1:].tolist()):
            opened = any(k == OPEN for k, _ in page)
            words = numbers[a:b].tobytes()
            content = int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)
            text = None if opened else "\n\n".join(t for k, t in page if k == ARTICLE)
            rows.append((opened, content, words, text, [k for k, _ in page] if opened else None, [t for _, t in page] if opened else None))
        own = _record(rows, ("opened", "content", "stream", "text", "kinds", "texts"), (pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())))
        yield pa.record_batch([*(batch.column(c) for c in KEYS), *own.columns], names=[*KEYS, *own.schema.names])


KEYS = ("page_id", "url", "host", "page")
PARSED = "page_id long, url string, host long, page long, opened boolean, content long, stream binary, text string, kinds array<int>, texts array<string>"


def heads(words: np.ndarray) -> np.ndarray:
    """Hashes of the first RUN words of suffixes (suffixes x at least RUN, 32-bit numbers)."""
    h = np.zeros(len(words), np.uint64)
    for k in range(RUN):
        h = mix(h + words[:, k])
    return h.view(np.int64)


def _suffixes(stream: bytes) -> np.ndarray:
    """The first DEPTH words of all suffixes that have RUN words at least; zeros behind the end."""
    words = np.frombuffer(stream, np.uint32)
    n = len(words) - RUN + 1
    if n <= 0:
        return np.zeros((0, DEPTH), np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.r_[words, np.zeros(DEPTH - RUN, np.uint32)], DEPTH)[:n]


def _rows_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """(values of the keys repeated for each suffix, places, suffixes) of the streams of several rows, about AT_ONCE suffixes at a time."""
    own, many = [], 0
    for batch in batches:
        for *values, stream in zip(*(batch.column(c).to_pylist() for c in (*keys, "stream"))):
            found = _suffixes(stream)
            if len(found):
                own.append((values, found))
                many += len(found)
            if many >= AT_ONCE:
                yield _joined(own)
                own, many = [], 0
    if own:
        yield _joined(own)


def _joined(own: list) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    n = [len(x) for _, x in own]
    return [np.repeat(np.array(v, np.int64), n) for v in zip(*(v for v, _ in own))], [x for _, x in own], np.concatenate([x for _, x in own])


def _to_sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, beginning, content, first) of all suffixes; first: no earlier suffix of the stream begins with its RUN words.
    Beginnings are big-endian, so that they sort by words."""
    for (host, content), parts, every in _rows_of(batches, ("host", "content")):
        first, at = np.zeros(len(every), bool), 0
        for part in parts:
            first[at + np.unique(heads(part), return_index=True)[1]] = True
            at += len(part)
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), len(every), [None, pa.py_buffer(every.astype(">u4").tobytes())])
        yield pa.record_batch([pa.array(host), raw.cast(pa.binary()), pa.array(content), pa.array(first)], names=["host", "beginning", "content", "first"])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, head, pages) of the intervals of sorted suffixes whose neighbours have RUN words or more in common. Of those
    that don't reach the border of the task, only such as PAGES streams have."""
    carried: list | None = None  # the last interval so far: host, head, pages
    last: tuple | None = None  # the suffix before: host, words, content
    edge = True  # the carried interval is the task's first
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        host, content, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("host", "content", "first"))
        words = np.frombuffer(b"".join(batch.column("beginning").to_pylist()), ">u4").reshape(n, DEPTH).astype(np.uint32)
        if last is None:
            last = (~host[0], words[0], content[0])
        before = np.concatenate([last[1][None], words[:-1]])
        same = np.r_[last[0], host[:-1]] == host
        common = np.where(same, np.logical_and.accumulate(before == words, axis=1).sum(axis=1), 0)  # with the suffix before
        again = (common == DEPTH) & (np.r_[last[2], content[:-1]] == content)  # a copy of the stream
        last = (host[-1], words[-1], content[-1])
        begins = np.flatnonzero(common < RUN)
        pages = np.add.reduceat((first & ~again).astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
        head = heads(words[begins])
        until = int(begins[0]) if len(begins) else n
        if carried is not None:
            carried[2] += int((first & ~again)[:until].sum())
        if not len(begins):
            continue
        done = [] if carried is None else [(*carried, edge)]
        edge = carried is None and len(begins) == 1
        if carried is None and len(begins) > 1:
            done.append((host[begins[0]], head[0], pages[0], True))
        inner = slice(0 if carried is not None else 1, len(begins) - 1)
        out = [(int(h), int(x), int(c)) for h, x, c, border in done if border or c >= PAGES]
        keep = pages[inner] >= PAGES
        out += list(zip(host[begins[inner]][keep].tolist(), head[inner][keep].tolist(), pages[inner][keep].tolist()))
        carried = [int(host[begins[-1]]), int(head[-1]), int(pages[-1])]
        if out:
            yield _record(out, ("host", "head", "pages"), (pa.int64(),) * 3)
    if carried is not None:
        yield _record([tuple(carried)], ("host", "head", "pages"), (pa.int64(),) * 3)


def _to_cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (host, page), parts, every in _rows_of(batches, ("host", "page")):
        start = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
        yield pa.record_batch([pa.array(host), pa.array(page), pa.array(start), pa.array(heads(every))], names=["host", "page", "start", "head"])


def _record(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))


def keep_unique(kinds: list[int], texts: list[str], covered: list[int]) -> str:
    """Article blocks and what isn't covered in open ones. covered: starts of repeated runs.

    A block with half of its words or fewer covered stays whole. Of others a covered stretch is cut out if it is the whole
    block or has RUN words there, so a run that only reaches into a block from the next one leaves it whole. If no text
    would be left, nothing tells the page's own text from its host's, and all open blocks stay.
    """
    flags: set[int] = set()
    for start in covered:
        flags.update(range(start, start + RUN))
    out, at = [], 0
    for kind, text in zip(kinds, texts):
        if kind == ARTICLE:
            out.append(text)
            continue
        words = text.split()
        n = len(re.findall(r"[^\x20\x09-\x0d]+", text))  # as the stream's words were counted
        if kind == OPEN:
            if n == len(words) and 2 * sum(w in flags for w in range(at, at + n)) > n:
                kept: list[str] = []
                for hit, stretch in groupby(enumerate(words, at), key=lambda w: w[0] in flags):
                    part = [w for _, w in stretch]
                    if not hit or len(part) < min(RUN, n):
                        kept += part
                text = " ".join(kept)
            if text:
                out.append(text)
        at += n
    return "\n\n".join(out or [t for k, t in zip(kinds, texts) if k == OPEN])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [keep_unique(k, t, c or []) for k, t, c in zip(*(batch.column(c).to_pylist() for c in ("kinds", "texts", "covered")))]
        yield _record(list(zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), texts, map(len, texts))), ("page_id", "url", "text", "n_chars"), (pa.int64(), pa.string(), pa.string(), pa.int64()))


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.xxhash64(host).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), F.col("html").cast("string").alias("html"))


def parse(pages: DataFrame) -> DataFrame:
    """The pages with their blocks or texts and their streams, written once."""
    return materialize(_rows(pages).mapInArrow(_parsed, PARSED), "parsed")


def intervals(parsed: DataFrame, run_pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """(host, head): the beginnings of RUN words that enough distinct streams of the host have, by the suffix array."""
    suffixes = parsed.select("host", "content", "stream").mapInArrow(_to_sort, "host long, beginning binary, content long, first boolean")
    order = ["host", "beginning", "content"]
    found = suffixes.repartitionByRange(*order).sortWithinPartitions(*order, F.col("first").desc()).mapInArrow(_intervals, "host long, head long, pages long")
    found = found.groupBy("host", "head").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= run_pages)
    hosts = parsed.where(F.octet_length("stream") >= 4 * RUN).groupBy("host", "content").count().groupBy("host").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") >= run_pages)
    hosts = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("part", F.col("part").cast("long"))
    found = found.withColumn("part", F.pmod("head", F.lit(PARTS)).cast("long")).join(hosts, ["host", "part"]).where(F.col("pages") >= share * F.col("contents"))
    return materialize(found.select("host", "head"), "repeated")


def repeated_runs(parsed: DataFrame, run_pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """page (a hash of the row), covered: where in each page's stream a repeated run of RUN words or more begins; the words
    from each of these on, RUN at a time, are the page's maximal runs."""
    suffixes = parsed.select("host", "page", "stream").mapInArrow(_to_cover, "host long, page long, start int, head long")
    return suffixes.join(intervals(parsed, run_pages, share), ["host", "head"], "left_semi").groupBy("page").agg(F.collect_set("start").alias("covered"))


def extract(pages: DataFrame, run_pages: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars.

    Pages whose blocks are all proven by the markup go as they are; those with open blocks meet the repeated runs of
    their host, which all pages of the host make.
    """
    parsed, schema = parse(pages), "page_id long, url string, text string, n_chars long"
    repeated = intervals(parsed, run_pages)
    opened = parsed.where("opened")
    suffixes = opened.select("host", "page", "stream").mapInArrow(_to_cover, "host long, page long, start int, head long")
    covered = suffixes.join(repeated, ["host", "head"], "left_semi").groupBy("page").agg(F.collect_set("start").alias("covered"))
    cut = opened.join(covered, "page", "left").select("page_id", "url", "kinds", "texts", "covered").mapInArrow(_assemble, schema)
    proven = parsed.where("NOT opened").select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
    return proven.unionByName(cut)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
