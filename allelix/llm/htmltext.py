"""Operator 7: main text of web pages, by differencing with the page of the nearest URL.

A page is parsed into lines, one for each block.  Pages of a host are ordered by
URL path; of the nearest page before it and the nearest after it whose lines
differ from its own, a page is paired with the one whose path shares the longer
beginning with its path.  The lines outside the article of both pages are aligned by a longest common subsequence, and the lines that they share are deleted: menus,
notices and footers repeat from page to page, content does not.

Markup settles what differencing cannot see from one pair.  Lines in <article>
(else <main>) are the article and are kept, also where another page is a copy of
it; lines in menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, by element, class, id or role, go.  So differencing has no say in the
text of a page with either element; its lines only tell its neighbours' menus.
Without either element the text is what is left of the body after both.

Scale: each page is parsed once, into a table of its lines.  What is shuffled for the
pairing is a 64-bit hash for each line outside articles.  Neighbours are found by numbering the range-sorted pages and joining the
numbers at the ends of each run of like pages, so a host with a third of all pages
is spread over all tasks.  Only a row for each range partition reaches the driver.

Defined results: null or empty html has an empty text; a null url is a host and
path of its own; the only page of a host has nothing deleted, nor have pages of a
host that are all alike, and copies are not paired with each other; repeated rows share their result, and each gives a row;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positioned, stored

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noembed iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav footer aside form head noscript template button select datalist dialog svg canvas object menu".split())
SCOPE = frozenset("article main section div body td th li table ul ol blockquote form aside nav header footer".split())
#: Words of class and id values that name something other than the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr notice notices "
    "popup popups modal overlay newsletter subscribe subscription signup login comment comments disqus replies respond sidebar sidebars widget widgets "
    "related recommended share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager toolbar masthead".split()
)
OUTSIDE = frozenset("header footer".split())  # these words, and <header>, only count outside the article
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
BODY, MAIN, ARTICLE, GONE = 0, 1, 2, 3
KEY = "struct<file:long,at:long>"
#: Larger alignments by rows are halved first, so that a table takes no more than 16 MB.
TABLE_BITS = 1 << 27


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "article", "main") or "=" not in attributes:
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if key.lower() == "role":
            if value.strip().lower() in ROLES and not (in_article and value.strip().lower() == "banner"):
                return True
        else:
            for w in WORDS.findall(value):
                w = w.lower()
                if w in NAMES or (w in OUTSIDE and not in_article):
                    return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, place) of each block in page order; place is BODY, MAIN, ARTICLE or GONE."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []  # (element, what it adds: 0, MAIN, ARTICLE or GONE)
    depth = [0, 0, 0, 0]
    at, n = 0, len(page)

    def flush() -> None:
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append((text, GONE if depth[GONE] else ARTICLE if depth[ARTICLE] else MAIN if depth[MAIN] else BODY))

    def cut(k: int) -> None:
        flush()
        for _, what in stack[k:]:
            depth[what] -= 1
        del stack[k:]

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        buffer.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if k >= 0 and (name not in INLINE or any(what for _, what in stack[k:])):
                cut(k)
            elif k >= 0:
                del stack[k]
                depth[0] -= 1
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            flush() if name not in INLINE else None
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before
                if stack[i][0] == "p" or (stack[i][0] == name == "li"):
                    cut(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if name in VOID or attributes.endswith("/"):
            continue
        what = GONE if _unwanted(name, attributes, depth[ARTICLE] > 0) else {"article": ARTICLE, "main": MAIN}.get(name, 0)
        if what and name in INLINE:
            flush()
        stack.append((name, what))
        depth[what] += 1
    flush()
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Equal ends are matched first.  Between them, where lines mostly occur once, it is
    found from the matching places (Hunt and Szymanski); where lines repeat so often that
    there are many more matches than lines, row by row with a bit for each line of ``b``.
    """
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    count = Counter(y)
    few = sum(count[v] for v in x) <= 16 * (len(x) + len(y))
    middle = _by_places(x, y) if few else _by_rows(x, y)
    return [*range(lo), *(lo + k for k in middle), *range(len(a) - hi, len(a))]


def _by_places(a: list[int], b: list[int]) -> list[int]:
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit vectors of the table of lengths, a row for each line of ``a`` (the last alone unless ``keep``): bit j is 0 where the length grows at b[j]."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    out = [row]
    for x in a:
        u = row & masks.get(x, 0)
        row = ((row + u) | (row - u)) & full
        if keep:
            out.append(row)
        else:
            out[0] = row
    return out


def _by_rows(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:  # halve ``a`` where the halves' lengths add up to most
        half = len(a) // 2
        lengths = []
        for part, line in ((a[:half], b), (a[half:][::-1], b[::-1])):
            bits = np.frombuffer(_rows(part, line, False)[0].to_bytes(-(-len(b) // 8), "little"), np.uint8)
            lengths.append(np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))]))
        cut = int(np.argmax(lengths[0] + lengths[1][::-1]))
        return _by_rows(a[:half], b[:cut]) + [half + k for k in _by_rows(a[half:], b[cut:])]
    rows = _rows(a, b, True)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, as far as it is one."""
    if not url:
        return "", ""
    try:
        parts = urlsplit(url)
    except ValueError:
        return "", url
    return parts.netloc.lower(), parts.path


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, page_id, url, html) to (key, page_id, url, host, path, text, lines, hashes, places).

    ``text`` is the result where the page has an article, else null; ``hashes`` and
    ``places`` are those of the lines outside articles, and ``lines`` their texts where
    differencing decides the page.
    """
    for batch in batches:
        rows = []
        for url, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            lines = lines_of(page or "")
            article = [t for t, p in lines if p == ARTICLE]
            rest = [(t, p) for t, p in lines if p != ARTICLE]
            hashes = np.array([xxhash.xxh64_intdigest(t) for t, _ in rest], "<u8").tobytes()
            places = np.array([p for _, p in rest], "u1").tobytes()
            rows.append((*place_of(url), " ".join(article) if article else None, None if article else [t for t, _ in rest], hashes, places))
        if rows:
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["key", "page_id", "url", "host", "path", "text", "lines", "hashes", "places"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the row's place in it, and the place of the first row of its run of pages alike."""
    part, at, last, start = TaskContext.get().partitionId(), 0, None, 0
    for batch in batches:
        n, runs = batch.num_rows, []
        for k, mine in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())):
            if mine != last:
                last, start = mine, at + k
            runs.append(start)
        columns = [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n)), pa.array(runs, pa.int64())]
        at += n
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "pos", "run"])


def _common(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the nearest pages unlike them, to the numbers of lines (outside articles) to delete."""
    for batch in batches:
        keys, out = [], []
        for k, r in enumerate(batch.to_pylist()):
            before = r["path_before"] if r["host_before"] == r["host"] else None
            after = r["path_after"] if r["host_after"] == r["host"] else None
            if before is None and after is None:
                continue
            near = r["hashes_before"]
            if before is None or (after is not None and _common(r["path"], after) > _common(r["path"], before)):
                near = r["hashes_after"]
            mine = np.frombuffer(r["hashes"], "<u8").tolist()
            places = np.frombuffer(r["places"], "u1")
            gone = [i for i in shared(mine, np.frombuffer(near, "<u8").tolist()) if places[i] == BODY]
            if gone:
                keys.append(k)
                out.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(out, pa.list_(pa.int32()))], ["key", "gone"])


def shared_lines(parsed: DataFrame) -> DataFrame:
    """(key, gone): for pages that share undecided lines with the page of the nearest URL, the numbers of these lines."""
    spark = parsed.sparkSession
    outline = parsed.select("key", "host", "path", "hashes", "places")
    ordered = outline.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    kind = f"key {KEY}, host string, path string, hashes binary, places binary, part int, pos long, run long"
    ordered = stored(spark, ordered.mapInArrow(_numbered, kind), "ordered")
    like = F.xxhash64("host", "hashes")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min_by(like, "pos").alias("first"), F.max_by(like, "pos").alias("last"), F.max("run").alias("run"))
    before, run, last, table = 0, 0, None, []
    for r in parts.orderBy("part").collect():  # a run may go on from the partition before
        first = run if r["first"] == last else before
        table.append((r["part"], before, first))
        run = before + r["run"] if r["run"] else first
        before, last = before + r["n"], r["last"]
    offsets = F.broadcast(spark.createDataFrame(table, "part int, before long, first long"))
    numbered = ordered.join(offsets, "part").select(
        (F.col("before") + F.col("pos")).alias("n"), F.when(F.col("run") == 0, F.col("first")).otherwise(F.col("before") + F.col("run")).alias("run"),
        "key", "host", "path", "hashes", "places",
    )
    # A copy of a page tells menus from content no better than the page itself, so a run's neighbours are those of its ends.
    runs = numbered.groupBy("run").agg(F.count("*").alias("size"))
    side = lambda name: numbered.select(F.col("n").alias(f"n_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in ("host", "path", "hashes")))
    ends = runs.select("run", (F.col("run") - 1).alias("n_before"), (F.col("run") + F.col("size")).alias("n_after"))
    ends = ends.join(side("before"), "n_before", "left").join(side("after"), "n_after", "left")
    return numbered.join(ends, "run").mapInArrow(_differences, f"key {KEY}, gone array<int>")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that differencing decides: what is left of their lines, of <main> if any is, else of the body."""
    for batch in batches:
        texts = []
        for lines, places, gone in zip(*(batch.column(k).to_pylist() for k in range(2, 5))):
            drop = set(gone or ())
            kept = [(t, p) for k, (t, p) in enumerate(zip(lines, places)) if p != GONE and k not in drop]
            best = max((p for _, p in kept), default=BODY)
            texts.append(" ".join(t for t, p in kept if p == best))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    row = F.col("row.page_id").cast("long").alias("page_id"), F.col("row.url").cast("string").alias("url"), F.col("row.html").alias("html")
    kind = f"key {KEY}, page_id long, url string, host string, path string, text string, lines array<string>, hashes binary, places binary"
    parsed = stored(spark, positioned(pages).select("key", *row).mapInArrow(_parsed, kind), "parsed")  # each page is parsed once
    sure = parsed.filter("text is not null").select("page_id", "url", "text")
    gone = stored(spark, shared_lines(parsed), "gone")
    open_pages = parsed.filter("text is null").join(gone, "key", "left").select("page_id", "url", "lines", "places", "gone")
    return sure.unionByName(open_pages.mapInArrow(_texts, "page_id long, url string, text string"))
