"""Main text of pages: nearest-URL page differencing, with markup as guard.

A page is cut into lines (its blocks). Each line is chrome by its markup (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments), or plain, or in the article (``article``, ``main`` or role=main). The pages of a
host are put in order of their URL path; each is paired with the neighbours before and after it that have other lines,
and lines of both are aligned by longest common subsequence. A line that the neighbour with the longer path prefix
shares is deleted, unless it is in the article: what markup names as the article is the text that is asked for, and
equal headings, quoted passages and copies in it are part of it. Chrome is never output, shared or not. The text is the
article's lines if the page has any, else the plain lines.

Only hashes of lines are put in order and aligned: pages of equal lines and path are one, ranges of (host, path) are
sorted, and the page before and after a range is carried over its border. Neighbouring pages of equal lines are one run,
which is aligned once and of which only the first page is held. Pages are parsed once, into a table that the numbers of
deleted lines are joined to.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.exprs import ascii_lower
from quillon.store import Stages

#: Deletions of up to so many pages (a few numbers each) are broadcast; more are joined by shuffle.
BROADCAST_PAGES = 100_000
#: Lines times lines that are aligned at once; longer pages are halved until they fit.
CELLS = 1 << 24
CHROME_LINE, PLAIN, ARTICLE, INSIDE = 0, 1, 2, 3

# fixed values: HTML elements by role
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
CELL_TAGS = {"td", "th"}
RAW = {"script", "style", "title", "textarea", "template", "iframe", "select"}
DROP = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# fixed values: words of class and id names that mark what is not main text
CHROME = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header"
    " masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted related replies respond share sharing"
    " sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
# fixed values: words that may stand beside them in a name
BESIDE = set(
    "area articles bar block bottom box button buttons container content form group icons inner item items left link links list main media outer page"
    " posts reader right row section site slot stories thread top unit user users wrap wrapper".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
COMMENTS = {"comment", "comments", "replies", "respond"}
# fixed values: words that mark chrome inside an article only together with page or site
HEADS = {"header", "masthead", "banner"}
# fixed values: elements that their names never make chrome inside an article
TEXT = set("h1 h2 h3 h4 h5 h6 p blockquote pre li dt dd td th figcaption caption b i em strong span".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)", re.S)


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _named(name: str) -> set[str]:
    """The words of a class or id, if it has one of ``CHROME`` and all others may stand beside it."""
    words = {w for w in re.split(r"[-_]+", name) if w and not w.isdigit()}
    return words if words & CHROME and words <= CHROME | BESIDE else set()


def _is_chrome(tag: str, raw: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is not main text, and whether it holds reader comments."""
    if tag in DROP or (tag == "header" and not in_article):
        return True, False
    if not raw.strip():
        return False, False
    a = _attributes(raw)
    words = set().union(*(_named(w) for w in f"{a.get('class', '')} {a.get('id', '')}".lower().split()))
    talk = bool(words & COMMENTS)
    if in_article:
        words = set() if tag in TEXT else words if words & {"page", "site"} else words - HEADS
    role = a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower())
    if tag in ("body", "html") or (tag in ("article", "main") and not talk):
        return bool(hidden), False
    return bool(words & CHROME or role in ROLES or hidden), talk and bool(words & CHROME)


def _events(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, tag, whether it closes, attributes) of each tag; the last has no tag. Content of ``RAW`` elements is left out."""
    at, end, low, text = 0, len(page), None, ""
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            break
        text += page[at : m.start()]
        at = m.end()
        tag, closing = (m[2] or "").lower(), bool(m[1])
        if not tag:
            continue
        if tag in RAW:
            if tag in BLOCK:
                yield text, tag, True, ""
                text = ""
            if not closing and not m[3].rstrip().endswith("/"):
                low = page.lower() if low is None else low
                if len(low) != len(page):  # a letter whose lower case is longer
                    close = re.compile(rf"</{tag}", re.I).search(page, at)
                    at = end if close is None else close.start()
                else:
                    found = low.find(f"</{tag}", at)
                    at = end if found < 0 else found
            continue
        yield text, tag, closing, m[3] or ""
        text = ""
    yield text + page[at:], "", False, ""


def _extents(events: list[tuple[str, str, bool, str]]) -> dict[int, tuple[int, bool]]:
    """Of each element, by its first event: the event that ends it, and whether that is its own end tag or a sibling."""
    out: dict[int, tuple[int, bool]] = {}
    opened: list[tuple[str, int]] = []
    of: dict[str, int] = {}  # how many of a tag are open

    def close(depth: int, n: int, own: bool) -> None:
        while len(opened) > depth:
            tag, first = opened.pop()
            of[tag] -= 1
            out[first] = n, own and len(opened) == depth

    for n, (_, tag, closing, _) in enumerate(events):
        if not tag or tag in VOID or tag in RAW:
            continue
        if closing:
            if of.get(tag):
                close(max(k for k, x in enumerate(opened) if x[0] == tag), n, True)
            continue
        if tag in BLOCK or tag in CELL_TAGS:  # a paragraph ends before a block, an item before the next
            last = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] in BLOCK or opened[k][0] in CELL_TAGS), None)
            if last is not None and (opened[last][0] == "p" or opened[last][0] == tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close(last, n, True)
        opened.append((tag, n))
        of[tag] = of.get(tag, 0) + 1
    close(0, len(events), False)
    return out


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The lines of a page and the kind of each.

    An element that is chrome is left at its own end, whatever it holds; one that has no end tag of its own is left where
    an article begins in it or an element around it ends. If a page has an article only inside of chrome (an element
    that another's end tag seems to close), that one counts.
    """
    lines: list[str] = []
    kinds: list[int] = []
    now: list[str] = []  # text of the open line, and of chrome inside of it
    aside: list[str] = []
    chrome: list[tuple[int, bool, bool]] = []  # end, own end, comments
    article: list[int] = []  # ends of open article and main elements

    def flush() -> None:
        for part, kind in ((now, ARTICLE if article else PLAIN), (aside, INSIDE if article and not any(c[2] for c in chrome) else CHROME_LINE)):
            s = " ".join(entities.unescape("".join(part)).split()) if part else ""
            part.clear()
            if s:
                lines.append(s)
                kinds.append(kind)

    events = list(_events(page))
    extents = _extents(events)
    for n, (text, tag, closing, raw) in enumerate(events):
        if text:
            (aside if chrome else now).append(text)
        if tag in BLOCK or not tag:
            flush()
        elif tag in CELL_TAGS or tag == "br":
            (aside if chrome else now).append(" ")
        while chrome and chrome[-1][0] <= n:
            chrome.pop()
        while article and article[-1] <= n:
            article.pop()
        if closing or not tag or n not in extents:
            continue
        end, own = extents[n]
        drop, talk = _is_chrome(tag, raw, bool(article))
        if drop:
            chrome.append((min(end, chrome[-1][0]) if chrome else end, own, talk))
        elif tag in ("article", "main") or ("role" in raw and tag in BLOCK and _attributes(raw).get("role") == "main"):
            if tag in ("article", "main") and not any(c[1] or c[2] for c in chrome):
                chrome.clear()
            article.append(end)
    if ARTICLE in kinds:
        return lines, [CHROME_LINE if k == INSIDE else k for k in kinds]
    return lines, [ARTICLE if k == INSIDE else k for k in kinds]


def main_lines(lines: list[str], kinds: list[int], deleted: set[int] | frozenset[int] = frozenset()) -> list[str]:
    """The article's lines, or the plain ones of a page without any, less the deleted ones."""
    kind = ARTICLE if ARTICLE in kinds else PLAIN
    return [x for i, x in enumerate(lines) if kinds[i] == kind and i not in deleted]


def _row(a: list, b: list) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` and each prefix of ``b`` (bit-parallel)."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    raised = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)] == 0
    return np.r_[0, np.cumsum(raised)]


def _aligned(a: list, b: list, out: list[tuple[int, int]], i0: int, j0: int) -> None:
    """Adds pairs of places of a longest common subsequence, in memory that is linear in the lines."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.append((i0 + head, j0 + head))
        head += 1
    a, b, i0, j0 = a[head:], b[head:], i0 + head, j0 + head
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out.append((i0, j0 + b.index(a[0])))
        return
    if len(a) * len(b) > CELLS:
        mid = len(a) // 2
        total = _row(a[:mid], b) + _row(a[mid:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(total))
        _aligned(a[:mid], b[:cut], out, i0, j0)
        _aligned(a[mid:], b[cut:], out, i0 + mid, j0 + cut)
        return
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j = len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            j -= 1


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of both."""
    in_a, in_b = set(a), set(b)
    own = [i for i, x in enumerate(a) if x in in_b]  # other lines are in no common subsequence
    out: list[tuple[int, int]] = []
    _aligned([a[i] for i in own], [x for x in b if x in in_a], out, 0, 0)
    return {own[i] for i, _ in out}


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def deleted_lines(path: str, kinds: list[int], near: list[tuple[str, set[int]]]) -> list[int]:
    """Numbers of the lines to delete; ``near`` has path and shared lines of the page before and of that after, as far as there are any."""
    if not near:
        return []
    best = near[int(len(near) == 2 and _common(path, near[1][0]) > _common(path, near[0][0]))]
    return sorted(i for i in best[1] if kinds[i] != ARTICLE)


def _differences(rows: Iterator[tuple], name: str) -> Iterator[tuple]:
    """Rows (part, host, path, d1, d2, hashes, kinds, visitor) in order -> what is known of them.

    (run, host, path, d1, d2, None, ...) for each page, and (run, None, None, None, None, kinds, path before, lines shared
    with it, path after, lines shared with it) for each run of pages of equal lines. Three pages are held at most.
    """
    before: tuple | None = None  # the page before the run, which has other lines
    head: tuple | None = None  # the first page of the run
    last = ""  # path of its last page
    run = 0

    def close(after: tuple | None) -> tuple:
        near = [x if x is not None and x[1] == head[1] else None for x in (before, after)]
        return (f"{name}-{run}", None, None, None, None, head[6], *(v for x in near for v in ((x[2], sorted(shared_lines(head[5], x[5]))) if x else (None, None))))

    for row in rows:
        if head is None or row[1] != head[1] or row[3:5] != head[3:5]:
            if head is not None:
                yield close(row)
                before, run = (*head[:2], last, *head[3:]), run + 1
            head = row
        last = row[2]
        if not row[7]:
            yield (f"{name}-{run}", *row[1:5], None, None, None, None, None)
    if head is not None:
        yield close(None)


def _borders(spans: list[tuple]) -> list[tuple]:
    """(part, page that goes before or after it) for parts given in order as their outermost pages.

    A span is (part, first pages, last pages): of each end the next page of other lines and the outermost page.
    """
    out = []
    for turn in (spans, spans[::-1]):
        carried: list[tuple] = []  # up to two pages of other lines, the nearest last
        for part, first, last in turn:
            out += [(part, page) for page in carried]
            for page in last if turn is spans else first:
                carried = [*[x for x in carried if x[2:] != page[2:] and x[0] == page[0]], page][-2:]
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars, n_shared) per row of ``pages``; n_shared counts deleted lines.

    A null or empty page has an empty text. Null or malformed URLs share the host '' and the path '', and are ordered
    by their lines. Pages of equal lines are never differenced with each other, so that repeated rows and copies keep
    their text and get the same one; of neighbours with equally long path prefixes the page before counts. Very long
    pages are parsed whole and aligned in memory that is linear in their lines. Null ids are kept. Other columns are
    not read, so their names may clash with ours. An empty table gives no rows.
    """
    spark = pages.sparkSession
    stages = Stages(spark, "pages")
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    whole = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    key = ["host", "path", "d1", "d2"]  # also the order
    parsed = stages.keep(whole.mapInArrow(_parse, PARSED), "parsed")
    each = parsed.select(*key, "hashes", "kinds").dropDuplicates(key)
    each = stages.keep(each.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "lines")
    # the outermost pages of each part (keys only: four a part)
    page = F.struct(*key)
    ends = each.groupBy("part").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    other = each.join(ends, "part").groupBy("part", "first", "last").agg(
        F.min(F.when((F.col("d1") != F.col("first.d1")) | (F.col("d2") != F.col("first.d2")), page)).alias("second"),
        F.max(F.when((F.col("d1") != F.col("last.d1")) | (F.col("d2") != F.col("last.d2")), page)).alias("late"),
    )
    spans = [
        (r["part"], [tuple(x) for x in (r["second"], r["first"]) if x], [tuple(x) for x in (r["late"], r["last"]) if x])
        for r in other.orderBy("part").collect()
    ]
    borders = [(part, *p) for part, p in _borders(spans)]
    visitors = spark.createDataFrame(borders, "to int, host string, path string, d1 long, d2 long").distinct()  # four a part at most
    carried = each.join(F.broadcast(visitors), key).select(F.col("to").alias("part"), *key, "hashes", "kinds", F.lit(True).alias("visitor"))
    flow = each.select("part", *key, "hashes", "kinds", F.lit(False).alias("visitor")).unionByName(carried)
    flow = flow.repartition("part").sortWithinPartitions("part", *key)
    runs = stages.keep(flow.mapInArrow(_align, RUNS), "runs")
    shared = runs.where("kinds is not null and (size(with_before) > 0 or size(with_after) > 0)").drop(*key)
    met = runs.where("kinds is null").select("run", *key).join(shared, "run")
    gone = stages.keep(met.select(*key, "kinds", "before", "with_before", "after", "with_after").mapInArrow(_choose, GONE), "gone")
    if gone.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES:
        gone = F.broadcast(gone)
    found = parsed.drop("hashes", "kinds").join(gone, key, "left")
    left = F.filter("lines", lambda x, i: F.col("deleted").isNull() | ~F.array_contains("deleted", F.get("at", i)))
    text = F.array_join(left, "\n\n")
    out = found.select("page_id", "url", text.alias("text"), F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_shared"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")


PARSED = "page_id long, url string, host string, path string, d1 long, d2 long, hashes array<long>, kinds array<tinyint>, lines array<string>, at array<int>"
RUNS = (
    "run string, host string, path string, d1 long, d2 long, kinds array<tinyint>, before string, with_before array<int>, after string, with_after array<int>"
)
GONE = "host string, path string, d1 long, d2 long, deleted array<int>"
_TYPES = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<tinyint>": pa.list_(pa.int8()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(_rows(batches), 500):
        out = []
        for page_id, url, host, path, page in chunk:
            lines, kinds = lines_of(page or "")
            at = [i for i, k in enumerate(kinds) if k == (ARTICLE if ARTICLE in kinds else PLAIN)]
            out.append((page_id, url, host, path, *_digest(lines, kinds), [_hash(x) for x in lines], kinds, [lines[i] for i in at], at))
        yield _batch(out, PARSED)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    parts = itertools.groupby(_rows(batches), key=lambda row: row[0])
    for chunk in _chunks((x for part, rows in parts for x in _differences(rows, f"{task}-{part}")), 1000):
        yield _batch(chunk, RUNS)


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in _chunks(_rows(batches), 1000):
        out = []
        for host, path, d1, d2, kinds, before, with_before, after, with_after in chunk:
            near = [(p, set(shared or ())) for p, shared in ((before, with_before), (after, with_after)) if p is not None]
            out.append((host, path, d1, d2, deleted_lines(path, kinds, near)))
        yield _batch([x for x in out if x[4]], GONE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _chunks(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while chunk := list(itertools.islice(rows, size)):
        yield chunk


def _hash(line: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(line.encode("utf-8", "surrogatepass")), "big", signed=True)


def _digest(lines: list[str], kinds: list[int]) -> tuple[int, int]:
    """Two hashes that name the lines of a page and their kinds."""
    whole = "\n".join(f"{k}{x}" for x, k in zip(lines, kinds, strict=True)).encode("utf-8", "surrogatepass")
    raw = xxhash.xxh3_128_digest(whole)
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)
