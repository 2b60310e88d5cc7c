"""Main text by nearest-URL page differencing.

Pages are sorted by host and URL path; each is paired with the neighbour of its host whose path
has the longer prefix in common with its own. The pair's text lines are aligned by a longest
common subsequence, and shared lines are deleted: menus, notices and footers repeat from page to
page. Two facts that markup states override the alignment: lines within an article or main
element stay even where the neighbour is a copy of the page, and then nothing outside it does;
lines in elements that name themselves as page furniture (nav, footer, class "ad", ...) go even
where no neighbour has them.

Sorting cuts the key space at a bounded, hash-chosen sample of keys, so that one host may spread
over many tasks. The first and last pages of each range are copied into the ranges around it (past
empty ones), so that every page sees its true neighbours and the text does not depend on the cuts.

Defined cases: null or empty html gives an empty text; null URLs form a host of their own;
repeated rows pair with each other; an empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?([a-zA-Z][\w:-]*)")
#: Elements whose content is no markup, or none to be read.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style textarea title noscript template iframe xmp".split()}
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACES = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(["article", "main"])
FURNITURE = frozenset("nav header footer aside form script style head button select option menu dialog svg math canvas object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _kind(name: str, attributes: str) -> int:
    """1: main content, 2: page furniture, 0: neither."""
    kind = 2 if name in FURNITURE else 1 if name in MAIN else 0
    if attributes.strip(" /"):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return 2
            if key == "role":
                kind = 2 if value in ROLES else 1 if value in MAIN else kind
            elif key in ("class", "id") and name not in ("html", "body") and name not in MAIN and NAMES.intersection(re.split(r"[\s_-]+", value)):
                return 2
    return kind


def tags(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(begin, end, closing, name, attributes) of each tag in order; no name: what is left out, such as
    a comment or a script. One pass: a search that finds no end is not made a second time."""
    at, n, quoted = 0, len(html), True
    while (lo := html.find("<", at)) >= 0:
        if html.startswith("<!--", lo):
            end = html.find("-->", lo + 4)
            at = n if end < 0 else end + 3
            yield lo, at, False, None, ""
            continue
        m = NAME.match(html, lo + 1)
        if not m:
            if html[lo + 1 : lo + 2] not in ("!", "?", "/"):
                at = lo + 1
                continue
            end = html.find(">", lo)
        else:
            end = m.end()
            while quoted:  # the first > outside quotes
                stop = STOP.search(html, end)
                if stop and stop[0] != ">":
                    end = html.find(stop[0], stop.end()) + 1
                    if end:
                        continue
                    stop = None
                if stop:
                    end = stop.start()
                else:
                    quoted = False  # an open quote, or no > at all: from here on quotes mean nothing
                break
            if not quoted:
                end = html.find(">", m.end())
        if end < 0:
            return
        at = end + 1
        if not m:
            yield lo, at, False, None, ""
            continue
        name, closing = m[1].lower(), html[lo + 1] == "/"
        if name in RAW and not closing:
            over = RAW[name].search(html, at)
            at = over.end() if over else n
            yield lo, at, False, None, ""
        else:
            yield lo, at, closing, name, html[m.end() : end]


def lines(html: str) -> list[tuple[str, bool, bool]]:
    """(text, within main content, within furniture) of each block with text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, int]] = []
    main = junk = 0
    text: list[str] = []

    def flush() -> None:
        if text:
            line = SPACES.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                out.append((line, main > 0, junk > 0))
            text.clear()

    def pop(to: int) -> None:
        nonlocal main, junk
        for _, kind in stack[to:]:
            main -= kind == 1
            junk -= kind == 2
        del stack[to:]

    at = 0
    for begin, end, closing, name, attributes in tags(html):
        if begin > at:
            text.append(html[at:begin])
        at = end
        if name is None:
            continue
        if name == "br":  # white space within its block
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(kind == 2 for _, kind in stack[i:]) or any(kind == 1 for _, kind in stack[i:]):
                        flush()
                    pop(i)
                    break
            continue
        if name in VOID or attributes.endswith("/") and name not in MAIN | FURNITURE | {"div", "p"}:
            continue
        if name not in INLINE:
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends where a block begins
                if stack[i][0] == "p" or stack[i][0] in CLOSES.get(name, ()):
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        kind = _kind(name, attributes)
        if kind:
            flush()
        stack.append((name, kind))
        main += kind == 1
        junk += kind == 2
    text.append(html[at:])
    flush()
    return out


def shared(a: list[str], b: list[str]) -> set[int]:
    """Indexes of ``a`` in a longest common subsequence of the two, by bit-parallel rows."""
    common = set(a).intersection(b)
    ia = [i for i, x in enumerate(a) if x in common]
    xs, ys = [a[i] for i in ia], [y for y in b if y in common]
    lo, hi = 0, min(len(xs), len(ys))
    while lo < hi and xs[lo] == ys[lo]:
        lo += 1
    tail = 0
    while tail < hi - lo and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    out = {*ia[:lo], *ia[len(ia) - tail :]}
    xs, ys, ia = xs[lo : len(xs) - tail], ys[lo : len(ys) - tail], ia[lo : len(ia) - tail]
    where: dict[str, int] = {}
    for i, x in enumerate(xs):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(xs)) - 1
    v, rows = full, []
    for y in ys:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(xs), len(ys)
    while i and j:  # a zero bit: the subsequence grows at this line
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(ia[i])
    return out


def keep(page: list[tuple[str, bool, bool]], other: list[tuple[str, bool, bool]] | None) -> list[str]:
    """The lines of ``page`` that are its main text, given its pair."""
    gone = shared([x for x, _, _ in page], [x for x, _, _ in other]) if other else set()
    marked = any(m and not j for _, m, j in page)
    return [x for i, (x, m, j) in enumerate(page) if not j and (m if marked else i not in gone)]


URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)"
ROWS = "page_id long, url string, text string, n_chars long"


def _with_edges(p: DataFrame) -> DataFrame:
    """The ranged pages, and as copies the last page before each range and the first after it."""
    p = p.withColumn("tie", F.xxhash64("url", "html"))
    page = F.struct("key", "tie", "page_id", "url", "host", "path")
    ends = p.groupBy("range").agg(F.min(page).alias("first"), F.max(page).alias("last")).collect()
    ends.sort(key=lambda r: r["range"])
    copies = [(*before["last"], after["range"]) for before, after in zip(ends, ends[1:], strict=False)]
    copies += [(*after["first"], before["range"]) for before, after in zip(ends, ends[1:], strict=False)]
    at = p.sparkSession.createDataFrame(copies, "key string, tie long, page_id long, url string, host string, path string, to int").select("key", "tie", "to")
    found = p.join(F.broadcast(at), ["key", "tie"]).groupBy("key", "tie", "to").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "html", "host", "path")])
    copied = found.withColumnRenamed("to", "range").withColumn("copy", F.lit(True))
    return p.withColumn("copy", F.lit(False)).unionByName(copied)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_range: int = 2_000) -> DataFrame:
    """page_id, url, text, n_chars of every page: one shuffle, a sorted stream in each task."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), F.lower(F.regexp_extract(url, URL, 1)).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))
    key = F.concat_ws("\0", "host", "path", F.format_string("%020d", F.coalesce("page_id", F.lit(-1))))
    p = p.withColumn("key", key)
    n = pages.count()
    ranges = max(1, n // per_range)
    # at most about 64 sampled keys for each of at most 4,096 cuts reach the driver
    every = max(1, n // min(64 * ranges, 1 << 18))
    sample = sorted(r[0] for r in p.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect()) if ranges > 1 else []
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("range", pa.array([bisect.bisect_right(cuts, k) for k in b.column("key").to_pylist()], pa.int32()))

    if cuts:
        p = p.mapInArrow(ranged, "page_id long, url string, html string, host string, path string, key string, range int")
        p = _with_edges(p).repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "key", "tie")
    else:
        p = p.withColumns({"range": F.lit(0), "copy": F.lit(False), "tie": F.xxhash64("url", "html")}).repartition(1).sortWithinPartitions("key", "tie")

    def near(x: tuple, y: tuple | None) -> int:
        return -1 if y is None or y[2:4] != x[2:4] else len(commonprefix([x[4], y[4]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None
        out: list[tuple] = []

        def done(x: tuple, prev: tuple | None, after: tuple | None) -> None:
            a, b = near(x, prev), near(x, after)
            other = prev if a >= b else after
            text = "\n".join(keep(x[5], other[5] if max(a, b) >= 0 else None))
            out.append((x[0], x[1], text, len(text)))

        def table() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], ["page_id", "url", "text", "n_chars"])

        for b in batches:
            for r in range(0, b.num_rows, 256):
                for row in zip(*(b.column(c).slice(r, 256).to_pylist() for c in ("page_id", "url", "range", "host", "path", "html", "copy")), strict=True):
                    new = (*row[:5], lines(row[5]), row[6])
                    if now is not None and not now[6]:
                        done(now, before, new)
                    before, now = now, new
                if out:
                    yield table()
        if now is not None and not now[6]:
            done(now, before, None)
            yield table()

    return p.select("page_id", "url", "range", "host", "path", "html", "copy").mapInArrow(run, ROWS)
