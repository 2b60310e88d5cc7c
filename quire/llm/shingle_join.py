"""Jaccard metric-space join of documents on word shingles, exact, with recursive pivot regions.

Documents are sets of five-word shingles; one minus their Jaccard similarity is a metric, and two
documents link at a distance of at most ``radius`` = 1 - similarity. Equal sets collapse into one
object before anything else, however many copies they come from.

Unrelated texts are all at distance one from each other and from any pivot, so pivots alone cannot
part them. A first cut therefore takes as regions the shingles in each object's prefix: in one
global order, linked objects share a shingle among their first n - ceil(s n) + 1. Then:

* the least object of each region is its pivot, and all others are measured against it: an object
  within the radius is linked to it. Each object meets the pivot that it shares most regions with
  first, and its other pivots only if no chain of links has joined it to them by then; those that a
  chain has joined need no distance, since whatever is linked to the pivot is on the same chain;
* by the triangle inequality such an object can only link to objects within twice the radius. Those in
  that window are the boundary: they are replicated, that is, they are held to meet the pivot's
  inner objects and also stay in the region; inner objects and the pivot leave it;
* regions whose objects are all joined by chains of links by then are done; those of the others that
  share chains are a cell. A cell of at most ``room`` shingles is joined exactly in one task: pivots far apart
  are drawn in it, and two objects are compared only if their distances to every pivot allow it by
  the triangle inequality, if their sizes do, and if no chain has joined them;
* regions of larger cells recur with more pivots each, until none is left.

Held meetings come last, and only between objects that no chain of links has joined by then: those of
one pivot are a cell too, and only where that is too large do pairs move.
A group of near copies so costs one distance a member and not all pairs; pairs are never rows
within a cell, and nothing is capped.

The global order puts frequent shingles last: those that a hash sample of documents shows most
often, at most ``hot`` of them. Any order gives the same links.

Defined cases: a text without words has no shingles, links with nothing and is its own component;
with fewer than five words its whole word sequence is the one shingle; equal texts are one class;
a null id takes the smallest id of its class, or null if it has none; an empty table returns no
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Words, bucketed, chain, chunks, discard, drop_bucketed, mix, stored, text_of
from .graph import components

WIDTH, PERCENT, ROOM = 5, 80, 1 << 21
BASE = "doc_id long, n long, s1 long, s2 long, prefix array<long>"
SETS = "id long, items binary, marks binary, rest long"
#: Bytes by which a shingle is named in a set that is compared, and in its marks.
ITEM, MARK = 5, 2


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of each distinct shingle, by text, and the number of each text."""
    w = Words(texts, lower=True)
    at, h = w.windows(width)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        first = np.searchsorted(w.doc, short)
        more = np.array([chain([w.hash[f + i : f + i + 1] for i in range(w.counts[d])])[0] for f, d in zip(first.tolist(), short.tolist(), strict=True)], U64)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, more])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=len(texts))


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _packed(values: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    """The low ``width`` bytes of each value, as one binary value for each count."""
    data = np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :])
    ends = (np.concatenate([[0], np.cumsum(counts)]) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _sums(h: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h + U64(salt)), out=sums[1:])
    ends = np.cumsum(n)
    return (sums[ends] - sums[ends - n]).view(np.int64)


def signatures(docs: DataFrame, hot: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """BASE of each document: size of its set, two sums that name the set, and its
    prefix. A task gives the prefix of equal sets only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, texts in chunks(batches):
            doc, h, n = shingles(texts)
            s1, s2 = _sums(h, n, 1), _sums(h, n, 2)
            new = np.zeros(len(texts), bool)
            for i, s in enumerate(s1.tolist()):
                if s not in seen:
                    new[i] = True
                    seen.add(s)
            if len(seen) > 1 << 20:
                seen.clear()
            late = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
            order = np.lexsort((h, late, doc))
            need = np.where(new, n + (percent * n) // -100 + (n > 0), 0)  # n - ceil(s n) + 1
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            kept = order[place < np.repeat(need, n)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), _lists(h[kept].view(np.int64), need, pa.int64())], ["doc_id", "n", "s1", "s2", "prefix"])

    return text_of(docs).mapInArrow(run, BASE)


def frequent(docs: DataFrame, hot: int, every: int) -> np.ndarray:
    """At most ``hot`` shingles that come three times or more in one of ``every`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(texts)[1].view(np.int64))], ["h"])

    some = text_of(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(run, "h long")
    top = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(hot)
    return np.sort(np.array([r[0] for r in top.select("h").collect()], np.int64).view(U64))


def sets(docs: DataFrame, by_doc: bool = False) -> DataFrame:
    """SETS of documents: the sorted shingles, 40 bits of each, by the set's first sum or by the
    document's id, and a sixth of these bytes to bound what two sets share: 16 bits of two shingles in five, and the number of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            doc, h, n = shingles(texts)
            name = mix(h + U64(3))
            in_part = (name >> U64(32)) % U64(5) < 2
            some = np.bincount(doc[in_part], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id") if by_doc else pa.array(_sums(h, n, 1)), _packed(h >> U64(64 - 8 * ITEM), n, ITEM), _packed(name[in_part], some, MARK), pa.array(n - some, pa.int64())], ["id", "items", "marks", "rest"])

    return text_of(docs).mapInArrow(run, SETS)


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a batch's column ``items``, ``width`` bytes a value: their bounds and all values."""
    col = batch.column("items")
    _, ends, data = col.buffers()
    at = np.frombuffer(ends, np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.zeros(((at[-1] - at[0]) // width, 8), np.uint8)
    if len(raw):
        raw[:, 8 - width :] = np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, width)
    return (at - at[0]).astype(np.int64) // width, raw.view(">u8").ravel().astype(U64)


def against_pivots(pairs: DataFrame, items: DataFrame, percent: int, far: int) -> DataFrame:
    """(a, pivot, m) -> a, b (the pivot), zone: 0 linked (similarity at least ``percent``), 1 similarity
    at least ``far``; others give no row. Most pairs meet by chance and are settled by the marks, so that
    whole sets move only for those whose bound is at least ``far``."""
    marked = _measured(pairs, items.select("id", F.col("marks").alias("items"), "rest"), percent, far, MARK)
    left = pairs.join(marked.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.col("a") == F.col("x")) & (F.col("pivot") == F.col("y"))).select("a", "pivot", "m")
    return _measured(stored(left, "pairs-left"), items.select("id", "items", F.lit(0).cast("long").alias("rest")), percent, far, ITEM)


def _measured(pairs: DataFrame, items: DataFrame, percent: int, far: int, width: int) -> DataFrame:
    """The zones of pairs by what they share at most: shared items, and all of the smaller rest. A task holds one pivot's set and streams those it meets; where
    ``m``, the size of the group, is large, the pivot's objects are salted over many tasks."""
    met = pairs.select("pivot", F.when(F.col("m") > 4096, F.pmod(F.xxhash64("a"), F.lit(64))).otherwise(0).alias("salt"), "a")
    met = met.withColumn("own", F.lit(1)).union(met.select("pivot", "salt", F.col("pivot"), F.lit(0)).distinct())
    rows = met.hint("merge").join(items, F.col("a") == F.col("id")).select("pivot", "salt", "own", "a", "items", "rest").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_rest = np.zeros(0, U64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            at, values = _rows(batch, width)
            own, ids, pivot, rest = (batch.column(c).to_numpy() for c in ("own", "a", "pivot", "rest"))
            out = []
            first = np.flatnonzero(own == 0)
            for lo, hi in zip(np.concatenate([[0], first]).tolist(), np.concatenate([first, [len(own)]]).tolist(), strict=True):
                if lo < hi and own[lo] == 0:
                    held, held_rest, lo = np.sort(values[at[lo] : at[lo + 1]]), rest[lo], lo + 1
                if lo >= hi:
                    continue
                some = values[at[lo] : at[hi]]
                hit = held[np.minimum(np.searchsorted(held, some), len(held) - 1)] == some if len(held) else np.zeros(len(some), bool)
                sums = np.concatenate([[0], np.cumsum(hit)])
                sizes = np.diff(at[lo : hi + 1]) + rest[lo:hi]
                inter = sums[at[lo + 1 : hi + 1] - at[lo]] - sums[at[lo:hi] - at[lo]] + np.minimum(rest[lo:hi], held_rest)
                total = sizes + len(held) + held_rest
                zone = np.where((100 + percent) * inter >= percent * total, 0, np.where((100 + far) * inter >= far * total, 1, 2))
                out.append((ids[lo:hi][zone < 2], pivot[lo:hi][zone < 2], zone[zone < 2]))
            if out:
                a, b, z = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(z, pa.int32())], ["a", "b", "zone"])

    return rows.mapInArrow(run, "a long, b long, zone int")


def join_cell(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, values: np.ndarray, percent: int, pivots: int = 6) -> list[tuple[int, int]]:
    """Links that, with the chains that the labels stand for, connect all linked objects of a cell.
    sizes: of each object's set; values: the sets one after the other."""
    order = np.argsort(sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    place = np.repeat(starts[order], sizes[order]) + np.arange(len(values)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
    names, word = np.unique(values[place], return_inverse=True)
    ids, labels, sizes = ids[order], labels[order].copy(), sizes[order]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    flag, found = np.zeros(len(names), np.int8), []

    def shared(i: int, lo: int, hi: int) -> np.ndarray:
        mine = word[ends[i] : ends[i + 1]]
        flag[mine] = 1
        sums = np.concatenate([[0], np.cumsum(flag[word[ends[lo] : ends[hi]]], dtype=np.int64)])
        flag[mine] = 0
        return sums[ends[lo + 1 : hi + 1] - ends[lo]] - sums[ends[lo:hi] - ends[lo]]

    radius, far, near = 1 - percent / 100 + 1e-9, [], np.full(len(ids), 2.0)
    while len(ids) > 32 and len(far) < pivots:
        i = int(near.argmax())  # far from all pivots so far
        inter = shared(i, 0, len(ids))
        far.append(1 - inter / (sizes + sizes[i] - inter))
        near = np.minimum(near, far[-1])
    top = np.searchsorted(sizes * percent, sizes * 100, "right")
    for i in range(len(ids)):
        lo, hi = i + 1, int(top[i])
        may = labels[lo:hi] != labels[i]
        for d in far:
            may &= np.abs(d[lo:hi] - d[i]) <= radius
        at = np.flatnonzero(may) + lo
        if not len(at):
            continue
        lo, hi = int(at[0]), int(at[-1]) + 1
        inter = shared(i, lo, hi)[at - lo]
        for j in at[(100 + percent) * inter >= percent * (sizes[at] + sizes[i])].tolist():
            if labels[j] != labels[i]:
                found.append((int(ids[i]), int(ids[j])))
                labels[labels == labels[j]] = labels[i]
    return found


def within_cells(members: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(cell, id, c) -> a, b: the links of each cell, a cell in one task."""
    rows = members.hint("merge").join(items.select(F.col("id").alias("i"), "items"), F.col("id") == F.col("i")).select("cell", "id", "c", "items").repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def close() -> list[tuple[int, int]]:
            ids, labels, sizes, values = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return join_cell(ids, labels, sizes, values, percent) if len(ids) > 1 else []

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at, values = _rows(batch, ITEM)
            cell, ids, labels = (batch.column(c).to_numpy() for c in ("cell", "id", "c"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]]).tolist()
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and now != cell[lo]:
                    out += close()
                now = cell[lo]
                held.append((ids[lo:hi].copy(), labels[lo:hi].copy(), np.diff(at[lo : hi + 1]).astype(np.int64), values[at[lo] : at[hi]].copy()))
            yield batch_of(out)
        if held:
            yield batch_of(close())

    return rows.mapInArrow(run, "a long, b long")


def _can(percent: int, at: str, n: str, atp: str, np_: str) -> Column:
    """Whether two objects that share a shingle may be as similar: before it in the global order
    they share at most the smaller number, and after it too."""
    room = F.least(at, atp) + 1 + F.least(F.col(n) - F.col(at) - 1, F.col(np_) - F.col(atp) - 1)
    return (100 + percent) * room >= percent * (F.col(n) + F.col(np_))


def _open_rows(rows: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """The rows of regions that chains have not joined as a whole, with the label ``c`` of each object,
    the region's least object ``lo``, least label ``cl`` and size ``m``."""
    if edges:
        label = components(reduce(DataFrame.union, edges)).select(F.col("node").alias("v"), "component")
        rows = rows.join(label, F.col("id") == F.col("v"), "left").withColumn("c", F.coalesce("component", "id")).drop("v", "component")
    else:
        rows = rows.withColumn("c", F.col("id"))
    sized = rows.groupBy(F.col("region").alias("r")).agg(F.min("id").alias("lo"), F.min("c").alias("cl"), F.max("c").alias("ch"), F.count("*").alias("m")).where("cl < ch")
    return stored(rows.join(sized, F.col("region") == F.col("r")).select("region", "id", "n", "at", "c", "lo", "cl", "m"), "regions")


def _apart(pairs: DataFrame, done: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """The pairs (a, pivot, m) not in ``done`` that no chain of edges joins."""
    label = components(reduce(DataFrame.union, edges))
    out = pairs.join(done.select("a", "pivot"), ["a", "pivot"], "left_anti")
    for end, name in (("a", "ca"), ("pivot", "cp")):
        out = out.join(label.select(F.col("node").alias("v"), F.col("component").alias(name)), F.col(end) == F.col("v"), "left").drop("v")
    return stored(out.where(F.coalesce("ca", "a") != F.coalesce("cp", "pivot")).select("a", "pivot", "m"), "pairs-apart")


def _fitting(members: DataFrame, room: int) -> DataFrame:
    """The members (cell, id, n, c) of cells that one task can join."""
    fits = members.groupBy(F.col("cell").alias("f")).agg(F.sum("n").alias("s"), F.count("*").alias("o")).where((F.col("s") <= room) & (F.col("s") * F.col("o") <= room << 12)).select("f")
    return members.join(fits, F.col("cell") == F.col("f"), "left_semi")


def links(live: DataFrame, items: DataFrame, percent: int = PERCENT, room: int = ROOM, growth: int = 16) -> DataFrame:
    """Edges that connect all linked objects: (region, id, n, at) -> a, b."""
    far = max(0, 2 * percent - 100)  # twice the radius
    edges, windows, k = [], [], 1
    rows = _open_rows(live, edges)
    while not rows.isEmpty():
        pivots = rows.where((F.col("id") == F.col("lo")) | (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) * F.col("m") < (k - 1) * (1 << 20)))
        y = pivots.select(F.col("region").alias("r"), F.col("id").alias("p"), F.col("n").alias("np"), F.col("at").alias("ap"), F.col("c").alias("cp"))
        meet = rows.join(y, F.col("region") == F.col("r")).where((F.col("id") != F.col("p")) & (F.col("c") != F.col("cp")) & _can(far, "at", "n", "ap", "np"))
        pairs = stored(meet.groupBy(F.col("id").alias("a"), F.col("p").alias("pivot")).agg(F.max("m").alias("m"), F.count("*").alias("shared")), "pairs")
        best = pairs.groupBy("a").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("pivot"), F.max("m").alias("m"))
        zones = stored(against_pivots(best, items, percent, far), "zones")
        edges.append(zones.where("zone = 0").select("a", "b"))
        more = stored(against_pivots(_apart(pairs, best, edges), items, percent, far), "zones")
        edges.append(more.where("zone = 0").select("a", "b"))
        zones = zones.union(more)
        windows.append(zones.select(F.col("b").alias("p"), F.col("a").alias("id"), "zone"))
        inner = zones.where("zone = 0").select(F.col("a").alias("x"), F.col("b").alias("y"))
        last, gone = rows, meet.join(inner, (F.col("id") == F.col("x")) & (F.col("p") == F.col("y"))).select("region", "id").union(pivots.select("region", "id")).distinct()
        rows = _open_rows(rows.join(gone, ["region", "id"], "left_anti").select("region", "id", "n", "at"), edges)
        for done in (pairs, last):
            discard(done)
        cells = components(rows.select(F.col("c").alias("a"), F.col("cl").alias("b"))).select(F.col("node").alias("v"), F.col("component").alias("cell"))
        members = stored(rows.select("id", "n", "c").distinct().join(cells, F.col("c") == F.col("v")).select("cell", "id", "n", "c"), "cells", small=True)
        fits = _fitting(members, room)
        edges.append(stored(within_cells(fits, items, percent), "cell-links"))
        last, rows = rows, stored(rows.join(fits.select(F.col("id").alias("i")), F.col("id") == F.col("i"), "left_anti"), "large-cells", small=True)
        discard(last)
        k *= growth
    if not edges:
        return live.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    edges = reduce(DataFrame.union, edges)
    # inner objects, all on their pivot's chain, meet the boundary of the same pivot that is not on it
    label = components(edges).select(F.col("node").alias("v"), "component")
    held = reduce(DataFrame.union, windows).distinct()
    held = stored(held.join(label, F.col("id") == F.col("v"), "left").select("p", "id", "zone", F.coalesce("component", "id").alias("c")), "windows", small=True)
    on = held.where("zone = 0").groupBy(F.col("p").alias("r")).agg(F.min("c").alias("cp"))
    ring = held.where("zone = 1").join(on, (F.col("p") == F.col("r")) & (F.col("c") != F.col("cp"))).select("p", "id", "zone", "c")
    inner = held.where("zone = 0").join(ring.select(F.col("p").alias("r")), F.col("p") == F.col("r"), "left_semi")
    sizes = live.select(F.col("id").alias("i"), "n").distinct()
    met = ring.union(inner).join(sizes, F.col("id") == F.col("i")).select(F.col("p").alias("cell"), "id", "zone", "n", "c")
    met = stored(met, "meetings", small=True)
    fits = _fitting(met, room)
    edges = edges.union(stored(within_cells(fits, items, percent), "met-links"))
    large = met.join(fits.select(F.col("cell").alias("f")), F.col("cell") == F.col("f"), "left_anti")
    other = large.where("zone = 1").select(F.col("cell").alias("f"), F.col("id").alias("pivot"))
    cross = large.where("zone = 0").join(other, F.col("cell") == F.col("f")).select(F.col("id").alias("a"), "pivot").distinct().withColumn("m", F.lit(0))
    return edges.union(against_pivots(cross, items, percent, percent).select("a", "b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, hot: int = 200_000, every: int = 16, room: int = ROOM) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (documents with the same set) of each document."""
    docs = text_of(docs, id_col, text_col)
    raw = stored(signatures(docs, frequent(docs, hot, every), percent), "shingle-raw")
    rows = raw.select(F.col("s1").alias("id"), "n", F.posexplode("prefix").alias("at", "region"))
    w = W.partitionBy("region")
    live = rows.withColumns({"lo": F.min("id").over(w), "hi": F.max("id").over(w)}).where("lo < hi")
    live = stored(live.select("region", "id", "n", "at").distinct(), "shingle-regions")
    base = stored(raw.select("doc_id", "n", "s1", "s2"), "shingle-base", small=True)
    discard(raw)
    named = base.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    named = stored(named, "shingle-sets", small=True)
    rows, ids = base.agg(F.count("*"), F.count_distinct("doc_id")).first()
    own = "rep" if rows == ids else "s1"
    if own == "rep":  # a set is named by its first document, so that the texts' own shuffle deals the sets
        reps = named.select(F.col("s1").alias("i"), F.col("rep"))
        last, live = live, stored(live.join(reps, F.col("id") == F.col("i")).select("region", F.col("rep").alias("id"), "n", "at"), "shingle-regions")
        discard(last)
        some = docs.hint("merge").join(live.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        items, table = bucketed(sets(some, by_doc=True), "id", "shingle-items", dealt=True)
    else:  # ids that are null or repeat name no set
        met = live.select(F.col("id").alias("i")).distinct()
        some = named.join(met, F.col("s1") == F.col("i"), "left_semi").select(F.col("rep").alias("d")).distinct()
        some = sets(docs.join(some, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi"))
        items, table = bucketed(some.join(met, F.col("id") == F.col("i"), "left_semi").dropDuplicates(["id"]), "id", "shingle-items")

    linked = components(links(live, items, percent, room))
    drop_bucketed(items, table)
    discard(live)
    of = named.join(linked, F.col(own) == F.col("node"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id")).withColumnRenamed("component", "c")
    label = of.join(least, F.col("component") == F.col("c")).select(F.col("s1").alias("m"), "component_id")
    label = named.join(label, F.col("s1") == F.col("m"), "left").select(F.col("s1").alias("z1"), F.col("s2").alias("z2"), F.col("n").alias("zn"), "n_copies", F.coalesce("component_id", "rep").alias("component_id"))
    out = base.join(label, (F.col("s1") == F.col("z1")) & (F.col("s2") == F.col("z2")) & (F.col("n") == F.col("zn")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
