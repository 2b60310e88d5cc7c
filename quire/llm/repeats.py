"""Repeated-passage removal by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``size`` bytes that covers it also starts anywhere else. Texts are
bytes; strings never cross texts.

1. Anchors. Every window of hashed k-grams has a smallest one; the string that starts at p is
   anchored at the smallest k-gram of its own leading window. Equal strings so have equal anchors at
   equal distance, and the starts of a text fall into runs, one per anchor. An anchor's k-gram that
   occurs once in the corpus cannot begin a repeat: only repeated anchors go on, each with its
   context, the bytes that the strings of its run span. Contexts that are equal as a whole settle all
   strings of their runs at once, by a count over their hashes, and one of them goes on in case
   others share a part.
2. Merge. The remaining contexts meet by anchor hash. The contexts that one map task sent are a shard:
   its starts are sorted by their strings, with the bytes that precede them, which is the shard's
   Burrows-Wheeler transform over these starts. Shards merge by refining their interleave: all
   starts begin as one block per anchor; each round extends the known common prefix of every block
   by the next symbols and splits blocks where these differ, a block of one start being final. The
   round in which neighbours part is their longest common prefix. No shard is sorted again. Starts
   whose block is still shared at ``size`` bytes are repeated; consecutive ones join into spans.

The symbols of a round are eight bytes; that changes the number of rounds, not the blocks.

Defined cases: a null text is empty; texts shorter than ``size`` lose nothing; repeated rows are
occurrences of their own, so long copies all go; null ids keep their rows; an empty table returns no
row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _BYTE, chunks, mix, span_hashes, stored, text_of

SIZE, GRAM = 200, 24
ANCHORS = "gram long, whole long, doc long, key long, first long, n int, lead int"


def _grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position; k = 24 is 16 + 8."""
    h, width = _BYTE[buf], 1
    parts = []
    at = 0
    while True:
        if k & width:
            parts.append((h, at))
            at += width
        if width * 2 > k:
            break
        h = h[: len(h) - width] * U64(0x9E3779B97F4A7C15) + mix(h[width:]) if width >= 8 else h[: len(h) - width] * U64(0x9E3779B97F4A7C15) + h[width:]
        width *= 2
    n = len(buf) - k + 1
    out = np.zeros(n, U64)
    for p, off in parts:
        out = out * U64(0xD6E8FEB86659FD93) + p[off : off + n]
    return mix(out)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[p : p + w] for each p, by doubling."""
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - width :][: len(x) - w + 1]) if width < w else out


def runs(buf: np.ndarray, bounds: np.ndarray, size: int = SIZE, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the texts buf[bounds[i]:bounds[i+1]]: (text, first start, starts, lead, gram, whole) of
    each anchor's run; first start counts from the text's begin, lead is the anchor's distance from
    it, gram and whole hash the anchor and the run's whole context."""
    w = size - k + 1
    h = _grams(buf, k)
    # the low bits carry the place: of equal k-grams in a window the first is its anchor
    place = np.arange(len(h), dtype=U64)
    least = (_window_min((h & ~U64((1 << 24) - 1)) | (place & U64((1 << 24) - 1)), w) & U64((1 << 24) - 1)).astype(np.int64)
    n = np.diff(bounds) - size + 1
    ok = np.flatnonzero(n > 0)
    text = np.repeat(ok, n[ok])
    start = np.arange(len(text)) - np.repeat(np.cumsum(n[ok]) - n[ok], n[ok])
    at = bounds[text] + start
    anchor = at + ((least[at] - at) & ((1 << 24) - 1))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(text)]]))
    lo, lead = at[new], (anchor - at)[new]
    whole = mix(span_hashes(buf, lo, lo + count + size - 1) + lead.astype(U64)) if len(new) else np.zeros(0, U64)
    return text[new], start[new], count, lead, h[anchor[new]], whole


def anchors(docs: DataFrame, size: int = SIZE, piece: int = 1 << 22) -> DataFrame:
    """ANCHORS of (doc, key, text); a text longer than ``piece`` is read in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            if len(texts) == 1 and len(texts[0]) > piece:
                cuts = [(rows, [texts[0][lo : lo + piece + size - 1]], lo) for lo in range(0, len(texts[0]) - size + 1, piece)]
            else:
                cuts = [(rows, texts, 0)]
            for rows_, some, lo in cuts:
                buf = np.frombuffer(b"".join(some), np.uint8)
                if len(buf) < size:
                    continue
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in some])])
                text, first, count, lead, gram, whole = runs(buf, bounds, size)
                doc, key = rows_.column("doc").to_numpy()[text], rows_.column("key").to_numpy()[text]
                cols = [gram.view(np.int64), whole.view(np.int64), doc, key, first + lo, count.astype(np.int32), lead.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in ANCHORS.split(", ")])

    return docs.select("doc", "key", "text").mapInArrow(run, ANCHORS)


def merge(contexts: list[bytes], leads: np.ndarray, grams: np.ndarray, shards: np.ndarray, size: int = SIZE, room: int = 1 << 20) -> list[np.ndarray]:
    """Of each context, whether the string at each of its starts also starts in another one here.

    Strings of equal ``gram`` and equal distance to it are compared; shards are merged block by
    block as described above, for so many distances at a time that about ``room`` starts are held."""
    lens = np.array([len(c) for c in contexts])
    count = lens - size + 1
    buf = np.frombuffer(b"".join(contexts) + b"\0" * 8, np.uint8)
    # the eight bytes from each place as one symbol
    words = np.lib.stride_tricks.sliding_window_view(buf, 8)
    base, put = np.cumsum(lens) - lens, np.cumsum(count) - count
    shared = np.zeros(int(count.sum()), bool)
    near, far = int((leads - count).min()) + 1, int(leads.max()) + 1
    width = max(1, (far - near) * room // max(1, len(shared)))
    for d in range(near, far, width):
        first = np.clip(leads - d - width + 1, 0, count)
        some = np.clip(leads - d + 1, first, count) - first
        owner = np.repeat(np.arange(len(lens)), some)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some) + first[owner]
        at = base[owner] + offset
        # one block for each anchor and distance to it
        block = mix(grams[owner] + (leads[owner] - offset).astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.lexsort((shards[owner], block))
        live, block = order, block[order]
        depth = 0
        while len(live):
            edge = np.concatenate([[True], block[1:] != block[:-1]])
            alone = edge & np.concatenate([edge[1:], [True]])
            live, block = live[~alone], block[~alone]
            if depth >= size or not len(live):
                break
            step = min(8, size - depth)
            symbol = np.zeros(len(live), U64)
            got = words[at[live] + depth]
            for i in range(step):
                symbol = (symbol << U64(8)) | got[:, i].astype(U64)
            rank = np.cumsum(np.concatenate([[0], block[1:] != block[:-1]]))
            order = np.lexsort((symbol, rank))  # stable: within a block shards keep their order
            live, rank, symbol = live[order], rank[order], symbol[order]
            block = np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]) | (symbol[1:] != symbol[:-1])]))
            depth += step
        shared[put[owner[live]] + offset[live]] = True
    return np.split(shared, np.cumsum(count)[:-1])


CONTEXTS = "gram long, shard int, doc long, key long, first long, lead int, context binary"
SPANS = "doc long, key long, first long, n long"


def contexts(docs: DataFrame, wanted: DataFrame, size: int, hot: int) -> DataFrame:
    """CONTEXTS of the runs in ``wanted`` (ANCHORS and wholes). Of an anchor with more than ``hot``
    different contexts every string goes alone, dealt by its own first half."""
    per = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("gram", "first", "n", "lead", (F.col("wholes") > hot).alias("hot"))).alias("runs")).toDF("d", "k", "runs")
    both = docs.join(per.hint("shuffle_hash"), (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k"))).select("doc", "key", "text", "runs")

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in CONTEXTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for rows, texts in chunks(batches):
            out, held = [], 0
            for doc, key, text, rs in zip(rows.column("doc").to_pylist(), rows.column("key").to_pylist(), texts, rows.column("runs").to_pylist(), strict=True):
                for r in rs:
                    lo, n = r["first"], r["n"]
                    if not r["hot"]:
                        out.append((r["gram"], shard, doc, key, lo, r["lead"], text[lo : lo + n + size - 1]))
                        held += n + size
                        continue
                    for i in range(n):
                        x = text[lo + i : lo + i + size]
                        h = hashlib.blake2b(x[: size // 2] + (r["lead"] - i).to_bytes(4, "little"), digest_size=8).digest()
                        out.append((int.from_bytes(h, "little", signed=True), shard, doc, key, lo + i, 0, x))
                    held += n * size
                    if held > 1 << 22:  # strings that go alone take many times their text's room
                        yield batch(out)
                        out, held = [], 0
            if out:
                yield batch(out)

    return both.mapInArrow(run, CONTEXTS)


def merged(ctx: DataFrame, size: int, group: int = 1 << 15) -> DataFrame:
    """SPANS of repeated starts among contexts: whole anchors at a time, ``group`` contexts or so."""

    def spans(part: pa.Table) -> pa.RecordBatch:
        cols = {n: part.column(n).to_numpy() for n in ("gram", "shard", "doc", "key", "first", "lead")}
        flags = merge([c for c in part.column("context").to_pylist()], cols["lead"].astype(np.int64), cols["gram"].view(U64), cols["shard"], size)
        out = []
        for i, f in enumerate(flags):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
            out += [(i, a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        at = np.array([o[0] for o in out], np.int64)
        off, n = np.array([o[1] for o in out], np.int64), np.array([o[2] for o in out], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cols["doc"][at]), pa.array(cols["key"][at]), pa.array(cols["first"][at] + off), pa.array(n)], ["doc", "key", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size_ = 0
        for b in batches:
            held.append(b)
            size_ += b.num_rows
            if size_ < group:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            grams = t.column("gram").to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))  # the last anchor may go on
            if cut:
                yield spans(t.slice(0, cut).combine_chunks())
                held, size_ = t.slice(cut).to_batches(), t.num_rows - cut
        if size_:
            yield spans(pa.Table.from_batches(held).combine_chunks())

    return ctx.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, SPANS)


def removed(docs: DataFrame, size: int = SIZE, hot: int = 20_000) -> DataFrame:
    """SPANS: runs of starts whose string of ``size`` bytes also starts elsewhere; docs: doc, key, text."""
    a = stored(anchors(docs, size), "anchors")
    g = a.groupBy("gram", "whole").agg(F.count("*").alias("m"))
    per = g.groupBy("gram").agg(F.sum("m").alias("total"), F.count("*").alias("wholes")).where("total > 1").withColumnRenamed("gram", "g1")
    g = stored(g.join(per, F.col("gram") == F.col("g1")).select(F.col("gram").alias("g"), F.col("whole").alias("w"), "m", "wholes"), "anchor-groups")
    live = stored(a.join(g, (F.col("gram") == F.col("g")) & (F.col("whole") == F.col("w"))).drop("g", "w"), "anchors-live")
    one = live.where("wholes > 1").groupBy("gram", "whole").agg(F.min(F.struct("doc", "key", "first", "n", "lead", "wholes")).alias("x")).select("gram", "x.*")
    part = merged(stored(contexts(docs, one, size, hot), "contexts"), size)
    return stored(live.where("m > 1").select("doc", "key", "first", F.col("n").cast("long")).union(part), "repeat-spans")


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """KEPT of every document: sizes, maximal removed runs, and the bytes that stay."""
    d = text_of(docs, id_col, text_col)
    d = d.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "key": F.xxhash64("doc_id", "text")})
    per = removed(d, size).groupBy("doc", "key").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns")).toDF("d", "k", "firsts", "ns")
    both = d.join(per.hint("shuffle_hash"), (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "firsts", "ns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            out = []
            for doc, t, firsts, ns in zip(rows.column("doc_id").to_pylist(), texts, rows.column("firsts"), rows.column("ns"), strict=True):
                if not firsts.is_valid:
                    out.append((doc, len(t), 0, 0, t))
                    continue
                change = np.zeros(len(t) + 1, np.int64)
                lo = np.asarray(firsts.values)
                np.add.at(change, lo, 1)
                np.add.at(change, lo + np.asarray(ns.values) + size - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                n_runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((doc, len(t), int(gone.sum()), n_runs, np.frombuffer(t, np.uint8)[~gone].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in KEPT.split(", ")])

    return both.mapInArrow(run, KEPT)
