"""Hierarchical residual best-fit packing.

Documents become token ids (byte-level BPE) and an end id; those longer than a sequence are cut,
the first piece taking the remainder. Pieces go into bins by best fit, largest first, within
each partition; bins that are nearly full are final, and the others become the items of the next
round, in as many partitions as their number needs.

Lengths are integers up to the capacity, so best fit needs one list of bins per residual space
and a bit set of the non-empty lists.

Defined cases: a null text is empty and becomes one piece with the end id; repeated rows are
packed once each; an empty table returns no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, text_of

CAPACITY, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"


AWKWARD = re.compile(r" (?:\s|\Z)")


class Tokenizer:
    """Token ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pattern always starts a new token run at a space before a character that is
    not white space, so a text splits at single spaces and each part is encoded on its own; parts
    already seen come from a cache of at most ``cache`` entries."""

    def __init__(self, ranks_path: str, pattern: str, full_path: str | None = None, cache: int = 600_000):
        import tiktoken

        # texts that hold a token added to the vocabulary go to the tokenizer's own file
        self.full, self.added = None, []
        if full_path:
            from tokenizers import Tokenizer as Full

            self.full = Full.from_file(full_path)
            self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache, self.most = {}, cache
        self.marks = {m: self.raw(m) for m in ".,;:!?"}

    def raw(self, text: str) -> bytes:
        ids = array("I", self.encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def part(self, part: str) -> bytes:
        # a word before one mark is a token run of its own
        word, mark = (self.cache.get(part[:-1]), self.marks.get(part[-1])) if part[:-1].isalpha() else (None, None)
        ids = word + mark if word and mark else self.raw(" " + part)
        if len(self.cache) < self.most and len(part) <= 64:
            self.cache[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.split(" ")
        if AWKWARD.search(text):
            return self.awkward(parts)
        got = list(map(self.cache.get, parts[1:]))
        head = self.raw(parts[0])
        if None in got:
            got = [self.part(p) if g is None else g for g, p in zip(got, parts[1:], strict=True)]
        return head + b"".join(got)

    def awkward(self, parts: list[str]) -> bytes:
        """Some part is empty or begins with white space: only split where a part does not."""
        out, run = [], parts[0]
        first = True
        for p in [*parts[1:], None]:
            if p is not None and (not p or p[0].isspace()):
                run += " " + p
                continue
            if first:
                out.append(self.raw(run))
            else:
                out.append(self.cache.get(run) or self.part(run))
            run, first = p, False
        return b"".join(out)


_TOKENIZERS: dict[str, Tokenizer] = {}


def pieces(docs: DataFrame, ranks_path: str | None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece; ``item`` numbers the pieces. ``ranks_path``: the vocabulary's ranks
    (none: that of the public byte-level BPE, looked up on each executor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from public_tokenizers import PATTERN, path

        at = ranks_path or path("byte_bpe_50k.tiktoken")
        if at not in _TOKENIZERS:
            _TOKENIZERS[at] = Tokenizer(at, PATTERN, None if ranks_path else path("byte_bpe_50k.json"))
        tok, last, step = _TOKENIZERS[at], end.to_bytes(4, "little"), 4 * capacity
        for rows, texts in chunks(batches):
            out: list[tuple] = []
            for doc, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                ids = tok.ids(text.decode()) + last
                n = len(ids)
                cut = n % step or step
                lo, hi, k = 0, cut, 0
                while lo < n:
                    out.append((doc, k, lo // 4, (hi - lo) // 4, crc32(ids[lo:hi]), 0))
                    lo, hi, k = hi, hi + step, k + 1
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    out = text_of(docs, id_col, text_col).mapInArrow(run, PIECES)
    return out.withColumn("item", F.monotonically_increasing_id())


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin); best fit, largest first, stable."""
    order = np.argsort(-sizes, kind="stable").tolist()
    size = sizes.tolist()
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, fills = 0, []  # bit r: some bin has room r
    to, off = [0] * len(size), [0] * len(size)
    for i in order:
        n = size[i]
        fit = open_ >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_ &= ~(1 << room)
            off[i] = fills[b]
            fills[b] += n
            room -= n
        else:
            b = len(fills)
            fills.append(n)
            room = capacity - n
        to[i] = b
        if room:
            by_room[room].append(b)
            open_ |= 1 << room
    return np.array(to, np.int64), np.array(off, np.int64), np.array(fills, np.int64)


ROUND = "item long, bin long, offset long, fill long"


def pack_round(items: DataFrame, parts: int, capacity: int, tag: int) -> DataFrame:
    """(item, size) -> item, its bin, offset and the bin's fill; bins are numbered by round and
    partition. A partition's items are three integers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        item, size, part = (np.concatenate(x) for x in zip(*got, strict=True))
        for p in np.unique(part):
            its, sz = item[part == p], size[part == p]
            order = np.argsort(its, kind="stable")
            its, sz = its[order], sz[order]
            to, off, fills = best_fit(sz, capacity)
            yield pa.RecordBatch.from_arrays([pa.array(its), pa.array((tag << 58) + (int(p) << 36) + to), pa.array(off), pa.array(fills[to])], ["item", "bin", "offset", "fill"])

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(tag)), F.lit(parts))) if parts > 1 else items.withColumn("part", F.lit(0).cast("long"))
    return dealt.repartition(parts, "part").mapInArrow(run, ROUND)


def pack(docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, per_part: int = 20_000, full: float = 0.995) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole-sequence pieces need no packing. ``per_part`` items go to a partition of each round, dealt
    anew, so that a task holds about that many whatever is left. Bins with no room for the smallest
    item left are final too. Rounds end with one of a single partition, or one that saves under a
    fiftieth of its items: what is left then (such as items all over half a sequence) does not pair."""
    got = stored(pieces(docs, ranks_path, id_col, text_col, capacity, end), "pack-pieces")
    items = got.where(F.col("length") < capacity).select("item", F.col("length").alias("size"))
    n, least = items.agg(F.count("*"), F.min("size")).first()
    rounds = []
    while True:
        parts = -(-n // per_part) or 1
        packed = stored(pack_round(items, parts, capacity, len(rounds) + 1), "pack-round")
        rounds.append(packed)
        if parts == 1:
            break
        # one row per underfull bin: that of its first item
        bins = packed.where("offset = 0")
        items = bins.where((F.col("fill") < full * capacity) & (F.col("fill") <= capacity - least)).select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        made, (left, least) = bins.count(), items.agg(F.count("*"), F.min("size")).first()
        if not left or made > 0.98 * n:
            break
        n = left
    # follow bins upwards; a bin's place is the sum of its offsets
    place = rounds[-1].select("item", "bin", "offset")
    for r in reversed(rounds[:-1]):
        up = place.select(F.col("item").alias("i"), F.col("bin").alias("up"), F.col("offset").alias("more"))
        place = r.join(up, F.col("bin") == F.col("i"), "left").select("item", F.coalesce("up", "bin").alias("bin"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
    place = place.select(F.col("item").alias("i"), "bin", "offset")
    out = got.join(place, F.col("item") == F.col("i"), "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("bin", "item").alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))
