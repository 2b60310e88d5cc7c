"""Shared pieces of the corpus operators: scratch tables, Arrow chunking, word hashing.

Text rules used throughout: a null text is the empty text, words are maximal runs of bytes
other than the six ASCII white-space bytes (space, tab, line feed, vertical tab, form feed,
carriage return), and lower-casing touches A-Z only. Both rules can be applied to UTF-8
bytes, so nothing here decodes text.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local session may lack that setting, as in tests: it gets a folder of its own. On a cluster
    a machine's own folder would be seen by that machine alone, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file:///tmp/quire-checkpoints"
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back, so that a
    lost executor costs a re-read and the expensive step before it never runs twice. ``small``:
    the step moved too little data for its shuffle files to matter."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if not small:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str, dealt: bool = False) -> tuple[DataFrame, str]:
    """Like stored(), as a table bucketed by ``column``, with its catalog name: joins on that column
    move only the other side. The table goes with drop_bucketed(). ``dealt``: the rows come from a
    shuffle by that column's values, so that each task already has whole buckets."""
    spark = df.sparkSession
    n = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"quire_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(n, column)).write.bucketBy(n, column).option("compression", "zstd").option("path", scratch(spark, name)).saveAsTable(table)
    release(spark)
    return spark.table(table), table


def drop_bucketed(df: DataFrame, table: str) -> None:
    discard(df)
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing will read again."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver's plan
    objects are collected, which a driver with a large heap may put off for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by as many underscores as none of them needs to clash with a column."""
    taken, names = {c.lower() for c in df.columns}, list(names)
    while taken & {n.lower() for n in names} or any(t.startswith(n.lower()) for t in taken for n in names):
        names = [f"_{n}" for n in names]
    return names


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text (a longer text comes alone),
    each with its texts as bytes; memory then follows the longest text, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        lo = size = 0
        for i, t in enumerate(texts):
            if i > lo and size + len(t) > limit:
                yield batch.slice(lo, i - lo), texts[lo:i]
                lo, size = i, 0
            size += len(t)
        yield batch.slice(lo), texts[lo:]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_B = 0x2545F4914F6CDD1D
_BINV = pow(_B, -1, 1 << 64)
_POW = {"n": 0}
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        m = max(n, 1 << 16)
        both = []
        for base in (_B, _BINV):
            p = np.full(m, base, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        _POW.update(n=m, p=both[0], q=both[1])
    p, q = _POW["p"][:n], _POW["q"][:n]
    if _POW["n"] > 1 << 23:  # a rare very long text; its tables are not kept
        _POW.update(n=0, p=None, q=None)
    return p, q


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], the same wherever the bytes stand."""
    p, q = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum((_LOWER if lower else _BYTE)[buf] * p[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U64))


class Words:
    """The words of a chunk of texts: byte spans, the text each is in, and hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False, hashes: bool = True):
        self.n = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, self.n) + 1
        self.bounds = np.concatenate([[0], np.cumsum(lens)])
        word = (~SPACE[self.buf]).view(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([np.zeros(1, np.int8), word])))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.counts = np.diff(np.searchsorted(self.starts, self.bounds))
        self.doc = np.repeat(np.arange(self.n), self.counts)
        self.hash = span_hashes(self.buf, self.starts, self.ends, lower) if hashes else None

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every k consecutive words of one text."""
        m = len(self.doc) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return at, chain([self.hash[i : i + m] for i in range(k)])[at]


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Order-aware hash of aligned columns of hashes."""
    h = np.full(len(parts[0]), len(parts), U64)
    for p in parts:
        h = mix(h * U64(0x9E3779B97F4A7C15) + p)
    return h


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of a per-byte column over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
