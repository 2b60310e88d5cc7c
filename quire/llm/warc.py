"""Deterministic sharded WARC writer and reader.

Records are sorted by id within key ranges cut at a hash-chosen sample of ids, so equal input gives
equal files. A writer task streams its range into gzip members, rolls to a new file at a compressed
size, and makes every header and digest from the payload. Files are written under temporary names
that carry the attempt; the manifest of the attempts that succeeded is stored as a table, and only
then are its files renamed and the manifest marked complete. A task that runs again leaves at most
an unnamed temporary file, and readers go by the manifest alone.

Of records with equal payloads of at least ``min_bytes`` the one with the largest id is the
response and the others are revisits of it. Only ids and digests take part in that join.

Defined cases: a null payload is empty; a null id sorts first, is written as an empty id and read
back as null, and is never what a revisit refers to unless all of its copies lack an id (then all
are responses); repeated rows with the largest id are all responses; an empty table makes an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, temporary string, first long, last long, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def _urn(page: int | None, sha1: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{sha1.hex()}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; refers_to: the id of the response, for a revisit."""
    sha1 = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "" if c > " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page, sha1)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"X-Page-ID: {'' if page is None else page}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, sha1)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> tuple:
    """A row of RECORDS from one record; the digests of a response are checked on the way."""
    head, _, rest = member.partition(b"\r\n\r\n")
    top = head.decode().split("\r\n")
    if not top[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in top[1:])}
    block = rest[: int(h["content-length"])]
    if base64.b32decode(h["warc-block-digest"].removeprefix("sha1:")) != hashlib.sha1(block).digest():
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:"))
    kind = h["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError("payload digest")
    page, to = h["x-page-id"], h.get("x-refers-to-page-id")
    return int(page) if page else None, h["warc-target-uri"], length, digest.hex(), kind, int(to) if to else None, payload


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, read block by block."""
    z, out, data = zlib.decompressobj(31), [], stream.read(1 << 18)
    while data:
        out.append(z.decompress(data))
        if z.eof:
            yield b"".join(out)
            data, out, z = z.unused_data or stream.read(1 << 18), [], zlib.decompressobj(31)
        else:
            data = stream.read(1 << 18)
    if any(out):
        raise ValueError("truncated file")


class _Roll:
    """Files of one task: gzip members under a temporary name, a new file at ``roll`` bytes."""

    def __init__(self, out: str, attempt: str, roll: int):
        self.fs, self.base = _fs(out)
        self.attempt, self.roll, self.file, self.range, self.k = attempt, roll, None, None, 0

    def put(self, rng: int, page: int | None, data: bytes) -> Iterator[tuple]:
        if self.file is not None and (rng != self.range or self.size >= self.roll):
            yield self.close()
        if self.file is None:
            self.k = self.k + 1 if rng == self.range else 0
            self.range, self.size, self.n, self.first, self.sha = rng, 0, 0, page, hashlib.sha256()
            self.name, self.tmp = f"part-{rng:06d}-{self.k:05d}.warc.gz", f"_temporary-{self.attempt}-{rng:06d}-{self.k:05d}"
            self.file = self.fs.open_output_stream(f"{self.base}/{self.tmp}", compression=None)
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        data = z.compress(data) + z.flush()
        self.file.write(data)
        self.sha.update(data)
        self.size, self.n, self.last = self.size + len(data), self.n + 1, page

    def close(self) -> tuple:
        self.file.close()
        self.file = None
        return self.name, self.tmp, self.first, self.last, self.n, self.size, self.sha.hexdigest()


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def write(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, roll: int = 64 << 20, range_bytes: int = 16 << 20) -> DataFrame:
    """Write the archive into folder ``out`` and return its manifest (a stored table)."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    ids = stored(p.select("page_id", F.octet_length("html").alias("n"), F.when(F.octet_length("html") >= min_bytes, F.sha1("html")).alias("d")), "warc-ids")
    size, n = ids.agg(F.sum("n"), F.count("*")).first()
    ranges = max(1, int(size or 0) // range_bytes)
    every = max(1, n // min(64 * ranges, 1 << 18))
    some = sorted(r[0] for r in ids.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)).select("page_id").collect()) if ranges > 1 else []
    cuts = sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []
    # one row per repeated digest meets the ids; then one small row per revisit meets its page by sorting
    most = ids.where("d is not null").groupBy("d").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("m")).where("m > 1")
    again = ids.join(most.withColumnRenamed("d", "e"), F.col("d") == F.col("e")).where("refers_to is not null and (page_id is null or page_id <> refers_to)")
    marks = again.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to", F.col("d").alias("digest")).distinct()
    rows = marks.unionByName(p.withColumns({"refers_to": F.lit(None).cast("long"), "digest": F.lit(None).cast("string")}))
    where = F.expr(f"cast(size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c <= page_id)) as int)") if cuts else F.lit(0)
    rows = rows.withColumn("range", F.coalesce(F.when(F.col("page_id").isNull(), F.lit(0)).otherwise(where), F.lit(0)))
    # a range is one task's: its marks come just before the pages they belong to
    rows = rows.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "page_id", F.col("html").isNotNull(), F.xxhash64("url", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(out)
        fs.create_dir(base, recursive=True)
        files, marks_of, at = _Roll(out, f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}", roll), {}, object()
        for b in batches:
            for i in range(0, b.num_rows, 64):
                for page, url, html, to, digest, rng in zip(*(c.to_pylist() for c in b.slice(i, 64).columns), strict=True):
                    if page != at:
                        at, marks_of = page, {}
                    if html is None:
                        marks_of[digest] = to
                        continue
                    data = html.encode()
                    to = marks_of.get(hashlib.sha1(data).hexdigest()) if marks_of else None
                    for done in files.put(rng, page, record(page, url, data, to)):
                        yield _rows([done], MANIFEST)
        if files.file is not None:
            yield _rows([files.close()], MANIFEST)

    manifest = stored(rows.select("page_id", "url", "html", "refers_to", "digest", "range").mapInArrow(run, MANIFEST), "warc-manifest")
    commit(manifest, out)
    return manifest


def commit(manifest: DataFrame, out: str) -> None:
    """Give the manifest's files their names, then mark the archive complete. Safe to repeat."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(out)
        for b in batches:
            for name, tmp in zip(b.column("file").to_pylist(), b.column("temporary").to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{tmp}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{tmp}", f"{base}/{name}")
            yield b.select(["file"])

    manifest.select("file", "temporary").mapInArrow(rename, "file string").write.mode("overwrite").parquet(f"{out}/_manifest")


def read(spark: SparkSession, manifest: DataFrame, out: str, payload: bool = True) -> DataFrame:
    """The records of an archive, one task stream per file; RECORDS with or without payload."""
    ddl = RECORDS if payload else RECORDS.rpartition(",")[0]
    width = len(ddl.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(out)
        for b in batches:
            for name in b.column("file").to_pylist():
                got, size = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for m in members(f):
                        got.append(parse(m)[:width])
                        size += len(m)
                        if size > 4 << 20:
                            yield _rows(got, ddl)
                            got, size = [], 0
                if got:
                    yield _rows(got, ddl)

    files = manifest.select("file")
    return files.repartition(max(1, min(10_000, files.count()))).mapInArrow(run, ddl)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write the archive in the shared folder and read it back, without payloads."""
    spark = pages.sparkSession
    out = scratch(spark, "warc")
    return read(spark, write(pages, out, **how), out, payload=False)
