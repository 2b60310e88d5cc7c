"""AVI motion-JPEG columns.

A payload becomes video: 576 bytes are one frame of 24 x 24 flat 8 x 8 blocks, one byte a block.
A flat block has a DC coefficient only, and with a DC step of 8 the coded value is the sample
minus 128, so baseline decoding returns every sample exactly. The frames' own Huffman tables give
size class c a code of 9 - c bits: a DC difference then takes 9 bits whatever its class, and with
a 7-bit end-of-block code a block takes two whole bytes, so frames are coded and decoded as arrays.

The reader goes by the RIFF chunk tree and the idx1 index. Frames of this profile are read as arrays;
any other baseline frame is decoded in full, by its own quantisation and Huffman tables (the usual
ones where it has none), with all coefficients and components, and its luma is what shots see. Shots end where the histogram difference of two frames passes mean + k deviations of the
differences seen in a sliding window; each shot is a timed clip.

Defined cases: null and empty texts become one frame of 255s; equal payloads give equal files,
clips and features; an empty table returns no row; other columns are ignored. A file must stay
under the format's 4 GiB.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, text_of

SIDE, FRAME, FPS = 24, 576, 25


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in lengths.get(n, []))


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, _dht(0x00, {9 - c: [c] for c in range(9)}))
    + _segment(0xC4, _dht(0x10, {7: [0]}))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """Canonical (symbol, code, length) of a Huffman table segment."""
    out, code, k = [], 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out.append((symbols[k], code, n))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _words(codes: list[tuple[int, int, int]]) -> np.ndarray:
    """9-bit word of each DC difference from -255 to 255."""
    table = np.zeros(511, np.uint16)
    for c, code, n in codes:
        if n + c != 9:
            raise ValueError("unsupported table")
        for low in range(1 << c):
            d = 0 if not c else low if low >> (c - 1) else low - (1 << c) + 1
            table[d + 255] = (code << c) | low
    return table


_ENCODE = _words([(c, ((1 << (8 - c)) - 1) << 1, 9 - c) for c in range(8, -1, -1)])

_DECODE = np.zeros(512, np.int16)
_DECODE[_ENCODE] = np.arange(-255, 256)


def encode(payload: bytes) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of 576."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    d = x.copy()
    d[:, 1:] -= x[:, :-1]
    d[:, 0] -= 128
    coded = (_ENCODE[d + 255] << 7).astype(">u2").tobytes()
    step = 2 * FRAME
    scans = (coded[i * step : (i + 1) * step].replace(b"\xff", b"\xff\x00") for i in range(len(x)))
    return container([HEADER + scan + b"\xff\xd9" for scan in scans], SIDE * 8, SIDE * 8)


def container(jpegs: list[bytes], width: int, height: int) -> bytes:
    """The AVI file of JPEG frames."""
    n, body, index, at = len(jpegs), [], [], 4
    for jpeg in jpegs:
        size = len(jpeg)
        body.append(struct.pack("<4sI", b"00dc", size) + jpeg + b"\x00" * (size & 1))
        index.append(struct.pack("<4sIII", b"00dc", 16, at, size))
        at += 8 + size + (size & 1)
    movi = b"movi" + b"".join(body)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 10000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _list(b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _list(b"hdrl" + _chunk(b"avih", avih) + strl)
    riff = b"AVI " + hdrl + _list(movi) + _chunk(b"idx1", b"".join(index))
    if len(riff) >= 1 << 32:
        raise ValueError("payload too long for one RIFF file")
    return _chunk(b"RIFF", riff)


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack("<4sI", name, len(body)) + body + b"\x00" * (len(body) & 1)


def _list(body: bytes) -> bytes:
    return _chunk(b"LIST", body)


def index(avi: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames per second and (position, size) of each key frame, from the RIFF tree and idx1."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, fps, frames = 12, 8 + struct.unpack_from("<I", avi, 4)[0], None, 0.0, []
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", avi, at)
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / struct.unpack_from("<I", avi, at + 20)[0]
        elif name == b"idx1":
            for k in range(at + 8, at + 8 + size, 16):
                frame, flags, offset, length = struct.unpack_from("<4sIII", avi, k)
                if frame[2:] == b"dc" and flags & 16:
                    frames.append((movi + offset + 8, length))
        at += 8 + size + (size & 1)
    return fps, frames


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_DCT = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _usual(counts: str, symbols: bytes) -> tuple[bytes, bytes]:
    return bytes.fromhex(counts), symbols


#: The tables of frames that bring none (ITU-T T.81, K.3).
USUAL = {
    0x00: _usual("00010501010101010100000000000000", bytes(range(12))),
    0x01: _usual("00030101010101010101010000000000", bytes(range(12))),
    0x10: _usual("0002010303020403050504040000017d", bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")),
    0x11: _usual("00020102040403040705040400010277", bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa")),
}


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """Of each 16 bits: the length of the code that they begin with, times 256, and its symbol; 0: none."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, code, n in _codes(counts, symbols):
        table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return table.tolist()


def _block(data: bytes, at: int, dc: list[int], ac: list[int], before: int) -> tuple[int, list[int]]:
    """The next bit's place and a block's coefficients in their coded order."""
    out, k, table = [0] * 64, 0, dc
    while k < 64:
        i = at >> 3
        if i + 6 > len(data):
            raise ValueError("a frame's data ends early")
        bits = int.from_bytes(data[i : i + 6], "big") >> (16 - (at & 7)) & 0xFFFFFFFF
        code = table[bits >> 16]
        if not code:
            raise ValueError("not a code of the frame's table")
        n, symbol = code >> 8, code & 255
        run, size = (symbol >> 4, symbol & 15) if k else (0, symbol)
        at += n + size
        if k and not size:
            if run < 15:
                break
            k += 16
            continue
        value = (bits >> (32 - n - size)) & ((1 << size) - 1)
        if size and not value >> (size - 1):
            value -= (1 << size) - 1
        k += run
        if k > 63:
            raise ValueError("too many coefficients in a block")
        out[k] = value + before if not k else value
        k, table = k + 1, ac
    return at, out


def picture(frame: bytes) -> np.ndarray:
    """The samples of a baseline frame as stored: (height, width, components), components of fewer
    samples repeated to full size."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, tables, restart, parts, high, wide = 2, {}, dict(USUAL), 0, {}, 0, 0
    while at + 4 <= len(frame):
        marker = frame[at + 1]
        if frame[at] != 0xFF or marker in (0xFF, 0x00):
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not high or not wide:
                raise ValueError("unsupported samples")
            parts = {body[6 + 3 * i]: [body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)}
            hs, vs = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
            mx, my = -(-wide // (8 * hs)), -(-high // (8 * vs))
            blocks = {c: np.zeros((my * p[1], mx * p[0], 64), np.int64) for c, p in parts.items()}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = [(body[1 + 2 * i], _lookup(*tables[body[2 + 2 * i] >> 4]), _lookup(*tables[16 | body[2 + 2 * i] & 15])) for i in range(body[0])]
            if len(scan) == 1:  # its own blocks, row by row
                c, (h, v, _) = scan[0][0], parts[scan[0][0]]
                units = [[(0, y, x)] for y in range(-(-(-(-high * v // vs)) // 8)) for x in range(-(-(-(-wide * h // hs)) // 8))]
            else:
                units = [[(i, my_ * parts[c[0]][1] + y, mx_ * parts[c[0]][0] + x) for i, c in enumerate(scan) for y in range(parts[c[0]][1]) for x in range(parts[c[0]][0])] for my_ in range(my) for mx_ in range(mx)]
            end = re.compile(rb"\xff[^\x00\xd0-\xd7]").search(frame, at)
            stop = end.start() if end else len(frame)
            pieces = re.split(rb"\xff[\xd0-\xd7]", frame[at:stop])
            every = restart or len(units)
            for lo in range(0, len(units), every):
                if lo // every >= len(pieces):
                    raise ValueError("a frame's data ends early")
                data, bit, last = pieces[lo // every].replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0, [0] * len(scan)
                for unit in units[lo : lo + every]:
                    for i, y, x in unit:
                        bit, got = _block(data, bit, scan[i][1], scan[i][2], last[i])
                        last[i] = got[0]
                        blocks[scan[i][0]][y, x] = got
            at = stop
    if not parts:
        raise ValueError("a frame without a header")
    planes = []
    for c, (h, v, q) in parts.items():
        f = np.zeros(blocks[c].shape, float)
        f[..., _ZIGZAG] = blocks[c] * quant[q]
        x = _DCT.T @ f.reshape(*f.shape[:2], 8, 8) @ _DCT
        x = x.transpose(0, 2, 1, 3).reshape(f.shape[0] * 8, -1)
        x = np.clip(np.floor(x + 128.5), 0, 255).astype(np.uint8)
        planes.append(x[np.arange(high) * v // vs][:, np.arange(wide) * h // hs])
    return np.stack(planes, 2)


def decode(avi: bytes) -> tuple[float, np.ndarray]:
    """Frames per second and the samples, one row a frame: the blocks' values where all frames are of
    this profile, else the luma of each frame."""
    fps, frames = index(avi)
    cut, words = len(HEADER), []
    for at, size in frames:
        words.append(avi[at + cut : at + size - 2].replace(b"\xff\x00", b"\xff") if avi[at : at + cut] == HEADER else b"")
    if all(len(w) == 2 * FRAME for w in words):
        w = np.frombuffer(b"".join(words), ">u2").reshape(len(frames), FRAME)
        if not (w & 127).any():
            return fps, (np.cumsum(_DECODE[w >> 7], axis=1, dtype=np.int16) + 128).astype(np.uint8)
    rows = []
    for at, size in frames:
        # an empty frame shows the last one again
        rows.append(picture(avi[at : at + size])[..., 0].ravel() if size or not rows else rows[-1])
    return fps, np.stack(rows)


def shots(x: np.ndarray, bins: int = 16, window: int = 8, k: int = 3, least: int = 64) -> list[tuple[int, int, int]]:
    """(first frame, end frame, histogram difference that opened it) of each shot. Integer
    arithmetic: a cut needs diff > least and diff > mean + k deviations of the window before it."""
    n = len(x)
    h = np.zeros(n * bins, np.int64)
    cells = (np.arange(n)[:, None] * bins + (x >> 4)).ravel()
    h = np.bincount(cells, minlength=n * bins).reshape(n, bins)
    diff = np.abs(np.diff(h, axis=0)).sum(1).tolist()
    cuts, s, q, since = [(0, 0)], 0, 0, []
    for i, d in enumerate(diff, 1):
        m = len(since)
        if m >= 2 and d > least and m * d > s and (m * d - s) ** 2 > k * k * (m * q - s * s):
            cuts.append((i, d))
            since, s, q = [], 0, 0
            continue
        since.append(d)
        s, q = s + d, q + d * d
        if m == window:
            out = since.pop(0)
            s, q = s - out, q - out * out
    ends = [c[0] for c in cuts[1:]] + [n]
    return [(a, e, d) for (a, d), e in zip(cuts, ends, strict=True)]


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


MEDIA = "doc_id long, n_bytes long, avi binary"
CLIPS = "doc_id long, clip int, start_ms long, end_ms long, start_frame int, end_frame int, opening int"


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, and its AVI file as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "avi"])

    return text_of(docs, id_col, text_col).mapInArrow(run, MEDIA)


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of a table with doc_id and avi: one per shot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, avi in zip(b.column("doc_id").to_pylist(), b.column("avi"), strict=True):
                fps, x = decode(avi.as_py())
                out += [(doc, i, round(1000 * a / fps), round(1000 * e / fps), a, e, d) for i, (a, e, d) in enumerate(shots(x))]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], [c.split()[0] for c in CLIPS.split(", ")])

    return media.select("doc_id", "avi").mapInArrow(run, CLIPS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame) -> DataFrame:
    """Digests of the stored file and of the payload read back from it; feature: frames and, of
    each shot, its first frame and the difference that opened it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, avi in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("avi"), strict=True):
                avi = avi.as_py()
                _, x = decode(avi)
                back = x.tobytes()
                cuts = shots(x)
                what = f"{len(x)}f {len(cuts)}s " + ",".join(f"{a}:{d}" for a, _, d in cuts)
                out.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), crc32(back[-32:]), len(avi), hashlib.sha256(avi).hexdigest(), what))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "avi").mapInArrow(run, DIGEST)
