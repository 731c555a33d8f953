"""Media columns by signature sniffing.

One Aho-Corasick automaton holds the magic bytes of all known formats and walks the whole payload once (bytes as
Latin-1, so that one character is one byte). Every place found is handed to the format's validator, which follows the
format's own structure and returns the length it confirms, or None. The format confirmed at offset 0 corrects the
declared type; formats confirmed elsewhere, and not inside one already carved, are carved as embedded media. Marks of ends
are found once for a payload, and streams that many places lead to are followed once, so that a payload full of magic
bytes takes no longer than its size.

Defined cases: a null payload is sniffed as empty bytes (type null, nothing carved); a declared type that no validator
confirms is kept with valid = false; ties at an offset go to the longest confirmed length, then to the format's name;
repeated rows give repeated rows; very long payloads are read whole; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import mapped, slices, utf8


def _riff(kind: bytes) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if len(b) < at + 12 or b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        pos, names = at + 12, []
        while pos + 8 <= end:  # chunks fill the form exactly, each padded to an even length
            names.append(b[pos : pos + 4])
            pos += 8 + struct.unpack_from("<I", b, pos + 4)[0]
            pos += pos - at & 1
        if pos < end or pos > end + 1 or not names:
            return None
        return end - at if kind != b"WAVE" or (b"fmt " in names and b"data" in names) else None

    return check


def _png(b: bytes, at: int) -> int | None:
    pos = at + 8
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or (pos == at + 8) != (kind == b"IHDR"):
            return None
        if struct.unpack_from(">I", b, pos + 8 + n)[0] != zlib.crc32(b[pos + 4 : pos + 8 + n]):
            return None
        pos += 12 + n
        if kind == b"IEND":
            return pos - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scan = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at if scan else None
        if 0xD0 <= mark <= 0xD7 or mark == 0x01:
            pos += 2
            continue
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:  # entropy-coded bytes up to the next marker that is neither stuffed nor a restart
            scan = True
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return None
    if b[pos : pos + 2] == b"\xff\xd9" and scan:
        return pos + 2 - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 14:
        return None
    flags, pos = b[at + 10], at + 13
    pos += 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
            pos = blocks(pos + 1)
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 26:
        return None
    size, spare, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if spare == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size <= len(b) - at else None


class Payload:
    """A payload, with what validators look for again and again found once: marks of ends, and where streams lead."""

    def __init__(self, b: bytes):
        self.b = b
        self.places: dict[bytes, list[int]] = {}
        self.archives: dict[int, int] | None = None
        self.streams: dict[int, int | None] = {}
        self.pages: dict[int, int | None] = {}

    def next(self, mark: bytes, at: int) -> int:
        """The first place of mark from at on, or the payload's length."""
        if mark not in self.places:
            self.places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.b)]
        k = bisect.bisect_left(self.places[mark], at)
        return self.places[mark][k] if k < len(self.places[mark]) else len(self.b)


def _pdf(p: Payload, at: int) -> int | None:
    b = p.b
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    end = p.next(b"%%EOF", at)
    return end + 5 - at if p.next(b"startxref", at) < end < len(b) else None


def _zip(p: Payload, at: int) -> int | None:
    """Every end record says where its archive begins."""
    if p.archives is None:
        p.archives, b = {}, p.b
        for m in re.finditer(b"PK\x05\x06", b):
            end = m.start()
            if end + 22 > len(b):
                break
            size, start, note = struct.unpack_from("<IIH", b, end + 12)
            first = end - size - start
            if first >= 0 and b[end - size : end - size + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
                p.archives.setdefault(first, end + 22 + note)
    return p.archives[at] - at if at in p.archives else None


def _gzip(p: Payload, at: int) -> int | None:
    b, pos = p.b, at + 10
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    flags = b[at + 3]
    if flags & 4:
        pos += 2 + int.from_bytes(b[pos : pos + 2], "little")
    for flag in (8, 16):  # name and comment end with a zero byte
        if flags & flag:
            pos = p.next(b"\0", pos) + 1
            if pos > len(b):
                return None
    if flags & 2:
        if b[pos : pos + 2] != (zlib.crc32(memoryview(b)[at:pos]) & 0xFFFF).to_bytes(2, "little"):
            return None
        pos += 2
    if pos not in p.streams:
        p.streams[pos] = _deflated(b, pos)
    end = p.streams[pos]
    return end - at if end else None


def _deflated(b: bytes, at: int) -> int | None:
    """Where a deflate stream with its trailer ends, if the trailer agrees."""
    d, view, pos, crc, size = zlib.decompressobj(-15), memoryview(b), at, 0, 0
    try:
        while not d.eof and pos < len(b):
            part = view[pos : pos + (1 << 14)]
            out = d.decompress(part, 1 << 20)
            pos += len(part) - len(d.unconsumed_tail) - len(d.unused_data)
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return None
    return pos + 8 if d.eof and b[pos : pos + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else None


def _flac(b: bytes, at: int) -> int | None:
    pos = at + 4
    first = True
    while pos + 4 <= len(b):
        kind, n = b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind != 0 or n != 34):
            return None
        first = False
        last = b[pos] & 0x80
        pos += 4 + n
        if last:
            return len(b) - at if pos <= len(b) else None
    return None


def _ogg(p: Payload, at: int) -> int | None:
    """Pages up to one that is the last; each page is gone through once, however many hits lead to it."""
    b, pos, chain, end = p.b, at, [], None
    while pos not in p.pages:
        if pos + 27 > len(b) or b[pos : pos + 4] != b"OggS" or b[pos + 4] != 0:
            break
        chain.append(pos)
        n = b[pos + 26]
        behind = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if behind > len(b):
            break
        if b[pos + 5] & 4:
            end = behind
            break
        pos = behind
    else:
        end = p.pages[pos]
    p.pages.update(dict.fromkeys(chain, end))
    return end - at if end else None


def _mp4(b: bytes, at: int) -> int | None:
    pos, names = at, []
    while pos + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if n < 8 or pos + n > len(b) or not kind.isalnum():
            break
        names.append(kind)
        pos += n
    return pos - at if names[:1] == [b"ftyp"] and len(names) > 1 else None


def _alone(check: Callable[[bytes, int], int | None]) -> Callable[[Payload, int], int | None]:
    return lambda p, at: check(p.b, at)


#: Media type, magic bytes, offset of the magic within the format, validator.
FORMATS: list[tuple[str, bytes, int, Callable[[Payload, int], int | None]]] = [
    ("audio/wav", b"RIFF", 0, _alone(_riff(b"WAVE"))),
    ("image/webp", b"RIFF", 0, _alone(_riff(b"WEBP"))),
    ("video/avi", b"RIFF", 0, _alone(_riff(b"AVI "))),
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _alone(_png)),
    ("image/jpeg", b"\xff\xd8\xff", 0, _alone(_jpeg)),
    ("image/gif", b"GIF87a", 0, _alone(_gif)),
    ("image/gif", b"GIF89a", 0, _alone(_gif)),
    ("image/bmp", b"BM", 0, _alone(_bmp)),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _gzip),
    ("audio/flac", b"fLaC", 0, _alone(_flac)),
    ("audio/ogg", b"OggS", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _alone(_mp4)),
]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}
    for kind, magic, back, check in FORMATS:
        found.setdefault(magic.decode("latin-1"), []).append((kind, len(magic) - 1 + back, check))
    a = ahocorasick.Automaton()
    for key, entries in found.items():
        a.add_word(key, entries)
    a.make_automaton()
    return a


def sniff(payload: bytes) -> list[tuple[str, int, int]]:
    """The confirmed media as (type, offset, length), by offset; none lies inside another."""
    places = [(end - back, kind, check) for end, entries in _automaton().iter(payload.decode("latin-1")) for kind, back, check in entries if end >= back]
    out, free, p = [], 0, Payload(payload)
    for at, same in itertools.groupby(sorted(places, key=lambda x: x[0]), key=lambda x: x[0]):
        if at >= free and (hits := [(-n, kind) for _, kind, check in same if (n := check(p, at))]):
            n, kind = min(hits)
            out.append((kind, at, -n))
            free = at - n
    return out


def wav_store(payload: bytes, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file whose 8-bit mono samples are the payload's bytes."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def wav_samples(media: bytes) -> bytes:
    """The bytes of the data chunk."""
    pos = 12
    while pos + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, pos)
        if name == b"data":
            return media[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def sniff_column(df: DataFrame, payload: str, declared: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, declared, media_type, corrected, valid, carved array<struct<type, offset, length, bytes>>) of a binary column."""
    src = df.select(F.col(id_col).alias("id"), F.col(payload).cast("binary").alias("text"), (F.col(declared) if declared else F.lit(None)).cast("string").alias("declared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            said, rows = batch.column("declared").to_pylist(), []
            for raw, was in zip(utf8(batch.column("text")), said, strict=True):
                found = sniff(raw)
                kind = found[0][0] if found and found[0][1] == 0 else None
                rows.append((kind or was, kind is not None and kind != was, kind is not None, [{"type": k, "offset": a, "length": n, "bytes": raw[a : a + n]} for k, a, n in found if a]))
            kind_of = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.bool_(), kind_of)))], names=["id", "declared", "media_type", "corrected", "valid", "carved"])

    kind = src.schema["id"].dataType.simpleString()
    return mapped(src, run, f"id {kind}, declared string, media_type string, corrected boolean, valid boolean, carved array<struct<type:string,offset:bigint,length:bigint,bytes:binary>>").withColumnRenamed("id", id_col)


def _features(media: bytes) -> tuple[bytes, str]:
    """The stored payload read back, and a feature string of what the stored bytes are and hold."""
    found = sniff(media)
    kind, _, n = found[0] if found and found[0][1] == 0 else ("application/octet-stream", 0, len(media))
    samples = wav_samples(media)
    inner = [(k, a, m) for k, a, m in sniff(samples)]
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    mean = float(counts @ np.arange(256)) / max(1, len(samples))
    return samples, f"{kind};length={n};levels={int((counts > 0).sum())};mean={mean:.3f};embedded={'+'.join(f'{k}@{a}:{m}' for k, a, m in inner) or '-'}"


def store_and_sniff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's padded UTF-8 as 8-bit samples declared as raw bytes; sniff, correct, read back and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for raw in utf8(batch.column("text")):
                payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
                media = wav_store(payload)
                back, feature = _features(media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return mapped(src, run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
