"""Media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton locates magic bytes anywhere in a blob. For each hit a validator of that format checks
structure and lengths; what passes is carved with its offset and length. The blob's type is that of the
longest carved item at its start, whatever was declared.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _u(data: bytes, at: int, size: int, order: str = "little") -> int:
    part = data[at : at + size]
    return int.from_bytes(part, order) if len(part) == size else -1


def _riff(data: bytes, at: int, form: bytes, needed: bytes) -> int:
    """Length of a RIFF file: its chunks fill it and one is ``needed``."""
    size = _u(data, at + 4, 4)
    end = at + 8 + size
    if size < 4 or end > len(data) or data[at + 8 : at + 12] != form:
        return 0
    p, seen = at + 12, False
    while p < end:
        n = _u(data, p + 4, 4)
        if n < 0 or p + 8 + n > end:
            return 0
        seen |= data[p : p + 4] == needed
        p += 8 + n + (n & 1 if p + 8 + n < end else 0)
    return size + 8 if seen and p == end else 0


def wav(data: bytes, at: int) -> int:
    return _riff(data, at, b"WAVE", b"data")


def avi(data: bytes, at: int) -> int:
    return _riff(data, at, b"AVI ", b"LIST")


def png(data: bytes, at: int) -> int:
    p = at + 8
    if data[p + 4 : p + 8] != b"IHDR" or _u(data, p, 4, "big") != 13:
        return 0
    while p + 12 <= len(data):
        n, kind = _u(data, p, 4, "big"), data[p + 4 : p + 8]
        if p + 12 + n > len(data) or zlib.crc32(data[p + 4 : p + 8 + n]) != _u(data, p + 8 + n, 4, "big"):
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def jpeg(data: bytes, at: int, places: Places) -> int:
    p = at + 2
    while p + 4 <= len(data) and data[p] == 0xFF:
        kind, n = data[p + 1], _u(data, p + 2, 2, "big")
        if n < 2 or p + 2 + n > len(data):
            return 0
        p += 2 + n
        if kind == 0xDA:
            end = places.next(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
    return 0


def gif(data: bytes, at: int) -> int:
    if len(data) < at + 14:
        return 0
    flags = data[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(data):
        if data[p] == 0x3B:
            return p + 1 - at
        if data[p] == 0x21:
            p += 2
        elif data[p] == 0x2C and p + 10 <= len(data):
            p += 10 + (3 << ((data[p + 9] & 7) + 1) if data[p + 9] & 0x80 else 0) + 1
        else:
            return 0
        while p < len(data) and data[p]:
            p += data[p] + 1
        p += 1
    return 0


def bmp(data: bytes, at: int) -> int:
    size, pixels, header = _u(data, at + 2, 4), _u(data, at + 10, 4), _u(data, at + 14, 4)
    return size if _u(data, at + 6, 4) == 0 and header in (12, 40, 56, 108, 124) and 14 + header <= pixels <= size <= len(data) - at else 0


class Places:
    """Where markers stand in the bytes in hand, each looked for once however many items ask."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}

    def next(self, marker: bytes, at: int) -> int:
        """The first place of ``marker`` from ``at`` on, or -1."""
        if marker not in self.found:
            self.found[marker] = [m.start() for m in re.finditer(re.escape(marker), self.data)]
        places = self.found[marker]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1


def pdf(data: bytes, at: int, places: Places) -> int:
    end = places.next(b"%%EOF", at + 8)
    return end + 5 - at if data[at + 5 : at + 6].isdigit() and 0 <= places.next(b"startxref", at) < end else 0


def zip_file(data: bytes, at: int, places: Places) -> int:
    end = places.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return 0
    size, start = _u(data, end + 12, 4), _u(data, end + 16, 4)
    return end + 22 + _u(data, end + 20, 2) - at if at + start + size == end else 0


def gzip_file(data: bytes, at: int) -> int:
    reader, p = zlib.decompressobj(31), at
    try:
        while not reader.eof and p < len(data):
            part = data[p : p + (1 << 16)]
            p += len(part)
            reader.decompress(part, 1 << 16)
            while not reader.eof and reader.unconsumed_tail:
                reader.decompress(reader.unconsumed_tail, 1 << 16)
    except zlib.error:
        return 0
    return p - at - len(reader.unused_data) if reader.eof else 0


def flac(data: bytes, at: int) -> int:
    p = at + 4
    while p + 4 <= len(data):
        kind, n = data[p], _u(data, p + 1, 3, "big")
        if p == at + 4 and (kind & 0x7F or n != 34) or p + 4 + n > len(data):
            return 0
        p += 4 + n
        if kind & 0x80:
            return len(data) - at  # frames have no length of their own
    return 0


def ogg(data: bytes, at: int) -> int:
    p = at
    while data[p : p + 4] == b"OggS" and p + 27 <= len(data):
        table = data[p + 27 : p + 27 + data[p + 26]]
        p += 27 + len(table) + sum(table)
    return p - at if at < p <= len(data) else 0


def mp4(data: bytes, at: int, chains: dict[int, tuple[int, bool]]) -> int:
    """``at`` is that of the type in the first box, four bytes into it.

    ``chains`` remembers where the run of boxes from each box ends and whether it has a movie, so that no box is walked twice.
    """
    start = p = at - 4
    walked = []
    while p >= 0 and p not in chains:
        n = _u(data, p, 4, "big") if p + 8 <= len(data) else 0
        if n < 8 or p + n > len(data) or not data[p + 4 : p + 8].isalnum():
            chains[p] = (p, False)
        else:
            walked.append(p)
            p += n
    end, movie = chains.get(p, (p, False))
    for box in reversed(walked):
        movie = movie or data[box + 4 : box + 8] == b"moov"
        chains[box] = (end, movie)
    return end - start if movie else 0


#: Magic bytes, place of the item before them, type, validator.
SIGNATURES = [
    (b"RIFF", 0, "audio/wav", wav),
    (b"RIFF", 0, "video/x-msvideo", avi),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", png),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg),
    (b"GIF87a", 0, "image/gif", gif),
    (b"GIF89a", 0, "image/gif", gif),
    (b"BM", 0, "image/bmp", bmp),
    (b"%PDF-", 0, "application/pdf", pdf),
    (b"PK\x03\x04", 0, "application/zip", zip_file),
    (b"\x1f\x8b\x08", 0, "application/gzip", gzip_file),
    (b"fLaC", 0, "audio/flac", flac),
    (b"OggS", 0, "audio/ogg", ogg),
    (b"ftyp", 4, "video/mp4", mp4),
]
#: Validators that look for a marker further on.
SEEKING = {jpeg, pdf, zip_file}


def automaton() -> ahocorasick.Automaton:
    out, by_magic = ahocorasick.Automaton(), {}
    for magic, before, kind, check in SIGNATURES:
        by_magic.setdefault(magic.decode("latin-1"), []).append((before, kind, check))
    for magic, found in by_magic.items():
        out.add_word(magic, (len(magic), found))
    out.make_automaton()
    return out


def carve(data: bytes, search: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each item that its validator confirms, by offset, the longest first.

    Pages of one Ogg file count once. An item inside another is listed as well.
    """
    found, ogg_end, places, chains = [], 0, Places(data), {}
    for end, (size, kinds) in search.iter(data.decode("latin-1")):
        at = end + 1 - size
        for before, kind, check in kinds:
            if kind == "audio/ogg" and at < ogg_end:
                continue
            length = check(data, at, places) if check in SEEKING else check(data, at, chains) if check is mp4 else check(data, at)
            if length:
                found.append((at - before, length, kind))
                ogg_end = at + length if kind == "audio/ogg" else ogg_end
    return sorted(found, key=lambda x: (x[0], -x[1], x[2]))


def sniff(blobs: DataFrame) -> DataFrame:
    """``blobs(id, media, declared)`` with ``actual`` and ``carved``: arrays of (offset, length, type, bytes).

    actual: the type found at the start, else the declared one; null media: no items. bytes: null for an item that begins within one
    before it (offset and length say where it is), so the carved bytes are never more than the media's. Other columns are not kept.
    """

    def run(batches):
        search = automaton()
        for batch in batches:
            actual, carved = [], []
            for blob, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
                items = carve(blob, search) if blob else []
                actual.append(next((k for at, _, k in items if at == 0), declared))
                upto, listed = 0, []
                for a, n, k in items:
                    listed.append({"offset": a, "length": n, "type": k, "bytes": blob[a : a + n] if a >= upto else None})
                    upto = max(upto, a + n)
                carved.append(listed)
            item = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())])
            yield pa.record_batch([batch.column("id"), batch.column("declared"), pa.array(actual, pa.string()), pa.array(carved, pa.list_(item))], ["id", "declared", "actual", "carved"])

    return blobs.select(F.col("id").cast("long"), F.col("media").cast("binary"), F.col("declared").cast("string")).mapInArrow(
        run, "id long, declared string, actual string, carved array<struct<offset:long,length:long,type:string,bytes:binary>>"
    )


def wav_of(samples: bytes, rate: int = 8000) -> bytes:
    """A mono WAV file of 8-bit samples; their number is even."""
    form = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(samples), b"WAVE") + form + samples


def wav_samples(data: bytes) -> bytes:
    """The samples of the ``data`` chunk of a WAV file."""
    p = 12
    while data[p : p + 4] != b"data":
        n = _u(data, p + 4, 4)
        p += 8 + n + (n & 1)
    return data[p + 8 : p + 8 + _u(data, p + 4, 4)]


#: What the stored media is declared as, for sniffing to correct.
DECLARED = "application/octet-stream"


def text_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of each row.

    The text's UTF-8, filled up with zero bytes to a positive multiple of 64, is stored as a WAV file of 8-bit samples.
    Sniffing finds the type, the carved item is read back, and the columns tell of that.
    feature: declared and actual type, number of carved items, and mean, deviation and entropy of the samples. Null: as empty.
    """

    def run(batches):
        search = automaton()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = wav_of(raw + bytes(-len(raw) % 64 if raw else 64))
                items = carve(media, search)
                at, length, kind = next(x for x in items if x[0] == 0)
                stored = media[at : at + length]
                payload = wav_samples(stored)
                n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                p = n[n > 0] / len(payload)
                mean = (n * np.arange(256)).sum() / len(payload)
                spread = ((n * np.arange(256) ** 2).sum() / len(payload) - mean * mean) ** 0.5
                feature = f"{DECLARED}>{kind};items={len(items)};mean={mean:.3f};deviation={spread:.3f};entropy={-(p * np.log2(p)).sum():.4f}"
                out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            if out:
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
