"""Word hashing over Arrow batches, a few megabytes of text at a time.

All word classes here are classes of UTF-8 bytes, so whole batches are split and
hashed with numpy and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step works on; a longer text is worked on alone.
STEP_BYTES = 1 << 19

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE_CODE[ord("A") : ord("Z") + 1] = _BYTE_CODE[ord("a") : ord("z") + 1]


#: powers of _P and of its inverse, as far as a step usually goes
_POWER = np.cumprod(np.full(STEP_BYTES + 2, _P, np.uint64))
_INVERSE = np.cumprod(np.full(STEP_BYTES + 2, _P_INV, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= len(_POWER):
        return _POWER[:n], _INVERSE[:n]
    return np.cumprod(np.full(n, _P, np.uint64)), np.cumprod(np.full(n, _P_INV, np.uint64))


def byte_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """1 for each byte of a word; ``separators``: closed ranges of the others."""
    table = np.ones(256, np.uint8)
    for a, b in separators:
        table[a : b + 1] = 0
    return table


#: ``[^\\x20\\x09-\\x0D]+``
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each step; a null is empty.

    Each row's bytes end with one added line feed, which ``offsets`` count too.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1)
    a = 0
    while a < n:
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
        part = pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_string())
        line = pa.scalar("\n", pa.large_string())
        joined = pc.binary_join_element_wise(part, line, pa.scalar("", pa.large_string()))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if joined.buffers()[2] else np.empty(0, np.uint8)
        yield a, b, data, offsets - offsets[0]
        a = b


@dataclass
class Words:
    """``hash`` of each word, its first byte and the byte after it; ``rows[i]:rows[i + 1]`` are those of row i."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray


def spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it."""
    inside = table[data].view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """The words of a step; A-Z hash as a-z. Words are also cut at the bytes in ``cuts``, which is sorted."""
    start, end = spans(data, table)
    if cuts is not None and len(cuts) and len(start):
        of = np.maximum(np.searchsorted(start, cuts, side="right") - 1, 0)
        cuts = cuts[(cuts > start[of]) & (cuts < end[of])]
        start, end = np.sort(np.concatenate((start, cuts))), np.sort(np.concatenate((end, cuts)))
    return Words(span_hashes(data, start, end), start, end, np.searchsorted(start, offsets))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span of bytes, in order and apart; A-Z hash as a-z."""
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # whole words, about STEP_BYTES at once
        to = max(at + 1, int(np.searchsorted(end, start[at] + STEP_BYTES, side="right")))
        a, b = int(start[at]), int(end[to - 1])
        power, inverse = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[a:b]] * power[:-1], out=sums[1:])
        s, e = start[at:to] - a, end[at:to] - a
        # the sum from s on, moved back to power 1: divided by P ** s
        hashes[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return hashes


def shingles(words_of_row: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of runs of ``n`` words, sorted; with fewer words, of the whole row."""
    count = len(words_of_row)
    if not count:
        return words_of_row
    n = min(n, count)
    out = np.full(count - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out * _P + words_of_row[j : count - n + 1 + j])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
