"""License scanning by ordered signature rules.

Rules (``license_rules``) are hand-written regexes over a text's UTF-8 with A-Z as a-z, in which each run of white space, with the
marks that begin a line of comment, is one space. An Aho-Corasick keyword filter over the same text says which rules can match at all. Detections are taken by
priority, then length; one whose interval lies in that of a detection taken before is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdlens.llm.license_rules import lines
from holdlens.llm.words import ALNUM, spans, steps

#: Phrases of whole words and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    score: float


def rules() -> list[Rule]:
    """By priority; letters and digits don't continue a match."""
    out = []
    for label, priority, score, keyword, pattern in lines():
        whole = rb"(?<![0-9a-z\x80-\xff])(?:" + pattern.encode("latin-1") + rb")(?![0-9a-z\x80-\xff])"
        out.append(Rule(label, keyword.encode(), re.compile(whole), priority, score))
    return sorted(out, key=lambda r: -r.priority)


#: White space other than one blank, with the marks of comment lines.
_GAPS = re.compile(rb"(?:[ \t\x0b\x0c]*[\r\n][ \t\x0b\x0c]*(?:(?:[#*;%!>|]+|//+|/\*+|--+|dnl(?= )|rem(?= ))[ \t]*)*)+|[ \t\x0b\x0c]{2,}|[\t\x0b\x0c]")


def plain_text(low: bytes) -> tuple[bytes, list[int], list[int]]:
    """``low`` with gaps as single spaces, the places there after each gap, and what to add to get the places in ``low``."""
    parts, after, shift, last, gone = [], [], [], 0, 0
    for m in _GAPS.finditer(low):
        parts.append(low[last : m.start()])
        last = m.end()
        gone += last - m.start() - 1
        after.append(last - gone)
        shift.append(gone)
    parts.append(low[last:])
    return b" ".join(parts), after, shift


class _Ends:
    """The greatest end of the intervals taken that start at a place or before it."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.tree = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int):
        i = bisect_left(self.starts, start) + 1
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], end)
            i += i & -i

    def greatest(self, start: int) -> int:
        i, out = bisect_left(self.starts, start) + 1, -1
        while i:
            out = max(out, self.tree[i])
            i -= i & -i
        return out


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.filter = ahocorasick.Automaton()
        for key in dict.fromkeys([r.keyword for r in self.rules]):
            self.filter.add_word(key.decode("latin-1"), key)
        self.filter.make_automaton()

    def detections(self, low: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what is left after suppression; ``low``: bytes with A-Z as a-z."""
        plain, after, shift = plain_text(low)
        present = {key for _, key in self.filter.iter(plain.decode("latin-1"))}
        if not present:
            return []
        found = [(m.start(), m.end(), r) for r in self.rules if r.keyword in present for m in r.pattern.finditer(plain)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        ends, kept = _Ends([x[0] for x in found]), []
        for start, end, rule in found:
            if ends.greatest(start) < end:
                ends.add(start, end)
                kept.append((start, end, rule))
        # the last byte of a match is no gap's, so its place in the text is that of the byte and one more
        at = lambda i: i + (shift[k - 1] if (k := bisect_right(after, i)) else 0)
        return [(at(a), at(b - 1) + 1, r) for a, b, r in kept]


_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BASE = re.compile(b"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(b"(" + _GAP.join(p.encode().split()) + b")" for p in BASE_PHRASES) + b")(?![0-9a-z\x80-\xff])")
_BASE_LABELS = list(BASE_PHRASES.values())


def _base_places(low: bytes) -> list[tuple[int, int]]:
    """(start, number of the phrase) of the base phrases; nothing is looked for where no phrase's rarest word is."""
    if b"reserved" not in low and b"license" not in low and b"cc" not in low:
        return []
    return [(m.start(), m.lastindex) for m in _BASE.finditer(low)]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)`` of each row.

    Words: runs of ASCII letters, digits and non-ASCII characters. n_base: places of the base phrases, counted all;
    first_word, last_word: their first words' numbers from 0, else null; labels: those of base phrases and
    rules, distinct, sorted and joined by commas; score: that of the surest rule left, 0 without one; detections: (label, start, end) in
    bytes. A null text is as an empty one.
    """

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            out, texts = [], batch.column("text")
            for a, b, data, offsets in steps(texts):
                starts, _ = spans(data, ALNUM)
                first = np.searchsorted(starts, offsets)
                for i in range(a, b):
                    low = texts[i].as_buffer().to_pybytes().lower() if texts[i].is_valid else b""
                    places = _base_places(low)
                    base = sorted({_BASE_LABELS[k - 1] for _, k in places})
                    at = [int(np.searchsorted(starts, offsets[i - a] + places[k][0]) - first[i - a]) for k in (0, -1)] if places else [None, None]
                    kept = scanner.detections(low)
                    labels = ",".join(sorted({*base, *(r.label for _, _, r in kept)}))
                    marks = [{"label": r.label, "start": s, "end": e} for s, e, r in sorted(kept, key=lambda x: x[:2])]
                    out.append((int(first[i - a + 1] - first[i - a]), len(places), at[0], at[1], ",".join(base), labels, max((r.score for _, _, r in kept), default=0.0), marks))
            if out:
                span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
                names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long>>"
    )
