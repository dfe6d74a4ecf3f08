"""Hierarchical packing of token ids into sequences of several context sizes.

Each task packs what it reads, so no ids are shuffled. A document is cut into full long windows; its rest is routed to
the shortest context size (tier) that holds it. Tiers are packed from the longest to the shortest: a rest opens a
window of its tier, the gap is filled by the longest rests that fit, of its own tier or a shorter one, and where
none fits one is cut. So windows leave no gap but the last few of a task. Step groups are made over all tasks:
running sums of tokens in each tier, from the tasks' totals, are cut at equal targets.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdlens.llm.cluster import cut
from holdlens.llm.words import span_hashes, steps

TIERS = (2048, 1024, 512, 256)
#: Powers of two that the last tokens of a task are cut into; fewer are padded to the longest tier.
LAST = (*TIERS, 128, 64)
END_ID = 1
#: Tokens of rests that are packed together, and words whose ids a worker remembers.
ROUND_TOKENS, CACHE_WORDS = 1 << 20, 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 64 * 2048

#: Classes of bytes: white space, letters, digits, marks, apostrophe; all others, which are never cut apart.
_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
for _first, _last, _kind in (("A", "Z", _LETTER), ("a", "z", _LETTER), ("0", "9", _DIGIT), ("'", "'", _APOSTROPHE), (" ", " ", _SPACE), ("\t", "\r", _SPACE)):
    _CLASS[ord(_first) : ord(_last) + 1] = _kind
#: Whether a part begins at a byte of the second class after one of the first.
_CUT = np.zeros((6, 6), bool)
_CUT[_SPACE] = True
_CUT[[_LETTER, _DIGIT], _MARK] = _CUT[[_LETTER, _DIGIT], _APOSTROPHE] = True
_CUT[_MARK, _LETTER] = _CUT[_MARK, _DIGIT] = True
_CUT[_DIGIT, _LETTER] = _CUT[_LETTER, _DIGIT] = _CUT[_DIGIT, _DIGIT] = True
_CUT[:, _SPACE] = False


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class Encoder:
    """Ids of whole texts by any tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, followed by END_ID; a null is as an empty text."""
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return [np.array([*x.ids, END_ID], np.uint32) for x in found]


class WordEncoder(Encoder):
    """The same for a tokenizer that lower-cases, drops white space and takes letters, single digits and marks apart.

    A text is cut, by the classes of its bytes, only where the tokenizer cuts it too, so its ids are those of its parts. They are
    remembered by the parts' 64-bit hashes, which don't tell A-Z from a-z. A part of Latin letters or marks is one word of
    the tokenizer's model, which is asked directly. A text that names a special token is encoded in one go.
    """

    #: What ``fits`` asks of a tokenizer.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        super().__init__(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    @staticmethod
    def fits(path: str) -> bool:
        """Whether a tokenizer file says what this class relies on."""
        import json

        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        steps_of = lambda x, key: [y for y in (x or {}).get(key, [x] if x else [])]
        norms, splits = steps_of(t["normalizer"], "normalizers"), steps_of(t["pre_tokenizer"], "pretokenizers")
        spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        return (
            [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1] == spaces and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and splits[0] == {"type": "Split", "pattern": {"Regex": WordEncoder.SPLIT}, "behavior": "Removed", "invert": True}
            and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"] and t["model"]["type"] == "BPE" and not t["model"]["dropout"]
            and all(x["special"] and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) for x in t["added_tokens"])
        )

    def _clear(self):
        self.known, self.start, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _learn(self, hashes: np.ndarray, parts: list[bytes]):
        """Remembers the ids of parts that aren't known; ``hashes`` is sorted."""
        model, got, odd = self.tokenizer.model.tokenize, [], []
        for i, p in enumerate(parts):
            if p.isalpha():  # ASCII letters
                got.append([t.id for t in model(p.decode().lower())])
                continue
            word = p.decode()
            if word.isalpha() and max(word) <= "\xff":
                got.append([t.id for t in model("".join(map(_BYTE_LETTERS.__getitem__, word.lower().encode())))])
            else:
                odd.append(i)
                got.append([])
        for i, x in zip(odd, self.tokenizer.encode_batch_fast([parts[i].decode() for i in odd], add_special_tokens=False), strict=True):
            got[i] = x.ids
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
        at = np.searchsorted(self.known, hashes)
        self.start = np.insert(self.start, at, self.used + np.cumsum(lengths) - lengths)
        self.length = np.insert(self.length, at, lengths)
        self.known = np.insert(self.known, at, hashes)
        self.used += total

    def _places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where each part's ids are remembered."""
        kinds, first, kind = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        missing = self._missing(kinds)
        if len(missing):
            if len(self.known) + len(missing) > CACHE_WORDS:
                self._clear()
                missing = np.arange(len(kinds))
            raw = data.tobytes()
            self._learn(kinds[missing], [raw[start[i] : end[i]] for i in first[missing].tolist()])
        return np.searchsorted(self.known, kinds)[kind]

    def _missing(self, kinds: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.arange(len(kinds))
        at = np.minimum(np.searchsorted(self.known, kinds), len(self.known) - 1)
        return np.flatnonzero(self.known[at] != kinds)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b, data, offsets in steps(texts):
            kind = _CLASS[data]
            inside = kind != _SPACE
            opens = inside.copy()
            opens[1:] &= _CUT[kind[:-1], kind[1:]]
            start = np.flatnonzero(opens)
            closes = inside.copy()
            closes[:-1] &= opens[1:] | ~inside[1:]
            end = np.flatnonzero(closes) + 1
            ids, ends = np.empty(0, np.uint32), np.empty(0, np.int64)
            if len(start):
                at = self._places(data, start, end)
                lengths = self.length[at]
                ends = np.cumsum(lengths)
                ids = self.flat[np.repeat(self.start[at] - ends + lengths, lengths) + np.arange(int(ends[-1]))]
            cuts = np.concatenate(([0], ends))[np.searchsorted(start, offsets)]
            out += [np.append(ids[s:e], np.uint32(END_ID)) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            if self._names_special(data):
                for i in range(a, b):
                    if texts[i].is_valid and self._names_special(texts[i].as_py().encode()):
                        out[i] = np.array([*self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, END_ID], np.uint32)
        return out

    def _names_special(self, data) -> bool:
        raw = bytes(data)
        return any(x in raw for x in self.special)


class Packer:
    """Takes documents' ids and makes rows of pieces; ``base`` keeps tasks' sequence numbers apart."""

    def __init__(self, base: int):
        #: by tier: (tokens, order, doc_id, start, ids, doc_tokens), sorted
        self.rests: dict[int, list[tuple[int, int, object, int, np.ndarray, int]]] = {t: [] for t in TIERS}
        self.tokens, self.order, self.sequence = 0, 0, base
        self.full: list[tuple[int, list]] = []
        self.done = dict.fromkeys(LAST, 0)
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray):
        whole = len(ids) // TIERS[0] * TIERS[0]
        for s in range(0, whole, TIERS[0]):
            self.full.append((TIERS[0], [(doc_id, s, ids[s : s + TIERS[0]], len(ids))]))
        if whole < len(ids):
            self._route(doc_id, whole, ids[whole:], len(ids))
        if self.tokens >= ROUND_TOKENS or len(self.full) >= ROUND_TOKENS // TIERS[0]:
            self._pack()
            self._emit()

    def _route(self, doc_id, start, ids, doc_tokens):
        """Puts a rest into the shortest tier that holds it."""
        self.order += 1
        tier = min(t for t in TIERS if t >= len(ids))
        insort(self.rests[tier], (len(ids), self.order, doc_id, start, ids, doc_tokens), key=lambda r: r[:2])
        self.tokens += len(ids)

    def _pop(self, tier: int, i: int):
        r = self.rests[tier].pop(i)
        self.tokens -= r[0]
        return r[2:]

    def _fitting(self, gap: int):
        """The longest rest of at most ``gap`` tokens, from the longest tier that has one; else the shortest of all."""
        for tier in TIERS:
            i = bisect_right(self.rests[tier], gap, key=lambda r: r[0]) - 1
            if i >= 0:
                return self._pop(tier, i)
        return self._pop(next(t for t in reversed(TIERS) if self.rests[t]), 0)

    def _fill(self, size: int, window: list) -> int:
        """Puts rests into ``window`` until it has ``size`` tokens; gives what is still free."""
        gap = size - sum(len(p[2]) for p in window)
        while gap and self.tokens:
            doc_id, start, ids, doc_tokens = self._fitting(gap)
            if len(ids) > gap:
                self._route(doc_id, start + gap, ids[gap:], doc_tokens)
                ids = ids[:gap]
            window.append((doc_id, start, ids, doc_tokens))
            gap -= len(ids)
        return gap

    def _pack(self):
        """Packs each tier, the longest first; what can't fill a window waits for more."""
        for tier in TIERS:
            while self.rests[tier]:
                window = [self._pop(tier, -1)]
                if self._fill(tier, window):
                    for p in window:
                        self._route(*p)
                    return
                self.full.append((tier, window))

    def _emit(self):
        for size, window in self.full:
            offset = 0
            for doc_id, start, ids, doc_tokens in window:
                self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, self.sequence, offset, size, self.done[size]))
                offset += len(ids)
            self.sequence += 1
            self.done[size] += size
        self.full = []

    def end(self):
        self._pack()
        while self.tokens:
            size = next((t for t in LAST if t <= self.tokens), TIERS[0])
            window: list = []
            self._fill(size, window)
            self.full.append((size, window))
        self._emit()


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "before"]
TASK_BITS = 33


def pack(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of a document of ``docs(doc_id, text)``.

    ``start``: the document's ids before the piece; ``ids_crc32``: of its ids as little-endian 32-bit numbers;
    ``doc_tokens``: the document's ids with END_ID; ``offset``: the sequence's ids before the piece; ``window``: the
    sequence's length with padding, which only a task's last sequence may have. A null or empty text has
    END_ID alone. Each row is packed, also where ids are null or repeat. Other columns are not read. ``tokenizer``: a file of the
    ``tokenizers`` library that is read by each executor.
    ``step_group``: sequences of one window size from any tasks, together STEP_TOKENS long but for each size's last group.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        encoder, packer = _encoder(path), Packer(TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            texts = batch.column("text")
            for a, b, _, _ in steps(texts):
                for doc_id, x in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), encoder.encode(texts.slice(a, b - a)), strict=True):
                    packer.add(doc_id, x)
                if len(packer.rows) > 5000:
                    yield _batch(packer)
        packer.end()
        if packer.rows:
            yield _batch(packer)

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
    return _with_step_groups(cut(made))


def _with_step_groups(pieces: DataFrame) -> DataFrame:
    """Groups of equal tokens by running sums over tasks; a row for each task and size is all that meets."""
    pieces = pieces.withColumn("task", F.shiftright("sequence_id", TASK_BITS))
    totals = pieces.where("offset = 0").groupBy("task", "window").agg(F.sum("window").alias("tokens"))
    earlier = Window.partitionBy("window").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("task", "window", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("in_tasks_before"))
    group = F.floor((F.col("in_tasks_before") + F.col("before")) / STEP_TOKENS)
    # a size's groups are numbered apart from those of others
    place = F.array_position(F.array(*(F.lit(x) for x in LAST)), F.col("window").cast("int")) - 1
    return pieces.join(totals, ["task", "window"]).select(*COLUMNS[:-1], (group * len(LAST) + place).cast("long").alias("step_group"))


def _batch(packer: Packer) -> pa.RecordBatch:
    rows, packer.rows = packer.rows, []
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], COLUMNS)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if WordEncoder.fits(path) else Encoder(path)
    return _encoders[path]
