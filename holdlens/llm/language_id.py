"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of an n-gram is the product
of its letters' vectors, each rotated by its place; a text's vector is the sum of
those of its n-grams, and a language's prototype the sum of its training texts'
vectors of length 1. A text gets the language whose prototype has the largest cosine.
Non-letters count as one space between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Components of the vectors, letters of an n-gram, characters worked on at once.
DIMENSIONS, N, STEP_CHARS = 1024, 3, 1 << 19
#: Kinds of n-grams whose vectors are held at once.
KINDS = 4096
#: Possible n-grams that are counted in a table; of larger alphabets they are sorted.
FEW_VALUES = 1 << 22
#: Texts are told apart from noise by the cosines of labelled texts of like length: this quantile, and what part of it must be reached.
QUANTILE, PART = 0.001, 0.75
#: Labelled texts that a length needs to have a bound of its own, and deviations of the cosine of unlike vectors that are noise at any length.
LEAST_TEXTS, DEVIATIONS = 20, 3.5
#: A prototype is a sum of whole numbers, so it doesn't depend on the order of its texts.
SCALE = 1 << 20

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def _vectors(codes: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), DIMENSIONS), np.float32)
    for i, c in enumerate(codes):
        out[i] = np.random.default_rng([int(c), 9]).integers(0, 2, DIMENSIONS) * 2 - 1
    return out


def _steps(texts: list[str | None]):
    """Rows of texts of about STEP_CHARS characters, and the characters of each text."""
    rows, chars, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        x = np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32)
        rows.append(i)
        chars.append(x)
        size += len(x)
        if size >= STEP_CHARS:
            yield rows, chars
            rows, chars, size = [], [], 0
    if rows:
        yield rows, chars


def _numbered(gram: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values below ``most``, sorted, and the place of each value among them; few possible ones are counted, not sorted."""
    if most > FEW_VALUES:
        return np.unique(gram, return_inverse=True)
    seen = np.zeros(most, bool)
    seen[gram] = True
    kinds = np.flatnonzero(seen)
    place = np.empty(most, np.int64)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[gram]


def text_vectors(texts: list[str | None]):
    """Yields (rows, their vectors as whole numbers in float64); texts without a letter are left out."""
    for rows, v, _ in _vectors_and_sizes(texts):
        yield rows, v


def _vectors_and_sizes(texts: list[str | None]):
    """The same with the texts' numbers of n-grams."""
    letter = _letters()
    for rows, chars in _steps(texts):
        ends = np.cumsum([len(x) + 1 for x in chars])
        stream = np.full(int(ends[-1]) + 1, 32, np.uint32)
        for x, e in zip(chars, ends, strict=True):
            stream[e - len(x) : e] = x
        is_letter = letter[stream]
        stream[~is_letter] = 32
        text = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=-1))
        keep = is_letter | np.concatenate(([True], is_letter[:-1]))  # one space after each word
        stream, is_letter, text = stream[keep], is_letter[keep], text[keep]
        has = np.bincount(text[is_letter], minlength=len(rows)) > 0
        alphabet = np.unique(stream)
        code = np.searchsorted(alphabet, stream)
        a = len(alphabet)
        base = _vectors(alphabet)
        # an n-gram belongs to the text of its middle letter; a space between texts is shared
        width = len(code) - N + 1
        if width < 1:
            continue
        gram, middle = np.zeros(width, np.int64), text[N // 2 : N // 2 + width]
        for j in range(N):
            gram = gram * a + code[j : j + width]
        # one that goes on into the next text is no text's
        within = middle == text[N - 1 : N - 1 + width]
        gram, middle = gram[within], middle[within]
        if not len(gram):
            continue
        kinds, kind = _numbered(gram, a**N)
        made, sizes = np.zeros((len(rows), DIMENSIONS), np.float32), np.bincount(middle, minlength=len(rows))
        rolled = [np.roll(base, j, axis=1) for j in range(N)]
        for k in range(0, len(kinds), KINDS):
            rest = kinds[k : k + KINDS]
            vectors, width = rolled[0][rest % a], len(rest)
            for j in range(1, N):
                rest = rest // a
                vectors *= rolled[j][rest % a]
            here, of = middle, kind
            if width < len(kinds):
                mine = (kind >= k) & (kind < k + width)
                here, of = middle[mine], kind[mine] - k
            # texts stand in order, so the n-grams of some of them are one range
            step = max(1, (1 << 20) // width)
            for s in range(0, len(rows), step):
                n = min(step, len(rows) - s)
                first, last = np.searchsorted(here, [s, s + n])
                counts = np.bincount((here[first:last] - s) * width + of[first:last], minlength=n * width).reshape(n, width)
                made[s : s + n] += counts.astype(np.float32) @ vectors
        at = np.flatnonzero(has)
        if len(at):
            yield [rows[i] for i in at], made[at].astype(np.float64), sizes[at]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def prototypes(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototype of each non-null ``lang`` of ``labelled(text, lang)``, from all its rows.

    A few partial sums a task meet in a groupBy; the driver gets DIMENSIONS numbers a language.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for rows, v in text_vectors(batch.column("text").to_pylist()):
                whole = np.rint(_unit(v) * SCALE).astype(np.int64)
                for i, x in zip(rows, whole, strict=True):
                    if langs[i] in sums:
                        sums[langs[i]] += x
                    else:
                        sums[langs[i]] = x.copy()
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "part"])

    parts = labelled.where("lang is not null").select(F.col("text").cast("string"), "lang").mapInArrow(run, "lang string, part array<long>")
    sums = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).collect()
    return {r.lang: np.array([x.x for x in r.v], np.float64) for r in rows}


def _predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``grams``, the number of n-grams; ``docs`` has none of these names."""
    names = sorted(profiles)
    target = _unit(np.stack([profiles[x] for x in names])).T if names else None

    def run(batches):
        for batch in batches:
            pred, score, grams = ["und"] * batch.num_rows, [0.0] * batch.num_rows, [0] * batch.num_rows
            for rows, v, sizes in _vectors_and_sizes(batch.column("text").to_pylist()) if names else ():
                cosine = np.round(_unit(v) @ target, 9)
                for i, best, x, n in zip(rows, cosine.argmax(1), cosine.max(1), sizes.tolist(), strict=True):
                    pred[i], score[i], grams[i] = names[best], min(1.0, max(0.0, float(x))), n
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(grams, pa.int64())], [*batch.schema.names, "lang_pred", "score", "grams"])

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("grams", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *made]))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with it, 0 at least.

    A null text, one without a letter, and all texts if nothing was learned: ``und`` and 0. Of equal
    cosines the first language in the alphabet wins. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    made = _predict(docs.select(row, F.col("text").cast("string").alias("text")), profiles)
    return made.select(*(F.col(f"row.`{c}`") for c in kept), "lang_pred", "score")


def is_held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each row; learned from rows with lang that aren't held out."""
    profiles = prototypes(docs.where(~is_held_out()).select("text", "lang"))
    out = docs.select("doc_id", is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict_language(out, profiles).select("doc_id", "held_out", "lang_pred", "score")


def _length():
    """Power of two of a text's n-grams."""
    return F.floor(F.log2(F.greatest("grams", F.lit(1)))).cast("int").alias("length")


def least_cosines(labelled: DataFrame, profiles: dict[str, np.ndarray]) -> list[float]:
    """For each power of two of n-grams, the cosine that a text of that length must have.

    PART of a low quantile of the cosines of labelled texts that get their own language; a length with few such
    texts has the next shorter one's bound, and none is below what unlike vectors reach by chance.
    """
    known = _predict(labelled.where("lang is not null").select(F.col("text").cast("string").alias("text"), "lang"), profiles).where("lang_pred = lang")
    rows = known.groupBy(_length()).agg(F.percentile_approx("score", QUANTILE, 10000).alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS).collect()  # a row for each length
    low, noise = {r.length: r.low for r in rows}, DEVIATIONS / DIMENSIONS**0.5
    out = [noise]
    for length in range(64):
        out.append(max(noise, PART * low[length]) if length in low else out[-1])
    return out[1:]


def keep_identified(docs: DataFrame, least: float | None = None) -> DataFrame:
    """Rows of ``docs(text, lang, doc_id, ...)`` whose text is in a learned language; the columns stay.

    Its cosine is ``least`` or more, by default what ``least_cosines`` asks of its length. Without labelled rows nothing is kept.
    """
    learned = docs.where(~is_held_out()).select("text", "lang")
    profiles = prototypes(learned)
    bounds = [least] * 64 if least is not None else least_cosines(learned, profiles)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    made = _predict(docs.select(row, F.col("text").cast("string").alias("text")), profiles)
    bound = F.element_at(F.array(*(F.lit(float(x)) for x in bounds)), _length() + 1)
    return made.where((F.col("lang_pred") != "und") & (F.col("score") >= bound)).select("row.*")
