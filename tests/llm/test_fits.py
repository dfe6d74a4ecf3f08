"""The ordinal fit against the likelihood itself, ties of labels, and validators on hostile bytes."""

import gzip
import time

import numpy as np

from holdlens.llm import media, toxicity


def _objective(free, rows, columns, values, grade, n_columns, k):
    """Mean log likelihood less the penalty, written from the model's definition."""
    theta = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:k]))))
    w = free[k:]
    x = np.zeros((len(grade), n_columns))
    np.add.at(x, (rows, columns), values)
    below = 1 / (1 + np.exp(-(theta[None] - (x @ w)[:, None])))
    below = np.column_stack((np.zeros(len(grade)), below, np.ones(len(grade))))
    p = below[np.arange(len(grade)), grade + 1] - below[np.arange(len(grade)), grade]
    return np.log(p).mean() - toxicity.RIDGE * (w @ w) / 2


def test_ordinal_fit_is_an_optimum():
    rng = np.random.default_rng(7)
    n, m, k = 600, 6, 3
    x = rng.poisson(0.7, (n, m)) * 1.0
    score = x @ np.array([1.5, -1.0, 0.5, 0.0, 0.8, -0.3]) + rng.logistic(size=n)
    grade = np.searchsorted([0.5, 1.5, 3.0], score)
    rows, columns = np.nonzero(x)
    weights, thresholds = toxicity.fit_ordinal(rows, columns, x[rows, columns], grade, m)
    assert np.allclose(weights, [1.5, -1.0, 0.5, 0.0, 0.8, -0.3], atol=0.35) and (np.diff(thresholds) > 0).all()
    free = np.concatenate(([thresholds[0]], np.log(np.diff(thresholds)), weights))
    at = lambda f: _objective(f, rows, columns, x[rows, columns], grade, m, k)
    slope = [(at(free + h) - at(free - h)) / 2e-5 for h in np.eye(len(free)) * 1e-5]
    assert np.abs(slope).max() < 2e-3
    best = max(at(free + rng.normal(size=len(free)) * s) for s in (0.003, 0.01, 0.03, 0.1) for _ in range(300))
    assert best < at(free) + 1e-5


def test_equal_texts_with_other_labels_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"{'bad words here' if i % 3 == 0 else 'good words there'} n{i % 40}") for i in range(600)] + [(900 + i, "the same text") for i in range(4)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 5 if i % 3 == 0 else 0) for i in range(600)] + [(900, 0), (901, 1), (902, 0), (903, None), (None, 1)], "doc_id long, toxic int")
    first, second = (toxicity.train(docs.orderBy(o), labels) for o in ("doc_id", toxicity.F.desc("doc_id")))
    assert np.array_equal(first.vocabulary, second.vocabulary) and np.allclose(first.weights, second.weights, atol=1e-6)
    got = {r.doc_id: r.toxic for r in toxicity.grade_toxicity(docs, first).collect()}
    assert all(got[i] == (i % 3 == 0) for i in range(600))


def test_validators_take_linear_time():
    search, began = media.automaton(), time.time()
    for text in (b"%PDF-1.4 no end ", b"PK\x03\x04 no end ", b"\xff\xd8\xff\xda\x00\x02 no end ", b"\x1f\x8b\x08 no end "):
        assert media.carve(text * 60_000, search) == []
    assert time.time() - began < 20
    blob = gzip.compress(bytes(range(256)) * 4000)
    assert media.carve(b"x" + blob + b"tail", search)[0][:2] == (1, len(blob))


def test_boxes_are_walked_once():
    """A megabyte of boxes, each of which could begin a file, and boxes inside others."""
    search = media.automaton()
    box = lambda kind, body=b"": (8 + len(body)).to_bytes(4, "big") + kind + body
    began = time.time()
    assert media.carve(box(b"ftyp") * 130_000, search) == []
    many = media.carve(box(b"ftyp") * 20_000 + box(b"moov"), search)
    assert time.time() - began < 10
    assert [(a, n) for a, n, _ in many] == [(8 * i, 8 * (20_000 - i) + 8) for i in range(20_000)]
    inner = box(b"ftyp", b"isom") + box(b"moov", b"x")
    blob = b"junk" + box(b"ftyp", b"mp42") + box(b"mdat", inner) + box(b"moov") + b"\0"
    assert [(a, n) for a, n, k in media.carve(blob, search)] == [(4, len(blob) - 5), (4 + 12 + 8, len(inner) + 8)]  # the run goes on behind its box


def test_carved_bytes_are_no_more_than_the_media(spark):
    blob = (b"%PDF-1 " * 3000) + b"startxref 1 %%EOF" + b"fLaC" * 500
    row = media.sniff(spark.createDataFrame([(1, bytearray(blob), "a/b")], "id long, media binary, declared string")).first()
    assert len(row.carved) > 1000 and sum(len(x.bytes) for x in row.carved if x.bytes is not None) <= len(blob)
