"""The registered toxicity query against counts made word by word."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from holdlens.llm import toxicity
from holdlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return Counter(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower))


def test_query_equals_plain_counts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    said = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null and doc_id is not null").collect():
        said[r.doc_id] = max(said.get(r.doc_id, 0), int(r.toxic > 0))
    assert len(said) < toxicity.TRAIN_ROWS  # so that all labelled rows are seen
    of_text = {}
    for doc_id, text in docs:
        if doc_id in said:
            of_text[text] = max(of_text.get(text, 0), said[doc_id])
    rows = [(_words(text), toxic) for text, toxic in of_text.items()]
    n, n_toxic = len(rows), sum(t for _, t in rows)
    df, hits = Counter(w for c, _ in rows for w in c), Counter(w for c, t in rows if t for w in c)
    odds = {}
    for w, k in df.items():
        h, expected = hits[w], k * n_toxic / n
        if k >= toxicity.LEAST_ROWS and (h - expected) ** 2 / (expected * (1 - n_toxic / n)) >= toxicity.LEAST_CHI:
            odds[w] = math.log((h + 0.5) / (n_toxic - h + 0.5)) - math.log((k - h + 0.5) / (n - n_toxic - k + h + 0.5))
    assert 0 < len(odds) <= toxicity.FEATURES
    place = {w: i for i, w in enumerate(sorted(odds))}
    weight = [round(sum(math.log1p(k) for w, k in c.items() if odds.get(w, 0) >= 2), 9) for c, _ in rows]
    cuts = [round(x, 9) for x in np.quantile([s for s, (_, t) in zip(weight, rows, strict=True) if t and s], [1 / 3, 2 / 3])]
    grade = np.array([int(t and (1 + sum(s >= x for x in cuts) if s else 1)) for s, (_, t) in zip(weight, rows, strict=True)])
    cells = [(i, place[w], math.log1p(k)) for i, (c, _) in enumerate(rows) for w, k in c.items() if w in place]
    index, column, value = (np.array(x) for x in zip(*cells, strict=True))
    weights, thresholds = toxicity.fit_ordinal(index, column, value, grade, len(place))
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        score = sum(math.log1p(k) * weights[place[w]] for w, k in _words(text).items() if w in place)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
        p = [b - a for a, b in zip(below, below[1:])]
        assert got[doc_id].expected_severity == pytest.approx(sum(k * x for k, x in enumerate(p)), abs=2e-5)
        assert got[doc_id].p_toxic == pytest.approx(1 - p[0], abs=2e-5)
        if abs(p[0] - 0.5) > 1e-3:
            assert got[doc_id].toxic == (p[0] < 0.5)
