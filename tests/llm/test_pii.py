"""Base spans against the plain patterns, messages against enumeration, and labels that travel between repeated tokens."""

import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdlens.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def checksum(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")) or kind == 2 and not (14 <= len(digits) <= 19 and checksum(digits)) or kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=600, deadline=None)
@given(st.one_of(
    st.text("01259.- +()@ab\n", max_size=60),
    st.lists(st.sampled_from(["a.b@c.de", "@", "x@y", ".", "1.2.3.4", "001.255.256.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", " ", "é", "　", "12345678901234567890", "-", "9"]), max_size=12).map("".join),
))
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("unit", ["1", "1.", "a", "@", "a@", "+", "+1", "+1 ", "1 ", "a.", "1.1.1.", "@a.", "-", " ", "1-", "12 34 ", "x9 "])
def test_time_grows_with_the_text(unit):
    text = unit * (400_000 // len(unit))
    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 4
    list(pii.tokens(text))
    assert time.time() - began < 25


def test_tokens_cover_every_digit_and_at_sign():
    text = "a1 (b) \n　2@c, x\t+1 (743) 555-3824!"
    found = list(pii.tokens(text))
    assert [text[t.start : t.end] for t in found] == ["a1", "2@c", "+1", "743", "555-3824"]
    assert [t.near for t in found] == [False, False, False, True, True]


def exact(unary, edges, pairs):
    """Marginals by enumeration."""
    n, out = len(unary), np.zeros_like(unary)
    for labels in itertools.product(range(pii.LABELS), repeat=n):
        p = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(pairs[k, labels[i], labels[j]] for i, j, k in edges))
        for i, x in enumerate(labels):
            out[i, x] += p
    return out / out.sum(1, keepdims=True)


def test_messages_are_exact_on_trees_and_near_on_loops():
    rng = np.random.default_rng(4)
    unary, pairs = rng.normal(size=(5, pii.LABELS)), rng.normal(size=(3, pii.LABELS, pii.LABELS))
    tree = np.array([(0, 1, 0), (1, 2, 1), (1, 3, 2), (0, 4, 0)])
    assert np.abs(pii.marginals(unary, tree, pairs) - exact(unary, tree, pairs)).max() < 1e-3
    loop = np.array([(0, 1, 0), (1, 2, 1), (0, 2, 2), (3, 4, 0)])
    assert np.abs(pii.marginals(unary, loop, pairs / 3) - exact(unary, loop, pairs / 3)).max() < 0.02
    assert np.allclose(pii.marginals(unary, np.zeros((0, 3), np.int64), pairs).sum(1), 1)


def test_the_fit_follows_its_gradient():
    """A fit by pseudo-likelihood is where no weight can gain: its gradient is next to nothing."""
    features = [["a"], ["b"], ["a"], ["b"], ["a", "b"]] * 4
    labels = np.array([0, 4, 0, 4, 1] * 4)
    edges = np.array([(5 * i, 5 * i + 2, pii.SAME) for i in range(4)])
    field = pii.fit_field(features, labels, edges, steps=3000)

    def objective(w, p):
        mean = np.stack([np.zeros((pii.LABELS, pii.LABELS)), *[pii.AGREEMENT * np.eye(pii.LABELS)] * 2])
        total = -0.5 * ((w**2).sum() + ((p - mean) ** 2).sum())
        for i, fs in enumerate(features):
            s = sum(w[field.features[f]] for f in fs)
            s = s + sum(p[k, :, labels[b]] for a, b, k in edges if a == i) + sum(p[k, labels[a], :] for a, b, k in edges if b == i)
            total += s[labels[i]] - np.log(np.exp(s).sum())
        return total

    best = objective(field.weights, field.pairs)
    rng = np.random.default_rng(1)
    for _ in range(60):
        w, p = rng.normal(size=field.weights.shape), rng.normal(size=field.pairs.shape)
        assert objective(field.weights + 0.01 * w, field.pairs + 0.01 * p) < best + 1e-4


def documents():
    """Numbers that the patterns find, and clean ones."""
    out = []
    for i in range(300):
        a, b = 200 + i, 1000 + 7 * i
        out += [f"call me on +1 ({a}) 555-{b} or mail jo.{i}@mail.example.com today", f"version {i % 9}.{i % 7} has {i} parts in 19{i % 90 + 10}", f"host 10.0.{i % 200}.7 is up, again host 10.0.{i % 200}.7", f"paid with 4111111111111111 at {i % 12}"]
    return out


def test_labels_travel_along_skip_edges(spark):
    texts = documents()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    field = pii.train(docs)
    assert np.trace(field.pairs[pii.SAME]) > 0
    # a number without its sign is no base span; it is found since it ends as one does, far away
    text = "call me on +1 (743) 555-3824 today. " + "Nothing else is here to see. " * 30 + "my number 7435553824 again"
    (base, added), (_, alone) = pii.scan_texts(field, [text, "my number 7435553824 again"])
    assert [k for *_, k in base] == [3]
    assert [(text[a:b], k) for a, b, k in added] == [("7435553824", 3)] and alone == []
    clean = [t for t in texts if not plain(t)]
    assert not any(base or more for base, more in pii.scan_texts(field, clean))


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "x@y.zz " * 20_000, 3), (2, "x@y.zz " * 20_000, 3), (3, "no numbers", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    got = pii.find_personal_data(docs, pii.train(docs)).collect()
    assert sorted((r.n_email for r in got)) == [0, 0, 0, 20_000, 20_000] and len({r.spans for r in got if r.n_email}) == 1
    none = docs.where("doc_id = -1")
    assert pii.find_personal_data(none, pii.train(none)).collect() == []


def test_the_query_on_the_sample(spark):
    from holdlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op12_pii"](spark, sf).collect():
        base = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for *_, k in base) for n in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base} <= set(r.spans.split(","))
        assert r.base_sha256 == pii.sha256(pii.joined(base).encode()).hexdigest()
