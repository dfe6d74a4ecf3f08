"""Ranked search against a plain version, and what sharing saves."""

import math
import re
from collections import Counter

import numpy as np

from holdlens.llm.search import Plan, accumulate, search, share

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_all = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k, None if z else i, -s) for k, (s, z, i) in enumerate(sorted(found)[:top], 1)]
    return out


def compare(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, terms string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in search(d, b, **options).collect()]
    assert sorted(got, key=str) == sorted(plain(docs, items), key=str)


def test_ranks_ties_nulls_and_repeats(spark):
    docs = [(7, "the cat sat"), (3, "the cat sat"), (3, "the cat sat"), (None, "the cat sat"), (5, None), (6, ""), (8, "!!"), (9, "THE Élan élan " * 20_000), (10, "a b c d e f g")]
    docs += [(100 + i, "the dog " * (i % 5 + 1) + "x" * (i % 3)) for i in range(30)]
    items = [(1, "The cat"), (2, "dog the"), (2, "x xx"), (3, None), (4, "unknown"), (None, "Élan a"), (5, "c d e f g the cat dog"), (6, "the cat dog"), (7, "")]
    compare(spark, docs, items)
    compare(spark, docs, items, block_terms=3)


def test_empty_tables(spark):
    compare(spark, [], [(1, "a")])
    compare(spark, [(1, "a")], [])
    compare(spark, [(1, None)], [(1, "a")])


def test_shared_sets_are_made_once():
    rng = np.random.default_rng(0)
    queries = [sorted({0, 1, 2, 3, *(int(x) for x in rng.integers(0, 60, 12))}) for _ in range(80)]
    plan = share(queries, 60)
    x = rng.integers(0, 1000, (60, 50))
    assert (accumulate(plan, x) == np.array([x[q].sum(0) for q in queries])).all()
    work = len(plan.pairs) + sum(len(q) for q in plan.queries)
    assert work < 0.8 * sum(len(q) for q in queries)
    # equal queries are one symbol, whatever their length
    same = share([[4, 5, 6, 7, 8]] * 9, 10)
    assert all(len(q) == 1 for q in same.queries) and len(same.pairs) == 4
    assert share([[], [1]], 2) == Plan(2, [], [[], [1]])
