"""The manifest against a plain recursive version, and what its proofs catch."""

from hashlib import sha256
from itertools import groupby
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from holdlens.llm.merkle import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place string, digest int"


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def proofs(nodes):
    """The root and each node's sibling runs, one level after another."""
    at, out = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % 3 : p - p % 3 + 3]
            out[i].append((run[: p % 3], run[p % 3 + 1 :]))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], out


def plain(rows, found=lambda r: r[4]):
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    first = lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))
    groups = [sorted(g, key=first) for _, g in groupby(sorted(rows, key=key), key)]
    trees = [proofs([leaf(r, r[4]) for r in g]) for g in groups]
    if not trees:
        return []
    root, upper = proofs([t[0] for t in trees])
    out = []
    for g, (subroot, inner), outer in zip(groups, trees, upper):
        for r, path in zip(g, inner):
            f = leaf(r, found(r))
            for a, b in path + outer:
                f = h("".join([*a, f, *b]))
            out.append((r[0], leaf(r, r[4]), subroot, root, h("".join("".join(a + b) for a, b in path + outer)), f, f == root))
    return out


def compare(spark, rows, found=None, plain_found=lambda r: r[4], **options):
    df = spark.createDataFrame([(*r, "odd", "odd", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in merkle_manifest(df, found, **options).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, plain_found), key=str)
    return got


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_trees_of_all_heights(spark, levels):
    """One superblock, several rounds of them, single leaves, short last runs, many sources."""
    rows = [(i, f"s{s}", "en", i, f"text {s}\n{i}") for s, n in enumerate((1, 2, 3, 4, 9, 10, 28, 40)) for i in range(n)]
    compare(spark, rows, levels=levels)
    compare(spark, rows[:1], levels=levels)
    compare(spark, [(i, f"s{i}", None, None, None) for i in range(5)], levels=levels)


def test_nulls_ties_long_texts_and_repeated_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (None, "b", "x", 1, ""), (3, "", "x", 1, "a"), (3, "", "x", 1, "a"), (3, "", "x", 1, "b"),
        (-7, "é", "x", 2**40, "ü" * 300_000), (12, "z", None, 0, "-"), (11, "z", "-", 0, None), (5, "a", "en", 3, "x\ny"),
    ]
    compare(spark, rows)


def test_an_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_changed_rows_fail(spark):
    rows = [(i, "ab"[i % 2], "en", i, ("one\ntwo" if i % 3 else "one") if i % 5 else None) for i in range(40)]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    found = F.when(odd, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    less = lambda r: r[4] if crc32(str(r[0]).encode()) % 2 or r[4] is None else r[4].replace("\n", "")
    got = compare(spark, rows, found, less)
    assert {r[0] for r in got if not r[6]} == {r[0] for r in rows if less(r) != r[4]}
