"""Tiers, gaps and step groups of packing."""

from collections import defaultdict

import numpy as np
import pytest

from holdlens.llm import packing


def _packed(lengths):
    p = packing.Packer(0)
    for k, n in enumerate(lengths):
        p.add(k, np.arange(n, dtype=np.uint32))
    p.end()
    windows = defaultdict(list)
    for doc_id, start, length, _, _, sequence, offset, size, _ in p.rows:
        windows[sequence, size].append((offset, doc_id, start, length))
    return [(size, [x[1:] for x in sorted(found)]) for (_, size), found in sorted(windows.items())]


@pytest.mark.parametrize("n, tier", [(1, 256), (256, 256), (257, 512), (512, 512), (513, 1024), (1025, 2048)])
def test_a_rest_goes_to_the_shortest_tier_that_holds_it(n, tier):
    p = packing.Packer(0)
    p.add(0, np.arange(2048 + n, dtype=np.uint32))
    assert [size for size, _ in p.full] == [2048]
    assert {t: len(found) for t, found in p.rests.items() if found} == {tier: 1}


def test_gaps_of_long_windows_are_filled_from_shorter_tiers():
    # 1500 opens a long window; its gap of 548 takes the longest that fit: 500, then 48
    assert _packed([1500, 48, 500, 30, 18]) == [(2048, [(0, 0, 1500), (2, 0, 500), (1, 0, 48)]), (2048, [(3, 0, 30), (4, 0, 18)])]
    # where none fits one is cut, and its rest goes on
    sizes = _packed([1500, 700, 900])
    assert sizes[0] == (2048, [(0, 0, 1500), (1, 0, 548)])
    assert sum(x[2] for _, found in sizes[1:] for x in found if x[0] == 1) == 152


def test_windows_hold_all_ids_once_whatever_the_lengths():
    rng = np.random.default_rng(4)
    lengths = [int(x) for x in rng.choice([1, 5, 60, 255, 256, 257, 511, 700, 1024, 1030, 2047, 2048, 2049, 5000], 700)]
    made = _packed(lengths)
    pieces = defaultdict(list)
    for _, found in made:
        for doc_id, start, length in found:
            pieces[doc_id].append((start, length))
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at and length > 0
            at += length
        assert at == n
    short = [size - sum(x[2] for x in found) for size, found in made]
    assert {size for size, _ in made} <= {*packing.LAST} and sum(x > 0 for x in short) <= 1
    assert {size for size, _ in made} >= {2048, 1024, 512, 256}


def test_step_groups_have_equal_tokens_of_one_window_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 2 * 2048)
    docs = spark.createDataFrame([(k, "some words of a text " * (k * 37 % 300 + k % 7 * 40)) for k in range(160)], "doc_id long, text string").repartition(3)
    sequences = packing.pack(docs).where("offset = 0").select("sequence_id", "window", "step_group").collect()
    groups, sizes = defaultdict(int), defaultdict(set)
    for r in sequences:
        groups[r.window, r.step_group] += r.window
        sizes[r.step_group].add(r.window)
    assert all(len(x) == 1 for x in sizes.values()) and len({r.sequence_id >> packing.TASK_BITS for r in sequences}) == 3
    for window in {w for w, _ in groups}:
        totals = [groups[w, g] for w, g in sorted(groups) if w == window]
        assert all(x == 2 * 2048 for x in totals[:-1]) and 0 < totals[-1] <= 2 * 2048
    assert sum(len([g for w, g in groups if w == window]) > 2 for window in (2048, 1024, 512, 256)) >= 1
    pieces = packing.pack(docs).groupBy("sequence_id").agg(packing.F.count_distinct("step_group").alias("n"), packing.F.count_distinct("window").alias("m"))
    assert pieces.where("n != 1 or m != 1").isEmpty()
