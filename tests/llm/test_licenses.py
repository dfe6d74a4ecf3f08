"""The keyword filter only skips rules that can't match."""

import time

import pytest

from holdlens.llm.licenses import Scanner, plain_text, rules

TEXTS = [
    "released under the gnu general public license, version 2.0",
    "licensed under a creative commons attribution-noncommercial 4.0 international license",
    "permission is hereby granted, free of charge, to any person obtaining a copy",
    "redistribution and use in source and binary forms, with or without modification",
    "all rights reserved",
    "this may not be reproduced without written permission",
    "this may not be copied without permission",
    "covered by the common development and distribution license 1.1",
    "open data commons public domain dedication and license 1.0",
]


class Unfiltered(Scanner):
    def __init__(self):
        super().__init__()
        self.filter = self

    def iter(self, text):
        return [(0, r.keyword) for r in self.rules]


@pytest.mark.parametrize("gap", [" ", "  ", "\t", "\n", "\r\n", "\n    ", "\r\n\t "])
def test_filtered_and_unfiltered_scans_agree(gap):
    scanner, whole = Scanner(), Unfiltered()
    for text in TEXTS:
        low = f"x {text} y".replace(" ", gap).encode()
        found = [(a, b, r.label) for a, b, r in scanner.detections(low)]
        assert found
        assert found == [(a, b, r.label) for a, b, r in whole.detections(low)]


def test_keywords_are_in_their_rules():
    assert {r.keyword for r in rules() if b"written" in r.pattern.pattern} == {b"permission"}


def test_rules_are_distinct_and_hold_their_keywords():
    found = rules()
    assert len({r.pattern.pattern for r in found}) == len(found) > 200
    for r in found:
        assert r.keyword in r.pattern.pattern.replace(b"\\", b"").replace(b"licen[sc]e", b"license"), r


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "; ", "-- ", "\r", "dnl "])
def test_headers_are_found_in_comments(mark):
    text = "Licensed under the Apache\nLicense, Version 2.0 (the license);\nyou may not\n\nuse GNU Lesser General\nPublic License, version 3.0 or\nCC\nBY-SA 4.0"
    low = ("/*\n" + "\n".join(mark + x for x in text.split("\n")) + "\n*/").lower().encode()
    got = [(low[a:b], r.label) for a, b, r in sorted(Scanner().detections(low), key=lambda x: x[:2])]
    assert [x for _, x in got] == ["apache-2.0", "lgpl-3.0", "cc-by-sa-4.0"]
    for (span, _), (first, last) in zip(got, [(b"licensed", b"2.0"), (b"gnu", b"3.0"), (b"cc", b"4.0")], strict=True):
        assert span.startswith(first) and span.endswith(last)


def test_detections_of_the_sample_against_all_rules_and_all_pairs(spark):
    scanner, whole = Scanner(), Unfiltered()
    some = 0
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect():
        low = row.text.encode().lower()
        plain, _, _ = plain_text(low)
        found = sorted(((m.start(), m.end(), r) for r in scanner.rules for m in r.pattern.finditer(plain)), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        kept = []
        for d in found:
            if not any(a <= d[0] and d[1] <= b for a, b, _ in kept):
                kept.append(d)
        got = scanner.detections(low)
        assert [r.label for _, _, r in got] == [r.label for _, _, r in kept] == [r.label for _, _, r in whole.detections(low)]
        some += len(got)
    assert some > 4


def test_very_many_detections_take_seconds():
    began, low = time.time(), b"some words and the mit license, copyright 2020 with text between them all; " * 50_000
    assert len(Scanner().detections(low)) == 100_000 and time.time() - began < 30
