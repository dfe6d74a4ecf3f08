"""Re-parameterised, short and numeric items against a plain version that works on one pair of texts at a time."""

import random
import re
from collections import Counter, defaultdict

from holdlens.llm.decontamination import _NUMBER_WORDS, _UNIT_WORDS, contaminated, drop_contaminated

NUMBERS, UNITS = set(_NUMBER_WORDS.split()), set(_UNIT_WORDS.split())


def _template(text):
    """(token, value or None) with equal neighbouring placeholders as one."""
    out, opens, last = [], True, 0
    number = False
    for m in re.finditer(r"[0-9A-Za-z]+", text):
        opens = not out or bool(re.search(r"[.!?\n]", text[last : m.start()]))
        last, word = m.end(), m.group().lower()
        was, number = number, m.group()[0].isdigit() or word in NUMBERS
        unit = was and not number and word in UNITS
        kind = "#" if number else "u" if unit else "N" if m.group()[0].isupper() and not opens else None
        if number and word in UNITS:
            kind = "#"
        if kind and out and out[-1][0] == kind and out[-1][1] is not None:
            out[-1] = (kind, out[-1][1] + " " + word)
        else:
            out.append((kind, word) if kind else (word, None))
    return out


def _windows(t, n=5, least=3):
    return [(i, t[i : i + n]) for i in range(len(t) - n + 1) if sum(v is None for _, v in t[i : i + n]) >= least]


def _holds(doc, item):
    mine, theirs = _windows(_template(item)), _windows(_template(doc))
    if not mine:
        words = [re.findall(r"[0-9a-z]+", x.lower()) for x in (item, doc)]
        size = min(8, len(words[0]))
        if size < 3:
            return False
        runs = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in words]
        return 2 * len(runs[0] & runs[1]) >= len(runs[0])
    at = defaultdict(list)
    for j, w in theirs:
        at[tuple(x for x, _ in w)].append((j, w))
    shifts = defaultdict(set)
    for i, w in mine:
        for j, v in at[tuple(x for x, _ in w)]:
            shifts[j - i].add((i, tuple(x for x, _ in w), tuple((a, b) for (_, a), (_, b) in zip(w, v, strict=True) if a is not None)))
    found = set()
    for rows in shifts.values():
        votes = defaultdict(Counter)
        for _, _, slots in rows:
            for a, b in slots:
                votes[a][b] += 1
        for _, tokens, slots in rows:
            # ties are broken by hashes there; the cases below have none that matter
            if all(votes[a][b] == max(votes[a].values()) for a, b in slots):
                found.add(tokens)
    return 2 * len(found) >= len({tuple(x for x, _ in w) for _, w in mine})


ITEMS = [
    "A farmer has 12 apples and gives 5 apples to his friend Mary before he walks 3 km home. How many apples has the farmer then?",
    "When Alice drives from Boston to Denver at 90 kmh she needs 31 hours with 2 stops. How long does Alice need without stops?",
    "What is 12 + 7 * 3?",
    "Sort 9 4 7 1 8 2 6 into rising order",
    "3 5 8 13 21 34 55 89 144 233 377",
    "Who wrote it",
    "Yes no",
    "The train leaves at seven and the other train leaves at nine while the station clock is slow by four minutes on that day.",
]


def _documents():
    rng = random.Random(5)
    filler = [f"word{i} goes here and there" for i in range(50)]
    out = []
    for item in ITEMS:
        out.append(f"{rng.choice(filler)}. {item} {rng.choice(filler)}")
        other = re.sub(r"\d+", lambda m: str(int(m.group()) * 3 + 1), item).replace("Mary", "Peter").replace("Alice", "Bob")
        out.append(f"{rng.choice(filler)}. {other} {rng.choice(filler)}")
        out.append(f"{rng.choice(filler)}. {re.sub(r'[0-9]+', lambda m: str(rng.randrange(1000)), item)} {rng.choice(filler)}")
        words = item.split()
        out.append(" ".join(words[: len(words) // 3]) + f". {rng.choice(filler)}")
        out.append(" ".join(words[len(words) // 4 :]))
    return [*out, "", "nothing of it"]


def test_items_against_brute_force(spark):
    docs, items = list(enumerate(_documents())), list(enumerate(ITEMS))
    want = {(d, i) for d, text in docs for i, item in items if _holds(text, item)}
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    assert {(5 * i, i) for i in range(len(ITEMS)) if i != 6} <= got and {(1, 0), (6, 1)} <= got and not {i for _, i in got} & {6}


def test_null_and_repeated_ids_and_any_column_names(spark):
    items = spark.createDataFrame([(None, ITEMS[0]), (7, ITEMS[1]), (7, ITEMS[1]), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, ITEMS[0], 1, 2, 3), (1, ITEMS[1], 1, 2, 3), (2, None, 1, 2, 3), (2, "clean", 4, 5, 6)], "doc_id long, text string, _id int, id int, `row` int")
    assert {(r.doc_id, r.item_id, r.windows == r.item_windows) for r in contaminated(docs, items).collect()} == {(None, None, True), (1, 7, True)}
    out = drop_contaminated(docs, items)
    assert out.columns == docs.columns and {(r.doc_id, r.text) for r in out.collect()} == {(2, None), (2, "clean")}
