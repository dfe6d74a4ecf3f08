"""What goes although it is short or has no sentence marks."""

import random

import pyarrow as pa

from holdlens.llm.passages import _units, remove_repeats


def _texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in remove_repeats(df).collect()}


def test_repeated_lines_go_whatever_their_length(spark):
    line, thai = "Click here to read more. Share it with friends.", "\u0e01\u0e02\u0e04" * 40
    got = _texts(spark, [f"one text\n{line}\n{thai}\nends", f"another\n{line}\nthen", f"third {line} inside\n{thai}\nOk.", "Ok.\nfourth"])
    assert got[0] == f"one text\n{line}\n{thai}\nends"
    assert got[1] == "another\nthen" and got[3] == "fourth"
    assert got[2] == f"third {line} inside\nOk."
    kept = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame([(1, "Ok.\nx y z w\nv"), (2, "Ok.\nx y z w\nu")], "doc_id long, text string"), line_words=4, line_bytes=24).collect()}
    assert kept == {1: "Ok.\nx y z w\nv", 2: "Ok.\nu"}


def test_lines_against_a_plain_loop(spark):
    """Lines split and compared by hand, without the library's units."""
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "cd", "EF", "gh,", "\u00e9t\u00e9", "7", "x-y"])
    texts = [[" ".join(word() for _ in range(rng.randint(1, 6))).lower() for _ in range(rng.randint(0, 9))] for _ in range(250)]
    rows = [(k, "\n".join(x.upper() if rng.random() < 0.2 and x.isascii() and len(x.split()) == 1 else x.replace(" ", "\t ", 1) if rng.random() < 0.2 else x for x in lines)) for k, lines in enumerate(texts)]
    seen, want = set(), {}
    for k, text in rows:
        pieces = text.split("\n")
        left = []
        for n, x in enumerate(pieces):
            key = tuple(x.lower().split())
            if not key or key not in seen:
                left.append(x + ("\n" if n + 1 < len(pieces) else ""))
            seen.add(key)
        want[k] = "".join(left)
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {k: r.text for k, r in got.items()} == want
    for k, text in rows:
        data, spans = text.encode(), sorted([(s.start, s.end) for s in got[k].removed + got[k].kept])
        assert "".join(data[a:b].decode() for a, b in ((s.start, s.end) for s in got[k].kept)) == want[k]
        assert b"".join(data[a:b] for a, b in spans) == data


def test_passages_without_marks_go_from_the_middle_of_lines(spark):
    passage = " ".join(f"word{i * i % 61}x{i}" for i in range(60))
    got = _texts(spark, [f"here the first host says {passage} and goes on with it", f"another one begins in other ways so {passage} until it ends"])
    left = got[1].split()
    assert left[:4] == "another one begins in".split() and left[-3:] == "until it ends".split()
    assert sum(w in passage.split() for w in left) <= 35


def test_other_scripts_have_marks(spark):
    greek = " ".join(f"\u0388\u03bd\u03b1 \u03bb\u03cc\u03b3\u03b9\u03b1{i} \u03b5\u03b4\u03ce." for i in range(20))
    chinese = "".join(f"{chr(0x4E00 + 7 * i)}{chr(0x5000 + 11 * i)}\u6211\u4eec\u5728\u8fd9\u91cc\u8bf4{chr(0x6000 + 13 * i)}\u3002" for i in range(30))
    got = _texts(spark, [f"a {greek} b\n\u7532\u4e59{chinese}\u4e19", f"c {greek} d\n\u4e01\u620a{chinese}\u5df1"])
    assert greek[30:] not in got[1] and chinese[20:] not in got[1]
    assert got[1].startswith("c ") and got[1].endswith("d\n\u4e01\u620a" + chinese[:10] + "\u5df1")


def test_units_do_not_depend_on_other_rows():
    texts = [" ".join(f"w{i * k % 97}" for i in range(40 + k)) for k in range(1, 60)]
    alone = [next(_units(pa.array([t]))).low.tolist() for t in texts]
    assert [u.low.tolist() for u in _units(pa.array(texts))] == alone
    assert [u.low.tolist() for u in _units(pa.array(texts[::-1]))] == alone[::-1]


def _brute_force(texts):
    """Each repeated line but the first by (id, place) goes, and pieces of lines by the same units; one text at a time."""
    from holdlens.llm.passages import _runs

    units = {i: next(_units(pa.array([t]))) for i, t in enumerate(texts)}
    first = {}
    for i, u in units.items():
        for place, d in enumerate(zip(u.low.tolist(), u.high.tolist(), strict=True)):
            first.setdefault(d, (i, place))
    out = {}
    for i, u in units.items():
        repeat = pa.array([first[d] != (i, place) for place, d in enumerate(zip(u.low.tolist(), u.high.tolist(), strict=True))], pa.bool_()).to_numpy(zero_copy_only=False)
        data, gone = texts[i].encode(), _runs(repeat, u, 25, 1, 1)
        for s, e in gone[::-1]:
            data = data[: u.start[s]] + (data[u.start[e] :] if e < len(u.size) else b"")
        out[i] = data.decode()
    return out


def test_whole_sample_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").collect()]
    got, want = _texts(spark, texts), _brute_force(texts)
    assert got == want and sum(got[i] != t for i, t in enumerate(texts)) > 20
    # every line of some length is left once: its first place
    lines = [" ".join(x.lower().split()) for i in range(len(texts)) for x in got[i].split("\n")]
    assert max(lines.count(x) for x in {x for x in lines if x}) == 1


def test_columns_may_have_any_name(spark):
    line = "one line of some words that comes twice"
    df = spark.createDataFrame([(1, f"a\n{line}", 1, "p", 3), (2, f"b\n{line}", 2, "q", 4)], "doc_id long, text string, _id int, `_hash` string, places int")
    out = remove_repeats(df)
    assert out.columns == [*df.columns, "n_units", "n_removed", "n_spans", "removed", "kept"]
    assert {(r.doc_id, r.text, r["_id"], r["_hash"], r.places) for r in out.collect()} == {(1, f"a\n{line}", 1, "p", 3), (2, "b\n", 2, "q", 4)}
