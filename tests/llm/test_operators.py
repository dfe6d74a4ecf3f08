import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdlens.llm import chat, decontamination, language_id, licenses, media, near_duplicates, packing, passages, sharding, toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, linked string, slots int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"Wort{i % 977} im Satz." for i in range(60000))
    rows = [(1, None, None, "x", 1), (2, "", "en", None, 2), (3, " \n\t ", "en", "x", None), (4, "one", "en", "x", 1), (5, long, "de", "x", 1), (6, long, "de", "x", 1), (6, long, "de", "x", 1), (None, "no id here", "en", "x", 1), (7, "¡Ñandú! 漢字 <|endoftext|> 1", "es", "x", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _components(texts, n):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, n):
    want, sizes = _components({r.doc_id: r.text for r in docs.collect()}, n)
    got = near_duplicates.near_duplicates(docs, shingle=n).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_near_duplicates_through_a_common_ancestor(spark):
    """Variants that link with their ancestor but not with each other, and one that links with a variant alone."""
    base = [f"w{i}" for i in range(100)]
    texts = {0: base}
    for k in range(12):
        v = list(base)
        for j in range(4):
            v[8 * k + 2 * j if 8 * k + 2 * j < 100 else j] = f"v{k}x{j}"
        texts[k + 1] = v
    far = list(texts[3])
    for j in range(5):
        far[40 + 3 * j] = f"far{j}"
    texts[50] = far
    texts = {i: " ".join(t) for i, t in texts.items()}
    want, _ = _components(texts, 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(df, shingle=2).collect()} == want


def test_near_duplicates_odd_rows(odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(odd).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[4] == (1, 4, True)
    assert got[6][1:] == (5, False) and got[None][1:] == (None, True)
    assert near_duplicates.near_duplicates(empty).count() == 0
    kept = near_duplicates.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]


def test_passages(spark, odd, empty):
    passage = " ".join(f"Passage {w} here." for w in "abcdefghijklmnopqrstuvwxyz")
    rows = [(1, f"Own start and some {passage} own end of one"), (2, f"Other words come in\n{passage.replace(' ', '  ')} then more"), (3, "Short. Short. Clean text\nShort."), (4, None)]
    got = {r.doc_id: r for r in passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **passages.KEEP_STOCK_LINES).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text is None
    assert "Passage b" not in got[2].text and got[2].text.startswith("Other words come in\n") and got[2].text.endswith("then more")
    for i, t in rows[:3]:  # the spans cover the original and the kept ones make the text
        marks = sorted([(s.start, s.end) for s in [*got[i].kept, *got[i].removed]])
        assert marks[0][0] == 0 and marks[-1][1] == len(t.encode()) and all(a[1] == b[0] for a, b in zip(marks, marks[1:]))
        assert "".join(t.encode()[s.start : s.end].decode() for s in got[i].kept) == got[i].text
    out = passages.remove_repeats(odd)
    assert out.count() == odd.count() and out.columns[:5] == odd.columns
    assert {r.doc_id: len(r.text or "") > 1000 for r in out.collect()}[6] is False
    assert passages.remove_repeats(empty).count() == 0


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in r.text}
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == want
    q = "A farmer has 12 apples and gives 5 apples to his friend Mary before he walks 3 km home. How many apples has the farmer then?"
    same = "so A farmer has 40 apples and gives 7 apples to his friend Peter before he walks 9 km home. How many apples has the farmer then? yes"
    twice = "a shop with 12 cats sold 12 cats on the very first day of the sale and closed"
    table = spark.createDataFrame([(1, q), (2, twice), (3, None), (4, "")], "item_id long, text string")
    texts = spark.createDataFrame([(1, same), (2, twice.replace("12", "5", 1)), (3, "nothing of it"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.contaminated(texts, table).collect()}
    # the copy with one of two equal numbers changed keeps most of its windows
    assert got == {(1, 1): False, (2, 2): True}
    assert decontamination.contaminated(odd, table).count() == 0 and decontamination.contaminated(empty, table).count() == 0
    assert decontamination.contaminated(texts, table.limit(0)).count() == 0
    assert {r.doc_id for r in decontamination.drop_contaminated(texts, table).collect()} == {3, 4}


def _check_packing(texts, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= found[0].window <= 2048
    return ids, by_sequence


def test_packing(docs):
    data, rows = docs.select("doc_id", "text").collect(), packing.pack(docs).collect()
    ids, by_sequence = _check_packing([r.text for r in data], rows)
    of = dict(zip([r.doc_id for r in data], ids, strict=True))
    for r in rows:
        assert zlib.crc32(np.array(of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(of[r.doc_id])
    padding = sum(f[0].window - sum(r.length for r in f) for f in by_sequence.values())
    assert padding < 2048 * docs.rdd.getNumPartitions()


def test_packing_odd_rows(odd, empty):
    _check_packing([r.text for r in odd.collect()], packing.pack(odd).collect())
    assert packing.pack(empty).count() == 0


def test_word_encoder_is_the_tokenizer():
    rng = np.random.default_rng(2)
    letters = [*"aZé ÉßΣσİıÅ.,'!s-\n\t́ ẞ1２中<|x\x1c\x85µªº", "<|endoftext|>", "'s", "’ll"]
    texts = ["".join(rng.choice(letters, 40)) for _ in range(400)]
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert packing.WordEncoder.fits(public_tokenizers.path("word_bpe_49k.json"))
    assert [list(x) for x in e.encode(pa.array(texts))] == [e.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_language_id(docs, odd, empty):
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    out = {r.doc_id: r for r in language_id.identify_languages(odd).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[5].lang_pred != "und"
    assert language_id.identify_languages(empty).count() == 0
    kept = language_id.keep_identified(docs, 0.05)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def test_toxicity(spark, docs, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(many, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade_toxicity(many, model).collect()}
    words = re.compile(r"\b(idiot|clown|scum|trash|moron|worthless|pathetic|loser|disgusting|stupid)\b", re.I)
    has = {r.doc_id for r in many.collect() if words.search(r.text or "")}
    flagged = {i for i, r in got.items() if r.toxic}
    assert len(flagged & has) >= 0.95 * len(has) and len(flagged - has) <= 0.02 * len(got)
    assert {r.doc_id: r.toxic for r in toxicity.grade_toxicity(odd, model).collect()}[1] is False
    blank = toxicity.train(empty, labels)
    assert toxicity.grade_toxicity(odd, blank).count() == odd.count() and toxicity.grade_toxicity(empty, blank).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\<s>\\\\[OUT]", "<<SYS>>x<</SYS>>", "<|image:1|>", "", None, "<", "\\", "[/TURN]\n[ROLE]"]
    roles = ["user", "assistant", "system", "tool[/ROLE]", None]
    rows = [(c, k, roles[(c + k) % 5], hard[(c * 2 + k) % len(hard)]) for c in range(9) for k in range(4)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_turns(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = [(r or "", t or "") for x, _, r, t in rows if x == c]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest() and got[c].n_turns == len(mine)
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_conversations(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see [INST]", None, None, None, None, None), ("image", None, "a.png", 56, 30, None, None), ("AUDIO", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), (None, "end", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    assert first.segment == "[INST]see \\[INST]<|image:1|><|audio:2|><|document:3|>end[/INST]" and second.segment == "[INST][/INST]"
    assert [(a.place, a.type, a.ref, a.tokens) for a in first.attachments] == [(1, "image", "a.png", 4), (2, "audio", "b.wav", 50), (3, "document", "c.pdf", 2400)]
    assert first.tokens == 3 + 4 + 50 + 2400 + 1


def test_media(spark, docs, odd, empty):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in media.text_media(docs).collect():
        p = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.feature.startswith("application/octet-stream>audio/wav;") and media.wav_samples(media.wav_of(p)) == p
    assert media.text_media(odd).count() == odd.count() and media.text_media(empty).count() == 0


def test_sniffing_carves_what_validators_confirm(spark):
    import gzip
    import struct

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    wav, gz = media.wav_of(b"\1\2\3\4"), gzip.compress(b"hello" * 50)
    rows = [(1, b"junk" + png + b"BM tail RIFF" + gz + wav, "text/plain"), (2, png, "image/jpeg"), (3, png[:-5], "image/png"), (4, None, "x"), (5, b"", None)]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id long, media binary, declared string")).collect()}
    assert [(x.type, bytes(x.bytes)) for x in got[1].carved] == [("image/png", png), ("application/gzip", gz), ("audio/wav", wav)]
    assert (got[2].actual, got[3].carved, got[3].actual, got[4].carved, got[1].actual) == ("image/png", [], "image/png", [], "text/plain")


def test_licenses(spark, docs, odd, empty):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in licenses.scan_licenses(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(LOWER))
        at = [(i, label) for i in range(len(w)) for p, label in phrases.items() if tuple(w[i : i + len(p)]) == p]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert {*r.base_labels.split(",")} <= {*r.labels.split(","), ""}
    rows = [(1, "Licensed under the Apache License,\nVersion 2.0."), (2, "under CC BY-NC 4.0 and CC-BY"), (3, "This work is licensed under the GNU Lesser General Public License, version 3."), (4, "SPDX-License-Identifier: MIT"), (5, "admit license")]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0", 2: "cc-by,cc-by-nc-4.0", 3: "gpl,lgpl-3.0", 4: "mit", 5: ""}
    assert len(licenses.rules()) > 200
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(empty).count() == 0


def test_sharding(docs, odd, empty):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = sorted(sharding.shard_by_bytes(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.size, r.text_crc32) for r in rows] == [(i, len(t) + 1, zlib.crc32(t)) for i, t in sorted(texts.items())]
    total, before, slots = sum(r.size for r in rows), 0, {}
    for r in rows:
        assert r.shard == (2 * before + r.size) * 16 // (2 * total) and r.slot == slots.get(r.shard, 0)
        slots[r.shard], before = r.slot + 1, before + r.size
    out = sharding.shard_by_bytes(odd).collect()
    assert len(out) == odd.count() and sorted(r.size for r in out)[:2] == [1, 1]
    assert sharding.shard_by_bytes(empty).count() == 0
