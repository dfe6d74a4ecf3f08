import numpy as np

from holdlens.llm import language_id


def test_equal_texts_have_equal_vectors_in_any_order_and_step(monkeypatch):
    texts = ["ab", "x", "a longer text, with words", "ab", "Zug", "a", "!?", "x", "ab."]
    made = lambda ts: {i: x for rows, v in language_id.text_vectors(ts) for i, x in zip(rows, v, strict=True)}
    alone = [made([t]).get(0) for t in texts]
    for order in (list(range(len(texts))), list(range(len(texts)))[::-1]):
        for step in (1, 5, 1 << 17):
            monkeypatch.setattr(language_id, "STEP_CHARS", step)
            got = made([texts[i] for i in order])
            for at, i in enumerate(order):
                assert (got.get(at) is None) if alone[i] is None else np.array_equal(got[at], alone[i])


def _plain_vector(text):
    """One text at a time, n-gram by n-gram."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return None
    spread, base = f" {' '.join(words)} ", {}
    for c in set(spread):
        base[c] = language_id._vectors(np.array([ord(c)], np.uint32))[0].astype(np.float64)
    return sum(base[z] * np.roll(base[y], 1) * np.roll(base[x], 2) for x, y, z in zip(spread, spread[1:], spread[2:]))


def test_predictions_against_one_text_at_a_time(spark):
    import zlib

    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and len(r.text) < 3000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    vectors = {r.doc_id: _plain_vector(r.text) for r in rows}
    sums = {}
    for r in rows:
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and vectors[r.doc_id] is not None:
            v = vectors[r.doc_id]
            sums[r.lang] = sums.get(r.lang, 0) + np.rint(v / np.sqrt(v @ v) * language_id.SCALE)
    names = sorted(sums)
    for r in language_id.identify_languages(docs).collect():
        v = vectors[r.doc_id]
        cosines = [v @ sums[x] / np.sqrt(v @ v) / np.sqrt(sums[x] @ sums[x]) for x in names] if v is not None else []
        best = int(np.argmax(np.round(cosines, 9))) if cosines else None
        assert r.lang_pred == ("und" if best is None else names[best]) and abs(r.score - (max(0, cosines[best]) if cosines else 0)) < 1e-6


def test_texts_in_no_learned_language_go(spark):
    rng = np.random.default_rng(8)

    def noise(n, lo, hi):
        return " ".join("".join(chr(c) for c in rng.integers(lo, hi, rng.integers(2, 9))) for _ in range(n))

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = [(10**6 + i, noise(n, lo, hi), None) for i, (n, (lo, hi)) in enumerate((n, r) for n in (20, 300, 3000) for r in ((97, 123), (0x430, 0x450), (0x3B1, 0x3CA), (0x5D0, 0x5EB)) for _ in range(3))]
    short = [(2 * 10**6 + i, t, None) for i, t in enumerate(" ".join(r.text.split()[:12]) for r in docs.where("lang = 'de' and n_chars > 500").limit(20).collect())]
    odd = [(3 * 10**6, None, "en"), (3 * 10**6 + 1, "", "en"), (3 * 10**6 + 2, "12 + 3!", None)]
    both = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(strange + short + odd, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language_id.keep_identified(both.withColumn("score", language_id.F.lit("mine")).withColumn("row", language_id.F.lit(1))).where("score = 'mine' and row = 1").select("doc_id").collect()}
    assert not kept & {i for i, *_ in strange + odd}
    assert len(kept & {i for i, *_ in short}) == len(short)
    assert len([i for i in kept if i < 10**6]) >= 0.995 * docs.count()


def test_few_possible_n_grams_are_counted_without_sorting(monkeypatch):
    texts = [r * 3 for r in ("a longer text, with words", "Zug und Bahn", "жук и дом", "x")]
    made = lambda: {i: x for rows, v in language_id.text_vectors(texts) for i, x in zip(rows, v, strict=True)}
    unique, sorted_sizes = np.unique, []
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: sorted_sizes.append(k.get("return_inverse", False)) or unique(x, *a, **k))
    counted = made()
    assert not any(sorted_sizes)
    monkeypatch.setattr(language_id, "FEW_VALUES", 0)
    monkeypatch.setattr(language_id, "KINDS", 7)
    by_sorting = made()
    assert any(sorted_sizes) and set(counted) == set(by_sorting) == {0, 1, 2, 3}
    assert all(np.array_equal(counted[i], by_sorting[i]) for i in counted)
