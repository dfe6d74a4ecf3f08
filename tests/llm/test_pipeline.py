import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_operators import _components
from test_passages import _brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of ``documents`` and those of each stage, in order."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns_and_take_effect(spark, stages):
    sizes = [df.count() for df in stages]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    assert sizes[0] >= sizes[1] > sizes[2] == sizes[3] > sizes[4]
    assert corpus_pipeline.run(spark, SF).count() == sizes[5]


def test_stages_against_plain_versions(spark, stages):
    docs, known, distinct, cut, clean, _ = stages
    assert set(_texts(known).items()) <= set(_texts(docs).items())
    label, _ = _components(_texts(known), 5)
    assert _texts(distinct) == {i: t for i, t in _texts(known).items() if label[i] == i}
    before = dict(sorted(_texts(distinct).items()))
    assert _texts(cut) == dict(zip(before, _brute_force(list(before.values())).values(), strict=True))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _texts(clean) == {i: t for i, t in _texts(cut).items() if not any(x in t for x in items)}
    assert all(r.n_chars == len(r.text) for r in clean.collect())


def test_pieces_are_the_tokenizers_ids(stages):
    from tokenizers import Tokenizer

    t, texts, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), _texts(stages[-2]), stages[-1].collect()
    found = {i: [] for i in texts}
    for r in sorted(pieces, key=lambda r: r.start):
        found[r.doc_id].append(r)
    for i, text in texts.items():
        ids, at = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in found[i]:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no row at all."""
    names = ["row", "id", "text_hash", "kept", "removed", "score", "place", "lang_pred", "others", "_id", "key", "window"]
    long = " ".join(f"Wort{i % 977} im Satz {i}." for i in range(30000))
    texts = [None, "", " \n\t ", "one", long, long, "a quick line of words in english " * 4, "a quick line of words in english " * 4, "漢字。", "12 + 3", "clean words that nobody else has written down"]
    rows = [(i if i != 5 else None, t, None if i % 3 == 1 else "en", None, None, *(None if (i + k) % 4 else f"v{i}{k}" for k in range(len(names)))) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    made = spark.createDataFrame(rows + rows[:4], schema)
    spark.createDataFrame([(1, None), (None, "a quick line of words in english and so on")], "item_id long, text string").write.parquet(f"{tmp_path}/some/benchmark.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    made.write.parquet(f"{tmp_path}/some/documents.parquet")
    made.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    packed = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()}
    assert 4 in packed and not packed & {0, 1, 2, 6, 7, 9}
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/some")
        assert out.columns == docs.columns, name
        extra = {tuple(r)[5:] for r in docs.collect()}
        assert {tuple(r)[5:] for r in out.collect()} <= extra, name
