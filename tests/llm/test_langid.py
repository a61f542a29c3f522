import zlib

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import langid
from gristmill.llm._tokens import texts_of


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_held_out_accuracy(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").select("*", langid.held_out().alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    held = [r for r in rows if r.h]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 2


def test_rows_of_every_kind(spark, model):
    texts = [None, "", "12 + 3 = 15 — …", "the and that with of", "日本語", "der und die nicht " * 20000]
    df = spark.createDataFrame([(i, t, 7.5, "x") for i, t in enumerate(texts)] + [(None, "the and that", 1.0, None)] * 2, "doc_id long, text string, score double, lang_pred string")
    got = langid.predict(df, model).collect()
    assert len(got) == 8
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and [by_id[i].score for i in (0, 1, 2)] == [0.0] * 3
    assert by_id[3].lang_pred == "en" and by_id[5].lang_pred == "de" and by_id[4].lang_pred in model.langs
    assert langid.predict(df.limit(0), model).collect() == []
    left = langid.accepted(df, model)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {3, 5, None} and left.where("doc_id < 3").count() == 0


def test_long_texts_by_pieces_are_as_whole(model, monkeypatch):
    texts = ["", "the cat", None, "que el perro de la casa " * 50, "x", "dass nicht eine " * 9]
    whole = model.predict(next(texts_of(pa.array(texts))))
    monkeypatch.setattr(langid, "PIECE", 17)
    pieces = model.predict(next(texts_of(pa.array(texts))))
    alone = [model.predict(t) for t in texts_of(pa.array(texts), 1)]
    assert np.allclose(whole[1], pieces[1]) and whole[0].tolist() == pieces[0].tolist()
    assert np.allclose(whole[1], np.concatenate([x[1] for x in alone]))


def test_no_rows_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    nothing = langid.fit(df)
    assert nothing.langs == [] and [r.lang_pred for r in langid.predict(df, nothing).collect()] == ["und", "und"]


def test_rejection_threshold_keeps_right_answers():
    score, right = np.linspace(0, 1, 1000), np.ones(1000, bool)
    assert langid._threshold(score, right) == 0.0
    right[:4] = False
    assert 0 < langid._threshold(np.linspace(0, 1, 1000), right) < 0.01 or langid._threshold(score, right) == 0.0
