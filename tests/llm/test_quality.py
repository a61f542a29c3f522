import collections
import re

import numpy as np
import pyarrow as pa

from gristmill.llm import quality_model, quality_rules
from gristmill.llm._tokens import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + j for v in windows.values() if len(v) > 1 for i in v for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None,
    "",
    " \n\t\n ",
    "a b c d e",
    "a b c d e f",
    "a a a a a a",
    "a a a a a a a",
    "a b c d e a b c d e",
    "x\nx\n x\ny\n\n\nx",
    "é # $ % ünïcode |<>| 日本",
    "one two three four five six seven eight nine ten one two three four five",
    " ".join(f"w{i % 977}" for i in range(30_000)),
    "\x00 \x0b a\x0cb",
]


def test_ledger_equals_a_plain_version(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "x"), (None, TEXTS[8], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality_rules.apply_policy(quality_rules.ledger(df)).collect()
    assert len(got) == len(rows)
    of = dict(enumerate(TEXTS)) | {None: TEXTS[8]}
    for r in got:
        m = plain(of[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, r.doc_id
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.ledger(df.limit(0)).collect() == []


def test_ablation_counts_what_each_rule_alone_rejects(spark):
    rows = spark.createDataFrame([(0,), (0,), (1,), (3,), (4,), (5,)], "fail_bits int")
    got = {(r.policy, r.rule): r for r in quality_rules.ablate(rows, {"p": 1 | 4}).collect()}
    assert set(got) == {("p", "too_few_words"), ("p", "symbols")}
    few = got["p", "too_few_words"]
    assert (few.n_docs, few.n_failed, few.n_kept, few.n_kept_without) == (6, 3, 2, 4)
    assert got["p", "symbols"].n_kept_without == 3


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(0)
    n, k = 20_000, len(quality_model.LABELLERS)
    good = rng.random(n) < 0.8
    hit = np.linspace(0.3, 0.9, k)
    votes = np.where(good[:, None], np.where(rng.random((n, k)) < 0.02, quality_model.BAD, quality_model.ABSTAIN), np.where(rng.random((n, k)) < hit, quality_model.BAD, quality_model.ABSTAIN))
    patterns, counts = np.unique(quality_model.pattern(votes), return_counts=True)
    model = quality_model.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    assert np.abs(model.chance[:, 1, quality_model.BAD] - hit).max() < 0.05
    assert ((model.posterior(quality_model.pattern(votes)) > 0.5) == good).mean() > 0.97


def test_classifier_agrees_with_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    rows = quality_model.classify(docs, quality_model.fit(docs)).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.98
    assert np.mean([not r.kept for r in rows if r.quality == 0]) >= 0.9


def test_measurements_do_not_depend_on_cuts():
    texts = pa.array(["a b b b", "", None, "ÄB *** !! x. y,", "z " * 500])
    whole = np.concatenate([quality_model.measure(t) for t in texts_of(texts)])
    alone = np.concatenate([quality_model.measure(t) for t in texts_of(texts, 1)])
    assert np.allclose(whole, alone) and whole[0][list(quality_model.NAMES).index("longest_run")] == 3


def test_classifier_rows_of_every_kind(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000), (None, "some words, here. And there."), (4, "### $$$")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = quality_model.classify(df, quality_model.fit(df)).collect()
    assert len(got) == 6 and not any(r.kept for r in got if r.doc_id in (1, 2))
    none = df.limit(0)
    assert quality_model.classify(none, quality_model.fit(none)).collect() == []


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark):
    good = "The house stands near the river, and it is old. We saw it in spring, when the water was high."
    rows = [(1, f"{good} {i}") for i in range(30)] + [(1, "### $$$ !!! ??? %%% " * 4 + str(i)) for i in range(30)] + [(1, good)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_model.fit(df, sample=40)
    got = quality_model.classify(df, model).collect()
    assert sorted(r.kept for r in got) == [False] * 30 + [True] * 230
    again = quality_model.fit(df.repartition(5), sample=40)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_ledger_of_an_id_on_many_rows_and_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k"), (1, "x"), (1, None)], "doc_id long, text string").selectExpr("*", "9 AS n_words", "'z' AS words", "true AS kept", "1 AS fail_bits")
    got = quality_rules.apply_policy(quality_rules.ledger(df)).collect()
    assert sorted(r.n_words for r in got) == [0, 1, 11]
