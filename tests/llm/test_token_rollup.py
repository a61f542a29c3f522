import json

import pytest

from gristmill.llm import token_rollup

CHANGES = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long"


def totals(rollup):
    return sorted(map(tuple, rollup.totals().collect()), key=str)


def test_counts_are_the_tokenizers_own(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    encoding = token_rollup._encoding(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken")
    want = {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_rollup.token_counts(docs).collect()} == want
    odd = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "s", "l", "x"), (None, "a b", "s", "l", "x")], "doc_id long, text string, source string, lang string, n_tokens string")
    assert {r.doc_id: r.n_tokens for r in token_rollup.token_counts(odd).collect()} == {1: 0, 2: 0, None: 2}
    assert encoding.decode(encoding.encode_ordinary("naïve 日本 \n")) == "naïve 日本 \n"


def test_deltas_equal_a_recount(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    assert totals(rollup) == []
    batches = [
        [("upsert", 1, "a", "en", "v1", 10), ("upsert", 2, "a", None, "v1", 5), ("upsert", 1, "a", "en", "v2", 12), ("upsert", None, "b", "en", "v1", 3), ("upsert", None, "b", "en", "v1", 3)],
        [("upsert", 1, "b", "en", "v1", 11), ("delete", 2, None, None, "v1", None), ("delete", 99, None, None, "v1", None), ("delete", None, "b", "en", "v1", None)],
        [("upsert", 2, "c", "fr", "v1", 7), ("upsert", 2, "c", "fr", "v1", 9), ("upsert", 1, "b", "en", "v1", None)],
        [],
    ]
    state, nameless = {}, []
    for number, rows in enumerate(batches, 1):
        df = spark.createDataFrame(rows, CHANGES)
        assert rollup.apply(number, df)
        before = totals(rollup)
        assert not rollup.apply(number, df) and totals(rollup) == before  # sent again
        for op, doc, source, lang, version, n in sorted(rows, key=lambda r: (r[0] != "upsert", r[5] or 0)):
            if doc is None:
                nameless += [(source, lang, version, n or 0)] if op == "upsert" else []
            elif op == "delete":
                state.pop((doc, version), None)
            else:
                state[doc, version] = (source, lang, version, n or 0)
        want = {}
        for *key, n in [*state.values(), *nameless]:
            docs, tokens = want.get(tuple(key), (0, 0))
            want[tuple(key)] = (docs + 1, tokens + n)
        assert before == sorted(((*k, *v) for k, v in want.items()), key=str)
    with pytest.raises(ValueError, match="after"):
        rollup.apply(0, spark.createDataFrame([], CHANGES))


def test_a_failed_attempt_leaves_nothing(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path))
    rollup.apply(1, spark.createDataFrame([("upsert", 1, "a", "en", "v", 4)], CHANGES))
    broken = spark.createDataFrame([("upsert", 2, "a", "en", "v", 4)], CHANGES).selectExpr("op", "doc_id", "source", "lang", "tokenizer_version", "n_tokens + CAST(raise_error('lost') AS BIGINT) AS n_tokens")
    with pytest.raises(Exception, match="lost"):
        rollup.apply(2, broken)
    assert totals(rollup) == [("a", "en", "v", 1, 4)]
    assert rollup.apply(2, spark.createDataFrame([("upsert", 2, "a", "en", "v", 6)], CHANGES))
    assert totals(rollup) == [("a", "en", "v", 2, 10)]
    other = token_rollup.TokenRollup(spark, str(tmp_path))
    assert not other._mark(2, str(tmp_path / "attempts" / "late")) and list(other.committed()) == [1, 2]
    assert json.loads((tmp_path / "commits" / "batch-000000000002.json").read_text())["attempt"].startswith(str(tmp_path))


def test_long_runs_count_as_the_tokenizer_would():
    encoding = token_rollup._encoding(f"{token_rollup.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for white in (" ", "\n", "\t", " ", " \n", "\r\n  "):
        run = (white * 3000)[:2999]
        for text in (run, f"a{run}b", f"a{run}\nb", f"{run} b{run}.", f"don't{run}'s {run}", f"7{run}　{run}é"):
            assert token_rollup.count_tokens(encoding, text) == len(encoding.encode_ordinary(text))


def test_very_long_texts_and_empty_tables(spark):
    n = 1_000_000
    texts = [" " * n, "\n" * n, "\t" * n + "x", "a" * n, "x" + " " * n + "y" + "\r\n" * n, "word " * 200_000, "　" * n]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.n_tokens for r in token_rollup.token_counts(docs).collect()}
    assert len(got) == 7 and all(got.values()) and got[5] == 200_001
    assert token_rollup.token_counts(docs.limit(0)).collect() == []


def test_inserts_revisions_and_deletes_equal_a_recount(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    docs = docs.union(docs.limit(20)).union(docs.selectExpr("CAST(NULL AS BIGINT)", "text", "lang", "source", "n_chars").limit(3)).unionByName(docs.limit(30).selectExpr("doc_id", "'again' AS text", "lang", "'other' AS source", "n_chars"))
    counts = token_rollup.token_counts(docs)
    want = sorted(map(tuple, counts.groupBy("source", "lang", "tokenizer_version").agg({"*": "count", "n_tokens": "sum"}).collect()), key=str)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path), each_row=True)
    named = lambda df, op: df.where("doc_id IS NOT NULL").selectExpr("*", f"'{op}' AS op")
    rollup.apply(1, named(token_rollup.estimated_counts(docs, "byte_bpe_50k").union(token_rollup.estimated_counts(docs, "draft")), "upsert"))
    assert rollup.compact() and not rollup.compact()
    rollup.apply(2, counts.selectExpr("*", "'upsert' AS op"))
    assert len(totals(rollup)) > len(want)
    rollup.apply(5, named(token_rollup.estimated_counts(docs, "draft"), "delete"))
    assert totals(rollup) == want
    assert rollup.compact() and totals(rollup) == want and not rollup.apply(5, counts.selectExpr("*", "'upsert' AS op"))
    by_state = rollup.state().groupBy("source").agg({"n_tokens": "sum"}).collect()
    assert sum(r[1] for r in by_state) + counts.where("doc_id IS NULL").agg({"n_tokens": "sum"}).head()[0] == sum(w[4] for w in want)


def test_the_query_counts_every_row(spark, sf_dir):
    from gristmill.llm import queries

    counts = token_rollup.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    want = counts.groupBy("source", "lang", "tokenizer_version").agg({"*": "count", "n_tokens": "sum"})
    assert sorted(map(tuple, queries.op10_token_counts(spark, sf_dir).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
