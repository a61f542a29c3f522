import re

import duckdb
import pytest
from test_decontam import brute
from test_mixing import plain_targets
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from gristmill.llm import langid, pii
from gristmill.llm import queries as registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    """The small tables with awkward rows beside their own."""
    out = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = benchmark.first().text
    copy = docs.first().text
    mine = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, copy, "en", "src0", 1), (10**6 + 3, "the and that " * 9 + item, "en", None, 9), (10**6 + 4, "the house and that the a.b@c.de with of 10.1.2.3", "en", "src1", 7)]
    docs.unionByName(spark.createDataFrame(mine, DOCUMENTS)).coalesce(3).write.parquet(f"{out}/documents.parquet")
    benchmark.write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_run_equals_plain_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    accepted = {r.doc_id for r in langid.predict(docs, model).where("not rejected").collect()}
    assert 10**6 not in accepted and 10**6 + 1 not in accepted
    ids = sorted(accepted)
    root = brute_components([brute_fingerprint(rows[i].text) for i in ids])
    first = {}
    for i, g in zip(ids, root, strict=True):
        first.setdefault(g, i)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    squeezed = re.compile(r"[^a-z0-9\x80-\U0010ffff]+")
    kept = []
    for i in first.values():
        flat = squeezed.sub(" ", rows[i].text.lower())
        suspects = [x for x in items if any(s in flat for s in _fives(squeezed.sub(" ", x.lower()).split()))]
        if not any(brute(rows[i].text, x) >= 0.8 for x in suspects):
            kept.append(i)
    sizes, own = {}, {}
    for i in kept:
        own[i] = len(re.findall(r"[^\x20\x09-\x0D]+", pii.masked(rows[i].text, pii.find_spans(rows[i].text))))
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + own[i]
    targets = plain_targets(sizes)
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in got} <= set(kept) and all(r["size"] == own[r.doc_id] for r in got)
    assert all(r.target == pytest.approx(targets[rows[r.doc_id].source]) for r in got)
    for s, t in targets.items():
        assert abs(sum(r.taken for r in got if rows[r.doc_id].source == s) - t) <= 64


def _fives(words):
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def test_stages_return_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "source_mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    masked = {r.doc_id: r for r in docs.collect()}
    assert masked[10**6 + 4].text.endswith("[EMAIL] with of [IP]") and masked[10**6 + 4].n_chars == len(masked[10**6 + 4].text)
    assert 10**6 + 2 not in masked and 10**6 + 3 not in masked


def test_stages_take_empty_tables(spark, small):
    none = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, sf_dir)
    want = db.sql(registry.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, frame.select(*columns).collect()), key=key) == sorted(want.select(*columns).fetchall(), key=key)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_stages_keep_columns_of_any_name_and_take_long_and_repeated_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    long = spark.createDataFrame([(10**7, "the house and that of with " * 60_000, "en", "src0", 1)] * 3, DOCUMENTS)
    odd = docs.unionByName(long).selectExpr("*", "1 AS size", "'t' AS taken", "2.0 AS target", "'x' AS _id", "4 AS _fp", "5 AS component", "6 AS fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, small)
        assert kept.columns == odd.columns
        assert {tuple(r)[5:] for r in kept.collect()} == {(1, "t", 2.0, "x", 4, 5, 6)}
        odd = kept
    got = corpus_pipeline.mix_sources(spark, odd, small).collect()
    assert sum(r.doc_id == 10**7 for r in got) == 1 and next(r["size"] for r in got if r.doc_id == 10**7) == 360_000
