import datetime
import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import equivalence, link, metrics, select, vectors, verify
from gristmill.operators.examples import build_examples, similar_examples
from gristmill.plans import flows
from gristmill.sources import artifacts, catalog
from gristmill.streaming import events as ev


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- sources ---------------------------------------------------------------------------------------------------


def test_questions_are_normalised(spark, tmp_path):
    (tmp_path / "dev").mkdir()
    raw = [{"question_id": 7, "db_id": "a", "question": "q?", "evidence": None, "SQL": "S1", "difficulty": " Moderate "}, {"db_id": "a", "question": "r?", "query": "S2"}, {"db_id": "a", "question": "s?", "sql": "S3", "difficulty": "hard"}, {"question": "no database"}, {"db_id": "b", "question": "t?", "SQL": "", "sql": "S4"}]
    (tmp_path / "dev" / "dev.json").write_text(json.dumps(raw))
    got = rows(catalog.load_questions(spark, "dev", str(tmp_path)))
    assert got == [(1, "a", "r?", "", "S2", "simple"), (4, "b", "t?", "", "S4", "simple"), (7, "a", "q?", "", "S1", "moderate")]
    assert catalog.load_questions(spark, "train", str(tmp_path)).collect() == []
    with pytest.raises(ValueError, match="unknown split"):
        catalog.load_questions(spark, "test", str(tmp_path))
    (tmp_path / "train.json").write_text("not json")
    assert catalog.load_questions(spark, "train", str(tmp_path)).collect() == []


def test_catalog(spark, sf_dir):
    assert "orders" in catalog.discover_tables(spark, sf_dir) and catalog.discover_tables(spark, sf_dir, ["nation", "x"]) == ["nation"]
    with pytest.raises(FileNotFoundError):
        catalog.discover_tables(spark, sf_dir + "/nowhere")
    c = catalog.load_catalog(spark, sf_dir, ["nation", "region"])
    assert [x[:3] for x in c.columns()][:2] == [("nation", "n_nationkey", 0), ("nation", "n_name", 1)]


def test_artifacts_and_results(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))
    calls = []
    make = lambda: calls.append(1) or spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(store.cached("d", "t", make)) == rows(store.cached("d", "t", make)) == [(1, "a")] and len(calls) == 1
    store.cached("d", "t", make, force=True)
    assert len(calls) == 2
    store.save_json(make(), "d", "j")
    assert rows(store.load_json("d", "j", "k int, v string")) == [(1, "a")]
    store.save_text(spark.createDataFrame([("x\ny",)], "t string"), "d", "x")
    assert store.load_text("d", "x").strip() == "x\ny"
    path = str(tmp_path / "results")
    for ids in ([1, 2], [2, 3]):
        artifacts.append_results(spark.createDataFrame([(i, True) for i in ids], "question_id int, correct boolean"), path)
    assert sorted(r.question_id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_partitioned_index_compares_blocks(spark):
    made = [(i, [float((i * 7 + j * j * 3) % 11 - 4) for j in range(3 if i % 9 == 4 else 5)]) for i in range(300)] + [(300, None), (None, [1.0] * 5)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").coalesce(2)
    asked = df.where("vec_id % 10 = 0")
    exact = vectors.cosine_topk(asked, df, 4)
    index = vectors.PartitionedIndex(df)
    assert len(index.centres) > 8
    found = index.search(asked, 4, probes=len(index.centres), block=7)  # a centre has several blocks on either side
    scores = lambda x: sorted((r.query_id, r.rank, round(r.similarity_score, 9)) for r in x.collect())
    assert scores(found) == scores(exact)
    assert 0.5 < vectors.recall(index.search(asked, 4, probes=4, block=7), exact).head().recall <= 1
    once = index.search(asked, 400, probes=len(index.centres), block=7)
    assert once.count() == once.select("query_id", "vec_id").distinct().count() == 31 * 301


def test_answer_cache(spark, tmp_path):
    cache = artifacts.AnswerCache(spark, str(tmp_path / "c"))
    messages = [{"role": "user", "content": "hi"}]
    assert cache.get("m", messages) is None
    cache.set("m", messages, "hello")
    assert cache.get("m", messages) == "hello" and cache.get("n", messages) is None and cache.get("m", messages, ttl=-1) is None
    asked = []
    ask = cache.cached("m")(lambda ms: asked.append(1) or "new")
    assert ask(messages) == "hello" and not asked
    found = cache.lookup(spark.createDataFrame([("hi",), ("ho",)], "prompt string"), "m")
    assert rows(found) == [("hi", "hello"), ("ho", None)]
    cache.add(spark.createDataFrame([("h\"o\n", "one"), ("é", "two")], "prompt string, answer string"), "m")
    assert cache.get("m", [{"role": "user", "content": 'h"o\n'}]) == "one" and cache.get("m", messages) == "hello"
    assert artifacts.AnswerCache(spark, str(tmp_path / "c"), enabled=False).get("m", messages) is None


def test_models_and_settings():
    def limited(_):
        raise artifacts.RateLimited

    assert artifacts.with_fallbacks([limited, lambda p: p + "!"])("x") == "x!"
    tries, waits = [], []

    def twice(p):
        tries.append(p)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert artifacts.with_retries(twice, sleep=waits.append)("x") == "ok" and waits == [2.0, 4.0]
    assert artifacts.Settings.of(models="a, b,", fix_rounds=1, other=3) == artifacts.Settings(models=("a", "b"), fix_rounds=1, extra={"other": "3"})
    schema = artifacts.schema_of_json({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"oneOf": [{"type": "null"}, {"type": "number"}]}}}})
    assert schema.simpleString() == "struct<a:bigint,b:array<double>>" and not schema["a"].nullable


# --- operators -------------------------------------------------------------------------------------------------


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "a"), (3, [-1.0, 0.0], "b"), (4, [0.0, 0.0], "b"), (5, [1.0, 0.0], "b"), (6, None, "b")], "vec_id long, embedding array<float>, label string")
    got = [(r.vec_id, round(r.similarity_score, 3), r["rank"]) for r in vectors.cosine_topk(df.where("vec_id = 1"), df, 6).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (5, 1.0, 2), (2, 0.0, 3), (4, 0.0, 4), (6, 0.0, 5), (3, 0.0, 6)]
    small = rows(vectors.cosine_topk(df, df, 2, block=2))
    assert small == rows(vectors.cosine_topk(df, df, 2))
    assert {r.vec_id for r in vectors.cosine_topk(df.where("vec_id = 1"), df, 9, exclude_same="label").collect()} == {3, 4, 5, 6}
    assert vectors.cosine_topk(df.limit(0), df).collect() == [] and vectors.cosine_topk(df, df.limit(0)).collect() == []
    unit = vectors.embed_texts(spark.createDataFrame([("hello world",), ("",), (None,)], "t string"), "t").collect()
    assert abs(sum(x * x for x in unit[0].embedding) - 1) < 1e-5 and not any(unit[1].embedding) and not any(unit[2].embedding)


def test_examples_of_other_databases(spark):
    q = spark.createDataFrame([(1, "a", "How many cats are there?"), (2, "b", "How many dogs are there?"), (3, "a", "List all towns"), (4, "c", "List all towns")], "question_id int, db_id string, question string")
    examples = build_examples(q)
    first = [r for r in similar_examples(q.where("question_id = 3"), examples, 2).collect() if r["rank"] == 1]
    assert [r.example_id for r in first] == [4]
    with pytest.raises(ValueError, match="no questions"):
        build_examples(q.limit(0))


def test_equivalence_keeps_no_rows(spark):
    a = spark.range(1000).selectExpr("id", "cast(id % 7 as string) s")
    plan = equivalence.equivalent(a, a.orderBy("s"))._jdf.queryExecution().executedPlan().toString()
    assert "keys=[row" not in plan and "hashpartitioning" not in plan
    same = lambda x, y, r="strict": equivalence.equivalent(x, y, r).head().equal
    swapped = a.withColumn("s", F.when(F.col("id") == 3, "4").when(F.col("id") == 4, "3").otherwise(F.col("s")))
    for r in equivalence.RELATIONS:
        assert same(a, a.orderBy(F.desc("id")), r) and not same(a, swapped, r) and same(a.union(swapped), swapped.union(a), r)
        assert not same(a.union(a), a, r) and not same(a.where("id > 0"), a.where("id < 999"), r)
        assert not same(a.where("id IN (1, 1, 2)").union(a.where("id = 1")), a.where("id IN (1, 2)").union(a.where("id = 2")), r)


def test_required_columns_of_rows_that_repeat_a_question(spark, monkeypatch):
    available = spark.createDataFrame([("Town", "Area", 0), ("town", "born", 1), ("user", "Area", 0)], "table string, column string, ordinal int")
    asked = [(1, "SELECT born FROM town"), (1, "SELECT area FROM user"), (2, None), (None, "SELECT area FROM user"), (3, "SELECT Area, area FROM town JOIN user"), *[(i, "SELECT area FROM user") for i in range(10, 60)]]
    q = spark.createDataFrame(asked, "question_id int, SQL string")
    monkeypatch.setattr(metrics, "TOGETHER", 2)
    found = metrics.required_columns(q, available)
    first = [(1, "town", "area"), (1, "town", "born"), (1, "user", "area"), (3, "town", "area"), (3, "user", "area")]
    assert rows(found.where("question_id < 10")) == first and found.where("question_id >= 10").count() == 50
    assert found.rdd.getNumPartitions() >= 27  # as many tasks as questions ask for


def test_pairs_of_blocks_reach_python_in_small_batches(spark):
    key, labels = "spark.sql.execution.arrow.maxBytesPerBatch", ["a", "b", None]
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(256 << 20))
        df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], labels[i % 3]) for i in range(90)], "vec_id long, embedding array<float>, label string")
        found = vectors.cosine_topk(df.where("vec_id < 6"), df, 5, exclude_same="label", block=8).collect()
        assert int(spark.conf.get(key).removesuffix("b")) <= 4 << 20
    finally:
        spark.conf.set(key, before)
    assert len(found) == 30 and all(labels[r.query_id % 3] != labels[r.vec_id % 3] for r in found)


def test_questions_of_one_skeleton_are_compared_once(spark, monkeypatch):
    from gristmill.operators import examples as module

    texts = ["How many cats are there?", "List all towns", "Which town has 5 cats?", "Which town has 7 cats?", "How many towns are there?"]
    made = [(i, None if i % 13 == 0 else f"d{i % 3}", texts[i % 5] if i % 17 else None) for i in range(200)]
    q = spark.createDataFrame(made, "question_id int, db_id string, question string")
    compared = []
    monkeypatch.setattr(module, "nearest", lambda a, b, *x, **y: compared.append((a.count(), b.count())) or vectors.nearest(a, b, *x, **y))
    got = {}
    for r in similar_examples(q.where("question_id % 4 = 0"), build_examples(q), 6).collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.example_id, round(r.similarity_score, 9)))
    assert compared and max(max(x) for x in compared) <= 5 * 4
    unit = {r.question_id: r.embedding for r in build_examples(q).collect()}
    for i, db, _ in made[::4]:
        cos = {j: round(sum(x * y for x, y in zip(unit[i], unit[j], strict=True)), 6) for j, other, _ in made if other != db}
        best = sorted(cos, key=lambda j: (-cos[j], j))[:6]
        assert [x[1] for x in sorted(got[i])] == best and [x[0] for x in sorted(got[i])] == [1, 2, 3, 4, 5, 6]


def test_linking_rules(spark):
    fields = [("students", c, i) for i, c in enumerate(("id", "name", "department_id"))] + [("departments", c, i) for i, c in enumerate(("id", "title"))]
    available = spark.createDataFrame(fields, "table string, column string, ordinal int")
    ranked = spark.createDataFrame([(1, "students", "name", 1), (1, "nowhere", "x", 2), (1, "students", "name", 3)], "question_id int, table string, column string, rank int")
    hints = spark.createDataFrame([(1, "TITLE")], "question_id int, hint string")
    got = rows(link.candidate_fields(ranked, available, hints))
    assert got == [(1, "departments", "title", 2), (1, "students", "name", 1)]
    keys = spark.createDataFrame([("students", "id"), ("departments", "id")], "table string, column string")
    edges = spark.createDataFrame([("students", "department_id", "departments", "id")], "from_table string, from_column string, to_table string, to_column string")
    alone = link.with_foreign_keys(ranked.where("rank = 1"), edges)
    assert rows(alone) == [(1, "students", "department_id"), (1, "students", "name")]
    s1, s2 = link.link(ranked, available, keys, edges, hints)
    assert rows(s1) == rows(s2) == sorted((1, t, c) for t, c, _ in fields)
    chosen = spark.createDataFrame([(1, "students", "name"), (1, "students", "Name")], "question_id int, table string, column string")
    s1, s2 = link.link(ranked, available, keys, edges, hints, chosen=chosen, wider=chosen)
    assert rows(s1) == [(1, "students", "department_id"), (1, "students", "id"), (1, "students", "name")] and rows(s2) == rows(s1)


CANDIDATES = "question_id int, pos int, generator_id string, sql string, success boolean, is_empty boolean, n_rows long, n_fixes int, adjustment double, result_key string"


def test_selection(spark):
    data = [
        (1, 0, "standard_B1_s1", "SELECT a", True, False, 5, 0, 0.2, "x"), (1, 1, "reasoning_A1", "SELECT bb", True, False, 5, 0, 0.0, "x"), (1, 2, "icl_C1", "SELECT c", True, False, 5, 1, 0.0, "y"),
        (2, 0, "icl_C1", "long query", True, False, 5, 0, 0.0, "x"), (2, 1, "icl_C2", "short", True, False, 5, 0, 0.0, "x"),
        (3, 0, "icl_C1", "broken", False, False, 0, 0, 0.0, "z"), (3, 1, "icl_C2", "empty", True, True, 0, 0, 0.0, "z"),
        (4, 0, "icl_C1", "p", True, False, 5, 0, 0.0, "x"), (4, 1, "icl_C2", "q", True, False, 5, 0, 0.1, "y"), (4, 2, "reasoning_A1", "r", True, False, 500, 0, 0.0, "w"),
    ]
    scored = select.with_confidence(spark.createDataFrame(data, CANDIDATES))
    conf = {(r.question_id, r.pos): round(r.confidence, 3) for r in scored.collect()}
    assert conf == {(1, 0): 1.0, (1, 1): 0.714, (1, 2): 0.0, (2, 0): 1.0, (2, 1): 1.0, (3, 0): 0.0, (3, 1): 0.0, (4, 0): 0.833, (4, 1): 1.0, (4, 2): 0.0}
    kept = {(r.question_id, r.pos): r.confidence for r in select.with_confidence(spark.createDataFrame(data, CANDIDATES), drop_least=False).collect()}
    assert kept[1, 2] > 0 and kept[3, 0] == 0
    got = {r.question_id: (r.sql, r.method, r.cluster_count) for r in select.choose(scored).collect()}
    assert got == {1: ("SELECT a", "fast_path", 1), 2: ("short", "fast_path", 1), 3: ("broken", "fallback", 0), 4: ("p", "tournament", 2)}
    judge = lambda pairs: pairs.withColumn("answer", F.lit("FINAL: B"))
    assert {r.sql for r in select.choose(scored, judge).where("question_id = 4").collect()} == {"q"}
    assert select.preview(spark.range(9).selectExpr("id", "repeat('x', 30) AS t"), 2).splitlines() == ["id | t", "0 | " + "x" * 20, "1 | " + "x" * 20, "... more than 2 rows"]


def test_verification(spark):
    spark.createDataFrame([("Alice", 3.9), ("Bob", 2.8), ("Carol", None)], "name string, gpa double").createOrReplaceTempView("students")
    spark.createDataFrame([("Alice", c) for c in "xy"] + [("Bob", c) for c in "xy"], "name string, course string").createOrReplaceTempView("enrolments")
    v, S = verify.Verifier(spark), verify.Spec
    status = lambda sql, *specs: [o.status for o in v.evaluate(sql, list(specs))]
    assert status("SELECT name FROM students", S("grain", upper_sql="SELECT COUNT(*) FROM students"), S("grain", upper=2), S("grain", lower=5), S("grain", upper_sql="DELETE FROM students")) == ["pass", "fail", "fail", "pass"]
    assert status("SELECT s.name FROM students s JOIN enrolments e ON s.name = e.name", S("duplicate", expected_sql="SELECT COUNT(*) FROM students WHERE name <> 'Carol'"), S("duplicate")) == ["fail", "fail"]
    assert status("SELECT name, gpa FROM students", S("null"), S("null", check_columns=["gpa"]), S("scale", minimum=0, maximum=3), S("column_alignment", expected_columns=2), S("column_alignment", expected_columns=3, confidence="low")) == ["fail", "fail", "fail", "pass", "skip"]
    assert status("SELECT AVG(gpa) FROM students", S("symmetry", other_sql="SELECT 3.35"), S("symmetry", other_sql="SELECT 9"), S("boundary")) == ["pass", "fail", "skip"]
    assert status("SELECT nothing FROM students", S("grain")) == ["error"]
    tests = spark.createDataFrame([(1, "grain", "fail"), (1, "null", "fail"), (2, "grain", "pass"), (2, "null", "error"), (3, "grain", "skip")], "id int, test_type string, status string")
    assert {r.id: (round(r.adjustment, 3), r.all_pass) for r in verify.adjustment(tests, ["id"]).collect()} == {1: (-0.4, False), 2: (0.2, True), 3: (0.0, True)}


def test_verification_sees_the_whole_result(spark):
    spark.range(30_000).selectExpr("id", "IF(id = 29999, NULL, id % 29000) AS k").createOrReplaceTempView("wide")
    v, S = verify.Verifier(spark), verify.Spec
    specs = [S("grain", upper=20_000), S("grain", lower=30_000), S("null"), S("duplicate"), S("scale", maximum=29_500), S("scale", maximum=28_998)]
    assert [o.status for o in v.evaluate("SELECT k FROM wide ORDER BY id", specs)] == ["fail", "pass", "fail", "fail", "pass", "fail"]


def test_a_judge_decides_on_boundaries(spark):
    S = verify.Spec("boundary")
    said = lambda answer, sql: [o.status for o in verify.Verifier(spark, answer).evaluate(sql, [S])]
    assert said(lambda p: "Pass: it does", "SELECT 1") == ["pass"] and said(lambda p: "fail", "SELECT 1") == ["fail"]
    assert said(lambda p: 1 / 0, "SELECT 1") == ["error"] and said(lambda p: 1 / 0, "SELECT 1 FROM range(3) WHERE DATE '2020-01-01' IS NULL") == ["pass"]


def test_ties_at_the_last_place_go_by_id(spark):
    df = spark.range(3000).selectExpr("id AS vec_id", "array(1.0D, 2.0D) AS embedding").repartition(3)
    got = vectors.cosine_topk(df.where("vec_id % 500 = 7"), df, 4, exclude_self=True, block=256).collect()
    assert len(got) == 6 * 4
    assert sorted(r.vec_id for r in got if r.query_id == 507) == [0, 1, 2, 3] and {r["rank"] for r in got} == {1, 2, 3, 4}


def test_equivalence_of_odd_numbers(spark):
    a = spark.createDataFrame([(float("nan"), 1e300), (float("inf"), -0.0)], "x double, y double")
    for relation in equivalence.RELATIONS:
        assert equivalence.equivalent(a, a.orderBy("y"), relation).head()[0]
        assert not equivalence.equivalent(a, a.limit(1), relation).head()[0]
    with pytest.raises(ValueError, match="unknown relation"):
        equivalence.canonical_rows(a, "other")


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "question_id int, db_id string, difficulty string, predicted_sql string, correct boolean, selection_method string, winner_generator string, fix_count int, latency_seconds double, cost_estimate double")
    assert tuple(metrics.overall(none).head()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert metrics.running_accuracy(none).collect() == []
    before = spark.createDataFrame([("a", "c", 5), ("b", "c", 2)], "table string, column string, n_entries long")
    assert rows(metrics.index_size_change(before, before.where("table = 'a'"))) == [("a", 5, 5, 0), ("b", 2, 0, -2)]


# --- flows and streams -----------------------------------------------------------------------------------------


def test_from_database_to_accuracy(spark, sf_dir, tmp_path):
    c = catalog.load_catalog(spark, sf_dir, ["nation", "region"])
    store = artifacts.ArtifactStore(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "main", "How many nations are in ASIA?", "", "SELECT COUNT(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", "simple"), (2, "main", "Name the top 2 regions", None, "SELECT r_name FROM region", "simple")], catalog.QUESTION)
    a = flows.build(c, store, asked)
    assert "CREATE TABLE nation" in store.load_text("main", "ddl") and rows(flows.build(c, store, asked).profile) == rows(a.profile)
    extra = spark.createDataFrame([(1, 20, "x_1", "SELECT COUNT(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"), (1, 21, "x_2", "SELECT COUNT(*) FROM nation"), (1, 22, "x_3", "SELECT oops"), (1, 23, "x_4", "SELECT 5 AS n")], "question_id int, pos int, generator_id string, sql string")
    got = {r.question_id: r for r in flows.answer(asked, a, extra=extra).collect()}
    assert got[1].method in ("fast_path", "tournament") and got[2].method == "fallback" and got[2].sql == ""
    truth = asked.where("question_id = 1").head().SQL
    assert flows.execution_accuracy(c, extra.head().sql, truth) and not flows.execution_accuracy(c, "SELECT COUNT(*) FROM nation", truth) and not flows.execution_accuracy(c, " ", truth)
    said = flows.answer(asked.where("question_id = 2"), a, model=lambda p: "```sql\nSELECT r_name FROM region ORDER BY r_name LIMIT 2;\n```").head()
    assert said.sql == "SELECT r_name FROM region ORDER BY r_name LIMIT 2" and said.method == "fast_path"


def test_a_model_grounds_and_links(spark, sf_dir, tmp_path):
    c = catalog.load_catalog(spark, sf_dir, ["customer", "nation", "region"])
    asked = spark.createDataFrame([(1, "main", "Which customers live in ASIA?", "x" * 900, "SELECT 1", "simple"), (2, "main", "Regions?", None, "SELECT 1", "simple")], catalog.QUESTION)
    a = flows.build(c, artifacts.ArtifactStore(spark, str(tmp_path)), None)
    seen = tmp_path / "seen"
    seen.mkdir()

    def model(prompt):
        (seen / f"{abs(hash(prompt))}").write_text(prompt)
        if "Regions?" in prompt:
            raise OSError("no answer")
        if "literals" in prompt:
            return 'Sure: {"literals": ["ASIA"], "references": "none"} done'
        if "further" in prompt:
            return '[{"table": "nation", "column": "n_name"}, {"table": "no", "column": "such"}]'
        return '[{"table": "customer", "column": "c_name"}]'

    rows = {r.question_id: r for r in flows.contexts(asked, a, model).collect()}
    one, two = rows[1], rows[2]
    assert {(x["table"], x["column"]) for x in one.s1_fields} == {("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_nationkey")}
    assert {(x["table"], x["column"]) for x in one.s2_fields} >= {("nation", "n_name"), ("nation", "n_nationkey"), ("customer", "c_name")} and not one.same
    assert one.s1_ddl.startswith("-- Table: customer\nCREATE TABLE customer (\n  c_custkey INTEGER PRIMARY KEY,") and "c_acctbal" not in one.s1_ddl and "CREATE TABLE nation" in one.s2_ddl and "| n_name | TEXT |" in one.s2_markdown
    assert "-- Foreign keys: c_nationkey REFERENCES nation(n_nationkey)" in one.s1_ddl
    assert two.same and len(two.s1_fields) >= 15 or len(two.s1_fields) == a.profile.count()
    assert any(("x" * 500 + "...") in f.read_text() and "x" * 501 not in f.read_text() for f in seen.iterdir())
    plain = {r.question_id: r.literals for r in flows.ground.literals(asked).collect()}
    said = {r.question_id: (r.literals, r.references) for r in flows.ground.literals(asked, model).collect()}
    assert said == {1: (["ASIA"], []), 2: (plain[2], plain[2])}
    promoted = spark.createDataFrame([(1, "The r_name field in the region table.")], "question_id int, hint string")
    named = {(r["table"], r["column"]) for r in flows._promoted(promoted, a).join(a.fields, "vec_id").collect()}
    assert ("region", "r_name") in named


def test_fix_rounds(spark, sf_dir):
    c = catalog.load_catalog(spark, sf_dir, ["region"]).register()
    tries = iter(["SELECT r_nam FROM region", "SELECT r_name FROM region WHERE r_regionkey < 0", "SELECT r_name FROM region"])
    fixed = flows.fix_one(c, 1, 0, "g", "SELEC", [verify.Spec("grain")], lambda sql, result, outcomes: next(tries))
    assert fixed.n_fixes == 3 and fixed.result.success and len(fixed.trace) == 4 and fixed.adjustment == verify.BONUS
    assert all(len(t) == 17 for t in fixed.trace) and [t["fix_triggered"] for t in fixed.trace] == [True, True, True, False] and fixed.trace[3]["is_final_assessment"] and fixed.trace[3]["verif_all_pass"]
    assert fixed.trace[1]["sql_changed_from_previous"] and fixed.trace[2]["exec_issues_sent"] == ["no rows"] and not fixed.trace[0]["verif_ran"] and fixed.trace[3]["exec_row_count"] == 5
    stuck = flows.fix_one(c, 1, 0, "g", "SELEC", [], lambda *a: "SELEC")
    assert stuck.n_fixes == 3 and not stuck.result.success

    def broken(*_):
        raise OSError("no model")

    assert flows.fix_one(c, 1, 0, "g", "SELEC", [], broken).n_fixes == 0
    assert ev.get_tracker().summary()["fixer"] == {"OSError": 1}
    ev.get_tracker().reset()


def test_fix_prompt_says_what_went_wrong():
    r = flows.ExecutionResult(True, [(1, None), (1, None), (2, "x")], columns=["a", "b"])
    text = flows.fix_prompt("how many?", "SELECT a, b FROM t", r, [verify.Outcome("duplicate", "fail", "1 repeated rows"), verify.Outcome("grain", "pass")], "schema")
    assert text.startswith("schema\n\nQuestion: how many?") and "- duplicate: 1 repeated rows" in text and "1 | NULL" in text and "1 rows repeat others." in text and "grain" not in text
    assert "It failed: oops" in flows.fix_prompt("q", "s", flows.ExecutionResult(False, error="oops"), [])


def test_fallback_events(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    tracker = ev.FallbackTracker(str(log))
    tracker.component("linker").record("LLMError", "first fields", n=3)
    tracker.record("linker", "LLMError", "first fields", "error")
    tracker.record("fixer", "Timeout", "kept")
    assert tracker.summary() == {"linker": {"LLMError": 2}, "fixer": {"Timeout": 1}}
    assert len(log.read_text().splitlines()) == 3
    summed = {r.component: r.triggers for r in ev.summarize_events(tracker.frame(spark)).collect()}
    assert summed == tracker.summary()
    ev.append_events(tracker.frame(spark), str(tmp_path / "events"))
    assert ev.read_events(spark, str(tmp_path / "events")).count() == 3
    assert ev.FallbackTracker(str(tmp_path / "no" / "folder")).record("a", "b", "c") is None


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(3):
        events.where(f"event_id % 3 = {i}").orderBy("ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ev.start_rollup(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "1 day", "1 day")
    q.awaitTermination()
    done = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r.window_start, r.event_type): r.n for r in ev.tumbling_counts(events, "1 day").collect()}
    last = max(k[0] for k in whole) - datetime.timedelta(days=2)
    assert {k: n for k, n in whole.items() if k[0] < last}.items() <= done.items() and done.items() <= whole.items()
