import pytest
from pyspark.sql import functions as F

from gristmill.operators import profile, render
from gristmill.operators.values import cell_values, index_values, search_values
from gristmill.sources.catalog import Catalog


@pytest.fixture(scope="module")
def students(spark):
    return Catalog(
        "students",
        {
            "countries": spark.createDataFrame([], "code string, name string"),
            "students": spark.createDataFrame([(1, "Alice", 20, 3.9, "USA"), (2, "Bob", 22, None, "UK"), (3, "Alice", 21, 3.5, "USA"), (4, None, 25, 2.8, None)], "id int, name string, age int, gpa double, country string"),
        },
        {"students": ["id"], "countries": ["code"]},
        [("students", "country", "countries", "code")],
    )


def test_profile_of_a_small_database(students):
    rows = {(r.table, r.column): r for r in profile.profile_catalog(students).collect()}
    name = rows["students", "name"]
    assert (name.null_rate, name.distinct_count, name.top_values[0].value, name.top_values[0].freq, name.avg_length) == (0.25, 2, "Alice", 2, 13 / 3)
    assert (rows["students", "age"].min_value, rows["students", "age"].max_value, rows["students", "age"].avg_value) == (20, 25, 22)
    assert rows["students", "id"].is_primary_key and rows["students", "country"].foreign_key == "countries.code"
    empty = rows["countries", "name"]
    assert (empty.total_rows, empty.null_count, empty.null_rate, empty.distinct_count, empty.top_values) == (0, 0, 0.0, 0, [])
    assert [tuple(r) for r in profile.totals(profile.profile_catalog(students)).collect()] == [(2, 7)]
    assert [tuple(r) for r in profile.key_containment(students).collect()] == [("students", "country", "countries", "code", 3, 3)]


def test_ties_go_by_value_and_names_may_be_odd(spark):
    df = spark.createDataFrame([("b", -0.0), ("a", 0.0), ("c", float("nan")), (None, None)], "`odd name` string, `x.y` double")
    rows = {r.column: r for r in profile.profile_table(df, "t").collect()}
    assert [v.value for v in rows["odd name"].top_values] == ["a", "b", "c"]
    assert rows["x.y"].distinct_count == 2 and rows["x.y"].null_count == 1


def test_signatures_are_of_sets_and_survive_their_text(spark):
    a = Catalog("x", {"t": spark.createDataFrame([("hello",), ("world",), ("hello",), (None,)], "v string"), "u": spark.createDataFrame([("world",), ("hello",)], "v string")})
    rows = {r.table: r.minhash for r in profile.column_signatures(a).collect()}
    assert rows["t"] == rows["u"] and len(rows["t"]) == 128
    df = spark.createDataFrame([(rows["t"],)], "m array<bigint>")
    assert df.select(profile.decode_signature(profile.encode_signature(df.m))).head()[0] == rows["t"]
    assert df.select(profile.estimated_jaccard(df.m, df.m)).head()[0] == 1.0


def test_fuzzy_values(spark):
    cities = spark.createDataFrame([(1, " Berkeley "), (2, "Oakley"), (3, "Los Angeles"), (4, None), (5, ""), (6, "los angeles")], "id int, city string")
    values = index_values(cell_values(Catalog("c", {"t": cities})))
    assert sorted(r.value for r in values.collect()) == ["Berkeley", "Los Angeles", "Oakley", "los angeles"]
    queries = spark.createDataFrame([(1, "Berkley"), (2, "Los Angelos"), (3, "LOS ANGELES"), (4, "zzz")], "query_id int, keyword string")
    found = search_values(queries, values).collect()
    best = {r.query_id: r for r in found if r.rank == 1}
    assert best[1].matched_value == "Berkeley" and best[1].similarity_score == pytest.approx(0.375)
    assert best[2].similarity_score == pytest.approx(0.7)
    assert best[3].exact_match and best[3].matched_value == "Los Angeles" and 4 not in best
    assert {(r.query_id, r.matched_value) for r in search_values(queries, values, exact=False).collect() if r.rank == 1} >= {(2, "Los Angeles"), (3, "Los Angeles")}


def test_columns_of_too_many_values_are_left_out(spark):
    t = spark.range(30).selectExpr("concat('record_', id) AS value", "id % 3 = 0 AS flag")
    assert {r.column for r in cell_values(Catalog("c", {"t": t}), most_distinct=20).collect()} == {"flag"}


def test_summaries_come_from_a_model_where_it_answers(students):
    found = profile.profile_table(students.tables["students"], "students")

    def model(prompts):
        if len(prompts) > 1 or "gpa" in prompts[0]:
            raise ValueError("too much")
        return [f"{p.split(';')[0]} described " + "x" * 2000 for p in prompts]

    rows = {r.column: r for r in render.summarize(found, model).collect()}
    assert rows["age"].short_summary.startswith("students.age described") and len(rows["age"].short_summary) == 200 and len(rows["age"].long_summary) == 1000
    assert rows["gpa"].long_summary == "The gpa field in the students table."


def test_ddl_quotes_and_truncates(spark):
    c = Catalog("q", {"my table": spark.createDataFrame([("x" * 80, 1)], "`a col` string, b int")}, {"my table": ["b"]})
    found = profile.profile_catalog(c)
    block = render.ddl(found, render.summarize(found), c.foreign_key_frame()).head().block
    assert block == f"""-- Table: my table
CREATE TABLE "my table" (
  "a col" TEXT,  -- The a col field in the my table table.
  b INTEGER PRIMARY KEY  -- The b field in the my table table.
);
-- Example row: ('{"x" * 50}...', 1)"""


def test_rendered_schemas_read_back(spark):
    c = Catalog("q", {"my table": spark.createDataFrame([("x|y", 1)], "`a \"col|` string, b int"), "u": spark.createDataFrame([(1,)], "k int")}, {"my table": ["b"], "u": ["k"]}, [("my table", "b", "u", "k")])
    found = profile.profile_catalog(c)
    summaries = render.summarize(found)
    want = [("my table", 0, 'a "col|', "TEXT", False, None), ("my table", 1, "b", "INTEGER", True, "u.k"), ("u", 0, "k", "INTEGER", True, None)]
    for got in (render.parse_ddl(render.whole_schema(render.ddl(found, summaries, c.foreign_key_frame()))), render.parse_markdown(render.whole_schema(render.markdown(found, summaries)))):
        assert sorted(map(tuple, got.collect())) == want


def test_signatures_of_a_small_file_are_many_tasks(spark):
    from types import SimpleNamespace

    one = spark.createDataFrame([(i, f"v{i % 40}", None if i % 2 else "xy") for i in range(200)], "k long, v string, w string").coalesce(1)
    found = profile.column_signatures(SimpleNamespace(tables={"t": one}), 8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    got = {r.column: list(r.minhash) for r in found.collect()}
    for c in ("k", "v", "w"):
        grams = one.select(F.explode(profile.shingles(F.col(c).cast("string"))).alias("g")).where("g IS NOT NULL").select(F.xxhash64("g").alias("h"))
        assert got[c] == list(grams.agg(*[F.min(F.xxhash64("h", F.lit(s))).alias(str(s)) for s in range(1, 9)]).head())
