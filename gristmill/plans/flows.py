"""From a database to its artefacts, from questions to queries, and from queries to accuracy."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import equivalence, generate, ground, link, render, select, vectors, verify
from gristmill.operators.examples import build_examples
from gristmill.operators.execute import ExecutionResult, execute_sql
from gristmill.operators.profile import profile_catalog
from gristmill.operators.values import cell_values, index_values
from gristmill.sources.artifacts import ArtifactStore
from gristmill.sources.catalog import Catalog
from gristmill.streaming.events import get_tracker


@dataclass
class Artifacts:
    catalog: Catalog
    profile: DataFrame
    summaries: DataFrame
    values: DataFrame
    fields: DataFrame
    examples: DataFrame | None


def build(catalog: Catalog, store: ArtifactStore, questions: DataFrame | None = None, model=None, force: bool = False) -> Artifacts:
    """Profile, summarise, render and index a database; each part is saved once and read again unless ``force``."""
    db = catalog.db_id
    profile = store.cached(db, "profile", lambda: profile_catalog(catalog), force)
    summaries = store.cached(db, "summaries", lambda: render.summarize(profile, model), force)
    if force or not store.has(db, "ddl"):
        store.save_text(render.whole_schema(render.ddl(profile, summaries, catalog.foreign_key_frame())), db, "ddl")
        store.save_text(render.whole_schema(render.markdown(profile, summaries)), db, "markdown")
    values = store.cached(db, "values", lambda: index_values(cell_values(catalog)), force)
    fields = store.cached(db, "fields", lambda: vectors.embed_texts(profile.join(summaries, ["table", "column"]).select(F.xxhash64("table", "column").alias("vec_id"), "table", "column", "ordinal", "long_summary"), "long_summary"), force)
    examples = store.cached("_examples", "questions", lambda: build_examples(questions), force) if questions is not None else None
    return Artifacts(catalog, profile, summaries, values, fields, examples)


def contexts(questions: DataFrame, a: Artifacts, model: Callable[[str], str] | None = None) -> DataFrame:
    """What the generators are told of each question: cells, examples, and both schema subsets in both formats.

    A model, if there is one, extracts literals and selects fields; each of its failures takes the deterministic way.
    """
    cells, found, examples = ground.ground(questions, a.values, a.examples, model=model)
    asked = vectors.embed_texts(questions.select(F.col("question_id").cast("long").alias("vec_id"), "question"), "question")
    near = vectors.cosine_topk(asked, a.fields, link.CANDIDATES)
    fields = a.fields.select("vec_id", "table", "column")
    ranked = near.join(fields, "vec_id").select(F.col("query_id").cast("int").alias("question_id"), "table", "column", "rank")
    hints = found.select("question_id", F.explode("references").alias("hint")).distinct()
    promoted = _promoted(hints, a).join(fields, "vec_id").select("question_id", "table", "column")
    available, keys, edges = a.profile.select("table", "column", "ordinal"), a.catalog.key_frame(), a.catalog.foreign_key_frame()
    if model is None:
        s1, s2 = link.link(ranked, available, keys, edges, hints, promoted=promoted)
    else:
        s1, s2 = link.link_with(model, questions, ranked, available, a.summaries, keys, edges, hints, promoted)
    of_cells = cells.groupBy(F.col("query_id").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("table", "column", "matched_value"))).alias("cells"))
    rows = questions.join(of_cells, "question_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<table: string, column: string, matched_value: string>>")))
    if examples is not None:
        shots = examples.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("\n", "question", "SQL").alias("text")))).alias("r"))
        rows = rows.join(shots.select("question_id", F.transform("r", lambda x: x["text"]).alias("examples")), "question_id", "left")
    else:
        rows = rows.withColumn("examples", F.lit(None).cast("array<string>"))
    rows = rows.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    for name, fields in (("s1", s1), ("s2", s2)):
        rows = rows.join(_rendered(a, fields, name), "question_id", "left")
    same = F.coalesce(F.col("s1_fields") == F.col("s2_fields"), F.lit(True))
    return rows.withColumn("same", same).withColumn("n_tables", F.size(F.array_distinct(F.transform("s2_fields", lambda f: f["table"]))))


def _promoted(hints: DataFrame, a: Artifacts) -> DataFrame:
    """``question_id, vec_id``: fields whose summaries are very near a hint."""
    named = hints.select("question_id", "hint", F.xxhash64("question_id", "hint").alias("vec_id"))
    near = vectors.cosine_topk(vectors.embed_texts(named.select("vec_id", "hint"), "hint"), a.fields, 3)
    return vectors.promoted(near).select("query_id", "vec_id").join(named.select("question_id", F.col("vec_id").alias("query_id")), "query_id").select("question_id", "vec_id").distinct()


def _rendered(a: Artifacts, fields: DataFrame, name: str) -> DataFrame:
    """The subset of each question as DDL and as Markdown, in the order of the schema."""
    by = ["question_id"]
    shown = render.subset(a.profile, fields, by)
    ddl = render.whole_schema(render.ddl(shown, a.summaries, a.catalog.foreign_key_frame(), by), by).withColumnRenamed("schema", f"{name}_ddl")
    markdown = render.whole_schema(render.markdown(shown, a.summaries, by), by).withColumnRenamed("schema", f"{name}_markdown")
    return link.sorted_fields(fields).withColumnRenamed("fields", f"{name}_fields").join(ddl, by).join(markdown, by)


@dataclass
class Fixed:
    """A candidate after its fix rounds."""

    question_id: int
    pos: int
    generator_id: str
    sql: str
    result: ExecutionResult
    n_fixes: int
    adjustment: float
    trace: list[dict]


def fix_prompt(question: str, sql: str, result: ExecutionResult, outcomes: list[verify.Outcome], schema: str = "", sample: int = 5) -> str:
    """What a fixer is told: the question, the query, what went wrong with it, and the first rows that it gave."""
    failed = [f"- {o.test_type}: {o.message or o.status}" for o in outcomes if o.status == "fail"]
    wrong = "The query returned no rows." if result.is_empty else f"It failed: {result.error}" if not result.success else "It ran."
    rows = [" | ".join("NULL" if x is None else str(x) for x in r) for r in result.rows[:sample]]
    repeated = len(result.rows) - len(set(map(repr, result.rows)))
    parts = [schema, f"Question: {question}", f"Query:\n{sql}", wrong, "Checks that failed:\n" + "\n".join(failed) if failed else "", "First rows:\n" + "\n".join(rows) if rows else "", f"{repeated} rows repeat others." if repeated else "", "Write one query that answers the question."]
    return "\n\n".join(p for p in parts if p)


def fix_one(catalog: Catalog, question_id: int, pos: int, generator_id: str, sql: str, specs: list[verify.Spec], fixer: Callable[[str, ExecutionResult, list[verify.Outcome]], str | None] | None = None, rounds: int = 3, timeout: float = 30.0) -> Fixed:
    """Execute, verify and mend one query: ``rounds`` fixes and a last look. No fixer, an error or an empty answer of it ends the rounds."""
    spark, trace, n_fixes, before = catalog.spark, [], 0, None
    while True:
        result = execute_sql(spark, sql, timeout) if sql else ExecutionResult(False, error="no query")
        outcomes = verify.Verifier(spark).evaluate(sql, specs) if result.success else []
        trace.append(trace_record(len(trace), n_fixes == rounds, sql, before, result, outcomes if result.success else None))
        failed = not result.success or result.is_empty or any(o.status == "fail" for o in outcomes)
        if not failed or fixer is None or n_fixes == rounds:
            break
        trace[-1] |= {"exec_issues_sent": [] if result.success and not result.is_empty else [result.error or "no rows"], "verif_issues_sent": [f"{o.test_type}: {o.message or o.status}" for o in outcomes if o.status == "fail"], "fix_triggered": True}
        try:
            mended = fixer(sql, result, outcomes)
        except Exception as e:  # a fixer that fails leaves the query as it is
            get_tracker().record("fixer", type(e).__name__, "kept the query")
            break
        trace[-1]["fix_produced_different_sql"] = bool(mended) and mended != sql
        if not mended:
            break
        before, sql, n_fixes = sql, mended, n_fixes + 1
    none_failed = all(o.status != "fail" for o in outcomes if o.status != "error")
    cost = sum((verify.CRITICAL_PENALTY if o.is_critical else verify.MINOR_PENALTY) for o in outcomes if o.status == "fail")
    bonus = verify.BONUS if none_failed and any(o.status == "pass" for o in outcomes) else 0.0
    return Fixed(question_id, pos, generator_id, sql, result, n_fixes, cost + bonus, trace)


# The names in a trace record, which analyses of traces read.
def trace_record(iteration: int, last: bool, sql: str, before: str | None, result: ExecutionResult, outcomes: list[verify.Outcome] | None) -> dict:
    """What one round of execution and verification saw; what was sent to a fixer is added where one is asked."""
    return {
        "iteration": iteration, "is_final_assessment": last, "sql": (sql or "")[:500], "sql_full": sql or "", "sql_changed_from_previous": before is not None and sql != before,
        "exec_success": result.success, "exec_is_empty": result.is_empty, "exec_error": result.error, "exec_row_count": result.n_rows if result.success else None,
        "verif_ran": outcomes is not None, "verif_run_expensive": True, "verif_all_pass": None if outcomes is None else all(o.status != "fail" for o in outcomes),
        "verif_results": None if outcomes is None else [{"test_type": o.test_type, "status": o.status, "actual_outcome": o.message, "is_critical": o.is_critical} for o in outcomes],
        "exec_issues_sent": None, "verif_issues_sent": None, "fix_triggered": False, "fix_produced_different_sql": None,
    }


def fix_all(catalog: Catalog, candidates: list[tuple[int, int, str, str]], specs: dict[int, list[verify.Spec]], fixer=None, threads: int = 4, timeout: float = 30.0) -> list[Fixed]:
    """All candidates ``(question, pos, generator, sql)``, a few at a time; each runs in a job group of its own."""
    catalog.register()
    with ThreadPoolExecutor(threads) as pool:
        run = inheritable_thread_target(lambda c: fix_one(catalog, *c, specs.get(c[0], [verify.Spec("grain")]), fixer, timeout=timeout))
        return list(pool.map(run, candidates))


def candidate_frame(catalog: Catalog, fixed: list[Fixed]) -> DataFrame:
    """Fixed candidates as the table that the selection takes; results are keyed by the cluster relation's cells."""
    def text(x) -> str:
        if x is None:
            return "NULL"
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    rows = [(f.question_id, f.pos, f.generator_id, f.sql, f.result.success, f.result.is_empty, f.result.n_rows, f.n_fixes, float(f.adjustment), f.result.key, None if f.result.key else [[text(x) for x in r] for r in f.result.rows]) for f in fixed]
    frame = catalog.spark.createDataFrame(rows, "question_id int, pos int, generator_id string, sql string, success boolean, is_empty boolean, n_rows long, n_fixes int, adjustment double, key string, rows array<array<string>>")
    return frame.withColumn("result_key", F.coalesce("key", equivalence.result_key(F.col("rows")))).drop("key", "rows")


def answer(questions: DataFrame, a: Artifacts, model: Callable[[str], str] | None = None, fixer=None, judge=None, extra: DataFrame | None = None, grounder: Callable[[str], str] | None = None) -> DataFrame:
    """The chosen query of each question. ``extra (question_id, pos, generator_id, sql)`` adds candidates from elsewhere.

    ``grounder``, a text model too, extracts literals and selects fields; ``model`` writes the queries.
    """
    made = generate.generate(generate.prompts(contexts(questions, a, grounder)), model).select("question_id", "pos", "generator_id", "sql")
    made = made.unionByName(extra.select("question_id", "pos", "generator_id", "sql")) if extra is not None else made
    rows = [tuple(r) for r in made.orderBy("question_id", "pos").collect()]  # a few per question
    plans = {r.question_id: verify.specs_of(r) for r in verify.planned_tests(questions).collect()}
    fixed = fix_all(a.catalog, rows, plans, fixer)
    return select.choose(select.with_confidence(candidate_frame(a.catalog, fixed)), judge)


def execution_accuracy(catalog: Catalog, predicted: str, truth: str, relation: str = "strict", timeout: float = 30.0) -> bool:
    """Whether two queries give the same result; a blank or failing one never does. A query runs again only where its rows were too many to hold."""
    if not predicted or not predicted.strip():
        return False
    spark = catalog.register().spark
    results = [execute_sql(spark, q, timeout) for q in (predicted, truth)]
    if not all(r.success for r in results):
        return False
    frames = [spark.sql(q) for q in (predicted, truth)]
    a, b = (f if r.truncated else spark.createDataFrame(r.rows, f.schema) for f, r in zip(frames, results, strict=True))
    return bool(equivalence.equivalent(a, b, relation).head()[0])
