"""Schema linking: a precise and a wider subset of the fields, closed over keys and capped, as set operations.

Fields are rows ``(question_id, table, column)``; ``available`` has every field of the database, with its ``ordinal``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import json_fields, truncate
from gristmill.operators.ground import TextModel, ask

FIELD = ["question_id", "table", "column"]
CANDIDATES, FALLBACK, S1_CAP = 50, 15, 20
S2_EXTRA, S2_CAP, COVERAGE, LEAST_LEFT = 10, 25, 0.8, 3
EVIDENCE_CHARS = 500


def candidate_fields(ranked: DataFrame, available: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``question_id, table, column, rank``: the best of ``ranked`` that are available, each once, then hinted columns.

    ``ranked`` has a ``rank`` per question. ``hints (question_id, hint)`` adds available columns of that name, whatever
    the case, after the others in the order of the schema.
    """
    first = ranked.where(F.col("rank") <= CANDIDATES).join(available.select("table", "column").distinct(), ["table", "column"], "left_semi")
    once = first.groupBy(*FIELD).agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "table", "column"))
    once = once.select(*FIELD, place.alias("rank"))
    if hints is None:
        return once
    named = hints.select("question_id", F.lower("hint").alias("hint")).distinct()
    more = available.join(named, F.lower(available["column"]) == named["hint"]).select("question_id", "table", "column", "ordinal").join(once, FIELD, "left_anti")
    count = once.groupBy("question_id").agg(F.max("rank").alias("have"))
    after = F.row_number().over(Window.partitionBy("question_id").orderBy("table", "ordinal", "column"))
    return once.unionByName(more.join(count, "question_id", "left").select(*FIELD, (F.coalesce("have", F.lit(0)) + after).alias("rank")))


def first_fields(candidates: DataFrame, n: int = FALLBACK) -> DataFrame:
    """The selection that needs no model: the first ``n`` candidates."""
    return candidates.where(F.col("rank") <= n).select(*FIELD)


def known_fields(selected: DataFrame, available: DataFrame) -> DataFrame:
    """Selected fields that exist, in the same spelling."""
    return selected.join(available.select("table", "column").distinct(), ["table", "column"], "left_semi").select(*FIELD).distinct()


def unknown_fields(selected: DataFrame, available: DataFrame) -> DataFrame:
    return selected.join(available.select("table", "column").distinct(), ["table", "column"], "left_anti").select(*FIELD).distinct()


def with_primary_keys(selected: DataFrame, keys: DataFrame) -> DataFrame:
    """The selection with every primary key of every table in it."""
    tables = selected.select("question_id", "table").distinct()
    return selected.select(*FIELD).union(tables.join(keys, "table").select(*FIELD)).distinct()


def with_foreign_keys(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """The selection with each selected table's own foreign keys, and what they refer to where that table is selected; one step only."""
    tables = selected.select("question_id", "table").distinct()
    own = tables.join(edges, tables["table"] == edges.from_table)
    local = own.select("question_id", F.col("from_table").alias("table"), F.col("from_column").alias("column"))
    there = tables.select(F.col("question_id").alias("_q"), F.col("table").alias("_t"))
    both = own.join(there, (own.question_id == there["_q"]) & (own.to_table == there["_t"]), "left_semi")
    remote = both.select("question_id", F.col("to_table").alias("table"), F.col("to_column").alias("column"))
    return selected.select(*FIELD).union(local).union(remote).distinct()


def evidence_excerpt(evidence):
    """Evidence as a prompt of the linker shows it: its first 500 characters, with dots where more was cut."""
    return truncate(F.coalesce(evidence, F.lit("")), EVIDENCE_CHARS)


def _ranked(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    return selected.join(candidates.select(*FIELD, "rank"), FIELD, "left")


def cap_s1(selected: DataFrame, candidates: DataFrame, cap: int = S1_CAP) -> DataFrame:
    """At most ``cap`` fields per question: candidates by rank, then the others by name."""
    order = Window.partitionBy("question_id").orderBy(F.col("rank").asc_nulls_last(), "table", "column")
    return _ranked(selected, candidates).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).select(*FIELD)


def expansion_rule(s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """``question_id, n_candidates, n_s1, n_remaining, skip``: whether widening the selection is pointless.

    It is where there are no candidates, none or fewer than three are left, or the selection is as large as 80 % of them;
    its key fields count for that even where they are no candidates.
    """
    c = candidates.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    s = s1.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_s1"))
    left = candidates.join(s1, FIELD, "left_anti").groupBy("question_id").agg(F.count(F.lit(1)).alias("n_remaining"))
    zero = {n: F.coalesce(n, F.lit(0)).alias(n) for n in ("n_candidates", "n_s1", "n_remaining")}
    sums = c.join(s, "question_id", "full").join(left, "question_id", "left").select("question_id", *zero.values())
    coverage = F.col("n_s1") / F.greatest("n_candidates", F.lit(1))
    return sums.withColumn("skip", (F.col("n_candidates") == 0) | (F.col("n_remaining") < LEAST_LEFT) | (coverage >= COVERAGE))


def cap_s2(s2: DataFrame, s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """The wider selection: all of S1, then others by rank, at most ten more than S1 and 25 in all (but never less than S1)."""
    marked = s1.select(*FIELD, F.lit(0).alias("extra")).union(s2.select(*FIELD).join(s1, FIELD, "left_anti").distinct().select(*FIELD, F.lit(1)))
    per = Window.partitionBy("question_id")
    order = per.orderBy("extra", F.col("rank").asc_nulls_last(), "table", "column")
    sized = marked.join(candidates.select(*FIELD, "rank"), FIELD, "left").select("*", F.sum(1 - F.col("extra")).over(per).alias("n_s1"), F.row_number().over(order).alias("_n"))
    return sized.where((F.col("extra") == 0) | (F.col("_n") <= F.least(F.col("n_s1") + S2_EXTRA, F.lit(S2_CAP)))).select(*FIELD)


def _schema_row(available: DataFrame, keys: DataFrame, edges: DataFrame) -> DataFrame:
    """The database as one row of arrays: its fields in order, its primary keys and its foreign keys. As large as a schema is."""
    known = available.agg(F.array_sort(F.collect_list(F.struct("table", "ordinal", "column"))).alias("known"))
    primary = keys.agg(F.collect_set(F.struct("table", "column")).alias("keys"))
    foreign = edges.agg(F.collect_set(F.struct("from_table", "from_column", "to_table", "to_column")).alias("edges"))
    return known.join(primary).join(foreign)


def _field(table, column):
    return F.struct(F.coalesce(table, F.lit("")).alias("table"), F.coalesce(column, F.lit("")).alias("column"))


def _with_closure(rows: DataFrame, fields, into: str) -> DataFrame:
    """``rows`` with a column of an array of fields, the primary keys of its tables, and their foreign keys with what these refer to in its tables.

    Each array that a lambda asks for is a column of its own, as an expression inside a lambda would be evaluated for each element.
    """
    tables = F.array_distinct(F.transform(into, lambda x: x["table"]))
    rows = rows.withColumn(into, fields).withColumn("_t", tables)
    keyed = F.transform(F.filter("keys", lambda k: F.array_contains("_t", k["table"])), lambda k: _field(k["table"], k["column"]))
    rows = rows.withColumn(into, F.array_union(into, keyed)).withColumn("_own", F.filter("edges", lambda e: F.array_contains("_t", e["from_table"])))
    local = F.transform("_own", lambda e: _field(e["from_table"], e["from_column"]))
    remote = F.transform(F.filter("_own", lambda e: F.array_contains("_t", e["to_table"])), lambda e: _field(e["to_table"], e["to_column"]))
    return rows.withColumn(into, F.array_distinct(F.concat(into, local, remote))).drop("_t", "_own")


def _in_order(fields):
    """An array of fields, candidates by rank first, then the others by name."""
    place = lambda x: F.array_position("candidates", x).cast("long")
    keyed = F.transform(fields, lambda x: F.struct(F.coalesce(F.nullif(place(x), F.lit(0)), F.lit(1 << 40)).alias("place"), x["table"].alias("table"), x["column"].alias("column")))
    return F.transform(F.array_sort(keyed), lambda x: _field(x["table"], x["column"]))


def link(ranked: DataFrame, available: DataFrame, keys: DataFrame, edges: DataFrame, hints: DataFrame | None = None, chosen: DataFrame | None = None, promoted: DataFrame | None = None, wider: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 and S2 of each question. ``chosen`` and ``wider`` are a model's selections; without them S1 is the first candidates and S2 is S1.

    What is known of a question is brought together once, as arrays of a few dozen fields, next to one row that holds the
    schema; the rules above then are array expressions, and nothing is exchanged again.
    """
    parts = [ranked.where(F.col("rank") <= CANDIDATES).select("question_id", F.lit("ranked").alias("kind"), F.col("rank").cast("int").alias("rank"), "table", "column")]
    if hints is not None:
        parts.append(hints.select("question_id", F.lit("hint"), F.lit(0), F.lit(""), F.lower("hint")))
    parts += [df.select("question_id", F.lit(kind), F.lit(0), "table", "column") for kind, df in (("chosen", chosen), ("promoted", promoted), ("wider", wider)) if df is not None]
    rows = reduce(DataFrame.union, parts).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "table", "column", "kind"))).alias("rows"))
    rows = rows.join(F.broadcast(_schema_row(available, keys, edges))).withColumn("fields", F.transform("known", lambda x: _field(x["table"], x["column"])))

    def of(kind: str):
        """The question's rows of a kind that are fields of the database, each once, in order of rank."""
        return F.array_distinct(F.filter(F.transform(F.filter("rows", lambda x: x["kind"] == kind), lambda x: _field(x["table"], x["column"])), lambda x: F.array_contains("fields", x)))

    rows = rows.withColumn("hinted", F.transform(F.filter("rows", lambda x: x["kind"] == "hint"), lambda x: x["column"]))
    named = F.filter("fields", lambda x: F.array_contains("hinted", F.lower(x["column"])))
    rows = rows.withColumn("candidates", of("ranked"))
    rows = rows.withColumn("candidates", F.concat("candidates", F.array_except(named, "candidates"))) if hints is not None else rows
    rows = _with_closure(rows, of("chosen") if chosen is not None else F.slice("candidates", 1, FALLBACK), "closed")
    rows = rows.withColumn("closed", F.array_union("closed", of("promoted"))) if promoted is not None else rows
    rows = rows.withColumn("s1", F.slice(_in_order(F.col("closed")), 1, S1_CAP))
    s1 = rows.select("question_id", F.inline("s1"))
    if wider is None:
        return s1, s1
    left, n, n_s1 = F.size(F.array_except("candidates", "s1")), F.size("candidates"), F.size("s1")
    skip = (n == 0) | (left < LEAST_LEFT) | (n_s1 / F.greatest(n, F.lit(1)) >= COVERAGE)
    rows = rows.withColumn("added", F.when(skip, F.slice("fields", 1, 0)).otherwise(of("wider")))
    rows = _with_closure(rows, F.array_union("added", "s1"), "more")
    rows = rows.withColumn("more", F.when(F.size("added") > 0, F.array_except("more", "s1")).otherwise(F.slice("fields", 1, 0)))
    room = F.greatest(F.least(n_s1 + S2_EXTRA, F.lit(S2_CAP)) - n_s1, F.lit(0))
    return s1, rows.select("question_id", F.inline(F.concat("s1", F.slice(_in_order(F.col("more")), F.lit(1), room))))


def field_prompt(wider: bool = False):
    """What a model is told that selects fields: the question, an excerpt of its evidence, and the fields to choose from (``listed``)."""
    task = "Which of these further fields might the answer need as well?" if wider else "Which of these fields does the answer need?"
    return F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Evidence: "), evidence_excerpt(F.col("evidence"))), F.lit("Fields:"), F.array_join("listed", "\n"), F.lit(task + ' Answer with a JSON list of {"table": ..., "column": ...}.'))


def ask_fields(questions: DataFrame, fields: DataFrame, summaries: DataFrame, model: TextModel, wider: bool = False) -> tuple[DataFrame, DataFrame]:
    """``question_id, table, column`` that a model selects for each question of ``fields`` (ranked), and the questions on which it fails."""
    line = F.concat(F.lit("- "), F.concat_ws(".", "table", "column"), F.coalesce(F.concat(F.lit(": "), "short_summary"), F.lit("")))
    lists = fields.join(summaries, ["table", "column"], "left").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("r"))
    rows = questions.select("question_id", "question", "evidence").join(lists.select("question_id", F.transform("r", lambda x: x["line"]).alias("listed")), "question_id")
    said = ask(rows, field_prompt(wider), model).persist()  # a model is asked once, though its answers are used in several places
    chosen = said.where("answer IS NOT NULL").select("question_id", F.inline(json_fields(F.col("answer"))))
    return chosen.where("table IS NOT NULL AND column IS NOT NULL"), said.where("answer IS NULL").select("question_id")


def link_with(model: TextModel, questions: DataFrame, ranked: DataFrame, available: DataFrame, summaries: DataFrame, keys: DataFrame, edges: DataFrame, hints: DataFrame | None = None, promoted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 and S2 by a model: asked for the fields that a question needs, then for more among the rest. Where it fails S1 is the first candidates, and S2 S1."""
    candidates = candidate_fields(ranked, available, hints)
    chosen, failed = ask_fields(questions, candidates, summaries, model)
    chosen = chosen.union(first_fields(candidates).join(failed, "question_id", "left_semi").select(*FIELD))
    s1, _ = link(ranked, available, keys, edges, hints, chosen, promoted)
    wider, _ = ask_fields(questions, candidates.join(s1, FIELD, "left_anti"), summaries, model, wider=True)
    return link(ranked, available, keys, edges, hints, chosen, promoted, wider)


def sorted_fields(fields: DataFrame) -> DataFrame:
    """``question_id, fields``: each question's fields as a sorted list."""
    return fields.groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("fields"))
