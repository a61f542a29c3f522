"""Candidate queries: eleven variants of prompts per question for a text model, as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import clean_sql

#: (generator, schema subset, format, style) of each candidate of a question.
VARIANTS = [
    ("reasoning_A1", "s1", "ddl", "minimal"),
    ("reasoning_A2", "s1", "ddl", "steps"),
    ("reasoning_A3", "s2", "ddl", "minimal"),
    ("reasoning_A4", "s2", "ddl", "steps"),
    ("standard_B1_s1", "s1", "markdown", "plain"),
    ("standard_B1_s2", "s2", "markdown", "plain"),
    ("complex_B2_s1", "s1", "markdown", "cte"),
    ("complex_B2_s2", "s2", "markdown", "cte"),
    ("icl_C1", "s2", "markdown", "examples"),
    ("icl_C2", "s2", "markdown", "examples_first"),
    ("icl_C3", "s2", "markdown", "examples_style"),
]
STYLES = {
    "minimal": "Answer with one query.",
    "steps": "Name tables, joins, filters, grouping and order one after the other, then write the query.",
    "plain": "Write the simplest query that is right.",
    "cte": "Use common table expressions, subqueries or window functions where they make the query clearer.",
    "examples": "Follow the examples.",
    "examples_first": "Say which example is nearest, then follow it.",
    "examples_style": "Keep to the examples' style.",
    "again": "Think of another way to reach the same answer.",
}
RULES = (
    "Select every column that the question asks for, and no other. Apply the value mappings that the evidence gives. "
    "Divide in the direction in which the question compares. Use DISTINCT only where uniqueness is asked for. "
    "Answer yes-or-no questions with 'YES' or 'NO'."
)
EXAMPLES, EXAMPLE_TOKENS = 6, 6000


def thinking_budget(n_tables: Column) -> Column:
    return F.when(n_tables <= 2, 4000).when(n_tables <= 4, 6000).otherwise(8000)


def trimmed_examples(examples: Column) -> Column:
    """At most six examples if all together pass 6000 tokens of four characters."""
    size = F.aggregate(examples, F.lit(0), lambda n, e: n + F.length(e))
    return F.when(F.floor(size / 4) > EXAMPLE_TOKENS, F.slice(examples, 1, EXAMPLES)).otherwise(examples)


def base_prompt() -> Column:
    """Question, evidence, matched cells and rules, from ``question, evidence, cells (array of struct)``."""
    cells = F.array_join(F.transform("cells", lambda c: F.format_string("- %s.%s = '%s'", c["table"], c["column"], c["matched_value"])), "\n")
    evidence = F.when(F.coalesce("evidence", F.lit("")) == "", "None").otherwise(F.col("evidence"))
    return F.concat_ws("\n", F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Evidence: "), evidence), F.when(F.size("cells") > 0, F.concat(F.lit("Values in the database:\n"), cells)), F.lit(RULES))


def variant_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *v) for i, v in enumerate(VARIANTS)], "pos int, generator_id string, schema_used string, schema_format string, style string")


def prompts(contexts: DataFrame) -> DataFrame:
    """``question_id, pos, generator_id, schema_used, schema_format, prompt, budget``: eleven rows per question.

    ``contexts`` has ``question_id, question, evidence, cells, examples (array of texts), s1_ddl, s1_markdown, s2_ddl, s2_markdown,
    same (whether S1 is S2), n_tables``. Where S1 is S2 the second of each pair of variants asks for another way.
    """
    variants = variant_frame(contexts.sparkSession)
    schema = F.when(F.col("schema_used") == "s1", F.when(F.col("schema_format") == "ddl", F.col("s1_ddl")).otherwise(F.col("s1_markdown"))).otherwise(F.when(F.col("schema_format") == "ddl", F.col("s2_ddl")).otherwise(F.col("s2_markdown")))
    style = F.create_map(*[x for k, v in STYLES.items() for x in (F.lit(k), F.lit(v))])
    repeated = F.col("same") & F.col("generator_id").endswith("_s2")
    ask = F.concat_ws(" ", style[F.col("style")], F.when(repeated, F.lit(STYLES["again"])))
    shots = F.when(F.col("style").startswith("examples"), F.array_join(trimmed_examples(F.col("examples")), "\n\n"))
    rows = contexts.join(F.broadcast(variants))
    budget = F.when(F.col("generator_id").startswith("reasoning"), thinking_budget(F.col("n_tables")))
    return rows.select("question_id", "pos", "generator_id", "schema_used", "schema_format", F.concat_ws("\n\n", schema, shots, base_prompt(), ask).alias("prompt"), budget.alias("budget"))


def generate(asked: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """``asked`` with ``sql`` and ``error_flag``. A model that fails, or none, gives an empty query with the flag, which goes on like any other."""
    if model is None:
        return asked.withColumn("sql", F.lit("")).withColumn("error_flag", F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answer(prompt: str) -> str | None:
            try:
                return model(prompt)
            except Exception:  # whatever a model raises, its candidate is flagged
                return None

        for pdf in batches:
            yield pdf.assign(answer=[answer(p) for p in pdf["prompt"]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    said = asked.mapInPandas(run, f"{fields}, answer string")
    sql = F.coalesce(clean_sql(F.col("answer")), F.lit(""))
    return said.withColumn("sql", sql).withColumn("error_flag", F.col("sql") == "").drop("answer")
