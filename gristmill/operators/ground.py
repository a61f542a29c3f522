"""Grounding a question: its keywords, the cell values they resemble, and similar worked examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import keywords, query_terms, sanitize
from gristmill.operators.examples import similar_examples
from gristmill.operators.values import search_values

#: A text model: takes a prompt, gives a text. None everywhere means the deterministic way.
TextModel = Callable[[str], str]


def ask(rows: DataFrame, prompt, model: TextModel, into: str = "answer") -> DataFrame:
    """``rows`` with what a text model says to each prompt; null where it fails in any way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def say(text: str) -> str | None:
            try:
                return model(text)
            except Exception:  # a model may fail in any way; the caller then takes its deterministic way
                return None

        for pdf in batches:
            yield pdf.assign(**{into: [say(p) for p in pdf["_prompt"]]}).drop(columns="_prompt")

    return rows.withColumn("_prompt", prompt).mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def literals(questions: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``question_id, literals, references``: values that a question may mean, and names it may give to parts of the schema.

    A model is asked for both as JSON; what is no list counts as empty. Without one, or where it fails, both are the keywords of
    question and evidence (None if there is none).
    """
    evidence = F.when(F.coalesce("evidence", F.lit("")) == "", F.lit("None")).otherwise(F.col("evidence"))
    words = keywords(F.concat_ws(" ", sanitize(F.col("question")), sanitize(evidence)))
    if model is None:
        return questions.select("question_id", words.alias("literals"), words.alias("references"))
    prompt = F.concat_ws("\n", F.lit('Give as JSON {"literals": [...], "references": [...]} the values that this question looks for, and the names of tables or columns that it uses.'), F.concat(F.lit("Question: "), sanitize(F.col("question"))), F.concat(F.lit("Evidence: "), sanitize(evidence)))
    said = ask(questions.select("question_id", "question", "evidence", words.alias("words")), prompt, model).persist()  # asked once
    body = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    none = F.array().cast("array<string>")

    def listed(name: str):
        found = F.filter(F.from_json(F.get_json_object(body, f"$.{name}"), "array<string>"), lambda x: x.isNotNull() & (x != ""))
        return F.when(F.col("answer").isNull(), F.col("words")).otherwise(F.coalesce(found, none)).alias(name)

    return said.select("question_id", listed("literals"), listed("references"))


def search_terms(found: DataFrame) -> DataFrame:
    """``query_id, keyword, term_pos``: each literal, and the longer words of those of several words."""
    return found.select(F.col("question_id").alias("query_id"), F.posexplode(query_terms(F.col("literals"))).alias("term_pos", "keyword"))


def best_per_column(matches: DataFrame) -> DataFrame:
    """One match per question, table and column: that of highest similarity; of equal ones the earlier term's, then the higher ranked."""
    order = Window.partitionBy("query_id", "table", "column").orderBy(F.desc("similarity_score"), "term_pos", "rank")
    return matches.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ground(questions: DataFrame, values: DataFrame, examples: DataFrame | None = None, top_k: int = 5, model: TextModel | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Matched cells, literals with schema references, and worked examples of each question."""
    found = literals(questions, model)
    terms = search_terms(found)
    matches = search_values(terms.select("query_id", "keyword").distinct(), values, top_k)
    cells = best_per_column(matches.join(terms, ["query_id", "keyword"]))
    return cells, found, similar_examples(questions, examples) if examples is not None else None
