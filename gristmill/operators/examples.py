"""Worked examples: questions as skeletons, found by similarity among those of other databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import mask_question
from gristmill.operators.vectors import clipped, embed_texts, nearest

TOP_K = 8
#: Digits after the point to which cosines of examples compare, so that equal vectors tie wherever their product was computed.
DIGITS = 12


def build_examples(questions: DataFrame) -> DataFrame:
    """``questions`` with ``skeleton`` and its ``embedding``; no questions are an error, as there is nothing to search.

    Each skeleton is embedded once.
    """
    if questions.limit(1).count() == 0:
        raise ValueError("no questions to build examples from")
    rows = questions.withColumn("skeleton", mask_question(F.col("question")))
    units = embed_texts(rows.select(F.col("skeleton").alias("_s")).distinct(), "_s")
    return rows.join(units, rows.skeleton.eqNullSafe(units["_s"])).drop("_s")


def similar_examples(questions: DataFrame, examples: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """For each question the ``top_k`` examples of other databases of highest similarity, by rank; of equal ones the least ids.

    Examples of the question's own database are left out before the ranking, so that they never take another's place.
    Questions of one skeleton and database have the same answer, so each such class is asked once, and answered by classes
    of examples: the best ``top_k`` rows lie in the best ``top_k`` classes, ordered by cosine and their least id, and are among the
    ``top_k`` least ids of each. Classes are embedded here, whatever embedding the examples bring. What is compared grows with the number of classes, not of questions.
    """
    key = ["skeleton", "db_id"]
    asked = questions.where("question_id IS NOT NULL").select(F.col("question_id").alias("query_id"), mask_question(F.col("question")).alias("skeleton"), "db_id").distinct()
    queries = embed_texts(asked.groupBy(*key).agg(F.min("query_id").alias("question_id")), "skeleton")
    order = Window.partitionBy(*key).orderBy("question_id")
    least = examples.where("question_id IS NOT NULL").select("question_id", *key).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_k)
    classes = least.groupBy(*key).agg(F.min("question_id").alias("question_id"), F.collect_list("question_id").alias("_ids"))
    held = embed_texts(classes.select("question_id", *key), "skeleton")
    near = nearest(queries, held, top_k, "question_id", exclude_same="db_id", digits=DIGITS).select("query_id", "question_id", "cosine")
    rows = near.join(classes.select("question_id", "_ids"), "question_id").select(F.col("query_id").alias("_class"), "cosine", F.explode("_ids").alias("question_id"))
    best = Window.partitionBy("_class").orderBy(F.desc("cosine"), "question_id")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    found = ranked.join(examples.drop("embedding"), "question_id").withColumnRenamed("question_id", "example_id")
    found = found.withColumn("similarity_score", clipped())
    answers = found.select("_class", *[c for c in found.columns if c not in ("_class", "cosine")])
    of = queries.select(F.col("question_id").alias("_of"), *[F.col(c).alias(f"_{c}") for c in key])
    each = asked.join(of, asked.skeleton.eqNullSafe(of["_skeleton"]) & asked.db_id.eqNullSafe(of["_db_id"])).select(F.col("query_id").alias("question_id"), "_of")
    return each.join(answers, F.col("_of") == F.col("_class")).drop("_of", "_class")
