"""Confidence of candidates, clusters of equal results, and the choice between clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import is_aggregation

# Candidates: question_id, pos, generator_id, sql, success, is_empty, n_rows, n_fixes, adjustment, result_key.


def raw_confidence() -> Column:
    """0 for failed or empty results; else 1, half more for a plausible number of rows, half less for each fix, and the checks' adjustment."""
    plausible = F.when(is_aggregation(F.col("sql")), F.col("n_rows") == 1).otherwise(F.col("n_rows").between(1, 100))
    score = 1.0 + F.when(plausible, 0.5).otherwise(0.0) - 0.5 * F.col("n_fixes") + F.col("adjustment")
    return F.when(~F.col("success") | F.col("is_empty"), F.lit(0.0)).otherwise(score)


def with_confidence(candidates: DataFrame, drop_least: bool = True) -> DataFrame:
    """``candidates`` with ``raw_confidence`` and ``confidence``, scaled to [0, 1] among a question's positive ones.

    The least positive one becomes 0, and so leaves the choice; ``drop_least=False`` gives it half of the next instead.
    """
    per = Window.partitionBy("question_id")
    scored = candidates.withColumn("raw_confidence", raw_confidence())
    raw = F.col("raw_confidence")
    low, high = F.min(F.when(raw > 0, raw)).over(per), F.max(F.when(raw > 0, raw)).over(per)
    scaled = scored.select("*", low.alias("_low"), high.alias("_high"))
    share = (raw - F.col("_low")) / (F.col("_high") - F.col("_low"))
    out = scaled.withColumn("confidence", F.when(raw <= 0, 0.0).when(F.col("_high") == F.col("_low"), 1.0).otherwise(share))
    if not drop_least:
        above = F.min(F.when(F.col("confidence") > 0, F.col("confidence"))).over(per)
        out = out.withColumn("confidence", F.when((raw > 0) & (F.col("confidence") == 0), above / 2).otherwise(F.col("confidence")))
    return out.drop("_low", "_high")


def generator_rank(generator: Column) -> Column:
    """Reasoning first, then complex, then in-context, then the rest."""
    g = F.lower(generator)
    return F.when(g.startswith("reasoning"), 0).when(g.contains("b2") | g.startswith("complex"), 1).when(g.startswith("icl"), 2).otherwise(3)


def with_clusters(candidates: DataFrame) -> DataFrame:
    """Executable candidates with their cluster: the same result, or alone if failed. ``cluster_key`` names it, ``cluster_size`` counts it."""
    alone = F.concat(F.lit("failed:"), F.col("generator_id"), F.lit(":"), F.col("pos"))
    live = candidates.where("confidence > 0").withColumn("cluster_key", F.when(F.col("success"), F.col("result_key")).otherwise(alone))
    of = Window.partitionBy("question_id", "cluster_key")
    return live.select("*", F.count(F.lit(1)).over(of).alias("cluster_size"), F.min("pos").over(of).alias("first_pos"), F.min(F.col("is_empty").cast("int")).over(of).alias("all_empty"))


def representatives(clustered: DataFrame) -> DataFrame:
    """One candidate per cluster: of highest confidence, then shortest SQL, then first; with ``cluster_order``.

    Clusters with rows come before empty ones, larger before smaller, then by generator, then by first place.
    """
    best = Window.partitionBy("question_id", "cluster_key").orderBy(F.desc("confidence"), F.length("sql"), "pos")
    reps = clustered.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("generator_rank", generator_rank(F.col("generator_id")))
    order = Window.partitionBy("question_id").orderBy("all_empty", F.desc("cluster_size"), "generator_rank", "first_pos")
    return reps.withColumn("cluster_order", F.row_number().over(order))


def tournament_pairs(reps: DataFrame) -> DataFrame:
    """Every two clusters of a question, the higher ordered as A: ``question_id, a, b`` and their SQL; 55 pairs of 11 clusters at most."""
    a = reps.select("question_id", F.col("cluster_order").alias("a"), F.col("sql").alias("sql_a"))
    b = reps.select(F.col("question_id").alias("_q"), F.col("cluster_order").alias("b"), F.col("sql").alias("sql_b"))
    return a.join(b, (a.question_id == b["_q"]) & (F.col("a") < F.col("b"))).drop("_q")


def verdict(answer: Column) -> Column:
    """A or B of an answer's first ``FINAL: A``; A if it says neither."""
    said = F.regexp_extract(F.upper(answer), r"FINAL:\s*([AB])", 1)
    return F.when(said == "B", "B").otherwise("A")


def tournament(reps: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``reps`` with ``wins``. ``judge`` adds an ``answer`` to the pairs; without one the higher ordered wins."""
    pairs = tournament_pairs(reps)
    judged = (judge(pairs) if judge else pairs.withColumn("answer", F.lit("FINAL: A"))).withColumn("won", F.when(verdict(F.col("answer")) == "A", F.col("a")).otherwise(F.col("b")))
    wins = judged.groupBy("question_id", F.col("won").alias("cluster_order")).agg(F.count(F.lit(1)).alias("wins"))
    return reps.join(wins, ["question_id", "cluster_order"], "left").withColumn("wins", F.coalesce("wins", F.lit(0)))


def choose(candidates: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``question_id, sql, generator_id, method, confidence, cluster_count`` of every question.

    Fewer than two executable candidates: fallback to the one of most confidence (the first of equal ones). One cluster: the
    fast path takes its shortest SQL. Else the tournament's wins decide, then size, confidence, generator and order.
    """
    clustered = with_clusters(candidates)
    counts = clustered.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_live"), F.count_distinct("cluster_key").alias("cluster_count"))
    asked = candidates.select("question_id").distinct().join(counts, "question_id", "left")
    method = F.when(F.coalesce("n_live", F.lit(0)) < 2, "fallback").when(F.col("cluster_count") == 1, "fast_path").otherwise("tournament")
    asked = asked.select("question_id", method.alias("method"), F.coalesce("cluster_count", F.lit(0)).alias("cluster_count"))

    def first(df: DataFrame, *order) -> DataFrame:
        ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
        return ranked.where("_n = 1").select("question_id", "sql", "generator_id", "confidence")

    of = lambda m: asked.where(F.col("method") == m)
    played = tournament(representatives(clustered), judge)
    parts = {
        "fallback": first(candidates, F.desc("confidence"), "pos"),
        "fast_path": first(clustered, F.length("sql"), "pos"),
        "tournament": first(played, F.desc("wins"), F.desc("cluster_size"), F.desc("confidence"), "generator_rank", "cluster_order"),
    }
    out = None
    for name, chosen in parts.items():
        rows = of(name).join(chosen, "question_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def preview(df: DataFrame, rows: int = 5, width: int = 20) -> str:
    """The first rows of a result as text, cells cut at ``width`` characters, with a note where there are more."""
    found = df.limit(rows + 1).collect()
    show = [["NULL" if x is None else str(x)[:width] for x in r] for r in found[:rows]]
    lines = [" | ".join(df.columns), *(" | ".join(r) for r in show)]
    return "\n".join([*lines, f"... more than {rows} rows"] if len(found) > rows else lines)
