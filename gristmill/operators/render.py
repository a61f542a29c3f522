"""Summaries of columns, and schemas as DDL and Markdown, put together by ordered aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import fixed, quote_name, truncate

SHORT, LONG, BATCH = 200, 1000, 6
DDL_SUMMARY, DDL_SAMPLE, MARKDOWN_SAMPLE, MARKDOWN_SAMPLES = 120, 50, 30, 3


def default_summary():
    return F.format_string("The %s field in the %s table.", "column", "table")


def summary_prompt():
    """What a text model is told of a column: its type, nulls, distinct values, samples and range."""
    samples = F.array_join(F.transform(F.slice("top_values", 1, 5), lambda x: x["value"]), ", ")
    spread = F.when(F.col("avg_value").isNotNull(), F.format_string("min %s, max %s, mean %s", F.col("min_value"), F.col("max_value"), fixed("avg_value", 2)))
    length = F.when(F.col("avg_length").isNotNull(), F.concat(F.lit("mean length "), fixed("avg_length", 1)))
    nulls = F.concat(F.lit("nulls "), fixed(F.col("null_rate") * 100, 1), F.lit("%"))
    return F.concat_ws("; ", F.concat_ws(".", "table", "column"), "affinity", nulls, F.concat(F.lit("distinct "), F.col("distinct_count")), F.concat(F.lit("values "), samples), F.coalesce(spread, length))


def summarize(profile: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """``table, column, short_summary, long_summary`` of each column.

    A model gets prompts of one table, six at a time; where it fails on a batch it gets them one by one, and where it
    fails on one, or there is none, the default sentence stands.
    """
    base = profile.select("table", "column", "ordinal", default_summary().alias("default"), summary_prompt().alias("prompt"), F.floor(F.col("ordinal") / BATCH).alias("batch"))
    if model is None:
        text = base.withColumn("text", F.col("default"))
    else:
        ask = model

        def answers(prompts: list[str]) -> list[str | None]:
            try:
                out = ask(prompts)
                if len(out) == len(prompts):
                    return list(out)
            except Exception:  # a model may fail in any way; each column is then asked alone
                pass
            return [None] if len(prompts) == 1 else [x for p in prompts for x in answers([p])]

        def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in groups:
                for _, part in pdf.groupby(["table", "batch"], sort=False):
                    said = answers(part["prompt"].tolist())
                    yield part.assign(text=[s or d for s, d in zip(said, part["default"], strict=True)])[["table", "column", "ordinal", "default", "prompt", "batch", "text"]]

        text = base.repartition("table", "batch").sortWithinPartitions("table", "batch", "ordinal").mapInPandas(run, "table string, column string, ordinal int, default string, prompt string, batch long, text string")
    return text.select("table", "column", F.substring("text", 1, SHORT).alias("short_summary"), F.substring("text", 1, LONG).alias("long_summary"))


def _with_summaries(profile: DataFrame, summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    return profile.join(summaries, ["table", "column"], "left").withColumn("n_columns", F.count(F.lit(1)).over(Window.partitionBy(*by, "table")))


def ddl(profile: DataFrame, summaries: DataFrame, foreign_keys: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``table, block``: a CREATE TABLE of each table with comments on columns, foreign keys and an example row.

    ``by`` names columns of the profile that tell schemas apart, as of different questions; foreign keys are then those of columns shown.
    """
    named = quote_name(F.col("column"))
    about = F.concat_ws(" | ", F.when(F.coalesce("long_summary", F.lit("")) != "", truncate(F.col("long_summary"), DDL_SUMMARY)), F.concat(F.lit("FK → "), F.col("foreign_key")))
    comma = F.when(F.col("ordinal") < F.col("n_columns") - 1, ",").otherwise("")
    line = F.concat(F.lit("  "), named, F.lit(" "), "affinity", F.when(F.col("is_primary_key"), " PRIMARY KEY").otherwise(""), comma, F.when(about != "", F.concat(F.lit("  -- "), about)).otherwise(""))
    sample = truncate(F.get("top_values", F.lit(0))["value"], DDL_SAMPLE)
    shown = F.coalesce(F.when(F.col("affinity").isin("TEXT", "BLOB"), F.concat(F.lit("'"), sample, F.lit("'"))).otherwise(sample), F.lit("NULL"))
    rows = _with_summaries(profile, summaries, by).select(*by, "table", F.struct("ordinal", line.alias("line"), shown.alias("shown")).alias("c"))
    tables = rows.groupBy(*by, "table").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    edges = foreign_keys.withColumnRenamed("from_table", "table")
    if by:
        edges = edges.join(profile.select(*by, "table", F.col("column").alias("from_column")), ["table", "from_column"])
    refs = edges.groupBy(*by, "table").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s REFERENCES %s(%s)", "from_column", "to_table", "to_column"))), ", ").alias("refs"))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("-- Table: "), "table"),
        F.concat(F.lit("CREATE TABLE "), quote_name(F.col("table")), F.lit(" (")),
        F.array_join(F.transform("cs", lambda c: c["line"]), "\n"),
        F.lit(");"),
        F.concat(F.lit("-- Foreign keys: "), "refs"),
        F.concat(F.lit("-- Example row: ("), F.array_join(F.transform("cs", lambda c: c["shown"]), ", "), F.lit(")")),
    )
    return tables.join(refs, [*by, "table"], "left").select(*by, "table", block.alias("block"))


def markdown(profile: DataFrame, summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``table, block``: a pipe table of each table's columns with types, descriptions and sample values; ``by`` as for ``ddl``."""
    short = F.btrim(F.coalesce("short_summary", F.lit("")))
    pipe = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    kind = F.concat(F.col("affinity"), F.when(F.col("is_primary_key"), " (PK)").otherwise(""), F.coalesce(F.concat(F.lit(" (FK→"), "foreign_key", F.lit(")")), F.lit("")))
    samples = F.array_join(F.transform(F.slice("top_values", 1, MARKDOWN_SAMPLES), lambda x: truncate(x["value"], MARKDOWN_SAMPLE)), ", ")
    line = F.format_string("| %s | %s | %s | %s |", pipe(F.col("column")), kind, pipe(F.when(short != "", F.col("short_summary")).otherwise(F.col("column"))), pipe(samples))
    rows = _with_summaries(profile, summaries, by).select(*by, "table", F.struct("ordinal", line.alias("line"), F.when(short != "", short).alias("about")).alias("c"))
    tables = rows.groupBy(*by, "table").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    about = F.coalesce(F.get(F.filter(F.transform("cs", lambda c: c["about"]), lambda s: s.isNotNull()), F.lit(0)), F.format_string("Data from %s table.", "table"))
    block = F.concat_ws("\n", F.concat(F.lit("## Table: "), "table"), F.concat(F.lit("*"), about, F.lit("*")), F.lit(""), F.lit("| Column | Type | Description | Sample Values |"), F.lit("|--------|------|-------------|---------------|"), F.array_join(F.transform("cs", lambda c: c["line"]), "\n"))
    return tables.select(*by, "table", block.alias("block"))


def whole_schema(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All blocks in order of the tables' names, a blank line between them, as one text (one for each value of ``by``)."""
    return blocks.groupBy(*by).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "block"))), lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("schema"))


def subset(profile: DataFrame, fields: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile's rows of the given fields, their ordinals counted anew within each table, in the order of the schema."""
    kept = profile.join(fields.select(*by, "table", "column").distinct(), ["table", "column"])
    return kept.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*by, "table").orderBy("ordinal")) - 1))


def parse_ddl(schemas: DataFrame, text_col: str = "schema") -> DataFrame:
    """``table, ordinal, column, affinity, is_primary_key, foreign_key`` of a schema text as ``ddl`` renders it; names may be quoted.

    For texts from elsewhere; what the engine renders itself it keeps as tables.
    """
    name = r'("(?:[^"]|"")+"|[A-Za-z0-9_]+)'
    unquoted = lambda c: F.when(c.startswith('"'), F.replace(F.expr("substring(n, 2, length(n) - 2)"), F.lit('""'), F.lit('"'))).otherwise(c)
    blocks = schemas.select(F.explode(F.regexp_extract_all(text_col, F.lit(rf"(?s)CREATE TABLE {name} \(\n(.*?)\n\);"), F.lit(0))).alias("b"))
    tables = blocks.select(F.regexp_extract("b", rf"CREATE TABLE {name}", 1).alias("n"), F.regexp_extract("b", r"(?s)\(\n(.*)\n\);", 1).alias("body"))
    lines = tables.select(unquoted(F.col("n")).alias("table"), F.posexplode(F.split("body", "\n")).alias("ordinal", "line"))
    parts = lines.select("table", "ordinal", "line", F.regexp_extract("line", rf"^  {name} ([A-Z]+)", 1).alias("n"), F.regexp_extract("line", rf"^  {name} ([A-Z]+)", 2).alias("affinity"))
    reference = F.regexp_extract("line", r"FK → (.+)$", 1)
    return parts.where("n <> ''").select("table", "ordinal", unquoted(F.col("n")).alias("column"), "affinity", F.col("line").rlike(r"^  .* PRIMARY KEY(?:,|  --|$)").alias("is_primary_key"), F.when(reference != "", reference).alias("foreign_key"))


def parse_markdown(schemas: DataFrame, text_col: str = "schema") -> DataFrame:
    """``table, ordinal, column, affinity, is_primary_key, foreign_key`` of a schema text as ``markdown`` renders it."""
    tables = schemas.select(F.explode(F.filter(F.split(text_col, r"(?m)^## Table: "), lambda t: t != "")).alias("t"))
    rows = tables.select(F.regexp_extract("t", r"^(.*?)\n", 1).alias("table"), F.posexplode(F.slice(F.regexp_extract_all("t", F.lit(r"(?m)^\| .*$"), F.lit(0)), 2, 1_000_000)).alias("ordinal", "line"))
    # A pipe inside a cell has a backslash before it.
    cells = rows.select("table", "ordinal", F.transform(F.split("line", r"(?<!\\)\|"), lambda c: F.btrim(F.replace(c, F.lit("\\|"), F.lit("|")))).alias("c"))
    kind = F.col("c")[2]
    reference = F.regexp_extract(kind, r"\(FK→(.+)\)", 1)
    return cells.select("table", "ordinal", F.col("c")[1].alias("column"), F.regexp_extract(kind, r"^[A-Z]+", 0).alias("affinity"), kind.contains("(PK)").alias("is_primary_key"), F.when(reference != "", reference).alias("foreign_key"))
