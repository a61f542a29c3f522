"""Guarded execution of one SQL query: a time limit, a row limit, no writes, and errors as values."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.equivalence import canonical_rows

#: Rows from which a query without LIMIT counts as a product that nobody wanted.
MOST_ROWS, TIMEOUT = 10_000, 30.0
_LIMIT = re.compile(r"\bLIMIT\b", re.IGNORECASE)
# Words that no verification query may hold.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "ATTACH")


@dataclass
class ExecutionResult:
    success: bool
    rows: list[tuple[Any, ...]] = field(default_factory=list)
    error: str | None = None
    execution_time: float = 0.0
    is_empty: bool = False
    columns: list[str] = field(default_factory=list)
    condition: str | None = None
    #: Rows of the whole result; where it is truncated ``rows`` holds the first of them and ``key`` stands for all.
    n_rows: int = 0
    truncated: bool = False
    key: str | None = None


class NotAQuery(ValueError):
    """The statement would change something."""


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether a statement only reads: its parsed plan has no command anywhere."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    return not any(re.search(r"Command|^(Create|Drop|Alter|Insert|Delete|Update|Merge|Replace|Truncate|Refresh|Set|Use|Cache|Uncache|Load|Analyze|Add|Repair|Recover|Overwrite|Append)", n) for n in _node_names(plan))


def _node_names(plan) -> list[str]:
    names, todo = [], [plan]
    while todo:
        node = todo.pop()
        names.append(node.nodeName())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return names


def is_safe_verification_sql(sql: str) -> bool:
    """A text that begins with SELECT and holds none of the forbidden words, even inside names."""
    s = sql.strip().upper()
    return s.startswith("SELECT") and not any(w in s for w in FORBIDDEN)


def safe_verification_sql(sql: Column) -> Column:
    s = F.upper(F.btrim(sql))
    return s.startswith("SELECT") & ~s.rlike("|".join(FORBIDDEN))


def execute_sql(spark: SparkSession, sql: str, timeout: float = TIMEOUT, most_rows: int = MOST_ROWS) -> ExecutionResult:
    """Run one query; whatever happens is a result, never an exception.

    Never more than ``most_rows`` and one rows come to the driver. A query that has more fails if LIMIT is nowhere in its
    text. Otherwise it succeeds and is ``truncated``: its rows are counted and made into a key where they are, so that
    comparisons are of the whole result. After ``timeout`` seconds its jobs are cancelled; the session stays usable.
    """
    began, group = time.time(), f"gristmill-{uuid.uuid4().hex}"
    context, late = spark.sparkContext, threading.Event()

    def stop() -> None:
        late.set()
        while not done.wait(0.05):
            context.cancelJobGroup(group)  # again, in case its next job began meanwhile

    done = threading.Event()
    timer = threading.Timer(timeout, stop)
    timer.daemon = True
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    context.setJobGroup(group, sql[:80], interruptOnCancel=True)
    timer.start()
    try:
        if not is_query(spark, sql):
            raise NotAQuery("only queries are executed")
        df = spark.sql(sql)
        rows = [tuple(r) for r in df.limit(most_rows + 1).collect()]
        n_rows, key = len(rows), None
        if len(rows) > most_rows and _LIMIT.search(sql):
            n_rows, key = whole_key(df)
        if late.is_set():
            raise TimeoutError
    except Exception as e:
        if late.is_set():
            return ExecutionResult(False, error=f"Query timed out after {timeout}s", execution_time=time.time() - began)
        condition = e.getCondition() if isinstance(e, PySparkException) else None
        return ExecutionResult(False, error=str(e), execution_time=time.time() - began, condition=condition)
    finally:
        timer.cancel()
        done.set()
        for k, v in before.items():
            context.setLocalProperty(k, v)
    took = time.time() - began
    if len(rows) > most_rows and key is None:
        return ExecutionResult(False, error=f"Query returned over {most_rows} rows without LIMIT; a join condition may be missing", execution_time=took)
    return ExecutionResult(True, rows[:most_rows], None, took, not rows, df.columns, n_rows=n_rows, truncated=len(rows) > most_rows, key=key)


def whole_key(df: DataFrame) -> tuple[int, str]:
    """The number of rows of a result and a key that is the same for the same multiset of rows, from one aggregation over it."""
    rows = canonical_rows(df, "cluster").select(*[F.xxhash64("row", F.lit(s)).cast("decimal(20,0)").alias(f"h{s}") for s in range(2)])
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("h0").alias("a"), F.sum("h1").alias("b")).head()
    return r.n, f"{len(df.columns)}:{r.n}:{r.a}:{r.b}"


# --- what went wrong -----------------------------------------------------------------------------------------------

# Parts of error messages, and Spark's error conditions, by kind of error.
_MESSAGES = {"schema": ("no such column", "no such table", "ambiguous column"), "type": ("datatype mismatch", "type mismatch", "cannot compare")}
_CONDITIONS = {"syntax": ("PARSE_",), "schema": ("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "AMBIGUOUS_REFERENCE", "UNRESOLVED_FIELD"), "type": ("DATATYPE_MISMATCH", "CAST_INVALID_INPUT", "INCOMPATIBLE_")}


def error_category(message: Column, is_empty: Column, condition: Column | None = None) -> Column:
    """empty_result, syntax, schema, type or other; an empty result comes first, then Spark's condition if there is one, then the message."""
    text, code = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(condition if condition is not None else F.lit(None).cast("string"), F.lit(""))
    out = F.when(is_empty, "empty_result")
    for kind, starts in _CONDITIONS.items():
        out = out.when(code.rlike("^(?:" + "|".join(starts) + ")"), kind)
    out = out.when(text.contains("syntax"), "syntax")
    for kind, parts in _MESSAGES.items():
        out = out.when(text.rlike("|".join(parts)), kind)
    return out.otherwise("other")


def fix_instruction(category: Column, message: Column) -> Column:
    """What to tell whoever mends the query."""
    name = F.regexp_extract(message, r"(?i)no such (?:column|table):\s*(\S+)", 1)
    what = F.lower(F.regexp_extract(message, r"(?i)no such (column|table):", 1))
    return (
        F.when(category == "syntax", F.concat(F.lit("Mend the syntax: "), message))
        .when((category == "schema") & (name != ""), F.format_string("There is no %s '%s'; take a name that the schema has.", what, name))
        .when(category == "schema", F.concat(F.lit("Take names that the schema has: "), message))
        .when(category == "type", F.concat(F.lit("Make the types agree: "), message))
        .when(category == "empty_result", F.lit("No row came back; the conditions or the join may be too strict."))
        .otherwise(F.concat(F.lit("Mend this error: "), F.coalesce(message, F.lit("unknown"))))
    )


def result_frame(spark: SparkSession, results: list[tuple[int, str, ExecutionResult]]) -> DataFrame:
    """Execution results of (question, candidate) as a table, cells as text."""
    rows = [(q, c, r.success, r.is_empty, r.error, r.condition, r.execution_time, [[None if x is None else str(x) for x in row] for row in r.rows]) for q, c, r in results]
    return spark.createDataFrame(rows, "question_id int, generator_id string, success boolean, is_empty boolean, error string, condition string, execution_time double, rows array<array<string>>")
