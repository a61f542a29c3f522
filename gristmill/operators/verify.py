"""Semantic checks of a result, as aggregations over it, and the score that their outcomes give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import direction_from_question, limit_from_question
from gristmill.operators.execute import is_safe_verification_sql

# Which tests are critical, and what their outcomes weigh.
CRITICAL = ("grain", "duplicate", "column_alignment")
TESTS = ("grain", "null", "duplicate", "ordering", "scale", "column_alignment", "symmetry", "boundary")
CRITICAL_PENALTY, MINOR_PENALTY, BONUS = -0.3, -0.1, 0.2
NUMBER = (int, float, Decimal)
NULL_SHARE, DUPLICATE_RATIO, SYMMETRY_SHARE, SYMMETRY_LEAST = 0.1, 2.0, 0.01, 0.01

# Fixed value: constructs that bound a date.
DATE_BOUND = (
    r"(?i)\b(BETWEEN|STRFTIME|JULIANDAY|DATE|DATETIME)\b"
    r"|[><=!]=?\s*['\"]?\d{4}[-/]"
    r"|\bLIKE\s+['\"]%?\d{4}%?['\"]"
    r"|\b\d{4}\s+AND\s+\d{4}\b"
)


@dataclass
class Spec:
    """One test of a plan; only what its type needs is set."""

    test_type: str
    lower: int | None = 1
    upper: int | None = None
    upper_sql: str | None = None
    confidence: str = "high"
    expected_columns: int | None = None
    check_columns: list[str] = field(default_factory=list)
    expected_sql: str | None = None
    keywords: list[str] = field(default_factory=list)
    order_limit: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    other_sql: str | None = None


@dataclass
class Outcome:
    test_type: str
    status: str  # pass, fail, skip or error
    message: str = ""

    @property
    def is_critical(self) -> bool:
        return self.test_type in CRITICAL


def _numeric(df: DataFrame) -> list[int]:
    return [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.NumericType | T.BooleanType)]


def _at(df: DataFrame, i: int) -> Column:
    return df[i]


def null_cells(df: DataFrame) -> DataFrame:
    """``n_rows, n_cells, n_nulls`` of a result."""
    nulls = sum((_at(df, i).isNull().cast("long") for i in range(len(df.columns))), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) * len(df.columns)).alias("n_cells"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """``n_rows, n_distinct`` of a result; rows are counted before they meet."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))


def scale_violations(df: DataFrame, minimum: float | None, maximum: float | None) -> DataFrame:
    """``n_violations``: numbers of a result outside the bounds."""
    return df.agg(F.coalesce(F.sum(_violations(df, minimum, maximum)), F.lit(0)).alias("n_violations"))


def _violations(df: DataFrame, minimum: float | None, maximum: float | None) -> Column:
    """How many numbers of a row are outside the bounds."""
    out = F.lit(0).cast("long")
    for i in _numeric(df):
        x = _at(df, i).cast("double")
        beyond = (x < minimum if minimum is not None else F.lit(False)) | (x > maximum if maximum is not None else F.lit(False))
        out = out + F.coalesce(beyond, F.lit(False)).cast("long")
    return out


def grain_bounds(n_rows: Column, lower: Column, upper: Column) -> Column:
    """pass or fail of a number of rows within bounds; a missing lower bound is 1, a missing upper bound none."""
    low = F.greatest(F.coalesce(lower, F.lit(1)), F.lit(0))
    high = F.when((upper == 0) & (low > 0), F.lit(None)).otherwise(upper)
    return F.when((n_rows >= low) & (high.isNull() | (n_rows <= high)), "pass").otherwise("fail")


def symmetric(a: Column, b: Column) -> Column:
    """Whether two numbers agree within 1 % of the first, or 0.01 if that is more."""
    return F.abs(a - b) <= F.greatest(F.abs(a) * SYMMETRY_SHARE, F.lit(SYMMETRY_LEAST))


def ordering_status(sql: Column, keywords: Column, order_limit: Column) -> Column:
    """fail if a keyword is missing from the SQL, or its LIMIT is less than asked for. Without keywords ORDER BY is one."""
    s = F.upper(sql)
    wanted = F.when(F.size(keywords) > 0, keywords).when(order_limit.isNotNull(), F.array(F.lit("ORDER BY"), F.lit("LIMIT"))).otherwise(F.array(F.lit("ORDER BY")))
    has = F.forall(wanted, lambda k: F.position(F.upper(k), s) > 0)
    limit = F.regexp_extract(s, r"\bLIMIT\s+(\d+)", 1)
    short = (limit != "") & order_limit.isNotNull() & (limit.try_cast("long") < order_limit)
    return F.when(~has | F.coalesce(short, F.lit(False)), "fail").otherwise("pass")


def has_date_bound(sql: Column) -> Column:
    return sql.rlike(DATE_BOUND)


def plan_from_question(questions: DataFrame) -> DataFrame:
    """The rule-based plan: ``question_id, order_limit, direction, wants_ordering, wants_boundary``; every plan has a grain test with one row at least."""
    q = F.col("question")
    limit, direction = limit_from_question(q), direction_from_question(q)
    return questions.select("question_id", limit.alias("order_limit"), direction.alias("direction"), (limit.isNotNull() | direction.isNotNull()).alias("wants_ordering"), q.rlike(r"\b(1[6-9]|20)\d\d\b").alias("wants_boundary"))


# Words of a question that call for a test.
ONE_NUMBER = r"(?i)\b(how many|number of|total|average|overall|sum of)\b"
BY_GROUP = r"(?i)\b(per|each|every|broken down by|grouped by)\b"
SPARSE = r"(?i)\b(names?|e-?mails?|address|addresses|phones?|descriptions?|websites?)\b"
LISTED = r"(?i)\b(list|show|find|return|give|which|who)\b"
SHARE = r"(?i)\b(percent|percentage|proportion|share)\b"


def planned_tests(questions: DataFrame) -> DataFrame:
    """The tests that the words of a question call for: ``question_id, one_row, least_rows, order_limit, wants_*``, by rules alone.

    A question for one number, not by group, has one row, whatever the query counts; one that names a number of rows has
    as many at least. Attributes that are often missing call for a test of nulls, lists of things for one of duplicates,
    percentages for one of scale, an order or superlative for one of ordering, a year for one of date bounds.
    """
    q = F.col("question")
    base = plan_from_question(questions).join(questions.select("question_id", "question"), "question_id")
    one_row = q.rlike(ONE_NUMBER) & ~q.rlike(BY_GROUP) & F.col("order_limit").isNull()
    return base.select(
        "question_id", one_row.alias("one_row"), F.coalesce("order_limit", F.lit(1)).alias("least_rows"), "order_limit", "wants_ordering", "wants_boundary",
        (q.rlike(SPARSE) & ~one_row).alias("wants_null"), (q.rlike(LISTED) & ~one_row).alias("wants_duplicate"), q.rlike(SHARE).alias("wants_scale"),
    )


def specs_of(plan: Row, upper_sql: str | None = None) -> list[Spec]:
    """The tests of one row of ``planned_tests``, the test of grain first. ``upper_sql`` counts what the question asks about, without conditions."""
    out = [Spec("grain", lower=plan.least_rows, upper_sql="SELECT 1" if plan.one_row else upper_sql, confidence="high" if plan.one_row else "low")]
    out += [Spec("null")] if plan.wants_null else []
    out += [Spec("duplicate")] if plan.wants_duplicate else []
    if plan.wants_ordering:
        out.append(Spec("ordering", keywords=["ORDER BY", *(["LIMIT"] if plan.order_limit else [])], order_limit=plan.order_limit))
    out += [Spec("scale", minimum=0, maximum=100)] if plan.wants_scale else []
    return out + ([Spec("boundary")] if plan.wants_boundary else [])


def adjustment(tests: DataFrame, keys: list[str]) -> DataFrame:
    """``adjustment, all_pass`` per candidate of ``tests (..., test_type, status)``.

    Each failed test costs 0.3 if critical, else 0.1. If none failed, errors aside, and one passed, 0.2 are added. A
    candidate passes unless a test failed.
    """
    failed = F.col("status") == "fail"
    cost = F.sum(F.when(failed & F.col("test_type").isin(*CRITICAL), CRITICAL_PENALTY).when(failed, MINOR_PENALTY).otherwise(0.0))
    none_failed, passed = F.coalesce(F.bool_and(F.when(F.col("status") != "error", ~failed)), F.lit(True)), F.coalesce(F.bool_or(F.col("status") == "pass"), F.lit(False))
    return tests.groupBy(*keys).agg((cost + F.when(none_failed & passed, BONUS).otherwise(0.0)).alias("adjustment"), F.bool_and(~failed).alias("all_pass"))


class Facts:
    """What the tests of one result ask of it, each found once and of the whole result."""

    def __init__(self, df: DataFrame, specs: list[Spec]):
        self.df, self._specs = df, specs

    @cached_property
    def counts(self) -> Row:
        """``n_rows, n_cells, n_nulls`` and the violations ``v0, v1, ...`` of each test of scale, from one aggregation."""
        df = self.df
        nulls = sum((_at(df, i).isNull().cast("long") for i in range(len(df.columns))), F.lit(0).cast("long"))
        beyond = [F.coalesce(F.sum(_violations(df, s.minimum, s.maximum)), F.lit(0)).alias(f"v{i}") for i, s in enumerate(self._specs) if s.test_type == "scale"]
        return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) * len(df.columns)).alias("n_cells"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls"), *beyond).head()

    @cached_property
    def distinct(self) -> Row:
        return exact_duplicates(self.df).head()

    def violations(self, spec: Spec) -> int:
        return self.counts[f"v{next(i for i, s in enumerate(self._specs) if s is spec)}"]


class Verifier:
    """Runs the tests of a plan on one query's whole result. Whatever fails inside a test is that test's error.

    ``judge``, a text model, is asked whether a query bounds its dates where its text does not show it; its failure is the test's error.
    """

    def __init__(self, spark: SparkSession, judge: Callable[[str], str] | None = None):
        self.spark, self.judge = spark, judge

    def evaluate(self, sql: str, specs: list[Spec]) -> list[Outcome]:
        """The outcome of each test; the result is read once for all counts, and once more if duplicates are asked for."""
        out, facts = [], None
        for spec in specs:
            try:
                facts = facts or Facts(self.spark.sql(sql), specs)
                out.append(Outcome(spec.test_type, *getattr(self, f"_{spec.test_type}")(sql, facts, spec)))
            except Exception as e:  # a test that cannot run says so
                out.append(Outcome(spec.test_type, "error", str(e)[:200]))
        return out

    def _number(self, sql: str | None) -> float | None:
        """The first cell of a safe query's first row, if it is a number."""
        if not sql or not is_safe_verification_sql(sql):
            return None
        row = self.spark.sql(sql).head()
        return float(row[0]) if row and isinstance(row[0], NUMBER) else None

    def _grain(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        if spec.confidence == "none":
            return "skip", "no bound is known"
        lower, n = max(1 if spec.lower is None else spec.lower, 0), facts.counts.n_rows
        upper = self._number(spec.upper_sql)
        if upper == 0 and lower > 0:
            upper = None
        if upper is None:
            upper = self._number(spec.expected_sql)
        if upper is None:
            upper = spec.upper
        if n < lower or (upper is not None and n > upper):
            return "fail", f"{n} rows, not {lower} to {upper}"
        columns = len(facts.df.columns)
        if n and spec.expected_columns is not None and columns != spec.expected_columns:
            return "fail", f"{columns} columns, not {spec.expected_columns}"
        return "pass", ""

    def _null(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        r = facts.counts
        if not r.n_rows:
            return "skip", "no rows"
        bad = r.n_nulls > NULL_SHARE * r.n_cells if spec.check_columns else r.n_nulls > 0
        return ("fail", f"{r.n_nulls} of {r.n_cells} cells are null") if bad else ("pass", "")

    def _duplicate(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        r = facts.distinct
        if not r.n_rows:
            return "skip", "no rows"
        expected = self._number(spec.expected_sql)
        if expected and expected > 0:
            return ("fail", f"{r.n_rows} rows for {expected}") if r.n_rows / expected >= DUPLICATE_RATIO else ("pass", "")
        return ("fail", f"{r.n_rows - r.n_distinct} repeated rows") if r.n_distinct < r.n_rows else ("pass", "")

    def _ordering(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        row = self.spark.createDataFrame([(sql, spec.keywords, spec.order_limit)], "s string, k array<string>, n int")
        return row.select(ordering_status(F.col("s"), F.col("k"), F.col("n"))).head()[0], ""

    def _scale(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        if (spec.minimum is None and spec.maximum is None) or not facts.counts.n_rows:
            return "skip", "no bounds or no rows"
        n = facts.violations(spec)
        return ("fail", f"{n} numbers out of bounds") if n else ("pass", "")

    def _column_alignment(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        if spec.expected_columns is None or spec.confidence == "low" or not facts.counts.n_rows:
            return "skip", "no number of columns is known"
        n = len(facts.df.columns)
        return ("pass", "") if n == spec.expected_columns else ("fail", f"{n} columns, not {spec.expected_columns}")

    def _symmetry(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        row = facts.df.head()
        mine = next((float(x) for x in row or () if isinstance(x, NUMBER)), None)
        other_row = self.spark.sql(spec.other_sql).head() if spec.other_sql and is_safe_verification_sql(spec.other_sql) else None
        other = next((float(x) for x in other_row or () if isinstance(x, NUMBER)), None)
        if mine is None or other is None:
            return "skip", "no numbers to compare"
        ok = abs(mine - other) <= max(abs(mine) * SYMMETRY_SHARE, SYMMETRY_LEAST)
        return ("pass", "") if ok else ("fail", f"{mine} is not {other}")

    def _boundary(self, sql: str, facts: Facts, spec: Spec) -> tuple[str, str]:
        row = self.spark.createDataFrame([(sql,)], "s string")
        if row.select(has_date_bound(F.col("s"))).head()[0]:
            return "pass", ""
        if self.judge is None:
            return "skip", "no model to judge it"
        said = self.judge(f"Does this query bound the dates that its question names? Answer pass or fail, then why.\n{sql}").strip().lower()
        return ("pass", "") if said.startswith("pass") else ("fail", said[:200])
