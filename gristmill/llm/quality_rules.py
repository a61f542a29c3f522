"""Quality rules as a bitmask ledger: every rule is evaluated once, and policies and ablations work on its failure bits.

DataFrame expressions only. A document's words stay in its own row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules in the order of their bits: (name, condition of failure on the measurements).
RULES = (
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("no_letters", "n_words > 0 AND n_letters * 2 < word_chars"),
    ("shouting", "10 * n_upper > 6 * n_letters AND n_letters > 0"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("one_word", "n_words >= 10 AND 10 * n_distinct_words < n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, int] = {
    "v1": BASE,
    "v2": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["no_letters"],
    "v3": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["no_letters"] | BIT["short_words"] | BIT["long_words"] | BIT["shouting"] | BIT["exclamations"] | BIT["one_word"],
}
CURRENT = "v3"
WINDOW = 5

_WHITE = r"[\x20\x09-\x0D]+"


def _count(text: str, pattern_of_others: str):
    """Characters of a text that are not of ``pattern_of_others``."""
    return F.length(F.regexp_replace(text, pattern_of_others, "")).cast("long")


def _let(value, body):
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words):
    """Words in windows of five words that the text holds twice or more, each word once.

    Windows are compared by a 64-bit hash of their words' hashes. Equal hashes stand side by side after a sort; only
    texts that hold some are sorted by hash and position, for the positions that the repeated windows cover.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(h, (i + j).cast("int")) for j in range(WINDOW)]))

    def covered(w):
        # Positions of repeated windows in order, then the words from each to the next, five at most.
        paired = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def is_repeated(p):
            last = F.size(p) - 1
            same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
            return F.filter(
                F.transform(p, lambda x, i: F.when(((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(i, F.least(i + 1, last))), x["i"])), lambda x: x.isNotNull()
            )

        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("total"))
        total = F.aggregate(F.sort_array(_let(paired, is_repeated)), start, lambda acc, i: F.struct(i.alias("at"), (acc["total"] + F.least(i - acc["at"], F.lit(WINDOW))).alias("total")), lambda acc: acc["total"])
        return F.when(F.size(F.array_distinct(w)) < F.size(w), total).otherwise(0)

    return F.when(F.size(words) > WINDOW, _let(hashes, lambda h: _let(windows(h), covered))).otherwise(0).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of every input row: each rule of ``RULES`` evaluated once.

    Null texts have no words, as empty ones. A text may be of any length: its words are arrays of its own row, sorted but never
    exploded, so time grows with n log n of its words. Repeated rows are rows of their own, whatever ids they share; other columns are
    not read; an empty table gives no rows. A measurement just at a rule's bound passes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = rows.select("doc_id", "text", F.filter(F.split("text", _WHITE), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r")) != "").alias("lines"))
    measured = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count("text", r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        _count("text", r"[^\p{L}]+").alias("n_letters"),
        _count("text", r"[^\p{Lu}]+").alias("n_upper"),
        _count("text", r"[^!]+").alias("n_exclamations"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
    )
    bits = sum((F.when(F.expr(failed), F.lit(BIT[name])).otherwise(0) for name, failed in RULES), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("int"))


def apply_policy(rows: DataFrame, version: str = CURRENT, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """The ledger's rows with ``base_failed``, ``kept`` and the policy's version."""
    mask = policies[version]
    return rows.select("*", ((F.col("fail_bits").bitwiseAND(F.lit(BASE))) != 0).alias("base_failed"), (F.col("fail_bits").bitwiseAND(F.lit(mask | BASE)) == 0).alias("kept"), F.lit(version).alias("policy"))


def ablate(rows: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """``policy, rule, n_docs, n_failed, n_kept, n_kept_without``: what each policy keeps, and would keep without each of its rules.

    Rows are first counted by their failure bits, of which there are 2 to the number of rules at most.
    """
    counted = rows.groupBy("fail_bits").count()
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).alias("mask")) for v, m in policies.items()]))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in BIT.items()]))
    pairs = counted.select("*", versions.alias("p")).select("*", rules.alias("r")).where("(p.mask & r.bit) <> 0")
    return pairs.groupBy("p.policy", "r.rule").agg(
        F.sum("count").alias("n_docs"),
        F.sum(F.expr("IF((fail_bits & r.bit) <> 0, count, 0)")).alias("n_failed"),
        F.sum(F.expr("IF((fail_bits & p.mask) = 0, count, 0)")).alias("n_kept"),
        F.sum(F.expr("IF((fail_bits & p.mask & ~r.bit) = 0, count, 0)")).alias("n_kept_without"),
    )
