"""Sinks and sources of what is built once and read often, the cache of model answers, and settings."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


class ArtifactStore:
    """Tables below one folder, named ``<database>/<kind>``; Parquet, JSON or text."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, db_id: str, kind: str) -> str:
        return f"{self.folder}/{db_id}/{kind}"

    def has(self, db_id: str, kind: str) -> bool:
        return exists(self.spark, f"{self.path(db_id, kind)}/_SUCCESS")

    def save(self, df: DataFrame, db_id: str, kind: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(db_id, kind))
        return self.load(db_id, kind)

    def load(self, db_id: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(self.path(db_id, kind))

    def cached(self, db_id: str, kind: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """The table as it was saved, or built and saved now."""
        return self.load(db_id, kind) if self.has(db_id, kind) and not force else self.save(build(), db_id, kind)

    def save_json(self, df: DataFrame, db_id: str, kind: str) -> None:
        df.write.mode("overwrite").json(self.path(db_id, kind))

    def load_json(self, db_id: str, kind: str, schema: T.StructType | str) -> DataFrame:
        return self.spark.read.schema(schema).json(self.path(db_id, kind))

    def save_text(self, df: DataFrame, db_id: str, kind: str) -> None:
        """A table of one text column as a text file."""
        df.coalesce(1).write.mode("overwrite").text(self.path(db_id, kind))

    def load_text(self, db_id: str, kind: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(self.path(db_id, kind)).collect())


def append_results(results: DataFrame, path: str) -> None:
    """Add results; those of a question that is there already stay out."""
    spark = results.sparkSession
    if exists(spark, path):
        results = results.join(spark.read.parquet(path).select("question_id").distinct(), "question_id", "left_anti")
    results.write.mode("append").parquet(path)


def cache_key(model: str, messages: Sequence[dict[str, Any]]) -> str:
    return hashlib.sha256((model + json.dumps(list(messages), sort_keys=True)).encode()).hexdigest()


class AnswerCache:
    """Answers of text models by model and messages, as JSON lines in 256 folders by key; the last line of a key counts.

    Off, missing, unreadable, of another key, or older than ``ttl`` seconds: no answer. One answer is looked up in its folder
    alone; many are looked up by ``lookup`` and added by ``add``, one job for all.
    """

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True):
        self.spark, self.folder, self.enabled = spark, folder, enabled
        self.schema = "key string, model string, answer string, created double"

    def _rows(self, path: str | None = None) -> DataFrame:
        path = path or self.folder
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(path).select("key", "model", "answer", "created")

    def _place(self, key: str) -> str:
        return f"{self.folder}/shard={key[:2]}"

    def get(self, model: str, messages: Sequence[dict[str, Any]], ttl: float | None = None) -> str | None:
        if not self.enabled:
            return None
        key = cache_key(model, messages)
        row = self._rows(self._place(key)).where((F.col("key") == key) & F.col("answer").isNotNull()).orderBy(F.desc("created")).head()
        return None if row is None or (ttl is not None and time.time() - row.created > ttl) else row.answer

    def set(self, model: str, messages: Sequence[dict[str, Any]], answer: str) -> None:
        if self.enabled:
            key = cache_key(model, messages)
            self.spark.createDataFrame([(key, model, answer, time.time())], self.schema).coalesce(1).write.mode("append").json(self._place(key))

    def add(self, answers: DataFrame, model: str) -> None:
        """Keep ``answers (prompt, answer)`` of one user message each."""
        if self.enabled:
            rows = answers.select(self._key(model).alias("key"), F.lit(model).alias("model"), "answer", F.lit(time.time()).alias("created")).withColumn("shard", F.substring("key", 1, 2))
            rows.repartition("shard").write.mode("append").partitionBy("shard").json(self.folder)

    def lookup(self, prompts: DataFrame, model: str) -> DataFrame:
        """``prompts (prompt)`` with the cached ``answer`` of each, null where there is none, by one join."""
        last = self._rows().groupBy("key").agg(F.max_by("answer", "created").alias("answer"))
        return prompts.withColumn("key", self._key(model)).join(last, "key", "left").drop("key")

    @staticmethod
    def _key(model: str) -> Column:
        """``cache_key`` of one user message, the column ``prompt``."""
        quoted = F.to_json(F.array("prompt"))
        return F.sha2(F.concat(F.lit(model + '[{"content": '), quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(', "role": "user"}]')), 256)

    def cached(self, model: str, ttl: float | None = None) -> Callable:
        """Wrap a function of messages so that it is asked once for the same ones."""

        def wrap(ask: Callable[[Sequence[dict[str, Any]]], str]):
            @wraps(ask)
            def inner(messages):
                found = self.get(model, messages, ttl)
                if found is None:
                    found = ask(messages)
                    self.set(model, messages, found)
                return found

            return inner

        return wrap


class RateLimited(RuntimeError):
    """A model takes no more for now."""


def with_fallbacks(models: Iterable[Callable[[str], str]]) -> Callable[[str], str]:
    """The first model, and the next only where one is rate-limited; other errors are the caller's."""
    chain = list(models)

    def ask(prompt: str) -> str:
        for model in chain[:-1]:
            try:
                return model(prompt)
            except RateLimited:
                continue
        return chain[-1](prompt)

    return ask


def with_retries(model: Callable[[str], str], times: int = 3, first: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Ask again after 2, 4, ... seconds, 30 at most, three times in all."""

    def ask(prompt: str) -> str:
        for i in range(times):
            try:
                return model(prompt)
            except Exception:  # any failure may pass; the last one is raised
                if i == times - 1:
                    raise
                sleep(min(most, first * 2**i))
        raise AssertionError("no attempt was made")

    return ask


def schema_of_json(schema: dict[str, Any]) -> T.DataType:
    """A Spark type for a JSON schema; of alternatives the first that is not null."""
    for word in ("oneOf", "anyOf"):
        if word in schema:
            return schema_of_json(next((s for s in schema[word] if s.get("type") != "null"), {"type": "string"}))
    kind = schema.get("type", "string")
    kind = next((k for k in kind if k != "null"), "string") if isinstance(kind, list) else kind
    if kind == "object":
        need = set(schema.get("required", ()))
        return T.StructType([T.StructField(n, schema_of_json(s), n not in need) for n, s in schema.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(schema_of_json(schema.get("items", {})))
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


@dataclass(frozen=True)
class Settings:
    """What the engine can be told. Lists may be given as texts with commas."""

    models: tuple[str, ...] = ()
    cache_answers: bool = True
    query_timeout: float = 30.0
    generator_timeout: float = 600.0
    question_timeout: float = 3600.0
    linker_top_k: int = 50
    values_top_k: int = 5
    examples_top_k: int = 8
    fix_rounds: int = 3
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, **values) -> Settings:
        models = values.pop("models", ())
        known = {k: values.pop(k) for k in list(values) if k in cls.__dataclass_fields__}
        names = tuple(m.strip() for m in models.split(",") if m.strip()) if isinstance(models, str) else tuple(models)
        return cls(models=names, extra={k: str(v) for k, v in values.items()}, **known)
