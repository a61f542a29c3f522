"""Token counts as delta-maintained rollups: signed changes update additive totals, and a batch counts once however often it is sent."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._shared import map_batches

TOKENIZERS = "/opt/tokenizers"
#: The pre-tokenizer pattern that belongs to byte-level ranks of this kind; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMENSIONS = ("source", "lang", "tokenizer_version")
_CHANGES = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long"
_STATE = "doc_id long, tokenizer_version string, entries array<struct<source: string, lang: string, n_docs: long, n_tokens: long>>, batch long"
_DELTA = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"
#: Runs of white space from this length on are counted apart from the pattern, which goes through them by recursion.
_LONG_RUN = 1024
# Fixed value: the white space of the pattern.
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG_RUN)


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The tokenizer of a file of byte-level ranks; loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding, text: str) -> int:
    """Tokens of a whole text of any length, as ``encode_ordinary`` gives them.

    The pattern makes one piece of a run of white space but its last character, which belongs to what follows; at the
    end of the text, of the whole run. Long runs are cut out as such pieces, so that none reaches the pattern.
    """
    n, at = 0, 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def token_counts(docs: DataFrame, tokenizer_version: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``doc_id, source, lang, tokenizer_version, n_tokens`` of every input row: tokens of its whole text, 0 if null or empty.

    Texts may be of any length and hold runs of anything. Repeated rows are rows of their own; an empty table gives none.
    The vocabulary is a file that each executor has, as an installed package; it is opened where the counting is done.
    """
    path = f"{tokenizers}/{tokenizer_version}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            texts = batch.column(3)
            n = np.fromiter((count_tokens(encoding, t.as_py()) if t.is_valid else 0 for t in texts), dtype=np.int64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([tokenizer_version] * len(n), type=pa.string()), pa.array(n)], names=["doc_id", "source", "lang", "tokenizer_version", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


def estimated_counts(docs: DataFrame, tokenizer_version: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """As ``token_counts``, a token for each four bytes begun: what is known of a text before a tokenizer has read it."""
    n = F.coalesce(F.ceil(F.octet_length(F.col(text_col).cast("string")) / 4), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.lit(tokenizer_version).alias("tokenizer_version"), n.alias("n_tokens"))


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version, below one folder that all executors share.

    A batch writes its signed sums and the new state of its documents to folders of its own, then one small marker named
    by its number. Only what markers name is ever read, so a failed attempt leaves nothing; a marker is created once,
    so a batch sent again, even by two drivers at a time, changes nothing. Batches are numbered in the order they hold.
    ``compact`` writes the state and sums of all batches so far once, and later reads begin there. With ``each_row`` rows that
    repeat an id in one batch are counted each and replaced together; otherwise they are one document.
    """

    def __init__(self, spark: SparkSession, path: str, each_row: bool = False):
        self.spark, self.path, self.each_row = spark, path.rstrip("/"), each_row
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self, kind: str) -> dict[int, object]:
        """The markers of a kind by their numbers, from one listing."""
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return {}
        found = {}
        for status in self._fs.listStatus(folder):
            m = re.fullmatch(kind + r"-(\d+)\.json", status.getPath().getName())
            if m and status.getLen():
                found[int(m[1])] = status.getPath()
        return dict(sorted(found.items()))

    def _marked(self, marker) -> dict:
        stream = self._fs.open(marker)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def committed(self) -> dict[int, dict]:
        """The attempt folder of each batch that is committed."""
        return {number: self._marked(marker) for number, marker in self._markers("batch").items()}

    def _read(self, part: str, schema: str) -> DataFrame:
        """What the last compaction and the batches after it have of a part."""
        compact = self._markers("compact")
        last = max(compact, default=-1)
        markers = [compact[last]] if compact else []
        markers += [m for number, m in self._markers("batch").items() if number > last]
        paths = [f"{self._marked(m)['attempt']}/{part}" for m in markers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _last(self) -> DataFrame:
        rows = self._read("state", _STATE)
        return rows.groupBy("doc_id", "tokenizer_version").agg(F.max_by("entries", "batch").alias("entries"), F.max("batch").alias("batch"))

    def state(self) -> DataFrame:
        """``doc_id, tokenizer_version, source, lang, n_docs, n_tokens``: what each document adds now."""
        return _entries(self._last())

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, n_docs, n_tokens``; groups without documents are not listed."""
        sums = self._read("deltas", _DELTA).groupBy(*DIMENSIONS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit ``changes (op, doc_id, source, lang, tokenizer_version, n_tokens)``; False if the batch was committed before.

        ``op`` is upsert (an insert, or a revised count, source or language) or delete. A change to a document's count for a
        tokenizer version takes away what that document added before and adds what it has now. Several rows for one
        document and version in a batch count as one, or each with ``each_row``; a delete among them deletes all, and of
        those that count as one the row of most tokens does, then of the first source and language. Deletes
        of unknown documents do nothing. Rows without a document id cannot be named later: upserts of them add up,
        deletes of them do nothing. Every step combines before its shuffle, so an id may repeat any number of times.
        """
        before = self._markers("batch")
        if batch in before:
            return False
        if before and batch < max(before):
            raise ValueError(f"batch {batch} comes after batch {max(before)}")
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        columns = [f.split(" ")[0] for f in _CHANGES.split(", ")]
        changes.select(*columns).write.parquet(f"{attempt}/changes")  # counting is done once
        changes = self.spark.read.schema(_CHANGES).parquet(f"{attempt}/changes").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
        key = ["doc_id", "tokenizer_version"]
        named, nameless = changes.where("doc_id IS NOT NULL"), changes.where("doc_id IS NULL AND op <> 'delete'")
        if self.each_row:
            sums = named.groupBy(*key, "source", "lang").agg(F.bool_or(F.col("op") == "delete").alias("gone"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            new = sums.groupBy(*key).agg(F.bool_or("gone").alias("gone"), F.collect_list(F.struct("source", "lang", "n_docs", "n_tokens")).alias("entries"))
        else:
            most = F.min(F.struct((-F.col("n_tokens")).alias("least"), "source", "lang")).alias("most")
            one = named.groupBy(*key).agg(F.bool_or(F.col("op") == "delete").alias("gone"), most)
            new = one.select(*key, "gone", F.array(F.struct("most.source", "most.lang", F.lit(1).cast("long").alias("n_docs"), (-F.col("most.least")).alias("n_tokens"))).alias("entries"))
        kept = F.when(F.col("gone"), F.slice("entries", 1, F.lit(0))).otherwise(F.col("entries"))
        state = new.select(*key, kept.alias("entries"), F.lit(batch).cast("long").alias("batch"))
        state.write.parquet(f"{attempt}/state")
        state = self.spark.read.schema(_STATE).parquet(f"{attempt}/state")

        def signed(rows: DataFrame, sign: int) -> DataFrame:
            return rows.select(*DIMENSIONS, (F.col("n_docs") * sign).alias("d_docs"), (F.col("n_tokens") * sign).alias("d_tokens"))

        deltas = signed(_entries(state), 1).union(signed(nameless.withColumn("n_docs", F.lit(1).cast("long")), 1))
        if before:
            deltas = deltas.union(signed(_entries(self._last().join(state.select(*key), key, "left_semi")), -1))
        sums = deltas.groupBy(*DIMENSIONS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.where("d_docs <> 0 OR d_tokens <> 0").write.parquet(f"{attempt}/deltas")
        return self._mark(batch, attempt)

    def compact(self) -> bool:
        """Write the state and sums of all batches committed so far as one, where later reads begin; False if that is done or nothing is."""
        last = max(self._markers("batch"), default=None)
        if last is None or last in self._markers("compact"):
            return False
        attempt = f"{self.path}/attempts/{uuid.uuid4().hex}"
        self._last().select("doc_id", "tokenizer_version", "entries", "batch").where(F.size("entries") > 0).write.parquet(f"{attempt}/state")
        sums = self._read("deltas", _DELTA).groupBy(*DIMENSIONS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.where("d_docs <> 0 OR d_tokens <> 0").write.parquet(f"{attempt}/deltas")
        return self._mark(last, attempt, "compact")

    def _mark(self, number: int, attempt: str, kind: str = "batch") -> bool:
        """Create a marker, once: another driver's marker stays."""
        staged, final = self._path(f"{attempt}/marker.json"), self._path(f"{self.path}/commits/{kind}-{number:012d}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(staged, True)
        out.write(json.dumps({"attempt": attempt}).encode())
        out.close()
        if self._fs.exists(final):
            return False
        return bool(self._fs.rename(staged, final))


def _entries(state: DataFrame) -> DataFrame:
    return state.select("doc_id", "tokenizer_version", F.explode("entries").alias("e")).select("doc_id", "tokenizer_version", "e.source", "e.lang", "e.n_docs", "e.n_tokens")
