"""What the operators share: the cluster's shared folder, tables written to cut lineage, and reading the input tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (local mode, tests) a temporary folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="gristmill-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            context.setCheckpointDir(folder)
        found = context.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/gristmill-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(drop_scratch)
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file system, so that any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch() -> None:
    """Remove all tables written so far; for a long session, once the results that read them are saved. Done at the driver's end too."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            try:
                drop_path(spark, path)
            except Exception:  # the JVM may be gone already when Python ends
                return


#: Seconds between collections of garbage on the driver at least; steps that take less leave little on the disk.
CLEAN_EVERY = 3.0
_cleaned = [0.0]


def _clean(spark: SparkSession) -> None:
    if time.monotonic() - _cleaned[0] >= CLEAN_EVERY:
        spark.sparkContext._jvm.System.gc()
        _cleaned[0] = time.monotonic()


def settle(df: DataFrame, name: str = "table", spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan behind it is cut, so what follows neither repeats the work nor depends on any executor's disk. ``spent`` are
    settled tables that nothing reads any more; they are removed. Collecting garbage on the driver lets Spark remove the
    shuffle files of the step just ended, so the disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for old in spent:
        release(old)
    _clean(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(settled: DataFrame) -> None:
    """Remove a settled table before the driver ends."""
    path = settled._settled_at
    _written[:] = [w for w in _written if w[1] != path]
    drop_path(settled.sparkSession, path)


#: Distinct values of a sieve, and so rows of its broadcast, at most.
SIEVE = 1 << 18


def sifted(rows: DataFrame, key: list[str], wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false where their key is surely none of ``wanted``'s (same names); where true, an exact join is to follow.

    Keys are folded to ``SIEVE`` values, so the broadcast side has that many rows at most, whatever is wanted; rows that are
    surely none need no exchange. Where nearly all keys are wanted all flags are true, and nothing is lost but the saving.
    """
    fold = F.pmod(F.xxhash64(*key), F.lit(SIEVE))
    marks = wanted.select(fold.alias("_mark")).distinct()
    return rows.join(F.broadcast(marks), fold == F.col("_mark"), "left").withColumn(flag, F.col("_mark").isNotNull()).drop("_mark")


#: Rows of one key that a join brings to one task, about.
TOGETHER = 512


def parts_of(counts: DataFrame, key: list[str], most: int) -> DataFrame:
    """Into how many parts keys of over ``most`` rows are dealt, from ``counts (key, n)``: a row for each value that they fold to, ``SIEVE`` at most."""
    fold = F.pmod(F.xxhash64(*key), F.lit(SIEVE))
    return counts.where(F.col("n") > most).groupBy(fold.alias("_mark")).agg(F.max(F.ceil(F.col("n") / most)).alias("_parts"))


def parted(rows: DataFrame, key: list[str], parts: DataFrame) -> DataFrame:
    """``rows`` with ``_parts``, 1 for most. Keys that fold to one value have one number of parts, so both sides of a join agree on it."""
    fold = F.pmod(F.xxhash64(*key), F.lit(SIEVE))
    return rows.join(F.broadcast(parts), fold == F.col("_mark"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_mark")


def spread_join(many: DataFrame, one: DataFrame, key: list[str], by: str) -> DataFrame:
    """``many`` joined with ``one`` (settled; a row for each key, with ``n``, how many rows of ``many`` have it) on ``key``.

    Keys of over ``TOGETHER`` rows are dealt to several tasks by ``by``, and their row of ``one`` goes to each. Both sides know
    into how many by a broadcast of bounded size, so no key is brought together to count it.
    """
    parts = parts_of(one, key, TOGETHER)
    left = parted(many, key, parts).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts"))).drop("_parts")
    right = parted(one, key, parts).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts", "n")
    return left.join(right, [*key, "_part"]).drop("_part")


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with the session's Arrow batches bounded to ``BATCH_BYTES``, so that long texts do not add up."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(key).removesuffix("b"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def listed(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A list for each stretch of ``values`` between cuts, as bytes."""
    offsets = (np.asarray(cut) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unlisted(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, one list after the other, and how many each has."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _dealt_to(key: int, n: int) -> int:
    """To which of n partitions Spark deals a long of less than 32 bits: its Murmur hash."""
    m, h = 0xFFFFFFFF, 42
    for word in (key, 0):
        k = word * 0xCC9E2D51 & m
        k = (k << 15 | k >> 17) * 0x1B873593 & m
        h ^= k & m
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % n


def part_keys(n: int) -> np.ndarray:
    """A key for each of n partitions, dealt to that one. Where Spark deals otherwise, parts still stay whole."""
    found: dict[int, int] = {}
    key = 0
    while len(found) < n:
        found.setdefault(_dealt_to(key, n), key)
        key += 1
    return np.array([found[i] for i in range(n)], np.int64)


def packed(keys: np.ndarray, by: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """``part`` and lists of the columns' values: a row for each part to which the 64-bit hashes ``by`` deal them."""
    n = len(keys)
    part = (by % np.uint64(n)).astype(np.uint16 if n <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    cut = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=n))))
    some = np.flatnonzero(np.diff(cut))
    cut = np.append(cut[some], len(part))
    return pa.RecordBatch.from_arrays([pa.array(keys[some]), *(listed(c[order], cut) for c in columns)], names=["part", *names])


def gathered(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> list[np.ndarray]:
    """All values of each column of lists of a partition, ``part`` first in its batches."""
    found = [[np.zeros(0, kind)] for kind in kinds]
    for batch in batches:
        for i, kind in enumerate(kinds):
            found[i].append(unlisted(batch.column(1 + i), kind)[0])
    return [np.concatenate(x) for x in found]


def fresh(name: str, df: DataFrame) -> str:
    """The name, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
