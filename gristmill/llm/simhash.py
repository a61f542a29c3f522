"""SimHash near-duplicates: fingerprints, links by pivot distance tables, and groups of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm import near_copies
from gristmill.llm._shared import fresh, map_batches, settle
from gristmill.llm._tokens import LOWER, Texts, mix, texts_of, words
from gristmill.llm.components import connected_components, unite

RADIUS = 3
#: Distances to these reference fingerprints are held against each other before a pair is verified: eight, a byte of a long each.
PIVOTS = mix(np.arange(101, 109, dtype=np.uint64))
#: Rows of one block of a large bucket, and rows from which a bucket is dealt anew by more bits.
BLOCK, LARGE = 512, 16384

# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of every span of ``data``: spans of one length are hashed together, lane by lane."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]))
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            size, rows = int(ordered[a]), order[a:b]
            at = starts[rows].copy()
            left = size
            if size >= 32:
                v = [np.full(len(rows), x, dtype=np.uint64) for x in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
                while left >= 32:
                    for i in range(4):
                        v[i] = _lane(v[i], eight[at + 8 * i])
                    at += 32
                    left -= 32
                acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    acc = (acc ^ _lane(np.uint64(0), x)) * _P1 + _P4
            else:
                acc = np.full(len(rows), seed64 + _P5, dtype=np.uint64)
            acc = acc + np.uint64(size)
            while left >= 8:
                acc = _rotl(acc ^ _lane(np.uint64(0), eight[at]), 27) * _P1 + _P4
                at += 8
                left -= 8
            if left >= 4:
                acc = _rotl(acc ^ (four[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at += 4
                left -= 4
            while left:
                acc = _rotl(acc ^ (data[at].astype(np.uint64) * _P5), 11) * _P1
                at += 1
                left -= 1
            acc = (acc ^ (acc >> np.uint64(33))) * _P2
            acc = (acc ^ (acc >> np.uint64(29))) * _P3
            out[rows] = acc ^ (acc >> np.uint64(32))
    return out


def bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set among ``hashes[bounds[i]:bounds[i + 1]]``, as rows of 64 counts.

    Eight counters of eight bits are added at a time, over blocks of at most 255 hashes.
    """
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), 64), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = -(-sizes[full] // 255)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    within = np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks)
    at = np.repeat(bounds[:-1][full], blocks) + 255 * within
    ones = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((hashes[: bounds[-1]] >> np.uint64(shift)) & ones, at)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[np.ix_(full, np.arange(8) * 8 + shift)] = np.add.reduceat(lanes, first_block[:-1], axis=0)
    return out


def text_fingerprints(texts: Texts, words_per_shingle: int, seed: int) -> np.ndarray:
    """The SimHash of each text: a bit is set if it is in over half the shingles' hashes; no words give zero."""
    lower = LOWER[texts.data]
    starts, ends, first_word = words(texts)
    n_words = np.diff(first_word)
    # Words joined by one space each: word i begins at joined[i].
    sizes = ends - starts
    joined = np.concatenate(([0], np.cumsum(sizes + 1)))
    spaced = np.full(joined[-1], 0x20, dtype=np.uint8)
    inside = np.zeros(len(lower) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    mark = np.ones(joined[-1], dtype=bool)
    mark[joined[1:] - 1] = False
    spaced[mark] = lower[np.cumsum(inside[:-1]).astype(bool)] if len(starts) else lower[:0]
    counts = np.where(n_words >= words_per_shingle, n_words - words_per_shingle + 1, np.minimum(n_words, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    begin = np.repeat(first_word[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    end = begin + np.repeat(np.minimum(n_words, words_per_shingle), counts)
    hashes = np.empty(bounds[-1], dtype=np.uint64)
    for a in range(0, len(begin), 1 << 18):
        s, e = joined[begin[a : a + (1 << 18)]], joined[end[a : a + (1 << 18)]] - 1
        hashes[a : a + (1 << 18)] = xxh64_spans(spaced, s, e - s, seed)
    bits = 2 * bit_counts(hashes, bounds) > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp``: the 64-bit SimHash of every whole text, one row for each input row (repeated rows included).

    Null texts and texts without words have fingerprint zero. No other column is read, so clashing names do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprints(t, words_per_shingle, seed) for t in texts_of(batch.column(1))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(kept, run, "doc_id long, fp long")


def _blocks(mask: int) -> list[int]:
    """The set bits of ``mask`` in six runs."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(x.tolist()) for x in np.array_split(np.array(bits, dtype=object), 6)]


def _masks(fixed: int) -> list[int]:
    """Twenty masks over ``fixed``: of six blocks of the free bits, at most three differ within the radius, so three are equal."""
    full = (1 << 64) - 1
    return [fixed | sum(three) for three in combinations(_blocks(full ^ fixed), 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucketed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """``mask, key, fp``: one row for each mask that replaces a row's own (or for each of the first twenty)."""
    spark = rows.sparkSession
    pairs = spark.createDataFrame([(_signed(old), _signed(new)) for old, news in masks.items() for new in news], "old long, mask long")  # 20, or 20 for each mask before: 8,420 at most
    if 0 in masks:
        each = F.explode(F.array(*[F.lit(_signed(x)) for x in masks[0]]))
        return rows.select("fp", "pivots", each.alias("mask")).select("mask", F.expr("fp & mask").alias("key"), "fp", "pivots")
    return rows.withColumnRenamed("mask", "old").join(F.broadcast(pairs), "old").select("mask", F.expr("fp & mask").alias("key"), "fp", "pivots")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """The distances of each fingerprint to the pivots, as bytes of one 64-bit value, the first pivot's lowest."""
    return sum((np.bitwise_count(fp ^ p).astype(np.uint64) << np.uint64(8 * i) for i, p in enumerate(PIVOTS)), np.zeros(len(fp), np.uint64))


def pivot_column(fp):
    """``pivot_table`` as a column."""
    return F.expr(" | ".join(f"shiftleft(CAST(bit_count({fp} ^ {_signed(int(p))}L) AS BIGINT), {8 * i})" for i, p in enumerate(PIVOTS)))


def bucket_links(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS, table: np.ndarray | None = None, work: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all fingerprints of one bucket within the radius, as few as a spanning forest has.

    ``table`` has the pivot distances of each. A bucket is put in order of the first, so that pairs farther apart there are never
    formed; of the others those whose distances to any pivot differ by more than the radius are discarded, and survivors
    are verified. ``work`` gets the numbers of pairs formed, verified and linked.
    """
    table = pivot_table(fp) if table is None else table
    distance = table.astype("<u8").view(np.uint8).reshape(-1, len(PIVOTS)).astype(np.int16)
    order = np.lexsort((distance[:, 0], group))
    group, fp, distance = group[order], fp[order], distance[order]
    n = len(fp)
    label, at, lag = np.arange(n), np.arange(n), 1
    count = {"formed": 0, "verified": 0, "linked": 0}
    while True:
        at = at[at + lag < n]
        at = at[(group[at] == group[at + lag]) & (distance[at + lag, 0] - distance[at, 0] <= radius)]
        if not len(at):
            break
        a = at[label[at] != label[at + lag]]
        b = a + lag
        count["formed"] += len(a)
        near = (np.abs(distance[a, 1:] - distance[b, 1:]) <= radius).all(axis=1)
        a, b = a[near], b[near]
        count["verified"] += len(a)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        count["linked"] += int(near.sum())
        label = unite(label, a[near], b[near])
        lag += 1
    if work is not None:
        work.update({k: work.get(k, 0) + v for k, v in count.items()})
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fp``, enough to connect all that a chain of links connects.

    Buckets hold fingerprints that agree on three of six blocks of bits, so none within the radius is missed. Buckets of
    one are dropped by a count that combines before the shuffle. A bucket of over ``BLOCK`` rows is dealt as pairs of
    blocks to many tasks; one of over ``LARGE`` rows first goes by three of six blocks of its free bits again, until
    at most 2**9 fingerprints can share a bucket.
    """
    if radius > RADIUS:
        raise ValueError("the blocks guarantee a radius of 3")
    # Distances to the pivots are computed once for each fingerprint and go with it.
    level, rows, out = 0, distinct.select("fp", pivot_column("fp").alias("pivots")), None
    masks = {0: _masks(0)}
    while True:
        keyed = _bucketed(rows, masks)
        counted = keyed.groupBy("mask", "key").count().where("count > 1")
        shared = settle(keyed.join(counted, ["mask", "key"]), "buckets")
        ready = shared if level == 2 else shared.where(F.col("count") <= LARGE)
        parts = F.ceil(F.col("count") / BLOCK).cast("int")
        own = F.when(parts == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), parts).cast("int"))
        other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
        dealt = ready.select("mask", "key", "fp", "pivots", own.alias("own"), other).select(F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp", "pivots")
        found = _linked(dealt, radius)
        out = found if out is None else out.union(found)
        rows = shared.where(F.col("count") > LARGE).select("mask", "fp", "pivots")
        if level == 2 or rows.limit(1).count() == 0:
            return out
        masks = {m: _masks(m) for news in masks.values() for m in news}
        level += 1


def _linked(dealt: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(group, fp, pivots):
            u, v = bucket_links(group, fp.view(np.uint64), radius, pivots.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((x, c.to_numpy())) for x, c in zip(held, batch.columns, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
            if cut:
                yield links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield links(*held)

    return map_batches(dealt.repartition("bucket").sortWithinPartitions("bucket", "fp"), run, "u long, v long")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``fp, first, root``: each distinct fingerprint, its smallest document id, and the fingerprint that names its component."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    component = connected_components(fingerprint_links(distinct, radius))
    return distinct.join(component, distinct.fp == component.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id``: every input row with its fingerprint and the smallest document id that a chain of links reaches.

    Fingerprints link at ``radius`` or fewer differing bits; equal texts share a fingerprint, so copies never become pairs.
    Null texts and texts without words have fingerprint zero and link like any other. Null ids reach others but are never
    the smallest; a group of null ids only has component null. Rows that repeat an id are rows of their own and may be in
    different groups. Texts may be of any length: time and memory of a text grow with its words. Empty input gives no rows.
    """
    prints = settle(fingerprints(docs, id_col, text_col, words_per_shingle, seed), "fingerprints")
    rooted = _grouped(prints, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.join(least, "root").select(F.col("fp").alias("print"), "component_id")
    return prints.join(by_print, prints.fp == by_print.print).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words_per_shingle: int = 3, seed: int = 42, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one left of each group of near-duplicates: that of the smallest id, one of repeated rows.

    With ``similarity`` texts link by that exact Jaccard similarity of their shingles, not by ``radius``; the fingerprints
    compared by pivots are then ones whose distance bounds what the sets differ in (``near_copies``). Null texts and texts
    without words are one group; an empty table gives no rows; other columns stay, whatever they are called.
    """
    if similarity is not None:
        return near_copies.one_of_each(docs, id_col, text_col, similarity, words_per_shingle)
    prints = settle(fingerprints(docs, id_col, text_col, words_per_shingle, seed), "fingerprints")
    best = _grouped(prints, radius).groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("best"))
    # Null ids get a value of their own, so that the join and the last step agree on plain keys and texts move once.
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    own, at, columns = fresh("_id", docs), fresh("_fp", docs), docs.columns
    kept = best.select(key("best.first").alias(own), F.col("best.fp").alias(at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprints(t, words_per_shingle, seed) for t in texts_of(batch.column(batch.schema.get_field_index(text_col)))]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, at])

    marked = map_batches(docs, run, T.StructType([*docs.schema.fields, T.StructField(at, T.LongType())]))
    joined = marked.withColumn(own, key(id_col)).join(kept, [own, at], "left_semi")
    return joined.dropDuplicates([own, at]).select(*columns)


def hex_fingerprint(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
