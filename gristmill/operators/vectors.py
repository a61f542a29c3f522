"""Vector search: exact top-k by cosine in pairs of blocks, a partitioned index, and hashed embeddings of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block of vectors, on either side.
BLOCK = 4096
#: Bytes of an Arrow batch of pairs of blocks, about.
BATCH_BYTES = 4 << 20
TOP_K = 30
SIZE = 384


def normalise(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm == 0, 1, norm)


def matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    """Rows of doubles of a list column; null rows and nulls in rows are zeros, rows of another size are cut or filled."""
    lists = column.to_pylist()
    size = size or max((len(x) for x in lists if x), default=1)
    out = np.zeros((len(lists), size))
    for i, x in enumerate(lists):
        if x:
            row = np.array([0.0 if v is None else v for v in x[:size]])
            out[i, : len(row)] = row
    return out


def fast_matrix(column: pa.Array, size: int) -> np.ndarray:
    """As ``matrix``, at once where all rows have the size."""
    if column.null_count == 0 and len(column) and len(column.flatten()) == len(column) * size and column.flatten().null_count == 0:
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == size).all():
            return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return matrix(column, size)


def _packed(rows: DataFrame, id_col: str, vector_col: str, group_col: str | None, size: int, block: int) -> DataFrame:
    """``spot, ids, unit, groups``: rows packed into blocks where they lie, unit vectors one after the other as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(most: int) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for a in range(0, whole.num_rows - most + 1 if most > 1 else whole.num_rows, block):
                part = whole.slice(a, block)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                unit = normalise(fast_matrix(part.column(1), size)).astype("<f8")
                columns = [pa.array([int(ids[0])]), pa.array([ids]), pa.array([unit.tobytes()], type=pa.binary()), pa.array([part.column(2).to_pylist()], type=pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["spot", "ids", "unit", "groups"])
            held[:] = [whole.slice(whole.num_rows - whole.num_rows % block)] if most > 1 else []

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from blocks(block)
        if sum(b.num_rows for b in held):
            yield from blocks(1)

    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    kept = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col), group)
    return kept.mapInArrow(run, "spot long, ids array<long>, unit binary, groups array<string>")


def _best(cosine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a table of cosines the columns of the ``k`` highest finite ones, of equal ones those of the least ids."""
    found = np.isfinite(cosine)
    if cosine.shape[1] > k:
        found &= cosine >= np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
    q, v = np.nonzero(found)
    order = np.lexsort((ids[v], -cosine[q, v], q))
    q, v = q[order], v[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], v[place < k]


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vector_col: str = "embedding", exclude_same: str | None = None, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """``query_id, <id>, similarity_score, rank``: the ``k`` rows of ``vectors`` of highest cosine for each query.

    Both sides are packed into blocks of bounded size where they lie. Blocks of vectors are dealt to as many groups as the session
    has shuffle partitions, each block of queries goes to every group, and a pair of blocks is one product of matrices that
    leaves ``k`` rows for each query; nothing passes through the driver. The score is clipped to [0, 1]; ranks go by the unclipped cosine, then
    the id. Rows of the query's own ``exclude_same`` value do not count. Zero vectors have cosine 0.
    """
    found = nearest(queries, vectors, k, id_col, vector_col, exclude_same, exclude_self, block)
    return found.select("query_id", id_col, clipped(), "rank")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", exclude_same: str | None = None, exclude_self: bool = False, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """As ``cosine_topk``, with the unclipped ``cosine``, rounded to so many digits if any are named."""
    spark = vectors.sparkSession
    first = vectors.where(F.col(vector_col).isNotNull()).select(F.size(vector_col)).head()
    size = max(1, first[0]) if first else 1  # vectors of another size are cut or filled with zeros
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _packed(queries, id_col, vector_col, exclude_same, size, block).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.struct("ids", "unit", "groups").alias("q"))
    held = _packed(vectors, id_col, vector_col, exclude_same, size, block).select(F.pmod(F.xxhash64("spot"), F.lit(groups)).cast("int").alias("at"), F.struct("ids", "unit", "groups").alias("v"))
    pairs = asked.join(held.hint("shuffle_hash"), asked.g == held.at).select("q", "v")
    return _ranked(pairs, k, id_col, size, bool(exclude_same), exclude_self, digits)


def clipped() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine")).alias("similarity_score")


def _ranked(pairs: DataFrame, k: int, id_col: str, size: int, exclude_same: bool = False, exclude_self: bool = False, digits: int | None = None) -> DataFrame:
    """``query_id, <id>, cosine, rank`` of pairs of blocks ``q, v``: each a product of matrices that leaves ``k`` rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
            s = column[i]
            ids = s["ids"].values.to_numpy(zero_copy_only=False)
            return ids, np.frombuffer(s["unit"].as_buffer(), dtype="<f8").reshape(len(ids), size), s["groups"].values

        for batch in batches:
            for i in range(batch.num_rows):
                own, left, mine = side(batch.column(0), i)
                other, right, theirs = side(batch.column(1), i)
                if exclude_same:  # one number for each value, as texts would be Python objects
                    codes = pa.concat_arrays([mine, theirs]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    mine, theirs = codes[: len(own)], codes[len(own) :]
                for a in range(0, len(own), 512):
                    cosine = left[a : a + 512] @ right.T
                    if digits is not None:
                        cosine = np.round(cosine, digits)
                    if exclude_self:
                        cosine[own[a : a + 512, None] == other[None, :]] = -np.inf
                    if exclude_same:
                        cosine[mine[a : a + 512, None] == theirs[None, :]] = -np.inf
                    q, v = _best(cosine, other, k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[a + q]), pa.array(other[v]), pa.array(cosine[q, v])], names=["query_id", id_col, "cosine"])

    # A pair of blocks has megabytes, and Spark would hand Python hundreds of them at once.
    conf, key = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(key).removesuffix("b"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    found = pairs.mapInArrow(run, f"query_id long, {id_col} long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def promoted(matches: DataFrame, least: float = 0.8, k: int = 3) -> DataFrame:
    """Of each hint's best ``k`` those of similarity ``least`` or more."""
    return matches.where((F.col("rank") <= k) & (F.col("similarity_score") >= least))


class PartitionedIndex:
    """Rows assigned to the nearest of a few centres, which are fitted on a bounded sample of least hash.

    A search compares each query with the rows of its ``probes`` nearest centres. Rows of one centre are packed into blocks, and a
    pair of blocks is one product of matrices; a large centre has many blocks, so it is no one task's. Only the numbers of rows of the
    centres pass through the driver. Probing all centres is exact; recall at fewer is measured by ``recall``. Null ids are left out,
    vectors of another size cut or filled with zeros, as in ``cosine_topk``.
    """

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most_centres: int = 32, sample: int = 5000, rounds: int = 10):
        self.id_col, self.vector_col = id_col, vector_col
        drawn = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).collect()
        points = normalise(matrix(pa.array([r[0] for r in drawn]))) if drawn else np.zeros((1, 1))
        n = max(1, min(most_centres, len(points) // 10))
        self.centres = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
        for _ in range(rounds):
            nearest = (points @ self.centres.T).argmax(axis=1)
            for c in range(n):
                if (nearest == c).any():
                    self.centres[c] = points[nearest == c].mean(axis=0)
            self.centres = normalise(self.centres)
        self.vectors = self._assigned(vectors, 1)

    def _assigned(self, rows: DataFrame, probes: int) -> DataFrame:
        """``<id>, <vector>, centre``: rows next to each of their ``probes`` nearest centres."""
        centres, at = self.centres, self.vector_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    unit = normalise(fast_matrix(batch.column(batch.schema.get_field_index(at)), centres.shape[1]))
                    near = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes]
                    rows_of = np.repeat(np.arange(batch.num_rows), near.shape[1])
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows_of)).columns, pa.array(near.reshape(-1).astype(np.int32))], names=[*batch.schema.names, "centre"])

        kept = rows.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).cast("long").alias(self.id_col), self.vector_col)
        return kept.mapInArrow(run, f"{self.id_col} long, {self.vector_col} {dict(kept.dtypes)[self.vector_col]}, centre int")

    def _blocks(self, assigned: DataFrame, block: int) -> tuple[DataFrame, Column]:
        """``centre, part, ids, unit, groups``: blocks of rows of one centre; and into how many parts a centre's rows are dealt by id."""
        size = self.centres.shape[1]
        counts = {r["centre"]: r["n"] for r in assigned.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = F.element_at(F.array(*[F.lit(-(-counts.get(c, 0) // block) or 1) for c in range(len(self.centres))]), F.col("centre") + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def blocks(last: bool) -> Iterator[pa.RecordBatch]:
                """Of rows in order of their keys, those of all keys but the last, which may go on, and of that whole blocks."""
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = [whole.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
                cut = [0, *(np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1).tolist(), whole.num_rows]
                done = 0
                for a, z in zip(cut[:-1], cut[1:], strict=True):
                    open_end = not last and z == whole.num_rows
                    for b in range(a, z, block):
                        if open_end and b + block > z:
                            break
                        part = whole.slice(b, min(block, z - b))
                        ids = part.column(0).to_numpy(zero_copy_only=False)
                        unit = normalise(fast_matrix(part.column(1), size)).astype("<f8")
                        columns = [part.column(2).slice(0, 1), part.column(3).slice(0, 1), pa.array([ids]), pa.array([unit.tobytes()], type=pa.binary()), pa.array([[]], type=pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays(columns, names=["centre", "part", "ids", "unit", "groups"])
                        done = b + part.num_rows
                held[:] = [whole.slice(done)] if done < whole.num_rows else []

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 2 * block:
                    yield from blocks(False)
            if sum(b.num_rows for b in held):
                yield from blocks(True)

        dealt = assigned.withColumn("part", F.pmod(F.xxhash64(self.id_col), parts).cast("int")).repartition("centre", "part").sortWithinPartitions("centre", "part")
        return dealt.mapInArrow(run, "centre int, part int, ids array<long>, unit binary, groups array<string>"), parts

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int = 4, block: int = BLOCK) -> DataFrame:
        held, parts = self._blocks(self.vectors, block)
        asked, _ = self._blocks(self._assigned(queries, probes), block)
        v = held.select(F.col("centre").alias("cell"), F.col("part").alias("at"), F.struct("ids", "unit", "groups").alias("v"))
        q = asked.select("centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.struct("ids", "unit", "groups").alias("q"))
        groups = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a named number, as small blocks are much work and Spark would join them
        q, v = q.repartition(groups, "centre", "part"), v.repartition(groups, "cell", "at")
        pairs = q.join(v.hint("shuffle_hash"), (q.centre == v.cell) & (q.part == v["at"])).select("q", "v")
        return _ranked(pairs, k, self.id_col, self.centres.shape[1]).select("query_id", self.id_col, clipped(), "rank")


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``n_exact, n_found, recall``: how many of the exact matches a search has."""
    hits = found.select("query_id", id_col, F.lit(1).alias("hit"))
    sums = exact.join(hits, ["query_id", id_col], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return sums.select("*", F.coalesce(F.try_divide("n_found", "n_exact"), F.lit(1.0)).alias("recall"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has length zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def embedded(column: pa.Array, size: int = SIZE) -> np.ndarray:
    """Signed hashes of each text's words and their 3-grams, of length one; words are runs of letters, digits and bytes beyond ASCII."""
    texts = column.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    out = np.zeros((len(texts), size))
    if not len(data):
        return out
    offsets = offsets - offsets[0]
    inside = np.concatenate((_IN_WORD[data], [False]))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    goes_on = inside[1:] & ~edge[1:]  # whether the next byte is of the same word
    letter = _LOWER[data].astype(np.uint64) + np.uint64(1)
    starts = np.flatnonzero(inside[:-1] & np.concatenate(([True], ~(inside[:-2] & goes_on[:-1]))))
    ends = np.flatnonzero(inside[:-1] & ~goes_on) + 1
    at = np.arange(len(data)) - np.repeat(starts, ends - starts)[np.cumsum(inside[:-1]) - 1] if len(starts) else np.zeros(len(data), np.int64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(inside[:-1], _scattered(letter + (at.astype(np.uint64) << np.uint64(9))), np.uint64(0)))))
    word = total[ends] - total[starts]
    step = np.concatenate((goes_on, [False, False]))
    two, three = step[: len(data)], step[: len(data)] & step[1 : len(data) + 1]
    padded = np.concatenate((letter, np.zeros(2, np.uint64)))
    gram = letter + (np.where(two, padded[1 : len(data) + 1], 0).astype(np.uint64) << np.uint64(16)) + (np.where(three, padded[2 : len(data) + 2], 0).astype(np.uint64) << np.uint64(32))
    whole = np.zeros(len(data), dtype=bool)
    whole[starts] = ends - starts < 3  # a short word is its own gram
    of_gram = np.flatnonzero(inside[:-1] & (three | whole))
    hashes = np.concatenate((_scattered(word), _scattered(gram[of_gram] + np.uint64(1 << 60))))
    row = np.searchsorted(offsets, np.concatenate((starts, of_gram)), side="right") - 1
    np.add.at(out, (row, (hashes % np.uint64(size)).astype(np.int64)), np.where(hashes >> np.uint64(63), -1.0, 1.0))
    return normalise(out)


def embed_texts(rows: DataFrame, text_col: str, into: str = "embedding", size: int = SIZE) -> DataFrame:
    """``rows`` with an offline stand-in for a sentence model (``embedded``); a null or empty text has a zero vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = embedded(batch.column(batch.schema.get_field_index(text_col)), size).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size), pa.array(unit.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))]))
