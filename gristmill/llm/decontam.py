"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import map_batches, settle
from gristmill.llm._tokens import shingle_hashes, squeeze, texts_of, whole_shingles, word_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints are near if they differ in so many bits at most; of four blocks of sixteen bits one then differs in three at most.
RADIUS, BLOCKS = 15, 4
#: Items compared in one pass over the documents, and bytes of their text.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 8 << 20
_FILTER_BITS = 22
#: Places of items' shingles in a document that are counted at once.
_PLACES = 1 << 20
#: What a block may differ by: 697 values of 65,536.
_NEAR = np.array([sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(64 // BLOCKS), n)], dtype=np.uint16)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Each hash as 64 values of 1 and -1."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


class ItemIndex:
    """The items of one pass: shingles with their weights, the shingles of all items, and fingerprints in blocks."""

    def __init__(self, item_ids: list[int], texts: list[str | None], k: int = SHINGLE):
        self.k = k
        self.ids, self.size, self.shingles, prints = [], [], [], []
        for t in texts_of(pa.array(texts, type=pa.string()), most_bytes=1):
            t_words = squeeze(t)
            starts, ends, _ = words(t_words)
            if not len(starts):
                continue
            h = word_hashes(t_words.data, starts, ends)
            s = shingle_hashes(h, min(k, len(h)))
            self.ids.append(item_ids[t.first])
            self.size.append(len(h))
            unique, weight = np.unique(s, return_counts=True)
            self.shingles.append((unique, weight))
            prints.append(np.packbits(bits_of(s).sum(axis=0) > 0, bitorder="little").view("<u8")[0])
        self.size = np.array(self.size, dtype=np.int64)
        self.prints = np.array(prints, dtype=np.uint64)
        # One entry for each item and shingle of k words; items of fewer words have one shingle, all their words.
        self.short = {int(n): np.flatnonzero(self.size == n) for n in np.unique(self.size[self.size < k])} if len(self.ids) else {}
        long = [i for i in range(len(self.ids)) if self.size[i] >= k]
        item = np.concatenate([np.full(len(self.shingles[i][0]), i) for i in long]) if long else np.zeros(0, int)
        seed = np.concatenate([self.shingles[i][0] for i in long]) if long else np.zeros(0, np.uint64)
        weight = np.concatenate([self.shingles[i][1] for i in long]) if long else np.zeros(0, int)
        order = np.argsort(seed, kind="stable")
        self.seed, self.seed_item, self.seed_weight = seed[order], item[order], weight[order]
        self.weight = np.array([w.sum() for _, w in self.shingles], dtype=np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.seed >> np.uint64(64 - _FILTER_BITS)] = True

    def seeds(self, shingle: np.ndarray) -> np.ndarray:
        """Positions whose shingle is one of any item: each window that is similar to an item holds one."""
        at = np.flatnonzero(self.filter[shingle >> np.uint64(64 - _FILTER_BITS)])
        if not len(at) or not len(self.seed):
            return at[:0]
        found = np.searchsorted(self.seed, shingle[at])
        return at[self.seed[np.minimum(found, len(self.seed) - 1)] == shingle[at]]

    def near_items(self, prints: np.ndarray, size: int, items: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Items of one size (of ``items``, or all) with the windows whose fingerprints are within the radius.

        The windows are indexed by each block of their fingerprints; an item asks for the values near its own block, which
        misses no window within the radius, and what that proposes is measured.
        """
        parts = prints.astype("<u8").view("<u2").reshape(-1, BLOCKS)
        order = np.argsort(parts, axis=0, kind="stable")
        tables = [parts[order[:, b], b] for b in range(BLOCKS)]
        for i in np.flatnonzero(self.size == size) if items is None else items[self.size[items] == size]:
            own = self.prints[i : i + 1].astype("<u8").view("<u2")
            proposed = [order[_ranges(*_span(tables[b], own[b] ^ _NEAR)), b] for b in range(BLOCKS)]
            at = np.unique(np.concatenate(proposed))
            at = at[np.bitwise_count(prints[at] ^ self.prints[i]) <= RADIUS]
            if len(at):
                yield int(i), at


def window_prints(shingle: np.ndarray, length: int, n: int) -> np.ndarray:
    """The SimHash of the ``length`` shingles from each of ``n`` places on, from running sums of their bits."""
    out = np.empty(n, dtype=np.uint64)
    for a in range(0, n, 1 << 14):
        z = min(n, a + (1 << 14))
        total = np.zeros((z - a + length, 64), dtype=np.int32)
        np.cumsum(bits_of(shingle[a : z + length - 1]), axis=0, out=total[1:])
        out[a:z] = np.packbits(total[length:] > total[: z - a], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _document(index: ItemIndex, hashes: np.ndarray, shingle: np.ndarray, seeds: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the best window of one document for each item that has one.

    Items of which the whole document holds too few shingles are left out, which bounds all their windows. Of the others
    the windows near by fingerprint are verified first; a whole copy is near and no window is better. Where none is
    whole, the fingerprint may be too far from a window that holds enough, so every window is measured: exact for the rest.
    """
    unique, count = np.unique(shingle[seeds], return_counts=True)
    first, last = _span(index.seed, unique)
    at = _ranges(first, last)
    held = np.bincount(index.seed_item[at], np.minimum(np.repeat(count, last - first), index.seed_weight[at]), len(index.ids))
    some = np.zeros(len(index.ids), dtype=bool)
    some[index.seed_item[at]] = True
    some &= held / index.weight >= least
    items = np.flatnonzero(some)
    if not len(items):
        return []
    out, rest = [], []
    for size in np.unique(index.size[items]):
        length, n = int(size) - index.k + 1, len(hashes) - int(size) + 1
        near = dict(index.near_items(window_prints(shingle, length, n), size, items)) if n > 0 else {}
        for i in items[index.size[items] == size]:
            whole = next((w for w in near.get(int(i), ()) if _holds_all(index, int(i), shingle[w : w + length])), None)
            if whole is None:
                rest.append(i)
            else:
                out.append((int(i), 1.0, int(whole), int(size)))
    if rest:
        of_rest = np.zeros(len(index.ids), dtype=bool)
        of_rest[rest] = True
        out += _measured(index, hashes, shingle, seeds, at[of_rest[index.seed_item[at]]], least)
    return out


def _holds_all(index: ItemIndex, item: int, shingle: np.ndarray) -> bool:
    unique, weight = np.unique(shingle, return_counts=True)
    return np.array_equal(unique, index.shingles[item][0]) and np.array_equal(weight, index.shingles[item][1])


def _measured(index: ItemIndex, hashes: np.ndarray, shingle: np.ndarray, seeds: np.ndarray, entries: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """The best window of each item of ``entries`` of the index, of all windows, by sliding counts.

    A window counts a shingle as often as the item holds it at most: a place counts in those windows that hold it, but
    not also the place so many before it.
    """
    entries = entries[np.argsort(index.seed_item[entries], kind="stable")]
    order = np.argsort(shingle[seeds], kind="stable")
    places, ordered = seeds[order], shingle[seeds][order]  # equal shingles in the order of their places
    out = []
    for entry in np.split(entries, np.flatnonzero(np.diff(index.seed_item[entries])) + 1):
        item = int(index.seed_item[entry[0]])
        size = int(index.size[item])
        n = max(len(hashes) - size + 1, 1)  # a document shorter than the item is one window, which may hold enough of it
        length = min(size, len(hashes)) - index.k + 1
        change = np.zeros(n + 1, dtype=np.int64)
        begin, end = _span(ordered, index.seed[entry])
        cut = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(end - begin) // _PLACES)) + 1, [len(entry)]))
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            j = _ranges(begin[a:z], end[a:z])
            before = j - np.repeat(index.seed_weight[entry[a:z]], end[a:z] - begin[a:z])
            lower = np.where(before >= np.repeat(begin[a:z], end[a:z] - begin[a:z]), places[np.maximum(before, 0)], -1)
            low, high = np.maximum(np.maximum(places[j] - length, lower) + 1, 0), np.minimum(places[j], n - 1) + 1
            real = low < high
            np.add.at(change, low[real], 1)
            np.add.at(change, high[real], -1)
        shared = np.cumsum(change[:n])
        w = int(np.argmax(shared))
        similar = float(shared[w] / index.weight[item])
        if similar >= least:
            out.append((item, similar, w, size))
    return out


def _span(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(ordered, values, side="left"), np.searchsorted(ordered, values, side="right")


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _short_matches(index: ItemIndex, hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
    """Items of fewer words than a shingle: only the same words match."""
    out = []
    for n, items in index.short.items():
        here = shingle_hashes(hashes, n)
        for i in items:
            at = np.flatnonzero(here == index.shingles[i][0][0])
            if len(at):
                out.append((int(i), 1.0, int(at[0]), n))
    return out


_SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _passes(benchmark: DataFrame, id_col: str, text_col: str, items: int, most_bytes: int) -> Iterator[tuple[list[int], list[str | None]]]:
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        if r[1] is None:
            continue
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if len(ids) == items or size >= most_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _mapper(index: ItemIndex, least: float):
    def matches(column: pa.Array) -> Iterator[tuple[int, list[tuple[int, float, int, int]]]]:
        for raw in texts_of(column):
            t = squeeze(raw)
            starts, ends, first = words(t)
            h = word_hashes(t.data, starts, ends)
            s = shingle_hashes(h, index.k)
            seeds = index.seeds(s)
            seeds = seeds[whole_shingles(first, len(h), index.k)[seeds]]
            cut = np.searchsorted(seeds, first)
            rows = range(len(t)) if index.short else np.flatnonzero(np.diff(cut))
            for i in rows:
                a, z = first[i], first[i + 1]
                own = seeds[cut[i] : cut[i + 1]] - a
                found = _document(index, h[a:z], s[a : max(a, z - index.k + 1)], own, least) if len(own) else []
                found += _short_matches(index, h[a:z]) if index.short else []
                if found:
                    yield t.first + int(i), found

    return matches


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: the best window of every document for each item it holds.

    Words are compared without case and punctuation. A window of as many words as the item is a match if the shingles it
    shares weigh at least ``similarity`` of all the item's. Items go to the executors in blocks of bounded size, each
    block over all documents. Items of fewer words than a shingle match only where all their words follow each other;
    null items, items without words and null or empty texts match nothing. Repeated rows match each; of windows that are
    equally similar the first counts. Texts may be of any length: time grows with their words, not with words times items.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ids, texts in _passes(benchmark, item_col, item_text_col, items_per_pass, bytes_per_pass):
        index = ItemIndex(ids, texts, shingle)
        if not index.ids:
            continue
        matches = _mapper(index, similarity)

        def run(batches: Iterator[pa.RecordBatch], matches=matches, ids=tuple(index.ids)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(batch.column(0)[i].as_py(), ids[item], s, w, n) for i, m in matches(batch.column(1)) for item, s, w, n in m]
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        # One block of items is mapped as it is asked for; before another comes, the rows so far are written, so that the driver and each task hold one block.
        out = map_batches(rows, run, _SCHEMA) if out is None else settle(out, "items").union(map_batches(rows, run, _SCHEMA))
    return docs.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """The rows of ``docs`` whose whole text holds no item, by the rules of ``contaminated``; one filter for each block of items.

    The rows left are written between blocks of items, so that each task holds one block. All columns stay, whatever they are called;
    null and empty texts hold nothing and stay; repeated rows each stay or go.
    """
    first = True
    for ids, texts in _passes(benchmark, item_col, item_text_col, items_per_pass, bytes_per_pass):
        matches = _mapper(ItemIndex(ids, texts, shingle), similarity)

        def run(batches: Iterator[pa.RecordBatch], matches=matches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[i for i, _ in matches(batch.column(batch.schema.get_field_index(text_col)))]] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        docs = map_batches(docs if first else settle(docs, "clean"), run, docs.schema)
        first = False
    return docs
