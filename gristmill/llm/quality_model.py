"""A quality classifier without labels: heuristic labellers vote, expectation-maximisation estimates how far to trust
each, and the posterior labels train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import map_batches
from gristmill.llm._tokens import PIECE, Texts, texts_of, word_hashes, words

#: Texts of fewer words say nothing by their capitals and stops.
FEW = 8
ABSTAIN, GOOD, BAD = 0, 1, 2
BUCKETS = 1 << 18
#: Texts fitted at most, half of them from each side of the posterior.
SAMPLE = 4000

_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_UPPER = np.zeros(256, dtype=np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_MARK = np.zeros(256, dtype=np.uint8)
_MARK[[ord("!"), ord("?")]] = 1
#: What a word seldom ends in.
_ODD = np.ones(256, dtype=np.uint8)
_ODD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *map(ord, ".,;:!?)]}'\"")]] = 0
_STOP = np.zeros(256, dtype=np.uint8)
_STOP[[ord(c) for c in ".,;:"]] = 1

#: The labellers: (measurement, votes bad below, votes good from, votes good up to, votes bad above). Where good begins
#: beyond where it ends a labeller only knows bad texts. Kinds of bad text show to two or three labellers each.
LABELLERS = (
    ("words", 1.0, 12.0, np.inf, np.inf),
    ("symbols_per_word", -1.0, 1.0, 0.0, 0.15),
    ("odd_ends_per_word", -1.0, 1.0, 0.0, 0.15),
    ("upper_per_letter", -1.0, 1.0, 0.0, 0.35),
    ("marks_per_word", -1.0, 1.0, 0.0, 0.15),
    ("distinct_per_word", 0.15, 1.0, 0.0, 2.0),
    ("longest_run", -1.0, 1.0, 0.0, 5.5),
    ("letters_per_word", 1.5, 1.0, 0.0, 15.0),
    ("stops_per_word", 0.01, 0.04, 0.4, 0.8),
)
NAMES = tuple(x[0] for x in LABELLERS)


def _per_text(texts: Texts, values: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def measure(texts: Texts) -> np.ndarray:
    """One row of measurements for each whole text, in the order of ``LABELLERS``; without words all are zero."""
    starts, ends, first = words(texts)
    n = np.diff(first).astype(np.float64)
    some = np.maximum(n, 1)
    h = word_hashes(texts.data, starts, ends)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
    odd = np.bincount(doc.astype(np.int64), weights=_ODD[texts.data[ends - 1]] if len(ends) else None, minlength=len(texts))
    keyed = np.sort((doc << np.uint64(43)) | (h >> np.uint64(21)))
    fresh = np.concatenate(([True], keyed[1:] != keyed[:-1])) if len(keyed) else np.zeros(0, bool)
    distinct = np.bincount((keyed[fresh] >> np.uint64(43)).astype(np.int64), minlength=len(texts))
    letters = _per_text(texts, _LETTER[texts.data])
    run = np.zeros(len(texts))
    if len(h):
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
        at = np.arange(len(h))
        since = at - np.maximum.accumulate(np.where(same, 0, at)) + 1
        np.maximum.at(run, doc.astype(np.int64), since)
    columns = [
        n,
        _per_text(texts, _SYMBOL[texts.data]) / some,
        odd / some,
        np.where(n >= FEW, _per_text(texts, _UPPER[texts.data]) / np.maximum(letters, 1), 0.1),
        _per_text(texts, _MARK[texts.data]) / some,
        np.where(n > 0, distinct / some, 0),
        run,
        letters / some,
        np.where(n >= FEW, _per_text(texts, _STOP[texts.data]) / some, 0.1),
    ]
    return np.stack(columns, axis=1)


def votes(measured: np.ndarray) -> np.ndarray:
    """Each labeller's vote on each text: good, bad, or none where the measurement is in between."""
    out = np.full(measured.shape, ABSTAIN, dtype=np.int64)
    for j, (_, low, good_from, good_to, high) in enumerate(LABELLERS):
        x = measured[:, j]
        out[(x >= good_from) & (x <= good_to), j] = GOOD
        out[(x < low) | (x > high), j] = BAD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def unpattern(p: np.ndarray) -> np.ndarray:
    return (np.asarray(p)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


@dataclass
class LabelModel:
    """``prior`` of good, and for each labeller the chance of each vote on good and on bad texts."""

    prior: float
    chance: np.ndarray  # labeller x (good, bad) x (abstain, good, bad)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that a text with these votes is good."""
        v = unpattern(patterns)
        odds = np.full(len(v), np.log(self.prior) - np.log1p(-self.prior))
        for j in range(len(LABELLERS)):
            odds += np.log(self.chance[j, 0, v[:, j]]) - np.log(self.chance[j, 1, v[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracy(self) -> dict[str, tuple[float, float]]:
        """Of each labeller's votes, the chance to be right on good and on bad texts."""
        said = self.chance[:, :, 1:] / self.chance[:, :, 1:].sum(axis=2, keepdims=True)
        return {name: (float(said[j, 0, 0]), float(said[j, 1, 1])) for j, name in enumerate(NAMES)}


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many texts have each, from texts without a bad vote as good ones.

    Smoothing keeps every chance above zero; with no texts the labellers are taken as mostly right.
    """
    v = unpattern(patterns)
    q = np.where((v == BAD).any(axis=1), 0.05, 0.95)
    start = np.array([[0.3, 0.69, 0.01], [0.3, 0.3, 0.4]])
    model = LabelModel(0.8, np.tile(start, (len(LABELLERS), 1, 1)))
    for _ in range(rounds if len(v) else 0):
        w = np.stack((q * counts, (1 - q) * counts))
        prior = float((w[0].sum() + 1) / (w.sum() + 2))
        chance = np.stack([[[w[c, v[:, j] == x].sum() for x in range(3)] for c in range(2)] for j in range(len(LABELLERS))])
        # A few pseudo-texts for which labellers are mostly right: enough to keep good good and bad bad.
        chance = chance + start * (1 + 0.001 * counts.sum())
        model = LabelModel(prior, chance / chance.sum(axis=2, keepdims=True))
        q, before = model.posterior(patterns), q
        if np.abs(q - before).max() < 1e-6:
            break
    return model


def features(texts: Texts, measured: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the mean weight of its hashed three-byte windows, plus those of its measurements' ranges."""
    sums = np.zeros(len(texts))
    size = np.diff(texts.offsets)
    for a in range(0, len(texts.data), PIECE):
        h = _trigrams(texts.data[a : a + PIECE + 2])
        n = min(len(h), PIECE)
        bounds = np.clip(texts.offsets - a, 0, n)
        w = weights[h[:n]].astype(np.float64)
        for j in (1, 2):  # windows that would reach into the next text
            last = texts.offsets[1:] - a - j
            w[last[(last >= 0) & (last < n)]] = 0
        rows = np.flatnonzero(np.diff(bounds))
        if len(rows):
            sums[rows] += np.add.reduceat(w, bounds[rows])
    return sums / np.maximum(size - 2, 1) + weights[_ranges(measured)].sum(axis=1)


def _trigrams(data: np.ndarray) -> np.ndarray:
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = data.astype(np.uint32)
    h = (b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(0x9E3779B1)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(15)).astype(np.int64) & (BUCKETS // 2 - 1)


def _ranges(measured: np.ndarray) -> np.ndarray:
    """A hashed feature for each measurement's range, eight to a doubling."""
    step = np.round(np.log2(np.maximum(measured, 1 / 256)) * 2).astype(np.int64) + 64
    return BUCKETS // 2 + (step * 64 + np.arange(measured.shape[1])) % (BUCKETS // 2)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, texts: Texts, measured: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(texts, measured, self.weights) + self.bias, -50, 50)))


def train_scorer(texts: list[str | None], target: np.ndarray, epochs: int = 6, rate: float = 2.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features by gradient steps, against posterior labels; both sides weigh the same."""
    weights, bias = np.zeros(BUCKETS, np.float32), 0.0
    rows = []
    for t in texts_of(pa.array(texts, type=pa.string()), most_bytes=1):
        grams, times = np.unique(_trigrams(t.data), return_counts=True)
        rows.append((grams, times / max(1, times.sum()), _ranges(measure(t))[0]))
    good = target.sum()
    weigh_good, weigh_bad = len(target) / max(1.0, 2 * good), len(target) / max(1.0, 2 * (len(target) - good))
    rng = np.random.default_rng(seed)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            grams, share, ranges = rows[i]
            z = float(weights[grams] @ share + weights[ranges].sum() + bias)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            y = target[i]
            g = (p - y) * (y * weigh_good + (1 - y) * weigh_bad) * (1 - steps / total)
            weights[grams] -= (rate * 20 * g * share).astype(np.float32)
            weights[ranges] -= np.float32(rate * 0.02 * g)
            bias -= rate * 0.02 * g
            steps += 1
    return weights, bias


def vote_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``pattern`` of every row: all labellers' votes on its whole text, as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(measure(t))).astype(np.int64))], names=["pattern"])

    return map_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "pattern long")


def _drawn(docs: DataFrame, text_col: str, seed: int, spots: dict[int, int]) -> DataFrame:
    """``spot, text, pattern`` of the texts whose seeded hash is below the limit of their pattern; equal texts once.

    What is above every limit never leaves the scan; votes are counted anew on the little that does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(0).to_numpy()
            for t in texts_of(batch.column(1)):
                found = pattern(votes(measure(t)))
                own = spot[t.first : t.first + len(t)]
                keep = np.flatnonzero(own < np.array([spots.get(int(p), 0) for p in found], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), batch.column(1).slice(t.first, len(t)).take(pa.array(keep)).cast(pa.string()), pa.array(found[keep].astype(np.int64))], names=["spot", "text", "pattern"])

    text = F.col(text_col).cast("string").alias("text")
    near = docs.select(F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1 << 40)).alias("spot"), text).where(F.col("text").isNotNull() & (F.col("spot") < max(spots.values(), default=0)))
    return map_batches(near, run, "spot long, text string, pattern long").dropDuplicates(["spot"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 5) -> QualityModel:
    """Labeller accuracies from the votes on all texts; scorer weights from at most ``sample`` whole texts of least seeded hash.

    The driver gets a count for each vote pattern, 3 to the number of labellers at most, and the sampled texts. Good and
    bad texts, by posterior, are drawn at rates of their own, so that the sample holds both. Texts are drawn by their own
    hash and equal ones once, so repeated rows and ids neither swell the sample nor get each other's votes.
    """
    counted = vote_patterns(docs, text_col).groupBy("pattern").count().orderBy("pattern").collect()
    patterns, counts = np.array([r.pattern for r in counted], dtype=np.int64), np.array([r["count"] for r in counted], dtype=np.float64)
    labels = fit_labels(patterns, counts)
    posterior = labels.posterior(patterns) if len(patterns) else np.zeros(0)
    spots = {}
    for side in (posterior >= 0.5, posterior < 0.5):
        n = counts[side].sum()
        spots |= {int(p): min(1 << 40, int((sample // 2 + 50) * (1 << 40) / n)) for p in patterns[side]}
    of = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    rows = _drawn(docs, text_col, seed, spots).collect() if spots else []  # about ``sample`` rows
    drawn = sorted((r.spot, r.text, of[r.pattern]) for r in rows)
    drawn = [x for side in (True, False) for x in [d for d in drawn if (d[2] >= 0.5) == side][: sample // 2]]
    weights, bias = train_scorer([t for _, t, _ in drawn], np.array([y for _, _, y in drawn])) if drawn else (np.zeros(BUCKETS, np.float32), 0.0)
    return QualityModel(labels, weights, bias)


def classify(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``doc_id, score, label_posterior, kept`` for every row: the scorer's probability that the whole text is good.

    Null texts and texts without words have score 0 and are not kept; a score of just ``least`` is kept. Texts may be of any
    length. Repeated rows are rows of their own, whatever ids they share. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, posterior = [np.zeros(0)], [np.zeros(0)]
            for t in texts_of(batch.column(1)):
                measured = measure(t)
                none = measured[:, 0] == 0
                score.append(np.where(none, 0.0, model.score(t, measured)))
                posterior.append(np.where(none, 0.0, model.labels.posterior(pattern(votes(measured)))))
            s = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(np.concatenate(posterior)), pa.array(s >= least)], names=["doc_id", "score", "label_posterior", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double, label_posterior double, kept boolean")
