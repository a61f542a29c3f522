"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by gradient descent in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import map_batches
from gristmill.llm._tokens import LOWER, PIECE, Texts, texts_of

BUCKETS, SIZE = 1 << 15, 16
#: Labelled texts fitted for each language, at most; all other texts are only counted. Languages learnt, the most frequent ones, at most.
SAMPLE_PER_LANG, MOST_LANGS = 200, 256
UNKNOWN = "und"
#: An answer of a smaller calibrated probability is more likely wrong than right, and always rejected.
EVEN = 0.5

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes as subwords see them: letters in lower case, everything else one boundary.
_FOLD = np.where(_IS_LETTER, LOWER, 0x20).astype(np.uint32)


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte position the hashed subwords of three and four bytes that begin there; no subword has bucket -1."""
    b = np.concatenate((_FOLD[data], np.full(3, 0x20, np.uint32)))
    three = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16
    four = three | b[3:] << 24
    empty = (b[:-3] == 0x20) & (b[1:-2] == 0x20)
    out = []
    for h, seed in ((three, 0x9E3779B1), (four, 0x85EBCA77)):
        h = h * np.uint32(seed)
        h ^= h >> np.uint32(15)
        h = h * np.uint32(0x2C1B3C6D)
        out.append(np.where(empty, -1, (h >> np.uint32(17)).astype(np.int32)))
    return out[0], out[1]


def _sums(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the table's rows over each text's subwords, and how many there are; long texts go by pieces."""
    n = len(texts)
    sums, counts = np.zeros((n, table.shape[1])), np.zeros(n, dtype=np.int64)
    padded = np.vstack((table, np.zeros((1, table.shape[1]), table.dtype)))  # row -1: no subword
    for a in range(0, len(texts.data), PIECE):
        data = texts.data[a : a + PIECE + 3]
        size = min(PIECE, len(texts.data) - a)
        bounds = np.clip(texts.offsets - a, 0, size)
        rows = np.flatnonzero(np.diff(bounds))
        for h, k in zip(subwords(data), (3, 4), strict=True):
            h = h[:size].copy()
            for j in range(1, k):  # the last bytes of a text begin no whole subword
                last = texts.offsets[1:] - a - j
                h[last[(last >= np.maximum(texts.offsets[:-1] - a, 0)) & (last < size)]] = -1
            sums[rows] += np.add.reduceat(padded[h], bounds[rows], axis=0)
            counts[rows] += np.add.reduceat((h >= 0).astype(np.int64), bounds[rows])
    return sums, counts


def has_letter(texts: Texts) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    out = np.zeros(len(texts), dtype=bool)
    if len(texts.data):
        ascii_letter = _IS_LETTER[texts.data] & (texts.data < 128)
        total = np.concatenate(([0], np.cumsum(ascii_letter)))
        out = total[texts.offsets[1:]] > total[texts.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(texts.offsets) > 0)):
        text = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(unicodedata.category(c)[0] == "L" for c in text)
    return out


@dataclass
class LanguageModel:
    """``table`` is the embedding of each subword times the softmax weights, all that prediction needs."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def predict(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the language's index (-1: null or no letter), its calibrated probability, and whether it is rejected."""
        n = len(texts)
        known = has_letter(texts) & ~texts.null & bool(self.langs)
        if not self.langs:
            return np.full(n, -1), np.zeros(n), np.ones(n, dtype=bool)
        sums, counts = _sums(texts, self.table)
        p = softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(known, p[np.arange(n), best], 0.0)
        return np.where(known, best, -1), score, ~known | (score < self.reject_below)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _segments(data: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """The whole text, cut into stretches of 24 to 600 bytes, so that short texts are learnt as well as long ones."""
    cuts = [0]
    while cuts[-1] < len(data):
        cuts.append(cuts[-1] + int(np.exp(rng.uniform(np.log(24), np.log(600)))))
    return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def train(samples: list[tuple[str, str]], epochs: int = 2, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Fit on (language, whole text) pairs; a fifth of the texts is kept back to calibrate the temperature and the rejection.

    The temperature is the one of least log loss there. A prediction is rejected below the lowest score at which
    accepted predictions err at most once in 200, but never more than one in 1000 correct ones is given up for it; and where it is
    below ``EVEN``.
    """
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    fit, held = [], []
    for i, (lang, text) in enumerate(samples):
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        for piece in _segments(data, rng):
            h = np.concatenate(subwords(piece))
            if (h >= 0).any():
                (held if i % 5 == 4 else fit).append((langs.index(lang), h[h >= 0]))
    embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    weight, bias = np.zeros((SIZE, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, total = 0, max(1, epochs * len(fit))
    share = np.bincount([y for y, _ in fit], minlength=len(langs))
    scale = len(fit) / np.maximum(share, 1) / len(langs)  # rare languages weigh as much as common ones
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            y, h = fit[i]
            step = rate * (1 - steps / total) * min(scale[y], 10.0)
            steps += 1
            mean = embed[h].mean(axis=0)
            z = mean @ weight + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = weight @ g
            weight -= step * np.outer(mean, g)
            bias -= 0.1 * step * g
            np.subtract.at(embed, h, (step * 8 / len(h)) * back)
    model = LanguageModel(langs, (embed @ weight).astype(np.float32), bias.astype(np.float64))
    if held:
        z = np.array([model.table[h].mean(axis=0) + bias for _, h in held], dtype=np.float64)
        y = np.array([y for y, _ in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
        model.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()))
        p = softmax(z / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y
        model.reject_below = max(EVEN, _threshold(score, right))
    return model


def _threshold(score: np.ndarray, right: np.ndarray, error: float = 0.005, given_up: float = 0.001) -> float:
    order = np.argsort(score, kind="stable")
    s, ok = score[order], right[order]
    kept = np.arange(len(s), 0, -1)
    wrong_above = np.cumsum((~ok)[::-1])[::-1]
    fine = np.flatnonzero(wrong_above <= error * kept)
    lost = np.concatenate(([0], np.cumsum(ok)))[: len(s)]
    at = int(fine[0]) if len(fine) else len(s) - 1
    at = min(at, int(np.searchsorted(lost, given_up * max(1, ok.sum()), side="right")) - 1)
    return float(s[at]) if at > 0 else 0.0


def held_out(id_col: str = "doc_id"):
    """One text in four, by crc32 of its id, is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, most_langs: int = MOST_LANGS, seed: int = 7) -> LanguageModel:
    """Train on a bounded sample: at most ``sample_per_lang`` whole texts of each language, those of least seeded hash.

    Languages are counted over all rows that may be learnt from, and each gets its own share of the hash range, so the
    sample that the driver receives has about twice the bound, however many rows a language has. The hash is of the text,
    and equal texts of a language are drawn once, however often they or their ids repeat. Beyond ``most_langs`` languages the most
    frequent are learnt, then by name. Held-out rows, null texts and null languages are not learnt from; without any row the
    model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").where(~held_out())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    share = F.floor(F.least(F.lit(1.0), (2 * sample_per_lang + 20) / F.col("n")) * (1 << 40)).alias("share")
    spot = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40)).alias("spot")
    shares = counts.select(F.col("lang").alias("_lang"), share)  # ``most_langs`` rows at most
    drawn: dict[str, list] = {}
    for r in rows.select("lang", "text", spot).join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where("spot < share").dropDuplicates(["lang", "spot"]).select("lang", "spot", "text").collect():
        drawn.setdefault(r.lang, []).append((r.spot, r.text))
    samples = [(lang, text) for lang in sorted(drawn) for _, text in sorted(drawn[lang])[:sample_per_lang]]
    return train(samples, seed=seed)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every input row, from its whole text alone.

    Null texts and texts without letters are ``und`` with score 0, and rejected. Of equal scores the first language by name is
    predicted. Texts may be of any length, repeated rows are rows of their own. Other columns are not read.
    """
    names = pa.array([*model.langs, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, rejected = _judged(model, batch.column(1))
            columns = [batch.column(0), names.take(pa.array(best % len(names))), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = _judged(model, batch.column(batch.schema.get_field_index(text_col)))[2]
            yield batch.filter(pa.array(~rejected)) if rejected.any() else batch

    return map_batches(docs, run, docs.schema)


def _judged(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [model.predict(t) for t in texts_of(column)]
    if not found:
        return np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
