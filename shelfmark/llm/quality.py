"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is described by a few shape features (lengths, shares of character
classes, repetition). Every feature is cut into bins at its quantiles, and
boosting goes round the features: a shallow tree on one feature's bins at a
time, added at a small rate to that feature's lookup table. Then the pairs of
features that explain most of what is left get tables of their own, grown by
trees with one cut on each axis. A score is the sum of table entries through
the logistic function: vectorised lookups and additions.

Training reads ``labels.quality`` of rows whose crc32 of the id (as text) leaves
no ``HELD_OUT`` modulo ``FOLDS``, at most ``SAMPLE_ROWS`` of them (by digest of
the id); the features are taken from the whole texts. Nothing but the text is
an input of a score.

Edge cases. NULL text is empty, and empty texts are scored. Labels that are
NULL, or of ids without a document, are left out; labels given twice both
count. Without labels every score is 0.5; with labels of one kind it leans to
that kind. Rows without id are not held out. Rows that repeat get the same
score. An empty table gives an empty result. Other columns, whatever their
names, are kept by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import tokens
from shelfmark.llm.common import fresh, stored

FOLDS, HELD_OUT, SAMPLE_ROWS = 3, 1, 20_000
FEATURES = (
    "log_chars", "log_words", "word_chars", "upper", "lower", "digits", "blanks", "stops", "symbols", "shouts", "other",
    "entropy", "distinct_words", "top_word", "log_line", "repeated_lines",
)
_BINS, _COARSE, _ROUNDS, _RATE, _PAIRS, _PAIR_ROUNDS = 32, 8, 80, 0.2, 6, 30


def _class_table() -> np.ndarray:
    """Character class of every byte: one column for each share."""
    table = np.zeros((256, 8), np.float64)
    for byte in range(256):
        c = chr(byte)
        kind = (0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 if c.isspace()
                else 4 if c in ".,;:'\"-" else 6 if c in "!?" else 5) if byte < 128 else 7
        table[byte, kind] = 1
    return table


_CLASSES = _class_table()


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    words, offsets = tokens.word_hashes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts.to_pylist()):
        text = text or ""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts = np.bincount(data, minlength=256)
        total = max(len(data), 1)
        upper, lower, digits, blanks, stops, symbols, shouts, other = counts @ _CLASSES / total
        p = counts[counts > 0] / total
        own = words[offsets[i]:offsets[i + 1]]
        n = max(len(own), 1)
        times = np.unique(own, return_counts=True)[1]
        lines = [line for line in text.split("\n") if line]
        out[i] = (
            np.log1p(len(text)), np.log1p(len(own)), (total - counts[32] - counts[10]) / n, upper, lower, digits, blanks, stops,
            symbols, shouts, other, -(p * np.log2(p)).sum(), len(times) / n, times.max(initial=0) / n,
            np.log1p(len(text) / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
        )
    return out


@dataclass(frozen=True)
class Model:
    """Bin borders and tables; ``pairs`` have coarser borders of their own."""

    bias: float
    borders: list[np.ndarray]
    tables: np.ndarray
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for i, borders in enumerate(self.borders):
            total += self.tables[i][np.searchsorted(borders, x[:, i], side="right")]
        for i, j, table in self.pairs:
            a = np.searchsorted(self.coarse[i], x[:, i], side="right")
            total += table[a, np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin: the bins are cut in two, ``depth`` times, where that explains most."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf value of each cell) of the best tree with one cut on each axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, cells = 0.0, np.zeros_like(g)
    rows, columns = np.meshgrid(np.arange(len(g) - 1), np.arange(g.shape[1] - 1), indexing="ij")
    gain, parts = np.zeros(rows.shape), []
    for a in (0, 1):
        for b in (0, 1):
            q = []
            for c in (cg, ch):
                corner, row, column = c[rows, columns], c[rows, -1], c[-1, columns]
                q.append((corner, row - corner, column - corner, c[-1, -1] - row - column + corner)[2 * a + b])
            gain = gain + _gain(*q)
            parts.append(q)
    if gain.size:
        r, c = np.unravel_index(int(gain.argmax()), gain.shape)
        best = float(gain[r, c] - _gain(g.sum(), h.sum()))
        values = [q[0][r, c] / (q[1][r, c] + 1.0) for q in parts]
        cells[:r + 1, :c + 1], cells[:r + 1, c + 1:], cells[r + 1:, :c + 1], cells[r + 1:, c + 1:] = values
    return best, cells


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost tables for rows of features with labels 0 and 1."""
    n, width = x.shape if len(x) else (0, len(FEATURES))
    if not n:
        return Model(0.0, [np.zeros(0)] * width, np.zeros((width, _BINS)), [np.zeros(0)] * width, [])
    rate = (y.sum() + 1) / (n + 2)
    bias = float(np.log(rate / (1 - rate)))
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, _BINS + 1)[1:-1])) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, _COARSE + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(b, c, side="right") for b, c in zip(borders, x.T, strict=True)]
    cells = [np.searchsorted(b, c, side="right") for b, c in zip(coarse, x.T, strict=True)]
    tables, total = np.zeros((width, _BINS)), np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(_ROUNDS):
        for i in range(width):
            g, h = slopes()
            step = _RATE * _tree(np.bincount(bins[i], g, _BINS), np.bincount(bins[i], h, _BINS), 2)
            tables[i] += step
            total = total + step[bins[i]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at = cells[i] * _COARSE + cells[j]
        return tuple(np.bincount(at, v, _COARSE * _COARSE).reshape(_COARSE, _COARSE) for v in (g, h))

    gains = sorted(((_quadrants(*grid(i, j))[0], i, j) for i in range(width) for j in range(i)), reverse=True)
    pairs = [(i, j, np.zeros((_COARSE, _COARSE))) for gain, i, j in gains[:_PAIRS] if gain > 0]
    for _ in range(_PAIR_ROUNDS):
        for i, j, table in pairs:
            step = _RATE * _quadrants(*grid(i, j))[1]
            table += step
            total = total + step[cells[i], cells[j]]
    return Model(bias, borders, tables, coarse, pairs)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model on at most ``sample_rows`` labelled rows that are not held out."""
    given = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    few = stored(
        given.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_label"))
        .withColumn("_digest", F.md5(F.col("_id").cast("string").cast("binary")))
        .orderBy("_digest", "_id", "_label").limit(sample_rows).drop("_digest"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 0):
                x = features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column(1)], names=["x", "y"])

    # At most ``sample_rows`` labels: a bounded side.
    rows = docs.join(F.broadcast(few), docs["doc_id"] == few["_id"]).select(docs["text"], "_label").mapInArrow(
        described, "x array<double>, y int").collect()
    rows = sorted((tuple(r["x"]), r["y"]) for r in rows)
    return fit(np.array([x for x, _ in rows]), np.array([min(max(y, 0), 1) for _, y in rows], float))


def score(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """(documents with their score, the column's name)."""
    name = fresh(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, text):
                p = model.score(features(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], names=[f.name for f in schema])

    return docs.mapInArrow(work, schema), name


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows, name = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "doc_id", held_out().alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted"))
