"""Language identification by hierarchical discrimination.

A text is described by the relative frequencies of its letters, letter pairs
and triples (hashed; other characters count as gaps). Linear support vector
machines first choose the language family; within it, one machine for each pair
of languages votes, which tells closely related languages apart.

Training reads ``text`` and non-NULL ``lang`` of rows whose crc32 of the id (as
text) leaves no ``HELD_OUT`` modulo ``FOLDS``, at most ``SAMPLE_ROWS`` of them
(evenly for each language, by digest of the id). Nothing but the text is an
input of a prediction.

Edge cases. NULL text and text without any letter are ``und`` with score 0, also
when nothing could be learned. One learned language is predicted for every
text with letters. Rows without id are not held out. Rows that repeat get the
same answer; of long texts all parts count. An empty table gives an empty
result. Other columns, whatever their names, are kept by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from shelfmark.llm import tokens
from shelfmark.llm.common import fresh

FOLDS, HELD_OUT, SAMPLE_ROWS = 4, 2, 1_200
UNKNOWN = "und"
_BUCKETS, _PIECE, _ROWS, _STEPS = 4_096, 1_000_000, 256, 120

# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def frequencies(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of relative frequencies, whether the text has a letter)."""
    out, lettered = np.zeros((len(texts), _BUCKETS), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        counts = np.zeros(_BUCKETS, np.int64)
        for start in range(0, len(text or ""), _PIECE):
            # Two characters of the next piece complete the last triples of this one.
            piece = text[start:start + _PIECE + 2].lower()
            codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            is_letter = _letters()[codes]
            lettered[i] |= bool(is_letter.any())
            codes = np.concatenate([[np.uint32(32)], np.where(is_letter, codes, np.uint32(32))])
            h = codes * np.uint32(0x9E3779B1)
            for _ in range(2):
                counts += np.bincount(h >> np.uint32(20), minlength=_BUCKETS)
                h = (h[:-1] ^ codes[-len(h) + 1:]) * np.uint32(0x85EBCA6B) if len(h) > 1 else h[:0]
                h = h ^ (h >> np.uint32(15))
            counts += np.bincount(h >> np.uint32(20), minlength=_BUCKETS)
        out[i] = counts / max(counts.sum(), 1)
    return out, lettered


@dataclass(frozen=True)
class Machine:
    """Linear decision between ``first`` (margin above 0) and ``second``."""

    first: str
    second: str
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        """How likely ``first`` is: the margin through the logistic function."""
        return 1 / (1 + np.exp(-np.clip(3 * (x @ self.weights + self.bias), -30, 30)))


def _machine(x: np.ndarray, first: str, second: str, is_first: np.ndarray) -> Machine:
    """L2-regularised squared-hinge machine by accelerated gradient descent."""
    y = np.where(is_first, 1.0, -1.0)
    # Rows of both sides weigh the same in total; features are scaled by their deviation.
    c = np.where(is_first, 0.5 / is_first.sum(), 0.5 / (~is_first).sum())
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-4)
    z = ((x - mean) * scale / np.sqrt(x.shape[1])).astype(np.float32)
    w, b, reg = np.zeros(z.shape[1], np.float32), 0.0, 1e-4
    step = np.float32(1 / (2 * (c * (z * z).sum(1)).sum() + 2 + reg))
    vw, vb = w, b
    for i in range(_STEPS):
        slack = (np.maximum(0, 1 - y * (z @ vw + vb)) * y * c).astype(np.float32)
        nw, nb = vw + step * (2 * (slack @ z) - np.float32(reg) * vw), vb + step * 2 * slack.sum()
        pace = np.float32(i / (i + 3))
        vw, vb = nw + pace * (nw - w), nb + pace * (nb - b)
        w, b = nw, nb
    w = w * scale / np.sqrt(x.shape[1])
    return Machine(first, second, w.astype(np.float32), float(b - mean @ w))


def _between(x: np.ndarray, names: np.ndarray) -> list[Machine]:
    return [
        _machine(x[(names == a) | (names == b)], a, b, names[(names == a) | (names == b)] == a)
        for a, b in combinations(sorted(set(names)), 2)
    ]


def _voted(x: np.ndarray, names: list[str], machines: list[Machine]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the winner in ``names``, its least probability against another)."""
    votes, worst = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
    for m in machines:
        p = m.probability(x)
        for name, q in ((m.first, p), (m.second, 1 - p)):
            i = names.index(name)
            votes[:, i] += (q > 0.5) + 1e-3 * q
            worst[:, i] = np.minimum(worst[:, i], q)
    best = votes.argmax(1)
    return best, worst[np.arange(len(x)), best]


@dataclass(frozen=True)
class Model:
    """Families and languages that were learned, with their machines."""

    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x, lettered = frequencies(texts)
        out, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not self.families:
            return list(out), score
        names = list(self.families)
        family, likely = _voted(x, names, self.between)
        for i, name in enumerate(names):
            rows = np.flatnonzero(lettered & (family == i))
            langs = self.families[name]
            best, p = _voted(x[rows], langs, self.within[name])
            out[rows] = np.array(langs, object)[best]
            score[rows] = likely[rows] * p
        return list(out), score


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model on at most ``sample_rows`` labelled rows that are not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy("lang").limit(sample_rows).collect()}
    if not counts:
        return Model({}, [], {})
    share = max(sample_rows // len(counts), 1)
    # The digest is even on [0, 1): twice the share passes the filter, and the first of these stay.
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10)
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2 * share / n))])
    few = labelled.withColumn("digest", digest.cast("double") / float(1 << 48)).filter(F.col("digest") < rate[F.col("lang")])
    few = few.select("text", "lang", F.row_number().over(W.partitionBy("lang").orderBy("digest")).alias("place"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 0):
                x, lettered = frequencies(part.column(0).to_pylist())
                rows = pa.array([r.tobytes() if ok else None for r, ok in zip(x, lettered, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows, part.column(1)], names=["x", "lang"])

    rows = few.filter(F.col("place") <= share).select("text", "lang").mapInArrow(described, "x binary, lang string")
    rows = rows.filter("x is not null").collect()
    if not rows:
        return Model({}, [], {})
    order = sorted(rows, key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in order])
    langs = np.array([r["lang"] for r in order], object)
    family = np.array([_FAMILY.get(lang, lang) for lang in langs], object)
    families = {f: sorted(set(langs[family == f])) for f in sorted(set(family))}
    return Model(families, _between(x, family), {f: _between(x[family == f], langs[family == f]) for f in families})


def identify(docs: DataFrame, model: Model) -> tuple[DataFrame, str, str]:
    """(documents with predicted language and score, names of the two columns)."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, text):
                for start in range(0, part.num_rows, _ROWS):
                    rows = part.slice(start, _ROWS)
                    names, p = model.predict(rows.column(text).to_pylist())
                    columns = [*rows.columns, pa.array(names, pa.string()), pa.array(p, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.mapInArrow(work, schema), lang, score


def keep_identified(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """Documents in a language that was learned, with a score of ``least_score`` at least; columns unchanged.

    A document is rejected if it has no letters or, above a ``least_score`` of
    0, if no language stands out.
    """
    found, lang, score = identify(docs, train(docs))
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least_score)).drop(lang, score)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    model = train(docs)
    found, _, _ = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
