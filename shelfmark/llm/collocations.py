"""Phrase collocations by top-order marginalisation.

Every word starts one window: the word and the next three of its piece, padded
with NULL at the piece's end. Only these longest windows are taken out of the
texts and counted; a ROLLUP over their four lead columns then sums successively
shorter prefixes. As each contiguous occurrence of a phrase begins exactly one
window, the prefix sums are the counts of all phrases of one to four words, and
no text is gone through once per length.

A window ends early, padded with NULL, after a word pair or triple that cannot
be frequent: no frequent phrase holds such a part, so no count that matters
changes, while most windows become short and equal. Pairs, and then triples of
possible pairs, are counted by hash bucket in passes before, and one bit per
bucket says whether the bucket reaches the least count. A bit table has a fixed
size of 16 MB at any input; parts that share a bucket with others are kept for
nothing, which costs rows and changes no result. The passes go through Arrow
batches: bytes are told apart by one look-up, words are numbers from then on,
and equal windows of a batch leave it as one row.

Phrases that are frequent enough are written to a table, far smaller than the
texts. All later steps use it alone: both parts of each cut of a phrase are at
least as frequent as the phrase, so they are in the table as well.

Windows are counted before the ROLLUP, and both groupings combine rows before
they are moved, so a common phrase or a language that holds most rows loads no
single task. Both parts of a cut are looked up by a broadcast where the counted table
is small, else by a shuffle join with one row per part on the other side, which
Spark may split where many phrases share a part.

Edge cases. NULL text has no words; NULL lang counts as ``und``, together with
rows whose lang is that. Texts are lower-cased for A-Z only. Repeated rows
count each time. Ties in the score go to the more frequent phrase, then to the
phrase first in UTF-8 byte order. An empty table, or one without frequent
phrases, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm import tokens
from shelfmark.llm.common import LOWER, UPPER, small, stored

MAX_WORDS, MIN_COUNT, INSIDE_PERCENT, TOP = 4, 30, 80, 2000
# Bits of a table of word pairs or triples, 16 MB: the driver and every task hold two such tables.
BUCKETS = 1 << 27
_SCALE = 2_000_000
# Text of a batch that is numbered at once, buckets of a range, and windows of a row from Python.
_TEXT_BYTES, _RANGE, _ROWS = 4_000_000, 1 << 16, 10_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD, _BLANK, _END = range(3)
_KIND, _FOLDED = np.full(256, _IN_WORD, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[list(b"\x20\x09")] = _BLANK
_KIND[list(b".,;:!?\x0A\x0B\x0C\x0D")] = _END
_FOLDED[list(UPPER.encode())] = list(LOWER.encode())
_WINDOW = [f"w{i}" for i in range(1, MAX_WORDS + 1)]


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(code of every word in order, distinct words, number of each word's piece, number of its text).

    One look-up per byte tells words, blanks and ends of pieces: no byte of a longer UTF-8 character is one of these.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    starts, kind = offsets[:-1] - offsets[0], _KIND[data]
    first = np.zeros(len(data), bool)
    first[starts[starts < len(data)]] = True
    inside = kind == _IN_WORD
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    at = np.flatnonzero(begins)
    letters = _FOLDED[data[inside]]
    ends = np.append(np.cumsum(inside, dtype=np.int64)[at] - 1, len(letters))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    piece = np.cumsum(first | (kind == _END), dtype=np.int32)[at]
    return words.indices.to_numpy().astype(np.int64), words.dictionary, piece, np.searchsorted(starts, at, side="right") - 1


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each string, the same in every task."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    powers = np.full(int(sizes.max(initial=0)) + 1, _FACTOR)
    powers[0] = 1
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * np.cumprod(powers)[place], dtype=np.uint64)])
    return tokens.mix(total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]])


@dataclass(frozen=True)
class _Words:
    """Words of some texts: ``codes`` of ``words``, number ``lang`` of ``langs``, ``near[k]`` if the one k places on is of the piece."""

    codes: np.ndarray
    words: pa.Array
    lang: np.ndarray
    langs: pa.Array
    near: list[np.ndarray]

    @staticmethod
    def of(langs: pa.Array, texts: pa.Array) -> _Words:
        codes, words, piece, text = _word_codes(texts)
        langs = langs.cast(pa.large_string()).dictionary_encode()
        near = [np.append(piece[k:] == piece[:-k], np.zeros(min(k, len(piece)), bool)) if k else piece >= 0 for k in range(MAX_WORDS)]
        return _Words(codes, words, langs.indices.to_numpy().astype(np.int64)[text], langs.dictionary, near)

    def buckets(self, size: int) -> list[np.ndarray]:
        """For parts of 2 to ``size`` words the hash bucket of the one that begins at each word."""
        word = _hashes(self.words)[self.codes]
        part, out = tokens.mix(_hashes(self.langs)[self.lang] + word), []
        for k in range(1, size):
            part = tokens.mix(part * _FACTOR + np.append(word[k:], np.zeros(min(k, len(word)), np.uint64)))
            out.append(part & np.uint64(BUCKETS - 1))
        return out

    def reach(self, size: int, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(words of the window at each word, of at most ``size``; buckets). It ends where a part has no bit in its table."""
        buckets = self.buckets(min(size, len(tables) + 2))
        may = [(bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) != 0 for bits, b in zip(tables, buckets, strict=False)]
        on, reach = np.ones(len(self.codes), bool), np.ones(len(self.codes), np.int64)
        for end in range(2, size + 1):
            on = on & self.near[end - 1]
            for n, bit in enumerate(may, 2):
                if n <= end:
                    on[:len(on) - (end - n)] &= bit[end - n:]
            reach += on
        return reach, buckets


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Words of batches ``lang, text``, about _TEXT_BYTES of text at once; a longer single text is handled alone."""
    held, size = [], 0
    for batch in batches:
        for part in tokens.slices(batch, 1):
            if size and size + part.nbytes > _TEXT_BYTES:
                yield _Words.of(*(pa.concat_arrays([p.column(c) for p in held]) for c in range(2)))
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield _Words.of(*(pa.concat_arrays([p.column(c) for p in held]) for c in range(2)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.make_valid_utf8("text").alias("text"))


def frequent_parts(docs: DataFrame, size: int, tables: list[np.ndarray], min_count: int) -> DataFrame:
    """``block, bits``: a bit for each hash bucket of parts of ``size`` words, set if it has ``min_count`` of them.

    A block is a range of buckets. Counts of a range are packed in two columns of bytes and summed in the
    task that has the range.
    """
    least = max(min_count, 0)
    # Counts are wanted up to the least one only.
    kind = np.min_scalar_type(least)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(batches):
            reach, buckets = found.reach(size, tables)
            seen, n = np.unique(buckets[size - 2][reach == size].astype(np.uint32), return_counts=True)
            n = np.minimum(n, least).astype(kind)
            ranges = np.unique(seen // _RANGE)
            cuts = [*np.searchsorted(seen, ranges * _RANGE), len(seen)]
            low = (seen % _RANGE).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                pa.array(ranges, pa.int32()),
                pa.array([low[a:b].tobytes() for a, b in pairwise(cuts)], pa.binary()),
                pa.array([n[a:b].tobytes() for a, b in pairwise(cuts)], pa.binary())], names=["block", "at", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = -1, np.zeros(_RANGE, np.int64)

        def bits() -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, at, n in zip(*(batch.column(c) for c in range(3)), strict=True):
                if block.as_py() != last:
                    if last >= 0:
                        yield bits()
                    last, total[:] = block.as_py(), 0
                total[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), kind)
        if last >= 0:
            yield bits()

    every = docs.sparkSession.range(0, BUCKETS // _RANGE, numPartitions=1).select(
        F.col("id").cast("int").alias("block"), F.lit(b"").alias("at"), F.lit(b"").alias("n"))
    rows = _texts(docs).mapInArrow(counted, "block int, at binary, n binary").union(every)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(summed, "block int, bits binary")


def windows(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, w1..w4, n``: windows of a word and the words that follow as far as they can be in a frequent phrase.

    Equal windows of some texts come as one row with their number. Every word begins one.
    """
    tables: list[np.ndarray] = []
    for size in range(2, MAX_WORDS):
        blocks = sorted(stored(frequent_parts(docs, size, tables, min_count)).collect())
        tables.append(np.frombuffer(b"".join(bytes(row["bits"]) for row in blocks), np.uint64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _gathered(batches):
            reach, _ = found.reach(MAX_WORDS, tables)
            kinds, codes = len(found.words) + 1, found.codes
            # Distinct windows by number: those of k words and their next word, or none.
            key = found.lang * kinds + codes
            for k in range(1, MAX_WORDS):
                key = np.unique(key, return_inverse=True)[1] * kinds
                key[reach > k] += codes[np.flatnonzero(reach > k) + k] + 1
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            for low in range(0, len(at), _ROWS):
                part, count = at[low:low + _ROWS], n[low:low + _ROWS]
                columns = [found.langs.take(pa.array(found.lang[part]))]
                for k in range(MAX_WORDS):
                    none = reach[part] <= k
                    columns.append(found.words.take(pa.array(codes[np.where(none, part, part + k)], mask=none)))
                lists = [pa.ListArray.from_arrays([0, len(part)], c.cast(pa.string())) for c in columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.ListArray.from_arrays([0, len(part)], pa.array(count))], names=names)

    names = ["lang", *_WINDOW, "n"]
    schema = ", ".join([*(f"{name} array<string>" for name in names[:-1]), "n array<long>"])
    rows = _texts(docs).mapInArrow(work, schema).select(F.explode_outer(F.arrays_zip(*names)).alias("z"))
    return rows.select(*[F.col(f"z.{name}").alias(name) for name in names])


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, words, f`` of phrases of one to four words with ``min_count`` occurrences.

    One row per language with ``words`` empty holds its number of words, however small.
    """
    counted = windows(docs, min_count).groupBy("lang", *_WINDOW).agg(F.sum("n").alias("n"))
    summed = counted.rollup("lang", *_WINDOW).agg(F.sum("n").alias("f"), F.grouping_id().alias("left_out"))
    # grouping_id has a bit for each column that is summed away: k lead columns stay.
    full = (1 << MAX_WORDS) - 1
    level = F.lit(-1)
    whole = F.lit(False)
    for k in range(MAX_WORDS + 1):
        is_k = F.col("left_out") == full >> k
        level = F.when(is_k, k).otherwise(level)
        whole = whole | (is_k & (F.col(_WINDOW[k - 1]).isNotNull() if k else F.lit(True)))
    words = F.filter(F.array(*_WINDOW), lambda w: w.isNotNull())
    return summed.filter(whole & ((F.col("f") >= min_count) | (level == 0))).select(
        "lang", F.when(level == 0, F.array().cast("array<string>")).otherwise(words).alias("words"), "f")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(counts: DataFrame) -> DataFrame:
    """``lang, words, a, l, r, score`` of phrases of two words and more, by their lowest-scoring cut.

    ``counts`` is the stored result of ``phrase_counts``.
    """
    phrases = counts.filter(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))
    known = counts.filter(F.size("words") > 0).select(
        F.col("lang").alias("_lang"), _joined(F.col("words")).alias("_part"), F.col("f").alias("of_part"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), _joined(F.slice("words", F.lit(1), k)).alias("first"),
        _joined(F.slice("words", k + 1, F.size("words"))).alias("rest")))
    rows = phrases.select("lang", "words", "a", F.explode(cuts).alias("cut")).select(
        "lang", "words", "a", "cut.k", "cut.first", "cut.rest")
    table = small(known)
    for side, name in (("first", "l"), ("rest", "r")):
        rows = rows.join(table, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))).drop("_lang", "_part")
        rows = rows.withColumnRenamed("of_part", name)
    # Whole-number division of decimals: exact, and no product leaves 38 digits.
    rows = rows.withColumn("score", F.expr(
        f"(cast({_SCALE} AS decimal(10, 0)) * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))"))
    lowest = F.min(F.struct("score", "k", "l", "r"))
    return rows.groupBy("lang", "words", "a").agg(lowest.alias("low")).select(
        "lang", "words", "a", "low.l", "low.r", "low.score")


def absorbed(counts: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """``lang, words`` of phrases that mostly occur inside one longer phrase."""
    longer = counts.filter(F.size("words") > 2)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))))
    most = longer.select("lang", "f", F.explode(F.array_distinct(inner)).alias("words")).groupBy("lang", "words").agg(
        F.max("f").alias("most"))
    own = counts.filter(F.size("words") > 1)
    wide = "decimal(20, 0)"
    return own.join(most, ["lang", "words"]).filter(
        F.lit(100).cast("decimal(3, 0)") * F.col("most").cast(wide) >= F.lit(inside_percent).cast("decimal(3, 0)") * F.col("f").cast(wide)
    ).select("lang", "words")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    counts = stored(phrase_counts(docs, min_count))
    left = scored(counts).join(absorbed(counts, inside_percent), ["lang", "words"], "left_anti")
    left = left.withColumn("phrase", _joined(F.col("words")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def report(docs: DataFrame) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language."""
    return collocations(docs)
