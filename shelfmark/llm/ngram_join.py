"""N-gram Jaccard join by partition and enumeration of set signatures.

Sets of word shingles are grouped in bands of size, so that similar sets are in
the same band or in neighbouring ones. Two such sets differ in at most ``k``
elements, a bound that follows from the band. The hash domain is cut into
``k + 1 + spare`` parts: similar sets then agree in at least ``1 + spare`` whole
parts, and the sum of a part's elements is its signature. A part that is empty
says nothing and gets no signature; a set with at most ``spare`` empty parts
still shares a filled one with every similar set. The few sets with more empty
parts only miss each other, and are also joined among themselves by the
elements of their prefix. So no similar pair is without a shared signature.

Sharers of a signature are not paired with each other: each is compared with
the smallest of them, in full, on the sets themselves. Where the sharers of a
signature are not all connected after that, they are compared with each other
in blocks of bounded size, one task for two blocks, which hands back a forest
of links and no pairs. So no link between different sets is lost.

Edge cases. NULL and empty texts have the empty set and are linked with nothing;
copies are one set; rows that repeat in full get the same answer; a document
without id is a node like any other, and a component of such rows alone has a
NULL id. An empty table gives an empty result. Extra columns are ignored by
``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import sharing, tokens
from shelfmark.llm.common import fresh, small, stored
from shelfmark.llm.graph import components

# Sets and elements of a block of a family, and elements compared at once within it.
_BLOCK_SETS, _BLOCK_ELEMENTS, _COLUMNS = 400, 400_000, 4_096


@dataclass(frozen=True)
class Similarity:
    """Jaccard similarity of at least ``percent`` on shingles of ``words`` words."""

    words: int = 5
    percent: int = 80


@lru_cache(maxsize=256)
def _tops(percent: int, largest: int) -> np.ndarray:
    """Largest size of each band, beyond ``largest``; band 0 has the empty set."""
    tops = [0]
    while len(tops) < 3 or tops[-2] < largest:
        tops.append((tops[-1] + 1) * 100 // percent)
    return np.array(tops)


@lru_cache(maxsize=256)
def _cuts(percent: int, band: int, reach: int) -> tuple[int, int, np.ndarray]:
    """(parts, spare, inner borders of the parts) for sets of ``band - 1`` and ``band``.

    Similar sets a and b differ in at most (a + b) * (1 - s) / (1 + s) elements.
    """
    tops = _tops(percent, reach)
    k = int(tops[band - 1] + tops[band]) * (100 - percent) // (100 + percent)
    spare = 1 + k // 40
    parts = k + 1 + spare
    return parts, spare, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def signatures(found: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Signatures of one sorted set."""
    n, percent = len(found), similarity.percent
    reach = 1 << n.bit_length()
    own = int(np.searchsorted(_tops(percent, reach), n))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens.mix(found))])
    out = []
    for band in (own, own + 1):
        parts, spare, cuts = _cuts(percent, band, reach)
        ends = np.concatenate([[0], np.searchsorted(found, cuts), [n]])
        at = np.flatnonzero(ends[1:] > ends[:-1])
        value = sums[ends[at + 1]] - sums[ends[at]]
        out.append(tokens.mix(value + tokens.mix((at + (band << 32)).astype(np.uint64))))
        if parts - len(at) > spare:
            prefix = n - (n * percent + 99) // 100 + 1
            out.append(tokens.mix(found[:prefix] ^ np.uint64(0xA5A5A5A5 + band)))
    return np.concatenate(out)


def sketch(found: np.ndarray) -> np.ndarray:
    """Check bytes of a sorted set: of each of about as many parts of the domain as it has elements.

    Sets that differ in d elements have at most d different check bytes, so too
    many rule a pair out for certain. Neighbouring parts add up, which makes
    sketches of different lengths comparable.
    """
    bits = max((len(found) - 1).bit_length() - 1, 3)
    part = (found >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(part, weights=(tokens.mix(found) & np.uint64(255)), minlength=1 << bits).astype(np.int64).astype(np.uint8)


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    return sketches.reshape(len(sketches), width, -1).sum(2, dtype=np.uint8)


def _most_different(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in which similar sets of these sizes differ; below zero if no such sets are similar."""
    sized = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return np.where(sized, (na + nb) * (100 - percent) // (100 + percent), -1)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that their sizes and sketches allow to be similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            na, nb = (batch.column(i).to_numpy() for i in (3, 4))
            for most, x, y in zip(_most_different(na, nb, percent), batch.column(5), batch.column(6), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                width = min(len(x), len(y))
                keep.append(int((_folded(x[None], width) != _folded(y[None], width)).sum()) <= most)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(3)], names=["a", "b", "times"])

    both = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "times", "na", "nb", "sa", "sb").mapInArrow(work, "a long, b long, times long")


def _blocks(members: DataFrame, weight: str) -> DataFrame:
    """Members with ``block``: families in parts of bounded size, every two parts of a family together."""
    parts = members.groupBy("family").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / _BLOCK_SETS), F.ceil(F.sum(weight) / _BLOCK_ELEMENTS)).alias("parts"))
    return (
        members.join(parts, "family")
        .withColumn("_own", F.pmod(F.xxhash64("set_id"), F.col("parts")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("block", F.concat_ws("/", "family", F.least("_own", "_other"), F.greatest("_own", "_other")))
        .drop("_own", "_other", "parts")
    )


def _partners(rows: list[tuple[int, int, int, np.ndarray]], percent: int) -> np.ndarray:
    """For ``id, root, n, sketch`` rows whether another component has a set that it can be similar to."""
    roots, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    widths, wanted = np.array([len(r[3]) for r in rows]), np.zeros(len(rows), bool)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        table = np.stack([rows[i][3] for i in own])
        # Similar sets have the same width or the next one, which is folded.
        for factor in (1 << i for i in range((400 // percent).bit_length())):
            other = own if factor == 1 else np.flatnonzero(widths == width * factor)
            if not len(other):
                continue
            against = table if factor == 1 else _folded(np.stack([rows[i][3] for i in other]), width)
            for at, i in enumerate(own):
                start = at + 1 if factor == 1 else 0
                some = other[start:]
                most = np.where(roots[some] == roots[i], -1, _most_different(n[some], n[i], percent))
                near = np.flatnonzero(most >= 0)
                good = near[(against[start:][near] != table[at]).sum(1) <= most[near]]
                wanted[some[good]] = True
                wanted[i] |= len(good) > 0
    return wanted


def _with_partner(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The members ``family, set_id`` that can be similar to one of their family in another component."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(batches):
            once = list({r[1]: r for r in held}.values())
            rows = [(i, root, n, np.frombuffer(s.as_buffer(), np.uint8)) for _, i, root, n, s in once]
            wanted = np.flatnonzero(_partners(rows, percent))
            yield pa.RecordBatch.from_arrays(
                [pa.array([once[w][0] for w in wanted], pa.int64()), pa.array([once[w][1] for w in wanted], pa.int64())],
                names=["family", "set_id"])

    rows = _blocks(members, "n").join(sketches.select("set_id", "sketch"), "set_id")
    rows = rows.repartition("block").sortWithinPartitions("block").select("block", "family", "set_id", "root", "n", "sketch")
    return rows.mapInArrow(work, "family long, set_id long").distinct()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of equal first column that follow each other; the last column stays an Arrow value."""
    key, held = None, []
    for batch in batches:
        plain = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        for name, *values, last in zip(*plain, batch.column(batch.num_columns - 1), strict=True):
            if name != key and held:
                yield held
                held = []
            key = name
            held.append((*values, last))
    if held:
        yield held


def _identity(found: np.ndarray) -> int:
    """Identifier of a set: a hash of all its elements (0 for the empty set)."""
    if not len(found):
        return 0
    first, second = tokens.mix(found).sum(), tokens.mix(found ^ np.uint64(0x5BD1E995)).sum()
    return int(tokens.mix(np.array([first ^ tokens.mix(np.array([second + np.uint64(len(found))]))[0]]))[0].view(np.int64)) or 1


def _sets_of(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``doc_id, mark, n, set_id, sketch`` for every row."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("set_id", T.LongType()), T.StructField("sketch", T.BinaryType())])
    size = similarity.words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 2):
                listed = [(len(s), _identity(s), sketch(s).tobytes()) for s in tokens.shingle_sets(part.column(2), size)]
                n, ids, sketches = zip(*listed, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "mark", "n", "set_id", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(work, schema)


def _shared(docs: DataFrame, similarity: Similarity, elements: int, rows: int) -> DataFrame:
    """``sig, id, hub``: sets that share a signature, and the one each is compared with."""
    # A set has about twice its largest difference in signatures, for either band, and a few more.
    ranges = sharing.ranges_for(5 * elements * (100 - similarity.percent) // (100 + similarity.percent) + 6 * rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = sharing.Gatherer(ranges)

        def each(batch: pa.RecordBatch) -> None:
            for part in tokens.slices(batch, 0):
                for found in tokens.shingle_sets(part.column(0), similarity.words):
                    if len(found):
                        gathered.add(signatures(found, similarity), _identity(found))

        yield from gathered.run(batches, each)

    packed = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(work, sharing.PACKED)
    return sharing.sharers(packed, ranges).select("sig", "id", "hub")


def _read_sets(docs: DataFrame, ids: DataFrame, where: DataFrame, similarity: Similarity) -> DataFrame:
    """``set_id, s`` (sorted elements as bytes) of the wanted sets, each read from one row."""
    wanted = stored(
        ids.distinct().join(where, "set_id")
        .select("set_id", F.col("at.doc_id").alias("_d"), F.col("at.mark").alias("_m"))
    )
    docs, size = docs.select("doc_id", "text"), similarity.words
    on = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_m"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 1):
                sets = [s.tobytes() for s in tokens.shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["set_id", "s"])

    return docs.join(small(wanted), on).select("set_id", "text").mapInArrow(listed, "set_id long, s binary")


def _elements(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = _elements(left), _elements(right)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return (
        pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        .mapInArrow(work, "a long, b long")
    )


def _links_of_block(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components: a forest, not every pair."""
    sizes = np.array([len(s) for s in sets])
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[codes] > 1
    column = (np.cumsum(counts > 1) - 1)[codes[shared]]
    owner, order = owner[shared], np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, [start, start + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        both += part @ part.T
    similar = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    links = []
    for i, j in np.argwhere(np.triu(similar & (roots[:, None] != roots[None, :]), 1)):
        x, y = top(int(roots[i])), top(int(roots[j]))
        if x != y:
            parent[x] = y
            links.append((int(ids[i]), int(ids[j])))
    return links


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the sets of each family (``family, set_id, root, n``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            once = {i: (r, _elements(s)) for i, r, s in rows}
            roots, found = np.array([r for r, _ in once.values()]), []
            if len(set(roots.tolist())) > 1:
                found = _links_of_block(np.array(list(once)), roots, [s for _, s in once.values()], percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    rows = _blocks(members, "n").join(sets, "set_id").repartition("block").sortWithinPartitions("block")
    return rows.select("block", "set_id", "root", "s").mapInArrow(work, "a long, b long")


def set_components(docs: DataFrame, similarity: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, mark, n, set_id`` per row; ``set_id, root`` of the sets with a link)."""
    percent = similarity.percent
    rows = stored(_sets_of(docs, similarity))
    total, elements = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = stored(_shared(docs, similarity, elements, total))
    # One row of each set, to read its text from.
    where = stored(
        rows.filter("n > 0").groupBy("set_id").agg(
            F.min("n").alias("n"), F.min(F.struct("doc_id", "mark")).alias("at")))
    n = where.select("set_id", "n")
    pairs = shared.filter("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(
        F.count(F.lit(1)).alias("times"))
    # Sketches of the sets that share a signature. Copies of a set have the same one, whichever row it is read from.
    first = where.select("set_id", F.col("at.doc_id").alias("_d"), F.col("at.mark").alias("_m"))
    sharing_ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    sketches = rows.join(first.join(sharing_ids, "set_id"), "set_id").filter(
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")))
    sketches = sketches.select("set_id", "n", "sketch")
    pairs = stored(_likely(pairs, sketches, percent).distinct())

    # First each set with the one it shares most signatures with; then the pairs that this leaves apart.
    # The empty table is a range: a Python list would start a second set of Python workers on every executor.
    links = docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    found = links.toDF("set_id", "root")
    best = pairs.groupBy("a").agg(F.max(F.struct("times", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    for some in (best, pairs.select("a", "b").join(best, ["a", "b"], "left_anti")):
        some = some.join(found.toDF("a", "ra"), "a", "left").join(found.toDF("b", "rb"), "b", "left")
        some = stored(some.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
        ids = some.select(F.col("a").alias("set_id")).union(some.select("b"))
        links = stored(links.union(_compared(some, _read_sets(docs, ids, where, similarity), percent)).distinct())
        found = stored(components(links).toDF("set_id", "root"))

    # Signatures whose sharers are in several components may hide links between these. Their sharers
    # are compared in blocks: families by smallest sharer, in blocks of bounded size, each with each.
    placed = stored(
        shared.select("sig", F.col("id").alias("set_id")).distinct().join(found, "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id")).join(n, "set_id"))
    split = placed.groupBy("sig").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.min("set_id").alias("family")
    ).filter("x <> y").select("sig", "family")
    members = placed.join(split, "sig").select("family", "set_id", "root", "n").distinct()
    members = stored(members.join(stored(_with_partner(members, sketches, percent)), ["family", "set_id"], "left_semi"))
    if members.isEmpty():
        return rows, found
    sets = _read_sets(docs, members.select("set_id"), where, similarity)
    more = stored(_block_links(members, sets, percent))
    if more.isEmpty():
        return rows, found
    return rows, stored(components(links.union(more)).toDF("set_id", "root"))


def classes(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """One row per document: ``doc_id, mark, n, component_id`` and ``keeper``.

    ``component_id`` is the smallest ``doc_id`` reachable by links, ``keeper``
    the first row (by ``doc_id, mark``) of the component.
    """
    rows, found = set_components(docs, similarity)
    rows = rows.join(found, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rows = stored(rows)
    firsts = rows.filter("n > 0").groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "mark")).alias("keeper"))
    alone = F.col("n") == 0
    out = rows.filter("n > 0").join(firsts, "root").select("doc_id", "mark", "n", "component_id", "keeper")
    return out.union(rows.filter(alone).select(
        "doc_id", "mark", "n", F.col("doc_id").alias("component_id"), F.struct("doc_id", "mark").alias("keeper")))


def report(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return classes(docs, similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """One document of each component: the first by ``doc_id``. Columns are unchanged.

    Documents without words stay. Of rows that repeat in full one stays.
    """
    found = stored(classes(docs, similarity))
    d, m = fresh(docs, "_d"), fresh(docs, "_m")
    key = [F.col("doc_id").alias(d), F.col("mark").alias(m)]
    gone = stored(found.filter(~F.struct("doc_id", "mark").eqNullSafe(F.col("keeper"))).select(*key).distinct())
    on = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(m))
    kept = docs.join(small(gone), on, "left_anti")
    again = stored(found.filter("n > 0").groupBy("doc_id", "mark").count().filter("count > 1").select(*key))
    if again.isEmpty():
        return kept
    twice = kept.join(small(again), on, "left_semi")
    once = twice.withColumn(m, F.xxhash64("text")).dropDuplicates(["doc_id", m]).drop(m)
    return kept.join(small(again), on, "left_anti").union(once)
