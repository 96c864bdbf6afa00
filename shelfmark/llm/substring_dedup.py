"""Substring dedup: passages that repeat across documents, by compact windows.

The tokens of a text are its word shingles. Under a hash function, the shingles
of a text form a Cartesian tree (the smallest on top, the rest to its left and
right likewise): a node's subtree is a compact window, all of whose
subsequences that contain the node share it as min-hash. Only windows of
``least`` shingles and more matter; their nodes are the minima of the text's
stretches of that length, so the tree is never built in full.

Windows with a shingle of their own cannot have a partner and go first. The
rest are joined with each other within a text: where windows of two hash
functions overlap by ``least`` shingles, all passages in the overlap that hold
both nodes share two min-hashes, which become the overlap's signature. Sharers
of a signature are compared with the smallest of them, on the shingles
themselves: a passage is verified if it is ``least`` shingles long on both
sides and their Jaccard similarity is ``percent`` or more. Where this leaves
sharers without a partner, they are compared with all sharers of that signature,
in blocks of bounded size, for the stretches that are not covered yet.

The same words in the same order are one text, whatever the number of rows.

Edge cases. NULL and empty texts, and texts of fewer words than a passage, have
no passage. Rows that repeat and copies of one text are passages as a whole.
Passages that repeat only inside one text are not reported; one that another
text has as well is reported at every place. Rows without id
are represented by NULL. An empty table gives an empty result. Extra columns are ignored by
``passages`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import sharing, tokens
from shelfmark.llm.common import cut_words, fresh, small, stored

# Texts and shingles of a block, shingles of a task's blocks, and cells of a comparison at once.
_BLOCK, _BLOCK_SHINGLES, _TASK_SHINGLES, _CELLS = 400, 250_000, 100_000, 2_000_000
# Rows of a few numbers that go to Python at once.
_NARROW_ROWS = 10_000
# Hash functions. A place packs a node and how far its window goes to both sides.
_FUNCTIONS = 4


@dataclass(frozen=True)
class Passage:
    """Passages of at least ``words`` words whose shingles of ``size`` words agree by ``percent``."""

    words: int = 50
    size: int = 5
    percent: int = 80

    @property
    def least(self) -> int:
        return self.words - self.size + 1

    @property
    def reach(self) -> int:
        return min(2 * self.least, 255)


def _sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:len(values) - step], values[step:])
        done += step
    return values


def windows(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, left ends, right ends) of the compact windows of at least ``least`` tokens.

    A node of such a window is the minimum of some stretch of ``least`` tokens,
    and the nearest smaller tokens on both sides are such nodes as well.
    """
    n = len(hashes)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    # A token is a node if the minima of all stretches it is in reach up to it.
    lowest = _sliding(np.minimum, hashes, least)
    around = np.concatenate([np.zeros(least - 1, np.uint64), lowest, np.zeros(least - 1, np.uint64)])
    nodes = np.flatnonzero(_sliding(np.maximum, around, least) == hashes)
    # The nearest smaller one on each side (equal ones count on the left), over those that are passed already.
    values = hashes[nodes]
    before, after = np.arange(len(nodes)) - 1, np.arange(len(nodes)) + 1
    late = np.flatnonzero(before >= 0)
    while len(late):
        late = late[values[before[late]] > values[late]]
        before[late] = before[before[late]]
        late = late[before[late] >= 0]
    late = np.flatnonzero(after < len(nodes))
    while len(late):
        late = late[values[after[late]] >= values[late]]
        after[late] = after[after[late]]
        late = late[after[late] < len(nodes)]
    ends = np.concatenate([nodes, [n, -1]])
    left, right = ends[before] + 1, ends[after] - 1
    wide = right - left + 1 >= least
    return nodes[wide], left[wide], right[wide]


def _sequences(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text (hashes of its words, hashes of its shingles in order)."""
    words, offsets = tokens.word_hashes(texts)
    runs = tokens.shingle_hashes(words, size)
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        yield words[start:end], runs[start:max(end - size + 1, start)]


def _identity(words: np.ndarray) -> int:
    """Identifier of a word sequence (0 without words)."""
    if not len(words):
        return 0
    at = np.arange(1, len(words) + 1, dtype=np.uint64)
    first = tokens.mix(words + at * np.uint64(0x9E3779B97F4A7C15)).sum()
    second = tokens.mix((words ^ np.uint64(0x5BD1E995)) * (at | np.uint64(1 << 32) | np.uint64(1))).sum()
    return int(tokens.mix(np.array([first ^ tokens.mix(np.array([second]))[0]]))[0].view(np.int64)) or 1


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, n, text_id``: word count and identifier of every row's word sequence."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("mark", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("text_id", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 2):
                words, offsets = tokens.word_hashes(part.column(2))
                ids = [_identity(words[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(offsets)), pa.array(ids, pa.int64())],
                    names=["doc_id", "mark", "n", "text_id"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(work, schema)


def _node(place: str | Column) -> Column:
    return F.shiftright(place, 16)


def _low(place: str | Column) -> Column:
    return F.shiftright(place, 16) - F.shiftright(place, 8).bitwiseAND(255)


def _high(place: str | Column) -> Column:
    return F.shiftright(place, 16) + F.col(place).bitwiseAND(255)


def _packed(node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (node << 16) | ((node - low) << 8) | (high - node)


def _repeated_windows(docs: DataFrame, passage: Passage, words: int) -> DataFrame:
    """``sig, id, place`` of compact windows that several texts have.

    All texts are taken under each hash function, which is told by the
    signature's last bits.
    """
    least, reach = passage.least, passage.reach
    # A text of n shingles has about 2 n / least windows under one function.
    ranges = sharing.ranges_for(_FUNCTIONS * 2 * words // least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = sharing.Gatherer(ranges)

        def each(batch: pa.RecordBatch) -> None:
            for part in tokens.slices(batch, 0):
                texts = [(_identity(w), r) for w, r in _sequences(part.column(0), passage.size) if len(r) >= least]
                if not texts:
                    continue
                # All texts in a row, with a smallest value between them that no window reaches over.
                sizes = np.array([len(r) + 1 for _, r in texts])
                starts = np.cumsum(sizes) - sizes
                flat, owners = np.zeros(sizes.sum(), np.uint64), np.array([i for i, _ in texts], np.int64)
                inside = np.ones(len(flat), bool)
                inside[starts + sizes - 1] = False
                flat[inside] = np.concatenate([r for _, r in texts])
                for f in range(_FUNCTIONS):
                    values = np.where(inside, tokens.mix(flat ^ np.uint64(0x632BE59BD9B4E019 * (f + 1) % (1 << 64))) | np.uint64(1), 0)
                    node, low, high = windows(values, least)
                    node, low, high = node[inside[node]], low[inside[node]], high[inside[node]]
                    text = np.searchsorted(starts, node, side="right") - 1
                    # Minima lie near zero: mixed, they spread over all ranges.
                    sig = (tokens.mix(values[node]) & ~np.uint64(_FUNCTIONS - 1)) | np.uint64(f)
                    node, low, high = node - starts[text], low - starts[text], high - starts[text]
                    place = _packed(node, np.maximum(low, node - reach), np.minimum(high, node + reach))
                    gathered.add(sig, owners[text], place)

        yield from gathered.run(batches, each)

    packed = docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(work, sharing.PACKED)
    return sharing.sharers(packed, ranges).select("sig", "id", "place")


def _shared_overlaps(repeated: DataFrame, least: int) -> DataFrame:
    """``sig, id, place, hub, at, till``: overlaps of two windows of different functions that several texts have."""
    # A window meets some four others.
    ranges = sharing.ranges_for(4 * repeated.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = sharing.Gatherer(ranges), []

        def close(ids: np.ndarray, sig: np.ndarray, place: np.ndarray) -> None:
            """Windows of whole texts, one text after the other."""
            node = place >> 16
            low, high = node - ((place >> 8) & 255), node + (place & 255)
            near = np.arange(len(sig))
            for step in range(1, len(sig)):
                # The window and the one ``step`` places further on; far enough, none can share a passage.
                near = near[:np.searchsorted(near, len(sig) - step)]
                near = near[(ids[near + step] == ids[near]) & (node[near + step] - node[near] < least)]
                if not len(near):
                    break
                x, y = near, near + step
                from_, to = np.maximum(low[x], low[y]), np.minimum(high[x], high[y])
                good = (to - from_ + 1 >= least) & (from_ <= node[x]) & (node[y] <= to)
                good &= (sig[x] ^ sig[y]) & (_FUNCTIONS - 1) != 0
                x, from_, to = x[good], from_[good], to[good]
                one, two = sig[x].view(np.uint64), sig[x + step].view(np.uint64)
                both = tokens.mix(tokens.mix(np.minimum(one, two)) + np.maximum(one, two))
                gathered.add(both, ids[x], _packed(node[x], from_, to))

        def each(batch: pa.RecordBatch) -> None:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            if not len(rows[0]):
                return
            # The last text of a batch may go on in the next one.
            cut = int(np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))[-1])
            if held and (cut or held[-1][0][-1] != rows[0][0]):
                held.append([r[:cut] for r in rows])
                flush()
                rows = [r[cut:] for r in rows]
            elif cut:
                close(*(r[:cut] for r in rows))
                rows = [r[cut:] for r in rows]
            held.append(rows)

        def flush() -> None:
            if held:
                close(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held.clear()

        yield from gathered.run(batches, each, flush)

    own = repeated.select("id", "sig", "place").distinct()
    packed = own.repartition("id").sortWithinPartitions("id", "place", "sig").mapInArrow(work, sharing.PACKED)
    return sharing.sharers(packed, ranges)


def _longest(match: np.ndarray, percent: int) -> tuple[int, int, int]:
    """Longest stretch of which ``percent`` are matched: ``start, end``, matched at both ends, and its length before it is narrowed to that."""
    total = np.zeros(len(match) + 1, np.int64)
    np.cumsum(match * 100 - percent, out=total[1:])
    least = np.minimum.accumulate(total)
    # A stretch that ends at a new minimum is empty; of sparse matches nearly all places are.
    ends = np.flatnonzero(total[1:] >= least[:-1]) + 1
    if not len(ends):
        return 0, 0, 0
    length = ends - np.searchsorted(-least, -total[ends], side="left")
    best = int(length.argmax())
    end, wide = int(ends[best]), int(length[best])
    hits = match[end - wide:end]
    return end - wide + int(hits.argmax()), end - int(hits[::-1].argmax()), wide


def _apart(match: np.ndarray, percent: int, shortest: int) -> list[tuple[int, int]]:
    """Parts that no stretch of which ``percent`` are matched reaches out of, but those below ``shortest``."""
    return _held_by(match * 100 - percent, shortest)


def _held_by(weights: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Parts that no stretch of weight 0 and more reaches out of, but those below ``shortest``."""
    total = np.zeros(len(weights) + 1, np.int64)
    np.cumsum(weights, out=total[1:])
    inside = np.zeros(len(weights) + 2, np.int8)
    inside[1:-1] = np.maximum.accumulate(total[:0:-1])[::-1] >= np.minimum.accumulate(total[:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= shortest]


def _dense(x: np.ndarray, match: np.ndarray, passage: Passage) -> np.ndarray:
    """Places of x in stretches that may have the share of a passage's denser side.

    Sides of which u and v are matched have at most the Jaccard similarity 1 / (1 / u + 1 / v - 1), so that
    one of the two has 2 s / (1 + s) at least to reach s. Of shingles that x repeats only the
    matched ones are counted, as they are one in the sets.
    """
    s, single = passage.percent, np.bincount(x)[x] == 1
    weights = np.where(match, 100 - s, np.where(single, -2 * s, 0))
    return _marked(_held_by(weights, passage.least), len(x))


def _marked(parts: list[tuple[int, int]], n: int) -> np.ndarray:
    """Whether each of ``n`` places is in one of the parts."""
    mask = np.zeros(n, bool)
    for a, b in parts:
        mask[a:b] = True
    return mask


def _around(match: np.ndarray, percent: int) -> tuple[int, int]:
    """The part of ``match`` from which no stretch of which ``percent`` are matched reaches out."""
    hits = np.flatnonzero(match)
    if not len(hits):
        return 0, 0
    over = len(hits) * (100 - percent) // percent + 1
    return max(int(hits[0]) - over, 0), min(int(hits[-1]) + 1 + over, len(match))


def _has(x: np.ndarray, kinds: int) -> np.ndarray:
    """For each of the numbers below ``kinds``, whether x has it."""
    has = np.zeros(kinds, bool)
    has[x] = True
    return has


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    kinds = int(max(x.max(), y.max())) + 1
    one, two = _has(x, kinds), _has(y, kinds)
    return 100 * np.count_nonzero(one & two) >= percent * np.count_nonzero(one | two)


def _fitted(x: np.ndarray, y: np.ndarray, a: int, b: int, share: int, passage: Passage) -> tuple[int, int, int, int] | None:
    """The stretch ``a..b`` of x and the one of y that matches it, each narrowed to what the other has."""
    kinds = int(max(x.max(), y.max())) + 1
    while b - a >= passage.least:
        match = _has(x[a:b], kinds)[y]
        if 100 * np.count_nonzero(match) < share * passage.least:
            return None
        from_, to = _around(match, share)
        c, d, _ = _longest(match[from_:to], share)
        c, d = from_ + c, from_ + d
        if d - c < passage.least:
            return None
        if _similar(x[a:b], y[c:d], passage.percent):
            return a, b, c, d
        low, high, _ = _longest(_has(y[c:d], kinds)[x[a:b]], share)
        if high - low == b - a:
            return None
        a, b = a + low, a + high
    return None


def _between(taken: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """What the stretches leave of ``0..n``."""
    gaps, low = [], 0
    for a, b in sorted(taken):
        gaps.append((low, a))
        low = max(low, b)
    return [*gaps, (low, n)]


def _search(x: np.ndarray, y: np.ndarray, taken: list[tuple[int, int]], passage: Passage,
            open_: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Verified passages of what ``taken`` leaves of x and of y, numbered shingles: ``start, end`` in both.

    With ``open_``, which tells it for each place of x, only stretches with open places are looked at.

    A Jaccard similarity of s needs a matched share of s on both sides. The
    longest stretch of that share is tried first, then what is left and right
    of it; where one is not similar as a whole, all that is not found yet is
    searched again for stretches of a higher share, up to unbroken runs.
    """
    least, found = passage.least, []
    if min(len(x), len(y)) < least:
        return found
    match = _has(y, int(max(x.max(), y.max())) + 1)[x]
    before = np.concatenate([[0], np.cumsum(match if open_ is None else match & open_)])
    for share in (*range(passage.percent, 100, 5), 100):
        failed, queue = False, []

        def best(low: int, high: int) -> list[tuple[int, int, int, int, int]]:
            """Length of the longest stretch of a part, its start and end, and the part."""
            if high - low < least or before[low] == before[high]:
                return []
            a, b, wide = _longest(match[low:high], share)
            return [(wide, low + a, low + b, low, high)]

        for low, high in _between([*taken, *(f[:2] for f in found)], len(x)):
            if 100 * np.count_nonzero(match[low:high]) >= share * least and before[low] < before[high]:
                queue.append([b for p, q in _apart(match[low:high], share, least) for b in best(low + p, low + q)])
        while queue:
            some = queue.pop()
            # The longest of all goes first; where it is too short, so are the others.
            at = max(range(len(some)), key=lambda i: some[i][0], default=None)
            if at is None or some[at][2] - some[at][1] < least:
                continue
            _, a, b, low, high = some[at]
            fit = _fitted(x, y, a, b, share, passage)
            if fit:
                found.append(fit)
                a, b = fit[:2]
            else:
                failed = True
            queue += [some[:at] + best(low, a), best(b, high) + some[at + 1:]]
        if not failed:
            break
    return found


def passages_of(x: np.ndarray, y: np.ndarray, passage: Passage) -> list[tuple[int, int, int, int]]:
    """Verified passages of two shingle sequences, ``start, end`` in both: all places of either that the other has."""
    codes, more = np.unique(np.concatenate([x, y]), return_inverse=True)[1], passage.size - 1
    x, y = codes[:len(x)], codes[len(x):]
    if min(len(x), len(y)) < passage.least:
        return []
    kinds = int(codes.max()) + 1
    ours, theirs = _has(y, kinds)[x], _has(x, kinds)[y]
    if not _dense(x, ours, passage).any() and not _dense(y, theirs, passage).any():
        return []
    found = _search(x, y, [], passage)
    taken = [(max(c - more, 0), min(d + more, len(y))) for _, _, c, d in found]
    return found + [(a, b, c, d) for c, d, a, b in _search(y, x, taken, passage)] if found else found


def _again(y: np.ndarray, places: set[tuple[int, int]], passage: Passage) -> list[tuple[int, int, int, int]]:
    """Places of y that an earlier one represents: ``start, end`` of both."""
    if len(places) < 2:
        return []
    codes = np.unique(y, return_inverse=True)[1]
    owner, firsts, out = np.full(len(y), -1), [], []
    for c, d in sorted(places):
        own = owner[codes[c:d]]
        if (own >= 0).any():
            p, q = firsts[int(np.bincount(own[own >= 0]).argmax())]
            if q + passage.size - 1 <= c and _similar(codes[c:d], codes[p:q], passage.percent):
                out.append((c, d, p, q))
                continue
        new = codes[c:d][own < 0]
        owner[new] = len(firsts)
        firsts.append((c, d))
    return out


def _pair(i: int, hub: int, x: np.ndarray, y: np.ndarray, a: int, c: int, passage: Passage) -> list[tuple[int, ...]]:
    """Rows of _FOUND for the stretches x (from ``a``) and y (from ``c``) of two texts.

    Where the hub has a passage several times, its later places are represented
    by its first: every passage points to a smaller text or an earlier place, so
    one of them always stays.
    """
    found = passages_of(x, y, passage)
    again = _again(y, {f[2:] for f in found}, passage)
    return [(i, hub, s + a, e + a, p + c, q + c) for s, e, p, q in found] + [
        (hub, hub, s + c, e + c, p + c, q + c) for s, e, p, q in again]


def _read_shingles(docs: DataFrame, ids: DataFrame, where: DataFrame, size: int) -> DataFrame:
    """``text_id, s``: shingle hashes in order, as bytes, of the wanted texts."""
    wanted = stored(ids.distinct().join(where, "text_id").select(
        "text_id", F.col("at.doc_id").alias("_d"), F.col("at.mark").alias("_m")))
    docs = docs.select("doc_id", "text")
    on = docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_m"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 1):
                runs = [r.tobytes() for _, r in _sequences(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, pa.binary())], names=["text_id", "s"])

    return docs.join(small(wanted), on).select("text_id", "text").mapInArrow(listed, "text_id long, s binary")


def _part(s: str, low: Column, high: Column) -> Column:
    """Bytes of the shingles from ``low`` to ``high``, both included."""
    return F.substring(s, (low * 8 + 1).cast("int"), ((high - low + 1) * 8).cast("int"))


_FOUND = "id long, hub long, start long, end long, hub_start long, hub_end long"
_FOUND_OR_LEFT = f"{_FOUND}, family long"


def _found(rows: list[tuple[int | None, ...]], schema: str = _FOUND) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _verified(pairs: DataFrame, shingles: DataFrame, passage: Passage) -> DataFrame:
    """Passages of pairs ``id, hub`` of texts, looked for where their sharers lie (``a..b`` and ``c..d``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, hub, a, c, x, y in zip(*batch.columns, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                rows += _pair(i.as_py(), hub.as_py(), x, y, a.as_py(), c.as_py(), passage)
            yield _found(rows)

    left = pairs.join(shingles.toDF("id", "s"), "id").select(
        "id", "hub", "a", "c", "d", _part("s", F.col("a"), F.col("b")).alias("x"))
    return left.join(shingles.toDF("hub", "s"), "hub").select(
        "id", "hub", "a", "c", "x", _part("s", F.col("c"), F.col("d")).alias("y")).mapInArrow(work, _FOUND)


def _best_stretches(places: np.ndarray, others: np.ndarray, wanted: np.ndarray, n: int, passage: Passage) -> np.ndarray:
    """For each wanted text the best stretch of least length and more of ``n`` places; below 0, none has enough matches.

    ``places`` are matched by the texts ``others``. A bounded number of texts is worked on at once.
    """
    column, best, step = np.full(max(others.max(initial=0), wanted.max(initial=0)) + 1, -1), [], max(1, _CELLS // (n + 1))
    for low in range(0, len(wanted), step):
        part = wanted[low:low + step]
        column[:] = -1
        column[part] = np.arange(len(part))
        of = column[others]
        total = np.zeros((len(part), n + 1), np.int32)
        total[of[of >= 0], places[of >= 0] + 1] = 100
        total[:, 1:] -= passage.percent
        np.cumsum(total, axis=1, out=total)
        best.append((total[:, passage.least:] - np.minimum.accumulate(total[:, :-passage.least], axis=1)).max(1))
    return np.concatenate(best) if best else np.zeros(0, np.int32)


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap as one, ends not included."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _compared(held: list[tuple[int, int, np.ndarray]], passage: Passage, wanted: dict[int, list[tuple[int, int]]] | None = None,
              left: dict[int, list[tuple[int, int]]] | None = None, still: list[tuple[int, ...]] | None = None) -> list[tuple[int, ...]]:
    """Passages among ``id, low, shingles``: enough to cover what the wanted stretches share with other texts.

    ``wanted`` has stretches by id (places of the text, ends not included); all
    of every text if not given. Only texts that match enough of a stretch are
    compared, the best first, around the places that are open yet; what a passage
    covers, in either text, is no longer looked for, and one that covers nothing new is
    left out. With ``left``, the open pieces of the stretches, wanted texts
    are compared with the others only. ``still`` gets ``id, start, end, low, high``
    of the pieces that stay open and of the stretches they are in.
    """
    held = sorted(held, key=lambda h: h[0])
    sizes, least = np.array([len(h[2]) for h in held]), passage.least
    begin = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(held)), sizes)
    order = np.lexsort((owner, codes))
    new = np.concatenate([[True], (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
    listed, by = owner[order][new], codes[order][new]
    starts = np.searchsorted(by, np.arange(codes.max(initial=-1) + 2))
    number = np.zeros(codes.max(initial=-1) + 1, np.int64)
    able = np.array([left is None or h[0] not in left for h in held], bool)
    stretches: list[list[tuple[int, int]]] = []
    opened = np.zeros(len(codes), bool)
    for at, (text, offset, shingles) in zip(begin, held, strict=True):
        whole = [(offset, offset + len(shingles))]
        stretches.append([(low - offset, high - offset) for low, high in _joined(whole if wanted is None else wanted.get(text, []))
                          if high - low >= least])
        for low, high in stretches[-1] if left is None else [(a - offset, b - offset) for a, b in left.get(text, [])]:
            opened[at + low:at + high] = True
    covered = np.zeros(len(codes), bool)
    rows: set[tuple[int, ...]] = set()

    def cover(j: int, i: int, focus: bool = True) -> bool:
        """Take the passages of two texts if some cover open places of the first, with ``focus`` where enough of these are matched."""
        ours, theirs = (slice(begin[k], begin[k] + sizes[k]) for k in (j, i))
        both = np.concatenate([codes[ours], codes[theirs]])
        # Numbers below the number of shingles of the pair, equal ones alike.
        number[both] = np.arange(len(both))
        both, useful = number[both], []
        x, y = both[:sizes[j]], both[sizes[j]:]
        match, open_ = _has(y, len(both))[x], opened[ours]
        near = match & open_
        if focus:
            near &= _marked(_apart(near, passage.percent, least), len(x))
        around = match & _marked([(a, b) for a, b in _apart(match, passage.percent, least) if near[a:b].any()], len(x))
        back = _has(x[around], len(both))[y]
        near &= _dense(x, around, passage) | _has(y[back & _dense(y, back, passage)], len(both))[x]
        found = _search(x, y, [], passage, near) if near.any() else []
        if not any(open_[a:b].any() for a, b, _, _ in found):
            return False
        # A pair that gives something is looked at as a whole, for what is new in either text.
        for a, b, c, d in passages_of(x, y, passage) + found:
            open_[a:b] = False
            if not (covered[ours][a:b].all() and covered[theirs][c:d].all()):
                covered[ours][a:b] = covered[theirs][c:d] = True
                useful.append((a, b, c, d))
        (ours_id, p, _), (theirs_id, q, _) = held[j], held[i]
        if i < j:
            rows.update((ours_id, theirs_id, a + p, b + p, c + q, d + q) for a, b, c, d in useful)
            again, hub, at = _again(y, {f[2:] for f in useful}, passage), theirs_id, q
        else:
            rows.update((theirs_id, ours_id, c + q, d + q, a + p, b + p) for a, b, c, d in useful)
            again, hub, at = _again(x, {f[:2] for f in useful}, passage), ours_id, p
        rows.update((hub, hub, s + at, e + at, c + at, d + at) for s, e, c, d in again)
        return True

    for j, within in enumerate(stretches):
        for low, high in within:
            n = high - low
            ours = slice(begin[j] + low, begin[j] + high)
            own = codes[ours]
            first, count = starts[own], np.where(opened[ours], starts[own + 1] - starts[own], 0)
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            places, others = np.repeat(np.arange(n), count), listed[at]
            good = (others != j) & able[others]
            places, others = places[good], others[good]
            matched = np.bincount(others, minlength=len(held))
            live = np.flatnonzero(100 * matched >= passage.percent * least)
            good = 100 * matched[others] >= passage.percent * least
            places, others = places[good], others[good]
            best = _best_stretches(places, others, live, n, passage)
            # Scores only fall as places are covered: one that is up to date and the highest is the best.
            queue = [(-int(score), 0, int(i)) for score, i in zip(best, live, strict=True) if score >= 0]
            if not queue:
                continue
            heapq.heapify(queue)
            places = places[np.argsort(others, kind="stable")]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(others, minlength=len(held)))])
            covers = 0
            while queue:
                _, seen, i = heapq.heappop(queue)
                if seen < covers:
                    mine = places[cuts[i]:cuts[i + 1]]
                    mine = mine[opened[ours][mine]]
                    if 100 * len(mine) >= passage.percent * least:
                        total = np.zeros(n + 1, np.int64)
                        total[mine + 1] = 100
                        total[1:] -= passage.percent
                        np.cumsum(total, out=total)
                        score = int((total[least:] - np.minimum.accumulate(total[:-least])).max())
                        if score >= 0:
                            heapq.heappush(queue, (-score, covers, i))
                    continue
                covers += cover(j, i)
            # Small pieces that are left: with what is covered around them they may lie in a passage of another text.
            share = passage.percent
            for i in live if left is None and opened[ours].any() else ():
                match = np.zeros(n, bool)
                match[places[cuts[i]:cuts[i + 1]]] = True
                near = match & opened[ours]
                if near.any() and any(near[a:b].any() for a, b in _held_by(np.where(match, 100 - share, -2 * share), least)):
                    cover(j, i, False)
    if still is not None:
        for (text, offset, _), at, within in zip(held, begin, stretches, strict=True):
            for low, high in within:
                here = opened[at + low:at + high] & ~covered[at + low:at + high]
                if 100 * np.count_nonzero(here) >= passage.percent * least:
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8))).tolist()
                    still += [(text, a + low + offset, b + low + offset, low + offset, high + offset)
                              for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return sorted(rows)


def _with_partners(members: DataFrame, passage: Passage) -> DataFrame:
    """``family, id, low, high, open, x``: what of the members other texts of the family may have.

    A passage lies where enough shingles occur in another text of the family. That is counted for
    each family as a whole, in proportion to its shingles: a family that has no more in common than
    a line, however large, is not compared pair by pair.
    """
    least, percent = passage.least, passage.percent
    shingled = members.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0] // 8
    if not shingled:
        return members.select("family", "id", "low", "high", "open", "x")
    ranges = sharing.ranges_for(shingled)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = sharing.Gatherer(ranges)

        def each(batch: pa.RecordBatch) -> None:
            for member, family, x in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                gathered.add(tokens.mix(x ^ tokens.mix(np.array([family]).view(np.uint64))), member, np.arange(len(x)))

        yield from gathered.run(batches, each)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for family, i, low, from_, to, x, shared in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                match = np.zeros(len(x) // 8, bool)
                match[shared] = True
                apart = _apart(match, percent, least)
                if not apart:
                    continue
                start, end = apart[0][0], apart[-1][1]
                open_ = []
                for p, q in sorted(zip(from_, to, strict=True)):
                    # A stretch of the text, ends not included, within what is kept of it.
                    p, q = max(p - low, start), min(q + 1 - low, end)
                    if q - p >= least and _apart(match[p:q], percent, least):
                        open_.append({"low": p + low, "high": q - 1 + low})
                rows.append((family, i, start + low, end - 1 + low, open_, x[8 * start:8 * end]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["family", "id", "low", "high", "open", "x"])

    named = members.withColumn("member", F.xxhash64("family", "id"))
    packed = named.select("member", "family", "x").mapInArrow(listed, sharing.PACKED)
    # Numbers of rows only go to Python here; the places of a member go with its shingles.
    shared = stored(sharing.sharers(packed, ranges).groupBy(F.col("id").alias("member")).agg(F.collect_list("place").alias("shared")))
    kind = members.schema["open"].dataType.simpleString()
    return stored(named.join(shared, "member").select(
        "family", "id", "low", F.col("open.low").alias("from"), F.col("open.high").alias("to"), "x", "shared").mapInArrow(
            narrowed, f"family long, id long, low long, high long, open {kind}, x binary"))


def _verified_in_blocks(members: DataFrame, shingles: DataFrame, passage: Passage) -> DataFrame:
    """Passages of a family's uncovered texts: ``family, id, low, high, open``.

    ``open`` lists the stretches of a text that nothing covers yet, if any. A family is dealt in
    parts of at most about _BLOCK texts, which are compared within themselves first. What this leaves open
    then meets the other parts, so every uncovered text meets every text of its family, and a large
    family of like texts is not searched for the same stretches part by part. It gives
    passages enough to cover what the stretches share, not every pair.
    """
    length, mixed = F.col("high") - F.col("low"), F.xxhash64("id")
    members = members.select("family", "id", "low", "high", "open")

    def parts(long: Column) -> Column:
        return F.greatest(F.ceil(F.count(F.lit(1)) / _BLOCK), F.ceil(F.sum(long) / _BLOCK_SHINGLES))

    sizes = members.groupBy("family").agg(
        parts(length).alias("parts"), F.max(F.size("open")).alias("_open")).filter("_open > 0").drop("_open")
    dealt = members.join(sizes, "family").withColumn("part", F.pmod(mixed, F.col("parts")))
    # Read once: both rounds need the shingles.
    dealt = stored(dealt.join(shingles.withColumnRenamed("text_id", "id"), "id").select(
        "family", "id", "low", "high", "open", "parts", "part", _part("s", F.col("low"), F.col("high")).alias("x")))
    large = _with_partners(dealt.filter("parts > 1"), passage)
    sizes = stored(large.groupBy("family").agg(
        parts(length).alias("parts"), F.max(F.size("open")).alias("_open")).filter("_open > 0").drop("_open"))
    dealt = dealt.filter("parts = 1").unionByName(
        large.join(sizes, "family").withColumn("part", F.pmod(mixed, F.col("parts"))))
    nothing = F.lit(None).cast(members.schema["open"].dataType)
    first = stored(_blocks_compared(dealt.select(
        F.concat_ws("/", "family", "part").alias("block"), "family", (F.col("parts") > 1).alias("several"), "id", "low",
        F.when(F.size("open") > 0, F.col("open")).alias("open"), nothing.alias("left"), "x"), passage))
    found = first.filter("hub is not null").drop("family")
    left = first.filter("hub is null").groupBy("family", "id").agg(
        F.collect_set(F.struct(F.col("hub_start").alias("low"), (F.col("hub_end") - 1).alias("high"))).alias("open"),
        F.collect_set(F.struct(F.col("start").alias("low"), (F.col("end") - 1).alias("high"))).alias("left"))
    left = stored(left)
    if left.isEmpty():
        return found

    again = dealt.drop("open").join(left, ["family", "id"])
    rows = again.groupBy("family").agg(parts(length).alias("rows"))

    def over(count: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(name)

    asking = again.join(rows, "family").withColumn("_row", F.pmod(mixed, F.col("rows"))).select(
        "*", over("parts", "_column")).filter("_column <> part")
    asked = dealt.drop("open").join(rows, "family").withColumn("_column", F.col("part")).select("*", over("rows", "_row"))
    both = asking.unionByName(asked.withColumn("open", nothing).withColumn("left", nothing))
    second = _blocks_compared(both.select(
        F.concat_ws("/", "family", "_row", "_column").alias("block"), "family", F.lit(False).alias("several"),
        "id", "low", "open", "left", "x"), passage)
    return found.union(second.drop("family"))


def _blocks_compared(rows: DataFrame, passage: Passage) -> DataFrame:
    """Passages of blocks, ``block, family, several, id, low, open, left, x``.

    Where a family has several blocks, also a row without hub for each open piece that is left.
    """
    shingled = rows.agg(F.coalesce(F.sum(F.octet_length("x")), F.lit(0))).first()[0] // 8

    def ends(column: str, end: str) -> Column:
        return F.col(f"{column}.{end}").alias(f"{column}_{end}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, wanted, left = None, {}, {}, {}

        def close() -> pa.RecordBatch:
            still = [] if key[2] else None
            found = [(*row, None) for row in _compared(list(held.values()), passage, wanted, left or None, still)]
            return _found(found + [(i, None, a, b, low, high, key[1]) for i, a, b, low, high in still or ()], _FOUND_OR_LEFT)

        for batch in batches:
            plain = (batch.column(c).to_pylist() for c in range(9))
            for block, family, several, i, low, from_, to, a, b, x in zip(*plain, batch.column(9), strict=True):
                if key and block != key[0]:
                    yield close()
                    held, wanted, left = {}, {}, {}
                key = block, family, several
                held[i] = (i, low, np.frombuffer(x.as_buffer(), np.uint64))
                if from_ is not None:
                    wanted[i] = [(p, q + 1) for p, q in zip(from_, to, strict=True)]
                if a is not None:
                    left[i] = [(p, q + 1) for p, q in zip(a, b, strict=True)]
        if held:
            yield close()

    dealt = rows.repartition(1 + shingled // _TASK_SHINGLES, "block").sortWithinPartitions("block")
    return dealt.select(
        "block", "family", "several", "id", "low", ends("open", "low"), ends("open", "high"), ends("left", "low"), ends("left", "high"), "x"
    ).mapInArrow(work, _FOUND_OR_LEFT)


def text_passages(docs: DataFrame, passage: Passage = Passage()) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, mark, n, text_id`` per row; verified ``id, hub, start, end, hub_start, hub_end`` between texts).

    Ends are not included and count shingles; ``hub`` is the smaller text, or the
    same one where an earlier place of it represents a passage that others have.
    """
    rows = stored(_rows(docs))
    where = stored(rows.filter("n > 0").groupBy("text_id").agg(F.min(F.struct("doc_id", "mark")).alias("at")))
    words = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    repeated = stored(_repeated_windows(docs, passage, words))
    star = stored(_shared_overlaps(repeated, passage.least), _NARROW_ROWS)
    pairs = stored(star.filter("id <> hub").groupBy("id", "hub").agg(
        F.min(_low("place")).alias("a"), F.max(_high("place")).alias("b"),
        F.min(_low("at")).alias("c"), F.max(_high("till")).alias("d")))
    shingles = _read_shingles(
        docs, star.select(F.col("id").alias("text_id")).union(star.select("hub")), where, passage.size)
    found = stored(_verified(pairs, shingles, passage))

    # Sharers without any passage there may have one with another sharer.
    covered = found.select("id", "start", "end").union(found.select("hub", "hub_start", "hub_end")).distinct()
    at = _node("place")
    alone = stored(star.select("sig", "id", "place").distinct().join(
        covered.withColumnRenamed("id", "of"), (F.col("id") == F.col("of")) & (at >= F.col("start")) & (at < F.col("end")),
        "left_anti"))
    # Two sharers have been compared already.
    several = star.groupBy("sig").agg(F.countDistinct("id").alias("n"), F.min("id").alias("family")).filter("n > 2")
    open_ = alone.select("sig").distinct().join(several, "sig").select("sig", "family")
    # Sharers of several signatures with the same smallest text are compared once.
    marked = alone.withColumn("open", F.struct(_low("place").alias("low"), _high("place").alias("high")))
    members = stored(star.join(open_, "sig").join(marked, ["sig", "id", "place"], "left").groupBy("family", "id").agg(
        F.min(_low("place")).alias("low"), F.max(_high("place")).alias("high"), F.collect_set("open").alias("open")))
    if members.isEmpty():
        return rows, found
    of_members = _read_shingles(docs, members.select(F.col("id").alias("text_id")), where, passage.size)
    more = _verified_in_blocks(members, of_members, passage)
    return rows, stored(found.union(more).distinct())


def passages(docs: DataFrame, passage: Passage = Passage()) -> DataFrame:
    """``doc_id, mark, start, end, rep_doc_id, rep_start, rep_end, first`` in words, ends not included.

    One row for every passage of a document that occurs elsewhere, with the
    occurrence that represents it; ``first`` marks the representative itself.
    """
    rows, found = text_passages(docs, passage)
    more = passage.size - 1
    firsts = stored(rows.filter("n > 0").groupBy("text_id").agg(
        F.min(F.struct("doc_id", "mark")).alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    rep = firsts.select(F.col("text_id").alias("hub"), F.col("rep.doc_id").alias("rep_doc_id"))
    spans = found.join(rep, "hub").select(
        F.col("id").alias("text_id"), "start", (F.col("end") + more).alias("end"), "rep_doc_id",
        F.col("hub_start").alias("rep_start"), (F.col("hub_end") + more).alias("rep_end"), F.lit(False).alias("first"))
    own = found.join(rep, "hub").select(
        F.col("hub").alias("text_id"), F.col("hub_start").alias("start"), (F.col("hub_end") + more).alias("end"), "rep_doc_id",
        F.col("hub_start").alias("rep_start"), (F.col("hub_end") + more).alias("rep_end"), F.lit(True).alias("first")).distinct()
    zero = F.lit(0).cast("long")
    whole = firsts.filter((F.col("copies") > 1) & (F.col("n") >= passage.words)).select(
        "text_id", zero.alias("start"), F.col("n").alias("end"), F.col("rep.doc_id").alias("rep_doc_id"),
        zero.alias("rep_start"), F.col("n").alias("rep_end"), F.lit(None).cast("boolean").alias("first"))
    everywhere = spans.union(own).union(whole).join(rows.select("text_id", "doc_id", "mark"), "text_id").join(
        firsts.select("text_id", "rep"), "text_id")
    is_rep = F.struct("doc_id", "mark").eqNullSafe(F.col("rep"))
    return everywhere.select(
        "doc_id", "mark", "start", "end", "rep_doc_id", "rep_start", "rep_end",
        F.coalesce("first", is_rep).alias("first")).distinct()


def remove_repeats(docs: DataFrame, passage: Passage = Passage()) -> DataFrame:
    """Documents without the passages that are represented elsewhere; columns are unchanged."""
    name, d, m = (fresh(docs, c) for c in ("spans", "_d", "_m"))
    gone = stored(passages(docs, passage).filter(~F.col("first")).groupBy(
        F.col("doc_id").alias(d), F.col("mark").alias(m)).agg(F.collect_set(F.struct("start", "end")).alias(name)))
    on = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(m))
    text = F.col("text")
    kept = F.when(F.col(name).isNull(), text).otherwise(cut_words(text, F.col(name), r"[^\x20\x09-\x0D]"))
    return docs.join(small(gone), on, "left").withColumn("text", kept).drop(d, m, name)


def report(docs: DataFrame) -> DataFrame:
    """Repeated passages of all documents."""
    return passages(docs).drop("mark")
