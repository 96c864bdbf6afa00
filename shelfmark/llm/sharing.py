"""Finding the sharers of signatures among very many ``(signature, owner, place)`` rows.

Nearly all signatures have one owner, so what counts is to bring equal ones
together cheaply. Tasks sort their rows by signature and hand them over as
packed columns for ranges of signatures; each range is then sorted and
searched in one piece, whose size is set by the number of ranges. For that,
signatures must be spread evenly over 64 bits. Before that, equal signatures
of a hand-over are tied to the smallest owner: only that row goes on under the
signature, the others travel on their own. A signature that a third of all
owners share therefore meets itself in as many rows as there are hand-overs,
not owners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.tokens import mix

# Rows that a task holds before it hands them over, and rows that a range should have.
HELD, RANGE_ROWS = 150_000, 300_000
# Rows of a part that is handed over, or handed back, at once where they need not be together:
# less than half a MB, so that no part is a humongous object of the JVM.
PART_ROWS = 8_000
PACKED, SHARED = "range int, data binary", "sig long, id long, place long, hub long, at long, till long"


def ranges_for(rows: int) -> int:
    """Number of signature ranges for about so many rows."""
    return max(1, -(-rows // RANGE_ROWS))


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, ...: like bytes lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplaned(data: memoryview, kind: type, count: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(data[:width * count], np.uint8).reshape(width, count)
    return np.ascontiguousarray(flat.T).view(kind).reshape(count)


def _pack(sig: np.ndarray, who: np.ndarray, place: np.ndarray, known: np.ndarray) -> bytes:
    names, at = np.unique(who, return_inverse=True)
    head = np.array([0, len(sig), len(names)], np.int64).tobytes()
    return b"".join((head, _planes(names), _planes(sig), _planes(at.astype(np.uint32)), _planes(place), known.tobytes()))


def _last(who: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """For each row the last one of its signature's smallest owner; ``lead`` is the first."""
    own = who == who[lead]
    return np.maximum.reduceat(np.where(own, np.arange(len(who)), 0), np.unique(lead))[np.unique(lead, return_inverse=True)[1]]


class Gatherer:
    """Rows of one task."""

    def __init__(self, ranges: int) -> None:
        self.ranges = ranges
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, sig: np.ndarray, owner: int | np.ndarray, place: np.ndarray | None = None) -> None:
        """Signatures (as unsigned values) of an owner, or of one each, with their places."""
        place = np.zeros(len(sig), np.int64) if place is None else place
        self.parts.append((sig, np.broadcast_to(np.asarray(owner, np.int64), len(sig)), place))
        self.held += len(sig)

    def _handed(self) -> pa.RecordBatch:
        sig, who, place = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.lexsort((place, who, sig))
        sig, who, place = sig[order], who[order], place[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1]) | (place[1:] != place[:-1])])
        sig, who, place = sig[new], who[new], place[new]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
        tied, last = who != who[lead], _last(who, lead)
        known = np.zeros(len(sig), np.uint8)
        known[lead[tied]] = 1
        numbers, data = [], []
        if tied.any():
            # These need nobody else: any range will do, and parts of bounded size.
            rows = [sig[tied].view(np.int64), who[tied], place[tied], who[lead][tied], place[lead][tied], place[last][tied]]
            for start in range(0, len(rows[0]), PART_ROWS):
                part = [r[start:start + PART_ROWS] for r in rows]
                numbers.append(int(mix(part[0][:1].view(np.uint64) ^ part[1][-1:].view(np.uint64))[0] % np.uint64(self.ranges)))
                data.append(np.array([1, len(part[0]), 0], np.int64).tobytes() + b"".join(r.tobytes() for r in part))
        sig, who, place, known = sig[~tied], who[~tied], place[~tied], known[~tied]
        number = ((sig >> np.uint64(32)) * np.uint64(self.ranges)) >> np.uint64(32)
        cuts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            numbers.append(int(number[a]))
            data.append(_pack(sig[a:b], who[a:b], place[a:b], known[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["range", "data"])

    def run(self, batches: Iterator[pa.RecordBatch], each: Callable[[pa.RecordBatch], None],
            last: Callable[[], None] = lambda: None) -> Iterator[pa.RecordBatch]:
        """Call ``each`` for the batches and ``last`` at the end; hand over what they add."""
        for batch in batches:
            each(batch)
            if self.held > HELD:
                yield self._handed()
        last()
        if self.held:
            yield self._handed()


def _sharers(rows: list[memoryview]) -> Iterator[pa.RecordBatch]:
    """Sharers of the signatures of one range."""

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "id", "place", "hub", "at", "till"])

    parts = []
    for data in rows:
        kind, n, names = np.frombuffer(data[:24], np.int64)
        data = data[24:]
        if kind:
            yield out([np.frombuffer(data[8 * n * i:8 * n * (i + 1)], np.int64) for i in range(6)])
            continue
        known = _unplaned(data, np.int64, names)
        data = data[8 * names:]
        sig, data = _unplaned(data, np.uint64, n), data[8 * n:]
        at, data = _unplaned(data, np.uint32, n), data[4 * n:]
        place, data = _unplaned(data, np.int64, n), data[8 * n:]
        parts.append((sig, known[at], place, np.frombuffer(data[:n], np.uint8)))
    if not parts:
        return
    sig, who, place, known = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((place, who, sig))
    sig, who, place, known = sig[order], who[order], place[order], known[order]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([start, [len(sig)]]))
    several = (who[start] != who[start + size - 1]) | (np.maximum.reduceat(known, start) > 0)
    keep, lead = np.repeat(several, size), np.repeat(start, size)
    last = _last(who, lead)
    last, lead = last[keep], lead[keep]
    rows = [sig.view(np.int64)[keep], who[keep], place[keep], who[lead], place[lead], place[last]]
    for start in range(0, len(lead), PART_ROWS):
        yield out([r[start:start + PART_ROWS] for r in rows])


def sharers(packed: DataFrame, ranges: int) -> DataFrame:
    """``sig, id, place, hub, at, till`` of signatures with several owners.

    ``hub, at, till`` is the smallest owner and its first and last place, of the
    range or of a hand-over; an owner that is its own hub is listed too.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []
        for batch in batches:
            for r, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != number and held:
                    yield from _sharers(held)
                    held = []
                number = r
                held.append(memoryview(data.as_buffer()))
        if held:
            yield from _sharers(held)

    return packed.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(work, SHARED)
