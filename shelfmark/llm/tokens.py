"""Words and word shingles of whole Arrow batches, as NumPy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Text handled at once; a longer single text is handled alone.
SLICE_BYTES = 2_000_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def word_hashes(texts: pa.Array, pattern: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets of each text's words).

    A-Z are lower-cased. Words are what white space (0x20, 0x09-0x0D) parts, or
    what ``pattern`` parts if given. NULL has no words. Only distinct words are
    hashed one by one.
    """
    folded = pc.ascii_lower(pc.fill_null(texts, ""))
    listed = pc.split_pattern_regex(folded, pattern) if pattern else pc.ascii_split_whitespace(folded)
    offsets = listed.offsets.to_numpy().astype(np.int64)
    values = listed.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    # By to_numpy, as to_pylist makes a scalar of every word on the way.
    known = values.dictionary.to_numpy(zero_copy_only=False)
    table = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    codes = values.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(values.dictionary, "").to_numpy(zero_copy_only=False)
    if len(codes) and empty.any():
        dropped = empty[codes]
        offsets = offsets - np.concatenate([[0], np.cumsum(dropped)])[offsets]
        codes = codes[~dropped]
    return table[codes] if len(codes) else np.zeros(0, np.uint64), offsets


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of a flat word array (also across texts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, size):
        h = h * _FACTOR + words[i:i + n]
    return mix(h)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A text with fewer words than ``size``, but not none, has one shingle: all
    its words. Without words the set is empty.
    """
    words, offsets = word_hashes(texts)
    runs = shingle_hashes(words, size)
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - start >= size:
            found = np.sort(runs[start:end - size + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif end > start:
            yield shingle_hashes(np.concatenate([[np.uint64(end - start)], words[start:end]]), int(end - start) + 1)
        else:
            yield np.zeros(0, np.uint64)
