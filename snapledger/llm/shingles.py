"""Word and shingle hashes of whole Arrow batches, in numpy passes over the UTF-8 bytes.

A word is a longest run of letters and digits after lower-casing; every non-ASCII character counts as a letter, so
the words of any script are kept. A shingle is five successive words; a text of one to four words has one shingle, of
all its words. Hashes have 64 bits and depend on the words alone, so equal words agree between tasks and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WORDS)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Running sums of the bytes' hashes, the inverse powers, begin and end of every word, and each text's first word."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if data is None or at[-1] == at[0]:
        none = np.zeros(0, np.int64)
        return np.zeros(1, np.uint64), np.ones(1, np.uint64), none, none, np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = _IS_WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True  # a word never runs over the end of its text
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=total[1:])
    return total, _powers(_INVERSE, len(raw)), starts, ends, np.searchsorted(starts, at)


def _hash(total: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the offset of each text's first word (one more than texts). Null: none."""
    total, inverse, starts, ends, at = _words(texts)
    return _hash(total, inverse, starts, ends), at


def stem_hashes(texts: pa.Array, stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of the first `stems` bytes of longer words, and the text that each belongs to."""
    total, inverse, starts, ends, at = _words(texts)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    hashes, owners = [_hash(total, inverse, starts, ends)], [text]
    for size in stems:
        long = ends - starts > size
        hashes.append(_hash(total, inverse, starts[long], starts[long] + size))
        owners.append(text[long])
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle in text order, and the offset of each text's first shingle (one more than texts)."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - WORDS + 1, 1))
    out_at = np.concatenate(([0], np.cumsum(n_shingles)))
    first = np.repeat(at[:-1] - out_at[:-1], n_shingles) + np.arange(out_at[-1])
    padded = np.concatenate((words, np.zeros(WORDS, np.uint64)))
    out = np.zeros(out_at[-1], np.uint64)
    short = np.repeat(np.minimum(counts, WORDS), n_shingles)
    for k in range(WORDS):
        out += np.where(k < short, padded[first + k], np.uint64(0)) * _STEP[k]
    return mix(out), out_at


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct shingle hashes in rising order, and how often each occurs."""
    hashes, at = shingle_hashes(texts)
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 where either is empty."""
    total = int(a[1].sum()) + int(b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)
