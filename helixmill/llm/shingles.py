"""Word shingles as 64-bit hashes, over all texts of an Arrow batch at once."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from helixmill.llm.common import Memo, mix64

#: Bytes of a generation of the memo of words: small, as a hash is quickly made again.
MEMO = 16 << 20


@functools.cache
def word_memo() -> Memo:
    """Word (bytes) to the 8 bytes of its hash, for this Python worker."""
    return Memo(lambda word: xxhash.xxh64_digest(word), MEMO, 48)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text."""
    own = word_memo().alone().__getitem__
    joined, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text.lower() if lower else text).split()
        counts[i] = len(words)
        joined.append(b"".join(map(own, words)))
    return np.frombuffer(b"".join(joined), "<u8"), counts


def window_hashes(words: np.ndarray, counts: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, the text of each, and its first word's place overall."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    odd = mix64(np.arange(1, size + 1, dtype=np.uint64), 100 + seed) | np.uint64(1)
    mixed = mix64(words, seed)
    total = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += mixed[k : n - size + 1 + k] * odd[k]
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[: n - size + 1] == text[size - 1 :]
    place = np.flatnonzero(whole)
    return mix64(total[place], seed + 1), text[place], place


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending inside each, and their number for each text.

    A text with fewer words than ``size`` has one shingle, its whole sequence; one without words has none.
    """
    words, counts = word_hashes(texts)
    hashes, text, _ = window_hashes(words, counts, size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        starts = np.cumsum(counts) - counts
        own = np.array([int.from_bytes(xxhash.xxh64_digest(bytes([int(counts[i])]) + words[starts[i] : starts[i] + counts[i]].tobytes()), "little") for i in short], np.uint64)
        hashes, text = np.concatenate([hashes, own]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[first], np.bincount(text[first], minlength=len(texts)).astype(np.int64)


def similarity_sketch(hashes: np.ndarray, counts: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Fast similarity sketch of each set: ``width`` uint64 coordinates, all ones for an empty set.

    In round r < width every element falls into one hashed bin and offers r with a hash; in round r >= width every
    element offers to bin r - width. A bin keeps its least offer, and a set is done when all its bins are filled, so
    2 * width rounds always fill it, and few do for a set that isn't small.
    """
    sets = len(counts)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(sets * width, empty)
    owner = np.repeat(np.arange(sets), counts)
    for r in range(2 * width):
        if not len(hashes):
            break
        offered = mix64(hashes, 1000 + seed * 1000 + r)
        value = (offered >> np.uint64(16)) | np.uint64(r << 48)
        place = (mix64(offered, 7) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32) if r < width else np.full(len(hashes), r - width, np.uint64)
        np.minimum.at(sketch, owner * width + place.astype(np.int64), value)
        open_sets = (sketch.reshape(sets, width) == empty).any(axis=1)
        stay = open_sets[owner]
        hashes, owner = hashes[stay], owner[stay]
    return sketch.reshape(sets, width)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One uint64 for each band of ``rows`` coordinates."""
    bands = sketch.shape[1] // rows
    out = np.zeros((len(sketch), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(sketch), b, np.uint64)
            for r in range(rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ sketch[:, b * rows + r], b)
            out[:, b] = key
    return out
