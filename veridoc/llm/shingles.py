"""Hashes of words and word shingles by numpy, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np

_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: What each byte counts as in a word's hash: A-Z as a-z, white space, which parts words, as nothing.
LOWER_VALUES = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)
LOWER_VALUES[_SPACE] = 0
_PLACES = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all of the input's."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: An odd factor for every place in a word; places beyond get one more, by which turn of the table they are in.
_FACTORS = mix(np.arange(1, _PLACES + 1, dtype=np.uint64)) | np.uint64(1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, the runs of bytes other than ASCII white space."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of `text`, with A-Z lower-cased."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return word_hashes_at(data, *word_bounds(data))


def word_hashes_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As `word_hashes`, for the words of `data` (bytes) with these bounds."""
    return span_hashes(data, starts, ends, LOWER_VALUES)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of `data` in order; `values` says what a byte counts as, 0 for the bytes between spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    spans = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    with np.errstate(over="ignore"):
        factors = _FACTORS[at & (_PLACES - 1)]
        if lens.max() > _PLACES:
            factors = factors * (mix((at // _PLACES).astype(np.uint64)) | np.uint64(1))
        sums = np.add.reduceat(values[data[starts[0] :]] * factors, starts - starts[0])
        return mix(sums + lens.astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of `k` words in order; of the whole sequence where it is shorter, of nothing where it is empty."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * np.uint64(3) + words[j : n - k + 1 + j])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of `text`."""
    return np.unique(shingle_hashes(word_hashes(text), k))


def words_of_all(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in turn, the index of each word's text, and its length in bytes."""
    raw = [(t or "").encode() for t in texts]
    joined = b"\n".join(raw)
    data = np.frombuffer(joined, np.uint8)
    starts, ends = word_bounds(data)
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    return word_hashes_at(data, starts, ends), np.searchsorted(np.cumsum(lens), starts, "right"), ends - starts
