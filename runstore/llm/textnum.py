"""Whole texts as numpy arrays of bytes, words and shingles, a slice of a batch at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A word's hash is a polynomial
of its bytes modulo 2**64, taken from prefix sums, so that no Python object is made for a word.

Memory is bounded by a slice, and for a longer text by a piece of it and 8 bytes or so a word: a text
of any length is worked in pieces that end at white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, MASK, 256, dtype=np.uint64)
BYTE_CODES[65:91] = BYTE_CODES[97:123]  # A-Z count as a-z
BASE = int(_rng.integers(1, MASK, dtype=np.uint64)) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
SHINGLE = 5
SHINGLE_CODES = _rng.integers(1, MASK, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
SLICE_BYTES = 1 << 18

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64; n is some slices' bytes at most."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            x = np.full(n + (1 << 16) + 1, np.uint64(base), np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and number of words before each text, for the words of all texts; bytes ``between`` part words."""
    n = len(data)
    ink = ~between[data]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    start[edges] = ink[edges]
    end[edges - 1] = ink[edges - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def _long_hash(data: np.ndarray) -> int:
    """The polynomial of one word of any length."""
    total = 0
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES]
        own = int((BYTE_CODES[part] * powers(len(part))[0][: len(part)]).sum(dtype=np.uint64))
        total = (total + own * pow(BASE, at, 1 << 64)) & MASK
    return total


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words in order, some slices' bytes of them at a time."""
    out, k, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while k < n:
        first = starts[k]
        upto = max(k + 1, int(np.searchsorted(ends, first + 2 * SLICE_BYTES, "right")))
        s, e = starts[k:upto] - first, ends[k:upto] - first
        if e[-1] > 2 * SLICE_BYTES:  # one word
            out[k] = _long_hash(data[first : first + e[-1]])
        else:
            part = data[first : first + e[-1]]
            up, down = powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(BYTE_CODES[part] * up[: len(part)], out=sums[1:])
            out[k:upto] = (sums[e] - sums[s]) * down[s]
        k = upto
    return mix(out + (ends - starts).astype(np.uint64))


def pieces(data: np.ndarray, limit: int = SLICE_BYTES):
    """(start, end) of pieces of one text, each of about ``limit`` bytes, which end after white space; a longer run without any is one piece."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + limit)
        if end < n:
            spaces = np.flatnonzero(IS_SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            while end < n and not IS_SPACE[data[end - 1]]:
                after = np.flatnonzero(IS_SPACE[data[end : end + limit]])
                end = end + int(after[0]) + 1 if len(after) else min(n, end + limit)
        yield at, end
        at = end


def hashes_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice's texts, with the number before each text."""
    if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
        s, e, first = word_bounds(data, offsets)
        return word_hashes(data, s, e), first
    found = []
    for a, b in pieces(data):
        s, e, _ = word_bounds(data[a:b], np.array([0, b - a]))
        found.append(word_hashes(data[a:b], s, e))
    h = np.concatenate(found)
    return h, np.array([0, len(h)])


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles (a shorter text is one), with the number before each text."""
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    before = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(before[-1], np.uint64)
    shift, short = first[:-1] - before[:-1], n < SHINGLE
    for lo in range(0, len(out), SLICE_BYTES):
        hi = min(len(out), lo + SLICE_BYTES)
        own = np.searchsorted(before, np.arange(lo, hi), "right") - 1
        at = np.arange(lo, hi) + shift[own]
        size = np.minimum(n[own], SHINGLE)
        total = size.astype(np.uint64) * SHINGLE_CODES[SHINGLE]
        some = short[own].any()
        for k in range(SHINGLE):
            w = hashes[np.minimum(at + k, len(hashes) - 1)] * SHINGLE_CODES[k]
            total += np.where(size > k, w, np.uint64(0)) if some else w
        out[lo:hi] = mix(total)
    return out, before


def shingle_sets(texts: pa.Array):
    """For each text in turn, its sorted distinct shingle hashes."""
    for _, data, offsets in slices(texts):
        h, before = shingles(*hashes_of_words(data, offsets))
        for k in range(len(before) - 1):
            own = np.sort(h[before[k] : before[k + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield own
