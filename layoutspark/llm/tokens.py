"""Vectorised tokenising of Arrow string columns: 64-bit word hashes by document, without a Python object per word.

Words are runs of bytes other than space and \\t..\\r, which in UTF-8 is the same as runs of such characters.
A word's hash is a polynomial over a byte table modulo 2**64, read off prefix sums and then mixed, so a chunk of
text costs a handful of numpy passes. Long texts are cut at separators: memory is bounded by CHUNK, not by a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
#: Bytes of text that callers hold at once, besides a single longer text.
SLICE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
#: Alone a separator of lines.
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, CHUNK) + 1, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def flags(*values: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True bytes of each text; mask begins at the first text."""
    sums = np.concatenate(([0], np.cumsum(mask)))
    return np.diff(sums[offsets - offsets[0]])


def slices(lengths: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose lengths add up to about most; a longer row is alone."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def _cuts(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + CHUNK, end)
        if to < end:
            inside = np.searchsorted(offsets, to, "right") - 1
            boundary = int(offsets[inside])
            gaps = np.flatnonzero(sep[data[max(at, boundary) : to]])
            if len(gaps):
                to = max(at, boundary) + int(gaps[-1]) + 1
            elif boundary > at:
                to = boundary
            else:  # one word longer than a chunk
                stop = int(offsets[inside + 1])
                while to < stop:
                    gaps = np.flatnonzero(sep[data[to : min(stop, to + CHUNK)]])
                    if len(gaps):
                        to += int(gaps[0])
                        break
                    to = min(stop, to + CHUNK)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, bounds of each text among the words, first byte, byte length of each word); words end at bytes in sep."""
    table = _LOWER if lower else _TABLE
    hashes, starts, sizes = [], [], []
    for s, e in _cuts(data, offsets, sep):
        b = data[s:e]
        n = e - s
        up, down = _powers(n)
        word = ~sep[b]
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = ~word[:-1]
        inner = offsets[np.searchsorted(offsets, s, "right") : np.searchsorted(offsets, e, "left")] - s
        edge[inner] = True
        first = np.flatnonzero(word & edge[:n])
        after = np.ones(n, dtype=bool)
        after[: n - 1] = ~word[1:]
        after[inner - 1] = True
        last = np.flatnonzero(word & after) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[b] * up[:n], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        starts.append(first + s)
        sizes.append(last - first)
    if not hashes:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    first = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(first, offsets, "left").astype(np.int64), first, np.concatenate(sizes)


def _salt(n: int) -> np.uint64:
    return U(n * 0xE7037ED1A0B428DB % (1 << 64))


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of width words, bounds by text). A text with fewer words has the whole sequence as its one shingle; without words, none."""
    n, counts = len(hashes), np.diff(bounds)
    base = U(0xA0761D6478BD642F)
    full = max(0, n - width + 1)
    run = np.zeros(full, dtype=np.uint64)
    for k in range(width):
        run = run * base + hashes[k : k + full]
    run = mix(run + _salt(width))
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros(int(out_bounds[-1]), dtype=np.uint64)
    long = np.flatnonzero(counts >= width)
    if len(long):
        size = per[long]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(out_bounds[long], size) + step] = run[np.repeat(bounds[long], size) + step]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.zeros(1, dtype=np.uint64)
        for w in hashes[bounds[i] : bounds[i + 1]]:
            h = h * base + w
        out[out_bounds[i]] = mix(h + _salt(int(counts[i])))[0]
    return out, out_bounds
