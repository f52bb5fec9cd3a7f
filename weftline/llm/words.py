"""Hashes of words, for whole Arrow columns of texts at a time.

Words are runs of other than ASCII white space. A word's 64-bit hash is a polynomial over its overlapping pairs of
bytes, taken from running sums over a block of text, and mixed. No Python object is made or kept for a word, so a task
holds a block's arrays and the hashes, however many different words there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_PLAIN = np.where(_WORD, np.arange(256), 0).astype(np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_PAIRS = mixed(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(BLOCK, 1 << (n - 1).bit_length())
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, np.uint64(x))
            out[0] = 1
            _powers[i] = np.cumprod(out)
    return _powers


def _block_hashes(data: np.ndarray, cuts: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, whose texts lie between cuts, and how many come before each cut."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    bytes_, inside = fold[data], _WORD[data]
    begin, end = (cuts[i][cuts[:-1] < cuts[1:]] for i in (slice(None, -1), slice(1, None)))
    pairs = bytes_.astype(np.uint16)
    pairs[:-1] |= bytes_[1:].astype(np.uint16) << 8
    pairs[end - 1] &= 255
    power, inverse = _powers_of(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_PAIRS[pairs] * power[: len(data)], out=sums[1:])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[begin] = inside[begin]
    last[:-1] &= ~inside[1:]
    last[end - 1] = inside[end - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mixed((sums[stop] - sums[start]) * inverse[start]), np.searchsorted(start, cuts)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in blocks that end at white space."""
    at = 0
    while at < len(data):
        to = at + BLOCK
        if to < len(data):
            spaces = np.flatnonzero(~_WORD[data[at:to]])
            while not len(spaces) and to < len(data):  # a word longer than a block
                spaces, to = np.flatnonzero(~_WORD[data[to : to + BLOCK]]) + (to - at), to + BLOCK
            to = at + int(spaces[-1]) + 1 if len(spaces) else len(data)
        yield data[at:to]
        at = to


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of all words of all texts end to end, and where each text's begin (one more entry than texts).

    Null texts have none. lower: A-Z count as a-z.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    fold = _LOWER if lower else _PLAIN
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, values = texts.buffers()
    if not len(texts) or values is None:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    places = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)
    found, bounds, total, row = [], [np.zeros(1, np.int64)], 0, 0
    while row < len(texts):
        to = max(int(np.searchsorted(places, places[row] + BLOCK, "right")) - 1, row + 1)
        own = data[places[row] : places[to]]
        if len(own) <= BLOCK:
            h, before = _block_hashes(own, places[row : to + 1] - places[row], fold)
        else:
            h = np.concatenate([_block_hashes(x, np.array([0, len(x)]), fold)[0] for x in _pieces(own)])
            before = np.array([0, len(h)])
        found.append(h)
        bounds.append(before[1:] + total)
        total, row = total + len(h), to
    return np.concatenate(found), np.concatenate(bounds)


def sliced(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some most_bytes of text (column number text), one row at least."""
    for batch in batches:
        at, size = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        while at < batch.num_rows:
            to = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def run_hashes(codes: np.ndarray, n: int, base: int = _BASE) -> np.ndarray:
    """A hash of each run of n codes, put together from runs of powers of two."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    out, have, power, size = None, 0, codes, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                m = len(codes) - have - size + 1
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + power[have : have + m]
                have += size
        if size * 2 > n:
            return mixed(out)
        m = len(power) - size
        power, size = power[:m] * np.uint64(pow(base, size, 1 << 64)) + power[size : size + m], size * 2
