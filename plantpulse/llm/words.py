"""Words of Arrow text columns as 64-bit hashes, found by whole-batch numpy passes over the UTF-8 bytes.

Word boundaries are ASCII bytes, so cutting bytes equals cutting code points. A word's hash is a
polynomial over its bytes modulo 2^64, mixed at the end; it depends on nothing but the word, so tasks
and reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Bytes handled by one numpy pass; bounds the memory of a task, not the length of a text. A pass takes some 50 bytes a
# byte, the powers below 16, and a worker that is used again keeps both.
PIECE_BYTES = 512 << 10


def byte_table(word_bytes, lower: bool = True) -> np.ndarray:
    """For each byte its value (A-Z lower-cased), or 0 where it ends a word."""
    table = np.zeros(256, np.uint8)
    for b in word_bytes:
        table[b] = b + 32 if lower and 65 <= b <= 90 else b
    return table


# All but space and \t \n \v \f \r; a NUL byte is a word character, kept apart from the 0 above as 255.
SPACED = byte_table(b for b in range(1, 256) if b != 32 and not 9 <= b <= 13)
SPACED[0] = 255
# Digits, letters and everything outside ASCII.
ALNUM = byte_table(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _MIX_1
    h ^= h >> np.uint64(27)
    h *= _MIX_2
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE_BYTES + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _TABLES:
        _TABLES[0], _TABLES[1] = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    return _TABLES[0], _TABLES[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start byte, end byte) of every word, in order; bytes count within `data`."""
    hashes, rows, starts, ends = [], [], [], []
    first, total = 0, len(offsets) - 1
    while first < total:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES // 2, "right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        h, s, e = _pieces(data[low:high], offsets[first:last] - low, table)
        hashes.append(h)
        starts.append(s + low)
        ends.append(e + low)
        rows.append(np.searchsorted(offsets[first + 1:last + 1] - low, s, "right") + first)
        first = last
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in (hashes, rows, starts, ends))


def bounds(value: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of non-zero bytes that stays within one text; begins: where texts start."""
    inside = value != 0
    turn = np.zeros(len(value) + 1, bool)
    turn[0], turn[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=turn[1:-1])
    cut = np.unique(begins[(begins > 0) & (begins < len(value))])  # empty texts begin where the next one does
    cut = cut[inside[cut] & inside[cut - 1]]  # two texts that touch without a space
    edges = np.flatnonzero(turn)
    if not len(cut):
        return edges[0::2], edges[1::2]
    return np.sort(np.concatenate([edges[0::2], cut])), np.sort(np.concatenate([edges[1::2], cut]))


def _pieces(data: np.ndarray, begins: np.ndarray, table: np.ndarray):
    """Words of some whole texts; a text longer than a piece is hashed piece by piece between words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = table[data]
    starts, ends = bounds(value, begins)
    up, down = powers()
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE_BYTES, "right")))
        high = int(ends[j - 1])
        if high - low > PIECE_BYTES:  # one word longer than a piece
            out[i] = _long_word(value[low:high], up)
        else:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(value[low:high] * up[:high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64)), starts, ends


def _long_word(value: np.ndarray, up: np.ndarray) -> np.uint64:
    total, factor = np.uint64(0), np.uint64(1)
    step = np.uint64(up[PIECE_BYTES])
    with np.errstate(over="ignore"):
        for at in range(0, len(value), PIECE_BYTES):
            part = value[at:at + PIECE_BYTES]
            total = total + factor * np.sum(part * up[:len(part)], dtype=np.uint64)
            factor = factor * step
    return total


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of `width` words within one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[width - 1:] == rows[:n])
    out = hashes[at].copy()
    for k in range(1, width):
        out *= np.uint64(_BASE)
        out += hashes[at + k]
    return mix(out), at


def shingles(hashes: np.ndarray, rows: np.ndarray, total: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `total` texts: the hashes, sorted within each row, and where each row begins.

    A text of fewer than `width` words, but not none, is one shingle of all its words.
    """
    h, at = windows(hashes, rows, width)
    r = rows[at]
    count = np.bincount(rows, minlength=total)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(rows, short)
        lone = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = count[short] > k
            lone[more] = lone[more] * np.uint64(_BASE) + hashes[first[more] + k]
        place = np.searchsorted(r, short)
        h, r = np.insert(h, place, mix(lone ^ np.uint64(1))), np.insert(r, place, short)
    bounds = np.searchsorted(r, np.arange(total + 1))
    for i in np.flatnonzero(np.diff(bounds) > 1):
        h[bounds[i]:bounds[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], kept[bounds]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20):
    """(first row, texts' bytes, their offsets) of runs of rows with about `most_bytes` of text, or one longer text."""
    data, offsets = text_bytes(batch.column(column))
    first, total = 0, len(offsets) - 1
    while first < total:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        low = offsets[first]
        yield first, data[low:offsets[last]], offsets[first:last + 1] - low
        first = last
