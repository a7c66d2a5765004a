"""Vectorised word kernels over the UTF-8 buffers of Arrow string columns.

A batch is cut into groups of whole documents of about ``GROUP_BYTES``; a longer
document is cut between words, so the memory of a kernel is bounded by the
longest single word, not by the longest text. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """256 flags; the inclusive ranges are set."""
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACED = ~byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = ~byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


#: Powers of the base and of its inverse modulo 2**64, as many as a worker has needed so far.
_POWERS = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), base, dtype=_U)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[starts[i]:ends[i]]``; equal bytes have equal hashes wherever they stand."""
    p, inverse = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=_U)
    total[0] = 0
    np.cumsum((buf.astype(_U) + _U(1)) * p[: len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row starts and ends in them."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or not len(column):
        z = np.zeros(len(column), dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), z, z
    at = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, at[:-1], at[1:]


def groups(starts: np.ndarray, ends: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or one longer row."""
    i, n = 0, len(starts)
    while i < n:
        j = i + 1
        if ends[i] - starts[i] < most:
            j = max(j, int(np.searchsorted(ends, starts[i] + most, side="right")))
            while j > i + 1 and ends[j - 1] - starts[i] > most:
                j -= 1
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in ``buf``; a word never crosses the rows' bounds."""
    inside = table[buf]
    full = ends > starts
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[starts[full]] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[ends[full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _pieces(text: np.ndarray, table: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts one long text between words."""
    at, n = 0, len(text)
    while at < n:
        to, reach = min(at + most, n), most
        while to < n:
            free = np.flatnonzero(~table[text[at:to]])
            if len(free):
                to = at + int(free[-1]) + 1
                break
            reach *= 2
            to = min(at + reach, n)
        yield at, to
        at = to


def hashed_words(column: pa.Array, table: np.ndarray, lower: bool = False, spans: bool = False) -> Iterator[tuple]:
    """Yields (first row, last row + 1, words of each row, hashes of all their words in order), and with ``spans`` the words' first and last byte and length too."""
    data, starts, ends = column_bytes(column)
    for i, j in groups(starts, ends):
        low, high = int(starts[i]), int(ends[j - 1])
        if high - low <= 2 * GROUP_BYTES:
            parts = [(data[low:high], starts[i:j] - low, ends[i:j] - low)]
        else:  # one long row
            text = data[low:high]
            parts = [(text[a:b], np.array([0]), np.array([b - a])) for a, b in _pieces(text, table, GROUP_BYTES)]
        counts, hashes, shapes = np.zeros(j - i, dtype=np.int64), [], []
        for buf, s, e in parts:
            if lower:
                buf = LOWER[buf]
            if len(buf):
                ws, we = word_spans(buf, s, e, table)
                hashes.append(span_hashes(buf, ws, we))
                counts += np.searchsorted(ws, e, side="left") - np.searchsorted(ws, s, side="left")
                if spans:
                    shapes.append((buf[ws], buf[we - 1], buf[np.maximum(we - 2, ws)], we - ws))
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=_U)
        if spans:
            yield i, j, counts, h, tuple(np.concatenate(x) for x in zip(*shapes)) if shapes else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        else:
            yield i, j, counts, h
