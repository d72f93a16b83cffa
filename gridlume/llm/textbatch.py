"""Vectorised work on Arrow text columns: slices of UTF-8 bytes, words, 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII other than letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def slices(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``limit`` bytes; a longer text stands alone; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def _edges(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words: runs of bytes not in ``breaks``, within rows."""
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sums of the bytes, A-Z lower-cased, times powers of the hash base; its inverse powers)."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((LOWER[data].astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return total, down


def _hashed(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    return mixed((total[ends] - total[starts]) * down[starts] ^ (ends - starts + salt).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end): words are runs of bytes not in ``breaks``, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    starts, ends = _edges(data, offsets, breaks)
    return _hashed(*_sums(data), starts, ends), np.searchsorted(starts, offsets)


def words_and_prefixes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of all words and of their first bytes, for each of the lengths that a word exceeds."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    starts, ends = _edges(data, offsets, breaks)
    rows, sums = np.searchsorted(offsets, starts, "right") - 1, _sums(data)
    values, owners = [_hashed(*sums, starts, ends)], [rows]
    for n in lengths:
        longer = ends - starts > n
        values.append(_hashed(*sums, starts[longer], starts[longer] + n, 1 << 32))
        owners.append(rows[longer])
    return np.concatenate(values), np.concatenate(owners)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, offsets): word runs of ``size``; a row of fewer words has its whole sequence as one."""
    values, at = words(data, offsets)
    counts = np.diff(at)
    n = len(values)
    rows = np.repeat(np.arange(len(counts)), counts)
    odd = mixed(np.arange(1, size + 1, dtype=U)) | U(1)
    whole = max(0, n - size + 1)
    sums = np.zeros(whole, U)
    for k in range(size):
        sums += values[k : k + whole] * odd[k]
    full = rows[:whole] == rows[size - 1 :] if whole else np.zeros(0, bool)
    hashes, owner = [mixed(sums[full])], [rows[:whole][full]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hashes.append(mixed(np.array([sum(int(v) * int(o) for v, o in zip(values[at[r] : at[r + 1]], odd)) + int(counts[r]) * 0xA0761D6478BD642F & (1 << 64) - 1 for r in short], U)))
        owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner)) if len(short) else _by_row(hashes, owner)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _by_row(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order that sorts each row's hashes; rows are together already."""
    cuts = np.flatnonzero(np.diff(owner)) + 1
    parts = np.split(np.arange(len(hashes)), cuts)
    return np.concatenate([p[np.argsort(hashes[p[0] : p[-1] + 1])] for p in parts if len(p)]) if len(hashes) else np.zeros(0, np.int64)
