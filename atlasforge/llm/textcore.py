"""NumPy kernels over the UTF-8 buffers of Arrow text columns, shared by the corpus operators.

Words, shingles and spans are handled as 64-bit hashes that are computed for a whole slice of
documents at once: no Python object is made for a word. Slices are bounded in bytes, so memory
does not depend on how many documents an Arrow batch holds; a document longer than the bound is
a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE_BYTES = 1 << 20
BLOCK = 1 << 15
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that it has an inverse modulo 2**64
_WHITE = [0x20, *range(0x09, 0x0E)]

_tables: dict[str, np.ndarray] = {}


def lean(run):
    """The same function over Arrow batches, after which a Python worker gives freed memory back. Workers
    live on for other tasks, and allocators would keep what the largest of them took."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def lower_table() -> np.ndarray:
    """A-Z lower-cased, white space as 0, and the NUL character as a byte that UTF-8 never uses."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 255
    t[65:91] += 32
    t[_WHITE] = 0
    return t


LOWER = lower_table()


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: spreads every bit over the word."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, up to n."""
    if len(_tables.get("pow", ())) < n:
        size = max(n, SLICE_BYTES) + 1
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("pow", _BASE), ("inv", inverse)):
            t = np.full(size, b, dtype=U)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass
class Words:
    """The words of a slice: byte spans, hashes, and for each row its first word's index."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = inside & (~before | border[:n])
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = inside & (~after | border[1:])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free polynomial hashes of spans, from one prefix sum over the slice."""
    up, down = powers(len(values))
    sums = np.empty(len(values) + 1, dtype=U)
    sums[0] = 0
    for lo in range(0, len(values), BLOCK):  # what is multiplied is still in the cache when it is summed
        run = sums[lo + 1 : lo + 1 + BLOCK]
        np.multiply(values[lo : lo + BLOCK], up[lo : lo + len(run)], out=run)
        run[:1] += sums[lo : lo + 1]
        np.cumsum(run, out=run)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of other than white space, A-Z lower-cased, as hashes."""
    low = np.frombuffer(raw.tobytes().translate(LOWER.tobytes()), np.uint8)  # faster than LOWER[raw]
    start, end = spans(low != 0, offsets)
    return Words(start, end, span_hashes(low, start, end), np.searchsorted(start, offsets))


_SHINGLE = [U(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


@dataclass
class Sets:
    """Sorted distinct hashes of many rows one after another: row k has values[first[k] : first[k + 1]]."""

    values: np.ndarray
    first: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self, k: int) -> np.ndarray:
        return self.values[self.first[k] : self.first[k + 1]]

    def some(self, rows: np.ndarray) -> Sets:
        """The sets of those rows, which rise."""
        n = self.sizes()
        kept = np.zeros(len(n), bool)
        kept[rows] = True
        return Sets(self.values[np.repeat(kept, n)], np.concatenate(([0], np.cumsum(n[rows]))))


def _sorted_in_rows(g: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Hashes sorted within each row. One key with the row above a hash's upper bits sorts faster than two
    keys; where two hashes of a row share those bits in the wrong order, both keys are used."""
    bits = max(1, int(rows).bit_length())
    order = np.argsort(row.astype(U) << U(64 - bits) | g >> U(bits))
    out = g[order]
    if len(out) > 1 and ((out[1:] < out[:-1]) & (row[1:] == row[:-1])).any():
        out = g[np.lexsort((g, row))]
    return out


def shingle_sets(w: Words, size: int = 5) -> Sets:
    """For each row its distinct hashes of runs of `size` words; a row with fewer words has its whole
    sequence as one, a row without words none."""
    n, rows = np.diff(w.first), len(w.first) - 1
    if size == 1:
        g = mix(w.hash * _SHINGLE[0] + U(0x2545F4914F6CDD1D))
        return _distinct(g, np.repeat(np.arange(rows), n), w.first)
    many = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(many)))
    start = np.arange(first[-1]) - np.repeat(first[:-1], many) + np.repeat(w.first[:-1], many)
    width = np.minimum(np.repeat(n, many), size)
    terms = np.concatenate((w.hash, np.zeros(size, dtype=U)))
    g = width.astype(U) * U(0x2545F4914F6CDD1D)
    short = bool(len(n)) and int(n.min()) < size
    for k in range(size):  # word hashes are mixed already, so odd multipliers tell places apart
        term = terms[start + k] * (_SHINGLE[k % 5] + U(2 * (k // 5)))
        g += np.where(width > k, term, U(0)) if short else term
    return _distinct(mix(g), np.repeat(np.arange(rows), many), first)


def _distinct(g: np.ndarray, row: np.ndarray, first: np.ndarray) -> Sets:
    """Sets of rows' hashes, of which each row's begin at `first`."""
    g = _sorted_in_rows(g, row, len(first) - 1)
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    kept = np.concatenate(([0], np.cumsum(new)))
    return Sets(g[new], kept[first])


def set_classes(s: Sets) -> np.ndarray:
    """A hash of each row's set, as a long; 0 for an empty set."""
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(s.values), dtype=U)))
    n = s.sizes()
    h = mix(sums[s.first[1:]] - sums[s.first[:-1]] + n.astype(U))
    return np.where(n > 0, h, U(0)).view(np.int64)


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines of all rows, which row each belongs to, and its number there from 0."""
    cut = np.flatnonzero(raw == 10) + 1
    starts = np.sort(np.concatenate((offsets[:-1], cut)), kind="stable")
    many = 1 + np.searchsorted(cut, offsets[1:], side="right") - np.searchsorted(cut, offsets[:-1], side="right")
    row = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return np.append(starts, offsets[-1]), row, number


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit hashes, and the hashes in it. Their upper bits and their places sort as one
    number, which is much faster than sorting places by hashes; hashes that share those bits are put right after."""
    n = len(keys)
    mask = U((1 << max(1, n.bit_length())) - 1)
    both = keys & ~mask
    both |= np.arange(n, dtype=U)
    both.sort()
    both &= mask
    order = both.view(np.int64)
    s = keys[order]
    wrong = np.flatnonzero(s[1:] < s[:-1])
    if len(wrong) > 1000:  # not hashes
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    upper = s & ~mask if len(wrong) else s
    for k in wrong.tolist():
        run = slice(*(int(np.searchsorted(upper, upper[k], side=e)) for e in ("left", "right")))
        order[run] = order[run][np.argsort(keys[order[run]], kind="stable")]
        s[run] = keys[order[run]]
    return order, s


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes."""
    return ordered(keys)[0]


def distinct_counts(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs, or the sum of its weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        s = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        return s[at], np.diff(np.append(at, len(s)))
    order, s = ordered(keys)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.add.reduceat(weights[order], at)


def parted(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Cuts keys that are sorted by `part_of` into runs by part."""
    p = part_of(keys, parts)
    at = np.searchsorted(p, np.arange(parts + 1))
    for k in range(parts):
        if at[k + 1] > at[k]:
            yield k, slice(at[k], at[k + 1])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash: equal ranges of its upper 32 bits, so sorted keys are sorted by part."""
    return ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(next(d for d in ("u1", "<u2", "<u4", "<u8") if not x.size or int(x.max()) <= np.iinfo(d).max))


def press(x: np.ndarray) -> bytes:
    """An array by bytes of equal weight, compressed."""
    return x.dtype.str.encode() + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def unpress(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data[3:]), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack(x: np.ndarray) -> bytes:
    """Counts, places or hashes in as few bytes as their largest needs."""
    return press(small(x) if x.dtype.kind in "iu" and (not x.size or int(x.min()) >= 0) else x)
