"""Whole-batch text work on Arrow buffers with numpy: words, hashes, windows.

Everything here takes one slice of an Arrow column (a few MB), never a whole
partition, so memory is bounded by the slice plus the longest single text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BASE = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)
_TABLES = (_table(11), _table(77))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    got = _POWERS.get(which)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, _U(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:
            _POWERS[which] = got
    return got


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for every pair, equal for equal content.

    A polynomial: cheap for long ranges, but different contents can be made to
    collide, so it only finds what something stronger then verifies.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))


def byte_values(buf: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLES[which][buf]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def binary_bytes(col: pa.Array) -> np.ndarray:
    """All bytes of a column of binary values, one after the other."""
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)


#: Bytes of text after which a worker gives free memory back.
TIDY_BYTES = 1 << 26
_worked = 0


def tidy() -> None:
    """Give free memory back to the system: many arrays of some MB leave gaps that the allocator keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _worked_on(n: int) -> None:
    global _worked
    _worked += n
    if _worked >= TIDY_BYTES:
        _worked = 0
        tidy()


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``most`` bytes of text (or one row), with bytes and offsets."""
    buf, offs = column_bytes(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        _worked_on(int(offs[to] - offs[at]))
        at = to


def gathered(batches: Iterator[pa.RecordBatch], most: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``most`` bytes, for work that gains from larger slices."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and, per text, the index of its first word.

    The last array has one entry more than there are texts.
    """
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    dark = ~SPACE[buf]
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    full = offs[:-1] < offs[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads] = dark[heads]
    last[tails] = dark[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Words of more bytes than this are hashed one by one with a keyed digest.
LONG_WORD = 128
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def _eights(buf: np.ndarray) -> np.ndarray:
    """For every place the number that its eight bytes make."""
    return np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of words, eight bytes after eight through a mix that no algebra of the bytes undoes.

    ``which`` names one of two independent functions. Words of at most eight
    bytes and equal length never collide.
    """
    n = ends - starts
    with np.errstate(over="ignore"):
        h = mix64(n.astype(np.uint64) * _SEEDS[which] + _SEEDS[1 - which])
        if not len(n):
            return h
        eight, seed = _eights(buf), _SEEDS[which]
        live, at, left = np.flatnonzero(n <= LONG_WORD), starts, n
        if len(live) < len(n):
            at, left = starts[live], n[live]
            view = memoryview(np.ascontiguousarray(buf))
            for i in np.flatnonzero(n > LONG_WORD).tolist():
                h[i] = int.from_bytes(hashlib.blake2b(view[starts[i] : ends[i]], digest_size=8, key=b"%d" % which).digest(), "little")
        while len(live):
            part = eight[at] & _KEEP[np.minimum(left, 8)]
            h[live] = mix64((h[live] ^ part) + seed)
            more = np.flatnonzero(left > 8)
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def first_eight(buf: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number that the first eight of n[i] bytes from at[i] make."""
    return _eights(buf)[at] & _KEEP[np.minimum(n, 8)]


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n[i] bytes from a[i] and from b[i] are the same."""
    out = np.ones(len(a), bool)
    eight, live = _eights(buf), np.flatnonzero(n <= LONG_WORD)
    if len(live) < len(n):
        view = memoryview(np.ascontiguousarray(buf))
        for i in np.flatnonzero(n > LONG_WORD).tolist():
            out[i] = view[a[i] : a[i] + n[i]] == view[b[i] : b[i] + n[i]]
    x, y, left = a[live], b[live], n[live]
    while len(live):
        differ = (eight[x] ^ eight[y]) & _KEEP[np.minimum(left, 8)] != 0
        out[live[differ]] = False
        more = np.flatnonzero((left > 8) & ~differ)
        live, x, y, left = live[more], x[more] + 8, y[more] + 8, left[more] - 8
    return out


def runs_of(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every k neighbours, by doubling; each step mixes, so that no sum over the places is left."""
    seed = _SEEDS[which]

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(32))) * _U(0xA0761D6478BD642F) + seed)

    with np.errstate(over="ignore"):
        power, out, size, bit = hashes, None, 0, 1
        while bit <= k:
            if k & bit:
                out = power if out is None else both(out[: len(hashes) - size - bit + 1], power[size:]) if len(hashes) >= size + bit else hashes[:0]
                size += bit
            bit *= 2
            if bit <= k:
                half = bit // 2
                power = both(power[: max(len(power) - half, 0)], power[half:]) if len(power) > half else hashes[:0]
    return out[: max(len(hashes) - k + 1, 0)]


def windows(hashes: np.ndarray, firsts: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ``k`` consecutive words inside one text.

    Returns the window's first word (index in ``hashes``), its hash, and per
    text the index of its first window (one entry more than texts).
    """
    counts = np.maximum(np.diff(firsts) - k + 1, 0)
    heads = np.zeros(len(firsts), np.int64)
    np.cumsum(counts, out=heads[1:])
    at = np.arange(heads[-1]) + np.repeat(firsts[:-1] - heads[:-1], counts)
    return at, runs_of(hashes, k, which)[at], heads


def short_sequences(hashes: np.ndarray, at: np.ndarray, n: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the n[i] words from at[i], for small n; marked by their number."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in np.unique(n).tolist():
            mine = n == k
            out[mine] = mix64(runs_of(hashes, k, which)[at[mine]] + _U(k) * _SEEDS[1 - which])
    return out


def squeezed(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of white space replaced by one space."""
    if not len(buf):
        return buf, offs
    white = SPACE[buf]
    again = white.copy()
    again[1:] &= white[:-1]
    again[0] = False
    heads = offs[:-1][offs[:-1] < offs[1:]]
    again[heads] = False
    out = np.where(white, np.uint8(0x20), buf)
    if not again.any():
        return out, offs
    kept = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~again, out=kept[1:])
    return out[~again], kept[offs]


def distinct_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different ranges of bytes in order of first place, and which of them each range is.

    Ranges of one hash are one only where their bytes are the same.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    import pandas as pd

    which, _ = pd.factorize(word_hashes(buf, starts, ends))
    one = np.empty(int(which.max()) + 1, np.int64)
    one[which[::-1]] = np.arange(len(starts) - 1, -1, -1)
    size, first = ends - starts, one[which]
    same = (size == size[first]) & (first_eight(buf, starts, size) == first_eight(buf, starts[first], size))
    long = np.flatnonzero(same & (size > 8))
    same[long] = same_bytes(buf, starts[long], starts[first[long]], size[long])
    whole = buf.tobytes()
    found = [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
    if not same.all():
        numbers: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            piece = whole[starts[i] : ends[i]]
            if piece not in numbers:
                numbers[piece] = len(found)
                found.append(piece)
            which[i] = numbers[piece]
    return found, which
