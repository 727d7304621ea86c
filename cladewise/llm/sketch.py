"""Count-min sketches of 64-bit hashes, made per task and merged by block.

A task sends, for each row of the sketch and each block of 65,536 counters, the
counters it has met once and those it has met more often. Merging adds them up
to two. What is left of the merged sketch is one bit per counter: met at least
twice. As in any count-min sketch the estimate is never too low, so a hash
whose bits are not all set occurs once in the whole input; a hash with all bits
set may also occur once. Its size is fixed by ``log2_width`` and ``depth``, and
so is what is collected and broadcast: depth * 2**log2_width bits.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 16
#: Hashes that a task keeps before it sends a partial sketch.
HELD = 4_000_000
_DENSE = BLOCK // 8
#: Counters of whole counts, and the hash bits that choose one: a table of fixed size, whatever the input.
LOG2_COUNTS, COUNT_SHIFT = 20, 43


def counter(hashes: np.ndarray, row: int, log2_width: int) -> np.ndarray:
    """Counter of each hash in a row of the sketch; rows use different bits."""
    return (hashes >> np.uint64(32 * row)) & np.uint64((1 << log2_width) - 1)


def _pack(local: np.ndarray) -> bytes:
    """Sorted different 16-bit numbers; as a bitmap where that is shorter."""
    if 2 * len(local) < _DENSE:
        return local.astype("<u2").tobytes()
    bits = np.zeros(BLOCK, bool)
    bits[local.astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if len(raw) < _DENSE:
        return np.frombuffer(raw, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


class Partial:
    """The partial sketch of one task."""

    def __init__(self, log2_width: int, depth: int):
        self.log2_width, self.depth, self.held, self.n = log2_width, depth, [], 0
        self.counts = np.zeros(1 << LOG2_COUNTS, np.uint32)

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes)
        self.n += len(hashes)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        hashes = np.concatenate(self.held)
        self.held, self.n = [], 0
        self.counts += np.bincount(_counters(hashes), minlength=len(self.counts)).astype(np.uint32)
        per_row = 1 << (self.log2_width - 16)
        for row in range(self.depth):
            c = np.sort(counter(hashes, row, self.log2_width).astype(np.uint32))
            new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            many = np.diff(np.r_[new, len(c)]) > 1
            c = c[new]
            cuts = np.searchsorted(c, np.arange(per_row + 1, dtype=np.uint64) << np.uint64(16))
            local = (c & np.uint32(BLOCK - 1)).astype(np.uint16)
            full = np.flatnonzero(np.diff(cuts))
            once = [_pack(local[cuts[b] : cuts[b + 1]][~many[cuts[b] : cuts[b + 1]]]) for b in full]
            twice = [_pack(local[cuts[b] : cuts[b + 1]][many[cuts[b] : cuts[b + 1]]]) for b in full]
            yield pa.RecordBatch.from_arrays([pa.array((full + row * per_row).astype(np.int32)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: one block's counters (64 KB) are held at a time."""
    cur, sums, done = None, None, []

    def closed():
        if cur is None:
            return
        if (sums >= 2).any():
            done.append((cur, zlib.compress(np.packbits(sums >= 2, bitorder="little").tobytes(), 1)))

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], pa.int32()), pa.array([r[1] for r in done], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if block != cur:
                closed()
                cur, sums = block, np.zeros(BLOCK, np.uint8)
            at = _unpack(once)
            sums[at] = np.minimum(sums[at] + 1, 2)
            sums[_unpack(twice)] = 2
        if len(done) >= 256:
            yield made()
            done.clear()
    closed()
    yield made()


class Repeated:
    """The merged sketch: tells which hashes may occur more than once."""

    def __init__(self, log2_width: int, depth: int, bits: np.ndarray):
        self.log2_width, self.depth, self.bits = log2_width, depth, bits

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(self.depth):
            c = counter(hashes, row, self.log2_width)
            byte = self.bits[(c >> np.uint64(3)).astype(np.int64) + row * (1 << (self.log2_width - 3))]
            out &= (byte >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def repeated(docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log2_width: int, depth: int) -> tuple[Repeated, Frequent]:
    """Sketch of all hashes that ``hashes_of`` takes from the batches of ``docs``, and the weights of the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partial(log2_width, depth)
        for batch in batches:
            for h in hashes_of(batch):
                yield from part.add(h)
        yield from part.flush()
        # Whole counts are blocks with negative numbers.
        block, raw = _packed(part.counts)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - block, pa.int32()), pa.array(raw, pa.binary()), pa.array([b""] * len(raw), pa.binary())], names=["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: counts come before the sketch."""
        rest: list[pa.RecordBatch] = []

        def counts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                here = int((batch.column(0).to_numpy() < 0).sum())
                yield batch.slice(0, here).select(["block", "once"])
                if here < batch.num_rows:
                    rest.append(batch.slice(here))
                    return

        for made in _added(counts()):
            yield made.rename_columns(["block", "bits"])
        yield from _merge(itertools.chain(rest, batches))

    merged = docs.mapInArrow(run, "block int, once binary, twice binary").repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    bits, counts = np.zeros(depth << (log2_width - 3), np.uint8), np.zeros(1 << LOG2_COUNTS, np.int64)
    for block, raw in merged.toLocalIterator():
        if block < 0:
            counts[(-1 - block) * BLOCK : -block * BLOCK] = np.frombuffer(zlib.decompress(raw), "<i8")
        else:
            bits[block * _DENSE : (block + 1) * _DENSE] = np.frombuffer(zlib.decompress(raw), np.uint8)
    return Repeated(log2_width, depth, bits), Frequent.of(counts)


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(COUNT_SHIFT) & np.uint64((1 << LOG2_COUNTS) - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Blocks of counters that are not all zero, and their compressed counts."""
    parts = counts.reshape(-1, BLOCK)
    some = np.flatnonzero(parts.any(axis=1))
    return some, [zlib.compress(parts[i].astype("<u4").tobytes(), 1) for i in some.tolist()]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: the sums of each block."""
    cur, sums = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cur], pa.int32()), pa.array([zlib.compress(sums.astype("<i8").tobytes(), 1)], pa.binary())], names=["block", "counts"])

    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if block != cur:
                if cur is not None:
                    yield row()
                cur, sums = block, np.zeros(BLOCK, np.int64)
            sums += np.frombuffer(zlib.decompress(raw), "<u4")
    if cur is not None:
        yield row()


class Frequent:
    """Weights of hashes that stand out of the counters' noise."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def of(cls, counts: np.ndarray) -> Frequent:
        """A counter stands out when it is more than six deviations of an even spread above the
        mean; its weight is the logarithm of what it has above that."""
        mean = counts.mean()
        over = counts - (mean + 6 * mean**0.5 + 64)
        return cls(np.where(over > 0, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8))

    def weight(self, hashes: np.ndarray) -> np.ndarray:
        """0 for a hash that is not clearly above the mean counter, else a number that grows with its count."""
        return self.weights[_counters(hashes)]


def frequent(docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Frequent:
    """Counts of all hashes in 2**LOG2_COUNTS counters (8 MB to the driver, 1 MB of weights to the tasks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << LOG2_COUNTS, np.uint32)
        for batch in batches:
            for h in hashes_of(batch):
                counts += np.bincount(_counters(h), minlength=len(counts)).astype(np.uint32)
        block, raw = _packed(counts)
        yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(raw, pa.binary())], names=["block", "counts"])

    merged = docs.mapInArrow(run, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, counts binary")
    counts = np.zeros(1 << LOG2_COUNTS, np.int64)
    for block, raw in merged.toLocalIterator():
        counts[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zlib.decompress(raw), "<i8")
    return Frequent.of(counts)
