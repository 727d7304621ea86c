"""Wavelet matrix of a token sequence, in one compressed file image.

The sequence is stored as bit-planes from the highest bit down. At each plane
the tokens whose bit is 0 come before those whose bit is 1, in stable order, so
rank on the planes leads from a position to its token (access), from a token to
the number of its occurrences in a range (count), and select leads back from
the k-th occurrence to its position (locate).

Image: magic, number of bits, length, zeros per plane, then per plane the
number of ones before each block and the block's place, then the blocks. A
block is 65,536 bits, compressed on its own: a query reads the blocks it needs.
An opened block has the number of ones before each of its 64-bit words, so rank
is one look-up and one population count, and select one search and one word.

The ``_many`` forms answer whole arrays of queries plane by plane.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"WVM2"
BLOCK_BITS = 1 << 16
_WORDS = BLOCK_BITS // 64
_HEAD = struct.Struct("<4sBQ")
#: Blocks that stay open.
_OPEN = 256


def _zstd():
    import zstandard

    return zstandard


def build(tokens: np.ndarray, bits: int) -> bytes:
    """File image of a sequence of numbers below 2**bits."""
    n = len(tokens)
    pack = _zstd().ZstdCompressor(level=1)
    zeros, ones_before, sizes, blocks = [], [], [], []
    cur = np.ascontiguousarray(tokens)
    full = np.zeros(-(-n // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
    for b in range(bits - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << b)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        full[: len(packed)] = packed
        counts = np.bitwise_count(full.view(np.uint64)).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
        ones_before.append(np.r_[0, np.cumsum(counts)].astype("<u8"))
        for h in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[h : h + BLOCK_BITS // 8].tobytes()
            small = pack.compress(raw)
            blocks.append(small if len(small) < len(raw) else raw)
            sizes.append(len(blocks[-1]))
        zeros.append(n - int(counts.sum()))
        if b:
            cur = np.concatenate([cur.compress(~bit), cur.compress(bit)])  # no branch on the bits, unlike cur[bit]
    places = np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype("<u8")
    return b"".join([_HEAD.pack(MAGIC, bits, n), np.array(zeros, "<u8").tobytes(), *(x.tobytes() for x in ones_before), places.tobytes(), *blocks])


class Wavelet:
    """Reads a file image."""

    def __init__(self, image: bytes):
        magic, self.bits, self.n = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix image")
        at, self.per_plane = _HEAD.size, -(-self.n // BLOCK_BITS)

        def take(k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, "<u8", k, at).astype(np.int64)
            at += 8 * k
            return out

        self.zeros = take(self.bits)
        self.ones_before = take(self.bits * (self.per_plane + 1)).reshape(self.bits, self.per_plane + 1)
        self.places = take(self.bits * self.per_plane + 1)
        self.image, self.start = image, at
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._unpack = _zstd().ZstdDecompressor()

    def _raw(self, plane: int, k: int) -> bytes:
        key = plane * self.per_plane + k
        raw = self.image[self.start + self.places[key] : self.start + self.places[key + 1]]
        n = -(-min(BLOCK_BITS, self.n - k * BLOCK_BITS) // 8)
        return self._unpack.decompress(raw, max_output_size=n) if len(raw) < n else raw

    def _block(self, plane: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of one block, and the ones before each word."""
        key = plane * self.per_plane + k
        got = self._opened.get(key)
        if got is None:
            words = np.zeros(_WORDS, np.uint64)
            raw = self._raw(plane, k)
            words.view(np.uint8)[: len(raw)] = np.frombuffer(raw, np.uint8)
            got = words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            if len(self._opened) >= _OPEN:
                self._opened.clear()
            self._opened[key] = got
        return got

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        if not rest:
            return int(self.ones_before[plane, k])
        words, before = self._block(plane, k)
        w, b = divmod(rest, 64)
        return int(self.ones_before[plane, k]) + int(before[w]) + ((int(words[w]) & ((1 << b) - 1)).bit_count() if b else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        ones = self.ones_before[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        at = int(np.searchsorted(before, k, "right")) - 1
        words, inside = self._block(plane, at)
        k -= int(before[at])
        inside = inside if bit else 64 * np.arange(len(inside)) - inside
        w = int(np.searchsorted(inside, k, "right")) - 1
        word = int(words[w]) if bit else ~int(words[w]) & ((1 << 64) - 1)
        for _ in range(k - int(inside[w])):
            word &= word - 1
        return at * BLOCK_BITS + 64 * w + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            k, rest = divmod(i, BLOCK_BITS)
            one = int(self._block(p, k)[0][rest // 64]) >> (rest % 64) & 1
            token = token << 1 | one
            i = int(self.zeros[p]) + self._rank1(p, i) if one else i - self._rank1(p, i)
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            if token >> (self.bits - 1 - p) & 1:
                lo, hi = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in positions lo to hi (end exclusive)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def _directory(self, plane: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a whole plane (one more than is full) and the ones before each; kept for the next query."""
        got = self._planes.get(plane)
        if got is None:
            words = np.zeros(self.n // 64 + 1, np.uint64)
            raw = b"".join(self._raw(plane, k) for k in range(self.per_plane))
            words.view(np.uint8)[: len(raw)] = np.frombuffer(raw, np.uint8)
            ones = np.bitwise_count(words)
            got = self._planes[plane] = words, np.cumsum(ones, dtype=np.int64) - ones
        return got

    def _bits(self, plane: int) -> np.ndarray:
        return np.unpackbits(self._directory(plane)[0].view(np.uint8), count=self.n, bitorder="little").view(bool)

    def _ranks(self, plane: int):
        """Words of a whole plane and a function that ranks positions."""
        words, before = self._directory(plane)

        def rank1(i: np.ndarray) -> np.ndarray:
            w = i >> 6
            return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

        return words, rank1

    def access_many(self, i: np.ndarray) -> np.ndarray:
        """The tokens at positions i."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.int64)
        for p in range(self.bits):
            words, rank1 = self._ranks(p)
            one = (words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out = out << 1 | one
            r = rank1(i)
            i = np.where(one, self.zeros[p] + r, i - r)
        return out

    def count_many(self, token: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Occurrences of a token in each range lo[i] to hi[i]."""
        both = np.concatenate([np.asarray(lo, np.int64), np.asarray(hi, np.int64)])
        for p in range(self.bits):
            r = self._ranks(p)[1](both)
            both = self.zeros[p] + r if token >> (self.bits - 1 - p) & 1 else both - r
        return both[len(lo) :] - both[: len(lo)]

    def locate_many(self, token: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k[i]-th occurrences of a token, which must exist."""
        i = self._range(token, 0, self.n)[0] + np.asarray(k, np.int64)
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            words, before = self._directory(p)
            if bit:
                i = i - self.zeros[p]
            else:
                before = 64 * np.arange(len(before)) - before
            w = np.searchsorted(before, i, "right") - 1
            found = np.unpackbits(words[w].view(np.uint8), bitorder="little").reshape(-1, 64) == bit
            i = 64 * w + np.argmax(np.cumsum(found, axis=1) == (i - before[w] + 1)[:, None], axis=1)
        return i

    def tokens(self, dtype=np.uint16) -> np.ndarray:
        """The whole sequence, from the lowest plane up: one pass over each plane."""
        out = np.zeros(self.n, dtype)
        for p in range(self.bits - 1, -1, -1):
            bit = self._bits(p)
            z = int(self.zeros[p])
            up = np.empty_like(out)
            ones = out[z:] | dtype(1 << (self.bits - 1 - p))
            # A mask is quick where bits come in runs, places where they alternate.
            runs = 4 * np.count_nonzero(bit[1:] != bit[:-1]) < self.n
            up[~bit if runs else np.flatnonzero(~bit)] = out[:z]
            up[bit if runs else np.flatnonzero(bit)] = ones
            out = up
        return out
