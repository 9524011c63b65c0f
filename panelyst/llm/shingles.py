"""Sets of hashed word shingles for batches of texts, and their circulant MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Seeds and odd multipliers of the hashes. Any odd numbers with well mixed bits do.
SEED = 20240229
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Bytes whose running sums are held at once; the last word of a block may exceed it.
BLOCK = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


class Shingler:
    """Distinct ``words``-word shingles of each text. A text with fewer words has its whole sequence as one shingle.

    Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased unless
    ``lower`` is false. A word's hash is a polynomial in
    random 64-bit values of its bytes, taken from a running sum over a block of bytes: eight bytes a value would be
    many times the batch's own size if they were held for all of it.
    """

    def __init__(self, words: int = 5, lower: bool = True):
        rng = np.random.default_rng(SEED)
        draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)
        self.words = words
        values = draw(256)
        byte = np.arange(256)
        if lower:
            byte[65:91] += 32
        self.values = values[byte]
        self.blank = np.zeros(256, bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        self.values[self.blank] = 0
        self.base = draw(1)[0]
        self.inverse = U(pow(int(self.base), -1, 1 << 64))
        self.factors = draw(words)
        self.length_factor = draw(1)[0]
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self.powers) < n:
            n += n >> 3  # blocks differ by a word's length
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def word_hashes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's words begin (one more entry at the end)."""
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(e) + 1 for e in encoded], out=first[1:])
        data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
        del encoded
        hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(data):
            end = self._block_end(data, at)
            found, begin = self._block_hashes(data[at:end])
            hashes.append(found)
            starts.append(begin + at)
            at = end
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), first)

    def _block_end(self, data: np.ndarray, at: int) -> int:
        """Where a block that begins at ``at`` ends: after a blank, so that no word is cut. The last byte is one."""
        end = at + BLOCK
        while end < len(data):
            blanks = np.flatnonzero(self.blank[data[end - 1 : end - 1 + BLOCK]])
            if len(blanks):
                return end + int(blanks[0])
            end += BLOCK
        return len(data)

    def _block_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of whole words' bytes, and where they begin."""
        self._grown(len(data) + 1)
        blank = self.blank[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.inverses[starts]), starts

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        hashes, bounds = self.word_hashes(texts)
        w = self.words
        whole = np.zeros(max(0, len(hashes) - w + 1), np.uint64)
        for j in range(w):
            whole += hashes[j : len(hashes) - w + 1 + j] * self.factors[j]
        whole = _mixed(whole)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= w:
                out.append(np.unique(whole[a : b - w + 1]))
            elif b > a:
                some = (hashes[a:b] * self.factors[: b - a]).sum(dtype=np.uint64, keepdims=True)
                out.append(_mixed(some + np.array([b - a], np.uint64) * self.length_factor))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit number that stands for a set of hashes, whatever their order."""
    total = _mixed(hashes ^ U(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True)
    return int(_mixed(total + U(1)).view(np.int64)[0])


class Circulant:
    """Circulant MinHash over 2**32 places: one permutation scatters a set, a second one ranks it.

    Coordinate k is the least rank of the scattered set after the second permutation is shifted circularly by k, so
    two permutations give any number of coordinates.
    """

    BLOCK = 512

    def __init__(self, size: int):
        self.shifts = np.arange(size, dtype=np.uint32)[:, None]
        self.buffers = np.empty((2, size, self.BLOCK), np.uint32)

    def _ranks(self, places: np.ndarray) -> np.ndarray:
        """The second permutation, shifted by each k: a bijection of 32-bit words."""
        x, y = (b[:, : len(places)] for b in self.buffers)
        np.add(places[None, :], self.shifts, out=x)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        return np.bitwise_xor(x, y, out=x)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        # The first permutation: shingle hashes are already scattered, their upper half is a random place.
        places = (hashes >> U(32)).astype(np.uint32)
        least = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(places), self.BLOCK):
            np.minimum(least, self._ranks(places[at : at + self.BLOCK]).min(axis=1), out=least)
        return least


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    x = signature[: bands * rows].astype(np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        key = _mixed(key * MIX_A + x[:, j] + U(1))
    return key
