"""Elias-Fano sequences as flat arrays: built once, memory-mapped, queried many places at a time."""

from __future__ import annotations

import mmap

import numpy as np

U = np.uint64
SAMPLE, BLOCK = 64, 512
#: Queries at a time: what a step makes stays in a CPU's own cache.
CHUNK = 4096
#: Place of the r-th one in a byte, at 8 * byte + r.
IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)]).ravel()


class EliasFano:
    """A non-decreasing sequence of n values below universe in about 2 + log2(universe / n) bits each."""

    FIELDS = ("head", "low", "high", "zeros", "ones", "ranks")

    def __init__(self, head, low, high, zeros, ones, ranks):
        self.head, self.low, self.high, self.zeros, self.ones, self.ranks = head, low, high, zeros, ones, ranks
        self.n, self.l = int(head[0]), int(head[1])

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        l = max(0, (int(universe) // max(1, n)).bit_length() - 1)
        top = (values >> U(l)).astype(np.int64) if l < 64 else np.zeros(n, np.int64)
        bits = np.zeros(-(-(n + (int(universe) >> l) + 66) // BLOCK) * BLOCK, bool)
        bits[top + np.arange(n)] = True
        groups = np.zeros((-(-n // 64) or 1, 64), U)
        groups.ravel()[:n] = values & U((1 << l) - 1)
        low = np.zeros((len(groups), l), U)
        for j in range(64) if l else ():
            w, off = j * l >> 6, j * l & 63
            low[:, w] |= groups[:, j] << U(off)
            if off + l > 64:
                low[:, w + 1] |= groups[:, j] >> U(64 - off)
        places = [np.flatnonzero(bits == bit)[::SAMPLE].astype(U) for bit in (False, True)]
        last = np.full(1, len(bits) - 1, U)
        return cls(
            np.array([n, l], U),
            np.append(low.ravel(), np.zeros(2, U)),
            np.packbits(bits, bitorder="little").view(U),
            *(np.concatenate((p, last)) for p in places),
            np.concatenate(([0], np.cumsum(bits.reshape(-1, BLOCK).sum(1)))).astype(U),
        )

    def _select(self, k: np.ndarray, samples: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Places of the bits number k that are one (flip 0) or zero (flip all ones)."""
        near = k // SAMPLE
        at = samples[near].astype(np.int64)
        rest = k % SAMPLE
        lo, hi = at // BLOCK, samples[near + 1].astype(np.int64) // BLOCK
        far = np.flatnonzero(lo < hi)
        if len(far):  # the block by the number of such bits before it
            x, y, want = lo[far], hi[far], k[far]
            while (x < y).any():
                mid = (x + y + 1) >> 1
                before = self.ranks[mid].astype(np.int64)
                if flip:
                    before = mid * BLOCK - before
                fits = before <= want
                x, y = np.where(fits, mid, x), np.where(fits, y, mid - 1)
            moved = x > lo[far]
            far, x = far[moved], x[moved]
            before = self.ranks[x].astype(np.int64)
            at[far], rest[far] = x * BLOCK, k[far] - ((x * BLOCK - before) if flip else before)
        word = at >> 6
        x = (self.high[word] ^ flip) & (~U(0) << (at & 63).astype(U))
        count = np.bitwise_count(x).astype(np.int64)
        go = np.flatnonzero(rest >= count)
        while len(go):
            rest[go] -= count[go]
            word[go] += 1
            x[go] = self.high[word[go]] ^ flip
            count[go] = np.bitwise_count(x[go])
            go = go[rest[go] >= count[go]]
        # within the word: sums of bits up to each byte, the byte, then a table
        s = x - ((x >> U(1)) & U(0x5555555555555555))
        s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
        s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * U(0x0101010101010101)
        r = rest.astype(U)
        byte = np.bitwise_count(((r * U(0x0101010101010101) | U(0x8080808080808080)) - s) & U(0x8080808080808080)).astype(U) << U(3)
        r -= ((s << U(8)) >> byte) & U(255)
        return (word << 6) + byte.astype(np.int64) + IN_BYTE[(((x >> byte) & U(255)) << U(3)) | r]

    def _next_zero(self, at: np.ndarray) -> np.ndarray:
        """Places of the first zero bit at or after each place."""
        word = at >> 6
        x = ~self.high[word] & (~U(0) << (at & 63).astype(U))
        go = np.flatnonzero(x == 0)
        steps = 0
        while len(go) and steps < 8:
            word[go] += 1
            x[go] = ~self.high[word[go]]
            go = go[x[go] == 0]
            steps += 1
        if len(go):  # a long run of ones: its end by number
            block = word[go] * 64 // BLOCK
            zeros = block * BLOCK - self.ranks[block].astype(np.int64)
            inner = word[go] - block * (BLOCK // 64)
            for j in range(BLOCK // 64):
                zeros += np.where(j <= inner, 64 - np.bitwise_count(self.high[block * (BLOCK // 64) + j]).astype(np.int64), 0)
            found = self._select(zeros, self.zeros, ~U(0))
            word[go], x[go] = found >> 6, U(1) << (found & 63).astype(U)
        return (word << 6) + np.bitwise_count((x & (~x + U(1))) - U(1))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        at = i * self.l
        w, off = at >> 6, (at & 63).astype(U)
        x = self.low[w] >> off
        over = (off > U(64 - self.l)) & (off > U(0))
        x[over] |= self.low[w[over] + 1] << (U(64) - off[over])
        return x & U((1 << self.l) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if len(i) > CHUNK:
            return np.concatenate([self[i[k : k + CHUNK]] for k in range(0, len(i), CHUNK)])
        top = self._select(i.copy(), self.ones, U(0)) - i
        return (top.astype(U) << U(self.l)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it is x); x sorted or not, below the universe."""
        if len(x) > CHUNK:
            return tuple(np.concatenate(p) for p in zip(*(self.successor(x[k : k + CHUNK]) for k in range(0, len(x), CHUNK))))
        x = x.astype(U)
        top, want = (x >> U(self.l)).astype(np.int64), x & U((1 << self.l) - 1)
        lo = np.zeros(len(x), np.int64)
        some = np.flatnonzero(top > 0)
        lo[some] = self._select(top[some] - 1, self.zeros, ~U(0)) + 1 - top[some]
        hi = self._next_zero(lo + top) - top
        end = hi.copy()
        on = np.flatnonzero(lo < hi)
        while len(on):
            mid = (lo[on] + hi[on]) >> 1
            less = self._low(mid) < want[on]
            lo[on[less]] = mid[less] + 1
            hi[on[~less]] = mid[~less]
            on = on[lo[on] < hi[on]]
        found = lo < end
        found[found] = self._low(lo[found]) == want[found]
        return lo, found


def write(path: str, sequences: list[EliasFano], *arrays: np.ndarray) -> None:
    """One file: a table of sizes, then every array, 8-byte aligned."""
    flat = [a for s in sequences for a in (getattr(s, f) for f in EliasFano.FIELDS)] + list(arrays)
    with open(path, "wb") as out:
        out.write(np.array([len(sequences), len(flat), *(a.nbytes for a in flat)], "<i8").tobytes())
        for a in flat:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))


def read(path: str, *kinds: str) -> tuple[list[EliasFano], list[np.ndarray]]:
    """What write() wrote, memory-mapped; kinds: of the arrays after the sequences."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n, total = np.frombuffer(data, "<i8", 2)
    sizes = np.frombuffer(data, "<i8", total, 16)
    at, flat = 16 + 8 * int(total), []
    for k, size in enumerate(sizes.tolist()):
        kind = "<u8" if k < 6 * n else kinds[k - 6 * n]
        flat.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size + -size % 8
    return [EliasFano(*flat[6 * k : 6 * k + 6]) for k in range(int(n))], flat[6 * int(n) :]
