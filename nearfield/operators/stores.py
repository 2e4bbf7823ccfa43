"""Adjacency stores: what a search reads rows from, each with its size in bytes.

A store is made from edges by Spark (rows coded in Arrow batches), then held as
a few flat arrays that go to every worker; its size is checked before that.
rows(ids) gives the neighbours of many nodes at once, as a matrix padded
with -1. Sizes are those of codecs.store_size.
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import TABLE_BYTES, _by_degree, decode_rows, encode

#: A store, with the vectors searched over, goes to every worker up to so many bytes; beyond that searches are joins.
BROADCAST_BYTES = 64 << 20
NAMES = ("raw", "packed", "ef", "rowef", "rowbic", "rowpack", "tiers", "slot_map", "tiers_ef")


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts), default=0)), -1, np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


class Raw:
    """Offsets of 64 bits (32 in a hot tier) and ids of 32."""

    def __init__(self, degrees: np.ndarray, ids: np.ndarray, wide: int = 8):
        self.offsets, self.ids, self.wide = np.concatenate(([0], np.cumsum(degrees))), ids.astype(np.uint32), wide

    def bytes(self) -> int:
        return self.wide * len(self.offsets) + 4 * len(self.ids)

    def rows(self, at: np.ndarray) -> np.ndarray:
        first, size = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        k = np.arange(size.max(initial=0))
        on = k < size[:, None]
        place = np.where(on, first[:, None] + k, 0)
        return np.where(on, self.ids[place].astype(np.int64), -1) if len(self.ids) else np.full(on.shape, -1)


class Packed:
    """Rows of one length: degree, ids, zeros."""

    def __init__(self, degrees: np.ndarray, ids: np.ndarray):
        most = int(degrees.max(initial=0))
        self.table = np.zeros((len(degrees), most + 1), np.uint32)
        self.table[:, 0] = degrees
        self.table[:, 1:][np.arange(most) < degrees[:, None]] = ids

    def bytes(self) -> int:
        return self.table.nbytes

    def rows(self, at: np.ndarray) -> np.ndarray:
        got = self.table[at].astype(np.int64)
        return np.where(np.arange(got.shape[1] - 1) < got[:, :1], got[:, 1:], -1)


class Rows:
    """One bit string of all rows, least significant bit first, with a place of 32 bits and a degree of 8 for each."""

    def __init__(self, codec: str, universe: int, degrees: np.ndarray, bits: np.ndarray, data: np.ndarray):
        total = int(bits.sum())
        if total >= 1 << 32:
            raise ValueError(f"a payload of {total} bits is over 32-bit places")
        self.codec, self.universe, self.degrees = codec, universe, degrees.astype(np.uint8)
        self.place = (np.cumsum(bits) - bits).astype(np.uint32)
        self.size = bits
        sizes = -(-bits // 8)
        flat = np.unpackbits(np.frombuffer(b"".join(data), np.uint8), bitorder="little")
        inside = np.arange(len(flat)) - np.repeat(8 * (np.cumsum(sizes) - sizes), 8 * sizes) < np.repeat(bits, 8 * sizes)
        self.words = np.packbits(np.concatenate((flat[inside], np.zeros(64 * (-(-total // 64) + 2) - total, np.uint8))), bitorder="little")

    def bytes(self) -> int:
        return len(self.words) + 5 * len(self.degrees) + 8 + TABLE_BYTES[self.codec]

    def rows(self, at: np.ndarray) -> np.ndarray:
        out = np.full((len(at), int(self.degrees[at].max(initial=0))), -1, np.int64)
        for d, some in _by_degree(self.degrees[at]) if len(at) else ():
            if d:
                out[some, :d] = decode_rows([self._one(u) for u in at[some].tolist()], d, self.universe, self.codec)
        return out

    def _one(self, u: int) -> bytes:
        p, n = int(self.place[u]), int(self.size[u])
        raw = int.from_bytes(self.words[p >> 3 : (p + n + 7 >> 3)].tobytes(), "little") >> (p & 7)
        return (raw & ((1 << n) - 1)).to_bytes(-(-n // 8), "little")


class EliasFano:
    """Ascending numbers in parts of `partition`: low bits as they are, high bits as places in a bit string."""

    def __init__(self, values: np.ndarray, partition: int = 32_000):
        self.partition, self.n, self.parts = partition, len(values), []
        for s in range(0, len(values), partition):
            own = values[s : s + partition]
            base, u = int(own[0]), int(own[-1] - own[0]) + 1
            low = max(0, (u // len(own)).bit_length() - 1)
            x = own - base
            high = np.zeros(int(x[-1] >> low) + len(own), np.uint8)
            high[(x >> low) + np.arange(len(own))] = 1
            lows = ((x[:, None] >> np.arange(low)) & 1).astype(np.uint8)
            self.parts.append((base, low, np.packbits(lows.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), len(own)))
        self._open: dict[int, np.ndarray] = {}

    def bytes(self) -> int:
        """Payload and 16 bytes for each part (base, width, count)."""
        return sum(len(lows) + len(high) + 16 for _, _, lows, high, _ in self.parts)

    def bits(self) -> int:
        return sum(low * n + int(np.unpackbits(high, bitorder="little").nonzero()[0][-1]) + 1 for _, low, _, high, n in self.parts)

    def part(self, k: int) -> np.ndarray:
        """The numbers of one part; the last few parts that were read are kept."""
        if k not in self._open:
            if len(self._open) >= 64:
                self._open.clear()
            base, low, lows, high, n = self.parts[k]
            x = (np.unpackbits(high, bitorder="little").nonzero()[0][:n] - np.arange(n)) << low
            if low:
                x |= (np.unpackbits(lows, count=n * low, bitorder="little").reshape(n, low).astype(np.int64) << np.arange(low)).sum(1)
            self._open[k] = x + base
        return self._open[k]

    def get(self, start: int, count: int) -> np.ndarray:
        out, at = [], start
        while at < start + count:
            k, first = divmod(at, self.partition)
            own = self.part(k)[first : first + start + count - at]
            out.append(own)
            at += len(own)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}


class EliasFanoGraph:
    """All edges as ascending numbers source * universe + target in an EliasFano; offsets as 32-bit numbers or in another."""

    def __init__(self, degrees: np.ndarray, ids: np.ndarray, universe: int, partition: int = 32_000, offsets: str = "raw32"):
        ends = np.concatenate(([0], np.cumsum(degrees)))
        self.universe = universe
        self.edges = EliasFano(np.repeat(np.arange(len(degrees)), degrees) * universe + ids, partition)
        self.offsets = ends.astype(np.uint32) if offsets == "raw32" else EliasFano(ends, partition)

    def parts(self) -> dict[str, int]:
        return {"offsets": 4 * len(self.offsets) if isinstance(self.offsets, np.ndarray) else self.offsets.bytes(), "neighbors": self.edges.bytes()}

    def bytes(self) -> int:
        return sum(self.parts().values())

    def rows(self, at: np.ndarray) -> np.ndarray:
        out = []
        for u in at.tolist():
            first, last = self.offsets[u : u + 2].tolist() if isinstance(self.offsets, np.ndarray) else self.offsets.get(u, 2).tolist()
            out.append(self.edges.get(first, last - first) - u * self.universe)
        return _padded(out)


class Tiers:
    """Hot rows raw, the others in a cold store: the first ids are hot, or those that a slot map names."""

    def __init__(self, hot: np.ndarray, n: int, raw: Raw, cold, slot_map: bool):
        self.raw, self.cold, self.slot_map, self.h, self.n = raw, cold, slot_map, len(hot), n
        slots = np.full(n, -1, np.int64)
        slots[hot] = np.arange(len(hot))
        slots[slots < 0] = len(hot) + np.arange(n - len(hot))  # cold rows keep their order
        self.slots = slots if slot_map else None

    def bytes(self) -> int:
        return self.raw.bytes() + self.cold.bytes() + (4 * self.n if self.slot_map else 0)

    def rows(self, at: np.ndarray) -> np.ndarray:
        slot = at if self.slots is None else self.slots[at]
        hot, cold = self.raw.rows(slot[slot < self.h]), self.cold.rows(slot[slot >= self.h] - self.h)
        out = np.full((len(at), max(hot.shape[1], cold.shape[1])), -1, np.int64)
        out[slot < self.h, : hot.shape[1]] = hot
        out[slot >= self.h, : cold.shape[1]] = cold
        return out


def flat(edges: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(degrees, ids) of nodes 0 to n - 1, rows in their order."""
    got = edges.select("src", "pos", "dst").toArrow().sort_by([("src", "ascending"), ("pos", "ascending")])
    src, dst = (got.column(c).to_numpy() for c in ("src", "dst"))
    return np.bincount(src, minlength=n), dst


def edges_bytes(edges: DataFrame, n: int) -> int:
    return 8 * (n + 1) + 4 * edges.count()


def build(edges: DataFrame, n: int, name: str = "raw", hot: DataFrame | None = None, partition: int = 32_000, offsets: str = "raw32"):
    """The named store of edges (src, pos, dst) over nodes 0 to n - 1, rows ascending; tiers need hot (id).

    tiers: the hot ids must be 0 to h - 1; slot_map: any. Their cold rows are
    rowef over the whole graph's ids, those of tiers_ef an EliasFanoGraph.
    """
    if (size := edges_bytes(edges, n)) > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of edges are over {BROADCAST_BYTES}: search by joins")
    if name in ("rowef", "rowbic", "rowpack"):
        return _coded(edges, n, name, np.arange(n))
    if name in ("tiers", "slot_map", "tiers_ef"):
        ids = np.sort(hot.select(F.col("id").cast("long")).toArrow().column(0).to_numpy())
        if name == "tiers" and len(ids) and ids[-1] != len(ids) - 1:
            raise ValueError("hot ids aren't the first ones: relabel, or take slot_map")
        degrees, row_ids = flat(edges, n)
        is_hot = np.zeros(n, bool)
        is_hot[ids] = True
        of_hot = np.repeat(is_hot, degrees)
        cold = _coded(edges.join(hot.select(F.col("id").alias("src")), "src", "left_anti"), n, "rowef", np.flatnonzero(~is_hot)) if name != "tiers_ef" else EliasFanoGraph(degrees[~is_hot], row_ids[~of_hot], n, partition, offsets)
        return Tiers(ids, n, Raw(degrees[is_hot], row_ids[of_hot], 4), cold, name == "slot_map" or (len(ids) > 0 and ids[-1] != len(ids) - 1))
    degrees, row_ids = flat(edges, n)
    return Raw(degrees, row_ids) if name == "raw" else Packed(degrees, row_ids) if name == "packed" else EliasFanoGraph(degrees, row_ids, n, partition, offsets)


def _coded(edges: DataFrame, n: int, codec: str, kept: np.ndarray) -> Rows:
    """Rows of the kept nodes, coded by Spark."""
    got = encode(edges, n, codec).select("src", "deg", "bits", "data").toArrow().sort_by("src")
    at = np.searchsorted(kept, got.column("src").to_numpy())
    degrees, bits, data = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64), np.full(len(kept), b"", object)
    degrees[at], bits[at] = got.column("deg").to_numpy(), got.column("bits").to_numpy()
    data[at] = np.array([*got.column("data").to_pylist(), None], object)[:-1]
    return Rows(codec, n, degrees, bits, data)


def edges_of(store, n: int, some: int = 1 << 14) -> list[tuple[int, int, int]]:
    """(src, pos, dst) of all rows, for checks of a round trip."""
    return [row for part in _parts(store, n, some) for row in zip(*(c.tolist() for c in part))]


def _parts(store, n: int, some: int):
    """(src, pos, dst) of `some` rows at a time, as arrays."""
    for s in range(0, n, some):
        got = store.rows(np.arange(s, min(n, s + some)))
        src, pos = np.nonzero(got >= 0)
        yield s + src, pos, got[src, pos]


def mismatches(store, edges: tuple[np.ndarray, np.ndarray], n: int, some: int = 1 << 14) -> int:
    """Edges that a store doesn't give back and those that it gives without there being any; edges: (degrees, ids) as flat() has them."""
    ends, wrong = np.concatenate(([0], np.cumsum(edges[0]))), 0
    for k, (src, pos, dst) in enumerate(_parts(store, n, some)):
        s, last = k * some, min(n, (k + 1) * some)
        size = edges[0][s:last]
        own = np.arange(ends[s], ends[last])
        place = np.searchsorted(ends, own, "right") - 1
        wide = int(max(size.max(initial=0), pos.max(initial=-1) + 1))
        want, have = (np.full((last - s, wide), -1, np.int64) for _ in range(2))
        want[place - s, own - ends[place]] = edges[1][own]
        have[src - s, pos] = dst
        wrong += int(((want != have) * ((want >= 0).astype(int) + (have >= 0))).sum())
    return wrong


def time_rows(store, n: int, reads: int = 2_000_000, repeats: int = 3, seed: int = 42, within: int | None = None, some: int = 4096) -> dict:
    """(rows, ids, ns): random rows read and decoded, and nanoseconds a row in the best of some repeats; within: only the first so many nodes, a working set that caches hold."""
    at, best, ids = np.random.default_rng(seed).integers(0, min(n, within or n), reads), float("inf"), 0
    for _ in range(repeats):
        began, ids = time.perf_counter(), 0
        for k in range(0, reads, some):
            ids += int((store.rows(at[k : k + some]) >= 0).sum())
        best = min(best, time.perf_counter() - began)
    return {"rows": reads, "ids": ids, "ns": best / max(1, reads) * 1e9}
