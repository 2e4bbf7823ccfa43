"""Adjacency codecs: exact sizes as aggregates, bits in Arrow batches.

Per row of degree d over universe u (ids ascending, repeats allowed):
raw: 32-bit ids. packed: rows of the greatest degree plus one. rowef: low bits
of floor(log2(floor(u / d))), then unary high parts. rowpack: first id in
ceil(log2 u) bits, 6 bits of width, gaps of that width. rowbic: interpolative
code of x + i, middle first, each in a minimal binary code centred in its range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import bit_length, floor_log2

CODECS = ("raw", "packed", "rowef", "rowbic", "rowpack")
#: Constant bytes of the codecs' tables.
TABLE_BYTES = {"rowef": 256, "rowbic": 32_640 * 5 + 256 * 4, "rowpack": 0}


def _steps(n: int):
    """(place, place below, place above) in the order of coding; -1 and n stand for the ends."""
    todo = [(0, n, -1, n)]
    while todo:
        lo, hi, below, above = todo.pop()
        if lo < hi:
            mid = lo + (hi - lo) // 2
            yield mid, below, above
            todo += [(mid + 1, hi, mid, above), (lo, mid, below, mid)]


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits of each of an array of integers under 2**53; 0 for 0."""
    return np.frexp(np.asarray(x, float))[1].astype(np.int64)


def _coded(ids: np.ndarray, u: int, codec: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bits) in the order of writing, of rows of one degree; steps are columns."""
    n, d = ids.shape
    if codec == "rowpack":
        gaps = np.diff(ids, axis=1)
        width = bit_lengths(gaps.max(1, initial=0))[:, None]
        head, sizes = [ids[:, :1], width], [np.full((n, 1), max(0, (u - 1).bit_length())), np.full((n, 1), 6)]
        return (np.hstack([*head, gaps]), np.hstack([*sizes, np.broadcast_to(width, gaps.shape)])) if d > 1 else (head[0], sizes[0])
    if codec == "rowbic":
        y, codes, sizes = ids + np.arange(d), [], []
        for mid, below, above in _steps(d):
            low = (y[:, below] if below >= 0 else -1) + mid - below
            r = np.broadcast_to((y[:, above] if above < d else u + d - 1) - (above - mid) - low + 1, n)
            b = np.maximum(1, bit_lengths(r - 1))
            c, short = r - (1 << (b - 1)), (1 << b) - r
            t = (y[:, mid] - low - c) % r
            full = t >= short
            t = np.where(full, t + short, t)  # of a full code the last bit is written last
            codes.append(np.where(full, (t >> 1) | ((t & 1) << (b - 1)), t))
            sizes.append(np.where(full, b, b - 1))
        return np.stack(codes, 1), np.stack(sizes, 1)
    return ids, np.full(ids.shape, 32)


def _rowef_low(u: int, d: int) -> int:
    return max(0, (u // d).bit_length() - 1)


def encode_rows(ids: np.ndarray, u: int, codec: str) -> tuple[list[bytes], np.ndarray]:
    """(data, bits) of rows of one degree at once, least significant bit first."""
    n, d = ids.shape
    if d > 255:
        raise ValueError(f"degree {d} is over 255")
    if (np.diff(ids, axis=1) < 0).any():
        raise ValueError("unsorted row")
    if d and (ids.min(initial=0) < 0 or ids.max(initial=0) >= u):
        raise ValueError("id out of range")
    if not n or not d:
        return [b""] * n, np.zeros(n, np.int64)
    low = _rowef_low(u, d) if codec == "rowef" else 0
    codes, sizes = (ids & ((1 << low) - 1), np.full(ids.shape, low)) if codec == "rowef" else _coded(ids, u, codec)
    ends = np.cumsum(sizes, axis=1)
    total = ends[:, -1] + ((ids[:, -1] >> low) + d if codec == "rowef" else 0)
    out = np.zeros((n, 8 * -(-int(total.max()) // 8)), np.uint8)
    row = np.arange(n)[:, None]
    for k in range(int(sizes.max(initial=0))):
        on = (sizes > k) & ((codes >> k) & 1 == 1)
        out[np.broadcast_to(row, on.shape)[on], (ends - sizes + k)[on]] = 1
    if codec == "rowef":
        out[row, d * low + (ids >> low) + np.arange(d)] = 1
    packed = np.packbits(out, axis=1, bitorder="little")
    return [packed[i, : -(-int(t) // 8)].tobytes() for i, t in enumerate(total.tolist())], total


def decode_rows(data: list[bytes], d: int, u: int, codec: str) -> np.ndarray:
    """encode_rows() back: a matrix of a row for each of data, all of degree d."""
    n = len(data)
    if not d or not n:
        return np.empty((n, d), np.int64)
    wide = max(map(len, data)) + 8
    bits = np.unpackbits(np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in data), np.uint8).reshape(n, wide), axis=1, bitorder="little")

    def field(at, size, most: int) -> np.ndarray:
        """Numbers of `size` bits at `at`, most bits at most; both can differ by row (and column)."""
        k = np.arange(most)
        at, size = np.broadcast_arrays(np.asarray(at), np.asarray(size))
        place = np.minimum(at[..., None] + k, bits.shape[1] - 1)
        got = np.take_along_axis(bits, place.reshape(n, -1), 1).reshape(place.shape).astype(np.int64)
        return ((got * (k < size[..., None])) << k).sum(-1)

    if codec == "rowef":
        low = _rowef_low(u, d)
        lows = field(np.broadcast_to(np.arange(d) * low, (n, d)), low, low) if low else np.zeros((n, d), np.int64)
        high = np.nonzero(bits[:, d * low :])[1].reshape(n, d) - np.arange(d)
        return (high << low) | lows
    if codec == "rowpack":
        first = max(0, (u - 1).bit_length())
        out = np.zeros((n, d), np.int64)
        out[:, 0] = field(np.zeros(n, np.int64), first, first) if first else 0
        if d > 1:
            width = field(np.full(n, first), 6, 6)
            out[:, 1:] = field(first + 6 + np.arange(d - 1) * width[:, None], width[:, None], int(width.max(initial=0)))
        return np.cumsum(out, axis=1)
    if codec == "rowbic":
        y, at = np.zeros((n, d), np.int64), np.zeros(n, np.int64)
        for mid, below, above in _steps(d):
            low = (y[:, below] if below >= 0 else -1) + mid - below
            r = (y[:, above] if above < d else u + d - 1) - (above - mid) - low + 1
            b = np.maximum(1, bit_lengths(np.broadcast_to(r, n) - 1))
            c, short = r - (1 << (b - 1)), (1 << b) - r
            t = field(at, b - 1, int(b.max()))
            full = t >= short
            t = np.where(full, 2 * t + field(at + b - 1, 1, 1) - short, t)
            at += np.where(full, b, b - 1)
            y[:, mid] = low + (t + c) % r
        return y - np.arange(d)
    return field(np.broadcast_to(np.arange(d) * 32, (n, d)), 32, 32)


def _by_degree(degrees: np.ndarray):
    """(degree, places) of each degree there is."""
    order = np.argsort(degrees, kind="stable")
    cuts = np.flatnonzero(np.diff(degrees[order])) + 1
    return [(int(degrees[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def _rows(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x.dst).alias("ids"))


def encode(edges: DataFrame, universe: int, codec: str) -> DataFrame:
    """(src, deg, data, bits) of every row that has edges; rows of one degree are coded at once."""

    @F.pandas_udf("data binary, bits long")
    def run(ids: pd.Series) -> pd.DataFrame:
        data, bits = np.empty(len(ids), object), np.zeros(len(ids), np.int64)
        for _, at in _by_degree(ids.map(len).to_numpy()) if len(ids) else ():
            data[at], bits[at] = encode_rows(np.stack(ids.iloc[at].to_numpy()).astype(np.int64), universe, codec)
        return pd.DataFrame({"data": data, "bits": bits})

    return _rows(edges).withColumn("x", run("ids")).select("src", F.size("ids").alias("deg"), "x.data", "x.bits")


def decoded(data, deg, universe: int, codec: str):
    """A column of the ids of encode()'s rows."""

    @F.pandas_udf("array<long>")
    def run(data: pd.Series, deg: pd.Series) -> pd.Series:
        out = np.empty(len(data), object)
        for d, at in _by_degree(deg.to_numpy()) if len(data) else ():
            for i, row in zip(at.tolist(), decode_rows([bytes(x) for x in data.iloc[at]], d, universe, codec)):
                out[i] = row
        return pd.Series(out)

    return run(data, deg)


def decode(encoded: DataFrame, universe: int, codec: str) -> DataFrame:
    """Edges (src, pos, dst) of encode()'s rows."""
    return encoded.select("src", F.posexplode(decoded("data", "deg", universe, codec)).alias("pos", "dst")).withColumn("pos", F.col("pos").cast("long"))


def roundtrip_mismatches(edges: DataFrame, universe: int, codec: str) -> DataFrame:
    """One row: edges that differ after encoding and decoding."""
    e, d = edges.select("src", "pos", "dst"), decode(encode(edges, universe, codec), universe, codec).select("src", "pos", "dst")
    return e.exceptAll(d).union(d.exceptAll(e)).agg(F.count("*").alias("mismatches"))


def payload_bits(edges: DataFrame, universe: int, codec: str) -> DataFrame:
    """(src, deg, bits): each row's payload; only rowbic runs Python, as its steps depend on the row."""
    if codec == "rowbic":
        @F.pandas_udf(LongType())
        def run(ids: pd.Series) -> pd.Series:
            bits = np.zeros(len(ids), np.int64)
            for _, at in _by_degree(ids.map(len).to_numpy()) if len(ids) else ():
                bits[at] = _coded(np.stack(ids.iloc[at].to_numpy()).astype(np.int64), universe, codec)[1].sum(1)
            return pd.Series(bits)

        return _rows(edges).select("src", F.size("ids").cast("long").alias("deg"), run("ids").alias("bits"))
    row = edges.groupBy("src").agg(F.count("*").alias("deg"), F.max("dst").alias("top"))
    if codec == "rowef":
        low = F.coalesce(floor_log2(F.floor(F.lit(universe) / F.col("deg"))), F.lit(0).cast("long"))
        return row.select("src", "deg", (F.col("deg") * low + F.expr("0") + F.floor(F.col("top") / F.pow(F.lit(2.0), low)) + F.col("deg")).cast("long").alias("bits"))
    if codec == "rowpack":
        from .graph import row_gaps

        wide = row_gaps(edges).groupBy("src").agg(F.max("gap").alias("gap"))
        first = max(0, (universe - 1).bit_length())
        bits = F.lit(first) + F.when(F.col("deg") >= 2, 6 + (F.col("deg") - 1) * bit_length(F.coalesce("gap", F.lit(0)))).otherwise(0)
        return row.join(wide, "src", "left").select("src", "deg", bits.cast("long").alias("bits"))
    return row.select("src", "deg", (32 * F.col("deg")).alias("bits"))


def store_size(edges: DataFrame, n: int, codec: str, universe: int | None = None) -> DataFrame:
    """(codec, nodes, edges, payload_bits, total_bytes, bits_per_edge) of a whole store; bits_per_edge is 0 without edges."""
    s = payload_bits(edges, universe or n, codec).agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("payload_bits"), F.coalesce(F.sum("deg"), F.lit(0)).alias("edges"), F.coalesce(F.max("deg"), F.lit(0)).alias("most"))
    if codec == "raw":
        total = 8 * (F.lit(n) + 1) + 4 * F.col("edges")
    elif codec == "packed":
        total = 4 * F.lit(n) * (F.col("most") + 1)
    else:
        total = 8 * (F.ceil(F.col("payload_bits") / 64) + 2) + 5 * F.lit(n) + 8 + TABLE_BYTES[codec]
    s = s.withColumn("total_bytes", total.cast("long"))
    return s.select(F.lit(codec).alias("codec"), F.lit(n).cast("long").alias("nodes"), "edges", "payload_bits", "total_bytes", F.when(F.col("edges") > 0, 8 * F.col("total_bytes") / F.col("edges")).otherwise(0.0).alias("bits_per_edge"))


def payload_limits(edges: DataFrame, universe: int, limit_bits: int = 1 << 32) -> DataFrame:
    """(codec, payload_bits, refused): a row's place is a 32-bit number of bits, so larger payloads are refused."""
    out = None
    for codec in ("rowef", "rowbic", "rowpack"):
        row = payload_bits(edges, universe, codec).agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("payload_bits"))
        row = row.select(F.lit(codec).alias("codec"), "payload_bits", (F.col("payload_bits") >= limit_bits).alias("refused"))
        out = row if out is None else out.union(row)
    return out


def two_tier_size(edges: DataFrame, hot: DataFrame, n: int, slot_map: bool = False) -> DataFrame:
    """(hot_nodes, hot_edges, cold_bits, total_bytes): hot rows (id) raw, the others rowef over the whole graph's ids."""
    marked = edges.join(hot.select(F.col("id").alias("src"), F.lit(1).alias("h")), "src", "left")
    h = hot.agg(F.count("*").alias("hot_nodes"))
    cold = payload_bits(marked.where("h is null"), n, "rowef").agg(F.coalesce(F.sum("bits"), F.lit(0)).alias("cold_bits"))
    hot_edges = marked.where("h = 1").agg(F.count("*").alias("hot_edges"))
    rows = h.join(cold).join(hot_edges)
    cold_bytes = 8 * (F.ceil(F.col("cold_bits") / 64) + 2) + 5 * (F.lit(n) - F.col("hot_nodes")) + 8 + TABLE_BYTES["rowef"]
    total = 4 * (F.col("hot_nodes") + 1) + 4 * F.col("hot_edges") + cold_bytes + (4 * n if slot_map else 0)
    return rows.select("hot_nodes", "hot_edges", "cold_bits", total.cast("long").alias("total_bytes"))


def elias_fano_bits(edges: DataFrame, n: int, partition: int = 32_000) -> DataFrame:
    """A size model of partitioned global Elias-Fano neighbours (not a byte-exact encoder of any library): bits in all."""
    from .graph import csr_offsets

    at = edges.join(csr_offsets(edges, n).withColumnRenamed("id", "src"), "src").select(F.floor((F.col("off") + F.col("pos")) / partition).alias("part"), (F.col("src") * n + F.col("dst")).alias("x"))
    part = at.groupBy("part").agg(F.count("*").alias("m"), (F.max("x") - F.min("x") + 1).alias("u"))
    low = F.coalesce(floor_log2(F.floor(F.col("u") / F.col("m"))), F.lit(0).cast("long"))
    return part.agg(F.sum(F.col("m") * (low + 2)).alias("bits"))
