"""Column functions on vectors and sorted id lists; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences of two double arrays."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def negated_ip(a: Column | str, b: Column | str) -> Column:
    """Minus the inner product: smaller is better."""
    return -F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str):
    """'ip' or else squared L2."""
    return negated_ip if metric == "ip" else squared_l2


def normalized(v: Column | str) -> Column:
    """v over its length, 1e-12 at least."""
    v = _col(v)
    length = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def bit_length(x: Column | str) -> Column:
    """Bits of a positive integer, exactly; 0 for 0."""
    x = _col(x).cast("long")
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x))).cast("long")


def floor_log2(x: Column | str) -> Column:
    """Greatest k with 2**k <= x; null under 1."""
    x = _col(x)
    return F.when(x >= 1, bit_length(x) - 1)


def real_ids(ids: Column | str, n: int | None = None) -> Column:
    """A list without sentinels: 0 <= id, and id < n where n is given."""
    return F.filter(_col(ids), lambda x: (x >= 0) & (x < n) if n is not None else x >= 0)


def gaps(ids: Column | str) -> Column:
    """Positive differences of neighbours of a sorted list."""
    ids = _col(ids)
    later = F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))
    pairs = F.zip_with(later, F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), lambda x, y: x - y)
    return F.filter(pairs, lambda g: g > 0)
