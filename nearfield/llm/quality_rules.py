"""Quality rules with suffix-array repetition.

The words of each text get a suffix array (prefix doubling that only goes on
with ties, many texts at once) and the longest common prefixes of neighbours.
A suffix's deepest common-prefix interval is as long as its longer neighbour
prefix, so the union of all intervals' spans is that of these. Rules bound the
share of words inside repeats of `min_repeat` words or more, and the longest
repeat. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_words, id_text, mix, raw_bytes

SPACE, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes; a suffix that ends sorts first."""
    n = len(values)
    if not n:
        return np.empty(0, np.int64)
    order = np.argsort(values, kind="stable")
    new = np.concatenate(([True], values[order][1:] != values[order][:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    h = 1
    while True:
        single = new & np.concatenate((new[1:], [True]))
        at = np.flatnonzero(~single)
        if not len(at):
            return order
        place = order[at]
        ahead = np.where(place + h < n, rank[np.minimum(place + h, n - 1)], -1)
        sort = np.lexsort((ahead, head[at]))
        order[at] = place = place[sort]
        ahead, group = ahead[sort], head[at]
        new[at] = np.concatenate(([True], (ahead[1:] != ahead[:-1]) | (group[1:] != group[:-1])))
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[at]] = head[at]
        h *= 2


def common_prefixes(values: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix and the next in order, by hashes of runs of doubling length. ends: of each place's text."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    a, b = order[:-1], order[1:]
    live = np.flatnonzero(values[a] == values[b]) if len(order) > 1 else np.empty(0, np.int64)
    if not len(live):
        return out
    most = np.minimum(ends[a[live]] - a[live], ends[b[live]] - b[live])
    levels = [values]
    while (1 << len(levels)) <= most.max():
        h = levels[-1]
        step = 1 << (len(levels) - 1)
        nxt = np.zeros_like(h)
        nxt[: len(h) - step] = mix(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
        levels.append(nxt)
    got = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        can = got + (1 << k) <= most
        i, j = a[live] + got, b[live] + got
        top = len(values) - 1
        same = can & (levels[k][np.minimum(i, top)] == levels[k][np.minimum(j, top)])
        got[same] += 1 << k
    out[live] = got
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a repeat of `least` or more that starts at or before them."""
    change = np.zeros(len(longest) + 1, np.int64)
    at = np.flatnonzero(longest >= least)
    change[at] += 1
    np.subtract.at(change, at + longest[at], 1)
    return np.cumsum(change)[:-1] > 0


def repeats(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(longest repeat that starts at each word, number of words of each text), texts end to end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    salt = mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
    values = mix(hash_words([w for t in texts for w in t]) ^ np.repeat(salt, sizes)) if sizes.sum() else np.empty(0, np.uint64)
    order = suffix_array(values)
    lcp = common_prefixes(values, order, ends)
    longest = np.zeros(len(values), np.int64)
    if len(lcp):
        longest[order] = np.maximum(np.concatenate(([0], lcp)), np.concatenate((lcp, [0])))
    return longest, sizes


def quality_rules(docs: DataFrame, min_repeat: int = 10, max_share: float = 0.3, max_repeat: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, repeated_words, longest_repeat) of every row of docs.

    kept: not base_failed, at most max_share of the words inside repeats of
    min_repeat words or more, and no repeat over max_repeat words. Null and
    empty texts have no words and fail the base; rows are kept as they are,
    with null or repeated ids too; an empty table gives no rows.
    """

    def batch(b: pa.RecordBatch) -> dict:
        raws = raw_bytes(b)
        texts = [r.split() for r in raws]
        longest, sizes = repeats(texts)
        starts = np.concatenate(([0], np.cumsum(sizes)))

        def per_text(a: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(a)))
            return total[starts[1:]] - total[starts[:-1]]

        lines = [[x for x in r.split(b"\n") if x.strip()] for r in raws]
        chars = pc.utf8_length(b.column(1).fill_null("")).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(sizes)
        most = np.zeros(len(raws), np.int64)
        if len(some):
            most[some] = np.maximum.reduceat(longest, starts[some])
        return {
            "doc_id": b.column(0),
            "n_words": sizes,
            "word_chars": chars - np.array([len(r) - len(r.translate(None, SPACE)) for r in raws]),
            "n_symbols": [len(r) - len(r.translate(None, SYMBOLS)) for r in raws],
            "n_dup_lines": [len(x) - len(set(x)) for x in lines],
            "n_repeat_words": per_text(covered(longest, 3)),
            "repeated_words": per_text(covered(longest, min_repeat)),
            "longest_repeat": most,
        }

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeated_words", "longest_repeat")
    out = arrow_map(rows, batch, ", ".join([f"doc_id {kind}", *(f"{c} long" for c in counts)]), rows=1000)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("repeated_words") <= max_share * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return out.select("doc_id", *counts[:5], failed.alias("base_failed"), (~failed & fine).alias("kept"), *counts[5:])
