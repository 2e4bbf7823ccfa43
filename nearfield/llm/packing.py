"""Vector best-fit packing of tokenised documents into sequences.

1. One pass cuts each document's ids into pieces of at most max_tokens; only
   the pieces' numbers (some 40 bytes each) go further.
2. Pieces are dealt by hash into groups of about group_tokens tokens, so the
   number of groups grows with the input and no group with it; a group leaves
   one part-filled sequence or so.
3. Within a group, pieces go in decreasing length to the open sequence that
   fits under every capacity (tokens, documents, attention cost = sum of
   squared piece lengths) and is best by weighted dot product or by the norm
   of what would be left over; if none fits, a new one is opened.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_text, materialize, strings
from .vocab import Ids, Pretokens

_STATE: dict[str, tuple] = {}


def cut_pieces(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids plus end_id, cut where longer than max_tokens.

    Of a longer document the first piece takes the remainder and all others are full.
    """

    def batch(b: pa.RecordBatch) -> dict:
        if vocabulary not in _STATE:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            pre = Pretokens(vocabulary)
            _STATE[vocabulary] = pre, Ids(pre)
        pre, ids = _STATE[vocabulary]
        end, rows, cols = np.array([end_id], "<u4").tobytes(), [], ([], [], [], [])
        for i, text in enumerate(strings(b)):
            split = pre.split(text)
            data = memoryview((np.array(pre.ids(text), "<u4").tobytes() if split is None else b"".join(map(ids.__getitem__, split))) + end)
            n, at, piece = len(data) // 4, 0, 0
            while at < n:
                take = (n - 1) % max_tokens + 1 if at == 0 else max_tokens
                rows.append(i)
                for col, v in zip(cols, (piece, at, take, zlib.crc32(data[4 * at : 4 * (at + take)]))):
                    col.append(v)
                at, piece = at + take, piece + 1
        return {"doc_id": b.column(0).take(pa.array(rows, pa.int64()))} | dict(zip(("piece", "start", "length", "ids_crc32"), cols))

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, batch, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def assign(lengths: np.ndarray, max_tokens: int, max_docs: int, max_attention: float, rule: str = "norm", weights: tuple = (1.0, 0.02, 0.02)) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths must be in the order of placement.

    Residual capacities of the open bins are kept in one array each. 'dot'
    takes the feasible bin with the largest weighted dot product of piece and
    residual, each as a share of its capacity, 'norm' the one whose weighted
    residual after placing has the least Euclidean norm; ties go to the oldest.
    """
    caps = np.array([max_tokens, max_docs, max_attention], float)
    w = np.asarray(weights, float) / caps**2
    left, used, name = np.empty((3, 1024)), np.empty(1024, np.int64), np.empty(1024, np.int64)
    n_open = n_bins = 0
    out, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = np.array([lengths.min(initial=1), 1, float(lengths.min(initial=1)) ** 2])
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rest = left[:, :n_open] - need[:, None]
        fits = rest.min(0, initial=np.inf) >= 0
        k = n_open
        if fits.any():
            score = w @ (rest * rest) if rule == "norm" else -((w * need) @ left[:, :n_open])
            k = int(np.where(fits, score, np.inf).argmin())
        else:
            if n_open == left.shape[1]:
                left, used, name = np.concatenate((left, left), 1), np.resize(used, 2 * n_open), np.resize(name, 2 * n_open)
            left[:, k], used[k], name[k] = caps, 0, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        out[i], at[i] = name[k], used[k]
        left[:, k] -= need
        used[k] += length
        if (left[:, k] < least).any():  # nothing fits any more
            for x in (left, used, name):
                x[..., k : n_open - 1] = x[..., k + 1 : n_open].copy()
            n_open -= 1
    return out, at


def pack(
    docs: DataFrame,
    vocabulary: str,
    max_tokens: int = 2048,
    max_docs: int | None = None,
    max_attention: float | None = None,
    rule: str = "norm",
    weights: tuple = (1.0, 0.02, 0.02),
    group_tokens: int = 4_000_000,
    group_pieces: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    max_docs and max_attention default to what max_tokens allows anyway. Null
    and empty texts are one piece, the end id alone. Rows with equal or null
    ids are packed each by itself; an empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs, vocabulary, max_tokens, id_col=id_col, text_col=text_col).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    total = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(total[0] or 0) // group_tokens), -(-total[1] // group_pieces))
    caps = max_tokens, max_docs or max_tokens, float(max_attention or max_tokens * max_tokens)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "_row"], ascending=[False, True, True, True])
        bins, at = assign(group["length"].to_numpy(), *caps, rule, weights)
        group["sequence_id"], group["offset"] = group["grp"].to_numpy() * np.int64(1 << 32) + bins, at
        return group.drop(columns=["grp", "_row"])

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long"))  # by row: equal rows don't meet
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("grp").applyInPandas(one, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
