"""A quality classifier by co-training.

Two naive Bayes views: the text's words and word shapes, hashed, and the page's
metadata (language, source, size class). Each is a table of counts by class, so
it is fitted by sums over all rows, added up in each task. In every round each
view labels the rows that nobody labelled and that it is most sure of (a fixed
share of all rows for each class, counted exactly on a fine scale, ties taken
whole), and the other view is fitted anew with them. Last, each view is
calibrated on labelled rows that no fit has seen, the calibrated views are
combined, and every document is scored.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, hash_words, id_text, materialize, raw_bytes

BUCKETS, META = 4096, 1024
SHAPES = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)


def text_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of word shapes, with how often."""
    words = raw.split()
    if not words:
        return np.empty(0, np.uint16), np.empty(0, np.uint32)
    shapes = RUNS.sub(rb"\1", raw.translate(SHAPES)).split()
    h = np.concatenate((hash_words([w.lower() for w in words]) % np.uint64(BUCKETS - 1024), np.uint64(BUCKETS - 1024) + hash_words(shapes) % np.uint64(1024)))
    count = np.bincount(h.astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at.astype(np.uint16), count[at].astype(np.uint32)


def _packed(n: np.ndarray) -> bytes:
    """Counts of a byte each, or of four where one needs more."""
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()


def _unpacked(at: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, square roots of counts)."""
    at = np.frombuffer(at, np.uint16)
    return at, np.sqrt(np.frombuffer(n, np.uint8 if len(n) == len(at) else np.uint32), dtype=float)


def _meta(values: tuple) -> list[int]:
    lang, source, size = values
    return [zlib.crc32(repr(x).encode()) % META for x in (("lang", lang), ("source", source), ("size", None if size is None else int(size).bit_length()))]


class Views:
    """Log odds of both views, from counts by class: tables (2, BUCKETS) and (2, META)."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.name = uuid.uuid4().hex
        self.text, self.meta = (np.log((t[1] + 1) / (t[1].sum() + t.shape[1])) - np.log((t[0] + 1) / (t[0].sum() + t.shape[1])) for t in (text, meta))

    def of(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Text log odds by the square root of the number of features, and metadata log odds, of each row."""
        texts, metas = np.zeros(b.num_rows), np.zeros(b.num_rows)
        for i, (at, n, meta) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("at", "n", "meta")))):
            at, n = _unpacked(at, n)
            texts[i] = self.text[at] @ n / np.sqrt(n.sum() + 1)
            metas[i] = self.meta[meta].sum()
        return texts, metas


def _counts(rows: DataFrame, label) -> tuple[np.ndarray, np.ndarray]:
    """Counts by class of both views; label(batch) gives each row's class for the text view and for the metadata view (-1: none)."""

    def run(batches):
        text, meta, some = np.zeros((2, BUCKETS)), np.zeros((2, META)), False
        for b in batches:
            for at, n, m, x, y in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("at", "n", "meta")), *label(b)):
                if x >= 0:
                    at, n = _unpacked(at, n)
                    text[x, at] += n
                if y >= 0:
                    meta[y, m] += 1
                some = True
        if some:
            flat = np.concatenate((text.ravel(), meta.ravel()))
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["place", "value"])

    flat = np.zeros(2 * (BUCKETS + META))
    for r in rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        flat[r.place] = r.value
    return flat[: 2 * BUCKETS].reshape(2, -1), flat[2 * BUCKETS :].reshape(2, -1)


def _given(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b.column(b.schema.get_field_index("given")).fill_null(-1).to_pylist(), np.int64)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes, and last an intercept, of a lightly bound logistic fit; the rate of 1 where one class is missing."""
    k = x.shape[1] + 1
    if len(set(y.tolist())) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.append(np.zeros(k - 1), np.log(rate / (1 - rate)))
    z, w = np.column_stack((x, np.ones(len(x)))), np.zeros(k)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(k), z.T @ (y - p) - 0.01 * w)
    return w


def _combined(text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, meta, both): each view's slope and intercept, and the slopes and intercept over the two calibrated log odds."""
    own = [_calibrate(x[:, None], y) for x in (text, meta)]
    return *own, _calibrate(np.column_stack([x * w[0] + w[1] for x, w in zip((text, meta), own)]), y)


def scale_of(x: np.ndarray) -> np.ndarray:
    """The place of log odds on a scale of 256 steps a unit."""
    return np.floor(np.clip(x, -64, 64) * 256).astype(np.int64)


def sure(counts: dict[int, int], share: float) -> tuple[int, int] | None:
    """(low, high): places at or beyond which at least `share` of the rows lie; None where both ends are one."""
    places, n = sorted(counts), sum(counts.values())
    if not n:
        return None

    def end(order: list[int]) -> int:
        got = 0
        for x in order:
            got += counts[x]
            if got >= share * n:
                break
        return x

    low, high = end(places), end(places[::-1])
    return (low, high) if low < high else None


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = 2, confident: float = 0.05, max_calibration: int = 20_000, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple = ("lang", "source", "n_chars")) -> DataFrame:
    """(doc_id, held_out, text_odds, meta_odds, score, kept) of every row of docs.

    labels: (doc_id, quality 0 or 1); several labels of an id count as 1 if any
    is. Rows with crc32(id as text) mod 5 = 0 are held out: their labels are
    never used. Of the others, remainder 4 calibrates (max_calibration rows at
    most, a documented bound) and the rest fits the first views. score is the
    calibrated chance of quality 1, kept is score >= 0.5. Null texts are empty,
    null metadata is a value of its own, ids that are null have no label; rows
    are kept as they are, repeated ones count each time; very long texts are
    taken whole; extra columns aren't looked at; an empty table gives no rows.
    """

    def features(b: pa.RecordBatch) -> dict:
        found = [text_features(r) for r in raw_bytes(b)]
        return {"doc_id": b.column(0), "at": [x.tobytes() for x, _ in found], "n": [_packed(x) for _, x in found], "meta": [_meta(v) for v in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))]}

    rows = id_text(docs, id_col, text_col, carry=meta_cols)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = arrow_map(rows, features, f"doc_id {kind}, at binary, n binary, meta array<int>", rows=1000)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality")).where(fold(F.col("doc_id"), 5) != 0)
    rows = rows.join(known.hint("merge"), "doc_id", "left").withColumn("fold", fold(F.col("doc_id"), 5))
    rows = rows.withColumn("given", F.when(F.col("fold") < 4, F.col("quality")))
    rows = materialize(rows.select("doc_id", "at", "n", "meta", "fold", "quality", "given"), "features")

    views = Views(*_counts(rows, lambda b: (_given(b), _given(b))))
    for _ in range(rounds):
        free = arrow_map(rows.where("quality is null"), lambda b, v=views: dict(zip(("text", "meta"), map(scale_of, v.of(b)))), "text long, meta long")
        seen: dict[str, dict[int, int]] = {"text": {}, "meta": {}}  # 32,769 places a view at most
        both = F.explode(F.array(*(F.struct(F.lit(c).alias("view"), F.col(c).alias("place")) for c in seen))).alias("x")
        for r in free.select(both).groupBy("x.view", "x.place").count().collect():
            seen[r.view][r.place] = r["count"]
        limits = [sure(seen[c], confident) for c in ("text", "meta")]

        def label(b: pa.RecordBatch, v=views, limits=limits):
            given, free = _given(b), np.array(b.column(b.schema.get_field_index("quality")).is_null())
            none = np.full(len(given), -1)
            by = [none if at is None else np.where(free & (x >= at[1]), 1, np.where(free & (x <= at[0]), 0, -1)) for x, at in zip(map(scale_of, v.of(b)), limits)]
            return np.where(given >= 0, given, by[1]), np.where(given >= 0, given, by[0])

        views = Views(*_counts(rows, label))

    def odds(b: pa.RecordBatch) -> dict:
        text, meta = views.of(b)
        return {"doc_id": b.column(0), "fold": b.column(1), "quality": b.column(2), "text_odds": text, "meta_odds": meta}

    scored = arrow_map(rows.select("doc_id", "fold", "quality", "at", "n", "meta"), odds, f"doc_id {kind}, fold long, quality long, text_odds double, meta_odds double")
    sample = scored.where("fold = 4 and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "text_odds").limit(max_calibration).select("text_odds", "meta_odds", "quality").toPandas()
    text, meta, both = _combined(*(sample[c].to_numpy(float) for c in ("text_odds", "meta_odds", "quality")))
    calibrated = [float(w[0]) * F.col(c) + float(w[1]) for w, c in ((text, "text_odds"), (meta, "meta_odds"))]
    score = 1 / (1 + F.exp(-(float(both[0]) * calibrated[0] + float(both[1]) * calibrated[1] + float(both[2]))))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "text_odds", "meta_odds", score.alias("score"), (score >= 0.5).alias("kept"))
