"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nystroem landmarks.

A text becomes its stream of letters, so separators put into a word don't
matter. Units are windows of `WINDOW` start places. The kernel of two windows
counts their common subsequences of four letters that span six at most, each
weighted by DECAY for every letter it skips: it tolerates inserted and gapped
characters. The machine sees a window through its kernel with `landmarks`
windows, whitened by their own kernel matrix (Nystroem). As the kernel is a dot
product over subsequences, a trained machine collapses to one weight per
subsequence, exactly; scoring is then linear in the text.

Labels are of documents, windows are what is toxic: as in multiple-instance
learning, the best windows of a toxic document and the worst of a clean one are
chosen anew after each fit. A document is judged by its best window and by how
many of its windows, absolutely and for its length, are beyond the margin,
calibrated on labelled rows kept out of the fit.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, id_text, raw_bytes

WINDOW = 8
DECAY = 0.6
#: Offsets of the second to fourth letter of a subsequence.
OFFSETS = [(a, b, d) for d in (3, 4, 5) for b in range(2, d) for a in range(1, b)]
PAD, SIZE = 31, 1 << 21
#: First letters of words are codes of their own, as the first letter of a subsequence only.
FIRST = 32
#: Codes of bytes; 64: between words. Lead bytes of other characters go, their last bytes stand for them.
CODES = bytes(b - 97 if 97 <= b <= 122 else b - 65 if 65 <= b <= 90 else 26 + (b & 31) % 5 if b >= 128 else 64 for b in range(256))
LEAD = bytes(range(192, 256))
GAP = bytes([PAD]) * (WINDOW + 8)
_WEIGHTS: dict[str, np.ndarray] = {}


def letters(raw: bytes) -> bytes:
    """Codes 0 to 25 of a to z in either case, 26 to 30 of other characters, plus FIRST at the start of a word."""
    c = np.frombuffer(raw.translate(CODES, LEAD), np.uint8)
    on = c < 64
    starts = on.copy()
    starts[1:] &= ~on[:-1]
    return (c | (starts.view(np.uint8) << 5))[on].tobytes()


def _keys(codes: np.ndarray, i: np.ndarray | slice, offset: tuple[int, int, int]) -> np.ndarray:
    a, b, d = offset
    rest = codes & 31
    return (codes[i] << 15) | (rest[i + a] << 10) | (rest[i + b] << 5) | rest[i + d]


def window_values(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The machine's value of the window at each place of codes (uint8, padded by GAP at the end)."""
    n = len(codes) - len(GAP)
    out = np.zeros(n + WINDOW, np.float32)
    step = 1 << 15
    for s in range(0, n, step):
        c = codes[s : min(s + step, n) + 5].astype(np.int32)
        m = len(c) - 5
        c3, c = c << 15, c & 31
        c2, c1 = c << 10, c << 5
        own = out[s : s + m]
        for a, b, d in OFFSETS:
            keys = c3[:m] | c2[a : a + m]
            keys |= c1[b : b + m]
            keys |= c[d : d + m]
            own += np.float32(DECAY ** (d - 3)) * weights.take(keys)
    step = 1
    while step < WINDOW:
        out[:-step] += out[step:]
        step *= 2
    return out[:n]


def pooled(raws: list[bytes], weights: np.ndarray, margin: float) -> np.ndarray:
    """Per text: the best window's value, log of its windows over the margin, log of their share. All windows of whole texts."""
    parts = [letters(r) for r in raws]
    codes = np.frombuffer(GAP.join([*parts, b""]), np.uint8)
    values = window_values(codes, weights)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + len(GAP))))[:-1]
    most, hits = np.zeros(len(raws)), np.zeros(len(raws))
    some = np.flatnonzero(sizes)
    if len(some):
        edges = np.column_stack((starts[some], starts[some] + sizes[some])).ravel()
        edges = edges[:-1] if edges[-1] >= len(values) else edges
        most[some] = np.maximum.reduceat(values, edges)[::2]
        hits[some] = np.add.reduceat((values > margin).astype(np.int64), edges)[::2]
    return np.column_stack((most, np.log1p(hits), np.log((hits + 0.5) / (sizes + 50))))


def _features(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of the subsequences of the windows at `at`; those with a pad weigh nothing."""
    i = (at[:, None] + np.arange(WINDOW)).ravel()
    keys = np.stack([_keys(codes, i, o) for o in OFFSETS], 1).reshape(len(at), -1)
    w = np.tile([DECAY ** (o[2] - 3) for o in OFFSETS], WINDOW)
    pad = np.zeros(keys.shape, bool)
    for shift in (0, 5, 10, 15):
        pad |= (keys >> shift) & 31 == PAD
    return keys, np.where(pad, 0, w)


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Weights and, last, bias of a linear machine with squared hinge loss, by Newton steps over the violators."""
    x = np.column_stack((x, np.ones(len(x))))
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(20):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(ridge + c * a.T @ x[on], c * a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


class _Sample:
    """Labelled texts as one padded code array."""

    def __init__(self, raws: list[bytes]):
        self.parts = [letters(r) for r in raws]
        self.codes = np.frombuffer(GAP.join([*self.parts, b""]), np.uint8).astype(np.int32)
        self.sizes = np.array([len(p) for p in self.parts])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + len(GAP))))[:-1]

    def top(self, values: np.ndarray, doc: int, n: int) -> list[int]:
        """Places of the n best windows of a text that don't overlap."""
        own, out = values[self.starts[doc] : self.starts[doc] + self.sizes[doc]].copy(), []
        for _ in range(n if len(own) else 0):
            k = int(own.argmax())
            if own[k] == -np.inf:
                break
            out.append(int(self.starts[doc]) + k)
            own[max(0, k - WINDOW) : k + WINDOW] = -np.inf
        return out


def train(raws: list[bytes], toxic: np.ndarray, landmarks: int = 256, rounds: int = 3, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """(weight of each subsequence, margin) of the collapsed machine, and its calibration over pooled()."""
    toxic = np.asarray(toxic, bool)
    rate = (toxic.sum() + 0.5) / (len(toxic) + 2)
    if toxic.sum() < 2 or (~toxic).sum() < 2:
        return np.zeros(SIZE, np.float32), 0.0, np.array([0, 0, 0, np.log(rate / (1 - rate))])
    rng = np.random.default_rng(seed)
    fit = rng.random(len(toxic)) < 0.7
    fit[[np.flatnonzero(toxic)[0], np.flatnonzero(~toxic)[0]]] = True
    s = _Sample(raws)
    count = np.zeros((2, SIZE))
    mark = np.zeros(SIZE, bool)
    for k in np.flatnonzero(fit):
        keys = _keys(s.codes, np.arange(s.starts[k], s.starts[k] + s.sizes[k]), (1, 2, 3))
        mark[keys] = True
        own = np.flatnonzero(mark)
        count[int(toxic[k]), own] += 1
        mark[own] = False
    n1, n0 = (fit & toxic).sum(), (fit & ~toxic).sum()
    weights = np.maximum(0, np.log((count[1] + 0.1) / (n1 + 1)) - np.log((count[0] + 0.5) / (n0 + 1)) - 0.5)
    weights[count[1] < 2] = 0
    weights = _clear(weights.astype(np.float32))
    codes8 = s.codes.astype(np.uint8)
    good, bad, margin = [], [], 0.0
    for r in range(rounds):
        values = window_values(codes8, weights)
        good = sorted({p for k in np.flatnonzero(fit & toxic) for p in s.top(values, k, 3)})
        hard = {p for k in np.flatnonzero(fit & ~toxic) for p in s.top(values, k, 2)}
        random = {int(s.starts[k] + rng.integers(s.sizes[k])) for k in np.flatnonzero(fit & ~toxic & (s.sizes > 0))}
        bad = sorted(hard | random | set(bad if r else ()))
        if not good or not bad:
            break
        at = np.array(good + bad)
        y = np.repeat([1.0, -1.0], [len(good), len(bad)])
        keys, w = _features(s.codes, at)
        marks = np.concatenate((rng.permutation(len(good))[: landmarks // 2], len(good) + rng.permutation(len(bad))[: landmarks // 2]))
        known, place = np.unique(keys[marks], return_inverse=True)
        base = np.zeros((len(marks), len(known)))
        np.add.at(base, (np.repeat(np.arange(len(marks)), keys.shape[1]), place.ravel()), w[marks].ravel())
        e, v = np.linalg.eigh(base @ base.T)
        on = e > 1e-6 * e[-1]
        white = v[:, on] / np.sqrt(e[on])
        at_known = np.searchsorted(known, keys).clip(max=len(known) - 1)
        w = np.where(known[at_known] == keys, w, 0)
        flat = base.T @ white
        x = np.concatenate([np.einsum("nf,nfk->nk", w[i : i + 128], flat[at_known[i : i + 128]]) for i in range(0, len(at), 128)])
        scale = np.sqrt((x * x).sum(1).mean())
        balance = np.where(y > 0, len(y) / (2 * len(good)), len(y) / (2 * len(bad)))
        machine = _squared_hinge(x / scale, y, balance)
        weights = np.zeros(SIZE, np.float32)
        weights[known] = flat @ machine[:-1] / scale
        margin = -float(machine[-1])
        weights = _clear(weights)
    value = pooled(raws, weights, margin)
    held = ~fit if (toxic & ~fit).sum() >= 5 and (~toxic & ~fit).sum() >= 5 else np.ones(len(fit), bool)
    return weights, margin, _logistic(value[held], toxic[held])


def _clear(weights: np.ndarray) -> np.ndarray:
    """No weight for subsequences with a pad."""
    w = weights.reshape(2, 32, 32, 32, 32)
    w[:, PAD], w[:, :, PAD], w[:, :, :, PAD], w[:, :, :, :, PAD] = 0, 0, 0, 0
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Slopes and, last, intercept, with Platt's smoothed targets."""
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (t - p) - pull * w)
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def trained(docs: DataFrame, labels: DataFrame, label: str, most: int, landmarks: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float, np.ndarray]:
    """train() on up to `most` rows of each class outside fold 0 of 5, the same ones every time, in one task.

    Documents with two labels count as 1 if either is. The chosen ids are a
    broadcast of a fixed bound; documents are read once, only the chosen ones
    move, and what comes back is the few weights that aren't zero.
    """
    rows = labels.where(fold(F.col("doc_id"), 5) != 0).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = rows.where("label = 1").orderBy(*order).limit(most).union(rows.where("label = 0").orderBy(*order).limit(most))
    found = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").where("text is not null").select(F.col("doc_id").cast("string"), "text", "label")

    def fit(batches):
        got = sorted((i, r, y) for b in batches for i, r, y in zip(b.column(0).to_pylist(), raw_bytes(b), b.column(2).to_pylist()))
        weights, margin, w = train([r for _, r, _ in got], np.array([y for _, _, y in got], np.int64), landmarks)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([weights[at].tobytes()]), pa.array([margin]), pa.array([w.tolist()])], names=["at", "value", "margin", "w"])

    got = found.repartition(1).mapInArrow(fit, "at binary, value binary, margin double, w array<double>").first()
    weights = np.zeros(SIZE, np.float32)
    if got is None:
        return train([], np.zeros(0, np.int64))
    weights[np.frombuffer(got.at, np.int64)] = np.frombuffer(got.value, np.float32)
    return weights, got.margin, np.array(got.w)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 2000, landmarks: int = 256, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; carry: columns that go along.

    The fit takes up to max_labelled labelled documents of each class
    (documented bound) whose crc32(id as text) mod 5 isn't 0; scores take
    nothing but the text. Null and empty texts score as texts without any known
    subsequence; without labels of both classes all score the rate. Rows are
    kept as they are, with null or repeated ids too.
    """
    weights, margin, w = trained(docs, labels, "toxic", max_labelled, landmarks, id_col, text_col)
    sent, name = docs.sparkSession.sparkContext.broadcast(weights), uuid.uuid4().hex

    def batch(b: pa.RecordBatch) -> dict:
        if name not in _WEIGHTS:
            _WEIGHTS.clear()
            _WEIGHTS[name] = sent.value
        score = 1 / (1 + np.exp(-np.clip(pooled(raw_bytes(b), _WEIGHTS[name], margin) @ w[:-1] + w[-1], -500, 500)))
        return {"doc_id": b.column(0), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    rows = id_text(docs, id_col, text_col, carry)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = arrow_map(rows, batch, f"doc_id {kind}, score double, predicted int", rows=512, carry=carry, text_col=text_col)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", *(c for c in carry if c != "doc_id"))
