"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is a bigram model with absolute discounting over a discounted unigram
model with one class of unknown words. It is built in passes whose data all
grow with the input and are spread over partitions:

1. Words of the training texts are counted in each task, and meet by the upper
   bits of their hash. A word's id is its rank by hash. First level: a file per
   part with the hashes and the cumulative counts as Elias-Fano sequences.
2. Pairs of ids are counted in each task and go, sorted and packed, to shards
   that hold equal shares of the training tokens; a frequent context is spread
   over several. Second level: a file per shard with the pointers of its
   contexts, its pairs (a monotone sequence, a context's children relative to
   the context's base) and their smoothed probabilities in 8 bits.
3. Texts are scored against the levels, which every worker maps into memory
   from the shared folder and searches by context-relative successor search.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, hash_words, id_text, materialize, raw_bytes, scratch_root
from .elias_fano import EliasFano, read, write

#: The end of a text: no word has this hash but by chance.
END = np.uint64(0x5DEECE66D1CE4E5B)
#: Log10 probabilities are kept in steps of 1 / STEPS.
STEPS = 20
_OPEN: dict[str, Model] = {}


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of tokens of each text): lower-case words, then the end."""
    words = [r.lower().split() for r in raws]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    out = np.empty(sizes.sum(), np.uint64)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hash_words([x for w in words for x in w])
    out[ends] = END
    return out, sizes


def _squeeze(a: np.ndarray) -> bytes:
    """Sorted 64-bit values, or small counts, as compressed bytes: differences, by significance."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(len(a), 8).T).tobytes())


def _unsqueeze(b: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(keys, counts, and what else goes with a key) with each key once, in order."""
    keys, counts, *rest = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first), *(x[order[first]] for x in rest)


class _Folder:
    """A folder of the model's files, shared by all machines."""

    def __init__(self, spark):
        url = urlparse(scratch_root(spark))
        if url.scheme not in ("", "file"):
            raise ValueError(f"the model's levels are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {url.scheme}")
        self.path = f"{unquote(url.path)}/lm-{uuid.uuid4().hex}"
        os.makedirs(self.path, exist_ok=True)

    def put(self, name: str, sequences: list[EliasFano], *arrays: np.ndarray) -> None:
        """Under the final name only when whole: a task that runs twice or dies leaves no half file."""
        own = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        write(own, sequences, *arrays)
        os.replace(own, f"{self.path}/{name}")


class Model:
    """The mapped levels. plan: numbers of the model as a whole, see build()."""

    def __init__(self, plan: dict):
        self.plan, self.words, self.shards = plan, {}, {}

    def _part(self, p: int):
        if p not in self.words:
            self.words[p] = read(f"{self.plan['folder']}/words-{p}")[0]
        return self.words[p]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, count, tokens counted before it) of sorted hashes; unknown: -1, 0, 0."""
        plan, shift = self.plan, np.uint64(64 - self.plan["bits"])
        out = np.full((3, len(hashes)), 0, np.int64)
        out[0] = -1
        part = (hashes >> shift).astype(np.int64) if plan["bits"] else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(part, np.arange((1 << plan["bits"]) + 1))
        for p in np.unique(part).tolist():
            if not plan["sizes"][p]:
                continue
            a, z = edges[p], edges[p + 1]
            order, totals = self._part(p)
            at, known = order.successor(hashes[a:z] & ((np.uint64(1) << shift) - np.uint64(1)) if plan["bits"] else hashes[a:z])
            at = at[known]
            before = totals[at].astype(np.int64)
            own = a + np.flatnonzero(known)
            out[0, own] = plan["first_id"][p] + at
            out[1, own] = totals[at + 1].astype(np.int64) - before
            out[2, own] = plan["first_token"][p] + before
        return out[0], out[1], out[2]

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ascending word ids."""
        out, firsts = np.empty(len(ids), np.int64), np.array(self.plan["first_id"])
        part = np.searchsorted(firsts, ids, "right") - 1
        for p in np.unique(part).tolist():
            own = part == p
            at, totals = ids[own] - firsts[p], self._part(p)[1]
            out[own] = (totals[at + 1] - totals[at]).astype(np.int64)
        return out

    def _opened(self, s: int):
        if s not in self.shards:
            self.shards[s] = read(f"{self.plan['folder']}/pairs-{s}", "u1")
        return self.shards[s]

    def children(self, ids: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """How many different words follow each of the ascending ids; shard: of each id's first pair."""
        out = np.zeros(len(ids), np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, z in zip(edges[:-1], edges[1:]):
            if (s := int(shard[a])) in self.plan["shards"]:
                first, last = self.plan["shards"][s]
                own = a + np.flatnonzero((ids[a:z] >= first) & (ids[a:z] <= last))
                (pointers, _), _ = self._opened(s)
                both = pointers[np.concatenate((ids[own] - first, ids[own] - first + 1))].astype(np.int64)
                out[own] = both[len(own) :] - both[: len(own)]
        split = self.plan["split"]
        for i in np.flatnonzero(np.isin(ids, np.fromiter(split, np.int64, len(split)))):
            out[i] = split[int(ids[i])]
        return out

    def pairs(self, context: np.ndarray, child: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Log10 of the discounted share, or nan, of pairs in ascending order."""
        out = np.full(len(context), np.nan)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, z in zip(edges[:-1], edges[1:]):
            if (s := int(shard[a])) in self.plan["shards"]:
                first, last = self.plan["shards"][s]
                own = a + np.flatnonzero((context[a:z] >= first) & (context[a:z] <= last))
                (_, nodes), (codes,) = self._opened(s)
                at, known = nodes.successor((context[own] - first).astype(np.uint64) * np.uint64(self.plan["words"]) + child[own].astype(np.uint64))
                out[own[known]] = codes[at[known]] / -STEPS
        return out


def _shard(before: np.ndarray, count: np.ndarray, child: np.ndarray, words: int, share: int) -> np.ndarray:
    """The shard of a pair: where its child falls within its context's share of all training tokens."""
    return (before + (count * (child / words)).astype(np.int64)) // share


def _flush_rows(parts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> dict:
    """Rows (part, keys, counts) of what is sorted by part and key."""
    edges = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True]))) if len(parts) else np.zeros(1, np.int64)
    cut = list(zip(edges[:-1], edges[1:]))
    return {"part": parts[edges[:-1]], "keys": [_squeeze(keys[a:z]) for a, z in cut], "counts": [_squeeze(counts[a:z]) for a, z in cut]}


PACKED = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _counted(rows: DataFrame, count, flush: int = 3_000_000) -> DataFrame:
    """Packed rows (part, keys, counts); count(raws) gives (part, key, count), which add up to `flush` entries before they leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed():
            keys, counts, parts = _merge([(k, c, p) for p, k, c in held])
            out = _flush_rows(parts, keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in PACKED], schema=PACKED)

        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                got = count(raw_bytes(whole.slice(k, 1000)))
                if len(got[1]):
                    held.append(got)
                    n += len(got[1])
                if n >= flush:
                    yield packed()
                    held, n = [], 0
        if held:
            yield packed()

    return rows.mapInArrow(run, "part long, keys binary, counts binary")


def _merged(packed: DataFrame, name: str) -> DataFrame:
    """One row (part, n, total, once, twice, keys, counts) a part, the entries of all tasks added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = None, [], 0

        def done():
            keys, counts = _merge(held)
            row = [[at], [len(keys)], [int(counts.sum())], [int((counts == 1).sum())], [int((counts == 2).sum())], [_squeeze(keys)], [_squeeze(counts)]]
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["part", "n", "total", "once", "twice", "keys", "counts"])

        for batch in batches:
            for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if part != at:
                    if held:
                        yield done()
                    at, held, n = part, [], 0
                held.append((_unsqueeze(keys), _unsqueeze(counts)))
                n += len(held[-1][0])
                if n > 2 * len(held[0][0]) + 2_000_000:
                    held = [_merge(held)]
                    n = len(held[0][0])
        if held:
            yield done()

    return materialize(packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part long, n long, total long, once long, twice long, keys binary, counts binary"), name)


def build(texts: DataFrame, share: int = 4_000_000, bits: int | None = None) -> dict:
    """The model of texts (a column text) as files in the shared folder; returns its plan.

    share: training tokens a shard; bits: upper bits of a hash that tell a
    word's part, by default as many as make a part of each shuffle partition.
    What comes back to the driver is a few numbers for each part and shard.
    """
    spark = texts.sparkSession
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()) if bits is None else bits
    folder, shift = _Folder(spark), np.uint64(64 - bits)

    def words(raws: list[bytes]):
        keys, counts = np.unique(tokens(raws)[0], return_counts=True)
        return (keys >> shift).astype(np.int64), keys, counts.astype(np.uint64)

    level = _merged(_counted(texts, words), "words")
    numbers = {r.part: r for r in level.select("part", "n", "total", "once", "twice").collect()}
    sizes = [numbers[p].n if p in numbers else 0 for p in range(1 << bits)]
    totals = [numbers[p].total if p in numbers else 0 for p in range(1 << bits)]
    once, twice = (sum(getattr(r, f) for r in numbers.values()) for f in ("once", "twice"))
    plan = {
        "folder": folder.path,
        "bits": bits,
        "sizes": sizes,
        "first_id": [0, *np.cumsum(sizes).tolist()],
        "first_token": [0, *np.cumsum(totals).tolist()],
        "words": sum(sizes),
        "tokens": sum(totals),
        "discount": min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5,
        "shards": {},
        "name": uuid.uuid4().hex,
    }
    if not plan["words"]:
        return plan

    def put_words(b: pa.RecordBatch) -> dict:
        for part, keys, counts in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
            keys, counts = _unsqueeze(keys), _unsqueeze(counts)
            order = EliasFano.build(keys & ((np.uint64(1) << shift) - np.uint64(1)), 1 << (64 - bits))
            before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(counts)))
            folder.put(f"words-{part}", [order, EliasFano.build(before, int(before[-1]) + 1)])
        return {"part": b.column(0)}

    arrow_map(level.select("part", "keys", "counts"), put_words, "part long", rows=4).agg(F.count("*")).collect()

    def pairs(raws: list[bytes]):
        model = _model(plan)
        known, back = np.unique(tokens(raws)[0], return_inverse=True)
        ids, count, before = model.ids(known)
        back = np.concatenate(([np.searchsorted(known, END)], back))  # the end of a text is the context of the next one's first word
        keys, counts = np.unique((ids[back[:-1]].astype(np.uint64) << np.uint64(32)) | ids[back[1:]].astype(np.uint64), return_counts=True)
        context, child = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.argsort(ids, kind="stable")
        at = place[np.searchsorted(ids[place], context)]
        return _shard(before[at], count[at], child, plan["words"], share), keys, counts.astype(np.uint64)

    level = _merged(_counted(texts, pairs), "pairs")
    once, twice = level.agg(F.sum("once"), F.sum("twice")).first()
    plan["share"], plan["discount2"] = share, min(0.98, max(0.05, once / (once + 2 * twice))) if once else 0.5
    plan["shards"] = {}

    def put_pairs(b: pa.RecordBatch) -> dict:
        model, out = _model(plan), {c: [] for c in ("part", "first", "last", "at_first", "at_last")}
        for part, keys, counts in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
            keys, counts = _unsqueeze(keys), _unsqueeze(counts)
            context, child = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first, last = int(context[0]), int(context[-1])
            degree = np.bincount(context - first, minlength=last - first + 1)
            pointers = np.concatenate(([0], np.cumsum(degree))).astype(np.uint64)
            nodes = (context - first).astype(np.uint64) * np.uint64(plan["words"]) + child.astype(np.uint64)
            total = model.count_of(np.arange(first, last + 1))
            # the discounted share of the pair alone; what the level below adds is added at the query
            own = np.maximum(counts.astype(float) - plan["discount2"], 1e-9) / total[context - first]
            codes = np.clip(np.rint(-STEPS * np.log10(own)), 0, 255).astype(np.uint8)
            folder.put(f"pairs-{part}", [EliasFano.build(pointers, len(keys) + 1), EliasFano.build(nodes, (last - first + 1) * plan["words"])], codes)
            for c, v in zip(out, (part, first, last, int(degree[0]), int(degree[-1]))):
                out[c].append(v)
        return out

    made = arrow_map(level.select("part", "keys", "counts"), put_pairs, "part long, first long, last long, at_first long, at_last long", rows=1).collect()
    plan["shards"] = {r.part: (r.first, r.last) for r in made}
    split: dict[int, int] = {}
    for r in made:  # contexts that several shards share
        split[r["first"]] = split.get(r["first"], 0) + r.at_first
        if r["last"] != r["first"]:
            split[r["last"]] = split.get(r["last"], 0) + r.at_last
    plan["split"] = split
    plan["name"] = uuid.uuid4().hex
    return plan


def _model(plan: dict) -> Model:
    """The worker's mapping of a model; one at a time."""
    if plan["name"] not in _OPEN:
        _OPEN.clear()
        _OPEN[plan["name"]] = Model(plan)
    return _OPEN[plan["name"]]


def _score(raws: list[bytes], plan: dict) -> dict:
    """Per text: n_tokens, n_known, base_score, score."""
    model = _model(plan)
    hashes, sizes = tokens(raws)
    known, back = np.unique(hashes, return_inverse=True)
    n, v, d = plan["tokens"], plan["words"], plan["discount"]
    ids, count, before = model.ids(known) if v else (np.full(len(known), -1), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64))
    text = np.repeat(np.arange(len(raws)), sizes)
    base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
    single = np.where(count > 0, (count - d) / n, d * v / n) if v else np.ones(len(known))
    per_text = lambda a: np.bincount(text, a, len(raws))
    out = {"n_tokens": sizes, "n_known": per_text((count > 0)[back]).astype(np.int64), "base_score": per_text(base[back])}
    if not v:
        return out | {"score": np.zeros(len(raws))}
    end = np.searchsorted(known, END)
    both, again = np.unique((np.concatenate(([end], back[:-1])).astype(np.uint64) << np.uint64(32)) | back.astype(np.uint64), return_inverse=True)
    c, w = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    p = single[w]  # of an unknown context
    kids = np.zeros(len(known))
    inside = np.flatnonzero(ids >= 0)
    kids[inside] = model.children(ids[inside], _shard(before[inside], count[inside], 0, v, plan["share"]))
    p *= np.where(ids[c] >= 0, plan["discount2"] * kids[c] / np.maximum(count[c], 1), 1)
    sure = np.flatnonzero((ids[c] >= 0) & (ids[w] >= 0))
    x, y = c[sure], w[sure]
    own = model.pairs(ids[x], ids[y], _shard(before[x], count[x], ids[y], v, plan["share"]))
    met = ~np.isnan(own)
    p[sure[met]] += 10.0 ** own[met]
    return out | {"score": per_text(np.log10(p)[again])}


def score_texts(docs: DataFrame, modulus: int = 10, share: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    The model learns from all rows whose crc32(id as text) modulo modulus isn't
    0 (a null id counts as the text ''), repeated rows each time. Null and
    empty texts have one token, their end. Without training rows every token is
    the unknown class with probability 1. An empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col)
    plan = build(rows.where(fold(F.col("doc_id"), modulus) != 0).select("text"), share)
    sent = docs.sparkSession.sparkContext.broadcast(plan)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = arrow_map(rows, lambda b: {"doc_id": b.column(0)} | _score(raw_bytes(b), sent.value), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double", rows=1000)
    return out.select("doc_id", (fold(F.col("doc_id"), modulus) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(plan["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
