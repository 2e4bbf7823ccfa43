"""Repeated substrings over a whole corpus by an anchor-sampled enhanced suffix array.

A string of `length` bytes that starts in two places has the same anchor in
both: the leftmost least hash among its k-grams. So only anchors are posted,
about one per length / 2 bytes. Anchors whose k-gram occurs once are dropped;
the others get their context (length bytes to the right, length - k to the
left) and meet by k-gram. There the contexts to the right are sorted, their
common-prefix intervals come from a stack scan, and within each interval the
contexts to the left, sorted backwards, show how far members can be extended
to the left by another member: so every occurrence of every maximal repeat is
found, not just neighbours in the order. A member is covered where left and
right extension reach `length` together.

Equal texts are one text to all this, so copies cost nothing; k-grams with
more than `block` contexts are split into blocks, and each pair of blocks is a
task of its own. Long runs of a short period are covered by themselves, only
their first and last anchors are posted; for what begins in a run and goes on
after it, every text also posts the end of each run its anchors lie in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, hash_words, id_text, materialize, mix, raw_bytes

#: Bytes that stand for a word where words are the units.
CODE = 8
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for k, b in enumerate((BASE, inverse)):
            factors = np.full(n, b, np.uint64)
            factors[0] = 1
            _POWERS[k : k + 1] = [np.multiply.accumulate(factors)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _kgram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    up, down = _powers(len(a) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])))
    return mix((sums[k:] - sums[:-k]) * down[: len(a) - k + 1])


def _leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the leftmost least of each w consecutive values (their upper 40 bits)."""
    if w == 1:
        return np.arange(len(h))
    n = len(h) - w + 1
    key = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    rows = key.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _run_end(raw: bytes, at: int, d: int) -> int:
    """Where bytes stop to equal those d before them, from `at` on."""
    step = 256
    while raw[at : at + step] == raw[at - d : at - d + step] and at + step <= len(raw):
        at, step = at + step, 2 * step
    own, before = (np.frombuffer(raw[x : x + step], np.uint8) for x in (at, at - d))
    differ = np.flatnonzero(own != before[: len(own)])
    return at + int(differ[0]) if len(differ) else at + len(own)


def _run_ends(raw: bytes, places: list[int], k: int) -> list[int]:
    """Ends of the periodic runs, of two periods and k bytes at least, that anchors lie in."""
    out, end, d = [], 0, 0
    for q in places:
        if q + k + d <= end:
            continue
        again = raw.find(raw[q : q + k], q + 1, q + 2 * k)
        if again < 0:
            end = 0
            continue
        d = again - q
        end = _run_end(raw, again + k, d)
        if end - q >= 2 * d + k:
            out.append(end)
    return out


def anchors(raw: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(places, hashes, spans): the posted anchors, and what long periodic runs cover by themselves."""
    if len(raw) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64), []
    a, w, at, hs = np.frombuffer(raw, np.uint8), length - k + 1, [], []
    for s in range(0, len(a) - length + 1, CHUNK):
        h = _kgram_hashes(a[s : s + CHUNK + length - 1], k)
        p = _leftmost_minima(h, w)
        at.append(p + s)
        hs.append(h[p])
    at, first = np.unique(np.concatenate(at), return_index=True)
    hs = np.concatenate(hs)[first]
    gap, same = np.diff(at), np.diff(hs.view(np.int64)) == 0
    linked = same & (gap <= k)
    linked[1:] &= True
    spans, keep = [], np.ones(len(at), bool)
    i = 0
    runs = np.flatnonzero(linked)
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1] == runs[j] + 1 and gap[runs[j + 1]] == gap[runs[i]]:
            j += 1
        lo, hi, d = runs[i], runs[j] + 1, int(gap[runs[i]])
        start, end = int(at[lo]), int(at[hi]) + k
        if end - start >= length + d and raw[start : end - d] == raw[start + d : end]:
            spans.append((start, _run_end(raw, end, d)))
            keep[lo + 2 : hi - 1] = False
        i = j + 1
    # where a window holds a dropped anchor and isn't within the run, it holds the k-gram with the byte after the run, in every text
    more = np.array(sorted({e + 1 - k for e in _run_ends(raw, at.tolist(), k) if e < len(raw)} - set(at[keep].tolist())), np.int64)
    if not len(more):
        return at[keep], hs[keep], spans
    ends = np.array([_kgram_hashes(a[p : p + k], k)[0] for p in more.tolist()], np.uint64)
    return np.concatenate((at[keep], more)), np.concatenate((hs[keep], ends)), spans


def _agree(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many leading columns of rows a and b agree, n at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), n)


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), np.array([len(p) for p in parts])


def prefix_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of each common-prefix interval of at least `least`; lcp[i] is of places i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > v:
            value, first = stack.pop()
            yield value, first, i
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, first))


def extents(left: list[bytes], right: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For members of one anchor: bytes covered to its left and right (-1, -1: none).

    left: backwards from the anchor; right: from the anchor on. Covered is what
    agrees with some other member over `length` bytes or more around the anchor.
    """
    m = len(left)
    lo, hi = np.full(m, -1), np.full(m, -1)
    order = sorted(range(m), key=right.__getitem__)
    rights, r_len = _matrix([right[i] for i in order], length)
    lefts, l_len = _matrix([left[i] for i in order], length - k)
    rank = np.empty(m, np.int64)
    rank[sorted(range(m), key=lambda i: left[order[i]])] = np.arange(m)
    lcp = _agree(rights[1:], rights[:-1], np.minimum(r_len[1:], r_len[:-1]))
    for value, first, last in prefix_intervals(lcp, k):
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[members])]
        near = _agree(lefts[members[1:]], lefts[members[:-1]], np.minimum(l_len[members[1:]], l_len[members[:-1]]))
        most = np.maximum(np.concatenate(([-1], near)), np.concatenate((near, [-1])))
        full = most + value >= length
        own = np.asarray(order)[members[full]]
        lo[own] = np.maximum(lo[own], most[full])
        hi[own] = np.maximum(hi[own], value)
    return lo, hi


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _meet(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(tid, start, end) covered, from rows (h, x, y, tid, pos, n, left, right) sorted by (h, x, y).

    n: places with these contexts at this offset of a text; a text's context that occurs twice covers itself.
    """

    def group(own: list) -> Iterator[tuple]:
        seen: dict[tuple[bytes, bytes], list] = {}
        for tid, pos, left, right in own:
            seen.setdefault((left, right), []).append((tid, pos))
        keys = list(seen)
        if len(keys) > 1:
            lo, hi = extents([x[0] for x in keys], [x[1] for x in keys], length, k)
        else:
            lo = hi = np.array([-1])
        for key, a, b in zip(keys, lo.tolist(), hi.tolist()):
            if len(seen[key]) > 1 and len(key[0]) + len(key[1]) >= length:
                a, b = len(key[0]), len(key[1])
            if b >= 0:
                yield from ((tid, pos - a, pos + b) for tid, pos in seen[key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, out = None, [], []

        def done():
            b = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.int64()))], names=["tid", "start", "end"])
            out.clear()
            return b

        for batch in batches:
            for h, x, y, *row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if at != (h, x, y):
                    if len(own) > 1:
                        out.extend(group(own))
                    at, own = (h, x, y), []
                own.append(row)
            yield done()
        if len(own) > 1:
            out.extend(group(own))
        yield done()

    return rows.mapInArrow(run, "tid binary, start long, end long")


def _tid(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _same_text(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted (tid, rep, ...) with the text of one of its rows."""
    rows = id_text(docs, id_col, text_col).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).drop("doc_id", "rep")
    return rows.select("tid", "text", *(c for c in rows.columns if c not in ("tid", "text")))


def _units(raw: bytes, unit: str) -> bytes:
    """What repeats are sought in: the text's bytes, or CODE bytes of hash for each word, ASCII letters in lower case."""
    return raw if unit == "byte" else hash_words(raw.lower().split()).tobytes()


def _in_text(raw: bytes, spans: list[tuple[int, int]], unit: str, length: int) -> list[tuple[int, int]]:
    """Spans of the text that spans of its units stand for; of words, from the first one's start to the last one's end."""
    if unit == "byte" or not spans:
        return spans
    at = [m.span() for m in WORD.finditer(raw)]
    words = [(-(-s // CODE), e // CODE) for s, e in spans]
    return [(at[s][0], at[e - 1][1]) for s, e in words if e - s >= length]


def _prepared(docs: DataFrame, length: int, k: int, block: int, unit: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with their anchors, distinct texts, those that share anchors or cover themselves, contexts dealt by anchor); length counts bytes of units."""

    def scan(b: pa.RecordBatch) -> dict:
        out = {"doc_id": b.column(0), "tid": [], "n_bytes": [], "n_units": [], "sha": [], "anchors": [], "spans": []}
        for raw in raw_bytes(b):
            units = _units(raw, unit)
            at, hs, spans = anchors(units, length, k)
            out["tid"].append(_tid(raw))
            out["n_bytes"].append(len(raw))
            out["n_units"].append(len(units))
            out["sha"].append(hashlib.sha256(raw).hexdigest())
            out["anchors"].append([{"h": h, "pos": p} for h, p in zip(hs.view(np.int64).tolist(), at.tolist())])
            out["spans"].append([{"start": s, "end": e} for s, e in spans])
        return out

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:long,end:long>>"
    base = materialize(arrow_map(rows, scan, f"doc_id {kind}, tid binary, n_bytes long, n_units long, sha string, anchors array<struct<h:long,pos:long>>, spans {span}", rows=500), "anchors")
    texts = materialize(base.where(F.col("n_units") >= length).groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "texts")

    posts = base.select("tid", F.explode("anchors").alias("a")).select("tid", "a.h", "a.pos").distinct()
    shared = posts.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    found = posts.join(shared, "h").groupBy("tid").agg(F.collect_list(F.struct("h", "pos", "n")).alias("at"))
    runs = base.where(F.size("spans") > 0).select("tid", "spans").dropDuplicates(["tid"])
    wanted = found.join(runs, "tid", "full").join(texts, "tid").where("copies = 1 or at is not null").select("tid", "rep", "copies", "at", "spans")

    def right(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([_tid(raw) == t for raw, t in zip(raw_bytes(b), b.column(0).to_pylist())]))

    near = materialize(arrow_map(_same_text(docs, wanted, id_col, text_col), right, f"tid binary, text string, copies long, at array<struct<h:long,pos:long,n:long>>, spans {span}", rows=500), "near")

    def contexts(b: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("tid", "h", "pos", "n", "left", "right")}
        for raw, tid, at in zip(raw_bytes(b), b.column(0).to_pylist(), b.column(2).to_pylist()):
            raw = _units(raw, unit) if at else raw
            for x in at or ():
                p = x["pos"]
                for c, v in zip(out, (tid, x["h"], p, x["n"], raw[max(0, p - length + k) : p][::-1], raw[p : p + length])):
                    out[c].append(v)
        return out

    met = arrow_map(near.select("tid", "text", "at"), contexts, "tid binary, h long, pos long, n long, left binary, right binary", rows=256)
    parts = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("mine", F.pmod(F.xxhash64("tid", "pos"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = met.select("h", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "tid", "pos", "left", "right")
    return base, texts, near, met.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")


def remove_repeats(docs: DataFrame, length: int = 400, k: int | None = None, block: int = 4096, keep_text: bool = False, unit: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs.

    Removed is each byte within a string of `length` bytes that also starts
    anywhere else, in the same text or another; overlaps count, matches don't
    cross texts. With keep_text the rows carry all their columns and kept_text
    (what is left, without parts of characters at cuts). Null and empty texts,
    and texts shorter than `length`, keep all; rows with equal or null ids are
    texts of their own; an empty table gives no rows. k: bytes of an anchor,
    by default a quarter of `length`. unit 'word': length counts words (runs of
    bytes but ASCII white space, ASCII letters in either case alike), and what
    is removed goes from the first word's start to the last one's end.
    Very long texts are taken whole; extra columns are carried with keep_text.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    least, length = length, length if unit == "byte" else length * CODE
    k = k or max(1, length // 4)
    base, texts, near, met = _prepared(docs, length, k, block, unit, id_col, text_col)
    cut = _meet(met, length, k).groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))

    def remove(b: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("tid", "n_removed", "n_spans", "kept_sha256", "kept_text")}
        for tid, raw, own, cuts in zip(b.column(0).to_pylist(), raw_bytes(b), b.column(2).to_pylist(), b.column(3).to_pylist()):
            spans = _in_text(raw, _merged([(x["start"], x["end"]) for x in [*(own or ()), *(cuts or ())]]), unit, least)
            left, at = [], 0
            for s, e in spans:
                left.append(raw[at:s])
                at = e
            left.append(raw[at:])
            for c, v in zip(out, (tid, sum(e - s for s, e in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest(), "".join(x.decode(errors="ignore") for x in left) if keep_text else None)):
                out[c].append(v)
        return out

    changed = near.where("copies = 1").select("tid", "text", "spans").join(cut, "tid", "left").where("spans is not null or cuts is not null")
    changed = arrow_map(changed, remove, "tid binary, n_removed long, n_spans long, kept_sha256 string, kept_text string", rows=500)
    copied = texts.where("copies > 1").select("tid", F.lit(True).alias("copied"))
    result = changed.join(copied, "tid", "full")
    if keep_text:
        result = materialize(result, "cuts")
        carry = tuple(c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", id_col) and not c.startswith("_own_"))
        schema = f"doc_id {kind}, _own_tid binary, _own_bytes long"
        kept = arrow_map(id_text(docs, id_col, text_col, carry), lambda b: {"doc_id": b.column(0), "_own_tid": [_tid(r) for r in raw_bytes(b)], "_own_bytes": [len(r) for r in raw_bytes(b)]}, schema, carry=carry, text_col=text_col)
        base = kept.withColumn("_own_sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    else:
        carry, base = (), base.select("doc_id", F.col("tid").alias("_own_tid"), F.col("n_bytes").alias("_own_bytes"), F.col("sha").alias("_own_sha"))
    # names of their own, as what is carried can have any
    own = result.select(F.col("tid").alias("_own_tid"), *(F.col(c).alias(f"_own_{c}") for c in result.columns if c != "tid"))
    out, all_ = base.join(own, "_own_tid", "left"), F.coalesce("_own_copied", F.lit(False))
    columns = [
        "doc_id",
        F.col("_own_bytes").alias("n_bytes"),
        F.when(all_, F.col("_own_bytes")).otherwise(F.coalesce("_own_n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, 1).otherwise(F.coalesce("_own_n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("_own_kept_sha256", "_own_sha")).alias("kept_sha256"),
    ]
    if keep_text:
        columns += [F.when(all_, F.lit("")).otherwise(F.coalesce("_own_kept_text", F.col(text_col), F.lit(""))).alias("kept_text"), *carry]
    return out.select(*columns)


def repeat_sets(left: list[bytes], right: list[bytes], length: int, k: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of each maximal string of `length` or more around one anchor: none of its members' extensions agrees for all of them."""
    order = sorted(range(len(left)), key=right.__getitem__)
    rights, r_len = _matrix([right[i] for i in order], max(map(len, right)))
    lefts, l_len = _matrix([left[i] for i in order], max(1, *map(len, left)))
    rank = np.empty(len(left), np.int64)
    rank[sorted(range(len(left)), key=lambda i: left[order[i]])] = np.arange(len(left))
    lcp = _agree(rights[1:], rights[:-1], np.minimum(r_len[1:], r_len[:-1]))
    for value, first, last in prefix_intervals(lcp, k):
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[members])]
        near = _agree(lefts[members[1:]], lefts[members[:-1]], np.minimum(l_len[members[1:]], l_len[members[:-1]]))
        least = max(0, length - value)
        spans = list(prefix_intervals(near, max(1, least))) + ([(0, 0, len(members) - 1)] if not least and not near.min() else [])
        for before, lo, hi in spans:
            own = members[lo : hi + 1]
            if lcp[own.min() : own.max()].min() == value:  # else a deeper interval has them
                yield before, value, np.asarray(order)[own].tolist()


def repeat_groups(docs: DataFrame, length: int = 400, k: int | None = None, block: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, length, whole, doc_id, start): every occurrence of every maximal repeated string of `length` bytes or more.

    repeat: a hash of the string; start in bytes. A string is taken where one of
    its own anchors lies, which all of its occurrences share. Its contexts reach
    `length` bytes to the right of that and `length` - k to the left: longer
    strings come as pieces cut there (whole false). Inside a long periodic run
    there are no anchors but near its ends; texts that are equal count as many
    times as they occur. For an anchor with more contexts than `block`, maximal
    means within a pair of blocks. Null, empty and short texts have none.
    """
    k = k or max(1, length // 4)
    base, _, _, met = _prepared(docs, length, k, block, "byte", id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []

        def done():
            seen: dict[tuple[bytes, bytes], list] = {}
            for tid, pos, left, right in own:
                seen.setdefault((left, right), []).append((tid, pos))
            keys, out = list(seen), ([], [], [], [], [])
            sets = list(repeat_sets([x[0] for x in keys], [x[1] for x in keys], length, k)) if len(keys) > 1 else []
            sets += [(len(x[0]), len(x[1]), [i]) for i, x in enumerate(keys) if len(seen[x]) > 1 and len(x[0]) + len(x[1]) >= length]
            for before, after, members in sets:
                left, right = keys[members[0]]
                text = left[:before][::-1] + right[:after]
                if before in anchors(text, length, k)[0]:
                    name, whole = xxhash.xxh3_128_digest(text), before < length - k and after < length
                    for i in members:
                        for tid, pos in seen[keys[i]]:
                            for c, v in zip(out, (name, len(text), whole, tid, pos - before)):
                                c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()))], names=["repeat", "length", "whole", "tid", "start"])

        for batch in batches:
            for h, x, y, *row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if at != (h, x, y):
                    if len(own) > 1:
                        yield done()
                    at, own = (h, x, y), []
                own.append(row)
        if len(own) > 1:
            yield done()

    found = met.mapInArrow(run, "repeat binary, length long, whole boolean, tid binary, start long").distinct()
    return found.join(base.select("tid", "doc_id"), "tid").select("repeat", "length", "whole", "doc_id", "start")
