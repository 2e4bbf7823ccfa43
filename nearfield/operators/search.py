"""Beam search over a neighbour graph, navigation layers, recall and traces."""

from __future__ import annotations

import functools
import itertools
import pickle
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut, scratch_root
from . import stores
from .caching import latency_percentiles, ranked
from .codecs import _by_degree, decode_rows, encode

#: Queries that a worker takes along at once; marks of what they have seen take at most SEEN bytes.
TOGETHER, SEEN = 256, 64 << 20
#: Neighbours of a hop, of all queries that go together: long rows take fewer queries.
CELLS = 1 << 20
#: Pairs whose vectors are held at once, however long rows are: few enough for a cache.
PAIRS = 1 << 10
#: Bytes of vectors that a partition of a search by joins holds.
PART_BYTES = 16 << 20
#: Nodes of a pool whose rows a search by joins fetches together.
AHEAD = 3


def _distances(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    return -(v * q).sum(-1) if metric == "ip" else ((v - q) ** 2).sum(-1)


def _pairs(v: np.ndarray, at: np.ndarray, q: np.ndarray, row: np.ndarray, metric: str) -> np.ndarray:
    """Distances of v[at] and q[row], some pairs at a time."""
    return np.concatenate([np.empty(0), *(_distances(v[at[p : p + PAIRS]], q[row[p : p + PAIRS]], metric) for p in range(0, len(at), PAIRS))])


def _descend(v: np.ndarray, layers: list, q: np.ndarray, entry: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries below, hops, distances) of all rows of q at once: in each layer on to the nearest neighbour as long as one is nearer; a node's row costs a hop, edges or not."""
    many = len(q)
    at, hops, dists = np.full(many, entry), np.zeros(many, np.int64), np.full(many, len(layers) > 0, np.int64)
    best = _distances(v[at], q, metric)
    for layer in layers:
        on = np.arange(many)
        while len(on):
            near = layer.rows(at[on])
            row, col = np.nonzero(near >= 0)
            hops[on] += 1
            dists[on] += np.bincount(row, minlength=len(on))
            d = np.full((len(on), near.shape[1] + 1), np.inf)
            d[row, col] = _pairs(v, near[row, col], q, on[row], metric)
            d[np.isnan(d)] = np.inf
            k = d.argmin(1)
            better = d[np.arange(len(on)), k] < best[on]
            on, next_, k = on[better], near[better], k[better]
            at[on], best[on] = next_[np.arange(len(on)), k], d[better][np.arange(len(on)), k]
    return at, hops, dists


def search_together(v: np.ndarray, store, layers: list, q: np.ndarray, size: int, entry: int, metric: str):
    """(pool distances, pool places, hops, distances, expanded, touched) of all rows of q at once.

    Every query expands the nearest unexpanded of its best `size` until it has
    none; those that still have one go on together, a hop at a time.
    """
    n, many = len(v), len(q)
    first, hops, dists = _descend(v, layers, q, entry, metric)
    pool_d, pool_i, closed = np.full((many, size), np.inf), np.full((many, size), n), np.ones((many, size), bool)
    pool_d[:, 0], pool_i[:, 0], closed[:, 0] = _distances(v[first], q, metric), first, False
    seen, expanded = np.zeros((many, n), bool), np.zeros((many, n), bool)
    seen[np.arange(many), first] = True
    dists, on = dists + 1, np.arange(many)
    while True:
        open_ = ~closed[on]
        on, open_ = on[open_.any(1)], open_[open_.any(1)]
        if not len(on):
            return pool_d, pool_i, hops, dists, expanded, seen
        place = open_.argmax(1)
        at = pool_i[on, place]
        closed[on, place] = expanded[on, at] = True
        hops[on] += 1
        near = np.sort(store.rows(at), axis=1)
        fresh = (near >= 0) & ~seen[on[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(fresh)
        new = near[row, col]
        seen[on[row], new] = True
        dists[on] += fresh.sum(1)
        d = np.full(near.shape, np.inf)
        d[row, col] = _pairs(v, new, q, on[row], metric)
        all_d, all_i, all_c = np.hstack((pool_d[on], d)), np.hstack((pool_i[on], np.where(fresh, near, n))), np.hstack((closed[on], ~fresh))
        order = np.lexsort((all_i, all_d), axis=1)[:, :size]
        pool_d[on], pool_i[on], closed[on] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_c))


def _levels(layer_edges: DataFrame) -> range:
    """All levels down to the last with an edge; one without any still costs a hop."""
    last = layer_edges.agg(F.max("level")).first()[0]
    return range(0 if last is None else last + 1)


def _vectors(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) in the order of ids, without a Python object for each."""
    got = base.select(F.col("id").cast("long"), F.col("v").cast("array<double>")).toArrow().sort_by("id").combine_chunks()
    flat = got.column("v").combine_chunks().flatten().to_numpy()
    return got.column("id").to_numpy(), flat.reshape(len(got), -1) if len(got) else np.empty((0, 0))


def compact(matrix: np.ndarray) -> np.ndarray:
    """The same numbers in half the bytes, if all of them are single precision; what is computed from them is in doubles."""
    with np.errstate(over="ignore"):
        small = matrix.astype(np.float32)
    return small if np.array_equal(small, matrix, equal_nan=True) else matrix


class Held:
    """What a search sends to every worker, sent once: the vectors (ids, matrix) and a store; and the number of nodes, the first of the vectors, and how many queries go together."""

    def __init__(self, vectors, store, n: int, together: int):
        self.vectors, self.store, self.n, self.together = vectors, store, n, together


def hold(base: DataFrame, edges: DataFrame, store: str = "raw", hot: DataFrame | None = None, partition: int = 32_000, offsets: str = "raw32", sent=None) -> Held | None:
    """What searches of this graph can share; None where it is over stores.BROADCAST_BYTES, so that they run as joins. sent: broadcast vectors (ids, matrix) that begin with base's, if there are any."""
    n, width = base.count(), len(base.select("v").first()[0])
    rows = stores.edges_bytes(edges, n)
    if 4 * n * width + rows > stores.BROADCAST_BYTES:
        return None
    if 8 * n * width + rows > stores.BROADCAST_BYTES:  # if all are single precision they take half of that
        single = F.forall("v", lambda x: x.cast("float").cast("double").eqNullSafe(x.cast("double")))
        if base.where(~single).limit(1).count():
            return None
    if not sent:
        ids, matrix = _vectors(base)
        if len(ids) and ids[-1] != n - 1:
            raise ValueError("nodes must be numbered from 0 to n - 1")
        sent = base.sparkSession.sparkContext.broadcast((ids, compact(matrix)))
    own, most = stores.build(edges, n, store, hot, partition, offsets), edges.groupBy("src").count().agg(F.max("count")).first()[0] or 1
    return Held(sent, base.sparkSession.sparkContext.broadcast(own), n, max(1, min(TOGETHER, SEEN // max(1, 2 * n), CELLS // most)))


def beam_search(
    base: DataFrame, edges: DataFrame, queries: DataFrame, size: int = 64, k: int = 10, entry: int = 0, metric: str = "l2", layer_edges: DataFrame | None = None, trace: bool = False, store: str = "raw", hot: DataFrame | None = None, partition: int = 32_000, offsets: str = "raw32", held: Held | None = None
) -> DataFrame:
    """(q, rank, id, hops, dists), or with trace (q, id, expand, touch), for queries (q, v) over nodes 0 to n - 1.

    The pool is ordered by (distance, id), so results depend neither on labels
    nor on the store, which says how neighbours are held (stores.NAMES, with
    hot ids for tiers). layer_edges (level, src, dst), top level 0, are
    descended greedily first. Vectors and store go to every worker as flat
    arrays as long as they are under stores.BROADCAST_BYTES together; beyond
    that the search runs as joins, in rounds, with the same results.
    held: hold() of the same graph and store, if several searches share it.
    """
    held = held or hold(base, edges, store, hot, partition, offsets)
    if not held:
        return beam_search_joins(base, edges, queries, size, k, entry, metric, trace, layer_edges, store if store in ("rowef", "rowbic", "rowpack") else None)
    levels = _levels(layer_edges) if layer_edges is not None else ()
    steps, sent, together = [stores.build(layer_edges.where(F.col("level") == x).select("src", F.col("dst").alias("pos"), "dst"), held.n) for x in levels], (held.vectors, held.store), held.together
    n = held.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, own = sent[0].value[1][:n], sent[1].value
        for whole in batches:
            for s in range(0, whole.num_rows, together):
                batch = whole.slice(s, together)
                q = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy().reshape(len(q), -1)
                d, at, hops, dists, expanded, seen = search_together(v, own, steps, x, size, entry, metric)
                if trace:
                    row, node = np.nonzero(seen)
                    cols = [q[row], node, expanded[row, node].astype(np.int64), np.ones(len(row), np.int64)]
                else:
                    row, rank = np.nonzero(np.isfinite(d[:, :k]))
                    cols = [q[row], (rank + 1).astype(np.int32), at[row, rank], hops[row], dists[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "id", "expand", "touch"] if trace else ["q", "rank", "id", "hops", "dists"])

    spread = queries.select(F.col("q").cast("long"), F.col("v").cast("array<double>")).repartition(base.sparkSession.sparkContext.defaultParallelism, "q")
    return spread.mapInArrow(run, "q long, id long, expand long, touch long" if trace else "q long, rank int, id long, hops long, dists long")


def searched_rows(held: Held, queries: DataFrame, size: int, entry: int, degree: int, alpha: float, metric: str = "l2") -> DataFrame:
    """(src, dst) of what RobustPrune keeps of the nodes that a search for each of queries (q, v) expands and of q's own neighbours; q is a number among held's vectors. A task prunes what it has found, so that candidates don't move."""
    from .vectors import _pruned

    sent, together, n = (held.vectors, held.store), held.together, held.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, own = sent[0].value[1], sent[1].value
        for whole in batches:
            for s in range(0, whole.num_rows, together):
                batch = whole.slice(s, together)
                q = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy().reshape(len(q), -1)
                expanded = search_together(v[:n], own, [], x, size, entry, metric)[4]
                known = np.flatnonzero(q < n)
                near = own.rows(q[known])
                row, col = np.nonzero(near >= 0)
                expanded[known[row], near[row, col]] = True
                expanded[known, q[known]] = False
                row, at = _pruned(v, v, q, *np.nonzero(expanded), degree, alpha)
                yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(at)], names=["src", "dst"])

    spread = queries.select(F.col("q").cast("long"), F.col("v").cast("array<double>")).repartition(3 * queries.sparkSession.sparkContext.defaultParallelism, "q")
    return spread.mapInArrow(run, "src long, dst long")


def _union(parts) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _adjacent(edges: DataFrame) -> DataFrame:
    """(at, ids): a row for each node that has edges."""
    return edges.groupBy(F.col("src").alias("at")).agg(F.collect_list("dst").alias("ids"))


def _binary(df: DataFrame) -> DataFrame:
    """(key, v array<double>) with each vector as its bytes, which pass between the JVM and Python whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], names=names)

    names = df.columns
    return df.select(F.col(names[0]).cast("long"), F.col(names[1]).cast("array<double>")).mapInArrow(run, f"{names[0]} long, {names[1]} binary")


def _of_bytes(column: pa.Array) -> np.ndarray:
    """The matrix of a column of vectors as bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(float).reshape(len(column), -1)


#: What a round brings a walk: a row's key, a neighbour in it and its distance.
MET = np.dtype([("at", np.int64), ("id", np.int64), ("d", float)])


class _Walk:
    """Where a query of a search by joins stands: in which layer and at which node, or its pool; and rows that were fetched ahead."""

    def __init__(self, q: int, entry: int, best: float):
        self.q, self.level, self.at, self.best, self.hops, self.dists = q, 0, entry, best, 0, 1
        self.pool, self.seen, self.expanded, self.rows = [], set(), set(), {}

    def go(self, size: int, levels: int, n: int, ahead: int) -> list[int]:
        """All hops whose rows are there; returns the keys of the rows that are wanted next, none at the end. rows: (distance, id) of neighbours by key, which is the node, or n times the layer more; without layers there was one distance only."""
        while self.level < levels:
            key = n * (1 + self.level) + self.at
            if key not in self.rows:
                return [key]
            near = self.rows.pop(key)
            self.hops, self.dists = self.hops + 1, self.dists + len(near)
            best, at = min((x for x in near if x[0] == x[0]), default=(np.inf, -1))
            if best < self.best:
                self.best, self.at = best, at
            else:
                self.level += 1
                self.dists += self.level == levels
        if not self.seen:
            self.pool, self.seen = [(self.best, self.at)], {self.at}
        while True:
            wanted = [i for _, i in self.pool if i not in self.expanded][:ahead]
            if not wanted or wanted[0] not in self.rows:
                return [i for i in wanted if i not in self.rows]
            near = {i: d for d, i in self.rows.pop(wanted[0]) if i not in self.seen}
            self.expanded.add(wanted[0])
            self.seen.update(near)
            self.hops, self.dists = self.hops + 1, self.dists + len(near)
            self.pool = sorted(x for x in (*self.pool, *((d, i) for i, d in near.items())) if x[0] == x[0])[:size]


def beam_search_joins(
    base: DataFrame, edges: DataFrame, queries: DataFrame, size: int = 64, k: int = 10, entry: int = 0, metric: str = "l2", trace: bool = False, layer_edges: DataFrame | None = None, codec: str | None = None, ahead: int = AHEAD
) -> DataFrame:
    """beam_search() as a loop of joins; nothing is broadcast that grows. codec: rows are coded once and decoded where they are read.

    Vectors and rows are dealt by node and sorted once, and stay so (on disk
    where memory ends), as every round reads them; a round writes its state
    once. Rows of the `ahead` nearest unexpanded nodes of a pool are fetched
    together, so that a round can take several hops; their order, and what
    counts as a hop, a distance or touched, is that of one hop a round. Layers
    are descended in the same rounds, each query at its own pace.
    """
    spark, path, n = base.sparkSession, f"{scratch_root(base.sparkSession)}/{uuid.uuid4().hex}", base.count()
    start = base.where(F.col("id") == entry).select(F.col("v").cast("array<double>").alias("v")).first()
    start = np.array(start.v if start else [])
    parts = max(spark.sparkContext.defaultParallelism, -(-8 * n * max(1, len(start)) // PART_BYTES))
    dealt = lambda df, key: df.repartition(parts, key).sortWithinPartitions(key).persist()
    levels = len(_levels(layer_edges)) if layer_edges is not None else 0
    layers = [layer_edges.select((F.col("src") + n * (1 + F.col("level"))).alias("src"), "dst")] if levels else []
    if codec:
        rows = [dealt(encode(edges, n, codec).select(F.col("src").alias("at"), "data", "deg"), "at"), *(dealt(_adjacent(x), "at") for x in layers)]
    else:
        rows = [dealt(_adjacent(_union([edges.select("src", "dst"), *layers])), "at")]
    vectors = dealt(_binary(base.select(F.col("id").alias("dst"), F.col("v").alias("w"))), "dst")
    names = ["row", "v", "walk", "ask"]

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=names)

    def began(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, q, v in zip(*(b.column(c).to_pylist() for c in ("row", "q", "v"))):
                walk = _Walk(q, entry, float(_distances(start, np.frombuffer(v), metric)))
                ask = walk.go(size, levels, n, ahead)
                out.append((row, v, pickle.dumps(walk), ask))
            yield batch(out)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, out = b.column("data").to_pylist(), np.empty(b.num_rows, object)
            for deg, some in _by_degree(b.column("deg").to_numpy()) if b.num_rows else ():
                for i, ids in zip(some.tolist(), decode_rows([data[i] for i in some.tolist()], deg, n, codec)):
                    out[i] = ids
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), b.column("at"), pa.array(out.tolist(), pa.list_(pa.int64()))], names=["row", "v", "at", "ids"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each walk of a batch, with its neighbours as the bytes of MET."""
        for b in batches:
            if b.num_rows:
                row, x, v = b.column("row").to_numpy(), _of_bytes(b.column("w")), _of_bytes(b.column("v"))
                order = np.argsort(row, kind="stable")
                met = np.empty(len(row), MET)
                met["at"], met["id"] = b.column("at").to_numpy(), b.column("dst").to_numpy()
                met["d"] = np.concatenate([_distances(x[p : p + PAIRS], v[p : p + PAIRS], metric) for p in range(0, len(row), PAIRS)])
                first = np.flatnonzero(np.diff(row[order], prepend=-1))
                data, ends = met[order].tobytes(), MET.itemsize * np.append(first, len(row))
                yield pa.RecordBatch.from_arrays([pa.array(row[order][first]), pa.array([data[i:j] for i, j in itertools.pairwise(ends.tolist())], pa.binary())], names=["row", "met"])

    def went(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = None, []

        def end(row: int, v: bytes, ask: list, walk: _Walk, parts: list) -> tuple:
            met = np.frombuffer(b"".join(parts), MET)
            walk.rows.update({key: [] for key in ask})
            for at, d, i in zip(*(met[c].tolist() for c in ("at", "d", "id"))):
                walk.rows[at].append((d, i))
            ask = walk.go(size, levels, n, ahead)
            return row, v, pickle.dumps(walk), ask

        for b in batches:
            met = b.column("met")
            heads = np.flatnonzero(~np.asarray(b.column("walk").is_null()))
            if own:  # what follows belongs to the last walk of the batch before
                own[4].extend(met[: heads[0] if len(heads) else b.num_rows].to_pylist())
            for (row, v, walk, ask), i, j in zip(zip(*(b.column(c).take(pa.array(heads)).to_pylist() for c in names)), heads.tolist(), [*heads[1:].tolist(), b.num_rows]):
                if own:
                    out.append(end(*own))
                if len(out) >= 1024:
                    yield batch(out)
                    out = []
                own = row, v, ask, pickle.loads(walk), met[i + 1 : j].to_pylist()
        yield batch([*out, *([end(*own)] if own else [])])

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for walk in map(pickle.loads, b.column(0).to_pylist()):
                if trace:
                    out += [(walk.q, i, int(i in walk.expanded), 1) for i in walk.seen]
                else:
                    out += [(walk.q, r, i, walk.hops, walk.dists) for r, (d, i) in enumerate(walk.pool[:k], 1) if np.isfinite(d)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=["q", "id", "expand", "touch"] if trace else ["q", "rank", "id", "hops", "dists"])

    kinds, schema, turn = [pa.int64()] * 4 if trace else [pa.int64(), pa.int32(), *[pa.int64()] * 3], "row long, v binary, walk binary, ask array<long>", 0
    first = _binary(queries.select("q", "v")).repartition(parts, "q").withColumn("row", F.monotonically_increasing_id())  # queries can have one name
    state = (first if len(start) else first.limit(0)).mapInArrow(began, schema)
    try:
        while True:
            state.write.parquet(f"{path}/{turn}")
            state = spark.read.schema(schema).parquet(f"{path}/{turn}").where("size(ask) > 0")  # the others have ended with this round
            turn += 1
            if state.select("row").isEmpty():
                break
            ask = state.select("row", "v", F.explode("ask").alias("at"))
            near = [ask.join(x, "at") for x in rows]
            if codec:
                near[0] = near[0].select("row", "v", "at", "data", "deg").mapInArrow(opened, "row long, v binary, at long, ids array<long>")
            near = _union(x.select("row", "v", "at", F.explode("ids").alias("dst")) for x in near)
            near = near.join(vectors, "dst").select("row", "v", "at", "dst", "w").mapInArrow(measured, "row long, met binary")
            both = state.unionByName(near, allowMissingColumns=True).repartition(parts, "row").sortWithinPartitions("row", F.col("walk").isNull())
            state = both.mapInArrow(went, schema)
    finally:
        vectors.unpersist()
        for x in rows:
            x.unpersist()
    done = spark.read.schema(schema).parquet(*(f"{path}/{x}" for x in range(turn))).where("size(ask) = 0").select("walk")
    return done.mapInArrow(ended, "q long, id long, expand long, touch long" if trace else "q long, rank int, id long, hops long, dists long")


class Timed:
    """found: a search's rows, as a table; times: mean, median and 99th percentile of a query's microseconds in the last repeat, queries a second in the best."""

    def __init__(self, found: DataFrame, times: dict):
        self.found, self.times = found, times


def timed_search(base: DataFrame, edges: DataFrame, queries: DataFrame, size: int = 64, k: int = 10, entry: int = 0, metric: str = "l2", repeats: int = 3, store: str = "raw") -> Timed:
    """beam_search() after a warm-up, `repeats` times. Queries of a batch go together, so a query's time is its share of the batch's by hops."""
    count, best, found = queries.count(), float("inf"), None
    df = beam_search(base, edges, queries, size, k, entry, metric, store=store)
    for turn in range(repeats + 1):
        began = time.perf_counter()
        found = cut(df)
        took = time.perf_counter() - began
        best = took if turn == 1 else min(best, took) if turn else best
    own = found.groupBy("q").agg(F.first("hops").alias("hops"))
    own = own.withColumn("us", F.col("hops") * F.lit(1e6 * took / max(1, own.agg(F.sum("hops")).first()[0] or 0)))
    r = latency_percentiles(own.withColumn("all", F.lit(1)), ["all"], "us").first()
    return Timed(found, {"qps": count / best, "mean_us": r["mean"], "p50_us": r["p50"], "p99_us": r["p99"]})


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (queries, recall, hops, dists): hits among the first k of truth (q, rank, id) over queries * k."""
    hits = results.join(truth.where(F.col("rank") <= k).select("q", "id"), ["q", "id"], "left_semi").agg(F.count("*").alias("hits"))
    own = results.groupBy("q").agg(F.first("hops").alias("hops"), F.first("dists").alias("dists")).agg(F.count("*").alias("queries"), F.avg("hops").alias("hops"), F.avg("dists").alias("dists"))
    return own.join(hits).select("queries", (F.col("hits") / (F.col("queries") * k)).alias("recall"), "hops", "dists")


def recall_sweep(base: DataFrame, edges: DataFrame, queries: DataFrame, truth: DataFrame, sizes: list[int], k: int = 10, entry: int = 0, metric: str = "l2", store: str = "raw") -> DataFrame:
    """recall() for each pool size; k is the size where that is smaller."""
    parts = [recall(beam_search(base, edges, queries, s, min(k, s), entry, metric, store=store), truth, min(k, s)).select(F.lit(s).alias("L"), "queries", "recall", "hops", "dists") for s in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def access_profile(trace: DataFrame, n: int) -> DataFrame:
    """(id, expand, touch) over all nodes, from traces (q, id, expand, touch)."""
    count = trace.groupBy("id").agg(F.sum("expand").alias("expand"), F.sum("touch").alias("touch"))
    return trace.sparkSession.range(n).join(count, "id", "left").na.fill(0)


def nav_layers(scores: DataFrame, sizes: list[int]) -> DataFrame:
    """(level, id): nested subsets of the highest score, ties to the smaller id; level 0 is the smallest."""
    top = ranked(scores).where(F.col("rank") <= max(sizes))
    goals = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.lit(s).alias("size")) for level, s in enumerate(sorted(sizes))))).alias("x")
    return top.select("id", "rank", goals).where("rank <= x.size").select("x.level", "id")
