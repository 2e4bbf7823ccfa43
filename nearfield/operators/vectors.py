"""Exact nearest neighbours, neighbour graphs and their pruning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut, drop, numbered

#: Values of vectors that go to every task: 64 MB, as in searches.
BLOCK_VALUES = 8 << 20
#: Pairs of a screen that are held at once.
PAIRS = 2_000_000


def with_queries(embeddings: DataFrame, id_col: str = "vec_id", v_col: str = "embedding", modulus: int = 20) -> tuple[DataFrame, DataFrame]:
    """(base, queries): all rows (id, v, vec_id), numbered densely in the order of vec_id (null ids last), and of them those whose vec_id is divisible by modulus as queries (q, v)."""
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(v_col).cast("array<double>").alias("v"))
    base = numbered(rows, F.col("vec_id").asc_nulls_last(), name="id").select("id", "v", "vec_id")
    return base, rows.where(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("q"), "v")


def _nearest(ids: np.ndarray, q: np.ndarray, own: np.ndarray, v: np.ndarray, k: int, metric: str, loops: bool, some: int = 512, wide: int = 1024) -> pd.DataFrame:
    """(q, id, d): of rows (own, v), the k nearest to each of (ids, q) by (distance, id).

    Products of matrices screen the pairs: what is beyond the k-th nearest by
    more than their rounding is none of the k. Distances of the others are
    computed one by one, and only those count. A vector with a NaN is near to
    nothing.
    """
    known = [~np.isnan(m).any(1) for m in (q, v)]
    ids, q = (ids, q) if known[0].all() else (ids[known[0]], q[known[0]])
    own, v = (own, v) if known[1].all() else (own[known[1]], v[known[1]])
    with np.errstate(all="ignore"):
        centre = v.mean(0) if metric != "ip" and len(v) else 0
        moved = v - centre
        squares = np.einsum("ij,ij->i", moved, moved)
        most = squares.max(initial=0) + np.einsum("ij,ij->i", q - centre, q - centre).max(initial=0)
    bounded, out, todo = np.isfinite(most), [], []
    if metric != "ip":  # squares are a column of their own, so that a product is all there is to do
        moved = np.hstack((moved, squares[:, None]))
    forms = [moved] if bounded else []
    if bounded and 1e-30 < most < 1e30:  # nothing that counts is lost in single precision, which goes first; double has less slack
        forms.insert(0, moved.astype(np.float32))
    for s in range(0, len(ids), some):
        todo = [slice(s, min(s + some, len(ids)))]
        while todo:
            at = todo.pop()
            x, names = q[at], ids[at]
            pairs = np.nonzero((names[:, None] != own[None]) | loops) if not bounded and len(x) == 1 else None
            for form in forms:
                pairs = _screened(names, x - centre, own, form, most, k, metric, loops, wide, None if len(x) == 1 and form is forms[-1] else PAIRS)
                if pairs:
                    break
            if pairs is None:  # many are equally near: fewer queries at a time
                middle = (at.start + at.stop) // 2
                todo += [slice(middle, at.stop), slice(at.start, middle)]
                continue
            row, col = pairs
            with np.errstate(all="ignore"):
                d = np.concatenate([np.empty(0), *(_each(x[row[p : p + wide]], v[col[p : p + wide]], metric) for p in range(0, len(row), wide))])
            order = np.lexsort((own[col], d, row))
            row, col, d = row[order], col[order], d[order]
            first = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (d < np.inf)
            out.append(pd.DataFrame({"q": names[row[first]], "id": own[col[first]], "d": d[first]}))
    return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "d": []}).astype({"q": "int64", "id": "int64"})


def _each(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    return -(x * y).sum(1) if metric == "ip" else ((y - x) ** 2).sum(1)


def _screened(names: np.ndarray, x: np.ndarray, own: np.ndarray, v: np.ndarray, most: float, k: int, metric: str, loops: bool, wide: int, pairs: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (row of x, row of v) that hold the k nearest of each row of x, and few others; None if a block holds more than `pairs`. v: vectors, and for distances their squares as a last column; most: bounds the squares of x and v.

    Products and marks stay in the same memory, small enough for a cache; blocks
    start small, as all of the first one is below its bounds. Slack follows the
    precision of v.
    """
    slack = 8 * (x.shape[1] + 8) * np.finfo(v.dtype).eps * most
    best, rows, cols, ds, held = np.full((len(x), k), np.inf), [], [], [], 0
    x = (-x if metric == "ip" else np.hstack((-2 * x, np.ones((len(x), 1))))).astype(v.dtype)
    mine = np.empty(0, np.int64) if loops else np.flatnonzero(np.isin(own, names))
    products, marks, s, step = np.empty(len(x) * wide, v.dtype), np.zeros(len(x) * wide + 8, bool), 0, min(wide, max(64, 4 * k))
    while s < len(v):
        size = min(step, len(v) - s)
        d = products[: len(x) * size].reshape(len(x), size)
        np.matmul(x, v[s : s + size].T, out=d)
        at = mine[slice(*np.searchsorted(mine, (s, s + size)))]
        if len(at):
            a, b = np.nonzero(names[:, None] == own[at][None])
            d[a, at[b] - s] = np.inf
        bound = np.minimum(best.max(1) + slack, np.finfo(v.dtype).max).astype(v.dtype)
        np.less_equal(d, bound[:, None], out=marks[: d.size].reshape(d.shape))
        marks[d.size : d.size + 8] = False
        on = (8 * np.flatnonzero(marks[: d.size + -d.size % 8].view(np.uint64))[:, None] + np.arange(8)).ravel()  # eight marks at a time: few are set
        row, col = np.divmod(on[marks[on]], size)
        near = d[row, col].astype(float)
        count = np.bincount(row, minlength=len(x))
        fresh = np.full((len(x), count.max(initial=0)), np.inf)
        fresh[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = near
        best = np.partition(np.hstack((best, fresh)), k - 1, axis=1)[:, :k]
        on = near <= best.max(1)[row] + slack
        held += np.count_nonzero(on)
        if pairs and held > pairs:
            return None
        rows.append(row[on])
        cols.append(col[on] + s)
        ds.append(near[on])
        s, step = s + size, min(wide, 2 * step)
    row, col = (np.concatenate([np.empty(0, np.int64), *z]) for z in (rows, cols))
    on = np.concatenate([np.empty(0), *ds]) <= best.max(1)[row] + slack
    return row[on], col[on]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def knn_exact(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", loops: bool = True, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(q, rank, id): the k nearest of base (id, v) to each of queries (q, v), rank from 1, ties to the smaller id.

    The side with fewer numbers, base if equal, goes to every task if it has up
    to block_values (they are counted first) and the other stays where it is,
    queries dealt evenly. Larger inputs are both dealt into blocks, and every
    pair of blocks is a task of its own: nothing passes through the driver.
    Only the k best of a task meet. metric: 'ip' (most inner product) or else squared L2,
    in doubles. loops: whether a vector may be its own neighbour.
    """
    found = _found(base, queries, k, metric, loops, block_values)[0]
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "id")


def _found(base: DataFrame, queries: DataFrame, k: int, metric: str, loops: bool, block_values: int, finish=None, schema: str = "q long, id long, d double") -> tuple[DataFrame, bool]:
    """((q, id, d) of candidates that hold the k nearest, whether those of a row of queries are its k nearest and come from one task); if so, finish makes rows of schema of them there."""
    base, queries = base.select(F.col("id").cast("long").alias("id"), "v"), queries.select(F.col("q").cast("long").alias("q"), "v")
    width, many = (df.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0 for df in (queries, base))
    spread = base.sparkSession.sparkContext.defaultParallelism
    whole_rows = many <= min(width, block_values)
    finish, schema = (finish, schema) if finish and whole_rows else (lambda out: out, "q long, id long, d double")
    if min(width, many) <= block_values:
        whole = (base if many <= width else queries).toArrow().combine_chunks()
        sent = base.sparkSession.sparkContext.broadcast((whole.column(0).to_numpy(), np.array(whole.column("v").combine_chunks().flatten().to_numpy(), float).reshape(len(whole), -1) if len(whole) else np.empty((0, 1))))

        def near(frames):
            for frame in frames:
                if len(frame):
                    own = frame.iloc[:, 0].to_numpy(), _matrix(frame["v"])
                    yield finish(_nearest(*own, *sent.value, k, metric, loops)) if many <= width else _nearest(*sent.value, *own, k, metric, loops)

        found = (queries.repartition(4 * spread, "q") if many <= width else base).mapInPandas(near, schema)
    else:
        x, y = -(-width // block_values), -(-many // block_values)
        x = max(x, math.isqrt(4 * spread) + 1)  # blocks can be smaller: all cores have several tasks
        y = max(y, math.isqrt(4 * spread) + 1)

        def deal(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
            return df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        def pair(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(b):
                return pd.DataFrame({"q": [], "id": [], "d": []}).astype({"q": "int64", "id": "int64", "d": "float64"})
            return _nearest(q["q"].to_numpy(), _matrix(q["v"]), b["id"].to_numpy(), _matrix(b["v"]), k, metric, loops)

        found = deal(queries, "x", x, "y", y).groupBy("x", "y").cogroup(deal(base, "y", y, "x", x).groupBy("x", "y")).applyInPandas(pair, schema)
    return found, whole_rows


def knn_graph(base: DataFrame, k: int = 16, metric: str = "l2", block_values: int = BLOCK_VALUES) -> DataFrame:
    """(src, pos, dst): each vector's k nearest others, rows ascending; ids are of one vector each, so where a task finds a whole row it numbers it too."""

    def row(out: pd.DataFrame) -> pd.DataFrame:
        src, dst = out["q"].to_numpy(), out["id"].to_numpy()
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        return pd.DataFrame({"src": src, "pos": np.arange(len(src)) - np.searchsorted(src, src), "dst": dst})

    queries = base.select(F.col("id").alias("q"), "v")
    found, whole = _found(base, queries, k, metric, False, block_values, row, "src long, pos long, dst long")
    if whole:
        return found
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("rank") <= k)
    pos = F.row_number().over(Window.partitionBy("q").orderBy("id")) - 1
    return near.select(F.col("q").alias("src"), pos.cast("long").alias("pos"), F.col("id").alias("dst"))


def send(base: DataFrame, block_values: int = BLOCK_VALUES):
    """Vectors (ids, matrix) in the order of ids as a broadcast; None if they have more than block_values numbers."""
    if (base.agg(F.sum(F.size("v").cast("long"))).first()[0] or 0) > block_values:
        return None
    whole = base.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).toArrow().sort_by("id").combine_chunks()
    from .search import compact

    return base.sparkSession.sparkContext.broadcast((whole.column("id").to_numpy(), compact(np.array(whole.column("v").combine_chunks().flatten().to_numpy()).reshape(len(whole), -1)) if len(whole) else np.empty((0, 1))))


def robust_prune(base: DataFrame, candidates: DataFrame, degree: int = 32, alpha: float = 1.2, block_values: int = BLOCK_VALUES, sent=None, spare: bool = False, ties: bool = False) -> DataFrame:
    """(src, pos, dst) of RobustPrune over candidates (src, dst): keep the nearest, drop what it is alpha times closer to, repeat.

    Distances are Euclidean; ties go to the smaller id; rows ascend. Vectors go
    to every task as long as they have up to block_values numbers, and only ids
    are moved, to so many tasks that all cores have some (ids are few bytes, and
    much work); beyond that they are joined to their candidates. sent: send(base), if it was made before.
    spare: rows of up to `degree` candidates stay whole. ties: what is as near to a
    kept one as to the node stays, unless it is a copy of the kept one.
    """
    schema, own = "src long, pos long, dst long", candidates.where("src != dst").select("src", "dst")
    if sent := sent or send(base, block_values):
        def run(batches):
            names, v = sent.value
            place = lambda x: np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))
            for batch in batches if len(names) else ():
                src, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                row, ids = np.repeat(np.arange(len(src)), rows.value_lengths().to_numpy(zero_copy_only=False)), rows.flatten().to_numpy(zero_copy_only=False)
                known = (names[place(ids)] == ids) & (names[place(src)] == src)[row]
                row, at = row[known], place(ids[known])  # in the order of names, places stand for ids
                row, at = _pruned(v, v, place(src), row, at, degree, alpha, spare, ties)
                pos = np.arange(len(row)) - np.searchsorted(row, row)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (src[row], pos, names[at])], names=["src", "pos", "dst"])

        # a number of its own: an exchange into as many parts as that of a window before would be left out, and joined parts left to few tasks
        dealt = own.select(F.col("src").cast("long"), F.col("dst").cast("long")).repartition(3 * base.sparkSession.sparkContext.defaultParallelism - 1, "src")
        return dealt.groupBy("src").agg(F.collect_set("dst").alias("ids")).mapInArrow(run, schema)

    def prune(rows: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(node):
            return pd.DataFrame({"src": [], "pos": [], "dst": []}).astype("int64")
        rows = rows.sort_values("dst")
        kept = _pruned(_matrix(rows["v"]), _matrix(node["u"]), np.array([0]), np.zeros(len(rows), np.int64), np.arange(len(rows)), degree, alpha, spare, ties)[1]
        return pd.DataFrame({"src": node["src"].iloc[0], "pos": np.arange(len(kept)), "dst": rows["dst"].to_numpy()[kept]})

    rows = own.distinct().join(base.select(F.col("id").alias("dst"), "v"), "dst")
    return rows.groupBy("src").cogroup(base.select(F.col("id").alias("src"), F.col("v").alias("u")).groupBy("src")).applyInPandas(prune, schema)


def _pruned(v: np.ndarray, of: np.ndarray, node: np.ndarray, row: np.ndarray, at: np.ndarray, degree: int, alpha: float, spare: bool = False, ties: bool = False, some: int = 1 << 11) -> tuple[np.ndarray, np.ndarray]:
    """(row, at) of the pairs that RobustPrune keeps of (row, at), ascending; row r is the node of[node[r]], at are rows of v, ties go to the smaller.

    All rows take their next candidate together, and only what is still open is compared with it. spare, ties: as in robust_prune.
    """
    if spare:
        short = np.bincount(row, minlength=len(node))[row] <= degree
        kept = _pruned(v, of, node, row[~short], at[~short], degree, alpha, ties=ties, some=some)
        row, at = (np.concatenate(x) for x in zip((row[short], at[short]), kept))
        order = np.lexsort((at, row))
        return row[order], at[order]
    far = lambda x, i, y, j: np.sqrt(np.concatenate([np.empty(0), *(((x[i[p : p + some]].astype(float) - y[j[p : p + some]]) ** 2).sum(1) for p in range(0, len(i), some))]))
    d = far(v, at, of, node[row])
    order = np.lexsort((at, d, row))
    row, at, d = row[order], at[order], d[order]
    kept, on = [], np.arange(len(row))  # what is still open, in order
    for _ in range(degree):
        if not len(on):
            break
        first = np.searchsorted(row[on], row[on])  # the open candidate that each is compared with: its row's first
        picked = on[first]
        kept.append(np.unique(picked))
        away = far(v, at[on], v, at[picked])
        on = on[((alpha * away >= d[on]) & (away > 0) if ties else alpha * away > d[on]) & (on != picked)]
    kept = np.concatenate([np.empty(0, np.int64), *kept])
    order = np.lexsort((at[kept], row[kept]))
    return row[kept][order], at[kept][order]


def medoid(base: DataFrame) -> int:
    """The id nearest to the mean vector, smallest first."""
    mean = {r.i: r.m for r in base.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()}
    centre = F.array(*(F.lit(mean[i]) for i in range(len(mean))))
    d = F.aggregate(F.zip_with("v", centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return base.agg(F.min_by("id", F.struct(d, "id"))).first()[0]


def sample_queries(base: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n base vectors (q, v), without replacement and the same every time."""
    return base.orderBy(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(n).select(F.col("id").alias("q"), "v")


def _ascending(edges: DataFrame) -> DataFrame:
    """(src, pos, dst) of distinct (src, dst), rows ascending."""
    own = edges.select("src", "dst").distinct()
    return own.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("pos"), "dst")


def vamana(base: DataFrame, degree: int = 32, size: int = 64, alpha: float = 1.2, seed: int = 128, entry: int | None = None) -> DataFrame:
    """(src, pos, dst) of a graph built by searching it: RobustPrune over what a beam search for each node expands.

    The first `seed` nodes, in the order of a hash, are pruned from their
    exact neighbours among themselves (a bound that no input widens). Then every
    round adds as many nodes as there are: all are searched at once with a pool
    of `size`, pruned over what they expanded, linked back, and rows over
    `degree` are pruned again. Rounds grow with the logarithm of the input; a
    second pass over all nodes lets the early ones see the late ones.
    """
    from .search import beam_search, hold, searched_rows

    n = base.count()
    entry = medoid(base) if entry is None else entry
    order = cut(numbered(base.select("id", "v"), F.col("id") != entry, F.xxhash64("id"), "id", name="turn"))
    # nodes of a round are numbered by their turn, as searches want 0 to n - 1
    by_turn = order.select(F.col("turn").alias("id"), "v")
    sent = send(by_turn)
    first = by_turn.where(F.col("id") < seed)
    edges = cut(robust_prune(first, knn_graph(first, size), degree, alpha, sent=sent))
    done = min(seed, n)

    def pruned(known: DataFrame, graph: DataFrame, nodes: DataFrame) -> DataFrame:
        """(src, dst) of a search of graph for each node: RobustPrune over what it expands, and the neighbours that the node has. As a table, as what is sent for it goes."""
        queries, held = nodes.select(F.col("id").alias("q"), "v"), hold(known, graph, sent=sent)
        if held and sent:
            out = cut(searched_rows(held, queries, size, 0, degree, alpha))
            held.store.destroy()
            return out
        seen = beam_search(known, graph, queries, size, size, 0, trace=True, held=held).where("expand = 1")
        found = cut(seen.select(F.col("q").alias("src"), F.col("id").alias("dst")).union(graph.select("src", "dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")))
        out = cut(robust_prune(by_turn, found, degree, alpha, sent=sent).select("src", "dst"))
        drop(found)
        return out

    while True:
        upto = min(n, 2 * done)
        again = done == n  # the second pass: rows of all nodes are new, as what they had is among their candidates
        known = by_turn.where(F.col("id") < upto)
        new = pruned(by_turn.where(F.col("id") < done), edges, known if again else known.where(F.col("id") >= done))
        both = new.union(new.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # the reverse of every new edge; rows that are too long by that are pruned again
        linked = cut(robust_prune(known, both if again else edges.select("src", "dst").union(both), degree, alpha, sent=sent, spare=True))
        before, edges, done = edges, linked, upto
        del both, known
        drop(before, new)
        if again:
            break
    if sent:
        sent.destroy()
    turn = order.select("turn", "id")
    named = edges.join(turn.select(F.col("turn").alias("src"), F.col("id").alias("s")), "src").join(turn.select(F.col("turn").alias("dst"), F.col("id").alias("d")), "dst")
    return _ascending(named.select(F.col("s").alias("src"), F.col("d").alias("dst")))


def nsg(base: DataFrame, degree: int = 32, candidates: int = 64, entry: int | None = None, metric: str = "l2") -> DataFrame:
    """(src, pos, dst): exact neighbours pruned by the relative-neighbour rule (alpha 1, what is equally near stays), and a way from the entry to every node.

    Nodes that no row leads to from the entry go to their nearest reached node.
    While they are more than an eighth of all (the entry's group is closed, as
    groups of near copies are), a node keeps of those that come to it what the
    same rule keeps, `degree` at most, and the rest is reached from there or
    looks again; in the end the others go to their nearest directly, or where
    more than `degree` go to one node as a tree below it. So no row gets more
    than `degree` in a round, and there are few rounds: each halves them or is
    the last.
    """
    from .graph import bfs_levels

    n, entry, lost = base.count(), medoid(base) if entry is None else entry, math.inf
    sent = send(base)
    edges = cut(robust_prune(base, knn_graph(base, candidates, metric), degree, 1.0, sent=sent, ties=True).select("src", "dst"))
    while True:
        level = cut(bfs_levels(edges, entry, n))
        left = level.where(F.col("level") == n).count()
        if not left:
            break
        part = lambda on: base.join(level.where(on).select("id"), "id")  # noqa: B023, E731
        near = cut(knn_exact(part(F.col("level") < n).select("id", "v"), part(F.col("level") == n).select(F.col("id").alias("q"), "v"), 1, metric).select(F.col("id").alias("src"), F.col("q").alias("dst")))
        if left > n // 8 and left <= lost // 2:
            before, edges, lost = edges, cut(edges.union(robust_prune(base, near, degree, 1.0, sent=sent, ties=True).select("src", "dst"))), left
            drop(before, level, near)
            continue
        turn = near.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).alias("turn"))
        below = turn.where(F.col("turn") >= degree).select("src", "dst", (F.floor(F.col("turn") / degree) - 1).alias("up"))
        over = turn.select("src", F.col("turn").alias("up"), F.col("dst").alias("parent"))
        edges = edges.union(turn.where(F.col("turn") < degree).select("src", "dst")).union(below.join(over, ["src", "up"]).select(F.col("parent").alias("src"), "dst"))
        break
    if sent:
        sent.destroy()
    return _ascending(edges)


def hnsw(base: DataFrame, m: int = 16, candidates: int = 64, metric: str = "l2", most: int = 8) -> DataFrame:
    """(level, src, pos, dst): layers of falling chance 1 / m, the base layer (level 0) of degree 2 m at most, others of m.

    A node's top layer comes from a hash of its id, so it is the same every
    time; rows are exact neighbours within the layer under the alpha 1 rule.
    """
    chance = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    tops = cut(base.withColumn("top", F.least(F.lit(most), F.floor(-F.log(chance) / F.lit(float(np.log(m))))).cast("int")))
    out = None
    for level in range((tops.agg(F.max("top")).first()[0] or 0) + 1):
        own = tops.where(F.col("top") >= level).select("id", "v")
        rows = robust_prune(own, knn_graph(own, candidates, metric), 2 * m if level == 0 else m, 1.0).select(F.lit(level).alias("level"), "src", "pos", "dst")
        out = rows if out is None else out.union(rows)
    return out


def base_layer(layers: DataFrame) -> DataFrame:
    """Edges (src, pos, dst) of the lowest layer."""
    return layers.where("level = 0").select("src", "pos", "dst")


__all__ = ["base_layer", "cut", "hnsw", "knn_exact", "knn_graph", "medoid", "nsg", "robust_prune", "sample_queries", "send", "vamana", "with_queries"]
