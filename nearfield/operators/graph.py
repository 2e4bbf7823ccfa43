"""Statistics, validation, orders and relabelling of edges (src, pos, dst) over nodes 0 to n - 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_log2
from ..plans import cut, numbered

#: Bytes of rows (offsets of 64 bits, ids of 32) that a walk holds as flat arrays, as many as a search; beyond that it runs as joins.
HELD_BYTES = 64 << 20


def nodes(spark, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "id")


def degrees(edges: DataFrame, n: int, by: str = "src") -> DataFrame:
    """(id, deg) with zeros; by: src for out-degrees, dst for in-degrees."""
    count = edges.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("deg"))
    return nodes(edges.sparkSession, n).join(count, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))


def degree_stats(edges: DataFrame, n: int) -> DataFrame:
    return degrees(edges, n).agg(F.count("*").alias("nodes"), F.sum("deg").alias("edges"), F.max("deg").alias("max_degree"), F.avg("deg").alias("avg_degree"))


def csr_offsets(edges: DataFrame, n: int) -> DataFrame:
    """(id, off): edges of smaller ids; n + 1 rows. Sums of blocks of ids come first, so no task sees all nodes."""
    block = 1 << 16
    deg = degrees(edges, n).withColumn("block", F.floor(F.col("id") / block))
    blocks = deg.groupBy("block").agg(F.sum("deg").alias("s"))
    before = blocks.withColumn("before", F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.sum("deg").over(Window.partitionBy("block").orderBy("id"))
    rows = deg.withColumn("upto", own).join(F.broadcast(before), "block").select((F.col("id") + 1).alias("id"), (F.col("before") + F.col("upto")).alias("off"))
    return rows.union(edges.sparkSession.createDataFrame([(0, 0)], "id long, off long"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """(edges, mutual): distinct edges and those whose reverse exists."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("m"))
    return e.join(back, ["src", "dst"], "left").agg(F.count("*").alias("edges"), F.coalesce(F.sum("m"), F.lit(0)).alias("mutual"))


def degree_bound(edges: DataFrame, n: int) -> DataFrame:
    """Bits an edge no order-oblivious code goes below: sum of log2 C(n, degree) over edges."""
    of = edges.groupBy("src").agg(F.count("*").alias("deg")).groupBy("deg").agg(F.count("*").alias("c"))
    bits = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("deg") - 1), F.lit(0.0), lambda s, i: s + F.log2((F.lit(float(n)) - i) / (i + 1)))
    return of.agg((F.sum(F.col("c") * bits) / F.sum(F.col("c") * F.col("deg"))).alias("bits_per_edge"))


def row_gaps(edges: DataFrame) -> DataFrame:
    """(src, gap) of positive gaps between neighbours in row order."""
    gap = F.col("dst") - F.lag("dst").over(Window.partitionBy("src").orderBy("pos"))
    return edges.select("src", gap.alias("gap")).where("gap > 0")


def gap_stats(edges: DataFrame) -> DataFrame:
    return row_gaps(edges).agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean_gap"), F.expr("percentile(gap, 0.5)").alias("median_gap"), F.sum((F.col("gap") == 1).cast("long")).alias("gaps_of_one"))


def gap_log2_hist(edges: DataFrame, buckets: int = 20) -> DataFrame:
    """(bucket, cnt) of floor(log2 gap), `buckets` rows at least."""
    count = row_gaps(edges).groupBy(floor_log2("gap").alias("bucket")).agg(F.count("*").alias("cnt"))
    return edges.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(count, "bucket", "full").select("bucket", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def row_violations(edges: DataFrame, n: int, max_degree: int = 255) -> DataFrame:
    """(src, reason) of rows that codecs refuse: an id outside 0 to n - 1, an unsorted row, a degree over max_degree."""
    bad = edges.where((F.col("dst") < 0) | (F.col("dst") >= n)).select("src", F.lit("id out of range").alias("reason"))
    back = edges.select("src", (F.col("dst") < F.lag("dst").over(Window.partitionBy("src").orderBy("pos"))).alias("x")).where("x").select("src", F.lit("unsorted").alias("reason"))
    many = edges.groupBy("src").count().where(F.col("count") > max_degree).select("src", F.lit("degree too large").alias("reason"))
    return bad.union(back).union(many).distinct()


def repeated_ids(edges: DataFrame) -> DataFrame:
    """(rows, repeats): rows that name a neighbour more than once, and how many entries repeat an earlier one."""
    own = edges.groupBy("src", "dst").agg((F.count("*") - 1).alias("more")).groupBy("src").agg(F.sum("more").alias("more"))
    return own.agg(F.sum((F.col("more") > 0).cast("long")).alias("rows"), F.coalesce(F.sum("more"), F.lit(0)).alias("repeats"))


def symmetrized(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").distinct()


def _held(edges: DataFrame, n: int, most: int, *order: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(src, dst) by (src, *order, dst); None beyond `most` bytes of rows, or where an id is outside 0 to n - 1."""
    many, low, high = edges.agg(F.count("*"), F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if 8 * (n + 1) + 4 * many > most or many and not (0 <= low and high < n):
        return None
    kind = "int" if n < 1 << 31 else "long"  # half of the bytes pass through the driver
    got = edges.select(F.col("src").cast(kind), F.col("dst").cast(kind), *order).toArrow().combine_chunks()
    if any(c.null_count for c in got.columns):
        return None
    src, dst = (got.column(c).to_numpy().astype(np.int64) for c in ("src", "dst"))
    at = np.lexsort((dst, *(got.column(c).to_numpy() for c in reversed(order)), src))
    return src[at], dst[at]


def _waves(src: np.ndarray, dst: np.ndarray, n: int, roots):
    """Levels of breadth-first walks from each of roots that no earlier walk has seen, as arrays; (src, dst) by src. A level is in the order of (first parent's place, place in its row)."""
    ends = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n))))
    seen = np.zeros(n, bool)
    for root in roots:
        front = np.array([root] if not seen[root] else [], np.int64)
        while len(front):
            seen[front] = True
            yield front
            size = ends[front + 1] - ends[front]
            near = dst[np.repeat(ends[front] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            near = near[~seen[near]]
            front = near[np.sort(np.unique(near, return_index=True)[1])]


def _frame(spark, **columns: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(x, pa.int64()) for k, x in columns.items()}))


def bfs_levels(edges: DataFrame, start: int, n: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(id, level) hops from start; n where unreached."""
    spark, level = edges.sparkSession, 0
    if 0 <= start < n and (held := _held(edges, n, held_bytes)):
        levels = np.full(n, n, np.int64)
        for level, front in enumerate(_waves(*held, n, [start])):
            levels[front] = level
        return _frame(spark, id=np.arange(n), level=levels)
    seen = front = cut(spark.createDataFrame([(start, 0)], "id long, level long"))
    while True:
        level += 1
        front = cut(front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level).cast("long")))
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return nodes(spark, n).join(seen, "id", "left").select("id", F.coalesce("level", F.lit(n)).alias("level"))


def first_ancestors(edges: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, turn, root): the least turn among the nodes of turns (id, turn) that lead to id, its own included. A round a hop, of what changed in the last."""
    label = cut(turns.select("id", "turn", F.col("turn").alias("root"), F.lit(True).alias("fresh")))
    while True:
        offer = label.where("fresh").join(edges.select("src", "dst"), F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("root").alias("offer"))
        less = F.coalesce(F.col("offer") < F.col("root"), F.lit(False))
        label = cut(label.join(offer, "id", "left").select("id", "turn", F.when(less, F.col("offer")).otherwise(F.col("root")).alias("root"), less.alias("fresh")))
        if not label.where("fresh").limit(1).count():
            return label.select("id", "turn", "root")


def _walk(edges: DataFrame, front: DataFrame, key) -> DataFrame:
    """(old_id, root, level, place): breadth-first from all of front (old_id, root, place) at once; places order a level by (first parent's place, key, id)."""
    seen, level = None, 0
    while True:
        front = cut(front.select("old_id", "root", F.lit(level).alias("level"), "place"))
        if not front.limit(1).count():
            return seen if seen is not None else front
        seen, level = front if seen is None else seen.unionByName(front), level + 1
        child = front.join(edges, F.col("old_id") == F.col("src")).select(F.col("dst").alias("id"), "root", F.struct(F.col("place").alias("p"), *(F.col(c) for c in key)).alias("k"))
        child = child.groupBy("id").agg(F.min("k").alias("k"), F.min_by("root", "k").alias("root")).join(seen.select(F.col("old_id").alias("id")), "id", "left_anti")
        front = numbered(child, "k.p", *(f"k.{c}" for c in key), "id", name="place").select(F.col("id").alias("old_id"), "root", "place")


def _search_order(edges: DataFrame, start: int, key, deg: DataFrame | None = None) -> DataFrame:
    """(old_id, new_id) by levels: children in the order of (their first parent's number, key).

    With deg (id, deg) it goes on at the unseen node of the least degree, then
    id, until none is left, yet in no more rounds than the longest way has hops:
    a node belongs to the first root, in that order, that leads to it, and so do
    all nodes on the ways between them, so all roots are walked from at once.
    """
    order = _walk(edges, edges.sparkSession.createDataFrame([(start, 0, 0)], "old_id long, root long, place long"), key)
    order = cut(numbered(order, "level", "place").select("old_id", "new_id"))
    rest = cut(deg.join(order.select(F.col("old_id").alias("id")), "id", "left_anti")) if deg is not None else None
    if rest is None or not rest.limit(1).count():
        return order
    own = edges.join(rest.select(F.col("id").alias("src")), "src", "left_semi").join(rest.select(F.col("id").alias("dst")), "dst", "left_semi")
    turns = first_ancestors(own, numbered(rest, "deg", "id", name="turn"))
    side = lambda c: turns.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    own = cut(own.join(side("src"), "src").join(side("dst"), "dst").where("src_root = dst_root").select(*edges.columns))
    more = _walk(own, turns.where("turn = root").select(F.col("id").alias("old_id"), "root", F.col("root").alias("place")), key)
    return order.unionByName(numbered(more, "root", "level", "place", start=order.count()).select("old_id", "new_id"))


def bfs_order(edges: DataFrame, start: int, n: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(new_id, old_id): breadth-first from start, children in row order; unreached nodes follow by id."""
    if 0 <= start < n and (held := _held(edges, n, held_bytes, "pos")):
        order = np.concatenate(list(_waves(*held, n, [start])))
        return _frame(edges.sparkSession, new_id=np.arange(n), old_id=np.concatenate((order, np.setdiff1d(np.arange(n), order))))
    order = _search_order(edges, start, ["pos"])
    rest = nodes(edges.sparkSession, n).join(order.select(F.col("old_id").alias("id")), "id", "left_anti")
    rest = numbered(rest, "id", start=order.count()).select(F.col("id").alias("old_id"), "new_id")
    return order.unionByName(rest).select("new_id", "old_id")


def cm_directed_order(edges: DataFrame, start: int | None, n: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(new_id, old_id): breadth-first over out-edges from start (or the node of least degree, then id), children by out-degree then id; goes on at the unseen node of least degree.

    Rows of up to held_bytes are walked as flat arrays, others by joins.
    """
    if n and (start is None or 0 <= start < n) and (held := _held(edges, n, held_bytes)):
        src, dst = held
        deg = np.bincount(src, minlength=n)
        at = np.lexsort((dst, deg[dst], src))
        turns = np.lexsort((np.arange(n), deg))
        order = np.concatenate(list(_waves(src[at], dst[at], n, turns.tolist() if start is None else [start, *turns.tolist()])))
        return _frame(edges.sparkSession, new_id=np.arange(n), old_id=order)
    deg = cut(degrees(edges, n))
    if start is None and (first := deg.agg(F.min(F.struct("deg", "id")).alias("x")).first().x):
        start = first.id
    keyed = cut(edges.select("src", "dst").distinct().join(deg.select(F.col("id").alias("dst"), "deg"), "dst").select("src", "dst", "deg", F.col("dst").alias("tie")))
    if start is None:
        return deg.select(F.col("id").alias("new_id"), F.col("id").alias("old_id"))  # no nodes
    return _search_order(keyed, start, ["deg", "tie"], deg).select("new_id", "old_id")


def rcm_order(edges: DataFrame, n: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(new_id, old_id): Cuthill-McKee over edges in both directions, from least degree then id, reversed."""
    both = cut(symmetrized(edges))
    return cm_directed_order(both, None, n, held_bytes).select((F.lit(n - 1) - F.col("new_id")).alias("new_id"), "old_id")


def relabel(edges: DataFrame, perm: DataFrame) -> DataFrame:
    """Edges under perm (new_id, old_id), rows ascending again."""
    e = edges.join(perm.select(F.col("old_id").alias("src"), F.col("new_id").alias("s")), "src").join(perm.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d")), "dst")
    pos = F.row_number().over(Window.partitionBy("s").orderBy("d")) - 1
    return e.select(F.col("s").alias("src"), pos.cast("long").alias("pos"), F.col("d").alias("dst"))


def not_a_bijection(perm: DataFrame, n: int) -> DataFrame:
    """Ids that perm lacks, repeats or shouldn't have."""
    seen = perm.select(F.col("new_id").alias("id"), F.lit("new").alias("side")).union(perm.select("old_id", F.lit("old")))
    all_ = nodes(perm.sparkSession, n).select("id", F.explode(F.array(F.lit("new"), F.lit("old"))).alias("side"), F.lit(0).alias("one"))
    return seen.withColumn("one", F.lit(1)).unionByName(all_).groupBy("id", "side").agg(F.sum("one").alias("times"), F.count("*").alias("c")).where("times != 1 or c != 2").select("id", "side")
