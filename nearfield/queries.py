"""The registered queries of the engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sources
from .functions import distance, normalized
from .operators import caching, codecs, graph, search, stores, vectors
from .plans import cut, numbered, scratch_root

K_GRAPH, K = 16, 10
SIZES = [10, 32, 64]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _state(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table is still the one that was read: its files' names, lengths and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)


_STUDIES: dict = {}


class Study:
    """All rows as nodes, their neighbour graph and its entry, and as queries the rows whose id is divisible by 20; each made once for a table, when a query first wants it."""

    def __new__(cls, spark: SparkSession, d: str):
        key = (spark.sparkContext.applicationId, d, _state(spark, f"{d}/embeddings.parquet"))
        if key not in _STUDIES:
            self = super().__new__(cls)
            self.spark = spark
            self.base, self.queries = vectors.with_queries(_table(spark, d, "embeddings"))
            self.n = self.base.count()
            _STUDIES.clear()
            _STUDIES[key] = self
        return _STUDIES[key]

    @cached_property
    def edges(self) -> DataFrame:
        return cut(vectors.knn_graph(self.base, K_GRAPH))

    @cached_property
    def entry(self) -> int:
        return vectors.medoid(self.base)

    @cached_property
    def held(self) -> search.Held | None:
        """The vectors and the graph as workers hold them, for all searches of raw rows."""
        return search.hold(self.base, self.edges)

    @cached_property
    def layers(self) -> tuple[DataFrame, DataFrame, int]:
        """In-degree layers (level, id), their neighbour rows (level, src, dst), and the medoid of the smallest."""
        layers = cut(search.nav_layers(self.in_degree(), [max(1, self.n // 16), max(1, self.n // 256)]))
        own = [cut(self.base.join(layers.where(F.col("level") == level).select("id"), "id").select("id", "v")) for level in (0, 1)]
        edges = cut(_union(vectors.knn_graph(own[level], 8).select(F.lit(level).alias("level"), "src", "dst") for level in (0, 1)))
        return layers, edges, vectors.medoid(own[0])

    @cached_property
    def accesses(self) -> DataFrame:
        """(id, expand, touch) over all nodes, from one search of all queries; and both for each half of them, by id / 20 modulo 2."""
        traced = search.beam_search(self.base, self.edges, self.queries, 64, K, self.entry, trace=True, held=self.held)
        half = F.floor(F.col("q") / 20) % 2
        sums = [F.sum(F.when(half == r, F.col(c))).alias(f"{c}_{r}") for r in (0, 1) for c in ("expand", "touch")]
        count = traced.groupBy("id").agg(F.sum("expand").alias("expand"), F.sum("touch").alias("touch"), *sums)
        return cut(self.spark.range(self.n).join(count, "id", "left").na.fill(0))

    def trace(self, remainder: int | None = None) -> DataFrame:
        """Access profile of the queries, or of those whose id / 20 has this remainder modulo 2: 0 trains a policy, 1 evaluates it."""
        return self.accesses.select("id", *(F.col(c if remainder is None else f"{c}_{remainder}").alias(c) for c in ("expand", "touch")))

    def in_degree(self) -> DataFrame:
        return graph.degrees(self.edges, self.n, "dst").select("id", F.col("deg").alias("score"))

    def out_degree(self) -> DataFrame:
        return graph.degrees(self.edges, self.n).select("id", F.col("deg").alias("score"))

    def hot(self) -> DataFrame:
        """A tenth of the nodes, the highest in-degrees."""
        return caching.ranked(self.in_degree()).where(F.col("rank") <= self.n // 10).select("id")

    def policies(self, train: DataFrame, names: tuple = ("freq", "bfs", "indeg", "outdeg", "random")) -> dict[str, DataFrame]:
        """Scores of what can be known before any evaluation; only those asked for are made."""
        own = {
            "freq": lambda: train.select("id", F.col("expand").alias("score")),
            "bfs": lambda: graph.bfs_levels(self.edges, self.entry, self.n).select("id", (-F.col("level")).alias("score")),
            "indeg": self.in_degree,
            "outdeg": self.out_degree,
            "random": lambda: graph.nodes(self.spark, self.n).select("id", F.md5(F.col("id").cast("string")).alias("score")),
        }
        return {name: own[name]() for name in names}

    def others(self, found: DataFrame) -> DataFrame:
        """found (q, rank, id, ...) without the query's own node, the first K of the rest."""
        own = found.join(self.base.select("id", "vec_id"), "id").where(F.col("vec_id") != F.col("q"))
        return own.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("rank") <= K).drop("vec_id")

    def sweep(self, store: str = "raw") -> DataFrame:
        """(L, q, rank, id, hops, dists) of searches of every pool size."""
        out = None
        for size in SIZES:
            row = self.others(search.beam_search(self.base, self.edges, self.queries, size, size, self.entry, store=store, held=self.held if store == "raw" else None)).withColumn("L", F.lit(size))
            out = row if out is None else out.unionByName(row)
        return cut(out)

    def truth(self) -> DataFrame:
        near = vectors.knn_exact(self.base.select(F.col("vec_id").alias("id"), "v"), self.queries, K, loops=False)
        return near.select("q", "rank", F.col("id").alias("vec_id")).join(self.base.select("id", "vec_id"), "vec_id").select("q", "rank", "id")


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def knn_exact(spark, d):
    base, queries = vectors.with_queries(_table(spark, d, "embeddings"))
    near = vectors.knn_exact(base.select(F.col("vec_id").alias("id"), "v"), queries, K, loops=False)
    return near.select("q", F.col("rank").cast("long").alias("rank"), "id")


def knn_exact_ip(spark, d):
    base, queries = vectors.with_queries(_table(spark, d, "embeddings"))
    near = vectors.knn_exact(base.select(F.col("vec_id").alias("id"), normalized("v").alias("v")), queries.select("q", normalized("v").alias("v")), K, "ip", loops=False)
    return near.select("q", F.col("rank").cast("long").alias("rank"), "id")


def knn_graph(spark, d):
    return Study(spark, d).edges


def robust_prune(spark, d):
    s = Study(spark, d)
    return vectors.robust_prune(s.base, s.edges, 8, 1.2)


def csr_offsets(spark, d):
    s = Study(spark, d)
    return graph.csr_offsets(s.edges, s.n)


def degree_stats(spark, d):
    s = Study(spark, d)
    return graph.degree_stats(s.edges, s.n)


def in_degree(spark, d):
    s = Study(spark, d)
    return graph.degrees(s.edges, s.n, "dst")


def reciprocity(spark, d):
    return graph.reciprocity(Study(spark, d).edges)


def degree_bound(spark, d):
    s = Study(spark, d)
    return graph.degree_bound(s.edges, s.n).select(F.round("bits_per_edge", 6).alias("bits_per_edge"))


def gap_stats(spark, d):
    return graph.gap_stats(Study(spark, d).edges).select("gaps", F.round("mean_gap", 6).alias("mean_gap"), "median_gap", "gaps_of_one")


def gap_log2_hist(spark, d):
    return graph.gap_log2_hist(Study(spark, d).edges)


def row_violations(spark, d):
    """Rows of the graph with one id out of range, another made to go back, and a third repeated beyond a degree of 255."""
    s = Study(spark, d)
    broken = F.when((F.col("src") == 3) & (F.col("pos") == 15), -1).when((F.col("src") == 7) & (F.col("pos") == 2), s.n - 1).otherwise(F.col("dst"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("src") == 11, 15).otherwise(0)))
    rows = s.edges.select("src", "pos", broken.alias("dst"), copies.alias("copy")).select("src", (F.col("pos") * 16 + F.col("copy")).alias("pos"), "dst")
    return graph.row_violations(rows, s.n, 255)


def repeated_ids(spark, d):
    """Of the graph, and of its rows with every id halved, where neighbours meet."""
    e = Study(spark, d).edges
    halved = e.select("src", "pos", F.floor(F.col("dst") / 2).alias("dst"))
    return _union(graph.repeated_ids(x).select(F.lit(name).alias("graph"), "rows", "repeats") for name, x in (("whole", e), ("halved", halved)))


def edge_distances(spark, d):
    """(src, dst, l2, ip) of every edge, by column functions."""
    s = Study(spark, d)
    rows = s.edges.join(s.base.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(s.base.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst")
    return rows.select("src", "dst", F.round(distance("l2")("a", "b"), 6).alias("l2"), F.round(distance("ip")("a", "b"), 6).alias("ip"))


def payload_limits(spark, d):
    """No payload is near 2^32 bits here; half of the largest is a limit that some exceed."""
    s = Study(spark, d)
    usual = codecs.payload_limits(s.edges, s.n)
    return usual.join(codecs.payload_limits(s.edges, s.n, 16 * s.n * 7).select("codec", F.col("refused").alias("refused_at_112_bits_a_node")), "codec")


def bfs_levels(spark, d):
    s = Study(spark, d)
    return graph.bfs_levels(s.edges, s.entry, s.n)


def bfs_order(spark, d):
    s = Study(spark, d)
    return graph.bfs_order(s.edges, s.entry, s.n)


def cm_directed_order(spark, d):
    s = Study(spark, d)
    return graph.cm_directed_order(s.edges, s.entry, s.n)


def rcm_order(spark, d):
    s = Study(spark, d)
    return graph.rcm_order(s.edges, s.n)


def hot_labeling(spark, d):
    s = Study(spark, d)
    return caching.hot_labeling(s.in_degree(), s.n // 10)


def relabel(spark, d):
    s = Study(spark, d)
    return graph.relabel(s.edges, caching.hot_labeling(s.in_degree(), s.n // 10))


def store_size(spark, d):
    s = Study(spark, d)
    parts = [codecs.store_size(s.edges, s.n, c) for c in ("raw", "packed", "rowef", "rowpack")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("bits_per_edge", F.round("bits_per_edge", 6))


def store_size_rowbic(spark, d):
    s = Study(spark, d)
    return codecs.store_size(s.edges, s.n, "rowbic").withColumn("bits_per_edge", F.round("bits_per_edge", 6))


def two_tier_size(spark, d):
    s = Study(spark, d)
    return codecs.two_tier_size(s.edges, s.hot(), s.n)


def two_tier_slot_map(spark, d):
    s = Study(spark, d)
    return codecs.two_tier_size(s.edges, s.hot(), s.n, slot_map=True)


def codec_roundtrip(spark, d):
    s = Study(spark, d)
    out = None
    for c in codecs.CODECS:
        row = codecs.roundtrip_mismatches(s.edges, s.n, c).select(F.lit(c).alias("codec"), "mismatches")
        out = row if out is None else out.union(row)
    return out


def elias_fano_model(spark, d):
    s = Study(spark, d)
    return codecs.elias_fano_bits(s.edges, s.n)


def _found(df: DataFrame) -> DataFrame:
    return df.select("q", F.col("rank").cast("long").alias("rank"), "id", "hops", "dists")


def beam_search(spark, d):
    s = Study(spark, d)
    return _found(search.beam_search(s.base, s.edges, s.queries, 32, K, s.entry, held=s.held))


def _on(store: str):
    def query(spark, d):
        s = Study(spark, d)
        return _found(search.beam_search(s.base, s.edges, s.queries, 32, K, s.entry, store=store, hot=s.hot() if store in ("slot_map", "tiers_ef") else None, partition=1024, offsets="ef"))

    query.__doc__ = f"beam_search on the store {store}: the same rows."
    return query


def beam_search_tiers(spark, d):
    """Hot nodes get the first labels, so that a contiguous tier holds them; results under the old labels are the same."""
    s = Study(spark, d)
    perm = cut(caching.hot_labeling(s.in_degree(), s.n // 10))
    base = s.base.join(perm.select(F.col("old_id").alias("id"), "new_id"), "id").select(F.col("new_id").alias("id"), "v")
    entry = perm.where(F.col("old_id") == s.entry).first().new_id
    found = search.beam_search(base, graph.relabel(s.edges, perm), s.queries, 32, K, entry, store="tiers", hot=spark.range(s.n // 10))
    return _found(found.join(perm.select(F.col("new_id").alias("id"), "old_id"), "id").drop("id").withColumnRenamed("old_id", "id"))


def beam_search_joins(spark, d):
    s = Study(spark, d)
    return _found(search.beam_search_joins(s.base, s.edges, s.queries, 10, K, s.entry))


def beam_search_joins_rowbic(spark, d):
    """Rows are decoded where the joins read them."""
    s = Study(spark, d)
    return _found(search.beam_search_joins(s.base, s.edges, s.queries, 10, K, s.entry, codec="rowbic"))


def stored(spark, d):
    """(store, total_bytes, mismatches) of every store: its size, and edges that it doesn't give back."""
    s, rows = Study(spark, d), []
    want = stores.flat(s.edges, s.n)
    for name in ("raw", "packed", "rowef", "rowbic", "rowpack", "slot_map", "tiers_ef", "ef"):
        store = stores.build(s.edges, s.n, name, s.hot() if name in ("slot_map", "tiers_ef") else None)
        rows.append((name, store.bytes(), stores.mismatches(store, want, s.n)))
    return spark.createDataFrame(rows, "store string, total_bytes long, mismatches long")


def elias_fano_store(spark, d):
    """(partition, offsets, offset_bytes, neighbor_bytes, total_bytes, mismatches) for every size of part and both kinds of offsets."""
    s, rows = Study(spark, d), []
    want = stores.flat(s.edges, s.n)
    for partition in (1024, 4096, 8192, 32_000, 128_000):
        for offsets in ("raw32", "ef"):
            store = stores.build(s.edges, s.n, "ef", partition=partition, offsets=offsets)
            part = store.parts()
            rows.append((partition, offsets, part["offsets"], part["neighbors"], store.bytes(), stores.mismatches(store, want, s.n)))
    return spark.createDataFrame(rows, "partition long, offsets string, offset_bytes long, neighbor_bytes long, total_bytes long, mismatches long")


def recall_sweep(spark, d):
    s = Study(spark, d)
    found, truth = s.sweep(), s.truth()
    return _union(search.recall(found.where(F.col("L") == size), truth, K).select(F.lit(size).alias("L"), "queries", "recall", "hops", "dists") for size in SIZES)


def access_profile(spark, d):
    return Study(spark, d).trace()


def profile_skew(spark, d):
    s = Study(spark, d)
    out = caching.profile_skew(s.trace(), s.n)
    return out.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in out.dtypes))


def level_share(spark, d):
    s = Study(spark, d)
    return caching.level_share(graph.bfs_levels(s.edges, s.entry, s.n), s.trace())


def policy_hit_rate(spark, d):
    """Policies learn from the first half of the queries and are judged on the other, but for the last, which knows it."""
    s = Study(spark, d)
    held = s.trace(1)
    return caching.policy_hit_rates(s.policies(s.trace(0)) | {"oracle": held.select("id", F.col("expand").alias("score"))}, held, s.n)


def train_share(spark, d):
    """(policy, train_share): what of the training accesses a tenth of the nodes holds under each policy."""
    s = Study(spark, d)
    train = s.trace(0)
    hot = lambda scores: caching.ranked(scores).where(F.col("rank") <= s.n // 10).select("id")
    return _union(caching.train_share(train, hot(scores)).select(F.lit(name).alias("policy"), F.round("train_share", 6).alias("train_share")) for name, scores in s.policies(train).items())


def hot_labelings(spark, d):
    """(policy, new_id, old_id): hot-first labels under every policy."""
    s = Study(spark, d)
    return _union(caching.hot_labeling(scores, s.n // 10).select(F.lit(name).alias("policy"), "new_id", "old_id") for name, scores in s.policies(s.trace(0)).items())


def layer_policies(spark, d):
    """(policy, level, id): navigation layers by in-degree, by frequency and at random."""
    s = Study(spark, d)
    own = s.policies(s.trace(0), ("freq", "indeg", "random"))
    return _union(search.nav_layers(scores, [max(1, s.n // 16), max(1, s.n // 256)]).select(F.lit(name).alias("policy"), "level", "id") for name, scores in own.items())


def sampled_queries(spark, d):
    """(q) of a hundredth of the nodes, without replacement and the same every time."""
    s = Study(spark, d)
    return vectors.sample_queries(s.base, max(1, s.n // 100)).select("q")


def rank_corr(spark, d):
    s = Study(spark, d)
    return caching.rank_correlation(s.trace().select("id", F.col("expand").alias("score")), s.in_degree()).select(F.round("rank_corr", 6).alias("rank_corr"))


def nav_layers(spark, d):
    s = Study(spark, d)
    return search.nav_layers(s.in_degree(), [max(1, s.n // 16), max(1, s.n // 256)])


def beam_search_layers(spark, d):
    """Beam search from the entry that a greedy descent through in-degree layers finds."""
    s = Study(spark, d)
    _, edges, start = s.layers
    return _found(search.beam_search(s.base, s.edges, s.queries, 32, K, start, layer_edges=edges, held=s.held))


def beam_search_layers_joins(spark, d):
    """The descent and the search by joins: the rows of beam_search_layers."""
    s = Study(spark, d)
    _, edges, start = s.layers
    return _found(search.beam_search_joins(s.base, s.edges, s.queries, 10, K, start, layer_edges=edges))


def _recall_of(s: Study, edges: DataFrame) -> DataFrame:
    """(edges, max_degree, unreached, L, recall, hops, dists) of searches of a built graph from the entry."""
    edges = cut(edges)
    lost = graph.bfs_levels(edges, s.entry, s.n).where(F.col("level") == s.n).count()
    stats, truth = graph.degree_stats(edges, s.n).select("edges", "max_degree", F.lit(lost).cast("long").alias("unreached")), s.truth()
    held = search.hold(s.base, edges)
    rows = (search.recall(s.others(search.beam_search(s.base, edges, s.queries, size, size, s.entry, held=held)), truth, K).select(F.lit(size).alias("L"), "recall", "hops", "dists") for size in SIZES[1:])
    return stats.join(F.broadcast(_union(rows)))


def vamana(spark, d):
    """R = 32, L = 64, alpha = 1.2."""
    s = Study(spark, d)
    return _recall_of(s, vectors.vamana(s.base, 32, 64, 1.2, entry=s.entry))


def nsg(spark, d):
    s = Study(spark, d)
    return _recall_of(s, vectors.nsg(s.base, 32, 64, s.entry))


def hnsw(spark, d):
    """Rows by layer of an M = 16 hierarchy; the base layer's recall is that of the graph alone."""
    s = Study(spark, d)
    layers = cut(vectors.hnsw(s.base, 16, 64))
    return _recall_of(s, vectors.base_layer(layers)).join(F.broadcast(layers.agg((F.max("level") + 1).alias("layers"))))


def labeling_sweep(spark, d):
    s = Study(spark, d)
    labelings = {"orig": None, "bfs": cut(graph.bfs_order(s.edges, s.entry, s.n)), "cm-dir": cut(graph.cm_directed_order(s.edges, s.entry, s.n)), "rcm": cut(graph.rcm_order(s.edges, s.n))}
    return caching.labeling_sweep(s.edges, labelings, ("raw", "rowef", "rowpack", "rowbic"), s.n, f"knn{K_GRAPH}")


def _costs(spark, d) -> DataFrame:
    """(L, q, cost) of searches: distances computed, which stand for time, as they are the same on every machine."""
    return Study(spark, d).sweep().select("L", "q", F.col("dists").cast("double").alias("cost")).distinct()


def latency_at_recall(spark, d):
    """Costs at recalls that searches of pools of 10, 32 and 64 enclose."""
    runs = recall_sweep(spark, d).select(F.lit("raw").alias("run"), "L", "recall", F.col("dists").alias("mean_us"))
    return caching.latency_at_recall(runs, (0.8, 0.9, 0.95, 0.97, 0.99)).select("run", "target", F.round("mean_us", 6).alias("mean_us"))


def error_bars(spark, d):
    return caching.error_bars(_costs(spark, d), ["L"], "cost").select("L", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def latency_percentiles(spark, d):
    return caching.latency_percentiles(_costs(spark, d), ["L"], "cost").select("L", "n", F.round("mean", 6).alias("mean"), "p50", "p99")


def cost_model(spark, d):
    """A raw row costs 1 and a coded one 4: what evaluation searches read under a tier of each budget, against the model from its hit rates."""
    s = Study(spark, d)
    held = s.trace(1)
    rates = cut(caching.policy_hit_rates({"freq": s.trace(0).select("id", F.col("expand").alias("score"))}, held, s.n))
    hops = float(held.agg(F.sum("expand")).first()[0])
    measured = rates.select("budget", (F.lit(hops) * (4 - 3 * F.col("hit"))).alias("mean_us"))
    out = caching.cost_model(rates, measured, hops, 4 * hops)
    return out.select("policy", "budget", *(F.round(c, 6).alias(c) for c in ("hit", "mean_us", "model_us", "recovered")))


def run_record(spark, d):
    """(L, recall, hops, dists) of a run's record that was written and read again; the record has times and rates too."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    runs, truth = [], s.truth()
    for size in SIZES:
        timed = search.timed_search(s.base, s.edges, s.queries, size, size, s.entry, repeats=2)
        row = search.recall(s.others(timed.found), truth, K).select(F.lit(size).alias("L"), "recall", "hops", "dists", *(F.lit(v).alias(k) for k, v in timed.times.items()))
        runs.append(row)
    sources.write_run(_union(runs), f"{path}/raw.json", {"backend": "raw", "nodes": s.n, "edges": s.edges.count(), "graph_bytes": 8 * (s.n + 1) + 4 * s.edges.count()})
    doc = sources.read_results(spark, f"{path}/raw.json").select("name", "backend", "nodes", F.explode("runs").alias("r"))
    return doc.where("name = 'raw' and backend = 'raw' and r.qps > 0 and r.p99_us >= r.p50_us").select(F.col("r.L").cast("int").alias("L"), "r.recall", "r.hops", "r.dists")


def csr_files(spark, d):
    """Edges that were written as offsets, neighbours and metadata and read again."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}/g"
    sources.write_csr(s.edges, path, s.n, {"start": s.entry})
    return sources.read_csr(spark, path)


def vector_files(spark, d):
    """(id, v0, v63) of vectors written as float32 rows with a header and read again."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}.fbin"
    sources.write_matrix(s.base.select("id", "v"), path)
    return sources.read_matrix(spark, path).select("id", F.element_at("v", 1).alias("v0"), F.element_at("v", 64).alias("v63"))


def truth_files(spark, d):
    """Exact neighbours of the queries, written as int32 rows (original ids in rank order) and read again: (row, ids)."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}.ibin"
    near = vectors.knn_exact(s.base.select(F.col("vec_id").alias("id"), "v"), s.queries, 100, loops=False).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("v"))
    sources.write_matrix(numbered(near, "q", name="id").select("id", "v"), path, "<i4")
    return sources.read_matrix(spark, path, "<i4").select("id", F.array_join("v", " ").alias("ids"))


def labeling_files(spark, d):
    """(new_id, old_id, hot) of a hot-first labelling's permutation and hot ids, written and read again."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}/h"
    sources.write_labeling(s.edges, cut(caching.hot_labeling(s.in_degree(), s.n // 10)), s.hot(), path, s.n, {"policy": "indeg"})
    perm = sources.read_raw(spark, f"{path}_perm.bin").select(F.col("pos").alias("new_id"), F.col("value").alias("old_id"))
    hot = sources.read_raw(spark, f"{path}_hot.u32").select(F.col("value").alias("old_id"), F.lit(True).alias("h"))
    return perm.join(hot, "old_id", "left").select("new_id", "old_id", F.col("h").isNotNull().alias("hot"))


def profile_files(spark, d):
    """The access profile, written as two files of counters and read again."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    sources.write_profile(s.trace(), path)
    both = [sources.read_raw(spark, f"{path}_{c}.u32").select(F.col("pos").alias("id"), F.col("value").alias(c)) for c in ("expand", "touch")]
    return both[0].join(both[1], "id").select("id", "expand", "touch")


def hierarchy_files(spark, d):
    """(level, src, dst) of the layers' rows, written as one JSON document and read again."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}_hier.json"
    layers, edges, start = s.layers
    sources.write_hierarchy(layers, edges, start, "indeg", path)
    nodes, rows, _ = sources.read_hierarchy(spark, path)
    name = lambda side: nodes.select("level", F.col("local_id").alias(f"{side}_local"), F.col("node_id").alias(side))
    return rows.withColumnRenamed("dst_local", "dst_local").join(name("src"), ["level", "src_local"]).join(name("dst"), ["level", "dst_local"]).select("level", "src", "dst")


def encoded_files(spark, d):
    """Edges whose coded rows were written beside a header and read again."""
    s, path = Study(spark, d), f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    sources.write_encoded(codecs.encode(s.edges, s.n, "rowbic"), path, {"codec": "rowbic", "universe": s.n})
    rows, head = sources.read_encoded(spark, path)
    return codecs.decode(rows, head["universe"], head["codec"])


def row_decode(spark, d):
    """(store, rows, ids) read in a decode benchmark: every store decodes the same rows; see codecs timings in bench.py."""
    s, rows = Study(spark, d), []
    for name in ("raw", "ef", "rowef", "rowbic", "rowpack"):
        took = stores.time_rows(stores.build(s.edges, s.n, name), s.n, 4 * s.n, 1)
        rows.append((name, took["rows"], took["ids"]))
    return spark.createDataFrame(rows, "store string, rows long, ids long")


for _store in ("packed", "ef", "rowef", "rowbic", "rowpack", "slot_map", "tiers_ef"):
    globals()[f"beam_search_{_store}"] = _on(_store)

NAMES = """knn_exact knn_exact_ip knn_graph robust_prune csr_offsets degree_stats in_degree reciprocity degree_bound gap_stats gap_log2_hist
row_violations bfs_levels bfs_order cm_directed_order rcm_order hot_labeling relabel store_size store_size_rowbic two_tier_size two_tier_slot_map
codec_roundtrip elias_fano_model beam_search beam_search_joins recall_sweep access_profile profile_skew level_share policy_hit_rate rank_corr
nav_layers beam_search_layers labeling_sweep latency_at_recall error_bars latency_percentiles cost_model payload_limits
beam_search_packed beam_search_ef beam_search_rowef beam_search_rowbic beam_search_rowpack beam_search_tiers beam_search_slot_map beam_search_tiers_ef
beam_search_joins_rowbic beam_search_layers_joins stored elias_fano_store train_share hot_labelings layer_policies sampled_queries vamana nsg hnsw
run_record csr_files vector_files truth_files labeling_files profile_files hierarchy_files encoded_files row_decode
repeated_ids edge_distances""".split()
QUERIES = {name: globals()[name] for name in NAMES}

#: Nodes, queries and the neighbour graph, as the queries above make them.
_GRAPH = """
WITH RECURSIVE base AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
queries AS MATERIALIZED (SELECT vec_id AS q, id AS own, v FROM base WHERE vec_id % 20 = 0),
near AS MATERIALIZED (
  SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r
  FROM base a JOIN base b ON a.id <> b.id QUALIFY r <= 16),
edges AS MATERIALIZED (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, dst FROM near),
n AS MATERIALIZED (SELECT count(*) AS n FROM base),
outdeg AS MATERIALIZED (SELECT id, count(dst) AS deg FROM base LEFT JOIN edges ON src = id GROUP BY id),
indeg AS MATERIALIZED (SELECT id, count(src) AS deg FROM base LEFT JOIN edges ON dst = id GROUP BY id),
gaps AS MATERIALIZED (SELECT src, gap FROM (SELECT src, dst - lag(dst) OVER (PARTITION BY src ORDER BY pos) AS gap FROM edges) WHERE gap > 0),
hot AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY deg DESC, id) AS r FROM indeg),
perm AS MATERIALIZED (
  SELECT id AS old_id, row_number() OVER (ORDER BY (r > n // 10)::INT, CASE WHEN r > n // 10 THEN id ELSE r END) - 1 AS new_id FROM hot, n),
mean AS MATERIALIZED (SELECT i, avg(v[i]) AS m FROM base, range(1, 65) t(i) GROUP BY i),
entry AS MATERIALIZED (
  SELECT arg_min(id, d * 1000000000000 + 0 * id) AS e FROM (SELECT id, sum((v[i] - m) * (v[i] - m)) AS d FROM base, mean GROUP BY id)),
bits AS MATERIALIZED (
  SELECT src, deg, top, CASE WHEN n // deg >= 1 THEN floor(log2(n // deg))::BIGINT ELSE 0 END AS low, width
  FROM (SELECT src, count(*) AS deg, max(dst) AS top FROM edges GROUP BY src)
  LEFT JOIN (SELECT src, floor(log2(max(gap)))::BIGINT + 1 AS width FROM gaps GROUP BY src) USING (src), n),
rowef AS MATERIALIZED (SELECT src, deg * low + (top >> low) + deg AS b FROM bits),
"""
_END = "done AS (SELECT 1) "


def _sql(tail: str, more: str = "") -> str:
    return _GRAPH + more + _END + tail


_TIER = """SELECT (SELECT count(*) FROM hot, n WHERE r <= n // 10) AS hot_nodes, he AS hot_edges, cb AS cold_bits,
 (4 * (h + 1) + 4 * he + 8 * (ceil(cb / 64.0) + 2) + 5 * (n - h) + 8 + 256 {map})::BIGINT AS total_bytes
FROM n, (SELECT count(*) AS h FROM hot, n WHERE r <= n // 10),
 (SELECT count(*) AS he FROM edges JOIN hot ON src = id, n WHERE r <= n // 10),
 (SELECT coalesce(sum(b), 0)::BIGINT AS cb FROM rowef JOIN hot ON src = id, n WHERE r > n // 10)"""
_SIZE = """SELECT codec, n::BIGINT AS nodes, e::BIGINT AS edges, payload::BIGINT AS payload_bits, total::BIGINT AS total_bytes, round(8.0 * total / e, 6)::DOUBLE AS bits_per_edge
FROM n, (SELECT count(*) AS e, max(deg) AS most FROM edges, (SELECT max(deg) AS deg FROM outdeg)) c, LATERAL (
 SELECT 'raw' AS codec, 32 * e AS payload, 8 * (n + 1) + 4 * e AS total
 UNION ALL SELECT 'packed', 32 * e, 4 * n * (most + 1)
 UNION ALL SELECT 'rowef', p, 8 * (ceil(p / 64.0) + 2) + 5 * n + 8 + 256 FROM (SELECT sum(b) AS p FROM rowef)
 UNION ALL SELECT 'rowpack', p, 8 * (ceil(p / 64.0) + 2) + 5 * n + 8 FROM (SELECT sum(ceil(log2(n)) + CASE WHEN deg >= 2 THEN 6 + (deg - 1) * coalesce(width, 0) ELSE 0 END) AS p FROM bits)
)"""
_LEVELS = """walk AS (
  SELECT 0 AS level, [e] AS front, [e] AS seen FROM entry
  UNION ALL
  SELECT level + 1, fresh, list_concat(seen, fresh) FROM (
    SELECT w.level, w.seen, list(DISTINCT x.dst) AS fresh FROM walk w JOIN edges x ON list_contains(w.front, x.src) WHERE NOT list_contains(w.seen, x.dst) GROUP BY w.level, w.seen)),
levels AS MATERIALIZED (SELECT b.id, coalesce(w.level, n)::BIGINT AS level FROM base b LEFT JOIN (SELECT level, unnest(front) AS id FROM walk) w ON w.id = b.id, n),
"""
ORACLE_SQL = {
    "knn_exact": """SELECT q.vec_id AS q, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank, b.vec_id AS id
FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id QUALIFY rank <= 10""",
    "knn_exact_ip": """SELECT q.vec_id AS q, row_number() OVER (PARTITION BY q.vec_id ORDER BY -list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank, b.vec_id AS id
FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id QUALIFY rank <= 10""",
    "knn_graph": _sql("SELECT src, pos, dst FROM edges"),
    "csr_offsets": _sql("SELECT id + 1 AS id, (sum(deg) OVER (ORDER BY id))::BIGINT AS off FROM outdeg UNION ALL SELECT 0, 0"),
    "degree_stats": _sql("SELECT count(*) AS nodes, sum(deg)::BIGINT AS edges, max(deg) AS max_degree, avg(deg) AS avg_degree FROM outdeg"),
    "in_degree": _sql("SELECT id, deg FROM indeg"),
    "reciprocity": _sql("SELECT count(*) AS edges, count(b.src) AS mutual FROM edges a LEFT JOIN edges b ON a.src = b.dst AND a.dst = b.src"),
    "degree_bound": _sql("SELECT round(sum((lgamma(n + 1) - lgamma(deg + 1) - lgamma(n - deg + 1)) / ln(2)) / sum(deg), 6) AS bits_per_edge FROM outdeg, n"),
    "gap_stats": _sql("SELECT count(*) AS gaps, round(avg(gap), 6) AS mean_gap, median(gap)::DOUBLE AS median_gap, count(*) FILTER (gap = 1) AS gaps_of_one FROM gaps"),
    "gap_log2_hist": _sql("SELECT bucket, count(gap) AS cnt FROM range(20) t(bucket) LEFT JOIN gaps ON floor(log2(gap)) = bucket GROUP BY bucket"),
    "row_violations": _sql(
        """SELECT DISTINCT src, 'id out of range' AS reason FROM e, n WHERE dst < 0 OR dst >= n
UNION SELECT src, 'unsorted' FROM (SELECT src, dst < lag(dst) OVER (PARTITION BY src ORDER BY pos) AS x FROM e) WHERE x
UNION SELECT src, 'degree too large' FROM e GROUP BY src HAVING count(*) > 255""",
        "e AS (SELECT src, pos * 16 + k AS pos, CASE WHEN src = 3 AND pos = 15 THEN -1 WHEN src = 7 AND pos = 2 THEN n - 1 ELSE dst END AS dst FROM edges, n, range(16) t(k) WHERE k = 0 OR src = 11),\n",
    ),
    "bfs_levels": _sql("SELECT id, level FROM levels", _LEVELS),
    "hot_labeling": _sql("SELECT new_id, old_id FROM perm"),
    "relabel": _sql("SELECT a.new_id AS src, row_number() OVER (PARTITION BY a.new_id ORDER BY b.new_id) - 1 AS pos, b.new_id AS dst FROM edges JOIN perm a ON src = a.old_id JOIN perm b ON dst = b.old_id"),
    "store_size": _sql(_SIZE),
    "two_tier_size": _sql(_TIER.replace("{map}", "")),
    "two_tier_slot_map": _sql(_TIER.replace("{map}", "+ 4 * n")),
    "codec_roundtrip": "SELECT codec, 0::BIGINT AS mismatches FROM (VALUES ('raw'), ('packed'), ('rowef'), ('rowbic'), ('rowpack')) t(codec)",
    "nav_layers": _sql("SELECT 0::INT AS level, id FROM hot, n WHERE r <= greatest(1, n // 256) UNION ALL SELECT 1, id FROM hot, n WHERE r <= greatest(1, n // 16)"),
}

#: Searches from `starts` (q, e): one row a hop, with the pool, the expanded and the seen nodes as lists.
_DIST = """dist AS MATERIALIZED (SELECT q.q, list(list_sum(list_transform(list_zip(q.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) ORDER BY b.id) AS d FROM queries q, base b GROUP BY q.q),
out_rows AS MATERIALIZED (SELECT src, list(dst ORDER BY pos) AS dsts FROM edges GROUP BY src),
"""
_BEAM = """beam AS (
  SELECT size, q, [{'d': d[e + 1], 'id': e}] AS pool, []::BIGINT[] AS done, [e] AS seen, e AS cur FROM starts JOIN dist USING (q), (VALUES (10), (32), (64)) t(size)
  UNION ALL
  SELECT size, q, pool, done, seen, list_filter(pool, lambda c: NOT list_contains(done, c.id))[1].id FROM (
    SELECT size, q, list_sort(list_concat(pool, list_transform(fresh, lambda j: {'d': d[j + 1], 'id': j})))[1:size] AS pool, done, list_concat(seen, fresh) AS seen FROM (
      SELECT b.size, b.q, b.pool, list_append(b.done, b.cur) AS done, b.seen, list_filter(r.dsts, lambda j: NOT list_contains(b.seen, j)) AS fresh, d
      FROM beam b JOIN out_rows r ON r.src = b.cur JOIN dist x ON x.q = b.q WHERE b.cur IS NOT NULL))),
ends AS MATERIALIZED (SELECT size, q, pool, len(done) AS hops, len(seen) AS dists, done, seen FROM beam WHERE cur IS NULL),
"""
_SEARCH = _DIST + "starts AS (SELECT q, e FROM queries, entry),\n" + _BEAM
_TRACE = _SEARCH + """profiles AS MATERIALIZED (
  SELECT part, id, count(*) FILTER (kind = 'x')::BIGINT AS expand, count(*) FILTER (kind = 't')::BIGINT AS touch FROM (
    SELECT q // 20 % 2 AS part, unnest(done) AS id, 'x' AS kind FROM ends WHERE size = 64 UNION ALL SELECT q // 20 % 2, unnest(seen), 't' FROM ends WHERE size = 64) GROUP BY ALL),
train AS MATERIALIZED (SELECT b.id, coalesce(expand, 0) AS expand, coalesce(touch, 0) AS touch FROM base b LEFT JOIN profiles p ON p.id = b.id AND part = 0),
held AS MATERIALIZED (SELECT b.id, coalesce(expand, 0) AS expand FROM base b LEFT JOIN profiles p ON p.id = b.id AND part = 1),
used AS MATERIALIZED (SELECT b.id, coalesce(sum(expand), 0)::BIGINT AS expand, coalesce(sum(touch), 0)::BIGINT AS touch FROM base b LEFT JOIN profiles p ON p.id = b.id GROUP BY b.id),
"""
_POLICIES = _TRACE + _LEVELS + """policies AS MATERIALIZED (
  SELECT 'freq' AS policy, id, row_number() OVER (ORDER BY expand DESC, id) AS r FROM train UNION ALL SELECT 'bfs', id, row_number() OVER (ORDER BY level, id) FROM levels
  UNION ALL SELECT 'indeg', id, r FROM hot UNION ALL SELECT 'outdeg', id, row_number() OVER (ORDER BY deg DESC, id) FROM outdeg
  UNION ALL SELECT 'random', id, row_number() OVER (ORDER BY md5(id::VARCHAR) DESC, id) FROM base),
"""
#: Greedy descent through two in-degree layers: level 2 is the base, its starts carry hops and distances so far.
_DESCENT = """layer AS MATERIALIZED (SELECT 0 AS level, id FROM hot, n WHERE r <= greatest(1, n // 256) UNION ALL SELECT 1, id FROM hot, n WHERE r <= greatest(1, n // 16)),
links AS MATERIALIZED (SELECT x.level, x.id AS src, y.id AS dst, row_number() OVER (PARTITION BY x.level, x.id ORDER BY list_distance(a.v, b.v), y.id) AS r
  FROM layer x JOIN layer y ON x.level = y.level AND x.id <> y.id JOIN base a ON a.id = x.id JOIN base b ON b.id = y.id QUALIFY r <= 8),
step_rows AS MATERIALIZED (SELECT l.level, l.id AS src, coalesce(list(dst ORDER BY dst) FILTER (dst IS NOT NULL), []) AS dsts FROM layer l LEFT JOIN links k ON k.level = l.level AND k.src = l.id GROUP BY ALL),
top AS (SELECT id AS e FROM layer WHERE level = 0 ORDER BY (SELECT sum((v[i] - m) * (v[i] - m)) FROM base b, (SELECT i, avg(v[i]) AS m FROM base JOIN layer USING (id), range(1, 65) t(i) WHERE level = 0 GROUP BY i) WHERE b.id = layer.id), id LIMIT 1),
fall AS (
  SELECT q, e AS cur, 0 AS level, 0 AS hops, 1 AS dists FROM queries, top
  UNION ALL
  SELECT q, CASE WHEN near.d < here THEN near.id ELSE cur END, level + CASE WHEN near.d < here THEN 0 ELSE 1 END, hops + 1, dists + deg FROM (
    SELECT f.q, cur, f.level, hops, dists, len(dsts) AS deg, d[cur + 1] AS here, list_sort(list_transform(dsts, lambda j: {'d': d[j + 1], 'id': j}))[1] AS near
    FROM fall f JOIN step_rows s ON s.level = f.level AND s.src = cur JOIN dist x ON x.q = f.q)),
starts AS MATERIALIZED (SELECT q, cur AS e, hops, dists FROM fall WHERE level = 2),
"""


def _order(name: str, rows: str, first: str, restart: bool) -> str:
    """A breadth-first order with its queue as a list, a row a node; goes on at the unseen node of least degree if restart. rows has (src, dsts); by_degree lists all ids."""
    more = f"(SELECT list_filter(ids, lambda j: NOT list_contains(queue, j))[1:1] FROM {name}_ids)" if restart else "[]::BIGINT[]"
    return f"""{name}_walk AS (
  SELECT 0 AS at_, [({first})] AS queue
  UNION ALL
  SELECT at_ + 1, CASE WHEN len(queue) > at_ + 1 THEN queue ELSE list_concat(queue, {more}) END FROM (
    SELECT at_, list_concat(queue, list_filter(coalesce(dsts, []), lambda j: NOT list_contains(queue, j))) AS queue FROM {name}_walk LEFT JOIN {rows} ON src = queue[at_ + 1] WHERE len(queue) > at_)),
{name}_reached AS (SELECT unnest(queue) AS old_id, generate_subscripts(queue, 1) - 1 AS new_id FROM (SELECT queue FROM {name}_walk ORDER BY at_ DESC LIMIT 1)),
{name} AS MATERIALIZED (SELECT new_id, old_id FROM {name}_reached UNION ALL
  SELECT (SELECT count(*) FROM {name}_reached) + row_number() OVER (ORDER BY id) - 1, id FROM base ANTI JOIN {name}_reached ON old_id = id),
"""


_ORDERS = (
    """pos_rows AS MATERIALIZED (SELECT src, list(dst ORDER BY pos) AS dsts FROM edges GROUP BY src),
cm_ids AS MATERIALIZED (SELECT list(id ORDER BY deg, id) AS ids FROM outdeg),
cm_rows AS MATERIALIZED (SELECT src, list(dst ORDER BY deg, dst) AS dsts FROM edges JOIN outdeg ON id = dst GROUP BY src),
both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
both_deg AS MATERIALIZED (SELECT id, count(dst) AS deg FROM base LEFT JOIN both_ways ON src = id GROUP BY id),
sym_ids AS MATERIALIZED (SELECT list(id ORDER BY deg, id) AS ids FROM both_deg),
both_rows AS MATERIALIZED (SELECT src, list(dst ORDER BY deg, dst) AS dsts FROM both_ways JOIN both_deg ON id = dst GROUP BY src),
"""
    + _order("bfs", "pos_rows", "SELECT e FROM entry", False)
    + _order("cm", "cm_rows", "SELECT e FROM entry", True)
    + _order("sym", "both_rows", "SELECT ids[1] FROM sym_ids", True)
    + "rcm AS MATERIALIZED (SELECT n - 1 - new_id AS new_id, old_id FROM sym, n),\n"
)
#: Payloads of every codec under labelings (lab, src, pos, dst).
_CODED = """under AS MATERIALIZED (SELECT lab, src, list(dst ORDER BY pos) AS ids FROM labeled GROUP BY ALL),
spans AS (
  SELECT lab, src, -1 AS below, len(ids) AS above FROM under
  UNION ALL
  SELECT lab, src, unnest([below, mid]), unnest([mid, above]) FROM (SELECT *, below + 1 + (above - below - 1) // 2 AS mid FROM spans WHERE above - below > 1)),
steps AS (SELECT lab, ids, below, above, below + 1 + (above - below - 1) // 2 AS mid FROM spans JOIN under USING (lab, src) WHERE above - below > 1),
bounds AS (SELECT lab, ids[mid + 1] + mid AS y, CASE WHEN below >= 0 THEN ids[below + 1] + below ELSE -1 END + mid - below AS low,
  CASE WHEN above < len(ids) THEN ids[above + 1] + above ELSE n + len(ids) - 1 END - (above - mid) AS high FROM steps, n),
coded AS (SELECT lab, y - low AS v, high - low + 1 AS r, CASE WHEN high - low <= 1 THEN 1 ELSE floor(log2(high - low))::BIGINT + 1 END AS b FROM bounds),
bic AS (SELECT lab, sum(CASE WHEN (v - r + (1 << (b - 1)) + r) % r < (1 << b) - r THEN b - 1 ELSE b END)::BIGINT AS p FROM coded GROUP BY lab),
flat AS (SELECT lab, src, len(ids) AS deg, ids[len(ids)] AS top, list_max(list_transform(range(1, len(ids)), lambda i: ids[i + 1] - ids[i])) AS gap FROM under),
sums AS (SELECT lab, sum(deg)::BIGINT AS e, sum(deg * low + (top >> low) + deg)::BIGINT AS ef, sum(ceil(log2(n)) + CASE WHEN deg >= 2 THEN 6 + (deg - 1) * CASE WHEN gap > 0 THEN floor(log2(gap)) + 1 ELSE 0 END ELSE 0 END)::BIGINT AS pk
  FROM (SELECT *, CASE WHEN n // deg >= 1 THEN floor(log2(n // deg))::BIGINT ELSE 0 END AS low FROM flat, n) GROUP BY lab),
stores AS MATERIALIZED (SELECT lab, codec, e, p, CASE WHEN codec = 'raw' THEN 8 * (n + 1) + 4 * e ELSE 8 * (ceil(p / 64.0)::BIGINT + 2) + 5 * n + 8 + extra END AS total FROM n, (
  SELECT lab, 'raw' AS codec, e, 32 * e AS p, 0 AS extra FROM sums UNION ALL SELECT lab, 'rowef', e, ef, 256 FROM sums UNION ALL SELECT lab, 'rowpack', e, pk, 0 FROM sums
  UNION ALL SELECT lab, 'rowbic', e, p, 32640 * 5 + 256 * 4 FROM sums JOIN bic USING (lab))),
"""
_SHARE = ", ".join(f"round(sum(expand) FILTER (r <= greatest(1, floor({b}::DOUBLE * n)::BIGINT)) / any_value(t)::DOUBLE, 6) AS top_{f'{b:g}'.replace('.', '_')}" for b in caching.BUDGETS)
_SWEEP = """truth AS MATERIALIZED (SELECT q, list(id) AS ids FROM (
  SELECT q, id FROM dist JOIN queries USING (q), base WHERE id <> own QUALIFY row_number() OVER (PARTITION BY q ORDER BY d[id + 1], id) <= 10) GROUP BY q),
sweep AS MATERIALIZED (SELECT size AS L, count(*) AS queries,
  sum(len(list_filter(list_filter(list_transform(pool, lambda c: c.id), lambda j: j <> own)[1:10], lambda j: list_contains(ids, j)))) / (count(*) * 10)::DOUBLE AS recall, avg(hops) AS hops, avg(dists) AS dists
  FROM ends JOIN truth USING (q) JOIN queries USING (q) GROUP BY size),
"""
#: Bytes of Elias-Fano parts of `size` ascending numbers: lists (what, x, place).
_PARTS = """ef_parts AS MATERIALIZED (SELECT what, size, sum(ceil(m * low / 8.0) + ceil(((u - 1) // (1::BIGINT << low) + m) / 8.0) + 16)::BIGINT AS bytes FROM (
  SELECT *, CASE WHEN u // m >= 1 THEN floor(log2(u // m))::BIGINT ELSE 0 END AS low FROM (
    SELECT what, size, count(*) AS m, max(x) - min(x) + 1 AS u FROM ef_values, (VALUES (1024), (4096), (8192), (32000), (128000)) t(size) GROUP BY what, size, place // size)) GROUP BY ALL),
"""
_EF_VALUES = """ef_values AS MATERIALIZED (
  SELECT 'edges' AS what, src * n + dst AS x, row_number() OVER (ORDER BY src, pos) - 1 AS place FROM edges, n
  UNION ALL SELECT 'offsets', off, row_number() OVER (ORDER BY off, id) - 1 FROM (SELECT id + 1 AS id, (sum(deg) OVER (ORDER BY id))::BIGINT AS off FROM outdeg UNION ALL SELECT 0, 0)
  UNION ALL SELECT 'cold', slot * n + dst, row_number() OVER (ORDER BY slot, pos) - 1 FROM edges, n, (SELECT id, row_number() OVER (ORDER BY id) - 1 AS slot FROM hot, n WHERE r > n // 10) c WHERE c.id = src),
"""
_ORIG = "labeled AS (SELECT 'orig' AS lab, src, pos, dst FROM edges),\n"
_PROFILE = "SELECT id, expand, touch FROM used"
ORACLE_SQL |= {
    "robust_prune": _sql(
        "SELECT src, generate_subscripts(kept, 1) - 1 AS pos, unnest(kept) AS dst FROM (SELECT src, list_sort(kept) AS kept FROM prune WHERE len(open_) = 0 OR len(kept) = 8)",
        """matrix AS MATERIALIZED (SELECT a.id, list(list_distance(a.v, b.v) ORDER BY b.id) AS d FROM base a, base b GROUP BY a.id),
prune AS (
  SELECT src, list(dst ORDER BY d[dst + 1], dst) AS open_, []::BIGINT[] AS kept FROM edges JOIN matrix ON id = src GROUP BY src
  UNION ALL
  SELECT src, list_filter(open_[2:], lambda j: 1.2::DOUBLE * y.d[j + 1] > x.d[j + 1]), list_append(kept, open_[1]) FROM prune JOIN matrix x ON x.id = src JOIN matrix y ON y.id = open_[1] WHERE len(open_) > 0 AND len(kept) < 8),
""",
    ),
    "beam_search": _sql("SELECT q, generate_subscripts(p, 1) AS rank, unnest(p).id AS id, hops, dists FROM (SELECT *, pool[1:10] AS p FROM ends WHERE size = 32)", _SEARCH),
    "beam_search_joins": _sql("SELECT q, generate_subscripts(p, 1) AS rank, unnest(p).id AS id, hops, dists FROM (SELECT *, pool[1:10] AS p FROM ends WHERE size = 10)", _SEARCH),
    "beam_search_layers": _sql(
        "SELECT q, generate_subscripts(p, 1) AS rank, unnest(p).id AS id, s.hops + x.hops AS hops, s.dists + x.dists AS dists FROM (SELECT *, pool[1:10] AS p FROM ends WHERE size = 32) x JOIN starts s USING (q)",
        _DIST + _DESCENT + _BEAM,
    ),
    "recall_sweep": _sql("SELECT L, queries, recall, hops, dists FROM sweep", _SEARCH + _SWEEP),
    "access_profile": _sql(_PROFILE, _TRACE),
    "profile_skew": _sql(
        f"""SELECT sum(expand)::BIGINT AS total, count(*) FILTER (expand > 0) AS touched, max(expand) AS greatest, round(-sum(p * log2(p)) FILTER (expand > 0), 6) AS entropy,
 round(regr_slope(ln(expand), ln(r)) FILTER (expand > 0), 6) AS zipf_slope, {_SHARE}, round(pow(2, -sum(p * log2(p)) FILTER (expand > 0)), 6) AS perplexity
FROM (SELECT *, nullif(expand, 0) / t::DOUBLE AS p FROM (SELECT id, nullif(expand, 0) AS expand, row_number() OVER (ORDER BY expand DESC, id) AS r, sum(expand) OVER () AS t FROM used)), n""",
        _TRACE,
    ),
    "level_share": _sql("SELECT level, count(*) AS nodes, sum(expand) / (SELECT sum(expand) FROM used)::DOUBLE AS share FROM levels JOIN used USING (id) WHERE level <= 12 GROUP BY level", _TRACE + _LEVELS),
    "policy_hit_rate": _sql(
        """SELECT policy, budget::DOUBLE AS budget, greatest(1, floor(budget::DOUBLE * n)::INT) AS hot_nodes, coalesce(sum(expand) FILTER (r <= greatest(1, floor(budget::DOUBLE * n)::INT)), 0) / greatest(1, (SELECT sum(expand) FROM held))::DOUBLE AS hit
FROM (SELECT * FROM policies UNION ALL SELECT 'oracle', id, row_number() OVER (ORDER BY expand DESC, id) FROM held) JOIN held USING (id), n, (VALUES (0.0001), (0.001), (0.01), (0.05), (0.1), (0.2)) t(budget) GROUP BY policy, budget, n""",
        _POLICIES,
    ),
    "rank_corr": _sql("SELECT round(corr(hot.r, t.r), 6) AS rank_corr FROM hot JOIN (SELECT id, row_number() OVER (ORDER BY expand DESC, id) AS r FROM used) t USING (id)", _TRACE),
    "bfs_order": _sql("SELECT new_id, old_id FROM bfs", _ORDERS),
    "cm_directed_order": _sql("SELECT new_id, old_id FROM cm", _ORDERS),
    "rcm_order": _sql("SELECT new_id, old_id FROM rcm", _ORDERS),
    "store_size_rowbic": _sql(
        "SELECT codec, n AS nodes, e AS edges, p AS payload_bits, total::BIGINT AS total_bytes, round(8 * total / e::DOUBLE, 6) AS bits_per_edge FROM stores, n WHERE codec = 'rowbic'",
        "labeled AS (SELECT 'orig' AS lab, src, pos, dst FROM edges),\n" + _CODED,
    ),
    "labeling_sweep": _sql(
        "SELECT 'knn16' AS graph, lab AS labeling, codec, e AS edges, p AS payload_bits, 8 * total / e::DOUBLE AS bits_per_edge FROM stores",
        _ORDERS
        + """perms AS (SELECT 'bfs' AS lab, * FROM bfs UNION ALL SELECT 'cm-dir', * FROM cm UNION ALL SELECT 'rcm', * FROM rcm UNION ALL SELECT 'orig', id, id FROM base),
labeled AS MATERIALIZED (SELECT a.lab, a.new_id AS src, b.new_id AS pos, b.new_id AS dst FROM edges JOIN perms a ON src = a.old_id JOIN perms b ON dst = b.old_id AND b.lab = a.lab),
"""
        + _CODED,
    ),
    "elias_fano_model": _sql(
        """SELECT sum(m * (CASE WHEN u // m >= 1 THEN floor(log2(u // m))::BIGINT ELSE 0 END + 2))::BIGINT AS bits FROM (
 SELECT count(*) AS m, max(x) - min(x) + 1 AS u FROM (SELECT src * n + dst AS x, (row_number() OVER (ORDER BY src, pos) - 1) // 32000 AS part FROM edges, n) GROUP BY part)"""
    ),
}
_STORED = """tier AS (SELECT h, 4 * (h + 1) + 4 * he AS hot_bytes, 8 * (ceil(cb / 64.0)::BIGINT + 2) + 5 * (n - h) + 8 + 256 AS cold_bytes FROM n, (SELECT count(*) AS h FROM hot, n WHERE r <= n // 10),
  (SELECT count(*) AS he FROM edges JOIN hot ON src = id, n WHERE r <= n // 10), (SELECT coalesce(sum(b), 0)::BIGINT AS cb FROM rowef JOIN hot ON src = id, n WHERE r > n // 10)),
"""
ORACLE_SQL |= {f"beam_search_{name}": ORACLE_SQL["beam_search"] for name in ("packed", "ef", "rowef", "rowbic", "rowpack", "tiers", "slot_map", "tiers_ef")}
ORACLE_SQL |= {
    "beam_search_joins_rowbic": ORACLE_SQL["beam_search_joins"],
    "beam_search_layers_joins": ORACLE_SQL["beam_search_layers"].replace("size = 32", "size = 10"),
    "payload_limits": _sql("SELECT codec, p AS payload_bits, p >= 4294967296 AS refused, p >= 112 * n AS refused_at_112_bits_a_node FROM stores, n WHERE codec <> 'raw'", _ORIG + _CODED),
    "stored": _sql(
        """SELECT store, total::BIGINT AS total_bytes, 0::BIGINT AS mismatches FROM (
SELECT codec AS store, total FROM stores
UNION ALL SELECT 'packed', 4 * n * (most + 1) FROM n, (SELECT max(deg) AS most FROM outdeg)
UNION ALL SELECT 'slot_map', hot_bytes + cold_bytes + 4 * n FROM tier, n
UNION ALL SELECT 'tiers_ef', hot_bytes + 4 * (n - h + 1) + bytes + 4 * n FROM tier, n, ef_parts WHERE what = 'cold' AND size = 32000
UNION ALL SELECT 'ef', 4 * (n + 1) + bytes FROM n, ef_parts WHERE what = 'edges' AND size = 32000)""",
        _ORIG + _CODED + _STORED + _EF_VALUES + _PARTS,
    ),
    "elias_fano_store": _sql(
        """SELECT size::BIGINT AS partition, offsets, ob AS offset_bytes, nb AS neighbor_bytes, ob + nb AS total_bytes, 0::BIGINT AS mismatches FROM (
SELECT e.size, e.bytes AS nb, unnest(['raw32', 'ef']) AS offsets, unnest([4 * (n + 1), o.bytes])::BIGINT AS ob FROM ef_parts e JOIN ef_parts o ON o.size = e.size AND e.what = 'edges' AND o.what = 'offsets', n)""",
        _EF_VALUES + _PARTS,
    ),
    "train_share": _sql("SELECT policy, round(coalesce(sum(expand) FILTER (r <= n // 10), 0) / greatest(1, sum(expand))::DOUBLE, 6) AS train_share FROM policies JOIN train USING (id), n GROUP BY policy", _POLICIES),
    "hot_labelings": _sql("SELECT policy, id AS old_id, row_number() OVER (PARTITION BY policy ORDER BY (r > n // 10)::INT, CASE WHEN r > n // 10 THEN id ELSE r END) - 1 AS new_id FROM policies, n", _POLICIES),
    "layer_policies": _sql(
        "SELECT policy, level::INT AS level, id FROM policies, n, (VALUES (0, 256), (1, 16)) t(level, part) WHERE policy IN ('freq', 'indeg', 'random') AND r <= greatest(1, n // part)", _POLICIES
    ),
    "sampled_queries": _sql("SELECT id AS q FROM base, n QUALIFY row_number() OVER (ORDER BY md5(id::VARCHAR || '-0'), id) <= greatest(1, n // 100)"),
    "latency_at_recall": _sql(
        """SELECT run, target, round(arg_min(t0 + (target - r0) / (r1 - r0) * (t1 - t0), L) FILTER (r0 <= target AND target <= r1 AND r1 > r0), 6) AS mean_us FROM (
 SELECT 'raw' AS run, L, recall AS r0, dists AS t0, lead(recall) OVER (ORDER BY L) AS r1, lead(dists) OVER (ORDER BY L) AS t1 FROM sweep), (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.97::DOUBLE), (0.99::DOUBLE)) t(target) GROUP BY run, target""",
        _SEARCH + _SWEEP,
    ),
    "error_bars": _sql("SELECT size AS L, count(*) AS n, round(avg(dists), 6) AS mean, round(coalesce(stddev_samp(dists), 0), 6) AS sd FROM ends GROUP BY size", _SEARCH),
    "latency_percentiles": _sql(
        """SELECT size AS L, count(*) AS n, round(avg(dists), 6) AS mean, max(dists) FILTER (r = c // 2)::DOUBLE AS p50, max(dists) FILTER (r = least(c - 1, c * 99 // 100))::DOUBLE AS p99
FROM (SELECT size, dists, row_number() OVER (PARTITION BY size ORDER BY dists) - 1 AS r, count(*) OVER (PARTITION BY size) AS c FROM ends) GROUP BY size""",
        _SEARCH,
    ),
    "cost_model": _sql(
        """SELECT 'freq' AS policy, budget, round(hit, 6) AS hit, round(t * (4 - 3 * hit), 6) AS mean_us, round(t + (1 - hit) * 3 * t, 6) AS model_us, round((4 * t - t * (4 - 3 * hit)) / (3 * t), 6) AS recovered FROM (
 SELECT budget::DOUBLE AS budget, coalesce(sum(expand) FILTER (r <= greatest(1, floor(budget::DOUBLE * n)::INT)), 0) / sum(expand)::DOUBLE AS hit, sum(expand)::DOUBLE AS t
 FROM policies JOIN held USING (id), n, (VALUES (0.0001), (0.001), (0.01), (0.05), (0.1), (0.2)) t(budget) WHERE policy = 'freq' GROUP BY budget, n)""",
        _POLICIES,
    ),
    "run_record": _sql("SELECT L, recall, hops, dists FROM sweep", _SEARCH + _SWEEP),
    "repeated_ids": _sql(
        """SELECT graph, count(*) FILTER (more > 0) AS rows, sum(more)::BIGINT AS repeats FROM (SELECT graph, src, count(*) - count(DISTINCT dst) AS more FROM (
 SELECT 'whole' AS graph, src, dst FROM edges UNION ALL SELECT 'halved', src, dst // 2 FROM edges) GROUP BY graph, src) GROUP BY graph"""
    ),
    "edge_distances": _sql("SELECT src, dst, round(power(list_distance(a.v, b.v), 2), 6) AS l2, round(-list_inner_product(a.v, b.v), 6) AS ip FROM edges JOIN base a ON a.id = src JOIN base b ON b.id = dst"),
    "csr_files": ORACLE_SQL["knn_graph"],
    "encoded_files": ORACLE_SQL["knn_graph"],
    "vector_files": _sql("SELECT id, v[1] AS v0, v[64] AS v63 FROM base"),
    "truth_files": """SELECT dense_rank() OVER (ORDER BY q) - 1 AS id, ids FROM (SELECT q, string_agg(id, ' ' ORDER BY r) AS ids FROM (
SELECT q.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS r
FROM embeddings q JOIN embeddings b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id QUALIFY r <= 100) GROUP BY q)""",
    "labeling_files": _sql("SELECT new_id, old_id, new_id < n // 10 AS hot FROM perm, n"),
    "profile_files": _sql(_PROFILE, _TRACE),
    "hierarchy_files": _sql("SELECT level, src, dst FROM links", _DESCENT.split("step_rows AS")[0]),
}
