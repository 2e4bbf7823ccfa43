"""Small fixtures with ties, repeats and unreached nodes; brute force where SQL can't tell."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from scalar_codecs import decode_row, encode_row

from nearfield import functions as fn
from nearfield.operators import caching, codecs, graph, search, stores, vectors
from nearfield.plans import numbered

EDGES = [(0, 0, 1), (0, 1, 2), (1, 0, 2), (3, 0, 4)]


def _edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src long, pos long, dst long")


def _order(df):
    return [r.old_id for r in df.orderBy("new_id").collect()]


def test_levels_and_orders_with_unreached_nodes(spark):
    e = _edges(spark)
    assert {r.id: r.level for r in graph.bfs_levels(e, 0, 5).collect()} == {0: 0, 1: 1, 2: 1, 3: 5, 4: 5}
    assert _order(graph.bfs_order(e, 0, 5)) == [0, 1, 2, 3, 4]
    assert _order(graph.cm_directed_order(e, 0, 5)) == [0, 2, 1, 4, 3]
    perm = graph.rcm_order(e, 5)
    assert sorted(_order(perm)) == [0, 1, 2, 3, 4]
    assert graph.not_a_bijection(perm, 5).count() == 0
    assert graph.relabel(e, perm).count() == 4


def test_orders_against_brute_force(spark):
    rng = random.Random(5)
    n, rows = 60, []
    for u in range(n):
        for p, v in enumerate(sorted(rng.sample(range(n), rng.randint(0, 4)))):
            rows.append((u, p, v))
    adj = {u: [v for a, _, v in rows if a == u] for u in range(n)}
    deg = {u: len(adj[u]) for u in range(n)}

    def walk(start, key, restart):
        order, seen = [], set()
        while start is not None:
            queue = [start]
            seen.add(start)
            while queue:
                u = queue.pop(0)
                order.append(u)
                for v in sorted({x for x in adj[u] if x not in seen}, key=key):
                    seen.add(v)
                    queue.append(v)
            left = [u for u in range(n) if u not in seen]
            start = min(left, key=lambda u: (deg[u], u)) if restart and left else None
        return order + [u for u in range(n) if u not in seen]

    e = _edges(spark, rows)
    assert _order(graph.bfs_order(e, 0, n)) == walk(0, lambda v: v, False)
    assert _order(graph.cm_directed_order(e, 0, n)) == walk(0, lambda v: (deg[v], v), True)


@pytest.mark.parametrize("codec", codecs.CODECS)
def test_codec_round_trip(codec):
    """Batches of equal degree against the scalar code, bit by bit."""
    rng = random.Random(12345)
    for u in (1, 2, 7, 1000, 1 << 20):
        rows = [[], [0], [u - 1], [0] * 4, [u - 1] * 10, [0, u - 1], list(range(min(64, u))), list(range(max(0, u - 64), u))]
        rows += [sorted(rng.randrange(u) for _ in range(rng.randint(0, 255))) for _ in range(60)]
        for degree in {len(r) for r in rows}:
            own = [r for r in rows if len(r) == degree]
            data, bits = codecs.encode_rows(np.array(own, np.int64).reshape(len(own), degree), u, codec)
            assert [(d, b) for d, b in zip(data, bits.tolist())] == [encode_row(r, u, codec) for r in own]
            assert codecs.decode_rows(data, degree, u, codec).tolist() == own == [decode_row(d, degree, u, codec) for d in data]
    for bad in (list(range(256)), [2, 1], [5]):
        with pytest.raises(ValueError):
            codecs.encode_rows(np.array([bad]), 5 if len(bad) == 1 else 1000, codec)


@pytest.mark.parametrize("name", stores.NAMES)
def test_stores_give_back_their_rows(spark, name):
    """Rows with repeats, without edges and at the end of the ids, in every store and in small parts."""
    rng, n = random.Random(3), 70
    rows = [(s, p, v) for s in range(n) if s % 7 for p, v in enumerate(sorted(rng.choice([rng.randrange(n), n - 1, 5]) for _ in range(rng.randint(1, 40))))]
    hot = spark.range(9) if name == "tiers" else spark.createDataFrame([(3,), (50,), (14,)], "id long")
    for offsets in ("raw32", "ef"):
        store = stores.build(_edges(spark, rows), n, name, hot, partition=16, offsets=offsets)
        assert stores.edges_of(store, n) == rows and store.bytes() > 0
    empty = stores.build(_edges(spark, rows).where("src < 0"), 3, name, hot.where("id < 0"))
    assert stores.edges_of(empty, 3) == []


def test_stores_refuse_what_they_cannot_hold(spark):
    with pytest.raises(ValueError):
        stores.Rows("rowef", 10, np.array([1, 1]), np.array([1 << 31, 1 << 31]), np.array([b"", b""], object))
    with pytest.raises(ValueError):
        stores.build(_edges(spark), 5, "tiers", spark.createDataFrame([(3,)], "id long"))


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(4)
    base = spark.createDataFrame([(i, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(80)], "id long, v array<double>")
    q = base.selectExpr("id as q", "v").where("q % 3 = 0")
    for metric in ("l2", "ip"):
        whole, parts = (sorted(map(tuple, vectors.knn_exact(base, q, 5, metric, False, size).collect())) for size in (1000, 20))
        assert whole == parts and len(whole) == 27 * 5


def test_builders(spark):
    """Degrees within bounds, every node reached, and nearly all neighbours found."""
    rng = np.random.default_rng(5)
    base = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "id long, v array<double>").cache()
    entry = vectors.medoid(base)
    q = base.where("id % 20 = 0").selectExpr("id as q", "v")
    truth = vectors.knn_exact(base, q, 10).cache()
    layers = vectors.hnsw(base, 8, 40)
    for edges, most in ((vectors.vamana(base, 12, 40, 1.2, seed=64, entry=entry), 12), (vectors.nsg(base, 16, 40, entry), 60), (vectors.base_layer(layers), 16)):
        rows = edges.collect()
        size = {}
        for r in rows:
            assert r.src != r.dst
            size[r.src] = size.get(r.src, 0) + 1
        assert max(size.values()) <= most
        edges = _edges(spark, [tuple(r) for r in rows])
        if most != 16:
            assert graph.bfs_levels(edges, entry, 300).where("level = 300").count() == 0
        assert search.recall(search.beam_search(base, edges, q, 40, 10, entry), truth, 10).first().recall > 0.9
    assert {r.level for r in layers.collect()} >= {0, 1}


def test_payload_bits_are_the_encoded_bits(spark):
    rng = random.Random(1)
    rows = [(s, p, v) for s in range(40) for p, v in enumerate(sorted(rng.randrange(900) for _ in range(rng.randint(1, 30))))]
    e = _edges(spark, rows)
    for codec in ("rowef", "rowpack", "rowbic", "raw"):
        sizes = {r.src: r.bits for r in codecs.payload_bits(e, 900, codec).collect()}
        assert sizes == {r.src: r.bits for r in codecs.encode(e, 900, codec).collect()}
        assert codecs.roundtrip_mismatches(e, 900, codec).first().mismatches == 0


def test_ties_and_both_beam_searches(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0]), (4, [5.0, 5.0])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "q long, v array<double>")
    assert [(r.rank, r.id) for r in vectors.knn_exact(base, q, 3).orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]
    e = vectors.knn_graph(base, 2)
    a = search.beam_search(base, e, q, 4, 3, 4).orderBy("rank").collect()
    b = search.beam_search_joins(base, e, q, 4, 3, 4).orderBy("rank").collect()
    assert [tuple(x[c] for c in ("rank", "id", "hops", "dists")) for x in a] == [tuple(x[c] for c in ("rank", "id", "hops", "dists")) for x in b]
    a, b = (sorted(map(tuple, s(base, e, q, 3, 3, 4, trace=True).collect())) for s in (search.beam_search, search.beam_search_joins))
    assert a == b and sum(x[2] for x in a) == 4


def test_layers_cost_a_hop_each_and_one_distance_at_the_start(spark):
    base = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id long, v array<double>")
    e = spark.createDataFrame([(i, 0, i - 1) for i in range(1, 6)], "src long, pos long, dst long")
    layers = spark.createDataFrame([(1, 5, 3), (1, 3, 5), (1, 3, 1), (1, 1, 3)], "level int, src long, dst long")
    r = search.beam_search(base, e, spark.createDataFrame([(0, [1.0])], "q long, v array<double>"), 2, 1, 5, layer_edges=layers).first()
    # layer 0 has no edges: a hop; layer 1 goes 5, 3, 1 and looks once more: 3 hops, 4 distances; the base expands 1 and 0
    assert (r.id, r.hops, r.dists) == (1, 1 + 3 + 2, 1 + 4 + 2)


#: Queries whose SQL is compared here too; the smallest tables have as many vectors as the next.
SEARCHES = ("stored", "elias_fano_store", "cost_model", "hierarchy_files", "csr_files", "train_share", "row_violations", "robust_prune", "beam_search_layers", "profile_skew", "policy_hit_rate", "rank_corr", "level_share", "store_size_rowbic", "elias_fano_model", "rcm_order")


@pytest.mark.parametrize("name", SEARCHES)
def test_queries_match_their_sql(spark, name):
    import duckdb

    from nearfield.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    flat = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert flat(QUERIES[name](spark, d).select(*columns).collect()) == flat(want.fetchall())


def test_search_matches_published_shape(spark):
    """Held-out queries: ids divisible by 10 against the others, as the published figures are."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id", "cast(embedding as array<double>) as v")
    base, q = numbered(rows.where("vec_id % 10 != 0"), "vec_id", name="id").select("id", "v").cache(), rows.where("vec_id % 10 = 0").selectExpr("vec_id as q", "v")
    got = search.recall_sweep(base, vectors.knn_graph(base, 16).cache(), q, vectors.knn_exact(base, q, 10), [10, 32, 64], 10, vectors.medoid(base))
    assert {r.L: round(r.recall, 4) for r in got.collect()} == {10: 0.69, 32: 0.936, 64: 0.986}


def test_reports(spark):
    runs = spark.createDataFrame([("a", 10, 0.9, 100.0), ("a", 20, 1.0, 200.0)], "run string, L long, recall double, mean_us double")
    got = {r.target: r.mean_us for r in caching.latency_at_recall(runs, (0.95, 0.5)).collect()}
    assert got[0.95] == pytest.approx(150) and got[0.5] is None
    rates = spark.createDataFrame([("f", 0.1, 0.4)], "policy string, budget double, hit double")
    rows = caching.cost_model(rates, spark.createDataFrame([(0.1, 150.0), (0.3, 1.0)], "budget double, mean_us double"), 100.0, 200.0).orderBy("budget").collect()
    assert rows[0].model_us == pytest.approx(160) and rows[1].hit is None


def test_functions(spark):
    df = spark.createDataFrame([([3, 3, 5, 9], [3.0, 4.0])], "ids array<long>, v array<double>")
    r = df.select(fn.gaps("ids").alias("g"), fn.normalized("v").alias("n"), fn.squared_l2("v", "v").alias("z"), fn.real_ids("ids", 6).alias("r")).first()
    assert r.g == [2, 4] and np.allclose(r.n, [0.6, 0.8]) and r.z == 0 and r.r == [3, 3, 5]


def test_sources(spark, tmp_path):
    from nearfield import sources

    (tmp_path / "g_offsets.bin").write_bytes(np.array([0, 2, 2, 3], "<u8").tobytes())
    (tmp_path / "g_neighbors.bin").write_bytes(np.array([1, 2, 0], "<u4").tobytes())
    assert sorted(map(tuple, sources.read_csr(spark, str(tmp_path / "g")).collect())) == [(0, 0, 1), (0, 1, 2), (2, 0, 0)]
    (tmp_path / "x.fbin").write_bytes(np.array([2, 2], "<u4").tobytes() + np.array([1, 2, 3, 4], "<f4").tobytes())
    assert [r.v for r in sources.read_matrix(spark, str(tmp_path / "x.fbin")).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert sources.markdown(spark.range(2)).count("\n") == 3
    chart = sources.svg_lines({"a & b": [(0.0, 1.0), (2.0, 3.0)]}, "recall", "L", "us")
    assert chart.count("<polyline") == 1 and "a &amp; b" in chart and ">L<" in chart and ">us<" in chart
    sources.write_csr(_edges(spark), str(tmp_path / "w"), 6, {"start": 0})
    assert sorted(map(tuple, sources.read_csr(spark, str(tmp_path / "w")).collect())) == EDGES
    assert spark.read.json(str(tmp_path / "w_meta.json")).first().asDict() == {"start": 0, "num_points": 6, "nnz": 4, "max_degree": 2, "sorted": True}
    assert np.fromfile(tmp_path / "w_offsets.bin", "<u8").tolist() == [0, 2, 3, 3, 4, 4, 4]
    words = [1, 7, 0, 2, 3, 4, 1, 0]  # node 0: 7; node 1: none; node 2: 3, 4; node 3: 0
    (tmp_path / "d.index").write_bytes(np.array([24 + 4 * len(words)], "<u8").tobytes() + np.array([3, 2], "<u4").tobytes() + np.array([0], "<u8").tobytes() + np.array(words, "<u4").tobytes())
    got = sources.read_index_graph(spark, str(tmp_path / "d.index")).collect()
    assert sorted((r.src, r.pos, r.dst) for r in got) == [(0, 0, 7), (2, 0, 3), (2, 1, 4), (3, 0, 0)] and {(r.start, r.max_degree) for r in got} == {(2, 3)}
    (tmp_path / "log").write_text("hello\noffsets raw=100 B compressed=50 B\nneighbors raw=10 compressed=7\nTOTAL raw=110 compressed=57\nOK\n")
    assert sorted(map(tuple, sources.read_log(spark, str(tmp_path / "log")).collect())) == [("TOTAL", 110, 57), ("neighbors", 10, 7), ("offsets", 100, 50)]


def test_access_counts_over_a_stream(spark, tmp_path):
    """Windows of a stream of traces; a window is out when the watermark has passed it."""
    from nearfield.streaming import access_counts

    source = str(tmp_path / "in")

    def add(*rows):
        spark.createDataFrame([(i, f"2024-01-01 {t}") for i, t in rows], "id long, t string").selectExpr("id", "cast(t as timestamp) as ts").coalesce(1).write.mode("append").parquet(source)

    add((1, "00:05:00"), (1, "00:20:00"), (2, "00:30:00"))
    stream = access_counts(spark.readStream.schema("id long, ts timestamp").parquet(source))
    for more in ((2, "01:30:00"), (1, "00:50:00"), (3, "03:00:00")):
        add(more)
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    out = {(str(r.start)[11:16], r.id): r.touch for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {("00:00", 1): 3, ("00:00", 2): 1, ("01:00", 2): 1}


def _plain_nearest(ids, q, own, v, k, loops):
    rows = []
    for i, x in zip(ids.tolist(), q):
        near = sorted((d, j) for d, j in zip(((v - x) ** 2).sum(1).tolist(), own.tolist()) if d < np.inf and (loops or j != i))
        rows += [(i, j, d) for d, j in near[:k]]
    return rows


@pytest.mark.parametrize("kind", ["plain", "whole", "far", "copies", "odd", "few", "apart"])
def test_screened_neighbours_are_the_nearest(kind):
    """Products of matrices decide nothing: rows, order and distances are those of a plain loop, bit by bit."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((30 if kind == "few" else 1500, 8))
    if kind == "whole":
        v = rng.integers(0, 3, v.shape).astype(float)
    if kind == "far":
        v = 1e7 + 1e-3 * v
    if kind == "copies":
        v[:1400] = v[0]
    if kind == "odd":
        v[3], v[5], v[7] = np.nan, np.inf, 1e200
    if kind == "apart":
        v[::2] += 1e9
    own = rng.permutation(len(v))
    ids, q = own[:120], v[:120]
    for loops in (True, False):
        with np.errstate(all="ignore"):
            got = vectors._nearest(ids, q, own, v, 40 if kind == "few" else 9, "l2", loops, some=50, wide=256)
            want = _plain_nearest(ids, q, own, v, 40 if kind == "few" else 9, loops)
        assert [tuple(r) for r in got.itertuples(index=False)] == want


def test_neighbours_of_many_rows_take_seconds():
    """80 million pairs in 64 dimensions: over 20 seconds when every pair's distance was taken and sorted."""
    rng = np.random.default_rng(4)
    v, began = rng.standard_normal((20_000, 64)), time.perf_counter()
    got = vectors._nearest(np.arange(4000), v[:4000], np.arange(20_000), v, 16, "l2", False)
    assert len(got) == 64_000 and time.perf_counter() - began < 10


def test_both_sides_of_neighbours_can_go_to_every_task(spark):
    """Rows are the same if base, the queries or neither is broadcast; repeated ids and an empty side too."""
    rng = np.random.default_rng(5)
    v = rng.integers(0, 4, (90, 3)).astype(float)
    base = spark.createDataFrame([(i // 2, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    rows = lambda df: sorted((r.q, r["rank"], r.id) for r in df.collect())
    for queries in (base.selectExpr("id as q", "v"), base.where("id < 5").selectExpr("id as q", "v"), base.where("id < 0").selectExpr("id as q", "v")):
        whole = rows(vectors.knn_exact(base, queries, 4, loops=False))
        assert whole == rows(vectors.knn_exact(base, queries, 4, loops=False, block_values=20))
    assert rows(vectors.knn_exact(base.where("id < 0"), base.selectExpr("id as q", "v"), 4)) == []


def test_mismatches_of_a_store_are_counted_by_arrays():
    """As sets of (src, pos, dst) differ, for edges lost, added and changed; 1.6 million edges take a second or so, not a minute."""
    rng = random.Random(6)
    rows = [sorted(rng.sample(range(50), rng.randint(0, 5))) for _ in range(50)]
    flat = lambda rows: (np.array([len(r) for r in rows]), np.array([x for r in rows for x in r], np.int64))
    triples = lambda rows: {(s, p, d) for s, r in enumerate(rows) for p, d in enumerate(r)}
    store, other = stores.Raw(*flat(rows)), [r[:-1] if k % 7 == 0 else [*r, 49] if k % 5 == 0 else [x + (x == 3) for x in r] for k, r in enumerate(rows)]
    assert stores.mismatches(store, flat(rows), 50, some=8) == 0
    for wrong in (other, [[]] * 50, rows[1:] + rows[:1]):
        assert stores.mismatches(store, flat(wrong), 50, some=8) == len(triples(rows) ^ triples(wrong)) > 0
    ids = np.sort(np.random.default_rng(1).integers(0, 100_000, (100_000, 16)), axis=1)
    degrees, began = np.full(100_000, 16), time.perf_counter()
    assert stores.mismatches(stores.EliasFanoGraph(degrees, ids.ravel(), 100_000, 1024), (degrees, ids.ravel()), 100_000) == 0
    assert time.perf_counter() - began < 20


def test_a_query_makes_only_what_it_needs(spark, monkeypatch):
    """sampled_queries reads vectors; it waited for the neighbour graph."""
    from nearfield import queries

    queries._STUDIES.clear()
    monkeypatch.setattr(vectors, "knn_graph", None)
    assert queries.sampled_queries(spark, "/root/testdata/sf0.001").count() == 5
    queries._STUDIES.clear()


def test_many_roots_are_walked_from_at_once(spark):
    """160 nodes that nothing leads to, each with a few to itself: an order that started anew for each took minutes."""
    rng, n = random.Random(8), 400
    rows = [(u, p, v) for u in range(n) for p, v in enumerate(sorted({rng.randrange(160, n) for _ in range(rng.randint(0, 2))}))]
    adj = {u: [v for a, _, v in rows if a == u] for u in range(n)}
    order, seen = [], set()
    for root in [7, *sorted(range(n), key=lambda u: (len(adj[u]), u))]:
        queue = [root] if root not in seen else []
        seen |= set(queue)
        while queue:
            u = queue.pop(0)
            order.append(u)
            new = sorted(set(adj[u]) - seen, key=lambda v: (len(adj[v]), v))
            seen |= set(new)
            queue += new
    began = time.perf_counter()
    assert _order(graph.cm_directed_order(_edges(spark, rows), 7, n)) == order
    assert time.perf_counter() - began < 90


def test_a_search_by_joins_writes_once_a_hop(spark):
    """Rows are the broadcast search's, repeats in rows too; the state of a hop was written twice, and what ended with it again."""
    from pathlib import Path

    from nearfield.plans import scratch_root

    base = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(12)], "id long, v array<double>")
    e = _edges(spark, [(i, p, v) for i in range(12) for p, v in enumerate(sorted([max(0, i - 1), min(11, i + 1), min(11, i + 1)]))])
    q = spark.createDataFrame([(0, [10.0, 0.0]), (1, [2.0, 1.0])], "q long, v array<double>")
    rows = lambda df: sorted((r.q, r["rank"], r.id, r.hops, r.dists) for r in df.collect())
    want, root = rows(search.beam_search(base, e, q, 4, 3, 0)), Path(scratch_root(spark).removeprefix("file:"))
    for codec in (None, "rowbic"):
        before = len([*root.rglob("_SUCCESS")])
        found = search.beam_search_joins(base, e, q, 4, 3, 0, codec=codec)
        assert len([*root.rglob("_SUCCESS")]) - before <= max(r[3] for r in want) + 1
        assert rows(found) == want


def test_arrays_are_packed_where_the_rows_are(spark, tmp_path, monkeypatch):
    """Files of numbers came to the driver as a Python object a row; what a kind can't hold is refused."""
    from nearfield import sources

    monkeypatch.setattr(sources, "_in_order", None)
    rows = spark.range(30_000).selectExpr("29999 - id as pos", "id * 7 as value")
    sources.write_raw(rows, str(tmp_path / "x.u32"))
    assert np.fromfile(tmp_path / "x.u32", "<u4").tolist() == [7 * (29_999 - i) for i in range(30_000)]
    with pytest.raises(Exception, match="out of the range"):
        sources.write_raw(rows.selectExpr("pos", "value - 1 as value"), str(tmp_path / "y.u32"))


@pytest.mark.parametrize("values", [1 << 20, 1])
def test_prune_by_ids_and_by_joins(spark, values):
    """Vectors sent or joined, rows are those of a plain loop; copies and unknown ids are among the candidates."""
    rng = np.random.default_rng(9)
    v = rng.integers(0, 3, (50, 4)).astype(float)
    base = spark.createDataFrame([(2 * i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    pairs = [(2 * int(a), int(b)) for a in range(50) for b in rng.integers(0, 104, 20)]
    want = []
    for a in range(50):
        own = sorted({b for s, b in pairs if s == 2 * a and b % 2 == 0 and b < 100 and b != s}, key=lambda b: (np.sqrt(((v[b // 2] - v[a]) ** 2).sum()), b))
        kept, left = [], own
        while left and len(kept) < 5:
            kept.append(left[0])
            left = [b for b in left[1:] if 1.2 * np.sqrt(((v[b // 2] - v[kept[-1] // 2]) ** 2).sum()) > np.sqrt(((v[b // 2] - v[a]) ** 2).sum())]
        want += [(2 * a, p, b) for p, b in enumerate(sorted(kept))]
    got = vectors.robust_prune(base, spark.createDataFrame(pairs, "src long, dst long"), 5, 1.2, block_values=values)
    assert sorted(map(tuple, got.collect())) == want


def test_long_rows_are_searched_in_bounded_memory():
    """A row of 20,000 neighbours: 64 queries that expand it took gigabytes."""
    import tracemalloc

    rng, n = np.random.default_rng(2), 20_000
    v = rng.standard_normal((n, 32))
    store = stores.Raw(np.array([n - 1] + [0] * (n - 1)), np.arange(1, n))
    tracemalloc.start()
    search.search_together(v, store, [], v[:64], 10, 0, "l2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_walks_over_arrays_are_those_by_joins(spark):
    """Repeats, several roots and rows out of order; an id outside 0 to n - 1 is left to the joins."""
    rng = random.Random(9)
    n = 12
    rows = [(u, p, rng.randrange(n)) for u in range(0, n, 2) for p in (3, 0, 1) if rng.random() < 0.6] + [(0, 7, 2), (0, 8, 2), (5, 0, 5)]
    e = _edges(spark, rows)
    for walk in (lambda **x: graph.bfs_levels(e, 0, n, **x), lambda **x: graph.bfs_order(e, 0, n, **x), lambda **x: graph.cm_directed_order(e, 2, n, **x), lambda **x: graph.cm_directed_order(e, None, n, **x), lambda **x: graph.rcm_order(e, n, **x)):
        held, joined = walk(), walk(held_bytes=0)
        assert held.dtypes == joined.dtypes
        assert sorted(map(tuple, held.collect())) == sorted(map(tuple, joined.collect()))
    assert graph._held(_edges(spark, [(0, 0, n)]), n, 1 << 20) is None


def test_a_store_is_sent_once_for_searches_of_all_sizes(spark):
    """Searches that share what goes to the workers return the rows of those that don't, on every store."""
    base, queries = _vectors_of_tests(spark)
    edges, entry = vectors.knn_graph(base, 6), vectors.medoid(base)
    for store in ("raw", "rowef"):
        held = search.hold(base, edges, store)
        for size in (5, 12):
            alone = search.beam_search(base, edges, queries, size, 5, entry, store=store)
            assert sorted(alone.collect()) == sorted(search.beam_search(base, edges, queries, size, 5, entry, store=store, held=held).collect())


def _vectors_of_tests(spark):
    return vectors.with_queries(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))


def test_numbers_need_no_join(spark):
    got = numbered(spark.range(100).repartition(7), F.desc("id"), name="at", start=5)
    assert sorted((r.id, r.at) for r in got.collect()) == [(i, 104 - i) for i in range(100)]
    assert "Join" not in got._jdf.queryExecution().toString()
    assert numbered(spark.range(0), "id").count() == 0


def test_pruning_is_dealt_to_all_cores(spark):
    """Ids are few bytes, so joining small partitions would leave the work to one task."""
    base, _ = _vectors_of_tests(spark)
    candidates = vectors.knn_graph(base, 12).select("src", "dst")
    pruned = vectors.robust_prune(base, candidates, 4)
    assert pruned.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(pruned.collect()) == sorted(vectors.robust_prune(base, candidates, 4, block_values=0).collect())


def test_policies_are_made_only_where_asked_for(spark, monkeypatch):
    from nearfield.queries import Study

    study = Study(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(graph, "bfs_levels", lambda *a: pytest.fail("no levels were asked for"))
    own = study.policies(spark.range(study.n).select("id", F.lit(1).alias("expand")), ("freq", "indeg", "random"))
    assert list(own) == ["freq", "indeg", "random"] and all(p.count() == study.n for p in own.values())


def test_long_rows_take_fewer_queries_together(spark):
    """A row of all nodes, as nsg makes of nodes that nothing leads to: the same rows as by joins, and a bounded matrix."""
    base, queries = _vectors_of_tests(spark)
    n = base.count()
    edges = _edges(spark, [(0, i - 1, i) for i in range(1, n)])
    assert search.hold(base, edges).together == min(search.TOGETHER, search.CELLS // (n - 1))
    found = search.beam_search(base, edges, queries, 8, 5, 0)
    assert sorted(found.collect()) == sorted(search.beam_search_joins(base, edges, queries, 8, 5, 0).select(*found.columns).collect())


def test_a_round_of_joins_takes_several_hops(spark):
    """Every hop was a round; queries of one name are searches of their own, as in the broadcast search."""
    from pathlib import Path

    from nearfield.plans import scratch_root

    base = spark.createDataFrame([(i, [float(i), float(i % 3)]) for i in range(12)], "id long, v array<double>")
    e = _edges(spark, [(i, p, v) for i in range(12) for p, v in enumerate(j for j in range(12) if j != i)])
    q = spark.createDataFrame([(0, [10.0, 0.0]), (0, [2.0, 1.0]), (3, [6.0, 1.0])], "q long, v array<double>")
    layers = spark.createDataFrame([(1, 0, 4), (1, 4, 0), (1, 4, 9), (1, 9, 4)], "level int, src long, dst long")
    root = Path(scratch_root(spark).removeprefix("file:"))
    for layer_edges, codec in ((None, None), (layers, "rowbic")):
        want = sorted(search.beam_search(base, e, q, 6, 3, 0, layer_edges=layer_edges).collect())
        before = len([*root.rglob("_SUCCESS")])
        found = search.beam_search_joins(base, e, q, 6, 3, 0, layer_edges=layer_edges, codec=codec)
        assert len([*root.rglob("_SUCCESS")]) - before < max(r.hops for r in want)
        assert sorted(found.collect()) == want


def test_a_hierarchy_is_read_without_looking_for_its_schema(spark, tmp_path):
    """The document was parsed once more for its schema, and each row of a layer took the layer's arrays along."""
    from nearfield import sources

    layers = spark.createDataFrame([(0, 4), (1, 4), (1, 2), (1, 9)], "level int, id long")
    edges = spark.createDataFrame([(1, 2, 9), (1, 9, 2), (1, 9, 4)], "level int, src long, dst long")
    sources.write_hierarchy(layers, edges, 4, "indeg", f"{tmp_path}/h.json")
    spark.sparkContext.setJobGroup("hierarchy", "")
    nodes, rows, entry = sources.read_hierarchy(spark, f"{tmp_path}/h.json")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("hierarchy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, nodes.collect())) == [(0, 0, 4), (1, 0, 2), (1, 1, 4), (1, 2, 9)] and entry.first().entry == 0
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 2), (1, 2, 0), (1, 2, 1)]


def test_queries_descend_layers_together():
    """A hop reads the rows of all queries that go on; it was a read for each."""
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    ids = np.sort(rng.integers(0, 40, (40, 4)), axis=1)
    layers, reads = [stores.Raw(np.full(40, 4), ids.ravel()), stores.Raw(np.zeros(40, np.int64), np.empty(0, np.int64))], []
    want = []
    for x in q:
        at, hops, dists = 7, 0, 1
        for rows in (ids, np.empty((40, 0), int)):
            while True:
                d = ((v[rows[at]] - x) ** 2).sum(1)
                hops, dists = hops + 1, dists + len(d)
                if not len(d) or d.min() >= ((v[at] - x) ** 2).sum():
                    break
                at = int(rows[at][d.argmin()])
        want.append((at, hops, dists))
    for layer in layers:
        layer.rows = (lambda own: lambda at: reads.append(len(at)) or own(at))(layer.rows)
    assert list(zip(*(x.tolist() for x in search._descend(v, layers, q, 7, "l2")))) == want
    assert len(reads) <= max(h for _, h, _ in want) and sum(reads) == sum(h for _, h, _ in want)


def test_layers_of_a_study_are_made_once(spark, monkeypatch):
    """Every query that descends layers, or writes them, made them anew."""
    from nearfield import queries

    study = queries.Study(spark, "/root/testdata/sf0.001")
    assert study.layers is study.layers
    monkeypatch.setattr(vectors, "knn_graph", lambda *a: pytest.fail("the layers were there"))
    assert queries.Study(spark, "/root/testdata/sf0.001").layers[1].count() > 0


def test_policies_are_numbered_together(spark, monkeypatch):
    """Each policy was numbered in jobs of its own; scores can be of several kinds, and a policy can be without nodes."""
    calls, own = [], caching.numbered
    monkeypatch.setattr(caching, "numbered", lambda *a, **k: calls.append(a) or own(*a, **k))
    scores = lambda values, kind: spark.createDataFrame(list(enumerate(values)), f"id long, score {kind}")
    policies = {"long": scores([1, 5, 5, None], "long"), "text": scores(["a", "c", "b", "d"], "string"), "none": scores([], "double"), "double": scores([0.5, 0.1, 0.2, 0.9], "double")}
    used = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "id long, expand long")
    got = {(r.policy, r.hot_nodes): r.hit for r in caching.policy_hit_rates(policies, used, 4, (0.25, 0.5)).collect()}
    assert got == {("long", 1): 0.2, ("long", 2): 0.5, ("text", 1): 0.4, ("text", 2): 0.6, ("none", 1): 0.0, ("none", 2): 0.0, ("double", 1): 0.4, ("double", 2): 0.5}
    assert len(calls) == 1


def test_rows_of_neighbours_are_numbered_where_they_are_found(spark):
    """They went through two windows; ties and blocks give the same rows."""
    base = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(60)], "id long, v array<double>")
    rows = vectors.knn_graph(base, 4)
    assert "Window" not in rows._jdf.queryExecution().toString()
    assert sorted(rows.collect()) == sorted(vectors.knn_graph(base, 4, block_values=50).collect())


def test_a_closed_entry_makes_no_long_rows(spark):
    """A group of near copies at the entry: all other nodes hung on it, in rows as long as the table. Exact copies: a row held its copy only."""
    rng = np.random.default_rng(4)
    v = np.vstack((rng.normal(size=(1, 8)) * 0.01 + rng.normal(size=(30, 8)) * 1e-4, rng.normal(size=(400, 8))))
    for x in (v, np.repeat(v[20:120], 4, axis=0), np.repeat(v[25:29], 100, axis=0)):
        n = len(x)
        base = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "id long, v array<double>").cache()
        edges = vectors.nsg(base, 8, 12, 0).cache()
        assert graph.bfs_levels(edges, 0, n).where(F.col("level") == n).count() == 0
        assert edges.count() == edges.select("src", "dst").distinct().count()
        assert graph.degree_stats(edges, n).first().max_degree <= 40
    base, q = (spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], f"{name} long, v array<double>") for name in ("id", "q"))
    found = search.beam_search(base, vectors.nsg(base, 8, 12, 0), q.where("q % 10 = 0"), 40, 10, 0)
    assert search.recall(found, vectors.knn_exact(base, q.where("q % 10 = 0"), 10), 10).first().recall > 0.85


def test_single_precision_is_held_in_half_the_bytes(spark, monkeypatch):
    """Vectors of floats beyond the limit in doubles were searched by joins; rows are the same, and those of real doubles still go by joins."""
    rng = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 16)).astype(np.float32).astype(float))]
    base, queries = (spark.createDataFrame(rows, f"{name} long, v array<double>") for name in ("id", "q"))
    edges = vectors.knn_graph(base, 8)
    want = search.hold(base, edges)
    assert want.vectors.value[1].dtype == np.float32
    monkeypatch.setattr(stores, "BROADCAST_BYTES", 8 * 200 * 16)
    assert search.hold(base, edges) and not search.hold(base.withColumn("v", F.transform("v", lambda x: x / 3)), edges)
    found = search.beam_search(base, edges, queries, 10, 5, 0)
    assert sorted(found.collect()) == sorted(search.beam_search_joins(base, edges, queries, 10, 5, 0).select(*found.columns).collect())


def test_vamana_leaves_few_tables(spark):
    """Tables of earlier rounds are deleted; candidates are pruned where they are found, to the same rows."""
    from pathlib import Path

    from nearfield.plans import scratch_root

    base, _ = _vectors_of_tests(spark)
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir()) if root.exists() else set()
    edges = vectors.vamana(base, 8, 16, seed=10, entry=0)
    assert len(set(root.iterdir()) - before) <= 4
    assert graph.bfs_levels(edges, 0, base.count()).where(F.col("level") == base.count()).count() == 0
    order = base.select(F.col("id").alias("q"), "v")
    known = vectors.knn_graph(base, 6)
    held = search.hold(base, known)
    seen = search.beam_search(base, known, order, 16, 16, 0, trace=True, held=held).where("expand = 1").select(F.col("q").alias("src"), F.col("id").alias("dst"))
    want = vectors.robust_prune(base, seen.union(known.select("src", "dst")), 8, 1.2).select("src", "dst")
    assert sorted(search.searched_rows(held, order, 16, 0, 8, 1.2).collect()) == sorted(want.collect())
