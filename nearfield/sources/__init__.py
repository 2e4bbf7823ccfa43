"""Readers and writers of vector, graph and result files, through Spark's own readers only."""

from __future__ import annotations

import itertools
import json
import struct
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import cut


def read_raw(spark: SparkSession, path: str, kind: str = "<u4", chunk: int = 1 << 20) -> DataFrame:
    """(pos, value) of a headerless array file; its size must be a multiple of the item's."""
    size = np.dtype(kind).itemsize

    def run(batches):
        for frame in batches:
            for content in frame["content"]:
                if len(content) % size:
                    raise ValueError(f"file size {len(content)} is no multiple of {size}")
                data = np.frombuffer(content, kind)
                for k in range(0, len(data), chunk):
                    yield pd.DataFrame({"pos": np.arange(k, min(k + chunk, len(data))), "value": data[k : k + chunk].astype("f8" if "f" in kind else "i8")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"pos long, value {'double' if 'f' in kind else 'long'}")


def read_matrix(spark: SparkSession, path: str, kind: str = "<f4", chunk: int = 1 << 14) -> DataFrame:
    """(id, v) of a file with a header of two u32, rows and columns, then rows (float32 vectors or int32 neighbours)."""
    item = "double" if "f" in kind else "long"

    def run(batches):
        for frame in batches:
            for content in frame["content"]:
                n, d = struct.unpack_from("<II", content)
                if len(content) != 8 + n * d * np.dtype(kind).itemsize:
                    raise ValueError("file size doesn't match its header")
                rows = np.frombuffer(content, kind, n * d, 8).reshape(n, d).astype("f8" if item == "double" else "i8")
                for k in range(0, n, chunk):
                    yield pd.DataFrame({"id": np.arange(k, min(k + chunk, n)), "v": list(rows[k : k + chunk])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"id long, v array<{item}>")


def read_index_graph(spark: SparkSession, path: str) -> DataFrame:
    """(src, pos, dst, start, max_degree) of an on-disk graph: u64 size, u32 max degree, u32 start, u64 frozen, then k and k ids each node."""

    def run(batches):
        for frame in batches:
            for content in frame["content"]:
                size, degree, start, _ = struct.unpack_from("<QIIQ", content)
                if size > len(content):
                    raise ValueError("the file is shorter than its header says")
                words, at, node, rows = np.frombuffer(content, "<u4", (size - 24) // 4, 24), 0, 0, []
                while at < len(words):
                    k = int(words[at])
                    if k > degree or at + 1 + k > len(words):
                        raise ValueError(f"node {node} has {k} neighbours")
                    rows += [(node, p, int(x)) for p, x in enumerate(words[at + 1 : at + 1 + k])]
                    at, node = at + 1 + k, node + 1
                yield pd.DataFrame(rows, columns=["src", "pos", "dst"]).assign(start=start, max_degree=degree)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "src long, pos long, dst long, start long, max_degree long")


def read_csr(spark: SparkSession, prefix: str) -> DataFrame:
    """(src, pos, dst) of prefix_offsets.bin (u64) and prefix_neighbors.bin (u32); the last offset must be the number of edges."""
    off, nbr = read_raw(spark, f"{prefix}_offsets.bin", "<u8"), read_raw(spark, f"{prefix}_neighbors.bin", "<u4")
    total, nnz = off.agg(F.max("value")).first()[0], nbr.count()
    if total != nnz:
        raise ValueError(f"offsets end at {total}, there are {nnz} neighbours")
    ends = off.select((F.col("pos") - 1).alias("src"), F.col("value").alias("last"))
    rows = off.select(F.col("pos").alias("src"), F.col("value").alias("first")).join(ends, "src").where("last > first")
    places = rows.select("src", "first", F.explode(F.sequence("first", F.col("last") - 1)).alias("at"))
    return places.join(nbr.select(F.col("pos").alias("at"), F.col("value").alias("dst")), "at").select("src", (F.col("at") - F.col("first")).alias("pos"), "dst")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Run results (one JSON document a file) with the file's base name."""
    return spark.read.option("multiLine", True).json(path).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(part, raw, compressed) of a compressor's printed lines 'offsets|neighbors|TOTAL raw=… compressed=…'."""
    line = r"^(offsets|neighbors|TOTAL)\s+raw=(\d+)\D+compressed=(\d+)"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 1).alias("part"), *(F.regexp_extract("value", line, k).cast("long").alias(c) for k, c in ((2, "raw"), (3, "compressed"))))


def read_hierarchy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layers, layer edges, entry) of a hierarchy's JSON, top level 0 first; see operators.search.nav_layers."""
    doc = spark.read.schema("levels array<struct<nodes: array<long>, offsets: array<long>, neighbors: array<long>>>, entry long").option("multiLine", True).json(path)
    levels = doc.select(F.posexplode("levels").alias("level", "x"))
    layers = levels.select("level", F.posexplode("x.nodes").alias("local_id", "node_id"))
    row = "slice(x.neighbors, int(x.offsets[i]) + 1, int(x.offsets[i + 1] - x.offsets[i]))"  # cut where the arrays are: they would be copied to every row of theirs
    spans = levels.select("level", F.posexplode(F.expr(f"transform(slice(x.offsets, 2, size(x.offsets)), (last, i) -> {row})")).alias("src_local", "ids"))
    return layers, spans.select("level", "src_local", F.explode("ids").alias("dst_local")), doc.select("entry")


def _put(spark: SparkSession, path: str, parts) -> None:
    """Bytes to one file of any store that Spark writes to, a part at a time."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def _in_order(df: DataFrame, order: list[str], cols: list[str], some: int = 1 << 16):
    """Rows in order, in bounded lists: one partition at a time comes to the driver, as the formats below are one file each."""
    held = []
    for r in df.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols).toLocalIterator():
        held.append(r)
        if len(held) >= some:
            yield held
            held = []
    if held:
        yield held


def _packed(df: DataFrame, order: list[str], column: str, kind: str):
    """A column's bytes in order, packed where the rows are: no Python object a row. Numbers that kind can't hold are refused."""
    least, most = (np.iinfo(kind).min, np.iinfo(kind).max) if np.dtype(kind).kind in "iu" else (-np.inf, np.inf)

    def pack(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            if batch.column(0).null_count or len(x) and not (least <= x.min() and x.max() <= most):
                raise ValueError(f"{column}: null or out of the range of {kind}")
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary())], names=["data"])

    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(column).mapInArrow(pack, "data binary")
    return (bytes(r.data) for r in rows.toLocalIterator(prefetchPartitions=True))


def write_matrix(df: DataFrame, path: str, kind: str = "<f4") -> None:
    """A file that read_matrix reads, of rows (id, v) in the order of id; all rows must have one length."""
    n, low, high = df.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"rows of {low} to {high} values")
    rows = (np.array([r.v for r in some], kind).tobytes() for some in _in_order(df, ["id"], ["v"], 1 << 12))
    _put(df.sparkSession, path, itertools.chain([struct.pack("<II", n, high or 0)], rows))


def write_raw(df: DataFrame, path: str, kind: str = "<u4") -> None:
    """A headerless array file of rows (pos, value) in the order of pos."""
    _put(df.sparkSession, path, _packed(df, ["pos"], "value", kind))


def write_csr(edges: DataFrame, prefix: str, n: int, meta: dict, sort: bool = True) -> None:
    """prefix_offsets.bin, prefix_neighbors.bin and prefix_meta.json that read_csr restores, nodes without edges too; rows ascend unless sort is false."""
    from ..operators.graph import csr_offsets

    _put(edges.sparkSession, f"{prefix}_offsets.bin", _packed(csr_offsets(edges, n), ["id"], "off", "<u8"))
    _put(edges.sparkSession, f"{prefix}_neighbors.bin", _packed(edges, ["src", "dst" if sort else "pos"], "dst", "<u4"))
    most = edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    write_json({**meta, "num_points": n, "nnz": edges.count(), "max_degree": most, "sorted": sort}, f"{prefix}_meta.json", edges.sparkSession)


def write_json(doc: dict, path: str, spark: SparkSession) -> None:
    """One JSON document: metadata, or a run's record."""
    _put(spark, path, [json.dumps(doc).encode()])


def write_run(runs: DataFrame, path: str, header: dict) -> None:
    """A run's record, as read_results reads it: header and runs[], one for each pool size."""
    write_json({**header, "runs": [r.asDict() for r in runs.orderBy("L").collect()]}, path, runs.sparkSession)


def write_hierarchy(layers: DataFrame, layer_edges: DataFrame, entry: int, policy: str, path: str) -> None:
    """The JSON that read_hierarchy reads: layers (level, id), edges between ids (level, src, dst), the entry's id; local ids ascend with ids.

    A hierarchy is a few hundredths of its graph and one document; it passes the driver a level at a time.
    """
    docs = []
    for level in sorted(r.level for r in layers.select("level").distinct().collect()):
        nodes = np.sort(layers.where(F.col("level") == level).select(F.col("id").cast("long")).toArrow().column(0).to_numpy())
        got = layer_edges.where(F.col("level") == level).select("src", "dst").toArrow().sort_by([("src", "ascending"), ("dst", "ascending")])
        src, dst = (np.searchsorted(nodes, got.column(c).to_numpy()) for c in ("src", "dst"))
        offsets = np.concatenate(([0], np.cumsum(np.bincount(src, minlength=len(nodes)))))
        docs.append({"n": len(nodes), "nodes": nodes.tolist(), "offsets": offsets.tolist(), "neighbors": dst.tolist(), "edges": len(dst)})
    first = docs[0]["nodes"].index(entry) if docs else 0
    write_json({"policy": policy, "levels": docs, "entry": first}, path, layers.sparkSession)


def write_labeling(edges: DataFrame, perm: DataFrame, hot: DataFrame, prefix: str, n: int, meta: dict) -> None:
    """What a hot-first labelling leaves: relabelled CSR, prefix_perm.bin (old id of each new one), prefix_hot.u32 (old ids) and the metadata."""
    from ..operators.graph import relabel

    write_csr(cut(relabel(edges, perm)), prefix, n, {**meta, "hot_count": hot.count()})
    write_raw(perm.select(F.col("new_id").alias("pos"), F.col("old_id").alias("value")), f"{prefix}_perm.bin")
    write_raw(hot.select(F.col("id").alias("pos"), F.col("id").alias("value")), f"{prefix}_hot.u32")


def write_profile(profile: DataFrame, prefix: str) -> None:
    """prefix_expand.u32 and prefix_touch.u32 of (id, expand, touch)."""
    for column in ("expand", "touch"):
        write_raw(profile.select(F.col("id").alias("pos"), F.col(column).alias("value")), f"{prefix}_{column}.u32")


def write_encoded(encoded: DataFrame, path: str, header: dict) -> None:
    """Rows of codecs.encode, (src, deg, data, bits), as Parquet beside a header of the codec, universe and sizes; see read_encoded."""
    encoded.write.parquet(f"{path}/rows")
    write_json(header, f"{path}/header.json", encoded.sparkSession)


def read_encoded(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows, header) of write_encoded."""
    head = spark.read.json(f"{path}/header.json").first().asDict()
    return spark.read.parquet(f"{path}/rows"), head


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Any result as Parquet, in folders by the given columns (profiles, hot ids, permutations, layers by level)."""
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A report table; a report is at most `rows` long."""
    cells = [df.columns, ["---"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in df.limit(rows).collect())]
    return "\n".join(f"| {' | '.join(map(str, c))} |" for c in cells)


def svg_lines(series: dict[str, list[tuple[float, float]]], title: str, x_name: str = "", y_name: str = "", width: int = 640, height: int = 400, ticks: int = 5) -> str:
    """A line chart of named (x, y) series with axes, ticks and a legend."""
    points = [p for s in series.values() for p in s] or [(0.0, 0.0)]
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points))
    x_at = lambda x: 60 + (x - x0) / ((x1 - x0) or 1) * (width - 200)
    y_at = lambda y: height - 50 - (y - y0) / ((y1 - y0) or 1) * (height - 90)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11">', f'<text x="60" y="20" font-size="14">{escape(title)}</text>']
    out.append(f'<path fill="none" stroke="#444" d="M60,{y_at(y1):.1f} V{height - 50} H{width - 140}"/>')
    for k in range(ticks):
        x, y = x0 + (x1 - x0) * k / (ticks - 1), y0 + (y1 - y0) * k / (ticks - 1)
        out.append(f'<text x="{x_at(x):.1f}" y="{height - 34}" text-anchor="middle">{x:.4g}</text><text x="54" y="{y_at(y) + 4:.1f}" text-anchor="end">{y:.4g}</text>')
    out.append(f'<text x="{x_at((x0 + x1) / 2):.1f}" y="{height - 12}" text-anchor="middle">{escape(x_name)}</text><text transform="translate(14,{height // 2}) rotate(-90)" text-anchor="middle">{escape(y_name)}</text>')
    for k, (name, own) in enumerate(series.items()):
        colour = f"hsl({360 * k // max(1, len(series))},60%,40%)"
        out.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{x_at(x):.1f},{y_at(y):.1f}" for x, y in sorted(own))}"/>')
        out.append(f'<text x="{width - 130}" y="{40 + 16 * k}" fill="{colour}">{escape(name)}</text>')
    return "".join(out) + "</svg>"
