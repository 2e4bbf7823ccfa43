"""Shared helpers of the training-data operators: scratch tables, Arrow passes, word hashing.

Every operator takes its columns by name and drops the rest before it adds its
own, so extra columns whose names clash with an operator's cannot disturb it.
"""

from __future__ import annotations

import contextvars
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch_root

#: Words remembered by one Python worker before its table is emptied.
WORD_CACHE = 600_000
_SCRATCH: contextvars.ContextVar = contextvars.ContextVar("scratch", default=None)


class Scratch:
    """Notes the tables that operators write while it is entered, so that release() deletes these and no others."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._before = _SCRATCH.set(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _SCRATCH.reset(self._before)

    def release(self, spark: SparkSession) -> None:
        """Delete the tables; frames built on them can't be read afterwards."""
        while self.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: later steps don't repeat its work.

    lasting: no Scratch notes it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting and _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """(doc_id, text) and the carried columns under names of their own; see arrow_map."""
    more = [F.col(c).alias(f"_carry_{c}") for c in carry if c not in (id_col, text_col)]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have `least` bytes."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def arrow_map(df: DataFrame, fn: Callable, schema: str, rows: int = 0, carry: tuple = (), text_col: str = "text", gather: int = 0) -> DataFrame:
    """mapInArrow over batches, cut into slices of `rows`; fn may return the columns as a dict. Empty batches are skipped.

    gather: batches are put together until they have so many bytes, for work whose cost is by the batch.

    carry: columns of the input that go along unchanged, where fn returns one
    row for each of its own; df must come from id_text(..., carry).
    """
    own = _struct(schema).fields
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in own])
    along = [(c, "text" if c == text_col else f"_carry_{c}") for c in carry if c not in {f.name for f in own}]
    full = ", ".join([schema, *(f"`_carry_{c}` {df.schema[at].dataType.simpleString()}" for c, at in along)])
    places = [df.columns.index(at) for _, at in along]
    arrow_full = pa.schema([*arrow, *((f"_carry_{c}", _arrow(df.schema[at].dataType)) for c, at in along)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _then_free(_gathered(batches, gather) if gather else batches):
            for k in range(0, whole.num_rows, rows or whole.num_rows or 1):
                batch = whole.slice(k, rows) if rows else whole
                if (out := fn(batch)) is not None:
                    cols = [_as(out[f.name], f.type) for f in arrow] if isinstance(out, dict) else list(out.columns)
                    yield pa.RecordBatch.from_arrays(cols + [_as(batch.column(p), arrow_full.field(len(arrow) + i).type) for i, p in enumerate(places)], schema=arrow_full)

    out = df.mapInArrow(run, full)
    return out.select(*(f.name for f in own), *(F.col(f"_carry_{c}").alias(c) for c, _ in along))


def _then_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; after the last one the worker, which waits for other tasks, gives back what it doesn't need."""
    yield from batches
    HASHES.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def strings(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """A string column; null is the empty text."""
    return batch.column(batch.schema.get_field_index(col)).fill_null("").to_pylist()


def raw_bytes(batch: pa.RecordBatch, col: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding; null is the empty text."""
    a = batch.column(batch.schema.get_field_index(col))
    return a.fill_null("").cast(pa.large_binary() if pa.types.is_large_string(a.type) else pa.binary()).to_pylist()


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; emptied when full, so that memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


#: One per Python worker.
HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def signed(a: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed long."""
    return a.view(np.int64)


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def fold(column, modulus: int):
    """crc32 of an id as text, modulo: the held-out rule of the queries (a null id counts as the text '')."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
