"""How plans are cut and numbered: scratch tables and distributed row numbers."""

from __future__ import annotations

import atexit
import gc
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, shared by all executors; in one machine's local mode a temporary folder where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_nearfield_scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark._nearfield_scratch = tempfile.mkdtemp(prefix="nearfield-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/nearfield-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage; lost executors lose nothing."""
    path = f"{scratch_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete tables that cut() returned and nothing reads any more; what was shuffled for them goes with the driver's next collection of garbage, which is asked for."""
    for df in cuts:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    if cuts:
        cuts[0].sparkSession._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete all tables that this application cut; frames built on them can't be read afterwards."""
    at = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *order: Column | str, name: str = "new_id", start: int = 0) -> DataFrame:
    """Rows numbered from start in the given total order, without a task that sees all rows.

    Range partitions are sorted apart; the number of rows before each partition
    (one number a partition) is added to the place within it.
    """
    own = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = cut(own.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = {r._part: r["count"] for r in own.groupBy("_part").count().collect()}
    before = itertools.accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=start)
    place = F.get(F.expr(f"array({', '.join(f'{x}L' for x in before)})"), F.col("_part").cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return own.withColumn(name, place).drop("_at", "_part")
