"""From documents to packed sequences: STAGES in order, each reading what the one before it kept.

Every function takes (spark, docs, sf_dir); docs is what the previous stage
returned, written as Parquet and read again, so a stage may drop the scratch
tables that the stage before it made, and drops no others.

In every stage: a null text is an empty one; texts are taken whole, however
long; rows are told apart by themselves, so repeated rows and null or repeated
ids stay what they are; columns but COLUMNS are dropped, so none can clash with
an operator's; an empty table gives no rows. What differs is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, materialize
from nearfield.llm.decontamination import find_leaks
from nearfield.llm.minhash import near_duplicates
from nearfield.llm.packing import pack
from nearfield.llm.suffix_dedup import remove_repeats
from nearfield.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The tables of the stage that ran last.
_LAST = Scratch()


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are predicted toxic (score 0.5 or more, ties too).

    Texts without letters score as texts without any known subsequence; without
    labels of both classes all score the rate of toxic labels, and stay unless
    that is 0.5 or more. Equal texts get equal scores.
    """
    _LAST.release(spark)
    with _LAST:
        scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=tuple(COLUMNS))
    return scored.where("predicted = 0").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest id, null ids last, of equal ids any one.

    Texts without words are in no group, so repeated empty rows all stay.
    """
    _LAST.release(spark)
    with _LAST:
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS), "rows")
        found = near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row"))
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(first.alias("first")).select("first._row")
    return rows.join(kept, "_row").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of more than 50 words that occurs elsewhere, in all its places, as op9 cuts its strings of 400 bytes.

    Words are those of near_dedup, so case and white space between them don't
    hide a passage. The document stays, if empty; null texts become empty ones.
    A text that is left twice word for word loses all of them, so this stage
    comes after near_dedup.
    """
    _LAST.release(spark)
    with _LAST:
        cut = remove_repeats(docs, 51, unit="word", keep_text=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; an empty benchmark drops none."""
    _LAST.release(spark)
    with _LAST:
        found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(COLUMNS))
    return found.where("n_hit = 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; an empty text is one piece, the end id alone, and of equal lengths the smaller id is placed first."""
    _LAST.release(spark)
    with _LAST:
        return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), max_tokens=2048)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Learned scores and substring removal can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others return is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
