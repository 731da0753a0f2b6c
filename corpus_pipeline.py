"""The corpus pipeline: quality, repeated lines, near duplicates, source mixing and packing, each stage on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back for the next. All
but the last return the columns of documents. Stages give defined results for null texts, repeated rows, empty tables and
extra columns: see each operator's docstring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nacre.llm import lines, minhash, mixing, packing, quality
from nacre.llm.common import ensure_checkpoint_dir, held_out, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts go, repeated rows are judged each. It learns from the
    labelled rows outside the held-out third; without labels of both kinds none is rejected unless the labels' mean is under 0.5."""
    judged = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels").where(~held_out()))
    return judged.where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their later repeated runs of lines; those of which no word is left go, those that had none (null, empty) stay.

    Repeated rows share their cuts; n_chars is made new where the text is."""
    cleaned = lines.dedup(docs.select(*COLUMNS))
    return cleaned.where("n_removed = 0 OR n_removed < n_lines").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id.

    Rows that are equal in all columns are one; of rows with one id but different texts each is judged by its own text. Rows
    without an id or without words stay."""
    gone = minhash.near_duplicates(docs, k=5, num=80, den=100).where("NOT kept").select(F.col("doc_id").alias("of"), F.col("text_hash").alias("h")).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    return rows.join(gone, (F.col("doc_id") == F.col("of")) & (F.col("text_hash") == F.col("h")), "left_anti").distinct().select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy that the sources' targets ask for, the last of a source's being cut. A text without
    words takes none of a target and comes back once for each whole epoch. Null is a source of its own."""
    return mixing.materialise(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; copies of a document, and rows repeated under one id, are packed each; a null text is its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer are no SQL; tests hold each stage after the classifier against a plain version, and the
#: classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again; what it was made of goes then."""
    docs = table(spark, sf_dir, "documents")
    root, before = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{root}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
