"""Analysis of structures as they arrive in a folder: an extension; the analyses themselves are those of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.analysis import Analysis
from ..sources import pdb


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], **options):
    """Start a stream over new PDB files of a folder; each batch's interfaces go to sink(interfaces, batch id).

    Files are taken up once (the checkpoint remembers them); a batch that is run again after a failure gives the same rows."""
    files = spark.readStream.option("wholetext", "true").format("text").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def batch(df: DataFrame, number: int) -> None:
        named = df.select(pdb.structure_id_of("path").alias("structure_id"), "path", "text")
        lines = pdb.lines_of(named)
        a = Analysis(pdb.number_atoms(pdb.select_altlocs(pdb.parse_atoms(lines))), pdb.structures_of(lines), **options)
        sink(a.interfaces, number)
        a.release()

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
