"""Reference data at rest: files kept by entry, calibration tables, and the frame that entries are sampled from.

Fetching is no work for executors: a mirror (rsync, HTTP) fills the folder beforehand, one file an entry; these read what is there and say what is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Suffixes of an entry's files by what they hold.
SUFFIXES = {"interfaces": ".xml.gz", "multimers": ".multimers.xml.gz", "coordinates": ".pdb.gz", "assembly": ".json.gz"}
#: The frame: method, worst resolution, fewest polymer chains, most atoms, latest release.
METHOD, MAX_RESOLUTION, MIN_CHAINS, MAX_ATOMS, MAX_RELEASE = "X-RAY DIFFRACTION", 3.0, 2, 12_000, "2018-06-30"


def kept(spark: SparkSession, root: str, what: str) -> DataFrame:
    """pdb_id, path and bytes of an archive's files of one kind; only the folder is listed."""
    suffix = SUFFIXES[what]
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    other = [s for s in SUFFIXES.values() if s != suffix and s.endswith(suffix)]
    for s in other:
        d = d.where(~F.col("path").endswith(s))
    return d.select(F.lower(F.expr("substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - %d)" % len(suffix))).alias("pdb_id"), "path", "bytes", name.alias("name"))


def wanted(entries: DataFrame, there: DataFrame) -> DataFrame:
    """Entries (pdb_id) that an archive lacks: what a mirror has still to fetch."""
    return entries.select(F.lower("pdb_id").alias("pdb_id")).distinct().join(there.select("pdb_id"), "pdb_id", "left_anti")


def save_table(table: DataFrame, path: str) -> None:
    """A calibration table as gzipped JSON lines, a file for each partition."""
    table.write.mode("overwrite").option("compression", "gzip").json(path)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table as save_table wrote it; fields that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def sampling_frame(entries: DataFrame) -> DataFrame:
    """One entry for each cluster of like sequences, the best resolved (then the first by id), of those that meet the frame's conditions.

    entries: pdb_id, cluster, method, resolution, polymer_chains, atoms, released (ISO date)."""
    ok = (F.col("method") == METHOD) & (F.col("resolution") <= MAX_RESOLUTION) & (F.col("polymer_chains") >= MIN_CHAINS) & (F.col("atoms") <= MAX_ATOMS) & (F.col("released") <= MAX_RELEASE)
    best = F.row_number().over(W.partitionBy("cluster").orderBy("resolution", "pdb_id"))
    return entries.where(ok).withColumn("place", best).where("place = 1").drop("place")
