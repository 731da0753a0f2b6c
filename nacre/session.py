"""Session defaults, and the way this package's code reaches Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build(app: str = "nacre", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and skew joins on; whatever the cluster already sets wins."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the session's Python workers, once, by Spark's own file distribution.

    Workers then import it wherever they run; an installed copy or PYTHONPATH does no harm."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="nacre-")) / "nacre-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def durable(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed now and kept in spark.checkpoint.dir, with its lineage and its plan cut.

    Plans built on it start from stored rows: they are short, and the loss of executors costs no earlier step. Only in local mode may a
    session do without a folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
