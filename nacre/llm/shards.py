"""Operator 6: size-tiered compaction of immutable shards under versioned manifests. Spark's writers and readers only."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: Size of a finished file; a tier's sizes lie within a factor of FANOUT; runs of a tier that call for a merge.
TARGET_BYTES, FANOUT, MERGE_AT = 64 << 20, 4, 4


class Store:
    """A folder of shards. Files never change; what counts is what the newest manifest lists.

    data/<arrival>/part-*.parquet hold rows; manifests/<version>.json list files with their sizes. A commit writes the
    manifest beside its place and renames it there, which fails if that version exists: of two writers one wins, the other
    reads anew and tries again. Readers see one whole version. All paths go through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The named or newest version: {"version", "files": [{"path", "bytes"}]}; version 0, without files, before any commit."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "files": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change) -> dict | None:
        """Put `change(files)` in force as the next version; again from the newest if another writer was first. None if change gives up."""
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = getattr(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        for _ in range(20):
            now = self.manifest()
            files = change(now["files"])
            if files is None:
                return None
            new = {"version": now["version"] + 1, "files": files}
            aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
            out = self._fs.create(aside, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            try:
                context.rename(aside, self._path(f"{self.root}/manifests/{new['version']:012d}.json"), none)
                return new
            except Exception as e:  # noqa: BLE001
                self._fs.delete(aside, False)
                if "AlreadyExists" not in str(e):
                    raise
        raise RuntimeError("other writers kept committing first")

    def _files(self, folder: str) -> list[dict]:
        out = []
        it = self._fs.listFiles(self._path(folder), True)
        while it.hasNext():
            s = it.next()
            if s.getPath().getName().startswith("part-"):
                out.append({"path": s.getPath().toString(), "bytes": s.getLen()})
        return sorted(out, key=lambda f: f["path"])

    def append(self, rows: DataFrame) -> dict:
        """One arrival: a small immutable shard for each task of `rows`, in force after one commit.

        An empty arrival adds nothing, but for the first one, whose empty shard tells readers the columns."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        new = self._files(folder)
        now = self.manifest()
        if now["files"] and self._read(new).isEmpty():
            self._fs.delete(self._path(folder), True)
            return now
        return self._commit(lambda files: files + new)

    def _tier(self, size: int) -> int:
        """Tiers count down from the target by factors of FANOUT; 0 is finished."""
        return 0 if size >= self.target // 2 else math.ceil(math.log(self.target / 2 / max(size, 1), FANOUT))

    def compact(self, all_tiers: bool = False) -> int:
        """Merge tiers with MERGE_AT runs or more, from the smallest up, until none has as many; the number of merges.

        A tier's files are merged without a shuffle into files of about the target size. A merge that is lost midway leaves
        files that no manifest lists. If another writer has merged one of the same runs meanwhile, that merge stands and this
        one is dropped: rows are never listed twice. `all_tiers` merges unfinished files whatever their number, once, at the end."""
        merges = 0
        while True:
            files = self.manifest()["files"]
            tiers: dict[int, list[dict]] = {}
            for f in files:
                tiers.setdefault(self._tier(f["bytes"]), []).append(f)
            due = [t for t in sorted(tiers, reverse=True) if t and len(tiers[t]) >= MERGE_AT]
            if due:  # similar sizes that are due at once go in one job, whose outputs land in higher tiers
                runs = [f for t in due for f in tiers[t]]
            elif all_tiers and len([f for f in files if self._tier(f["bytes"])]) > 1:
                runs, all_tiers = [f for f in files if self._tier(f["bytes"])], False
            else:
                return merges
            n = max(1, round(sum(f["bytes"] for f in runs) / self.target))
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self._read(runs).coalesce(n).write.option("compression", "zstd").parquet(folder)
            gone, new = {f["path"] for f in runs}, self._files(folder)
            if len(new) >= len(runs):
                self._fs.delete(self._path(folder), True)
                return merges

            def swap(now: list[dict], gone=gone, new=new) -> list[dict] | None:
                rest = [f for f in now if f["path"] not in gone]
                return rest + new if len(rest) == len(now) - len(gone) else None

            if self._commit(swap) is None:
                self._fs.delete(self._path(folder), True)
            else:
                merges += 1

    def vacuum(self) -> int:
        """Delete data files that the newest manifest doesn't list; for when no older version is being read."""
        live = {f["path"] for f in self.manifest()["files"]}
        dead = [f for f in self._files(f"{self.root}/data") if f["path"] not in live]
        for f in dead:
            self._fs.delete(self._path(f["path"]), False)
        return len(dead)

    def _read(self, files: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f["path"] for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, with the name of the shard each is in (column shard)."""
        files = self.manifest(version)["files"]
        if not files:
            raise ValueError("the store has no rows yet")
        return self._read(files).withColumn("shard", F.col("_metadata.file_name"))


def shared_root(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def arrive_and_compact(documents: DataFrame, root: str, target: int = TARGET_BYTES) -> Store:
    """`documents` as one arrival of small shards under `root`, compacted into target-sized files, superseded files deleted."""
    store = Store(documents.sparkSession, root, target)
    store.append(documents)
    store.compact(all_tiers=True)
    store.vacuum()
    return store
