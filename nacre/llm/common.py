"""Shared pieces of the training-data operators: durable intermediate results, hashing in numpy, connected components."""

from __future__ import annotations

import tempfile
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every rule here: maximal runs of anything but space and the ASCII controls 9 to 13.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, else the folder that its setCheckpointDir named, else, in local mode alone, one of our own."""
    sc = spark.sparkContext
    named, current = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or str(current.get())
    if not named and not sc.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    root = named or tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the reliable checkpoint folder, with its lineage cut.

    Later stages survive the loss of any executor. With spark.cleaner.referenceTracking.cleanCheckpoints, which session.build
    sets, the files go with the last reference to the frame; else they stay until the folder is emptied."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves 1 on division by 3."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1


def held_out_py(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = tuple(mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, grown as longer texts come."""
    if kind not in _POW or len(_POW[kind][0]) <= n:
        both = []
        for b in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            p = np.full(max(1 << 16, 1 << int(n + 1).bit_length()), b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POW[kind] = both[0], both[1]
    return _POW[kind]


class RollingHash:
    """64-bit hashes of any substring of a byte string: prefix sums of a polynomial over random byte values modulo 2^64.

    The two kinds (0 and 1) have bases and byte values of their own."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        up, down = _powers(len(data), kind)
        self.up = up
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[kind][data] * down[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k bytes, in order, mixed as far as their upper bits and their order need."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        x = self.sums[k:] - self.sums[:-k]
        x *= self.up[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a UTF-8 text."""
    ink = np.zeros(len(data) + 2, dtype=np.int8)
    ink[1:-1] = ~_SPACE[data]
    edge = np.diff(ink)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Filter:
    """Bloom filters in segments, each for the keys (uint64) that are its number modulo the segments'. Its size is bounded: a
    segment has at most `most` / segments bytes, however many keys it holds; a fuller one passes more keys that aren't there."""

    def __init__(self, bitmaps: dict[int, bytes], segments: int):
        maps = [np.frombuffer(bitmaps.get(s, b"\0" * 8), dtype=np.uint8) for s in range(segments)]
        self.segments, self.data = segments, np.concatenate(maps)
        self.base = np.cumsum([0] + [len(m) for m in maps])[:-1].astype(np.int64)
        self.mask = np.array([len(m) * 8 - 1 for m in maps], dtype=np.uint64)

    @staticmethod
    def _bits(keys: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
        return mix64(keys) & mask, mix64(keys ^ np.uint64(0xA0761D6478BD642F)) & mask

    @staticmethod
    def build(keys: np.ndarray, segments: int, most: int = 64 << 20) -> bytes:
        size = 8
        while size * 8 < 12 * len(keys) and 2 * size * segments <= most:
            size *= 2
        out = np.zeros(size, dtype=np.uint8)
        for b in Filter._bits(keys, np.uint64(size * 8 - 1)):
            np.bitwise_or.at(out, (b >> np.uint64(3)).astype(np.int64), np.uint8(1) << (b & np.uint64(7)).astype(np.uint8))
        return out.tobytes()

    def has(self, keys: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Which keys may be there; the segments are those of `of`, by default of the keys."""
        yes = np.arange(len(keys))
        for salt in (np.uint64(0), np.uint64(0xA0761D6478BD642F)):  # the second bit is looked up only where the first is set
            k = keys[yes]
            s = ((k if of is None else of[yes]) % np.uint64(self.segments)).astype(np.int64)
            b = mix64(k ^ salt) & self.mask[s]
            yes = yes[(self.data[self.base[s] + (b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(keys), dtype=bool)
        out[yes] = True
        return out


def id_filter(ids: DataFrame, segments: int = 64) -> Filter:
    """A Filter of a column of longs, built in parallel; only its bitmaps come to the driver."""
    import pyarrow as pa

    name = ids.columns[0]

    def build(key, part):
        keys = part.column(name).to_numpy().view(np.uint64)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([Filter.build(keys, segments)], pa.binary())})

    # pmod of the signed value would differ from the unsigned remainder, so segments are by low bits.
    assert segments & (segments - 1) == 0
    keyed = ids.where(F.col(name).isNotNull()).select(F.col(name).cast("long"), F.col(name).cast("long").bitwiseAND(F.lit(segments - 1)).cast("int").alias("segment"))
    rows = keyed.groupBy("segment").applyInArrow(build, "segment int, bitmap binary").collect()
    return Filter({r["segment"]: bytes(r["bitmap"]) for r in rows}, segments)


#: Keys that a join may broadcast as hot, at most.
MOST_HOT = 10_000


def split_join(rows: DataFrame, found: DataFrame, on: list[str], count: str) -> DataFrame:
    """`rows` joined with `found` on its keys; `count`, which is dropped, says how many of the rows have each.

    Keys with more than one in MOST_HOT of the rows that match at all, so fewer than MOST_HOT keys, are broadcast and their
    rows stay where they are; the others meet in an ordinary join, in which none is large. Both are read twice: have them durable."""
    total = found.agg(F.sum(count)).first()[0] or 0
    hot, cold = (found.where(F.col(count) * MOST_HOT > total).drop(count), found.where(F.col(count) * MOST_HOT <= total).drop(count))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every id in the edges; component is the smallest id reachable.

    Alternating large-star and small-star contraction, until a round gives back the very edges it was given. Each round
    aggregates minima per node before it joins, so a hub with very many neighbours costs a partial aggregate and a join
    side that AQE may split, never one task's list. Rounds grow with the logarithm of the longest path."""
    e = durable(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct())
    n, settled = e.count(), False
    while not settled:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, durable(moved.union(down.select("a", F.col("m").alias("b"))).distinct())
        was, n = n, e.count()
        settled = n == was and e.join(before, ["a", "b"], "left_anti").isEmpty()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
