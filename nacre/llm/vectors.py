"""Operator 3: near-duplicate embeddings by int8 tile products with error bounds, recomputed in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import components, durable

#: Bytes, in double precision, of a group of vectors (a task holds two groups, some of it several times over), and rows of a tile.
GROUP_BYTES, TILE = 48 << 20, 2048
#: Products of int8 codes are exact in single precision for so many dimensions; longer vectors are multiplied in slices.
_EXACT = 1024
#: What rounding in double precision may add; far above it, far below any bound that matters.
_SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales and exact errors |x - scale * code| of unit vectors."""
    scale = np.abs(x).max(1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - scale[:, None] * codes, axis=1) + 1e-15


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes."""
    out = a[:, :_EXACT].astype(np.float32) @ b[:, :_EXACT].astype(np.float32).T
    if a.shape[1] > _EXACT:
        out = out.astype(np.float64)
        for k in range(_EXACT, a.shape[1], _EXACT):
            out += a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T
    return out


class Links:
    """Counts of links and a spanning forest over `n` vectors; links come in blocks and are not kept."""

    def __init__(self, n: int):
        self.root, self.count = np.arange(n), np.zeros(n, dtype=np.int64)

    def add(self, i: np.ndarray, j: np.ndarray, copies: np.ndarray) -> None:
        np.add.at(self.count, i, copies[j])
        np.add.at(self.count, j, copies[i])
        f = self.root
        while True:
            a, b = f[i], f[j]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(f, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(g := f[f], f):
                f = g
            self.root = f
            i, j = i[apart], j[apart]


def link_tiles(x: np.ndarray, first: np.ndarray, second: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each, root of each) among the rows `first` and between `first` and `second` (or among `first` alone if they are one).

    A pair is recomputed in double precision only if its int8 product plus both vectors' errors reaches the threshold."""
    codes, scale, error = quantise(x)
    found = Links(len(x))
    same = first is second
    for at in range(0, len(first), TILE):
        i = first[at : at + TILE]
        for to in range(at if same else 0, len(second), TILE):
            j = second[to : to + TILE]
            p = tile_product(codes[i], codes[j])
            e, g = error[i], error[j]
            worst = e.max() * (1 + g.max()) + g.max() * (1 + e.max()) + e.max() * g.max() + _SLACK
            # Codes' products are whole numbers: a row's least one that can matter, rounded down, is compared in p's own precision.
            least = np.floor((threshold - worst) / (scale[i] * (scale[j].max() if threshold > worst else scale[j].min()))).astype(p.dtype)
            r, c = np.nonzero(p >= least[:, None])
            if same and at == to:
                keep = r < c
                r, c = r[keep], c[keep]
            bound = e[r] * (1 + g[c]) + g[c] * (1 + e[r]) + e[r] * g[c] + _SLACK
            keep = p[r, c] * scale[i[r]] * scale[j[c]] + bound >= threshold
            r, c = r[keep], c[keep]
            if not len(r):
                continue
            if len(r) > p.size // 16:
                full = (x[i] @ x[j].T)[r, c]
            else:
                full = np.concatenate([np.einsum("ij,ij->i", x[i[r[k : k + 50_000]]], x[j[c[k : k + 50_000]]]) for k in range(0, len(r), 50_000)])
            keep = full >= threshold
            found.add(i[r[keep]], j[c[keep]], copies)
    return found.count, found.root


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding): links are cosines of threshold or more.

    All rows are compared. Copies of one vector form a class, compared once and counted by its size. Classes are dealt by a hash
    into groups of about GROUP_BYTES; a task takes two groups, multiplies their int8 codes tile by tile and gives back a count
    for each vector and a spanning forest, so a dense neighbourhood costs rows in proportion to its vectors, not its pairs.
    Null and zero vectors and those with null or non-finite components link with nothing, nor do vectors of different
    length; rows of one id and vector count as copies; rows without an id link with nothing; extra columns are ignored."""
    spark = vectors.sparkSession
    ship(spark)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for v in batch.column(1).to_pylist():
                x = None if not v or any(c is None for c in v) else np.asarray(v, dtype=np.float64)
                kept.append(None if x is None or not np.isfinite(x).all() or not (x != 0).any() else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["vec_id", "v"])

    rows = durable(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(prepare, "vec_id long, v binary").withColumn("key", F.sha2("v", 256)))
    usable = rows.where("v IS NOT NULL AND vec_id IS NOT NULL")
    classes = durable(usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    n, size = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
    parallel = spark.sparkContext.defaultParallelism
    groups = max(1, math.ceil(size / GROUP_BYTES), min(math.ceil(math.sqrt(2 * parallel)), math.ceil(n / TILE)))
    g = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(groups)).cast("int")
    to = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = classes.select("rep", "copies", "v", F.length("v").alias("dim"), g.alias("g")).withColumn("o", to)
    dealt = dealt.select("rep", "copies", "v", "g", "dim", F.least("g", "o").alias("p"), F.greatest("g", "o").alias("q"))

    def compare(key, part):
        ids = part.column("rep").to_numpy()
        order = np.argsort(ids)
        ids, copies, of = ids[order], part.column("copies").to_numpy()[order], part.column("g").to_numpy()[order]
        x = np.frombuffer(b"".join(part.column("v").to_pylist()), dtype=np.float64).reshape(len(ids), -1)[order]
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        p, q = key[1].as_py(), key[2].as_py()
        first = np.flatnonzero(of == p)
        count, root = link_tiles(x, first, first if p == q else np.flatnonzero(of == q), copies, threshold)
        some = np.flatnonzero(count)
        return pa.table([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(count[some])], names=["a", "b", "n"])

    linked = durable(dealt.groupBy("dim", "p", "q").applyInArrow(compare, "a long, b long, n long"))
    counts = linked.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    parts = components(linked.select("a", "b")).withColumnRenamed("id", "rep")
    of_class = classes.select("key", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    of_class = of_class.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("of"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(of_class, "key", "left")
    component = F.coalesce("of", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
