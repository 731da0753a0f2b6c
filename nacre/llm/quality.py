"""Operator 1: a quality classifier by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import RollingHash, mix64, word_spans

#: Labelled documents to fit on, at most (the bound of the broadcast); taken by lowest hash of the id, half for each label.
FIT_ROWS = 2000
#: Latent dimensions, neighbours that vote, and the power on their similarities.
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 24
#: Terms by hash: word shapes' trigrams, and words themselves, whose vector has WORD_WEIGHT times the length of the shapes'.
HASHED, WORDS, WORD_WEIGHT = 2048, 2048, 0.5
_SHAPES = HASHED + 64

# Classes of bytes for shape n-grams: each ASCII sign has its own, letters and digits are by case and kind.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 1
for _k, _c in enumerate("!#$%&'()*+,-./:;<=>?@[]^_`{|}~\"\\"):
    _CLASS[ord(_c)] = 6 + _k
_N = 6 + _k + 1


def features(text: str | None) -> np.ndarray:
    """Counts of a whole text's terms: byte-class trigrams (hashed), word shapes, how words and lines repeat, and words (hashed).

    Letters beyond ASCII count as lower case but for the capitals of Latin-1; null is taken as empty; both give zeros."""
    out = np.zeros(_SHAPES + WORDS, dtype=np.float64)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if not len(data):
        return out
    c = _CLASS[data]
    if len(data) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
        c[upper] = c[upper + 1] = 2
    # Runs of one class count once, so that a word's length does not matter.
    starts, ends = word_spans(data)
    keep = np.r_[True, c[1:] != c[:-1]]
    r = c[keep]
    if len(r) >= 3:
        grams = (r[:-2] * _N + r[1:-1]) * _N + r[2:]
        out[:HASHED] = np.bincount((mix64(grams.astype(np.uint64)) % np.uint64(HASHED)).astype(np.int64), minlength=HASHED)
    n = len(starts)
    if n:
        h = RollingHash(data)(starts, ends)
        again = np.count_nonzero(h[1:] == h[:-1])
        distinct = len(np.unique(h))
        first, last = c[starts], c[ends - 1]
        shape = (np.bincount(first, minlength=_N) > 0).sum()
        out[HASHED] = again
        out[HASHED + 1] = n - again
        out[HASHED + 2] = np.count_nonzero((first == 2) & (c[np.minimum(starts + 1, ends - 1)] == 2) & (ends - starts > 1))
        out[HASHED + 3] = np.count_nonzero(first == 1)
        out[HASHED + 4] = np.count_nonzero(last >= 6)
        out[HASHED + 5] = np.count_nonzero((ends - starts == 1) & (first >= 6))
        out[HASHED + 6] = (n - distinct) * (n >= 20) * 0.25
        out[HASHED + 7] = np.count_nonzero(c == 5)
        out[HASHED + 8] = shape
        if n >= 16:  # eight-word windows that come back
            w = h[:-7].copy()
            for j in range(1, 8):
                w = mix64(w) + h[j : n - 7 + j]
            out[HASHED + 9] = len(w) - len(np.unique(w))
        out[HASHED + 16 + min(15, int(np.log2(n + 1)))] = 1 + 0.02 * n  # length by powers of two
        out[_SHAPES:] = np.bincount((h % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows as unit vectors: of shape terms' root shares, and words' root counts, both times inverse document frequency."""
    total = np.maximum(x[:, :HASHED].sum(1, keepdims=True), 1)
    shapes = _unit(np.sqrt(x[:, :_SHAPES] / total) * idf[:_SHAPES])
    words = _unit(np.sqrt(x[:, _SHAPES:]) * idf[_SHAPES:])
    return _unit(np.concatenate([shapes, WORD_WEIGHT * words], axis=1))


class Model:
    """Projection to the latent space and the labelled vectors there; its size is bounded by FIT_ROWS x DIMENSIONS and the terms."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        """`counts` are features() of the labelled texts, a row each."""
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float64)
        if len(labels) == 0 or labels.min() == labels.max():
            self.vectors = None
            return
        x = counts.astype(np.float32)
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.3).astype(np.float32)
        y = _weigh(x, self.idf)
        # Singular vectors by way of the rows' products, of which there are fewer than of the terms'.
        value, u = np.linalg.eigh((y @ y.T).astype(np.float64))
        value, u = value[::-1][:DIMENSIONS], u[:, ::-1][:, :DIMENSIONS]
        real = value > 1e-6 * value[0]
        self.basis = (y.T @ (u[:, real] / np.sqrt(value[real]))).astype(np.float32)
        self.vectors = self.project(y)

    def project(self, y: np.ndarray) -> np.ndarray:
        z = y.astype(np.float32) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], block: int = 128) -> np.ndarray:
        """Similarity-weighted shares of label 1 among the nearest labelled vectors, by exact cosines block by block.

        Each neighbour votes with its cosine to the power of SHARPNESS. Texts without any byte (null, empty) get 0."""
        out = np.full(len(texts), self.prior)
        if self.vectors is None:
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), block):
            x = np.stack([features(t).astype(np.float32) for t in texts[at : at + block]])
            cos = self.project(_weigh(x, self.idf)) @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            sim = np.take_along_axis(cos, near, 1).astype(np.float64)
            w = np.clip(sim, 0, None) ** SHARPNESS + 1e-9
            s = (w * self.labels[near]).sum(1) / w.sum(1)
            out[at : at + block] = np.where(x.any(1), s, 0.0)
        return np.clip(out, 0.0, 1.0)


def fit(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fit on at most `most` labelled documents, the same for the same rows; null labels and ids don't count.

    Of an id's labels the largest counts, of its texts the one with the least hash."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = []
    for value in (0, 1):
        # limit over an order by a hash: each task keeps its own top rows; only `most` rows reach the driver.
        ids = known.where(F.col("quality") == value).withColumn("h", F.xxhash64("doc_id", F.lit(17))).orderBy("h", "doc_id").limit(most // 2).select("doc_id", "quality")
        rows.append(ids)
    chosen = rows[0].unionByName(rows[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(3).to_pylist():
                x = features(t)
                at = np.flatnonzero(x)
                made.append(at.astype(np.int32).tobytes() + x[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["doc_id", "quality", "h", "terms"])

    # Texts stay where they are: what comes to the driver is counts of terms, of bounded size however long a text is, once for an id.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.xxhash64("text").alias("h"), "text")
    got = texts.mapInArrow(count, "doc_id long, quality int, h long, terms binary").groupBy("doc_id").agg(F.min(F.struct("h", "quality", "terms")).alias("x")).orderBy("doc_id").select("x.*").collect()
    counts = np.zeros((len(got), _SHAPES + WORDS), dtype=np.float32)
    for row, r in zip(counts, got, strict=True):
        n = len(r["terms"]) // 8
        row[np.frombuffer(r["terms"], np.int32, n)] = np.frombuffer(r["terms"], np.float32, n, 4 * n)
    return Model(counts, np.array([r["quality"] for r in got], dtype=np.float64))


def classify(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """`documents` with score (0 to 1) and predicted (1 from 0.5 on), every column else as it was.

    `labels` (doc_id, quality) are the rows to learn from. Without labels of both kinds every score is the labels' mean (0.5 without any).
    Null and empty texts score 0. Clashing columns named score or predicted are replaced."""
    spark = documents.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(documents, labels, most))
    kept = documents.drop("score", "predicted")
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                s = model.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, schema)
