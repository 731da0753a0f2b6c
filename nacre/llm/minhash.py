"""Operator 7: near-duplicate documents by b-bit MinHash over word shingles, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import RollingHash, components, durable, id_filter, mix64, word_spans

#: Hash functions, bits kept of each minimum, rows of a band, bands (of the first minima). 40 bands of 6 miss a pair at
#: similarity 0.8 five times in a million, one at 0.85 six times in 1e9; unlike texts that share a passage rarely meet.
HASHES, BITS, ROWS, BANDS = 1024, 2, 6, 40
LONGS = HASHES * BITS // 64
_A = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_C = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xAF251AF3B0F025B5)) >> np.uint64(32)).astype(np.uint32)
_KEEP = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A long text's shingles are hashed in blocks of so many, which bounds the work space.
_BLOCK = 256


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text (A-Z lower-cased); fewer words make one shingle; none, none."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)]
    start, end = word_spans(data)
    if not len(start):
        return np.empty(0, np.uint64)
    h = RollingHash(data)(start, end)
    k = min(k, len(h))
    g = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        g = mix64(g + h[j : len(h) - k + 1 + j])
    return np.unique(g)


def minima(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set: affine permutations of 32 bits of the shingles' hashes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), _BLOCK):
        np.minimum(out, (x[i : i + _BLOCK, None] * _A + _C).min(0), out=out)
    return out.astype(np.uint64)


def sign(text: str | None, k: int) -> tuple:
    """(n_shingles, two digests of the set, band hashes, packed low bits of the minima)."""
    s = shingles(text, k)
    if not len(s):
        return 0, 0, 0, [], [0] * LONGS
    m = minima(s)
    bands = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        bands = mix64(bands + m[r : ROWS * BANDS : ROWS])
    # An affine permutation's low bits depend on its argument's low bits alone, so the minima are mixed before bits are kept.
    low = (mix64(m + _KEEP) & np.uint64((1 << BITS) - 1)).reshape(LONGS, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
    return len(s), *digests(s), bands.view(np.int64).tolist(), packed.view(np.int64).tolist()


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n, d0, d1 (digests of the set), bands, sig and text_hash, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [sign(t, k) for t in part.column(1).to_pylist()]
                cols = [pa.array([g[j] for g in got], pa.int64() if j < 3 else pa.list_(pa.int64())) for j in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, part.column(2)], ["doc_id", "n", "d0", "d1", "bands", "sig", "text_hash"])

    rows = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, n long, d0 long, d1 long, bands array<long>, sig array<long>, text_hash long")


def digests(s: np.ndarray) -> list[int]:
    return [int(mix64(s ^ np.uint64(x)).sum(dtype=np.uint64).view(np.int64)) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def full_sets(documents: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """id, the set's first digest d0 and the whole set of shingle hashes, of the documents named in `ids`; texts are not moved, only the sets asked for.

    Which documents those are travels as a filter of bounded size; what it lets through wrongly goes in the join."""
    known = documents.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            named[named] = known.value.has(batch.column(0).drop_null().to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(named))
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [shingles(t, k) for t in part.column(1).to_pylist()]
                first = pa.array([digests(s)[0] for s in got], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), first, pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], ["id", "d0", "s"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, d0 long, s array<long>")


def estimate(a, b):
    """Similarity of two packed signatures: the share of equal fields, corrected for those that are equal by chance."""
    fields = 0x5555555555555555
    apart = lambda x: F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(fields)))
    differ = reduce(lambda x, y: x + y, [apart(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(LONGS)])
    chance = 1.0 / (1 << BITS)
    return (1 - differ / F.lit(float(HASHES)) - chance) / (1 - chance)


def margin(threshold: float) -> float:
    """Six standard deviations of the estimate at the threshold: of links there, about one in a thousand million falls outside."""
    chance = 1.0 / (1 << BITS)
    p = chance + (1 - chance) * threshold
    return 6 * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def _compare(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with linked (full sets as similar as num / den) and apart (their Jaccard distance)."""
    left, right = sets.withColumnsRenamed({"id": "a", "s": "sa"}), sets.withColumnsRenamed({"id": "b", "s": "sb"})
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    j = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("all"))
    either = F.col("all") - F.col("both")
    return j.select("a", "b", (den * F.col("both") >= num * either).alias("linked"), (1 - F.col("both") / either).alias("apart"))


def near_duplicates(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash for each row: documents whose k-word shingle sets overlap by num / den are linked.

    1. One pass signs every whole text. Documents of one and the same set form a class; its smallest id speaks for it, so
       copies, however many, cost a partial aggregate. 2. The classes' band hashes make buckets; each member is paired with
       its bucket's best met member (an aggregate, not a list), pairs are estimated by bit counts, and those within six
       deviations of the threshold are confirmed on full sets. 3. Buckets whose members are not yet all connected are joined
       with themselves, for members of different components only, under the same estimate, and confirmed: no link between
       parts that are not connected already is lost. Full sets are made for documents in some pair alone.
    Null and empty texts have no shingles and link with nothing; rows of one doc_id are documents of
    their own, each with its own text's links (text_hash tells them apart); rows without an id link with nothing and stay; an empty table gives no rows; other columns are ignored."""
    ship(documents.sparkSession)
    threshold = num / den
    signed = durable(signatures(documents, k))
    content = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = durable(content.groupBy("n", "d0", "d1").agg(F.min("doc_id").alias("rep")))
    # A class goes by its smallest doc_id; the others of several classes that share one (an id with different texts) by negative hashes.
    own = F.struct("n", "d0", "d1") == F.min(F.struct("n", "d0", "d1")).over(W.partitionBy("rep"))
    named = F.when(own, F.col("rep")).otherwise(F.xxhash64("rep", "n", "d0", "d1").bitwiseOR(F.lit(-(1 << 63))))
    classes = durable(classes.withColumn("id", named))
    reps = durable(content.join(classes, ["n", "d0", "d1"]).where("doc_id = rep").dropDuplicates(["id"]).select("id", "rep", "d0", "n", "bands", "sig"))
    members = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mates = durable(members.join(buckets, "bucket").select("bucket", "id", "m"))
    # The member that meets most others is the least changed of its group: most of the rest link with it at once.
    meets = mates.groupBy("id").agg(F.sum("m").alias("meets"))
    heads = durable(mates.join(meets, "id").groupBy("bucket").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("head")))
    stars = mates.join(heads, "bucket").where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()

    sig = reps.select("id", "sig", "n")
    left, right = sig.withColumnsRenamed({"id": "a", "sig": "x", "n": "na"}), sig.withColumnsRenamed({"id": "b", "sig": "y", "n": "nb"})
    sizes = den * F.least("na", "nb") >= num * F.greatest("na", "nb")  # sets of too different sizes cannot overlap enough
    close = estimate(F.col("x"), F.col("y")) >= threshold - margin(threshold)
    pairs = durable(stars.join(left, "a").join(right, "b").where(sizes & close).select("a", "b"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        ids = durable(ids.join(reps.select("id", "rep", "d0"), "id"))
        found = full_sets(documents, k, ids.select("rep")).withColumnRenamed("id", "rep")
        return durable(found.join(ids, ["rep", "d0"]).dropDuplicates(["id"]).select("id", "s"))

    scored = durable(_compare(pairs, sets_of(pairs), num, den))
    links = scored.where("linked").select("a", "b")
    parts = durable(components(links))
    # Whoever is in no link yet is a part of its own.
    placed = durable(mates.select("bucket", "id").join(parts, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("part")))
    open_ = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket")
    rest = placed.join(open_, "bucket", "left_semi").join(heads, "bucket").withColumn("a", F.least("id", "head")).withColumn("b", F.greatest("id", "head"))
    far = F.when(F.col("id") == F.col("head"), F.lit(0.0)).otherwise(F.col("apart"))
    rest = rest.join(scored.select("a", "b", "apart"), ["a", "b"], "left").select("bucket", "id", "part", far.alias("far"))
    rest = durable(rest.join(reps.select("id", "sig", "n", "bands"), "id"))
    r1, r2 = (rest.select(F.col("bucket").alias(f"bucket_{s}"), F.col("id").alias(s), F.col("part").alias(f"p{s}"), F.col("far").alias(f"f{s}"), F.col("sig").alias(x), F.col("n").alias(f"n{s}"), F.col("bands").alias(f"v{s}")) for s, x in (("a", "x"), ("b", "y")))
    # All that rules a pair out is a condition of the join itself, so that pairs that are no candidates never become rows: they are
    # of one part, too far from each other by their distances to the bucket's head (Jaccard distance is a metric), estimated as
    # too far apart, or met in an earlier bucket.
    reach = F.coalesce(F.abs(F.col("fa") - F.col("fb")) <= 1 - num / den + 1e-9, F.lit(True))
    here = F.get(F.array_intersect("va", "vb"), F.lit(0)) == F.col("bucket_a")
    met = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("pa") != F.col("pb")) & (F.col("a") < F.col("b"))
    late = r1.join(r2, met & sizes & reach & close & here).select("a", "b").distinct()
    late = durable(late.join(pairs, ["a", "b"], "left_anti"))
    if not late.isEmpty():
        more = _compare(late, sets_of(late), num, den).where("linked").select("a", "b")
        parts = components(links.union(more))
    # A part is named by the smallest doc_id in it.
    parts = durable(parts.join(reps.select("id", "rep"), "id"))
    parts = parts.join(parts.groupBy("component").agg(F.min("rep").alias("of")), "component").select("id", "of")
    of_class = classes.join(parts, "id", "left").select("n", "d0", "d1", F.coalesce("of", "rep").alias("of"))
    out = signed.select("doc_id", "n", "d0", "d1", "text_hash").join(of_class, ["n", "d0", "d1"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash")
