"""Operator 8: mixing sources to target weights by capped water-filling. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

#: Most times that a source is gone through; seed of the sample; hash buckets of each source.
MAX_EPOCHS, SEED, BUCKET_DIGITS = 3, "mix-0", 3


def n_words(text="text"):
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` with their rank (from 1) in the order of source, null last; each range of sources is ordered in a task of its own."""
    s = durable(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    # One row per range, of which there are no more than shuffle partitions.
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = s.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return s.join(starts, "range").withColumn("rank", F.col("before") + within).drop("range", "before")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) with target added: the total shared by weight, none above max_epochs times its size.

    In each round the sources above their cap under the current share are clamped, and what is left is shared by weight among the
    others, until a round clamps no more: every open source then has the same share per weight. A round is one aggregate, of which
    three sums come to the driver, so there may be as many sources as there are hosts. One row per source."""
    whole = dict(sources.dtypes)["weight"] in ("tinyint", "smallint", "int", "bigint")
    wide = (lambda c: c.cast("decimal(38,0)")) if whole else (lambda c: c.cast("double"))
    total, weights = (x or 0 for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    left, open_, n = total, weights, 0
    while True:
        over = wide(F.lit(left)) * wide(F.col("weight")) > wide(F.col("source_size")) * F.lit(max_epochs) * wide(F.lit(open_))
        size, weight, now = sources.where(over).agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
        if now <= n:
            break
        left, open_, n = total - size * max_epochs, weights - weight, now
    shared = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(open_ or 1))
    return sources.select("source", "source_size", "weight", F.when(over, (F.col("source_size") * max_epochs).cast("double")).otherwise(shared).alias("target"))


def _digest(seed: str, doc_id: str):
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def mix(documents: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (epochs), part (words of one more, cut copy), taken and key (the id's digest) for each document.

    Weights 1, 2, 3, 1, ... go to the sources in order of their code points, null last, unless `weights` (source, weight) gives them.
    A source's target over its size is its number of epochs: whole ones take every document; the fraction is taken in the order of a
    seeded digest of the id until its words are reached, the last document being cut. The order is found in two steps: sums by the
    digest's first digits place whole buckets, and only a bucket's own rows are ordered, so a source with most of the rows never meets
    in one task. A document's size bounds every copy, so nothing exceeds max_epochs times it. Sizes of null texts are 0;
    rows repeated under one id share a place in the order and split it by size. An empty table gives no rows."""
    d = documents.select("doc_id", "source", n_words().alias("size")).withColumn("key", _digest(seed, "doc_id")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    d = durable(d)
    by_bucket = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    by_bucket = durable(by_bucket)
    sources = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    if weights is None:
        sources = numbered(sources).select("source", "source_size", ((F.col("rank") - 1) % 3 + 1).cast("long").alias("weight"))
    else:
        w = weights.select(F.col("source").alias("of"), "weight")
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    targets = water_fill(durable(sources), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    t = targets.withColumnRenamed("source", "of")
    along = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(along), F.lit(0))).withColumnsRenamed({"source": "of", "bucket": "b"})
    starts = starts.join(t, starts["of"].eqNullSafe(t["of"])).select(starts["of"], "b", "before", "source_size", "target", "whole", "extra")
    j = d.join(starts, d["source"].eqNullSafe(F.col("of")) & (d["bucket"] == F.col("b"))).drop("of", "b")
    within = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    j = j.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("at"))).cast("long")
    return j.withColumn("part", part).select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "key")


def materialise(documents: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: a row for each whole copy and for a cut one (its text's first words, blanks between them kept).

    All columns of documents come back; n_chars, if there, is the text's new length."""
    # Rows under one id of one source and size, if there are several, are told apart by their place: the parts go to them in the order of their texts.
    m = mix(documents, **options).withColumn("from", F.coalesce(F.sha2("source", 256), F.lit("")))
    m = m.groupBy("key", "from", "size").agg(F.first("whole").alias("whole"), F.sort_array(F.collect_list("part"), asc=False).alias("parts"))
    cols = documents.columns
    # The row travels in a struct, so that its columns' names cannot meet those made here.
    d = documents.select(F.struct(*cols).alias("row"), n_words().alias("size"), _digest(options.get("seed", SEED), "doc_id").alias("key"), F.coalesce(F.sha2("source", 256), F.lit("")).alias("from"))
    place = F.row_number().over(W.partitionBy("key", "from", "size").orderBy(F.xxhash64("row.text"), F.xxhash64("row")))
    j = d.join(m, ["key", "from", "size"]).withColumn("part", F.get("parts", place - 1))
    copies = F.when(F.col("whole") > 0, F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int"))).otherwise(F.array().cast("array<long>"))
    last = F.when(F.col("part") > 0, F.array(F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(F.lit(-1).cast("long")))).otherwise(F.array().cast("array<long>"))
    j = j.select("row", F.explode(F.concat(copies, last)).alias("take"))
    # The text up to the end of its take-th word: words are split only for cut copies.
    pieces = F.regexp_extract_all("row.text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    j = j.withColumn("cut", F.when(F.col("take") < 0, F.col("row.text")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("take").cast("int")), "")))
    new = {"text": F.col("cut")}
    if "n_chars" in cols:
        new["n_chars"] = F.length("cut").cast(documents.schema["n_chars"].dataType)
    return j.select(*[new.get(c, F.col("row")[c]).alias(c) for c in cols])
