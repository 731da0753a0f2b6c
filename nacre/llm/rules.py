"""Operator 4: quality rules with verdicts on whole hosts. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Base rules: fewest words, and most percent of words in repeated eight-word windows.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: Rules that only count against a host: most percent of symbols and of repeated lines.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: A host goes if its shrunken rate of failed documents is above this.
MAX_HOST_RATE = 0.5
#: Prior strength bounds, in documents, between which the moments' estimate is held.
LEAST_PRIOR, MOST_PRIOR = 2.0, 10_000.0


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, host and the whole text's counts; one row for each row, null texts counted as empty.

    Repeated windows are found inside the row: hashes of all windows, and only where some hash is repeated are they sorted
    with their places, so no window leaves its row and nothing is shuffled."""
    text = F.coalesce("text", F.lit(""))
    d = documents.select("doc_id", F.col("source").alias("host"), text.alias("t"))
    d = d.select(
        "doc_id",
        "host",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
    )
    d = d.select(
        "doc_id", "host", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("h"),
    )
    slide = F.transform(F.sequence(F.lit(1), F.size("h") - WINDOW + 1), lambda i: F.xxhash64(*[F.get(F.col("h"), i + (j - 1)) for j in range(WINDOW)]))
    d = d.withColumn("w", F.when(F.col("h").isNotNull(), slide)).drop("h")
    d = d.withColumn("w", F.when(F.size(F.array_distinct("w")) < F.size("w"), F.col("w")))
    # (hash, place) sorted; a place counts if a neighbour has its hash; the places sorted again give the words covered.
    pairs = F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("p", F.when(F.col("w").isNotNull(), pairs)).drop("w")
    twice = F.filter(F.transform("p", lambda x, k: F.when((F.get(F.col("p"), k - 1)["x"] == x["x"]) | (F.get(F.col("p"), k + 1)["x"] == x["x"]), x["i"])), lambda i: i.isNotNull())
    d = d.withColumn("p", F.when(F.col("p").isNotNull(), F.sort_array(twice)))
    covered = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")))["n"]
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("p").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, rate (shrunken), host_kept. Null is a host of its own.

    Rates are shrunk toward a beta prior whose mean and strength are fitted to the hosts' raw rates by moments, so that
    a host of few documents needs stronger evidence. Counts are aggregated before the shuffle, whatever a host's share."""
    hosts = durable(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    m = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("sq")).first()
    n, f, k = m["n"] or 0, m["f"] or 0, m["k"] or 0
    mean = (f + 0.5) / (n + 1)
    between = ((m["sq"] or 0) - f * f / n) / max(k - 1, 1) if n else 0.0  # variance between hosts, on the scale of one document
    per_host = n / k if k else 1.0
    spread = max((between - mean * (1 - mean)) / per_host, 1e-9)
    strength = min(max(mean * (1 - mean) / spread - 1, LEAST_PRIOR), MOST_PRIOR)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= max_rate)


def apply_rules(documents: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, host, the counts, base_failed, failed (any rule), rate and kept, for each row of documents (doc_id, text, source).

    Empty and null texts fail the base rule; repeated rows are judged each; extra columns are ignored."""
    m = measure(documents)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    failed = base | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    m = durable(m.withColumn("base_failed", base).withColumn("failed", failed))
    hosts = host_verdicts(m, max_rate).select(F.col("host").alias("of"), "rate", "host_kept")
    # No hint: Spark broadcasts the hosts only if their size is under its threshold, else AQE splits a hot host's rows.
    return m.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left").drop("of").withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("host_kept")
