"""Comparison with other tools' results, sampling, and fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Distinct values of a column that the driver sorts at most, and the accuracy of the estimates that narrow a column down to them.
MEDIAN_VALUES, MEDIAN_ACCURACY = 100_000, 10_000


def medians(frame: DataFrame, columns: list[Column]) -> list[float | None]:
    """Exact medians (nulls left out; the mean of the middle two), whatever the number of distinct values.

    F.median keeps every distinct value of all rows in one task. Here estimated quantiles just beside the middle bound it, rows
    below and between the bounds are counted, and the bounds close in until few distinct values are left between them; those alone
    are counted one by one. Ranks are always counted, so the estimates decide only how many passes there are."""
    d = frame.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    inside = lambda i, lo, hi: F.col(f"v{i}").isNotNull() if lo is None else (F.col(f"v{i}") >= F.lit(lo)) & (F.col(f"v{i}") <= F.lit(hi))
    total = d.agg(*[F.count(c) for c in d.columns]).first()
    bound = {i: (None, None, 0, n) for i, n in enumerate(total) if n}  # least and greatest value, rows below, rows inside
    open_ = {i for i, (*_, n) in bound.items() if n > MEDIAN_VALUES}
    while open_:
        todo = sorted(open_)
        asked = []
        for i in todo:
            lo, hi, below, n = bound[i]
            at = [(r - below) / n for r in ((total[i] - 1) // 2, total[i] // 2)]
            asked.append(F.percentile_approx(F.when(inside(i, lo, hi), F.col(f"v{i}")), [max(0.0, at[0] - 2 / MEDIAN_ACCURACY), min(1.0, at[1] + 2 / MEDIAN_ACCURACY)], MEDIAN_ACCURACY))
        near = dict(zip(todo, d.agg(*[q.alias(f"q{i}") for i, q in zip(todo, asked, strict=True)]).first(), strict=True))
        counts = d.agg(*[c.alias(f"{k}{i}") for i in todo for k, c in (("b", F.count_if(F.col(f"v{i}") < F.lit(near[i][0]))), ("n", F.count_if(inside(i, *near[i]))))]).first()
        for i in todo:
            (lo, hi), below, n = near[i], counts[f"b{i}"], counts[f"n{i}"]
            held = below <= (total[i] - 1) // 2 and total[i] // 2 < below + n
            closer = held and n < bound[i][3]
            if held:
                bound[i] = lo, hi, below, n
            if not closer or n <= MEDIAN_VALUES or lo == hi:
                open_.discard(i)
    out: list[float | None] = [None] * len(columns)
    for i, (lo, hi, below, n) in bound.items():
        if lo is not None and lo == hi:
            out[i] = lo
            continue
        values = d.where(inside(i, lo, hi)).groupBy(f"v{i}").agg(F.count(F.lit(1)).alias("n"))
        found = values.orderBy(f"v{i}").limit(MEDIAN_VALUES + 1).collect()
        if len(found) > MEDIAN_VALUES:  # the estimates did not close in
            out[i] = d.agg(F.median(f"v{i}")).first()[0]
            continue
        ends = below + np.cumsum([r.n for r in found])
        low, high = (found[int(np.searchsorted(ends, r, side="right"))][0] for r in ((total[i] - 1) // 2, total[i] // 2))
        out[i] = low if low == high else low * 0.5 + high * 0.5
    return out


def agreement(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Medians of relative and absolute differences, correlation, share within one. The medians are found when this is called."""
    a, b = F.col(ours), F.col(theirs)
    relative, absolute = (F.lit(x).cast("double") for x in medians(pairs, [F.abs(a - b) / b, F.abs(a - b)]))
    d = pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(a, b), 8).alias("pearson"), F.round(F.avg((F.abs(a - b) <= 1).cast("int")), 8).alias("within_one"))
    return d.select("n", F.round(relative, 8).alias("median_relative"), F.round(absolute, 6).alias("median_absolute"), "pearson", "within_one")


def spearman(pairs: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Rank correlation, ties in the order of the key."""
    r = pairs.withColumn("rx", F.row_number().over(W.orderBy(x, key))).withColumn("ry", F.row_number().over(W.orderBy(y, key)))
    return r.agg(F.corr("rx", "ry").alias("spearman"))


def energy_metrics(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    d = F.col(ours) - F.col(theirs)
    return pairs.agg(F.round(F.corr(ours, theirs), 8).alias("r"), F.round(F.regr_slope(ours, theirs), 8).alias("slope"), F.round(F.regr_intercept(ours, theirs), 8).alias("intercept"), F.round(F.sqrt(F.avg(d * d)), 8).alias("rmse"), F.round(F.avg(d), 8).alias("bias"))


def compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Interfaces of both side by side, matched on the unordered pair of chains; either side may lack one."""
    key = lambda d: d.withColumn("pair", F.array_sort(F.array("chain_1", "chain_2")))
    a, b = key(ours), key(theirs)
    cols = ["interface_area", "solvation_energy"]
    a = a.select("structure_id", "pair", *[F.col(c).alias(f"our_{c}") for c in cols])
    b = b.select("structure_id", "pair", *[F.col(c).alias(f"their_{c}") for c in cols])
    d = a.join(b, ["structure_id", "pair"], "full_outer")
    return d.withColumn("status", F.when(F.col("their_interface_area").isNull(), "ours only").when(F.col("our_interface_area").isNull(), "theirs only").otherwise("both"))


def seeded_draw(frame: DataFrame, key: str, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """n rows in the order of a seeded digest of the key, whatever the rows' order; none that is excluded."""
    d = frame if exclude is None else frame.join(exclude.select(key).distinct(), key, "left_anti")
    return d.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def last_records(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The newest record of each key in an append-only log, and how many there are."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("records"))


def read_log(spark, path: str, schema: str) -> DataFrame:
    """A line-wise JSON log; torn lines are dropped."""
    d = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return d.where("_corrupt_record IS NULL").drop("_corrupt_record")


def folds(entries: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Entries dealt into k folds of equal size by a seeded digest."""
    e = entries.select(key).distinct()
    rank = F.row_number().over(W.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))))
    return e.withColumn("fold", (rank - 1) % k)


def design(records: DataFrame, map_column: str, keys: list[str]) -> DataFrame:
    """A column for each key of a map of areas."""
    return records.select("*", *[F.coalesce(F.try_element_at(map_column, F.lit(k)), F.lit(0.0)).alias(f"x{i}") for i, k in enumerate(keys)])


def fit_linear(records: DataFrame, columns: list[str], target: str, ridge: float = 0.0, prior: list[float] | None = None) -> np.ndarray:
    """Least squares, shrunk toward a prior: the sums of products are one distributed aggregate of a fixed number of columns; only
    they come to the driver, where the small system is solved."""
    n = len(columns)
    xs = [F.col(c) for c in columns]
    row = records.agg(*[F.sum(xs[i] * xs[j]) for i in range(n) for j in range(i, n)], *[F.sum(x * F.col(target)) for x in xs]).first()
    a = np.zeros((n, n))
    a[np.triu_indices(n)] = row[: n * (n + 1) // 2]
    a = a + np.triu(a, 1).T
    p = np.zeros(n) if prior is None else np.array(prior)
    return np.linalg.solve(a + ridge * np.eye(n), np.array(row[n * (n + 1) // 2 :], dtype=float) + ridge * p)
