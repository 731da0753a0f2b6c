"""Operator 5: line deduplication by winnowing over line hashes. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, split_join

#: A run that repeats is at least so many lines, or fewer lines of at least so many words together.
WINDOW, LONG_LINE = 3, 50
#: The windows that a selected line can stand for: lines before it, lines in all.
_SHAPES = [(before, k) for k in range(1, WINDOW + 1) for before in range(k)]
_REACH = WINDOW - 1
_BLANKS = " \t\x0b\x0c\r"


def _inked(x: Column) -> Column:
    return F.translate(x, _BLANKS, "") != ""


def _hashes(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and h: for each line that has a word, in order, two hashes that have nothing in common, words, and its place among all lines."""
    words = lambda x: F.size(F.split(F.trim(F.translate(x, _BLANKS, "     ")), " +"))
    line = lambda x, i: F.when(_inked(x), F.struct(F.xxhash64(x).alias("x"), F.xxhash64(F.lit(7), x).alias("y"), words(x).alias("n"), i.alias("p")))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), lambda x: x.isNotNull())
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("h"))


def _selected(hashes: DataFrame) -> DataFrame:
    """The winnowed fingerprints: doc_id, text_hash, at (place among lines with words), fp, stands and near.

    Of each window, WINDOW lines in a row or fewer with LONG_LINE words together, the least hash is selected, the last of
    equal ones; a line that is selected by no window gives no row. So equal windows always select equal lines at the same place in them.
    `stands` has a bit for each of _SHAPES that the line stands for, `near` the hashes and places of the lines up to _REACH to both sides."""
    of = lambda i, d, name: F.get(F.col("h"), i + d)[name] if d else F.get(F.col("h"), i)[name]

    def stands(i: Column) -> Column:
        bits = F.lit(0)
        for bit, (before, k) in enumerate(_SHAPES):
            least = [of(i, 0, "x") < of(i, d, "x") if d > 0 else of(i, 0, "x") <= of(i, d, "x") for d in range(-before, k - before) if d]
            if k < WINDOW:
                words = of(i, -before, "n")
                for d in range(1 - before, k - before):
                    words = words + of(i, d, "n")
                least.insert(0, words >= LONG_LINE)
            held = least[0]
            for c in least[1:]:
                held = held & c
            bits = bits + F.when(held, 1 << bit).otherwise(0)
        return bits

    near = lambda i: F.array(*[of(i, d, name).cast("long") for d in range(-_REACH, _REACH + 1) for name in ("x", "y", "p")])
    found = F.filter(F.transform("h", lambda y, i: F.struct(i.alias("at"), stands(i).alias("stands"))), lambda s: s["stands"] > 0)
    rows = hashes.withColumn("found", found)
    rows = rows.select("doc_id", "text_hash", F.explode(F.transform("found", lambda s: F.struct(s["at"].alias("at"), s["stands"].alias("stands"), near(s["at"]).alias("near")))).alias("s"))
    return rows.select("doc_id", "text_hash", "s.*", F.get("s.near", F.lit(3 * _REACH)).alias("fp"))


def _extended(found: DataFrame) -> DataFrame:
    """Each window that a fingerprint stands for: doc_id, text_hash, its lines' hashes l0, l1, ... (null beyond its end), and
    its lines' places `at` (the first among lines with words) and p0, p1, ..."""
    windows = []
    for bit, (before, k) in enumerate(_SHAPES):
        get = lambda j, c: F.get("near", F.lit(3 * (_REACH - before + j) + c)) if j < k else F.lit(None).cast("long")  # noqa: B023, E731
        hashes = [get(j, c).alias(f"l{2 * j + c}") for j in range(WINDOW) for c in (0, 1)]
        places = [get(j, 2).alias(f"p{j}") for j in range(WINDOW)]
        windows.append(F.when(F.col("stands").bitwiseAND(F.lit(1 << bit)) != 0, F.struct((F.col("at") - before).alias("at"), *hashes, *places)))
    return found.select("doc_id", "text_hash", F.explode(F.filter(F.array(*windows), lambda w: w.isNotNull())).alias("w")).select("doc_id", "text_hash", "w.*")


def repeated_runs(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and cut: the lines in later repeated runs, by place among the lines with words (k) and among all (p)."""
    selected = durable(_selected(_hashes(documents)))
    # Fingerprints are counted before anything else moves: partial counts, so a line that everybody has costs one row a task.
    again = durable(selected.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # Where fingerprints meet, the match is extended to both sides, and all its lines are compared by 128 bits each. What is longer
    # than a window has more fingerprints, whose windows overlap.
    windows = durable(_extended(split_join(selected, again, ["fp"], "n")))
    lines = [f"l{c}" for c in range(2 * WINDOW)]
    windows = windows.withColumns({c: F.coalesce(c, F.lit(0)) for c in lines[2:]}).withColumn("k", F.expr("+".join(f"int(p{j} IS NOT NULL)" for j in range(WINDOW))))
    first = durable(windows.groupBy("k", *lines).agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    later = split_join(windows, first, ["k", *lines], "n").where(F.struct("doc_id", "text_hash", "at") > F.col("first"))
    spans = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.array(*[F.struct((F.col("at") + j).alias("k"), F.col(f"p{j}").cast("int").alias("p")) for j in range(WINDOW)])).alias("spans"))
    return spans.select("doc_id", "text_hash", F.array_distinct(F.filter(F.flatten("spans"), lambda s: s["p"].isNotNull())).alias("cut"))


def dedup(documents: DataFrame) -> DataFrame:
    """`documents` with text less its later repeated runs, and n_lines, n_removed, n_runs (of lines that have a word).

    A run repeats if all its windows of WINDOW lines, or of fewer lines with LONG_LINE words together, also occur at an
    earlier (doc_id, place); the whole input is judged, not what is left. Lines without a word are never removed and break no run. Repeated rows (same id and
    text) are one document and share its cuts; null texts stay null, with no lines; n_chars, if there, is made new."""
    cols = documents.columns
    names = [c for c in cols if c not in ("n_lines", "n_removed", "n_runs")]
    own = ["_".join(["", *cols, n]) for n in ("doc_id", "hash", "of", "cut")]  # names that none of the columns can have
    cuts = repeated_runs(documents).toDF(own[0], own[1], own[3]).withColumn(own[3], F.sort_array(own[3]))
    d = documents.select(*names, F.xxhash64("text").alias(own[2]))
    d = d.join(cuts, F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.col(own[2]) == F.col(own[1])), "left").drop(*own[:3])
    cut, lines = F.col(own[3]), F.split("text", "\n")
    # How far each cut line is from the one before it. From that, in one pass, a mark for each line: null (beyond the last cut) and true stay.
    steps = lambda name, least: F.zip_with(cut[name], F.concat(F.array(F.lit(least)), F.slice(cut[name], 1, F.size(cut) - 1)), lambda a, b: a - b)
    marks = F.flatten(F.transform(steps("p", -1), lambda g: F.concat(F.array_repeat(F.lit(True), g - 1), F.array(F.lit(False)))))
    kept = F.transform(F.filter(F.zip_with(lines, marks, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda z: F.coalesce(z["m"], F.lit(True))), lambda z: z["x"])
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, _inked)))
    runs = F.size(F.filter(steps("k", -2), lambda g: g != 1))
    made = {
        "n_lines": n_lines.cast("long"),
        "n_removed": F.when(cut.isNull(), F.lit(0)).otherwise(F.size(cut)).cast("long"),
        "n_runs": F.when(cut.isNull(), F.lit(0)).otherwise(runs).cast("long"),
        "text": F.when(cut.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
    }
    d = d.withColumns(made).drop(own[3])
    if "n_chars" in names:
        d = d.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return d
