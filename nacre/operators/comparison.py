"""Complexes against complexes, and results against references: alignment, matching, audits and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship

#: Scores of an alignment: equal letters, unequal ones, a letter against none.
MATCH, MISMATCH, GAP = 2, -1, -2
#: Least percent of equal letters for chains to correspond; least share of equal names for residue numbers to be trusted.
LEAST_IDENTITY, TRUSTED_NUMBERS = 30.0, 0.6
#: Slack of a relative transform's rotation (largest element) and shift (largest component).
ROTATION_SLACK, SHIFT_SLACK = 0.02, 0.8
#: Atom kinds that an audit lists.
MOST_KINDS = 12


# --- contacts and residues -----------------------------------------------------------------------------------------------


def orient(contacts: DataFrame, group1: list[str]) -> DataFrame:
    """`contacts` (columns a_* and b_*) with side a in group 1: the others' sides change places."""
    swap = ~F.col("a_auth_asym_id").isin(group1)
    sides = [c[2:] for c in contacts.columns if c.startswith("a_") and f"b_{c[2:]}" in contacts.columns]
    turned = {f"{s}_{c}": F.when(swap, F.col(f"{o}_{c}")).otherwise(F.col(f"{s}_{c}")) for c in sides for s, o in (("a", "b"), ("b", "a"))}
    return contacts.select(*[turned.get(c, F.col(c)).alias(c) for c in contacts.columns])


def top_contributors(residues: DataFrame, k: int = 4, by: tuple[str, ...] = ("structure_id", "side")) -> DataFrame:
    """The k residues of each side that bury most."""
    order = W.partitionBy(*by).orderBy(F.desc("bsa"), "auth_asym_id", "res_seq", "icode")
    return residues.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def residue_order(chain, label) -> Column:
    """What residue labels (12, 12A, -3) are sorted by: chain, number (unreadable ones last), what follows it."""
    t = F.trim(F.col(label) if isinstance(label, str) else label)
    number = F.regexp_extract(t, r"^(-?\d+)", 1).try_cast("int")
    return F.struct(chain if isinstance(chain, Column) else F.col(chain), number.isNull().alias("unread"), number.alias("number"), F.regexp_extract(t, r"^-?\d+(.*)$", 1).alias("rest"))


def bond_groups(bonds: DataFrame, key: str, other: str, order: str) -> DataFrame:
    """For each residue and type of bond its partners, each once, in the order they come in, and the number of bonds."""
    g = bonds.groupBy(key, "type").agg(F.sort_array(F.collect_list(F.struct(order, other))).alias("of"), F.count(F.lit(1)).alias("n"))
    return g.select(key, "type", F.array_join(F.array_distinct(F.transform("of", lambda x: x[other])), ", ").alias("partners"), "n")


def operator_of(placements: DataFrame, operators: DataFrame) -> DataFrame:
    """`placements` (structure_id, asu, rotation, translation in 24ths) with operator: the number of the listed operator (same columns, and
    operator) that has their rotation and, but for whole cells, their translation; null where none has, never a default."""
    inside = lambda c: F.transform(c, lambda v: F.pmod(v, F.lit(24)))
    known = operators.select("structure_id", "asu", "rotation", inside("translation").alias("_t"), "operator").groupBy("structure_id", "asu", "rotation", "_t").agg(F.min("operator").alias("operator"))
    return placements.withColumn("_t", inside("translation")).join(known, ["structure_id", "asu", "rotation", "_t"], "left").drop("_t")


def provenance(results: DataFrame, **options) -> DataFrame:
    """`results` with the options they were made under, as one struct that is the same in every row."""
    from .. import __version__

    scope = "first model only; crystal symmetry mates generated" if options.get("symmetry") == "crystal" else "first model only; no symmetry generation"
    fixed = {"version": __version__, "coordinate_scope": scope, "surface_algorithm": "points on spheres"} | options
    return results.withColumn("provenance", F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()]))


# --- sequences -------------------------------------------------------------------------------------------------------------


def align(a: str, b: str) -> list[tuple[int, int]]:
    """Pairs of places of a global alignment. Of equally good ones, that which from the end prefers pairs, then gaps in b.

    A row of scores is filled at once: gaps along a row are a running maximum of scores that have been freed of their place."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    along = np.arange(len(y) + 1) * GAP
    table = np.empty((len(x) + 1, len(y) + 1), dtype=np.int64)
    table[0] = along
    for i, letter in enumerate(x, start=1):
        row = table[i - 1] + GAP
        np.maximum(row[1:], table[i - 1, :-1] + np.where(y == letter, MATCH, MISMATCH), out=row[1:])
        table[i] = np.maximum.accumulate(row - along) + along
    i, j, pairs = len(x), len(y), []
    while i and j:
        here = table[i, j]
        if here == table[i - 1, j - 1] + (MATCH if x[i - 1] == y[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif here == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def aligned(pairs: DataFrame, first: str = "sequence_1", second: str = "sequence_2") -> DataFrame:
    """`pairs` of sequences with aligned (array of i, j) and identity (percent of equal letters among the aligned)."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
        for batch in batches:
            of, same = [], []
            for a, b in zip(batch.column(first).to_pylist(), batch.column(second).to_pylist(), strict=True):
                got = align(a or "", b or "")
                of.append([{"i": i, "j": j} for i, j in got])
                same.append(100.0 * sum(a[i] == b[j] for i, j in got) / max(len(got), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, kind), pa.array(same, pa.float64())], [*batch.schema.names, "aligned", "identity"])

    schema = pairs.limit(0).selectExpr("*", "CAST(NULL AS ARRAY<STRUCT<i: INT, j: INT>>) AS aligned", "0D AS identity").schema
    return pairs.mapInArrow(run, schema)


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one choice of (row, column) with the largest sum, by shortest augmenting paths."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    row_price, column_price, holder = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        holder[m], at = row, m
        far, back, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        while holder[at] >= 0:
            done[at] = True
            open_ = np.flatnonzero(~done[:m])
            reach = cost[holder[at], open_] - row_price[holder[at]] - column_price[open_]
            better = reach < far[open_]
            far[open_[better]], back[open_[better]] = reach[better], at
            step = far[open_].min()
            row_price[holder[done]] += step
            column_price[done] -= step
            far[open_] -= step
            at = int(open_[far[open_].argmin()])
        while at != m:
            holder[at] = holder[back[at]]
            at = int(back[at])
    chosen = [(int(r), c) for c, r in enumerate(holder[:m]) if r >= 0]
    return sorted((c, r) for r, c in chosen) if turned else sorted(chosen)


def shared_chains(reference: DataFrame, others: DataFrame, least: float = LEAST_IDENTITY) -> DataFrame:
    """Which chain of each structure in `others` is which of the reference: structure_id, chain, reference_chain, identity.

    Both are (structure_id, chain, sequence), the reference of one structure, so a bounded few rows. Sequences are aligned pair by pair in
    parallel; each structure's chains are then assigned one to one for the largest sum of identities; those under `least` are dropped."""
    pairs = others.select("structure_id", "chain", F.col("sequence").alias("sequence_1")).crossJoin(F.broadcast(reference.select(F.col("chain").alias("reference_chain"), F.col("sequence").alias("sequence_2"))))
    scored = aligned(pairs).select("structure_id", "chain", "reference_chain", "identity")

    def assign(key, part):
        rows = sorted((r["chain"], r["reference_chain"], r["identity"]) for r in part.to_pylist())
        chains, refs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        gain = np.zeros((len(chains), len(refs)))
        for c, r, v in rows:
            gain[chains.index(c), refs.index(r)] = v
        got = [(i, j) for i, j in assignment(gain) if gain[i, j] >= least]
        return pa.table({"structure_id": pa.array([key[0].as_py()] * len(got), pa.string()), "chain": pa.array([chains[i] for i, _ in got], pa.string()), "reference_chain": pa.array([refs[j] for _, j in got], pa.string()), "identity": pa.array([float(gain[i, j]) for i, j in got], pa.float64())})

    return scored.groupBy("structure_id").applyInArrow(assign, "structure_id string, chain string, reference_chain string, identity double")


def shared_sides(inventory: DataFrame, matches: DataFrame) -> DataFrame:
    """structure_id, group1 (chains that correspond to the reference's side) and group2 (its other chains, ligands apart)."""
    d = inventory.join(matches.select("structure_id", "chain", F.lit(True).alias("met")), ["structure_id", "chain"], "left")
    side = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("chain"))))
    return d.groupBy("structure_id").agg(side(F.col("met")).alias("group1"), side(F.col("met").isNull() & (F.col("class") != "Ligand")).alias("group2"))


def residue_keys(residues: DataFrame, reference: DataFrame, alignments: DataFrame | None = None) -> DataFrame:
    """`residues` (complex, chain, seq, icode, one) with key: the name under which the reference's complex has each residue.

    Numbers are taken where at least TRUSTED_NUMBERS of a complex's residues have the reference's name at their number; else, with
    `alignments` (complex, chain, seq, icode, key), what their sequence aligned them with; what neither names keeps its own."""
    own = F.concat("chain", F.lit(":"), "one", F.col("seq").cast("string"), "icode")
    names = reference.select("chain", "seq", "icode", F.col("one").alias("named")).distinct()
    hits = residues.join(names, ["chain", "seq", "icode"], "left").groupBy("complex").agg(F.avg(F.coalesce((F.col("named") == F.col("one")).cast("double"), F.lit(0.0))).alias("agree"))
    d = residues.join(hits, "complex").withColumn("own", own)
    if alignments is None:
        return d.withColumn("key", F.col("own")).drop("own", "agree")
    d = d.join(alignments.select("complex", "chain", "seq", "icode", "key"), ["complex", "chain", "seq", "icode"], "left")
    return d.withColumn("key", F.when(F.col("agree") < TRUSTED_NUMBERS, F.coalesce("key", "own")).otherwise(F.col("own"))).drop("own", "agree")


def superposition(pairs: DataFrame) -> DataFrame:
    """For each complex the rotation (nine, by rows), shift and rmsd that lay (x, y, z) best on (u, v, w), both in one row per atom.

    Sixteen sums per complex are an aggregate; only the 3 x 3 decomposition is a kernel."""
    ship(pairs.sparkSession)
    xs, us = "xyz", "uvw"
    sums = [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in xs + us], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a in xs for b in us], *[F.var_pop(c).alias(f"s{c}") for c in xs + us]]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                h = np.array([[r[f"c{a}{c}"] for c in us] for a in xs])
                p, s, q = np.linalg.svd(h)
                d = np.sign(np.linalg.det(q.T @ p.T)) or 1.0
                turn = q.T @ np.diag([1.0, 1.0, d]) @ p.T
                left = sum(r[f"s{c}"] for c in xs + us) - 2 * (s[0] + s[1] + d * s[2])
                shift = np.array([r[f"m{c}"] for c in us]) - turn @ np.array([r[f"m{c}"] for c in xs])
                out.append((r["complex"], turn.reshape(-1).tolist(), shift.tolist(), float(np.sqrt(max(left, 0.0))), r["n"]))
            kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["complex", "rotation", "shift", "rmsd", "n"])

    return pairs.groupBy("complex").agg(*sums).mapInArrow(solve, "complex string, rotation array<double>, shift array<double>, rmsd double, n long")


# --- several complexes -----------------------------------------------------------------------------------------------------


def overlaps(footprints: DataFrame, name: str, values: str, keys: list[str]) -> DataFrame:
    """Every pair of footprints within `keys` that share anything: what both have, what either has, and the ratio.

    Footprints meet on their elements, so pairs that share nothing cost nothing; they have a ratio of 0 and no row."""
    d = footprints.select(*keys, F.col(name).alias("c"), F.explode(F.array_distinct(values)).alias("v"))
    size = d.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("n"))
    both = d.withColumnRenamed("c", "c1").join(d.withColumnRenamed("c", "c2"), [*keys, "v"]).where("c1 < c2").groupBy(*keys, "c1", "c2").agg(F.count(F.lit(1)).alias("both"))
    for k in (1, 2):
        both = both.join(size.withColumnsRenamed({"c": f"c{k}", "n": f"n{k}"}), [*keys, f"c{k}"])
    either = F.col("n1") + F.col("n2") - F.col("both")
    return both.select(*keys, "c1", "c2", "both", either.alias("any"), F.round(F.col("both") / either, 8).alias("jaccard"))


def against_first(digests: DataFrame, reference: str, shared: DataFrame | None = None) -> DataFrame:
    """Digests of complexes (complex, buried_total, buried_side1, n_hbonds, n_salt_bridges) with their differences from the reference's, and a sentence.

    shared: complex, shared (residues), jaccard of the footprints with the reference's."""
    first = digests.where(F.col("complex") == reference).select(*[F.col(c).alias(f"first_{c}") for c in ("buried_total", "buried_side1", "n_hbonds", "n_salt_bridges")])
    d = digests.where(F.col("complex") != reference).crossJoin(F.broadcast(first.limit(1)))
    d = d.withColumns({"total_change": F.col("buried_total") - F.col("first_buried_total"), "side_change": F.col("buried_side1") - F.col("first_buried_side1")})
    d = d.join(shared, "complex", "left") if shared is not None else d.withColumns({"shared": F.lit(0).cast("long"), "jaccard": F.lit(0.0)})
    d = d.fillna(0, ["shared", "jaccard"])
    more = lambda c: F.when(F.col(c) >= 0, "more").otherwise("less")
    text = F.format_string(
        "Relative to %s, %s buries %,.0f A^2 %s surface in total (%,.0f A^2 %s on side 1), with %d vs %d hydrogen bonds and %d vs %d salt bridges; its footprint shares %d residues (Jaccard %.2f).",
        F.lit(reference), "complex", F.abs("total_change"), more("total_change"), F.abs("side_change"), more("side_change"), "n_hbonds", "first_n_hbonds", "n_salt_bridges", "first_n_salt_bridges", "shared", "jaccard",
    )
    return d.select("complex", "total_change", "side_change", "shared", "jaccard", text.alias("sentence"))


# --- crystals and assemblies against a reference ----------------------------------------------------------------------------


def relative_transform(rotation_1, shift_1, rotation_2, shift_2) -> Column:
    """Struct (r, t): where molecule 2 is, as molecule 1 sees it. Rotations are nine doubles by rows and orthogonal."""
    a, b, s, u = (F.col(c) if isinstance(c, str) else c for c in (rotation_1, rotation_2, shift_1, shift_2))
    dot = lambda i, g: F.get(a, F.lit(i)) * g(0) + F.get(a, F.lit(3 + i)) * g(1) + F.get(a, F.lit(6 + i)) * g(2)
    r = [dot(i, lambda k, j=j: F.get(b, F.lit(3 * k + j))) for i in range(3) for j in range(3)]
    t = [dot(i, lambda k: F.get(u, F.lit(k)) - F.get(s, F.lit(k))) for i in range(3)]
    return F.struct(F.array(*r).alias("r"), F.array(*t).alias("t"))


def _seen_back(r: Column, t: Column) -> tuple[Column, Column]:
    """The inverse of a transform: the same contact from its other end."""
    back = F.array(*[F.get(r, F.lit(3 * j + i)) for i in range(3) for j in range(3)])
    return back, F.array(*[-(F.get(r, F.lit(i)) * F.get(t, F.lit(0)) + F.get(r, F.lit(3 + i)) * F.get(t, F.lit(1)) + F.get(r, F.lit(6 + i)) * F.get(t, F.lit(2))) for i in range(3)])


def match_crystal(ours: DataFrame, theirs: DataFrame, rotation_slack: float = ROTATION_SLACK, shift_slack: float = SHIFT_SLACK) -> DataFrame:
    """structure_id, their_id, our_id and cost (the shifts' largest difference) of interfaces matched one to one.

    Both are (structure_id, pair, id, r, t). Ours fits if its transform, or that seen from its other end, lies within the slack.
    References choose in the order of their ids, each the nearest of ours that is still free; one structure's candidates are one small group."""
    ship(ours.sparkSession)
    far = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    c = theirs.select("structure_id", "pair", F.col("id").alias("their_id"), F.col("r").alias("r1"), F.col("t").alias("t1")).join(ours.select("structure_id", "pair", F.col("id").alias("our_id"), F.col("r").alias("r2"), F.col("t").alias("t2")), ["structure_id", "pair"])
    r, t = _seen_back(F.col("r2"), F.col("t2"))
    fit = lambda r, t: F.when((far("r1", r) < rotation_slack) & (far("t1", t) < shift_slack), far("t1", t))
    c = c.select("structure_id", "their_id", "our_id", F.coalesce(fit(F.col("r2"), F.col("t2")), fit(r, t)).alias("cost")).where("cost IS NOT NULL")

    def choose(key, part):
        taken, met, out = set(), set(), []
        for their, cost, our in sorted(zip(*(part.column(x).to_pylist() for x in ("their_id", "cost", "our_id")), strict=True)):
            if their not in met and our not in taken:
                met.add(their)
                taken.add(our)
                out.append((their, our, cost))
        cols = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), *cols], names=["structure_id", "their_id", "our_id", "cost"])

    ids = c.withColumns({x: F.col(x).cast("long") for x in ("their_id", "our_id")})
    return ids.groupBy("structure_id").applyInArrow(choose, "structure_id string, their_id long, our_id long, cost double")


def summarize_crystal(matched: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: entries, references, matched, reported, the match rate, and how areas and energies agree.

    matched: area_ref, area, dg_ref, dg; entries: n_reference, n_reported. The area's error is over references of more than 100, if any are."""
    relative = F.abs(F.col("area") - F.col("area_ref")) / F.greatest(F.col("area_ref"), F.lit(1.0))
    m = matched.agg(
        F.count(F.lit(1)).alias("matched"), F.coalesce(F.median(F.when(F.col("area_ref") > 100, relative)), F.median(relative)).alias("area_median_relative"),
        F.corr("dg", "dg_ref").alias("dg_pearson"), F.median(F.abs(F.col("dg") - F.col("dg_ref"))).alias("dg_median_absolute"),
    )
    e = entries.agg(F.count(F.lit(1)).alias("n_entries"), F.sum("n_reference").alias("n_reference"), F.sum("n_reported").alias("reported"))
    return e.crossJoin(m).withColumn("match_rate", F.when(F.col("n_reference") > 0, F.col("matched") / F.col("n_reference")))


def blind_summary(matched: DataFrame, entries: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(summarize_crystal with the share of entries matched whole, the n entries of the worst rate). entries: also structure_id, n_matched."""
    whole = entries.agg(F.avg((F.col("n_matched") == F.col("n_reference")).cast("double")).alias("entries_whole"))
    worst = entries.where("n_reference > 0").withColumn("rate", F.col("n_matched") / F.col("n_reference")).orderBy("rate", "structure_id").limit(n)
    return summarize_crystal(matched, entries).crossJoin(whole), worst


def compare_assemblies(ours: DataFrame, theirs: DataFrame, entries: DataFrame) -> DataFrame:
    """A row for each of `entries` (structure_id): whether both sides' first assemblies agree, and how the sets of sizes do.

    ours: structure_id, rank, mmsize, counts (map), dissociation_energy; theirs: structure_id, set_no, id, mmsize, counts, by_author. An entry that
    either side has nothing for is a row too. Reference sizes of 0 (ligands alone) don't count; shares are null without a denominator."""
    sorted_map = lambda c: F.sort_array(F.map_entries(c))
    a = ours.groupBy("structure_id").agg(
        F.min_by(F.struct("mmsize", sorted_map("counts").alias("c")), "rank").alias("first"), F.collect_set("mmsize").alias("sizes"), F.max("dissociation_energy").alias("best"), F.count(F.lit(1)).alias("n_ours"),
    )
    order = F.struct("set_no", "id")
    b = theirs.groupBy("structure_id").agg(
        F.min_by(F.struct("mmsize", sorted_map("counts").alias("c")), order).alias("their_first"), F.collect_set(F.when(F.col("mmsize") > 0, F.col("mmsize"))).alias("their_sizes"),
        F.min_by("mmsize", F.when(F.col("by_author"), order)).alias("author"), F.max(F.col("by_author").cast("int")).alias("any_author"), F.count(F.lit(1)).alias("n_theirs"),
    )
    d = entries.select("structure_id").distinct().join(a, "structure_id", "left").join(b, "structure_id", "left")
    shared = F.size(F.array_intersect("sizes", "their_sizes"))
    share = lambda of: F.when(F.size(of) > 0, F.coalesce(shared, F.lit(0)) / F.size(of))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return d.select(
        "structure_id", F.col("their_first").isNotNull().alias("comparable"), F.coalesce("n_ours", F.lit(0)).alias("n_ours"), F.coalesce("n_theirs", F.lit(0)).alias("n_theirs"),
        yes(F.col("first.mmsize") == F.col("their_first.mmsize")).alias("size_match"), yes(F.col("first.c") == F.col("their_first.c")).alias("composition_match"),
        F.when(F.col("any_author") == 1, yes(F.col("first.mmsize") == F.col("author"))).alias("author_match"), share("their_sizes").alias("recall"), share("sizes").alias("precision"),
        (~yes(F.col("best") > 0)).alias("nothing_stable"),
    )


def summarize_assemblies(compared: DataFrame) -> DataFrame:
    """Rates over compare_assemblies: of comparable entries, of those with an author's assembly, and of those with none to compare."""
    on = lambda c, v: F.avg(F.when(c, v.cast("double")))
    c = F.col("comparable")
    return compared.agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_if(c).alias("n_comparable"), F.count("author_match").alias("n_with_author"), on(c, F.col("size_match")).alias("size_match_rate"), on(c, F.col("composition_match")).alias("composition_match_rate"),
        F.avg(F.col("author_match").cast("double")).alias("author_match_rate"), on(c, F.col("recall")).alias("mean_recall"), on(c, F.col("precision")).alias("mean_precision"), F.count_if(~c).alias("n_without"), on(~c, F.col("nothing_stable")).alias("nothing_stable_rate"),
    )


# --- bonds against a reference -----------------------------------------------------------------------------------------------


def bond_audit(ours: DataFrame, theirs: DataFrame, keys: list[str], facts: DataFrame | None = None) -> DataFrame:
    """Bonds of both sides matched on the unordered pair of atom names a1, a2: status matched, missed or extra, and why one is missed.

    facts: for pairs of atoms (keys, a1, a2) what is known of them: distance, roles, metal, angle, hydrogen (false where that test
    fails; null if there is no such test). The first test that fails is the reason; without facts the atoms are not in the model."""
    pair = lambda d: d.withColumns({"a1": F.least("a1", "a2"), "a2": F.greatest("a1", "a2")})
    best = lambda d, name: pair(d).groupBy(*keys, "a1", "a2").agg(F.min("distance").alias(name))
    d = best(ours, "our_distance").join(best(theirs, "their_distance"), [*keys, "a1", "a2"], "full_outer")
    status = F.when(F.col("their_distance").isNull(), "extra").when(F.col("our_distance").isNull(), "missed").otherwise("matched")
    d = d.withColumn("status", status)
    if facts is None:
        return d.withColumn("reason", F.lit(None).cast("string"))
    known = pair(facts).select(*keys, "a1", "a2", F.lit(True).alias("known"), "distance", "roles", "metal", "angle", "hydrogen")
    why = F.when(F.col("known").isNull(), "atom not in model")
    for test, name in (("distance", "distance"), ("roles", "no donor/acceptor role"), ("metal", "metal-coordinated"), ("angle", "antecedent angle"), ("hydrogen", "explicit-H geometry")):
        why = why.when(~F.col(test), name)
    d = d.join(known, [*keys, "a1", "a2"], "left")
    return d.withColumn("reason", F.when(F.col("status") == "missed", why.otherwise("capacity"))).select(*keys, "a1", "a2", "our_distance", "their_distance", "status", "reason")


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row: numbers, precision, recall, reasons of missed ones, quartiles of distances."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    quartiles = lambda c, s: F.percentile(F.when(F.col("status") == s, F.col(c)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    ours, theirs, both = n("matched", "extra"), n("matched", "missed"), n("matched")
    return audit.agg(
        theirs.alias("n_ref"), ours.alias("n_ours"), both.alias("n_matched"), F.when(ours > 0, both / ours).alias("precision"), F.when(theirs > 0, both / theirs).alias("recall"),
        quartiles("their_distance", "missed").alias("missed_quartiles"), quartiles("our_distance", "extra").alias("extra_quartiles"),
    )


def audit_counts(audit: DataFrame, of: str, status: str, most: int = MOST_KINDS) -> DataFrame:
    """The commonest values of a column among bonds of one status: reasons, or kinds of atoms."""
    return audit.where(F.col("status") == status).groupBy(of).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), of).limit(most)


# --- calibration tables ------------------------------------------------------------------------------------------------------


def residue_match(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Residues of both sides by structure, chain, number and insertion code; those that one side lacks are left out."""
    return ours.join(theirs, ["structure_id", "chain", "seq", "icode"])


def regroup(records: DataFrame, keys: list[str], areas: str, scheme: dict[str, str]) -> DataFrame:
    """Maps of areas by fine type as maps by a scheme's classes; types that the scheme does not name keep their own."""
    of = F.create_map(*[F.lit(x) for pair in scheme.items() for x in pair]) if scheme else F.create_map()
    e = records.select(*keys, F.explode(areas).alias("fine", "area"))
    name = F.coalesce(F.try_element_at(of, F.col("fine")), F.col("fine")) if scheme else F.col("fine")
    g = e.groupBy(*keys, name.alias("class")).agg(F.sum("area").alias("area"))
    return g.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "area")))).alias(areas))


def entropy_constant(parts: DataFrame) -> DataFrame:
    """The constant per additional body, in units of RT, that best fits known entropies: parts has known, rest (what the masses give) and bodies.

    Least squares of known - rest = constant * RT * (bodies - 1): two sums."""
    from ..functions import tables

    x = (F.col("bodies") - 1) * F.lit(tables.GAS_CONSTANT * tables.TEMPERATURE)
    y = F.col("known") - F.col("rest")
    return parts.agg(F.count(F.lit(1)).alias("n"), (F.sum(x * y) / F.sum(x * x)).alias("constant"), F.median(F.abs(y)).alias("median_rest"))
