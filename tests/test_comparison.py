"""Alignment, assignment and matching against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nacre.operators import comparison as P


def plain_best(a, b):
    row = [j * P.GAP for j in range(len(b) + 1)]
    for x in a:
        new = [row[0] + P.GAP]
        for j, y in enumerate(b, start=1):
            new.append(max(row[j - 1] + (P.MATCH if x == y else P.MISMATCH), row[j] + P.GAP, new[-1] + P.GAP))
        row = new
    return row[-1]


def test_alignment():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACDE") for _ in range(rng.randint(0, 12))) for _ in range(2))
        pairs = P.align(a, b)
        assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))
        gaps = len(a) + len(b) - 2 * len(pairs)
        assert sum(P.MATCH if a[i] == b[j] else P.MISMATCH for i, j in pairs) + gaps * P.GAP == plain_best(a, b)


def test_assignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 6, 2))
        gain = rng.integers(0, 20, (n, m)).astype(float)
        got = P.assignment(gain)
        small, large = sorted((n, m))
        best = max(sum(gain[i, j] if n <= m else gain[j, i] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small))
        assert sum(gain[i, j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == small == len(got)


def test_shared_chains(spark):
    ref = [("r", "H", "EVQLVESGGGLVQPGG"), ("r", "L", "DIQMTQSPSSLSASVG")]
    mob = [("m", "X", "DIQMTQSPSSLSASVA"), ("m", "Y", "EVQLVESGGGLVQAGG"), ("m", "Z", "EVQLVESGGGLVQPGA"), ("k", "A", "WWWWWWWWWWWWWWWW")]
    frame = lambda rows: spark.createDataFrame(rows, "structure_id string, chain string, sequence string")
    got = {(r.structure_id, r.chain): r.reference_chain for r in P.shared_chains(frame(ref), frame(mob)).collect()}
    assert got.pop(("m", "X")) == "L" and set(got.values()) == {"H"} and len(got) == 1 and ("k", "A") not in got


def test_match_crystal_is_greedy_and_sees_both_ends(spark):
    one, quarter, back = ([float(x) for x in v] for v in ((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, -1, 0, 1, 0, 0, 0, 0, 1), (0, 1, 0, -1, 0, 0, 0, 0, 1)))
    schema = "structure_id string, pair string, id long, r array<double>, t array<double>"
    theirs = spark.createDataFrame([("s", "A+B", 1, one, [0.0, 0.0, 0.0]), ("s", "A+B", 2, one, [0.5, 0.0, 0.0]), ("s", "A+B", 3, quarter, [1.0, 2.0, 3.0]), ("s", "A+C", 4, one, [0.0, 0.0, 0.0])], schema)
    # 10 is nearest to both 1 and 2: 1 chooses first, 2 takes what is left within its reach. 12 is 3 seen from its other end.
    ours = spark.createDataFrame([("s", "A+B", 10, one, [0.2, 0.0, 0.0]), ("s", "A+B", 11, one, [1.2, 0.0, 0.0]), ("s", "A+B", 12, back, [-2.0, 1.0, -3.0])], schema)
    got = {r.their_id: (r.our_id, round(r.cost, 6)) for r in P.match_crystal(ours, theirs).collect()}
    assert got == {1: (10, 0.2), 2: (11, 0.7), 3: (12, 0.0)}


def test_superposition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 3)) * 10
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    noise = rng.normal(size=(30, 3)) * 0.1
    u = x @ q.T + [1, 2, 3] + noise
    rows = [("c", *map(float, a), *map(float, b)) for a, b in zip(x, u, strict=True)]
    r = P.superposition(spark.createDataFrame(rows, "complex string, x double, y double, z double, u double, v double, w double")).collect()[0]
    turn, shift = np.array(r.rotation).reshape(3, 3), np.array(r.shift)
    assert np.linalg.det(turn) == pytest.approx(1) and np.abs(turn - q).max() < 0.02
    assert r.rmsd == pytest.approx(np.sqrt((((x @ turn.T + shift) - u) ** 2).sum(1).mean()), abs=1e-6)


def test_operators_are_never_guessed(spark):
    schema = "structure_id string, asu string, rotation array<int>, translation array<int>"
    one = [1, 0, 0, 0, 1, 0, 0, 0, 1]
    known = spark.createDataFrame([("s", "A", one, [0, 12, 0], 7)], schema + ", operator int")
    placed = spark.createDataFrame([("s", "A", one, [24, -12, 48]), ("s", "A", one, [1, 12, 0]), ("s", "B", one, [0, 12, 0])], schema)
    assert [r.operator for r in P.operator_of(placed, known).orderBy("asu", "translation").collect()] == [None, 7, None]


def test_medians(spark, monkeypatch):
    """Exact medians of many distinct values, of ties, of few rows, with nulls, and none without rows; agreement keeps no set of all values."""
    from nacre.operators import validate

    monkeypatch.setattr(validate, "MEDIAN_VALUES", 50)
    monkeypatch.setattr(validate, "MEDIAN_ACCURACY", 100)
    rng = np.random.default_rng(4)
    for n in (1, 2, 49, 4000, 4001):
        x = [[float(v) for v in rng.normal(size=n)], [float(v) for v in rng.integers(0, 3, n)], [None if i % 3 else float(i % 1000) for i in range(n)], [None] * n, [7.0 if i % 5 else float(i) for i in range(n)]]
        d = spark.createDataFrame(list(zip(*x, strict=True)), ", ".join(f"c{i} double" for i in range(5)))
        got = validate.medians(d, [F.col(c) for c in d.columns])
        assert got == [pytest.approx(float(np.median([v for v in c if v is not None]))) if any(v is not None for v in c) else None for c in x]
    plan = validate.agreement(d.select("c0", (F.col("c1") + 1).alias("c1")), "c0", "c1")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile" not in plan


def test_aligned_errors(spark):
    """Errors by a formula, over contacts that bring their residues' index, are those of the matrix; no pair of residues is a row unless it touches."""
    from nacre import queries
    from nacre.operators import contacts, report

    from .conftest import DATA

    a = queries.heavy(spark, DATA)
    h = report.with_residue_index(a)
    ix = report.residue_index(a).select("structure_id", "index")
    matrix = ix.withColumnRenamed("index", "i").join(ix.withColumnRenamed("index", "j"), "structure_id").withColumn("pae", ((F.col("i") * 7 + F.col("j") * 3) % 31).cast("double"))
    was = report.pae_scores(contacts.contacts(a, 5.0), a, matrix)
    now = report.pae_scores(contacts.contacts(h, 5.0, ("index",)), h, lambda i, j: ((i * 7 + j * 3) % 31).cast("double"))
    assert sorted(map(tuple, was.collect())) == [pytest.approx(r) for r in sorted(map(tuple, now.collect()))]
    plan = queries.QUERIES["J24_aligned_error"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 3 and sum("floor" in x or "_c0" in x for x in joins) == 1  # each side's index, and the contacts


def test_contact_map(spark):
    """Counts, least distances and the dominant class against a plain count; the query's map is one aggregate by hashing."""
    from nacre import queries
    from nacre.operators import contacts as C

    from .conftest import DATA

    rng = random.Random(3)
    classes = ["disulfide", "pi_pi", "hydrogen_bond", "clash", "proximal", "weak_hbond", "polar_vdw"]
    rows = [("s", 0, 1, rng.choice("AB"), rng.randrange(2), "", "GLY", rng.choice("AB"), rng.randrange(2), "", "SER", rng.choice(classes[rng.randrange(5) :]), i / 64 + 1) for i in range(90)]
    cols = ["structure_id", "molecule_1", "molecule_2", "a_auth_asym_id", "a_res_seq", "a_icode", "a_res_name", "b_auth_asym_id", "b_res_seq", "b_icode", "b_res_name", "interaction", "distance"]
    groups = {}
    for r in rows:
        x, y = (r[3:6], r[6]), (r[7:10], r[10])
        x, y = (x, y) if x[0] <= y[0] else (y, x)
        groups.setdefault((x[0], y[0]), []).append((r[12], r[11], x[1], y[1]))
    got = C.contact_map(spark.createDataFrame(rows, cols)).collect()
    assert len(got) == len(groups)
    for r in got:
        g = groups[(r.residue_1_chain, r.residue_1_seq, r.residue_1_icode), (r.residue_2_chain, r.residue_2_seq, r.residue_2_icode)]
        n = {c: sum(x[1] == c for x in g) for c in classes if any(x[1] == c for x in g)}
        special = [c for c in n if c not in C.GENERIC]
        best = max(special, key=lambda c: (n[c], -min(x[0] for x in g if x[1] == c))) if special else min(n, key=C.GENERIC_ORDER.index)
        assert (r.min_distance, r.residue_1_type, r.residue_2_type, r.num_contacts, r.interaction_counts, r.dominant_interaction) == (*[min(g)[k] for k in (0, 2, 3)], len(g), n, best)
    plan = queries.QUERIES["A8_contact_map"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2
