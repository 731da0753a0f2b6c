import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nacre.functions import chem, scalars
from nacre.operators import assembly as A
from nacre.operators import crystal as X
from nacre.operators import molecules, spatial, surface
from nacre.sources import pdb

from .conftest import DATA

LINE = "{rec:<6}{serial:>5} {name:<4}{alt}{res:>3} {chain}{seq:>4}{icode}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{b:6.2f}          {el:>2}"


def line(serial, name, res, chain, seq, x, y, z, el, alt=" ", occ=1.0, b=10.0, rec="ATOM", icode=" "):
    return LINE.format(rec=rec, serial=serial, name=f" {name}", alt=alt, res=res, chain=chain, seq=seq, icode=icode, x=x, y=y, z=z, occ=occ, b=b, el=el)


def parse(spark, *texts, strict=True):
    files = spark.createDataFrame([(f"s{i}", "p", t) for i, t in enumerate(texts)], "structure_id string, path string, text string")
    lines = pdb.lines_of(files)
    return pdb.parse_atoms(lines, strict), lines


def points(spark, n, seed, span=20.0):
    rng = np.random.default_rng(seed)
    rows = [("s", i, int(i % 3), *map(float, rng.uniform(-span, span, 3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "structure_id string, atom_id int, molecule_id int, x double, y double, z double")


@pytest.mark.parametrize("cutoff", [2.0, 7.5])
def test_range_join_is_all_pairs(spark, cutoff):
    rows, d = points(spark, 150, 7)
    got = {(r.a_atom_id, r.b_atom_id) for r in spatial.pair_join(d, cutoff).collect()}
    want = {(p[1], q[1]) for p in rows for q in rows if p[2] < q[2] and math.dist(p[3:], q[3:]) <= cutoff}
    assert got == want
    near = {r.atom_id for r in spatial.atoms_near(d.where("molecule_id = 0"), d.where("molecule_id = 2"), cutoff).collect()}
    assert near == {p[1] for p in rows if p[2] == 0 and any(q[2] == 2 and math.dist(p[3:], q[3:]) <= cutoff for q in rows)}


def test_first_model_and_records(spark):
    text = "\n".join(["HEADER    TEST", "CRYST1   10.000   20.000   30.000  90.00  90.00  90.00 P 21 21 21    4", "SEQRES   1 A    2  DVA HOH", "MODEL        1", line(1, "CA", "ALA", "A", 1, 0, 0, 0, "C"), "ENDMDL", "MODEL        2", line(2, "CA", "ALA", "A", 1, 5, 0, 0, "C"), "ENDMDL"])
    atoms, lines = parse(spark, text)
    assert [(r.atom_name, r.x) for r in atoms.collect()] == [("CA", 0.0)]
    s = pdb.structures_of(lines).first()
    assert s.space_group == "P 21 21 21" and s.cell.b == 20.0 and s.cell.z == 4 and s.polymer_residues == ["DVA"]


def test_bad_records_name_their_line(spark):
    bad = line(1, "CA", "ALA", "A", 1, 0, 0, 0, "  ")
    with pytest.raises(Exception, match="blank element columns at line 1"):
        parse(spark, bad)[0].collect()
    loose = parse(spark, bad, line(1, "CA", "ALA", "A", 1, 0, 0, 0, "C"), line(1, "CA", "ALA", "A", 1, 0, 0, 0, "C")[:40], strict=False)[0]
    assert {(r.structure_id, r.error) for r in pdb.errors_of(loose).collect()} == {("s0", "blank element columns at line 1"), ("s2", "truncated atom record at line 1")}


def test_sequence_numbers(spark):
    want = {"  -5": -5, "9999": 9999, "A000": 10000, "A001": 10001, "ZZZZ": 1223055, "a000": 1223056, "a1!x": None, "    ": None}
    got = spark.createDataFrame([(k,) for k in want], "f string").select("f", pdb.decode_sequence_number("f").alias("n")).collect()
    assert {r.f: r.n for r in got} == want


def test_altlocs(spark):
    text = "\n".join([line(1, "N", "SER", "A", 1, 0, 0, 0, "N"), line(2, "CA", "SER", "A", 1, 1, 0, 0, "C", "A", 0.4), line(3, "CA", "ALA", "A", 1, 2, 0, 0, "C", "B", 0.9), line(4, "CB", "SER", "A", 1, 3, 0, 0, "C", "A", 0.4)])
    got = pdb.select_altlocs(parse(spark, text)[0]).collect()
    assert sorted((r.atom_name, r.altloc, r.res_name) for r in got) == [("CA", "B", "ALA"), ("N", " ", "ALA")]


def test_molecules(spark):
    text = "\n".join([line(1, "CA", "ALA", "A", 1, 0, 0, 0, "C"), line(2, "O", "HOH", "A", 9, 5, 0, 0, "O", rec="HETATM"), line(3, "FE", "HEM", "A", 5, 9, 0, 0, "FE", rec="HETATM"), line(4, "P", "DA", "B", 1, 0, 9, 0, "P")])
    atoms = molecules.assign(pdb.number_atoms(pdb.select_altlocs(parse(spark, text)[0])))
    got = {(r.atom_name, r.molecule_id, r.molecule_class, r.molecule_label) for r in atoms.collect()}
    assert got == {("CA", 0, "Protein", "A"), ("FE", 1, "Ligand", "[HEM]A:5"), ("O", None, None, None), ("P", 3, "NucleicAcid", "B")}
    with pytest.raises(ValueError):
        molecules.assign(atoms, ligand_mode="other")


def test_surface_closed_forms(spark):
    rows = [("one", 0, 0, "CA", "ALA", "C", 0.0, 0.0, 0.0), ("two", 0, 0, "K", "K", "K", 0.0, 0.0, 0.0), ("two", 1, 1, "K", "K", "K", 7.95, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "structure_id string, atom_id int, molecule_id int, atom_name string, res_name string, element string, x double, y double, z double")
    got = {(r.structure_id, r.atom_id): r for r in surface.atom_surface(d).collect()}
    assert got["one", 0].asa_combined == pytest.approx(4 * math.pi * (1.87 + 1.4) ** 2)
    r = 2.75 + 1.4
    cap = 2 * math.pi * r * (r - 7.95 / 2)
    assert got["two", 0].asa_alone == pytest.approx(4 * math.pi * r * r)
    assert got["two", 0].asa_alone - got["two", 0].asa_combined == pytest.approx(cap, abs=4 * math.pi * r * r / 480 * 1.5)
    assert got["two", 0].pairs[0].molecule == 1 and got["two", 0].pairs[0].buried == pytest.approx(got["two", 0].asa_alone - got["two", 0].asa_combined)
    live = {(x.structure_id, x.atom_id): x.live for x in surface.accessible_points(d.withColumn("radius", chem.surface_radius("element", "atom_name", "res_name"))).collect()}
    assert all(got[k].asa_combined == pytest.approx(4 * math.pi * (got[k].radius + 1.4) ** 2 * n / 480) for k, n in live.items())


def test_erf(spark):
    xs = [-6.0, -2.6, -2.5, -1.0, -1e-9, 0.0, 0.3, 1.7, 2.49, 2.51, 4.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.erf("x").alias("e")).collect()
    assert all(r.e == pytest.approx(math.erf(r.x), abs=1e-13) for r in got)


def test_composition_counts(spark):
    got = spark.range(1).select(scalars.composition_counts(F.lit("E[4]I[CA][2]")).alias("m")).first().m
    assert got == {"E": 4, "I": 1, "CA": 2}


def test_dissociation():
    m = {"A": 10_000.0, "B": 20_000.0, "C": 5_000.0, "D": 8_000.0}
    d = A.dissociate({k: m[k] for k in "AB"}, [("A", "B", -12.5)])
    assert d.energy == pytest.approx(12.5 - A.entropy([m["A"], m["B"]])) and d.cut == [("A", "B")]
    chain = A.dissociate({k: m[k] for k in "ABC"}, [("A", "B", -40.0), ("B", "C", -5.0)])
    assert chain.cut == [("B", "C")] and chain.parts == [["A", "B"], ["C"]]
    daisy = A.dissociate(m, [("A", "B", -0.2), ("B", "C", -0.2), ("C", "D", -0.2), ("D", "A", -0.2)])
    assert len(daisy.parts) == 4
    assert A.dissociate({"A": 1.0}, []).energy == 0.0
    big = A.dissociate({i: 1000.0 + i for i in range(16)}, [(i, i + 1, -30.0) for i in range(15)])
    assert not big.exact and len(big.cut) == 1


def test_entropy_adds_up_over_a_split():
    a, b, c = 1e4, 2e4, 3e4
    assert A.entropy([a, b, c]) == pytest.approx(A.entropy([a + b, c]) + A.entropy([a, b]))


def op(text, cell=(0, 0, 0)):
    r, t = X.parse_triplet(text)
    return r, tuple(x + 24 * k for x, k in zip(t, cell, strict=True))


@pytest.mark.parametrize(("place", "nodes"), [("-x,-y,z", 2), ("-y,x-y,z", 3), ("-x,-y,z+1/2", None)])
def test_growth(place, nodes):
    def body(turn, shift):
        c = A.Contact(1, "A", "A", turn, shift, -5.0, 100.0)
        packing = A.Packing(["A"], [c])
        packing.add(c)
        return packing.body("A")

    got = body(*op(place))
    assert (got and len(got)) == nodes
    assert body(A.NO_TURN, (24, 0, 0)) is None


def plain_bodies(molecules, contacts):
    """What each molecule is connected with, by walking contacts from its place, None where the walk leaves a small box."""
    out = {}
    for m in molecules:
        seen, todo = {(m, A.NO_TURN, (0, 0, 0))}, [(m, A.NO_TURN, (0, 0, 0))]
        while todo and seen:
            name, r, t = todo.pop()
            steps = []
            for c in contacts:
                if c.first == name:
                    steps.append((c.second, A.turned(r, c.turn), tuple(x + y for x, y in zip(t, A.turned(r, c.shift), strict=True))))
                if c.second == name:
                    back = next(q for q in TURNS if A.turned(q, c.turn) == A.NO_TURN)
                    q = A.turned(r, back)
                    steps.append((c.first, q, tuple(x - y for x, y in zip(t, A.turned(q, c.shift), strict=True))))
            for s in steps:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
            if any(abs(x) > 24 * 9 for _, _, t in seen for x in t):
                seen = None
        out[m] = seen
    return out


TURNS = [r for r, _ in X.operators_of("P 43 21 2")]


def test_packing_against_walks():
    import random

    rng = random.Random(3)
    for _ in range(60):
        molecules = ["A", "B", "C"]
        contacts = [A.Contact(i, rng.choice(molecules), rng.choice(molecules), rng.choice(TURNS), tuple(24 * rng.choice([0, 0, 0, 1, -1]) for _ in range(3)), -1.0, 1.0) for i in range(rng.randint(1, 4))]
        packing = A.Packing(molecules, contacts)
        for c in contacts:
            packing.add(c)
        walks = plain_bodies(molecules, contacts)
        for m in molecules:
            got = packing.body(m)
            assert (got and {(n, r, t) for (n, r), t in got.items()}) == walks[m]


def test_self_inverse_contact_counts_once():
    r = A.bodies_of({"A": 1e4}, set(), [A.Contact(1, "A", "A", *op("-x,-y,z"), -20.0, 500.0)])[0]
    assert r["size"] == 2 and r["n_interfaces"] == 1 and r["composition"] == "A[2]" and r["formula"] == "A2"
    assert r["dissociation_energy"] == pytest.approx(20.0 - A.entropy([1e4, 1e4]))


ORDERS = {"P 1": 1, "P 21 21 21": 4, "C 2": 4, "R 3 2": 18, "P 43 21 2": 8, "I 41 2 2": 16, "P 61 2 2": 12, "F 4 3 2": 96, "I 41 3 2": 48, "P 32 2 1": 6}


@pytest.mark.parametrize("name", ORDERS)
def test_space_groups(name):
    ops = X.operators_of(name)
    assert len(ops) == ORDERS[name] == len(set(ops)) and X.triplet(ops[0]) == "x,y,z"
    with pytest.raises(ValueError):
        X.operators_of("Q 9")


def after(p, q):
    return A.turned(p[0], q[0]), tuple(x + y for x, y in zip(p[1], A.turned(p[0], q[1]), strict=True))


def test_equivalent_pairs_share_a_key(spark):
    a, b = op("x,y,z"), op("-y,x-y,z+1/3", (1, 0, 0))
    move = op("-x,-y,z+1/2", (0, 2, -1))
    rows = [("A", "B", *map(list, a), *map(list, b)), ("A", "B", *map(list, after(move, a)), *map(list, after(move, b))), ("B", "A", *map(list, b), *map(list, a)), ("A", "B", *map(list, a), *map(list, move))]
    ints = "array<int>"
    d = spark.createDataFrame(rows, f"asu_1 string, asu_2 string, rotation_1 {ints}, translation_1 {ints}, rotation_2 {ints}, translation_2 {ints}")
    keys = [r.eq_key for r in X.with_relative(d).collect()]
    assert keys[0] == keys[1] == keys[2] != keys[3]


def test_two_chains_end_to_end(spark):
    from nacre.plans.analysis import Analysis

    rows = []
    for k, chain in enumerate("AB"):
        for i in range(3):
            for j, (name, el) in enumerate((("N", "N"), ("CA", "C"), ("C", "C"), ("O", "O"))):
                rows.append(line(len(rows) + 1, name, "ALA", chain, i + 1, 1.4 * j, 3.8 * i, 3.5 * k, el))
    atoms = pdb.number_atoms(pdb.select_altlocs(parse(spark, "\n".join(rows))[0]))
    a = Analysis(atoms)
    got = a.interfaces.collect()
    assert len(got) == 1 and got[0].interface_area > 50 and 0 < got[0].css < 1 and 0 <= got[0].p_value <= 1
    assert got[0].number_interface_residues == 6
    moved = Analysis(atoms.withColumn("x", F.col("x") + 100)).interfaces.first()
    assert moved.interface_area == pytest.approx(got[0].interface_area, abs=0.02)
    a.release()
    with pytest.raises(ValueError):
        Analysis(atoms, mode="nothing")


def test_pair_rules_cost_bits(spark):
    """Rules of pairs look at traits found once an atom, are dealt out by cells, and say the same as from names."""
    from nacre import queries

    pairs = queries.contact_pairs(spark, DATA)
    known = pairs.select(chem.contact_class(known=True).alias("c"), chem.is_hydrogen_bond(known=True).alias("h"), chem.is_salt_bridge(known=True).alias("s"), chem.is_disulfide(known=True).alias("d"))
    plan = known._jdf.queryExecution()
    above = plan.optimizedPlan().toString().split("Join")[0]
    assert "traits" in above and "_name" not in above and "element" not in above
    assert "SortMergeJoin" in plan.sparkPlan().toString() and "Broadcast" not in plan.sparkPlan().toString()
    both = pairs.select(*[f(known=k).alias(f"{n}{k:d}") for n, f in (("c", chem.contact_class), ("h", chem.is_hydrogen_bond), ("s", chem.is_salt_bridge), ("d", chem.is_disulfide)) for k in (True, False)])
    assert both.where(" OR ".join(f"{n}0 <> {n}1 OR {n}0 IS NULL OR {n}1 IS NULL" for n in "chsd")).count() == 0
    odd = spark.createDataFrame([(None, "SG", "S", "CYS", None, "S", 2.5), ("CYS", "SG", None, "CYS", "SG", "S", 2.5), (" cys", "sg ", "s", "CYS", "SG", "S", 2.5), (None, None, None, None, None, None, 4.0)], "a_res_name string, a_atom_name string, a_element string, b_res_name string, b_atom_name string, b_element string, distance double")
    assert [r.c for r in odd.select(chem.is_disulfide().alias("c")).collect()] == [False, False, True, False]


def test_surface_by_blocks(spark, monkeypatch):
    """A crowd and a spread of atoms over several blocks and groups, against all pairs; pairs of atoms are never rows."""
    monkeypatch.setattr(surface, "GROUP_ATOMS", 40)
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(0, 3, (150, 3)), rng.uniform(-60, 60, (120, 3))])
    mol = [None if i % 9 == 0 else i % 4 for i in range(270)]
    rows = [("s", i, mol[i], "CA", "ALA", "C", *map(float, xyz[i])) for i in range(270)] + [("s", 270, 1, "CA", "ALA", "C", None, 0.0, 0.0), ("t", 0, 0, "CA", "ALA", "C", 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "structure_id string, atom_id int, molecule_id int, atom_name string, res_name string, element string, x double, y double, z double")
    frame = surface.atom_surface(d)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "collect_list" not in plan and "a_x" not in plan
    got = {(r.structure_id, r.atom_id): r for r in frame.collect()}
    live = {(r.structure_id, r.atom_id): r.live for r in surface.accessible_points(d.withColumn("radius", F.lit(1.87))).collect()}
    r = 1.87 + 1.4
    assert len(got) == len(live) == 272 and got["s", 270].asa_combined == got["t", 0].asa_alone == pytest.approx(4 * math.pi * r * r) and live["s", 270] == 480
    unit, m = surface.unit_sphere(), np.array([-1 if x is None else x for x in mol])
    for i in range(270):
        dark = ((xyz[i] + r * unit)[:, None, :] - xyz[None]) ** 2
        dark = dark.sum(2) < r * r
        dark[:, i] = False
        share = 4 * math.pi * r * r / 480
        g, own = got["s", i], dark[:, m == m[i]].any(1) if mol[i] is not None else np.zeros(480, bool)
        assert live["s", i] == 480 - dark.any(1).sum() and g.asa_combined == pytest.approx(share * live["s", i]) and g.asa_alone == pytest.approx(share * (480 - own.sum()))
        near = {int(k) for k in m[np.sqrt(((xyz[i] - xyz) ** 2).sum(1)) < 2 * r] if k >= 0 and k != m[i]} if mol[i] is not None else set()
        assert {p.molecule: p.buried for p in g.pairs} == {k: pytest.approx(share * (dark[:, m == k].any(1) & ~own).sum()) for k in near}


def test_bonds_counted_without_contacts(spark):
    """Bonds from the atoms that can take part, and counts without a row for each contact, are those of all contacts."""
    from nacre import queries
    from nacre.operators import contacts as C

    a = queries.atoms(spark, DATA)
    p = C.with_bonds(a, queries.contact_pairs(spark, DATA))
    key = ["structure_id", "molecule_1", "molecule_2"]
    was = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c[:1]) for c in ("hydrogen_bond", "salt_bridge", "disulfide")], F.count_if(F.size("bond_types") == 0).alias("other"))
    now = C.bond_counts(a, 5.0)
    assert sorted(map(tuple, was.collect())) == sorted(map(tuple, now.collect())) and was.agg(F.sum("hydrogen_bond"[:1])).first()[0] > 0
    for cutoff in (3.0, 5.0):
        bonds = C.with_bonds(a, C.contacts(a, cutoff)).where("hydrogen_bond").select(*key, "a_atom_id", "b_atom_id")
        assert sorted(map(tuple, bonds.collect())) == sorted(map(tuple, C.hydrogen_bonds(a, cutoff).collect()))


def test_interfaces_keep_no_contacts(spark):
    """The interfaces and their residues come without the table of all contacts, which is made only when it is asked for."""
    from nacre import queries
    from nacre.plans.analysis import Analysis

    a = queries.atoms(spark, DATA).where("atom_id < 200").withColumns({"molecule_class": F.lit("Protein"), "molecule_label": F.col("auth_asym_id"), "chain_type": F.lit("polymer"), "ccd_id": F.lit(None).cast("string"), "label_comp_id": F.col("res_name")})
    made = Analysis(a.drop("label"))
    assert made.interfaces.count() > 0 and made.residues.count() > 0 and "contacts" not in vars(made)
    sums = made.interfaces.agg(F.sum("number_hydrogen_bonds"), F.sum("number_salt_bridges"), F.sum("number_disulfide_bonds"), F.sum("number_other_bonds")).first()
    assert tuple(sums) == tuple(made.contacts.agg(*[F.count_if(c) for c in ("hydrogen_bond", "salt_bridge", "disulfide")], F.count_if(F.size("bond_types") == 0)).first())
    bare = Analysis(a.drop("label"), probe=0.0, points=1)  # surfaces that bury next to nothing: sides stand by their contacts
    bare.__dict__["burial"] = made.burial.where("molecule_1 > 3 AND molecule_id = molecule_1")
    touching = bare.contacts.selectExpr("molecule_1", "molecule_2", "stack(2, molecule_1, a_atom_id, molecule_2, b_atom_id) AS (molecule_id, atom_id)").distinct()
    want = {tuple(r) for r in touching.collect() if not (r.molecule_1 > 3 and r.molecule_id == r.molecule_1)} | {(r.molecule_1, r.molecule_2, r.molecule_id, r.atom_id) for r in bare.burial.collect()}
    got = {(r.molecule_1, r.molecule_2, r.molecule_id, r.atom_id) for r in bare.faces.collect()}
    sides = {x[:3] for x in ((r.molecule_1, r.molecule_2, r.molecule_id) for r in bare.burial.collect())}
    assert got == {x for x in want if x[:3] not in sides} | {x for x in got if x[:3] in sides} and len(got) > len(sides)
