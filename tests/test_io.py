import json

from pyspark.sql import functions as F

from nacre import sinks
from nacre.operators import report
from nacre.plans.analysis import Analysis
from nacre.sources import cif, other, pdb

from .test_structure import line, parse

CIF = """data_X
_entry.id X
_symmetry.space_group_name_H-M 'P 21 21 21'
_cell.length_a 10.0
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_seq_id
_atom_site.auth_asym_id
_atom_site.pdbx_PDB_ins_code
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.occupancy
_atom_site.pdbx_PDB_model_num
ATOM C CA A SER AA 3 7 A B 1.0 2.0 3.0 0.70 1
ATOM C CA B SER AA 3 7 A B 1.5 2.0 3.0 0.30 1
ATOM O "O5'" . SER AA 3 7 A B 2.0 2.0 3.0 1.00 1
ATOM C CA A SER AA 3 7 A B 9.0 2.0 3.0 1.00 2
loop_
_pdbx_poly_seq_scheme.mon_id
SER
HOH
"""


def test_cif(spark):
    files = spark.createDataFrame([("x", "x.cif", CIF)], "structure_id string, path string, text string")
    atoms, structures = cif.from_text(files)
    got = {(r.atom_name, r.altloc, r.chain_id, r.res_seq, r.label_seq_id, r.icode, r.x) for r in atoms.collect()}
    assert got == {("CA", "A", "A", 7, 3, "B", 1.0), ("O5'", " ", "A", 7, 3, "B", 2.0)}
    s = structures.first()
    assert s.space_group == "P 21 21 21" and s.cell.a == 10.0 and s.polymer_residues == ["SER"]


def test_cif_text_fields():
    got = cif.parse("data_a\n_a.b\n;two\nlines\n;\n_a.c 'it''s' # no\n_a.d ?\n_a.e '?'\n")
    assert got == {"_a.b": ["two\nlines"], "_a.c": ["it''s"], "_a.d": [None], "_a.e": ["?"]}


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.pdb").write_text(line(1, "CA", "ALA", "A", 1, 0, 0, 0, "C") + "\n")
    (tmp_path / "two.ent").write_text(line(1, "CA", "GLY", "B", 1, 0, 0, 0, "C") + "\n")
    (tmp_path / "notes.txt").write_text("no")
    atoms, _ = pdb.read_pdb(spark, str(tmp_path))
    assert {(r.structure_id, r.res_name) for r in atoms.collect()} == {("one", "ALA"), ("two", "GLY")}


def test_pae(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"predicted_aligned_error": [[0, 5], [7, 0]], "iptm": 0.8, "ptm": 0.7}))
    scores, matrix = other.read_pae(spark, str(tmp_path / "m.json"))
    assert scores.first().iptm == 0.8 and {(r.i, r.j): r.pae for r in matrix.collect()} == {(0, 0): 0.0, (0, 1): 5.0, (1, 0): 7.0, (1, 1): 0.0}


def test_documents(spark, tmp_path):
    rows = []
    for k, chain in enumerate("AB"):
        for i in range(2):
            for j, (name, el) in enumerate((("N", "N"), ("CA", "C"), ("C", "C"), ("O", "O"))):
                rows.append(line(len(rows) + 1, name, "ALA", chain, i + 1, 1.4 * j, 3.8 * i, 3.2 * k, el, b=20.0 + i))
    a = Analysis(pdb.number_atoms(pdb.select_altlocs(parse(spark, "\n".join(rows))[0])))
    docs = sinks.interface_documents(a.interfaces, a.contacts, a.totals, a.contact_map)
    doc = json.loads(docs.first().document)["assembly"]
    i = doc["interfaces"][0]
    assert i["interface_id"] == 1 and len(i.get("hbond", {"distance": []})["distance"]) == i["number_hydrogen_bonds"] and i["interface_contact_map"]
    sinks.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert "color 0x" in sinks.colour_script(a.residues).first().script
    text = sinks.pdb_text(a.assigned).first().text
    assert text.splitlines()[0].split()[:3] == ["ATOM", "1", "C"] and len(text.splitlines()) == 17
    totals, merged = report.group_digest(a.interfaces, a.residues, ["A"], ["B"])
    t = totals.first()
    assert t.n_pairs == 1 and abs(merged.agg(F.sum("bsa")).first()[0] / 2 - t.area) < 0.1
    assert report.interpretation(totals).first().remarks and "buries" in report.results_sentence(totals).first().sentence
    assert report.hot_spots(a.residues, n=2).count() == 2 and report.residue_matrix(merged).count() == 4
    a.release()


def test_engine_reads_both_formats(spark, tmp_path):
    from nacre.engine import StructureEngine

    (tmp_path / "x.cif").write_text(CIF)
    (tmp_path / "y.pdb").write_text(line(1, "CA", "GLY", "B", 1, 0, 0, 0, "C") + "\n")
    e = StructureEngine(spark)
    atoms, structures = e.read(str(tmp_path))
    assert {(r.structure_id, r.atom_name) for r in atoms.collect()} == {("x", "CA"), ("x", "O5'"), ("y", "CA")}
    assert {r.structure_id for r in structures.collect()} == {"x", "y"}
