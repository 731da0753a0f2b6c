"""XML of reference data, archives, error rows of batches, exports."""

import gzip

import pytest
from pyspark.sql import functions as F

from nacre.engine import StructureEngine
from nacre.sinks import export
from nacre.sources import archive, other, pdb

ATOM = "ATOM  {:5d}  CA  ALA {}{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00 10.00           C  "


def model(n=3, chain="A"):
    return "\n".join(ATOM.format(i, chain, i, i * 3.8, 0.0, 0.0) for i in range(1, n + 1)) + "\nEND\n"


def test_interfaces_xml(spark, tmp_path):
    bond = "<bond><chain-1>A</chain-1><res-1>ARG</res-1><seqnum-1> 12</seqnum-1><atname-1> NH1</atname-1><chain-2>B</chain-2><res-2>ASP</res-2><seqnum-2>7</seqnum-2><atname-2>OD1</atname-2><dist>2.9</dist></bond>"
    mol = "<molecule><id>1</id><chain_id>A</chain_id><class>Protein</class><symop>X,Y,Z</symop><rxx>1.0</rxx><ryy>1</ryy><rzz>1</rzz><tx>5.5</tx><residues><residue><name>ARG</name><seq_num>12</seq_num><bsa>10.5</bsa></residue><residue><name>GLY</name><seq_num>13</seq_num><bsa>0.0</bsa></residue></residues></molecule>"
    (tmp_path / "a.xml").write_text(f"<pdb_entry><interface><id>1</id><n_occ>2</n_occ><int_area>495.3</int_area><h-bonds><bond_count>1</bond_count>{bond}</h-bonds>{mol}{mol}</interface><interface><id>2</id></interface></pdb_entry>")
    rows = {r.id: r for r in other.read_interfaces_xml(spark, str(tmp_path / "a.xml"), residues=True).collect()}
    r = rows[1]
    assert (r.n_occ, r.int_area, len(r.h_bonds), r.h_bonds[0].seqnum1, r.h_bonds[0].atname1, r.salt_bridges) == (2, 495.3, 1, "12", "NH1", [])
    assert r.molecules[0].rotation == [1, 0, 0, 0, 1, 0, 0, 0, 1] and r.molecules[0].translation == [5.5, 0, 0] and [x.name for x in r.molecules[0].residues] == ["ARG"]
    assert rows[2].molecules == [] and rows[2].n_occ == 1
    assert other.identity_interfaces(other.read_interfaces_xml(spark, str(tmp_path / "a.xml"))).select("id").collect()[0].id == 1


def test_assemblies_xml_with_none(spark, tmp_path):
    asm = "<asm_set><ser_no>1</ser_no><assembly><id>3</id><size>2</size><mmsize>2</mmsize><composition>AB</composition><diss_energy>1.5</diss_energy><R350>1</R350><score> stable   in solution </score><molecule><chain_id>A</chain_id><rxx>1</rxx></molecule></assembly></asm_set>"
    (tmp_path / "some.xml").write_text(f"<pisa_multimers><pdb_entry><pdb_code>1ABC</pdb_code><total_asm>1</total_asm></pdb_entry>{asm}</pisa_multimers>")
    (tmp_path / "none.xml").write_text("<pisa_multimers><pdb_entry><pdb_code>2XYZ</pdb_code><total_asm>0</total_asm></pdb_entry></pisa_multimers>")
    entries, assemblies = other.read_assemblies_xml(spark, str(tmp_path))
    assert {r.pdb_id: r.total_asm for r in entries.collect()} == {"1abc": 1, "2xyz": 0}
    rows = assemblies.collect()
    assert len(rows) == 1 and (rows[0].set_no, rows[0].id, rows[0].mmsize, rows[0].r350, rows[0].symmetry_number, rows[0].score) == (1, 3, 2, 1, 1, "stable in solution")
    assert rows[0].molecules[0].rotation[:2] == [1, 0]
    _, empty = other.read_assemblies_xml(spark, str(tmp_path / "none.xml"))
    assert empty.count() == 0


def test_same_names_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "m.pdb").write_text(model())
    (tmp_path / "a" / "own.pdb").write_text(model())
    ids = sorted(r.structure_id for r in pdb.read_files(spark, str(tmp_path)).collect())
    assert len(set(ids)) == 3 and "own" in ids and all(i == "own" or i.endswith("/m.pdb") for i in ids)


def test_bad_files_are_rows(spark, tmp_path):
    (tmp_path / "good.pdb").write_text(model(4) + model(4, "B"))
    (tmp_path / "bad.pdb").write_text(model(2).replace("   3.800", "   x.800"))
    (tmp_path / "empty.pdb").write_text("REMARK nothing\n")
    rows = {r.structure_id: r for r in StructureEngine(spark).analyze_many(str(tmp_path)).collect()}
    assert rows["good"].error is None and "unreadable coordinates at line 1" in rows["bad"].error and rows["empty"].error == "no atoms" and len(rows) == 3
    export.batch_log(spark.createDataFrame([(1, None)], "id int, error string"), str(tmp_path / "log"))
    export.batch_log(spark.createDataFrame([(2, "x")], "id int, error string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_archive(spark, tmp_path):
    for name in ("1abc.xml.gz", "1abc.multimers.xml.gz", "2DEF.xml.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("<x/>")
    there = archive.kept(spark, str(tmp_path), "interfaces")
    assert sorted(r.pdb_id for r in there.collect()) == ["1abc", "2def"]
    assert [r.pdb_id for r in archive.wanted(spark.createDataFrame([("1ABC",), ("9zzz",)], "pdb_id string"), there).collect()] == ["9zzz"]
    t = spark.createDataFrame([("a", {"C": 1.5})], "k string, m map<string, double>")
    archive.save_table(t, str(tmp_path / "t"))
    assert archive.load_table(spark, str(tmp_path / "t"), "k string, m map<string, double>").collect() == t.collect()


def test_sheet_names_and_export(spark, tmp_path):
    got = export.sheet_names(["a/b", "A b", "x" * 40, "x" * 50, "", "''"])
    assert got == ["a b", "A b (2)", "x" * 31, "x" * 27 + " (2)", "Sheet", "Sheet (2)"]
    out = export.export({"one": spark.range(3).withColumn("l", F.array("id"))}, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(out["one"]).count() == 3


def test_scene_is_json(spark):
    import json

    d = spark.createDataFrame([("s", 1, "A", 5), ("s", 2, "B", 6), ("s", 1, "A", 7)], "structure_id string, side int, auth_asym_id string, res_seq int")
    r = export.scene(d).collect()[0]
    tree = json.loads(r.scene)["root"]["children"][0]["children"][0]["children"][0]["children"]
    assert len(tree) == 3 and tree[1]["params"]["selector"] == [{"auth_asym_id": "A", "auth_seq_id": 5}, {"auth_asym_id": "A", "auth_seq_id": 7}]
