"""Other inputs: predicted aligned errors, interface and assembly XML, assembly JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pae(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(scores, matrix) of predicted aligned errors: iptm, ptm and max by structure; structure_id, i, j, pae by pair of residues."""
    d = spark.read.option("multiLine", "true").json(list(paths)).select(F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json(\.gz)?$", "").alias("structure_id"), "*")
    have = lambda c: F.col(c).cast("double") if c in d.columns else F.lit(None).cast("double")
    scores = d.select("structure_id", have("iptm").alias("iptm"), have("ptm").alias("ptm"), have("max_predicted_aligned_error").alias("max_pae"))
    rows = d.select("structure_id", F.posexplode("predicted_aligned_error").alias("i", "row"))
    return scores, rows.select("structure_id", "i", F.posexplode("row").alias("j", "pae")).withColumn("pae", F.col("pae").cast("double"))


_BOND = ", ".join(f"`{n}-{k}`: string" for k in (1, 2) for n in ("chain", "res", "seqnum", "inscode", "atname")) + ", dist: double"
_PLACE = ", ".join([*(f"r{p}{q}: double" for p in "xyz" for q in "xyz"), "tx: double, ty: double, tz: double"])
_RESIDUES = "residues: struct<residue: array<struct<name: string, seq_num: string, ins_code: string, asa: double, bsa: double, solv_en: double>>>"
_MOLECULE = f"id: string, chain_id: string, class: string, symop: string, symop_no: string, cell_i: int, cell_j: int, cell_k: int, int_natoms: int, int_nres: int, int_area: double, int_solv_en: double, pvalue: double, {_PLACE}, {_RESIDUES}"
_LISTS = {"h-bonds": "h_bonds", "salt-bridges": "salt_bridges", "ss-bonds": "ss_bonds", "cov-bonds": "cov_bonds"}
_INTERFACE = "id int, type string, n_occ int, int_area double, int_solv_en double, pvalue double, stab_en double, css double, " + ", ".join(f"`{x}` struct<bond: array<struct<{_BOND}>>>" for x in _LISTS) + f", molecule array<struct<{_MOLECULE}>>"
_ASSEMBLY = f"id: int, size: int, mmsize: int, formula: string, composition: string, diss_energy: double, entropy: double, diss_area: double, int_energy: double, symNumber: int, n_diss: int, R350: int, score: string, molecule: array<struct<chain_id: string, {_PLACE}>>"


def _placed(m) -> list:
    """Rotation (nine by rows) and translation of a molecule; what the file leaves out is 0."""
    zero = lambda k: F.coalesce(m[k], F.lit(0.0))
    return [F.array(*[zero(f"r{p}{q}") for p in "xyz" for q in "xyz"]).alias("rotation"), F.array(*[zero(f"t{p}") for p in "xyz"]).alias("translation")]


def read_interfaces_xml(spark: SparkSession, *paths: str, residues: bool = False) -> DataFrame:
    """Interfaces of the original engine's XML, one row each: energies, four lists of bonds, molecules with their transforms, and source.

    The schema is fixed, so files that lack a part give empty lists and nulls. Of residues, if wanted, those that bury something are kept."""
    d = spark.read.format("xml").option("rowTag", "interface").schema(_INTERFACE).load(list(paths))
    names = {f"{n}-{k}": f"{n}{k}" for k in (1, 2) for n in ("chain", "res", "seqnum", "inscode", "atname")}
    bond = lambda b: F.struct(*[F.trim(b[x]).alias(y) for x, y in names.items()], b["dist"].alias("dist"))
    lists = [F.transform(F.coalesce(F.col(f"`{x}`.bond"), F.array()), bond).alias(y) for x, y in _LISTS.items()]

    def molecule(m):
        plain = [m[c].alias(c) for c in ("id", "chain_id", "class", "symop", "symop_no", "int_natoms", "int_nres", "int_area", "int_solv_en", "pvalue")]
        cell = F.array(*[F.coalesce(m[f"cell_{k}"], F.lit(0)) for k in "ijk"]).alias("cell")
        found = [F.filter(F.coalesce(m["residues"]["residue"], F.array()), lambda r: r["bsa"] != 0).alias("residues")] if residues else []
        return F.struct(*plain, *_placed(m), cell, *found)

    molecules = F.transform(F.coalesce("molecule", F.array()), molecule).alias("molecules")
    return d.select("id", "type", F.coalesce("n_occ", F.lit(1)).alias("n_occ"), "int_area", "int_solv_en", "pvalue", "stab_en", "css", *lists, molecules, F.col("_metadata.file_path").alias("source"))


def read_assemblies_xml(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(entries, assemblies) of the original engine's multimer XML: pdb_id, total_asm and source by file; a row for each assembly.

    A file without any assembly is an entry with none: that is an answer, not an error."""
    schema = f"pdb_entry struct<pdb_code: string, total_asm: int>, asm_set array<struct<ser_no: int, assembly: array<struct<{_ASSEMBLY}>>>>, total_asm int, pdb_code string"
    text = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.from_xml("value", schema).alias("x"))
    entry = lambda c: F.coalesce(F.col(f"x.pdb_entry.{c}"), F.col(f"x.{c}"))
    entries = text.select("source", F.lower(F.trim(entry("pdb_code"))).alias("pdb_id"), F.coalesce(entry("total_asm"), F.lit(0)).alias("total_asm"))
    sets = text.select("source", F.lower(F.trim(entry("pdb_code"))).alias("pdb_id"), F.explode("x.asm_set").alias("s"))
    d = sets.select("source", "pdb_id", F.coalesce("s.ser_no", F.lit(0)).alias("set_no"), F.explode("s.assembly").alias("a"))
    molecules = F.transform(F.coalesce("a.molecule", F.array()), lambda m: F.struct(m["chain_id"].alias("chain_id"), *_placed(m)))
    number = lambda c, least: F.coalesce(F.col(f"a.{c}"), F.lit(least))
    plain = [F.col(f"a.{c}").alias(c) for c in ("formula", "composition", "diss_energy", "entropy", "diss_area", "int_energy")]
    counts = [number(c, 0).alias(c) for c in ("id", "size", "mmsize", "n_diss")]
    score = F.array_join(F.filter(F.split(F.coalesce("a.score", F.lit("")), r"\s+"), lambda w: w != ""), " ")
    return entries, d.select("source", "pdb_id", "set_no", *counts, *plain, number("symNumber", 1).alias("symmetry_number"), number("R350", 0).alias("r350"), score.alias("score"), molecules.alias("molecules"))


def identity_interfaces(interfaces: DataFrame, molecules: str = "molecules", symop: str = "symop") -> DataFrame:
    """Interfaces of exactly two molecules, neither moved."""
    m = F.col(molecules)
    return interfaces.where((F.size(m) == 2) & F.forall(m, lambda x: F.lower(F.regexp_replace(x[symop], " ", "")) == "x,y,z"))


def read_assembly_json(spark: SparkSession, *paths: str) -> DataFrame:
    """Interfaces of assembly documents, flat: one row each with its assembly's totals."""
    d = spark.read.option("multiLine", "true").json(list(paths)).select("assembly.*")
    top = [c for c in d.columns if c != "interfaces"]
    return d.select(*[F.col(c).alias(f"assembly_{c}") for c in top], F.explode("interfaces").alias("i")).select(*[f"assembly_{c}" for c in top], "i.*")
