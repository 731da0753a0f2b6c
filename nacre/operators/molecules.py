"""Molecules of a structure: polymers by chain, ligands by residue; and which molecule each atom is of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chem, tables


def assign(atoms: DataFrame, structures: DataFrame | None = None, ligand_mode: str = "separate", exclude_water: bool = True) -> DataFrame:
    """`atoms` with molecule_id and the molecule's columns (class, chain label, type, ccd_id).

    separate: a chain's polymer atoms are one molecule, each other residue one of its own, named [CCD]chain:number. merge: a chain is one
    molecule, water excluded. Molecules are numbered from 0 in chain order, polymer first, then by code as first seen,
    number and insertion code, before water is left out (its atoms get no molecule)."""
    if ligand_mode not in ("separate", "merge"):
        raise ValueError(f"ligand_mode must be separate or merge, not {ligand_mode!r}")
    d = atoms
    if structures is not None:
        d = d.join(structures.select("structure_id", "polymer_residues"), "structure_id", "left")
    else:
        d = d.withColumn("polymer_residues", F.array().cast("array<string>"))
    code = F.upper(F.col("res_name"))
    d = d.withColumn("_poly", chem.is_polymer("res_name", "polymer_residues")).withColumn("_water", chem.is_water("res_name"))
    chain = W.partitionBy("structure_id", "chain_id")
    nucleic = code.isin(tables.NUCLEIC_ACIDS)
    if ligand_mode == "merge":
        d = d.withColumn("_any", F.max(F.when(~F.col("_water"), F.col("_poly").cast("int"))).over(chain)).withColumn("_other", F.max((F.col("_poly") & ~nucleic).cast("int")).over(chain))
        d = d.withColumn("_key", F.when(~F.col("_water"), F.struct(F.col("chain_order"), F.lit(0).alias("k"), F.lit(0).alias("c"), F.lit(0).alias("s"), F.lit("").alias("i"))))
        kind = F.when(F.col("_any") == 0, "Ligand").when(F.col("_other") == 1, "Protein").otherwise("NucleicAcid")
        label, type_, ccd = F.col("chain_id"), F.lit("chain"), F.lit(None).cast("string")
    else:
        d = d.withColumn("_other", F.max((F.col("_poly") & ~nucleic).cast("int")).over(chain))
        d = d.withColumn("_seen", F.min("atom_id").over(W.partitionBy("structure_id", "chain_id", "res_name")))
        zero = F.lit(0)
        d = d.withColumn("_key", F.struct(F.col("chain_order"), (~F.col("_poly")).cast("int").alias("k"), F.when(F.col("_poly"), zero).otherwise(F.col("_seen")).alias("c"), F.when(F.col("_poly"), zero).otherwise(F.col("auth_seq_id")).alias("s"), F.when(F.col("_poly"), "").otherwise(F.col("icode")).alias("i")))
        kind = F.when(~F.col("_poly"), "Ligand").when(F.col("_other") == 0, "NucleicAcid").otherwise("Protein")
        label = F.when(F.col("_poly"), F.col("chain_id")).otherwise(F.concat(F.lit("["), code, F.lit("]"), F.col("chain_id"), F.lit(":"), F.col("auth_seq_id").cast("string"), F.col("icode")))
        type_, ccd = F.when(F.col("_poly"), "polymer").otherwise("ligand"), F.when(~F.col("_poly"), code)
    d = d.withColumn("_no", F.dense_rank().over(W.partitionBy("structure_id").orderBy(F.col("_key").asc_nulls_last())) - 1)
    out = F.col("_key").isNotNull()
    if exclude_water and ligand_mode == "separate":
        out = out & ~(F.col("_water") & ~F.col("_poly"))
    put = lambda c: F.when(out, c)
    d = d.withColumn("molecule_id", put(F.col("_no"))).withColumn("molecule_class", put(kind)).withColumn("molecule_label", put(label)).withColumn("chain_type", put(type_)).withColumn("ccd_id", put(ccd))
    return d.drop(*[c for c in d.columns if c.startswith("_")], "polymer_residues")


def molecules_of(atoms: DataFrame) -> DataFrame:
    """One row per molecule: class, label, chain, residues and heavy atoms, mass."""
    heavy = chem.is_heavy("element")
    return atoms.where("molecule_id IS NOT NULL").groupBy("structure_id", "molecule_id").agg(
        F.first("molecule_class").alias("molecule_class"), F.first("molecule_label").alias("molecule_label"), F.first("chain_type").alias("chain_type"), F.first("ccd_id").alias("ccd_id"), F.first("auth_asym_id").alias("auth_asym_id"),
        F.count_distinct("res_seq", "icode").alias("n_residues"), F.count_if(heavy).alias("n_heavy_atoms"), F.sum(F.when(heavy, chem.mass("element"))).alias("mass"),
    )
