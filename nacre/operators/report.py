"""Digests, confidence and comparison of interfaces as views over the analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chem, scalars
from .spatial import range_join

PAIR = ["structure_id", "molecule_1", "molecule_2"]


def pair_proximity(atoms: DataFrame, first_reach: float = 8.0, keys: tuple[str, ...] = ("structure_id",)) -> DataFrame:
    """Nearest distance of every pair of molecules.

    Pairs with atoms within first_reach are settled by a grid join; the few others compare molecules' atoms outright, by
    which time only pairs of molecules far apart are left."""
    keys = list(keys)
    d = atoms.where("molecule_id IS NOT NULL").select(*keys, "molecule_id", "x", "y", "z")
    near = range_join(d, d, first_reach, keys, condition=F.col("a_molecule_id") < F.col("b_molecule_id"))
    near = near.groupBy(*keys, F.col("a_molecule_id").alias("molecule_1"), F.col("b_molecule_id").alias("molecule_2")).agg(F.min("distance").alias("nearest"))
    m = d.select(*keys, "molecule_id").distinct()
    pairs = m.withColumnRenamed("molecule_id", "molecule_1").join(m.withColumnRenamed("molecule_id", "molecule_2"), keys).where("molecule_1 < molecule_2")
    far = pairs.join(near, [*keys, "molecule_1", "molecule_2"], "left_anti")
    for k in (1, 2):
        far = far.join(d.withColumnsRenamed({"molecule_id": f"molecule_{k}", "x": f"x{k}", "y": f"y{k}", "z": f"z{k}"}), [*keys, f"molecule_{k}"])
    d2 = sum(((F.col(f"{x}1") - F.col(f"{x}2")) * (F.col(f"{x}1") - F.col(f"{x}2")) for x in "yz"), (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")))
    return near.unionByName(far.groupBy(*keys, "molecule_1", "molecule_2").agg(F.sqrt(F.min(d2)).alias("nearest")))


def model_confidence(atoms: DataFrame, by: list[str]) -> DataFrame:
    """Mean of residues' mean B factors (pLDDT of predicted models) over groups."""
    key = list(dict.fromkeys([*by, "auth_asym_id", "res_seq"]))
    return atoms.groupBy(*key).agg(F.avg("bfactor").alias("b")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("plddt"))


def check_confidence(atoms: DataFrame) -> DataFrame:
    """`atoms`, or an error for structures whose B factors are all equal: those carry no confidence."""
    flat = F.min("bfactor").over(W.partitionBy("structure_id")) == F.max("bfactor").over(W.partitionBy("structure_id"))
    return atoms.withColumn("_flat", F.when(flat, F.raise_error(F.concat(F.lit("constant B factors in "), "structure_id")).cast("boolean"))).where("_flat IS NULL").drop("_flat")


def interface_confidence(faces: DataFrame, atoms: DataFrame) -> DataFrame:
    """Mean confidence of each interface's residues."""
    r = atoms.groupBy("structure_id", "auth_asym_id", "res_seq", "icode").agg(F.avg("bfactor").alias("b"))
    key = ["structure_id", "auth_asym_id", "res_seq", "icode"]
    of = faces.join(atoms.select("structure_id", "atom_id", "auth_asym_id", "res_seq", "icode"), ["structure_id", "atom_id"]).select(*PAIR, "auth_asym_id", "res_seq", "icode").distinct()
    return of.join(r, key).groupBy(*PAIR).agg(F.avg("b").alias("plddt"))


def residue_index(atoms: DataFrame) -> DataFrame:
    """Index from 0 of each residue as first met in the file: the rows and columns of an error matrix."""
    r = atoms.groupBy("structure_id", "auth_asym_id", "res_seq", "icode").agg(F.min("atom_id").alias("first"))
    return r.withColumn("index", F.row_number().over(W.partitionBy("structure_id").orderBy("first")) - 1).drop("first")


def with_residue_index(atoms: DataFrame) -> DataFrame:
    """`atoms` with the index of their residues."""
    return atoms.join(residue_index(atoms), ["structure_id", "auth_asym_id", "res_seq", "icode"])


def pae_scores(contacts: DataFrame, atoms: DataFrame, pae) -> DataFrame:
    """Mean aligned error of each interface over its distinct residue pairs. pae: structure_id, i, j, pae, or a function that gives
    the error as a Column of the Columns i and j, where no matrix has to be written out.

    Contacts of atoms that have their residues' index (a_index, b_index) are taken as they are; for others it is joined to each."""
    d = contacts
    if "a_index" not in d.columns:
        index = residue_index(atoms)
        for s in "ab":
            d = d.join(index.select("structure_id", F.col("auth_asym_id").alias(f"{s}_auth_asym_id"), F.col("res_seq").alias(f"{s}_res_seq"), F.col("icode").alias(f"{s}_icode"), F.col("index").alias(f"{s}_index")), ["structure_id", f"{s}_auth_asym_id", f"{s}_res_seq", f"{s}_icode"])
    pairs = d.select(*PAIR, F.col("a_index").alias("i"), F.col("b_index").alias("j")).distinct()
    pairs = pairs.withColumn("pae", pae(F.col("i"), F.col("j"))) if callable(pae) else pairs.join(pae, ["structure_id", "i", "j"])
    return pairs.groupBy(*PAIR).agg(F.avg("pae").alias("pae"))


def filter_by_score(interfaces: DataFrame, scores: DataFrame, column: str, most: float | None = None, least: float | None = None) -> DataFrame:
    """Interfaces within the bound; those without a score stay. Filters compose: each works on what the last one left."""
    d = interfaces.join(scores.select(*PAIR, column), PAIR, "left")
    ok = F.col(column).isNull()
    if most is not None:
        ok = ok | (F.col(column) <= most)
    if least is not None:
        ok = ok | (F.col(column) >= least)
    return d.where(ok)


def weight_by_confidence(interfaces: DataFrame, pae: str | None = None, plddt: str | None = None, pae_threshold: float = 10, plddt_threshold: float = 50) -> DataFrame:
    """Energies and significance scaled down where the model is doubtful."""
    w = scalars.confidence_weight(pae, plddt, pae_threshold, plddt_threshold)
    d = interfaces.withColumn("confidence_weight", w)
    return d.withColumns({c: F.col(c) * F.col("confidence_weight") for c in ("solvation_energy", "solvation_energy_apolar", "solvation_energy_polar", "stabilization_energy", "css")})


def hot_spots(residues: DataFrame, by: str = "bsa", n: int = 10) -> DataFrame:
    """Residues that bury most, or gain most, over all their interfaces: top n of each structure."""
    g = residues.groupBy("structure_id", "auth_asym_id", "res_seq", "residue").agg(F.bround(F.sum("bsa"), 2).alias("bsa"), F.bround(F.sum("solvation_energy"), 4).alias("solvation_energy"), F.sort_array(F.collect_set("interface_id")).alias("interfaces"))
    order = F.desc("bsa") if by == "bsa" else F.asc("solvation_energy")
    return g.withColumn("rank", F.row_number().over(W.partitionBy("structure_id").orderBy(order, "auth_asym_id", "res_seq"))).where(F.col("rank") <= n)


def sequences(atoms: DataFrame, keys: tuple[str, ...] = ("structure_id",)) -> DataFrame:
    """One-letter sequence of each chain, in residue order."""
    r = atoms.groupBy(*keys, F.col("auth_asym_id").alias("chain"), "res_seq", "icode").agg(F.min_by("res_name", "atom_id").alias("res_name"))
    item = F.struct("res_seq", "icode", chem.one_letter("res_name").alias("x"))
    return r.groupBy(*keys, "chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda s: s["x"]), "").alias("sequence"))


def group_digest(interfaces: DataFrame, residues: DataFrame, group1: list[str], group2: list[str]) -> tuple[DataFrame, DataFrame]:
    """(totals, residues) of the interface between two groups of chains: pairs with one label in each.

    A residue met in several pairs keeps its largest asa and adds up the rest; residues that bury nothing are left out."""
    if set(group1) & set(group2):
        raise ValueError("the groups share chains")
    across = (F.col("chain_1").isin(group1) & F.col("chain_2").isin(group2)) | (F.col("chain_1").isin(group2) & F.col("chain_2").isin(group1))
    pairs = interfaces.where(across)
    totals = pairs.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.bround(F.sum("interface_area"), 2).alias("area"), *[F.bround(F.sum(c), 2).alias(c) for c in ("solvation_energy", "solvation_energy_apolar", "solvation_energy_polar", "stabilization_energy")], *[F.sum(c).alias(c) for c in ("number_hydrogen_bonds", "number_salt_bridges", "number_disulfide_bonds")], F.min("p_value").alias("min_p_value"))
    r = residues.join(pairs.select(*PAIR), PAIR, "left_semi").where("bsa > 0")
    r = r.withColumn("side", F.when(F.col("auth_asym_id").isin(group1), 1).otherwise(2))
    merged = r.groupBy("structure_id", "side", "auth_asym_id", "res_seq", "icode").agg(F.first("residue").alias("residue"), F.max("asa").alias("asa"), F.bround(F.sum("bsa"), 2).alias("bsa"), F.bround(F.sum("solvation_energy"), 4).alias("solvation_energy"))
    return totals, merged


def residue_matrix(merged: DataFrame, complexes: list[str] | None = None) -> DataFrame:
    """Residues (r) against complexes: a column of buried area for each of `complexes`, 0 where one does not touch a residue.

    Without names there is one map of areas by complex instead, so that no names come to the driver, however many there are."""
    name = F.concat_ws(":", "auth_asym_id", F.col("res_seq").cast("string"), "icode")
    d = merged.withColumn("r", name)
    if complexes is not None:
        return d.groupBy("r").pivot("structure_id", complexes).agg(F.sum("bsa")).fillna(0)
    sums = d.groupBy("r", "structure_id").agg(F.sum("bsa").alias("bsa"))
    return sums.groupBy("r").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("structure_id", "bsa")))).alias("bsa"))


def interpretation(totals: DataFrame) -> DataFrame:
    """`totals` with remarks: what the numbers of an interface commonly mean."""
    bonds = 100 * F.col("number_hydrogen_bonds") / F.col("area")
    ratio = F.abs(F.col("solvation_energy_apolar")) / F.greatest(F.abs(F.col("solvation_energy_polar")), F.lit(1e-9))
    remarks = F.array_compact(F.array(
        F.when(F.col("area") < 400, "small interface").when(F.col("area") < 700, "interface of moderate size"), F.when((F.col("area") > 200) & (F.col("min_p_value") < 0.3), "specific: unusually hydrophobic").when((F.col("area") > 200) & (F.col("min_p_value") > 0.6), "no more hydrophobic than the rest of the surface"),
        F.when(ratio > 2, "mostly apolar gain"), F.when(bonds > 1.5, "dense in hydrogen bonds"), F.when(F.col("n_pairs") > 1, "sum over several chain pairs"),
    ))
    return totals.withColumn("remarks", remarks)


def results_sentence(totals: DataFrame) -> DataFrame:
    return totals.withColumn("sentence", F.format_string("The interface buries %.1f A^2 with a solvation gain of %.1f kcal/mol, %d hydrogen bonds and %d salt bridges.", "area", "solvation_energy", "number_hydrogen_bonds", "number_salt_bridges"))


def selection_script(merged: DataFrame, style: str = "pymol") -> DataFrame:
    """Selections of an interface's residues, as commands of two viewers."""
    one = F.concat(F.lit("/"), "auth_asym_id", F.lit(":"), F.col("res_seq").cast("string")) if style == "chimerax" else F.concat(F.lit("(chain "), "auth_asym_id", F.lit(" and resi "), F.col("res_seq").cast("string"), F.lit(")"))
    g = merged.groupBy("structure_id", "side").agg(F.array_join(F.array_sort(F.collect_set(one)), " " if style == "chimerax" else " or ").alias("s"))
    return g.select("structure_id", "side", F.concat(F.lit("select ") if style == "chimerax" else F.concat(F.lit("select side"), F.col("side").cast("string"), F.lit(", ")), "s").alias("command"))
