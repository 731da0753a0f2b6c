"""The whole analysis of structures as one set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chem, scalars
from ..operators import assembly as A
from ..operators import contacts as C
from ..operators import crystal as X
from ..operators import molecules as M
from ..operators import surface as S
from ..session import durable

PAIR = ["structure_id", "molecule_1", "molecule_2"]


@dataclass
class Analysis:
    """Interfaces of all structures of `atoms`, keyed by structure_id; every property is a DataFrame, built when asked for.

    Tables that several results need are computed when first asked for and kept in the checkpoint folder; release() forgets them. `assigned` atoms
    carry molecule_id, and is_asu where symmetry mates are among them."""

    atoms: DataFrame
    structures: DataFrame | None = None
    probe: float = S.PROBE
    points: int = S.POINTS
    cutoff: float = 5.0
    interaction_cutoff: float | None = None
    ligand_mode: str = "separate"
    exclude_water: bool = True
    min_css: float | None = None
    mode: str = "combined"
    symmetry: str = "none"

    def __post_init__(self):
        if self.mode not in ("energy", "contacts", "combined"):
            raise ValueError(f"mode must be energy, contacts or combined, not {self.mode!r}")
        if self.ligand_mode not in ("separate", "merge"):
            raise ValueError(f"ligand_mode must be separate or merge, not {self.ligand_mode!r}")
        if self.symmetry not in ("none", "crystal"):
            raise ValueError(f"symmetry must be none or crystal, not {self.symmetry!r}")

    def _hold(self, df: DataFrame) -> DataFrame:
        return durable(df)

    def release(self) -> None:
        """Forget all tables; their files go with them where the session cleans checkpoints."""
        for name, of in vars(type(self)).items():
            if isinstance(of, cached_property):
                vars(self).pop(name, None)

    @cached_property
    def assigned(self) -> DataFrame:
        if "molecule_id" in self.atoms.columns:
            return self._hold(self.atoms)
        atoms = X.expand(self.atoms, self.structures, exclude_water=self.exclude_water) if self.symmetry == "crystal" else self.atoms
        return self._hold(M.assign(atoms, self.structures, self.ligand_mode, self.exclude_water))

    @cached_property
    def molecules(self) -> DataFrame:
        return M.molecules_of(self.assigned)

    @cached_property
    def surface(self) -> DataFrame:
        return self._hold(S.atom_surface(self.assigned, self.probe, self.points))

    @cached_property
    def totals(self) -> DataFrame:
        return S.totals(self.surface)

    @cached_property
    def burial(self) -> DataFrame:
        return self._hold(self._asu(S.pair_burial(self.surface)))

    def _asu(self, pairs: DataFrame) -> DataFrame:
        """Pairs of which one molecule at least is of the asymmetric unit: all others are copies of such."""
        if "is_asu" not in self.assigned.columns:
            return pairs
        asu = self.assigned.where("is_asu AND molecule_id IS NOT NULL").select("structure_id", F.col("molecule_id").alias("m")).distinct()
        keep = pairs.select(*PAIR).distinct().join(asu, "structure_id").where("m = molecule_1 OR m = molecule_2").select(*PAIR).distinct()
        return pairs.join(keep, PAIR, "left_semi")

    @cached_property
    def contacts(self) -> DataFrame:
        return self._hold(C.with_bonds(self.assigned, self._asu(C.contacts(self.assigned, self.cutoff)), self.hydrogen_bonds))

    @cached_property
    def hydrogen_bonds(self) -> DataFrame:
        return self._hold(C.hydrogen_bonds(self.assigned, self.cutoff, self._asu))

    @cached_property
    def bond_counts(self) -> DataFrame:
        """PAIR, n_contacts, hb, sb, ss, other: counted as contacts are found, which are kept only if they are asked for."""
        return self._hold(C.bond_counts(self.assigned, self.cutoff, self._asu, self.hydrogen_bonds))

    @cached_property
    def classes(self) -> DataFrame:
        """Contacts at the map's own cutoff, with classes."""
        if self.interaction_cutoff in (None, self.cutoff):
            return self._hold(C.classified(self.assigned, self.contacts))
        pairs = self._asu(C.contacts(self.assigned, self.interaction_cutoff))
        bonds = self.contacts.where("hydrogen_bond").select(*PAIR, "a_atom_id", "b_atom_id", "hydrogen_bond")
        pairs = pairs.join(bonds, [*PAIR, "a_atom_id", "b_atom_id"], "left").withColumn("hydrogen_bond", F.coalesce("hydrogen_bond", F.lit(False)))
        return self._hold(C.classified(self.assigned, pairs))

    @cached_property
    def contact_map(self) -> DataFrame:
        return C.contact_map(self.classes)

    @cached_property
    def faces(self) -> DataFrame:
        """PAIR, molecule_id, atom_id of the interfaces' atoms: the buried ones, or where a side has none its atoms in contact."""
        buried = self.burial.select(*PAIR, "molecule_id", "atom_id")
        sides = self.bond_counts.select(*PAIR, F.explode(F.array("molecule_1", "molecule_2")).alias("molecule_id"))
        lacking = self._hold(sides.join(buried.select(*PAIR, "molecule_id").distinct(), [*PAIR, "molecule_id"], "left_anti"))
        some = lacking.select("structure_id", F.explode(F.array("molecule_1", "molecule_2")).alias("molecule_id")).distinct()
        near = C.contacts(self.assigned.join(some, ["structure_id", "molecule_id"], "left_semi"), self.cutoff).join(lacking.select(*PAIR).distinct(), PAIR, "left_semi")
        touching = near.select(*PAIR, F.explode(F.array(F.struct(F.col("molecule_1").alias("m"), F.col("a_atom_id").alias("a")), F.struct(F.col("molecule_2").alias("m"), F.col("b_atom_id").alias("a")))).alias("s")).select(*PAIR, F.col("s.m").alias("molecule_id"), F.col("s.a").alias("atom_id")).distinct()
        bare = touching.join(lacking, [*PAIR, "molecule_id"], "left_semi").select(*PAIR, "molecule_id", "atom_id")
        return buried.union(bare)

    @cached_property
    def _typed(self) -> DataFrame:
        d = chem.with_types(self.assigned.where(chem.is_heavy("element") & F.col("molecule_id").isNotNull()))
        return self._hold(d.select("structure_id", "atom_id", "molecule_id", "auth_asym_id", "res_seq", "icode", "res_name", "sigma", "fine_type", "solvation_class"))

    @cached_property
    def surface_moments(self) -> DataFrame:
        """Of each molecule's exposed atoms: total area, and its sums times sigma and sigma squared."""
        d = self.surface.where("molecule_id IS NOT NULL AND asa_alone > 0").join(self._typed.select("structure_id", "atom_id", "sigma"), ["structure_id", "atom_id"])
        return d.groupBy("structure_id", "molecule_id").agg(F.sum("asa_alone").alias("w"), F.sum(F.col("asa_alone") * F.col("sigma")).alias("ws"), F.sum(F.col("asa_alone") * F.col("sigma") * F.col("sigma")).alias("wss"))

    @cached_property
    def interfaces(self) -> DataFrame:
        """One row per interface: areas, energies, scores, counts. Pairs are kept that bury 0.01 or more, or touch."""
        b = self.burial.join(self._typed.select("structure_id", "atom_id", "sigma", "solvation_class"), ["structure_id", "atom_id"])
        e = F.col("sigma") * F.col("buried")
        apolar = chem.is_apolar_class("solvation_class")
        areas = b.groupBy(*PAIR).agg((F.sum("buried") / 2).alias("area"), F.sum("buried").alias("b1"), F.sum(F.col("buried") * F.col("buried")).alias("b2"), F.sum(e).alias("solv"), F.sum(F.when(apolar, e).otherwise(0.0)).alias("apolar"), F.sum(F.when(~apolar, e).otherwise(0.0)).alias("polar"))
        residues = self.faces.join(self._typed.select("structure_id", "atom_id", "auth_asym_id", "res_seq", "icode"), ["structure_id", "atom_id"]).groupBy(*PAIR).agg(F.count_distinct("molecule_id", "auth_asym_id", "res_seq", "icode").alias("number_interface_residues"))
        d = areas.join(self.bond_counts, PAIR, "full_outer").join(residues, PAIR, "left").fillna(0)
        d = d.where("area >= 0.01 OR n_contacts > 0")
        for k in (1, 2):
            m = self.surface_moments.select("structure_id", F.col("molecule_id").alias(f"molecule_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("w", "ws", "wss")])
            d = d.join(m, ["structure_id", f"molecule_{k}"], "left").fillna(0.0)
            n = self.molecules.select("structure_id", F.col("molecule_id").alias(f"molecule_{k}"), F.col("molecule_label").alias(f"chain_{k}"), F.col("molecule_class").alias(f"class_{k}"))
            d = d.join(n, ["structure_id", f"molecule_{k}"], "left")
        w = F.col("w_1") + F.col("w_2")
        mean = (F.col("ws_1") + F.col("ws_2")) / w
        var = (F.col("wss_1") + F.col("wss_2")) / w - mean * mean
        d = d.withColumn("mean_sigma", F.when(w > 0, mean)).withColumn("var_sigma", F.when(w > 0, F.greatest(var, F.lit(0.0)))).withColumn("z", scalars.p_score("solv", "b1", "b2", "mean_sigma", "var_sigma"))
        p = scalars.p_value("z")
        css = scalars.css("solv", "area")
        d = d.select(
            *PAIR, "chain_1", "chain_2", "class_1", "class_2",
            F.bround("area", 2).alias("interface_area"), F.bround("solv", 2).alias("solvation_energy"), F.bround("apolar", 2).alias("solvation_energy_apolar"), F.bround("polar", 2).alias("solvation_energy_polar"),
            F.bround(F.col("solv") + scalars.bond_energy("hb", "sb", "ss"), 2).alias("stabilization_energy"), F.bround(p, 3).alias("p_value"), F.bround(css, 3).alias("css"), "number_interface_residues",
            F.col("hb").alias("number_hydrogen_bonds"), F.col("sb").alias("number_salt_bridges"), F.col("ss").alias("number_disulfide_bonds"), F.lit(0).cast("long").alias("number_covalent_bonds"), F.col("other").alias("number_other_bonds"), F.lit(1).cast("long").alias("n_occurrences"),
        )
        if self.symmetry == "crystal":
            d = X.collapse_equivalent(d, self.placements)
        return self._hold(self._numbered(d))

    @cached_property
    def placements(self) -> DataFrame:
        return self._hold(X.molecule_placements(self.assigned))

    @cached_property
    def dissociation(self) -> DataFrame:
        """Cheapest dissociation of each structure as given."""
        return A.dissociation(self.interfaces, self.molecules)

    @cached_property
    def assemblies(self) -> DataFrame:
        """Assemblies that a crystal can form, ranked; needs symmetry="crystal"."""
        if self.symmetry != "crystal":
            raise ValueError("assemblies are predicted from crystal symmetry")
        return A.assemblies(self.interfaces, self.placements, self.molecules)

    @cached_property
    def summary(self) -> DataFrame:
        """One row per structure: surfaces, sums over interfaces, dissociation, formula."""
        sums = self.interfaces.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n_interfaces"), F.sum("interface_area").alias("dissociation_area"), F.sum("solvation_energy").alias("solvation_energy_gain"))
        d = self.totals.join(sums, "structure_id", "left").join(self.dissociation, "structure_id", "left").join(A.formula_of(self.molecules), "structure_id", "left")
        return d.fillna(0, ["n_interfaces", "dissociation_area", "solvation_energy_gain", "dissociation_energy", "entropy"])

    def _numbered(self, d: DataFrame) -> DataFrame:
        """Interfaces of enough significance, numbered from 1 in the order of their molecules."""
        if self.min_css is not None:
            d = d.where(F.col("css") >= self.min_css)
        return d.withColumn("interface_id", F.row_number().over(W.partitionBy("structure_id").orderBy("molecule_1", "molecule_2")))

    @cached_property
    def residues(self) -> DataFrame:
        """Residues of the interfaces, with asa, bsa and solvation energy."""
        d = S.residue_surface(self.assigned.where(chem.is_heavy("element")), self.surface, self.burial, self.faces)
        return d.join(self.interfaces.select(*PAIR, "interface_id"), PAIR)

    @cached_property
    def population(self) -> DataFrame:
        return C.population(self.classes)

    @cached_property
    def calibration(self) -> DataFrame:
        """Per interface: buried area by class and fine type, exposed area by both, and the sums of burial."""
        b = self.burial.join(self._typed.select("structure_id", "atom_id", "fine_type", "solvation_class"), ["structure_id", "atom_id"])
        s = self.surface.where("molecule_id IS NOT NULL").join(self._typed.select("structure_id", "atom_id", "fine_type", "solvation_class"), ["structure_id", "atom_id"])

        def as_map(d: DataFrame, keys: list[str], of: str, value: str, name: str) -> DataFrame:
            g = d.groupBy(*keys, of).agg(F.sum(value).alias("v"))
            return g.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(of, "v")))).alias(name))

        pairs = self.interfaces.select(*PAIR)
        exposed = pairs.select(*PAIR, F.explode(F.array("molecule_1", "molecule_2")).alias("molecule_id")).join(s, ["structure_id", "molecule_id"])
        out = b.groupBy(*PAIR).agg(F.sum("buried").alias("b_sum"), F.sum(F.col("buried") * F.col("buried")).alias("b_sq_sum"), F.count(F.lit(1)).alias("n_buried_atoms"))
        for of, short in (("solvation_class", "class"), ("fine_type", "type")):
            out = out.join(as_map(b, PAIR, of, "buried", f"bsa_by_{short}"), PAIR, "left").join(as_map(exposed, PAIR, of, "asa_alone", f"surf_asa_by_{short}"), PAIR, "left")
        return pairs.join(out, PAIR, "left")
