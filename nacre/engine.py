"""One entry point: read structures of any format, analyse them, and see the results as DataFrames or SQL views."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session, sinks
from .operators import report
from .plans.analysis import Analysis
from .sources import cif, other, pdb

#: Analysis tables that are offered as views.
VIEWS = ["molecules", "surface", "totals", "contacts", "classes", "contact_map", "interfaces", "residues", "population", "dissociation", "summary"]


class StructureEngine:
    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or session.build()

    def read(self, *paths: str) -> tuple[DataFrame, DataFrame]:
        """(atoms, structures) of PDB and mmCIF files alike, by their suffixes."""
        files = pdb.read_files(self.spark, *paths)
        lines = pdb.lines_of(files.where(~pdb.is_cif_path("path")))
        atoms = pdb.number_atoms(pdb.select_altlocs(pdb.parse_atoms(lines)))
        structures = lines.select("structure_id").distinct().join(pdb.structures_of(lines), "structure_id", "left")
        more, others = cif.from_text(files.where(pdb.is_cif_path("path")))
        return atoms.unionByName(more), structures.unionByName(others)

    def read_each(self, *paths: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(atoms, structures, errors): a file that cannot be read is a row of errors (structure_id, path, error), the others go on.

        Files without an atom and PDB records that cannot be read are found in one pass over the lines; mmCIF files are read apart, those
        without atoms are errors too."""
        files = pdb.read_files(self.spark, *paths)
        lines = pdb.lines_of(files.where(~pdb.is_cif_path("path")))
        parsed = session.durable(pdb.parse_atoms(lines, strict=False))
        bad = pdb.errors_of(parsed)
        atoms = pdb.number_atoms(pdb.select_altlocs(parsed.join(bad.select("structure_id"), "structure_id", "left_anti")))
        more, others = cif.from_text(files.where(pdb.is_cif_path("path")))
        atoms = session.durable(atoms.unionByName(more, allowMissingColumns=True))
        structures = lines.select("structure_id").distinct().join(pdb.structures_of(lines), "structure_id", "left").unionByName(others)
        met = atoms.select("structure_id").distinct().withColumn("met", F.lit(True))
        errors = files.select("structure_id", "path").join(bad, "structure_id", "left").join(met, "structure_id", "left").where("met IS NULL")
        return atoms, structures.join(met.select("structure_id"), "structure_id", "left_semi"), errors.select("structure_id", "path", F.coalesce("error", F.lit("no atoms")).alias("error"))

    def analyze_many(self, *paths: str, **options) -> DataFrame:
        """One row for each file, in the order of their paths: its totals, or the error that kept it from being analysed."""
        atoms, structures, errors = self.read_each(*paths)
        done = Analysis(atoms, structures, **options).summary.withColumn("error", F.lit(None).cast("string"))
        paths_of = pdb.read_files(self.spark, *paths).select("structure_id", "path")
        failed = errors.select("structure_id", "error")
        return paths_of.join(done.unionByName(failed, allowMissingColumns=True), "structure_id").orderBy("path")

    def analyze(self, *paths: str, **options) -> Analysis:
        atoms, structures = self.read(*paths)
        return Analysis(atoms, structures, **options)

    def register_views(self, analysis: Analysis, prefix: str = "") -> list[str]:
        """Temporary views of the analysis tables; they run when queried."""
        for name in VIEWS:
            getattr(analysis, name).createOrReplaceTempView(prefix + name)
        return [prefix + n for n in VIEWS]

    def interface_between(self, analysis: Analysis, chain_1: str, chain_2: str) -> DataFrame:
        pair = F.array_sort(F.array("chain_1", "chain_2"))
        return analysis.interfaces.where(pair == F.array(*[F.lit(c) for c in sorted((chain_1, chain_2))]))

    def largest(self, analysis: Analysis, n: int | None = None) -> DataFrame:
        d = analysis.interfaces.orderBy(F.desc("interface_area"), "structure_id", "interface_id")
        return d if n is None else d.limit(n)

    def filter_by_pae(self, analysis: Analysis, interfaces: DataFrame, *paths: str, most: float = 10.0) -> DataFrame:
        """Interfaces with a mean aligned error up to `most`, and those without one."""
        _, matrix = other.read_pae(self.spark, *paths)
        return report.filter_by_score(interfaces, report.pae_scores(analysis.contacts, analysis.assigned, matrix), "pae", most=most)

    def filter_by_iptm(self, interfaces: DataFrame, *paths: str, least: float = 0.8) -> DataFrame:
        """Interfaces of models whose ipTM reaches `least`, and of those that state none: an unsure model has no interface to trust."""
        scores, _ = other.read_pae(self.spark, *paths)
        unsure = scores.where(F.col("iptm") < least).select("structure_id")
        return interfaces.join(unsure, "structure_id", "left_anti")

    def has_plddt(self, analysis: Analysis) -> DataFrame:
        """structure_id and has_plddt: whether B factors vary at all, as confidences do."""
        return analysis.assigned.groupBy("structure_id").agg((F.min("bfactor") < F.max("bfactor")).alias("has_plddt"))

    def filter_by_plddt(self, analysis: Analysis, interfaces: DataFrame, least: float = 70.0) -> DataFrame:
        atoms = report.check_confidence(analysis.assigned)
        return report.filter_by_score(interfaces, report.interface_confidence(analysis.faces, atoms), "plddt", least=least)


def main(args: list[str] | None = None) -> None:
    """python -m nacre.engine structures/ --out results/: interfaces as Parquet and documents as JSON text."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("paths", nargs="+")
    p.add_argument("--out", required=True)
    p.add_argument("--cutoff", type=float, default=5.0)
    p.add_argument("--interaction-cutoff", type=float)
    p.add_argument("--probe", type=float, default=1.4)
    p.add_argument("--points", type=int, default=480)
    p.add_argument("--ligand-mode", choices=["separate", "merge"], default="separate")
    p.add_argument("--keep-water", action="store_true")
    p.add_argument("--min-css", type=float)
    p.add_argument("--symmetry", choices=["none", "crystal"], default="none")
    p.add_argument("--predict-assemblies", action="store_true")
    o = p.parse_args(args)
    engine = StructureEngine()
    a = engine.analyze(*o.paths, cutoff=o.cutoff, interaction_cutoff=o.interaction_cutoff, probe=o.probe, points=o.points, ligand_mode=o.ligand_mode, exclude_water=not o.keep_water, min_css=o.min_css, symmetry=o.symmetry)
    a.interfaces.write.mode("overwrite").parquet(f"{o.out}/interfaces")
    a.contact_map.write.mode("overwrite").parquet(f"{o.out}/contact_map")
    a.residues.write.mode("overwrite").parquet(f"{o.out}/residues")
    sinks.write_documents(sinks.interface_documents(a.interfaces, a.contacts, a.summary, a.contact_map), f"{o.out}/documents")
    if o.predict_assemblies:
        a.assemblies.write.mode("overwrite").parquet(f"{o.out}/assemblies")
    print(json.dumps({"interfaces": a.interfaces.count()}))
    a.release()


if __name__ == "__main__":
    main()
