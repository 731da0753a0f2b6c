"""Documents, scripts and tables written from analysis results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["structure_id", "molecule_1", "molecule_2"]


def bond_tables(contacts: DataFrame) -> DataFrame:
    """For each interface and kind of bond, parallel lists of its atoms and distances, closest first."""
    kinds = contacts.select(*PAIR, F.explode("bond_types").alias("kind"), F.struct("distance", *[F.col(f"{s}_{c}").alias(f"{n}_{k}") for k, s in ((1, "a"), (2, "b")) for c, n in (("auth_asym_id", "chain"), ("res_name", "residue"), ("res_seq", "seq"), ("icode", "icode"), ("atom_name", "atom"))]).alias("b"))
    g = kinds.groupBy(*PAIR, "kind").agg(F.sort_array(F.collect_list("b")).alias("b"))
    names = ["distance", *[f"{n}_{k}" for k in (1, 2) for n in ("chain", "residue", "seq", "icode", "atom")]]
    lists = F.struct(*[F.col(f"b.{n}").alias(n) for n in names])
    return g.select(*PAIR, "kind", lists.alias("bonds")).groupBy(*PAIR).pivot("kind", ["hbond", "salt_bridge", "disulfide", "covalent"]).agg(F.first("bonds"))


def interface_documents(interfaces: DataFrame, contacts: DataFrame, summary: DataFrame, contact_map: DataFrame | None = None) -> DataFrame:
    """structure_id and document: totals and one entry per interface, keys without a value left out."""
    d = interfaces.join(bond_tables(contacts), PAIR, "left")
    if contact_map is not None:
        m = contact_map.groupBy(*PAIR).agg(F.collect_list(F.struct(*[c for c in contact_map.columns if c not in PAIR])).alias("interface_contact_map"))
        d = d.join(m, PAIR, "left")
    entry = F.struct("interface_id", *[c for c in d.columns if c not in ("structure_id", "interface_id")])
    # Sorted by id alone: entries hold maps, which have no order.
    in_order = F.array_sort(F.collect_list(entry), lambda p, q: p["interface_id"] - q["interface_id"])
    entries = d.groupBy("structure_id").agg(in_order.alias("interfaces"))
    s = summary.join(entries, "structure_id", "left")
    body = F.to_json(F.struct(F.struct(*[c for c in s.columns]).alias("assembly")), {"ignoreNullFields": "true"})
    return s.select("structure_id", body.alias("document"))


def assembly_documents(summary: DataFrame, assemblies: DataFrame | None = None) -> DataFrame:
    s = summary
    if assemblies is not None:
        s = s.join(assemblies.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in assemblies.columns if c not in ("structure_id", "rank")]))).alias("predicted_assemblies")), "structure_id", "left")
    return s.select("structure_id", F.to_json(F.struct(F.struct(*s.columns).alias("assembly")), {"ignoreNullFields": "true"}).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One folder per structure, each with its document as text; written by all executors."""
    documents.select("structure_id", F.col("document").alias("value")).write.mode("overwrite").partitionBy("structure_id").text(path)


def colour_script(residues: DataFrame) -> DataFrame:
    """PyMOL commands that colour interface residues from blue over white to red by buried area."""
    from pyspark.sql import Window as W

    w = W.partitionBy("structure_id")
    t = (F.col("bsa") - F.min("bsa").over(w)) / F.greatest(F.max("bsa").over(w) - F.min("bsa").over(w), F.lit(1e-9))
    up, down = F.least(t * 2, F.lit(1.0)), F.least((1 - t) * 2, F.lit(1.0))
    two = lambda x: F.lpad(F.hex(F.round(x * 255).cast("int")), 2, "0")
    line = F.concat(F.lit("color 0x"), two(up), two(F.least(up, down)), two(down), F.lit(", chain "), "auth_asym_id", F.lit(" and resi "), F.col("res_seq").cast("string"))
    d = residues.select("structure_id", F.struct("auth_asym_id", "res_seq", line.alias("l")).alias("l"))
    return d.groupBy("structure_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["l"]), "\n").alias("script"))


def pdb_text(atoms: DataFrame) -> DataFrame:
    """Atoms as PDB records, in order, one text per structure."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.rpad("atom_name", 3, " "))).otherwise(F.col("atom_name"))
    line = F.format_string("%-6s%5d %4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", "group", (F.col("atom_id") + 1) % 100_000, name, "altloc", "res_name", F.substring("chain_id", 1, 1), "res_seq", F.when(F.col("icode") == "", " ").otherwise(F.col("icode")), "x", "y", "z", "occupancy", "bfactor", "element")
    g = atoms.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct("atom_id", line.alias("l")))).alias("ls"))
    return g.select("structure_id", F.concat(F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\nEND\n")).alias("text"))
