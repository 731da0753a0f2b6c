"""mmCIF files as the same tables as PDB's: a tokenizer over whole files, everything after it in DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem
from ..session import ship
from .pdb import is_cif_path, number_atoms, read_files, select_altlocs

_TOKEN = re.compile(r"""(?:^;(.*?)\n;(?=\s|$))|'((?:[^'\n]|'(?!\s|$))*)'(?=\s|$)|"((?:[^"\n]|"(?!\s|$))*)"(?=\s|$)|(\#[^\n]*)|(\S+)""", re.M | re.S)

#: Item of _atom_site and its column; defaults follow in read_cif.
_SITE = "group_PDB type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv auth_seq_id auth_comp_id auth_asym_id auth_atom_id pdbx_PDB_ins_code pdbx_PDB_model_num".split()
#: Single items that structures are made of; space groups are looked for under either name.
_ITEMS = "_entry.id _symmetry.space_group_name_h-m _space_group.name_h-m_alt _exptl.space_group_type _cell.length_a _cell.length_b _cell.length_c _cell.angle_alpha _cell.angle_beta _cell.angle_gamma _cell.z_pdbx".split()


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, quoted) of a file; comments left out."""
    for m in _TOKEN.finditer(text):
        field, single, double, comment, bare = m.groups()
        if comment is not None:
            continue
        quoted = bare is None
        yield (bare if bare is not None else field if field is not None else single if single is not None else double), quoted


def parse(text: str) -> dict[str, list[str | None]]:
    """Columns of values by lower-case tag; `.` and `?` are null."""
    out: dict[str, list[str | None]] = {}
    value = lambda t, q: None if not q and t in (".", "?") else t
    loop: list[str] = []
    tag, in_loop, heads, k = None, False, False, 0
    for t, quoted in tokens(text):
        low = t.lower()
        if not quoted and low.startswith(("data_", "save_", "global_", "stop_")):
            in_loop, tag = False, None
        elif not quoted and low == "loop_":
            loop, in_loop, heads, k = [], True, True, 0
        elif not quoted and t.startswith("_"):
            if in_loop and heads:
                loop.append(low)
                out.setdefault(low, [])
            else:
                in_loop, tag = False, low
        elif in_loop and loop:
            heads = False
            out[loop[k % len(loop)]].append(value(t, quoted))
            k += 1
        elif tag is not None:
            out.setdefault(tag, []).append(value(t, quoted))
            tag = None
    return out


def read_cif(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(atoms, structures) of mmCIF files: first model, author names with label names where they lack."""
    files = read_files(spark, *paths).where(is_cif_path("path"))
    return from_text(files)


def from_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark = files.sparkSession
    ship(spark)

    def sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = parse(text)
                n = len(cols.get("_atom_site.cartn_x", []))
                values = [(cols.get(f"_atom_site.{c.lower()}", []) + [None] * n)[:n] for c in _SITE]
                yield pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), *[pa.array(v, pa.string()) for v in values]], ["structure_id", "line_no", *_SITE])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = parse(text)
                one = [next(iter(cols.get(i, [])), None) for i in _ITEMS]
                declared = next((cols[t] for t in ("_pdbx_poly_seq_scheme.mon_id", "_entity_poly_seq.mon_id") if cols.get(t)), [])
                rows.append((sid, *one, sorted({x.upper() for x in declared if x})))
            kinds = [pa.string()] * (1 + len(_ITEMS)) + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["structure_id", *[f"i{k}" for k in range(len(_ITEMS))], "declared"])

    raw = files.select("structure_id", "text")
    d = raw.mapInArrow(sites, "structure_id string, line_no int, " + ", ".join(f"`{c}` string" for c in _SITE))
    first = d.groupBy("structure_id").agg(F.min_by("pdbx_PDB_model_num", "line_no").alias("_model"))
    d = d.join(first, "structure_id").where(F.coalesce("pdbx_PDB_model_num", F.coalesce("_model", F.lit("1"))) == F.coalesce("_model", F.lit("1"))).where(F.col("group_PDB").isin("ATOM", "HETATM"))
    label_seq = F.col("label_seq_id").try_cast("int")
    auth_seq = F.coalesce(F.col("auth_seq_id").try_cast("int"), F.lit(0))
    chain = F.coalesce("auth_asym_id", "label_asym_id", F.lit(""))
    blank = F.raise_error(F.concat(F.col("structure_id"), F.lit(": blank element in atom site "), F.col("line_no").cast("string"))).cast("string")
    num = lambda c, default: F.coalesce(F.col(c).try_cast("double"), F.lit(default))
    d = d.select(
        "structure_id", "line_no", F.col("group_PDB").alias("group"), F.coalesce("auth_atom_id", "label_atom_id", F.lit("")).alias("atom_name"), F.coalesce("label_alt_id", F.lit(" ")).alias("altloc"),
        F.upper(F.coalesce("auth_comp_id", "label_comp_id", F.lit(""))).alias("res_name"), chain.alias("chain_id"), auth_seq.alias("res_seq"), F.coalesce("pdbx_PDB_ins_code", F.lit("")).alias("icode"),
        num("Cartn_x", 0.0).alias("x"), num("Cartn_y", 0.0).alias("y"), num("Cartn_z", 0.0).alias("z"), num("occupancy", 1.0).alias("occupancy"), num("B_iso_or_equiv", 0.0).alias("bfactor"), F.coalesce(F.upper("type_symbol"), blank).alias("element"),
        F.coalesce("label_asym_id", F.lit("")).alias("label_asym_id"), F.coalesce(label_seq, auth_seq).alias("label_seq_id"), F.upper(F.coalesce("label_comp_id", F.lit(""))).alias("label_comp_id"), chain.alias("auth_asym_id"), auth_seq.alias("auth_seq_id"), F.lit(None).cast("string").alias("problem"),
    )
    h = raw.mapInArrow(heads, "structure_id string, " + ", ".join(f"i{k} string" for k in range(len(_ITEMS))) + ", declared array<string>")
    cell = F.struct(*[F.col(f"i{k}").try_cast("double").alias(c) for k, c in zip(range(4, 10), ("a", "b", "c", "alpha", "beta", "gamma"), strict=True)], F.coalesce(F.col("i10").try_cast("int"), F.lit(1)).alias("z"))
    structures = h.select("structure_id", F.col("i0").alias("source"), F.coalesce("i1", "i2", "i3").alias("space_group"), cell.alias("cell"), F.filter("declared", lambda x: ~chem.is_water(x)).alias("polymer_residues"))
    return number_atoms(select_altlocs(d)), structures
