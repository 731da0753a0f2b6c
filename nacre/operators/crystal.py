"""Crystal symmetry: space-group operators in exact 1/24 units, copies around the asymmetric unit, equivalence of interfaces."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chem
from ..session import ship
from .spatial import range_join

UNIT = 24

# --- FIXED VALUES: generators of the space groups without mirrors, by their international symbols -----------------------
SPACE_GROUPS = """
P 1: x,y,z
P -1: -x,-y,-z
P 1 2 1: -x,y,-z
P 1 21 1: -x,y+1/2,-z
C 1 2 1: -x,y,-z
A 1 2 1: -x,y,-z
I 1 2 1: -x,y,-z
P 2 2 2: -x,-y,z; -x,y,-z
P 2 2 21: -x,-y,z+1/2; -x,y,-z+1/2
P 21 21 2: -x,-y,z; -x+1/2,y+1/2,-z
P 21 21 21: -x+1/2,-y,z+1/2; -x,y+1/2,-z+1/2
C 2 2 21: -x,-y,z+1/2; -x,y,-z+1/2
C 2 2 2: -x,-y,z; -x,y,-z
F 2 2 2: -x,-y,z; -x,y,-z
I 2 2 2: -x,-y,z; -x,y,-z
I 21 21 21: -x+1/2,-y,z+1/2; -x,y+1/2,-z+1/2
P 4: -y,x,z
P 41: -y,x,z+1/4
P 42: -y,x,z+1/2
P 43: -y,x,z+3/4
I 4: -y,x,z
I 41: -y,x+1/2,z+1/4
P 4 2 2: -y,x,z; -x,y,-z
P 4 21 2: -y+1/2,x+1/2,z; -x+1/2,y+1/2,-z
P 41 2 2: -y,x,z+1/4; -x,y,-z
P 41 21 2: -y+1/2,x+1/2,z+1/4; -x+1/2,y+1/2,-z+1/4
P 42 2 2: -y,x,z+1/2; -x,y,-z
P 42 21 2: -y+1/2,x+1/2,z+1/2; -x+1/2,y+1/2,-z+1/2
P 43 2 2: -y,x,z+3/4; -x,y,-z
P 43 21 2: -y+1/2,x+1/2,z+3/4; -x+1/2,y+1/2,-z+3/4
I 4 2 2: -y,x,z; -x,y,-z
I 41 2 2: -y,x+1/2,z+1/4; -x+1/2,y,-z+3/4
P 3: -y,x-y,z
P 31: -y,x-y,z+1/3
P 32: -y,x-y,z+2/3
H 3: -y,x-y,z
P 3 1 2: -y,x-y,z; -y,-x,-z
P 3 2 1: -y,x-y,z; y,x,-z
P 31 1 2: -y,x-y,z+1/3; -y,-x,-z+2/3
P 31 2 1: -y,x-y,z+1/3; y,x,-z
P 32 1 2: -y,x-y,z+2/3; -y,-x,-z+1/3
P 32 2 1: -y,x-y,z+2/3; y,x,-z
H 3 2: -y,x-y,z; y,x,-z
P 6: x-y,x,z
P 61: x-y,x,z+1/6
P 65: x-y,x,z+5/6
P 62: x-y,x,z+1/3
P 64: x-y,x,z+2/3
P 63: x-y,x,z+1/2
P 6 2 2: x-y,x,z; y,x,-z
P 61 2 2: x-y,x,z+1/6; y,x,-z+1/3
P 65 2 2: x-y,x,z+5/6; y,x,-z+2/3
P 62 2 2: x-y,x,z+1/3; y,x,-z+2/3
P 64 2 2: x-y,x,z+2/3; y,x,-z+1/3
P 63 2 2: x-y,x,z+1/2; y,x,-z
P 2 3: -x,-y,z; -x,y,-z; z,x,y
F 2 3: -x,-y,z; -x,y,-z; z,x,y
I 2 3: -x,-y,z; -x,y,-z; z,x,y
P 21 3: -x+1/2,-y,z+1/2; -x,y+1/2,-z+1/2; z,x,y
I 21 3: -x+1/2,-y,z+1/2; -x,y+1/2,-z+1/2; z,x,y
P 4 3 2: -x,-y,z; -x,y,-z; z,x,y; y,x,-z
P 42 3 2: -x,-y,z; -x,y,-z; z,x,y; y+1/2,x+1/2,-z+1/2
F 4 3 2: -x,-y,z; -x,y,-z; z,x,y; y,x,-z
F 41 3 2: -x,-y+1/2,z+1/2; -x+1/2,y+1/2,-z; z,x,y; y+3/4,x+1/4,-z+3/4
I 4 3 2: -x,-y,z; -x,y,-z; z,x,y; y,x,-z
P 43 3 2: -x+1/2,-y,z+1/2; -x,y+1/2,-z+1/2; z,x,y; y+1/4,x+3/4,-z+3/4
P 41 3 2: -x+1/2,-y,z+1/2; -x,y+1/2,-z+1/2; z,x,y; y+3/4,x+1/4,-z+1/4
I 41 3 2: -x+1/2,-y,z+1/2; -x,y+1/2,-z+1/2; z,x,y; y+3/4,x+1/4,-z+1/4
"""
CENTRINGS = {"C": ["1/2 1/2 0"], "A": ["0 1/2 1/2"], "I": ["1/2 1/2 1/2"], "F": ["0 1/2 1/2", "1/2 0 1/2", "1/2 1/2 0"], "H": ["2/3 1/3 1/3", "1/3 2/3 2/3"]}
#: Other names of the same settings.
ALIASES = {"R 3": "H 3", "R 3 2": "H 3 2", "R 3:H": "H 3", "R 3 2:H": "H 3 2", "P 21": "P 1 21 1", "P 2": "P 1 2 1", "C 2": "C 1 2 1", "I 2": "I 1 2 1", "A 2": "A 1 2 1"}
# -----------------------------------------------------------------------------------------------------------------------

Operator = tuple[tuple[int, ...], tuple[int, ...]]


def parse_triplet(text: str) -> Operator:
    """-x+1/2,y,z as a rotation (nine integers) and a translation in 1/24."""
    rotation, shift = [], []
    for part in text.split(","):
        row, t = [0, 0, 0], Fraction(0)
        for sign, body in re.findall(r"([+-]?)([xyz]|\d+(?:/\d+)?)", part.replace(" ", "")):
            s = -1 if sign == "-" else 1
            if body in "xyz":
                row["xyz".index(body)] = s
            else:
                t += s * Fraction(body)
        rotation += row
        shift.append(int(t * UNIT) % UNIT)
    return tuple(rotation), tuple(shift)


def triplet(op: Operator) -> str:
    out = []
    for i in range(3):
        terms = "".join(f"{'+' if c > 0 else '-'}{v}" for c, v in zip(op[0][3 * i : 3 * i + 3], "xyz", strict=True) if c)
        t = Fraction(op[1][i], UNIT)
        out.append((terms + (f"+{t}" if t else "")).removeprefix("+"))
    return ",".join(out)


def _times(p: Operator, q: Operator) -> Operator:
    r = tuple(sum(p[0][3 * i + k] * q[0][3 * k + j] for k in range(3)) for i in range(3) for j in range(3))
    return r, tuple((p[1][i] + sum(p[0][3 * i + k] * q[1][k] for k in range(3))) % UNIT for i in range(3))


def operators_of(symbol: str) -> list[Operator]:
    """All operators of a space group, identity first: the closure of its generators and centring. Unknown symbols are errors."""
    name = " ".join(symbol.split()).upper()
    name = ALIASES.get(name, name)
    table = dict(line.split(": ") for line in SPACE_GROUPS.strip().splitlines())
    if name not in table:
        raise ValueError(f"unknown space group: {symbol!r}")
    gens = [parse_triplet(g) for g in table[name].split(";")]
    gens += [((1, 0, 0, 0, 1, 0, 0, 0, 1), tuple(int(Fraction(x) * UNIT) for x in c.split())) for c in CENTRINGS.get(name[0], [])]
    identity: Operator = ((1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 0))
    found = {identity: None}
    fresh = [identity]
    while fresh:
        fresh = [x for x in dict.fromkeys(_times(g, p) for p in fresh for g in gens) if x not in found]
        found |= dict.fromkeys(fresh)
    return [identity, *sorted(x for x in found if x != identity)]


def operator_table(spark: SparkSession, symbols: list[str] | None = None) -> DataFrame:
    """space_group, symop_no (from 1), triplet, rotation (nine) and translation (1/24) of the listed groups: a table of fixed size."""
    names = symbols or [line.split(":")[0] for line in SPACE_GROUPS.strip().splitlines()]
    rows = [(n, k, triplet(op), list(op[0]), list(op[1])) for n in names for k, op in enumerate(operators_of(n), start=1)]
    return spark.createDataFrame(rows, "space_group string, symop_no int, triplet string, rotation array<int>, translation array<int>")


def canonical_symbol(symbol) -> Column:
    name = F.upper(F.regexp_replace(F.trim(chem.col(symbol)), " +", " "))
    return F.coalesce(chem.lookup(name, ALIASES, "string"), name)


def cell_matrix(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """The matrix that takes fractions to angstroms."""
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    x, y = c * cb, c * (ca - cb * cg) / sg
    return np.array([[a, b * cg, x], [0.0, b * sg, y], [0.0, 0.0, math.sqrt(max(c * c - x * x - y * y, 0.0))]])


def window(m: np.ndarray, ops: list[Operator], centre: np.ndarray, extent: np.ndarray, cutoff: float) -> list[tuple[int, tuple[int, int, int], Operator]]:
    """(operator number, cell, placement) of the copies whose enclosing spheres come within the cutoff of the unit's."""
    inv = np.linalg.inv(m)
    diagonal = float(np.linalg.norm(extent))
    half = np.clip(np.ceil((diagonal + cutoff) * np.linalg.norm(inv, axis=1)), 1, 4).astype(int)
    f = inv @ centre
    out = []
    for no, (r, t) in enumerate(ops, start=1):
        rot, shift = np.array(r).reshape(3, 3), np.array(t)
        middle = np.rint(f - (rot @ f + shift / UNIT)).astype(int)
        for cell in product(*[range(int(k - h), int(k + h) + 1) for k, h in zip(middle, half, strict=True)]):
            at = shift + UNIT * np.array(cell)
            if no == 1 and not any(cell):
                continue
            if np.linalg.norm(m @ (rot @ f + at / UNIT) - centre) <= diagonal + cutoff:
                out.append((no, cell, (r, tuple(int(v) for v in at))))
    return out


def placements(atoms: DataFrame, structures: DataFrame, cutoff: float) -> DataFrame:
    """Copies that may come within the cutoff of the asymmetric unit: structure_id, symop_no, triplet, cell (i, j, k), exact rotation and
    translation (1/24), and m (nine) and t (three) that place an atom in angstroms.

    One small kernel row per structure; atoms are not touched but for their means and extents. The identity itself is left
    out. Structures without cell or group have no copies; unknown groups are errors."""
    ship(atoms.sparkSession)
    ext = atoms.groupBy("structure_id").agg(*[F.avg(x).alias(f"c{x}") for x in "xyz"], *[(F.max(x) - F.min(x)).alias(f"w{x}") for x in "xyz"])
    s = structures.where("space_group IS NOT NULL AND cell.a IS NOT NULL").select("structure_id", "space_group", *[F.col(f"cell.{c}").alias(c) for c in ("a", "b", "c", "alpha", "beta", "gamma")]).join(ext, "structure_id")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                m = cell_matrix(*(r[c] for c in ("a", "b", "c", "alpha", "beta", "gamma")))
                inv = np.linalg.inv(m)
                ops = operators_of(r["space_group"])
                for no, cell, (rot, at) in window(m, ops, np.array([r[f"c{x}"] for x in "xyz"]), np.array([r[f"w{x}"] for x in "xyz"]), cutoff):
                    place = m @ np.array(rot).reshape(3, 3) @ inv
                    rows.append((r["structure_id"], no, triplet(ops[no - 1]), *cell, list(rot), list(at), place.ravel().tolist(), (m @ (np.array(at) / UNIT)).tolist()))
            kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["structure_id", "symop_no", "triplet", "i", "j", "k", "rotation", "translation", "m", "t"])

    return s.mapInArrow(lay_out, "structure_id string, symop_no int, triplet string, i int, j int, k int, rotation array<int>, translation array<int>, m array<double>, t array<double>")


def expand(atoms: DataFrame, structures: DataFrame, cutoff: float | None = None, exclude_water: bool = True) -> DataFrame:
    """The asymmetric unit's atoms and those of every copy with an atom within the cutoff of them.

    Copies' chains are named <chain>~<operator>_<cell>; is_asu, asu_chain_id, symop_no, rotation and translation say what each
    atom is of. Copies are found by a semi-join on grid cells over placed atoms; only those kept are written out."""
    from .surface import widest_reach

    cutoff = widest_reach() + 0.1 if cutoff is None else cutoff
    unit = atoms.where(chem.is_heavy("element"))
    if exclude_water:
        unit = unit.where(~chem.is_water("res_name"))
    p = placements(unit, structures, cutoff)
    near = unit.select("structure_id", "atom_id", "x", "y", "z")

    def placed(d: DataFrame) -> DataFrame:
        new = [F.get("t", F.lit(i)) + sum((F.get("m", F.lit(3 * i + j)) * F.col(x) for j, x in enumerate("xyz")), F.lit(0.0)) for i in range(3)]
        return d.withColumns({f"_{x}": c for x, c in zip("xyz", new, strict=True)}).drop("x", "y", "z").withColumnsRenamed({f"_{x}": x for x in "xyz"})

    key = ["structure_id", "symop_no", "i", "j", "k"]
    moved = placed(near.join(p.select(*key, "m", "t"), "structure_id")).select(*key, "x", "y", "z")
    kept = range_join(moved, near, cutoff, ["structure_id"], how="left_semi").select(*key).distinct()
    copies = p.join(kept, key)
    source = atoms if not exclude_water else atoms.where(~chem.is_water("res_name"))
    label = F.concat(F.lit("~"), F.col("symop_no").cast("string"), F.lit("_"), *[(F.col(c) + 5).cast("string") for c in "ijk"])
    mates = placed(source.join(copies, "structure_id")).withColumn("asu_chain_id", F.col("auth_asym_id"))
    for c in ("chain_id", "auth_asym_id", "label_asym_id"):
        mates = mates.withColumn(c, F.concat(F.col(c), label))
    mates = mates.withColumn("is_asu", F.lit(False)).withColumn("chain_order", F.col("chain_order") + F.lit(1_000_000) * (1 + F.dense_rank().over(_by_structure("symop_no", "i", "j", "k"))))
    own = atoms.withColumn("asu_chain_id", F.col("auth_asym_id")).withColumn("is_asu", F.lit(True)).withColumn("symop_no", F.lit(1)).withColumn("triplet", F.lit("x,y,z"))
    own = own.withColumns({c: F.lit(0) for c in "ijk"}).withColumn("rotation", F.array(*[F.lit(v) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)])).withColumn("translation", F.array(F.lit(0), F.lit(0), F.lit(0)))
    d = own.unionByName(mates.drop("m", "t"), allowMissingColumns=True)
    return d.withColumn("atom_id", F.row_number().over(_by_structure("chain_order", "atom_id")) - 1)


def _by_structure(*order: str):
    from pyspark.sql import Window as W

    return W.partitionBy("structure_id").orderBy(*order)


# --- exact algebra of placements: nine integers, three in 1/24 ----------------------------------------------------------


def inverse_rotation(r: np.ndarray) -> np.ndarray:
    """The inverse of an integer matrix of determinant 1 or -1, in integers."""
    cofactors = np.array([np.cross(r[1], r[2]), np.cross(r[2], r[0]), np.cross(r[0], r[1])])
    return cofactors.T * int(r[0] @ cofactors[0])


def seen_from(first: tuple, second: tuple) -> tuple[list[int], list[int]]:
    """The second placement as the first sees it."""
    r1, r2 = np.array(first[0]).reshape(3, 3), np.array(second[0]).reshape(3, 3)
    inv = inverse_rotation(r1)
    return (inv @ r2).ravel().tolist(), (inv @ (np.array(second[1]) - np.array(first[1]))).tolist()


def with_relative(pairs: DataFrame) -> DataFrame:
    """`pairs` (asu_k, rotation_k, translation_k) with rel_rotation, rel_translation (2 seen from 1) and eq_key.

    The key is one for all symmetry copies of a pair: the lesser of (first, second, relative) and the same the other way round."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("asu_1", "asu_2", "rotation_1", "translation_1", "rotation_2", "translation_2")]
            rel, keys = [], []
            for a1, a2, r1, t1, r2, t2 in zip(*cols, strict=True):
                there, back = seen_from((r1, t1), (r2, t2)), seen_from((r2, t2), (r1, t1))
                rel.append(there)
                keys.append(json.dumps(min((a1, a2, *there), (a2, a1, *back))))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in rel], ints), pa.array([t for _, t in rel], ints), pa.array(keys, pa.string())], [*b.schema.names, "rel_rotation", "rel_translation", "eq_key"])

    fields = [T.StructField("rel_rotation", T.ArrayType(T.IntegerType())), T.StructField("rel_translation", T.ArrayType(T.IntegerType())), T.StructField("eq_key", T.StringType())]
    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, *fields]))


def molecule_placements(atoms: DataFrame) -> DataFrame:
    """structure_id, molecule_id, asu molecule name, placement of each molecule of expanded, assigned atoms."""
    asu = F.when(F.col("chain_type") == "ligand", F.concat(F.lit("["), F.col("ccd_id"), F.lit("]"), F.col("asu_chain_id"), F.lit(":"), F.col("auth_seq_id").cast("string"), F.col("icode"))).otherwise(F.col("asu_chain_id"))
    return atoms.where("molecule_id IS NOT NULL").groupBy("structure_id", "molecule_id").agg(F.first(asu).alias("asu"), F.first("molecule_class").alias("molecule_class"), F.first("is_asu").alias("is_asu"), F.first("symop_no").alias("symop_no"), F.first("rotation").alias("rotation"), F.first("translation").alias("translation"))


def collapse_equivalent(interfaces: DataFrame, molecules: DataFrame) -> DataFrame:
    """Interfaces with one row for each class of symmetry copies: the first by molecules, with n_occurrences counting all."""
    d = interfaces
    for k in (1, 2):
        m = molecules.select("structure_id", F.col("molecule_id").alias(f"molecule_{k}"), F.col("asu").alias(f"asu_{k}"), F.col("rotation").alias(f"rotation_{k}"), F.col("translation").alias(f"translation_{k}"))
        d = d.join(m, ["structure_id", f"molecule_{k}"])
    d = with_relative(d)
    cols = [c for c in d.columns if c not in ("structure_id", "eq_key", "n_occurrences")]
    g = d.groupBy("structure_id", "eq_key").agg(F.min_by(F.struct(*cols), F.struct("molecule_1", "molecule_2")).alias("_f"), F.count(F.lit(1)).alias("n_occurrences"))
    return g.select("structure_id", "_f.*", "n_occurrences")


