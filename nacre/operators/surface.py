"""Solvent-accessible surface by points on spheres: for all atoms together, for each molecule alone, and for each pair of molecules."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chem, tables
from ..session import ship

POINTS, PROBE = 480, 1.4


def unit_sphere(n: int = POINTS) -> np.ndarray:
    """n points of a golden spiral on the unit sphere."""
    i = np.arange(n)
    phi, theta = np.arccos(1 - 2 * i / (n - 0.5)), math.pi * (1 + 5**0.5) * i
    return np.column_stack([np.sin(phi) * np.cos(theta), np.sin(phi) * np.sin(theta), np.cos(phi)])


def widest_reach(probe: float = PROBE) -> float:
    """Farthest that two atoms of any listed kind can shade each other."""
    return 2 * max(tables.SURFACE_RADII.values()) + 2 * probe


#: Atoms that one group of a kernel evaluates at most, and the width of its block of space in reaches.
GROUP_ATOMS, BLOCK_REACHES = 2000, 4


def _neighbourhoods(wanted: DataFrame, shading: DataFrame, reach: float, keys: list[str], kernel, out: str) -> DataFrame:
    """kernel(wanted atoms, all atoms within reach of them and others) for groups of atoms; both are Arrow tables.

    Space is cut into blocks. Atoms that shade go to each block that they reach into, so what is sent grows with the atoms, not with
    their pairs. A crowded block's atoms are dealt over several groups, GROUP_ATOMS to each about, and each group gets the block's surroundings."""
    ship(wanted.sparkSession)
    width = BLOCK_REACHES * reach
    block = [F.floor(F.col(c) / width).cast("int").alias(f"_b{c}") for c in "xyz"]
    cells = [*keys, "_bx", "_by", "_bz"]
    a = wanted.select("*", *block)
    groups = a.groupBy(*[F.col(c).alias(f"_of_{c}") for c in cells]).agg(F.ceil(F.count(F.lit(1)) / GROUP_ATOMS).cast("int").alias("_groups"))
    b = shading.select(*[F.col(c).alias(c) for c in shading.columns])  # columns of its own, where both sides are one table
    for c in "xyz":
        low, high = (F.floor((F.col(c) + sign * reach) / width).cast("int") for sign in (-1, 1))
        b = b.withColumn(f"_b{c}", F.explode(F.sequence(low, high)))
    drop = [f"_of_{c}" for c in cells]
    # Atoms without a place shade nothing and stay out of b; of a they are a group with nothing around it.
    a = a.join(groups, reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cells])).withColumn("_group", F.pmod(F.xxhash64("atom_id"), F.col("_groups")).cast("int")).drop(*drop, "_groups")
    b = b.join(groups, reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_of_{c}") for c in cells])).withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop(*drop, "_groups")
    return a.groupBy(*cells, "_group").cogroup(b.groupBy(*cells, "_group")).applyInArrow(kernel, out)


def _near(x: np.ndarray, radius: float, id: int, places: np.ndarray, radii: np.ndarray, ids: np.ndarray, probe: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the other atoms that can shade one, nearest first, and their places from it."""
    c = places - x[:, None]
    d2 = c[0] * c[0] + c[1] * c[1] + c[2] * c[2]
    near = np.flatnonzero(d2 < (radius + radii + 2 * probe) ** 2)
    near = near[ids[near] != id]
    near = near[np.argsort(d2[near])]
    return near, c[:, near].T


def _dark(unit: np.ndarray, r: float, c: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which points of a sphere of radius r lie inside some sphere (places c, radii `reach`), nearest spheres first.

    |r u - c|^2 < reach^2, with |u| = 1. Points in the dark are not asked again, so a buried atom looks at few of its neighbours."""
    dark, live, at, step = np.zeros(len(unit), bool), np.arange(len(unit)), 0, 32
    bound = (r * r + (c * c).sum(1) - reach**2) / (2 * r)
    while at < len(c) and len(live):
        inside = (unit[live] @ c[at : at + step].T > bound[at : at + step]).any(1)
        dark[live[inside]] = True
        live = live[~inside]
        at, step = at + step, min(2 * step, 1024)
    return dark


def accessible_points(atoms: DataFrame, probe: float = PROBE, points: int = POINTS, keys: tuple[str, ...] = ("structure_id",)) -> DataFrame:
    """keys, atom_id, radius and live: points of each atom's sphere inside no other atom's (columns x, y, z, radius)."""
    keys = list(keys)
    unit = unit_sphere(points)
    d = atoms.select(*keys, "atom_id", "radius", "x", "y", "z")

    def kernel(part: pa.Table, around: pa.Table) -> pa.Table:
        places, radii, ids = np.stack([around.column(c).to_numpy() for c in "xyz"]), around.column("radius").to_numpy(), around.column("atom_id").to_numpy()
        live = []
        for id, radius, *x in zip(*(part.column(c).to_numpy() for c in ("atom_id", "radius", "x", "y", "z")), strict=True):
            near, c = _near(np.array(x), radius, id, places, radii, ids, probe)
            live.append(points - int(np.count_nonzero(_dark(unit, radius + probe, c, radii[near] + probe))))
        return pa.table([*[part.column(c) for c in (*keys, "atom_id", "radius")], pa.array(live, pa.int64())], names=[*keys, "atom_id", "radius", "live"])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return _neighbourhoods(d, d, widest_reach(probe), keys, kernel, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "atom_id", "radius")) + ", live long")


def area(radius, live, points: int = POINTS, probe: float = PROBE):
    r = chem.col(radius) + probe
    return F.lit(4 * math.pi) * r * r * chem.col(live) / points


def atom_surface(atoms: DataFrame, probe: float = PROBE, points: int = POINTS, evaluate=None) -> DataFrame:
    """structure_id, atom_id, molecule_id, radius, asa_combined, asa_alone and pairs for each heavy atom.

    asa_combined: shaded by all heavy atoms, water included. asa_alone: by its own molecule. pairs: for each other molecule
    near, the area that it buries of asa_alone. One numpy kernel answers all three for the atoms of a block from the
    atoms around it, so pairs of atoms are never rows; structures of any size spread by block. `evaluate`: condition on the atoms wanted."""
    d = atoms.where(chem.is_heavy("element")).withColumn("radius", chem.surface_radius("element", "atom_name", "res_name"))
    d = d.select("structure_id", "atom_id", "molecule_id", "radius", "x", "y", "z", *([F.expr(evaluate).alias("_want")] if evaluate else []))
    wanted = d.where("_want").drop("_want") if evaluate else d
    unit = unit_sphere(points)
    kind = pa.list_(pa.struct([("molecule", pa.int32()), ("buried", pa.float64())]))

    def kernel(part: pa.Table, around: pa.Table) -> pa.Table:
        places, radii, ids = np.stack([around.column(c).to_numpy() for c in "xyz"]), around.column("radius").to_numpy(), around.column("atom_id").to_numpy()
        molecules = around.column("molecule_id").fill_null(-1).to_numpy()
        both, alone, pairs = [], [], []
        for id, own, radius, *x in zip(*(part.column(c).to_numpy() for c in ("atom_id",)), part.column("molecule_id").to_pylist(), *(part.column(c).to_numpy() for c in ("radius", "x", "y", "z")), strict=True):
            near, c = _near(np.array(x), radius, id, places, radii, ids, probe)
            r, reach, of, out = radius + probe, radii[near] + probe, molecules[near], []
            full = 4 * math.pi * r * r
            mine = of == own if own is not None else np.zeros(len(near), bool)
            dark = _dark(unit, r, c[mine], reach[mine])
            rest = unit[~dark]  # what the own molecule leaves; only there can others bury anything
            both.append(full * (len(rest) - np.count_nonzero(_dark(rest, r, c[~mine], reach[~mine]))) / points)
            alone.append(full * len(rest) / points)
            for m in np.unique(of[~mine]).tolist() if own is not None else ():
                if m >= 0:
                    out.append({"molecule": m, "buried": full * int(np.count_nonzero(_dark(rest, r, c[of == m], reach[of == m]))) / points if len(rest) else 0.0})
            pairs.append(out)
        return pa.table([*[part.column(c) for c in ("structure_id", "atom_id", "molecule_id", "radius")], pa.array(both, pa.float64()), pa.array(alone, pa.float64()), pa.array(pairs, kind)], names=["structure_id", "atom_id", "molecule_id", "radius", "asa_combined", "asa_alone", "pairs"])

    return _neighbourhoods(wanted, d.drop("_want"), widest_reach(probe), ["structure_id"], kernel, "structure_id string, atom_id int, molecule_id int, radius double, asa_combined double, asa_alone double, pairs array<struct<molecule:int,buried:double>>")


def buried_surface(surface: DataFrame) -> DataFrame:
    """`surface` with bsa: what all other atoms together bury of an atom, 0 outside molecules."""
    return surface.withColumn("bsa", F.when(F.col("molecule_id").isNotNull(), F.greatest(F.col("asa_alone") - F.col("asa_combined"), F.lit(0.0))).otherwise(F.lit(0.0)))


def totals(surface: DataFrame) -> DataFrame:
    """assembly_asa (all heavy atoms, water included), and assembly_bsa: the molecules' areas alone less that, 0 at least."""
    g = surface.groupBy("structure_id").agg(F.sum("asa_combined").alias("assembly_asa"), F.sum(F.when(F.col("molecule_id").isNotNull(), F.col("asa_alone")).otherwise(0.0)).alias("total_asa_alone"))
    return g.withColumn("assembly_bsa", F.greatest(F.col("total_asa_alone") - F.col("assembly_asa"), F.lit(0.0)))


def pair_burial(surface: DataFrame, least: float = 1e-6) -> DataFrame:
    """structure_id, molecule_1 < molecule_2, atom_id, molecule_id, buried: what each atom loses to the pair's other molecule."""
    d = surface.select("structure_id", "atom_id", "molecule_id", F.explode("pairs").alias("p")).where(F.col("p.buried") > least)
    return d.select("structure_id", F.least("molecule_id", "p.molecule").alias("molecule_1"), F.greatest("molecule_id", "p.molecule").alias("molecule_2"), "atom_id", "molecule_id", F.col("p.buried").alias("buried"))


def residue_surface(atoms: DataFrame, surface: DataFrame, burial: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """One row per residue that an interface touches, over all its heavy atoms: asa (alone), bsa and solvation energy in this pair.

    faces (structure_id, molecule_1, molecule_2, atom_id): the interface's atoms; burial's if not given. Each atom's numbers are
    rounded (2, 2 and 4 places) before they are added, and the sums again."""
    res = ["structure_id", "molecule_1", "molecule_2", "molecule_id", "auth_asym_id", "res_seq", "icode"]
    where = chem.with_types(atoms.where("molecule_id IS NOT NULL")).select("structure_id", "atom_id", "molecule_id", "auth_asym_id", "res_seq", "icode", "label_comp_id", "sigma")
    face = burial if faces is None else faces
    touched = face.select("structure_id", "molecule_1", "molecule_2", "atom_id").join(where, ["structure_id", "atom_id"]).select(*res).distinct()
    d = touched.join(where, ["structure_id", "molecule_id", "auth_asym_id", "res_seq", "icode"]).join(surface.select("structure_id", "atom_id", "asa_alone"), ["structure_id", "atom_id"])
    d = d.join(burial.select("structure_id", "molecule_1", "molecule_2", "atom_id", "buried"), ["structure_id", "molecule_1", "molecule_2", "atom_id"], "left").withColumn("buried", F.coalesce("buried", F.lit(0.0)))
    return d.groupBy(*res).agg(
        F.min_by("label_comp_id", "atom_id").alias("residue"), F.round(F.sum(F.bround("asa_alone", 2)), 2).alias("asa"), F.round(F.sum(F.bround("buried", 2)), 2).alias("bsa"),
        F.round(F.sum(F.bround(F.col("sigma") * F.col("buried"), 4)), 4).alias("solvation_energy"),
    )
