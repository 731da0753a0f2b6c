"""Range joins in space: pairs of points within a distance, by an equi-join on grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cell(x: str, cutoff: float):
    return F.floor(F.col(x) / cutoff).cast("int")


def distance(ax: list[str] = ("a_x", "a_y", "a_z"), bx: list[str] = ("b_x", "b_y", "b_z")):
    return F.sqrt(reduce(lambda s, t: s + t, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(ax, bx, strict=True)]))


def range_join(left: DataFrame, right: DataFrame, cutoff: float, keys: list[str] = (), strict: bool = False, how: str = "inner", condition=None, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of rows of `left` and `right` (equal in `keys`) at most `cutoff` apart, with a column distance.

    Columns of left are renamed a_<name>, of right b_<name>, but for the keys. A plain distance predicate would be a nested-loop
    join; here each right row is put into the 27 cells around its own, each left row into its own cell, and cells are
    joined by sorting. Cells are as wide as the cutoff, so every pair meets exactly once. Keys and cell together spread one
    large structure over many tasks, however few its files are: the hint keeps a small right side from being broadcast to tasks
    of the left one's files, since work grows with the pairs, not with the rows. AQE splits a crowded cell. `how` may be left_semi or left_anti, which give left rows as they are.
    Rows with a null coordinate pair with nothing (and stay in left_anti)."""
    semi = how in ("left_semi", "left_anti")
    a = left.select(*[F.col(k) for k in keys], *[F.col(c).alias(c if semi else f"a_{c}") for c in left.columns if c not in keys])
    ax = [x if semi else f"a_{x}" for x in xyz]
    bx = [f"b_{x}" for x in xyz]
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in keys])
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for i, (p, q) in enumerate(zip(ax, bx, strict=True)):
        a = a.withColumn(f"_c{i}", _cell(p, cutoff))
        b = b.withColumn("_o", F.explode(near)).withColumn(f"_d{i}", _cell(q, cutoff) + F.col("_o")).drop("_o")
    d = distance(ax, bx)
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(f"_c{i}") == F.col(f"_d{i}") for i in range(3)] + [d < cutoff if strict else d <= cutoff]
    if condition is not None:
        on.append(condition)
    j = a.join(b.hint("merge"), reduce(lambda p, q: p & q, on), how)
    if semi:
        return j.drop("_c0", "_c1", "_c2")
    return j.withColumn("distance", d).drop(*[f"_{k}" for k in keys], *[f"_{x}{i}" for x in "cd" for i in range(3)])


def pair_join(atoms: DataFrame, cutoff: float, keys: list[str] = ("structure_id",), strict: bool = False, of: str = "molecule_id") -> DataFrame:
    """Pairs of atoms of different molecules, the lower molecule first: cross-molecule neighbours."""
    return range_join(atoms, atoms, cutoff, list(keys), strict, condition=F.col(f"a_{of}") < F.col(f"b_{of}"))


def neighbour_sets(atoms: DataFrame, cutoff: float, keys: list[str] = ("structure_id",), of: str = "molecule_id", id: str = "atom_id") -> DataFrame:
    """For each pair of molecules with neighbours, the sorted distinct atoms of either side."""
    p = pair_join(atoms, cutoff, keys, of=of)
    return p.groupBy(*keys, F.col(f"a_{of}").alias("molecule_1"), F.col(f"b_{of}").alias("molecule_2")).agg(F.sort_array(F.collect_set(f"a_{id}")).alias("atoms_1"), F.sort_array(F.collect_set(f"b_{id}")).alias("atoms_2"))


def atoms_near(first: DataFrame, second: DataFrame, cutoff: float, keys: list[str] = ("structure_id",)) -> DataFrame:
    """Atoms of `first` that have one of `second` within the cutoff."""
    return range_join(first, second, cutoff, list(keys), how="left_semi")
