"""Assemblies: cheapest dissociation, growth over symmetry contacts, enumeration and ranking; one kernel call per structure.

These searches are recursive and small (a structure's molecules and interfaces), so each structure is one group of one kernel; the
graphs' edges come from DataFrames and the results go back as rows."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..session import ship

#: Bodies up to which every way of coming apart is weighed; molecules beyond which a set counts as endless.
EXACT_BODIES, MOST_NODES = 14, 512
_RT = tables.GAS_CONSTANT * tables.TEMPERATURE


def entropy(masses: list[float]) -> float:
    """T dS gained when bodies of these masses part, kcal/mol."""
    if len(masses) < 2:
        return 0.0
    return _RT * (1.5 * (sum(map(math.log, masses)) - math.log(sum(masses))) + (len(masses) - 1) * tables.ENTROPY_LOG_TERM)


@dataclass
class Dissociation:
    energy: float
    entropy: float
    parts: list[list]
    cut: list[tuple]
    exact: bool = True


def dissociate(masses: dict, edges: list[tuple]) -> Dissociation:
    """The cheapest way for bodies held by edges (a, b, energy) to come apart; of several connected groups, the weakest one's.

    Parallel edges add up. Up to EXACT_BODIES, a table over subsets holds the best further gain of each: a subset may split
    in two where an edge is cut, and its halves go on splitting as long as that gains. Larger groups shed one body (exact is then False)."""
    names = sorted(masses, key=str)
    place = {k: i for i, k in enumerate(names)}
    weight: Counter = Counter()
    for a, b, e in edges:
        if a != b and a in place and b in place:
            weight[tuple(sorted((place[a], place[b])))] += float(e)
    if not weight:
        return Dissociation(0.0, 0.0, [[k] for k in names], [])
    root = list(range(len(names)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in weight:
        root[max(top(i), top(j))] = min(top(i), top(j))
    found = []
    for r in sorted({top(i) for pair in weight for i in pair}):
        group = [i for i in range(len(names)) if top(i) == r]
        found.append(_split_group(group, [masses[k] for k in names], weight))
    parts, cut, exact, energy, s = min(found, key=lambda f: f[3])
    label = lambda xs: [names[i] for i in xs]
    return Dissociation(energy, s, sorted(map(label, parts), key=lambda p: (-len(p), str(p))), [(names[i], names[j]) for i, j in cut], exact)


def _split_group(group: list[int], mass: list[float], weight: Counter) -> tuple:
    n = len(group)
    bit = {v: k for k, v in enumerate(group)}
    pairs = [(bit[i], bit[j], w) for (i, j), w in weight.items() if i in bit]
    if n > EXACT_BODIES:
        total = sum(mass[v] for v in group)
        options = []
        for k, v in enumerate(group):
            crossing = sum(w for i, j, w in pairs if k in (i, j))
            s = entropy([mass[v], total - mass[v]])
            options.append((-crossing - s, v, s))
        energy, v, s = min(options)
        return [[x for x in group if x != v], [v]], sorted(p for p in weight if v in p), False, energy, s
    size = 1 << n
    inside, heavy, near = [0.0] * size, [0.0] * size, [0] * size
    for m in range(1, size):
        k = m.bit_length() - 1
        rest = m ^ (1 << k)
        heavy[m] = heavy[rest] + mass[group[k]]
        inside[m] = inside[rest] + sum(w for i, j, w in pairs if (i == k and rest >> j & 1) or (j == k and rest >> i & 1))
        near[m] = near[rest] | sum(1 << (j if i == k else i) for i, j, _ in pairs if k in (i, j))
    # gain[m]: least energy of splitting m further, 0 if none is worth while; how[m]: the first half of the best split.
    gain, how = [0.0] * size, [0] * size
    logs = [math.log(h) if h else 0.0 for h in heavy]
    for m in range(1, size):
        low, best, half = m & -m, None, 0
        sub = (m - 1) & m
        while sub:
            if sub & low and near[sub] & (m ^ sub):
                other = m ^ sub
                s = _RT * (1.5 * (logs[sub] + logs[other] - logs[m]) + tables.ENTROPY_LOG_TERM)
                value = -(inside[m] - inside[sub] - inside[other]) - s + min(0.0, gain[sub]) + min(0.0, gain[other])
                if best is None or value < best:
                    best, half = value, sub
            sub = (sub - 1) & m
        if best is not None:
            gain[m], how[m] = best, half
    parts, todo = [], [size - 1]
    first = True
    while todo:
        m = todo.pop()
        if how[m] and (first or gain[m] < 0):
            todo += [how[m], m ^ how[m]]
        else:
            parts.append([group[k] for k in range(n) if m >> k & 1])
        first = False
    of = {v: p for p, xs in enumerate(parts) for v in xs}
    cut = sorted(p for p in weight if p[0] in bit and of[p[0]] != of[p[1]])
    s = entropy([sum(mass[v] for v in p) for p in parts])
    return parts, cut, True, -sum(weight[p] for p in cut) - s, s


def dissociation(interfaces: DataFrame, molecules: DataFrame) -> DataFrame:
    """One row per structure: dissociation_energy, entropy, parts, cut and exact, over its macromolecules.

    A ligand goes with the polymer it buries most against in one interface, its mass and its edges with it."""
    ship(interfaces.sparkSession)
    lig = interfaces.select("structure_id", F.explode(F.array(F.struct(F.col("molecule_1").alias("l"), F.col("molecule_2").alias("o"), F.col("class_1").alias("lc"), F.col("class_2").alias("oc")), F.struct(F.col("molecule_2").alias("l"), F.col("molecule_1").alias("o"), F.col("class_2").alias("lc"), F.col("class_1").alias("oc")))).alias("p"), "interface_area")
    host = lig.where("p.lc = 'Ligand' AND p.oc <> 'Ligand'").groupBy("structure_id", F.col("p.l").alias("molecule_id")).agg(F.max_by("p.o", F.struct("interface_area", -F.col("p.o"))).alias("host"))
    body = molecules.join(host, ["structure_id", "molecule_id"], "left").withColumn("host", F.coalesce("host", "molecule_id"))
    masses = body.groupBy("structure_id", "host").agg(F.sum("mass").alias("mass"), F.max_by("molecule_label", F.col("molecule_id") == F.col("host")).alias("label"))
    h = body.select("structure_id", "molecule_id", "host")
    e = interfaces.join(h.withColumnsRenamed({"molecule_id": "molecule_1", "host": "a"}), ["structure_id", "molecule_1"]).join(h.withColumnsRenamed({"molecule_id": "molecule_2", "host": "b"}), ["structure_id", "molecule_2"]).where("a <> b")
    none = lambda t: F.lit(None).cast(t)
    rows = masses.select("structure_id", F.col("host").alias("a"), none("int").alias("b"), F.col("mass").alias("v"), "label").union(e.select("structure_id", "a", "b", "stabilization_energy", none("string")))

    def settle(key, part):
        rs = part.to_pylist()
        label = {r["a"]: r["label"] for r in rs if r["b"] is None}
        d = dissociate({r["a"]: r["v"] for r in rs if r["b"] is None and r["v"]}, [(r["a"], r["b"], r["v"]) for r in rs if r["b"] is not None])
        names = [[label[x] for x in p] for p in d.parts]
        cut = [[label[a], label[b]] for a, b in d.cut]
        return pa.table({"structure_id": pa.array([key[0].as_py()], pa.string()), "dissociation_energy": pa.array([d.energy]), "entropy": pa.array([d.entropy]), "parts": pa.array([names], pa.list_(pa.list_(pa.string()))), "cut": pa.array([cut], pa.list_(pa.list_(pa.string()))), "exact": pa.array([d.exact])})

    return rows.groupBy("structure_id").applyInArrow(settle, "structure_id string, dissociation_energy double, entropy double, parts array<array<string>>, cut array<array<string>>, exact boolean")


# --- assemblies in a crystal -------------------------------------------------------------------------------------------


class Contact(NamedTuple):
    """Molecule `first`, unmoved, touches `second` turned by nine integers and shifted by three 24ths of the cell's axes."""

    number: int
    first: str
    second: str
    turn: tuple
    shift: tuple
    energy: float
    area: float


def turned(turn: tuple, v: tuple) -> tuple:
    """A vector (three numbers) or a rotation (nine, by rows) under a rotation."""
    step = len(v) // 3
    return tuple(sum(turn[3 * i + k] * v[step * k + j] for k in range(3)) for i in range(3) for j in range(step))


NO_TURN, NO_SHIFT = (1, 0, 0, 0, 1, 0, 0, 0, 1), (0, 0, 0)


class Packing:
    """A crystal's molecules, in all their orientations, in connected sets that grow contact by contact.

    Copies that differ by whole cells share a vertex (molecule, rotation). A vertex keeps its shift against the first of its set, so a set
    is one body of a crystal: joining two shifts the smaller. A contact between vertices of one set whose shifts don't agree
    links a body with its own translated copy: that set is endless, as is any it becomes part of."""

    def __init__(self, molecules: list[str], contacts: list[Contact]):
        turns, fresh = {NO_TURN}, [NO_TURN]
        while fresh:  # the group that the contacts' rotations make
            fresh = list({turned(t, c.turn) for t in fresh for c in contacts} - turns)
            turns.update(fresh)
        self.turns = sorted(turns, reverse=True)
        self.set_of = {(m, t): (m, t) for m in molecules for t in self.turns}
        self.members = {v: {v: NO_SHIFT} for v in self.set_of}
        self.endless: set = set()

    def add(self, c: Contact) -> None:
        for t in self.turns:
            self._join((c.first, t), (c.second, turned(t, c.turn)), turned(t, c.shift))

    def _join(self, u: tuple, v: tuple, apart: tuple) -> None:
        p, q = self.set_of[u], self.set_of[v]
        have, other = self.members[p], self.members[q]
        off = tuple(a + d - b for a, d, b in zip(have[u], apart, other[v], strict=True))  # what q's shifts lack in p's frame
        if p == q:
            if any(off):
                self.endless.add(p)
            return
        if len(other) > len(have):
            p, q, have, other, off = q, p, other, have, tuple(-x for x in off)
        for w, shift in other.items():
            have[w] = tuple(x + y for x, y in zip(shift, off, strict=True))
            self.set_of[w] = p
        del self.members[q]
        if q in self.endless:
            self.endless.add(p)

    def body(self, molecule: str) -> dict | None:
        """{(molecule, rotation): shift} of the set around an unmoved molecule, in its frame; None if endless or of more than MOST_NODES."""
        home = (molecule, NO_TURN)
        inside = self.members[self.set_of[home]]
        if self.set_of[home] in self.endless or len(inside) > MOST_NODES:
            return None
        at = inside[home]
        return {v: tuple(x - y for x, y in zip(shift, at, strict=True)) for v, shift in inside.items()}


def contacts_within(body: dict, contacts: list[Contact]) -> dict[tuple, Contact]:
    """Contacts between members of a body, by their two vertices and number. Each is seen from its first molecule's side."""
    by_molecule = defaultdict(list)
    for v in body:
        by_molecule[v[0]].append(v)
    out = {}
    for c in contacts:
        for u in by_molecule[c.first]:
            v = (c.second, turned(u[1], c.turn))
            if v != u and body.get(v) == tuple(x + y for x, y in zip(body[u], turned(u[1], c.shift), strict=True)):
                out[(*sorted((u, v)), c.number)] = c
    return out


def content_of(molecules: Iterable[str], ligands: set[str]) -> tuple[str, str]:
    """(composition, formula): E[4]I[4][CA][4] and A4B4a4, polymers before ligands, each with its number if over one."""
    times = Counter(molecules)
    number = lambda n: str(n) if n > 1 else ""
    bracketed = sorted(times, key=lambda m: (m.startswith("["), m))
    composition = "".join(m + (f"[{times[m]}]" if times[m] > 1 else "") for m in bracketed)
    polymers, others = sorted(set(times) - ligands), sorted(set(times) & ligands)
    letters = [*zip(ascii_uppercase, polymers, strict=False), *zip(ascii_lowercase, others, strict=False)]
    return composition, "".join(letter + number(times[m]) for letter, m in letters)


def bodies_of(masses: dict[str, float], ligands: set[str], contacts: list[Contact]) -> list[dict]:
    """Finite bodies that hold together by a crystal's k strongest contacts, for any k, most stable first.

    One pass over the contacts by strength; after each, the sets that it changed are looked at. Bodies of ligands alone don't
    count. All contacts within a body are scored, not the k alone; of bodies with equal contents the one hardest to part stays."""
    contacts = sorted((c for c in contacts if {c.first, c.second} <= masses.keys()), key=lambda c: (c.energy, -c.area, c.number))
    packing, best, seen = Packing(sorted(masses), contacts), {}, set()
    for c in contacts or [None]:
        if c is not None:
            packing.add(c)
        for molecule in sorted(masses):
            state = packing.set_of[molecule, NO_TURN], len(packing.members[packing.set_of[molecule, NO_TURN]])
            if state in seen:
                continue
            seen.add(state)
            body = packing.body(molecule)
            if body is None or all(m in ligands for m, _ in body):
                continue
            inner = contacts_within(body, contacts)
            d = dissociate({v: masses[v[0]] for v in body}, [(u, v, x.energy) for (u, v, _), x in inner.items()])
            composition, formula = content_of([m for m, _ in body], ligands)
            key = tuple(sorted(Counter(m for m, _ in body).items()))
            if key in best and best[key]["dissociation_energy"] >= d.energy:
                continue
            best[key] = {
                "size": len(body), "mmsize": sum(m not in ligands for m, _ in body), "composition": composition, "formula": formula, "dissociation_energy": d.energy, "entropy": d.entropy,
                "n_interfaces": len(inner), "interface_ids": sorted({x.number for x in inner.values()}), "body": body,
            }
    order = lambda r: (r["dissociation_energy"] <= 0, -r["mmsize"], -r["dissociation_energy"], -r["size"], r["composition"])
    return [r | {"rank": i} for i, r in enumerate(sorted(best.values(), key=order), start=1)]


def assemblies(interfaces: DataFrame, molecules: DataFrame, masses: DataFrame) -> DataFrame:
    """Predicted assemblies of each crystal, ranked.

    interfaces: collapsed ones, with asu_1/2, rotation_1/2, translation_1/2; molecules: placements with asu and class; masses: molecules
    with mass, of the asymmetric unit."""
    ship(interfaces.sparkSession)
    e = interfaces
    none = lambda t: F.lit(None).cast(t)
    m = molecules.where("is_asu").join(masses.select("structure_id", "molecule_id", "mass"), ["structure_id", "molecule_id"])
    rows = e.select("structure_id", F.col("asu_1").alias("a"), F.col("asu_2").alias("b"), F.col("rel_rotation").alias("r"), F.col("rel_translation").alias("t"), F.col("stabilization_energy").alias("v"), F.col("interface_area").alias("area"), F.col("interface_id").cast("int").alias("interface_id"), none("boolean").alias("ligand"))
    rows = rows.union(m.select("structure_id", "asu", none("string"), none("array<int>"), none("array<int>"), "mass", none("double"), none("int"), F.col("molecule_class") == "Ligand"))

    def settle(key, part):
        rs = part.to_pylist()
        alone = [r for r in rs if r["b"] is None]
        found = [Contact(r["interface_id"], r["a"], r["b"], tuple(r["r"]), tuple(r["t"]), r["v"], r["area"]) for r in rs if r["b"] is not None]
        out = bodies_of({r["a"]: r["v"] or 0.0 for r in alone}, {r["a"] for r in alone if r["ligand"]}, found)
        node = pa.struct([("molecule", pa.string()), ("rotation", pa.list_(pa.int32())), ("translation", pa.list_(pa.int32()))])
        cols = {"structure_id": pa.array([key[0].as_py()] * len(out), pa.string())}
        for name, kind in (("rank", pa.int32()), ("size", pa.int32()), ("mmsize", pa.int32()), ("composition", pa.string()), ("formula", pa.string()), ("dissociation_energy", pa.float64()), ("entropy", pa.float64()), ("n_interfaces", pa.int32()), ("interface_ids", pa.list_(pa.int32()))):
            cols[name] = pa.array([r[name] for r in out], kind)
        cols["molecules"] = pa.array([[{"molecule": m, "rotation": list(t), "translation": list(x)} for (m, t), x in r["body"].items()] for r in out], pa.list_(node))
        return pa.table(cols)

    schema = "structure_id string, rank int, size int, mmsize int, composition string, formula string, dissociation_energy double, entropy double, n_interfaces int, interface_ids array<int>, molecules array<struct<molecule:string,rotation:array<int>,translation:array<int>>>"
    return rows.groupBy("structure_id").applyInArrow(settle, schema)


def formula_of(molecules: DataFrame) -> DataFrame:
    """Formula and composition strings of the analysed coordinates, by aggregates alone."""
    d = molecules.groupBy("structure_id", "molecule_label", "molecule_class").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") == 1, F.col("molecule_label")).otherwise(F.concat("molecule_label", F.lit("["), F.col("n").cast("string"), F.lit("]")))
    order = F.struct(F.col("molecule_label").startswith("[").alias("l"), F.col("molecule_label").alias("m"), name.alias("s"))
    return d.groupBy("structure_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["s"]), "").alias("composition"), F.sum("n").alias("size"), F.sum(F.when(F.col("molecule_class") != "Ligand", F.col("n")).otherwise(0)).alias("mmsize"))
