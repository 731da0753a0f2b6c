"""Chemistry of atoms and of atom pairs as Column expressions: radii, solvation, bond roles, predicates, contact classes.

Every function takes Columns (or column names) and gives a Column, so Catalyst folds them into whatever stage uses them. Names are
compared trimmed and in capitals. Values by key come from map literals of fixed size; no joins are needed for them."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c) -> Column:
    return F.upper(F.trim(col(c)))


def key(res, atom) -> Column:
    return F.concat_ws(":", norm(res), norm(atom))


def lookup(k: Column, of: dict, kind: str = "double") -> Column:
    """The value of `k` in a fixed mapping, null if it has none. One folded map literal, so `k` stands in the expression once."""
    m = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b).cast(kind)) for a, b in of.items()))
    return F.try_element_at(m, k)


# --- atoms ---------------------------------------------------------------------------------------------------------


def is_heavy(element) -> Column:
    return ~norm(element).isin("H", "D")


def is_water(res) -> Column:
    return F.upper(F.coalesce(col(res), F.lit(""))).isin(T.WATERS)


def is_polymer(res, declared=None) -> Column:
    """Standard residues, or those that the file declares (array), but never water."""
    r = F.upper(col(res))
    known = r.isin(sorted({*T.AMINO_ACIDS, *T.NUCLEIC_ACIDS}))
    if declared is not None:
        known = known | F.coalesce(F.array_contains(col(declared), r), F.lit(False))
    return known & ~is_water(res)


def is_standard(res) -> Column:
    return F.upper(col(res)).isin(T.STANDARD_AMINO_ACIDS + T.STANDARD_NUCLEIC_ACIDS)


def contact_radius(element) -> Column:
    by, letters = T.contact_radius_rule()
    el = norm(element)
    return F.coalesce(lookup(el, by), lookup(F.substring(el, 1, 1), letters), F.lit(T.OTHER_RADIUS))


def surface_radius(element, atom, res) -> Column:
    el, name, r = norm(element), norm(atom), norm(res)
    sp2 = (name == "C") | key(res, atom).isin(T.SP2_CARBONS) | (r.isin(T.SURFACE_NUCLEOTIDES) & ~name.endswith("'"))
    radii = T.SURFACE_RADII
    return F.when(el == "C", F.when(sp2, F.lit(T.SP2_CARBON_RADIUS)).otherwise(F.lit(radii["C"]))).otherwise(F.coalesce(lookup(el, radii), contact_radius(element)))


def salt_charge(res, atom) -> Column:
    return lookup(key(res, atom), {k: int(v) for k, v in T.SALT_CHARGES.items()}, "int")


def hetero_class(element, atom, res) -> Column:
    el, name, r = norm(element), norm(atom), norm(res)
    charge = F.coalesce(salt_charge(res, atom), F.lit(0))
    return (
        F.when(el == "ZN", "ZN").when(el.isin(T.SOLVATION_METALS), "MET").when(r.isin(T.ION_RESIDUES) & (el == "O"), "OI").when(el == "C", "C").when(el.isin("S", "SE"), "S").when(el == "P", "P")
        .when(el.isin(T.HALOGENS), "HAL").when(el == "N", F.when(charge > 0, "N+").otherwise("N"))
        .when(el == "O", F.when(charge < 0, "O-").when(name.isin(T.PHOSPHATE_OXYGENS), "OP").otherwise("O")).otherwise("X")
    )


def fine_type(element, atom, res) -> Column:
    """RES:ATOM for typed residues, het:<class> (and element for metals and halogens) for others, H for hydrogens."""
    el = norm(element)
    cls = hetero_class(element, atom, res)
    het = F.when(cls.isin("MET", "HAL"), F.concat_ws(":", F.lit("het"), cls, el)).otherwise(F.concat(F.lit("het:"), cls))
    return F.when(el.isin("H", "D"), "H").when(norm(res).isin(T.TYPED_RESIDUES), key(res, atom)).otherwise(het)


def solvation_class(fine) -> Column:
    f = col(fine)
    res, atom = F.substring_index(f, ":", 1), F.substring(f, F.instr(f, ":") + 1, F.length(f))
    el = F.when((res == "MSE") & (atom == "SE"), "SE").otherwise(F.substring(atom, 1, 1))
    sugar = atom.endswith("'")
    nucleotide = (
        F.when(el == "P", "NA_P").when(atom.isin("OP1", "OP2", "OP3", "O1P", "O2P"), "NA_OP").when(sugar & (el == "C"), "NA_C_sugar").when(sugar, "NA_O_sugar")
        .when(el == "C", "NA_C_base").when(el == "N", "NA_N_base").when(el == "O", "NA_O_base").otherwise("X")
    )
    aromatic = [k for k in T.SP2_CARBONS if k[:3] in ("PHE", "TYR", "TRP", "HIS")]
    carbon = F.when(atom == "CA", "C_CA").when(atom == "C", "C_bb").when(f.isin(aromatic), "C_aro").when(f.isin(T.POLAR_SP2_CARBONS), "C_sp2_polar").otherwise("C_ali")
    nitrogen = F.when(atom == "N", "N_bb").when(res == "ARG", "N_arg").when(res == "LYS", "N_lys").when(res == "HIS", "N_his").when(res == "TRP", "N_trp").otherwise("N_amide")
    oxygen = F.when(atom.isin("O", "OXT"), "O_bb").when(res.isin("ASP", "GLU"), "O_carbox").when(res.isin("ASN", "GLN"), "O_amide").otherwise("O_hyd")
    sulfur = F.when(res == "CYS", "S_cys").otherwise("S_met")
    protein = F.when(el == "C", carbon).when(el == "N", nitrogen).when(el == "O", oxygen).when(el.isin("S", "SE"), sulfur).otherwise("X")
    return F.when(f == "H", "H").when(f.startswith("het:"), F.split_part(f, F.lit(":"), F.lit(2))).when(res.isin(T.TYPED_NUCLEOTIDES), nucleotide).otherwise(protein)


def sigma(fine, cls) -> Column:
    """Solvation energy per area of an atom from its types: its class's value and its own deviation; 0 for hydrogens."""
    f, c = col(fine), col(cls)
    return F.when(f == "H", F.lit(0.0)).otherwise(F.coalesce(lookup(c, T.SOLVATION), F.lit(0.0)) + F.coalesce(lookup(f, T.SOLVATION_BY_ATOM), F.lit(0.0)))


def with_types(atoms: DataFrame) -> DataFrame:
    """`atoms` with fine_type, solvation_class and sigma. A blank element is read off the atom name's first letter.

    Each column builds on the one before it as a column, which keeps the expressions from multiplying."""
    el = norm("element")
    el = F.when(el == "", F.coalesce(F.nullif(F.substring(norm("atom_name"), 1, 1), F.lit("")), F.lit("C"))).otherwise(el)
    d = atoms.withColumn("_el", el).withColumn("fine_type", fine_type("_el", "atom_name", "res_name")).drop("_el")
    return d.withColumn("solvation_class", solvation_class("fine_type")).withColumn("sigma", sigma("fine_type", "solvation_class"))


def is_apolar_class(cls) -> Column:
    c = col(cls)
    return c.startswith("C") | c.startswith("S") | c.startswith("NA_C")


def bond_role(res, atom, element) -> Column:
    """D, A, DA or empty: how a heavy atom can take part in a hydrogen bond."""
    r, name, el = norm(res), norm(atom), norm(element)
    listed = T.BOND_ROLES | T.bases(T.BASE_ROLES)
    generic = F.when(el == "N", "D").when(el == "O", "A").otherwise("")
    standard = r.isin(sorted({*T.AMINO_ACIDS, *T.NUCLEIC_ACIDS}))
    sugar = F.when(r.isin(T.NUCLEIC_ACIDS), lookup(name, T.SUGAR_ROLES, "string"))
    backbone = F.when(name == "N", F.when(r == "PRO", "").otherwise("D")).when(name.isin("O", "OXT"), "A")
    return F.coalesce(lookup(key(res, atom), listed, "string"), F.when(standard, F.coalesce(sugar, backbone, generic)).otherwise(generic))


def donates(role) -> Column:
    return col(role).contains("D")


def accepts(role) -> Column:
    return col(role).contains("A")


def donor_capacity(res, atom) -> Column:
    """Bonds that a donor may take part in: its hydrogens and one more, for bonds that share one."""
    listed = {k: int(v) for k, v in (T.DONOR_HYDROGENS | T.bases(T.BASE_HYDROGENS)).items()}
    return F.coalesce(lookup(key(res, atom), listed, "int"), F.lit(1)) + 1


def acceptor_capacity(element) -> Column:
    return F.when(norm(element).isin("O", "S"), 2).otherwise(1)


def is_metal(element) -> Column:
    return norm(element).isin(T.CONTACT_METALS)


def is_polar(atom, element) -> Column:
    return norm(element).isin(T.POLAR_ELEMENTS) | norm(atom).isin(T.POLAR_NAMES)


#: Names of carbons that count as apolar. (Fixed value.)
APOLAR_NAMES = "C CA CB CG CD CE CZ CH2 CG2 CD1 CD2 CE1 CE2 CZ2 CZ3".split()


def is_apolar(atom, element) -> Column:
    return (norm(element) == "C") & norm(atom).isin(APOLAR_NAMES)


def bears_hydrogen(res, atom) -> Column:
    """Whether a carbon has a hydrogen to give."""
    r, name = norm(res), norm(atom)
    base = F.when((F.length(r) == 2) & F.substring(r, 1, 1).isin("D", "R"), F.substring(r, 2, 1)).otherwise(r)
    return ~((name == "C") | F.concat_ws(":", r, name).isin(T.BARE_CARBONS) | F.concat_ws(":", base, name).isin(T.BARE_BASE_CARBONS))


def is_ring_atom(res, atom) -> Column:
    return key(res, atom).isin([f"{r}:{a}" for r, atoms in T.RING_ATOMS for a in atoms])


def one_letter(res) -> Column:
    return F.coalesce(lookup(norm(res), T.ONE_LETTER, "string"), F.lit("X"))


def moiety(atom) -> Column:
    return F.when(norm(atom).isin(T.BACKBONE_ATOMS), "backbone").otherwise("side chain")


#: Residues by kind, for composition plots. (Fixed values.)
RESIDUE_KINDS = {"positive": "ARG LYS HIS", "negative": "ASP GLU", "polar": "SER THR ASN GLN CYS TYR", "aromatic": "PHE TRP", "aliphatic": "ALA VAL LEU ILE MET PRO GLY MSE"}


def residue_kind(res) -> Column:
    return F.coalesce(lookup(norm(res), {r: k for k, rs in RESIDUE_KINDS.items() for r in rs.split()}, "string"), F.when(norm(res).isin(T.NUCLEIC_ACIDS), "nucleic").otherwise("other"))


def mass(element, strict: bool = False) -> Column:
    """Atomic mass; unknown elements count as carbon, or are an error if `strict`."""
    known = lookup(norm(element), T.MASSES)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown element: "), col(element))).cast("double") if strict else F.lit(T.OTHER_MASS))


# --- pairs of atoms ------------------------------------------------------------------------------------------------
# A side is the prefix of its columns: a_res_name, a_atom_name, a_element; distances are in column `distance`. What the rules ask
# of one atom alone is its traits, bits of one number. Where the sides have columns a_traits, a_reach and b_traits, b_reach (`known`), made
# before atoms were joined, a rule costs a pair some bits; the names' rules are then asked once an atom.


def side(prefix: str) -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}_res_name"), F.col(f"{prefix}_atom_name"), F.col(f"{prefix}_element")


#: Bits of an atom's traits, in order.
TRAITS = "donor acceptor positive negative cys_sulphur map_cation map_anion halogen oxygen_nitrogen carbon bearing_carbon metal ring cation polar".split()


def traits(res, atom, element) -> Column:
    """What the rules of pairs ask of one atom, as bits."""
    el, k, role = norm(element), key(res, atom), bond_role(res, atom, element)
    of = {
        "donor": donates(role), "acceptor": accepts(role), "positive": salt_charge(res, atom) > 0, "negative": salt_charge(res, atom) < 0,
        "cys_sulphur": (norm(res) == "CYS") & (el == "S"), "map_cation": k.isin(T.MAP_SALT_CATIONS),
        "map_anion": k.isin(T.MAP_SALT_ANIONS) | (norm(res).isin(T.MAP_SALT_NUCLEOTIDES) & norm(atom).isin(T.MAP_SALT_PHOSPHATES)),
        "halogen": el.isin(T.HALOGENS), "oxygen_nitrogen": el.isin("O", "N"), "carbon": el == "C", "bearing_carbon": (el == "C") & bears_hydrogen(res, atom),
        "metal": is_metal(element), "ring": is_ring_atom(res, atom), "cation": k.isin([c for c, v in T.CHARGED_ATOMS.items() if v > 0]), "polar": is_polar(atom, element),
    }
    return reduce(lambda p, q: p.bitwiseOR(q), [F.when(of[t], F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(TRAITS)])


def with_traits(atoms: DataFrame) -> DataFrame:
    """`atoms` with traits and reach (the radius in contacts)."""
    return atoms.withColumn("traits", traits("res_name", "atom_name", "element")).withColumn("reach", contact_radius("element"))


def _traits(known: bool) -> tuple[Column, Column]:
    return (F.col("a_traits"), F.col("b_traits")) if known else (traits(*side("a")), traits(*side("b")))


def _has(of: Column, *names: str) -> Column:
    bits = sum(1 << TRAITS.index(n) for n in names)
    return of.bitwiseAND(F.lit(bits)) == bits


def has_role(traits_: Column) -> Column:
    """Whether an atom can take part in a hydrogen bond."""
    return _has(traits_, "donor") | _has(traits_, "acceptor")


def _one_each(t: tuple[Column, Column], x: str, y: str) -> Column:
    """Trait x on one side and y on the other."""
    return (_has(t[0], x) & _has(t[1], y)) | (_has(t[1], x) & _has(t[0], y))


def is_hydrogen_bond(distance="distance", below: float = 3.89, known: bool = False) -> Column:
    """Donor and acceptor within reach, by their roles alone."""
    return (col(distance) < below) & _one_each(_traits(known), "donor", "acceptor")


def is_salt_bridge(distance="distance", most: float = 4.0, known: bool = False) -> Column:
    return (col(distance) <= most) & _one_each(_traits(known), "positive", "negative")


def is_disulfide(distance="distance", below: float = 3.0, known: bool = False) -> Column:
    a, b = _traits(known)
    return (col(distance) < below) & _has(a, "cys_sulphur") & _has(b, "cys_sulphur")


def is_map_salt_bridge(most: float = 4.5, known: bool = False) -> Column:
    """The contact map's own salt bridges: Lys NZ or Arg NH with a carboxylate or phosphate oxygen."""
    return (F.col("distance") <= most) & _one_each(_traits(known), "map_cation", "map_anion")


#: All classes of contacts; water_mediated is kept for tables' sake and never given.
CONTACT_CLASSES = "hydrogen_bond weak_hbond salt_bridge disulfide halogen_bond pi_pi cation_pi ch_pi polar_vdw apolar_vdw water_mediated metal_mediated clash proximal".split()


def contact_class(hydrogen_bond: Column | None = None, pi_pi: Column | None = None, cation_pi: Column | None = None, ch_pi: Column | None = None, known: bool = False) -> Column:
    """The class of a contact: the first rule that holds, from disulfide down to proximal.

    Verdicts on geometry are boolean Columns; without them distance alone decides (the roles' hydrogen bonds, 5.5, 6 and 5 angstroms)."""
    d, t = F.col("distance"), _traits(known)
    a, b = t
    hydrogen_bond = is_hydrogen_bond(known=known) if hydrogen_bond is None else hydrogen_bond
    pi_pi = d < 5.5 if pi_pi is None else pi_pi
    cation_pi = d < 6.0 if cation_pi is None else cation_pi
    ch_pi = d < 5.0 if ch_pi is None else ch_pi
    reach = F.col("a_reach") + F.col("b_reach") if known else contact_radius(F.col("a_element")) + contact_radius(F.col("b_element"))
    return (
        F.when(is_disulfide(known=known), "disulfide")
        .when(is_map_salt_bridge(known=known), "salt_bridge")
        .when((d < 3.6) & _one_each(t, "halogen", "oxygen_nitrogen"), "halogen_bond")
        .when((d < 3.0) & (_has(a, "metal") | _has(b, "metal")), "metal_mediated")
        .when(hydrogen_bond, "hydrogen_bond")
        .when((d <= 3.6) & _one_each(t, "bearing_carbon", "oxygen_nitrogen"), "weak_hbond")
        .when(_has(a, "ring") & _has(b, "ring") & pi_pi, "pi_pi")
        .when(_one_each(t, "ring", "cation") & cation_pi, "cation_pi")
        .when(((_has(a, "ring") & ~_has(b, "ring") & _has(b, "carbon")) | (_has(b, "ring") & ~_has(a, "ring") & _has(a, "carbon"))) & ch_pi, "ch_pi")
        .when(d < reach, "clash")
        .when(d <= reach + 0.5, F.when(_has(a, "polar") | _has(b, "polar"), "polar_vdw").otherwise("apolar_vdw"))
        .otherwise("proximal")
    )
