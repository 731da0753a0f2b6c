"""Queries of comparison, reference data and export over the driver's tables, with the same in DuckDB's SQL. Put beside those of queries.py."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import __version__
from .functions import tables
from .operators import comparison as P
from .operators import contacts as C
from .operators import crystal
from .queries import _CLASS, _FINE, _HB, _SALT, _SIGMA, ATOMS, PAIRS, SQL, atoms, contact_pairs, heavy, query, read
from .sinks import export
from .sources import archive, pdb

# --- contacts, residues, labels ----------------------------------------------------------------------------------------------

_SWAP = "ac NOT IN ('A', 'C', 'E')"


@query("P20_orient", f"WITH {PAIRS} SELECT CASE WHEN {_SWAP} THEN b_id ELSE a_id END AS first_id, CASE WHEN {_SWAP} THEN a_id ELSE b_id END AS second_id, CASE WHEN {_SWAP} THEN bc ELSE ac END AS first_chain FROM pairs")
def _p20(s, d):
    p = P.orient(contact_pairs(s, d), ["A", "C", "E"])
    return p.select(F.col("a_atom_id").alias("first_id"), F.col("b_atom_id").alias("second_id"), F.col("a_auth_asym_id").alias("first_chain"))


@query("O4_top_contributors", f"WITH {ATOMS}, r AS (SELECT auth_asym_id, res_seq, round(sum(bfactor), 6) AS bsa FROM heavy GROUP BY ALL) SELECT auth_asym_id, res_seq, bsa, place FROM (SELECT *, row_number() OVER (PARTITION BY ascii(auth_asym_id) % 2 ORDER BY bsa DESC, auth_asym_id, res_seq)::INT AS place FROM r) WHERE place <= 4")
def _o4(s, d):
    r = heavy(s, d).groupBy("structure_id", "auth_asym_id", "res_seq", "icode").agg(F.round(F.sum("bfactor"), 6).alias("bsa")).withColumn("side", F.ascii("auth_asym_id") % 2)
    return P.top_contributors(r).select("auth_asym_id", "res_seq", "bsa", "place")


@query("P25_residue_order", "SELECT p_partkey, (row_number() OVER (PARTITION BY p_size ORDER BY (p_partkey % 7 = 0)::INT, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 50 - 9 END, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END, p_partkey))::INT AS place FROM part")
def _p25(s, d):
    label = F.when(F.col("p_partkey") % 7 == 0, "?").otherwise(F.concat((F.col("p_partkey") % 50 - 9).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("")))
    p = read(s, d, "part").withColumn("label", label)
    return p.select("p_partkey", F.row_number().over(W.partitionBy("p_size").orderBy(P.residue_order("p_size", "label"), "p_partkey")).alias("place"))


@query("P31_operator_of", "SELECT vec_id, CASE WHEN vec_id % 3 = 2 OR vec_id % 24 <> 12 * (vec_id % 3) THEN NULL ELSE vec_id % 3 + 1 END::INT AS operator FROM embeddings")
def _p31(s, d):
    turn = F.when(F.col("vec_id") % 3 == 0, F.array(*map(F.lit, (1, 0, 0, 0, 1, 0, 0, 0, 1)))).when(F.col("vec_id") % 3 == 1, F.array(*map(F.lit, (-1, 0, 0, 0, -1, 0, 0, 0, 1)))).otherwise(F.array(*map(F.lit, (0, -1, 0, 1, 0, 0, 0, 0, 1))))
    placed = read(s, d, "embeddings").select("vec_id", F.lit("s").alias("structure_id"), F.lit("A").alias("asu"), turn.alias("rotation"), F.array(F.lit(24), F.lit(-48), F.col("vec_id").cast("int") - 240).alias("translation"))
    known = s.createDataFrame([("s", "A", [1, 0, 0, 0, 1, 0, 0, 0, 1], [0, 0, 0], 1), ("s", "A", [-1, 0, 0, 0, -1, 0, 0, 0, 1], [0, 24, 12], 2)], "structure_id string, asu string, rotation array<int>, translation array<int>, operator int")
    return P.operator_of(placed, known).select("vec_id", "operator")


@query("P36_provenance", f"SELECT r_regionkey, '{__version__}' AS version, 'first model only; no symmetry generation' AS coordinate_scope, 1.4::DOUBLE AS probe FROM region")
def _p36(s, d):
    return P.provenance(read(s, d, "region").select("r_regionkey"), probe=1.4, symmetry="none").select("r_regionkey", "provenance.version", "provenance.coordinate_scope", "provenance.probe")


@query("A30_bond_groups", "WITH b AS (SELECT l_suppkey AS r, l_returnflag AS type, l_linestatus || l_linenumber AS o, min(l_orderkey) AS first, count(*) AS n FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY ALL) SELECT r, type, string_agg(o, ', ' ORDER BY first, o) AS partners, sum(n)::BIGINT AS n FROM b GROUP BY r, type")
def _a30(s, d):
    b = read(s, d, "lineitem").where("l_orderkey % 5 = 0").select(F.col("l_suppkey").alias("r"), F.col("l_returnflag").alias("type"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("o"), "l_orderkey")
    return P.bond_groups(b, "r", "o", "l_orderkey")


@query("J7_contact_map_join", f"WITH {PAIRS.replace('< 5.0', '< 7.5')} SELECT m1, m2, count(*) AS n, round(min(d), 6) AS nearest FROM pairs GROUP BY ALL")
def _j7(s, d):
    return C.contacts(atoms(s, d), 7.5).groupBy(F.col("molecule_1").alias("m1"), F.col("molecule_2").alias("m2")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("distance"), 6).alias("nearest"))


@query("K8_heat_map", f"WITH {PAIRS}, k AS (SELECT m1, m2, ac, asq, bc, bsq, count(*) AS n FROM pairs GROUP BY ALL) SELECT m1, m2, (dense_rank() OVER (PARTITION BY m1, m2 ORDER BY ac, asq) - 1)::INT AS row, (dense_rank() OVER (PARTITION BY m1, m2 ORDER BY bc, bsq) - 1)::INT AS column, n FROM k")
def _k8(s, d):
    p = contact_pairs(s, d)
    g = p.groupBy("molecule_1", "molecule_2", *[F.col(f"{x}_{c}").alias(f"residue_{k}_{n}") for k, x in ((1, "a"), (2, "b")) for c, n in (("auth_asym_id", "chain"), ("res_seq", "seq"))]).agg(F.count(F.lit(1)).alias("n"))
    return export.heat_map(g, ("molecule_1", "molecule_2")).select(F.col("molecule_1").alias("m1"), F.col("molecule_2").alias("m2"), "row", "column", "n")


@query("K14_bars", f"WITH {ATOMS}, r AS (SELECT auth_asym_id, res_name, round(sum(bfactor), 6) AS v FROM heavy GROUP BY ALL) SELECT auth_asym_id, res_name, v, round(share, 8) AS share, place FROM (SELECT *, v / sum(v) OVER (PARTITION BY auth_asym_id) AS share, row_number() OVER (PARTITION BY auth_asym_id ORDER BY v DESC, res_name)::INT AS place FROM r) WHERE place <= 6")
def _k14(s, d):
    r = heavy(s, d).groupBy("auth_asym_id", "res_name").agg(F.round(F.sum("bfactor"), 6).alias("v"))
    return export.bars(r, ["auth_asym_id"], "v", "res_name", 6).select("auth_asym_id", "res_name", "v", F.round("share", 8).alias("share"), "place")


@query("K14_bond_network", f"WITH {PAIRS}, b AS (SELECT m1, m2, 'hbond' AS kind, ac, asq, bc, bsq, d FROM pairs WHERE {_HB} UNION ALL SELECT m1, m2, 'salt_bridge', ac, asq, bc, bsq, d FROM pairs WHERE {_SALT}) SELECT m1, m2, kind, ac || ':' || asq AS source, bc || ':' || bsq AS target, count(*) AS n, round(min(d), 6) AS shortest FROM b GROUP BY ALL")
def _k14n(s, d):
    from .functions import chem

    p = contact_pairs(s, d).withColumn("bond_types", F.array_compact(F.array(F.when(chem.is_hydrogen_bond(known=True), "hbond"), F.when(chem.is_salt_bridge(known=True), "salt_bridge"))))
    n = export.network(p, ["molecule_1", "molecule_2"])
    return n.select(F.col("molecule_1").alias("m1"), F.col("molecule_2").alias("m2"), "kind", F.col("from").alias("source"), F.col("to").alias("target"), "n", F.round("shortest", 6).alias("shortest"))


@query("K12_results_text", "SELECT s_suppkey, 'The interface between A and B buries ' || (s_suppkey % 900)::VARCHAR || ' A^2 with a solvation gain of -1.5 kcal/mol, 3 hydrogen bonds and 0 salt bridges' || CASE WHEN s_suppkey % 2 = 0 THEN '; it rests mainly on Arg1, Tyr2' ELSE '' END || '.' AS text FROM supplier")
def _k12(s, d):
    x = read(s, d, "supplier")
    hot = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("Arg1"), F.lit("Tyr2"))).otherwise(F.array().cast("array<string>"))
    return x.select("s_suppkey", export.results_text(F.lit("A"), F.lit("B"), (F.col("s_suppkey") % 900).cast("double"), F.lit(-1.5), F.lit(3), F.lit(0), hot).alias("text"))


# --- sequences and complexes -------------------------------------------------------------------------------------------------


@query("J20_residue_match", f"WITH {ATOMS}, r AS (SELECT auth_asym_id AS chain, res_seq AS seq, round(sum(bfactor), 6) AS ours FROM heavy GROUP BY ALL), t AS (SELECT chr((65 + label)::INT) AS chain, (vec_id // 8)::INT AS seq, count(*) AS theirs FROM embeddings WHERE vec_id % 3 = 0 GROUP BY ALL) SELECT chain, seq, ours, theirs FROM r JOIN t USING (chain, seq)")
def _j20(s, d):
    r = heavy(s, d).groupBy("structure_id", F.col("auth_asym_id").alias("chain"), F.col("res_seq").alias("seq"), "icode").agg(F.round(F.sum("bfactor"), 6).alias("ours"))
    t = atoms(s, d).where("atom_id % 3 = 0").groupBy("structure_id", F.col("auth_asym_id").alias("chain"), F.col("res_seq").alias("seq"), "icode").agg(F.count(F.lit(1)).alias("theirs"))
    return P.residue_match(r, t).select("chain", "seq", "ours", "theirs")


@query("J21_shared_chains")
def _j21(s, d):
    """Rows only: an assignment. Nations' names stand for sequences, regions for structures."""
    n = read(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("structure_id"), F.col("n_nationkey").cast("string").alias("chain"), F.col("n_name").alias("sequence"))
    return P.shared_chains(n.where("structure_id = '0'"), n).select("structure_id", "chain", "reference_chain", F.round("identity", 6).alias("identity"))


@query("J22_alignment", "SELECT c_custkey, 9 AS n, 100.0::DOUBLE AS identity, 0 AS first_i, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 0 END AS first_j FROM customer")
def _j22(s, d):
    """Sequences without a letter twice, one of them after three of its own: only one alignment is best."""
    c = read(s, d, "customer").select("c_custkey", F.lit("ACDEFGHIK").alias("sequence_1"), F.when(F.col("c_custkey") % 2 == 0, "WYVACDEFGHIK").otherwise("ACDEFGHIKWYV").alias("sequence_2"))
    return P.aligned(c).select("c_custkey", F.size("aligned").alias("n"), "identity", F.col("aligned")[0]["i"].alias("first_i"), F.col("aligned")[0]["j"].alias("first_j"))


_KEYS = """WITH r AS (SELECT (l_suppkey % 4)::VARCHAR AS complex, l_returnflag AS chain, l_linenumber AS seq, l_linestatus AS one FROM lineitem WHERE l_orderkey < 3000 GROUP BY ALL),
n AS (SELECT DISTINCT chain, seq, one AS named FROM r WHERE complex = '0' AND one = 'O'),
h AS (SELECT complex, avg(coalesce((named = one)::INT, 0)) AS agree FROM r LEFT JOIN n USING (chain, seq) GROUP BY complex)
SELECT complex, chain, seq, one, CASE WHEN agree < 0.6 AND seq % 2 = 0 THEN 'Z' || seq ELSE chain || ':' || one || seq END AS key FROM r JOIN h USING (complex)"""


@query("J23_residue_keys", _KEYS)
def _j23(s, d):
    x = read(s, d, "lineitem").where("l_orderkey < 3000")
    r = x.select((F.col("l_suppkey") % 4).cast("string").alias("complex"), F.col("l_returnflag").alias("chain"), F.col("l_linenumber").alias("seq"), F.lit("").alias("icode"), F.col("l_linestatus").alias("one")).distinct()
    a = r.where("seq % 2 = 0").select("complex", "chain", "seq", "icode", F.concat(F.lit("Z"), F.col("seq").cast("string")).alias("key")).distinct()
    return P.residue_keys(r, r.where("complex = '0' AND one = 'O'"), a).select("complex", "chain", "seq", "one", "key")


@query("J25_superposition", "SELECT label::VARCHAR AS complex, count(*) AS n, 0.0::DOUBLE AS rmsd, 5.0::DOUBLE AS shift_x, -1.0::DOUBLE AS turn_xy FROM embeddings GROUP BY label HAVING count(*) >= 4")
def _j25(s, d):
    """Atoms against the same atoms turned by a quarter about z and moved by (5, 6, 7)."""
    a = atoms(s, d).select(F.col("label").cast("string").alias("complex"), "x", "y", "z", (5 - F.col("y")).alias("u"), (6 + F.col("x")).alias("v"), (7 + F.col("z")).alias("w"))
    out = P.superposition(a).where("n >= 4")
    return out.select("complex", "n", F.abs(F.round("rmsd", 4)).alias("rmsd"), F.round(F.get("shift", F.lit(0)), 6).alias("shift_x"), F.round(F.get("rotation", F.lit(1)), 6).alias("turn_xy"))


@query("E5_against_first", "WITH g AS (SELECT n_name AS complex, round(sum(s_acctbal), 2) AS t, round(min(s_acctbal), 2) AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL) SELECT g.complex, round(g.t - f.t, 2) AS total_change, round(g.b - f.b, 2) AS side_change FROM g, (SELECT * FROM g ORDER BY complex LIMIT 1) f WHERE g.complex <> f.complex")
def _e5(s, d):
    x = read(s, d, "supplier").join(read(s, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    g = x.groupBy(F.col("n_name").alias("complex")).agg(F.round(F.sum("s_acctbal"), 2).alias("buried_total"), F.round(F.min("s_acctbal"), 2).alias("buried_side1"), F.count(F.lit(1)).alias("n_hbonds"), F.count(F.lit(1)).alias("n_salt_bridges"))
    return P.against_first(g, g.agg(F.min("complex")).first()[0] or "").select("complex", F.round("total_change", 2).alias("total_change"), F.round("side_change", 2).alias("side_change"))


@query("E10_shared_sides", "SELECT n_regionkey::VARCHAR AS structure_id, coalesce(string_agg(n_name, ' ' ORDER BY n_name) FILTER (n_nationkey % 3 = 0), '') AS group1, coalesce(string_agg(n_name, ' ' ORDER BY n_name) FILTER (n_nationkey % 3 = 1), '') AS group2 FROM nation GROUP BY n_regionkey")
def _e10(s, d):
    n = read(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("structure_id"), F.col("n_name").alias("chain"), F.when(F.col("n_nationkey") % 3 == 2, "Ligand").otherwise("Protein").alias("class"), "n_nationkey")
    out = P.shared_sides(n, n.where("n_nationkey % 3 = 0"))
    return out.select("structure_id", F.array_join("group1", " ").alias("group1"), F.array_join("group2", " ").alias("group2"))


# --- against references ------------------------------------------------------------------------------------------------------


def _placed(s, d):
    """Pairs of placed molecules: the second turned by a quarter, moved by what the id says."""
    e = read(s, d, "embeddings").where("vec_id < 400")
    flat = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    at = F.array(F.col("vec_id") * 3.0, F.lit(1.0), F.lit(2.0))
    both = P.relative_transform(flat(1, 0, 0, 0, 1, 0, 0, 0, 1), flat(0, 0, 0), flat(0, -1, 0, 1, 0, 0, 0, 0, 1), at)
    return e.select((F.col("vec_id") % 7).cast("string").alias("structure_id"), F.lit("A+B").alias("pair"), F.col("vec_id").alias("id"), both.alias("p")).select("structure_id", "pair", "id", "p.r", "p.t")


@query("J15_match_crystal", "SELECT vec_id AS their_id, vec_id AS our_id, 0.25::DOUBLE AS cost FROM embeddings WHERE vec_id < 400 AND vec_id % 5 <> 0")
def _j15(s, d):
    """Ours are theirs moved by a quarter, every other one seen from its other end; every fifth is not there."""
    theirs = _placed(s, d)
    ours = theirs.where("id % 5 <> 0").withColumn("t", F.transform("t", lambda v, i: F.when(i == 1, v + 0.25).otherwise(v)))
    r, t = P._seen_back(F.col("r"), F.col("t"))
    other = F.col("id") % 2 == 0
    ours = ours.select("structure_id", "pair", "id", F.when(other, r).otherwise(F.col("r")).alias("r"), F.when(other, t).otherwise(F.col("t")).alias("t"))
    return P.match_crystal(ours, theirs).select("their_id", "our_id", F.round("cost", 6).alias("cost"))


_M = "m AS (SELECT l_extendedprice / 100 AS area_ref, l_extendedprice / 100 * (1 + l_tax) AS area, l_discount AS dg_ref, l_discount + l_tax AS dg, l_suppkey FROM lineitem)"


def _matched(s, d):
    x = read(s, d, "lineitem")
    return x.select((F.col("l_extendedprice") / 100).alias("area_ref"), (F.col("l_extendedprice") / 100 * (1 + F.col("l_tax"))).alias("area"), F.col("l_discount").alias("dg_ref"), (F.col("l_discount") + F.col("l_tax")).alias("dg"))


def _entries(s, d):
    x = read(s, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("structure_id")).agg(F.count(F.lit(1)).alias("n_reference"), F.count_if(F.col("l_linenumber") < 6).alias("n_matched"))
    return x.withColumn("n_reported", F.col("n_reference") + 1)


@query("A18_crystal_summary", f"WITH {_M} SELECT (SELECT count(DISTINCT l_suppkey) FROM m) AS n_entries, count(*) AS matched, round(median(CASE WHEN area_ref > 100 THEN abs(area - area_ref) / greatest(area_ref, 1) END), 8) AS area_median_relative, round(corr(dg, dg_ref), 8) AS dg_pearson, round(median(abs(dg - dg_ref)), 8) AS dg_median_absolute, 1.0::DOUBLE AS match_rate FROM m")
def _a18(s, d):
    out = P.summarize_crystal(_matched(s, d), _entries(s, d))
    return out.select("n_entries", "matched", *[F.round(c, 8).alias(c) for c in ("area_median_relative", "dg_pearson", "dg_median_absolute", "match_rate")])


@query("A28_worst_entries", "SELECT l_suppkey::VARCHAR AS structure_id, round(count(*) FILTER (l_linenumber < 6) / count(*), 8) AS rate FROM lineitem GROUP BY l_suppkey ORDER BY count(*) FILTER (l_linenumber < 6) / count(*), l_suppkey::VARCHAR LIMIT 10")
def _a28(s, d):
    return P.blind_summary(_matched(s, d), _entries(s, d))[1].select("structure_id", F.round("rate", 8).alias("rate"))


def _assemblies(s, d):
    o = read(s, d, "supplier").select((F.col("s_suppkey") % 40).cast("string").alias("structure_id"), F.col("s_suppkey").alias("rank"), (F.col("s_nationkey") % 6 + 1).cast("int").alias("mmsize"), F.col("s_acctbal").alias("dissociation_energy"))
    t = read(s, d, "customer").where("c_custkey % 50 < 35").select((F.col("c_custkey") % 50).cast("string").alias("structure_id"), F.lit(1).alias("set_no"), F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 6).cast("int").alias("mmsize"), (F.col("c_custkey") % 3 == 0).alias("by_author"))
    one = lambda x: x.withColumn("counts", F.create_map(F.lit("A"), F.col("mmsize")))
    return P.compare_assemblies(one(o), one(t), s.range(50).select(F.col("id").cast("string").alias("structure_id")))


_ASM = """o AS (SELECT (s_suppkey % 40)::VARCHAR AS k, s_suppkey AS rank, (s_nationkey % 6 + 1)::INT AS m, s_acctbal AS e FROM supplier),
t AS (SELECT (c_custkey % 50)::VARCHAR AS k, c_custkey AS id, (c_nationkey % 6)::INT AS m, c_custkey % 3 = 0 AS author FROM customer WHERE c_custkey % 50 < 35),
a AS (SELECT k, arg_min(m, rank) AS first, list_distinct(list(m)) AS sizes, max(e) AS best, count(*) AS n FROM o GROUP BY k),
b AS (SELECT k, arg_min(m, id) AS first, coalesce(list_distinct(list(m) FILTER (m > 0)), []) AS sizes, arg_min(m, id) FILTER (author) AS author, bool_or(author) AS any_author, count(*) AS n FROM t GROUP BY k),
x AS (SELECT i::VARCHAR AS structure_id, b.k IS NOT NULL AS comparable, coalesce(a.n, 0) AS n_ours, coalesce(b.n, 0) AS n_theirs, coalesce(a.first = b.first, false) AS size_match, CASE WHEN b.any_author THEN coalesce(a.first = b.author, false) END AS author_match,
  CASE WHEN len(b.sizes) > 0 THEN coalesce(len(list_intersect(a.sizes, b.sizes)), 0) / len(b.sizes) END AS recall, CASE WHEN len(a.sizes) > 0 THEN coalesce(len(list_intersect(a.sizes, b.sizes)), 0) / len(a.sizes) END AS precision, NOT coalesce(a.best > 0, false) AS nothing_stable
  FROM range(50) r(i) LEFT JOIN a ON a.k = i::VARCHAR LEFT JOIN b ON b.k = i::VARCHAR)"""


@query("J16_compare_assemblies", f"WITH {_ASM} SELECT structure_id, comparable, n_ours, n_theirs, size_match, size_match AS composition_match, author_match, round(recall, 8) AS recall, round(precision, 8) AS precision, nothing_stable FROM x")
def _j16(s, d):
    return _assemblies(s, d).withColumns({c: F.round(c, 8) for c in ("recall", "precision")})


@query("A19_assembly_summary", f"WITH {_ASM} SELECT count(*) AS n_entries, count(*) FILTER (comparable) AS n_comparable, count(author_match) AS n_with_author, round(avg(size_match::INT) FILTER (comparable), 8) AS size_match_rate, round(avg(author_match::INT), 8) AS author_match_rate, round(avg(recall) FILTER (comparable), 8) AS mean_recall, round(avg(precision) FILTER (comparable), 8) AS mean_precision, round(avg(nothing_stable::INT) FILTER (NOT comparable), 8) AS nothing_stable_rate FROM x")
def _a19(s, d):
    out = P.summarize_assemblies(_assemblies(s, d))
    return out.select("n_entries", "n_comparable", "n_with_author", *[F.round(c, 8).alias(c) for c in ("size_match_rate", "author_match_rate", "mean_recall", "mean_precision", "nothing_stable_rate")])


def _audit(s, d):
    x = read(s, d, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("a1"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("a2"), F.col("l_quantity").cast("double").alias("distance"))
    facts = x.where("l_linenumber % 4 <> 0").select("k", "a1", "a2", "distance", (F.col("l_linenumber") % 3 != 0).alias("roles"), (F.col("l_linenumber") != 1).alias("metal")).groupBy("k", "a1", "a2").agg(F.lit(True).alias("distance"), F.every("roles").alias("roles"), F.every("metal").alias("metal"))
    facts = facts.withColumns({"angle": F.lit(True), "hydrogen": F.lit(None).cast("boolean")})
    swapped = x.where("l_linenumber % 2 = 0").select("k", F.col("a2").alias("a1"), F.col("a1").alias("a2"), "distance")
    return P.bond_audit(swapped.unionByName(x.where("l_linenumber = 5").drop("l_linenumber")), x.where("l_linenumber <= 4").drop("l_linenumber"), ["k"], facts)


_AUDIT = """x AS (SELECT l_orderkey AS k, l_linenumber AS n, 'P' || l_partkey AS a1, 'S' || l_suppkey AS a2, l_quantity::DOUBLE AS d FROM lineitem WHERE l_orderkey % 3 = 0),
o AS (SELECT k, a1, a2, min(d) AS our_distance FROM x WHERE n % 2 = 0 OR n = 5 GROUP BY ALL), t AS (SELECT k, a1, a2, min(d) AS their_distance FROM x WHERE n <= 4 GROUP BY ALL),
f AS (SELECT k, a1, a2, bool_and(n % 3 <> 0) AS roles, bool_and(n <> 1) AS metal FROM x WHERE n % 4 <> 0 GROUP BY ALL),
u AS (SELECT k, a1, a2, our_distance, their_distance, CASE WHEN their_distance IS NULL THEN 'extra' WHEN our_distance IS NULL THEN 'missed' ELSE 'matched' END AS status FROM o FULL JOIN t USING (k, a1, a2)),
a AS (SELECT u.*, CASE WHEN status = 'missed' THEN CASE WHEN f.k IS NULL THEN 'atom not in model' WHEN NOT roles THEN 'no donor/acceptor role' WHEN NOT metal THEN 'metal-coordinated' ELSE 'capacity' END END AS reason FROM u LEFT JOIN f USING (k, a1, a2))"""


@query("J17_bond_audit", f"WITH {_AUDIT} SELECT k, a1, a2, our_distance, their_distance, status, reason FROM a")
def _j17(s, d):
    return _audit(s, d)


@query("A20_audit_summary", f"WITH {_AUDIT} SELECT count(their_distance) AS n_ref, count(our_distance) AS n_ours, count(*) FILTER (status = 'matched') AS n_matched, round(count(*) FILTER (status = 'matched') / count(our_distance), 8) AS precision, round(count(*) FILTER (status = 'matched') / count(their_distance), 8) AS recall, round(quantile_cont(their_distance, 0.5) FILTER (status = 'missed'), 8) AS missed_median FROM a")
def _a20(s, d):
    out = P.audit_summary(_audit(s, d))
    return out.select("n_ref", "n_ours", "n_matched", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), F.round(F.get("missed_quartiles", F.lit(1)), 8).alias("missed_median"))


@query("A20_audit_reasons", f"WITH {_AUDIT} SELECT reason, count(*) AS n FROM a WHERE status = 'missed' GROUP BY reason ORDER BY n DESC, reason LIMIT 12")
def _a20r(s, d):
    return P.audit_counts(_audit(s, d), "reason", "missed")


@query("A23_regroup", f"WITH {ATOMS} SELECT auth_asym_id, CASE WHEN element IN ('N', 'O') THEN 'polar' ELSE element END AS class, round(sum(bfactor), 6) AS area FROM heavy GROUP BY ALL")
def _a23(s, d):
    e = heavy(s, d).groupBy("auth_asym_id", "element").agg(F.sum("bfactor").alias("v")).groupBy("auth_asym_id").agg(F.map_from_entries(F.collect_list(F.struct("element", "v"))).alias("areas"))
    return P.regroup(e, ["auth_asym_id"], "areas", {"N": "polar", "O": "polar"}).select("auth_asym_id", F.explode("areas").alias("class", "area")).withColumn("area", F.round("area", 6))


_RT = tables.GAS_CONSTANT * tables.TEMPERATURE


@query("A27_entropy_constant", f"WITH p AS (SELECT l_linenumber * {_RT!r}::DOUBLE AS x, l_extendedprice / 1000 - l_tax AS y FROM lineitem) SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 6) AS constant, round(median(abs(y)), 6) AS median_rest FROM p")
def _a27(s, d):
    x = read(s, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("known"), F.col("l_tax").alias("rest"), (F.col("l_linenumber") + 1).alias("bodies"))
    return P.entropy_constant(x).select("n", F.round("constant", 6).alias("constant"), F.round("median_rest", 6).alias("median_rest"))


# --- sources -----------------------------------------------------------------------------------------------------------------


@query("S16_sampling_frame", "SELECT pdb_id, cluster FROM (SELECT p_partkey::VARCHAR AS pdb_id, p_partkey % 50 AS cluster, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_size / 10.0, p_partkey::VARCHAR) AS k FROM part WHERE p_size / 10.0 <= 3.0 AND p_partkey % 4 >= 2 AND p_partkey % 3 <> 0) WHERE k = 1")
def _s16(s, d):
    p = read(s, d, "part").select(F.col("p_partkey").cast("string").alias("pdb_id"), (F.col("p_partkey") % 50).alias("cluster"), F.when(F.col("p_partkey") % 3 == 0, "SOLUTION NMR").otherwise(archive.METHOD).alias("method"), (F.col("p_size") / 10.0).cast("double").alias("resolution"), (F.col("p_partkey") % 4).alias("polymer_chains"), F.lit(500).alias("atoms"), F.lit("2010-01-01").alias("released"))
    return archive.sampling_frame(p).select("pdb_id", "cluster")


@query("S1_atom_records", "SELECT vec_id::INT AS line_no, chr((65 + label)::INT) AS chain_id, (vec_id % 9000)::INT AS res_seq, round(embedding[1]::DOUBLE * 40, 3) AS x, round(embedding[2]::DOUBLE * 40, 3) AS y, round(embedding[3]::DOUBLE * 40, 3) AS z, 'CA' AS atom_name, 'C' AS element FROM embeddings")
def _s1(s, d):
    xyz = [F.round(F.get("embedding", F.lit(i)).cast("double") * 40, 3) for i in range(3)]
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00 10.00           C  ", F.col("vec_id") % 99999, F.char(F.col("label") + 65), F.col("vec_id") % 9000, *xyz)
    lines = read(s, d, "embeddings").select(F.lit("s").alias("structure_id"), F.col("vec_id").cast("int").alias("line_no"), F.lit("ATOM").alias("record"), line.alias("line"))
    return pdb.parse_atoms(lines).select("line_no", "chain_id", "res_seq", "x", "y", "z", "atom_name", "element")


@query("S4_cell_records", "SELECT p_partkey, p_size + 0.5::DOUBLE AS a, 90.0::DOUBLE AS alpha, CASE WHEN p_partkey % 3 > 0 THEN 'P 21 21 21' END AS space_group, CASE WHEN p_partkey % 3 = 2 THEN 4 END AS z FROM part")
def _s4(s, d):
    whole = F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 21 21 21    4", F.col("p_size") + F.lit(0.5), F.lit(20.0), F.lit(30.0), F.lit(90.0), F.lit(90.0), F.lit(90.0))
    cut = F.substr(whole, F.lit(1), F.when(F.col("p_partkey") % 3 == 0, 54).when(F.col("p_partkey") % 3 == 1, 66).otherwise(70))
    return read(s, d, "part").select("p_partkey", cut.alias("line")).select("p_partkey", pdb.parse_cryst1("line").alias("c")).select("p_partkey", "c.a", "c.alpha", "c.space_group", "c.z")


@query("O2_largest", "SELECT l_orderkey, l_linenumber, l_extendedprice AS area FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def _o2(s, d):
    from types import SimpleNamespace

    from .engine import StructureEngine

    faces = read(s, d, "lineitem").select(F.col("l_extendedprice").alias("interface_area"), F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("interface_id"))
    return StructureEngine(s).largest(SimpleNamespace(interfaces=faces), 25).select(F.col("structure_id").alias("l_orderkey"), F.col("interface_id").alias("l_linenumber"), F.col("interface_area").alias("area"))


# --- the analysis itself, over surfaces that the ids give ------------------------------------------------------------------------


def _analysis(s, d):
    """The whole analysis with a surface that is not integrated but follows from the ids, so that SQL can follow it too."""
    from .plans.analysis import Analysis

    a = atoms(s, d).withColumns({"molecule_class": F.lit("Protein"), "molecule_label": F.col("auth_asym_id"), "chain_type": F.lit("polymer"), "ccd_id": F.lit(None).cast("string"), "label_comp_id": F.col("res_name")})
    out = Analysis(a.drop("label"))
    alone = (F.col("atom_id") % 40) * 1.5
    pairs = F.when(F.col("molecule_id").isNotNull(), F.array(F.struct(((F.col("molecule_id") + 1) % 10).cast("int").alias("molecule"), (alone * (F.col("atom_id") % 4) / 8).alias("buried")))).otherwise(F.array())
    kept = out.assigned.where("element NOT IN ('H', 'D')")
    out.__dict__["surface"] = kept.select("structure_id", "atom_id", "molecule_id", F.lit(1.5).alias("radius"), (alone * (F.col("atom_id") % 3) / 3).alias("asa_combined"), alone.alias("asa_alone"), pairs.alias("pairs"))
    return out


_SURFACE = f"""{ATOMS}, v AS (SELECT *, (atom_id % 40) * 1.5::DOUBLE AS alone, (atom_id % 40) * 1.5::DOUBLE * (atom_id % 3) / 3 AS combined FROM heavy),
ty AS (SELECT *, {_CLASS} AS c, {_FINE} AS f FROM v), sg AS (SELECT *, {_SIGMA} AS sigma FROM ty),
b AS (SELECT *, least(molecule_id, (molecule_id + 1) % 10) AS m1, greatest(molecule_id, (molecule_id + 1) % 10) AS m2, alone * (atom_id % 4) / 8 AS buried FROM sg WHERE molecule_id IS NOT NULL AND alone * (atom_id % 4) / 8 > 1e-6)"""


@query("A1_buried_surface", f"WITH {_SURFACE} SELECT atom_id, round(CASE WHEN molecule_id IS NULL THEN 0 ELSE greatest(alone - combined, 0) END, 6) AS bsa FROM v")
def _a1(s, d):
    from .operators import surface

    return surface.buried_surface(_analysis(s, d).surface).select("atom_id", F.round("bsa", 6).alias("bsa"))


@query("A1_totals", f"WITH {_SURFACE} SELECT round(sum(combined), 4) AS assembly_asa, round(greatest(coalesce(sum(alone) FILTER (molecule_id IS NOT NULL), 0) - sum(combined), 0), 4) AS assembly_bsa FROM v")
def _a1t(s, d):
    return _analysis(s, d).totals.select(F.round("assembly_asa", 4).alias("assembly_asa"), F.round("assembly_bsa", 4).alias("assembly_bsa"))


@query("A2_pair_burial", f"WITH {_SURFACE} SELECT m1, m2, atom_id, molecule_id, round(buried, 6) AS buried FROM b")
def _a2(s, d):
    return _analysis(s, d).burial.select(F.col("molecule_1").alias("m1"), F.col("molecule_2").alias("m2"), "atom_id", "molecule_id", F.round("buried", 6).alias("buried"))


_APOLAR = "(c LIKE 'C%' OR c LIKE 'S%' OR c LIKE 'NA\\_C%' ESCAPE '\\')"


@query(
    "A3_interface_energies",
    f"WITH {_SURFACE}, e AS (SELECT m1, m2, sum(buried) / 2 AS area, sum(sigma * buried) AS solv, sum(CASE WHEN {_APOLAR} THEN sigma * buried ELSE 0 END) AS apolar FROM b GROUP BY ALL), "
    "t AS (SELECT a.molecule_id AS m1, b.molecule_id AS m2, count(*) AS n FROM heavy a JOIN heavy b ON a.molecule_id < b.molecule_id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 5.0 GROUP BY ALL), "
    "u AS (SELECT m1, m2, coalesce(area, 0) AS area, coalesce(solv, 0) AS solv, coalesce(apolar, 0) AS apolar, coalesce(n, 0) AS n FROM e FULL JOIN t USING (m1, m2)) "
    "SELECT m1, m2, round_even(area, 2) AS area, round_even(solv, 2) + 0 AS solvation, round_even(apolar, 2) + 0 AS apolar, (row_number() OVER (ORDER BY m1, m2))::INT AS interface_id FROM u WHERE area >= 0.01 OR n > 0",
)
def _a3(s, d):
    made = [(F.col(c) + 0.0).alias(n) for c, n in (("interface_area", "area"), ("solvation_energy", "solvation"), ("solvation_energy_apolar", "apolar"))]
    return _analysis(s, d).interfaces.select(F.col("molecule_1").alias("m1"), F.col("molecule_2").alias("m2"), *made, "interface_id")


@query("A9_surface_moments", f"WITH {_SURFACE} SELECT molecule_id, round(sum(alone), 4) AS w, round(sum(alone * sigma), 4) AS ws, round(sum(alone * sigma * sigma), 6) AS wss FROM sg WHERE molecule_id IS NOT NULL AND alone > 0 GROUP BY ALL")
def _a9(s, d):
    return _analysis(s, d).surface_moments.select("molecule_id", F.round("w", 4).alias("w"), F.round("ws", 4).alias("ws"), F.round("wss", 6).alias("wss"))


@query("A10_calibration", f"WITH {_SURFACE} SELECT m1, m2, c AS class, round(sum(buried), 4) AS area FROM b GROUP BY ALL")
def _a10(s, d):
    c = _analysis(s, d).calibration.select("molecule_1", "molecule_2", F.explode("bsa_by_class").alias("class", "area"))
    return c.select(F.col("molecule_1").alias("m1"), F.col("molecule_2").alias("m2"), "class", F.round("area", 4).alias("area"))


@query(
    "A4_residue_surface",
    f"WITH {_SURFACE}, k AS (SELECT DISTINCT m1, m2, molecule_id, auth_asym_id, res_seq FROM b) SELECT k.m1, k.m2, k.molecule_id, k.auth_asym_id, k.res_seq, round(sum(round_even(sg.alone, 2)), 2) AS asa, round(sum(round_even(coalesce(b.buried, 0), 2)), 2) AS bsa "
    "FROM k JOIN sg USING (molecule_id, auth_asym_id, res_seq) LEFT JOIN b ON b.m1 = k.m1 AND b.m2 = k.m2 AND b.atom_id = sg.atom_id GROUP BY ALL",
)
def _a4(s, d):
    from .operators import surface

    a = _analysis(s, d)
    r = surface.residue_surface(a.assigned.where("element NOT IN ('H', 'D')"), a.surface, a.burial)
    return r.select(F.col("molecule_1").alias("m1"), F.col("molecule_2").alias("m2"), "molecule_id", "auth_asym_id", "res_seq", "asa", "bsa")


# --- what had no SQL before --------------------------------------------------------------------------------------------------

#: The error function's series; at the arguments here forty terms are exact.
_ERF = "list_sum(list_transform(range(0, 40), lambda k: CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END * pow(u, 2 * k + 1) / ((2 * k + 1) * gamma(k + 1)))) * 2 / sqrt(pi())"
SQL["P30_p_value"] = f"SELECT l_orderkey, l_linenumber, round(0.5 + 0.5 * {_ERF}, 6) AS p FROM (SELECT l_orderkey, l_linenumber, (l_quantity / 10 - 2.5)::DOUBLE / sqrt(2) AS u FROM lineitem)"
SQL["A16_rings"] = "SELECT vec_id::INT AS res_seq, vec_id * 10.0::DOUBLE AS cx, 1.0::DOUBLE AS nz FROM embeddings"

# Orders of space groups by their symbols: copies of a lattice point times the order of the point group.
_LATTICE = {"P": 1, "A": 2, "B": 2, "C": 2, "I": 2, "F": 4, "R": 3, "H": 3}
_POINT = {"-1": 2, "1": 1, "2": 2, "121": 2, "112": 2, "211": 2, "222": 4, "3": 3, "32": 6, "321": 6, "312": 6, "4": 4, "422": 8, "6": 6, "622": 12, "23": 12, "432": 24}


def _order(symbol: str) -> int:
    lattice, *axes = symbol.replace(":H", "").split()
    return _LATTICE[lattice] * _POINT["".join(a[: 2 if a[0] == "-" else 1] for a in axes)]


_SYMBOLS = sorted({row.split(":")[0] for row in crystal.SPACE_GROUPS.strip().splitlines()})
SQL["C6_space_groups"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {_order(n)}::BIGINT)" for n in _SYMBOLS) + ") t(space_group, operators)"
