"""PDB text as tables: atoms, structures, declared polymer residues. Built-in functions only; files stay splittable by structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chem

#: Suffixes of files that are read as mmCIF, and of all structure files.
CIF_SUFFIXES = r"(?i)\.(cif|mmcif)(\.gz)?$"
STRUCTURE_SUFFIXES = r"(?i)\.(pdb|ent|cif|mmcif)(\.gz)?$"


def is_cif_path(path) -> Column:
    return chem.col(path).rlike(CIF_SUFFIXES)


def structure_id_of(path) -> Column:
    """The file's name without folders and suffixes."""
    return F.regexp_replace(F.element_at(F.split(chem.col(path), "/"), -1), STRUCTURE_SUFFIXES, "")


def read_files(spark: SparkSession, *paths: str, recursive: bool = True) -> DataFrame:
    """structure_id, path and text of each structure file under the paths (files, folders, globs); .gz is unpacked by the reader.

    A structure goes by its file's name; files of one name in several folders, or formats, by their whole paths, so that none are taken for one."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(list(paths), wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = raw.where(F.col("path").rlike(STRUCTURE_SUFFIXES)).dropDuplicates(["path"]).withColumn("name", structure_id_of("path"))
    # Which names come more than once is found from paths alone, before any text is read.
    twice = files.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(True).alias("several"))
    return files.join(twice, "name", "left").select(F.when(F.col("several"), F.col("path")).otherwise(F.col("name")).alias("structure_id"), "path", "text")


def decode_sequence_number(field) -> Column:
    """Residue numbers as decimal or hybrid-36 (A000 is 10000; lower case goes on after ZZZZ); null if unreadable."""
    t = F.trim(chem.col(field))
    value = F.conv(F.upper(t), 36, 10).cast("long") - F.lit(10 * 36**3) + F.lit(10**4)
    lower = F.when(F.substring(t, 1, 1).rlike("[a-z]"), F.lit(26 * 36**3)).otherwise(F.lit(0))
    plain = t.try_cast("int")
    return F.when(t.rlike(r"^[+-]?\d+$"), plain).when(t.rlike("^[0-9A-Za-z]{1,4}$"), (value + lower).cast("int"))


def _field(line: str, start: int, end: int) -> Column:
    """Columns start to end (counted from 1, both included), trimmed."""
    return F.trim(F.substring(F.col(line), start, end - start + 1))


def parse_cryst1(line: str = "line") -> Column:
    """Cell and space group of a CRYST1 record; each field is read for itself, so a cut record gives what it has."""
    number = lambda a, b, kind="double": F.nullif(_field(line, a, b), F.lit("")).try_cast(kind)
    return F.struct(
        number(7, 15).alias("a"), number(16, 24).alias("b"), number(25, 33).alias("c"), number(34, 40).alias("alpha"), number(41, 47).alias("beta"), number(48, 54).alias("gamma"),
        F.nullif(_field(line, 56, 66), F.lit("")).alias("space_group"), number(67, 70, "int").alias("z"),
    )


def lines_of(files: DataFrame) -> DataFrame:
    """structure_id, line_no (from 1), record and line of each file's first model.

    The first model ends at its ENDMDL or the next MODEL; it is found inside the file's own array of lines, without a shuffle."""
    kinds = F.transform(F.col("lines"), lambda x: F.trim(F.substring(x, 1, 6)))
    d = files.select("structure_id", F.split("text", "\r?\n").alias("lines")).withColumn("kinds", kinds)
    models = F.filter(F.transform("kinds", lambda k, i: F.when(k == "MODEL", i)), lambda i: i.isNotNull())
    d = d.withColumn("models", models)
    ends = F.filter(F.transform("kinds", lambda k, i: F.when((k == "ENDMDL") & (i > F.get("models", F.lit(0))), i)), lambda i: i.isNotNull())
    stop = F.least(F.coalesce(F.get("models", F.lit(1)), F.size("lines")), F.coalesce(F.get(ends, F.lit(0)), F.size("lines")))
    d = d.select("structure_id", F.posexplode(F.slice("lines", F.lit(1), stop)).alias("pos", "line"))
    return d.select("structure_id", (F.col("pos") + 1).alias("line_no"), _field("line", 1, 6).alias("record"), "line")


def parse_atoms(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Atom records as rows, in file order, with `problem` naming the line where one cannot be read.

    strict: such a record is an error; otherwise it comes back with its problem and the caller decides (see errors_of)."""
    d = lines.where(F.col("record").isin("ATOM", "HETATM"))
    number = lambda a, b: F.nullif(_field("line", a, b), F.lit("")).try_cast("double")
    d = d.select(
        "structure_id", "line_no", F.col("record").alias("group"), F.col("line"),
        _field("line", 13, 16).alias("atom_name"), F.coalesce(F.nullif(_field("line", 17, 17), F.lit("")), F.lit(" ")).alias("altloc"), _field("line", 18, 20).alias("res_name"),
        _field("line", 22, 22).alias("chain_id"), decode_sequence_number(F.substring("line", 23, 4)).alias("res_seq"), _field("line", 27, 27).alias("icode"),
        number(31, 38).alias("x"), number(39, 46).alias("y"), number(47, 54).alias("z"),
        F.coalesce(number(55, 60), F.lit(1.0)).alias("occupancy"), F.coalesce(number(61, 66), F.lit(0.0)).alias("bfactor"), F.upper(_field("line", 77, 78)).alias("element"),
    )
    at = F.concat(F.lit(" at line "), F.col("line_no").cast("string"))
    problem = (
        F.when(F.length("line") < 54, F.concat(F.lit("truncated atom record"), at))
        .when(F.col("res_seq").isNull(), F.concat(F.lit("unreadable residue number"), at))
        .when(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), F.concat(F.lit("unreadable coordinates"), at))
        .when(F.col("element") == "", F.concat(F.lit("blank element columns"), at))
    )
    if strict:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat(F.col("structure_id"), F.lit(": "), problem)).cast("string"))
    d = d.withColumn("problem", problem).drop("line")
    if strict:  # a use of the column, so that the check is not pruned
        d = d.where(F.col("problem").isNull())
    return d.select(
        "structure_id", "line_no", "group", "atom_name", "altloc", "res_name", "chain_id", "res_seq", "icode", "x", "y", "z", "occupancy", "bfactor", "element",
        F.col("chain_id").alias("label_asym_id"), F.col("res_seq").alias("label_seq_id"), F.col("res_name").alias("label_comp_id"),
        F.col("chain_id").alias("auth_asym_id"), F.col("res_seq").alias("auth_seq_id"), "problem",
    )


def errors_of(atoms: DataFrame) -> DataFrame:
    """structure_id and error of structures with an unreadable record: the first one."""
    return atoms.where("problem IS NOT NULL").groupBy("structure_id").agg(F.min_by("problem", "line_no").alias("error"))


def select_altlocs(atoms: DataFrame) -> DataFrame:
    """One alternate conformer for each residue: the lettered one of highest total occupancy, then of the first letter.

    Blank ones are shared by all and stay. Of atoms that then share a name in a residue the blank one stays, else the one of
    higher occupancy, else the first. The winner's residue name holds for the whole residue."""
    res = ["structure_id", "auth_asym_id", "label_asym_id", "auth_seq_id", "label_seq_id", "icode"]
    w = W.partitionBy(*res)
    lettered = F.col("altloc") != " "
    d = atoms.withColumn("_total", F.when(lettered, F.sum("occupancy").over(W.partitionBy(*res, "altloc"))))
    best = F.max(F.when(lettered, F.col("_total"))).over(w)
    d = d.withColumn("_best", best)
    d = d.withColumn("_win", F.min(F.when(lettered & (F.col("_total") == F.col("_best")), F.col("altloc"))).over(w))
    d = d.where(~lettered | (F.col("altloc") == F.col("_win")))
    first = W.partitionBy(*res, "atom_name").orderBy((F.col("altloc") != " ").cast("int"), F.desc("occupancy"), "line_no")
    d = d.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    for c in ("res_name", "label_comp_id"):
        last = F.max_by(F.when(lettered, F.col(c)), F.when(lettered, F.col("line_no"))).over(w)
        d = d.withColumn(c, F.coalesce(last, F.col(c)))
    return d.drop("_total", "_best", "_win", "_k")


def number_atoms(atoms: DataFrame) -> DataFrame:
    """atom_id (from 0) in the order of chains as first seen, then residue number, insertion code, atom name."""
    w = W.partitionBy("structure_id")
    d = atoms.withColumn("chain_order", F.min("line_no").over(W.partitionBy("structure_id", "chain_id")))
    return d.withColumn("atom_id", F.row_number().over(w.orderBy("chain_order", "res_seq", "icode", "atom_name", "line_no")) - 1)


def chains_of(atoms: DataFrame) -> DataFrame:
    """One row per chain: its order, atoms, residues, and group (ligand once any residue is not standard)."""
    return atoms.groupBy("structure_id", "chain_id").agg(
        F.min("chain_order").alias("chain_order"), F.count(F.lit(1)).alias("n_atoms"), F.count_distinct("res_seq", "icode").alias("n_residues"),
        F.when(F.min(chem.is_standard("res_name").cast("int")) == 1, "polymer").otherwise("ligand").alias("group"),
    )


def structures_of(lines: DataFrame) -> DataFrame:
    """One row per structure: source, cell and space group, and the polymer residues that SEQRES declares (never water)."""
    names = F.filter(F.split(F.upper(F.trim(F.substring("line", 20, 51))), r"\s+"), lambda x: (x != "") & ~chem.is_water(x))
    d = lines.where(F.col("record").isin("HEADER", "CRYST1", "SEQRES")).select(
        "structure_id", F.when(F.col("record") == "HEADER", _field("line", 11, 70)).alias("source"), F.when(F.col("record") == "CRYST1", parse_cryst1()).alias("cell"),
        F.when(F.col("record") == "SEQRES", names).alias("names"), "line_no",
    )
    d = d.groupBy("structure_id").agg(F.max_by("source", F.when(F.col("source").isNotNull(), F.col("line_no"))).alias("source"), F.max_by("cell", F.when(F.col("cell").isNotNull(), F.col("line_no"))).alias("cell"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("polymer_residues"))
    return d.select("structure_id", "source", "cell.space_group", F.col("cell").dropFields("space_group").alias("cell"), "polymer_residues")


def read_pdb(spark: SparkSession, *paths: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(atoms, structures) of PDB files. Not strict: structures with an unreadable record keep their rows' problems."""
    lines = lines_of(read_files(spark, *paths))
    atoms = number_atoms(select_altlocs(parse_atoms(lines, strict)))
    structures = lines.select("structure_id").distinct().join(structures_of(lines), "structure_id", "left")
    return atoms, structures
