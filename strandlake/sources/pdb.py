"""Fixed-width structure files: scans by column expressions, and a writer.

Lines are numbered inside a file by reading it whole, as atom order decides which record wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import vec as v
from ..operators.geometry import EPSILON, bond_strand, pseudo_strand

# Nucleotide residue names and those of them that are purines.
NUCLEOTIDES = ["A", "G", "C", "U", "ADE", "GUA", "CYT", "URA", "DA", "DG", "DC", "DT"]
PURINES = ["A", "G", "ADE", "GUA", "DA", "DG"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of every line of the files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def from_text(df: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """path, line_no, line of files held in a column."""
    return df.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def _cut(a: int, b: int) -> Column:
    return F.substring("line", a, b - a + 1)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """By the session's number of partitions: adaptive execution would merge them until a task sorts a share of all lines that only the cores bound."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Line numbers of a block of a file, as a power of two.
BLOCK_BITS = 16


def models(rows: DataFrame) -> DataFrame:
    """``rows`` with the model number of closed MODEL blocks; a file without any MODEL is one model, and an open block is left out.

    Lines meet in blocks of 65536 line numbers. What goes over the edges of blocks (how many models are before, and whether the
    models at both ends are closed) comes from one small row for each block, so no task holds a file.
    """
    block = F.shiftright(F.col("line_no").cast("long"), BLOCK_BITS)
    opens, ends = F.coalesce(F.col("line").startswith("MODEL"), F.lit(False)), F.coalesce(F.col("line").startswith("ENDMDL"), F.lit(False))
    of = rows.groupBy(F.col("path").alias("_path"), block.alias("_at")).agg(
        F.count_if(opens).alias("_count"), *[f(F.when(when, F.col("line_no"))).alias(n) for n, f, when in (("_first", F.min, opens), ("_last", F.max, opens), ("_end", F.min, ends), ("_end_last", F.max, ends))]
    )
    before = Window.partitionBy("_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    # a model over the edges of blocks is closed by an end in any of them: before the first MODEL of a later one, or from the last MODEL of its own on
    of = of.withColumn("_head", F.col("_end").isNotNull() & (F.col("_first").isNull() | (F.col("_end") < F.col("_first"))))
    of = of.withColumn("_tail", F.col("_end_last").isNotNull() & (F.col("_last").isNull() | (F.col("_end_last") > F.col("_last"))))
    of = of.withColumn("_after", F.col("_before") + F.col("_count"))
    # the blocks that hold a part of one model follow each other: the one it opens in by its tail, those after it by their heads
    ends_of = F.explode(F.array(F.struct(F.col("_before").alias("m"), F.col("_head").alias("c")), F.struct(F.col("_after").alias("m"), F.col("_tail").alias("c"))))
    closed = of.select("_path", ends_of.alias("e")).groupBy(F.col("_path").alias("_p"), F.col("e.m").alias("_m")).agg(F.max("e.c").alias("_c"))
    for to, number in (("_head_closed", "_before"), ("_tail_closed", "_after")):
        of = of.join(closed.withColumnRenamed("_c", to), F.col("_path").eqNullSafe(F.col("_p")) & (F.col(number) == F.col("_m"))).drop("_p", "_m")
    whole = of.groupBy(F.col("_path").alias("_p")).agg((F.sum("_count") > 0).alias("_any"))
    told = F.struct("_before", "_after", "_head_closed", "_tail_closed", "_any").alias("_told")
    of = of.join(whole, F.col("_path").eqNullSafe(F.col("_p"))).select(F.col("_path").alias("path"), F.col("_at").alias("_block"), told)
    # a block's row comes with its lines, in front of them, so that lines are sent and ordered once and joined with nothing
    m = _dealt(rows.withColumn("_block", block).unionByName(of, allowMissingColumns=True), "path", "_block")
    w = Window.partitionBy("path", "_block").orderBy(F.col("_told").isNull(), "line_no")
    m = m.withColumns({"_of": F.first("_told", ignorenulls=True).over(w), "_opened": F.sum(opens.cast("int")).over(w)}).where("_told IS NULL")
    m = m.select(*rows.columns, "_block", "_of.*", (F.col("_of._before") + F.col("_opened")).alias("model"))
    here = F.max(ends).over(Window.partitionBy("path", "_block", "model"))
    done = here | ((F.col("model") == F.col("_before")) & F.col("_head_closed")) | ((F.col("model") == F.col("_after")) & F.col("_tail_closed"))
    m = m.withColumn("_closed", done)
    return m.where(~F.col("_any") | ((F.col("model") > 0) & F.col("_closed"))).select(*rows.columns, "model")


def atoms(rows: DataFrame, chain: str | None = None, mode: str = "raise") -> DataFrame:
    """Atom records: path(, model), line_no, atom, residue name, chain_id, seq_id, i_code, x, y, z, b_factor.

    Lines under 54 characters and alternate locations other than blank, A and 1 are left out. ``mode`` "null" drops
    records with unreadable numbers; "raise" fails on them. An unreadable B factor is 0.
    """
    keep = [c for c in ("path", "model", "line_no") if c in rows.columns]
    a = rows.where((F.length("line") >= 54) & F.substring("line", 1, 6).isin("ATOM  ", "HETATM") & _cut(17, 17).isin(" ", "A", "1"))
    if chain is not None:
        a = a.where(_cut(22, 22) == chain)
    read = (lambda c, t: F.trim(c).try_cast(t)) if mode == "null" else (lambda c, t: F.trim(c).cast(t))
    a = a.select(
        *keep,
        F.trim(_cut(13, 16)).alias("atom"),
        F.trim(_cut(18, 20)).alias("name"),
        _cut(22, 22).alias("chain_id"),
        read(_cut(23, 26), "int").alias("seq_id"),
        _cut(27, 27).alias("i_code"),
        read(_cut(31, 38), "double").alias("x"),
        read(_cut(39, 46), "double").alias("y"),
        read(_cut(47, 54), "double").alias("z"),
        F.coalesce(F.trim(_cut(61, 66)).try_cast("double"), F.lit(0.0)).alias("b_factor"),
    )
    return a.where("seq_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL") if mode == "null" else a


def _residue_keys(a: DataFrame) -> list[str]:
    return [c for c in ("path", "model") if c in a.columns] + ["chain_id", "seq_id", "i_code"]


_XYZ = ("line_no", "x", "y", "z")


def residues(rows: DataFrame, chain: str | None = None, mode: str = "raise") -> DataFrame:
    """Residues with a CA: first_line, name and b_factor of the CA, ca, cb, n and c (null if absent) as structs; later records of an atom win."""
    a = atoms(rows, chain, mode).where(F.col("atom").isin("CA", "CB", "N", "C"))
    if "model" in a.columns:  # a file may hold very many
        a = _dealt(a, "path", "model")
    got = [F.max(F.when(F.col("atom") == k, F.struct(*_XYZ, "name", "b_factor"))).alias(k.lower()) for k in ("CA", "CB", "N", "C")]
    r = a.groupBy(*_residue_keys(a)).agg(F.min("line_no").alias("first_line"), *got).where("ca IS NOT NULL")
    plain = [F.when(F.col(k).isNotNull(), F.struct(*[F.col(k)[c].alias(c) for c in "xyz"])).alias(k) for k in ("ca", "cb", "n", "c")]
    return r.select(*_residue_keys(a), "first_line", F.col("ca.name").alias("name"), F.col("ca.b_factor").alias("b_factor"), *plain)


def ribbons(rows: DataFrame, chain: str | None = None, mode: str = "raise") -> DataFrame:
    """path(, model), res (in file order), x, y, z, cx, cy, cz, name, chain_id, seq_id, i_code, b_factor.

    Where a residue has no CB, or one at its CA, the second strand is built: from N and C if there are both, else from the
    neighbouring CAs.
    """
    r = residues(rows, chain, mode)
    keys = [c for c in ("path", "model") if c in r.columns]
    r = r.withColumn("frame_id", F.struct(*keys))
    at = lambda s: tuple(F.col(s)[c] for c in "xyz")
    r = bond_strand(r, at("ca"), at("n"), at("c"), "_b")
    built = F.struct(*[F.col(f"_b{c}").alias(c) for c in "xyz"])
    r = r.withColumn("_own", F.when(F.col("cb").isNotNull(), F.col("cb")).when(F.col("n").isNotNull() & F.col("c").isNotNull(), built))
    r = r.withColumns({c: F.col("ca")[c] for c in "xyz"}).withColumn("res", F.col("first_line"))
    r = pseudo_strand(r)
    use = F.col("_own").isNotNull() & (F.col("_own") != F.col("ca"))
    place = F.row_number().over(Window.partitionBy("frame_id").orderBy("first_line")) - 1
    return r.select(*keys, place.alias("res"), "x", "y", "z", *[F.when(use, F.col("_own")[c]).otherwise(F.col(f"p{c}")).alias(f"c{c}") for c in "xyz"], "name", "chain_id", "seq_id", "i_code", "b_factor")


def residue_ids(rows: DataFrame, chain: str | None = None, atom: str = "CA", mode: str = "raise") -> DataFrame:
    """path(, model), first_line, seq_id: residue numbers that have ``atom`` (CA, or C4' of nucleotides), by their first record."""
    a = atoms(rows, chain, mode).withColumn("atom", F.regexp_replace(F.upper("atom"), r"\*", "'")).where(F.col("atom") == atom)
    keys = [c for c in ("path", "model") if c in a.columns]
    return a.groupBy(*keys, "seq_id").agg(F.min("line_no").alias("first_line")).select(*keys, "first_line", "seq_id")


def nucleotides(rows: DataFrame, chain: str | None = None, mode: str = "raise") -> DataFrame:
    """Nucleotides with a C1' and a base nitrogen: first_line, name and b_factor of the first record, p, c4, c1, n as structs.

    The nitrogen is N9 of purines, else their first N1; of others the last N1, else the first N3. Without C4', C1' stands
    for it. A missing phosphorus is put 1.60 from O5' away from C5', or else 2.50 from C4' away from C3', or else (also
    where these two points meet) 3.5 above C4'.
    """
    a = atoms(rows, chain, mode).withColumns({"name": F.upper("name"), "atom": F.regexp_replace(F.upper("atom"), r"\*", "'")}).where(F.col("name").isin(NUCLEOTIDES))
    purine = F.col("name").isin(PURINES)
    point = F.struct(*_XYZ)
    last = lambda when: F.max(F.when(when, point))
    first = lambda when: F.min(F.when(when, point))
    got = {k: last(F.col("atom") == n) for k, n in {"p": "P", "o5": "O5'", "c5": "C5'", "c4": "C4'", "c3": "C3'", "c1": "C1'"}.items()}
    n9, n1, n3 = (F.col("atom") == k for k in ("N9", "N1", "N3"))
    n = F.coalesce(last(n9 & purine), first(n1 & purine), last(n1 & ~purine), first(n3 & ~purine))
    keys = _residue_keys(a)
    r = a.groupBy(*keys).agg(F.min(F.struct("line_no", "name", "b_factor")).alias("head"), n.alias("n"), *[c.alias(k) for k, c in got.items()]).where("c1 IS NOT NULL AND n IS NOT NULL")
    r = r.withColumn("c4", F.coalesce("c4", "c1"))
    at = lambda s: tuple(F.col(s)[c] for c in "xyz")
    struct = lambda t: F.struct(*[x.alias(c) for c, x in zip("xyz", t, strict=True)])
    x, y, z = at("c4")
    high = struct((x, y, z + 3.5))

    def step(start: str, other: str, size: float) -> Column:
        d = v.sub(at(start), at(other))
        n_ = v.norm(d)
        return F.when(n_ >= EPSILON, struct(tuple(p + size * (q / n_) for p, q in zip(at(start), d, strict=True)))).otherwise(high)

    p = F.when(F.col("p").isNotNull(), struct(at("p"))).when(F.col("o5").isNotNull() & F.col("c5").isNotNull(), step("o5", "c5", 1.60)).when(F.col("c3").isNotNull(), step("c4", "c3", 2.50)).otherwise(high)
    return r.select(*keys, F.col("head.line_no").alias("first_line"), F.col("head.name").alias("name"), F.col("head.b_factor").alias("b_factor"), p.alias("p"), *[struct(at(k)).alias(k) for k in ("c4", "c1", "n")])


def base_curves(rows: DataFrame, chain: str | None = None, mode: str = "raise") -> DataFrame:
    """path(, model), res (in file order), x, y, z (P), ox, oy, oz (C1'), nx, ny, nz (N), name, chain_id, seq_id, i_code, b_factor."""
    r = nucleotides(rows, chain, mode)
    keys = [c for c in ("path", "model") if c in r.columns]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first_line")) - 1
    cols = [F.col(s)[c].alias(pre + c) for pre, s in (("", "p"), ("o", "c1"), ("n", "n")) for c in "xyz"]
    return r.select(*keys, place.alias("res"), *cols, "name", "chain_id", "seq_id", "i_code", "b_factor")


def printable(points: DataFrame, *names: str) -> DataFrame:
    """``points`` with these coordinates (x, y and z by default) as format_string's %8.3f needs them."""
    return points.withColumns({c: F.expr(tables.THREE_DECIMALS.format(x=c)) for c in names or "xyz"})


def to_lines(points: DataFrame) -> DataFrame:
    """frame_id, line_no, line: alpha-carbon records of every point."""
    line = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", (F.col("res") + 1).cast("int"), (F.col("res") + 1).cast("int"), "x", "y", "z")
    # exploded, as filters on the line would else be moved before it and format it once more for each of their terms
    return printable(points).select("frame_id", F.col("res").alias("line_no"), F.explode(F.array(line)).alias("line"))
