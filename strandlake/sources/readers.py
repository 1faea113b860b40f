"""Curves from files, as the operators take them: one call for each format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dcd, pdb


def even_frames(points: DataFrame) -> DataFrame:
    """``points``; fails if there are none or frames differ in their number of points."""
    size = points.groupBy("frame_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"), F.max("n").alias("_most"))
    told = F.when(F.col("_least").isNull(), F.lit("there are no frames")).otherwise(F.concat(F.lit("frames have from "), "_least", F.lit(" to "), "_most", F.lit(" points")))
    fine = size.select(F.when(F.col("_least") == F.col("_most"), True).otherwise(F.raise_error(told).cast("boolean")).alias("_fine"))
    return fine.join(points, F.lit(True), "left").where("_fine AND frame_id IS NOT NULL").drop("_fine")  # the left side is one row, there without points too


def some_frames(frames: DataFrame) -> DataFrame:
    """``frames``; fails if there are none. Only whether there is a row is looked up before."""
    if not frames.select("frame_idx").head(1):
        raise ValueError("there are no frames")
    return frames


_STRAND = ("cx", "cy", "cz")


def read_pdb(spark: SparkSession, path: str, chain: str | None = None, strand: bool = False, mode: str = "raise") -> DataFrame:
    """frame_id (the file's path), res, x, y, z(, cx, cy, cz) and the residues' names and numbers."""
    r = pdb.ribbons(pdb.lines(spark, path), chain, mode).withColumnRenamed("path", "frame_id")
    return r if strand else r.drop(*_STRAND)


def read_pdb_trajectory(spark: SparkSession, path: str, chain: str | None = None, strand: bool = False, mode: str = "raise") -> DataFrame:
    """frame_id (from 0, in the order of the models of a file), res, x, y, z(, cx, cy, cz): the models of one file, all of one length."""
    rows = pdb.models(pdb.lines(spark, path)).withColumn("model", F.greatest(F.col("model") - 1, F.lit(0)))
    r = even_frames(pdb.ribbons(rows, chain, mode).withColumn("frame_id", F.col("model").cast("long")))
    return r.select("frame_id", "res", "x", "y", "z", *(_STRAND if strand else ()))


def read_dcd(spark: SparkSession, path: str, atoms: list[int] | None = None, second: list[int | None] | None = None, strict: bool = True) -> DataFrame:
    """frame_id, res, x, y, z(, cx, cy, cz): listed atoms of every frame of one file, or all of them."""
    wanted = None if atoms is None else sorted({*atoms, *(a for a in second or [] if a is not None)})
    if second is not None and atoms is not None and len(second) != len(atoms):
        raise ValueError(f"{len(atoms)} atoms, {len(second)} of the second strand")
    frames = some_frames(dcd.read_dcd(spark, path, strict, wanted))
    if atoms is None:  # a file has one number of atoms
        flat = frames.select(F.col("frame_idx").alias("frame_id"), F.posexplode(F.arrays_zip("x", "y", "z")).alias("res", "p"))
        return flat.select("frame_id", "res", *[F.col("p")[c].cast("double").alias(c) for c in "xyz"])
    place = {a: i for i, a in enumerate(wanted)}
    return dcd.project(frames, [place[a] for a in atoms], None if second is None else [None if a is None else place[a] for a in second])


def read_pdb_rna(spark: SparkSession, path: str, chain: str | None = None, mode: str = "raise") -> DataFrame:
    """frame_id (the file's path), res, x, y, z (P), ox, oy, oz (C1'), nx, ny, nz (N) and the nucleotides' names and numbers."""
    return pdb.base_curves(pdb.lines(spark, path), chain, mode).withColumnRenamed("path", "frame_id")


def read_text(df: DataFrame, text: str = "text", path: str = "path", chain: str | None = None, nucleotides: bool = False, mode: str = "raise") -> DataFrame:
    """As :func:`read_pdb` with its strand, or :func:`read_pdb_rna`, from files held in a column."""
    rows = pdb.from_text(df, text, path)
    return (pdb.base_curves if nucleotides else pdb.ribbons)(rows, chain, mode).withColumnRenamed("path", "frame_id")


def base_vectors(nucleotides: DataFrame) -> DataFrame:
    """``nucleotides`` with bx, by, bz: from C1' to N."""
    return nucleotides.withColumns({f"b{c}": F.col(f"n{c}") - F.col(f"o{c}") for c in "xyz"})
