"""Functions for SQL text: distances of angles, bends, spectra and moment states, printed coordinates and angles of points as SQL-bodied
functions, which plans see through, and a table function that gives the residues of a structure file held in a column."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: What format_string has to be given for x to print three decimals as C's printf does: by the exact value, ties to even. By itself it takes
#: all ties of the shortest digits up. Only what is close to a tie is rounded first, by format_number, which is exact but for 0.0005 (it is over its tie).
THREE_DECIMALS = "CASE WHEN abs(abs({x} * 1000D) % 1 - 0.5D) < 0.001D THEN CAST(format_number(CASE WHEN abs({x}) = 0.0005D THEN 2 * {x} ELSE {x} END, '0.000') AS DOUBLE) ELSE {x} END"

#: name -> parameters, result type and body. Temporary functions of the session.
SCALARS: dict[str, tuple[str, str, str]] = {
    "circle_distance": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN abs(a - b) > pi() THEN 2 * pi() - abs(a - b) ELSE abs(a - b) END"),
    "bend_distance": ("ka DOUBLE, ta DOUBLE, kb DOUBLE, tb DOUBLE", "DOUBLE", "sqrt((ka - kb) * (ka - kb) + CASE WHEN abs(ta - tb) > pi() THEN (2 * pi() - abs(ta - tb)) * (2 * pi() - abs(ta - tb)) ELSE (ta - tb) * (ta - tb) END)"),
    "spectrum_distance": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN least(size(a), size(b)) > 0 THEN sqrt(aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (p, q) -> (p - q) * (p - q)), 0D, (s, x) -> s + x) / least(size(a), size(b))) ELSE 0D END",
    ),
    "three_decimals": ("x DOUBLE", "DOUBLE", THREE_DECIMALS.format(x="x")),
    # atan2 with the signs of zeros, which Spark's leaves out: a text of -0.000 keeps its sign
    "point_angle": ("y DOUBLE, x DOUBLE", "DOUBLE", "CASE WHEN y = 0 AND (x < 0 OR x = 0 AND CAST(x AS STRING) = '-0.0') THEN CASE WHEN CAST(y AS STRING) = '-0.0' THEN -pi() ELSE pi() END ELSE atan2(y, x) END"),
}

RESIDUE = "res int, chain_id string, seq_id int, i_code string, name string, b_factor double, x double, y double, z double, bx double, by double, bz double"


def residue_rows(text: str | None, chain: str | None = None) -> Iterator[tuple]:
    """The residues with a CA of a structure file in the order of their first record, by the rules of :func:`sources.pdb.residues`; bx, by, bz is the CB."""
    found: dict[tuple, dict] = {}
    for line in (text or "").split("\n"):
        line = line.removesuffix("\r")
        if len(line) < 54 or line[:6] not in ("ATOM  ", "HETATM") or line[16] not in " A1" or chain is not None and line[21] != chain:
            continue
        atom = line[12:16].strip()
        if atom not in ("CA", "CB", "N", "C"):
            continue
        own = found.setdefault((line[21], int(line[22:26]), line[26]), {})
        point = tuple(float(line[k : k + 8]) for k in (30, 38, 46))
        try:
            factor = float(line[60:66])
        except ValueError:
            factor = 0.0
        own[atom] = (point, line[17:20].strip(), factor)  # a later record of an atom wins
    kept = [(key, own) for key, own in found.items() if "CA" in own]
    for res, (key, own) in enumerate(kept):
        at, name, factor = own["CA"]
        yield (res, *key, name, factor, *at, *(own["CB"][0] if "CB" in own else (None,) * 3))


class StructureResidues:
    """structure_residues(text, chain): rows of :data:`RESIDUE`; a null chain takes all. Unreadable numbers fail."""

    def eval(self, text: str, chain: str = None) -> Iterator[tuple]:  # noqa: RUF013
        yield from residue_rows(text, chain)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("structure_residues", F.udtf(StructureResidues, returnType=RESIDUE))
