"""Differential geometry of ordered points: segments, curvature, torsion and ribbon angles.

All neighbour terms are window expressions over one partitioning and order, so a plan has one exchange and one sort.
Row ``res`` i of a result holds segment i, the curvature and ribbon angle at vertex i + 1 and the torsion about
segment i + 1; terms that reach beyond the last point are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as v

#: Shorter segments are degenerate, and smaller sines of a bend are collinear.
EPSILON = 1e-9
PSEUDO = 1.52


def _order(key: str = "frame_id"):
    return Window.partitionBy(key).orderBy("res")


def _checked(ok: Column, value: Column, known: Column, mode: str, message: str) -> Column:
    if mode == "null":
        return F.when(ok, value)
    return F.when(known & ~ok, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def segments(points: DataFrame, mode: str = "raise") -> DataFrame:
    """``points`` with seg (length) and tx, ty, tz (unit tangent); ``mode`` "null" blanks degenerate segments, "raise" fails."""
    w = _order()
    d = tuple(F.lead(a).over(w) - F.col(a) for a in "xyz")
    out = points.withColumns({f"_d{a}": c for a, c in zip("xyz", d, strict=True)})
    out = out.withColumn("_len", v.norm(v.vec("_d")))
    seg = _checked(F.col("_len") >= EPSILON, F.col("_len"), F.col("_len").isNotNull(), mode, "degenerate segment")
    out = out.withColumn("seg", seg)
    return out.withColumns({f"t{a}": F.col(f"_d{a}") / F.col("seg") for a in "xyz"}).drop("_dx", "_dy", "_dz", "_len")


def invariants(points: DataFrame, mode: str = "raise", strand: str | None = None) -> DataFrame:
    """frame_id, res, seg, kappa, tau and, with ``strand`` (a vector column prefix), theta."""
    w = _order()
    s = segments(points, mode)
    s = s.withColumns({f"u{a}": F.lead(f"t{a}").over(w) for a in "xyz"})
    if strand:
        s = s.withColumns({f"s{a}": F.lead(f"{strand}{a}").over(w) for a in "xyz"})
    t, u = v.vec("t"), v.vec("u")
    s = s.withColumns({f"_b{a}": c for a, c in zip("xyz", v.cross(t, u), strict=True)}).withColumn("_bn", v.norm(v.vec("_b")))
    s = s.withColumn("_bn", _checked(F.col("_bn") >= EPSILON, F.col("_bn"), F.col("_bn").isNotNull(), mode, "collinear segments"))
    s = s.withColumns({f"b{a}": F.col(f"_b{a}") / F.col("_bn") for a in "xyz"})
    s = s.withColumns({f"c{a}2": F.lead(f"b{a}").over(w) for a in "xyz"})
    b, c = v.vec("b"), v.vec("c", "2")
    out = {"kappa": F.acos(v.clamp(v.dot(t, u))), "tau": F.atan2(v.dot(v.cross(b, c), u), v.clamp(v.dot(b, c)))}
    if strand:
        mid = v.add(t, u)
        n = v.norm(mid)
        mid = tuple(F.when(n >= EPSILON, m / n).otherwise(x) for m, x in zip(mid, u, strict=True))
        out["theta"] = F.atan2(v.dot(v.vec("s"), b), v.dot(v.vec("s"), v.cross(b, mid)))
    return s.select("frame_id", "res", "seg", *[x.alias(k) for k, x in out.items()])


def ribbon_invariants(ribbon: DataFrame, mode: str = "raise") -> DataFrame:
    """Invariants with the ribbon angle of the second strand cx, cy, cz."""
    d = v.sub(v.vec("c"), v.vec(""))
    n = v.norm(d)
    n = _checked(n >= EPSILON, n, n.isNotNull(), mode, "degenerate strand vector")
    return invariants(ribbon.withColumns({f"e{a}": x / n for a, x in zip("xyz", d, strict=True)}), mode, "e")


def base_invariants(nucleotides: DataFrame, mode: str = "raise") -> DataFrame:
    """Invariants of the P curve with the base angle of N - C1'."""
    d = v.sub(v.vec("n"), v.vec("o"))
    n = v.norm(d)
    n = _checked(n >= EPSILON, n, n.isNotNull(), mode, "degenerate base vector")
    return invariants(nucleotides.withColumns({f"e{a}": x / n for a, x in zip("xyz", d, strict=True)}), mode, "e")


def bundle(points: DataFrame, mode: str = "raise", strand: str | None = None, radius: int | None = None) -> DataFrame:
    """frame_id, seg, kappa, tau(, theta), writhe: the arrays of every curve.

    The local writhe has ``radius`` points on both sides; by default 4 for curves of 12 points or more, 2 from 8 points
    and 1 below. Curves of fewer than 4 points fail, or are left out with ``mode`` "null". ``strand`` is "c" for ribbons,
    "n" for nucleotides (N against C1', radius 2 by default) or the prefix of ready unit vectors.
    """
    from . import curves, writhe

    w = Window.partitionBy("frame_id")
    inv = ribbon_invariants(points, mode) if strand == "c" else base_invariants(points, mode) if strand == "n" else invariants(points, mode, strand)
    names = ["seg", "kappa", "tau", *(["theta"] if strand else [])]
    inv = inv.groupBy("frame_id").agg(F.count("*").alias("_n"), *[curves.gathered(n) for n in names])
    short = F.col("_n") < 4
    inv = inv.where(~short) if mode == "null" else inv.where(F.when(short, F.raise_error(F.lit("a curve has four points or more")).cast("boolean")).otherwise(True))
    if radius is None and strand == "n":
        radius = 2
    far = F.lit(radius) if radius else F.when(F.col("_c") >= 12, 4).when(F.col("_c") >= 8, 2).otherwise(1)
    sized = points.select("frame_id", "res", "x", "y", "z", F.count("*").over(w).alias("_c")).withColumn("_r", far)
    spectrum = writhe.local_writhe(sized, F.col("_r")).groupBy("frame_id").agg(curves.gathered("writhe"))
    return inv.drop("_n").join(spectrum, "frame_id", "left").withColumn("writhe", F.coalesce("writhe", F.array().cast("array<double>")))


def deltas(one: DataFrame, two: DataFrame) -> DataFrame:
    """res, d_kappa, d_tau(, d_theta): differences of two curves' invariants; those of tau and theta on the circle, in degrees."""
    names = [n for n in ("tau", "theta") if n in one.columns and n in two.columns]
    b = two.select("res", *[F.col(n).alias(f"_{n}") for n in ("kappa", *names)])
    return one.join(b, "res").select("res", F.abs(F.col("kappa") - F.col("_kappa")).alias("d_kappa"), *[F.degrees(v.circle_distance(F.col(n), F.col(f"_{n}"))).alias(f"d_{n}") for n in names])


def subcurve(points: DataFrame, start: int, end: int) -> DataFrame:
    """Points ``start`` .. ``end`` of each curve; nothing unless end - start >= 3. Invariants are local, so they may be taken after it."""
    return points.where(F.col("res").between(start, end) if end - start >= 3 else F.lit(False))


def totals(inv: DataFrame) -> DataFrame:
    """frame_id, total_curvature, mean_segment (0 if there is none)."""
    return inv.groupBy("frame_id").agg(F.coalesce(F.sum("kappa"), F.lit(0.0)).alias("total_curvature"), F.coalesce(F.avg("seg"), F.lit(0.0)).alias("mean_segment"))


def _perpendicular(d: v.Vec, otherwise: tuple[float, float, float]) -> v.Vec:
    """Unit vector at a right angle to ``d``, or ``otherwise`` where there is none."""
    flat = (F.abs(d[0]) > 0.1) | (F.abs(d[1]) > 0.1)
    side = F.when(flat, -d[1]).otherwise(0.0), F.when(flat, d[0]).otherwise(-d[2]), F.when(flat, 0.0).otherwise(d[1])
    wide = v.norm(side) >= EPSILON
    return tuple(F.when(wide, s).otherwise(o) for s, o in zip(v.unit(side, EPSILON), otherwise, strict=True))


def bond_strand(rows: DataFrame, ca: v.Vec, n: v.Vec, c: v.Vec, prefix: str) -> DataFrame:
    """``rows`` with the point (``prefix`` x, y, z) 1.52 from ``ca`` away from both its bonded atoms ``n`` and ``c``.

    Where these lie opposite each other the direction is their cross product, then a perpendicular of ca - n, then the x axis.
    """
    # in steps, as each of them is used several times by the next
    rows = rows.withColumns({f"_{k}{a}": e for k, t in (("1", v.sub(ca, n)), ("2", v.sub(ca, c))) for a, e in zip("xyz", t, strict=True)})
    one, two = v.vec("_1"), v.vec("_2")
    rows = rows.withColumns({f"_{k}{a}": e for k, t in (("w", v.add(one, two)), ("u", v.cross(one, two))) for a, e in zip("xyz", t, strict=True)})
    rows = rows.withColumns({f"_s{a}": e for a, e in zip("xyz", _perpendicular(one, (1.0, 0.0, 0.0)), strict=True)} | {"_nw": v.norm(v.vec("_w")), "_nu": v.norm(v.vec("_u"))})
    way = {a: F.when(F.col("_nw") >= EPSILON, F.col(f"_w{a}") / F.col("_nw")).when(F.col("_nu") >= EPSILON, F.col(f"_u{a}") / F.col("_nu")).otherwise(F.col(f"_s{a}")) for a in "xyz"}
    rows = rows.withColumns({f"{prefix}{a}": p + PSEUDO * way[a] for a, p in zip("xyz", ca, strict=True)})
    return rows.drop("_nw", "_nu", *[f"_{k}{a}" for k in "12wus" for a in "xyz"])


def pseudo_strand(points: DataFrame) -> DataFrame:
    """``points`` with px, py, pz, a second strand point 1.52 from each along the outward bisector of its neighbours.

    Where there is no bisector, as at curve ends and on straight stretches, the direction is a perpendicular of the
    curve, and the y axis where there is none. A curve of one point is taken to run down the z axis.
    """
    w = _order()
    p = points.withColumns({f"_{s}{a}": f(a).over(w) for s, f in (("p", F.lag), ("n", F.lead)) for a in "xyz"})
    r = v.vec("")
    way = v.sub(v.scale(r, 2), v.add(v.vec("_p"), v.vec("_n")))  # null at the ends
    far = {"x": 0.0, "y": 0.0, "z": -2.0}
    along = {a: F.coalesce(F.col(f"_n{a}") - F.col(f"_p{a}"), 2 * (F.col(f"_n{a}") - F.col(a)), 2 * (F.col(a) - F.col(f"_p{a}")), F.lit(far[a])) for a in "xyz"}
    p = p.withColumns({f"_w{a}": c for a, c in zip("xyz", way, strict=True)} | {f"_d{a}": c for a, c in along.items()})
    bent = v.norm(v.vec("_w")) >= EPSILON
    u = tuple(F.when(bent, b).otherwise(s) for b, s in zip(v.unit(v.vec("_w"), EPSILON), _perpendicular(v.vec("_d"), (0.0, 1.0, 0.0)), strict=True))
    return p.withColumns({f"p{a}": q + PSEUDO * x for a, q, x in zip("xyz", r, u, strict=True)}).drop(*[f"_{s}{a}" for s in "pnwd" for a in "xyz"])


def integrate(inv_arrays: DataFrame) -> DataFrame:
    """frame_id, curve: points rebuilt from the arrays seg, kappa, tau by carrying a moving frame along the curve, for all curves of one shape at once."""
    import numpy as np
    import pyarrow as pa

    from .curves import chains

    point = pa.struct([(c, pa.float64()) for c in "xyz"])

    def run(batches):
        for b in batches:
            parts = [b.column(1 + k) for k in range(3)]
            sizes = np.stack([p.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for p in parts], 1)
            data = [(p.values.to_numpy(zero_copy_only=False), p.offsets.to_numpy()[:-1]) for p in parts]
            for shape in np.unique(sizes, axis=0):
                rows = np.flatnonzero((sizes == shape).all(1))
                q = chains(*(values[start[rows][:, None] + np.arange(n)] for (values, start), n in zip(data, shape, strict=True)))
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * q.shape[1])
                flat = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(q[:, :, c]).ravel()) for c in range(3)], fields=list(point))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(offsets, flat)], names=["frame_id", "curve"])

    rows = inv_arrays.select(F.col("frame_id").cast("long").alias("frame_id"), *[F.col(c).cast("array<double>").alias(c) for c in ("seg", "kappa", "tau")])
    return rows.mapInArrow(run, "frame_id long, curve array<struct<x:double,y:double,z:double>>")
