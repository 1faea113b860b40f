"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from itertools import combinations

FRAMES = "p AS (SELECT vec_id AS frame_id, r::INT AS res, embedding[3*r+1]::DOUBLE AS x, embedding[3*r+2]::DOUBLE AS y, embedding[3*r+3]::DOUBLE AS z FROM embeddings, range(0, 21) t(r))"
RIBBONS = FRAMES.replace("range(0, 21)", "range(0, 10)").replace(" AS z FROM", " AS z, embedding[3*r+31]::DOUBLE - embedding[3*r+1]::DOUBLE AS vx, embedding[3*r+32]::DOUBLE - embedding[3*r+2]::DOUBLE AS vy, embedding[3*r+33]::DOUBLE - embedding[3*r+3]::DOUBLE AS vz FROM")
BASES = FRAMES.replace("range(0, 21)", "range(0, 7)").replace(" AS z FROM", " AS z, embedding[3*r+43]::DOUBLE - embedding[3*r+22]::DOUBLE AS vx, embedding[3*r+44]::DOUBLE - embedding[3*r+23]::DOUBLE AS vy, embedding[3*r+45]::DOUBLE - embedding[3*r+24]::DOUBLE AS vz FROM")
ASKED = "SELECT -1 AS frame_id, r::INT AS res, (0.5 * r)::DOUBLE AS x, (0.3 * (r % 3))::DOUBLE AS y, (0.2 * (r * r % 5))::DOUBLE AS z FROM range(0, 21) t(r)"
WITH_ASKED = FRAMES[:-1] + f" UNION ALL {ASKED})"
USERS = """p AS (SELECT user_id AS frame_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS res,
  epoch_us(ts::TIMESTAMP) / 3.6e9 - 473328.0 AS x, value AS y, (props->>'$.k')::DOUBLE AS z FROM events)"""
W = "(PARTITION BY frame_id ORDER BY res)"


def geometry(strand: bool = False) -> str:
    """CTEs from p to inv (frame_id, res, seg, tx, ty, tz, kappa, tau, theta)."""
    lead = lambda c, n: ", ".join(f"lead({a}) OVER w AS {b}" for a, b in zip(c, n, strict=True))
    v = ", vx, vy, vz" if strand else ""
    out = f"""g1 AS (SELECT frame_id, res{v}, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM p WINDOW w AS {W}),
g2 AS (SELECT *, CASE WHEN sqrt(dx*dx+dy*dy+dz*dz) >= 1e-9 THEN sqrt(dx*dx+dy*dy+dz*dz) END AS seg FROM g1),
g3 AS (SELECT *, dx/seg AS tx, dy/seg AS ty, dz/seg AS tz FROM g2),
g4 AS (SELECT *, {lead(("tx", "ty", "tz"), ("ux", "uy", "uz"))}{", lead(vx) OVER w AS ex, lead(vy) OVER w AS ey, lead(vz) OVER w AS ez" if strand else ""} FROM g3 WINDOW w AS {W}),
g5 AS (SELECT *, ty*uz-tz*uy AS cx, tz*ux-tx*uz AS cy, tx*uy-ty*ux AS cz FROM g4),
g6 AS (SELECT *, CASE WHEN sqrt(cx*cx+cy*cy+cz*cz) >= 1e-9 THEN sqrt(cx*cx+cy*cy+cz*cz) END AS cn FROM g5),
g7 AS (SELECT *, cx/cn AS bx, cy/cn AS by_, cz/cn AS bz FROM g6),
g8 AS (SELECT *, {lead(("bx", "by_", "bz"), ("fx", "fy", "fz"))} FROM g7 WINDOW w AS {W}),
inv AS (SELECT frame_id, res, seg, tx, ty, tz,
  CASE WHEN tx*ux+ty*uy+tz*uz IS NOT NULL THEN acos(greatest(-1.0, least(1.0, tx*ux+ty*uy+tz*uz))) END AS kappa,
  CASE WHEN bx IS NOT NULL AND fx IS NOT NULL THEN atan2((by_*fz-bz*fy)*ux + (bz*fx-bx*fz)*uy + (bx*fy-by_*fx)*uz, greatest(-1.0, least(1.0, bx*fx+by_*fy+bz*fz))) END AS tau"""
    if strand:
        n = "sqrt((tx+ux)*(tx+ux)+(ty+uy)*(ty+uy)+(tz+uz)*(tz+uz))"
        m = [f"((t{a}+u{a})/{n})" for a in "xyz"]
        e = "sqrt(ex*ex+ey*ey+ez*ez)"
        nx = f"(by_*{m[2]}-bz*{m[1]})"
        ny = f"(bz*{m[0]}-bx*{m[2]})"
        nz = f"(bx*{m[1]}-by_*{m[0]})"
        out += f""",
  CASE WHEN bx IS NOT NULL THEN atan2((ex*bx+ey*by_+ez*bz)/{e}, (ex*{nx}+ey*{ny}+ez*{nz})/{e}) END AS theta"""
    return out + " FROM g8)"


def _angle(a: str, b: str, c: str) -> str:
    d = lambda p, q: "(" + "+".join(f"{p}{k}*{q}{k}" for k in "xyz") + ")"
    triple = f"({a}x*({b}y*{c}z-{b}z*{c}y)+{a}y*({b}z*{c}x-{b}x*{c}z)+{a}z*({b}x*{c}y-{b}y*{c}x))"
    return f"2*atan2({triple}, 1+{d(a, b)}+{d(b, c)}+{d(c, a)})"


PAIRS = (
    f"s1 AS (SELECT frame_id, res, x, y, z, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1 FROM p WINDOW w AS {W}), "
    "s2 AS (SELECT * FROM s1 WHERE x1 IS NOT NULL), "
    "q1 AS (SELECT a.frame_id, a.res AS i, b.res AS j, "
    + ", ".join(f"b.{k}-a.{k} AS p{k}, b.{k}1-a.{k} AS q{k}, b.{k}1-a.{k}1 AS r{k}, b.{k}-a.{k}1 AS s{k}" for k in "xyz")
    + " FROM s2 a JOIN s2 b ON a.frame_id = b.frame_id AND b.res >= a.res + 2), "
    "q2 AS (SELECT *, " + ", ".join(f"sqrt({k}x*{k}x+{k}y*{k}y+{k}z*{k}z) AS n{k}" for k in "pqrs") + " FROM q1), "
    "q3 AS (SELECT frame_id, i, j, least(np, nq, nr, ns) AS near, " + ", ".join(f"{k}{a}/n{k} AS u{k}{a}" for k in "pqrs" for a in "xyz") + " FROM q2), "
    f"pairs AS (SELECT frame_id, i, j, CASE WHEN near < 1e-12 THEN 0 ELSE ({_angle('up', 'uq', 'ur')} + {_angle('up', 'ur', 'us')}) / (4*pi()) END AS w FROM q3)"
)


def bc(x: str) -> str:
    """Bimodality coefficient from central moments nx, vx, m3, m4 of CTE columns named after x."""
    n, m2, m3, m4 = f"n_{x}", f"m2_{x}", f"m3_{x}", f"m4_{x}"
    low = f"({m4}/({m2}*{m2}) - 3 + 3*({n}-1)*({n}-1)/(({n}-2)*({n}-3)))"
    return f"CASE WHEN {n} < 4 OR {m2} <= 1e-14 THEN 0 WHEN {low} <= 1e-12 THEN 0 ELSE greatest(0, least(1, ({m3}*{m3}/({m2}*{m2}*{m2}) + 1) / {low})) END"


def central(src: str, key: str, xs: list[str]) -> str:
    """CTE ``cm``: n, mean and central moments of each x by key."""
    mean = ", ".join(f"avg({x}) AS mu_{x}" for x in xs)
    d = lambda x, k: "*".join([f"(a.{x}-b.mu_{x})"] * k)
    mom = ", ".join(f"count(a.{x})::DOUBLE AS n_{x}, any_value(b.mu_{x}) AS mean_{x}, avg({d(x, 2)}) AS m2_{x}, avg({d(x, 3)}) AS m3_{x}, avg({d(x, 4)}) AS m4_{x}" for x in xs)
    return f"mu AS (SELECT {key}, {mean} FROM {src} GROUP BY {key}), cm AS (SELECT a.{key}, {mom} FROM {src} a JOIN mu b ON a.{key} = b.{key} GROUP BY a.{key})"


def profile(features: dict[str, int], width: int) -> str:
    """CTE ``prof`` from inv; features: name and rows that follow in its window."""
    m = ", ".join(f"avg({f}) OVER (PARTITION BY frame_id ORDER BY res ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) AS {f}" for f, k in features.items())
    bcs = ", ".join(f"{bc(f)} AS bc_{f}" for f in features)
    score = "greatest(" + ", ".join(f"bc_{f}" for f in features) + ")"
    return f"""wm0 AS (SELECT frame_id, res AS window_start, max(res) OVER (PARTITION BY frame_id) AS last, {m} FROM inv),
wm AS (SELECT * FROM wm0 WHERE window_start + {width} - 1 <= last), {central("wm", "window_start", list(features))},
pr AS (SELECT window_start, {bcs} FROM cm), prof AS (SELECT *, window_start + {width} - 1 AS window_end, {score} AS score FROM pr)"""


def rd(cols: str) -> str:
    """Rounded double columns."""
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols.split())


def long(cols: str) -> str:
    return ", ".join(f"{c}::BIGINT AS {c}" for c in cols.split())


K = "kappa tau"
LOCAL = "lw AS (SELECT p.frame_id, p.res, coalesce(sum(w), 0) AS writhe FROM p LEFT JOIN pairs q ON q.frame_id = p.frame_id AND q.i >= p.res - 4 AND q.j <= p.res + 3 WHERE p.res BETWEEN 4 AND 16 GROUP BY ALL)"
LOCAL5 = LOCAL.replace("- 4", "- 5").replace("+ 3", "+ 4").replace("BETWEEN 4 AND 16", "BETWEEN 5 AND 15")
COMPACT = """cw AS (SELECT p.frame_id, p.res, coalesce(sum(w), 0) AS w FROM p LEFT JOIN pairs q ON q.frame_id = p.frame_id AND q.i >= p.res - 4 AND q.j <= p.res + 3 GROUP BY ALL),
ck AS (SELECT c.frame_id, c.res, any_value(c.w) AS w, coalesce(avg(k.kappa), 0) AS k FROM cw c LEFT JOIN inv k ON k.frame_id = c.frame_id AND k.res + 1 > greatest(c.res - 4, 0) AND k.res + 1 < least(c.res + 4, 20) GROUP BY c.frame_id, c.res),
comp AS (SELECT frame_id, res, abs(w) * k AS compactness FROM ck)"""
DENSITY = """dp AS (SELECT res, avg(compactness) AS mean_density, coalesce(stddev_samp(compactness), 0) AS std_density FROM comp GROUP BY res),
dens AS (SELECT *, (mean_density - avg(mean_density) OVER ()) / greatest(coalesce(stddev_samp(mean_density) OVER (), 0), 1e-12) AS z_score FROM dp)"""
SPECTRUM = "sp AS (SELECT a.frame_id, sqrt(avg((a.writhe - b.writhe) * (a.writhe - b.writhe))) AS writhe_distance FROM lw a JOIN lw b ON a.res = b.res AND b.frame_id = 10 GROUP BY a.frame_id)"
E8 = profile({"kappa": 5, "tau": 4}, 8)
UNWRAP = """first AS (SELECT res, tau AS t0, theta AS h0 FROM inv0 WHERE frame_id = (SELECT min(frame_id) FROM inv0)),
inv AS (SELECT i.frame_id, i.res, kappa, t0 + atan2(sin(tau - t0), cos(tau - t0)) AS tau, h0 + atan2(sin(theta - h0), cos(theta - h0)) AS theta FROM inv0 i JOIN first f ON i.res = f.res)"""
RNA = f"{BASES}, {geometry(True).replace('inv AS (SELECT frame_id', 'inv0 AS (SELECT frame_id')}, {UNWRAP}, " + profile({"kappa": 2, "tau": 2, "theta": 2}, 3).replace("window_start + 3 - 1 <= last", "window_start + 3 <= last - 1")


def grid(pairs: str, keys: str, n: str, m: str, cost: str, total: bool) -> str:
    """CTE ``dp`` (keys, n, m, far) from ``pairs``: the dynamic programme by diagonals, each a list over the row i of its cells.

    ``cost`` is written in i and j, which count from 0.
    """
    best = "CASE WHEN z + 1 = 0 THEN 0 ELSE least(p1[i], p1[i + 1], p2[i]) END"
    cell = f"{best} + {cost}" if total else f"greatest({best}, {cost})"
    cell = cell.replace("<j>", "(z + 1 - i)").replace("<i>", "i")
    return f"""pq AS (SELECT *, {n} AS n, {m} AS m FROM {pairs}),
dg AS (SELECT *, -1 AS z, list_transform(range(n), lambda i: 'inf'::DOUBLE) AS p1, list_transform(range(n), lambda i: 'inf'::DOUBLE) AS p2 FROM pq
 UNION ALL SELECT * REPLACE (z + 1 AS z, p1 AS p2, list_transform(range(n), lambda i: CASE WHEN z + 1 - i < 0 OR z + 1 - i >= m THEN 'inf'::DOUBLE ELSE {cell} END) AS p1) FROM dg WHERE z < n + m - 2),
dp AS (SELECT {keys}, n, m, p1[n] AS far FROM dg WHERE z = n + m - 2)"""


_T = "abs(ta[<i> + 1] - tb[<j> + 1])"
BEND = f"sqrt((ka[<i> + 1] - kb[<j> + 1]) ** 2 + (CASE WHEN {_T} > pi() THEN 2 * pi() - {_T} ELSE {_T} END) ** 2)"
SHORTER = "least(len(ka), len(ta))", "least(len(kb), len(tb))"


ARRAYS = "ar AS (SELECT frame_id, list(kappa ORDER BY res) FILTER (kappa IS NOT NULL) AS k, list(tau ORDER BY res) FILTER (tau IS NOT NULL) AS t FROM inv GROUP BY frame_id)"


NET = """rw AS (SELECT frame_id, res, kappa, coalesce(tau, lag(tau) OVER (PARTITION BY frame_id ORDER BY res)) AS tau FROM inv),
nr AS (SELECT * FROM rw WHERE kappa IS NOT NULL),
cm AS (SELECT res, atan2(sum(sin(kappa)), sum(cos(kappa))) AS mk, atan2(sum(sin(tau)), sum(cos(tau))) AS mt FROM nr GROUP BY res),
ft AS (SELECT frame_id, n.res + 1 AS res, atan2(sin(kappa-mk), cos(kappa-mk)) AS k, atan2(sin(tau-mt), cos(tau-mt)) AS t FROM nr n JOIN cm ON cm.res = n.res),
"""


def net(a: str, b: str, on: str) -> str:
    e = "1e-6"
    sums = f"""mm AS (SELECT a.res AS i, b.res AS j, sum(a.k*a.k)/(count(*)-1)+{e} AS a00, sum(a.k*a.t)/(count(*)-1) AS a01, sum(a.t*a.t)/(count(*)-1)+{e} AS a11,
 sum(b.k*b.k)/(count(*)-1)+{e} AS b00, sum(b.k*b.t)/(count(*)-1) AS b01, sum(b.t*b.t)/(count(*)-1)+{e} AS b11,
 sum(a.k*b.k)/(count(*)-1) AS c00, sum(a.k*b.t)/(count(*)-1) AS c01, sum(a.t*b.k)/(count(*)-1) AS c10, sum(a.t*b.t)/(count(*)-1) AS c11
 FROM {a} a JOIN {b} b ON a.frame_id = b.frame_id AND {on} GROUP BY a.res, b.res)"""
    rows = [["A", "a01", "c00", "c01"], ["a01", "B", "c10", "c11"], ["c00", "c10", "C", "b01"], ["c01", "c11", "b01", "D"]]

    def det(m):
        if len(m) == 1:
            return m[0][0]
        return "(" + "".join(f"{'-' if k % 2 else '+'}{m[0][k]}*{det([r[:k] + r[k + 1:] for r in m[1:]])}" for k in range(len(m))) + ")"

    return f"""{sums}, md AS (SELECT *, a00+{e} AS A_, a11+{e} AS B_, b00+{e} AS C_, b11+{e} AS D_ FROM mm),
me AS (SELECT i, j, greatest(0, -0.5*(ln({det(rows).replace("A", "A_").replace("B", "B_").replace("C", "C_").replace("D", "D_")})-ln(a00*a11-a01*a01)-ln(b00*b11-b01*b01))) AS mi FROM md),
ed AS (SELECT i, j, sqrt(greatest(0, least(1, 1-exp(-2*mi)))) AS r FROM me)"""


CHAINS = "pa AS (SELECT * FROM p WHERE res < 9), pb AS (SELECT frame_id, res - 9 AS res, x, y, z FROM p WHERE res >= 9)"
EDGES = f"{FRAMES}, {geometry()}, {NET}{net('ft', 'ft', 'a.res < b.res')}"
MOMENTS = "{key}, n_v::BIGINT AS n, round(mean_v, 6) + 0.0 AS mean, round(m2_v, 6) + 0.0 AS variance, round(CASE WHEN n_v < 3 OR m2_v <= 1e-14 THEN 0 ELSE m3_v / (m2_v * sqrt(m2_v)) END, 6) + 0.0 AS skewness, round(CASE WHEN n_v < 4 OR m2_v <= 1e-14 THEN 0 ELSE m4_v / (m2_v * m2_v) - 3 END, 6) + 0.0 AS kurtosis, round({bc}, 6) + 0.0 AS bc"


def moments(table: str, key: str, x: str) -> str:
    return f"WITH src AS (SELECT {key}, {x} AS v FROM {table}), {central('src', key, ['v'])} SELECT {MOMENTS.format(key=key, bc=bc('v'))} FROM cm"


def island(index: str, src: str, keep: str, gap: int) -> str:
    return f"""i1 AS (SELECT *, CASE WHEN {index} - lag({index}) OVER (ORDER BY {index}) > {gap + 1} THEN 1 WHEN lag({index}) OVER (ORDER BY {index}) IS NULL THEN 1 ELSE 0 END AS fresh FROM {src} WHERE {keep}),
i2 AS (SELECT *, sum(fresh) OVER (ORDER BY {index}) AS island FROM i1)"""


def segments_sql(pre: str, least: float, gap: int, shift: int) -> str:
    return f"WITH {pre}, {island('window_start', 'prof', f'score >= {least}', gap)} SELECT (min(window_start)+{shift})::BIGINT AS start_res, (max(window_end)+{shift})::BIGINT AS end_res, arg_max(window_start, score)::BIGINT AS peak_start, round(max(score), 6) + 0.0 AS score FROM i2 GROUP BY island"


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + "".join(f"{'-' if k % 2 else '+'}{m[0][k]}*{_det([r[:k] + r[k + 1:] for r in m[1:]])}" for k in range(len(m))) + ")"


def _network3() -> str:
    """The network of three features (kappa, tau, theta) from inv; determinants of minors are columns of their own, one CTE for each size."""
    f = "kte"
    source = """rw AS (SELECT frame_id, res, kappa, coalesce(tau, lag(tau) OVER (PARTITION BY frame_id ORDER BY res)) AS tau, theta FROM inv),
nr AS (SELECT * FROM rw WHERE kappa IS NOT NULL),
cm AS (SELECT res, atan2(sum(sin(kappa)), sum(cos(kappa))) AS mk, atan2(sum(sin(tau)), sum(cos(tau))) AS mt, atan2(sum(sin(theta)), sum(cos(theta))) AS me FROM nr GROUP BY res),
ft AS (SELECT frame_id, n.res + 1 AS res, atan2(sin(kappa-mk), cos(kappa-mk)) AS k, atan2(sin(tau-mt), cos(tau-mt)) AS t, atan2(sin(theta-me), cos(theta-me)) AS e FROM nr n JOIN cm ON cm.res = n.res)"""
    both = [f"a.{x}" for x in f] + [f"b.{x}" for x in f]
    sums = ", ".join(f"sum({both[r]}*{both[c]})/(count(*)-1) + {'1e-6' if r == c else '0'} AS s{r}{c}" for r in range(6) for c in range(6))
    layers, before = [], "mm"
    for size in range(1, 7):  # minors of the first ``size`` rows, by their columns; the joint covariance has the regulariser twice
        cells = []
        for cols in combinations(range(6), size):
            name = "d" + "".join(map(str, cols))
            row = size - 1
            entry = lambda c: f"(s{row}{c}{' + 1e-6' if row == c else ''})"
            if size == 1:
                cells.append(f"{entry(cols[0])} AS {name}")
            else:
                cells.append("".join(f"{'-' if (size - 1 - k) % 2 else '+'}{entry(c)}*d{''.join(map(str, cols[:k] + cols[k + 1:]))}" for k, c in enumerate(cols)) + f" AS {name}")
        layers.append(f"y{size} AS (SELECT *, {', '.join(cells)} FROM {before})")
        before = f"y{size}"
    one = _det([[f"s{r}{c}" for c in range(3)] for r in range(3)])
    two = _det([[f"s{r}{c}" for c in range(3, 6)] for r in range(3, 6)])
    return f"""{source}, mm AS (SELECT a.res AS i, b.res AS j, {sums} FROM ft a JOIN ft b ON a.frame_id = b.frame_id AND a.res < b.res GROUP BY a.res, b.res),
{', '.join(layers)}, ed AS (SELECT i, j, sqrt(greatest(0, least(1, 1 - exp(-2 * greatest(0, -0.5 * (ln(d012345) - ln({one}) - ln({two}))))))) AS r FROM y6)"""


#: Best rotation by the singular values of the 3 x 3 product: two from the eigenvalues of its square, the third from its determinant.
SUPERPOSED = f"""WITH {FRAMES}, o AS (SELECT res, x AS rx, y AS ry, z AS rz FROM p WHERE frame_id = 0),
j AS (SELECT p.*, rx, ry, rz FROM p JOIN o USING (res)),
m AS (SELECT frame_id, {', '.join(f'avg({c}) AS m{c}' for c in ('x', 'y', 'z', 'rx', 'ry', 'rz'))} FROM j GROUP BY frame_id),
h AS (SELECT frame_id, count(*) AS n, sum((x-mx)**2 + (y-my)**2 + (z-mz)**2 + (rx-mrx)**2 + (ry-mry)**2 + (rz-mrz)**2) AS q, {', '.join(f'sum(({a}-m{a})*(r{b}-mr{b})) AS h{a}{b}' for a in 'xyz' for b in 'xyz')} FROM j JOIN m USING (frame_id) GROUP BY frame_id),
g AS (SELECT *, {', '.join(f"{'+'.join(f'h{k}{a}*h{k}{b}' for k in 'xyz')} AS g{a}{b}" for a in 'xyz' for b in 'xyz')}, {_det([[f'h{a}{b}' for b in 'xyz'] for a in 'xyz'])} AS det FROM h),
e AS (SELECT *, (gxx + gyy + gzz) / 3 AS c, sqrt(((gxx - (gxx+gyy+gzz)/3)**2 + (gyy - (gxx+gyy+gzz)/3)**2 + (gzz - (gxx+gyy+gzz)/3)**2 + 2*(gxy**2 + gxz**2 + gyz**2)) / 6) AS s FROM g),
a AS (SELECT *, acos(greatest(-1, least(1, ({_det([[f"((g{a}{b}{' - c' if a == b else ''})/s)" for b in 'xyz'] for a in 'xyz'])}) / 2))) / 3 AS phi FROM e),
d AS (SELECT *, sqrt(c + 2*s*cos(phi)) AS d1, sqrt(greatest(0, 3*c - (c + 2*s*cos(phi)) - (c + 2*s*cos(phi + 2*pi()/3)))) AS d2 FROM a)
SELECT frame_id, round(sqrt(greatest(0, q - 2*(d1 + d2 + det/(d1*d2))) / n), 6) + 0.0 AS rmsd FROM d"""


def three(cols: str) -> str:
    return ", ".join(f"printf('%8.3f', {c})::DOUBLE AS {c}" for c in cols.split())


#: frame_id, res, x, y, z, px, py, pz from p: the second strand from the bisector of a point's neighbours.
BUILT = f"""WITH a AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p{c}, lead({c}) OVER w AS n{c}" for c in "xyz")} FROM p WINDOW w AS {W}),
 b AS (SELECT *, {", ".join(f"2*{c} - p{c} - n{c} AS d{c}, coalesce(n{c} - p{c}, 2*(n{c} - {c}), 2*({c} - p{c})) AS a{c}" for c in "xyz")} FROM a),
 c AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) >= 1e-9 AS bent, abs(ax) > 0.1 OR abs(ay) > 0.1 AS flat FROM b),
 e AS (SELECT *, CASE WHEN bent THEN dx WHEN flat THEN -ay ELSE 0 END AS ux, CASE WHEN bent THEN dy WHEN flat THEN ax ELSE -az END AS uy, CASE WHEN bent THEN dz WHEN flat THEN 0 ELSE ay END AS uz FROM c)
 SELECT frame_id, res, x, y, z, {", ".join(f"{c} + 1.52*u{c}/sqrt(ux*ux+uy*uy+uz*uz) AS p{c}" for c in "xyz")} FROM e"""
_INDEX = f"WITH {FRAMES}, {PAIRS}, {LOCAL5}, {SPECTRUM}"
SQL: dict[str, str] = {
    "segment_lengths": f"WITH {FRAMES}, {geometry()} SELECT frame_id, {long('res')}, {rd('seg tx ty tz')} FROM inv WHERE seg IS NOT NULL",
    "curve_invariants": f"WITH {FRAMES}, {geometry()} SELECT frame_id, {long('res')}, {rd('seg kappa tau')} FROM inv",
    "curve_totals": f"WITH {FRAMES}, {geometry()} SELECT frame_id, round(coalesce(sum(kappa), 0), 6) + 0.0 AS total_curvature, round(coalesce(avg(seg), 0), 6) + 0.0 AS mean_segment FROM inv GROUP BY frame_id",
    "curve_invariants_events": f"WITH {USERS}, {geometry()} SELECT frame_id, {long('res')}, {rd('seg kappa tau')} FROM inv",
    "subcurve_invariants": f"WITH {FRAMES.replace('range(0, 21)', 'range(5, 13)')}, {geometry()} SELECT frame_id, {long('res')}, {rd('seg kappa tau')} FROM inv",
    "theta_beta": f"WITH {RIBBONS}, {geometry(True)} SELECT frame_id, {long('res')}, {rd('theta')} FROM inv WHERE theta IS NOT NULL",
    "base_angles": f"WITH {BASES}, {geometry(True)} SELECT frame_id, {long('res')}, {rd('theta kappa')} FROM inv WHERE theta IS NOT NULL",
    "pseudo_strand": f"WITH {FRAMES}, built AS ({BUILT}) SELECT frame_id, {long('res')}, {rd('px py pz')} FROM built",
    "total_writhe": f"WITH {FRAMES}, {PAIRS} SELECT frame_id, round(sum(w), 6) + 0.0 AS writhe FROM pairs GROUP BY frame_id",
    "total_writhe_standard": f"WITH {FRAMES}, {PAIRS} SELECT frame_id, round(-2*sum(w), 6) + 0.0 AS writhe FROM pairs GROUP BY frame_id",
    "local_writhe": f"WITH {FRAMES}, {PAIRS}, {LOCAL} SELECT frame_id, {long('res')}, {rd('writhe')} FROM lw",
    "compactness": f"WITH {FRAMES}, {PAIRS}, {geometry()}, {COMPACT} SELECT frame_id, {long('res')}, {rd('compactness')} FROM comp",
    "density_profile": f"WITH {FRAMES}, {PAIRS}, {geometry()}, {COMPACT}, {DENSITY} SELECT {long('res')}, {rd('mean_density std_density z_score')} FROM dens",
    "transient_motifs": f"WITH {FRAMES}, {PAIRS}, {geometry()}, {COMPACT}, {DENSITY}, {island('res', 'dens', 'z_score >= 0.5', 0)} SELECT min(res)::BIGINT AS start_res, max(res)::BIGINT AS end_res, arg_max(res, mean_density)::BIGINT AS peak_res, round(avg(mean_density), 6) + 0.0 AS mean_compactness, round(max(mean_density), 6) + 0.0 AS peak_compactness, round(arg_max(z_score, mean_density), 6) + 0.0 AS z_score FROM i2 GROUP BY island",
    "moments_by_event_type": moments("events", "event_type", "value"),
    "moments_by_returnflag": moments("lineitem", "l_returnflag", "l_extendedprice"),
    "bimodality_profile": f"WITH {FRAMES}, {geometry()}, {E8} SELECT {long('window_start window_end')}, {rd('bc_kappa bc_tau score')} FROM prof",
    "bimodality_profile_theta": f"WITH {RIBBONS}, {geometry(True)}, {profile({'kappa': 2, 'tau': 1, 'theta': 2}, 5)} SELECT {long('window_start window_end')}, {rd('bc_kappa bc_tau bc_theta score')} FROM prof",
    "bimodality_profile_unwrapped": f"WITH {RNA} SELECT {long('window_start window_end')}, {rd('bc_kappa bc_tau bc_theta score')} FROM prof",
    "switching_segments": segments_sql(f"{FRAMES}, {geometry()}, {E8}", 0.345, 0, 0),
    "switching_hinges": segments_sql(RNA, 0.33, 0, 1),
    "writhe_range": f"{_INDEX} SELECT frame_id, {rd('writhe_distance')} FROM sp WHERE writhe_distance <= 0.8",
    "writhe_knn": f"{_INDEX} SELECT frame_id, {rd('writhe_distance')} FROM sp ORDER BY sp.writhe_distance, frame_id LIMIT 20",
    "conformer_search": f"WITH RECURSIVE {FRAMES}, {PAIRS}, {LOCAL5}, {SPECTRUM}, {geometry()}, {ARRAYS}, c AS (SELECT a.frame_id, writhe_distance, b.k AS ka, b.t AS ta, a.k AS kb, a.t AS tb FROM ar a JOIN ar b ON b.frame_id = 10 JOIN sp ON sp.frame_id = a.frame_id WHERE writhe_distance <= 0.9), {grid('c', 'frame_id, writhe_distance', *SHORTER, BEND, False)} SELECT frame_id, {rd('writhe_distance')}, round(far, 6) + 0.0 AS frechet FROM dp WHERE far <= 2.2",
    "conformer_knn": f"WITH RECURSIVE {FRAMES}, {PAIRS}, {LOCAL5}, {SPECTRUM}, {geometry()}, {ARRAYS}, near AS (SELECT * FROM sp WHERE (SELECT count(*) FROM sp WHERE writhe_distance <= 0.1) >= 10 AND writhe_distance <= 0.1 OR (SELECT count(*) FROM sp WHERE writhe_distance <= 0.1) < 10 AND frame_id IN (SELECT frame_id FROM sp ORDER BY sp.writhe_distance, sp.frame_id LIMIT 30)), c AS (SELECT a.frame_id, writhe_distance, b.k AS ka, b.t AS ta, a.k AS kb, a.t AS tb FROM ar a JOIN ar b ON b.frame_id = 10 JOIN near ON near.frame_id = a.frame_id), {grid('c', 'frame_id, writhe_distance', *SHORTER, BEND, False)} SELECT frame_id, {rd('writhe_distance')}, round(far, 6) + 0.0 AS frechet FROM dp ORDER BY far, dp.writhe_distance, frame_id LIMIT 10",
    "conformer_knn_points": f"WITH RECURSIVE {WITH_ASKED}, {PAIRS}, {LOCAL5}, {SPECTRUM.replace('b.frame_id = 10', 'b.frame_id = -1')}, {geometry()}, {ARRAYS}, near AS (SELECT * FROM sp WHERE frame_id <> -1 AND writhe_distance <= 1.0), c AS (SELECT a.frame_id, writhe_distance, b.k AS ka, b.t AS ta, a.k AS kb, a.t AS tb FROM ar a JOIN ar b ON b.frame_id = -1 JOIN near ON near.frame_id = a.frame_id), {grid('c', 'frame_id, writhe_distance', *SHORTER, BEND, False)} SELECT frame_id, {rd('writhe_distance')}, round(far, 6) + 0.0 AS frechet FROM dp ORDER BY far, dp.writhe_distance, frame_id LIMIT 25",
    "subcurve_knn": f"WITH RECURSIVE {FRAMES.replace('range(0, 21)', 'range(3, 9)')}, {geometry()}, {ARRAYS}, c AS (SELECT a.frame_id, b.k AS ka, b.t AS ta, a.k AS kb, a.t AS tb FROM ar a, ar b WHERE b.frame_id = 10), {grid('c', 'frame_id', *SHORTER, BEND, False)} SELECT frame_id, round(far, 6) + 0.0 AS frechet FROM dp ORDER BY far, frame_id LIMIT 10",
    "subcurve_knn_points": f"WITH RECURSIVE {WITH_ASKED.replace('range(0, 21)', 'range(3, 9)')}, {geometry()}, {ARRAYS}, c AS (SELECT a.frame_id, b.k AS ka, b.t AS ta, a.k AS kb, a.t AS tb FROM ar a, ar b WHERE b.frame_id = -1 AND a.frame_id <> -1), {grid('c', 'frame_id', *SHORTER, BEND, False)} SELECT frame_id, round(far, 6) + 0.0 AS frechet FROM dp ORDER BY far, frame_id LIMIT 15",
    "time_warp_pairs": f"WITH RECURSIVE {FRAMES}, {geometry()}, {ARRAYS}, c AS (SELECT x.frame_id AS a, y.frame_id AS b, x.k AS ka, x.t AS ta, y.k AS kb, y.t AS tb FROM ar x JOIN ar y ON y.frame_id = x.frame_id + 1), {grid('c', 'a, b', *SHORTER, BEND, True)} SELECT a, b, round(far / (n + m), 6) + 0.0 AS warp FROM dp",
    "frechet_points_users": f"WITH RECURSIVE {USERS}, ar AS (SELECT frame_id, list([x, y, z] ORDER BY res) AS c FROM p GROUP BY frame_id), c AS (SELECT x.frame_id AS a, y.frame_id AS b, x.c AS ca, y.c AS cb FROM ar x JOIN ar y ON y.frame_id = x.frame_id + 1), "
    + grid("c", "a, b", "len(ca)", "len(cb)", "sqrt(" + " + ".join(f"(ca[<i> + 1][{k}] - cb[<j> + 1][{k}]) ** 2" for k in (1, 2, 3)) + ")", False)
    + " SELECT a, b, round(far, 6) + 0.0 AS frechet FROM dp",
    "correlation_network_theta": f"WITH {RIBBONS}, {geometry(True)}, {_network3()} SELECT {long('i j')}, {rd('r')} FROM ed",
    "superposition_rmsd": SUPERPOSED,
    "free_energy": f"WITH {FRAMES}, {PAIRS}, t AS (SELECT frame_id, sum(w) AS v FROM pairs GROUP BY frame_id), q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, stddev_samp(v) * count(*) ** -0.2 AS h, count(*) AS n FROM t), g AS (SELECT lo + (hi - lo) * i / 49 AS x, h, n FROM q, range(0, 50) r(i)), e AS (SELECT x, -ln(greatest(sum(exp(-((v - x) ** 2) / (2 * h * h))) / any_value(n * h * sqrt(2 * pi())), 1e-4)) AS u FROM g, t GROUP BY x) SELECT round(x, 6) + 0.0 AS x, round(u - (SELECT min(u) FROM e), 6) + 0.0 AS energy FROM e",
    "correlation_network": f"WITH {EDGES} SELECT {long('i j')}, {rd('r')} FROM ed",
    "inter_network": f"WITH {FRAMES}, {CHAINS}, "
    + geometry().replace("FROM p ", "FROM pa ").replace("inv AS", "inva AS")
    + ", "
    + geometry().replace("FROM p ", "FROM pb ").replace("g1", "h1").replace("g2", "h2").replace("g3", "h3").replace("g4", "h4").replace("g5", "h5").replace("g6", "h6").replace("g7", "h7").replace("g8", "h8").replace("inv AS", "invb AS")
    + ", "
    + NET.replace("inv)", "inva)")
    + NET.replace("inv)", "invb)").replace("rw", "rx").replace("nr", "ny_").replace("cm", "cn_").replace("ft AS", "fu AS")
    + net("ft", "fu", "true")
    + f" SELECT {long('i j')}, {rd('r')} FROM ed",
    "cooperativity": f"WITH {EDGES}, two AS (SELECT i, j, r FROM ed UNION ALL SELECT j, i, r FROM ed), want(i, j) AS (VALUES (2, 3), (3, 4), (5, 4), (3, 4), (0, 40)) SELECT round(coalesce(avg(r), 0), 6) + 0.0 AS cooperativity FROM want JOIN two USING (i, j)",
    "centrality": f"WITH {EDGES}, two AS (SELECT i AS res, r FROM ed WHERE j - i >= 4 UNION ALL SELECT j, r FROM ed WHERE j - i >= 4) SELECT {long('res')}, round(sum(r), 6) + 0.0 AS centrality FROM two GROUP BY res",
    "top_pairs": f"WITH {EDGES} SELECT {long('i j')}, {rd('r')} FROM ed WHERE j - i >= 8 ORDER BY ed.r DESC, ed.i, ed.j LIMIT 10",
    "interface_contacts": f"WITH {FRAMES}, {CHAINS}, d AS (SELECT a.frame_id, a.res AS i, b.res AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS distance FROM pa a JOIN pb b ON a.frame_id = b.frame_id) SELECT frame_id, {long('i j')}, {rd('distance')} FROM d WHERE distance < 0.1",
    "buried_area": f"WITH {FRAMES}, {CHAINS}, d AS (SELECT a.frame_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM pa a JOIN pb b ON a.frame_id = b.frame_id) SELECT frame_id, round(450 + sum(22.5 * exp(-(d-4.5)*(d-4.5)/12.5)), 6) + 0.0 AS area FROM d GROUP BY frame_id",
    "pair_states": f"WITH {FRAMES}, d AS (SELECT a.frame_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS distance FROM p a JOIN p b ON a.frame_id = b.frame_id AND a.res = 2 AND b.res = 15) SELECT frame_id, {rd('distance')}, (d.distance > (SELECT median(distance) FROM d))::INT::BIGINT AS state FROM d",
    "silhouette": "WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), d AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(list_distance(a.e, b.e)) AS m FROM f a JOIN f b ON a.vec_id <> b.vec_id GROUP BY ALL), w AS (SELECT vec_id, max(CASE WHEN la = lb THEN m END) AS own, min(CASE WHEN la <> lb THEN m END) AS other FROM d GROUP BY vec_id) SELECT round(avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 6) + 0.0 AS silhouette FROM w",
    "nearest_state": f"WITH {FRAMES}, {PAIRS}, {LOCAL5}, t AS (SELECT a.frame_id, b.frame_id AS q, avg((a.writhe-b.writhe)*(a.writhe-b.writhe)) AS d FROM lw a JOIN lw b ON a.res = b.res AND b.frame_id IN (3, 7) GROUP BY ALL) SELECT x.frame_id, (y.d < x.d)::INT::BIGINT AS state FROM t x JOIN t y ON x.frame_id = y.frame_id AND x.q = 3 AND y.q = 7",
    "order_curve_lengths": f"WITH p AS (SELECT l_orderkey AS frame_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS res, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem), {geometry()} SELECT frame_id, count(*)::BIGINT AS points, round(sum(seg), 6) + 0.0 AS length FROM inv GROUP BY frame_id HAVING count(*) >= 4",
    "pdb_round_trip": f"WITH {FRAMES} SELECT frame_id, (res + 1)::BIGINT AS seq_id, 'A' AS chain_id, 'ALA' AS name, printf('%8.3f', x)::DOUBLE + 0.0 AS x, printf('%8.3f', y)::DOUBLE + 0.0 AS y, printf('%8.3f', z)::DOUBLE + 0.0 AS z FROM p",
    "curve_arrays": f"WITH {FRAMES} SELECT frame_id, {long('res')}, {rd('x y z')} FROM p",
    "rebuilt_lengths": f"WITH {FRAMES}, {geometry()}, {PAIRS}, t AS (SELECT frame_id, sum(w) AS writhe FROM pairs GROUP BY frame_id) SELECT frame_id, round(coalesce(sum(kappa), 0), 6) + 0.0 AS total_curvature, round(coalesce(avg(seg), 0), 6) + 0.0 AS mean_segment, round(any_value(writhe), 6) + 0.0 AS writhe FROM inv JOIN t USING (frame_id) GROUP BY frame_id",
    "pdb_ribbons": f"WITH {FRAMES.replace('range(0, 21)', 'range(0, 10)').replace('p AS', 'o AS', 1)}, p AS (SELECT frame_id, res, {three('x y z')} FROM o), w AS (SELECT vec_id AS frame_id, r::INT AS res, {', '.join(f"printf('%8.3f', embedding[3*r+{31 + k}])::DOUBLE AS c{c}" for k, c in enumerate('xyz'))} FROM embeddings, range(0, 10) t(r)), built AS ({BUILT}) SELECT b.frame_id, {long('b.res').replace('AS b.res', 'AS res')}, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, {', '.join(f"round(CASE WHEN b.res % 2 = 1 AND (cx <> x OR cy <> y OR cz <> z) THEN c{c} ELSE p{c} END, 6) + 0.0 AS c{c}" for c in 'xyz')} FROM built b JOIN w ON w.frame_id = b.frame_id AND w.res = b.res",
    "pdb_nucleotides": f"""WITH b AS (SELECT vec_id AS frame_id, r::INT AS res, {', '.join(f"printf('%8.3f', embedding[3*(r+{s})+{k + 1}])::DOUBLE AS {n}{c}" for s, n in ((0, 'p'), (7, 'o'), (14, 'n')) for k, c in enumerate('xyz'))} FROM embeddings, range(0, 7) t(r)),
 d AS (SELECT *, sqrt((px-ox)**2 + (py-oy)**2 + (pz-oz)**2) AS l FROM b)
 SELECT frame_id, {long('res')}, CASE WHEN res % 2 = 0 THEN 'ADE' ELSE 'URA' END AS name, {', '.join(f"round(CASE WHEN res % 2 = 0 THEN p{c} WHEN l >= 1e-9 THEN p{c} + 1.6*(p{c}-o{c})/l ELSE o{c} + {3.5 if c == 'z' else 0} END, 6) + 0.0 AS {c}" for c in 'xyz')}, {', '.join(f"round({n}{c}, 6) + 0.0 AS {n}{c}" for n in 'on' for c in 'xyz')} FROM d""",
    "pdb_residue_ids": f"WITH {FRAMES} SELECT frame_id, (res + 1)::BIGINT AS seq_id FROM p",
    "pdb_models": f"WITH {FRAMES}, f AS (SELECT *, dense_rank() OVER (ORDER BY frame_id) AS model FROM p) SELECT model::BIGINT AS model, (res + 1)::BIGINT AS seq_id, {', '.join(f"printf('%8.3f', {c})::DOUBLE + 0.0 AS {c}" for c in 'xyz')} FROM f",
    "curve_bundles": f"WITH {FRAMES}, {PAIRS}, {LOCAL} SELECT frame_id, {long('res')}, {rd('writhe')} FROM lw",
    "base_bundles": f"WITH {BASES}, {geometry(True)}, {PAIRS}, {LOCAL.replace('- 4', '- 2').replace('+ 3', '+ 1').replace('BETWEEN 4 AND 16', 'BETWEEN 2 AND 4')} SELECT i.frame_id, i.res::BIGINT AS res, round(theta, 6) + 0.0 AS theta, round(writhe, 6) + 0.0 AS writhe FROM inv i LEFT JOIN lw ON lw.frame_id = i.frame_id AND lw.res = i.res + 2 WHERE theta IS NOT NULL",
    "invariant_deltas": f"WITH {RIBBONS}, {geometry(True)} SELECT a.res::BIGINT AS res, round(abs(a.kappa - b.kappa), 6) + 0.0 AS d_kappa, {', '.join(f'round(degrees(CASE WHEN abs(a.{c} - b.{c}) > pi() THEN 2*pi() - abs(a.{c} - b.{c}) ELSE abs(a.{c} - b.{c}) END), 6) + 0.0 AS d_{c}' for c in ('tau', 'theta'))} FROM inv a JOIN inv b ON a.res = b.res AND a.frame_id = 3 AND b.frame_id = 8 WHERE a.kappa IS NOT NULL AND b.kappa IS NOT NULL",
    "sliding_frechet": f"WITH RECURSIVE {USERS}, w AS (SELECT frame_id, s.v AS start, list([x, y, z] ORDER BY res) AS c FROM p JOIN (SELECT unnest(range(0, 200)) AS v) s ON p.res BETWEEN s.v AND s.v + 5 WHERE frame_id IN (3, 8) GROUP BY ALL HAVING count(*) = 6), c AS (SELECT x.start, x.c AS ca, y.c AS cb FROM w x JOIN w y ON x.start = y.start AND x.frame_id = 3 AND y.frame_id = 8), "
    + grid("c", "start", "6", "6", "sqrt(" + " + ".join(f"(ca[<i> + 1][{k}] - cb[<j> + 1][{k}]) ** 2" for k in (1, 2, 3)) + ")", False)
    + " SELECT start::BIGINT AS start, (start + 3)::BIGINT AS centre, round(far, 6) + 0.0 AS frechet FROM dp",
    "domain_means": f"WITH {FRAMES}, {PAIRS}, {geometry()}, {COMPACT}, {DENSITY} SELECT CASE WHEN res < 6 THEN 'head' WHEN res < 15 THEN 'middle' ELSE 'tail' END AS domain, round(avg(mean_density), 6) + 0.0 AS mean, arg_max(res, mean_density)::BIGINT AS peak_res, round(max(mean_density), 6) + 0.0 AS peak, round(avg(std_density) / sqrt((SELECT count(*) FROM embeddings)), 6) + 0.0 AS sem FROM dens GROUP BY 1",
    "energy_barrier": f"WITH {FRAMES}, {PAIRS}, t AS (SELECT frame_id, sum(w) AS v FROM pairs GROUP BY frame_id), q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi, stddev_samp(v) * count(*) ** -0.2 AS h FROM t), g AS (SELECT i, lo - 0.1*(hi - lo) + 1.2*(hi - lo) * i / 99 AS x, h FROM q, range(0, 100) r(i)), d AS (SELECT i, sum(exp(-((v - x) ** 2) / (2 * h * h))) AS d FROM g, t GROUP BY i), e0 AS (SELECT i, -ln(greatest(d / (SELECT max(d) FROM d), 1e-4)) AS u FROM d), e AS (SELECT i, u - (SELECT min(u) FROM e0) AS u FROM e0), s AS (SELECT arg_min(i, u) FILTER (i < 50) AS a, arg_min(i, u) FILTER (i >= 50) AS b, min(u) FILTER (i < 50) AS ua, min(u) FILTER (i >= 50) AS ub FROM e), k AS (SELECT max(u) AS top FROM e, s WHERE i >= a AND i < b) SELECT round(top - least(ua, ub), 6) + 0.0 AS height, round(ua, 6) + 0.0 AS well1, round(ub, 6) + 0.0 AS well2, round(top, 6) + 0.0 AS top FROM s, k",
    "histogram_barrier": "WITH u AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i)), m AS (SELECT i, avg(v) FILTER (label = 1) - avg(v) FILTER (label = 0) AS w FROM u GROUP BY i), l AS (SELECT sqrt(sum(w * w)) AS l FROM m), a AS (SELECT vec_id, sum(v * w / l) AS pos FROM u JOIN m USING (i), l GROUP BY vec_id), r AS (SELECT min(pos) AS lo, max(pos) AS hi FROM a), b AS (SELECT least(floor((pos - lo) / (hi - lo) * 50), 49) AS bin, count(*) AS n FROM a, r GROUP BY 1) SELECT round(CASE WHEN count(*) < 3 THEN 0 ELSE -ln(greatest(min(n) / max(n), 1e-12)) END, 6) + 0.0 AS barrier FROM b",
    "index_size": "SELECT count(*)::BIGINT AS frames, 21::BIGINT AS least_points, 21::BIGINT AS most_points FROM embeddings",
    "audit_writhe": f"WITH {FRAMES}, {PAIRS} SELECT frame_id, round(-2*sum(w), 6) + 0.0 AS writhe FROM pairs GROUP BY frame_id",
}

SQL |= {
    "pivot_range": f"{_INDEX} SELECT frame_id, {rd('writhe_distance')} FROM sp WHERE writhe_distance <= 0.9",
    "pivot_knn": SQL["writhe_knn"],
    "pivot_conformers": SQL["conformer_knn"],
    "merged_moments": SQL["moments_by_event_type"],
    "checked_orders": "SELECT l_orderkey AS frame_id, CASE WHEN count(*) >= 4 THEN count(*) - 1 ELSE 0 END AS segments, CASE WHEN count(*) >= 4 THEN '' ELSE 'too few points' END AS reason, CASE WHEN count(*) >= 4 THEN -1 ELSE count(*) END AS place FROM lineitem GROUP BY l_orderkey",
    "nearest_by_writhe": f"{_INDEX} SELECT frame_id, round(writhe_distance, 6) + 0.0 AS distance FROM sp ORDER BY writhe_distance, frame_id LIMIT 15",
}


def _bends(weight: str, total: bool) -> str:
    """CTE ``dp`` of the programmes of frame 10 against all."""
    cost = BEND.replace("sqrt((ka", f"sqrt({weight} * (ka")
    return f"WITH RECURSIVE {FRAMES}, {geometry()}, {ARRAYS}, c AS (SELECT a.frame_id, b.k AS ka, b.t AS ta, a.k AS kb, a.t AS tb FROM ar a, ar b WHERE b.frame_id = 10), {grid('c', 'frame_id', *SHORTER, cost, total)}"


SQL |= {
    "nearest_by_frechet": _bends("4", False) + " SELECT frame_id, round(far, 6) + 0.0 AS distance FROM dp ORDER BY far, frame_id LIMIT 15",
    "nearest_by_warp": _bends("1", True) + " SELECT frame_id, round(far / (n + m), 6) + 0.0 AS distance FROM dp ORDER BY far / (n + m), frame_id LIMIT 15",
    "within_frechet_pivots": _bends("1", False) + " SELECT frame_id, round(far, 6) + 0.0 AS distance FROM dp WHERE far <= 2.3",
}


def _cofactors(m: list[list[str]], row: int) -> list[str]:
    rest = [r for i, r in enumerate(m) if i != row]
    return [("-" if (row + k) % 2 else "") + _det([r[:k] + r[k + 1 :] for r in rest]) for k in range(4)]


def turned(points: str, mask: str) -> str:
    """CTE ``al``: the rows of ``p`` with x, y, z and its second strand laid on frame 0 by the masked points.

    The rotation is a quaternion: the vector of the largest eigenvalue (the sum of the singular values that :data:`SUPERPOSED` has)
    of the symmetric 4 x 4 matrix of the products, from the row of the adjugate that is largest.
    """
    h = SUPERPOSED[SUPERPOSED.index("o AS ") : SUPERPOSED.index("SELECT frame_id, round(sqrt")].replace("FROM p JOIN o USING (res)", f"FROM p JOIN o USING (res) WHERE {mask}")
    n = [["hxx+hyy+hzz", "hyz-hzy", "hzx-hxz", "hxy-hyx"], ["", "hxx-hyy-hzz", "hxy+hyx", "hzx+hxz"], ["", "", "hyy-hxx-hzz", "hyz+hzy"], ["", "", "", "hzz-hxx-hyy"]]
    n = [[f"({n[min(i, j)][max(i, j)]}{' - top' if i == j else ''})" for j in range(4)] for i in range(4)]
    quads = ", ".join(f"[{', '.join(_cofactors(n, i))}] AS q{i}" for i in range(4))
    one = lambda p, c: {
        "x": f"(w*w+a*a-b*b-g*g)*({p}x-mx) + 2*(a*b-w*g)*({p}y-my) + 2*(a*g+w*b)*({p}z-mz) + mrx",
        "y": f"2*(a*b+w*g)*({p}x-mx) + (w*w-a*a+b*b-g*g)*({p}y-my) + 2*(b*g-w*a)*({p}z-mz) + mry",
        "z": f"2*(a*g-w*b)*({p}x-mx) + 2*(b*g+w*a)*({p}y-my) + (w*w-a*a-b*b+g*g)*({p}z-mz) + mrz",
    }[c]
    strands = ["", "c"] if "cx" in points else [""]
    return f"""{points}, {h},
tp AS (SELECT *, d1 + d2 + det/(d1*d2) AS top FROM d), qd AS (SELECT frame_id, {quads} FROM tp),
qb AS (SELECT frame_id, list_reduce([q0, q1, q2, q3], lambda s, t: CASE WHEN list_inner_product(t, t) > list_inner_product(s, s) THEN t ELSE s END) AS q FROM qd),
qn AS (SELECT frame_id, q[1]/l AS w, q[2]/l AS a, q[3]/l AS b, q[4]/l AS g FROM (SELECT *, sqrt(list_inner_product(q, q)) AS l FROM qb)),
al AS (SELECT p.frame_id, p.res, {', '.join(f'{one(p, c)} AS {p}{c}' for p in strands for c in 'xyz')} FROM p JOIN qn USING (frame_id) JOIN m USING (frame_id))"""


_STRANDS = FRAMES.replace("range(0, 21)", "range(0, 10)").replace(" AS z FROM", " AS z, " + ", ".join(f"embedding[3*r+{31 + k}]::DOUBLE AS c{c}" for k, c in enumerate("xyz")) + " FROM")
SQL |= {
    "masked_superposition": f"WITH {turned(FRAMES, 'res < 12')} SELECT al.frame_id, round(sqrt(avg((al.x-o.rx)**2 + (al.y-o.ry)**2 + (al.z-o.rz)**2)), 6) + 0.0 AS rmsd FROM al JOIN o USING (res) WHERE res >= 12 GROUP BY al.frame_id",
    "superposed_points": f"WITH {turned(_STRANDS, 'res BETWEEN 2 AND 7')} SELECT frame_id, {long('res')}, {rd('x y z cx cy cz')} FROM al",
}
SQL |= {
    "structures_in_sql": f"WITH {FRAMES}, t AS (SELECT frame_id, res, {three('x y z')} FROM p), o AS (SELECT res, x AS ox, y AS oy FROM t WHERE frame_id = 0), a AS (SELECT frame_id, abs(atan2(y, x) - atan2(oy, ox)) AS g FROM t JOIN o USING (res) WHERE res = 1) SELECT t.frame_id, count(*) AS residues, round(sqrt(avg((x - ox) * (x - ox))), 6) + 0.0 AS x_distance, round(any_value(CASE WHEN g > pi() THEN 2 * pi() - g ELSE g END), 6) + 0.0 AS turn FROM t JOIN o USING (res) JOIN a USING (frame_id) GROUP BY t.frame_id",
    "bucketed_invariants": SQL["curve_invariants"],
}


def _surface(points: int = 40, sigma: float = 0.8) -> str:
    """Energy surface of total writhe and curvature: kernel sums on the grid's nodes, then a fixed filter mirrored at the edges, along one axis after the other."""
    last, reach = points - 1, int(4 * sigma + 0.5)
    weights = f"f AS (SELECT o, exp(-0.5 * (o / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (k / {sigma}) ** 2)) FROM range({-reach}, {reach + 1}) u(k)) AS w FROM range({-reach}, {reach + 1}) t(o))"
    node = lambda k: f"CASE WHEN {k} < 0 THEN -({k}) - 1 WHEN {k} > {last} THEN {2 * last + 1} - ({k}) ELSE {k} END"
    grid = lambda c: f"lo{c} - 0.2*(hi{c} - lo{c}) + 1.4*(hi{c} - lo{c}) * k / {last}"
    return f"""WITH {FRAMES}, {PAIRS}, {geometry()}, t AS (SELECT frame_id, x, y FROM (SELECT frame_id, sum(w) AS x FROM pairs GROUP BY frame_id) JOIN (SELECT frame_id, sum(kappa) AS y FROM inv GROUP BY frame_id) USING (frame_id)),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.01) AS lo{c}, quantile_cont({c}, 0.99) AS hi{c}" for c in "xy")}, var_samp(x) * count(*) ** (-1.0 / 3) AS cxx, var_samp(y) * count(*) ** (-1.0 / 3) AS cyy, covar_samp(x, y) * count(*) ** (-1.0 / 3) AS cxy FROM t),
gx AS (SELECT k AS i, {grid("x")} AS gx FROM q, range(0, {points}) r(k)), gy AS (SELECT k AS j, {grid("y")} AS gy FROM q, range(0, {points}) r(k)),
d AS (SELECT i, j, gx, gy, sum(exp(-0.5 * ((gx-x)**2 * cyy - 2*(gx-x)*(gy-y)*cxy + (gy-y)**2 * cxx) / (cxx*cyy - cxy*cxy))) AS d FROM gx, gy, t, q GROUP BY ALL),
e AS (SELECT i, j, gx, gy, -ln(greatest(d / (SELECT max(d) FROM d), 1e-4)) AS u FROM d), {weights},
a AS (SELECT e.i, e.j, e.gx, e.gy, sum(w * o_.u) AS u FROM e, f, e o_ WHERE o_.i = e.i AND o_.j = ({node("e.j + o")}) GROUP BY ALL),
b AS (SELECT a.i, a.j, a.gx, a.gy, sum(w * o_.u) AS u FROM a, f, a o_ WHERE o_.j = a.j AND o_.i = ({node("a.i + o")}) GROUP BY ALL)
SELECT round(gx, 6) + 0.0 AS x, round(gy, 6) + 0.0 AS y, round(u - (SELECT min(u) FROM b), 6) + 0.0 AS energy FROM b"""


SQL["free_energy_surface"] = _surface()
SQL["trace_parts"] = "SELECT vec_id AS frame_id, 10::BIGINT AS points, 10::BIGINT AS strand_points, true AS has_strand, 8::BIGINT AS res, round(embedding[25]::DOUBLE, 6) + 0.0 AS x, round(embedding[55]::DOUBLE, 6) + 0.0 AS cx, round(embedding[56]::DOUBLE, 6) + 0.0 AS cy, round(embedding[57]::DOUBLE, 6) + 0.0 AS cz FROM embeddings"
