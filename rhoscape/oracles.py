"""SQL equivalents of the queries, for an independent engine over the same tables."""

from __future__ import annotations

import itertools
import math

from rhoscape.constants import BECKE_CELLS, BECKE_K, COULOMB, DENSITY_TO_AU, FIRST, GRADIENT_TO_AU, GRADES, RADIAL_BIN, RATIO_BIN, S_PREFACTOR, SECOND, SPHERE_A, SPHERE_B
from rhoscape.elements import COVALENT_RADIUS, SYMBOLS, ZVAL
from rhoscape.functions.chemistry import F_ELEMENTS
from rhoscape.kernels import topology
from rhoscape.kernels.spectral import PAIRS
from rhoscape.operators import metrics
from rhoscape.operators.geometry import ATOMS
from rhoscape.operators.geometry import SYMBOLS as BOUND
from rhoscape.operators.grid import CELL, GRID_FACTOR, SCALE, SIZE, smooth_sizes

N = SIZE
EPS = 1e-8


def num(x: float) -> str:
    """A double literal."""
    return f"{float(x)!r}::DOUBLE"


def values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(v if isinstance(v, str) else num(v) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


INDEX = f"idx AS (SELECT (v // {N * N})::INT AS i, (v // {N} % {N})::INT AS j, (v % {N})::INT AS k, v::BIGINT AS vox FROM range({N**3}) t(v))"
GRID = f"""{INDEX},
g AS (SELECT l_returnflag AS structure_id, (l_orderkey % {N})::INT AS i, (l_partkey % {N})::INT AS j, (l_suppkey % {N})::INT AS k, sum(l_quantity)::BIGINT AS held FROM lineitem GROUP BY ALL),
vx AS (SELECT s.structure_id, idx.i, idx.j, idx.k, idx.vox, coalesce(g.held, 0)::BIGINT AS rho FROM (SELECT DISTINCT structure_id FROM g) s CROSS JOIN idx LEFT JOIN g ON g.structure_id = s.structure_id AND g.i = idx.i AND g.j = idx.j AND g.k = idx.k)"""


def position(f: list[str], c: int) -> str:
    return " + ".join(f"{f[a]} * {num(CELL.rows[a, c])}" for a in range(3)) + " + 0.0"


POINTS = f"pts AS (SELECT vox, i, j, k, i / {N}.0 AS u1, j / {N}.0 AS u2, k / {N}.0 AS u3, " + ", ".join(f"{position([f'({d} / {N}.0)' for d in 'ijk'], c)} AS {'xyz'[c]}" for c in range(3)) + " FROM idx)"
ATOM = f"""at0 AS (SELECT (s_suppkey % {ATOMS})::INT AS atom, sum(n_regionkey) AS regions FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
atom AS (SELECT atom, ([{", ".join(f"'{s}'" for s in BOUND)}])[(regions % {len(BOUND)})::INT + 1] AS element, ((atom * 7) % {N}) / {N}.0 AS fx, ((atom * 3 + 1) % {N}) / {N}.0 AS fy, ((atom * 5 + 2) % {N}) / {N}.0 AS fz FROM at0),
rad AS (SELECT * FROM {values([(f"'{e}'", COVALENT_RADIUS[e]) for e in BOUND], "element, radius")})"""


def images(name: str, reach: float) -> str:
    r = [int(v) for v in CELL.repeats(reach)]
    f = ["(fx + t1)", "(fy + t2)", "(fz + t3)"]
    return f"""{name} AS (SELECT atom.*, radius, t1, t2, t3, fx + t1 AS f1, fy + t2 AS f2, fz + t3 AS f3, {", ".join(f"{position(f, c)} AS p{'xyz'[c]}" for c in range(3))}
    FROM atom JOIN rad USING (element) CROSS JOIN (SELECT unnest(range({-r[0]}, {r[0] + 1}))::INT AS t1) CROSS JOIN (SELECT unnest(range({-r[1]}, {r[1] + 1}))::INT AS t2) CROSS JOIN (SELECT unnest(range({-r[2]}, {r[2] + 1}))::INT AS t3))"""


DIST = "sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz))"
TIE = "round(u1 - f1, 9) DESC, round(u2 - f2, 9) DESC, round(u3 - f3, 9) DESC"
NEAR = f"""{images("im", CELL.reach)},
met AS (SELECT pts.*, im.*, {DIST} AS r FROM pts CROSS JOIN im),
ne AS (SELECT vox, atom, element, r, CASE WHEN r > 1e-12 THEN (x - px) / r ELSE 0 END AS ux, CASE WHEN r > 1e-12 THEN (y - py) / r ELSE 0 END AS uy, CASE WHEN r > 1e-12 THEN (z - pz) / r ELSE 0 END AS uz
    FROM met QUALIFY row_number() OVER (PARTITION BY vox ORDER BY round(r, 8), {TIE}) = 1)"""


def region(a: str, b: str) -> str:
    return f"CASE WHEN rs <= {a} * radius + {EPS!r} THEN 'core' WHEN rs <= {b} * radius + {EPS!r} THEN 'bond' ELSE 'int' END"


SPHERE = f"""sp AS (SELECT vox, atom AS sphere_atom, r AS rs, radius FROM met QUALIFY row_number() OVER (PARTITION BY vox ORDER BY round(r / radius, 9), element, {TIE}) = 1),
sr AS (SELECT *, {region(num(SPHERE_A), num(SPHERE_B))} AS region FROM sp)"""
GEOMETRY = f"{POINTS}, {ATOM}, {NEAR}, {SPHERE}"


def line(order: int, second: bool) -> dict[int, float]:
    if second:
        return {0: SECOND[order][0]} | {s * k: c for k, c in enumerate(SECOND[order][1:], 1) for s in (1, -1)}
    return {s * k: s * c for k, c in enumerate(FIRST[order], 1) for s in (1, -1)}


def derivative(axes: str, order: int, second: bool = False) -> str:
    """Sum over shifted copies of the grid, by arrays in index order."""
    terms = []
    if len(axes) == 1:
        for n, w in line(order, second).items():
            terms.append((w * N ** (2 if second else 1), {axes: n}))
    else:
        for (n, w), (m, v) in itertools.product(line(order, False).items(), repeat=2):
            terms.append((w * v * N * N, {axes[0]: n, axes[1]: m}))
    at = lambda o: "((i + {} + {n}) % {n}) * {nn} + ((j + {} + {n}) % {n}) * {n} + (k + {} + {n}) % {n} + 1".format(*(o.get(c, 0) for c in "ijk"), n=N, nn=N * N)
    return " + ".join(f"{num(w)} * a[{at(o)}]" for w, o in terms)


ARRAYS = "ar AS (SELECT structure_id, list(rho::DOUBLE ORDER BY vox) AS a FROM vx GROUP BY structure_id)"
AXES = "ijk"


def fractional(order: int = 4) -> str:
    g = ", ".join(f"{derivative(AXES[a], order)} AS g{a + 1}" for a in range(3))
    h = ", ".join(f"{derivative(AXES[a], order, True) if a == b else derivative(AXES[a] + AXES[b], order)} AS h{a + 1}{b + 1}" for a, b in PAIRS)
    return f"{ARRAYS}, fr AS (SELECT vx.*, {g}, {h} FROM vx JOIN ar USING (structure_id))"


def _cartesian() -> str:
    b, metric = CELL.reciprocal, CELL.metric
    g = ", ".join(" + ".join(f"g{a + 1} * {num(b[a, c])}" for a in range(3)) + f" AS g{'xyz'[c]}" for c in range(3))
    h = lambda a, c: f"h{min(a, c) + 1}{max(a, c) + 1}"
    diagonal = " + ".join(f"{h(a, a)} * {num(metric[a, a])}" for a in range(3))
    mixed = " + ".join(f"{h(a, c)} * {num(2 * metric[a, c])}" for a, c in PAIRS[3:])
    full = ", ".join(" + ".join(f"{h(a, c)} * {num(b[a, p] * b[c, q])}" for a in range(3) for c in range(3)) + f" AS h{'xyz'[p]}{'xyz'[q]}" for p, q in PAIRS)
    return f"{fractional()}, ca0 AS (SELECT *, {g}, {diagonal} + {mixed} AS lap, {diagonal} AS lap_diagonal, {full} FROM fr), ca AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS gn FROM ca0)"


CARTESIAN = _cartesian()
FULL = f"{GRID}, {CARTESIAN}, {GEOMETRY}, fu AS (SELECT ca.*, ne.atom, ne.element, ne.r, ux, uy, uz, sphere_atom, rs, radius, region FROM ca JOIN ne USING (vox) JOIN sr USING (vox))"
PLACED = f"{GRID}, {GEOMETRY}, pl AS (SELECT vx.*, ne.atom, ne.element, ne.r, sphere_atom, rs, radius, region FROM vx JOIN ne USING (vox) JOIN sr USING (vox))"


def eigen(source: str, target: str, names: tuple[str, str, str], m: tuple[str, ...]) -> str:
    xx, yy, zz, xy, xz, yz = m
    return f"""{target}q AS (SELECT *, ({xx} + {yy} + {zz}) / 3 AS eq FROM {source}),
{target}p AS (SELECT *, {xx} - eq AS ea, {yy} - eq AS eb, {zz} - eq AS ec, sqrt((({xx} - eq) * ({xx} - eq) + ({yy} - eq) * ({yy} - eq) + ({zz} - eq) * ({zz} - eq) + 2 * ({xy} * {xy} + {xz} * {xz} + {yz} * {yz})) / 6) AS ep FROM {target}q),
{target}r AS (SELECT *, CASE WHEN ep > 0 THEN (ea * (eb * ec - {yz} * {yz}) - {xy} * ({xy} * ec - {yz} * {xz}) + {xz} * ({xy} * {yz} - eb * {xz})) / (2 * ep * ep * ep) ELSE 0 END AS er FROM {target}p),
{target}f AS (SELECT *, acos(greatest(-1.0, least(1.0, er))) / 3 AS ef FROM {target}r),
{target}g AS (SELECT *, eq + 2 * ep * cos(ef) AS {names[2]}, eq + 2 * ep * cos(ef + {num(2 * math.pi / 3)}) AS {names[0]} FROM {target}f),
{target} AS (SELECT *, 3 * eq - {names[0]} - {names[2]} AS {names[1]} FROM {target}g)"""


CURVED = f"""{FULL}, {eigen("fu", "ei", ("e1", "e2", "e3"), ("hxx", "hyy", "hzz", "hxy", "hxz", "hyz"))},
cu0 AS (SELECT *, round(e1, 6) AS l1, round(e2, 6) AS l2, greatest(rho, 0) * {num(SCALE * DENSITY_TO_AU)} AS rho_au FROM ei),
cu AS (SELECT *, CASE WHEN rho_au > 1e-8 THEN gn * {num(SCALE * GRADIENT_TO_AU)} / ({num(S_PREFACTOR)} * pow(rho_au, {num(4 / 3)})) ELSE 'inf'::DOUBLE END AS s FROM cu0)"""
TWO_PI = num(2 * math.pi)
PHASE = f"{TWO_PI} * (m1 * {{0}} + m2 * {{1}} + m3 * {{2}})"
SIGNED = lambda c: f"(CASE WHEN {c} >= {N // 2} THEN {c} - {N} ELSE {c} END)"


def transform(half: bool) -> str:
    top = N // 2 + 1 if half else N
    weight = f"CASE WHEN c IN (0, {N // 2}) THEN 1.0 ELSE 2.0 END" if half else "1.0"
    phase = PHASE.format(f"(i / {N}.0)", f"(j / {N}.0)", f"(k / {N}.0)")
    return f"""mo AS (SELECT {SIGNED("a")} AS m1, {SIGNED("b")} AS m2, {"c" if half else SIGNED("c")} AS m3, {weight}::DOUBLE AS weight FROM range({N}) t(a), range({N}) u(b), range({top}) w(c)),
am AS (SELECT structure_id, m1, m2, m3, weight, sum(rho * cos({phase})) / {N**3} AS re, -sum(rho * sin({phase})) / {N**3} AS im FROM vx CROSS JOIN mo GROUP BY ALL)"""


def hartree() -> str:
    b = CELL.reciprocal
    wave = [" + ".join(f"m{a + 1} * {num(2 * math.pi * b[a, c])}" for a in range(3)) for c in range(3)]
    squared = " + ".join(f"({w}) * ({w})" for w in wave)
    return f"{transform(True)}, ha0 AS (SELECT *, {squared} AS q2 FROM am), ha AS (SELECT structure_id, m1, m2, m3, weight, CASE WHEN q2 = 0 THEN 0 ELSE re * {num(4 * math.pi * COULOMB * SCALE)} / q2 END AS re, CASE WHEN q2 = 0 THEN 0 ELSE im * {num(4 * math.pi * COULOMB * SCALE)} / q2 END AS im FROM ha0)"


SYNTH = "sum(weight * (re * cos({p}) - im * sin({p})))".format(p=PHASE.format("u1", "u2", "u3"))
FIELD = f"{GRID}, {GEOMETRY}, {hartree()}, fi AS (SELECT structure_id, vox, {SYNTH} AS v FROM ha CROSS JOIN pts GROUP BY ALL)"


def bonds(tol: float = 0.1) -> str:
    return f"""{images("bi", (1 + tol) * float(CELL.lengths.min()))},
ce AS (SELECT atom AS i, px AS x, py AS y, pz AS z FROM bi WHERE t1 = 0 AND t2 = 0 AND t3 = 0),
bm AS (SELECT i, atom AS j, t1, t2, t3, {DIST} AS length FROM ce CROSS JOIN bi WHERE {DIST} > 1e-9),
bs AS (SELECT *, min(length) OVER (PARTITION BY i) AS closest FROM bm),
bk AS (SELECT *, (i, j, t1, t2, t3) > (j, i, -t1, -t2, -t3) AS flip FROM bs WHERE length <= {num(1 + tol)} * closest + 1e-9),
bo AS (SELECT CASE WHEN flip THEN j ELSE i END AS i, CASE WHEN flip THEN i ELSE j END AS j, CASE WHEN flip THEN -t1 ELSE t1 END AS t1, CASE WHEN flip THEN -t2 ELSE t2 END AS t2, CASE WHEN flip THEN -t3 ELSE t3 END AS t3, min(length) AS length FROM bk GROUP BY 1, 2, 3, 4, 5)"""


def neighbours(table, off: str = "off", nb: str = "nb") -> str:
    step = CELL.rows / N
    rows = [(*map(int, o), k, float((o @ step @ (o @ step)) ** 0.5)) for k, o in enumerate(table)]
    return f"""{off} AS (SELECT * FROM {values(rows, "di, dj, dk, bit, length")}),
{nb} AS (SELECT v.structure_id, v.vox, v.rho, bit, length, w.rho AS there, w.vox AS too, w.rho < v.rho OR (w.rho = v.rho AND w.vox < v.vox) AS lower
    FROM vx v CROSS JOIN {off} JOIN vx w ON w.structure_id = v.structure_id AND w.i = (v.i + di + {N}) % {N} AND w.j = (v.j + dj + {N}) % {N} AND w.k = (v.k + dk + {N}) % {N})"""


BASINS = f"""{neighbours(topology.CUBE)},
pt AS (SELECT vx.structure_id, vx.vox, coalesce(b.too, vx.vox) AS too FROM vx LEFT JOIN (SELECT * FROM nb WHERE NOT lower QUALIFY row_number() OVER (PARTITION BY structure_id, vox ORDER BY round((there - rho) / length, 9) DESC, bit) = 1) b USING (structure_id, vox)),
climb AS (SELECT structure_id, vox, too, 0 AS step FROM pt UNION ALL SELECT c.structure_id, c.vox, p.too, step + 1 FROM climb c JOIN pt p ON p.structure_id = c.structure_id AND p.vox = c.too WHERE p.too <> c.too),
ba AS (SELECT structure_id, vox, arg_max(too, step) AS basin FROM climb GROUP BY ALL)"""
DV = CELL.volume / N**3


def r6(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {digits}) + 0.0 AS {c.split(' AS ')[-1]}" for c in columns)


def share(part: str, whole: str, value: float = 0.0) -> str:
    return f"coalesce({part} / nullif({whole}, 0), {value!r})"


def sites(base: str) -> str:
    radial = "abs(gx * ux + gy * uy + gz * uz)"
    return f"""sn AS (SELECT structure_id, atom, element, sum(rho * r) / nullif(sum(rho), 0) AS m1, 1 - sum({radial}) / nullif(sum(gn), 0) AS zeta, sum(rho)::BIGINT AS charge FROM {base} GROUP BY ALL),
ss AS (SELECT structure_id, sphere_atom AS atom, sum(CASE WHEN region = 'bond' THEN rho ELSE 0 END) / nullif(sum(rho), 0) AS f_bond FROM {base} GROUP BY ALL),
si AS (SELECT sn.*, f_bond FROM sn LEFT JOIN ss USING (structure_id, atom))"""


def statistics(x: str) -> str:
    return f"""(SELECT structure_id, sqrt(greatest(0, sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)))) AS {x}_site_std, max(top) - min(low) AS {x}_site_range, max(top) AS {x}_site_max, min(low) AS {x}_site_min,
        CASE WHEN max(n) < 2 THEN 0 ELSE sum(n * v) / sum(n) END AS {x}_within_element_var, CASE WHEN count(*) = 1 THEN 0 ELSE greatest(0, sum(n * m * m) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n))) END AS {x}_between_element_var
    FROM (SELECT structure_id, element, count({x}) AS n, sum({x}) AS s, avg({x}) AS m, var_pop({x}) AS v, max({x}) AS top, min({x}) AS low, sum({x} * {x}) AS q FROM si GROUP BY ALL) GROUP BY structure_id)"""


SPREADS = [f"{x}_{k}" for x in ("m1", "f_bond", "zeta") for k in ("site_std", "site_range", "site_max", "site_min", "within_element_var", "between_element_var")]
ORACLES: dict[str, str] = {
    "voxelize": f"WITH {GRID} SELECT * FROM vx",
    "grid_integrate": f"WITH {GRID} SELECT structure_id, {r6(f'avg(rho) * {num(CELL.volume)} AS integral', 'avg(rho) AS mean')} FROM vx GROUP BY structure_id",
    "slab_profiles": f"WITH {GRID} SELECT structure_id, CASE WHEN i IS NOT NULL THEN 0 WHEN j IS NOT NULL THEN 1 ELSE 2 END AS axis, coalesce(i, j, k) AS plane, max(rho) AS top, round(avg(rho), 6) AS mean FROM vx GROUP BY GROUPING SETS ((structure_id, i), (structure_id, j), (structure_id, k))",
    "roll_neighbors": f"WITH {GRID}, {ARRAYS} SELECT structure_id, vox, a[((i + 1) % {N}) * {N * N} + j * {N} + k + 1]::BIGINT AS ahead_i, a[i * {N * N} + ((j + 1) % {N}) * {N} + k + 1]::BIGINT AS ahead_j, a[i * {N * N} + j * {N} + (k + 1) % {N} + 1]::BIGINT AS ahead_k FROM vx JOIN ar USING (structure_id)",
    "slice_plane": f"WITH {GRID} SELECT structure_id, vox, rho FROM vx WHERE k = (SELECT p FROM range({N}) t(p) ORDER BY least(abs(p / {N}.0 - 0.3), 1 - abs(p / {N}.0 - 0.3)), p LIMIT 1)",
    "preview": f"WITH {GRID} SELECT structure_id, vox, rho FROM vx WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0",
    "translate_invariance": f"WITH {GRID} SELECT count(*) - count(*) AS differing FROM vx",
    "supercell_invariance": f"WITH {GRID} SELECT structure_id, sum(rho)::BIGINT AS total, max(rho) AS top, min(rho) AS low FROM vx GROUP BY structure_id",
    "grid_sizes": "SELECT p_partkey, "
    + ", ".join(f"(2 * (SELECT min(n) FROM (SELECT unnest([{', '.join(map(str, smooth_sizes()))}]) AS n) WHERE n >= floor({num(2 * GRID_FACTOR['accurate'])} * (p_size / {d} + 2.0) * {num(math.sqrt(500 / 13.605826) / 0.529177249 / (2 * math.pi))} + 0.5)))::INT AS n{a}" for a, d in ((1, "4.0"), (2, "7.0"), (3, "3.0")))
    + " FROM part",
    "fd_gradient": f"WITH {GRID}, {ARRAYS} " + " UNION ALL ".join(f"SELECT structure_id, vox, {o} AS accuracy, {r6(*(f'{derivative(AXES[a], o)} AS g{a + 1}' for a in range(3)), digits=5)} FROM vx JOIN ar USING (structure_id)" for o in (2, 4, 6, 8)),
    "fd_hessian": f"WITH {GRID}, {fractional()} SELECT structure_id, vox, {r6('h11', 'h22', 'h33', 'h12', 'h13', 'h23', digits=4)} FROM fr",
    "fd_laplacian": f"WITH {GRID}, {CARTESIAN} SELECT structure_id, vox, {r6('lap', 'lap_diagonal', digits=4)} FROM ca",
    "laplacian_shares": f"""WITH {FULL} SELECT structure_id, {r6("avg((lap < 0)::INT) AS lnf", share("sum(CASE WHEN lap < 0 THEN rho ELSE 0 END)", "sum(rho)") + " AS lnf_charge_weighted",
        share("sum(CASE WHEN lap < 0 AND region <> 'core' THEN abs(lap) ELSE 0 END)", "sum(CASE WHEN region <> 'core' THEN abs(lap) ELSE 0 END)", 0.5) + " AS lap_concentration_valence")} FROM fu GROUP BY structure_id""",
    "gradient_shape": f"""WITH {FULL}, gs AS (SELECT structure_id, 1 - sum(abs(gx * ux + gy * uy + gz * uz)) / sum(gn) AS zeta, {", ".join(f"sum(g{p[0]} * g{p[1]}) / sum(gn * gn) AS t{p}" for p in ("xx", "yy", "zz", "xy", "xz", "yz"))} FROM fu GROUP BY structure_id),
        {eigen("gs", "te", ("t1", "t2", "t3"), ("txx", "tyy", "tzz", "txy", "txz", "tyz"))}
        SELECT structure_id, {r6("zeta", "t1", "t2", "t3", "sqrt(1.5) * sqrt((pow(txx - 1 / 3.0, 2) + pow(tyy - 1 / 3.0, 2) + pow(tzz - 1 / 3.0, 2) + 2 * (txy * txy + txz * txz + tyz * tyz)) / (txx * txx + tyy * tyy + tzz * tzz + 2 * (txy * txy + txz * txz + tyz * tyz))) AS charge_FA")} FROM te""",
    "hessian_eigen": f"WITH {GRID}, {CARTESIAN}, {eigen('ca', 'ei', ('e1', 'e2', 'e3'), ('hxx', 'hyy', 'hzz', 'hxy', 'hxz', 'hyz'))} SELECT structure_id, vox, {r6('e1 AS l1', 'e2 AS l2', 'e3 AS l3', digits=3)} FROM ei",
    "curvature": f"""WITH {CURVED} SELECT structure_id, {r6("coalesce(avg(CASE WHEN region = 'bond' AND l2 < 0 THEN 1 - l2 / l1 END), 0) AS ellip_bond_bounded_avg", "avg((s < 3.0 AND rho_au < 0.05)::INT) AS f_NCI",
        "coalesce(avg(CASE WHEN s < 3.0 AND rho_au < 0.05 THEN (l2 < 0)::INT END), 0) AS NCI_attractive", "coalesce(avg(CASE WHEN s < 3.0 AND rho_au < 0.05 THEN sign(l2) * rho_au END), 0) AS sign_lambda2_rho_mean")} FROM cu GROUP BY structure_id""",
    "nci_map": f"""WITH {CURVED}, xy AS (SELECT structure_id, round(sign(l2) * rho_au, 9) AS x, round(s, 9) AS y FROM cu)
        SELECT structure_id, least(floor((x + 0.08) / (0.08 + 0.08) * 120), 119)::INT AS bx, least(floor((y - 0.0) / 2.0 * 80), 79)::INT AS by, count(*) AS amount FROM xy WHERE x BETWEEN -0.08 AND 0.08 AND y BETWEEN 0 AND 2 GROUP BY ALL""",
    "hartree_potential": f"WITH {FIELD} SELECT structure_id, vox, {r6('v')} FROM fi",
    "potential_spread": f"""WITH {FIELD}, st AS (SELECT ((round(fx * {N}) * {N} + round(fy * {N})) * {N} + round(fz * {N}))::BIGINT AS vox FROM atom)
        SELECT structure_id, {r6("V_spread", "V_int_min")} FROM (SELECT structure_id, stddev_pop(v) AS V_spread FROM fi JOIN st USING (vox) GROUP BY structure_id) JOIN (SELECT structure_id, coalesce(min(CASE WHEN region = 'int' THEN v END), 0) AS V_int_min FROM fi JOIN sr USING (vox) GROUP BY structure_id) USING (structure_id)""",
    "midpoint_density": f"""WITH {GRID}, {ATOM}, {bonds()}, {transform(False)}, mp AS (SELECT bo.*, 0.5 * (a.fx + b.fx + t1) AS u1, 0.5 * (a.fy + b.fy + t2) AS u2, 0.5 * (a.fz + b.fz + t3) AS u3 FROM bo JOIN atom a ON a.atom = i JOIN atom b ON b.atom = j),
        mv AS (SELECT structure_id, i, j, t1, t2, t3, {SYNTH} AS v FROM am CROSS JOIN mp GROUP BY ALL) SELECT structure_id, {r6("avg(v) AS rho_mid_mean", "stddev_pop(v) AS rho_mid_std")}, count(*) AS bonds FROM mv GROUP BY structure_id""",
    "nearest_atom": f"WITH {INDEX}, {GEOMETRY} SELECT vox, atom, element, {r6('r')} FROM ne",
    "sphere_regions": f"WITH {INDEX}, {GEOMETRY} SELECT vox, sphere_atom AS atom, {r6('rs AS r')}, region FROM sr",
    "bond_census": f"WITH {ATOM}, {bonds()} SELECT i, j, t1, t2, t3, {r6('length')} FROM bo",
    "neighbor_edges": f"WITH {ATOM}, {images('bi', 4.05)}, ce AS (SELECT atom AS i, px AS x, py AS y, pz AS z FROM bi WHERE t1 = 0 AND t2 = 0 AND t3 = 0), ed AS (SELECT i, atom AS j, t1, t2, t3, {DIST} AS length FROM ce CROSS JOIN bi) SELECT i, j, t1, t2, t3, {r6('length')} FROM ed WHERE length <= 4.05 AND length > 1e-9",
    "becke_weights": f"""WITH {INDEX}, {POINTS}, {ATOM}, {images("bi", 2 * CELL.reach)},
        nr AS (SELECT vox, atom, {DIST} AS d, px, py, pz, row_number() OVER (PARTITION BY vox ORDER BY round({DIST}, 8), {TIE}) AS rank FROM pts CROSS JOIN bi QUALIFY rank <= {BECKE_K}),
        mu0 AS (SELECT l.vox, l.rank, l.atom, (l.d - r.d) / sqrt((l.px - r.px) * (l.px - r.px) + (l.py - r.py) * (l.py - r.py) + (l.pz - r.pz) * (l.pz - r.pz)) AS mu FROM nr l JOIN nr r ON l.vox = r.vox AND l.rank <> r.rank WHERE l.rank <= {BECKE_CELLS}),
        mu1 AS (SELECT * REPLACE (mu * (1.5 - 0.5 * mu * mu) AS mu) FROM mu0), mu2 AS (SELECT * REPLACE (mu * (1.5 - 0.5 * mu * mu) AS mu) FROM mu1), mu3 AS (SELECT * REPLACE (mu * (1.5 - 0.5 * mu * mu) AS mu) FROM mu2),
        pr AS (SELECT vox, rank, atom, product(0.5 * (1 - mu)) AS p FROM mu3 GROUP BY ALL), w1 AS (SELECT *, p / sum(p) OVER (PARTITION BY vox) AS w FROM pr), w2 AS (SELECT vox, atom, w / sum(w) OVER (PARTITION BY vox) AS w FROM w1 WHERE w > 1e-10)
        SELECT vox, atom, {r6("sum(w) AS weight")} FROM w2 GROUP BY vox, atom""",
    "periodic_images": f"WITH {ATOM}, {images('bi', 2.0)} SELECT atom, t1, t2, t3, {r6('px', 'py', 'pz')} FROM bi",
    "moments": f"""WITH {PLACED}, mo1 AS (SELECT structure_id, {share("sum(rho * r)", "sum(rho)")} AS m1, {share("sum(rho * r * r)", "sum(rho)")} AS m2, {", ".join(share(f"sum(CASE WHEN region = '{n}' THEN rho ELSE 0 END)", "sum(rho)") + f" AS f_{n}" for n in ("core", "bond", "int"))} FROM pl GROUP BY structure_id)
        SELECT structure_id, {r6("m1", "m2", "m2 - m1 * m1 AS sigma_r2", "f_core", "f_bond", "f_int")} FROM mo1""",
    "information": f"""WITH {GRID}, p AS (SELECT structure_id, rho, greatest(rho, 0)::DOUBLE / sum(greatest(rho, 0)) OVER (PARTITION BY structure_id) AS p, count(*) OVER (PARTITION BY structure_id) AS n FROM vx),
        s AS (SELECT structure_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) - ln(max(n)) AS e, max(n) * sum(p * p) AS d, min(rho) AS low, avg(rho) AS mean FROM p GROUP BY structure_id)
        SELECT structure_id, {r6("e AS shannon_entropy", "d AS disequilibrium", "d * exp(e) AS LMC_complexity", "low AS rho_min", "low / mean AS rho_min_ratio")} FROM s""",
    "site_values": f"WITH {FULL}, {sites('fu')} SELECT structure_id, atom, element, {r6('m1', 'f_bond', 'zeta')}, charge FROM si",
    "site_statistics": f"WITH {FULL}, {sites('fu')} SELECT structure_id, {r6(*SPREADS)} FROM {statistics('m1')} JOIN {statistics('f_bond')} USING (structure_id) JOIN {statistics('zeta')} USING (structure_id)",
    "anova_parts": f"""WITH x AS (SELECT avg(l_quantity) AS x, any_value(p_brand) AS e FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey), e AS (SELECT e, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY e), a AS (SELECT avg(x) AS m FROM x)
        SELECT {r6("(SELECT stddev_pop(x) FROM x) AS x_site_std", "(SELECT max(x) - min(x) FROM x) AS x_site_range", "sum(n * v) / sum(n) AS x_within_element_var", "sum(n * pow(e.m - a.m, 2)) / sum(n) AS x_between_element_var")} FROM e, a""",
    "sensitivity_sweep": f"""WITH {PLACED}, pa AS (SELECT * FROM {values([(a, b) for a in (0.6, 0.79, 1.0) for b in (0.9, 1.14, 1.4) if a < b], "a, b")}), sw AS (SELECT structure_id, a, b, rho, {region("a", "b")} AS w FROM pl CROSS JOIN pa)
        SELECT structure_id, a, b, {r6(*(share(f"sum(CASE WHEN w = '{n}' THEN rho ELSE 0 END)", "sum(rho)") + f" AS f_{n}" for n in ("core", "bond", "int")), "coalesce(avg(CASE WHEN w = 'int' THEN rho END), 0) AS rho_int_mean")} FROM sw GROUP BY structure_id, a, b""",
    "nmape": f"WITH {GRID} SELECT {r6('100.0 * sum(abs(b.rho - a.rho)) / sum(abs(a.rho)) AS nmape')} FROM vx a JOIN vx b USING (vox) WHERE a.structure_id = 'N' AND b.structure_id = 'R'",
    "renormalised": f"""WITH {GRID}, {ATOM}, el AS (SELECT sum(z) AS e FROM atom JOIN (SELECT * FROM {values([(f"'{e}'", ZVAL[e]) for e in BOUND], "element, z")}) USING (element)), rn AS (SELECT structure_id, rho * e / (avg(rho) OVER (PARTITION BY structure_id) * {num(CELL.volume)}) AS rho FROM vx, el)
        SELECT structure_id, {r6(f"avg(rho) * {num(CELL.volume)} AS electrons", "max(rho) AS top")} FROM rn GROUP BY structure_id""",
    "lower_mask": f"WITH {GRID}, {neighbours(topology.CUBE)} SELECT structure_id, vox, sum(CASE WHEN lower THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS bits FROM nb GROUP BY ALL",
    "ascent_basins": f"WITH RECURSIVE {GRID}, {BASINS} SELECT * FROM ba",
    "non_nuclear_maxima": f"""WITH RECURSIVE {GRID}, {BASINS}, {GEOMETRY}, pk AS (SELECT structure_id, vox AS basin FROM nb JOIN sr USING (vox) WHERE region <> 'core' GROUP BY ALL HAVING bool_and(lower))
        SELECT structure_id, {r6(f"coalesce(any_value(n), 0) / {num(CELL.volume)} AS n_NNM", "sum(CASE WHEN pk.basin IS NOT NULL THEN rho ELSE 0 END) / sum(rho) AS Q_NNM")} FROM vx JOIN ba USING (structure_id, vox) LEFT JOIN pk USING (structure_id, basin) LEFT JOIN (SELECT structure_id, count(*) AS n FROM pk GROUP BY ALL) USING (structure_id) GROUP BY structure_id""",
    "basin_charges": f"""WITH RECURSIVE {GRID}, {BASINS}, bc AS (SELECT structure_id, basin, sum(rho)::BIGINT AS charge FROM vx JOIN ba USING (structure_id, vox) GROUP BY ALL)
        SELECT structure_id, basin, charge, {r6("charge / sum(charge) OVER (PARTITION BY structure_id) AS share")}, row_number() OVER (PARTITION BY structure_id ORDER BY charge DESC, basin)::INT AS rank FROM bc QUALIFY rank <= 40""",
    "radial_profile": f"""WITH {FULL}, ra AS (SELECT *, round(lap, 4) AS l, greatest(ceil((r - {EPS!r}) / {RADIAL_BIN!r}) - 1, 0)::INT AS bin FROM fu)
        SELECT structure_id, bin, {r6(f"sum(rho) * {num(DV)} AS charge", f"count(*) * {num(DV)} AS volume", f"sum((l < 0)::INT) * {num(DV)} AS vol_neg", f"sum(CASE WHEN l < 0 THEN rho ELSE 0 END) * {num(DV)} AS charge_neg", f"sum(CASE WHEN l < 0 THEN abs(l) ELSE 0 END) * {num(DV)} AS lap_neg", f"sum(CASE WHEN l < 0 THEN 0 ELSE abs(l) END) * {num(DV)} AS lap_pos", digits=3)} FROM ra GROUP BY structure_id, bin""",
    "region_profile": f"""WITH {PLACED} SELECT structure_id, floor(rs / radius / {RATIO_BIN!r})::INT AS bin, {r6(*(f"sum(CASE WHEN region = '{n}' THEN rho ELSE 0 END) * {num(DV)} AS {n}" for n in ("core", "bond", "int")))} FROM pl GROUP BY 1, 2""",
    "hist_1d": "WITH e AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) SELECT event_type, least(floor((value - lo) / (hi - lo) * 120), 119)::INT AS bin, count(*) AS amount FROM e WHERE value IS NOT NULL GROUP BY ALL",
    "hist_weighted": "WITH e AS (SELECT l_returnflag, l_quantity AS x, round(l_extendedprice * 100)::BIGINT AS w, min(l_quantity) OVER (PARTITION BY l_returnflag) AS lo, max(l_quantity) OVER (PARTITION BY l_returnflag) AS hi FROM lineitem) SELECT l_returnflag, least(floor((x - lo) / (hi - lo) * 50), 49)::INT AS bin, sum(w)::BIGINT AS amount FROM e GROUP BY ALL",
    "support_range": "WITH e AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events), h AS (SELECT event_type, least(floor((value - lo) / (hi - lo) * 120), 119)::INT AS bin, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS top FROM h) SELECT event_type, min(bin) AS first_bin, max(bin) AS last_bin FROM t WHERE n > 0.5 * top GROUP BY event_type",
    "site_labels": "SELECT s_suppkey, 'N' || s_nationkey || '-' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS label FROM supplier",
    "etl_targets": """SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 5000 THEN top END AS top, orders AS spend_orders, (c_acctbal BETWEEN 0 AND 5000)::INT AS sane, coalesce((abs(c_acctbal - top) < 1000)::INT, 0) AS near
        FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS top, count(*) AS orders FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "coverage": """WITH r AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'test' WHEN c_custkey % 10 = 1 THEN 'val' ELSE 'train' END AS split, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, 1.0::DOUBLE AS one FROM customer), l AS (SELECT split, 'balance' AS "column", balance AS v FROM r UNION ALL SELECT split, 'one', one FROM r)
        SELECT "column", count(v) AS n, count(v) FILTER (split = 'train') AS n_train, count(v) FILTER (split = 'val') AS n_val, count(v) FILTER (split = 'test') AS n_test, count(*) FILTER (v IS NULL) AS empty, coalesce(max(v) - min(v) < 1e-9, true) AS constant FROM l GROUP BY 1""",
    "inconsistent_keys": 'SELECT l_orderkey, count(DISTINCT l_linestatus) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) > 1',
    "repeated_keys": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "formula_parse": f"""WITH f AS (SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') || 'Fe2O' || p_size, '[A-Z][a-z]?'))) AS e FROM part)
        SELECT p_partkey, array_to_string(e, '-') AS system, len(e)::INT AS elements, list_has_any(e, [{", ".join(f"'{e}'" for e in F_ELEMENTS)}])::INT AS f_element FROM f""",
    "species_expand": """WITH c AS (SELECT p_partkey, p_size % 3 + 1 AS a, p_size % 4 + 1 AS b, p_size % 2 + 1 AS c FROM part), d AS (SELECT *, gcd(gcd(a, b), c) AS g FROM c)
        SELECT p_partkey, rtrim(repeat('Fe,', a::INT) || repeat('O,', b::INT) || repeat('Ni,', c::INT), ',') AS species, (a // g)::VARCHAR || ',' || (b // g)::VARCHAR || ',' || (c // g)::VARCHAR AS reduced FROM d""",
    "run_dir_pick": "SELECT s[-2] AS directory, min(s[-1]) AS file, count(*) AS files FROM (SELECT string_split(url, '/') AS s FROM pages) GROUP BY 1",
    "metrics_regression": f"""WITH x AS (SELECT l_returnflag, l_extendedprice AS y, p_retailprice * l_quantity AS p FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT l_returnflag, avg(y) AS m FROM x GROUP BY 1)
        SELECT l_returnflag, {r6("avg(abs(y - p)) AS mae", "sqrt(avg((y - p) * (y - p))) AS rmse", "1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2", "median(abs(y - p)) AS median_ae", digits=4)} FROM x JOIN m USING (l_returnflag) GROUP BY 1""",
    "metrics_classification": f"""WITH x AS (SELECT quality = 1 AS y, n_chars / (n_chars + 2000.0) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM x)
        SELECT 'all' AS "all", {r6("avg(((p >= 0.5) = y)::INT) AS accuracy", "coalesce(2.0 * count(*) FILTER (p >= 0.5 AND y) / nullif(count(*) FILTER (p >= 0.5) + count(*) FILTER (y), 0), 0) AS f1", "-avg(CASE WHEN y THEN ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END) AS logloss",
        "(sum(CASE WHEN y THEN k ELSE 0 END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * (count(*) - count(*) FILTER (y))) AS roc_auc")} FROM r""",
    "seed_summary": f"SELECT event_type, {r6('avg(value) AS mean', 'coalesce(stddev_samp(value), 0) AS spread')}, count(*) AS seeds FROM events GROUP BY event_type",
    "best_by": "SELECT c_mktsegment, arg_max(c_name, (c_acctbal, c_name)) AS best, max(c_acctbal) AS score FROM customer GROUP BY 1",
    "importance_shares": f"WITH g AS (SELECT l_returnflag, l_suppkey, sum(l_quantity)::BIGINT AS gain FROM lineitem GROUP BY ALL) SELECT *, {r6('gain / sum(gain) OVER (PARTITION BY l_returnflag) AS share')}, row_number() OVER (PARTITION BY l_returnflag ORDER BY gain DESC, l_suppkey)::INT AS rank FROM g QUALIFY rank <= 10",
    "element_table": "SELECT z, symbol, covalent_radius, zval::DOUBLE AS zval FROM " + values([(z, f"'{s}'", num(COVALENT_RADIUS[s]) if s in COVALENT_RADIUS else "NULL", ZVAL.get(s, "NULL")) for z, s in enumerate(SYMBOLS, 1)], "z, symbol, covalent_radius, zval"),
    "inverse_transform": f"SELECT p_partkey, {r6('greatest(pow(10.0, z), 20.0) AS log10', 'exp(z) - 1 AS log1p', 'greatest(z - 1.5, 0.0) AS plain')}, CASE WHEN z > 0 THEN greatest(0, 1 - floor(log10(z))::INT) ELSE 3 END::INT AS decimals FROM (SELECT p_partkey, p_retailprice / 1000.0 AS z FROM part)",
}
DIMENSIONS = 64
RANKED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_RANKS = "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in RANKED) + " FROM lineitem)"
_PAIRS = "sm AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, coalesce(corr({a}, {b}), 0) AS rho FROM rk" for a, b in itertools.combinations(RANKED, 2)) + ")"
_FEATURES = "fe AS (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS x{k}" for k in range(DIMENSIONS)) + " FROM embeddings), lo AS (" + " UNION ALL ".join(f"SELECT vec_id, 'x{k}' AS name, x{k} AS value FROM fe" for k in range(DIMENSIONS)) + "), rg AS (SELECT name, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM lo GROUP BY name)"
_SYSTEMS = """sy0 AS (SELECT o_custkey, array_to_string(list_sort(list_distinct(list(substr(o_orderpriority, 1, 1)))), '-') AS system FROM orders GROUP BY o_custkey),
sy AS (SELECT *, CASE WHEN o_custkey % 10 = 0 THEN 'test' WHEN o_custkey % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM sy0), sh AS (SELECT *, split <> 'test' AND system IN (SELECT system FROM sy WHERE split = 'test') AS shared FROM sy)"""


def _compared(other: str, spearman: str) -> str:
    """Compared voxels of two structures; the grade is by the thresholds of agreement."""
    noise = "greatest(abs(a), abs(b)) < 1e-3 * 1000.0"
    return f"""{GRID}, cm0 AS (SELECT p.vox AS name, p.rho::DOUBLE AS a, q.rho::DOUBLE AS b, {spearman} AS s FROM vx p JOIN vx q USING (vox) WHERE p.structure_id = 'N' AND q.structure_id = '{other}'),
cm AS (SELECT name, a, b, CASE WHEN {noise} THEN 'nan'::DOUBLE WHEN greatest(abs(a), abs(b)) = 0 THEN 0 ELSE abs(a - b) / greatest(abs(a), abs(b)) END AS d, CASE WHEN {noise} THEN 'zero in both' WHEN abs(a - b) > 0.05 * greatest(abs(a), abs(b)) THEN 'differs' ELSE '' END AS note,
    CASE WHEN s >= {GRADES[0]} THEN 'excellent' WHEN s >= {GRADES[1]} THEN 'good' WHEN s >= {GRADES[2]} THEN 'fair' ELSE 'poor' END AS transfer FROM cm0)"""


ORACLES |= {
    "spearman_matrix": f"WITH {_RANKS}, {_PAIRS} SELECT a, b, {r6('rho')} FROM sm",
    "redundant_pairs": f"WITH {_RANKS}, {_PAIRS} SELECT a, b, {r6('abs(rho) AS abs_rho')} FROM sm WHERE abs(rho) >= 0.5",
    "most_similar": f"WITH {_RANKS}, {_PAIRS}, bo AS (SELECT a, b, abs(rho) AS r FROM sm UNION ALL SELECT b, a, abs(rho) FROM sm) SELECT a, arg_max(b, (r, b)) AS most_similar, {r6('max(r) AS r')} FROM bo GROUP BY a",
    "feature_range": f"WITH {_FEATURES} SELECT name, {r6('low', 'high')} FROM rg",
    "outside_range": f"WITH {_FEATURES} SELECT vec_id, name, {r6('value')} FROM lo JOIN rg USING (name) WHERE low < high AND NOT value BETWEEN low AND high",
    "tolerant_match": f"WITH {_FEATURES}, q AS (SELECT vec_id, "
    + ", ".join(f"CASE WHEN vec_id % 2 = 0 THEN x{k} * (1 + 1e-7::DOUBLE) ELSE x{k} + 1 END AS x{k}" for k in range(DIMENSIONS))
    + " FROM fe WHERE vec_id % 3 = 0), h AS (SELECT q.vec_id AS query, d.vec_id AS m FROM q JOIN fe d ON "
    + " AND ".join(f"abs(d.x{k} - q.x{k}) <= 1e-12 + 1e-5 * abs(q.x{k})" for k in range(DIMENSIONS))
    + ') SELECT query, min(m) AS "match" FROM h GROUP BY query HAVING count(*) = 1',
    "held_out_systems": f"WITH {_SYSTEMS} SELECT split, count(*) AS n, count(DISTINCT system) AS systems, sum(o_custkey)::BIGINT AS keys FROM sh WHERE NOT shared GROUP BY split",
    "control_split": f"WITH {_SYSTEMS} SELECT split, greatest(count(*) - sum(shared::INT), sum(shared::INT))::BIGINT AS n FROM sh GROUP BY split",
    "compare_rows": f"WITH {_compared('R', 'p.vox / 512.0')} SELECT name, a, b, {r6('d AS difference')}, note, transfer FROM cm",
    "compare_summary": f"WITH {_compared('A', '0.9')} SELECT {r6('median(d) FILTER (NOT isnan(d)) AS median')}, count(*) FILTER ((NOT isnan(d) AND d <= 0.01) OR note = 'zero in both') AS close, count(*) FILTER (NOT isnan(d) AND d > 0.05) AS far, count(*) AS n FROM cm",
}

_PLANES = " UNION ALL ".join(
    f"""SELECT atom, element, {a} AS axis, unnest(CASE WHEN {u} < 0.02 THEN [{u}, {u} + 1.0] ELSE [{u}] END)::DOUBLE AS u, {v} AS v0 FROM atom WHERE abs({w} - 0.25 - round({w} - 0.25)) * {num(CELL.heights[a])} <= 1.2"""
    for a, (w, u, v) in enumerate((("fx", "fy", "fz"), ("fy", "fx", "fz"), ("fz", "fx", "fy")))
)
_FORMULA = lambda by: f"string_agg(element || CASE WHEN n // {by} > 1 THEN (n // {by})::VARCHAR ELSE '' END, '' ORDER BY f)"
ORACLES |= {
    "synthetic_density": f"""WITH {INDEX}, {POINTS}, {ATOM}, {images("im", 6.0)}, sy AS (SELECT vox, {DIST} AS r, atom + 6 AS e, 1.5 + 0.25 * atom AS x1 FROM pts CROSS JOIN im)
        SELECT vox, {r6(f"sum(e * pow(x1 / {num(math.pi)}, 1.5) * exp(-x1 * r * r)) AS rho")} FROM sy WHERE r <= 6.0 GROUP BY vox""",
    "cell_summary": f"""WITH {ATOM}, c AS (SELECT element, count(*) AS n, min(atom) AS f FROM atom GROUP BY element), d AS (SELECT max(k) AS d FROM range(1, 5) t(k) WHERE (SELECT bool_and(n % k = 0) FROM c))
        SELECT {_FORMULA("1")} AS formula, {_FORMULA("(SELECT d FROM d)")} AS reduced, sum(n)::BIGINT AS n_atoms, {", ".join(f"round({num(v)}, 6) + 0.0 AS {n}" for n, v in zip(("a", "b", "c", "alpha", "beta", "gamma", "volume"), (*CELL.lengths, *CELL.angles, CELL.volume)))} FROM c""",
    "atoms_near_plane": f"WITH {ATOM}, p AS ({_PLANES}), q AS (SELECT atom, element, axis, u, unnest(CASE WHEN v0 < 0.02 THEN [v0, v0 + 1.0] ELSE [v0] END)::DOUBLE AS v FROM p) SELECT atom, element, {r6('u', 'v')}, axis FROM q",
    "chunk_sizes": f"WITH p AS (SELECT p_partkey, p_size / (p_retailprice / 10.0) * {num(4 / 3 * math.pi * 64)} AS e FROM part) SELECT p_partkey, {r6('e AS pairs_per_point')}, greatest(64, floor(16384 / greatest(1.0, e)))::INT AS chunk FROM p",
    "compare_properties": f"""WITH p AS (SELECT (['band_gap', 'is_metal', 'is_gap_direct', 'refractive_index'])[p_partkey % 4 + 1] AS name, p_size / 50.0::DOUBLE AS a, (p_size * 7 % 50) / 50.0::DOUBLE AS b FROM part),
        q AS (SELECT *, name LIKE 'is%' AS c, name = 'refractive_index' AND a >= 0.5 AS na, name = 'refractive_index' AND b >= 0.5 AS nb FROM p),
        r AS (SELECT name, CASE WHEN NOT c AND NOT na AND NOT nb THEN b - a END AS d, CASE WHEN c THEN (a >= 0.5) = (b >= 0.5) WHEN NOT na AND NOT nb THEN abs(b - a) <= 0.2 ELSE na = nb END AS g FROM q)
        SELECT name, count(*) FILTER (g) AS agreeing, count(*) AS n, count(d) AS compared, round(sum(d), 6) + 0.0 AS total FROM r GROUP BY name""",
    "value_texts": """WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS v, p_partkey % 2 = 0 AS c FROM part)
        SELECT p_partkey, CASE WHEN c THEN (CASE WHEN v >= 0.5 THEN 'Yes' ELSE 'No' END) || ' (' || CASE WHEN 100 * greatest(v, 1 - v) > 99 THEN '> 99' ELSE printf('%.0f', 100 * greatest(v, 1 - v)) END || ' %)' ELSE printf('%.3f', v) END AS text, (NOT c AND v < 0.5)::INT AS weak FROM p""",
    "document_flatten": "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
    "one_to_one_join": "SELECT n_nationkey, n_name, suppliers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey",
    "set_operations": """WITH e AS (SELECT l_partkey AS key FROM lineitem WHERE l_quantity < 5), l AS (SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 45),
        s AS (SELECT 'union' AS "set", key FROM (SELECT key FROM e UNION SELECT key FROM l) UNION ALL SELECT 'both', key FROM (SELECT key FROM e INTERSECT SELECT key FROM l) UNION ALL SELECT 'surplus', key FROM (SELECT DISTINCT key FROM (SELECT key FROM e EXCEPT ALL SELECT key FROM l)) UNION ALL SELECT 'only', key FROM (SELECT key FROM e EXCEPT SELECT key FROM l))
        SELECT "set", count(*) AS n, sum(key)::BIGINT AS total FROM s GROUP BY 1""",
    "bundle_scoring": f"WITH {_FEATURES} SELECT vec_id, round(greatest(pow(10.0, CASE WHEN x0 <= 0 THEN 0.5 WHEN x1 <= 0.1 THEN 1 ELSE 2 END), 4.0), 6) + 0.0 AS y FROM fe",
}


def _catalogue() -> str:
    from rhoscape.options import DOMAINS
    from rhoscape.plans.registry import selected

    text = lambda v: "'" + str(v).replace("'", "''") + "'"
    double = lambda v: f"'{'-' if v < 0 else ''}inf'::DOUBLE" if math.isinf(v) else num(v)
    rows = [(text(d.name), text(d.domain), text(d.source), text(",".join(d.requires)), text(d.units), double(d.range[0]), double(d.range[1]), str(d.intensive).lower(), text(";".join(f"{k}={v}" for k, v in d.cases.items())), text(d.formula)) for d in selected(DOMAINS)]
    return f"ct AS (SELECT * FROM {values(rows, 'name, domain, field, requires, units, range_min, range_max, intensive, sentinel_cases, formula')})"


def _positive(size: int, entry) -> str:
    """Pivots p0, p1, ... of the symmetric elimination of a matrix with SQL entries (i <= j), step by step."""
    name = lambda k, i, j: f"m{k}_{min(i, j)}_{max(i, j)}"
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    steps = ["e0 AS (SELECT p_partkey, " + ", ".join(f"{entry(i, j)} AS {name(0, i, j)}" for i, j in pairs) + " FROM part)"]
    for k in range(1, size):
        left = [(i, j) for i, j in pairs if i >= k]
        steps.append(f"e{k} AS (SELECT *, " + ", ".join(f"{name(k - 1, i, j)} - {name(k - 1, k - 1, i)} * {name(k - 1, k - 1, j)} / {name(k - 1, k - 1, k - 1)} AS {name(k, i, j)}" for i, j in left) + f" FROM e{k - 1})")
    good = " AND ".join(f"{name(k, k, k)} > 0" for k in range(size))
    return f"WITH {', '.join(steps)} SELECT p_partkey, coalesce({good}, false) AS stable FROM e{size - 1}"


_LINK = topology.SIMPLEX.tolist()
_TOUCH = [(a, b) for a, p in enumerate(_LINK) for b, q in enumerate(_LINK) if [y - x for x, y in zip(p, q)] in _LINK]
_PRIME, _MIX = metrics.PRIME, metrics.MIX
_PRICED = "pr AS (SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS k, l_extendedprice AS y, p_retailprice * l_quantity AS p, l_quantity * 1500.0::DOUBLE AS q FROM lineitem JOIN part ON l_partkey = p_partkey)"
_RATED = "ra AS (SELECT quality, n_chars / (n_chars + 2000.0::DOUBLE) AS p, (n_chars % 97) / 97.0::DOUBLE AS q FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL)"
_AUC = lambda c: f"(SELECT (sum(CASE WHEN quality = 1 THEN k ELSE 0 END) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * (count(*) - count(*) FILTER (quality = 1))) FROM (SELECT quality, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS k FROM ra WHERE quality IS NOT NULL))"
_BIN = lambda x, lo, hi, n: f"least(floor(({x} - {lo}) / ({hi} - {lo}) * {n}), {n - 1})::INT"
_TENSOR = f"""st AS (SELECT * FROM fu WHERE gn > 1e-9), gs AS (SELECT structure_id, {", ".join(f"sum(g{p[0]} * g{p[1]}) / sum(gn * gn) AS t{p}" for p in ("xx", "yy", "zz", "xy", "xz", "yz"))} FROM st GROUP BY structure_id),
{eigen("gs", "te", ("t1", "t2", "t3"), ("txx", "tyy", "tzz", "txy", "txz", "tyz"))},
un AS (SELECT structure_id, gn, t1, t2, t3, gx / gn AS a, gy / gn AS b, gz / gn AS c, txx, tyy, tzz, txy, txz, tyz FROM st JOIN te USING (structure_id) WHERE t2 - t1 > 1e-9 AND t3 - t2 > 1e-9),
tu AS (SELECT *, txx * a + txy * b + txz * c AS ta, txy * a + tyy * b + tyz * c AS tb, txz * a + tyz * b + tzz * c AS tc FROM un),
mm AS (SELECT *, a * a + b * b + c * c AS m0, a * ta + b * tb + c * tc AS m1, ta * ta + tb * tb + tc * tc AS m2 FROM tu)"""
_AXIS = lambda k, i, j: f"SELECT structure_id, gn, 'c{k}' AS axis, greatest(round(least((m2 - (t{i} + t{j}) * m1 + t{i} * t{j} * m0) / ((t{k} - t{i}) * (t{k} - t{j})), 1.0), 9), 0.0) AS x FROM mm"
_EDGES = [(m, n) for m, n in itertools.combinations(range(8), 2) if bin(m ^ n).count("1") == 1]
_CORNER = lambda m: [float(sum((m >> (2 - a) & 1) * CELL.rows[a, c] for a in range(3))) for c in range(3)]
_LEAVES, _P, _Q = (0.5, 1.0, 2.0), num(300 / 500), num(80 / 200)
_RIGHT = f"({_Q} * {_LEAVES[1]} + (1 - {_Q}) * {_LEAVES[2]})"
_SECOND = f"(CASE WHEN x1 <= 0.1 THEN {_LEAVES[1]} ELSE {_LEAVES[2]} END)"
_KNOWN = {
    "v": f"({_P} * {_LEAVES[0]} + (1 - {_P}) * {_RIGHT})",
    "v0": f"(CASE WHEN x0 <= 0 THEN {_LEAVES[0]} ELSE {_RIGHT} END)",
    "v1": f"({_P} * {_LEAVES[0]} + (1 - {_P}) * {_SECOND})",
    "v01": f"(CASE WHEN x0 <= 0 THEN {_LEAVES[0]} ELSE {_SECOND} END)",
}
_SHAP = f"""sv AS (SELECT {", ".join(f"{v} AS {n}" for n, v in _KNOWN.items())} FROM fe), si AS (SELECT avg(abs(((v0 - v) + (v01 - v1)) / 2)) AS a, avg(abs(((v1 - v) + (v01 - v0)) / 2)) AS b FROM sv),
sf AS (SELECT 'x0' AS feature, a AS mean_abs FROM si UNION ALL SELECT 'x1', b FROM si UNION ALL SELECT 'x' || k, 0.0 FROM range(2, {DIMENSIONS}) t(k))"""
ORACLES |= {
    "extremum_census": f"""WITH RECURSIVE {GRID}, {neighbours(topology.CUBE)}, {neighbours(topology.SIMPLEX, "off2", "nb2")}, cu AS (SELECT structure_id, vox, bool_and(lower) AS top, bool_and(NOT lower) AS low FROM nb GROUP BY ALL),
        li AS (SELECT structure_id, vox, sum(CASE WHEN lower THEN 1 << bit ELSE 0 END)::INT AS link FROM nb2 GROUP BY ALL), ma AS (SELECT link AS mask FROM li UNION SELECT {2 ** len(_LINK) - 1} - link FROM li), bi AS (SELECT k::INT AS a FROM range({len(_LINK)}) t(k)), ad AS (SELECT * FROM {values(_TOUCH, "a, b")}),
        re AS (SELECT mask, a, a AS b FROM ma, bi WHERE (mask >> a) & 1 = 1 UNION SELECT re.mask, re.a, ad.b FROM re JOIN ad ON ad.a = re.b WHERE (re.mask >> ad.b) & 1 = 1),
        pa AS (SELECT mask, count(*) AS parts FROM (SELECT mask, a FROM re GROUP BY ALL HAVING min(b) = a) GROUP BY mask),
        sa AS (SELECT structure_id, sum(x.parts - 1)::BIGINT AS n_saddle1, sum(y.parts - 1)::BIGINT AS n_saddle2 FROM li JOIN pa x ON x.mask = link JOIN pa y ON y.mask = {2 ** len(_LINK) - 1} - link GROUP BY structure_id),
        ex AS (SELECT structure_id, count(*) FILTER (top) AS n_max, count(*) FILTER (low) AS n_min FROM cu GROUP BY structure_id)
        SELECT structure_id, n_max, n_min, n_saddle1, n_saddle2, n_max - n_saddle2 + n_saddle1 - n_min AS euler FROM ex JOIN sa USING (structure_id)""",
    "sampled_extrema": f"WITH {GRID}, {neighbours(topology.CUBE)}, mk AS (SELECT structure_id, vox, sum(CASE WHEN lower THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS bits FROM nb GROUP BY ALL), pk AS (SELECT * FROM mk WHERE bits IN (0, {2**26 - 1})) SELECT *, (SELECT count(*) FROM pk) AS total FROM pk ORDER BY md5(structure_id || ':' || vox || ':' || bits) LIMIT 20",
    "json_rows": """SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","x":' || CASE WHEN r_regionkey = 2 THEN 'null' ELSE (r_regionkey / 2.0)::DOUBLE::VARCHAR END || '}' AS json FROM region""",
    # Simpson's rule on 400 intervals.
    "error_function": f"SELECT p_partkey, round({num(2 / math.sqrt(math.pi))} * x / 1200 * list_sum(list_transform(range(0, 401), lambda k: CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-(k * x / 400) * (k * x / 400)))), 6) + 0.0 AS erf FROM (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE AS x FROM part)",
    "catalogue": f"WITH {_catalogue()} SELECT * FROM ct",
    "found_descriptors": f"WITH {_catalogue()} SELECT name, domain FROM ct WHERE domain = 'bonding' AND (contains(lower(name), 'charge') OR contains(lower(formula), 'charge'))",
    "featurize_relational": "SELECT * FROM " + " JOIN ".join(f"({ORACLES[n]})" + (" USING (structure_id)" if k else "") for k, n in enumerate(("moments", "laplacian_shares", "gradient_shape", "information", "site_statistics", "non_nuclear_maxima"))),
    "density_round_trip": f"WITH {GRID} SELECT structure_id AS path, {ATOMS} AS n_atoms, '{N}x{N}x{N}' AS shape, round(sum(rho) * {num(SCALE)}, 6) + 0.0 AS total, '' AS error FROM vx GROUP BY structure_id",
    "born_stability": _positive(6, lambda i, j: "39.0 + p_size::DOUBLE" if i == j else f"p_size * {1.0 + (i + j) % 3}::DOUBLE / 3.0"),
    "predict_density": f"""WITH {INDEX}, {POINTS}, {ATOM}, {images("im", 4.0)}, el AS (SELECT sum(z) AS e FROM atom JOIN (SELECT * FROM {values([(f"'{e}'", ZVAL[e]) for e in BOUND], "element, z")}) USING (element)),
        pd AS (SELECT vox, sum(CASE WHEN {DIST} <= 4.0 THEN exp(-pow({DIST} / radius, 2)) ELSE 0 END) AS raw FROM pts CROSS JOIN im GROUP BY vox) SELECT vox, {r6(f"raw * e / (avg(raw) OVER () * {num(CELL.volume)}) AS rho")} FROM pd, el""",
    "bootstrap_interval": f"""WITH {_PRICED}, h0 AS (SELECT y, p, q, d, (k % {_PRIME} * {_MIX[0]} + d * {_MIX[1]} + {_MIX[2]}) % {_PRIME} AS x FROM pr CROSS JOIN range(2000) t(d)),
        {", ".join(f"h{n} AS (SELECT * REPLACE ((x * x + x * {c}) % {_PRIME} AS x) FROM h{n - 1})" for n, c in enumerate(_MIX, 1))},
        wt AS (SELECT d, y, p, q, {" + ".join(f"(x / {num(_PRIME)} >= {num(limit)})::INT" for limit in metrics.POISSON)} AS w FROM h{len(_MIX)}),
        dr AS (SELECT d, (sum(w * (y - p) * (y - p)) - sum(w * (y - q) * (y - q))) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)) AS gain FROM wt GROUP BY d)
        SELECT {r6("quantile_cont(gain, 0.025) AS low", "quantile_cont(gain, 0.975) AS high")} FROM dr""",
    "zeta_angles": f"WITH {FULL}, za AS (SELECT structure_id, gn, round(least(abs(gx * ux + gy * uy + gz * uz) / gn, 1.0), 9) AS x FROM fu WHERE gn > 1e-9) SELECT structure_id, {_BIN('x', '0.0', '1.0', 50)} AS bin, {r6('sum(gn) AS amount', digits=4)} FROM za GROUP BY 1, 2",
    "tensor_angles": f"WITH {FULL}, {_TENSOR}, ax AS ({_AXIS(1, 2, 3)} UNION ALL {_AXIS(2, 1, 3)} UNION ALL {_AXIS(3, 1, 2)}) SELECT structure_id, axis, {_BIN('x', '0.0', '1.0', 50)} AS bin, {r6('sum(gn * gn) AS amount', digits=2)} FROM ax GROUP BY 1, 2, 3",
    "ellipticity_values": f"WITH {CURVED}, el AS (SELECT structure_id, round(least(1 - l2 / l1, 1.0), 9) AS x FROM cu WHERE region = 'bond' AND l2 < 0) SELECT structure_id, {_BIN('x', '0.0', '1.0', 50)} AS bin, count(*) AS amount FROM el WHERE x BETWEEN 0 AND 1 GROUP BY 1, 2",
    "signed_densities": f"WITH {CURVED}, sg AS (SELECT structure_id, l2 < 0 AS attractive, round(sign(l2) * rho_au, 9) AS x FROM cu WHERE s < 3.0 AND rho_au < 0.05) SELECT structure_id, attractive, {_BIN('x', num(-0.05), num(0.05), 120)} AS bin, count(*) AS amount FROM sg WHERE x BETWEEN -0.05 AND 0.05 GROUP BY 1, 2, 3",
    "interstitial_values": f"WITH {PLACED}, iv AS (SELECT *, min(rho) OVER (PARTITION BY structure_id) AS lo, max(rho) OVER (PARTITION BY structure_id) AS hi FROM pl) SELECT structure_id, {_BIN('rho', 'lo', 'hi', 120)} AS bin, count(*) AS voxels, count(*) FILTER (region = 'int') AS interstitial FROM iv GROUP BY 1, 2",
    "least_voxel": f"WITH {PLACED} SELECT structure_id, vox, rho, atom, element, {r6('r')} FROM pl QUALIFY row_number() OVER (PARTITION BY structure_id ORDER BY rho, vox) = 1",
    "site_frame": f"WITH {FULL}, {sites('fu')}, v AS (SELECT structure_id, atom, element, round(m1, 9) AS m FROM si) SELECT structure_id, atom, element || row_number() OVER (PARTITION BY structure_id, element ORDER BY atom) AS label, {r6('m AS value', 'avg(m) OVER w AS mean', 'stddev_pop(m) OVER w AS spread')}, m = max(m) OVER w AS highest, m = min(m) OVER w AS lowest FROM v WINDOW w AS (PARTITION BY structure_id)",
    "element_boxes": f"WITH w AS (SELECT count(*) AS n, avg(p_retailprice) AS m FROM part) SELECT 'all' AS structure_id, p_brand AS element, count(*) AS sites, {r6('count(*) / any_value(n) AS share', 'avg(p_retailprice) - any_value(m) AS offset', 'var_pop(p_retailprice) AS variance', 'min(p_retailprice) AS low', 'quantile_cont(p_retailprice, 0.25) AS quarter', 'median(p_retailprice) AS middle', 'quantile_cont(p_retailprice, 0.75) AS three_quarters', 'max(p_retailprice) AS high')} FROM part, w GROUP BY p_brand",
    "bond_types": f"""WITH {GRID}, {ATOM}, {bonds()}, {transform(False)}, mp AS (SELECT bo.*, a.element AS ea, b.element AS eb, 0.5 * (a.fx + b.fx + t1) AS u1, 0.5 * (a.fy + b.fy + t2) AS u2, 0.5 * (a.fz + b.fz + t3) AS u3 FROM bo JOIN atom a ON a.atom = i JOIN atom b ON b.atom = j),
        mv AS (SELECT structure_id, i, j, t1, t2, t3, length, least(ea, eb) || '-' || greatest(ea, eb) AS pair, {SYNTH} AS v FROM am CROSS JOIN mp GROUP BY ALL) SELECT structure_id, pair, count(*) AS bonds, {r6("avg(v) AS mean", "stddev_pop(v) AS spread", "avg(length) AS length")} FROM mv GROUP BY 1, 2""",
    "maxima_by_ratio": f"WITH RECURSIVE {GRID}, {BASINS}, {GEOMETRY}, mr AS (SELECT structure_id, floor(round(rs / radius, 9) / {num(5 * RATIO_BIN)})::INT AS bin, region = 'core' AS core FROM ba JOIN sr USING (vox) WHERE vox = basin) SELECT structure_id, bin, count(*) FILTER (core) AS nuclear, count(*) FILTER (NOT core) AS other, bin * {num(5 * RATIO_BIN)} <= {num(SPHERE_A)} AND {num(SPHERE_A)} < (bin + 1) * {num(5 * RATIO_BIN)} AS marks_core FROM mr GROUP BY 1, 2",
    "cell_edges": f"SELECT structure_id, start, stop, {r6('x0', 'y0', 'z0', 'x1', 'y1', 'z1')} FROM (SELECT DISTINCT l_returnflag AS structure_id FROM lineitem) CROSS JOIN {values([(m, n, *_CORNER(m), *_CORNER(n)) for m, n in _EDGES], 'start, stop, x0, y0, z0, x1, y1, z1')}",
    "parity": f"WITH {_PRICED} SELECT l_returnflag, {r6('greatest(least(min(y), min(p)), 1e-3) AS low', 'greatest(max(y), max(p)) AS high')}, count(*) FILTER (p > y) AS above, count(*) FILTER (p < y) AS below, count(*) AS n FROM pr GROUP BY 1",
    "paired_evaluation": f"WITH {_PRICED} SELECT l_returnflag, count(*) AS n_test, {r6('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS p_r2', '1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*)) AS q_r2', 'avg(abs(y - p)) AS p_mae', 'avg(abs(y - q)) AS q_mae', '1 - sum((p - q) * (p - q)) / (var_pop(p) * count(*)) AS agree_r2')} FROM pr GROUP BY 1",
    "paired_classes": f"WITH {_RATED} SELECT 'all' AS \"all\", round(avg(((p >= 0.5) = (q >= 0.5))::INT), 6) + 0.0 AS same_class, round({_AUC('p')}, 6) AS p_auc, round({_AUC('q')}, 6) AS q_auc FROM ra",
    "class_histogram": f"WITH {_RATED}, ch AS (SELECT quality, round(p, 9) AS x FROM ra WHERE quality IS NOT NULL) SELECT quality, {_BIN('x', '0.0', '1.0', 20)} AS bin, count(*) AS amount FROM ch WHERE x BETWEEN 0 AND 1 GROUP BY 1, 2",
    "relabelled_split": f"WITH {_SYSTEMS} SELECT CASE WHEN o_custkey % 7 = 0 THEN 'test' WHEN split = 'test' THEN 'aside' ELSE split END AS split, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM sy GROUP BY 1",
    "gap_labels": "SELECT p_partkey, CASE WHEN p_size > 10 AND p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'indirect' END END AS gap FROM part",
    "importance_melt": f"WITH {_FEATURES}, im AS (SELECT name, avg(abs(value)) AS g FROM lo GROUP BY name) SELECT 'm' AS model, name, {r6('g AS gain', 'g / sum(g) OVER () AS share')}, row_number() OVER (ORDER BY g DESC, name)::INT AS rank FROM im",
    "shap_importances": f"WITH {_FEATURES}, {_SHAP} SELECT feature, {r6('mean_abs', 'mean_abs / sum(mean_abs) OVER () AS share', digits=9)} FROM sf ORDER BY mean_abs DESC, feature LIMIT 3",
    "structure_formats": f"WITH {ATOM}, a AS (SELECT string_agg(element, '' ORDER BY atom) AS s, round(sum(fx + fy + fz), 6) AS f FROM atom) SELECT path, CASE WHEN path <> 'bare.xyz' THEN s END AS species, CASE WHEN path <> 'bare.xyz' THEN f END AS fractions, path <> 'bare.xyz' AS read FROM a, (VALUES ('POSCAR'), ('a.cif'), ('a.xyz'), ('bare.xyz')) t(path)",
}

_WIDE = ("m1", "m2", "sigma_r2", "f_core", "f_bond", "f_int", "shannon_entropy", "disequilibrium", "LMC_complexity", "rho_min", "rho_min_ratio")
ORACLES |= {
    "squared_distances": f"WITH {PLACED}, sq AS (SELECT structure_id, rho, pow(round(r, 9), 2) AS q, pow(max(round(r, 9)) OVER (PARTITION BY structure_id), 2) AS top FROM pl) SELECT structure_id, {_BIN('q', '0.0', 'top', 100)} AS bin, sum(rho)::BIGINT AS amount FROM sq GROUP BY 1, 2",
    "centred_density": f"WITH {GRID} SELECT structure_id, vox, {r6('rho - avg(rho) OVER (PARTITION BY structure_id) AS rho')} FROM vx",
    "long_results": f"WITH {_catalogue()}, w AS (SELECT * FROM ({ORACLES['moments']}) JOIN ({ORACLES['information']}) USING (structure_id)), l AS ({' UNION ALL '.join(f"SELECT structure_id, '{n}' AS name, {n} AS value FROM w" for n in _WIDE)}) SELECT structure_id, name, value, domain, units FROM l JOIN ct USING (name)",
    "document_tensor": "SELECT p_partkey, " + ", ".join(f"(p_size + {(i + 1) * 10 + j})::BIGINT AS C{i + 1}{j + 1}" for i in range(6) for j in range(i, 6)) + ", p_size::BIGINT AS elastic_k, p_brand AS brand FROM part",
}
