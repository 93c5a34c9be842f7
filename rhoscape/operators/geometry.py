"""Join-like geometry on voxel and atom tables: periodic images, nearest atoms, regions, bonds, fuzzy cells."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscape.constants import BECKE_CELLS, BECKE_K, BOND_TOL, GEOMETRY_EPS, SPHERE_A, SPHERE_B
from rhoscape.elements import elements
from rhoscape.kernels.lattice import Cell
from rhoscape.operators.grid import CELL, SIZE

SYMBOLS = ("Fe", "O", "Ni", "Si", "S")
ATOMS = 4
#: Blocks of a cell, along each axis, that candidates are found for.
BLOCKS = 4


def bind_atoms(supplier: DataFrame, nation: DataFrame, count: int = ATOMS, size: int = SIZE) -> DataFrame:
    """Atoms from all suppliers, dealt by key: an atom's element comes from the regions of its suppliers, its place on the grid from its number."""
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    dealt = placed.groupBy(F.pmod(F.col("s_suppkey"), F.lit(count)).cast("int").alias("atom")).agg(F.sum("n_regionkey").alias("regions"))
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.pmod(F.col("regions"), F.lit(len(SYMBOLS))) + 1).cast("int"))
    fractions = [(((F.col("atom") * m + s) % size) / F.lit(float(size))).alias(n) for m, s, n in ((7, 0, "fx"), (3, 1, "fy"), (5, 2, "fz"))]
    return dealt.select("atom", symbol.alias("element"), *fractions)


def with_radius(atoms: DataFrame) -> DataFrame:
    """Atoms with their covalent radius (a dimension of 118 rows)."""
    table = elements(atoms.sparkSession).select(F.col("symbol").alias("element"), F.col("covalent_radius").alias("radius"))
    return atoms.join(F.broadcast(table), "element", "left")


def unknown_elements(atoms: DataFrame) -> DataFrame:
    table = elements(atoms.sparkSession).where("covalent_radius IS NOT NULL").select(F.col("symbol").alias("element"))
    return atoms.join(F.broadcast(table), "element", "left_anti").select("element").distinct()


def images(atoms: DataFrame, reach: float, cell: Cell = CELL) -> DataFrame:
    """Images of wrapped atoms with shifts t1..t3 and positions px, py, pz, enough for a reach from any point of the cell."""
    ranges = [range(-int(r), int(r) + 1) for r in cell.repeats(reach)]
    shifts = atoms.sparkSession.createDataFrame(list(itertools.product(*ranges)), "t1 int, t2 int, t3 int")
    f = [F.pmod(F.col(n), F.lit(1.0)) + F.col(t) for n, t in (("fx", "t1"), ("fy", "t2"), ("fz", "t3"))]
    position = [sum((f[a] * F.lit(float(cell.rows[a, c])) for a in range(3)), F.lit(0.0)).alias("p" + "xyz"[c]) for c in range(3)]
    return atoms.join(F.broadcast(shifts)).select("*", *(v.alias(f"f{a + 1}") for a, v in enumerate(f)), *position)


def _distance() -> Column:
    return F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2)


def _tie() -> list[Column]:
    """Of equally near images the one with the lexicographically largest fractional displacement comes first."""
    return [-F.round(F.col(f"u{a}") - F.col(f"f{a}"), 9) for a in (1, 2, 3)]


def with_candidates(points: DataFrame, shown: DataFrame, cell: Cell, scale: Column, blocks: int = BLOCKS) -> DataFrame:
    """Points (u1..u3 in [0, 1)) with the images that can have the least distance / scale, found once for each block of the cell.

    In a block of radius ρ around a centre at distance d, an image's distance lies between d - ρ and d + ρ; images whose
    least is above another's most are never the nearest. So a point meets the images around its block, not all.
    """
    half = np.array(list(itertools.product((-0.5, 0.5), repeat=3))) / blocks @ cell.rows
    radius = F.lit(float(np.sqrt((half**2).sum(1)).max()))
    at = [F.floor(F.col("id") / blocks**n) % blocks for n in (2, 1, 0)]
    centre = [sum(((at[a] + 0.5) / blocks * F.lit(float(cell.rows[a, c])) for a in range(3)), F.lit(0.0)).alias("xyz"[c]) for c in range(3)]
    # Both sides are about one cell: a row a block, and a row an image.
    met = points.sparkSession.range(blocks**3).select(F.col("id").alias("block"), *centre).join(F.broadcast(shown)).withColumn("__d", _distance())
    held = F.struct(((F.col("__d") - radius) / scale).alias("least"), *shown.columns)
    near = met.groupBy("block").agg(F.min((F.col("__d") + radius) / scale).alias("most"), F.collect_list(held).alias("all"))
    near = near.select("block", F.explode(F.filter("all", lambda s: s.least <= F.col("most") + 1e-6)).alias("near"))
    place = sum((F.floor(F.col(f"u{a}") * blocks) * blocks ** (3 - a) for a in (1, 2, 3)), F.lit(0)).cast("bigint")
    return points.withColumn("block", place).join(near, "block").select(*points.columns, *(F.col(f"near.{c}").alias(c) for c in shown.columns))


def nearest_atoms(points: DataFrame, atoms: DataFrame, cell: Cell = CELL) -> DataFrame:
    """Nearest image of each point: atom, distance r and unit direction ux, uy, uz.

    The least of a point's candidates is kept with map-side aggregation.
    """
    met = with_candidates(points, images(atoms, cell.reach, cell), cell, F.lit(1.0)).withColumn("r", _distance())
    key = F.struct(F.round("r", 8).alias("d"), *(t.alias(f"t{k}") for k, t in enumerate(_tie())))
    best = met.groupBy("vox").agg(F.min_by(F.struct("atom", "element", "r", "px", "py", "pz", "x", "y", "z"), key).alias("b"))
    away = lambda p, x: F.when(F.col("b.r") > 1e-12, F.try_divide(F.col(f"b.{x}") - F.col(f"b.{p}"), F.col("b.r"))).otherwise(0.0)
    return best.select("vox", "b.atom", "b.element", "b.r", away("px", "x").alias("ux"), away("py", "y").alias("uy"), away("pz", "z").alias("uz"))


def sphere_regions(points: DataFrame, atoms: DataFrame, a: float = SPHERE_A, b: float = SPHERE_B, cell: Cell = CELL) -> DataFrame:
    """Atom with the least r / radius of each point (ties: element, then the geometric rule), and its region."""
    met = with_candidates(points, images(with_radius(atoms), cell.reach, cell), cell, F.col("radius")).withColumn("r", _distance())
    key = F.struct(F.round(F.col("r") / F.col("radius"), 9).alias("d"), F.col("element"), *(t.alias(f"t{k}") for k, t in enumerate(_tie())))
    best = met.groupBy("vox").agg(F.min_by(F.struct("atom", "element", "r", "radius"), key).alias("b"))
    return best.select("vox", F.col("b.atom").alias("sphere_atom"), F.col("b.r").alias("rs"), F.col("b.radius").alias("radius"), region(F.col("b.r"), F.col("b.radius"), F.lit(a), F.lit(b)).alias("region"))


def region(r: Column, radius: Column, a: Column, b: Column) -> Column:
    return F.when(r <= a * radius + GEOMETRY_EPS, "core").when(r <= b * radius + GEOMETRY_EPS, "bond").otherwise("int")


def bond_census(atoms: DataFrame, tol: float = BOND_TOL, cell: Cell = CELL) -> DataFrame:
    """First-shell pairs (i, j, t1, t2, t3, length), each undirected pair once."""
    centres = images(atoms, 0.0, cell).where("t1 = 0 AND t2 = 0 AND t3 = 0").select(F.col("atom").alias("i"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    met = centres.join(F.broadcast(images(atoms, (1 + tol) * float(cell.lengths.min()), cell))).withColumn("length", _distance()).where("length > 1e-9")
    shell = met.groupBy("i").agg(F.min("length").alias("closest"))
    pairs = met.join(shell, "i").where(F.col("length") <= (1 + tol) * F.col("closest") + 1e-9)
    ahead = F.struct(F.col("i").alias("i"), F.col("atom").alias("j"), "t1", "t2", "t3")
    back = F.struct(F.col("atom").alias("i"), F.col("i").alias("j"), (-F.col("t1")).alias("t1"), (-F.col("t2")).alias("t2"), (-F.col("t3")).alias("t3"))
    return pairs.select(F.least(ahead, back).alias("bond"), "length").groupBy("bond").agg(F.min("length").alias("length")).select("bond.*", "length")


def neighbour_edges(atoms: DataFrame, cutoff: float, cell: Cell = CELL) -> DataFrame:
    """Directed edges (i, j, t1, t2, t3, length) between different atoms' images within a cutoff."""
    centres = images(atoms, 0.0, cell).where("t1 = 0 AND t2 = 0 AND t3 = 0").select(F.col("atom").alias("i"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    return centres.join(F.broadcast(images(atoms, cutoff, cell))).withColumn("length", _distance()).where((F.col("length") <= cutoff) & (F.col("length") > 1e-9)).select("i", F.col("atom").alias("j"), "t1", "t2", "t3", "length")


def becke_weights(points: DataFrame, atoms: DataFrame, k: int = BECKE_K, cells: int = BECKE_CELLS, cell: Cell = CELL) -> DataFrame:
    """Weighted bridge (vox, atom, weight) of the fuzzy-cell partition over the k nearest images."""
    from pyspark.sql import Window

    reach = 2.0 * cell.reach
    met = points.join(F.broadcast(images(atoms, reach, cell))).withColumn("d", _distance())
    order = Window.partitionBy("vox").orderBy(F.round("d", 8), *_tie())
    near = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("vox", "atom", "d", "rank", "px", "py", "pz")
    l, r = near.where(F.col("rank") <= cells).alias("l"), near.alias("r")
    apart = F.sqrt((F.col("l.px") - F.col("r.px")) ** 2 + (F.col("l.py") - F.col("r.py")) ** 2 + (F.col("l.pz") - F.col("r.pz")) ** 2)
    pairs = l.join(r, (F.col("l.vox") == F.col("r.vox")) & (F.col("l.rank") != F.col("r.rank"))).select(F.col("l.vox").alias("vox"), F.col("l.rank").alias("rank"), F.col("l.atom").alias("atom"), ((F.col("l.d") - F.col("r.d")) / apart).alias("mu"))
    for _ in range(3):
        pairs = pairs.withColumn("mu", F.col("mu") * (F.lit(1.5) - 0.5 * F.col("mu") * F.col("mu")))
    product = F.aggregate(F.array_sort(F.collect_list(0.5 * (1 - F.col("mu")))), F.lit(1.0), lambda a, s: a * s)
    cell_ = pairs.groupBy("vox", "rank", "atom").agg(product.alias("p"))
    whole = Window.partitionBy("vox")
    kept = cell_.withColumn("w", F.col("p") / F.sum("p").over(whole)).where(F.col("w") > 1e-10)
    return kept.withColumn("w", F.col("w") / F.sum("w").over(whole)).groupBy("vox", "atom").agg(F.sum("w").alias("weight"))
