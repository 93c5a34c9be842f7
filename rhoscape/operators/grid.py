"""Grid algebra on voxel tables (structure_id, i, j, k, vox, rho), and the binding of line items to such tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscape.constants import AUTOA, RYTOEV
from rhoscape.kernels.lattice import Cell

SIZE = 8
#: Lattice of the driver-table structures, rows in Angstrom.
LATTICE = ((4.0, 0.0, 0.0), (0.5, 4.1, 0.0), (0.3, 0.4, 4.3))
CELL = Cell(LATTICE)
#: Density units of one voxel count, so that densities have an atomic scale.
SCALE = 1e-4


def axis(size: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name)


def voxel_grid(spark: SparkSession, size: int = SIZE) -> DataFrame:
    """All voxels of a cubic index range with fractional and Cartesian positions."""
    grid = spark.range(size**3).select((F.col("id") / size**2).cast("int").alias("i"), ((F.col("id") / size).cast("int") % size).alias("j"), (F.col("id") % size).cast("int").alias("k"), F.col("id").alias("vox"))
    return with_positions(grid, size)


def with_positions(voxels: DataFrame, size: int = SIZE, cell: Cell = CELL) -> DataFrame:
    """Fractions u1..u3 and Cartesian x, y, z of voxels."""
    u = [F.col(c) / F.lit(float(size)) for c in ("i", "j", "k")]
    xyz = [sum((u[a] * F.lit(float(cell.rows[a, c])) for a in range(3)), F.lit(0.0)).alias("xyz"[c]) for c in range(3)]
    return voxels.select("*", *(v.alias(f"u{a + 1}") for a, v in enumerate(u)), *xyz)


def voxelize(lineitem: DataFrame, size: int = SIZE) -> DataFrame:
    """A density from line items: quantities summed in cells of the keys' remainders, a structure a return flag, dense."""
    cell = [(F.col(c) % size).cast("int").alias(n) for c, n in (("l_orderkey", "i"), ("l_partkey", "j"), ("l_suppkey", "k"))]
    sums = lineitem.groupBy(F.col("l_returnflag").alias("structure_id"), *cell).agg(F.sum("l_quantity").cast("bigint").alias("held"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size**3 - 1).cast("bigint"))).alias("vox")
    place = [F.floor(F.col("vox") / s % size).cast("int").alias(n) for s, n in ((size**2, "i"), (size, "j"), (1, "k"))]
    dense = sums.select("structure_id").distinct().select("structure_id", every).select("structure_id", *place, "vox")
    return dense.join(sums, ["structure_id", "i", "j", "k"], "left").select("structure_id", "i", "j", "k", "vox", F.coalesce("held", F.lit(0)).alias("rho"))


def neighbour(voxels: DataFrame, offsets: DataFrame, size: int = SIZE, value: str = "rho") -> DataFrame:
    """Each voxel's value at each offset (di, dj, dk, ...) under periodic wrapping, by scattering values to their receivers."""
    moved = [F.pmod(F.col(c) - F.col(f"d{c}"), F.lit(size)).alias(c) for c in ("i", "j", "k")]
    extra = [c for c in offsets.columns if c not in ("di", "dj", "dk")]
    scattered = voxels.join(F.broadcast(offsets)).select("structure_id", *moved, "di", "dj", "dk", *extra, F.col(value).alias("there"))
    return scattered.withColumn("vox", ((F.col("i") * size + F.col("j")) * size + F.col("k")).cast("bigint"))


def slab_profiles(voxels: DataFrame) -> DataFrame:
    """Largest and mean value of every plane along every axis, by grouping sets."""
    grouped = voxels.groupingSets([["structure_id", "i"], ["structure_id", "j"], ["structure_id", "k"]], "structure_id", "i", "j", "k").agg(F.max("rho").alias("top"), F.avg("rho").alias("mean"), F.grouping_id().alias("g"))
    axis_ = F.when(F.col("i").isNotNull(), 0).when(F.col("j").isNotNull(), 1).otherwise(2)
    return grouped.select("structure_id", axis_.alias("axis"), F.coalesce("i", "j", "k").alias("plane"), "top", F.round("mean", 6).alias("mean"))


def slice_plane(voxels: DataFrame, axis_: str, position: float, size: int = SIZE) -> DataFrame:
    """The stored plane nearest a fractional position, by periodic distance."""
    away = F.abs(F.col(axis_) / size - position % 1.0)
    index = voxels.sparkSession.range(size).select(F.col("id").cast("int").alias(axis_))
    best = index.agg(F.min_by(axis_, F.least(away, 1 - away)).alias(axis_))
    return voxels.join(F.broadcast(best), axis_, "left_semi")


def preview(voxels: DataFrame, size: int = SIZE, most: int = 96) -> DataFrame:
    """Every ceil(size / most)-th voxel of each axis."""
    step = math.ceil(size / most)
    return voxels.where((F.col("i") % step == 0) & (F.col("j") % step == 0) & (F.col("k") % step == 0))


def translate(voxels: DataFrame, shift: tuple[int, int, int], size: int = SIZE) -> DataFrame:
    moved = [F.pmod(F.col(c) + s, F.lit(size)).alias(c) for c, s in zip(("i", "j", "k"), shift)]
    return voxels.select("structure_id", *moved, "rho").withColumn("vox", ((F.col("i") * size + F.col("j")) * size + F.col("k")).cast("bigint"))


def rotated(packed: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Packed structures with their lattice vectors turned; values on the grid stay, so no descriptor may change."""
    turn = lambda row, c: sum((F.col("lattice")[3 * row + k] * F.lit(float(matrix[c][k])) for k in range(3)), F.lit(0.0))
    return packed.withColumn("lattice", F.array(*(turn(row, c) for row in range(3) for c in range(3))))


def supercell(voxels: DataFrame, repeats: tuple[int, int, int], size: int = SIZE) -> DataFrame:
    """The grid repeated along its axes."""
    spark = voxels.sparkSession
    copies = spark.createDataFrame([(a, b, c) for a in range(repeats[0]) for b in range(repeats[1]) for c in range(repeats[2])], "ra int, rb int, rc int")
    return voxels.join(F.broadcast(copies)).select("structure_id", *((F.col(c) + F.col(r) * size).alias(c) for c, r in zip(("i", "j", "k"), ("ra", "rb", "rc"))), "rho")


def smooth_sizes(limit: int = 4096) -> list[int]:
    """Even numbers without prime factors above 7."""
    out = []
    for n in range(2, limit + 1, 2):
        m = n
        for p in (2, 3, 5, 7):
            while m % p == 0:
                m //= p
        if m == 1:
            out.append(n)
    return out


#: Grid factors of the precision settings (fixed values).
GRID_FACTOR = {"accurate": 2.0, "normal": 1.5}


def _least_from(sizes: Column, asked: Column) -> Column:
    return F.element_at(F.filter(sizes, lambda n: n >= asked), 1)


def grid_sizes(cells: DataFrame, cutoff: float = 500.0, precision: str = "accurate") -> DataFrame:
    """Density-grid sizes n1..n3 of a plane-wave calculation for lattice lengths l1..l3 and an energy cutoff in eV.

    The wave grid is the least even size without prime factors above 7 that holds 2 x factor x (wave vectors along the
    axis), rounded; the density grid doubles it.
    """
    if precision not in GRID_FACTOR:
        raise ValueError(f"precision must be one of {sorted(GRID_FACTOR)}, got {precision!r}")
    waves = math.sqrt(cutoff / RYTOEV) / AUTOA / (2.0 * math.pi)
    sizes = F.array(*[F.lit(n) for n in smooth_sizes()])
    out = cells
    for a in (1, 2, 3):
        asked = F.floor(F.lit(2.0 * GRID_FACTOR[precision]) * F.col(f"l{a}") * F.lit(waves) + 0.5)
        out = out.withColumn(f"n{a}", 2 * _least_from(sizes, asked))
    return out
