"""Presentation and comparison of predicted properties, cell summaries and network budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscape.kernels.lattice import Cell
from rhoscape.operators.compare import decimals
from rhoscape.operators.grid import CELL

#: Properties that only materials with a gap have, and the least test R2 of a model that isn't weak (fixed values).
GAPPED_ONLY, WEAK_R2 = ("is_gap_direct", "dielectric_total", "dielectric_electronic", "dielectric_ionic", "refractive_index"), 0.5
#: Atom-probe pairs a chunk of a density-prediction network may hold (fixed values).
PAIRS_PER_CHUNK = {"cpu": 16_384, "cuda": 65_536}


def metallic(is_metal: Column) -> Column:
    return F.coalesce(is_metal, F.lit(0.0)) >= 0.5


def applies(name: Column, is_metal: Column) -> Column:
    return ~(name.isin(*GAPPED_ONLY) & metallic(is_metal))


def weak(task: Column, r2: Column) -> Column:
    return (task == "regression") & (F.coalesce(r2, F.lit(1.0)) < WEAK_R2)


def value_text(task: Column, value: Column, error: Column) -> Column:
    """A value with as many decimals as its typical error warrants, or a class with its certainty."""
    sure = 100 * F.greatest(value, 1 - value)
    words = F.concat(F.when(value >= 0.5, "Yes").otherwise("No"), F.lit(" ("), F.when(sure > 99, "> 99").otherwise(F.format_string("%.0f", sure)), F.lit(" %)"))
    return F.when(task == "classification", words).otherwise(F.call_function("format_number", value, decimals(error)))


def compare_properties(table: DataFrame) -> DataFrame:
    """Agreement of two predictions (a, b) of each property: the same class, within the typical error, or both not applicable.

    Rows: name, task, error, a, b, metal_a, metal_b.
    """
    ok_a, ok_b = applies(F.col("name"), F.col("metal_a")), applies(F.col("name"), F.col("metal_b"))
    same = (F.col("a") >= 0.5) == (F.col("b") >= 0.5)
    near = F.col("error").isNull() | (F.abs(F.col("b") - F.col("a")) <= F.col("error"))
    agree = F.when(F.col("task") == "classification", same).when(ok_a & ok_b, near).otherwise(ok_a == ok_b)
    diff = F.when((F.col("task") != "classification") & ok_a & ok_b, F.col("b") - F.col("a"))
    return table.select("name", diff.alias("difference"), agree.alias("agree"))


def cell_summary(atoms: DataFrame, cell: Cell = CELL) -> DataFrame:
    """Formula, reduced formula and cell of the atoms; elements in the order of their first atom."""
    counts = atoms.groupBy("element").agg(F.count("*").alias("n"), F.min("atom").alias("first"))
    whole = counts.agg(F.array_sort(F.collect_list(F.struct("first", "element", "n"))).alias("e"), F.sum("n").alias("n_atoms"))
    # Counts are at most a cell's atoms, so a divisor is found by trial.
    divisor = F.array_max(F.filter(F.sequence(F.lit(1).cast("bigint"), F.col("n_atoms")), lambda d: F.forall("e", lambda x: x.n % d == 0)))
    spelled = lambda by: F.array_join(F.transform("e", lambda x: F.concat(x.element, F.when(x.n / by > 1, (x.n / by).cast("bigint").cast("string")).otherwise(""))), "")
    sizes = [F.lit(float(v)).alias(n) for n, v in zip(("a", "b", "c", "alpha", "beta", "gamma"), (*cell.lengths, *cell.angles))]
    return whole.withColumn("d", divisor).select(spelled(F.lit(1)).alias("formula"), spelled(F.col("d")).alias("reduced"), "n_atoms", *sizes, F.lit(cell.volume).alias("volume"))


def atoms_near_plane(atoms: DataFrame, axis: int, position: float, within: float = 0.6, edge: float = 0.02, cell: Cell = CELL) -> DataFrame:
    """Atoms close to a lattice plane, with copies on the far edges of the cell's face."""
    f = [F.pmod(F.col(c), F.lit(1.0)) for c in ("fx", "fy", "fz")]
    away = f[axis] - F.lit(position)
    near = F.abs(away - F.round(away)) * F.lit(float(cell.heights[axis])) <= within
    u, v = (k for k in range(3) if k != axis)
    copies = lambda x: F.explode(F.when(x < edge, F.array(x, x + 1.0)).otherwise(F.array(x)))
    return atoms.where(near).select("atom", "element", f[v].alias("v0"), copies(f[u]).alias("u")).select("atom", "element", "u", copies(F.col("v0")).alias("v"))


def chunk_sizes(structures: DataFrame, cutoff: float = 4.0, device: str = "cpu", pairs: int | None = None) -> DataFrame:
    """Expected pairs a grid point and grid points a chunk for structures with n_atoms and volume."""
    each = F.col("n_atoms") / F.col("volume") * F.lit(4.0 / 3.0 * math.pi * cutoff**3)
    budget = pairs or PAIRS_PER_CHUNK[device]
    return structures.select("*", each.alias("pairs_per_point"), F.greatest(F.lit(64), F.floor(F.lit(budget) / F.greatest(F.lit(1.0), each)).cast("int")).alias("chunk"))
