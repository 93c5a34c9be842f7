"""Discrete Fourier sums on voxel tables, an axis at a time; single points are summed over all modes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscape.constants import COULOMB
from rhoscape.kernels.lattice import Cell
from rhoscape.operators.grid import CELL, SIZE


def _phase(u1: Column, u2: Column, u3: Column) -> Column:
    return F.lit(2 * math.pi) * (F.col("m1") * u1 + F.col("m2") * u2 + F.col("m3") * u3)


def _along(frame: DataFrame, index: str, to: str, size: int, sign: int, top: int) -> DataFrame:
    """One axis of a Fourier sum: complex values (re, im) along one index become values along another, 0 to top - 1.

    Each value meets the size values of its axis only, and its products are summed map-side.
    """
    turn = F.pmod(F.col(index) * F.col(to), F.lit(size)) * F.lit(2 * math.pi / size)
    c, s = F.cos(turn), F.sin(turn) * F.lit(float(sign))
    keys = [n for n in frame.columns if n not in (index, "re", "im")]
    met = frame.select("*", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias(to))
    return met.groupBy(*keys, to).agg(F.sum(F.col("re") * c - F.col("im") * s).alias("re"), F.sum(F.col("im") * c + F.col("re") * s).alias("im"))


def transform(voxels: DataFrame, size: int = SIZE, half: bool = False, value: str = "rho") -> DataFrame:
    """Mode amplitudes re, im of signed frequencies m1, m2, m3, axis by axis; on the half spectrum m3 >= 0 with the weight of each plane."""
    made = voxels.select("structure_id", "i", "j", "k", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    for index, to, top in (("k", "m3", size // 2 + 1 if half else size), ("j", "m2", size), ("i", "m1", size)):
        made = _along(made, index, to, size, -1, top)
    signed = lambda c: F.when(F.col(c) >= size // 2, F.col(c) - size).otherwise(F.col(c)).alias(c)
    weight = F.when(F.col("m3").isin(0, size // 2), 1.0).otherwise(2.0) if half else F.lit(1.0)
    return made.select("structure_id", signed("m1"), signed("m2"), F.col("m3") if half else signed("m3"), weight.alias("weight"), (F.col("re") / size**3).alias("re"), (F.col("im") / size**3).alias("im"))


def synthesise_grid(amplitudes: DataFrame, size: int = SIZE) -> DataFrame:
    """Values (structure_id, vox, value) at all voxels from mode amplitudes, axis by axis."""
    made = amplitudes.select("structure_id", "m1", "m2", "m3", (F.col("re") * F.col("weight")).alias("re"), (F.col("im") * F.col("weight")).alias("im"))
    for index, to in (("m1", "i"), ("m2", "j"), ("m3", "k")):
        made = _along(made, index, to, size, 1, size)
    return made.select("structure_id", ((F.col("i") * size + F.col("j")) * size + F.col("k")).cast("bigint").alias("vox"), F.col("re").alias("value"))


def synthesise(amplitudes: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Values at a few fractional points u1..u3 (sites or bonds of one cell, a broadcast side) from mode amplitudes."""
    phase = _phase(F.col("u1"), F.col("u2"), F.col("u3"))
    return amplitudes.join(F.broadcast(points)).groupBy("structure_id", *key).agg(F.sum(F.col("weight") * (F.col("re") * F.cos(phase) - F.col("im") * F.sin(phase))).alias("value"))


def hartree(voxels: DataFrame, size: int = SIZE, cell: Cell = CELL, scale: float = 1.0) -> DataFrame:
    """Amplitudes of the electrostatic potential in eV; the mean is 0 and unpaired frequencies are kept."""
    b = cell.reciprocal
    wave = [sum((F.col(f"m{a + 1}") * F.lit(2 * math.pi * float(b[a, c])) for a in range(3)), F.lit(0.0)) for c in range(3)]
    squared = wave[0] ** 2 + wave[1] ** 2 + wave[2] ** 2
    factor = F.coalesce(F.try_divide(F.lit(4 * math.pi * COULOMB * scale), squared), F.lit(0.0))
    return transform(voxels, size, half=True).withColumn("f", factor).select("structure_id", "m1", "m2", "m3", "weight", (F.col("re") * F.col("f")).alias("re"), (F.col("im") * F.col("f")).alias("im"))
