"""Synthetic densities with known answers: superpositions of atomic profiles, as relational plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscape.kernels.lattice import Cell
from rhoscape.operators.geometry import images
from rhoscape.operators.grid import CELL


def gaussian(r: Column, exponent: Column) -> Column:
    """Normalised Gaussian, exponent in 1/A^2."""
    return F.pow(exponent / F.lit(math.pi), F.lit(1.5)) * F.exp(-exponent * r * r)


def slater(r: Column, exponent: Column) -> Column:
    """Normalised 1s function squared, exponent in 1/A."""
    return F.pow(exponent, F.lit(3.0)) / F.lit(math.pi) * F.exp(-2.0 * exponent * r)


def cutoff(profile: str, exponent: float, tol: float = 1e-12) -> float:
    """Distance at which a profile has fallen to tol of its centre."""
    return -math.log(tol) / (2 * exponent) if profile == "slater" else math.sqrt(-math.log(tol) / exponent)


def superpose(points: DataFrame, atoms: DataFrame, profile: str = "gaussian", reach: float = 6.0, cell: Cell = CELL) -> DataFrame:
    """rho at each point (vox, x, y, z): electrons x profile(distance) summed over atom images within a reach.

    Atoms need columns electrons and exponent; one cell's images are a small broadcast side and sums are map-side.
    """
    met = points.join(F.broadcast(images(atoms, reach, cell))).withColumn("r", F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2))
    shape = {"gaussian": gaussian, "slater": slater}[profile]
    return met.where(F.col("r") <= reach).groupBy("vox").agg(F.sum(F.col("electrons") * shape(F.col("r"), F.col("exponent"))).alias("rho"))


def uniform(points: DataFrame, value: float = 0.1) -> DataFrame:
    return points.select("vox", F.lit(float(value)).alias("rho"))


def slater_moment(n: int, exponent: float) -> float:
    """<r^n> of a 1s atom."""
    return math.factorial(n + 2) / 2 / (2 * exponent) ** n


def gaussian_moment(n: int, exponent: float) -> float:
    return 2 / math.sqrt(math.pi) * math.gamma((n + 3) / 2) / exponent ** (n / 2)


def slater_fraction(radius: float, exponent: float) -> float:
    """Charge of a 1s atom within a radius."""
    x = 2 * exponent * radius
    return 1 - math.exp(-x) * (1 + x + x * x / 2)


def gaussian_fraction(radius: float, exponent: float) -> float:
    x = math.sqrt(exponent) * radius
    return math.erf(x) - 2 / math.sqrt(math.pi) * x * math.exp(-x * x)


def slater_concentration_volume(exponent: float, volume: float) -> float:
    """Share of a volume where the Laplacian of a 1s density is negative (r < 1 / exponent)."""
    return 4 / 3 * math.pi / exponent**3 / volume
