"""Finite-difference derivatives of voxel tables: every voxel sends its value, weighted, to the voxels that use it.

All stencils of one call share one shuffle by receiver with map-side sums.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.constants import FIRST, SECOND
from rhoscape.kernels.lattice import Cell
from rhoscape.kernels.spectral import PAIRS
from rhoscape.operators.grid import CELL, SIZE, neighbour


def _line(order: int, second: bool) -> dict[int, float]:
    """Weights by offset along one axis."""
    if second:
        first, *rest = SECOND[order]
        return {0: first} | {s * k: c for k, c in enumerate(rest, start=1) for s in (1, -1)}
    return {s * k: s * c for k, c in enumerate(FIRST[order], start=1) for s in (1, -1)}


def stencil(order: int, size: int, hessian: bool) -> list[tuple]:
    """Offsets with their weights in each fractional derivative: g1..g3 and, if asked, h11, h22, h33, h12, h13, h23."""
    names = [f"g{a + 1}" for a in range(3)] + ([f"h{a + 1}{b + 1}" for a, b in PAIRS] if hessian else [])
    table: dict[tuple, dict[str, float]] = {}

    def put(offset: tuple, name: str, weight: float) -> None:
        table.setdefault(offset, dict.fromkeys(names, 0.0))[name] += weight

    unit = lambda axis, n: tuple(n if a == axis else 0 for a in range(3))
    for a in range(3):
        for n, w in _line(order, False).items():
            put(unit(a, n), f"g{a + 1}", w * size)
    for a, b in PAIRS if hessian else ():
        if a == b:
            for n, w in _line(order, True).items():
                put(unit(a, n), f"h{a + 1}{a + 1}", w * size**2)
        else:
            for (n, w), (m, v) in itertools.product(_line(order, False).items(), repeat=2):
                put(tuple(x + y for x, y in zip(unit(a, n), unit(b, m))), f"h{a + 1}{b + 1}", w * v * size**2)
    return [(*offset, *(row[n] for n in names)) for offset, row in sorted(table.items())]


def fractional_derivatives(voxels: DataFrame, order: int = 4, size: int = SIZE, hessian: bool = True) -> DataFrame:
    """Voxels with fractional gradient g1..g3 and Hessian h11..h23 columns."""
    names = [f"g{a + 1}" for a in range(3)] + ([f"h{a + 1}{b + 1}" for a, b in PAIRS] if hessian else [])
    offsets = voxels.sparkSession.createDataFrame(stencil(order, size, hessian), "di int, dj int, dk int, " + ", ".join(f"{n} double" for n in names))
    sent = neighbour(voxels, offsets, size)
    sums = sent.groupBy("structure_id", "vox").agg(*(F.sum(F.col(n) * F.col("there")).alias(n) for n in names))
    return voxels.join(sums, ["structure_id", "vox"])


def cartesian(fractional: DataFrame, cell: Cell = CELL, hessian: bool = True) -> DataFrame:
    """Cartesian gradient gx..gz, its norm gn, both Laplacians and the packed Hessian hxx..hyz."""
    b, metric = cell.reciprocal, cell.metric
    g = [sum((F.col(f"g{a + 1}") * F.lit(float(b[a, c])) for a in range(3)), F.lit(0.0)) for c in range(3)]
    out = fractional.select("*", *(v.alias(n) for v, n in zip(g, ("gx", "gy", "gz")))).withColumn("gn", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2))
    if not hessian:
        return out
    h = lambda a, c: F.col(f"h{min(a, c) + 1}{max(a, c) + 1}")
    diagonal = sum((h(a, a) * F.lit(float(metric[a, a])) for a in range(3)), F.lit(0.0))
    mixed = sum((h(a, c) * F.lit(2.0 * float(metric[a, c])) for a, c in PAIRS[3:]), F.lit(0.0))
    full = [sum((h(a, c) * F.lit(float(b[a, p] * b[c, q])) for a in range(3) for c in range(3)), F.lit(0.0)).alias(f"h{'xyz'[p]}{'xyz'[q]}") for p, q in PAIRS]
    return out.select("*", (diagonal + mixed).alias("lap"), diagonal.alias("lap_diagonal"), *full)
