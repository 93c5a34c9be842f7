"""Density prediction: a model of the density at probe points is evaluated over voxel chunks and renormalised.

The model is a plug-in: model(points, atoms) with Cartesian points (n, 3) and, for each edge within the cutoff, its
probe, atom, distance and direction. Chunks hold a bounded number of atom-probe pairs, so a task's memory doesn't grow
with the grid; a chunk is the unit of work and recovery.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.elements import ZVAL, covalent_radius
from rhoscape.kernels.lattice import Cell, images
from rhoscape.operators.grid import grid_sizes
from rhoscape.operators.properties import PAIRS_PER_CHUNK
from rhoscape.sources.density import PACKED

Model = Callable[[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
STRUCTURES = "path string, lattice array<double>, species array<string>, frac array<double>, shape array<int>"


def gaussians(points, species, probe, atom, distance, direction) -> np.ndarray:
    """A plug-in: a Gaussian of each atom's covalent radius."""
    radius = np.array([covalent_radius(e) for e in species])
    return np.bincount(probe, np.exp(-((distance / radius[atom]) ** 2)), len(points))


def unsupported(species: list[str]) -> list[str]:
    return [e for e in dict.fromkeys(species) if e not in ZVAL]


def predict_density(structures: DataFrame, model: Model, cutoff: float = 4.0, pairs: int = PAIRS_PER_CHUNK["cpu"]) -> DataFrame:
    """(path, vox, rho) of structures (path, lattice, species, frac, shape), scaled to hold their valence electrons.

    model(points, species, probe, atom, distance, direction) returns one value a point. Fails for elements without
    a valence and for densities that hold no charge.
    """
    total = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n)
    sized = structures.select("path", "lattice", "species", "frac", "shape", total.alias("voxels"))
    chunked = sized.mapInArrow(_chunks(cutoff, pairs), STRUCTURES + ", start bigint, stop bigint")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                bad = unsupported(r["species"])
                if bad:
                    raise ValueError(f"{r['path']}: no valence for {', '.join(bad)}")
                cell, frac = Cell(r["lattice"]), np.array(r["frac"]).reshape(-1, 3)
                index = np.arange(r["start"], r["stop"])
                points = np.stack(np.unravel_index(index, r["shape"]), 1) / np.array(r["shape"], float) @ cell.rows
                places, owners, _ = images(cell, frac, cell.repeats(cutoff))
                low, high = points.min(0) - cutoff, points.max(0) + cutoff
                near = np.flatnonzero(((places >= low) & (places <= high)).all(1))
                step = points[:, None] - places[near][None]
                distance = np.sqrt((step**2).sum(2))
                probe, column = np.nonzero(distance <= cutoff)
                d = distance[probe, column]
                rho = model(points, r["species"], probe, owners[near][column], d, step[probe, column] / np.maximum(d, 1e-12)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(index)), pa.array(index), pa.array(np.asarray(rho, float))], ["path", "vox", "rho"])

    # Chunks are spread evenly; each carries its structure's few atoms, not its grid.
    raw = chunked.repartition("path", "start").mapInArrow(run, "path string, vox bigint, rho double")
    table = F.create_map(*[F.lit(v) for e, n in ZVAL.items() for v in (e, n)])
    electrons = structures.select("path", F.aggregate("species", F.lit(0).cast("bigint"), lambda a, e: a + table[e]).alias("electrons"), "lattice")
    a = [[F.col("lattice")[3 * i + j] for j in range(3)] for i in range(3)]
    volume = F.abs(sum(a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(3)))
    sums = raw.groupBy("path").agg(F.avg("rho").alias("mean")).join(electrons.select("path", "electrons", volume.alias("volume")), "path")
    factor = sums.select("path", F.when(F.col("mean") <= 0, F.raise_error(F.lit("the density holds no charge")).cast("double")).otherwise(F.col("electrons") / (F.col("mean") * F.col("volume"))).alias("factor"))
    return raw.join(factor, "path").select("path", "vox", (F.col("rho") * F.col("factor")).alias("rho"))


def sized(structures: DataFrame, cutoff: float = 500.0, precision: str = "accurate") -> DataFrame:
    """Structures (path, lattice, ...) with the shape of the grid that a plane-wave calculation would have."""
    length = lambda a: F.sqrt(sum((F.col("lattice")[3 * a + c] ** 2 for c in range(3)), F.lit(0.0)))
    measured = structures.select("*", *(length(a).alias(f"l{a + 1}") for a in range(3)))
    return grid_sizes(measured, cutoff, precision).select(*structures.columns, F.array("n1", "n2", "n3").alias("shape"))


def packed_predictions(structures: DataFrame, model: Model, cutoff: float = 4.0) -> DataFrame:
    """Predicted densities as packed structures; a structure's voxels meet in one row, which is the unit of files."""
    values = predict_density(structures, model, cutoff)
    grids = values.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("vox", "rho"))), lambda v: v.rho).alias("values"))

    def pack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                row = (r["path"], r["lattice"], r["species"], r["frac"], r["shape"], np.array(r["values"], "<f8").tobytes(), "")
                kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["path", "lattice", "species", "frac", "shape", "grid", "error"])

    return structures.select("path", "lattice", "species", "frac", "shape").join(grids, "path").mapInArrow(pack, PACKED)


def _chunks(cutoff: float, pairs: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                each = len(r["species"]) / Cell(r["lattice"]).volume * 4 / 3 * np.pi * cutoff**3
                size = int(max(64, pairs // max(1.0, each)))
                starts = list(range(0, r["voxels"], size))
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]] * n), pa.array([r["lattice"]] * n), pa.array([r["species"]] * n), pa.array([r["frac"]] * n), pa.array([r["shape"]] * n, pa.list_(pa.int32())), pa.array(starts), pa.array([min(s + size, r["voxels"]) for s in starts])],
                    ["path", "lattice", "species", "frac", "shape", "start", "stop"],
                )

    return run
