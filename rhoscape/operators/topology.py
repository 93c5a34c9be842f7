"""Grid topology on voxel tables: neighbour bits, extrema, steepest-ascent basins, percolation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.kernels import topology
from rhoscape.kernels.lattice import Cell
from rhoscape.operators.grid import CELL, SIZE, neighbour
from rhoscape.storage import discard, materialise


def _offsets(voxels: DataFrame, table: np.ndarray, cell: Cell, size: int) -> DataFrame:
    step = cell.rows / size
    rows = [(*map(int, o), k, float(np.linalg.norm(o @ step))) for k, o in enumerate(table)]
    return voxels.sparkSession.createDataFrame(rows, "di int, dj int, dk int, bit int, length double")


def neighbours(voxels: DataFrame, table: np.ndarray = topology.CUBE, cell: Cell = CELL, size: int = SIZE) -> DataFrame:
    """A row for each voxel and neighbour: its bit, step length, value and index beside the voxel's own."""
    indexed = voxels.withColumn("own", F.struct("rho", "vox"))
    sent = neighbour(indexed, _offsets(voxels, table, cell, size), size, "own").select("structure_id", "vox", "bit", "length", F.col("there.rho").alias("there"), F.col("there.vox").alias("to"))
    return sent.join(voxels.select("structure_id", "vox", "rho"), ["structure_id", "vox"])


def _lower():
    """Whether the neighbour is lower; equal values go by index."""
    return (F.col("there") < F.col("rho")) | ((F.col("there") == F.col("rho")) & (F.col("to") < F.col("vox")))


def lower_bits(voxels: DataFrame, table: np.ndarray = topology.CUBE, size: int = SIZE) -> DataFrame:
    return neighbours(voxels, table, CELL, size).groupBy("structure_id", "vox").agg(F.bit_or(F.when(_lower(), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("bigint"))).alias("bits"))


def extremum_census(voxels: DataFrame, size: int = SIZE) -> DataFrame:
    """Maxima, minima, saddles and their alternating sum of each structure."""
    around = lower_bits(voxels, topology.CUBE, size)
    link = lower_bits(voxels, topology.SIMPLEX, size).withColumnRenamed("bits", "link")
    every = (1 << len(topology.SIMPLEX)) - 1
    counts = topology.link_components()
    # A fixed table of 2**14 rows.
    table = voxels.sparkSession.createDataFrame([(m, int(counts[m])) for m in range(every + 1)], "link bigint, parts int")
    other = table.select(F.col("link").alias("rest"), F.col("parts").alias("rest_parts"))
    met = around.join(link, ["structure_id", "vox"]).withColumn("rest", F.lit(every).cast("bigint") - F.col("link")).join(F.broadcast(table), "link").join(F.broadcast(other), "rest")
    middle = (F.col("link") != 0) & (F.col("rest") != 0)
    count = lambda c: F.count(F.when(c, 1))
    out = met.groupBy("structure_id").agg(
        count(F.col("bits") == (1 << 26) - 1).alias("n_max"),
        count(F.col("bits") == 0).alias("n_min"),
        F.sum(F.when(middle, F.col("parts") - 1).otherwise(0)).alias("n_saddle1"),
        F.sum(F.when(middle, F.col("rest_parts") - 1).otherwise(0)).alias("n_saddle2"),
    )
    return out.withColumn("euler", F.col("n_max") - F.col("n_saddle2") + F.col("n_saddle1") - F.col("n_min"))


def ascent_pointers(voxels: DataFrame, size: int = SIZE, cell: Cell = CELL) -> DataFrame:
    """The neighbour of the largest slope among those that aren't lower (first in order among equals); maxima point to themselves."""
    slope = (F.col("there") - F.col("rho")) / F.col("length")
    up = neighbours(voxels, topology.CUBE, cell, size).where(~_lower())
    best = up.groupBy("structure_id", "vox").agg(F.max_by("to", F.struct(F.round(slope, 9), -F.col("bit"))).alias("to"))
    return voxels.select("structure_id", "vox").join(best, ["structure_id", "vox"], "left").select("structure_id", "vox", F.coalesce("to", "vox").alias("to"))


def ascent_basins(voxels: DataFrame, size: int = SIZE, cell: Cell = CELL) -> DataFrame:
    """The maximum that each voxel's steepest ascent reaches, by pointer doubling.

    A logarithmic number of self-joins, each cut by a table in shared storage, until no pointer moves.
    """
    stored = materialise(ascent_pointers(voxels, size, cell), "pointers")
    while True:
        to = stored.select("structure_id", "vox", "to")
        further = to.select("structure_id", F.col("vox").alias("to"), F.col("to").alias("next"))
        moved = materialise(to.join(further, ["structure_id", "to"]).select("structure_id", "vox", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
        discard(stored)
        stored = moved
        if moved.where("moved").isEmpty():
            return moved.drop("moved")


def percolation(voxels: DataFrame, size: int = SIZE) -> DataFrame:
    """Highest spanning level on each axis; a structure's voxels meet in one task (its grid is the unit of work)."""

    def levels(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values("vox")
        found = topology.percolation(frame["rho"].to_numpy(float).reshape(size, size, size))
        return pa.table({"structure_id": [frame["structure_id"].iloc[0]], **{f"rho_perc_{n}": [float(v)] for n, v in zip("abc", found)}})

    made = voxels.select("structure_id", "vox", F.col("rho").cast("double").alias("rho")).groupBy("structure_id").applyInArrow(levels, "structure_id string, rho_perc_a double, rho_perc_b double, rho_perc_c double")
    top, low = F.greatest("rho_perc_a", "rho_perc_b", "rho_perc_c"), F.least("rho_perc_a", "rho_perc_b", "rho_perc_c")
    mean = (F.col("rho_perc_a") + F.col("rho_perc_b") + F.col("rho_perc_c")) / 3
    return made.withColumn("perc_anisotropy", F.coalesce(F.try_divide(top - low, mean), F.lit(0.0)))
