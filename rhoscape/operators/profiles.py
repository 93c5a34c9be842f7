"""Histograms and profiles: the data behind the descriptor figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhoscape.constants import GEOMETRY_EPS, RADIAL_BIN, RATIO_BIN


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of x, the last edge closed; an empty range is widened by a half to either side."""
    lo = F.when(high > low, low).otherwise(low - 0.5)
    hi = F.when(high > low, high).otherwise(high + 0.5)
    return F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")


def histogram(frame: DataFrame, x: str, bins: int, by: list[str] | None = None, weight: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts (or weight sums) of each non-empty bin of each group; the range defaults to the group's own."""
    by = by or []
    if low is None or high is None:
        ends = frame.groupBy(*by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
        ranged = frame.join(ends, by) if by else frame.join(F.broadcast(ends))  # without groups, one row
    else:
        ranged = frame.where(F.col(x).between(low, high)).withColumn("__lo", F.lit(float(low))).withColumn("__hi", F.lit(float(high)))
    binned = ranged.where(F.col(x).isNotNull()).withColumn("bin", bin_of(F.col(x), F.col("__lo"), F.col("__hi"), bins))
    return binned.groupBy(*by, "bin").agg((F.sum(weight) if weight else F.count("*")).alias("amount"))


def histogram_2d(frame: DataFrame, x: str, y: str, bins: tuple[int, int], ends: tuple[float, float, float, float], by: list[str] | None = None) -> DataFrame:
    x0, x1, y0, y1 = map(F.lit, map(float, ends))
    inside = frame.where(F.col(x).between(ends[0], ends[1]) & F.col(y).between(ends[2], ends[3]))
    return inside.groupBy(*(by or []), bin_of(F.col(x), x0, x1, bins[0]).alias("bx"), bin_of(F.col(y), y0, y1, bins[1]).alias("by")).agg(F.count("*").alias("amount"))


def radial_profile(voxels: DataFrame, dv: float) -> DataFrame:
    """Charge, volume and Laplacian by distance; bins are closed to the right. Needs r and lap."""
    k = F.greatest(F.ceil((F.col("r") - GEOMETRY_EPS) / RADIAL_BIN) - 1, F.lit(0)).cast("int")
    down = F.col("lap") < 0
    total = lambda c: F.sum(F.when(down, c).otherwise(0))
    return voxels.groupBy("structure_id", k.alias("bin")).agg(
        (F.sum("rho") * dv).alias("charge"), (F.count("*") * dv).alias("volume"), (total(1) * dv).alias("vol_neg"), (total(F.col("rho")) * dv).alias("charge_neg"),
        (total(F.abs("lap")) * dv).alias("lap_neg"), (F.sum(F.when(~down, F.abs("lap")).otherwise(0)) * dv).alias("lap_pos"),
    )


def region_profile(voxels: DataFrame, dv: float) -> DataFrame:
    """Charge by r / radius, a column a region; bins are closed to the left. Needs rs, radius and region."""
    k = F.floor(F.col("rs") / F.col("radius") / RATIO_BIN).cast("int")
    pivoted = voxels.groupBy("structure_id", k.alias("bin")).pivot("region", ["core", "bond", "int"]).agg(F.sum("rho") * dv)
    return pivoted.na.fill(0.0, ["core", "bond", "int"])


def support_range(bins: DataFrame, tol: float, by: list[str]) -> DataFrame:
    """First and last bin above a share of the largest."""
    kept = bins.withColumn("__top", F.max("amount").over(Window.partitionBy(*by))).where(F.col("amount") > tol * F.col("__top"))
    return kept.groupBy(*by).agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


def sampled(points: DataFrame, most: int) -> DataFrame:
    """A fixed pseudo-random choice of at most so many rows with the number of all rows."""
    total = points.agg(F.count("*").alias("total"))
    return points.orderBy(F.md5(F.concat_ws(":", *points.columns).cast("binary"))).limit(most).join(F.broadcast(total))


def basin_charges(voxels: DataFrame, basins: DataFrame, most: int | None = 40) -> DataFrame:
    """Charge share of every basin, the largest first."""
    held = voxels.join(basins, ["structure_id", "vox"]).groupBy("structure_id", F.col("to").alias("basin")).agg(F.sum("rho").alias("charge"))
    shares = held.withColumn("share", F.try_divide(F.col("charge"), F.sum("charge").over(Window.partitionBy("structure_id"))))
    if most is None:
        return shares
    order = Window.partitionBy("structure_id").orderBy(F.desc("charge"), "basin")
    return shares.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
