"""Descriptors as weighted, masked aggregates over voxel tables: one groupBy a grain, all sums in one pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscape.constants import DENSITY_TO_AU, GRADIENT_TO_AU, NCI_RHO_MAX_AU, NCI_S_MAX, RHO_FLOOR_AU, S_PREFACTOR, UNIFORM_TOL
from rhoscape.functions.linear import eigenvalues
from rhoscape.operators.grid import CELL, SCALE


def share(part: Column, whole: Column, value: float = 0.0) -> Column:
    """part / whole, or the documented fallback where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(value))


def where(condition: Column, value: Column | str) -> Column:
    """Sum over the rows of a condition."""
    return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value).otherwise(0))


def uniform() -> Column:
    """Whether a group's values are constant up to rounding."""
    top = F.max(F.abs("rho"))
    return (top == 0) | (F.max("rho") - F.min("rho") <= UNIFORM_TOL * top)


def moments(voxels: DataFrame) -> DataFrame:
    """Radial moments and region shares of each structure; needs r and region."""
    total = F.sum("rho")
    m1, m2 = share(F.sum(F.col("rho") * F.col("r")), total), share(F.sum(F.col("rho") * F.col("r") ** 2), total)
    out = voxels.groupBy("structure_id").agg(m1.alias("m1"), m2.alias("m2"), *(share(where(F.col("region") == n, "rho"), total).alias(f"f_{n}") for n in ("core", "bond", "int")))
    return out.withColumn("sigma_r2", F.col("m2") - F.col("m1") ** 2)


def laplacian_shares(voxels: DataFrame) -> DataFrame:
    """Volume and charge shares of concentration and its share outside the cores; needs lap and region."""
    down, out_ = F.col("lap") < 0, F.col("region") != "core"
    return voxels.groupBy("structure_id").agg(
        F.when(uniform(), 0.0).otherwise(F.avg(down.cast("double"))).alias("lnf"),
        F.when(uniform(), 0.0).otherwise(share(where(down, "rho"), F.sum("rho"))).alias("lnf_charge_weighted"),
        F.when(uniform(), 0.5).otherwise(share(where(down & out_, F.abs("lap")), where(out_, F.abs("lap")), 0.5)).alias("lap_concentration_valence"),
    )


def gradient_shape(voxels: DataFrame) -> DataFrame:
    """Radial anisotropy, gradient tensor, its eigenvalues and fractional anisotropy; needs gx..gz, gn, ux..uz."""
    radial = F.abs(F.col("gx") * F.col("ux") + F.col("gy") * F.col("uy") + F.col("gz") * F.col("uz"))
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    sums = voxels.groupBy("structure_id").agg(
        (1 - F.coalesce(F.try_divide(F.sum(radial), F.sum("gn")), F.lit(1.0))).alias("zeta"),
        F.sum(F.col("gn") ** 2).alias("trace"),
        *(F.sum(F.col(f"g{p[0]}") * F.col(f"g{p[1]}")).alias(f"s{p}") for p in pairs),
    )
    t = sums.select("structure_id", "zeta", *(F.coalesce(F.try_divide(F.col(f"s{p}"), F.col("trace")), F.lit(1 / 3 if p[0] == p[1] else 0.0)).alias(f"t{p}") for p in pairs))
    t = eigenvalues(t, "txx", "tyy", "tzz", "txy", "txz", "tyz", ("t1", "t2", "t3"))
    off = 2 * (F.col("txy") ** 2 + F.col("txz") ** 2 + F.col("tyz") ** 2)
    deviation = sum(((F.col(f"t{p}") - F.lit(1 / 3)) ** 2 for p in pairs[:3]), F.lit(0.0)) + off
    whole = sum((F.col(f"t{p}") ** 2 for p in pairs[:3]), F.lit(0.0)) + off
    return t.withColumn("charge_FA", F.lit(math.sqrt(1.5)) * F.sqrt(F.try_divide(deviation, whole)))


def atomic_units(voxels: DataFrame, scale: float = SCALE) -> DataFrame:
    """Clipped density and reduced gradient in atomic units; needs gn."""
    rho = F.greatest(F.col("rho"), F.lit(0)) * F.lit(scale * DENSITY_TO_AU)
    with_rho = voxels.withColumn("rho_au", rho)
    s = F.try_divide(F.col("gn") * F.lit(scale * GRADIENT_TO_AU), F.lit(S_PREFACTOR) * F.pow("rho_au", F.lit(4 / 3)))
    return with_rho.withColumn("s", F.when(F.col("rho_au") > RHO_FLOOR_AU, s).otherwise(F.lit(float("inf"))))


def curvature(voxels: DataFrame, s_max: float = NCI_S_MAX, rho_max: float = NCI_RHO_MAX_AU) -> DataFrame:
    """Bond ellipticity and interaction measures; needs l1..l3 (Hessian eigenvalues), region, rho_au and s."""
    weak = (F.col("s") < s_max) & (F.col("rho_au") < rho_max)
    bond = (F.col("region") == "bond") & (F.col("l2") < 0)
    return voxels.groupBy("structure_id").agg(
        F.coalesce(F.avg(F.when(bond, 1 - F.try_divide(F.col("l2"), F.col("l1")))), F.lit(0.0)).alias("ellip_bond_bounded_avg"),
        F.avg(weak.cast("double")).alias("f_NCI"),
        F.coalesce(F.avg(F.when(weak, (F.col("l2") < 0).cast("double"))), F.lit(0.0)).alias("NCI_attractive"),
        F.coalesce(F.avg(F.when(weak, F.signum("l2") * F.col("rho_au"))), F.lit(0.0)).alias("sign_lambda2_rho_mean"),
    )


def information(voxels: DataFrame) -> DataFrame:
    """Entropy, disequilibrium and their product, and the density floor; sums of x ln x need no second pass."""
    x = F.greatest(F.col("rho"), F.lit(0)).cast("double")
    sums = voxels.groupBy("structure_id").agg(F.sum(x).alias("q"), F.sum(F.when(x > 0, x * F.ln(x)).otherwise(0.0)).alias("e"), F.sum(x * x).alias("w"), F.count("*").alias("n"), F.min("rho").alias("low"), F.avg("rho").alias("mean"))
    # With p = x / (q dv): -sum p ln p dv - ln V = ln(q / n) - e / q, and V sum p^2 dv = n w / q^2.
    entropy = F.ln(F.try_divide(F.col("q"), F.col("n"))) - F.try_divide(F.col("e"), F.col("q"))
    uneven = F.try_divide(F.col("n") * F.col("w"), F.col("q") ** 2)
    zero = F.col("q") <= 0
    return sums.select(
        "structure_id",
        F.when(zero, 0.0).otherwise(entropy).alias("shannon_entropy"),
        F.when(zero, 0.0).otherwise(uneven).alias("disequilibrium"),
        F.when(zero, 0.0).otherwise(uneven * F.exp(entropy)).alias("LMC_complexity"),
        F.col("low").cast("double").alias("rho_min"),
        share(F.col("low"), F.col("mean")).alias("rho_min_ratio"),
    )


def site_values(voxels: DataFrame) -> DataFrame:
    """m1 and zeta of every site over the nearest-atom cells and f_bond over the sphere cells."""
    radial = F.abs(F.col("gx") * F.col("ux") + F.col("gy") * F.col("uy") + F.col("gz") * F.col("uz"))
    near = voxels.groupBy("structure_id", "atom", "element").agg(
        F.try_divide(F.sum(F.col("rho") * F.col("r")), F.sum("rho")).alias("m1"), (1 - F.try_divide(F.sum(radial), F.sum("gn"))).alias("zeta"), F.sum("rho").alias("charge")
    )
    spheres = voxels.groupBy("structure_id", F.col("sphere_atom").alias("atom")).agg(F.try_divide(where(F.col("region") == "bond", "rho"), F.sum("rho")).alias("f_bond"))
    return near.join(spheres, ["structure_id", "atom"], "left")


def site_statistics(sites: DataFrame, values: list[str]) -> DataFrame:
    """Population spread of per-site values and its parts within and between elements, all values in one pass.

    Two levels of groupBy over (structure, value, element); columns are named value_statistic.
    """
    long = sites.unpivot(["structure_id", "element"], [F.col(v).cast("double").alias(v) for v in values], "base", "x")
    by_element = long.groupBy("structure_id", "base", "element").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.max("x").alias("top"), F.min("x").alias("low"), F.sum(F.col("x") ** 2).alias("q"))
    total = F.sum("n")
    mean = F.sum("s") / total
    statistics = {
        "site_std": F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / total - mean**2)),
        "site_range": F.max("top") - F.min("low"),
        "site_max": F.max("top"),
        "site_min": F.min("low"),
        "within_element_var": F.when(F.max("n") < 2, 0.0).otherwise(F.sum(F.col("n") * F.col("v")) / total),
        "between_element_var": F.when(F.count("*") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("m") ** 2) / total - mean**2)),
    }
    each = by_element.groupBy("structure_id", "base").agg(*(c.alias(n) for n, c in statistics.items()))
    return each.groupBy("structure_id").pivot("base", values).agg(*(F.first(n).alias(n) for n in statistics))


def sensitivity_sweep(voxels: DataFrame, factors: list[tuple[float, float]]) -> DataFrame:
    """Region shares for many sphere factors (a < b) from one scan: the parameters are a small broadcast side."""
    from rhoscape.operators.geometry import region

    table = voxels.sparkSession.createDataFrame([(float(a), float(b)) for a, b in factors if a < b], "a double, b double")
    met = voxels.join(F.broadcast(table)).withColumn("where", region(F.col("rs"), F.col("radius"), F.col("a"), F.col("b")))
    return met.groupBy("structure_id", "a", "b").agg(*(share(where(F.col("where") == n, "rho"), F.sum("rho")).alias(f"f_{n}") for n in ("core", "bond", "int")), F.coalesce(F.avg(F.when(F.col("where") == "int", F.col("rho"))), F.lit(0.0)).alias("rho_int_mean"))


def integrals(voxels: DataFrame, volume: float = CELL.volume) -> DataFrame:
    return voxels.groupBy("structure_id").agg((F.avg("rho") * F.lit(volume)).alias("integral"), F.avg("rho").alias("mean"))


def centred(voxels: DataFrame, value: str = "rho") -> DataFrame:
    """Voxels with their structure's mean taken off."""
    means = voxels.groupBy("structure_id").agg(F.avg(value).alias("__mean"))  # a row a structure
    return voxels.join(means, "structure_id").withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")


def renormalised(voxels: DataFrame, electrons: DataFrame, volume: float = CELL.volume) -> DataFrame:
    """Densities scaled to hold a structure's valence electrons; fails where a density holds no charge."""
    held = integrals(voxels, volume)
    factor = held.join(electrons, "structure_id").select("structure_id", F.when(F.col("integral") <= 0, F.raise_error(F.lit("the density holds no charge"))).otherwise(F.col("electrons") / F.col("integral")).cast("double").alias("factor"))
    return voxels.join(factor, "structure_id").withColumn("rho", F.col("rho") * F.col("factor")).drop("factor")


def valence_electrons(atoms: DataFrame) -> DataFrame:
    """Electrons of each structure's atoms, from the valence table; null if an element has none."""
    from rhoscape.elements import elements

    table = elements(atoms.sparkSession).select(F.col("symbol").alias("element"), "zval")
    return atoms.join(F.broadcast(table), "element", "left").agg(F.when(F.count("*") == F.count("zval"), F.sum("zval")).alias("electrons"))


def nmape(reference: DataFrame, other: DataFrame) -> DataFrame:
    """100 sum|b - a| / sum|a| over equal voxels; fails if the grids differ."""
    met = reference.select("vox", F.col("rho").alias("a")).join(other.select("vox", F.col("rho").alias("b")), "vox", "full")
    whole = F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1))
    return met.agg(F.when(whole > 0, F.raise_error(F.lit("grids differ")).cast("double")).otherwise(100 * F.sum(F.abs(F.col("b") - F.col("a"))) / F.sum(F.abs("a"))).alias("nmape"))
