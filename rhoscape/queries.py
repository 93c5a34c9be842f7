"""Queries of the analytics engine over the driver's tables; oracles.py has their SQL equivalents.

The tables hold no crystals, so line items are summed into one periodic grid a return flag and all suppliers, dealt into
four, stand for its atoms (operators.grid.voxelize, operators.geometry.bind_atoms).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscape.constants import MAP_RHO, MAP_S, SPHERE_A, VALUE_BINS
from rhoscape.functions.chemistry import chemical_system, elements_of, has_f_element, parent_directory, reduced_counts, species
from rhoscape.functions.linear import eigenvalues, erf
from rhoscape.operators import compare, figures, geometry, grid, metrics, models, profiles, properties, reduce, spectral, stencil, tabular, topology
from rhoscape.operators.grid import CELL, SCALE, SIZE
from rhoscape.sources import bundles, runs, synthetic


#: Numbers in an embedding.
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.voxelize(table(spark, sf_dir, "lineitem"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.bind_atoms(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))


def positions(spark: SparkSession) -> DataFrame:
    return grid.voxel_grid(spark)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.nearest_atoms(positions(spark), atoms(spark, sf_dir))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.sphere_regions(positions(spark), atoms(spark, sf_dir))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with nearest atom and region."""
    return voxels(spark, sf_dir).join(nearest(spark, sf_dir), "vox").join(regions(spark, sf_dir), "vox")


def derived(spark: SparkSession, sf_dir: str, order: int = 4, hessian: bool = True) -> DataFrame:
    return stencil.cartesian(stencil.fractional_derivatives(voxels(spark, sf_dir), order, SIZE, hessian), CELL, hessian)


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).join(nearest(spark, sf_dir), "vox").join(regions(spark, sf_dir), "vox")


def curved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with Hessian eigenvalues and atomic units, rounded where a threshold looks at them."""
    with_l = eigenvalues(full(spark, sf_dir), "hxx", "hyy", "hzz", "hxy", "hxz", "hyz", ("l1", "l2", "l3"))
    rounded = with_l.select("*").withColumns({n: F.round(n, 6) for n in ("l1", "l2", "l3")})
    return reduce.atomic_units(rounded)


def rounded(frame: DataFrame, digits: int = 6, but: tuple = ()) -> DataFrame:
    """Floating-point columns rounded, negative zero made zero."""
    return frame.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in but else F.col(c) for c, t in frame.dtypes))


# grids ----------------------------------------------------------------------------------------------------------------


def grid_integrate(spark, sf_dir):
    return rounded(reduce.integrals(voxels(spark, sf_dir)))


def slab_profiles(spark, sf_dir):
    return grid.slab_profiles(voxels(spark, sf_dir))


def roll_neighbors(spark, sf_dir):
    offsets = spark.createDataFrame([(1, 0, 0, "i"), (0, 1, 0, "j"), (0, 0, 1, "k")], "di int, dj int, dk int, axis string")
    return grid.neighbour(voxels(spark, sf_dir), offsets).groupBy("structure_id", "vox").pivot("axis", ["i", "j", "k"]).agg(F.max("there")).select("structure_id", "vox", F.col("i").alias("ahead_i"), F.col("j").alias("ahead_j"), F.col("k").alias("ahead_k"))


def slice_plane(spark, sf_dir):
    return grid.slice_plane(voxels(spark, sf_dir), "k", 0.3).select("structure_id", "vox", "rho")


def preview(spark, sf_dir):
    return grid.preview(voxels(spark, sf_dir), SIZE, 4).select("structure_id", "vox", "rho")


def translate_invariance(spark, sf_dir):
    """Extent and moments of the grid and of its translate: equal rows, so no difference stays."""
    base = voxels(spark, sf_dir)
    sums = lambda v: v.groupBy("structure_id").agg(F.sum("rho").alias("total"), F.sum(F.col("rho") * F.col("rho")).alias("square"), F.max("rho").alias("top"))
    before, after = sums(base), sums(grid.translate(base, (3, 5, 7)))
    return before.exceptAll(after).agg(F.count("*").alias("differing"))


def supercell_invariance(spark, sf_dir):
    base = voxels(spark, sf_dir)
    mean = lambda v, n: v.groupBy("structure_id").agg((F.sum("rho") / n).cast("bigint").alias("total"), F.max("rho").alias("top"), F.min("rho").alias("low"))
    return mean(grid.supercell(base, (2, 1, 2)), 4).select("structure_id", "total", "top", "low")


def grid_sizes(spark, sf_dir):
    lengths = table(spark, sf_dir, "part").select("p_partkey", *((F.col("p_size") / F.lit(k) + 2.0).alias(f"l{a}") for a, k in ((1, 4.0), (2, 7.0), (3, 3.0))))
    return grid.grid_sizes(lengths).select("p_partkey", "n1", "n2", "n3")


# derivatives ----------------------------------------------------------------------------------------------------------


def fd_gradient(spark, sf_dir):
    made = None
    for order in (2, 4, 6, 8):
        part = stencil.fractional_derivatives(voxels(spark, sf_dir), order, SIZE, False).select("structure_id", "vox", F.lit(order).alias("accuracy"), "g1", "g2", "g3")
        made = part if made is None else made.unionByName(part)
    return rounded(made, 5)


def fd_hessian(spark, sf_dir):
    return rounded(stencil.fractional_derivatives(voxels(spark, sf_dir)).select("structure_id", "vox", "h11", "h22", "h33", "h12", "h13", "h23"), 4)


def fd_laplacian(spark, sf_dir):
    return rounded(derived(spark, sf_dir).select("structure_id", "vox", "lap", "lap_diagonal"), 4)


def laplacian_shares(spark, sf_dir):
    return rounded(reduce.laplacian_shares(full(spark, sf_dir)))


def gradient_shape(spark, sf_dir):
    shape = reduce.gradient_shape(full(spark, sf_dir))
    return rounded(shape.select("structure_id", "zeta", "t1", "t2", "t3", "charge_FA"))


def hessian_eigen(spark, sf_dir):
    return rounded(eigenvalues(derived(spark, sf_dir), "hxx", "hyy", "hzz", "hxy", "hxz", "hyz", ("l1", "l2", "l3")).select("structure_id", "vox", "l1", "l2", "l3"), 3)


def curvature(spark, sf_dir):
    return rounded(reduce.curvature(curved(spark, sf_dir), s_max=3.0))


def nci_map(spark, sf_dir):
    signed = curved(spark, sf_dir).withColumn("x", F.round(F.signum("l2") * F.col("rho_au"), 9)).withColumn("y", F.round("s", 9))
    return profiles.histogram_2d(signed, "x", "y", (120, 80), (-MAP_RHO, MAP_RHO, 0.0, MAP_S), ["structure_id"])


def hartree_potential(spark, sf_dir):
    return rounded(spectral.synthesise_grid(spectral.hartree(voxels(spark, sf_dir), scale=SCALE)).withColumnRenamed("value", "v"))


def potential_spread(spark, sf_dir):
    """V at the sites and over the interstitial voxels, from one set of amplitudes."""
    field = spectral.synthesise_grid(spectral.hartree(voxels(spark, sf_dir), scale=SCALE))
    sites = atoms(spark, sf_dir).select("atom", ((F.round(F.col("fx") * SIZE) * SIZE + F.round(F.col("fy") * SIZE)) * SIZE + F.round(F.col("fz") * SIZE)).cast("bigint").alias("vox"))
    spread = field.join(F.broadcast(sites), "vox").groupBy("structure_id").agg(F.stddev_pop("value").alias("V_spread"))
    low = field.join(regions(spark, sf_dir), "vox").groupBy("structure_id").agg(F.coalesce(F.min(F.when(F.col("region") == "int", F.col("value"))), F.lit(0.0)).alias("V_int_min"))
    return rounded(spread.join(low, "structure_id"))


def midpoint_density(spark, sf_dir):
    base = atoms(spark, sf_dir)
    ends = lambda side: base.select(F.col("atom").alias(side), *(F.col(f"f{c}").alias(f"{side}{c}") for c in "xyz"))
    bonds = geometry.bond_census(base).join(F.broadcast(ends("i")), "i").join(F.broadcast(ends("j")), "j")
    points = bonds.select("i", "j", "t1", "t2", "t3", *((0.5 * (F.col(f"i{c}") + F.col(f"j{c}") + F.col(f"t{a}"))).alias(f"u{a}") for a, c in enumerate("xyz", start=1)))
    values = spectral.synthesise(spectral.transform(voxels(spark, sf_dir)), points, ["i", "j", "t1", "t2", "t3"])
    return rounded(values.groupBy("structure_id").agg(F.avg("value").alias("rho_mid_mean"), F.stddev_pop("value").alias("rho_mid_std"), F.count("*").alias("bonds")))


# geometry -------------------------------------------------------------------------------------------------------------


def nearest_atom(spark, sf_dir):
    return rounded(nearest(spark, sf_dir).select("vox", "atom", "element", "r"))


def sphere_regions(spark, sf_dir):
    return rounded(regions(spark, sf_dir).select("vox", F.col("sphere_atom").alias("atom"), F.col("rs").alias("r"), "region"))


def bond_census(spark, sf_dir):
    return rounded(geometry.bond_census(atoms(spark, sf_dir)))


def neighbor_edges(spark, sf_dir):
    return rounded(geometry.neighbour_edges(atoms(spark, sf_dir), 4.05))


def becke_weights(spark, sf_dir):
    return rounded(geometry.becke_weights(positions(spark), atoms(spark, sf_dir)))


def periodic_images(spark, sf_dir):
    return rounded(geometry.images(atoms(spark, sf_dir), 2.0).select("atom", "t1", "t2", "t3", "px", "py", "pz"))


# descriptors ----------------------------------------------------------------------------------------------------------


def moments(spark, sf_dir):
    return rounded(reduce.moments(placed(spark, sf_dir)).select("structure_id", "m1", "m2", "sigma_r2", "f_core", "f_bond", "f_int"))


def information(spark, sf_dir):
    return rounded(reduce.information(voxels(spark, sf_dir)))


def site_values(spark, sf_dir):
    return rounded(reduce.site_values(full(spark, sf_dir)).select("structure_id", "atom", "element", "m1", "f_bond", "zeta", "charge"))


def site_statistics(spark, sf_dir):
    return rounded(reduce.site_statistics(reduce.site_values(full(spark, sf_dir)), ["m1", "f_bond", "zeta"]))


def anova_parts(spark, sf_dir):
    """Within and between variance of line prices: parts as sites of their brand."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    sites = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("x")).join(parts.select("p_partkey", F.col("p_brand").alias("element")), "p_partkey").withColumn("structure_id", F.lit("all"))
    return rounded(reduce.site_statistics(sites, ["x"]).select("x_site_std", "x_site_range", "x_within_element_var", "x_between_element_var"))


def sensitivity_sweep(spark, sf_dir):
    factors = [(a, b) for a in (0.6, 0.79, 1.0) for b in (0.9, 1.14, 1.4)]
    return rounded(reduce.sensitivity_sweep(placed(spark, sf_dir), factors))


def nmape(spark, sf_dir):
    base = voxels(spark, sf_dir)
    return rounded(reduce.nmape(base.where("structure_id = 'N'"), base.where("structure_id = 'R'")))


def renormalised(spark, sf_dir):
    electrons = reduce.valence_electrons(atoms(spark, sf_dir))
    each = voxels(spark, sf_dir).select("structure_id").distinct().join(F.broadcast(electrons))  # one row
    made = reduce.renormalised(voxels(spark, sf_dir), each)
    return rounded(made.groupBy("structure_id").agg((F.avg("rho") * F.lit(CELL.volume)).alias("electrons"), F.max("rho").alias("top")))


def extremum_census(spark, sf_dir):
    return topology.extremum_census(voxels(spark, sf_dir)).select("structure_id", "n_max", "n_min", "n_saddle1", "n_saddle2", "euler")


def lower_mask(spark, sf_dir):
    return topology.lower_bits(voxels(spark, sf_dir))


def ascent_basins(spark, sf_dir):
    return topology.ascent_basins(voxels(spark, sf_dir)).select("structure_id", "vox", F.col("to").alias("basin"))


def non_nuclear_maxima(spark, sf_dir):
    """Maxima outside every core and the charge share of their basins."""
    base = voxels(spark, sf_dir)
    basins = topology.ascent_basins(base)
    # A maximum is a voxel that is its own basin.
    peaks = basins.where(F.col("vox") == F.col("to")).join(regions(spark, sf_dir), "vox").where(F.col("region") != "core").select("structure_id", "to")
    held = base.join(basins, ["structure_id", "vox"]).join(peaks.withColumn("ghost", F.lit(1)), ["structure_id", "to"], "left")
    charge = held.groupBy("structure_id").agg(reduce.share(reduce.where(F.col("ghost") == 1, "rho"), F.sum("rho")).alias("Q_NNM"))
    count = peaks.groupBy("structure_id").agg(F.count("*").alias("ghosts"))
    return rounded(charge.join(count, "structure_id", "left").select("structure_id", (F.coalesce("ghosts", F.lit(0)) / F.lit(CELL.volume)).alias("n_NNM"), "Q_NNM"))


def basin_charges(spark, sf_dir):
    base = voxels(spark, sf_dir)
    return rounded(profiles.basin_charges(base, topology.ascent_basins(base)).select("structure_id", "basin", "charge", "share", "rank"))


def percolation(spark, sf_dir):
    return rounded(topology.percolation(voxels(spark, sf_dir)))


# profiles -------------------------------------------------------------------------------------------------------------


def radial_profile(spark, sf_dir):
    return rounded(profiles.radial_profile(full(spark, sf_dir).withColumn("lap", F.round("lap", 4)), CELL.volume / SIZE**3), 3)


def region_profile(spark, sf_dir):
    return rounded(profiles.region_profile(placed(spark, sf_dir), CELL.volume / SIZE**3))


def hist_1d(spark, sf_dir):
    return profiles.histogram(table(spark, sf_dir, "events"), "value", VALUE_BINS, ["event_type"])


def hist_weighted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return profiles.histogram(lines, "l_quantity", 50, ["l_returnflag"], "cents")


def support_range(spark, sf_dir):
    return profiles.support_range(hist_1d(spark, sf_dir), 0.5, ["event_type"])


def site_labels(spark, sf_dir):
    """Occurrence numbers within groups, in order."""
    ranked = tabular.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey", "rank")
    return ranked.select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey"), F.lit("-"), F.col("rank")).alias("label"))


# tables ---------------------------------------------------------------------------------------------------------------


def etl_targets(spark, sf_dir):
    """Left-joined, tolerance-checked and masked targets."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    spent = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.max("o_totalprice"), 2).alias("top"), F.count("*").alias("orders"))
    base = tabular.reindexed(customers.select("c_custkey", "c_acctbal", "c_nationkey"), {"spend": spent}, "c_custkey")
    sane = F.col("c_acctbal").between(0, 5000)
    return base.select("c_custkey", tabular.masked("spend_top", sane).alias("top"), "spend_orders", sane.cast("int").alias("sane"), tabular.agree("c_acctbal", "spend_top", 1000.0).cast("int").alias("near"))


def _systems(spark, sf_dir) -> DataFrame:
    """Customers with the set of order priorities as a system and a split by key."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.substring("o_orderpriority", 1, 1))), "-").alias("system"))
    split = F.when(F.col("o_custkey") % 10 == 0, "test").when(F.col("o_custkey") % 10 == 1, "val").otherwise("train")
    return orders.withColumn("split", split)


def held_out_systems(spark, sf_dir):
    return tabular.held_out_systems(_systems(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("system").alias("systems"), F.sum("o_custkey").alias("keys"))


def control_split(spark, sf_dir):
    return tabular.size_matched_control(_systems(spark, sf_dir), "o_custkey").groupBy("split").agg(F.count("*").alias("n"))


def coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.lit(1.0).alias("one"))
    split = F.when(F.col("c_custkey") % 10 == 0, "test").when(F.col("c_custkey") % 10 == 1, "val").otherwise("train")
    return tabular.coverage(rows.withColumn("split", split), ["balance", "one"])


def inconsistent_keys(spark, sf_dir):
    return tabular.inconsistent(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus")


def repeated_keys(spark, sf_dir):
    return tabular.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def formula_parse(spark, sf_dir):
    """Element symbols of names read as formulas."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit("Fe2O"), F.col("p_size")).alias("formula"))
    return names.select("p_partkey", chemical_system(F.col("formula")).alias("system"), F.size(elements_of(F.col("formula"))).alias("elements"), has_f_element(F.col("formula")).cast("int").alias("f_element"))


def species_expand(spark, sf_dir):
    labels = F.array(F.lit("Fe_pv"), F.lit("O/abc"), F.lit("Ni"))
    counts = F.array(*((F.col("p_size") % k + 1).cast("bigint") for k in (3, 4, 2)))
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.array_join(species(labels, counts), ",").alias("species"), F.array_join(reduced_counts(F.transform(counts, lambda n: n * 6)), ",").alias("reduced"))


def run_dir_pick(spark, sf_dir):
    """Directory and file of each page's address; the least file of a directory is taken."""
    pages = table(spark, sf_dir, "pages").select("page_id", parent_directory(F.col("url")).alias("directory"), F.element_at(F.split("url", "/"), -1).alias("file"))
    return pages.groupBy("directory").agg(F.min("file").alias("file"), F.count("*").alias("files"))


def metrics_regression(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("guess", F.col("p_retailprice") * F.col("l_quantity"))
    return rounded(metrics.regression_scores(lines, "l_extendedprice", "guess", ["l_returnflag"]), 4)


def metrics_classification(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id").withColumn("p", F.col("n_chars") / (F.col("n_chars") + 2000.0)).withColumn("all", F.lit("all"))
    return rounded(metrics.classification_scores(scored, "quality", "p", ["all"]))


def _numbers(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return table(spark, sf_dir, "lineitem").select(*columns), columns


def spearman_matrix(spark, sf_dir):
    return rounded(metrics.spearman(*_numbers(spark, sf_dir)))


def redundant_pairs(spark, sf_dir):
    return rounded(metrics.redundant_pairs(metrics.spearman(*_numbers(spark, sf_dir)), 0.5))


def most_similar(spark, sf_dir):
    return rounded(metrics.most_similar(metrics.spearman(*_numbers(spark, sf_dir))))


def complete_linkage(spark, sf_dir):
    frame, columns = _numbers(spark, sf_dir)
    found = metrics.complete_linkage(metrics.spearman(frame, columns), columns, 0.5)
    return spark.createDataFrame(sorted(found.items()), "name string, cluster int")


def bootstrap_interval(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), F.col("l_extendedprice").alias("y"), (F.col("p_retailprice") * F.col("l_quantity")).alias("p"), (F.col("l_quantity") * 1500.0).alias("q"))
    return rounded(metrics.bootstrap_difference(rows, "key", "y", "p", "q"))


def seed_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_type", "value")
    return rounded(metrics.seed_summary(runs, ["event_type"], "value"))


def best_by(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_acctbal")
    return metrics.best_by(rows, ["c_mktsegment"], "c_name", "c_acctbal")


def importance_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").cast("bigint").alias("gain"))
    return rounded(metrics.importance_shares(rows, "l_returnflag", "l_suppkey", "gain", 10))


def _features(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    names = [f"x{k}" for k in range(DIMENSIONS)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(names))), names


def feature_range(spark, sf_dir):
    return rounded(compare.feature_range(*_features(spark, sf_dir)))


def outside_range(spark, sf_dir):
    frame, names = _features(spark, sf_dir)
    return rounded(compare.outside_range(frame, "vec_id", names, compare.feature_range(frame, names)))


def tolerant_match(spark, sf_dir):
    frame, names = _features(spark, sf_dir)
    moved = frame.where("vec_id % 3 = 0").select("vec_id", *(F.when(F.col("vec_id") % 2 == 0, F.col(n) * (1 + 1e-7)).otherwise(F.col(n) + 1.0).alias(n) for n in names))
    return compare.tolerant_match(moved, frame, "vec_id", names)


def compare_rows(spark, sf_dir):
    base = voxels(spark, sf_dir)
    side = lambda s, n: base.where(F.col("structure_id") == s).select(F.col("vox").alias("name"), F.col("rho").cast("double").alias(n))
    met = side("N", "a").join(side("R", "b"), "name").withColumn("scale", F.lit(1000.0)).withColumn("spearman", F.col("name") / 512.0)
    return rounded(compare.compare_rows(met))


def compare_summary(spark, sf_dir):
    base = voxels(spark, sf_dir)
    side = lambda s, n: base.where(F.col("structure_id") == s).select(F.col("vox").alias("name"), F.col("rho").cast("double").alias(n))
    met = side("N", "a").join(side("A", "b"), "name").withColumn("scale", F.lit(1000.0)).withColumn("spearman", F.lit(0.9))
    return rounded(compare.compare_summary(compare.compare_rows(met)))


def inverse_transform(spark, sf_dir):
    z = F.col("p_retailprice") / 1000.0
    parts = table(spark, sf_dir, "part")
    return rounded(parts.select("p_partkey", compare.inverse_transform(z, "log10", 20.0).alias("log10"), compare.inverse_transform(z, "log1p", None).alias("log1p"), compare.inverse_transform(z - 1.5, None, 0.0).alias("plain"), compare.decimals(z).alias("decimals")))


def json_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.when(F.col("r_regionkey") == 2, F.lit(float("nan"))).otherwise(F.col("r_regionkey") / 2.0).alias("x"))
    return compare.json_rows(rows, ["r_regionkey", "r_name", "x"])


def error_function(spark, sf_dir):
    """erf of a range of values against their Gaussian sums."""
    x = (F.col("p_size") - 25) / 10.0
    return rounded(table(spark, sf_dir, "part").select("p_partkey", erf(x).alias("erf")))


def catalogue(spark, sf_dir):
    from rhoscape.plans.registry import catalogue as made

    return made(spark)


def element_table(spark, sf_dir):
    from rhoscape.elements import elements

    return elements(spark).select("z", "symbol", "covalent_radius", F.col("zval").cast("double").alias("zval"))


# whole plans ----------------------------------------------------------------------------------------------------------


def packed_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids as packed structures, for the kernels' path."""
    import numpy as np

    base = voxels(spark, sf_dir)
    sites = atoms(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("atom", "element", "fx", "fy", "fz"))).alias("sites"))
    grids = base.groupBy("structure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vox", "rho"))), lambda v: v.rho * F.lit(SCALE)).alias("values"))
    rows = grids.join(F.broadcast(sites))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["structure_id"]]), pa.array([CELL.rows.ravel().tolist()]), pa.array([[s["element"] for s in r["sites"]]]), pa.array([[s[c] for s in r["sites"] for c in ("fx", "fy", "fz")]]), pa.array([[SIZE] * 3], pa.list_(pa.int32())), pa.array([np.array(r["values"], "<f8").tobytes()]), pa.array([""])],
                    ["path", "lattice", "species", "frac", "shape", "grid", "error"],
                )

    from rhoscape.sources.density import PACKED

    return rows.mapInArrow(pack, PACKED)


def featurize_packed(spark, sf_dir):
    from rhoscape.options import Options
    from rhoscape.plans.featurize import featurize

    return featurize(packed_structures(spark, sf_dir), Options(derivative_backend="fd")).drop("wall_time_s")


def featurize_spectral(spark, sf_dir):
    from rhoscape.options import Options
    from rhoscape.plans.featurize import featurize

    return featurize(packed_structures(spark, sf_dir), Options(partition="becke")).drop("wall_time_s")


def featurize_relational(spark, sf_dir):
    """The relational descriptors side by side: one wide row a structure."""
    out = moments(spark, sf_dir)
    for part in (laplacian_shares, gradient_shape, information, site_statistics, non_nuclear_maxima):
        out = out.join(part(spark, sf_dir), "structure_id")
    return out


def sweep_packed(spark, sf_dir):
    from rhoscape.plans.featurize import sweep

    return sweep(packed_structures(spark, sf_dir), [(0.6, 1.0), (0.79, 1.14), (1.2, 1.0)])


def grid_convergence(spark, sf_dir):
    from rhoscape.plans.featurize import grid_convergence as made

    return made(packed_structures(spark, sf_dir))


def density_round_trip(spark, sf_dir):
    """Structures written as volumetric files, read back and held against the originals."""
    from rhoscape.sources.density import read_densities

    def text(batches):
        import numpy as np
        import pyarrow as pa

        from rhoscape.sources.density import format_density

        for batch in batches:
            for r in batch.to_pylist():
                made = format_density(r["lattice"], r["species"], r["frac"], [np.frombuffer(r["grid"], "<f8").reshape(r["shape"])])
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([made.encode()])], ["path", "content"])

    @F.arrow_udf("double")
    def total(grids):
        import numpy as np
        import pyarrow as pa

        return pa.array([float(np.frombuffer(g, "<f8").sum()) for g in grids.to_pylist()])

    packed = packed_structures(spark, sf_dir)
    back = read_densities(packed.mapInArrow(text, "path string, content binary"))
    return back.select("path", F.size("species").alias("n_atoms"), F.array_join("shape", "x").alias("shape"), F.round(total("grid"), 6).alias("total"), "error")


def _training(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    frame, names = _features(spark, sf_dir)
    return frame.withColumn("y", F.exp(F.col("x0") + 0.5 * F.col("x1"))).withColumn("label", (F.col("x2") > F.col("x3")).cast("int")), names


def score_linear(spark, sf_dir):
    rows, names = _training(spark, sf_dir)
    model = models.fit(rows.where("vec_id % 5 > 0"), names, "y", "linear", "log10", regParam=1e-3)
    return rounded(metrics.regression_scores(models.predict(model, rows.where("vec_id % 5 = 0"), "p", "log10", 0.0).withColumn("set", F.lit("test")), "y", "p", ["set"]), 4)


def score_tuned(spark, sf_dir):
    """A linear model whose penalty does best on validation rows, scored on test rows."""
    rows, names = _training(spark, sf_dir)
    part = lambda k: rows.where(F.col("vec_id") % 5 == k)
    model = models.tuned(rows.where("vec_id % 5 > 1"), part(1), names, "y", "log10")
    return rounded(metrics.regression_scores(models.predict(model, part(0), "p", "log10", 0.0).withColumn("set", F.lit("test")), "y", "p", ["set"]), 4)


def score_boosted(spark, sf_dir):
    rows, names = _training(spark, sf_dir)
    model = models.fit(rows.where("vec_id % 5 > 0"), names, "label", "boosted", None, True, seed=1)
    return rounded(metrics.classification_scores(models.predict(model, rows.where("vec_id % 5 = 0"), "p", None, None, True).withColumn("set", F.lit("test")), "label", "p", ["set"]), 4)


def predict_density(spark, sf_dir):
    """Density of the atoms by a plug-in of atom-centred Gaussians, in chunks, renormalised to the valence electrons."""
    from rhoscape.plans.predict import gaussians
    from rhoscape.plans.predict import predict_density as predicted

    structure = packed_structures(spark, sf_dir).where("path = 'N'")
    return rounded(predicted(structure, gaussians, cutoff=4.0, pairs=1 << 12).select("vox", "rho"))


def synthetic_density(spark, sf_dir):
    """Gaussian superposition over the atoms' images."""
    sites = atoms(spark, sf_dir).select("*", (F.col("atom") + 6).cast("double").alias("electrons"), (1.5 + 0.25 * F.col("atom")).alias("exponent"))
    return rounded(synthetic.superpose(positions(spark), sites))


def cell_summary(spark, sf_dir):
    return rounded(properties.cell_summary(atoms(spark, sf_dir)))


def atoms_near_plane(spark, sf_dir):
    every = None
    for axis in range(3):
        part = properties.atoms_near_plane(atoms(spark, sf_dir), axis, 0.25, 1.2).withColumn("axis", F.lit(axis))
        every = part if every is None else every.unionByName(part)
    return rounded(every)


def chunk_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n_atoms"), (F.col("p_retailprice") / 10.0).alias("volume"))
    return rounded(properties.chunk_sizes(rows).select("p_partkey", "pairs_per_point", "chunk"))


def compare_properties(spark, sf_dir):
    names = F.array(*map(F.lit, ("band_gap", "is_metal", "is_gap_direct", "refractive_index")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")).alias("name"), (F.col("p_size") / 50.0).alias("a"), (F.pmod(F.col("p_size") * 7, F.lit(50)) / 50.0).alias("b"))
    full_ = rows.select(F.concat_ws("|", "name", "p_partkey").alias("key"), "name", F.when(F.col("name").startswith("is_"), "classification").otherwise("regression").alias("task"), F.lit(0.2).alias("error"), "a", "b", F.col("a").alias("metal_a"), F.col("b").alias("metal_b"))
    return rounded(properties.compare_properties(full_).groupBy("name").agg(F.count_if("agree").alias("agreeing"), F.count("*").alias("n"), F.count("difference").alias("compared"), F.sum("difference").alias("total")))


def value_texts(spark, sf_dir):
    """Properties as they are shown: classes with certainty, numbers with the decimals of their error."""
    parts = table(spark, sf_dir, "part")
    task = F.when(F.col("p_partkey") % 2 == 0, "classification").otherwise("regression")
    return parts.select("p_partkey", properties.value_text(task, (F.col("p_size") / F.lit(50.0)), F.lit(0.05)).alias("text"), properties.weak(task, F.col("p_size") / 50.0).cast("int").alias("weak"))


def document_flatten(spark, sf_dir):
    return runs.flattened(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("json")), "struct<k:bigint>")


def one_to_one_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return tabular.one_to_one(nations, suppliers, "n_nationkey")


def set_operations(spark, sf_dir):
    """Union, difference and intersection of the elements of two groups of atoms."""
    keys = table(spark, sf_dir, "lineitem")
    early, late = keys.where("l_quantity < 5").select(F.col("l_partkey").alias("key")), keys.where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    tagged = lambda f, name: f.withColumn("set", F.lit(name))
    every = tagged(early.union(late).distinct(), "union").unionByName(tagged(early.intersect(late), "both")).unionByName(tagged(early.exceptAll(late).distinct(), "surplus")).unionByName(tagged(early.subtract(late), "only"))
    return every.groupBy("set").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


def sampled_extrema(spark, sf_dir):
    peaks = topology.lower_bits(voxels(spark, sf_dir)).where((F.col("bits") == (1 << 26) - 1) | (F.col("bits") == 0))
    return profiles.sampled(peaks, 20)


def born_stability(spark, sf_dir):
    """Stability of stiffness-like matrices of part sizes."""
    n = F.col("p_size").cast("double")
    flat = F.array(*[F.lit(40.0) + n if i == j else n * (1.0 + (i + j) % 3) / F.lit(3.0) for i in range(6) for j in range(6)])
    return table(spark, sf_dir, "part").select("p_partkey", tabular.born_stable(flat).alias("stable"))


def bundle_scoring(spark, sf_dir):
    """A model bundle of one small tree model over embedding features."""
    frame, names = _features(spark, sf_dir)
    return rounded(bundles.predict(frame.select("vec_id", *names), _bundle(names)).select("vec_id", "y"))


# figures and studies --------------------------------------------------------------------------------------------------


def zeta_angles(spark, sf_dir):
    return rounded(figures.radial_angles(full(spark, sf_dir)), 4)


def tensor_angles(spark, sf_dir):
    return rounded(figures.tensor_angles(full(spark, sf_dir)), 2)


def ellipticity_values(spark, sf_dir):
    return figures.ellipticities(curved(spark, sf_dir))


def signed_densities(spark, sf_dir):
    return figures.signed_densities(curved(spark, sf_dir), 3.0, 0.05)


def interstitial_values(spark, sf_dir):
    return figures.interstitial_values(placed(spark, sf_dir))


def least_voxel(spark, sf_dir):
    return rounded(figures.least_voxel(placed(spark, sf_dir)))


def site_frame(spark, sf_dir):
    return rounded(figures.site_frame(reduce.site_values(full(spark, sf_dir)).withColumn("m1", F.round("m1", 9)), "m1"))


def element_boxes(spark, sf_dir):
    """Line prices by brand, a part a site, as boxes."""
    sites = table(spark, sf_dir, "part").select(F.lit("all").alias("structure_id"), F.col("p_brand").alias("element"), "p_retailprice")
    return rounded(figures.element_boxes(sites, "p_retailprice"))


def bond_types(spark, sf_dir):
    base = atoms(spark, sf_dir)
    ends = lambda side: base.select(F.col("atom").alias(side), *(F.col(f"f{c}").alias(f"{side}{c}") for c in "xyz"))
    bonds = geometry.bond_census(base).join(ends("i"), "i").join(ends("j"), "j")
    points = bonds.select("i", "j", "t1", "t2", "t3", "length", *((0.5 * (F.col(f"i{c}") + F.col(f"j{c}") + F.col(f"t{a}"))).alias(f"u{a}") for a, c in enumerate("xyz", start=1)))
    values = spectral.synthesise(spectral.transform(voxels(spark, sf_dir)), points, ["i", "j", "t1", "t2", "t3", "length"])
    return rounded(figures.bond_types(values, base))


def maxima_by_ratio(spark, sf_dir):
    basins = topology.ascent_basins(voxels(spark, sf_dir))
    return figures.maxima_by_ratio(basins.where(F.col("vox") == F.col("to")).join(regions(spark, sf_dir), "vox"), SPHERE_A)


def cell_edges(spark, sf_dir):
    cells = voxels(spark, sf_dir).select("structure_id").distinct().withColumn("lattice", F.array(*(F.lit(float(v)) for v in CELL.rows.ravel())))
    return rounded(figures.cell_edges(cells))


def _priced(spark, sf_dir) -> DataFrame:
    """Line items with their price and two guesses of it."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("p_retailprice") * F.col("l_quantity")).alias("p"), (F.col("l_quantity") * 1500.0).alias("q"))


def squared_distances(spark, sf_dir):
    return figures.squared_distances(placed(spark, sf_dir))


def centred_density(spark, sf_dir):
    return rounded(reduce.centred(voxels(spark, sf_dir)).select("structure_id", "vox", "rho"))


def long_results(spark, sf_dir):
    """Descriptors of each structure, one row a value with its domain and units."""
    from rhoscape.plans.registry import catalogue as made

    wide = moments(spark, sf_dir).join(information(spark, sf_dir), "structure_id")
    return compare.long_results(wide, "structure_id", [c for c in wide.columns if c != "structure_id"], made(spark))


def document_tensor(spark, sf_dir):
    """Documents with a nested 6 x 6 tensor as one column an entry of its upper triangle."""
    size = F.col("p_size")
    rows = F.array(*(F.array(*(size + (i + 1) * 10 + j for j in range(6))) for i in range(6)))
    made = F.to_json(F.struct(F.struct(rows.alias("tensor"), size.alias("k")).alias("elastic"), F.col("p_brand").alias("brand")))
    documents = table(spark, sf_dir, "part").select("p_partkey", made.alias("json"))
    return runs.flattened(documents, "struct<elastic:struct<tensor:array<array<bigint>>,k:bigint>,brand:string>", tensor="elastic_tensor")


def parity(spark, sf_dir):
    return rounded(figures.parity(_priced(spark, sf_dir), "y", "p", ["l_returnflag"], "log10"))


def paired_evaluation(spark, sf_dir):
    return rounded(figures.paired_evaluation(_priced(spark, sf_dir), ["l_returnflag"], "y", "p", "q"))


def _rated(spark, sf_dir) -> DataFrame:
    """Labelled documents with two probabilities of quality."""
    n = F.col("n_chars")
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return met.where(n.isNotNull()).select(F.lit("all").alias("all"), "quality", (n / (n + 2000.0)).alias("p"), ((n % 97) / 97.0).alias("q"))


def paired_classes(spark, sf_dir):
    return rounded(figures.paired_classes(_rated(spark, sf_dir), ["all"], "quality", "p", "q"))


def class_histogram(spark, sf_dir):
    return figures.class_histogram(_rated(spark, sf_dir), "quality", "p")


def relabelled_split(spark, sf_dir):
    rows = _systems(spark, sf_dir)
    aside = rows.where(F.col("o_custkey") % 7 == 0).select("o_custkey")
    return tabular.relabelled(rows, aside, "o_custkey").groupBy("split").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


def gap_labels(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", tabular.conditional_label(size > 10, F.when(key % 5 > 0, key % 2 == 0), "direct", "indirect").alias("gap"))


def found_descriptors(spark, sf_dir):
    """Descriptors of one domain that mention a text."""
    from rhoscape.plans.registry import catalogue as made

    return tabular.containing(made(spark).where("domain = 'bonding'"), ["name", "formula"], "Charge").select("name", "domain")


def importance_melt(spark, sf_dir):
    """Mean |value| of each embedding dimension, in long form with its share."""
    frame, names = _features(spark, sf_dir)
    long = frame.select(*(F.abs(n).alias(n) for n in names)).unpivot([], names, "name", "value").groupBy("name").agg(F.avg("value").alias("gain")).withColumn("model", F.lit("m"))
    return rounded(metrics.importance_shares(long, "model", "name", "gain"))


def _bundle(names: list[str]):
    """A model bundle with one tree of three leaves on two features."""
    import json

    tree = "tree\nobjective=regression\nfeature_names=" + " ".join(names) + "\n\nTree=0\nnum_leaves=3\nsplit_feature=0 1\nthreshold=0 0.1\ndecision_type=2 10\nleft_child=-1 -2\nright_child=1 -3\nleaf_value=0.5 1 2\ninternal_count=500 200\nleaf_count=300 80 120\n\nend of trees\n"
    raw = {"name": "example", "features": names, "feature_range": {n: [-1, 1] for n in names}, "targets": {"y": {"task": "regression", "transform": "log10", "floor": 4.0, "booster": tree}}}
    return bundles.parse_bundle(json.dumps(raw).encode())


def shap_importances(spark, sf_dir):
    frame, names = _features(spark, sf_dir)
    return rounded(bundles.leading(bundles.importances(frame.select(*names), _bundle(names), "y"), 3), 9)


def structure_formats(spark, sf_dir):
    """The atoms written as a header, a crystallographic file and extended XYZ, and read again."""
    from rhoscape.sources import structures

    sites = atoms(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("atom", "element", "fx", "fy", "fz"))).alias("sites"))
    lattice = [" ".join(map(repr, map(float, row))) for row in CELL.rows]
    each = lambda line: F.array_join(F.transform("sites", line), "\n")
    places = lambda s: F.concat_ws(" ", s.fx, s.fy, s.fz)
    at = lambda s, c: s.fx * float(CELL.rows[0, c]) + s.fy * float(CELL.rows[1, c]) + s.fz * float(CELL.rows[2, c])
    header = F.concat(F.lit("c\n1.0\n" + "\n".join(lattice) + "\n"), F.array_join(F.transform("sites", lambda s: s.element), " "), F.lit("\n1 1 1 1\nDirect\n"), each(places))
    cell = "\n".join([*(f"_cell_length_{n} {v!r}" for n, v in zip("abc", map(float, CELL.lengths))), *(f"_cell_angle_{n} {v!r}" for n, v in zip(("alpha", "beta", "gamma"), map(float, CELL.angles)))])
    crystal = F.concat(F.lit(f"data_x\n{cell}\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n"), each(lambda s: F.concat_ws(" ", s.element, places(s))))
    points = F.concat(F.lit(f'4\nLattice="{" ".join(lattice)}"\n'), each(lambda s: F.concat_ws(" ", s.element, *(at(s, c) for c in range(3)))))
    bare = F.concat(F.lit("4\nno lattice\n"), each(lambda s: F.concat_ws(" ", s.element, *(at(s, c) for c in range(3)))))
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("path"), v.cast("binary").alias("content")) for n, v in (("POSCAR", header), ("a.cif", crystal), ("a.xyz", points), ("bare.xyz", bare)))))
    read = structures.read_structures(sites.select(named.alias("f")).select("f.*"))
    return read.select("path", F.array_join("species", "").alias("species"), F.round(F.aggregate("frac", F.lit(0.0), lambda a, x: a + x), 6).alias("fractions"), (F.col("error") == "").alias("read"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments(spark, sf_dir)


#: Queries in the order of the inventory.
QUERIES: list[Callable] = [
    voxels, grid_integrate, slab_profiles, roll_neighbors, slice_plane, preview, translate_invariance, supercell_invariance, grid_sizes,
    fd_gradient, fd_hessian, fd_laplacian, laplacian_shares, gradient_shape, hessian_eigen, curvature, nci_map, hartree_potential, potential_spread, midpoint_density,
    nearest_atom, sphere_regions, bond_census, neighbor_edges, becke_weights, periodic_images,
    moments, information, site_values, site_statistics, anova_parts, sensitivity_sweep, nmape, renormalised,
    extremum_census, lower_mask, ascent_basins, non_nuclear_maxima, basin_charges, percolation,
    radial_profile, region_profile, hist_1d, hist_weighted, support_range, site_labels,
    etl_targets, held_out_systems, control_split, coverage, inconsistent_keys, repeated_keys, formula_parse, species_expand, run_dir_pick,
    metrics_regression, metrics_classification, spearman_matrix, redundant_pairs, most_similar, complete_linkage, bootstrap_interval, seed_summary, best_by, importance_shares,
    feature_range, outside_range, tolerant_match, compare_rows, compare_summary, inverse_transform, json_rows, error_function, catalogue, element_table,
    featurize_packed, featurize_spectral, featurize_relational, sweep_packed, grid_convergence, density_round_trip, synthetic_density, cell_summary, atoms_near_plane, chunk_sizes, compare_properties, value_texts, document_flatten,
    one_to_one_join, set_operations, sampled_extrema, born_stability, bundle_scoring, score_linear, score_boosted, score_tuned, predict_density,
    zeta_angles, tensor_angles, ellipticity_values, signed_densities, interstitial_values, least_voxel, site_frame, element_boxes, bond_types, maxima_by_ratio, cell_edges,
    squared_distances, centred_density, long_results, document_tensor, parity, paired_evaluation, paired_classes, class_histogram, relabelled_split, gap_labels, found_descriptors, importance_melt, shap_importances, structure_formats,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {("voxelize" if f is voxels else f.__name__): f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from rhoscape.oracles import ORACLES

    return dict(ORACLES)


