"""The data behind the descriptor and property figures: distributions, sites, bonds, cells and test sets, as tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscape.constants import RATIO_BIN, UNIT_BINS, VALUE_BINS
from rhoscape.functions.linear import eigenvalues
from rhoscape.operators.profiles import bin_of, histogram
from rhoscape.storage import quantiles

#: Gradients below this norm have no direction.
FLAT = 1e-9
#: Digits kept before binning, so that rounding errors don't move values over a bin's edge.
DIGITS = 9
#: Width of the bins of predicted probabilities, and the least value on a logarithmic axis (fixed values).
PROBABILITY_BIN, LOG_FLOOR = 0.05, 1e-3


def _unit(x: Column) -> Column:
    return F.round(F.least(x, F.lit(1.0)), DIGITS)


def radial_angles(voxels: DataFrame) -> DataFrame:
    """|cos| between the gradient and the direction to the nearest atom, weighted by the gradient's norm."""
    cosine = F.abs(F.col("gx") * F.col("ux") + F.col("gy") * F.col("uy") + F.col("gz") * F.col("uz")) / F.col("gn")
    return histogram(voxels.where(F.col("gn") > FLAT).withColumn("x", _unit(cosine)), "x", UNIT_BINS, ["structure_id"], "gn", 0.0, 1.0)


def squared_distances(voxels: DataFrame, bins: int = 100) -> DataFrame:
    """Charge by squared distance to the nearest atom, from 0 to a structure's largest; needs r."""
    ends = voxels.groupBy("structure_id").agg(F.pow(F.max(F.round("r", DIGITS)), 2.0).alias("__top"))
    held = voxels.join(ends, "structure_id").withColumn("bin", bin_of(F.pow(F.round("r", DIGITS), 2.0), F.lit(0.0), F.col("__top"), bins))
    return held.groupBy("structure_id", "bin").agg(F.sum("rho").alias("amount"))


def tensor_angles(voxels: DataFrame) -> DataFrame:
    """cos² between the gradient and each axis of the gradient tensor, weighted by the squared norm.

    Axes need not be named: with eigenvalues t1..t3 apart, the square is g'Pg / g'g for the projector P = (T - ti)(T -
    tj) / (tk - ti)(tk - tj) on the axis of tk. A structure with two equal eigenvalues has no axes and no rows.
    """
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    steep = voxels.where(F.col("gn") > FLAT)
    sums = steep.groupBy("structure_id").agg(F.sum(F.col("gn") ** 2).alias("trace"), *(F.sum(F.col(f"g{p[0]}") * F.col(f"g{p[1]}")).alias(f"s{p}") for p in pairs))
    tensor = eigenvalues(sums.select("structure_id", *((F.col(f"s{p}") / F.col("trace")).alias(f"t{p}") for p in pairs)), *(f"t{p}" for p in pairs), ("t1", "t2", "t3"))
    apart = (F.col("t2") - F.col("t1") > FLAT) & (F.col("t3") - F.col("t2") > FLAT)
    met = steep.join(tensor.where(apart), "structure_id")
    g = {c: F.col(f"g{c}") / F.col("gn") for c in "xyz"}
    at = lambda a, b: F.col("t" + "".join(sorted(a + b)))
    turned = {a: sum((at(a, b) * g[b] for b in "xyz"), F.lit(0.0)) for a in "xyz"}  # T g
    whole = sum((g[c] * g[c] for c in "xyz"), F.lit(0.0))
    once = sum((g[c] * turned[c] for c in "xyz"), F.lit(0.0))
    twice = sum((turned[c] * turned[c] for c in "xyz"), F.lit(0.0))
    named = met.select("structure_id", F.col("gn"), "t1", "t2", "t3", whole.alias("m0"), once.alias("m1"), twice.alias("m2"))
    squares = []
    for k in (1, 2, 3):
        i, j = (F.col(f"t{n}") for n in (1, 2, 3) if n != k)
        t = F.col(f"t{k}")
        squares.append(((F.col("m2") - (i + j) * F.col("m1") + i * j * F.col("m0")) / ((t - i) * (t - j))).alias(f"c{k}"))
    long = named.select("structure_id", (F.col("gn") ** 2).alias("weight"), *squares).unpivot(["structure_id", "weight"], ["c1", "c2", "c3"], "axis", "x")
    return histogram(long.withColumn("x", F.greatest(_unit(F.col("x")), F.lit(0.0))), "x", UNIT_BINS, ["structure_id", "axis"], "weight", 0.0, 1.0)


def ellipticities(voxels: DataFrame) -> DataFrame:
    """1 - l2 / l1 of the bond voxels with l2 < 0; needs l1, l2 and region."""
    bond = voxels.where((F.col("region") == "bond") & (F.col("l2") < 0))
    return histogram(bond.withColumn("x", _unit(1 - F.col("l2") / F.col("l1"))), "x", UNIT_BINS, ["structure_id"], None, 0.0, 1.0)


def signed_densities(voxels: DataFrame, s_max: float, rho_max: float) -> DataFrame:
    """sign(l2) rho of the voxels of weak interaction, by sign; needs l2, rho_au and s."""
    weak = voxels.where((F.col("s") < s_max) & (F.col("rho_au") < rho_max)).withColumn("x", F.round(F.signum("l2") * F.col("rho_au"), DIGITS)).withColumn("attractive", F.col("l2") < 0)
    return histogram(weak, "x", VALUE_BINS, ["structure_id", "attractive"], None, -rho_max, rho_max)


def interstitial_values(voxels: DataFrame, value: str = "rho") -> DataFrame:
    """Counts of all voxels and of the interstitial ones by value, in bins of all voxels' range; needs region."""
    ends = voxels.groupBy("structure_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    binned = voxels.join(ends, "structure_id").withColumn("bin", bin_of(F.col(value), F.col("low"), F.col("high"), VALUE_BINS))
    return binned.groupBy("structure_id", "bin").agg(F.count("*").alias("voxels"), F.count_if(F.col("region") == "int").alias("interstitial"))


def least_voxel(voxels: DataFrame) -> DataFrame:
    """The voxel of the least density (the first of equal ones), its nearest atom and the distance to it."""
    place = F.min_by(F.struct("vox", "rho", "atom", "element", "r"), F.struct("rho", "vox")).alias("b")
    return voxels.groupBy("structure_id").agg(place).select("structure_id", "b.vox", "b.rho", "b.atom", "b.element", "b.r")


def site_frame(sites: DataFrame, value: str) -> DataFrame:
    """A site's value beside the mean and spread of all sites, its label (element and occurrence) and whether it is extreme."""
    from rhoscape.operators.tabular import numbered

    labelled = numbered(sites.withColumn("__group", F.concat_ws("|", "structure_id", "element")), "__group", "atom", "__k").select("structure_id", "atom", "element", F.concat("element", "__k").alias("label"), F.col(value).alias("value"))
    whole = sites.groupBy("structure_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), F.max(value).alias("__top"), F.min(value).alias("__low"))
    met = labelled.join(whole, "structure_id")
    return met.select("structure_id", "atom", "label", "value", "mean", "spread", (F.col("value") == F.col("__top")).alias("highest"), (F.col("value") == F.col("__low")).alias("lowest"))


def element_boxes(sites: DataFrame, value: str) -> DataFrame:
    """Quartiles, variance, share of sites and distance from the overall mean of each element's sites."""
    by = ["structure_id", "element"]
    boxes = quantiles(sites, by, value, {"low": 0.0, "quarter": 0.25, "middle": 0.5, "three_quarters": 0.75, "high": 1.0})
    each = sites.groupBy(*by).agg(F.count(value).alias("sites"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    whole = sites.groupBy("structure_id").agg(F.count(value).alias("__n"), F.avg(value).alias("__mean"))
    met = each.join(boxes, by).join(whole, "structure_id")
    return met.select(*by, "sites", (F.col("sites") / F.col("__n")).alias("share"), (F.col("mean") - F.col("__mean")).alias("offset"), "variance", "low", "quarter", "middle", "three_quarters", "high")


def bond_types(bonds: DataFrame, atoms: DataFrame, value: str = "value") -> DataFrame:
    """Bonds (structure_id, i, j, length, value) by the pair of their elements: number, mean, spread and mean length."""
    ends = lambda side: atoms.select(F.col("atom").alias(side), F.col("element").alias(f"e{side}"))
    named = bonds.join(ends("i"), "i").join(ends("j"), "j")
    pair = F.concat_ws("-", F.least("ei", "ej"), F.greatest("ei", "ej"))
    return named.groupBy("structure_id", pair.alias("pair")).agg(F.count("*").alias("bonds"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("spread"), F.avg("length").alias("length"))


def maxima_by_ratio(maxima: DataFrame, a: float) -> DataFrame:
    """Maxima (structure_id, rs, radius) by their distance to the nearest atom in radii: at a nucleus, and others."""
    ratio = F.round(F.col("rs") / F.col("radius"), DIGITS)
    inside = F.col("region") == "core"
    width = 5 * RATIO_BIN
    return maxima.groupBy("structure_id", F.floor(ratio / F.lit(width)).cast("int").alias("bin")).agg(F.count_if(inside).alias("nuclear"), F.count_if(~inside).alias("other")).withColumn("marks_core", (F.col("bin") * width <= a) & (F.lit(a) < (F.col("bin") + 1) * width))


def cell_edges(cells: DataFrame) -> DataFrame:
    """The twelve edges of cells (structure_id, lattice of nine numbers, rows first): corner numbers and end points."""
    corners = list(itertools.product((0, 1), repeat=3))
    edges = [(m, n) for m, n in itertools.combinations(range(8), 2) if sum(p != q for p, q in zip(corners[m], corners[n])) == 1]
    at = lambda corner, c: sum((F.lit(float(corner[a])) * F.col("lattice")[3 * a + c] for a in range(3)), F.lit(0.0))
    made = [F.struct(F.lit(m).alias("start"), F.lit(n).alias("stop"), *(at(corners[m], c).alias(f"{'xyz'[c]}0") for c in range(3)), *(at(corners[n], c).alias(f"{'xyz'[c]}1") for c in range(3))) for m, n in edges]
    return cells.select("structure_id", F.explode(F.array(*made)).alias("e")).select("structure_id", "e.*")


def parity(tested: DataFrame, y: str, p: str, by: list[str], transform: str | None = None) -> DataFrame:
    """The axis range of a test set's values against its predictions, and how many points lie on either side of equality."""
    low = F.least(F.min(y), F.min(p))
    return tested.groupBy(*by).agg(
        (F.greatest(low, F.lit(LOG_FLOOR)) if transform == "log10" else low).alias("low"),
        F.greatest(F.max(y), F.max(p)).alias("high"),
        F.count_if(F.col(p) > F.col(y)).alias("above"),
        F.count_if(F.col(p) < F.col(y)).alias("below"),
        F.count("*").alias("n"),
    )


def class_histogram(tested: DataFrame, y: str, p: str) -> DataFrame:
    """Predicted probabilities of each true class in bins of PROBABILITY_BIN."""
    bins = round(1 / PROBABILITY_BIN)
    return histogram(tested.where(F.col(y).isNotNull()).withColumn("x", F.round(p, DIGITS)), "x", bins, [y], None, 0.0, 1.0)


def paired_evaluation(tested: DataFrame, by: list[str], y: str, p: str, q: str) -> DataFrame:
    """Scores of predictions p and q from two sources of features for the same rows, and how far the two agree."""
    r2 = lambda a, b: 1 - F.try_divide(F.sum((F.col(a) - F.col(b)) ** 2), F.var_pop(a) * F.count(a))
    return tested.groupBy(*by).agg(
        F.count("*").alias("n_test"), r2(y, p).alias("p_r2"), r2(y, q).alias("q_r2"), F.avg(F.abs(F.col(y) - F.col(p))).alias("p_mae"), F.avg(F.abs(F.col(y) - F.col(q))).alias("q_mae"), r2(p, q).alias("agree_r2")
    )


def paired_classes(tested: DataFrame, by: list[str], y: str, p: str, q: str) -> DataFrame:
    """ROC-AUC of two probabilities for the same rows, and the share of rows that both put into one class."""
    from rhoscape.operators.metrics import classification_scores

    auc = lambda c, name: classification_scores(tested, y, c, by).select(*by, F.col("roc_auc").alias(name))
    same = tested.groupBy(*by).agg(F.avg(((F.col(p) >= 0.5) == (F.col(q) >= 0.5)).cast("double")).alias("same_class"))
    return same.join(auc(p, "p_auc"), by).join(auc(q, "q_auc"), by)
