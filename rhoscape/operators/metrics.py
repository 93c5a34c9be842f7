"""Scores of predictions, rank correlation, redundancy, bootstrap intervals."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rhoscape.storage import quantiles, running_total


def regression_scores(frame: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """mae, rmse, r2 = 1 - SSE/SST (not a squared correlation) in one pass, and the median absolute error by counting."""
    error, value = F.col(y) - F.col(p), F.col(y)
    sst = F.var_pop(value) * F.count(value)
    sums = frame.groupBy(*by).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error**2)).alias("rmse"), (1 - F.try_divide(F.sum(error**2), sst)).alias("r2"))
    return sums.join(quantiles(frame.select(*by, F.abs(error).alias("__e")), by, "__e", {"median_ae": 0.5}), by)


def classification_scores(frame: DataFrame, y: str, p: str, by: list[str], bins: int | None = None) -> DataFrame:
    """ROC-AUC by midranks, accuracy and F1 at one half, and the log loss (probabilities kept within 1e-7 of the ends).

    Rows are first counted by distinct score, so ranks are taken over score values, not rows.
    """
    value = F.round(F.col(p), bins) if bins is not None else F.col(p)
    pos = F.col(y) == 1
    kept = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(p)))
    base = frame.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    hard = F.col(p) >= 0.5
    plain = base.groupBy(*by).agg(
        F.avg((hard == pos).cast("double")).alias("accuracy"),
        F.coalesce(F.try_divide(2.0 * F.count_if(hard & pos), F.count_if(hard) + F.count_if(pos)), F.lit(0.0)).alias("f1"),
        (-F.avg(F.when(pos, F.ln(kept)).otherwise(F.ln(1 - kept)))).alias("logloss"),
    )
    counted = base.groupBy(*by, value.alias("__v")).agg(F.count("*").alias("__n"), F.count_if(pos).alias("__p"))
    ranked = running_total(counted, by, "__v", "__n", "__below").withColumn("__r", F.col("__below") + (F.col("__n") + 1) / 2.0)
    n1, n = F.sum("__p"), F.sum("__n")
    auc = ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("__r") * F.col("__p")) - n1 * (n1 + 1) / 2.0, n1 * (n - n1)).alias("roc_auc"))
    return plain.join(auc, by)


def ranks(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Midranks of each column, by counting its distinct values first: no window over all rows."""
    out = frame
    for c in columns:
        values = running_total(frame.groupBy(c).agg(F.count("*").alias("__n")), [], c, "__n", "__below")
        ranked = values.select(F.col(c), (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(f"__rank_{c}"))
        out = out.join(ranked, c)
    return out.select(*(F.col(f"__rank_{c}").alias(c) for c in columns))


def spearman(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair a < b: moments of midranks in one aggregation; NaN and null become 0."""
    pairs = list(itertools.combinations(columns, 2))
    row = ranks(frame.dropna(subset=columns), columns).agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    stacked = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "rho")
    return stacked.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), F.coalesce(F.nanvl("rho", F.lit(None)), F.lit(0.0)).alias("rho"))


def redundant_pairs(matrix: DataFrame, cut: float = 0.9) -> DataFrame:
    return matrix.where(F.abs("rho") >= cut).select("a", "b", F.abs("rho").alias("abs_rho"))


def most_similar(matrix: DataFrame) -> DataFrame:
    """Each column's most correlated other column."""
    both = matrix.select("a", "b", F.abs("rho").alias("r")).unionByName(matrix.select(F.col("b").alias("a"), F.col("a").alias("b"), F.abs("rho").alias("r")))
    return both.groupBy("a").agg(F.max_by("b", F.struct("r", "b")).alias("most_similar"), F.max("r").alias("r"))


def complete_linkage(matrix: DataFrame, columns: list[str], cut: float = 0.9) -> dict[str, int]:
    """Clusters whose members all correlate at least cut, merged closest first (a matrix of columns, not rows, on the driver)."""
    away = {frozenset((r["a"], r["b"])): 1 - abs(r["rho"]) for r in matrix.collect()}
    groups = [[c] for c in columns]
    while True:
        best = min(((max(away[frozenset((x, y))] for x in g for y in h), i, j) for (i, g), (j, h) in itertools.combinations(enumerate(groups), 2)), default=(2.0, 0, 0))
        if best[0] > 1 - cut + 1e-12:
            return {c: k for k, g in enumerate(groups) for c in g}
        groups[best[1]] += groups.pop(best[2])


def representatives(clusters: dict[str, int], importances: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Of each cluster of columns the one of the largest importance, and how many it stands for; without one it counts as 0."""
    table = importances.sparkSession.createDataFrame(sorted(clusters.items()), f"{name} string, cluster int")
    met = table.join(importances.select(name, value), name, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    return met.groupBy("cluster").agg(F.max_by(name, F.struct(F.col(value), F.col(name))).alias("kept"), F.count("*").alias("members"))


#: Chances that a Poisson(1) number is at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(9)])
#: Prime modulus and constants of the draws' hash (fixed values); all products stay within 63 bits.
PRIME, MIX = 2_147_483_647, (48_271, 69_621, 16_807)
#: Draws times rows that are weighed at once.
WEIGHED = 2_000_000


def draw_weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each draw (a row) takes each key (a column): Poisson(1) numbers from a hash of both."""
    x = (keys[None, :] % PRIME * MIX[0] + draws[:, None] * MIX[1] + MIX[2]) % PRIME
    for constant in MIX:
        x = (x * x + x * constant) % PRIME
    return np.searchsorted(POISSON, x / PRIME, "right").astype(float)


def bootstrap_difference(frame: DataFrame, key: str, y: str, p: str, q: str, draws: int = 2_000) -> DataFrame:
    """2.5 and 97.5 percentiles over paired resamples of r2(q) - r2(p); key is a whole number that tells rows apart.

    A resample takes each row a hashed Poisson(1) number of times, so rows stay where they are: a batch's rows are
    weighed for all draws as a matrix, a task adds its batches up, and only sums by draw are shuffled.
    """

    def run(batches):
        every, total = np.arange(draws), np.zeros((draws, 5))
        for batch in batches:
            keys, *values = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            v, one, other = (x.astype(float) for x in values)
            terms = np.stack([np.ones(len(v)), v, v * v, (v - one) ** 2, (v - other) ** 2], 1)
            step = max(1, WEIGHED // draws)
            for at in range(0, len(v), step):
                total += draw_weights(keys[at : at + step].astype(np.int64), every) @ terms[at : at + step]
        yield pa.RecordBatch.from_arrays([pa.array(every), *(pa.array(total[:, k]) for k in range(5))], ["draw", "w", "s", "ss", "sp", "sq"])

    rows = frame.select(F.col(key).cast("bigint"), *(F.col(c).cast("double") for c in (y, p, q))).dropna()
    sums = rows.mapInArrow(run, "draw bigint, w double, s double, ss double, sp double, sq double").groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("w", "s", "ss", "sp", "sq")))
    # A row a draw, whatever the rows.
    return sums.agg(F.percentile(F.try_divide(F.col("sp") - F.col("sq"), F.col("ss") - F.try_divide(F.col("s") ** 2, F.col("w"))), F.array(F.lit(0.025), F.lit(0.975))).alias("ends")).select(F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def seed_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample spread over seeds; one seed has spread 0."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(None)), F.lit(0.0)).alias("spread"), F.count("*").alias("seeds"))


def best_by(rows: DataFrame, by: list[str], name: str, score: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(name, F.struct(F.col(score), F.col(name))).alias("best"), F.max(score).alias("score"))


def importance_shares(rows: DataFrame, by: str, name: str, value: str, top: int | None = None) -> DataFrame:
    """Shares of a group's total, largest first, optionally the top few."""
    shared = rows.join(rows.groupBy(by).agg(F.sum(value).alias("__all")), by).withColumn("share", F.coalesce(F.try_divide(F.col(value), F.col("__all")), F.lit(0.0))).drop("__all")
    if top is not None:  # a bounded rank is limited before rows are dealt
        order = Window.partitionBy(by).orderBy(F.desc(value), name)
        return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ordered = shared.withColumn("__order", F.struct(-F.col(value), F.col(name))).withColumn("__one", F.lit(1))
    return running_total(ordered, [by], "__order", "__one", "__before").withColumn("rank", (F.col("__before") + 1).cast("int")).drop("__before", "__order", "__one")
