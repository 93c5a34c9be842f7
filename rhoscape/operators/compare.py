"""Scoring, applicability and the comparison of two feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscape.constants import CLOSE, FAR, GRADES, NOISE
from rhoscape.storage import quantiles


def relative(a: Column, b: Column) -> Column:
    """|a - b| / max(|a|, |b|), 0 if both are 0, NaN unless both are finite; up to 2 for opposite signs."""
    finite = ~(F.isnan(a) | F.isnan(b) | (F.abs(a) == float("inf")) | (F.abs(b) == float("inf")))
    return F.when(finite, F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.lit(0.0))).otherwise(F.lit(float("nan")))


def grade(rho: Column) -> Column:
    return F.when(rho.isNull() | F.isnan(rho), "unknown").when(rho >= GRADES[0], "excellent").when(rho >= GRADES[1], "good").when(rho >= GRADES[2], "fair").otherwise("poor")


def compare_rows(table: DataFrame) -> DataFrame:
    """Rows of name, a, b, scale, spearman with relative difference, note and transfer grade.

    Values below NOISE of the descriptor's scale in both rows are noise: no difference is given.
    """
    noise = (F.col("scale") > 0) & (F.greatest(F.abs("a"), F.abs("b")) < NOISE * F.col("scale"))
    diff = F.when(noise, F.lit(float("nan"))).otherwise(relative(F.col("a"), F.col("b")))
    note = F.when(noise, "zero in both").when(~F.isnan(diff) & (diff > FAR), "differs").otherwise("")
    return table.select("name", "a", "b", diff.alias("difference"), note.alias("note"), grade(F.col("spearman")).alias("transfer"))


def compare_summary(compared: DataFrame) -> DataFrame:
    known = ~F.isnan("difference")
    median = quantiles(compared.where(known), [], "difference", {"median": 0.5})
    return median.join(compared.agg(F.count_if((known & (F.col("difference") <= CLOSE)) | (F.col("note") == "zero in both")).alias("close"), F.count_if(known & (F.col("difference") > FAR)).alias("far"), F.count("*").alias("n")))


def feature_range(frame: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Linear-interpolated percentiles of each column, long form."""
    long = frame.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "name", "value")
    return quantiles(long, ["name"], "value", {"low": low, "high": high})


def outside_range(frame: DataFrame, key: str, columns: list[str], ranges: DataFrame) -> DataFrame:
    """(key, name, value) of finite values outside their range; ranges are a row a column."""
    long = frame.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([key], columns, "name", "value")
    met = long.join(F.broadcast(ranges), "name")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return met.where(finite & (F.col("low") < F.col("high")) & ~F.col("value").between(F.col("low"), F.col("high"))).select(key, "name", "value")


def tolerant_match(queries: DataFrame, dataset: DataFrame, key: str, columns: list[str], rtol: float = 1e-5, atol: float = 1e-12) -> DataFrame:
    """The dataset row whose columns all equal a query's within atol + rtol |query|, if exactly one does.

    Rows can only meet if their first column does, so both sides are bucketed on its logarithm (a query also looks in
    the neighbouring buckets) and the join stays an equi-join; NaN equals NaN.
    """
    first = columns[0]

    def bucket(x: Column) -> Column:
        size = F.floor(F.ln(F.greatest(F.abs(x), F.lit(atol))) / F.lit(max(4 * rtol, 1e-6)))
        return F.when(F.isnan(x) | x.isNull(), F.lit(-(1 << 62)).cast("bigint")).otherwise(size.cast("bigint"))

    q = queries.withColumn("__b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: bucket(F.col(first)) + d))).alias("q")
    d = dataset.withColumn("__b", bucket(F.col(first))).alias("d")
    same = F.lit(True)
    for c in columns:
        a, b = F.col(f"d.{c}"), F.col(f"q.{c}")
        same = same & ((F.abs(a - b) <= atol + rtol * F.abs(b)) | (F.isnan(a) & F.isnan(b)))
    hits = q.join(d, (F.col("q.__b") == F.col("d.__b")) & same).select(F.col(f"q.{key}").alias("query"), F.col(f"d.{key}").alias("match")).distinct()
    return hits.groupBy("query").agg(F.min("match").alias("match"), F.count("*").alias("hits")).where("hits = 1").select("query", "match")


def inverse_transform(z: Column, transform: str | None, floor: float | None, classification: bool = False) -> Column:
    """A model's raw output in the target's units."""
    if classification:
        return z
    y = F.pow(F.lit(10.0), z) if transform == "log10" else F.expm1(z) if transform == "log1p" else z
    return y if floor is None else F.greatest(y, F.lit(float(floor)))


def forward_transform(y: Column, transform: str | None) -> Column:
    return F.log10(F.greatest(y, F.lit(1e-12))) if transform == "log10" else F.log1p(y) if transform == "log1p" else y


def decimals(error: Column) -> Column:
    """Decimals worth showing beside a typical error: one past its leading digit; 3 where it is unknown."""
    return F.when(error > 0, F.greatest(F.lit(0), 1 - F.floor(F.log10(error)).cast("int"))).otherwise(F.lit(3))


def long_results(wide: DataFrame, key: str, columns: list[str], catalogue: DataFrame) -> DataFrame:
    """One row a value with its domain and units."""
    return wide.select(key, *columns).unpivot([key], columns, "name", "value").join(F.broadcast(catalogue.select("name", "domain", "units")), "name")


def exported(descriptors: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """Plain numbers (kind, name, a, b, relative difference) of compared descriptors and properties (name, a, b), for export."""
    kinds = [("descriptor", descriptors)] + ([("property", properties)] if properties is not None else [])
    made = [t.select(F.lit(kind).alias("kind"), "name", "a", "b", relative(F.col("a"), F.col("b")).alias("relative_difference")) for kind, t in kinds]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def json_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON; values that aren't finite become null."""
    clean = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in frame.select(*columns).dtypes]
    return frame.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))
