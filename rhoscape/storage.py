"""Tables in the cluster's shared storage that cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that the cluster names; a local session, which is one machine, may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """A table in shared storage in df's place; it goes with the application, or earlier by discard()."""
    spark = df.sparkSession
    name = shared_path(spark, label)
    df.write.parquet(name)
    system, path = _located(spark, name)
    system.deleteOnExit(path)
    out = spark.read.parquet(name)
    out._stored_at = name
    return out


def discard(stored: DataFrame) -> None:
    """Delete the table behind what materialise() returned."""
    system, path = _located(stored.sparkSession, stored._stored_at)
    system.delete(path, True)


def running_total(counts: DataFrame, by: list[str], order: str, amount: str, name: str) -> DataFrame:
    """counts with the sum of amount over the rows before each, in order, within groups, without gathering a group.

    Rows are dealt into ranges of (by, order) and stored, so that ranges stay as they are; a range starts where the
    sums of the ranges before it end.
    """
    ranged = materialise(counts.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "__part").agg(F.sum(amount).alias("__sum"))
    # A row for each range and group that meet: about as many as ranges and groups together.
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col("__part").alias("__of"), "__start")
    same = [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)] + [F.col("__part") == F.col("__of")]
    met = ranged.withColumn("__inside", inside).join(starts, same).withColumn(name, F.col("__inside") + F.col("__start"))
    return met.drop("__inside", "__start", "__part", "__of", *(f"__by{k}" for k in range(len(by))))


def quantiles(values: DataFrame, by: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles of a column in each group, a named column each; null values don't count.

    Rows are first counted by distinct value and the counts totalled range by range, so no task gathers a group.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    placed = running_total(counted, by, "__v", "__n", "__below")
    # A row a group: null groups meet as well.
    totals = placed.groupBy(*by).agg((F.max(F.col("__below") + F.col("__n")) - 1).alias("__last")).select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), "__last")
    met = placed.join(totals, [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)] or F.lit(True))
    out = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * F.col("__last")
        at = lambda rank: F.max(F.when((F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__n")), F.col("__v")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low * (1 - part) + high * part).alias(name))
    return met.groupBy(*by).agg(*out)
