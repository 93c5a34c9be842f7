"""Incremental featurisation: new density files are featurised once, restarts repeat nothing that is done.

The stream is stateless: a row a file, errors recorded in the row. Each micro-batch appends to a table partitioned by
batch, and rewriting a batch after a failure overwrites its own partition, so results are exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscape.options import Options
from rhoscape.plans.featurize import featurize
from rhoscape.sources.density import read_densities

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def feature_stream(spark: SparkSession, folder: str, pattern: str = "CHG*", options: Options | None = None, files_per_batch: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return featurize(read_densities(files), options)


def run_available(features: DataFrame, table: str, checkpoint: str) -> None:
    """Process all files there are, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """One row a path, from its last batch."""
    rows = spark.read.parquet(table)
    return rows.groupBy("path").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "path")), "batch").alias("r")).select("path", "r.*")
