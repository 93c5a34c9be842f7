"""The relational study around the features: assembling tables, leakage-safe splits and quality checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rhoscape.storage import running_total


def reindexed(base: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """base with the columns of each other table by key, left outer, prefixed by the table's name."""
    out = base
    for name, table in others.items():
        out = out.join(table.select(F.col(key), *(F.col(c).alias(f"{name}_{c}") for c in table.columns if c != key)), key, "left")
    return out


def agree(a: str, b: str, tol: float = 1e-3) -> Column:
    """Whether two values differ by less than a tolerance; null counts as no."""
    return F.coalesce(F.abs(F.col(a) - F.col(b)) < tol, F.lit(False))


def masked(value: str, condition: Column) -> Column:
    """The value where the condition holds, else null."""
    return F.when(condition, F.col(value))


def born_stable(stiffness: Column, least: float = 1.0):
    """Whether the symmetric part of a 6x6 matrix has its smallest eigenvalue above a bound; null without a matrix."""

    @F.arrow_udf("boolean")
    def stable(values: pa.Array) -> pa.Array:
        out = []
        for flat in values.to_pylist():
            m = None if flat is None else np.array(flat, float).reshape(6, 6)
            out.append(None if m is None else bool(np.isfinite(m).all() and np.linalg.eigvalsh((m + m.T) / 2)[0] > least))
        return pa.array(out, pa.bool_())

    return stable(stiffness)


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join that fails if a key repeats on either side; uniqueness is checked by the counts that come with the rows."""
    counted = [t.withColumn(f"__{n}", F.count("*").over(Window.partitionBy(key))) for n, t in (("l", left), ("r", right))]
    met = counted[0].join(counted[1], key, how)
    broken = (F.col("__l") > 1) | (F.coalesce("__r", F.lit(1)) > 1)
    return met.where(F.when(broken, F.raise_error(F.lit(f"{key} is not unique")).cast("boolean")).otherwise(F.lit(True))).drop("__l", "__r")


def duplicates(frame: DataFrame, *key: str) -> DataFrame:
    return frame.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def inconsistent(frame: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return frame.groupBy(key).agg(F.count_distinct(value).alias("values")).where(F.col("values") > 1)


def held_out_systems(rows: DataFrame, system: str = "system", split: str = "split") -> DataFrame:
    """Rows without the training and validation rows whose chemical system also occurs in the test rows."""
    tested = rows.where(F.col(split) == "test").select(F.col(system)).distinct()
    return rows.where(F.col(split) != "test").join(tested, system, "left_anti").select(*rows.columns).unionByName(rows.where(F.col(split) == "test"))


def size_matched_control(rows: DataFrame, key: str, system: str = "system", split: str = "split", seed: int = 0) -> DataFrame:
    """As many rows dropped from each split as held_out_systems() drops, chosen by hash among the rows that it keeps.

    Rows are numbered range by range in the order of their hash, so no task gathers a split.
    """
    tested = rows.where(F.col(split) == "test").select(F.col(system)).distinct().withColumn("__tested", F.lit(True))
    marked = rows.join(tested, system, "left").withColumn("__shared", (F.col(split) != "test") & F.coalesce("__tested", F.lit(False)))
    counts = marked.groupBy(split).agg(F.count_if("__shared").alias("__drop"))  # a row a split
    ordered = marked.withColumn("__order", F.struct(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))).withColumn("__one", F.when(F.col("__shared"), 0).otherwise(1))
    numbered = running_total(ordered, [split], "__order", "__one", "__before").join(counts, split)
    return numbered.where((F.col(split) == "test") | F.col("__shared") | (F.col("__before") >= F.col("__drop"))).select(*rows.columns)


def relabelled(rows: DataFrame, aside: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Rows whose key is set aside become the test rows, former test rows without one are left aside, others stay."""
    marked = rows.join(aside.select(key).distinct().withColumn("__aside", F.lit(True)), key, "left")
    label = F.when(F.col("__aside"), "test").when(F.col(split) == "test", "aside").otherwise(F.col(split))
    return marked.select(*(label.alias(split) if c == split else F.col(c) for c in rows.columns))


def numbered(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Occurrence numbers from 1 within groups, in an order; counted range by range, so no task gathers a group."""
    return running_total(rows.withColumn("__one", F.lit(1)), [by], order, "__one", name).withColumn(name, F.col(name) + 1).drop("__one")


def conditional_label(condition: Column, value: Column, yes: str, no: str) -> Column:
    """yes or no by a true value, only where the condition holds; null elsewhere and for unknown values."""
    return F.when(condition, F.when(value, yes).when(~value, no))


def containing(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows of which any of some columns contains a text, whatever the case; the empty text is in all."""
    asked = text.lower()
    hit = F.lit(asked == "")
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(asked)), F.lit(False))
    return rows.where(hit)


def coverage(rows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Non-null counts, distinct emptiness and constancy of columns: all, and by split."""
    long = rows.select(split, *columns).unpivot([split], columns, "column", "value")
    return long.groupBy("column").agg(F.count("value").alias("n"), *(F.count(F.when(F.col(split) == s, F.col("value"))).alias(f"n_{s}") for s in ("train", "val", "test")), F.count_if(F.col("value").isNull()).alias("empty"), F.coalesce(F.max("value") - F.min("value") < 1e-9, F.lit(True)).alias("constant"))
