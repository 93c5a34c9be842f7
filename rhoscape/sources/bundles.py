"""Model bundles: packed JSON with targets, feature ranges and a data set, and the evaluation of their tree models."""

from __future__ import annotations

import gzip
import json
import lzma
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscape.kernels.shapley import Leaves, contributions
from rhoscape.operators.compare import inverse_transform


@dataclass
class Tree:
    """One regression tree: children below 0 are leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    decision: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    #: Training rows of each node and leaf, where the model says so.
    node_count: np.ndarray = field(default_factory=lambda: np.zeros(0))
    leaf_count: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @cached_property
    def leaves(self) -> Leaves:
        return Leaves(self)

    def goes_left(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether each row of x goes left at its node."""
        value = x[np.arange(len(x)), self.feature[at]]
        missing = np.isnan(value)
        kind = (self.decision[at] >> 2) & 3  # how missing values are treated: 0 as zero, 1 zero is missing, 2 NaN is missing
        value = np.where(missing & (kind != 2), 0.0, value)
        gone = ((kind == 2) & missing) | ((kind == 1) & (np.abs(value) < 1e-35))
        return np.where(gone, (self.decision[at] & 2) > 0, value <= self.threshold[at])

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.leaf[0])
        node, todo = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(todo):
            at = node[todo]
            node[todo] = np.where(self.goes_left(at, x[todo]), self.left[at], self.right[at])
            todo = todo[node[todo] >= 0]
        return self.leaf[~node]


@dataclass
class Booster:
    """A sum of trees read from the text form of gradient-boosting models."""

    features: list[str]
    trees: list[Tree]
    binary: bool = False

    @classmethod
    def parse(cls, text: str) -> "Booster":
        head, *blocks = text.split("\nTree=")
        fields = dict(line.split("=", 1) for line in head.splitlines() if "=" in line)
        trees = []
        for block in blocks:
            own = dict(line.split("=", 1) for line in block.split("\nend of trees")[0].splitlines() if "=" in line)
            numbers = lambda k, t, own=own: np.array(own.get(k, "").split(), t)
            decision = numbers("decision_type", np.int64)
            if (decision & 1).any():
                raise ValueError("categorical splits are not supported")
            trees.append(Tree(numbers("split_feature", np.int64), numbers("threshold", float), decision, numbers("left_child", np.int64), numbers("right_child", np.int64), numbers("leaf_value", float), numbers("internal_count", float), numbers("leaf_count", float)))
        return cls(fields["feature_names"].split(), trees, fields.get("objective", "").startswith("binary"))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return 1.0 / (1.0 + np.exp(-total)) if self.binary else total


    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) Shapley values of the raw output."""
        return sum((contributions(t, x) for t in self.trees), np.zeros((len(x), len(self.features))))


@dataclass
class Target:
    name: str
    task: str
    units: str = ""
    transform: str | None = None
    floor: float | None = None
    features: list[str] = field(default_factory=list)
    booster: str = ""
    metrics: dict = field(default_factory=dict)
    label: str = ""


@dataclass
class Bundle:
    name: str
    features: list[str]
    feature_range: dict[str, tuple[float, float]]
    targets: dict[str, Target]
    dataset: dict | None = None

    def ranges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in self.feature_range.items()], "name string, low double, high double")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The training data set: identity columns, features and targets."""
        d = self.dataset or {"material_id": [], "formula": [], "split": [], "X": [], "y": {}}
        names = [*self.features, *d["y"]]
        made = [(m, f, s, *(float("nan") if v is None else float(v) for v in x), *(float("nan") if v[i] is None else float(v[i]) for v in d["y"].values())) for i, (m, f, s, x) in enumerate(zip(d["material_id"], d["formula"], d["split"], d["X"]))]
        return spark.createDataFrame(made, "material_id string, formula string, split string, " + ", ".join(f"`{n}` double" for n in names))


def parse_bundle(content: bytes) -> Bundle:
    """A bundle from plain, gzip or xz JSON."""
    if content.startswith(b"\x1f\x8b"):
        content = gzip.decompress(content)
    elif content.startswith(b"\xfd7zXZ\x00"):
        content = lzma.decompress(content)
    raw = json.loads(content)
    known = Target.__dataclass_fields__
    targets = {n: Target(name=n, **{k: v for k, v in t.items() if k in known and k != "name"}) for n, t in raw["targets"].items()}
    for t in targets.values():
        t.features = t.features or raw["features"]
    return Bundle(raw["name"], raw["features"], {k: tuple(v) for k, v in raw["feature_range"].items()}, targets, raw.get("dataset"))


def read_bundle(spark: SparkSession, path: str) -> Bundle:
    """A bundle (one bounded model file) through Spark's file source."""
    return parse_bundle(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]))


def predict(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """rows with one column a target: the value in its units, or the probability of the positive class. NaN is allowed."""
    models = rows.sparkSession.sparkContext.broadcast({n: (t.features, Booster.parse(t.booster)) for n, t in bundle.targets.items()})
    names = list(bundle.targets)
    used = list(dict.fromkeys(f for t in bundle.targets.values() for f in t.features))
    kind = ", ".join(f"`{n}`: double" for n in names)

    @F.arrow_udf(f"struct<{kind}>")
    def raw(table: pa.Array) -> pa.Array:
        columns = {f: np.array(table.field(k).to_numpy(zero_copy_only=False), float) for k, f in enumerate(used)}
        out = []
        for n in names:
            features, booster = models.value[n]
            out.append(pa.array(booster.predict(np.stack([columns[f] for f in features], 1))))
        return pa.StructArray.from_arrays(out, names)

    scored = rows.withColumn("__raw", raw(F.struct(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in used))))
    values = [inverse_transform(F.col(f"__raw.{n}"), t.transform, t.floor, t.task == "classification").alias(n) for n, t in bundle.targets.items()]
    return scored.select(*(F.col(c) for c in rows.columns), *values)


def importances(rows: DataFrame, bundle: Bundle, target: str, members: list[str] = ()) -> DataFrame:
    """Mean |Shapley value| of each feature over rows, averaged over a target's boosters (its own, and more members in text
    form), with its share of all; sums by feature are all that is shuffled."""
    spec = bundle.targets[target]
    boosters = rows.sparkSession.sparkContext.broadcast([Booster.parse(text) for text in (spec.booster, *members)])
    names = list(spec.features)

    def run(batches):
        total, n = np.zeros(len(names)), 0
        for batch in batches:
            x = np.stack([np.array(batch.column(k).to_numpy(zero_copy_only=False), float) for k in range(len(names))], 1)
            total += sum(np.abs(b.contributions(x)).sum(0) for b in boosters.value) / len(boosters.value)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array([n] * len(names), pa.int64())], ["feature", "total", "n"])

    read = rows.select(*(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))).alias(f) for f in names))
    means = read.mapInArrow(run, "feature string, total double, n bigint").groupBy("feature").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean_abs"))
    whole = means.agg(F.sum("mean_abs").alias("__all"))  # one row
    return means.join(F.broadcast(whole)).select("feature", "mean_abs", F.coalesce(F.try_divide(F.col("mean_abs"), F.col("__all")), F.lit(0.0)).alias("share"))


def leading(ranked: DataFrame, top: int = 10) -> DataFrame:
    """The features with the largest shares (a row a feature, so few)."""
    return ranked.orderBy(F.desc("share"), "feature").limit(top)
