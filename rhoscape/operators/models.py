"""Property models: imputed and standardised linear models, forests and boosted trees, and the scoring of new rows."""

from __future__ import annotations

import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscape.operators.compare import forward_transform, inverse_transform
from rhoscape.operators.metrics import classification_scores

#: Penalties tried on the validation rows.
PENALTIES = [10.0**k for k in range(-6, 7)]


#: Seeds of a study, trees of a forest, and rounds and trials of boosting.
SEEDS, TREES, ROUNDS, TRIALS = (0, 1, 2, 3, 4), 500, 500, 40
#: Rows that stop boosting early are marked by this column.
HELD = "__held"


def _estimator(kind: str, classification: bool, seed: int, settings: dict):
    shared = {"featuresCol": "features", "labelCol": "__y"}
    if kind == "linear":
        return LogisticRegression(**shared, **settings) if classification else LinearRegression(**shared, elasticNetParam=0.0, **settings)
    if kind == "forest":
        made = RandomForestClassifier if classification else RandomForestRegressor
        return made(**shared, seed=seed, **({"numTrees": TREES, "maxDepth": 8, "featureSubsetStrategy": "sqrt" if classification else "onethird"} | settings))
    made = GBTClassifier if classification else GBTRegressor
    return made(**shared, seed=seed, **({"maxIter": 30, "maxDepth": 4} | settings))


def pipeline(kind: str, columns: list[str], classification: bool = False, seed: int = 0, **settings) -> Pipeline:
    """Median imputation, standardisation and a model; settings are the model's own."""
    filled = [f"__{c}" for c in columns]
    return Pipeline(stages=[Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="features", withMean=True), _estimator(kind, classification, seed, settings)])


def fit(train: DataFrame, columns: list[str], target: str, kind: str = "linear", transform: str | None = None, classification: bool = False, seed: int = 0, held: DataFrame | None = None, **settings) -> PipelineModel:
    """A fitted pipeline; with held rows, boosting stops where these no longer gain, as the settings say."""
    y = F.col(target).cast("double")
    rows = train if held is None else train.withColumn(HELD, F.lit(False)).unionByName(held.withColumn(HELD, F.lit(True)))
    ready = rows.where(y.isNotNull()).withColumn("__y", y if classification else forward_transform(y, transform))
    return pipeline(kind, columns, classification, seed, **(settings if held is None else {"validationIndicatorCol": HELD} | settings)).fit(ready)


def predict(model: PipelineModel, rows: DataFrame, name: str = "prediction", transform: str | None = None, floor: float | None = None, classification: bool = False) -> DataFrame:
    """rows with the prediction in the target's units, or the probability of the positive class."""
    made = model.transform(rows)
    z = vector_to_array("probability")[1] if classification else F.col("prediction")
    return made.select(*rows.columns, inverse_transform(z, transform, floor, classification).alias(name))


def loss(model: PipelineModel, rows: DataFrame, target: str, transform: str | None = None, classification: bool = False) -> float:
    """Log loss, or the root mean square error of the transformed target, over rows that have one."""
    known = rows.where(F.col(target).isNotNull()).withColumn("__all", F.lit(1))
    if classification:
        return classification_scores(predict(model, known, "__p", None, None, True), target, "__p", ["__all"]).first()["logloss"]
    scored = predict(model, known.withColumn("__z", forward_transform(F.col(target).cast("double"), transform)), "__p")
    return scored.agg(F.sqrt(F.avg((F.col("__p") - F.col("__z")) ** 2)).alias("loss")).first()["loss"]


def tuned(train: DataFrame, validation: DataFrame, columns: list[str], target: str, transform: str | None = None, classification: bool = False) -> PipelineModel:
    """A linear model with the penalty that does best on the validation rows."""
    tried = [fit(train, columns, target, "linear", transform, classification, regParam=penalty) for penalty in PENALTIES]
    return min(tried, key=lambda m: loss(m, validation, target, transform, classification))


def drawn(rng: random.Random) -> dict:
    """Boosting settings from the ranges that are searched."""
    log = lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high)))
    return {"stepSize": log(0.01, 0.1), "maxDepth": round(math.log2(log(7, 127) + 1)), "minInstancesPerNode": round(log(5, 100)), "featureSubsetStrategy": f"{rng.uniform(0.3, 1.0):.3f}", "subsamplingRate": rng.uniform(0.5, 1.0)}


def searched(train: DataFrame, validation: DataFrame, columns: list[str], target: str, transform: str | None = None, classification: bool = False, trials: int = TRIALS, rounds: int = ROUNDS) -> dict:
    """The boosting settings, of so many drawn ones, that do best on the validation rows; boosting stops early on these."""
    rng = random.Random(0)
    tried = [drawn(rng) | {"maxIter": rounds, "validationTol": 1e-3} for _ in range(trials)]
    return min(tried, key=lambda s: loss(fit(train, columns, target, "boosted", transform, classification, 0, validation, **s), validation, target, transform, classification))


def study(train: DataFrame, validation: DataFrame, test: DataFrame, key: str, columns: list[str], target: str, transform: str | None = None, floor: float | None = None, classification: bool = False, seeds: tuple[int, ...] = SEEDS, trees: int = TREES, trials: int = TRIALS, rounds: int = ROUNDS) -> DataFrame:
    """Test predictions (key, model, seed, prediction) of a tuned linear model, forests and boosted trees of every seed, and
    the boosted trees' mean before it is transformed back (seed -1)."""
    rows = test.where(F.col(target).isNotNull())
    made = [predict(tuned(train, validation, columns, target, transform, classification), rows, "prediction", transform, floor, classification).select(key, F.lit("linear").alias("model"), F.lit(0).alias("seed"), "prediction")]
    best = searched(train, validation, columns, target, transform, classification, trials, rounds)
    raw: list[DataFrame] = []
    for seed in seeds:
        forest = fit(train, columns, target, "forest", transform, classification, seed, numTrees=trees)
        made.append(predict(forest, rows, "prediction", transform, floor, classification).select(key, F.lit("forest").alias("model"), F.lit(seed).alias("seed"), "prediction"))
        boosted = fit(train, columns, target, "boosted", transform, classification, seed, validation, **best)
        raw.append(predict(boosted, rows, "prediction", None, None, classification))
        made.append(raw[-1].select(key, F.lit("boosted").alias("model"), F.lit(seed).alias("seed"), inverse_transform(F.col("prediction"), transform, floor, classification).alias("prediction")))
    made.append(ensemble(raw, key).select(key, F.lit("boosted").alias("model"), F.lit(-1).alias("seed"), inverse_transform(F.col("prediction"), transform, floor, classification).alias("prediction")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def ensemble(predictions: list[DataFrame], key: str, name: str = "prediction") -> DataFrame:
    """Mean prediction over seeds."""
    out = predictions[0].select(key, name)
    for more in predictions[1:]:
        out = out.unionByName(more.select(key, name))
    return out.groupBy(key).agg(F.avg(name).alias(name))
