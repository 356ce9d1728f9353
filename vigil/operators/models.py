"""Probability of health from supervised models, trained with MLlib."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train(rows: DataFrame, names: list[str], kind: str = "forest", seed: int = 42, trees: int = 100) -> PipelineModel:
    """Scales the features and fits on fault = (label > 0).

    Rows of one class alone give a model that knows no other. Rows with a feature that is null or not finite aren't
    learned from; without any other row there is nothing to fit, and a ValueError.
    """
    # the two classes are named here, so that a fit doesn't depend on which of them the rows hold
    fault = (F.col("label") > 0).cast("double").alias("fault", metadata={"ml_attr": {"name": "fault", "type": "nominal", "vals": ["0", "1"]}})
    rows = rows.where(known_features(names)).select(*[c for c in rows.columns if c != "fault"], fault)
    if rows.isEmpty():
        raise ValueError("training needs a row whose features are all known")
    if kind == "forest":
        model = RandomForestClassifier(featuresCol="scaled", labelCol="fault", numTrees=trees, maxDepth=12, seed=seed)
    else:
        model = GBTClassifier(featuresCol="scaled", labelCol="fault", maxIter=trees, maxDepth=5, stepSize=0.3, seed=seed)
    vector = VectorAssembler(inputCols=names, outputCol="vector", handleInvalid="keep")
    return Pipeline(stages=[vector, StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), model]).fit(rows)


def known_features(names: list[str]) -> Column:
    """Every feature is a finite number."""
    return reduce(and_, [F.coalesce(F.abs(F.col(x)) < float("inf"), F.lit(False)) for x in names])


def healthy_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds health, the probability of the healthy class; null where a feature is null or not finite."""
    known = known_features(model.stages[0].getInputCols())
    return model.transform(rows).withColumn("health", F.when(known, vector_to_array("probability")[0])).drop("vector", "scaled", "rawPrediction", "probability", "prediction")


def stratified_split(rows: DataFrame, share: float = 0.8, seed: int = 42, key: str = "win_no", label: str = "label") -> DataFrame:
    """Adds train: the given share of each label, by the order of a hash."""
    from pyspark.sql import Window

    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(F.xxhash64(key, F.lit(seed)), key))
    return rows.withColumn("train", rank <= F.floor(F.count("*").over(w) * share + 0.5))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: n and the share of rows whose health of one half or more agrees with label 0. Rows without either value don't count."""
    known = rows.where(F.col("health").isNotNull() & F.col("label").isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(((F.col("health") >= 0.5) == (F.col("label") == 0)).cast("double")).alias("accuracy"))


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined, from one count of (label, predicted)."""
    c = confusion(rows)
    sides = c.select(F.col("label").alias("class"), "n", (F.col("label") == F.col("predicted")).alias("hit"), F.lit("label").alias("side"))
    sides = sides.union(c.select("predicted", "n", F.col("label") == F.col("predicted"), F.lit("predicted")))
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")
    t = sides.groupBy("class").agg(s((F.col("side") == "label") & F.col("hit")).alias("tp"), s(F.col("side") == "label").alias("actual"), s(F.col("side") == "predicted").alias("guessed"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("guessed"))).withColumn("recall", ratio(F.col("tp"), F.col("actual")))
    return t.select("class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.col("actual").cast("long").alias("support"))
