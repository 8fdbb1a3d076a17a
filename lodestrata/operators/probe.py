"""Linear probe: how well a simple model reads a class from feature vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z95_EXACT, binomial_tail, wilson


def folds(rows: DataFrame, k: int, seed: int | str, cls: str, key: str) -> DataFrame:
    """Stratified folds: each class is dealt out in hash order."""
    order = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy(cls).orderBy(order, key)) - 1) % k)


def predictions(rows: DataFrame, cls: str, features: str, key: str, k: int = 5, components: int = 256, seed: int | str = 0, iterations: int = 50) -> DataFrame:
    """(key, cls, predicted, correct) out of fold: scale, reduce, logistic regression."""
    dim = rows.select(F.size(features).alias("n")).first()["n"]
    vec = folds(rows, k, seed, cls, key).withColumn("__x", array_to_vector(features)).withColumn("__y", F.col(cls).cast("string")).persist()
    out = None
    for f in range(k):
        steps = [StringIndexer(inputCol="__y", outputCol="__label", handleInvalid="keep"), StandardScaler(inputCol="__x", outputCol="__s", withMean=True), PCA(k=min(components, dim), inputCol="__s", outputCol="__p"), LogisticRegression(featuresCol="__p", labelCol="__label", maxIter=iterations)]
        model = Pipeline(stages=steps).fit(vec.where(F.col("fold") != f))
        names = F.array(*map(F.lit, model.stages[0].labels))
        done = model.transform(vec.where(F.col("fold") == f))
        part = done.select(key, cls, F.get(names, F.col("prediction").cast("int")).alias("predicted")).withColumn("correct", F.col("predicted") == F.col(cls).cast("string"))
        out = part if out is None else out.unionByName(part)
    return out


def accuracy(pred: DataFrame, cls: str) -> DataFrame:
    """n, accuracy with its interval, balanced accuracy, and the p against chance."""
    per = pred.groupBy(cls).agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    all_ = per.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("classes"), F.avg(F.col("k") / F.col("n")).alias("balanced_accuracy"))
    w = wilson(F.col("k"), F.col("n"), Z95_EXACT)
    return all_.select("n", "classes", (F.col("k") / F.col("n")).alias("accuracy"), w["low"].alias("low"), w["high"].alias("high"), "balanced_accuracy", binomial_tail(F.col("k"), F.col("n"), 1.0 / F.col("classes")).alias("p_vs_chance"))
