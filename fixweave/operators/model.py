"""Random-forest model over the features, and its evaluation as tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixweave.functions.features import FEATURES
from fixweave.operators.dataset import SEED


def train_forest(
    train: DataFrame,
    features: list[str] = FEATURES,
    label: str = "label",
    num_trees: int = 100,
    max_depth: int = 30,
    max_bins: int = 256,
    seed: int = SEED,
    key: list[str] | None = None,
    partitions: int = 8,
) -> PipelineModel:
    """Fit a forest: 100 trees, square-root feature subsets, the deepest trees MLlib grows.

    MLlib draws its samples by the place of a row. With ``key``, which must tell
    rows apart, rows are laid out by it in ``partitions`` first, and the forest is
    the same however the rows came.
    """
    if key:
        train = train.repartition(partitions, *key).sortWithinPartitions(*key)
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=num_trees, maxDepth=max_depth,
        featureSubsetStrategy="sqrt", maxBins=max_bins, seed=seed,
    )
    return Pipeline(stages=[assemble, forest]).fit(train)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` to feature rows.

    A fitted forest holds its training summary, and that the session, which
    tasks cannot take along once counts were observed in it. A copy holds none.
    """
    return model.copy().transform(rows).drop("features", "rawPrediction", "probability")


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: share of right predictions."""
    return predicted.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def classification_report(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means.

    The data is reduced to one count per (label, prediction) first; all else is
    arithmetic on that small table. A ratio with nothing below the line is 0.
    """
    counts = predicted.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count("*").alias("n")
    )
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
    roles = counts.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hits")),
                F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits")),
            )
        )
    )
    sums = roles.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])

    def ratio(top: str, below: str):
        return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(below)), F.lit(0.0))

    rated = sums.withColumn("precision", ratio("hits", "predicted")).withColumn("recall", ratio("hits", "support"))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    rated = rated.withColumn("f1", f1)
    metrics = ["precision", "recall", "f1"]
    classes = rated.select(F.col("class").cast("string").alias("class"), *metrics, "support")
    macro = rated.agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in metrics], F.sum("support").alias("support")
    )
    weighted = rated.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics],
        F.sum("support").alias("support"),
    )
    return classes.unionByName(macro).unionByName(weighted)


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str] = FEATURES) -> DataFrame:
    """Features with their importance, largest first; one row per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(features, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
