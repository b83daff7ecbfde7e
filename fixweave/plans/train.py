"""Training run: from function pairs to a model and its reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from fixweave.operators.dataset import (
    build_features, dataset_summary, drop_blank_code, drop_empty_pairs, label_pairs, stratified_split,
)
from fixweave.operators.model import accuracy, classification_report, feature_importance, predict, train_forest
from fixweave.session import staged


@dataclass
class TrainingRun:
    model: PipelineModel
    predicted: DataFrame
    summary: DataFrame
    accuracy: DataFrame
    report: DataFrame
    importance: DataFrame


def training_rows(pairs: DataFrame, *key: str) -> DataFrame:
    """Labelled feature rows of code pairs; ``key`` names the columns that identify a pair."""
    return build_features(drop_blank_code(label_pairs(drop_empty_pairs(pairs), *key)))


def train(pairs: DataFrame, key: list[str], **forest) -> TrainingRun:
    """Split, fit and evaluate. Features are computed once and stored without the code."""
    rows = staged(training_rows(pairs, *key).drop("code"), "features")
    split = staged(stratified_split(rows, "label", [*key, "label"]), "split")
    model = train_forest(split.where("NOT is_test"), key=[*key, "label"], **forest)
    predicted = predict(model, split.where("is_test"))
    return TrainingRun(
        model, predicted, dataset_summary(rows), accuracy(predicted), classification_report(predicted),
        feature_importance(rows.sparkSession, model),
    )
