"""Classifiers with the reference parameters: comparison, search, calibration and voting."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parallel import WIDTH, concurrently
from ..functions.scratch import settled
from . import metrics
from .boosting import HistogramBoosting
from .validate import evaluate, folds_of, scored, scored_as

#: The searched parameters: rounds, depth, step, rows sampled, columns sampled.
GRID = {"rounds": [100, 200, 300], "depth": [4, 6, 8], "step": [0.05, 0.1, 0.2], "rows": [0.8, 0.9], "columns": [0.5, 0.8]}
#: What the search holds fixed.
SEARCHED = HistogramBoosting(l1=0.3, l2=1.0, min_child_weight=3.0)


def candidates(n_rows: int, scale: float = 1.0) -> dict[str, Estimator]:
    """The compared models; scale shrinks their numbers of trees."""
    few = lambda n: max(2, int(n * scale))
    return {
        "boosted_base": HistogramBoosting(rounds=few(100), depth=6, step=0.1),
        "random_forest": RandomForestClassifier(numTrees=few(100), maxDepth=5, seed=42),
        "gradient_boosting": GBTClassifier(maxIter=few(50), maxDepth=4, stepSize=0.1, seed=42),
        "logistic_regression": LogisticRegression(maxIter=max(10, int(5500 * scale)), regParam=1.0 / max(1, n_rows)),
        "decision_tree": DecisionTreeClassifier(maxDepth=15 if scale == 1 else 5, seed=42),
        "naive_bayes": NaiveBayes(modelType="gaussian"),
    }


def compare(train: DataFrame, test: DataFrame, estimators: dict[str, Estimator]) -> DataFrame:
    """model, accuracy, auc; best accuracy first. Models are fitted side by side on rows kept for them."""
    train, test = settled(train), settled(test)

    def tried(name: str) -> tuple:
        found = evaluate(estimators[name].fit(train), test)
        return name, found["accuracy"], found["auc"]

    return train.sparkSession.createDataFrame(concurrently(tried, estimators), "model string, accuracy double, auc double").orderBy(F.desc("accuracy"), "model")


def with_parameters(estimator: Estimator | HistogramBoosting, values: dict) -> Estimator | HistogramBoosting:
    return estimator.copy(values) if isinstance(estimator, HistogramBoosting) else estimator.copy({estimator.getParam(n): v for n, v in values.items()})


def grid_search(folded: DataFrame, k: int, estimator: Estimator | HistogramBoosting = SEARCHED, grid: dict[str, Sequence] = GRID, width: int = WIDTH) -> DataFrame:
    """One row a combination: its parameters (text) and mean log-loss over expanding folds (a table with _fold), best first.

    The folded rows are written once for all trials; `width` trials, each a combination and a fold, run side by side.
    """
    folds = list(folds_of(settled(folded), k))
    combinations = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    trials = [(c, train, test) for c in combinations for train, test in folds]
    losses = concurrently(lambda t: evaluate(with_parameters(estimator, t[0]).fit(t[1]), t[2])["logloss"], trials, width)
    rows = [(", ".join(f"{n}={v}" for n, v in c.items()), float(sum(losses[i * k : (i + 1) * k]) / k)) for i, c in enumerate(combinations)]
    return folded.sparkSession.createDataFrame(rows, "parameters string, logloss double").orderBy("logloss", "parameters")


def calibrate(folded: DataFrame, k: int, estimator: Estimator) -> list[tuple[Model, IsotonicRegressionModel]]:
    """For each expanding fold, a model and the isotonic map of its scores on the fold; folds run side by side."""

    def fold(parts: tuple[DataFrame, DataFrame]) -> tuple[Model, IsotonicRegressionModel]:
        model = estimator.fit(parts[0])
        own = scored(model, parts[1]).select("label", F.col("p").alias("features_p"))
        return model, IsotonicRegression(featuresCol="features_p", labelCol="label").fit(own)

    return concurrently(fold, folds_of(settled(folded), k))


def _mean(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return df.select(key, "label", (sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).alias("p"))


def calibrated(models: list[tuple[Model, IsotonicRegressionModel]], df: DataFrame, key: str) -> DataFrame:
    """key, label, p: the mean of the maps, in one pass over the rows."""
    for i, (model, iso) in enumerate(models):
        df = scored_as(model, df, f"_score{i}")
        df = iso.transform(df, {iso.getParam("featuresCol"): f"_score{i}", iso.getParam("predictionCol"): f"_p{i}"})
    return _mean(df, key, [f"_p{i}" for i in range(len(models))])


def vote(models: Sequence[Model], df: DataFrame, key: str) -> DataFrame:
    """key, label, p: the mean probability of all models, in one pass over the rows."""
    for i, model in enumerate(models):
        df = scored_as(model, df, f"_p{i}")
    return _mean(df, key, [f"_p{i}" for i in range(len(models))])


def summary(scores: DataFrame) -> DataFrame:
    """accuracy, logloss, brier of p against label."""
    p, y = F.col("p"), F.col("label")
    return scores.agg(metrics.accuracy(p, y).alias("accuracy"), metrics.log_loss(p, y).alias("logloss"), metrics.brier(p, y).alias("brier"))
