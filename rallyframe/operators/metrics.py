"""Exact metrics of scores against labels of 0 and 1, as aggregations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import settled


def in_ranges(values: DataFrame, column: str, name: str = "r", n: int = 1000) -> DataFrame:
    """Adds the range of a column of distinct values: about n ranges of equal numbers of values, whatever their spread."""
    edges = values.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n)).first()[0]
    splits = [-float("inf"), *sorted(set(edges or [0.0])), float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(values)


def auc(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """auc: the share of pairs of a 1 and a 0 that the score orders rightly, ties by half. weight: how often a row counts.

    Scores are counted first, so only distinct scores are ranked.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(w * F.col(label).cast("long")).alias("p"), F.sum(w * (1 - F.col(label).cast("long"))).alias("n"))
    # A running count over ranges of scores: sums of the ranges, then within each.
    ranged = in_ranges(counts, "s")
    totals = ranged.groupBy("r").agg(F.sum("n").alias("rn"))
    before = totals.select("r", F.coalesce(F.sum("rn").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("below", below).join(F.broadcast(before), "r")
    return placed.agg((F.sum(F.col("p") * (F.col("before") + F.col("below") + F.col("n") / 2.0)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def aucs(df: DataFrame, by: str, score: str, label: str, weight: str) -> DataFrame:
    """by, auc of each group of rows (say, of each model's scores), all in the same jobs; ranges of group and score as in audit.ks_statistics."""
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(by).alias("g"), F.col(score).cast("double").alias("s"))
    counts = counts.agg(F.sum(F.col(weight) * F.col(label)).alias("p"), F.sum(F.col(weight) * (1 - F.col(label))).alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(counts.repartitionByRange(parts, "g", "s").withColumn("r", F.spark_partition_id()))
    before = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("g", "r").agg(F.sum("n").alias("rn")).select("g", "r", F.coalesce(F.sum("rn").over(before), F.lit(0.0)).alias("base"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("g", "r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = ranged.withColumn("below", below).join(bases, ["g", "r"])
    return placed.groupBy(F.col("g").alias(by)).agg(F.try_divide(F.sum(F.col("p") * (F.col("base") + F.col("below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def log_loss(score: Column, label: Column, eps: float = 1e-15) -> Column:
    """An aggregate: the mean negative log likelihood of clipped probabilities."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return F.avg(-(label * F.log(p) + (1 - label) * F.log(1 - p)))


def brier(score: Column, label: Column) -> Column:
    return F.avg(F.pow(score - label, F.lit(2.0)))


def accuracy(score: Column, label: Column, cut: float = 0.5) -> Column:
    return F.avg(((score >= cut).cast("int") == label).cast("double"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("target"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


# What the ranges of confidence are called.
CONFIDENCE = ("Baja", "Media", "Alta")


def confidence_bins(df: DataFrame, score: str, label: str, predicted: str, names: tuple[str, str, str] = CONFIDENCE) -> DataFrame:
    """bin, n, accuracy for scores in (0, .3], (.3, .7], (.7, 1]; empty bins stay, other scores have no bin."""
    s = F.col(score)
    own = F.when((s > 0) & (s <= 0.3), names[0]).when((s > 0.3) & (s <= 0.7), names[1]).when((s > 0.7) & (s <= 1), names[2])
    found = df.withColumn("bin", own).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))
    bins = df.sparkSession.createDataFrame([(n,) for n in names], "bin string")
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def cumulative_share(df: DataFrame, name: str, value: str) -> DataFrame:
    """Each row's share of the total and the running share, largest first. For tables of one row a feature."""
    total = F.sum(value).over(Window.partitionBy())
    running = F.sum(value).over(Window.orderBy(F.desc(value), name).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(name, value, (F.col(value) / total).alias("share"), (running / total).alias("cumulative"))


def features_for(df: DataFrame, share: float) -> int:
    """How many of the largest make up the share (of a cumulative_share table)."""
    return df.filter(F.col("cumulative") <= share).count() + 1
