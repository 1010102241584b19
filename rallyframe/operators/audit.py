"""Checks that features know nothing of the outcome or of the future."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import settled
from .reduce import aggregated, imputed, medians, moments


def label_correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, corr (absolute, medians filled), largest first; features of one value or fewer than five values are left out."""
    seen = aggregated(df, {f"{c}\t{k}": e for c in features for k, e in (("n", F.count(c)), ("low", F.min(c)), ("high", F.max(c)))})
    use = [c for c in features if seen[f"{c}\tn"] >= 5 and seen[f"{c}\tlow"] != seen[f"{c}\thigh"]]
    full = imputed(df.select(*use, F.col(label).cast("double").alias("_label")), medians(df, use)) if use else df
    found = moments(full, [*use, "_label"]).correlation() if use else None
    return df.sparkSession.createDataFrame([(c, abs(float(found[i, -1])) if np.isfinite(found[i, -1]) else None) for i, c in enumerate(use)], "feature string, corr double").orderBy(F.desc("corr"), "feature")


def suspects(correlations: DataFrame, threshold: float = 0.95) -> DataFrame:
    return correlations.filter(F.col("corr") > threshold)


def key_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """The keys of test that train has too."""
    return test.select(key).distinct().join(train.select(key).distinct(), key, "left_semi")


def temporal_split(df: DataFrame, split: str, date: str) -> DataFrame:
    """train_end, test_start, ordered: whether all of train lies before all of test."""
    found = df.agg(F.max(F.when(F.col(split) == "train", F.col(date))).alias("train_end"), F.min(F.when(F.col(split) == "test", F.col(date))).alias("test_start"))
    return found.withColumn("ordered", F.col("train_end") < F.col("test_start"))


def ks_statistics(df: DataFrame, features: Sequence[str], second: str) -> DataFrame:
    """feature, n1, n2, d of all features at once: two-sample Kolmogorov-Smirnov statistics; `second` tells (boolean) the sample.

    Values are counted by feature first. The counts are dealt to ranges of feature and value, the sums of a feature's
    ranges say where each range begins, and running sums stay within a range, so no task holds a feature and the number of
    jobs is the same for any number of features.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features))))
    counts = df.select(F.col(second).alias("_second"), cells.alias("_c")).select("_second", "_c.*").filter("v is not null").groupBy("f", "v").agg(F.sum((~F.col("_second")).cast("long")).alias("a"), F.sum(F.col("_second").cast("long")).alias("b"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(counts.repartitionByRange(parts, "f", "v").withColumn("r", F.spark_partition_id()))
    totals = ranged.groupBy("f", "r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))  # a row a feature and range that has it
    over, whole = Window.partitionBy("f").orderBy("r").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("f")
    bases = totals.select("f", "r", *(F.coalesce(F.sum(f"r{x}").over(over), F.lit(0)).alias(f"base_{x}") for x in "ab"), F.sum("ra").over(whole).alias("n1"), F.sum("rb").over(whole).alias("n2"))
    within = Window.partitionBy("f", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.select("f", "r", F.sum("a").over(within).alias("a"), F.sum("b").over(within).alias("b")).join(bases, ["f", "r"])
    share = lambda x, n: (F.col(f"base_{x}") + F.col(x)) / F.greatest(F.col(n), F.lit(1)).cast("double")
    found = placed.groupBy("f").agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(F.abs(share("a", "n1") - share("b", "n2"))).alias("d"))
    return found.select(F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1).alias("feature"), "n1", "n2", "d")


def ks_statistic(df: DataFrame, value: str, second: str) -> DataFrame:
    """n1, n2, d of one column."""
    return ks_statistics(df, [value], second).select("n1", "n2", "d")


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Kolmogorov's series."""
    n = n1 * n2 / (n1 + n2)
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


# What a feature's two samples are called.
SAME, OTHER = "similar", "distinta"


def drift(train: DataFrame, test: DataFrame, features: Sequence[str], alpha: float = 0.001) -> DataFrame:
    """feature, d, p, verdict of features that each side has ten values of; all features in the same jobs."""
    there = [c for c in features if c in train.columns and c in test.columns]
    rows = []
    if there:
        both = train.select(*there, F.lit(False).alias("_second")).union(test.select(*there, F.lit(True).alias("_second")))
        found = {r["feature"]: r for r in ks_statistics(both, there, "_second").collect()}  # a row a feature
        for c in there:
            if c in found and min(found[c]["n1"], found[c]["n2"]) >= 10:
                p = ks_p_value(found[c]["d"], found[c]["n1"], found[c]["n2"])
                rows.append((c, found[c]["d"], p, OTHER if p < alpha else SAME))
    return train.sparkSession.createDataFrame(rows, "feature string, d double, p double, verdict string")
