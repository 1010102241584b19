"""Resampling and time-ordered validation of classifiers.

A model is any pyspark.ml estimator over the columns features and label that yields probability.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns
from ..functions.parallel import concurrently
from ..functions.scratch import settled, stored
from . import metrics
from .audit import label_correlations
from .boosting import BoostedTrees, HistogramBoosting


def _numbers(df: DataFrame, features: Sequence[str], label: str, *keep: str) -> DataFrame:
    """The features as doubles (missing columns and nulls as 0), label."""
    return df.select(*keep, *((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in features), F.col(label).cast("double").alias("label"))


def assembled(df: DataFrame, features: Sequence[str], label: str, *keep: str) -> DataFrame:
    """features (a vector, missing columns and nulls as 0), label."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(_numbers(df, features, label, *keep)).select(*keep, "features", "label")


def scored(model: Model, df: DataFrame) -> DataFrame:
    """label, p, and what else is there."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def scored_as(model: Model, df: DataFrame, name: str) -> DataFrame:
    """df with the model's chance of a 1 as `name`; no other column is added, so that models can follow one another over the same rows."""
    if isinstance(model, BoostedTrees):
        return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("probability")
    own = {model.getParam(p): f"_{p}_{name}" for p in ("rawPredictionCol", "probabilityCol", "predictionCol")}
    return model.transform(df, own).withColumn(name, vector_to_array(f"_probabilityCol_{name}")[1]).drop(*own.values())


def evaluate(model: Model, df: DataFrame) -> dict[str, float]:
    rows = scored(model, df).select("p", "label").persist()
    try:
        p, y = F.col("p"), F.col("label")
        found = rows.agg(metrics.accuracy(p, y).alias("accuracy"), metrics.log_loss(p, y).alias("logloss"), metrics.brier(p, y).alias("brier")).first().asDict()
        return found | {"auc": metrics.auc(rows, "p", "label").first()["auc"]}
    finally:
        rows.unpersist()


# -- resampling


def sample_rows(df: DataFrame, n: int, key: str, seed: str = "sample") -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key).limit(n)


def dense_ids(df: DataFrame, order: Sequence, name: str = "_row") -> DataFrame:
    """Adds 0, 1, ... in the order given: places within ranges plus the ranges' offsets, so no task sorts all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    shift = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(shift.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    base, total = [], 0
    for p in sorted(sizes):
        base.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(base, "_p long, _base long")
    return dealt.withColumn("_p", shift).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_base", "_id")


def bootstrap_draws(n: int, draws: int, spark, seed: str = "bootstrap") -> DataFrame:
    """draw, row: for each draw a row number between 0 and n - 1, hashed from the seed (with replacement)."""
    word = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    return spark.range(draws).select(F.col("id").alias("draw"), (word % F.lit(n)).alias("row"))


def bootstrap(df: DataFrame, key: str, draws: int | None = None, seed: str = "bootstrap") -> DataFrame:
    """Exactly `draws` rows (default: as many as there are) with replacement, with their draw number."""
    return drawn_of(numbered(df, key), draws, seed)


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The rows with their numbers, and how many there are: any number of bootstrap samples are drawn from these."""
    rows = dense_ids(df, [F.col(key)], "row")
    return rows, rows.count()


def drawn_of(rows: tuple[DataFrame, int], draws: int | None, seed: str) -> DataFrame:
    return bootstrap_draws(rows[1], draws or rows[1], rows[0].sparkSession, seed).join(rows[0], "row").drop("row")


#: Rows whose draws are counted in one group (a place there has two bytes), and draws that are hashed at once.
BLOCK, HASHED = 1 << 16, 1 << 19


def _places(seed: str, n: int) -> callable:
    """Spans of draws to block, sample, rest, places: two bytes, the row's place in its block, for each draw of the span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, rest, low, high in zip(*(batch.column(c).to_pylist() for c in ("sample", "rest", "low", "high")), strict=True):
                prefix = f"{seed}{sample}:".encode()
                digests = b"".join([md5(b"%s%d" % (prefix, i), usedforsecurity=False).digest() for i in range(low, high)])
                rows = np.sort(np.frombuffer(digests, ">u4")[::4].astype(np.int64) % n)
                blocks, starts = np.unique(rows // BLOCK, return_index=True)
                ends = np.append(starts, len(rows)).astype(np.int32) * 2
                places = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends), pa.py_buffer((rows % BLOCK).astype("<u2"))])
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(np.full(len(blocks), sample, np.int32)), pa.array(np.full(len(blocks), rest)), places], ["block", "sample", "rest", "places"])

    return run


def _counted(names: dict[tuple[int, bool], str]) -> callable:
    """A block's rows and its places to its rows with how often each sample's part (sample, rest) has them."""

    def run(rows: pa.Table, cells: pa.Table) -> pa.Table:
        at = rows.column("row").to_numpy() % BLOCK
        times = {own: np.zeros(BLOCK, np.int32) for own in names}
        for sample, rest, places in zip(*(cells.column(c).to_pylist() for c in ("sample", "rest", "places")), strict=True):
            times[sample, rest] += np.bincount(np.frombuffer(places, "<u2"), minlength=BLOCK).astype(np.int32)
        out = rows.drop_columns(["row", "block"])
        for own, name in names.items():
            out = out.append_column(name, pa.array(times[own][at]))
        return out

    return run


def multiplicities(df: DataFrame, key: str, samples: int, draws: int | None = None, cut: int | None = None, seed: str = "bootstrap") -> tuple[DataFrame, int, int]:
    """The rows with how often each sample i has them among its first `cut` draws (_first<i>) and among the rest (_rest<i>); draws and cut.

    Sample i has the rows that `bootstrap` draws by the seed with i behind it. Spans of draws are hashed in tasks of their
    own, and what is shuffled is two bytes a draw, by blocks of rows; each row is kept once, however many samples there
    are, and who reads one sample reads its columns alone.
    """
    rows, n = numbered(df, key)
    draws = n if draws is None else draws
    cut = draws if cut is None else cut
    spark = df.sparkSession
    names = {(i, rest): f"_{'rest' if rest else 'first'}{i}" for rest in ((False, True) if cut < draws else (False,)) for i in range(samples)}
    head, every = -(-cut // HASHED), -(-cut // HASHED) + -(-(draws - cut) // HASHED)
    number = samples * every if n else 0
    spans = spark.range(0, number, 1, max(1, min(number, int(spark.conf.get("spark.sql.shuffle.partitions"))))).select(F.expr(f"cast(id div {max(1, every)} as int)").alias("sample"), F.expr(f"id % {max(1, every)}").alias("j"))
    spans = spans.withColumn("rest", F.col("j") >= head).withColumn("low", F.when(F.col("rest"), cut + (F.col("j") - head) * HASHED).otherwise(F.col("j") * HASHED))
    spans = spans.select("sample", "rest", "low", F.least(F.col("low") + HASHED, F.when(F.col("rest"), F.lit(draws)).otherwise(F.lit(cut)).cast("long")).alias("high"))
    cells = spans.mapInArrow(_places(seed, max(1, n)), "block long, sample int, rest boolean, places binary")
    blocked = rows.withColumn("block", F.expr(f"cast(row div {BLOCK} as long)"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "row"), *(T.StructField(name, T.IntegerType()) for name in names.values())])
    return stored(blocked.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(_counted(names), schema)), draws, cut


def weighted(rows: DataFrame, sample: int, part: str) -> DataFrame:
    """The rows of a sample's part (first or rest), with how often it has them as _w."""
    own = f"_{part}{sample}"
    kept = [c for c in rows.columns if not c.startswith(("_first", "_rest"))]
    return rows.select(*kept, (F.col(own).cast("double") if own in rows.columns else F.lit(0.0)).alias("_w")).filter("_w > 0")


def permuted(df: DataFrame, key: str, column: str, seed: str) -> DataFrame:
    """The column's values dealt to other rows: rows in order of key get the values in order of a seeded hash."""
    here = dense_ids(df, [F.col(key)], "_at")
    there = dense_ids(df.select(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))).alias("_h"), F.col(key).alias("_k"), F.col(column).alias("_new")), [F.col("_h"), F.col("_k")], "_at").select("_at", "_new")
    return here.join(there, "_at").withColumn(column, F.col("_new")).drop("_at", "_new")


# -- splits in time


def temporal_windows(df: DataFrame, date: str, n_splits: int = 5, test_months: int = 3, least_train: int = 1000, least_test: int = 100) -> DataFrame:
    """split, train_end, test_end, train_size, test_size: a cut every six months, and the test_months after it."""
    spark = df.sparkSession
    span = df.agg(F.min(F.to_date(date)).alias("low"), F.max(F.to_date(date)).alias("high"))
    cuts = spark.range(1, n_splits + 1).select(F.col("id").cast("int").alias("split")).crossJoin(span)
    cuts = cuts.select("split", "high", F.add_months("low", 6 * F.col("split")).alias("train_end")).withColumn("test_end", F.add_months("train_end", test_months)).filter("test_end <= high")
    days = df.groupBy(F.to_date(date).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    sized = F.broadcast(cuts).join(days, F.col("d") < F.col("test_end")).groupBy("split", "train_end", "test_end")
    sized = sized.agg(F.sum(F.when(F.col("d") < F.col("train_end"), F.col("n")).otherwise(0)).alias("train_size"), F.sum(F.when(F.col("d") >= F.col("train_end"), F.col("n")).otherwise(0)).alias("test_size"))
    return sized.filter((F.col("train_size") >= least_train) & (F.col("test_size") >= least_test))


def expanding_folds(df: DataFrame, order: Sequence, k: int = 5) -> DataFrame:
    """Adds _fold: 0 for the rows that only train, then 1..k; fold i is tested on what lies before it. Every test fold has n // (k + 1) rows."""
    rows = dense_ids(df, order)
    n = rows.count()
    size = max(1, n // (k + 1))
    first = n - k * size
    return rows.withColumn("_fold", F.when(F.col("_row") < first, 0).otherwise(F.floor((F.col("_row") - first) / size) + 1).cast("int")).drop("_row")


def folds_of(df: DataFrame, k: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    for i in range(1, k + 1):
        yield df.filter(F.col("_fold") < i), df.filter(F.col("_fold") == i)


def temporal_validation(df: DataFrame, features: Sequence[str], label: str, date: str, estimator: Estimator, **how) -> DataFrame:
    """The windows with auc and logloss of a model fitted before each and tested in it."""
    data = settled(assembled(df.withColumn("_day", F.to_date(date)), features, label, "_day"))

    def window(w) -> tuple:
        model = estimator.fit(data.filter(F.col("_day") < w["train_end"]))
        found = evaluate(model, data.filter((F.col("_day") >= w["train_end"]) & (F.col("_day") < w["test_end"])))
        return (w["split"], w["train_end"].strftime("%Y-%m"), w["train_end"].strftime("%Y-%m"), w["test_end"].strftime("%Y-%m"), w["train_size"], w["test_size"], found["auc"], found["logloss"])

    rows = concurrently(window, temporal_windows(df, date, **how).orderBy("split").collect())  # a row a window
    return df.sparkSession.createDataFrame(rows, "split int, train_end string, test_start string, test_end string, train_size long, test_size long, auc double, logloss double")


# -- stability and leakage


def stability(df: DataFrame, features: Sequence[str], label: str, key: str, estimator: Estimator, n_bootstrap: int = 50, share: float = 0.8, seed: str = "stability") -> dict[str, float]:
    """Mean, population deviation, least and greatest auc over bootstrap samples, each split by position (a row may fall on both sides). Samples are weights of the rows; fits run side by side, and each model scores the rows held from it, all in one job."""
    n = df.count()
    draws = max(2, int(share * n))
    cut = int(0.8 * draws)
    if draws - cut < 50:
        return {"n": 0}
    data, _, _ = multiplicities(_numbers(df, features, label, key), key, n_bootstrap, draws, cut, seed)
    drawn = lambda i, part: assembled(weighted(data, i, part), features, "label", "_w")

    fitted = concurrently(lambda i: _weighing(estimator).fit(drawn(i, "first")), range(n_bootstrap))
    held = [scored_as(model, drawn(i, "rest"), "p").select(F.lit(i).alias("sample"), "label", "p", F.col("_w").alias("w")) for i, model in enumerate(fitted)]
    tested = reduce(DataFrame.unionAll, held)
    x = np.array([r["auc"] for r in metrics.aucs(tested, "sample", "p", "label", "w").collect() if r["auc"] is not None])  # a row a sample
    return {"mean": float(x.mean()), "std": float(x.std()), "min": float(x.min()), "max": float(x.max()), "n": len(x)} if len(x) else {"n": 0}


def _weighing(estimator: Estimator) -> Estimator:
    """A copy that counts a row _w times."""
    if isinstance(estimator, HistogramBoosting):
        return estimator.copy({"weight": "_w"})
    return estimator.copy({estimator.getParam("weightCol"): "_w"})


def importances(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    own = model.importances() if isinstance(model, BoostedTrees) else model.featureImportances.toArray()
    return list(zip(features, own.tolist(), strict=True))


def importance_stability(df: DataFrame, features: Sequence[str], label: str, key: str, estimator: Estimator, n: int = 20, seed: str = "importance") -> DataFrame:
    """feature, mean, std (population), cv over bootstrap samples (weights of the rows), largest mean first."""
    data, _, _ = multiplicities(_numbers(df, features, label, key), key, n, seed=seed)
    rows = [x for own in concurrently(lambda i: importances(_weighing(estimator).fit(assembled(weighted(data, i, "first"), features, "label", "_w")), features), range(n)) for x in own]
    return summarised_importances(df.sparkSession.createDataFrame(rows, "feature string, importance double"))


def summarised_importances(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))
    return found.withColumn("cv", F.col("std") / (F.col("mean") + 1e-8)).orderBy(F.desc("mean"), "feature")


_LEAKS = "features array<string>, auc double, individual_corrs array<double>"


def interaction_leakage(df: DataFrame, label: str, threshold: float = 0.95, features: Sequence[str] | None = None) -> DataFrame:
    """features, auc, individual_corrs: pairs and triples of the first ten telling features whose small tree tells the label too well."""
    features = [c for c in features or numeric_columns(df) if c != label]
    corr = {r["feature"]: r["corr"] for r in label_correlations(df, features, label).collect()}
    telling = [c for c in features if (corr.get(c) or 0.0) > 0.3][:10]
    if len(telling) < 2:
        return df.sparkSession.createDataFrame([], _LEAKS)
    kept = settled(df.select(*telling, label))

    def tried(own: tuple[str, ...]) -> tuple | None:
        data = assembled(kept, own, label)
        auc = evaluate(DecisionTreeClassifier(maxDepth=5, seed=42).fit(data), data)["auc"]
        return (list(own), auc, [corr[c] for c in own]) if auc is not None and auc > threshold else None

    rows = [x for x in concurrently(tried, [own for n in (2, 3) for own in combinations(telling, n)]) if x]
    return df.sparkSession.createDataFrame(rows, _LEAKS).orderBy(F.desc("auc"))


def permutation_test(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, estimator: Estimator, trials: int = 1, seed: str = "permutation") -> DataFrame:
    """trial (0: true labels), auc, logloss: with permuted labels a sound model tells nothing."""
    held, rows = assembled(test, features, label), []
    for i in range(trials + 1):
        own = train if i == 0 else permuted(train, key, label, f"{seed}{i}")
        found = evaluate(estimator.fit(assembled(own, features, label)), held)
        rows.append((i, found["auc"], found["logloss"]))
    return train.sparkSession.createDataFrame(rows, "trial int, auc double, logloss double")


def shuffle_ablation(train: DataFrame, test: DataFrame, features: Sequence[str], top: Sequence[str], label: str, key: str, estimator: Estimator, seed: str = "ablation", cumulative: bool = True) -> DataFrame:
    """feature, auc, drop after its values are shuffled in train (on top of the features before it, if cumulative)."""
    held = assembled(test, features, label)
    base = evaluate(estimator.fit(assembled(train, features, label)), held)["auc"]
    rows, current = [(None, base, 0.0)], train
    for c in top:
        if c in train.columns:
            own = permuted(current, key, c, f"{seed}:{c}")
            current = own if cumulative else train
            auc = evaluate(estimator.fit(assembled(own, features, label)), held)["auc"]
            rows.append((c, auc, base - auc))
    return train.sparkSession.createDataFrame(rows, "feature string, auc double, drop double")


def full_audit(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, estimator: Estimator, date: str | None = None, n_bootstrap: int = 50, n_importance: int = 20) -> dict:
    """All of the above, and the test side's metrics; either side is made once."""
    date_of = [] if date is None else [date]
    train, test = (stored(df.select(*dict.fromkeys([key, *(c for c in features if c in df.columns), label, *more]))) for df, more in ((train, date_of), (test, [])))
    out: dict = {"interactions": interaction_leakage(train, label, features=features), "stability": stability(train, features, label, key, estimator, n_bootstrap), "test": evaluate(estimator.fit(assembled(train, features, label)), assembled(test, features, label))}
    if date is not None:
        out["temporal"] = temporal_validation(train, features, label, date, estimator)
    if isinstance(estimator, HistogramBoosting) or hasattr(estimator, "impurity") or "Tree" in type(estimator).__name__ or "Forest" in type(estimator).__name__:
        out["importance"] = importance_stability(train, features, label, key, estimator, n_importance)
    return out
