"""Fewer columns: components of feature groups, and dropping of constant, correlated and collinear columns.

All pairs of columns are summed up in one scan: tasks keep matrices of columns by columns, which Spark adds up row by row,
some tasks at a time. What to do is decided on the driver over one such matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import GROUPS, numeric_columns

CHUNK = 400


def aggregated(df: DataFrame, expressions: dict[str, Column]) -> dict[str, float | None]:
    """All values, by aggregations of at most CHUNK expressions each."""
    out: dict[str, float | None] = {}
    names = list(expressions)
    for i in range(0, len(names), CHUNK):
        part = names[i : i + CHUNK]
        row = df.agg(*(expressions[n].alias(f"a{k}") for k, n in enumerate(part))).first()
        out |= {n: row[f"a{k}"] for k, n in enumerate(part)}
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; 0 for a column of nulls. Two passes for all columns.

    The first brackets each median by approximate quantiles a thousandth of the rows apart; the second counts what is
    below the bracket and the values in it, so no task holds more than that thousandth of a column.
    """
    names = list(columns)
    double = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)))
    found = aggregated(double, {f"{i}\t{k}": e for i in range(len(names)) for k, e in (("n", F.count(f"c{i}")), ("q", F.percentile_approx(f"c{i}", [0.4995, 0.5005], 10_000)))})
    brackets = {i: found[f"{i}\tq"] for i in range(len(names)) if found[f"{i}\tn"]}
    out = dict.fromkeys(names, 0.0)
    if not brackets:
        return out
    place = lambda i, low, high: F.when(F.col(f"c{i}") < low, F.struct(F.lit(i).alias("c"), F.lit(None).cast("double").alias("v"))).when(F.col(f"c{i}") <= high, F.struct(F.lit(i).alias("c"), F.col(f"c{i}").alias("v")))
    counts = double.select(F.explode(F.filter(F.array(*(place(i, low, high) for i, (low, high) in brackets.items())), lambda x: x.isNotNull())).alias("x")).groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c").orderBy(F.col("v").asc_nulls_first()))
    sizes = F.array(*(F.lit(found[f"{i}\tn"] or 0) for i in range(len(names))))
    rank = [(F.get(sizes, F.col("c")) - 1) / 2, F.get(sizes, F.col("c")) / 2]
    rows = counts.withColumn("upto", upto).groupBy("c").agg(*(F.min(F.when(F.col("upto") > F.floor(r), F.col("v"))).alias(k) for r, k in zip(rank, "ab", strict=True)))
    return out | {names[r["c"]]: (r["a"] + r["b"]) / 2 for r in rows.collect()}


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: 0.0 if x is None else x for c, x in aggregated(df, {c: F.avg(c) for c in columns}).items()}


def imputed(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def standard_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column."""
    found = aggregated(df, {f"{c}\t{f.__name__}": f(c) for c in columns for f in (F.avg, F.stddev_pop)})
    return {c: (found[f"{c}\tavg"] or 0.0, found[f"{c}\tstddev_pop"] or 0.0) for c in columns}


@dataclass
class Moments:
    """For columns i and j over the rows that have both: n, the mean of i, the squares of i about it, the products of both about their means."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray

    @classmethod
    def none(cls, rows: int, d: int) -> Moments:
        return cls(*(np.zeros((rows, d)) for _ in range(4)))

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of a block of rows; NaN is no value."""
        there = ~np.isnan(x)
        mask = there.astype(np.float64)
        middle = np.where(there, x, 0.0).sum(axis=0) / np.maximum(1, mask.sum(axis=0))  # so that what is squared is small
        own = np.where(there, x - middle, 0.0)
        n = mask.T @ mask
        some = np.maximum(n, 1)
        shift, square, product = own.T @ mask / some, (own * own).T @ mask, own.T @ own
        return cls(n, (shift + middle[:, None]) * (n > 0), np.maximum(square - n * shift * shift, 0.0), product - n * shift * shift.T)

    def added(self, other: Moments, mean_of_other: np.ndarray, mean_of_its_other: np.ndarray) -> Moments:
        """Both together. mean_of_other: the means of j over the same rows, which stand in another row of the whole matrix."""
        n = self.n + other.n
        some = np.maximum(n, 1)
        gap, across = other.mean - self.mean, mean_of_its_other - mean_of_other
        weight = self.n * other.n / some
        return Moments(n, self.mean + gap * other.n / some, self.square + other.square + gap * gap * weight, self.product + other.product + gap * across * weight)

    def correlation(self) -> np.ndarray:
        """Pearson's r, NaN where a column has no spread or there are no rows."""
        spread = self.square > 1e-28 * self.n * self.mean**2  # less is the rounding of a constant
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(spread & spread.T, self.product / np.sqrt(self.square * self.square.T), np.nan)

    def gram(self) -> np.ndarray:
        """X'X of columns without nulls."""
        return self.product + self.n * self.mean * self.mean.T


_ROW = "i int, n array<double>, mean array<double>, other array<double>, square array<double>, product array<double>"
_PARTS = ("n", "mean", "other", "square", "product")


def _rows(moments: Moments, at: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(lists(np.ascontiguousarray(x)) for x in (moments.n, moments.mean, other, moments.square, moments.product))], ["i", *_PARTS])


def moments(df: DataFrame, columns: Sequence[str], fan: int = 16) -> Moments:
    """The moments of all pairs of columns in one scan of them (nulls and NaN are no values); columns squared stay in a task and on the driver."""
    d = len(columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.none(d, d)
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
                own = Moments.of(x)
                total = total.added(own, total.mean.T, own.mean.T)
        yield _rows(total, np.arange(d), total.mean.T)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[Moments, np.ndarray]] = {}
        for batch in batches:
            number = {c: batch.column(c).flatten().to_numpy().reshape(-1, d) for c in _PARTS}
            for k, i in enumerate(batch.column("i").to_pylist()):
                own, other = Moments(*(number[c][k] for c in ("n", "mean", "square", "product"))), number["other"][k]
                before, there = totals.get(i) or (Moments(*np.zeros((4, d))), np.zeros(d))
                n = before.n + own.n
                totals[i] = before.added(own, there, other), there + (other - there) * own.n / np.maximum(n, 1)
        for i, (own, other) in totals.items():
            yield _rows(Moments(*(x[None] for x in (own.n, own.mean, own.square, own.product))), np.array([i]), other[None])

    double = df.select(*(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    rows = double.mapInArrow(scan, _ROW).withColumn("part", F.spark_partition_id())
    tree = rows.repartition("i", F.col("part") % fan).select("i", *_PARTS).mapInArrow(add, _ROW).repartition("i").mapInArrow(add, _ROW)
    out = Moments.none(d, d)
    for r in tree.collect():  # a row a column
        for name in ("n", "mean", "square", "product"):
            getattr(out, name)[r["i"]] = r[name]
    return out


@dataclass
class GroupState:
    """A fitted group: what transform needs."""

    columns: list[str]
    medians: list[float]
    means: list[float]
    stds: list[float]
    components: list[list[float]]
    k: int
    ratios: list[float] = field(default_factory=list)

    @property
    def cumulative(self) -> list[float]:
        return np.cumsum(self.ratios).tolist()


def fit_components(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> GroupState:
    """Medians fill, standardised columns, principal axes; the first k whose share of variance reaches the threshold."""
    middle = medians(df, columns)
    full = imputed(df.select(*columns), middle)
    found, d = moments(full, columns), len(columns)
    mean, std = np.diag(found.mean), np.sqrt(np.diag(found.square) / np.maximum(np.diag(found.n), 1))
    gram = np.nan_to_num(found.correlation())
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
    for v in vectors:  # the largest loading is positive
        v *= np.sign(v[np.argmax(np.abs(v))]) or 1.0
    total = values.sum()
    ratios = values / total if total > 0 else np.zeros(d)
    reached = np.flatnonzero(np.cumsum(ratios) >= threshold - 1e-12)
    k = int(reached[0]) + 1 if len(reached) else d
    return GroupState(list(columns), [middle[c] for c in columns], mean.tolist(), np.where(std > 0, std, 1.0).tolist(), vectors[:k].tolist(), k, ratios[:k].tolist())


def project(df: DataFrame, group: str, state: GroupState) -> DataFrame:
    """Adds <group>_pca1.. and drops the group's columns; columns that are missing count as null, so as the median."""
    z = []
    for c, median, mean, std in zip(state.columns, state.medians, state.means, state.stds, strict=True):
        x = F.coalesce(F.col(c).cast("double"), F.lit(median)) if c in df.columns else F.lit(median)
        z.append((x - mean) / std)
    new = {}
    for i, axis in enumerate(state.components, 1):
        total = z[0] * axis[0]
        for x, w in zip(z[1:], axis[1:], strict=True):
            total = total + x * w
        new[f"{group}_pca{i}"] = total
    return df.withColumns(new).drop(*state.columns)


def group_components(df: DataFrame, state: dict[str, GroupState] | None = None, *, threshold: float = 0.9, groups: dict[str, list[str]] = GROUPS, allow_refit: bool = False, train: bool = True) -> tuple[DataFrame, dict[str, GroupState]]:
    """Fits (train) or applies each group of two present columns and more. Applying without a fitted group is an error unless allowed."""
    out: dict[str, GroupState] = {}
    for group, names in groups.items():
        present = [c for c in names if c in df.columns]
        if not train and state and group in state:
            out[group] = state[group]
        elif len(present) < 2:
            continue
        elif train or allow_refit:
            out[group] = fit_components(df, present, threshold)
        else:
            raise ValueError(f"group {group} was not fitted")
    for group, own in out.items():
        df = project(df, group, own)
    return df, out


def component_report(spark: SparkSession, state: dict[str, GroupState]) -> DataFrame:
    """group, n_components, pc1_var, pc1_cum, cum_at_n; most explained first."""
    rows = [(g, s.k, s.ratios[0], s.cumulative[0], s.cumulative[-1]) for g, s in state.items()]
    return spark.createDataFrame(rows, "group string, n_components int, pc1_var double, pc1_cum double, cum_at_n double").orderBy(F.desc("pc1_var"), "group")


def first_loadings(spark: SparkSession, group: str, state: dict[str, GroupState]) -> DataFrame:
    """feature, loading of a group's first component, largest first; ValueError for a group that isn't there."""
    if group not in state:
        raise ValueError(f"no group {group}")
    own = sorted(zip(state[group].columns, state[group].components[0], strict=True), key=lambda x: -abs(x[1]))
    return spark.createDataFrame(own, "feature string, loading double")


def diagnosis(spark: SparkSession, group: str, state: dict[str, GroupState]) -> DataFrame:
    """component, share, cumulative, loadings (of features, largest first) of a group's components; ValueError for a group that isn't there."""
    if group not in state:
        raise ValueError(f"no group {group}")
    own = state[group]
    rows = [(i + 1, own.ratios[i], own.cumulative[i], sorted(zip(own.columns, axis, strict=True), key=lambda x: -abs(x[1]))) for i, axis in enumerate(own.components)]
    return spark.createDataFrame(rows, "component int, share double, cumulative double, loadings array<struct<feature: string, loading: double>>")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without variance; columns of nulls are not among them."""
    found = aggregated(df, {c: F.var_samp(c) for c in columns})
    return [c for c in columns if found[c] == 0]


def correlations(df: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pearson's r of all pairs, over the rows in which both have values; None where there is none."""
    found = moments(df, columns).correlation()
    return {(a, b): float(found[i, j]) if np.isfinite(found[i, j]) else None for (i, a), (j, b) in combinations(enumerate(columns), 2)}


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.995) -> list[str]:
    """The later one of each pair over the threshold, whether or not the earlier one goes too."""
    found = correlations(df, columns)
    return [b for i, b in enumerate(columns) if any(abs(found[a, b] or 0.0) > threshold for a in columns[:i])]


def drop_constant_and_correlated(df: DataFrame, threshold: float = 0.995, protect: Sequence[str] = ("mk", "target")) -> tuple[DataFrame, list[str]]:
    columns = [c for c in numeric_columns(df) if c not in protect]
    gone = constant_columns(df, columns)
    gone += correlated_columns(df, [c for c in columns if c not in gone], threshold)
    return df.drop(*gone), gone


def inflation(gram: np.ndarray) -> np.ndarray:
    """Variance inflation factors without intercept from X'X; infinite where a column depends on others."""
    if np.linalg.matrix_rank(gram) < len(gram):
        out = np.full(len(gram), np.inf)
        inverse = np.linalg.pinv(gram)
        own = np.diag(gram) * np.diag(inverse)
        free = np.isclose(np.diag(gram @ inverse), 1.0)
        out[free] = own[free]
        return out
    return np.diag(gram) * np.diag(np.linalg.inv(gram))


def inflated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 10.0, most: int = 25) -> list[str]:
    """Columns to drop, worst first, until no factor is over the threshold: one scan for X'X, the rest on the driver."""
    full = imputed(df.select(*columns), medians(df, columns))
    found = moments(full, columns)
    std = np.sqrt(np.diag(found.square) / np.maximum(np.diag(found.n) - 1, 1))
    use = np.flatnonzero(std > 1e-6)
    names, gone = [columns[i] for i in use], [c for i, c in enumerate(columns) if not std[i] > 1e-6]
    gram = found.gram()[np.ix_(use, use)]
    left = list(range(len(names)))
    for _ in range(most):
        if len(left) < 2:
            break
        factors = inflation(gram[np.ix_(left, left)])
        worst = int(np.argmax(factors))
        if not factors[worst] > threshold:
            break
        gone.append(names[left.pop(worst)])
    return gone
