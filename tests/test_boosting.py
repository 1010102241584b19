"""Boosted trees against a plain version that looks at all rows for every cut."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rallyframe.operators.boosting import BoostedTrees, HistogramBoosting


def table(spark, x, y):
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y)], "x array<double>, label double")
    return df.select(array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))).alias("features"), "label").repartition(3)


def plain(bins, y, how, d):
    """The trees by recursion over rows: margins after all rounds."""
    score = lambda g, h: (np.sign(g) * max(0, abs(g) - how.l1)) ** 2 / (h + how.l2)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for t in range(how.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, add = p - y, p * (1 - p), np.zeros(len(y))

        def grow(rows, depth):
            best = (1e-12, None)
            if depth < how.depth:
                for j in how.features_of(t, d):
                    for b in np.unique(bins[rows, j])[:-1]:
                        left = bins[rows, j] <= b
                        a, c = rows[left], rows[~left]
                        if h[a].sum() >= how.min_child_weight and h[c].sum() >= how.min_child_weight:
                            gain = (score(g[a].sum(), h[a].sum()) + score(g[c].sum(), h[c].sum()) - score(g[rows].sum(), h[rows].sum())) / 2 - how.gamma
                            if gain > best[0] + 1e-9:
                                best = (gain, (a, c))
            if best[1] is None:
                total = g[rows].sum()
                add[rows] = -how.step * np.sign(total) * max(0, abs(total) - how.l1) / (h[rows].sum() + how.l2)
            else:
                for part in best[1]:
                    grow(part, depth + 1)

        grow(np.arange(len(y)), 0)
        margin += add
    return margin


@pytest.mark.parametrize("how", [HistogramBoosting(rounds=4, depth=3, step=0.3, bins=16, refresh=2), HistogramBoosting(rounds=3, depth=2, step=0.5, l1=0.3, l2=2.0, gamma=0.1, min_child_weight=3.0, columns=0.5, bins=8)])
def test_trees_equal_a_plain_search(spark, how):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x[:, 2] = rng.integers(0, 3, 300)
    x[rng.random(300) < 0.1, 1] = np.nan
    y = (x[:, 0] + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=300) > 0.7).astype(float)
    model = how.fit(table(spark, x, y))
    bins = model.binned(x)
    assert len(model.trees) == how.rounds
    assert model.margins(bins) == pytest.approx(plain(bins, y, how, 4), abs=1e-6)
    assert model.importances().sum() == pytest.approx(1)


def test_boosting_tells_labels_apart(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = HistogramBoosting(rounds=12, depth=3, step=0.5, rows=0.8, bins=32).fit(table(spark, x[:500], y[:500]))
    scored = model.transform(table(spark, x[500:], y[500:]))
    from rallyframe.operators import validate

    found = validate.evaluate(model, table(spark, x[500:], y[500:]))
    assert found["accuracy"] > 0.9 and found["auc"] > 0.95 and scored.columns == ["features", "label", "probability"]
    assert model.importances()[2] < 0.2


def test_boosting_of_odd_tables(spark):
    one = HistogramBoosting(rounds=3).fit(table(spark, np.ones((20, 2)), np.ones(20)))
    assert one.trees == [] and one.base > 10
    assert HistogramBoosting(rounds=3).fit(table(spark, np.ones((1, 2)), np.ones(1)).limit(0)).trees == []
    assert isinstance(one, BoostedTrees)
