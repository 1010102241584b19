"""Quantiles, ranges, resampled audits and column pairs against direct computations."""

import collections
import os
import random
import statistics
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from rallyframe.functions import columns
from rallyframe.operators import audit, metrics, models, reduce, reports, validate
from rallyframe.operators.boosting import HistogramBoosting


def test_medians_are_exact(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 1000, 20_001):
        rows = [(rng.gauss(0, 1) if rng.random() < 0.9 else None, 1e12 if i == 0 else float(rng.randint(0, 3)), None) for i in range(n)]
        found = reduce.medians(spark.createDataFrame(rows, "a double, `b` double, c double"), ["a", "b", "c"])
        for k, c in enumerate("ab"):
            own = [r[k] for r in rows if r[k] is not None]
            assert found[c] == pytest.approx(statistics.median(own) if own else 0.0, abs=1e-12)
        assert found["c"] == 0.0


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 7)) * [1, 10, 0.1, 1, 1, 1, 0] + [0, 1e6, -5, 0, 3, 1, 0.1]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=700) * 0.01
    there = rng.random(x.shape) > [0, 0.3, 0.9, 0.2, 0, 0.999, 0]
    there[:, 5] = False
    rows = [tuple(float(v) if ok else None for v, ok in zip(r, m)) for r, m in zip(x, there)] + [(float("nan"), None, None, None, None, None, 0.1)]
    names = [f"x{i}" for i in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(9)
    found = reduce.moments(df, names, fan=2)
    for i in range(7):
        for j in range(7):
            both = there[:, i] & there[:, j]
            assert found.n[i, j] == both.sum() + (i == j == 6)
            if both.sum() > 1 and 6 not in (i, j):
                a, b = x[both, i], x[both, j]
                assert found.mean[i, j] == pytest.approx(a.mean()) and found.square[i, j] == pytest.approx(((a - a.mean()) ** 2).sum())
                assert found.product[i, j] == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(), abs=1e-6)
                assert found.correlation()[i, j] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
    assert np.isnan(found.correlation()[6]).all() and np.isnan(found.correlation()[5]).all()
    whole = df.select("x0", "x4").dropna()
    assert reduce.moments(whole.where("x0 = x0"), ["x0", "x4"]).gram() == pytest.approx(x[:, [0, 4]].T @ x[:, [0, 4]])
    assert reduce.correlations(df.limit(0), names[:2]) == {("x0", "x1"): None}
    assert reduce.correlated_columns(df, names[:5]) == ["x3"]


def test_many_columns_take_one_scan(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 120))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{i} double" for i in range(120)))
    tracker, before = spark.sparkContext.statusTracker(), "moments-test"
    spark.sparkContext.setJobGroup(before, before)
    found = reduce.moments(df, df.columns)
    assert len(tracker.getJobIdsForGroup(before)) <= 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.correlation() == pytest.approx(np.corrcoef(x.T))


def test_all_features_in_the_same_jobs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(5)]), rng.gauss(0, 1) + i % 2, float(i % 2), rng.random() if i < 8 else None, i % 2 == 1) for i in range(400)]
    names = ["few", "shifted", "apart", "rare"]
    df = spark.createDataFrame(rows, "few int, shifted double, apart double, rare double, second boolean").repartition(5)
    found = {r["feature"]: r for r in audit.ks_statistics(df, names, "second").collect()}
    for k, c in enumerate(names):
        a, b = ([r[k] for r in rows if r[k] is not None and r[4] == s] for s in (False, True))
        gap = max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in a + b)
        assert (found[c]["n1"], found[c]["n2"]) == (len(a), len(b)) and found[c]["d"] == pytest.approx(gap)
    verdicts = {r["feature"]: r["verdict"] for r in audit.drift(df.filter("not second"), df.filter("second"), [*names, "absent"]).collect()}
    assert verdicts == {"few": "similar", "shifted": "distinta", "apart": "distinta"}
    assert audit.ks_statistics(df.limit(0), names, "second").collect() == []


def test_the_catalogue_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 60; from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_ranges_bear_outliers(spark):
    rng = random.Random(2)
    rows = [(rng.choice([rng.random(), round(rng.random(), 1)]), rng.randint(0, 1)) for _ in range(500)] + [(1e15, 1), (-1e15, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    ones, zeros = [s for s, y in rows if y], [s for s, y in rows if not y]
    wanted = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert metrics.auc(df, "s", "y").first()["auc"] == pytest.approx(wanted)
    gap = max(abs(sum(x <= v for x in ones) / len(ones) - sum(x <= v for x in zeros) / len(zeros)) for v, _ in rows)
    assert audit.ks_statistic(df.withColumn("second", F.col("y") == 1), "s", "second").first()["d"] == pytest.approx(gap)
    counts = df.groupBy("s").count()
    sizes = [r["n"] for r in metrics.in_ranges(counts, "s", n=10).groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 0.2 * counts.count() + 2


def told(spark, n=300):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random(), f"2020-{1 + i * 12 // n:02d}-10") for i in range(n)]
    return spark.createDataFrame([(*r, int(r[1] > 0.5)) for r in rows], "mk long, x double, z double, d string, y int")


def test_resampled_audits(spark):
    df, tree = told(spark), DecisionTreeClassifier(maxDepth=2, seed=1)
    found = validate.stability(df, ["x", "z"], "y", "mk", tree, n_bootstrap=2, share=1.0)
    assert found["n"] == 2 and found["min"] > 0.9 and found["min"] <= found["mean"] <= found["max"]
    first = validate.importance_stability(df, ["x", "z"], "y", "mk", tree, n=2).first()
    assert first["feature"] == "x" and first["mean"] > 0.9
    windows = validate.temporal_validation(df, ["x", "z"], "y", "d", tree, least_train=50, least_test=20)
    assert [r["auc"] > 0.9 for r in windows.collect()] == [True] and windows.first()["train_size"] + windows.first()["test_size"] <= 300
    whole = validate.full_audit(df.filter("mk < 200"), df.filter("mk >= 200"), ["x", "z"], "y", "mk", tree, n_bootstrap=1, n_importance=1)
    assert whole["test"]["auc"] > 0.9 and whole.keys() == {"interactions", "stability", "test", "importance"}


def test_multiplicities_are_the_draws(spark):
    df = told(spark, 60)
    rows, draws, cut = validate.multiplicities(df, "mk", 3, 50, 40, "s")
    whole = validate.numbered(df, "mk")
    for i in range(3):
        drawn = validate.drawn_of(whole, 50, f"s{i}").collect()
        for part, mine in (("first", [r["mk"] for r in drawn if r["draw"] < cut]), ("rest", [r["mk"] for r in drawn if r["draw"] >= cut])):
            found = {r["mk"]: r["_w"] for r in validate.weighted(rows, i, part).collect()}
            assert found == collections.Counter(mine)
    assert validate.multiplicities(df.limit(0), "mk", 2)[0].collect() == []


def test_weights_are_repeated_rows(spark):
    df = told(spark, 200).withColumn("w", F.pmod(F.col("mk"), F.lit(3)).cast("double"))
    often = df.filter("w > 0").withColumn("k", F.explode(F.expr("sequence(1, cast(w as int))")))
    scores = lambda x: x.withColumn("p", F.round("z", 1))
    wanted = metrics.auc(scores(often), "p", "y").first()["auc"]
    assert metrics.auc(scores(df), "p", "y", "w").first()["auc"] == pytest.approx(wanted)
    both = scores(df).select(F.lit(1).alias("g"), "p", "y", "w").union(df.select(F.lit(2), "x", "y", "w"))
    found = {r["g"]: r["auc"] for r in metrics.aucs(both, "g", "p", "y", "w").collect()}
    assert found == {1: pytest.approx(wanted), 2: 1.0}


def test_scores_of_several_models_need_no_join(spark):
    data = validate.assembled(told(spark, 120), ["x", "z"], "y", "mk")
    fitted = [DecisionTreeClassifier(maxDepth=d, seed=1).fit(data) for d in (1, 2)] + [HistogramBoosting(rounds=2, depth=2).fit(data)]
    found = models.vote(fitted, data, "mk")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    apart = [{r["mk"]: r["p"] for r in validate.scored(m, data).select("mk", "p").collect()} for m in fitted]
    assert all(r["p"] == pytest.approx(sum(a[r["mk"]] for a in apart) / 3) for r in found.collect())
    folded = validate.expanding_folds(told(spark, 120), [F.col("mk")], 2)
    maps = models.calibrate(validate.assembled(folded, ["x", "z"], "y", "_fold"), 2, DecisionTreeClassifier(maxDepth=1, seed=1))
    joined = models.calibrated(maps, data, "mk")
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString() and joined.count() == 120


def test_search_over_boosted_trees(spark):
    folded = validate.assembled(validate.expanding_folds(told(spark, 150), [F.col("mk")], 2), ["x", "z"], "y", "_fold")
    rows = models.grid_search(folded, 2, models.SEARCHED.copy({"rounds": 2}), {"depth": [1, 2], "step": [0.1, 0.6]}).collect()
    assert len(rows) == 4 and rows[0]["parameters"].endswith("step=0.6") and rows[0]["logloss"] < rows[-1]["logloss"]
    found = models.compare(folded.filter("_fold < 2"), folded.filter("_fold = 2"), {"boosted": HistogramBoosting(rounds=2), "tree": DecisionTreeClassifier(maxDepth=2, seed=1)}).collect()
    assert {r["model"] for r in found} == {"boosted", "tree"} and all(r["auc"] > 0.9 for r in found)


def test_bootstrap_samples_are_drawn_from_one_numbering(spark):
    whole = validate.numbered(told(spark, 50), "mk")
    assert sorted(r["mk"] for r in validate.drawn_of(whole, 40, "a").collect()) == sorted(r["mk"] for r in validate.bootstrap(told(spark, 50), "mk", 40, "a").collect())


def test_pairs_of_different_types(spark):
    df = spark.createDataFrame([("1", 2, "x", 5, 1.0, 2.0), (None, 3, None, 6, 3.0, None)], "p1_rank string, p2_rank long, p1_entry string, p2_entry long, elo_p1 double, elo_p2 double")
    out = columns.harmonise_pairs(df)
    assert dict(out.dtypes) == {"p1_rank": "double", "p2_rank": "double", "p1_entry": "double", "p2_entry": "double", "elo_p1": "double", "elo_p2": "double"}
    assert [tuple(r)[:2] for r in out.collect()] == [(1.0, 2.0), (None, 3.0)]
    words = columns.harmonise_pairs(spark.createDataFrame([("x", True)], "p1_a string, p2_a boolean"))
    assert set(dict(words.dtypes).values()) == {"string"}
    assert columns.common_columns(df, df.select("p2_rank", "elo_p1")) == ["p2_rank", "elo_p1"]


def test_components_are_diagnosed(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + i % 3) for i in range(30)], "a double, b double")
    _, state = reduce.group_components(df, groups={"g": ["a", "b"]})
    rows = reduce.diagnosis(spark, "g", state).collect()
    assert [r["component"] for r in rows] == [1] and rows[0]["share"] > 0.99 and {x["feature"] for x in rows[0]["loadings"]} == {"a", "b"}
    with pytest.raises(ValueError):
        reduce.diagnosis(spark, "h", state)


def test_grids_of_chosen_and_of_all_players(spark):
    rows = spark.createDataFrame([(1, 2, "Hard", 1), (2, 1, "Hard", 0), (1, 2, "Clay", 0), (2, 1, "Clay", 1)], "player int, opp int, surface string, won int")
    assert {tuple(r) for r in reports.surface_grid(rows).collect()} == {(1, "Hard", 1.0), (1, "Clay", 0.0), (1, "Grass", 0.0), (2, "Hard", 0.0), (2, "Clay", 1.0), (2, "Grass", 0.0)}
    assert {tuple(r) for r in reports.surface_grid(rows, [3]).collect()} == {(3, s, 0.0) for s in ("Hard", "Clay", "Grass")}
    assert {tuple(r) for r in reports.head_to_head_matrix(rows).collect()} == {(1, 2, 0.5), (2, 1, 0.5)}
    assert {tuple(r) for r in reports.head_to_head_matrix(rows, [1, 3]).collect()} == {(1, 1, 0.0), (1, 3, 0.0), (3, 1, 0.0), (3, 3, 0.0)}


def test_draws_are_counted_by_blocks_and_read_by_sample(spark, monkeypatch):
    monkeypatch.setattr(validate, "BLOCK", 16)
    monkeypatch.setattr(validate, "HASHED", 7)
    df = told(spark, 60)
    rows, draws, cut = validate.multiplicities(df, "mk", 3, 50, 40, "s")
    whole = validate.numbered(df, "mk")
    for i in range(3):
        drawn = validate.drawn_of(whole, 50, f"s{i}").collect()
        for part, mine in (("first", [r["mk"] for r in drawn if r["draw"] < cut]), ("rest", [r["mk"] for r in drawn if r["draw"] >= cut])):
            assert {r["mk"]: r["_w"] for r in validate.weighted(rows, i, part).collect()} == collections.Counter(mine)
    read = validate.weighted(rows.select("mk", *(c for c in rows.columns if c.startswith("_"))), 1, "first")._jdf.queryExecution().executedPlan().toString()
    assert "_first1" in read.split("ReadSchema")[1] and "_first0" not in read.split("ReadSchema")[1] and "_rest1" not in read.split("ReadSchema")[1]


def test_full_audit_makes_either_side_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = told(spark).select("mk", "x", "z", "y")
    df = df.mapInArrow(seen, df.schema)
    validate.full_audit(df.filter("mk < 200"), df.filter("mk >= 200"), ["x", "z"], "y", "mk", DecisionTreeClassifier(maxDepth=2, seed=1), n_bootstrap=1, n_importance=1)
    assert made.value == 600
