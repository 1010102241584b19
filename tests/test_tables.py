"""Sources, cleaning, columns, reductions, audits, metrics and models."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import functions as F

from rallyframe.functions import columns
from rallyframe.operators import audit, metrics, models, reduce, reports, validate
from rallyframe.sources import matches as sources


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_files_are_bound_by_their_own_headers(spark, tmp_path):
    write(tmp_path / "raw", "a.csv", "tourney_date,winner_name,loser_name,w_ace\n20240101,A,B,3\nx,C,D,1\n")
    write(tmp_path / "raw", "b.csv", "loser_name,winner_name,surface\nF,E,Clay\n")
    write(tmp_path / "raw", "c.csv", "")
    df, skipped = sources.load_folder(spark, str(tmp_path / "raw"))
    rows = {r["winner_name"]: (r["loser_name"], r["surface"], r["w_ace"]) for r in df.collect()}
    assert rows == {"A": ("B", None, 3), "C": ("D", None, 1), "E": ("F", "Clay", None)}
    assert len(skipped) == 1
    clean = {r["winner_name"]: (str(r["tourney_date"]), r["surface"]) for r in sources.clean(df).collect()}
    assert clean == {"A": ("2024-01-01", "Unknown"), "C": ("None", "Unknown"), "E": ("None", "Clay")}


def test_folders_must_be_there_and_hold_rows(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.load_train_test(spark, str(tmp_path / "none"))
    write(tmp_path / "train", "a.csv", "winner_name,loser_name\n")
    write(tmp_path / "test", "a.csv", "winner_name,loser_name\nA,B\n")
    with pytest.raises(ValueError):
        sources.load_train_test(spark, str(tmp_path))
    write(tmp_path / "empty", "a.txt", "")
    with pytest.raises(ValueError):
        sources.load_folder(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_outputs_round_trip(spark, tmp_path, format):
    assert sources.load_processed(spark, str(tmp_path / "none"), format) is None
    df = spark.createDataFrame([(1, 2.5), (2, None)], "a int, b double")
    sources.save_outputs(str(tmp_path / format), format, train_final=df, test_final=df)
    train, _ = sources.load_processed(spark, str(tmp_path / format), format)
    assert sorted(map(tuple, train.collect())) == sorted(map(tuple, df.collect()))


def test_renaming(spark):
    raw = spark.createDataFrame([(1, "A", "B", 7, "R", 3, "ESP", 1)], "winner_id int, winner_name string, loser_name string, winner_rank int, loser_hand string, w_ace int, winner_ioc string, y int")
    assert sources.rename_sides(raw).columns == ["player_1_id", "player_1", "player_2", "p1_rank", "player_2_hand", "p1_ace", "p1_ioc", "target"]
    with pytest.raises(ValueError):
        sources.rename_sides(spark.createDataFrame([("A", "B", "C")], "winner string, winner_name string, loser string"))
    with pytest.raises(ValueError):
        sources.rename_sides(spark.createDataFrame([("A",)], "winner_name string"))
    assert sources.rename_sides(spark.createDataFrame([(1, 2)], "winner_id int, loser_id int")).first()["player_1"] == 1


def test_date_column_needs_a_date(spark):
    df = spark.createDataFrame([("x", "20240102"), ("y", None)], "match_date string, tourney_date string")
    assert sources.date_column(df) == "tourney_date"
    assert sources.date_column(df.drop("tourney_date")) is None


def test_coercion(spark):
    rows = [(str(i), str(i) if i else "1Q", "x" if i < 10 else "1", "R") for i in range(40)]
    df = columns.coerce_sides(spark.createDataFrame(rows, "p1_a string, p1_b string, p1_c string, p1_hand string"))
    assert [t for _, t in df.dtypes] == ["double", "double", "string", "string"]
    assert df.filter("p1_b is null").count() == 1


def test_swap_is_coherent_and_repeatable(spark):
    df = spark.createDataFrame([(i, "A", "B", 1, 2, "L", "R", 1) for i in range(200)], "mk long, player_1 string, player_2 string, p1_rank int, p2_rank int, player_1_hand string, player_2_hand string, target int")
    rows = columns.swap_sides(df).orderBy("mk").collect()
    assert rows == columns.swap_sides(df.repartition(5)).orderBy("mk").collect()
    assert {(r["player_1"], r["p1_rank"], r["player_1_hand"], r["target"]) for r in rows} == {("A", 1, "L", 1), ("B", 2, "R", 0)}
    assert 60 < sum(r["target"] for r in rows) < 140


def test_selection(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "elo_prob int, other int, elo_core_pca1 int, elo_prob_x int")
    assert columns.curated(df) == ["elo_prob", "elo_prob_x", "elo_core_pca1"]
    assert len(columns.CURATED) == 49
    assert columns.aligned(df, ["other", "none"]).first().asDict() == {"other": 2, "none": 0.0}


def frame(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    x = np.stack([a, b, a + 0.3 * b, a + b + 0.001 * rng.normal(size=n)], axis=1)
    rows = [(i, *map(float, r), int(r[0] + 0.5 * rng.normal() > 0)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "mk long, a double, b double, c double, d double, target int"), x


def test_components_equal_numpy(spark):
    df, x = frame(spark)
    out, state = reduce.group_components(df, groups={"g": ["a", "b", "c", "d"], "alone": ["a"]}, threshold=0.8)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(z.T @ z / len(z))[::-1]
    assert state["g"].ratios == pytest.approx((values / values.sum())[: state["g"].k].tolist())
    assert "alone" not in state and out.columns[:2] == ["mk", "target"]
    found = np.array([[r[f"g_pca{i + 1}"] for i in range(state["g"].k)] for r in out.orderBy("mk").collect()])
    assert found == pytest.approx(z @ np.array(state["g"].components).T)
    again, _ = reduce.group_components(df.drop("d"), state, groups={"g": ["a", "b", "c", "d"]}, train=False)
    assert f"g_pca{state['g'].k}" in again.columns
    with pytest.raises(ValueError):
        reduce.group_components(df, {}, groups={"g": ["a", "b"]}, train=False)
    with pytest.raises(ValueError):
        reduce.first_loadings(spark, "none", state)
    assert reduce.component_report(spark, {}).count() == 0


def test_dropping(spark):
    df, x = frame(spark)
    df = df.withColumns({"one": F.lit(1.0), "twice": F.col("a") * 2, "void": F.lit(None).cast("double")})
    _, gone = reduce.drop_constant_and_correlated(df)
    assert gone == ["one", "twice"]
    assert np.isinf(reduce.inflation(x.T @ x)[:3]).all()  # the third is a sum of the others
    x = x[:, [0, 1, 3]]
    factors, brute = reduce.inflation(x.T @ x), []
    for i in range(3):
        rest = np.delete(x, i, axis=1)
        left = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        brute.append((x[:, i] @ x[:, i]) / (left @ left))
    assert factors == pytest.approx(brute, rel=1e-5)
    assert "twice" in reduce.inflated_columns(df, ["a", "b", "twice"]) or "a" in reduce.inflated_columns(df, ["a", "b", "twice"])


def test_metrics_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "p double, y int")
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert metrics.auc(df, "p", "y").first()["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    bins = {r["bin"]: r["n"] for r in metrics.confidence_bins(spark.createDataFrame([(0.0, 1, 1), (0.3, 1, 1), (0.7, 1, 0), (1.0, 0, 0)], "p double, y int, q int"), "p", "y", "q").collect()}
    assert bins == {"Baja": 1, "Media": 1, "Alta": 1}
    both = df.select("p", (F.col("y") == 1).alias("s"))
    d = audit.ks_statistic(both, "p", "s").first()["d"]
    assert d == pytest.approx(max(abs(sum(a <= t for a in pos) / len(pos) - sum(b <= t for b in neg) / len(neg)) for t in {p for p, _ in rows}))
    assert audit.ks_p_value(0.9, 100, 100) < 1e-6 and math.isclose(audit.ks_p_value(0.0, 100, 100), 1.0)


def test_audits(spark):
    df, _ = frame(spark)
    found = {r["feature"]: r["corr"] for r in audit.label_correlations(df.withColumn("leak", F.col("target") * 3.0), ["a", "leak"], "target").collect()}
    assert found["leak"] == pytest.approx(1.0) and found["a"] < 0.95
    drift = {r["feature"]: r["verdict"] for r in audit.drift(df, df.withColumn("b", F.col("b") + 3), ["a", "b", "none"]).collect()}
    assert drift == {"a": "similar", "b": "distinta"}


def test_folds_and_resampling(spark):
    df = spark.range(100).withColumnRenamed("id", "k").repartition(6)
    sizes = {r["_fold"]: r["count"] for r in validate.expanding_folds(df, [F.col("k")], 5).groupBy("_fold").count().collect()}
    assert sizes == {0: 20, 1: 16, 2: 16, 3: 16, 4: 16, 5: 16}
    rows = validate.dense_ids(df, [F.col("k").desc()]).collect()
    assert all(r["_row"] == 99 - r["k"] for r in rows)
    drawn = validate.bootstrap(df, "k")
    assert drawn.count() == 100 and drawn.select("k").distinct().count() < 100
    moved = validate.permuted(df.withColumn("v", F.col("k")), "k", "v", "s").collect()
    assert sorted(r["v"] for r in moved) == list(range(100)) and sum(r["v"] == r["k"] for r in moved) < 20


def test_models(spark):
    df, _ = frame(spark)
    data = validate.assembled(validate.expanding_folds(df, [F.col("mk")], 3), ["a", "b", "c"], "target", "mk", "_fold").persist()
    train, test = data.filter("_fold < 3"), data.filter("_fold = 3")
    table = models.compare(train, test, {"tree": DecisionTreeClassifier(maxDepth=3, seed=1), "line": LogisticRegression(maxIter=20)}).collect()
    assert len(table) == 2 and all(r["auc"] > 0.7 for r in table)
    fitted = models.calibrate(data, 3, DecisionTreeClassifier(maxDepth=3, seed=1))
    assert models.summary(models.calibrated(fitted, test, "mk")).first()["accuracy"] > 0.7
    base = {r["feature"]: r["auc"] for r in validate.shuffle_ablation(df, df, ["a", "b"], ["a"], "target", "mk", DecisionTreeClassifier(maxDepth=3, seed=1)).collect()}
    assert base["a"] < base[None]
    trials = {r["trial"]: r["auc"] for r in validate.permutation_test(df, df, ["a", "b"], "target", "mk", DecisionTreeClassifier(maxDepth=3, seed=1)).collect()}
    assert trials[1] < trials[0]


def test_reports(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    assert [tuple(r) for r in reports.histogram(df, "x", 5).orderBy("bin").collect()] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert [tuple(r) for r in reports.histogram(df.filter("x = 1"), "x", 5).collect()] == [(0, 1)]


def test_many_files_of_few_headers_take_few_jobs(spark, tmp_path):
    for i in range(120):
        names = ["a", "b"] if i % 3 else ["b", "a", "c"]
        (tmp_path / f"{i:03d}.csv").write_text(",".join(names) + "\n" + "\n".join(",".join(str(i * 10 + (ord(c) - 96)) for c in names) for _ in range(2)) + "\n")
    (tmp_path / "empty.csv").write_text("")
    group = "folder-test"
    spark.sparkContext.setJobGroup(group, group)
    df, skipped = sources.load_folder(spark, str(tmp_path))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 10
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [s.rsplit("/", 1)[1] for s in skipped] == ["empty.csv"] and set(df.columns) == {"a", "b", "c"}
    rows = df.collect()
    assert len(rows) == 240 and all(r["b"] == r["a"] + 1 for r in rows) and sum(r["c"] is not None for r in rows) == 80
