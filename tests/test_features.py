"""Histories and ratings against hand-made figures and a sequential oracle."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import derived, history, ratings
from rallyframe.plans.features import FeaturePipeline
from rallyframe.streaming.ratings import stream_surface_elo

ROWS = [(1, 1, "A", "B", "Hard", 1), (2, 1, "C", "A", "Hard", 0), (3, 3, "B", "A", "Clay", 1), (4, 8, "A", "B", "Hard", 0), (5, 9, "A", "C", "Hard", 1), (6, 20, "B", "A", "Hard", 1)]
SCHEMA = "mk long, tourney_date date, player_1 string, player_2 string, surface string, target int"


def matches(spark, rows=ROWS):
    return spark.createDataFrame([(mk, datetime.date(2024, 1, d), *rest) for mk, d, *rest in rows], SCHEMA)


def by_key(df, *names):
    return {r["mk"]: tuple(r[n] for n in names) for r in df.collect()}


def close(found, wanted):
    assert found.keys() == wanted.keys()
    for k in wanted:
        assert found[k] == pytest.approx(wanted[k], abs=1e-6), k


def test_global_ratings(spark):
    m = matches(spark)
    close(by_key(ratings.elo(m), "elo_p1", "elo_p2"), {1: (1500.0, 1500.0), 2: (1500.0, 1521.0), 3: (1479.0, 1540.56479), 4: (1516.296883, 1503.473224), 5: (1495.065591, 1480.267757), 6: (1524.882056, 1514.509209)})
    volatility = by_key(ratings.elo(m), "elo_vol5_p1")
    assert volatility[1] == (None,) and volatility[6][0] == pytest.approx(22.294019, abs=1e-6)


def test_surface_ratings(spark):
    found = by_key(ratings.surface_elo(matches(spark)), "surface_elo_p1", "surface_elo_p2")
    close(found, {1: (1500.0, 1500.0), 2: (1500.0, 1520.274881), 3: (1500.0, 1500.0), 4: (1539.213644, 1479.490148), 5: (1515.996517, 1480.458102), 6: (1503.158387, 1533.674659)})


def test_final_states(spark):
    m = matches(spark)
    found = {r["player"]: r["elo"] for r in ratings.final_state(m, ratings.fold(m, ratings.match_counts(m))).collect()}
    assert found == pytest.approx({"A": 1494.966888, "B": 1544.746802, "C": 1460.332266}, abs=1e-6)
    own = ratings.fold(m, ratings.surface_counts(m), by_surface=True)
    found = {(r["player"], r["surface"]): r["elo"] for r in ratings.final_state(m, own, True).collect()}
    assert found == pytest.approx({("A", "Hard"): 1512.430981, ("B", "Hard"): 1524.978525, ("C", "Hard"): 1461.977486, ("B", "Clay"): 1520.391544, ("A", "Clay"): 1479.953602}, abs=1e-6)


def test_head_to_head(spark):
    found = by_key(history.head_to_head(matches(spark)), "h2h_count", "h2h_balance", "h2h_recent3_balance")
    assert found == {1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 1, 1), 4: (2, 2, 2), 5: (1, -1, -1), 6: (3, 1, 1)}


def test_form(spark):
    found = by_key(history.side_features(matches(spark)), "p1_form_winrate_last5", "p1_streak_wins", "p1_days_since_last", "p1_matches_last7d")
    close({k: tuple(-1 if x is None else x for x in v) for k, v in found.items()}, {1: (-1, 0, -1, 0), 2: (-1, 0, -1, 0), 3: (0.0, 0, 2, 1), 4: (0.666667, 0, 5, 1), 5: (0.5, 0, 1, 2), 6: (0.666667, 2, 12, 0)})


def sequential(rows, k_min=24.0, k_max=42.0, half=50.0):
    rating, count, out = {}, {}, {}
    for mk, _, a, b, _, won in rows:
        r1, r2 = rating.get(a, 1500.0), rating.get(b, 1500.0)
        k = [k_min + (k_max - k_min) * math.exp(-count.get(p, 0) / half) for p in (a, b)]
        e = 1 / (1 + 10 ** ((r2 - r1) / 400))
        rating[a], rating[b] = r1 + k[0] * (won - e), r2 + k[1] * (e - won)
        count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
        out[mk] = (r1, r2)
    return out


def random_rows(n, players=6, seed=0):
    rng = random.Random(seed)
    return [(i, 1 + i * 25 // n, *rng.sample("ABCDEFGH"[:players], 2), rng.choice(["Hard", "Clay"]), rng.randint(0, 1)) for i in range(n)]


def test_ratings_equal_a_sequential_run_whatever_the_partitions(spark):
    rows = random_rows(120)
    m = matches(spark, random.Random(1).sample(rows, len(rows))).repartition(7)
    close(by_key(ratings.elo(m), "elo_p1", "elo_p2"), sequential(rows))


def leagues(n, seed=2):
    """Matches of three groups of players that never meet."""
    rng = random.Random(seed)
    return [(i, 1 + i * 25 // n, *(f"{g}{x}" for x in rng.sample(range(5), 2)), rng.choice(["Hard", "Clay", "Grass"]), rng.randint(0, 1)) for i in range(n) for g in [rng.choice("XYZ")]]


def test_slices_and_groups_change_no_rating(spark):
    for rows in (random_rows(150, seed=4), leagues(150)):
        m = matches(spark, rows).repartition(5)
        n, names = ratings.match_counts(m), ("r1", "r2", "d1", "d2", "v1", "v2")
        for how in ({}, {"by_surface": True}):
            whole = {k: tuple(-1 if x is None else x for x in v) for k, v in by_key(ratings.fold(m, n, **how), *names).items()}
            assert len(whole) == 150
            cut = ratings.fold(m, n, slice_rows=50, **how)
            close({k: tuple(-1 if x is None else x for x in v) for k, v in by_key(cut, *names).items()}, whole)


def test_a_slice_reads_its_own_matches_and_all_players_pass_through(spark, monkeypatch):
    rows = random_rows(60, seed=5)
    rows += [(60 + i, 25, "Y", "Z", "Hard", 1) for i in range(60)] + [(120 + r[0], 26, *r[2:]) for r in random_rows(60, seed=6)]
    calls, keep = [], ratings.stored
    monkeypatch.setattr(ratings, "stored", lambda df, *by: calls.append(by) or keep(df, *by))
    m = matches(spark, rows).repartition(5)
    cut = ratings.fold(m, ratings.match_counts(m), slice_rows=60)
    assert calls == [("_slice",), ("_slice",), (), (), ()]
    names = ("r1", "r2", "v1", "v2")
    whole = by_key(ratings.fold(m, ratings.match_counts(m)), *names)
    none = lambda found: {k: tuple(-1 if x is None else x for x in v) for k, v in found.items()}
    close(none(by_key(cut, *names)), none(whole))
    close({k: v[:2] for k, v in whole.items()}, sequential(rows))


def test_a_task_lets_go_of_groups(spark):
    m = matches(spark, leagues(150))
    edges = m.withColumn("surface", F.lit("")).select(ratings._node("player_1").alias("a"), ratings._node("player_2").alias("b"))
    wide = m.withColumns({"surface": F.lit(""), "node": ratings._node("player_1"), "target": F.col("target").cast("double"), "k1": F.lit(30.0), "k2": F.lit(20.0), "start": F.lit(None).cast("double"), "recent": F.lit(None).cast("array<double>")})
    ordered = wide.withColumn("node", F.xxhash64("player_1", "surface")).join(ratings.groups(edges), "node").coalesce(1).sortWithinPartitions("group", "mk").select(*ratings._READ)
    whole, few = (sorted(map(str, ordered.mapInArrow(ratings._fold(1500.0, held), ratings._given(wide)).collect())) for held in (1 << 17, 0))
    assert whole == few and len(whole) == 150 + 15


def test_groups_never_meet(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 4), (20, 20), (-5, 4)]
    found = {r["node"]: r["group"] for r in ratings.groups(spark.createDataFrame(edges * 3, "a long, b long").repartition(5), fan=2).collect()}
    assert found == {1: -5, 2: -5, 3: -5, 4: -5, -5: -5, 10: 10, 11: 10, 12: 10, 20: 20}
    plan = ratings.elo(matches(spark, leagues(30)))._jdf.queryExecution().optimizedPlan().toString()
    assert "SinglePartition" not in plan


def test_ratings_start_from_a_state(spark):
    rows = random_rows(120, seed=8)
    m = matches(spark, rows)
    first, later = m.filter("mk < 70"), m.filter("mk >= 70")
    state = ratings.final_state(first, ratings.fold(first, ratings.match_counts(first)))
    wanted = {k: v for k, v in sequential(rows).items() if k >= 70}
    for size in (1000, 25):
        close(by_key(ratings.fold(later, ratings.match_counts(later, state), state=state, slice_rows=size), "r1", "r2"), wanted)


def test_later_matches_change_nothing_before_them(spark):
    rows = random_rows(60, seed=3)
    for f in (lambda m: ratings.elo(m), history.side_features, history.head_to_head):
        whole = {r["mk"]: r for r in f(matches(spark, rows)).collect()}
        assert all(whole[r["mk"]] == r for r in f(matches(spark, rows[:30])).collect())


def test_windows_equal_brute_force(spark):
    rows = random_rows(100, seed=5)
    found = {r["mk"]: r for r in history.side_features(matches(spark, rows)).collect()}
    past = {}
    for mk, day, a, b, _, won in rows:
        for side, p, w in ((1, a, won), (2, b, 1 - won)):
            mine = past.get(p, [])
            streak = 0
            for _, x in reversed(mine):
                if not x:
                    break
                streak += 1
            assert found[mk][f"p{side}_streak_wins"] == streak
            assert found[mk][f"p{side}_matches_last7d"] == sum(d > day - 7 for d, _ in mine)
            assert found[mk][f"p{side}_matches_last14d"] == sum(d > day - 14 for d, _ in mine)
            last = [x for _, x in mine[-5:]]
            assert found[mk][f"p{side}_form_winrate_last5"] == (pytest.approx(sum(last) / len(last)) if last else None)
        for p, w in ((a, won), (b, 1 - won)):
            past.setdefault(p, []).append((day, w))


def test_statistics_skip_nulls_and_need_three_values(spark):
    rows = spark.createDataFrame([(i, datetime.date(2024, 1, 1 + i), "A", "B", "Hard" if i < 3 else "Clay", 1, v, None) for i, v in enumerate([4.0, None, 6.0, 8.0, None, 1.0])], SCHEMA + ", p1_ace double, p2_ace double")
    long = history.long(rows)
    own = history.stat_means(long)
    found = {r["mk"]: (r["m"], r["s"]) for r in long.select("mk", "side", own["ace_mean"].alias("m"), own["ace_surface_mean"].alias("s")).filter("side = 1").collect()}
    assert [found[i][0] for i in range(6)] == [None, None, None, None, 6.0, 6.0]
    assert found[0][1] is None and found[1][1] == pytest.approx(4 / 3) and found[4][1] == pytest.approx(8 / 3)


def test_missing_ranks_do_not_mismatch(spark):
    df = spark.sql("select 1 mk, 1600.0D elo_p1, 1500.0D elo_p2, 1500.0D surface_elo_p1, 1500.0D surface_elo_p2, cast(null as double) p1_rank, 5.0D p2_rank union all select 2, 1600.0D, 1500.0D, 1500.0D, 1500.0D, 9.0D, 5.0D union all select 3, cast(null as double), 1500.0D, 1500.0D, 1500.0D, 9.0D, 5.0D")
    found = by_key(derived.rating_features(df), "elo_rank_mismatch", "elo_diff_clip")
    assert found == {1: (0, 100.0), 2: (1, 100.0), 3: (0, None)}


def test_self_match_is_an_error(spark):
    with pytest.raises(Exception, match="against themselves"):
        ratings.elo(matches(spark, [(1, 1, "A", "A", "Hard", 1)])).collect()


def with_stats(m):
    return m.withColumns({"p1_ace": F.when(F.col("mk") % 5 != 0, F.pmod(F.col("mk"), F.lit(9)).cast("double")), "p2_ace": F.pmod(F.col("mk") * 7, F.lit(11)).cast("double"), "p1_rank": F.col("mk") % 13 + 1.0, "p2_rank": F.col("mk") % 17 + 1.0})


def test_windows_start_from_a_state(spark):
    m = with_stats(matches(spark, random_rows(150, players=4, seed=12)))
    parts = [m.filter("mk < 50"), m.filter("mk >= 50 and mk < 90"), m.filter("mk >= 90")]
    names = ("h2h_count", "h2h_balance", "h2h_surface_count", "h2h_surface_balance", "h2h_recent3_balance")
    whole = by_key(history.head_to_head(m), *names)
    state = None
    for part in parts:
        assert by_key(history.head_to_head(part, state=state), *names).items() <= whole.items()
        state = history.head_to_head_state(part, state)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, history.head_to_head_state(m).collect()))
    sides = lambda rows: {(r["mk"], r["side"]): (r["a"], r["s"]) for r in rows.select("mk", "side", *(history.stat_means(rows)[n].alias(k) for n, k in (("ace_mean", "a"), ("ace_surface_mean", "s")))).collect()}
    wanted, state = sides(history.long(m)), history.stat_state(history.long(parts[0]))
    for part in parts[1:]:
        rows = history.long(part)
        for k, x in sides(history.seeded(rows, state)).items():
            assert x == pytest.approx(wanted[k]), k
        state = history.stat_state(rows, state)
    close({(r["player"], r["stat"], r["surface"]): (r["sum"], r["n"]) for r in state.collect()}, {(r["player"], r["stat"], r["surface"]): (r["sum"], r["n"]) for r in history.stat_state(history.long(m)).collect()})
    with pytest.raises(ValueError):
        history.head_to_head(m, by_listing=False, state=state)


def test_pipeline_carries_its_state(spark, tmp_path):
    raw = with_stats(matches(spark, random_rows(80, seed=7)))
    raw.filter("mk < 50").write.parquet(str(tmp_path / "train"))
    raw.filter("mk >= 50").write.parquet(str(tmp_path / "test"))
    train, test = (spark.read.parquet(str(tmp_path / x)) for x in ("train", "test"))
    pipeline = FeaturePipeline(swap=False)
    fitted = pipeline.fit(train)
    out = pipeline.transform(test)
    assert set(out.final.columns) == set(fitted.final.columns)
    assert {"mk", "target"} <= set(out.final.columns) and any("_pca1" in c for c in out.final.columns)
    read = [f for x in (out.full, out.final, out.h2h, out.stats, out.elo) for f in x.inputFiles()]
    assert any("/test/" in f for f in read) and not any("/train/" in f for f in read)
    names = ("h2h_count", "h2h_balance", "h2h_recent3_balance", "p1_ace_mean", "p2_ace_surface_mean")
    whole = history.head_to_head(raw).join(history.side_features(raw), "mk")
    wanted = {k: tuple(-1 if x is None else x for x in v) for k, v in by_key(whole, *names).items() if k >= 50}
    close({k: tuple(-1 if x is None else x for x in v) for k, v in by_key(out.full, *names).items()}, wanted)
    first = out.full.orderBy("mk").first()
    state = {r["player"]: r["elo"] for r in fitted.elo.collect()}
    assert first["elo_p1"] == pytest.approx(state[first["player_1"]])
    assert {r["player"]: r["n"] for r in out.elo.collect()} == {r["player"]: r["count"] for r in history.long(raw).groupBy("player").count().collect()}
    with pytest.raises(ValueError):
        FeaturePipeline().transform(raw)


def test_streamed_ratings_equal_the_batch(spark, tmp_path):
    rows = random_rows(40, seed=9)
    m = matches(spark, rows)
    for i in range(2):
        m.filter(f"mk >= {20 * i} and mk < {20 * i + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    job = stream_surface_elo(stream).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).start()
    job.processAllAvailable()
    job.stop()
    wanted = ratings.fold(m, ratings.match_counts(m), by_surface=True, fixed_k=32.0)
    close(by_key(spark.table("streamed"), "r1", "r2"), by_key(wanted, "r1", "r2"))
