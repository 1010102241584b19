"""Features of a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "bpSaved", "bpFaced")
#: name: (first column's differences, bound) of the scaled load differences.
SCALES = {"matches_last7d_diff": 5.0, "matches_last14d_diff": 10.0, "days_since_last_diff": 30.0}


def clipped(x: Column, bound: float) -> Column:
    """Within +-bound; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def rank_features(df: DataFrame) -> DataFrame:
    """rank_diff, rank_ratio, log_rank_ratio; neutral values where the table has no ranks."""
    if "p1_rank" not in df.columns or "p2_rank" not in df.columns:
        return df.withColumns({"rank_diff": F.lit(0.0), "rank_ratio": F.lit(1.0), "log_rank_ratio": F.lit(0.0)})
    a, b = (F.col(f"p{s}_rank").try_cast("double") for s in (1, 2))
    return df.withColumns({"rank_diff": b - a, "rank_ratio": F.try_divide(b + 1, a + 1), "log_rank_ratio": F.log1p(b) - F.log1p(a)})


def rating_features(df: DataFrame) -> DataFrame:
    """Clipped rating differences, win probabilities, squares, their interplay with each other and with ranks."""
    zero = {c: F.lit(0.0) for c in ("elo_vol5_diff", "surface_elo_vol5_diff") if c not in df.columns}
    df = df.withColumns(zero) if zero else df
    df = df.withColumns({f"{p}elo_diff_clip": clipped(F.col(f"{p}elo_p1") - F.col(f"{p}elo_p2"), 400.0) for p in ("", "surface_")})
    df = rank_features(df)
    clip, on_surface = F.col("elo_diff_clip"), F.col("surface_elo_diff_clip")
    against = lambda c: F.coalesce(c, F.lit(False)).cast("int")  # noqa: E731  a missing rank agrees with any rating
    return df.withColumns(
        {f"{p}elo_prob": 1 / (1 + F.pow(F.lit(10.0), -F.col(f"{p}elo_diff_clip") / 400)) for p in ("", "surface_")}
        | {f"{p}elo_diff_sq": F.pow(F.col(f"{p}elo_diff_clip") / 100, F.lit(2.0)) for p in ("", "surface_")}
        | {
            "elo_surface_interaction": clip * on_surface / 10000,
            "elo_consistency": F.abs(clip - on_surface),
            "elo_rank_mismatch": against((clip > 0) & (F.col("rank_diff") < 0)) - against((clip < 0) & (F.col("rank_diff") > 0)),
            "match_competitiveness": 1 / (1 + F.abs(clip) / 120),
        }
    )


def form_differences(df: DataFrame) -> DataFrame:
    """p1 less p2 of form and load, scaled loads, and their combinations."""
    names = {"form_last5": "form_winrate_last5", "form_last10": "form_winrate_last10"} | {x: x for x in ("surface_wr_all", "surface_wr_last5", "streak_wins", "days_since_last", "matches_last7d", "matches_last14d")}
    df = df.withColumns({f"{to}_diff": F.col(f"p1_{c}") - F.col(f"p2_{c}") for to, c in names.items()})
    df = df.withColumns({f"{c}_scaled": clipped(F.col(c).cast("double"), b) / b for c, b in SCALES.items()})
    df = df.withColumn("matches_recent_weighted", 0.6 * F.col("matches_last7d_diff_scaled") + 0.4 * F.col("matches_last14d_diff_scaled"))
    weight = F.col("elo_prob") if "elo_prob" in df.columns else F.lit(1.0)
    return df.withColumn("elo_matches_interaction", weight * F.col("matches_recent_weighted"))


def stat_ratios(df: DataFrame) -> DataFrame:
    """<stat>_ratio: the first side's mean over the second's."""
    return df.withColumns({f"{s}_ratio": F.try_divide(F.col(f"p1_{s}_mean"), F.col(f"p2_{s}_mean") + 1e-6) for s in STATS if f"p1_{s}_mean" in df.columns})
