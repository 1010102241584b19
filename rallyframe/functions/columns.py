"""Column work on match tables: coercion, alignment, the swap of sides, selection by name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Feature groups.
GROUPS = {
    "ace_df": ["p1_ace_mean", "p2_ace_mean", "p1_df_mean", "p2_df_mean", "p1_ace_surface_mean", "p2_ace_surface_mean"],
    "serve": ["p1_svpt_mean", "p2_svpt_mean", "p1_1stIn_mean", "p2_1stIn_mean", "p1_1stWon_mean", "p2_1stWon_mean", "p1_2ndWon_mean", "p2_2ndWon_mean"],
    "breakpoints": ["p1_bpSaved_mean", "p2_bpSaved_mean", "p1_bpFaced_mean", "p2_bpFaced_mean"],
    "elo_core": ["elo_prob", "surface_elo_prob", "elo_diff_clip", "surface_elo_diff_clip", "elo_diff_sq", "surface_elo_diff_sq", "elo_surface_interaction", "elo_consistency", "elo_vol5_diff", "surface_elo_vol5_diff"],
    "ranking": ["rank_diff", "rank_ratio", "log_rank_ratio", "elo_rank_mismatch"],
    "h2h": ["h2h_count", "h2h_balance", "h2h_surface_count", "h2h_surface_balance", "h2h_recent3_balance"],
    "recent_form": ["form_last5_diff", "form_last10_diff", "surface_wr_all_diff", "surface_wr_last5_diff", "streak_wins_diff"],
    "fatigue": ["matches_recent_weighted", "days_since_last_diff_scaled", "elo_matches_interaction"],
    "fatigue_raw": ["matches_last7d_diff", "matches_last14d_diff", "days_since_last_diff", "matches_last7d_diff_scaled", "matches_last14d_diff_scaled"],
    "match_context": ["match_competitiveness"],
}
CURATED = [c for g in GROUPS.values() for c in g if c not in ("matches_last7d_diff_scaled", "matches_last14d_diff_scaled")]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def to_number(column: Column) -> Column:
    """A double, null where the value is none."""
    return column.try_cast("double")


def coerce_sides(df: DataFrame, share: float = 0.95) -> DataFrame:
    """Text columns of the sides become numbers if all their values are plain numbers, or at least `share` of all rows are numbers.

    Columns that end in name or hand stay. One aggregation looks at all columns.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name.startswith(("p1_", "p2_")) and not f.name.endswith(("name", "hand"))]
    if not text:
        return df
    plain = [F.coalesce(F.bool_and(F.col(c).rlike(r"^-?\d+(\.\d+)?$")), F.lit(False)).alias(f"{c}_plain") for c in text]
    parsed = [F.avg(F.when(to_number(F.col(c)).isNotNull(), 1.0).otherwise(0.0)).alias(f"{c}_parsed") for c in text]
    seen = df.agg(*plain, *parsed).first()
    return df.withColumns({c: to_number(F.col(c)) for c in text if seen[f"{c}_plain"] or (seen[f"{c}_parsed"] or 0) >= share})


def pairs(df: DataFrame) -> list[tuple[str, str]]:
    """Columns that tell the same of either side."""
    there = set(df.columns)
    own = [(c, f"p2_{c[3:]}") for c in df.columns if c.startswith("p1_") and f"p2_{c[3:]}" in there]
    more = [("player_1", "player_2"), ("player_1_id", "player_2_id"), ("player_1_hand", "player_2_hand"), ("elo_p1", "elo_p2"), ("surface_elo_p1", "surface_elo_p2")]
    return own + [(a, b) for a, b in more if a in there and b in there]


def harmonise_pairs(df: DataFrame) -> DataFrame:
    """Where the types of a pair differ: doubles if either side has a numeric value, else strings."""
    types = dict(df.dtypes)
    odd = [(a, b) for a, b in pairs(df) if types[a] != types[b]]
    if not odd:
        return df
    seen = df.agg(*(F.max(to_number(F.coalesce(F.col(a).cast("string"), F.col(b).cast("string"))).isNotNull() | to_number(F.col(a).cast("string")).isNotNull() | to_number(F.col(b).cast("string")).isNotNull()).alias(a) for a, b in odd)).first()
    return df.withColumns({c: to_number(F.col(c).cast("string")) if seen[a] else F.col(c).cast("string") for a, b in odd for c in (a, b)})


def coin(key: Column, seed: str = "swap") -> Column:
    """A fair coin for a key, the same everywhere."""
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 1) < "8"


def swap_sides(df: DataFrame, key: str = "mk", seed: str = "swap") -> DataFrame:
    """Swaps the sides, ids and hands included, of the rows that the coin chooses, and flips their target (1 if missing)."""
    df = harmonise_pairs(coerce_sides(df))
    chosen = coin(F.col(key), seed)
    new: dict[str, Column] = {}
    for a, b in pairs(df):
        new[a], new[b] = F.when(chosen, F.col(b)).otherwise(F.col(a)), F.when(chosen, F.col(a)).otherwise(F.col(b))
    target = F.col("target") if "target" in df.columns else F.lit(1)
    return df.withColumns(new | {"target": F.when(chosen, 1 - target).otherwise(target)})


def curated(df: DataFrame) -> list[str]:
    """Selected feature names: those listed, with any suffix, in the frame's order; then components of each group."""
    known = re.compile(f"(?:{'|'.join(map(re.escape, CURATED))})(_\\w+)?")
    components = [c for g in GROUPS for c in df.columns if re.fullmatch(f"{re.escape(g)}_pca\\d+", c)]
    return [c for c in df.columns if known.fullmatch(c) and c not in components] + components


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    there = set(b.columns)
    return [c for c in a.columns if c in there]


def aligned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns asked for, 0 where the frame has none."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns))


def finite(column: Column) -> Column:
    """Null for infinite and not-a-number values."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def tagged(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))
