"""Surface ratings of a stream of matches: state by surface, matches in order of their key within each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "mk long, surface string, r1 double, r2 double"


def stream_surface_elo(matches: DataFrame, k: float = 32.0, initial: float = 1500.0) -> DataFrame:
    """mk, surface, r1, r2: ratings before each match. Columns mk, surface, player_1, player_2 (strings), target.

    The state holds one number for each of a surface's players.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values = state.get if state.exists else ([], [])
        ratings = dict(zip(names, values, strict=True))
        rows = pd.concat(list(batches)).sort_values("mk")
        out = []
        for mk, a, b, won in rows[["mk", "player_1", "player_2", "target"]].itertuples(index=False):
            r1, r2 = ratings.get(a, initial), ratings.get(b, initial)
            change = k * (won - 1.0 / (1.0 + 10.0 ** ((r2 - r1) / 400.0)))
            ratings[a], ratings[b] = r1 + change, r2 - change
            out.append((mk, key[0], r1, r2))
        state.update((list(ratings), list(ratings.values())))
        yield pd.DataFrame(out, columns=["mk", "surface", "r1", "r2"])

    rows = matches.select("mk", F.coalesce("surface", F.lit("Unknown")).alias("surface"), F.col("player_1").cast("string").alias("player_1"), F.col("player_2").cast("string").alias("player_2"), F.col("target").cast("double").alias("target"))
    return rows.groupBy("surface").applyInPandasWithState(update, _OUT, "names array<string>, ratings array<double>", "append", GroupStateTimeout.NoTimeout)
