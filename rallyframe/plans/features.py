"""The feature pipeline: fit on one table of matches, transform another with what was learnt."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.scratch import settled
from ..operators import derived, history, ratings, reduce
from ..sources.matches import rename_sides


@dataclass
class Features:
    """A pipeline's result: the reduced table, all features, and the state that later matches start from."""

    final: DataFrame
    full: DataFrame
    elo: DataFrame
    surface_elo: DataFrame
    h2h: DataFrame
    stats: DataFrame


@dataclass
class FeaturePipeline:
    """Rating, history and derived features of match tables (with a unique key mk and, to order them, tourney_date).

    swap: sides are dealt by a seeded coin. reduce_inflated: collinear columns go too. compat: surface ratings count as
    the original pipeline does. Ratings, head-to-head records and statistics carry over from fit to transform, form and
    load do not; components and dropped columns are those of fit. They carry over as tables in the checkpoint folder (a row a
    player, pair or statistic): transform reads no earlier match, and its own result is the state for the table after it.
    """

    swap: bool = True
    compat: bool = True
    reduce_inflated: bool = False
    components: float = 0.9
    correlated: float = 0.995
    inflated: float = 10.0
    inflated_most: int = 8
    seed: str = "swap"
    groups: dict[str, reduce.GroupState] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    fitted: Features | None = None

    def _oriented(self, raw: DataFrame) -> DataFrame:
        df = rename_sides(raw)
        df = df.fillna({"surface": "Unknown"}) if "surface" in df.columns else df.withColumn("surface", F.lit("Unknown"))
        df = columns.swap_sides(df, seed=self.seed) if self.swap else columns.harmonise_pairs(columns.coerce_sides(df))
        return df if "target" in df.columns else df.withColumn("target", F.lit(1))

    def _features(self, df: DataFrame, before: Features | None) -> Features:
        counts, surface_counts = ratings.match_counts(df), ratings.surface_counts(df, self.compat)
        elo_fold = settled(ratings.fold(ratings.reject_self_matches(df), counts, state=before.elo if before else None))
        surface_fold = settled(ratings.fold(ratings.reject_self_matches(df), surface_counts, by_surface=True, state=before.surface_elo if before else None))
        full = history.head_to_head(df, state=before.h2h if before else None)
        rows = history.numbered(history.long(df))
        sides = history.seeded(rows, before.stats) if before else rows
        new = history.form(sides) | history.stat_means(sides)
        side_columns = history.wide(sides.select("mk", "side", *(c.alias(n) for n, c in new.items())), list(new))
        for part in (ratings._named(elo_fold, ""), ratings._named(surface_fold, "surface_"), side_columns):
            full = full.join(part, "mk")
        full = derived.stat_ratios(derived.form_differences(derived.rating_features(full)))
        state = dict(
            elo=ratings.final_state(df, elo_fold, before=before.elo if before else None),
            surface_elo=ratings.final_state(df, surface_fold, True, before=before.surface_elo if before else None),
            h2h=history.head_to_head_state(df, before.h2h if before else None),
            stats=history.stat_state(rows, before.stats if before else None),
        )
        return Features(final=full, full=full, **{k: settled(x) for k, x in state.items()})

    def fit(self, raw: DataFrame) -> Features:
        df = self._oriented(raw)
        out = self._features(df, None)
        reduced, self.groups = reduce.group_components(out.full, threshold=self.components)
        numbers = reduced.select(*columns.numeric_columns(reduced))
        numbers, self.dropped = reduce.drop_constant_and_correlated(numbers, self.correlated)
        if self.reduce_inflated:
            more = reduce.inflated_columns(numbers, [c for c in numbers.columns if c not in ("mk", "target")], self.inflated, self.inflated_most)
            numbers, self.dropped = numbers.drop(*more), self.dropped + more
        self.fitted = out
        out.final = numbers
        return out

    def transform(self, raw: DataFrame) -> Features:
        if self.fitted is None:
            raise ValueError("fit comes first")
        out = self._features(self._oriented(raw), self.fitted)
        reduced, _ = reduce.group_components(out.full, self.groups, train=False)
        out.final = reduced.select(*columns.numeric_columns(reduced)).drop(*self.dropped)
        return out
