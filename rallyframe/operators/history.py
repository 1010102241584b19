"""What was known before each match: windows over player and pair histories, ending one row before the match."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "bpSaved", "bpFaced")
MIN_MATCHES = 3


def order_of(df: DataFrame) -> list[Column]:
    """The canonical total order: date (nulls last), tournament, match number, key."""
    there = [c for c in ("tourney_date", "tourney_id", "match_num", "mk") if c in df.columns]
    return [F.col(c).asc_nulls_last() for c in there]


def prior(keys: Sequence[str], order: Sequence[Column], last: int | None = None) -> Window:
    """The rows of equal keys before this one; only the `last` of them if given."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-last if last else Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class History:
    """A feature of a side: an aggregate over prior rows of equal keys."""

    keys: tuple[str, ...]
    value: str
    last: int | None = None
    least: int = 1
    shrink: int | None = None

    def column(self, order: Sequence[Column]) -> Column:
        over = prior(self.keys, order, self.last)
        n, mean = F.count(self.value).over(over), F.avg(self.value).over(over)
        if self.shrink:
            mean = mean * F.least(n / float(self.shrink), F.lit(1.0))
        return F.when(n >= self.least, mean) if self.least > 1 else mean


def long(matches: DataFrame) -> DataFrame:
    """Two rows for each match: mk, side, player, opp, surface, tourney_date, won, and the side's statistics."""
    there = [c for c in ("tourney_date", "tourney_id", "match_num", "mk", "split") if c in matches.columns]
    surface = F.coalesce("surface", F.lit("Unknown")) if "surface" in matches.columns else F.lit("Unknown")
    target = F.col("target") if "target" in matches.columns else F.lit(1)
    stats = [s for s in STATS if f"p1_{s}" in matches.columns and f"p2_{s}" in matches.columns]
    sides = [
        F.struct(F.lit(a).alias("side"), F.col(f"player_{a}").alias("player"), F.col(f"player_{b}").alias("opp"), (target if a == 1 else 1 - target).alias("won"), *(F.col(f"p{a}_{s}").alias(s) for s in stats))
        for a, b in ((1, 2), (2, 1))
    ]
    return matches.select(*there, surface.alias("surface"), F.explode(F.array(*sides)).alias("_s")).select(*there, "surface", "_s.*")


def wide(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """mk and p1_/p2_ columns from one row a side: one regrouping."""
    return rows.groupBy("mk").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"p{s}_{c}") for s in (1, 2) for c in names))


def head_to_head(matches: DataFrame, by_listing: bool = True, state: DataFrame | None = None) -> DataFrame:
    """h2h_* columns for each match. by_listing: a win counts for who was listed first then; else for the smaller player.

    state: what head_to_head_state gave for all earlier matches; the windows then start from its counts, its last results
    stand before theirs, and earlier matches are not needed. It holds results by listing only.
    """
    if state is not None and not by_listing:
        raise ValueError("the state counts wins by listing")
    order = order_of(matches)
    surface = F.coalesce("surface", F.lit("Unknown")) if "surface" in matches.columns else F.lit("Unknown")
    target = F.col("target") if "target" in matches.columns else F.lit(1)
    sign = 2 * target - 1 if by_listing else F.when(F.col("player_1") <= F.col("player_2"), 2 * target - 1).otherwise(1 - 2 * target)
    own = matches.withColumns({"_lo": F.least("player_1", "player_2"), "_hi": F.greatest("player_1", "player_2"), "_sf": surface, "_w": sign})
    pair, on_surface, recent = prior(("_lo", "_hi"), order), prior(("_lo", "_hi", "_sf"), order), prior(("_lo", "_hi"), order, 3)
    count, balance = (lambda w: F.count(F.lit(1)).over(w)), (lambda w: F.coalesce(F.sum("_w").over(w), F.lit(0)).cast("long"))
    before = dict.fromkeys(("count", "balance", "surface_count", "surface_balance", "recent"), F.lit(0))
    if state is not None:
        on = F.struct(F.col("surface"), F.struct("count", (2 * F.col("listed_p1_wins") - F.col("count")).alias("balance")))
        pairs = state.groupBy(F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).agg(F.map_from_entries(F.collect_list(on)).alias("_on"), F.first("recent").alias("_recent"))
        own = own.join(pairs, ["_lo", "_hi"], "left")
        total = lambda c: F.coalesce(F.aggregate(F.map_values("_on"), F.lit(0).cast("long"), lambda s, x: s + x[c]), F.lit(0))
        here = lambda c: F.coalesce(F.try_element_at("_on", F.col("_sf"))[c], F.lit(0))
        missing = F.greatest(F.lit(0).cast("long"), 3 - count(pair)).cast("int")  # of the last three, those before the table
        tail = F.slice("_recent", -F.least(missing, F.size("_recent")), missing)
        last = F.when((missing > 0) & (F.size("_recent") > 0), F.aggregate(tail, F.lit(0).cast("long"), lambda s, x: s + 2 * x - 1)).otherwise(0)
        before = {"count": total("count"), "balance": total("balance"), "surface_count": here("count"), "surface_balance": here("balance"), "recent": last}
    return own.select(
        *matches.columns,
        (count(pair) + before["count"]).alias("h2h_count"),
        (balance(pair) + before["balance"]).alias("h2h_balance"),
        (count(on_surface) + before["surface_count"]).alias("h2h_surface_count"),
        (balance(on_surface) + before["surface_balance"]).alias("h2h_surface_balance"),
        (balance(recent) + before["recent"]).alias("h2h_recent3_balance"),
    )


def head_to_head_state(matches: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """lo, hi, surface, count, listed_p1_wins, recent (results, the latest last): what later matches need of these and of those before."""
    order = [c for c in ("tourney_date", "tourney_id", "match_num", "mk") if c in matches.columns]
    rows = matches.select(F.least("player_1", "player_2").alias("lo"), F.greatest("player_1", "player_2").alias("hi"), F.coalesce("surface", F.lit("Unknown")).alias("surface"), F.col("target").cast("long").alias("target"), *order)
    back = Window.partitionBy("lo", "hi").orderBy(*(F.col(c).desc_nulls_first() for c in order))
    recent = rows.withColumn("_n", F.row_number().over(back)).filter("_n <= 3").groupBy("lo", "hi").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_n", "target")))), lambda x: x["target"]).alias("recent"))
    totals = rows.groupBy("lo", "hi", "surface").agg(F.count(F.lit(1)).alias("count"), F.sum("target").alias("listed_p1_wins"))
    if before is not None:
        totals = totals.unionByName(before.select(*totals.columns)).groupBy("lo", "hi", "surface").agg(F.sum("count").alias("count"), F.sum("listed_p1_wins").alias("listed_p1_wins"))
        old = before.groupBy("lo", "hi").agg(F.first("recent").alias("_old"))
        both = F.concat(F.coalesce("_old", F.array().cast("array<bigint>")), F.coalesce("recent", F.array().cast("array<bigint>")))
        recent = recent.join(old, ["lo", "hi"], "full_outer").select("lo", "hi", F.slice(both, -F.least(F.lit(3), F.size(both)), 3).alias("recent"))
    return totals.join(recent, ["lo", "hi"])


def stat_means(rows: DataFrame, min_matches: int = MIN_MATCHES) -> dict[str, Column]:
    """<stat>_mean over all prior values, and ace_surface_mean on the surface, shrunk below min_matches values. Of rows that `seeded` gave, values before the table count too."""
    order, there = order_of(rows), [s for s in STATS if s in rows.columns]
    if "_seed" not in rows.columns:
        out = {f"{s}_mean": History(("player",), s, least=min_matches).column(order) for s in there}
        return out | ({"ace_surface_mean": History(("player", "surface"), "ace", shrink=min_matches).column(order)} if "ace" in there else {})

    def mean(keys: tuple[str, ...], s: str, name: Column) -> tuple[Column, Column]:
        seed = F.try_element_at("_seed", name)
        n = F.count(s).over(prior(keys, order)) + F.coalesce(seed["n"], F.lit(0))
        total = F.coalesce(F.sum(F.col(s).cast("double")).over(prior(keys, order)), F.lit(0.0)) + F.coalesce(seed["sum"], F.lit(0.0))
        return n, F.when(n > 0, total / n)

    out = {}
    for s in there:
        n, x = mean(("player",), s, F.lit(s))
        out[f"{s}_mean"] = F.when(n >= min_matches, x)
    if "ace" in there:
        n, x = mean(("player", "surface"), "ace", F.concat(F.lit("ace|"), F.col("surface")))
        out["ace_surface_mean"] = x * F.least(n / float(min_matches), F.lit(1.0))
    return out


def seeded(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The rows with _seed, their player's sums and counts of stat_state by stat and by stat|surface."""
    entry = F.struct(F.concat_ws("|", "stat", "surface"), F.struct("sum", "n"))
    by = state.filter("stat is not null").groupBy(F.col("player").alias("_player")).agg(F.map_from_entries(F.collect_list(entry)).alias("_seed"))
    return rows.join(by, F.col("player").eqNullSafe(F.col("_player")), "left").drop("_player")


def stat_state(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """player, stat, surface (null: all), sum, n of these rows and of those before."""
    there = [s for s in STATS if s in rows.columns]
    tall = rows.select("player", "surface", F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("x")) for s in there))).alias("_e")).select("player", "surface", "_e.*").filter("x is not null")
    own = tall.rollup("player", "stat", "surface").agg(F.sum("x").alias("sum"), F.count("x").alias("n"), F.grouping_id().alias("_g")).filter("_g <= 1").drop("_g")
    return own if before is None else own.unionByName(before).groupBy("player", "stat", "surface").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))


def form(rows: DataFrame) -> dict[str, Column]:
    """Win rates of recent matches, the running streak, rest days and recent load."""
    order = order_of(rows)
    player, own = ("player",), Window.partitionBy("player").orderBy(*order)
    out = {
        "form_winrate_last5": History(player, "won", last=5).column(order),
        "form_winrate_last10": History(player, "won", last=10).column(order),
        "surface_wr_all": History(("player", "surface"), "won").column(order),
        "surface_wr_last5": History(("player", "surface"), "won", last=5).column(order),
        # the streak is what lies between this match and the last one that was not won
        "streak_wins": (F.row_number().over(own) - 1 - F.coalesce(F.max(F.when(F.col("won") != 1, F.col("_rn"))).over(prior(player, order)), F.lit(0))).cast("long"),
    }
    if "tourney_date" in rows.columns:
        out["days_since_last"] = F.datediff("tourney_date", F.lag("tourney_date").over(own)).cast("long")
        day = F.unix_date("tourney_date")
        same_day = F.row_number().over(Window.partitionBy("player", "tourney_date").orderBy(*order)) - 1
        for n in (7, 14):  # days after d - n, and earlier matches of the day itself
            before = F.count(F.lit(1)).over(Window.partitionBy("player").orderBy(day).rangeBetween(-(n - 1), -1))
            out[f"matches_last{n}d"] = F.when(F.col("tourney_date").isNotNull(), before + same_day).otherwise(0).cast("long")
    else:
        out |= {"days_since_last": F.lit(None).cast("long"), "matches_last7d": F.lit(None).cast("long"), "matches_last14d": F.lit(None).cast("long")}
    return out


def numbered(rows: DataFrame, keys: Sequence[str] = ("player",)) -> DataFrame:
    """With _rn, the match's number in the player's history."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_of(rows))))


def side_features(matches: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """mk and all form, load and statistics columns of both sides: windows by player and by player and surface share one shuffle."""
    rows = numbered(long(matches))
    new = form(rows) | stat_means(rows, min_matches)
    return wide(rows.select("mk", "side", *(c.alias(n) for n, c in new.items())), list(new))
