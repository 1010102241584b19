"""Descriptive reports, each a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Month labels.
MONTHS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")


def counts_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """name, n; rows without the key are left out."""
    return df.filter(key.isNotNull()).groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(name)


def shares_by(df: DataFrame, key: str) -> DataFrame:
    """key, n, share of all in percent, most first."""
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), key)


def counts_by_month(df: DataFrame, date: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, MONTHS)), F.col("month"))
    return counts_by(df, F.month(date), "month").withColumn("label", label)


def top(df: DataFrame, key: Column, name: str, k: int = 10) -> DataFrame:
    """The k most frequent values."""
    return df.filter(key.isNotNull()).groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(k)


def winner(df: DataFrame, first: str, second: str) -> Column:
    """The first side's value where it won, else the second's."""
    return F.when(F.col("target") == 1, F.col(first)).otherwise(F.col(second))


def general(df: DataFrame, date: str) -> DataFrame:
    year = F.year(date)
    return df.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.countDistinct(year).alias("years"), F.count(F.lit(1)).alias("matches"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, n of equal widths between the extremes, the last bin closed; empty bins are left out."""
    span = df.agg(F.min(column).cast("double").alias("_low"), F.max(column).cast("double").alias("_high"))
    at = F.least(F.floor((F.col(column) - F.col("_low")) / ((F.col("_high") - F.col("_low")) / bins)), F.lit(bins - 1))
    own = F.when(F.col("_high") > F.col("_low"), at).otherwise(0).cast("int")
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def player_stats(rows: DataFrame, players: Sequence | None = None) -> DataFrame:
    """Per player of a long table with elo: matches, wins, losses, win_rate, avg_elo, max_elo, career; best rate first."""
    own = rows if players is None else rows.filter(F.col("player").isin(list(players)))
    year = F.year("tourney_date")
    found = own.groupBy("player").agg(F.count(F.lit(1)).alias("matches"), F.sum("won").alias("wins"), F.avg("won").alias("win_rate"), F.avg("elo").alias("avg_elo"), F.max("elo").alias("max_elo"), F.min(year).alias("_a"), F.max(year).alias("_b"))
    career = F.coalesce(F.concat(F.col("_a").cast("string"), F.lit("-"), F.col("_b").cast("string")), F.lit("-"))
    return found.select("player", "matches", "wins", (F.col("matches") - F.col("wins")).alias("losses"), "win_rate", "avg_elo", "max_elo", career.alias("career")).orderBy(F.desc("win_rate"), "player")


def yearly_rates(rows: DataFrame, least: int = 10) -> DataFrame:
    """player, year, n, win_rate of years with at least so many matches."""
    return rows.groupBy("player", F.year("tourney_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("won").alias("win_rate")).filter(F.col("n") >= least)


def surface_grid(rows: DataFrame, players: Sequence | None = None, surfaces: Sequence[str] = ("Hard", "Clay", "Grass")) -> DataFrame:
    """player, surface, win_rate of every combination, 0 where there is no match; players: all that occur, if not given."""
    own = rows if players is None else rows.filter(F.col("player").isin(list(players)))
    there = own.select("player") if players is None else rows.sparkSession.createDataFrame([(p,) for p in players], f"player {rows.schema['player'].dataType.simpleString()}")
    grid = there.distinct().select("player", F.explode(F.array(*map(F.lit, surfaces))).alias("surface"))
    found = own.filter(F.col("surface").isin(list(surfaces))).groupBy("player", "surface").agg(F.avg("won").alias("r"))
    return grid.join(found, ["player", "surface"], "left").select("player", "surface", F.coalesce("r", F.lit(0.0)).alias("win_rate"))


def head_to_head_matrix(rows: DataFrame, players: Sequence | None = None) -> DataFrame:
    """player, opp, win_share of every pair of the players chosen, 0 on the diagonal and where they never met; of all pairs that met, if none are chosen."""
    if players is None:
        return rows.groupBy("player", "opp").agg(F.avg("won").alias("win_share"))
    kind = rows.schema["player"].dataType.simpleString()
    grid = rows.sparkSession.createDataFrame([(a, b) for a in players for b in players], f"player {kind}, opp {kind}")
    found = rows.filter(F.col("player").isin(list(players)) & F.col("opp").isin(list(players))).groupBy("player", "opp").agg(F.avg("won").alias("r"))
    return grid.join(found, ["player", "opp"], "left").select("player", "opp", F.coalesce("r", F.lit(0.0)).alias("win_share"))


def errors(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """n, errors, error_rate, false_positives, false_negatives."""
    wrong = F.col(label) != F.col(predicted)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("errors"), F.avg(wrong.cast("double")).alias("error_rate"), F.count_if(wrong & (F.col(predicted) == 1)).alias("false_positives"), F.count_if(wrong & (F.col(predicted) == 0)).alias("false_negatives"))
