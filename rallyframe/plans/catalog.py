"""The named queries of the library over the driver's tables, and the same in DuckDB SQL.

Matches come from the events table: rows 2k and 2k + 1 are the two sides of match k.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns
from ..functions.parallel import concurrently
from ..functions.scratch import settled, stored
from ..operators import audit, derived, history, metrics, models, ratings, reduce, reports, validate
from ..operators.boosting import HistogramBoosting
from ..sources import matches as sources

_M = """select a.event_id // 2 as mk, cast(a.ts as date) as tourney_date, a.ts as ts, a.user_id as player_1, b.user_id as player_2,
 case a.event_type when 'click' then 'Hard' when 'view' then 'Clay' when 'purchase' then 'Grass' when 'signup' then 'Carpet' else 'Unknown' end as surface,
 case when a.value > b.value then 1 else 0 end as target,
 cast(json_extract_string(a.props, '$.k') as int) + 1 as p1_rank, cast(json_extract_string(b.props, '$.k') as int) + 1 as p2_rank,
 case when a.user_id % 11 = 0 then null else floor(a.value) % 20 end as p1_ace, case when b.user_id % 11 = 0 then null else floor(b.value) % 20 end as p2_ace,
 case when a.user_id % 7 = 0 then null else floor(a.value) % 9 end as p1_df, case when b.user_id % 7 = 0 then null else floor(b.value) % 9 end as p2_df,
 60 + floor(a.value) % 120 as minutes
 from events a join events b on b.event_id = a.event_id + 1 where a.event_id % 2 = 0 and a.user_id <> b.user_id"""
_WITH = f"with m as ({_M})"
_LONG = f"""{_WITH}, l as (select mk, tourney_date, surface, 1 as side, player_1 as player, player_2 as opp, target as won, p1_ace as ace, p1_df as df from m
 union all select mk, tourney_date, surface, 2, player_2, player_1, 1 - target, p2_ace, p2_df from m)"""
_BEFORE = "rows between unbounded preceding and 1 preceding"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_SURFACES = {"click": "Hard", "view": "Clay", "purchase": "Grass", "signup": "Carpet"}


def match_view(spark: SparkSession, sf: str) -> DataFrame:
    """One scan and one hash aggregation of numbers; what follows by mk finds its rows where they are, and columns that nothing reads are not gathered."""
    kind = F.coalesce(*(F.when(F.col("event_type") == e, i) for i, e in enumerate(_SURFACES)), F.lit(len(_SURFACES)))
    raw = table(spark, sf, "events").select("event_id", "ts", "user_id", "value", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    side = lambda s, c: F.max(F.when(F.col("event_id") % 2 == s, F.col(c)))
    wanted = {"ts": ("ts", 0), "player_1": ("user_id", 0), "player_2": ("user_id", 1), "v1": ("value", 0), "v2": ("value", 1), "kind": ("kind", 0), "k1": ("k", 0), "k2": ("k", 1)}
    pairs = raw.groupBy(F.expr("event_id div 2").alias("mk")).agg(*(side(s, c).alias(n) for n, (c, s) in wanted.items())).filter("player_1 <> player_2")
    return pairs.select(
        "mk", F.to_date("ts").alias("tourney_date"), "ts", "player_1", "player_2",
        F.element_at(F.array(*map(F.lit, [*_SURFACES.values(), "Unknown"])), F.col("kind") + 1).alias("surface"),
        F.when(F.col("v1") > F.col("v2"), 1).otherwise(0).alias("target"), (F.col("k1") + 1).alias("p1_rank"), (F.col("k2") + 1).alias("p2_rank"),
        *(F.expr(f"case when player_{i} % {m} = 0 then null else floor(v{i}) % {n} end").alias(f"p{i}_{c}") for c, m, n in (("ace", 11, 20), ("df", 7, 9)) for i in (1, 2)),
        F.expr("60 + floor(v1) % 120").alias("minutes"),
    )


def r6(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


# -- cleaning and orientation


@query("select distinct case when l_linenumber % 3 = 0 then 'Unknown' else l_returnflag end as surface, coalesce(case when l_linestatus = 'O' then l_linestatus end, 'U') as tourney_level, l_partkey from lineitem")
def clean_fill_dedupe(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("surface"), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).alias("tourney_level"), "l_partkey", F.lit(None).cast("string").alias("winner_entry"))
    return sources.clean(raw).dropDuplicates()


@query("select o_orderkey, case when o_orderkey % 10 = 0 then null else cast(o_orderdate as date) end as tourney_date from orders")
def parse_dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("20241301")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf, "orders").select("o_orderkey", sources.parse_date(text).alias("tourney_date"))


@query(f"{_WITH} select mk, player_1, player_2, p1_rank, p2_rank, p1_ace, p2_ace, target from m")
def rename_orient(spark, sf):
    back = {"player_1": "winner_name", "player_2": "loser_name", "p1_rank": "winner_rank", "p2_rank": "loser_rank", "p1_ace": "w_ace", "p2_ace": "l_ace", "target": "y"}
    raw = match_view(spark, sf).select("mk", *back).withColumnsRenamed(back)
    return sources.rename_sides(raw)


@query(f"""{_WITH}, c as (select *, substr(md5('swap:' || cast(mk as varchar)), 1, 1) < '8' as s from m)
 select mk, case when s then player_2 else player_1 end as player_1, case when s then player_1 else player_2 end as player_2,
 case when s then p2_rank else p1_rank end as p1_rank, case when s then p1_rank else p2_rank end as p2_rank, case when s then 1 - target else target end as target from c""")
def swap_sides(spark, sf):
    return columns.swap_sides(match_view(spark, sf)).select("mk", "player_1", "player_2", "p1_rank", "p2_rank", "target")


@query("select event_id, case when event_id % 50 = 0 then null else cast(event_id as double) end as p1_seed from events")
def numeric_coerce(spark, sf):
    text = F.when(F.col("event_id") % 50 == 0, F.concat(F.col("event_id").cast("string"), F.lit("Q"))).otherwise(F.col("event_id").cast("string"))
    return columns.coerce_sides(table(spark, sf, "events").select("event_id", text.alias("p1_seed")))


@query("select c_custkey as k, c_acctbal as bal, c_mktsegment as seg, null::bigint as nation from customer union all by name select s_suppkey as k, s_acctbal as bal, null::varchar as seg, cast(s_nationkey as bigint) as nation from supplier")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").selectExpr("c_custkey k", "c_acctbal bal", "c_mktsegment seg")
    b = table(spark, sf, "supplier").selectExpr("s_acctbal bal", "cast(s_nationkey as bigint) nation", "s_suppkey k")
    return sources.union_by_name([a, b])


@query("select distinct o_custkey as k from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def semi_key_overlap(spark, sf):
    return audit.key_overlap(table(spark, sf, "customer").filter("c_acctbal > 0").selectExpr("c_custkey k"), table(spark, sf, "orders").selectExpr("o_custkey k"), "k")


@query(f"{_LONG} select mk, max(case when side = 1 then ace end) as p1_ace, max(case when side = 2 then ace end) as p2_ace, max(case when side = 1 then won end) as p1_won, max(case when side = 2 then won end) as p2_won from l group by mk")
def long_to_wide(spark, sf):
    return history.wide(history.long(match_view(spark, sf)), ["ace", "won"])


@query("select l_orderkey, l_linenumber, l_discount, l_tax, 0.0::double as missing from lineitem")
def aligned_columns(spark, sf):
    rows = table(spark, sf, "lineitem")
    return columns.aligned(rows, ["l_orderkey", "l_linenumber", "l_discount", "l_tax", "missing"])


@query("select l_orderkey, l_linenumber, l_partkey, case when l_discount = 0 then null else round(l_tax / l_discount, 6) end as ratio from lineitem")
def finite_values(spark, sf):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(columns.finite(ratio), 6).alias("ratio"))


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity, 'train' as split from lineitem where l_shipdate < '1997-01-01' union all select l_orderkey, l_linenumber, l_partkey, l_quantity, 'test' from lineitem where l_shipdate >= '1997-01-01' and l_shipdate < '1997-04-01'")
def tagged_split(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    cut = F.lit("1997-01-01").cast("date")
    train, test = rows.filter(F.col("l_shipdate") < cut), rows.filter((F.col("l_shipdate") >= cut) & (F.col("l_shipdate") < F.add_months(cut, 3)))
    return columns.tagged(train, "split", "train").unionByName(columns.tagged(test, "split", "test")).drop("l_shipdate")


# -- histories


def _h2h(names: str) -> str:
    pair = f"least(player_1, player_2), greatest(player_1, player_2)"
    w, ws, w3 = (f"over (partition by {p} order by mk {f})" for p, f in ((pair, _BEFORE), (f"{pair}, surface", _BEFORE), (pair, "rows between 3 preceding and 1 preceding")))
    own = {
        "h2h_count": f"count(*) {w}", "h2h_balance": f"cast(coalesce(sum(2 * target - 1) {w}, 0) as bigint)",
        "h2h_surface_count": f"count(*) {ws}", "h2h_surface_balance": f"cast(coalesce(sum(2 * target - 1) {ws}, 0) as bigint)",
        "h2h_recent3_balance": f"cast(coalesce(sum(2 * target - 1) {w3}, 0) as bigint)",
    }
    return ", ".join(f"{own[n]} as {n}" for n in names.split())


@query(f"{_WITH} select mk, player_1, player_2, {_h2h('h2h_count h2h_balance')} from m")
def h2h_global(spark, sf):
    return history.head_to_head(match_view(spark, sf)).select("mk", "player_1", "player_2", "h2h_count", "h2h_balance")


@query(f"{_WITH} select mk, {_h2h('h2h_surface_count h2h_surface_balance')} from m")
def h2h_surface(spark, sf):
    return history.head_to_head(match_view(spark, sf)).select("mk", "h2h_surface_count", "h2h_surface_balance")


@query(f"{_WITH} select mk, {_h2h('h2h_recent3_balance')} from m")
def h2h_recent3(spark, sf):
    return history.head_to_head(match_view(spark, sf)).select("mk", "h2h_recent3_balance")


@query(f"""{_WITH}, r as (select least(player_1, player_2) as lo, greatest(player_1, player_2) as hi, surface, target, row_number() over (partition by least(player_1, player_2), greatest(player_1, player_2) order by mk desc) as i, mk from m),
 p as (select lo, hi, array_to_string(list(target order by mk), '') as recent from r where i <= 3 group by all)
 select lo, hi, surface, count(*) as count, cast(sum(target) as bigint) as listed_p1_wins, any_value(recent) as recent from r join p using (lo, hi) group by lo, hi, surface""")
def h2h_state(spark, sf):
    return history.head_to_head_state(match_view(spark, sf)).select("lo", "hi", "surface", "count", "listed_p1_wins", F.array_join("recent", "").alias("recent"))


_W = f"over (partition by player order by mk {_BEFORE})"


@query(f"{_LONG} select mk, side, case when count(ace) {_W} >= 3 then round(avg(ace) {_W}, 6) end as ace_mean, case when count(df) {_W} >= 3 then round(avg(df) {_W}, 6) end as df_mean from l")
def prior_stat_means(spark, sf):
    rows = history.long(match_view(spark, sf))
    own = history.stat_means(rows)
    return rows.select("mk", "side", *(F.round(own[n], 6).alias(n) for n in ("ace_mean", "df_mean")))


@query(f"{_LONG} select mk, side, round(avg(ace) over w * least(count(ace) over w / 3.0, 1), 6) as ace_surface_mean from l window w as (partition by player, surface order by mk {_BEFORE})")
def surface_ace_shrunk(spark, sf):
    rows = history.long(match_view(spark, sf))
    return rows.select("mk", "side", F.round(history.stat_means(rows)["ace_surface_mean"], 6).alias("ace_surface_mean"))


@query(f"{_LONG}, a as (select mk, side, case when count(ace) {_W} >= 3 then avg(ace) {_W} end as x from l) select mk, round(max(case when side = 1 then x end) / (max(case when side = 2 then x end) + 1e-6), 4) as ace_ratio from a group by mk")
def stat_ratios(spark, sf):
    return derived.stat_ratios(history.side_features(match_view(spark, sf))).select("mk", F.round("ace_ratio", 4).alias("ace_ratio"))


@query(f"""{_LONG}, e as (select player, surface, 'ace' as stat, ace as x from l union all select player, surface, 'df', df from l)
 select player, stat, surface, cast(sum(x) as double) as sum, count(x) as n from e where x is not null group by grouping sets ((player, stat, surface), (player, stat))""")
def stat_state(spark, sf):
    return history.stat_state(history.long(match_view(spark, sf)))


#: Matches from here on are the later part of a history.
_CUT = "(select max(mk) * 3 // 4 from m)"


def _two_parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    m = match_view(spark, sf)
    cut = m.agg(F.expr("max(mk) * 3 div 4")).first()[0]
    return m.filter(F.col("mk") < F.lit(cut or 0)), m.filter(F.col("mk") >= F.lit(cut or 0))


@query(f"{_WITH}, w as (select mk, {_h2h('h2h_count h2h_balance h2h_surface_count h2h_surface_balance h2h_recent3_balance')} from m) select * from w where mk >= {_CUT}")
def h2h_from_state(spark, sf):
    """Later matches by the earlier ones' state alone."""
    first, later = _two_parts(spark, sf)
    return history.head_to_head(later, state=history.head_to_head_state(first)).select("mk", "h2h_count", "h2h_balance", "h2h_surface_count", "h2h_surface_balance", "h2h_recent3_balance")


@query(f"""{_LONG}, w as (select mk, side, case when count(ace) {_W} >= 3 then round(avg(ace) {_W}, 6) end as ace_mean, case when count(df) {_W} >= 3 then round(avg(df) {_W}, 6) end as df_mean,
 round(avg(ace) over s * least(count(ace) over s / 3.0, 1), 6) as ace_surface_mean from l window s as (partition by player, surface order by mk {_BEFORE})) select * from w where mk >= {_CUT}""")
def stats_from_state(spark, sf):
    first, later = _two_parts(spark, sf)
    rows = history.seeded(history.long(later), history.stat_state(history.long(first)))
    own = history.stat_means(rows)
    return rows.select("mk", "side", *(F.round(own[n], 6).alias(n) for n in ("ace_mean", "df_mean", "ace_surface_mean")))


@query(f"{_LONG} select mk, side, round(avg(won) over (partition by player order by mk rows between 5 preceding and 1 preceding), 6) as form_winrate_last5, round(avg(won) over (partition by player order by mk rows between 10 preceding and 1 preceding), 6) as form_winrate_last10 from l")
def form_last5_10(spark, sf):
    rows = history.numbered(history.long(match_view(spark, sf)))
    own = history.form(rows)
    return rows.select("mk", "side", *(F.round(own[n], 6).alias(n) for n in ("form_winrate_last5", "form_winrate_last10")))


@query(f"{_LONG} select mk, side, round(avg(won) over (partition by player, surface order by mk {_BEFORE}), 6) as surface_wr_all, round(avg(won) over (partition by player, surface order by mk rows between 5 preceding and 1 preceding), 6) as surface_wr_last5 from l")
def surface_form(spark, sf):
    rows = history.numbered(history.long(match_view(spark, sf)))
    own = history.form(rows)
    return rows.select("mk", "side", *(F.round(own[n], 6).alias(n) for n in ("surface_wr_all", "surface_wr_last5")))


@query(f"{_LONG}, n as (select *, row_number() over (partition by player order by mk) as rn from l) select mk, side, rn - 1 - coalesce(max(case when won <> 1 then rn end) {_W}, 0) as streak_wins from n")
def win_streak(spark, sf):
    rows = history.numbered(history.long(match_view(spark, sf)))
    return rows.select("mk", "side", history.form(rows)["streak_wins"].alias("streak_wins"))


@query(f"{_LONG} select mk, side, cast(date_diff('day', lag(tourney_date) over (partition by player order by mk), tourney_date) as bigint) as days_since_last from l")
def days_since_last(spark, sf):
    rows = history.numbered(history.long(match_view(spark, sf)))
    return rows.select("mk", "side", history.form(rows)["days_since_last"].alias("days_since_last"))


@query(f"""{_LONG}, d as (select *, date_diff('day', date '2024-01-01', tourney_date) as dd from l)
 select mk, side, count(*) over (partition by player order by dd range between 6 preceding and 1 preceding) + row_number() over (partition by player, dd order by mk) - 1 as matches_last7d,
 count(*) over (partition by player order by dd range between 13 preceding and 1 preceding) + row_number() over (partition by player, dd order by mk) - 1 as matches_last14d from d""")
def load_7_14d(spark, sf):
    rows = history.numbered(history.long(match_view(spark, sf)))
    own = history.form(rows)
    return rows.select("mk", "side", *(own[n].alias(n) for n in ("matches_last7d", "matches_last14d")))


@query(f"""{_LONG}, d as (select *, date_diff('day', date '2024-01-01', tourney_date) as dd from l), w as (select mk, side, count(*) over (partition by player order by dd range between 6 preceding and 1 preceding) + row_number() over (partition by player, dd order by mk) - 1 as a,
 count(*) over (partition by player order by dd range between 13 preceding and 1 preceding) + row_number() over (partition by player, dd order by mk) - 1 as b from d),
 p as (select mk, max(case when side = 1 then a end) - max(case when side = 2 then a end) as a, max(case when side = 1 then b end) - max(case when side = 2 then b end) as b from w group by mk)
 select mk, a as matches_last7d_diff, b as matches_last14d_diff, round(0.6 * greatest(-5, least(5, a)) / 5.0 + 0.4 * greatest(-10, least(10, b)) / 10.0, 6) as matches_recent_weighted from p""")
def fatigue_combo(spark, sf):
    df = derived.form_differences(history.side_features(match_view(spark, sf)))
    return df.select("mk", "matches_last7d_diff", "matches_last14d_diff", *r6("matches_recent_weighted"))


@query(f"{_WITH} select mk, cast(p2_rank - p1_rank as double) as rank_diff, round((p2_rank + 1.0) / (p1_rank + 1.0), 6) as rank_ratio, round(ln(1 + p2_rank) - ln(1 + p1_rank), 6) as log_rank_ratio from m")
def rank_features(spark, sf):
    return derived.rank_features(match_view(spark, sf)).select("mk", "rank_diff", *r6("rank_ratio", "log_rank_ratio"))


# -- ratings

_COUNTS = f"n as (select mk, side, count(*) over (partition by player order by mk {_BEFORE}) as n from l), k as (select mk, 24 + 18 * exp(-max(case when side = 1 then n end) / 50.0) as k1, 24 + 18 * exp(-max(case when side = 2 then n end) / 50.0) as k2 from n group by mk)"


@query(f"{_LONG}, {_COUNTS} select mk, round(k1, 6) as k1, round(k2, 6) as k2 from k")
def k_factor(spark, sf):
    n = ratings.match_counts(match_view(spark, sf))
    return n.select("mk", *(F.round(ratings.k_adaptive(F.col(f"n_{s}"), 24.0, 42.0, 50.0), 6).alias(f"k{s}") for s in (1, 2)))




def _folded(name: str, counts: str, group: str) -> str:
    """The ratings as a recursive query whose rows carry all ratings of their group so far in a map."""
    return f"""{name}k as materialized ({counts}),
 {name}o as materialized (select {group} as g, m.mk, m.player_1 as a, m.player_2 as b, m.target as t, k1, k2, row_number() over (partition by {group} order by m.mk) as i from m join {name}k using (mk)),
 {name}f as materialized (select g, cast(0 as bigint) as i, cast(null as bigint) as mk, 0.0::double as r1, 0.0::double as r2, 0.0::double as d1, 0.0::double as d2, MAP {{}}::MAP(bigint, double) as s from (select distinct g from {name}o) union all
  select g, i, mk, r1, r2, d1, d2, map_concat(s, MAP([a, b], [r1 + d1, r2 + d2])) from (select *, k1 * (t - e) as d1, k2 * ((1.0 - t) - (1.0 - e)) as d2 from (select *, 1.0 / (1.0 + power(10.0, (r2 - r1) / 400.0)) as e from
  (select o.*, f.s, coalesce(f.s[o.a], 1500.0) as r1, coalesce(f.s[o.b], 1500.0) as r2 from {name}f f join {name}o o on o.g = f.g and o.i = f.i + 1)))),
 {name}t as (select l.mk, l.side, l.player, l.surface, case when side = 1 then r1 else r2 end as r, case when side = 1 then d1 else d2 end as d, won, tourney_date from l join {name}f f on l.mk = f.mk)"""


def _factor(n: str, inner: str) -> str:
    k = lambda s: f"24 + 18 * exp(-max(case when side = {s} then {n} end) / 50.0) as k{s}"
    return f"select mk, {k(1)}, {k(2)} from (select mk, side, {inner} from l) group by mk"


_RECURSIVE = _LONG.replace("with m as", "with recursive m as", 1)
_GLOBAL = _folded("g", _factor("n", f"count(*) over (partition by player order by mk {_BEFORE}) as n"), "''")
_ON_SURFACE = _folded("u", _factor("n", f"0.7 * (count(*) over (partition by player order by mk {_BEFORE}) + count(*) over (partition by player)) + 0.3 * count(*) over (partition by player, surface order by mk {_BEFORE}) as n"), "m.surface")


def _rating_sql(name: str, prefix: str, keys: str) -> str:
    own = lambda c, s: f"max(case when side = {s} then {c} end)"
    columns = {f"{prefix}elo_p1": own("r", 1), f"{prefix}elo_p2": own("r", 2), f"{prefix}elo_diff": f"{own('r', 1)} - {own('r', 2)}", f"{prefix}elo_vol5_p1": own("v", 1), f"{prefix}elo_vol5_p2": own("v", 2)}
    if not prefix:
        columns["elo_vol5_diff"] = f"{own('v', 1)} - {own('v', 2)}"
    picked = ", ".join(f"round({x}, 6) as {c}" for c, x in columns.items())
    return f"select mk, {picked} from (select *, avg(abs(d)) over (partition by {keys} order by mk rows between 5 preceding and 1 preceding) as v from {name}t) group by mk"


def _matches(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """What ratings read of the matches, made once: counts, slices and what joins the ratings read the files."""
    return stored(match_view(spark, sf).select("mk", "tourney_date", "surface", "player_1", "player_2", "target", *more))


@query(f"{_RECURSIVE}, {_GLOBAL} {_rating_sql('g', '', 'player')}")
def elo_global(spark, sf):
    return ratings.elo(_matches(spark, sf)).select("mk", *r6("elo_p1", "elo_p2", "elo_diff", "elo_vol5_p1", "elo_vol5_p2", "elo_vol5_diff"))


@query(f"{_RECURSIVE}, {_ON_SURFACE} {_rating_sql('u', 'surface_', 'player, surface')}")
def elo_surface(spark, sf):
    return ratings.surface_elo(_matches(spark, sf)).select("mk", *r6("surface_elo_p1", "surface_elo_p2", "surface_elo_diff", "surface_elo_vol5_p1", "surface_elo_vol5_p2"))


@query(f"{_RECURSIVE}, {_GLOBAL} select player, round(arg_max(r + d, mk), 6) as elo, count(*) as n from gt group by player")
def elo_state(spark, sf):
    m = _matches(spark, sf)
    return ratings.final_state(m, ratings.fold(m, ratings.match_counts(m))).select("player", *r6("elo"), "n")


@query(f"""{_RECURSIVE}, {_GLOBAL}, {_ON_SURFACE},
 c as (select m.mk, greatest(-400.0, least(400.0, g.r1 - g.r2)) as x, greatest(-400.0, least(400.0, u.r1 - u.r2)) as y, p2_rank - p1_rank as rd from m join gf g on m.mk = g.mk join uf u on m.mk = u.mk)
 select mk, round(x, 6) as elo_diff_clip, round(1 / (1 + power(10.0, -x / 400)), 6) as elo_prob, round(1 / (1 + power(10.0, -y / 400)), 6) as surface_elo_prob, round(power(x / 100, 2), 6) as elo_diff_sq,
 round(x * y / 10000, 6) as elo_surface_interaction, round(abs(x - y), 6) as elo_consistency, round(1 / (1 + abs(x) / 120), 6) as match_competitiveness,
 cast((case when x > 0 and rd < 0 then 1 else 0 end) - (case when x < 0 and rd > 0 then 1 else 0 end) as int) as elo_rank_mismatch from c""")
def elo_enriched(spark, sf):
    m = _matches(spark, sf, "p1_rank", "p2_rank")
    overall, on_surface = concurrently(lambda f: f(m), (ratings.elo, ratings.surface_elo))
    df = derived.rating_features(m.join(overall, "mk").join(on_surface, "mk"))
    return df.select("mk", *r6("elo_diff_clip", "elo_prob", "surface_elo_prob", "elo_diff_sq", "elo_surface_interaction", "elo_consistency", "match_competitiveness"), "elo_rank_mismatch")


@query(f"{_RECURSIVE}, {_GLOBAL} select mk, round(r1, 6) as elo_p1, round(r2, 6) as elo_p2 from gf where mk >= {_CUT}")
def elo_from_state(spark, sf):
    """Ratings of later matches that start from the earlier ones' state."""
    first, later = _two_parts(spark, sf)
    state = ratings.final_state(first, ratings.fold(first, ratings.match_counts(first)))
    folded = ratings.fold(later, ratings.match_counts(later, state), state=state)
    return folded.select("mk", F.round("r1", 6).alias("elo_p1"), F.round("r2", 6).alias("elo_p2"))


def _rated(spark, sf) -> DataFrame:
    m = match_view(spark, sf)
    folded = ratings.fold(m, ratings.match_counts(m))
    return history.long(m).join(folded, "mk").withColumn("elo", F.when(F.col("side") == 1, F.col("r1")).otherwise(F.col("r2")))


@query(f"{_RECURSIVE}, {_GLOBAL} select mk, side, case when count(r) over w >= 5 then round(avg(r) over w, 6) end as elo_smooth from gt window w as (partition by player order by mk rows between 10 preceding and 9 following)")
def elo_smooth20(spark, sf):
    rows = _rated(spark, sf)
    return rows.select("mk", "side", F.round(ratings.smoothed(rows), 6).alias("elo_smooth"))


# -- reports


@query("select cast(year(o_orderdate) as int) as year, count(*) as n from orders group by 1")
def counts_by_year(spark, sf):
    return reports.counts_by(table(spark, sf, "orders"), F.year("o_orderdate"), "year")


@query("select cast(month(o_orderdate) as int) as month, count(*) as n, list_extract(['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'], month(o_orderdate)) as label from orders group by 1, 3")
def counts_by_month(spark, sf):
    return reports.counts_by_month(table(spark, sf, "orders"), "o_orderdate")


@query(f"{_WITH} select surface, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as share from m group by surface")
def counts_by_surface_share(spark, sf):
    return reports.shares_by(match_view(spark, sf), "surface").select("surface", "n", *r6("share"))


@query("select o_orderpriority as round, count(*) as n from orders group by 1")
def counts_by_round(spark, sf):
    return reports.counts_by(table(spark, sf, "orders"), F.col("o_orderpriority"), "round")


@query("select n_name as country, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1 order by n desc, country limit 10")
def top_countries(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.top(rows, F.col("n_name"), "country")


@query("select cast(min(year(o_orderdate)) as int) as first_year, cast(max(year(o_orderdate)) as int) as last_year, count(distinct year(o_orderdate)) as years, count(*) as matches from orders")
def general_stats(spark, sf):
    return reports.general(table(spark, sf, "orders"), "o_orderdate")


_HIST = "select cast(least(floor((x - lo) / ((hi - lo) / {bins})), {last}) as int) as bin, count(*) as n from (select cast({x} as double) as x, min(cast({x} as double)) over () as lo, max(cast({x} as double)) over () as hi from m) group by 1"


@query(f"{_WITH} {_HIST.format(bins='50.0', last=49, x='minutes')}")
def minutes_histogram(spark, sf):
    return reports.histogram(match_view(spark, sf).withColumn("minutes", F.col("minutes").cast("double")), "minutes", 50)


@query(f"{_WITH} {_HIST.format(bins='40.0', last=39, x='case when target = 1 then p1_rank else p2_rank end')}")
def winner_age_hist(spark, sf):
    m = match_view(spark, sf)
    return reports.histogram(m.select(reports.winner(m, "p1_rank", "p2_rank").cast("double").alias("age")), "age", 40)


@query(f"{_LONG} select player, count(*) as matches, cast(sum(won) as bigint) as wins, count(*) - cast(sum(won) as bigint) as losses, round(avg(won), 6) as win_rate, min(year(tourney_date)) || '-' || max(year(tourney_date)) as career from l group by player")
def player_summary(spark, sf):
    return reports.player_stats(history.long(match_view(spark, sf)).withColumn("elo", F.lit(1500.0))).select("player", "matches", "wins", "losses", *r6("win_rate"), "career")


@query(f"{_RECURSIVE}, {_GLOBAL} select player, count(*) as matches, round(avg(won), 6) as win_rate, round(avg(r), 6) as avg_elo, round(max(r), 6) as max_elo from gt group by player")
def player_summary_rated(spark, sf):
    return reports.player_stats(_rated(spark, sf)).select("player", "matches", *r6("win_rate", "avg_elo", "max_elo"))


@query(f"{_LONG} select player, cast(year(tourney_date) as int) as year, count(*) as n, round(avg(won), 6) as win_rate from l group by 1, 2 having count(*) >= 10")
def yearly_winrate(spark, sf):
    return reports.yearly_rates(history.long(match_view(spark, sf))).select("player", "year", "n", *r6("win_rate"))


@query("select o_orderpriority as tourney_level, count(*) as n from orders group by 1 order by n desc")
def counts_by_level(spark, sf):
    return reports.shares_by(table(spark, sf, "orders"), "o_orderpriority").select(F.col("o_orderpriority").alias("tourney_level"), "n")


@query(f"{_LONG}, g as (select * from (select distinct player from l) cross join (select unnest(['Hard', 'Clay', 'Grass']) as surface)) select g.player, g.surface, round(coalesce(avg(l.won), 0), 6) as win_rate from g left join l on g.player = l.player and g.surface = l.surface group by 1, 2")
def surface_winrate_grid(spark, sf):
    return reports.surface_grid(history.long(match_view(spark, sf))).select("player", "surface", *r6("win_rate"))


@query(f"{_LONG} select player, opp, round(avg(won), 6) as win_share from l group by 1, 2")
def h2h_matrix(spark, sf):
    return reports.head_to_head_matrix(history.long(match_view(spark, sf))).select("player", "opp", *r6("win_share"))


@query("select a.surface as surface, b.level as level, coalesce(n, 0) as n from (select distinct l_returnflag as surface from lineitem) a cross join (select distinct l_linestatus as level from lineitem) b left join (select l_returnflag, l_linestatus, count(*) as n from lineitem group by all) c on c.l_returnflag = a.surface and c.l_linestatus = b.level")
def label_grid_join(spark, sf):
    rows = table(spark, sf, "lineitem")
    found = rows.groupBy(F.col("l_returnflag").alias("surface"), F.col("l_linestatus").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    grid = found.select("surface").distinct().crossJoin(F.broadcast(found.select("level").distinct()))  # a handful of labels each
    return grid.join(found, ["surface", "level"], "left").select("surface", "level", F.coalesce("n", F.lit(0)).alias("n"))


@query("select c_custkey, case when c_custkey % 3 = 0 then null else cast(c_nationkey as double) end as p1_rank, cast(c_nationkey as double) as p2_rank, c_name as p1_entry, cast(c_custkey as varchar) as p2_entry from customer")
def harmonised_pairs(spark, sf):
    text = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string"))
    raw = table(spark, sf, "customer").select("c_custkey", text.alias("p1_rank"), F.col("c_nationkey").alias("p2_rank"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("p1_entry"), F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("p2_entry"), "c_name")
    return columns.harmonise_pairs(raw).select("c_custkey", "p1_rank", "p2_rank", F.col("c_name").alias("p1_entry"), F.col("c_custkey").cast("string").alias("p2_entry"))


@query("select l_orderkey, l_linenumber, l_partkey, l_tax from lineitem")
def shared_columns(spark, sf):
    rows = table(spark, sf, "lineitem")
    train, test = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount"), rows.select("l_tax", "l_partkey", "l_linenumber", "l_orderkey", "l_quantity")
    return train.select(*columns.common_columns(train, test))


# -- columns

_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _numbers(spark, sf) -> DataFrame:
    """Numeric columns, one constant, one nearly the same as another."""
    rows = table(spark, sf, "lineitem").select(*_NUMBERS, F.lit(1.0).alias("one"), (F.col("l_quantity") * 2 + F.col("l_tax") / 1000).alias("twice"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return rows


def _values(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(" union all ".join(f"select '{c}' as feature from lineitem having min({x}) = max({x})" for c, x in [*((c, c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), ("one", "l_linenumber * 0")]))
def var_constants(spark, sf):
    df = _numbers(spark, sf)
    return _values(spark, [(c,) for c in reduce.constant_columns(df, [*_NUMBERS, "one"])], "feature string")


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]))
def corr_pairs(spark, sf):
    found = reduce.correlations(table(spark, sf, "lineitem"), _NUMBERS)
    return _values(spark, [(a, b, r) for (a, b), r in found.items()], "a string, b string, r double").select("a", "b", *r6("r"))


@query(" union all ".join(f"select '{c}' as feature, round(abs(corr({c}, case when l_returnflag = 'R' then 1.0 else 0.0 end)), 6) as corr from lineitem" for c in _NUMBERS))
def corr_target(spark, sf):
    return audit.label_correlations(_numbers(spark, sf), [*_NUMBERS, "one"], "label").select("feature", *r6("corr"))


@query("select 'twice' as feature union all select 'one'")
def drop_list_corr(spark, sf):
    _, gone = reduce.drop_constant_and_correlated(_numbers(spark, sf), protect=("label",))
    return _values(spark, [(c,) for c in gone], "feature string")


@query("select round(1 / (1 - power(sum(l_discount * l_tax), 2) / (sum(l_discount * l_discount) * sum(l_tax * l_tax))), 6) as vif from lineitem")
def vif_two(spark, sf):
    df = table(spark, sf, "lineitem")
    found = reduce.aggregated(df, {"aa": F.sum(F.col("l_discount") ** 2), "bb": F.sum(F.col("l_tax") ** 2), "ab": F.sum(F.col("l_discount") * F.col("l_tax"))})
    factors = reduce.inflation(np.array([[found["aa"], found["ab"]], [found["ab"], found["bb"]]]))
    return _values(spark, [(float(factors[0]),)], "vif double").select(*r6("vif"))


_VIF = {**{c: c for c in _NUMBERS}, "more": "l_quantity * 2 + l_tax * l_discount * 100"}


def _vif_sql(columns: dict[str, str], threshold: float = 10.0) -> str:
    """X'X, its inverse by Gauss and Jordan over the columns that are left, and the worst column dropped, round after round."""
    d = range(len(columns))
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'x': sum(a{i} * a{j})}}" for i in d for j in d)
    ctes = [f"t as (select {', '.join(f'cast({x} as double) as a{i}' for i, x in enumerate(columns.values()))} from lineitem)", f"c as (select unnest([{cells}]) as c from t)", "g as materialized (select c.i as i, c.j as j, c.x as x from c)", "d0 as (select cast(null as int) as k where false)"]
    for r in range(len(columns) - 1):
        ctes.append(f"m{r}_0 as materialized (select * from g where i not in (select k from d{r}) and j not in (select k from d{r}))")
        for k in d:
            m = f"m{r}_{k}"
            ctes.append(f"""m{r}_{k + 1} as materialized (select m.i, m.j, case when p.x is null then m.x when m.i = {k} and m.j = {k} then 1 / p.x when m.i = {k} then m.x / p.x when m.j = {k} then -m.x / p.x else m.x - c.x * w.x / p.x end as x
 from {m} m left join (select x from {m} where i = {k} and j = {k}) p on true left join {m} c on c.i = m.i and c.j = {k} left join {m} w on w.i = {k} and w.j = m.j)""")
        ctes.append(f"v{r} as materialized (select g.i as i, g.x * m.x as vif from g join m{r}_{len(columns)} m on m.i = g.i and m.j = g.j where g.i = g.j)")
        ctes.append(f"d{r + 1} as materialized (select k from d{r} union all select i from (select i from v{r} where vif > {threshold} order by vif desc limit 1))")
    names = ", ".join(f"'{c}'" for c in columns)
    return f"with {', '.join(ctes)} select list_extract([{names}], k + 1) as feature from d{len(columns) - 1}"


@query(_vif_sql(_VIF))
def vif_drop_list(spark, sf):
    rows = table(spark, sf, "lineitem").select(*(F.expr(x).alias(c) for c, x in _VIF.items()))
    return _values(spark, [(c,) for c in reduce.inflated_columns(rows, list(_VIF))], "feature string")


@query("select round((1 + abs(corr(l_quantity, l_extendedprice))) / 2, 6) as pc1_var from lineitem")
def pca_two_column(spark, sf):
    _, state = reduce.group_components(table(spark, sf, "lineitem"), groups={"size": ["l_quantity", "l_extendedprice"]})
    return reduce.component_report(spark, state).select(*r6("pc1_var"))


def _axes_sql(columns: tuple[str, ...], sweeps: int = 6) -> str:
    """The correlation matrix turned by Jacobi's rotations until it is diagonal: columns a<i><i> and the axes v<.><i> in one row, named jacobi."""
    d = range(len(columns))
    pair = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    first = [f"{'1.0' if i == j else f'corr({columns[i]}, {columns[j]})'} as a{i}{j}" for i in d for j in d if i <= j] + [f"{float(i == j)} as v{i}{j}" for i in d for j in d]
    ctes, before = [f"j0 as materialized (select {', '.join(first)} from lineitem)"], "j0"
    for k, (p, q) in enumerate([(p, q) for _ in range(sweeps) for p in d for q in d if p < q], 1):
        tau, own = f"((a{q}{q} - a{p}{p}) / (2 * a{p}{q}))", {f"a{p}{p}": f"a{p}{p} - t * a{p}{q}", f"a{q}{q}": f"a{q}{q} + t * a{p}{q}", f"a{p}{q}": "0.0"}
        for r in d:
            if r not in (p, q):
                own |= {pair(r, p): f"c * {pair(r, p)} - s * {pair(r, q)}", pair(r, q): f"s * {pair(r, p)} + c * {pair(r, q)}"}
            own |= {f"v{r}{p}": f"c * v{r}{p} - s * v{r}{q}", f"v{r}{q}": f"s * v{r}{p} + c * v{r}{q}"}
        turn = f"select *, t / sqrt(1 + t * t) as s, 1 / sqrt(1 + t * t) as c from (select *, case when abs(a{p}{q}) < 1e-300 then 0.0 else case when {tau} < 0 then -1 else 1 end / (abs({tau}) + sqrt(1 + {tau} * {tau})) end as t from {before})"
        ctes.append(f"j{k} as materialized (select * exclude (t, s, c) replace ({', '.join(f'{x} as {n}' for n, x in own.items())}) from ({turn}))")
        before = f"j{k}"
    return ", ".join(ctes) + f", jacobi as (select * from {before})"


def _projection_sql(columns: tuple[str, ...], n: int) -> str:
    """The rows on the n largest axes, each axis with its largest loading positive."""
    d = range(len(columns))
    axes = f"select unnest([{', '.join(f'a{i}{i}' for i in d)}]) as size, unnest([{', '.join('[' + ', '.join(f'v{r}{i}' for r in d) + ']' for i in d)}]) as axis from jacobi"
    signed = "select row_number() over (order by size desc) as i, [x * sign(axis[list_position([abs(y) for y in axis], list_max([abs(y) for y in axis]))]) for x in axis] as axis from axes"
    z = [f"({c} - avg({c}) over ()) / stddev_pop({c}) over ()" for c in columns]
    own = lambda i: f"(select axis from signed where i = {i})"
    return f"with {_axes_sql(columns)}, axes as ({axes}), signed as ({signed}), z as (select l_orderkey, l_linenumber, {', '.join(f'{x} as z{k}' for k, x in enumerate(z))} from lineitem) select l_orderkey, l_linenumber, " + ", ".join(f"round({' + '.join(f'z{k} * {own(i)}[{k + 1}]' for k in d)}, 6) as price_pca{i}" for i in range(1, n + 1)) + " from z"


@query(_projection_sql(_NUMBERS, 4))
def pca_projection(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_NUMBERS)
    df, _ = reduce.group_components(rows, groups={"price": list(_NUMBERS)}, threshold=1.0)
    return df.select("l_orderkey", "l_linenumber", *r6(*(c for c in df.columns if c.startswith("price_pca"))))


def _sized(spark, sf) -> DataFrame:
    """Two columns that go together."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_quantity") + 10 * F.col("l_discount")).alias("more"), "l_shipdate")


_SIZED = "(select *, l_quantity + 10 * l_discount as more from lineitem)"


@query(f"with c as (select round((1 + corr(l_quantity, more)) / 2, 6) as share, round(sqrt(0.5), 6) as loading from {_SIZED}) select cast(1 as int) as component, unnest(['l_quantity', 'more']) as feature, share, loading from c")
def pca_diagnosis(spark, sf):
    _, state = reduce.group_components(_sized(spark, sf), groups={"size": ["l_quantity", "more"]})
    rows = reduce.diagnosis(spark, "size", state)
    return rows.select("component", "share", F.explode("loadings").alias("l")).select("component", "l.feature", *r6("share"), F.round("l.loading", 6).alias("loading"))


@query(f"""with t as (select *, l_shipdate < '1997-01-01' as train from {_SIZED}),
 s as (select avg(l_quantity) as a, stddev_pop(l_quantity) as sa, avg(more) as b, stddev_pop(more) as sb from t where train)
 select l_orderkey, l_linenumber, l_partkey, round(((l_quantity - a) / sa + (more - b) / sb) * sqrt(0.5), 5) as size_pca1 from t, s where not train""")
def pca_transform_state(spark, sf):
    """Components of the training rows applied to later rows."""
    rows, cut, groups = _sized(spark, sf), F.lit("1997-01-01").cast("date"), {"size": ["l_quantity", "more"]}
    _, state = reduce.group_components(rows.filter(F.col("l_shipdate") < cut), groups=groups)
    later, _ = reduce.group_components(rows.filter(F.col("l_shipdate") >= cut), state, groups=groups, train=False)
    return later.select("l_orderkey", "l_linenumber", "l_partkey", F.round("size_pca1", 5).alias("size_pca1"))


@query(f"{_WITH} select mk, coalesce(p1_ace, (select median(p1_ace) from m)) as p1_ace from m")
def impute_median(spark, sf):
    m = match_view(spark, sf).select("mk", "p1_ace")
    return reduce.imputed(m, reduce.medians(m, ["p1_ace"]))


@query("select l_orderkey, l_linenumber, l_partkey, round((l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem), 6) as z from lineitem")
def standardise(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    mean, std = reduce.standard_stats(df, ["l_quantity"])["l_quantity"]
    return df.select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_quantity") - mean) / std, 6).alias("z"))


# -- audits and metrics

_SCORE = "select round(l_discount * 10, 1) as p, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem"


def _scores(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.round(F.col("l_discount") * 10, 1).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("pred"))


@query("""with v as (select l_quantity as v, sum(case when l_returnflag <> 'R' then 1 else 0 end) as a, sum(case when l_returnflag = 'R' then 1 else 0 end) as b from lineitem group by 1),
 c as (select sum(a) over (order by v) * 1.0 / sum(a) over () as fa, sum(b) over (order by v) * 1.0 / sum(b) over () as fb, sum(a) over () as n1, sum(b) over () as n2 from v)
 select cast(max(n1) as bigint) as n1, cast(max(n2) as bigint) as n2, round(max(abs(fa - fb)), 6) as d from c""")
def ks_two_sample(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("second"))
    return audit.ks_statistic(df, "l_quantity", "second").select("n1", "n2", *r6("d"))


_KS = """select '{c}' as feature, cast(max(n1) as bigint) as n1, cast(max(n2) as bigint) as n2, round(max(abs(fa - fb)), 6) as d from (select sum(a) over (order by v) * 1.0 / sum(a) over () as fa, sum(b) over (order by v) * 1.0 / sum(b) over () as fb, sum(a) over () as n1, sum(b) over () as n2
 from (select {c} as v, sum(case when l_shipdate < '1997-01-01' then 1 else 0 end) as a, sum(case when l_shipdate >= '1997-01-01' then 1 else 0 end) as b from lineitem where {c} is not null group by 1))"""


@query(" union all ".join(_KS.format(c=c) for c in (*_NUMBERS, "l_linenumber", "l_partkey", "l_suppkey")))
def ks_features(spark, sf):
    """Earlier against later rows, all features in the same jobs."""
    names = [*_NUMBERS, "l_linenumber", "l_partkey", "l_suppkey"]
    df = table(spark, sf, "lineitem").select(*names, (F.col("l_shipdate") >= F.lit("1997-01-01").cast("date")).alias("second"))
    return audit.ks_statistics(df, names, "second").select("feature", "n1", "n2", *r6("d"))


@query("select max(case when l_shipdate < '1997-01-01' then cast(l_shipdate as date) end) as train_end, min(case when l_shipdate >= '1997-01-01' then cast(l_shipdate as date) end) as test_start, max(case when l_shipdate < '1997-01-01' then cast(l_shipdate as date) end) < min(case when l_shipdate >= '1997-01-01' then cast(l_shipdate as date) end) as ordered from lineitem")
def temporal_split_check(spark, sf):
    df = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.when(F.col("l_shipdate") < F.lit("1997-01-01").cast("date"), "train").otherwise("test").alias("split"))
    return audit.temporal_split(df, "split", "d")


@query(f"with s as ({_SCORE}), g as (select p, sum(y) as pos, sum(1 - y) as neg from s group by p), c as (select pos, neg, coalesce(sum(neg) over (order by p {_BEFORE}), 0) as below from g) select round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) as auc from c")
def auc_rank(spark, sf):
    return metrics.auc(_scores(spark, sf), "p", "y").select(*r6("auc"))


@query(f"with s as (select greatest(0.01, least(0.99, p)) as p, y from ({_SCORE})) select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as logloss, round(avg(power(p - y, 2)), 6) as brier, round(avg(case when (case when p >= 0.5 then 1 else 0 end) = y then 1.0 else 0.0 end), 6) as accuracy from s")
def logloss_brier_accuracy(spark, sf):
    p, y = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("p"))), F.col("y")
    return _scores(spark, sf).agg(metrics.log_loss(p, y).alias("logloss"), metrics.brier(p, y).alias("brier"), metrics.accuracy(p, y).alias("accuracy")).select(*r6("logloss", "brier", "accuracy"))


@query("select case when l_returnflag = 'R' then 1 else 0 end as target, case when l_discount >= 0.05 then 1 else 0 end as pred, count(*) as n from lineitem group by 1, 2")
def confusion(spark, sf):
    return metrics.confusion(_scores(spark, sf), "y", "pred")


@query("""with s as (select case when l_returnflag = 'R' then 1 else 0 end as y, case when l_discount >= 0.05 then 1 else 0 end as pred from lineitem)
 select count(*) as n, count(*) filter (where y <> pred) as errors, round(avg(case when y <> pred then 1.0 else 0.0 end), 6) as error_rate, count(*) filter (where y <> pred and pred = 1) as false_positives, count(*) filter (where y <> pred and pred = 0) as false_negatives from s""")
def error_counts(spark, sf):
    return reports.errors(_scores(spark, sf), "y", "pred").select("n", "errors", *r6("error_rate"), "false_positives", "false_negatives")


@query(f"""with s as (select p, y, case when p >= 0.5 then 1 else 0 end as pred from ({_SCORE})), b as (select case when p > 0 and p <= 0.3 then 'Baja' when p > 0.3 and p <= 0.7 then 'Media' when p > 0.7 and p <= 1 then 'Alta' end as bin, y, pred from s)
 select n.bin, count(b.y) as n, round(avg(case when b.y is null then null when b.y = b.pred then 1.0 else 0.0 end), 6) as accuracy from (select unnest(['Baja', 'Media', 'Alta']) as bin) n left join b on n.bin = b.bin group by 1""")
def confidence_bins(spark, sf):
    return metrics.confidence_bins(_scores(spark, sf), "p", "y", "pred").select("bin", "n", *r6("accuracy"))


@query("with s as (select l_returnflag || l_linestatus as feature, sum(l_tax) as x from lineitem group by 1) select feature, round(x, 4) as x, round(x / sum(x) over (), 6) as share, round(sum(x) over (order by x desc, feature rows unbounded preceding) / sum(x) over (), 6) as cumulative from s")
def cumulative_share(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("feature")).agg(F.sum("l_tax").alias("x"))
    return metrics.cumulative_share(rows, "feature", "x").select("feature", F.round("x", 4).alias("x"), *r6("share", "cumulative"))


@query("with s as (select case when l_linenumber % 2 = 0 then 'a' else 'b' end || l_returnflag as feature, l_tax as x from lineitem) select feature, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(stddev_pop(x) / (avg(x) + 1e-8), 6) as cv from s group by 1")
def importance_summary(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b"), F.col("l_returnflag")).alias("feature"), F.col("l_tax").alias("importance"))
    return validate.summarised_importances(rows).select("feature", *r6("mean", "std", "cv"))


# -- splits and resampling


@query("""with s as (select cast(min(o_orderdate) as date) as lo, cast(max(o_orderdate) as date) as hi from orders), c as (select i as split, cast(lo + to_months(cast(6 * i as int)) as date) as train_end, cast(cast(lo + to_months(cast(6 * i as int)) as date) + to_months(3) as date) as test_end, hi from s, (select unnest([1, 2, 3, 4, 5]) as i))
 select cast(split as int) as split, train_end, test_end, cast(count(*) filter (where cast(o_orderdate as date) < train_end) as bigint) as train_size, cast(count(*) filter (where cast(o_orderdate as date) >= train_end) as bigint) as test_size from c join orders on cast(o_orderdate as date) < test_end where test_end <= hi group by 1, 2, 3
 having count(*) filter (where cast(o_orderdate as date) < train_end) >= 1000 and count(*) filter (where cast(o_orderdate as date) >= train_end) >= 100""")
def temporal_windows(spark, sf):
    return validate.temporal_windows(table(spark, sf, "orders"), "o_orderdate")


@query("with n as (select count(*) as n, count(*) // 6 as size from orders), r as (select row_number() over (order by o_orderdate, o_orderkey) - 1 as i, n, size from orders, n) select cast(case when i < n - 5 * size then 0 else (i - (n - 5 * size)) // size + 1 end as int) as fold, count(*) as n from r group by 1")
def expanding_folds(spark, sf):
    rows = validate.expanding_folds(table(spark, sf, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")])
    return rows.groupBy(F.col("_fold").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey from orders order by md5('sample:' || cast(o_orderkey as varchar)), o_orderkey limit 500")
def sample_rows(spark, sf):
    return validate.sample_rows(table(spark, sf, "orders").select("o_orderkey"), 500, "o_orderkey")


@query("""with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as row from orders), n as (select count(*) as n from orders),
 d as (select i as draw, cast('0x' || substr(md5('bootstrap:' || i), 1, 8) as bigint) % n as row from n, range((select n from n)) as x(i))
 select d.draw, r.o_orderkey from d join r using (row)""")
def bootstrap_ids(spark, sf):
    return validate.bootstrap(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("with a as (select o_orderkey, row_number() over (order by o_orderkey) as i from orders), b as (select o_orderstatus, row_number() over (order by md5('permute:' || cast(o_orderkey as varchar)), o_orderkey) as i from orders) select a.o_orderkey, b.o_orderstatus from a join b using (i)")
def permute_labels(spark, sf):
    return validate.permuted(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", "permute").select("o_orderkey", "o_orderstatus")


# -- models


def _learnable(spark, sf) -> DataFrame:
    """key, features and label of matches whose winner has more aces, mostly."""
    m = match_view(spark, sf)
    df = derived.rank_features(m)
    return df.select("mk", "tourney_date", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("p1_ace", "p2_ace", "p1_df", "p2_df", "rank_diff")), "target")


_FEATURES = ["p1_ace", "p2_ace", "p1_df", "p2_df", "rank_diff"]


@query()
def model_compare(spark, sf):
    rows = validate.expanding_folds(_learnable(spark, sf), [F.col("mk")], 3)
    data = settled(validate.assembled(rows, _FEATURES, "target", "mk", "_fold"))
    train, test = data.filter("_fold < 3"), data.filter("_fold = 3")
    return models.compare(train, test, models.candidates(train.count(), 0.1))


@query()
def boosted(spark, sf):
    """Second-order boosting fitted before the last fold, and its scores there."""
    rows = validate.expanding_folds(_learnable(spark, sf), [F.col("mk")], 3)
    data = settled(validate.assembled(rows, _FEATURES, "target", "mk", "_fold"))
    model = HistogramBoosting(rounds=20, depth=4, l1=0.3, min_child_weight=3.0, rows=0.9, columns=0.8).fit(data.filter("_fold < 3"))
    return validate.scored_as(model, data.filter("_fold = 3"), "p").select("mk", "label", "p")


@query()
def ensemble_vote(spark, sf):
    data = settled(validate.assembled(_learnable(spark, sf), _FEATURES, "target", "mk"))
    fitted = concurrently(lambda e: e.fit(data), (RandomForestClassifier(numTrees=100, maxDepth=5, seed=42), HistogramBoosting(rounds=10, depth=4), LogisticRegression(maxIter=1000)))
    return models.summary(models.vote(fitted, data, "mk"))


@query()
def calibrated(spark, sf):
    rows = validate.expanding_folds(_learnable(spark, sf), [F.col("mk")], 3)
    data = settled(validate.assembled(rows, _FEATURES, "target", "mk", "_fold"))
    return models.summary(models.calibrated(models.calibrate(data, 3, RandomForestClassifier(numTrees=100, maxDepth=5, seed=42)), data, "mk"))


@query()
def importance(spark, sf):
    data = validate.assembled(_learnable(spark, sf), _FEATURES, "target")
    model = RandomForestClassifier(numTrees=100, maxDepth=5, seed=42).fit(data)
    return metrics.cumulative_share(_values(spark, validate.importances(model, _FEATURES), "feature string, importance double"), "feature", "importance")


@query()
def grid_small(spark, sf):
    rows = validate.expanding_folds(_learnable(spark, sf), [F.col("mk")], 5)
    data = validate.assembled(rows, _FEATURES, "target", "_fold")
    return models.grid_search(data, 5, RandomForestClassifier(seed=42), {"numTrees": [10, 20], "maxDepth": [4, 6]})


@query()
def interaction_leakage(spark, sf):
    rows = _learnable(spark, sf).drop("mk", "tourney_date")
    leaks = {"leak": F.col("target") * 2.0 + F.col("p1_df") / 4, "other_leak": F.col("target") * 1.0 - F.col("p2_df") / 8}
    return validate.interaction_leakage(rows.withColumns(leaks), "target", 0.9)


def _tree() -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=3, seed=42)


@query()
def temporal_fit(spark, sf):
    """Orders' priority told from price and date, in windows of time."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), "o_totalprice", (F.col("o_totalprice") > 150_000).cast("int").alias("label"))
    return validate.temporal_validation(rows, ["o_totalprice"], "label", "d", _tree()).select("split", "train_end", "test_end", "train_size", "test_size", *r6("auc", "logloss"))


@query()
def stability_audit(spark, sf):
    found = validate.stability(_learnable(spark, sf), _FEATURES, "target", "mk", _tree())
    return _values(spark, [(k, float(v)) for k, v in found.items()], "name string, value double")


@query()
def importance_audit(spark, sf):
    return validate.importance_stability(_learnable(spark, sf), _FEATURES, "target", "mk", _tree())


@query()
def full_audit(spark, sf):
    rows = _learnable(spark, sf)
    cut = rows.agg(F.percentile_approx("mk", 0.8)).first()[0] or 0
    found = validate.full_audit(rows.filter(F.col("mk") < cut), rows.filter(F.col("mk") >= cut), _FEATURES, "target", "mk", _tree())
    out = [("test", k, float(v)) for k, v in found["test"].items()] + [("stability", k, float(v)) for k, v in found["stability"].items()]
    return _values(spark, out, "part string, name string, value double").unionByName(found["importance"].select(F.lit("importance").alias("part"), F.col("feature").alias("name"), F.col("mean").alias("value"))).unionByName(found["interactions"].select(F.lit("interactions").alias("part"), F.array_join("features", " ").alias("name"), F.col("auc").alias("value")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
