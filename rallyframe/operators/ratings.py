"""Ratings before each match, with an update factor that falls with experience.

A rating depends on the opponent's rating of that moment, so matches that share players must be folded in order. All that
does not depend on ratings (match counts, hence update factors) is computed by windows first. The rest is folded by
slices of time and, inside a slice, by groups of players that its matches connect: groups never meet within the slice, so
each is a task's own, and no task sees more than SLICE_ROWS matches however long the history. All slices' groups are found
in one job before the first is folded, and a slice reads its own matches alone. Besides its matches' ratings, a fold gives
the ratings and last changes of its players, which the next slice starts from; who does not play passes through. Surface
ratings are the same over pairs of player and surface, whose groups never cross surfaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import settled, stored
from .history import order_of, prior

INITIAL = 1500.0
K_MIN, K_MAX, HALF_LIFE = 24.0, 42.0, 50.0
SURFACE_SHARE = 0.7
RECENT = 5
#: Matches that one task folds at most, in the worst case of a slice whose players are all connected (some seconds).
SLICE_ROWS = 1_000_000


def k_adaptive(n: Column, k_min: float = 18.0, k_max: float = 32.0, half_life: float = 50.0) -> Column:
    """The update factor after n matches."""
    return k_min + (k_max - k_min) * F.exp(-F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)) / half_life)


def _sides(matches: DataFrame, *more: str) -> DataFrame:
    order = [c for c in ("tourney_date", "tourney_id", "match_num", "mk") if c in matches.columns]
    both = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("player_1").alias("player")), F.struct(F.lit(2).alias("side"), F.col("player_2").alias("player"))))
    return matches.select(*order, *more, both.alias("_s")).select(*order, *more, "_s.*")


def match_counts(matches: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """mk, n_1, n_2: matches of either player before this one. before: player, n to start from."""
    rows = _sides(matches)
    n = F.count(F.lit(1)).over(prior(["player"], order_of(rows)))
    if before is not None:
        rows = rows.join(before.select(F.col("player").alias("_player"), F.col("n").alias("_before")), F.col("player").eqNullSafe(F.col("_player")), "left")
        n = n + F.coalesce("_before", F.lit(0))
    n = rows.withColumn("n", n)
    return n.groupBy("mk").agg(*(F.max(F.when(F.col("side") == s, F.col("n"))).alias(f"n_{s}") for s in (1, 2)))


def surface_counts(matches: DataFrame, compat: bool = True, share: float = SURFACE_SHARE) -> DataFrame:
    """mk, n_1, n_2 of surface ratings: share of the global and the rest of the surface's count.

    compat: the global count starts at the career total of the same table, as the original pipeline has it (a look-ahead);
    else it counts prior matches only.
    """
    rows = _sides(matches, "surface")
    order = order_of(rows)
    before = F.count(F.lit(1)).over(prior(["player"], order))
    if compat:
        before = before + F.count(F.lit(1)).over(Window.partitionBy("player"))
    on_surface = F.count(F.lit(1)).over(prior(["player", "surface"], order))
    n = rows.withColumn("n", share * before + (1 - share) * on_surface)
    return n.groupBy("mk").agg(*(F.max(F.when(F.col("side") == s, F.col("n"))).alias(f"n_{s}") for s in (1, 2)))


def _merged(batches: Iterator[pa.RecordBatch], a: str, b: str) -> tuple[list[int], list[int]]:
    """The nodes of the edges (a, b), and for each the smallest node that the edges connect it to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        edges = np.unique(np.column_stack([batch.column(a).to_numpy(), batch.column(b).to_numpy()]), axis=0)
        for p, q in zip(*edges.T.tolist(), strict=True) if len(edges) else ():
            x, y = root(p), root(q)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return nodes, [root(x) for x in nodes]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to (node, smallest node that the edges seen here connect it to)."""
    nodes, roots = _merged(batches, "a", "b")
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)], pa.int64()) for x in (nodes, roots)], ["a", "b"])


def groups(edges: DataFrame, fan: int = 16) -> DataFrame:
    """node, group (its smallest node) of the edges' two columns of longs: partial forests of partitions, merged `fan` at a time. The last merge holds a row for each node of a slice and partition it came from."""
    forest = edges.mapInArrow(_linked, "a long, b long")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // fan)
        forest = forest.repartition(parts, F.spark_partition_id() % parts if parts > 1 else F.lit(0)).mapInArrow(_linked, "a long, b long")
    return forest.toDF("node", "group")


def _slices_groups(dealt: DataFrame, slices: int) -> DataFrame:
    """_slice, node, group of all slices in one job: partial forests of partitions, then one merge a slice."""
    edges = dealt.select("_slice", _node("player_1").alias("a"), _node("player_2").alias("b"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            at = batch.column("_slice").to_numpy()
            for i in np.unique(at).tolist():
                own.setdefault(i, []).append(batch.filter(pa.array(at == i)).select(["a", "b"]))
        for i in own:
            nodes, roots = _merged(own[i], "a", "b")
            for k in range(0, len(nodes), 1 << 16):
                part = [pa.array(x[k : k + (1 << 16)], pa.int64()) for x in (nodes, roots)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), i, np.int32)), *part], ["_slice", "a", "b"])

    schema = "_slice int, a long, b long"
    return edges.mapInArrow(linked, schema).repartition(slices, "_slice").mapInArrow(linked, schema).toDF("_slice", "node", "group")


#: What a fold reads, and what it gives: rows of matches (start is null), and one of each player and surface after them.
_READ = ["mk", "group", "surface", "player_1", "player_2", "target", "k1", "k2", "start", "recent"]
_GIVEN = ["mk", "r1", "r2", "d1", "d2", "v1", "v2", "player", "surface", "start", "recent"]


def _given(keyed: DataFrame) -> str:
    types = dict(keyed.dtypes)
    return f"mk {types['mk']}, r1 double, r2 double, d1 double, d2 double, v1 double, v2 double, player {types['player_1']}, surface string, start double, recent array<double>"


def _means(last: np.ndarray, code: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each change d of a code, in order, the mean of the last RECENT before it (NaN: none). last: by code the last changes, NaN before them; brought up to date."""
    players, code = np.unique(code, return_inverse=True)
    held = len(players) * RECENT
    who, x = np.concatenate([np.repeat(np.arange(len(players)), RECENT), code]), np.concatenate([last[players].ravel(), d])
    order = np.argsort(who, kind="stable")
    x, back = x[order], np.flatnonzero(order >= held)
    before = x[back[:, None] + np.arange(-RECENT, 0)]
    there = ~np.isnan(before)
    n, total = there.sum(axis=1), np.where(there, before, 0.0).cumsum(axis=1)[:, -1]
    out = np.empty(len(d))
    out[order[back] - held] = np.where(n > 0, total / np.maximum(n, 1), np.nan)
    ends = np.cumsum(np.bincount(who))
    last[players] = x[ends[:, None] + np.arange(-RECENT, 0)]
    return out


class _Players:
    """Ratings and last changes of the players (with surface) that a task has seen, by their codes."""

    def __init__(self, initial: float):
        self.initial = initial
        self.codes: dict[tuple, int] = {}
        self.ratings: list[float] = []
        self.last = np.empty((0, RECENT))

    def code(self, players: pa.Array, surfaces: pa.Array) -> np.ndarray:
        p, s = players.dictionary_encode(), surfaces.dictionary_encode()
        names, grounds = [None, *p.dictionary.to_pylist()], [None, *s.dictionary.to_pylist()]
        i, j = (x.indices.fill_null(-1).to_numpy().astype(np.int64) + 1 for x in (p, s))
        both, at = np.unique(i * len(grounds) + j, return_inverse=True)
        own = [self.codes.setdefault((names[x // len(grounds)], grounds[x % len(grounds)]), len(self.codes)) for x in both.tolist()]
        self.ratings += [self.initial] * (len(self.codes) - len(self.ratings))
        if len(self.codes) > len(self.last):
            self.last = np.vstack([self.last, np.full((max(len(self.codes), 2 * len(self.last)) - len(self.last), RECENT), np.nan)])
        return np.array(own, np.int64)[at]

    def start(self, rows: pa.RecordBatch) -> None:
        for at, r, recent in zip(self.code(rows.column("player_1"), rows.column("surface")).tolist(), *(rows.column(c).to_pylist() for c in ("start", "recent")), strict=True):
            self.ratings[at] = r
            if recent:
                self.last[at, RECENT - len(recent) :] = recent

    def play(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        n, ratings = rows.num_rows, self.ratings
        code = self.code(pa.concat_arrays([rows.column("player_1"), rows.column("player_2")]), pa.concat_arrays([rows.column("surface")] * 2)).reshape(2, n)
        r1s, r2s, d1s, d2s = [], [], [], []
        for a, b, won, k1, k2 in zip(*code.tolist(), *(rows.column(c).to_numpy().tolist() for c in ("target", "k1", "k2")), strict=True):
            r1, r2 = ratings[a], ratings[b]
            expected = 1.0 / (1.0 + 10.0 ** ((r2 - r1) / 400.0))
            d1, d2 = k1 * (won - expected), k2 * ((1.0 - won) - (1.0 - expected))
            ratings[a], ratings[b] = r1 + d1, r2 + d2
            r1s.append(r1)
            r2s.append(r2)
            d1s.append(d1)
            d2s.append(d2)
        v = _means(self.last, code.T.ravel(), np.abs(np.column_stack([d1s, d2s])).ravel()).reshape(n, 2).T
        none = [pa.nulls(n, t) for t in (rows.schema.field("player_1").type, pa.string(), pa.float64(), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([rows.column("mk"), *map(pa.array, (r1s, r2s, d1s, d2s)), *(pa.array(x, mask=np.isnan(x)) for x in v), *none], _GIVEN)

    def state(self, mk: pa.DataType, player: pa.DataType) -> Iterator[pa.RecordBatch]:
        names = list(self.codes)
        for i in range(0, len(names), 1 << 14):
            part = names[i : i + (1 << 14)]
            x = self.last[i : i + len(part)]
            there = ~np.isnan(x)
            recent = pa.ListArray.from_arrays(pa.array(np.append(0, there.sum(axis=1).cumsum()), pa.int32()), pa.array(x[there]))
            own = [pa.array([p for p, _ in part], player), pa.array([s for _, s in part], pa.string()), pa.array(self.ratings[i : i + len(part)], pa.float64()), recent]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), mk), *[pa.nulls(len(part), pa.float64())] * 6, *own], _GIVEN)


def _fold(initial: float, held: int = 1 << 17) -> callable:
    """Rows by group and in order, start rows first, to ratings, changes and the players' state. Groups share no player, so those of a batch go together; where a task holds more than `held` players, it lets go of them at the next group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        players, current, types = _Players(initial), None, None

        def folded(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            starts = rows.column("start").is_valid()
            players.start(rows.filter(starts))
            played = rows.filter(pc.invert(starts))
            if played.num_rows:
                yield players.play(played)

        for rows in batches:
            if not rows.num_rows:
                continue
            types = [rows.schema.field(c).type for c in ("mk", "player_1")]
            group = rows.column("group").to_numpy()
            other = np.flatnonzero(group != current)
            if len(players.codes) > held and other.size:
                at = int(other[0])
                yield from folded(rows.slice(0, at))
                yield from players.state(*types)
                players, rows = _Players(initial), rows.slice(at)
            current = group[-1]
            yield from folded(rows)
        if types:
            yield from players.state(*types)

    return run


def _node(player: str) -> Column:
    """A number for a player on a surface; two that share one are folded in one group, which changes nothing."""
    return F.xxhash64(F.col(player), F.col("surface"))


def _slice(keyed: DataFrame, group: DataFrame, state: DataFrame | None, order: list[str], initial: float) -> DataFrame:
    """The fold of one slice: keyed matches, their groups (node, group), and the state (player, surface, start, recent) of everyone before it."""
    rows = keyed.withColumns({"node": _node("player_1"), "start": F.lit(None).cast("double"), "recent": F.lit(None).cast("array<double>")}).join(group, "node")
    if state is not None:
        first = state.select(F.col("player").alias("player_1"), "surface", "start", "recent").withColumn("node", _node("player_1")).join(group, "node", "left")
        rows = rows.unionByName(first.withColumn("group", F.coalesce("group", "node")), allowMissingColumns=True)
    ordered = rows.repartition(F.col("group")).sortWithinPartitions("group", F.col("start").isNull(), *(F.col(c).asc_nulls_last() for c in order))
    return ordered.select(*_READ).mapInArrow(_fold(initial), _given(keyed))


def fold(matches: DataFrame, counts: DataFrame, *, by_surface: bool = False, fixed_k: float | None = None, k_min: float = K_MIN, k_max: float = K_MAX, half_life: float = HALF_LIFE, initial: float = INITIAL, state: DataFrame | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """mk, r1, r2 (ratings before the match), d1, d2 (their changes), v1, v2 (mean size of the last five changes before it).

    state: player[, surface], elo to start from. slice_rows: about how many matches a slice has; a history of fewer is one slice.
    """
    k = lambda s: F.lit(float(fixed_k)) if fixed_k is not None else k_adaptive(F.col(f"n_{s}"), k_min, k_max, half_life)
    order = [c for c in ("tourney_date", "tourney_id", "match_num", "mk") if c in matches.columns]
    surface = F.coalesce("surface", F.lit("Unknown")) if by_surface else F.lit("")
    target = F.col("target").cast("double") if "target" in matches.columns else F.lit(1.0)
    keyed = matches.join(counts, "mk").select(*order, surface.alias("surface"), "player_1", "player_2", target.alias("target"), k(1).alias("k1"), k(2).alias("k2"))
    if state is not None:
        state = state.select("player", (F.col("surface") if by_surface else F.lit("")).alias("surface"), F.col("elo").cast("double").alias("start"), F.lit(None).cast("array<double>").alias("recent"))
    of_matches = lambda df: df.filter("start is null").select("mk", "r1", "r2", "d1", "d2", "v1", "v2")
    slices = -(-matches.count() // slice_rows)
    if slices <= 1:
        return of_matches(_slice(keyed, groups(keyed.select(_node("player_1").alias("a"), _node("player_2").alias("b"))), state, order, initial))
    dealt = stored(keyed.repartitionByRange(slices, *(F.col(c).asc_nulls_last() for c in order)).withColumn("_slice", F.spark_partition_id()), "_slice")
    group = stored(_slices_groups(dealt, slices), "_slice")
    out = []
    for i in range(slices):
        of_slice = lambda df, i=i: df.filter(F.col("_slice") == i).drop("_slice")
        out.append(stored(_slice(of_slice(dealt), of_slice(group), state, order, initial)))
        state = out[-1].filter("start is not null").select("player", "surface", "start", "recent")
    return reduce(DataFrame.unionAll, map(of_matches, out))


def _named(folded: DataFrame, prefix: str) -> DataFrame:
    return folded.select("mk", F.col("r1").alias(f"{prefix}elo_p1"), F.col("r2").alias(f"{prefix}elo_p2"), (F.col("r1") - F.col("r2")).alias(f"{prefix}elo_diff"), F.col("v1").alias(f"{prefix}elo_vol5_p1"), F.col("v2").alias(f"{prefix}elo_vol5_p2"), (F.col("v1") - F.col("v2")).alias(f"{prefix}elo_vol5_diff"))


def reject_self_matches(matches: DataFrame) -> DataFrame:
    """Fails, when run, on a match of a player against themselves."""
    return matches.filter(F.when(F.col("player_1") == F.col("player_2"), F.raise_error(F.lit("a match of a player against themselves")).cast("boolean")).otherwise(F.lit(True)))


def elo(matches: DataFrame, **how) -> DataFrame:
    """mk and elo_p1, elo_p2, elo_diff, elo_vol5_p1, elo_vol5_p2, elo_vol5_diff."""
    return _named(fold(reject_self_matches(matches), match_counts(matches), **how), "")


def surface_elo(matches: DataFrame, compat: bool = True, share: float = SURFACE_SHARE, **how) -> DataFrame:
    """The same of surface ratings, with surface_ before each name."""
    return _named(fold(reject_self_matches(matches), surface_counts(matches, compat, share), by_surface=True, **how), "surface_")


def final_state(matches: DataFrame, folded: DataFrame, by_surface: bool = False, before: DataFrame | None = None) -> DataFrame:
    """player[, surface], elo, n after all matches; before: the state they started from, whose other players stay."""
    order = [c for c in ("tourney_date", "tourney_id", "match_num", "mk") if c in matches.columns]
    surface = [F.coalesce("surface", F.lit("Unknown")).alias("surface")] if by_surface else []
    rows = matches.select(*order, *surface, "player_1", "player_2").join(folded, "mk")
    both = F.explode(F.array(*(F.struct(F.col(f"player_{s}").alias("player"), (F.col(f"r{s}") + F.col(f"d{s}")).alias("elo")) for s in (1, 2))))
    keys = ["player", "surface"] if by_surface else ["player"]
    tall = rows.select(*order, *(["surface"] if by_surface else []), both.alias("_s")).select(F.lit(True).alias("_new"), *order, *(["surface"] if by_surface else []), "_s.*")
    if before is not None:
        tall = tall.unionByName(before.select(F.lit(False).alias("_new"), *keys, "elo", F.col("n").alias("_n")), allowMissingColumns=True)
    late = F.struct("_new", *(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in order))
    n = F.count(F.lit(1)) if before is None else F.sum(F.coalesce("_n", F.lit(1)))
    return tall.groupBy(*keys).agg(F.max_by("elo", late).alias("elo"), n.alias("n"))


def smoothed(rows: DataFrame, value: str = "elo", keys: tuple[str, ...] = ("player",), width: int = 20, least: int = 5) -> Column:
    """The centred mean of `width` rows in order, null with fewer than `least` values."""
    over = Window.partitionBy(*keys).orderBy(*order_of(rows)).rowsBetween(-(width // 2), (width - 1) // 2)
    return F.when(F.count(value).over(over) >= least, F.avg(value).over(over))
