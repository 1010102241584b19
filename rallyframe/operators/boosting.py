"""Second-order gradient boosting of trees for labels of 0 and 1, over histograms that Spark adds up.

Each feature is cut into bins at approximate quantiles once. A round fits one tree to the gradient g = p - y and the
hessian h = p (1 - p) of the log-loss, level by level: every task walks its rows down the trees so far (whole arrays at a
time) and adds up g and h by node, feature and bin; these rows are added up by a shuffle on node and feature, which also
finds each pair's best cut, so that the driver gets a row a node and feature. A cut gains

    (score(G_left, H_left) + score(G_right, H_right) - score(G, H)) / 2 - gamma,  score(G, H) = soft(G)^2 / (H + l2)

where soft draws G to 0 by l1; both sides need a hessian of min_child_weight. A leaf is -step * soft(G) / (H + l2). Rows of
a tree are drawn by a hash of their bins (equal rows together), features by a hash of tree and feature. Equal gains go to the smaller feature, then
the smaller bin. Every `refresh` trees the sums so far are written to the checkpoint folder, so no job walks more trees.

Null and NaN features are in a bin of their own below all values. A table without rows, or of one label, gives a model of
the prior alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import settled

#: A tree: by node (0 is the root, 2i + 1 and 2i + 2 follow i) the feature to look at (-1: a leaf), the last bin that goes left, the leaf's value.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(0.0, np.abs(g) - l1)


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node in which each row ends."""
    feature, cut, _ = tree
    node = np.zeros(len(bins), np.int64)
    while (inner := np.flatnonzero(feature[node] >= 0)).size:
        at = node[inner]
        node[inner] = 2 * at + 1 + (bins[inner, feature[at]] > cut[at])
    return node


def matrix(lists: pa.ListArray, width: int, dtype: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


@dataclass
class BoostedTrees:
    """A fitted model over a vector column `features`."""

    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], "left")) for j, e in enumerate(self.edges)]).astype(np.int64) if self.edges else np.zeros((len(x), 0), np.int64)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += tree[2][leaf_of(tree, bins)]
        return out

    def importances(self) -> np.ndarray:
        """Each feature's share of all gains."""
        return self.gains / self.gains.sum() if self.gains is not None and self.gains.sum() > 0 else np.zeros(len(self.edges))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds probability, a vector of the chances of 0 and 1."""
        d, margins, binned = len(self.edges), self.margins, self.binned

        @F.pandas_udf("double")
        def chance(features):
            x = np.array(features.tolist(), np.float64).reshape(-1, d)
            return type(features)(1.0 / (1.0 + np.exp(-margins(binned(x)))))

        p = df.withColumn("_p", chance(vector_to_array("features")))
        return p.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), "_p"))).drop("_p")


@dataclass(frozen=True)
class HistogramBoosting:
    """What to fit. columns: the share of features a tree may use; rows: the share of rows it sees."""

    rounds: int = 100
    depth: int = 6
    step: float = 0.1
    l2: float = 1.0
    l1: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 64
    seed: int = 42
    refresh: int = 20
    weight: str | None = None

    def copy(self, changes: dict) -> HistogramBoosting:
        return replace(self, **changes)

    def features_of(self, tree: int, d: int) -> np.ndarray:
        """The features that a tree may use."""
        order = sorted(range(d), key=lambda j: xxhash.xxh64_intdigest(f"{self.seed}:{tree}:{j}"))
        return np.array(sorted(order[: max(1, round(self.columns * d))])) if d else np.zeros(0, int)

    def fit(self, df: DataFrame) -> BoostedTrees:
        """df: features (vector) and label."""
        w = F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), w.alias("w"))
        first = rows.select(F.size("x").alias("d")).first()
        d = first["d"] if first else 0
        model = self._edges(rows, d)
        data = settled(self._binned(rows, model).withColumn("margin", F.lit(model.base)))
        for t in range(self.rounds if d else 0):
            if t and t % self.refresh == 0:
                data = settled(self._refreshed(data, model.trees[t - self.refresh :], d))
            tree = self._tree(data, model, t, d)
            if tree is None:
                break
            model.trees.append(tree)
        return model

    def _edges(self, rows: DataFrame, d: int) -> BoostedTrees:
        share = [i / self.bins for i in range(1, self.bins)]
        value = lambda j: F.when(~F.isnan(F.col("x")[j]), F.col("x")[j])
        found = rows.agg(F.sum(F.col("y") * F.col("w")).alias("ones"), F.sum("w").alias("all"), *(F.percentile_approx(value(j), share, 20 * self.bins).alias(f"e{j}") for j in range(d))).first()
        p = (found["ones"] or 0.0) / found["all"] if found["all"] else 0.5
        p = min(max(p, 1e-6), 1 - 1e-6)
        return BoostedTrees([sorted(set(found[f"e{j}"] or [])) for j in range(d)], float(np.log(p / (1 - p))), gains=np.zeros(d))

    def _binned(self, rows: DataFrame, model: BoostedTrees) -> DataFrame:
        d = len(model.edges)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = model.binned(matrix(batch.column("x"), d, np.float64))
                    key = [xxhash.xxh64_intdigest(r.tobytes()) >> 1 for r in bins]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * d, pa.int32()), pa.array(bins.ravel().astype(np.int16)))
                    yield pa.RecordBatch.from_arrays([lists, batch.column("y"), batch.column("w"), pa.array(key, pa.int64())], ["bins", "y", "w", "key"])

        return rows.mapInArrow(work, "bins array<smallint>, y double, w double, key long")

    def _refreshed(self, data: DataFrame, trees: list[Tree], d: int) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = batch.column("margin").to_numpy() + BoostedTrees([[]] * d, 0.0, trees).margins(matrix(batch.column("bins"), d, np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "y", "w", "key")), pa.array(margin)], ["bins", "y", "w", "key", "margin"])

        return data.mapInArrow(work, "bins array<smallint>, y double, w double, key long, margin double")

    def _tree(self, data: DataFrame, model: BoostedTrees, t: int, d: int) -> Tree | None:
        """The next tree, or None if nothing gains."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        recent, usable = model.trees[t - t % self.refresh :], self.features_of(t, d)
        open_nodes = [0]
        for level in range(self.depth + 1):
            found = self._level(data, recent, (feature.copy(), cut.copy(), value.copy()), open_nodes, usable, t, d, level < self.depth)
            best: dict[int, tuple] = {}
            for r in found:
                node = r["node"]
                value[node] = -self.step * float(soft(np.float64(r["g"]), self.l1)) / (r["h"] + self.l2) if r["h"] + self.l2 > 0 else 0.0
                if r["gain"] is not None and r["gain"] > 1e-12 and (node not in best or (-r["gain"], r["feature"]) < best[node][:2]):
                    best[node] = (-r["gain"], r["feature"], r["bin"])
            open_nodes = []
            for node, (gain, j, b) in sorted(best.items()):
                feature[node], cut[node] = j, b
                model.gains[j] -= gain
                open_nodes += [2 * node + 1, 2 * node + 2]
            if not open_nodes:
                break
        return (feature, cut, value) if feature[0] >= 0 else None

    def _level(self, data: DataFrame, trees: list[Tree], partial: Tree, nodes: list[int], usable: np.ndarray, t: int, d: int, splits: bool) -> list:
        """node, feature, g, h of the node, and the best gain and bin of the feature there: a row a node and feature (one feature where nothing is split any more)."""
        used = usable if splits else usable[:1]
        width, place = self.bins + 1, np.full(len(partial[0]), -1)
        place[nodes] = np.arange(len(nodes))
        limit, salt = int(self.rows * (1 << 31)), xxhash.xxh64_intdigest(f"{self.seed}:{t}") >> 1
        me = self

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(nodes), len(used), width, 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, (y, w, margin, key) = matrix(batch.column("bins"), d, np.int64), (batch.column(c).to_numpy() for c in ("y", "w", "margin", "key"))
                at = place[leaf_of(partial, bins)]
                keep = at >= 0
                if me.rows < 1:
                    mixed = (key.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
                    keep &= (mixed >> np.uint64(33)).astype(np.int64) < limit
                bins, at, y, w = bins[keep], at[keep], y[keep], w[keep]
                margin = margin[keep] + BoostedTrees([[]] * d, 0.0, trees).margins(bins)
                p = 1.0 / (1.0 + np.exp(-margin))
                for k, j in enumerate(used):
                    cell = (at * len(used) + k) * width + bins[:, j]
                    for s, x in enumerate((w * (p - y), w * p * (1 - p))):
                        total.reshape(-1, 2)[:, s] += np.bincount(cell, weights=x, minlength=len(nodes) * len(used) * width)
            flat = total.reshape(len(nodes) * len(used), -1)
            full = np.flatnonzero(np.abs(flat).sum(axis=1) > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * width * 2, pa.int32()), pa.array(flat[full].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes)[full // len(used)], pa.int32()), pa.array(used[full % len(used)], pa.int32()), lists], ["node", "feature", "sums"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i, j, x in zip(batch.column("node").to_pylist(), batch.column("feature").to_pylist(), matrix(batch.column("sums"), 2 * width, np.float64), strict=True):
                    sums[i, j] = sums[i, j] + x if (i, j) in sums else x
            rows = [(i, j, *me.best_cut(x.reshape(width, 2), splits)) for (i, j), x in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32()), strict=True)], ["node", "feature", "g", "h", "gain", "bin"])

        return data.mapInArrow(scan, "node int, feature int, sums array<double>").repartition("node", "feature").mapInArrow(best, "node int, feature int, g double, h double, gain double, bin int").collect()

    def best_cut(self, sums: np.ndarray, splits: bool = True) -> tuple[float, float, float | None, int | None]:
        """g and h of a node, and the best gain and last left bin of a feature by its sums of (g, h) by bin."""
        g, h = sums.sum(axis=0)
        left = np.cumsum(sums, axis=0)[:-1]
        right = np.array([g, h]) - left
        # bins without rows are no cuts of their own
        some = (np.abs(sums[:-1]).sum(axis=1) > 0) & (left[:, 1] >= self.min_child_weight) & (right[:, 1] >= self.min_child_weight)
        if not splits or not some.any():
            return float(g), float(h), None, None
        score = lambda g, h: soft(g, self.l1) ** 2 / np.maximum(h + self.l2, 1e-12)
        gain = np.where(some, (score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - score(np.float64(g), np.float64(h))) / 2 - self.gamma, -np.inf)
        at = int(np.argmax(gain))
        return float(g), float(h), float(gain[at]), at
