"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's set holds the 64-bit hashes of its distinct shingles; its sketch is the k smallest. Documents of equal
   sets form a class, and only one representative of each goes on.
2. Inverted lists hold the sketches' values. Two sets over the threshold t share far more than half of their sketches
   (of 32 values 29 +- 1.5 at t = 0.85, and all of the set for small ones), so each representative is listed only under
   its rarest values, as many as any partner of that overlap must meet one of. Common values drop out this way.
3. The members of a list form a group under the list's smallest member; equal groups of many lists fall together. In a
   group, an estimate from the bottom-k of the union of two sketches filters pairs, the full sets decide, and pairs that
   are connected already are passed over. A group of many shingles is cut into tiles, whose members are compared among
   themselves; one member of each tile's largest part is compared with those of the other tiles; and then only members
   outside the group's largest connected part meet all the rest. So m near copies take about m times a tile's members
   of comparisons, and what isn't connected yet is compared in full.
4. The links' connected components are found by alternating large and small stars.

Null and empty texts have an empty set and are linked with nothing. Texts of fewer words than a shingle have one
shingle, the whole sequence. Rows with equal ids are documents of their own that share their id; a null id is never the
smallest. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, mixed, release, slices, split_words, spread, stored, texts_of, without

K = 32
#: Standard errors below the threshold at which an estimate rules a pair out.
ERRORS = 8.0
#: Shingles of a tile: what one task holds of a group is at most two tiles, or two documents.
TILE = 1_500_000
_MOST = np.iinfo(np.int64).max


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes (as signed 64-bit integers)."""
    codes, starts, words = split_words(pc.ascii_lower(texts))
    word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))[codes]
    n = max(0, len(word) - width + 1)
    with np.errstate(over="ignore"):
        hashed = np.full(n, width, np.uint64)
        for j in range(width):
            hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + word[j : n + j])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(hashed[a : b - width + 1].view(np.int64))
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for x in word[a:b]:
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x)
                yield h.view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def class_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def sketched(docs: DataFrame, width: int, k: int, id: str, text: str) -> DataFrame:
    """id, n_shingles, class (null for an empty set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                n, classes, sketches = [], [], []
                for own in shingle_sets(texts_of(part, text), width):
                    n.append(len(own))
                    classes.append(class_of(own) if len(own) else None)
                    sketches.append(own[:k])
                yield pa.RecordBatch.from_arrays([part.column(id), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))], [id, "n_shingles", "class", "sketch"])

    return bounded_batches(docs).select(id, text).mapInArrow(run, f"{id} {docs.schema[id].dataType.simpleString()}, n_shingles long, class long, sketch array<long>")


def groups(classes: DataFrame) -> DataFrame:
    """pivot, class, n_shingles, rep: the groups of two members and more that inverted lists give."""
    size = F.size("sketch")
    listed = classes.select("class", size.alias("_s"), F.explode("sketch").alias("_v"))
    common = listed.groupBy("_v").agg(F.count(F.lit(1)).alias("_f")).filter("_f > 1")
    own = Window.partitionBy("class")
    rarest = (
        listed.join(common, "_v")
        .withColumn("_rank", F.row_number().over(own.orderBy("_f", "_v")))
        .withColumn("_alone", F.col("_s") - F.count(F.lit(1)).over(own))  # values that nobody else has come first
        .filter(F.col("_rank") + F.col("_alone") <= F.col("_s") - F.ceil(F.col("_s") * 0.5) + 1)
        .select("_v", "class")
    )
    lists = stored(rarest, "lists")
    pivots = lists.groupBy("_v").agg(F.min("class").alias("pivot"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_v", "pivot")
    members = lists.join(pivots, "_v").select("pivot", "class").distinct()
    return members.join(classes.select("class", "n_shingles", "rep"), "class")


def connected(sets: list[np.ndarray], sketches: list[np.ndarray], tile: np.ndarray, threshold: tuple[int, int], k: int, root: np.ndarray) -> np.ndarray:
    """Each member's smallest connected member. tile: 0 or 1; if there are both, only pairs across them count. root: the same, as known before."""
    m, root = len(sets), root.copy()
    n = np.fromiter(map(len, sets), np.int64, m)
    t = threshold[0] / threshold[1]
    across = bool(tile.any()) and not tile.all()

    flat, ends = np.concatenate(sets), np.cumsum(n)

    def held(of: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which values are in the sorted set."""
        return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values

    padded = np.full((m, k), _MOST, np.int64)
    for i, x in enumerate(sketches):
        padded[i, : len(x)] = x
    kept = np.fromiter(map(len, sketches), np.int64, m)
    for i in range(m):
        j = np.arange(i + 1, m)
        j = j[(root[j] != root[i]) & (threshold[1] * np.minimum(n[j], n[i]) >= threshold[0] * np.maximum(n[j], n[i]))]
        if across:
            j = j[tile[j] != tile[i]]
        if len(j):
            j = j[held(sketches[i], padded[j]).sum(axis=1) >= np.ceil(0.5 * np.minimum(kept[i], kept[j]))]
        if not len(j):
            continue
        both = np.sort(np.concatenate([np.broadcast_to(padded[i], (len(j), k)), padded[j]], axis=1), axis=1)
        again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _MOST)
        rank = np.cumsum(np.concatenate([np.ones((len(j), 1), bool), ~again], axis=1) & (both < _MOST), axis=1)
        of = np.minimum(k, rank[:, -1])  # the union's bottom-k, of which so many are in both
        estimate = (again & (rank[:, 1:] <= of[:, None])).sum(axis=1) / of
        j = j[estimate >= t - ERRORS * np.sqrt(t * (1 - t) / of)]
        if not len(j):
            continue
        which, row = spread(ends[j] - n[j], n[j])
        common = np.bincount(row[held(sets[i], flat[which])], minlength=len(j))
        linked = j[threshold[1] * common >= threshold[0] * (n[i] + n[j] - common)]
        for r in np.unique(root[linked]).tolist():
            low, high = sorted((r, int(root[i])))
            root[root == high] = low
    return root


def compared(docs: DataFrame, cells: DataFrame, width: int, k: int, threshold: tuple[int, int], id: str, text: str) -> DataFrame:
    """Pairs (x, y), x < y, that join what was not joined before. cells: class, rep, and at: an array of pivot, a, b (the cell), tile (the member's side: a or b) and root (its part so far)."""
    targets = stored(cells.groupBy("class", F.col("rep").alias("_rep")).agg(F.flatten(F.collect_list("at")).alias("_in")), "targets")
    if (targets.agg(F.sum(F.size("_in"))).first()[0] or 0) <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    wanted = docs.select(id, text).join(targets, F.col(id).eqNullSafe(F.col("_rep"))).select(text, "class", "_in")
    names = ["pivot", "a", "b", "tile", "root"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows: list[tuple] = []
                for own, name, into in zip(shingle_sets(texts_of(part, text), width), part.column("class").to_pylist(), part.column("_in").to_pylist(), strict=True):
                    if len(own) and class_of(own) == name:  # else another document of the same id
                        rows += [(*(x[c] for c in names), name, own[:k], own.tobytes()) for x in into]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], [*names, "class", "sketch", "set"])

    def compare(table: pa.Table) -> pa.Table:
        classes, first = np.unique(table.column("class").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        sets = [np.frombuffer(x.as_py(), np.int64) for x in table.column("set")]
        sketches = [np.array(x.as_py(), np.int64) for x in table.column("sketch")]
        tile = (table.column("tile").to_numpy() != table.column("a")[0].as_py()).astype(int)
        _, leader, part = np.unique(table.column("root").to_numpy(), return_index=True, return_inverse=True)
        before = leader[part]
        after = connected(sets, sketches, tile, threshold, k, before)
        pairs = np.unique(np.stack([classes[after], classes[before]])[:, after != before], axis=1)
        release()
        return pa.table({"x": pa.array(pairs.min(axis=0), pa.int64()), "y": pa.array(pairs.max(axis=0), pa.int64())})

    schema = "pivot long, a int, b int, tile int, root long, class long, sketch array<long>, set binary"
    return wanted.mapInArrow(spread, schema).groupBy("pivot", "a", "b").applyInArrow(compare, "x long, y long")


def links(docs: DataFrame, members: DataFrame, width: int, k: int, threshold: tuple[int, int], id: str, text: str) -> DataFrame:
    """Pairs (x, y) of classes that connect whatever is connected within the groups."""
    how = (width, k, threshold, id, text)
    cell = lambda a, b, tile, root: F.struct("pivot", a.cast("int").alias("a"), b.cast("int").alias("b"), tile.cast("int").alias("tile"), root.alias("root"))
    tiles = members.groupBy("pivot").agg(F.ceil(F.sum("n_shingles") / TILE).cast("int").alias("tiles"))
    placed = members.join(tiles, "pivot").withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
    within = placed.select("class", "rep", F.array(cell(F.col("tile"), F.col("tile"), F.col("tile"), F.col("class"))).alias("at"))
    found = stored(compared(docs, within, *how), "links")
    large = stored(placed.filter("tiles > 1"), "large")
    if large.isEmpty():
        return found

    def parts(edges: DataFrame) -> DataFrame:
        """The members of large groups with their part's root."""
        known = components(edges).withColumnRenamed("root", "_root")
        return stored(large.join(known, "class", "left").withColumn("root", F.coalesce("_root", "class")).drop("_root"), "parts")

    zero = F.lit(0)
    sizes = parts(found).groupBy("pivot", "tile", "root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("class", "rep")).alias("m"))
    leaders = sizes.groupBy("pivot", "tile").agg(F.max_by(F.struct("m", "root"), F.struct("n", "root")).alias("l"))
    met = leaders.select(F.col("l.m.class").alias("class"), F.col("l.m.rep").alias("rep"), F.array(cell(zero - 1, zero - 1, zero - 1, F.col("l.root"))).alias("at"))
    found = stored(found.union(compared(docs, met, *how)), "links")

    rooted = parts(found)
    weight = rooted.groupBy("pivot", "root").agg(F.sum("n_shingles").alias("s"))
    whole = weight.groupBy("pivot").agg(F.max_by("root", F.struct("s", "root")).alias("main"), F.max("s").alias("main_s"), F.sum("s").alias("all_s")).filter("all_s > main_s")
    # tiles of the rest come first; a member of the rest meets all tiles, one of the main part those of the rest
    count = lambda s: F.ceil(s / TILE).cast("int")
    dealt = rooted.drop("tiles", "tile").join(whole, "pivot").select("*", count(F.col("all_s") - F.col("main_s")).alias("rest"), count(F.col("main_s")).alias("mains"), (F.col("root") == F.col("main")).alias("in_main"))
    tile = F.when(F.col("in_main"), F.col("rest") + F.pmod(F.xxhash64("class"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("class"), F.col("rest"))).cast("int")
    dealt = dealt.withColumn("tile", tile)
    others = F.sequence(zero, F.when(F.col("in_main"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    at = F.transform(others, lambda u: cell(F.least(u, "tile"), F.greatest(u, "tile"), F.col("tile"), F.col("root")))
    return found.union(compared(docs, dealt.select("class", "rep", at.alias("at")), *how))


def components(edges: DataFrame) -> DataFrame:
    """class, root (the component's smallest class) for all classes on edges x, y (x < y)."""
    edges = stored(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("m").alias("x"), "y")  # all larger neighbours to the smallest
        down = stored(large.filter("x < y").distinct(), "edges")
        low = down.groupBy("y").agg(F.min("x").alias("m"))
        small = down.join(low, "y").select(F.col("m").alias("x"), F.col("x").alias("v")).filter("x < v").select("x", F.col("v").alias("y")).union(low.select(F.col("m").alias("x"), "y"))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("y").alias("class"), F.col("x").alias("root"))


def near_duplicates(docs: DataFrame, *, words: int = 5, threshold: tuple[int, int] = (80, 100), k: int = K, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: documents linked, over any number of steps, by a Jaccard index of threshold[0] / threshold[1] or more."""
    rows = stored(sketched(docs, words, k, id, text), "sketches")
    classes = stored(rows.filter("class is not null").groupBy("class").agg(F.min(id).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    members = stored(groups(classes), "groups")
    found = components(links(docs, members, words, k, threshold, id, text))
    rooted = classes.select("class", "rep").join(found, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("class", "component_id"), "components")
    out = rows.select(id, "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col(id)).otherwise(F.col("component_id"))
    return out.select(id, "n_shingles", component.alias("component_id"), F.coalesce(F.col(id) == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id: str = "doc_id", **how) -> DataFrame:
    """The documents less those that near_duplicates doesn't keep, all columns as they are."""
    return without(docs, id, near_duplicates(docs, id=id, **how).filter(~F.col("kept")).select(id))
