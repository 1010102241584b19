"""Packing of token sequences by patterns that a non-negative least squares fit repeats.

1. Whole texts are encoded and cut into pieces of at most `capacity` tokens; the pieces' lengths are counted.
2. Lengths are grouped in bins. Patterns of at most `depth` bins that fill a sequence are enumerated, their repeat
   counts are fitted to the histogram by non-negative least squares, and rounded down to what is there.
3. A pattern's slots take their bins' longest lengths, the last what fills the sequence best, so its repeats fall into
   a few runs of equal exact lengths. What
   is left over fills the remaining room, and then new sequences, by best fit on counts of lengths, longest first.
4. The plan says, for the r-th piece of a length, its sequence and offset; pieces are ranked within their length in
   salted buckets, so no task holds a length's pieces.

The plan is made on the driver from at most `capacity` counts, whatever the number of documents.

Null texts are empty and have the end id only; an empty table gives no rows; equal rows are packed each by itself;
longer documents are cut, which no other document is.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored, texts_of
from .pieces import PIECES, encoder

CAPACITY = 2048


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, *, end: int = 0, id: str = "doc_id", text: str = "text", held: int = PIECES) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each document's pieces. held: distinct pieces of text that a worker keeps, also after the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, held)
        for batch in batches:
            for part in slices(batch, text):
                ids, counts = coder.encode(texts_of(part, text))
                ends = np.cumsum(counts)
                ids = np.insert(ids.astype("<u4"), ends, end)
                counts = counts + 1
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                first = (np.cumsum(counts) - counts)[row] + start
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())], [id, "piece", "start", "length", "ids_crc32"])

    return bounded_batches(docs).select(id, text).mapInArrow(run, f"{id} {docs.schema[id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """x >= 0 of least |ax - b|: columns enter by steepest descent and leave where they would turn negative."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gain = a.T @ b
    for _ in range(most):
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            found = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (found > 0).all():
                break
            low = found <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - found[low], 1e-300)))
            x[at] += step * (found - x[at])
            gone = at[low & (x[at] <= 1e-12)]
            if not len(gone):
                gone = at[low][:1]
            x[gone], active[gone] = 0, False
        x[:] = 0
        x[at] = found
        gain = a.T @ (b - a @ x)
    return x


def patterns(bins: int, present: list[int], depth: int) -> list[tuple[int, ...]]:
    """Descending bins that sum to the whole, at most `depth` of them."""
    there, out = set(present), []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left in there and left <= (head[-1] if head else bins):
            out.append((*head, left))
        if len(head) + 2 <= depth:
            for x in present:
                if x < left and x <= (head[-1] if head else bins):
                    grow((*head, x), left - x)

    grow((), bins)
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, width: int = 16, depth: int = 3, shortest: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) for all pieces counted by length.

    Pieces under `shortest` are in no pattern: they fill the room that the longer ones leave.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = -(-capacity // width)
    of = -(-np.arange(capacity + 1) // width)
    histogram = np.bincount(of, weights=left, minlength=bins + 1)[1:]
    shapes = patterns(bins, [int(x) + 1 for x in np.flatnonzero(histogram) if (int(x) + 1) * width > shortest], depth)
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    if shapes:
        a = np.zeros((bins, len(shapes)))
        for j, shape in enumerate(shapes):
            for x in shape:
                a[x - 1, j] += 1
        weight = np.sqrt(np.arange(1, bins + 1) / bins)  # what is left over of short pieces is easy to place
        repeats = nnls(a * weight[:, None], histogram * weight, 3 * bins)
        for j in np.argsort(-repeats, kind="stable"):
            shape, n = shapes[j], int(repeats[j] + 1e-6)
            while n > 0:  # runs of equal exact lengths: the longest of each bin, and last what fills the sequence best
                own: list[int] = []
                for i, x in enumerate(shape):
                    top = capacity - sum(own) if i == len(shape) - 1 else x * width
                    low = (x - 1) * width + 1
                    there = np.flatnonzero(left[low : top + 1])[::-1] + low
                    own += [y for y in there[: len(own) + 1].tolist() if left[y] > own.count(y)][:1]
                if len(own) < len(shape):
                    break
                run = min([n, *(int(left[y]) // own.count(y) for y in set(own))])
                for y in own:
                    left[y] -= run
                rooms[capacity - sum(own)][tuple(own)] += run
                n -= run
    for length in range(capacity, 0, -1):  # best fit on counts
        for room in range(length, capacity):
            fits = room // length  # a sequence takes pieces of one length until no more fits
            while left[length] and rooms.get(room):
                own, n = rooms[room].popitem()
                run = min(n, int(left[length]) // fits)
                if run:
                    rooms[room - fits * length][(*own, *(length,) * fits)] += run
                    left[length] -= fits * run
                if run < n and 0 < (rest := int(left[length])) < fits:
                    rooms[room - rest * length][(*own, *(length,) * rest)] += 1
                    left[length], run = 0, run + 1
                if run < n:
                    rooms[room][own] += n - run
        if n := int(left[length]):
            fits = capacity // length  # several of one length in new sequences
            if n // fits:
                rooms[capacity - fits * length][(length,) * fits] += n // fits
            if n % fits:
                rooms[capacity - n % fits * length][(length,) * (n % fits)] += 1
            left[length] = 0
    return [(own, n) for room in sorted(rooms) for own, n in sorted(rooms[room].items())]


def packed(pieces: DataFrame, capacity: int = CAPACITY, *, id: str = "doc_id", rows_per_bucket: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (length between 1 and capacity)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first rank, sequence of that rank, offset
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for own, n in plan(counts, capacity):
        for length, at in zip(own, itertools.accumulate(own, initial=0), strict=False):
            places[length].append((used[length], sequence, at))
            used[length] += n
        sequence += n
    tables = {length: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in places.items()}

    buckets = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // rows_per_bucket)
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id, "piece", "ids_crc32"), F.lit(buckets)))
    sizes = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(id, "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")

    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, sequence, offset = tables[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], "right") - 1
                seq[own], at[own] = sequence[k] + rank[own] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(at)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, *, end: int = 0, id: str = "doc_id", text: str = "text", held: int = PIECES) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `capacity` tokens."""
    return packed(stored(cut_pieces(docs, path, capacity, end=end, id=id, text=text, held=held), "pieces"), capacity, id=id)
