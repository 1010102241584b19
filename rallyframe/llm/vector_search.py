"""Nearest vectors by randomly rotated one-bit codes.

A vector less the centre is rotated and each component's sign kept: D bits, packed, and two scalars, its norm and its
inner product with its own code. From these an inner product with a query is estimated with a known error, so a lower
bound of each distance follows; the estimated nearest of a block are measured first, and then every vector whose lower
bound does not exceed the k-th distance found.

Every row is indexed; the centre and the rotation (from a seed) are the only fitted parts, and the centre is a mean over
all rows. Equal vectors are one index entry with their k + 1 smallest ids, which are all that any answer can hold. Blocks
of queries meet blocks of entries, each pair in one task; of each pair k rows a query go on.

Vectors that are null, zero, hold null or non-finite components, or have another dimension than most take no part; ties
go to the smaller id; a repeated row counts as often as it is there; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_type, stored

#: Standard errors that a lower bound allows for.
SIGMAS = 3.5
ENTRIES, QUERIES = 8192, 2048


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def number(vectors: DataFrame, embedding: str) -> str:
    """Floats travel as floats; all measures are taken in double precision."""
    return "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"


def usable(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """_id, _v (array of number()) of vectors of any dimension with finite components, not all zero."""
    x = F.col("_v")
    good = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))) & F.exists(x, lambda y: y != 0)
    rows = vectors.select(F.col(id).alias("_id"), F.col(embedding).cast(f"array<{number(vectors, embedding)}>").alias("_v"))
    return rows.filter(x.isNotNull() & F.col("_id").isNotNull()).filter(good)


def index(vectors: DataFrame, k: int, *, id: str = "vec_id", embedding: str = "embedding", seed: int = 11) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Entries (_ids, _v, code, norm, along), the centre and the rotation."""
    rows = usable(vectors, id, embedding)
    most = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = most["d"] if most else 0
    rows = rows.filter(F.size("_v") == dim)
    center = np.array(rows.agg(*(F.avg(F.get("_v", F.lit(i))).alias(f"m{i}") for i in range(dim))).first()) if dim else np.zeros(0)
    turn = rotation(len(center), seed)
    nth = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    distinct = rows.withColumn("_n", nth).filter(F.col("_n") <= k + 1).groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("_v").to_numpy(zero_copy_only=False)).astype(np.float64) - center
            norm = np.linalg.norm(x, axis=1)
            y = (x / np.where(norm > 0, norm, 1)[:, None]) @ turn
            codes = np.packbits(y > 0, axis=1)
            along = np.abs(y).sum(axis=1) / np.sqrt(len(center))
            yield pa.RecordBatch.from_arrays([batch.column("_ids"), batch.column("_v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(along)], ["_ids", "_v", "code", "norm", "along"])

    kind = rows.schema["_id"].dataType.simpleString()
    entries = distinct.select("_ids", "_v").mapInArrow(encode, f"_ids array<{kind}>, _v array<{number(vectors, embedding)}>, code binary, norm double, along double")
    return stored(entries, "index"), center, turn


def packed_words(codes: list[bytes], dim: int) -> np.ndarray:
    """The codes as rows of 64-bit words, padded by zeros."""
    size = -(-dim // 64) * 8
    return np.frombuffer(b"".join(c.ljust(size, b"\0") for c in codes), np.uint64).reshape(len(codes), -1)


def signed_sums(codes: np.ndarray, ones: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of y over each code's ones, and the most by which it may be off: y is taken in 256 steps, one plane of bits for each of eight."""
    low, step = float(y.min()), max(float(y.max() - y.min()), 1e-300) / 255
    steps = np.rint((y - low) / step).astype(np.uint8)
    total = np.zeros(len(codes), np.int64)
    for k in range(8):
        plane = packed_words([np.packbits(steps >> k & 1).tobytes()], len(y))[0]
        total += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << k
    return low * ones + step * total, ones * (step / 2)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, *, id: str = "vec_id", embedding: str = "embedding", seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: each chosen row's k nearest other rows by Euclidean distance."""
    entries, center, turn = index(vectors, k, id=id, embedding=embedding, seed=seed)
    dim, kind, own = len(center), vectors.schema[id].dataType.simpleString(), arrow_type(vectors, id)
    asked = stored(usable(vectors.filter(queries), id, embedding).filter(F.size("_v") == dim).distinct(), "asked")
    across, down = 1 + entries.count() // ENTRIES, 1 + asked.count() // QUERIES
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", F.pmod(F.xxhash64("_id"), F.lit(down)).cast("int")).withColumn("e", every(across))
    right = entries.withColumn("e", F.pmod(F.xxhash64("_v"), F.lit(across)).cast("int")).withColumn("q", every(down))

    def search(ask: pa.Table, has: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if ask.num_rows and has.num_rows:
            original = np.stack(has.column("_v").to_numpy())
            codes = packed_words(has.column("code").to_pylist(), dim)
            ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
            members = has.column("_ids").to_pylist()
            norm, along = has.column("norm").to_numpy(), np.maximum(has.column("along").to_numpy(), 1e-12)
            error = SIGMAS * np.sqrt(np.maximum(0, 1 - along**2)) / along / np.sqrt(max(1, dim - 1))
            for name, v in zip(ask.column("_id").to_pylist(), ask.column("_v").to_numpy(), strict=True):
                v = v.astype(np.float64)
                q = v - center
                length = float(np.linalg.norm(q))
                y = (q / length if length else q) @ turn
                positive, slack = signed_sums(codes, ones, y)
                inner = (2 * positive - y.sum()) / np.sqrt(dim) / along
                wide = error + 2 * slack / np.sqrt(dim) / along
                square = norm**2 + length**2
                guess = square - 2 * norm * length * inner
                first = np.argpartition(guess, min(k, len(guess) - 1))[: k + 1]
                measured = lambda at: np.sqrt(((original[at].astype(np.float64) - v) ** 2).sum(axis=1))  # noqa: B023, E731
                found = [(d, m) for d, at in zip(measured(first), first, strict=True) for m in members[at] if m != name]
                limit = sorted(found)[k - 1][0] if len(found) >= k else np.inf
                low = square - 2 * norm * length * (inner + wide)
                at = np.flatnonzero(low <= limit * limit * (1 + 1e-9) + 1e-9)
                best = sorted((d, m) for d, x in zip(measured(at).tolist(), at, strict=True) if d <= limit for m in members[x] if m != name)[:k]
                for to, column in zip(out, ([name] * len(best), [m for _, m in best], [d for d, _ in best]), strict=True):
                    to += column
        return pa.table([pa.array(out[0], own), pa.array(out[1], own), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = left.groupBy("q", "e").cogroup(right.groupBy("q", "e")).applyInArrow(search, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
