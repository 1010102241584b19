"""Log ratios of hashed n-grams between a trusted target and the raw corpus, for scoring of documents.

N-grams are of four kinds, one of each for every word of a text: the word in lower case without leading and trailing
marks, the word as it stands, the word as it stands with the one before it, and the shapes of these two (letter case,
trailing marks, and whether a word repeats the one before it). Each kind is hashed into SPACE buckets.
The raw multinomials count every document, the target's the documents labelled as target:

    ratio(bucket) = log((target + PRIOR) / (raw * T / R + PRIOR)), T and R being all words of target and raw

A ratio is worth something only as far as it exceeds its own sampling error: it is drawn towards 0 by Z standard errors
(1 / (target + PRIOR) + 1 / (raw * T / R + PRIOR) under the root) and is 0 within them. So thousands of words that the
labels happen to hold a little too seldom weigh nothing, and a few words that trusted documents avoid are not drowned.
A document is always scored by counts without itself, labelled or not.

A document's score is the mean ratio over its n-grams of the three kinds of words, plus the mean ratio over its shapes
where that is negative: odd shapes speak against a document, ordinary ones don't speak for it, as nearly all have them.

A bucket of fewer than LEAST occurrences can't exceed Z errors whatever the target has of it, so it is not gathered;
what is gathered grows with the corpus until all buckets are filled (KINDS * SPACE rows of 12 bytes).
At most MAX_LABELS labelled documents (those of smallest hash) make the target, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, slices, split_words, spread, texts_of

MAX_LABELS = 60_000
SPACE = 1 << 21
KINDS = 4
#: Buckets whose counts travel together.
RANGE = 1 << 13
PRIOR, Z = 3.0, 3.0
#: The fewest occurrences whose ratio can exceed its errors: all of them, or none, being the target's.
LEAST = next(m for m in range(1, 1000) if math.log((m + PRIOR) / PRIOR) > Z * math.sqrt(1 / (m + PRIOR) + 1 / PRIOR))
_EDGE = r"^[^\pL\pN]+|[^\pL\pN]+$"


def hashed(words: pa.Array) -> np.ndarray:
    """64 bits of each string: the sum of a hash of each byte and its place, mixed."""
    words = pa.concat_arrays([words])
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8, int(offsets[-1]))
    place, _ = spread(np.zeros(len(words), np.int64), np.diff(offsets))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1)))])
    return mixed(np.diff(sums[offsets]))


def ngrams(codes: np.ndarray, starts: np.ndarray, words: list[str]) -> list[np.ndarray]:
    """Buckets of each word of the texts that split_words gave, an array for each kind."""
    column = pa.array(words, pa.string())
    core = pc.replace_substring_regex(pc.utf8_lower(column), _EDGE, "")
    low, raw, shape = hashed(pc.if_else(pc.equal(core, ""), column, core))[codes], hashed(column)[codes], hashed(shapes(column))[codes]
    first = np.zeros(len(codes), bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    again = np.zeros(len(codes), bool)
    again[1:] = low[1:] == low[:-1]
    shape = mixed(shape + (again & ~first).astype(np.uint64))
    kinds = (low, raw, paired(raw, first), paired(shape, first))
    return [kind * SPACE + (x & np.uint64(SPACE - 1)).astype(np.int64) for kind, x in enumerate(kinds)]


def shapes(words: pa.Array) -> pa.Array:
    """U, T, l or o (upper case of three letters and more, a capital first, a small letter first, other) and the last two marks after the last letter or digit."""
    first = pc.utf8_slice_codeunits(words, 0, 1)
    upper = pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 2))
    kind = pc.if_else(upper, "U", pc.if_else(pc.utf8_is_upper(first), "T", pc.if_else(pc.utf8_is_alpha(first), "l", "o")))
    marks = pc.replace_substring_regex(words, r"^.*[\pL\pN]", "")
    return pc.binary_join_element_wise(kind, pc.utf8_slice_codeunits(marks, -2, 1 << 30), "")


def paired(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each hash with the one before it; first: where a text begins."""
    former = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        former[1:] = hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        former[first] = 0
        return mixed(former + hashes + np.uint64(7))


def bounded_labels(labels: DataFrame, id: str) -> DataFrame:
    """At most MAX_LABELS rows: _label_of, _label (1 target: good and not toxic; else 0)."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("_label_of")).agg(F.min(good.cast("int")).alias("_label")).orderBy(F.xxhash64("_label_of"), "_label_of").limit(MAX_LABELS)


def marked(docs: DataFrame, labels: DataFrame, id: str, text: str) -> DataFrame:
    """_id, _text, _label (null: not labelled)."""
    rows = bounded_batches(docs).select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    return rows.join(F.broadcast(bounded_labels(labels, id)), F.col("_id") == F.col("_label_of"), "left").select("_id", "_text", "_label")


def targets_of(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("_label"), 0).to_numpy(zero_copy_only=False) == 1


class Ratios:
    """The counts of every bucket that can tell something."""

    def __init__(self, buckets: np.ndarray, raw: np.ndarray, target: np.ndarray):
        total = buckets < 0  # the row of all words
        self.share = float(target[total].sum() / max(1, raw[total].sum()))
        self.buckets, self.raw, self.target = (x[~total] for x in (buckets, raw, target))

    def laid_out(self) -> tuple[np.ndarray, np.ndarray]:
        """raw and target by bucket: what a task scores by."""
        raw, target = np.zeros(KINDS * SPACE, np.float32), np.zeros(KINDS * SPACE, np.float32)
        raw[self.buckets], target[self.buckets] = self.raw, self.target
        return raw, target

    def scores(self, counts: tuple[np.ndarray, np.ndarray], grams: list[np.ndarray], starts: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Each text's score by counts without it; 0 without words. target: which texts are among the target's."""
        n, sums = len(starts) - 1, []
        if not self.share:
            return np.zeros(n)
        row = np.repeat(np.arange(n), np.diff(starts))
        for buckets in grams:
            known = counts[0][buckets] >= LEAST
            found, own = np.unique(row[known] * (KINDS * SPACE) + buckets[known], return_counts=True)
            at, bucket = np.divmod(found, KINDS * SPACE)
            expected = np.maximum(counts[0][bucket].astype(np.float64) - own, 0) * self.share + PRIOR
            counted = np.maximum(counts[1][bucket].astype(np.float64) - own * target[at], 0) + PRIOR
            ratio = np.log(counted / expected)
            ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - Z * np.sqrt(1 / counted + 1 / expected))
            sums.append(np.bincount(at, weights=own * ratio, minlength=n))
        words = np.maximum(1, np.diff(starts))
        return sum(sums[:-1]) / (words * (KINDS - 1)) + np.minimum(0, sums[-1] / words)


def packed(x: np.ndarray, bytes: int) -> bytes:
    """Numbers as planes of bytes, of which a shuffle's compression leaves little where the numbers are small."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T[:bytes].tobytes()


def unpacked(x: bytes, bytes: int) -> np.ndarray:
    planes = np.frombuffer(x, np.uint8).reshape(bytes, -1).astype(np.int64)
    return sum(planes[k] << (8 * k) for k in range(bytes))


def fit(docs: DataFrame) -> Ratios:
    """docs: _text and _label. A task adds up its own counts and sends them by ranges of buckets; ranges are added up as they stream in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = np.zeros((2, KINDS * SPACE), np.uint32), np.zeros((2, 1), np.int64)
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                codes, starts, distinct = split_words(texts_of(part, "_text"))
                good = np.repeat(targets_of(part), np.diff(starts))
                words += [[len(codes)], [int(good.sum())]]
                for buckets in ngrams(codes, starts, distinct):
                    np.add.at(counts[0], buckets, np.uint32(1))
                    np.add.at(counts[1], buckets[good], np.uint32(1))
        rows = [(-1, np.array([RANGE - 1]), words)]
        for k in range(0, KINDS * SPACE // RANGE):
            own = counts[:, k * RANGE : (k + 1) * RANGE]
            if len(at := np.flatnonzero(own[0])):
                rows.append((k, at, own[:, at]))
            if len(rows) == 64 or k + 1 == KINDS * SPACE // RANGE:
                found = [(k, packed(np.diff(at, prepend=0), 2), packed(x[0], 4), packed(x[1], 4)) for k, at, x in rows]
                yield pa.RecordBatch.from_pylist([dict(zip(("range", "gaps", "raw", "target"), r, strict=True)) for r in found], schema)
                rows = []

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, gaps, *numbers in zip(*(batch.column(c).to_pylist() for c in ("range", "gaps", "raw", "target")), strict=True):
                total = totals.setdefault(k, np.zeros((2, RANGE), np.int64))
                total[:, np.cumsum(unpacked(gaps, 2))] += [unpacked(x, 4) for x in numbers]
        for k, total in totals.items():
            at = np.flatnonzero(total[0] >= (LEAST if k >= 0 else 0))
            yield pa.RecordBatch.from_arrays([pa.array(k * RANGE + at, pa.int32()), *(pa.array(x[at].astype(np.float64)) for x in total)], ["bucket", "raw", "target"])

    schema = pa.schema([("range", pa.int32()), ("gaps", pa.binary()), ("raw", pa.binary()), ("target", pa.binary())])
    ranges = docs.select("_text", "_label").mapInArrow(count, "range int, gaps binary, raw binary, target binary")
    found = ranges.repartition("range").mapInArrow(add, "bucket int, raw double, target double").toArrow()
    return Ratios(*(found.column(c).to_numpy() for c in ("bucket", "raw", "target")))
