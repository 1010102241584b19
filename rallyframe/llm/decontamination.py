"""Finds benchmark passages in documents by spaced seeds.

A seed hashes the words under a fixed mask's ones and ignores the words under its zeros, so a substituted word spoils
only the seeds that look at it. Documents' seeds meet the benchmark's; around each hit the passage is laid over the
document, and it counts if some window of `window` words (or the whole of a shorter item) agrees in `agree` of its
positions. Words are runs of letters and digits, case folded. Items (or windows) under SHORT words are sought by runs of
words so short that every accepted pattern of substitutions leaves one whole; the masks leave none out from SHORT words
on at the window and agreement; parameters at which they would are an error. Items of one to four words must be there verbatim at 0.8.

Hits are joined by distinct seeds first: a seed that stands often in a text and in an item gives one row with both counts.
Rows of up to DENSE hits are spread over their diagonals; for others all diagonals of the pair are counted at once, one
item word after the other, so repeated words cost words x words in time but never in memory.

The benchmark is the stated query set: it is taken in blocks of items of a bounded number of words, each sent to the
tasks once, and every document is held against every block. Null and empty texts hold nothing; equal items and equal
documents are reported each by itself, but `without_contaminated` drops all rows of an id in which an item is found; an
empty table gives no rows; other columns don't matter, whatever their names; ids may be of any type.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, bounded_batches, coded_lists, mixed, slices, spread, texts_of, without

#: Fixed masks: six words each, of seven to ten positions.
MASKS = ("1110111", "11011011", "110010111", "1010110011")
BLOCK_WORDS = 1_000_000
WINDOW, AGREE = 13, 0.8
#: Below so many words the masks don't meet every accepted pattern.
SHORT = 12
CHUNK_HITS = 1 << 20
#: Hits of one seed between one text and one item that are still spread one by one.
DENSE = 4096


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, and where each text's start (and the end)."""
    codes, starts, words = coded_lists(pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pN]+"))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))[codes]
    if "" in words:
        full = codes != words.index("")
        return hashes[full], np.concatenate([[0], np.cumsum(full)])[starts]
    return hashes, starts


def seeds(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The seed that begins at each word, as far as the mask fits."""
    n = len(words) - len(mask) + 1
    out = np.full(max(0, n), salt, np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1" and n > 0:
                out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
    return mixed(out)


def needed(words: int, agree: float) -> int:
    """The positions of so many that must agree."""
    return int(np.ceil(agree * words - 1e-9))


def whole_run(words: int, agree: float) -> int:
    """The longest run that agrees wherever the accepted substitutions fall."""
    same = max(1, needed(words, agree))
    return -(-same // (words - same + 1))


@functools.lru_cache
def masks_meet(words: int, agree: float) -> bool:
    """Whether some mask fits into so many words whichever of them the accepted substitutions are (False too where there are too many ways to look at)."""
    gone = words - needed(words, agree)
    if math.comb(words, gone) > 1_000_000:
        return False
    fits = [sum(1 << (at + i) for i, bit in enumerate(mask) if bit == "1") for mask in MASKS for at in range(words - len(mask) + 1)]
    return all(any(not fit & lost for fit in fits) for lost in (sum(1 << i for i in c) for c in itertools.combinations(range(words), gone)))


def checked(window: int, agree: float) -> None:
    """ValueError for a window and agreement at which the masks would miss accepted passages."""
    if missed := [w for w in range(SHORT, window + 1) if not masks_meet(w, agree)]:
        raise ValueError(f"the masks don't meet every accepted pattern of {missed[0]} words at an agreement of {agree}; take a window under {missed[0]} or a higher agreement")


class Benchmark:
    """A block of items: all words, and the seeds with their places."""

    def __init__(self, items: list, texts: list[str | None], window: int = WINDOW, agree: float = AGREE):
        self.items, self.window, self.agree = items, window, agree
        self.words, self.starts = word_hashes(pa.array([x or "" for x in texts], pa.string()))
        self.size = np.diff(self.starts)
        over = np.minimum(self.size, window)
        run = np.array([0, *(whole_run(w, agree) for w in range(1, SHORT))])[np.where(over < SHORT, over, 0)]  # 0: by masks
        self.least = np.array([needed(w, agree) for w in range(SHORT)])
        self.masks = [(mask, salt, 0) for salt, mask in enumerate(MASKS)] + [("1" * r, len(MASKS) + r, r) for r in np.unique(run[run > 0]).tolist()]
        found, places = [], []
        for mask, salt, r in self.masks:
            own = seeds(self.words, mask, salt)
            place = np.arange(len(own))
            item = np.searchsorted(self.starts, place, "right") - 1
            inside = (place + len(mask) <= self.starts[item + 1]) & (run[item] == r)
            found.append(own[inside])
            places.append(place[inside])
        seed, place = np.concatenate(found), np.concatenate(places)
        item = np.searchsorted(self.starts, place, "right") - 1
        order = np.lexsort((item, seed))
        seed, item, self.place = seed[order], item[order], place[order]
        first = runs_of(seed, item)
        self.seed, self.item, self.first, self.often = seed[first], item[first], first, np.diff(np.append(first, len(seed)))
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(seed)) * 16))))
        self.sieve = np.zeros(1 << self.bits, bool)  # most of the documents' seeds stop here
        self.sieve[(self.seed >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def laid_whole(self, hits: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of hits of short items, those where the whole item agrees: text, item, words that agree, first word; the best place of each pair."""
        text, item, shift = hits
        first, size = self.starts[item] + shift, self.size[item]
        inside = (first >= starts[text]) & (first + size <= starts[text + 1])
        text, item, first, size = text[inside], item[inside], first[inside], size[inside]
        equal = np.zeros(len(text), np.int64)
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > k)
            equal[on] += words[first[on] + k] == self.words[self.starts[item[on]] + k]
        rows = np.stack([text, item, equal, first - starts[text]])[:, equal >= self.least[size]]
        return best_rows(rows)

    def laid_everywhere(self, own: np.ndarray, i: int) -> tuple[int, int, int] | None:
        """The best place of an item in a text whatever the diagonal: words that agree, first word, words laid over."""
        item = self.words[self.starts[i] : self.starts[i + 1]]
        n, m = len(own), len(item)
        w = m if m < min(SHORT, self.window + 1) else min(self.window, m)
        if n < w:
            return None
        equal, last, most = np.zeros(n + m - 1, np.int32), np.zeros(n + m - 1, np.int32), np.zeros(n + m - 1, np.int32)
        for j in range(m):  # on diagonal e the item's word j meets the text's word e - (m - 1) + j
            same, at = own == item[j], m - 1 - j
            equal[at : at + n] += same
            last[at : at + n] += same
            if j >= w:
                last[at + w : at + w + n] -= own == item[j - w]
            if j >= w - 1:
                np.maximum(most[at + w - 1 : at + n], last[at + w - 1 : at + n], out=most[at + w - 1 : at + n])
        e = np.flatnonzero(most >= needed(w, self.agree))
        if not len(e):
            return None
        d = e - (m - 1)
        first, over = np.maximum(d, 0), np.minimum(m, n - d) - np.maximum(0, -d)
        best = np.lexsort((over, first, equal[e]))[-1]
        return int(equal[e[best]]), int(first[best]), int(over[best])

    def hits(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and item with more hits than are spread; and text, item, diagonal of all other hits, each once."""
        dense, parts = [np.zeros((2, 0), np.int64)], [np.zeros((3, 0), np.int64)]
        for mask, salt, _ in self.masks:
            own = seeds(words, mask, salt)
            at = np.flatnonzero(self.sieve[(own >> np.uint64(64 - self.bits)).astype(np.int64)])
            at = at[self.seed[np.minimum(np.searchsorted(self.seed, own[at]), len(self.seed) - 1)] == own[at]] if len(self.seed) else at[:0]
            text = np.searchsorted(starts, at, "right") - 1
            order = np.lexsort((own[at], text))
            at, text = at[order], text[order]
            head = runs_of(own[at], text)
            count = np.diff(np.append(head, len(at)))
            low, high = np.searchsorted(self.seed, own[at[head]], "left"), np.searchsorted(self.seed, own[at[head]], "right")
            for rows in chunked(high - low):
                k, row = spread(low[rows], (high - low)[rows])  # one row for each seed, text and item
                row = rows[row]
                n = count[row] * self.often[k]
                far = n > DENSE
                dense.append(np.unique(np.stack([text[head[row[far]]], self.item[k[far]]]), axis=1))
                k, row, n = k[~far], row[~far], n[~far]
                for some in chunked(n):
                    which, one = spread(np.zeros(len(some), np.int64), n[some])
                    one = some[one]
                    a, b = np.divmod(which, self.often[k[one]])
                    here, place = at[head[row[one]] + a], self.place[self.first[k[one]] + b]
                    parts.append(np.unique(np.stack([text[head[row[one]]], self.item[k[one]], here - place]), axis=1))
        return np.unique(np.concatenate(dense, axis=1), axis=1), np.unique(np.concatenate(parts, axis=1), axis=1)

    def matches(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word in the text, words laid over, words that agree), the best place of each pair."""
        dense, hits = self.hits(words, starts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i in dense.T.tolist():
            if found := self.laid_everywhere(words[starts[t] : starts[t + 1]], i):
                best[t, i] = found
        done = set(map(tuple, dense.T.tolist()))
        if done:
            hits = hits[:, [(t, i) not in done for t, i in hits[:2].T.tolist()]]
        short = self.size[hits[1]] < min(SHORT, self.window + 1)
        text, item, equal, first = self.laid_whole(hits[:, short], words, starts)
        out = list(zip(text.tolist(), item.tolist(), first.tolist(), self.size[item].tolist(), equal.tolist(), strict=True))
        for t, i, d in hits[:, ~short].T.tolist():
            a, b = max(self.starts[i], starts[t] - d), min(self.starts[i + 1], starts[t + 1] - d)
            same = words[a + d : b + d] == self.words[a:b]
            w = min(self.window, int(self.size[i]))
            if len(same) < w:
                continue
            runs = np.concatenate([[0], np.cumsum(same)])
            if (runs[w:] - runs[:-w]).max() >= needed(w, self.agree):
                best[t, i] = max(best.get((t, i), (0, 0, 0)), (int(same.sum()), int(a + d - starts[t]), len(same)))
        return out + [(t, i, first, over, equal) for (t, i), (equal, first, over) in best.items()]


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def chunked(n: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in chunks of about CHUNK_HITS by n; one larger row makes a chunk of its own."""
    ends = np.cumsum(n)
    cuts = np.unique(np.searchsorted(ends, np.arange(CHUNK_HITS, (ends[-1] if len(n) else 0) + CHUNK_HITS, CHUNK_HITS), "right"))
    return (rows for rows in np.split(np.arange(len(n)), cuts) if len(rows))


def best_rows(rows: np.ndarray) -> np.ndarray:
    """The last of each pair of the first two rows' values, in order of the other rows."""
    rows = rows[:, np.lexsort(rows[::-1])]
    last = np.ones(rows.shape[1], bool)
    last[:-1] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    return rows[:, last]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """One row for each document and item found in it: id, item_id, first_word, n_words (laid over), n_equal."""
    checked(window, agree)
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.size(F.split(item_text, r"\s+"))).alias("n")).first()["n"] or 0
    blocks = 1 + 2 * total // BLOCK_WORDS  # halves, as items fall into blocks by hash
    kinds = (docs.schema[id].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    kind, out = arrow_type(benchmark, item), None
    for block in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64(item, item_text), F.lit(blocks)) == block).select(item, item_text).collect()
        held = spark.sparkContext.broadcast(Benchmark([r[0] for r in rows], [r[1] for r in rows], window, agree))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            b = held.value
            for batch in batches:
                for part in slices(batch, text):
                    found = b.matches(*word_hashes(texts_of(part, text)))
                    ids = part.column(id).take(pa.array([x[0] for x in found], pa.int64()))
                    own = pa.array([b.items[x[1]] for x in found], kind)
                    yield pa.RecordBatch.from_arrays([ids, own, *(pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4))], [id, item, "first_word", "n_words", "n_equal"])

        part = bounded_batches(docs).select(id, text).mapInArrow(run, f"{id} {kinds[0]}, {item} {kinds[1]}, first_word long, n_words long, n_equal long")
        out = part if out is None else out.union(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", **how) -> DataFrame:
    """The documents in which no item is found, all columns as they are."""
    return without(docs, id, contaminated(docs, benchmark, id=id, **how).select(id))
