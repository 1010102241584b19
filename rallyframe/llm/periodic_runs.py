"""Periodic runs of words, found by bit-parallel lags, and texts without the repetitions.

The ids of a text's words are laid out as bit planes, one big integer for each bit of an id. For a lag p every plane is
XORed with itself shifted by p and the results are ORed: a zero bit is a word that equals the word p further on. ANDing
what is left with itself shifted by 1, 2, 4, ... keeps the starts of stretches of at least max(p, least - p) such words,
and a stretch of m words at lag p is a run of m + p words with period p. Lags go up, and a stretch that a run of a divisor
of p contains has that smaller period, so it is passed over.

Lags under DIRECT go over all texts of a slice at once (matches do not reach from one text into the next). A longer lag
is tried on a text's planes only if a sample lets it through: a stretch of p matches contains a multiple of p - k + 1
from which k words on match, for k of at least a quarter of p. Each lag looks at about 2n / p hashes of k words, so all lags of a
text of n words look at about 2n ln(n) of them, and hardly any lag without a run is tried. The sample passes every lag with a run; it has no part
in what a run is.

A run is (start, length, period): words from number start on, equal to the word `period` before them, that no
neighbour extends, of its smallest period, with length >= max(least, 2 * period). The collapsed text is the words that
no run contains after its first period, joined by one space.

Words are maximal runs of bytes other than space and 0x09-0x0D. Null and empty texts have no words, no runs and an empty
collapsed text; rows of equal or null ids are treated one by one; an empty table gives no rows; other columns are left
out; ids may be of any type. A text is handled whole, in memory of about 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, slices, split_words, spread, texts_of

LEAST = 12
DIRECT = 32
#: Hashes that are compared at once.
CHUNK = 1 << 20
_OUT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def planes_of(ids: np.ndarray) -> list[int]:
    """The bits of ids (from 0) as integers: bit i of plane b is bit b of the i-th id."""
    bits = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> b).astype(np.uint8) & 1, bitorder="little").tobytes(), "little") for b in range(bits)]


def stretches(planes: list[int], lag: int, inside: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each maximal stretch of `least` and more places whose id is that of the place `lag` on. inside: the places to look at."""
    differ = 0
    for x in planes:
        differ |= x ^ (x >> lag)
    bits, have = inside & ~differ, 1
    while bits and have < least:
        step = min(have, least - have)
        bits &= bits >> step
        have += step
    if not bits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + least - 1


class Runs:
    """Runs by period. Runs of one period are in order of start, and so of end."""

    def __init__(self):
        self.by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def within(self, lag: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the stretches of words [start, end) lie in one run whose period divides the lag."""
        out = np.zeros(len(start), bool)
        for period, (starts, ends) in self.by_period.items():
            if period and lag % period == 0:
                at = np.searchsorted(starts, start, "right") - 1
                out |= (at >= 0) & (ends[np.maximum(at, 0)] >= end)
        return out

    def add(self, lag: int, first: np.ndarray, last: np.ndarray) -> None:
        """The stretches of matches first..last (inclusive) at a lag that are no runs of a smaller period."""
        end = last + lag + 1
        new = ~self.within(lag, first, end)
        if new.any():
            self.by_period[lag] = (first[new], end[new])


def short_lags(ids: np.ndarray, starts: np.ndarray, least: int) -> Runs:
    """The runs of periods under DIRECT of all texts at once; places count from the first text's start."""
    found, n = Runs(), np.diff(starts)
    if not len(ids) or n.max() < 2:
        return found
    planes = planes_of(ids)
    linked = np.ones(len(ids), np.uint8)
    linked[starts[1:][n > 0] - 1] = 0  # a text's last word has no next one
    step = int.from_bytes(np.packbits(linked, bitorder="little").tobytes(), "little")
    inside = -1
    for lag in range(1, min(DIRECT, int(n.max()) // 2 + 1)):
        inside &= step >> (lag - 1)
        found.add(lag, *stretches(planes, lag, inside, max(lag, least - lag)))
    return found


def sampled_lags(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, lag and place (in the slice) of matches of k words, 2k <= lag < 4k, for lags of DIRECT and more, sorted by text and lag."""
    n, out = np.diff(starts), []
    k, hashes = 1, mixed(ids.astype(np.uint64) + np.uint64(1))
    while len(n) and 4 * k <= n.max():
        if 2 * k >= DIRECT:
            long = np.flatnonzero(n >= 4 * k)
            lag, text = spread(np.full(len(long), 2 * k), np.minimum(n[long] // 2, 4 * k - 1) - 2 * k + 1)
            text, width = long[text], lag - k + 1
            sizes = (n[text] - lag - k) // width + 1
            upto = np.cumsum(sizes)
            i = 0
            while i < len(lag):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, "right")))
                for low in range(0, int(sizes[i]) if j == i + 1 else 1, CHUNK):  # one lag of a very long text comes in parts
                    count = np.minimum(sizes[i:j] - low, CHUNK) if j == i + 1 else sizes[i:j]
                    nth, row = spread(np.full(j - i, low), count)
                    place = starts[text[i:j]][row] + nth * width[i:j][row]
                    hit = hashes[place] == hashes[place + lag[i:j][row]]
                    if hit.any():
                        out.append((text[i:j][row[hit]], lag[i:j][row[hit]], place[hit]))
                i = j
        with np.errstate(over="ignore"):
            hashes = mixed(hashes[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        k *= 2
    if not out:
        return (np.zeros(0, np.int64),) * 3
    text, lag, place = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((place, lag, text))
    return text[order], lag[order], place[order]


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (in its text), length and period of all runs, in order of text, start and period."""
    found = short_lags(ids, starts, least)
    parts = [(s, e, np.full(len(s), q)) for q, (s, e) in found.by_period.items()]
    text, lag, place = sampled_lags(ids, starts)
    edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        begin, end = int(starts[text[i]]), int(starts[text[i] + 1])
        own = Runs()
        for q, (s, e) in found.by_period.items():  # those of this text
            a, b = np.searchsorted(s, (begin, end))
            if a < b:
                own.by_period[q] = (s[a:b] - begin, e[a:b] - begin)
        planes: list[int] = []
        lags, at = lag[i:j], place[i:j] - begin
        cuts = np.flatnonzero(np.diff(lags, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p = int(lags[a])
            # where a match and its partner lie in a run of a divisor, so does its whole stretch
            if not own.within(p, at[a:b], at[a:b] + p + 1).all():
                planes = planes or planes_of(np.unique(ids[begin:end], return_inverse=True)[1])
                own.add(p, *stretches(planes, p, (1 << (end - begin - p)) - 1, max(p, least - p)))
        parts += [(s + begin, e + begin, np.full(len(s), q)) for q, (s, e) in own.by_period.items() if q >= DIRECT]
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    start, end, period = (np.concatenate(x) for x in zip(*parts, strict=True))
    owner = np.searchsorted(starts, start, "right") - 1
    order = np.lexsort((period, start, owner))
    start, end, period, owner = start[order], end[order], period[order], owner[order]
    return owner, start - starts[owner], end - start, period


def impose(ids: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> None:
    """Makes the text of a tenth of the seeds repeat itself from some word on: a test that every run is found at scale."""
    n = np.diff(starts)
    for i in np.flatnonzero((seeds >= 0) & (seeds % 10 == 0) & (n > 0)):
        g, size = int(seeds[i]) // 10, int(n[i])
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        ids[starts[i] + a : starts[i + 1]] = np.resize(ids[starts[i] + a : starts[i] + a + p], size - a)


def collapse(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = LEAST, seed: Column | None = None) -> DataFrame:
    """id, n_words, runs (sorted by start and period), collapsed. seed: a number from 0 on by which a tenth of the texts is made to repeat itself first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                codes, starts, words = split_words(texts_of(part, "_text"))
                ids = codes.astype(np.int64)
                impose(ids, starts, pc.fill_null(part.column("_seed"), -1).to_numpy(zero_copy_only=False))
                owner, start, length, period = runs_of(ids, starts, least)
                depth = np.zeros(len(ids) + 1, np.int64)
                np.add.at(depth, starts[owner] + start + period, 1)
                np.add.at(depth, starts[owner] + start + length, -1)
                kept = np.cumsum(depth)[:-1] == 0
                offsets = np.concatenate([[0], np.cumsum(kept)])[starts]
                left = pa.array(words, pa.string()).take(pa.array(ids[kept])) if len(words) else pa.array([], pa.string())
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left), " ")
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(starts))), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.diff(starts), pa.int64()), runs, collapsed], ["_id", "n_words", "runs", "collapsed"])

    rows = bounded_batches(docs).select(F.col(id).alias("_id"), F.col(text).alias("_text"), (F.lit(None) if seed is None else seed).cast("long").alias("_seed"))
    return rows.mapInArrow(find, f"_id {docs.schema[id].dataType.simpleString()}, {_OUT}").withColumnRenamed("_id", id)
