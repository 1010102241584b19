"""Quality rules: counts of a text that rules of thumb use, and the verdict of an n-gram likelihood ratio on every document.

The verdict is deterministic: a document is kept if its score, the mean log ratio of its n-grams between the trusted target
and the raw corpus (ngram_ratio.py; length-normalised: sums over all n-grams by their number), is at least THRESHOLD nats.
Documents that the base rules fail are not kept whatever their ratio: fewer than MIN_WORDS words, or over half of the
words in repeated windows.

Words are maximal runs of bytes other than space and 0x09-0x0D. n_repeat_words counts the words that lie in windows of
three words which the text has twice or more; n_dup_lines the lines with a word that equal an earlier line.

Null and empty texts have no words and fail; rows of equal or null ids are judged one by one; no documents give no rows;
without labels (or without trusted ones) every ratio is 0 and the base rules decide; other columns are left out; ids may
be of any type that can be ordered; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngram_ratio
from .common import coded_lists, slices, split_words, texts_of

#: Nats an n-gram: about one word in a hundred that trusted documents avoid. Trusted documents lie at 0 and a little above.
THRESHOLD = -0.01
MIN_WORDS = 50
#: Per cent of the words that may lie in repeated windows.
MAX_REPEATED = 50
SYMBOLS = "[#*$%&|<>]"


def dup_lines(texts: pa.Array) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier one."""
    codes, starts, lines = coded_lists(pc.split_pattern(texts, "\n"))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    worded = np.diff(split_words(pa.array(lines, pa.string()))[1]) > 0 if lines else np.zeros(0, bool)
    full = worded[codes]
    row, codes = row[full], codes[full].astype(np.int64)
    distinct = np.unique(row * max(1, len(lines)) + codes) // max(1, len(lines))
    return np.bincount(row, minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def repeat_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text, the words in three-word windows that it has twice or more; exact, by sorting pairs and then triples."""
    n = np.diff(starts)
    if not len(codes) or n.max() < 4:
        return np.zeros(len(n), np.int64)
    wide, codes = int(codes.max()) + 1, codes.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(starts[1:], n) - np.arange(len(codes))  # words from here to the text's end
    at = np.flatnonzero(left >= 3)
    pair = np.unique(codes[at] * wide + codes[at + 1], return_inverse=True)[1]
    pair = np.unique(row[at] * (int(pair.max()) + 1) + pair, return_inverse=True)[1]
    _, window, times = np.unique(pair * wide + codes[at + 2], return_inverse=True, return_counts=True)
    again = at[times[window] > 1]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(row, weights=covered, minlength=len(n)).astype(np.int64)


def judged(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept."""
    rows = ngram_ratio.marked(docs, labels, id, text)
    model = docs.sparkSession.sparkContext.broadcast(ngram_ratio.fit(rows))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laid_out = model.value.laid_out()
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                texts = texts_of(part, "_text")
                codes, starts, words = split_words(texts)
                n = np.diff(starts)
                sizes = pc.utf8_length(pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
                score = model.value.scores(laid_out, ngram_ratio.ngrams(codes, starts, words), starts, ngram_ratio.targets_of(part))
                counts = {
                    "n_words": n,
                    "word_chars": np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[starts]),
                    "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False),
                    "n_dup_lines": dup_lines(texts),
                    "n_repeat_words": repeat_words(codes, starts),
                }
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(x, pa.int64()) for x in counts.values()), pa.array(score, pa.float64())], ["_id", *counts, "score"])

    found = rows.mapInArrow(judge, f"_id {docs.schema[id].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).withColumnRenamed("_id", id)
