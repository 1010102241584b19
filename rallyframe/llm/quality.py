"""Importance resampling: documents are drawn in proportion to how much likelier the target model finds them than the raw one.

Both models are multinomials over hashed n-grams: words, pairs of words and their shapes (ngram_ratio.py: ratios by counts
without the document itself, drawn to 0 by three standard errors). A document's log weight is its score there (mean log
ratios) times LENGTH: documents are compared as if each had so many n-grams, else a long one would outweigh any noise for
its length alone.

Documents are sampled without replacement by Gumbel top-k: the k largest of log weight + temperature * Gumbel noise,
the noise hashed from the id. The weights of sound documents lie within a few units of each other, where the noise
deals the places; a word in a hundred that the target avoids takes some ten units. Unless given, k is the number of documents
whose key is at least that which all but 1 - KEEP of the labelled target documents reach (rounded to whole documents). The k-th
largest key is found by refining a histogram, not by a sort in one task.

At most ngram_ratio.MAX_LABELS labelled documents (smallest hash first) make the target model, whatever the corpus.
Everything else is counted over all documents.

Null and empty texts have no n-grams and weight 0; rows of equal or null ids share their noise, and `drawn` keeps all of
them or none, as the likeliest of them; no documents or no labels (then all documents are kept) are no error; other
columns pass unchanged, whatever their names; ids may be of any type that can be ordered; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngram_ratio
from .common import slices, split_words, stored, texts_of, without

#: N-grams that each document counts as having.
LENGTH = 512
TEMPERATURE = 1.0
#: Share of the labelled target documents that the default k draws.
KEEP = 0.995
#: Values that are sorted in one place at the end of a search for the k-th.
FEW = 10_000


def keyed(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", temperature: float = TEMPERATURE, seed: int = 17) -> DataFrame:
    """_id, log_weight, key, label of each document."""
    marked = ngram_ratio.marked(docs, labels, id, text)
    model = docs.sparkSession.sparkContext.broadcast(ngram_ratio.fit(marked))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laid_out = model.value.laid_out()
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                codes, starts, words = split_words(texts_of(part, "_text"))
                weight = LENGTH * model.value.scores(laid_out, ngram_ratio.ngrams(codes, starts, words), starts, ngram_ratio.targets_of(part))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(weight, pa.float64()), part.column("_label")], ["_id", "log_weight", "label"])

    scored = marked.mapInArrow(score, f"_id {docs.schema[id].dataType.simpleString()}, log_weight double, label int")
    uniform = (F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return stored(scored.withColumn("key", F.col("log_weight") - temperature * F.log(-F.log(uniform))), "keys")


def kth(rows: DataFrame, value: Column, k: int) -> tuple[float, int]:
    """The k-th largest value and how many are above it: of ever fewer values, those of one bin of a thousand are left."""
    inside, above = rows.select(value.alias("v")), 0
    values = inside
    while True:
        low, high, n = inside.agg(F.min("v"), F.max("v"), F.count("v")).first()
        if low == high:
            return low, above
        if n <= FEW:
            found = sorted((r["v"] for r in inside.collect()), reverse=True)
            at = found[k - above - 1]
            return at, above + sum(x > at for x in found)
        place = F.least(F.floor((F.col("v") - low) / ((high - low) / 1000)), F.lit(999)).alias("b")
        for r in sorted(inside.groupBy(place).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                inside = values.filter(F.col("v").between(r["low"], r["high"]))
                break
            above += r["n"]


def default_k(keys: DataFrame, keep: float = KEEP) -> int:
    """Documents whose key is at least that which all but 1 - keep of the labelled target documents reach."""
    target = keys.filter("label = 1")
    n = target.count()
    if not n:
        return keys.count()
    cut, _ = kth(target, F.col("key"), n - min(n - 1, round((1 - keep) * n)))
    return keys.filter(F.col("key") >= cut).count()


def among_top(keys: DataFrame, k: int) -> Column:
    """True for the rows of the k largest keys, ties in order of a hash of _id (repeated rows stay together)."""
    if k <= 0 or k >= keys.count():
        return F.lit(k > 0)
    at, above = kth(keys, F.col("key"), k)
    tied = keys.filter(F.col("key") == at)
    if tied.count() == k - above:
        return F.col("key") >= at
    tie = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 52)).cast("double")
    last, _ = kth(tied, -tie, k - above)
    return (F.col("key") > at) | ((F.col("key") == at) & (-tie >= last))


def resampled(docs: DataFrame, labels: DataFrame, *, k: int | None = None, **how) -> DataFrame:
    """_id, log_weight, key of the documents drawn."""
    keys = keyed(docs, labels, **how)
    return keys.filter(among_top(keys, default_k(keys) if k is None else k)).select("_id", "log_weight", "key")


def drawn(docs: DataFrame, labels: DataFrame, *, k: int | None = None, id: str = "doc_id", **how) -> DataFrame:
    """The documents drawn, all columns as they are."""
    keys = keyed(docs, labels, id=id, **how)
    inside = among_top(keys, default_k(keys) if k is None else k)
    return without(docs, id, keys.groupBy("_id").agg(F.max(inside).alias("_in")).filter(~F.col("_in")).select("_id"))
