"""Site-relative line frequency: lines that too large a share of a host's pages repeat are boilerplate.

For each host, the pages that contain a line, divided by the host's pages, is the line's ratio; lines above `ratio` that
at least `pages` pages have are dropped from all pages of the host, and the other lines keep their order. DataFrame
expressions only. A line counts once for a page. The rows of a host that have the same text are one page, in a line's
pages and in the host's, so the lines of a page that is copied often stay (null texts are one page then); with
copies_once=False each row is a page. Lines are keyed by 128 bits of hash.

Null texts stay null, pages of a null host form one host, a page that loses all its lines keeps an empty text, and an
empty table stays empty. Other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, stored

#: Lines of menus, footers and licenses stand on a tenth and more of a host's pages, lines that groups of near copies share
#: (for near-duplicate removal) on up to a twentieth; the ratio lies between. A line of two pages may be a page and its revision.
RATIO, PAGES = 0.08, 3
#: Parts of a host where its pages meet its lines in a shuffle.
PARTS = 32


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def line_ratios(docs: DataFrame, *, host: str = "source", text: str = "text", pages: int = PAGES, copies_once: bool = True) -> DataFrame:
    """host, line (its key), n_pages, ratio of lines that at least `pages` pages of a host have."""
    own = docs.select(F.col(host).alias("host"), _key(F.col(text)).alias("page"), F.array_distinct(F.transform(F.split(text, "\n"), _key)).alias("lines"))
    if copies_once:  # by keys, so that no text is shuffled
        own = own.distinct()
    lines = own.filter(F.col("lines").isNotNull()).select("host", F.explode("lines").alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= pages)
    totals = own.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    return often.join(totals, F.col("host").eqNullSafe(F.col("_host"))).select("host", "line", "n_pages", (F.col("n_pages") / F.col("_pages")).alias("ratio"))


def drop_boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES, copies_once: bool = True, counts: tuple[str, str] | None = None) -> DataFrame:
    """The pages without their hosts' boilerplate lines. counts: names for columns of the lines there were and the lines dropped."""
    # A host has at most (lines of a page) / ratio such lines, so one row holds them.
    of, bad, salt = fresh("of"), fresh("bad"), fresh("salt")
    found = line_ratios(docs, host=host, text=text, pages=pages, copies_once=copies_once).filter(F.col("ratio") > ratio)
    lists = stored(found.groupBy("host").agg(F.collect_list("line").alias(bad)).select(F.col("host").alias(of), bad), "boilerplate")
    if (lists.agg(F.sum(F.size(bad))).first()[0] or 0) <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(lists), F.col(host).eqNullSafe(F.col(of)), "left")
    else:  # a host of many pages is dealt to several tasks
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        joined = docs.join(lists, F.col(host).eqNullSafe(F.col(of)) & (F.pmod(F.xxhash64(text), F.lit(PARTS)) == F.col(salt)), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bad), _key(x)))
    clean = F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        left = F.when(F.col(bad).isNull(), F.size(lines)).otherwise(F.size(kept))
        columns += [F.size(lines).cast("long").alias(counts[0]), (F.size(lines) - left).cast("long").alias(counts[1])]
    return joined.select(*columns)
