"""The queries of this subpackage over the driver's tables, each through its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, chat_format, decontamination, line_dedup, near_duplicates, packing, periodic_runs, quality, quality_rules, rans, token_counts, vector_search, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(F.col("_id").alias("doc_id"), "log_weight", "key")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budgets=(512,))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("fit_512").alias("chars_within_limit"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), packing.CAPACITY)


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(spark, warc.write_warc(table(spark, sf_dir, "pages")))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return records.select(number("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = "values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)"
    back = chat_format.read_chats(chat_format.format_chats(turns.unionByName(spark.sql(f"select * from {more}"))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.read_archive(rans.write_archive(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(table(spark, sf_dir, "documents"), seed=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(F.expr("1000 * best.length div -best.col3")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters.with_inertia(centroid_clusters.clustered(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_resampling, op2_token_counts, op3_best_fit_packing, op4_vector_search, op5_warc_archive, op6_decontamination, op7_line_dedup, op8_chat_format, op9_token_archive, op10_near_duplicates, op11_periodic_runs, op12_quality_rules, op13_centroid_clusters)
    return {f.__name__: f for f in own}


_LINES = """with p as (select doc_id, source, text, string_split(text, chr(10)) as l from documents),
 e as (select doc_id, source, text, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from p),
 c as (select source, line, count(distinct text) as n from e group by all),
 h as (select source, count(distinct text) + max(case when text is null then 1 else 0 end) as pages from documents group by all),
 bad as (select c.source, c.line from c join h using (source) where c.n >= 3 and c.n * 1.0 / h.pages > 0.08),
 k as (select e.*, b.line is not null as gone from e left join bad b on e.source = b.source and e.line = b.line),
 g as (select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as text, count(*) as n_lines, count(*) filter (where gone) as n_dropped from k group by doc_id)
 select p.doc_id, g.text, coalesce(g.n_lines, 0) as n_lines, coalesce(g.n_dropped, 0) as n_dropped from p left join g using (doc_id)"""

_ESCAPED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
_CHATS = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 o as (select *, lag(role) over (partition by conv_id order by turn, role, text) as former, row_number() over (partition by conv_id order by turn, role, text) as i from t),
 m as (select *, length({_ESCAPED.format(x="text")}) + case when former is null then 9 + length(replace({_ESCAPED.format(x="role")}, chr(10), '&#10;')) when former = role then 8 else 17 + length(replace({_ESCAPED.format(x="role")}, chr(10), '&#10;')) end as n from o)
 select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(n) + 8 as bigint) as formatted_chars from m group by conv_id"""


def _clusters(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after another: nearest centroids by distance and number, then floors of exact means."""
    ctes = ["""v as materialized (select row_number() over () as i, vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as q from embeddings
 where len(embedding) = 64 and len([1 for x in embedding if x is not null and isfinite(cast(x as double))]) = 64)""",
        "x as materialized (select i, unnest(q) as x, unnest(range(64)) as d from v)",
        f"c0 as materialized (select row_number() over (order by h nulls last, q) - 1 as c, q from (select sha256('3:' || vec_id) as h, q from v order by h nulls last, q limit {k}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} as materialized (select i, arg_min(c, cast(dist as hugeint) * {k} + c) as c, min(dist) as dist from (select v.i, c{r}.c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c{r}.q)]) as dist from v, c{r}) group by i)")
        if r < rounds:
            ctes.append(f"s{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by d) as q from (select c, d, sum(x) as s, count(*) as n from a{r} join x using (i) group by c, d) group by c)")
            ctes.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(s{r}.q, c{r}.q) as q from c{r} left join s{r} on s{r}.c = c{r}.c)")
    last = f"a{rounds}"
    return f"with {', '.join(ctes)} select v.vec_id, cast(a.c as int) as cluster, cast(a.dist as bigint) as distance, cast(sum(a.dist) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.dist) over () as bigint) as inertia, sha256(array_to_string(c.q, ',')) as centroid_sha256 from {last} a join v on v.i = a.i join c{rounds} c on c.c = a.c"


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the query; tests/llm holds the others against brute force."""
    return {"op7_line_dedup": _LINES, "op8_chat_format": _CHATS, "op13_centroid_clusters": _clusters()}
