"""The registered queries of this subpackage, and DuckDB SQL where SQL can express one over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, pii, quality, secrets, sharding, simhash, spelling, sql, suffix_dedup, toxicity, trie, urls
from .common import materialise, table


#: A conversation whose texts hold what templates use as marks.
MARKS = "\\### Assistant: </turn> ok"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], given.schema)
    return chat.digests(chat.format_windows(given.unionByName(own)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op7_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    placed = sharding.kd_shards(documents, shards=24).select(
        "doc_id", sharding.text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "shard"
    )
    numbered = sharding.slots(materialise(placed), ["doc_id", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copies", "copy_no", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


def op12_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_chat_windows, op2_quality_rules, op3_simhash_components, op4_suffix_dedup, op5_benchmark_decontamination, op6_personal_data, op7_kd_tree_shards, op8_secret_spans, op9_poisson_mixture, op10_toxicity]
    own += [op11_conversation_trie, op12_url_verdicts, op13_spelling_variants]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


OP9_SQL = """
with recursive counts as (select source, count(*)::double as n from documents group by source),
sums as (select sum(n) as all_n, sum(pow(n, 0.7)) as all_weight from counts),
rates as (select source, pow(n, 0.7) / all_weight * all_n / n as rate from counts, sums),
cdf(source, rate, k, term, below) as (
  select source, rate, 0, exp(-rate), exp(-rate) from rates
  union all
  select source, rate, k + 1, term * rate / (k + 1), below + term * rate / (k + 1) from cdf where k < ceil(rate + 12 * sqrt(rate) + 20)
),
steps as (select source, list(below order by k) as cdf from cdf group by source),
drawn as (
  select doc_id, d.source, text,
    len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5(concat_ws('/', '42', coalesce(doc_id::varchar, ''), coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0))::int as copies
  from documents d join steps s on d.source is not distinct from s.source
)
select doc_id, source, copies, unnest(range(copies))::int as copy_no, strlen(text)::bigint as n_bytes, md5(text) as text_md5 from drawn
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_poisson_mixture": OP9_SQL, "op11_conversation_trie": sql.TRIE, "op12_url_verdicts": sql.URLS, "op13_spelling_variants": sql.SPELLING}
