"""The queries that apply the operators to the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, mixing, quality, simhash, substring, tokenbin, tokencount, toxicity, urlfilter

#: The rules of the URL filter query, from its contract: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


#: Ids that end a document in the token files, from the query's contract.
END_ID = 2


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; only the queries know the place, the operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.counts_after_edits(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash")


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_table(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_ann_one_bit_codes, op2_mix_sources, op3_url_filter, op4_edit_token_counts, op5_simhash_components,
        op6_quality_perplexity, op7_toxicity_neighbours, op8_decontaminate, op9_repeated_passages, op10_token_files,
    )
    return {f.__name__: f for f in own}


#: Words as the operators count them.
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP2_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5(concat_ws('#', doc_id::VARCHAR, '7')) AS key FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sizes GROUP BY source
), steps AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl
  FROM per WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source ASC NULLS LAST)
), goal AS (
  SELECT source, source_size, cap,
    least(cap::DOUBLE, coalesce((SELECT arg_min(lvl, ratio) FROM steps WHERE ratio >= lvl) * weight, cap::DOUBLE)) AS target
  FROM steps
), budgets AS (
  SELECT *, least(round(target)::BIGINT, cap) AS budget FROM goal
), run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.budget,
    CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM run
"""

OP3_SQL = r"""
WITH rules(rh, rp, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
         ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')
), cutted AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cutted
), fits AS (
  SELECT k, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op3_url_filter": OP3_SQL}
