"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.best_fit import best_fit_pack
from tessella.llm.common import shared_dir
from tessella.llm.context_tree import score_texts
from tessella.llm.decontaminate import decontaminate
from tessella.llm.jaccard_join import jaccard_join
from tessella.llm.packing import pack_documents
from tessella.llm.sharding import shard
from tessella.llm.substring_dedup import substring_dedup
from tessella.llm.token_alignment import align_tokens
from tessella.llm.token_files import read_token_files, write_token_files
from tessella.llm.vector_graph import near_duplicates
from tessella.llm.weak_labels import judge
from tessella.llm.url_filter import SPAM_WORDS, host_path_rule, url_filter, word_rule
from tessella.llm.whitening import whiten

URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 75)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.round(f"_quality.{c}", 9).alias(c) for c in ("quality_posterior", "clean_posterior", "quality", "clean")], "_quality.keep")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2048, 1)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return out.select("doc_id", "_shard.size", "_shard.text_crc32", F.lit("bytes").alias("law"), "_shard.shard", "_shard.slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [host_path_rule(*r) for r in URL_RULES] + [word_rule("block", w) for w in SPAM_WORDS]
    out = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")


def _op8_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}', {len(h) + len(p)})" for v, h, p in URL_RULES)
    words = "|".join(w.replace("-", "[^a-z0-9]") for w in SPAM_WORDS)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
part AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
rules(verdict, h, p, n) AS (VALUES {rules}),
best AS (
  SELECT page_id, max_by(h || p, n) AS rule, max_by(verdict, n) AS verdict FROM part JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(lower(host || ' ' || path), '(^|[^a-z0-9])({words})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM part LEFT JOIN best USING (page_id)"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), 2)
    return read_token_files(spark, path)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), 16)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = best_fit_pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096, 1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_packing": op6_packing,
        "op7_sharding": op7_sharding,
        "op8_url_filter": op8_url_filter,
        "op9_token_files": op9_token_files,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": _op8_sql()}
