"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, fingerprint, html_extract, line_dedup, mixing, ngram_join, oracles, quality, token_files, topk, url_filter

WORD_TOKENIZER, BYTE_TOKENIZER, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, k=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file(WORD_TOKENIZER))
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(_table(spark, sf_dir, "documents"), schedule=mixing.CURRICULUM)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), width=4, sim=ngram_join.Similarity(85, 100))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


#: The rules of the query (verdict, host, path).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, url_filter.default_model(spark))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_file(BYTE_TOKENIZER), END_ID)
    return out.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.grouped_report(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.in_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_files": op8_token_files,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": oracles.TOP_K,
    "op4_ngram_join": oracles.NGRAM_COMPONENTS,
    "op5_line_dedup": oracles.LINE_DEDUP,
}
