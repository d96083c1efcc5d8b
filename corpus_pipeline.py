"""Corpus preparation: quality, line dedup, near-duplicate join, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of ``documents``, further ones as they
are, whatever their names.  Null texts count as empty, long ones are taken
whole, rows with a null id stay, an empty table gives an empty one; what a stage
does with repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, line_dedup, mixing, ngram_join, quality
from tidelog.llm.queries import WORD_TOKENIZER, tokenizer_file
from tidelog.llm.store import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier scores below 0.3; repeated rows have one score.  Empty texts are scored like any other."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filter_quality(docs, model, threshold=0.3)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs of 50 words or more; rows of one id and text change alike.  A text may become empty, none goes."""
    return line_dedup.dedup_lines(docs)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five words, a similarity of 0.8 or more; rows that repeat its id stay with it, as do empty texts."""
    return ngram_join.keep_one(docs, width=5, sim=ngram_join.Similarity(80, 100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take sources by weights 1, 2, 3 in turn along the curriculum, none more than three times; repeats are rows of their own, sorted by training position; texts stay whole.

    Empty texts have no words to take and go; rows that repeat an id are documents of their own.
    """
    return mixing.mix(docs, whole=True, schedule=mixing.CURRICULUM)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit integers) and the decoded text, a row for each row."""
    return bpe.bpe_encode_decode(docs, tokenizer_file(WORD_TOKENIZER))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram jaccard join", ngram_join_stage),
    ("mixing sources", mixing_stage),
    ("bpe encoding", bpe_stage),
]

#: The classifier can't be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
