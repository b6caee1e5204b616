"""Corpus pipeline: quality, near copies, benchmark leaks, source mix, token table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, a written table; all but the last
return the columns of ``documents``. Decisions are made on rows, never by doc_id, which may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.llm import decontaminate, mixing, near_copies, quality, token_output
from hearthlog.llm.common import fresh_path, materialise, table
from hearthlog.llm.registry import tokenizer_path

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _modest_batches(spark: SparkSession) -> None:
    """Texts go to Python by the thousand, so that executors that run all stages hold little outside the heap."""
    if int(spark.conf.get(_BATCH_ROWS)) > 1000:
        spark.conf.set(_BATCH_ROWS, 1000)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3 go."""
    _modest_batches(spark)
    scorer = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_of(F.col("text"), scorer) >= 0.3).select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles, directly or over others, the one with the smallest id stays."""
    return near_copies.keep_one(docs, written=True).select(*COLUMNS)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole and in part, to the weights of their sources."""
    return mixing.mix(docs, written=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token table written, and its digests read back."""
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, path, tokenizer_path(), chunk_bytes=4 << 20, remembered=200_000)
    return token_output.token_digests(spark, path)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_copies_stage),
    ("benchmark decontamination", leaks_stage),
    ("mixing sources to target weights", mix_stage),
    ("token-ID output", tokens_stage),
]

#: SQL can express neither the learned scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(_BATCH_ROWS)
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    finally:
        spark.conf.set(_BATCH_ROWS, before)  # the caller's session stays as it was
    return docs
