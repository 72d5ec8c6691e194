"""A corpus in five stages: quality, near duplicates, benchmark passages, source mix, token ids.

In every stage a null or empty text is a document without words, whole texts are read however long, an empty table gives an empty one,
and other columns are carried unchanged. Null ids take part like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import free_name, fresh_path
from tickloom.llm.decontaminate import find_contamination
from tickloom.llm.jaccard_join import keep_one
from tickloom.llm.mixing import mix_sources
from tickloom.llm.quality_model import score_quality
from tickloom.llm.queries import table, token_digests, word_count

#: Least score of a document that stays.
MIN_QUALITY = 0.3


#: Rows of an Arrow batch: with all columns and whole texts the default of 10,000 takes too much of a worker's memory.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, scores MIN_QUALITY or more. Repeated rows share one score, so
    all stay or none."""
    _small_batches(spark)
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("quality_score") >= MIN_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id (null last), of each component of five-word-shingle Jaccard 0.8 or more. Documents
    without words all stay; rows with equal id and text stay once."""
    _small_batches(spark)
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Repeated rows are judged alike; so are documents without words,
    which stay."""
    _small_batches(spark)
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contamination.contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them, twice at most; a null source is a source. Documents of no words stay or
    go with their place in the shuffled queue."""
    turn = free_name(docs, "turn")
    copies = F.col("mix.copies")
    mixed = mix_sources(docs, word_count()).where(copies > 0)
    return mixed.withColumn(turn, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards, written to the shared folder and read back: doc_id, start, n_tokens, ids_crc32. Null ids come first,
    repeated rows are repeated documents, and a document without words is the end id alone."""
    _small_batches(spark)
    return token_digests(docs)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between two of them the documents are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None
