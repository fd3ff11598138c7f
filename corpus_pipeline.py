"""From documents to token files in five stages: toxicity, near duplicates, benchmark leaks, mixing, token records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.decontaminate import decontaminate
from foliant.llm.jaccard_join import near_dedup
from foliant.llm.mixing import mixed_documents
from foliant.llm.queries import TOKENIZER, table
from foliant.llm.shared import stored
from foliant.llm.token_records import token_records
from foliant.llm.toxicity import toxicity

#: Rows and bytes that Spark hands to Python at once, at most: a worker and its JVM each hold such a batch several times over.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that stages that follow one another leave room for each other's workers."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes  # of "64m"
    for name, most, number in (("maxRecordsPerBatch", BATCH_ROWS, int), ("maxBytesPerBatch", BATCH_BYTES, size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = number(spark.conf.get(key))
        spark.conf.set(key, str(min(now, most) if now > 0 else most))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an expected severity under the limit, by a classifier fitted on the labelled ones among them.

    All columns stay, whatever their names. Null and blank texts have no severity and stay, as all do without usable labels;
    repeated rows share their fate; an empty table stays empty.
    """
    in_small_batches(spark)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    return toxicity(row, table(spark, sf_dir, "labels")).where("not rejected").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id (null last), of rows with one id that with the least hash of its text.

    Null and blank texts are linked with nothing and stay; rows that repeat id and text count once; all columns stay; an
    empty table stays empty.
    """
    in_small_batches(spark)
    return near_dedup(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (three quarters of its shingles).

    Null texts hold nothing and stay; items without words are in nothing; repeated rows share their fate; all columns stay; an
    empty table on either side changes nothing.
    """
    in_small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, as often as it does (twice at most).

    Documents without words, null ones too, stay once; null sources are one source; repeated rows are drawn apart; all
    columns stay; an empty table stays empty. Reruns agree.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as files of token ids, read back: doc_id, start, n_tokens, ids_crc32 of each document drawn.

    In ascending doc_id order, null last, rows of one id by a hash of their text. Null and empty texts have the end id alone;
    other columns don't matter; an empty table gives no files and no rows.
    """
    in_small_batches(spark)
    return token_records(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_copies),
    ("decontamination", without_leaks),
    ("source_mix", mixed),
    ("token_records", tokens),
]

#: SQL can't express the stages (a fitted classifier, a tokenizer); tests hold the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
