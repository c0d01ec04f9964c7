"""A corpus pipeline over the table of documents: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.llm import decontaminate, language, line_dedup, near_dedup, sentencepiece_codec
from boxtally.llm.filters import maybe_in
from boxtally.session import cut_lineage, settled

#: A document of which no language holds this share of the letters is rejected.
LEAST_LANGUAGE = 0.2


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, written once with a number ``__row`` each, in order of id (rows without one last) and of a digest of the text.

    Decisions about rows go by this number: ids may repeat, with equal or with different texts, or be missing.
    """
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.sha2("text", 256)]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("__row", F.monotonically_increasing_id()))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number is not in the written table ``gone``; only rows that may go are shuffled, with their texts, to meet it."""
    may_go, stay = maybe_in(rows, gone, ("__row",))
    return stay.unionByName(may_go.join(gone, "__row", "left_anti"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter and those of no learned language go. Learns from all rows with one."""
    labelled = docs.withColumn("__label", language.predicted(docs, language.fit(docs)))
    return labelled.filter((F.col("__label.lang_pred") != "und") & (F.col("__label.score") >= LEAST_LANGUAGE)).select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat an earlier line; ``n_chars`` follows the text."""
    cleaned = line_dedup.clean(numbered(docs), "__row")
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, the first in the order of ``numbered``."""
    rows = numbered(docs)
    gone = settled(lambda: near_dedup.near_duplicates(rows, "__row").filter("not kept").select(F.col("doc_id").alias("__row")))
    return without(rows, gone).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    rows = numbered(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = settled(lambda: decontaminate.find_items(rows, items, "__row", within=True).select(F.col("doc_id").alias("__row")).distinct())
    return without(rows, gone).select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether they decode to its text."""
    return sentencepiece_codec.encode_and_check(docs, sentencepiece_codec.Codec.load())


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_documents),
    ("decontaminate", without_benchmarks),
    ("sentencepiece", as_pieces),
]
#: The first, third and last stage cannot be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table of documents; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 < len(STAGES):
            docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        else:
            docs = stage(spark, docs, sf_dir)
    return docs
