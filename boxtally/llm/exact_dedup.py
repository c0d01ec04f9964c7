"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text ever accepted.
A batch is reduced to its distinct digests, which meet the index in a sort-merge anti join that
shuffles only the batch; what is new is appended.

Defined results: null counts as the empty text, so empty, blank and null texts are one group.
Repeated rows are texts like any other. An empty batch adds nothing. Extra columns are ignored: only
the named id and text columns are read. A row with a null id takes part and can be kept; it loses
ties against numbered rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.session import fresh_path

#: Fixed value: the characters that do not count, x20 and x09 to x0D.
BLANKS = " \t\n\x0b\x0c\r"
INDEX_COLUMNS = "text_sha256 string, keep_id bigint, n_points bigint"


def normalised(text: Column) -> Column:
    """The text without blanks; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, n_points): digest of the normalised text, code points of the original."""
    text = F.col(text_col)
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_points"),
    )


def distinct_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the row with most code points, then smallest id, and the group's size.

    Aggregates combine before the shuffle, so a digest that holds a third of all rows moves as one
    row per task.
    """
    best = F.max(F.struct(F.col("n_points"), F.when(F.col("doc_id").isNotNull(), -F.col("doc_id")).alias("back"))).alias("best")
    return rows.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).select(
        "text_sha256", (-F.col("best.back")).alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size"
    )


class DigestIndex:
    """A bucketed table of accepted digests at ``path``; opened again under the same path and bucket count."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or fresh_path(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append_new(self, batch: DataFrame) -> None:
        """Adds the batch's digests that the index lacks. ``batch`` comes from ``distinct_digests``.

        The anti join is a sort merge on the buckets: the index is neither shuffled nor broadcast. A
        task that fails is retried from the batch; nothing is visible before the write commits.
        """
        new = batch.join(self.rows().hint("merge"), "text_sha256", "left_anti")
        new.select("text_sha256", "keep_id", "n_points").repartition(self.buckets, "text_sha256").sortWithinPartitions(
            "text_sha256"
        ).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def accepted(self) -> DataFrame:
        """The index as plain files, for joins whose other side has hot digests that AQE must be able to split."""
        return self.spark.read.schema(INDEX_COLUMNS).parquet(self.path)


def deduplicate(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a batch to ``index`` and returns a row per row of ``df``.

    (doc_id, keep_id, group_size, kept, text_sha256): ``group_size`` counts the batch, ``keep_id`` names the row that
    stays, which is of an earlier batch when the text was known before.
    """
    rows = digests(df, id_col, text_col)
    batch = distinct_digests(rows)
    index.append_new(batch)
    groups = batch.select("text_sha256", "group_size", F.col("keep_id").alias("own")).join(
        index.accepted().select("text_sha256", "keep_id"), "text_sha256"
    )
    return rows.select("doc_id", "text_sha256").join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
