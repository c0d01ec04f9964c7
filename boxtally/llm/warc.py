"""A content-addressed web archive.

An archive is two Parquet data sets. ``payloads`` holds every payload once, under its SHA-256;
``headers`` holds the exact header bytes of each record with the digest it points to. Both are bucketed
and sorted by the digest. Records are put together again by a join on the digest, bucket by bucket where
the reader knows the number of buckets, so payloads are shuffled once, on their way into the archive. The
payload is digested again on the way, so damaged bytes are found. ``export_warc`` writes ordinary WARC files from the same parts and ``import_warc``
reads such files.

Defined results: a null payload is empty; a null url is written as an empty target; rows with equal
ids are separate records, all of them responses where that id is the smallest; a row without an id is
a response; an empty table makes an empty archive. Extra columns are ignored, whatever their names. Only the payload's UTF-8 bytes count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtally.session import fresh_path

#: Fixed value: the digits of base 32 in digests.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: A hot payload is copied once for each so many records that point to it.
RECORDS_A_COPY = 10_000


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 40-digit hex string: five hex digits are four base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def page_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows of the archive to be written: (record_id, header, payload_key, copies).

    Of records with equal payloads of at least ``least_bytes`` the smallest id is the response and
    the others revisit it; smaller payloads are always responses. Only digests are shuffled.
    """
    payload = _utf8(F.col(payload_col))
    rows = df.select(
        F.col(id_col).cast("long").alias("record_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.sha2(payload, 256).alias("payload_key"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n"),
    )
    first = rows.groupBy("payload_key").agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies"))
    rows = rows.join(first, "payload_key")
    revisit = F.coalesce((F.col("n") >= least_bytes) & (F.col("record_id") != F.col("first_id")), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("record_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("n").cast("string")), F.lit(CRLF),
    )
    return rows.select(
        "record_id", header.cast("binary").alias("header"), "payload_key",
        "copies",
    )


def _write_bucketed(rows: DataFrame, path: str, buckets: int) -> None:
    """Files by buckets of the digest; the catalog's entry is only needed to write them."""
    table = f"archive_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(buckets, "payload_key").sortBy("payload_key").option("path", path).saveAsTable(table)
    rows.sparkSession.sql(f"DROP TABLE {table}")


def _open_bucketed(spark: SparkSession, path: str, buckets: int, columns: str) -> DataFrame:
    table = f"archive_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (payload_key) SORTED BY (payload_key) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # external, so the files stay, and the frame knows them and their buckets
    return rows


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> int:
    """Writes ``headers`` and ``payloads`` below ``path`` and returns the number of buckets; each payload is stored once.

    Equal payloads meet in each task before the shuffle, so a hot payload travels once per task. There are as many
    buckets as shuffle partitions, so what the shuffle brings together is written as it is.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _write_bucketed(page_records(df, id_col, url_col, payload_col, least_bytes), f"{path}/headers", buckets)
    payload = _utf8(F.col(payload_col))
    stored = df.select(F.sha2(payload, 256).alias("payload_key"), payload.alias("payload")).groupBy("payload_key").agg(
        F.count("*").alias("copies"), F.first("payload").alias("payload")
    )
    _write_bucketed(stored, f"{path}/payloads", buckets)
    return buckets


def read_archive(spark: SparkSession, path: str, buckets: int | None = None) -> DataFrame:
    """Original records: (record_id, header, payload, verified); ``buckets`` as ``write_archive`` returned it, else payloads are shuffled.

    A payload that more than ``RECORDS_A_COPY`` records share is copied once for each so many of them and the
    copies are joined apart, so no task holds all records of one digest; the others meet in their buckets.
    """
    if buckets:
        headers = _open_bucketed(spark, f"{path}/headers", buckets, "record_id bigint, header binary, payload_key string, copies bigint")
        payloads = _open_bucketed(spark, f"{path}/payloads", buckets, "payload_key string, copies bigint, payload binary")
    else:
        headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    payloads = payloads.withColumn("verified", F.sha2("payload", 256) == F.col("payload_key"))
    hot = F.col("copies") > RECORDS_A_COPY
    whole = headers.filter(~hot).drop("copies").join(payloads.filter(~hot).drop("copies"), "payload_key")
    ways = F.ceil(F.col("copies") / F.lit(RECORDS_A_COPY)).cast("int")
    parts = headers.filter(hot).withColumn("part", F.pmod(F.xxhash64("record_id", "header"), ways).cast("int")).drop("copies")
    stored = payloads.filter(hot).withColumn("part", F.explode(F.sequence(F.lit(0), ways - 1))).drop("copies")
    out = ("record_id", "header", "payload", "verified")
    return whole.select(*out).unionByName(parts.join(stored, ["payload_key", "part"]).select(*out))


def field(header: Column, name: str) -> Column:
    """Value of a named field of a record header; null when it is absent."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def describe(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified) of read records.

    Length and digest come from the payload as read; ``verified`` also holds them against the header.
    """
    h = F.col("header")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("long")
    digest = base32_of_hex(F.sha1("payload"))
    size = F.octet_length("payload").cast("long")
    return records.select(
        F.col("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"),
        field(h, "WARC-Type").alias("record_type"), page(field(h, "WARC-Refers-To")).alias("refers_to"),
        (F.col("verified") & (field(h, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest))
         & (field(h, "Content-Length").cast("long") == size)).alias("verified"),
    )


def export_warc(spark: SparkSession, path: str, target: str, records_a_file: int = 10_000) -> None:
    """WARC files of bounded size from an archive; a revisit carries its header without the payload."""
    revisit = field(F.col("header"), "WARC-Type") == "revisit"
    head = F.when(revisit, F.regexp_replace(F.col("header").cast("string"), r"Content-Length: \d+", "Content-Length: 0")).otherwise(
        F.col("header").cast("string")
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("payload").cast("string")))
    read_archive(spark, path).select(record.alias("value")).write.option("lineSep", CRLF * 2).option(
        "maxRecordsPerFile", records_a_file
    ).text(target)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: (header, payload). Each file is read whole, so files are to be of bounded size."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                found, at = [], 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    size = next(
                        int(x.split(b":", 1)[1]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:")
                    )
                    found.append((data[at:end], data[end : end + size]))
                    at = end + size + 4
                yield pd.DataFrame(found, columns=["header", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(parse, "header binary, payload binary")


def round_trip(df: DataFrame, **columns: str) -> DataFrame:
    """Archives ``df`` below the shared checkpoint folder and describes what comes back."""
    spark = df.sparkSession
    path = fresh_path(spark)
    buckets = write_archive(df, path, **columns)
    return describe(read_archive(spark, path, buckets))
