"""Importance resampling of documents towards the word distribution of a target.

Texts are lower-cased in A-Z only and cut into words by an untrained Regex Split of the tokenizers library, which
gives every word with its offsets. A window is a pair of offsets, of its first and of its last word; windows of
``low`` to ``high`` words are the features. A feature falls into a bucket by the CRC-32 of its words joined by one
space, so the counts of all documents and of all target texts are two histograms of ``buckets`` numbers. The
logarithm of the ratio of the smoothed shares is a bucket's gain; a document's weight is the sum of the gains of its
features. Weights plus Gumbel noise, drawn from a digest of the id, rank the documents: the first of them are a
sample without replacement in proportion to exp(weight).

Documents are cut into words once: their own histograms (never longer than ``buckets`` pairs) are written, and both
the histogram of the corpus and the weights are read from that copy. To the driver come ``buckets`` counts.

Defined results: null and empty texts have no words, weight 0 and are never drawn. Equal rows are rows like any
other and get ranks of their own, in any order. A row without an id has a weight, but neither noise nor score, and
is not in the pool of those that can be drawn. Ties in the score go to the smaller id. Without documents there are
no rows; without target texts every gain follows from the smoothing alone. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from boxtally.llm.ordering import numbered
from boxtally.session import cut_lineage

#: A word is a run of digits, lower-case letters a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
APART = frozenset([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10
SEED = 2024
#: Characters that are cut into words at a time; a cut is made at a character that is in no word.
PIECE = 1 << 18
#: Features whose bucket a task remembers.
REMEMBERED = 1 << 17
#: Documents that leave a task at a time.
ROWS = 512

_SPLIT = None


def _split() -> pre_tokenizers.Split:
    global _SPLIT
    if _SPLIT is None:
        _SPLIT = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
    return _SPLIT


def words_with_offsets(text: str | None) -> Iterator[tuple[str, int, int]]:
    """The words of a text, lower-cased in A-Z, each with the offsets of its first character and of the one behind it."""
    low = (text or "").encode("utf-8", "replace").lower().decode("utf-8")
    at = 0
    while at < len(low):
        end = min(at + PIECE, len(low))
        while end < len(low) and ord(low[end]) not in APART:
            end += 1
        for word, (a, b) in _split().pre_tokenize_str(low[at:end]):
            yield word, at + a, at + b
        at = end


class _Buckets:
    """The bucket of a feature, remembered for the frequent ones."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[str, int] = {}

    def of(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            found = zlib.crc32(feature.encode()) % self.buckets
            if len(feature) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[feature] = found
        return found


def _histogram(text: str | None, low: int, high: int, table: _Buckets) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, buckets in ascending order, counts) of one text."""
    total = np.zeros(table.buckets, dtype=np.int64)
    found: list[int] = []
    recent: list[str] = []
    n_words = n_features = 0
    for word, _, _ in words_with_offsets(text):
        n_words += 1
        recent.append(word)
        del recent[:-high]
        for k in range(low, min(high, len(recent)) + 1):
            found.append(table.of(word if k == 1 else " ".join(recent[-k:])))
        if len(found) >= PIECE:
            n_features += len(found)
            total += np.bincount(found, minlength=table.buckets)
            found.clear()
    n_features += len(found)
    if n_features == len(found):
        bucket, count = np.unique(np.array(found, dtype=np.int64), return_counts=True)
    else:
        total += np.bincount(np.array(found, dtype=np.int64), minlength=table.buckets)
        bucket = np.flatnonzero(total)
        count = total[bucket]
    return n_words, n_features, bucket, count


def histograms(texts: DataFrame, id_col: str, text_col: str, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, bucket, count) a row: the buckets that a text fills and how often, as packed 32-bit and 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Buckets(buckets)
        names = ["id", "n_words", "n_features", "bucket", "count"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            ids = batch.column("id")
            for i in range(0, batch.num_rows, ROWS):
                rows = []
                for j in range(i, min(i + ROWS, batch.num_rows)):
                    n_words, n_features, bucket, count = _histogram(batch.column("text")[j].as_py(), low, high, table)
                    rows.append((ids[j].as_py(), n_words, n_features, bucket.astype("<u4").tobytes(), count.astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    own = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, bucket binary, count binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of a batch of ``histograms``."""
    bucket = [np.frombuffer(x, dtype="<u4") for x in batch.column("bucket").to_pylist()]
    count = [np.frombuffer(x, dtype="<i8") for x in batch.column("count").to_pylist()]
    row = np.repeat(np.arange(len(bucket)), [len(x) for x in bucket])
    if not bucket:
        return row, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return row, np.concatenate(bucket).astype(np.int64), np.concatenate(count)


def total(parts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of ``histograms``; every task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                _, bucket, count = _unpacked(batch.slice(i, ROWS))
                np.add.at(held, bucket, count)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    return parts.select("bucket", "count").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(parts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, dtype=np.int64)
    for r in total(parts, buckets).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down, for each bucket."""
    n = len(source)
    ratio = (target + 1.0) * float(source.sum() + n) / ((source + 1.0) * float(target.sum() + n))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weights(parts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``histograms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                row, bucket, count = _unpacked(part)
                weight = np.zeros(part.num_rows, dtype=np.int64)
                np.add.at(weight, row, gain[bucket] * count)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n_words"), part.column("n_features"), pa.array(weight, pa.int64())],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return parts.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw, rounded down, from a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
    low: int = 1, high: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row; the best ``share`` percent of the pool have a rank."""
    parts = cut_lineage(histograms(docs, id_col, text_col, low, high, buckets))
    source = _dense(parts, buckets)
    wanted = _dense(histograms(target, target_id, target_text, low, high, buckets), buckets)
    scored = cut_lineage(
        weights(parts, gains(source, wanted)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("__row", F.monotonically_increasing_id())
    )
    in_pool = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    pool = numbered(scored.filter(in_pool), [F.col("score").desc(), F.col("doc_id"), F.col("__row")], "__n")
    drawn = pool.count() * share // 100
    rank = F.when(F.col("__n") < drawn, F.col("__n") + 1)
    rest = scored.filter(~in_pool).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return pool.withColumn("rank", rank).select(*out).unionByName(rest.select(*out))
