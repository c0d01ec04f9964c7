"""Line deduplication within one edit, by a deletion-neighbourhood join.

Lines are compared in a normal form: lower case, white space runs as one space, ends trimmed. A line goes
when an earlier line of the corpus equals it, or is within one inserted, deleted or replaced character of
it and both have at least ``NEAR_CHARS`` characters. Earlier means: a smaller document id, within a document
a smaller line number. Of the equal lines the first stands for all; blank lines are never touched.

Two distinct lines one edit apart have an equal variant: the lines themselves and all their texts with one
character deleted, as hashed keys. Replaced characters stand at the same place, so those variants meet under
(variant, place); an inserted character makes the variant of one line the other line itself. In both cases an
aggregate per key finds the earliest line, no pairs within a key are made, and the edit distance of each found
pair is verified on the texts. One edit leaves either the first or the last half of a line as it was, and all
but one of eight stretches: variants are only made of lines that share a half and then all but a stretch with
another line, and only by deleting in that stretch. So no pair is lost.

Defined results: a null or empty text has no lines and stays as it is; a text all of whose lines go is empty.
A row without an id has no place in the order: it stays as it is and nothing is compared with it. Rows with
equal ids are one document: a line number that goes is taken out of each. Extra columns are ignored by
``deduplicate`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.llm.filters import maybe_in
from boxtally.llm.text import mix, powers, signed
from boxtally.session import cut_lineage, settled

#: Below so many characters a line has only equal lines: one edit would be too much of it.
NEAR_CHARS = 16
STRETCHES = 8
#: Lines that a task holds as Python's strings and lists at a time.
LINES = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def normal_form(line: Column) -> Column:
    """Lower case, trimmed, each run of white space one space; most lines have single spaces only and skip the pattern."""
    plain = ~(F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\x0b")))
    return F.lower(F.trim(F.when(plain, line).otherwise(F.regexp_replace(line, r"\s+", " "))))


def _half(n: Column) -> Column:
    """Largest power of two of which two fit into n - 1 characters."""
    return F.pow(F.lit(2.0), F.floor(F.log2((n - 1) / 2 + 1e-9))).cast("int")


def _stretch(n: Column) -> Column:
    """A length of which eight fit into n - 1 characters, from a grid of four steps for each doubling."""
    return F.floor(F.pow(F.lit(2.0), F.floor(F.log2((n - 1) / STRETCHES) * 4 + 1e-9) / 4)).cast("int")


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line, key) of the lines that are not blank."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text <> ''")
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return lines.select("doc_id", "line_no", normal_form(F.col("raw")).alias("line")).filter("line <> ''").withColumn("key", F.xxhash64("line", F.lit(1)))


def near_earlier(all_lines: DataFrame) -> DataFrame:
    """Keys of lines with an earlier line one edit away: (key, seen_doc, seen_line). ``all_lines`` comes from ``document_lines``."""
    n = F.char_length("line")
    # a line one character longer may use the next larger half, which this line then offers as well
    halves = all_lines.filter(n >= NEAR_CHARS).select("key", "line", F.explode(F.array_distinct(F.array(_half(n), _half(n + 1)))).alias("p"))
    halves = halves.select("key", F.explode(F.array(
        F.xxhash64(F.lit(0), "p", F.substring(F.col("line"), F.lit(1), F.col("p"))),
        F.xxhash64(F.lit(1), "p", F.substring(F.col("line"), -F.col("p"), F.col("p"))),
    )).alias("half"))
    shared = cut_lineage(_held_by_two(halves, "half"))
    may_share, _ = maybe_in(halves, shared, ("half",))
    wanted = cut_lineage(may_share.join(shared, "half").select("key").distinct())
    some, _ = maybe_in(all_lines, wanted, ("key",))
    lines = some.join(wanted, "key").groupBy("key").agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "line_no")).alias("place"))
    # one number per line in order of its first place, so that variants carry a number instead of a place
    lines = cut_lineage(
        lines.repartitionByRange("place").sortWithinPartitions("place").select(
            F.monotonically_increasing_id().alias("turn"), "key", "line", "place.doc_id", "place.line_no"
        )
    )
    rest = F.lit(STRETCHES - 1) - F.col("i")
    open_at = (
        lines.select("key", "line", F.explode(F.array_distinct(F.array(_stretch(n), _stretch(n + 1)))).alias("q"))
        .select("key", "line", "q", F.explode(F.sequence(F.lit(0), F.lit(STRETCHES - 1))).alias("i"))
        .select("key", "i", "q", F.xxhash64(
            F.lit(2), "i", "q", F.substring(F.col("line"), F.lit(1), F.col("i") * F.col("q")),
            F.substring(F.col("line"), n - rest * F.col("q") + 1, rest * F.col("q")),
        ).alias("others"))
    )
    shared = _held_by_two(open_at, "others")
    gaps = open_at.join(shared, "others").groupBy("key").agg(F.collect_set(F.struct("i", "q")).alias("gaps"))

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, LINES) for whole in batches for i in range(0, whole.num_rows, LINES)):
            for at, (line, own) in enumerate(zip(batch.column("line").to_pylist(), batch.column("gaps").to_pylist())):
                value, place = line_variants(line)
                wanted = place < 0
                for gap in own:
                    wanted[gap["i"] * gap["q"] : len(line) - (STRETCHES - 1 - gap["i"]) * gap["q"]] = True
                source = batch.column("turn").take(pa.array(np.full(int(wanted.sum()), at)))
                yield pa.RecordBatch.from_arrays([source, pa.array(signed(value[wanted])), pa.array(place[wanted])], ["turn", "variant", "at"])

    made = cut_lineage(lines.join(gaps, "key").select("turn", "line", "gaps").mapInArrow(variants, "turn bigint, variant bigint, at int"))
    # what follows needs only the variants of two different lines, a small part of all
    met = made.groupBy("variant").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).filter("a < b").select("variant")
    met = cut_lineage(met)
    may_meet, _ = maybe_in(made, met, ("variant",))
    made = cut_lineage(may_meet.join(met, "variant"))
    first = F.min("turn").alias("first")
    # one character replaced: equal variants with the same place deleted
    replaced = made.filter("at >= 0").groupBy("variant", "at").agg(first, F.max("turn").alias("last")).filter("first < last").select("variant", "at", "first")
    by_replacing = made.join(replaced, ["variant", "at"]).select("turn", "first")
    # one character inserted: the whole line (at -1) equals a variant of the longer one
    longer = made.filter("at >= 0").groupBy("variant").agg(first)
    whole = made.filter("at = -1").select("variant", F.col("turn").alias("shorter"))
    by_deleting = whole.join(longer, "variant").select(F.col("shorter").alias("turn"), "first")
    by_inserting = made.filter("at >= 0").join(whole, "variant").select("turn", F.col("shorter").alias("first"))
    found = by_replacing.unionByName(by_deleting).unionByName(by_inserting).filter("first < turn")
    best = found.groupBy("turn").agg(F.min("first").alias("first"))
    earlier = lines.select(F.col("turn").alias("first"), F.col("line").alias("earlier"), F.col("doc_id").alias("seen_doc"), F.col("line_no").alias("seen_line"))
    pairs = best.join(lines.select("turn", "key", "line"), "turn").join(earlier, "first")
    return pairs.filter(F.levenshtein("line", "earlier", 1) >= 0).select("key", "seen_doc", "seen_line")


def _held_by_two(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column that rows of two different lines have; combined before the shuffle."""
    return rows.groupBy(column).agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").select(column)


def line_variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a line without each of its characters and of the whole line, with the place deleted (-1: none).

    The hash of a text is a polynomial of its code points, so each variant joins a prefix and a shifted suffix
    and a line costs time in proportion to its length.
    """
    c = mix(np.frombuffer(line.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(c)
    power = powers(_BASE, n + 1)
    with np.errstate(over="ignore"):
        up = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(c * power[:n], out=up[1:])
        down = np.zeros(n + 1, dtype=np.uint64)  # the suffix behind each place, one power lower
        down[: n - 1] = np.cumsum((c[1:] * power[: n - 1])[::-1])[::-1] if n > 1 else down[:0]
        value = np.append(mix(up[:n] + down[:n] + np.uint64(n - 1)), mix(up[n:] + np.uint64(n)))
    return value, np.append(np.arange(n), -1).astype(np.int32)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no) of every line that goes.

    A line meets the first place of its key in a join that AQE can split when one line holds a third of all rows.
    """
    lines = cut_lineage(document_lines(docs, id_col, text_col))
    near = settled(lambda: near_earlier(lines))
    # written, so that the lines meet a plain table and AQE can split a key that a third of them share
    seen = lines.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("place")).join(near.select("key", F.lit(True).alias("near")), "key", "left")
    seen = cut_lineage(seen)
    place = F.struct("doc_id", "line_no")
    return lines.select("doc_id", "line_no", "key").join(seen, "key").filter(F.col("near") | (F.col("place") < place)).select("doc_id", "line_no")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the lines that go taken out of their texts; all rows and columns stay, and ``n_lines_dropped`` is added."""
    gone = settled(lambda: dropped_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone")))
    # the row travels as one column, so that its own columns may have any name
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    kept = F.transform(
        F.array(F.split(F.col("row")[text_col], "\n")),
        lambda all_lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")), lambda i: F.element_at(all_lines, i + 1)), "\n"
        ),
    )[0]
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(kept)
    own = [(text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns]
    # written, the table looks small enough to be broadcast on small inputs only; the work should grow evenly
    return keyed.join(gone.hint("merge"), "doc_id", "left").select(*own, F.coalesce(F.size("gone"), F.lit(0)).alias("n_lines_dropped"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines_dropped), a row per row of ``docs``."""
    return clean(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
