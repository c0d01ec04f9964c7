"""Near-duplicate documents by ProbMinHash.

A document is the multiset of its five-word shingles, weighted by how often each occurs. Every shingle is a
Poisson process whose rate is its weight; each arrival falls on one of ``REGISTERS`` registers, which keeps the
shingle that arrives first. A shingle stops arriving once its time is behind the slowest register of its
document. Two documents agree in a register with a probability equal to their probability Jaccard
similarity J_P, which for unweighted sets of shingles is their Jaccard similarity. Registers are hashed in
bands; documents that share a band are candidates, and J_P of 0.8 or more is verified on the whole texts.

Copies (equal sequences of words) are one text: only one of them, the smallest id, is compared.

No list of all pairs is made. Everyone in a band's bucket is compared with its leader, the smallest id; that
settles groups of copies in one step. Documents that buckets connect but these links don't are then compared in
blocks of bounded size: all but the largest class of such a group against each other and against that class.
Within a block registers are compared first; a pair that agrees in fewer than ``SCREEN`` of them is passed over
(for a pair at the bound a chance below 1e-5), and so is a pair that is connected already. So the classes are
those of all links, and what a block gives out is no more than it needs to connect them.

Defined results: null and empty texts have no shingles and are copies of each other; a text of one to four
words has one shingle of all its words. Rows with equal ids and equal texts are one document; where ids may repeat
with different texts the caller numbers the rows and passes the number, as the pipeline does. A row without an id is
not compared: it is in no class. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.llm.filters import maybe_in
from boxtally.llm.text import by_text, chunks, mix, shingles, signed, words
from boxtally.operators.graph import connected_components
from boxtally.session import cut_lineage

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
CHUNK = 1 << 20
#: Share of registers in which a pair has to agree to be verified.
SCREEN = 0.6
#: Documents in one block of a comparison; a task holds two.
BLOCK_ROWS = 512


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of several texts: the element that arrives first in each; 0 where a text has none.

    ``owner``, ``element`` and ``weight`` list the distinct elements of all texts. An element's arrivals depend
    on nothing but itself and its weight, so equal documents have equal registers everywhere.
    """
    first = np.full(texts * registers, np.inf)
    held = np.zeros(texts * registers, dtype=np.uint64)
    base = owner * registers
    time = np.zeros(len(owner))
    turn = 0
    live = np.arange(len(owner))
    while len(live):
        draw = mix(element[live] + np.uint64((0x9E3779B97F4A7C15 * (2 * turn + 1)) % (1 << 64)))
        place = mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
        time[live] -= np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[live]
        at = base[live] + (place % np.uint64(registers)).astype(np.int64)
        better = time[live] < first[at]
        np.minimum.at(first, at[better], time[live][better])
        won = better & (time[live] == first[at])
        held[at[won]] = element[live][won]
        slowest = first.reshape(texts, registers).max(axis=1)
        live = live[time[live] < slowest[owner[live]]]
        turn += 1
    return held.reshape(texts, registers)


def bands(held: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each text."""
    parts = held.reshape(len(held), -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ parts[:, :, k])
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, bands_: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, words_key, bands, registers): a digest of the sequence of words, band hashes (null without shingles), 16 bits of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").to_pylist()
            for i, j in chunks(column, CHUNK):
                texts = column[i:j]
                value, offsets = words(texts)
                keys = [hashlib.md5(value[a:b].tobytes()).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                owner, element, count = by_text(*shingles(texts, WORDS))
                with np.errstate(over="ignore"):
                    held = signatures(owner, element, count.astype(np.float64), len(texts), bands_ * rows)
                    found = bands(held, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands_), pa.array(signed(found.ravel())), mask=pa.array(offsets[1:] == offsets[:-1])
                )
                short = [x.tobytes() for x in (held >> np.uint64(48)).astype(np.uint16)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(keys, pa.binary()), lists, pa.array(short, pa.binary())], ["doc_id", "words_key", "bands", "registers"]
                )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return own.mapInArrow(run, "doc_id bigint, words_key binary, bands array<bigint>, registers binary")


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, each as sorted distinct elements and their weights.

    J_P is the sum over common elements d of 1 / sum over all e of max(x_e / x_d, y_e / y_d). With the elements
    ordered by y / x, those behind d take their y and those before it their x, so prefix sums do.
    """
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][ia].astype(np.float64), b[1][ib].astype(np.float64)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below = float(a[1].sum()) - x.sum() + np.cumsum(x)
    above = float(b[1].sum()) - np.cumsum(y)
    return float((1.0 / (below / x + above / y)).sum())


def _distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(leader, member, distance) of pairs; the member's text goes to the leader, whose hot key AQE can split."""
    one = texts.select(F.col("id").alias("member"), F.col("text").alias("own"))
    two = texts.select(F.col("id").alias("leader"), F.col("text").alias("other"))
    joined = pairs.join(one, "member").join(two, "leader").select("leader", "member", "own", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, tuple] = (None, ())
        for batch in batches:
            out = []
            for own, other in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist()):
                if other != last[0]:
                    last = (other, by_text(*shingles([other], WORDS))[1:])
                out.append(1.0 - probability_jaccard(by_text(*shingles([own], WORDS))[1:], last[1]))
            yield pa.RecordBatch.from_arrays([batch.column("leader"), batch.column("member"), pa.array(out, pa.float64())], ["leader", "member", "distance"])

    return joined.mapInArrow(run, "leader bigint, member bigint, distance double")


def _star_classes(nodes: DataFrame, stars: DataFrame) -> DataFrame:
    """(id, component) of all ``nodes``; ``stars`` has a row (member, leaders) per member, its smaller ids, at most one a band.

    Members hang on their smallest leader, so only leaders go through the rounds: linked when a member has both.
    """
    low = cut_lineage(stars.select("member", F.array_min("leaders").alias("p"), "leaders"))
    leaders = cut_lineage(low.select(F.explode("leaders").alias("id")).distinct())
    among = low.select(F.col("p").alias("u"), F.explode("leaders").alias("v")).filter("u <> v").distinct()
    own = low.select(F.col("p").alias("u"), F.col("member").alias("v")).join(leaders.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
    labels = cut_lineage(connected_components(leaders, among.unionByName(own)).withColumnRenamed("id", "at"))
    at = cut_lineage(nodes.join(low.select(F.col("member").alias("id"), "p"), "id", "left").select("id", F.coalesce("p", "id").alias("at")))
    return at.join(labels, "at", "left").select("id", F.coalesce("component", "at").alias("component"))


def links(buckets: DataFrame, texts: DataFrame, least: float = LEAST, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Classes (id, component) by the links to leaders, and further links (u, v) between those classes.

    ``buckets`` has (bucket, id) with at least two members each, ``texts`` (id, text, registers).
    """
    far = 1.0 - least + 1e-9
    leader = cut_lineage(buckets.groupBy("bucket").agg(F.min("id").alias("leader")))
    stars = cut_lineage(buckets.join(leader, "bucket").filter("id <> leader").select("leader", F.col("id").alias("member")).distinct())
    measured = _distances(stars, texts)
    seen = cut_lineage(measured.groupBy("member").agg(
        F.collect_set("leader").alias("leaders"), F.collect_set(F.when(F.col("distance") <= far, F.col("leader"))).alias("near")
    ))
    nodes = texts.select("id")
    groups = _star_classes(nodes, seen.select("member", "leaders")).withColumnRenamed("component", "grp")
    classes = _star_classes(nodes, seen.filter(F.size("near") > 0).select("member", F.col("near").alias("leaders")))
    rows = cut_lineage(groups.join(classes, "id"))
    sizes = rows.groupBy("grp", "component").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("grp").agg(
        F.count("*").alias("classes"), F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.max("n").alias("most")
    ).filter("classes > 1")
    open_ = cut_lineage(open_.select(
        "grp", "main", F.ceil(F.col("others") / block_rows).cast("int").alias("k"), F.ceil(F.col("most") / block_rows).cast("int").alias("k_main")
    ))
    in_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(in_main, F.col("k_main")).otherwise(F.col("k"))).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda a, b, main, first: F.struct(a.alias("a"), b.alias("b"), F.lit(main).alias("with_main"), first.alias("first"))
    among = F.transform(each("k"), lambda j: place(F.least("own", j), F.greatest("own", j), False, F.col("own") <= j))
    against = F.transform(each("k_main"), lambda j: place(F.col("own"), j, True, F.lit(True)))
    from_main = F.transform(each("k"), lambda i: place(i, F.col("own"), True, F.lit(False)))
    placed = rows.join(open_, "grp").withColumn("own", own).select(
        "id", "grp", "component", F.explode(F.when(in_main, from_main).otherwise(F.concat(among, against))).alias("p")
    )
    placed = placed.select("id", "component", F.xxhash64("grp", "p.a", "p.b", "p.with_main").alias("block"), "p.first", (~F.col("p.with_main") & (F.col("p.a") == F.col("p.b"))).alias("alone"))
    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = placed.join(texts, "id").repartition(parts, "block").sortWithinPartitions("block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "component", "first", "alone", "registers", "text"))):
                if held and held[0][0] != row[0]:
                    yield _block_links(held, least)
                    held = []
                held.append(row)
        if held:
            yield _block_links(held, least)

    compared = whole.select("block", "id", "component", "first", "alone", "registers", "text").mapInArrow(run, "u bigint, v bigint")
    return rows.select("id", "component"), cut_lineage(compared)


def _block_links(rows: list, least: float) -> pa.RecordBatch:
    """Links between the classes of the two sides of a block, or of a block alone, that connect them."""
    registers = np.array([np.frombuffer(r[5], dtype=np.uint16) for r in rows])
    first = np.array([r[3] for r in rows])
    alone = rows[0][4]
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    sets: dict[int, tuple] = {}

    def own(i: int) -> tuple:
        if i not in sets:
            sets[i] = by_text(*shingles([rows[i][6]], WORDS))[1:]
        return sets[i]

    found = []
    others = np.flatnonzero(~first)
    for i in np.flatnonzero(first):
        against = np.arange(i + 1, len(rows)) if alone else others
        agree = (registers[against] == registers[i]).mean(axis=1)
        for j in against[agree >= SCREEN][np.argsort(-agree[agree >= SCREEN], kind="stable")]:
            a, b = top(rows[i][2]), top(rows[j][2])
            if a != b and probability_jaccard(own(i), own(j)) >= least - 1e-9:
                root[max(a, b)] = min(a, b)
                found.append((rows[i][2], rows[j][2]))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, class_id, class_size, is_copy, kept): a row per distinct id and text; a class is named by its smallest id, which is kept."""
    drawn = cut_lineage(sketch(docs, id_col, text_col))
    # tables that hot keys meet are written first, so that both sides of those joins are plain exchanges AQE can split
    reps = cut_lineage(drawn.groupBy("words_key").agg(F.min("doc_id").alias("rep")))
    rep_bands = drawn.join(reps, [drawn["words_key"] == reps["words_key"], drawn["doc_id"] == reps["rep"]], "left_semi").select("doc_id", "bands")
    keys = cut_lineage(rep_bands.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")).distinct())
    shared = cut_lineage(keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    buckets = cut_lineage(keys.join(shared, "bucket"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = cut_lineage(buckets.select("id").distinct())
    may, _ = maybe_in(own, wanted, ("id",))
    texts = may.join(wanted, "id").dropDuplicates(["id"]).join(drawn.select(F.col("doc_id").alias("id"), "registers").dropDuplicates(["id"]), "id")
    texts = cut_lineage(texts)
    classes = reps.select(F.col("rep").alias("id"), F.col("rep").alias("component"))
    if not buckets.isEmpty():
        by_leader, between = links(buckets, texts, least)
        merged = cut_lineage(connected_components(by_leader.select(F.col("component").alias("id")).distinct(), between).withColumnRenamed("component", "whole"))
        found = cut_lineage(by_leader.join(merged.withColumnRenamed("id", "component"), "component").select("id", "whole"))
        classes = classes.join(found, "id", "left").select("id", F.coalesce("whole", "component").alias("component"))
    classes = cut_lineage(classes)
    members = cut_lineage(drawn.select("doc_id", "words_key").distinct().join(reps, "words_key").join(classes.withColumnRenamed("id", "rep"), "rep"))
    sizes = cut_lineage(members.groupBy("component").agg(F.count("*").alias("class_size")))
    return members.join(sizes, "component").select(
        "doc_id", F.col("component").alias("class_id"), "class_size", (F.col("doc_id") != F.col("rep")).alias("is_copy"),
        (F.col("doc_id") == F.col("component")).alias("kept"),
    )
