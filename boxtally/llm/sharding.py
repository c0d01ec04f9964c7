"""Shards of equal counts that keep linked documents together, by balanced label propagation.

Documents are linked through hubs: two that share a hub (here: an equal text) are neighbours. Every round a hub
finds its homes, the shards that hold most of its members (more than one only where it has more members than a
shard has room), and a document votes for the homes of its hubs. Those that are not where most of their votes are
want to move. How many may go from each shard to each other is cut until no shard holds more than its quota; of
more candidates those of largest gain go first. A shard that had to turn candidates away is a home of last resort in
the next round, and in proportion to what it refused small hubs that are together in it move elsewhere. Rounds are
joins and aggregates over the linked documents only and go on while fewer and fewer are away from home. Documents without a link are placed last and fill what room the quotas leave, so counts end at most one apart.

What reaches the driver is one number for each pair of shards and one for each partition.

Defined results: a null text has no bytes, size 1, and equals the empty text. Rows are told apart by a number of
their own, so equal rows, repeated ids and rows without an id are placed like any other. An empty table gives no
rows. Ties between shards go by a digest of hub or row. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.llm.ordering import numbered
from boxtally.session import cut_lineage

SHARDS = 8
#: Rounds at most; they end earlier when nothing moves or the spread no longer falls.
ROUNDS = 30
#: Rounds without a gain after which they end.
PATIENCE = 4
#: A shard is full when it refuses more than this share of its quota, and more than a quarter of what any other refuses.
SLACK = 0.01


def quotas(rows: int, shards: int) -> list[int]:
    """How many rows each shard holds: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def allowed_moves(wanted: dict[tuple[int, int], int], held: list[int], quota: list[int]) -> dict[tuple[int, int], int]:
    """Moves between shards, none more than ``wanted``, after which no shard holds more than its quota.

    Inflows of an overfull shard are cut in proportion; that keeps rows where they are, which may fill another
    shard, so cuts go on until all fit. Without any move all fit, so they end.
    """
    moves = {k: v for k, v in wanted.items() if v}
    while True:
        full = True
        for s in range(len(held)):
            into = [k for k in moves if k[1] == s]
            inflow = sum(moves[k] for k in into)
            over = held[s] + inflow - sum(v for k, v in moves.items() if k[0] == s) - quota[s]
            if over <= 0:
                continue
            full = False
            for k in sorted(into, key=lambda k: -moves[k]):
                cut = min(moves[k], -(-moves[k] * over // inflow) if inflow else 0, over)
                inflow -= moves[k]
                moves[k] -= cut
                over -= cut
        if full:
            return {k: v for k, v in moves.items() if v}


def _homes(placed: DataFrame, quota: int, shards: int, refused: dict[int, float], turn: int) -> DataFrame:
    """(hub, homes, away): the shards that its members should be in, and how many are outside the fullest of them.

    ``refused`` has the full shards and the share of their quota that they could not take in the last round. A hub that is not together
    prefers other homes, and that share of the hubs with one home leaves it.
    """
    counts = placed.groupBy("hub", "shard").agg(F.count("*").alias("c"))
    pair = F.struct((-F.col("c")).alias("c"), F.xxhash64("hub", "shard").alias("h"), F.col("shard").alias("shard"))
    hub = counts.groupBy("hub").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(pair)).alias("in"))
    hub = hub.withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n") / quota)).cast("int"))
    need, inside = F.col("need"), F.col("in.shard")
    away = F.col("n") + F.aggregate(F.slice("in", F.lit(1), need), F.lit(0).cast("long"), lambda a, x: a + x.c)
    full = F.array(*[F.lit(x) for x in sorted(refused) or [-1]])
    if refused:  # the homes of large hubs stay
        inside = F.when(need == 1, F.concat(F.filter(inside, lambda t: ~F.array_contains(full, t)), F.filter(inside, lambda t: F.array_contains(full, t)))).otherwise(inside)
    # a hub that needs more shards than it is in takes others too, those with room first
    others = F.array_sort(F.transform(F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.col("in.shard")), lambda t: F.struct(
        F.array_contains(full, t).alias("shut"), F.xxhash64("hub", t).alias("h"), t.alias("shard"))))
    ranked = F.concat(inside, others["shard"])
    if refused:
        share = F.element_at(F.array(*[F.lit(refused.get(x, 0.0)) for x in range(shards)]), ranked[0] + 1)
        leaves = (need == 1) & (F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(1 << 20)) < share * (1 << 20))
        there = [x for x in range(shards) if x not in refused]
        if there:
            another = F.element_at(F.array(*[F.lit(x) for x in there]), (F.pmod(F.xxhash64("hub", F.lit(-turn)), F.lit(len(there))) + 1).cast("int"))
            ranked = F.when(leaves & (F.size("in") == 1), F.array(another)).otherwise(ranked)
    return hub.select("hub", F.slice(ranked, F.lit(1), need).alias("homes"), away.alias("away"))


def _candidates(placed: DataFrame, homes: DataFrame, shards: int) -> DataFrame:
    """(row, shard, target, gain) of the documents that most of their hubs' votes call elsewhere."""
    votes = [F.sum(F.when(F.array_contains("homes", s), F.col("weight")).otherwise(0.0)).alias(f"v{s}") for s in range(shards)]
    voted = placed.join(homes, "hub").groupBy("row", "shard").agg(*votes)
    each = F.array(*[F.struct(F.col(f"v{s}").alias("v"), F.xxhash64("row", F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)])
    best = F.array_max(each)
    own = F.element_at(F.array(*[F.col(f"v{s}") for s in range(shards)]), F.col("shard") + 1)
    ranked = voted.select("row", "shard", best.alias("best"), own.alias("own"))
    return ranked.filter(F.col("best.v") > F.col("own")).select("row", "shard", F.col("best.s").alias("target"), (F.col("best.v") - F.col("own")).alias("gain"))


def _chosen(wishes: DataFrame, wanted: dict[tuple[int, int], int], moves: dict[tuple[int, int], int]) -> DataFrame:
    """The candidates that may move: the first of each pair of shards in order of gain."""
    if moves == wanted:
        return wishes
    order = sorted(wanted)
    starts = dict(zip(order, accumulate([0, *[wanted[k] for k in order[:-1]]])))
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(starts[a, b] + moves.get((a, b), 0)).alias("end")) for a, b in order])
    end = F.filter(ends, lambda e: (e.a == F.col("shard")) & (e.b == F.col("target")))[0]["end"]
    ranked = numbered(wishes, [F.col("shard"), F.col("target"), F.col("gain").desc(), F.xxhash64("row"), F.col("row")], "n")
    return ranked.filter(F.col("n") < end)


def propagate(links: DataFrame, quota: list[int], rounds: int = ROUNDS, patience: int = PATIENCE) -> DataFrame:
    """(row, shard) of the linked rows. ``links`` has (row, hub, weight, shard), the shard it starts in; no shard starts or ends above its quota.

    The placement of the round with the fewest members away from home is returned.
    """
    shards, room = len(quota), max(min(quota), 1)
    placed = best = cut_lineage(links.select("row", "hub", "weight", "shard"))
    lowest, since, refused = None, 0, {}
    for turn in range(1, rounds + 1):
        homes = cut_lineage(_homes(placed, room, shards, refused, turn))
        away = homes.agg(F.coalesce(F.sum("away"), F.lit(0))).first()[0]
        if lowest is None or away < lowest:
            best, lowest, since = placed, away, 0
        else:
            since += 1
        if not away or since >= patience:
            break
        wishes = cut_lineage(_candidates(placed, homes, shards))
        wanted = {(r["shard"], r["target"]): r["count"] for r in wishes.groupBy("shard", "target").count().collect()}
        held = [0] * shards
        for r in placed.select("row", "shard").distinct().groupBy("shard").count().collect():
            held[r["shard"]] = r["count"]
        moves = allowed_moves(wanted, held, quota)
        refused = {}
        for (a, b), n in wanted.items():
            if n > moves.get((a, b), 0):
                refused[b] = refused.get(b, 0.0) + (n - moves.get((a, b), 0)) / max(quota[b], 1)
        usual = max(SLACK, *[x / 4 for x in refused.values()], 0)
        refused = {b: x - usual for b, x in refused.items() if x > usual}
        if moves:
            moved = placed.join(_chosen(wishes, wanted, moves).select("row", "target"), "row", "left")
            placed = cut_lineage(moved.select("row", "hub", "weight", F.coalesce("target", "shard").alias("shard")))
    return best.select("row", "shard").distinct()


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; equal texts are linked."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = numbered(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("hub"),
    ), name="row")
    n = rows.count()
    quota = quotas(n, shards)
    groups = rows.groupBy("hub").count().filter("count > 1").select("hub")
    links = rows.join(groups, "hub", "left_semi").select("row", "hub", F.lit(1.0).alias("weight"), (F.col("row") % shards).cast("int").alias("shard"))
    linked = cut_lineage(propagate(links, quota, rounds))
    held = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
    fill = list(accumulate(quota[s] - held.get(s, 0) for s in range(shards)))
    single = numbered(rows.select("row").join(linked, "row", "left_anti"), name="k")
    shard = sum((F.when(F.col("k") >= end, 1).otherwise(0) for end in fill[:-1]), F.lit(0))
    everyone = linked.select("row", "shard").unionByName(single.select("row", shard.cast("int").alias("shard")))
    whole = numbered(rows.drop("hub").join(everyone, "row"), [F.col("shard"), F.col("doc_id").asc_nulls_last(), F.col("row")], "n")
    return whole.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("n") - _start(quota)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _start(quota: list[int]) -> Column:
    starts = [0, *accumulate(quota[:-1])]
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard") + 1)
