"""Greedy independent sets and connected components over conflict graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.operators.groups import oversized_groups, split_by
from boxtally.session import cut_lineage

MAX_GROUP_EDGES = 100_000


def fold_lost(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids dropped when bounded groups are taken in turn: (keys, id).

    ``edges`` has (keys, u, v, turn): a better item ``u`` that clashes with ``v``, and the sort key
    of ``v``. An item is dropped when a clashing better item was not itself dropped. Items nothing
    clashes with never enter the fold.
    """
    blockers = edges.groupBy(*keys, "v", "turn").agg(F.collect_list("u").alias("blockers"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "v", "blockers"))).alias("turns")
    fold = """
      aggregate(turns, cast(array() as array<bigint>),
        (lost, d) -> if(size(array_except(d.blockers, lost)) > 0, concat(lost, array(d.v)), lost))
    """
    return blockers.groupBy(*keys).agg(turns).select(*keys, F.explode(F.expr(fold)).alias("id"))


def rounds_keep(items: DataFrame, edges: DataFrame, keys: Sequence[str], max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """Greedy keep of unbounded groups: ``edges`` has (keys, u, v), ``u`` the better end.

    Every round keeps all items without a live better neighbour and drops the neighbours of what was kept, which is
    what the one-by-one order would do. What is still open then is made smaller without waiting for the order: groups
    and, in larger groups, components of up to ``max_group`` edges are settled in one task each, and in components
    beyond that chains of single blockers are followed by pointer jumping. So a long chain takes no round per link. A
    round settles the best live item of every component at least, so the rounds end.
    """
    k = list(keys)
    live = cut_lineage(edges.select(*k, "u", "v"))
    lost: list[DataFrame] = []
    while not live.isEmpty():
        dominated = live.select(*k, F.col("v").alias("u")).distinct()
        kept = live.select(*k, "u").distinct().join(dominated, [*k, "u"], "left_anti")
        lost.append(cut_lineage(live.join(kept, [*k, "u"], "left_semi").select(*k, F.col("v").alias("id")).distinct()))
        live = _without(live, lost[-1], k)
        live = _settle_bounded(live, k, max_group, lost)
        if live is None:
            break
        live = _settle_components(live, k, max_group, lost)
        if live is None:
            break
        lost.append(_odd_chain_ends(live, k))
        live = _without(live, lost[-1], k)
    for gone in lost:
        items = items.join(gone, [*k, "id"], "left_anti")
    return items


def _without(live: DataFrame, gone: DataFrame, k: list[str]) -> DataFrame:
    """The edges neither of whose ends is ``gone``."""
    left = live.join(gone.withColumnRenamed("id", "v"), [*k, "v"], "left_anti").join(gone.withColumnRenamed("id", "u"), [*k, "u"], "left_anti")
    return cut_lineage(left.select(*k, "u", "v"))


def _settle_bounded(live: DataFrame, k: list[str], max_group: int, lost: list[DataFrame]) -> DataFrame | None:
    """Settles the groups of bounded size; what is left, or None."""
    if not k:
        return live
    hot = oversized_groups([live], k, max_group)
    small, large = (live, None) if hot is None else split_by(live, hot, k)
    lost.append(cut_lineage(_settled(small, k)))
    return large


def _settle_components(live: DataFrame, k: list[str], max_group: int, lost: list[DataFrame]) -> DataFrame | None:
    """Settles the components of bounded size; the edges of larger ones, or None."""
    ids = live.select(*k, F.col("u").alias("id")).distinct()
    label = connected_components(ids, live, k, max_group).withColumnRenamed("id", "u")
    tagged = cut_lineage(live.join(label, [*k, "u"]).select(*k, "component", "u", "v"))
    left = _settle_bounded(tagged, [*k, "component"], max_group, found := [])
    lost += [f.select(*k, "id") for f in found]
    return None if left is None else cut_lineage(left.select(*k, "u", "v"))


def _odd_chain_ends(live: DataFrame, k: list[str]) -> DataFrame:
    """Items that go because they lie an odd number of single blockers behind an item that nothing blocks: (keys, id).

    An item with one live blocker stays exactly if the blocker goes. So each points to its blocker, and pointers are
    doubled until they end at an item with no blocker or with several; of the latter nothing is known yet.
    """
    blocked = cut_lineage(live.groupBy(*k, "v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("a")))
    way = cut_lineage(blocked.filter("n = 1").select(*k, "v", "a", F.lit(1).alias("odd")))
    while True:
        ahead = way.select(*k, F.col("v").alias("a"), F.col("a").alias("a2"), F.col("odd").alias("odd2"))
        step = cut_lineage(way.join(ahead, [*k, "a"], "left").select(
            *k, "v", F.coalesce("a2", "a").alias("a"), (F.col("odd") + F.coalesce("odd2", F.lit(0))).bitwiseAND(F.lit(1)).alias("odd"), F.col("a2").isNotNull().alias("moved")
        ))
        way = step.select(*k, "v", "a", "odd")
        if step.filter("moved").isEmpty():
            break
    ends = way.join(blocked.select(*k, F.col("v").alias("a")), [*k, "a"], "left_anti")
    return cut_lineage(ends.filter("odd = 1").select(*k, F.col("v").alias("id")))


def _coded(pdf: pd.DataFrame, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends u, ends v, ids, codes) of the edges: nodes of different groups get codes of their own that sort by id inside a group."""
    n = len(pdf)
    group = pdf.groupby(list(keys), sort=False).ngroup().to_numpy()
    ids, at = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    codes, node = np.unique(np.concatenate([group, group]) * len(ids) + at, return_inverse=True)
    return node[:n], node[n:], ids, codes


def _lost_items(pdf: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """Items that go, for the edges (keys, u, v) of some whole groups: each is decided once all its blockers are."""
    a, b, ids, codes = _coded(pdf, keys)
    order = np.argsort(a, kind="stable")
    first = np.searchsorted(a[order], np.arange(len(codes) + 1)).tolist()
    below, waiting = b[order].tolist(), np.bincount(b, minlength=len(codes)).tolist()
    stays = [True] * len(codes)
    ready = [x for x, n in enumerate(waiting) if not n]
    while ready:
        x = ready.pop()
        for y in below[first[x] : first[x + 1]]:
            stays[y] = stays[y] and not stays[x]
            waiting[y] -= 1
            if not waiting[y]:
                ready.append(y)
    gone = np.flatnonzero(~np.array(stays, dtype=bool))
    row = np.empty(len(codes), dtype=np.int64)
    row[b] = np.arange(len(b))
    out = pdf[list(keys)].iloc[row[gone]].reset_index(drop=True)
    out["id"] = ids[codes[gone] % len(ids)]
    return out


def _settled(edges: DataFrame, k: list[str]) -> DataFrame:
    return _whole_groups(edges, k, _lost_items, "id bigint")


def _label_edges(pdf: pd.DataFrame, keys: Sequence[str]) -> pd.DataFrame:
    """Smallest reachable id of every node for the edges (keys, u, v) of some whole groups."""
    n = len(pdf)
    a, b, ids, codes = _coded(pdf, keys)
    label = np.arange(len(codes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    first = np.empty(len(codes), dtype=np.int64)
    first[a] = first[b] = np.arange(n)
    out = pdf[list(keys)].iloc[first].reset_index(drop=True)
    out["id"] = ids[codes % len(ids)]
    out["component"] = ids[codes[label] % len(ids)]
    return out


def _fold_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of bounded groups."""
    return _whole_groups(edges, keys, _label_edges, "id bigint, component bigint")


def _whole_groups(
    edges: DataFrame, keys: Sequence[str], fold: Callable[[pd.DataFrame, Sequence[str]], pd.DataFrame], adds: str, batch_rows: int = 200_000
) -> DataFrame:
    """(keys, ``adds``) of bounded groups: one shuffle on the group, ``fold`` takes the edges of many whole groups at a time."""
    k = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < batch_rows:
                continue
            pool = pd.concat(held, ignore_index=True)
            # rows come sorted by group; the last group may go on in the next batch
            last = (pool[k] == pool[k].iloc[-1]).all(axis=1).to_numpy()
            if not last.all():
                yield fold(pool[~last], k)
                pool = pool[last]
            held, rows = [pool], len(pool)
        if rows:
            yield fold(pd.concat(held, ignore_index=True), k)

    ddl = ", ".join([*[f"{c} {kinds[c]}" for c in k], adds])
    # work per byte is high here, so the partitions are not merged by size
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = edges.select(*k, "u", "v").repartition(parts, *k).sortWithinPartitions(*k)
    return placed.mapInPandas(solve, ddl)


def _round_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels of groups of any size by rounds of joins keyed by single nodes.

    Alternates taking the smallest label among the neighbours with pointer jumping, so the number
    of rounds grows with the logarithm of the longest chain.
    """
    k = list(keys)
    both = edges.select(*k, "u", "v").unionByName(edges.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy(*k, "u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:  # labels only fall, and a round that lowers none is the last
        from_neighbours = (
            both.join(labels.select(*k, F.col("u").alias("v"), F.col("c").alias("nc")), [*k, "v"])
            .groupBy(*k, "u").agg(F.min("nc").alias("nc"))
        )
        lower = labels.join(from_neighbours, [*k, "u"]).select(*k, "u", "c", F.least("c", "nc").alias("m"))
        jump = labels.select(*k, F.col("u").alias("m"), F.col("c").alias("jc"))
        # a label always names a node with edges, so the jump finds exactly one row
        step = cut_lineage(lower.join(jump, [*k, "m"]).select(*k, "u", F.least("m", "jc").alias("n"), "c"))
        moved = not step.filter(F.col("n") < F.col("c")).isEmpty()
        labels = step.select(*k, "u", F.col("n").alias("c"))
        if not moved:
            return labels.select(*k, F.col("u").alias("id"), F.col("c").alias("component"))


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), max_group: int = MAX_GROUP_EDGES) -> DataFrame:
    """Smallest node id reachable from every node: (keys, id, component).

    ``edges`` has (keys, u, v) in either direction. Groups of up to ``max_group`` edges are labelled
    in one task each, larger ones and graphs without a group key in rounds. Nodes without edges are
    their own component and stay out of both.
    """
    k = list(keys)
    real = cut_lineage(edges.select(*k, "u", "v").filter(F.col("u") != F.col("v")))
    if not k:
        found = _round_components(real, k)
    else:
        hot = oversized_groups([real], k, max_group)
        if hot is None:
            found = _fold_components(real, k)
        else:
            cold, big = split_by(real, hot, k)
            found = _fold_components(cold, k).unionByName(_round_components(big, k))
    return nodes.select(*k, "id").join(found, [*k, "id"], "left").select(
        *k, "id", F.coalesce("component", "id").alias("component")
    )
