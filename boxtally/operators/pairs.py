"""Box pair joins: the theta joins every matching and suppression operator sits on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions.geometry import BOX_COLUMNS, box, box_center, box_iou, ranges_intersect


def prefixed(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """Prefix every column that is not a key."""
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def _cells(lo: Column, hi: Column, width: float) -> Column:
    first = F.floor(lo / width)
    return F.sequence(first, F.greatest(first, F.floor(hi / width)))


def _on_grid(df: DataFrame, prefix: str, cell: float, axes: Sequence[int], margin: float) -> DataFrame:
    b = box(prefix)
    for i in axes:
        df = df.withColumn(f"_{prefix}first{i}", F.floor((b.lo[i] - margin) / cell))
        df = df.withColumn(f"_cell{i}", F.explode(_cells(b.lo[i] - margin, b.hi[i] + margin, cell)))
    return df


def box_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("case_id",),
    condition: Column | None = None,
    cell: float | None = None,
    axes: Sequence[int] = (0, 1),
    margin: float = 0.0,
    how: str = "inner",
) -> DataFrame:
    """Pairs within a key group whose boxes overlap, columns prefixed ``a_`` and ``b_``.

    Without ``cell`` this is an equi-join on the keys plus the overlap predicate, which keeps the
    result partitioned by the keys: right for groups of bounded size. With ``cell`` the boxes are
    also laid on a grid and joined cell by cell, so one huge group is spread over many tasks and
    only near boxes meet; a pair is reported in the first cell its boxes share. ``margin`` widens
    every box, for predicates that accept boxes a small distance apart.
    """
    overlap = condition if condition is not None else ranges_intersect(box("a_"), box("b_"))
    a, b = prefixed(left, keys, "a_"), prefixed(right, keys, "b_")
    if cell is None:
        on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [overlap]
        joined = a.alias("l").join(b.alias("r"), on, how)
        rest = [c for c in a.columns + b.columns if c not in keys]
        return joined.select(*[F.col(f"l.{k}").alias(k) for k in keys], *rest)
    if how != "inner":
        raise ValueError("grid joins are inner joins")
    a, b = _on_grid(a, "a_", cell, axes, margin), _on_grid(b, "b_", cell, axes, margin)
    cells = [f"_cell{i}" for i in axes]
    joined = a.join(b, [*keys, *cells], "inner").filter(overlap)
    for i in axes:
        joined = joined.filter(F.col(f"_cell{i}") == F.greatest(f"_a_first{i}", f"_b_first{i}"))
    return joined.drop(*cells, *[f"_{p}_first{i}" for p in "ab" for i in axes])


def iou_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("case_id",),
    min_iou: float = 0.0,
    cell: float | None = None,
) -> DataFrame:
    """Overlapping pairs with their ``iou``; ``min_iou`` > 0 keeps pairs at or above it."""
    pairs = box_pairs(left, right, keys, cell=cell).withColumn("iou", box_iou(box("a_"), box("b_")))
    return pairs.filter(F.col("iou") >= min_iou) if min_iou > 0 else pairs.filter(F.col("iou") > 0)


def pairwise_iou_stats(boxes: DataFrame, keys: Sequence[str], id_col: str, cell: float | None = 64.0) -> DataFrame:
    """IoU over all ordered pairs of different boxes of a group, diagonal left out.

    Disjoint pairs have IoU 0, so they enter the mean through the pair count n·(n−1) and are
    never produced as rows.
    """
    # copies of a box count as one box with a multiplicity, so a stack of them yields one pair
    unique = boxes.groupBy(*keys, *BOX_COLUMNS).agg(F.count(F.lit(1)).alias("m"), F.min(id_col).alias("uid"))
    same = F.col("a_uid") == F.col("b_uid")
    times = F.col("a_m") * F.when(same, F.col("b_m") - 1).otherwise(F.col("b_m"))
    near = (
        iou_join(unique, unique, keys, cell=cell)
        .withColumn("times", times)
        .filter(F.col("times") > 0)
        .groupBy(*keys)
        .agg(F.sum(F.col("iou") * F.col("times")).alias("_s"), F.max("iou").alias("_m"), F.sum("times").alias("overlapping_pairs"))
    )
    totals = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_boxes"))
    pairs = F.col("num_boxes") * (F.col("num_boxes") - 1)
    return totals.join(near, list(keys), "left").select(
        *keys,
        "num_boxes",
        pairs.alias("pairs"),
        F.coalesce("overlapping_pairs", F.lit(0)).cast("long").alias("overlapping_pairs"),
        F.when(pairs > 0, F.coalesce("_s", F.lit(0.0)) / pairs).alias("mean_iou"),
        F.when(pairs > 0, F.coalesce("_m", F.lit(0.0))).alias("max_iou"),
    )


def neighbour_count(
    boxes: DataFrame, patch: Sequence[float], keys: Sequence[str] = ("case_id",), id_col: str = "gt_id"
) -> DataFrame:
    """Per box: boxes of its group whose centres lie within half a patch on every axis, itself included.

    The band join runs on a grid as wide as the patch, so each centre is compared with the
    neighbouring cells only.
    """
    dims = range(len(patch))
    centre = [f"c{i}" for i in dims]
    placed = boxes.select(*keys, F.col(id_col), *[c.alias(n) for c, n in zip(box_center(box(dim=len(patch))), centre)])
    # boxes with one centre are counted once and told the same number
    points = placed.groupBy(*keys, *centre).agg(F.count(F.lit(1)).alias("m"))
    points = points.select("*", *[F.floor(F.col(c) / p).alias(f"g{i}") for i, (c, p) in enumerate(zip(centre, patch))])
    grid = [f"g{i}" for i in dims]
    probes = points
    for g in grid:
        probes = probes.withColumn(g, F.explode(F.sequence(F.col(g) - 1, F.col(g) + 1)))
    near = prefixed(probes, [*keys, *grid], "a_").join(prefixed(points, [*keys, *grid], "b_"), [*keys, *grid])
    for i, p in enumerate(patch):
        near = near.filter(F.abs(F.col(f"a_c{i}") - F.col(f"b_c{i}")) <= p / 2.0)
    sums = near.groupBy(*keys, *[F.col(f"a_{c}").alias(c) for c in centre]).agg(F.sum("b_m").alias("neighbours"))
    return placed.join(sums, [*keys, *centre]).select(*keys, id_col, "neighbours")
