"""Many-to-one assignment of candidates to ground truth, and copying of attributes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions.geometry import BOX_COLUMNS, box, box_center, box_iou, center_in_box
from boxtally.operators.curves import union_all
from boxtally.operators.pairs import box_pairs, prefixed
from boxtally.session import cut_lineage

BELOW, BETWEEN = -1, -2


def iou_assign(
    cands: DataFrame, gts: DataFrame, low: float, high: float, best_per_gt: bool = False,
    keys: Sequence[str] = ("case_id",), cell: float = 32.0,
) -> DataFrame:
    """(keys, det_id, gt_id, iou): the ground truth of largest IoU for every candidate.

    Below ``low`` the id is −1, from ``low`` up to ``high`` −2. With ``best_per_gt`` every ground
    truth also claims its best candidate whatever the IoU (the highest id wins a contested one; one
    that overlaps nothing claims the first candidate of its group).
    """
    k = list(keys)
    thin = cands.select(*k, "det_id", *BOX_COLUMNS)
    targets = gts.select(*k, "gt_id", *BOX_COLUMNS)
    # copies of a box share their answer, so only distinct boxes are paired
    place = [*k, *BOX_COLUMNS]
    pairs = box_pairs(
        thin.groupBy(*place).agg(F.min("det_id").alias("det_id")), targets.groupBy(*place).agg(F.min("gt_id").alias("gt_id")), k, cell=cell
    ).withColumn("iou", box_iou(box("a_"), box("b_")))
    mine = [F.col(f"a_{c}").alias(c) for c in BOX_COLUMNS]
    best = pairs.groupBy(*k, *mine).agg(F.max(F.struct("iou", (-F.col("b_gt_id")).alias("o"), F.col("b_gt_id").alias("gt_id"))).alias("m"))
    joined = thin.join(best, place, "left").select(*k, "det_id", "m")
    iou = F.coalesce("m.iou", F.lit(0.0))
    out = joined.select(
        *k, "det_id", F.when(iou < low, BELOW).when(iou < high, BETWEEN).otherwise(F.col("m.gt_id")).alias("gt_id"), iou.alias("iou")
    )
    if not best_per_gt:
        return out
    theirs = [F.col(f"b_{c}").alias(c) for c in BOX_COLUMNS]
    top = pairs.groupBy(*k, *theirs).agg(F.max(F.struct("iou", (-F.col("a_det_id")).alias("o"), F.col("a_det_id").alias("det_id"))).alias("t"))
    first = thin.groupBy(*k).agg(F.min("det_id").alias("first"))
    claims = (
        targets.join(top, place, "left").join(first, k)
        .groupBy(*k, F.coalesce("t.det_id", "first").alias("det_id"))
        .agg(F.max(F.struct("gt_id", F.coalesce("t.iou", F.lit(0.0)).alias("iou"))).alias("c"))
    )
    both = out.join(claims, [*k, "det_id"], "left")
    return both.select(*k, "det_id", F.coalesce("c.gt_id", "gt_id").alias("gt_id"), "iou")


def nearest_k(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, k: int, radius: float,
    coords: Sequence[str] = ("cx", "cy", "cz"),
) -> DataFrame:
    """The ``k`` nearest rows of ``right`` for each row of ``left`` in its group: (keys, ids, dist).

    Works in rings: points meet on a grid of cells twice the radius wide, a row is finished once it
    has ``k`` partners within the radius, and only unfinished rows go on with twice the radius. So
    near partners are found without ever pairing a whole group. Ties go to the lower ``right_id``.
    Coordinates that are not finite are an error.
    """
    ks, cs = list(keys), list(coords)
    a = left.select(*ks, left_id, *[F.col(c).alias(f"l{c}") for c in cs])
    b = right.select(*ks, right_id, *[F.col(c).alias(f"r{c}") for c in cs])
    bounds = left.select(*cs).unionByName(right.select(*cs)).agg(*[f(c) for c in cs for f in (F.min, F.max)]).first()
    reach = 0.0
    if bounds[0] is not None and bounds[1] is not None:
        if not all(math.isfinite(v) for v in bounds if v is not None):
            raise ValueError("a coordinate is not finite")
        reach = sum((bounds[2 * i + 1] - bounds[2 * i]) ** 2 for i in range(len(cs))) ** 0.5
    cells = [f"_g{i}" for i in range(len(cs))]
    parts, open_rows = [], a
    while True:
        last = radius >= reach
        probe, points = open_rows, b
        for g, c in zip(cells, cs):
            # a ball of this radius reaches into at most two cells of twice the radius per axis
            low, high = F.floor((F.col(f"l{c}") - radius) / (2 * radius)), F.floor((F.col(f"l{c}") + radius) / (2 * radius))
            probe = probe.withColumn(g, F.explode(F.sequence(low, high)))
            points = points.withColumn(g, F.floor(F.col(f"r{c}") / (2 * radius)))
        dist = F.sqrt(sum([(F.col(f"l{c}") - F.col(f"r{c}")) ** 2 for c in cs[1:]], (F.col(f"l{cs[0]}") - F.col(f"r{cs[0]}")) ** 2))
        near = probe.join(points, [*ks, *cells]).withColumn("dist", dist).filter(F.col("dist") <= radius)
        near = near.select(*ks, left_id, right_id, "dist")
        if k == 1:
            first = near.groupBy(*ks, left_id).agg(F.min(F.struct("dist", right_id)).alias("m"))
            ranked = first.select(*ks, left_id, f"m.{right_id}", "m.dist", F.lit(1).alias("_n"))
        else:
            order = Window.partitionBy(*ks, left_id).orderBy("dist", right_id)
            ranked = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
        if last:
            parts.append(ranked.drop("_n"))
            break
        ranked = cut_lineage(ranked)
        full = ranked.filter(F.col("_n") == k).select(*ks, left_id)
        parts.append(ranked.join(full, [*ks, left_id], "left_semi").drop("_n"))
        open_rows = cut_lineage(open_rows.join(full, [*ks, left_id], "left_anti"))
        if open_rows.isEmpty():
            break
        radius *= 2
    return union_all(parts)


def adaptive_assign(
    cands: DataFrame, gts: DataFrame, num_candidates: int, per_location: int = 1, level: str = "level",
    keys: Sequence[str] = ("case_id",), eps: float = 0.01, center_in_gt: bool = True, radius: float = 16.0,
) -> DataFrame:
    """Assignment with an IoU threshold per ground truth (mean + sample deviation of its nearest candidates).

    The nearest candidates are taken per level. A candidate claimed by several ground truths goes
    to the one of largest IoU; unclaimed candidates are −1.
    """
    ks = list(keys)
    c = [v.alias(n) for v, n in zip(box_center(box()), ("cx", "cy", "cz"))]
    levels = cands.select(*ks, level).distinct()
    points = gts.select(*ks, "gt_id", *c).join(levels, ks)
    near = nearest_k(points, cands.select(*ks, level, "det_id", *c), [*ks, level], "gt_id", "det_id",
                     num_candidates * per_location, radius)
    g = prefixed(gts.select(*ks, "gt_id", *BOX_COLUMNS), [*ks, "gt_id"], "a_")
    d = prefixed(cands.select(*ks, level, "det_id", *BOX_COLUMNS), [*ks, level, "det_id"], "b_")
    scored = near.join(g, [*ks, "gt_id"]).join(d, [*ks, level, "det_id"]).withColumn("iou", box_iou(box("a_"), box("b_")))
    mine = Window.partitionBy(*ks, "gt_id")
    passed = scored.withColumn("thr", F.avg("iou").over(mine) + F.stddev_samp("iou").over(mine)).filter(F.col("iou") >= F.col("thr"))
    if center_in_gt:
        passed = passed.filter(center_in_box(box("b_"), box("a_"), eps))
    best = passed.groupBy(*ks, "det_id").agg(F.max(F.struct("iou", (-F.col("gt_id")).alias("o"), "gt_id")).alias("m"))
    out = cands.select(*ks, "det_id").join(best, [*ks, "det_id"], "left")
    return out.select(*ks, "det_id", F.coalesce("m.gt_id", F.lit(BELOW)).alias("gt_id"), F.coalesce("m.iou", F.lit(0.0)).alias("iou"))


def assign_attributes(assigned: DataFrame, gts: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Copy class, grade and supervision from the assigned ground truth.

    ``target`` is class + 1 for assigned candidates, 0 for background and −1 for those to discard.
    """
    k = list(keys)
    info = gts.select(*k, "gt_id", F.col("label").alias("_label"), F.col("grade").alias("_grade"), F.col("supervised").alias("_sup"))
    j = assigned.join(info, [*k, "gt_id"], "left")
    hit = F.col("gt_id") >= 0
    return j.select(
        *k, "det_id", F.when(hit, F.col("gt_id")).alias("gt_id"),
        F.when(hit, F.col("_label") + 1).when(F.col("gt_id") == BELOW, 0).otherwise(-1).cast("long").alias("target"),
        F.when(hit & F.col("_sup"), F.col("_grade")).alias("grade"),
        F.coalesce(hit & F.col("_sup"), F.lit(False)).alias("supervised"),
        F.when(hit, F.col("iou")).otherwise(F.lit(0.0)).alias("iou"),
    )
