"""Case-level classification metrics and overlap metrics of segmentations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.operators.curves import rank_auroc, running_totals
from boxtally.operators.matching import greedy_match

VOXEL = ("case_id", "z", "y", "x")


def case_scores(dets: DataFrame, gts: DataFrame, cases: DataFrame, target_class: int | None = None) -> DataFrame:
    """Best detection score per case (0 without any) and whether the class is present."""
    d = dets if target_class is None else dets.filter(F.col("label") == target_class)
    g = gts if target_class is None else gts.filter(F.col("label") == target_class)
    best = d.groupBy("case_id").agg(F.max("score").alias("score"))
    has = g.select("case_id").distinct().withColumn("positive", F.lit(True))
    out = cases.select("case_id").join(best, "case_id", "left").join(has, "case_id", "left")
    return out.select("case_id", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score"), F.coalesce("positive", F.lit(False)).alias("positive"))


def average_precision(scored: DataFrame, large: bool = False) -> DataFrame:
    """Σ (recall step × precision) over distinct scores from the top."""
    per = scored.groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    run = running_totals(per, [], [F.desc("score")], {"tp": "p", "seen": "n"}, large)
    return run.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")).alias("ap"))


def case_metrics(scored: DataFrame, threshold: float = 0.5, large: bool = False) -> DataFrame:
    """AUC, AP and the confusion figures at ``score > threshold`` as one row."""
    called, pos = F.col("score") > threshold, F.col("positive")
    c = lambda cond: F.count(F.when(cond, 1))
    counts = scored.agg(c(called & pos).alias("tp"), c(called & ~pos).alias("fp"), c(~called & pos).alias("fn"), c(~called & ~pos).alias("tn"))
    auc = rank_auroc(scored, [], "score", pos, large, "auc")
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    # three one-row aggregates side by side
    return counts.join(F.broadcast(auc)).join(F.broadcast(average_precision(scored, large))).select(
        "auc", "ap", "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
    )


def voxel_counts(pred: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True positives, false positives and false negatives per ``keys`` (which may include ``class``).

    Both sides are (case_id, z, y, x, class) without background; rows meet by a full outer join on
    the voxel.
    """
    j = pred.select(*VOXEL, F.col("class").alias("_p")).join(truth.select(*VOXEL, F.col("class").alias("_t")), list(VOXEL), "full")
    same = F.coalesce(F.col("_p") == F.col("_t"), F.lit(False))
    parts = F.array(
        F.when(same, F.struct(F.col("_p").alias("class"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))),
        F.when(~same & F.col("_p").isNotNull(), F.struct(F.col("_p").alias("class"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))),
        F.when(~same & F.col("_t").isNotNull(), F.struct(F.col("_t").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))),
    )
    rows = j.select(*VOXEL, F.explode(F.filter(parts, lambda r: r.isNotNull())).alias("r")).select("case_id", "r.*")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def _dice():
    return 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))


def dice_global(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Dice per class on counts summed over all cases; classes seen nowhere are absent from the mean."""
    return voxel_counts(pred, truth, ["class"]).select("class", _dice().alias("dice"))


def dice_per_case(pred: DataFrame, truth: DataFrame, cases: DataFrame, classes: Sequence[int], skip_nan: bool = False) -> DataFrame:
    """Mean over cases and classes of the per-case Dice.

    A class without ground truth in a case is NaN, and NaN propagates into the mean unless skipped.
    """
    counts = voxel_counts(pred, truth, ["case_id", "class"])
    frame = cases.select("case_id", F.explode(F.array(*[F.lit(c).cast("long") for c in classes])).alias("class"))
    j = frame.join(counts, ["case_id", "class"], "left")
    has_gt = F.coalesce(F.col("tp") + F.col("fn"), F.lit(0)) > 0
    dice = F.when(has_gt, _dice()) if skip_nan else F.when(has_gt, _dice()).otherwise(F.lit(float("nan")))
    return j.groupBy("class").agg(F.avg(dice).alias("dice"))


def lesion_dice(dets: DataFrame, gts: DataFrame, truth: DataFrame, pred: DataFrame, min_iou: float = 0.1, cell: int = 32) -> DataFrame:
    """Dice of every matched lesion inside its own box; ``truth`` is (voxel, instance), ``pred`` voxels are foreground.

    Voxels reach the boxes through grid cells, so a large case is spread over many tasks.
    """
    taken = greedy_match(dets, gts, min_iou).filter(F.col("gt_id").isNotNull()).select("case_id", "gt_id")
    boxes = gts.join(taken, ["case_id", "gt_id"], "left_semi").select("case_id", "gt_id", "x1", "y1", "z1", "x2", "y2", "z2")
    for a in "xy":
        boxes = boxes.withColumn(f"_g{a}", F.explode(F.sequence(F.floor(F.col(f"{a}1") / cell), F.floor(F.col(f"{a}2") / cell))))
    inside = (
        F.col("x").between(F.col("x1"), F.col("x2") - 1) & F.col("y").between(F.col("y1"), F.col("y2") - 1)
        & F.col("z").between(F.col("z1"), F.col("z2") - 1)
    )
    t = truth.select(*VOXEL, F.col("gt_id").alias("inst"))
    p = pred.select(*VOXEL, F.lit(True).alias("fg"))
    both = t.join(p, list(VOXEL), "full").withColumn("_gx", F.floor(F.col("x") / cell)).withColumn("_gy", F.floor(F.col("y") / cell))
    hit = both.join(boxes, ["case_id", "_gx", "_gy"]).filter(inside)
    own, fg = F.coalesce(F.col("inst") == F.col("gt_id"), F.lit(False)), F.col("fg").isNotNull()
    counts = hit.groupBy("case_id", "gt_id").agg(
        F.count(F.when(own & fg, 1)).alias("both"), F.count(F.when(own, 1)).alias("gt"), F.count(F.when(fg, 1)).alias("pr")
    )
    total = F.col("gt") + F.col("pr")
    out = boxes.select("case_id", "gt_id").distinct().join(counts, ["case_id", "gt_id"], "left").na.fill(0)
    return out.select("case_id", "gt_id", F.when(total > 0, 2 * F.col("both") / total).otherwise(F.lit(1.0)).alias("dice"))


def lesion_dice_summary(match: DataFrame, gts: DataFrame, dice: DataFrame) -> DataFrame:
    """Matched, missed and false-positive counts with the mean lesion Dice, as one row."""
    hits = match.agg(F.count("gt_id").alias("matched"), F.count(F.when(F.col("gt_id").isNull(), 1)).alias("false_positives"))
    n = gts.agg(F.count(F.lit(1)).alias("n"))
    return hits.join(F.broadcast(n)).join(F.broadcast(dice.agg(F.avg("dice").alias("mean_dice")))).select(
        "matched", (F.col("n") - F.col("matched")).alias("missed"), "false_positives", "mean_dice"
    )
