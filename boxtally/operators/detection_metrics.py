"""Detection metrics over match tables: average precision, FROC, histograms, overviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions.geometry import box, box_iou, box_size
from boxtally.operators.curves import (
    interp_at, interp_first_crossing, running_totals, tie_grouped_curve, top_k, union_all, value_at_budget,
)
from boxtally.operators.matching import sequential_match
from boxtally.operators.pairs import box_pairs

GRADES = (2, 3, 4, 5)


def gt_support(gts: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Number of regular (not ignored) ground-truth boxes per key."""
    return gts.filter(~F.col("ignore")).groupBy(*keys).agg(F.count(F.lit(1)).alias("num_gt"))


def coco_ap(
    events: DataFrame, gts: DataFrame, thresholds: Sequence[float], max_detections: Sequence[int] = (1, 10, 100),
    steps: int = 100, large: bool = False,
) -> DataFrame:
    """Precision and score at ``steps`` + 1 recall levels, per threshold, class and detection cap.

    The interpolated precision at a recall level is the largest precision of any point at or
    beyond it. So after the running sums a point is filed under the highest level it reaches, the
    points shrink to one row per level, and the running maximum runs over those few rows only.
    Levels compare integers (``tp * steps >= level * num_gt``) and are free of rounding.
    """
    caps = F.explode(F.array(*[F.lit(m) for m in max_detections])).alias("max_det")
    counted = (
        events.filter(~F.col("ignored"))
        .select("label", "iou_thr", "score", "case_id", "rank", F.col("matched").cast("long").alias("tp1"), caps)
        .filter(F.col("rank") <= F.col("max_det"))
        .withColumn("fp1", 1 - F.col("tp1"))
    )
    keys = ["label", "iou_thr", "max_det"]
    order = [F.desc("score"), F.asc("case_id"), F.asc("rank")]
    sums = running_totals(counted, keys, order, {"tp": "tp1", "fp": "fp1"}, large)
    support = gt_support(gts)
    points = sums.join(support, "label").select(
        *keys, "score", "num_gt", "tp",
        F.floor(F.col("tp") * steps / F.col("num_gt")).alias("guess"),
        (F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(2.220446049250313e-16))).alias("pr"),
    )
    fits = lambda lvl: F.col("tp") * steps >= lvl * F.col("num_gt")
    level = F.when(fits(F.col("guess") + 1), F.col("guess") + 1).when(fits(F.col("guess")), F.col("guess")).otherwise(F.col("guess") - 1)
    best = points.withColumn("level", level).groupBy(*keys, "level").agg(F.max("pr").alias("pr"), F.max("score").alias("s"))
    # every class with support gets a full curve, whether or not anything was detected
    frame = (
        support.select("label", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("iou_thr"))
        .select("label", "iou_thr", caps)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("level"))
        .withColumn("level", F.col("level").cast("long"))
    )
    tail = Window.partitionBy(*keys).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    filled = frame.join(best, [*keys, "level"], "left")
    return filled.select(
        *keys, "level",
        F.coalesce(F.max("pr").over(tail), F.lit(0.0)).alias("precision"),
        F.coalesce(F.max("s").over(tail), F.lit(0.0)).alias("score"),
    )


def thresholds_of(events: DataFrame, thresholds: Sequence[float] | None) -> DataFrame:
    """The given thresholds as rows; those that occur in the events when none are given."""
    if thresholds is None:
        return events.select("iou_thr").distinct()
    one = events.sparkSession.range(1)
    return one.select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("iou_thr"))


def coco_recall(events: DataFrame, gts: DataFrame, max_detections: int = 100, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Overall recall per threshold and class with support; 0 where nothing was detected."""
    hits = events.filter(~F.col("ignored") & (F.col("rank") <= max_detections)).groupBy("label", "iou_thr").agg(
        F.sum(F.col("matched").cast("long")).alias("tp")
    )
    frame = gt_support(gts).join(F.broadcast(thresholds_of(events, thresholds)))
    recall = F.coalesce("tp", F.lit(0)) / F.col("num_gt")
    return frame.join(hits, ["label", "iou_thr"], "left").select("label", "iou_thr", recall.alias("recall"))


def map_range(curves: DataFrame, classes: Sequence[int], keep_absent: bool = True) -> DataFrame:
    """Mean precision over thresholds, recall levels and classes.

    Classes without support keep −1 in the mean unless ``keep_absent`` is false.
    """
    cells = curves.select("iou_thr", "level").distinct()
    frame = cells.select("iou_thr", "level", F.explode(F.array(*[F.lit(c).cast("long") for c in classes])).alias("label"))
    full = frame.join(curves.select("iou_thr", "level", "label", "precision"), ["iou_thr", "level", "label"], "left")
    value = F.coalesce("precision", F.lit(-1.0)) if keep_absent else F.col("precision")
    return full.agg(F.avg(value).alias("map"))


def froc(
    events: DataFrame, gts: DataFrame, num_images: int | Column, fpi: Sequence[float] = (0.125, 0.25, 0.5, 1, 2, 4, 8),
    per_class: bool = False, large: bool = False, thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Sensitivity at false positives per image, interpolated on the tie-grouped curve.

    ``num_images`` counts all images. Without supported ground truth the value is 0, and so it is for
    a threshold, or a class with support, that has no detections.
    """
    images = F.lit(num_images) if isinstance(num_images, int) else num_images
    by = ["label"] if per_class else []
    keys = ["iou_thr", *by]
    flags = events.filter(~F.col("ignored")).select(
        *keys, "score", F.col("matched").cast("long").alias("tp"), (~F.col("matched")).cast("long").alias("fp")
    )
    curve = tie_grouped_curve(flags, keys, ["tp", "fp"], large=large)
    if per_class:
        support = gt_support(gts, by)
        joined = curve.join(support, by, "left")
    else:
        support = gts.agg(F.count(F.when(~F.col("ignore"), 1)).alias("num_gt"))
        joined = curve.join(F.broadcast(support))  # one row
    sens = F.when(F.col("num_gt") > 0, F.col("tp") / F.col("num_gt")).otherwise(F.lit(0.0))
    read = interp_at(joined, keys, F.col("fp") / images, sens, list(fpi))
    frame = F.broadcast(thresholds_of(events, thresholds))
    frame = gt_support(gts, by).select(*by).join(frame).select(*keys) if per_class else frame
    silent = frame.join(curve.select(*keys).distinct(), keys, "left_anti")
    targets = F.explode(F.array(*[F.lit(float(t)) for t in fpi])).alias("target")
    return read.unionByName(silent.select(*keys, targets, F.lit(0.0).alias("value")))


def froc_score(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    return readings.groupBy(*keys).agg(F.avg("value").alias("froc_score"))


def grade_froc_events(dets: DataFrame, gts: DataFrame, min_iou: float = 0.5, probs: Sequence[str] = ("p2", "p3", "p4", "p5")) -> DataFrame:
    """Candidate events of the generic and the four grade-specific analyses.

    Generic: all ground truth takes part; a match with an unsupervised lesion is neither true nor
    false. Grade-specific: score times the grade's probability against supervised lesions of that
    grade only. The five matchings run as one job with the analysis as a further key.
    """
    scored = F.array(
        F.struct(F.lit(0).cast("long").alias("analysis"), F.col("score").alias("s")),
        *[F.struct(F.lit(g).cast("long").alias("analysis"), (F.col("score") * F.col(p)).alias("s")) for g, p in zip(GRADES, probs)],
    )
    candidates = dets.withColumn("a", F.explode(scored)).select(
        "case_id", "patient_id", "det_id", "x1", "y1", "x2", "y2", "z1", "z2", "a.analysis", F.col("a.s").alias("score")
    )
    roles = F.array(F.lit(0).cast("long"), F.when(F.col("supervised"), F.col("grade")))
    targets = gts.withColumn("analysis", F.explode(F.filter(roles, lambda r: r.isNotNull())))
    match = sequential_match(
        candidates, targets, ("case_id", "analysis"), (min_iou,), det_cols=["patient_id"], gt_cols=["grade", "supervised"]
    )
    hit = F.col("gt_id").isNotNull()
    return match.select(
        "analysis", "case_id", "patient_id", "det_id", "score",
        F.when(hit & F.col("supervised"), F.col("grade")).alias("grade"),
        (hit & F.col("supervised")).alias("tp"), (~hit).alias("fp"),
    )


def grade_support(gts: DataFrame) -> DataFrame:
    """Supervised lesions of each grade 2..5 as one row, zeros included."""
    return gts.agg(*[F.count(F.when(F.col("supervised") & (F.col("grade") == g), 1)).alias(f"n{g}") for g in GRADES])


def harmonized_froc(
    events: DataFrame, support: DataFrame, patients: DataFrame, targets: Sequence[float] = (0.5, 1.0), large: bool = False
) -> DataFrame:
    """Sensitivity of each grade at false positives per patient, for both analyses.

    ``support`` and ``patients`` are one-row aggregates (n2..n5, num_patients). Every analysis, grade
    and target has a row; without events the sensitivity is 0 where there is support.
    """
    tps = [f"tp{g}" for g in GRADES]
    flags = events.select(
        "analysis", "score", F.col("fp").cast("long").alias("fp"),
        *[(F.col("tp") & (F.col("grade") == g)).cast("long").alias(f"tp{g}") for g in GRADES],
    ).na.fill(0)
    curve = tie_grouped_curve(flags, ["analysis"], ["fp", *tps], large=large)
    curve = curve.join(F.broadcast(support)).join(F.broadcast(patients))
    x = F.try_divide(F.col("fp"), F.col("num_patients"))
    sens = {str(g): F.try_divide(F.col(f"tp{g}"), F.col(f"n{g}")) for g in GRADES}
    counts = [f"n{g}" for g in GRADES]
    read = value_at_budget(curve, ["analysis", *counts, "num_patients"], x, sens, targets)
    grade = F.col("series").cast("long")
    read = read.filter((F.col("analysis") == 0) | (F.col("analysis") == grade)).select("analysis", grade.alias("grade"), "target", "value")
    support_of = F.create_map(*[v for g in GRADES for v in (F.lit(g).cast("long"), F.col(f"n{g}"))])[F.col("grade")]
    cells = F.array(*[
        F.struct(F.lit(a).cast("long").alias("analysis"), F.lit(g).cast("long").alias("grade"), F.lit(float(t)).alias("target"))
        for g in GRADES for a in (0, g) for t in targets
    ])
    frame = support.join(F.broadcast(patients)).withColumn("c", F.explode(cells)).select(*counts, "num_patients", "c.*")
    return frame.join(read, ["analysis", "grade", "target"], "left").select(
        F.when(F.col("analysis") == 0, "generic").otherwise("grade_specific").alias("analysis"), "grade", "target",
        F.when(support_of > 0, F.coalesce("value", F.lit(0.0))).alias("sensitivity"), support_of.alias("support"), "num_patients",
    )


def pool_fold_events(events: Sequence[DataFrame], supports: Sequence[DataFrame], patients: Sequence[DataFrame]):
    """Union of fold events, summed support, distinct union of patients: inputs of the finish step."""
    support = union_all(list(supports)).agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in GRADES])
    people = union_all(list(patients)).agg(F.countDistinct("patient_id").alias("num_patients"))
    return union_all(list(events)), support, people


def prediction_histogram(
    events: DataFrame, gts: DataFrame, bins: int = 50, per_class: bool = False, thresholds: Sequence[float] | None = None
) -> DataFrame:
    """Score histogram of true and false positives per threshold on ``[0, 1]``.

    Missed ground truth, of undetected classes too, enters as true positives at score 0. Scores outside the range are left out.
    """
    by = ["label"] if per_class else []
    keys = ["iou_thr", *by]
    kept = events.filter(~F.col("ignored"))
    slot = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    hist = kept.filter(F.col("score").between(0, 1)).groupBy(*keys, "matched", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    found = kept.groupBy(*keys).agg(F.sum(F.col("matched").cast("long")).alias("tp"))
    support = gt_support(gts, by) if per_class else gts.agg(F.count(F.when(~F.col("ignore"), 1)).alias("num_gt"))
    frame = support.join(F.broadcast(thresholds_of(events, thresholds)))
    missed = frame.join(found, keys, "left").select(
        *keys, F.lit(True).alias("matched"), F.lit(0).cast("long").alias("bin"), (F.col("num_gt") - F.coalesce("tp", F.lit(0))).alias("n")
    )
    return hist.unionByName(missed).groupBy(*keys, "matched", "bin").agg(F.sum("n").alias("n")).filter("n > 0")


def _percent_level(score: Column) -> Column:
    """Largest whole percent not above the score, exact against ``i / 100``."""
    guess = F.floor(score * 100)
    return F.when((guess + 1) / 100.0 <= score, guess + 1).when(guess / 100.0 > score, guess - 1).otherwise(guess)


def threshold_froc(
    dets: DataFrame, gts: DataFrame, groups: dict[str, Column], min_iou: float = 0.1, min_score: float = 0.2
) -> DataFrame:
    """False positives per patient and sensitivity at score thresholds 0.01 .. 0.99, per lesion group.

    Detections arrive best first, so what is matched at a threshold is a prefix of one first-fit
    run: the matching is done once and counted by threshold. Cases without a target of the group
    add no events; cases without a detection of at least ``min_score`` leave the cohort.
    """
    kept = dets.filter(F.col("score") >= min_score)
    cohort = kept.select("case_id").distinct()
    members = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]), lambda v: v.isNotNull())
    targets = gts.join(cohort, "case_id", "left_semi").withColumn("type", F.explode(members))
    wanted = targets.select("case_id", "type").distinct()
    ordered = kept.join(wanted, "case_id")
    match = sequential_match(ordered, targets, ("case_id", "type"), (min_iou,), preference="first", order="score")
    level = F.least(_percent_level(F.col("score")), F.lit(99)).cast("long")
    binned = match.groupBy("type", level.alias("level")).agg(
        F.count("gt_id").alias("tp1"), F.count(F.when(F.col("gt_id").isNull(), 1)).alias("fp1")
    )
    support = targets.groupBy("type").agg(F.count(F.lit(1)).alias("num_gt"))
    frame = support.select("type", "num_gt", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("level"))
    frame = frame.withColumn("level", F.col("level").cast("long"))
    down = Window.partitionBy("type").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    filled = frame.join(binned, ["type", "level"], "left").na.fill(0, ["tp1", "fp1"])
    n = cohort.agg(F.count(F.lit(1)).alias("num_patients"))
    counted = filled.select("type", "level", "num_gt", F.sum("tp1").over(down).alias("tp"), F.sum("fp1").over(down).alias("fp"))
    return counted.join(F.broadcast(n)).select(
        "type", "level", (F.col("fp") / F.col("num_patients")).alias("fp_per_patient"),
        (F.col("tp") / F.col("num_gt")).alias("sensitivity"),
    )


def fp_at_sensitivity(curve: DataFrame, targets: Sequence[float] = (0.6, 0.8, 0.9)) -> DataFrame:
    """False positives per patient where each group's sensitivity first reaches the targets."""
    parts = [
        interp_first_crossing(curve, ["type"], "sensitivity", "fp_per_patient", t, "fp_per_patient")
        .withColumn("target", F.lit(float(t)))
        for t in targets
    ]
    return union_all(parts)


def best_overlap(dets: DataFrame, gts: DataFrame, keys: Sequence[str] = ("case_id",), cell: float | None = 32.0) -> DataFrame:
    """Each detection's ground truth of largest IoU (lowest id on ties), null when nothing overlaps."""
    thin = dets.select(*keys, "det_id", "x1", "y1", "x2", "y2", "z1", "z2")
    # of identical ground truth only the lowest id can be the answer
    gt = gts.groupBy(*keys, "x1", "y1", "x2", "y2", "z1", "z2").agg(
        F.min("gt_id").alias("gt_id"), F.min_by("label", "gt_id").alias("target")
    )
    pairs = box_pairs(thin, gt, keys, cell=cell).withColumn("iou", box_iou(box("a_"), box("b_")))
    best = pairs.groupBy(*keys, F.col("a_det_id").alias("det_id")).agg(
        F.max_by(F.struct(F.col("b_gt_id").alias("gt_id"), F.col("b_target").alias("target"), "iou"),
                 F.struct("iou", -F.col("b_gt_id"))).alias("m")
    )
    return best.select(*keys, "det_id", "m.*")


def argmax_overlap_label(dets: DataFrame, gts: DataFrame, min_iou: float, cell: float | None = 32.0) -> DataFrame:
    """Every detection with the label of its best ground truth, −1 below ``min_iou``."""
    best = best_overlap(dets, gts, cell=cell).filter(F.col("iou") >= min_iou)
    return dets.select("case_id", "det_id", "label", "score").join(best, ["case_id", "det_id"], "left").select(
        "case_id", "det_id", "label", "score", "gt_id",
        F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("iou", F.lit(0.0)).alias("iou"),
    )


def missed_gt(dets: DataFrame, gts: DataFrame, min_iou: float, cell: float | None = 32.0) -> DataFrame:
    """Ground truth that no detection reaches with at least ``min_iou``."""
    thin = gts.select("case_id", "gt_id", "x1", "y1", "x2", "y2", "z1", "z2")
    boxes = dets.select("case_id", "x1", "y1", "x2", "y2", "z1", "z2").distinct()
    near = box_pairs(thin, boxes, ("case_id",), cell=cell).filter(box_iou(box("a_"), box("b_")) >= min_iou)
    return gts.join(near.select("case_id", F.col("a_gt_id").alias("gt_id")), ["case_id", "gt_id"], "left_anti")


def confusion_with_background(dets: DataFrame, gts: DataFrame, min_iou: float, min_score: float, true_class: bool = False) -> DataFrame:
    """Counts of (prediction, target), −1 standing for background.

    Missed boxes of cases that have detections are filed under class 0 unless ``true_class``.
    """
    kept = dets.filter(F.col("score") > min_score)
    pairs = argmax_overlap_label(kept, gts, min_iou).select(F.col("label").alias("pred"), "target")
    missed = missed_gt(kept, gts, min_iou)
    seen = kept.select("case_id").distinct().withColumn("seen", F.lit(True))
    filed = F.col("label") if true_class else F.when(F.col("seen"), F.lit(0)).otherwise(F.col("label"))
    lost = missed.join(seen, "case_id", "left").select(F.lit(-1).cast("long").alias("pred"), filed.cast("long").alias("target"))
    return pairs.unionByName(lost).groupBy("pred", "target").agg(F.count(F.lit(1)).alias("n"))


def case_overview(dets: DataFrame, gts: DataFrame, cases: DataFrame, min_iou: float, min_score: float, max_fp: int = 5) -> DataFrame:
    """Per case: counts, best and least confident true positives, top false positives, misses."""
    kept = dets.filter(F.col("score") > min_score)
    num = gts.groupBy("case_id").agg(F.count(F.lit(1)).alias("num_gt"))
    label = argmax_overlap_label(kept, gts, min_iou)
    with_gt = F.col("target") == F.col("label")
    kind = (
        F.when(with_gt & (F.col("score") > 0.5), "tp_high").when(with_gt & (F.col("score") < 0.5), "tp_low")
        .when(~with_gt & (F.col("target") == -1), "fp_iou").when(~with_gt, "fp_cls").otherwise("tp_mid")
    )
    tagged = label.withColumn("kind", kind)
    totals = tagged.groupBy("case_id").agg(F.count(F.when(with_gt, 1)).alias("iou_tp"))
    side = F.when(F.col("kind").startswith("fp"), "fp").otherwise(F.col("kind"))
    order = F.when(F.col("kind") == "tp_low", F.col("score")).otherwise(-F.col("score"))
    ranked = top_k(tagged.withColumn("side", side), ["case_id", "side"], [order.asc(), F.asc("det_id")], max_fp)
    entry = F.struct("rank", "det_id", "score", "kind")

    def listed(name: str, k: int) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("side") == name) & (F.col("rank") <= k), entry))).alias(name)

    lists = ranked.groupBy("case_id").agg(listed("tp_high", 3), listed("tp_low", 3), listed("fp", max_fp))
    lost = missed_gt(kept, gts, min_iou).groupBy("case_id").agg(F.count(F.lit(1)).alias("num_fn"))
    out = cases.select("case_id").join(num, "case_id", "left").join(totals, "case_id", "left")
    return out.join(lists, "case_id", "left").join(lost, "case_id", "left").na.fill(0, ["num_gt", "iou_tp", "num_fn"])


def box_sizes_by_outcome(dets: DataFrame, gts: DataFrame, min_iou: float, min_score: float) -> DataFrame:
    """Sum of sides of true positives, false positives and misses, counted per whole size."""
    kept = dets.filter(F.col("score") > min_score)
    label = argmax_overlap_label(kept, gts, min_iou).select("case_id", "det_id", "target")
    sides = box_size(box())
    total = sum(sides[1:], sides[0])
    found = kept.join(label, ["case_id", "det_id"]).select(
        F.when(F.col("target") == F.col("label"), "tp").otherwise("fp").alias("outcome"), F.floor(total).alias("size")
    )
    lost = missed_gt(kept, gts, min_iou).select(F.lit("fn").alias("outcome"), F.floor(total).alias("size"))
    return found.unionByName(lost).groupBy("outcome", "size").agg(F.count(F.lit(1)).alias("n"))


