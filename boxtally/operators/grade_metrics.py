"""Ordinal grade metrics: matches, confusion, kappa, AUROC, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.functions.values import argmax_grade
from boxtally.operators.curves import rank_auroc, union_all
from boxtally.operators.matching import greedy_match, unmatched_gt

GRADES = (2, 3, 4, 5)
PROBS = ("p2", "p3", "p4", "p5")


def match_rows(dets: DataFrame, gts: DataFrame, min_iou: float = 0.1, min_score: float = 0.0, det_cols: Sequence[str] = PROBS) -> DataFrame:
    """Greedy matches of the detections at or above ``min_score``, with the grade of the lesion taken."""
    kept = dets.filter(F.col("score") >= min_score)
    return greedy_match(kept, gts, min_iou, det_cols=list(det_cols), gt_cols=["grade", "supervised"])


def grade_matches(dets: DataFrame, gts: DataFrame, cases: DataFrame, min_iou: float = 0.1, min_score: float = 0.0) -> DataFrame:
    """Per case: supervised matches, unsupervised matches, false positives and supervised misses."""
    rows = match_rows(dets, gts, min_iou, min_score, ())
    hit = F.col("gt_id").isNotNull()
    per_case = rows.groupBy("case_id").agg(
        F.count(F.when(hit & F.col("supervised"), 1)).alias("matched"),
        F.count(F.when(hit & ~F.col("supervised"), 1)).alias("matched_unsupervised"),
        F.count(F.when(~hit, 1)).alias("false_positives"),
    )
    missed = unmatched_gt(rows, gts.filter("supervised")).groupBy("case_id").agg(F.count(F.lit(1)).alias("misses"))
    out = cases.select("case_id").join(per_case, "case_id", "left").join(missed, "case_id", "left")
    return out.na.fill(0)


def graded_pairs(rows: DataFrame) -> DataFrame:
    """True and predicted grade of every supervised match."""
    hit = rows.filter(F.col("gt_id").isNotNull() & F.col("supervised"))
    return hit.withColumn("predicted", argmax_grade(F.array(*PROBS))).withColumnRenamed("grade", "true")


def confusion(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Dense 4×4 counts (keys, true, predicted, n)."""
    seen = pairs.groupBy(*keys, "true", "predicted").agg(F.count(F.lit(1)).alias("n"))
    values = F.array(*[F.lit(g).cast("long") for g in GRADES])
    base = pairs.select(*keys).distinct() if keys else pairs.sparkSession.range(1).select()
    frame = base.select(*keys, F.explode(values).alias("true")).select("*", F.explode(values).alias("predicted"))
    return frame.join(seen, [*keys, "true", "predicted"], "left").na.fill(0, ["n"])


def grade_summary(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-grade precision, recall, F1 and the summary figures of a confusion matrix.

    Works on the 16 cells per key, so it costs nothing next to counting them.
    """
    keys = list(keys)
    s = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    t, p = F.col("true"), F.col("predicted")
    dist = F.abs(t - p)
    per = matrix.groupBy(*keys).agg(
        *[s((t == g) & (p == g)).alias(f"tp{g}") for g in GRADES],
        *[s(t == g).alias(f"support{g}") for g in GRADES],
        *[s(p == g).alias(f"called{g}") for g in GRADES],
        F.sum("n").alias("total"),
        F.sum(F.col("n") * dist).alias("abs_error"),
        s(dist <= 1).alias("near"),
        F.sum(F.col("n") * dist * dist).alias("sq_error"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    for g in GRADES:
        tp, sup, called = F.col(f"tp{g}"), F.col(f"support{g}"), F.col(f"called{g}")
        per = per.withColumn(f"precision{g}", ratio(tp, called)).withColumn(f"recall{g}", ratio(tp, sup))
        pr, rc = F.col(f"precision{g}"), F.col(f"recall{g}")
        per = per.withColumn(f"f1_{g}", F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0)))
    total = F.col("total")
    present = sum([(F.col(f"support{g}") > 0).cast("long") for g in GRADES[1:]], (F.col("support2") > 0).cast("long"))
    over = lambda f: sum([F.when(F.col(f"support{g}") > 0, F.col(f(g))).otherwise(0.0) for g in GRADES], F.lit(0.0))
    hits = sum([F.col(f"tp{g}") for g in GRADES[1:]], F.col("tp2"))
    expected = sum(
        [F.lit(float((a - b) ** 2)) * F.col(f"support{a}") * F.col(f"called{b}") for a in GRADES for b in GRADES], F.lit(0.0)
    ) / total
    return per.select(
        *keys, "total",
        *[c for g in GRADES for c in (f"precision{g}", f"recall{g}", f"f1_{g}", f"support{g}")],
        F.when(total > 0, hits / total).alias("accuracy"),
        F.when(total > 0, F.col("abs_error") / total).alias("mae"),
        F.when(total > 0, F.col("near") / total).alias("adjacent_accuracy"),
        F.when(present > 0, over(lambda g: f"f1_{g}") / present).alias("macro_f1"),
        F.when(present > 0, over(lambda g: f"recall{g}") / present).alias("balanced_accuracy"),
        F.when(total > 0, sum([F.col(f"f1_{g}") * F.col(f"support{g}") for g in GRADES], F.lit(0.0)) / total).alias("weighted_f1"),
        F.when((total > 0) & (expected > 0), F.lit(1.0) - F.col("sq_error") / expected).alias("quadratic_kappa"),
    )


def grade_auroc(pairs: DataFrame, keys: Sequence[str] = (), large: bool = False) -> DataFrame:
    """One-vs-rest AUROC per grade and their mean over the defined ones (grade 0)."""
    entries = F.explode(F.array(*[
        F.struct(F.lit(g).cast("long").alias("grade"), F.col(p).alias("p")) for g, p in zip(GRADES, PROBS)
    ])).alias("e")
    long = pairs.select(*keys, "true", entries).select(*keys, "true", "e.grade", "e.p")
    per = rank_auroc(long, [*keys, "grade"], "p", F.col("true") == F.col("grade"), large)
    mean = per.groupBy(*keys).agg(F.avg("auroc").alias("auroc")).select(*keys, F.lit(0).cast("long").alias("grade"), "auroc")
    return union_all([per, mean])


def calibration(pairs: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Brier score, NLL, ECE over equal bins (last one closed) and mean confidences."""
    return calibration_summary(calibration_bins(pairs, keys, bins), keys)


def calibration_bins(pairs: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Sums per confidence bin: all that :func:`calibration_summary` needs; sums of parts may be added up."""
    probs = F.array(*PROBS)
    own = F.get(probs, (F.col("true") - 2).cast("int"))
    brier = F.aggregate(probs, F.lit(0.0), lambda a, v: a + v * v) - 2 * own + 1
    conf = F.array_max(probs)
    rows = pairs.select(
        *keys, brier.alias("brier"), (-F.log(F.greatest(own, F.lit(1e-7)))).alias("nll"), conf.alias("conf"),
        (F.col("true") == F.col("predicted")).alias("right"),
    ).withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)))
    return rows.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("brier").alias("brier"), F.sum("nll").alias("nll"), F.sum("conf").alias("conf"),
        F.sum(F.col("right").cast("long")).alias("right"), F.sum(F.when(F.col("right"), F.col("conf"))).alias("conf_right"),
    )


def calibration_summary(per_bin: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    total = F.sum("n")
    return per_bin.groupBy(*keys).agg(
        total.alias("n"), (F.sum("brier") / total).alias("brier"), (F.sum("nll") / total).alias("nll"),
        (F.sum(F.abs(F.col("right") - F.col("conf"))) / total).alias("ece"),
        (F.sum("conf") / total).alias("mean_confidence"),
        F.when(F.sum("right") > 0, F.sum("conf_right") / F.sum("right")).alias("mean_confidence_correct"),
        F.when(total > F.sum("right"), (F.sum("conf") - F.coalesce(F.sum("conf_right"), F.lit(0.0))) / (total - F.sum("right"))).alias("mean_confidence_incorrect"),
    )
