"""Class weights, dataset properties and planning statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.functions.geometry import box, box_size
from boxtally.operators.order_stats import column_quantiles, with_quantiles

GRADES = (2, 3, 4, 5)


def _dense(counts: DataFrame, key: str, values: Sequence[int]) -> DataFrame:
    spark = counts.sparkSession
    frame = spark.range(1).select(F.explode(F.array(*[F.lit(v).cast("long") for v in values])).alias(key))
    return frame.join(counts, key, "left").na.fill(0, ["n"])


def grade_class_weights(instances: DataFrame, require_all: bool = True) -> DataFrame:
    """Inverse-frequency weights of the supervised grades with mean one."""
    counts = instances.filter("supervised").groupBy("grade").agg(F.count(F.lit(1)).alias("n"))
    dense = _dense(counts, "grade", GRADES)
    if require_all:
        missing = F.raise_error(F.concat(F.lit("no supervised lesions of grade "), F.col("grade").cast("string"))).cast("double")
        inverse = F.when(F.col("n") == 0, missing).otherwise(F.lit(1.0) / F.col("n"))
    else:
        inverse = F.when(F.col("n") > 0, F.lit(1.0) / F.col("n"))
    every = Window.partitionBy(F.lit(0))  # four rows
    return dense.withColumn("_i", inverse).select("grade", "n", (F.col("_i") / F.avg("_i").over(every)).alias("weight"))


def class_weights_with_background(instances: DataFrame, num_classes: int) -> DataFrame:
    """Background 1/(C+1); classes share the rest by (1 − n/Σn). Class ids are shifted by one."""
    counts = instances.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    dense = _dense(counts, "label", range(num_classes))
    bg = 1.0 / (num_classes + 1)
    every = Window.partitionBy(F.lit(0))  # one row per class
    fg = dense.select(
        (F.col("label") + 1).alias("label"), (F.lit(1 - bg) * (1 - F.col("n") / F.sum("n").over(every))).alias("weight")
    )
    back = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("label"), F.lit(bg).alias("weight"))
    return fg.unionByName(back)


def telemetry_totals(rows: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Summed counters with the supervised share; counters that do not reconcile are an error."""
    total = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("positive", "supervised", "unsupervised", *classes)])
    by_class = sum([F.col(c) for c in classes[1:]], F.col(classes[0]))
    ok = (F.col("supervised") + F.col("unsupervised") == F.col("positive")) & (by_class == F.col("supervised"))
    share = F.when(F.col("positive") > 0, F.col("supervised") / F.col("positive")).otherwise(F.lit(0.0))
    return total.withColumn("supervised_share", F.when(ok, share).otherwise(F.raise_error(F.lit("counters do not reconcile")).cast("double")))


def weighted_mean(value: str, weight: str) -> Column:
    """Σ v·w / Σ w, infinite when the weights sum to zero."""
    w = F.sum(weight)
    return F.when(w == 0, F.lit(float("inf"))).otherwise(F.sum(F.col(value) * F.col(weight)) / w)


def instance_counts(instances: DataFrame) -> DataFrame:
    """Instances per class for every case, per case, per class and overall (nulls mark totals)."""
    return instances.cube("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def instances_per_case_histogram(instances: DataFrame, cases: DataFrame) -> DataFrame:
    per = cases.select("case_id").join(instances.groupBy("case_id").agg(F.count(F.lit(1)).alias("instances")), "case_id", "left")
    return per.na.fill(0).groupBy("instances").agg(F.count(F.lit(1)).alias("cases"))


def spacing_plan(cases: DataFrame, spacing: Sequence[str], size: Sequence[str], percentile: float = 0.5, ratio: float = 3.0) -> DataFrame:
    """Target spacing: the percentile per axis, lowered for one anisotropic axis.

    An axis whose spacing exceeds ``ratio`` times the smallest other and whose size times
    ``ratio`` stays below the smallest other size takes its 10th percentile, but not below the
    smallest other spacing.
    """
    agg = column_quantiles(cases, {
        **{f"s{i}": (F.col(c), percentile) for i, c in enumerate(spacing)},
        **{f"n{i}": (F.col(c), percentile) for i, c in enumerate(size)},
        **{f"low{i}": (F.col(c), 0.1) for i, c in enumerate(spacing)},
    })
    dims = range(len(spacing))
    worst = F.greatest(*[F.col(f"s{i}") for i in dims])
    out, earlier = [], F.lit(False)
    for i in dims:
        others = [j for j in dims if j != i]
        min_s = F.least(*[F.col(f"s{j}") for j in others])
        min_n = F.least(*[F.col(f"n{j}") for j in others])
        is_worst = (F.col(f"s{i}") == worst) & ~earlier
        coarse = is_worst & (F.col(f"s{i}") > ratio * min_s) & (F.col(f"n{i}") * ratio < min_n)
        low = F.when(F.col(f"low{i}") < min_s, min_s + 1e-5).otherwise(F.col(f"low{i}"))
        out.append(F.when(coarse, low).otherwise(F.col(f"s{i}")).alias(f"target_{i}"))
        earlier = earlier | (F.col(f"s{i}") == worst)
    return agg.select(*out)


def shape_stats(cases: DataFrame, spacing: Sequence[str], size: Sequence[str], target: Sequence[float]) -> DataFrame:
    """Median, minimum and maximum of the resampled size per axis."""
    shape = [F.col(n) * F.col(s) / F.lit(t) for n, s, t in zip(size, spacing, target)]
    rows = cases.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("axis"), v.alias("v")) for i, v in enumerate(shape)])).alias("e"))
    rows = rows.select("e.*")
    ends = rows.groupBy("axis").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return with_quantiles(ends, rows, ["axis"], "v", {"median": 0.5}).select("axis", "median", "min", "max")


def large_object_trigger(boxes: DataFrame, patch: Sequence[float], percentile: float = 0.995) -> DataFrame:
    """Size percentile per axis and whether any exceeds the patch."""
    agg = column_quantiles(boxes, {f"size_{i}": (s, percentile) for i, s in enumerate(box_size(box(dim=len(patch))))})
    over = [F.col(f"size_{i}") > F.lit(float(p)) for i, p in enumerate(patch)]
    cond = over[0]
    for o in over[1:]:
        cond = cond | o
    return agg.withColumn("triggered", cond)


def percentile_trim(boxes: DataFrame, low: float = 0.005, high: float = 0.995, dim: int = 3) -> DataFrame:
    """Boxes strictly inside both percentiles on every axis, thresholds taken from all boxes."""
    sizes = box_size(box(dim=dim))
    limits = column_quantiles(boxes, {f"_{end}{i}": (s, p) for i, s in enumerate(sizes) for end, p in (("low", low), ("high", high))})
    out = boxes.join(F.broadcast(limits))  # one row
    for i, s in enumerate(sizes):
        out = out.filter((s > F.col(f"_low{i}")) & (s < F.col(f"_high{i}")))
    return out.select(*boxes.columns)


def normalisation_rule(cases: DataFrame, crop_volume: Column, volume: Column, modalities: Mapping[int, str], limit: float = 0.75) -> DataFrame:
    """Median share kept by cropping, and per modality whether statistics are masked to non-zero voxels."""
    agg = column_quantiles(cases, {"median_reduction": (crop_volume / volume, 0.5)})
    rows = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("modality"), F.lit(n).alias("kind")) for i, n in modalities.items()])).alias("m")
    small = F.col("median_reduction") < limit
    return agg.select("median_reduction", rows).select(
        "m.modality", "m.kind", "median_reduction", ((F.lower("m.kind") != "ct") & small).alias("use_mask")
    )


def volume_ranking(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Instances by ascending voxel count, with their first voxel in (z, y, x) order."""
    return voxels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("voxels"), F.min(F.struct("z", "y", "x")).alias("first")
    ).select(*keys, "voxels", "first.z", "first.y", "first.x").orderBy("voxels", *keys)
