"""Assigning detections to ground truth one to one.

All matchers are the same game: detections act in a fixed order and each takes the free ground
truth it prefers most. They differ in the order (by score, or as given) and in the preference
(largest IoU, regular before ignored, or first in the list).

Two exact ways are used, chosen by group size:

* groups up to ``max_group`` boxes are folded in one pass with a higher-order function: one
  shuffle on the group key, no Python;
* larger groups are solved by rounds of proposals. Every detection proposes to its favourite, a
  ground truth keeps its best proposer, and pairs that can no longer happen are dropped. Because
  every ground truth ranks the detections the same way, the stable outcome is unique and equal to
  the sequential one, while each round only needs aggregates keyed by single boxes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions.geometry import BOX_COLUMNS, box, box_iou, ranges_intersect
from boxtally.operators.groups import oversized_groups, split_by
from boxtally.operators.pairs import box_pairs
from boxtally.session import cut_lineage

MAX_FOLD_GROUP = 512
ALMOST_ONE = 1 - 1e-10


def _preference(kind: str) -> Column:
    """Struct ordered so that its minimum is the ground truth a detection wants most."""
    if kind == "best":
        return F.struct((-F.col("iou")).alias("p0"), F.col("b_gt_id").alias("p1"))
    if kind == "coco":
        return F.struct(
            F.col("b_ignore").cast("int").alias("p0"),
            (-F.col("iou")).alias("p1"),
            (-F.col("b_gt_id")).alias("p2"),
        )
    if kind == "first":
        return F.struct(F.col("b_gt_id").alias("p0"))
    raise ValueError(f"unknown preference {kind!r}")


def _turn(order: str) -> Column:
    if order == "score":
        return F.struct((-F.col("a_score")).alias("t0"), F.col("a_det_id").alias("t1"))
    if order == "input":
        return F.struct(F.col("a_det_id").alias("t0"))
    raise ValueError(f"unknown order {order!r}")


def _fold(dets, gts, keys, thresholds, preference, order, det_cols, gt_cols) -> DataFrame:
    """One pass per group: collect the bounded group and let the detections take turns."""
    # partitioned by group once, everything below needs no further shuffle
    pairs = box_pairs(dets.repartition(*keys), gts, keys, how="left").withColumn(
        "iou", F.when(F.col("b_gt_id").isNotNull(), box_iou(box("a_"), box("b_")))
    )
    floor = min(min(thresholds), ALMOST_ONE)
    wish = F.struct(
        _preference(preference).alias("pref"),
        F.col("b_gt_id").alias("gt_id"),
        F.col("iou"),
        *[F.col(f"b_{c}").alias(c) for c in gt_cols],
    )
    per_det = pairs.groupBy(*keys, "a_det_id", "a_score", *[f"a_{c}" for c in det_cols]).agg(
        F.array_sort(F.collect_list(F.when(F.col("iou") >= F.lit(floor), wish))).alias("wishes")
    )
    turn = F.struct(
        _turn(order).alias("turn"),
        F.col("a_det_id").alias("det_id"),
        F.col("a_score").alias("score"),
        *[F.col(f"a_{c}").alias(c) for c in det_cols],
        F.col("wishes"),
    )
    grouped = per_det.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    levels = ", ".join(f"cast({t!r} as double)" for t in thresholds)
    kept = ["det_id", "score", *det_cols]
    row_fields = ", ".join(
        [f"'{c}', d.{c}" for c in kept]
        + ["'gt_id', g.gt_id", "'iou', g.iou"]
        + [f"'{c}', g.{c}" for c in gt_cols]
    )
    row_types = ", ".join(
        [f"{c}: {t}" for c, t in _field_types(per_det, kept, "a_")]
        + ["gt_id: bigint", "iou: double"]
        + [f"{c}: {t}" for c, t in _field_types(pairs, gt_cols, "b_")]
    )
    fold = f"""
      transform(array({levels}), t -> named_struct('iou_thr', t, 'rows', aggregate(
        turns,
        named_struct('used', cast(array() as array<bigint>),
                     'rows', cast(array() as array<struct<{row_types}>>)),
        (acc, d) -> transform(
          array(get(filter(d.wishes, w -> w.iou >= least(t, cast({ALMOST_ONE!r} as double))
                                          and not array_contains(acc.used, w.gt_id)), 0)),
          g -> named_struct(
            'used', if(g.gt_id is null, acc.used, concat(acc.used, array(g.gt_id))),
            'rows', concat(acc.rows, array(named_struct({row_fields})))
          ))[0],
        acc -> acc.rows)))
    """
    solved = grouped.select(*keys, F.explode(F.expr(fold)).alias("level"))
    flat = solved.select(*keys, F.col("level.iou_thr").alias("iou_thr"), F.explode("level.rows").alias("r"))
    return flat.select(*keys, "iou_thr", "r.*")


def _field_types(df: DataFrame, names: Sequence[str], prefix: str):
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(n, types[prefix + n]) for n in names]


def _rounds(dets, gts, keys, thresholds, preference, order, det_cols, gt_cols, cell) -> DataFrame:
    """Proposal rounds for groups too large to fold."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    id_keys = [*keys, "iou_thr"]
    # copies of one box share their wishes; only as many as there are wishes can ever be served
    unique = dets.groupBy(*keys, *BOX_COLUMNS).agg(F.min("det_id").alias("det_id"))
    thin_gt = gts.select(*keys, "gt_id", *BOX_COLUMNS, *(["ignore"] if preference == "coco" else []))
    near = (
        box_pairs(unique, thin_gt, keys, cell=cell)
        .withColumn("iou", box_iou(box("a_"), box("b_")))
        .withColumn("pref", _preference(preference))
        .withColumn("iou_thr", levels)
        .filter(F.col("iou") >= F.least(F.col("iou_thr"), F.lit(ALMOST_ONE)))
        .select(
            *id_keys, *[F.col(f"a_{c}").alias(c) for c in BOX_COLUMNS],
            F.col("b_gt_id").alias("gt_id"), "iou", "pref",
        )
    )
    near = cut_lineage(near)
    wishes = near.groupBy(*id_keys, *BOX_COLUMNS).agg(F.count(F.lit(1)).alias("wishes"))
    turns = prefixed_turns(dets, keys, order)
    ranked = (
        turns.join(wishes, [*keys, *BOX_COLUMNS])
        .withColumn("copy", F.row_number().over(_window([*id_keys, *BOX_COLUMNS], "turn")))
        .filter(F.col("copy") <= F.col("wishes"))
        .select(*id_keys, *BOX_COLUMNS, "det_id", "turn")
    )
    live = cut_lineage(
        ranked.join(near, [*id_keys, *BOX_COLUMNS]).select(*id_keys, "det_id", "turn", "gt_id", "iou", "pref")
    )
    size = live.count()
    while True:
        proposals = live.groupBy(*id_keys, "det_id").agg(
            F.min(F.struct("pref", "gt_id", "turn", "iou")).alias("best")
        )
        holders = proposals.groupBy(*id_keys, F.col("best.gt_id").alias("gt_id")).agg(
            F.min("best.turn").alias("holder")
        )
        smaller = cut_lineage(
            live.join(holders, [*id_keys, "gt_id"], "left")
            .filter(F.col("holder").isNull() | (F.col("turn") <= F.col("holder")))
            .drop("holder")
        )
        left = smaller.count()
        live = smaller
        if left == size:
            break
        size = left
    matched = live.groupBy(*id_keys, "det_id").agg(F.min(F.struct("pref", "gt_id", "iou")).alias("m"))
    matched = matched.select(*id_keys, "det_id", "m.gt_id", "m.iou")
    payload = gts.select(*keys, "gt_id", *gt_cols)
    return (
        dets.select(*keys, "det_id", "score", *det_cols)
        .withColumn("iou_thr", levels)
        .join(matched, [*id_keys, "det_id"], "left")
        .join(payload, [*keys, "gt_id"], "left")
        .select(*id_keys, "det_id", "score", *det_cols, "gt_id", "iou", *gt_cols)
    )


def _window(parts, order):
    from pyspark.sql import Window

    return Window.partitionBy(*parts).orderBy(order)


def prefixed_turns(dets: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    thin = dets.select(*keys, "det_id", "score", *BOX_COLUMNS)
    turn = (
        F.struct((-F.col("score")).alias("t0"), F.col("det_id").alias("t1"))
        if order == "score"
        else F.struct(F.col("det_id").alias("t0"))
    )
    return thin.withColumn("turn", turn)


def sequential_match(
    dets: DataFrame,
    gts: DataFrame,
    keys: Sequence[str] = ("case_id",),
    thresholds: Sequence[float] = (0.1,),
    preference: str = "best",
    order: str = "score",
    det_cols: Sequence[str] = (),
    gt_cols: Sequence[str] = (),
    max_group: int = MAX_FOLD_GROUP,
    cell: float = 32.0,
) -> DataFrame:
    """One row per detection and threshold: the ground truth it took (``gt_id`` null if none).

    ``det_cols`` and ``gt_cols`` travel with the rows, so no join back is needed afterwards.
    """
    keys, det_cols, gt_cols = list(keys), list(det_cols), list(gt_cols)
    args = (keys, list(thresholds), preference, order, det_cols, gt_cols)
    need = [*keys, "gt_id", *BOX_COLUMNS, *gt_cols]
    if preference == "coco" and "ignore" not in need:
        need.append("ignore")
    dets = dets.select(*keys, "det_id", "score", *BOX_COLUMNS, *det_cols)
    gts = gts.select(*need)
    hot = oversized_groups([dets, gts], keys, max_group)
    if hot is None:
        return _fold(dets, gts, *args)
    cold_d, hot_d = split_by(dets, hot, keys)
    cold_g, hot_g = split_by(gts, hot, keys)
    return _fold(cold_d, cold_g, *args).unionByName(_rounds(hot_d, hot_g, *args, cell))


def greedy_match(dets, gts, min_iou: float = 0.1, **kwargs) -> DataFrame:
    """Class-agnostic greedy matching: by score, best free ground truth at or above ``min_iou``."""
    return sequential_match(dets, gts, thresholds=(min_iou,), **kwargs).drop("iou_thr")


def first_fit_match(dets, gts, min_iou: float = 0.1, **kwargs) -> DataFrame:
    """Detections in input order take the first free ground truth at or above ``min_iou``."""
    out = sequential_match(
        dets, gts, thresholds=(min_iou,), preference="first", order="input", **kwargs
    )
    return out.drop("iou_thr")


def coco_match(
    dets: DataFrame,
    gts: DataFrame,
    thresholds: Sequence[float],
    max_detections: int = 100,
    keys: Sequence[str] = ("case_id", "label"),
    det_cols: Sequence[str] = (),
    **kwargs,
) -> DataFrame:
    """Per case and class: the ``max_detections`` best-scored detections matched at each threshold.

    A detection takes the free regular ground truth with the largest IoU (the last one on ties)
    and falls back to an ignored one; ``ignored`` marks detections matched to ignored boxes.
    """
    by_score = _window(list(keys), [F.desc("score"), F.asc("det_id")])
    top = dets.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= max_detections)
    out = sequential_match(
        top, gts, keys, thresholds, "coco", det_cols=["rank", *det_cols], gt_cols=["ignore"], **kwargs
    )
    return out.select(
        *keys, "iou_thr", "det_id", "score", "rank", *det_cols, "gt_id", "iou",
        F.col("gt_id").isNotNull().alias("matched"),
        F.coalesce("ignore", F.lit(False)).alias("ignored"),
    )


def unmatched_gt(matches: DataFrame, gts: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Ground truth no detection took."""
    taken = matches.filter(F.col("gt_id").isNotNull()).select(*keys, "gt_id")
    return gts.join(taken, [*keys, "gt_id"], "left_anti")


__all__ = [
    "coco_match", "first_fit_match", "greedy_match", "ranges_intersect", "sequential_match", "unmatched_gt",
]
