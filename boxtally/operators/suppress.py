"""Suppression, clustering and ensembling of detections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.functions.geometry import (
    BOX_COLUMNS, Box, box, box_area, box_columns, box_iou, clip_box, overlap_volume, ranges_intersect, sides_at_least,
)
from boxtally.operators.curves import number_rows, top_k, union_all
from boxtally.operators.graph import connected_components, fold_lost, rounds_keep
from boxtally.operators.groups import oversized_groups, split_by
from boxtally.operators.pairs import box_pairs
from boxtally.session import cut_lineage

MAX_FOLD_GROUP = 512


def _by_score() -> list[Column]:
    return [F.desc("score"), F.asc("det_id")]


def _better(s: str) -> Column:
    """Whether box ``a_`` comes before box ``b_``: higher sort value, then lower id."""
    return (F.col(f"a_{s}") > F.col(f"b_{s}")) | (
        (F.col(f"a_{s}") == F.col(f"b_{s}")) & (F.col("a_det_id") < F.col("b_det_id"))
    )


def greedy_keep(
    dets: DataFrame,
    keys: Sequence[str],
    clash: Callable[[Box, Box], Column],
    sort_by: str = "score",
    max_group: int = MAX_FOLD_GROUP,
    cell: float = 32.0,
    copies_clash: bool = True,
    margin: float = 0.0,
) -> DataFrame:
    """Boxes that survive when taken best first and dropped on a clash with a kept box.

    Groups up to ``max_group`` boxes are paired by an equi-join on the group and folded; larger
    ones are paired on a grid and settled in rounds. When copies of one box clash with each other
    only the best copy can survive, so in large groups copies are reduced before any pairing and
    a stack of identical boxes never yields its square in pairs.
    """
    k = list(keys)
    thin = dets.select(*k, "det_id", F.col(sort_by).alias("_s"), *BOX_COLUMNS)
    hot = oversized_groups([thin], k, max_group)
    better_clash = _better("_s") & clash(box("a_"), box("b_"))
    cold, big = (thin, None) if hot is None else split_by(thin, hot, k)
    turn = F.struct((-F.col("b__s")).alias("t0"), F.col("b_det_id").alias("t1")).alias("turn")
    # partitioned by group once: the join, the blockers and the fold share that partitioning
    cold = cold.repartition(*k)
    pairs = box_pairs(cold, cold, k, condition=better_clash)
    lost = fold_lost(pairs.select(*k, F.col("a_det_id").alias("u"), F.col("b_det_id").alias("v"), turn), k)
    lost = lost.withColumnRenamed("id", "det_id")
    if big is None:
        return dets.join(lost, [*k, "det_id"], "left_anti")
    pool = big
    if copies_clash:
        best = F.min(F.struct((-F.col("_s")).alias("n"), F.col("det_id"))).alias("b")
        # empty boxes overlap nothing, not even their copies
        apart = F.when(box_area(box()) <= 0, F.col("det_id")).alias("_own")
        pool = big.groupBy(*k, *BOX_COLUMNS, apart).agg(best).select(
            *k, F.col("b.det_id").alias("det_id"), (-F.col("b.n")).alias("_s"), *BOX_COLUMNS
        )
    near = box_pairs(pool, pool, k, condition=better_clash, cell=cell, margin=margin)
    edges = near.select(*k, F.col("a_det_id").alias("u"), F.col("b_det_id").alias("v"))
    kept = rounds_keep(pool.select(*k, F.col("det_id").alias("id")), edges, k)
    cold_d, hot_d = split_by(dets, hot, k)
    return cold_d.join(lost, [*k, "det_id"], "left_anti").unionByName(
        hot_d.join(kept.withColumnRenamed("id", "det_id"), [*k, "det_id"], "left_semi")
    )


def nms(dets: DataFrame, max_iou: float, keys: Sequence[str] = ("case_id",), **kwargs) -> DataFrame:
    """Non-maximum suppression: drop a box whose IoU with a kept better box exceeds ``max_iou``."""
    return greedy_keep(dets, keys, lambda a, b: box_iou(a, b) > max_iou, copies_clash=max_iou < 1, **kwargs)


def batched_nms(dets: DataFrame, max_iou: float, keys: Sequence[str] = ("case_id", "label"), **kwargs) -> DataFrame:
    """NMS within each class; the class is part of the group key, so coordinates may be negative."""
    return nms(dets, max_iou, keys, **kwargs)


def weighted_nms(dets: DataFrame, max_iou: float, weight: str = "weight", keys: Sequence[str] = ("case_id", "label"), **kwargs) -> DataFrame:
    """NMS in the order of score times weight; scores stay as they are and weights become 1."""
    keyed = dets.withColumn("_order", F.col("score") * F.col(weight))
    return nms(keyed, max_iou, keys, sort_by="_order", **kwargs).drop("_order").withColumn(weight, F.lit(1.0))


def _clusters(dets: DataFrame, max_iou: float, keys: Sequence[str], cell: float, **kwargs) -> DataFrame:
    """Every box with the seed it joins: the best-scored kept box it overlaps by more than ``max_iou``."""
    k = list(keys)
    seeds = nms(dets, max_iou, k, cell=cell, **kwargs)
    thin = seeds.select(*k, F.col("det_id").alias("seed"), F.col("score").alias("seed_score"), *BOX_COLUMNS)
    near = box_pairs(thin, dets, k, cell=cell).withColumn("iou", box_iou(box("a_"), box("b_")))
    choice = F.min_by(
        F.struct(F.col("a_seed").alias("seed"), "iou"), F.struct((-F.col("a_seed_score")).alias("s"), F.col("a_seed").alias("i"))
    ).alias("c")
    rest = [c for c in dets.columns if c not in k and c != "det_id"]
    joined = near.filter((F.col("iou") > max_iou)).groupBy(*k, F.col("b_det_id").alias("det_id")).agg(
        choice, *[F.first(f"b_{c}").alias(c) for c in rest]
    )
    return joined.select(*k, "det_id", *rest, "c.seed", "c.iou")


def weighted_box_clustering(
    dets: DataFrame,
    max_iou: float,
    expected: str = "n_expected",
    weight: str = "weight",
    missing_weight: float = 1.0,
    min_score: float = 0.0,
    use_area: bool = False,
    keys: Sequence[str] = ("case_id", "label"),
    cell: float = 32.0,
    **kwargs,
) -> DataFrame:
    """Merge each cluster into one box (``det_id`` is its seed).

    With w = IoU to the seed · weight (· area), the box is the mean weighted by w · score and the
    score is Σ w·score / (Σ w + missing · mean(w) · missing_weight), where ``missing`` is how many
    members fewer than expected were found.
    """
    k = list(keys)
    w = F.col("iou") * F.col(weight) * (box_area(box()) if use_area else F.lit(1.0))
    members = _clusters(dets, max_iou, k, cell, **kwargs).withColumn("_w", w).withColumn("_ws", F.col("_w") * F.col("score"))
    n = F.count(F.lit(1))
    lacking = F.greatest(F.lit(0.0), F.avg(expected) - n)
    score = F.try_divide(F.sum("_ws"), F.sum("_w") + lacking * F.avg("_w") * F.lit(missing_weight))
    merged = members.groupBy(*k, F.col("seed").alias("det_id")).agg(
        score.alias("score"), n.alias("members"),
        *[F.try_divide(F.sum(F.col(c) * F.col("_ws")), F.sum("_ws")).alias(c) for c in BOX_COLUMNS],
    )
    return merged.filter(F.col("score") > min_score)


def top_member_clustering(
    dets: DataFrame, max_iou: float, expected: str = "n_expected", weight: str = "weight", missing_weight: float = 1.0,
    min_score: float = 0.0, keys: Sequence[str] = ("case_id", "label"), cell: float = 32.0, **kwargs,
) -> DataFrame:
    """Variant that averages only the expected number of strongest members of a cluster."""
    k = list(keys)
    # read by the count, the ranking and the sizes, so written out once
    members = cut_lineage(_clusters(dets, max_iou, k, cell, **kwargs).withColumn("_ws", F.col("iou") * F.col(weight) * F.col("score")))
    sizes = members.groupBy(*k, "seed").agg(F.avg(expected).alias("_e"), F.count(F.lit(1)).alias("_n"))
    ranked = number_rows(members, [*k, "seed"], [F.desc("_ws"), F.asc("det_id")], "_r")
    sized = ranked.join(sizes, [*k, "seed"]).filter(F.col("_r") <= F.floor("_e"))
    lacking = F.greatest(F.lit(0.0), F.first("_e") - F.first("_n"))
    merged = sized.groupBy(*k, F.col("seed").alias("det_id")).agg(
        (F.avg("score") * (1 - F.try_divide(F.lit(missing_weight) * lacking, F.first("_e")))).alias("score"),
        F.first("_n").alias("members"),
        *[F.try_divide(F.sum(F.col(c) * F.col("_ws")), F.sum("_ws")).alias(c) for c in BOX_COLUMNS],
    )
    return merged.filter(F.col("score") > min_score)


def cluster_then_nms(dets: DataFrame, cluster_iou: float, nms_iou: float, **kwargs) -> DataFrame:
    """Clustering per class followed by class-agnostic NMS."""
    # the clusters are read several times by the suppression, so they are written out once
    return nms(cut_lineage(weighted_box_clustering(dets, cluster_iou, **kwargs)), nms_iou, ("case_id",))


def postprocess(
    dets: DataFrame, cases: DataFrame, top: int, min_score: float, min_size: float, max_iou: float, per_image: int,
    shape: Sequence[str] = ("shape_x", "shape_y", "shape_z"), keys: Sequence[str] = ("case_id",), **kwargs,
) -> DataFrame:
    """Top-k, score filter, clip, drop small, per-class NMS, cap: the order of the steps is part of the result."""
    k = list(keys)
    best = top_k(dets, k, _by_score(), top).filter(F.col("score") > min_score).drop("rank")
    size = cases.select("case_id", *shape)
    rest = [c for c in dets.columns if c not in BOX_COLUMNS]
    clipped = best.join(size, "case_id").select(*rest, *box_columns(clip_box(box(), [F.col(s) for s in shape])))
    solid = cut_lineage(clipped.filter(sides_at_least(box(), min_size)))
    return top_k(batched_nms(solid, max_iou, [*k, "label"], **kwargs), k, _by_score(), per_image)


def expected_from_tiles(dets: DataFrame, tiles: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Mean number of tiles covering each box: Σ intersection volume / box volume, as ``n_expected``."""
    k = list(keys)
    thin = dets.select(*k, "det_id", *BOX_COLUMNS)
    near = box_pairs(thin, tiles.select(*k, *BOX_COLUMNS), k, condition=ranges_intersect(box("a_"), box("b_")))
    cover = near.groupBy(*k, F.col("a_det_id").alias("det_id")).agg(
        F.sum(overlap_volume(box("a_"), box("b_")) / box_area(box("a_"))).alias("n_expected")
    )
    return dets.join(cover, [*k, "det_id"], "left").na.fill(0.0, ["n_expected"])


def tile_cover_median(voxels: DataFrame, tiles: DataFrame, keys: Sequence[str], case: str = "case_id") -> DataFrame:
    """Median number of tiles over the voxels of each box, the voxel-wise reading of the overlap.

    A case has few tiles, so the range join meets a voxel with those of its case only.
    """
    spots = tiles.select(F.col(case).alias("_case"), *[F.col(c).alias(f"t{c}") for c in BOX_COLUMNS])
    inside = [(F.col(a) >= F.col(f"t{a}1")) & (F.col(a) < F.col(f"t{a}2")) for a in "xyz"]
    hit = voxels.join(spots, (F.col(case) == F.col("_case")) & inside[0] & inside[1] & inside[2], "left")
    per_voxel = hit.groupBy(*keys, "z", "y", "x").agg(F.count("_case").alias("n"))
    return per_voxel.groupBy(*keys).agg(F.percentile("n", F.lit(0.5)).alias("n_expected"))


def ensemble(
    models: Sequence[DataFrame] | DataFrame, top: int, max_iou: float, n_expected: str | float, weight: str | None = None, **kwargs
) -> DataFrame:
    """Boxes of several models merged per case: global top-k, then clustering.

    ``n_expected`` names a column (for instance from :func:`expected_from_tiles`) or is a number
    such as the count of models.
    """
    pool = models if isinstance(models, DataFrame) else union_all(list(models))
    best = top_k(pool, ["case_id"], _by_score(), top).drop("rank")
    expected = F.col(n_expected) if isinstance(n_expected, str) else F.lit(float(n_expected))
    ready = best.withColumn("n_expected", expected).withColumn("weight", F.col(weight) if weight else F.lit(1.0))
    return weighted_box_clustering(cut_lineage(ready), max_iou, **kwargs)


def attach_grade_probs(final: DataFrame, candidates: DataFrame, probs: Sequence[str], cell: float = 32.0) -> DataFrame:
    """Grade probabilities of the candidate with the largest IoU + [same class] · score · 1e-6.

    A candidate that overlaps nothing still competes through its class and score, so the best
    overlapping candidate is compared with the best candidate of the case and class.
    """
    f, c = box("a_"), box("b_")
    payload = F.struct(*[F.col(f"b_{p}").alias(p) for p in probs], F.col("b_det_id").alias("source"))
    near = box_pairs(final.select("case_id", "det_id", "label", *BOX_COLUMNS),
                     candidates.select("case_id", "det_id", "label", "score", *BOX_COLUMNS, *probs), ("case_id",), cell=cell)
    bonus = F.when(F.col("a_label") == F.col("b_label"), F.col("b_score") * 1e-6).otherwise(F.lit(0.0))
    near = near.select("case_id", F.col("a_det_id").alias("det_id"), (box_iou(f, c) + bonus).alias("v"), payload.alias("p"))
    touching = near.groupBy("case_id", "det_id").agg(F.max(F.struct("v", (-F.col("p.source")).alias("o"), "p")).alias("t"))
    pick = F.max(F.struct((F.col("score") * 1e-6).alias("v"), (-F.col("det_id")).alias("o"),
                          F.struct(*probs, F.col("det_id").alias("source")).alias("p"))).alias("s")
    same = candidates.groupBy("case_id", "label").agg(pick)
    first = candidates.groupBy("case_id").agg(F.max(F.struct(F.lit(0.0).alias("v"), (-F.col("det_id")).alias("o"),
                          F.struct(*probs, F.col("det_id").alias("source")).alias("p"))).alias("z"))
    joined = final.join(touching, ["case_id", "det_id"], "left").join(same, ["case_id", "label"], "left").join(first, "case_id", "left")
    best = F.greatest("t", "s", "z")
    return joined.select(*final.columns, *[best["p"][p].alias(p) for p in [*probs, "source"]])


def voxel_box(b: Box, shape: Sequence[Column]) -> Box:
    """Outward rounding to voxel ranges ``[lo, hi)`` clipped to the image."""
    lo = [F.greatest(F.lit(0.0), F.least(F.floor(v).cast("double"), s)) for v, s in zip(b.lo, shape)]
    hi = [F.greatest(F.lit(0.0), F.least(F.ceil(v).cast("double"), s)) for v, s in zip(b.hi, shape)]
    return Box(tuple(lo), tuple(hi))


def merge_touching(
    dets: DataFrame, cases: DataFrame, shape: Sequence[str] = ("shape_x", "shape_y", "shape_z"), cell: float = 32.0
) -> DataFrame:
    """26-connected unions of painted boxes: one row per component with its best score and hull.

    Two boxes touch iff their half-open voxel ranges meet or overlap on every axis, so nothing is
    painted. Identical voxel boxes are merged before pairing; boxes that score 0 or are empty after
    clipping leave no trace.
    """
    voxel = voxel_box(box(), [F.col(s) for s in shape])
    placed = dets.filter(F.col("score") > 0).join(cases.select("case_id", *shape), "case_id")
    solid = placed.select("case_id", "det_id", "score", *box_columns(voxel)).filter(box_area(box()) > 0)
    unique = solid.groupBy("case_id", *BOX_COLUMNS).agg(F.max("score").alias("score"), F.min("det_id").alias("id"))
    near = box_pairs(unique.drop("score"), unique.drop("score"), ("case_id",), margin=1.0, cell=cell,
                     condition=ranges_intersect(box("a_"), box("b_"), closed=True) & (F.col("a_id") < F.col("b_id")))
    edges = near.select("case_id", F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    labels = connected_components(unique.select("case_id", "id"), edges, ("case_id",))
    return unique.join(labels, ["case_id", "id"]).groupBy("case_id", "component").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("boxes"),
        *[F.min(c).alias(c) for c in ("x1", "y1", "z1")], *[F.max(c).alias(c) for c in ("x2", "y2", "z2")],
    )


def greedy_non_overlap(dets: DataFrame, cases: DataFrame, min_voxels: int = 0, keys: Sequence[str] = ("case_id", "label"),
                       shape: Sequence[str] = ("shape_x", "shape_y", "shape_z"), **kwargs) -> DataFrame:
    """Best first; a box is dropped when its one-voxel neighbourhood holds part of an accepted box.

    Accepted boxes occupy the voxels ``[int(lo) + 1, int(hi))``, a candidate looks at
    ``[max(0, int(lo) − 1), int(hi) + 2)``. Boxes with at most ``min_voxels`` inner voxels are dropped first.
    """
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double")
    b = box()
    bounds = [F.col(s) for s in shape]
    placed = dets.join(cases.select("case_id", *shape), "case_id")
    # painting clips to the image: negative starts count from 0 and ends stop at the border
    inner = Box(tuple(F.greatest(whole(v) + 1, F.lit(0.0)) for v in b.lo), tuple(F.least(whole(v), s) for v, s in zip(b.hi, bounds)))
    sides = [F.greatest(h - l, F.lit(0.0)) for l, h in inner.axes()]
    sized = placed.filter(sides[0] * sides[1] * sides[2] > min_voxels).select(
        *dets.columns, *[c.alias(f"i{n}") for n, c in zip(BOX_COLUMNS, (inner.lo[0], inner.lo[1], inner.hi[0], inner.hi[1], inner.lo[2], inner.hi[2]))]
    )
    painted = sized.select(*keys, "det_id", "score", *[F.col(f"i{c}").alias(c) for c in BOX_COLUMNS])

    def clash(a: Box, c: Box) -> Column:
        # c.lo is int(lo)+1 clipped at 0, so the neighbourhood starts two voxels lower
        tests = [
            F.least(ah, ch + 2) > F.greatest(al, F.greatest(cl - 2, F.lit(0.0))) for (al, ah), (cl, ch) in zip(a.axes(), c.axes())
        ]
        return tests[0] & tests[1] & tests[2]

    kept = greedy_keep(painted, keys, clash, margin=3.0, **kwargs)
    return sized.join(kept.select(*keys, "det_id"), [*keys, "det_id"], "left_semi").select(*dets.columns)


def tile_grid(
    cases: DataFrame, shape: Sequence[str], patch: Sequence[int], overlap: Sequence[int],
    mode: str = "fixed", center_border: bool = False, border: str = "shift",
) -> DataFrame:
    """Tiles of every case as boxes, from start positions per axis.

    ``fixed`` starts at 0 and steps by patch − overlap until the extent is covered; ``symmetric``
    starts so far outside that both ends stick out equally. ``center_border`` adds tiles centred on
    the two borders. ``border`` says whether tiles that stick out are shifted inside or left to padding.
    """
    if mode not in ("fixed", "symmetric") or border not in ("shift", "pad"):
        raise ValueError("mode is fixed or symmetric, border is shift or pad")
    out = cases
    for name, s, p, o in zip("xyz", shape, patch, overlap):
        d = F.col(s).cast("long")
        step = p - o
        first = F.lit(0).cast("long")
        if mode == "symmetric":
            wide = F.floor((d - p) / 2.0)
            first = F.when(d <= p, wide).otherwise(F.floor((d % step - p) / 2.0))
        more = F.greatest(F.ceil((d - p - first) / F.lit(float(step))), F.lit(0))
        starts = F.transform(F.sequence(F.lit(0).cast("long"), more), lambda i: first + i * step)
        if center_border:
            edges = F.array(F.lit(int(-0.5 * p)).cast("long"), d - int(0.5 * p))
            starts = F.concat(starts, edges)
        if border == "shift":
            starts = F.transform(starts, lambda v: F.when(v < 0, F.lit(0)).when(v + p > d, d - p).otherwise(v))
        out = out.withColumn(f"{name}1", F.explode(starts)).withColumn(f"{name}2", F.col(f"{name}1") + p)
    return out.select("case_id", *[f"{a}{i}" for i in (1, 2) for a in "xyz"])


def sweep(
    start: dict[str, float], choices: dict[str, Sequence[float]], evaluate: Callable[[dict[str, float]], DataFrame], metric: str
) -> tuple[dict[str, float], list[tuple[str, float, float]]]:
    """Coordinate descent over parameter lists, the first best value of each list being kept.

    ``evaluate`` returns a one-row metric table for a setting; all values of one parameter are
    evaluated as one job, and only their scores come to the driver.
    """
    state, history = dict(start), []
    for name, values in choices.items():
        tables = [
            evaluate({**state, name: v}).select(F.lit(i).alias("i"), F.col(metric).cast("double").alias("m"))
            for i, v in enumerate(values)
        ]
        scores = {r["i"]: r["m"] for r in union_all(tables).collect()}
        best = max(range(len(values)), key=lambda i: (scores[i], -i))
        history += [(name, float(v), scores[i]) for i, v in enumerate(values)]
        state[name] = values[best]
    return state, history


def segmentation_score(members: DataFrame, keys: Sequence[str], prob: str = "prob") -> DataFrame:
    """Instance scores from member probabilities: max, mean, median and 95th percentile."""
    return members.groupBy(*keys).agg(
        F.max(prob).alias("score_max"), F.avg(prob).alias("score_mean"),
        F.percentile(prob, F.lit(0.5)).alias("score_median"), F.percentile(prob, F.lit(0.95)).alias("score_p95"),
    )


def weighted_tile_mean(rows: DataFrame, keys: Sequence[str], model_weight: str = "model_weight", tile_weight: str = "tile_weight", prob: str = "prob") -> DataFrame:
    """Class probability per voxel: Σ prob · tile weight · model weight / Σ tile weight."""
    return rows.groupBy(*keys).agg(
        (F.sum(F.col(prob) * F.col(tile_weight) * F.col(model_weight)) / F.sum(tile_weight)).alias(prob)
    )


