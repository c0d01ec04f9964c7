"""Operators on sparse voxels: one row per labelled voxel (case_id, z, y, x, ...).

Image arrays become rows, so every operator is an aggregate or an equi-join on the voxel (or on a
grid of voxels), partitioned by voxel and not by case: a large case spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.operators.curves import number_rows, running_totals
from boxtally.operators.distance import with_distance
from boxtally.operators.graph import connected_components
from boxtally.operators.order_stats import with_quantiles
from boxtally.session import cut_lineage

AXES = ("z", "y", "x")
VOXEL = ("case_id", *AXES)
#: The percentiles of intensity statistics.
INTENSITY_LEVELS = {"median": 0.5, "p005": 0.005, "p995": 0.995}
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def mask_to_boxes(voxels: DataFrame, keys: Sequence[str], convention: str = "half_open") -> DataFrame:
    """Bounding box per instance; ``expanded`` widens by one voxel on both sides (min − 1, max + 1)."""
    if convention not in ("half_open", "expanded"):
        raise ValueError("convention is half_open or expanded")
    low = 1 if convention == "expanded" else 0
    return voxels.groupBy(*keys).agg(
        *[(F.min(a) - low).cast("double").alias(f"{a}1") for a in "xyz"],
        *[(F.max(a) + 1).cast("double").alias(f"{a}2") for a in "xyz"],
    )


def bbox_nonzero(voxels: DataFrame, value: str = "value") -> DataFrame:
    """Half-open box of the non-zero voxels of a case, over all channels."""
    return mask_to_boxes(voxels.filter(F.col(value) != 0), ["case_id"])


def instance_volume(voxels: DataFrame, keys: Sequence[str], cases: DataFrame, spacing: Sequence[str]) -> DataFrame:
    """Voxel count and physical volume per instance, class or region."""
    unit = F.col(spacing[0])
    for s in spacing[1:]:
        unit = unit * F.col(s)
    counts = voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("voxels"))
    return counts.join(cases.select("case_id", unit.alias("_u")), "case_id").select(
        *keys, "voxels", (F.col("voxels") * F.col("_u")).alias("volume")
    )


def every_nth(voxels: DataFrame, keys: Sequence[str], n: int = 10, large: bool = False) -> DataFrame:
    """Every ``n``-th row of a group in (z, y, x) order, starting with the first."""
    numbered = running_totals(voxels.withColumn("_one", F.lit(1).cast("long")), keys, [F.asc(a) for a in AXES], {"_i": "_one"}, large)
    return numbered.filter((F.col("_i") - 1) % n == 0).drop("_one", "_i")


def intensity_stats(
    voxels: DataFrame, modality: str = "modality", value: str = "value", step: int = 10, approximate: bool = False, large: bool = False
) -> DataFrame:
    """Foreground intensity statistics per case and modality and pooled per modality (null case).

    The deviation is the population one. Percentiles are exact unless ``approximate``.
    """
    rows = every_nth(voxels, ["case_id", modality], step, large) if step > 1 else voxels
    sets = f"GROUPING SETS ((case_id, {modality}), ({modality}))"
    known = f"count(*) AS n, avg({value}) AS mean, stddev_pop({value}) AS std, min({value}) AS min, max({value}) AS max"
    if approximate:
        near = ", ".join(f"percentile_approx({value}, {p}, 100000) AS {n}" for n, p in INTENSITY_LEVELS.items())
        return rows.sparkSession.sql(f"SELECT case_id, {modality}, {known}, {near} FROM {{rows}} GROUP BY {sets}", rows=rows)
    rows = cut_lineage(rows.select("case_id", modality, value))
    stats = rows.sparkSession.sql(f"SELECT case_id, {modality}, {known} FROM {{rows}} GROUP BY {sets}", rows=rows)
    pooled = rows.withColumn("case_id", F.lit(None).cast(dict(rows.dtypes)["case_id"]))
    # a pooled value counts once for its case and once for all
    return with_quantiles(stats, rows.unionByName(pooled), ["case_id", modality], value, INTENSITY_LEVELS)


def _positive(std: Column, what: str) -> Column:
    return F.when(std > 0, std).otherwise(F.raise_error(F.lit(f"{what} must be positive")).cast("double"))


def normalise_ct(voxels: DataFrame, stats: DataFrame, value: str = "value") -> DataFrame:
    """Clip to the pooled percentiles and scale by the pooled mean and deviation (one-row ``stats``)."""
    j = voxels.join(F.broadcast(stats.select("mean", "std", "p005", "p995")))  # one row
    clipped = F.greatest(F.col("p005"), F.least(F.col(value), F.col("p995")))
    return j.select(*voxels.columns, ((clipped - F.col("mean")) / _positive(F.col("std"), "deviation")).alias("normalised"))


def normalise_ct_per_case(voxels: DataFrame, stats: DataFrame, value: str = "value") -> DataFrame:
    """Clip to pooled percentiles; mean and deviation of the case's values strictly inside them."""
    j = voxels.join(F.broadcast(stats.select("p005", "p995")))  # one row
    inside = F.when((F.col(value) > F.col("p005")) & (F.col(value) < F.col("p995")), F.col(value))
    per = j.groupBy("case_id").agg(F.avg(inside).alias("_m"), F.stddev_pop(inside).alias("_s"))
    clipped = F.greatest(F.col("p005"), F.least(F.col(value), F.col("p995")))
    return j.join(per, "case_id").select(*voxels.columns, ((clipped - F.col("_m")) / _positive(F.col("_s"), "deviation")).alias("normalised"))


def normalise_per_case(voxels: DataFrame, value: str = "value", mask: Column | None = None) -> DataFrame:
    """Zero mean and unit deviation per case (+1e-8), over the mask only; 0 outside it."""
    inside = mask if mask is not None else F.lit(True)
    v = F.when(inside, F.col(value))
    per = voxels.groupBy("case_id").agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    scaled = (F.col(value) - F.col("_m")) / (F.col("_s") + 1e-8)
    return voxels.join(per, "case_id").select(*voxels.columns, F.when(inside, scaled).otherwise(F.lit(0.0)).alias("normalised"))


def normalise_gland_group(voxels: DataFrame, adc: Mapping[str, float], hbv: Mapping[str, float], fill: float) -> DataFrame:
    """Gland z-score for T2W, a fixed linear map for ADC, the ratio to the gland median for HBV.

    ``voxels`` has t2w, adc, hbv, gland and the three field-of-view flags fov_t2w, fov_adc, fov_hbv.
    Voxels outside the field of view of a channel get ``fill``.
    """
    gt = F.when(F.col("gland") & F.col("fov_t2w"), F.col("t2w"))
    gh = F.when(F.col("gland") & F.col("fov_hbv"), F.col("hbv"))
    per = voxels.groupBy("case_id").agg(
        F.avg(gt).alias("_m"), F.stddev_pop(gt).alias("_s")
    )
    per = with_quantiles(per, voxels, ["case_id"], gh, {"_h": 0.5})
    clip = lambda v, c: F.greatest(F.lit(c["low"]), F.least(v, F.lit(c["high"])))
    lin = lambda v, c: (clip(v, c) - c["offset"]) / c["scale"]
    keep = lambda flag, v: F.when(F.col(flag), v).otherwise(F.lit(fill))
    return voxels.join(per, "case_id").select(
        *VOXEL,
        keep("fov_t2w", (F.col("t2w") - F.col("_m")) / _positive(F.col("_s"), "gland deviation")).alias("t2w"),
        keep("fov_adc", lin(F.col("adc"), adc)).alias("adc"),
        keep("fov_hbv", lin(F.col("hbv") / _positive(F.col("_h"), "gland median"), hbv)).alias("hbv"),
    )


def fov_coverage(voxels: DataFrame, flags: Sequence[str]) -> DataFrame:
    return voxels.groupBy("case_id").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])


def _packed(z: Column, y: Column, x: Column) -> Column:
    """One long per voxel that sorts in (z, y, x) order; coordinates outside ``[0, 2^21)`` raise an error."""
    inside = z.between(0, (1 << 21) - 1) & y.between(0, (1 << 21) - 1) & x.between(0, (1 << 21) - 1)
    key = F.shiftleft(z.cast("long"), 42) + F.shiftleft(y.cast("long"), 21) + x.cast("long")
    return F.when(inside, key).otherwise(F.raise_error(F.lit("a voxel coordinate is outside of 0 to 2^21 - 1")).cast("long"))


def _runs(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The unbroken runs along x from ``a`` to ``b``, with an id named by the first voxel; a voxel may be repeated."""
    row = Window.partitionBy(*keys, "z", "y").orderBy("x")
    island = voxels.select(*keys, *AXES, (F.col("x") - F.dense_rank().over(row)).alias("_i"))
    runs = island.groupBy(*keys, "z", "y", "_i").agg(F.min("x").alias("a"), F.max("x").alias("b")).drop("_i")
    return runs.withColumn("run", _packed(F.col("z"), F.col("y"), F.col("a")))


def _labelled_runs(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs of a group with their component."""
    k = list(keys)
    # compressed, a table of runs looks small enough to be broadcast and is not
    runs = cut_lineage(_runs(voxels, k)).hint("merge")
    # half of the neighbouring rows is enough, edges are undirected
    step = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("s")
    up = runs.select(*k, F.col("run").alias("u"), F.col("a").alias("ua"), F.col("b").alias("ub"), "z", "y", step).select(
        *k, "u", "ua", "ub", (F.col("z") + F.col("s.dz")).alias("z"), (F.col("y") + F.col("s.dy")).alias("y")
    )
    edges = up.join(runs.withColumnRenamed("run", "v"), [*k, "z", "y"]).filter(
        (F.col("ua") <= F.col("b") + 1) & (F.col("a") <= F.col("ub") + 1)
    ).select(*k, "u", "v")
    nodes = runs.select(*k, F.col("run").alias("id"))
    labels = connected_components(nodes, edges, k).withColumnRenamed("id", "run")
    return runs.join(labels, [*k, "run"])


def _component_sizes(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The voxels of each component: (keys, component, voxels)."""
    return labelled.groupBy(*keys, "component").agg(F.sum(F.col("b") - F.col("a") + 1).alias("voxels"))


def connected_voxels(voxels: DataFrame, keys: Sequence[str] = ("case_id", "class"), min_voxels: int = 0) -> DataFrame:
    """Label connected voxels of a group over the full 26-neighbourhood.

    Adds ``component`` (first voxel in scan order, packed) and the dense ``instance_id`` from 1.
    Voxels are first reduced to runs along x, so the graph has one node per run; neighbouring rows
    meet in an equi-join on (group, z, y).
    """
    k = list(keys)
    labelled = cut_lineage(_labelled_runs(voxels, k)).hint("merge")
    sizes = cut_lineage(_component_sizes(labelled, k).filter(F.col("voxels") > min_voxels))
    ids = number_rows(sizes, k, [F.asc("component")], "instance_id")
    found = labelled.join(ids, [*k, "component"])
    return found.select(*k, "component", "z", "y", F.explode(F.sequence("a", "b")).alias("x"), "voxels", "instance_id")


def voted_components(voxels: DataFrame, cls: str = "class") -> DataFrame:
    """Components of the foreground whatever its class; each takes its commonest class (lowest on ties)."""
    comp = connected_voxels(voxels, ("case_id",)).drop("voxels")
    # compressed, a table of voxels looks small enough to be broadcast and is not
    votes = comp.join(voxels.select(*VOXEL, cls).distinct().hint("merge"), list(VOXEL)).groupBy("case_id", "instance_id", cls).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("case_id", "instance_id").agg(
        F.max_by(cls, F.struct("n", -F.col(cls))).alias(cls), F.sum("n").alias("voxels")
    )
    return comp.join(best.hint("merge"), ["case_id", "instance_id"])


def region_counts(voxels: DataFrame, keys: Sequence[str] = ("case_id", "class")) -> DataFrame:
    """Number of components per group and whether it is a single one."""
    sizes = _component_sizes(_labelled_runs(voxels, keys), keys)
    return sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("components")).withColumn("single", F.col("components") == 1)


def min_size_filter(voxels: DataFrame, cases: DataFrame, spacing: Sequence[str], min_size: float, min_voxels: int) -> DataFrame:
    """Instances whose extent in mm exceeds ``min_size`` on all axes but the coarsest, renumbered from 1."""
    boxes = mask_to_boxes(voxels, ["case_id", "instance_id"], "expanded")
    count = voxels.groupBy("case_id", "instance_id").agg(F.count(F.lit(1)).alias("voxels"))
    j = boxes.join(count, ["case_id", "instance_id"]).join(cases.select("case_id", *spacing), "case_id")
    coarsest = F.greatest(*[F.col(s) for s in spacing])
    wide, taken = F.lit(True), F.lit(False)
    for a, s in zip("xyz", spacing):
        skip = (F.col(s) == coarsest) & ~taken
        wide = wide & (skip | ((F.col(f"{a}2") - F.col(f"{a}1")) * F.col(s) > min_size))
        taken = taken | (F.col(s) == coarsest)
    kept = j.filter(wide & (F.col("voxels") > min_voxels)).select("case_id", "instance_id", "voxels")
    return number_rows(kept, ["case_id"], [F.asc("instance_id")], "new_id")


def containment(lesion: DataFrame, gland: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Share of the lesion's voxels inside the gland, with the voxel counts."""
    inside = gland.select(*VOXEL).distinct().withColumn("_in", F.lit(1.0))
    j = lesion.join(inside, list(VOXEL), "left")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("voxels"), F.count(F.when(F.col("_in").isNull(), 1)).alias("outside_voxels"),
        F.avg(F.coalesce("_in", F.lit(0.0))).alias("containment"),
    )


def containment_per_case(cases: DataFrame, lesion: DataFrame, gland: DataFrame) -> DataFrame:
    """Containment of every case; a case without lesion counts as fully contained."""
    return cases.select("case_id").join(containment(lesion, gland), "case_id", "left").select(
        "case_id", F.coalesce("containment", F.lit(1.0)).alias("containment")
    )


def centroid(voxels: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    return voxels.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in AXES])


def centroid_offset_mm(a: DataFrame, b: DataFrame, cases: DataFrame, spacing: Sequence[str]) -> DataFrame:
    """Distance in mm of the centroids of two masks per case, null where either is empty."""
    ca, cb = centroid(a), centroid(b).toDF("case_id", "oz", "oy", "ox")
    j = cases.select("case_id", *spacing).join(ca, "case_id", "left").join(cb, "case_id", "left")
    d = [(F.col(f"c{ax}") - F.col(f"o{ax}")) * F.col(s) for ax, s in zip("xyz", spacing)]
    return j.select("case_id", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("offset_mm"))


def mask_dice(a: DataFrame, b: DataFrame, cases: DataFrame) -> DataFrame:
    """2·∩ / (|a| + |b|) per case, 1 when both are empty."""
    va = a.select(*VOXEL).distinct().withColumn("_a", F.lit(1))
    vb = b.select(*VOXEL).distinct().withColumn("_b", F.lit(1))
    n = va.join(vb, list(VOXEL), "full").groupBy("case_id").agg(
        F.count("_a").alias("na"), F.count("_b").alias("nb"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both")
    )
    total = F.col("na") + F.col("nb")
    return cases.select("case_id").join(n, "case_id", "left").select(
        "case_id", F.when(total > 0, 2 * F.col("both") / total).otherwise(F.lit(1.0)).alias("dice")
    )


def _neighbour_counts(voxels: DataFrame) -> DataFrame:
    """Voxels with how many of their six face neighbours belong to the mask."""
    steps = F.array(*[
        F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(own).alias("own"))
        for dz, dy, dx, own in ((0, 0, 0, 1), *[(*f, 0) for f in FACES])
    ])
    cast = voxels.select(*VOXEL).distinct().select("*", F.explode(steps).alias("s")).select(
        "case_id", *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in AXES], F.col("s.own").alias("own")
    )
    return cast.groupBy(*VOXEL).agg(F.sum("own").alias("own"), F.sum(1 - F.col("own")).alias("near")).filter(F.col("own") == 1)


def surface(voxels: DataFrame) -> DataFrame:
    """Mask voxels with a face outside the mask."""
    return _neighbour_counts(voxels).filter(F.col("near") < 6).select(*VOXEL)


def erode(voxels: DataFrame, steps: int = 1) -> DataFrame:
    """Remove the surface ``steps`` times."""
    out = voxels.select(*VOXEL)
    for _ in range(steps):
        out = _neighbour_counts(out).filter(F.col("near") == 6).select(*VOXEL)
    return out


def outside_distance(lesion: DataFrame, gland: DataFrame, cases: DataFrame, spacing: Sequence[str]) -> DataFrame:
    """Voxels outside the gland with the distance in mm to its nearest voxel, null where a case has no gland."""
    out = lesion.join(gland.select(*VOXEL).distinct(), list(VOXEL), "left_anti")
    return with_distance(out, gland, cases, spacing)


def distance_summary(distances: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = F.percentile("dist", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    agg = distances.groupBy(*keys).agg(F.min("dist").alias("min"), q.alias("q"), F.max("dist").alias("max"))
    return agg.select(*keys, "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))], "max")


def dilation_sweep(lesion: DataFrame, gland: DataFrame, steps: int = 3, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Containment after 0..steps dilations of the gland with the six-neighbour element.

    A voxel is covered after r dilations iff its city-block distance to the gland is at most r. That distance adds up
    over the axes, so the gland is widened along one axis after the other, each voxel keeping its least distance.
    """
    near = gland.select(*VOXEL).distinct().withColumn("r", F.lit(0))
    moves = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(abs(d)).alias("n")) for d in range(-steps, steps + 1)])).alias("s")
    for a in AXES:
        rest = [c for c in VOXEL if c != a]
        wide = near.select(*VOXEL, "r", moves).filter(F.col("r") + F.col("s.n") <= steps)
        near = wide.select(*rest, (F.col(a) + F.col("s.d")).alias(a), (F.col("r") + F.col("s.n")).alias("r")).groupBy(*VOXEL).agg(F.min("r").alias("r"))
    look = lesion.withColumn("_id", _packed(F.col("z"), F.col("y"), F.col("x")))
    hit = look.select(*keys, "_id", *[c for c in VOXEL if c not in keys]).join(near, list(VOXEL), "left")
    best = hit.groupBy(*keys, "_id").agg(F.min("r").alias("r"))
    return best.groupBy(*keys).agg(*[F.avg(F.when(F.col("r") <= s, 1.0).otherwise(0.0)).alias(f"containment_{s}") for s in range(steps + 1)])


def anatomy_codes(voxels: DataFrame, gland: str = "gland", zone: str = "zone") -> DataFrame:
    """0 outside the gland, 1 and 2 for its zones, 3 for the rest of the gland."""
    code = F.when(~F.col(gland), 0).when(F.col(zone) == 1, 1).when(F.col(zone) == 2, 2).otherwise(3)
    return voxels.withColumn("anatomy", code.cast("long"))


def sample_centres(voxels: DataFrame, per_zone: int, order: Column, keys: Sequence[str] = ("case_id", "zone")) -> DataFrame:
    """At most ``per_zone`` voxels per case and zone, the lowest by a reproducible draw."""
    w = Window.partitionBy(*keys).orderBy(order, *AXES)
    return voxels.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= per_zone).drop("_n")


def retention_stats(voxels: DataFrame, stage: str = "stage") -> DataFrame:
    """Voxel and component counts per case and processing stage."""
    sizes = _component_sizes(_labelled_runs(voxels, ("case_id", stage)), ("case_id", stage))
    return sizes.groupBy("case_id", stage).agg(F.sum("voxels").alias("voxels"), F.count(F.lit(1)).alias("components"))


def crop_window(gland: DataFrame, cases: DataFrame, shape: Sequence[str], spacing: Sequence[str], fov_mm: float) -> DataFrame:
    """In-plane window of ``fov_mm`` around the gland centroid, else the image centre, with padding.

    Rounding is half to even. ``strategy`` records which centre was used.
    """
    c = centroid(gland)
    j = cases.select("case_id", *shape, *spacing).join(c, "case_id", "left")
    out = [F.when(F.col("cx").isNull(), "t2w_geometric_centre").otherwise("gland").alias("strategy")]
    for a, n, s in zip("xy", shape, spacing):
        size = F.bround(F.lit(fov_mm) / F.col(s)).cast("long")
        centre = F.coalesce(F.col(f"c{a}"), (F.col(n) - 1) / 2.0)
        start = F.bround(centre - size / 2.0).cast("long")
        end = start + size
        extent = F.col(n).cast("long")
        out += [
            F.greatest(F.lit(0), start).alias(f"{a}_start"), F.least(extent, end).alias(f"{a}_end"),
            F.greatest(F.lit(0), -start).alias(f"{a}_pad_before"), F.greatest(F.lit(0), end - extent).alias(f"{a}_pad_after"),
        ]
    return j.select("case_id", *out)


def region_features(lesion: DataFrame, gland: DataFrame, cases: DataFrame, spacing: Sequence[str], keys: Sequence[str] = ("case_id", "instance_id")) -> DataFrame:
    """ADC 10th percentile and median, HBV 90th percentile and T2W median relative to the gland, volume.

    Both inputs carry t2w, adc, hbv and fov flags. Empty selections and near-zero denominators give null.
    """
    inside = lambda v: F.when(F.col(f"fov_{v}"), F.col(v))
    per = lesion.groupBy(*keys).agg(
        F.percentile(inside("adc"), F.lit(0.1)).alias("adc_p10"), F.percentile(inside("adc"), F.lit(0.5)).alias("adc_median"),
        F.percentile(inside("hbv"), F.lit(0.9)).alias("_h"), F.percentile(inside("t2w"), F.lit(0.5)).alias("_t"), F.count(F.lit(1)).alias("_n"),
    )
    ref = gland.groupBy("case_id").agg(F.percentile(inside("hbv"), F.lit(0.5)).alias("_gh"), F.percentile(inside("t2w"), F.lit(0.5)).alias("_gt"))
    j = per.join(ref, "case_id", "left").join(cases.select("case_id", *spacing), "case_id")
    ratio = lambda a, b: F.when(F.abs(F.col(b)) >= 1e-8, F.col(a) / F.col(b))
    unit = F.col(spacing[0]) * F.col(spacing[1]) * F.col(spacing[2])
    return j.select(*keys, "adc_p10", "adc_median", ratio("_h", "_gh").alias("hbv_ratio"), ratio("_t", "_gt").alias("t2w_ratio"), (F.col("_n") * unit).alias("volume"))


def occupancy(source: DataFrame, anatomy: DataFrame, placements: DataFrame, zone_code: Column) -> DataFrame:
    """Share of a shifted source mask inside the gland and inside its target zone.

    ``source`` is (source_id, z, y, x), ``placements`` (placement_id, source_id, case_id, dz, dy, dx and
    what ``zone_code`` reads), ``anatomy`` voxels with their code. Voxels that leave the patch count as outside.
    """
    moved = placements.join(source, "source_id").select(
        placements["*"], *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES]
    )
    # a join loses the hint of its sides, and the voxels look as small as the boxes they come from
    j = moved.join(anatomy.select(*VOXEL, "anatomy").hint("merge"), list(VOXEL), "left")
    gland = F.coalesce(F.col("anatomy") > 0, F.lit(False)).cast("double")
    zone = F.coalesce(F.col("anatomy") == zone_code, F.lit(False)).cast("double")
    return j.groupBy("placement_id").agg(F.avg(gland).alias("gland_fraction"), F.avg(zone).alias("zone_fraction"))


def rater_consensus(votes: DataFrame, raters: int = 4, rating_limit: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(voxels kept by at least half of the raters, rating label per region).

    ``votes`` has one row per region, rater and voxel with the rater's ``rating``; absent raters count
    as empty masks and rating 0, negative ratings are left out of the mean.
    """
    kept = votes.groupBy("case_id", "region", *AXES).agg((F.count(F.lit(1)) / raters).alias("share")).filter(F.col("share") >= 0.5)
    per_rater = votes.select("case_id", "region", "rater", "rating").distinct()
    n, valid = F.count(F.lit(1)), F.count(F.when(F.col("rating") > -1, 1))
    mean = F.sum(F.when(F.col("rating") > -1, F.col("rating"))) / (valid + (raters - n))
    labels = per_rater.groupBy("case_id", "region").agg(mean.alias("rating")).withColumn("label", (F.col("rating") >= rating_limit).cast("long"))
    return kept.drop("share"), labels.join(kept.select("case_id", "region").distinct(), ["case_id", "region"], "left_semi")


def ball_to_voxels(annotations: DataFrame, cases: DataFrame, spacing: Sequence[str], origin: Sequence[str]) -> DataFrame:
    """Voxels whose centre lies within ``radius`` of a world-space centre (wx, wy, wz)."""
    j = annotations.join(cases.select("case_id", *spacing, *origin), "case_id")
    for a, s, o in zip("xyz", spacing, origin):
        low = F.ceil((F.col(f"w{a}") - F.col("radius") - F.col(o)) / F.col(s))
        high = F.floor((F.col(f"w{a}") + F.col("radius") - F.col(o)) / F.col(s))
        # an annotation thinner than the spacing covers no voxel centre on this axis
        span = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        j = j.withColumn(a, F.explode(span))
    d = [F.col(a) * F.col(s) + F.col(o) - F.col(f"w{a}") for a, s, o in zip("xyz", spacing, origin)]
    return j.filter(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= F.col("radius") * F.col("radius")).select(
        *annotations.columns, "z", "y", "x"
    )


def index_to_world(points: DataFrame, cases: DataFrame, spacing: Sequence[str], origin: Sequence[str], direction: Sequence[str] | None = None) -> DataFrame:
    """Physical position of voxel coordinates (px, py, pz): origin + direction · (index · spacing)."""
    cols = [*spacing, *origin, *(direction or [])]
    j = points.join(cases.select("case_id", *cols), "case_id")
    scaled = [F.col(f"p{a}") * F.col(s) for a, s in zip("xyz", spacing)]
    out = []
    for i, (a, o) in enumerate(zip("xyz", origin)):
        term = scaled[i] if direction is None else sum([F.col(direction[3 * i + k]) * scaled[k] for k in (1, 2)], F.col(direction[3 * i]) * scaled[0])
        out.append((term + F.col(o)).alias(f"world_{a}"))
    return j.select(*points.columns, *out)


def object_crops(voxels: DataFrame, keys: Sequence[str], size: Mapping[str, int]) -> DataFrame:
    """One window per object: int(centroid) ± half the size."""
    c = centroid(voxels, keys)
    half = {a: s // 2 for a, s in size.items()}
    mid = {a: F.floor(f"c{a}") for a in size}
    return c.select(
        *keys, *[(mid[a] - half[a]).alias(f"{a}1") for a in size], *[(mid[a] + half[a]).alias(f"{a}2") for a in size]
    )


def mean_probability(rows: DataFrame, models: int, keys: Sequence[str] = (*VOXEL, "class")) -> DataFrame:
    """Mean class probability of several models; a voxel that a model lacks is an error."""
    agg = rows.groupBy(*keys).agg(F.avg("prob").alias("prob"), F.countDistinct("model").alias("_n"))
    complete = F.when(F.col("_n") == models, F.col("prob")).otherwise(F.raise_error(F.lit("a model is missing for a voxel")).cast("double"))
    return agg.select(*keys, complete.alias("prob"))


def softmax_to_detections(probs: DataFrame, min_prob: float | None = None, stuff: Sequence[int] = (), min_voxels: int = 0) -> DataFrame:
    """Boxes with scores out of class probabilities (case_id, z, y, x, class, prob), class 0 being background.

    Each voxel takes its best class (the lowest on ties), or its best foreground class above
    ``min_prob``; classes listed in ``stuff`` are dropped; touching foreground becomes one instance
    with its commonest class, a box and the largest, mean, median and 95th-percentile probability.
    """
    pool = probs if min_prob is None else probs.filter((F.col("class") > 0) & (F.col("prob") > min_prob))
    best = pool.groupBy(*VOXEL).agg(F.max_by(F.struct("class", "prob"), F.struct("prob", -F.col("class"))).alias("b"))
    fg = best.select(*VOXEL, "b.class", "b.prob").filter((F.col("class") > 0) & ~F.col("class").isin(list(stuff) or [-1]))
    fg = cut_lineage(fg)
    comp = voted_components(fg).filter(F.col("voxels") > min_voxels)
    joined = comp.join(fg.select(*VOXEL, "prob").hint("merge"), list(VOXEL))
    keys = ["case_id", "instance_id", "class"]
    q = F.percentile("prob", F.array(F.lit(0.5), F.lit(0.95)))
    scores = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("voxels"), F.max("prob").alias("score"), F.avg("prob").alias("score_mean"), q.alias("_q"),
        *[F.min(a).cast("double").alias(f"{a}1") for a in "xyz"], *[(F.max(a) + 1).cast("double").alias(f"{a}2") for a in "xyz"],
    )
    return scores.withColumn("score_median", F.col("_q")[0]).withColumn("score_p95", F.col("_q")[1]).drop("_q")
