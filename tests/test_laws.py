"""Laws: both ways of an operator agree, results do not depend on layout, brute force agrees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtally.operators import suppress as D
from boxtally.operators import voxels as V
from boxtally.operators.assign import iou_assign, nearest_k
from boxtally.operators.curves import number_rows, patience, running_totals, top_k
from boxtally.operators.graph import connected_components
from boxtally.operators.matching import coco_match, first_fit_match, greedy_match
from boxtally.operators.pairs import iou_join, neighbour_count, pairwise_iou_stats


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def scene(make):
    """One case holds a third of all boxes, and a stack of identical boxes."""
    rng = random.Random(7)

    def place(span):
        x, y, z = (rng.randrange(-4, span) for _ in range(3))
        return (float(x), float(y), float(x + rng.randrange(3, 8)), float(y + rng.randrange(3, 8)), float(z), float(z + rng.randrange(3, 6)))

    dets, gts = [], []
    for i in range(360):
        case = "hot" if i % 3 == 0 else f"c{i % 11}"
        box = (1.0, 1.0, 6.0, 6.0, 1.0, 5.0) if i % 9 == 0 else place(30)
        dets.append((case, i, i % 2, rng.randrange(40) / 40, *box))
    for i in range(120):
        case = "hot" if i % 3 == 0 else f"c{i % 11}"
        gts.append((case, i, i % 2, 2 + i % 4, i % 5 != 0, i % 7 == 0, *place(20)))
    gts.append(("hot", 500, 0, 2, True, False, 1.0, 1.0, 6.0, 6.0, 1.0, 5.0))
    gts.append(("hot", 501, 0, 2, True, False, 1.0, 1.0, 6.0, 6.0, 1.0, 5.0))
    return make.dets(dets).cache(), make.gts(gts).cache()


@pytest.mark.parametrize("match", [
    lambda d, g, n: greedy_match(d, g, 0.1, max_group=n), lambda d, g, n: first_fit_match(d, g, 0.1, max_group=n),
    lambda d, g, n: coco_match(d, g, [0.1, 0.3], max_detections=200, max_group=n),
])
def test_fold_equals_rounds(scene, match):
    d, g = scene
    one_pass, rounds = rows(match(d, g, 10_000)), rows(match(d, g, 50))
    assert one_pass == rounds and any(None not in r for r in one_pass)


def brute_greedy(d, g, thr):
    def iou(a, b):
        inter = 1.0
        for lo, hi in (("x1", "x2"), ("y1", "y2"), ("z1", "z2")):
            inter *= max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))
        vol = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]) * (r["z2"] - r["z1"])
        return inter / (vol(a) + vol(b) - inter)

    used, out = set(), {}
    for a in sorted(d, key=lambda r: (-r["score"], r["det_id"])):
        best = max(((iou(a, b), -b["gt_id"]) for b in g if b["case_id"] == a["case_id"] and b["gt_id"] not in used), default=(0, 0))
        if best[0] >= thr:
            used.add(-best[1])
            out[a["det_id"]] = -best[1]
        else:
            out[a["det_id"]] = None
    return out


@pytest.mark.parametrize("limit", [10_000, 50])
def test_greedy_against_brute_force(scene, limit):
    d, g = scene
    got = {r["det_id"]: r["gt_id"] for r in greedy_match(d, g, 0.2, max_group=limit).collect()}
    assert got == brute_greedy(d.collect(), g.collect(), 0.2)


@pytest.mark.parametrize("op", [
    lambda d, n: D.nms(d, 0.2, max_group=n), lambda d, n: D.batched_nms(d, 0.2, max_group=n),
    lambda d, n: D.weighted_box_clustering(d.withColumn("weight", F.lit(1.0)).withColumn("n_expected", F.lit(3.0)), 0.2, max_group=n).select("det_id", "members", F.round("score", 9)),
])
def test_suppression_fold_equals_rounds(scene, op):
    d, _ = scene
    assert rows(op(d, 10_000)) == rows(op(d, 20))


def test_empty_boxes_are_never_suppressed(make):
    flat = (1.0, 1.0, 1.0, 6.0, 1.0, 5.0)
    d = make.dets([("a", i, 0, 0.5, *flat) for i in range(4)])
    assert D.nms(d, 0.2).count() == 4 and D.nms(d, 0.2, max_group=2).count() == 4


def test_grid_join_equals_plain_join(scene):
    d, g = scene
    cols = ["case_id", "a_det_id", "b_gt_id", "iou"]
    plain = rows(iou_join(d, g).select(*cols))
    for cell in (5.0, 32.0):
        assert rows(iou_join(d, g, cell=cell).select(*cols)) == plain


def test_pair_statistics_count_copies(scene):
    d, _ = scene
    got = {r["case_id"]: r for r in pairwise_iou_stats(d, ["case_id"], "det_id").collect()}
    plain = iou_join(d, d).filter("a_det_id <> b_det_id").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("iou").alias("s")).collect()
    for r in plain:
        assert got[r["case_id"]]["overlapping_pairs"] == r["n"]
        assert got[r["case_id"]]["mean_iou"] * got[r["case_id"]]["pairs"] == pytest.approx(r["s"])


def test_neighbours_count_copies(scene):
    d, _ = scene
    got = {r["det_id"]: r["neighbours"] for r in neighbour_count(d, [10.0, 10.0, 10.0], id_col="det_id").collect()}
    data = d.collect()
    mid = lambda r: ((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2, (r["z1"] + r["z2"]) / 2)
    for a in data[:60]:
        near = sum(1 for b in data if b["case_id"] == a["case_id"] and all(abs(p - q) <= 5 for p, q in zip(mid(a), mid(b))))
        assert got[a["det_id"]] == near


def test_assignment_does_not_depend_on_grid(scene):
    d, g = scene
    assert rows(iou_assign(d, g, 0.1, 0.3, best_per_gt=True)) == rows(iou_assign(d, g, 0.1, 0.3, best_per_gt=True, cell=4.0))


@pytest.mark.parametrize("how", ["sum", "max"])
def test_two_level_totals_equal_window(spark, how):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.expr("id * 7919 % 5000").alias("o"), (F.col("id") % 13).alias("v"))
    run = lambda large: rows(running_totals(df, ["k"], [F.desc("o")], {"t": "v"}, large, how).select("k", "o", "t"))
    assert run(True) == run(False)


def test_two_level_totals_with_one_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(0.5)).otherwise(F.col("id") / 3000.0).alias("s"), F.col("id"), F.lit(1).alias("one"))
    run = lambda large: rows(running_totals(df, [], [F.desc("s"), F.asc("id")], {"t": "one"}, large).select("id", "t"))
    assert run(True) == run(False)


def test_salted_top_k(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), F.col("id"), F.expr("id * 31 % 997").alias("v"))
    got = rows(top_k(df, ["k"], [F.desc("v"), F.asc("id")], 1500).select("k", "id", "rank"))
    want = rows(number_rows(df, ["k"], [F.desc("v"), F.asc("id")], "rank").filter("rank <= 1500").select("k", "id", "rank"))
    assert got == want


def test_patience(spark):
    vals = [1.0, 2.0, 1.5, float("nan"), 2.0, 1.0, 3.0, 2.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(vals)], "run int, step int, v double")
    out = [(r["best"], r["idle_steps"], r["fired"]) for r in patience(df, ["run"], "step", "v", 3).orderBy("step").collect()]
    assert out == [(1, 0, False), (2, 0, False), (2, 1, False), (2, 1, False), (2, 2, False), (2, 3, True), (3, 0, False), (3, 1, False)]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 520)]
    parent = {i: i for i in range(600)}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(600)
    got = {r["id"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in range(600)}


def test_component_fold_equals_rounds(spark):
    rng = random.Random(9)
    edges = [(f"c{i % 5}", rng.randrange(60), rng.randrange(60)) for i in range(200)] + [("long", i, i + 1) for i in range(300)]
    e = spark.createDataFrame(edges, "case_id string, u long, v long")
    n = e.select("case_id", F.col("u").alias("id")).union(e.select("case_id", "v")).distinct()
    assert rows(connected_components(n, e, ["case_id"])) == rows(connected_components(n, e, ["case_id"], max_group=50))


def test_voxel_components_use_corners(spark):
    cubes = [(0, 0, 0), (2, 2, 2), (5, 0, 0)]
    vox = [("a", 1, z + dz, y + dy, x + dx) for z, y, x in cubes for dz in range(2) for dy in range(2) for dx in range(2)]
    v = spark.createDataFrame(vox, "case_id string, class int, z int, y int, x int")
    sizes = V.connected_voxels(v).groupBy("instance_id").count().orderBy("instance_id").collect()
    assert [(r["instance_id"], r["count"]) for r in sizes] == [(1, 16), (2, 8)]
    assert V.connected_voxels(v, min_voxels=8).select("instance_id").distinct().count() == 1


@pytest.mark.parametrize("radius", [1.0, 4.0, 100.0])
def test_nearest_does_not_depend_on_radius(spark, radius):
    rng = random.Random(5)
    pts = lambda n: [("a", i, rng.random() * 40, rng.random() * 40, rng.random() * 10) for i in range(n)]
    left, right = pts(40), pts(60)
    l = spark.createDataFrame(left, "case_id string, lid long, cx double, cy double, cz double")
    r = spark.createDataFrame(right, "case_id string, rid long, cx double, cy double, cz double")
    got = {}
    for row in nearest_k(l, r, ["case_id"], "lid", "rid", 3, radius).collect():
        got.setdefault(row["lid"], set()).add(row["rid"])
    for _, i, *p in left:
        best = sorted(right, key=lambda q: (sum((a - b) ** 2 for a, b in zip(p, q[2:])), q[1]))[:3]
        assert got[i] == {q[1] for q in best}


def test_nearest_with_too_few_partners(spark):
    l = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0), ("b", 2, 0.0, 0.0, 0.0)], "case_id string, lid long, cx double, cy double, cz double")
    r = spark.createDataFrame([("a", 7, 30.0, 0.0, 0.0)], "case_id string, rid long, cx double, cy double, cz double")
    assert [(x["lid"], x["rid"]) for x in nearest_k(l, r, ["case_id"], "lid", "rid", 3, 1.0).collect()] == [(1, 7)]


def test_matching_does_not_depend_on_layout(scene):
    d, g = scene
    one = rows(greedy_match(d.repartition(1), g.repartition(1), 0.1))
    assert one == rows(greedy_match(d.repartition(16), g.repartition(16, "gt_id"), 0.1))


@pytest.mark.parametrize("far", [0, 5000])
def test_distance_to_mask_is_exact(spark, monkeypatch, far):
    """Against all pairs, with rows, slices and tiles of every size, negative coordinates and a case without a mask."""
    from boxtally.operators import distance

    monkeypatch.setattr(distance, "ROWS", 3)
    rng = np.random.default_rng(far)
    spacing = {"a": (0.5, 0.7, 3.0), "b": (1.0, 1.0, 1.0), "c": (2.0, 0.3, 0.9), "none": (1.0, 1.0, 1.0)}
    ask, mask = [], []
    for k, c in enumerate(("a", "b", "c")):
        ask += [(c, *map(int, v)) for v in rng.integers(-40, 60, (80, 3))] * 2
        mask += [(c, *map(int, v)) for v in rng.integers(-20, 30, (1 + 150 * k, 3)) + far]
    ask.append(("none", 1, 2, 3))
    ddl = "case_id string, z int, y int, x int"
    cases = spark.createDataFrame([(c, *s) for c, s in spacing.items()], "case_id string, sx double, sy double, sz double")
    got = distance.distance_to_mask(spark.createDataFrame(ask, ddl), spark.createDataFrame(mask + mask[:5], ddl), cases, ("sx", "sy", "sz"))
    found = {(r.case_id, r.z, r.y, r.x): r.dist for r in got.collect()}
    assert set(found) == {v for v in ask if v[0] != "none"}
    for (c, z, y, x), d in found.items():
        points = np.array([m[1:] for m in mask if m[0] == c])
        steps = (points - (z, y, x)) * np.array(spacing[c][::-1])
        assert d == pytest.approx(np.sqrt((steps**2).sum(axis=1)).min(), rel=1e-12, abs=1e-12)


def test_lower_envelope_of_many_lanes():
    from boxtally.operators.distance import envelope_min

    rng = np.random.default_rng(1)
    count = rng.integers(1, 30, 200)
    position = np.sort(rng.choice(1000, (200, 30)), axis=1) + np.arange(30) / 64
    value = rng.choice([0.0, 1.0, 50.0, 1e4, 1e6], (200, 30)) * rng.random((200, 30))
    lane, query = rng.integers(0, 200, 5000), rng.uniform(-500, 1500, 5000)
    every = np.where(np.arange(30) < count[lane][:, None], value[lane] + (query[:, None] - position[lane]) ** 2, np.inf)
    assert np.allclose(envelope_min(position, value, count, lane, query), every.min(axis=1), rtol=1e-9)


def test_exact_quantiles_equal_percentile(spark):
    """Groups of every size, null keys and values, NaN, equal values, and a group that spans all ranges."""
    from boxtally.operators.order_stats import column_quantiles, exact_quantiles, with_quantiles

    rng = random.Random(2)
    data = [("hot", rng.random() * 100) for _ in range(3000)] + [("equal", 4.0)] * 500 + [(f"g{i % 40}", float(rng.randrange(9))) for i in range(400)]
    data += [(None, float(i)) for i in range(7)] + [("one", -2.5), ("void", None), ("odd", float("nan")), ("odd", 1.0), ("odd", float("inf"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    levels = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    want = df.filter("v is not null").groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in levels])).alias("q"))
    got = exact_quantiles(df, ["k"], "v", levels)
    assert repr(rows(got)) == repr(rows(want))  # NaN equals itself in print only
    numbers = df.filter("not isnan(v)")
    assert exact_quantiles(numbers, [], "v", levels).first()["q"] == numbers.agg(F.percentile("v", F.array(*[F.lit(q) for q in levels]))).first()[0]
    assert exact_quantiles(df.limit(0), [], "v", levels).count() == 0
    each = with_quantiles(df.groupBy("k").agg(F.count("v").alias("n")), df, ["k"], "v", {"median": 0.5})
    assert {r["k"]: r["median"] for r in each.collect()}["void"] is None and each.count() == want.count() + 1
    both = column_quantiles(numbers, {"a": (F.col("v"), 0.5), "b": (F.col("v") * 2, 0.9)})
    assert rows(both) == rows(numbers.agg(F.percentile("v", F.lit(0.5)), F.percentile(F.col("v") * 2, F.lit(0.9))))


def kept_in_order(n, edges):
    """One by one: an item stays unless a better neighbour stayed."""
    blockers, stays = {}, {}
    for u, v in edges:
        blockers.setdefault(v, []).append(u)
    for i in range(n):
        stays[i] = not any(stays[u] for u in blockers.get(i, ()))
    return [i for i in range(n) if stays[i]]


def in_rounds(spark, monkeypatch, groups, limit, components):
    """Kept ids of each group, and how often edges were taken away."""
    from boxtally.operators import graph

    rounds, real = [], graph._without
    monkeypatch.setattr(graph, "_without", lambda *args: rounds.append(1) or real(*args))
    if not components:
        monkeypatch.setattr(graph, "_settle_components", lambda live, *rest: live)
    items = spark.createDataFrame([(k, i) for k, (n, _) in groups.items() for i in range(n)], "k string, id long")
    edges = spark.createDataFrame([(k, u, v) for k, (_, e) in groups.items() for u, v in e], "k string, u long, v long")
    kept = graph.rounds_keep(items, edges, ["k"], limit).collect()
    return {k: sorted(r["id"] for r in kept if r["k"] == k) for k in groups}, len(rounds)


def chain(n, extra=()):
    return n, [(i, i + 1) for i in range(n - 1)] + list(extra)


def test_long_chains_are_settled_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    groups = {"plain": chain(3000), "branches": chain(3000, [(i, i + 5) for i in range(0, 2900, 37)])}
    groups["any"] = 60, sorted({(u, v) for u, v in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if u < v})
    got, rounds = in_rounds(spark, monkeypatch, groups, 100_000, True)
    assert got == {k: kept_in_order(*g) for k, g in groups.items()} and rounds == 1


def test_long_chains_beyond_a_task_are_jumped_along(spark, monkeypatch):
    groups = {"plain": chain(3000), "branches": chain(400, [(100, 150), (200, 260)])}
    got, rounds = in_rounds(spark, monkeypatch, groups, 20, False)
    assert got == {k: kept_in_order(*g) for k, g in groups.items()} and rounds <= 20


def test_components_of_a_large_group_are_settled(spark, monkeypatch):
    parts = [(i, i + 1) for i in range(60) if i % 15 != 14] + [(i, i + 1) for i in range(100, 140)]
    got, _ = in_rounds(spark, monkeypatch, {"x": (150, parts)}, 30, True)
    assert got == {"x": kept_in_order(150, parts)}


@pytest.mark.parametrize("scores", [7, 1])
def test_resamples_in_one_pass_equal_rows_per_patient(spark, scores):
    """Few scores, so that ties go over the ends of ranges; one hot patient; a patient without rows."""
    from boxtally.operators import stats as ST

    n = 12
    base = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("long").alias("patient_id"), (2 + F.col("id") % 4).alias("true"),
        (2 + F.expr("id * 7 % 13 % 4")).alias("predicted"), *[(F.expr(f"id * {k} % 31 % {scores}") / 8.0).alias(f"p{g}") for g, k in zip((2, 3, 4, 5), (3, 5, 7, 11))],
    )
    patients = spark.range(12).select(F.col("id").alias("patient_id"))
    weights, hits = ST.bootstrap_weights(patients, n, point=True), ST.bootstrap_hits(patients, n)
    cells = ["b", "true", "predicted", "n"]
    assert rows(ST.resampled_confusion(base, hits, n).select(*cells)) == rows(ST.weighted_confusion(base, weights).select(*cells))
    models = {"a": ["p2", "p3", "p4", "p5"], "b": ["p5", "p4", "p3", "p2"]}
    value = lambda df: {(r["b"], r["model"]): r["auroc"] for r in df.collect()}
    assert value(ST.resampled_macro_auroc(base, hits, n, models)) == pytest.approx(value(ST.weighted_macro_auroc(base, weights, models)))
    from boxtally.operators.grade_metrics import calibration

    drawn = {(r["b"], r["patient_id"]): r["w"] for r in weights.collect()}
    per = {r["b"]: r for r in ST.resampled_calibration(base, hits, n).collect()}
    for b in (ST.POINT, 0, 5):
        copies = base.crossJoin(F.broadcast(spark.range(n * 4).select(F.col("id").alias("copy"))))
        w = spark.createDataFrame([(p, c) for (x, p), c in drawn.items() if x == b], "patient_id long, w long")
        want = calibration(copies.join(w, "patient_id").filter("copy < w")).first()
        for name in ("n", "brier", "nll", "ece", "mean_confidence"):
            assert per[b][name] == pytest.approx(want[name]), name
