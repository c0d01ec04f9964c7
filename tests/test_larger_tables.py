"""Queries on odd and larger tables: own rows, and what used to fail on them."""

import datetime
import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxtally.functions.values import draw, draws
from boxtally.operators import audit as Q
from boxtally.operators import stats as ST
from boxtally.operators import voxels as V
from boxtally.operators.distance import distance_to_mask
from boxtally.operators.order_stats import exact_quantiles
from boxtally.plans import source_queries as SQ
from boxtally.plans.catalogue import QUERIES
from boxtally.sources.derived import Tables

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events_dir(spark, folder, n, value=lambda i: float(i % 400), ts=lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)):
    rows = [(i, ts(i), i % 7, "abc"[i % 3], value(i), None) for i in range(n)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_scores_above_one_come_back_from_prediction_files(spark, tmp_path):
    folder = events_dir(spark, tmp_path, 60, value=lambda i: 560.21 if i == 3 else float(i))
    got = QUERIES["s1_read_detections"](spark, folder).collect()
    want = {round(r.score, 6) for r in Tables(spark, folder).det.collect()}
    assert len(got) == 48 and {r.score for r in got} == want and max(want) > 1


@pytest.mark.parametrize("null_ts", [False, True])
def test_stream_holds_every_event_in_order_of_time(spark, tmp_path, null_ts):
    folder = events_dir(spark, tmp_path, 40, **({"ts": lambda i: None} if null_ts else {}))
    SQ.event_stream(Tables(spark, folder))
    counters = QUERIES["t3_running_counters"](spark, folder).agg(F.sum("n")).first()[0]
    assert counters == 40


def test_voxels_are_neither_shuffled_nor_broadcast_to_meet_those_of_their_case(spark, tmp_path):
    t = Tables(spark, events_dir(spark, tmp_path, 400))
    gland = t.voxels.filter("label = 0").select("case_id", "z", "y", "x").distinct()
    met = t.voxels.filter("label = 1").join(gland, ["case_id", "z", "y", "x"], "left").groupBy("case_id", "z", "y", "x").count()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM")


def test_dilation_sweep_is_the_city_block_distance(spark):
    gland = {(0, 0, 0), (0, 0, 1), (4, 2, 1)}
    spots = [(z, y, x) for z in range(6) for y in range(4) for x in range(5)]
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "case_id long, z long, y long, x long")
    got = V.dilation_sweep(frame(spots), frame(gland)).first()
    near = [min(sum(abs(a - b) for a, b in zip(s, g)) for g in gland) for s in spots]
    for k in range(4):
        assert got[f"containment_{k}"] == pytest.approx(sum(r <= k for r in near) / len(near))
    plan = V.dilation_sweep(frame(spots), frame(gland))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate explode(array(struct(d, -3") == 3


def test_temperature_fit_shuffles_sums_only(spark):
    rows = spark.createDataFrame([(2 + i % 4, 0.4, 0.3, 0.2, 0.1) for i in range(200)], "true long, p2 double, p3 double, p4 double, p5 double")
    fit = ST.fit_temperature(rows, ["p2", "p3", "p4", "p5"], steps=101)
    assert "Generate" not in fit._jdf.queryExecution().executedPlan().toString()
    found = fit.first()
    mean = lambda t: sum(math.log(sum(p ** (1 / t) for p in (0.4, 0.3, 0.2, 0.1))) - math.log(q) / t for q in (0.4, 0.3, 0.2, 0.1)) / 4
    grid = [0.05 * 400.0 ** (i / 100) for i in range(101)]
    assert found.temperature == pytest.approx(min(grid, key=mean)) and found.nll == pytest.approx(min(map(mean, grid)))
    empty = ST.fit_temperature(rows.filter(F.col("true") == 9), ["p2", "p3", "p4", "p5"])
    assert empty.first().temperature is None


@pytest.mark.parametrize("keys", [[], ["subgroup"]])
def test_draws_of_the_bootstrap_are_dealt_out_before_they_are_made(spark, keys):
    patients = spark.range(50).select(F.col("id").alias("patient_id"), F.lit("all").alias("subgroup"))
    hits = ST.bootstrap_hits(patients, 20, keys)
    assert hits.select(F.sum(F.size("hits"))).first()[0] == 50 * 20
    plan = hits._jdf.queryExecution().executedPlan().toString()
    made = plan[plan.index("Generate explode") :]
    assert made.index("REPARTITION_BY_NUM") < made.index("Window")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_values_of_many_groups_are_not_broadcast(spark):
    rows = spark.range(200).select((F.col("id") % 20).alias("k"), F.col("id").cast("double").alias("v"))
    got = exact_quantiles(rows, ["k"], "v", [0.5])
    assert "Broadcast" not in plan_of(got)
    assert {r.k: r.q[0] for r in got.collect()} == {k: k + 90.0 for k in range(20)}


def test_voxels_behind_a_join_and_tiles_are_not_broadcast(spark):
    spots = spark.createDataFrame([(1, z, y, x) for z in range(2) for y in range(3) for x in range(4)], "case_id long, z long, y long, x long")
    codes = spots.join(spots.filter("x < 2"), ["case_id", "z", "y", "x"], "left").withColumn("anatomy", F.lit(1).cast("long"))
    source = spots.select(F.lit(7).alias("source_id"), "z", "y", "x")
    places = spark.createDataFrame([(5, 7, 1, 0, 0, 1)], "placement_id long, source_id int, case_id long, dz int, dy int, dx int")
    got = V.occupancy(source, codes, places, F.lit(1))
    joins = [line for line in plan_of(got).splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0] and got.first().gland_fraction == 0.75
    cases = spark.createDataFrame([(1, 1.0, 1.0, 2.0)], "case_id long, sx double, sy double, sz double")
    far = distance_to_mask(spots.filter("x = 3"), spots.filter("x = 0"), cases, ("sx", "sy", "sz"))
    assert "BroadcastHashJoin" not in plan_of(far) and {r.dist for r in far.collect()} == {3.0}


def test_draws_of_the_patients_are_not_broadcast(spark):
    whole = lambda n: F.lit(n).cast("long")
    pairs = spark.range(90).select((F.col("id") % 30).alias("patient_id"), whole(2).alias("true"), whole(3).alias("predicted"))
    got = ST.resampled_confusion(pairs, ST.bootstrap_hits(pairs, 20), 20)
    assert "BroadcastHashJoin" not in plan_of(got) and got.filter("b >= 0").agg(F.sum("n")).first()[0] == 20 * 90


def test_containment_is_worked_out_once_for_the_gate(spark):
    cases = spark.range(9).select(F.when(F.col("id") >= 0, 1 - F.col("id") / 100).alias("containment"), F.lit(None).cast("double").alias("p95_mm"))
    gate = Q.containment_gate(cases)
    assert "Range" not in plan_of(gate) and gate.first().median == pytest.approx(0.96)


def test_retention_is_checked_in_one_pass_with_repeated_and_null_cases(spark):
    stages = [f"{s}_{m}" for s in Q.STAGES for m in ("voxels", "components")]
    full, gone, none = [9, 2] * 4, [9, 2, 9, 2, 9, 2, 0, 0], [0] * 8
    rows = [(1, "odd", full), (1, "fully_retained", none), (2, "excluded_no_retained_voxels", gone), (3, "negative", full), (4, None, full),
            (5, "fully_retained", full), (None, "partially_clipped", full), (None, "odd", full)]
    audit = spark.createDataFrame([(c, s, *v) for c, s, v in rows], "case_id long, status string, " + ", ".join(f"{s} long" for s in stages))
    ids = lambda *i: spark.createDataFrame([(n,) for n in i], "case_id long")
    got = Q.check_retention(audit, ids(1, 2, 2, 3, 6, None), ids(1, 2, 2), ids(2, None))
    want = [(1, "duplicate_case"), (None, "duplicate_case"), (1, "unknown_status"), (1, "unknown_status"), (1, "status_disagrees"), (3, "status_disagrees"),
            (4, "not_in_manifest"), (5, "not_in_manifest"), (None, "not_in_manifest"), (6, "not_in_audit"), (None, "not_in_audit"),
            (2, "excluded_but_in_data"), (2, "excluded_but_in_folds"), (5, "retained_but_missing"), (None, "retained_but_missing")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "Join" not in plan_of(got)
    many = audit.filter("status = 'odd' AND case_id = 1").crossJoin(spark.range(5000)).drop("id")
    assert Q.check_retention(many, ids(1), ids(), ids()).filter("rule = 'unknown_status'").count() == 5000


def test_components_are_counted_in_runs_and_labelled_once(spark):
    spots = [(1, "a", 0, 0, x) for x in (0, 0, 1, 2, 5, 5)] + [(1, "a", 1, 1, 3), (1, "b", 0, 0, 0), (None, "a", 0, 0, 0)]
    voxels = spark.createDataFrame(spots, "case_id long, stage string, z long, y long, x long")
    stats, counts = V.retention_stats(voxels), V.region_counts(voxels, ("case_id", "stage"))
    assert {tuple(r) for r in stats.collect()} == {(1, "a", 5, 2), (1, "b", 1, 1)}
    assert {tuple(r) for r in counts.collect()} == {(1, "a", 2, False), (1, "b", 1, True)}
    assert "explode" not in plan_of(stats) + plan_of(counts)
    got = V.connected_voxels(voxels, ("case_id", "stage"))
    assert "MapInPandas" not in plan_of(got)
    assert sorted((r.stage, r.instance_id, r.z, r.y, r.x, r.voxels) for r in got.collect()) == [
        ("a", 1, 0, 0, 0, 4), ("a", 1, 0, 0, 1, 4), ("a", 1, 0, 0, 2, 4), ("a", 1, 1, 1, 3, 4), ("a", 2, 0, 0, 5, 1), ("b", 1, 0, 0, 0, 1)]


def test_rows_outside_go_along_with_their_voxels_to_the_distance(spark):
    ddl = "case_id long, gt_id long, grade long, z long, y long, x long"
    spots = [(1, g, 2, z, y, x) for g in (1, 2) for z in (-2, 0, 3) for y in (-1, 70) for x in (-17, 0, 40)] + [(1, 1, 2, 0, 0, 0)] * 2 + [(1, 1, 2, 1, 1, 2), (2, 3, None, 0, 0, 0), (None, 4, 2, 0, 0, 0)]
    gland = [(1, 1, 1, 2), (1, 5, -3, 30), (1, 5, 90, -40), (3, 0, 0, 0), (None, 0, 0, 0)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    cases = frame([(1, 0.5, 0.75, 3.0), (2, 1.0, 1.0, 1.0)], "case_id long, sx double, sy double, sz double")
    got = V.outside_distance(frame(spots, ddl), frame(gland, "case_id long, z long, y long, x long"), cases, ("sx", "sy", "sz"))
    assert got.columns == ["case_id", "z", "y", "x", "gt_id", "grade", "dist"]
    near = lambda z, y, x: min(math.dist((z * 3, y * 0.75, x * 0.5), (c * 3, b * 0.75, a * 0.5)) for k, c, b, a in gland if k == 1)
    want = [(c, z, y, x, g, r, round(near(z, y, x), 9) if c == 1 else None) for c, g, r, z, y, x in spots if (c, z, y, x) != (1, 1, 1, 2)]
    assert sorted((tuple(r[:6]) + (r.dist and round(r.dist, 9),) for r in got.collect()), key=str) == sorted(want, key=str)
    # the voxels outside are found once, and no join brings them together with their distances
    assert plan_of(got).count("LeftAnti") == 0 and "z#" not in "".join(line for line in plan_of(got).splitlines() if "Join" in line)


def test_draws_on_arrays_equal_the_column(spark):
    js = spark.range(1005).select(draw(F.lit(17), F.col("id")).alias("d"), "id").orderBy("id")
    assert draws(17, 1005).tolist() == [r.d for r in js.collect()]
    late = int(hashlib.md5(b"2026|1999|100001").hexdigest()[:15], 16)
    assert draws(1999, 100_002)[-1] == late and draws(3, 0).size == 0


def macro_auroc(rows, hits, columns):
    """``rows`` has (patient, true, four scores); null scores come first, NaN last."""
    place = lambda p: (-1, 0.0) if p is None else (1, 0.0) if math.isnan(p) else (0, p)
    found = []
    for g, c in zip((2, 3, 4, 5), columns):
        pos = [(place(r[2 + c]), hits[r[0]]) for r in rows if r[1] == g]
        neg = [(place(r[2 + c]), hits[r[0]]) for r in rows if r[1] != g]
        n = sum(w for _, w in pos) * sum(w for _, w in neg)
        if n:
            found.append(sum(w * v * ((p > q) + (p == q) / 2) for p, w in pos for q, v in neg) / n)
    return sum(found) / len(found) if found else None


def test_macro_auroc_makes_its_draws_in_the_tasks(spark):
    """Groups of their own sizes, a null group, patient and grade, a patient without rows, scores that are null, NaN or minus zero."""
    odd = [None, float("nan"), -0.0, 0.0, 0.5, 0.25]
    rows = [(s, i % 7, 2 + i * 5 % 11 % 4 if i % 9 else 1, *[odd[(i * m + i // 4) % 6] if i % 2 else i * m % 13 / 16 for m in (1, 3, 5, 7)])
            for s, n in (("x", 60), ("y", 25)) for i in range(n)]
    rows += [("z", 1, 2, 0.1, 0.2, 0.3, 0.4), ("x", None, 3, 0.1, 0.2, 0.3, 0.4), ("y", 2, None, 0.1, 0.2, 0.3, 0.4), (None, 2, 3, 0.1, 0.2, 0.3, 0.4)]
    pairs = spark.createDataFrame(rows, "subgroup string, patient_id long, true long, p2 double, p3 double, p4 double, p5 double")
    patients = spark.createDataFrame([(r[0], r[1]) for r in rows] + [("x", 99)], "subgroup string, patient_id long")
    hits = ST.bootstrap_hits(patients, 9, ["subgroup"])
    got = ST.resampled_macro_auroc(pairs, hits, 9, {"a": ["p2", "p3", "p4", "p5"], "b": ["p3", "p4", "p5", "p2"]}, ["subgroup"])
    assert "md5" not in plan_of(got) and "md5" not in plan_of(hits.select("subgroup", "patient_id", "idx", "of")) and "md5" in plan_of(hits)
    want = {}
    for s in "xyz":
        ids = sorted({p for g, p in patients.collect() if g == s}, key=lambda p: (p is not None, p or 0))
        for b in range(-1, 9):
            drawn = Counter(int(hashlib.md5(f"2026|{b}|{j}".encode()).hexdigest()[:15], 16) % len(ids) for j in range(len(ids)))
            weight = {p: drawn[i] if b >= 0 else 1 for i, p in enumerate(ids)} | {None: 0}
            mine = [r[1:] for r in rows if r[0] == s and r[2] is not None]
            want |= {(s, b, m): macro_auroc(mine, weight, c) for m, c in (("a", (0, 1, 2, 3)), ("b", (1, 2, 3, 0)))}
    found = {(r.subgroup, r.b, r.model): r.auroc for r in got.collect()}
    assert found.keys() == want.keys() and want["z", -1, "a"] is None
    assert {k: v and pytest.approx(v, abs=1e-12) for k, v in want.items()} == found


@pytest.mark.parametrize("scores", [3, 1_000_003])
def test_macro_auroc_of_several_chunks(spark, scores):
    base = spark.range(24_000).select((F.col("id") % 50).alias("patient_id"), (2 + F.col("id") % 5).alias("true"), *[
        (F.expr(f"id * {k} % 104729 % {scores}") / 8.0).alias(f"p{g}") for g, k in zip((2, 3, 4, 5), (3, 5, 7, 11))])
    models = {"a": ["p2", "p3", "p4", "p5"]}
    got = ST.resampled_macro_auroc(base, ST.bootstrap_hits(base, 3), 3, models)
    want = ST.weighted_macro_auroc(base, ST.bootstrap_weights(base, 3, point=True), models)
    value = lambda df: {r.b: r.auroc for r in df.collect()}
    assert value(got) == pytest.approx(value(want), abs=1e-12)
    empty = base.filter("patient_id < 0")
    assert ST.resampled_macro_auroc(empty, ST.bootstrap_hits(empty, 3), 3, models).count() == 0


def test_voxels_of_a_softmax_and_their_votes_are_not_broadcast(spark):
    """Two instances of case 1, the first of both classes; background and a voxel of another case."""
    spots = {(1, 0, 0, 0): (1, 0.5), (1, 0, 0, 1): (1, 0.75), (1, 0, 1, 1): (2, 0.9), (1, 4, 4, 4): (2, 0.6), (1, 0, 0, 3): (0, 0.95), (2, 0, 0, 0): (1, 0.7)}
    rows = [(*at, c, p if c == best else (1 - p) / 3) for at, (best, p) in spots.items() for c in range(3)]
    got = V.softmax_to_detections(spark.createDataFrame(rows, "case_id long, z long, y long, x long, class long, prob double"))
    assert "Broadcast" not in plan_of(got)
    found = {(r.case_id, r.instance_id): (r["class"], r.voxels, r.score, round(r.score_mean, 9), r.x1, r.x2, r.z2) for r in got.collect()}
    assert found == {(1, 1): (1, 3, 0.9, round(2.15 / 3, 9), 0.0, 2.0, 1.0), (1, 2): (2, 1, 0.6, 0.6, 4.0, 5.0, 5.0), (2, 1): (1, 1, 0.7, 0.7, 0.0, 1.0, 1.0)}


@pytest.mark.parametrize("name", ["p13_paired_bootstrap_delta", "p14_verdict", "p12_bootstrap_auroc"])
def test_queries_over_resampled_aurocs_shuffle_no_draws(spark, tmp_path, name):
    got = QUERIES[name](spark, events_dir(spark, tmp_path, 600))
    assert "md5" not in plan_of(got) and "hits" not in plan_of(got)
