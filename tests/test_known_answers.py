"""Hand-computed answers on tiny tables."""

import pytest
from pyspark.sql import functions as F

from boxtally.operators import audit as Q
from boxtally.operators import case_metrics as CM
from boxtally.operators import curves as W
from boxtally.operators import detection_metrics as DM
from boxtally.operators import grade_metrics as GM
from boxtally.operators import splits as SP
from boxtally.operators import stats as ST
from boxtally.operators import suppress as D
from boxtally.operators.lookups import exclude_cases, grade_labels
from boxtally.operators.matching import coco_match, greedy_match

CUBE2 = (0.0, 0.0, 2.0, 2.0, 0.0, 2.0)
CUBE1 = (0.0, 0.0, 1.0, 1.0, 0.0, 1.0)
FAR = (9.0, 9.0, 11.0, 11.0, 0.0, 2.0)


def gt(i, box, grade=3, supervised=True, ignore=False, case="a", label=0):
    return (case, i, label, grade, supervised, ignore, *box)


def det(i, score, box, case="a", label=0):
    return (case, i, label, score, *box)


@pytest.mark.parametrize("threshold, expected", [(0.5, None), (0.1, 0)])
def test_match_depends_on_threshold(make, threshold, expected):
    m = greedy_match(make.dets([det(0, 0.9, CUBE1)]), make.gts([gt(0, CUBE2)]), threshold).first()
    assert m["gt_id"] == expected


def test_duplicates_become_false_positives(make):
    d = make.dets([det(i, 0.9 - i * 0.1, CUBE2) for i in range(3)])
    rows = greedy_match(d, make.gts([gt(0, CUBE2)]), 0.1).collect()
    assert sorted((r["det_id"], r["gt_id"]) for r in rows if r["gt_id"] is not None) == [(0, 0)]


def test_coco_prefers_regular_and_last_on_ties(make):
    gts = make.gts([gt(0, CUBE2), gt(1, CUBE2), gt(2, CUBE2, ignore=True)])
    d = make.dets([det(i, 0.9 - i * 0.1, CUBE2) for i in range(4)])
    rows = {r["det_id"]: (r["gt_id"], r["ignored"]) for r in coco_match(d, gts, [0.5]).collect()}
    assert rows == {0: (1, False), 1: (0, False), 2: (2, True), 3: (None, False)}


def test_tie_grouped_curve(spark):
    # two tied scores of three rows each, worked out by hand
    rows = [(0.5, "hit"), (0.5, "hit"), (0.5, "miss"), (0.75, "miss"), (0.25, "hit"), (0.25, "miss"), (0.25, "miss"), (1.0, "hit")]
    e = spark.createDataFrame(rows, "score double, kind string").select(
        "score", (F.col("kind") == "hit").cast("long").alias("tp"), (F.col("kind") == "miss").cast("long").alias("fp")
    )
    c = W.tie_grouped_curve(e, [], ["tp", "fp"]).orderBy(F.col("score").desc_nulls_first()).collect()
    assert [(r["score"], r["tp"], r["fp"]) for r in c] == [(None, 0, 0), (1.0, 1, 0), (0.75, 1, 1), (0.5, 3, 2), (0.25, 4, 4)]


@pytest.mark.parametrize("points, target, expected", [
    ([(0, 0), (2, 3), (5, 8)], 4.9, 3.0),  # between two points: the one before counts
    ([(0, 0), (2, 3), (5, 8)], 5.0, 8.0),  # on a point
    ([(0, 0), (3, 1), (3, 4), (3, 6), (9, 7)], 3.0, 6.0),  # a vertical step: its last point
    ([(0, 0), (1, 2)], 100.0, 2.0),  # beyond the end
    ([(0, 0), (7, 5)], 6.0, 0.0),  # before the first detection
])
def test_value_at_budget(spark, points, target, expected):
    rows = [(None if i == 0 else 1.0 / i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    c = spark.createDataFrame(rows, "score double, x double, y double")
    assert W.value_at_budget(c, [], F.col("x"), F.col("y"), [target]).first()["value"] == expected


def _graded_dets(spark, make, rows):
    d = make.dets([r[:10] for r in rows])
    p = spark.createDataFrame([(r[1], "p", *r[10]) for r in rows], "det_id long, patient_id string, p2 double, p3 double, p4 double, p5 double")
    return d.join(p, "det_id")


def test_generic_and_grade_specific_events(spark, make):
    gts = make.gts([gt(0, CUBE2, grade=2, supervised=False), gt(1, FAR, grade=2)])
    d = _graded_dets(spark, make, [(*det(0, 0.9, CUBE2), (1.0, 0.0, 0.0, 0.0)), (*det(1, 0.8, FAR), (1.0, 0.0, 0.0, 0.0))])
    ev = {(r["analysis"], r["det_id"]): r for r in DM.grade_froc_events(d, gts).collect()}
    assert (ev[0, 0]["tp"], ev[0, 0]["fp"], ev[0, 0]["grade"]) == (False, False, None)
    assert (ev[0, 1]["tp"], ev[0, 1]["grade"]) == (True, 2)
    assert (ev[2, 0]["fp"], ev[2, 1]["tp"]) == (True, True)


def test_grade_score_is_product(spark, make):
    d = _graded_dets(spark, make, [(*det(0, 0.9, CUBE2), (0.9, 0.1, 0.0, 0.0)), (*det(1, 0.5, FAR), (0.2, 0.8, 0.0, 0.0))])
    ev = DM.grade_froc_events(d, make.gts([gt(0, CUBE2)])).filter("analysis = 3").orderBy("det_id").collect()
    assert [round(r["score"], 6) for r in ev] == [0.09, 0.4]


def test_pooled_equals_combined(spark, make):
    gts = make.gts([gt(0, CUBE2, grade=2, case="a"), gt(1, CUBE2, grade=3, case="b")])
    rows = [(*det(0, 0.9, CUBE2, "a"), (1.0, 0.0, 0.0, 0.0)), (*det(1, 0.7, FAR, "a"), (1.0, 0.0, 0.0, 0.0)), (*det(2, 0.8, CUBE2, "b"), (0.0, 1.0, 0.0, 0.0))]
    d = _graded_dets(spark, make, rows).withColumn("patient_id", F.col("case_id"))
    people = d.select("patient_id").distinct()
    ev = DM.grade_froc_events(d, gts)
    whole = DM.harmonized_froc(ev, DM.grade_support(gts), people.agg(F.count(F.lit(1)).alias("num_patients")))
    part = lambda c: (ev.filter(F.col("case_id") == c), DM.grade_support(gts.filter(F.col("case_id") == c)), people.filter(F.col("patient_id") == c))
    a, b = part("a"), part("b")
    pooled = DM.harmonized_froc(*DM.pool_fold_events([a[0], b[0]], [a[1], b[1]], [a[2], b[2]]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, pooled.collect()))


def test_grade_matches_counts(spark, make):
    gts = make.gts([gt(0, CUBE2, grade=2), gt(1, FAR, grade=5)])
    p5, p2 = (0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0)
    d = _graded_dets(spark, make, [(*det(0, 0.9, FAR), p5), (*det(1, 0.8, CUBE2), p2), (*det(2, 0.7, (20.0, 20.0, 22.0, 22.0, 0.0, 2.0)), p2)])
    pairs = GM.graded_pairs(GM.match_rows(d, gts)).orderBy(F.desc("score")).collect()
    assert [(r["true"], r["predicted"]) for r in pairs] == [(5, 5), (2, 2)]
    cases = spark.createDataFrame([("a",)], "case_id string")
    row = GM.grade_matches(d, gts, cases).first()
    assert (row["matched"], row["false_positives"], row["misses"]) == (2, 1, 0)
    assert GM.grade_matches(d, gts, cases, min_score=0.85).first()["false_positives"] == 0


def _pairs(spark, rows):
    full = [(t, p, *(probs or [float(p == g) for g in (2, 3, 4, 5)])) for t, p, probs in rows]
    return spark.createDataFrame(full, "true long, predicted long, p2 double, p3 double, p4 double, p5 double")


def test_confusion_mae_adjacent(spark):
    p = _pairs(spark, [(2, 2, None), (3, 2, None), (3, 3, None)])
    m = {(r["true"], r["predicted"]): r["n"] for r in GM.confusion(p).collect()}
    assert len(m) == 16 and (m[2, 2], m[3, 2], m[3, 3]) == (1, 1, 1) and sum(m.values()) == 3
    s = GM.grade_summary(GM.confusion(p)).first()
    assert s["mae"] == pytest.approx(1 / 3) and s["adjacent_accuracy"] == 1


@pytest.mark.parametrize("predicted, sign", [((2, 3, 4, 5), 1), ((5, 4, 3, 2), -1)])
def test_kappa(spark, predicted, sign):
    p = _pairs(spark, [(t, q, None) for t, q in zip((2, 3, 4, 5), predicted)])
    k = GM.grade_summary(GM.confusion(p)).first()["quadratic_kappa"]
    assert (k == 1) if sign > 0 else (k < 0)


def test_summary_auroc_calibration(spark):
    p = _pairs(spark, [(2, 2, (0.8, 0.2, 0.0, 0.0)), (2, 2, (0.9, 0.1, 0.0, 0.0)), (3, 3, (0.2, 0.8, 0.0, 0.0)), (3, 2, (0.7, 0.3, 0.0, 0.0))])
    s = GM.grade_summary(GM.confusion(p)).first()
    assert s["accuracy"] == 0.75 and s["balanced_accuracy"] == 0.75
    assert s["macro_f1"] == pytest.approx((0.8 + 2 / 3) / 2)
    auc = {r["grade"]: r["auroc"] for r in GM.grade_auroc(p).collect()}
    assert auc[2] == 1 and auc[3] == 1 and auc[4] is None
    assert GM.calibration(p).first()["mean_confidence_incorrect"] == pytest.approx(0.7)


@pytest.mark.parametrize("boxes, scores, best", [
    (((0, 0, 3, 3, 0, 3), (1, 1, 5, 5, 1, 5)), (0.2, 0.8), 0.8), (((0, 0, 2, 2, 0, 2), (2, 2, 4, 4, 2, 4)), (0.9, 0.1), 0.9),
])
def test_touching_boxes_merge(spark, make, boxes, scores, best):
    d = make.dets([det(i, s, tuple(map(float, b))) for i, (b, s) in enumerate(zip(boxes, scores))])
    cases = spark.createDataFrame([("a", 4.0, 4.0, 4.0)], "case_id string, shape_x double, shape_y double, shape_z double")
    rows = D.merge_touching(d, cases).collect()
    assert len(rows) == 1 and rows[0]["score"] == best


def test_separate_boxes_stay_apart(spark, make):
    d = make.dets([det(0, 0.9, (0.0, 0.0, 2.0, 2.0, 0.0, 2.0)), det(1, 0.8, (3.0, 0.0, 5.0, 2.0, 0.0, 2.0)), det(2, 0.0, (2.0, 0.0, 3.0, 2.0, 0.0, 2.0))])
    cases = spark.createDataFrame([("a", 9.0, 9.0, 9.0)], "case_id string, shape_x double, shape_y double, shape_z double")
    assert D.merge_touching(d, cases).count() == 2


def test_lesion_dice_half(spark, make):
    gts, d = make.gts([gt(0, CUBE2)]), make.dets([det(0, 0.9, CUBE2)])
    cube = [("a", z, y, x, 0) for z in range(2) for y in range(2) for x in range(2)]
    truth = spark.createDataFrame(cube, "case_id string, z int, y int, x int, gt_id long")
    dice = CM.lesion_dice(d, gts, truth, truth.filter("z = 0")).first()["dice"]
    assert dice == pytest.approx(2 / 3)


def test_excluded_cases_leave_every_fold(spark):
    s = spark.createDataFrame([(0, "train", "a"), (0, "train", "lost"), (0, "val", "b"), (1, "train", "b"), (1, "val", "a"), (1, "val", "lost")], "fold long, role string, case_id string")
    left = exclude_cases(s, spark.createDataFrame([("lost",)], "case_id string")).collect()
    assert sorted((r["fold"], r["role"], r["case_id"]) for r in left) == [(0, "train", "a"), (0, "val", "b"), (1, "train", "b"), (1, "val", "a")]


def test_patient_leak(spark):
    """Fold 4 has one patient on both sides with different studies, fold 5 the same study twice, fold 6 nothing in common."""
    rows = [(4, "train", "n3_left", "n3"), (4, "train", "n5", "n5"), (4, "val", "n3_right", "n3"), (5, "train", "n5", "n5"), (5, "val", "n5", "n5"), (6, "train", "n3_left", "n3"), (6, "val", "n5", "n5")]
    s = spark.createDataFrame(rows, "fold long, role string, case_id string, patient_id string")

    def broken(fold):
        one = s.filter(f"fold = {fold}")
        return {r["rule"] for r in Q.check_splits(one, one.select("case_id").distinct()).collect()} & {"patient_in_both_roles", "case_in_both_roles"}

    assert [broken(f) for f in (4, 5, 6)] == [{"patient_in_both_roles"}, {"patient_in_both_roles", "case_in_both_roles"}, set()]


@pytest.mark.parametrize("voxels, status", [((0, 0, 0, 0), "negative"), ((7, 7, 7, 7), "fully_retained"), ((112, 90, 41, 3), "partially_clipped"), ((5, 4, 1, 0), "excluded_no_retained_voxels")])
def test_retention_status(spark, voxels, status):
    names = ", ".join(f"{s}_{m} int" for m in ("voxels", "components") for s in Q.STAGES)
    row = spark.createDataFrame([("a", *voxels, *(1 if v else 0 for v in voxels))], f"case_id string, {names}")
    assert Q.retention_records(row).first()["status"] == status


def test_feature_readout(spark):
    """Three anchors of one instance, whose mean is (2, 0, 1), and an instance with a single poor one."""
    rows = [
        (31, "q", 70, 0.35, 4, [1.5, 1.0, 0.0]), (32, "q", 70, 0.55, 4, [0.5, -1.0, 2.0]), (33, "q", 70, 0.45, 4, [4.0, 0.0, 1.0]), (40, "r", 71, 0.05, 5, [9.0, 8.0, 7.0]),
    ]
    f = spark.createDataFrame(rows, "row_id long, case_id string, instance_id long, anchor_iou double, grade long, f array<double>")
    assert {r["instance_id"]: r["f"] for r in ST.best_anchor_readout(f).collect()} == {70: [0.5, -1.0, 2.0], 71: [9.0, 8.0, 7.0]}
    assert {r["instance_id"]: r["f"] for r in ST.pooled_readout(f).collect()} == {70: [2.0, 0.0, 1.0], 71: [9.0, 8.0, 7.0]}


def test_stratified_split_is_disjoint_and_complete(spark):
    rows = [(f"p{i}", g, True) for i in range(20) for g in (2, 3, 4, 5)]
    inst = spark.createDataFrame(rows, "patient_id string, grade long, supervised boolean")
    split = SP.stratified_group_split(inst, F.crc32("patient_id"))
    assert split.count() == 20 and split.select("patient_id").distinct().count() == 20
    assert SP.missing_role_grades(split, inst).count() == 0


def test_unknown_class_is_an_error(spark):
    inst = spark.createDataFrame([("a", 1, 7)], "case_id string, instance_id long, class long")
    audit = spark.createDataFrame([], "case_id string, grade long, supervised boolean")
    prior = spark.createDataFrame([], "case_id string, instance_id long, grade long, source string")
    with pytest.raises(Exception, match="unexpected instance class"):
        grade_labels(inst, audit, prior).collect()


def test_verdict(spark):
    df = spark.createDataFrame([(0.8, 0.4), (0.8, 0.6), (0.6, 0.55)], "p double, l double")
    assert [r[0] for r in df.select(ST.verdict(F.col("p"), F.col("l"))).collect()] == ["NULL", "SIGNAL", "INCONCLUSIVE"]
