"""Readers, writers and checks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from boxtally.sources import readers as R
from boxtally.sources import writers as W
from boxtally.operators.matching import greedy_match
from boxtally.streaming import jobs as J


def test_predictions_round_trip_and_reject(spark, tmp_path):
    good = {"case_id": "a", "pred_boxes": [[0, 0, 1, 1, 0, 1]], "pred_scores": [0.5], "pred_labels": [0], "pred_grade_probs": [[0.1, 0.2, 0.3, 0.4]]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    assert R.read_detections(spark, str(tmp_path / "a.json")).first()["score"] == 0.5
    for change, rule in (({"pred_scores": [1.5]}, "bad_score"), ({"pred_labels": [0, 1]}, "length_mismatch"), ({"pred_scores": None}, "missing_key")):
        (tmp_path / "b.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError, match=rule):
            R.read_detections(spark, str(tmp_path / "b.json"))


def test_splits_need_exact_keys_and_five_folds(spark, tmp_path):
    five = [{"train": ["a"], "val": ["b"]}] * 5
    path = tmp_path / "s.json"
    path.write_text(json.dumps(five, indent=1))
    assert R.read_splits(spark, str(path)).count() == 10
    for bad in (five[:4], [five[0] | {"test": ["c"]}] + five[1:]):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            R.read_splits(spark, str(path))


def test_audit_header_drift_fails(spark, tmp_path):
    path = tmp_path / "audit.csv"
    path.write_text("case_id,other\na,1\n")
    with pytest.raises(Exception):
        R.read_audit_csv(spark, str(path)).collect()


def test_write_once_refuses(spark, tmp_path):
    df = spark.range(3)
    W.write_once(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)already exists"):
        W.write_once(df, str(tmp_path / "o"))


def test_scan_by_name(spark, tmp_path):
    for name in ("p1_s1_0000.nii", "p1_s1_0001.nii", "p2_s9_0000.nii", "notes.txt"):
        (tmp_path / name).write_text("x")
    files = R.scan_files(spark, str(tmp_path), "*.nii")
    assert sorted((r["case_id"], r["modality"]) for r in files.collect()) == [("p1_s1", 0), ("p1_s1", 1), ("p2_s9", 0)]
    assert R.duplicate_files(files).count() == 0


def test_marksheet_entries(spark):
    sheet = spark.createDataFrame([("1", "2", "3, N/A,,2 ", 3), ("1", "3", None, 0)], "patient_id string, study_id string, lesion_ISUP string, case_ISUP long")
    out = R.explode_marksheet(sheet).orderBy("case_id", "position").collect()
    assert [(r["case_id"], r["entry"], r["grade"]) for r in out] == [("1_2", "3", 3), ("1_2", "N/A", None), ("1_2", "2", 2), ("1_3", None, None)]


def test_label_maps_must_agree(spark):
    ddl = "case_id string, instances map<string,long>, grades map<string,long>, grade_sources map<string,string>, grade_supervised map<string,boolean>"
    df = spark.createDataFrame([("a", {"1": 0}, {"1": 3}, {"1": "x"}, {"1": True}), ("b", {"1": 0}, {"2": 3}, {}, {"1": False})], ddl)
    assert [r["case_id"] for r in R.instance_violations(df).collect()] == ["b"]
    assert R.explode_instances(df.filter("case_id = 'a'")).first()["grade"] == 3


def arrive(spark, folder, name, rows):
    spark.createDataFrame(rows, "arm string, fold long, case_id string, kind string, arrived string").select(
        "arm", "fold", "case_id", "kind", F.to_timestamp("arrived").alias("arrived")
    ).coalesce(1).write.mode("append").parquet(f"{folder}")


def test_fold_waits_for_all_arms_and_the_exact_set(spark, tmp_path):
    arms, folder, out, ckpt = ["x", "y"], str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    expected = spark.createDataFrame([(a, 0, c) for a in arms for c in "ab"], "arm string, fold long, case_id string")
    counts = J.expected_counts(expected)
    at = "2024-01-01 00:00:00"

    def step(rows):
        arrive(spark, folder, "f", rows)
        stream = spark.readStream.schema("arm string, fold long, case_id string, kind string, arrived timestamp").parquet(folder)
        J.append_batches(J.arrival_status(stream, expected), out, ckpt, "update").awaitTermination()
        return J.ready_folds(J.latest(spark.read.parquet(out), ["fold", "arm"]), counts).first()["ready"]

    assert step([("x", 0, "a", "case", at), ("x", 0, "m", "marker", at)]) is False
    assert step([("x", 0, "a", "case", at), ("x", 0, "b", "case", at)]) is False
    assert step([("y", 0, c, "case", at) for c in "ab"] + [("y", 0, "m", "marker", at)]) is True
    assert step([("y", 0, "m", "marker_removed", at)]) is False
    assert step([("y", 0, "m", "marker", "2024-01-01 00:00:05")]) is True
    assert step([("y", 0, "z", "case", at)]) is False


def test_pool_only_once(spark, tmp_path):
    status = spark.createDataFrame([(0, True), (1, False)], "fold long, ready boolean")
    path = str(tmp_path / "pooled")
    expected = spark.createDataFrame([(0,), (1,), (1,)], "fold long")
    assert J.pool_when_done(status, expected, lambda: spark.range(1), path) is False
    done = status.withColumn("ready", F.lit(True))
    assert J.pool_when_done(done, expected, lambda: spark.range(1), path) is True
    assert J.pool_when_done(done, expected, lambda: spark.range(1), path) is False


def test_case_over_two_batches_is_matched_once(spark, make, tmp_path):
    box = (0.0, 0.0, 4.0, 4.0, 0.0, 4.0)
    gts = make.gts([("a", 1, 0, 2, True, False, *box)])
    folder, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for det in ((1, 0.4), (2, 0.9)):
        make.dets([("a", det[0], 0, det[1], *box)]).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        J.incremental_evaluation(stream, gts, lambda d, g: greedy_match(d, g, 0.5), out, ckpt).awaitTermination()
    got = {r["det_id"]: r["gt_id"] for r in J.newest_cases(spark.read.parquet(f"{out}/events")).collect()}
    assert got == {1: None, 2: 1}


def test_patience_does_not_depend_on_transfer_chunks(spark, tmp_path):
    rows = [(1, s, v) for s, v in enumerate([1.0, 3.0, 2.0, float("nan"), 2.5, 4.0, 1.0, 1.0, 1.0, 9.0])]
    spark.createDataFrame(rows[::-1], "run long, step long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        stream = spark.readStream.schema("run long, step long, value double").parquet(str(tmp_path / "in"))
        J.append_batches(J.patience_stream(stream, 3), str(tmp_path / "out"), str(tmp_path / "ck"), "update").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.parquet(str(tmp_path / "out")).first()
    assert (got["best"], got["idle_steps"], got["fired"], got["step"]) == (4.0, 3, True, 9)
