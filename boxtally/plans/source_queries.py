"""Sources, sinks and streaming jobs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from boxtally.operators.audit import retention_records
from boxtally.operators.matching import greedy_match
from boxtally.plans.audit_queries import _STG
from boxtally.plans.matching_queries import _overview
from boxtally.plans.metric_queries import FOLDS_SQL, fold_table
from boxtally.plans.registry import big, query, r6
from boxtally.plans.sqlparts import R, match_sql
from boxtally.session import cut_lineage, fresh_path
from boxtally.sources import readers as RD
from boxtally.sources import schema as SC
from boxtally.sources import writers as WR
from boxtally.sources.derived import Tables
from boxtally.streaming import jobs as ST


def _packed(df, chunk, id_col, fields):
    """Rows of a chunk of ids as parallel arrays, the layout of a prediction file."""
    rows = df.groupBy(F.expr(chunk).cast("string").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct(id_col, *fields))).alias("r"))
    return rows


_BOX6 = ("x1", "y1", "x2", "y2", "z1", "z2")


@query("s1_read_detections", f"SELECT (det_id//20)::VARCHAR AS case_id, row_number() OVER (PARTITION BY det_id//20 ORDER BY det_id)-1 AS det_id, label, {R('score')} AS score, x1, z2, {R('p3')} AS p3 FROM det")
def _(t):
    # scores of the tables may exceed 1, those of a prediction file may not: they are stored divided by a power of two, which loses no digit
    top = t.det.agg(F.max(F.when(F.abs("score") < float("inf"), F.col("score")))).first()[0]
    unit = 2.0 ** max(0, math.ceil(math.log2(top))) if top and top > 1 else 1.0
    det = t.det.withColumn("probs", F.array("p2", "p3", "p4", "p5")).withColumn("score", F.col("score") / unit)
    rows = _packed(det, "det_id DIV 20", "det_id", ["label", "score", *_BOX6, "probs"])
    files = rows.select(
        "case_id", F.transform("r", lambda e: F.array(*[e[c] for c in _BOX6])).alias("pred_boxes"), F.col("r.score").alias("pred_scores"),
        F.col("r.label").alias("pred_labels"), F.col("r.probs").alias("pred_grade_probs"),
    )
    path = fresh_path(t.spark)
    WR.write_once(files, path, "json")
    d = RD.read_detections(t.spark, path)
    return d.select("case_id", "det_id", "label", r6(F.col("score") * unit, "score"), "x1", "z2", r6(F.col("grade_probs")[1], "p3"))


@query("s1_detection_violations", "SELECT (det_id//20)::VARCHAR AS case_id, 'bad_score' AS rule FROM det GROUP BY det_id//20 HAVING max(score)*2>1 UNION ALL SELECT (det_id//20)::VARCHAR, 'length_mismatch' FROM det WHERE (det_id//20)%3=0 GROUP BY det_id//20")
def _(t):
    rows = _packed(t.det, "det_id DIV 20", "det_id", ["label", "score", *_BOX6])
    labels = F.when(F.col("case_id").cast("long") % 3 == 0, F.slice("r.label", 1, 1)).otherwise(F.col("r.label"))
    files = rows.select("case_id", F.transform("r", lambda e: F.array(*[e[c] for c in _BOX6])).alias("pred_boxes"),
                        F.transform("r.score", lambda s: s * 2).alias("pred_scores"), labels.alias("pred_labels"),
                        F.lit(None).cast("array<array<double>>").alias("pred_grade_probs"))
    return RD.detection_violations(files)


@query("s2_read_gt", "SELECT case_id::VARCHAR AS case_id, row_number() OVER (PARTITION BY case_id ORDER BY gt_id)-1 AS gt_id, label, x1, y2, z2 FROM gt")
def _(t):
    rows = _packed(t.gt, "case_id", "gt_id", ["label", *_BOX6])
    files = rows.select("case_id", F.transform("r", lambda e: F.array(*[e[c] for c in _BOX6])).alias("boxes"), F.col("r.label").alias("classes"))
    path = fresh_path(t.spark)
    WR.write_once(files, path, "json")
    return RD.read_gt(t.spark, path).select("case_id", "gt_id", "label", "x1", "y2", "z2")


@query("s3_read_instance_labels", "SELECT case_id::VARCHAR AS case_id, gt_id AS instance_id, 0::BIGINT AS class, CASE WHEN supervised THEN grade END AS grade, CASE WHEN supervised THEN 'expert' END AS source, supervised FROM gt")
def _(t):
    rows = _packed(t.gt, "case_id", "gt_id", ["grade", "supervised"])
    key = lambda e: e["gt_id"].cast("string")
    good = F.filter("r", lambda e: e["supervised"])
    entries = lambda src, v: F.map_from_entries(F.transform(src, lambda e: F.struct(key(e), v(e))))
    files = rows.select(
        "case_id", entries("r", lambda e: F.lit(0).cast("long")).alias("instances"), entries(good, lambda e: e["grade"]).alias("grades"),
        entries(good, lambda e: F.lit("expert")).alias("grade_sources"), entries("r", lambda e: e["supervised"]).alias("grade_supervised"),
    )
    path = fresh_path(t.spark)
    WR.write_once(files, path, "json")
    labels = t.spark.read.schema(SC.INSTANCE_LABELS).json(path)
    RD.assert_none(RD.instance_violations(labels), "label maps cover different instances")
    return RD.explode_instances(labels)


@query("s4_read_marksheet", """SELECT patient_id || '_' || gt_id AS case_id, (gt_id//5)%6 AS case_ISUP, i-1 AS position, v AS entry, TRY_CAST(v AS BIGINT) AS grade FROM
   (SELECT *, unnest(e) AS v, generate_subscripts(e,1) AS i FROM (SELECT patient_id, gt_id, [CAST(CAST(x1 AS BIGINT)%6 AS VARCHAR), 'N/A', CAST(CASE WHEN case_id%2=0 THEN CAST(x1 AS BIGINT)%6 ELSE (gt_id//5)%6 END AS VARCHAR)] AS e FROM gt))""")
def _(t):
    sheet = t.gt.selectExpr("CAST(patient_id AS STRING) AS patient_id", "CAST(gt_id AS STRING) AS study_id",
                            "concat_ws(',', CAST(x1 AS BIGINT) % 6, ' N/A', CASE WHEN case_id % 2 = 0 THEN CAST(x1 AS BIGINT) % 6 ELSE gt_id DIV 5 % 6 END, '') AS lesion_ISUP", "gt_id DIV 5 % 6 AS case_ISUP")
    path = fresh_path(t.spark)
    WR.write_once(sheet, path, "csv", header=True)
    return RD.read_marksheet(t.spark, path).select("case_id", "case_ISUP", big("position").alias("position"), "entry", "grade")


@query("s5_read_splits", FOLDS_SQL + " SELECT fold, role, case_id::VARCHAR AS case_id FROM spl")
def _(t):
    chunk = F.expr("case_id DIV 64").alias("chunk")
    pick = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("case_id").cast("string"))).alias(role)
    lines = fold_table(t).groupBy("fold", chunk).agg(pick("train"), pick("val")).drop("chunk")
    path = fresh_path(t.spark)
    WR.write_once(lines, path, "json")
    return RD.read_split_lines(t.spark, path)


@query("s6_read_audit_csv", f"s AS ({_STG.format(src='orders')}) SELECT case_id::VARCHAR AS case_id, source_voxels::BIGINT AS source_voxels, final_components::BIGINT AS final_components FROM s", views="")
def _(t):
    rec = retention_records(t.spark.sql(_STG, src=t("orders"))).withColumn("crop_strategy", F.lit("gland"))
    ordered = rec.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SC.RETENTION.fields])
    path = fresh_path(t.spark)
    WR.write_once(ordered, path, "csv", header=True)
    return RD.read_audit_csv(t.spark, path).select("case_id", "source_voxels", "final_components")


@query("s7_scan_by_glob", """SELECT 'p' || (patient_id%40) || '_s' || (case_id%2) AS case_id, m::BIGINT AS modality, 1::BIGINT AS files, false AS repeated
   FROM cases, (VALUES (0),(1)) v(m) GROUP BY ALL""")
def _(t):
    path = fresh_path(t.spark)
    name = F.concat(F.lit("p"), F.col("patient_id") % 40, F.lit("_s"), F.col("case_id") % 2)
    rows = t.cases.select(F.col("case_id").alias("id"), name.alias("case_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("modality"))
    rows.repartition("case_id", "modality").write.partitionBy("case_id", "modality").parquet(path)
    files = RD.scan_files(t.spark, path, "*.parquet", from_folders=True)
    twice = RD.duplicate_files(files).withColumn("repeated", F.lit(True))
    counted = files.groupBy("case_id", "modality").agg(F.count(F.lit(1)).alias("files"))
    return counted.join(twice, ["case_id", "modality"], "left").select("case_id", "modality", "files", F.coalesce("repeated", F.lit(False)).alias("repeated"))


@query("s8_write_once", "SELECT label, count(*) AS n FROM det GROUP BY label")
def _(t):
    path = fresh_path(t.spark)
    table = t.det.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    WR.write_once(table, path)
    return t.spark.read.schema(table.schema).parquet(path)


@query("s9_write_metrics", f"""SELECT o_orderpriority AS run, o_orderkey%5 AS fold, {R('avg(o_totalprice)')} AS mean_price, count(*)::DOUBLE AS orders FROM orders GROUP BY 1,2""", views="")
def _(t):
    agg = t("orders").groupBy(F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 5).alias("fold")).agg(
        F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).cast("double").alias("orders"))
    scalars = agg.unpivot(["run", "fold"], ["mean_price", "orders"], "key", "value")
    path = fresh_path(t.spark)
    WR.write_metrics(scalars, path)
    back = t.spark.read.schema(SC.METRICS).parquet(f"{path}/scalars")
    return WR.metric_table(back, ["mean_price", "orders"]).select("run", "fold", r6("mean_price"), "orders")


def _scalars(t):
    per = t("orders").groupBy(F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 5).alias("fold")).agg(
        F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).cast("double").alias("orders")
    )
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("mean_price", "orders")])
    return per.select("run", "fold", F.explode(rows).alias("r")).select("run", "fold", "r.*")


@query("s9_write_report", f"""SELECT o_orderpriority AS run, o_orderkey%5 AS fold, count(*)::DOUBLE AS orders, NULL::DOUBLE AS never_measured, {R('avg(o_totalprice)')} AS mean_price FROM orders GROUP BY 1,2""", views="")
def _(t):
    path = fresh_path(t.spark)
    WR.write_report(_scalars(t), path, ["orders", "never_measured", "mean_price"])
    back = t.spark.read.schema("run STRING, fold BIGINT, orders DOUBLE, never_measured DOUBLE, mean_price DOUBLE").csv(path, header=True, enforceSchema=False)
    return back.select("run", "fold", "orders", "never_measured", r6("mean_price"))


@query("s9_write_curves", f"""SELECT o_orderpriority AS run, o_orderkey%5 AS fold, 'by_year' AS key, (year(o_orderdate)-1992)::BIGINT AS idx, year(o_orderdate)::DOUBLE AS x, {R('avg(o_totalprice)')} AS y
   FROM orders GROUP BY ALL""", views="")
def _(t):
    year = F.year("o_orderdate")
    curves = t("orders").groupBy(F.col("o_orderpriority").alias("run"), (F.col("o_orderkey") % 5).alias("fold"), year.alias("year")).agg(F.avg("o_totalprice").alias("y"))
    curves = curves.select("run", "fold", F.lit("by_year").alias("key"), (F.col("year") - 1992).cast("long").alias("idx"), F.col("year").cast("double").alias("x"), "y")
    path = fresh_path(t.spark)
    WR.write_metrics(_scalars(t), path, curves)
    back = t.spark.read.schema("key STRING, idx BIGINT, x DOUBLE, y DOUBLE, run STRING, fold BIGINT").parquet(f"{path}/curves")
    return back.select("run", "fold", "key", "idx", "x", r6("y"))


@query("s10_overview_export", "SELECT case_id, count(gt_id) AS num_gt FROM cases LEFT JOIN gt USING (case_id) GROUP BY case_id")
def _(t):
    path = fresh_path(t.spark)
    WR.export_overview(_overview(t), path)
    return t.spark.read.schema("case_id BIGINT, num_gt BIGINT").json(f"{path}/json")


@query("s11_merge_fold_outputs", "SELECT det_id, patient_id%5 AS fold FROM det")
def _(t):
    return RD.merge_folds({f: t.det.filter(F.col("patient_id") % 5 == f) for f in range(5)}).select("det_id", "fold")


# ---- streaming: the events table read as a stream of files


def event_stream(t, parts=4):
    """The events in order of time as a stream of several files, one to a micro-batch."""
    events = t("events")
    path = fresh_path(t.spark)
    at = F.col("ts").cast("timestamp").cast("double")
    cut = F.percentile_approx(at, F.array(*[F.lit(i / parts) for i in range(1, parts)]))
    cuts = events.agg(cut.alias("c")).first().c or []  # three numbers
    # as literals: a filter on a column made from a joined row of cuts is pushed to the wrong side of the join on larger tables
    part = sum([F.when(at > c, 1).otherwise(0) for c in cuts], F.lit(0))
    cut_up = events.withColumn("part", part)
    for i in range(parts):  # one write per file, so that the files are as old as their rows are in order
        cut_up.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(q):
    q.awaitTermination()
    return q


def arrivals_of(events):
    """Each event as the arrival of a case; some also bring or withdraw the marker of their arm."""
    kinds = F.array(
        F.when(~((F.col("user_id") % 5 == 1) & (F.col("event_id") % 10 == 7)), F.lit("case")),
        F.when(F.col("event_id") % 7 == 0, F.lit("marker")),
        F.when((F.col("user_id") % 5 == 4) & (F.col("event_id") % 7 == 0), F.lit("marker_removed")),
        # fold 3 is marked, cleared and marked again
        F.when((F.col("user_id") % 5 == 3) & (F.col("event_id") % 7 == 1), F.lit("marker_removed")),
    )
    return events.select(
        F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("fold"), F.col("event_id").alias("case_id"),
        F.col("ts").cast("timestamp").alias("arrived"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"),
    )


def expected_of(events):
    wanted = events.filter("NOT (user_id % 5 = 2 AND event_id % 10 = 3)")
    return wanted.select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("fold"), F.col("event_id").alias("case_id"))


_ARRIVED = """ar AS (SELECT event_type AS arm, user_id%5 AS fold, event_id, ts FROM events), ex AS (SELECT * FROM ar WHERE NOT (fold=2 AND event_id%10=3)), ca AS (SELECT * FROM ar WHERE NOT (fold=1 AND event_id%10=7)),
   mk AS (SELECT fold, arm, arg_max(NOT gone, (ts, gone)) AS marked FROM (SELECT *, false AS gone FROM ar WHERE event_id%7=0 UNION ALL SELECT *, true FROM ar WHERE (fold=4 AND event_id%7=0) OR (fold=3 AND event_id%7=1)) GROUP BY ALL),
   st AS (SELECT k.fold, k.arm, (SELECT count(*) FROM ex WHERE ex.fold=k.fold AND ex.arm=k.arm) AS want, (SELECT count(*) FROM ca JOIN ex USING (arm, fold, event_id) WHERE fold=k.fold AND arm=k.arm) AS have,
     (SELECT count(*) FROM ca ANTI JOIN ex USING (arm, fold, event_id) WHERE fold=k.fold AND arm=k.arm) AS odd, coalesce(mk.marked, false) AS marked
     FROM (SELECT f.fold, a.arm FROM (SELECT DISTINCT fold FROM ar) f, (SELECT DISTINCT arm FROM ar) a) k LEFT JOIN mk USING (fold, arm)),
   rf AS (SELECT fold, bool_and(want=have AND odd=0 AND marked) AS ready FROM st GROUP BY fold)"""


def _status(t):
    events = t("events")
    expected = expected_of(events)
    path, ckpt = fresh_path(t.spark), fresh_path(t.spark)
    drain(ST.append_batches(ST.arrival_status(arrivals_of(event_stream(t)), expected), path, ckpt, "update"))
    return ST.ready_folds(ST.latest(t.spark.read.parquet(path), ["fold", "arm"]), ST.expected_counts(expected)), expected


@query("t1_arrival_completeness", _ARRIVED + " SELECT fold, ready FROM rf", views="")
def _(t):
    return _status(t)[0]


@query("t2_incremental_evaluation", match_sql("m", thr="0.5") + " SELECT case_id, det_id, gt_id FROM m")
def _(t):
    live = Tables(t.spark, t.sf_dir)
    detections = live.det_of(event_stream(t))
    path, ckpt = fresh_path(t.spark), fresh_path(t.spark)
    drain(ST.incremental_evaluation(detections, t.gt, lambda d, g: greedy_match(d, g, 0.5), path, ckpt))
    return ST.newest_cases(t.spark.read.parquet(f"{path}/events")).select("case_id", "det_id", "gt_id")


@query("t3_running_counters", "SELECT event_type, user_id%3 AS lane, count(*) AS n FROM events GROUP BY 1,2", views="")
def _(t):
    stream = event_stream(t).select("event_type", (F.col("user_id") % 3).alias("lane"))
    path, ckpt = fresh_path(t.spark), fresh_path(t.spark)
    drain(ST.running_counters(stream, ["event_type", "lane"], path, ckpt))
    return ST.latest(t.spark.read.parquet(path), ["event_type", "lane"])


@query("t4_patience_stream", """o AS (SELECT event_id//10 AS run, row_number() OVER (PARTITION BY event_id//10 ORDER BY event_id) AS n, event_id AS step, value AS v, count(*) OVER (PARTITION BY event_id//10) AS total FROM events),
   s AS (SELECT run, 0::BIGINT AS n, -1e300::DOUBLE AS best, 0::BIGINT AS idle, false AS fired, -1::BIGINT AS step FROM (SELECT DISTINCT run FROM o)
     UNION ALL SELECT o.run, o.n, CASE WHEN NOT s.fired AND o.v>s.best THEN o.v ELSE s.best END, CASE WHEN s.fired THEN s.idle WHEN o.v>s.best THEN 0 ELSE s.idle+1 END, s.fired OR (o.v<=s.best AND s.idle+1>=3), o.step FROM s JOIN o ON o.run=s.run AND o.n=s.n+1)
   SELECT s.run, s.step, s.best, s.idle AS idle_steps, s.fired FROM s JOIN o ON o.run=s.run AND o.n=s.n WHERE s.n=o.total""", views="")
def _(t):
    metrics = event_stream(t).select(F.expr("event_id DIV 10").alias("run"), F.col("event_id").alias("step"), "value")
    path, ckpt = fresh_path(t.spark), fresh_path(t.spark)
    drain(ST.append_batches(ST.patience_stream(metrics, 3), path, ckpt, "update"))
    return ST.latest(t.spark.read.parquet(path), ["run"])


@query("t5_pool_when_done", _ARRIVED + """ SELECT event_type, count(*) AS n, (SELECT bool_and(ready) FROM rf) AS all_pooled
   FROM events WHERE (SELECT bool_and(ready) FROM rf WHERE fold IN (0, 3)) AND user_id%5 IN (0, 3) GROUP BY event_type""", views="")
def _(t):
    status, expected = _status(t)
    status = cut_lineage(status)
    some, every = fresh_path(t.spark), fresh_path(t.spark)
    pooled = lambda fold: t("events").filter(fold).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    fold = F.col("user_id") % 5
    empty = t.spark.createDataFrame([], "event_type STRING, n BIGINT")
    done = ST.pool_when_done(status, expected.filter("fold IN (0, 3)"), lambda: pooled(fold.isin(0, 3)), some)
    again = ST.pool_when_done(status, expected.filter("fold IN (0, 3)"), lambda: pooled(fold.isin(0, 3)), some)
    all_done = ST.pool_when_done(status, expected, lambda: pooled(F.lit(True)), every)
    assert not again
    out = t.spark.read.schema("event_type STRING, n BIGINT").parquet(some) if done else empty
    return out.withColumn("all_pooled", F.lit(all_done))

