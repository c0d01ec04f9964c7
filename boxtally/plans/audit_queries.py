"""Checks, audits and gates (Q1–Q24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.operators import audit as Q
from boxtally.operators import voxels as V
from boxtally.plans.metric_queries import FOLDS_SQL, fold_table
from boxtally.plans.registry import big, query, r6
from boxtally.plans.sqlparts import R, CRC_STEPS, crc32_sql
from boxtally.plans.voxel_queries import GLAND, SP, _V13, gland, lesion
from boxtally.sources.readers import explode_marksheet

# ---- dataset descriptions: one per order, deliberately broken in a few ways


@query("q1_check_dataset_info", """SELECT o_orderkey AS name, unnest(list_filter([CASE WHEN o_orderkey%7=0 THEN 'missing_task' END, CASE WHEN o_orderkey%4 NOT IN (2,3) THEN 'bad_dim' END,
   CASE WHEN o_orderkey%5=0 THEN 'labels_not_contiguous' END, CASE WHEN o_orderkey%3=2 THEN 'unknown_target_class' END], lambda v: v IS NOT NULL)) AS rule FROM orders""", views="")
def _(t):
    k = F.col("o_orderkey")
    second = F.when(k % 5 == 0, "2").otherwise("1")
    info = t("orders").select(
        k.alias("name"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("task"), (k % 4).cast("int").alias("dim"),
        F.create_map(F.lit("0"), F.lit("a"), second, F.lit("b")).alias("labels"),
        F.create_map(F.lit("0"), F.lit("t2w"), F.lit("1"), F.lit("adc")).alias("modalities"),
        F.when(k % 3 == 1, F.lit(0)).when(k % 3 == 2, F.lit(9)).alias("target_class"),
    )
    return Q.check_dataset_info(info)


_META = "SELECT case_id, 1+(gt_id//5)%10 AS instance_id, gt_id%4 AS class, gt_id FROM gt"


def _metadata(t):
    return t.gt.select("case_id", (1 + F.expr("gt_id DIV 5 % 10")).alias("instance_id"), (F.col("gt_id") % 4).alias("class"), "gt_id")


@query("q2_check_instances", f"""md AS ({_META}), mk AS (SELECT DISTINCT case_id, instance_id FROM md WHERE gt_id%3<>0), me AS (SELECT * FROM md WHERE gt_id%7<>0),
   j AS (SELECT coalesce(k.case_id,e.case_id) AS case_id, coalesce(k.instance_id,e.instance_id) AS instance_id, k.case_id IS NULL AS nom, e.case_id IS NULL AS nod, e.class FROM mk k FULL JOIN me e ON k.case_id=e.case_id AND k.instance_id=e.instance_id)
   SELECT case_id, instance_id, 'not_in_metadata' AS rule FROM j WHERE nod UNION ALL SELECT case_id, instance_id, 'not_in_mask' FROM j WHERE nom UNION ALL SELECT case_id, instance_id, 'undeclared_class' FROM j WHERE class NOT IN (0,1,2)
   UNION ALL SELECT case_id, NULL, 'ids_not_contiguous' FROM me GROUP BY case_id HAVING min(instance_id)<>1 OR max(instance_id)<>count(*) OR count(DISTINCT instance_id)<>count(*)""")
def _(t):
    md = _metadata(t)
    return Q.check_instances(md.filter("gt_id % 3 <> 0"), md.filter("gt_id % 7 <> 0"), [0, 1, 2])


@query("q3_check_geometry", """SELECT det_id // 5 AS case_id, det_id AS image, unnest(list_filter([CASE WHEN det_id%5<>1 AND det_id%11=0 THEN 'size' END, CASE WHEN det_id%5<>1 AND det_id%13=0 THEN 'spacing' END], lambda v: v IS NOT NULL)) AS rule
   FROM (SELECT d.*, min(det_id) OVER (PARTITION BY det_id//5) AS f FROM det d) WHERE f%11<>0 AND f%13<>0
   UNION ALL SELECT det_id//5, det_id, 'size' FROM (SELECT d.*, min(det_id) OVER (PARTITION BY det_id//5) AS f FROM det d) WHERE f%11=0 AND det_id%11<>0
   UNION ALL SELECT det_id//5, det_id, 'spacing' FROM (SELECT d.*, min(det_id) OVER (PARTITION BY det_id//5) AS f FROM det d) WHERE f%13=0 AND det_id%13<>0
   UNION ALL SELECT det_id//5, det_id, 'spacing' FROM (SELECT d.*, min(det_id) OVER (PARTITION BY det_id//5) AS f FROM det d) WHERE f%11=0 AND f%13<>0 AND det_id%13=0
   UNION ALL SELECT det_id//5, det_id, 'size' FROM (SELECT d.*, min(det_id) OVER (PARTITION BY det_id//5) AS f FROM det d) WHERE f%13=0 AND f%11<>0 AND det_id%11=0""")
def _(t):
    n = F.col("det_id")
    images = t.det.select(
        F.expr("det_id DIV 5").alias("case_id"), n.alias("image"),
        F.array(F.lit(10), F.when(n % 11 == 0, 21).otherwise(20)).alias("size"),
        F.array(F.lit(0.5), F.when(n % 13 == 0, 0.6).otherwise(0.5 + 0.00001 * (n % 3))).alias("spacing"),
        F.array(F.lit(0.0), F.lit(1.0)).alias("origin"), F.array(F.lit(1.0), F.lit(0.0)).alias("direction"),
    )
    return Q.check_geometry(images)


_BAD = FOLDS_SQL + """, sp AS (SELECT * FROM spl WHERE NOT (case_id%17=0 AND fold=1) UNION ALL SELECT fold, 'train', case_id, patient_id FROM spl WHERE role='val' AND case_id%23=0)"""


def _bad_folds(t):
    s = fold_table(t)
    again = s.filter("role = 'val' AND case_id % 23 = 0").withColumn("role", F.lit("train"))
    return s.filter("NOT (case_id % 17 = 0 AND fold = 1)").unionByName(again)


@query("q4_check_splits", _BAD + """ SELECT 'case_in_both_roles' AS rule, fold, case_id::VARCHAR AS id FROM sp GROUP BY fold, case_id HAVING count(DISTINCT role)>1
   UNION ALL SELECT 'patient_in_both_roles', fold, patient_id::VARCHAR FROM sp GROUP BY fold, patient_id HAVING count(DISTINCT role)>1
   UNION ALL SELECT 'case_repeated', fold, case_id::VARCHAR FROM sp GROUP BY fold, role, case_id HAVING count(*)>1
   UNION ALL SELECT 'case_missing', f.fold, c.case_id::VARCHAR FROM cases c, (SELECT DISTINCT fold FROM sp) f WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.fold=f.fold AND sp.case_id=c.case_id)
   UNION ALL SELECT 'case_not_validated_once', NULL, c.case_id::VARCHAR FROM cases c WHERE (SELECT count(DISTINCT fold) FROM sp WHERE role='val' AND sp.case_id=c.case_id)<>1
   UNION ALL SELECT 'patient_validated_twice', NULL, patient_id::VARCHAR FROM sp WHERE role='val' GROUP BY patient_id HAVING count(DISTINCT fold)>1""")
def _(t):
    return Q.check_splits(_bad_folds(t), t.cases)


@query("q5_check_fold_grades", FOLDS_SQL + """ SELECT f.fold, g.grade FROM (SELECT DISTINCT fold FROM spl) f, (SELECT unnest(range(2,7)) AS grade) g
   WHERE NOT EXISTS (SELECT 1 FROM spl JOIN gt USING (case_id) WHERE role='val' AND spl.fold=f.fold AND gt.grade=g.grade AND supervised)""")
def _(t):
    return Q.check_fold_grades(fold_table(t), t.gt, (2, 3, 4, 5, 6))


@query("q6_check_supervision", """i AS (SELECT case_id, gt_id AS instance_id, supervised, CASE WHEN gt_id%3<>0 THEN grade END AS grade, CASE WHEN gt_id%4<>0 THEN 's' END AS source, CASE WHEN gt_id%50=0 THEN 1 ELSE 0 END AS class FROM gt)
   SELECT case_id, instance_id, 'supervised_without_grade' AS rule FROM i WHERE supervised AND grade IS NULL UNION ALL SELECT case_id, instance_id, 'supervised_without_source' FROM i WHERE supervised AND source IS NULL
   UNION ALL SELECT case_id, instance_id, 'unsupervised_with_grade' FROM i WHERE NOT supervised AND grade IS NOT NULL UNION ALL SELECT case_id, instance_id, 'class_not_zero' FROM i WHERE class<>0""")
def _(t):
    n = F.col("gt_id")
    rows = t.gt.select("case_id", n.alias("instance_id"), "supervised", F.when(n % 3 != 0, F.col("grade")).alias("grade"),
                       F.when(n % 4 != 0, F.lit("s")).alias("source"), F.when(n % 50 == 0, 1).otherwise(0).alias("class"))
    return Q.check_supervision(rows)


@query("q7_check_positives", """p AS (SELECT case_id FROM cases WHERE case_id%4<>3), a AS (SELECT case_id FROM cases WHERE case_id%5<>3), d AS (SELECT case_id FROM cases WHERE case_id%6<>0), x AS (SELECT case_id FROM cases WHERE case_id%12=0 OR case_id%10=5), i AS (SELECT DISTINCT case_id FROM gt WHERE case_id%9<>1)
   SELECT case_id, 'marksheet_only' AS rule FROM p ANTI JOIN a USING (case_id) UNION ALL SELECT case_id, 'audit_only' FROM a ANTI JOIN p USING (case_id)
   UNION ALL SELECT case_id, 'neither_kept_nor_excluded' FROM p WHERE case_id NOT IN (FROM d) AND case_id NOT IN (FROM x) UNION ALL SELECT case_id, 'kept_and_excluded' FROM p WHERE case_id IN (FROM d) AND case_id IN (FROM x)
   UNION ALL SELECT case_id, 'positive_without_instance' FROM p WHERE case_id IN (FROM d) AND case_id NOT IN (FROM i)""")
def _(t):
    c = t.cases.select("case_id")
    sheet = c.withColumn("case_ISUP", F.when(F.col("case_id") % 4 == 3, 0).otherwise(2 + F.col("case_id") % 4))
    return Q.check_positives(sheet, c.filter("case_id % 5 <> 3"), c.filter("case_id % 6 <> 0"), c.filter("case_id % 12 = 0 OR case_id % 10 = 5"),
                             t.gt.filter("case_id % 9 <> 1").select("case_id").distinct())


_STG = """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey%5=0 THEN 0 ELSE 30 END AS source_voxels, CASE WHEN o_orderkey%5=0 THEN 0 ELSE 30 END AS resampled_voxels, 30-10*(o_orderkey%3) AS inplane_voxels,
   CASE WHEN o_orderkey%7=0 THEN 0 ELSE 30-10*(o_orderkey%3) END AS final_voxels, 2 AS source_components, 2 AS resampled_components, 2-o_orderkey%2 AS inplane_components, 2-o_orderkey%2 AS final_components FROM {src}"""
_STATUS = "CASE WHEN source_voxels=0 THEN 'negative' WHEN final_voxels=0 THEN 'excluded_no_retained_voxels' WHEN inplane_voxels<resampled_voxels OR final_voxels<inplane_voxels OR inplane_components<resampled_components OR final_components<inplane_components THEN 'partially_clipped' ELSE 'fully_retained' END"


def _stages(t):
    return t.spark.sql(_STG, src=t("orders"))


@query("q8_retention_record", f"s AS ({_STG.format(src='orders')}) SELECT case_id, {_STATUS} AS status, CASE WHEN {_STATUS}='excluded_no_retained_voxels' THEN 'gland_centred_crop_retained_no_lesion_voxels' ELSE '' END AS exclusion_reason FROM s", views="")
def _(t):
    return Q.retention_records(_stages(t)).select("case_id", "status", "exclusion_reason")


@query("q9_check_retention", f"""s AS ({_STG.format(src='orders')}), a AS (SELECT *, CASE WHEN case_id%19=0 THEN 'odd' WHEN case_id%23=0 THEN 'fully_retained' ELSE {_STATUS} END AS st, {_STATUS} AS own FROM s WHERE case_id%29<>0),
   m AS (SELECT case_id FROM s WHERE case_id%31<>0), d AS (SELECT case_id FROM s WHERE case_id%3<>1)
   SELECT case_id, 'unknown_status' AS rule FROM a WHERE st='odd' UNION ALL SELECT case_id, 'status_disagrees' FROM a WHERE st<>'odd' AND st<>own
   UNION ALL SELECT case_id, 'not_in_manifest' FROM a WHERE case_id NOT IN (FROM m) UNION ALL SELECT case_id, 'not_in_audit' FROM m WHERE case_id NOT IN (SELECT case_id FROM a)
   UNION ALL SELECT case_id, 'excluded_but_in_data' FROM a WHERE st='excluded_no_retained_voxels' AND case_id IN (FROM d) UNION ALL SELECT case_id, 'excluded_but_in_folds' FROM a WHERE st='excluded_no_retained_voxels' AND case_id IN (FROM d)
   UNION ALL SELECT case_id, 'retained_but_missing' FROM a WHERE st IN ('partially_clipped','fully_retained') AND case_id NOT IN (FROM d)""", views="")
def _(t):
    s = _stages(t)
    a = Q.retention_records(s.filter("case_id % 29 <> 0"))
    a = a.withColumn("status", F.when(F.col("case_id") % 19 == 0, "odd").when(F.col("case_id") % 23 == 0, "fully_retained").otherwise(F.col("status")))
    d = s.filter("case_id % 3 <> 1").select("case_id")
    return Q.check_retention(a, s.filter("case_id % 31 <> 0").select("case_id"), d, d)


_LIST = "concat_ws(',', CAST(x1 % 6 AS BIGINT), ' N/A', CASE WHEN case_id % 2 = 0 THEN CAST(x1 % 6 AS BIGINT) ELSE (gt_id {div} 5) % 6 END, '')"


def marksheet(t):
    return explode_marksheet(t.gt.selectExpr("CAST(patient_id AS STRING) AS patient_id", "CAST(gt_id AS STRING) AS study_id", _LIST.format(div="DIV") + " AS lesion_ISUP", "gt_id DIV 5 % 6 AS case_ISUP"))


ENTRIES = f"""ms AS (SELECT patient_id || '_' || gt_id AS case_id, (gt_id//5)%6 AS case_ISUP, {_LIST.format(div='//')} AS lst FROM gt),
   en AS (SELECT case_id, case_ISUP, trim(e) AS entry, TRY_CAST(trim(e) AS BIGINT) AS grade FROM (SELECT case_id, case_ISUP, unnest(string_split(lst, ',')) AS e FROM ms) WHERE trim(e)<>'')"""


@query("q10_homogeneity_audit", ENTRIES + """, g AS (SELECT case_id, count(DISTINCT CASE WHEN grade BETWEEN 2 AND 5 THEN grade END) AS n, min(CASE WHEN grade BETWEEN 2 AND 5 THEN grade END) AS gr FROM en GROUP BY case_id)
   SELECT case_id, CASE WHEN n=0 THEN 'no_valid_grade' WHEN n>1 THEN 'heterogeneous' ELSE 'homogeneous' END AS status, CASE WHEN n=1 THEN gr END AS grade, 1+length(case_id)%3 AS num_components, n=1 AS supervised FROM g""")
def _(t):
    e = marksheet(t)
    comp = e.select("case_id").distinct().withColumn("num_components", 1 + F.length("case_id") % 3)
    return Q.homogeneity_audit(e, comp)


@query("q11_grade_metadata_audit", """SELECT 'instances' AS item, count(*) AS found, 1500::BIGINT AS expected, count(*)=1500 AS ok FROM gt UNION ALL SELECT 'supervised', count(*) FILTER (WHERE supervised), 7::BIGINT, count(*) FILTER (WHERE supervised)=7 FROM gt UNION ALL SELECT 'cases', count(DISTINCT case_id), 150, count(DISTINCT case_id)=150 FROM gt""")
def _(t):
    return Q.grade_coverage(t.gt, {"instances": 1500, "supervised": 7, "cases": 150})


@query("q12_manifest_build", "SELECT page_id AS path, strlen(html)::BIGINT AS bytes, sha256(html) AS sha256 FROM pages", views="")
def _(t):
    files = t("pages").select(F.col("page_id").alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return Q.file_manifest(files)


@query("q12_case_list_hash", "SELECT patient_id, count(*) AS n, sha256(string_agg(case_id::VARCHAR, chr(10) ORDER BY case_id::VARCHAR)) AS sha256 FROM cases GROUP BY patient_id")
def _(t):
    return Q.list_hash(t.cases, ["patient_id"], "case_id")


@query("q12_manifest_verify", "SELECT page_id, CASE WHEN page_id%11=0 THEN 'added' WHEN page_id%13=0 THEN 'removed' ELSE 'changed' END AS change FROM pages WHERE page_id%11=0 AND page_id%13<>0 OR page_id%13=0 AND page_id%11<>0 OR page_id%7=0 AND page_id%11<>0 AND page_id%13<>0", views="")
def _(t):
    p = t("pages").select("page_id", F.sha2("html", 256).alias("h"))
    stored = p.filter("page_id % 11 <> 0").withColumn("h", F.when(F.col("page_id") % 7 == 0, "x").otherwise(F.col("h")))
    return Q.manifest_diff(stored, p.filter("page_id % 13 <> 0"), "page_id", "h")


@query("q13_store_drift", """SELECT 'a' AS store, count(*) FILTER (WHERE gt_id%15=0) AS missing, 0::BIGINT AS unknown, count(*) FILTER (WHERE gt_id%15<>0 AND (gt_id//5)%6=1) AS differing FROM gt
   UNION ALL SELECT 'b', 0, count(*) FILTER (WHERE gt_id%35=0), 0 FROM gt""")
def _(t):
    base = t.gt.select("gt_id", "grade", "supervised")
    a = base.filter("gt_id % 15 <> 0").withColumn("grade", F.when(F.expr("gt_id DIV 5 % 6 = 1"), F.lit(None)).otherwise(F.col("grade")))
    b = base.unionByName(base.filter("gt_id % 35 = 0").withColumn("gt_id", -F.col("gt_id") - 1))
    return Q.store_drift(base, {"a": a, "b": b}, ["gt_id"], ["grade", "supervised"])


@query("q13_store_repair", "SELECT gt_id, CASE WHEN gt_id%15=0 THEN 99 ELSE grade END AS grade FROM gt")
def _(t):
    base = t.gt.select("gt_id", "grade")
    return Q.repair_store(base.filter("gt_id % 15 <> 0"), base.withColumn("grade", F.lit(99).cast("long")), ["gt_id"], ["grade"])


@query("q14_unit_class_audit", f"""u AS (SELECT user_id, count(*) AS n, min(value) AS min, quantile_cont(value,0.01) AS p1, quantile_cont(value,0.5) AS median, quantile_cont(value,0.99) AS p99, max(value) AS max FROM events GROUP BY user_id)
   SELECT user_id, n, {R('min')} AS min, {R('p1')} AS p1, {R('median')} AS median, {R('p99')} AS p99, {R('max')} AS max, CASE WHEN median BETWEEN 0 AND 30 AND NOT median BETWEEN 28 AND 60 THEN 'low' WHEN median BETWEEN 28 AND 60 AND NOT median BETWEEN 0 AND 30 THEN 'high' ELSE 'unrecognized' END AS unit FROM u""", views="")
def _(t):
    a = Q.unit_class_audit(t("events"), ["user_id"], "value", {"low": (0.0, 30.0), "high": (28.0, 60.0)})
    return a.select("user_id", "n", *[r6(c) for c in ("min", "p1", "median", "p99", "max")], "unit")


_CONT = _V13 + """, ct AS (SELECT le.case_id, avg(CASE WHEN g.x IS NULL THEN 0.0 ELSE 1.0 END) AS containment FROM le LEFT JOIN gl g ON g.case_id=le.case_id AND g.z=le.z AND g.y=le.y AND g.x=le.x GROUP BY le.case_id),
   cg AS (SELECT ct.*, (SELECT quantile_cont(dist,0.95) FROM od WHERE od.case_id=ct.case_id) AS p95_mm FROM ct)"""


def _contained(t):
    d = V.outside_distance(lesion(t), gland(t), t.cases, SP)
    p = V.distance_summary(d, ["case_id"]).select("case_id", F.col("p95").alias("p95_mm"))
    return V.containment(lesion(t), gland(t)).join(p, "case_id", "left")


@query("q15_containment_gate", _CONT + f""", k AS (SELECT containment AS c, (containment<0.5 AND coalesce(p95_mm>2.0,false)) AS x FROM cg)
   SELECT count(*) AS cases, count(*) FILTER (WHERE x) AS excluded, count(*) FILTER (WHERE NOT x) AS gated, {R('min(c) FILTER (WHERE NOT x)')} AS min, {R('quantile_cont(c,0.5) FILTER (WHERE NOT x)')} AS median,
   {R('quantile_cont(c,0.05) FILTER (WHERE NOT x)')} AS p05, {R('max(c) FILTER (WHERE NOT x)')} AS max, quantile_cont(c,0.5) FILTER (WHERE NOT x)>=0.9 AND min(c) FILTER (WHERE NOT x)>=0.5 AS passed FROM k""", views="gt det cases voxels")
def _(t):
    g = Q.containment_gate(_contained(t))
    return g.select("cases", "excluded", "gated", *[r6(c) for c in ("min", "median", "p05", "max")], "passed")


@query("q16_yield_sweep", GLAND + """, dn AS (SELECT le.gt_id, any_value(le.grade) AS grade, avg(CASE WHEN g.x IS NULL THEN 0.0 ELSE 1.0 END) AS c FROM le LEFT JOIN gl g ON g.case_id=le.case_id AND g.z=le.z AND g.y=le.y AND g.x=le.x GROUP BY le.gt_id),
   dd AS (SELECT *, CASE WHEN c<1 THEN (1-c)*6 END AS mm FROM dn),
   b AS (SELECT 'distance<='||v||'.0' AS bar, v::DOUBLE AS v, 0 AS k FROM range(1,6) r(v) UNION ALL SELECT 'containment>='||v, v, 1 FROM (VALUES (0.5),(0.9)) w(v))
   SELECT grade, bar, count(*) FILTER (WHERE CASE WHEN k=0 THEN coalesce(mm<=v,true) ELSE c>=v END) AS n FROM dd, b GROUP BY GROUPING SETS ((grade, bar), (bar))""", views="gt det cases voxels")
def _(t):
    c = V.containment(lesion(t), gland(t), ["gt_id"]).join(t.gt.select("gt_id", "grade"), "gt_id")
    donors = c.withColumn("p95_mm", F.when(F.col("containment") < 1, (1 - F.col("containment")) * 6))
    return Q.yield_sweep(donors, [1.0, 2.0, 3.0, 4.0, 5.0], [0.5, 0.9])


@query("q17_completeness_check", "SELECT case_id, 'missing' AS only_in FROM cases WHERE case_id NOT IN (SELECT case_id FROM det WHERE score>0.2) UNION ALL SELECT DISTINCT case_id, 'unexpected' FROM det WHERE score>0.2 AND case_id%9=0 AND false")
def _(t):
    return Q.completeness(t.cases, t.det.filter("score > 0.2"), ["case_id"])


@query("q17_partial_outputs", "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM gt)")
def _(t):
    return Q.partial_outputs(t.cases.select("case_id"), t.gt.select("case_id"))


@query("q18_log_error_scan", "SELECT event_id, left(line,20) AS line FROM (SELECT event_id, event_type || ' from ' || user_id || ' ' || props AS line FROM events) WHERE regexp_matches(line,'(?i)traceback|error') AND NOT regexp_matches(line,'from 4[0-9] ')", views="")
def _(t):
    lines = t("events").select("event_id", F.concat_ws(" ", "event_type", F.lit("from"), "user_id", "props").alias("line"))
    return Q.scan_log(lines, "line", ["from 4[0-9] "], 20)


@query("q19_config_lock", "SELECT event_id AS arm, 'k' AS key, '50' AS expected, json_extract_string(props,'$.k') AS actual FROM events WHERE json_extract_string(props,'$.k') IS DISTINCT FROM '50'", views="")
def _(t):
    e = t("events")
    resolved = e.select(F.col("event_id").alias("arm"), F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("value"))
    locked = e.select(F.col("event_id").alias("arm"), F.lit("k").alias("key"), F.lit("50").alias("value"))
    return Q.config_lock(resolved, locked)


@query("q20_metric_floor", f"SELECT user_id AS run, 'mAP_click' AS key, {R('avg(CASE WHEN event_type=chr(99)||chr(108)||chr(105)||chr(99)||chr(107) THEN value END)')} AS value, coalesce(avg(CASE WHEN event_type='click' THEN value END)>=20.0,false) AS ok FROM events GROUP BY user_id".replace("chr(99)||chr(108)||chr(105)||chr(99)||chr(107)", "'click'"), views="")
def _(t):
    m = t("events").groupBy(F.col("user_id").alias("run"), F.concat(F.lit("mAP_"), "event_type").alias("key")).agg(F.avg("value").alias("value"))
    return Q.metric_floor(m, "^mAP_", 20.0).select("run", "key", r6("value"), "ok")


@query("q20_runtime_gate", f"""r AS (SELECT o_orderkey AS run, o_orderpriority AS arm, o_totalprice AS elapsed FROM orders), b AS (SELECT o_orderpriority AS arm, avg(o_totalprice) AS projected FROM orders WHERE o_orderpriority<>'2-HIGH' GROUP BY 1)
   SELECT run, arm, {R('elapsed')} AS elapsed, coalesce(elapsed<=1.5*projected,false) AS ok FROM r LEFT JOIN b USING (arm)""", views="")
def _(t):
    runs = t("orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("arm"), F.col("o_totalprice").alias("elapsed"))
    budget = runs.filter("arm <> '2-HIGH'").groupBy("arm").agg(F.avg("elapsed").alias("projected"))
    return Q.runtime_gate(runs, budget, 1.5).select("run", "arm", r6("elapsed"), "ok")


@query("q21_drop_gate", f"""m AS (SELECT o_orderstatus AS key, avg(CASE WHEN o_orderpriority='1-URGENT' THEN o_totalprice END) AS base, avg(CASE WHEN o_orderpriority='5-LOW' THEN o_totalprice END) AS other FROM orders GROUP BY 1)
   SELECT key, {R('base')} AS base, {R('other')} AS other, {R('base-other')} AS drop, CASE key WHEN 'F' THEN 100.0::DOUBLE ELSE 1000000.0::DOUBLE END AS "limit", base-other<=CASE key WHEN 'F' THEN 100.0 ELSE 1000000.0 END AS ok FROM m WHERE key IN ('F','O')""", views="")
def _(t):
    m = t("orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("key")).agg(F.avg("o_totalprice").alias("value"))
    g = Q.drop_gate(m, {"F": 100.0, "O": 1e6}, "1-URGENT", "5-LOW")
    return g.select("key", r6("base"), r6("other"), r6("drop"), "limit", "ok")


@query("q22_budget_projection", f"""a AS (SELECT o_orderpriority AS arm, avg(o_totalprice)/1e5 AS s FROM orders GROUP BY 1) SELECT {R('sum(s*2500*60*5)/3600.0')} AS gpu_hours, {R('sum(s*2500*60*5)/3600.0/4')} AS wall_hours, {R('sum(s*2500*60*5)/3600.0*0.7844')} AS cost, arg_max(arm,s) AS slowest_arm FROM a""", views="")
def _(t):
    arms = t("orders").groupBy(F.col("o_orderpriority").alias("arm")).agg((F.avg("o_totalprice") / 1e5).alias("sec_per_step"))
    p = Q.budget_projection(arms, 2500, 60, 5, 4, 0.7844)
    return p.select(r6("gpu_hours"), r6("wall_hours"), r6("cost"), "slowest_arm")


@query("q23_feature_export_check", """SELECT vec_id AS row_id, unnest(list_filter([CASE WHEN vec_id%5=0 THEN 'bad_instance' END, CASE WHEN vec_id%7=0 THEN 'bad_iou' END, CASE WHEN label=9 AND vec_id%2=0 THEN 'bad_grade' END], lambda v: v IS NOT NULL)) AS rule FROM embeddings""", views="")
def _(t):
    n = F.col("vec_id")
    rows = t("embeddings").select(
        n.alias("row_id"), F.col("embedding").alias("f"), (n % 5).alias("instance_id"), F.when(n % 7 == 0, 1.5).otherwise(0.5).alias("anchor_iou"),
        F.when(F.col("label") == 9, 9).otherwise(2 + F.col("label") % 4).alias("grade"), (n % 2 == 0).alias("supervised"),
    )
    return Q.check_features(rows, 64)


@query("q24_prevalence_report", ENTRIES + """, b AS (SELECT 'case' AS level, coalesce(case_ISUP,-1) AS grade FROM (SELECT DISTINCT case_id, case_ISUP FROM en) UNION ALL SELECT 'lesion', coalesce(grade,-1) FROM en)
   SELECT level, grade, count(*) AS n FROM b GROUP BY GROUPING SETS ((level, grade), (level))""")
def _(t):
    return Q.prevalence(marksheet(t))


@query("q2_renumber_ids", "SELECT gt_id, dense_rank() OVER (PARTITION BY case_id ORDER BY gt_id) AS instance_id FROM gt")
def _(t):
    return Q.rank_ids(t.gt, ["case_id"], "gt_id").select("gt_id", "instance_id")


@query("q12_id_fingerprint_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang", views="")
def _(t):
    return Q.id_fingerprint(t("documents"), ["lang"], "doc_id").select("lang", big("n").alias("n"))


@query("q12_id_fingerprint", f"""{CRC_STEPS}, b AS (SELECT lang, {crc32_sql("doc_id::VARCHAR")} % 1024 AS b, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS h
   FROM documents, crc_steps GROUP BY 1, 2)
   SELECT lang, sum(n)::BIGINT AS n, sha256(string_agg(b || ':' || h, chr(10) ORDER BY b)) AS fingerprint FROM b GROUP BY lang""", views="")
def _(t):
    return Q.id_fingerprint(t("documents"), ["lang"], "doc_id")


@query("q17_completeness_both_sides", """w AS (SELECT DISTINCT case_id FROM gt WHERE grade>=3), f AS (SELECT DISTINCT case_id FROM det WHERE score>0.9)
   SELECT case_id, 'missing' AS only_in FROM w WHERE case_id NOT IN (SELECT case_id FROM f) UNION ALL SELECT case_id, 'unexpected' FROM f WHERE case_id NOT IN (SELECT case_id FROM w)""")
def _(t):
    return Q.completeness(t.gt.filter("grade >= 3"), t.det.filter("score > 0.9"), ["case_id"])
