"""Pair joins, matching and detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.operators import detection_metrics as DM
from boxtally.operators import matching as M
from boxtally.operators import pairs as P
from boxtally.operators.curves import exceeds
from boxtally.operators.grade_metrics import grade_matches
from boxtally.plans.registry import big, query, r6
from boxtally.plans.sqlparts import R, iou, match_sql, overlap
from boxtally.session import cut_lineage

IOU_DG = iou("d", "g")


@query("j1_iou_join", f"SELECT d.det_id, g.gt_id, {R(IOU_DG)} AS iou FROM det d JOIN gt g ON d.case_id=g.case_id AND {overlap('d','g')}")
def _(t):
    return P.iou_join(t.det, t.gt, cell=32.0).select(F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), r6("iou"))


@query("j1_iou_join_same_class", f"SELECT d.det_id, g.gt_id, {R(IOU_DG)} AS iou FROM det d JOIN gt g ON d.case_id=g.case_id AND d.label=g.label AND {overlap('d','g')} WHERE {IOU_DG} >= 0.3")
def _(t):
    return P.iou_join(t.det, t.gt, ("case_id", "label"), min_iou=0.3).select(F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), r6("iou"))


def _coco_part(n: str, thr: float, det: str = "det_top") -> str:
    return match_sql(n, det=det, keys="case_id, label", thr=str(thr), pref="ignore, iou DESC, gt_id DESC")


_TOP = "det_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY score DESC, det_id) AS rk FROM det) WHERE rk <= {k})"
_COCO = _TOP.format(k=100) + "," + _coco_part("m1", 0.1) + "," + _coco_part("m5", 0.5) + """,
    ev AS (SELECT *, row_number() OVER (PARTITION BY iou_thr, case_id, label ORDER BY score DESC, det_id) AS rk FROM
       (SELECT 0.1::DOUBLE AS iou_thr, m1.*, coalesce(g.ignore, false) AS ignored FROM m1 LEFT JOIN gt g USING (gt_id)
        UNION ALL SELECT 0.5::DOUBLE, m5.*, coalesce(g.ignore, false) FROM m5 LEFT JOIN gt g USING (gt_id))
       AS e(iou_thr, case_id, label, det_id, score, gt_id, ignored)),
    sup AS (SELECT label, count(*) AS num_gt FROM gt WHERE NOT ignore GROUP BY label)"""
_COCO = _COCO.replace("m1.*", "m1.case_id, m1.label, m1.det_id, m1.score, m1.gt_id").replace("m5.*", "m5.case_id, m5.label, m5.det_id, m5.score, m5.gt_id")


@query("j2_coco_match", _TOP.format(k=10) + "," + _coco_part("m1", 0.1) + "," + _coco_part("m5", 0.5) +
       " SELECT 0.1::DOUBLE AS iou_thr, m1.det_id, m1.gt_id, m1.gt_id IS NOT NULL AS matched, coalesce(g.ignore,false) AS ignored FROM m1 LEFT JOIN gt g USING (gt_id)"
       " UNION ALL SELECT 0.5::DOUBLE, m5.det_id, m5.gt_id, m5.gt_id IS NOT NULL, coalesce(g.ignore,false) FROM m5 LEFT JOIN gt g USING (gt_id)")
def _(t):
    return M.coco_match(t.det, t.gt, [0.1, 0.5], max_detections=10).select("iou_thr", "det_id", "gt_id", "matched", "ignored")


@query("j3_greedy_match", match_sql("m", thr="0.5") + " SELECT case_id, det_id, gt_id FROM m")
def _(t):
    return M.greedy_match(t.det, t.gt, 0.5).select("case_id", "det_id", "gt_id")


@query("j7_first_fit_match", match_sql("m", thr="0.2", pref="gt_id", order="det_id") + " SELECT case_id, det_id, gt_id FROM m")
def _(t):
    return M.first_fit_match(t.det, t.gt, 0.2).select("case_id", "det_id", "gt_id")


_BEST = f"""best AS (SELECT det_id, arg_max(gt_id, (v, -gt_id)) AS gt_id, max(v) AS v FROM
    (SELECT d.det_id, g.gt_id, {IOU_DG} AS v FROM det d JOIN gt g ON d.case_id=g.case_id AND {overlap('d','g')}) GROUP BY det_id)"""


@query("j8_argmax_overlap_label", _BEST + f""" SELECT d.det_id, CASE WHEN b.v >= 0.1 THEN b.gt_id END AS gt_id,
       coalesce(CASE WHEN b.v >= 0.1 THEN g.label END, -1) AS target, {R('coalesce(CASE WHEN b.v >= 0.1 THEN b.v END, 0.0)')} AS iou
       FROM det d LEFT JOIN best b USING (det_id) LEFT JOIN gt g ON g.gt_id=b.gt_id""")
def _(t):
    return DM.argmax_overlap_label(t.det, t.gt, 0.1).select("det_id", "gt_id", big("target").alias("target"), r6("iou"))


@query("j8_missed_gt", f"SELECT g.gt_id, g.label FROM gt g WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.case_id=g.case_id AND {IOU_DG} >= 0.4)")
def _(t):
    return DM.missed_gt(t.det, t.gt, 0.4).select("gt_id", "label")


_J9 = match_sql("m", thr="0.1") + """, j AS (SELECT m.case_id, m.det_id, m.gt_id, g.grade, g.supervised FROM m LEFT JOIN gt g USING (gt_id))"""


@query("j9_match_grades", _J9 + """ SELECT c.case_id,
    (SELECT count(*) FROM j WHERE j.case_id=c.case_id AND supervised) AS matched,
    (SELECT count(*) FROM j WHERE j.case_id=c.case_id AND NOT supervised) AS matched_unsupervised,
    (SELECT count(*) FROM j WHERE j.case_id=c.case_id AND gt_id IS NULL) AS false_positives,
    (SELECT count(*) FROM gt g WHERE g.case_id=c.case_id AND g.supervised AND g.gt_id NOT IN (SELECT gt_id FROM m WHERE gt_id IS NOT NULL)) AS misses
    FROM cases c""")
def _(t):
    return grade_matches(t.det, t.gt, t.cases, 0.1)


_PAIR = f"pr AS (SELECT a.case_id, {iou('a','b')} AS v FROM gt a JOIN gt b ON a.case_id=b.case_id AND a.gt_id<>b.gt_id)"


@query("j16_pairwise_iou_stats", _PAIR + f""" SELECT n.case_id, n.num_boxes, n.num_boxes*(n.num_boxes-1) AS pairs,
   (SELECT count(*) FROM pr WHERE pr.case_id=n.case_id AND v>0) AS overlapping_pairs,
   {R('(SELECT avg(v) FROM pr WHERE pr.case_id=n.case_id)')} AS mean_iou, {R('(SELECT max(v) FROM pr WHERE pr.case_id=n.case_id)')} AS max_iou
   FROM (SELECT case_id, count(*) AS num_boxes FROM gt GROUP BY case_id) n""")
def _(t):
    s = P.pairwise_iou_stats(t.gt, ["case_id"], "gt_id")
    return s.select("case_id", "num_boxes", "pairs", "overlapping_pairs", r6("mean_iou", "mean_iou"), r6("max_iou", "max_iou"))


@query("j16_pairwise_iou_per_class", _PAIR.replace("a.case_id=b.case_id", "a.case_id=b.case_id AND a.label=b.label").replace("a.case_id, ", "a.case_id, a.label, ", 1) + f"""
   SELECT n.case_id, n.label, n.num_boxes, {R('(SELECT avg(v) FROM pr WHERE pr.case_id=n.case_id AND pr.label=n.label)')} AS mean_iou
   FROM (SELECT case_id, label, count(*) AS num_boxes FROM gt GROUP BY case_id, label) n""")
def _(t):
    s = P.pairwise_iou_stats(t.gt, ["case_id", "label"], "gt_id")
    return s.select("case_id", "label", "num_boxes", r6("mean_iou", "mean_iou"))


@query("j17_neighbour_count", """SELECT a.gt_id, count(*) AS neighbours FROM gt a JOIN gt b ON a.case_id=b.case_id
   AND abs((a.x1+a.x2)/2-(b.x1+b.x2)/2)<=6.0 AND abs((a.y1+a.y2)/2-(b.y1+b.y2)/2)<=6.0 AND abs((a.z1+a.z2)/2-(b.z1+b.z2)/2)<=3.0 GROUP BY a.gt_id""")
def _(t):
    return P.neighbour_count(t.gt, [12.0, 12.0, 6.0]).select("gt_id", "neighbours")


# ---- average precision and FROC

_AP = _COCO + """, caps(max_det) AS (VALUES (1),(10),(100)),
    cum AS (SELECT e.label, e.iou_thr, c.max_det, e.score, s.num_gt,
                   sum(CASE WHEN gt_id IS NOT NULL THEN 1 ELSE 0 END) OVER w AS tp, sum(CASE WHEN gt_id IS NULL THEN 1 ELSE 0 END) OVER w AS fp
            FROM ev e JOIN caps c ON e.rk <= c.max_det JOIN sup s ON s.label=e.label WHERE NOT ignored
            WINDOW w AS (PARTITION BY e.label, e.iou_thr, c.max_det ORDER BY e.score DESC, e.case_id, e.rk ROWS UNBOUNDED PRECEDING)),
    grid AS (SELECT s.label, t.iou_thr, c.max_det, l.level FROM sup s, (VALUES (0.1::DOUBLE),(0.5::DOUBLE)) t(iou_thr), caps c, (SELECT unnest(range(0,101)) AS level) l),
    ap AS (SELECT g.label, g.iou_thr, g.max_det, g.level, coalesce(max(tp/(tp+fp+2.220446049250313e-16)),0.0) AS pr, coalesce(max(score),0.0) AS sc
           FROM grid g LEFT JOIN cum c ON c.label=g.label AND c.iou_thr=g.iou_thr AND c.max_det=g.max_det AND c.tp*100 >= g.level*c.num_gt
           GROUP BY g.label, g.iou_thr, g.max_det, g.level)"""


def _events(t):
    return M.coco_match(t.det, t.gt, [0.1, 0.5])


@query("a1_coco_ap", _AP + f" SELECT label, iou_thr, CAST(max_det AS BIGINT) AS max_det, level, {R('pr')} AS precision, {R('sc')} AS score FROM ap")
def _(t):
    ap = DM.coco_ap(_events(t), t.gt, [0.1, 0.5], large=exceeds(t.det))
    return ap.select("label", "iou_thr", big("max_det").alias("max_det"), "level", r6("precision"), r6("score")).toDF(
        "label", "iou_thr", "max_det", "level", "precision", "score")


@query("a1_coco_recall", _COCO + f" SELECT e.label, e.iou_thr, {R('sum(CASE WHEN gt_id IS NOT NULL THEN 1 ELSE 0 END)*1.0/any_value(num_gt)')} AS recall FROM ev e JOIN sup s ON s.label=e.label WHERE NOT ignored AND rk<=100 GROUP BY ALL")
def _(t):
    return DM.coco_recall(_events(t), t.gt).select("label", "iou_thr", r6("recall", "recall"))


@query("a2_map_range", _AP + f" SELECT {R('(sum(pr) - 202.0) / (3*202.0)')} AS map, {R('avg(pr)')} AS map_present FROM ap WHERE max_det=100")
def _(t):
    ap = DM.coco_ap(_events(t), t.gt, [0.1, 0.5], [100], large=exceeds(t.det))
    with_absent = DM.map_range(ap, [0, 1, 2])
    present = DM.map_range(ap, [0, 1], keep_absent=False).withColumnRenamed("map", "map_present")
    return with_absent.join(F.broadcast(present)).select(r6("map", "map"), r6("map_present", "map_present"))


def _froc_sql(by: str = "") -> str:
    k = "iou_thr" + by
    on = " AND ".join(f"p.{c.strip()}=k.{c.strip()}" for c in k.split(","))
    sup = "sup.num_gt" if by else "(SELECT sum(num_gt) FROM sup)"
    join = "JOIN sup USING (label)" if by else ""
    ek = k
    return _COCO + f""", tie AS (SELECT {ek}, score, sum(CASE WHEN gt_id IS NOT NULL THEN 1 ELSE 0 END) AS tp1, sum(CASE WHEN gt_id IS NULL THEN 1 ELSE 0 END) AS fp1 FROM ev WHERE NOT ignored GROUP BY {ek}, score),
    pts AS (SELECT {k}, -score AS i, sum(fp1) OVER w / 200.0 AS x, CAST(sum(tp1) OVER w AS DOUBLE) / {sup} AS y FROM tie {join} WINDOW w AS (PARTITION BY {k} ORDER BY score DESC)
            UNION ALL SELECT DISTINCT {k}, -1e308, 0.0, 0.0 FROM tie),
    tg(target) AS (VALUES (0.125::DOUBLE),(0.25::DOUBLE),(0.5::DOUBLE),(1.0::DOUBLE),(2.0::DOUBLE),(4.0::DOUBLE),(8.0::DOUBLE)),
    rd AS (SELECT k.*, target, (SELECT arg_max((x,y), i) FROM pts p WHERE {on} AND x <= target) AS lo, (SELECT arg_min((x,y), i) FROM pts p WHERE {on} AND x > target) AS hi
           FROM (SELECT DISTINCT {k} FROM pts) k, tg),
    fr AS (SELECT {k}, target, CASE WHEN hi IS NULL THEN lo[2] ELSE lo[2] + (hi[2]-lo[2])/(hi[1]-lo[1])*(target-lo[1]) END AS value FROM rd)"""


_FROC = _froc_sql().replace("/ 200.0", "/ (SELECT count(*)::DOUBLE FROM cases)")
_FROC_C = _froc_sql(", label").replace("/ 200.0", "/ (SELECT count(*)::DOUBLE FROM cases)")


def _images(t):
    return t.cases.count()


@query("a3_froc", _FROC + f" SELECT iou_thr, target, {R('value')} AS sensitivity FROM fr")
def _(t):
    return DM.froc(_events(t), t.gt, _images(t), large=exceeds(t.det)).select("iou_thr", "target", r6("value", "sensitivity"))


@query("a3_froc_score", _FROC + f" SELECT iou_thr, {R('avg(value)')} AS froc_score FROM fr GROUP BY iou_thr")
def _(t):
    curve = DM.froc(_events(t), t.gt, _images(t), large=exceeds(t.det))
    return DM.froc_score(curve, ["iou_thr"]).select("iou_thr", r6("froc_score", "froc_score"))


@query("a3_froc_per_class", _FROC_C + f" SELECT iou_thr, label, target, {R('value')} AS sensitivity FROM fr")
def _(t):
    curve = DM.froc(_events(t), t.gt, _images(t), per_class=True, large=exceeds(t.det))
    return curve.select("iou_thr", "label", "target", r6("value", "sensitivity"))


_A4_PARTS = ",".join(
    [match_sql("q0", thr="0.5")]
    + [f"gt{g} AS (SELECT * FROM gt WHERE supervised AND grade={g}), det{g} AS (SELECT *, score*p{g} AS s{g} FROM det)," + match_sql(f"q{g}", det=f"det{g}", gt=f"gt{g}", thr="0.5", score=f"s{g}") for g in (2, 3, 4, 5)]
)
_A4 = _A4_PARTS + """,
    ev AS (SELECT 0 AS analysis, q0.score, CASE WHEN supervised THEN grade END AS grade, q0.gt_id IS NULL AS fp FROM q0 LEFT JOIN gt USING (gt_id)
    """ + " ".join(f"UNION ALL SELECT {g}, score, CASE WHEN gt_id IS NOT NULL THEN {g} END, gt_id IS NULL FROM q{g}" for g in (2, 3, 4, 5)) + """),
    np AS (SELECT count(DISTINCT patient_id) AS n FROM cases),
    sup AS (SELECT grade, count(*) AS support FROM gt WHERE supervised GROUP BY grade),
    tie AS (SELECT analysis, score, sum(fp::INT) AS fp1, """ + ", ".join(f"sum(CASE WHEN grade={g} THEN 1 ELSE 0 END) AS t{g}" for g in (2, 3, 4, 5)) + """ FROM ev GROUP BY ALL),
    cum AS (SELECT analysis, sum(fp1) OVER w AS fp, """ + ", ".join(f"sum(t{g}) OVER w AS c{g}" for g in (2, 3, 4, 5)) + """ FROM tie WINDOW w AS (PARTITION BY analysis ORDER BY score DESC)),
    lng AS (""" + " UNION ALL ".join(f"SELECT analysis, {g} AS grade, fp, c{g} AS tp FROM cum WHERE analysis IN (0,{g})" for g in (2, 3, 4, 5)) + """)
    SELECT CASE WHEN k.analysis=0 THEN 'generic' ELSE 'grade_specific' END AS analysis, CAST(k.grade AS BIGINT) AS grade, target,
           round(coalesce((SELECT max(tp) FROM lng l WHERE l.analysis=k.analysis AND l.grade=k.grade AND l.fp <= target*np.n),0)/CAST(support AS DOUBLE),6)+0.0 AS sensitivity,
           support, np.n AS num_patients
    FROM (SELECT DISTINCT analysis, grade FROM lng) k, (VALUES (0.5::DOUBLE),(1.0::DOUBLE),(10.0::DOUBLE),(40.0::DOUBLE)) t(target), np, sup WHERE sup.grade=k.grade"""


def patients(t):
    return t.cases.agg(F.countDistinct("patient_id").alias("num_patients"))


def flagship(t):
    """Sensitivity per grade at false positives per patient."""
    events = DM.grade_froc_events(t.det, t.gt)
    out = DM.harmonized_froc(events, DM.grade_support(t.gt), patients(t), (0.5, 1.0, 10.0, 40.0), large=exceeds(t.det))
    return out.select("analysis", "grade", "target", r6("sensitivity", "sensitivity"), "support", "num_patients")


@query("a4_harmonized_froc", _A4)
def _(t):
    return flagship(t)


@query("a5_pool_folds", _A4)
def _(t):
    # every fold's events are an artifact of their own, written once and pooled later
    events = cut_lineage(DM.grade_froc_events(t.det, t.gt))
    folds = range(5)
    pick = lambda df, f: df.filter(F.col("patient_id") % 5 == f)
    pooled = DM.pool_fold_events(
        [pick(events, f) for f in folds], [DM.grade_support(pick(t.gt, f)) for f in folds],
        [pick(t.cases, f).select("patient_id") for f in folds],
    )
    out = DM.harmonized_froc(*pooled, (0.5, 1.0, 10.0, 40.0), large=exceeds(t.det))
    return out.select("analysis", "grade", "target", r6("sensitivity", "sensitivity"), "support", "num_patients")


@query("a14_prediction_histogram", _COCO + """, found AS (SELECT iou_thr, count(gt_id) AS tp FROM ev WHERE NOT ignored GROUP BY iou_thr),
   h AS (SELECT iou_thr, gt_id IS NOT NULL AS matched, least(CAST(floor(score*50) AS BIGINT),49) AS bin, count(*) AS n FROM ev WHERE NOT ignored AND score BETWEEN 0 AND 1 GROUP BY ALL
         UNION ALL SELECT iou_thr, true, 0, (SELECT sum(num_gt) FROM sup)-tp FROM found)
   SELECT iou_thr, matched, bin, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL HAVING sum(n) > 0""")
def _(t):
    return DM.prediction_histogram(_events(t), t.gt)


@query("a14_prediction_histogram_per_class", _COCO + """, found AS (SELECT iou_thr, label, count(gt_id) AS tp FROM ev WHERE NOT ignored GROUP BY ALL),
   h AS (SELECT iou_thr, label, gt_id IS NOT NULL AS matched, least(CAST(floor(score*50) AS BIGINT),49) AS bin, count(*) AS n FROM ev WHERE NOT ignored AND score BETWEEN 0 AND 1 GROUP BY ALL
         UNION ALL SELECT iou_thr, label, true, 0, num_gt-tp FROM found JOIN sup USING (label))
   SELECT iou_thr, label, matched, bin, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL HAVING sum(n) > 0""")
def _(t):
    return DM.prediction_histogram(_events(t), t.gt, per_class=True)


# ---- classes without detections, folds without events

_NO_CLASS_1 = _COCO.replace("ev AS (", "ev_all AS (", 1) + ", ev AS (SELECT * FROM ev_all WHERE label<>1)"


def _events_without_class_1(t):
    return M.coco_match(t.det.filter("label <> 1"), t.gt, [0.1, 0.5])


@query("a1_coco_recall_undetected", _NO_CLASS_1 + f""" SELECT s.label, t.iou_thr, {R('(SELECT count(gt_id) FROM ev e WHERE e.label=s.label AND e.iou_thr=t.iou_thr AND NOT ignored AND rk<=100)*1.0/num_gt')} AS recall
   FROM sup s, (VALUES (0.1::DOUBLE),(0.5::DOUBLE)) t(iou_thr)""")
def _(t):
    return DM.coco_recall(_events_without_class_1(t), t.gt, thresholds=[0.1, 0.5]).select("label", "iou_thr", r6("recall"))


@query("a3_froc_per_class_undetected", _FROC_C + f""" SELECT t.iou_thr, s.label, g.target, {R('coalesce(CASE WHEN s.label<>1 THEN value END, 0.0)')} AS sensitivity
   FROM sup s CROSS JOIN (VALUES (0.1::DOUBLE),(0.5::DOUBLE)) t(iou_thr) CROSS JOIN tg g LEFT JOIN fr ON fr.label=s.label AND fr.iou_thr=t.iou_thr AND fr.target=g.target""")
def _(t):
    curve = DM.froc(_events_without_class_1(t), t.gt, _images(t), per_class=True, large=exceeds(t.det), thresholds=[0.1, 0.5])
    return curve.select("iou_thr", "label", "target", r6("value", "sensitivity"))


@query("a4_harmonized_froc_no_events", f"""np AS (SELECT count(DISTINCT patient_id) AS n FROM cases), sup AS (SELECT grade, count(*) AS support FROM gt WHERE supervised GROUP BY grade)
   SELECT a.analysis, CAST(grade AS BIGINT) AS grade, t.target, 0.0::DOUBLE AS sensitivity, support, np.n AS num_patients
   FROM sup, np, (VALUES ('generic'),('grade_specific')) a(analysis), (VALUES (0.5::DOUBLE),(1.0::DOUBLE)) t(target)""")
def _(t):
    events = DM.grade_froc_events(t.det.filter("score > 2"), t.gt)
    return DM.harmonized_froc(events, DM.grade_support(t.gt), patients(t), (0.5, 1.0))


@query("a14_prediction_histogram_undetected", _NO_CLASS_1 + """, h AS (SELECT iou_thr, label, gt_id IS NOT NULL AS matched, least(CAST(floor(score*50) AS BIGINT),49) AS bin, count(*) AS n FROM ev WHERE NOT ignored AND score BETWEEN 0 AND 1 GROUP BY ALL
         UNION ALL SELECT t.iou_thr, s.label, true, 0, num_gt-(SELECT count(gt_id) FROM ev e WHERE e.label=s.label AND e.iou_thr=t.iou_thr AND NOT ignored) FROM sup s, (VALUES (0.1::DOUBLE),(0.5::DOUBLE)) t(iou_thr))
   SELECT iou_thr, label, matched, bin, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY ALL HAVING sum(n) > 0""")
def _(t):
    return DM.prediction_histogram(_events_without_class_1(t), t.gt, per_class=True, thresholds=[0.1, 0.5])


# ---- threshold sweeps; lesion class = grade - 1


def _sweep_sql(groups: dict[str, str]) -> str:
    parts = ["kept AS (SELECT * FROM det WHERE score >= 0.2)", "coh AS (SELECT DISTINCT case_id FROM kept)"]
    unions, sups = [], []
    for n, cond in groups.items():
        parts.append(f"gt_{n} AS (SELECT * FROM gt WHERE {cond} AND case_id IN (SELECT case_id FROM coh))")
        parts.append(f"det_{n} AS (SELECT * FROM kept WHERE case_id IN (SELECT case_id FROM gt_{n}))")
        parts.append(match_sql(f"m_{n}", det=f"det_{n}", gt=f"gt_{n}", thr="0.1", pref="gt_id"))
        unions.append(f"SELECT '{n}' AS type, score, gt_id FROM m_{n}")
        sups.append(f"SELECT '{n}' AS type, count(*) AS num_gt FROM gt_{n}")
    return ", ".join(parts) + f""", e AS ({' UNION ALL '.join(unions)}), s AS (SELECT * FROM ({' UNION ALL '.join(sups)}) WHERE num_gt > 0),
      cur AS (SELECT s.type, l.level, CAST(count(CASE WHEN e.score IS NOT NULL AND e.gt_id IS NULL THEN 1 END) AS DOUBLE) / (SELECT count(*) FROM coh) AS fps,
                     CAST(count(e.gt_id) AS DOUBLE) / any_value(num_gt) AS sens
              FROM s CROSS JOIN (SELECT unnest(range(1,100)) AS level) l LEFT JOIN e ON e.type=s.type AND e.score >= l.level/100.0 GROUP BY s.type, l.level)"""


_TYPES = {"idx": "grade=5", "clinical": "grade>=3", "every": "true"}
_CLASSES = {f"c{k}": f"grade={k + 1}" for k in range(5)}


def _types():
    return {"idx": F.col("grade") == 5, "clinical": F.col("grade") >= 3, "every": F.lit(True)}


@query("a15_threshold_froc", _sweep_sql(_TYPES) + f" SELECT type, level, {R('fps')} AS fp_per_patient, {R('sens')} AS sensitivity FROM cur")
def _(t):
    return DM.threshold_froc(t.det, t.gt, _types()).select("type", "level", r6("fp_per_patient", "fp_per_patient"), r6("sensitivity", "sensitivity"))


def crossing_sql(cur: str, by: str, other: str, targets) -> str:
    return f"""st AS (SELECT type, {by} AS b1, {other} AS o1, lag({by}) OVER w AS b0, lag({other}) OVER w AS o0, row_number() OVER w AS n FROM {cur} WINDOW w AS (PARTITION BY type ORDER BY {by}, {other})),
      tg(target) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in targets)}),
      cr AS (SELECT type, target, coalesce(arg_min(CASE WHEN o0 IS NULL THEN o1 WHEN b1=b0 THEN o0 ELSE o0+(o1-o0)*(target-b0)/(b1-b0) END, n) FILTER (WHERE b1>=target), arg_max(o1, n)) AS v
             FROM st, tg GROUP BY type, target)"""


@query("a16_per_grade_fp_at_sens", _sweep_sql(_CLASSES) + "," + crossing_sql("cur", "sens", "fps", [0.2, 0.4, 0.6]) + f" SELECT type, target, {R('v')} AS fp_per_patient FROM cr")
def _(t):
    groups = {f"c{k}": F.col("grade") == k + 1 for k in range(5)}
    curve = DM.threshold_froc(t.det, t.gt, groups)
    return DM.fp_at_sensitivity(curve, (0.2, 0.4, 0.6)).select("type", "target", r6("fp_per_patient", "fp_per_patient"))


_CONF = f"""kept AS (SELECT * FROM det WHERE score > 0.05), {_BEST.replace('FROM det d', 'FROM kept d')},
   lb AS (SELECT d.case_id, d.det_id, d.score, d.label, coalesce(CASE WHEN b.v >= 0.3 THEN g.label END, -1) AS target FROM kept d LEFT JOIN best b USING (det_id) LEFT JOIN gt g ON g.gt_id=b.gt_id),
   mis AS (SELECT g.* FROM gt g WHERE NOT EXISTS (SELECT 1 FROM kept d WHERE d.case_id=g.case_id AND {IOU_DG} >= 0.3))"""


@query("a17_confusion_with_background", _CONF + """ SELECT pred, target, count(*) AS n FROM (SELECT label AS pred, target FROM lb UNION ALL
   SELECT -1, CASE WHEN case_id IN (SELECT case_id FROM kept) THEN 0 ELSE label END FROM mis) GROUP BY ALL""")
def _(t):
    return DM.confusion_with_background(t.det, t.gt, 0.3, 0.05)


@query("a17_confusion_true_class", _CONF + " SELECT pred, target, count(*) AS n FROM (SELECT label AS pred, target FROM lb UNION ALL SELECT -1, label FROM mis) GROUP BY ALL")
def _(t):
    return DM.confusion_with_background(t.det, t.gt, 0.3, 0.05, true_class=True)


_OVER = _CONF + """, tg AS (SELECT *, CASE WHEN label=target AND score>0.5 THEN 'tp_high' WHEN label=target AND score<0.5 THEN 'tp_low' WHEN label=target THEN 'tp_mid' ELSE 'fp' END AS side FROM lb),
   rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY CASE WHEN side='tp_low' THEN score ELSE -score END, det_id) AS r FROM tg),
   ov AS (SELECT c.case_id, (SELECT count(*) FROM gt WHERE gt.case_id=c.case_id) AS num_gt, (SELECT count(*) FROM lb WHERE lb.case_id=c.case_id AND label=target) AS iou_tp,
     (SELECT count(*) FROM mis WHERE mis.case_id=c.case_id) AS num_fn,
     (SELECT string_agg(det_id, ',' ORDER BY r) FROM rk WHERE rk.case_id=c.case_id AND side='tp_high' AND r<=3) AS tp_high,
     (SELECT string_agg(det_id, ',' ORDER BY r) FROM rk WHERE rk.case_id=c.case_id AND side='tp_low' AND r<=3) AS tp_low,
     (SELECT string_agg(det_id || CASE WHEN target=-1 THEN ':fp_iou' ELSE ':fp_cls' END, ',' ORDER BY r) FROM rk WHERE rk.case_id=c.case_id AND side='fp' AND r<=5) AS fp FROM cases c)"""


def _ids(name, with_kind=False):
    text = (lambda e: F.concat(e["det_id"], F.lit(":"), e["kind"])) if with_kind else (lambda e: e["det_id"].cast("string"))
    joined = F.array_join(F.transform(name, text), ",")
    return F.when(F.size(name) > 0, joined).alias(name)


def _overview(t):
    return DM.case_overview(t.det, t.gt, t.cases, 0.3, 0.05)


@query("a18_case_overview", _OVER + " SELECT * FROM ov")
def _(t):
    return _overview(t).select("case_id", "num_gt", "iou_tp", "num_fn", _ids("tp_high"), _ids("tp_low"), _ids("fp", True))


@query("a19_box_size_by_outcome", _CONF + """, o AS (SELECT CASE WHEN l.target=l.label THEN 'tp' ELSE 'fp' END AS outcome, d.x2-d.x1+d.y2-d.y1+d.z2-d.z1 AS s FROM lb l JOIN det d USING (det_id)
   UNION ALL SELECT 'fn', x2-x1+y2-y1+z2-z1 FROM mis) SELECT outcome, CAST(floor(s) AS BIGINT) AS size, count(*) AS n FROM o GROUP BY ALL""")
def _(t):
    return DM.box_sizes_by_outcome(t.det, t.gt, 0.3, 0.05)


@query("w8_global_top_n", _CONF + " SELECT case_id, count(*) AS num_fn FROM mis GROUP BY case_id ORDER BY num_fn DESC, case_id LIMIT 10")
def _(t):
    from boxtally.operators.curves import global_top_n

    lost = DM.missed_gt(t.det.filter("score > 0.05"), t.gt, 0.3).groupBy("case_id").agg(F.count(F.lit(1)).alias("num_fn"))
    return global_top_n(lost, [F.desc("num_fn"), F.asc("case_id")], 10)
