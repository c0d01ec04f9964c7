"""Assignment, lookups, curves, grade / case / dataset metrics (J4–J6, J11–J15, W, A6–A13, A20–A30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.operators import assign as AS
from boxtally.operators import case_metrics as CM
from boxtally.operators import curves as W
from boxtally.operators import dataset_stats as DS
from boxtally.operators import detection_metrics as DM
from boxtally.operators import grade_metrics as GM
from boxtally.operators import lookups as L
from boxtally.operators.matching import greedy_match
from boxtally.plans.matching_queries import _TYPES, _sweep_sql, _types, crossing_sql
from boxtally.plans.registry import big, query, r6
from boxtally.plans.sqlparts import R, iou, match_sql, overlap

IOU_DG = iou("d", "g")

# ---- assignment

_ASSIGN = f"""pr AS (SELECT d.case_id, d.det_id, g.gt_id, {IOU_DG} AS v FROM det d JOIN gt g ON d.case_id=g.case_id AND {overlap('d', 'g')}),
  bst AS (SELECT det_id, arg_max(gt_id, (v, -gt_id)) AS gt_id, max(v) AS v FROM pr GROUP BY det_id),
  base AS (SELECT d.case_id, d.det_id, CASE WHEN coalesce(b.v,0)<0.2 THEN -1 WHEN b.v<0.5 THEN -2 ELSE b.gt_id END AS gt_id, coalesce(b.v,0.0) AS v FROM det d LEFT JOIN bst b USING (det_id)),
  top AS (SELECT gt_id, arg_max(det_id, (v, -det_id)) AS det_id FROM pr GROUP BY gt_id),
  cl AS (SELECT coalesce(t.det_id, (SELECT min(det_id) FROM det d WHERE d.case_id=g.case_id)) AS det_id, max(g.gt_id) AS gt_id FROM gt g LEFT JOIN top t USING (gt_id) GROUP BY 1),
  asg AS (SELECT b.case_id, b.det_id, coalesce(c.gt_id, b.gt_id) AS gt_id, b.v FROM base b LEFT JOIN cl c USING (det_id))"""


@query("j4_iou_assign", _ASSIGN + f" SELECT det_id, CAST(gt_id AS BIGINT) AS gt_id, {R('v')} AS iou FROM base")
def _(t):
    return AS.iou_assign(t.det, t.gt, 0.2, 0.5).select("det_id", big("gt_id").alias("gt_id"), r6("iou"))


@query("j4_iou_assign_best_per_gt", _ASSIGN + f" SELECT det_id, CAST(gt_id AS BIGINT) AS gt_id, {R('v')} AS iou FROM asg")
def _(t):
    return AS.iou_assign(t.det, t.gt, 0.2, 0.5, best_per_gt=True).select("det_id", big("gt_id").alias("gt_id"), r6("iou"))


_D2 = "+".join(f"((d.{c}1+d.{c}2)/2-(g.{c}1+g.{c}2)/2)*((d.{c}1+d.{c}2)/2-(g.{c}1+g.{c}2)/2)" for c in "xyz")
_MARGIN = "least(" + ",".join(f"(d.{c}1+d.{c}2)/2-g.{c}1, g.{c}2-(d.{c}1+d.{c}2)/2" for c in "xyz") + ")"


@query("j5_adaptive_assign", f"""nr AS (SELECT * FROM (SELECT d.case_id, d.det_id, g.gt_id, {IOU_DG} AS v, {_MARGIN} AS m,
     row_number() OVER (PARTITION BY g.gt_id, d.model ORDER BY sqrt({_D2}), d.det_id) AS r FROM det d JOIN gt g ON d.case_id=g.case_id) WHERE r<=4),
   th AS (SELECT *, avg(v) OVER w + stddev_samp(v) OVER w AS thr FROM nr WINDOW w AS (PARTITION BY gt_id)),
   ps AS (SELECT det_id, arg_max(gt_id, (v, -gt_id)) AS gt_id, max(v) AS v FROM th WHERE v>=thr AND m>0.01 GROUP BY det_id)
   SELECT d.det_id, coalesce(p.gt_id,-1) AS gt_id, {R('coalesce(p.v,0.0)')} AS iou FROM det d LEFT JOIN ps p USING (det_id)""")
def _(t):
    return AS.adaptive_assign(t.det, t.gt, 4, level="model").select("det_id", big("gt_id").alias("gt_id"), r6("iou"))


@query("j6_assign_attributes", _ASSIGN + f""" SELECT a.det_id, CASE WHEN a.gt_id>=0 THEN a.gt_id END AS gt_id,
   CAST(CASE WHEN a.gt_id>=0 THEN g.label+1 WHEN a.gt_id=-1 THEN 0 ELSE -1 END AS BIGINT) AS target, CASE WHEN g.supervised THEN g.grade END AS grade,
   coalesce(g.supervised,false) AS supervised, {R('CASE WHEN a.gt_id>=0 THEN a.v ELSE 0.0 END')} AS iou FROM base a LEFT JOIN gt g ON g.gt_id=a.gt_id""")
def _(t):
    out = AS.assign_attributes(AS.iou_assign(t.det, t.gt, 0.2, 0.5), t.gt)
    return out.select("det_id", "gt_id", "target", "grade", "supervised", r6("iou"))


# ---- lookups

_INST = "SELECT case_id, gt_id AS instance_id, (gt_id {div} 5) % 5 AS class FROM gt"
_AUDIT = "SELECT case_id, 2 + case_id % 4 AS grade, case_id % 3 <> 0 AS supervised FROM cases WHERE case_id % 2 = 0"
_PRIOR = "SELECT case_id, gt_id AS instance_id, 2 + gt_id % 4 AS grade, CASE WHEN gt_id % 15 = 0 THEN 'other' ELSE 'human_expert_mask' END AS source FROM gt"


def _sub(t, text):
    return t.spark.sql(text.format(div="DIV").replace("FROM gt", "FROM {gt}").replace("FROM cases", "FROM {cases}"), gt=t.gt, cases=t.cases)


@query("j11_label_join", f"""inst AS ({_INST.format(div='//')}), aud AS ({_AUDIT}), pri AS ({_PRIOR}),
   o AS (SELECT i.*, CASE WHEN class BETWEEN 1 AND 4 THEN class+1 WHEN a.supervised THEN a.grade WHEN a.case_id IS NULL AND p.source='human_expert_mask' THEN p.grade END AS grade,
     CASE WHEN class BETWEEN 1 AND 4 THEN 'human_expert_mask' WHEN a.supervised THEN 'audit_unifocal' WHEN a.case_id IS NULL AND p.source='human_expert_mask' THEN p.source END AS source
     FROM inst i LEFT JOIN aud a USING (case_id) LEFT JOIN pri p USING (case_id, instance_id))
   SELECT *, grade IS NOT NULL AS supervised FROM o""")
def _(t):
    return L.grade_labels(_sub(t, _INST), _sub(t, _AUDIT), _sub(t, _PRIOR))


@query("j12_source_fallback", """SELECT case_id, CASE WHEN case_id%3=0 THEN 'expert/'||case_id WHEN case_id%5<>0 THEN 'auto/'||case_id END AS path,
   CAST(CASE WHEN case_id%3=0 THEN 0 WHEN case_id%5<>0 THEN 1 END AS BIGINT) AS source_rank FROM cases""")
def _(t):
    path = lambda kind: F.concat(F.lit(kind + "/"), F.col("case_id")).alias("path")
    a = t.cases.filter("case_id % 3 = 0").select("case_id", path("expert"))
    b = t.cases.filter("case_id % 5 <> 0").select("case_id", path("auto"))
    return L.source_fallback(t.cases, [a, b], ["case_id"])


@query("j13_finding_join", "SELECT doc_id, quality, toxic, lang, n_chars FROM labels JOIN documents USING (doc_id)", views="")
def _(t):
    return L.finding_join(t("labels"), t("documents").select("doc_id", "lang", "n_chars"), ["doc_id"])


@query("j14_cohort_semi_join", """SELECT gt_id, grade, patient_id, CASE WHEN patient_id IN (SELECT patient_id FROM cases WHERE patient_id%5<>0) THEN 'kept' ELSE 'dropped' END AS outcome FROM gt WHERE supervised""")
def _(t):
    kept, dropped = L.cohort_donors(t.gt.filter("supervised").select("gt_id", "grade", "patient_id"), t.cases.filter("patient_id % 5 <> 0"))
    return kept.withColumn("outcome", F.lit("kept")).unionByName(dropped.withColumn("outcome", F.lit("dropped"))).select("gt_id", "grade", "patient_id", "outcome")


def fold_table(t):
    """Five patient-based folds as rows (fold, role, case_id)."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")
    rows = t.cases.select("case_id", "patient_id", fold).withColumn("fold", big("fold"))
    return rows.select("fold", F.when(F.col("patient_id") % 5 == F.col("fold"), "val").otherwise("train").alias("role"), "case_id", "patient_id")


FOLDS_SQL = "spl AS (SELECT f.fold, CASE WHEN patient_id%5=f.fold THEN 'val' ELSE 'train' END AS role, case_id, patient_id FROM cases, (SELECT unnest(range(0,5)) AS fold) f)"


@query("j15_exclude_join", FOLDS_SQL + " SELECT fold, role, case_id FROM spl WHERE case_id NOT IN (SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM gt))")
def _(t):
    negative = L.unfinished(t.cases, t.gt)
    return L.exclude_cases(fold_table(t), negative).select("fold", "role", "case_id")


# ---- curves

_FLAGS = "fl AS (SELECT label, case_id, det_id, score, CASE WHEN model=0 THEN 1 ELSE 0 END AS tp1, CASE WHEN model<>0 THEN 1 ELSE 0 END AS fp1 FROM det)"


def _flags(t):
    return t.det.select("label", "case_id", "det_id", "score", (F.col("model") == 0).cast("long").alias("tp1"), (F.col("model") != 0).cast("long").alias("fp1"))


@query("w1_cumulative_by_score", _FLAGS + " SELECT det_id, CAST(sum(tp1) OVER w AS BIGINT) AS tp, CAST(sum(fp1) OVER w AS BIGINT) AS fp FROM fl WINDOW w AS (PARTITION BY label ORDER BY score DESC, case_id, det_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    order = [F.desc("score"), F.asc("case_id"), F.asc("det_id")]
    return W.running_totals(_flags(t), ["label"], order, {"tp": "tp1", "fp": "fp1"}, large=W.exceeds(t.det)).select("det_id", "tp", "fp")


@query("w1_cumulative_two_level", _FLAGS + " SELECT det_id, CAST(sum(tp1) OVER w AS BIGINT) AS tp, CAST(sum(fp1) OVER w AS BIGINT) AS fp FROM fl WINDOW w AS (PARTITION BY label ORDER BY score DESC, case_id, det_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    order = [F.desc("score"), F.asc("case_id"), F.asc("det_id")]
    return W.running_totals(_flags(t), ["label"], order, {"tp": "tp1", "fp": "fp1"}, large=True).select("det_id", "tp", "fp")


_CURVE = _FLAGS + """, tie AS (SELECT label, score, sum(tp1) AS a, sum(fp1) AS b FROM fl GROUP BY ALL),
  cv AS (SELECT label, score, CAST(sum(a) OVER w AS BIGINT) AS tp, CAST(sum(b) OVER w AS BIGINT) AS fp FROM tie WINDOW w AS (PARTITION BY label ORDER BY score DESC)
         UNION ALL SELECT DISTINCT label, NULL, 0, 0 FROM tie)"""


def _curve(t):
    flags = _flags(t).select("label", "score", F.col("tp1").alias("tp"), F.col("fp1").alias("fp"))
    return W.tie_grouped_curve(flags, ["label"], ["tp", "fp"], large=W.exceeds(t.det))


@query("w2_tie_grouped_curve", _CURVE + f" SELECT label, {R('score')} AS score, tp, fp FROM cv")
def _(t):
    return _curve(t).select("label", r6("score"), "tp", "fp")


_TG = "tg(target) AS (VALUES (0.25::DOUBLE),(1.0::DOUBLE),(7.5::DOUBLE),(1000000.0::DOUBLE))"
_NC = "(SELECT count(*)::DOUBLE FROM cases)"


@query("w3_value_at_budget", _CURVE + f", {_TG} SELECT label, target, {R(f'max(tp::DOUBLE) FILTER (WHERE fp/{_NC} <= target)')} AS value FROM cv, tg GROUP BY label, target")
def _(t):
    n = t.cases.count()
    return W.value_at_budget(_curve(t), ["label"], F.col("fp") / n, F.col("tp").cast("double"), [0.25, 1.0, 7.5, 1e6]).select("label", "target", r6("value"))


@query("w4_interp_at", _CURVE + f""", {_TG}, rd AS (SELECT label, target,
   arg_max((fp/{_NC}, tp::DOUBLE), coalesce(-score,-1e300)) FILTER (WHERE fp/{_NC} <= target) AS lo, arg_min((fp/{_NC}, tp::DOUBLE), coalesce(-score,-1e300)) FILTER (WHERE fp/{_NC} > target) AS hi FROM cv, tg GROUP BY label, target)
   SELECT label, target, {R('CASE WHEN hi IS NULL THEN lo[2] ELSE lo[2]+(hi[2]-lo[2])/(hi[1]-lo[1])*(target-lo[1]) END')} AS value FROM rd""")
def _(t):
    n = t.cases.count()
    return W.interp_at(_curve(t), ["label"], F.col("fp") / n, F.col("tp").cast("double"), [0.25, 1.0, 7.5, 1e6]).select("label", "target", r6("value"))


@query("w5_interp_first_crossing", _sweep_sql(_TYPES) + "," + crossing_sql("cur", "fps", "sens", [0.5]) + f" SELECT type, {R('v')} AS sensitivity FROM cr")
def _(t):
    curve = DM.threshold_froc(t.det, t.gt, _types())
    return W.interp_first_crossing(curve, ["type"], "fp_per_patient", "sensitivity", 0.5, "sensitivity").select("type", r6("sensitivity"))


@query("w6_partial_auc", _sweep_sql(_TYPES) + f""", st AS (SELECT type, (fps-lag(fps) OVER w)*(sens+lag(sens) OVER w)/2.0 AS a FROM cur WHERE fps BETWEEN 0.1 AND 3.0 WINDOW w AS (PARTITION BY type ORDER BY fps, sens))
   SELECT c.type, {R('coalesce((SELECT sum(a) FROM st WHERE st.type=c.type),0.0)')} AS pauc FROM (SELECT DISTINCT type FROM cur) c""")
def _(t):
    return W.partial_auc(DM.threshold_froc(t.det, t.gt, _types()), ["type"], "fp_per_patient", "sensitivity", 0.1, 3.0).select("type", r6("pauc"))


@query("w7_topk_per_group", "SELECT case_id, det_id, r AS rank FROM (SELECT case_id, det_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, det_id) AS INTEGER) AS r FROM det) WHERE r<=3")
def _(t):
    return W.top_k(t.det, ["case_id"], [F.desc("score"), F.asc("det_id")], 3).select("case_id", "det_id", "rank")


@query("w9_patience", """b AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, o_totalprice > coalesce(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS better FROM orders),
   i AS (SELECT *, sum(better::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS isl, max(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM b),
   d AS (SELECT *, CAST(sum((NOT better)::INT) OVER (PARTITION BY o_custkey, isl ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS idle FROM i)
   SELECT o_custkey, o_orderkey, best, idle AS idle_steps, idle >= 3 AS fired FROM d""", views="")
def _(t):
    runs = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return W.patience(runs, ["o_custkey"], "o_orderkey", "o_totalprice", 3).select("o_custkey", "o_orderkey", "best", "idle_steps", "fired")


@query("w10_delta_vs_baseline", f"""SELECT o_orderkey, {R("o_totalprice-(SELECT arg_min(o_totalprice,o_orderkey) FROM orders WHERE o_orderpriority='1-URGENT')")} AS delta_price, CAST(NULL AS DOUBLE) AS delta_status FROM orders""", views="")
def _(t):
    runs = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("config"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return W.delta_vs_baseline(runs, ["price", "status"], "config", "o_orderkey", "1-URGENT").select("o_orderkey", r6("delta_price"), "delta_status")


# ---- grades

_GP = match_sql("m", thr="0.1") + """, gp AS (SELECT m.det_id, g.grade AS tr, d.p2, d.p3, d.p4, d.p5,
    CASE WHEN p2>=p3 AND p2>=p4 AND p2>=p5 THEN 2 WHEN p3>=p4 AND p3>=p5 THEN 3 WHEN p4>=p5 THEN 4 ELSE 5 END AS pr
    FROM m JOIN gt g USING (gt_id) JOIN det d ON d.det_id=m.det_id WHERE g.supervised),
   cf AS (SELECT a.g AS tr, b.g AS pr, (SELECT count(*) FROM gp WHERE gp.tr=a.g AND gp.pr=b.g) AS n FROM (SELECT unnest(range(2,6)) AS g) a, (SELECT unnest(range(2,6)) AS g) b)"""


def graded(t):
    return GM.graded_pairs(GM.match_rows(t.det, t.gt, 0.1))


@query("a6_grade_confusion", _GP + " SELECT tr AS \"true\", pr AS predicted, n FROM cf")
def _(t):
    return GM.confusion(graded(t))


_PRF = ", pg AS (SELECT g, (SELECT sum(n) FROM cf WHERE tr=g AND pr=g)::DOUBLE AS tp, (SELECT sum(n) FROM cf WHERE tr=g)::DOUBLE AS sup, (SELECT sum(n) FROM cf WHERE pr=g)::DOUBLE AS cal FROM (SELECT unnest(range(2,6)) AS g)), pf AS (SELECT *, CASE WHEN cal>0 THEN tp/cal ELSE 0 END AS p, CASE WHEN sup>0 THEN tp/sup ELSE 0 END AS r FROM pg), f AS (SELECT *, CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END AS f1 FROM pf)"


@query("a6_grade_summary", _GP + _PRF + f""" SELECT CAST(sum(sup) AS BIGINT) AS total, {R('sum(tp)/sum(sup)')} AS accuracy, {R('sum(f1*sup)/sum(sup)')} AS weighted_f1,
   {R('avg(f1) FILTER (WHERE sup>0)')} AS macro_f1, {R('avg(r) FILTER (WHERE sup>0)')} AS balanced_accuracy,
   {R('(SELECT sum(n*abs(tr-pr))*1.0/sum(n) FROM cf)')} AS mae, {R('(SELECT sum(CASE WHEN abs(tr-pr)<=1 THEN n ELSE 0 END)*1.0/sum(n) FROM cf)')} AS adjacent_accuracy,
   {R('max(CASE WHEN g=3 THEN p END)')} AS precision3, {R('max(CASE WHEN g=4 THEN f1 END)')} AS f1_4 FROM f""")
def _(t):
    names = ("accuracy", "weighted_f1", "macro_f1", "balanced_accuracy", "mae", "adjacent_accuracy", "precision3", "f1_4")
    return GM.grade_summary(GM.confusion(graded(t))).select("total", *[r6(n) for n in names])


@query("a7_quadratic_kappa", _GP + f", mg AS (SELECT a.tr, b.pr, a.n*b.n/(SELECT sum(n) FROM cf)::DOUBLE AS e FROM (SELECT tr, sum(n) AS n FROM cf GROUP BY tr) a, (SELECT pr, sum(n) AS n FROM cf GROUP BY pr) b) SELECT {R('1.0-(SELECT sum(n*(tr-pr)*(tr-pr)) FROM cf)/(SELECT sum(e*(tr-pr)*(tr-pr)) FROM mg)')} AS quadratic_kappa")
def _(t):
    return GM.grade_summary(GM.confusion(graded(t))).select(r6("quadratic_kappa"))


_AUC = ", lg AS (" + " UNION ALL ".join(f"SELECT {g} AS grade, tr={g} AS pos, p{g} AS p FROM gp" for g in (2, 3, 4, 5)) + """),
   au AS (SELECT grade, (sum(CASE WHEN pos THEN rk END)-count(*) FILTER (WHERE pos)*(count(*) FILTER (WHERE pos)+1)/2.0)/(count(*) FILTER (WHERE pos)*count(*) FILTER (WHERE NOT pos)) AS auroc
          FROM (SELECT *, rank() OVER (PARTITION BY grade ORDER BY p) + (count(*) OVER (PARTITION BY grade, p)-1)/2.0 AS rk FROM lg) GROUP BY grade)"""


@query("a8_grade_auroc", _GP + _AUC + f" SELECT CAST(grade AS BIGINT) AS grade, {R('auroc')} AS auroc FROM au UNION ALL SELECT 0, {R('avg(auroc)')} FROM au")
def _(t):
    return GM.grade_auroc(graded(t), large=W.exceeds(t.det)).select("grade", r6("auroc"))


_OWN = "CASE tr WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4 ELSE p5 END"


@query("a9_calibration", _GP + f""", c AS (SELECT {_OWN} AS own, greatest(p2,p3,p4,p5) AS conf, tr=pr AS ok, p2*p2+p3*p3+p4*p4+p5*p5-2*({_OWN})+1 AS brier FROM gp),
   b AS (SELECT least(floor(conf*10),9) AS bin, sum(conf) AS sc, sum(ok::INT) AS so FROM c GROUP BY bin)
   SELECT count(*) AS n, {R('avg(brier)')} AS brier, {R('avg(-ln(greatest(own,1e-7)))')} AS nll, {R('(SELECT sum(abs(so-sc)) FROM b)/count(*)')} AS ece,
   {R('avg(conf)')} AS mean_confidence, {R('avg(conf) FILTER (WHERE ok)')} AS mean_confidence_correct, {R('avg(conf) FILTER (WHERE NOT ok)')} AS mean_confidence_incorrect FROM c""")
def _(t):
    c = GM.calibration(graded(t))
    return c.select("n", *[r6(x) for x in c.columns if x != "n"])


_CS = "cs AS (SELECT case_id, coalesce((SELECT max(score) FROM det d WHERE d.case_id=c.case_id AND label=1),0.0) AS score, EXISTS(SELECT 1 FROM gt g WHERE g.case_id=c.case_id AND label=1 AND grade=5) AS positive FROM cases c)"


@query("a10_case_metrics", _CS + f""", k AS (SELECT count(*) FILTER (WHERE score>0.3 AND positive) AS tp, count(*) FILTER (WHERE score>0.3 AND NOT positive) AS fp, count(*) FILTER (WHERE score<=0.3 AND positive) AS fn, count(*) FILTER (WHERE score<=0.3 AND NOT positive) AS tn FROM cs),
   au AS (SELECT sum(CASE WHEN a.score>b.score THEN 1.0 WHEN a.score=b.score THEN 0.5 ELSE 0 END)/count(*) AS auc FROM cs a, cs b WHERE a.positive AND NOT b.positive),
   pt AS (SELECT score, sum(positive::INT) AS p, count(*) AS n FROM cs GROUP BY score), rn AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM pt)
   SELECT {R('auc')} AS auc, {R('(SELECT sum(p*tp*1.0/seen)/sum(p) FROM rn)')} AS ap, tp, fp, fn, tn, {R('CASE WHEN tp+fp>0 THEN tp*1.0/(tp+fp) ELSE 0 END')} AS precision, {R('tp*1.0/(tp+fn)')} AS recall,
   {R('2.0*tp/(2*tp+fp+fn)')} AS f1, {R('(tp+tn)*1.0/(tp+fp+fn+tn)')} AS accuracy FROM k, au""")
def _(t):
    scored = CM.case_scores(t.det, t.gt.filter("grade = 5"), t.cases, 1)
    m = CM.case_metrics(scored, 0.3, large=W.exceeds(t.cases))
    ints = ("tp", "fp", "fn", "tn")
    return m.select(*[F.col(c) if c in ints else r6(c) for c in m.columns])


# ---- segmentation overlap: one instance per voxel (the later one), prediction shifted by one voxel

SEG_SQL = "seg AS (SELECT case_id, z, y, x, max(gt_id) AS gt_id, arg_max(label, gt_id)+1 AS class FROM voxels GROUP BY ALL), prd AS (SELECT case_id, z, y, x+1 AS x, CASE WHEN (x+y)%9=0 THEN 3-class ELSE class END AS class FROM seg)"


def segmentation(t):
    return t.voxels.groupBy("case_id", "z", "y", "x").agg(F.max("gt_id").alias("gt_id"), (F.max_by("label", "gt_id") + 1).alias("class"))


def predicted(t):
    other = F.when((F.col("x") + F.col("y")) % 9 == 0, 3 - F.col("class")).otherwise(F.col("class"))
    return segmentation(t).select("case_id", "z", "y", other.alias("class"), (F.col("x") + 1).alias("x"))


_CNT = """, jn AS (SELECT coalesce(s.case_id,p.case_id) AS case_id, s.class AS t, p.class AS q FROM seg s FULL JOIN prd p ON s.case_id=p.case_id AND s.z=p.z AND s.y=p.y AND s.x=p.x),
   ct AS (SELECT case_id, k.class, count(*) FILTER (WHERE t=k.class AND q=k.class) AS tp, count(*) FILTER (WHERE q=k.class AND t IS DISTINCT FROM k.class) AS fp, count(*) FILTER (WHERE t=k.class AND q IS DISTINCT FROM k.class) AS fn
          FROM jn, (SELECT unnest([1,2])::BIGINT AS class) k GROUP BY case_id, k.class)"""


@query("a11_seg_dice_global", SEG_SQL + _CNT + f" SELECT class, {R('2.0*sum(tp)/(2*sum(tp)+sum(fp)+sum(fn))')} AS dice FROM ct GROUP BY class", views="gt det cases voxels")
def _(t):
    return CM.dice_global(predicted(t), segmentation(t)).select("class", r6("dice"))


@query("a12_seg_dice_per_case", SEG_SQL + _CNT + f" SELECT class, {R('avg(2.0*tp/(2*tp+fp+fn)) FILTER (WHERE tp+fn>0)')} AS dice FROM ct GROUP BY class", views="gt det cases voxels")
def _(t):
    return CM.dice_per_case(predicted(t), segmentation(t), t.cases, [1, 2], skip_nan=True).select("class", r6("dice"))


@query("a12_seg_dice_per_case_nan", SEG_SQL + _CNT + f""", one AS (SELECT case_id FROM ct WHERE class=1 AND tp+fn>0), nc AS (SELECT count(*) AS n FROM one)
   SELECT class, CASE WHEN count(*) FILTER (WHERE tp+fn>0) < any_value(n) THEN 'nan'::DOUBLE ELSE {R('avg(2.0*tp/(2*tp+fp+fn))')} END AS dice
   FROM ct JOIN one USING (case_id), nc GROUP BY class""", views="gt det cases voxels")
def _(t):
    with_one = t.cases.join(segmentation(t).filter("class = 1").select("case_id").distinct(), "case_id", "left_semi")
    return CM.dice_per_case(predicted(t), segmentation(t), with_one, [1, 2]).select("class", r6("dice"))


_LD = match_sql("m", thr="0.1") + "," + SEG_SQL + f""", ld AS (SELECT g.case_id, g.gt_id,
    (SELECT count(*) FROM seg s WHERE s.gt_id=g.gt_id) AS ng FROM gt g WHERE gt_id IN (SELECT gt_id FROM m WHERE gt_id IS NOT NULL)),
   pc AS (SELECT g.gt_id, count(*) AS np, count(*) FILTER (WHERE s.gt_id=g.gt_id) AS nb FROM ld g JOIN gt b USING (gt_id) JOIN prd p ON p.case_id=g.case_id AND p.x>=b.x1 AND p.x<b.x2 AND p.y>=b.y1 AND p.y<b.y2 AND p.z>=b.z1 AND p.z<b.z2
     LEFT JOIN seg s ON s.case_id=p.case_id AND s.x=p.x AND s.y=p.y AND s.z=p.z GROUP BY g.gt_id),
   dc AS (SELECT case_id, gt_id, CASE WHEN ng+coalesce(np,0)>0 THEN 2.0*coalesce(nb,0)/(ng+coalesce(np,0)) ELSE 1.0 END AS dice FROM ld LEFT JOIN pc USING (gt_id))"""


@query("a13_lesion_dice", _LD + f" SELECT case_id, gt_id, {R('dice')} AS dice FROM dc", views="gt det cases voxels")
def _(t):
    return CM.lesion_dice(t.det, t.gt, segmentation(t), predicted(t)).select("case_id", "gt_id", r6("dice"))


@query("a13_lesion_dice_summary", _LD + f" SELECT count(gt_id) AS matched, (SELECT count(*) FROM gt)-count(gt_id) AS missed, count(*) FILTER (WHERE gt_id IS NULL) AS false_positives, {R('(SELECT avg(dice) FROM dc)')} AS mean_dice FROM m", views="gt det cases voxels")
def _(t):
    dice = CM.lesion_dice(t.det, t.gt, segmentation(t), predicted(t))
    out = CM.lesion_dice_summary(greedy_match(t.det, t.gt, 0.1), t.gt, dice)
    return out.select("matched", "missed", "false_positives", r6("mean_dice"))


# ---- dataset statistics


@query("a20_class_weights", f"c AS (SELECT grade, count(*) AS n FROM gt WHERE supervised GROUP BY grade) SELECT grade, n, {R('(1.0/n)/(SELECT avg(1.0/n) FROM c)')} AS weight FROM c")
def _(t):
    return DS.grade_class_weights(t.gt).select("grade", "n", r6("weight"))


@query("a21_class_weights_with_bg", f"SELECT 0 AS label, 0.25::DOUBLE AS weight UNION ALL SELECT k+1, {R('0.75*(1-(SELECT count(*) FROM gt WHERE label=k)*1.0/(SELECT count(*) FROM gt))')} FROM (SELECT unnest(range(0,3)) AS k)".replace("0 AS label", "0::BIGINT AS label"))
def _(t):
    return DS.class_weights_with_background(t.gt, 3).select("label", r6("weight"))


@query("a22_telemetry_totals", f"""SELECT label, count(*) AS positive, count(*) FILTER (WHERE supervised) AS supervised, count(*) FILTER (WHERE NOT supervised) AS unsupervised,
   count(*) FILTER (WHERE supervised AND grade=2) AS c2, count(*) FILTER (WHERE supervised AND grade=5) AS c5, {R('count(*) FILTER (WHERE supervised)*1.0/count(*)')} AS supervised_share FROM gt GROUP BY label""")
def _(t):
    c = lambda cond: F.count(F.when(cond, 1))
    s = F.col("supervised")
    rows = t.gt.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("positive"), c(s).alias("supervised"), c(~s).alias("unsupervised"),
                                                *[c(s & (F.col("grade") == g)).alias(f"c{g}") for g in (2, 3, 4, 5)])
    out = DS.telemetry_totals(rows, ["label"], ["c2", "c3", "c4", "c5"])
    return out.select("label", "positive", "supervised", "unsupervised", "c2", "c5", r6("supervised_share"))


@query("a23_weighted_mean", f"SELECT l_returnflag, {R('sum(l_discount*l_quantity)/sum(l_quantity)')} AS discount FROM lineitem GROUP BY l_returnflag", views="")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(r6(DS.weighted_mean("l_discount", "l_quantity"), "discount"))


@query("a24_dataset_properties", "SELECT case_id, label, count(*) AS n FROM gt GROUP BY CUBE (case_id, label)")
def _(t):
    return DS.instance_counts(t.gt)


@query("a24_instances_per_case", "SELECT instances, count(*) AS cases FROM (SELECT c.case_id, count(g.gt_id) AS instances FROM cases c LEFT JOIN gt g USING (case_id) GROUP BY c.case_id) GROUP BY instances")
def _(t):
    return DS.instances_per_case_histogram(t.gt, t.cases)


_SP, _SZ = ("sp_x", "sp_y", "sp_z"), ("shape_x", "shape_y", "shape_z")


@query("a25_spacing_plan", f"""q AS (SELECT quantile_cont(sp_x,0.5) AS a, quantile_cont(sp_y,0.5) AS b, quantile_cont(sp_z,0.5) AS c, quantile_cont(shape_x,0.5) AS n, quantile_cont(shape_y,0.5) AS m, quantile_cont(shape_z,0.5) AS o, quantile_cont(sp_z,0.1) AS lo FROM cases)
   SELECT {R('a')} AS target_0, {R('b')} AS target_1, {R('CASE WHEN c>1.5*least(a,b) AND o*1.5<least(n,m) THEN CASE WHEN lo<least(a,b) THEN least(a,b)+1e-5 ELSE lo END ELSE c END')} AS target_2 FROM q""")
def _(t):
    plan = DS.spacing_plan(t.cases, _SP, _SZ, ratio=1.5)
    return plan.select(*[r6(c) for c in plan.columns])


@query("a26_shape_stats", " UNION ALL ".join(f"SELECT {i}::BIGINT AS axis, {R(f'quantile_cont(shape_{a}*sp_{a}/{tg},0.5)')} AS median, {R(f'min(shape_{a}*sp_{a}/{tg})')} AS min, {R(f'max(shape_{a}*sp_{a}/{tg})')} AS max FROM cases" for i, (a, tg) in enumerate((("x", 0.5), ("y", 0.5), ("z", 3.0)))))
def _(t):
    return DS.shape_stats(t.cases, _SP, _SZ, [0.5, 0.5, 3.0]).select("axis", r6("median"), r6("min"), r6("max"))


@query("a27_large_object_trigger", f"SELECT {R('quantile_cont(x2-x1,0.995)')} AS size_0, {R('quantile_cont(y2-y1,0.995)')} AS size_1, {R('quantile_cont(z2-z1,0.995)')} AS size_2, (quantile_cont(x2-x1,0.995)>16 OR quantile_cont(y2-y1,0.995)>8.5 OR quantile_cont(z2-z1,0.995)>16) AS triggered FROM gt")
def _(t):
    return DS.large_object_trigger(t.gt, [16, 8.5, 16]).select(r6("size_0"), r6("size_1"), r6("size_2"), "triggered")


@query("a28_percentile_trim", """s AS (SELECT det_id, x1, y1, z1, x1+1+det_id%17 AS x2, y1+1+det_id%19 AS y2, z1+1+det_id%23 AS z2 FROM det),
   q AS (SELECT quantile_cont(x2-x1,[0.05,0.95]) AS a, quantile_cont(y2-y1,[0.05,0.95]) AS b, quantile_cont(z2-z1,[0.05,0.95]) AS c FROM s)
   SELECT det_id FROM s, q WHERE x2-x1>a[1] AND x2-x1<a[2] AND y2-y1>b[1] AND y2-y1<b[2] AND z2-z1>c[1] AND z2-z1<c[2]""")
def _(t):
    varied = t.det.selectExpr("det_id", "x1", "y1", "z1", "x1+1+det_id%17 AS x2", "y1+1+det_id%19 AS y2", "z1+1+det_id%23 AS z2")
    return DS.percentile_trim(varied, 0.05, 0.95).select("det_id")


@query("a29_norm_mask_rule", f"m AS (SELECT quantile_cont((shape_x-8)*(shape_y-8)/(shape_x*shape_y),0.5) AS r FROM cases) SELECT i AS modality, k AS kind, {R('r')} AS median_reduction, k<>'CT' AND r<0.75 AS use_mask FROM m, (VALUES (0::BIGINT,'MRI'),(1::BIGINT,'CT')) v(i,k)")
def _(t):
    x, y = F.col("shape_x"), F.col("shape_y")
    rule = DS.normalisation_rule(t.cases, (x - 8) * (y - 8), x * y, {0: "MRI", 1: "CT"})
    return rule.select("modality", "kind", r6("median_reduction"), "use_mask")


@query("a30_volume_ranking", "SELECT gt_id, count(*) AS voxels, min((z,y,x))[1] AS z, min((z,y,x))[2] AS y, min((z,y,x))[3] AS x FROM voxels GROUP BY gt_id", views="voxels")
def _(t):
    return DS.volume_ranking(t.voxels, ["gt_id"])
