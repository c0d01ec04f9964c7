"""Splits, sampling and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions.values import draw, draw_sql
from boxtally.operators import grade_metrics as GM
from boxtally.operators import sampling as SA
from boxtally.operators import splits as SP
from boxtally.operators import stats as ST
from boxtally.operators.voxels import containment, mask_to_boxes
from boxtally.plans.metric_queries import _GP, _OWN, graded
from boxtally.plans.registry import big, query, r6
from boxtally.plans.sqlparts import R
from boxtally.plans.voxel_queries import GLAND, SHAPE, gland, lesion

DC = draw_sql("case_id")
DP = draw_sql("patient_id")


@query("p1_kfold", f"SELECT case_id, CAST(floor((row_number() OVER (ORDER BY {DC}, case_id)-1)*5/(SELECT count(*) FROM cases)) AS BIGINT) AS fold FROM cases")
def _(t):
    return SP.kfold(t.cases, 5, draw(F.col("case_id")))


_GK = f"s AS (SELECT patient_id, count(*) AS size FROM gt GROUP BY patient_id), n AS (SELECT *, row_number() OVER (ORDER BY size DESC, {DP}, patient_id)-1 AS i FROM s)"


@query("p1_group_kfold", _GK + " SELECT patient_id, size, CASE WHEN (i//5)%2=0 THEN i%5 ELSE 4-i%5 END AS fold FROM n")
def _(t):
    return SP.group_kfold(t.gt, 5, draw(F.col("patient_id")))


@query("p2_leave_subset_out", """SELECT case_id, fold, CASE WHEN s=fold THEN 'test' WHEN s=(fold+1)%10 THEN 'val' ELSE 'train' END AS role FROM (SELECT case_id, case_id%10 AS s FROM cases), (SELECT unnest(range(0,10)) AS fold)""")
def _(t):
    rows = t.cases.select("case_id", (F.col("case_id") % 10).alias("subset"))
    return SP.leave_subset_out(rows, 10).select("case_id", "fold", "role")


@query("p2_leave_subset_out_val_only", """SELECT case_id, fold, CASE WHEN s=fold THEN 'val' ELSE 'train' END AS role FROM (SELECT case_id, case_id%10 AS s FROM cases), (SELECT unnest(range(0,10)) AS fold)""")
def _(t):
    rows = t.cases.select("case_id", (F.col("case_id") % 10).alias("subset"))
    return SP.leave_subset_out(rows, 10, separate_test=False).select("case_id", "fold", "role")


@query("p3_holdout", f"SELECT case_id, CASE WHEN row_number() OVER (ORDER BY {DC}, case_id) <= ceil((SELECT count(*) FROM cases)*0.3) THEN 'test' ELSE 'train' END AS role FROM cases")
def _(t):
    return SP.holdout(t.cases, 0.3, draw(F.col("case_id")))


_STRAT = f"""c AS (SELECT grade, count(*) AS c FROM gt WHERE supervised GROUP BY grade), r AS (SELECT patient_id, arg_min(grade, (c, grade)) AS stratum FROM gt JOIN c USING (grade) WHERE supervised GROUP BY patient_id),
   n AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY {DP}, patient_id)-0.5)/count(*) OVER (PARTITION BY stratum) AS pos FROM r)"""


@query("p4_stratified_group_split", _STRAT + " SELECT patient_id, stratum, CASE WHEN pos<=0.7 THEN 'train' WHEN pos<=0.85 THEN 'val' ELSE 'test' END AS role FROM n")
def _(t):
    return SP.stratified_group_split(t.gt, draw(F.col("patient_id")))


@query("p5_assign_roles", "SELECT gt_id, CASE WHEN patient_id%3=0 THEN 'test' ELSE 'train' END AS role FROM gt WHERE patient_id%11<>0 AND patient_id%13<>0")
def _(t):
    split = t.cases.filter("patient_id % 11 <> 0").select("patient_id", F.when(F.col("patient_id") % 3 == 0, "test").otherwise("train").alias("role")).distinct()
    twice = split.unionByName(split.filter("patient_id % 13 = 0").withColumn("role", F.lit("val")))
    rows, _bad = SP.assign_roles(t.gt, twice)
    return rows.select("gt_id", "role")


@query("p5_role_violations", "SELECT DISTINCT patient_id, CASE WHEN patient_id%11=0 THEN 'no_role' ELSE 'several_roles' END AS rule FROM gt WHERE patient_id%11=0 OR patient_id%13=0")
def _(t):
    split = t.cases.filter("patient_id % 11 <> 0").select("patient_id", F.when(F.col("patient_id") % 3 == 0, "test").otherwise("train").alias("role")).distinct()
    twice = split.unionByName(split.filter("patient_id % 13 = 0").withColumn("role", F.lit("val")))
    return SP.assign_roles(t.gt, twice)[1]


@query("p6_tiny_cohort", """k AS (SELECT c.case_id, c.patient_id, count(g.gt_id) AS n, coalesce(list(DISTINCT g.grade) FILTER (WHERE sup), []) AS gr FROM cases c LEFT JOIN (SELECT *, supervised AND case_id%5<>1 AS sup FROM gt) g USING (case_id) GROUP BY ALL),
   s2 AS (SELECT 'grade2' AS slot, case_id, patient_id FROM k WHERE list_contains(gr,2) ORDER BY len(gr)<>1, case_id LIMIT 1),
   s3 AS (SELECT 'grade3' AS slot, case_id, patient_id FROM k WHERE list_contains(gr,3) AND patient_id NOT IN (SELECT patient_id FROM s2) ORDER BY len(gr)<>1, case_id LIMIT 1),
   u3 AS (FROM s2 UNION ALL FROM s3),
   s4 AS (SELECT 'grade4' AS slot, case_id, patient_id FROM k WHERE list_contains(gr,4) AND patient_id NOT IN (SELECT patient_id FROM u3) ORDER BY len(gr)<>1, case_id LIMIT 1), u4 AS (FROM u3 UNION ALL FROM s4),
   s5 AS (SELECT 'grade5' AS slot, case_id, patient_id FROM k WHERE list_contains(gr,5) AND patient_id NOT IN (SELECT patient_id FROM u4) ORDER BY len(gr)<>1, case_id LIMIT 1), u5 AS (FROM u4 UNION ALL FROM s5),
   s6 AS (SELECT 'unsupervised' AS slot, case_id, patient_id FROM k WHERE len(gr)=0 AND n>0 AND patient_id NOT IN (SELECT patient_id FROM u5) ORDER BY case_id LIMIT 1), u6 AS (FROM u5 UNION ALL FROM s6),
   s7 AS (SELECT 'benign' AS slot, case_id, patient_id FROM k WHERE n=0 AND patient_id NOT IN (SELECT patient_id FROM u6) ORDER BY case_id LIMIT 1)
   FROM u6 UNION ALL FROM s7""")
def _(t):
    inst = t.gt.withColumn("supervised", F.col("supervised") & (F.col("case_id") % 5 != 1))
    return SP.tiny_cohort(t.cases, inst)


_PICK = draw_sql("batch", "slot")
_SLOTS = "sl AS (SELECT i//8 AS batch, i%8 AS slot FROM range(0, {n}) r(i))"


def _batches(t):
    return t.cases.count()


@query("p7_foreground_sampler", _SLOTS.format(n="(SELECT count(*) FROM cases)*8") + f""", ci AS (SELECT case_id, row_number() OVER (ORDER BY case_id)-1 AS idx FROM cases), gi AS (SELECT case_id, gt_id, row_number() OVER (ORDER BY case_id, gt_id)-1 AS idx FROM gt)
   SELECT batch, slot, case_id, -1::BIGINT AS instance_id FROM sl JOIN ci ON ci.idx={_PICK}%(SELECT count(*) FROM cases) WHERE slot<5
   UNION ALL SELECT batch, slot, case_id, gt_id FROM sl JOIN gi ON gi.idx={_PICK}%(SELECT count(*) FROM gt) WHERE slot>=5""")
def _(t):
    inst = t.gt.select("case_id", F.col("gt_id").alias("instance_id"))
    return SA.foreground_sampler(t.cases, inst, _batches(t), 8, 0.33)


@query("p7_foreground_sampler_balanced", _SLOTS.format(n="(SELECT count(*) FROM cases)*8") + f""", ci AS (SELECT case_id, row_number() OVER (ORDER BY case_id)-1 AS idx FROM cases), gi AS (SELECT case_id, gt_id, grade, row_number() OVER (PARTITION BY grade ORDER BY case_id, gt_id)-1 AS idx FROM gt WHERE supervised),
   gn AS (SELECT grade, count(*) AS n, row_number() OVER (ORDER BY grade)-1 AS g FROM gt WHERE supervised GROUP BY grade)
   SELECT batch, slot, case_id, -1::BIGINT AS instance_id FROM sl JOIN ci ON ci.idx={_PICK}%(SELECT count(*) FROM cases) WHERE slot<5
   UNION ALL SELECT batch, slot, case_id, gt_id FROM sl JOIN gn ON gn.g={draw_sql('slot', 'batch')}%(SELECT count(*) FROM gn) JOIN gi ON gi.grade=gn.grade AND gi.idx={_PICK}%gn.n WHERE slot>=5""")
def _(t):
    inst = t.gt.filter("supervised").select("case_id", F.col("gt_id").alias("instance_id"), "grade")
    return SA.foreground_sampler(t.cases, inst, _batches(t), 8, 0.33, strata="grade")


_HN = """rw AS (SELECT case_id, det_id, score, CASE WHEN det_id%4=1 THEN label+1 WHEN det_id%4=2 THEN -1 ELSE 0 END AS target FROM det),
   ct AS (SELECT case_id, count(*) FILTER (WHERE target>=1) AS p, count(*) FILTER (WHERE target=0) AS n FROM rw GROUP BY case_id),
   qt AS (SELECT case_id, {qp} AS qp, {qn} AS qn FROM ct),
   ps AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {o}, det_id) AS r FROM rw WHERE target>=1),
   pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, det_id) AS b FROM rw WHERE target=0) JOIN qt USING (case_id) WHERE b<=floor(qn*2.0)),
   ng AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {o}, det_id) AS r FROM pl)
   SELECT case_id, det_id, target FROM ps JOIN qt USING (case_id) WHERE r<=qp UNION ALL SELECT case_id, det_id, target FROM ng WHERE r<=qn"""
_HO = draw_sql("det_id")


def _hn(t, **kw):
    target = F.when(F.col("det_id") % 4 == 1, F.col("label") + 1).when(F.col("det_id") % 4 == 2, -1).otherwise(0).cast("long")
    rows = t.det.select("case_id", "det_id", "score", target.alias("target"))
    return SA.hard_negative_sample(rows, draw(F.col("det_id")), 12, 0.33, 2.0, **kw).select("case_id", "det_id", "target")


@query("p8_hard_negative_sample", _HN.format(qp="least(p,3)", qn="least(n, greatest(CAST(floor(greatest(least(p,3),1)*abs(1-1.0/0.33)) AS BIGINT),1))", o=_HO))
def _(t):
    return _hn(t, min_neg=1)


@query("p8_hard_negative_balanced", _HN.format(qp="least(p,3)", qn="least(n, greatest(least(p,3),1))", o=_HO))
def _(t):
    return _hn(t, mode="balanced")


@query("p8_hard_negative_all_positives", _HN.format(qp="p", qn="least(n, greatest(CAST(floor(1.5*p) AS BIGINT),1))", o=_HO))
def _(t):
    return _hn(t, mode="all_positives", ratio=1.5)


_DN = GLAND + """, ds AS (SELECT le.gt_id, avg(CASE WHEN g.x IS NULL THEN 0.0 ELSE 1.0 END) AS c FROM le LEFT JOIN gl g ON g.case_id=le.case_id AND g.z=le.z AND g.y=le.y AND g.x=le.x GROUP BY le.gt_id),
   dn AS (SELECT g.*, CASE WHEN ds.c<1 THEN (1-ds.c)*6 END AS mm FROM gt g JOIN ds USING (gt_id))"""


def _donors(t):
    c = containment(lesion(t), gland(t), ["case_id", "gt_id"])
    d = c.join(t.gt.select("gt_id", "grade", "supervised"), "gt_id")
    return d.select("case_id", F.col("gt_id").alias("instance_id"), "grade", "supervised",
                    F.when(F.col("containment") < 1, (1 - F.col("containment")) * 6).alias("p95_mm"))


@query("p9_donor_bank", _DN + """ SELECT gt_id AS instance_id, grade, greatest(x1-4,0) AS x1, greatest(z1-4,0) AS z1, least(x2+4,shape_x) AS x2, least(z2+4,shape_z) AS z2 FROM dn JOIN cases USING (case_id) WHERE supervised AND coalesce(mm<=2.0,true)""", views="gt det cases voxels")
def _(t):
    boxes = mask_to_boxes(t.voxels, ["case_id", "gt_id"]).withColumnRenamed("gt_id", "instance_id")
    bank, _counts = SA.donor_bank(_donors(t), boxes, t.cases, SHAPE)
    return bank.select("instance_id", "grade", "x1", "z1", "x2", "z2")


@query("p9_donor_counts", _DN + " SELECT CASE WHEN NOT supervised THEN 'unsupervised' WHEN coalesce(mm<=2.0,true) THEN 'kept' ELSE 'displaced' END AS outcome, count(*) AS n FROM dn GROUP BY 1", views="gt det cases voxels")
def _(t):
    boxes = mask_to_boxes(t.voxels, ["case_id", "gt_id"]).withColumnRenamed("gt_id", "instance_id")
    return SA.donor_bank(_donors(t), boxes, t.cases, SHAPE)[1]


_DRAW = f"""dd AS (SELECT gt_id AS donor_id, grade, CASE WHEN (gt_id//5)%3=0 THEN 'pz' WHEN (gt_id//5)%3=1 THEN 'tz' END AS zone FROM gt WHERE supervised),
   bz AS (SELECT *, row_number() OVER (PARTITION BY grade, zone ORDER BY donor_id)-1 AS idx, count(*) OVER (PARTITION BY grade, zone) AS n FROM dd WHERE zone IS NOT NULL),
   bg AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY donor_id)-1 AS idx, count(*) OVER (PARTITION BY grade) AS n FROM dd),
   rq AS (SELECT det_id AS request_id, 2+det_id%4 AS grade, CASE det_id%3 WHEN 0 THEN 'pz' WHEN 1 THEN 'tz' ELSE 'nowhere' END AS zone, {draw_sql('det_id')} AS d FROM det)"""


def _draw(t, mode):
    share = F.expr("CASE gt_id DIV 5 % 3 WHEN 0 THEN 0.9D WHEN 1 THEN 0.2D ELSE 0.5D END")
    donors = t.gt.filter("supervised").select(F.col("gt_id").alias("donor_id"), "grade", share.alias("zone_pz_frac"))
    zone = F.when(F.col("det_id") % 3 == 0, "pz").when(F.col("det_id") % 3 == 1, "tz").otherwise("nowhere")
    requests = t.det.select(F.col("det_id").alias("request_id"), (2 + F.col("det_id") % 4).alias("grade"), zone.alias("zone"))
    return SA.donor_draw(requests, donors, draw(F.col("request_id")), mode).select("request_id", "donor_id", "matched_zone")


@query("p10_donor_draw", _DRAW + """ SELECT r.request_id, coalesce(z.donor_id, g.donor_id) AS donor_id, z.donor_id IS NOT NULL AS matched_zone FROM rq r LEFT JOIN bz z ON z.grade=r.grade AND z.zone=r.zone AND z.idx=r.d%z.n LEFT JOIN bg g ON g.grade=r.grade AND g.idx=r.d%g.n""")
def _(t):
    return _draw(t, "prefer")


@query("p10_donor_draw_strict", _DRAW + " SELECT r.request_id, z.donor_id, CASE WHEN z.donor_id IS NOT NULL THEN true END AS matched_zone FROM rq r LEFT JOIN bz z ON z.grade=r.grade AND z.zone=r.zone AND z.idx=r.d%z.n")
def _(t):
    return _draw(t, "strict")


_TRY = f"""tr AS (SELECT d.case_id, d.det_id, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, (z1+z2)/2 AS cz, score, p2, EXISTS(SELECT 1 FROM gt g WHERE g.case_id=d.case_id AND (d.x1+d.x2)/2>=g.x1 AND (d.x1+d.x2)/2<g.x2 AND (d.y1+d.y2)/2>=g.y1 AND (d.y1+d.y2)/2<g.y2 AND (d.z1+d.z2)/2>=g.z1 AND (d.z1+d.z2)/2<g.z2) AS hit FROM det d),
   vl AS (SELECT * FROM tr WHERE cx-3>=0 AND cx-3+7<=40 AND cy-3>=0 AND cy-3+7<=40 AND cz-2>=0 AND cz-2+4<=20),
   rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {draw_sql('det_id')}, det_id) AS t FROM vl), tg AS (SELECT *, CASE WHEN p2<0.25 THEN 'occupancy' WHEN hit THEN 'collision' ELSE 'accepted' END AS outcome FROM rk WHERE t<=8),
   fs AS (SELECT case_id, min(t) AS f FROM tg WHERE outcome='accepted' GROUP BY case_id)"""


def _placements(t):
    mid = [((F.col(f"{a}1") + F.col(f"{a}2")) / 2).alias(f"c{a}") for a in "xyz"]
    c = t.det.select("case_id", "det_id", "p2", *mid, F.lit(7).alias("sx"), F.lit(7).alias("sy"), F.lit(4).alias("sz"))
    ok = SA.valid_centres(c, ["sx", "sy", "sz"], [40.0, 40.0, 20.0])
    g = t.gt.select("case_id", "x1", "y1", "z1", "x2", "y2", "z2")
    inside = [(F.col(f"c{a}") >= F.col(f"{a}1")) & (F.col(f"c{a}") < F.col(f"{a}2")) for a in "xyz"]
    hits = ok.join(g, "case_id").filter(inside[0] & inside[1] & inside[2]).select("det_id").distinct().withColumn("hit", F.lit(True))
    tries = ok.join(hits, "det_id", "left")
    return SA.first_accepted(tries, ["case_id"], F.col("p2") >= 0.25, F.coalesce("hit", F.lit(False)), draw(F.col("det_id")))


@query("p11_valid_placements", _TRY + " SELECT case_id, det_id, t AS \"try\" FROM tg JOIN fs USING (case_id) WHERE t=f")
def _(t):
    return _placements(t)[0].select("case_id", "det_id", "try")


@query("p11_attempt_counters", _TRY + " SELECT outcome, count(*) AS n FROM tg LEFT JOIN fs USING (case_id) WHERE f IS NULL OR t<=f GROUP BY outcome")
def _(t):
    return _placements(t)[1]


# ---- bootstrap over patients

B = 2000
_BOOT = f"""px AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id)-1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM cases)),
   dr AS (SELECT b, {draw_sql('b', 'idx')}%n AS idx FROM px, (SELECT unnest(range(0,{B})) AS b)), wt AS (SELECT b, p.patient_id, count(*) AS w FROM dr JOIN px p USING (idx) GROUP BY ALL UNION ALL SELECT -1, patient_id, 1 FROM px)"""
_GPP = _GP + ", gq AS (SELECT gp.*, d.patient_id FROM gp JOIN det d USING (det_id)), " + _BOOT
_AUCS = ", ".join([""] + [
    f"""{m} AS (SELECT b, avg(a) AS auroc FROM (SELECT b, g, CASE WHEN sp>0 AND sn>0 THEN wins/(sp*sn) END AS a FROM (SELECT b, g, sum(pw) AS sp, sum(nw) AS sn, sum(pw*(cum-nw/2.0)) AS wins FROM
       (SELECT b, g, p, pw, nw, sum(nw) OVER (PARTITION BY b, g ORDER BY p) AS cum FROM (SELECT b, g, p, sum(CASE WHEN tr=g THEN w ELSE 0 END) AS pw, sum(CASE WHEN tr<>g THEN w ELSE 0 END) AS nw FROM
         ({' UNION ALL '.join(f"SELECT patient_id, tr, {g} AS g, p{q} AS p FROM gq" for g, q in zip((2, 3, 4, 5), cols))}) JOIN wt USING (patient_id) GROUP BY b, g, p)) GROUP BY b, g)) GROUP BY b)"""
    for m, cols in (("au_a", (2, 3, 4, 5)), ("au_b", (3, 4, 5, 2)))
])


def _graded_patients(t):
    return GM.graded_pairs(GM.match_rows(t.det, t.gt, 0.1, det_cols=[*GM.PROBS, "patient_id"]))


def _aurocs(t):
    return ST.resampled_macro_auroc(_graded_patients(t), ST.bootstrap_hits(t.cases, B), B, {"a": ["p2", "p3", "p4", "p5"], "b": ["p3", "p4", "p5", "p2"]})


@query("p12_cluster_bootstrap", _GPP + f" SELECT b, tr AS \"true\", pr AS predicted, CAST(sum(w) AS BIGINT) AS n FROM gq JOIN wt USING (patient_id) WHERE b>=0 GROUP BY ALL")
def _(t):
    c = ST.resampled_confusion(_graded_patients(t), ST.bootstrap_hits(t.cases, B), B).filter(F.col("b") != ST.POINT)
    return c.select("b", "true", big("predicted").alias("predicted"), "n")


_ENDS = f"SELECT metric, {R('max(v) FILTER (WHERE b=-1)')} AS point, {R('quantile_cont(v,0.025) FILTER (WHERE b>=0)')} AS lower, {R('quantile_cont(v,0.975) FILTER (WHERE b>=0)')} AS upper, count(v) FILTER (WHERE b>=0) AS valid FROM lv GROUP BY metric"


def _ends(t, per, names):
    flat = per.select("b", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("e"))
    return ST.interval(flat.select("b", "e.*"), "v", ["metric"]).select("metric", r6("point"), r6("lower"), r6("upper"), "valid")


@query("p12_bootstrap_summary", _GPP + f""", cb AS (SELECT b, tr, pr, sum(w)::DOUBLE AS n FROM gq JOIN wt USING (patient_id) GROUP BY ALL), ta AS (SELECT b, tr, sum(n) AS n FROM cb GROUP BY ALL), tp AS (SELECT b, pr, sum(n) AS n FROM cb GROUP BY ALL),
   ob AS (SELECT b, sum(n) AS n, sum(CASE WHEN tr=pr THEN n ELSE 0 END) AS hits, sum(n*abs(tr-pr)) AS err, sum(n*(tr-pr)*(tr-pr)) AS sq FROM cb GROUP BY b), ex AS (SELECT b, sum(ta.n*tp.n*(tr-pr)*(tr-pr)) AS e FROM ta JOIN tp USING (b) GROUP BY b),
   lv AS (SELECT b, 'accuracy' AS metric, hits/n AS v FROM ob UNION ALL SELECT b, 'mae', err/n FROM ob UNION ALL SELECT b, 'quadratic_kappa', CASE WHEN e>0 THEN 1-sq/(e/n) END FROM ob JOIN ex USING (b)) {_ENDS}""")
def _(t):
    c = ST.resampled_confusion(_graded_patients(t), ST.bootstrap_hits(t.cases, B), B)
    return _ends(t, GM.grade_summary(c, ["b"]), ["accuracy", "mae", "quadratic_kappa"])


@query("p12_bootstrap_calibration", _GPP + f""", c AS (SELECT patient_id, {_OWN} AS own, greatest(p2,p3,p4,p5) AS conf, tr=pr AS ok, p2*p2+p3*p3+p4*p4+p5*p5-2*({_OWN})+1 AS brier FROM gq),
   bb AS (SELECT b, least(floor(conf*10),9) AS bin, sum(w) AS n, sum(w*brier) AS brier, sum(w*-ln(greatest(own,1e-7))) AS nll, sum(w*conf) AS sc, sum(w*ok::INT) AS so FROM c JOIN wt USING (patient_id) GROUP BY ALL),
   fb AS (SELECT b, sum(brier)/sum(n) AS brier, sum(nll)/sum(n) AS nll, sum(abs(so-sc))/sum(n) AS ece, sum(sc)/sum(n) AS conf FROM bb GROUP BY b),
   lv AS (SELECT b, 'brier' AS metric, brier AS v FROM fb UNION ALL SELECT b, 'nll', nll FROM fb UNION ALL SELECT b, 'ece', ece FROM fb UNION ALL SELECT b, 'mean_confidence', conf FROM fb) {_ENDS}""")
def _(t):
    c = ST.resampled_calibration(_graded_patients(t), ST.bootstrap_hits(t.cases, B), B)
    return _ends(t, c, ["brier", "nll", "ece", "mean_confidence"])


@query("p12_bootstrap_auroc", _GPP + _AUCS + f" SELECT b, {R('auroc')} AS auroc FROM au_a")
def _(t):
    return _aurocs(t).filter("model = 'a'").select("b", r6("auroc"))


@query("p13_paired_bootstrap_delta", _GPP + _AUCS + f", dl AS (SELECT b, au_a.auroc-au_b.auroc AS d FROM au_a JOIN au_b USING (b)) SELECT {R('max(d) FILTER (WHERE b=-1)')} AS point, {R('quantile_cont(d,0.025) FILTER (WHERE b>=0)')} AS lower, {R('quantile_cont(d,0.975) FILTER (WHERE b>=0)')} AS upper, count(d) FILTER (WHERE b>=0) AS valid, count(*) FILTER (WHERE b>=0 AND d IS NULL) AS undefined FROM dl")
def _(t):
    i = ST.interval(ST.paired_delta(_aurocs(t), "a", "b"), "delta")
    return i.select(r6("point"), r6("lower"), r6("upper"), "valid", "undefined")


@query("p14_verdict", _GPP + _AUCS + f""", al AS (SELECT 'a' AS model, * FROM au_a UNION ALL SELECT 'b', * FROM au_b), iv AS (SELECT model, quantile_cont(auroc,0.025) FILTER (WHERE b>=0) AS lo, max(auroc) FILTER (WHERE b=-1) AS m FROM al GROUP BY model)
   SELECT model, {R('m')} AS point, CASE WHEN lo<=0.5 THEN 'NULL' WHEN m>=0.7 THEN 'SIGNAL' ELSE 'INCONCLUSIVE' END AS verdict FROM iv""")
def _(t):
    i = ST.interval(_aurocs(t), "auroc", ["model"])
    return i.select("model", r6("point"), ST.verdict(F.col("point"), F.col("lower")).alias("verdict"))


_LOGP = ",".join(f"ln(greatest(1e-7,least(p{k},1.0)))" for k in (2, 3, 4, 5))


@query("p15_fit_temperature", _GP + f""", lp AS (SELECT tr, [{_LOGP}] AS l FROM gp), gr AS (SELECT i, 0.05*pow(400.0, i/800.0) AS t FROM range(0,801) r(i)),
   nl AS (SELECT i, any_value(t) AS t, avg(-((l[tr-1]-list_max(l))/t - ln(exp((l[1]-list_max(l))/t)+exp((l[2]-list_max(l))/t)+exp((l[3]-list_max(l))/t)+exp((l[4]-list_max(l))/t)))) AS nll FROM lp, gr GROUP BY i)
   SELECT {R('t')} AS temperature, {R('nl.nll')} AS nll FROM nl ORDER BY nl.nll, i LIMIT 1""")
def _(t):
    return ST.fit_temperature(graded(t), GM.PROBS).select(r6("temperature"), r6("nll"))


def features(t):
    n = F.col("vec_id")
    return t("embeddings").select(
        n.alias("row_id"), F.expr("vec_id DIV 8").alias("case_id"), F.expr("vec_id DIV 4").alias("instance_id"), (n % 3 / 10.0).alias("anchor_iou"),
        F.expr("2 + vec_id DIV 4 % 4").alias("grade"), F.transform("embedding", lambda v: v.cast("double")).alias("f"), F.expr("vec_id DIV 16").alias("patient_id"),
    )


@query("p16_best_anchor_readout", f"SELECT instance_id, row_id, grade, {R('f1')} AS f1 FROM (SELECT vec_id//4 AS instance_id, vec_id AS row_id, 2+(vec_id//4)%4 AS grade, embedding[1]::DOUBLE AS f1, row_number() OVER (PARTITION BY vec_id//4 ORDER BY vec_id%3 DESC, vec_id) AS r FROM embeddings) WHERE r=1", views="")
def _(t):
    return ST.best_anchor_readout(features(t)).select("instance_id", "row_id", "grade", r6(F.col("f")[0], "f1"))


@query("p16_pooled_readout", f"SELECT vec_id//4 AS instance_id, 2+(vec_id//4)%4 AS grade, {R('avg(embedding[1]::DOUBLE)')} AS f1, {R('avg(embedding[64]::DOUBLE)')} AS f64 FROM embeddings GROUP BY 1,2", views="")
def _(t):
    return ST.pooled_readout(features(t)).select("instance_id", "grade", r6(F.col("f")[0], "f1"), r6(F.col("f")[63], "f64"))


@query("p16_conflicting_labels", "SELECT vec_id//4 AS instance_id FROM embeddings GROUP BY 1 HAVING count(DISTINCT label%2)>1", views="")
def _(t):
    rows = t("embeddings").select(F.expr("vec_id DIV 4").alias("instance_id"), (F.col("label") % 2).alias("grade"))
    return ST.conflicting_labels(rows, ["instance_id"])


@query("p17_oof_probe", """SELECT (vec_id//2)%5 AS fold, count(*) AS n, count(*) AS sums_to_one, count(DISTINCT label%4) AS grades, true AS all_probabilities
   FROM embeddings GROUP BY 1""", views="")
def _(t):
    entries = [f"f{i}" for i in range(64)]
    rows = t("embeddings").select("vec_id", (2 + F.col("label") % 4).alias("grade"), (F.expr("vec_id DIV 2") % 5).alias("fold"),
                                  *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(entries)])
    out = ST.oof_probe(rows, entries, 5, max_iter=2000, reg=0.01)
    probs = [F.col(f"p{g}") for g in (2, 3, 4, 5)]
    whole = F.abs(sum(probs[1:], probs[0]) - 1) <= 1e-6
    inside = F.bool_and(F.least(*probs) >= 0) & F.bool_and(F.greatest(*probs) <= 1)
    return out.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(whole, 1)).alias("sums_to_one"), F.countDistinct("grade").alias("grades"), inside.alias("all_probabilities")
    )


@query("p18_subgroup_report", _GP + f""", sg AS (SELECT 'all' AS subgroup, * FROM gp UNION ALL SELECT 'even', * FROM gp WHERE det_id%2=0 UNION ALL SELECT 'third', * FROM gp WHERE det_id%3=0)
   SELECT subgroup, count(*) AS n, {R('avg((tr=pr)::INT)')} AS accuracy FROM sg GROUP BY subgroup""")
def _(t):
    rows = ST.subgroups(graded(t), {"all": F.lit(True), "even": F.col("det_id") % 2 == 0, "third": F.col("det_id") % 3 == 0})
    s = GM.grade_summary(GM.confusion(rows, ["subgroup"]), ["subgroup"])
    return s.select("subgroup", F.col("total").alias("n"), r6("accuracy"))


@query("p18_subgroup_auroc", _GP + ", sg AS (SELECT 'all' AS subgroup, * FROM gp UNION ALL SELECT 'even', * FROM gp WHERE det_id%2=0), lg AS (" +
       " UNION ALL ".join(f"SELECT subgroup, {g} AS grade, tr={g} AS pos, p{g} AS p FROM sg" for g in (2, 3, 4, 5)) +
       f""") SELECT subgroup, CAST(grade AS BIGINT) AS grade, {R("(sum(CASE WHEN pos THEN rk END)-count(*) FILTER (WHERE pos)*(count(*) FILTER (WHERE pos)+1)/2.0)/(count(*) FILTER (WHERE pos)*count(*) FILTER (WHERE NOT pos))")} AS auroc
       FROM (SELECT *, rank() OVER (PARTITION BY subgroup, grade ORDER BY p) + (count(*) OVER (PARTITION BY subgroup, grade, p)-1)/2.0 AS rk FROM lg) GROUP BY subgroup, grade""")
def _(t):
    rows = ST.subgroups(graded(t), {"all": F.lit(True), "even": F.col("det_id") % 2 == 0})
    return GM.grade_auroc(rows, ["subgroup"]).filter("grade > 0").select("subgroup", "grade", r6("auroc"))


_SUBS = """sg AS (SELECT 'all' AS subgroup, * FROM gq UNION ALL SELECT 'even', * FROM gq WHERE det_id%2=0 UNION ALL SELECT 'top', * FROM gq WHERE tr=5),
   sx AS (SELECT subgroup, patient_id, row_number() OVER (PARTITION BY subgroup ORDER BY patient_id)-1 AS idx, count(*) OVER (PARTITION BY subgroup) AS n FROM (SELECT DISTINCT subgroup, patient_id FROM sg)),
   sd AS (SELECT subgroup, b, """ + draw_sql("b", "idx") + f"""%n AS idx FROM sx, (SELECT unnest(range(0,{B})) AS b)),
   sw AS (SELECT subgroup, b, patient_id, count(*) AS w FROM sd JOIN sx USING (subgroup, idx) GROUP BY ALL UNION ALL SELECT subgroup, -1, patient_id, 1 FROM sx)""" + "".join(
    f""", {m} AS (SELECT subgroup, b, avg(a) AS auroc FROM (SELECT subgroup, b, g, CASE WHEN sum(pw)>0 AND sum(nw)>0 THEN sum(pw*(cum-nw/2.0))/(sum(pw)*sum(nw)) END AS a FROM
       (SELECT *, sum(nw) OVER (PARTITION BY subgroup, b, g ORDER BY p) AS cum FROM (SELECT subgroup, b, g, p, sum(CASE WHEN tr=g THEN w ELSE 0 END) AS pw, sum(CASE WHEN tr<>g THEN w ELSE 0 END) AS nw FROM
         ({' UNION ALL '.join(f"SELECT subgroup, patient_id, tr, {g} AS g, p{q} AS p FROM sg" for g, q in zip((2, 3, 4, 5), cols))}) JOIN sw USING (subgroup, patient_id) GROUP BY ALL)) GROUP BY subgroup, b, g) GROUP BY subgroup, b)"""
    for m, cols in (("sa", (2, 3, 4, 5)), ("sb", (3, 4, 5, 2)))) + f""", dl AS (SELECT subgroup, b, sa.auroc AS a, sb.auroc AS b2, sa.auroc-sb.auroc AS d FROM sa JOIN sb USING (subgroup, b)),
   iv AS (SELECT subgroup, max(a) FILTER (WHERE b=-1) AS a, max(b2) FILTER (WHERE b=-1) AS b2, max(d) FILTER (WHERE b=-1) AS point, quantile_cont(d,0.025) FILTER (WHERE b>=0) AS lo, quantile_cont(d,0.975) FILTER (WHERE b>=0) AS hi, count(d) FILTER (WHERE b>=0) AS valid, count(*) FILTER (WHERE b>=0 AND d IS NULL) AS undefined FROM dl GROUP BY subgroup),
   sz AS (SELECT subgroup, count(*) AS n, count(DISTINCT patient_id) AS patients FROM sg GROUP BY subgroup)
   SELECT m.subgroup, coalesce(n,0) AS n, coalesce(patients,0) AS patients, {R('a')} AS auroc_a, {R('b2')} AS auroc_b, {R('CASE WHEN valid>0 THEN point END')} AS point, {R('CASE WHEN point IS NOT NULL THEN lo END')} AS lower, {R('CASE WHEN point IS NOT NULL THEN hi END')} AS upper,
   coalesce(valid,0) AS valid, coalesce(undefined,0) AS undefined, CASE WHEN n IS NULL THEN 'empty' WHEN point IS NULL OR valid=0 THEN 'undefined' ELSE 'defined' END AS status
   FROM (VALUES ('all'),('even'),('top'),('none')) m(subgroup) LEFT JOIN sz USING (subgroup) LEFT JOIN iv USING (subgroup)"""


@query("p18_paired_delta", _GPP + ", " + _SUBS)
def _(t):
    members = {"all": F.lit(True), "even": F.col("det_id") % 2 == 0, "top": F.col("true") == 5, "none": F.col("true") > 5}
    d = ST.subgroup_delta(_graded_patients(t), members, ["p2", "p3", "p4", "p5"], ["p3", "p4", "p5", "p2"], B)
    return d.select("subgroup", "n", "patients", *[r6(c) for c in ("auroc_a", "auroc_b", "point", "lower", "upper")], "valid", "undefined", "status")


@query("p19_one_per_grade", "SELECT grade, case_id, gt_id FROM (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY case_id, gt_id) AS r FROM gt WHERE supervised) WHERE r=1")
def _(t):
    return SP.one_per_grade(t.gt, ["case_id", "gt_id"]).select("grade", "case_id", "gt_id")


@query("p4_missing_role_grades", _STRAT + """, sp AS (SELECT patient_id, CASE WHEN pos<=0.7 THEN 'train' WHEN pos<=0.85 THEN 'val' ELSE 'test' END AS role FROM n)
   SELECT role, grade FROM (SELECT DISTINCT role FROM sp), (SELECT unnest(range(2,7)) AS grade) g WHERE NOT EXISTS (SELECT 1 FROM sp s2 JOIN gt USING (patient_id) WHERE s2.role=sp.role AND gt.grade=g.grade AND supervised)""".replace("SELECT DISTINCT role FROM sp), ", "SELECT DISTINCT role FROM sp) sp, "))
def _(t):
    split = SP.stratified_group_split(t.gt, draw(F.col("patient_id")))
    return SP.missing_role_grades(split, t.gt, (2, 3, 4, 5, 6))


