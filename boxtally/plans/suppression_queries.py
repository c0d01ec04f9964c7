"""Suppression, clustering and ensembling."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions import geometry as G
from boxtally.operators import suppress as D
from boxtally.operators.curves import union_all
from boxtally.operators.matching import greedy_match
from boxtally.plans.registry import query, r6
from boxtally.plans.sqlparts import R, area, inter, iou, keep_sql, match_sql, overlap

KD = iou("k", "d")


def clash(t: float) -> str:
    return f"({overlap('k', 'd')} AND {KD} > {t})"


@query("d1_nms", keep_sql("kp", conflict=clash(0.1)) + " SELECT case_id, det_id FROM kp")
def _(t):
    return D.nms(t.det, 0.1).select("case_id", "det_id")


@query("d2_batched_nms", keep_sql("kp", keys="case_id, label", conflict=clash(0.1)) + " SELECT case_id, label, det_id FROM kp")
def _(t):
    return D.batched_nms(t.det, 0.1).select("case_id", "label", "det_id")


@query("d3_weighted_nms", "dw AS (SELECT *, score*(1.0+model) AS ord FROM det)," + keep_sql("kp", det="dw", keys="case_id, label", conflict=clash(0.1), order="ord DESC, det_id")
       + f" SELECT det_id, {R('score')} AS score, 1.0::DOUBLE AS weight FROM kp JOIN det USING (det_id)")
def _(t):
    weighted = t.det.withColumn("weight", 1.0 + F.col("model"))
    return D.weighted_nms(weighted, 0.1).select("det_id", r6("score"), "weight")


def wbc_sql(name: str, t: float, det: str = "det", keys: str = "case_id, label", weight: str = "1.0", expected: str = "3.0", mw: float = 1.0) -> str:
    on = " AND ".join(f"k.{c.strip()}=d.{c.strip()}" for c in keys.split(","))
    dk = ", ".join(f"d.{c.strip()}" for c in keys.split(","))
    boxes = ", ".join(f"sum({c}*w*score)/sum(w*score) AS {c}" for c in ("x1", "y1", "x2", "y2", "z1", "z2"))
    return keep_sql(f"{name}_k", det=det, keys=keys, conflict=clash(t)) + f""",
    {name}_seeds AS (SELECT d.* FROM {det} d JOIN {name}_k USING (det_id)),
    {name}_m AS (SELECT {dk}, d.* EXCLUDE({keys}), k.det_id AS seed, {KD} AS iou_seed,
          row_number() OVER (PARTITION BY {dk}, d.det_id ORDER BY k.score DESC, k.det_id) AS pick
          FROM {det} d JOIN {name}_seeds k ON {on} AND {overlap('k', 'd')} AND {KD} > {t}),
    {name}_w AS (SELECT *, iou_seed*({weight}) AS w, {expected} AS n_exp FROM {name}_m WHERE pick = 1),
    {name} AS (SELECT {keys}, seed AS det_id, count(*) AS members,
          sum(w*score)/(sum(w)+greatest(0.0, avg(n_exp)-count(*))*avg(w)*{mw}) AS score, {boxes} FROM {name}_w GROUP BY {keys}, seed)"""


_SIX = ", ".join(f"{R(c)} AS {c}" for c in G.BOX_COLUMNS)


def _six():
    return [r6(c) for c in G.BOX_COLUMNS]


def _weighted(t, expected=3.0):
    return t.det.withColumn("weight", 1.0 + F.col("model") * 0.5).withColumn("n_expected", F.lit(expected))


@query("d4_weighted_box_clustering", wbc_sql("wb", 0.1, weight="1.0+model*0.5") + f" SELECT det_id, label, members, {R('score')} AS score, {_SIX} FROM wb WHERE score > 0.01")
def _(t):
    return D.weighted_box_clustering(_weighted(t), 0.1, min_score=0.01).select("det_id", "label", "members", r6("score"), *_six())


@query("d5_wbc_topk", wbc_sql("wb", 0.1, weight="1.0+model*0.5") + f""",
   tk AS (SELECT *, w*score AS ws, avg(n_exp) OVER c AS e, count(*) OVER c AS n, row_number() OVER (PARTITION BY case_id, label, seed ORDER BY w*score DESC, det_id) AS r
          FROM wb_w WINDOW c AS (PARTITION BY case_id, label, seed))
   SELECT seed AS det_id, label, any_value(n) AS members, {R('avg(score)*(1-1.0*greatest(0.0,any_value(e)-any_value(n))/any_value(e))')} AS score, {R('sum(x1*ws)/sum(ws)')} AS x1, {R('sum(z2*ws)/sum(ws)')} AS z2
   FROM tk WHERE r <= floor(e) GROUP BY case_id, label, seed""")
def _(t):
    return D.top_member_clustering(_weighted(t), 0.1).select("det_id", "label", "members", r6("score"), r6("x1"), r6("z2"))


@query("d6_wbc_then_nms", wbc_sql("wb", 0.1, weight="1.0+model*0.5") + ", wpos AS (SELECT * FROM wb WHERE score > 0.0)," + keep_sql("kp", det="wpos", conflict=clash(0.3)) + " SELECT case_id, det_id FROM kp")
def _(t):
    return D.cluster_then_nms(_weighted(t), 0.1, 0.3).select("case_id", "det_id")


_CLIPPED = ", ".join(f"greatest(0.0,least(d.{c}{i},c.shape_{c})) AS {c}{i}" for i in (1, 2) for c in "xyz")
_POST = f"""tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, det_id) AS r0 FROM det) WHERE r0<=30 AND score > 0.02),
   cl AS (SELECT * FROM (SELECT d.case_id, d.det_id, d.label, d.score, {_CLIPPED} FROM tp d JOIN cases c USING (case_id)) WHERE x2-x1>=2 AND y2-y1>=2 AND z2-z1>=2),"""


@query("d7_postprocess_model", _POST + keep_sql("kp", det="cl", keys="case_id, label", conflict=clash(0.2)) + """
   SELECT det_id, label, r AS rank, x1, z2 FROM (SELECT cl.*, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, det_id) AS INTEGER) AS r FROM cl JOIN kp USING (case_id, label, det_id)) WHERE r<=10""")
def _(t):
    return D.postprocess(t.det, t.cases, 30, 0.02, 2.0, 0.2, 10).select("det_id", "label", "rank", "x1", "z2")


@query("d8_ensemble_case", "mp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, det_id) AS r FROM det) WHERE r<=35)," + wbc_sql("wb", 0.2, det="mp")
       + f" SELECT det_id, label, members, {R('score')} AS score, {_SIX} FROM wb WHERE score > 0.0")
def _(t):
    models = [t.det.filter(F.col("model") == m) for m in range(3)]
    return D.ensemble(models, 35, 0.2, n_expected=3).select("det_id", "label", "members", r6("score"), *_six())


_TILES = "tl(tile, x1, x2, y1, y2, z1, z2) AS (VALUES " + ", ".join(
    f"({i}, {x}.0::DOUBLE, {x + 24}.0::DOUBLE, {y}.0::DOUBLE, {y + 24}.0::DOUBLE, 0.0::DOUBLE, 16.0::DOUBLE)" for i, (x, y) in enumerate([(0, 0), (12, 0), (0, 12), (12, 12)])
) + ")"


def _tiles(t):
    spots = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x1"), F.lit(float(y)).alias("y1")) for x, y in [(0, 0), (12, 0), (0, 12), (12, 12)]])).alias("s")
    return t.cases.select("case_id", spots).select(
        "case_id", "s.x1", "s.y1", (F.col("s.x1") + 24).alias("x2"), (F.col("s.y1") + 24).alias("y2"), F.lit(0.0).alias("z1"), F.lit(16.0).alias("z2"))


@query("d8_ensemble_by_tiles", _TILES + f", de AS (SELECT d.*, coalesce((SELECT sum({inter('d', 't')}/{area('d')}) FROM tl t), 0.0) AS cover FROM det d)," + wbc_sql("wb", 0.2, det="de", expected="cover", mw=0.7310585)
       + f" SELECT det_id, members, {R('score')} AS score FROM wb WHERE score > 0.0")
def _(t):
    covered = D.expected_from_tiles(t.det, _tiles(t))
    return D.ensemble(covered, 10_000, 0.2, n_expected="n_expected", missing_weight=0.7310585).select("det_id", "members", r6("score"))


@query("d11_tile_overlap_mean", _TILES + f" SELECT d.det_id, {R('coalesce((SELECT sum(' + inter('d', 't') + '/' + area('d') + ') FROM tl t), 0.0)')} AS n_expected FROM det d")
def _(t):
    return D.expected_from_tiles(t.det, _tiles(t)).select("det_id", r6("n_expected"))


@query("d11_tile_overlap_median", _TILES + f", n AS (SELECT v.gt_id, v.z, v.y, v.x, count(t.tile) AS n FROM voxels v LEFT JOIN tl t ON v.x>=t.x1 AND v.x<t.x2 AND v.y>=t.y1 AND v.y<t.y2 AND v.z>=t.z1 AND v.z<t.z2 GROUP BY ALL) SELECT gt_id, {R('quantile_cont(n,0.5)')} AS n_expected FROM n GROUP BY gt_id", views="gt cases voxels")
def _(t):
    return D.tile_cover_median(t.voxels, _tiles(t), ["case_id", "gt_id"]).select("gt_id", r6("n_expected"))


_TOUCH = " AND ".join(f"least(a.{c}2,b.{c}2)-greatest(a.{c}1,b.{c}1) >= 0" for c in "xyz")


@query("d9_merge_touching", f"""vb AS (SELECT * FROM (SELECT d.case_id, d.det_id, d.score, {_CLIPPED} FROM det d JOIN cases c USING (case_id) WHERE score > 0) WHERE x2>x1 AND y2>y1 AND z2>z1),
   ed AS (SELECT a.case_id, a.det_id AS u, b.det_id AS v FROM vb a JOIN vb b ON a.case_id=b.case_id AND {_TOUCH}),
   reach AS (SELECT u AS root, v FROM ed UNION SELECT r.root, e.v FROM reach r JOIN ed e ON e.u=r.v),
   comp AS (SELECT v AS det_id, min(root) AS component FROM reach GROUP BY v)
   SELECT vb.case_id, component, {R('max(score)')} AS score, min(x1) AS x1, min(y1) AS y1, min(z1) AS z1, max(x2) AS x2, max(y2) AS y2, max(z2) AS z2 FROM vb JOIN comp USING (det_id) GROUP BY ALL""")
def _(t):
    return D.merge_touching(t.det, t.cases).select("case_id", "component", r6("score"), "x1", "y1", "z1", "x2", "y2", "z2")


_INNER = ", ".join(f"greatest(trunc(d.{c}1)+1,0.0) AS {c}1, least(trunc(d.{c}2),c.shape_{c}) AS {c}2" for c in "xyz")
_NEAR = "(" + " AND ".join(f"least(k.{c}2,d.{c}2+2) > greatest(k.{c}1,greatest(d.{c}1-2,0.0))" for c in "xyz") + ")"


@query("d10_greedy_non_overlap", f"inn AS (SELECT * FROM (SELECT d.case_id, d.label, d.det_id, d.score, {_INNER} FROM det d JOIN cases c USING (case_id)) WHERE greatest(x2-x1,0)*greatest(y2-y1,0)*greatest(z2-z1,0) > 10),"
       + keep_sql("kp", det="inn", keys="case_id, label", conflict=_NEAR) + " SELECT case_id, label, det_id FROM kp")
def _(t):
    return D.greedy_non_overlap(t.det, t.cases, min_voxels=10).select("case_id", "label", "det_id")


def _axis_sql(axis: str, p: int, o: int, mode: str) -> str:
    d = f"CAST(shape_{axis} AS BIGINT)"
    first = "0" if mode == "fixed" else f"CASE WHEN {d} <= {p} THEN CAST(floor(({d}-{p})/2.0) AS BIGINT) ELSE CAST(floor(({d}%{p - o}-{p})/2.0) AS BIGINT) END"
    shift = f"CASE WHEN v<0 THEN 0 WHEN v+{p} > {d} THEN {d}-{p} ELSE v END"
    return f"(SELECT case_id, {shift} AS {axis}1 FROM (SELECT case_id, shape_{axis}, unnest(range({first}, greatest({d}-{o}, {first}+1), {p - o})) AS v FROM cases))"


def _grid_sql(mode: str) -> str:
    x, y, z = (_axis_sql(a, p, o, mode) for a, p, o in (("x", 16, 4), ("y", 16, 8), ("z", 8, 2)))
    return f"SELECT case_id, x1, y1, z1, x1+16 AS x2, y1+16 AS y2, z1+8 AS z2, '{mode}' AS mode FROM {x} JOIN {y} USING (case_id) JOIN {z} USING (case_id)"


@query("d12_tile_grid", _grid_sql("fixed") + " UNION ALL " + _grid_sql("symmetric"))
def _(t):
    shape = ("shape_x", "shape_y", "shape_z")
    return union_all([D.tile_grid(t.cases, shape, (16, 16, 8), (4, 8, 2), m).withColumn("mode", F.lit(m)) for m in ("fixed", "symmetric")])


_COMBOS = [(t, s) for t in (0.05, 0.4) for s in (0.0, 0.1, 0.2)]
_SWEEP = ", ".join(
    f"dc{i} AS (SELECT * FROM det WHERE score > {s})," + keep_sql(f"kc{i}", det=f"dc{i}", conflict=clash(t))
    + f", dk{i} AS (SELECT det.* FROM det JOIN kc{i} USING (det_id))," + match_sql(f"mc{i}", det=f"dk{i}", thr="0.1")
    + f", sc{i} AS (SELECT {t}::DOUBLE AS max_iou, {s}::DOUBLE AS min_score, 2.0*count(gt_id)/(count(*)+(SELECT count(*) FROM gt)) AS f1 FROM mc{i})"
    for i, (t, s) in enumerate(_COMBOS)
) + ", al AS (" + " UNION ALL ".join(f"SELECT * FROM sc{i}" for i in range(len(_COMBOS))) + """),
   b1 AS (SELECT max_iou FROM al WHERE min_score=0.1 ORDER BY f1 DESC, max_iou LIMIT 1)
   SELECT 'max_iou' AS parameter, max_iou AS value, round(f1,6)+0.0 AS f1 FROM al WHERE min_score=0.1
   UNION ALL SELECT 'min_score', min_score, round(f1,6)+0.0 FROM al WHERE max_iou=(SELECT max_iou FROM b1)"""


@query("d13_sweep", _SWEEP)
def _(t):
    n_gt = t.gt.agg(F.count(F.lit(1)).alias("n_gt"))

    def f1(setting):
        kept = D.nms(t.det.filter(F.col("score") > setting["min_score"]), setting["max_iou"])
        hits = greedy_match(kept, t.gt, 0.1).agg(F.count("gt_id").alias("tp"), F.count(F.lit(1)).alias("n"))
        return hits.join(F.broadcast(n_gt)).select((2.0 * F.col("tp") / (F.col("n") + F.col("n_gt"))).alias("f1"))

    _, history = D.sweep({"max_iou": 0.4, "min_score": 0.1}, {"max_iou": [0.05, 0.4], "min_score": [0.0, 0.1, 0.2]}, f1, "f1")
    return t.spark.createDataFrame(history, "parameter string, value double, f1 double").select("parameter", "value", r6("f1"))


_PROB = "(1 + (x*3 + y*7 + z*5) % 17) / 19.0e0"


@query("d14_seg_score", f"SELECT gt_id, {R('max(p)')} AS score_max, {R('avg(p)')} AS score_mean, {R('quantile_cont(p,0.5)')} AS score_median, {R('quantile_cont(p,0.95)')} AS score_p95 FROM (SELECT *, {_PROB} AS p FROM voxels) GROUP BY gt_id", views="voxels")
def _(t):
    scored = D.segmentation_score(t.voxels.withColumn("prob", F.expr(_PROB)), ["gt_id"])
    return scored.select("gt_id", *[r6(c) for c in scored.columns if c != "gt_id"])


_TW = f"""SELECT case_id, z, y, x, label, {R('sum(p*tw*mw)/sum(tw)')} AS prob FROM
   (SELECT case_id, z, y, x, label, {_PROB} AS p, 1.0e0 + (x + gt_id) % 3 AS tw, 0.5e0 + gt_id % 2 AS mw FROM voxels) GROUP BY ALL"""


@query("d16_weighted_tile_mean", _TW, views="voxels")
def _(t):
    rows = t.voxels.selectExpr("case_id", "z", "y", "x", "label", f"{_PROB} AS prob", "1.0D + (x + gt_id) % 3 AS tile_weight", "0.5D + gt_id % 2 AS model_weight")
    keys = ["case_id", "z", "y", "x", "label"]
    return D.weighted_tile_mean(rows, keys).select(*keys, r6("prob"))


@query("j10_attach_grade_probs", "mp AS (SELECT * FROM det)," + wbc_sql("wb", 0.2) + f""",
   cand AS (SELECT f.case_id, f.det_id, d.det_id AS source, d.p2, d.p5, row_number() OVER (PARTITION BY f.case_id, f.det_id ORDER BY
       (CASE WHEN {overlap('f', 'd')} THEN {iou('f', 'd')} ELSE 0.0 END) + (CASE WHEN f.label=d.label THEN d.score*1e-6 ELSE 0.0 END) DESC, d.det_id) AS r
       FROM wb f JOIN det d ON f.case_id=d.case_id)
   SELECT case_id, det_id, source, {R('p2')} AS p2, {R('p5')} AS p5 FROM cand WHERE r=1""")
def _(t):
    final = D.weighted_box_clustering(t.det.withColumn("weight", F.lit(1.0)).withColumn("n_expected", F.lit(3.0)), 0.2, min_score=-1.0)
    out = D.attach_grade_probs(final, t.det, ["p2", "p3", "p4", "p5"])
    return out.select("case_id", "det_id", "source", r6("p2"), r6("p5"))


