"""Geometry expressions and simple projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions import geometry as G
from boxtally.functions import values as V
from boxtally.operators.pairs import box_pairs
from boxtally.operators.lookups import collapsed_classes, remap_classes
from boxtally.plans.registry import query, r6
from boxtally.plans.sqlparts import R, area, inter, iou, overlap
from boxtally.sources.readers import flatten_json


def A():
    return G.box("a_")


def B():
    return G.box("b_")


def SHAPE():
    return [F.col("shape_x"), F.col("shape_y"), F.col("shape_z")]


def SPACING():
    return [F.col("sp_x"), F.col("sp_y"), F.col("sp_z")]


def PROBS():
    return F.array("p2", "p3", "p4", "p5")




def _pairs(t):
    keep = ["case_id", *G.BOX_COLUMNS]
    return box_pairs(t.det.select("det_id", *keep), t.gt.select("gt_id", *keep))


def _with_case(t, df):
    return df.join(t.cases.drop("patient_id"), "case_id")


def _six(b, digits=True):
    return [r6(c, n) for c, n in zip((*b.lo, *b.hi), (*G.LOW, *G.HIGH))]


def _pair_sql(**cols):
    body = ", ".join(f"{R(e)} AS {n}" for n, e in cols.items())
    return f"SELECT d.det_id, g.gt_id, {body} FROM det d JOIN gt g ON d.case_id=g.case_id AND {overlap('d', 'g')}"


def _det_sql(where="", **cols):
    body = ", ".join(f"{R(e)} AS {n}" for n, e in cols.items())
    return f"SELECT d.det_id, {body} FROM det d JOIN cases c USING (case_id) {where}"


@query("g1_box_area", f"SELECT det_id, {R(area('det'))} AS volume, {R('(x2-x1)*(y2-y1)')} AS area FROM det")
def _(t):
    return t.det.select("det_id", r6(G.box_area(G.box()), "volume"), r6(G.box_area(G.box(dim=2)), "area"))


@query("g2_box_size_center", "SELECT det_id, x2-x1 AS sx, y2-y1 AS sy, z2-z1 AS sz, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy, (z1+z2)/2 AS cz FROM det")
def _(t):
    b = G.box()
    names = zip([*G.box_size(b), *G.box_center(b)], ["sx", "sy", "sz", "cx", "cy", "cz"])
    return t.det.select("det_id", *[c.alias(n) for c, n in names])


_I2 = "(greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0.0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0.0))"
_A2 = "((d.x2-d.x1)*(d.y2-d.y1)+(g.x2-g.x1)*(g.y2-g.y1))"


@query("g3_box_iou", _pair_sql(iou=iou("d", "g"), iou2d=f"{_I2}/({_A2}-{_I2})"))
def _(t):
    return _pairs(t).select(
        F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"),
        r6(G.box_iou(A(), B()), "iou"), r6(G.box_iou(G.box("a_", 2), G.box("b_", 2)), "iou2d"),
    )


_HULL = "(" + "*".join(f"(greatest(d.{c}2,g.{c}2)-least(d.{c}1,g.{c}1))" for c in "xyz") + ")"
_UNION = f"({area('d')}+{area('g')}-{inter('d', 'g')})"


@query("g4_box_giou", _pair_sql(giou=f"{iou('d', 'g')}-({_HULL}-{_UNION})/{_HULL}"))
def _(t):
    return _pairs(t).select(
        F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), r6(G.box_giou(A(), B()), "giou")
    )


_DC = [f"((d.{c}1+d.{c}2)/2-(g.{c}1+g.{c}2)/2)" for c in "xyz"]


@query("g5_center_distance", _pair_sql(dist="sqrt(" + "+".join(f"{d}*{d}" for d in _DC) + ")", signed="+".join(_DC)))
def _(t):
    return _pairs(t).select(
        F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"),
        r6(G.center_distance(A(), B()), "dist"), r6(G.center_distance(A(), B(), euclidean=False), "signed"),
    )


_DS = [f"({d}*c.sp_{a})" for d, a in zip(_DC, "xyz")]


@query(
    "g6_centroid_similarity",
    f"SELECT d.det_id, g.gt_id, {R('exp(-sqrt(' + '+'.join(f'{d}*{d}' for d in _DS) + ')/10.0)')} AS similarity "
    f"FROM det d JOIN gt g ON d.case_id=g.case_id AND {overlap('d', 'g')} JOIN cases c ON c.case_id=d.case_id",
)
def _(t):
    return _with_case(t, _pairs(t)).select(
        F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"),
        r6(G.centroid_similarity(A(), B(), SPACING()), "similarity"),
    )


_MARGIN = "least(" + ",".join(f"(d.{c}1+d.{c}2)/2-g.{c}1, g.{c}2-(d.{c}1+d.{c}2)/2" for c in "xyz") + ")"


@query("g7_center_in_box", f"SELECT d.det_id, g.gt_id, {_MARGIN} > 0.01 AS inside FROM det d JOIN gt g ON d.case_id=g.case_id AND {overlap('d', 'g')}")
def _(t):
    return _pairs(t).select(
        F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"), G.center_in_box(A(), B()).alias("inside")
    )


@query("g8_remove_small_boxes", "SELECT gt_id, case_id FROM gt WHERE x2-x1>=7 AND y2-y1>=8 AND z2-z1>=2")
def _(t):
    return t.gt.filter(G.sides_at_least(G.box(), [7, 8, 2])).select("gt_id", "case_id")


_CLIP = {f"{c}{i}": f"greatest(0.0,least(d.{c}{i},c.shape_{c}))" for i in (1, 2) for c in "xyz"}


@query("g9_clip_boxes", _det_sql(**_CLIP))
def _(t):
    return _with_case(t, t.det).select("det_id", *_six(G.clip_box(G.box(), SHAPE())))


@query("g10_permute_axes", _det_sql(x1="d.z1", y1="d.x1", z1="d.y1", x2="d.z2", y2="d.x2", z2="d.y2",
       ex1="c.sp_x", ex2="c.sp_x", ey1="c.sp_y", ey2="c.sp_y", ez1="c.sp_z", ez2="c.sp_z"))
def _(t):
    wide = G.expand_to_box(SPACING())
    return _with_case(t, t.det).select(
        "det_id", *_six(G.permute_axes(G.box(), [2, 0, 1])),
        *[r6(c, f"e{n}") for c, n in zip((*wide.lo, *wide.hi), (*G.LOW, *G.HIGH))],
    )


_RESTORE = {}
for _i in (1, 2):
    for _to, _from, _off in (("x", "z", "2"), ("y", "y", "3"), ("z", "x", "5")):
        _RESTORE[f"{_to}{_i}"] = f"d.{_from}{_i}*(1.0/c.sp_{_to})+{_off}"


@query("g11_restore_boxes", _det_sql(**_RESTORE))
def _(t):
    one = [F.lit(1.0)] * 3
    out = G.restore_box(G.box(), [2, 1, 0], one, SPACING(), [F.lit(2.0), F.lit(3.0), F.lit(5.0)])
    return _with_case(t, t.det).select("det_id", *_six(out))


@query("g12_offset_boxes", _det_sql(**{f"{c}{i}": f"d.{c}{i}+{o}" for i in (1, 2) for c, o in
       (("x", "(d.tile_id%2)*16"), ("y", "(d.tile_id//2)*16"), ("z", "0"))}))
def _(t):
    origins = t.det.select("case_id", "tile_id").distinct().select(
        "case_id", "tile_id",
        (F.col("tile_id") % 2 * 16).alias("ox"), F.expr("tile_id DIV 2 * 16").alias("oy"), F.lit(0).alias("oz"),
    )
    placed = t.det.join(origins, ["case_id", "tile_id"])
    return placed.select("det_id", *_six(G.shift_box(G.box(), [F.col("ox"), F.col("oy"), F.col("oz")])))


@query("g13_rescale_boxes", _det_sql(**{f"{to}{i}": f"d.{fr}{i}*(c.sp_{to}/{tg})" for i in (1, 2)
       for to, fr, tg in (("x", "z", "2.0"), ("y", "y", "0.5"), ("z", "x", "0.25"))}))
def _(t):
    target = [F.lit(2.0), F.lit(0.5), F.lit(0.25)]
    return _with_case(t, t.det).select("det_id", *_six(G.rescale_box(G.box(), SPACING(), target, [2, 1, 0])))


_BELL = "+".join(f"exp(-0.5*((((d.{c}1+d.{c}2)/2-{h})/({h}*0.8))*(((d.{c}1+d.{c}2)/2-{h})/({h}*0.8))))" for c, h in (("x", 16.0), ("y", 16.0), ("z", 8.0)))
_PLAT = "sqrt(" + "+".join(f"((d.{c}1+d.{c}2)/2-{h})*((d.{c}1+d.{c}2)/2-{h})" for c, h in (("x", 16.0), ("y", 16.0), ("z", 8.0))) + ")/sqrt(576.0)"


@query("g14_tile_weight", _det_sql(bell=f"({_BELL})/3.0", plateau=f"1.0-greatest(0.0,{_PLAT}-0.5)"))
def _(t):
    tile = [F.lit(32.0), F.lit(32.0), F.lit(16.0)]
    b = G.box()
    return t.det.select("det_id", r6(G.gaussian_tile_weight(b, tile), "bell"), r6(G.plateau_tile_weight(b, tile), "plateau"))


@query("g15_score_filter", "SELECT det_id, score > 0.05 AS strictly FROM det WHERE score >= 0.05")
def _(t):
    kept = t.det.filter(V.score_at_least(0.05))
    return kept.select("det_id", V.score_at_least(0.05, strict=True).alias("strictly"))


@query(
    "g16_identifiers",
    """SELECT o_orderkey, split_part(cid,'_',1) AS patient, regexp_extract(p,'([^/]+)_[0-9]{4}\\.nii$',1) AS case_id,
       CAST(regexp_extract(p,'_([0-9]{4})\\.nii$',1) AS BIGINT) AS modality,
       CASE WHEN arm LIKE '%lff%' THEN 'lff' WHEN arm LIKE '%caf%' AND arm NOT LIKE '%full%' THEN 'caf'
            WHEN arm LIKE '%full%' THEN 'full' WHEN arm LIKE '%baseline%' THEN 'baseline' ELSE arm END AS config
       FROM (SELECT o_orderkey, o_custkey || '_' || o_orderkey AS cid, arm,
                    '/data/' || arm || '/' || o_custkey || '_' || o_orderkey || '_000' || (o_orderkey % 3) || '.nii' AS p
             FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'run_baseline' WHEN '2-HIGH' THEN 'run_lff'
                   WHEN '3-MEDIUM' THEN 'run_caf' WHEN '4-NOT SPECIFIED' THEN 'run_full_caf' ELSE 'other' END AS arm FROM orders))""",
    views="",
)
def _(t):
    arm = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "run_baseline").when(F.col("o_orderpriority") == "2-HIGH", "run_lff")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "run_caf").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "run_full_caf")
        .otherwise("other")
    )
    cid = F.concat_ws("_", "o_custkey", "o_orderkey")
    path = F.concat(F.lit("/data/"), arm, F.lit("/"), cid, F.lit("_000"), F.col("o_orderkey") % 3, F.lit(".nii"))
    return t("orders").select(
        "o_orderkey", V.patient_of(cid).alias("patient"), V.case_from_path(path).alias("case_id"),
        V.modality_from_path(path).alias("modality"), V.config_from_path(path).alias("config"),
    )




@query("g17_grade_argmax", """SELECT det_id, CAST(CASE WHEN p2>=p3 AND p2>=p4 AND p2>=p5 THEN 2
       WHEN p3>=p4 AND p3>=p5 THEN 3 WHEN p4>=p5 THEN 4 ELSE 5 END AS BIGINT) AS grade FROM det""")
def _(t):
    return t.det.select("det_id", V.argmax_grade(PROBS()).alias("grade"))


@query("g18_temperature_scale", "SELECT det_id, " + ", ".join(
    f"{R(f'pow(p{k},0.5)/(pow(p2,0.5)+pow(p3,0.5)+pow(p4,0.5)+pow(p5,0.5))')} AS p{k}" for k in (2, 3, 4, 5)) + " FROM det")
def _(t):
    q = V.temperature_scale(PROBS(), F.lit(2.0))
    return t.det.select("det_id", q.alias("q")).select("det_id", *[r6(F.col("q")[i], f"p{i + 2}") for i in range(4)])


@query("g19_ordinal_probs", f"""SELECT det_id, {R('r1/n')} AS p2, {R('r2/n')} AS p3, {R('r3/n')} AS p4, {R('r4/n')} AS p5, clamped FROM
   (SELECT *, r1+r2+r3+r4 AS n FROM (SELECT det_id, 1.0-a AS r1, greatest(a-b,0.0) AS r2, greatest(b-c,0.0) AS r3, c AS r4,
      CAST(CASE WHEN b>a THEN 1 ELSE 0 END + CASE WHEN c>b THEN 1 ELSE 0 END AS BIGINT) AS clamped FROM
      (SELECT det_id, 1.0/(1.0+exp(-x1/10.0)) AS a, 1.0/(1.0+exp(-y1/10.0)) AS b, 1.0/(1.0+exp(-z1/10.0)) AS c FROM det)))""")
def _(t):
    logits = F.array(F.col("x1") / 10.0, F.col("y1") / 10.0, F.col("z1") / 10.0)
    q = t.det.select("det_id", V.ordinal_class_probs(logits).alias("q"), V.ordinal_clamp_count(logits).alias("clamped"))
    return q.select("det_id", *[r6(F.col("q")[i], f"p{i + 2}") for i in range(4)], "clamped")


_ENC = {f"d{c}": f"2.0*((g.{c}1+g.{c}2)/2-(d.{c}1+d.{c}2)/2)/(d.{c}2-d.{c}1)" for c in "xyz"}
_ENC |= {f"s{c}": f"0.5*ln((g.{c}2-g.{c}1)/(d.{c}2-d.{c}1))" for c in "xyz"}
_ENC |= {f"{c}{i}": f"g.{c}{i}" for i in (1, 2) for c in "xyz"}


@query("g20_box_offset_features", _pair_sql(**_ENC))
def _(t):
    w = [2.0, 2.0, 2.0, 0.5, 0.5, 0.5]
    shifts, scales = G.encode_offsets(B(), A(), w)
    back = G.decode_offsets(shifts, scales, A(), w)
    return _pairs(t).select(
        F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"),
        *[r6(c, f"d{n}") for c, n in zip(shifts, "xyz")], *[r6(c, f"s{n}") for c, n in zip(scales, "xyz")], *_six(back),
    )


@query("g21_remap_classes", """SELECT vec_id, CASE label WHEN 0 THEN 7 WHEN 7 THEN 0 WHEN 3 THEN -1 WHEN 4 THEN -1 ELSE label END AS label,
       CAST(0 AS INTEGER) AS collapsed FROM embeddings""", views="")
def _(t):
    mapping = {0: 7, 7: 0}
    new = remap_classes(F.col("label"), mapping, dropped=(3, 4))
    return t("embeddings").select("vec_id", new.alias("label"), F.lit(collapsed_classes(mapping)).alias("collapsed"))


@query("g22_flatten_config", """SELECT event_id, 'k' AS key, json_extract_string(props,'$.k') AS value FROM events
       UNION ALL SELECT event_id, 'run.type', event_type FROM events UNION ALL SELECT event_id, 'run.user', CAST(user_id AS VARCHAR) FROM events""", views="")
def _(t):
    nested = F.concat(
        F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "run": {"type": "'), F.col("event_type"),
        F.lit('", "user": '), F.col("user_id"), F.lit("}}"),
    )
    return flatten_json(t("events").select("event_id", nested.alias("config")), "event_id", "config", "k BIGINT, run STRUCT<type: STRING, user: BIGINT>")


_FLIP = {}
for _c, _bit in (("x", 1), ("y", 2), ("z", 4)):
    _FLIP[f"{_c}1"] = f"CASE WHEN ((d.det_id%8)//{_bit})%2=1 THEN c.shape_{_c}-d.{_c}2 ELSE d.{_c}1 END"
    _FLIP[f"{_c}2"] = f"CASE WHEN ((d.det_id%8)//{_bit})%2=1 THEN c.shape_{_c}-d.{_c}1 ELSE d.{_c}2 END"


@query("g23_mirror_boxes", _det_sql(**_FLIP))
def _(t):
    variant = F.col("det_id") % 8
    dims = F.filter(F.array(*[F.when(F.expr(f"(det_id % 8) DIV {1 << i} % 2 = 1"), F.lit(i)) for i in range(3)]), lambda v: v.isNotNull())
    flipped = _with_case(t, t.det.withColumn("variant", variant).withColumn("dims", dims))
    return flipped.select("det_id", *_six(G.mirror_box(G.box(), SHAPE(), F.col("dims"))))

