"""Sparse-voxel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtally.functions.values import draw, draw_sql
from boxtally.operators import voxels as V
from boxtally.operators.lookups import instance_classes
from boxtally.plans.metric_queries import SEG_SQL, segmentation
from boxtally.plans.registry import big, query, r6
from boxtally.plans.sqlparts import R

SP = ("sp_x", "sp_y", "sp_z")
SHAPE = ("shape_x", "shape_y", "shape_z")
ALL = "gt det cases voxels"
GLAND = "gl AS (SELECT DISTINCT case_id, z, y, x FROM voxels WHERE label=0), le AS (SELECT case_id, gt_id, grade, z, y, x FROM voxels WHERE label=1)"


def gland(t):
    return t.voxels.filter("label = 0").select("case_id", "z", "y", "x").distinct()


def lesion(t):
    return t.voxels.filter("label = 1").select("case_id", "gt_id", "grade", "z", "y", "x")


@query("v1_mask_to_boxes", """SELECT gt_id, 'half_open' AS convention, min(x)::DOUBLE AS x1, max(x)+1.0::DOUBLE AS x2, min(z)::DOUBLE AS z1, max(z)+1.0::DOUBLE AS z2 FROM voxels GROUP BY gt_id
   UNION ALL SELECT gt_id, 'expanded', min(x)-1.0::DOUBLE, max(x)+1.0::DOUBLE, min(z)-1.0::DOUBLE, max(z)+1.0::DOUBLE FROM voxels GROUP BY gt_id""", views="voxels")
def _(t):
    make = lambda c: V.mask_to_boxes(t.voxels, ["gt_id"], c).select("gt_id", F.lit(c).alias("convention"), "x1", "x2", "z1", "z2")
    return make("half_open").unionByName(make("expanded"))


@query("v2_bbox_nonzero", "SELECT case_id, min(x)::DOUBLE AS x1, min(y)::DOUBLE AS y1, min(z)::DOUBLE AS z1, max(x)+1.0::DOUBLE AS x2, max(y)+1.0::DOUBLE AS y2, max(z)+1.0::DOUBLE AS z2 FROM voxels WHERE value<>0 GROUP BY case_id", views="voxels")
def _(t):
    return V.bbox_nonzero(t.voxels)


@query("v3_instance_volume", f"SELECT case_id, gt_id, label, count(*) AS voxels, {R('count(*)*any_value(sp_x*sp_y*sp_z)')} AS volume FROM voxels JOIN cases USING (case_id) GROUP BY ALL", views=ALL)
def _(t):
    return V.instance_volume(t.voxels, ["case_id", "gt_id", "label"], t.cases, SP).select("case_id", "gt_id", "label", "voxels", r6("volume"))


_V4 = """v4 AS (SELECT * FROM (SELECT *, gt_id%2 AS modality, row_number() OVER (PARTITION BY case_id, gt_id%2 ORDER BY z,y,x) AS i FROM voxels) WHERE (i-1)%10=0)"""


@query("v4_intensity_stats", _V4 + f""" SELECT case_id, modality, count(*) AS n, {R('quantile_cont(value,0.5)')} AS median, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, min(value) AS min, max(value) AS max,
   {R('quantile_cont(value,0.005)')} AS p005, {R('quantile_cont(value,0.995)')} AS p995 FROM v4 GROUP BY GROUPING SETS ((case_id, modality), (modality))""", views="voxels")
def _(t):
    s = V.intensity_stats(t.voxels.withColumn("modality", F.col("gt_id") % 2))
    return s.select("case_id", "modality", "n", *[r6(c) for c in ("median", "mean", "std")], "min", "max", r6("p005"), r6("p995"))


_ST = "st AS (SELECT avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value,0.005) AS lo, quantile_cont(value,0.995) AS hi FROM voxels)"


@query("v5_normalise_ct", _ST + f", r AS (SELECT gt_id, (greatest(lo,least(value,hi))-m)/s AS n FROM voxels, st) SELECT gt_id, {R('sum(n)')} AS total, {R('max(n)')} AS top FROM r GROUP BY gt_id", views="voxels")
def _(t):
    pooled = V.intensity_stats(t.voxels.withColumn("modality", F.lit(0)), step=1).filter("case_id IS NULL")
    out = V.normalise_ct(t.voxels, pooled)
    return out.groupBy("gt_id").agg(r6(F.sum("normalised"), "total"), r6(F.max("normalised"), "top"))


@query("v5_normalise_ct_per_case", _ST + f""", pc AS (SELECT case_id, avg(value) AS cm, stddev_pop(value) AS cs FROM voxels, st WHERE value>lo AND value<hi GROUP BY case_id),
   r AS (SELECT gt_id, (greatest(lo,least(value,hi))-cm)/cs AS n FROM voxels JOIN pc USING (case_id), st) SELECT gt_id, {R('sum(n)')} AS total FROM r GROUP BY gt_id""", views="voxels")
def _(t):
    pooled = V.intensity_stats(t.voxels.withColumn("modality", F.lit(0)), step=1).filter("case_id IS NULL")
    return V.normalise_ct_per_case(t.voxels, pooled).groupBy("gt_id").agg(r6(F.sum("normalised"), "total"))


@query("v5_normalise_per_case", f"""pc AS (SELECT case_id, avg(value) AS cm, stddev_pop(value) AS cs FROM voxels WHERE x>=5 GROUP BY case_id)
   SELECT gt_id, {R('sum(CASE WHEN x>=5 THEN (value-cm)/(cs+1e-8) ELSE 0 END)')} AS total FROM voxels JOIN pc USING (case_id) GROUP BY gt_id""", views="voxels")
def _(t):
    return V.normalise_per_case(t.voxels, mask=F.col("x") >= 5).groupBy("gt_id").agg(r6(F.sum("normalised"), "total"))


_MRI = "CAST((x*13+y*7+z*3+case_id)%97+1 AS DOUBLE) AS t2w, CAST((x*5+y*11+z*2)%83*20 AS DOUBLE) AS adc, CAST((x+y*3+z*17+case_id)%71+1 AS DOUBLE) AS hbv, gt_id%2=0 AS gland, x>=2 AS fov_t2w, y>=2 AS fov_adc, z>=1 AS fov_hbv"


def mri(t):
    return t.voxels.selectExpr("case_id", "gt_id", "z", "y", "x", "label", *_MRI.split(", "))


@query("v5_normalise_gland_group", f"""mr AS (SELECT case_id, {_MRI} FROM voxels), pc AS (SELECT case_id, avg(t2w) FILTER (WHERE gland AND fov_t2w) AS m, stddev_pop(t2w) FILTER (WHERE gland AND fov_t2w) AS s, quantile_cont(hbv,0.5) FILTER (WHERE gland AND fov_hbv) AS h FROM mr GROUP BY case_id)
   SELECT case_id, {R('sum(CASE WHEN fov_t2w THEN (t2w-m)/s ELSE -5.0 END)')} AS t2w, {R('sum(CASE WHEN fov_adc THEN (greatest(0.0,least(adc,1500.0))-800.0)/400.0 ELSE -5.0 END)')} AS adc,
   {R('sum(CASE WHEN fov_hbv THEN (greatest(0.2,least(hbv/h,1.7))-1.0)/0.5 ELSE -5.0 END)')} AS hbv FROM mr JOIN pc USING (case_id) GROUP BY case_id""", views="voxels")
def _(t):
    out = V.normalise_gland_group(mri(t), {"low": 0.0, "high": 1500.0, "offset": 800.0, "scale": 400.0}, {"low": 0.2, "high": 1.7, "offset": 1.0, "scale": 0.5}, -5.0)
    return out.groupBy("case_id").agg(*[r6(F.sum(c), c) for c in ("t2w", "adc", "hbv")])


@query("v6_fov_coverage", f"mr AS (SELECT case_id, {_MRI} FROM voxels) SELECT case_id, " + ", ".join(f"{R(f'avg({c}::INT)')} AS {c}" for c in ("fov_t2w", "fov_adc", "fov_hbv")) + " FROM mr GROUP BY case_id", views="voxels")
def _(t):
    c = V.fov_coverage(mri(t), ["fov_t2w", "fov_adc", "fov_hbv"])
    return c.select("case_id", *[r6(x) for x in ("fov_t2w", "fov_adc", "fov_hbv")])


def components_sql(same: str, group: str) -> str:
    """Components of unions of integer boxes: boxes touch iff their ranges meet on every axis."""
    touch = " AND ".join(f"least(a.{c}2,b.{c}2)-greatest(a.{c}1,b.{c}1) >= 0" for c in "xyz")
    return f"""ed AS (SELECT a.gt_id AS u, b.gt_id AS v FROM gt a JOIN gt b ON a.case_id=b.case_id {same} AND {touch}),
    reach AS (SELECT u AS root, v FROM ed UNION SELECT r.root, e.v FROM reach r JOIN ed e ON e.u=r.v),
    cp AS (SELECT v AS gt_id, min(root) AS comp FROM reach GROUP BY v),
    vx AS (SELECT DISTINCT v.case_id, {group} comp, z, y, x FROM voxels v JOIN cp USING (gt_id)),
    sz AS (SELECT case_id, {group} comp, count(*) AS voxels, min((z::BIGINT<<42)+(y::BIGINT<<21)+x) AS first FROM vx GROUP BY ALL),
    nb AS (SELECT *, row_number() OVER (PARTITION BY case_id{', ' + group.rstrip(', ') if group else ''} ORDER BY first) AS instance_id FROM sz)"""


@query("v7_connected_components", components_sql("AND a.label=b.label", "label,") + " SELECT case_id, label, instance_id, first AS component, voxels FROM nb", views=ALL)
def _(t):
    c = V.connected_voxels(t.voxels, ("case_id", "label"))
    return c.groupBy("case_id", "label", "instance_id", "component").agg(F.count(F.lit(1)).alias("voxels"))


@query("v7_voted_components", components_sql("", "") + "," + SEG_SQL + """, vt AS (SELECT vx.case_id, vx.comp, s.class, count(*) AS n FROM vx JOIN seg s ON s.case_id=vx.case_id AND s.z=vx.z AND s.y=vx.y AND s.x=vx.x GROUP BY ALL)
   SELECT nb.case_id, instance_id, voxels, (SELECT arg_max(class,(n,-class)) FROM vt WHERE vt.comp=nb.comp) AS class FROM nb""", views=ALL)
def _(t):
    return V.voted_components(segmentation(t)).select("case_id", "instance_id", "voxels", "class").distinct()


@query("v8_single_region_check", components_sql("AND a.label=b.label", "label,") + " SELECT case_id, label, count(*) AS components, count(*)=1 AS single FROM nb GROUP BY ALL", views=ALL)
def _(t):
    return V.region_counts(t.voxels, ("case_id", "label"))


@query("v9_min_size_filter", """b AS (SELECT v.case_id, gt_id, count(*) AS voxels, (max(x)-min(x)+2)*any_value(sp_x) AS ex, (max(y)-min(y)+2)*any_value(sp_y) AS ey, (max(z)-min(z)+2)*any_value(sp_z) AS ez,
   any_value(sp_x) AS sx, any_value(sp_y) AS sy, any_value(sp_z) AS sz FROM voxels v JOIN cases USING (case_id) GROUP BY ALL)
   SELECT case_id, gt_id AS instance_id, voxels, row_number() OVER (PARTITION BY case_id ORDER BY gt_id) AS new_id FROM b WHERE voxels>150 AND ex>5.0 AND ey>5.0""", views=ALL)
def _(t):
    v = t.voxels.withColumnRenamed("gt_id", "instance_id")
    return V.min_size_filter(v, t.cases, SP, 5.0, 150)


@query("v10_containment", GLAND + f" SELECT c.case_id, {R('coalesce((SELECT avg(CASE WHEN g.x IS NULL THEN 0.0 ELSE 1.0 END) FROM le LEFT JOIN gl g USING (case_id,z,y,x) WHERE le.case_id=c.case_id),1.0)')} AS containment FROM cases c", views=ALL)
def _(t):
    return V.containment_per_case(t.cases, lesion(t), gland(t)).select("case_id", r6("containment"))


@query("v10_containment_per_instance", GLAND + f" SELECT le.gt_id, count(*) AS voxels, count(*) FILTER (WHERE g.x IS NULL) AS outside_voxels, {R('avg(CASE WHEN g.x IS NULL THEN 0.0 ELSE 1.0 END)')} AS containment FROM le LEFT JOIN gl g ON g.case_id=le.case_id AND g.z=le.z AND g.y=le.y AND g.x=le.x GROUP BY le.gt_id", views=ALL)
def _(t):
    return V.containment(lesion(t), gland(t), ["gt_id"]).select("gt_id", "voxels", "outside_voxels", r6("containment"))


@query("v11_centroid", f"SELECT gt_id, {R('avg(x)')} AS cx, {R('avg(y)')} AS cy, {R('avg(z)')} AS cz FROM voxels GROUP BY gt_id", views="voxels")
def _(t):
    return V.centroid(t.voxels, ["gt_id"]).select("gt_id", r6("cx"), r6("cy"), r6("cz"))


@query("v11_centroid_offset_mm", GLAND + f""", a AS (SELECT case_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM le GROUP BY case_id), b AS (SELECT case_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM gl GROUP BY case_id)
   SELECT c.case_id, {R('sqrt(pow((a.x-b.x)*sp_x,2)+pow((a.y-b.y)*sp_y,2)+pow((a.z-b.z)*sp_z,2))')} AS offset_mm FROM cases c LEFT JOIN a USING (case_id) LEFT JOIN b USING (case_id)""", views=ALL)
def _(t):
    return V.centroid_offset_mm(lesion(t), gland(t), t.cases, SP).select("case_id", r6("offset_mm"))


@query("v12_dice", GLAND + f""", l AS (SELECT DISTINCT case_id, z, y, x FROM le), n AS (SELECT coalesce(l.case_id,g.case_id) AS case_id, count(l.x) AS a, count(g.x) AS b, count(CASE WHEN l.x IS NOT NULL AND g.x IS NOT NULL THEN 1 END) AS i FROM l FULL JOIN gl g ON g.case_id=l.case_id AND g.z=l.z AND g.y=l.y AND g.x=l.x GROUP BY 1)
   SELECT c.case_id, {R('CASE WHEN a+b>0 THEN 2.0*i/(a+b) ELSE 1.0 END')} AS dice FROM cases c LEFT JOIN n USING (case_id)""", views=ALL)
def _(t):
    return V.mask_dice(lesion(t), gland(t), t.cases).select("case_id", r6("dice"))


_V13 = GLAND + """, ou AS (SELECT le.* FROM le ANTI JOIN gl USING (case_id,z,y,x)), uo AS (SELECT DISTINCT case_id, z, y, x FROM ou),
   ds AS (SELECT o.case_id, o.z, o.y, o.x, min(sqrt(pow((o.x-g.x)*sp_x,2)+pow((o.y-g.y)*sp_y,2)+pow((o.z-g.z)*sp_z,2))) AS dist FROM uo o JOIN gl g ON g.case_id=o.case_id JOIN cases c ON c.case_id=o.case_id GROUP BY ALL),
   od AS (SELECT ou.*, ds.dist FROM ou LEFT JOIN ds USING (case_id,z,y,x))"""
_DS = ", ".join(f"{R(e)} AS {n}" for n, e in (("min", "min(dist)"), ("p25", "quantile_cont(dist,0.25)"), ("median", "quantile_cont(dist,0.5)"), ("p75", "quantile_cont(dist,0.75)"), ("p95", "quantile_cont(dist,0.95)"), ("max", "max(dist)")))


@query("v13_outside_distance", _V13 + f" SELECT case_id, gt_id, {_DS} FROM od GROUP BY case_id, gt_id", views=ALL)
def _(t):
    d = V.outside_distance(lesion(t), gland(t), t.cases, SP)
    s = V.distance_summary(d, ["case_id", "gt_id"])
    return s.select("case_id", "gt_id", *[r6(c) for c in ("min", "p25", "median", "p75", "p95", "max")])


@query("v14_dilation_sweep", GLAND + """, l AS (SELECT DISTINCT case_id, z, y, x FROM le), m AS (SELECT l.case_id, l.z, l.y, l.x, min(abs(l.z-g.z)+abs(l.y-g.y)+abs(l.x-g.x)) AS r FROM l LEFT JOIN gl g ON g.case_id=l.case_id AND g.z BETWEEN l.z-3 AND l.z+3 AND g.y BETWEEN l.y-3 AND l.y+3 AND g.x BETWEEN l.x-3 AND l.x+3 GROUP BY ALL)
   SELECT case_id, """ + ", ".join(f"{R(f'avg(CASE WHEN r<={k} THEN 1.0 ELSE 0.0 END)')} AS containment_{k}" for k in range(4)) + " FROM m GROUP BY case_id", views=ALL)
def _(t):
    s = V.dilation_sweep(lesion(t).select("case_id", "z", "y", "x").distinct(), gland(t))
    return s.select("case_id", *[r6(f"containment_{k}") for k in range(4)])


_ZONE = "(x+2*y)%4"


def anatomy(t):
    inside = gland(t).withColumn("gland", F.lit(True))
    v = t.voxels.select("case_id", "z", "y", "x").distinct().join(inside, ["case_id", "z", "y", "x"], "left")
    return V.anatomy_codes(v.withColumn("gland", F.coalesce("gland", F.lit(False))).withColumn("zone", F.expr(_ZONE)))


_ANAT = GLAND + f", an AS (SELECT v.*, CASE WHEN g.x IS NULL THEN 0 WHEN {_ZONE.replace('x', 'v.x').replace('y', 'v.y')}=1 THEN 1 WHEN {_ZONE.replace('x', 'v.x').replace('y', 'v.y')}=2 THEN 2 ELSE 3 END AS code FROM (SELECT DISTINCT case_id,z,y,x FROM voxels) v LEFT JOIN gl g ON g.case_id=v.case_id AND g.z=v.z AND g.y=v.y AND g.x=v.x)"


@query("v15_anatomy_codes", _ANAT + " SELECT case_id, CAST(code AS BIGINT) AS anatomy, count(*) AS n FROM an GROUP BY ALL", views=ALL)
def _(t):
    return anatomy(t).groupBy("case_id", "anatomy").agg(F.count(F.lit(1)).alias("n"))


@query("v15_zone_share", f"SELECT gt_id, {R(f'avg(CASE WHEN {_ZONE}=1 THEN 1.0 ELSE 0.0 END)')} AS pz_share FROM voxels WHERE label=1 GROUP BY gt_id", views=ALL)
def _(t):
    return lesion(t).groupBy("gt_id").agg(r6(F.avg(F.when(F.expr(_ZONE) == 1, 1.0).otherwise(0.0)), "pz_share"))


_OFFSETS = "(VALUES (0,0,0,1)," + ",".join(f"({dz},{dy},{dx},0)" for dz, dy, dx in V.FACES) + ") o(dz,dy,dx,own)"


def eroded_sql(src: str) -> str:
    return f"(SELECT case_id, z, y, x FROM (SELECT case_id, z+dz AS z, y+dy AS y, x+dx AS x, own FROM {src}, {_OFFSETS}) GROUP BY case_id, z, y, x HAVING sum(own)=1 AND count(*)=7)"


@query("v16_sample_centres", GLAND + f", e1 AS {eroded_sql('gl')}, e2 AS {eroded_sql('e1')}," +
       f" rk AS (SELECT *, {_ZONE} AS zone, row_number() OVER (PARTITION BY case_id, {_ZONE} ORDER BY {draw_sql('case_id', 'z*4096+y*64+x')}, z, y, x) AS n FROM e2 WHERE {_ZONE} IN (1,2)) SELECT case_id, CAST(zone AS BIGINT) AS zone, z, y, x FROM rk WHERE n<=5", views=ALL)
def _(t):
    core = V.erode(gland(t), 2).withColumn("zone", big(F.expr(_ZONE))).filter("zone IN (1, 2)")
    return V.sample_centres(core, 5, draw(F.col("case_id"), F.col("z") * 4096 + F.col("y") * 64 + F.col("x"))).select("case_id", "zone", "z", "y", "x")


@query("v17_retention_stats", components_sql("AND a.label=b.label", "label,") + " SELECT case_id, label AS stage, CAST(sum(voxels) AS BIGINT) AS voxels, count(*) AS components FROM nb GROUP BY ALL", views=ALL)
def _(t):
    return V.retention_stats(t.voxels.withColumnRenamed("label", "stage"))


def _crop(a: str) -> str:
    n, s = f"shape_{a}", f"sp_{a}"
    size = f"CAST(round_even(12.0/{s},0) AS BIGINT)"
    start = f"CAST(round_even(coalesce(c{a},({n}-1)/2.0)-{size}/2.0,0) AS BIGINT)"
    return f"greatest(0,{start}) AS {a}_start, least(CAST({n} AS BIGINT),{start}+{size}) AS {a}_end, greatest(0,-({start})) AS {a}_pad_before, greatest(0,{start}+{size}-CAST({n} AS BIGINT)) AS {a}_pad_after"


@query("v18_crop_window", GLAND + f", ce AS (SELECT case_id, avg(x) AS cx, avg(y) AS cy FROM gl GROUP BY case_id) SELECT case_id, CASE WHEN cx IS NULL THEN 't2w_geometric_centre' ELSE 'gland' END AS strategy, {_crop('x')}, {_crop('y')} FROM cases LEFT JOIN ce USING (case_id)", views=ALL)
def _(t):
    return V.crop_window(gland(t), t.cases, SHAPE, SP, 12.0)


@query("v19_region_features", f"""mr AS (SELECT case_id, gt_id, label, {_MRI} FROM voxels), gg AS (SELECT case_id, quantile_cont(hbv,0.5) FILTER (WHERE fov_hbv) AS gh, quantile_cont(t2w,0.5) FILTER (WHERE fov_t2w) AS gtw FROM mr WHERE label=0 GROUP BY case_id)
   SELECT m.gt_id AS instance_id, {R('quantile_cont(adc,0.1) FILTER (WHERE fov_adc)')} AS adc_p10, {R('quantile_cont(adc,0.5) FILTER (WHERE fov_adc)')} AS adc_median,
   {R('quantile_cont(hbv,0.9) FILTER (WHERE fov_hbv)/any_value(gh)')} AS hbv_ratio, {R('quantile_cont(t2w,0.5) FILTER (WHERE fov_t2w)/any_value(gtw)')} AS t2w_ratio, {R('count(*)*any_value(sp_x*sp_y*sp_z)')} AS volume
   FROM mr m LEFT JOIN gg USING (case_id) JOIN cases c ON c.case_id=m.case_id WHERE m.label=1 GROUP BY m.gt_id""", views=ALL)
def _(t):
    m = mri(t).withColumnRenamed("gt_id", "instance_id")
    f = V.region_features(m.filter("label = 1"), m.filter("label = 0"), t.cases, SP)
    return f.select("instance_id", *[r6(c) for c in ("adc_p10", "adc_median", "hbv_ratio", "t2w_ratio", "volume")])


@query("v20_occupancy", _ANAT + f" SELECT l.gt_id AS placement_id, {R('avg(CASE WHEN code>0 THEN 1.0 ELSE 0.0 END)')} AS gland_fraction, {R('avg(CASE WHEN code=1 THEN 1.0 ELSE 0.0 END)')} AS zone_fraction FROM le l LEFT JOIN an ON an.case_id=l.case_id AND an.z=l.z+1 AND an.y=l.y+2 AND an.x=l.x+3 GROUP BY l.gt_id", views=ALL)
def _(t):
    source = lesion(t).select(F.col("gt_id").alias("source_id"), "z", "y", "x")
    spots = t.gt.filter("label = 1").select(F.col("gt_id").alias("placement_id"), F.col("gt_id").alias("source_id"), "case_id", F.lit(1).alias("dz"), F.lit(2).alias("dy"), F.lit(3).alias("dx"))
    o = V.occupancy(source, anatomy(t), spots, F.lit(1))
    return o.select("placement_id", r6("gland_fraction"), r6("zone_fraction"))


_VOTES = "SELECT case_id, gt_id AS region, r AS rater, z, y, x, CASE WHEN (gt_id {div} 5+r)%6=5 THEN -1.0e0 ELSE CAST((gt_id {div} 5+r)%6 AS DOUBLE) END AS rating FROM {src} WHERE r < 1+gt_id%4 AND (x*3+y*5+z*7+r)%4<>0"


def _votes(t):
    rows = t.voxels.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return t.spark.sql(_VOTES.replace("{div}", "DIV"), src=rows)


_VT = "vt AS (" + _VOTES.format(div="//", src="(SELECT * FROM voxels, (SELECT unnest(range(0,4)) AS r))") + "), kp AS (SELECT case_id, region, z, y, x FROM vt GROUP BY ALL HAVING count(*)/4.0>=0.5)"


@query("v21_rater_consensus", _VT + f""", rt AS (SELECT DISTINCT case_id, region, rater, rating FROM vt), lb AS (SELECT region, sum(CASE WHEN rating>-1 THEN rating END)/(count(CASE WHEN rating>-1 THEN 1 END)+4-count(*)) AS rating FROM rt GROUP BY region)
   SELECT kp.region, count(*) AS voxels, {R('any_value(rating)')} AS rating, CAST(any_value(rating)>=3 AS BIGINT) AS label FROM kp JOIN lb USING (region) GROUP BY kp.region""", views="voxels")
def _(t):
    kept, labels = V.rater_consensus(_votes(t))
    n = kept.groupBy("region").agg(F.count(F.lit(1)).alias("voxels"))
    return n.join(labels, "region").select("region", "voxels", r6("rating"), "label")


@query("v22_ball_to_voxels", """an AS (SELECT gt_id, case_id, (x1+x2)/2*sp_x+10.0 AS wx, (y1+y2)/2*sp_y-5.0 AS wy, (z1+z2)/2*sp_z+2.5 AS wz, sp_x, sp_y, sp_z FROM gt JOIN cases USING (case_id))
   SELECT gt_id, CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM an, (SELECT unnest(range(-10,70)) AS x) a, (SELECT unnest(range(-10,70)) AS y) b, (SELECT unnest(range(-10,40)) AS z) c
   WHERE abs(x*sp_x+10.0-wx)<=3 AND abs(y*sp_y-5.0-wy)<=3 AND abs(z*sp_z+2.5-wz)<=3 AND pow(x*sp_x+10.0-wx,2)+pow(y*sp_y-5.0-wy,2)+pow(z*sp_z+2.5-wz,2)<=9.0""")
def _(t):
    c = _with_origin(t)
    mid = [((F.col(f"{a}1") + F.col(f"{a}2")) / 2 * F.col(f"sp_{a}") + F.col(f"o{a}")).alias(f"w{a}") for a in "xyz"]
    notes = t.gt.join(c, "case_id").select("case_id", "gt_id", *mid, F.lit(3.0).alias("radius"))
    return V.ball_to_voxels(notes, c, SP, ("ox", "oy", "oz")).select("gt_id", "z", "y", "x")


def _with_origin(t):
    return t.cases.select("case_id", *SP, F.lit(10.0).alias("ox"), F.lit(-5.0).alias("oy"), F.lit(2.5).alias("oz"),
                          *[F.lit(v).alias(f"d{i}") for i, v in enumerate((0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0))])


@query("v23_index_to_world", f"""SELECT det_id, {R('(y1+y2)/2*sp_y+10.0')} AS world_x, {R('-(x1+x2)/2*sp_x-5.0')} AS world_y, {R('(z1+z2)/2*sp_z+2.5')} AS world_z FROM det JOIN cases USING (case_id)""")
def _(t):
    pts = t.det.select("case_id", "det_id", *[((F.col(f"{a}1") + F.col(f"{a}2")) / 2).alias(f"p{a}") for a in "xyz"])
    w = V.index_to_world(pts, _with_origin(t), SP, ("ox", "oy", "oz"), [f"d{i}" for i in range(9)])
    return w.select("det_id", *[r6(f"world_{a}") for a in "xyz"])


@query("v24_instances_to_classes", "SELECT case_id, label+1 AS class, count(*) AS n FROM voxels GROUP BY ALL", views="voxels")
def _(t):
    mapping = t.boxes.select("case_id", F.col("gt_id").alias("instance_id"), F.col("label").alias("class"))
    v = t.voxels.select("case_id", F.col("gt_id").alias("instance_id"), "z", "y", "x")
    return instance_classes(v, mapping, background=True).groupBy("case_id", "class").agg(F.count(F.lit(1)).alias("n"))


@query("v25_object_crops", "SELECT gt_id, CAST(floor(avg(x)) AS BIGINT)-8 AS x1, CAST(floor(avg(y)) AS BIGINT)-8 AS y1, CAST(floor(avg(z)) AS BIGINT)-4 AS z1, CAST(floor(avg(x)) AS BIGINT)+8 AS x2, CAST(floor(avg(y)) AS BIGINT)+8 AS y2, CAST(floor(avg(z)) AS BIGINT)+4 AS z2 FROM voxels GROUP BY gt_id", views="voxels")
def _(t):
    return V.object_crops(t.voxels, ["gt_id"], {"x": 16, "y": 16, "z": 8})


@query("v26_mean_probability", SEG_SQL + f" SELECT case_id, z, y, x, class, {R('(((x+y+z)%7+1)/10.0+((x+y+z+1)%7+1)/10.0+((x+y+z+2)%7+1)/10.0)/3')} AS prob FROM seg", views="voxels")
def _(t):
    rows = segmentation(t).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.withColumn("prob", ((F.col("x") + F.col("y") + F.col("z") + F.col("model")) % 7 + 1) / 10.0)
    return V.mean_probability(rows, 3).select("case_id", "z", "y", "x", "class", r6("prob"))


_SM = SEG_SQL + """, sm AS (SELECT s.case_id, s.z, s.y, s.x, k.c, CASE WHEN k.c=0 THEN 0.05e0 WHEN k.c=s.class THEN 0.8737111e0-((s.x+s.y)%5)*0.0971237e0 ELSE 0.1e0+((s.x*3+s.y)%7)*0.1e0 END AS p FROM seg s, (SELECT unnest(range(0,3)) AS c) k),
   bs AS (SELECT case_id, z, y, x, arg_max(c,(p,-c)) AS class, max(p) AS p FROM sm GROUP BY ALL)"""


@query("d15_softmax_to_detections", components_sql("", "") + "," + _SM + f""", ag AS (SELECT vx.case_id, vx.comp, count(*) AS voxels, max(p) AS score, avg(p) AS score_mean, min(vx.x)::DOUBLE AS x1, max(vx.z)+1.0::DOUBLE AS z2 FROM vx JOIN bs ON bs.case_id=vx.case_id AND bs.z=vx.z AND bs.y=vx.y AND bs.x=vx.x GROUP BY ALL),
   vt AS (SELECT vx.comp, bs.class, count(*) AS n FROM vx JOIN bs ON bs.case_id=vx.case_id AND bs.z=vx.z AND bs.y=vx.y AND bs.x=vx.x GROUP BY ALL)
   SELECT nb.case_id, nb.instance_id, (SELECT arg_max(class,(n,-class)) FROM vt WHERE vt.comp=nb.comp) AS class, ag.voxels, {R('score')} AS score, {R('score_mean')} AS score_mean, x1, z2 FROM nb JOIN ag ON ag.comp=nb.comp""", views=ALL)
def _(t):
    seg = segmentation(t).withColumn("own", F.col("class"))
    c = F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("c")
    rows = seg.select("case_id", "z", "y", "x", "own", c)
    p = (F.when(F.col("c") == 0, F.lit(0.05)).when(F.col("c") == F.col("own"), 0.8737111 - ((F.col("x") + F.col("y")) % 5) * 0.0971237)
         .otherwise(0.1 + ((F.col("x") * 3 + F.col("y")) % 7) * 0.1))
    probs = rows.select("case_id", "z", "y", "x", F.col("c").alias("class"), p.alias("prob"))
    return V.softmax_to_detections(probs).select("case_id", "instance_id", "class", "voxels", r6("score"), r6("score_mean"), "x1", "z2")
