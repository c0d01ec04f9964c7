"""Explicit schemas of the engine's tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

D, L, S, B = T.DoubleType(), T.LongType(), T.StringType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


BOX_FIELDS = dict(x1=D, y1=D, x2=D, y2=D, z1=D, z2=D)
BOX = struct(**BOX_FIELDS)

DETECTIONS = struct(case_id=S, det_id=L, label=L, score=D, **BOX_FIELDS, grade_probs=T.ArrayType(D))
GROUND_TRUTH = struct(case_id=S, gt_id=L, label=L, **BOX_FIELDS, ignore=B, grade=L, supervised=B)
CASES = struct(case_id=S, size=T.ArrayType(L), spacing=T.ArrayType(D), origin=T.ArrayType(D), direction=T.ArrayType(D))

PREDICTION_FILE = struct(
    case_id=S,
    pred_boxes=T.ArrayType(T.ArrayType(D)),
    pred_scores=T.ArrayType(D),
    pred_labels=T.ArrayType(L),
    pred_grade_probs=T.ArrayType(T.ArrayType(D)),
)
GT_FILE = struct(case_id=S, boxes=T.ArrayType(T.ArrayType(D)), classes=T.ArrayType(L))
INSTANCE_LABELS = struct(
    case_id=S,
    instances=T.MapType(S, L),
    grades=T.MapType(S, L),
    grade_sources=T.MapType(S, S),
    grade_supervised=T.MapType(S, B),
)
SPLITS = T.ArrayType(struct(train=T.ArrayType(S), val=T.ArrayType(S)))
MARKSHEET = struct(patient_id=S, study_id=S, lesion_ISUP=S, case_ISUP=L)
STAGES = ("source", "resampled", "inplane", "final")
RETENTION = struct(
    case_id=S, crop_strategy=S, status=S, exclusion_reason=S,
    **{f"{s}_{m}": L for s in STAGES for m in ("voxels", "components")},
)
ARRIVALS = struct(arm=S, fold=L, case_id=S, kind=S, arrived=T.TimestampType())
METRICS = struct(run=S, fold=L, key=S, value=D)
