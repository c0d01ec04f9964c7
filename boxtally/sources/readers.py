"""Readers: files in, one row per box / instance / finding out, with contract violations as rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxtally.functions.values import case_from_path, modality_from_path
from boxtally.sources import schema as S


def assert_none(violations: DataFrame, what: str) -> None:
    """Raise with up to five examples when a violations table is not empty."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def _six(value) -> list:
    """Box columns out of a packed ``(x1, y1, x2, y2, z1, z2)`` array."""
    return [F.get(value, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "z1", "z2"))]


def explode_detections(files: DataFrame) -> DataFrame:
    """One row per detection of per-case parallel arrays; ``det_id`` is the position in the file."""
    zipped = F.arrays_zip("pred_boxes", "pred_scores", "pred_labels", "pred_grade_probs")
    rows = files.select("case_id", F.posexplode(zipped).alias("pos", "r"))
    return rows.select(
        "case_id", F.col("pos").cast("long").alias("det_id"), F.col("r.pred_labels").alias("label"),
        F.col("r.pred_scores").alias("score"), *_six(F.col("r.pred_boxes")),
        F.col("r.pred_grade_probs").alias("grade_probs"),
    )


def detection_violations(files: DataFrame) -> DataFrame:
    """Cases whose arrays differ in length or hold non-finite or out-of-range values."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    unit = lambda c: finite(c) & (c >= 0) & (c <= 1)
    n = F.size("pred_scores")
    rules = [
        ("missing_key", F.col("pred_boxes").isNull() | F.col("pred_scores").isNull() | F.col("pred_labels").isNull()),
        ("length_mismatch", (F.size("pred_boxes") != n) | (F.size("pred_labels") != n)
         | (F.col("pred_grade_probs").isNotNull() & (F.size("pred_grade_probs") != n))),
        ("bad_score", ~F.forall("pred_scores", unit)),
        ("bad_box", ~F.forall("pred_boxes", lambda b: F.forall(b, finite))),
        ("bad_probability", F.col("pred_grade_probs").isNotNull()
         & ~F.forall("pred_grade_probs", lambda p: F.forall(p, unit))),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda v: v.isNotNull())
    return files.select("case_id", F.explode(found).alias("rule"))


def read_detections(spark: SparkSession, path, fmt: str = "json", check: bool = True) -> DataFrame:
    files = read_table(spark, path, S.PREDICTION_FILE, fmt)
    if check:
        assert_none(detection_violations(files), "invalid predictions")
    return explode_detections(files)


def read_gt(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    return explode_gt(read_table(spark, path, S.GT_FILE, fmt))


def explode_gt(files: DataFrame) -> DataFrame:
    rows = files.select("case_id", F.posexplode(F.arrays_zip("boxes", "classes")).alias("pos", "r"))
    return rows.select(
        "case_id", F.col("pos").cast("long").alias("gt_id"), F.col("r.classes").alias("label"), *_six(F.col("r.boxes"))
    )


def explode_instances(files: DataFrame) -> DataFrame:
    """One row per instance out of the id-keyed maps of a case."""
    rows = files.select("*", F.explode(F.map_entries("instances")).alias("e"))
    key = F.col("e.key")
    return rows.select(
        "case_id", key.cast("long").alias("instance_id"), F.col("e.value").alias("class"),
        F.col("grades")[key].alias("grade"), F.col("grade_sources")[key].alias("source"),
        F.coalesce(F.col("grade_supervised")[key], F.lit(False)).alias("supervised"),
    )


def instance_violations(files: DataFrame) -> DataFrame:
    """Cases whose maps do not cover the same ids."""
    ids = F.array_sort(F.map_keys("instances"))
    return files.filter(
        (F.array_sort(F.map_keys("grade_supervised")) != ids)
        | (F.size(F.array_except(F.map_keys("grades"), ids)) > 0)
        | (F.size(F.array_except(F.map_keys("grade_sources"), ids)) > 0)
    ).select("case_id")


def read_instance_labels(spark: SparkSession, path) -> DataFrame:
    files = spark.read.schema(S.INSTANCE_LABELS).option("multiLine", True).json(path)
    assert_none(instance_violations(files), "label maps cover different instances")
    return explode_instances(files)


def list_items(text, separator: str = ","):
    """Split a list column, trim the items and drop blanks."""
    return F.filter(F.transform(F.split(text, separator), lambda v: F.trim(v)), lambda v: v != "")


def explode_marksheet(sheet: DataFrame) -> DataFrame:
    """Case id and one row per listed finding; findings that are not numbers have a null grade."""
    return sheet.select(
        F.concat_ws("_", "patient_id", "study_id").alias("case_id"), "case_ISUP",
        F.posexplode_outer(list_items(F.col("lesion_ISUP"))).alias("position", "entry"),
    ).withColumn("grade", F.col("entry").try_cast("long"))


def read_marksheet(spark: SparkSession, path) -> DataFrame:
    sheet = spark.read.schema(S.MARKSHEET).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    return explode_marksheet(sheet)


def read_splits(spark: SparkSession, path, folds: int = 5) -> DataFrame:
    """Fold JSON ``[{"train": [...], "val": [...]}, ...]`` as rows (fold, role, case_id)."""
    schema = T.StructType([T.StructField("train", T.ArrayType(S.S)), T.StructField("val", T.ArrayType(S.S))])
    text = spark.read.text(path, wholetext=True)
    keys = F.from_json("value", "array<map<string,array<string>>>")
    parsed = text.select(F.from_json("value", T.ArrayType(schema)).alias("folds"), keys.alias("raw"))
    wrong = parsed.filter(
        F.col("raw").isNull() | (F.size("raw") != folds)
        | F.exists("raw", lambda m: F.array_sort(F.map_keys(m)) != F.array(F.lit("train"), F.lit("val")))
    ).select(F.size("raw").alias("folds_found"))
    assert_none(wrong, "fold file must hold exactly the train and val lists of every fold")
    return explode_splits(parsed.select(F.posexplode("folds").alias("fold", "s")))


def read_split_lines(spark: SparkSession, path) -> DataFrame:
    """Fold lists cut into lines ``{"fold": .., "train": [..], "val": [..]}``, for cohorts too long for one document."""
    schema = T.StructType([T.StructField("fold", S.L), T.StructField("train", T.ArrayType(S.S)), T.StructField("val", T.ArrayType(S.S))])
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return explode_splits(lines.select("fold", F.struct("train", "val").alias("s")))


def explode_splits(folds: DataFrame) -> DataFrame:
    roles = F.explode(F.create_map(F.lit("train"), F.col("s.train"), F.lit("val"), F.col("s.val"))).alias("role", "ids")
    return folds.select(F.col("fold").cast("long").alias("fold"), roles).select("fold", "role", F.explode("ids").alias("case_id"))


def read_audit_csv(spark: SparkSession, path) -> DataFrame:
    """Retention audit with its fixed header; any drift in names or types fails the read."""
    return spark.read.schema(S.RETENTION).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def scan_files(spark: SparkSession, path: str, glob: str = "*", with_content: bool = False, from_folders: bool = False) -> DataFrame:
    """Files below ``path`` with the case id and modality their names carry.

    With ``from_folders`` both come from folders named ``case_id=…`` and ``modality=…`` on the way.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(path)
    )
    folder = lambda name: F.regexp_extract("path", rf"/{name}=([^/]+)/", 1)
    if from_folders:
        case, modality = folder("case_id"), F.nullif(folder("modality"), F.lit("")).cast("long")
    else:
        case, modality = case_from_path(F.col("path")), modality_from_path(F.col("path"))
    return files.select("path", "length", case.alias("case_id"), modality.alias("modality"), *(["content"] if with_content else []))


def duplicate_files(files: DataFrame) -> DataFrame:
    return files.groupBy("case_id", "modality").count().filter("count > 1").drop("count")


def merge_folds(frames: dict[int, DataFrame]) -> DataFrame:
    """Union of per-fold outputs with a ``fold`` column."""
    tagged = [df.withColumn("fold", F.lit(fold).cast("long")) for fold, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def flatten_json(df: DataFrame, id_col: str, json_col: str, ddl: str) -> DataFrame:
    """One row per leaf of a JSON column: dotted key and value as text."""
    parsed = T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(ddl)

    def leaves(struct: T.StructType, path: str, key: str):
        for f in struct.fields:
            here, name = f"{path}.{f.name}", f"{key}.{f.name}" if key else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here, name)
            else:
                yield name, F.col(here).cast("string")

    flat = df.select(id_col, F.from_json(json_col, parsed).alias("_j"))
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in leaves(parsed, "_j", "")]
    return flat.select(id_col, F.explode(F.array(*pairs)).alias("kv")).select(id_col, "kv.key", "kv.value")
