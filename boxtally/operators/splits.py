"""Folds, holdouts and cohorts. Draws are arithmetic hashes, so they do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.operators.curves import number_rows


def kfold(cases: DataFrame, folds: int, order: Column, id_col: str = "case_id") -> DataFrame:
    """Validation fold of every case: cases are drawn into an order and cut into equal runs."""
    numbered = number_rows(cases.select(id_col).distinct().withColumn("_o", order), [], [F.asc("_o"), F.asc(id_col)], "_n")
    total = numbered.agg(F.count(F.lit(1)).alias("_t"))
    fold = F.floor((F.col("_n") - 1) * folds / F.col("_t")).cast("long")
    return numbered.join(F.broadcast(total)).select(id_col, fold.alias("fold"))


def group_kfold(cases: DataFrame, folds: int, order: Column, group: str = "patient_id") -> DataFrame:
    """Fold of every group, balanced on group size: largest first, dealt out in snake order."""
    sizes = cases.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_o", order)
    numbered = number_rows(sizes, [], [F.desc("size"), F.asc("_o"), F.asc(group)], "_n")
    lap, place = F.floor((F.col("_n") - 1) / folds), (F.col("_n") - 1) % folds
    fold = F.when(lap % 2 == 0, place).otherwise(folds - 1 - place)
    return numbered.select(group, "size", fold.cast("long").alias("fold"))


def fold_roles(assigned: DataFrame, folds: int) -> DataFrame:
    """Expand a fold per case into train and val roles of every fold."""
    rows = assigned.withColumn("_f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    role = F.when(F.col("fold") == F.col("_f"), "val").otherwise("train")
    return rows.select(*[c for c in assigned.columns if c != "fold"], F.col("_f").alias("fold"), role.alias("role"))


def leave_subset_out(subsets: DataFrame, n: int, separate_test: bool = True) -> DataFrame:
    """Roles of every fold: test = subset i and val = subset i + 1 (mod n), or val = subset i alone."""
    rows = subsets.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    s, f = F.col("subset"), F.col("fold")
    if separate_test:
        role = F.when(s == f, "test").when(s == (f + 1) % n, "val").otherwise("train")
    else:
        role = F.when(s == f, "val").otherwise("train")
    return rows.withColumn("role", role)


def holdout(cases: DataFrame, share: float, order: Column, id_col: str = "case_id") -> DataFrame:
    """Exactly ⌈share · n⌉ cases as test, the first in a drawn order."""
    numbered = number_rows(cases.select(id_col).distinct().withColumn("_o", order), [], [F.asc("_o"), F.asc(id_col)], "_n")
    total = numbered.agg(F.count(F.lit(1)).alias("_t"))
    role = F.when(F.col("_n") <= F.ceil(F.col("_t") * share), "test").otherwise("train")
    return numbered.join(F.broadcast(total)).select(id_col, role.alias("role"))


def stratified_group_split(instances: DataFrame, order: Column, shares: Sequence[tuple[str, float]] = (("train", 0.7), ("val", 0.15), ("test", 0.15))) -> DataFrame:
    """Patient-disjoint roles that hold every grade's share.

    A patient belongs to the stratum of its rarest grade; patients are ordered by draw inside the
    stratum and cut by cumulative share.
    """
    s = instances.filter("supervised")
    counts = s.groupBy("grade").agg(F.count(F.lit(1)).alias("_c"))
    rarest = s.join(F.broadcast(counts), "grade").groupBy("patient_id").agg(F.min_by("grade", F.struct("_c", "grade")).alias("stratum"))
    numbered = number_rows(rarest.withColumn("_o", order), ["stratum"], [F.asc("_o"), F.asc("patient_id")], "_n")
    sizes = rarest.groupBy("stratum").agg(F.count(F.lit(1)).alias("_t"))
    at = (F.col("_n") - 0.5) / F.col("_t")
    role, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        role = F.when(at <= edge, name) if role is None else role.when(at <= edge, name)
    return numbered.join(F.broadcast(sizes), "stratum").select("patient_id", "stratum", role.otherwise(shares[-1][0]).alias("role"))


def missing_role_grades(split: DataFrame, instances: DataFrame, grades: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """(role, grade) combinations that hold no supervised lesion."""
    have = instances.filter("supervised").join(split, "patient_id").select("role", F.col("grade").cast("long").alias("grade")).distinct()
    need = F.explode(F.array(*[F.lit(g).cast("long") for g in grades])).alias("grade")
    return split.select("role").distinct().select("role", need).join(have, ["role", "grade"], "left_anti")


def assign_roles(rows: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their role, violations): patients without a role or with several are violations."""
    per = split.groupBy("patient_id").agg(F.min("role").alias("role"), F.countDistinct("role").alias("_r"))
    j = rows.join(per, "patient_id", "left")
    bad = j.filter(F.coalesce("_r", F.lit(0)) != 1).select(
        "patient_id", F.when(F.col("_r").isNull(), "no_role").otherwise("several_roles").alias("rule")
    ).distinct()
    return j.filter("_r = 1").drop("_r"), bad


def tiny_cohort(cases: DataFrame, instances: DataFrame, grades: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    """One case per grade (pure cases first, then by id), one ungraded positive and one benign, all of distinct patients.

    Every slot is one small top-1 query that excludes the patients already used, so only single
    rows come to the driver and the number of steps is fixed.
    """
    per = instances.groupBy("case_id").agg(
        F.collect_set(F.when(F.col("supervised"), F.col("grade"))).alias("grades"), F.count(F.lit(1)).alias("n")
    )
    known = cases.select("case_id", "patient_id").join(per, "case_id", "left")
    known = known.withColumn("grades", F.coalesce("grades", F.array().cast("array<bigint>"))).withColumn("n", F.coalesce("n", F.lit(0)))
    slots = [(f"grade{g}", F.array_contains("grades", F.lit(g).cast("long")), F.size("grades") != 1) for g in grades]
    slots.append(("unsupervised", (F.size("grades") == 0) & (F.col("n") > 0), F.lit(False)))
    slots.append(("benign", F.col("n") == 0, F.lit(False)))
    used, chosen = [], []
    for slot, fits, mixed in slots:
        free = known.filter(fits & ~F.col("patient_id").isin(used) if used else fits)
        row = free.orderBy(mixed, "case_id").select("case_id", "patient_id").first()
        if row is None:
            raise ValueError(f"no case of a further patient for {slot}")
        used.append(row["patient_id"])
        chosen.append((slot, row["case_id"], row["patient_id"]))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    return cases.sparkSession.createDataFrame(chosen, f"slot string, case_id {kinds['case_id']}, patient_id {kinds['patient_id']}")


def one_per_grade(instances: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first supervised instance of every grade."""
    w = Window.partitionBy("grade").orderBy(*order)
    return instances.filter("supervised").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


