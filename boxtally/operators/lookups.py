"""Equi, semi and anti joins that attach labels, sources and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grade_labels(instances: DataFrame, audit: DataFrame, prior: DataFrame) -> DataFrame:
    """Grade and its source for every instance (case_id, instance_id, class).

    Expert classes 1..4 give grade class + 1. Class 0 takes the audit result of its case; without
    an audit row it keeps an earlier expert grade if that is valid. Other classes are an error.
    """
    a = audit.select("case_id", F.col("grade").alias("_ag"), F.col("supervised").alias("_as"), F.lit(True).alias("_audited"))
    p = prior.select("case_id", "instance_id", F.col("grade").alias("_pg"), F.col("source").alias("_ps"))
    j = instances.join(a, "case_id", "left").join(p, ["case_id", "instance_id"], "left")
    expert = F.col("class").between(1, 4)
    from_audit = (F.col("class") == 0) & F.coalesce("_as", F.lit(False))
    from_prior = (F.col("class") == 0) & F.col("_audited").isNull() & F.col("_pg").between(2, 5) & (F.col("_ps") == "human_expert_mask")
    bad = ~F.coalesce(F.col("class").between(0, 4), F.lit(False))
    grade = (
        F.when(bad, F.raise_error(F.concat(F.lit("unexpected instance class "), F.col("class").cast("string"))).cast("long"))
        .when(expert, F.col("class") + 1).when(from_audit, F.col("_ag")).when(from_prior, F.col("_pg"))
    )
    source = F.when(expert, "human_expert_mask").when(from_audit, "audit_unifocal").when(from_prior, F.col("_ps"))
    return j.select("case_id", "instance_id", "class", grade.alias("grade"), source.alias("source")).withColumn(
        "supervised", F.col("grade").isNotNull()
    )


def source_fallback(wanted: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """For every wanted key the row of the first source that has it; ``source_rank`` 0, 1, … or null if none."""
    k = list(keys)
    tagged = [s.withColumn("source_rank", F.lit(i).cast("long")) for i, s in enumerate(sources)]
    pool = tagged[0]
    for t in tagged[1:]:
        pool = pool.unionByName(t)
    first = Window.partitionBy(*k).orderBy("source_rank")
    chosen = pool.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return wanted.select(*k).distinct().join(chosen, k, "left")


def missing_sources(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("source_rank").isNull())


def finding_join(findings: DataFrame, masks: DataFrame, keys: Sequence[str], keep_unmatched: bool = False) -> DataFrame:
    """Attach findings to masks by key; findings without a mask are dropped unless kept on request."""
    return findings.join(masks, list(keys), "left" if keep_unmatched else "inner")


def cohort_donors(donors: DataFrame, cohort: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) donors by whether their case or patient is in the training cohort."""
    patients = cohort.select("patient_id").distinct()
    return donors.join(patients, "patient_id", "left_semi"), donors.join(patients, "patient_id", "left_anti")


def exclude_cases(splits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Fold lists without the excluded cases."""
    return splits.join(excluded.select("case_id").distinct(), "case_id", "left_anti")


def unfinished(wanted: DataFrame, finished: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cases still to do: wanted minus those present in every finished output."""
    return wanted.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def instance_classes(voxels: DataFrame, mapping: DataFrame, background: bool = False) -> DataFrame:
    """Voxel instance id to class (+1 when background is class 0); unknown ids give null."""
    shift = 1 if background else 0
    m = mapping.select("case_id", "instance_id", (F.col("class") + shift).alias("class"))
    return voxels.join(m, ["case_id", "instance_id"], "left")


def remap_classes(label: Column, mapping: dict[int, int], dropped: Sequence[int] = (), fill: int = -1) -> Column:
    """Class ids under a mapping that applies to all at once, so that two classes can change places.

    Dropped classes become ``fill``; classes the mapping doesn't name stay.
    """
    new = F.coalesce(F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[label], label) if mapping else label
    return F.when(label.isin(list(dropped)), F.lit(fill)).otherwise(new) if dropped else new


def collapsed_classes(mapping: dict[int, int]) -> int:
    """How many classes of a mapping share their target with another one."""
    return len(mapping) - len(set(mapping.values()))
