"""Sinks: outputs that refuse to overwrite, metric tables and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write a new output; an existing one is an error."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def write_metrics(scalars: DataFrame, path: str, curves: DataFrame | None = None) -> None:
    """Scalar metrics (run, fold, key, value) and curves (run, fold, key, idx, x, y), partitioned by run and fold."""
    scalars.write.mode("errorifexists").partitionBy("run", "fold").parquet(f"{path}/scalars")
    if curves is not None:
        curves.write.mode("errorifexists").partitionBy("run", "fold").parquet(f"{path}/curves")


def metric_table(scalars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run and fold with a fixed list of metric columns."""
    return scalars.groupBy("run", "fold").pivot("key", list(keys)).agg(F.first("value"))


def write_report(scalars: DataFrame, path: str, fields: Sequence[str]) -> None:
    """CSV with a header of run, fold and the given fields, in this order whatever was measured; absent values are empty."""
    metric_table(scalars, fields).select("run", "fold", *fields).write.mode("errorifexists").csv(path, header=True)


def export_overview(overview: DataFrame, path: str) -> None:
    """Case overview as JSON, and as CSV with its lists turned into JSON text."""
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
        for f in overview.schema.fields
    ]
    overview.write.mode("errorifexists").json(f"{path}/json")
    overview.select(*flat).write.mode("errorifexists").csv(f"{path}/csv", header=True)


