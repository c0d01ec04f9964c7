"""Group-size probes that decide between the one-pass and the multi-round forms of an operator."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oversized_groups(frames: Sequence[DataFrame], keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys whose group exceeds ``limit`` rows in any of ``frames``; None when there are none.

    Costs one map-side-combined count per frame. Groups up to the limit may be folded inside a
    single task; the ones returned here must be handled by an operator that spreads a group over
    many tasks.
    """
    counted = [
        f.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys) for f in frames
    ]
    hot = reduce(DataFrame.unionByName, counted).distinct()
    return None if hot.isEmpty() else hot


def split_by(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows outside ``hot``, rows inside ``hot``)."""
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")
