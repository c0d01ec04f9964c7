"""Gapless numbers for the rows of a table in a given order, without a window over the whole."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.session import cut_lineage

#: Spark's monotonically increasing ids keep the place within a partition in this many low bits.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column] = (), name: str = "n") -> DataFrame:
    """``df`` with the number of each row from 0 on in ``order``, written once; without an order rows are numbered as they come, without a shuffle.

    Rows are cut into ranges and sorted within them; the number is the place in the range plus the sizes of the
    ranges before, of which the driver sees one count a range. Rows that ``order`` does not tell apart come in any
    order and in one range: add a column that tells them apart where they may be many.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    held = cut_lineage(sorted_rows.select("*", F.spark_partition_id().alias("__range"), place.alias("__place")))
    sizes = {r["__range"]: r["count"] for r in held.groupBy("__range").count().collect()}
    if not sizes:
        return held.select(*df.columns, F.col("__place").alias(name))
    ranges = sorted(sizes)
    starts = [0, *accumulate(sizes[r] for r in ranges[:-1])]
    table = df.sparkSession.createDataFrame(list(zip(ranges, starts)), "__range int, __start bigint")
    return held.join(F.broadcast(table), "__range").select(*df.columns, (F.col("__start") + F.col("__place")).alias(name))
