"""Exact quantiles of groups of any size.

Values become counts per distinct value, cut into ranges by group and value. The totals of the ranges tell which range
holds a wanted rank, so only those ranges are summed up value by value, and each rank is read where the running count
passes it. No task holds more than a range, and many groups and quantiles are found in one go.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.session import cut_lineage


def _renamed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]


def _same(keys: Sequence[str]) -> list[Column]:
    """The keys equal the renamed ones, where a null is a key like any other."""
    return [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, quantiles: Sequence[float], name: str = "q", few: bool = False) -> DataFrame:
    """(keys, ``name``): an array with the interpolated ``quantiles`` of every group that has a value.

    Equals ``percentile``: nulls don't count, NaN is above all numbers. Without keys there is one row, or none.
    ``few`` says that the number of groups is bounded, so that the wanted ranks may be broadcast.
    """
    v = F.col(value) if isinstance(value, str) else value
    own = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    counted = rows.select(*own, v.cast("double").alias("_v")).filter("_v is not null").groupBy(*own, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = cut_lineage(counted.repartitionByRange(*own, "_v").withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*own)
    before = F.coalesce(F.sum("_t").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy(*own, "_part").agg(F.sum("_c").alias("_t")).select(*own, "_part", "_t", before.alias("_before"), F.sum("_t").over(group).alias("_n"))
    wanted = []
    for i, q in enumerate(quantiles):
        at = (F.col("_n") - 1) * F.lit(float(q))
        wanted += [F.struct(F.lit(i).alias("i"), f(at).cast("long").alias("rank"), F.lit(upper).alias("upper"), at.alias("at")) for upper, f in ((False, F.floor), (True, F.ceil))]
    here = F.filter(F.array(*wanted), lambda w: (w.rank >= F.col("_before")) & (w.rank < F.col("_before") + F.col("_t")))
    asked = parts.select(*_renamed(own), F.col("_part").alias("_at_part"), "_before", here.alias("_asked")).filter(F.size("_asked") > 0)
    # compressed, a table of values looks small enough to be broadcast and is not
    asked = F.broadcast(asked) if few or not keys else asked.hint("merge")
    near = placed.join(asked, [*_same(own), F.col("_part") == F.col("_at_part")])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*own, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    summed = near.select(*own, "_v", "_c", "_asked", upto.alias("_upto"))
    read = summed.select(*own, "_v", F.explode(F.filter("_asked", lambda w: (w.rank < F.col("_upto")) & (w.rank >= F.col("_upto") - F.col("_c")))).alias("w"))
    ends = read.groupBy(*own, "w.i").agg(
        F.max(F.when(~F.col("w.upper"), F.col("_v"))).alias("lo"), F.max(F.when(F.col("w.upper"), F.col("_v"))).alias("hi"), F.max("w.at").alias("at")
    )
    between = (F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi")
    one = ends.select(*own, "i", F.when(F.floor("at") == F.ceil("at"), F.col("lo")).otherwise(between).alias("x"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x)
    return one.groupBy(*own).agg(sorted_.alias(name)).select(*keys, name)


def with_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], value: Column | str, quantiles: Mapping[str, float]) -> DataFrame:
    """``stats``, which has a row for each group, with a column for each of the named quantiles; null where a group has no value."""
    q = exact_quantiles(df, keys, value, list(quantiles.values()), "_q").select(*_renamed(keys), "_q")
    joined = stats.join(q.hint("merge"), _same(keys), "left") if keys else stats.join(F.broadcast(q), how="left")  # one row
    return joined.select(*stats.columns, *[F.col("_q")[i].alias(n) for i, n in enumerate(quantiles)])


def column_quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """One row with a column for each of ``wanted``, a quantile of a column over all rows."""
    entries = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, (c, _) in wanted.items()]
    levels = sorted({q for _, q in wanted.values()})
    q = exact_quantiles(df.select(F.explode(F.array(*entries)).alias("e")).select("e.*"), ["name"], "v", levels, few=True)
    return q.agg(*[F.max(F.when(F.col("name") == n, F.col("q")[levels.index(p)])).alias(n) for n, (_, p) in wanted.items()])
