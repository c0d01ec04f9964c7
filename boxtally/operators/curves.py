"""Running totals, operating-point curves and readings from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtally.session import cut_lineage

MAX_WINDOW_ROWS = 4_000_000


def exceeds(df: DataFrame, limit: int = MAX_WINDOW_ROWS) -> bool:
    """Whether ``df`` has more than ``limit`` rows: a count with map-side combine, metadata only on plain Parquet."""
    return df.count() > limit


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, str],
    large: bool = False,
    how: str = "sum",
) -> DataFrame:
    """Add ``sums`` (new name -> source column) accumulated in ``order`` within ``keys``.

    ``how`` is ``sum`` or ``max``. With ``large`` no window ever spans more than one range
    partition: rows are range-partitioned by (keys, order), each partition is accumulated on its
    own and combined with the total of the partitions before it. The partition number is fixed by
    writing the placed rows out, so both uses of it agree. The table of partition totals has at
    most (partitions + keys) rows.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    if not large:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[fold(c).over(w).alias(n) for n, c in sums.items()])
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = cut_lineage(spread.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_part").agg(*[fold(c).alias(f"_t_{n}") for n, c in sums.items()])
    shift = totals.select(*keys, "_part", *[fold(f"_t_{n}").over(before).alias(f"_s_{n}") for n in sums])
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[fold(c).over(local).alias(f"_l_{n}") for n, c in sums.items()])
    # null-safe on the keys: a key may be null
    same = [summed[k].eqNullSafe(shift[k]) for k in keys] + [summed["_part"] == shift["_part"]]
    out = summed.join(shift, same)

    def combined(n: str) -> Column:
        here, earlier = F.col(f"_l_{n}"), F.col(f"_s_{n}")
        return F.greatest(here, earlier) if how == "max" else here + F.coalesce(earlier, F.lit(0))

    return out.select(*[summed[c] for c in df.columns], *[combined(n).alias(n) for n in sums])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], alias: str = "n") -> DataFrame:
    """1-based position in a total order within ``keys``; large tables go by range partitions."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(one, keys, order, {alias: "_one"}, large=exceeds(df)).drop("_one")


def tie_grouped_curve(
    events: DataFrame, keys: Sequence[str], values: Sequence[str], score: str = "score", large: bool = False
) -> DataFrame:
    """Running sums of ``values`` by falling score, equal scores moving together.

    Rows shrink to one per distinct score (with map-side combine) before anything is ordered.
    The first point of every key is the origin, at a null score.
    """
    points = events.groupBy(*keys, score).agg(*[F.sum(v).alias(f"_{v}") for v in values]).withColumn("_one", F.lit(1))
    sums = {v: f"_{v}" for v in values} | {"_pos": "_one"}
    curve = running_totals(points, keys, [F.desc(score)], sums, large)
    types = {f.name: f.dataType for f in curve.schema.fields}
    here = F.struct(F.col(score).alias(score), *[F.col(v).alias(v) for v in values])
    origin = F.struct(F.lit(None).cast("double").alias(score), *[F.lit(0).cast(types[v]).alias(v) for v in values])
    # the origin rides along with the first point, so the events are read once
    rows = F.explode(F.when(F.col("_pos") == 1, F.array(origin, here)).otherwise(F.array(here))).alias("r")
    return curve.select(*keys, rows).select(*keys, "r.*")


def _rank(score: str) -> Column:
    """Position along a curve: the origin first, then falling score."""
    return F.coalesce(-F.col(score), F.lit(float("-inf")))


def value_at_budget(
    curve: DataFrame, keys: Sequence[str], x: Column, y: Column | Mapping[str, Column], targets: Sequence[float], score: str = "score"
) -> DataFrame:
    """``y`` of the last point with ``x`` not above each target, without interpolation; 0 if none.

    Several curves over one ``x`` are read in the same pass when ``y`` maps their names to columns;
    the result then has a ``series`` column.
    """
    at = _rank(score)
    series = y if isinstance(y, Mapping) else {"": y}
    cells = [(n, t) for n in series for t in targets]
    read = [
        F.max_by(F.when(x <= t, series[n]), F.when(x <= t, F.struct(x.alias("x"), at.alias("i")))).alias(f"_y{i}")
        for i, (n, t) in enumerate(cells)
    ]
    wide = curve.groupBy(*keys).agg(*read)
    rows = F.array(*[
        F.struct(F.lit(n).alias("series"), F.lit(float(t)).alias("target"), F.coalesce(F.col(f"_y{i}"), F.lit(0.0)).alias("value"))
        for i, (n, t) in enumerate(cells)
    ])
    out = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return out if isinstance(y, Mapping) else out.drop("series")


def interp_at(
    curve: DataFrame, keys: Sequence[str], x: Column, y: Column, targets: Sequence[float], score: str = "score"
) -> DataFrame:
    """Linear interpolation of a curve with non-falling ``x``; clamped outside.

    The last point at or left of a target and the first point right of it are plain aggregates,
    so every target is read in one pass without ordering the curve again.
    """
    at = _rank(score)
    point = F.struct(x.alias("x"), y.alias("y"))
    aggs = []
    for i, t in enumerate(targets):
        aggs.append(F.max_by(point, F.when(x <= t, at)).alias(f"_l{i}"))
        aggs.append(F.min_by(point, F.when(x > t, at)).alias(f"_r{i}"))
    wide = curve.groupBy(*keys).agg(*aggs)

    def value(i: int, t: float) -> Column:
        lo, hi = F.col(f"_l{i}"), F.col(f"_r{i}")
        slope = (hi["y"] - lo["y"]) / (hi["x"] - lo["x"])
        return F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(lo["y"] + slope * (F.lit(t) - lo["x"]))

    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("target"), value(i, t).alias("value")) for i, t in enumerate(targets)
    ])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def interp_first_crossing(
    points: DataFrame, keys: Sequence[str], by: str, other: str, target: float, alias: str = "value"
) -> DataFrame:
    """Read ``other`` where ``by`` first reaches ``target``.

    Points are sorted by (``by``, ``other``). Before the first point its value is taken, beyond
    the last point the last value, on a flat step the left value, else the line between the two.
    """
    w = Window.partitionBy(*keys).orderBy(by, other)
    steps = points.select(
        *keys, F.col(by).alias("b1"), F.col(other).alias("o1"),
        F.lag(by).over(w).alias("b0"), F.lag(other).over(w).alias("o0"), F.row_number().over(w).alias("n"),
    )
    line = F.col("o0") + (F.col("o1") - F.col("o0")) * (F.lit(target) - F.col("b0")) / (F.col("b1") - F.col("b0"))
    here = F.when(F.col("o0").isNull(), F.col("o1")).when(F.col("b1") == F.col("b0"), F.col("o0")).otherwise(line)
    reached = F.when(F.col("b1") >= target, F.col("n"))
    return steps.groupBy(*keys).agg(
        F.coalesce(F.min_by(here, reached), F.max_by("o1", "n")).alias(alias)
    )


def partial_auc(
    points: DataFrame, keys: Sequence[str], x: str, y: str, low: float, high: float, alias: str = "pauc"
) -> DataFrame:
    """Trapezoid area over the points with ``x`` in ``[low, high]``; 0 with fewer than two."""
    w = Window.partitionBy(*keys).orderBy(x, y)
    inside = points.filter(F.col(x).between(low, high)).select(
        *keys, ((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2.0).alias("_a")
    )
    area = inside.groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias(alias))
    every = points.select(*keys).distinct()
    return every.join(area, list(keys), "left").select(*keys, F.coalesce(alias, F.lit(0.0)).alias(alias))


def rank_auroc(
    scored: DataFrame, keys: Sequence[str], score: str, positive: Column, large: bool = False, alias: str = "auroc"
) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; null if one side is empty."""
    flagged = scored.select(
        *keys, F.col(score).alias("_s"), positive.cast("long").alias("_pos"), (~positive).cast("long").alias("_neg")
    )
    per_score = flagged.groupBy(*keys, "_s").agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))
    ranked = running_totals(per_score, keys, [F.asc("_s")], {"below": "n"}, large)
    wins = F.sum(F.col("p") * (F.col("below") - F.col("n") / 2.0))
    pairs = F.sum("p") * F.sum("n")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias(alias))


GROUP_LIMIT = 1000
SALTS = 64


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, with their rank.

    Up to ``GROUP_LIMIT`` Spark prunes each group on the map side. Beyond, groups are first cut to
    their best ``k`` in salted slices, so no task sorts more of a group than the slices can hold.
    """
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
        salted = df.withColumn("_salt", salt).withColumn(rank, F.row_number().over(slices))
        df = salted.filter(F.col(rank) <= k).drop("_salt", rank)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def global_top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def patience(
    df: DataFrame, keys: Sequence[str], step: str, value: str, wait: int
) -> DataFrame:
    """Best value so far, steps since it last improved, and whether ``wait`` has been reached.

    Non-finite values neither improve nor count. An improvement must be strict.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    large = exceeds(df)
    seen = df.withColumn("_v", F.when(finite, F.col(value))).withColumn("_c", finite.cast("long"))
    # rows that share the best value so far form one island, opened by the improvement itself
    best = running_totals(seen, keys, [F.asc(step)], {"best": "_v"}, large, how="max")
    counted = running_totals(best, [*keys, "best"], [F.asc(step)], {"_n": "_c"}, large)
    idle = F.greatest(F.col("_n") - 1, F.lit(0))
    return counted.select(*df.columns, "best", idle.alias("idle_steps"), (idle >= wait).alias("fired"))


def delta_vs_baseline(
    runs: DataFrame, metrics: Sequence[str], config: str, order: str, baseline: str = "baseline"
) -> DataFrame:
    """Every run's metrics minus those of the first baseline run; null where not numeric."""
    numeric = {m: F.col(m).try_cast("double") for m in metrics}
    first = runs.filter(F.col(config) == baseline).agg(
        *[F.min_by(F.struct(c.alias("v")), F.col(order)).alias(f"_b_{m}") for m, c in numeric.items()]
    )
    # the aggregate is a single row by construction, so the product adds no rows
    return runs.join(F.broadcast(first)).select(
        *runs.columns, *[(c - F.col(f"_b_{m}.v")).alias(f"delta_{m}") for m, c in numeric.items()]
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
