"""Sampling of patches, negatives, donors and placements with reproducible draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxtally.functions.values import draw
from boxtally.operators.curves import number_rows


def dense_index(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), alias: str = "idx") -> DataFrame:
    """0-based index in a total order within ``keys``."""
    return number_rows(df, keys, order, "_i").withColumn(alias, F.col("_i") - 1).drop("_i")


def slots(spark: SparkSession, batches: int, batch_size: int) -> DataFrame:
    """One row per (batch, slot)."""
    n = spark.range(batches * batch_size)
    return n.select(F.floor(F.col("id") / batch_size).alias("batch"), (F.col("id") % batch_size).alias("slot"))


def foreground_sampler(
    cases: DataFrame, instances: DataFrame, batches: int, batch_size: int, foreground: float, strata: str | None = None
) -> DataFrame:
    """Batches whose first round(B·(1 − p)) slots are random cases and the rest random instances.

    With ``strata`` every foreground slot first picks a stratum with equal probability and then an
    instance inside it. Draws are with replacement: a slot's draw modulo the stratum size is joined
    to a dense index, so nothing is collected.
    """
    background = int(round(batch_size * (1 - foreground)))
    table = slots(cases.sparkSession, batches, batch_size)
    pick = draw(F.col("batch"), F.col("slot"))
    sized = lambda df, n: df.join(F.broadcast(n))  # n is a one-row count
    bg = table.filter(F.col("slot") < background)
    n_cases = cases.agg(F.count(F.lit(1)).alias("_n"))
    bg = sized(bg, n_cases).withColumn("idx", pick % F.col("_n"))
    bg = bg.join(dense_index(cases.select("case_id"), [F.asc("case_id")]), "idx").select("batch", "slot", "case_id", F.lit(-1).cast("long").alias("instance_id"))
    fg = table.filter(F.col("slot") >= background)
    keys = [strata] if strata else []
    pool = dense_index(instances.select("case_id", "instance_id", *keys), [F.asc("case_id"), F.asc("instance_id")], keys)
    if strata:
        groups = instances.groupBy(strata).agg(F.count(F.lit(1)).alias("_n"))
        groups = dense_index(groups, [F.asc(strata)], alias="_g")
        total = groups.agg(F.count(F.lit(1)).alias("_k"))
        fg = sized(fg, total).withColumn("_g", draw(F.col("slot"), F.col("batch")) % F.col("_k")).join(groups, "_g")
    else:
        fg = sized(fg, instances.agg(F.count(F.lit(1)).alias("_n")))
    fg = fg.withColumn("idx", pick % F.col("_n")).join(pool, [*keys, "idx"]).select("batch", "slot", "case_id", "instance_id")
    return bg.unionByName(fg)


def hard_negative_sample(
    rows: DataFrame, order: Column, per_image: int, positive_fraction: float, pool_size: float, min_neg: int = 0,
    keys: Sequence[str] = ("case_id",), mode: str = "per_image", ratio: float = 1.0,
) -> DataFrame:
    """Positives and hard negatives of every image: rows (keys, det_id, target, score) that were chosen.

    Negatives are drawn from the ``num_neg · pool_size`` best-scored ones. Modes: ``per_image`` caps
    the positives and fills up with negatives, ``balanced`` takes as many negatives as positives,
    ``all_positives`` keeps every positive and ``ratio`` negatives for each. A whole batch is
    sampled by passing batch keys and the batch's total as ``per_image``.
    """
    k = list(keys)
    pos, neg = rows.filter(F.col("target") >= 1), rows.filter(F.col("target") == 0)
    counts = rows.groupBy(*k).agg(
        F.count(F.when(F.col("target") >= 1, 1)).alias("_p"), F.count(F.when(F.col("target") == 0, 1)).alias("_n")
    )
    cap = F.lit(int(per_image * positive_fraction))
    num_pos = F.col("_p") if mode == "all_positives" else F.least(F.col("_p"), cap)
    if mode == "per_image":
        want = F.greatest(F.floor(F.greatest(num_pos, F.lit(1)) * abs(1 - 1.0 / positive_fraction)), F.lit(min_neg))
    elif mode == "balanced":
        want = F.greatest(num_pos, F.lit(1))
    elif mode == "all_positives":
        want = F.greatest(F.floor(F.lit(ratio) * F.col("_p")), F.lit(1))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    num_neg = F.least(F.col("_n"), want)
    quota = counts.select(*k, num_pos.alias("_qp"), num_neg.alias("_qn"), F.floor(num_neg * pool_size).alias("_pool"))
    drawn, best = [F.asc("_o"), F.asc("det_id")], [F.desc("score"), F.asc("det_id")]
    p = number_rows(pos.withColumn("_o", order), k, drawn, "_r").join(quota, k).filter(F.col("_r") <= F.col("_qp"))
    pool = number_rows(neg, k, best, "_b").join(quota, k).filter(F.col("_b") <= F.col("_pool"))
    n = number_rows(pool.withColumn("_o", order), k, drawn, "_r").filter(F.col("_r") <= F.col("_qn"))
    cols = [*k, "det_id", "target", "score"]
    return p.select(*cols).unionByName(n.select(*cols))


def donor_bank(instances: DataFrame, boxes: DataFrame, cases: DataFrame, shape: Sequence[str], margin: int = 4, max_mm: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(donors with their crop window, counts of kept and rejected).

    Donors are supervised instances whose outside distance (p95_mm) is small or undefined; the
    window is the box widened by ``margin`` and clipped to the image.
    """
    ok = F.coalesce("supervised", F.lit(False)) & F.coalesce(F.col("p95_mm") <= max_mm, F.lit(True))
    reason = F.when(~F.coalesce("supervised", F.lit(False)), "unsupervised").when(ok, "kept").otherwise("displaced")
    counts = instances.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    kept = instances.filter(ok).join(boxes, ["case_id", "instance_id"]).join(cases.select("case_id", *shape), "case_id")
    lo = [F.greatest(F.col(f"{a}1") - margin, F.lit(0)).alias(f"{a}1") for a in "xyz"]
    hi = [F.least(F.col(f"{a}2") + margin, F.col(s)).alias(f"{a}2") for a, s in zip("xyz", shape)]
    return kept.select(*instances.columns, *lo, *hi), counts


def zone_of(share: Column) -> Column:
    """pz above one half, tz below, unknown at exactly one half."""
    return F.when(share > 0.5, "pz").when(share < 0.5, "tz")


def donor_draw(requests: DataFrame, donors: DataFrame, pick: Column, mode: str = "prefer") -> DataFrame:
    """One donor per request (request_id, grade, zone), of its grade.

    ``strict`` needs the requested zone, ``prefer`` falls back to any zone, ``off`` ignores zones.
    Requests nothing fits stay without a donor.
    """
    if mode not in ("prefer", "strict", "off"):
        raise ValueError(f"unknown mode {mode!r}")
    d = donors.select("donor_id", "grade", zone_of(F.col("zone_pz_frac")).alias("zone"))
    by_zone = dense_index(d.filter(F.col("zone").isNotNull()), [F.asc("donor_id")], ["grade", "zone"])
    by_grade = dense_index(d.select("donor_id", "grade"), [F.asc("donor_id")], ["grade"])
    nz = by_zone.groupBy("grade", "zone").agg(F.count(F.lit(1)).alias("_nz"))
    ng = by_grade.groupBy("grade").agg(F.count(F.lit(1)).alias("_ng"))
    r = requests.withColumn("_d", pick).join(nz, ["grade", "zone"], "left").join(ng, "grade", "left")
    use_zone = F.col("_nz").isNotNull() if mode != "off" else F.lit(False)
    fall = F.lit(True) if mode != "strict" else F.lit(False)
    a = r.filter(use_zone).withColumn("idx", F.col("_d") % F.col("_nz")).join(by_zone, ["grade", "zone", "idx"]).withColumn("matched_zone", F.lit(True))
    b = r.filter(~use_zone & fall & F.col("_ng").isNotNull()).withColumn("idx", F.col("_d") % F.col("_ng")).join(by_grade, ["grade", "idx"]).withColumn("matched_zone", F.lit(False))
    got = a.select("request_id", "donor_id", "matched_zone").unionByName(b.select("request_id", "donor_id", "matched_zone"))
    return requests.join(got, "request_id", "left")


def valid_centres(centres: DataFrame, size: Sequence[str], patch: Sequence[float]) -> DataFrame:
    """Candidate centres (cx, cy, cz) whose shifted extent fits the patch."""
    out = centres
    for a, s, p in zip("xyz", size, patch):
        low = F.col(f"c{a}") - F.floor(F.col(s) / 2)
        out = out.filter((low >= 0) & (low + F.col(s) <= p))
    return out


def first_accepted(tries: DataFrame, keys: Sequence[str], accept: Column, collides: Column, order: Column, max_tries: int = 8) -> tuple[DataFrame, DataFrame]:
    """(first accepted try per group within ``max_tries``, counts by outcome of the tries made).

    A try fails on the occupancy limits or on a collision; tries after the first success are not made.
    """
    k = list(keys)
    w = Window.partitionBy(*k).orderBy(order)
    ranked = tries.withColumn("try", F.row_number().over(w).cast("long")).filter(F.col("try") <= max_tries)
    outcome = F.when(~accept, "occupancy").when(collides, "collision").otherwise("accepted")
    tagged = ranked.withColumn("outcome", outcome)
    first = tagged.filter("outcome = 'accepted'").groupBy(*k).agg(F.min("try").alias("_first"))
    made = tagged.join(first, k, "left").filter(F.col("_first").isNull() | (F.col("try") <= F.col("_first")))
    chosen = made.filter(F.col("try") == F.col("_first")).drop("_first", "outcome")
    return chosen, made.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


