"""Data quality checks, audits and release gates.

A check returns a table of violations (or of verdicts); ``sources.readers.assert_none`` turns a
violations table into an error. Every rule is a filter, an anti join or an outer join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.operators.curves import number_rows, union_all
from boxtally.operators.order_stats import column_quantiles, with_quantiles
from boxtally.session import cut_lineage

GRADES = (2, 3, 4, 5)
STAGES = ("source", "resampled", "inplane", "final")


def rule_violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row (keys, rule) per broken rule; a rule is the condition of being wrong."""
    found = F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]), lambda v: v.isNotNull())
    return df.select(*keys, F.explode(found).alias("rule"))


def noncontiguous_ids(df: DataFrame, keys: Sequence[str], id_col: str, first: int = 0) -> DataFrame:
    """Groups whose ids are not exactly first, first + 1, … without gaps or repeats."""
    agg = df.groupBy(*keys).agg(
        F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.count(id_col).alias("n"), F.countDistinct(id_col).alias("d")
    )
    return agg.filter((F.col("lo") != first) | (F.col("hi") - first + 1 != F.col("n")) | (F.col("d") != F.col("n"))).select(*keys, "lo", "hi", "n")


def check_dataset_info(info: DataFrame) -> DataFrame:
    """Dataset descriptions (name, task, dim, labels and modalities as id → name maps, target_class)."""
    contiguous = lambda m: F.array_sort(F.transform(F.map_keys(m), lambda k: k.try_cast("int"))) == F.sequence(F.lit(0), F.size(m) - 1)
    missing = lambda c: F.col(c).isNull()
    return rule_violations(info, ["name"], {
        "missing_task": missing("task"), "bad_dim": missing("dim") | ~F.col("dim").isin(2, 3),
        "missing_labels": missing("labels") | (F.size("labels") < 1),
        "labels_not_contiguous": (F.size("labels") >= 1) & ~F.coalesce(contiguous("labels"), F.lit(False)),
        "missing_modalities": missing("modalities") | (F.size("modalities") < 1),
        "modalities_not_contiguous": (F.size("modalities") >= 1) & ~F.coalesce(contiguous("modalities"), F.lit(False)),
        "unknown_target_class": F.col("target_class").isNotNull()
        & ~F.coalesce(F.map_contains_key("labels", F.col("target_class").cast("string")), F.lit(False)),
    })


def check_instances(mask_ids: DataFrame, metadata: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Mask ids must equal metadata ids, count from 1 without gaps, and have a declared class."""
    m = mask_ids.select("case_id", "instance_id").distinct().withColumn("_m", F.lit(True))
    j = m.join(metadata.select("case_id", "instance_id", "class"), ["case_id", "instance_id"], "full")
    rows = rule_violations(j, ["case_id", "instance_id"], {
        "not_in_metadata": F.col("class").isNull(), "not_in_mask": F.col("_m").isNull(),
        "undeclared_class": ~F.col("class").isin(list(classes)),
    })
    gaps = noncontiguous_ids(metadata, ["case_id"], "instance_id", 1)
    return rows.unionByName(gaps.select("case_id", F.lit(None).cast("long").alias("instance_id"), F.lit("ids_not_contiguous").alias("rule")))


def check_geometry(images: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Images of a case (case_id, image, size, spacing, origin, direction) against its first image."""
    first = images.groupBy("case_id").agg(F.min_by(F.struct("size", "spacing", "origin", "direction"), "image").alias("f"))
    far = lambda c: F.coalesce(
        (F.size(c) != F.size(f"f.{c}")) | F.exists(F.zip_with(c, f"f.{c}", lambda a, b: F.coalesce(F.abs(a - b), F.lit(1e308))), lambda d: d > tolerance),
        F.lit(True),
    )
    return rule_violations(images.join(first, "case_id"), ["case_id", "image"], {
        "size": ~F.col("size").eqNullSafe(F.col("f.size")), "spacing": far("spacing"), "origin": far("origin"), "direction": far("direction"),
    })


def check_splits(splits: DataFrame, cohort: DataFrame) -> DataFrame:
    """Fold lists (fold, role, case_id, patient_id): rule, fold and the offending id.

    No overlap of roles by case or patient, every fold covers the cohort exactly, and each case
    and patient is validated exactly once overall.
    """
    out = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), F.col("fold").cast("long").alias("fold"), F.col(key).cast("string").alias("id"))
    overlap = splits.groupBy("fold", "case_id").agg(F.countDistinct("role").alias("n")).filter("n > 1")
    leak = splits.groupBy("fold", "patient_id").agg(F.countDistinct("role").alias("n")).filter("n > 1")
    repeated = splits.groupBy("fold", "role", "case_id").count().filter("count > 1")
    folds = splits.select("fold").distinct()
    want = cohort.select("case_id").distinct().join(F.broadcast(folds))  # folds are a handful of rows
    have = splits.select("fold", "case_id").distinct()
    missing = want.join(have, ["fold", "case_id"], "left_anti")
    extra = have.join(cohort.select("case_id"), "case_id", "left_anti")
    val = splits.filter("role = 'val'")
    times = val.groupBy("case_id").agg(F.countDistinct("fold").alias("n"))
    once = cohort.select("case_id").distinct().join(times, "case_id", "left").filter(F.coalesce("n", F.lit(0)) != 1).withColumn("fold", F.lit(None))
    patient_folds = val.groupBy("patient_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").withColumn("fold", F.lit(None))
    return union_all([
        out(overlap, "case_in_both_roles", "case_id"), out(leak, "patient_in_both_roles", "patient_id"),
        out(repeated, "case_repeated", "case_id"), out(missing, "case_missing", "case_id"), out(extra, "case_unknown", "case_id"),
        out(once, "case_not_validated_once", "case_id"), out(patient_folds, "patient_validated_twice", "patient_id"),
    ])


def check_fold_grades(splits: DataFrame, instances: DataFrame, required: Sequence[int] = GRADES) -> DataFrame:
    """Validation folds that lack a required grade."""
    need = F.explode(F.array(*[F.lit(g).cast("long") for g in required])).alias("grade")
    want = splits.filter("role = 'val'").select("fold").distinct().select("fold", need)
    have = splits.filter("role = 'val'").select("fold", "case_id").join(
        instances.filter("supervised").select("case_id", F.col("grade").cast("long").alias("grade")), "case_id"
    )
    return want.join(have.select("fold", "grade").distinct(), ["fold", "grade"], "left_anti")


def check_supervision(instances: DataFrame) -> DataFrame:
    """Supervised instances need a grade 2..5 and a source, others no grade; the class must be 0."""
    s = F.coalesce("supervised", F.lit(False))
    return rule_violations(instances, ["case_id", "instance_id"], {
        "supervised_without_grade": s & ~F.coalesce(F.col("grade").between(2, 5), F.lit(False)),
        "supervised_without_source": s & F.col("source").isNull(),
        "unsupervised_with_grade": ~s & F.col("grade").isNotNull(),
        "class_not_zero": ~F.coalesce(F.col("class") == 0, F.lit(False)),
    })


def symmetric_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Keys in only one of two tables, with the name of the table that has them."""
    k = list(keys)
    left, right = a.select(*k).distinct(), b.select(*k).distinct()
    return left.join(right, k, "left_anti").withColumn("only_in", F.lit(names[0])).unionByName(
        right.join(left, k, "left_anti").withColumn("only_in", F.lit(names[1]))
    )


def check_positives(marksheet: DataFrame, audited: DataFrame, data: DataFrame, excluded: DataFrame, instances: DataFrame) -> DataFrame:
    """Marksheet positives (grade ≥ 2) = audited positives; each is in the data or excluded, and has an instance."""
    positives = marksheet.filter(F.col("case_ISUP") >= 2).select("case_id").distinct()
    diff = symmetric_difference(positives, audited, ["case_id"], ("marksheet_only", "audit_only"))
    lost = positives.join(data, "case_id", "left_anti").join(excluded, "case_id", "left_anti")
    both = positives.join(data, "case_id", "left_semi").join(excluded, "case_id", "left_semi")
    empty = positives.join(data, "case_id", "left_semi").join(instances, "case_id", "left_anti")
    tag = lambda df, rule: df.select("case_id", F.lit(rule).alias("rule"))
    return union_all([
        diff.select("case_id", F.col("only_in").alias("rule")), tag(lost, "neither_kept_nor_excluded"),
        tag(both, "kept_and_excluded"), tag(empty, "positive_without_instance"),
    ])


def retention_records(stages: DataFrame) -> DataFrame:
    """Status of every case from its voxel and component counts per stage; the first true rule wins."""
    v = lambda s: F.col(f"{s}_voxels")
    c = lambda s: F.col(f"{s}_components")
    shrinks = lambda m: (m("inplane") < m("resampled")) | (m("final") < m("inplane"))
    status = (
        F.when(v("source") == 0, "negative").when(v("final") == 0, "excluded_no_retained_voxels")
        .when(shrinks(v) | shrinks(c), "partially_clipped").otherwise("fully_retained")
    )
    out = stages.withColumn("status", status)
    reason = F.when(F.col("status") == "excluded_no_retained_voxels", "gland_centred_crop_retained_no_lesion_voxels").otherwise("")
    return out.withColumn("exclusion_reason", reason)


def retention_exclusions(records: DataFrame) -> DataFrame:
    return records.filter(F.col("status") == "excluded_no_retained_voxels").select("case_id", "exclusion_reason")


def check_retention(audit: DataFrame, manifest: DataFrame, data: DataFrame, splits: DataFrame) -> DataFrame:
    """The retention audit against itself, the manifest, the kept data and the folds.

    A case is one row of counts, made in one pass over the four tables, and its broken rules are read from them. Each
    of its audit rows is held against every status that its own counts give; a null case equals no other.
    """
    known = ["negative", "excluded_no_retained_voxels", "partially_clipped", "fully_retained"]
    own = retention_records(audit.select("case_id", F.col("status").alias("_given"), *[f"{s}_{m}" for s in STAGES for m in ("voxels", "components")]))
    bits = {n: 1 << i for i, n in enumerate(["audit", "manifest", "data", "splits", *known])}
    right = F.lit(bits["audit"])
    for s in known:
        right = right + F.when(F.col("status") == s, bits[s]).otherwise(0)
    seen = own.select("case_id", "_given", right.alias("_seen"))
    for name, df in (("manifest", manifest), ("data", data), ("splits", splits)):
        seen = seen.unionByName(df.select("case_id", F.lit(None).cast("string").alias("_given"), F.lit(bits[name]).alias("_seen")))
    per = seen.groupBy("case_id").agg(
        F.bit_or("_seen").alias("_seen"), F.count(F.when(F.col("_seen").bitwiseAND(bits["audit"]) > 0, 1)).alias("_n"),
        F.count(F.when(~F.col("_given").isin(known), 1)).alias("_odd"), *[F.count(F.when(F.col("_given") == s, 1)).alias(f"_{s}") for s in known],
    )
    has = lambda name: F.col("_seen").bitwiseAND(bits[name]) > 0
    met = lambda name: has(name) & F.col("case_id").isNotNull()
    once = lambda rule: F.when(rule, 1).otherwise(0)
    owns = sum([once(has(s)) for s in known[1:]], once(has(known[0])))
    off = sum([F.col(f"_{s}") * (owns - once(has(s))) for s in known[1:]], F.col(f"_{known[0]}") * (owns - once(has(known[0]))))
    paired = lambda n: F.when(F.col("case_id").isNotNull(), n).otherwise(0)
    gone, kept = F.col("_excluded_no_retained_voxels") > 0, F.col("_partially_clipped") + F.col("_fully_retained") > 0
    counts = {
        "duplicate_case": once(F.col("_n") > 1), "unknown_status": paired(F.col("_odd") * owns), "status_disagrees": paired(off),
        "not_in_manifest": once(has("audit") & ~met("manifest")), "not_in_audit": once(has("manifest") & ~met("audit")),
        "excluded_but_in_data": once(gone & met("data")), "excluded_but_in_folds": once(gone & met("splits")), "retained_but_missing": once(kept & ~met("data")),
    }
    broken = F.filter(F.array(*[F.struct(F.lit(r).alias("rule"), n.cast("long").alias("n")) for r, n in counts.items()]), lambda c: c.n > 0)
    rows = per.select("case_id", F.explode(broken).alias("c")).select("case_id", "c.rule", "c.n")
    # a case that is repeated very often is written in blocks
    block = 4096
    blocks = rows.select("case_id", "rule", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("i"))
    times = F.least(F.lit(block).cast("long"), F.col("n") - F.col("i") * block).cast("int")
    return blocks.select("case_id", F.explode(F.array_repeat("rule", times)).alias("rule"))


def homogeneity_audit(entries: DataFrame, components: DataFrame) -> DataFrame:
    """Per case: whether its valid listed grades agree; the grade is kept only when they do."""
    valid = F.collect_set(F.when(F.col("grade").between(2, 5), F.col("grade")))
    per = entries.groupBy("case_id").agg(valid.alias("g"))
    n = F.size("g")
    status = F.when(n == 0, "no_valid_grade").when(n > 1, "heterogeneous").otherwise("homogeneous")
    return per.join(components, "case_id", "left").select(
        "case_id", status.alias("status"), F.when(n == 1, F.col("g")[0]).alias("grade"),
        F.coalesce("num_components", F.lit(0)).cast("long").alias("num_components"), (n == 1).alias("supervised"),
    )


def homogeneity_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("cases"), F.sum("num_components").alias("components"))


def grade_coverage(instances: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Totals of the grade metadata next to the expected counts."""
    s = F.coalesce("supervised", F.lit(False))
    agg = instances.agg(
        F.count(F.lit(1)).alias("instances"), F.count(F.when(s, 1)).alias("supervised"), F.countDistinct("case_id").alias("cases")
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(k).alias("item"), F.col(k).alias("found"), F.lit(v).cast("long").alias("expected")) for k, v in expected.items()
    ])).alias("r")
    return agg.select(rows).select("r.*").withColumn("ok", F.col("found") == F.col("expected"))


def file_manifest(files: DataFrame) -> DataFrame:
    """Size and SHA-256 of every file (path, length, content)."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def id_fingerprint(df: DataFrame, keys: Sequence[str], id_col: str, buckets: int = 1024) -> DataFrame:
    """Order-free fingerprint of the ids of every group.

    Hashing all sorted ids as one string would gather a group in one task. Ids are hashed in
    buckets (sorted inside), and the group hash is taken over the fixed number of bucket hashes.
    """
    bucket = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(buckets)).alias("_b")
    part = df.groupBy(*keys, bucket).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(id_col).cast("string"))), "\n"), 256).alias("_h"), F.count(F.lit(1)).alias("_n")
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda s: F.concat_ws(":", s["_b"], s["_h"]))
    return part.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def list_hash(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """SHA-256 of the sorted ids joined by newlines, for groups of bounded size such as a fold list."""
    text = F.array_join(F.array_sort(F.collect_list(F.col(id_col).cast("string"))), "\n")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sha2(text, 256).alias("sha256"))


def manifest_diff(stored: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Entries added, removed or changed since a manifest was stored."""
    j = stored.select(key, F.col(value).alias("_a")).join(current.select(key, F.col(value).alias("_b")), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def store_drift(canonical: DataFrame, stores: Mapping[str, DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per store: rows missing, rows unknown to the canonical table, and rows whose values differ."""
    k = list(keys)
    parts = []
    for name, store in stores.items():
        a = canonical.select(*k, F.struct(*values).alias("_a"))
        b = store.select(*k, F.struct(*values).alias("_b"))
        j = a.join(b, k, "full")
        gone, extra = F.col("_b").isNull(), F.col("_a").isNull()
        parts.append(j.agg(
            F.count(F.when(gone, 1)).alias("missing"), F.count(F.when(extra, 1)).alias("unknown"),
            F.count(F.when(~gone & ~extra & ~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("differing"),
        ).withColumn("store", F.lit(name)))
    return union_all(parts).select("store", "missing", "unknown", "differing")


def repair_store(canonical: DataFrame, store: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The store with its values overwritten from the canonical table where that knows the row."""
    fresh = canonical.select(*keys, F.struct(*values).alias("_c"))
    j = store.join(fresh, list(keys), "left")
    return j.select(*[
        F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in store.columns
    ])


def unit_class_audit(values: DataFrame, keys: Sequence[str], value: str, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Distribution per group and the one unit range its median falls in, else ``unrecognized``."""
    ends = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    agg = with_quantiles(ends, values, keys, value, {"p1": 0.01, "median": 0.5, "p99": 0.99})
    hits = F.filter(F.array(*[F.when(F.col("median").between(lo, hi), F.lit(u)) for u, (lo, hi) in ranges.items()]), lambda v: v.isNotNull())
    return agg.select(*keys, "n", "min", "p1", "median", "p99", "max", F.when(F.size(hits) == 1, hits[0]).otherwise("unrecognized").alias("unit"))


def mixed_units(audit: DataFrame, expected: str) -> DataFrame:
    return audit.filter(F.col("unit") != expected)


def distribution(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    ends = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return with_quantiles(ends, df, keys, value, {"median": 0.5, "p05": 0.05}).select(*keys, "n", "min", "median", "p05", "max")


def containment_gate(cases: DataFrame, min_each: float = 0.5, min_median: float = 0.9, max_distance: float = 2.0) -> DataFrame:
    """Verdict over lesion-bearing cases (containment, p95_mm).

    A case is left out when it is contained by less than ``min_each`` and displaced by more than
    ``max_distance`` mm; the rest must have a median and a minimum at the limits or above.
    """
    # read twice below, for the ends and for the quantiles
    cases = cut_lineage(cases.select("containment", "p95_mm"))
    out = (F.col("containment") < min_each) & F.coalesce(F.col("p95_mm") > max_distance, F.lit(False))
    kept = F.when(~out, F.col("containment"))
    ends = cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(out, 1)).alias("excluded"), F.count(kept).alias("gated"), F.min(kept).alias("min"), F.max(kept).alias("max")
    )
    agg = with_quantiles(ends, cases, [], kept, {"median": 0.5, "p05": 0.05}).select("cases", "excluded", "gated", "min", "median", "p05", "max")
    return agg.withColumn("passed", (F.col("median") >= min_median) & (F.col("min") >= min_each))


def containment_tail(cases: DataFrame, limit: float = 0.5) -> DataFrame:
    """Cases below the limit or at or below the 5th percentile."""
    p = column_quantiles(cases, {"_p": (F.col("containment"), 0.05)})
    return cases.join(F.broadcast(p)).filter((F.col("containment") < limit) | (F.col("containment") <= F.col("_p"))).drop("_p")


def yield_sweep(donors: DataFrame, distance_bars: Sequence[float], containment_bars: Sequence[float]) -> DataFrame:
    """Donors per grade left at each distance and containment bar; a null grade is the total."""
    bars = [(f"distance<={d}", F.coalesce(F.col("p95_mm") <= d, F.lit(True))) for d in distance_bars]
    bars += [(f"containment>={c}", F.col("containment") >= c) for c in containment_bars]
    counts = donors.rollup("grade").agg(*[F.count(F.when(cond, 1)).alias(f"_b{i}") for i, (_, cond) in enumerate(bars)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("bar"), F.col(f"_b{i}").alias("n")) for i, (n, _) in enumerate(bars)])).alias("r")
    return counts.select("grade", rows).select("grade", "r.bar", "r.n")


def completeness(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return symmetric_difference(expected, found, keys, ("missing", "unexpected"))


def partial_outputs(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Missing secondary outputs, if at least one exists: none at all is allowed, some is not."""
    k = list(keys)
    some = secondary.select(F.lit(True).alias("_some")).limit(1)
    return primary.join(secondary, k, "left_anti").join(F.broadcast(some)).drop("_some")


def scan_log(lines: DataFrame, column: str = "value", benign: Sequence[str] = (), width: int = 200) -> DataFrame:
    """Log lines that report an error, shortened, without the benign patterns."""
    bad = F.col(column).rlike(r"(?i)traceback|error")
    for pattern in benign:
        bad = bad & ~F.col(column).rlike(pattern)
    return lines.filter(bad).withColumn(column, F.substring(column, 1, width))


def config_lock(resolved: DataFrame, locked: DataFrame, keys: Sequence[str] = ("arm", "key")) -> DataFrame:
    """Locked settings that the resolved configuration lacks or contradicts."""
    j = locked.select(*keys, F.col("value").alias("expected")).join(resolved.select(*keys, F.col("value").alias("actual")), list(keys), "left")
    return j.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def metric_floor(metrics: DataFrame, pattern: str, floor: float, run: str = "run") -> DataFrame:
    """First metric of each run whose key matches: it must be finite and at least ``floor``."""
    hit = metrics.filter(F.col("key").rlike(pattern)).groupBy(run).agg(F.min_by(F.struct("key", "value"), "key").alias("m"))
    ok = F.col("m.value").isNotNull() & ~F.isnan("m.value") & (F.abs("m.value") != float("inf")) & (F.col("m.value") >= floor)
    return metrics.select(run).distinct().join(hit, run, "left").select(run, F.col("m.key").alias("key"), F.col("m.value").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def runtime_gate(runs: DataFrame, budget: DataFrame, factor: float = 2.0) -> DataFrame:
    j = runs.join(budget, "arm", "left")
    return j.withColumn("ok", F.coalesce(F.col("elapsed") <= factor * F.col("projected"), F.lit(False)))


def drop_gate(metrics: DataFrame, limits: Mapping[str, float], base: str, other: str) -> DataFrame:
    """Drop of each limited metric from arm ``base`` to arm ``other`` and whether it stays within its limit."""
    pick = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("value")))
    wide = metrics.filter(F.col("key").isin(list(limits))).groupBy("key").agg(pick(base).alias("base"), pick(other).alias("other"))
    limit = F.create_map(*[v for k, x in limits.items() for v in (F.lit(k), F.lit(float(x)))])
    out = wide.select("key", "base", "other", (F.col("base") - F.col("other")).alias("drop"), limit[F.col("key")].alias("limit"))
    return out.withColumn("ok", F.coalesce(F.col("drop") <= F.col("limit"), F.lit(False)))


def inconsistent_records(records: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Stored gate records whose drop is not the difference of its parts."""
    return records.filter(~F.coalesce(F.abs(F.col("base") - F.col("other") - F.col("drop")) <= tolerance, F.lit(False)))


def budget_projection(arms: DataFrame, steps: int, epochs: int, folds: int, gpus: int, price: float) -> DataFrame:
    """GPU hours, wall hours and cost out of seconds per step, with the slowest arm."""
    hours = F.sum(F.col("sec_per_step") * steps * epochs * folds) / 3600.0
    agg = arms.agg(hours.alias("gpu_hours"), F.max_by("arm", "sec_per_step").alias("slowest_arm"))
    return agg.select("gpu_hours", (F.col("gpu_hours") / gpus).alias("wall_hours"), (F.col("gpu_hours") * price).alias("cost"), "slowest_arm")


def check_features(features: DataFrame, width: int) -> DataFrame:
    """Feature rows that are misaligned, not finite, or out of range."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return rule_violations(features, ["row_id"], {
        "width": F.size("f") != width, "not_finite": ~F.forall("f", finite),
        "bad_instance": ~F.coalesce(F.col("instance_id") > 0, F.lit(False)),
        "bad_iou": ~F.coalesce(F.col("anchor_iou").between(0, 1), F.lit(False)),
        "bad_grade": F.coalesce(F.col("supervised"), F.lit(False)) & ~F.coalesce(F.col("grade").between(2, 5), F.lit(False)),
    })


def missing_grades(features: DataFrame, required: Sequence[int] = GRADES) -> DataFrame:
    spark = features.sparkSession
    want = spark.range(1).select(F.explode(F.array(*[F.lit(g).cast("long") for g in required])).alias("grade"))
    have = features.filter("supervised").select(F.col("grade").cast("long").alias("grade"))
    return want.join(have, "grade", "left_anti")


def prevalence(entries: DataFrame) -> DataFrame:
    """Case and lesion counts per grade out of exploded marksheet rows, with totals (null grade)."""
    cases = entries.select("case_id", F.col("case_ISUP").cast("long").alias("grade")).distinct().withColumn("level", F.lit("case"))
    lesions = entries.filter(F.col("entry").isNotNull()).select("case_id", F.col("grade").cast("long").alias("grade")).withColumn("level", F.lit("lesion"))
    both = cases.unionByName(lesions).withColumn("grade", F.coalesce("grade", F.lit(-1)))
    counted = both.rollup("level", "grade").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("level").isNotNull())


def rank_ids(df: DataFrame, keys: Sequence[str], id_col: str, alias: str = "instance_id") -> DataFrame:
    """Renumber ids of a group from 1 in their order."""
    ids = number_rows(df.select(*keys, id_col).distinct(), keys, [F.asc(id_col)], alias)
    return df.join(ids, [*keys, id_col])


